"""Sections of whole documents against a plain scan of their lines."""

import re

from loomwork.functions.english import STOP_WORDS
from loomwork.operators.syllabus import BULLET, CLOSING, SECTIONS
from loomwork.plans import registry

BEFORE = "COURSE DESCRIPTION\n"
AFTER = "\nLearning Outcomes\n1. Name things\n2. Weigh them\nTopics\n- Water\n- Fire\nUniversity Policies\nBe kind."
OPENS = {h: name for name, hs in SECTIONS.items() for h in hs} | dict.fromkeys(CLOSING, "")


def scan(text):
    out, last, current, upper = {name: [] for name in SECTIONS}, {}, "", False
    for line in map(str.strip, text.splitlines()):
        if not line:
            continue
        plain = re.sub(r"\s+", " ", re.sub(r"[:.]+$", "", re.sub(BULLET, "", line).lower())).strip()
        after = plain.partition(":")[2].strip()
        few = len(line.split()) <= 3 and not re.match(r"[A-Z]{4} ?\d{3}", line)
        words = " ".join(w for w in re.findall(r"\w+", line) if w.lower() not in STOP_WORDS)
        if plain in OPENS or after in OPENS:
            current = OPENS.get(plain, OPENS.get(after))
            upper = line.isupper()
        elif few and (line.isupper() or (current == "description" and (words.isupper() or (not upper and words.istitle())))):
            current = ""
        elif current:
            items = out[current]
            if items and not re.match(BULLET, line) and (line[0].islower() or last[current].endswith((",", "-"))):
                items[-1] += f" {line}"
            else:
                items.append(re.sub(BULLET, "", line))
            last[current] = line
    return out


def test_sections_of_whole_texts(spark, tmp_path):
    late = "Some words.\n" * 40 + "Assessments\n- Essay, 40%\nRequired Readings\n- A book"
    titled = "about soil\nCourse Policies\nnot this\nOverview: x\nSchedule:\n1. One,\n2. two and\nmore\n\nLECTURES\n- Three\nCONTACT US\nnone"
    texts = {1: late, 2: "short", 3: "", 4: None, 5: titled}
    spark.createDataFrame(list(texts.items()), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    rows = {r.document_id: r for r in registry.queries()["syllabus_sections"](spark, str(tmp_path)).collect()}
    assert rows[1].assessments == ["Essay, 40%"] and rows[1].materials == ["A book"] and len(rows[1].description) == 40
    for doc_id, text in texts.items():
        expected = scan("" if text is None else BEFORE + text + AFTER)
        assert {n: list(rows[doc_id][n]) for n in SECTIONS} == expected


def test_every_topic_heading_opens(spark, tmp_path):
    from loomwork.operators import outline

    assert len(SECTIONS["topics"]) == 38
    docs = [(i, f"{h.title()}:\n- Soil\nCopyright\n- none") for i, h in enumerate(SECTIONS["topics"])]
    found = outline.text_topics(spark.createDataFrame(docs, "document_id long, text string")).collect()
    assert sorted((r.document_id, r.topic) for r in found) == [(i, "Soil") for i, _ in docs]
