"""The stored index against a search that reads all texts, and headlines against a plain walk."""

import random
import re

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from loomwork.functions import english
from loomwork.operators import search
from loomwork.sources.search_index import SearchIndex

WORDS = "soil water fire forest the of climate running runs ring".split()
VECTOR = "course_id long, property string, matched_text string, file_name string, page_number long, text_id long"


def vectors(spark, rows, stemmed=False):
    frame = spark.createDataFrame([(c, p, text, None, None, i) for i, (c, p, text) in rows], VECTOR)
    tokens = english.words(F.col("matched_text"))
    return frame.withColumn("tokens", english.stems(tokens) if stemmed else tokens)


QUERIES = ["soil", "soil water", '"soil water"', "fire OR forest", "soil -water", "-soil", '-"the of" fire', '"climate" OR "ring of fire"', "nothing", '"the"', "soil OR -water"]


@pytest.mark.parametrize("stemmed", [False, True])
def test_index_gives_the_same_rows(spark, tmp_path, stemmed):
    rng = random.Random(3)
    rows = [(i, (i % 9, rng.choice(["topic", "description"]), " ".join(rng.choices(WORDS, k=rng.randint(0, 7))))) for i in range(150)]
    all_rows = vectors(spark, rows, stemmed)
    index = SearchIndex(spark, str(tmp_path / "index"), stemmed)
    index.add(all_rows, 0)
    changed = [(i, (c, p, "soil of fire" if i % 2 else None)) for i, (c, p, _) in rows if i % 5 == 0]
    after = vectors(spark, [(i, r) for i, r in rows if i % 5] + [(i, r) for i, r in changed if r[2]], stemmed)
    plain = lambda frame: sorted(map(str, frame.collect()))
    for _ in range(2):  # a generation added again changes nothing
        for stored, extra in ((all_rows, None), (after, changed)):
            if extra:
                index.add(vectors(spark, extra, stemmed), 1)
            for query in QUERIES[:: 1 if extra is None else 3]:
                request = search.Request(query, properties=("topic", "description"), stemmed=stemmed)
                assert plain(index.matches(request)) == plain(search.matches_in(stored, request)), (query, extra is not None)
        all_rows = after


def walk(text, wanted, least=4, most=20):
    found = list(re.finditer(r"[^\W_]+", text))
    hits = [i for i, m in enumerate(found) if m[0].lower() in wanted]
    windows = []
    for p in hits:
        inside = [h for h in hits if p <= h < p + most - least]
        windows.append((len({found[h][0].lower() for h in inside}), len(inside), -p))
    if not windows:
        return None

    def widen(w, low, high):
        start = max(low, -w[2] - least)
        return start, min(high, start + most - 1)

    parts = [widen(max(windows), 0, len(found) - 1)]
    start, end = parts[0]
    rest = [w for w in windows if -w[2] > end or -w[2] + most - least <= start]
    if rest:
        best = max(rest)
        parts.append(widen(best, end + 1, len(found) - 1) if -best[2] > end else widen(best, 0, start - 1))
    out = []
    for a, b in sorted(parts):
        piece, at = "", found[a].start()
        for i in range(a, b + 1):
            piece += english_escape(text[at : found[i].start()]) + (f"<mark>{found[i][0]}</mark>" if i in hits else found[i][0])
            at = found[i].end()
        out.append(piece)
    return " ... ".join(out)


def english_escape(text):
    return text.replace("&", "&amp;").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")


def test_headlines_against_a_plain_walk(spark):
    rng = random.Random(5)
    texts = ["", "soil", " <Soil>", 'x & "Fire"!', None]
    texts += ["".join(rng.choice([" ", ", ", " <", "&"]) + rng.choice(["a", "b", "c", "d", "Soil", "fire"]) * (rng.random() < 0.9) for _ in range(rng.choice([3, 30, 120]))) for _ in range(60)]
    rows = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = rows.select("i", english.headline(F.col("t"), english.words(F.col("t")), ["fire", "soil"]).alias("x")).collect()
    assert {r.i: r.x for r in got} == {i: walk(t or "", {"fire", "soil"}) for i, t in enumerate(texts)}


def test_postings_take_one_shuffle(spark, tmp_path, monkeypatch):
    """Lists of positions are made within the ranges that they are written in."""
    from pyspark.sql import DataFrameWriter

    plans, write = [], DataFrameWriter.parquet
    monkeypatch.setattr(DataFrameWriter, "parquet", lambda self, path, *a, **k: (plans.append((path, self._df._jdf.queryExecution().executedPlan().toString())), write(self, path, *a, **k))[1])
    rows = [("topic", i, i, f"a b{i} a", ["a", f"b{i}", "a"]) for i in range(20)]
    vectors = spark.createDataFrame(rows, "property string, text_id long, course_id long, matched_text string, tokens array<string>")
    monkeypatch.setattr("loomwork.sources.search_index.FOUND", ["course_id", "property", "matched_text"])
    index = SearchIndex(spark, f"file://{tmp_path}/i")
    index.add(vectors, 0)
    plan = next(p for path, p in plans if "postings" in path)
    assert plan.count("Exchange") == 1
    assert {tuple(r.positions) for r in spark.read.parquet(f"{index.path}/postings").where("token = 'a'").collect()} == {(0, 2)}


def test_stems_of_batches(spark):
    """as stem() word by word, with empty and sliced lists, from distinct words."""
    words = [["running", "the", "climates"], [], ["climates", "licensing"]] * 7
    frame = spark.createDataFrame([(i, w) for i, w in enumerate(words)], "i long, w array<string>").coalesce(1)
    found = {r.i: r.s for r in frame.select("i", english.stems("w").alias("s")).collect()}
    assert [found[i] for i in range(len(words))] == [["" if x in english.STOP_WORDS else english.stem(x) for x in w] for w in words]
    sliced = pa.array(words).slice(1, 3)
    assert english.stems.func(sliced).to_pylist() == [found[1], found[2], found[3]]
