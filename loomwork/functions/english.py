"""English text search: words, stop words and stems, and queries in web-search style.

Stems follow the published Porter2 description. Words are made of letters and digits; other characters part them.
"""

from __future__ import annotations

import re
from dataclasses import dataclass
from functools import lru_cache

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, StringType

#: Words that no search needs (fixed values).
STOP_WORDS = frozenset(
    """i me my myself we our ours ourselves you your yours yourself yourselves he him his himself she her hers herself it
    its itself they them their theirs themselves what which who whom this that these those am is are was were be been
    being have has had having do does did doing a an the and but if or because as until while of at by for with about
    against between into through during before after above below to from up down in out on off over under again further
    then once here there when where why how all any both each few more most other some such no nor not only own same so
    than too very s t can will just don should now""".split()
)
_WORD = r"[\p{L}\p{N}]+"
_VOWEL = "aeiouy"


def words(text: Column) -> Column:
    """Lower-case words in order; null counts as empty."""
    return F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(f"({_WORD})"), 1)


def _regions(w: str) -> tuple[int, int]:
    """Where the parts after the first and second vowel-consonant pair begin."""

    def after(start: int) -> int:
        for i in range(start + 1, len(w)):
            if w[i] not in _VOWEL and w[i - 1] in _VOWEL:
                return i + 1
        return len(w)

    first = next((len(p) for p in ("gener", "commun", "arsen") if w.startswith(p)), None)
    r1 = after(0) if first is None else first
    return r1, after(r1)


def _short_end(w: str) -> bool:
    if len(w) == 2:
        return w[0] in _VOWEL and w[1] not in _VOWEL
    return len(w) > 2 and w[-1] not in _VOWEL + "wxY" and w[-2] in _VOWEL and w[-3] not in _VOWEL


#: Words with stems of their own (fixed values).
_SPECIAL = {"skis": "ski", "skies": "sky", "dying": "die", "lying": "lie", "tying": "tie", "idly": "idl", "gently": "gentl", "ugly": "ugli", "early": "earli", "only": "onli", "singly": "singl", **{w: w for w in "sky news howe atlas cosmos bias andes".split()}}
_KEPT = frozenset("inning outing canning herring earring proceed exceed succeed".split())
#: Endings and what takes their place in the region after the first pair (fixed values).
_STEP2 = [("ational", "ate"), ("ization", "ize"), ("fulness", "ful"), ("ousness", "ous"), ("iveness", "ive"), ("tional", "tion"), ("biliti", "ble"), ("lessli", "less"), ("entli", "ent"), ("ation", "ate"), ("alism", "al"), ("aliti", "al"), ("ousli", "ous"), ("iviti", "ive"), ("fulli", "ful"), ("enci", "ence"), ("anci", "ance"), ("abli", "able"), ("izer", "ize"), ("ator", "ate"), ("alli", "al"), ("bli", "ble")]
_STEP3 = [("ational", "ate"), ("tional", "tion"), ("alize", "al"), ("icate", "ic"), ("iciti", "ic"), ("ical", "ic"), ("ness", ""), ("ful", "")]
_STEP4 = sorted("al ance ence er ic able ible ant ement ment ent ism ate iti ous ive ize".split(), key=len, reverse=True)


@lru_cache(maxsize=100_000)
def stem(word: str) -> str:
    w = word
    if len(w) <= 2:
        return w
    if w in _SPECIAL:
        return _SPECIAL[w]
    w = re.sub(f"(?<=[{_VOWEL}])y|^y", "Y", w)
    r1, r2 = _regions(w)
    if w.endswith("sses"):
        w = w[:-2]
    elif w.endswith(("ied", "ies")):
        w = w[:-2] if len(w) > 4 else w[:-1]
    elif w.endswith("s") and not w.endswith(("us", "ss")) and any(c in _VOWEL for c in w[:-2]):
        w = w[:-1]
    if w in _KEPT:
        return w
    for end in ("eedly", "eed"):
        if w.endswith(end):
            w = w[: len(w) - len(end)] + "ee" if len(w) - len(end) >= r1 else w
            break
    else:
        for end in ("ingly", "edly", "ing", "ed"):
            if w.endswith(end):
                base = w[: -len(end)]
                if any(c in _VOWEL for c in base):
                    w = base
                    if w.endswith(("at", "bl", "iz")):
                        w += "e"
                    elif w.endswith(("bb", "dd", "ff", "gg", "mm", "nn", "pp", "rr", "tt")):
                        w = w[:-1]
                    elif _short_end(w) and r1 >= len(w):
                        w += "e"
                break
    if len(w) > 2 and w[-1] in "yY" and w[-2] not in _VOWEL:
        w = w[:-1] + "i"
    for end, put in _STEP2:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + put
            break
    else:
        if w.endswith("ogi") and len(w) - 3 >= r1 and w[-4] == "l":
            w = w[:-1]
        elif w.endswith("li") and len(w) - 2 >= r1 and w[-3] in "cdeghkmnrt":
            w = w[:-2]
    for end, put in _STEP3:
        if w.endswith(end):
            if len(w) - len(end) >= r1:
                w = w[: -len(end)] + put
            break
    else:
        if w.endswith("ative") and len(w) - 5 >= r2:
            w = w[:-5]
    for end in _STEP4:
        if w.endswith(end):
            if len(w) - len(end) >= r2:
                w = w[: -len(end)]
            break
    else:
        if w.endswith("ion") and len(w) - 3 >= r2 and w[-4] in "st":
            w = w[:-3]
    if w.endswith("e"):
        if len(w) - 1 >= r2 or (len(w) - 1 >= r1 and not _short_end(w[:-1])):
            w = w[:-1]
    elif w.endswith("ll") and len(w) - 1 >= r2:
        w = w[:-1]
    return w.lower()


@F.arrow_udf(ArrayType(StringType()))
def stems(tokens: pa.Array) -> pa.Array:
    """Stems of words in order, an empty string in the place of a stop word.

    Only the distinct words of a batch become Python strings, so memory follows Arrow's columns, not the words.
    """
    words = tokens.flatten().dictionary_encode()
    known = pa.array(["" if w in STOP_WORDS else stem(w) for w in words.dictionary.to_pylist()], pa.string())
    ends = pc.cumulative_sum(pc.fill_null(pc.list_value_length(tokens), 0))
    return pa.ListArray.from_arrays(pa.concat_arrays([pa.array([0], ends.type), ends]), known.take(words.indices))


@dataclass(frozen=True)
class Term:
    """Words that must stand next to each other (one word: a plain term), or must not."""

    words: tuple[str, ...]
    negated: bool = False


def parse(text: str) -> list[list[Term]]:
    """A web-search query as alternatives (OR) of terms that all hold: words, "phrases", -not."""
    alternatives: list[list[Term]] = [[]]
    for minus, phrase, plain in re.findall(r'(-?)(?:"([^"]*)"?|([^\s"]+))', text):
        if plain.upper() == "OR" and not minus:
            alternatives.append([])
            continue
        found = tuple(re.findall(r"[^\W_]+", (phrase or plain).lower()))
        if found:
            alternatives[-1].append(Term(found, bool(minus)))
    return [a for a in alternatives if a]


def _holds(tokens: Column, term: Term) -> Column:
    """An empty word of a phrase stands for any one word; at its ends it asks for nothing."""
    named = [k for k, w in enumerate(term.words) if w]
    term = Term(term.words[named[0] : named[-1] + 1], term.negated)
    if len(term.words) == 1:
        out = F.array_contains(tokens, term.words[0])
    else:
        starts = F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(tokens) - len(term.words)))

        def at(i: Column) -> Column:
            same = F.lit(True)
            for k, w in enumerate(term.words):
                same = same & F.coalesce(F.get(tokens, i + k) == w, F.lit(False)) if w else same
            return same

        out = F.array_contains(tokens, term.words[0]) & F.exists(starts, at)
    return ~out if term.negated else out


def matches(tokens: Column, query: str, stemmed: bool = False) -> Column:
    """Whether a token array meets the query; stop words in it ask for nothing, and a query of none matches nothing."""
    out = F.lit(False)
    for alternative in parse(query):
        terms = [Term(tuple("" if w in STOP_WORDS else stem(w) for w in t.words), t.negated) for t in alternative] if stemmed else alternative
        terms = [t for t in terms if any(t.words)]
        if terms:
            every = F.lit(True)
            for t in terms:
                every = every & _holds(tokens, t)
            out = out | every
    return out


#: A course's code and number at the start of a query, maybe run together (a fixed pattern).
CODE_AND_NUMBER = r"^([A-Za-z]+(?:_[A-Za-z]+)?)\s*(\d+)\b"


def course_code_query(text: str) -> str:
    """A query that starts with a code and number run together, with a blank between them."""
    return re.sub(CODE_AND_NUMBER, r"\1 \2", text)


def course_code_text(text: Column) -> Column:
    """course_code_query() of a column of queries, such as a log of searches."""
    return F.regexp_replace(text, CODE_AND_NUMBER, "$1 $2")


def normalized(text: str | None) -> str:
    """Trimmed, white space collapsed; empty means no search."""
    return re.sub(r"\s+", " ", text or "").strip()


#: Fragments of a headline, and least and most words of one (fixed values).
FRAGMENTS, LEAST_WORDS, MOST_WORDS = 2, 4, 20
_PIECES = r"([\p{L}\p{N}]+|[^\p{L}\p{N}]+)"


def wanted_words(query: str, stemmed: bool = False) -> list[str]:
    """The words, or stems, that a headline marks: all that the query asks for."""
    return sorted({(stem(w) if stemmed else w) for a in parse(query) for t in a if not t.negated for w in t.words if not (stemmed and w in STOP_WORDS)})


def headline(text: Column, tokens: Column, wanted: list[str]) -> Column:
    """Up to FRAGMENTS parts of the text that hold most wanted words, <mark>ed, HTML-escaped, in order; null without any.

    tokens are the text's words (or stems) in order. A part is a run of words from a wanted one on: of all such the one
    with most different wanted words is taken, of equals that with most wanted words, then the first; and then the best
    one of those apart from it. Parts are widened by LEAST_WORDS words before and up to MOST_WORDS in all.
    """
    asked, reach = F.array(*map(F.lit, wanted)).cast("array<string>"), MOST_WORDS - LEAST_WORDS
    # each step is made once and handed to the next as a struct's field
    once = lambda value, use: F.transform(F.array(value), use)[0]

    def with_hits(w: Column) -> Column:
        hits = F.filter(F.transform(w, lambda t, i: F.when(F.array_contains(asked, t), i)), lambda i: i.isNotNull())
        return once(hits, lambda h: F.when(F.size(h) > 0, rendered(w, h)))

    def windows(w: Column, hits: Column) -> Column:
        def one(p: Column) -> Column:
            inside = F.filter(hits, lambda h: (h >= p) & (h < p + reach))
            return F.struct(F.size(F.array_distinct(F.transform(inside, lambda h: F.get(w, h)))).alias("kinds"), F.size(inside).alias("n"), (-p).alias("before"))

        return F.transform(hits, one)

    def widened(best: Column, first: Column, last: Column) -> Column:
        start = F.greatest(first, -best["before"] - LEAST_WORDS)
        return F.struct(start.alias("start"), F.least(last, start + (MOST_WORDS - 1)).alias("end"))

    def rendered(w: Column, hits: Column) -> Column:
        end = F.size(w) - 1

        def parts(all_windows: Column) -> Column:
            return once(widened(F.array_max(all_windows), F.lit(0), end), lambda first: both(all_windows, first))

        def both(all_windows: Column, first: Column) -> Column:
            after = lambda x: -x["before"] > first["end"]
            apart = F.filter(all_windows, lambda x: after(x) | (-x["before"] + reach <= first["start"]))
            second = F.array_max(apart)
            wide = F.when(after(second), widened(second, first["end"] + 1, end)).otherwise(widened(second, F.lit(0), first["start"] - 1))
            some = F.when(F.size(apart) > 0, F.array_sort(F.array(first, wide))).otherwise(F.array(first))
            pieces = F.regexp_extract_all(text, F.lit(_PIECES), 1)
            return once(pieces, lambda q: F.array_join(F.transform(some, lambda f: marked(q, f)), " ... "))

        def marked(pieces: Column, part: Column) -> Column:
            lead = F.when(F.get(pieces, F.lit(0)).rlike(r"^[\p{L}\p{N}]"), 0).otherwise(1)  # words and others take turns
            own = F.slice(pieces, lead + part["start"] * 2 + 1, (part["end"] - part["start"]) * 2 + 1)
            safe = lambda x: F.replace(F.replace(F.replace(F.replace(x, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;"))
            word = lambda x, i: F.when((i % 2 == 0) & F.array_contains(hits, (part["start"] + i / 2).cast("int")), F.concat(F.lit("<mark>"), safe(x), F.lit("</mark>"))).otherwise(safe(x))
            return F.array_join(F.transform(own, word), "")

        return once(windows(w, hits), parts)

    return once(tokens, with_hits)
