"""Near-duplicates and components against brute force."""

import collections
import random
import re

import pytest

from loomwork.llm import common, minhash
from loomwork.llm.components import connected_components
from tests.conftest import SMALL


def words_of(text):
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x20\x09-\x0D]+", lowered)


def brute(rows):
    """{doc_id: (n_shingles, component)} by comparing all pairs of sets that share a shingle."""
    sets = {}
    for doc, text in rows:
        w = words_of(text)
        sets[doc] = {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())
    parent = {d: d for d in sets}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    holders = collections.defaultdict(list)
    for d, s in sets.items():
        for g in s:
            holders[g].append(d)
    for d, s in sets.items():
        shared = collections.Counter(o for g in s for o in holders[g] if o < d)
        for o, n in shared.items():
            if 100 * n >= 75 * (len(s) + len(sets[o]) - n):
                a, b = root(d), root(o)
                parent[max(a, b)] = min(a, b)
    return {d: (len(s), root(d)) for d, s in sets.items()}


def got(frame):
    return {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame).collect()}


def test_documents(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    assert got(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_chains_of_copies_that_the_least_member_does_not_link(spark):
    rng = random.Random(3)
    rows, base = [], [f"w{rng.random()}" for _ in range(200)]
    for step in range(40):  # each a little further from the one before
        rows.append((step, " ".join(base)))
        base = list(base)
        at = rng.randrange(len(base))
        base[at] = f"v{rng.random()}"
        base[(at * 7) % len(base)] = f"v{rng.random()}"
    passage = [f"p{i}" for i in range(60)]
    rows += [(100 + i, " ".join(passage + [f"q{i}x{j}" for j in range(25)])) for i in range(60)]
    rows += [(200 + i, " ".join(passage + [f"q7x{j}" for j in range(25 - i)])) for i in range(4)]
    rng.shuffle(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert got(docs) == brute(rows)


def test_odd_rows(odd, nothing):
    rows = minhash.near_duplicates(odd).collect()
    assert len(rows) == odd.count()
    by = collections.defaultdict(list)
    for r in rows:
        by[r.doc_id].append((r.n_shingles, r.component_id, r.kept))
    assert by[1] == by[2][:0] + [(0, 1, True)] and by[2] == [(0, 2, True)] and by[3] == [(0, 3, True)]
    assert by[4] == [(8, 4, True)] * 2 and by[5] == [(8, 4, False)]
    assert sorted(by[None], key=str) == sorted([(8, 4, False), (0, None, False)], key=str)
    assert by[8] == [(1, 8, True)]
    assert minhash.near_duplicates(nothing).collect() == []


def test_estimate_is_corrected_for_chance(spark):
    """Unrelated signatures estimate near 0, equal ones 1."""
    rows = spark.createDataFrame([(i, " ".join(f"{i}-{j}" for j in range(300))) for i in range(20)], "doc_id long, text string")
    made = minhash.sketches(rows).select("doc_id", "signature")
    pairs = made.alias("a").crossJoin(made.alias("b")).selectExpr("a.doc_id as i", "b.doc_id as j", "a.signature as s", "b.signature as t")
    for r in pairs.select("i", "j", minhash.estimate(pairs.s, pairs.t).alias("e")).collect():
        assert r.e == 1 if r.i == r.j else abs(r.e) < 0.15


@pytest.mark.parametrize("edges", [[], [(1, 1)], [(i, i + 1) for i in range(50)], [(0, i) for i in range(1, 50)], [(5, 3), (3, 5), (9, 8), (8, 3), (7, 6)]])
def test_components(spark, edges):
    frame = connected_components(spark.createDataFrame(edges, "a long, b long"))
    parent = {}

    def root(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in edges:
        if a != b:
            x, y = root(a), root(b)
            parent[max(x, y)] = min(x, y)
    assert {r.node: r.component for r in frame.collect()} == {x: root(x) for x in parent}


def test_repeated_rows_do_not_multiply(spark, monkeypatch):
    """Fifty rows of each text: as many nodes, candidates and confirmed pairs as with one row of each."""
    base = [f"w{i}" for i in range(60)]
    rows = [(i, " ".join(base[: 60 - i])) for i in range(4)] + [(9, " ".join(base[::-1]))]
    counts = []
    confirmed = minhash.confirmed

    def counted(pairs, sets):
        found = confirmed(pairs, sets)
        counts.append((pairs.count(), sets.count(), found.count()))
        return found

    monkeypatch.setattr(minhash, "confirmed", counted)
    for times in (1, 50):
        frame = spark.createDataFrame(rows * times, "doc_id long, text string")
        assert got(frame) == brute(rows)
    assert counts[0] == counts[1]


@pytest.mark.parametrize("chunk, grams", [(3, 10**6), (1024, 300)])
def test_small_chunks_lose_no_link(spark, monkeypatch, chunk, grams):
    monkeypatch.setattr(minhash, "CHUNK", chunk)
    monkeypatch.setattr(minhash, "CHUNK_GRAMS", grams)
    test_chains_of_copies_that_the_least_member_does_not_link(spark)


def test_tables_on_the_way_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = minhash.near_duplicates(spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f")], "doc_id long, text string")).collect()
    assert len(rows) == 2 and [p.name.split("-")[:2] for p in tmp_path.iterdir()] == [["near", "result"]]
