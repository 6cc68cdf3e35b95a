"""Places in an order, pages, and exact samples against sorted lists."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from loomwork.operators import evaluation, paging


@pytest.fixture
def rows(spark):
    rng = random.Random(2)
    texts = [None, "", "a", "b" * 40, "b" * 40 + "c", "é", "zz"]
    out = [(i, rng.choice(texts), rng.choice([None, dt.datetime(2024, 1, 1) + dt.timedelta(seconds=rng.randint(0, 50))]), rng.choice([None, 0.5, -1.5, 3.0])) for i in range(700)]
    return out, spark.createDataFrame(out, "id long, t string, at timestamp, x double").repartition(3)


ORDERS = [[("id", True)], [("t", True), ("id", False)], [("at", False), ("x", True), ("id", True)], [("x", False), ("t", False), ("id", False)]]


def ordered(out, order):
    """Nulls are lowest; strings by bytes."""
    for name, down in reversed(order):
        k = ("id", "t", "at", "x").index(name)
        low = {0: -1, 1: b"", 2: dt.datetime(1, 1, 1), 3: float("-inf")}[k]
        out = sorted(out, key=lambda r, k=k, low=low: (r[k] is not None, r[k].encode() if k == 1 and r[k] is not None else low if r[k] is None else r[k]), reverse=down)
    return out


@pytest.mark.parametrize("order", ORDERS)
def test_places_and_pages(monkeypatch, rows, order):
    monkeypatch.setattr(paging, "FEW", 100)
    monkeypatch.setattr(paging, "BUCKETS", 16)
    plain, frame = rows
    want = ordered(plain, order)
    for place in (351,):
        key = paging.key_at(frame, order, place)
        assert [key[n] for n, _ in order] == [want[place][("id", "t", "at", "x").index(n)] for n, _ in order]
    assert paging.key_at(frame, order, 700) is None and paging.key_at(frame.limit(0), order, 0) is None
    for number, got in ((1, 1), (10**9, 47)):
        page, at = paging.page_of(frame, order, number, 15)
        assert at == got and [r.id for r in page.collect()] == [r[0] for r in want[(got - 1) * 15 : got * 15]]
    plan = page._jdf.queryExecution().executedPlan().toString()
    assert "limit=15" in plan and "offset" not in plan.lower().replace("offset 0", "")


def test_exact_samples(spark, monkeypatch):
    monkeypatch.setattr(paging, "FEW", 50)
    rows = spark.range(2000).select("id", (F.col("id") % 10 == 0).cast("int").alias("y"))
    sample = evaluation.balanced(rows, "y")
    assert sample.where("y = 1").count() == sample.where("y = 0").count() == 200
    again = evaluation.balanced(rows.repartition(5), "y")
    assert sorted(r.id for r in sample.collect()) == sorted(r.id for r in again.collect()), "reruns agree"
    assert {r.id for r in sample.collect()} != {r.id for r in evaluation.balanced(rows, "y", seed=1).collect()}
    parts = [{r.id for r in p.collect()} for p in evaluation.split(sample)]
    assert [len(p) for p in parts] == [320, 40, 40] and len(set.union(*parts)) == 400
    assert sorted(r.id for r in evaluation.shuffled(sample).collect()) == sorted(r.id for r in sample.collect())
    assert evaluation.balanced(rows.where("y = 1"), "y").count() == 200 and evaluation.balanced(rows.limit(0), "y").count() == 0
    assert [p.count() for p in evaluation.split(rows.limit(0))] == [0, 0, 0]


def test_hashes_at_places(spark, monkeypatch):
    """places of hashes by counts of their digits, all places in one pass a digit, ties and one value included."""
    monkeypatch.setattr(paging, "FEW", 20)
    values = [random.Random(i).randint(-(1 << 63), (1 << 63) - 1) for i in range(300)] + [5] * 50 + [-(1 << 63), (1 << 63) - 1]
    rows = spark.createDataFrame([(v,) for v in values], f"{paging.HASH} long").repartition(3)
    want = sorted(values)
    places = [0, 1, want.index(5), want.index(5) + 49, 200, 351]
    assert paging.hash_at(rows, places) == [want[p] for p in places]
    assert paging.hash_at(rows, [352, -1]) == [None, None] and paging.hash_at(rows.limit(0), [0]) == [None]
    assert paging.lowest(rows, want.index(5) + 7).count() == want.index(5) + 7 and paging.lowest(rows, 999).count() == 352
    assert [p.count() for p in paging.parts(rows, [0.25, 0.5, 0.25])] == [88, 176, 88]
