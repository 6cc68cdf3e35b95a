"""The pipeline's stages on the smallest tables."""

import collections

import corpus_pipeline
from loomwork.llm import common, minhash
from tests.conftest import SMALL
from tests.llm.test_neardup import brute


def test_stages(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = {r.doc_id: r for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "quality", "near_dedup", "mixing", "bpe"]
    rows = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before, rows = rows, stage(spark, rows, SMALL)
        assert rows.columns == docs.columns
        kept, there = collections.Counter(r.doc_id for r in rows.collect()), {r.doc_id: r.text for r in before.collect()}
        assert set(kept) <= set(there)
        clean = [d for d in there if d in labels and labels[d].quality == 1 and labels[d].toxic == 0]
        if name in ("toxicity", "quality"):
            assert sum(d in kept for d in clean) >= 0.9 * len(clean)
        if name == "near_dedup":
            groups = brute(list(there.items()))
            assert set(kept) == {d for d in there if groups[d][1] == d}
        if name == "mixing":
            assert max(kept.values()) <= 2
    out = corpus_pipeline.STAGES[-1][1](spark, rows, SMALL)
    assert out.count() == rows.count()
    stage = dict(corpus_pipeline.STAGES)
    assert stage["near_dedup"](spark, odd, SMALL).where("doc_id = 4").count() == 1
    assert minhash.near_duplicates(odd.limit(0)).count() == 0


def test_stages_on_odd_and_empty_tables(spark, odd, nothing):
    """Null doc_ids, repeated rows and clashing columns stay rows; an empty table stays one."""
    odd = odd.withColumn("times", odd.size).withColumn("taken", odd.size).withColumn("first", odd.size)
    stage = dict(corpus_pipeline.STAGES)
    for name in ("toxicity", "quality", "near_dedup", "mixing"):
        rows = stage[name](spark, odd, SMALL)
        assert rows.columns == odd.columns
        for r in rows.collect():
            assert r.times == 1
        none = nothing.withColumn("times", nothing.size)
        assert stage[name](spark, none, SMALL).collect() == []
    assert stage["near_dedup"](spark, odd, SMALL).where("doc_id is null").count() == 2
    assert stage["bpe"](spark, odd, SMALL).count() == odd.count() and stage["bpe"](spark, nothing, SMALL).collect() == []


def test_run_leaves_the_last_stage_only(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    rows = corpus_pipeline.run(spark, SMALL).collect()
    assert rows and [p.name.split("-")[:2] for p in tmp_path.iterdir()] == [["stage", "mixing"]]
