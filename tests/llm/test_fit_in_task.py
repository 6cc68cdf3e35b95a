"""Models are fitted in a task: the driver's memory holds no training rows and nothing made of them."""

import os

import pytest

from loomwork.llm import quality, toxicity


@pytest.mark.parametrize(("module", "label"), [(toxicity, "toxic"), (quality, "quality")])
def test_the_driver_does_not_fit(spark, monkeypatch, module, label):
    """Pipeline (F1): both models were trained in the driver's Python, which with its JVM went beyond the limit on check_h."""
    here, own = os.getpid(), module.train

    def train(rows):
        assert os.getpid() != here, "fitted by the driver"
        return own(rows)

    monkeypatch.setattr(module, "train", train)
    docs = spark.createDataFrame([(i, f"word{i} of a text number {i * i}. " + ("vilething!" if i % 2 else "It is calm.")) for i in range(1, 61)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, i % 2, 1 - i % 2) for i in range(1, 61)], "doc_id long, toxic int, quality int").select("doc_id", label)
    if module is toxicity:
        scored = module.score_toxicity(docs, labels)
        left = module.without_toxic(docs, labels, 0.5)
    else:
        scored = module.score_quality(docs, labels)
        left = module.with_quality(docs, labels, 0.3)
    good = {r.doc_id for r in scored.collect() if (r.score < 0.5 if module is toxicity else r.score >= 0.3)}
    assert {r.doc_id for r in left.collect()} == good and 0 < len(good) < 60
