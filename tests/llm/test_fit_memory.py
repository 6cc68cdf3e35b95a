"""The driver fits on a bounded sample; what it holds for each token is bounded too."""

import random
import tracemalloc

import pyarrow as pa

from loomwork.llm import toxicity

#: Bytes of arrays for each token at most.
BYTES = 175


def test_training_holds_little_for_each_token():
    """Pipeline: places of weights were 64-bit, and arrays of all features were made in each round."""
    r = random.Random(5)
    words = ["".join(r.choices("abcdefghij", k=6)) for _ in range(3000)]
    labels = [i % 2 for i in range(1500)]
    texts = [" ".join(" ".join(r.choices(words, k=30)) + (" vilething" if y else " calm") for _ in range(9)) for y in labels]
    rows = pa.table({"text": texts, "label": pa.array(labels, pa.int32())})
    toxicity.train(rows.slice(0, 20))  # tables that stay are made once
    tracemalloc.start()
    try:
        tagger = toxicity.train(rows)
        most = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert tagger.weights.any()
    assert most < BYTES * sum(len(t.split()) for t in texts), most / sum(len(t.split()) for t in texts)
