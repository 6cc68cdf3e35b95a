"""The pipeline's mixing stage against the targets of the mix."""

from collections import Counter, defaultdict

import corpus_pipeline
from loomwork.llm import mixing

MIDDLE = "/root/testdata/sf0.01"


def test_words_of_each_source_meet_their_target(spark):
    docs = spark.read.parquet(f"{MIDDLE}/documents.parquet")
    whole = {r.doc_id: r for r in docs.collect()}
    targets = {r.source: r for r in mixing.mix_sources(docs).sources.collect()}
    words, long_words, long_size, texts = Counter(), Counter(), Counter(), defaultdict(list)
    for r in corpus_pipeline.mix_to_weights(spark, docs, MIDDLE).collect():
        words[r.source] += len(r.text.encode().split())
        texts[r.doc_id].append(r.text)
        assert (r.lang, r.n_chars) == (whole[r.doc_id].lang, whole[r.doc_id].n_chars)
    for source, r in targets.items():
        assert abs(words[source] - r.target) <= 128, source
    for doc_id, r in whole.items():
        n = len((r.text or "").encode().split())
        if n >= 1000:
            long_size[r.source] += n
            long_words[r.source] += sum(len(t.encode().split()) for t in texts[doc_id])
    for source, n in long_size.items():
        assert abs(long_words[source] / n - targets[source].target / targets[source].size) < 0.15, source
    assert any(t == whole[d].text for d, ts in texts.items() for t in ts)
    for doc_id, ts in texts.items():
        assert all(Counter(t.split()) <= Counter(whole[doc_id].text.split()) for t in ts)


def test_odd_rows(spark, odd, nothing):
    """Null ids and repeated rows count on their own; the mix takes what the operator says it takes."""
    rows = mixing.passes_of(odd)
    assert rows.columns == odd.columns
    found = Counter()
    for r in rows.collect():
        found[r.source] += len(r.text.encode().split())
    targets = {r.source: r.target for r in mixing.mix_sources(odd).sources.collect()}
    assert all(abs(found[s] - t) <= 64 for s, t in targets.items())
    assert mixing.passes_of(nothing).collect() == []
