"""The query of each operator of this folder, over whole tables and with production parameters."""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import ann, bpe, licenses, media, minhash, mixing, quality, tokenstore, toxicity, trie, urls, whitening, wrappers
from loomwork.llm.common import held_out, scratch, shared_dir, table

Query = Callable[[SparkSession, str], DataFrame]

RULES = [
    urls.Rule("allow", "org", "/"),
    urls.Rule("block", "example.org", "/es/"),
    urls.Rule("block", "example.org", "/en/1"),
    urls.Rule("allow", "com", "/fr/"),
    urls.Rule("block", "com", "/de/"),
]


def tokenizer() -> tuple[str, str]:
    """Rank file and pattern; the installed package has the file on every executor."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


#: Scores from which a document counts as of good quality, and as toxic.
GOOD_FROM, TOXIC_FROM = 0.3, 0.5


def _predicted(scores: DataFrame, at_least: float, *more: Column) -> DataFrame:
    predicted = (F.col("score") >= at_least).cast("int").alias("predicted")
    return scores.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", predicted, *more)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also n_bad_lines, of the operator's bad lines."""
    scores = quality.score_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    return _predicted(scores, GOOD_FROM, F.size("bad_lines").alias("n_bad_lines"))


#: Neighbours of each query, and which rows are queries.
NEIGHBOURS, QUERY_EVERY = 20, 20


def op2_vector_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch("ann-found") as keep:
        return keep(ann.search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % QUERY_EVERY == 0, NEIGHBOURS))


def op3_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge_urls(table(spark, sf_dir, "pages"), RULES)


def op4_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch("mix-taken") as keep:
        return keep(mixing.words_taken(mixing.mix_sources(table(spark, sf_dir, "documents"), mixing.Mix())))


def op5_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digest_documents(table(spark, sf_dir, "documents"), *tokenizer())


def op6_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.near_duplicates(table(spark, sf_dir, "documents"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Also n_offenders and first_offender (byte), of the operator's spans."""
    scores = toxicity.score_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
    first = F.get("offenders", F.lit(0))["start"]
    return _predicted(scores, TOXIC_FROM, F.size("offenders").alias("n_offenders"), first.alias("first_offender"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


#: Ids of a sequence in the token shards, and sequences of a shard.
SEQUENCE, SHARD_SLOTS = 256, 65_536


def op9_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index of all documents' pieces of sequences, with a checksum of each one's bytes as read back."""
    layout = tokenstore.Layout(*tokenizer(), seq_len=SEQUENCE, shard_slots=SHARD_SLOTS)
    path = f"{shared_dir(spark).rstrip('/')}/token-shards-{uuid.uuid4().hex}"
    index = tokenstore.write_tokens(table(spark, sf_dir, "documents"), path, layout)
    return tokenstore.read_back(index, path, layout).drop("ids")


def op10_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return media.media_digests(media.media_columns(table(spark, sf_dir, "documents")))


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whiten(table(spark, sf_dir, "embeddings"))


def op12_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    with scratch("trie") as keep:
        return keep(trie.prefix_trie(table(spark, sf_dir, "conversations")))


def op13_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wrappers.main_texts(table(spark, sf_dir, "pages"))


def queries() -> dict[str, Query]:
    return {f.__name__: f for f in (op1_quality_classifier, op2_vector_search, op3_url_filters, op4_source_mixing, op5_byte_bpe, op6_minhash_near_dedup, op7_toxicity, op8_license_scan, op9_token_output, op10_media_columns, op11_embedding_whitening, op12_prefix_trie, op13_html_extraction)}
