"""A training corpus from raw documents: filters, one document of each group of near copies, a mix, token ids.

Each stage takes (spark, docs, sf_dir); all but the last return the columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomwork.llm import bpe, minhash, mixing, quality, toxicity
from loomwork.llm.common import release, scratch, table
from loomwork.llm.queries import GOOD_FROM, TOXIC_FROM, tokenizer


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below TOXIC_FROM. Empty texts and null doc_ids are scored like others."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"), TOXIC_FROM)


def keep_good(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality is GOOD_FROM or more. Empty texts and null doc_ids are scored like others."""
    return quality.with_quality(docs, table(spark, sf_dir, "labels"), GOOD_FROM)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group stays, and one row of a doc_id, the least; rows without a doc_id all stay."""
    verdicts = minhash.near_duplicates(docs).where("doc_id is not null")
    gone = verdicts.where("not kept").select("doc_id").distinct()
    kept = docs.join(gone, "doc_id", "left_anti").select(docs.columns)
    repeated = docs.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").select("doc_id")
    if repeated.isEmpty():
        return kept
    own = F.struct(*[c for c in docs.columns])
    once = kept.join(repeated, "doc_id", "left_semi").groupBy(F.col("doc_id").alias("_id")).agg(F.min(own).alias("_row")).select("_row.*")
    return kept.join(repeated, "doc_id", "left_anti").unionByName(once.select(docs.columns)).select(docs.columns)


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The words that the mix takes of each document, a row for each pass; one of which it takes none goes.

    Texts without words have nothing to take. A null source is a source; null doc_ids and repeated rows count alone.
    """
    return mixing.passes_of(docs)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row; a null text has no ids."""
    return bpe.digest_documents(docs, *tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("quality", keep_good),
    ("near_dedup", drop_near_copies),
    ("mixing", mix_to_weights),
    ("bpe", encode),
]

#: SQL can express neither the classifiers nor the tokenizer; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each one's rows in a table of the shared folder before the next.

    Tables that a stage made on its way go with its end, and its input with the end of the next.
    """
    docs = last = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with scratch(f"stage-{name}") as keep:
            last, docs = docs, keep(stage(spark, docs, sf_dir))
        if hasattr(last, "stored_at"):
            release(last)
    return STAGES[-1][1](spark, docs, sf_dir)
