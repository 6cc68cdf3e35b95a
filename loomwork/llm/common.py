"""Session helpers that the operators of this folder share."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Used only where a session in local mode names no shared folder, as in tests.
LOCAL_CHECKPOINTS = "file:///tmp/checkpoints"
#: Rows of one key that a running total adds up in one task at either of its levels, about.
TOTAL_STEP = 4096

#: White space and words by the contracts of the queries: bytes, not Unicode classes.
WORD = r"[^\x20\x09-\x0D]+"


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir; an error on a cluster that names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named and not spark.conf.get("spark.master", "").startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
    return named or LOCAL_CHECKPOINTS


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Writes df to a new table in the shared folder and reads it back: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    df.write.options(**options).parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    for made in _scratch:
        made.append(out)
    return out


_scratch: list[list[DataFrame]] = []


@contextmanager
def scratch(result: str) -> Iterator[Callable[[DataFrame], DataFrame]]:
    """Gives a function that stores a result under that name; the other tables stored inside go at the end."""
    made: list[DataFrame] = []
    kept: list[DataFrame] = []
    _scratch.append(made)

    def keep(df: DataFrame) -> DataFrame:
        kept.append(stored(df, result))
        return kept[-1]

    try:
        yield keep
        release(*[t for t in made if all(t is not k for k in kept)])
    finally:
        _scratch.remove(made)


def release(*tables: DataFrame) -> None:
    """Deletes tables that stored() made; nothing that is still to be computed may read them."""
    for t in tables:
        remove(t.sparkSession, t.stored_at)


def remove(spark: SparkSession, path: str) -> None:
    """Deletes a file or folder, on any file system that Spark reaches."""
    jvm = spark._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


def running_before(df: DataFrame, keys: list[str], place: str, value: str, name: str) -> DataFrame:
    """df with name: the sum of value over the rows of the same keys whose place (long, from 0, unique) is smaller.

    Two levels: within runs of TOTAL_STEP places, and over the sums of those runs, so no task adds up all rows of a key.
    """
    run = F.call_function("div", F.col(place), F.lit(TOTAL_STEP)).alias("_run")
    each = df.select("*", run)
    sums = each.groupBy(*keys, "_run").agg(F.sum(value).alias("_sum"))
    upto = F.sum("_sum").over(Window.partitionBy(*keys).orderBy("_run"))
    sums = sums.select(*[F.col(k).alias(f"_of_{k}") for k in keys], F.col("_run").alias("_at"), (upto - F.col("_sum")).alias("_base"))
    inner = F.sum(value).over(Window.partitionBy(*keys, "_run").orderBy(place)) - F.col(value)
    same = F.col("_run") == F.col("_at")
    for k in keys:
        same = same & F.col(k).eqNullSafe(F.col(f"_of_{k}"))
    return each.withColumn("_inner", inner).join(sums, same).select(*df.columns, (F.col("_base") + F.col("_inner")).alias(name))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def lower_ascii(text: Column) -> Column:
    """A-Z to a-z, and no other letters."""
    return F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def held_out(doc_id: Column) -> Column:
    """crc32 of doc_id as text is divisible by 5; false for a null doc_id."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def numbered(df: DataFrame, key: str, order: list[str], name: str) -> DataFrame:
    """df with name: how many rows of the same key (long, not null) stand before it by `order`, nulls first.

    Rows are cut into ranges of (key, order) and numbered in each, and the ranges before are added, so a key with any
    share of the rows spreads over many tasks. Rows that tie in `order` get numbers in any order.
    """
    by = [F.col(c).asc_nulls_first() for c in (key, *order)]
    cut = stored(df.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_row", F.monotonically_increasing_id()), "numbered")
    cut = cut.withColumn("_part", F.shiftright("_row", 33))
    parts = cut.groupBy(key, "_part").agg(F.min("_row").alias("_first"), F.count("*").alias("_n"))
    before = F.sum("_n").over(Window.partitionBy(key).orderBy("_part")) - F.col("_n")
    parts = parts.select(F.col(key).alias("_key"), F.col("_part").alias("_of"), (before - F.col("_first")).alias("_base"))
    found = cut.join(parts, (F.col(key) == F.col("_key")) & (F.col("_part") == F.col("_of")))
    return found.select(*df.columns, (F.col("_row") + F.col("_base")).alias(name))
