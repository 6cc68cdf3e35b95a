"""Joins whose rows out are many times the rows in: dealt by the rows that meet, not by bytes or by the join's few keys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Blocks that the many are dealt into and the few copied to, and tasks of the join.
BLOCKS, TASKS = 32, 128


def met(many: DataFrame, few: DataFrame, on: list[str], by: list[str]) -> DataFrame:
    """many joined with few on the columns. Rows of many go into blocks by hash of `by`, and few are copied to each.

    The number of tasks is set, as AQE would join blocks of few bytes into one task.
    """
    keys = ["_block", *on]
    dealt = many.withColumn("_block", F.pmod(F.xxhash64(*by), F.lit(BLOCKS)))
    copies = few.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(BLOCKS - 1).cast("long"))))
    return dealt.repartition(TASKS, *keys).join(copies.repartition(TASKS, *keys), keys).drop("_block")


def evenly(rows: DataFrame, other: DataFrame, on: list[str], how: str = "inner") -> DataFrame:
    """rows joined with other on the columns, in TASKS tasks by hash of them.

    Groups and windows of keys that begin with the columns follow in the same tasks. AQE would join partitions until a
    task reads 64 MB of compressed shuffle, many million rows here, that sorts and aggregates then hold many times over.
    """
    return rows.repartition(TASKS, *on).join(other.repartition(TASKS, *on), on, how)
