"""Connected components of an undirected graph, by alternating stars over a table of edges.

Each step is a grouped minimum and a join of the edges with it. Minima are taken by (vertex, salt of the neighbour)
first and then over a vertex's salts; the result goes back to the salts before the edges are joined with it, so the
edges of a vertex are dealt to up to SALTS tasks, whatever their number. Each round ends in a table in the shared folder
and the one before is deleted.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import release, stored

#: Parts that a vertex's edges are dealt to.
SALTS = 1024


def _salted(directed: DataFrame) -> DataFrame:
    return directed.withColumn("salt", F.pmod(F.xxhash64("b"), F.lit(SALTS)).cast("int"))


def _lowest(salted: DataFrame) -> DataFrame:
    """a, salt, low: the least of a and its neighbours, a row for each salt that a's neighbours have."""
    parts = salted.groupBy("a", "salt").agg(F.min("b").alias("least"))
    lows = parts.groupBy("a").agg(F.min("least").alias("least"), F.collect_list("salt").alias("salts"))  # SALTS at most
    return lows.select("a", F.explode("salts").alias("salt"), F.least("a", "least").alias("low"))


def _once(edges: DataFrame) -> DataFrame:
    """Distinct edges without loops; one shuffle, by the whole edge."""
    return edges.where("a != b").distinct()


def _state(edges: DataFrame) -> tuple:
    """Number and checksum of the edges."""
    return tuple(edges.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())


def connected_components(edges: DataFrame) -> DataFrame:
    """node, component (its least node) of each node of edges(a long, b long); loops and repeats do no harm.

    Edges with a null end don't count; an empty table gives no rows. The rows are read from a stored table.
    """
    edges = edges.where("a is not null and b is not null")
    edges = stored(_once(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b"))), "edges")
    before, state = None, _state(edges)
    while state != before and state[0]:
        both = _salted(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))))
        large = both.where("b > a").join(_lowest(both), ["a", "salt"]).select(F.col("b").alias("a"), F.col("low").alias("b"))
        large = _salted(large)
        lowest = _lowest(large)
        small = large.join(lowest, ["a", "salt"]).select(F.col("b").alias("a"), F.col("low").alias("b")).unionByName(lowest.select("a", F.col("low").alias("b")))
        last, edges = edges, stored(_once(small), "edges")
        release(last)
        before, state = state, _state(edges)
    roots = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    out = stored(edges.select(F.col("a").alias("node"), F.col("b").alias("component")).unionByName(roots), "components")
    release(edges)
    return out
