"""Approximate nearest neighbours by inner product: an inverted file of product-quantised residuals, exactly reranked.

Coarse centroids and codebooks are fitted on a bounded sample. Every vector is indexed: its nearest centroid's list
and a code of SUBSPACES bytes for the residual. A query looks into the lists of its best centroids, and into further
ones until those hold k other vectors; tables of its
inner products with all codewords score their codes, and the best of each piece are scored again on the original
vectors, in double precision. Small lists are packed and large ones cut into pieces of bounded size, and
queries are dealt into blocks, so a list that holds a third of all rows, or is wanted by a third of all queries,
spreads over many tasks.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import stored

#: Bound of the sample that centroids and codebooks are fitted on: the vectors whose vec_id hashes lowest.
FIT_VECTORS = 20_000
SUBSPACES, CODES = 16, 256
#: Lists: LISTS_ROOT times the root of the number of vectors, within bounds; a query probes this part of them. The part
#: is large as vectors without much of a cluster structure have their neighbours in many lists.
LISTS_ROOT, LEAST_LISTS, MOST_LISTS = 1.2, 64, 4096
PROBED = 0.66
#: Reranked are the RERANK best codes of a piece and all that its k-th best may hide by MARGIN deviations of their
#: quantisation error in one direction, which is all of a cluster too tight for the codes to tell apart.
RERANK, MARGIN = 250, 2.0
#: Vectors of a piece, about, and queries of a block: what meets in one task. Each vector is sent to as many tasks as
#: there are blocks, each query to one for each piece it probes, so both are as large as a task's memory lets them be.
PIECE, BLOCK = 16_384, 16_384
ROUNDS = 8


@dataclass(frozen=True)
class Index:
    """Fitted parts: centroids (lists x dim), and codebooks (subspaces x codes x width) of residuals."""

    centroids: np.ndarray
    codebooks: np.ndarray

    @property
    def cuts(self) -> list[np.ndarray]:
        return np.array_split(np.arange(self.centroids.shape[1]), len(self.codebooks))


def nearest(x: np.ndarray, centres: np.ndarray) -> np.ndarray:
    """Index of the closest centre (Euclidean) of each row."""
    half = (centres**2).sum(axis=1) / 2
    return np.concatenate([(x[i : i + 4096] @ centres.T - half).argmax(axis=1) for i in range(0, len(x), 4096)] or [np.empty(0, np.int64)])


def k_means(x: np.ndarray, k: int, seed: int) -> np.ndarray:
    """Up to k centres of the distinct rows of x, after ROUNDS rounds; a centre that loses its rows stays."""
    distinct = np.unique(x, axis=0)
    centres = distinct[np.random.default_rng(seed).permutation(len(distinct))[:k]].copy()
    for _ in range(ROUNDS if len(centres) == k else 0):
        own = nearest(x, centres)
        n = np.bincount(own, minlength=k)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, x)
        centres[n > 0] = sums[n > 0] / n[n > 0, None]
    return centres


def fit(sample: np.ndarray, lists: int) -> Index:
    x = np.unique(sample.astype(np.float64), axis=0)  # a very common vector counts once
    centroids = k_means(x, lists, 1)
    residuals = x - centroids[nearest(x, centroids)]
    cuts = np.array_split(np.arange(x.shape[1]), min(SUBSPACES, x.shape[1]))
    width = max(map(len, cuts))
    books = np.zeros((len(cuts), CODES, width))
    for i, cut in enumerate(cuts):
        found = k_means(residuals[:, cut], CODES, 2 + i)
        books[i, : len(found), : len(cut)] = found
        books[i, len(found) :, : len(cut)] = found[0]
    return Index(centroids, books)


def encode(index: Index, x: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(list, codes, length of the quantisation error) of each row."""
    lists = nearest(x, index.centroids)
    residuals = x - index.centroids[lists]
    codes, error = np.empty((len(x), len(index.codebooks)), np.uint8), np.zeros(len(x))
    for i, cut in enumerate(index.cuts):
        book = index.codebooks[i][:, : len(cut)]
        codes[:, i] = nearest(residuals[:, cut], book)
        error += ((residuals[:, cut] - book[codes[:, i]]) ** 2).sum(axis=1)
    return lists, codes, np.sqrt(error)


def tables(index: Index, q: np.ndarray) -> np.ndarray:
    """Inner products of one query's parts with all codewords: subspaces x codes."""
    return np.stack([index.codebooks[i][:, : len(cut)] @ q[cut] for i, cut in enumerate(index.cuts)])


def packed(counts: dict[int, int]) -> list[tuple[int, int, int]]:
    """(list, group, pieces): small lists share a group of PIECE rows or so, a larger one is a group of some pieces."""
    out, group, held = [], 0, 0
    for number, n in sorted(counts.items()):
        if held and held + n > PIECE:
            group, held = group + 1, 0
        held += n
        out.append((number, group, -(-n // PIECE)))
    return out


def takes_part(vector: Column, dim: int) -> Column:
    """Not null, of dim components, all finite, one not zero."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))
    return F.coalesce((F.size(vector) == dim) & F.forall(vector, fine) & F.exists(vector, lambda x: x != 0), F.lit(False))


def _matrix(column: pa.Array) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def search(vectors: DataFrame, queries: Column, k: int) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the k nearest found of each row that `queries` selects.

    vectors has vec_id and embedding. Rows with a null vec_id and vectors that are null, zero, not of the most
    frequent length, or hold a null or non-finite component take no part. A row is no candidate for its own vec_id;
    repeated vec_ids count once, with the best score. Ties go to smaller vec_ids. Other columns are left out; a table
    without queries or candidates gives no rows.
    """
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding", F.coalesce(queries, F.lit(False)).alias("asks")).where("vec_id is not null")
    lengths = rows.where("size(embedding) > 0").groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), "d").first()
    empty = rows.sparkSession.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    if lengths is None:
        return empty
    rows = rows.where(takes_part(F.col("embedding"), lengths.d))
    count = rows.count()
    sample = rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(FIT_VECTORS).select("embedding").toArrow()
    if not count:
        return empty
    index = fit(_matrix(sample.column(0)), min(MOST_LISTS, max(LEAST_LISTS, round(LISTS_ROOT * math.sqrt(count)))))
    probes = min(len(index.centroids), max(2, math.ceil(PROBED * len(index.centroids))))

    def place(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            lists, codes, error = encode(index, _matrix(part.column(1)))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(lists.astype(np.int32)), pa.array([c.tobytes() for c in codes], pa.binary()), pa.array(error), part.column(1)], ["vec_id", "list", "code", "error", "embedding"])

    kind = dict(rows.dtypes)["embedding"]
    placed = stored(rows.select("vec_id", "embedding").mapInArrow(place, f"vec_id long, list int, code binary, error double, embedding {kind}"), "ann-index")
    counts = placed.groupBy("list").agg(F.count("*"), F.count_distinct("vec_id")).collect()  # MOST_LISTS rows at most
    pack = packed({number: n for number, n, _ in counts})
    ids_in = np.zeros(len(index.centroids), np.int64)
    for number, _, ids in counts:
        ids_in[number] = ids
    group_of = np.zeros(len(index.centroids), np.int32)
    for number, group, _ in pack:
        group_of[number] = group
    held = np.isin(np.arange(len(group_of)), [number for number, _, _ in pack])

    def aim(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            best = np.argsort(-(_matrix(part.column(1)) @ index.centroids.T), axis=1, kind="stable")
            before = np.cumsum(ids_in[best], axis=1) - ids_in[best]
            looked = (np.arange(best.shape[1]) < probes) | (before < k + 1)  # one of the ids may be the query's own
            probed = np.zeros((len(best), len(group_of)), bool)
            np.put_along_axis(probed, best, looked, axis=1)
            groups = [np.unique(group_of[p & held]) for p in probed]
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(groups, pa.list_(pa.int32())), pa.array([np.packbits(p).tobytes() for p in probed], pa.binary()), part.column(1)], ["query_id", "groups", "probed", "query"])

    blocks = rows.where("asks").count() // BLOCK + 1
    plan = F.broadcast(rows.sparkSession.createDataFrame(pack, "list int, group int, pieces int"))
    sizes = plan.groupBy("group").agg(F.max("pieces").alias("pieces"))
    asked = rows.where("asks").select("vec_id", "embedding").mapInArrow(aim, f"query_id long, groups array<int>, probed binary, query {kind}")
    asked = asked.select("query_id", F.explode("groups").alias("group"), "probed", "query")
    own = lambda c, n: F.pmod(F.xxhash64(c), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    right = placed.join(plan, "list").select("group", own("vec_id", F.col("pieces")).alias("piece"), each(F.lit(blocks)).alias("block"), "vec_id", "list", "code", "error", "embedding")
    left = asked.join(F.broadcast(sizes), "group").select("group", each(F.col("pieces")).alias("piece"), own("query_id", F.lit(blocks)).alias("block"), "query_id", "probed", "query")

    def meet(key: tuple, some: pa.Table, others: pa.Table) -> pa.Table:
        ids, found = others.column("vec_id").to_numpy(), ([], [], [])
        if len(ids) and some.num_rows:
            order = np.argsort(ids, kind="stable")
            ids, x = ids[order], _matrix(others.column("embedding"))[order]
            codes = np.frombuffer(b"".join(others.column("code").to_pylist()), np.uint8).reshape(len(ids), -1)[order]
            at, lists = codes + np.arange(codes.shape[1]) * CODES, others.column("list").to_numpy()[order]
            coarse, slack = index.centroids, others.column("error").to_numpy()[order] * (MARGIN / math.sqrt(x.shape[1]))
            for query, q, bits in zip(some.column("query_id").to_numpy(), _matrix(some.column("query")), some.column("probed").to_pylist(), strict=True):
                probed = np.unpackbits(np.frombuffer(bits, np.uint8), count=len(coarse)).view(bool)
                mine = np.flatnonzero(probed[lists] & (ids != query))
                near = (coarse @ q)[lists[mine]] + tables(index, q).ravel()[at[mine]].sum(axis=1)
                best = np.argsort(-near, kind="stable")
                may = near + slack[mine] * np.sqrt(q @ q) >= near[best[min(k, len(best)) - 1]] if len(best) else near > 0
                may[best[:RERANK]] = True
                top = mine[may]
                score = (x[top] * q).sum(axis=1)
                best = np.lexsort((ids[top], -score))[:k]
                found[0].append(np.full(len(best), query))
                found[1].append(ids[top][best])
                found[2].append(score[best])
        flat = [np.concatenate(f) if f else [] for f in found]
        return pa.table({"query_id": pa.array(flat[0], pa.int64()), "vec_id": pa.array(flat[1], pa.int64()), "score": pa.array(flat[2], pa.float64())})

    keys = ["group", "piece", "block"]
    hits = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(meet, "query_id long, vec_id long, score double")
    hits = hits.repartition("query_id").groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return hits.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
