"""Whitening of embeddings by a tiled covariance.

The distinct lattice vectors are cut into row blocks of bounded size, and each row block into column blocks of TILE
dimensions. A pair of column blocks is a tile; column blocks are shuffled by (row block, tile), multiplied there once
centred, and the products are summed per tile: within each partition first, then over partitions. Only the covariance
of all dimensions (dim x dim doubles) reaches the driver, which takes its eigenvectors.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import stored

#: Components returned, rows of a row block at most, dimensions of a column block.
COMPONENTS, ROWS, TILE = 4, 4096, 32
#: Lattice steps to a unit, and the largest lattice coordinate: beyond it entries saturate.
STEPS, FURTHEST = 256, 1 << 50
#: Eigenvalues below this part of the trace are zero but for rounding; their components are left out.
LEAST_SHARE = 1e-12


@dataclass(frozen=True)
class Whitening:
    """n fitted vectors, their sums by dimension, and the largest components: vectors (dim x k), eigenvalues, trace."""

    n: int
    sums: list[int]
    vectors: np.ndarray
    values: np.ndarray
    trace: float

    @property
    def matrix(self) -> np.ndarray:
        """Centred vectors times this are white."""
        return self.vectors / np.sqrt(self.values)


def lattice(vector: Column) -> Column:
    """floor(256 * c) of each entry."""
    return F.transform(vector, lambda c: F.floor(F.least(F.greatest(c.cast("double") * STEPS, F.lit(-float(FURTHEST))), F.lit(float(FURTHEST)))))


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def deviations(x: np.ndarray, n: int, sums: list[int]) -> list[int | None]:
    """Sum over dimensions of (n * x - sum)^2 of each row, exact; None where a long cannot hold it."""
    largest = n * max(1, int(np.abs(x).max(initial=0))) + max(map(abs, sums), default=0)
    if x.shape[1] * largest**2 < 1 << 63:
        y = n * x - np.array(sums, np.int64)
        return (y * y).sum(axis=1).tolist()
    exact = (sum((n * int(v) - s) ** 2 for v, s in zip(row, sums, strict=True)) for row in x)
    return [d if d < 1 << 63 else None for d in exact]


def _centred(x: np.ndarray, n: int, sums: list[int]) -> np.ndarray:
    return x.astype(np.float64) - np.array([s / n for s in sums])


def _sums(fit: DataFrame, dim: int) -> tuple[int, list[int]]:
    """Rows and exact sums by dimension; a row for each dimension and batch is shuffled."""

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                x = _matrix(part.column(0).slice(at, ROWS))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(dim + 1)), pa.array(np.append(x.sum(axis=0), len(x)))], ["place", "part"])

    total = F.sum(F.col("part").cast("decimal(20,0)")).alias("total")
    found = {r.place: int(r.total) for r in fit.mapInArrow(partial, "place long, part long").groupBy("place").agg(total).collect()}  # dim + 1 rows
    return found.get(dim, 0), [found.get(i, 0) for i in range(dim)]


def covariance(fit: DataFrame, dim: int, n: int, sums: list[int]) -> np.ndarray:
    """Covariance of the rows x (array<long> of dim) of fit, divisor n, of the n rows centred by their sums."""
    cuts = [slice(at, min(dim, at + TILE)) for at in range(0, dim, TILE)]

    def split(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number, kinds = 0, (np.int8, np.int16, np.int32, np.int64)
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                x = _matrix(part.column(0).slice(at, ROWS))
                kind = next(k for k in kinds if np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max)
                blocks = [(i, j, side, x[:, cuts[side]].astype(kind).tobytes()) for i in range(len(cuts)) for j in range(i, len(cuts)) for side in {i, j}]
                at_i, at_j, sides, data = zip(*blocks, strict=True)
                block = f"{TaskContext.get().partitionId()}-{number}"
                number += 1
                columns = [[block] * len(blocks), at_i, at_j, sides, [kind().itemsize] * len(blocks), data]
                kinds_of = [pa.string(), pa.int32(), pa.int32(), pa.int32(), pa.int32(), pa.binary()]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds_of, strict=True)], ["block", "i", "j", "side", "width", "data"])

    def multiply(key: tuple, rows: pa.Table) -> pa.Table:
        i, j = key[1].as_py(), key[2].as_py()
        sides = {}
        for row in rows.to_pylist():
            cut = cuts[row["side"]]
            x = np.frombuffer(row["data"], f"i{row['width']}").reshape(-1, cut.stop - cut.start)
            sides[row["side"]] = _centred(x, n, sums[cut])
        return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "product": pa.array([(sides[i].T @ sides[j]).tobytes()], pa.binary())})

    def add(products: Iterator[tuple[int, int, bytes]]) -> dict[tuple[int, int], np.ndarray]:
        out: dict[tuple[int, int], np.ndarray] = {}
        for i, j, data in products:
            out[i, j] = out.get((i, j), 0.0) + np.frombuffer(data)
        return out

    def within(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (row for part in parts for row in zip(*(c.to_pylist() for c in part.columns), strict=True))
        for (i, j), total in sorted(add(rows).items()):
            yield pa.RecordBatch.from_arrays([pa.array([i], pa.int32()), pa.array([j], pa.int32()), pa.array([total.tobytes()], pa.binary())], ["i", "j", "product"])

    def over(key: tuple, rows: pa.Table) -> pa.Table:
        [((i, j), total)] = add(zip(*(c.to_pylist() for c in rows.columns), strict=True)).items()
        return pa.table({"i": pa.array([i], pa.int32()), "j": pa.array([j], pa.int32()), "product": pa.array([total.tobytes()], pa.binary())})

    tile = "i int, j int, product binary"
    blocks = fit.mapInArrow(split, "block string, i int, j int, side int, width int, data binary")
    products = blocks.groupBy("block", "i", "j").applyInArrow(multiply, tile).mapInArrow(within, tile)
    out = np.zeros((dim, dim))
    for i, j, total in products.groupBy("i", "j").applyInArrow(over, tile).collect():  # dim x dim doubles in all
        tile_of = np.frombuffer(total).reshape(cuts[i].stop - cuts[i].start, -1) / n
        out[cuts[i], cuts[j]] = tile_of
        out[cuts[j], cuts[i]] = tile_of.T
    return out


def components(cov: np.ndarray, n: int, sums: list[int], most: int = COMPONENTS) -> Whitening:
    """The `most` largest components whose eigenvalue is not zero; the entry of largest size of each is positive."""
    values, vectors = np.linalg.eigh(cov)
    trace = float(np.trace(cov))
    order = [k for k in range(len(values) - 1, -1, -1) if values[k] > LEAST_SHARE * trace][:most]
    vectors = vectors[:, order]
    signs = np.sign(vectors[np.abs(vectors).argmax(axis=0), np.arange(len(order))]) if order else np.ones(0)
    return Whitening(n, sums, vectors * signs, values[order], trace)


def identity_error(fit: DataFrame, whitening: Whitening) -> float:
    """Largest absolute entry of the covariance of the whitened rows of fit, minus the identity; measured on the rows."""
    k = len(whitening.values)

    def partial(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                z = _centred(_matrix(part.column(0).slice(at, ROWS)), whitening.n, whitening.sums) @ whitening.matrix
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(k * k + k)), pa.array(np.append((z.T @ z).ravel(), z.sum(axis=0)))], ["place", "part"])

    found = dict(fit.mapInArrow(partial, "place long, part double").groupBy("place").agg(F.sum("part")).collect())  # k * k + k rows
    means = np.array([found[k * k + i] for i in range(k)]) / whitening.n
    cov = np.array([found[i] for i in range(k * k)]).reshape(k, k) / whitening.n - np.outer(means, means)
    return float(np.abs(cov - np.eye(k)).max())


def whiten(vectors: DataFrame, most: int = COMPONENTS) -> DataFrame:
    """vec_id, component, n, deviation, whitened, explained, identity_error of each row of vectors(vec_id, embedding).

    Rows whose vector is null, of another length than the most frequent one (of equally frequent ones the shortest),
    or holds a null or non-finite entry give no rows. Equal lattice vectors count once in the fit; null and repeated
    vec_ids keep a row for each of theirs. Components without variance are left out: one distinct vector gives no
    rows, nor does an empty table. Entries beyond 2^42 saturate, a deviation that a long can't hold is null. Other
    columns are left out.
    """
    fine = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != float("inf"))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where((F.size("embedding") > 0) & F.forall("embedding", fine))
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    common = rows.groupBy(F.size("embedding").alias("dim")).count().orderBy(F.desc("count"), "dim").first()
    if common is None:
        return rows.sparkSession.createDataFrame([], schema)
    dim = common.dim
    rows = rows.where(F.size("embedding") == dim).select("vec_id", lattice(F.col("embedding")).alias("x"))
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    n, sums = _sums(fit, dim)
    whitening = components(covariance(fit, dim, n, sums), n, sums, most)
    k = len(whitening.values)
    if not k:
        return rows.sparkSession.createDataFrame([], schema)
    error, explained = identity_error(fit, whitening), whitening.values / whitening.trace

    def project(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for at in range(0, part.num_rows, ROWS):
                some = part.slice(at, ROWS)
                x = _matrix(some.column(1))
                z = _centred(x, n, sums) @ whitening.matrix
                each = np.repeat(np.arange(len(x)), k)
                columns = [
                    some.column(0).take(pa.array(each)),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(x))),
                    pa.array(np.full(len(each), n)),
                    pa.array(deviations(x, n, sums), pa.int64()).take(pa.array(each)),
                    pa.array(z.ravel()),
                    pa.array(np.tile(explained, len(x))),
                    pa.array(np.full(len(each), error)),
                ]
                yield pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in schema.split(", ")])

    return rows.mapInArrow(project, schema)
