"""The bounded sample of labelled rows that the classifiers learn from."""

from __future__ import annotations

import pickle
from collections import Counter
from collections.abc import Callable, Iterator
from typing import TypeVar

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import held_out
from loomwork.llm.textbytes import NOT_SPACE, Hashes, mix, spans, text_slices

Model = TypeVar("Model")

#: Bounds of what a model is fitted on: pieces of labelled texts, and characters of a piece. A longer text is cut into
#: pieces, all of which may be drawn.
FIT_ROWS, PIECE_CHARS = 3000, 4_000


def fitted(docs: DataFrame, labels: DataFrame, label: str, train: Callable[[pa.Table], Model], rows: int = FIT_ROWS) -> Model:
    """What train makes of training_rows, in one task of an executor: the driver holds the model, but no row of them."""
    drawn = _drawn(docs, labels, label, rows).repartition(1).sortWithinPartitions("doc_id", "place").select("text", "label")
    none = pa.schema([("text", pa.string()), ("label", pa.int32())]).empty_table()

    def fit(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        some = [pa.table({"text": part.column(0), "label": part.column(1)}) for part in parts]
        model = train(without_copies(pa.concat_tables(some or [none])))
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], ["model"])

    found = drawn.mapInArrow(fit, "model binary").first()  # no task runs where Spark finds that there are no rows
    return pickle.loads(found.model) if found else train(none)


def training_rows(docs: DataFrame, labels: DataFrame, label: str, rows: int = FIT_ROWS) -> pa.Table:
    """text and label (0 or 1) of up to `rows` pieces of labelled documents that are not held out.

    Half of them at most have each label. Within a label, the pieces whose doc_id and place hash lowest are taken, of
    the rows // 2 documents whose doc_id hashes lowest, without near copies of others; a doc_id counts once, with its
    larger label and its least text. Null labels, ids and texts are not learned from, an empty text is one empty piece.
    """
    return fitted(docs, labels, label, lambda table: table, rows)


def _drawn(docs: DataFrame, labels: DataFrame, label: str, rows: int) -> DataFrame:
    """doc_id, place, text and label of training_rows, with near copies."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col(label).isin(0, 1) & ~held_out(F.col("doc_id")))
    known = known.groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    pick = lambda table, y, order: table.where(F.col("label") == y).orderBy(*order).limit(rows // 2)
    by_id = (F.xxhash64("doc_id"), "doc_id")
    some = pick(known, 1, by_id).unionByName(pick(known, 0, by_id))
    texts = docs.select(F.col("doc_id").alias("id"), "text").where(F.col("text").isNotNull())
    joined = texts.join(F.broadcast(some), F.col("id") == F.col("doc_id")).groupBy("doc_id", "label").agg(F.min("text").alias("text"))
    cut = F.when(F.length("text") <= PIECE_CHARS, F.array("text")).otherwise(F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE_CHARS}}}"), F.lit(0)))
    pieces = joined.select("doc_id", "label", F.posexplode(cut).alias("place", "text"))
    by_piece = (F.xxhash64("doc_id", "place"), "doc_id", "place")
    return pick(pieces, 1, by_piece).unionByName(pick(pieces, 0, by_piece))


def without_copies(rows: pa.Table, sketches: int = 8) -> pa.Table:
    """Rows without near copies of earlier ones that stay: of runs of three words, most minimum hashes are the same.

    Copies of one text would pass for independent evidence on its words; texts that share a passage stay.
    """
    holders: dict[int, list[int]] = {}
    keep = np.zeros(rows.num_rows, bool)
    for first, _, data, offsets in text_slices(rows.column("text")):
        starts, ends, text = spans(NOT_SPACE[data], offsets)
        words = Hashes(data).of(starts, ends)
        runs = words[:-2] + np.uint64(3) * words[1:-1] + np.uint64(7) * words[2:]
        at = np.flatnonzero(text[:-2] == text[2:])
        begins = np.searchsorted(at, at[np.flatnonzero(np.diff(text[at], prepend=-1))])
        lows = [np.minimum.reduceat(mix(runs[at] + np.uint64(i)), begins) ^ np.uint64(i) for i in range(1, sketches + 1)] if len(at) else []
        own = dict(zip(text[at][begins].tolist(), zip(*(x.tolist() for x in lows), strict=True), strict=True)) if len(at) else {}
        for i in range(len(offsets) - 1):
            marks = own.get(i, ())
            same = Counter(row for m in marks for row in holders.get(m, ()))
            keep[first + i] = not same or max(same.values()) * 2 <= sketches
            if keep[first + i]:
                for m in marks:
                    holders.setdefault(m, []).append(first + i)
    return rows.filter(pa.array(keep))
