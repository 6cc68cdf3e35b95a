"""Quality classifier: a conditional random field labels lines good or bad by their own and their neighbours' features.

Labels are of documents, so lines to learn from are labelled first: a good document's lines are good, a bad one's are
bad but for those that a model of single lines finds clearly good. As documents are mostly of one kind, lines of bad
documents are spliced into good ones too, so the field learns to change its mind within a document. The
forward-backward marginals of a document's lines, weighted by length, make its score.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm import crf
from loomwork.llm.labelled import fitted
from loomwork.llm.textbytes import NOT_SPACE, Hashes, spans, text_slices

ROUNDS, RATE, L2 = 150, 0.1, 1e-4
#: A line is called bad below this marginal; a bad document's line counts as good in training from CLEARLY_GOOD on.
GOOD, CLEARLY_GOOD = 0.5, 0.9
#: Score of a document without labels to learn from.
PRIOR = 0.5

_B = np.arange(256)
UPPER = (_B >= 65) & (_B <= 90)
LOWERCASE = (_B >= 97) & (_B <= 122)
DIGIT = (_B >= 48) & (_B <= 57)
STOP = np.isin(_B, [ord(c) for c in ".,;:?"])
MARK = (_B > 32) & (_B < 127) & ~UPPER & ~LOWERCASE & ~DIGIT & ~STOP
#: Of each line: shares of these bytes; then shares of repeated words; word and line lengths; the end.
CLASSES = (UPPER, LOWERCASE, DIGIT, STOP, MARK, _B >= 128)
FEATURES = len(CLASSES) + 6


@dataclass(frozen=True)
class LineModel:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray  # own, before, after; then the bias
    steps: np.ndarray


def lines_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, text) of all lines; a text without any, or with blank ones, has empty lines too."""
    breaks = np.flatnonzero(data == 10)
    starts = np.sort(np.concatenate((offsets[:-1], breaks + 1)), kind="stable")
    ends = np.sort(np.concatenate((offsets[1:], breaks)), kind="stable")
    text = np.repeat(np.arange(len(offsets) - 1), 1 + np.bincount(np.searchsorted(offsets, breaks, "right") - 1, minlength=len(offsets) - 1))
    return starts, ends, text


def line_features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(features, lengths, text) of all lines of a slice, in order."""
    starts, ends, text = lines_of(data, offsets)
    size = ends - starts
    out = np.zeros((len(starts), FEATURES))
    each = np.maximum(size, 1)
    for i, kind in enumerate(CLASSES):
        sums = np.concatenate(([0], np.cumsum(kind[data], dtype=np.int64)))
        out[:, i] = (sums[ends] - sums[starts]) / each
    first, last, _ = spans(NOT_SPACE[data], offsets)
    hashes = Hashes(data).of(first, last)
    line = np.searchsorted(starts, first, "right") - 1
    n = np.bincount(line, minlength=len(starts))
    words = np.maximum(n, 1)
    for i, ahead in enumerate((1, 2)):
        same = (hashes[:-ahead] == hashes[ahead:]) & (line[:-ahead] == line[ahead:])
        out[:, len(CLASSES) + i] = np.bincount(line[:-ahead][same], minlength=len(starts)) / words
    tail = data[last - 1]
    k = len(CLASSES) + 2
    out[:, k] = np.bincount(line, weights=MARK[tail], minlength=len(starts)) / words
    out[:, k + 1] = np.log1p(size / words)
    out[:, k + 2] = np.log1p(size)
    some = size > 0
    out[some, k + 3] = np.isin(data[ends[some] - 1], [ord(c) for c in ".!?"])
    return out, size, text


def with_neighbours(x: np.ndarray, text: np.ndarray) -> np.ndarray:
    """Own features, then those of the line before and after in the same text (0 at its ends)."""
    before, after = np.zeros_like(x), np.zeros_like(x)
    if len(x) > 1:
        same = (text[1:] == text[:-1])[:, None]
        before[1:], after[:-1] = x[:-1] * same, x[1:] * same
    return np.hstack((x, before, after))


def line_labels(x: np.ndarray, text: np.ndarray, labels: np.ndarray) -> np.ndarray:
    """1 for lines of good documents and lines of bad ones that look clearly good; a bad one's worst line stays 0."""
    own, alone = labels[text].astype(np.int64), np.arange(len(x))
    w, _ = crf.fit(lambda w: x @ w[:-1] + w[-1], lambda r: np.append(r @ x, r.sum()), x.shape[1] + 1, own, alone, np.ones_like(alone), rounds=ROUNDS, rate=RATE, l2=L2)
    p = 1 / (1 + np.exp(-np.clip(x @ w[:-1] + w[-1], -30, 30)))
    order = np.lexsort((p, text))
    worst = order[np.flatnonzero(np.diff(text[order], prepend=-1))]
    out = np.where(p >= CLEARLY_GOOD, 1, own)
    out[worst] = own[worst]
    return out


def spliced(text: np.ndarray, y: np.ndarray, labels: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sequence) of all documents' lines, then of good documents with lines of a bad one put in the middle."""
    begins = np.flatnonzero(np.diff(text, prepend=-1))
    ends, kind = np.append(begins, len(text))[1:], labels[text[begins]]
    rows, numbers, new = [np.arange(len(text))], [text], int(text[-1]) + 1 if len(text) else 0
    for g, b in zip(np.flatnonzero(kind == 1), np.flatnonzero(kind == 0), strict=False):
        middle = begins[g] + (ends[g] - begins[g] + 1) // 2
        bad = np.arange(begins[b], ends[b])
        bad = bad[y[bad] == 0]
        put = bad[: (len(bad) + 1) // 2]
        rows.append(np.concatenate((np.arange(begins[g], middle), put, np.arange(middle, ends[g]))))
        numbers.append(np.full(len(rows[-1]), new))
        new += 1
    return np.concatenate(rows), np.concatenate(numbers)


def train(rows: pa.Table) -> LineModel | None:
    """Learns from text and label; None without both labels."""
    labels = rows.column("label").to_numpy()
    if not 0 < labels.sum() < len(labels):
        return None
    parts = []
    for first, _, data, offsets in text_slices(rows.column("text")):
        x, _, text = line_features(data, offsets)
        parts.append((x, text + first))
    x, text = (np.concatenate(p) for p in zip(*parts, strict=True))
    mean, scale = x.mean(axis=0), x.std(axis=0) + 1e-6
    x = (x - mean) / scale
    y = line_labels(x, text, labels)
    at, sequence = spliced(text, y, labels)
    z, y = with_neighbours(x[at], sequence), y[at]
    starts = np.flatnonzero(np.diff(sequence, prepend=-1))
    lengths = np.diff(np.append(starts, len(sequence)))
    w, steps = crf.fit(lambda w: z @ w[:-1] + w[-1], lambda r: np.append(r @ z, r.sum()), z.shape[1] + 1, y, starts, lengths, rounds=ROUNDS, rate=RATE, l2=L2)
    return LineModel(mean, scale, w, steps)


def line_marginals(model: LineModel | None, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(probability of good, length, text) of all lines of a slice."""
    x, size, text = line_features(data, offsets)
    if model is None:
        return np.full(len(x), PRIOR), size, text
    z = with_neighbours((x - model.mean) / model.scale, text)
    starts = np.flatnonzero(np.diff(text, prepend=-1))
    return crf.marginals(z @ model.weights[:-1] + model.weights[-1], starts, np.diff(np.append(starts, len(text))), model.steps), size, text


def document_scores(p: np.ndarray, size: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Marginals of each text's lines, weighted by length; an empty line counts as one byte."""
    weight = np.maximum(size, 1).astype(float)
    return np.bincount(text, weights=p * weight, minlength=n) / np.bincount(text, weights=weight, minlength=n)


def score_quality(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and bad_lines array<int> (from 0) of each row of docs.

    docs has doc_id and text, labels has doc_id and quality. A null or empty text is one empty line, scored like
    others. Repeated rows and null doc_ids are scored, other columns are left out, an empty table gives no rows.
    Without labels of both kinds every score is PRIOR.
    """
    model = fitted(docs, labels, "quality", train)

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, end, data, offsets in text_slices(part.column(1)):
                p, size, text = line_marginals(model, data, offsets)
                n = end - first
                out = [part.column(0).slice(first, n), pa.array(document_scores(p, size, text, n))]
                bad = np.flatnonzero(p < GOOD)
                place = bad - np.searchsorted(text, text[bad])
                out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(text[bad], np.arange(n + 1)).astype(np.int32)), pa.array(place.astype(np.int32))))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "bad_lines"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(batches, "doc_id long, score double, bad_lines array<int>")


def with_quality(docs: DataFrame, labels: DataFrame, good_from: float) -> DataFrame:
    """Rows of docs, with all their columns, whose score is good_from or more; scores as in score_quality."""
    model = fitted(docs, labels, "quality", train)
    text_at = docs.columns.index("text")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, end, data, offsets in text_slices(part.column(text_at)):
                score = document_scores(*line_marginals(model, data, offsets), end - first)
                yield part.slice(first, end - first).filter(pa.array(score >= good_from))

    return docs.mapInArrow(batches, docs.schema)
