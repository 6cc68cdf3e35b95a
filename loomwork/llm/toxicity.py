"""Toxicity: a conditional random field tags toxic words; its marginals make document scores and offending spans.

Labels are of documents, so the words to learn from are found first. A toxic document has a toxic token, a clean one
has none: hashed words and word beginnings that stand in many more toxic documents than chance allows are toxic in
those documents, and rounds go on with the toxic documents that no such token explains, so that rare stems are not lost
beside common ones. Words that clean documents share are clean, whatever they begin with. The field learns from windows
of tokens with hashed features (the word and its first 4 and 5 bytes), so it also knows new endings of known stems.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from loomwork.llm import crf
from loomwork.llm.labelled import fitted
from loomwork.llm.textbytes import WORD_BYTES, Hashes, lowered, mix, spans, text_slices

BITS = 18
PREFIXES = (4, 5)
#: A bucket is toxic if its documents are toxic TIMES as often (by odds) as all are, and chance makes fewer than
#: exp(-SURE) such buckets of all.
SURE, TIMES = 1.0, 20.0
WINDOW, ROUNDS, RATE, L2 = 64, 40, 0.5, 1e-6
#: A token is an offender from this marginal on.
OFFENDS = 0.5
#: The score of a token that nothing is known about, before training.
BIAS = -4.0
#: Rounds of the search for toxic tokens, and clean documents that make a word clean if no more toxic ones hold it.
SEARCHES, CLEAN_DOCS = 6, 2
#: Tokens whose part of the gradient is added at once.
GRADIENT_ROWS = 1 << 16
#: How often a bucket must stand in a document to count; each is a count of its own.
OFTEN = (1, 2)


#: Logits of a document's largest marginals are cut at this; how strongly their weights are held at zero, and steps.
CUT, HOLD, NEWTON = 8.0, 1e-2, 25


@dataclass(frozen=True)
class Tagger:
    weights: np.ndarray  # by bucket; the last is the bias
    steps: np.ndarray
    #: Weights of the logits of a document's largest and second largest marginal, and a bias.
    document: tuple[float, float, float] = (1.0, 0.0, 0.0)


def features(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets of each token, starts, ends, text) of one slice."""
    data = lowered(data)
    starts, ends, text = spans(WORD_BYTES[data], offsets)
    hashes = Hashes(data)
    found = np.empty((len(starts), 1 + len(PREFIXES)), np.int32)
    for i, k in enumerate((0, *PREFIXES)):
        upto = np.minimum(ends, starts + k) if k else ends
        found[:, i] = mix(hashes.of(starts, upto) + np.uint64(i + 1)) >> np.uint64(64 - BITS)
    return found, starts, ends, text


def toxic_buckets(found: np.ndarray, text: np.ndarray, toxic: np.ndarray, counted: np.ndarray) -> np.ndarray:
    """Which buckets of the counted tokens stand in toxic documents, once or several times, far more often than chance
    allows: a beginning that clean documents have once may stand in toxic ones again and again.
    """
    base, size = toxic.mean() if len(toxic) else 0.0, 1 << BITS
    out = np.zeros((found.shape[1], size), bool)
    for i in range(found.shape[1]):
        each, held = np.unique(text[counted].astype(np.int64) << BITS | found[counted, i], return_counts=True)
        for often in OFTEN:
            some = each[held >= often]
            bucket, doc = some & (size - 1), some >> BITS
            docs, bad = np.bincount(bucket, minlength=size), np.bincount(bucket, weights=toxic[doc], minlength=size)
            rate = np.clip(bad / np.maximum(docs, 1), 1e-12, 1 - 1e-12)
            bound = docs * (rate * np.log(rate / base) + (1 - rate) * np.log((1 - rate) / (1 - base)))
            out[i] |= (bound >= SURE + np.log(max(1, (docs > 0).sum()))) & (bad * (1 - base) > TIMES * (docs - bad) * base)
    return out


def toxic_tokens(found: np.ndarray, text: np.ndarray, toxic: np.ndarray) -> np.ndarray:
    """Which tokens are toxic, in documents labelled so: each round looks at toxic documents that have none yet."""
    size = 1 << BITS
    each = np.unique(text.astype(np.int64) << BITS | found[:, 0])
    held = [np.bincount(each & (size - 1), weights=x[each >> BITS], minlength=size) for x in (toxic, 1 - toxic)]
    clean_word = ((held[1] >= CLEAN_DOCS) & (held[0] <= held[1]))[found[:, 0]]
    y = np.zeros(len(found), bool)
    open_docs = toxic > 0
    for _ in range(SEARCHES):
        if not open_docs.any():
            break
        some = (open_docs | (toxic == 0))[text]
        share = np.flatnonzero(open_docs | (toxic == 0))
        place = np.zeros(len(toxic), np.int64)
        place[share] = np.arange(len(share))
        known = toxic_buckets(found[some], place[text[some]], toxic[share], ~clean_word[some])
        new = np.zeros(len(found), bool)
        for i in range(found.shape[1]):
            new |= known[i][found[:, i]]
        new &= ~clean_word & (toxic[text] > 0) & ~y
        if not new.any():
            break
        y |= new
        open_docs &= np.bincount(text[y], minlength=len(toxic)) == 0
    return y


def train(rows: pa.Table) -> Tagger:
    """Learns from text and label; without both labels, every token keeps the score BIAS.

    How marginals make a document's score is learned from the same rows: one likely token weighs as much as it is worth
    beside a second one.
    """
    tagger = train_field(rows)
    labels = rows.column("label").to_numpy().astype(float)
    if not 0 < labels.sum() < len(labels):
        return tagger
    parts = []
    for first, end, data, offsets in text_slices(rows.column("text")):
        p, _, _, text = tag(tagger, data, offsets)
        parts.append(largest(p, text, end - first))
    x, y = np.concatenate(parts), labels
    x = np.column_stack((x, np.ones(len(x))))
    w = np.zeros(3)
    for _ in range(NEWTON):
        q = 1 / (1 + np.exp(-(x @ w)))
        hold = HOLD * np.array([1.0, 1.0, 0.0])
        w = w + np.linalg.solve((x * (q * (1 - q))[:, None]).T @ x + np.diag(hold + 1e-9), x.T @ (y - q) - hold * w)
    return replace(tagger, document=(max(0.0, float(w[0])), max(0.0, float(w[1])), float(w[2])))  # more of a marginal is never less


def largest(p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Logits of the largest and second largest marginal of each of n texts, cut at CUT; the least where there is none."""
    out = np.full((n, 2), -CUT)
    logit = np.clip(np.log(np.maximum(p, 1e-12)) - np.log(np.maximum(1 - p, 1e-12)), -CUT, CUT)
    order = np.lexsort((-logit, text))
    of = text[order]
    place = np.arange(len(of)) - np.searchsorted(of, of)
    for k in (0, 1):
        at = order[place == k]
        out[text[at], k] = logit[at]
    return out


def train_field(rows: pa.Table) -> Tagger:
    """The field alone, of text and label."""
    nothing = Tagger(np.append(np.zeros(1 << BITS, np.float32), np.float32(BIAS)), np.zeros((2, 2)))
    labels = rows.column("label").to_numpy()
    if not 0 < labels.sum() < len(labels):
        return nothing
    parts = []
    for first, _, data, offsets in text_slices(rows.column("text")):
        found, _, _, text = features(data, offsets)
        parts.append((found, (text + first).astype(np.int32)))
    found, text = (np.concatenate(x) for x in zip(*parts, strict=True))
    del parts
    toxic = labels.astype(float)
    y = toxic_tokens(found, text, toxic).astype(np.int64)
    # windows of one text; those with a toxic token, and as many others
    begins = np.flatnonzero(np.diff(text, prepend=-1))
    cut = np.zeros(len(text), np.int64)
    cut[begins] = 1
    place = np.arange(len(text)) - np.repeat(begins, np.diff(np.append(begins, len(text))))
    cut[place % WINDOW == 0] = 1
    window = np.cumsum(cut) - 1
    hot = np.bincount(window, weights=y) > 0
    if not hot.any():
        return nothing
    cold = np.flatnonzero(~hot)
    chosen = hot.copy()
    chosen[cold[:: max(1, len(cold) // (2 * int(hot.sum())))]] = True
    keep = chosen[window]
    found, y, window = found[keep], y[keep], window[keep]
    starts = np.flatnonzero(np.diff(window, prepend=-1))
    lengths = np.diff(np.append(starts, len(window)))
    # memory is scarce: places of weights are small integers, and nothing three times as long as the tokens is made
    used = np.flatnonzero(np.bincount(found.ravel(), minlength=1 << BITS))
    place = np.zeros(1 << BITS, np.int32)
    place[used] = np.arange(len(used))
    index = place[found]
    del found, text, window, keep, cut, place

    def score(w: np.ndarray) -> np.ndarray:
        out = w[index[:, 0]]
        for i in range(1, index.shape[1]):
            out += w[index[:, i]]
        return out + w[-1] + BIAS

    def gradient(r: np.ndarray) -> np.ndarray:
        out = np.zeros(len(used) + 1)
        for at in range(0, len(r), GRADIENT_ROWS):
            np.add.at(out, index[at : at + GRADIENT_ROWS], r[at : at + GRADIENT_ROWS, None])
        out[-1] = r.sum()
        return out

    w, steps = crf.fit(score, gradient, len(used) + 1, y, starts, lengths, rounds=ROUNDS, rate=RATE, l2=L2)
    weights = np.zeros((1 << BITS) + 1, np.float32)
    weights[used], weights[-1] = w[:-1], w[-1] + BIAS
    return Tagger(weights, steps)


def tag(tagger: Tagger, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(marginal, start, end, text) of each token of a slice."""
    found, starts, ends, text = features(data, offsets)
    scores = tagger.weights[found].sum(axis=1, dtype=np.float64) + tagger.weights[-1]
    begins = np.flatnonzero(np.diff(text, prepend=-1))
    return crf.marginals(scores, begins, np.diff(np.append(begins, len(text))), tagger.steps), starts, ends, text


def document_scores(tagger: Tagger, p: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
    """Scores of n texts by their two largest marginals; 0 without tokens."""
    first, second, bias = tagger.document
    x = largest(p, text, n)
    score = 1 / (1 + np.exp(-(x @ np.array([first, second]) + bias)))
    return np.where(np.bincount(text, minlength=n) > 0, score, 0.0)


def score_toxicity(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, score and offenders array<struct<start, end, p>> (bytes of UTF-8) of each row of docs.

    docs has doc_id and text, labels has doc_id and toxic. A null, empty or wordless text scores 0. Repeated rows and
    null doc_ids are scored like others, other columns are left out, an empty table gives no rows. Without labels of
    both kinds all tokens score alike, low.
    """
    tagger = fitted(docs, labels, "toxic", train)
    span = pa.struct([("start", pa.int64()), ("end", pa.int64()), ("p", pa.float64())])

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, end, data, offsets in text_slices(part.column(1)):
                p, starts, ends, text = tag(tagger, data, offsets)
                out = [part.column(0).slice(first, end - first), pa.array(document_scores(tagger, p, text, end - first))]
                bad = np.flatnonzero(p >= OFFENDS)
                each = pa.StructArray.from_arrays([pa.array(starts[bad] - offsets[text[bad]]), pa.array(ends[bad] - offsets[text[bad]]), pa.array(p[bad])], fields=list(span))
                out.append(pa.ListArray.from_arrays(pa.array(np.searchsorted(text[bad], np.arange(end - first + 1)).astype(np.int32)), each))
                yield pa.RecordBatch.from_arrays(out, ["doc_id", "score", "offenders"])

    schema = "doc_id long, score double, offenders array<struct<start:long,end:long,p:double>>"
    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(batches, schema)


def without_toxic(docs: DataFrame, labels: DataFrame, toxic_from: float) -> DataFrame:
    """Rows of docs, with all their columns, whose score is below toxic_from; scores as in score_toxicity."""
    tagger = fitted(docs, labels, "toxic", train)
    text_at = docs.columns.index("text")

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, end, data, offsets in text_slices(part.column(text_at)):
                p, _, _, text = tag(tagger, data, offsets)
                yield part.slice(first, end - first).filter(pa.array(document_scores(tagger, p, text, end - first) < toxic_from))

    return docs.mapInArrow(batches, docs.schema)
