"""Byte-level BPE: encoding by merge ranks and decoding, for whole texts.

A pre-token's symbols are a linked list. A pair that merges waits in the bucket of its rank, as the position of its
left symbol; a bitmap over ranks in three levels of 64-bit words marks the buckets in use, so the next rank is three
find-first-set steps away. A position whose pair has changed since it was put there is stale and skipped. A pre-token
of n bytes takes O(n log n) steps at most, which is what very long ones need. Short ones take the same steps with two
levels of wider words and with buckets that are bit sets, which Python's integers make cheap while they are small.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator
from functools import lru_cache
from heapq import heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame

#: A worker keeps the encodings of so many pre-tokens, and of as many before those; what is used again stays.
CACHED = 300_000
#: Longer pre-tokens are not kept.
CACHED_CHARS = 64
#: Bytes up to which a pre-token is a short one.
SHORT = 128


class RankQueue:
    """Positions by rank, smallest rank first; within a rank, leftmost first."""

    def __init__(self, ranks: int):
        self.low = [0] * ((ranks >> 6) + 1)
        self.mid = [0] * ((ranks >> 12) + 1)
        self.top = 0
        self.buckets: dict[int, list[int]] = {}

    def push(self, rank: int, position: int) -> None:
        if bucket := self.buckets.get(rank):
            heappush(bucket, position)
            return
        self.buckets[rank] = [position]
        self.low[rank >> 6] |= 1 << (rank & 63)
        self.mid[rank >> 12] |= 1 << (rank >> 6 & 63)
        self.top |= 1 << (rank >> 12)

    def pop(self) -> tuple[int, int]:
        """(rank, position) of the first; the queue must hold one (top is not 0)."""
        t = (self.top & -self.top).bit_length() - 1
        m = self.mid[t]
        i = t << 6 | (m & -m).bit_length() - 1
        word = self.low[i]
        rank = i << 6 | (word & -word).bit_length() - 1
        bucket = self.buckets[rank]
        position = heappop(bucket)
        if not bucket:
            del self.buckets[rank]
            self.low[i] = word = word & word - 1
            if not word:
                self.mid[t] = m = m & m - 1
                if not m:
                    self.top &= self.top - 1
        return rank, position


class Encoder:
    """Encodes and decodes by a rank file (a base64 token and its rank on each line) and a pre-token pattern."""

    def __init__(self, rank_file: str, pattern: str):
        with open(rank_file, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.tokens = {rank: token for token, rank in self.ranks.items()}
        self.byte_ids = [self.ranks[bytes([b])] for b in range(256)]
        self.split = regex.compile(pattern).findall
        nothing: dict[int, int] = {}
        #: By left id: the rank of each right id that merges with it.
        self.pairs = [nothing] * (max(self.ranks.values()) + 1)
        for token, rank in self.ranks.items():
            for cut in range(1, len(token)):
                left, right = self.ranks.get(token[:cut]), self.ranks.get(token[cut:])
                if left is not None and right is not None:
                    if self.pairs[left] is nothing:
                        self.pairs[left] = {}
                    self.pairs[left][right] = rank
        self.queue = RankQueue(max(self.ranks.values()) + 1)
        self.low = [0] * (len(self.pairs) // 256 + 1)
        #: Of pre-tokens: the ids as decimals joined by blanks; older is the generation before kept.
        self.kept: dict[str, str] = {}
        self.older: dict[str, str] = {}
        #: The bytes of each id, by its decimal.
        self.named = {str(rank): token for token, rank in self.ranks.items()}

    def merge(self, data: bytes) -> list[int]:
        """Ids of one pre-token."""
        whole = self.ranks.get(data)
        if whole is not None:
            return [whole]
        return self._merge_short(data) if len(data) <= SHORT else self._merge_long(data)

    def _merge_short(self, data: bytes) -> list[int]:
        """merge() with the queue's steps in line: top has a bit for each 256 ranks, low[h] a bit for each of them."""
        pairs, low, buckets, top = self.pairs, self.low, {}, 0
        ids = [*map(self.byte_ids.__getitem__, data)]
        n = len(ids)
        before, after = [*range(-1, n - 1)], [*range(1, n + 1)]
        new = [(r, i) for i, r in enumerate([pairs[x].get(y) for x, y in zip(ids, ids[1:])]) if r is not None]  # noqa: B905
        while True:
            for r, i in new:
                if bucket := buckets.get(r):
                    buckets[r] = bucket | 1 << i
                else:
                    buckets[r] = 1 << i
                    low[r >> 8] |= 1 << (r & 255)
                    top |= 1 << (r >> 8)
            if not top:
                return [x for x in ids if x >= 0]
            h = (top & -top).bit_length() - 1
            word = low[h]
            rank = h << 8 | (word & -word).bit_length() - 1
            bucket = buckets[rank]
            i = (bucket & -bucket).bit_length() - 1
            buckets[rank] = bucket = bucket & bucket - 1
            if not bucket:
                low[h] = word = word & word - 1
                if not word:
                    top &= top - 1
            new = []
            if (x := ids[i]) < 0 or (j := after[i]) >= n or pairs[x].get(ids[j]) != rank:
                continue  # stale
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pairs[rank].get(ids[k])) is not None:
                    new.append((r, i))
            if (h := before[i]) >= 0 and (r := pairs[ids[h]].get(rank)) is not None:
                new.append((r, h))

    def _merge_long(self, data: bytes) -> list[int]:
        pairs, queue = self.pairs, self.queue
        ids = [self.byte_ids[b] for b in data]
        n = len(ids)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        for i in range(n - 1):
            rank = pairs[ids[i]].get(ids[i + 1])
            if rank is not None:
                queue.push(rank, i)
        while queue.top:
            rank, i = queue.pop()
            if ids[i] < 0 or (j := after[i]) >= n or pairs[ids[i]].get(ids[j]) != rank:
                continue  # stale
            ids[i], ids[j] = rank, -1
            after[i] = k = after[j]
            if k < n:
                before[k] = i
                if (r := pairs[rank].get(ids[k])) is not None:
                    queue.push(r, i)
            if (h := before[i]) >= 0 and (r := pairs[ids[h]].get(rank)) is not None:
                queue.push(r, h)
        return [x for x in ids if x >= 0]

    def _new(self, piece: str) -> str:
        if not (found := self.older.get(piece)):
            found = " ".join(map(str, self.merge(piece.encode())))
        if len(piece) <= CACHED_CHARS:
            if len(self.kept) >= CACHED:
                self.older, self.kept = self.kept, {}
            self.kept[piece] = found
        return found

    def names(self, text: str) -> str:
        """The ids of text as decimals joined by blanks."""
        get, new = self.kept.get, self._new
        return " ".join([get(piece) or new(piece) for piece in self.split(text)])

    def decode_names(self, names: str) -> bytes:
        """What ids decode to, given as decimals joined by blanks."""
        return b"".join(map(self.named.__getitem__, names.split()))

    def encode(self, text: str) -> list[int]:
        return [*map(int, self.names(text).split())]

    def decode(self, ids: list[int]) -> bytes:
        return b"".join(map(self.tokens.__getitem__, ids))


@lru_cache(maxsize=2)
def encoder(rank_file: str, pattern: str) -> Encoder:
    """One encoder a worker process."""
    return Encoder(rank_file, pattern)


def encode_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id and ids array<int> of the whole text, for each row of docs(doc_id, text); null counts as empty.

    Special tokens' strings are ordinary text. Null doc_ids and repeated rows stay, other columns are left out, an
    empty table gives no rows. rank_file must be readable on every executor.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(rank_file, pattern)
        for part in parts:
            for rows in slices(part):
                ids = [own.encode(t or "") for t in rows.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(batches, "doc_id long, ids array<int>")


def digest_documents(docs: DataFrame, rank_file: str, pattern: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each row, as encode_documents; the ids never leave the worker.

    decoded_sha256 is of the bytes that the row's ids, the very ones that ids_sha256 is of, decode to.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = encoder(rank_file, pattern)
        for part in parts:
            for rows in slices(part):
                counts, ids_hex, decoded_hex = [], [], []
                for text in rows.column(1).to_pylist():
                    names = own.names(text or "")
                    counts.append(names.count(" ") + 1 if names else 0)
                    ids_hex.append(hashlib.sha256(names.encode()).hexdigest())
                    decoded_hex.append(hashlib.sha256(own.decode_names(names)).hexdigest())
                yield pa.RecordBatch.from_arrays([rows.column(0), pa.array(counts, pa.int64()), pa.array(ids_hex, pa.string()), pa.array(decoded_hex, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(batches, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def slices(part: pa.RecordBatch, rows: int = 256) -> Iterator[pa.RecordBatch]:
    """A batch in steps of few rows, so that what is made of each stays small."""
    for at in range(0, part.num_rows, rows):
        yield part.slice(at, rows)
