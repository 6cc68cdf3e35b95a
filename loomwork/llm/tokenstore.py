"""Token-ID output in training order: sequences of fixed length at places that a keyed permutation gives them.

All documents, each one's ids and an end mark, form one stream that is cut into sequences of seq_len, so only the last
sequence is padded. The stream's order is by (hash bucket, doc_id, text hash): it hangs on the rows alone, not on their
partitions. A keyed Feistel permutation with cycle-walking sends sequence k to its slot, so training order needs no
sort by a random key and any slot's shard and offset follow from arithmetic. Each range of shard_slots slots is one
file: sequences of equal stride in slot order, so a reader goes through a shard from front to back and resumes at
slot * stride.

Ids are made once. Tasks append them to token files of bounded size, and pass on a narrow row for each document, from
which running totals give places. A second pass reads each token file once and deals its pieces to their shards, one
compressed block for each file and shard; a group of blocks is one shard.
"""

from __future__ import annotations

import base64
import json
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import asdict, dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyarrow import fs
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import release, remove, running_before, stored
from loomwork.llm.feistel import permute_array

#: A token file is closed at so many ids or documents; a frame of one holds so many documents.
FILE_IDS, FILE_DOCS, FRAME_DOCS = 4_000_000, 65_536, 256
#: Documents whose ids are added up in one window, about.
BUCKET_DOCS = 1000
#: Levels of zstd for token files and for blocks.
FILE_LEVEL, BLOCK_LEVEL = 6, 6
#: What a piece of a document in a sequence has in a block, before the ids of all pieces.
PIECE = np.dtype([("slot", "<i8"), ("doc_id", "<i8"), ("part", "<i8"), ("at", "<i4"), ("n", "<i4"), ("known", "?")])

PLACES = "doc_id long, h long, n_tokens long, file string, frame long, size long, skip long"
INDEX = "slot long, shard long, offset long, doc_id long, part long, n_tokens long"


@dataclass(frozen=True)
class Layout:
    """Ids are little-endian unsigned integers of id_bytes; a shard holds shard_slots sequences, the last one fewer."""

    rank_file: str
    pattern: str
    seq_len: int = 512
    end_id: int = 50256
    pad_id: int = 50257
    id_bytes: int = 2
    shard_slots: int = 32_768
    key: str = "epoch 0"

    @property
    def stride(self) -> int:
        return self.seq_len * self.id_bytes

    @property
    def kind(self) -> str:
        return f"<u{self.id_bytes}"


@lru_cache(maxsize=1)
def fast_encoding(rank_file: str, pattern: str) -> tiktoken.Encoding:
    """The library's encoding by a rank file, one a worker process."""
    with open(rank_file, "rb") as lines:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
    return tiktoken.Encoding("own", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path)


def _packed(data: bytes, level: int) -> bytes:
    return len(data).to_bytes(8, "little") + pa.Codec("zstd", compression_level=level).compress(data, asbytes=True)


def _unpacked(data: bytes) -> bytes:
    return pa.Codec("zstd").decompress(data[8:], int.from_bytes(data[:8], "little"), asbytes=True)


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def tokenized(docs: DataFrame, path: str, layout: Layout) -> DataFrame:
    """PLACES of each row of docs, whose ids (with the end mark) go to token files in the folder path.

    frame and size are the bytes of the file that hold the row's frame, skip is the row's first id in the frame.
    """

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = fast_encoding(layout.rank_file, layout.pattern)
        files, root = _open(path)
        name, out, at, ids_held, docs_held = "", None, 0, 0, 0
        for part in parts:
            for row in range(0, part.num_rows, FRAME_DOCS):
                some = part.slice(row, FRAME_DOCS)
                ids = [np.array(own.encode_ordinary(t or "") + [layout.end_id], layout.kind) for t in some.column(1).to_pylist()]
                counts = np.array([len(x) for x in ids])
                frame = _packed(np.concatenate(ids).tobytes(), FILE_LEVEL)
                if out is None:
                    name, at, ids_held, docs_held = f"{uuid.uuid4().hex}.ids", 0, 0, 0
                    out = files.open_output_stream(f"{root}/{name}")
                out.write(frame)
                n = len(counts)
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(2), pa.array(counts, pa.int64()), pa.array([name] * n), pa.array([at] * n, pa.int64()), pa.array([len(frame)] * n, pa.int64()), pa.array(np.cumsum(counts) - counts)], [c.split()[0] for c in PLACES.split(", ")])
                at, ids_held, docs_held = at + len(frame), ids_held + int(counts.sum()), docs_held + n
                if ids_held >= FILE_IDS or docs_held >= FILE_DOCS:
                    out.close()
                    out = None
        if out is not None:
            out.close()

    return docs.select(docs["doc_id"].cast("long"), "text", F.xxhash64(F.coalesce("text", F.lit("")))).mapInArrow(batches, PLACES)


def numbered(places: DataFrame, rows: int) -> DataFrame:
    """places with start, the row's first id in the stream of all ids.

    Equal rows go by their place in the token files, which a task that runs again finds unchanged.
    """
    buckets = rows // BUCKET_DOCS + 1
    dealt = places.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "h"), F.lit(buckets)))
    sums = running_before(dealt.groupBy("bucket").agg(F.sum("n_tokens").alias("held")), [], "bucket", "held", "base")
    order = Window.partitionBy("bucket").orderBy("doc_id", "h", "n_tokens", "file", "frame", "skip")
    inner = F.sum("n_tokens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("n_tokens")
    return dealt.withColumn("inner", inner).join(sums.select("bucket", "base"), "bucket").select(*places.columns, (F.col("base") + F.col("inner")).alias("start"))


def dealt_blocks(numbers: DataFrame, path: str, layout: Layout, sequences: int) -> DataFrame:
    """shard and block (binary) for each token file and each shard that takes ids of it."""

    def blocks(part: pa.Table) -> pa.Table:
        files, root = _open(path)
        part = part.sort_by([("frame", "ascending"), ("skip", "ascending")])
        col = lambda name: part.column(name).to_numpy()
        frames, first = np.unique(col("frame"), return_index=True)
        with files.open_input_file(f"{root}/{part.column('file')[0].as_py()}") as source:
            ids = np.concatenate([np.frombuffer(_unpacked(source.read_at(int(n), int(at))), layout.kind) for at, n in zip(frames, col("size")[first], strict=True)])
        n, start = col("n_tokens"), col("start")
        held = part.column("doc_id").combine_chunks()
        doc_id, known = held.fill_null(0).to_numpy(), held.is_valid().to_numpy(zero_copy_only=False)
        source_at = np.cumsum(n) - n
        first_seq = start // layout.seq_len
        parts = (start + n - 1) // layout.seq_len - first_seq + 1
        row = np.repeat(np.arange(len(n)), parts)
        nth = np.arange(len(row)) - np.repeat(np.cumsum(parts) - parts, parts)
        seq = first_seq[row] + nth
        begin, end = np.maximum(seq * layout.seq_len, start[row]), np.minimum((seq + 1) * layout.seq_len, (start + n)[row])
        piece = np.empty(len(row), PIECE)
        piece["slot"], piece["doc_id"], piece["known"], piece["part"] = permute_array(seq, sequences, layout.key), doc_id[row], known[row], nth
        piece["at"], piece["n"] = begin - seq * layout.seq_len, end - begin
        order = np.lexsort((piece["at"], piece["slot"]))
        piece, source_at = piece[order], (source_at[row] + begin - start[row])[order]
        size = piece["n"].astype(np.int64)
        upto = np.concatenate(([0], np.cumsum(size)))
        ids = ids[np.repeat(source_at - upto[:-1], size) + np.arange(upto[-1])]
        shard = piece["slot"] // layout.shard_slots
        cuts = np.flatnonzero(np.diff(shard, prepend=-1))
        made = [_packed((b - a).tobytes() + b"".join(np.ascontiguousarray(piece[c][a:b]).tobytes() for c in PIECE.names) + ids[upto[a] : upto[b]].tobytes(), BLOCK_LEVEL) for a, b in zip(cuts, np.append(cuts[1:], len(piece)), strict=True)]
        return pa.table({"shard": pa.array(shard[cuts], pa.int64()), "block": pa.array(made, pa.binary())})

    return numbers.groupBy("file").applyInArrow(blocks, "shard long, block binary")


def _pieces(block: bytes, kind: str) -> tuple[np.ndarray, np.ndarray]:
    """(pieces, ids) of a block."""
    data = _unpacked(block)
    n, at = int.from_bytes(data[:8], "little"), 8
    out = np.empty(n, PIECE)
    for c in PIECE.names:
        out[c] = np.frombuffer(data, PIECE[c], n, at)
        at += PIECE[c].itemsize * n
    return out, np.frombuffer(data, kind, offset=at)


def _begin(path: str, described: dict) -> None:
    """Makes the folder ready for what is described; shards of anything else go."""
    folder, where = _open(path)
    folder.create_dir(where, recursive=True)
    there = folder.get_file_info(f"{where}/layout.json")
    if there.is_file:
        with folder.open_input_stream(there.path) as source:
            if json.loads(source.read()) == described:
                return
    for found in folder.get_file_info(fs.FileSelector(where)):
        if found.is_file:
            folder.delete_file(found.path)
    with folder.open_output_stream(f"{where}/layout.json") as out:
        out.write(json.dumps(described).encode())


def write_tokens(docs: DataFrame, path: str, layout: Layout) -> DataFrame:
    """Writes shards and layout.json into the folder path (a URI that all executors reach); returns its index.

    Index, a row for each document's piece of a sequence: slot, shard, offset (bytes), doc_id, part (of the document,
    from 0), n_tokens. A null or empty text is its end mark only. Null doc_ids and repeated rows are stored like
    others. Other columns are left out. An empty table gives no shards. The shards hang on the rows and the layout
    alone, however the rows are partitioned. layout.json holds a digest of both: a folder of other rows or another
    layout is cleared first. A shard becomes visible by a rename when it is whole, so a task that runs again, or a
    job that resumes with the same rows and layout, leaves whole shards as they are.
    """
    ids_at = f"{path}/ids-{uuid.uuid4().hex}"
    folder, where = _open(ids_at)
    folder.create_dir(where, recursive=True)
    places = stored(tokenized(docs, ids_at, layout), "token-places")
    state = places.agg(F.count("*"), F.sum("n_tokens"), F.sum(F.xxhash64("doc_id", "h", "n_tokens").cast("decimal(38,0)"))).first()
    sequences = -(-(state[1] or 0) // layout.seq_len)
    last = (state[1] or 0) - max(0, sequences - 1) * layout.seq_len
    kept = {k: v for k, v in asdict(layout).items() if k != "rank_file"}
    _begin(path, kept | {"ranks": zlib.crc32(open(layout.rank_file, "rb").read()), "rows": state[0], "tokens": state[1] or 0, "digest": str(state[2] or 0), "sequences": sequences, "last": last})

    def write(key: tuple, part: pa.Table) -> pa.Table:
        files, root = _open(path)
        shard = key[0].as_py()
        first, slots = shard * layout.shard_slots, min(layout.shard_slots, sequences - shard * layout.shard_slots)
        name, found = f"{root}/{shard_name(shard)}", [_pieces(b.as_py(), layout.kind) for b in part.column("block")]
        piece = np.concatenate([p for p, _ in found])
        at = (piece["slot"] - first) * layout.seq_len + piece["at"]
        there = files.get_file_info(name)
        if not (there.is_file and there.size == slots * layout.stride):
            whole = np.full(slots * layout.seq_len, layout.pad_id, layout.kind)
            done = 0
            for p, ids in found:
                size = p["n"].astype(np.int64)
                whole[np.repeat(at[done : done + len(p)] - (np.cumsum(size) - size), size) + np.arange(len(ids))] = ids
                done += len(p)
            draft = f"{root}/.{shard_name(shard)}-{uuid.uuid4().hex}"
            with files.open_output_stream(draft) as out:
                out.write(memoryview(whole))
            files.move(draft, name)
        order = np.argsort(at, kind="stable")
        piece, at = piece[order], at[order]
        doc_id = pa.array(piece["doc_id"], mask=~piece["known"])
        return pa.table([pa.array(piece["slot"]), pa.array(np.full(len(at), shard)), pa.array(at * layout.id_bytes), doc_id, pa.array(piece["part"]), pa.array(piece["n"].astype(np.int64))], [c.split()[0] for c in INDEX.split(", ")])

    blocks = dealt_blocks(numbered(places, state[0]), ids_at, layout, sequences)
    index = stored(blocks.groupBy("shard").applyInArrow(write, INDEX), "token-index")
    release(places)
    remove(docs.sparkSession, ids_at)
    return index


def read_back(index: DataFrame, path: str, layout: Layout) -> DataFrame:
    """The index with ids array<int> and crc32 (of the piece's stored bytes), read from the shards front to back."""

    def read(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = _open(path)
        for part in parts:
            shards, starts = part.column("shard").to_numpy(), part.column("offset").to_numpy()
            sizes = part.column("n_tokens").to_numpy() * layout.id_bytes
            cuts = np.flatnonzero(np.diff(shards, prepend=-1))
            crcs, ids = [], []
            for a, b in zip(cuts, np.append(cuts[1:], len(shards)), strict=True):
                low, high = int(starts[a:b].min()), int((starts + sizes)[a:b].max())
                with files.open_input_file(f"{root}/{shard_name(shards[a])}") as source:
                    data = memoryview(source.read_at(high - low, low))
                for at, n in zip((starts[a:b] - low).tolist(), sizes[a:b].tolist(), strict=True):
                    crcs.append(zlib.crc32(data[at : at + n]))
                    ids.append(np.frombuffer(data[at : at + n], layout.kind))
            lengths = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
            flat = np.concatenate([np.empty(0, np.int32), *ids]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([*part.columns, pa.ListArray.from_arrays(pa.array(lengths), pa.array(flat)), pa.array(crcs, pa.int64())], [*part.schema.names, "ids", "crc32"])

    return index.mapInArrow(read, f"{INDEX}, ids array<int>, crc32 long")
