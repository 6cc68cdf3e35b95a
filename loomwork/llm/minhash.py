"""MinHash near-duplicates: bands propose pairs, b-bit signatures weed them, full shingle sets decide.

1. Texts with equal shingle sets become one class; its least doc_id stands for it.
2. HASHES minima in BANDS bands: classes that share a band are candidates. Each is paired with the least of its band
   only, which is linear in the rows whatever the size of a group. Packed b-bit minima estimate each pair's
   similarity, corrected for chance collisions; pairs well below the threshold go.
3. Pairs that are left are decided on the full sets, and components follow.
4. A band whose members are in several components by now may hide links that do not involve its least member: its
   members of different components are compared too (see closing_pairs), so nothing is lost but by the bands' chance:
   (1 - s**ROWS)**BANDS, 5e-6 at a similarity of 0.75.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.llm.common import release, stored
from loomwork.llm.components import connected_components
from loomwork.llm.textbytes import LOWER, NOT_SPACE, U64, Hashes, mix, spans, text_slices

WORDS = 5
#: Links have 100 * intersection >= PERCENT * union.
PERCENT = 75
BANDS, ROWS = 32, 4
HASHES = BANDS * ROWS
BITS = 4
#: 64-bit words of a packed signature, and the bits that mark differing minima in one.
PACKED = HASHES * BITS // 64
MARKS = 0x1111111111111111
#: Estimates this far below the threshold go: over four deviations of an estimate from HASHES minima.
SLACK = 0.19
SLICE = 500_000

_ODD = mix(np.arange(1, 2 * HASHES + 1, dtype=U64)) | U64(1)
_TIMES, _PLUS = _ODD[:HASHES], mix(_ODD[HASHES:])
_PLACES = mix(np.arange(101, 101 + WORDS, dtype=U64)) | U64(1)
_ROWS = mix(np.arange(201, 201 + ROWS, dtype=U64)) | U64(1)
_BANDS = mix(np.arange(301, 301 + BANDS, dtype=U64))


def shingles(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(hash, text) of the distinct shingles of each text, ascending within a text."""
    data = LOWER[data]
    starts, ends, text = spans(NOT_SPACE[data], offsets)
    words = Hashes(data).of(starts, ends)
    whole = np.flatnonzero(text[: 1 - WORDS or None] == text[WORDS - 1 :]) if len(words) >= WORDS else np.empty(0, np.int64)
    total = np.zeros(len(whole), U64)
    for i in range(WORDS):
        total += words[whole + i] * _PLACES[i]
    found, of = [mix(total)], [text[whole]]
    first = np.flatnonzero(np.diff(text, prepend=-1))
    n = np.diff(np.append(first, len(text)))
    for k in range(1, WORDS):  # the whole sequence of shorter texts
        at = first[n == k]
        total = np.full(len(at), k, U64)
        for i in range(k):
            total += words[at + i] * _PLACES[i]
        found.append(mix(total))
        of.append(text[at])
    h, text = np.concatenate(found), np.concatenate(of)
    order = np.argsort(text, kind="stable")
    h, text = h[order], text[order]
    begins = np.flatnonzero(np.diff(text, prepend=-1))
    for a, b in zip(begins, np.append(begins, len(text))[1:], strict=True):
        h[a:b].sort()
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (text[1:] != text[:-1])
    return h[new], text[new]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, h (of the text), n, print0, print1, signature, bands; the last four are null for a text without words."""
    schema = "doc_id long, h long, n long, print0 long, print1 long, signature array<long>, bands array<long>"

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, end, data, offsets in text_slices(part.column(1), SLICE):
                h, text = shingles(data, offsets)
                begins = np.flatnonzero(np.diff(text, prepend=-1))
                some, n = text[begins], np.diff(np.append(begins, len(text)))
                minima = np.empty((HASHES, len(some)), U64)
                for i in range(HASHES if len(some) else 0):
                    minima[i] = np.minimum.reduceat((h * _TIMES[i] + _PLUS[i]) >> U64(32), begins)
                signature = np.zeros((PACKED, len(some)), U64)
                for i in range(HASHES):
                    signature[i * BITS // 64] |= (minima[i] & U64((1 << BITS) - 1)) << U64(i * BITS % 64)
                bands = np.empty((BANDS, len(some)), U64)
                for b in range(BANDS):
                    bands[b] = mix((minima[b * ROWS : (b + 1) * ROWS] * _ROWS[:, None]).sum(axis=0, dtype=U64) + _BANDS[b])
                prints = [np.add.reduceat(mix(h + U64(k)), begins) if len(some) else h for k in (1, 2)]
                count = np.zeros(end - first, np.int64)
                count[some] = n
                full = count > 0
                upto = np.concatenate(([0], np.cumsum(full)))
                place = pa.array(np.where(full, np.cumsum(full) - 1, 0), mask=~full)
                take = lambda x: pa.array(x.view(np.int64)).take(place)

                def lists(x: np.ndarray, full=full, upto=upto) -> pa.Array:
                    flat = np.ascontiguousarray(x.T).view(np.int64).ravel()
                    return pa.ListArray.from_arrays(pa.array((upto * len(x)).astype(np.int32), mask=np.append(~full, False)), pa.array(flat))

                yield pa.RecordBatch.from_arrays([part.column(0).slice(first, end - first), part.column(2).slice(first, end - first), pa.array(count), take(prints[0]), take(prints[1]), lists(signature), lists(bands)], ["doc_id", "h", "n", "print0", "print1", "signature", "bands"])

    return docs.select(docs["doc_id"].cast("long"), "text", F.xxhash64("text")).mapInArrow(batches, schema)


def shingle_sets(docs: DataFrame) -> DataFrame:
    """doc_id and grams, its distinct shingle hashes."""

    def batches(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part in parts:
            for first, end, data, offsets in text_slices(part.column(1), SLICE):
                h, text = shingles(data, offsets)
                ends = np.searchsorted(text, np.arange(end - first + 1)).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0).slice(first, end - first), pa.ListArray.from_arrays(pa.array(ends), pa.array(h.view(np.int64)))], ["doc_id", "grams"])

    return docs.select(docs["doc_id"].cast("long"), "text").mapInArrow(batches, "doc_id long, grams array<long>")


def estimate(a: Column, b: Column) -> Column:
    """Similarity from packed b-bit minima: equal ones, less those that agree by chance."""
    differ = F.lit(0)
    for i in range(PACKED):
        x = F.get(a, i).bitwiseXOR(F.get(b, i))
        for shift in (1, 2):
            x = x.bitwiseOR(F.shiftrightunsigned(x, shift))
        differ = differ + F.bit_count(x.bitwiseAND(F.lit(MARKS)))
    equal, chance = 1 - differ / HASHES, 2.0**-BITS
    return (equal - chance) / (1 - chance)


def likely(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Pairs (a, b) that sizes and signatures do not rule out."""
    one = nodes.select(F.col("node").alias("a"), F.col("n").alias("na"), F.col("signature").alias("sa"))
    two = nodes.select(F.col("node").alias("b"), F.col("n").alias("nb"), F.col("signature").alias("sb"))
    sized = pairs.join(one, "a").join(two, "b")
    sized = sized.where(F.least("na", "nb") * 100 >= F.greatest("na", "nb") * PERCENT)
    return sized.where(estimate(F.col("sa"), F.col("sb")) >= PERCENT / 100 - SLACK).select("a", "b")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) whose full sets (doc_id, grams) meet the threshold."""
    one = sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("ga"))
    two = sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("gb"))
    both = F.size(F.array_intersect("ga", "gb"))
    found = pairs.join(one, "a").join(two, "b").where(both * 100 >= (F.size("ga") + F.size("gb") - both) * PERCENT)
    return found.select("a", "b")


#: What meets in one task, on either side: members of a band, and shingles of their sets (a set of more is alone).
CHUNK, CHUNK_GRAMS = 1024, 2_000_000


def _alike(left: dict, right: dict, keys: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """Rows of right, most alike first, that may link with each row of left and are of another component.

    A pair of rows is looked at in the first band that it shares only.
    """
    lowest = int(np.ceil((PERCENT / 100 - SLACK) * HASHES * (1 - 2.0**-BITS) + HASHES * 2.0**-BITS))
    for i in range(len(left["component"])):
        x = left["signature"][i] ^ right["signature"]
        x |= x >> U64(2)
        x |= x >> U64(1)
        equal = HASHES - np.bitwise_count(x & U64(MARKS)).sum(axis=1, dtype=np.int64)
        n, m = left["n"][i], right["n"]
        may = (equal >= lowest) & (np.minimum(n, m) * 100 >= np.maximum(n, m) * PERCENT) & (right["component"] != left["component"][i])
        may &= right["settled"] | (right["node"] > left["node"][i])
        at = np.flatnonzero(may)
        if len(at):
            shared = left["bands"][i] == right["bands"][at]
            at = at[left["bands"][i][shared.argmax(axis=1)] == keys]
            if len(at):
                yield i, at[np.argsort(-equal[at], kind="stable")]


def _linked(keys: np.ndarray, left: dict, right: dict) -> tuple[list, list]:
    """Pairs of components that a confirmed link between left and right rows joins; one link for each is enough."""
    group: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := group.get(x, x)) != x:
            x = up
        return x

    a, b = [], []
    for i, at in _alike(left, right, keys):
        for j in at:
            one, two = root(int(left["component"][i])), root(int(right["component"][j]))
            if one == two:
                continue
            n, m = left["n"][i], right["n"][j]
            both = len(np.intersect1d(left["grams"][i], right["grams"][j], assume_unique=True))
            if both * 100 >= (n + m - both) * PERCENT:
                group[max(one, two)] = min(one, two)
                a.append(int(left["component"][i]))
                b.append(int(right["component"][j]))
    return a, b


def _side(part: pa.Table, is_left: bool) -> dict:
    """The columns of one side as arrays; grams only where the table has them."""
    t = part.filter(pa.array(part.column("is_left").to_numpy() == is_left))
    wide = lambda name, n: t.column(name).combine_chunks().flatten().to_numpy().reshape(t.num_rows, n)
    out = {c: t.column(c).to_numpy() for c in ("node", "component", "n", "settled")}
    out |= {"signature": wide("signature", PACKED).view(U64), "bands": wide("bands", BANDS)}
    if "grams" in t.column_names:
        grams = t.column("grams").combine_chunks()
        cuts, flat = grams.offsets.to_numpy(), grams.values.to_numpy().view(U64)
        out["grams"] = [flat[i:j] for i, j in zip(cuts[:-1], cuts[1:], strict=True)]
    return out


def closing_links(members: DataFrame, components: DataFrame, nodes: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs (a, b) of components that links inside of bands join, beyond those with a band's least member.

    members: key, node. In each band with three members or more of several components, the members outside its most
    frequent component (left) meet all members (right), chunk by chunk, so no task holds more than two chunks and
    no pair becomes a row. Sizes and signatures meet first; full sets follow only for the rows, and to the chunks,
    where a pair is left to decide.
    """
    of = members.join(components, "node", "left").select("key", "node", F.coalesce("component", "node").alias("component"))
    of = of.join(nodes.select("node", "n"), "node")
    counts = of.groupBy("key", "component").agg(F.count("*").alias("c"), F.sum("n").alias("g"))
    mixed = counts.groupBy("key").agg(F.sum("c").alias("m"), F.max("c").alias("most"), F.sum("g").alias("g"), F.max_by("g", F.struct("c", "component")).alias("main_g"), F.max_by("component", F.struct("c", "component")).alias("main"), F.count("*").alias("k")).where("k > 1 and m > 2")
    parts = lambda n, g: F.greatest(F.ceil(n / CHUNK), F.ceil(g / CHUNK_GRAMS)).cast("int")
    mixed = mixed.select("key", "main", parts(F.col("m"), F.col("g")).alias("rights"), parts(F.col("m") - F.col("most"), F.col("g") - F.col("main_g")).alias("lefts"))
    rows = stored(of.drop("n").join(mixed, "key"), "near-mixed")
    own = lambda n: F.pmod(F.xxhash64("node"), n).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    settled = F.col("component") == F.col("main")
    left = rows.where(~settled).select("key", "node", "component", settled.alias("settled"), F.lit(True).alias("is_left"), own(F.col("lefts")).alias("l"), each(F.col("rights")).alias("r"))
    right = rows.select("key", "node", "component", settled.alias("settled"), F.lit(False).alias("is_left"), each(F.col("lefts")).alias("l"), own(F.col("rights")).alias("r"))
    light = left.unionByName(right).join(nodes.select("node", "n", "signature", "bands"), "node")

    def wanted(key: tuple, part: pa.Table) -> pa.Table:
        one, two = _side(part, True), _side(part, False)
        found = [(i, at) for i, at in _alike(one, two, key[0].as_py())]
        rows_of = lambda side, at, is_left: part.filter(pa.array(part.column("is_left").to_numpy() == is_left)).take(pa.array(at))
        lefts = rows_of(one, np.array([i for i, _ in found], np.int64), True)
        rights = rows_of(two, np.unique(np.concatenate([np.empty(0, np.int64), *(at for _, at in found)])), False)
        return pa.concat_tables([lefts, rights])

    schema = "node long, key long, component long, settled boolean, is_left boolean, l int, r int, n long, signature array<long>, bands array<long>"
    names = [c.split()[0] for c in schema.split(", ")]
    some = stored(light.select(names).groupBy("key", "l", "r").applyInArrow(wanted, schema), "near-wanted")
    full = some.join(sets.select(F.col("doc_id").alias("node"), "grams"), "node")

    def links(key: tuple, part: pa.Table) -> pa.Table:
        a, b = _linked(key[0].as_py(), _side(part, True), _side(part, False))
        return pa.table({"a": pa.array(a, pa.int64()), "b": pa.array(b, pa.int64())})

    found = stored(full.groupBy("key", "l", "r").applyInArrow(links, "a long, b long"), "near-closing")
    release(rows, some)
    return found


def _once(rows: DataFrame, keys: list[str]) -> DataFrame:
    """One row of each key; only rows of keys that are repeated move."""
    counts = rows.groupBy(*keys).count()
    repeated = counts.where("count > 1").drop("count")
    if repeated.isEmpty():
        return rows
    return rows.join(repeated, keys, "left_anti").unionByName(rows.join(repeated, keys, "left_semi").dropDuplicates(keys))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for each row of docs(doc_id, text).

    A text of fewer words than a shingle is one shingle; null, empty and wordless texts have none and stay alone.
    Each row goes by its own text, so repeated rows share a component; different texts with one doc_id are one node
    where that doc_id stands for both. A row without a doc_id gets a null component
    and kept false unless another row with its words has one. Other columns are left out; an empty table gives none.
    """
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.xxhash64("text").alias("h"))
    made = stored(sketches(docs), "near-sketches")
    prints = ["print0", "print1", "n"]
    every = stored(made.where("n > 0").groupBy(*prints).agg(F.min("doc_id").alias("node")).where("node is not null"), "near-classes")
    named = made.join(every, prints).where("doc_id = node")
    nodes = named.groupBy("node", *prints).agg(F.min("h").alias("h"))  # one text of each class stands for it
    nodes = stored(_once(named.join(nodes, ["node", *prints, "h"], "left_semi").select("node", "h", "n", "signature", "bands"), ["node", "h"]), "near-nodes")
    banded = nodes.select("node", F.explode("bands").alias("key")).distinct()
    shared = banded.groupBy("key").agg(F.count("*").alias("m"), F.min("node").alias("least")).where("m > 1")
    members = stored(banded.join(shared, "key").select("key", "node", "least"), "near-members")
    used = nodes.join(members.select("node").distinct(), "node", "left_semi").select(F.col("node").alias("doc_id"), "h")
    sets = stored(shingle_sets(_once(docs.join(used, ["doc_id", "h"], "left_semi"), ["doc_id", "h"])), "near-sets")
    pairs = members.where("node != least").select(F.col("node").alias("a"), F.col("least").alias("b")).distinct()
    components = connected_components(confirmed(likely(pairs, nodes), sets))
    closing = closing_links(members.select("key", "node"), components, nodes, sets)
    ends = connected_components(closing)
    joined = ends.select(F.col("node").alias("component"), F.col("component").alias("final"))
    of = every.join(components, "node", "left").withColumn("component", F.coalesce("component", "node"))
    of = of.join(joined, "component", "left").select(*prints, F.coalesce("final", "component").alias("component"))
    rows = made.select("doc_id", *prints).join(of, prints, "left")
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id"))
    out = stored(rows.select("doc_id", F.col("n").alias("n_shingles"), component.alias("component_id"), F.coalesce(F.col("doc_id") == component, F.lit(False)).alias("kept")), "near-result")
    release(made, every, nodes, members, sets, components, closing, ends)
    return out
