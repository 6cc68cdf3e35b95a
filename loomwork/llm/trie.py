"""Prefix trie of conversations by partition refinement.

Conversations that are equal turn by turn are one unit with a weight. All units start in one class. A class is split by
the next turns of its units; a unit alone in its class retires, and its further turns are a unary chain. The rounds
take 2, 4, 8, ... turns each, so a prefix of n turns that many units share takes about log(n) rounds. Then sums over
the chains are folded back to all classes on the way. Turns are known by a 128-bit hash of role and text.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import WORD, numbered, running_before, stored

#: Conversations of a prompt group: conv_id less its remainder; and one more than the most turns that are shared.
GROUP, SHARED = 20, 4
#: Turns of the first round and of any round at most.
FIRST_TURNS, MOST_TURNS = 2, 64
#: Two to this power: the ids of ends that meet in one row.
CHUNK_BITS = 12


def shared_turns(conv_id: Column) -> Column:
    """How many turns a conversation takes from the first one of its group."""
    return (F.crc32(conv_id.cast("string")) % SHARED).cast("int")


def turns_of(conversations: DataFrame) -> DataFrame:
    """conv_id, place (from 1), mark (16 bytes), words of each turn, in the order of turn, null first.

    Null roles and texts count as empty. Turns that tie are ordered by their marks; repeated rows are turns of their
    own. Rows without a conv_id are left out.
    """
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    mark = F.unhex(F.md5(F.concat(F.length(role).cast("string"), F.lit(":"), role, text)))
    rows = conversations.where("conv_id is not null").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), mark.alias("mark"), F.regexp_count(text, F.lit(WORD)).cast("long").alias("words"))
    return numbered(rows, "conv_id", ["turn", "mark"], "before").select("conv_id", (F.col("before") + 1).alias("place"), "mark", "words")


def rebuilt(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Turns (conv_id, depth from 1, mark, words) and all ids (conv_id, n_turns) of the rebuilt conversations.

    Each starts with the first shared_turns of its group's first conversation, and goes on with its own turns after as
    many of them.
    """
    sizes = turns.groupBy("conv_id").agg(F.count("*").alias("own"))
    group = F.col("conv_id") - F.col("conv_id") % GROUP
    firsts = sizes.select(F.col("conv_id").alias("group_id"), F.col("own").alias("there"))
    plan = sizes.select("conv_id", "own", group.alias("group_id"), shared_turns(F.col("conv_id")).alias("h")).join(firsts, "group_id", "left")
    plan = plan.select("conv_id", "group_id", "own", "h", F.least("h", F.coalesce("there", F.lit(0))).alias("taken"))
    heads = turns.where(F.col("place") < SHARED).select(F.col("conv_id").alias("group_id"), F.col("place").alias("depth"), "mark", "words")
    heads = plan.where("h > 0").select("conv_id", "group_id", "h").join(heads, "group_id").where("depth <= h").select("conv_id", "depth", "mark", "words")
    rest = turns.join(plan.select("conv_id", "h", "taken"), "conv_id").where("place > h")
    rest = rest.select("conv_id", (F.col("taken") + F.col("place") - F.col("h")).alias("depth"), "mark", "words")
    return heads.unionByName(rest), plan.select("conv_id", (F.col("taken") + F.greatest(F.col("own") - F.col("h"), F.lit(0))).alias("n_turns"))


def _lanes(depth: str, mark: str) -> list[Column]:
    """Two 64-bit hashes of a turn at its depth; exclusive-ors of both are the mark of a sequence."""
    return [F.xxhash64(F.lit(1), depth, mark), F.xxhash64(mark, depth, F.lit(2))]


def _joined_ids(members: DataFrame) -> DataFrame:
    """unit, ends_sha256 of members(unit, conv_id): of all ids, ascending.

    Ids meet in rows of a bounded range of them, and such rows of one unit stream through one task in order.
    """
    pieces = members.groupBy("unit", F.shiftright("conv_id", CHUNK_BITS).alias("chunk")).agg(F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",").alias("ids"))

    def digest(parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        unit, state = None, hashlib.sha256()
        done: list[tuple[int, str]] = []
        row = lambda: pa.RecordBatch.from_arrays([pa.array([u for u, _ in done], pa.int64()), pa.array([d for _, d in done], pa.string())], ["unit", "ends_sha256"])
        for part in parts:
            for own, ids in zip(part.column(0).to_pylist(), part.column(2).to_pylist(), strict=True):
                if own != unit:
                    if unit is not None:
                        done.append((unit, state.hexdigest()))
                    unit, state = own, hashlib.sha256(ids.encode())
                else:
                    state.update(b"," + ids.encode())
            if done:
                yield row()
                done = []
        if unit is not None:
            done.append((unit, state.hexdigest()))
            yield row()

    return pieces.repartition("unit").sortWithinPartitions("unit", "chunk").mapInArrow(digest, "unit long, ends_sha256 string")


def units_of(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """unit (least conv_id), length, weight, ends_sha256 of each distinct sequence of turns; stored."""
    sums = [F.bit_xor(h).alias(f"sum{k}") for k, h in enumerate(_lanes("depth", "mark"))]
    whole = ids.join(turns.groupBy("conv_id").agg(*sums), "conv_id", "left")
    whole = stored(whole.select("conv_id", F.col("n_turns").alias("length"), *[F.coalesce(f"sum{k}", F.lit(0)).alias(f"sum{k}") for k in range(2)]), "trie-sequences")
    same = ["length", "sum0", "sum1"]
    units = whole.groupBy(*same).agg(F.min("conv_id").alias("unit"), F.count("*").alias("weight"))
    several = whole.join(units.where("weight > 1").select("unit", *same), same).select("unit", "conv_id")
    alone = F.sha2(F.col("unit").cast("string"), 256)
    units = units.join(_joined_ids(several), "unit", "left")
    return stored(units.select("unit", "length", "weight", F.coalesce("ends_sha256", alone).alias("ends_sha256")), "trie-units")


def refine(turns: DataFrame, units: DataFrame) -> DataFrame:
    """unit, depth, label of each unit at each depth where its class has several units; the label is the least unit.

    turns are of units only. Each round splits the classes left by some more turns and stores what it found.
    """
    spark, found, depth, step = turns.sparkSession, [], 0, FIRST_TURNS
    active = units.where("length > 0").select("unit", F.lit(0).cast("long").alias("class"))
    while True:
        some = turns.where((F.col("depth") > depth) & (F.col("depth") <= depth + step)).join(active, "unit")
        upto = Window.partitionBy("unit").orderBy("depth")
        some = some.select("unit", "depth", "class", *[F.bit_xor(h).over(upto).alias(f"sum{k}") for k, h in enumerate(_lanes("depth", "mark"))])
        same = ["depth", "class", "sum0", "sum1"]
        parts = some.groupBy(*same).agg(F.min("unit").alias("label"), F.count("*").alias("n")).where("n > 1").drop("n")
        split = stored(some.join(parts, same).select("unit", "depth", "label"), "trie-classes")
        found.append(split)
        depth, step = depth + step, min(2 * step, MOST_TURNS)
        active = split.where(F.col("depth") == depth).select("unit", F.col("label").alias("class"))
        if active.isEmpty():
            break
    out = found[0]
    for more in found[1:]:
        out = out.unionByName(more)
    return out if len(found) > 1 else spark.createDataFrame([], out.schema).unionByName(out)


def prefix_trie(conversations: DataFrame, rebuild: Callable[[DataFrame], tuple[DataFrame, DataFrame]] = rebuilt) -> DataFrame:
    """A row for each node: each distinct sequence of first turns of the rebuilt conversations, from the root on.

    conv_id (least member), depth, parent_conv_id (null at the root), n_convs, n_children, n_leaves, saved_tokens and
    ends_sha256 (of the members that end there). Null roles and texts count as empty, null turns come first, turns
    that tie are ordered by a hash of role and text, repeated rows are turns of their own; rows without a conv_id and
    other columns are left out. Conversations without turns are members of the root. An empty table gives no rows.
    """
    turns, ids = rebuild(stored(turns_of(conversations), "trie-own-turns"))
    turns = stored(turns, "trie-turns")
    units = units_of(turns, ids)
    turns = turns.join(units.select(F.col("unit").alias("conv_id")), "conv_id", "left_semi").withColumnRenamed("conv_id", "unit")
    classes = refine(turns, units)
    # the label's turn stands for its node; chains begin where a unit has no class any more
    shared = classes.join(units.select("unit", "weight"), "unit").groupBy("depth", "label").agg(F.sum("weight").alias("n_convs"))
    chains = classes.groupBy("unit").agg(F.count("*").alias("classes"))
    known = units.join(chains, "unit", "left").select("unit", "length", "weight", "ends_sha256", F.coalesce("classes", F.lit(0)).alias("classes"))
    nodes = turns.join(known, "unit").join(shared.withColumnRenamed("label", "unit"), ["unit", "depth"], "left")
    n_convs = F.when(F.col("depth") > F.col("classes"), F.col("weight")).otherwise(F.col("n_convs"))
    nodes = nodes.select("unit", "depth", "length", "classes", "ends_sha256", n_convs.alias("n_convs"), F.coalesce((n_convs - 1) * F.col("words"), F.lit(0)).alias("own"), (F.col("depth") - 1).alias("place"))
    nodes = stored(running_before(nodes, ["unit"], "place", "own", "before"), "trie-nodes")
    totals = nodes.groupBy("unit").agg(F.sum("own").alias("total"))
    nodes = nodes.join(totals, "unit").withColumn("ahead", F.col("total") - F.col("before"))
    # fold back: what each unit owns ahead, to the classes that it is in
    leaf = (F.col("classes") < F.col("length")).cast("long")
    ends = F.when(F.col("depth") == F.col("length"), F.col("ends_sha256"))
    placed = classes.join(nodes.select("unit", "depth", "ahead", leaf.alias("leaf"), ends.alias("ends")), ["unit", "depth"])
    folded = placed.groupBy("depth", "label").agg(F.sum("ahead").alias("saved_tokens"), F.sum("leaf").alias("n_leaves"), F.max("ends").alias("ends_sha256"))
    inner = folded.join(shared, ["depth", "label"])
    inner = inner.select(F.col("label").alias("unit"), "depth", "n_convs", "n_leaves", "saved_tokens", "ends_sha256")
    chain = nodes.where("depth > classes").select("unit", "depth", "n_convs", F.lit(1).cast("long").alias("n_leaves"), F.col("ahead").alias("saved_tokens"), ends.alias("ends_sha256"))
    below = stored(inner.unionByName(chain), "trie-below")
    # parents: the class one turn before, or the unit itself on its chain
    before = classes.select("unit", (F.col("depth") + 1).alias("depth"), F.col("label").alias("parent_conv_id"))
    root = known.agg(F.min("unit").alias("unit"), F.sum("weight").alias("n_convs"), F.sum(leaf).alias("leaves"), F.max(F.when(F.col("length") == 0, F.col("ends_sha256"))).alias("ends_sha256"))
    root = root.crossJoin(totals.agg(F.sum("total").alias("saved"))).where("unit is not null")  # one row by one row
    root = root.select("unit", F.lit(0).cast("long").alias("depth"), "n_convs", F.greatest("leaves", F.lit(1)).alias("n_leaves"), F.coalesce("saved", F.lit(0)).alias("saved_tokens"), "ends_sha256")
    least = root.select(F.col("unit").alias("least"))
    below = below.join(before, ["unit", "depth"], "left").crossJoin(F.broadcast(least))  # one row
    parent = F.when(F.col("depth") == 1, F.col("least")).otherwise(F.coalesce("parent_conv_id", "unit"))
    below = below.select("unit", "depth", "n_convs", "n_leaves", "saved_tokens", "ends_sha256", parent.alias("parent_conv_id"))
    children = below.groupBy(F.col("parent_conv_id").alias("unit"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    every = below.unionByName(root.withColumn("parent_conv_id", F.lit(None).cast("long"))).join(children, ["unit", "depth"], "left")
    none = hashlib.sha256(b"").hexdigest()
    return every.select(F.col("unit").alias("conv_id"), "depth", "parent_conv_id", "n_convs", F.coalesce("n_children", F.lit(0)).alias("n_children"), "n_leaves", "saved_tokens", F.coalesce("ends_sha256", F.lit(none)).alias("ends_sha256"))
