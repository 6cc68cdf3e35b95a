"""Mixing sources to target weights, in DataFrame expressions only.

The words of a source, its documents in a fixed order, form one stream that is cut into blocks of equal length.
Each output shard draws how many of its slots each source fills (a multinomial draw: one uniform number a slot). The
k-th slot of a source takes block permute(k mod blocks) of its stream, with a new permutation after each pass, so no
block is taken more often than there are passes. Draws beyond a source's slots are dealt anew, where they were drawn, to
the sources that lack slots, so every shard but the last is full. Nothing is keyed by source alone where rows are many:
running totals go in two levels.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.llm.common import WORD, running_before, stored
from loomwork.llm.feistel import permute

#: Uniform numbers are integers below this; the table that finds their source has BINS rows or a little more.
UNIT, BINS = 1 << 40, 4096
#: Rows of one source and bucket, and slots that one task places, about.
BUCKET_ROWS, TASK_SLOTS = 1000, 50_000
#: White space, and words each with the white space after it, repeated as a count in braces says.
SPACE = r"[\x20\x09-\x0D]"
SPACED_WORDS = f"(?:{WORD}+{SPACE}*+)"


@dataclass(frozen=True)
class Mix:
    """weights repeat over the sources by code point, null last; share and cap are multiples of sizes."""

    weights: tuple[int, ...] = (5, 2, 1)
    share: float = 1.5
    cap: float = 2.0
    block_words: int = 64
    shard_slots: int = 4096
    seed: int = 17


@dataclass(frozen=True)
class Mixture:
    """Tables of one mix.

    sources: sid, source, size, target, blocks, slots. documents: doc_id, key (a hash of doc_id, source and text), sid,
    size, start (word of the stream).
    slots: shard, sid, pass, block (of the source's stream), one row a slot.
    """

    mix: Mix
    sources: DataFrame
    documents: DataFrame
    slots: DataFrame


def _targets(sizes: DataFrame, mix: Mix) -> DataFrame:
    """Targets by weight with a ceiling: min(cap * size, level * weight), the level from sorted running sums."""
    rows = sizes.groupBy("source").agg(F.sum("size").alias("size"))
    rows = rows.withColumn("sid", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in mix.weights]), ((F.col("sid") - 1) % len(mix.weights) + 1).cast("int"))
    rows = rows.withColumn("weight", weight).withColumn("ceiling", F.col("size") * mix.cap)
    order = Window.orderBy(F.col("ceiling") / F.col("weight"), "sid")
    before, all_rows = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    spent, used = F.coalesce(F.sum("ceiling").over(before), F.lit(0.0)), F.coalesce(F.sum("weight").over(before), F.lit(0.0))
    level = (F.sum("size").over(all_rows) * mix.share - spent) / (F.sum("weight").over(all_rows) - used)
    rows = rows.withColumn("level", level)
    top = F.max("level").over(all_rows)  # levels rise up to the first source below its ceiling, then fall
    rows = rows.withColumn("target", F.least("ceiling", top * F.col("weight")))
    blocks = F.ceil(F.col("size") / mix.block_words).cast("long")
    slots = F.when(F.col("size") > 0, F.round(F.col("target") * blocks / F.col("size"))).otherwise(0).cast("long")
    return rows.select("sid", "source", "size", "target", blocks.alias("blocks"), slots.alias("slots"))


def _draws(sources: DataFrame, mix: Mix) -> DataFrame:
    """shard, sid, n: the slots that each shard draws from each source."""
    spark = sources.sparkSession
    total = sources.agg(F.sum("slots")).first()[0] or 0
    upto = F.sum("slots").over(Window.orderBy("sid"))
    edge = lambda slots: F.floor(slots / max(1, total) * UNIT).cast("long")
    guide = sources.where("slots > 0").select("sid", edge(upto - F.col("slots")).alias("lo"), edge(upto).alias("hi"))
    width = UNIT // BINS
    guide = guide.where("hi > lo").select("sid", "lo", "hi", F.explode(F.sequence(F.call_function("div", "lo", F.lit(width)), F.call_function("div", F.col("hi") - 1, F.lit(width)))).alias("bin"))
    slots = spark.range(total).select(F.call_function("div", "id", F.lit(mix.shard_slots)).alias("shard"), F.pmod(F.xxhash64("id", F.lit(mix.seed)), F.lit(UNIT)).alias("u"))
    slots = slots.withColumn("bin", F.call_function("div", "u", F.lit(width)))
    hits = slots.join(guide, "bin").where("u >= lo and u < hi")
    return hits.groupBy("shard", "sid").agg(F.count("*").alias("n"))


def _slots(sources: DataFrame, mix: Mix) -> DataFrame:
    """Draws, made to meet each source's slots: what is drawn beyond them goes to sources that lack some."""
    draws = stored(_draws(sources, mix), "mix-draws")
    placed = running_before(draws, ["sid"], "shard", "n", "first").join(sources.select("sid", "blocks", "slots"), "sid")
    within = F.greatest(F.lit(0).cast("long"), F.least("n", F.col("slots") - F.col("first")))
    placed = stored(placed.select("shard", "sid", "blocks", "first", within.alias("n"), (F.col("n") - within).alias("over")), "mix-placed")
    # units beyond a source's slots, by shard, meet as many units that sources lack, in a pseudorandom order
    over = running_before(placed.groupBy("shard").agg(F.sum("over").alias("over")), [], "shard", "over", "before")
    seats = over.where("over > 0").select("shard", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("over") - 1)).alias("unit"))
    units = placed.agg(F.sum("over")).first()[0] or 0
    drawn = placed.groupBy("sid").agg(F.sum("n").alias("drawn"))
    lack = sources.join(drawn, "sid", "left").select("sid", "blocks", F.coalesce("drawn", F.lit(0)).alias("drawn"), (F.col("slots") - F.coalesce("drawn", F.lit(0))).alias("lack"))
    lack = lack.withColumn("before", F.sum("lack").over(Window.orderBy("sid")) - F.col("lack")).where("lack > 0")
    claims = lack.select("sid", "blocks", "drawn", "before", F.explode(F.sequence(F.col("before"), F.col("before") + F.col("lack") - 1)).alias("at"))
    claims = claims.select("sid", "blocks", (F.col("drawn") + F.col("at") - F.col("before")).alias("k"), permute(F.col("at"), F.lit(max(1, units)).cast("long"), F.xxhash64(F.lit(mix.seed))).alias("unit"))
    dealt = claims.join(seats, "unit").select("shard", "sid", "blocks", "k")
    tasks = (sources.agg(F.sum("slots")).first()[0] or 0) // TASK_SLOTS + 1
    runs = placed.where("n > 0").repartition(tasks, "shard", "sid")
    each = runs.select("shard", "sid", "blocks", F.explode(F.sequence(F.col("first"), F.col("first") + F.col("n") - 1)).alias("k")).unionByName(dealt)
    passes = F.call_function("div", "k", F.col("blocks"))
    key = F.xxhash64("sid", passes, F.lit(mix.seed))
    return each.select("shard", "sid", passes.alias("pass"), permute(F.col("k") % F.col("blocks"), F.col("blocks"), key).alias("block"))


def mix_sources(docs: DataFrame, mix: Mix = Mix()) -> Mixture:
    """The mixture of all rows of docs(doc_id, text, source).

    A null or empty text has size 0 and is never taken. A null source is a source of its own, the last. Repeated rows
    and null doc_ids are rows like others; equal rows may swap places, which changes no result. An empty table gives
    empty tables. Other columns are left out. Reruns give the same mixture.
    """
    size = F.coalesce(F.regexp_count("text", F.lit(WORD)), F.lit(0)).cast("long")
    sizes = stored(docs.select("doc_id", "source", size.alias("size"), F.xxhash64("doc_id", "source", "text").alias("key")), "mix-sizes")
    sources = stored(_targets(sizes, mix), "mix-sources")
    buckets = sizes.count() // BUCKET_ROWS + 1
    rows = sizes.join(sources.select("sid", F.col("source").alias("of")), F.col("source").eqNullSafe(F.col("of"))).select("doc_id", "key", "sid", "size", F.pmod("key", F.lit(buckets)).alias("bucket"))
    sums = running_before(rows.groupBy("sid", "bucket").agg(F.sum("size").alias("in_bucket")), ["sid"], "bucket", "in_bucket", "base").drop("in_bucket")
    inner = F.sum("size").over(Window.partitionBy("sid", "bucket").orderBy("doc_id", "key").rowsBetween(Window.unboundedPreceding, Window.currentRow)) - F.col("size")
    placed = rows.withColumn("inner", inner).join(sums, ["sid", "bucket"])
    documents = placed.select("doc_id", "key", "sid", "size", (F.col("base") + F.col("inner")).alias("start"))
    return Mixture(mix, sources, documents, _slots(sources, mix))


def words_taken(mixture: Mixture) -> DataFrame:
    """doc_id, size, source_size, target, taken: blocks joined to slots by (source, block)."""
    length = mixture.mix.block_words
    block = lambda word: F.call_function("div", word, F.lit(length))
    end = F.col("start") + F.col("size")
    some = mixture.documents.drop("key").where("size > 0").withColumn("block", F.explode(F.sequence(block(F.col("start")), block(end - 1))))
    overlap = F.least(end, (F.col("block") + 1) * length) - F.greatest("start", F.col("block") * length)
    times = mixture.slots.groupBy("sid", "block").agg(F.count("*").alias("times"))
    parts = some.withColumn("overlap", overlap).join(times, ["sid", "block"], "left")
    taken = parts.groupBy("sid", "start", "doc_id", "size").agg(F.sum(F.col("overlap") * F.coalesce("times", F.lit(0))).alias("taken"))
    none = mixture.documents.where("size = 0").select("sid", "start", "doc_id", "size", F.lit(0).cast("long").alias("taken"))
    sources = mixture.sources.select("sid", F.col("size").alias("source_size"), "target")
    return taken.unionByName(none).join(sources, "sid").select("doc_id", "size", "source_size", "target", "taken")


def _numbered(rows: DataFrame, key: Column, *order: Column) -> DataFrame:
    """rows with _key and _nth, which tells equal rows apart."""
    keyed = rows.withColumn("_key", key)
    return keyed.withColumn("_nth", F.row_number().over(Window.partitionBy("_key").orderBy(*order)))


def block_texts(docs: DataFrame, mixture: Mixture) -> DataFrame:
    """shard, sid, pass, block, text: each slot with its block's words, joined by blanks. docs are the mixture's."""
    length = mixture.mix.block_words
    own = F.xxhash64("doc_id", "source", "text")
    words = _numbered(docs, own, F.lit(0)).select("_key", "_nth", F.regexp_extract_all("text", F.lit(f"({WORD})"), 1).alias("words")).where("size(words) > 0")
    pieces = _numbered(mixture.documents, F.col("key"), F.col("start")).join(words, ["_key", "_nth"])
    block = lambda word: F.call_function("div", word, F.lit(length))
    end = F.col("start") + F.col("size")
    pieces = pieces.withColumn("block", F.explode(F.sequence(block(F.col("start")), block(end - 1))))
    first = F.greatest("start", F.col("block") * length)
    upto = F.least(end, (F.col("block") + 1) * length)
    piece = F.slice("words", (first - F.col("start") + 1).cast("int"), (upto - first).cast("int"))
    texts = pieces.groupBy("sid", "block").agg(F.array_sort(F.collect_list(F.struct(first.alias("at"), F.array_join(piece, " ").alias("piece")))).alias("parts"))
    texts = texts.select("sid", "block", F.array_join(F.transform("parts", lambda p: p["piece"]), " ").alias("text"))
    return mixture.slots.join(texts, ["sid", "block"])


def passes_of(docs: DataFrame, mix: Mix = Mix()) -> DataFrame:
    """The mix as documents: a row of docs for each pass that takes words of it, its text cut to the words taken.

    All of a row's words in a pass leave its text as it is; else each piece keeps the white space after its words.
    Other columns stay as they are. Null doc_ids and repeated rows count as rows of their own.
    """
    mixture = mix_sources(docs, mix)
    length = mix.block_words
    block = lambda word: F.call_function("div", word, F.lit(length))
    end = F.col("start") + F.col("size")
    rows = _numbered(mixture.documents, F.col("key"), F.col("start")).where("size > 0")
    parts = rows.withColumn("block", F.explode(F.sequence(block(F.col("start")), block(end - 1)))).join(mixture.slots, ["sid", "block"])
    n = F.least(end, (F.col("block") + 1) * length) - F.greatest("start", F.col("block") * length)
    head, place = F.lit(length) - F.col("start") % length, (F.col("block") - block(F.col("start"))).cast("int")
    parts = parts.select("_key", "_nth", F.col("pass").alias("_pass"), F.col("size").alias("_size"), head.alias("_head"), n.alias("n"), place.alias("place"))
    passes = parts.groupBy("_key", "_nth", "_pass", "_size", "_head").agg(F.sum("n").alias("_taken"), F.array_sort(F.collect_list("place")).alias("_places"))
    numbered = _numbered(docs, F.xxhash64("doc_id", "source", "text"), F.lit(0))
    pattern = F.concat(F.lit(f"^{SPACE}*+{SPACED_WORDS}{{1,"), F.col("_head").cast("string"), F.lit(f"}}+|{SPACED_WORDS}{{1,{length}}}+"))
    pieces = F.regexp_extract_all("text", pattern, F.lit(0))  # by block: the first is what is left of the block it starts in
    cut = F.transform(F.array(pieces), lambda w: F.array_join(F.transform("_places", lambda i: F.get(w, i)), ""))  # found once
    taken = numbered.join(passes, ["_key", "_nth"]).withColumn("text", F.when(F.col("_taken") == F.col("_size"), F.col("text")).otherwise(cut[0]))
    return taken.select(docs.columns)
