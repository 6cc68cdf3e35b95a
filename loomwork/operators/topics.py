"""Topics of documents: matched terms, titles and headings by font, cleaning, and the filters after extraction."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions.english import STOP_WORDS
from loomwork.functions.text import let

MAX_TITLE_WORDS, HEADING_SIZE, MAX_TOPIC_WORDS = 15, 10.0, 8
MIN_WINDOW, WINDOW_STEP = 20, 0.75
TOPICS, WORDS_PER_CLUSTER = 20, 10
#: An address with an image after a sentence's end, links up to their last word character, and names of image kinds
#: (fixed patterns, stated as they must match).
LINK_TO_IMAGE = r"(?:http|https|www):.*?/.*?\. .*(?:jpg|jpeg|png|gif|bmp|svg|webp)"
LINK = r"\b(?:http|https|www)\S*\b"
IMAGE_NAME = r"\b(?:jpg|jpeg|png|gif|bmp|svg|webp)\b"
#: Parts that make a topic an address or a file (fixed values).
URL_WORDS, URL_PARTS = ("com", "org"), ("http", "jpg", "png", "www")


def clean_text(text: Column) -> Column:
    """Without links, what leads from one to an image on its line, and names of image kinds."""
    for pattern in (LINK_TO_IMAGE, LINK, IMAGE_NAME):
        text = F.regexp_replace(text, pattern, "")
    return text


def slide_text(text: Column) -> Column:
    """Lines end in a period, bullets go."""
    return F.regexp_replace(F.regexp_replace(clean_text(text), r"(?<![.!?])\n", ". \n"), r"(?<=\n)[•-]\s+", "")


def before_references(text: Column) -> Column:
    """What stands before the last 'References' or 'Citations'."""
    head = F.regexp_extract(text, r"(?s)^(.*)\b(?:Citations|References)\b", 1)
    return F.when(text.rlike(r"\b(?:Citations|References)\b"), head).otherwise(text)


def times_found(text: Column, topic: Column) -> Column:
    """How often a topic stands in the text as whole words, in any case."""
    quoted = F.concat(F.lit(r"(?iu)\b\Q"), F.replace(topic, F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E\b"))
    return F.regexp_count(text, quoted)


def matched(documents: DataFrame, topics: DataFrame, least: int = 1) -> DataFrame:
    """document_id, topic of the course's known topics that the document holds `least` times."""
    rows = documents.select("document_id", "course_id", "text").join(topics.select("course_id", "topic"), "course_id")
    return rows.where(F.lower("text").contains(F.lower("topic"))).where(times_found(F.col("text"), F.col("topic")) >= least).select("document_id", "topic")


def lines_of(pages: DataFrame) -> DataFrame:
    """document_id, page_number, line, text, size, bold of non-blank lines."""
    rows = pages.select("document_id", "page_number", F.posexplode("lines").alias("line", "l"))
    return rows.select("document_id", "page_number", "line", F.trim("l.text").alias("text"), F.col("l.size").alias("size"), F.col("l.bold").alias("bold")).where("text <> ''")


def titles(pages: DataFrame) -> DataFrame:
    """The line in the largest font of each page, the first of equals, if it is short enough."""
    order = Window.partitionBy("document_id", "page_number").orderBy(F.desc(F.coalesce("size", F.lit(0.0))), "line")
    rows = lines_of(pages).withColumn("n", F.row_number().over(order)).where("n = 1")
    return rows.where(F.size(F.split("text", r"\s+")) <= MAX_TITLE_WORDS).select("document_id", "page_number", "text")


def headings(pages: DataFrame) -> DataFrame:
    """Lines of a large font that are bold, or of which that is unknown."""
    big = (F.coalesce("size", F.lit(0.0)) >= HEADING_SIZE) & F.coalesce("bold", F.lit(True))
    return lines_of(pages).where(big).select("document_id", "page_number", "line", "text")


def first_seen(rows: DataFrame, key: list[str], text: str, order: list[str]) -> DataFrame:
    """One row for each key and text in any case: the first in order. Blank texts go."""
    named = rows.withColumn("_k", F.lower(F.trim(text))).where("_k <> ''")
    return named.withColumn("_n", F.row_number().over(Window.partitionBy(*key, "_k").orderBy(*order))).where("_n = 1").drop("_n", "_k")


def united(lists: list[DataFrame], key: list[str]) -> DataFrame:
    """topic, score, source of several lists; of equal topics the earlier list's stays."""
    rows = None
    for i, part in enumerate(lists):
        part = part.select(*key, "topic", "score", "source").withColumn("_list", F.lit(i))
        rows = part if rows is None else rows.unionByName(part)
    return first_seen(rows, key, "topic", ["_list", "topic"]).drop("_list")


def windows(text: Column) -> Column:
    """Overlapping windows of words: as many words as the root of their number, MIN_WINDOW at least."""
    size = lambda words: F.greatest(F.lit(MIN_WINDOW), F.bround(F.sqrt(F.size(words))).cast("int"))
    step = lambda size: F.greatest(F.lit(1), F.bround(size * WINDOW_STEP).cast("int"))
    starts = lambda words, size: F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(words)), step(size))
    cut = lambda words, size: F.transform(starts(words, size), lambda i: F.array_join(F.slice(words, i, size), " "))
    some = lambda words: F.when(F.size(words) > 0, let(size(words), lambda n: cut(words, n))).otherwise(F.array().cast("array<string>"))
    return let(F.filter(F.split(text, r"\s+"), lambda w: w != ""), some)


def filtered(topics: DataFrame, key: list[str], *, least_chars: int = 5, threshold: float = 0.5, cased: bool = False, ends_well: Callable[[Column], Column] | None = None, stop_words: Iterable[str] = STOP_WORDS) -> DataFrame:
    """Topics (key, topic, score, source) that pass all filters.

    One to MAX_TOPIC_WORDS words; a single word long enough (and, if cased, capitalised); each once in any case; not
    all digits; no address; ends_well says whether the last word may end a topic (a tagger's job, so the caller's);
    none of stop_words (the caller's tagger has its own) at either end; not within another topic unless it was matched; a score of `threshold` or more.
    """
    topic = F.col("topic")
    words = F.split(F.trim(topic), r"\s+")
    low = F.transform(words, F.lower)
    n = F.size(words)
    capital = (topic == F.initcap(topic)) | (topic == F.upper(topic))
    single = (F.length(F.trim(topic)) >= least_chars) & (capital if cased else F.lit(True))
    rows = topics.where((F.trim(topic) != "") & (n <= MAX_TOPIC_WORDS) & ((n > 1) | single))
    rows = first_seen(rows, key, "topic", [F.desc("score"), F.col("topic")])
    whole = rows.select(*key, F.lower("topic").alias("_whole"))
    rows = rows.where(~topic.rlike(r"^[\d\s]+$")).where(~F.arrays_overlap(low, F.array(*map(F.lit, URL_WORDS))))
    for part in URL_PARTS:
        rows = rows.where(~F.lower(topic).contains(part))
    if ends_well is not None:
        rows = rows.where(ends_well(topic))
    stops = F.array(*[F.lit(w) for w in sorted(stop_words)])
    rows = rows.where((n == 1) | ~(F.array_contains(stops, F.element_at(low, 1)) | F.array_contains(stops, F.element_at(low, -1))))
    inside = contained(rows.where("source <> 'match'").select(*key, "topic"), whole, key)
    return rows.join(inside, [*key, "topic"], "left_anti").where(F.col("score") >= threshold)


#: Characters that a topic and the one that it stands in must share, to meet; and texts of a key that all meet.
GRAM, FEW_TEXTS = 4, 100


def contained(topics: DataFrame, whole: DataFrame, key: list[str]) -> DataFrame:
    """key, topic of topics that stand within another text (key, _whole, lower-case) of their key, in any case.

    In a key of at most FEW_TEXTS texts, each topic meets all of them. In a larger one a topic meets the texts that
    hold the run of GRAM characters of its own that fewest texts hold; topics shorter than that meet all.
    """
    low = topics.withColumn("_low", F.lower("topic"))
    sizes = whole.groupBy(*key).agg(F.count("*").alias("_texts"))
    counted = whole.join(sizes, key)
    few, many = counted.where(F.col("_texts") <= FEW_TEXTS), counted.where(F.col("_texts") > FEW_TEXTS)
    runs = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(c) - (GRAM - 1)), lambda i: F.substring(F.col(c), i, F.lit(GRAM))))
    grams = many.where(F.length("_whole") >= GRAM).select(*key, "_whole", F.explode(runs("_whole")).alias("_gram"))
    held = grams.groupBy(*key, "_gram").agg(F.count("*").alias("_n"))
    long = low.join(sizes.where(F.col("_texts") > FEW_TEXTS), key, "left_semi").where(F.length("_low") >= GRAM)
    rarest = F.min_by("_gram", F.struct(F.coalesce("_n", F.lit(0)), "_gram")).alias("_gram")
    asked = long.select(*key, "topic", "_low", F.explode(runs("_low")).alias("_gram")).join(held, [*key, "_gram"], "left").groupBy(*key, "topic", "_low").agg(rarest)
    likely = asked.join(grams, [*key, "_gram"]).select(*key, "topic", "_low", "_whole")
    plain = low.join(few, key).unionByName(low.where(F.length("_low") < GRAM).join(many, key)).select(*key, "topic", "_low", "_whole")
    both = plain.unionByName(likely).where((F.col("_low") != F.col("_whole")) & F.col("_whole").contains(F.col("_low")))
    return both.select(*key, "topic").distinct()


def top_topics(topics: DataFrame, key: list[str], limit: int = TOPICS) -> DataFrame:
    place = F.row_number().over(Window.partitionBy(*key).orderBy(F.desc("score"), "topic"))
    return topics.withColumn("place", place).where(F.col("place") <= limit)


#: Extraction by kind of material: how text is cleaned, how often a known topic must stand in it.
HANDLERS: dict[str, tuple[Callable[[Column], Column], int]] = {"slides": (slide_text, 1), "article": (lambda t: before_references(clean_text(t)), 2)}


def extracted(documents: DataFrame, topics: DataFrame) -> DataFrame:
    """Matched topics of documents (document_id, course_id, material_type, text), each kind by its handler."""
    kinds = F.lower(F.coalesce("material_type", F.lit("")))
    other = documents.where(~kinds.isin(list(HANDLERS)))
    out = matched(other.withColumn("text", clean_text(F.col("text"))), topics)
    for kind, (clean, least) in HANDLERS.items():
        out = out.unionByName(matched(documents.where(kinds == kind).withColumn("text", clean(F.col("text"))), topics, least))
    return out
