"""Cognitive levels of learning outcomes, and how they spread over course levels."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Neither side of a whole term: letters, marks, digits, underscore.
_EDGE = r"[\p{L}\p{M}\p{N}_]"
#: A CLO with this many levels or more is worth a second look.
REVIEW_LEVELS = 3


def holds_term(lowered: Column, term: str) -> Column:
    """Whether lower-case text holds a lower-case term whole, as literal text between Unicode word edges.

    A blank of the term stands for any white space of the text. The literal stands first in the pattern and its words
    are looked for on their own before, which spares most texts the edges.
    """
    words = term.split()
    literal = re.escape(term)
    edged = f"{literal}(?<!{_EDGE}{literal})(?!{_EDGE})"
    if len(words) > 1:
        edged = f"(?<!{_EDGE}){r'(?U:\s+)'.join(map(re.escape, words))}(?!{_EDGE})"
    held = lowered.rlike(edged)
    for word in sorted(set(words), key=len):
        held = lowered.contains(word) & held
    return held


#: As many terms become literals of one expression; more are joined with the words of the texts.
LITERAL_TERMS = 2000


def squeezed(text: Column) -> Column:
    """Runs of white space as one blank, none at the ends."""
    return F.trim(F.regexp_replace(text, r"(?U)\s+", " "))


def clean_verbs(verbs: DataFrame) -> DataFrame:
    """level_id, verb, low, place: blanks gone, one spelling for each level and lower-case term, the first by place.

    verbs without a column place go by their spelling, so the least one stays.
    """
    place = F.col("place") if "place" in verbs.columns else F.lit(0).cast("long")
    trimmed = verbs.select("level_id", squeezed(F.col("verb")).alias("verb"), place.alias("place")).where("verb <> ''")
    first = F.min(F.struct("place", "verb"))
    return trimmed.groupBy("level_id", F.lower("verb").alias("low")).agg(first.alias("f")).select("level_id", "f.verb", "low", "f.place")


MATCHES = "array<struct<level_id:bigint,verb:string>>"


def classify(clos: DataFrame, verbs: DataFrame, levels: DataFrame | None = None) -> DataFrame:
    """clos with matches, by the level's position and the term's place; null if the reference is empty.

    White space of terms is collapsed first, and a blank of theirs stands for any white space, so a term may stand over
    a line break. levels (level_id, position) orders the levels; without it they go by id. Up to LITERAL_TERMS terms
    become literals that look at one lower-case copy of a text, and no row is multiplied by the terms; more of them
    meet the texts by their first word.
    """
    order = ["position", "level_id", "place", "low"]
    terms = clean_verbs(verbs)
    terms = terms.withColumn("position", F.col("level_id")) if levels is None else terms.join(levels.select("level_id", "position"), "level_id")
    kind, some = MATCHES, terms.orderBy(*order).limit(LITERAL_TERMS + 1).collect()
    if not some:
        return clos.withColumn("matches", F.lit(None).cast(kind))
    if len(some) > LITERAL_TERMS:
        return _joined(clos, terms, order)
    one = lambda low, t: F.when(holds_term(low, t.low), F.struct(F.lit(t.level_id).cast("long").alias("level_id"), F.lit(t.verb).alias("verb")))
    every = lambda low: F.filter(F.array(*[one(low, t) for t in some]), lambda m: m.isNotNull())
    held = F.transform(F.array(F.lower("l_outcome")), every)[0]  # made once a row, however many terms ask
    return clos.withColumn("matches", F.coalesce(F.when(F.col("l_outcome").isNotNull(), held), F.array().cast(kind)))


def _joined(clos: DataFrame, terms: DataFrame, order: list[str]) -> DataFrame:
    """classify() for many terms: distinct texts and terms join on the term's first word ('' if it has none)."""
    words = lambda text: F.filter(F.split(text, rf"(?:(?!{_EDGE}).)+"), lambda w: w != "")
    low = F.lower(squeezed(F.col("l_outcome")))
    texts = clos.select(low.alias("_low")).where("_low is not null").distinct()
    texts = texts.select("_low", F.explode(F.array_union(F.array(F.lit("")), words(F.col("_low")))).alias("_word"))
    keyed = terms.withColumn("_word", F.coalesce(F.get(words(F.col("low")), F.lit(0)), F.lit("")))
    literal = F.concat(F.lit(r"\Q"), F.replace("low", F.lit(r"\E"), F.lit(r"\E\\E\Q")), F.lit(r"\E"))
    pattern = F.concat(F.lit(f"(?<!{_EDGE})"), literal, F.lit(f"(?!{_EDGE})"))
    hits = texts.join(keyed, "_word").where(F.contains("_low", "low")).where(F.regexp_like("_low", pattern))
    found = hits.groupBy("_low").agg(F.array_sort(F.collect_list(F.struct(*order, "verb"))).alias("_hits"))
    matches = F.transform("_hits", lambda h: F.struct(h["level_id"].cast("long").alias("level_id"), h["verb"].alias("verb")))
    out = clos.withColumn("_low", low).join(found, "_low", "left")
    return out.withColumn("matches", F.coalesce(matches, F.array().cast(MATCHES))).select(*clos.columns, "matches")


def course_level(course_num: Column) -> Column:
    """Hundred of a three-digit number with letters or none after it; other numbers and none: 'other'."""
    fits = course_num.rlike("(?i)^[1-9][0-9]{2}[a-z]*$")
    return F.when(fits, F.concat(F.substring(course_num, 1, 1), F.lit("00"))).otherwise("other")


def simple_level(course_num: Column) -> Column:
    """'100 Level' to '600 Level' by the first character, else 'Other'."""
    first = F.substring(course_num, 1, 1)
    return F.when(first.between("1", "6"), F.concat(first, F.lit("00 Level"))).otherwise("Other")


def percent(n: Column, d: Column) -> Column:
    """n / d in percent with two places, half up, from integers only; null where d is 0."""
    return F.when(d > 0, F.floor((20000 * n + d) / (2 * d)).cast("double") / 100)


def scope(courses: DataFrame, course_programs: DataFrame, clos: DataFrame) -> DataFrame:
    """program_id, course_id, level, l_outcome_id, matches: a program's courses; one row of nulls without CLOs."""
    rows = course_programs.select("program_id", "course_id").join(courses.select("course_id", course_level(F.col("course_num")).alias("level")), "course_id")
    return rows.join(clos.select("course_id", "l_outcome_id", "matches"), "course_id", "left")


def narrowed(rows: DataFrame, maps: DataFrame, levels: DataFrame, pl_outcome_id: int, program_id: int) -> DataFrame:
    """Rows of one program whose CLO maps to the outcome at a configured level; courses left empty are gone."""
    configured = levels.where((F.col("program_id") == program_id) & (F.col("map_scale_id") != 0)).select("map_scale_id")
    chosen = maps.where(F.col("pl_outcome_id") == pl_outcome_id).join(configured, "map_scale_id", "left_semi").select("l_outcome_id").distinct()
    return rows.where(F.col("program_id") == program_id).join(chosen, "l_outcome_id", "left_semi")


def group_totals(rows: DataFrame, available: bool) -> DataFrame:
    """Of each course level: courses, CLOs, matched and unmatched CLOs (null without a reference)."""
    known = F.lit(available)
    hit = F.size("matches") > 0
    out = rows.groupBy("program_id", "level").agg(F.count_distinct("course_id").alias("course_count"), F.count_distinct("l_outcome_id").alias("clo_count"), F.count_distinct(F.when(hit, F.col("l_outcome_id"))).alias("matched"))
    return out.withColumns({"matched": F.when(known, F.col("matched")), "unmatched": F.when(known, F.col("clo_count") - F.col("matched"))})


def distributions(rows: DataFrame, bloom_levels: DataFrame, available: bool = True) -> DataFrame:
    """CLOs of each course level at each cognitive level, zeros too, and their share of the group's CLOs."""
    groups = group_totals(rows, available).select("program_id", "level", "clo_count")
    hits = rows.select("program_id", "level", "l_outcome_id", F.explode(F.array_distinct(F.transform("matches", lambda m: m["level_id"]))).alias("level_id"))
    counts = hits.groupBy("program_id", "level", "level_id").agg(F.count_distinct("l_outcome_id").alias("n"))
    grid = groups.crossJoin(F.broadcast(bloom_levels.select("level_id", "position")))  # groups x reference levels, both small
    out = grid.join(counts, ["program_id", "level", "level_id"], "left")
    n = F.when(F.lit(available), F.coalesce("n", F.lit(0)))
    return out.select("program_id", "level", "level_id", "position", n.alias("matched_clos"), percent(n, F.col("clo_count")).alias("percentage"))


def cognitive_summary(rows: DataFrame, bloom_levels: DataFrame) -> DataFrame:
    """Of each program and cognitive level: distinct CLOs, their share of all CLOs, contributing courses."""
    totals = rows.groupBy("program_id").agg(F.count_distinct("l_outcome_id").alias("clo_count"))
    hits = rows.select("program_id", "course_id", "l_outcome_id", F.explode(F.transform("matches", lambda m: m["level_id"])).alias("level_id"))
    counts = hits.groupBy("program_id", "level_id").agg(F.count_distinct("l_outcome_id").alias("n"), F.array_sort(F.collect_set("course_id")).alias("courses"))
    grid = totals.crossJoin(F.broadcast(bloom_levels.select("level_id", "name")))
    out = grid.join(counts, ["program_id", "level_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
    return out.select("program_id", "level_id", "name", F.col("n").alias("clo_count"), percent(F.col("n"), F.col("clo_count")).alias("percentage"), F.coalesce("courses", F.array().cast("array<bigint>")).alias("courses"))


def review_suggested(clos: DataFrame) -> DataFrame:
    """clos with levels (distinct) and review, true from REVIEW_LEVELS levels on."""
    levels = F.size(F.array_distinct(F.transform("matches", lambda m: m["level_id"])))
    return clos.withColumn("levels", levels).withColumn("review", F.col("levels") >= REVIEW_LEVELS)


def in_order(groups: DataFrame) -> DataFrame:
    """Course levels with their place: ascending, 'other' last."""
    order = Window.partitionBy("program_id").orderBy(F.when(F.col("level") == "other", 1).otherwise(0), "level")
    return groups.withColumn("place", F.row_number().over(order))
