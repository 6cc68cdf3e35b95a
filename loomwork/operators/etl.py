"""Writes as DataFrames: what a table holds after an import, a replacement or a decision. Keys make them idempotent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MAP_KEY = ["l_outcome_id", "pl_outcome_id", "map_scale_id"]
PAIR = MAP_KEY[:2]


def suggestions(results: DataFrame, clos: DataFrame, plos: DataFrame, scales: DataFrame) -> DataFrame:
    """Suggested maps of results (l_outcome_id, pl_outcome_id, is_mapped, labels) of completed jobs.

    Deleted outcomes go; unmapped pairs become N/A (0); each label becomes its level; unknown labels are skipped.
    """
    live = results.join(clos.select("l_outcome_id"), "l_outcome_id", "left_semi").join(plos.select("pl_outcome_id"), "pl_outcome_id", "left_semi")
    none = live.where(~F.coalesce("is_mapped", F.lit(False))).select(*PAIR, F.lit(0).cast("long").alias("map_scale_id"))
    labelled = live.where("is_mapped").select(*PAIR, F.explode("labels").alias("abbreviation")).join(scales.select("map_scale_id", "abbreviation"), "abbreviation")
    return none.unionByName(labelled.select(*MAP_KEY)).distinct()


def with_defaults(maps: DataFrame, suggested: DataFrame) -> DataFrame:
    """Manual maps, and the suggestions of pairs without any."""
    return maps.select(*MAP_KEY).unionByName(suggested.select(*MAP_KEY).join(maps.select(*PAIR).distinct(), PAIR, "left_anti"))


def replaced(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """rows with all those of new's keys exchanged for new's."""
    return rows.join(new.select(*key).distinct(), key, "left_anti").unionByName(new.select(rows.columns))


def upserted(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """One row a key: new's, else the old one."""
    order = Window.partitionBy(*key).orderBy(F.desc("_new"))
    both = rows.withColumn("_new", F.lit(0)).unionByName(new.select(rows.columns).withColumn("_new", F.lit(1)))
    return both.withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n", "_new")


def latest(rows: DataFrame, key: list[str], order: str) -> DataFrame:
    """key and the row with the largest order, as a struct's fields; ties go to the larger row."""
    rest = [c for c in rows.columns if c not in key]
    best = F.max(F.struct(order, *[c for c in rest if c != order])).alias("best")
    return rows.groupBy(*key).agg(best).select(*key, *[F.col(f"best.{c}").alias(c) for c in rest])


def kept_only(rows: DataFrame, wanted: DataFrame, key: list[str]) -> DataFrame:
    return rows.join(wanted.select(*key).distinct(), key, "left_semi")


def added(rows: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """rows and those of new whose key is not there yet."""
    return rows.unionByName(new.select(rows.columns).join(rows.select(*key).distinct(), key, "left_anti"))


def confirm_topics(topics: DataFrame, decided: DataFrame) -> DataFrame:
    """Topics after decisions (course_id, topic, confirm): new ones at the next positions, by topic; known ones once."""
    key = lambda c: F.lower(F.trim(c))
    known = topics.select("course_id", key("topic").alias("k")).distinct()
    new = decided.where("confirm").select("course_id", F.trim("topic").alias("topic"), key("topic").alias("k")).where("k <> ''")
    new = new.groupBy("course_id", "k").agg(F.min("topic").alias("topic")).join(known, ["course_id", "k"], "left_anti")
    last = topics.groupBy("course_id").agg(F.max("position").alias("last"))
    place = F.row_number().over(Window.partitionBy("course_id").orderBy("k"))
    new = new.join(last, "course_id", "left").select("course_id", "topic", (F.coalesce("last", F.lit(0)) + place).alias("position"))
    return topics.select("course_id", "topic", "position").unionByName(new)


REJECTED = 2


def decided(suggested: DataFrame, decisions: DataFrame, confirmed: int = 1) -> DataFrame:
    """Suggestions (course_id, topic, source, score, status) after decisions (course_id, topic, confirm) by topic.

    A confirmed one has status `confirmed`, a rejected one REJECTED, in any case of the topic; others stay as they are.
    Several decisions on a topic: it is confirmed if one says so.
    """
    said = decisions.groupBy(F.col("course_id").alias("_c"), F.lower(F.trim("topic")).alias("_k")).agg(F.bool_or("confirm").alias("_yes"))
    same = (F.col("course_id") == F.col("_c")) & (F.lower(F.trim("topic")) == F.col("_k"))
    status = F.when(F.col("_yes"), confirmed).when(~F.col("_yes"), REJECTED).otherwise(F.col("status"))
    return suggested.join(said, same, "left").withColumn("status", status).drop("_c", "_k", "_yes")


#: Sources whose suggestions an extraction makes anew (fixed values).
REFRESHED = ("keyword", "match")


def refreshable(suggested: DataFrame) -> DataFrame:
    """Suggestions that an extraction makes anew: not rejected, of a REFRESHED source."""
    return suggested.where((F.coalesce(F.col("status"), F.lit(0)) != REJECTED) & F.col("source").isin(*REFRESHED))


def extracted_topics(suggested: DataFrame, found: DataFrame, material: str = "course_material_id") -> DataFrame:
    """Suggestions of materials after an extraction found topics (material, topic, source, score).

    Refreshable ones of the materials in found go; of the found, blanks and those that are there already are skipped,
    in any case; of equal ones the best score stays.
    """
    again = found.select(material).distinct()
    held = suggested.join(again, material, "left_anti").unionByName(suggested.join(again, material, "left_semi").exceptAll(refreshable(suggested).join(again, material, "left_semi")))
    key = F.lower(F.trim("topic"))
    new = found.withColumn("_k", key).where("_k <> ''").groupBy(material, "_k").agg(F.max(F.struct("score", "topic", "source")).alias("m"))
    new = new.join(held.select(material, key.alias("_k")).distinct(), [material, "_k"], "left_anti")
    rows = new.select(material, F.trim("m.topic").alias("topic"), "m.source", "m.score", F.lit(0).alias("status"))
    return held.unionByName(rows.select(held.columns))


def pending_topics(suggested: DataFrame, topics: DataFrame, dropped: Column) -> DataFrame:
    """Suggestions still open: not rejected, of a source that lasts, not a topic of the course, best score first."""
    keys = topics.select("course_id", F.lower("topic").alias("k")).distinct()
    open_ones = suggested.where(~F.coalesce(dropped, F.lit(False))).withColumn("k", F.lower("topic"))
    rows = open_ones.join(keys, ["course_id", "k"], "left_anti")
    return rows.drop("k").withColumn("place", F.row_number().over(Window.partitionBy("course_id").orderBy(F.desc_nulls_last("score"), "topic")))


#: Ids that one task of an id map numbers, about.
ID_STEP = 65_536


def duplicate(rows: DataFrame, id_column: str, first_new: int, references: dict[str, DataFrame] | None = None) -> tuple[DataFrame, DataFrame]:
    """(copies with new ids, map of old to new). references: maps for other columns, as this returns them.

    New ids follow the old ones from first_new on. Ids are counted by ranges first and numbered within a range.
    """
    ids = rows.select(F.col(id_column).alias("old")).where("old is not null").distinct().withColumn("_range", F.call_function("div", "old", F.lit(ID_STEP)))
    counts = ids.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(Window.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_range").orderBy("old"))
    ids = ids.withColumn("_within", within).join(before, "_range").select("old", (F.col("_before") + F.col("_within") + (first_new - 1)).alias("new"))
    copied = rows.join(ids, rows[id_column] == ids["old"]).withColumn(id_column, F.col("new")).drop("old", "new")
    return remapped(copied, references or {}), ids


def remapped(rows: DataFrame, references: dict[str, DataFrame]) -> DataFrame:
    """rows whose columns are exchanged by id maps; ids without an entry stay as they are."""
    for column, ids in references.items():
        other = ids.select(F.col("old").alias("_old"), F.col("new").alias("_new"))
        rows = rows.join(other, rows[column] == other["_old"], "left").withColumn(column, F.coalesce("_new", column)).drop("_old", "_new")
    return rows


def scale_change(levels: DataFrame, maps: DataFrame, plos: DataFrame, program_id: int, scale_ids: list[int]) -> tuple[DataFrame, DataFrame]:
    """(levels, maps) after a program takes other scales: its maps go, the new scales follow each other from position 1."""
    spark = levels.sparkSession
    new = spark.createDataFrame([(s, program_id, i) for i, s in enumerate(scale_ids, 1)], "map_scale_id long, program_id long, position long")
    return levels.where(F.col("program_id") != program_id).unionByName(new.select(levels.columns)), without_program(maps, plos, program_id)


def without_program(maps: DataFrame, plos: DataFrame, program_id: int) -> DataFrame:
    """Maps, or suggestions, without those to outcomes of a program whose scales change."""
    gone = plos.where(F.col("program_id") == program_id).select("pl_outcome_id")
    return maps.join(gone, "pl_outcome_id", "left_anti")


def flags_reset(course_programs: DataFrame, program_id: int, flags: list[str]) -> DataFrame:
    """course_programs with a program's flags (how far its maps are) back at 0."""
    return course_programs.withColumns({f: F.when(F.col("program_id") == program_id, F.lit(0)).otherwise(F.col(f)) for f in flags})


def scales_appended(levels: DataFrame, program_id: int, scale_ids: list[int]) -> DataFrame:
    """levels with further scales of a program at its next positions; those it has stay where they are."""
    new = levels.sparkSession.createDataFrame([(s, program_id, i) for i, s in enumerate(scale_ids, 1)], "map_scale_id long, program_id long, place long")
    new = new.join(levels.select("map_scale_id", "program_id"), ["map_scale_id", "program_id"], "left_anti")
    last = levels.groupBy("program_id").agg(F.max("position").alias("last"))
    place = F.row_number().over(Window.partitionBy("program_id").orderBy("place"))
    new = new.withColumn("place", place).join(last, "program_id", "left").withColumn("position", F.coalesce("last", F.lit(0)) + F.col("place"))
    return levels.unionByName(new.select(levels.columns))


def reordered(rows: DataFrame, id_column: str, order: DataFrame) -> DataFrame:
    """Positions from a submitted list: order has ids, an array; others keep theirs."""
    places = order.select(F.posexplode("ids").alias("i", "id")).select(F.col("id").alias("_id"), (F.col("i") + 1).alias("_at"))
    return rows.join(places, rows[id_column] == places["_id"], "left").withColumn("position", F.coalesce("_at", "position")).drop("_id", "_at")


def topic_list(topics: DataFrame, submitted: DataFrame) -> DataFrame:
    """A course's topics after a submitted list (course_id, course_topic_id or null, topic, index): blanks go."""
    named = submitted.where(F.trim("topic") != "")
    known = named.join(topics.select("course_id", "course_topic_id"), ["course_id", "course_topic_id"], "left_semi")
    new = named.where("course_topic_id is null")
    return known.unionByName(new).select("course_id", "course_topic_id", F.trim("topic").alias("topic"), (F.col("index") + 1).alias("position"))


def oldest_pending(jobs: DataFrame, before: Column) -> DataFrame:
    return jobs.where((F.col("status") == "PENDING") & (F.col("created_at") < before)).orderBy("created_at", "request_id").limit(1)


def in_flight(jobs: DataFrame, statuses: list[str]) -> DataFrame:
    """The newest unfinished job of each course and program."""
    return latest(jobs.where(F.col("status").isin(statuses)), ["course_id", "program_id"], "created_at")


def job_states(finished: DataFrame) -> DataFrame:
    """status after a batch job ended: only terminal states change anything."""
    state = F.col("job_status")
    after = F.when(state == "Completed", "AWAITING").when(state.isin("Failed", "Stopped"), "AWAITING_FAILED").otherwise(F.col("status"))
    return finished.withColumn("status", after)


def pair_status(pairs: DataFrame, results: DataFrame) -> DataFrame:
    """pairs with done, false where no result came."""
    return pairs.join(results.select(*PAIR, "done"), PAIR, "left").withColumn("done", F.coalesce("done", F.lit(False)))


def program_duplicate_ids(plos: DataFrame, program_id: int, new_program_id: int, first_new: int) -> DataFrame:
    """Outcomes of a program copied into another."""
    copied, _ = duplicate(plos.where(F.col("program_id") == program_id), "pl_outcome_id", first_new)
    return copied.withColumn("program_id", F.lit(new_program_id).cast("long"))


def program_copied(program_id: int, new_program_id: int, plos: DataFrame, categories: DataFrame, levels: DataFrame, scales: DataFrame, *, custom: Column, first: dict[str, int]) -> dict[str, DataFrame]:
    """The rows that a copy of a program adds: outcomes, their categories, configured levels, and its custom scales.

    Categories (those its outcomes use) and scales for which `custom` is true get new ids from first["plo_category_id"]
    and first["map_scale_id"] on, outcomes from first["pl_outcome_id"]; shared scales are only linked to the copy. Maps
    are not copied.
    """
    own = plos.where(F.col("program_id") == program_id)
    used = categories.join(own.select("plo_category_id"), "plo_category_id", "left_semi")
    new_categories, category_ids = duplicate(used, "plo_category_id", first["plo_category_id"])
    new_plos, _ = duplicate(own, "pl_outcome_id", first["pl_outcome_id"], {"plo_category_id": category_ids})
    linked = levels.where(F.col("program_id") == program_id)
    new_scales, scale_ids = duplicate(scales.where(custom).join(linked.select("map_scale_id"), "map_scale_id", "left_semi"), "map_scale_id", first["map_scale_id"])
    to_copy = lambda df: df.withColumn("program_id", F.lit(new_program_id).cast("long"))
    return {"p_l_o_categories": new_categories, "program_learning_outcomes": to_copy(new_plos), "mapping_scales": new_scales, "mapping_scale_programs": to_copy(remapped(linked, {"map_scale_id": scale_ids}))}


def course_copied(course_id: int, new_course_id: int, tables: dict[str, DataFrame], first: dict[str, int]) -> dict[str, DataFrame]:
    """The rows that a copy of a course adds: outcomes, methods, activities and the alignment between them.

    tables and first by name: learning_outcomes, assessment_methods, learning_activities; tables also
    outcome_assessments and outcome_activities, whose ids on both sides become the copies'.
    """
    keys = {"learning_outcomes": "l_outcome_id", "assessment_methods": "a_method_id", "learning_activities": "l_activity_id"}
    out, ids = {}, {}
    for name, key in keys.items():
        copied, ids[key] = duplicate(tables[name].where(F.col("course_id") == course_id), key, first[name])
        out[name] = copied.withColumn("course_id", F.lit(new_course_id).cast("long"))
    for name, key in (("outcome_assessments", "a_method_id"), ("outcome_activities", "l_activity_id")):
        own = tables[name].join(ids["l_outcome_id"].select(F.col("old").alias("l_outcome_id")), "l_outcome_id", "left_semi")
        out[name] = remapped(own, {"l_outcome_id": ids["l_outcome_id"], key: ids[key]})
    return out


def job_of(jobs: DataFrame, names: DataFrame) -> DataFrame:
    """jobs with their end (job_name, job_status) in names, found by job_name; jobs without an end have none."""
    return jobs.join(names.select("job_name", "job_status"), "job_name", "left")


def next_started(jobs: DataFrame, before: Column) -> DataFrame:
    """jobs, the oldest pending one of which runs now, if none does."""
    free = jobs.where("status = 'RUNNING'").limit(1).agg(F.count("*").alias("_busy"))
    first = oldest_pending(jobs, before).select(F.col("request_id").alias("_first")).join(free, F.lit(True)).where("_busy = 0")
    out = jobs.join(first.select("_first"), F.col("request_id") == F.col("_first"), "left")
    return out.withColumn("status", F.when(F.col("_first").isNotNull(), "RUNNING").otherwise(F.col("status"))).drop("_first")
