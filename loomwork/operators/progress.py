"""Course progress checks and per-course totals."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Checks of a course without standards, and with them.
CHECKS, CHECKS_WITH_STANDARDS = 9, 10


def _has(rows: DataFrame, name: str) -> DataFrame:
    return rows.select("course_id").distinct().withColumn(name, F.lit(1))


def course_progress(t: dict[str, DataFrame]) -> DataFrame:
    """course_id, done, checks, percent, remaining (names of open checks) of each course.

    One point each for a description, topics, materials, CLOs, assessments and activities; up to two for alignment;
    one for the program map; one for standards, unless the course has no standard category (then there are nine).
    The map needs all pairs of a course in one program or none, and one pair less in several.
    """
    clos = t["learning_outcomes"].select("course_id", "l_outcome_id")
    aligned = lambda bridge, name: t[bridge].select("l_outcome_id").distinct().withColumn(name, F.lit(1))
    alignment = clos.join(aligned("outcome_assessments", "assessed"), "l_outcome_id", "left").join(aligned("outcome_activities", "active"), "l_outcome_id", "left")
    alignment = alignment.groupBy("course_id").agg(F.count("*").alias("clos"), F.max("assessed").alias("any_assessed"), F.max("active").alias("any_active"), F.max(F.when(F.col("assessed").isNull() | F.col("active").isNull(), 1)).alias("some_open"))
    plo_counts = t["program_learning_outcomes"].groupBy("program_id").agg(F.count("*").alias("plos"))
    owed = t["course_programs"].select("course_id", "program_id").join(plo_counts, "program_id", "left").groupBy("course_id").agg(F.count("*").alias("programs"), F.sum(F.coalesce("plos", F.lit(0))).alias("plos"))
    maps = t["outcome_maps"].join(clos, "l_outcome_id").groupBy("course_id").agg(F.count("*").alias("maps"))
    standards = t["standards"].groupBy("standard_category_id").agg(F.count("*").alias("standards"))
    standard_maps = t["standards_outcome_maps"].groupBy("course_id").agg(F.count("*").alias("standard_maps"))
    rows = t["courses"].select("course_id", "standard_category_id")
    parts = [("course_descriptions", "description"), ("course_topics", "topics"), ("course_materials", "materials"), ("assessment_methods", "assessments"), ("learning_activities", "activities")]
    described = t["course_descriptions"].where("course_description is not null and course_description <> ''")
    for table, name in parts:
        rows = rows.join(_has(described if name == "description" else t[table], name), "course_id", "left")
    for more, key in ((alignment, "course_id"), (owed, "course_id"), (maps, "course_id"), (standards, "standard_category_id"), (standard_maps, "course_id")):
        rows = rows.join(more, key, "left")
    n = lambda c: F.coalesce(c, F.lit(0))
    expected = F.when(n("programs") <= 1, 1).otherwise(0) + n("plos") * n("clos")
    mapped = (n("maps") >= F.when(expected == 1, 1).otherwise(expected - 1)).cast("int")
    points = {name: n(name) for _, name in parts} | {
        "outcomes": (n("clos") > 0).cast("int"),
        "alignment": F.when(F.col("any_assessed").isNull() & F.col("any_active").isNull(), 0).when(F.col("some_open") == 1, 1).otherwise(2),
        "program map": mapped,
        "standards": F.when(F.col("standard_category_id") == 0, 0).otherwise((n("standard_maps") == n("standards")).cast("int")),
    }
    done = sum(points.values(), F.lit(0))
    checks = F.when(F.col("standard_category_id") == 0, CHECKS).otherwise(CHECKS_WITH_STANDARDS)
    full = {"alignment": 2}
    open_ones = F.array_compact(F.array(*[F.when((p < full.get(k, 1)) & (F.lit(k != "standards") | (F.col("standard_category_id") != 0)), k) for k, p in sorted(points.items())]))
    return rows.select("course_id", done.alias("done"), checks.alias("checks"), F.floor((200 * done + checks) / (2 * checks)).alias("percent"), F.array_join(open_ones, ", ").alias("remaining"))


def weights(methods: DataFrame) -> DataFrame:
    """course_id, total weight and whether it is over 100."""
    return methods.groupBy("course_id").agg(F.sum("weight").alias("total")).withColumn("over", F.col("total") > 100)


def relative_time(seconds):
    """'3 days ago' from a difference in seconds."""
    out = F.lit("just now")
    for name, size in (("second", 1), ("minute", 60), ("hour", 3600), ("day", 86400), ("week", 7 * 86400), ("month", 30 * 86400), ("year", 365 * 86400)):
        n = F.floor(seconds / size)
        out = F.when(n >= 1, F.concat(n.cast("string"), F.lit(f" {name}"), F.when(n > 1, "s ago").otherwise(" ago"))).otherwise(out)
    return out
