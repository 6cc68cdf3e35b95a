"""Gap and redundancy coverage of program outcomes, for all programs at once.

Inputs are the star's tables by role. A mapping counts as coverage if its course is in the outcome's program and its
level is configured there and not N/A (id 0); completeness counts every decision, N/A too. course_required has three
values: unknown counts as neither required nor not.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwork.operators.blocks import evenly

METRICS = ("mapped_clo_count", "covering_course_count", "required_course_count", "non_required_course_count")


def program_totals(course_programs: DataFrame, courses: DataFrame, clos: DataFrame) -> DataFrame:
    """program_id, course_count, clo_count: distinct courses, empty ones too, and distinct CLOs."""
    rows = course_programs.join(courses.select("course_id"), "course_id").join(clos.select("course_id", "l_outcome_id"), "course_id", "left")
    return rows.groupBy("program_id").agg(F.count_distinct("course_id").alias("course_count"), F.count_distinct("l_outcome_id").alias("clo_count"))


def clos_per_course(courses: DataFrame, clos: DataFrame) -> DataFrame:
    """course_id, clo_count, zero for courses without CLOs."""
    counts = clos.groupBy("course_id").agg(F.count_distinct("l_outcome_id").alias("clo_count"))
    return courses.select("course_id").join(counts, "course_id", "left").withColumn("clo_count", F.coalesce("clo_count", F.lit(0)))


def mapping_decisions(course_programs: DataFrame, clos: DataFrame, plos: DataFrame, maps: DataFrame) -> DataFrame:
    """program_id, course_id, decisions: pairs with any level at all; several levels of a pair count once."""
    pairs = maps.select("l_outcome_id", "pl_outcome_id").distinct()
    pairs = pairs.join(clos.select("l_outcome_id", "course_id"), "l_outcome_id").join(plos.select("pl_outcome_id", "program_id"), "pl_outcome_id")
    return evenly(pairs, course_programs.select("course_id", "program_id"), ["course_id", "program_id"]).groupBy("program_id", "course_id").agg(F.count("*").alias("decisions"))


def mapping_completeness(course_programs: DataFrame, courses: DataFrame, clos: DataFrame, plos: DataFrame, maps: DataFrame) -> DataFrame:
    """A row for each program and course: expected, actual and missing mapping decisions, is_complete.

    Expected is CLOs times PLOs; a course without CLOs still owes one decision for each PLO. Nothing is multiplied
    out: the product is of two counts.
    """
    plo_counts = plos.groupBy("program_id").agg(F.count("*").alias("plos"))
    rows = course_programs.select("program_id", "course_id").join(clos_per_course(courses, clos), "course_id").join(plo_counts, "program_id", "left")
    rows = rows.join(mapping_decisions(course_programs, clos, plos, maps), ["program_id", "course_id"], "left")
    owed = F.coalesce("plos", F.lit(0))
    expected = F.when(F.col("clo_count") == 0, owed).otherwise(F.col("clo_count") * owed)
    rows = rows.select("program_id", "course_id", "clo_count", expected.alias("expected"), F.coalesce("decisions", F.lit(0)).alias("actual"))
    return rows.withColumns({"missing": F.greatest(F.lit(0), F.col("expected") - F.col("actual")), "is_complete": F.col("expected") == F.col("actual")})


def mapping_facts(plos: DataFrame, maps: DataFrame, clos: DataFrame, course_programs: DataFrame, levels: DataFrame) -> DataFrame:
    """A row for each mapping of each PLO, with `covered`; PLOs without mappings keep one row of nulls."""
    in_program = course_programs.select("program_id", "course_id", F.lit(True).alias("current"), "course_required")
    configured = levels.where("map_scale_id <> 0").select("program_id", "map_scale_id", F.lit(True).alias("configured"))
    rows = plos.select("program_id", "pl_outcome_id").join(maps, "pl_outcome_id", "left").join(clos.select("l_outcome_id", "course_id"), "l_outcome_id", "left")
    rows = evenly(rows, in_program, ["program_id", "course_id"], "left").join(configured, ["program_id", "map_scale_id"], "left")
    return rows.withColumn("current", F.coalesce("current", F.lit(False))).withColumn("covered", F.col("current") & F.coalesce("configured", F.lit(False)))


def _counted(facts: DataFrame, keys: list[str]) -> DataFrame:
    """keys with METRICS, n_a_clo_count and multi_level_mapping_count, by sums over courses of sums over CLOs.

    A CLO is one course's, so sums of distinct CLOs of courses count each CLO once, and no fact is expanded for any of
    the counts. A CLO has several levels if the least and the largest that cover it differ.
    """
    covered, level = F.col("covered"), F.when(F.col("covered"), F.col("map_scale_id"))
    any_of = lambda c: F.coalesce(F.bool_or(c), F.lit(False))
    clos = facts.groupBy(*keys, "course_id", "l_outcome_id").agg(
        any_of(covered).alias("covered"), any_of(covered & (F.col("course_required") == 1)).alias("required"), any_of(covered & (F.col("course_required") == 0)).alias("other"),
        any_of(F.col("current") & (F.col("map_scale_id") == 0)).alias("n_a"), F.coalesce(F.min(level) < F.max(level), F.lit(False)).alias("several"),
    )
    count = lambda c: F.count_if(F.col(c)).alias(c)
    courses = clos.groupBy(*keys, "course_id").agg(*[count(c) for c in ("covered", "required", "other", "n_a", "several")])
    some = lambda c, name: F.count_if(F.col(c) > 0).alias(name)
    total = lambda c, name: F.sum(c).alias(name)
    return courses.groupBy(*keys).agg(total("covered", METRICS[0]), some("covered", METRICS[1]), some("required", METRICS[2]), some("other", METRICS[3]), total("n_a", "n_a_clo_count"), total("several", "multi_level_mapping_count"))


def plo_coverage(facts: DataFrame, plos: DataFrame | None = None) -> DataFrame:
    """Distinct CLOs and courses that cover each PLO, CLOs mapped as N/A, and CLOs mapped at several levels.

    Only facts of current courses count, so no others are grouped. plos: the PLOs of the facts, where they are at hand.
    """
    keys = ["program_id", "pl_outcome_id"]
    every = (facts if plos is None else plos).select(*keys).distinct()
    counts = _counted(facts.where("current and l_outcome_id is not null"), keys)  # so outer joins become inner ones
    return every.join(counts, keys, "left").na.fill(0, counts.columns[len(keys) :])


def histogram(plos: DataFrame, levels: DataFrame, facts: DataFrame) -> DataFrame:
    """METRICS of each PLO and configured level of its program, zeros too, with the level's position."""
    grid = plos.select("program_id", "pl_outcome_id").join(levels.where("map_scale_id <> 0").select("program_id", "map_scale_id", "position"), "program_id")
    keys = ["program_id", "pl_outcome_id", "map_scale_id"]
    counts = _counted(facts.where("covered and l_outcome_id is not null"), keys).select(*keys, *METRICS)
    return grid.join(counts, keys, "left").na.fill(0, list(METRICS))


def distribution(hist: DataFrame) -> DataFrame:
    return hist.where("mapped_clo_count > 0").select("program_id", "pl_outcome_id", "map_scale_id", F.col("mapped_clo_count").alias("clo_count"))


def evidence(facts: DataFrame) -> DataFrame:
    """program_id, pl_outcome_id, course_id, evidence: sorted array of (l_outcome_id, map_scale_id)."""
    rows = facts.where("covered").groupBy("program_id", "pl_outcome_id", "course_id")
    return rows.agg(F.sort_array(F.collect_list(F.struct("l_outcome_id", "map_scale_id"))).alias("evidence"))


@dataclass(frozen=True)
class Bound:
    """What one metric should be at one level, in whole percent of its denominator; None is open."""

    metric: str
    map_scale_id: int
    least: int | None = None
    most: int | None = None


def validated(bounds: list[Bound], configured: set[int]) -> list[Bound]:
    """The bounds, or ValueError: known metrics, configured levels other than N/A, whole percent, least <= most."""
    for b in bounds:
        if b.metric not in METRICS:
            raise ValueError(f"unknown metric {b.metric}")
        if b.map_scale_id == 0 or b.map_scale_id not in configured:
            raise ValueError(f"level {b.map_scale_id} is not configured")
        for x in (b.least, b.most):
            if x is not None and (isinstance(x, bool) or not isinstance(x, int) or not 0 <= x <= 100):
                raise ValueError(f"{x} is no whole percentage")
        if b.least is not None and b.most is not None and b.least > b.most:
            raise ValueError("the least is larger than the most")
    return bounds


def evaluate(hist: DataFrame, totals: DataFrame, bounds: DataFrame, *, gaps: bool = True, redundancies: bool = True) -> DataFrame:
    """A row for each PLO, level and metric with its status.

    bounds: metric, map_scale_id, least, most. CLO counts are shares of the program's CLOs, course counts of its
    courses. Percentages are compared as 100 * count against bound * denominator, never rounded.
    """
    long = hist.unpivot(["program_id", "pl_outcome_id", "map_scale_id"], list(METRICS), "metric", "count")
    rows = long.join(totals, "program_id").join(bounds, ["metric", "map_scale_id"], "left")
    denominator = F.when(F.col("metric") == METRICS[0], F.col("clo_count")).otherwise(F.col("course_count"))
    rows = rows.withColumn("denominator", denominator)
    low = F.coalesce(F.lit(gaps) & (100 * F.col("count") < F.col("least") * F.col("denominator")), F.lit(False))
    high = F.coalesce(F.lit(redundancies) & (100 * F.col("count") > F.col("most") * F.col("denominator")), F.lit(False))
    asked = (F.lit(gaps) & F.col("least").isNotNull()) | (F.lit(redundancies) & F.col("most").isNotNull())
    status = F.when(F.col("denominator") == 0, "not_applicable").when(low, "gap").when(high, "redundancy").when(asked, "within_expectations").otherwise("no_expectation")
    return rows.select("program_id", "pl_outcome_id", "map_scale_id", "metric", "count", "denominator", status.alias("status"))


def summary(evaluated: DataFrame) -> DataFrame:
    """PLOs of each program with any gap, any redundancy; each counts once a concern."""
    each = evaluated.groupBy("program_id", "pl_outcome_id").agg(*[F.bool_or(F.col("status") == s).alias(s) for s in ("gap", "redundancy")])
    return each.groupBy("program_id").agg(F.count("*").alias("plos"), F.count_if("gap").alias("gap_plos"), F.count_if("redundancy").alias("redundancy_plos"))
