"""Queries on program maps (J-18, A-15 to A-37, N-01, W-04 to W-06)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.operators import program_map as M
from loomwork.plans.registry import query
from loomwork.plans.star import Star

_PAIRS = """pairs AS (SELECT cp.program_id, m.pl_outcome_id, cp.course_id, cp.course_required, m.l_outcome_id, m.map_scale_id FROM {outcome_maps} m JOIN {learning_outcomes} l ON l.l_outcome_id = m.l_outcome_id
    JOIN {program_learning_outcomes} p ON p.pl_outcome_id = m.pl_outcome_id JOIN {course_programs} cp ON cp.course_id = l.course_id AND cp.program_id = p.program_id)"""
_FREQ = _PAIRS + ", freq AS (SELECT program_id, pl_outcome_id, course_id, map_scale_id, COUNT(*) AS n, MIN(l_outcome_id) AS first FROM pairs GROUP BY 1, 2, 3, 4)"


def _ucwords(x: str) -> str:
    """For one or two words."""
    one = lambda w: f"UPPER(SUBSTRING({w}, 1, 1)) || SUBSTRING({w}, 2)"
    return f"CASE WHEN STRPOS({x}, ' ') = 0 THEN {one(x)} ELSE {one(f'SPLIT_PART({x}, chr(32), 1)')} || ' ' || {one(f'SPLIT_PART({x}, chr(32), 2)')} END"


def _pairs(t: Star):
    return M.program_pairs(t.outcome_maps, t.learning_outcomes, t.program_learning_outcomes, t.course_programs)


@query(f"WITH {_PAIRS} SELECT program_id, pl_outcome_id, course_id, l_outcome_id, MIN(map_scale_id) AS map_scale_id FROM pairs GROUP BY 1, 2, 3, 4")
def clo_plo_levels(t: Star):
    return M.one_level(_pairs(t))


@query(f"WITH {_FREQ} SELECT * FROM freq")
def map_frequency(t: Star):
    return M.frequency(_pairs(t))


@query(f"WITH {_FREQ} SELECT program_id, pl_outcome_id, course_id, abbreviation, CAST(SUM(n) AS BIGINT) AS n FROM freq JOIN {{mapping_scales}} s ON s.map_scale_id = freq.map_scale_id GROUP BY 1, 2, 3, 4")
def map_frequency_by_abbreviation(t: Star):
    return M.by_abbreviation(M.frequency(_pairs(t)), t.mapping_scales)


_MODES = f"""{_FREQ}, ranked AS (SELECT *, RANK() OVER (PARTITION BY program_id, pl_outcome_id, course_id ORDER BY n DESC) AS r FROM freq)
    SELECT program_id, pl_outcome_id, course_id, STRING_AGG(abbreviation, ' / ' ORDER BY first, ranked.map_scale_id) AS label, CASE WHEN COUNT(*) > 1 THEN '#FFFFFF' ELSE MAX(colour) END AS colour, MAX(n) AS n
    FROM ranked JOIN {{mapping_scales}} s ON s.map_scale_id = ranked.map_scale_id WHERE r = 1 GROUP BY 1, 2, 3"""


@query(f"WITH {_MODES}")
def map_modes(t: Star):
    return M.modes(M.frequency(_pairs(t)), t.mapping_scales)


@query(f"WITH {_MODES}".replace("FROM pairs GROUP BY", "FROM pairs WHERE course_required = 1 GROUP BY"))
def map_modes_required(t: Star):
    return M.modes(M.frequency(_pairs(t).where("course_required = 1")), t.mapping_scales)


@query(f"WITH {_MODES}".replace("FROM pairs GROUP BY", "FROM pairs WHERE course_id IN (SELECT course_id FROM {courses} WHERE SUBSTRING(course_num, 1, 1) IN ('5', '6')) GROUP BY"))
def map_modes_graduate(t: Star):
    graduate = t.courses.where(M.year_filter(F.col("course_num"), list(M.GRADUATE)))
    return M.modes(M.frequency(_pairs(t).join(graduate, "course_id", "left_semi")), t.mapping_scales)


@query(f"""WITH {_PAIRS}, x AS (SELECT pairs.*, abbreviation, CASE abbreviation WHEN 'I' THEN 1 WHEN 'D' THEN 2 WHEN 'A' THEN 3 END AS strength FROM pairs JOIN {{mapping_scales}} s ON s.map_scale_id = pairs.map_scale_id WHERE pairs.map_scale_id <> 0)
    SELECT program_id, pl_outcome_id, course_id, abbreviation AS dominant FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY program_id, pl_outcome_id, course_id ORDER BY strength DESC, l_outcome_id DESC, map_scale_id DESC) AS r FROM x) AS y WHERE r = 1""")
def map_dominant(t: Star):
    return M.dominant(_pairs(t), t.mapping_scales)


@query(f"WITH {_PAIRS}, d AS (SELECT DISTINCT program_id, pl_outcome_id, course_id, l_outcome_id FROM pairs WHERE map_scale_id <> 0) SELECT program_id, pl_outcome_id, d.course_id, STRING_AGG(clo_shortphrase, ', ' ORDER BY d.l_outcome_id) AS clos FROM d JOIN {{learning_outcomes}} l ON l.l_outcome_id = d.l_outcome_id GROUP BY 1, 2, 3")
def map_clo_lists(t: Star):
    return M.clo_lists(_pairs(t), t.learning_outcomes)


@query(f"WITH {_PAIRS} SELECT p.program_id, p.pl_outcome_id, " + ", ".join(f"COUNT(*) FILTER (WHERE map_scale_id = {s}) AS level_{s}" for s in range(4)) + " FROM {program_learning_outcomes} p LEFT JOIN pairs ON pairs.program_id = p.program_id AND pairs.pl_outcome_id = p.pl_outcome_id GROUP BY 1, 2")
def scale_matrix(t: Star):
    return M.scale_matrix(_pairs(t), t.program_learning_outcomes, [0, 1, 2, 3])


_METHODS = f"m AS (SELECT program_id, {_ucwords('a_method')} AS method, COUNT(*) AS n FROM {{course_programs}} cp JOIN {{assessment_methods}} a ON a.course_id = cp.course_id WHERE TRUE GROUP BY 1, 2)"
_MERGED = "SELECT program_id, CASE WHEN method = 'Final' AND program_id IN (SELECT program_id FROM m WHERE method = 'Final Exam') THEN 'Final Exam' ELSE method END AS method, CAST(SUM(n) AS BIGINT) AS n FROM m GROUP BY 1, 2"


@query(f"WITH {_METHODS} {_MERGED}")
def assessment_frequency(t: Star):
    return M.assessment_frequency(t.assessment_methods, t.course_programs)


@query(f"WITH {_METHODS} {_MERGED}".replace("WHERE TRUE", "JOIN {courses} c ON c.course_id = cp.course_id WHERE SUBSTRING(course_num, 1, 1) = '2'"))
def assessment_frequency_second_year(t: Star):
    second = t.courses.where(M.year_filter(F.col("course_num"), ["2"]))
    return M.assessment_frequency(t.assessment_methods, t.course_programs.join(second, "course_id", "left_semi"))


@query(f"WITH {_METHODS} {_MERGED}".replace("WHERE TRUE", "JOIN {courses} c ON c.course_id = cp.course_id WHERE SUBSTRING(course_num, 1, 1) IN ('5', '6')"))
def assessment_frequency_graduate(t: Star):
    graduate = t.courses.where(M.year_filter(F.col("course_num"), list(M.GRADUATE)))
    return M.assessment_frequency(t.assessment_methods, t.course_programs.join(graduate, "course_id", "left_semi"))


@query(f"SELECT program_id, {_ucwords('l_activity')} AS activity, COUNT(*) AS n FROM {{course_programs}} cp JOIN {{learning_activities}} a ON a.course_id = cp.course_id GROUP BY 1, 2")
def activity_frequency(t: Star):
    return M.activity_frequency(t.learning_activities, t.course_programs)


@query("""SELECT program_id, p.op_id, optional_priority, subcat_name, COUNT(*) AS n, STRING_AGG(CAST(c.course_id AS STRING) || '=' || CONCAT_WS(' ', course_code, course_num), '; ' ORDER BY c.course_id) AS courses FROM {course_programs} cp JOIN {course_optional_priorities} x ON x.course_id = cp.course_id
    JOIN {optional_priorities} p ON p.op_id = x.op_id JOIN {courses} c ON c.course_id = cp.course_id GROUP BY 1, 2, 3, 4""")
def priority_frequency(t: Star):
    out = M.priority_frequency(t.course_optional_priorities, t.optional_priorities, t.courses, t.course_programs)
    entries = F.transform(F.array_sort(F.map_entries("courses")), lambda e: F.concat(e["key"].cast("string"), F.lit("="), e["value"]))
    return out.withColumn("courses", F.array_join(entries, "; "))


@query("""WITH n AS (SELECT program_id, standard_id, standard_scale_id, COUNT(*) AS n, STRING_AGG(CONCAT_WS(' ', course_code, course_num), ', ' ORDER BY c.course_id) AS courses FROM {course_programs} cp JOIN {standards_outcome_maps} m ON m.course_id = cp.course_id JOIN {courses} c ON c.course_id = cp.course_id GROUP BY 1, 2, 3)
    SELECT p.program_id, s.standard_id, s_shortphrase, x.standard_scale_id, COALESCE(n, 0) AS n, COALESCE(courses, '') AS courses FROM (SELECT DISTINCT program_id FROM {course_programs}) AS p CROSS JOIN {standards} s CROSS JOIN {standard_scales} x
    LEFT JOIN n ON n.program_id = p.program_id AND n.standard_id = s.standard_id AND n.standard_scale_id = x.standard_scale_id""")
def standards_matrix(t: Star):
    return M.standards_matrix(t.standards_outcome_maps, t.standards, t.standard_scales, t.course_programs, t.courses)


@query(f"WITH {_PAIRS} SELECT cp.program_id, cp.course_id, CASE WHEN COUNT(l.l_outcome_id) > 0 AND BOOL_AND(d.l_outcome_id IS NOT NULL) THEN 'Yes' ELSE 'No' END AS mapped FROM {{course_programs}} cp LEFT JOIN {{learning_outcomes}} l ON l.course_id = cp.course_id LEFT JOIN (SELECT DISTINCT program_id, l_outcome_id FROM pairs) AS d ON d.program_id = cp.program_id AND d.l_outcome_id = l.l_outcome_id GROUP BY 1, 2")
def courses_mapped_to_program(t: Star):
    return M.mapped_to_program(t.course_programs, t.learning_outcomes, _pairs(t))


_LABELS = {"activity": ["discussion", "Group Work", "lecture", "field TRIP", "lab"], "method": ["Final Exam", "Final", "Lab REPORT", "Quiz", "Assignment", "Midterm"]}


def _columns(table: str, column: str, labels: list[str]) -> str:
    marks = ", ".join(f"MAX(CASE WHEN {column} = '{x}' THEN 1 END) AS c{i}" for i, x in enumerate(labels))
    return f"SELECT course_id, {marks} FROM {{{table}}} GROUP BY 1"


def _numbered(df, labels: list[str]):
    return df.select("course_id", *[F.col(f"`{x}`").alias(f"c{i}") for i, x in enumerate(labels)])


@query(_columns("learning_activities", "l_activity", _LABELS["activity"]))
def course_activity_pivot(t: Star):
    return _numbered(M.pivot_marks(t.learning_activities, ["course_id"], F.col("l_activity"), _LABELS["activity"]), _LABELS["activity"])


@query(_columns("assessment_methods", _ucwords("a_method"), _LABELS["method"]))
def course_assessment_pivot(t: Star):
    return _numbered(M.pivot_marks(t.assessment_methods, ["course_id"], M.ucwords(F.col("a_method")), _LABELS["method"]), _LABELS["method"])


@query("SELECT course_id, " + ", ".join(f"MAX(CASE WHEN op_id = {i} THEN 1 END) AS c{i - 1}" for i in range(1, 5)) + " FROM {course_optional_priorities} GROUP BY 1")
def course_priority_pivot(t: Star):
    return _numbered(M.pivot_marks(t.course_optional_priorities, ["course_id"], F.col("op_id").cast("string"), ["1", "2", "3", "4"]), ["1", "2", "3", "4"])


@query("SELECT program_id, COUNT(DISTINCT plo_category_id) AS categories, COUNT(*) FILTER (WHERE plo_category_id IS NULL) AS uncategorized, BOOL_OR(plo_category_id IS NULL) AS has_uncategorized FROM {program_learning_outcomes} GROUP BY 1")
def category_usage(t: Star):
    return M.category_usage(t.program_learning_outcomes)


@query("SELECT program_id, pl_outcome_id, COALESCE(plo_shortphrase, 'PLO #' || CAST(n AS STRING)) AS label, n FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY program_id ORDER BY plo_category_id NULLS LAST, pl_outcome_id) AS n FROM {program_learning_outcomes}) AS x")
def outcome_labels(t: Star):
    return M.default_numbers(t.program_learning_outcomes).withColumn("n", F.col("n").cast("long"))


@query("SELECT program_id, map_scale_id, ROW_NUMBER() OVER (PARTITION BY program_id ORDER BY map_scale_id) AS position FROM {mapping_scale_programs}")
def position_backfill(t: Star):
    order = Window.partitionBy("program_id").orderBy("map_scale_id")
    return t.mapping_scale_programs.select("program_id", "map_scale_id", F.row_number().over(order).cast("long").alias("position"))


@query("SELECT program_id, COALESCE(MAX(position), 0) + 1 AS next FROM {mapping_scale_programs} GROUP BY 1")
def next_position(t: Star):
    return t.mapping_scale_programs.groupBy("program_id").agg((F.coalesce(F.max("position"), F.lit(0)) + 1).alias("next"))


_MODE_ROWS = "{}, modes AS (SELECT{})".format(*_MODES.rsplit("\n    SELECT", 1))


@query(f"WITH {_MODE_ROWS}, sheet AS (SELECT program_id, pl_outcome_id, STRING_AGG(CAST(course_id AS STRING) || ':' || label, ';' ORDER BY course_id) AS cells FROM modes GROUP BY 1, 2) SELECT p.program_id, ROW_NUMBER() OVER (PARTITION BY p.program_id ORDER BY p.plo_category_id NULLS LAST, p.pl_outcome_id) AS place, p.pl_outcome_id, COALESCE(plo_category, 'Uncategorized') AS category, ROW_NUMBER() OVER (PARTITION BY p.program_id, p.plo_category_id ORDER BY p.pl_outcome_id) = 1 AS heading, COALESCE(cells, '') AS cells FROM {{program_learning_outcomes}} p LEFT JOIN {{p_l_o_categories}} c ON c.plo_category_id = p.plo_category_id LEFT JOIN sheet s ON s.program_id = p.program_id AND s.pl_outcome_id = p.pl_outcome_id")
def outcome_map_sheet(t: Star):
    out = M.outcome_map_sheet(M.modes(M.frequency(_pairs(t)), t.mapping_scales), t.program_learning_outcomes, t.p_l_o_categories, "label")
    joined = F.array_join(F.transform("cells", lambda c: F.concat_ws(":", c["course_id"].cast("string"), c["label"])), ";")
    return out.withColumns({"cells": joined, "place": F.col("place").cast("long")})


@query("SELECT DISTINCT course_id, CASE o WHEN 0 THEN 'Final Exam' WHEN 1 THEN 'Final' WHEN 2 THEN 'Lab REPORT' WHEN 3 THEN 'Quiz' WHEN 4 THEN 'Assignment' WHEN 5 THEN 'Final Exam' ELSE 'Midterm' END || ' (' || CAST(CAST(weight AS BIGINT) AS STRING) || '%)' AS heading FROM (SELECT course_id, weight, (a_method_id - 1) % 7 AS o FROM {assessment_methods}) AS x")
def course_assessment_headings(t: Star):
    return M.marks(t.assessment_methods, ["course_id"], M.weighted_heading(F.col("a_method"), F.col("weight")))


@query("WITH n AS (SELECT program_id, standard_id, standard_scale_id, COUNT(*) AS n FROM {course_programs} cp JOIN {standards_outcome_maps} m ON m.course_id = cp.course_id GROUP BY 1, 2, 3) SELECT p.program_id, s.standard_id, s_shortphrase, x.standard_scale_id, COALESCE(n, 0) AS n FROM {programs} p JOIN {standards} s ON s.standard_category_id = CASE p.level WHEN 'Masters' THEN 2 WHEN 'Doctoral' THEN 3 ELSE 1 END CROSS JOIN {standard_scales} x LEFT JOIN n ON n.program_id = p.program_id AND n.standard_id = s.standard_id AND n.standard_scale_id = x.standard_scale_id")
def standards_counts_by_level(t: Star):
    return M.standards_counts(t.standards_outcome_maps, t.standards, t.standard_scales, t.programs, t.course_programs).select("program_id", "standard_id", "s_shortphrase", "standard_scale_id", "n")
