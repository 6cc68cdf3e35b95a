"""Queries on course progress and totals (A-35, A-38, A-39, N-10)."""

from pyspark.sql import functions as F

from loomwork.operators import progress as P
from loomwork.plans.registry import query
from loomwork.plans.star import Star

_TABLES = ("courses", "course_descriptions", "course_topics", "course_materials", "learning_outcomes", "assessment_methods", "learning_activities", "outcome_assessments", "outcome_activities", "program_learning_outcomes", "course_programs", "outcome_maps", "standards", "standards_outcome_maps")
_HAS = "CASE WHEN c.course_id IN (SELECT course_id FROM {{{}}}) THEN 1 ELSE 0 END AS {}"


@query("""WITH al AS (SELECT l.course_id, COUNT(*) AS clos, MAX(a.x) AS any_a, MAX(b.x) AS any_b, MAX(CASE WHEN a.x IS NULL OR b.x IS NULL THEN 1 END) AS some_open FROM {learning_outcomes} l
        LEFT JOIN (SELECT DISTINCT l_outcome_id, 1 AS x FROM {outcome_assessments}) AS a ON a.l_outcome_id = l.l_outcome_id LEFT JOIN (SELECT DISTINCT l_outcome_id, 1 AS x FROM {outcome_activities}) AS b ON b.l_outcome_id = l.l_outcome_id GROUP BY 1),
    plos AS (SELECT program_id, COUNT(*) AS plos FROM {program_learning_outcomes} GROUP BY 1),
    owed AS (SELECT course_id, COUNT(*) AS programs, CAST(SUM(COALESCE(plos, 0)) AS BIGINT) AS plos FROM {course_programs} cp LEFT JOIN plos ON plos.program_id = cp.program_id GROUP BY 1),
    maps AS (SELECT l.course_id, COUNT(*) AS maps FROM {outcome_maps} m JOIN {learning_outcomes} l ON l.l_outcome_id = m.l_outcome_id GROUP BY 1),
    st AS (SELECT standard_category_id, COUNT(*) AS standards FROM {standards} GROUP BY 1), sm AS (SELECT course_id, COUNT(*) AS standard_maps FROM {standards_outcome_maps} GROUP BY 1),
    x AS (SELECT c.course_id, c.standard_category_id AS cat, """ + ", ".join(_HAS.format(t, n) for t, n in (("course_descriptions", "description"), ("course_topics", "topics"), ("course_materials", "materials"), ("assessment_methods", "assessments"), ("learning_activities", "activities"))) + """,
        COALESCE(clos, 0) AS clos, any_a, any_b, some_open, COALESCE(maps, 0) AS maps, COALESCE(standard_maps, 0) AS standard_maps, COALESCE(standards, 0) AS standards,
        CASE WHEN COALESCE(programs, 0) <= 1 THEN 1 ELSE 0 END + COALESCE(plos, 0) * COALESCE(clos, 0) AS expected
        FROM {courses} c LEFT JOIN al ON al.course_id = c.course_id LEFT JOIN owed ON owed.course_id = c.course_id LEFT JOIN maps ON maps.course_id = c.course_id LEFT JOIN st ON st.standard_category_id = c.standard_category_id LEFT JOIN sm ON sm.course_id = c.course_id),
    y AS (SELECT *, CASE WHEN clos > 0 THEN 1 ELSE 0 END AS outcomes, CASE WHEN any_a IS NULL AND any_b IS NULL THEN 0 WHEN some_open = 1 THEN 1 ELSE 2 END AS alignment,
        CASE WHEN maps >= CASE WHEN expected = 1 THEN 1 ELSE expected - 1 END THEN 1 ELSE 0 END AS mapped, CASE WHEN cat = 0 THEN 0 WHEN standard_maps = standards THEN 1 ELSE 0 END AS std, CASE WHEN cat = 0 THEN 9 ELSE 10 END AS checks FROM x),
    z AS (SELECT *, description + topics + materials + assessments + activities + outcomes + alignment + mapped + std AS done FROM y)
    SELECT course_id, done, checks, CAST(FLOOR((200 * done + checks) / (2.0 * checks)) AS BIGINT) AS percent, CONCAT_WS(', ', CASE WHEN activities = 0 THEN 'activities' END, CASE WHEN alignment < 2 THEN 'alignment' END, CASE WHEN assessments = 0 THEN 'assessments' END,
        CASE WHEN description = 0 THEN 'description' END, CASE WHEN materials = 0 THEN 'materials' END, CASE WHEN outcomes = 0 THEN 'outcomes' END, CASE WHEN mapped = 0 THEN 'program map' END, CASE WHEN std = 0 AND cat <> 0 THEN 'standards' END, CASE WHEN topics = 0 THEN 'topics' END) AS remaining FROM z""")
def course_progress(t: Star):
    return P.course_progress({n: t[n] for n in _TABLES})


@query("SELECT course_id, SUM(weight) AS total, SUM(weight) > 100 AS over FROM {assessment_methods} GROUP BY 1")
def assessment_weights(t: Star):
    return P.weights(t.assessment_methods)


@query("SELECT 'outcomes' AS kind, program_id AS id, COUNT(*) AS n FROM {program_learning_outcomes} GROUP BY 2 UNION ALL SELECT 'maps', course_id, COUNT(*) FROM {outcome_maps} m JOIN {learning_outcomes} l ON l.l_outcome_id = m.l_outcome_id GROUP BY 2 UNION ALL SELECT 'standards', standard_category_id, COUNT(*) FROM {standards} GROUP BY 2")
def dashboard_counts(t: Star):
    count = lambda df, kind, key: df.groupBy(F.col(key).alias("id")).agg(F.count("*").alias("n")).select(F.lit(kind).alias("kind"), "id", "n")
    maps = t.outcome_maps.join(t.learning_outcomes.select("l_outcome_id", "course_id"), "l_outcome_id")
    return count(t.program_learning_outcomes, "outcomes", "program_id").unionByName(count(maps, "maps", "course_id")).unionByName(count(t.standards, "standards", "standard_category_id"))


@query("""WITH x AS (SELECT event_id, CAST(EXTRACT(EPOCH FROM (TIMESTAMP '2026-01-01' - ts)) AS BIGINT) AS s FROM {events})
    SELECT event_id, CASE WHEN s >= 31536000 THEN CAST(s // 31536000 AS STRING) || ' year' || CASE WHEN s // 31536000 > 1 THEN 's ago' ELSE ' ago' END
        WHEN s >= 2592000 THEN CAST(s // 2592000 AS STRING) || ' month' || CASE WHEN s // 2592000 > 1 THEN 's ago' ELSE ' ago' END ELSE 'recent' END AS ago FROM x""")
def event_age(t: Star):
    seconds = F.lit(1767225600) - F.floor(F.unix_micros(F.col("ts").cast("timestamp")) / 1000000)
    ago = P.relative_time(seconds)
    return t.events.select("event_id", F.when(seconds >= 2592000, ago).otherwise("recent").alias("ago"))


_UNITS = [("year", 31536000), ("month", 2592000), ("week", 604800), ("day", 86400), ("hour", 3600), ("minute", 60), ("second", 1)]


@query("WITH x AS (SELECT o_orderkey AS id, CASE o_orderkey % 7 WHEN 0 THEN 31536000 WHEN 1 THEN 2592000 WHEN 2 THEN 604800 WHEN 3 THEN 86400 WHEN 4 THEN 3600 WHEN 5 THEN 60 ELSE 1 END * (o_custkey % 3 + 1) AS s FROM {orders}) SELECT id, CASE " + " ".join(f"WHEN s >= {n} THEN CAST(s // {n} AS STRING) || ' {unit}' || CASE WHEN s // {n} > 1 THEN 's ago' ELSE ' ago' END" for unit, n in _UNITS) + " END AS ago FROM x")
def relative_times(t: Star):
    """Ages of one to three of each unit."""
    unit = F.element_at(F.array(*[F.lit(n) for _, n in _UNITS]), (F.col("o_orderkey") % 7 + 1).cast("int"))
    return t.orders.select(F.col("o_orderkey").alias("id"), P.relative_time((unit * (F.col("o_custkey") % 3 + 1)).cast("long")).alias("ago"))
