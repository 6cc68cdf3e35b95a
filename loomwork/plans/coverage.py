"""Queries on coverage (J-03 to J-05, A-01 to A-11)."""

from pyspark.sql import functions as F

from loomwork.operators import coverage as C
from loomwork.plans.registry import query
from loomwork.plans.star import Star

_FACTS = """facts AS (SELECT p.program_id, p.pl_outcome_id, m.map_scale_id, l.l_outcome_id, cp.course_id, cp.course_required,
    cp.course_id IS NOT NULL AS current, cp.course_id IS NOT NULL AND ms.map_scale_id IS NOT NULL AS covered
    FROM {program_learning_outcomes} p LEFT JOIN {outcome_maps} m ON p.pl_outcome_id = m.pl_outcome_id
    LEFT JOIN {learning_outcomes} l ON m.l_outcome_id = l.l_outcome_id
    LEFT JOIN {course_programs} cp ON cp.course_id = l.course_id AND cp.program_id = p.program_id
    LEFT JOIN {mapping_scale_programs} ms ON ms.program_id = p.program_id AND ms.map_scale_id = m.map_scale_id AND ms.map_scale_id <> 0)"""
_COUNTS = """COUNT(DISTINCT CASE WHEN covered THEN l_outcome_id END) AS mapped_clo_count, COUNT(DISTINCT CASE WHEN covered THEN course_id END) AS covering_course_count,
    COUNT(DISTINCT CASE WHEN covered AND course_required = 1 THEN course_id END) AS required_course_count, COUNT(DISTINCT CASE WHEN covered AND course_required = 0 THEN course_id END) AS non_required_course_count"""
_HIST = f"""{_FACTS}, hist AS (SELECT p.program_id, p.pl_outcome_id, s.map_scale_id, s.position, {_COUNTS}
    FROM {{program_learning_outcomes}} p JOIN {{mapping_scale_programs}} s ON s.program_id = p.program_id AND s.map_scale_id <> 0
    LEFT JOIN facts f ON f.pl_outcome_id = p.pl_outcome_id AND f.program_id = p.program_id AND f.map_scale_id = s.map_scale_id GROUP BY 1, 2, 3, 4)"""
_TOTALS = """SELECT cp.program_id, COUNT(DISTINCT c.course_id) AS course_count, COUNT(DISTINCT l.l_outcome_id) AS clo_count FROM {course_programs} cp
    JOIN {courses} c ON cp.course_id = c.course_id LEFT JOIN {learning_outcomes} l ON l.course_id = c.course_id GROUP BY 1"""
#: (metric, level, least, most) of the registered evaluation.
BOUNDS = [("mapped_clo_count", 1, 1, 5), ("mapped_clo_count", 2, 3, None), ("covering_course_count", 1, None, 1), ("required_course_count", 2, 1, 2), ("non_required_course_count", 3, 0, 1)]
_EVALUATED = _HIST + f""", totals AS ({_TOTALS}), long AS (
    SELECT program_id, pl_outcome_id, map_scale_id, 'mapped_clo_count' AS metric, mapped_clo_count AS count FROM hist UNION ALL
    SELECT program_id, pl_outcome_id, map_scale_id, 'covering_course_count', covering_course_count FROM hist UNION ALL
    SELECT program_id, pl_outcome_id, map_scale_id, 'required_course_count', required_course_count FROM hist UNION ALL
    SELECT program_id, pl_outcome_id, map_scale_id, 'non_required_course_count', non_required_course_count FROM hist),
    bounds AS (SELECT * FROM (VALUES {", ".join(f"('{m}', {s}, {'NULL' if a is None else a}, {'NULL' if b is None else b})" for m, s, a, b in BOUNDS)}) AS v(metric, map_scale_id, least, most)),
    joined AS (SELECT long.*, least, most, CASE WHEN long.metric = 'mapped_clo_count' THEN clo_count ELSE course_count END AS denominator FROM long JOIN totals USING (program_id)
        LEFT JOIN bounds ON bounds.metric = long.metric AND bounds.map_scale_id = long.map_scale_id),
    evaluated AS (SELECT program_id, pl_outcome_id, map_scale_id, metric, count, denominator, CASE WHEN denominator = 0 THEN 'not_applicable'
        WHEN 100 * count < least * denominator THEN 'gap' WHEN 100 * count > most * denominator THEN 'redundancy'
        WHEN least IS NOT NULL OR most IS NOT NULL THEN 'within_expectations' ELSE 'no_expectation' END AS status FROM joined)"""


def _facts(t: Star):
    return C.mapping_facts(t.program_learning_outcomes, t.outcome_maps, t.learning_outcomes, t.course_programs, t.mapping_scale_programs)


def _hist(t: Star):
    return C.histogram(t.program_learning_outcomes, t.mapping_scale_programs, _facts(t))


def _evaluated(t: Star):
    bounds = t.spark.createDataFrame(BOUNDS, "metric string, map_scale_id long, least int, most int")
    return C.evaluate(_hist(t), C.program_totals(t.course_programs, t.courses, t.learning_outcomes), bounds)


@query(_TOTALS)
def program_totals(t: Star):
    return C.program_totals(t.course_programs, t.courses, t.learning_outcomes)


@query("SELECT c.course_id, COUNT(DISTINCT l_outcome_id) AS clo_count FROM {courses} c LEFT JOIN {learning_outcomes} l ON l.course_id = c.course_id GROUP BY 1")
def clos_per_course(t: Star):
    return C.clos_per_course(t.courses, t.learning_outcomes)


_DECISIONS = """SELECT program_id, course_id, COUNT(*) AS decisions FROM (SELECT DISTINCT cp.program_id, cp.course_id, m.l_outcome_id, m.pl_outcome_id FROM {outcome_maps} m
    JOIN {learning_outcomes} l ON l.l_outcome_id = m.l_outcome_id JOIN {program_learning_outcomes} p ON p.pl_outcome_id = m.pl_outcome_id
    JOIN {course_programs} cp ON cp.course_id = l.course_id AND cp.program_id = p.program_id) AS x GROUP BY 1, 2"""


@query(_DECISIONS)
def mapping_decisions(t: Star):
    return C.mapping_decisions(t.course_programs, t.learning_outcomes, t.program_learning_outcomes, t.outcome_maps)


@query(f"""WITH decisions AS ({_DECISIONS}), clos AS (SELECT c.course_id, COUNT(DISTINCT l_outcome_id) AS clo_count FROM {{courses}} c LEFT JOIN {{learning_outcomes}} l ON l.course_id = c.course_id GROUP BY 1),
    plos AS (SELECT program_id, COUNT(*) AS plos FROM {{program_learning_outcomes}} GROUP BY 1),
    x AS (SELECT cp.program_id, cp.course_id, clo_count, CASE WHEN clo_count = 0 THEN COALESCE(plos, 0) ELSE clo_count * COALESCE(plos, 0) END AS expected, COALESCE(decisions, 0) AS actual
        FROM {{course_programs}} cp JOIN clos USING (course_id) LEFT JOIN plos ON plos.program_id = cp.program_id LEFT JOIN decisions d ON d.program_id = cp.program_id AND d.course_id = cp.course_id)
    SELECT *, GREATEST(0, expected - actual) AS missing, expected = actual AS is_complete FROM x""")
def mapping_completeness(t: Star):
    return C.mapping_completeness(t.course_programs, t.courses, t.learning_outcomes, t.program_learning_outcomes, t.outcome_maps)


@query(f"""WITH {_FACTS}, multi AS (SELECT program_id, pl_outcome_id, COUNT(*) AS n FROM (SELECT program_id, pl_outcome_id, l_outcome_id FROM facts WHERE covered GROUP BY 1, 2, 3 HAVING COUNT(DISTINCT map_scale_id) > 1) AS y GROUP BY 1, 2),
    x AS (SELECT program_id, pl_outcome_id, {_COUNTS}, COUNT(DISTINCT CASE WHEN current AND map_scale_id = 0 THEN l_outcome_id END) AS n_a_clo_count FROM facts GROUP BY 1, 2)
    SELECT x.*, COALESCE(n, 0) AS multi_level_mapping_count FROM x LEFT JOIN multi USING (program_id, pl_outcome_id)""")
def plo_coverage(t: Star):
    return C.plo_coverage(_facts(t), t.program_learning_outcomes)


@query(f"WITH {_HIST} SELECT * FROM hist")
def coverage_histogram(t: Star):
    return _hist(t)


@query(f"WITH {_HIST} SELECT program_id, pl_outcome_id, map_scale_id, mapped_clo_count AS clo_count FROM hist WHERE mapped_clo_count > 0")
def coverage_distribution(t: Star):
    return C.distribution(_hist(t))


@query(f"""WITH {_FACTS} SELECT program_id, pl_outcome_id, course_id, STRING_AGG(CAST(l_outcome_id AS STRING) || ':' || CAST(map_scale_id AS STRING), ',' ORDER BY l_outcome_id, map_scale_id) AS evidence
    FROM facts WHERE covered GROUP BY 1, 2, 3""")
def coverage_evidence(t: Star):
    joined = F.array_join(F.transform("evidence", lambda e: F.concat_ws(":", e["l_outcome_id"].cast("string"), e["map_scale_id"].cast("string"))), ",")
    return C.evidence(_facts(t)).withColumn("evidence", joined)


@query(f"WITH {_EVALUATED} SELECT * FROM evaluated")
def coverage_evaluation(t: Star):
    return _evaluated(t)


@query(f"""WITH {_EVALUATED}, each AS (SELECT program_id, pl_outcome_id, BOOL_OR(status = 'gap') AS gap, BOOL_OR(status = 'redundancy') AS redundancy FROM evaluated GROUP BY 1, 2)
    SELECT program_id, COUNT(*) AS plos, COUNT(*) FILTER (WHERE gap) AS gap_plos, COUNT(*) FILTER (WHERE redundancy) AS redundancy_plos FROM each GROUP BY 1""")
def coverage_summary(t: Star):
    return C.summary(_evaluated(t))
