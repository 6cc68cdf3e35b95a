"""Queries on cognitive levels (J-16, N-05, N-06, N-08, A-12 to A-14, A-48, T-08)."""

from pyspark.sql import functions as F

from loomwork.operators import progression as P
from loomwork.plans.registry import query
from loomwork.plans.star import Star

_EDGE = r"[^\pL\pM\pN_]"
_HITS = rf"hits AS (SELECT DISTINCT l.l_outcome_id, l.course_id, v.level_id, v.verb FROM {{learning_outcomes}} l JOIN {{bloom_verbs}} v ON REGEXP_MATCHES(TRIM(REGEXP_REPLACE(l.l_outcome, '\s+', ' ', 'g')), '(?i)(^|{_EDGE})' || v.verb || '($|{_EDGE})'))"
_LEVEL = "CASE WHEN REGEXP_MATCHES(course_num, '^[1-9][0-9][0-9][A-Za-z]*$') THEN SUBSTRING(course_num, 1, 1) || '00' ELSE 'other' END"
_ROWS = f"""{_HITS}, rows_ AS (SELECT cp.program_id, c.course_id, {_LEVEL} AS level, l.l_outcome_id FROM {{course_programs}} cp JOIN {{courses}} c ON c.course_id = cp.course_id LEFT JOIN {{learning_outcomes}} l ON l.course_id = c.course_id)"""
_PERCENT = "CASE WHEN {d} > 0 THEN CAST(FLOOR((20000.0 * {n} + {d}) / (2 * {d})) AS DOUBLE) / 100 END"


def _percent(n: str, d: str) -> str:
    return _PERCENT.replace("{n}", n).replace("{d}", d)


def _rows(t: Star):
    return P.scope(t.courses, t.course_programs, P.classify(t.learning_outcomes, t.bloom_verbs))


@query(f"WITH {_HITS} SELECT l_outcome_id, STRING_AGG(CAST(level_id AS STRING) || ':' || verb, ',' ORDER BY level_id, verb) AS matches FROM hits GROUP BY 1")
def bloom_classification(t: Star):
    joined = F.array_join(F.transform("matches", lambda m: F.concat_ws(":", m["level_id"].cast("string"), m["verb"])), ",")
    return P.classify(t.learning_outcomes, t.bloom_verbs).where("size(matches) > 0").select("l_outcome_id", joined.alias("matches"))


@query(f"SELECT course_id, {_LEVEL} AS level, CASE WHEN SUBSTRING(course_num, 1, 1) BETWEEN '1' AND '6' THEN SUBSTRING(course_num, 1, 1) || '00 Level' ELSE 'Other' END AS simple FROM {{courses}}")
def course_level_buckets(t: Star):
    return t.courses.select("course_id", P.course_level(F.col("course_num")).alias("level"), P.simple_level(F.col("course_num")).alias("simple"))


_GROUPS = "SELECT r.program_id, r.level, COUNT(DISTINCT r.course_id) AS course_count, COUNT(DISTINCT r.l_outcome_id) AS clo_count, COUNT(DISTINCT h.l_outcome_id) AS matched FROM rows_ r LEFT JOIN hits h ON h.l_outcome_id = r.l_outcome_id GROUP BY 1, 2"


@query(f"WITH {_ROWS}, g AS ({_GROUPS}) SELECT *, clo_count - matched AS unmatched, ROW_NUMBER() OVER (PARTITION BY program_id ORDER BY CASE WHEN level = 'other' THEN 1 ELSE 0 END, level) AS place FROM g")
def progression_groups(t: Star):
    return P.in_order(P.group_totals(_rows(t), True))


_COUNTS = "SELECT r.program_id, r.level, h.level_id, COUNT(DISTINCT r.l_outcome_id) AS n FROM rows_ r JOIN hits h ON h.l_outcome_id = r.l_outcome_id GROUP BY 1, 2, 3"


@query(f"WITH {_ROWS}, g AS ({_GROUPS}), n AS ({_COUNTS}) SELECT g.program_id, g.level, b.level_id, b.position, COALESCE(n.n, 0) AS matched_clos, {_percent('COALESCE(n.n, 0)', 'clo_count')} AS percentage FROM g CROSS JOIN {{bloom_levels}} b LEFT JOIN n ON n.program_id = g.program_id AND n.level = g.level AND n.level_id = b.level_id")
def progression_distributions(t: Star):
    return P.distributions(_rows(t), t.bloom_levels)


@query(f"""WITH {_ROWS}, chosen AS (SELECT * FROM rows_ WHERE program_id = 2 AND l_outcome_id IN (SELECT m.l_outcome_id FROM {{outcome_maps}} m JOIN {{mapping_scale_programs}} s ON s.map_scale_id = m.map_scale_id AND s.program_id = 2 AND m.map_scale_id <> 0
    WHERE m.pl_outcome_id = (SELECT MIN(pl_outcome_id) FROM {{program_learning_outcomes}}))),
    g AS (SELECT program_id, level, COUNT(DISTINCT course_id) AS course_count, COUNT(DISTINCT chosen.l_outcome_id) AS clo_count, COUNT(DISTINCT h.l_outcome_id) AS matched FROM chosen LEFT JOIN (SELECT DISTINCT l_outcome_id FROM hits) AS h ON h.l_outcome_id = chosen.l_outcome_id GROUP BY 1, 2) SELECT *, clo_count - matched AS unmatched FROM g""")
def progression_of_outcome(t: Star):
    first = t.program_learning_outcomes.agg(F.min("pl_outcome_id")).first()[0]
    return P.group_totals(P.narrowed(_rows(t), t.outcome_maps, t.mapping_scale_programs, first, 2), True)


@query(f"""WITH {_ROWS}, tot AS (SELECT program_id, COUNT(DISTINCT l_outcome_id) AS clos FROM rows_ GROUP BY 1), n AS (SELECT r.program_id, h.level_id, COUNT(DISTINCT r.l_outcome_id) AS n, STRING_AGG(DISTINCT CAST(r.course_id AS STRING), ',' ORDER BY CAST(r.course_id AS STRING)) AS courses FROM rows_ r JOIN hits h ON h.l_outcome_id = r.l_outcome_id GROUP BY 1, 2)
    SELECT tot.program_id, b.level_id, b.name, COALESCE(n, 0) AS clo_count, {_percent('COALESCE(n, 0)', 'clos')} AS percentage, COALESCE(courses, '') AS courses FROM tot CROSS JOIN {{bloom_levels}} b LEFT JOIN n ON n.program_id = tot.program_id AND n.level_id = b.level_id""")
def cognitive_summary(t: Star):
    out = P.cognitive_summary(_rows(t), t.bloom_levels)
    return out.withColumn("courses", F.array_join(F.array_sort(F.transform("courses", lambda c: c.cast("string"))), ","))


@query(f"WITH {_HITS} SELECT l.l_outcome_id, COUNT(DISTINCT level_id) AS levels, COUNT(DISTINCT level_id) >= 3 AS review FROM {{learning_outcomes}} l LEFT JOIN hits h ON h.l_outcome_id = l.l_outcome_id GROUP BY 1")
def review_suggested(t: Star):
    return P.review_suggested(P.classify(t.learning_outcomes, t.bloom_verbs)).select("l_outcome_id", F.col("levels").cast("long").alias("levels"), "review")
