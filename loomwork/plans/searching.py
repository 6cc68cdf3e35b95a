"""Queries on search (X-01 to X-16, U-01, A-32 to A-34, W-01 to W-03, J-20)."""

import uuid

from pyspark.sql import functions as F

from loomwork.functions import english
from loomwork.operators import search as S
from loomwork.plans.registry import query
from loomwork.plans.star import Star
from loomwork.sources.search_index import SearchIndex
from loomwork.sources.shared import shared_folder

QUERY = 'climate the OR "small ring" -water'
_TOKENS = "' ' || LOWER(REGEXP_REPLACE({x}, '[^\\pL\\pN]+', ' ', 'g')) || ' '"


def _tokens(x: str) -> str:
    return _TOKENS.replace("{x}", f"COALESCE({x}, '')")


def _hit(x: str) -> str:
    t = _tokens(x)
    return f"(({t}) LIKE '% climate %' AND ({t}) LIKE '% the %') OR (({t}) LIKE '% small ring %' AND ({t}) NOT LIKE '% water %')"


_ALL = {
    "course": ("{courses}", "CONCAT_WS(' ', course_code, course_num, course_title)"),
    "topic": ("{course_topics}", "topic"),
    "learning outcome": ("{learning_outcomes}", "l_outcome"),
    "assessment": ("{assessment_methods}", "a_method"),
    "description": ("{course_descriptions}", "course_description"),
    "material": ("{course_materials}", "CONCAT_WS(' ', name, type, description)"),
    "material content": ("(SELECT m.course_id, content, file_name, page_number FROM {course_material_chunks} h JOIN {course_material_files} f ON f.course_material_file_id = h.course_material_file_id JOIN {course_materials} m ON m.course_material_id = f.course_material_id WHERE status = 'INDEXED') AS x", "content"),
}
_MATCHES = "matches AS (" + " UNION ALL ".join(f"SELECT course_id, '{p}' AS property, {x} AS matched_text, {'file_name' if p == 'material content' else 'CAST(NULL AS VARCHAR)'} AS file_name, {'CAST(page_number AS BIGINT)' if p == 'material content' else 'CAST(NULL AS BIGINT)'} AS page_number FROM {t} WHERE {_hit(x)}" for p, (t, x) in _ALL.items()) + ")"
_STATS = ", ".join(f"COUNT(*) FILTER (WHERE property = '{p}') AS {p.replace(' ', '_')}" for p in S.WEIGHTS)
_SCORE = "CAST(SUM(CASE property " + " ".join(f"WHEN '{p}' THEN {w}" for p, w in S.WEIGHTS.items()) + " END) AS BIGINT)"
_RANKED = f"{_MATCHES}, scored AS (SELECT course_id, {_SCORE} AS score, BOOL_OR(property = 'course') AS is_course_match, {_STATS} FROM matches GROUP BY 1), ranked AS (SELECT *, ROW_NUMBER() OVER (ORDER BY is_course_match DESC, score DESC, course_id) AS rank FROM scored)"


def _matches(t: Star):
    names = ("courses", "course_topics", "learning_outcomes", "assessment_methods", "course_descriptions", "course_materials", "course_material_files", "course_material_chunks")
    return S.branches({n: t[n] for n in names}, S.Request(QUERY))


@query(f"WITH {_MATCHES} SELECT * FROM matches")
def search_matches(t: Star):
    return _matches(t)


@query(f"WITH {_RANKED} SELECT * FROM ranked")
def search_ranking(t: Star):
    return S.ranked(_matches(t)).withColumn("rank", F.col("rank").cast("long"))


@query(f"WITH {_RANKED} SELECT course_id, score, rank FROM ranked WHERE rank BETWEEN 11 AND 20")
def search_second_page(t: Star):
    return S.page(S.top(_matches(t), 20), 2).select("course_id", "score", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {_RANKED} SELECT (SELECT COUNT(DISTINCT course_id) FROM matches) AS courses, (SELECT COUNT(DISTINCT program_id) FROM {{course_programs}} WHERE course_id IN (SELECT course_id FROM matches)) AS programs, " + ", ".join(f"(SELECT COUNT(*) FROM matches WHERE property = '{p}') AS {p.replace(' ', '_')}" for p in S.WEIGHTS if p != "course"))
def search_stats(t: Star):
    return S.stats(_matches(t), t.course_programs)


@query(f"WITH {_RANKED} SELECT program_id, COUNT(*) AS courses, COUNT(*) FILTER (WHERE is_course_match) AS direct, " + ", ".join(f"CAST(SUM({p.replace(' ', '_')}) AS BIGINT) AS {p.replace(' ', '_')}" for p in S.WEIGHTS if p != "course") + " FROM ranked r JOIN {course_programs} cp ON cp.course_id = r.course_id GROUP BY 1")
def search_by_program(t: Star):
    return S.by_program(S.scored(_matches(t)), t.course_programs)


@query(f"WITH {_RANKED}, x AS (SELECT program_id, r.course_id, rank, ROW_NUMBER() OVER (ORDER BY program_id, rank) AS spent FROM ranked r JOIN {{course_programs}} cp ON cp.course_id = r.course_id) SELECT * FROM x WHERE spent <= 500")
def search_shared_cap(t: Star):
    out = S.shared_cap(S.ranked(_matches(t)), t.course_programs, S.EXPORT_LIMIT)
    return out.withColumns({"rank": F.col("rank").cast("long"), "spent": F.col("spent").cast("long")})


_ALLOWED = "allowed AS (SELECT course_id FROM {courses} c WHERE course_code IN ('Brand#1', 'Brand#2', 'Brand#3', 'Brand#4', 'Brand#5', 'Brand#6', 'Brand#7', 'Brand#8') AND course_id IN (SELECT course_id FROM {course_programs} WHERE program_id < 20))"
_REQUEST = S.Request(QUERY, course_codes=tuple(f"Brand#{i}" for i in range(1, 9)), program_ids=tuple(range(1, 20)))


def _allowed(t: Star):
    return S.allowed_courses({n: t[n] for n in ("courses", "course_programs", "course_users", "course_user_role")}, _REQUEST, 0, administrator=True)


_SOME_NAMED = "named AS (SELECT program_id FROM {programs} WHERE program_id >= 20)"


@query(f"WITH {_RANKED}, {_SOME_NAMED}, x AS (SELECT program_id, r.course_id, rank, ROW_NUMBER() OVER (ORDER BY program_id, rank) AS spent FROM ranked r JOIN {{course_programs}} cp ON cp.course_id = r.course_id), k AS (SELECT * FROM x WHERE spent <= 500) SELECT * FROM k UNION ALL SELECT program_id, NULL, NULL, NULL FROM named WHERE program_id NOT IN (SELECT program_id FROM k)")
def search_shared_cap_with_named(t: Star):
    out = S.shared_cap(S.ranked(_matches(t)), t.course_programs, S.EXPORT_LIMIT, t.programs.where("program_id >= 20"))
    return out.withColumns({"rank": F.col("rank").cast("long"), "spent": F.col("spent").cast("long")})


_ASKED = "CASE course_id % 5 WHEN 0 THEN LEFT(course_code, 5) || course_num || ' ' || course_title WHEN 1 THEN LEFT(course_code, 5) || '_A' || course_num WHEN 2 THEN course_title || ' ' || LEFT(course_code, 5) || course_num WHEN 3 THEN LEFT(course_code, 5) || '  ' || course_num ELSE course_num || LEFT(course_code, 5) END"


@query(f"SELECT course_id, REGEXP_REPLACE({_ASKED}, '^([A-Za-z]+(_[A-Za-z]+)?)\\s*([0-9]+)\\b', '\\1 \\3') AS q FROM {{courses}} WHERE course_num IS NOT NULL")
def search_code_queries(t: Star):
    """Queries that name each course's code and number, run together, apart, and elsewhere than at the start."""
    rows = t.courses.where("course_num is not null")
    return rows.select("course_id", english.course_code_text(F.expr(_ASKED)).alias("q"))


@query(f"WITH {_MATCHES}, {_ALLOWED} SELECT * FROM matches WHERE course_id IN (SELECT course_id FROM allowed)")
def search_scoped(t: Star):
    return S.scoped(_matches(t), _allowed(t))


@query(f"WITH {_RANKED} SELECT r.course_id, rank, COALESCE(p.programs, '') AS programs FROM ranked r LEFT JOIN (SELECT course_id, STRING_AGG(CAST(cp.program_id AS STRING), ',' ORDER BY cp.program_id) AS programs FROM {{course_programs}} cp JOIN {{programs}} g ON g.program_id = cp.program_id GROUP BY 1) AS p ON p.course_id = r.course_id")
def search_with_programs(t: Star):
    out = S.with_programs(S.ranked(_matches(t)), t.course_programs, t.programs)
    return out.select("course_id", F.col("rank").cast("long").alias("rank"), F.array_join(F.col("programs.program_id").cast("array<string>"), ",").alias("programs"))


@query(f"WITH {_ALLOWED} SELECT program_id, program FROM {{programs}} WHERE program LIKE 'NATION_7' AND program_id IN (SELECT program_id FROM {{course_programs}} WHERE course_id IN (SELECT course_id FROM allowed))")
def search_program_names(t: Star):
    return S.program_matches(t.programs, t.course_programs, _allowed(t), '"nation 7"')


@query(f"SELECT l_outcome_id FROM {{learning_outcomes}} WHERE ({_tokens('l_outcome')}) LIKE '% license %' AND ({_tokens('l_outcome')}) LIKE '% under %'")
def search_by_index(t: Star):
    return S.lookup(S.inverted_index(t.learning_outcomes, "l_outcome_id", "l_outcome"), "l_outcome_id", ["license", "under"])


@query()
def search_stemmed(t: Star):
    """Stems have no SQL; tests hold them against known words."""
    names = ("courses", "course_topics", "learning_outcomes", "assessment_methods", "course_descriptions", "course_materials", "course_material_files", "course_material_chunks")
    found = S.branches({n: t[n] for n in names}, S.Request("licensing terms OR climates", stemmed=True))
    return S.with_snippets(found, S.Request("licensing terms OR climates", stemmed=True)).drop("matched_text")


_NAMES = ("courses", "course_topics", "learning_outcomes", "assessment_methods", "course_descriptions", "course_materials", "course_material_files", "course_material_chunks")


def _index(t: Star, stemmed: bool = False) -> SearchIndex:
    """All texts, stored as a search reads them."""
    index = SearchIndex(t.spark, f"{shared_folder(t.spark)}/search-{uuid.uuid4().hex}", stemmed)
    index.add(S.vectors({n: t[n] for n in _NAMES}, stemmed), 0)
    return index


@query(f"WITH {_MATCHES} SELECT * FROM matches")
def search_index_matches(t: Star):
    """search_matches from a stored index: its words, phrase, OR and NOT from lists of positions."""
    return _index(t).matches(S.Request(QUERY))


@query(f"WITH {_RANKED} SELECT * FROM ranked")
def search_index_ranking(t: Star):
    """search_ranking from the lists of positions alone; no text is read."""
    return S.ranked(_index(t).hits(S.Request(QUERY))).withColumn("rank", F.col("rank").cast("long"))


_CHANGED = "topics AS (SELECT course_topic_id, course_id, CASE WHEN course_topic_id % 3 = 1 THEN REPLACE(topic, 'climate', 'weather') ELSE topic END AS topic FROM {course_topics} WHERE course_topic_id % 3 > 0)"


@query(f"WITH {_CHANGED} SELECT course_id, topic AS matched_text FROM topics WHERE topic LIKE '%climate%' AND NOT topic LIKE '%NOT SPECIFIED%'")
def search_index_updated(t: Star):
    """A third of the topics changed, a third gone: only these are stored anew."""
    topics, index = t.course_topics, _index(t)
    own = F.col("course_topic_id") % 3
    vectors = S.vectors({n: t[n] for n in _NAMES} | {"course_topics": topics.where(own == 1).withColumn("topic", F.replace("topic", F.lit("climate"), F.lit("weather")))}).where("property = 'topic'")
    gone = S.vectors({n: t[n] for n in _NAMES} | {"course_topics": topics.where(own == 0)}).where("property = 'topic'")
    gone = gone.withColumns({"matched_text": F.lit(None).cast("string"), "tokens": F.array().cast("array<string>")})
    index.add(vectors.unionByName(gone), 1)
    return index.matches(S.Request('climate -"not specified"', properties=("topic",))).select("course_id", "matched_text")


_HEAD_WORDS = ("license", "under", "the", "de")


@query(rf"""WITH w AS (SELECT doc_id, text, REGEXP_EXTRACT_ALL(LOWER(text), '[\pL\pN]+') AS w, REGEXP_EXTRACT_ALL(text, '[\pL\pN]+|[^\pL\pN]+') AS q FROM {{documents}}),
    h AS (SELECT *, LIST_FILTER(RANGE(1, LEN(w) + 1), LAMBDA i: LIST_CONTAINS({list(_HEAD_WORDS)!r}, w[i])) AS h FROM w),
    c AS (SELECT doc_id, p, LIST_FILTER(h, LAMBDA x: x >= p AND x < p + 16) AS s, w, LEN(w) AS n FROM (SELECT doc_id, w, h, UNNEST(h) AS p FROM h) AS x),
    d AS (SELECT doc_id, p, LEN(LIST_DISTINCT(LIST_TRANSFORM(s, LAMBDA x: w[x]))) AS kinds, LEN(s) AS k, n FROM c),
    r AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY doc_id ORDER BY kinds DESC, k DESC, p) AS r FROM d),
    a AS (SELECT doc_id, GREATEST(1, p - 4) AS s, LEAST(n, GREATEST(1, p - 4) + 19) AS e FROM r WHERE r = 1),
    x AS (SELECT d.doc_id, p, n, a.s AS s1, a.e AS e1, ROW_NUMBER() OVER (PARTITION BY d.doc_id ORDER BY kinds DESC, k DESC, p) AS r FROM d JOIN a ON a.doc_id = d.doc_id WHERE p > a.e OR p + 16 <= a.s),
    y AS (SELECT *, GREATEST(CASE WHEN p > e1 THEN e1 + 1 ELSE 1 END, p - 4) AS s FROM x WHERE r = 1),
    b AS (SELECT doc_id, s, LEAST(CASE WHEN p > e1 THEN n ELSE s1 - 1 END, s + 19) AS e, 1 AS r FROM y),
    f AS (SELECT doc_id, s, e FROM a UNION ALL SELECT doc_id, s, e FROM b WHERE r = 1),
    m AS (SELECT f.doc_id, f.s, LIST_TRANSFORM(RANGE(1, 2 * (e - f.s) + 2), LAMBDA i: {{'x': REPLACE(REPLACE(REPLACE(REPLACE(q[CASE WHEN REGEXP_MATCHES(q[1], '^[\pL\pN]') THEN 0 ELSE 1 END + 2 * (f.s - 1) + i], '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '"', '&quot;'), 'hit': i % 2 = 1 AND LIST_CONTAINS(h, f.s + (i - 1) // 2)}}) AS parts FROM f JOIN h ON h.doc_id = f.doc_id)
    SELECT doc_id, STRING_AGG(ARRAY_TO_STRING(LIST_TRANSFORM(parts, LAMBDA y: CASE WHEN y.hit THEN '<mark>' || y.x || '</mark>' ELSE y.x END), ''), ' ... ' ORDER BY s) AS snippet FROM m GROUP BY 1""")
def search_headlines(t: Star):
    """The best parts of each document for four words."""
    rows = t.documents.select("doc_id", "text", english.words(F.col("text")).alias("tokens"))
    return rows.select("doc_id", english.headline(F.col("text"), F.col("tokens"), list(_HEAD_WORDS)).alias("snippet")).where("snippet is not null")
