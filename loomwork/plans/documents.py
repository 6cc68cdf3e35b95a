"""Queries on topics and syllabus text (J-17, A-40 to A-42, U-02, W-07 to W-11, T-05, N-19 to N-37, E-08)."""

from pyspark.sql import Column, Window
from pyspark.sql import functions as F

from loomwork.functions.english import STOP_WORDS
from loomwork.operators import assessments as G
from loomwork.operators import grids as D
from loomwork.operators import outline as O
from loomwork.operators import syllabus as Y
from loomwork.operators import topics as T
from loomwork.plans.registry import query
from loomwork.plans.star import Star, spread


@query("SELECT doc_id, CASE WHEN STRPOS(text, 'License') > 0 THEN 'y' ELSE 'n' END AS has, LENGTH(text) - LENGTH(REPLACE(text, 'e', '')) AS n FROM {documents}")
def document_letters(t: Star):
    return t.documents.select("doc_id", F.when(F.contains("text", F.lit("License")), "y").otherwise("n").alias("has"), F.regexp_count("text", F.lit("e")).cast("long").alias("n"))


@query(r"SELECT doc_id AS document_id, topic FROM {documents} JOIN (SELECT 'license' AS topic UNION ALL SELECT 'under' UNION ALL SELECT 'MIT License') AS k ON REGEXP_MATCHES(text, '(?i)(^|[^\pL\pN_])' || topic || '($|[^\pL\pN_])')")
def matched_topics(t: Star):
    topics = t.spark.range(1).select(F.lit(0).cast("long").alias("course_id"), F.explode(F.array(*map(F.lit, ["license", "under", "MIT License"]))).alias("topic"))
    return T.matched(t.documents.select(F.col("doc_id").alias("document_id"), F.lit(0).cast("long").alias("course_id"), "text"), topics)


@query("SELECT course_id, MIN(topic) AS topic FROM {course_topics} WHERE TRIM(topic) <> '' GROUP BY course_id, LOWER(TRIM(topic))")
def topics_once(t: Star):
    return T.first_seen(t.course_topics, ["course_id"], "topic", ["topic"]).select("course_id", "topic")


@query("""WITH s AS (SELECT DISTINCT course_id, topic FROM {course_topics} UNION SELECT course_id, SUBSTRING(topic, STRPOS(topic, ' ') + 1) FROM {course_topics})
    SELECT course_id, topic FROM s WHERE (STRPOS(topic, ' ') > 0 OR LENGTH(topic) >= 5) AND NOT EXISTS (SELECT 1 FROM s o WHERE o.course_id = s.course_id AND LOWER(o.topic) <> LOWER(s.topic) AND STRPOS(LOWER(o.topic), LOWER(s.topic)) > 0 AND (STRPOS(o.topic, ' ') > 0 OR LENGTH(o.topic) >= 5)) AND LOWER(SPLIT_PART(topic, ' ', 1)) <> 'not'""")
def topics_filtered(t: Star):
    short = t.course_topics.select("course_id", F.expr("substring(topic, instr(topic, ' ') + 1)").alias("topic"))
    rows = t.course_topics.select("course_id", "topic").union(short).distinct().withColumns({"score": F.lit(1.0), "source": F.lit("keyword")})
    return T.filtered(rows, ["course_id"]).select("course_id", "topic")


@query("SELECT course_id, topic, place FROM (SELECT course_id, topic, ROW_NUMBER() OVER (PARTITION BY course_id ORDER BY position DESC, topic) AS place FROM {course_topics}) AS x WHERE place <= 3")
def top_topics(t: Star):
    return T.top_topics(t.course_topics.withColumn("score", F.col("position")), ["course_id"], 3).select("course_id", "topic", F.col("place").cast("long").alias("place"))


@query(r"""WITH w AS (SELECT doc_id, LIST_FILTER(STRING_SPLIT_REGEX(text, '[ \t\n\x0b\f\r]+'), LAMBDA x: x <> '') AS w FROM {documents}),
    s AS (SELECT *, GREATEST(20, CAST(ROUND_EVEN(SQRT(LEN(w)), 0) AS INT)) AS size FROM w),
    p AS (SELECT *, GREATEST(1, CAST(ROUND_EVEN(size * 0.75, 0) AS INT)) AS step FROM s WHERE LEN(w) > 0)
    SELECT doc_id, UNNEST(RANGE(0, (LEN(w) - 1) // step + 1)) AS place, ARRAY_TO_STRING(w[UNNEST(RANGE(0, (LEN(w) - 1) // step + 1)) * step + 1 : UNNEST(RANGE(0, (LEN(w) - 1) // step + 1)) * step + size], ' ') AS "window" FROM p""")
def text_windows(t: Star):
    """Windows of each document's words, in order."""
    return spread(t.documents.select("doc_id", "text")).select("doc_id", F.posexplode(T.windows(F.col("text"))).alias("place", "window")).withColumn("place", F.col("place").cast("long"))


@query("SELECT part, CASE WHEN n > 0 THEN CAST(SUBSTRING(num, 1, 3) AS INT) ELSE 999 END AS number FROM (SELECT course_id AS part, course_num AS num, COALESCE(LENGTH(course_num), 0) AS n FROM {courses}) AS x")
def syllabus_numbers(t: Star):
    return t.courses.select(F.col("course_id").alias("part"), Y.course_number(F.col("course_num")).alias("number"))


@query("SELECT p_partkey AS id, CASE p_partkey % 12 + 1 WHEN 1 THEN 'W2' WHEN 2 THEN 'W2' WHEN 3 THEN 'W2' WHEN 4 THEN 'W2' WHEN 5 THEN 'S1' WHEN 6 THEN 'S1' WHEN 7 THEN 'S2' WHEN 8 THEN 'S2' ELSE 'W1' END AS code, CASE WHEN p_partkey % 700 < 500 THEN 'Undergraduate' ELSE 'Graduate' END AS level FROM {part}")
def syllabus_terms(t: Star):
    return t.part.select(F.col("p_partkey").alias("id"), Y.term_code(F.lit("none"), F.col("p_partkey") % 12 + 1).alias("code"), Y.level_of_study(F.col("p_partkey") % 700).alias("level"))


_AROUND = ("COURSE DESCRIPTION\n", "\nLearning Outcomes\n1. Name things\n2. Weigh them\nTopics\n- Water\n- Fire\nUniversity Policies\nBe kind.")
_BLANK = r"[\s\x0b\x{85}\pZ]"
_HEADINGS = ", ".join("('" + h.replace("'", "''") + f"', '{name}')" for name, some in [*Y.SECTIONS.items(), ("", Y.CLOSING)] for h in some)
_STOPS = ", ".join(f"'{w}'" for w in sorted(STOP_WORDS))
_INNER = ", ".join(f"'{w}'" for w in Y.INNER_HEADINGS)
_WORDS_UPPER = r"REGEXP_MATCHES({x}, '\p{Lu}') AND NOT REGEXP_MATCHES({x}, '\p{Ll}')"
_SECTIONS = (
    r"""WITH d AS (SELECT doc_id AS document_id, 'BEFORE' || text || 'AFTER' AS t FROM {documents} WHERE text IS NOT NULL),
    s AS (SELECT document_id, STRING_SPLIT_REGEX(t, '\r\n|[\n\r\x0b\x0c\x1c-\x1e\x{85}\x{2028}\x{2029}]') AS ls FROM d),
    l AS (SELECT document_id, UNNEST(ls) AS line, UNNEST(RANGE(LEN(ls))) AS pos FROM s),
    x AS (SELECT document_id, pos, REGEXP_REPLACE(line, '^BLANK+|BLANK+$', '', 'g') AS line FROM l),
    y AS (SELECT *, TRIM(REGEXP_REPLACE(REGEXP_REPLACE(LOWER(REGEXP_REPLACE(line, 'BULLET', '')), '[:.]+$', ''), '\s+', ' ', 'g')) AS head, LEN(STRING_SPLIT_REGEX(line, '\s+')) <= 3 AS few, REGEXP_MATCHES(line, '^[A-Z]{4} ?\d{3}') AS code, UPPER_LINE AS up,
        REGEXP_REPLACE(TRIM(REGEXP_EXTRACT(line, 'BULLET')), '[()]', '', 'g') AS mark FROM x),
    z AS (SELECT y.*, CASE WHEN line <> '' THEN COALESCE(k.name, a.name, CASE WHEN few AND up AND NOT code THEN '' END) END AS event, CASE WHEN REGEXP_MATCHES(mark, '^[A-Za-z]$') THEN 'a' ELSE REGEXP_REPLACE(mark, '\d+', '0', 'g') END AS shape,
        ARRAY_TO_STRING(LIST_FILTER(REGEXP_EXTRACT_ALL(line, '[\pL\pM\p{Nd}\p{Pc}]+'), LAMBDA w: LOWER(w) NOT IN (STOPS)), ' ') AS words
        FROM y LEFT JOIN (VALUES HEADINGS) AS k(h, name) ON k.h = head LEFT JOIN (VALUES HEADINGS) AS a(h, name) ON a.h = TRIM(REGEXP_EXTRACT(head, ':\s*(.+)$', 1))),
    w AS (SELECT *, LAST_VALUE(event IGNORE NULLS) OVER o AS sect, LAST_VALUE(CASE WHEN event = 'description' THEN up END IGNORE NULLS) OVER o AS head_up, LAST_VALUE(CASE WHEN event = 'description' THEN shape END IGNORE NULLS) OVER o AS head_shape FROM z WINDOW o AS (PARTITION BY document_id ORDER BY pos)),
    v AS (SELECT *, COALESCE(event, CASE WHEN sect = 'description' AND NOT (LOWER(line) IN (INNER_) OR REPLACE(LOWER(line), ':', '') IN (INNER_) OR code) AND ((shape <> '' AND shape = head_shape) OR (line <> '' AND few AND (UPPER_WORDS
        OR (NOT head_up AND ((REGEXP_MATCHES(words, '\p{Lu}') AND NOT REGEXP_MATCHES(words, '(^|[^\pL])\p{Ll}') AND NOT REGEXP_MATCHES(words, '\pL\p{Lu}')) OR LOWER(words) IN ('academic objectives', 'learning outcomes')))))) THEN '' END) AS ev FROM w),
    u AS (SELECT *, LAST_VALUE(ev IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY pos) AS section FROM v),
    i AS (SELECT *, LAG(line) OVER (PARTITION BY document_id, section ORDER BY pos) AS prev, REGEXP_MATCHES(line, 'BULLET') AS bulleted FROM u WHERE ev IS NULL AND section <> '' AND line <> ''),
    j AS (SELECT *, CASE WHEN prev IS NOT NULL AND NOT bulleted AND (REGEXP_MATCHES(line, '^\p{Ll}') OR REGEXP_MATCHES(prev, '[,-]$')) THEN 0 ELSE 1 END AS begins FROM i),
    g AS (SELECT *, SUM(begins) OVER (PARTITION BY document_id, section ORDER BY pos) AS item FROM j),
    f AS (SELECT document_id, section, item, STRING_AGG(CASE WHEN begins = 1 THEN REGEXP_REPLACE(line, 'BULLET', '') ELSE line END, ' ' ORDER BY pos) AS text FROM g GROUP BY 1, 2, 3),
    e AS (SELECT document_id, section, STRING_AGG(text, CHR(10) ORDER BY item) AS items FROM f GROUP BY 1, 2)
    SELECT doc_id AS document_id, """.replace("BEFORE", _AROUND[0])
    .replace("AFTER", _AROUND[1])
    .replace("BLANK", _BLANK)
    .replace("BULLET", Y.BULLET)
    .replace("STOPS", _STOPS)
    .replace("HEADINGS", _HEADINGS)
    .replace("INNER_", _INNER)
    .replace("UPPER_LINE", _WORDS_UPPER.replace("{x}", "line"))
    .replace("UPPER_WORDS", _WORDS_UPPER.replace("{x}", "words"))
    + ", ".join(f"COALESCE((SELECT items FROM e WHERE e.document_id = doc_id AND section = '{n}'), '') AS {n}" for n in Y.SECTIONS)
    + " FROM {documents}"
)


def _made_up(t: Star):
    """Syllabi around each document."""
    return t.documents.select(F.col("doc_id").alias("document_id"), F.concat(F.lit(_AROUND[0]), "text", F.lit(_AROUND[1])).alias("text"))


@query()
def syllabus_sections(t: Star):
    """Sections as lists; section_texts has the same with SQL."""
    return O.sections(_made_up(t))


@query(_SECTIONS)
def section_texts(t: Star):
    """Sections of made-up syllabi around each document, their items in lines."""
    found = O.sections(_made_up(t))
    return found.select("document_id", *[F.array_join(n, "\n").alias(n) for n in Y.SECTIONS])


def _table_rows(rows: list[tuple[int, int, Column]]) -> Column:
    """Columns table, row and cells, a row for each of rows."""
    return F.inline(F.array(*[F.struct(F.lit(table).alias("table"), F.lit(row).alias("row"), cells.alias("cells")) for table, row, cells in rows]))


_NTH = "n AS (SELECT course_id, topic, ROW_NUMBER() OVER (PARTITION BY course_id ORDER BY position) AS i, COUNT(*) OVER (PARTITION BY course_id) AS k FROM {course_topics})"


@query(f"WITH {_NTH} SELECT DISTINCT course_id AS document_id, topic FROM n WHERE (course_id % 5 <> 2 OR k >= 2) AND (course_id % 5 <> 4 OR i = 1 OR k >= 3)")
def schedule_topics(t: Star):
    """Topics from tables: plain, with headings over two rows, a column to the right of their heading, listed in one cell,
    and going on over pages past a table of assessments. A table of one row is none, nor is one topic beside its heading enough to move a column.
    """
    by = Window.partitionBy("course_id")
    topics = t.course_topics.select("course_id", "topic", F.row_number().over(by.orderBy("position")).alias("i"))
    week, kind = F.col("i").cast("string"), F.col("course_id") % 5
    cell = lambda *c: F.array(*[x if isinstance(x, Column) else F.lit(x) for x in c])
    body = topics.where(kind != 3).select("course_id", F.when((kind == 4) & (F.col("i") > 1), 2).otherwise(1).alias("page"), (F.col("i") + 10).alias("row"), F.when(kind == 2, cell(week, "", F.col("topic"))).when(kind == 4, cell(week, F.col("topic"))).otherwise(cell(week, F.col("topic"), F.lit(None))).alias("cells"))
    one = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", "topic"))), lambda x: F.concat(x["i"].cast("string"), F.lit(". "), x["topic"])), "\n")
    listed = topics.where(kind == 3).groupBy("course_id").agg(one.alias("all")).select("course_id", F.lit(1).alias("page"), F.lit(11).alias("row"), cell("1", F.col("all"), F.lit(None)).alias("cells"))
    courses = topics.select("course_id").distinct()
    heads = F.when(kind == 1, F.array(cell("", "Learning", ""), cell("Week", "Topics*", "Notes"))).when(kind == 4, F.array(cell("Week", "Topic"))).otherwise(F.array(cell("Week", "Topic", "")))
    head = courses.select("course_id", F.lit(1).alias("page"), F.posexplode(heads).alias("row", "cells"))
    schedule = head.unionByName(body).unionByName(listed).withColumn("table", F.lit(1))
    others = [(0, 0, cell("Item", "Weight")), (0, 1, cell("Essay on soils", "40%")), (2, 0, cell("Item", "Weight")), (2, 1, cell("Essay on soils", "40%")), (3, 0, cell("1", "Lost topic here")), (3, 1, cell("2", "Another lost one"))]
    beside = courses.select("course_id", F.lit(1).alias("page"), _table_rows(others))
    rows = schedule.unionByName(beside).select(F.col("course_id").alias("document_id"), "page", "table", "row", "cells")
    return D.schedule_topics(rows)


@query("SELECT course_id AS document_id, a_method AS name, weight FROM {assessment_methods}")
def assessment_tables(t: Star):
    """Assessments of tables with merged cells and two entries in some rows, beside other tables and text that adds up."""
    i = F.row_number().over(Window.partitionBy("course_id").orderBy("a_method_id"))
    rows = t.assessment_methods.select("course_id", "a_method", F.concat(F.col("weight").cast("int").cast("string"), F.lit("%")).alias("share"), F.floor(i / 2).cast("int").alias("row"), i.alias("i"))
    lines = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("i", F.col(c).alias("x")))), lambda r: r["x"]), "\n")
    body = rows.groupBy("course_id", "row").agg(F.array(lines("a_method"), F.lit(None).cast("string"), lines("share")).alias("cells")).select("course_id", F.lit(1).alias("table"), (F.col("row") + 1).alias("row"), "cells")
    courses = rows.select("course_id").distinct()
    cell = lambda *c: F.array(*[F.lit(x).cast("string") for x in c])
    others = [(0, 0, cell("Week", "Topic")), (0, 1, cell("1", "50% of it")), (1, 0, cell("Component", None, "Weight")), (1, 9999, cell("Total", "", "100%"))]
    head = courses.select("course_id", _table_rows(others))
    tables = head.unionByName(body).select(F.col("course_id").alias("document_id"), F.lit(2).alias("page"), "table", "row", "cells")
    text = F.create_map(F.lit(1), F.lit("Essay 30%"), F.lit(3), F.lit("Quiz 50%\nTest 50%"))
    pages = courses.select(F.col("course_id").alias("document_id"), F.explode(text).alias("page_number", "text"))
    return G.assessments_of(pages, tables).select("document_id", "name", "weight")


@query("SELECT p_partkey AS document_id, 'Smith, J. 2020. ' || p_name || ' of the north. Springer.' AS name, 'book' AS type, 'Required Readings' AS description FROM {part}")
def syllabus_citations(t: Star):
    """A citation of each part's name, wrapped after any of its words, between other lines."""
    whole = F.split(F.concat(F.lit("Smith, J. 2020. "), "p_name", F.lit(" of the north. Springer.")), " ")
    at = 4 + F.col("p_partkey") % (F.size(whole) - 4)
    cited = F.concat(F.array_join(F.slice(whole, 1, at), " "), F.lit("\n"), F.array_join(F.slice(whole, at + 1, F.size(whole)), " "))
    text = F.concat(F.lit("Course Policies\nNo. 2020. 1 x\nRequired Readings:\nStudents can access all of these.\n"), cited, F.lit("\n\nsome more words\nUniversity Policies\nJones, K. 2021. Not this."))
    return O.materials(t.part.select(F.col("p_partkey").alias("document_id"), text.alias("text"))).select("document_id", "name", "type", "description")


#: Parts of pages that name months, years and terms, and some that only look like it.
_DATED = ["may I ask", "Rainfall in", "Sept 3, 2021", "January 2022", "on news1 and windows1", "Winter Term 2", "Fall 2020", "May 2021,", "2023_S2", "Term 1 2024", "in the fall"]
_MONTH_ROWS = ", ".join(f"({i}, '\\b(?:{full}{'|' + short if short else ''})\\b')" for i, (full, short) in enumerate(Y.MONTH_NAMES.items(), 1))


@query(rf"""WITH d AS (SELECT p_partkey AS id, [{', '.join(chr(39) + x + chr(39) for x in _DATED)}] AS k FROM {{part}}),
    t AS (SELECT id, k[id % 11 + 1] || '; ' || k[id // 11 % 11 + 1] || '; ' || k[id // 121 % 11 + 1] AS x FROM d),
    n AS (SELECT id, x, UPPER(REGEXP_EXTRACT(x, '(?i)(Fall[ _]?20\d{{2}}|Winter[ _]?Term[ _]?[12]|20\d{{2}}[ _]?[WS][ _]?[12]|Term[ ]?[12][ ]?20\d{{2}})')) AS named, REGEXP_EXTRACT_ALL(x, '20\d{{2}}') AS years FROM t),
    m AS (SELECT id, i, ROW_NUMBER() OVER (PARTITION BY id ORDER BY c DESC, i) AS r, c FROM (SELECT id, i, LEN(REGEXP_EXTRACT_ALL(x, p)) AS c FROM t, (VALUES {_MONTH_ROWS}) AS v(i, p)) AS q),
    y AS (SELECT id, y, c, ROW_NUMBER() OVER (PARTITION BY id ORDER BY c DESC, f) AS r FROM (SELECT id, y, COUNT(*) AS c, MIN(pos) AS f FROM (SELECT id, UNNEST(years) AS y, UNNEST(RANGE(LEN(years))) AS pos FROM n) AS q GROUP BY 1, 2) AS q2),
    b AS (SELECT n.id, named, REGEXP_EXTRACT(named, '20\d{{2}}') AS own, CAST(y.y AS INT) AS best, m.i AS month, m.c, LIST_CONTAINS(years, CAST(CAST(y.y AS INT) + 1 AS VARCHAR)) AS next_too FROM n LEFT JOIN m ON m.id = n.id AND m.r = 1 LEFT JOIN y ON y.id = n.id AND y.r = 1),
    s AS (SELECT *, REGEXP_REPLACE(REGEXP_REPLACE(named, '20\d{{2}}', ''), '[ _]', '', 'g') AS bare FROM b),
    w AS (SELECT *, CASE WHEN bare = 'FALL' THEN 'Winter Term 1' WHEN bare LIKE 'S%' THEN 'Summer Term ' || RIGHT(bare, 1) WHEN bare <> '' THEN 'Winter Term ' || RIGHT(bare, 1) END AS term FROM s)
    SELECT id, CASE WHEN own <> '' OR (named <> '' AND best IS NOT NULL) THEN term WHEN c = 0 OR month < 5 THEN 'Winter Term 2' WHEN month > 8 THEN 'Winter Term 1' WHEN month < 7 THEN 'Summer Term 1' ELSE 'Summer Term 2' END AS term,
        CAST(CASE WHEN own <> '' THEN CAST(own AS INT) WHEN named <> '' THEN best WHEN c > 0 AND month < 5 AND NOT next_too THEN best - 1 ELSE best END AS INT) AS year FROM w""")
def syllabus_named_terms(t: Star):
    """Terms of pages that name months, years and terms, and words that only look like them."""
    parts = F.array(*map(F.lit, _DATED))
    pick = lambda by: F.get(parts, (F.call_function("div", "p_partkey", F.lit(by)) % len(_DATED)).cast("int"))
    text = F.concat_ws("; ", pick(1), pick(11), pick(121))
    return spread(t.part).select(F.col("p_partkey").alias("id"), Y.term_of_pages(F.lit("syllabus.pdf"), F.array(text)).alias("t")).select("id", "t.term", "t.year")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN 'Syllabus of ' || p_brand ELSE p_name END AS title FROM {part}")
def syllabus_titles(t: Star):
    """Titles that stand twice where titles stand, after the code, or nowhere, so that the first line serves."""
    named = F.concat(F.lit("7\nSyllabus\nCourse Title: Other\nFRST 200: "), "p_name", F.lit(" \nmore\nFRST 200: "), "p_name", F.lit(" \nend"))
    dashed = F.concat(F.lit("Course Title: code and section number\nx\nCourse Name: "), "p_name", F.lit("!\n"))
    none = F.concat(F.lit("\n12\n Syllabus of "), "p_brand", F.lit(" \nmore"))
    kind = F.col("p_partkey") % 3
    text = F.when(kind == 0, none).when(kind == 1, named).otherwise(dashed)
    return spread(t.part).select(F.col("p_partkey").alias("id"), Y.course_title(text, F.lit("FRST"), F.lit("200")).alias("title"))


@query("SELECT conv_id AS document_id, UPPER(role) AS value FROM (SELECT conv_id, role, ROW_NUMBER() OVER (PARTITION BY conv_id ORDER BY COUNT(*) DESC, MIN(turn)) AS r FROM {conversations} GROUP BY conv_id, role) AS x WHERE r = 1")
def most_frequent_role(t: Star):
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role"))), lambda x: x["role"]), " ")
    return Y.most_frequent(t.conversations.groupBy(F.col("conv_id").alias("document_id")).agg(joined.alias("text")), r"(\w+)")


@query("WITH b AS (SELECT conv_id AS document_id, turn, role, turn % 3 = 0 AS top, turn % 3 = 1 AS bottom FROM {conversations}), p AS (SELECT document_id, COUNT(DISTINCT turn) AS pages FROM b GROUP BY 1), r AS (SELECT DISTINCT b.document_id, role FROM b JOIN p ON p.document_id = b.document_id WHERE top OR bottom GROUP BY b.document_id, role, top, pages HAVING COUNT(*) >= FLOOR(pages * 0.8)) SELECT b.document_id, turn, role FROM b WHERE NOT EXISTS (SELECT 1 FROM r WHERE r.document_id = b.document_id AND r.role = b.role)")
def blocks_without_headers(t: Star):
    blocks = t.conversations.select(F.col("conv_id").alias("document_id"), F.col("turn").alias("page_number"), "turn", F.col("role").alias("text"), (F.col("turn") % 3 == 0).alias("top"), (F.col("turn") % 3 == 1).alias("bottom"))
    return Y.without_headers(blocks).select("document_id", "turn", F.col("text").alias("role"))


@query("SELECT course_material_id AS document_id, CASE WHEN name LIKE '%7%' THEN 'book' WHEN type = 'slides' THEN 'slides' WHEN type = 'article' THEN 'article' ELSE 'book' END AS kind FROM {course_materials}")
def material_types(t: Star):
    named = F.concat_ws(" ", F.when(F.col("name").contains("7"), "A Springer text"), F.col("type"))
    return t.course_materials.select(F.col("course_material_id").alias("document_id"), Y.material_type(named, F.lit("")).alias("kind"))


_PAGES = "lines AS (SELECT conv_id AS document_id, CAST(turn // 3 AS INT) AS page_number, CAST(turn % 3 AS INT) AS line, TRIM(role) AS text, CAST((conv_id + turn) % 4 * 4 AS DOUBLE) AS size, CASE (conv_id + turn) % 3 WHEN 0 THEN TRUE WHEN 1 THEN FALSE END AS bold FROM {conversations})"


def _pages(t: Star):
    c = F.col
    size, mark = ((c("conv_id") + c("turn")) % 4 * 4).cast("double"), (c("conv_id") + c("turn")) % 3
    line = F.struct((c("turn") % 3).alias("at"), F.concat(F.lit(" "), "role").alias("text"), size.alias("size"), F.when(mark == 0, True).when(mark == 1, False).alias("bold"))
    rows = t.conversations.groupBy(c("conv_id").alias("document_id"), F.floor(c("turn") / 3).cast("int").alias("page_number")).agg(F.array_sort(F.collect_list(line)).alias("lines"))
    return rows.withColumn("lines", F.transform("lines", lambda x: F.struct(x["text"], x["size"], x["bold"])))


@query(f"WITH {_PAGES} SELECT document_id, page_number, text FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY document_id, page_number ORDER BY size DESC, line) AS r FROM lines) AS x WHERE r = 1")
def page_titles(t: Star):
    return T.titles(_pages(t))


@query(f"WITH {_PAGES}, n AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY document_id, page_number ORDER BY line) - 1 AS place FROM lines) SELECT document_id, page_number, place AS line, text FROM n WHERE size >= 10 AND (bold OR bold IS NULL)")
def page_headings(t: Star):
    return T.headings(_pages(t)).withColumn("line", F.col("line").cast("long"))


@query("WITH f AS (SELECT course_id, topic, 1.0 AS score, 'match' AS source FROM {course_topics} WHERE position % 2 = 0), s AS (SELECT course_id, LOWER(topic) AS topic, 0.5 AS score, 'keyword' AS source FROM {course_topics}), b AS (SELECT course_id, topic, CAST(score AS DOUBLE) AS score, source, 0 AS l FROM f UNION ALL SELECT course_id, topic, CAST(score AS DOUBLE), source, 1 FROM s) SELECT course_id, topic, score, source FROM (SELECT *, ROW_NUMBER() OVER (PARTITION BY course_id, LOWER(TRIM(topic)) ORDER BY l, topic) AS r FROM b) AS x WHERE r = 1")
def topics_united(t: Star):
    first = t.course_topics.where("position % 2 = 0").select("course_id", "topic", F.lit(1.0).alias("score"), F.lit("match").alias("source"))
    second = t.course_topics.select("course_id", F.lower("topic").alias("topic"), F.lit(0.5).alias("score"), F.lit("keyword").alias("source"))
    return T.united([first, second], ["course_id"])


@query("SELECT p_partkey AS id, p_name || ' see  or . It' AS article, '. ' || chr(10) || p_name || '. ' || chr(10) || ' . ' || chr(10) || 'two!' || chr(10) || 'three' AS slides FROM {part}")
def texts_by_kind(t: Star):
    """Links and image names go; an article ends before its last references, a slide's bullets become sentences."""
    article = F.concat("p_name", F.lit(" see https://x.org/a.png or www.y.com/b. It"), F.lit(" References Citations z"))
    slides = F.concat(F.lit("\n"), "p_name", F.lit("\n jpg\n• two!\n- three"))
    cut = F.regexp_replace(T.before_references(T.before_references(T.clean_text(article))), r" $", "")
    return t.part.select(F.col("p_partkey").alias("id"), cut.alias("article"), T.slide_text(slides).alias("slides"))


@query("SELECT course_id AS document_id, UPPER(SUBSTRING(a_method, 1, 1)) || SUBSTRING(a_method, 2) AS name, weight FROM {assessment_methods}")
def syllabus_assessments(t: Star):
    """Assessments read back from a page of 'Name: weight%' lines for each course."""
    line = F.concat(F.upper(F.substring("a_method", 1, 1)), F.substring("a_method", 2, 100), F.lit(": "), F.col("weight").cast("long").cast("string"), F.lit("%"))
    pages = t.assessment_methods.groupBy(F.col("course_id").alias("document_id")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("a_method_id", line.alias("l")))), lambda x: x["l"]), "\n").alias("text"))
    return G.assessments_of(pages.withColumn("page_number", F.lit(1))).select("document_id", "name", "weight")


@query("SELECT course_id AS document_id, place, name, type, description FROM (SELECT course_id, name, type, REPLACE(description, '\u2013', '-') AS description, ROW_NUMBER() OVER (PARTITION BY course_id ORDER BY course_material_id) - 1 AS place FROM {course_materials}) AS x")
def syllabus_materials(t: Star):
    """Each material once, though it comes again without a description, and with notes that are none between."""
    order = F.row_number().over(Window.partitionBy("course_id").orderBy("course_material_id")) - 1
    rows = t.course_materials.select(F.col("course_id").alias("document_id"), order.cast("long").alias("place"), "name", "type", "description")
    again = rows.select("document_id", (F.col("place") + 10_000).alias("place"), F.concat(F.upper("name"), F.lit(":")).alias("name"), "type", F.lit("").alias("description"))
    notes = rows.select("document_id", (F.col("place") + 20_000).alias("place"), F.lit("Readings posted on Canvas").alias("name"), "type", "description")
    return Y.clean_materials(rows.unionByName(again).unionByName(notes)).select("document_id", "place", "name", "type", "description")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 12 < 4 THEN 'Winter Term 2' WHEN p_partkey % 12 > 7 THEN 'Winter Term 1' WHEN p_partkey % 12 < 6 THEN 'Summer Term 1' ELSE 'Summer Term 2' END AS term, CAST(CASE WHEN p_partkey % 12 < 4 THEN 2019 + p_partkey % 5 ELSE 2020 + p_partkey % 5 END AS INT) AS year FROM {part}")
def syllabus_term_and_year(t: Star):
    month = F.element_at(F.array(*[F.lit(m.capitalize()) for m in Y.MONTHS]), (F.col("p_partkey") % 12 + 1).cast("int"))
    text = F.concat(month, F.lit(" 3, "), (F.col("p_partkey") % 5 + 2020).cast("string"), F.lit(" and "), month, F.lit(" 9; August 1999"))
    return spread(t.part).select(F.col("p_partkey").alias("id"), Y.term_and_year(F.lit("syllabus.pdf"), text).alias("t")).select("id", "t.term", "t.year")


@query("SELECT course_id, TRIM(topic) AS topic FROM (SELECT DISTINCT course_id, CASE WHEN course_topic_id % 3 = 0 THEN topic ELSE SUBSTRING(topic, 1, LENGTH(topic) - 1) END AS topic FROM {course_topics}) AS x")
def syllabus_topics_cleaned(t: Star):
    """Topics with bullets, stars, joined notes and teachers around them, and entries of a schedule that are none."""
    c = F.col("course_topic_id")
    own = F.when(c % 3 == 0, F.col("topic")).otherwise(F.expr("substring(topic, 1, length(topic) - 1)"))
    dressed = F.when(c % 3 == 0, F.concat(F.lit("1. "), own, F.lit(" **"))).when(c % 3 == 1, F.concat(F.lit("• "), own, F.lit(" (Dr. X)"))).otherwise(F.concat(own, F.lit(" Workshop: bring it")))
    rows = t.course_topics.select("course_id", F.explode(F.array(dressed, F.lit("Week 1 - 2"), F.lit("Midterm exam"), F.lit("3)"))).alias("topic"))
    listed = rows.groupBy("course_id").agg(F.collect_list("topic").alias("topics"))
    return listed.select("course_id", F.explode(Y.clean_topics(F.col("topics"))).alias("topic"))


#: Names and descriptions of materials, and the type of each.
_KINDS = [("Smith, J. 2020. Soils.", "", "textbook"), ("Smith, J. 2020. Soils.", "course materials", "article"), ("Vice: a film", "", "video"), ("ArcGIS", "", "software"), ("Portal", "", "website"), ("A", "optional text", "text"), ("A Routledge volume", "", "book"), ("Soils, 3rd edition", "", "textbook"), ("lecture slides", "", "lecture slides"), ("Handheld", "calculator", "equipment"), ("x", "digital resources", "digital resource"), ("A documentary", "", "video"), ("case study 3", "", "case study"), ("podcast", "", "podcast"), ("x", "movie", "movie"), ("x", "", "course resource")]


@query("SELECT p_partkey AS id, CASE p_partkey % 16 " + " ".join(f"WHEN {i} THEN '{kind}'" for i, (_, _, kind) in enumerate(_KINDS)) + " END AS kind FROM {part}")
def material_kinds(t: Star):
    one = lambda k: F.element_at(F.array(*[F.lit(x[k]) for x in _KINDS]), (F.col("p_partkey") % 16 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), Y.material_type(one(0), one(1)).alias("kind"))


@query("SELECT p_partkey AS document_id, UNNEST(CASE WHEN p_partkey % 2 = 0 THEN [p_name, 'On ' || p_brand, 'three little words here'] ELSE [p_name, 'On ' || p_brand] END) AS topic FROM {part}")
def syllabus_text_topics(t: Star):
    """Topics in lines of a schedule: after leads, as plain lines, and as list items, one of them under its marker."""
    even = F.concat(F.lit("Course Schedule\nWeek\nModule 2: "), "p_name", F.lit("\nSep 5, On "), "p_brand", F.lit("\nthree little words here\nshort\nA whole sentence is no topic.\nUniversity Policies\n- none"))
    odd = F.concat(F.lit("Topics\n1. "), "p_name", F.lit("\n2.\nOn "), "p_brand", F.lit("\nthree little words here\nCONTACT\n3. none"))
    return O.text_topics(t.part.select(F.col("p_partkey").alias("document_id"), F.when(F.col("p_partkey") % 2 == 0, even).otherwise(odd).alias("text")))
