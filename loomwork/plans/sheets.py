"""Queries on sources, sinks and sheets (S-07, S-08, S-12 to S-18, A-30, A-57, W-08, E-08, N-25, N-32)."""

from pyspark.sql import Window
from pyspark.sql import functions as F

from loomwork.operators import program_map as M
from loomwork.operators import syllabus as Y
from loomwork.plans.registry import query
from loomwork.plans.star import Star
from loomwork.sources import files, sinks


@query("SELECT program_id, " + ", ".join(f"CAST(COALESCE(SUM(CASE WHEN abbreviation = '{a}' THEN 1 END), 0) AS BIGINT) AS {a.lower()}" for a in "IDA") + " FROM {mapping_scale_programs} p JOIN {mapping_scales} s ON s.map_scale_id = p.map_scale_id GROUP BY 1")
def chart_series(t: Star):
    rows = t.mapping_scale_programs.join(t.mapping_scales, "map_scale_id").withColumn("one", F.lit(1).cast("long"))
    return sinks.chart_series(rows, "program_id", "abbreviation", "one", ["I", "D", "A"]).toDF("program_id", "i", "d", "a")


@query("SELECT o_orderkey, o_totalprice FROM {orders} ORDER BY o_totalprice DESC, o_orderkey LIMIT 500")
def export_detail(t: Star):
    return sinks.detail(t.orders, [F.desc("o_totalprice"), F.col("o_orderkey")])[0].select("o_orderkey", "o_totalprice")


@query("SELECT p_partkey AS id, CASE WHEN p_partkey % 2 = 0 THEN '''=' || p_name ELSE p_name END AS cell FROM {part}")
def literal_cells(t: Star):
    cell = F.when(F.col("p_partkey") % 2 == 0, F.concat(F.lit("="), "p_name")).otherwise(F.col("p_name"))
    return t.part.select(F.col("p_partkey").alias("id"), sinks.literal(cell).alias("cell"))


_WORDS = "words AS (SELECT l_orderkey AS document_id, l_linenumber AS page_number, 0 AS block, 0 AS paragraph, l_suppkey % 2 AS line, l_partkey AS word, 'w' || CAST(l_partkey AS STRING) AS text, l_quantity * 2 AS confidence, CAST(l_suppkey % 4 * 50 + 50 AS DOUBLE) AS height FROM {lineitem})"


@query(f"WITH {_WORDS} SELECT document_id, page_number, line, STRING_AGG(text, ' ' ORDER BY word, text) AS text, MEDIAN(height) * 72 / 300 AS size FROM words WHERE confidence >= 40 GROUP BY 1, 2, 3")
def ocr_lines(t: Star):
    c = F.col
    words = t.lineitem.select(c("l_orderkey").alias("document_id"), c("l_linenumber").alias("page_number"), F.lit(0).alias("block"), F.lit(0).alias("paragraph"), (c("l_suppkey") % 2).alias("line"), c("l_partkey").alias("word"), F.concat(F.lit("w"), c("l_partkey").cast("string")).alias("text"), (c("l_quantity") * 2).alias("confidence"), (c("l_suppkey") % 4 * 50 + 50).cast("double").alias("height"))
    return files.ocr_lines(words).select("document_id", "page_number", "line", "text", "size")


@query("SELECT conv_id AS document_id, turn // 2 AS page_number, STRING_AGG(role, '|' ORDER BY turn) AS lines FROM {conversations} WHERE turn % 3 <> 2 GROUP BY 1, 2")
def cloud_ocr_pages(t: Star):
    blocks = t.conversations.select(F.col("conv_id").alias("document_id"), F.when(F.col("turn") % 3 == 2, "WORD").otherwise("LINE").alias("kind"), F.floor(F.col("turn") / 2).alias("page"), F.col("turn").alias("position"), F.col("role").alias("text"))
    return files.cloud_ocr_pages(blocks).withColumn("lines", F.array_join("lines", "|"))


@query("SELECT pl_outcome_id, program_id, plo_category, ROW_NUMBER() OVER (PARTITION BY program_id ORDER BY p.plo_category_id NULLS LAST, pl_outcome_id) AS place FROM {program_learning_outcomes} p LEFT JOIN {p_l_o_categories} c ON c.plo_category_id = p.plo_category_id")
def outcome_sheet(t: Star):
    order = Window.partitionBy("program_id").orderBy(F.col("plo_category_id").asc_nulls_last(), "pl_outcome_id")
    rows = t.program_learning_outcomes.join(t.p_l_o_categories, "plo_category_id", "left")
    return rows.select("pl_outcome_id", "program_id", "plo_category", F.row_number().over(order).cast("long").alias("place"))


@query("SELECT l_outcome_id, MAX(CASE WHEN plo_category = 'Knowledge' THEN 1 END) AS c0, MAX(CASE WHEN plo_category = 'Skills' THEN 1 END) AS c1, MAX(CASE WHEN plo_category = 'Attitudes' THEN 1 END) AS c2, MAX(CASE WHEN plo_category IS NULL THEN 1 END) AS c3 FROM {outcome_maps} m JOIN {program_learning_outcomes} p ON p.pl_outcome_id = m.pl_outcome_id LEFT JOIN {p_l_o_categories} c ON c.plo_category_id = p.plo_category_id WHERE map_scale_id <> 0 GROUP BY 1")
def outcome_pivot(t: Star):
    """The categories of the outcomes that each CLO maps to."""
    plos = t.program_learning_outcomes.join(t.p_l_o_categories, "plo_category_id", "left").select("pl_outcome_id", F.coalesce("plo_category", F.lit(M.UNCATEGORIZED)).alias("category"))
    rows = t.outcome_maps.where("map_scale_id <> 0").join(plos, "pl_outcome_id")
    return M.pivot_marks(rows, ["l_outcome_id"], F.col("category"), ["Knowledge", "Skills", "Attitudes", M.UNCATEGORIZED]).toDF("l_outcome_id", "c0", "c1", "c2", "c3")


@query("SELECT DISTINCT l_outcome_id, COALESCE(plo_shortphrase, pl_outcome) AS heading FROM {outcome_maps} m JOIN {program_learning_outcomes} p ON p.pl_outcome_id = m.pl_outcome_id WHERE map_scale_id <> 0")
def outcome_marks(t: Star):
    """The cells of the info table that hold a mark, whatever the number of outcomes."""
    rows = t.outcome_maps.where("map_scale_id <> 0").join(t.program_learning_outcomes.select("pl_outcome_id", "plo_shortphrase", "pl_outcome"), "pl_outcome_id")
    return M.marks(rows, ["l_outcome_id"], F.coalesce("plo_shortphrase", "pl_outcome"))


@query("SELECT DISTINCT p_size AS document_id, p_name AS name, CAST(LENGTH(p_name) AS STRING) AS description FROM {part}")
def distinct_materials(t: Star):
    rows = t.part.select(F.col("p_size").alias("document_id"), F.col("p_name").alias("name"), F.length("p_name").cast("string").alias("description"))
    shorter = rows.withColumn("description", F.lit(""))
    return Y.distinct_materials(rows.unionByName(shorter))


@query("SELECT course_id, position, topic FROM (SELECT p_partkey + 1 AS course_id, UNNEST([1, 2]) AS position, UNNEST([p_name, p_brand]) AS topic FROM {part}) AS x")
def syllabus_loaded_topics(t: Star):
    none = F.array().cast("array<string>")
    parsed = t.part.select((F.col("p_partkey") + 1).alias("course_id"), none.alias("description"), none.alias("goals"), F.array("p_name", "p_brand").alias("topics"), none.alias("materials"))
    return Y.load(parsed)["course_topics"].select("course_id", "position", "topic")


@query("SELECT p_partkey AS id, CASE p_partkey % 4 WHEN 0 THEN 'number' WHEN 1 THEN 'letter' WHEN 2 THEN '•' END AS kind FROM {part}")
def bullet_kinds(t: Star):
    sign = F.element_at(F.array(F.lit("1.2) "), F.lit("(a) "), F.lit("• "), F.lit("")), (F.col("p_partkey") % 4 + 1).cast("int"))
    return t.part.select(F.col("p_partkey").alias("id"), Y.bullet_kind(F.concat(sign, "p_name")).alias("kind"))


_LOADED = {
    "courses": "SELECT course_id, CASE WHEN course_id % 7 > 0 THEN course_code END AS course_code, CASE WHEN course_id % 7 > 0 THEN course_num END AS course_num, CASE WHEN course_id % 7 > 1 THEN CAST(year AS INT) END AS year, course_id % 7 = 0 AS bad FROM {courses}",
    "course_descriptions": "SELECT course_id, course_title || ' \"for\" all' AS course_description FROM {courses} WHERE course_id % 7 > 0",
    "learning_outcomes": "SELECT course_id, l_outcome FROM {learning_outcomes} WHERE course_id % 7 > 0 AND course_id IN (SELECT course_id FROM {courses})",
    "assessment_methods": "SELECT course_id, a_method, CASE WHEN a_method_id % 5 > 0 THEN weight END AS weight FROM {assessment_methods} WHERE course_id % 7 > 1",
    "course_topics": "SELECT course_id, topic FROM {course_topics} WHERE course_id % 7 > 0 AND course_topic_id % 4 > 0",
    "course_materials": "SELECT course_id, name, type, CASE WHEN course_material_id % 3 > 0 THEN description END AS description FROM {course_materials} WHERE course_id % 7 > 0 AND course_id IN (SELECT course_id FROM {courses})",
}


def _parsed(t: Star):
    """A parser's JSON for each course: cut off for some, with a list that is none, and fields of other kinds."""
    c = F.col
    listed = lambda df, x: df.groupBy("course_id").agg(F.collect_list(x).alias("x"))
    marks = listed(t.assessment_methods, F.concat(F.lit('["'), "a_method", F.lit('",'), F.when(c("a_method_id") % 5 > 0, c("weight").cast("string")).otherwise('"half"'), F.lit("]")))
    topics = listed(t.course_topics, F.when(c("course_topic_id") % 4 > 0, c("topic")).otherwise(""))
    goals = listed(t.learning_outcomes, "l_outcome")
    materials = listed(t.course_materials, F.struct("name", "type", F.when(c("course_material_id") % 3 > 0, c("description")).alias("description")))
    rows = t.courses
    for name, df in (("goals", goals), ("topics", topics), ("materials", materials), ("marks", marks)):
        rows = rows.join(df.withColumnRenamed("x", name), "course_id", "left")
    head = F.to_json(F.struct(c("course_code").alias("code"), c("course_num").alias("number"), c("course_title").alias("title"), F.concat("course_title", F.lit(' "for" all')).alias("description"), "goals", "topics", "materials"))
    more = F.concat(F.lit(', "year": '), F.when(c("course_id") % 7 > 1, c("year").cast("string")).otherwise('"soon"'), F.lit(', "assessments": '), F.when(c("course_id") % 7 > 1, F.concat(F.lit("["), F.coalesce(F.array_join("marks", ","), F.lit("")), F.lit("]"))).otherwise("7"), F.lit("}"))
    whole = F.concat(F.substring(head, F.lit(1), F.length(head) - 1), more)
    return rows.select("course_id", F.when(c("course_id") % 7 > 0, whole).otherwise(F.substring(whole, 1, 20)).alias("parsed"))


@query(_LOADED["courses"])
def parsed_courses(t: Star):
    return Y.load_parsed(_parsed(t))["courses"].select("course_id", "course_code", "course_num", "year", F.col("error").isNotNull().alias("bad"))


@query(_LOADED["course_descriptions"])
def parsed_descriptions(t: Star):
    return Y.load_parsed(_parsed(t))["course_descriptions"]


@query(_LOADED["learning_outcomes"])
def parsed_outcomes(t: Star):
    return Y.load_parsed(_parsed(t))["learning_outcomes"].select("course_id", "l_outcome")


@query(_LOADED["assessment_methods"])
def parsed_assessments(t: Star):
    return Y.load_parsed(_parsed(t))["assessment_methods"].select("course_id", "a_method", "weight")


@query(_LOADED["course_topics"])
def parsed_topics(t: Star):
    return Y.load_parsed(_parsed(t))["course_topics"].select("course_id", "topic")


@query(_LOADED["course_materials"])
def parsed_materials(t: Star):
    return Y.load_parsed(_parsed(t))["course_materials"].select("course_id", "name", "type", "description")
