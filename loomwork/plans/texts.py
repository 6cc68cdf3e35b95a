"""Queries on scalar functions (N-02 to N-04, N-07, N-09, N-11 to N-13, N-17, N-18, N-38, X-15, X-16)."""

from pyspark.sql import functions as F

from loomwork.functions import text as X
from loomwork.plans.registry import query
from loomwork.plans.star import Star
from loomwork.sources import files


@query("SELECT p_partkey AS id, TRIM(REGEXP_REPLACE('  ' || p_name || '   x ', '\\s+', ' ', 'g')) AS squeezed, SUBSTRING(TRIM(REGEXP_REPLACE(LOWER('-' || p_name || ' & ' || p_brand), '[^a-z0-9]+', '-', 'g'), '-'), 1, 60) AS slug, REGEXP_REPLACE(p_brand, '[^A-Za-z0-9._-]+', '_', 'g') AS safe, REGEXP_REPLACE(p_brand, '[^A-Za-z0-9-]+', '-', 'g') AS job FROM {part}")
def names_made_safe(t: Star):
    c = F.col
    return t.part.select(c("p_partkey").alias("id"), X.squeezed(F.concat(F.lit("  "), c("p_name"), F.lit("   x "))).alias("squeezed"), X.slug(F.concat(F.lit("-"), c("p_name"), F.lit(" & "), c("p_brand"))).alias("slug"), X.safe_name(c("p_brand")).alias("safe"), X.job_name(c("p_brand")).alias("job"))


@query("SELECT page_id AS id, REPLACE(REPLACE(REPLACE(REPLACE(REPLACE(REPLACE('<mark>' || url || '</mark> & <b>', '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;'), '&lt;mark&gt;', '<mark>'), '&lt;/mark&gt;', '</mark>') AS escaped FROM {pages}")
def marked_escaped(t: Star):
    return t.pages.select(F.col("page_id").alias("id"), X.escaped(F.concat(F.lit("<mark>"), "url", F.lit("</mark> & <b>"))).alias("escaped"))


@query("SELECT user_id, SPLIT_PART(email, '@', 1) AS local, SPLIT_PART(email, '@', 2) AS domain FROM {users}")
def email_parts(t: Star):
    return t.users.select("user_id", X.email_parts(F.col("email")).alias("p")).select("user_id", "p.local", "p.domain")


@query("SELECT event_id AS id, CAST(props ->> '$.k' AS BIGINT) AS k FROM {events}")
def event_properties(t: Star):
    return t.events.select(F.col("event_id").alias("id"), F.from_json("props", "struct<k:bigint>")["k"].alias("k"))


@query("SELECT p_partkey AS id, 'b' || CAST(p_partkey % 3 AS STRING) AS bucket, 'jobs/' || p_name AS key FROM {part}")
def uri_parts(t: Star):
    uri = F.concat(F.lit("s3://b"), (F.col("p_partkey") % 3).cast("string"), F.lit("/jobs/"), F.col("p_name"))
    return t.part.select(F.col("p_partkey").alias("id"), files.split_uri(uri).alias("u")).select("id", "u.bucket", "u.key")


@query("SELECT c_custkey AS id, c_custkey % 3 = 0 AS upper, c_custkey % 3 = 1 AS title FROM {customer}")
def letter_cases(t: Star):
    word = F.when(F.col("c_custkey") % 3 == 0, F.upper("c_mktsegment")).when(F.col("c_custkey") % 3 == 1, F.initcap("c_mktsegment")).otherwise(F.lower("c_mktsegment"))
    return t.customer.select(F.col("c_custkey").alias("id"), X.upper_case(word).alias("upper"), X.title_case(word).alias("title"))


@query("SELECT program_id, 'courses' AS view, 'A1,B2' AS codes, CAST(program_id AS STRING) || ',' || CAST(program_id + 1 AS STRING) AS programs FROM {programs}")
def saved_presets(t: Star):
    saved = F.concat(F.lit('{"course_codes": ["b2 ", "A1", "a1"], "program_ids": ['), (F.col("program_id") + 1).cast("string"), F.lit(", "), F.col("program_id").cast("string"), F.lit("]}"))
    p = t.programs.select("program_id", X.preset(saved).alias("p"))
    return p.select("program_id", "p.view", F.array_join("p.course_codes", ",").alias("codes"), F.array_join(F.col("p.program_ids").cast("array<string>"), ",").alias("programs"))
