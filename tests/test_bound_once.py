"""Expressions that functions over arrays use again are computed once, and rows of small files go over all cores."""

import pytest
from pyspark.sql import functions as F

from loomwork.operators import syllabus, topics
from loomwork.plans import registry
from tests.conftest import SMALL


@pytest.mark.parametrize("make, costly, most", [
    (lambda t: topics.windows(t), "split(", 1),
    (lambda t: syllabus.course_title(t, F.lit("FRST"), F.lit("200")), "regexp_extract_all(", len(syllabus.TITLE_PATTERNS)),
    (lambda t: syllabus.term_and_year(F.lit("a.pdf"), t), "regexp_extract_all(", 1),
    (lambda t: syllabus.term_and_year(F.lit("a.pdf"), t), "regexp_count(", 12),
])
def test_computed_once(spark, make, costly, most):
    rows = spark.createDataFrame([("a",)], "text string")
    plan = rows.select(make(F.col("text")).alias("x"))._jdf.queryExecution().analyzed().toString()
    assert plan.count(costly) == most


@pytest.mark.parametrize("name", ["text_windows", "syllabus_titles", "syllabus_term_and_year", "syllabus_named_terms"])
def test_spread(spark, name):
    assert registry.queries()[name](spark, SMALL).rdd.getNumPartitions() > spark.sparkContext.defaultParallelism
