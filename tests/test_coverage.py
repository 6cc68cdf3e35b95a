"""Hand-worked coverage cases."""

import pytest

from loomwork.operators import coverage as C

N_A, INTRO, DEVELOP, ADVANCE = 0, 1, 2, 3


@pytest.fixture(scope="module")
def star(spark):
    make = spark.createDataFrame
    return {
        "courses": make([(1,), (2,), (3,)], "course_id long"),
        "course_programs": make([(1, 9, 1), (2, 9, 0), (3, 9, None)], "course_id long, program_id long, course_required int"),
        "plos": make([(10, 9), (11, 9)], "pl_outcome_id long, program_id long"),
        "clos": make([(1, 1), (2, 2), (3, 3), (4, 1)], "l_outcome_id long, course_id long"),
        "levels": make([(9, DEVELOP, 1), (9, INTRO, 2), (9, ADVANCE, 3)], "program_id long, map_scale_id long, position long"),
        "maps": make([(1, 10, INTRO), (1, 10, DEVELOP), (2, 10, INTRO), (3, 10, DEVELOP), (4, 10, N_A)], "l_outcome_id long, pl_outcome_id long, map_scale_id long"),
    }


def facts(s, **changed):
    s = s | changed
    return C.mapping_facts(s["plos"], s["maps"], s["clos"], s["course_programs"], s["levels"])


def test_plo_coverage(star):
    rows = {r.pl_outcome_id: r for r in C.plo_coverage(facts(star)).collect()}
    r = rows[10]
    assert (r.mapped_clo_count, r.covering_course_count, r.required_course_count, r.non_required_course_count, r.n_a_clo_count, r.multi_level_mapping_count) == (3, 3, 1, 1, 1, 1)
    assert rows[11].mapped_clo_count == 0


def test_histogram_in_position_order(star):
    rows = C.histogram(star["plos"], star["levels"], facts(star)).where("pl_outcome_id = 10").orderBy("position").collect()
    assert [r.mapped_clo_count for r in rows] == [2, 2, 0]
    assert [r.covering_course_count for r in rows] == [2, 2, 0]
    assert [r.required_course_count for r in rows] == [1, 1, 0]
    assert [r.non_required_course_count for r in rows] == [0, 1, 0]


def test_removed_course_no_longer_covers(star):
    left = star["course_programs"].where("course_id <> 1")
    r = C.plo_coverage(facts(star, course_programs=left)).where("pl_outcome_id = 10").first()
    assert (r.mapped_clo_count, r.covering_course_count, r.required_course_count) == (2, 2, 0)


def test_completeness_counts_pairs_once_and_courses_without_clos(spark, star):
    rows = C.mapping_completeness(star["course_programs"], star["courses"], star["clos"].where("course_id <> 2"), star["plos"], star["maps"])
    got = {r.course_id: (r.expected, r.actual, r.missing, r.is_complete) for r in rows.collect()}
    assert got == {1: (4, 2, 2, False), 2: (2, 0, 2, False), 3: (2, 1, 1, False)}


def test_totals_keep_empty_courses(star):
    r = C.program_totals(star["course_programs"], star["courses"], star["clos"].where("course_id <> 2")).first()
    assert (r.course_count, r.clo_count) == (3, 3)


def test_bounds_are_inclusive_and_unrounded(spark):
    hist = spark.createDataFrame([(9, 10, 1, 1, 1, 0, 0)], "program_id long, pl_outcome_id long, map_scale_id long, mapped_clo_count long, covering_course_count long, required_course_count long, non_required_course_count long")
    totals = spark.createDataFrame([(9, 0, 3)], "program_id long, course_count long, clo_count long")
    status = lambda least, most: C.evaluate(hist, totals, spark.createDataFrame([("mapped_clo_count", 1, least, most)], "metric string, map_scale_id long, least int, most int")).where("metric = 'mapped_clo_count'").first().status
    assert status(33, None) == "within_expectations"
    assert status(34, None) == "gap"
    assert status(None, 33) == "redundancy"
    assert status(None, 34) == "within_expectations"
    assert status(None, None) == "no_expectation"
    other = C.evaluate(hist, totals, spark.createDataFrame([], "metric string, map_scale_id long, least int, most int")).where("metric = 'covering_course_count'").first()
    assert other.status == "not_applicable"


@pytest.mark.parametrize("bound", [C.Bound("x", 1), C.Bound("mapped_clo_count", 0), C.Bound("mapped_clo_count", 1, -1), C.Bound("mapped_clo_count", 1, 5, 4), C.Bound("mapped_clo_count", 1, 101)])
def test_bad_bounds(bound):
    with pytest.raises(ValueError):
        C.validated([bound], {0, 1})
