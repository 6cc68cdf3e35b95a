"""Maps meet courses of programs in a set number of tasks, and are counted there."""

import pytest

from loomwork.operators import blocks, course_reports, coverage, program_map

MAPS = [(1, 10, 0), (1, 10, 2), (2, 10, 1), (2, 11, 1), (3, 12, 3), (3, 12, 0), (4, 12, 2), (9, 10, 1), (5, 13, 1)]


@pytest.fixture(scope="module")
def star(spark):
    make = spark.createDataFrame
    return {
        "maps": make(MAPS, "l_outcome_id long, pl_outcome_id long, map_scale_id long"),
        "clos": make([(1, 1), (2, 1), (3, 2), (4, 3), (5, 8)], "l_outcome_id long, course_id long"),
        "plos": make([(10, 7, 1), (11, 7, None), (12, 8, 2), (13, 8, None), (14, None, None)], "pl_outcome_id long, program_id long, plo_category_id long"),
        "course_programs": make([(1, 7, 1), (1, 8, 1), (2, 8, 0), (3, 7, 1)], "course_id long, program_id long, course_required int"),
        "levels": make([(p, s, s) for p in (7, 8) for s in (1, 2, 3)], "program_id long, map_scale_id long, position long"),
        "scales": make([(0, "N/A", "w"), (1, "I", "b"), (2, "D", "c"), (3, "A", "d")], "map_scale_id long, abbreviation string, colour string"),
    }



def pairs(s):
    return program_map.program_pairs(s["maps"], s["clos"], s["plos"], s["course_programs"])


def test_cells_are_made_where_pairs_meet(star):
    """The number of tasks is set, and grouping needs no other."""
    freq = program_map.frequency(pairs(star))
    for out in (program_map.one_level(pairs(star)), freq, program_map.by_abbreviation(freq, star["scales"]), program_map.modes(freq, star["scales"])):
        assert out.rdd.getNumPartitions() == blocks.TASKS
    found = sorted(tuple(r) for r in program_map.modes(freq, star["scales"]).collect())
    assert found == [(7, 10, 1, "N/A / D / I", "#FFFFFF", 1), (7, 11, 1, "I", "b", 1), (8, 12, 2, "N/A / A", "#FFFFFF", 1)]


def test_outcomes_are_numbered_before_they_get_cells(star):
    """no window sorts cells."""
    categories = star["plos"].sparkSession.createDataFrame([(1, "K"), (2, "S")], "plo_category_id long, plo_category string")
    out = program_map.outcome_map_sheet(program_map.modes(program_map.frequency(pairs(star)), star["scales"]), star["plos"], categories, "label")
    rows = {r.pl_outcome_id: (r.program_id, r.place, r.category, r.heading, [tuple(c) for c in r.cells]) for r in out.collect()}
    assert rows == {10: (7, 1, "K", True, [(1, "N/A / D / I")]), 11: (7, 2, "Uncategorized", True, [(1, "I")]), 12: (8, 1, "S", True, [(2, "N/A / A")]), 13: (8, 2, "Uncategorized", True, []), 14: (None, 1, "Uncategorized", True, [])}
    assert "Window" not in out._jdf.queryExecution().optimizedPlan().toString().partition("Join")[0]


def test_coverage_groups_current_facts_only(star):
    """Facts meet courses by an inner join in set tasks; PLOs without any, or without a program, stay."""
    facts = coverage.mapping_facts(star["plos"], star["maps"], star["clos"], star["course_programs"], star["levels"])
    assert facts.rdd.getNumPartitions() == blocks.TASKS
    for out in (coverage.plo_coverage(facts), coverage.plo_coverage(facts, star["plos"])):
        rows = {tuple(r)[1]: tuple(r)[2:] for r in out.where("program_id is not null").collect()}
        assert rows == {10: (2, 1, 1, 0, 1, 0), 11: (1, 1, 1, 0, 0, 0), 12: (1, 1, 0, 1, 1, 0), 13: (0, 0, 0, 0, 0, 0)}
        assert [tuple(r)[1:] for r in out.where("program_id is null").collect()] == [(14, 0, 0, 0, 0, 0, 0)]
    plan = coverage.plo_coverage(facts, star["plos"])._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("RepartitionByExpression [program_id") == 2 and plan.count("Join LeftOuter") == 2  # PLOs without counts, levels not configured
    hist = coverage.histogram(star["plos"], star["levels"], facts)
    assert {(r.pl_outcome_id, r.map_scale_id): r.mapped_clo_count for r in hist.where("mapped_clo_count > 0").collect()} == {(10, 1): 1, (10, 2): 1, (11, 1): 1, (12, 3): 1}


def test_parts_without_expansion(star):
    """counts of a course's programs are added, no map is expanded for distinct counts."""
    make = star["maps"].sparkSession.createDataFrame
    maps = pairs(star).select("course_id", "program_id", "pl_outcome_id", "l_outcome_id", "map_scale_id")
    maps = maps.unionByName(make([(1, 8, 12, 1, 1)], "course_id long, program_id long, pl_outcome_id long, l_outcome_id long, map_scale_id long"))
    none = [make([], x) for x in ("course_id long, standard_id long, standard_scale_id long", "course_id long, op_id long", "op_id long, subcat_name string")]
    out = course_reports.course_parts(make([(1,), (2,), (3,)], "course_id long"), maps, star["plos"], *none)
    assert sorted(tuple(r)[:4] for r in out.collect()) == [(1, 2, 4, 2), (2, 1, 1, 1), (3, 0, 0, 0)]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Expand") <= 1  # of standards, a count of one column, none at all
