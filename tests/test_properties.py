"""Coverage properties that hold for any maps."""

from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st

from loomwork.operators import coverage as C
from loomwork.operators import program_map as M

CLO, PLO, LEVEL = st.integers(1, 8), st.integers(1, 3), st.integers(0, 3)


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(maps=st.sets(st.tuples(CLO, PLO, LEVEL), max_size=30), required=st.lists(st.sampled_from([0, 1, None]), min_size=4, max_size=4))
def test_counts_agree(spark, maps, required):
    make = spark.createDataFrame
    courses = make([(c, 9, r) for c, r in enumerate(required)], "course_id long, program_id long, course_required int")
    clos = make([(i, i % 5) for i in range(1, 9)], "l_outcome_id long, course_id long")  # course 4 is in no program
    plos = make([(p, 9) for p in (1, 2, 3)], "pl_outcome_id long, program_id long")
    levels = make([(9, 1, 1), (9, 2, 2)], "program_id long, map_scale_id long, position long")  # level 3 is not configured
    table = make(sorted(maps), "l_outcome_id long, pl_outcome_id long, map_scale_id long")
    facts = C.mapping_facts(plos, table, clos, courses, levels)
    whole = {r.pl_outcome_id: r for r in C.plo_coverage(facts).collect()}
    hist = C.histogram(plos, levels, facts).collect()
    assert len(whole) == 3 and len(hist) == 6
    for p, r in whole.items():
        covered = {c for c, q, s in maps if q == p and s in (1, 2) and c % 5 != 4}
        assert r.mapped_clo_count == len(covered)
        assert r.covering_course_count == len({c % 5 for c in covered}) >= r.required_course_count + r.non_required_course_count
        assert sum(h.mapped_clo_count for h in hist if h.pl_outcome_id == p) == r.mapped_clo_count + r.multi_level_mapping_count
        assert r.n_a_clo_count == len({c for c, q, s in maps if q == p and s == 0 and c % 5 != 4})
    scales = make([(i, a, a) for i, a in enumerate(["N/A", "I", "D", "A"])], "map_scale_id long, abbreviation string, colour string")
    pairs = M.program_pairs(table, clos, plos, courses)
    groups = {(r.pl_outcome_id, r.course_id): r.n for r in M.modes(M.frequency(pairs), scales).collect()}
    sizes: dict = {}
    for c, p, _ in maps:
        if c % 5 != 4:
            sizes[p, c % 5] = sizes.get((p, c % 5), 0) + 1
    assert groups.keys() == sizes.keys() and all(0 < groups[k] <= sizes[k] for k in sizes)
