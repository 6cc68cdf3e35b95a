"""Joins with many rows out: tasks by rows, and JSON made once for each text or list."""

import json

from loomwork.operators import blocks, course_reports
from loomwork.plans import registry
from loomwork.sources import sinks


def test_prompts(spark):
    """quotes, lines and braces in texts, null texts; the number of tasks is set."""
    texts = ['say "so"\n\\ {plo} é', None, ""]
    clos = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "course_id long, l_outcome_id long, l_outcome string")
    plos = spark.createDataFrame([(3, 7, "{clo}\t'x'"), (3, 8, None)], "program_id long, pl_outcome_id long, pl_outcome string")
    lines = sinks.prompt_lines(clos, plos, spark.createDataFrame([(1, 3)], "course_id long, program_id long"), "A {plo} \"B\" {clo}")
    found = {r.value for r in lines.collect()}
    want = [{"id": f"clo-{i}__plo-{p}"} | ({"inputs": f'A {q} "B" {t}'} if q is not None and t is not None else {}) for i, t in enumerate(texts) for p, q in ((7, "{clo}\t'x'"), (8, None))]
    assert sorted(map(repr, map(json.loads, found))) == sorted(map(repr, want)) and len(found) == 6
    assert lines.rdd.getNumPartitions() == blocks.TASKS


def test_prompts_without_parsing(spark):
    """id and inputs stand in columns of their own, as the line has them; the query parses no line."""
    texts = ['say "so"\n\\ {plo} \u2028 é', None, "", "\ttab\u0001"]
    clos = spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "course_id long, l_outcome_id long, l_outcome string")
    plos = spark.createDataFrame([(3, 7, "{clo}/'x'"), (3, 8, None)], "program_id long, pl_outcome_id long, pl_outcome string")
    rows = sinks.prompt_lines(clos, plos, spark.createDataFrame([(1, 3)], "course_id long, program_id long"), "A {plo} \"B\" {clo}").collect()
    assert len(rows) == 8 and sum(r.inputs is None for r in rows) == 5
    for r in rows:
        assert json.loads(r.value) == {"id": r.id} | ({"inputs": r.inputs} if r.inputs is not None else {})
    plan = registry.queries()["prompt_lines"](spark, "/root/testdata/sf0.01")._jdf.queryExecution().optimizedPlan().toString()
    assert "json" not in plan


def test_payloads(spark):
    """lists are put into payloads as JSON, nulls left out as before; the number of tasks is set."""
    clos = spark.createDataFrame([(1, 2, None), (1, 1, 'a"')], "course_id long, l_outcome_id long, clo_shortphrase string")
    plos = spark.createDataFrame([(3, 9, "p"), (3, 8, "q\n")], "program_id long, pl_outcome_id long, pl_outcome string")
    levels = spark.createDataFrame([(1, 3, 2), (2, 3, 1)], "map_scale_id long, program_id long, position long")
    scales = spark.createDataFrame([(1, "I", "t", "#"), (2, "D", "u", "#")], "map_scale_id long, abbreviation string, title string, colour string")
    made = course_reports.mapping_payload(clos, plos, levels, scales, spark.createDataFrame([(3, 1), (4, 1)], "program_id long, course_id long"))
    (row,) = made.collect()
    assert json.loads(row.payload) == {
        "clos": [{"l_outcome_id": 1, "clo_shortphrase": 'a"'}, {"l_outcome_id": 2}], "plos": [{"pl_outcome_id": 8, "pl_outcome": "q\n"}, {"pl_outcome_id": 9, "pl_outcome": "p"}],
        "scales": [{"position": 1, "abbreviation": "D", "title": "u"}, {"position": 2, "abbreviation": "I", "title": "t"}],
    }
    assert made.rdd.getNumPartitions() == blocks.TASKS


def test_lists_are_read_back_once(spark):
    """the query reads each list back before courses and programs meet, and parses nothing in a payload."""
    frame = registry.queries()["mapping_payload"](spark, "/root/testdata/sf0.001")
    plan = frame._jdf.queryExecution().optimizedPlan().toString()
    first = next(i for i, line in enumerate(plan.splitlines()) if "Join" in line)
    assert "from_json" in plan.lower() or "jsontostructs" in plan.lower()
    assert not any("json" in line.lower() for line in plan.splitlines()[:first])
    assert frame.count() > 0
