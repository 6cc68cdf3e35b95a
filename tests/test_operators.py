"""Hand-worked cases of the other operators."""

from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from loomwork.functions import english, text
from loomwork.operators import access, assessments, etl, evaluation, grids, outline, program_map, progression, search, syllabus, topics
from loomwork.sources import files, sinks
from loomwork.streaming import jobs


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


@pytest.mark.parametrize("clo, hit", [("Retrace traced traces étrace", False), ("“TRACE,” he said", True), ("trace_it", False), ("re-trace", True), ("traceé", False), (None, False)])
def test_whole_terms_with_unicode_edges(spark, clo, hit):
    clos = spark.createDataFrame([(1, clo)], "l_outcome_id long, l_outcome string")
    verbs = spark.createDataFrame([(1, "Trace"), (1, " trace "), (2, "test+check"), (3, "")], "level_id long, verb string")
    assert len(progression.classify(clos, verbs).first().matches) == int(hit)


def test_terms_over_line_breaks_first_spelling_and_position(spark, monkeypatch):
    clos = spark.createDataFrame([(1, "They set\n up and\u00a0 TEST+check it"), (2, "nothing"), (3, None), (1, "setup + test")], "l_outcome_id long, l_outcome string")
    verbs = spark.createDataFrame([(1, "set  up", 1), (1, "Set up", 0), (2, "test+check", 0), (2, "and", 1), (3, "+", 0), (3, "(", 1)], "level_id long, verb string, place long")
    levels = spark.createDataFrame([(1, 2), (2, 1), (3, 3)], "level_id long, position int")
    rows = lambda: [(r.l_outcome_id, r.matches and [tuple(m) for m in r.matches]) for r in progression.classify(clos, verbs, levels).orderBy("l_outcome_id", F.length("l_outcome")).collect()]
    few = rows()
    assert few == [(1, [(3, "+")]), (1, [(2, "test+check"), (2, "and"), (1, "Set up")]), (2, []), (3, [])]
    monkeypatch.setattr(progression, "LITERAL_TERMS", 2)
    assert rows() == few, "many terms are joined, with equal results"


def test_no_reference_is_not_no_match(spark):
    clos = spark.createDataFrame([(1, 1, "x")], "l_outcome_id long, course_id long, l_outcome string")
    rows = progression.classify(clos, spark.createDataFrame([], "level_id long, verb string"))
    assert rows.first().matches is None


@pytest.mark.parametrize("number, level", [("101A", "100"), ("999", "900"), ("2000", "other"), ("012", "other"), (None, "other"), ("20", "other")])
def test_course_level(spark, number, level):
    assert one(spark, progression.course_level(F.lit(number).cast("string"))) == level


def test_percent_rounds_half_up_from_integers(spark):
    p = lambda n, d: one(spark, progression.percent(F.lit(n), F.lit(d)))
    assert (p(1, 3), p(2, 3), p(1, 8), p(0, 5), p(1, 0)) == (33.33, 66.67, 12.5, 0.0, None)


def test_mode_ties_in_first_seen_order(spark):
    pairs = spark.createDataFrame([(9, 10, 1, 1, 5, 2), (9, 10, 1, 1, 6, 1), (9, 10, 2, 1, 7, 1), (9, 10, 2, 1, 8, 1), (9, 10, 2, 1, 9, 3)], "program_id long, pl_outcome_id long, course_id long, course_required int, l_outcome_id long, map_scale_id long")
    scales = spark.createDataFrame([(1, "I", "#1"), (2, "D", "#2"), (3, "A", "#3")], "map_scale_id long, abbreviation string, colour string")
    got = {r.course_id: (r.label, r.colour) for r in program_map.modes(program_map.frequency(pairs), scales).collect()}
    assert got == {1: ("D / I", "#FFFFFF"), 2: ("I", "#1")}
    assert {r.course_id: r.dominant for r in program_map.dominant(pairs, scales).collect()} == {1: "D", 2: "A"}


def test_final_joins_final_exam_only_where_both_are(spark):
    methods = spark.createDataFrame([(1, "final"), (1, "final Exam"), (2, "Final")], "course_id long, a_method string")
    programs = spark.createDataFrame([(1, 1), (2, 2)], "program_id long, course_id long")
    got = {(r.program_id, r.method): r.n for r in program_map.assessment_frequency(methods, programs).collect()}
    assert got == {(1, "Final Exam"): 2, (2, "Final"): 1}


def test_ucwords_leaves_the_rest(spark):
    assert one(spark, program_map.ucwords(F.lit("final EXAM  x"))) == "Final EXAM  X"


@pytest.mark.parametrize("word, root", [("running", "run"), ("relational", "relat"), ("hopping", "hop"), ("hoping", "hope"), ("generously", "generous"), ("skies", "sky"), ("kneeled", "kneel"), ("ponies", "poni"), ("ties", "tie"), ("happy", "happi"), ("consignment", "consign"), ("knots", "knot")])
def test_stems(word, root):
    assert english.stem(word) == root


@pytest.mark.parametrize("query, hit", [("water fire", True), ("water ice", False), ('"water and fire"', True), ('"fire water"', False), ("ice OR fire", True), ("water -fire", False), ("", False), ("-fire", False)])
def test_web_search(spark, query, hit):
    assert one(spark, english.matches(english.words(F.lit("Water and FIRE.")), query)) is hit


def test_stemmed_search_and_snippet(spark):
    rows = spark.createDataFrame([("The runner was running <b>far</b>",)], "t string")
    tokens = english.stems(english.words(F.col("t")))
    assert rows.select(english.matches(tokens, "runs", stemmed=True).alias("x")).first().x
    assert rows.select(english.headline(F.col("t"), tokens, english.wanted_words("runs", stemmed=True)).alias("x")).first().x == "The runner was <mark>running</mark> &lt;b&gt;far&lt;/b"


def test_ranks_over_ranges_of_ids(spark, monkeypatch):
    monkeypatch.setattr(search, "RANK_STEP", 7)
    matches = [(i, p) for i in range(100) for p in ("topic", "course", "material")[: i % 4]]
    rows = search.ranked(spark.createDataFrame(matches, "course_id long, property string")).collect()
    order = sorted(rows, key=lambda r: (not r.is_course_match, -r.score, r.course_id))
    assert [r["rank"] for r in order] == list(range(1, 76))


def test_ranking_puts_direct_matches_first(spark):
    matches = spark.createDataFrame([(1, "topic"), (2, "learning outcome"), (2, "description"), (3, "course")], "course_id long, property string")
    ranked = search.ranked(matches).orderBy("rank").collect()
    assert [(r.course_id, r.score) for r in ranked] == [(3, 70), (2, 60), (1, 50)]


@pytest.mark.parametrize("bad", [{"query": "x" * 201}, {"query": "x", "view": "z"}, {"query": "x", "course_levels": (150,)}, {"query": "x", "course_codes": ("A" * 11,)}, {"query": "x", "properties": ("y",)}])
def test_bad_requests(bad):
    with pytest.raises(ValueError):
        search.Request(**bad)


def test_request_of_a_form():
    form = {"query": " soil ", "properties": ["topic"], "course_codes": [], "course_levels": [100], "course_filters_applied": True, "program_ids": [2]}
    asked = search.request_of_form(form, ["FRST"], [1, 2])
    assert (asked.query, asked.view, asked.properties, asked.course_codes, asked.course_levels, asked.program_ids) == ("soil", "courses", tuple(search.WEIGHTS), (), (100,), (1, 2))
    assert search.request_of_form({}, ["FRST"], []).course_codes == ("FRST",)


def test_code_query():
    assert english.course_code_query("FRST100 fire") == "FRST 100 fire"


def test_access_never_repeats_a_course(spark):
    courses = spark.createDataFrame([(1,), (2,)], "course_id long")
    direct = spark.createDataFrame([(7, 1), (7, 1)], "user_id long, course_id long")
    roles = spark.createDataFrame([(7, 1)], "user_id long, course_id long")
    assert [r.course_id for r in access.visible(courses, direct, roles, 7, "course_id").collect()] == [1]
    assert access.visible(courses, direct, roles, 8, "course_id").count() == 0


def test_topic_filter_keeps_scores_at_the_threshold(spark):
    rows = spark.createDataFrame([(1, "Ecology", 0.6, "keyword"), (1, "ecology", 0.9, "font"), (1, "the water", 0.9, "font"), (1, "12 34", 1.0, "font"), (1, "fire com", 1.0, "font"), (1, "Forest fires", 0.6, "font"), (1, "fires", 0.9, "match"), (1, "Forest", 0.7, "font"), (1, "tree", 0.9, "font"), (1, "old http page", 1.0, "font"), (1, "Deep water", 0.59, "font")], "d long, topic string, score double, source string")
    assert {r.topic for r in topics.filtered(rows, ["d"], threshold=0.6).collect()} == {"ecology", "Forest fires", "fires"}


def test_titles_windows_and_references(spark):
    pages = spark.createDataFrame([(1, 1, [("a", 9.0, False), ("Big", 20.0, None), ("Also", 20.0, True)])], files.PAGES)
    assert [r.text for r in topics.titles(pages).collect()] == ["Big"]
    assert [r.text for r in topics.headings(pages).orderBy("line").collect()] == ["Big", "Also"]
    assert one(spark, topics.before_references(F.lit("a References b References c"))) == "a References b "
    assert [len(w.split()) for w in one(spark, topics.windows(F.lit(" ".join("x" * 40))))] == [20, 20, 10]


def test_result_lines(spark):
    lines = ['[{"generated_text": "<think>x</think>{\\"id\\": \\"clo-1__plo-2\\", \\"is_mapped\\": true, \\"mapLabels\\": [\\"I\\"]}"}]', '{"id": "clo-3__plo-4", "is_mapped": false}', "", "nonsense", '{"id": "clo-5__plo-6", "explanation": "cut', "id: clo-7__plo-8\nis_mapped: true\nmapLabels: I, D"]
    rows = files.parse_result_lines(spark.createDataFrame([(x,) for x in lines], "value string")).select(files.pair_ids(F.col("object.id")).alias("p"), "object.mapLabels", "bad").collect()
    assert sorted((r.p.clo, r.p.plo) for r in rows if not r.bad) == [(1, 2), (3, 4), (5, 6), (7, 8)]
    assert [r.mapLabels for r in rows if r.p.clo == 7] == [["I", "D"]]
    assert sum(r.bad for r in rows) == 1


def test_bloom_workbook(spark):
    good = spark.createDataFrame([("Cognitive", "1", "Remember (Recall)", "List"), ("Cognitive", "1", "Remember (Recall)", "list")], "domain string, n string, proto_verb string, verb string")
    assert {r.term for r in files.bloom_rows(good).collect()} == {"Remember", "Recall", "List"}
    placed = spark.createDataFrame([(2, "C", "1", "Know", "list"), (1, "C", "1", "Know", "List"), (3, "C", "1", "Know", "know")], "row int, domain string, n string, proto_verb string, verb string")
    assert {r.term for r in files.bloom_rows(placed).collect()} == {"List", "know"}, "the first spelling stays"
    for bad in [("C", "0", "a", "b"), ("C", "1", "", "b"), ("C", "1", "a", "=b"), ("C", "x", "a", "b")]:
        with pytest.raises(Exception):
            files.bloom_rows(spark.createDataFrame([bad], good.schema)).collect()
    two = spark.createDataFrame([("C", "1", "a", "x"), ("C", "1", "b", "y")], good.schema)
    with pytest.raises(Exception):
        files.bloom_rows(two).collect()
    assert files.import_reference(good, good) is None
    with pytest.raises(ValueError):
        files.import_reference(good, two)


def test_outcome_sheet_and_labelled_table(spark, tmp_path):
    (tmp_path / "a.csv").write_text("outcome,short\nOne,1\n,2\nThree,3\n")
    assert [r.outcome for r in files.read_outcomes(spark, str(tmp_path / "a.csv")).collect()] == ["One", "Three"]
    (tmp_path / "b.csv").write_bytes("clo,plo,score\né,b,1\nc,d,0\n".encode("latin-1"))
    assert [(r.clo, r.id) for r in files.read_labelled(spark, str(tmp_path / "b.csv")).orderBy("id").collect()] == [("é", 2), ("c", 3)]
    (tmp_path / "c.csv").write_text("clo,plo,score\n" + "".join(f"c{i},p,{i}\n" for i in range(5000)))
    spark.conf.set("spark.sql.files.maxPartitionBytes", "4096")
    try:
        rows = files.read_labelled(spark, str(tmp_path / "c.csv")).collect()
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")
    assert len(rows) == 5000 and all(r.id == r.score + 2 for r in rows), "ids follow the file over all splits"


def test_ocr_and_pdf(spark):
    words = spark.createDataFrame([(1, 1, 0, 0, 0, 1, "b", 90.0, 50), (1, 1, 0, 0, 0, 0, "a", 80.0, 48), (1, 1, 0, 0, 0, 2, "noise", 10.0, 9)], "document_id long, page_number int, block int, paragraph int, line int, word int, text string, confidence double, height int")
    r = files.ocr_lines(words).first()
    assert (r.text, r.size) == ("a b", 11.8)
    pdf = spark.createDataFrame([(1, bytearray(b"x"))], "document_id long, content binary")
    assert [p.page_number for p in files.read_pdf_pages(pdf, lambda b: [[{"text": "t", "size": 1.0, "bold": None}], []]).collect()] == [1, 2]


def test_syllabus_fields(spark):
    o = lambda c: one(spark, c)
    assert o(syllabus.term(F.lit("Fall 2024"))) == "Winter Term 1"
    assert o(syllabus.term_code(F.lit("Summer Term 2"))) == "S2"
    assert o(syllabus.main_month(F.lit("Sept 3, Sep 5, October 1, may"))) == 9
    assert [o(syllabus.masked_numbers(F.lit(x))) for x in ("Page 12 of 50", "3 / 4", "12", "- 7 -", "12 Soil", "Soil 12")] == ["Page <NUM> of <NUM>", "<NUM> / <NUM>", "<NUM>", "- <NUM> -", "<NUM> Soil", "Soil 12"]
    assert o(syllabus.code_in_file_name(F.lit("APBI_200_syllabus.pdf"))) == "APBI 200"
    asked = ["1. Soil*", "Midterm exam", "Week 5 - 7", "Soil", "A1", "Water (Dr. X)", "Paper due", "Fire Workshop: bring pens", "Latest  reading week", "Quiz", "(b) Ice — age", "3)", ""]
    assert o(syllabus.clean_topics(F.array(*map(F.lit, asked)))) == ["Soil", "Water", "Fire", "Quiz", "Ice - age"]
    kinds = {("Smith, J. 2020. Soils of the north.", ""): "textbook", ("x", "Smith, J. 2020. Soils."): "textbook", ("Smith, J. 2020. Soils.", "course materials"): "article", ("Vice: a film", ""): "video", ("ArcGIS", ""): "software", ("Portal", ""): "website", ("A", "optional text"): "text", ("Routledge book", "textbook"): "book", ("lecture slides", ""): "lecture slides", ("x", ""): "course resource", ("Handheld calculator", "digital resources"): "equipment", (None, None): "course resource"}
    for (name, description), kind in kinds.items():
        assert o(syllabus.material_type(F.lit(name), F.lit(description))) == kind, name
    bullets = [("1.", "2.", True), ("1.1", "2", False), ("1.1", "2.3", True), ("-", "-", True), ("-", "•", False), ("(a)", "(b)", True), ("(a)", "(1)", False), (None, "-", False)]
    assert [o(F.coalesce(syllabus.bullet_shape(F.concat(F.lit(a).cast("string"), F.lit(" x"))) == syllabus.bullet_shape(F.lit(f"{b} x")), F.lit(False))) for a, b, _ in bullets] == [x for *_, x in bullets]
    dated = [("x 2023.pdf", "Jan 5, January 6, 2024 2024", "Winter Term 2", 2023), ("x.pdf", "Jan 5, 2024", "Winter Term 2", 2023), ("x.pdf", "Jan 5, 2024, 2025", "Winter Term 2", 2024), ("x.pdf", "October 2024", "Winter Term 1", 2024), ("x W2 2022.pdf", "October 2024", "Winter Term 1", 2022), ("x 2022W2.pdf", "October 2024", "Winter Term 2", 2022), ("x.pdf", "Students may ask. You may leave. It may rain. September 3, 2024, September 10", "Winter Term 1", 2024), ("x.pdf", "Rainfall measured. January 8, 2024 and January 9", "Winter Term 2", 2023), ("x.pdf", "Reports on windows1 and news1. February 2024", "Winter Term 2", 2023), ("x.pdf", "Winter Term 2. Fall 2019. October 2024", "Winter Term 2", 2019), ("x.pdf", "2024_S1", "Summer Term 1", 2024), ("x.pdf", "Term 1 2023", "Winter Term 1", 2023), ("x.pdf", "June 1 2020 July 2021 July", "Summer Term 2", 2020), ("x.pdf", "nothing", "Winter Term 2", None)]
    for name, content, season, year in dated:
        got = o(syllabus.term_and_year(F.lit(name), F.lit(content)))
        assert (got.term, got.year) == (season, year), (name, content)
    paged = [(["Winter Term 1", "Fall 2021", "2020 S2"], "Winter Term 1", 2021), (["Winter Term 1", "Winter Term 2", "May 2020"], "Winter Term 2", 2020), ([None, "May 2020", "May"], "Summer Term 1", 2020), ([], "Winter Term 2", None)]
    for pages, season, year in paged:
        got = o(syllabus.term_of_pages(F.lit("x.pdf"), F.array(*map(F.lit, pages)).cast("array<string>")))
        assert (got.term, got.year) == (season, year), pages
    assert o(syllabus.material_type(F.lit("Soils, 3rd edition"), F.lit(""))) == "textbook"
    assert o(syllabus.material_type(F.lit("thing"), F.lit("watch the video"))) == "video"
    text = "COURSE DESCRIPTION\nAll about\nsoil.\nLearning Outcomes\n1. Name\n2. Weigh\nUniversity Policies\nnone"
    found = outline.sections(spark.createDataFrame([(1, text)], "document_id long, text string")).first()
    assert found.description == ["All about soil."] and found.goals == ["Name", "Weigh"]


@pytest.mark.parametrize(
    "pages, found",
    [
        (["Midterm: 40%\nFinal exam 60 %\nLate work 10%"], [("Midterm", 40), ("Final exam", 60)]),
        (["Midterm (30%)\nFinal Exam (70%)"], [("Midterm", 30), ("Final Exam", 70)]),
        (["Quizzes 12.5 points"], [("Quizzes", 12.5)]),
        (["GRADING\nQuizzes 20%\nLab\nreports 80 pts"], [("Quizzes", 20), ("Lab\nreports", 80)]),
        (["A 90%\nB 10%\nTotal 100%"], [("Total", 100)][:0]),
        (["Essay 30%", "Midterm 50%\nFinal 50%"], [("Midterm", 50), ("Final", 50)]),
        (["Components\nEssay\nLab\nPercentage\n60%\n40%\nmore"], [("essay", 60), ("lab", 40)]),
        ([""], []),
        ([], []),
    ],
)
def test_assessments_of_pages(spark, pages, found):
    rows = spark.createDataFrame([(1, i, x) for i, x in enumerate(pages)], "document_id long, page_number int, text string")
    assert [(r.name, r.weight) for r in assessments.assessments_of(rows).orderBy("place").collect()] == found


def test_assessments_by_document(spark):
    rows = spark.createDataFrame([(1, 2, "Midterm 50%\nFinal 50%"), (1, 1, "Essay 30%"), (2, 1, None), (3, 1, "Essay 30%")], "document_id long, page_number int, text string")
    assert sorted(map(tuple, assessments.assessments_of(rows).collect())) == [(1, 0, "Midterm", 50.0), (1, 1, "Final", 50.0), (3, 0, "Essay", 30.0)]


@pytest.mark.parametrize("line, upper, bullet, ends", [("COURSE POLICIES", True, None, True), ("Course Policies", True, None, False), ("Course Policies", False, None, True), ("Contact of the Staff", False, None, False), ("Rationale:", False, None, False), ("FRST 200", False, None, False), ("learning outcomes", False, None, True), ("2. something long that follows here", False, "1. ", True), ("2.1. something long that follows here", False, "1. ", False), ("", False, None, False)])
def test_headings_that_end_a_description(spark, line, upper, bullet, ends):
    shape = syllabus.bullet_shape(F.lit(f"{bullet}x" if bullet else "x"))
    assert one(spark, outline.ends_description(F.lit(line), F.lit(upper), shape)) == ends


@pytest.mark.parametrize("lines, found", [(["Module 2: Soil", "Sept. 12 Water", "Week", "a plain line here", "no", "A whole sentence here."], ["Soil", "Water", "a plain line here"]), (["ii. Soil", "a plain line here", "3)", "Water", "- Fire"], ["Soil", "Water", "Fire"]), ([], [])])
def test_topics_of_lines(spark, lines, found):
    rows = spark.createDataFrame([(1, "\n".join(["Tentative Lecture Schedule:", *lines]))], "document_id long, text string")
    assert [r.topic for r in outline.text_topics(rows).collect()] == found


def test_clean_materials(spark):
    rows = [(1, 0, "Soils  of  the north", "book", "a"), (1, 1, "soils of the north:", "book", "longer"), (1, 2, "Canvas", "", ""), (1, 3, "Videos: films – all", "video", "Videos: films – all"), (1, 4, "Slides posted on canvas", "", ""), (1, 5, "The textbook posted on canvas", "", ""), (1, 6, "September 5 lab", "", ""), (1, 7, "one two three four five six seven eight nine", "", "Resource for course"), (1, 8, "There is no textbook", "", ""), (1, 9, "Reading assignments", "", ""), (1, 10, None, None, None), (2, 0, "* note this", "", "")]
    got = syllabus.clean_materials(spark.createDataFrame(rows, "document_id long, place int, name string, type string, description string")).orderBy("place").collect()
    assert [(r.place, r.name, r.description) for r in got] == [(0, "soils of the north:", "longer"), (3, "Videos", "films - all"), (5, "The textbook posted on canvas", "")]


def test_schedule_tables(spark):
    header, two = ["Week", "Topic"], [["1", "Soil of forests"], ["2", "Final exam"], ["3", "Water of lakes"]]
    tables = {
        1: [(1, 0, [header, *two])],  # plain
        2: [(1, 0, [["", "Lecture"], ["Week", "Topics covered"], *two, ["", ""], ["4", None]])],  # the first row names a column, so the second is no heading
        3: [(1, 0, [["Class", "Guest"], ["topic", "speaker"], ["Soil of forests", "A"], ["Water of lakes", "B"]])],  # stacked headings
        4: [(1, 0, [["Week", "Topic", ""], ["1", "", "Soil of forests"], ["2", "", "Water of lakes"]])],  # cells one column to the right
        5: [(1, 0, [header, *two]), (2, 0, [["4", "Fire in woods"], ["5", "Ice and snow"]])],  # goes on without a header
        6: [(1, 0, [["Item", "Weight"], ["Essay on soils", "40%"]])],  # assessments only
        7: [(1, 0, [header, *two]), (1, 1, [["Item", "Weight"], ["x", "1"]]), (1, 2, [["4", "Fire in woods"], ["5", "Ice and snow"]])],  # ended on its page
        8: [(1, 0, [header]), (2, 0, [["a", "lost row here"], ["1", "Soil of forests"], ["2", "Water of lakes"]])],  # header alone on its page
        9: [(1, 0, [["Module", "Title"], ["1", "1. Soil of forests\n2. Water of\nlakes"]])],  # titles beside modules, a list in a cell
        10: [(1, 0, [["Day", "Transpo", "Notes"], ["1", "bus", "x"]])],  # itinerary
        11: [],
    }
    flat = [(d, page, table, i, cells) for d, some in tables.items() for page, table, rows in some for i, cells in enumerate(rows)]
    rows = spark.createDataFrame(flat, "document_id long, page int, table int, row int, cells array<string>")
    found = defaultdict(list)
    for r in grids.schedule_topics(rows).collect():
        found[r.document_id].append(r.topic)
    soil, water = "Soil of forests", "Water of lakes"
    assert dict(found) == {1: [soil, water], 2: ["Topics covered", soil, water], 3: [soil, water], 4: [soil, water], 5: [soil, water, "Fire in woods", "Ice and snow"], 7: [soil, water], 8: [soil, water], 9: [soil, water]}
    assert grids.schedule_topics(rows.limit(0)).collect() == []


def test_assessment_tables(spark):
    tables = {
        1: [(2, 0, [["Component", None, "Weight"], ["Essay", "", "40%"], ["Midterm\nFinal", None, "20%\n40%"], ["Total", "", "100%"], [None, "", ""]])],
        2: [(1, 0, [["Week", "Topic"], ["1", "2%"]]), (1, 1, [["Item", "Mark"], ["Lab", "9"]])],
        3: [(3, 0, [["Item", "Mark"], ["Late work", "9"]])],
    }
    flat = [(d, page, table, i, cells) for d, some in tables.items() for page, table, rows in some for i, cells in enumerate(rows)]
    rows = spark.createDataFrame(flat, "document_id long, page int, table int, row int, cells array<string>")
    pages = spark.createDataFrame([(1, 1, "Quiz 30%"), (1, 2, "Quiz 50%\nTest 50%"), (2, 1, "x"), (3, 1, "Quiz 50%\nTest 50%"), (3, 3, "")], "document_id long, page_number int, text string")
    found = sorted((r.document_id, r.place, r.name, r.weight) for r in assessments.assessments_of(pages, rows).collect())
    assert found == [(1, 0, "Essay", 40.0), (1, 1, "Midterm", 20.0), (1, 2, "Final", 40.0), (2, 0, "Lab", 9.0), (3, 0, "Quiz", 50.0), (3, 1, "Test", 50.0)]


def test_materials_of_wrapped_lines(spark):
    cited = "Smith, J. 2020. Soils of the north and of the far east. Springer."
    words = cited.split()
    docs = [(k, "Required Readings\n" + " ".join(words[:k]) + "\n" + " ".join(words[k:]) + "\n\nUniversity Policies\nnone") for k in range(4, len(words))]
    docs.append((100, "Course Materials\nThere is no required textbook. Recommended reading: Soils of\nthe north (2011) and Water, an\nintroduction (2012) or so.\n\nRequired Textbooks\n- A book on\nice\n1. Fire, Wiley\n2015\n2. nothing more\nStudents can access these\nlost line"))
    docs += [(101, ""), (102, None), (103, "Textbooks\nnone")]
    found = defaultdict(list)
    for r in outline.materials(spark.createDataFrame(docs, "document_id long, text string")).orderBy("document_id", "place").collect():
        found[r.document_id].append((r.name, r.type, r.description))
    assert {k: v for k, v in found.items() if k < 100} == {k: [(cited, "book", "Required Readings")] for k in range(4, len(words))}
    assert found[100] == [("Soils of the north (2011)", "course resource", "recommended reading"), ("Water, an introduction (2012)", "course resource", "recommended reading"), ("A book on ice", "textbook", "Required Textbooks"), ("Fire, Wiley 2015", "textbook", "Required Textbooks")]
    assert set(found) == {*range(4, len(words)), 100}


def test_writes_are_idempotent(spark):
    maps = spark.createDataFrame([(1, 1, 1)], "l_outcome_id long, pl_outcome_id long, map_scale_id long")
    new = spark.createDataFrame([(1, 1, 2), (2, 1, 3)], maps.schema)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert rows(etl.with_defaults(maps, new)) == [(1, 1, 1), (2, 1, 3)]
    once = etl.replaced(maps, new, etl.PAIR)
    assert rows(once) == rows(etl.replaced(once, new, etl.PAIR)) == [(1, 1, 2), (2, 1, 3)]
    assert rows(etl.upserted(maps, new, etl.MAP_KEY)) == [(1, 1, 1), (1, 1, 2), (2, 1, 3)]


def test_evaluation(spark):
    o = lambda c: one(spark, c)
    labels = lambda t: evaluation.labels_of(F.lit(t))
    assert o(labels("i, r,X,i")) == ["I", "R"]
    kinds = [o(evaluation.match_class(labels(a), labels(b))) for a, b in (("I,R", "R,I"), ("I,R", "I"), ("I", "I,E"), ("I", "E"), ("", ""), ("", "I"), ("I", ""))]
    assert kinds == ["full", "partial", "full", "mismatch", "full", "mismatch", "mismatch"]
    assert [o(evaluation.new_label(labels(a), labels(b))) for a, b in (("I", "I,E"), ("I,R", "R"), ("", "E"))] == [True, False, True]
    rows = spark.range(2000).select((F.col("id") % 10 == 0).cast("int").alias("y"))
    assert 250 < evaluation.balanced(rows, "y").count() < 550


def test_text_functions(spark):
    assert one(spark, text.slug(F.lit("A & B  c!"))) == "a-b-c"
    assert one(spark, text.escaped(F.lit("<mark>a</mark><i>"))) == "<mark>a</mark>&lt;i&gt;"
    assert one(spark, sinks.literal(F.lit("=1+1"))) == "'=1+1"


def test_streams(spark, tmp_path):
    source, schema = tmp_path / "in", "id long, ok boolean"
    spark.range(3).select("id", F.lit(True).alias("ok")).write.json(str(source))
    stream = jobs.follow_files(spark, str(source), schema)
    jobs.run_jobs(stream, lambda b: b.withColumn("n", F.col("id") * 2), str(tmp_path / "done"), str(tmp_path / "failed"), str(tmp_path / "c1")).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "done")).collect()) == [0, 2, 4]

    def broken(batch):
        raise RuntimeError("no")

    def picky(batch):
        return batch.withColumn("n", F.when(F.col("id") == 1, F.raise_error(F.lit("one is bad"))).otherwise(F.col("id")))

    jobs.run_jobs(jobs.follow_files(spark, str(source), schema), picky, str(tmp_path / "done3"), str(tmp_path / "failed3"), str(tmp_path / "c3")).awaitTermination()
    assert sorted(r.n for r in spark.read.parquet(str(tmp_path / "done3")).collect()) == [0, 2], "the others go on"
    assert [(r.id, "one is bad" in r.error) for r in spark.read.parquet(str(tmp_path / "failed3")).collect()] == [(1, True)]
    jobs.run_jobs(jobs.follow_files(spark, str(source), schema), broken, str(tmp_path / "done2"), str(tmp_path / "failed2"), str(tmp_path / "c2")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "failed2")).where("error = 'no'").count() == 3


def test_missing_subpackage_does_not_matter():
    import ast
    from pathlib import Path

    root = Path(access.__file__).parent.parent
    for path in root.rglob("*.py"):
        if "llm" not in path.parts:
            names = [n.module or "" for n in ast.walk(ast.parse(path.read_text())) if isinstance(n, ast.ImportFrom)]
            assert not [n for n in names if n.startswith("loomwork.llm")], path
