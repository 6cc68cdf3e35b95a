"""Tables of documents as grids: schedules and their topic columns.

A grid comes as rows(document_id, page, table, row, cells array<string>). A table is one grid on one page, so its rows
fit one array; what goes from table to table of a document are windows over its tables. No Python runs on rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.syllabus import LEARNING_STARTS, clean_topics

TABLE = ["document_id", "page", "table"]

#: Headings of columns of a schedule, as heading_text() has them (fixed values).
TOPIC_HEADINGS = [
    "topic", "topics", "lecture", "lecture topic", "lecture topics", "lab topic", "lab topics", "class topic", "class topics",
    "course topic", "course topics", "module topics", "weekly topics", "weekly topic", "topic speaker", "topic and speaker",
    "topics and speakers", "speaker topic", "speaker and topic", "topic presenter", "topic facilitator", "learning topic",
    "learning topics", "topics covered", "topic description", "theme", "topic covered", "topic of lecture", "module",
]
TITLE_HEADINGS = ["title", "name", "topic name", "topic title", "topics title"]
SCHEDULE_HEADINGS = ["week", "date", "dates", "module", "unit", "lecture"]
MODULE_HEADINGS = ["module", "module name", "course module"]
THEME_HEADINGS = ["theme", "themes"]
OTHER_HEADINGS = [
    "reading", "readings", "readings deadlines", "readings and deadlines", "deadline", "deadlines", "due date", "assessment",
    "assessments", "activity", "activities", "mark", "marks", "weight", "weight %", "percentage", "%", "number", "#", "week",
    "in-class", "in class", "work",
]
ASSESSMENT_HEADINGS = ["item", "mark", "marks", "weight", "due date", "assessment", "assessments", "assignment", "assignments"]
ITINERARY_HEADINGS = ["activity", "activities", "transpo", "transportation", "accoms", "accommodations", "meals", "meals provided", "course deliverables", "course deliverables and notes"]
#: What cells of other columns look like: parts of the course, times, days, logistics, cited years (fixed patterns).
NO_TOPIC_CELLS = [
    r"^(day|week|module|unit)\s*[\divxlcdm/ -]+$",
    r"\b\d{1,2}:\d{2}\b",
    r"\b(mon|tue|wed|thu|fri|monday|tuesday|wednesday|thursday|friday|jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)\b",
    r"\b(canvas|reading|readings|assignment|assignments|due|quiz|exam|test|prep|slides?|http|www|room|location|mark|weight)\b",
    r"\b(?:\(\d{4}\)|\d{4})\.",
]
#: A part of the course without a name of its own, and lines of a cell that are no topics (fixed patterns).
BARE_PART = r"(?i)^(module|unit|week)\s+(\d+|[ivxlcdm]+)$"
CELL_NOTE = r"^(?:time$|(?:note:|midterm|mid term|final exam|exam|quiz)\b)"
NO_LABS = r"(?i)^no labs?\s*\((.+)\)$"
LIST_MARK, MODULE_MARK = r"^(\d+[.)]|[-•*])\s+", r"(?i)^module\s+\d+:"
#: Rows that the look of a column is judged by, rows that tell what a table is about, words of a module's own name.
LOOK_ROWS, CONTEXT_ROWS, MODULE_ROWS, MODULE_WORDS = 6, 12, 7, 3
_MARK = "\u0001"


def heading_text(cell: Column) -> Column:
    """Lower case, 'and' for &, a blank for /, without %, brackets, stars and colons."""
    plain = F.regexp_replace(F.replace(F.replace(F.lower(F.trim(cell)), F.lit("&"), F.lit("and")), F.lit("/"), F.lit(" ")), r"[%()*:]", "")
    return F.trim(F.regexp_replace(plain, r"\s+", " "))


def grids(rows: DataFrame) -> DataFrame:
    """document_id, page, table, grid array<array<string>>: cells trimmed, null ones empty, rows without text gone."""
    cells = F.transform(F.coalesce("cells", F.array().cast("array<string>")), lambda c: F.trim(F.regexp_replace(F.coalesce(c, F.lit("")), r"^\s+|\s+$", "")))
    some = rows.select(*TABLE, "row", cells.alias("cells")).where(F.exists("cells", lambda c: c != ""))
    return some.groupBy(*TABLE).agg(F.transform(F.array_sort(F.collect_list(F.struct("row", "cells"))), lambda r: r["cells"]).alias("grid"))


def _any(headings: Column, values: list[str]) -> Column:
    return F.arrays_overlap(headings, F.array(*map(F.lit, values)))


def _headings(row: int) -> Column:
    return F.transform(F.coalesce(F.get("grid", F.lit(row)), F.array().cast("array<string>")), heading_text)


def _places(headings: Column, values: list[str]) -> Column:
    """Indexes of the headings that are among the values."""
    each = F.transform(headings, lambda h, i: F.when(h.isin(values), i))
    return F.filter(each, lambda i: i.isNotNull())


def _topic_like(cell: Column) -> Column:
    return F.size(F.regexp_extract_all(cell, F.lit(r"([^\W\d_]{2,}(?:[-‐‑–—][^\W\d_]{2,})*)"), 1)) >= 2


def _look(body: Column, at: Column) -> Column:
    """struct<some, good, bad>: of a column's first cells, how many have text, look like topics, and like none."""
    cells = F.filter(F.transform(F.slice(body, 1, LOOK_ROWS), lambda r: F.trim(F.regexp_replace(F.coalesce(F.get(r, at), F.lit("")), r"\s+", " "))), lambda c: c != "")

    def bad(cell: Column) -> Column:
        low = F.lower(cell)
        out = F.exists(F.array(*map(F.lit, LEARNING_STARTS)), lambda w: F.startswith(low, w))
        for pattern in NO_TOPIC_CELLS:
            out = out | low.rlike(pattern)
        return out

    count = lambda test: F.size(F.filter(cells, test))
    return F.struct(F.size(cells).alias("some"), count(lambda c: ~bad(c) & _topic_like(c)).alias("good"), count(bad).alias("bad"))


def _aligned(body: Column, places: Column) -> Column:
    """places, each moved to the neighbour that looks like topics where its own column doesn't."""

    def moved(at: Column) -> Column:
        own = _look(body, at)
        beside = F.transform(F.array(at - 1, at + 1), lambda k: F.struct(_look(body, k).alias("look"), k.alias("k")))
        better = F.filter(beside, lambda b: (b["k"] >= 0) & (b["look"]["good"] >= 2) & (b["look"]["bad"] <= b["look"]["good"]) & (b["look"]["good"] > own["good"]))
        best = F.array_max(F.transform(better, lambda b: F.struct(b["look"]["good"].alias("good"), (-b["k"]).alias("k"))))["k"]
        usable = (own["good"] >= 1) & (own["bad"] <= own["good"])
        return F.when(usable, at).otherwise(F.coalesce(-best, at))

    return F.array_distinct(F.transform(places, moved))


def _topics_of_cell(cell: Column) -> Column:
    """The topics of a cell: one for each list item or module, if it lists several, else its lines as one."""
    tidy = lambda x: F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))
    lines = F.filter(F.transform(F.split(cell, "\n"), lambda x: F.trim(x)), lambda x: (x != "") & ~tidy(x).rlike(CELL_NOTE))
    lines = F.transform(lines, lambda x: F.coalesce(F.nullif(F.trim(F.regexp_extract(x, NO_LABS, 1)), F.lit("")), x))

    def parts(pattern: str, cut: bool) -> Column:
        marked = F.transform(lines, lambda x: F.when(x.rlike(pattern), F.concat(F.lit(_MARK), F.regexp_replace(x, pattern, "") if cut else x)).otherwise(x))
        return F.filter(F.transform(F.split(F.array_join(marked, " "), _MARK), lambda x: F.trim(x)), lambda x: x != "")

    several = lambda pattern: F.size(F.filter(lines, lambda x: x.rlike(pattern))) > 1
    whole = F.filter(F.array(F.trim(F.array_join(lines, " "))), lambda x: x != "")
    return F.when(several(LIST_MARK), parts(LIST_MARK, True)).when(several(MODULE_MARK), parts(MODULE_MARK, False)).otherwise(whole)


def schedule_columns(rows: DataFrame) -> DataFrame:
    """document_id, page, table, grid, header, body (index of its first row), places (indexes of topic columns).

    Only tables that hold topics. The header is the first row, or the first two by column where only both together name
    a topic; a table whose own first row names nothing takes the header that stood alone in a table before, if it is as
    wide. Topic columns are those named so; else modules with names of their own, or themes of a schedule; and titles
    beside them. A table without any goes on with the columns of the one before. Tables of assessments and itineraries
    are none, and once topics were found they end those of their page.
    """
    some = grids(rows).select(*TABLE, "grid", F.size("grid").alias("n"), _headings(0).alias("h0"), _headings(1).alias("h1"))
    before = Window.partitionBy("document_id").orderBy("page", "table").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("lone", F.last(F.when(F.col("n") == 1, F.col("h0")), ignorenulls=True).over(before)).where("n > 1")
    named = [*TOPIC_HEADINGS, *TITLE_HEADINGS, *MODULE_HEADINGS, *THEME_HEADINGS]
    width = F.greatest(F.size("h0"), F.size("h1"))
    both = F.transform(F.sequence(F.lit(0), width - 1), lambda i: F.trim(F.concat(F.coalesce(F.get("h0", i), F.lit("")), F.lit(" "), F.coalesce(F.get("h1", i), F.lit("")))))
    nothing = ~_any(F.col("h0"), named)
    stacked = nothing & (F.col("n") > 2) & _any(both, TOPIC_HEADINGS)
    some = some.withColumn("stacked", stacked)
    lone = nothing & ~F.col("stacked") & F.coalesce(F.size("lone") == F.size("h0"), F.lit(False))
    header = F.when(F.col("stacked"), both).when(lone, F.col("lone")).otherwise(F.col("h0"))
    some = some.select(*TABLE, "grid", header.alias("header"), F.when(F.col("stacked"), 2).otherwise(1).alias("skip"))
    h = F.col("header")
    topic, schedule = _any(h, TOPIC_HEADINGS), _any(h, SCHEDULE_HEADINGS)
    context = F.flatten(F.transform(F.slice("grid", 1, CONTEXT_ROWS), lambda r: F.transform(r, heading_text)))
    assessments, itinerary = _any(h, ASSESSMENT_HEADINGS) & ~topic, (_any(h, ITINERARY_HEADINGS) | _any(context, ITINERARY_HEADINGS)) & ~topic
    other = _any(h, OTHER_HEADINGS) & ~schedule & ~topic & ~_any(h, MODULE_HEADINGS)
    # a module column holds topics if one of its first cells has more to say than a number
    own_name = lambda c: (F.size(F.split(F.trim(F.regexp_replace(c, r"\s+", " ")), " ")) >= MODULE_WORDS) & ~F.trim(c).rlike(BARE_PART)
    tells = lambda i: F.exists(F.slice(F.col("grid"), F.col("skip") + 1, F.lit(MODULE_ROWS)), lambda r: own_name(F.coalesce(F.get(r, i), F.lit(""))))
    modules = F.filter(_places(h, MODULE_HEADINGS), tells)
    themes = F.when(schedule, _places(h, THEME_HEADINGS)).otherwise(F.array().cast("array<int>"))
    titles = F.when(schedule | topic, _places(h, TITLE_HEADINGS)).otherwise(F.array().cast("array<int>"))
    main = F.when(topic, _places(h, TOPIC_HEADINGS)).when(F.size(modules) > 0, modules).otherwise(themes)
    places = F.filter(F.concat(main, titles), lambda i: ~F.get(h, i).isin(OTHER_HEADINGS))
    some = some.select(*TABLE, "grid", "header", "skip", (topic | _any(h, MODULE_HEADINGS + THEME_HEADINGS)).alias("headed"), (assessments | itinerary).alias("foreign"), (assessments & ~itinerary & schedule).alias("mixed"), other.alias("other"), places.alias("places"))
    headed_body = F.col("headed") | (F.col("skip") > 1) | _any(F.col("header"), TITLE_HEADINGS)
    look_at = F.slice(F.col("grid"), F.when(headed_body, F.col("skip") + 1).otherwise(1), F.size("grid"))
    fits = (F.size("places") > 0) & ~F.col("foreign") & ~F.col("other")
    some = some.withColumn("look_at", look_at).withColumn("own", F.when(fits, _aligned(F.col("look_at"), F.col("places"))))
    # what earlier tables tell: the columns to go on with, and whether this page's topics have ended
    last = F.last("own", ignorenulls=True).over(before)
    some = some.withColumn("last", last)
    ends = F.col("foreign") & ~F.col("mixed") & F.col("last").isNotNull()
    on_page = Window.partitionBy("document_id", "page").orderBy("table").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("ended", F.coalesce(F.max(ends).over(on_page), F.lit(False))).where(~F.col("ended") & ~F.col("foreign"))
    first = F.coalesce(F.get("grid", F.lit(0)), F.array().cast("array<string>"))
    narrow = (F.array_max("last") >= F.size(first)) & F.coalesce(F.get(first, F.lit(0)).rlike(r"^\d+(\s|$)"), F.lit(False)) & (F.size(first) > 1)
    going_on = F.when(narrow, F.array(F.lit(1))).otherwise(F.col("last"))
    found = F.coalesce(F.col("own"), F.when(F.col("last").isNotNull(), _aligned(F.col("look_at"), going_on)))
    body = F.when(F.col("headed"), F.col("skip")).otherwise(0)
    return some.select(*TABLE, "grid", "header", body.alias("body"), found.alias("places")).where(F.size("places") > 0)


def schedule_topics(rows: DataFrame) -> DataFrame:
    """document_id, topic of the schedules among tables; topics cleaned, each once a document.

    An empty cell of a theme or speaker column takes the one on its left, if that has no heading.
    """

    def cell_of(row: Column, i: Column) -> Column:
        own, spaced = F.coalesce(F.get(row, i), F.lit("")), F.get("header", i).isin([*THEME_HEADINGS, "topic speaker"]) & (F.coalesce(F.get("header", i - 1), F.lit("-")) == "")
        return F.when((own == "") & F.coalesce(spaced, F.lit(False)) & (i > 0), F.coalesce(F.get(row, i - 1), F.lit(""))).otherwise(own)

    cells = F.flatten(F.transform(F.slice(F.col("grid"), F.col("body") + 1, F.size("grid")), lambda r: F.transform("places", lambda i: cell_of(r, i))))
    topics = F.flatten(F.transform(cells, _topics_of_cell))
    listed = schedule_columns(rows).select(*TABLE, topics.alias("topics"))
    whole = listed.groupBy("document_id").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("page", "table", "topics"))), lambda x: x["topics"])).alias("topics"))
    return whole.select("document_id", F.explode(clean_topics(F.col("topics"))).alias("topic"))
