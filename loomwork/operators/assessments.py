"""Assessments and their weights: from tables first, then from text, page by page, as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomwork.operators.grids import grids
from loomwork.operators.syllabus import FULL_WEIGHT, GRADES, NO_ASSESSMENT

#: A label that begins with a capital, over lines maybe, and its share; and the same with the share in brackets at the
#: end of a line (fixed patterns).
SHARE = r"(?U)([A-Z][\w\s\[\]\-/–():.&@%*=]*?)[:.…\s]*?(\d+(?:\.\d+)?)\s*(?:%|points|pts)(?=\s|$)"
BRACKETED = r"(?Um)^([A-Z][\w\s\[\]\-/–():.&%]*?)\s*\(\s*(\d+)%\s*\)\s*$"
PLAIN_SHARE = r"^\d+%(\s+each\s+\(\d+%\s+total\))?$"
#: Headings of lists that hold labels and shares apart, and of columns of names and weights (fixed values).
LABELS_BELOW, SHARES_BELOW = ["component", "components"], ["percentage", "points/marks"]
NAME_HEADINGS = ["item", "assessment", "graded activities", "component", "activity", "assignment", "category", "components", "module", "type", "grading component", "evaluations", "learning assessment", "grade component", "graded activities/assignments", "winter term i", "winter term ii", "exams and problem sets"]
MARK_HEADINGS = ["mark", "percentage", "marks", "weight (%)", "weight", "% of final grade", "total weight", "percentage of final grade", "assignment weight", "%", "weighting", "pts (/100)", "percent of final grade", "% final mark", "percent of grade", "grade weight"]
PAIRS = "array<struct<name:string,share:string>>"


def _pairs(text: Column, pattern: str) -> Column:
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(pattern), 1).alias("name"), F.regexp_extract_all(text, F.lit(pattern), 2).alias("share"))
    return F.transform(found, lambda p: F.struct(p["name"].alias("name"), p["share"].alias("share")))


def _total(pairs: Column) -> Column:
    return F.aggregate(pairs, F.lit(0.0), lambda a, p: a + p["share"].cast("double"))


def _upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")


def named(pairs: Column) -> Column:
    """Pairs whose label names an assessment: the last line has no word that none has, the label is no grade.

    Of a label of two lines a first one in upper case goes, of more only the last stays.
    """

    def good(p: Column) -> Column:
        last = F.element_at(F.split(p["name"], "\n"), -1)
        words = F.split(F.lower(F.trim(last)), r"\s+")
        return (p["share"] != "100") & ~p["name"].isin(GRADES) & (F.length(F.trim(p["name"])) >= 3) & ~F.arrays_overlap(words, F.array(*map(F.lit, NO_ASSESSMENT)))

    def short(p: Column) -> Column:
        parts = F.split(p["name"], "\n")
        whole = (F.size(parts) == 1) | ((F.size(parts) == 2) & ~_upper(F.trim(parts[0])))
        return F.struct(F.regexp_replace(F.when(whole, p["name"]).otherwise(F.element_at(parts, -1)), r"^\s+|\s+$", "").alias("name"), p["share"].alias("share"))

    return F.transform(F.filter(pairs, good), short)


def _listed(text: Column) -> Column:
    """Labels under one heading with the shares under another, in order, up to the first line that is no share."""
    lines = F.filter(F.transform(F.split(F.lower(text), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    first = lambda some: F.array_min(F.filter(F.transform(F.array(*map(F.lit, some)), lambda w: F.array_position(lines, w)), lambda k: k > 0)).cast("int")
    labels, shares = first(LABELS_BELOW), first(SHARES_BELOW)
    below = F.slice(lines, shares + 1, F.size(lines))
    other = F.array_min(F.filter(F.transform(below, lambda x, i: F.when(x.rlike(PLAIN_SHARE) | (x.contains("each") & x.contains("total")), F.size(lines)).otherwise(i)), lambda i: i.isNotNull()))
    below = F.slice(below, 1, F.coalesce(F.least(other, F.size(below)), F.lit(0)))
    between = F.slice(lines, labels + 1, F.greatest(shares - labels - 1, F.lit(0)))
    both = F.transform(between, lambda x, i: F.struct(x.alias("name"), F.get(below, i).alias("share")))
    return F.when(labels.isNotNull() & shares.isNotNull(), F.filter(both, lambda p: p["share"].isNotNull()))


def table_pairs(rows: DataFrame) -> DataFrame:
    """document_id, page, pairs: of each page with tables of assessments, those of its first such table.

    rows(document_id, page, table, row, cells) as for grids(). Empty cells are merged ones and go. The first row names
    a column of names and one of weights; a row whose weight has a digit is a pair, or one for each line of its cells.
    Shares of 100 are sums.
    """
    full = F.transform("grid", lambda r: F.filter(r, lambda c: c != ""))
    some = grids(rows).select("document_id", "page", "table", full.alias("grid"))
    head = F.transform(F.get("grid", F.lit(0)), lambda c: F.lower(c))
    place = lambda values: F.array_min(F.filter(F.transform(head, lambda h, i: F.when(h.isin(values), i)), lambda i: i.isNotNull()))
    some = some.select("document_id", "page", "table", "grid", place(NAME_HEADINGS).alias("name_at"), place(MARK_HEADINGS).alias("mark_at")).where("name_at is not null and mark_at is not null")
    rows_of = F.filter(F.slice("grid", 2, F.size("grid")), lambda r: F.coalesce(F.get(r, F.col("mark_at")).rlike(r"\d") & F.get(r, F.col("name_at")).isNotNull(), F.lit(False)))

    def each(row: Column) -> Column:
        names, marks = F.split(F.get(row, F.col("name_at")), "\n"), F.split(F.get(row, F.col("mark_at")), "\n")
        return F.transform(F.sequence(F.lit(0), F.least(F.size(names), F.size(marks)) - 1), lambda i: F.struct(F.get(names, i).alias("name"), F.get(marks, i).alias("share")))

    pairs = F.filter(F.flatten(F.transform(rows_of, each)), lambda p: ~p["share"].contains("100"))
    some = some.withColumn("pairs", pairs).where("size(pairs) > 0")
    return some.groupBy("document_id", "page").agg(F.min_by("pairs", "table").alias("pairs"))


def assessments_of(pages: DataFrame, tables: DataFrame | None = None) -> DataFrame:
    """document_id, place, name, weight of pages(document_id, page_number, text) and their tables (rows as for grids()).

    The first page with a table of assessments, or whose text's pairs add up to FULL_WEIGHT and still do once cleaned,
    has the answer. Other pages' pairs add to it, if each label has one share. Where none was found yet, lists of labels
    and of shares apart count, and end the search. Null text is an empty page.
    """
    rows = pages.select("document_id", F.col("page_number").cast("long").alias("page"), F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("document_id", "page", "text", _pairs(F.col("text"), SHARE).alias("plain"), _pairs(F.col("text"), BRACKETED).alias("bracketed"))
    nothing = F.array().cast(PAIRS)

    def judged(pairs: str) -> tuple[Column, Column, Column]:
        """Of a list of pairs: the answer, if it is one; what it adds; whether it is as large as an answer."""
        p = F.col(pairs)
        large = (F.size(p) > 1) & (_total(p) >= FULL_WEIGHT)
        clean = named(p)
        one_share = F.when(F.size(p) == 1, F.size(F.filter(F.split(p[0]["name"], "\n"), lambda x: ~_upper(x))) == 1).otherwise(F.size(p) > 1)
        return F.when(large & (_total(clean) >= FULL_WEIGHT), clean), F.when(large | one_share, clean).otherwise(nothing), large

    answer, adds, large = judged("plain")
    answer2, adds2, _ = judged("bracketed")
    listed = F.when(F.lower("text").contains("component") & F.lower("text").contains("percentage"), F.coalesce(_listed(F.col("text")), nothing))
    rows = rows.select("document_id", "page", F.coalesce(answer, F.when(~large, answer2)).alias("answer"), F.when(large, adds).otherwise(F.concat(adds, adds2)).alias("adds"), listed.alias("listed"))
    if tables is not None:
        found = table_pairs(tables.withColumn("page", F.col("page").cast("long"))).withColumnRenamed("pairs", "of_table")
        rows = rows.join(found, ["document_id", "page"], "full").select("document_id", "page", F.coalesce("of_table", "answer").alias("answer"), F.coalesce("adds", nothing).alias("adds"), "listed")
    by_page = rows.groupBy("document_id").agg(F.array_sort(F.collect_list(F.struct("page", "answer", "adds", "listed"))).alias("pages"))
    # page by page: an answer ends the search, so do lists that stand apart where nothing was found before
    start = F.struct(nothing.alias("found"), F.lit(False).alias("sure"), F.lit(False).alias("done"))

    def step(state: Column, page: Column) -> Column:
        more = F.concat(state["found"], page["adds"])
        apart = (F.size(more) == 0) & page["listed"].isNotNull()
        found = F.when(page["answer"].isNotNull(), page["answer"]).when(apart, page["listed"]).otherwise(more)
        sure = page["answer"].isNotNull()
        return F.when(state["done"], state).otherwise(F.struct(found.alias("found"), sure.alias("sure"), (sure | apart).alias("done")))

    by_page = by_page.select("document_id", F.aggregate("pages", start, step).alias("state"))
    found = F.when(F.col("state.sure"), F.col("state.found")).otherwise(named(F.col("state.found")))
    number = lambda p: F.regexp_extract(p["share"], r"(\d+\.?\d*)", 1)
    weights = F.transform(F.filter(found, lambda p: number(p) != ""), lambda p: F.struct(p["name"].alias("name"), number(p).cast("double").alias("weight")))
    return by_page.select("document_id", F.posexplode(weights).alias("place", "x")).select("document_id", "place", "x.name", "x.weight")

