"""Federated course search: one branch for each property, united, scored by course, ranked and paged.

Each branch matches token arrays; an inverted index table gives the same rows through a join on tokens, for corpora
where reading all texts for each query would not do.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.functions import english
from loomwork.operators import access

#: What a match of each property adds to its course's score (fixed values).
WEIGHTS = {"course": 70, "topic": 50, "learning outcome": 40, "assessment": 30, "description": 20, "material content": 15, "material": 10}
PAGE = 10
EXPORT_LIMIT = 500
VIEWS = ("courses", "programs")
LEVELS = (100, 200, 300, 400, 500, 600)


@dataclass(frozen=True)
class Request:
    """A validated search: ValueError says what is wrong."""

    query: str
    view: str = "courses"
    properties: tuple[str, ...] = tuple(WEIGHTS)
    course_codes: tuple[str, ...] = ()
    course_levels: tuple[int, ...] = ()
    program_ids: tuple[int, ...] = ()
    stemmed: bool = False

    def __post_init__(self):
        object.__setattr__(self, "query", english.normalized(self.query))
        if len(self.query) > 200:
            raise ValueError("a query has 200 characters at most")
        if self.view not in VIEWS:
            raise ValueError(f"unknown view {self.view}")
        if unknown := set(self.properties) - set(WEIGHTS):
            raise ValueError(f"unknown properties {sorted(unknown)}")
        if any(len(c) > 10 for c in self.course_codes):
            raise ValueError("a course code has 10 characters at most")
        if set(self.course_levels) - set(LEVELS):
            raise ValueError("course levels are 100 to 600")


def request_of_form(form: dict, codes: list[str], programs: list[int]) -> Request:
    """The request of a form: query, view, and the lists of its property, course and program filters.

    A list counts if the form says that its filter was applied (property_, course_ or program_filters_applied); else all
    properties, levels, and the codes and programs that the user may see.
    """
    lists = {"properties": ("property", list(WEIGHTS)), "course_codes": ("course", codes), "course_levels": ("course", list(LEVELS)), "program_ids": ("program", programs)}
    some = {name: tuple(chosen(form.get(name), bool(form.get(f"{kind}_filters_applied")), default)) for name, (kind, default) in lists.items()}
    return Request(form.get("query") or "", form.get("view") or VIEWS[0], **some)


def chosen(values: list | None, applied: bool, default: list) -> list:
    """The list that a form sent if its filter was applied, else the default; an applied filter may be empty."""
    return list(values or []) if applied else list(default)


def allowed_courses(tables: dict[str, DataFrame], request: Request, user_id: int, administrator: bool = False) -> DataFrame:
    """course_id of the courses that the user sees and that the request's codes, levels and programs let through."""
    courses = tables["courses"]
    if request.course_codes:
        courses = courses.where(F.col("course_code").isin(list(request.course_codes)))
    courses = courses.where(access.level_filter(F.col("course_num"), list(request.course_levels)))
    courses = access.courses_in_programs(courses, tables["course_programs"], list(request.program_ids))
    return access.visible(courses, tables["course_users"], tables["course_user_role"], user_id, "course_id", administrator).select("course_id")


def scoped(matches: DataFrame, allowed: DataFrame) -> DataFrame:
    return matches.join(allowed, "course_id", "left_semi")


def with_programs(ranked_rows: DataFrame, course_programs: DataFrame, programs: DataFrame) -> DataFrame:
    """ranked_rows with programs, a sorted array of (program_id, program); empty for courses in none."""
    named = course_programs.select("course_id", "program_id").distinct().join(programs.select("program_id", "program"), "program_id")
    listed = named.groupBy("course_id").agg(F.array_sort(F.collect_list(F.struct("program_id", "program"))).alias("programs"))
    none = F.array().cast("array<struct<program_id:bigint,program:string>>")
    return ranked_rows.join(listed, "course_id", "left").withColumn("programs", F.coalesce("programs", none))


def program_matches(programs: DataFrame, course_programs: DataFrame, allowed: DataFrame, query: str, stemmed: bool = False) -> DataFrame:
    """program_id, program whose name meets the query and that have a course which is allowed."""
    tokens = english.words(F.col("program"))
    tokens = english.stems(tokens) if stemmed else tokens
    held = course_programs.join(allowed, "course_id", "left_semi")
    return programs.where(english.matches(tokens, query, stemmed)).join(held, "program_id", "left_semi").select("program_id", "program")


FOUND = ["course_id", "property", "matched_text", "file_name", "page_number"]


def vectors(tables: dict[str, DataFrame], stemmed: bool = False) -> DataFrame:
    """FOUND, text_id (of a property's rows) and tokens of every text that a search looks into.

    tables by role: courses, topics, outcomes, ... as in the star. file_name and page_number are null but for files.
    """
    t = tables
    files = t["course_material_files"].where("status = 'INDEXED'")
    chunks = t["course_material_chunks"].join(files, "course_material_file_id").join(t["course_materials"].select("course_material_id", "course_id"), "course_material_id")
    plans = {
        "course": (t["courses"], F.concat_ws(" ", "course_code", "course_num", "course_title"), "course_id"),
        "topic": (t["course_topics"], F.col("topic"), "course_topic_id"),
        "learning outcome": (t["learning_outcomes"], F.col("l_outcome"), "l_outcome_id"),
        "assessment": (t["assessment_methods"], F.col("a_method"), "a_method_id"),
        "description": (t["course_descriptions"], F.col("course_description"), "course_id"),
        "material": (t["course_materials"], F.concat_ws(" ", "name", "type", "description"), "course_material_id"),
        "material content": (chunks, F.col("content"), "chunk_id"),
    }

    def rows_of(name: str, rows: DataFrame, text: Column, key: str) -> DataFrame:
        tokens = english.words(text)
        place = [(F.col(c) if c in rows.columns else F.lit(None)).cast(kind).alias(c) for c, kind in (("file_name", "string"), ("page_number", "long"))]
        return rows.select("course_id", F.lit(name).alias("property"), text.alias("matched_text"), *place, F.col(key).cast("long").alias("text_id"), (english.stems(tokens) if stemmed else tokens).alias("tokens"))

    return reduce(lambda a, b: a.unionByName(b), [rows_of(p, *plans[p]) for p in plans])


def matches_in(stored: DataFrame, request: Request) -> DataFrame:
    """FOUND of the rows of vectors() that meet the request, duplicates kept; a course code in the query is split."""
    q, hit = request.query, F.lit(False)
    for name in request.properties:
        own = english.course_code_query(q) if name == "course" else q
        hit = hit | ((F.col("property") == name) & english.matches(F.col("tokens"), own, request.stemmed))
    return stored.where(F.col("property").isin(list(request.properties)) & hit).select(*FOUND)


def branches(tables: dict[str, DataFrame], request: Request) -> DataFrame:
    """All matches in texts that are read as they are, duplicates kept."""
    return matches_in(vectors(tables, request.stemmed), request)


def with_snippets(matches: DataFrame, request: Request) -> DataFrame:
    """matches with snippet: the parts of the text that hold most of the query's words, marked."""
    tokens = english.words(F.col("matched_text"))
    tokens = english.stems(tokens) if request.stemmed else tokens
    rows = matches.withColumn("_tokens", tokens)
    return rows.withColumn("snippet", english.headline(F.col("matched_text"), F.col("_tokens"), english.wanted_words(request.query, request.stemmed))).drop("_tokens")


def scored(matches: DataFrame) -> DataFrame:
    """A row for each course: score, direct match, matches by property."""
    weight = F.lit(0)
    for name, points in WEIGHTS.items():
        weight = F.when(F.col("property") == name, points).otherwise(weight)
    stats = [F.count_if(F.col("property") == p).alias(p.replace(" ", "_")) for p in WEIGHTS]
    return matches.groupBy("course_id").agg(F.sum(weight).alias("score"), F.bool_or(F.col("property") == "course").alias("is_course_match"), *stats)


#: Course ids that one task of a ranking numbers, about.
RANK_STEP = 65_536


def ranked(matches: DataFrame) -> DataFrame:
    """scored() with rank: direct matches first, then by score, then by id.

    Courses are packed by (direct match, score) and ranges of ids, the sizes of the packs are added up, and each pack
    is numbered from there, so no task sorts all courses. Both sides of the join read one exchange of the packs.
    """
    rows = scored(matches).withColumn("_range", F.call_function("div", "course_id", F.lit(RANK_STEP)))
    keys = ("is_course_match", "score", "_range")
    packed = rows.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("course_id", *[p.replace(" ", "_") for p in WEIGHTS]))).alias("_rows"))
    order = (F.desc("is_course_match"), F.desc("score"), F.col("_range"))
    sizes = packed.select(*keys, F.size("_rows").alias("_n"))
    before = sizes.select(*[F.col(k).alias(f"_of_{k}") for k in keys], (F.sum("_n").over(Window.orderBy(*order)) - F.col("_n")).alias("_before"))
    same = reduce(lambda a, b: a & b, [F.col(k).eqNullSafe(F.col(f"_of_{k}")) for k in keys])  # asks nothing of one side alone
    placed = packed.join(before, same).select("is_course_match", "score", "_before", F.posexplode("_rows").alias("_at", "_row"))
    return placed.select("_row.course_id", "score", "is_course_match", *[f"_row.{p.replace(' ', '_')}" for p in WEIGHTS], (F.col("_before") + F.col("_at") + 1).alias("rank"))


def top(matches: DataFrame, limit: int = EXPORT_LIMIT) -> DataFrame:
    """The first courses of the ranking; a top-k before the row numbers, so no sort of all courses."""
    order = (F.desc("is_course_match"), F.desc("score"), F.col("course_id"))
    return scored(matches).orderBy(*order).limit(limit).withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def page(ranked_rows: DataFrame, number: int, size: int = PAGE) -> DataFrame:
    return ranked_rows.where(F.col("rank").between((number - 1) * size + 1, number * size))


def stats(matches: DataFrame, course_programs: DataFrame) -> DataFrame:
    """One row: distinct courses and programs, matches by property."""
    programs = course_programs.join(matches.select("course_id").distinct(), "course_id", "left_semi").agg(F.count_distinct("program_id").alias("programs"))
    counts = [F.count_if(F.col("property") == p).alias(p.replace(" ", "_")) for p in WEIGHTS if p != "course"]
    return matches.agg(F.count_distinct("course_id").alias("courses"), *counts).join(programs, F.lit(True))


def by_program(scored_rows: DataFrame, course_programs: DataFrame) -> DataFrame:
    """Of each program with matching courses: how many, direct ones, summed matches."""
    rows = course_programs.select("program_id", "course_id").distinct().join(scored_rows, "course_id")
    sums = [F.sum(p.replace(" ", "_")).alias(p.replace(" ", "_")) for p in WEIGHTS if p != "course"]
    return rows.groupBy("program_id").agg(F.count("*").alias("courses"), F.count_if("is_course_match").alias("direct"), *sums)


def shared_cap(ranked_rows: DataFrame, course_programs: DataFrame, limit: int, named: DataFrame | None = None) -> DataFrame:
    """Courses of programs in order, until the limit is spent over all of them; a top-k before the row numbers.

    named: program_id of programs that their own name matches. They stay without a course, as one row of nulls.
    """
    rows = course_programs.select("program_id", "course_id").distinct().join(ranked_rows.select("course_id", "rank"), "course_id")
    first = rows.orderBy("program_id", "rank").limit(limit)
    out = first.withColumn("spent", F.row_number().over(Window.orderBy("program_id", "rank")))
    if named is None:
        return out
    return out.unionByName(named.select("program_id").distinct().join(out.select("program_id").distinct(), "program_id", "left_anti"), allowMissingColumns=True)


def inverted_index(texts: DataFrame, doc: str, text: str) -> DataFrame:
    """token, doc, positions (from 0), for a table sorted by token, whose row groups then prune."""
    rows = texts.select(F.col(doc), F.posexplode(english.words(F.col(text))).alias("position", "token"))
    return rows.groupBy("token", doc).agg(F.array_sort(F.collect_list("position")).alias("positions"))


def lookup(index: DataFrame, doc: str, terms: list[str]) -> DataFrame:
    """Documents that hold all terms, from the index alone."""
    hits = index.where(F.col("token").isin(terms)).groupBy(doc).agg(F.count_distinct("token").alias("n"))
    return hits.where(F.col("n") == len(set(terms))).select(doc)
