"""Program maps: how often, how mostly and how strongly courses map to outcomes; frequencies and wide reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomwork.operators.blocks import evenly

#: Colour of a tied cell.
TIE_COLOUR = "#FFFFFF"
#: Abbreviations from weak to strong, by kind of scale (fixed values).
HIERARCHIES = {
    "degree": ["I", "D", "A"],
    "ministry": ["Mi", "Ma", "S", "P"],
    "yes": ["Y"],
    "foundational": ["F", "E"],
}
GRADUATE = ("5", "6")


def program_pairs(maps: DataFrame, clos: DataFrame, plos: DataFrame, course_programs: DataFrame) -> DataFrame:
    """program_id, pl_outcome_id, course_id, course_required, l_outcome_id, map_scale_id of current program courses.

    Rows of a program and course are in one of TASKS tasks, so cells are counted and ranked where they meet.
    """
    rows = maps.join(clos.select("l_outcome_id", "course_id"), "l_outcome_id").join(plos.select("pl_outcome_id", "program_id"), "pl_outcome_id")
    return evenly(rows, course_programs.select("program_id", "course_id", "course_required"), ["program_id", "course_id"])


def one_level(pairs: DataFrame) -> DataFrame:
    """One level for each CLO and PLO: the least id, where the pair has several."""
    keys = ["program_id", "pl_outcome_id", "course_id", "l_outcome_id"]
    return pairs.groupBy(*keys).agg(F.min("map_scale_id").alias("map_scale_id"))


def frequency(pairs: DataFrame) -> DataFrame:
    """program_id, pl_outcome_id, course_id, map_scale_id, n, first (CLO that has it first)."""
    return pairs.groupBy("program_id", "pl_outcome_id", "course_id", "map_scale_id").agg(F.count("*").alias("n"), F.min("l_outcome_id").alias("first"))


def by_abbreviation(freq: DataFrame, scales: DataFrame) -> DataFrame:
    """Frequency by abbreviation; levels that share one merge."""
    rows = freq.join(scales.select("map_scale_id", "abbreviation"), "map_scale_id")
    return rows.groupBy("program_id", "pl_outcome_id", "course_id", "abbreviation").agg(F.sum("n").alias("n"))


def modes(freq: DataFrame, scales: DataFrame) -> DataFrame:
    """Most frequent level of each PLO and course; ties joined by ' / ' in first-seen order, with TIE_COLOUR."""
    cell = ["program_id", "pl_outcome_id", "course_id"]
    ranked = freq.withColumn("r", F.rank().over(Window.partitionBy(*cell).orderBy(F.desc("n")))).where("r = 1")
    rows = ranked.join(scales.select("map_scale_id", "abbreviation", "colour"), "map_scale_id")
    tied = F.array_sort(F.collect_list(F.struct("first", "map_scale_id", "abbreviation")))
    out = rows.groupBy(*cell).agg(tied.alias("tied"), F.max("colour").alias("colour"), F.max("n").alias("n"))
    label = F.array_join(F.transform("tied", lambda x: x["abbreviation"]), " / ")
    return out.select(*cell, label.alias("label"), F.when(F.size("tied") > 1, TIE_COLOUR).otherwise(F.col("colour")).alias("colour"), "n")


def _strength(kind: Column, abbreviation: Column, map_scale_id: Column) -> Column:
    """Place in the kind's hierarchy, from 1; a custom kind goes by id."""
    out = map_scale_id
    for name, order in HIERARCHIES.items():
        out = F.when(kind == name, F.array_position(F.array(*map(F.lit, order)), abbreviation)).otherwise(out)
    return out


def dominant(pairs: DataFrame, scales: DataFrame) -> DataFrame:
    """Strongest level of each PLO and course, in the hierarchy that its first mapping other than N/A belongs to.

    Mappings are seen by CLO, then level. Of equal strength the last seen wins. Mappings of other hierarchies have
    strength 0; a cell of N/A mappings only has none.
    """
    kinds = F.lit("custom")
    for name, order in HIERARCHIES.items():
        kinds = F.when(F.col("abbreviation").isin(order), name).otherwise(kinds)
    rows = pairs.where("map_scale_id <> 0").join(scales.select("map_scale_id", "abbreviation"), "map_scale_id").withColumn("kind", kinds)
    cell = ["program_id", "pl_outcome_id", "course_id"]
    first = rows.groupBy(*cell).agg(F.min_by("kind", F.struct("l_outcome_id", "map_scale_id")).alias("first_kind"))
    strength = _strength(F.col("first_kind"), F.col("abbreviation"), F.col("map_scale_id"))
    rows = rows.join(first, cell).withColumn("strength", strength)
    return rows.groupBy(*cell).agg(F.max_by("abbreviation", F.struct("strength", "l_outcome_id", "map_scale_id")).alias("dominant"))


def clo_lists(pairs: DataFrame, clos: DataFrame) -> DataFrame:
    """CLO phrases of each PLO and course, N/A left out, joined by ', ' in CLO order."""
    rows = pairs.where("map_scale_id <> 0").select("program_id", "pl_outcome_id", "course_id", "l_outcome_id").distinct()
    rows = rows.join(clos.select("l_outcome_id", "clo_shortphrase"), "l_outcome_id")
    listed = F.array_sort(F.collect_list(F.struct("l_outcome_id", "clo_shortphrase")))
    return rows.groupBy("program_id", "pl_outcome_id", "course_id").agg(F.array_join(F.transform(listed, lambda c: c["clo_shortphrase"]), ", ").alias("clos"))


def scale_matrix(pairs: DataFrame, plos: DataFrame, scale_ids: list[int]) -> DataFrame:
    """Mappings of each PLO at each level, one column a level, zeros too."""
    counts = pairs.groupBy("program_id", "pl_outcome_id").pivot("map_scale_id", scale_ids).agg(F.count("l_outcome_id"))
    named = counts.select("program_id", "pl_outcome_id", *[F.col(f"`{s}`").alias(f"level_{s}") for s in scale_ids])
    return plos.select("program_id", "pl_outcome_id").join(named, ["program_id", "pl_outcome_id"], "left").na.fill(0)


def ucwords(text: Column) -> Column:
    """The first letter of each blank-separated word upper-cased, the rest as it is."""
    return F.array_join(F.transform(F.split(text, " "), lambda w: F.concat(F.upper(F.substring(w, 1, 1)), F.substring(w, 2, 1 << 30))), " ")


def year_filter(course_num: Column, years: list[str]) -> Column:
    """Courses whose number starts with one of the digits; graduate years are '5' and '6'."""
    return F.coalesce(F.substring(course_num, 1, 1).isin(years), F.lit(False))


def assessment_frequency(methods: DataFrame, course_programs: DataFrame) -> DataFrame:
    """program_id, method, n; 'Final' joins 'Final Exam' in programs that have both."""
    rows = course_programs.select("program_id", "course_id").join(methods, "course_id").groupBy("program_id", ucwords(F.col("a_method")).alias("method")).agg(F.count("*").alias("n"))
    has_exam = F.max(F.when(F.col("method") == "Final Exam", 1)).over(Window.partitionBy("program_id"))
    merged = F.when((F.col("method") == "Final") & has_exam.isNotNull(), "Final Exam").otherwise(F.col("method"))
    return rows.withColumn("method", merged).groupBy("program_id", "method").agg(F.sum("n").alias("n"))


def activity_frequency(activities: DataFrame, course_programs: DataFrame) -> DataFrame:
    rows = course_programs.select("program_id", "course_id").join(activities, "course_id")
    return rows.groupBy("program_id", ucwords(F.col("l_activity")).alias("activity")).agg(F.count("*").alias("n"))


def priority_frequency(chosen: DataFrame, priorities: DataFrame, courses: DataFrame, course_programs: DataFrame) -> DataFrame:
    """program_id, op_id, optional_priority, subcat_name, n, courses ('CODE NUM' by course_id); in op_id order by id."""
    rows = course_programs.select("program_id", "course_id").join(chosen, "course_id").join(priorities, "op_id").join(courses.select("course_id", F.concat_ws(" ", "course_code", "course_num").alias("name")), "course_id")
    named = F.array_sort(F.collect_list(F.struct("course_id", "name")))
    return rows.groupBy("program_id", "op_id", "optional_priority", "subcat_name").agg(F.count("*").alias("n"), F.map_from_entries(named).alias("courses"))


def standards_matrix(maps: DataFrame, standards: DataFrame, scales: DataFrame, course_programs: DataFrame, courses: DataFrame) -> DataFrame:
    """Courses of each program at each standard and scale, zeros too, with their names; courses without maps don't count."""
    programs = course_programs.select("program_id").distinct()
    grid = programs.join(F.broadcast(standards.select("standard_id", "s_shortphrase").crossJoin(scales.select("standard_scale_id"))), F.lit(True))
    rows = course_programs.select("program_id", "course_id").join(maps, "course_id").join(courses.select("course_id", F.concat_ws(" ", "course_code", "course_num").alias("name")), "course_id")
    listed = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("course_id", "name"))), lambda c: c["name"]), ", ")
    counts = rows.groupBy("program_id", "standard_id", "standard_scale_id").agg(F.count("*").alias("n"), listed.alias("courses"))
    out = grid.join(counts, ["program_id", "standard_id", "standard_scale_id"], "left")
    return out.select("program_id", "standard_id", "s_shortphrase", "standard_scale_id", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("courses", F.lit("")).alias("courses"))


def mapped_to_program(course_programs: DataFrame, clos: DataFrame, pairs: DataFrame) -> DataFrame:
    """program_id, course_id, mapped: there are CLOs and each maps to an outcome of the program."""
    done = pairs.select("program_id", "l_outcome_id").distinct().withColumn("done", F.lit(True))
    rows = course_programs.select("program_id", "course_id").join(clos.select("course_id", "l_outcome_id"), "course_id", "left").join(done, ["program_id", "l_outcome_id"], "left")
    every = F.bool_and(F.coalesce("done", F.lit(False))) & (F.count("l_outcome_id") > 0)
    return rows.groupBy("program_id", "course_id").agg(F.when(every, "Yes").otherwise("No").alias("mapped"))


def pivot_marks(rows: DataFrame, key: list[str], label: Column, labels: list[str]) -> DataFrame:
    """One row a key, one column a label: 1 or null. Rows that share a label merge."""
    return rows.withColumn("_label", label).groupBy(*key).pivot("_label", labels).agg(F.max(F.lit(1)))


def category_usage(plos: DataFrame) -> DataFrame:
    """program_id, categories used, outcomes without one, and whether there are such."""
    return plos.groupBy("program_id").agg(F.count_distinct("plo_category_id").alias("categories"), F.count_if(F.col("plo_category_id").isNull()).alias("uncategorized"), F.bool_or(F.col("plo_category_id").isNull()).alias("has_uncategorized"))


def default_numbers(plos: DataFrame) -> DataFrame:
    """'PLO #n' within each program: by category, those without one last, then by id."""
    order = Window.partitionBy("program_id").orderBy(F.col("plo_category_id").asc_nulls_last(), "pl_outcome_id")
    n = F.row_number().over(order)
    return plos.select("program_id", "pl_outcome_id", F.coalesce("plo_shortphrase", F.concat(F.lit("PLO #"), n.cast("string"))).alias("label"), n.alias("n"))


UNCATEGORIZED = "Uncategorized"


def outcome_map_sheet(cells: DataFrame, plos: DataFrame, categories: DataFrame, label: str) -> DataFrame:
    """program_id, place, pl_outcome_id, category, heading (it opens its category), cells, of every outcome.

    cells has program_id, pl_outcome_id, course_id and a label column; a row's cells are (course_id, label) by course,
    none where no course maps to the outcome. Categories go by id, outcomes without one last under UNCATEGORIZED.
    """
    keys = ["program_id", "pl_outcome_id"]
    row = cells.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("course_id", F.col(label).alias("label")))).alias("cells"))
    order = Window.partitionBy("program_id").orderBy(F.col("plo_category_id").asc_nulls_last(), "pl_outcome_id")
    opens = F.row_number().over(Window.partitionBy("program_id", "plo_category_id").orderBy("pl_outcome_id")) == 1
    named = plos.join(categories.select("plo_category_id", "plo_category"), "plo_category_id", "left")
    # outcomes are numbered before they get their cells, which would all be sorted by program
    rows = named.select(*keys, F.row_number().over(order).alias("place"), F.coalesce("plo_category", F.lit(UNCATEGORIZED)).alias("category"), opens.alias("heading")).join(row, keys, "left")
    return rows.select("program_id", "place", "pl_outcome_id", "category", "heading", F.coalesce("cells", F.array().cast("array<struct<course_id:bigint,label:string>>")).alias("cells"))


def weighted_heading(name: Column, weight: Column) -> Column:
    """'name (weight%)', the name with ucwords, the weight without needless zeros; without a weight the name alone."""
    number = F.regexp_replace(F.format_string("%.2f", weight.cast("double")), r"\.?0+$", "")
    return F.when(weight.isNull(), ucwords(name)).otherwise(F.concat(ucwords(name), F.lit(" ("), number, F.lit("%)")))


def marks(rows: DataFrame, key: list[str], heading: Column) -> DataFrame:
    """key and heading of each cell of a pivot sheet that holds a 1; equal headings merge. No list of headings needed."""
    return rows.select(*key, heading.alias("heading")).distinct()


#: Level of a program and the category of standards that it is held to (fixed values).
STANDARD_CATEGORIES = {"Undergraduate": 1, "Bachelors": 1, "Masters": 2, "Doctoral": 3}


def standards_of_level(standards: DataFrame, programs: DataFrame, categories: dict[str, int] = STANDARD_CATEGORIES) -> DataFrame:
    """program_id and the standards of the category that its level asks for; other levels have none."""
    category = F.lit(None).cast("long")
    for level, number in categories.items():
        category = F.when(F.col("level") == level, number).otherwise(category)
    return programs.select("program_id", category.alias("standard_category_id")).join(standards, "standard_category_id")


def standards_counts(maps: DataFrame, standards: DataFrame, scales: DataFrame, programs: DataFrame, course_programs: DataFrame) -> DataFrame:
    """Courses of each program at each standard of its level and scale, zeros too; courses without any map don't count."""
    wanted = standards_of_level(standards, programs).select("program_id", "standard_id", "s_shortphrase")
    ids = F.array_sort(F.collect_set("standard_scale_id"))
    grid = wanted.join(scales.agg(ids.alias("ids")), F.lit(True)).select("*", F.explode("ids").alias("standard_scale_id")).drop("ids")  # one row of scales
    counts = course_programs.select("program_id", "course_id").join(maps, "course_id").groupBy("program_id", "standard_id", "standard_scale_id").agg(F.count("*").alias("n"))
    return grid.join(counts, ["program_id", "standard_id", "standard_scale_id"], "left").withColumn("n", F.coalesce("n", F.lit(0)))
