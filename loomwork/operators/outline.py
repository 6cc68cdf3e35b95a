"""Sections of documents: lines in order, headings as events, and windows that carry the last event on.

documents(document_id, text) become a row for each line. A heading's section goes on until the next event, so a
section is an island between events of a running window; items of lists are islands between lines that begin one.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from loomwork.functions.english import STOP_WORDS
from loomwork.operators.syllabus import BULLET, CITATION, CLOSING, COLUMN_LINES, ENDING_HEADINGS, INNER_HEADINGS, SECTIONS, TOPIC_WORDS, bullet_shape, clean_materials, clean_topics, material_type

#: Most words of a heading that no list knows.
HEADING_WORDS = 3
COURSE_CODE = r"^[A-Z]{4} ?\d{3}"


def _in_order() -> WindowSpec:
    return Window.partitionBy("document_id").orderBy("at")


def lines(documents: DataFrame) -> DataFrame:
    """document_id, at (from 0), line of each line, trimmed, blank ones too; a null text has none."""
    rows = documents.select("document_id", F.posexplode(F.split("text", r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]")).alias("at", "line"))
    return rows.select("document_id", "at", F.regexp_replace("line", r"(?U)^\s+|\s+$", "").alias("line"))


def plain(line: Column) -> Column:
    """A heading as the lists have it: without bullet, marks at its end and double blanks, lower case."""
    bare = F.regexp_replace(F.lower(F.regexp_replace(line, BULLET, "")), r"[:.]+$", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def _all_upper(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"\p{Ll}")


def _titled(text: Column) -> Column:
    return text.rlike(r"\p{Lu}") & ~text.rlike(r"(?<!\p{L})\p{Ll}") & ~text.rlike(r"(?<=\p{L})\p{Lu}")


def opened(line: Column) -> Column:
    """The section that a line opens, '' if it only closes one, null if it is no heading. After a colon counts too."""
    names = {h: name for name, some in SECTIONS.items() for h in some} | dict.fromkeys(CLOSING, "")
    known = F.create_map(*[F.lit(x) for pair in names.items() for x in pair])
    head = plain(line)
    after = F.trim(F.regexp_extract(head, r":\s*(.+)$", 1))
    short = (F.size(F.split(line, r"\s+")) <= HEADING_WORDS) & _all_upper(line) & ~line.rlike(COURSE_CODE)
    return F.when(line != "", F.coalesce(F.element_at(known, head), F.element_at(known, after), F.when(short, "")))


def ends_description(line: Column, only_upper: Column, shape: Column, stop_words: Iterable[str] = STOP_WORDS) -> Column:
    """Whether a line is a heading that ends a description: of HEADING_WORDS words at most, and in upper case or, but for
    stop words and unless the description's own heading is in upper case, each with a capital.

    shape is that of the bullet before the description's heading: a line with one alike ends it too.
    """
    low = F.lower(line)
    inner = low.isin(INNER_HEADINGS) | F.replace(low, F.lit(":"), F.lit("")).isin(INNER_HEADINGS) | line.rlike(COURSE_CODE)
    stops = F.array(*[F.lit(w) for w in sorted(stop_words)])
    words = F.array_join(F.filter(F.regexp_extract_all(line, F.lit(r"(?U)(\w+)"), 1), lambda w: ~F.array_contains(stops, F.lower(w))), " ")
    alike = F.coalesce(bullet_shape(line) == shape, F.lit(False))
    short = (line != "") & (F.size(F.split(line, r"\s+")) <= HEADING_WORDS)
    return ~inner & (alike | (short & (_all_upper(words) | (~only_upper & (_titled(words) | F.lower(words).isin(ENDING_HEADINGS))))))


def placed_lines(documents: DataFrame) -> DataFrame:
    """document_id, at, line, event, section of every line; event: the section that the line opens, '' if it ends one.

    A heading opens a section and ends the one before. Any short line in upper case ends one; a description ends at a
    heading that no list knows, too.
    """
    rows = lines(documents).withColumn("event", opened(F.col("line")))
    own = F.when(F.col("event") == "description", F.struct(_all_upper(F.col("line")).alias("upper"), bullet_shape(F.col("line")).alias("shape")))
    rows = rows.withColumns({"section": F.last("event", ignorenulls=True).over(_in_order()), "head": F.last(own, ignorenulls=True).over(_in_order())})
    ends = F.when((F.col("section") == "description") & ends_description(F.col("line"), F.col("head.upper"), F.col("head.shape")), "")
    rows = rows.select("document_id", "at", "line", F.coalesce("event", ends).alias("event"))
    return rows.withColumn("section", F.last("event", ignorenulls=True).over(_in_order()))


def section_lines(documents: DataFrame) -> DataFrame:
    """document_id, at, line, section of the lines that stand in one, headings left out, blank lines kept."""
    return placed_lines(documents).where("event is null and section <> ''").select("document_id", "at", "line", "section")


def sections(documents: DataFrame) -> DataFrame:
    """document_id and the items of each section (arrays, in order) of every document; null text has none.

    A line with a bullet begins an item, any other goes on with the one before if it begins in lower case or the line
    before ends with a comma or hyphen.
    """
    rows = section_lines(documents).where("line <> ''")
    by_section = Window.partitionBy("document_id", "section").orderBy("at")
    before = F.lag("line").over(by_section)
    first = F.substring("line", 1, 1)
    goes_on = ~F.col("line").rlike(BULLET) & ((first.rlike(r"\p{Ll}")) | before.rlike("[,-]$"))
    rows = rows.withColumn("begins", F.when(before.isNotNull() & goes_on, 0).otherwise(1))
    rows = rows.withColumn("item", F.sum("begins").over(by_section))
    part = F.when(F.col("begins") == 1, F.regexp_replace("line", BULLET, "")).otherwise(F.col("line"))
    ordered = lambda c: F.transform(F.array_sort(F.collect_list(F.struct("at", c))), lambda x: x["part"])
    items = rows.withColumn("part", part).groupBy("document_id", "section", "item").agg(F.array_join(ordered("part"), " ").alias("text"))
    lists = items.groupBy("document_id", "section").agg(F.transform(F.array_sort(F.collect_list(F.struct("item", "text"))), lambda x: x["text"]).alias("items"))
    by_name = lists.groupBy("document_id").agg(*[F.max(F.when(F.col("section") == n, F.col("items"))).alias(n) for n in SECTIONS])
    none = F.array().cast("array<string>")
    return documents.select("document_id").join(by_name, "document_id", "left").select("document_id", *[F.coalesce(n, none).alias(n) for n in SECTIONS])


#: What stands before a topic on its line: a list marker, a part of the course, a day of a month (fixed patterns).
LIST_MARKER = r"(?i)^((?:\d+|[ivxlcdm]+)[.)]|[•\-–*¢●])\s*"
LEADS = [BULLET, r"(?i)^(?:module|week|unit|lecture)\s+(?:\d+|[ivxlcdm]+)[.:–—-]\s*(?=.)", r"(?i)^(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+\d{1,2}[,:]?\s+(?=.)"]


def text_topics(documents: DataFrame) -> DataFrame:
    """document_id, topic of documents whose topics stand in lines of a topic section; cleaned. Null text has none.

    List items, if any line has a marker (one alone on its line takes the next line). Else what follows a lead, such as
    'Module 2:' or 'Sep 5', and plain lines of TOPIC_WORDS words that don't end in a period.
    """
    line = F.col("line")
    rows = section_lines(documents).where((F.col("section") == "topics") & (line != "") & ~plain(line).isin(COLUMN_LINES))
    marked, rest = line.rlike(LIST_MARKER), F.regexp_replace(line, LIST_MARKER, "")
    alone = F.coalesce(F.lag(marked & (rest == "")).over(_in_order()), F.lit(False))
    item = F.when(marked, F.nullif(rest, F.lit(""))).when(alone, line)
    words = F.size(F.split(line, r"\s+"))
    other = F.when((words >= TOPIC_WORDS[0]) & (words <= TOPIC_WORDS[1]) & ~line.endswith("."), line)
    for lead in reversed(LEADS):
        other = F.when(line.rlike(lead), F.trim(F.regexp_replace(line, lead, ""))).otherwise(other)
    rows = rows.select("document_id", "at", item.alias("item"), other.alias("other"))
    listed = lambda c: F.transform(F.array_sort(F.collect_list(F.when(F.col(c).isNotNull(), F.struct("at", F.col(c).alias("t"))))), lambda x: x["t"])
    both = rows.groupBy("document_id").agg(listed("item").alias("items"), listed("other").alias("others"))
    chosen = F.when(F.size("items") > 0, F.col("items")).otherwise(F.col("others"))
    return both.select("document_id", F.explode(clean_topics(chosen)).alias("topic"))


#: Lines that say what the materials below them are, words of materials, and phrases of instructions (fixed values).
MATERIAL_LABELS = [
    "required textbook", "required textbooks", "optional textbook", "optional textbooks", "optional articles", "optional article", "required readings", "required reading",
    "optional reading", "optional readings", "optional text for lectures", "optional text for labs", "digital resources", "course materials", "other course materials",
    "recommended literature sources", "textbook and references", "required documentary / video content", "podcast and audio media", "websites and online articles",
    "recomended literature sources", "learning materials", "learning materials and technology requirements", "podcast", "online articles",
    "required and optional readings", "video", "textbook", "primary textbook", "primary textbooks", "course textbook", "course textbooks", "required course materials",
    "course readings and materials", "readings", "iclicker", "suggested reading materials", "e-books on r", "e-books on choosing and fitting models", "other useful books",
    "required equipment",
]
MATERIAL_WORDS = ["textbook", "edition", "readings", "reading", "slides", "canvas", "software", "arcgis", "qgis", "calculator", "journal articles", "case studies", "documentary", "video", "podcast", "website", "portal", "articles", "article", "book"]
INSTRUCTIONS = [
    "students can access", "students can purchase", "hardcopies are also available", "most required readings", "required readings that are not from", "course canvas website",
    "supplementary readings", "all course materials will be posted", "use of canvas", "make sure that you can access canvas", "problem, please contact", "note: to download",
    "to download this book", "students can read parts of", "another good overview", "downloaded from", "suggested technical requirements", "you will need a laptop",
    "module 0 on canvas", "obtain at least one reference book", "recommendations for e-books", "not be required to purchase", "readings can all be accessed",
    "slides for each lecture", "available at canvas", "regularly login to your course page", "announcements, assignments", "learning management system",
]
#: A name, a comma and a year: the form of an entry of a bibliography; signs of a publication; books that a paragraph
#: without a required textbook recommends (fixed patterns).
BIBLIOGRAPHY = r"^[A-Z][^\n]{0,120},[^\n]*\b(?:\(\d{4}\)|\d{4})\b\.?\s+.+"
PUBLISHED = r"\b(?:19|20)\d{2}\b|(?i:\b(Springer|CRC|Wiley|Press|Publishing|Editions|journal|proceedings)\b)"
RECOMMENDED = r"(?i)recommended reading:\s*(.+?\(\d{4}\))\s+and\s+(.+?\(\d{4}\))"
NUMBERED, SIGNED = r"^\d{1,2}[.)]\s+", r"^(?:[•\-–*¢●]|\([a-zA-Z]\)|G)\s+"
PLAIN_LABEL, BARE_LABEL = "Course materials", "resource for course"


def materials(documents: DataFrame) -> DataFrame:
    """document_id, place, name, type, description of the materials that material sections list; cleaned, each once.

    A numbered or signed line, a citation, a line that names a kind of material, and a paragraph on no required textbook
    begin an entry. Other lines go on with it, as citations wrap, until a blank line, a label, an instruction, or the
    next entry. A label describes the entries below it. Numbered entries count if they name a year or a publisher,
    signed ones if they look cited, stand below a label or name a kind of material; of a paragraph on no required
    textbook the books count that it recommends.
    """
    line, low = F.col("line"), plain(F.col("line"))
    rows = placed_lines(documents).where("section = 'materials'")  # its headings are labels, too
    label = low.isin(MATERIAL_LABELS) | low.contains("suggested reading materials")
    any_of = lambda c, some: F.exists(F.array(*map(F.lit, some)), lambda w: F.contains(c, w))
    stops = (line == "") | F.col("event").isNotNull() | label | any_of(low, INSTRUCTIONS) | low.startswith("http") | low.startswith("technology requirements")
    cited = line.rlike(CITATION) | line.rlike(BIBLIOGRAPHY)
    kind = F.when(stops, "").when(low.contains("no required textbook"), "none required").when(line.rlike(NUMBERED), "numbered").when(line.rlike(SIGNED), "signed").when(cited, "cited")
    rows = rows.withColumns({"kind": kind, "label": F.when(label, F.regexp_replace("line", ":+$", "")), "named": any_of(low, MATERIAL_WORDS)})
    # a line of no kind begins an entry of its own where there is none to go on with and it names a material
    last = F.last("kind", ignorenulls=True).over(_in_order())
    free = F.col("kind").isNull() & (F.coalesce(last, F.lit("")) == "") & F.col("named")
    rows = rows.withColumn("kind", F.when(free, "named").otherwise(F.col("kind")))
    rows = rows.withColumns({"entry": F.count("kind").over(_in_order()), "of": F.last("kind", ignorenulls=True).over(_in_order()), "under": F.last("label", ignorenulls=True).over(_in_order())})
    rows = rows.where("of <> ''")
    joined = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "line"))), lambda x: x["line"]), " ")
    entries = rows.groupBy("document_id", "entry", "of", "under").agg(F.min("at").alias("at"), joined.alias("whole"), F.max("named").alias("named"))
    whole = F.trim(F.regexp_replace(F.regexp_replace("whole", NUMBERED, ""), SIGNED, ""))
    entries = entries.withColumn("name", whole)
    books = F.array(*[F.regexp_replace(F.trim(F.regexp_extract("name", RECOMMENDED, k)), "[ ,.]+$", "") for k in (1, 2)])
    looks_cited = F.col("name").rlike(CITATION) | F.col("name").rlike(BIBLIOGRAPHY) | F.col("name").rlike(r"\b(?:\(\d{4}\)|\d{4})\.$")
    counts = F.when(F.col("of") == "numbered", F.col("name").rlike(PUBLISHED)).when(F.col("of") == "signed", looks_cited | F.col("under").isNotNull() | F.col("named")).otherwise(True)
    listed = F.when(F.col("of") == "none required", F.filter(books, lambda b: b != "")).when(counts, F.array("name")).otherwise(F.array().cast("array<string>"))
    described = F.when(F.col("of") == "none required", "recommended reading").otherwise(F.coalesce("under", F.when(F.col("of") == "named", BARE_LABEL).otherwise(PLAIN_LABEL)))
    each = entries.select("document_id", "at", described.alias("description"), F.coalesce("under", F.lit("")).alias("under"), F.posexplode(listed).alias("k", "name"))
    rows = each.select("document_id", (F.col("at") * 2 + F.col("k")).alias("place"), "name", material_type(F.col("name"), F.col("under")).alias("type"), "description")
    return clean_materials(rows)
