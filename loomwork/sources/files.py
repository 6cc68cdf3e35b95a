"""File sources: outcome sheets, labelled tables, the Bloom workbook, model output lines, PDF and OCR text."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Rows of an outcome sheet that are read, header included.
SHEET_ROWS = 30
#: Words that OCR is less sure of are left out; its pixels become points at this resolution.
OCR_CONFIDENCE, OCR_DPI = 40, 300

OUTCOMES = "outcome string, shortphrase string"
LABELLED = "clo string, plo string, score int"
PAGES = "document_id long, page_number int, lines array<struct<text:string,size:double,bold:boolean>>"
#: A result line's object (fixed names).
MAPPING = "struct<id:string,CLO:string,Accreditation_Standard:string,is_mapped:boolean,mapLabels:array<string>,explanation:string>"


def read_outcomes(spark: SparkSession, path: str) -> DataFrame:
    """outcome, shortphrase of an outcome sheet: the first two columns, header and rows without an outcome skipped.

    A csv path is read by Spark; a workbook goes through pandas on the driver, SHEET_ROWS rows of it at most.
    """
    if path.endswith((".xlsx", ".xls")):
        sheet = pd.read_excel(path, header=None, skiprows=1, nrows=SHEET_ROWS, usecols=[0, 1], dtype=str)
        rows = spark.createDataFrame([[None if pd.isna(v) else v for v in r] for r in sheet.values.tolist()], OUTCOMES)
    else:
        rows = spark.read.csv(path, schema=OUTCOMES, header=True, multiLine=True).limit(SHEET_ROWS)
    return rows.where(F.trim("outcome") != "")


def read_labelled(spark: SparkSession, path: str) -> DataFrame:
    """clo, plo, score, id (row number + 1, so the first row has 2) of a Latin-1 csv file."""
    rows = spark.read.csv(path, schema=LABELLED, header=True, encoding="ISO-8859-1")
    # rows of one split of one file have ascending ids; splits go by file and offset, and are few
    rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"), F.monotonically_increasing_id().alias("_at"))
    splits = rows.groupBy("_file", "_block").agg(F.min("_at").alias("_first"), F.count("*").alias("_n"))
    splits = splits.withColumn("_before", F.sum("_n").over(Window.orderBy("_file", "_block")) - F.col("_n")).drop("_n")
    out = rows.join(F.broadcast(splits), ["_file", "_block"])  # a row for each input split
    return out.withColumn("id", F.col("_before") + F.col("_at") - F.col("_first") + 2).drop("_file", "_block", "_at", "_first", "_before")


def bloom_rows(rows: DataFrame) -> DataFrame:
    """domain, position, level, term of workbook rows (row, domain, n, proto_verb, verb); raises on what it can't take.

    Formulas, blanks, positions that are no positive number, texts over 255 characters and two names for a position
    stop the import. A level's name adds its own parts as terms, after its verbs; terms are distinct in any case, the
    first spelling by row stays. Without a column row the least spelling does.
    """
    columns = ["domain", "n", "proto_verb", "verb"]
    bad = F.lit(False)
    for c in columns:
        text = F.trim(F.coalesce(F.col(c).cast("string"), F.lit("")))
        bad = bad | (text == "") | text.startswith("=") | (F.length(text) > 255)
    bad = bad | ~F.coalesce(F.expr("try_cast(n as int)") > 0, F.lit(False))
    checked = rows.withColumn("_ok", F.when(bad, F.raise_error(F.concat(F.lit("bad Bloom row: "), F.to_json(F.struct(*columns))))).otherwise(F.lit(True))).where("_ok")
    place = F.col("row").cast("long") if "row" in rows.columns else F.lit(0).cast("long")
    clean = checked.select(place.alias("place"), F.trim("domain").alias("domain"), F.col("n").cast("int").alias("position"), F.trim("proto_verb").alias("level"), F.trim("verb").alias("verb"))
    names = clean.groupBy("domain", "position").agg(F.count_distinct(F.lower("level")).alias("names"), F.min(F.struct("place", "level"))["level"].alias("level"))
    one = F.when(F.col("names") > 1, F.raise_error(F.concat(F.lit("two names for level "), F.col("position").cast("string")))).otherwise(F.col("level"))
    names = names.select("domain", "position", one.alias("level"))
    own = names.select("domain", "position", "level", F.lit(None).cast("long").alias("place"), F.explode(F.split("level", "[&()]")).alias("term"))
    terms = clean.drop("level").join(names, ["domain", "position"]).select("domain", "position", "level", "place", F.col("verb").alias("term")).unionByName(own)
    terms = terms.withColumn("term", F.trim("term")).where("term <> ''").withColumn("last", F.col("place").isNull())
    first = F.min(F.struct("last", "place", "term"))["term"]
    return terms.groupBy("domain", "position", "level", F.lower("term").alias("key")).agg(first.alias("term")).drop("key")


def same_rows(a: DataFrame, b: DataFrame) -> bool:
    """Equal as sets of rows with repeats."""
    return a.exceptAll(b.select(a.columns)).isEmpty() and b.select(a.columns).exceptAll(a).isEmpty()


def import_reference(new: DataFrame, old: DataFrame | None, replace: bool = False) -> DataFrame | None:
    """What to write: None if nothing changes; ValueError if it would replace rows and may not."""
    if old is None or old.isEmpty():
        return new
    if same_rows(new, old):
        return None
    if not replace:
        raise ValueError("a different reference is there; ask for a replacement")
    return new


def parse_result_lines(lines: DataFrame) -> DataFrame:
    """lines with object (MAPPING) and bad, of model output in the column value: list-wrapped or plain, thinking cut off, truncated mended."""
    text = F.trim("value")
    wrapped = F.from_json(text, "array<struct<generated_text:string>>")
    plain = F.from_json(text, "struct<generated_text:string>")
    inner = F.coalesce(F.try_element_at(wrapped, F.lit(1))["generated_text"], plain["generated_text"], text)
    inner = after_thinking(inner)
    out = lines.where(F.trim("value") != "").withColumn("inner", inner)
    direct = F.from_json("inner", MAPPING)
    mended = F.from_json(repaired("inner"), MAPPING)
    fallback = F.from_json(F.to_json(line_fields(F.col("inner"))), MAPPING)
    usable = lambda o: F.when(o["id"].isNotNull(), o)
    found = F.coalesce(usable(direct), usable(mended), usable(fallback))
    return out.withColumns({"object": found, "bad": found.isNull()}).drop("inner")


def after_thinking(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"(?s)^.*</think>", ""))


def repaired(name: str) -> Column:
    """JSON with the quote and the brace that a cut-off end lacks."""
    text = F.rtrim(F.col(name))
    odd = F.regexp_count(text, F.lit(r'(?<!\\)"')) % 2 == 1
    quoted = F.when(odd, F.concat(text, F.lit('"'))).otherwise(text)
    return F.when(quoted.endswith("}"), quoted).otherwise(F.concat(quoted, F.lit("}")))


def line_fields(text: Column) -> Column:
    """The fields of an answer written as 'name: value' lines instead of JSON."""
    of = lambda name: F.nullif(F.trim(F.regexp_extract(text, rf"(?im)^\W*{name}\W*:\s*\"?(.*?)\"?,?\s*$", 1)), F.lit(""))
    labels = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(of("mapLabels"), F.lit("")), r"[\[\]\"']", ""), ","), lambda x: F.trim(x)), lambda x: x != "")
    return F.struct(of("id").alias("id"), of("clo").alias("CLO"), of("accreditation_standard").alias("Accreditation_Standard"), (F.lower(of("is_mapped")) == "true").alias("is_mapped"), labels.alias("mapLabels"), of("explanation").alias("explanation"))


def pair_ids(pair: Column) -> Column:
    """struct<clo:long, plo:long> of 'clo-1__plo-2', nulls where it is none."""
    part = lambda i: F.nullif(F.regexp_extract(pair, r"^clo-(\d+)__plo-(\d+)$", i), F.lit("")).cast("long")
    return F.struct(part(1).alias("clo"), part(2).alias("plo"))


def read_pdf_pages(files: DataFrame, decode: Callable[[bytes], list[list[dict]]]) -> DataFrame:
    """document_id, page_number, lines of binary files (document_id, content); decode gives lines for each page.

    There is no PDF decoder in the JVM, so the decoder is the caller's and runs in mapInPandas, a file at a time.
    """

    def pages(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in parts:
            for doc, content in zip(part["document_id"], part["content"], strict=True):
                rows = [(doc, n, lines) for n, lines in enumerate(decode(bytes(content)), 1)]
                yield pd.DataFrame(rows, columns=["document_id", "page_number", "lines"])

    return files.select("document_id", "content").mapInPandas(pages, PAGES)


def ocr_lines(words: DataFrame) -> DataFrame:
    """Lines of OCR words (document_id, page_number, block, paragraph, line, word, text, confidence, height in pixels)."""
    sure = words.where((F.col("confidence") >= OCR_CONFIDENCE) & (F.trim("text") != ""))
    rows = sure.groupBy("document_id", "page_number", "block", "paragraph", "line").agg(F.array_sort(F.collect_list(F.struct("word", "text"))).alias("w"), F.median("height").alias("h"))
    return rows.select("document_id", "page_number", "block", "paragraph", "line", F.array_join(F.transform("w", lambda x: x["text"]), " ").alias("text"), F.round(F.col("h") * 72 / OCR_DPI, 1).alias("size"))


def cloud_ocr_pages(blocks: DataFrame) -> DataFrame:
    """document_id, page_number, lines of a cloud OCR answer's blocks (document_id, kind, page, position, text)."""
    rows = blocks.where("kind = 'LINE'").groupBy("document_id", F.col("page").alias("page_number"))
    return rows.agg(F.transform(F.array_sort(F.collect_list(F.struct("position", "text"))), lambda x: x["text"]).alias("lines"))


def needs_ocr(text: Column, threshold: int = 0) -> Column:
    return F.length(F.trim(F.coalesce(text, F.lit("")))) <= threshold


def split_uri(uri: Column) -> Column:
    """struct<bucket, key> of 's3://bucket/key'."""
    return F.struct(F.regexp_extract(uri, r"^s3://([^/]+)/(.*)$", 1).alias("bucket"), F.regexp_extract(uri, r"^s3://([^/]+)/(.*)$", 2).alias("key"))
