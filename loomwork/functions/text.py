"""Scalar text functions as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F


def squeezed(text: Column) -> Column:
    """Trimmed, with runs of white space as one blank."""
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def slug(text: Column, limit: int = 60) -> Column:
    """Lower-case letters and digits with hyphens between, `limit` characters at most."""
    return F.substring(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "-"), "^-|-$", ""), 1, limit)


def escaped(text: Column) -> Column:
    """HTML-escaped, with <mark> tags put back."""
    out = text
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        out = F.replace(out, F.lit(char), F.lit(entity))
    for tag in ("mark", "/mark"):
        out = F.replace(out, F.lit(f"&lt;{tag}&gt;"), F.lit(f"<{tag}>"))
    return out


def one_decimal(number: Column) -> Column:
    return F.format_number(number, 1)


def email_parts(email: Column) -> Column:
    """struct<local, domain>."""
    return F.struct(F.element_at(F.split(email, "@"), 1).alias("local"), F.try_element_at(F.split(email, "@"), F.lit(2)).alias("domain"))


def safe_name(text: Column, other: str = "_") -> Column:
    """File-name letters only."""
    return F.regexp_replace(text, r"[^A-Za-z0-9._-]+", other)


def job_name(text: Column, limit: int = 63) -> Column:
    """Letters, digits and hyphens, as job names allow."""
    return F.substring(F.regexp_replace(F.regexp_replace(text, r"[^A-Za-z0-9-]+", "-"), "^-+", ""), 1, limit)


def title_case(text: Column) -> Column:
    return (text == F.initcap(text)) & (text != F.lower(text))


def upper_case(text: Column) -> Column:
    return (text == F.upper(text)) & (text != F.lower(text))


def preset(text: Column) -> Column:
    """A saved search: view, properties, course_codes, course_levels, program_ids; lists distinct and sorted."""
    p = F.from_json(text, "struct<view:string,properties:array<string>,course_codes:array<string>,course_levels:array<int>,program_ids:array<bigint>>")
    some = lambda c, kind: F.array_sort(F.array_distinct(F.coalesce(c, F.array().cast(f"array<{kind}>"))))
    codes = F.transform(some(p["course_codes"], "string"), lambda c: F.upper(F.trim(c)))
    return F.struct(F.coalesce(p["view"], F.lit("courses")).alias("view"), some(p["properties"], "string").alias("properties"), F.array_sort(F.array_distinct(codes)).alias("course_codes"), some(p["course_levels"], "int").alias("course_levels"), some(p["program_ids"], "bigint").alias("program_ids"))


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value) with the value computed once: within functions over arrays Spark repeats an expression that stands there."""
    return F.get(F.transform(F.array(value), use), F.lit(0))
