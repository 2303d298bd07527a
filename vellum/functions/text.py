"""Text functions with the white space, rounding and case rules of browser scripts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What a script's \s and trim() match.
SPACE = "\\t\\n\\x0B\\f\\r \\u00A0\\u1680\\u2000-\\u200A\\u2028\\u2029\\u202F\\u205F\\u3000\\uFEFF"
NUMBER = "^[+-]?(?:[0-9]+\\.?[0-9]*|\\.[0-9]+)(?:[eE][+-]?[0-9]+)?"


def half_up(c: Column) -> Column:
    """Round half towards plus infinity."""
    return F.floor(c + F.lit(0.5))


def trim(c: Column) -> Column:
    return F.regexp_replace(c, f"^[{SPACE}]+|[{SPACE}]+$", "")


def single_blanks(c: Column) -> Column:
    """Runs of white space become one blank, at the ends too."""
    return F.regexp_replace(c, f"[{SPACE}]+", " ")


def squeeze(c: Column) -> Column:
    """Runs of white space become one blank; ends are trimmed."""
    return trim(single_blanks(c))


def bare_length(c: Column) -> Column:
    """Characters that aren't white space; 0 for null."""
    return F.coalesce(F.length(F.regexp_replace(c, f"[{SPACE}]+", "")), F.lit(0))


def leading_number(c: Column) -> Column:
    """The number a text begins with, as double; null if there is none."""
    return F.nullif(F.regexp_extract(trim(c), NUMBER, 0), F.lit("")).cast("double")


def pad_left(c: Column, width: int, fill: str = "0") -> Column:
    """Pad but never cut."""
    return F.when(F.length(c) >= width, c).otherwise(F.lpad(c, width, fill))


def pad_right(c: Column, width: int, fill: str = " ") -> Column:
    return F.when(F.length(c) >= width, c).otherwise(F.rpad(c, width, fill))


def utf16_prefix(c: Column, n: int) -> Column:
    """The first n UTF-16 units, as scripts count; a character that would be cut in half is left out."""
    units = F.encode(c, "UTF-16BE")
    half = F.hex(F.substring(units, 2 * n - 1, 1)).between("D8", "DB") & (F.length(units) > 2 * n)
    cut = F.decode(F.substring(units, F.lit(1), F.when(half, 2 * n - 2).otherwise(2 * n)), "UTF-16BE")
    return F.when(F.length(c) * 2 == F.length(units), F.substring(c, 1, n)).otherwise(cut)


def number_text(c: Column) -> Column:
    """A number as scripts print it: no ``.0`` at the end; null as null."""
    return F.coalesce(F.regexp_replace(c.cast("double").cast("string"), r"\.0$", ""), F.lit("null"))


def page_title(html: Column, fallback: Column) -> Column:
    """The trimmed title element, else the first 60 units of the first h1 without tags, else the fallback."""
    title = trim(F.regexp_extract(html, "(?is)<title[^>]*>(.*?)</title>", 1))
    h1 = utf16_prefix(trim(F.regexp_replace(F.regexp_extract(html, "(?is)<h1[^>]*>(.*?)</h1>", 1), "<[^>]+>", "")), 60)
    return F.coalesce(F.nullif(title, F.lit("")), F.nullif(h1, F.lit("")), fallback)


def card_title(html: Column, number: Column) -> Column:
    """The variant shown in lists: tags are stripped from titles too, both are cut at 60, fallback ``Slide N``."""
    def clean(tag: str) -> Column:
        found = F.regexp_extract(html, f"(?is)<{tag}[^>]*>(.*?)</{tag}>", 1)
        return F.nullif(utf16_prefix(trim(F.regexp_replace(found, "<[^>]+>", "")), 60), F.lit(""))

    return F.coalesce(clean("title"), clean("h1"), F.concat(F.lit("Slide "), number.cast("string")))


def looks_like_html(c: Column) -> Column:
    return F.coalesce(c.rlike(r"(?i)<!DOCTYPE html>|<html[\s>]|slide-container|<body[\s>]|<div[\s>]"), F.lit(False))


def signature(names_and_contents: Column) -> Column:
    """First 12 hex digits of the SHA-1 over an array's sorted strings joined."""
    return F.substring(F.sha1(F.array_join(F.array_sort(names_and_contents), "").cast("binary")), 1, 12)
