"""Text clean-up: accents, headers, paths, names."""

from __future__ import annotations

import re
import sys
import unicodedata
from functools import cache

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

HEADER_CHARS = 100


@cache
def _marks() -> dict[int, None]:
    """Every non-spacing mark, for deletion by ``str.translate``."""
    codes = range(sys.maxunicode + 1)
    return dict.fromkeys(code for code in codes if unicodedata.category(chr(code)) == "Mn")


def plain_letters(text: str) -> str:
    """Canonical decomposition without the non-spacing marks."""
    return unicodedata.normalize("NFD", text).translate(_marks())


@cache
def _accent_table() -> tuple[str, str]:
    """Characters that lose an accent, their plain forms, then the bare marks.

    Built from the Unicode tables: a character is listed when its plain form is
    one other character, or nothing.
    """
    swapped, plain, dropped = [], [], []
    for code in range(128, sys.maxunicode + 1):
        if 0xD800 <= code <= 0xDFFF:
            continue
        char = chr(code)
        bare = plain_letters(char)
        if bare == "":
            dropped.append(char)
        elif bare != char and len(bare) == 1:
            swapped.append(char)
            plain.append(bare)
    return "".join(swapped + dropped), "".join(plain)


def strip_accents(c: Column) -> Column:
    """Remove accents on the JVM, by character table.

    Hangul syllables and a few musical signs, whose decomposition has several
    base characters, stay whole here; :func:`strip_accents_full` splits them.
    """
    found, plain = _accent_table()
    return F.translate(c, found, plain)


@cache
def _blanks() -> str:
    """All characters that count as blank, control and no-break blanks included."""
    return "".join(c for c in map(chr, range(0xD800)) if c.isspace())


@F.pandas_udf(T.StringType())
def strip_accents_full(values: pd.Series) -> pd.Series:
    """Full decomposition for any script, in Arrow batches."""
    return values.map(plain_letters, na_action="ignore")


def header_name(text: str) -> str:
    """A raw header cell as an attribute name."""
    plain = plain_letters(text.strip())
    return re.sub(r"\W", "_", plain[:HEADER_CHARS].lower())


def header_names(cells: list[str]) -> list[str]:
    """Attribute names of a header; a name that is taken gets a number."""
    names: list[str] = []
    for cell in cells:
        name, nth = header_name(cell), 1
        while (chosen := name if nth == 1 else f"{name}_{nth}") in names:
            nth += 1
        names.append(chosen)
    return names


def default_names(count: int) -> list[str]:
    return [f"attr{i}" for i in range(count)]


def normalise_header(c: Column) -> Column:
    """:func:`header_name` for a column of header cells."""
    trimmed = F.btrim(c, F.lit(_blanks()))
    short = F.lower(F.left(strip_accents(trimmed), F.lit(HEADER_CHARS)))
    return F.regexp_replace(short, r"[^\p{L}\p{N}]", "_")


def without_nul(c: Column) -> Column:
    return F.replace(c, F.lit("\0"), F.lit(""))


def clean_path(c: Column) -> Column:
    """Drop trailing slashes, and fold doubled slashes outside the scheme."""
    return F.regexp_replace(F.regexp_replace(c, "(?<![:/])/{2,}", "/"), "(?<!/)/$", "")


def export_name(name: Column, format_: Column, as_csv: Column | None = None) -> Column:
    """Download name: blanks become dashes, the format is the extension."""
    base = F.concat(F.replace(name, F.lit(" "), F.lit("-")), F.lit("."), F.lower(format_))
    if as_csv is None:
        return base
    return F.concat(base, F.when(as_csv, F.lit(".csv")).otherwise(F.lit("")))


def part_name(file: Column, number: Column) -> Column:
    """Name of one part of an upload: nine digits, counted from 1."""
    return F.format_string("%s.part%09d", file, number.cast("long"))


def size_in_mb(size: Column) -> Column:
    return F.round(size.cast("decimal(20,0)") / F.lit(1048576), 2).cast("decimal(10,2)")


def format_from_name(name: Column) -> Column:
    """Format of a file by its extension; tab-separated files are CSV too."""
    extension = F.lower(F.regexp_extract(name, r"\.([^./]+)$", 1))
    return (
        F.when(extension.isin("csv", "tsv"), "CSV")
        .when(extension == "json", "JSON")
        .when(extension == "xml", "XML_FILE")
        .when(extension == "txt", "TEXT")
        .otherwise("UNKNOWN")
    )


def iso_datetime(c: Column) -> Column:
    """ISO-8601 text of a wall-clock time; microseconds only when there are any."""
    text = F.replace(c.cast("timestamp_ntz").cast("string"), F.lit(" "), F.lit("T"))
    micros = F.rpad(F.substring_index(text, ".", -1), 6, "0")
    return F.when(text.contains("."), F.concat(F.substring_index(text, ".", 1), F.lit("."), micros)).otherwise(text)
