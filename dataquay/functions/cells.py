"""Classification of single text cells, as column expressions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

MISSING, CHAR, TEXT = "MISSING", "CHAR", "TEXT"
DATETIME, DECIMAL, INT32, INT64 = "DATETIME", "DECIMAL", "INT32", "INT64"

# What counts as a number: single underscores between digits are allowed,
# named values (nan, inf) and type suffixes are not. Digits never backtrack.
_DIGITS = r"\d++(?:_\d++)*+"
NUMBER = rf"^\s*[+-]?(?:{_DIGITS}(?:\.(?:{_DIGITS})?)?|\.{_DIGITS})(?:[eE][+-]?{_DIGITS})?\s*$"

# Month-and-day texts. Feb 29 is in; only it depends on the year.
_TO_29 = r"(?:[12]\d|0?[1-9]| [1-9])"
_DAYS_OF_MONTHS = (
    (r"(?:1[02]|0?[13578])", rf"(?:3[01]|{_TO_29})"),
    (r"(?:11|0?[469])", rf"(?:30|{_TO_29})"),
    (r"0?2", _TO_29),
)
_MONTH_DAY = "|".join(rf"{month}\1{day}" for month, day in _DAYS_OF_MONTHS)
_DAY_MONTH = "|".join(rf"{day}\1{month}" for month, day in _DAYS_OF_MONTHS)
_YEAR = r"(?!0000)\d{4}"
_HOURS, _SIXTY = r"(?:2[0-3]|[01]?\d)", r"[0-5]?\d"
_CLOCK = rf"{_HOURS}:{_SIXTY}:{_SIXTY}"
_TIME = rf"(?:[Tt]{_CLOCK}\.\d{{1,6}}[Zz]|\s+{_CLOCK})?"
# The separator is looked up ahead, so that one pattern serves all three.
_SEP_AHEAD = r"(?=[\d ]{1,4}([/.-]))"

DATE_ORDERS = (
    (("MM", "dd", "yyyy"), rf"^{_SEP_AHEAD}(?:{_MONTH_DAY})\1{_YEAR}{_TIME}$"),
    (("yyyy", "MM", "dd"), rf"^{_SEP_AHEAD}{_YEAR}\1(?:{_MONTH_DAY}){_TIME}$"),
    (("dd", "MM", "yyyy"), rf"^{_SEP_AHEAD}(?:{_DAY_MONTH})\1{_YEAR}{_TIME}$"),
)
SEPARATORS = ("/", "-", ".")
TIMES = ("", "THH:mm:ss.Z", " HH:mm:ss")

# Every date pattern; a cell's pattern is an index into this list.
DATE_PATTERNS = tuple(
    sep.join(fields) + time for fields, _ in DATE_ORDERS for sep in SEPARATORS for time in TIMES
)

# A cell that could be a date at all; spares the other tests for plain words.
DATE_SHAPE = r"^[ \d]{1,4}[/.-][ \d]{1,2}[/.-][ \d]"
LEAP_DAY = (
    r"^0?2[/.-]29[/.-]\d{4}|^29[/.-]0?2[/.-]\d{4}|^\d{4}[/.-]0?2[/.-]29"
)


def missing_tokens(text: str | None) -> list[str]:
    """The comma list of texts that stand for a missing value, taken as is."""
    return text.split(",") if text else []


def is_missing(v: Column, tokens: Sequence[str] = ()) -> Column:
    return v.isNull() | v.isin("", *tokens)


def blank_to_null(v: Column, tokens: Sequence[str] = ()) -> Column:
    """NULL for empty cells and missing-value tokens, else the cell."""
    return F.when(~v.isin("", *tokens), v)


def numeric_value(v: Column) -> Column:
    """The cell as a double, NULL when it is not a number; it may be infinite."""
    plain = F.when(v.contains("_"), F.replace(v, F.lit("_"), F.lit(""))).otherwise(v)
    return F.when(v.rlike(NUMBER), plain.try_cast("double"))


def _position(tests: Sequence[Column]) -> Column:
    """Index of the first test that holds."""
    found = F.when(tests[0], 0)
    for i, test in enumerate(tests[1:], 1):
        found = found.when(test, i)
    return found


def date_pattern_index(v: Column) -> Column:
    """Index in DATE_PATTERNS of the pattern a cell follows, NULL when it is no date.

    Tried in order: month first, year first, day first. The three parts share
    one separator; a time of day may follow.
    """
    order = _position([v.rlike(pattern) for _, pattern in DATE_ORDERS])
    sep = F.when(v.rlike("^[ \\d]+/"), 0).when(v.rlike("^[ \\d]+-"), 1).otherwise(2)
    time = F.when(v.rlike("[Zz]$"), 1).when(v.contains(":"), 2).otherwise(0)
    index = order * (len(SEPARATORS) * len(TIMES)) + sep * len(TIMES) + time
    year = F.regexp_extract(v, r"\d{4}", 0).try_cast("int")
    leap = ((year % 4 == 0) & (year % 100 != 0)) | (year % 400 == 0)
    return F.when(v.rlike(DATE_SHAPE), F.when(~v.rlike(LEAP_DAY) | leap, index))


def date_pattern(index: Column) -> Column:
    """The pattern text of a pattern index."""
    return F.get(F.array(*[F.lit(p) for p in DATE_PATTERNS]), index)


def classify(v: Column, number: Column, pattern: Column, tokens: Sequence[str] = ()) -> Column:
    """Class of a cell, from the cell, its number and its date pattern.

    A number too large for a double is text, like a named infinity.
    """
    # A leading zero marks a code, not a number, unless a fraction follows.
    code = v.startswith("0") & (F.length(v) > 1) & (F.substring(v, 2, 1) != ".")
    whole = F.rint(number) == number
    # Both bounds are outside the 32-bit class.
    small = (number > -2147483648) & (number < 2147483647)
    return (
        F.when(is_missing(v, tokens), MISSING)
        .when(number.isNull(), F.when(pattern.isNotNull(), DATETIME).otherwise(CHAR))
        .when(code | (F.abs(number) == float("inf")), CHAR)
        .when(whole, F.when(small, INT32).otherwise(INT64))
        .when(v.contains("."), DECIMAL)
        .otherwise(TEXT)
    )


#: What makes a number more than a sign, digits and a dot.
ODD_NUMBER = r"[eE_\s]"
# Sign and digits before the dot, digits after it, and the exponent.
_PARTS = r"^\s*([+-]?[\d_]*)(?:\.([\d_]*))?(?:[eE]([+-]?[\d_]+))?\s*$"


def number_digits(v: Column) -> tuple[Column, Column]:
    """Places before and after the dot that hold a number, written out; a sign counts as a place.

    An exponent moves digits over the dot, but never makes either side shorter.
    Most numbers are plain, and their lengths tell; only others are taken apart.
    """
    dot, odd = F.instr(v, "."), v.rlike(ODD_NUMBER)
    part = lambda i: F.replace(F.regexp_extract(v, _PARTS, i), F.lit("_"), F.lit(""))
    before, after = F.length(part(1)), F.length(part(2))
    moved = F.coalesce(part(3).try_cast("int"), F.lit(0))
    plain_before = F.when(dot > 0, dot - 1).otherwise(F.length(v))
    return (
        F.when(odd, F.greatest(before, before + moved)).otherwise(plain_before),
        F.when(odd, F.greatest(after, after - moved)).otherwise(F.length(v) - plain_before - F.when(dot > 0, 1).otherwise(0)),
    )


def decimal_digits(v: Column) -> tuple[Column, Column]:
    """(precision, scale) of a cell with one dot; a sign counts as a digit."""
    return F.length(v) - 1, F.length(v) - F.instr(v, ".")
