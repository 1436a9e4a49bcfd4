"""Checks of catalog rows, with the problems listed per row."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquay import vocabulary as V

# Fields a row must have.
SOURCE_REQUIRED = ("name", "url", "format", "storage_id")
STORAGE_REQUIRED = ("name", "type", "url")
PERMISSION_REQUIRED = ("permission", "user_name", "user_login")

SOURCE_ENUMS = {"format": V.DATA_SOURCE_FORMATS, "initialization": V.INITIALIZATION_STATUSES}
STORAGE_ENUMS = {"type": V.STORAGE_TYPES}
MODEL_ENUMS = {"type": V.MODEL_TYPES, "deployment_status": V.DEPLOYMENT_STATUSES}
PERMISSION_ENUMS = {"permission": V.PERMISSIONS}

ERRORS = "errors"


def missing_error(name: str, blank_counts: bool = True) -> Column:
    """``Missing: name`` when the field is NULL, or blank text."""
    absent = F.col(name).isNull()
    if blank_counts:
        absent = absent | (F.trim(F.col(name).cast("string")) == "")
    return F.when(absent, F.lit(f"Missing: {name}"))


def enum_error(name: str, members: Sequence[str]) -> Column:
    """``Invalid: name`` when the field has a value outside its list."""
    return F.when(~F.col(name).isin(*members), F.lit(f"Invalid: {name}"))


def check_rows(
    df: DataFrame,
    required: Sequence[str] = (),
    enums: Mapping[str, Sequence[str]] | None = None,
    blank_counts: bool = True,
) -> DataFrame:
    """Add ``errors``: required fields in their order, then enumerations."""
    tests = [missing_error(n, blank_counts) for n in required if n in df.columns]
    absent = [F.lit(f"Missing: {n}") for n in required if n not in df.columns]
    tests += [enum_error(n, m) for n, m in (enums or {}).items() if n in df.columns]
    found = F.array_compact(F.array(*absent, *tests)) if absent or tests else F.array().cast("array<string>")
    return df.withColumn(ERRORS, found)


def first_error(errors: str = ERRORS) -> Column:
    """The first problem of a row, NULL when there is none."""
    return F.get(F.col(errors), F.lit(0))


def known_fields(df: DataFrame, known: Sequence[str]) -> DataFrame:
    """Drop fields the catalog does not know."""
    return df.select(*[c for c in df.columns if c in set(known)])
