"""Typed conversion of text columns, with the bad cells reported per row."""

from __future__ import annotations

import re
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquay.functions.cells import NUMBER, ODD_NUMBER, blank_to_null
from dataquay.vocabulary import spark_type

ERRORS = "_errors"


class Attribute(NamedTuple):
    """A declared column: name, logical type, digits for decimals, date pattern."""

    name: str
    type: str
    precision: int | None = None
    scale: int | None = None
    format: str | None = None


# Stored patterns show two-digit fields; cells may have one digit, and one to
# six digits of a second's fraction.
_FIELDS = {"yyyy": r"(?<y>\d{4})", "MM": r"(?<m>\d{1,2})", "dd": r"(?<d>\d{1,2})"}
_CLOCK = r"(?<t>\d{1,2}:\d{1,2}:\d{1,2})"
_CLOCK_FRACTION = r"[Tt](?<t>\d{1,2}:\d{1,2}:\d{1,2}\.\d{1,6})[Zz]"


def read_datetime(c: Column, label: str) -> Column:
    """Wall-clock time of a cell that follows a stored date pattern, else NULL.

    The cell is put in ISO order and cast, so that no time zone is involved:
    hours that the session's zone skips are read like all others.
    """
    pattern = re.escape(label)
    for name, digits in _FIELDS.items():
        pattern = pattern.replace(name, digits)
    clock = r"\ HH:mm:ss" in pattern or "THH:mm:ss" in pattern
    pattern = pattern.replace(r"THH:mm:ss\.Z", _CLOCK_FRACTION).replace(r"\ HH:mm:ss", rf"\s+{_CLOCK}")
    iso = "${y}-${m}-${d}" + (" ${t}" if clock else "")
    ordered = F.regexp_replace(c, f"^{pattern}$", iso)
    return F.when(c.rlike(f"^{pattern}$"), ordered.try_cast("timestamp_ntz"))


def convert(c: Column, attribute: Attribute) -> Column:
    """The cell in its declared type; NULL when it does not fit."""
    trimmed = F.trim(c)
    target = spark_type(attribute.type, attribute.precision, attribute.scale)
    kind = target.typeName()
    if kind == "string":
        return trimmed
    if kind == "binary":
        return F.encode(c, "UTF-8")
    if kind in ("array", "struct"):
        return F.from_json(trimmed, target.simpleString(), {"mode": "PERMISSIVE"})
    if attribute.format and kind in ("timestamp_ntz", "date"):
        return read_datetime(trimmed, attribute.format).cast(target)
    return (written_out(trimmed) if kind in NUMERIC else trimmed).try_cast(target)


NUMERIC = ("integer", "long", "float", "double", "decimal")


def written_out(c: Column) -> Column:
    """A number without the underscores that may stand between its digits."""
    return F.when(c.contains("_") & c.rlike(NUMBER), F.replace(c, F.lit("_"), F.lit(""))).otherwise(c)


def is_rounded(cell: Column, attribute: Attribute) -> Column:
    """Whether a decimal has digits, other than zeros, behind the places that its type keeps."""
    target = spark_type(attribute.type, attribute.precision, attribute.scale)
    if target.typeName() != "decimal":
        return F.lit(False)
    trimmed = F.trim(cell)
    number, dot = F.lower(trimmed), F.instr(trimmed, ".")
    places = F.rtrim(F.regexp_extract(number, r"\.([\d_]*)", 1), F.lit("0_"))
    moved = F.coalesce(F.regexp_extract(number, r"e([+-]?\d+)", 1).try_cast("int"), F.lit(0))
    odd = F.length(F.replace(places, F.lit("_"), F.lit(""))) - moved > target.scale
    plain = (dot > 0) & (F.length(F.rtrim(trimmed, F.lit("0"))) - dot > target.scale)
    return F.when(trimmed.rlike(ODD_NUMBER), odd).otherwise(plain)


def convert_columns(
    df: DataFrame,
    attributes: Sequence[Attribute],
    tokens: Sequence[str] = (),
    keep: Sequence[str] = (),
) -> DataFrame:
    """Convert the declared columns; absent ones are NULL.

    Other columns are dropped, except those to ``keep``.
    ``_errors`` lists one message per cell that is present but does not fit;
    that cell becomes NULL. A decimal with more places than its type is
    rounded and listed too.
    """
    present = set(df.columns)
    read = [a for a in attributes if a.name in present]
    # Three steps, so that no cell is cleaned or converted twice.
    cells = df.select(
        *keep,
        *[
            blank_to_null(F.col(f"`{a.name}`").cast("string"), tokens).alias(f"_cell{i}")
            for i, a in enumerate(read)
        ],
    )
    values = cells.withColumns({f"_value{i}": convert(F.col(f"_cell{i}"), a) for i, a in enumerate(read)})
    errors = [
        F.when(
            F.col(f"_cell{i}").isNotNull() & F.col(f"_value{i}").isNull(),
            F.concat(F.lit(f"{a.name}: <Invalid data>: `"), F.col(f"_cell{i}"), F.lit("`")),
        ).when(
            F.col(f"_value{i}").isNotNull() & is_rounded(F.col(f"_cell{i}"), a),
            F.concat(F.lit(f"{a.name}: <Rounded>: `"), F.col(f"_cell{i}"), F.lit("`")),
        )
        for i, a in enumerate(read)
    ]
    listed = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    place = {a.name: i for i, a in enumerate(read)}
    typed = [
        F.col(f"_value{place[a.name]}").alias(a.name)
        if a.name in place
        else F.lit(None).cast(spark_type(a.type, a.precision, a.scale)).alias(a.name)
        for a in attributes
    ]
    return values.select(*typed, *keep, listed.alias(ERRORS))


def columns_with_errors(df: DataFrame, attributes: Sequence[Attribute], tokens: Sequence[str] = ()) -> DataFrame:
    """One row per declared column: how many cells do not fit its type."""
    counts = []
    for i, attribute in enumerate(attributes):
        cell = blank_to_null(F.col(f"`{attribute.name}`").cast("string"), tokens)
        counts.append(F.count_if(cell.isNotNull() & convert(cell, attribute).isNull()).alias(f"_{i}"))
    rows = F.array(*[
        F.struct(F.lit(a.name).alias("name"), F.col(f"_{i}").alias("bad_cells")) for i, a in enumerate(attributes)
    ])
    return df.agg(*counts).select(F.explode(rows).alias("r")).select("r.*")
