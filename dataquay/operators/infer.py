"""Schema inference over whole columns of text cells.

The type of a column depends on the order of its cells: a date after a number
makes the column a date column, a number after a date an integer column. The
fold is still one partial aggregate, because only the last position of each
class decides (see :func:`_fold_type`); no cells are ordered or gathered.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataquay.functions import cells as C
from dataquay.vocabulary import MAX_DIGITS, TEXT_ABOVE

# Delimiters that are voted on, in the order that wins a tie.
DELIMITERS = (",", ";", "\t")


def cell_rows(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order_column: str | None = None,
    width: Column | None = None,
    split: Column | None = None,
) -> DataFrame:
    """One row (column_index, split, pos, v) per cell of the given text columns.

    Without an order column, positions follow the scan, which is the order of
    rows within a split of a file. ``split`` says which one a row is in, as an
    ordered value; rows are ordered by split, then position. ``width`` tells
    how many cells a row really has; cells beyond it do not exist.
    """
    names = list(columns or [c for c in df.columns if c != order_column])
    split = F.struct(F.lit(0)) if split is None else split
    pos = F.col(order_column).cast("long") if order_column else F.monotonically_increasing_id()
    kept = [F.col(f"`{n}`").cast("string").alias(f"_{i}") for i, n in enumerate(names)]
    rows = df.select(split.alias("split"), pos.alias("pos"), (F.lit(None) if width is None else width).cast("int").alias("_width"), *kept)
    pairs = [x for i in range(len(names)) for x in (F.lit(i), F.col(f"_{i}"))]
    tall = rows.select("split", "pos", "_width", F.stack(F.lit(len(names)), *pairs).alias("column_index", "v"))
    if width is not None:
        tall = tall.where(F.col("_width").isNull() | (F.col("column_index") < F.col("_width")))
    return tall.select("column_index", "split", "pos", "v")


def classify_cells(rows: DataFrame, missing: Sequence[str] = ()) -> DataFrame:
    """Add class, date pattern, precision and scale to cell rows."""
    v = F.col("v")
    numbered = rows.withColumn("_number", C.numeric_value(v))
    dated = numbered.withColumn("_date", F.when(F.col("_number").isNull(), C.date_pattern_index(v)))
    classed = dated.withColumn("cell_class", C.classify(v, F.col("_number"), F.col("_date"), missing))
    precision, scale = C.decimal_digits(v)
    is_decimal = F.col("cell_class") == C.DECIMAL
    before, after = C.number_digits(v)
    is_number = F.col("cell_class").isin(C.DECIMAL, C.INT32, C.INT64, C.TEXT)
    return classed.select(
        "column_index",
        "split",
        "pos",
        "v",
        "cell_class",
        F.when(F.col("cell_class") == C.DATETIME, F.col("_date")).alias("format_index"),
        F.when(is_decimal, precision).alias("precision"),
        F.when(is_decimal, scale).alias("scale"),
        F.when(is_number, before).alias("digits"),
        F.when(is_number, after).alias("places"),
    )


def _last(cell_class: str) -> Column:
    """Last position of a cell of a class, NULL when there is none."""
    return F.max(F.when(F.col("cell_class") == cell_class, F.col("pos")))


def _fold_type() -> Column:
    """The column type, from the last positions of the classes."""
    # Dates, decimals and texts replace any type; integers hold from there on.
    override = F.greatest("last_datetime", "last_decimal", "last_text")

    def later(last: Column) -> Column:
        return last.isNotNull() & (override.isNull() | (last > override))

    return (
        F.when(F.col("first_char").isNotNull(), "CHARACTER")
        .when(F.col("last_decimal") == override, "DECIMAL")
        .when(later(F.col("last_int64")), "LONG")
        .when(later(F.col("last_int32")), "INTEGER")
        .when(override.isNull(), "CHARACTER")
        .when(F.col("last_datetime") == override, "DATETIME")
        .otherwise("TEXT")
    )


def fold_cells(classed: DataFrame) -> DataFrame:
    """Fold classified cells into one row per column.

    The size of a CHARACTER column is the longest value from its first
    CHARACTER cell on. Grouping by length first keeps, for each length, the
    last position it was seen at, so one scan is enough: a length counts when
    that position is not before the first CHARACTER cell. Date patterns are
    part of the first grouping too, which leaves only numbers to aggregate.
    Splits are as well; a row of the first grouping is what one task found.

    A DECIMAL column has room for the longest part of any of its numbers before
    the dot and after it; one that needs more than 38 digits is CHARACTER.
    """
    by_length = classed.groupBy("column_index", "format_index", "split", F.length("v").alias("cell_length")).agg(
        F.min(F.when(F.col("cell_class") == C.CHAR, F.col("pos"))).alias("first_char"),
        F.max(F.when(F.col("cell_class") != C.MISSING, F.col("pos"))).alias("last_filled"),
        _last(C.DATETIME).alias("last_datetime"),
        _last(C.DECIMAL).alias("last_decimal"),
        _last(C.TEXT).alias("last_text"),
        _last(C.INT64).alias("last_int64"),
        _last(C.INT32).alias("last_int32"),
        F.max("digits").alias("digits"),
        F.max("places").alias("places"),
        F.max(F.when(F.col("cell_class") != C.MISSING, F.length("v"))).alias("longest"),
        F.max(F.col("cell_class") == C.MISSING).alias("nullable"),
    )
    # From here on there are at most as many rows as cell lengths and patterns, per split.
    positions = ("first_char", "last_filled", "last_datetime", "last_decimal", "last_text", "last_int64", "last_int32")
    by_length = by_length.withColumns({
        p: F.when(F.col(p).isNotNull(), F.struct("split", F.col(p).alias("pos"))) for p in positions
    })
    first = F.min("first_char").over(Window.partitionBy("column_index"))
    counted = F.when(F.col("last_filled") >= F.col("first_char"), F.col("cell_length"))
    merged = by_length.withColumn("first_char", first).groupBy("column_index").agg(
        F.min("first_char").alias("first_char"),
        F.max(counted).alias("size"),
        F.max_by("format_index", "last_datetime").alias("format_index"),
        *[F.max(c).alias(c) for c in (
            "last_datetime", "last_decimal", "last_text", "last_int64", "last_int32",
            "digits", "places", "longest", "nullable",
        )],
    )
    typed = merged.withColumn("type", _fold_type()).withColumn("precision", F.col("digits") + F.col("places"))
    too_long = (F.col("type") == "DECIMAL") & (F.col("precision") > MAX_DIGITS)
    typed = typed.withColumn("size", F.when(too_long, F.col("longest")).otherwise(F.col("size")))
    typed = typed.withColumn("type", F.when(too_long, "CHARACTER").otherwise(F.col("type")))
    is_decimal = F.col("type") == "DECIMAL"
    return typed.select(
        "column_index",
        F.when((F.col("type") == "CHARACTER") & (F.col("size") > TEXT_ABOVE), "TEXT")
        .otherwise(F.col("type")).alias("type"),
        F.when(F.col("type") == "CHARACTER", F.col("size")).cast("int").alias("size"),
        F.when(is_decimal, F.col("precision")).cast("int").alias("precision"),
        F.when(is_decimal, F.col("places")).cast("int").alias("scale"),
        F.when(F.col("type") == "DATETIME", C.date_pattern(F.col("format_index"))).alias("format"),
        "nullable",
    )


def infer_columns(
    df: DataFrame,
    columns: Sequence[str] | None = None,
    order_column: str | None = None,
    missing: Sequence[str] = (),
    width: Column | None = None,
    split: Column | None = None,
) -> DataFrame:
    """Infer the attributes of text columns: one row per column.

    ``order_column`` or ``split`` give the order of rows, as in :func:`cell_rows`.
    Result: position, name, type, size, precision, scale, format, nullable.
    """
    names = list(columns or [c for c in df.columns if c != order_column])
    rows = cell_rows(df, names, order_column, width, split)
    folded = fold_cells(classify_cells(rows, missing))
    declared = df.sparkSession.createDataFrame(list(enumerate(names)), "position int, name string")
    # One row per column on either side.
    joined = declared.join(F.broadcast(folded), declared["position"] == folded["column_index"], "left")
    return joined.select(
        "position",
        "name",
        F.coalesce("type", F.lit("CHARACTER")).alias("type"),
        "size",
        "precision",
        "scale",
        "format",
        F.coalesce("nullable", F.lit(False)).alias("nullable"),
    )


def delimiter_counts(text: Column) -> list[Column]:
    """How often each candidate delimiter occurs in a text."""
    return [
        (F.length(text) - F.length(F.replace(text, F.lit(d), F.lit("")))).cast("long")
        for d in DELIMITERS
    ]


def winner(counts: Sequence[Column]) -> Column:
    """The delimiter with the largest count; ties and empty votes by order."""
    top = F.greatest(*counts)
    choice = F.lit(DELIMITERS[-1])
    for delimiter, count in reversed(list(zip(DELIMITERS, counts))[:-1]):
        choice = F.when(count == top, delimiter).otherwise(choice)
    return choice


def infer_delimiter(df: DataFrame, text: str, keys: Sequence[str] = ()) -> DataFrame:
    """Vote for the field delimiter of each file (group of lines) by frequency."""
    votes = [F.coalesce(F.sum(c), F.lit(0)).alias(f"_{i}") for i, c in enumerate(delimiter_counts(F.col(text)))]
    counted = df.groupBy(*keys).agg(*votes)
    return counted.select(*keys, winner([F.col(f"_{i}") for i in range(len(DELIMITERS))]).alias("delimiter"))
