"""A positional index: an order laid out once, and pages read from it.

An index is three tables. ``rows`` has the rows in ranges of the order, a folder
for each, every row with its place in its range; ``starts`` has one row per range:
the position it begins at and its number of rows; ``layout`` has the columns. A
page reads the ranges it touches, and of these the row groups whose places it
needs, however deep it is.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

PART, PLACE, RANK = "_part", "_place", "rank"
#: Rows of one task are numbered in the low bits of Spark's increasing ids.
_PLACE_BITS = 33


def index_positions(df: DataFrame, order: Sequence[Column | str], path: str) -> None:
    """Write the index of a relation in an order, which must be total.

    One range sort of the relation. Nothing is sorted again for a page; the written
    ranges stay as they are when executors are lost. A path is used once: a changed
    relation gets an index of its own, so that the pages of a reader agree.
    """
    clash = sorted({PART, PLACE, RANK} & {c.lower() for c in df.columns})
    if clash:
        raise ValueError(f"Columns {clash} are needed by the index")
    place = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << _PLACE_BITS) - 1))
    laid_out = df.orderBy(*order).withColumn(PART, F.spark_partition_id()).withColumn(PLACE, place)
    laid_out.write.partitionBy(PART).parquet(f"{path}/rows")
    # The columns, known even where there is no row.
    df.sparkSession.createDataFrame([], laid_out.schema).write.parquet(f"{path}/layout")
    counts = _rows(df.sparkSession, path).groupBy(PART).agg(F.count("*").alias("rows"))
    # One row per range: a single task is enough for the running sum.
    before = F.sum("rows").over(Window.orderBy(PART).rowsBetween(Window.unboundedPreceding, -1))
    counts.select(PART, F.coalesce(before, F.lit(0)).cast("long").alias("start"), "rows").write.parquet(f"{path}/starts")


def _rows(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(spark.read.parquet(f"{path}/layout").schema).parquet(f"{path}/rows")


def row_count(spark: SparkSession, path: str) -> int:
    """Rows of an indexed relation, from the starts of its ranges."""
    return spark.read.parquet(f"{path}/starts").agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]


def read_positions(spark: SparkSession, path: str, start: int, stop: int) -> DataFrame:
    """Rows ``start`` to ``stop`` (0-based, end excluded) of an index, with ``rank`` from 1.

    Rows come in no set order; sort by ``rank``. Beyond the last row there is nothing.
    """
    starts = spark.read.parquet(f"{path}/starts")
    touched = starts.where((F.col("start") < stop) & (F.col("start") + F.col("rows") > start)).collect()
    hits = [
        (F.col(PART) == r[PART]) & F.col(PLACE).between(max(0, start - r["start"]), min(r["rows"], stop - r["start"]) - 1)
        for r in touched
    ]
    offsets = {r[PART]: r["start"] for r in touched}
    rows = _rows(spark, path)
    if not hits:
        return rows.where(F.lit(False)).withColumn(RANK, F.lit(None).cast("long")).drop(PART, PLACE)
    # Ranges between the first and the last are wanted whole.
    inner = [r[PART] for r in touched if r["start"] >= start and r["start"] + r["rows"] <= stop]
    edges = [h for r, h in zip(touched, hits) if r[PART] not in set(inner)]
    wanted = F.col(PART).isin(inner)
    for hit in edges:
        wanted = wanted | hit
    begins = spark.createDataFrame(list(offsets.items()), f"{PART} int, _start long")
    found = rows.where(F.col(PART).isin(list(offsets)) & wanted).join(F.broadcast(begins), PART)  # one row per range
    return found.withColumn(RANK, F.col("_start") + F.col(PLACE) + 1).drop(PART, PLACE, "_start")


def read_page(spark: SparkSession, path: str, number: int, size: int) -> DataFrame:
    """Page ``number`` (from 1) of an index, with ``rank``."""
    if number < 1 or size < 1:
        raise ValueError("Pages and their sizes begin at 1")
    return read_positions(spark, path, (number - 1) * size, number * size)
