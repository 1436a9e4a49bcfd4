"""Positions in a global order, without a single-task sort."""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquay.session import scratch_dir


# Long ranges are exploded in two steps, so that no row holds a whole range.
RANGE_BLOCK = 10_000


def explode_range(df: DataFrame, name: str, length: Column, first: int = 0) -> DataFrame:
    """Repeat each row ``length`` times, numbered in column ``name`` from ``first``."""
    sized = df.withColumn("_size", length.cast("long")).where("_size > 0")
    blocks = F.sequence(F.lit(0).cast("long"), F.floor((F.col("_size") - 1) / RANGE_BLOCK))
    blocked = sized.withColumn("_block", F.explode(blocks))
    start = F.col("_block") * RANGE_BLOCK
    stop = F.least(start + RANGE_BLOCK, F.col("_size")) - 1
    return blocked.withColumn(name, F.explode(F.sequence(start + first, stop + first))).drop("_size", "_block")


def _sorted_table(df: DataFrame, order: Sequence[Column | str]) -> DataFrame:
    """The relation sorted by range and written, each row with its ``_part`` of the sort.

    The written table fixes the layout against lost executors, and a filter on
    ``_part`` skips the files of other parts.
    """
    path = scratch_dir(df.sparkSession, "sorted")
    numbered = df.orderBy(*order).withColumn("_part", F.spark_partition_id())
    numbered.write.parquet(path)
    return df.sparkSession.read.schema(numbered.schema).parquet(path)


# Bounds of a band are picked from this many approximate quantiles.
GRID = 1000
QUANTILE_ACCURACY = 10_000
BANDED_TYPES = (T.NumericType, T.DateType, T.TimestampType, T.TimestampNTZType)


class Lead(NamedTuple):
    """The column an order starts with."""

    name: str
    ascending: bool = True


def _band(df: DataFrame, lead: Lead, start: int, stop: int) -> tuple[DataFrame, int]:
    """The rows whose leading value can have a wanted position, and how many come before.

    The bounds are approximate quantiles with a margin; counting the rows on
    either side proves that they hold. When they do not, or there is nothing to
    compare by, all rows stay.
    """
    c = F.col(f"`{lead.name}`")
    if not isinstance(df.schema[lead.name].dataType, BANDED_TYPES):
        return df, 0
    grid = F.approx_percentile(c, [i / GRID for i in range(GRID + 1)], QUANTILE_ACCURACY)
    rows, nulls, points = df.agg(F.count("*"), F.count_if(c.isNull()), grid).first()
    if nulls or rows == 0 or start >= rows:
        return df, 0
    margin = 2 / QUANTILE_ACCURACY
    first, last = start / rows - margin, stop / rows + margin
    if not lead.ascending:
        first, last = 1 - last, 1 - first
    low, high = points[max(0, math.floor(first * GRID))], points[min(GRID, math.ceil(last * GRID))]
    below, above = df.agg(F.count_if(c < F.lit(low)), F.count_if(c > F.lit(high))).first()
    before, after = (below, above) if lead.ascending else (above, below)
    if before > start or after > rows - min(stop, rows):
        return df, 0
    return df.where(c.between(F.lit(low), F.lit(high))), before


def rows_between(
    df: DataFrame, order: Sequence[Column], start: int, stop: int, lead: Lead | None = None
) -> DataFrame:
    """Rows ``start`` to ``stop`` (0-based, end excluded) of a total order, with ``rank`` from 1.

    With the order's leading column given, only a narrow band of rows around
    the wanted ones is sorted. Row counts per part of the distributed sort (one
    number each) tell which parts the wanted rows are in; only those are read
    again and numbered.
    """
    skipped = 0
    if lead is not None:
        # Written once: counts, bounds and the band are all taken from the copy.
        path = scratch_dir(df.sparkSession, "unsorted")
        df.write.parquet(path)
        df, skipped = _band(df.sparkSession.read.schema(df.schema).parquet(path), lead, start, stop)
    laid_out = _sorted_table(df, order)
    counts = sorted(laid_out.groupBy("_part").count().collect())
    offsets, before = [], skipped
    for part, n in counts:
        if before < stop and before + n > start:
            offsets.append((part, before))
        before += n
    # One row per part of the sort at most.
    wanted = F.broadcast(df.sparkSession.createDataFrame(offsets, "_part int, _before long"))
    inside = laid_out.where(F.col("_part").isin([part for part, _ in offsets])).join(wanted, "_part")
    number = F.row_number().over(Window.partitionBy("_part").orderBy(*order))
    ranked = inside.withColumn("rank", number.cast("long") + F.col("_before"))
    return ranked.where((F.col("rank") > start) & (F.col("rank") <= stop)).drop("_part", "_before")


def quantiles(
    counts: DataFrame, group: str, value: str, weight: str, probabilities: Sequence[float]
) -> DataFrame:
    """Exact interpolated quantiles per group, from one (group, value, weight) row per value.

    Meant for few groups, such as the columns of a relation, of any size.
    Weights per part of a distributed sort by (group, value) give the position
    each part starts at; only the parts that hold a wanted position are read
    again, for running sums. No group has to fit in one task.

    Result: the group, its number of distinct values, and ``quantiles``.
    """
    named = counts.select(
        F.col(group).alias("_group"), F.col(value).alias("_value"), F.col(weight).alias("_weight")
    )
    laid_out = _sorted_table(named, ["_group", "_value"])
    by_part = Window.partitionBy("_group").orderBy("_part")
    whole = Window.partitionBy("_group")
    spans = laid_out.groupBy("_group", "_part").agg(
        F.sum("_weight").alias("_in_part"), F.count("*").alias("_values")
    )
    spans = spans.select(
        "_group",
        "_part",
        (F.sum("_in_part").over(by_part) - F.col("_in_part")).alias("_before"),
        F.sum("_in_part").over(by_part).alias("_after"),
        F.sum("_in_part").over(whole).alias("_total"),
        F.sum("_values").over(whole).alias("distinct_values"),
    )

    def wanted(p: float) -> Column:
        return F.lit(float(p)) * (F.col("_total") - 1)

    ranks = F.array(*[f(wanted(p)).cast("long") for p in probabilities for f in (F.floor, F.ceil)])
    hit = F.exists("_ranks", lambda r: (r >= F.col("_before")) & (r < F.col("_after")))
    spans = spans.withColumn("_ranks", ranks).where(hit).drop("_after")
    # At most two parts per group and probability.
    known = spans.collect()
    few = F.broadcast(counts.sparkSession.createDataFrame(known, spans.schema))
    running = F.sum("_weight").over(
        Window.partitionBy("_group", "_part").orderBy("_value").rowsBetween(Window.unboundedPreceding, 0)
    )
    inside = laid_out.where(F.col("_part").isin([r["_part"] for r in known])).join(few, ["_group", "_part"])
    inside = inside.withColumn("_after", F.col("_before") + running)
    inside = inside.withColumn("_before", F.col("_after") - F.col("_weight")).where(hit)
    # At most two rows per probability are left in a group.
    found = inside.groupBy("_group", "_total", "distinct_values").agg(
        F.collect_list(F.struct("_before", "_after", "_value")).alias("_hits")
    )

    def at(rank: Column) -> Column:
        holds = F.filter("_hits", lambda h: (h["_before"] <= rank) & (rank < h["_after"]))
        return F.get(holds, F.lit(0))["_value"]

    def interpolated(p: float) -> Column:
        low, high = at(F.floor(wanted(p))), at(F.ceil(wanted(p)))
        return low + (high - low) * (wanted(p) - F.floor(wanted(p)))

    return found.select(
        F.col("_group").alias(group),
        "distinct_values",
        F.array(*[interpolated(p) for p in probabilities]).alias("quantiles"),
    )
