"""Column statistics of a source.

Two modes. The quick one aggregates without a shuffle of the data: sketches
give distinct values and quantiles. The exact one counts each distinct
value once (partial aggregation absorbs hot values) and finds quantiles by
position in a distributed sort of those counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquay.functions.cells import is_missing
from dataquay.operators.positions import quantiles

DECILES = tuple(i / 10 for i in range(1, 10))
MEDIAN = (0.5,)
# 2^12 registers: distinct counts are off by about 1.6 %.
DISTINCT_LOG_SIZE = 12
QUANTILE_ACCURACY = 10_000


def _is_number(df: DataFrame, name: str) -> bool:
    return isinstance(df.schema[name].dataType, T.NumericType)


def _ref(name: str) -> Column:
    return F.col(f"`{name}`")


def _one_row_per_column(totals: DataFrame, names: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """Turn the one wide row ``{i}_{field}`` into rows (position, name, fields...)."""
    rows = F.array(*[
        F.struct(
            F.lit(i).alias("position"),
            F.lit(name).alias("name"),
            *[F.col(f"{i}_{field}").alias(field) for field in fields],
        )
        for i, name in enumerate(names)
    ])
    return totals.select(F.explode(rows).alias("r")).select("r.*")


def _moments(df: DataFrame, i: int, name: str) -> list[Column]:
    c = _ref(name)
    numeric = _is_number(df, name)
    nothing = F.lit(None).cast("double")
    return [
        (F.avg(c) if numeric else F.max(nothing)).cast("double").alias(f"{i}_mean_value"),
        (F.stddev_samp(c) if numeric else F.max(nothing)).cast("double").alias(f"{i}_std_deviation"),
        F.min(c).cast("string").alias(f"{i}_min_value"),
        F.max(c).cast("string").alias(f"{i}_max_value"),
        F.count_if(c.isNull()).alias(f"{i}_missing_total"),
    ]


def _approximate_distinct(c: Column) -> Column:
    hashed = F.when(c.isNotNull(), F.xxhash64(c))
    return F.coalesce(F.hll_sketch_estimate(F.hll_sketch_agg(hashed, F.lit(DISTINCT_LOG_SIZE))), F.lit(0))


MOMENTS = ("mean_value", "std_deviation", "min_value", "max_value", "missing_total")


def value_counts(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """(position, l, d, s, n): how often each value of each column occurs.

    Whole numbers are in ``l``, other floats in ``d``, and all else in ``s`` as
    text; keys of fixed width keep the aggregate fast.
    """
    def slots(name: str) -> list[Column]:
        dtype, c = df.schema[name].dataType, _ref(name)
        l, d, s = F.lit(None).cast("long"), F.lit(None).cast("double"), F.lit(None).cast("string")
        if isinstance(dtype, T.IntegralType):
            l = c.cast("long")
        elif isinstance(dtype, (T.FloatType, T.DoubleType)):
            d = c.cast("double")
        else:
            s = c.cast("string")
        return [l, d, s]

    values = [x for i, n in enumerate(names) for x in (F.lit(i), *slots(n))]
    cells = df.select(F.stack(F.lit(len(names)), *values).alias("position", "l", "d", "s"))
    filled = F.col("l").isNotNull() | F.col("d").isNotNull() | F.col("s").isNotNull()
    return cells.where(filled).groupBy("position", "l", "d", "s").agg(F.count("*").alias("n"))


def _exact_quantiles(df: DataFrame, names: Sequence[str], probabilities: Sequence[float]) -> DataFrame:
    """(position, distinct_values, quantiles) of numeric columns."""
    value = F.coalesce(F.col("l").cast("double"), "d", F.col("s").try_cast("double"))
    counts = value_counts(df, names).select("position", value.alias("v"), "n")
    return quantiles(counts, "position", "v", "n", probabilities)


def _renumbered(df: DataFrame, places: Sequence[int]) -> DataFrame:
    """Positions in a subset of the columns as positions in the whole."""
    return df.withColumn("position", F.get(F.array(*[F.lit(i) for i in places]), F.col("position")))


def _by_kind(df: DataFrame, names: Sequence[str], numbers, others) -> DataFrame:
    """Rows about the numeric columns and rows about the others, by a function for each."""
    found = []
    for numeric, about in ((True, numbers), (False, others)):
        places = [i for i, n in enumerate(names) if _is_number(df, n) == numeric]
        if places:
            found.append(_renumbered(about(df, [names[i] for i in places]), places))
    return reduce(DataFrame.unionByName, found)


def _all_moments(df: DataFrame, names: Sequence[str]) -> DataFrame:
    totals = df.agg(*[a for i, n in enumerate(names) for a in _moments(df, i, n)])
    return _one_row_per_column(totals, names, MOMENTS)


def _exact_number_ranks(df: DataFrame, names: Sequence[str]) -> DataFrame:
    found = _exact_quantiles(df, names, MEDIAN)
    return found.select("position", "distinct_values", F.get("quantiles", F.lit(0)).alias("median"))


def _exact_distinct(df: DataFrame, names: Sequence[str]) -> DataFrame:
    counted = value_counts(df, names).groupBy("position").agg(F.count("*").alias("distinct_values"))
    return counted.withColumn("median", F.lit(None).cast("double"))


def _sketched_ranks(df: DataFrame, names: Sequence[str]) -> DataFrame:
    nothing = F.max(F.lit(None).cast("double"))
    sketches = []
    for i, n in enumerate(names):
        median = F.approx_percentile(_ref(n).cast("double"), MEDIAN[0], QUANTILE_ACCURACY)
        sketches += [
            _approximate_distinct(_ref(n)).alias(f"{i}_distinct_values"),
            (median if _is_number(df, n) else nothing).alias(f"{i}_median"),
        ]
    return _one_row_per_column(df.agg(*sketches), names, ("distinct_values", "median")).drop("name")


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """Statistics of each column: distinct, mean, median, min, max, deviation, missing.

    Min, max and median are text, since a column may have any type. The quick
    form estimates distinct values and medians; the exact one shuffles each
    distinct value once.

    Numeric moments are an aggregate of their own, which Spark compiles whole;
    sketches and text in the same aggregate would make it interpret them all.
    """
    names = list(columns or df.columns)
    moments = _by_kind(df, names, _all_moments, _all_moments)
    if exact:
        ranks = _by_kind(df, names, _exact_number_ranks, _exact_distinct)
    else:
        ranks = _sketched_ranks(df, names)
    result = moments.join(ranks, "position", "left")
    return result.select(
        "position", "name", F.coalesce("distinct_values", F.lit(0)).alias("distinct_values"), "mean_value",
        F.col("median").cast("string").alias("median_value"),
        "max_value", "min_value", "std_deviation", "missing_total",
    )


def deciles(df: DataFrame, columns: Sequence[str] | None = None, exact: bool = False) -> DataFrame:
    """The nine deciles of each numeric column, as an array of doubles."""
    names = [n for n in (columns or df.columns) if _is_number(df, n)]
    if exact:
        found = _exact_quantiles(df, names, DECILES)
        listed = df.sparkSession.createDataFrame(list(enumerate(names)), "position int, name string")
        return listed.join(found, "position", "left").select("position", "name", F.col("quantiles").alias("deciles"))
    sketches = [
        F.approx_percentile(_ref(n).cast("double"), list(DECILES), QUANTILE_ACCURACY).alias(f"{i}_deciles")
        for i, n in enumerate(names)
    ]
    return _one_row_per_column(df.agg(*sketches), names, ("deciles",))


def deciles_json(values: Column) -> Column:
    """Deciles as the JSON text a catalog stores, with four decimals."""
    rounded = F.transform(values, lambda x: F.round(x, 4).cast("decimal(38,4)"))
    return F.to_json(rounded)


def profile_missing(df: DataFrame, columns: Sequence[str] | None = None, tokens: Sequence[str] = ()) -> DataFrame:
    """Missing cells per column: NULL, empty text, or a missing-value token."""
    names = list(columns or df.columns)
    counts = [
        F.count_if(is_missing(_ref(n).cast("string"), tokens)).alias(f"{i}_missing_total")
        for i, n in enumerate(names)
    ]
    return _one_row_per_column(df.agg(*counts), names, ("missing_total",))


def profile_table(df: DataFrame) -> DataFrame:
    """The row count a catalog stores for a source."""
    return df.agg(F.count("*").alias("estimated_rows"))


def count_profiling(sources: DataFrame, profiled: DataFrame) -> DataFrame:
    """Add one to the profiling counter of the sources whose id was profiled."""
    done = F.col("id").isin(profiled.select("id"))
    step = F.when(done, 1).otherwise(0)
    return sources.withColumn("statistics_process_counter", F.col("statistics_process_counter") + step)
