"""Profiles that grow with a source: statistics kept per file, and merged.

A run reads the files that no earlier run has read, adds one row per file and
column to a store, and merges the rows of the files that are there now. New
files cost their own size; files that went or were written anew cost nothing or
their own size. Counts, means, deviations, minima and maxima are those of the
whole source; distinct values and quantiles come from sketches that merge.

The store is two tables: ``pieces``, one row per file and column, and ``files``,
one row per file that a finished run has read. A run writes its pieces first and
its files last, so what a broken run left behind is never counted, and the next
run reads those files again.
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquay.functions.locations import without_patterns
from dataquay.operators.profile import DISTINCT_LOG_SIZE

#: Size of a quantile sketch: ranks are off by about 0.5 %.
RANK_SIZE = 800
#: What tells a file from an earlier one of its name.
IDENTITY = ("file", "length", "modified")
_IDENTITY_TYPES = "file string, length long, modified timestamp"

_FILES = f"run string, {_IDENTITY_TYPES}"
_PIECES = (
    f"run string, {_IDENTITY_TYPES}, position int, name string, numeric boolean, rows long, filled long, numbers long, "
    "mean double, deviations double, low string, high string, distinct binary, ranks binary"
)


def _identity() -> list[Column]:
    fields = ("file_path", "file_size", "file_modification_time")
    return [F.col(f"_metadata.{field}").alias(name) for field, name in zip(fields, IDENTITY)]


def _stored(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A table of the store, empty before the first run."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException as missing:
        if missing.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def list_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, file, length, modified) of the files of a source; no content is read."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return found.select("path", *_identity())


def _sketches(df: DataFrame, names: Sequence[str]) -> DataFrame:
    """One row per file and column. Aggregates are partial in each task, so that a file may have any size."""
    tagged = df.select(*_identity(), *[F.col(f"`{n}`").alias(f"c{i}") for i, n in enumerate(names)])
    found = []
    for i, name in enumerate(names):
        c, numeric = F.col(f"c{i}"), isinstance(df.schema[name].dataType, T.NumericType)
        number = c.cast("double") if numeric else F.lit(None).cast("double")
        real = F.when(~F.isnan(number), number)
        found.append(F.struct(
            F.lit(i).alias("position"), F.lit(name).alias("name"), F.lit(numeric).alias("numeric"),
            F.count(F.lit(1)).alias("rows"), F.count(c).alias("filled"), F.count(real).alias("numbers"),
            F.avg(number).alias("mean"), (F.var_pop(number) * F.count(number)).alias("deviations"),
            F.min(c).cast("string").alias("low"), F.max(c).cast("string").alias("high"),
            F.hll_sketch_agg(F.when(c.isNotNull(), F.xxhash64(c)), F.lit(DISTINCT_LOG_SIZE)).alias("distinct"),
            F.kll_sketch_agg_double(real, F.lit(RANK_SIZE)).alias("ranks"),
        ))
    by_file = tagged.groupBy(*IDENTITY).agg(F.array(*found).alias("columns"))
    return by_file.select(*IDENTITY, F.inline("columns"))


def add_new_files(
    spark: SparkSession, store: str, path: str, columns: Sequence[str] | None = None, files: DataFrame | None = None
) -> int:
    """Read the Parquet files that the store does not know, and keep their statistics; how many there were.

    A file is known by its name, length and time of modification. Hive partition
    columns count as columns. The driver sees the names of the new files, as it
    does whenever Spark reads files. A file that changes while it is read is an
    error, and the run leaves nothing behind that counts.
    """
    listed = list_files(spark, path) if files is None else files
    new = listed.join(_stored(spark, f"{store}/files", _FILES), list(IDENTITY), "left_anti")
    wanted = new.collect()
    if not wanted:
        return 0
    whole = spark.read.parquet(path)
    names = list(columns or whole.columns)
    plain = [without_patterns(row["path"]) for row in wanted]
    df = spark.read.schema(whole.schema).option("basePath", path).parquet(*plain)
    run = uuid.uuid4().hex
    pieces = _sketches(df, names).withColumn("run", F.lit(run))
    pieces.select(*_fields(_PIECES)).write.mode("append").parquet(f"{store}/pieces")
    seen = spark.createDataFrame([(run, *[row[c] for c in IDENTITY]) for row in wanted], _FILES)
    written = _stored(spark, f"{store}/pieces", _PIECES).where(F.col("run") == run)
    if not written.join(seen, list(IDENTITY), "left_anti").isEmpty():
        raise RuntimeError("Files changed while they were read; run again")
    seen.write.mode("append").parquet(f"{store}/files")
    return len(wanted)


def _fields(schema: str) -> list[str]:
    return [field.strip().split(" ")[0] for field in schema.split(",")]


def _order(text: Column) -> Column:
    """Stored text as something that sorts as the column does."""
    number = F.when(F.col("numeric"), text)
    return F.struct(
        number.try_cast("double").alias("n"), number.try_cast("decimal(38,18)").alias("exact"),
        F.when(~F.col("numeric"), text).alias("t"),
    )


def merged_profile(
    spark: SparkSession, store: str, path: str, probabilities: Sequence[float] = (0.5,), files: DataFrame | None = None
) -> DataFrame:
    """Statistics of each column over the files that are there now, from the store alone.

    Pieces of files that went, or that were written anew, do not count; neither do
    files that :func:`add_new_files` has not read. A file that two runs have read
    at once counts once. ``quantiles`` is null for columns without numbers, and
    leaves NaN out; means and deviations do not.
    """
    listed = list_files(spark, path) if files is None else files
    known = _stored(spark, f"{store}/files", _FILES).groupBy(*IDENTITY).agg(F.min("run").alias("run"))
    pieces = _stored(spark, f"{store}/pieces", _PIECES)
    pieces = pieces.join(known, ["run", *IDENTITY], "left_semi").join(listed, list(IDENTITY), "left_semi")
    weight = F.when(F.col("mean").isNotNull(), F.col("filled"))
    merged = pieces.groupBy("position", "name", "numeric").agg(
        F.sum("rows").alias("rows"), F.sum("filled").alias("_filled"), F.sum("numbers").alias("_numbers"),
        (F.sum(F.col("mean") * weight) / F.sum(weight)).alias("mean_value"),
        F.min_by("low", F.when(F.col("low").isNotNull(), _order(F.col("low")))).alias("min_value"),
        F.max_by("high", F.when(F.col("high").isNotNull(), _order(F.col("high")))).alias("max_value"),
        F.hll_sketch_estimate(F.hll_union_agg("distinct")).alias("distinct_values"),
        F.kll_merge_agg_double("ranks").alias("_ranks"),
    )
    # A second pass over one row per file and column: squares about the mean of all lose no digits.
    means = F.broadcast(merged.select("position", F.col("mean_value").alias("_mean")))  # one row per column
    apart = pieces.join(means, "position").groupBy("position").agg(
        F.sum(F.col("deviations") + weight * (F.col("mean") - F.col("_mean")) ** 2).alias("_squares")
    )
    points = [F.kll_sketch_get_quantile_double("_ranks", F.lit(float(p))) for p in probabilities]
    return merged.join(apart, "position").select(
        "position", "name", "rows", (F.col("rows") - F.col("_filled")).alias("missing_total"), "distinct_values",
        "mean_value", F.when(F.col("_filled") > 1, F.sqrt(F.col("_squares") / (F.col("_filled") - 1))).alias("std_deviation"),
        "min_value", "max_value",
        F.when(F.col("_numbers") > 0, F.array(*points)).alias("quantiles"),
    )


def profile_files(
    spark: SparkSession, store: str, path: str, columns: Sequence[str] | None = None, probabilities: Sequence[float] = (0.5,)
) -> DataFrame:
    """Bring the store up to date, then merge it. New files alone are read."""
    files = list_files(spark, path)
    add_new_files(spark, store, path, columns, files)
    return merged_profile(spark, store, path, probabilities, files)
