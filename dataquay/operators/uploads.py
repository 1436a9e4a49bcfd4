"""Book-keeping of uploads that arrive in numbered parts, in any order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Gaps are looked for among so many part numbers at a time.
PART_BLOCK = 10_000


def upload_completeness(parts: DataFrame, file: str, part: str, total: str) -> DataFrame:
    """One row per file: parts present, parts expected, and whether all are there.

    A part sent twice counts once; a number outside 1 to the total it was sent
    with is no part of the file and counts as stray. The distinct count runs in
    two shuffles, first by (file, part), so a file with very many parts is
    spread.
    """
    inside = F.col(part).between(1, F.col(total))
    counted = parts.groupBy(file).agg(
        F.count_distinct(F.when(inside, F.col(part))).alias("parts_present"),
        F.count_distinct(F.when(~inside, F.col(part))).alias("parts_stray"),
        F.max(total).cast("long").alias("parts_expected"),
    )
    return counted.withColumns({
        "parts_missing": F.col("parts_expected") - F.col("parts_present"),
        "complete": F.col("parts_present") == F.col("parts_expected"),
    })


def missing_parts(parts: DataFrame, file: str, part: str, total: str) -> DataFrame:
    """One row (file, first_part, last_part) per range of parts that incomplete files still wait for.

    Ranges, not parts, since a total is whatever a sender wrote. Gaps are found
    within blocks of part numbers, and then between the blocks of a file, so a
    file with very many parts is spread.
    """
    expected = parts.groupBy(F.col(file).alias("_file")).agg(F.max(total).cast("long").alias("_last"))
    present = parts.where(F.col(part).between(1, F.col(total))).select(
        F.col(file).alias("_file"), F.col(part).cast("long").alias("_part")
    ).distinct().withColumn("_block", F.expr(f"_part div {PART_BLOCK}"))
    inner = Window.partitionBy("_file", "_block").orderBy("_part")
    gaps = present.withColumn("_next", F.lead("_part").over(inner)).select(
        "_file", (F.col("_part") + 1).alias("first_part"), (F.col("_next") - 1).alias("last_part")
    )
    # From here on there is one row per block of a file.
    blocks = present.groupBy("_file", "_block").agg(F.min("_part").alias("_min"), F.max("_part").alias("_max"))
    outer = Window.partitionBy("_file").orderBy("_block")
    between = blocks.select(
        "_file", (F.coalesce(F.lag("_max").over(outer), F.lit(0)) + 1).alias("first_part"), (F.col("_min") - 1).alias("last_part")
    )
    ends = blocks.groupBy("_file").agg(F.max("_max").alias("_max"))
    tails = expected.join(ends, "_file", "left").select(
        "_file", (F.coalesce("_max", F.lit(0)) + 1).alias("first_part"), F.col("_last").alias("last_part")
    )
    found = gaps.unionAll(between).unionAll(tails).where("first_part <= last_part")
    return found.withColumnRenamed("_file", file)


def parts_in_order(parts: DataFrame, file: str, part: str) -> DataFrame:
    """Parts sorted the way they are put together; sent twice means listed once."""
    return parts.dropDuplicates([file, part]).orderBy(file, part)


def source_size(spark, path: str) -> DataFrame:
    """Files and size in MB of a stored source; only file lengths are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select("length")
    total: Column = F.coalesce(F.sum("length"), F.lit(0))
    return files.agg(
        F.count("*").alias("files"),
        F.round(total.cast("decimal(38,0)") / F.lit(1048576), 2).cast("decimal(20,2)").alias("size_mb"),
    )
