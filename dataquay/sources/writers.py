"""Exports: a source as CSV, and many Parquet files as few."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Files of a compacted source are about this large.
FILE_BYTES = 512 * 1024 * 1024


CSV_OPTIONS = {
    # Empty text is quoted, which tells it from NULL when it is read back.
    "emptyValue": '""',
    "escape": '"',
    "timestampNTZFormat": "yyyy-MM-dd HH:mm:ss[.SSSSSS]",
}


def export_csv(df: DataFrame, path: str) -> None:
    """Write a source as CSV files, each with a header, that readers take as one."""
    df.write.options(header=True, **CSV_OPTIONS).csv(path)


def export_csv_download(df: DataFrame, path: str) -> None:
    """Write a source as parts of one CSV file with a single header.

    The parts, put together in the order of their names, are the file; the
    header is a part of its own, the first. Every part is written by its own
    task, so the source may be of any size.
    """
    names = df.sparkSession.createDataFrame([tuple(df.columns)], T.StructType(
        [T.StructField(f"_{i}", T.StringType()) for i in range(len(df.columns))]
    ))
    header = names.coalesce(1).select(F.to_csv(F.struct("*"), CSV_OPTIONS).alias("value"))
    rows = df.select(F.to_csv(F.struct("*"), CSV_OPTIONS).alias("value"))
    header.unionAll(rows).write.text(path)


#: How Spark packs files into tasks: by bytes, largest first, whatever their number and the cores.
_PACKED = {"spark.sql.files.openCostInBytes": "1", "spark.sql.files.minPartitionNum": "1"}


def compact_parquet(spark: SparkSession, path: str, out: str, file_bytes: int = FILE_BYTES) -> int:
    """Rewrite a folder of Parquet files as files of about ``file_bytes``.

    Files are packed by their bytes, and larger ones cut between row groups, so
    that no output file is much above the size and few are below half of it,
    however uneven the input. A source below that size becomes one file, as a
    download needs. Every file that the Parquet reader takes counts, whatever its
    name ends with. Returns the number of files. Each output file has a task of
    its own, and no row moves between tasks.
    """
    before = {name: spark.conf.get(name, None) for name in (*_PACKED, "spark.sql.files.maxPartitionBytes")}
    try:
        for name, value in {**_PACKED, "spark.sql.files.maxPartitionBytes": str(file_bytes)}.items():
            spark.conf.set(name, value)
        df = spark.read.parquet(path)
        parts = max(1, df.rdd.getNumPartitions())
        df.coalesce(parts).write.parquet(out)  # one part at least, so that an empty source has a file too
    finally:
        for name, value in before.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
    return parts
