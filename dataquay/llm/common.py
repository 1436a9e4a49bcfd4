"""What several operators share: words, normal forms, staged tables."""

from __future__ import annotations

import ctypes
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from dataquay.session import scratch_dir

#: A word, and the white space between words: ASCII blanks only.
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"
#: Rows of a side table that may be broadcast: proven by a count before it is.
BROADCAST_ROWS = 10_000


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


#: Shuffle files go as soon as the table that needed them is written.
_CLEAN = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows that Python gets at a time: some MB of texts.
_BATCH, BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch", 1000
#: A join whose smaller side has no partition above this, as measured, is done by hash instead of by sorting both sides.
_HASHED, HASHED_BYTES = "spark.sql.adaptive.maxShuffledHashJoinLocalMapThreshold", "64m"


def staged(df: DataFrame, label: str) -> DataFrame:
    """Write a table to the shared folder and read it again.

    The copy cuts lineage, fixes row ids made by ``monotonically_increasing_id``
    and outlives lost executors.
    """
    spark = df.sparkSession
    path = scratch_dir(spark, label)
    before = {name: spark.conf.get(name, given) for name, given in ((_CLEAN, "false"), (_BATCH, "10000"), (_HASHED, "0"))}
    spark.conf.set(_CLEAN, "true")
    spark.conf.set(_HASHED, HASHED_BYTES)
    spark.conf.set(_BATCH, str(min(int(before[_BATCH]), BATCH_ROWS)))
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        for name, value in before.items():
            spark.conf.set(name, value)
    return spark.read.schema(df.schema).parquet(path)


Batches = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def tidied(run: Batches, *forget: Callable[[], None]) -> Batches:
    """The same function of batches; when a task is done, its Python worker, which others use after it, gives memory back."""

    def call(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            yield from run(batches)
        finally:
            for f in forget:
                f()
            pa.default_memory_pool().release_unused()
            trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # the C library's own, where it has one
            if trim is not None:
                trim(0)

    return call


def whole_text(text: Column | str = "text") -> Column:
    """The text, empty where null."""
    column = F.col(text) if isinstance(text, str) else text
    return F.coalesce(column.cast("string"), F.lit(""))


def count_words(text: Column | str = "text") -> Column:
    return F.regexp_count(whole_text(text), F.lit(WORD)).cast("long")


def one_space(text: Column | str = "text") -> Column:
    """The text with each run of white space as one blank."""
    return F.regexp_replace(whole_text(text), SPACE, " ")


def uniform(seed: str, *keys: Column) -> Column:
    """A number in [0, 1) that depends on the seed and the keys alone (52 bits of an MD5)."""
    digest = F.md5(F.concat(F.lit(seed + ":"), *[F.coalesce(k.cast("string"), F.lit("")) for k in keys]))
    return F.conv(F.substring(digest, 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def small(df: DataFrame) -> DataFrame:
    """A staged table with a broadcast hint if a count proves it small; else as it is."""
    return F.broadcast(df) if df.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS else df


def same(left: Column, right: Column) -> Column:
    return left.eqNullSafe(right)
