"""Sharding by proportional stratified interleaving.

Rows are shuffled by a seeded hash and ranked within their source; sorting all
rows by (rank + 0.5) / rows of the source spreads every source evenly over the
line, and cutting the line into equal pieces gives shards that all match the
mixture. Both sorts are range sorts over rows without texts; ranks come from
counts per part of a sort, so no source passes through one task however large.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataquay.llm.common import same, small, staged, whole_text

#: Bytes that a row takes besides its text.
ROW_OVERHEAD = 8
_INDEX_BITS = 33  # of monotonically_increasing_id


def _sorted(df: DataFrame, order: list[str], label: str) -> DataFrame:
    """Rows in order, with `part` (ascending along the order) and `at` (place in the part)."""
    ordered = df.repartitionByRange(*order).sortWithinPartitions(*order)
    at = F.monotonically_increasing_id()
    ids = ordered.withColumn("mid", at)
    parts = ids.withColumn("part", F.shiftright("mid", _INDEX_BITS))
    return staged(parts.withColumn("at", F.col("mid").bitwiseAND((1 << _INDEX_BITS) - 1)).drop("mid"), label)


def _offsets(parts: DataFrame, group: list[str]) -> DataFrame:
    """Per group and part: the first place, rows of the group before the part, and rows of the group."""
    counts = parts.groupBy(*group, "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    whole = Window.partitionBy(*group)
    before = whole.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(
        *group, "part", "first",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"), F.sum("n").over(whole).alias("total"),
    )


def assign_shards(
    docs: DataFrame, shards: int = 24, seed: str = "shard", id_col: str = "doc_id", text_col: str = "text",
    source_col: str = "source", carry: tuple[str, ...] = (),
) -> DataFrame:
    """One row per row of `docs`: doc_id, source, size, text_crc32, shard, slot, and the columns in `carry`.

    Row counts of shards differ by one at most, and so do the rows that a shard
    has of each source, but for one row on either end. Slots count from 0
    without gaps. Null texts are empty, null sources form a stratum, null ids
    shuffle as an empty id; equal rows share neighbouring places in any order.
    An empty table gives no rows. `carry` columns travel through both sorts
    under the names `carry_0`, `carry_1`, ….
    """
    text = whole_text(text_col)
    rows = staged(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"),
        (F.octet_length(text) + F.lit(ROW_OVERHEAD)).cast("long").alias("size"),
        F.crc32(text.cast("binary")).cast("long").alias("text_crc32"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id_col).cast("string"), F.lit("")))).alias("shuffled"),
        *[F.col(c).alias(f"carry_{i}") for i, c in enumerate(carry)],
    ), "shard-rows")
    strata = _sorted(rows, ["source", "shuffled", "doc_id", "text_crc32", "size"], "shard-strata")
    offsets = small(staged(_offsets(strata, ["source"]), "shard-ranks").withColumnsRenamed({"part": "o_part", "source": "o_source"}))
    joined = strata.join(offsets, (F.col("part") == F.col("o_part")) & same(F.col("source"), F.col("o_source")))
    rank = F.col("at") - F.col("first") + F.col("before")
    line = joined.withColumn("fraction", (rank + F.lit(0.5)) / F.col("total")).drop(
        "part", "at", "o_part", "o_source", "first", "before", "total",
    )
    line = _sorted(line, ["fraction", "source", "shuffled", "doc_id", "text_crc32", "size"], "shard-line")
    # One row per part of the sort: as many as there are partitions, whatever the data.
    counts = line.groupBy("part").agg(F.count("*").alias("n"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    everything = Window.partitionBy()
    places = small(staged(counts.select(
        F.col("part").alias("o_part"), F.coalesce(F.sum("n").over(before), F.lit(0)).alias("before"),
        F.sum("n").over(everything).alias("total"),
    ), "shard-places"))
    cut = line.join(places, F.col("part") == F.col("o_part")).withColumn("place", F.col("before") + F.col("at"))
    cut = cut.withColumn("shard", F.expr(f"int(place * {shards} div total)"))
    return cut.select(
        "doc_id", "source", "size", "text_crc32", "shard",
        F.expr(f"place - (shard * total + {shards - 1}) div {shards}").alias("slot"),
        *[f"carry_{i}" for i in range(len(carry))],
    )


def write_shards(docs: DataFrame, path: str, shards: int = 24, columns: tuple[str, ...] = ("text",), **options) -> None:
    """Write the shards with the given columns of `docs`, one folder each, files in order of slot."""
    rows = assign_shards(docs, shards, carry=columns, **options)
    named = rows.select("doc_id", "shard", "slot", *[F.col(f"carry_{i}").alias(c) for i, c in enumerate(columns)])
    named.repartitionByRange("shard", "slot").sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
