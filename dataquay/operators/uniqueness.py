"""Column sets that single rows out, and what a re-identified row gives away."""

from __future__ import annotations

import json
from collections.abc import Sequence
from functools import reduce
from itertools import combinations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Size of the sketches (a logarithm), their relative standard deviation, and how many of it an estimate is off at most.
SKETCH, DEVIATION, TRUSTED = 12, 0.0163, 8
#: Sets that one pass counts.
SETS_AT_ONCE = 100
#: Two equal rows in one of so many parts, by hash, prove a set not unique.
PARTS = 64


def _named(columns: Sequence[str]) -> list[Column]:
    return [F.col(f"`{c}`") for c in columns]


def _hash(columns: Sequence[str]) -> Column:
    """A hash of some columns that knows which of them are missing: plain hashes pass over those."""
    return F.xxhash64(*[x for c in _named(columns) for x in (c, c.isNull())])


def is_unique(df: DataFrame, columns: Sequence[str]) -> bool:
    """Whether no two rows agree in all of the columns; missing values agree.

    Rows that agree have one hash, so hashes that are all different settle it, and
    they alone cross the network. Of equal hashes, the values of two are looked at;
    only if these differ, and there are more, all values are counted. Text with a
    collation is counted at once: its equal values may differ in their hashes.
    """
    if any("collate" in kind for _, kind in df.select(*_named(columns)).dtypes):
        return not _has_equal(df, columns)
    equal = df.groupBy(_hash(columns).alias("_hash")).agg(F.count("*").alias("n")).where("n > 1")
    found = equal.agg(F.count("*").alias("hashes"), F.min("_hash").alias("low"), F.max("_hash").alias("high")).first()
    if not found["hashes"]:
        return True
    if _has_equal(df.where(_hash(columns).isin(found["low"], found["high"])), columns):
        return False
    return found["hashes"] <= 2 or not _has_equal(df, columns)


def _has_equal(df: DataFrame, columns: Sequence[str]) -> bool:
    return not df.groupBy(*_named(columns)).agg(F.count("*").alias("n")).where("n > 1").isEmpty()


def _refuted(df: DataFrame, sets: Sequence[Sequence[str]]) -> set[int]:
    """Places of the sets of which a small part of the keys shows two equal rows: one pass for all of them.

    Hashes alone choose the part; keys are made of the rows in it.
    """
    inside = [F.pmod(F.xxhash64(*_named(s)), F.lit(PARTS)) == 0 for s in sets]
    keys = [F.when(x, F.struct(F.lit(i).alias("i"), F.array(*[c.cast("string") for c in _named(s)]).alias("key"))) for i, (x, s) in enumerate(zip(inside, sets))]
    tall = df.where(reduce(Column.__or__, inside)).select(F.explode(F.array_compact(F.array(*keys))).alias("s")).select("s.*")
    return {r["i"] for r in tall.groupBy("i", "key").agg(F.count("*").alias("n")).where("n > 1").select("i").distinct().collect()}


def minimal_unique_sets(df: DataFrame, columns: Sequence[str], most: int = 3) -> list[tuple[str, ...]]:
    """The sets of at most `most` columns that tell all rows apart, none of which holds a smaller one.

    Level by level: a set is looked at only if no part of it is unique. One pass
    looks for equal rows in a small part of the keys of all sets of a level. Another
    estimates the distinct rows of the others by sketches; a set far below the number
    of rows isn't unique. What is left is counted exactly.
    A table of one row or none needs no column: the set is empty.
    """
    rows = df.count()
    if rows <= 1:
        return [()]
    least = rows * (1 - TRUSTED * DEVIATION)
    found: list[tuple[str, ...]] = []
    for size in range(1, most + 1):
        sets = [s for s in combinations(columns, size) if not any(set(u) <= set(s) for u in found)]
        for at in range(0, len(sets), SETS_AT_ONCE):
            part = sets[at:at + SETS_AT_ONCE]
            refuted = _refuted(df, part)
            part = [s for i, s in enumerate(part) if i not in refuted]
            if not part:
                continue
            estimates = df.agg(*[F.hll_sketch_estimate(F.hll_sketch_agg(F.xxhash64(*_named(s)), SKETCH)).alias(f"_{i}") for i, s in enumerate(part)]).first()
            found += [s for s, estimate in zip(part, estimates) if estimate >= least and is_unique(df, s)]
    return found


def unique_sets(df: DataFrame, columns: Sequence[str], most: int = 3) -> DataFrame:
    """One row per minimal unique set: attributes (joined by commas, in the order given) and size."""
    rows = [(",".join(s), len(s)) for s in minimal_unique_sets(df, columns, most)]
    return df.sparkSession.createDataFrame(rows, "attributes string, size int")


def risk(df: DataFrame, quasi: Sequence[str], sensitive: Column) -> DataFrame:
    """One risk row of a source: type, probability, impact, value, detail.

    ``probability`` is the largest chance of naming a row by its
    quasi-identifiers, 1/k in a class of k, and ``value`` the mean over rows.
    ``impact`` is what the class alone gives away: the chance of guessing a
    row's sensitive value by the commonest one of its class, as a mean over rows.
    """
    values = df.withColumn("_sensitive", sensitive).groupBy(*_named(quasi), "_sensitive").agg(F.count("*").alias("n"))
    classes = values.groupBy(*_named(quasi)).agg(F.sum("n").alias("k"), F.max("n").alias("most"))
    return classes.agg(
        F.lit("IDENTIFICATION").alias("type"), (F.lit(1.0) / F.min("k")).alias("probability"), (F.sum("most") / F.sum("k")).alias("impact"),
        (F.count("*") / F.sum("k")).alias("value"), F.lit(json.dumps(list(quasi))).alias("detail"),
    )


def risk_by_set(df: DataFrame, quasi: Sequence[str], sensitive: Column, most: int = 3) -> DataFrame:
    """The risk of every set of at most `most` quasi-identifiers: which of them does the harm.

    Rows are grouped by all quasi-identifiers once; the sets are counted over
    these groups in one aggregate.
    """
    sets = [s for size in range(1, most + 1) for s in combinations(range(len(quasi)), size)]
    base = df.withColumn("_sensitive", sensitive).groupBy(*_named(quasi), "_sensitive").agg(F.count("*").alias("n"))
    keys = [F.struct(F.lit(json.dumps([quasi[i] for i in s])).alias("detail"), F.array(*[F.col(f"`{quasi[i]}`").cast("string") for i in s]).alias("key")) for s in sets]
    tall = base.select(F.explode(F.array(*keys)).alias("s"), "_sensitive", "n").select("s.*", "_sensitive", "n")
    classes = tall.groupBy("detail", "key", "_sensitive").agg(F.sum("n").alias("n")).groupBy("detail", "key").agg(F.sum("n").alias("k"), F.max("n").alias("most"))
    return classes.groupBy("detail").agg(
        F.lit("IDENTIFICATION").alias("type"), (F.lit(1.0) / F.min("k")).alias("probability"), (F.sum("most") / F.sum("k")).alias("impact"),
        (F.count("*") / F.sum("k")).alias("value"), F.coalesce(F.sum(F.when(F.col("k") == 1, 1)), F.lit(0)).cast("long").alias("singled_out"),
    )
