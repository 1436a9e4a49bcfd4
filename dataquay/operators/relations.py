"""Declared relations between sources: foreign keys and lookups."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class KeyPart(NamedTuple):
    """One column pair of a foreign key; ``order`` is its place in the key."""

    order: int
    from_attribute: str
    to_attribute: str


def _pairs(parts: Sequence[KeyPart]) -> list[tuple[str, str]]:
    return [(p.from_attribute, p.to_attribute) for p in sorted(parts)]


def _condition(child: DataFrame, parent: DataFrame, parts: Sequence[KeyPart]) -> Column:
    tests = [child[a] == parent[b] for a, b in _pairs(parts)]
    return reduce(Column.__and__, tests)


def join_by_key(child: DataFrame, parent: DataFrame, parts: Sequence[KeyPart], how: str = "inner") -> DataFrame:
    """Join two sources along a foreign key.

    No hint is given: the parent is broadcast when its measured size allows,
    otherwise AQE splits the partitions of a key that many children share.
    """
    return child.join(parent, _condition(child, parent, parts), how)


def orphans(child: DataFrame, parent: DataFrame, parts: Sequence[KeyPart]) -> DataFrame:
    """Child rows whose key is complete and has no parent."""
    complete = reduce(Column.__and__, [F.col(a).isNotNull() for a, _ in _pairs(parts)])
    keys = parent.select(*[b for _, b in _pairs(parts)])
    return child.where(complete).join(keys, _condition(child, keys, parts), "left_anti")


def count_orphans(name: str, child: DataFrame, parent: DataFrame, parts: Sequence[KeyPart]) -> DataFrame:
    """One row (fk, child_rows, orphan_rows) for a foreign key.

    Children are counted per key first, so a key that many rows share crosses
    the shuffle once per task.
    """
    columns = [a for a, _ in _pairs(parts)]
    per_key = child.groupBy(*columns).agg(F.count("*").alias("n"))
    # The keys of a parent are unique only by promise.
    keys = parent.select(*[F.col(b).alias(f"_{b}") for _, b in _pairs(parts)]).distinct().withColumn("_hit", F.lit(True))
    tests = [per_key[a] == keys[f"_{b}"] for a, b in _pairs(parts)]
    joined = per_key.join(keys, reduce(Column.__and__, tests), "left")
    complete = reduce(Column.__and__, [F.col(a).isNotNull() for a in columns])
    missing = F.when(complete & F.col("_hit").isNull(), F.col("n")).otherwise(0)
    return joined.agg(
        F.coalesce(F.sum("n"), F.lit(0)).cast("long").alias("child_rows"),
        F.coalesce(F.sum(missing), F.lit(0)).cast("long").alias("orphan_rows"),
    ).select(F.lit(name).alias("fk"), "child_rows", "orphan_rows")


def decode(df: DataFrame, code: str, lookup: DataFrame, as_: str) -> DataFrame:
    """Add the description of a code from a two-column lookup source.

    A code that the lookup lists twice has the first of its descriptions by
    name, so that rows never multiply.
    """
    if len(lookup.columns) != 2:
        raise ValueError("A lookup source has exactly two attributes")
    key, description = lookup.columns
    renamed = lookup.groupBy(F.col(key).alias("_code")).agg(F.min(description).alias(as_))
    return df.join(renamed, df[code] == renamed["_code"], "left").drop("_code")
