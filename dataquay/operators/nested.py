"""Parents with their children nested as lists.

A parent may have so many children that one list would not fit in a task. Its
document then goes on over several rows, numbered by ``part``: each row holds
about ``part_rows`` children of a kind, and no child is left out. Parents with
fewer children, the normal case, get the one row with ``part`` 0.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.operators.positions import explode_range

PART_ROWS = 10_000
KNOWN_LARGE = 10_000


class Children(NamedTuple):
    """A child relation: its rows, the parent key in it, and the fields to nest.

    The fields must tell the children of a parent apart (as an id does): rows
    with equal fields always land in the same part.
    """

    rows: DataFrame
    parent: str
    fields: Sequence[str]


def _stack(frames: Sequence[DataFrame]) -> DataFrame:
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def _large_families(children: Mapping[str, Children], part_rows: int) -> DataFrame | None:
    """(_key, _parts) of the parents whose lists need several parts, None if there are none.

    Finding them costs a count per parent key, reduced before its shuffle. A
    short result is kept as a local relation, small enough to broadcast; a long
    one stays a relation, and joins with it are split by AQE where keys are hot.
    """
    counts = [
        child.rows.groupBy(F.col(child.parent).alias("_key"))
        .agg(F.count("*").alias("_n"))
        .where(F.col("_n") > part_rows)
        for child in children.values()
    ]
    parts = F.ceil(F.max("_n") / part_rows).cast("long").alias("_parts")
    large = _stack(counts).groupBy("_key").agg(parts)
    known = large.limit(KNOWN_LARGE + 1).collect()
    if not known:
        return None
    if len(known) > KNOWN_LARGE:
        return large
    return F.broadcast(large.sparkSession.createDataFrame(known, large.schema))


def nest_children(
    parents: DataFrame,
    key: str,
    children: Mapping[str, Children],
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """Parents left-joined to lists of their children, one list column per kind.

    All kinds travel in one shuffle. It is by parent alone when every list fits
    in a part, and the join then needs no other; with large families it is by
    (parent, part), so that the children of one parent spread over tasks.
    A parent without children gets empty lists.
    """
    kinds = list(children)
    stacked = _stack([
        child.rows.select(F.col(child.parent).alias("_key"), F.struct(*child.fields).alias(f"_{kind}"))
        for kind, child in children.items()
    ])
    large = _large_families(children, part_rows)
    first = F.lit(0).cast("long")
    if large is None:
        keys = ["_key"]
        placed = stacked.withColumn("part", first)
        numbered = parents.withColumns({"_key": F.col(key), "part": first})
    else:
        keys = ["_key", "part"]
        item = F.xxhash64(*[f"_{kind}" for kind in kinds])
        part = F.coalesce(F.pmod(item, F.col("_parts")), first)
        placed = stacked.join(large, "_key", "left").withColumn("part", part).drop("_parts")
        spread = parents.withColumn("_key", F.col(key)).join(large, "_key", "left")
        numbered = explode_range(spread, "part", F.coalesce("_parts", F.lit(1))).drop("_parts")
    # Explicit, so that a join by key alone never stands in for these keys.
    lists = (
        placed.repartition(*keys)
        .groupBy("_key", "part")
        .agg(*[F.sort_array(F.collect_list(f"_{kind}")).alias(kind) for kind in kinds])
    )
    if large is None:
        lists = lists.drop("part")
    joined = numbered.join(lists, keys, "left").drop("_key")
    filled = {
        kind: F.coalesce(kind, F.array().cast(lists.schema[kind].dataType)) for kind in kinds
    }
    return joined.withColumns(filled)


def with_storage(sources: DataFrame, storages: DataFrame) -> DataFrame:
    """Sources with their storage as a struct; a source always has one."""
    packed = storages.select(F.col("id").alias("_sid"), F.struct(*storages.columns).alias("storage"))
    return sources.join(packed, sources["storage_id"] == packed["_sid"]).drop("_sid")


def with_privacy(attributes: DataFrame, privacy: DataFrame) -> DataFrame:
    """Attributes with their privacy setting as a struct, NULL when there is none."""
    fields = [c for c in privacy.columns if c != "attribute_id"]
    packed = privacy.select(F.col("attribute_id").alias("_aid"), F.struct(*fields).alias("privacy"))
    return attributes.join(packed, attributes["id"] == packed["_aid"], "left").drop("_aid")


def privacy_view(sources: DataFrame, attributes: DataFrame, privacy: DataFrame) -> DataFrame:
    """One row per attribute with a privacy setting, of enabled privacy-aware sources."""
    kept = sources.where(F.col("enabled") & F.col("privacy_aware")).select(
        F.col("id").alias("data_source_id"), F.col("name").alias("data_source_name")
    )
    named = attributes.select("data_source_id", F.col("id").alias("attribute_id"), "name", "type")
    return kept.join(named, "data_source_id").join(privacy, "attribute_id")


def expand_groups(attributes: DataFrame, policies: DataFrame) -> DataFrame:
    """Give each attribute the policy of its privacy group.

    One policy speaks for a group (the one with the largest id), so the result
    has one row per attribute and no pairs of members.
    """
    fields = [c for c in policies.columns if c not in ("id", "group_id")]
    chosen = (
        policies.groupBy("group_id")
        .agg(F.max_by(F.struct(*fields), F.col("id")).alias("_policy"))
        .select("group_id", *[F.col("_policy")[f].alias(f) for f in fields])
    )
    return attributes.join(chosen, "group_id", "left")


def source_documents(
    sources: DataFrame,
    storages: DataFrame,
    children: Mapping[str, Children],
    part_rows: int = PART_ROWS,
) -> DataFrame:
    """The full document of a source: storage, and the lists of its children."""
    return nest_children(with_storage(sources, storages), "id", children, part_rows)
