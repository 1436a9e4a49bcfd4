"""Privacy models applied: full-domain generalisation to k-anonymity and l-diversity.

Each quasi-identifier has a ladder of levels, from the value over ever coarser
categories to suppression. A node of the lattice takes one level of each ladder;
it is safe if every class of rows that agree then has `k` rows and `l` distinct
sensitive values, but for a share of rows that may be left out. Whatever lies
above a safe node is safe too, so the search goes upwards by the sum of levels
and leaves out all that lies above a safe node. It begins where each ladder is
safe alone, which one aggregate over all ladders tells; rows are grouped at
these levels once, and all open nodes of a sum are counted by one aggregate over
the groups. The driver sees one row per node.
"""

from __future__ import annotations

import json
import math
from collections.abc import Sequence
from itertools import product
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquay.operators.privacy import generalize, suppress
from dataquay.session import scratch_dir

#: Nodes that a lattice may have; ladders of a few levels each have fewer.
MOST_NODES = 20_000
#: Nodes that one aggregate counts; more are counted in turns.
NODES_AT_ONCE = 64
NODE = "levels array<int>, small long, classes long, smallest long, squares long"


class Ladder(NamedTuple):
    """A quasi-identifier and its rules (JSON, as in a policy's hierarchy), from fine to coarse."""

    attribute: str
    rules: tuple[str, ...] = ()

    @property
    def height(self) -> int:
        """The level that suppresses; level 0 is the value."""
        return len(self.rules) + 1


class Model(NamedTuple):
    """What makes a table safe."""

    k: int
    l: int = 1  # noqa: E741
    #: Share of rows that may be left out, because their class is small.
    suppress: float = 0.0


class Node(NamedTuple):
    """Levels that are safe, and what they cost."""

    levels: tuple[int, ...]
    #: Mean height over the ladders: 0 keeps all values, 1 none.
    loss: float
    #: Rows in classes that are too small, which go.
    suppressed: int
    #: Classes that stay, the smallest, and the sum of their squared sizes.
    classes: int
    smallest: int | None
    squares: int


def ladder(attribute: str, hierarchy: str | None) -> Ladder:
    """The ladder of a stored hierarchy: ``{"levels": [rule, ...]}``, one rule, or none."""
    rule = json.loads(hierarchy or "{}")
    steps = rule.get("levels", [rule] if rule else [])
    return Ladder(attribute, tuple(json.dumps(s) for s in steps))


def at_level(df: DataFrame, step: Ladder, level: int) -> Column:
    c = F.col(f"`{step.attribute}`")
    if level == 0:
        return c
    if level == step.height:
        return suppress(c, df.schema[step.attribute].dataType)
    return generalize(c, step.rules[level - 1])


def _texts(df: DataFrame, step: Ladder) -> Column:
    """The value as text at every level."""
    return F.array(*[at_level(df, step, i).cast("string") for i in range(step.height + 1)])


def _unsafe(model: Model) -> Column:
    return (F.col("n") < model.k) | (F.col("kinds") < model.l)


def _classes(counted: DataFrame, key: Sequence[str]) -> DataFrame:
    """Per class its rows and its sensitive values, from rows (key, sensitive, n)."""
    by_value = counted.groupBy(*key, "sensitive").agg(F.sum("n").alias("n"))
    return by_value.groupBy(*key).agg(F.sum("n").alias("n"), F.count("sensitive").alias("kinds"))


def _lowest(rows: DataFrame, ladders: Sequence[Ladder], model: Model) -> tuple[int, list[int] | None]:
    """The number of rows, and per ladder the first level that is safe alone; None if suppression is not."""
    places = [
        F.struct(F.lit(i).alias("i"), F.lit(level).alias("level"), F.get(f"_q{i}", F.lit(level)).alias("value"), F.get(f"_q{i}", F.lit(level + 1)).alias("next"))
        for i, step in enumerate(ladders) for level in range(step.height + 1)
    ]
    tall = rows.select(F.explode(F.array(*places)).alias("p"), "sensitive").select("p.*", "sensitive")
    steps = tall.groupBy("i", "level", "value", "next", "sensitive").agg(F.count("*").alias("n"))
    per_class = _classes(steps, ["i", "level", "value"])
    levels = per_class.groupBy("i", "level").agg(F.sum("n").alias("rows"), F.coalesce(F.sum(F.when(_unsafe(model), F.col("n"))), F.lit(0)).alias("small"))
    found = {(r["i"], r["level"]): r for r in levels.collect()}
    forks = steps.groupBy("i", "level", "value").agg(F.count_distinct("next").alias("kinds"), F.max(F.col("next").isNull()).alias("gone"), F.max(F.col("next").isNotNull()).alias("stays"))
    fork = forks.where((F.col("kinds") > 1) | (F.col("gone") & F.col("stays"))).select("i", "level").first()
    if fork is not None:
        raise ValueError(f"Level {fork['level'] + 1} of {ladders[fork['i']].attribute} splits a value of the level below")
    total = next((r["rows"] for r in found.values()), 0)
    safe = [
        [level for level in range(step.height + 1) if (i, level) in found and found[i, level]["small"] <= model.suppress * total]
        for i, step in enumerate(ladders)
    ]
    return total, [min(s) for s in safe] if all(safe) else None


def _evaluate(base: DataFrame, lowest: Sequence[int], nodes: Sequence[tuple[int, ...]], model: Model) -> list:
    """One row per node: rows in small classes, the classes that stay, their smallest, the sum of their squares."""
    listed = F.explode(F.array(*[F.array(*[F.lit(x) for x in node]) for node in nodes])).alias("levels")
    key = F.array(*[F.get(f"_q{i}", F.get("levels", F.lit(i)) - F.lit(low)) for i, low in enumerate(lowest)])
    counted = base.select("*", listed).select("levels", key.alias("key"), "sensitive", "n")
    per_class = _classes(counted, ["levels", "key"])
    big = F.when(~_unsafe(model), F.col("n"))
    return per_class.groupBy("levels").agg(
        F.coalesce(F.sum(F.when(_unsafe(model), F.col("n"))), F.lit(0)).alias("small"), F.count(big).alias("classes"),
        F.min(big).alias("smallest"), F.coalesce(F.sum(big * big), F.lit(0)).alias("squares"),
    ).collect()


def safe_nodes(df: DataFrame, ladders: Sequence[Ladder], model: Model, sensitive: Column | None = None) -> list[Node]:
    """All safe nodes that lie above no other safe node, best first: least loss, then least squares, then levels.

    Missing values agree with each other. There is none if the table has rows,
    but is not safe with every quasi-identifier suppressed. A level that splits
    a value of the one below is an error.
    """
    if not ladders:
        raise ValueError("A privacy model needs a quasi-identifier")
    if math.prod(step.height + 1 for step in ladders) > MOST_NODES:
        raise ValueError(f"More than {MOST_NODES} nodes: use fewer attributes or levels")
    spark = df.sparkSession
    told = F.lit("") if sensitive is None else sensitive.cast("string")
    rows = df.select(*[_texts(df, step).alias(f"_q{i}") for i, step in enumerate(ladders)], F.coalesce(told, F.lit("\0")).alias("sensitive"))
    total, lowest = _lowest(rows, ladders, model)
    if total == 0:
        return [Node((0,) * len(ladders), 0.0, 0, 0, None, 0)]
    if lowest is None:
        return []
    upwards = [F.slice(f"_q{i}", low + 1, step.height + 1 - low).alias(f"_q{i}") for i, (step, low) in enumerate(zip(ladders, lowest))]
    path = scratch_dir(spark, "privacy-classes")
    grouped = rows.select(*upwards, "sensitive").groupBy(*[f"_q{i}" for i in range(len(ladders))], "sensitive").agg(F.count("*").alias("n"))
    grouped.write.parquet(path)
    base = spark.read.schema(grouped.schema).parquet(path)
    allowed = model.suppress * total
    found: list[Node] = []
    nodes = list(product(*[range(low, step.height + 1) for step, low in zip(ladders, lowest)]))
    for height in range(sum(lowest), sum(step.height for step in ladders) + 1):
        open_ = [n for n in nodes if sum(n) == height and not any(all(a >= b for a, b in zip(n, s.levels)) for s in found)]
        for at in range(0, len(open_), NODES_AT_ONCE):
            for r in _evaluate(base, lowest, open_[at:at + NODES_AT_ONCE], model):
                if r["small"] <= allowed:
                    loss = sum(x / step.height for x, step in zip(r["levels"], ladders)) / len(ladders)
                    found.append(Node(tuple(r["levels"]), loss, r["small"], r["classes"], r["smallest"], r["squares"]))
    return sorted(found, key=lambda n: (round(n.loss, 12), n.squares, n.levels))


def generalised(df: DataFrame, ladders: Sequence[Ladder], node: Node) -> DataFrame:
    """The table at the levels of a node, with all its columns."""
    return df.withColumns({step.attribute: at_level(df, step, level) for step, level in zip(ladders, node.levels)})


def anonymised(df: DataFrame, ladders: Sequence[Ladder], model: Model, sensitive: Column | None = None) -> DataFrame:
    """The table at the best safe levels; rows of classes that are too small go.

    The sensitive column is taken from `df` as given. Without any safe node no
    rows are left.
    """
    nodes = safe_nodes(df, ladders, model, sensitive)
    if not nodes:
        return df.limit(0)
    told = df.withColumn("_sensitive", F.lit("") if sensitive is None else sensitive.cast("string"))
    done = generalised(told, ladders, nodes[0])
    if not nodes[0].suppressed:
        return done.drop("_sensitive")
    names = [step.attribute for step in ladders]
    keyed = done.withColumn("_key", F.array(*[F.col(f"`{c}`").cast("string") for c in names]))
    counted = keyed.select(F.col("_key").alias("_small"), F.coalesce("_sensitive", F.lit("\0")).alias("sensitive"), F.lit(1).alias("n"))
    small = _classes(counted, ["_small"]).where(_unsafe(model)).select("_small")
    return keyed.join(small, F.col("_key") == F.col("_small"), "left_anti").drop("_key", "_sensitive")


def stored_model(policies: DataFrame, columns: Sequence[str]) -> tuple[list[Ladder], Model, str | None]:
    """The ladders, the model and the sensitive attribute that stored privacy settings ask for.

    Of each attribute the newest setting (largest id) counts. Quasi-identifiers
    have ladders; of several models the strictest values hold: parameters are
    ``{"k": 5, "l": 2, "suppress": 0.01}``. At most one row per column reaches
    the driver.
    """
    fields = ("attribute_name", "privacy_type", "hierarchy", "privacy_model_technique", "privacy_model_parameters")
    newest = policies.where(F.col("attribute_name").isin(list(columns))).groupBy("attribute_name").agg(F.max_by(F.struct(*fields), F.col("id")).alias("p"))
    rows = sorted(newest.select("p.*").collect(), key=lambda r: list(columns).index(r["attribute_name"]))
    ladders = [ladder(r["attribute_name"], r["hierarchy"]) for r in rows if r["privacy_type"] == "QUASI_IDENTIFIER"]
    asked = [json.loads(r["privacy_model_parameters"] or "{}") for r in rows if r["privacy_model_technique"]]
    model = Model(max((p.get("k", 1) for p in asked), default=1), max((p.get("l", 1) for p in asked), default=1), min((p.get("suppress", 0.0) for p in asked), default=0.0))
    return ladders, model, next((r["attribute_name"] for r in rows if r["privacy_type"] == "SENSITIVE"), None)


def apply_model(df: DataFrame, policies: DataFrame) -> DataFrame:
    """A source made safe as its stored privacy settings say."""
    ladders, model, sensitive = stored_model(policies, df.columns)
    return anonymised(df, ladders, model, None if sensitive is None else F.col(f"`{sensitive}`"))
