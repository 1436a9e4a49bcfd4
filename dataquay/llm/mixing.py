"""Mixing sources to target weights, in DataFrame functions only.

Words are summed per source; targets are shares of a budget by weight, each at
most a multiple of its source, the excess shared again. A source's rate is its
target over its size, and a document is taken floor(rate) times, plus once
more if a hash of its id, read as a uniform number, is below the fraction.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataquay.llm.common import count_words, same, small, staged, uniform

WEIGHTS = (3, 1, 2)
BUDGET = 1.5
MOST = 2


def source_targets(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget: float = BUDGET, most: int = MOST,
    source_col: str = "source", size: Column | None = None,
) -> DataFrame:
    """Per source: source, source_size, weight, target.

    Sources in order of code points, null last, take the weights in turn. The
    shared budget is `budget` times all sizes. Sharing the excess again until
    no target is above `most` times its source ends at
    ``min(most * size, level * weight)``; the level follows from prefix sums
    over sources in order of cap per weight. These windows see one row per
    source. Sources without words get 0.
    """
    sizes = docs.groupBy(F.col(source_col).cast("string").alias("source")).agg(
        F.sum(count_words() if size is None else size).alias("source_size"),
    )
    turn = (F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1) % len(weights)
    weight = F.element_at(F.array(*[F.lit(w) for w in weights]), turn + 1)
    shares = sizes.withColumn("weight", weight).withColumn("cap", F.col("source_size") * most)
    shares = shares.withColumn("per_weight", F.col("cap") / F.col("weight"))
    by_cap = Window.orderBy("per_weight", F.col("source").asc_nulls_last())
    before, rest = by_cap.rowsBetween(Window.unboundedPreceding, -1), by_cap.rowsBetween(0, Window.unboundedFollowing)
    everything = Window.partitionBy()
    total = F.sum("source_size").over(everything) * F.lit(float(budget))
    capped = F.coalesce(F.sum("cap").over(before), F.lit(0))
    shares = shares.withColumn("level", (total - capped) / F.sum("weight").over(rest))
    # The first source that its level doesn't fill sets the level; later ones only fall.
    level = F.max(F.when(F.col("level") <= F.col("per_weight"), F.col("level"))).over(everything)
    shares = shares.withColumn("level", F.coalesce(level, F.lit(float("inf"))))
    return shares.select(
        "source", "source_size", "weight",
        F.least(F.col("cap").cast("double"), F.col("level") * F.col("weight")).alias("target"),
    )


def with_copies(docs: DataFrame, targets: DataFrame, seed: str = "mix", id_col: str = "doc_id", source_col: str = "source") -> DataFrame:
    """`docs` as a struct `row`, with source_size, target and `copies`, how often the mix takes it."""
    rows = docs.select(F.struct("*").alias("row"), F.col(source_col).cast("string").alias("of"), uniform(seed, F.col(id_col)).alias("u"))
    joined = rows.join(targets, same(F.col("of"), F.col("source")))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    copies = F.floor(rate) + F.when(F.col("u") < rate - F.floor(rate), 1).otherwise(0)
    return joined.select("row", "source_size", "target", copies.cast("long").alias("copies"))


def mix(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """The mixture: rows of `docs`, each as often as it is taken, with the columns of `docs`.

    Null texts have no words, null sources form a source. Rows of one id draw
    alike, so reruns agree. An empty table gives an empty mixture.
    """
    targets = small(staged(source_targets(docs, source_col=source_col, size=count_words(text_col), **shares), "mix-targets"))
    taken = with_copies(docs, targets, seed, id_col, source_col).where("copies > 0")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), F.col("copies").cast("int"))).alias("nth")).select("row.*")


def mix_plan(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **shares) -> DataFrame:
    """What the mix takes of each row: doc_id, size, source_size, target, copies, taken. Texts are read once."""
    sizes = staged(docs.select(
        F.col(id_col).alias("doc_id"), F.col(source_col).cast("string").alias("source"), count_words(text_col).alias("size"),
    ), "mix-sizes")
    targets = small(staged(source_targets(sizes, size=F.col("size"), **shares), "mix-targets"))
    plan = with_copies(sizes, targets, seed)
    return plan.select(
        "row.doc_id", "row.size", "source_size", "target", "copies", (F.col("row.size") * F.col("copies")).alias("taken"),
    )
