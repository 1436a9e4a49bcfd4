"""Quality rules with adaptive thresholds.

Each rule compares a ratio of a document with a threshold learned for its
language and source. The sketch of a group is a histogram over a bounded number
of bins, whole numbers first and then ever wider ones: sketches of parts that
have no text in common merge by adding counts, in any order, and a quantile read
from it is off by one bin at most, or by one part in 2,048 of large numbers. A text counts
once in a group, however many copies it has there. Groups with few texts use
their language's sketch, small languages the sketch of all documents.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquay.llm.common import same, small, staged, tidied, whole_text

#: Base rules: least words, and most repeated words of a hundred.
LEAST_WORDS = 50
MOST_REPEATED = 50
#: Distinct texts that a group needs for thresholds of its own.
LEAST_GROUP = 100
#: A threshold is the median plus (less) SPREAD times the distance from it to the
#: nearer quartile, which counts as `floor` bins at least.
SPREAD = 8
#: (ratio, numerator, denominator, bins per unit, spread floor in bins, sides). A bin is the place of bins * numerator div denominator.
RULES = (
    ("symbols", "n_symbols", "n_words", 1000, 12, "high"),
    ("repeats", "n_repeat_words", "n_words", 200, 9, "high"),
    ("dup_lines", "n_dup_lines", "n_lines", 200, 12, "high"),
    ("word_length", "word_chars", "n_words", 100, 25, "both"),
    ("capitals", "n_capitals", "word_chars", 1000, 12, "high"),
)
#: Up to 2 ** PLACE_BITS each whole number is a bin; above, numbers that agree in their first PLACE_BITS bits
#: share one. A sketch has some 110,000 bins at most, whatever the ratios.
PLACE_BITS = 12
COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_capitals")
_WORD = re.compile(r"[^\x20\x09-\x0D]+")
_SYMBOL = re.compile(r"[#*$%&|<>]")
_CAPITAL = re.compile(r"[A-Z]+")


def _repeated(words: list[str]) -> int:
    """Words inside 3-word windows that the text has twice or more."""
    if len(words) < 4:
        return 0
    names: dict[str, int] = {}
    w = np.fromiter((names.setdefault(x, len(names)) for x in words), np.int64, len(words))
    _, pairs = np.unique(w[:-1] * len(names) + w[1:], return_inverse=True)
    _, which, counts = np.unique(pairs[:-1] * len(names) + w[2:], return_inverse=True, return_counts=True)
    twice = counts[which] > 1
    covered = np.zeros(len(words), bool)
    for k in range(3):
        covered[k:k + len(twice)] |= twice
    return int(covered.sum())


def count_text(text: str | None) -> tuple[int, ...]:
    """The counts of one whole text, in the order of COUNTS."""
    text = text or ""
    words = _WORD.findall(text)
    lines = [x for x in text.split("\n") if _WORD.search(x)]
    return (
        len(words), sum(map(len, words)), len(_SYMBOL.findall(text)), len(lines) - len(set(lines)),
        _repeated(words), len(lines), sum(map(len, _CAPITAL.findall(text))),
    )


def _counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [count_text(x.as_py()) for x in batch.column("text")]
        columns = [batch.column("row"), batch.column("text_hash"), *[pa.array([f[i] for f in found], pa.int64()) for i in range(len(COUNTS))]]
        yield pa.RecordBatch.from_arrays(columns, names=["row", "text_hash", *COUNTS])


def _text_counts(texts: pa.Array) -> pa.Array:
    found = [count_text(x.as_py()) for x in texts]
    return pa.StructArray.from_arrays([pa.array([f[i] for f in found], pa.int64()) for i in range(len(COUNTS))], names=list(COUNTS))


def with_counts(docs: DataFrame, text_col: str, keep: list[str]) -> DataFrame:
    """`row` (a struct of the columns in `keep`), a hash of the text and its counts."""
    text = whole_text(text_col)
    slim = docs.select(F.struct(*keep).alias("row"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    schema = f"row {slim.schema['row'].dataType.simpleString()}, text_hash long, " + ", ".join(f"{c} long" for c in COUNTS)
    return slim.mapInArrow(tidied(_counted), schema)


def _bin(top: str, bottom: str, bins: int) -> Column:
    value = F.expr(f"CASE WHEN {bottom} > 0 THEN {bins} * {top} div {bottom} ELSE 0L END")
    more = F.length(F.bin(value)) - PLACE_BITS
    shared = more * (1 << PLACE_BITS - 1) + F.call_function("shiftright", value, more)
    return F.when(value < 1 << PLACE_BITS, value).otherwise(shared).cast("long")


def sketches(counted: DataFrame) -> DataFrame:
    """The histogram sketch of each rule: level (2 language and source, 1 language, 0 all), lang, source, rule, bin, n (distinct texts)."""
    levels = counted.select(
        "lang", "source", "text_hash", *[_bin(*r[1:4]).alias(r[0]) for r in RULES],
        F.explode(F.array(*[F.lit(x) for x in (0, 1, 2)])).alias("level"),
    )
    # Copies of a text have the same bins.
    texts = levels.select(
        "level", F.when(F.col("level") > 0, F.col("lang")).alias("lang"),
        F.when(F.col("level") > 1, F.col("source")).alias("source"), "text_hash", *[r[0] for r in RULES],
    ).distinct()
    bins = F.explode(F.map_from_arrays(
        F.array(*[F.lit(r[0]) for r in RULES]), F.array(*[F.col(r[0]) for r in RULES]),
    )).alias("rule", "bin")
    return texts.select("level", "lang", "source", bins).groupBy("level", "lang", "source", "rule", "bin").agg(F.count("*").alias("n"))


def thresholds(sketch: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """Per level, language and source: a column `high_<rule>` or `low_<rule>` for each side of a rule.

    A quantile is the first bin at which the counts reach its share of all.
    Junk beyond one quartile leaves the nearer one where it is. Where junk is so
    much that the median is junk too, a group's threshold is no looser than that
    of the level above or the one that its own lower (upper) quartile and the
    twentieth beyond give, so a source that is unusual throughout keeps its own.
    """
    group = ["level", "lang", "source", "rule"]
    whole = Window.partitionBy(*group)
    steps = sketch.withColumn("upto", F.sum("n").over(whole.orderBy("bin"))).withColumn("total", F.sum("n").over(whole))
    quantile = lambda q: F.min(F.when(F.col("upto") * 20 >= F.col("total") * q, F.col("bin")))
    points = steps.where((F.col("total") >= least_group) | (F.col("level") == 0)).groupBy(*group).agg(
        *[quantile(q).alias(f"q{q}") for q in (1, 5, 10, 15, 19)],
    )
    floor = F.create_map(*[x for r in RULES for x in (F.lit(r[0]), F.lit(r[4]))])[F.col("rule")]
    beyond = lambda distance: SPREAD * F.greatest(distance, floor)
    near = F.least(F.col("q10") - F.col("q5"), F.col("q15") - F.col("q10"))
    own = staged(points.select(
        *group, (F.col("q10") + beyond(near)).alias("high"), (F.col("q10") - beyond(near)).alias("low"),
        (F.col("q5") + beyond(F.col("q5") - F.col("q1"))).alias("tail_high"),
        (F.col("q15") - beyond(F.col("q19") - F.col("q15"))).alias("tail_low"),
    ), "rule-points")
    of_all = own.where("level = 0").select(*group, "high", "low")
    bounded = lambda rows: rows.select(
        *group, F.least("high", F.greatest("up_high", "tail_high")).alias("high"),
        F.greatest("low", F.least("up_low", "tail_low")).alias("low"),
    )
    of_lang = bounded(own.where("level = 1").join(
        F.broadcast(of_all.select("rule", F.col("high").alias("up_high"), F.col("low").alias("up_low"))), "rule",
    ))
    above = of_lang.select(
        F.col("lang").alias("up_lang"), F.col("rule").alias("up_rule"), F.col("high").alias("up_high"), F.col("low").alias("up_low"),
    )
    of_source = bounded(own.where("level = 2").join(above, same(F.col("lang"), F.col("up_lang")) & (F.col("rule") == F.col("up_rule"))))
    fences = of_all.unionAll(of_lang).unionAll(of_source)
    sides = [(side, r[0]) for r in RULES for side in ("high", "low") if side == "high" or r[5] == "both"]
    return fences.groupBy(*group[:-1]).agg(*[
        F.max(F.when(F.col("rule") == rule, F.col(side))).alias(f"{side}_{rule}") for side, rule in sides
    ])


def judged(counted: DataFrame, least_group: int = LEAST_GROUP) -> DataFrame:
    """`counted` (with lang and source) with base_failed, broken (the broken adaptive rules) and kept."""
    fences = staged(thresholds(sketches(counted), least_group), "rule-thresholds")
    cuts = [c for c in fences.columns if c not in ("level", "lang", "source")]
    level = lambda k: small(fences.where(F.col("level") == k).select(
        F.col("lang").alias(f"lang_{k}"), F.col("source").alias(f"source_{k}"),
        F.struct(*cuts).alias(f"cuts_{k}"),
    ))
    joined = counted.join(level(2), same(F.col("lang"), F.col("lang_2")) & same(F.col("source"), F.col("source_2")), "left")
    joined = joined.join(level(1), same(F.col("lang"), F.col("lang_1")), "left")
    overall = fences.where("level = 0").first()  # one row, or none of an empty table
    rest = F.struct(*[F.lit(overall[c] if overall else None).cast("long").alias(c) for c in cuts])
    joined = joined.withColumn("cuts", F.coalesce("cuts_2", "cuts_1", rest))
    broken = []
    for rule, top, bottom, bins, _, sides in RULES:
        out = _bin(top, bottom, bins) > F.col(f"cuts.high_{rule}")
        if sides == "both":
            out = out | (_bin(top, bottom, bins) < F.col(f"cuts.low_{rule}"))
        broken.append(F.when(out, F.lit(rule)))
    joined = joined.withColumn("broken", F.array_compact(F.array(*broken))).withColumn(
        "base_failed", (F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words")),
    )
    return joined.withColumn("kept", ~F.col("base_failed") & (F.size("broken") == 0))


def judge(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source",
    least_group: int = LEAST_GROUP,
) -> DataFrame:
    """One row per row of `docs`: doc_id, the counts, base_failed, broken, kept.

    Texts are read once. A null text is empty and fails the base rule. A null
    language or source is a group of its own. An empty table gives no rows.
    """
    rows = with_counts(docs.select(
        F.col(id_col).alias("doc_id"), F.col(lang_col).cast("string").alias("lang"),
        F.col(source_col).cast("string").alias("source"), F.col(text_col).alias("text"),
    ), "text", ["doc_id", "lang", "source"])
    counted = staged(rows.select("row.*", "text_hash", *COUNTS), "rule-counts")
    return judged(counted, least_group).select("doc_id", *COUNTS, "base_failed", "broken", "kept")


def keep_good(
    docs: DataFrame, text_col: str = "text", lang_col: str = "lang", source_col: str = "source", least_group: int = LEAST_GROUP,
) -> DataFrame:
    """The rows of `docs` that pass, with its columns. The thresholds are learned in a first pass over all rows.

    Only texts go to Python; the rows wait beside it.
    """
    text = whole_text(text_col)
    counted = docs.select(
        F.struct("*").alias("row"), F.col(lang_col).cast("string").alias("lang"), F.col(source_col).cast("string").alias("source"),
        F.xxhash64(text).alias("text_hash"), F.arrow_udf(_text_counts, T.StructType([T.StructField(c, T.LongType()) for c in COUNTS]))(text).alias("counts"),
    ).select("row", "lang", "source", "text_hash", "counts.*")
    return judged(counted, least_group).where("kept").select("row.*")
