"""A search index: which rows have which three letters in which column.

``search_text`` reads all texts for each term. With an index a term is first cut
into runs of three letters; rows that have them all in one column are the only
ones whose texts are compared. A posting is a row of its own, never a list, so a
frequent run is as many rows as it has texts, spread over tasks. Each task writes
the postings of its own rows, in stretches sorted by gram: none cross the network,
and a search skips the pages of other grams in each stretch.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataquay.operators.catalog import search_text

GRAM = 3
#: Bits of a code point; three of them are a gram, as one number.
BITS = 21
#: Postings of one sorted stretch; a text's own are never parted.
STRETCH = 4_000_000


def _sorted_grams(texts: DataFrame, kind: str) -> DataFrame:
    """The distinct grams of each text, as rows (gram, key) in sorted stretches of bounded size.

    `texts` has a text and a key without null. A stretch has the rows of one Arrow
    batch at most, so that a task holds the same memory whatever the size of its input.
    """
    gram, bits, stretch = GRAM, BITS, STRETCH

    def distinct(text: str) -> np.ndarray:
        signs = np.frombuffer(text.encode("utf-32-le"), np.uint32).astype(np.int64)
        found = np.zeros(max(len(signs) - gram + 1, 0), np.int64)
        for i in range(gram if len(found) else 0):
            found = found << bits | signs[i : i + len(found)]
        found.sort()
        return found[np.diff(found, prepend=-1) != 0]

    def in_order(grams: list[np.ndarray], first: int, keys: pa.Array) -> pa.RecordBatch:
        rows = np.repeat(np.arange(first, first + len(grams)), [len(g) for g in grams])
        joined = np.concatenate(grams)
        order = np.argsort(joined)
        return pa.RecordBatch.from_arrays([pa.array(joined[order]), keys.take(pa.array(rows[order]))], ["gram", "key"])

    def stretches(batches):
        for batch in batches:
            grams, first, size = [], 0, 0
            for row, text in enumerate(batch.column(0)):
                grams.append(distinct(text.as_py()))
                size += len(grams[-1])
                if size >= stretch:
                    yield in_order(grams, first, batch.column(1))
                    grams, first, size = [], row + 1, 0
            if size:
                yield in_order(grams, first, batch.column(1))

    return texts.mapInArrow(stretches, f"gram long, key {kind}")


def gram_number(gram: str) -> int:
    """A gram as the postings have it: its code points, side by side."""
    number = 0
    for sign in gram:
        number = number << BITS | ord(sign)
    return number


def index_texts(df: DataFrame, key: str, columns: Sequence[str], path: str) -> None:
    """Write the postings (gram, place, key) of some text columns, in stretches sorted by gram.

    Texts are lower-cased as ILIKE does. Rows without a key, and texts shorter than
    three letters, have no postings: neither can be found by a run of three. A gram
    counts once in a text; several rows of a key have their own postings.
    """
    kind = df.select(F.col(f"`{key}`")).schema[0].dataType.simpleString()
    rows = []
    for place, name in enumerate(columns):
        texts = df.select(F.lower(F.col(f"`{name}`").cast("string")).alias("text"), F.col(f"`{key}`").alias("key"))
        grams = _sorted_grams(texts.where("text IS NOT NULL AND key IS NOT NULL"), kind)
        rows.append(grams.select("gram", F.lit(place).alias("place"), "key"))
    reduce(DataFrame.unionAll, rows).write.parquet(path)


def literal_runs(pattern: str) -> list[str]:
    """The stretches of a LIKE pattern without wildcards; a backslash makes the next sign plain."""
    runs, run, signs = [], "", iter(pattern)
    for sign in signs:
        if sign in "%_":
            runs.append(run)
            run = ""
        else:
            run += next(signs, "") if sign == "\\" else sign
    return [r for r in [*runs, run] if r]


def term_grams(spark: SparkSession, term: str) -> list[str]:
    """The distinct grams that a text must have to match a term."""
    lowered = spark.range(1).select(F.lower(F.lit(f"%{term}%"))).first()[0]
    return sorted({r[i : i + GRAM] for r in literal_runs(lowered) for i in range(len(r) - GRAM + 1)})


def search_indexed(df: DataFrame, term: str, key: str, columns: Sequence[str], path: str) -> DataFrame:
    """The rows of ``search_text(df, term, columns)`` by way of an index of these columns.

    Where a term has no three letters in a row, all texts are read, as without an
    index. The grams of a term are as many as its letters; postings of other grams
    are skipped by the sort of the stretches. Rows without a key are searched directly.
    """
    grams = term_grams(df.sparkSession, term)
    if not grams:
        return search_text(df, term, columns)
    postings = df.sparkSession.read.parquet(path).where(F.col("gram").isin([gram_number(g) for g in grams]))
    held = postings.groupBy("key", "place").agg(F.count_distinct("gram").alias("n")).where(F.col("n") == len(grams))
    candidates = held.select(F.col("key").alias("_key")).distinct()
    texts = search_text(df, term, columns)
    keyed = texts.join(candidates, F.col(f"`{key}`") == F.col("_key"), "left_semi")
    return keyed.unionByName(texts.where(F.col(f"`{key}`").isNull()))
