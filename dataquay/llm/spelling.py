"""Spelling variants by a scan of the sorted vocabulary.

Words that are one edit apart share at least half of the shorter one as a prefix
or as a suffix, rounded down: the edit is in one half only. So each word is
listed under its half prefix and, read backwards, under its half suffix, once
for its own length and once for pairs with a word shorter by one. A list is
sorted; going through it, a word keeps the rows of the edit matrix that it has
in common with the word before (their longest common prefix), and only its other
signs add rows. The matrix is held for all queries of the list at once, as a
band: the queries are the shorter words, so of a row only the cell on the
diagonal and the one before it can still end at one edit. A row keeps the
queries that have a cell of at most one; where none is left, the range of words
that share that prefix is skipped.

Lists are short, as half a word tells most words apart. A list that isn't is cut
into blocks by hash: a task takes the queries of one block through the sorted
words of another.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquay.llm.common import staged, whole_text

#: Lower-case here means A-Z alone.
RUN = r"[A-Za-zÀ-ÿ]+"
LEAST_SIGNS, LEAST_COUNT, FORM_FACTOR = 6, 5, 5
#: One run in so many loses a sign; 0 turns that off.
TYPO_IN = 199
#: Words of a list from which it is cut into blocks.
BLOCK = 20_000


def _runs(text: Column) -> Column:
    lower = F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    return F.explode(F.regexp_extract_all(lower, F.lit(RUN), F.lit(0)))


def word_counts(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_in: int = TYPO_IN,
    least_signs: int = LEAST_SIGNS, least_count: int = LEAST_COUNT,
) -> DataFrame:
    """word and n of the words with so many signs and occurrences at least; null texts have none.

    With `typo_in`, a run whose CRC with its document's id is divisible by it
    loses one sign first. A null id counts as an empty one.
    """
    named = F.concat(F.coalesce(F.col(id_col).cast("string"), F.lit("")), F.lit(":"))
    runs = docs.select(named.alias("named"), _runs(whole_text(text_col)).alias("run")).where(F.char_length("run") >= least_signs)
    word = F.col("run")
    if typo_in:
        crc = F.crc32(F.concat("named", "run").cast("binary"))
        at = (crc % F.char_length("run")).cast("int")
        shorter = F.concat(F.substring("run", F.lit(1), at), F.substring("run", at + 2, F.char_length("run")))
        word = F.when(crc % typo_in == 0, shorter).otherwise(word)
    counted = runs.select(word.alias("word")).where(F.char_length("word") >= least_signs).groupBy("word").agg(F.count("*").alias("n"))
    return counted.where(F.col("n") >= least_count)


def _listed(words: DataFrame) -> DataFrame:
    """Rows (key, rest, word, n, asks, listed, back) in order of key, a cell of a list: (length, backwards, half, query block, word block)."""
    signs = F.char_length("word")
    shorter = F.explode(F.array(signs, signs - 1)).alias("shorter")
    ways = F.explode(F.array(F.struct(F.lit(False).alias("back"), F.col("word").alias("line")), F.struct(F.lit(True).alias("back"), F.reverse("word").alias("line"))))
    rows = words.select("word", "n", shorter).select("word", "n", "shorter", ways.alias("way"))
    half = (F.col("shorter") / 2).cast("int")
    rows = rows.select(
        "word", "n", "shorter", F.col("way.back").alias("back"), F.substring(F.col("way.line"), F.lit(1), half).alias("half"),
        F.substring(F.col("way.line"), half + 1, F.char_length("way.line")).alias("rest"), (F.char_length("word") == F.col("shorter")).alias("asks"),
    )
    group = ["shorter", "back", "half"]
    sized = staged(rows.groupBy(*group).agg(F.count("*").alias("size"), F.count_if("asks").alias("queries")).where("size > 1 AND queries > 0"), "spelling-lists")
    rows = rows.join(sized, group).withColumn("blocks", F.ceil(F.col("size") / BLOCK).cast("int"))
    mine = F.pmod(F.xxhash64("word"), F.col("blocks")).cast("int")
    every = F.sequence(F.lit(0), F.col("blocks") - 1)
    # A word asks the words of every block, and is asked by the queries of every block.
    cells = rows.withColumn("mine", mine).withColumn("other", F.explode(every)).withColumn("part", F.explode(F.array(
        F.struct(F.col("mine").alias("q"), F.col("other").alias("w"), F.col("asks").alias("asks"), (F.col("mine") == F.col("other")).alias("listed")),
        F.struct(F.col("other").alias("q"), F.col("mine").alias("w"), F.lit(False).alias("asks"), (F.col("mine") != F.col("other")).alias("listed")),
    ))).where("part.asks OR part.listed")
    key = F.struct(*group, F.col("part.q").alias("q"), F.col("part.w").alias("w"))
    dealt = cells.select(key.alias("key"), "rest", "word", "n", F.col("part.asks").alias("asks"), F.col("part.listed").alias("listed"))
    dealt = dealt.repartition("key").sortWithinPartitions("key", "rest")
    return dealt.select(F.xxhash64("key").alias("key"), "rest", "word", "n", "asks", "listed", F.col("key.back").alias("back"))


def _signs(lines: list[str], width: int) -> np.ndarray:
    """One row of code points per line, filled up with zeros."""
    out = np.zeros((len(lines), width), np.uint32)
    for row, line in enumerate(lines):
        out[row, :len(line)] = np.frombuffer(line.encode("utf-32-le", "surrogatepass"), "<u4")
    return out


def common_prefix(a: str, b: str) -> int:
    n = min(len(a), len(b))
    for k in range(n):
        if a[k] != b[k]:
            return k
    return n


def near_in_list(queries: list[str], lines: list[str]) -> list[tuple[int, int]]:
    """(query, line) indices one edit apart or equal.

    Queries have one length; lines are sorted, of the same length or longer by one.
    """
    if not queries or not lines:
        return []
    size = len(queries[0])
    asked = _signs(queries, size + 2)  # column k: sign k + 1, and none behind the last
    found = []
    # Per depth: the queries that are left, the cell before the diagonal, the diagonal.
    live = [np.arange(len(queries))]
    before, diagonal = [np.full(len(queries), 2, np.uint8)], [np.zeros(len(queries), np.uint8)]
    last, dead = "", None
    for place, line in enumerate(lines):
        shared = common_prefix(last, line)
        last = line
        if dead is not None and shared >= dead:
            continue
        dead = None
        # Rows behind the shared prefix are of another word.
        depth = min(shared, len(live) - 1)
        del live[depth + 1:], before[depth + 1:], diagonal[depth + 1:]
        for k in range(depth, len(line)):
            left, sign = live[k], ord(line[k])
            one = np.minimum(before[k] + (asked[left, k - 1] != sign), diagonal[k] + 1) if k else np.ones(len(left), np.uint8)
            two = diagonal[k] + (asked[left, k] != sign)
            keep = np.minimum(one, two) <= 1
            if not keep.all():
                left, one, two = left[keep], one[keep], two[keep]
            if not len(left):
                dead = k + 1
                break
            live.append(left)
            before.append(one)
            diagonal.append(two)
        else:
            end = diagonal[-1] if len(line) == size else before[-1]
            found += [(q, place) for q in live[-1][end <= 1].tolist()]
    return found


def _near(rows: DataFrame) -> DataFrame:
    """Each pair of near words once: a, n_a, b, n_b."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held = None, []

        def pairs() -> list[tuple]:
            queries, lines = [r for r in held if r[3]], [r for r in held if r[4]]
            out = []
            for i, j in near_in_list([r[0] for r in queries], [r[0] for r in lines]):
                a, b = queries[i], lines[j]
                if len(a[1]) == len(b[1]) and a[1] >= b[1]:
                    continue  # both ask
                half = len(a[1]) // 2
                if a[5] and a[1][:half] == b[1][:half]:
                    continue  # found by the prefix too
                out.append((a[1], a[2], b[1], b[2]))
            return out

        def told(out: list[tuple]) -> pa.RecordBatch:
            a, n_a, b, n_b = zip(*out) if out else ((), (), (), ())
            return pa.RecordBatch.from_arrays([pa.array(a, pa.string()), pa.array(n_a, pa.int64()), pa.array(b, pa.string()), pa.array(n_b, pa.int64())], names=["a", "n_a", "b", "n_b"])

        out = []
        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("key", "rest", "word", "n", "asks", "listed", "back"))):
                if r[0] != key:
                    out += pairs()
                    key, held = r[0], []
                    if len(out) >= 10_000:
                        yield told(out)
                        out = []
                held.append(r[1:])
        yield told(out + pairs())

    return rows.mapInArrow(run, "a string, n_a long, b string, n_b long")


def _roots(forms: DataFrame) -> DataFrame:
    """word and root of rows (word, form): steps to the end of the chain, twice as long in each round.

    A form is five times as frequent as its word, so chains are short, and never return.
    """
    chains = staged(forms.select("word", F.col("form").alias("root")), "spelling-chains")
    while True:
        further = chains.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = staged(chains.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "spelling-chains")
        chains = step.select("word", "root")
        if step.where("moved").isEmpty():
            return chains


def variants(words: DataFrame, form_factor: int = FORM_FACTOR) -> DataFrame:
    """Per row (word, n) of distinct words: word, form, root, n, n_near, form_n.

    The form is the most frequent of the words one insertion, deletion or
    replacement away (of equal ones the first by code points) if it is
    `form_factor` times as frequent; the root is where forms lead to. Words
    differ by case and accent. A null word is left out. No rows give no rows.
    """
    words = staged(words.where("word IS NOT NULL").select("word", F.col("n").cast("long").alias("n")), "spelling-words")
    pairs = staged(_near(_listed(words)), "spelling-pairs")
    both = pairs.select(F.col("a").alias("word"), F.struct((-F.col("n_b")).alias("minus"), F.col("b").alias("other")).alias("other")).unionAll(
        pairs.select(F.col("b").alias("word"), F.struct((-F.col("n_a")).alias("minus"), F.col("a").alias("other")).alias("other")))
    best = both.groupBy("word").agg(F.count("*").alias("n_near"), F.min("other").alias("best"))
    enough = -F.col("best.minus") >= form_factor * F.col("n")
    joined = staged(words.join(best, "word", "left").select(
        "word", "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(enough, F.col("best.other")).alias("form"), F.when(enough, -F.col("best.minus")).alias("form_n"),
    ), "spelling-forms")
    roots = _roots(joined.where("form IS NOT NULL"))
    return joined.join(roots, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_in: int = TYPO_IN) -> DataFrame:
    """The variants among the words of `docs`. Null and empty texts have no words, and an empty table gives no rows."""
    return variants(word_counts(docs, id_col, text_col, typo_in))
