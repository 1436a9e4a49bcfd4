"""Importance resampling towards a target distribution, with an Aho-Corasick dictionary.

The distinct words of a slice of texts are the patterns of an automaton, each
between two delimiters, so that a word is never found inside another. A pattern
carries the CRC-32 and the byte length of its word. A text, its other signs
turned to delimiters, goes through the automaton once; what comes out is the
payload of each of its words in order. A feature is a run of words: its CRC
follows from the CRC and lengths of its neighbours alone, as a CRC of joined
strings is a linear function of theirs, so features are never spelled out.

Features fall into buckets by CRC. Two tables of bucket counts, of all documents
and of the target, give the gain of each bucket, and the mean gain of a
document's features is its weight. Gumbel noise that depends on the id turns
the highest scores into a weighted sample without replacement.
"""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections.abc import Iterable, Iterator
from operator import itemgetter

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataquay.llm.common import same, small, staged, whole_text

BUCKETS, MOST_WORDS, LEAST_WORDS, PERCENT, SEED = 10_000, 1, 20, 10, 2024
#: Characters of the texts that share a dictionary, about; a longer text has one of its own.
SLICE = 4_000_000
_INDEX_BITS = 33  # of monotonically_increasing_id

_NO_WORD = re.compile("[\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_LOWER = {k: k + 32 for k in range(65, 91)}
_POLYNOMIAL = 0xEDB88320


def delimited(text: str | None) -> str:
    """The words of a text, A-Z in lower case, with one blank before, between and behind them."""
    return f" {_NO_WORD.sub(' ', (text or '').translate(_LOWER)).strip(' ')} "


class Dictionary:
    """An automaton over words between blanks; per word, `crc`, `crc_behind` (of a blank and the word) and `size` in bytes."""

    def __init__(self, lines: Iterable[str]):
        words: set[str] = set()
        for line in lines:
            words.update(line.split(" "))
        words.discard("")
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_INTS)
        for place, word in enumerate(words):
            self.automaton.add_word(f" {word} ", place)
        self.automaton.make_automaton()
        raw = [w.encode("utf-8", "surrogatepass") for w in words]
        self.size = np.fromiter(map(len, raw), np.int64, len(raw))
        self.crc = np.fromiter(map(zlib.crc32, raw), np.uint32, len(raw))
        self.crc_behind = np.fromiter((zlib.crc32(w, zlib.crc32(b" ")) for w in raw), np.uint32, len(raw))

    def scan(self, line: str) -> np.ndarray:
        """The places of the words of a line, in order."""
        if not len(self.size):
            return np.zeros(0, np.int64)
        return np.fromiter(map(itemgetter(1), self.automaton.iter(line)), np.int64)


def _then(first: np.ndarray, second: np.ndarray) -> np.ndarray:
    """The operator that does `first`, then `second`; an operator is what becomes of each of the 32 bits."""
    return moved(first, np.broadcast_to(second, (32, 32)))


def moved(crc: np.ndarray, operators: np.ndarray) -> np.ndarray:
    """Each number under the operator in its row."""
    out = np.zeros(len(crc), np.uint32)
    for bit in range(32):
        out ^= np.where(crc >> np.uint32(bit) & np.uint32(1), operators[:, bit], np.uint32(0)).astype(np.uint32)
    return out


def zeros_behind(n: int) -> np.ndarray:
    """What `n` zero bytes behind a string do to its CRC, without the conditioning that cancels out."""
    step = np.array([(1 << k >> 1) ^ (_POLYNOMIAL if k == 0 else 0) for k in range(32)], np.uint32)  # one bit
    for _ in range(3):
        step = _then(step, step)
    done = np.array([1 << k for k in range(32)], np.uint32)
    while n:
        if n & 1:
            done = _then(done, step)
        step, n = _then(step, step), n >> 1
    return done


class Runs:
    """CRCs of runs of words from the payloads of neighbours."""

    def __init__(self, words: Dictionary, most: int):
        self.words, self.most = words, most
        if most > 1:
            sizes, self.kind = np.unique(words.size, return_inverse=True)
            self.operators = np.stack([zeros_behind(int(n) + 1) for n in sizes]) if len(sizes) else np.zeros((0, 32), np.uint32)

    def crcs(self, places: np.ndarray) -> np.ndarray:
        """Of all runs of 1 to `most` words."""
        found = [self.words.crc[places]]
        for length in range(2, min(self.most, len(places)) + 1):
            last = places[length - 1:]
            longer = moved(found[-1][:len(last)], self.operators[self.kind[last]]) ^ self.words.crc_behind[last]
            found.append(longer)
        return np.concatenate(found)


def _slices(texts: Iterable[str | None]) -> Iterator[list[str]]:
    lines, length = [], 0
    for text in texts:
        lines.append(delimited(text))
        length += len(lines[-1])
        if length >= SLICE:
            yield lines
            lines, length = [], 0
    if lines:
        yield lines


def _kind(buckets: int):
    return np.uint16 if buckets <= 1 << 16 else np.uint32


def text_features(texts: Iterable[str | None], buckets: int = BUCKETS, most: int = MOST_WORDS) -> Iterator[tuple[int, np.ndarray]]:
    """Per text the number of words and the buckets of its features, repeats counted."""
    for lines in _slices(texts):
        runs = Runs(Dictionary(lines), most)
        for line in lines:
            places = runs.words.scan(line)
            yield len(places), (runs.crcs(places) % np.uint32(buckets)).astype(_kind(buckets))


def features(rows: DataFrame, text_col: str, id_col: str | None, buckets: int = BUCKETS, most: int = MOST_WORDS) -> DataFrame:
    """A written table: doc_id (null without an id column), text_hash, n_words, n_features, features (bytes of the buckets)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, n_words, n_features, found, size = 0, [], [], [], 0

            def told() -> pa.RecordBatch:
                return pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(at, len(found)), batch.column("text_hash").slice(at, len(found)), pa.array(n_words, pa.int64()), pa.array(n_features, pa.int64()),
                    pa.array(found, pa.binary()),
                ], names=["doc_id", "text_hash", "n_words", "n_features", "features"])

            for words, of_text in text_features((t.as_py() for t in batch.column("text")), buckets, most):
                n_words.append(words)
                n_features.append(len(of_text))
                found.append(of_text.tobytes())
                size += len(found[-1])
                if size >= SLICE:
                    yield told()
                    at, n_words, n_features, found, size = at + len(found), [], [], [], 0
            yield told()

    named = F.lit(None) if id_col is None else F.col(id_col)
    text = whole_text(text_col)
    texts = rows.select(named.cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return staged(texts.mapInArrow(run, "doc_id long, text_hash long, n_words long, n_features long, features binary"), "resampling-features")


def bucket_counts(found: DataFrame, buckets: int = BUCKETS) -> list[int]:
    """How many features are in each bucket: a sum per task, then over tasks; as many numbers as buckets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for raw in batch.column("features"):
                total += np.bincount(np.frombuffer(raw.as_buffer(), _kind(buckets)), minlength=buckets)
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["bucket", "n"])

    rows = found.select("features").mapInArrow(run, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect()
    out = [0] * buckets
    for r in rows:
        out[r["bucket"]] = r["n"]
    return out


def gains(raw: list[int], target: list[int]) -> list[int]:
    """Per bucket 1000 times the logarithm of how much likelier a feature of the target falls there, smoothed by one, floored."""
    all_raw, all_target = float(sum(raw) + len(raw)), float(sum(target) + len(target))
    return [math.floor(1000 * math.log((t + 1) * all_raw / ((s + 1) * all_target))) for s, t in zip(raw, target)]


def noise(doc_id: int | None, seed: int) -> int:
    """Gumbel noise of an id, in thousandths, floored."""
    named = f"{seed}:{'' if doc_id is None else doc_id}".encode()
    uniform = (int(hashlib.sha256(named).hexdigest()[:8], 16) + 0.5) / 4294967296
    return math.floor(-1000 * math.log(-math.log(uniform)))


def scored(found: DataFrame, gain: list[int], seed: int = SEED) -> DataFrame:
    """doc_id, text_hash, n_words, n_features, weight, score of each row of features."""
    table = np.array(gain, np.int64)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            weights = []
            for raw in batch.column("features"):
                at = np.frombuffer(raw.as_buffer(), _kind(len(table)))
                weights.append(int(table[at].sum()) // len(at) if len(at) else 0)
            ids = batch.column("doc_id")
            scores = [w + noise(i, seed) for w, i in zip(weights, ids.to_pylist())]
            yield pa.RecordBatch.from_arrays([
                ids, batch.column("text_hash"), batch.column("n_words"), batch.column("n_features"), pa.array(weights, pa.int64()), pa.array(scores, pa.int64()),
            ], names=["doc_id", "text_hash", "n_words", "n_features", "weight", "score"])

    return found.mapInArrow(run, "doc_id long, text_hash long, n_words long, n_features long, weight long, score long")


def resample(
    docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", target_col: str = "text", buckets: int = BUCKETS,
    most: int = MOST_WORDS, least_words: int = LEAST_WORDS, percent: int = PERCENT, seed: int = SEED,
) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, n_words, n_features, weight, score, rank.

    Features are runs of 1 to `most` words. Of the rows with `least_words` words
    or more, `percent` of a hundred are drawn, those of the highest scores; equal
    scores go by id, null ids last, and repeated rows of one id have ranks in any
    order. Others have no rank. A null text has no words, and weighs 0 as any
    text without words; an empty target leaves smoothing alone. A null id draws
    the noise of an empty one. An empty table gives no rows.
    """
    found = features(docs, text_col, id_col, buckets, most)
    gain = gains(bucket_counts(found, buckets), bucket_counts(features(target, target_col, None, buckets, most), buckets))
    rows = staged(scored(found, gain, seed), "resampling-scores")
    order = ["minus", "no_id", "doc_id", "n_features"]
    entered = rows.where(F.col("n_words") >= least_words).withColumn("minus", -F.col("score")).withColumn("no_id", F.col("doc_id").isNull())
    # Places on the line come from a range sort: the place in a part, and the rows of the parts before it.
    line = entered.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("mid", F.monotonically_increasing_id())
    line = staged(line.withColumn("part", F.shiftright("mid", _INDEX_BITS)).withColumn("at", F.col("mid").bitwiseAND((1 << _INDEX_BITS) - 1)), "resampling-line")
    counts = line.groupBy("part").agg(F.count("*").alias("n"))
    # One row per part of the sort, whatever the data.
    parts = small(staged(counts.select(
        F.col("part").alias("o_part"), F.coalesce(F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"),
        F.sum("n").over(Window.partitionBy()).alias("total"),
    ), "resampling-parts"))
    place = F.col("before") + F.col("at")
    drawn = F.when(place < F.expr(f"{percent} * total div 100"), place + 1)
    columns = ["doc_id", "text_hash", "n_words", "n_features", "weight", "score"]
    ranked = line.join(parts, F.col("part") == F.col("o_part")).select(*columns, drawn.alias("rank"))
    return ranked.unionAll(rows.where(F.col("n_words") < least_words).select(*columns, F.lit(None).cast("long").alias("rank")))


def drawn(docs: DataFrame, target: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of `docs` that are drawn; a repeated row stays if one of its kind is."""
    ranked = resample(docs, target, id_col, text_col, **options).where("rank IS NOT NULL")
    ranked = staged(ranked.select(F.col("doc_id").alias("id"), "text_hash"), "resampling-drawn")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("of"), F.xxhash64(whole_text(text_col)).alias("hash"))
    return rows.join(ranked, same(F.col("of"), F.col("id")) & (F.col("hash") == F.col("text_hash")), "left_semi").select("row.*")
