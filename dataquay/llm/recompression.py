"""Substring dedup by recompression.

Words are renamed in rounds. In a round each symbol is a left or a right one by
a bit of its name; a left symbol and the right one after it become a pair, and
neighbours left over that are equal become a run. Names are hashes of what they
stand for, so they are the same in the whole corpus without a table. Equal
passages get equal symbols but near their ends, and every symbol knows the
words that its making depends on.

A window of words is anchored at the symbol with the most text, of those that
depend on words inside the window alone. So equal windows have equal anchors,
and an anchor that one document alone has is in no repeat. The neighbouring
windows of one anchor are a stretch, at most as many as words in a window, so
that its first and last window hold all its words and name it.

Shared anchors are settled by stretches. The document of the smallest id that has
an anchor is the first owner of its stretches: wherever one of them occurs again,
all of its windows are repeats, and none can be of an earlier document. Only
where a stretch of the first owner doesn't come again whole, as at the ends of a
passage, are single windows compared, one copy of each distinct stretch of the
anchor, by 96 bits of their words.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.llm.common import same, staged, tidied, whole_text
from dataquay.llm.hashing import mixed, runs, word_hashes

#: More rounds give longer symbols, of which fewer lie inside a window, and more anchors in a text.
WINDOW, LEVELS = 13, 2
#: Bytes of words from which a symbol is as rare as another.
RARE_BYTES = 24
#: Bits of an anchor's name: enough to filter by; windows are compared by 96.
ANCHOR_BITS = 48
#: Bytes of texts that a task lays end to end at a time; a longer text is laid alone.
PORTION = 1_000_000
#: A place is where a stretch begins, and in its lowest bits how many windows it has.
SIZE_BITS = 8
_FAR = 1 << 40
_A, _B, _C = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)


class Symbols(NamedTuple):
    """Names; the words [start, end) each stands for; the words [low, high) its making depends on; walls between texts."""

    name: np.ndarray
    start: np.ndarray
    end: np.ndarray
    low: np.ndarray
    high: np.ndarray
    wall: np.ndarray


class Laid(NamedTuple):
    """Words of several texts end to end, a wall before and after each; where each text begins, and its words."""

    hashes: np.ndarray
    upto: np.ndarray  # bytes of all words before a place
    wall: np.ndarray
    begin: np.ndarray
    count: np.ndarray


def lay(texts: list[bytes]) -> Laid:
    found, sizes, count = word_hashes(texts)
    begin = np.cumsum(count + 1) - count
    places = int(count.sum()) + len(texts) + 1
    hashes, size, wall = np.zeros(places, np.uint64), np.zeros(places, np.int64), np.zeros(places, bool)
    wall[begin - 1] = wall[-1] = True
    hashes[~wall], size[~wall] = found, sizes
    return Laid(hashes, np.append(0, np.cumsum(size)), wall, begin, count)


def words_as_symbols(laid: Laid) -> Symbols:
    at = np.arange(len(laid.hashes), dtype=np.int64)
    # What depends on a wall depends on what may follow the text elsewhere: no window has that inside.
    return Symbols(laid.hashes, at, at + 1, np.where(laid.wall, -_FAR, at), np.where(laid.wall, _FAR, at + 1), laid.wall)


def _beside(values: np.ndarray, at: np.ndarray, outside: int) -> np.ndarray:
    """values[at], or `outside` beyond the ends."""
    inside = (at >= 0) & (at < len(values))
    return np.where(inside, values[np.clip(at, 0, len(values) - 1)], outside)


def compress(s: Symbols, round_: int) -> tuple[Symbols, np.ndarray]:
    """One round: the renamed symbols, and which of them are new."""
    n = len(s.name)
    right = (mixed(s.name + np.uint64(round_) * _C) & np.uint64(1)).astype(bool)
    first, second, equal = (np.zeros(n + 1, bool) for _ in range(3))
    first[:n - 1] = ~right[:-1] & right[1:] & ~s.wall[:-1] & ~s.wall[1:]
    second[1:n] = first[:n - 1]
    equal[1:n] = (s.name[1:] == s.name[:-1]) & ~s.wall[1:] & ~s.wall[:-1]  # to the one before
    single = ~first & ~second
    again = np.zeros(n, bool)  # goes on the run of the symbol before
    again[1:] = single[1:n] & single[:n - 1] & equal[1:n]
    head = np.flatnonzero(~second[:n] & ~again)
    length = np.diff(np.append(head, n))
    last = head + length - 1
    pair = first[head]
    run = ~pair & (length > 1)
    name = s.name[head]
    name[pair] = mixed(s.name[head[pair]] * _A + s.name[last[pair]] * _B + np.uint64(2))
    name[run] = mixed(s.name[head[run]] * _B + length[run].astype(np.uint64) * _A + np.uint64(3))
    # A pair depends on its two symbols. What is not paired depends on its neighbours, and if
    # one of them has the same name, on why it isn't in the run: on the neighbour's neighbour.
    low, high = np.minimum.reduceat(s.low, head), np.maximum.reduceat(s.high, head)
    alone = np.flatnonzero(~pair)
    h, t = head[alone], last[alone]
    before, after = _beside(s.low, h - 1, -_FAR), _beside(s.high, t + 1, _FAR)
    before = np.where(equal[h], np.minimum(before, _beside(s.low, h - 2, -_FAR)), before)
    after = np.where(equal[t + 1], np.maximum(after, _beside(s.high, t + 2, _FAR)), after)
    low[alone] = np.minimum(low[alone], before)
    high[alone] = np.maximum(high[alone], after)
    return Symbols(name, s.start[head], s.end[last], low, high, s.wall[head]), pair | run


def anchors(laid: Laid, window: int = WINDOW, levels: int = LEVELS) -> np.ndarray:
    """For each place the name of the anchor of the window that starts there; of windows over a wall, any number.

    The anchor is the symbol with the most bytes of those that depend on words of
    the window alone, for which RARE_BYTES are enough, and of equals the one with
    the largest name. Every window has one, as words are symbols too.
    """
    n = len(laid.hashes)
    s = words_as_symbols(laid)
    made = [s]
    for round_ in range(levels):
        s, new = compress(s, round_)
        inside = new & (s.high - s.low <= window)
        made.append(Symbols(*(x[inside] for x in s)))
    name, start, end, low, high, wall = (np.concatenate([m[i] for m in made]) for i in range(6))
    order = np.lexsort((name, np.minimum(laid.upto[end] - laid.upto[start], RARE_BYTES)))
    name, low, high, wall = name[order], low[order], high[order], wall[order]
    # A symbol serves the windows from high - window to low. Each such stretch is covered by two
    # blocks of 2**k places; a block's best is then handed down to its halves.
    from_, to = np.maximum(high - window, 0), low
    usable = np.flatnonzero(~wall & (to >= 0))
    from_, to = from_[usable], to[usable]
    size = np.frexp(to - from_ + 1)[1] - 1
    best = np.full(n, -1, np.int64)
    for k in range(int(size.max(initial=0)), -1, -1):
        block = 1 << k
        of = np.flatnonzero(size == k)
        for at in (from_[of], to[of] - block + 1):
            top = np.full(n, -1, np.int64)
            top[at] = usable[of]  # symbols ascend, so the last for a place is the best
            np.maximum(best, top, out=best)
        if k:
            half = block >> 1
            best[half:] = np.maximum(best[half:], best[:-half])
    return name[np.maximum(best, 0)] >> np.uint64(64 - ANCHOR_BITS)


def window_places(laid: Laid, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """Where windows start, and in which text."""
    windows = np.maximum(laid.count - window + 1, 0)
    text = np.repeat(np.arange(len(windows)), windows)
    return laid.begin[text] + np.arange(len(text)) - np.repeat(np.cumsum(windows) - windows, windows), text


def window_names(laid: Laid, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """96 bits of the words of the window at each place, as two numbers."""
    return runs(laid.hashes, window, 1).view(np.int64), (runs(laid.hashes, window, 2) >> np.uint64(32)).astype(np.uint32).view(np.int32)


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Rows and their texts, some PORTION bytes at a time."""
    for batch in batches:
        texts: list[bytes] = []
        begin, size = 0, 0
        for i, text in enumerate(batch.column("text")):
            texts.append(text.as_buffer().to_pybytes())
            size += len(texts[-1])
            if size >= PORTION:
                yield batch.slice(begin, i + 1 - begin), texts
                texts, begin, size = [], i + 1, 0
        if texts:
            yield batch.slice(begin), texts


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


def _stretches_of(laid: Laid, window: int, levels: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Neighbouring windows of one anchor: text, anchor, place of the first in its text, how many."""
    places, text = window_places(laid, window)
    name = anchors(laid, window, levels)[places].astype(np.int64)
    change = np.ones(len(name), bool)
    change[1:] = (name[1:] != name[:-1]) | (text[1:] != text[:-1])
    at = np.arange(len(name))
    since = at - np.maximum.accumulate(np.where(change, at, 0))
    first = np.flatnonzero(since % window == 0)
    return text[first], name[first], places[first] - laid.begin[text[first]], np.diff(np.append(first, len(name)))


def _lists(values: np.ndarray, text: np.ndarray, texts: int) -> pa.ListArray:
    ends = np.append(0, np.cumsum(np.bincount(text, minlength=texts))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(values))


def _measured(window: int, levels: int):
    """Per text its words, their digest, and its stretches."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _portions(batches):
            laid = lay(texts)
            text, name, start, size = _stretches_of(laid, window, levels)
            yield pa.RecordBatch.from_arrays([
                rows.column("doc_id"), rows.column("text_hash"), pa.array(laid.count),
                pa.array([hashlib.sha256(b" ".join(text.split())).digest() for text in texts], pa.binary()),
                _lists(name, text, len(texts)), _lists(start << SIZE_BITS | size, text, len(texts)),
            ], names=["doc_id", "text_hash", "n_words", "sha", "anchors", "places"])

    return run


def _listed(rows: pa.RecordBatch, laid: Laid, *columns: str) -> tuple[np.ndarray, ...]:
    """The text of each listed stretch, where it begins among the laid words, its size, and other columns of its list."""
    lists = [rows.column(c) for c in ("places", *columns)]
    text = np.repeat(np.arange(rows.num_rows), lists[0].value_lengths().to_numpy(zero_copy_only=False))
    place, *values = (x.flatten().to_numpy(zero_copy_only=False) for x in lists)
    return text, laid.begin[text] + (place >> SIZE_BITS), place & ((1 << SIZE_BITS) - 1), *values


def _named(window: int):
    """The stretches of candidates, named by their first and last window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _portions(batches):
            laid = lay(texts)
            one, two = window_names(laid, window)
            text, place, size, anchor, least = _listed(rows, laid, "anchors", "leasts")
            last = place + size - 1
            first = mixed(one[place].view(np.uint64) * _A + one[last].view(np.uint64) * _B + size.astype(np.uint64))
            second = (mixed(two[place].astype(np.uint64) * _A + two[last].astype(np.uint64) * _B) >> np.uint64(32)).astype(np.uint32)
            ids, candidates = (rows.column(c).to_numpy(zero_copy_only=False)[text] for c in ("doc_id", "candidate"))
            yield pa.RecordBatch.from_arrays([
                pa.array(anchor), pa.array(first.view(np.int64)), pa.array(second.view(np.int32)), pa.array(least), pa.array(ids),
                pa.array(candidates), pa.array((place - laid.begin[text]) << SIZE_BITS | size),
            ], names=["anchor", "one", "two", "least", "doc_id", "candidate", "place"])

    return run


def _windows(window: int):
    """The windows of stretches: two names, the stretch's first owner, and a tag: kind, place in the stretch, whether it is open."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in _portions(batches):
            laid = lay(texts)
            one, two = window_names(laid, window)
            _, place, size, tag, first = _listed(rows, laid, "tags", "firsts")
            of = np.repeat(np.arange(len(place)), size)
            nth = np.arange(len(of)) - np.repeat(np.cumsum(size) - size, size)
            at = place[of] + nth
            yield pa.RecordBatch.from_arrays([
                pa.array(one[at]), pa.array(two[at]), pa.array(first[of]), pa.array(tag[of] + (nth << 1)),
            ], names=["one", "two", "first", "tag"])

    return run


def _cut(window: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, sha = [], []
            texts = []
            for text, places in zip(batch.column("text"), batch.column("places")):
                words = text.as_buffer().to_pybytes().split()
                gone = np.zeros(len(words) + 1, np.int64)
                places = places.values.to_numpy(zero_copy_only=False)
                at, windows = places >> SIZE_BITS, places & ((1 << SIZE_BITS) - 1)
                np.add.at(gone, at, 1)
                np.add.at(gone, at + windows - 1 + window, -1)
                covered = np.cumsum(gone[:-1]) > 0
                kept = b" ".join([words[i] for i in np.flatnonzero(~covered)])
                n.append(int(covered.sum()))
                sha.append(hashlib.sha256(kept).digest())
                texts.append(kept.decode("utf-8", "surrogatepass"))
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_hash"), pa.array(n, pa.int64()), pa.array(sha, pa.binary()), pa.array(texts, pa.string()),
            ], names=["doc_id", "text_hash", "n_removed", "kept_sha", "kept_text"])

    return run


def repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, levels: int = LEVELS) -> tuple[DataFrame, DataFrame]:
    """What is removed: (rows, changed).

    rows, one per row of `docs`: doc_id, text_hash, n_words, sha (of its words
    joined by blanks), copy (a smaller id has the same words). changed, one per
    (doc_id, text_hash) that loses some words and is no copy: n_removed,
    kept_sha, kept_text.

    A word goes if a window over it also starts in a document of a smaller id.
    Copies with a whole window go altogether, and their windows are neither
    looked up nor found, since those of the smallest id are. Rows without an id
    neither lose words nor cost others any; rows with one id count as one
    document; null texts and texts shorter than a window lose nothing.
    """
    texts = _texts(docs, id_col, text_col)
    measured = staged(texts.mapInArrow(
        tidied(_measured(window, levels)),
        "doc_id long, text_hash long, n_words long, sha binary, anchors array<long>, places array<long>",
    ).withColumn("row_id", F.monotonically_increasing_id()), "repeat-anchors")
    slim = measured.drop("anchors", "places")
    least = slim.where("doc_id IS NOT NULL").groupBy("sha").agg(F.min("doc_id").alias("least"))
    rows = staged(slim.join(least, "sha", "left").withColumn("copy", F.coalesce(F.col("doc_id") > F.col("least"), F.lit(False))).drop("least"), "repeat-copies")
    named = measured.where("doc_id IS NOT NULL")
    originals = named.join(rows.where("copy").select("row_id"), "row_id", "left_anti").select("doc_id", F.explode("anchors").alias("anchor"))
    shared = staged(originals.groupBy("anchor").agg(F.min("doc_id").alias("least"), F.max("doc_id").alias("most")).where("least < most").drop("most"), "repeat-shared")
    each = named.select("row_id", F.explode(F.arrays_zip("anchors", "places")).alias("s")).select("row_id", F.col("s.anchors").alias("anchor"), F.col("s.places").alias("place"))
    lists = each.join(shared, "anchor").groupBy("row_id").agg(F.collect_list(F.struct("place", "anchor", "least")).alias("found"))
    return rows.drop("row_id"), _settled(texts, lists.join(rows.where("NOT copy").select("row_id", "doc_id", "text_hash"), "row_id"), window)


def _settled(texts: DataFrame, lists: DataFrame, window: int) -> DataFrame:
    """The texts that change, from the stretches of shared anchors that each has."""
    lists = lists.dropDuplicates(["doc_id", "text_hash"])  # repeated rows
    lists = lists.select(F.col("doc_id").alias("l_id"), F.col("text_hash").alias("l_hash"), *[F.col(f"found.{c}").alias(f"{c}s") for c in ("place", "anchor", "least")])
    candidates = texts.join(lists, (F.col("doc_id") == F.col("l_id")) & (F.col("text_hash") == F.col("l_hash"))).drop("l_id", "l_hash")
    candidates = staged(candidates.withColumn("candidate", F.monotonically_increasing_id()), "repeat-candidates")
    stretches = staged(candidates.drop("text_hash").mapInArrow(
        tidied(_named(window)), "anchor long, one long, two int, least long, doc_id long, candidate long, place long",
    ), "repeat-stretches")
    name = ["anchor", "one", "two"]
    kinds = stretches.groupBy(*name).agg(F.min(F.struct("doc_id", "candidate", "place")).alias("first"), F.min("least").alias("least"))
    kinds = staged(kinds.select(
        *name, (F.col("first.doc_id") > F.col("least")).alias("open"), "first", F.monotonically_increasing_id().alias("kind"),
    ), "repeat-kinds")
    # Anchors of which some stretch doesn't occur in the first owner: the windows of all their stretches are compared.
    doubtful = kinds.where("open").select("anchor").distinct()
    tag = F.shiftleft("kind", SIZE_BITS) + F.col("open").cast("long")
    asked = kinds.join(doubtful, "anchor", "left_semi").groupBy("first.candidate").agg(
        F.collect_list(F.struct("first.place", tag.alias("tag"), F.col("first.doc_id").alias("first"))).alias("found"),
    ).select("candidate", *[F.col(f"found.{c}").alias(f"{c}s") for c in ("place", "tag", "first")])
    windows = staged(candidates.select("candidate", "text").join(asked, "candidate").mapInArrow(
        tidied(_windows(window)), "one long, two int, first long, tag long",
    ), "repeat-windows")
    open_ = F.col("tag").bitwiseAND(1) == 1
    earliest = windows.groupBy("one", "two").agg(F.min("first").alias("earliest"), F.max(open_).alias("open")).where("open").drop("open")
    # Written first: a join of two plain tables is one whose hot keys AQE splits.
    earliest = staged(earliest, "repeat-earliest")
    found = windows.where(open_).join(earliest, ["one", "two"]).where("earliest < first").select(
        F.shiftright("tag", SIZE_BITS).alias("kind"), F.shiftright(F.col("tag").bitwiseAND((1 << SIZE_BITS) - 1), 1).alias("nth"), "earliest",
    )
    of_kind = staged(found.groupBy("kind").agg(F.collect_list(F.struct("nth", "earliest")).alias("found")), "repeat-of-kind")
    told = stretches.join(kinds.select(*name, "open", "kind", F.col("first.doc_id").alias("first")), name).where(F.col("doc_id") > F.col("least"))
    told = staged(told.select("candidate", "doc_id", "place", "open", "kind", "first"), "repeat-told")
    # A stretch that is not the first of its kind is a repeat throughout; the first of an open kind where an earlier document has its windows.
    whole = told.where("doc_id > first").select("candidate", "place")
    parts = told.where("open AND doc_id = first").join(of_kind, "kind").select("candidate", "place", F.explode("found").alias("f"))
    begin = F.shiftleft(F.shiftright("place", SIZE_BITS) + F.col("f.nth"), SIZE_BITS)
    gone = whole.unionAll(parts.select("candidate", (begin + 1).alias("place"))).groupBy("candidate").agg(F.collect_list("place").alias("places"))
    gone = staged(gone, "repeat-places")
    changed = candidates.select("candidate", "doc_id", "text_hash", "text").join(gone, "candidate")
    return changed.select("doc_id", "text_hash", "text", "places").mapInArrow(
        tidied(_cut(window)), "doc_id long, text_hash long, n_removed long, kept_sha binary, kept_text string",
    )


def without_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, levels: int = LEVELS) -> DataFrame:
    """One row per row of `docs`: doc_id, n_words, n_removed, kept_sha256, kept_text (null where nothing or everything goes)."""
    rows, changed = repeats(docs, id_col, text_col, window, levels)
    changed = staged(changed, "repeat-changed").dropDuplicates(["doc_id", "text_hash"])  # repeated rows are cut alike
    told = changed.withColumnsRenamed({"doc_id": "c_id", "text_hash": "c_hash"})
    joined = rows.join(told, same(F.col("doc_id"), F.col("c_id")) & (F.col("text_hash") == F.col("c_hash")), "left")
    all_gone = F.col("copy") & (F.col("n_words") >= window)
    nothing = F.unhex(F.sha2(F.lit(""), 256))
    sha = F.when(all_gone, nothing).otherwise(F.coalesce("kept_sha", "sha"))
    return joined.select(
        "doc_id", "n_words", F.when(all_gone, F.col("n_words")).otherwise(F.coalesce("n_removed", F.lit(0))).alias("n_removed"),
        F.lower(F.hex(sha)).alias("kept_sha256"), F.when(all_gone, F.lit("")).otherwise(F.col("kept_text")).alias("kept_text"),
    )
