"""MinHash near-dedup with SetSketch registers.

A register holds the smallest of exponential variates of a document's shingles,
cut to a power of a base just above 1 and to a range: 1 - log_b(h), whole and
between 0 and a limit. Registers of a union are the larger of two, and two
documents agree in one with a probability near their similarity. Bands of
registers find candidates, a likelihood ratio over all registers and the set
sizes drops those that can't be similar, and the others are decided on their
full sets.

Texts with the same words are one node from the start. Within a bucket no pairs
are made: members are compared with a centre, links are merged into components,
and only members of different components are looked at further. Buckets whose
members are alike but not similar, such as texts around one long passage, would
still hold very many pairs. So the members left are put into new buckets by
their rarest shingles: documents that are similar have one of these in common
for certain, and texts that share a passage alone mostly have none. Members of
different components in such a bucket are compared in pairs where it is small. A
large one goes through tasks as blocks of bounded size, which count what all
members have in common at once, and give out the links between components.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.llm.common import same, staged, tidied, whole_text
from dataquay.llm.components import components
from dataquay.llm.hashing import forget, hashes_of, runs, words_of

WORDS, PERCENT = 5, 80
#: A pair at the threshold shares no band with a probability of (1 - 0.8**4)**40 = 7e-10.
BANDS, ROWS = 40, 4
REGISTERS = BANDS * ROWS
BASE, RATE, LIMIT = 1.001, 20.0, 65534
#: A candidate is dropped if its registers are e**18 times likelier at its best similarity than at any accepted one.
UNLIKELY = 18.0
#: Rounds with new centres.
ROUNDS = 1
#: Members of a bucket of rare shingles from which it goes through a task in blocks, shingles and members
#: in a block (about; blocks are dealt by hash), and shingles that are counted at a time.
MANY, BLOCK_SHINGLES, BLOCK_MEMBERS, COUNTED = 64, 500_000, 2000, 4096

_odd = np.random.default_rng(20)
_FACTORS = _odd.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + np.uint64(1)
_MASKS = _odd.integers(0, 1 << 63, REGISTERS, np.uint64) * np.uint64(2) + _odd.integers(0, 2, REGISTERS, np.uint64)


def shingles(words: list[bytes], length: int) -> np.ndarray:
    """Sorted hashes of the distinct shingles; a shorter text is one shingle, a text without words none."""
    if not words:
        return np.zeros(0, np.uint64)
    hashes = hashes_of(words)
    return np.unique(runs(hashes, min(length, len(hashes))))


def registers(found: np.ndarray) -> np.ndarray:
    """The SetSketch of a set of hashes. The order of variates is that of their hashes, so minima are taken of these."""
    least = np.full(REGISTERS, np.iinfo(np.uint64).max)
    for at in range(0, len(found), 128):  # blocks that stay in a core's cache
        part = found[at:at + 128, None] ^ _MASKS
        part *= _FACTORS
        np.minimum(least, part.min(axis=0), out=least)
    uniform = ((least >> np.uint64(11)).astype(np.float64) + 0.5) / float(1 << 53)
    smallest = -np.log1p(-uniform) / RATE
    return np.clip(np.floor(1 - np.log(smallest) / math.log(BASE)), 0, LIMIT + 1).astype(np.uint16)


def bands(sketch: np.ndarray) -> list[int]:
    raw = np.ascontiguousarray(sketch).tobytes()
    width = 2 * ROWS
    return [xxhash.xxh3_64_intdigest(raw[k * width:(k + 1) * width], seed=k) - (1 << 63) for k in range(BANDS)]


_GRID = np.linspace(0, 1, 201)


def unlikely(a: np.ndarray, b: np.ndarray, n_a: np.ndarray, n_b: np.ndarray, percent: int) -> np.ndarray:
    """Which pairs the joint likelihood of their registers (rows of a and b) puts below the threshold beyond doubt."""
    above, below = (a > b).sum(axis=1), (a < b).sum(axis=1)
    u = (n_a / (n_a + n_b))[:, None]
    v = 1 - u
    p = lambda x: -np.log1p(-np.clip(x, 1e-12, 1) * (BASE - 1) / BASE) / math.log(BASE)
    more, less = p(u - v * _GRID), p(v - u * _GRID)
    equal = np.clip(1 - more - less, 1e-12, 1)
    likely = above[:, None] * np.log(more) + below[:, None] * np.log(less) + (REGISTERS - above - below)[:, None] * np.log(equal)
    possible = _GRID <= np.minimum(u / v, v / u) + 1e-9
    likely = np.where(possible, likely, -np.inf)
    accepted = np.where(_GRID >= percent / 100 - 1e-9, likely, -np.inf).max(axis=1)
    return likely.max(axis=1) - accepted > UNLIKELY


def _rows(doc_words: Iterator[list[bytes]], length: int) -> Iterator[tuple]:
    for words in doc_words:
        found = shingles(words, length)
        sketch = registers(found) if len(found) else None
        yield (
            xxhash.xxh3_128_digest(b" ".join(words)), len(found), None if sketch is None else sketch.tobytes(),
            [] if sketch is None else bands(sketch),
        )


def sketched(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """Per row: row_id, doc_id, text_hash, digest (of the words), n, sketch, bands. A written table, so that row ids hold."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = list(_rows((words_of(t.as_py(), lower=True) for t in batch.column("text")), length))
            digest, n, sketch, keys = zip(*rows) if rows else ((), (), (), ())
            yield pa.RecordBatch.from_arrays([
                batch.column("doc_id"), batch.column("text_hash"), pa.array(digest, pa.binary()), pa.array(n, pa.int64()),
                pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64())),
            ], names=["doc_id", "text_hash", "digest", "n", "sketch", "bands"])

    rows = _texts(docs, id_col, text_col).mapInArrow(
        tidied(run, forget), "doc_id long, text_hash long, digest binary, n long, sketch binary, bands array<long>",
    )
    return staged(rows.withColumn("row_id", F.monotonically_increasing_id()), "near-sketches")


def _texts(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    text = whole_text(text_col)
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))


class _Links:
    """Links between nodes, verified on full sets, and the components they make."""

    def __init__(self, nodes: DataFrame, sets: DataFrame, percent: int):
        self.nodes, self.sets, self.percent = nodes, sets, percent
        self.links: DataFrame | None = None
        self.roots: DataFrame | None = None
        self.tried: DataFrame | None = None

    def test(self, pairs: DataFrame) -> None:
        """Verify pairs (a, b) that were not tried before; merge what they link."""
        pairs = pairs.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).where("a <> b").distinct()
        if self.tried is not None:
            pairs = pairs.join(self.tried, ["a", "b"], "left_anti")
        pairs = staged(pairs, "near-pairs")
        self.tried = pairs if self.tried is None else self.tried.unionAll(pairs)
        self.add(_verified(_plausible(pairs, self.nodes, self.percent), self.sets, self.percent))

    def add(self, links: DataFrame) -> None:
        links = staged(links, "near-links")
        self.links = links if self.links is None else self.links.unionAll(links)
        self.roots = components(self.links, "near-components")

    def labelled(self, members: DataFrame) -> DataFrame:
        roots = self.roots.withColumnRenamed("node", "r_node")
        return members.select("key", "node").join(roots, F.col("node") == F.col("r_node"), "left").select("key", "node", F.coalesce("root", "node").alias("root"))


def _plausible(pairs: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """Pairs whose sizes and registers allow the similarity."""
    side = lambda s: nodes.select(F.col("node").alias(s), F.col("n").alias(f"n_{s}"), F.col("sketch").alias(f"s_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    both = both.where(f"100 * least(n_a, n_b) >= {percent} * greatest(n_a, n_b)").select("a", "b", "n_a", "n_b", "s_a", "s_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4096):
                part = batch.slice(at, 4096)
                a, b = (np.frombuffer(b"".join(part.column(c).to_pylist()), np.uint16).reshape(-1, REGISTERS) for c in ("s_a", "s_b"))
                n_a, n_b = (part.column(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("n_a", "n_b"))
                good = pa.array(~unlikely(a, b, n_a, n_b, percent))
                yield pa.RecordBatch.from_arrays([part.column("a").filter(good), part.column("b").filter(good)], names=["a", "b"])

    return both.mapInArrow(tidied(run), "a long, b long")


def _hashes(stored: pa.Scalar) -> np.ndarray:
    """A set as it is stored: an array of hashes, or their bytes."""
    return np.frombuffer(stored.as_buffer(), np.int64) if isinstance(stored, pa.BinaryScalar) else stored.values.to_numpy()


def _verified(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Pairs whose full sets are similar: 100 * shared >= percent * all."""
    side = lambda s: sets.select(F.col("node").alias(s), F.col("shingles").alias(f"f_{s}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b").select("a", "b", "f_a", "f_b")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            good = []
            for x, y in zip(batch.column("f_a"), batch.column("f_b")):
                x, y = _hashes(x), _hashes(y)
                shared = len(np.intersect1d(x, y, assume_unique=True))
                good.append(100 * shared >= percent * (len(x) + len(y) - shared))
            good = pa.array(good, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column("a").filter(good), batch.column("b").filter(good)], names=["a", "b"])

    return both.mapInArrow(tidied(run), "a long, b long")


def _sets(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """Shingles of candidate nodes. Spark broadcasts the nodes' ids if their table is small, else shuffles."""
    wanted = nodes.select(F.col("doc_id").alias("w_id"), F.col("text_hash").alias("w_hash"), "node")
    texts = _texts(docs, id_col, text_col)
    found = texts.join(wanted, same(F.col("doc_id"), F.col("w_id")) & (F.col("text_hash") == F.col("w_hash"))).select("node", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingles(words_of(t.as_py(), lower=True), length).view(np.int64) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("node"), pa.array(sets, pa.list_(pa.int64()))], names=["node", "shingles"])

    # Repeated rows of one id and text give one set.
    return staged(found.mapInArrow(tidied(run, forget), "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles")), "near-sets")


def _linked(docs: DataFrame, rows: DataFrame, groups: DataFrame, id_col: str, text_col: str, length: int, percent: int) -> DataFrame | None:
    """node and root of the nodes that have links; None if no two share a bucket."""
    nodes = rows.join(groups.select(F.col("node").alias("row_id")), "row_id", "left_semi").withColumnRenamed("row_id", "node")
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = keyed.groupBy("key").agg(F.min("node").alias("least"), F.max("node").alias("most")).where("least < most").select("key")
    members = staged(keyed.join(shared, "key"), "near-members")
    if members.isEmpty():
        return None
    wanted = members.select("node").distinct()
    nodes = staged(nodes.join(wanted, "node", "left_semi").select("node", "doc_id", "text_hash", "n", "sketch"), "near-nodes")
    found = _Links(nodes, _sets(docs, nodes, id_col, text_col, length), percent)
    centres = members.groupBy("key").agg(F.min("node").alias("centre"))
    found.test(members.join(centres, "key").select(F.col("centre").alias("a"), F.col("node").alias("b")))
    for round_ in range(ROUNDS):
        found.test(_to_centres(_unsettled(found.labelled(members)), round_))
    members = _unsettled(found.labelled(members))
    rare = _rare_members(found.sets, members.select("node").distinct(), percent)
    rare = _unsettled(found.labelled(rare))
    size = F.count("*").alias("size")
    small = staged(rare.join(rare.groupBy("key").agg(size).where(F.col("size") <= MANY), "key"), "near-small")
    other = small.select("key", F.col("node").alias("o_node"), F.col("root").alias("o_root"))
    pairs = small.join(other, "key").where(F.col("root") < F.col("o_root"))
    found.test(pairs.select(F.col("node").alias("a"), F.col("o_node").alias("b")))
    large = staged(rare.join(rare.groupBy("key").agg(size).where(F.col("size") > MANY), "key"), "near-large")
    found.add(_links_in_blocks(_unsettled(found.labelled(large)), found.nodes, found.sets, percent))
    return found.roots


def _to_centres(members: DataFrame, round_: int) -> DataFrame:
    """Each member with a centre of its bucket, picked by hash, where that is in another component."""
    by_hash = F.struct(F.xxhash64(F.lit(round_), "key", "node").alias("h"), F.col("node"), F.col("root"))
    centres = members.groupBy("key").agg(F.min(by_hash).alias("c"))
    pairs = members.join(centres, "key").where(F.col("root") != F.col("c.root"))
    return pairs.select(F.col("c.node").alias("a"), F.col("node").alias("b"))


def _rare_members(sets: DataFrame, nodes: DataFrame, percent: int) -> DataFrame:
    """(key, node): the rarest shingles of each node, by how many of the nodes have them.

    Of n shingles a similar document has percent * n / 100 in common at least.
    So in any one order of all shingles, the first n less that, and one more,
    include one that both have among theirs. Shingles of one node alone come
    first in the order, take their places, and need no bucket.
    """
    rows = sets.join(nodes, "node", "left_semi").select(F.explode("shingles").alias("key"), "node", F.size("shingles").cast("long").alias("n"))
    shared = staged(rows.groupBy("key").agg(F.count("*").alias("holders")).where("holders > 1"), "near-shingles")
    lists = rows.join(shared, "key").groupBy("node").agg(F.max("n").alias("n"), F.collect_list(F.struct("holders", "key")).alias("some"))
    places = F.expr(f"int(greatest(0, n - (({percent} * n + 99) div 100) + 1 - (n - size(some))))")
    first = lists.select("node", F.slice(F.array_sort("some"), F.lit(1), places).alias("first"))
    members = staged(first.select(F.explode("first.key").alias("key"), "node"), "near-rare")
    # Near copies share many rare shingles: of buckets with the same members one is enough.
    same_members = members.groupBy("key").agg(
        F.count("*").alias("n"), F.min("node").alias("least"), F.max("node").alias("most"), F.bit_xor(F.xxhash64("node")).alias("all"),
    ).groupBy("n", "least", "most", "all").agg(F.min("key").alias("key"))
    return members.join(same_members.where("n > 1").select("key"), "key").select("key", "node")


def similar_pairs(sets: list[np.ndarray], blocks: list[int], roots: list[int], percent: int) -> list[tuple[int, int]]:
    """Indices of similar sets that join sets of different roots: enough of them to connect what is connected.

    Sets of two blocks are compared across them; of one block, all. Only
    shingles that several sets have are counted, by a product of matrices.
    """
    parent: dict[int, int] = {}

    def top(x: int) -> int:
        while parent.setdefault(x, x) != x:
            parent[x] = x = parent[parent[x]]
        return x

    n = np.array([len(x) for x in sets], np.float32)
    values, column, holders = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    row = np.repeat(np.arange(len(sets)), n.astype(np.int64))
    place = np.cumsum(holders > 1) - 1
    some = holders[column] > 1
    row, column = row[some], place[column[some]]
    one, two = np.flatnonzero(np.array(blocks) == min(blocks)), np.flatnonzero(np.array(blocks) == max(blocks))
    shared = np.zeros((len(one), len(two)), np.float32)
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    kinds = int(column[-1]) + 1 if len(column) else 0
    for start in range(0, kinds, COUNTED):
        a, b = np.searchsorted(column, (start, start + COUNTED))
        has = np.zeros((len(sets), min(COUNTED, kinds - start)), np.float32)
        has[row[a:b], column[a:b] - start] = 1
        shared += has[one] @ has[two].T
    similar = 100 * shared >= percent * (n[one][:, None] + n[two][None, :] - shared)
    links = []
    for i, found in zip(one.tolist(), similar):
        for j in two[found].tolist():
            a, b = top(roots[i]), top(roots[j])
            if a != b:
                parent[a] = b
                links.append((i, j))
    return links


def _links_in_blocks(members: DataFrame, nodes: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Links (a, b) between members of different components of a bucket.

    A bucket has as many blocks as its shingles or its members need, so that the
    matrices of a cell are bounded however short the texts; a cell is a pair of
    blocks, or one alone, and each member goes to the cells of its block.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, rows = None, []

        def links() -> pa.RecordBatch:
            found = similar_pairs([r[4] for r in rows], [r[2] for r in rows], [r[3] for r in rows], percent) if rows else []
            ends = [pa.array([rows[pair[side]][1] for pair in found], pa.int64()) for side in (0, 1)]
            return pa.RecordBatch.from_arrays(ends, names=["a", "b"])

        for batch in batches:
            for r in zip(*(batch.column(c).to_pylist() for c in ("cell", "node", "block", "root")), map(_hashes, batch.column("shingles"))):
                if r[0] != cell:
                    yield links()
                    cell, rows = r[0], []
                rows.append(r)
        yield links()

    sized = members.join(nodes.select("node", "n"), "node")
    needed = F.greatest(F.ceil(F.sum("n") / BLOCK_SHINGLES), F.ceil(F.count("*") / BLOCK_MEMBERS))
    blocks = sized.groupBy("key").agg(needed.cast("int").alias("blocks"))
    placed = members.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = cells.select(
        "node", "root", "block", F.struct("key", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j")).alias("cell"),
    )
    dealt = cells.join(sets, "node").repartition("cell").sortWithinPartitions("cell").select("cell", "node", "block", "root", "shingles")
    return dealt.mapInArrow(tidied(run), "a long, b long")


def _unsettled(labelled: DataFrame) -> DataFrame:
    """Members of buckets with more than one component."""
    open_ = labelled.groupBy("key").agg(F.min("root").alias("least"), F.max("root").alias("most")).where("least < most").select("key")
    return staged(labelled.join(open_, "key"), "near-open")


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """One row per row of `docs`: row_id, doc_id, text_hash, n_shingles, component_id, kept, owner.

    Documents are linked if 100 * shared >= percent * all of their distinct
    shingles of so many words (A-Z in lower case; a shorter text is one
    shingle). component_id is the smallest id that links reach. A null or empty
    text is linked with nothing. Null ids are larger than others: a component
    of them alone has a null id. `owner` marks one row of each component,
    also where rows share an id; empty texts own themselves.
    """
    rows = sketched(docs, id_col, text_col, words)
    groups = staged(rows.where("n > 0").groupBy("digest").agg(F.min("row_id").alias("node")), "near-groups")
    roots = _linked(docs, rows, groups, id_col, text_col, words, percent)
    slim = rows.select("row_id", "doc_id", "text_hash", "digest", F.col("n").alias("n_shingles"))
    of_row = slim.where("n_shingles > 0").join(groups, "digest").drop("digest")
    if roots is not None:
        of_row = of_row.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    else:
        of_row = of_row.withColumn("root", F.col("node"))
    of_row = staged(of_row.drop("node"), "near-rows")
    first = F.struct(F.col("doc_id").isNull().alias("no_id"), F.col("doc_id"), F.col("row_id"))
    least = of_row.groupBy("root").agg(F.min(first).alias("first")).select("root", F.col("first.doc_id").alias("component_id"), F.col("first.row_id").alias("first_row"))
    told = of_row.join(least, "root").select(
        "row_id", "doc_id", "text_hash", "n_shingles", "component_id",
        F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"), (F.col("row_id") == F.col("first_row")).alias("owner"),
    )
    empty = slim.where("n_shingles = 0").select(
        "row_id", "doc_id", "text_hash", "n_shingles", F.col("doc_id").alias("component_id"), F.lit(True).alias("kept"), F.lit(True).alias("owner"),
    )
    return told.unionAll(empty)


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> DataFrame:
    """The rows of `docs` that stay, with its columns: one document of each component, the one with the smallest id.

    Repeated rows of one id and text are one document and stay together; exact dedup removes those.
    """
    groups = near_groups(docs, id_col, text_col, words, percent)
    staying = groups.where("owner").select(F.col("doc_id").alias("id"), "text_hash")
    gone = groups.where("NOT owner").select(F.col("doc_id").alias("id"), "text_hash")
    gone = staged(gone.join(staying.withColumnsRenamed({"id": "s_id", "text_hash": "s_hash"}),
                            same(F.col("id"), F.col("s_id")) & (F.col("text_hash") == F.col("s_hash")), "left_anti").distinct(), "near-gone")
    texts = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("of"), F.xxhash64(whole_text(text_col)).alias("hash"))
    return texts.join(gone, same(F.col("of"), F.col("id")) & (F.col("hash") == F.col("text_hash")), "left_anti").select("row.*")
