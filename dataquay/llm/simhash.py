"""SimHash near-dedup by multi-index hashing.

A fingerprint has a bit of each of 64 positions: what more than half of the
hashes of a text's shingles have there. Fingerprints are linked if few bits
differ. They are cut into segments; if two differ in at most `distance` bits,
some segment has at most its radius of them. So each fingerprint is put into the
table of every segment by the bits it has there, looks up the small Hamming ball
around these bits, and every match is verified on the complete fingerprints. Of
two bit patterns only the smaller one looks the other up.

Equal fingerprints are one node from the start. A bucket with few members meets
its look-ups in a join. What meets in a fuller one is dealt anew by segments of
other, interleaved bits, so that only fingerprints that are alike nearly
everywhere stay together. Buckets that are still full are cut into blocks of
bounded size; a task compares two blocks and gives out a spanning forest of
their links, never all pairs. Nothing depends on the path: each of them finds
every link of its bucket.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import accumulate, combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.llm.common import same, staged, whole_text
from dataquay.llm.components import components
from dataquay.llm.hashing import words_of

WORDS, DISTANCE, SEED, BITS = 4, 4, 42, 64
#: Members of a bucket up to which its look-ups are joined, and rows of a block.
MANY, BLOCK = 64, 1024
#: Shingles whose bits are counted at a time.
COUNTED = 65_536


def fingerprint(text: str | None, length: int = WORDS) -> int:
    """The fingerprint as an unsigned number; that of a text without words is 0."""
    words = words_of(text, lower=True)
    if not words:
        return 0
    length = min(length, len(words))
    line = b" ".join(words)
    starts = list(accumulate((len(w) + 1 for w in words), initial=0))
    hashes = np.fromiter(
        (xxhash.xxh64_intdigest(line[a:b - 1], SEED) for a, b in zip(starts, starts[length:])), np.uint64, len(words) - length + 1,
    )
    ones = np.zeros(BITS, np.int64)
    for at in range(0, len(hashes), COUNTED):
        part = hashes[at:at + COUNTED].astype("<u8").view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = WORDS) -> DataFrame:
    """doc_id, text_hash and node (the fingerprint as a signed long) of each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter((fingerprint(t.as_py(), length) for t in batch.column("text")), np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("text_hash"), pa.array(found.view(np.int64))], names=["doc_id", "text_hash", "node"])

    text = whole_text(text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text).alias("text_hash"), text.alias("text"))
    return texts.mapInArrow(run, "doc_id long, text_hash long, node long")


def _signed(bits: int) -> int:
    return bits - (1 << BITS) if bits >> (BITS - 1) else bits


def segments(count: int, distance: int, interleaved: bool = False) -> list[tuple[int, int]]:
    """(mask, radius) per segment: if more than its radius differs in each, more than `distance` bits differ in all."""
    count = max(1, min(count, distance + 1))
    radius = [(distance + 1) // count - 1 + (k < (distance + 1) % count) for k in range(count)]
    owner = [b % count if interleaved else b * count // BITS for b in range(BITS)]
    return [(sum(1 << b for b in range(BITS) if owner[b] == k), radius[k]) for k in range(count)]


def segments_for(n: int, distance: int) -> int:
    """As many segments as leave each about as many bits as number the fingerprints."""
    return max(2, min(distance + 1, BITS // max(1, n.bit_length())))


def _looked_up(rows: DataFrame, cut: list[tuple[int, int]]) -> DataFrame:
    """(key, node, own) of rows (key, node): the bucket of each segment, and those of the ball that are larger."""
    flips = []
    for k, (mask, radius) in enumerate(cut):
        bits = [1 << b for b in range(BITS) if mask >> b & 1]
        flips += [(k, _signed(mask), _signed(sum(c))) for r in range(radius + 1) for c in combinations(bits, r)]
    listed = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(m).cast("long").alias("mask"), F.lit(f).cast("long").alias("flip")) for k, m, f in flips]))
    at = lambda node: node.bitwiseAND(F.col("c.mask"))
    there = at(F.col("node").bitwiseXOR(F.col("c.flip")))
    own = F.col("c.flip") == 0
    return rows.select("key", "node", listed.alias("c")).where(own | (there > at(F.col("node")))).select(
        F.xxhash64("key", F.col("c.k"), there).alias("key"), "node", own.alias("own"),
    )


def _split(rows: DataFrame, cut: list[tuple[int, int]], distance: int) -> tuple[DataFrame, DataFrame]:
    """Links found in buckets of few members, and the rows (key, node) of the others."""
    met = _looked_up(rows, cut)
    full = staged(met.where("own").groupBy("key").count().where(F.col("count") > MANY).select("key"), "simhash-full")
    members = met.where("own").join(full, "key", "left_anti").select("key", F.col("node").alias("b"))
    close = F.bit_count(F.col("node").bitwiseXOR(F.col("b"))) <= distance
    links = met.join(members, "key").where(close & (~F.col("own") | (F.col("node") < F.col("b"))))
    return links.select(F.col("node").alias("a"), "b"), met.join(full, "key", "left_semi").select("key", "node")


def forest(nodes: np.ndarray, distance: int) -> tuple[np.ndarray, np.ndarray]:
    """Links that connect what links of at most `distance` bits connect, one less than nodes at most."""
    near = np.bitwise_count(nodes[:, None] ^ nodes[None, :]) <= distance
    unseen = np.ones(len(nodes), bool)
    ends: list[tuple[np.ndarray, np.ndarray]] = []
    for start in range(len(nodes)):
        if not unseen[start]:
            continue
        unseen[start] = False
        edge = np.array([start])
        while len(edge):
            new = np.flatnonzero(near[edge].any(axis=0) & unseen)
            ends.append((nodes[edge[near[edge][:, new].argmax(axis=0)]], nodes[new]))
            unseen[new] = False
            edge = new
    a, b = zip(*ends) if ends else ((), ())
    return (np.concatenate(a), np.concatenate(b)) if ends else (nodes[:0], nodes[:0])


def _links_in_blocks(rows: DataFrame, distance: int) -> DataFrame:
    """Links of full buckets: (key, node) rows go to the cells, pairs of blocks, of their own block."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cell, held = None, []

        def links() -> pa.RecordBatch:
            a, b = forest(np.unique(np.array(held, np.int64)).view(np.uint64), distance)
            return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (a, b)], names=["a", "b"])

        for batch in batches:
            for c, node in zip(batch.column("cell").to_pylist(), batch.column("node").to_pylist()):
                if c != cell:
                    yield links()
                    cell, held = c, []
                held.append(node)
        yield links()

    rows = staged(rows, "simhash-rows")
    blocks = rows.groupBy("key").agg(F.ceil(F.count("*") / BLOCK).cast("int").alias("blocks"))
    placed = rows.join(blocks, "key").withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    cells = placed.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = cells.select("node", F.xxhash64("key", F.least("block", "other"), F.greatest("block", "other")).alias("cell"))
    return dealt.repartition("cell").sortWithinPartitions("cell").select("cell", "node").mapInArrow(run, "a long, b long")


def links(nodes: DataFrame, distance: int = DISTANCE, count: int | None = None) -> DataFrame:
    """Pairs (a, b) of the distinct fingerprints in `node` that connect all that differ in at most `distance` bits.

    Every pair is a link; a pair whose ends are connected by others may be left out.
    """
    count = count or segments_for(nodes.count(), distance)
    found, full = _split(nodes.select(F.lit(0).cast("long").alias("key"), "node"), segments(count, distance), distance)
    found = staged(found, "simhash-links")
    full = staged(full, "simhash-full-rows")
    if full.isEmpty():
        return found
    again, full = _split(full, segments(4, distance, interleaved=True), distance)
    return found.unionAll(again).unionAll(_links_in_blocks(full, distance))


def near_groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """One row per row of `docs`: doc_id, text_hash, fingerprint (16 hex digits) and component_id, the smallest id that links reach.

    A null text is empty; texts without words have fingerprint zero and are
    linked like any others, with each other too. A text of fewer words than a
    shingle is one shingle. Null ids are larger than others: a component of
    them alone has a null id. Repeated rows stay. Other columns are not read.
    """
    rows = staged(fingerprints(docs, id_col, text_col, words), "simhash-rows")
    nodes = staged(rows.groupBy("node").agg(F.min("doc_id").alias("least")), "simhash-nodes")
    roots = components(links(nodes.select("node"), distance), "simhash-components").withColumnsRenamed({"node": "r_node"})
    rooted = nodes.join(roots, F.col("node") == F.col("r_node"), "left").select("node", "least", F.coalesce("root", "node").alias("root"))
    rooted = staged(rooted, "simhash-roots")
    least = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    told = rooted.select("node", "root").join(least, "root").select("node", "component_id")
    # Rows of one fingerprint may be very many: no hint, so that AQE splits them.
    return rows.join(told, "node").select("doc_id", "text_hash", F.lower(F.lpad(F.hex("node"), 16, "0")).alias("fingerprint"), "component_id")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, distance: int = DISTANCE) -> DataFrame:
    """The rows of `docs` with the smallest id of their component; where no row has an id, all stay. Repeated rows stay together."""
    groups = near_groups(docs, id_col, text_col, words, distance).where("NOT doc_id <=> component_id")
    gone = staged(groups.select(F.col("doc_id").alias("id"), "text_hash").distinct(), "simhash-gone")
    rows = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("of"), F.xxhash64(whole_text(text_col)).alias("hash"))
    return rows.join(gone, same(F.col("of"), F.col("id")) & (F.col("hash") == F.col("text_hash")), "left_anti").select("row.*")
