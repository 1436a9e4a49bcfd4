"""Sampled segmentation over the piece lattice of a SentencePiece vocabulary, and lossless decoding.

A text is cut into chunks that no piece crosses (blanks and the word after
them). The lattice of a chunk has a node for each place between signs and an
edge for each piece. Forward filtering sums the weights of all paths to each
node; backward sampling then draws, from the end, each last piece in
proportion to the paths that end with it, so that a segmentation is drawn with
exactly its share of all weight. Signs without a piece are spelt in byte
pieces. Draws come from a counter-based generator over (row key, chunk, step):
no state, no order of rows, and so the same result in every run.

Weights are those of a Zipf law over the ranks that the vocabulary file gives
its pieces; nothing is trained.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.llm.common import tidied, whole_text

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Flattens (below 1) or sharpens (above 1) the distribution over segmentations.
SHARPNESS = 1.0
#: Signs of text that a task segments at a time; a longer text is taken alone.
SLICE_CHARS = 1_000_000
#: Weight of a sign spelt in bytes, and a factor per sign that every path has alike.
BARE, PER_SIGN = 1e-5, 9.0
#: Signs after which sums are brought back to one scale; longer than any piece.
RESCALE = 32
#: Chunks from which on a worker's lattices are enough.
KNOWN = 30_000
_BLANK = "▁"
#: What no piece crosses: a line end, or a run of blanks with the signs after it.
_CHUNK = re.compile(r"\n| *[^ \n]+| +")


_SLOTS = 1 << 18


def _slot(key: np.ndarray) -> np.ndarray:
    return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(46)).astype(np.int64)


class Vocabulary:
    """Pieces, their weights, and a trie over their signs as one table of transitions."""

    def __init__(self, model: str, sharpness: float = SHARPNESS):
        import sentencepiece

        sp = sentencepiece.SentencePieceProcessor(model_file=model)
        self.spelling: list[bytes] = []
        byte_ids: dict[int, int] = {}
        self.edges: dict[str, tuple[int, float]] = {}
        rank = 0
        for i in range(sp.get_piece_size()):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                byte_ids[int(piece[1:-1], 16)] = i
                self.spelling.append(bytes([int(piece[1:-1], 16)]))
            elif sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i):
                self.spelling.append(b"")
            else:
                rank += 1
                plain = piece.replace(_BLANK, " ")
                self.spelling.append(plain.encode())
                # A factor per sign is common to all paths and keeps sums of products near 1. A
                # piece with a blank after other signs, or with a line end, would cross chunks.
                if not re.search(r"[^ ] |\n", plain):
                    self.edges[plain] = (i, (rank + 10.0) ** -sharpness * PER_SIGN ** len(plain))
        if len(byte_ids) != 256:
            raise ValueError("the vocabulary has no byte pieces: decoding could not be lossless")
        if max(map(len, self.edges)) >= RESCALE:
            raise ValueError("the vocabulary has pieces that are too long for the scaling here")
        self.byte_ids = np.array([byte_ids[b] for b in range(256)], np.int64)
        signs = {c: k + 1 for k, c in enumerate(sorted({c for p in self.edges for c in p}))}
        self.sign_of = np.zeros(0x110000, np.int32)  # 0: in no piece
        self.sign_of[[ord(c) for c in signs]] = list(signs.values())
        children: dict[tuple[int, int], int] = {}
        ends: list[tuple[int, float]] = [(-1, 0.0)]
        for plain, (i, weight) in self.edges.items():
            node = 0
            for c in plain:
                key = (node, signs[c])
                if key not in children:
                    children[key] = len(ends)
                    ends.append((-1, 0.0))
                node = children[key]
            ends[node] = (i, weight)
        self.width = len(signs) + 1
        if 2 * len(children) > _SLOTS:
            raise ValueError("the vocabulary is too large for the table of its trie")
        self.slots, self.targets = np.full(_SLOTS, -1, np.int64), np.zeros(_SLOTS, np.int64)
        left = np.array([a * self.width + b for a, b in children], np.int64)
        targets = np.array(list(children.values()), np.int64)
        at = _slot(left)
        while len(left):  # a key goes to the first free slot from its own
            free = np.flatnonzero(self.slots[at] < 0)
            self.slots[at[free]] = left[free]  # of several keys for a slot one gets it
            self.targets[at[free]] = targets[free]
            rest = np.flatnonzero(self.slots[at] != left)
            left, targets, at = left[rest], targets[rest], (at[rest] + 1) % _SLOTS
        self.piece = np.array([x[0] for x in ends], np.int64)
        self.weight = np.array([x[1] for x in ends])

    def step(self, node: np.ndarray, sign: np.ndarray) -> np.ndarray:
        """The child of each node under a sign; -1 if there is none."""
        key = node * self.width + sign  # a sign in no piece is 0, and no key has that
        at = _slot(key)
        seen = self.slots[at]
        child = np.where(seen == key, self.targets[at], -1)
        on = np.flatnonzero((seen != key) & (seen >= 0))
        while len(on):
            at[on] = (at[on] + 1) % _SLOTS
            seen = self.slots[at[on]]
            hit = seen == key[on]
            child[on[hit]] = self.targets[at[on[hit]]]
            on = on[~hit & (seen >= 0)]
        return child

    def decode(self, ids: np.ndarray) -> str:
        """The text of a row's ids: spellings end to end, without the blank put before."""
        return b"".join(map(self.spelling.__getitem__, ids.tolist()))[1:].decode("utf-8", "surrogatepass")


class Lattices(NamedTuple):
    """The lattices of many chunks. Nodes are places after a sign; the edges into a node are neighbours."""

    first_node: np.ndarray  # of each chunk; the node after its k-th sign is first_node + k - 1
    length: np.ndarray  # of each chunk, in signs
    first_edge: np.ndarray  # into each node
    count: np.ndarray  # of edges into each node
    upto: np.ndarray  # per edge: share of the paths into its node that come by it or an earlier edge
    piece: np.ndarray  # per edge; -1: a sign spelt in bytes
    start: np.ndarray  # per edge: signs of the chunk before it
    codes: np.ndarray  # code point of the sign before each node


def lattices(vocabulary: Vocabulary, chunks: list[str]) -> Lattices:
    """Walks the trie from all places at once, then sums path weights over all chunks, place by place."""
    length = np.fromiter(map(len, chunks), np.int64, len(chunks))
    first_node = np.cumsum(length) - length
    codes = np.frombuffer("".join(chunks).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
    sign = vocabulary.sign_of[codes]
    n = len(codes)
    place = np.arange(n) - np.repeat(first_node, length)  # of a sign in its chunk
    room = np.repeat(length, length) - place
    live, node = np.arange(n), np.zeros(n, np.int64)
    covered = np.zeros(n, bool)
    found: list[tuple[np.ndarray, np.ndarray]] = []  # by size: where edges end, and their nodes of the trie
    while len(live):
        size = len(found) + 1
        node = vocabulary.step(node, sign[live + size - 1])
        on = node >= 0
        live, node = live[on], node[on]
        ends = vocabulary.piece[node] >= 0
        found.append((live[ends] + size - 1, node[ends]))
        if size == 1:
            covered[live[ends]] = True
        more = room[live] > size
        live, node = live[more], node[more]
    bare = np.flatnonzero(~covered)
    count = np.zeros(n, np.int32)
    for end, _ in [*found, (bare, None)]:
        count[end] += 1  # an end has one edge of a size at most
    first_edge = (np.cumsum(count) - count).astype(np.int32)
    edges = int(count.sum())
    piece, weight, start, sizes = np.full(edges, -1, np.int32), np.full(edges, BARE), np.zeros(edges, np.int32), np.ones(edges, np.int32)
    free = first_edge.copy()
    start[free[bare]] = place[bare]
    free[bare] += 1
    for size, (end, node) in enumerate(found, 1):
        at = free[end]
        piece[at], weight[at], sizes[at], start[at] = vocabulary.piece[node], vocabulary.weight[node], size, place[end] - size + 1
        free[end] += 1
    # Forward sums, one place of all chunks at a time, longest chunks first. In long chunks the
    # nodes that later edges can start from are brought back to one scale now and then. Shares are
    # summed within a node, so that other chunks of a slice make no difference.
    longest = np.argsort(-length, kind="stable")
    nodes_from, lengths = first_node[longest], length[longest]
    forward, totals, upto = np.zeros(n), np.zeros(n), np.zeros(edges)
    for k in range(int(lengths[0])):
        nodes = nodes_from[:np.searchsorted(-lengths, -k)] + k
        total, rows, rank = np.zeros(len(nodes)), np.arange(len(nodes)), 0
        while len(rows):
            ending = nodes[rows]
            edge = first_edge[ending] + rank
            size = sizes[edge]
            total[rows] += np.where(size > k, 1.0, forward[ending - size]) * weight[edge]
            upto[edge] = total[rows]
            rank += 1
            rows = rows[count[ending] > rank]
        forward[nodes] = totals[nodes] = total
        if k % RESCALE == RESCALE - 1:
            for back in range(RESCALE):
                forward[nodes - back] /= total
    upto /= np.repeat(totals, count)
    return Lattices(first_node, length, first_edge, count, upto, piece, start, codes)


def joined(a: Lattices, b: Lattices) -> Lattices:
    """The lattices of a, then those of b."""
    moved = b._replace(first_node=b.first_node + len(a.codes), first_edge=b.first_edge + np.int32(len(a.piece)))
    return Lattices(*(np.concatenate(x) for x in zip(a, moved)))


class Known:
    """Lattices that a worker has at hand: those of chunks that came twice in one of its first slices."""

    def __init__(self, vocabulary: Vocabulary):
        self.vocabulary = vocabulary
        self.forget()

    def forget(self) -> None:
        self.numbers: dict[str, int] = {" ": 0}
        self.lattices = lattices(self.vocabulary, [" "])

    def of(self, numbers: dict[str, int]) -> Lattices:
        new = list(numbers)[len(self.numbers):]
        return joined(self.lattices, lattices(self.vocabulary, new)) if new else self.lattices

    def keep(self, numbers: dict[str, int], times: np.ndarray) -> None:
        if len(self.numbers) < KNOWN:
            again = [c for c, n in zip(numbers, times.tolist()) if n > 1 and c not in self.numbers and len(c) < RESCALE]
            if again:
                self.lattices = joined(self.lattices, lattices(self.vocabulary, again))
                self.numbers.update(zip(again, range(len(self.numbers), len(self.numbers) + len(again))))


def _mixed(x: np.ndarray) -> np.ndarray:
    """SplitMix64's finisher: 64 well-mixed bits of a counter."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def segment(known: Known, texts: list[str], keys: list[int]) -> tuple[np.ndarray, np.ndarray]:
    """Piece ids of all texts laid end to end, and how many each has. A blank is put before each text."""
    numbers = known.numbers.copy()
    chunk_of: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = _CHUNK.findall(" " + text) if text else []
        chunk_of.extend([numbers.setdefault(c, len(numbers)) for c in found])
        counts[i] = len(found)
    if not chunk_of:
        return np.zeros(0, np.int32), counts
    chunk = np.array(chunk_of, np.int64)
    lattice = known.of(numbers)
    known.keep(numbers, np.bincount(chunk, minlength=len(numbers)))
    text_of = np.repeat(np.arange(len(texts)), counts)
    nth = np.arange(len(chunk)) - np.repeat(np.cumsum(counts) - counts, counts)
    seeds = _mixed(np.array(keys, np.int64).view(np.uint64)[text_of] + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    base = lattice.first_node[chunk]
    place, live = lattice.length[chunk], np.arange(len(chunk))
    drawn: list[tuple[np.ndarray, np.ndarray]] = []
    while len(live):
        node = base[live] + place - 1
        step = np.uint64((len(drawn) * 0xD1342543DE82EF95) % (1 << 64))
        u = (_mixed(seeds[live] + step) >> np.uint64(11)).astype(np.float64) / float(1 << 53)
        edge = lattice.first_edge[node]
        last = edge + lattice.count[node] - 1
        open_ = np.flatnonzero((lattice.upto[edge] <= u) & (edge < last))
        while len(open_):
            edge[open_] += 1
            open_ = open_[(lattice.upto[edge[open_]] <= u[open_]) & (edge[open_] < last[open_])]
        drawn.append((live, edge))
        place = lattice.start[edge]
        on = np.flatnonzero(place)
        live, place = live[on], place[on]
    # Draws ran from the ends of chunks: lay the pieces out by chunk, the last draw first.
    taken = np.zeros(len(chunk), np.int64)
    for k, (where, _) in enumerate(drawn):
        taken[where] = k + 1
    final = np.cumsum(taken) - 1
    edges = np.zeros(int(taken.sum()), np.int64)
    for k, (where, edge) in enumerate(drawn):
        edges[final[where] - k] = edge
    ids = lattice.piece[edges].astype(np.int64)
    per_text = np.bincount(text_of, taken, len(texts)).astype(np.int64)
    bare = np.flatnonzero(ids < 0)
    if len(bare):
        of = np.searchsorted(final, bare)
        signs = lattice.codes[base[of] + lattice.start[edges[bare]]]
        spelt = [chr(c).encode("utf-8", "surrogatepass") for c in signs.tolist()]
        sizes = np.ones(len(ids), np.int64)
        sizes[bare] = [len(x) for x in spelt]
        ids = np.repeat(ids, sizes)
        ids[ids < 0] = known.vocabulary.byte_ids[np.frombuffer(b"".join(spelt), np.uint8)]
        per_text += np.bincount(text_of[of], sizes[bare] - 1, len(texts)).astype(np.int64)
    return ids.astype(np.int32), per_text


_known: dict[tuple, Known] = {}


def _known_lattices(model: str, sharpness: float) -> Known:
    """One per Python worker: the file is read once for all its tasks; a task forgets its lattices."""
    if (model, sharpness) not in _known:
        _known[model, sharpness] = Known(Vocabulary(model, sharpness))
    return _known[model, sharpness]


def _slices(column: pa.Array) -> Iterator[tuple[int, list[str]]]:
    """Where a slice of texts begins, and its texts."""
    texts: list[str] = []
    begin, size = 0, 0
    for i, value in enumerate(column):
        text = value.as_py()
        if size and size + len(text) > SLICE_CHARS:
            yield begin, texts
            texts, begin, size = [], i, 0
        texts.append(text)
        size += len(text)
    if texts:
        yield begin, texts


def encode(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL, sharpness: float = SHARPNESS,
    seed: int = 17, keep: tuple[str, ...] = (), check: bool = True,
) -> DataFrame:
    """One row per row of `docs`: doc_id, ids (the sampled pieces), n_pieces, n_chars, and the columns in `keep`.

    With `check`, also `lossless`: whether decoding the ids gives the text back.
    `model` is a path that every executor can open. Rows are seeded by (seed,
    id), so rows of one id and text are cut alike; a null id is a key too. Null
    texts are empty, empty texts have no pieces. Names in `keep` are kept as
    columns of a struct `kept`, so none clashes.
    """
    slim = docs.select(
        F.col(id_col).alias("doc_id"), F.struct(F.lit(0).alias("_"), *keep).alias("kept"),
        F.xxhash64(F.lit(seed), F.col(id_col)).alias("key"), whole_text(text_col).alias("text"),
    )
    kinds = {f.name: f.dataType.simpleString() for f in slim.schema.fields}
    schema = f"doc_id {kinds['doc_id']}, kept {kinds['kept']}, ids array<int>, n_pieces long, n_chars long, lossless boolean"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = _known_lattices(model, sharpness)
        for batch in batches:
            for a, texts in _slices(batch.column("text")):
                b = a + len(texts)
                ids, sizes = segment(known, texts, batch.column("key").slice(a, b - a).to_pylist())
                ends = np.cumsum(sizes)
                right = [known.vocabulary.decode(ids[e - n:e]) == t for t, e, n in zip(texts, ends, sizes)] if check else [None] * len(texts)
                offsets = pa.array(np.concatenate([[0], ends]).astype(np.int32))
                yield pa.RecordBatch.from_arrays([
                    batch.column("doc_id").slice(a, b - a), batch.column("kept").slice(a, b - a),
                    pa.ListArray.from_arrays(offsets, pa.array(ids, pa.int32())), pa.array(sizes, pa.int64()),
                    pa.array([len(t) for t in texts], pa.int64()), pa.array(right, pa.bool_()),
                ], names=["doc_id", "kept", "ids", "n_pieces", "n_chars", "lossless"])

    out = slim.mapInArrow(tidied(run, lambda: _known_lattices(model, sharpness).forget()), schema)
    return out.select("doc_id", "ids", "n_pieces", "n_chars", *(["lossless"] if check else []), *(["kept"] if keep else []))


def decode(encoded: DataFrame, model: str = MODEL, id_col: str = "doc_id", ids_col: str = "ids") -> DataFrame:
    """doc_id and the text of each row's ids; null ids give an empty text."""
    slim = encoded.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(ids_col), F.array().cast("array<int>")).alias("ids"))
    kind = slim.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = _known_lattices(model, SHARPNESS).vocabulary
        for batch in batches:
            texts = [vocabulary.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], names=["doc_id", "text"])

    return slim.mapInArrow(run, f"doc_id {kind}, text string")
