"""Exact dedup with Patricia-trie owners.

Texts equal after each run of white space is made one blank are one group. Rows
go to partitions by length and content hash, sorted by both. A compressed radix
trie takes the full byte strings, and its terminal nodes hold the smallest
identifier. Over its memory budget a task first lets the rows go that are copies
of others, so that a text takes the room of one, however often it comes. If that
is not enough, the trie is emptied subtree by subtree, each given out as rows and
dropped: once the stream has passed a (length, hash) key, its strings can't come
again. Each map task first runs its own rows through a trie, so that a text
shared by a third of all rows crosses the network once per task, or as often as
the task's other texts fill the budget.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import groupby

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.llm.common import one_space, tidied

#: Bytes of strings, nodes and rows that a task holds, but for its last batch; and of a subtree that is given out at once.
TRIE_BYTES, SUBTREE_BYTES = 16 << 20, 4 << 20
#: Bytes that a node takes besides its string.
NODE_BYTES = 400
_SPACES = re.compile(rb"[\x20\x09-\x0D]+")


class PatriciaTrie:
    """A compressed radix trie over bytes; every terminal node has a value."""

    __slots__ = ("root", "bytes")

    def __init__(self):
        self.root = [b"", {}, None]  # label, children by first byte, value
        self.bytes = 0

    def terminal(self, key: bytes) -> list:
        """The node where `key` ends; made if there is none."""
        node, at = self.root, 0
        while at < len(key):
            child = node[1].get(key[at])
            if child is None:
                child = [key[at:], {}, None]
                node[1][key[at]] = child
                self.bytes += len(key) - at + NODE_BYTES
                return child
            label = child[0]
            if key.startswith(label, at):
                node, at = child, at + len(label)
                continue
            common = _common_prefix(label, key, at)
            upper = [label[:common], {label[common]: child}, None]
            child[0] = label[common:]
            self.bytes += NODE_BYTES
            node[1][key[at]] = upper
            node, at = upper, at + common
        return node

    def values(self) -> Iterator:
        stack = [self.root]
        while stack:
            node = stack.pop()
            if node[2] is not None:
                yield node[2]
            stack.extend(node[1].values())

    def emptied(self, size: int) -> Iterator[list]:
        """The values of subtrees, some `size` bytes of strings together, which are dropped."""
        stack, found, taken = [self.root], [], 0
        self.root, self.bytes = [b"", {}, None], 0
        while stack:
            label, children, value = stack.pop()
            taken += len(label) + NODE_BYTES
            if value is not None:
                found.append(value)
            stack.extend(children.values())
            if taken >= size and found:
                yield found
                found, taken = [], 0
        if found:
            yield found


def _common_prefix(label: bytes, key: bytes, at: int) -> int:
    """How many bytes of `label` equal `key` from `at`; halves the range, so that slices compare in C."""
    low, high = 0, min(len(label), len(key) - at)
    while low < high:
        middle = (low + high + 1) // 2
        if label[:middle] == key[at:at + middle]:
            low = middle
        else:
            high = middle - 1
    return low


def _normal(text) -> bytes:
    return b"" if text is None else _SPACES.sub(b" ", str(text).encode("utf-8", "surrogatepass"))


class _Task:
    """A task's trie, and the rows that its terminal nodes point to."""

    def __init__(self):
        self.trie, self.held, self.rows_bytes = PatriciaTrie(), [], 0

    @property
    def bytes(self) -> int:
        return self.trie.bytes + self.rows_bytes

    def hold(self, batch: pa.RecordBatch) -> None:
        self.held.append(batch)
        self.rows_bytes += batch.nbytes

    def add(self, at: int, content: bytes, rank: tuple, n: int) -> None:
        """A row of the last batch."""
        node = self.trie.terminal(content)
        here = len(self.held) - 1
        if node[2] is None:
            node[2] = [rank, here, at, n, hashlib.sha256(content).digest()]
            return
        node[2][3] += n
        if rank < node[2][0]:
            node[2][:3] = rank, here, at

    def slim(self) -> None:
        """Only the rows that are owners so far stay: copies take no room."""
        values = sorted(self.trie.values(), key=lambda v: (v[1], v[2]))
        self.held = [self._rows(values)] if values else []
        for place, value in enumerate(values):
            value[1:3] = 0, place
        self.rows_bytes = sum(b.nbytes for b in self.held)

    def _rows(self, values: list) -> pa.RecordBatch:
        """The rows of values that are sorted by batch and place, as a copy."""
        parts = [self.held[which].take(pa.array([v[2] for v in of], pa.int64())) for which, of in groupby(values, key=lambda v: v[1])]
        return pa.Table.from_batches(parts).combine_chunks().to_batches()[0]

    def given_out(self) -> Iterator[pa.RecordBatch]:
        """Subtree by subtree, the owners; the trie is empty then."""
        for values in self.trie.emptied(SUBTREE_BYTES):
            values.sort(key=lambda v: (v[1], v[2]))
            rows = self._rows(values)
            columns = {name: rows.column(name) for name in rows.schema.names}
            columns["n_rows"] = pa.array([v[3] for v in values], pa.int64())
            columns["sha"] = pa.array([v[4] for v in values], pa.binary())
            yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))
        self.held, self.rows_bytes = [], 0


def _owners(batches: Iterator[pa.RecordBatch], text_col: str, budget: int, by_key: bool) -> Iterator[pa.RecordBatch]:
    """One row per distinct text: the row of the smallest (id, tie), with the rows it stands for.

    Copies are let go when trie and rows are over the budget. If they still are
    over half of it, all is given out: at once, or where the stream is sorted
    `by_key`, as soon as the key changes, so that a text comes out once.
    """
    task, last, full = _Task(), None, False
    for batch in batches:
        texts = batch.column("row").field(text_col)
        ids, ties, counts = (batch.column(c).to_pylist() for c in ("id", "tie", "n_rows"))
        keys = list(zip(batch.column("length").to_pylist(), batch.column("hash").to_pylist()))
        task.hold(batch)
        for at, text in enumerate(texts):
            if full and keys[at] != last:
                yield from task.given_out()
                task.hold(batch)
                full = False
            last = keys[at]
            task.add(at, _normal(text.as_py()), (ids[at] is None, ids[at] or 0, ties[at]), counts[at])
            if by_key and task.trie.bytes > budget:
                full = True
        if task.bytes > budget:
            task.slim()
            full = task.bytes > budget // 2
            if full and not by_key:
                yield from task.given_out()
                full = False
    yield from task.given_out()


def owner_rows(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", budget: int = TRIE_BYTES) -> DataFrame:
    """One row per distinct text (a column of strings): `row` (the row that stays, as a struct), `sha`, `n_rows` of its group."""
    normal = one_space(text_col)
    hashable = [c for c, kind in docs.dtypes if "map<" not in kind and "variant" not in kind]
    keyed = docs.select(
        F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"), F.xxhash64(*hashable).alias("tie"),
        F.octet_length(normal).cast("long").alias("length"), F.xxhash64(normal).alias("hash"),
        F.lit(1).cast("long").alias("n_rows"), F.lit(None).cast("binary").alias("sha"),
    )
    local = keyed.mapInArrow(tidied(lambda batches: _owners(batches, text_col, budget, False)), keyed.schema)
    dealt = local.repartition("length", "hash").sortWithinPartitions("length", "hash")
    return dealt.mapInArrow(tidied(lambda batches: _owners(batches, text_col, budget, True)), keyed.schema).select("row", "sha", "n_rows")


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows that stay, with the columns of `docs`: of equal texts the one with the smallest id.

    Null texts equal empty ones, null ids come last, and of rows with one id
    and text one stays. An empty table stays empty.
    """
    return owner_rows(docs, id_col, text_col).select("row.*")


def membership(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, keep_id, group_size, kept, text_sha256.

    Repeated rows of one id and text are one document, and all say the same.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    owners = owner_rows(slim).select(F.col("row.doc_id").alias("keep_id"), "sha", F.col("n_rows").alias("group_size"))
    members = slim.select("doc_id", F.unhex(F.sha2(one_space(), 256)).alias("sha"))
    return members.join(owners, "sha").select(
        "doc_id", "keep_id", "group_size", F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"),
    )

