"""Records of CSV files whose quoted cells span lines, read by many tasks.

Spark cuts a file at line ends near given bytes, so a split may begin inside a
quoted cell, and nothing in it tells. But a line can begin in two ways only,
in a quoted cell or at a record, so a split is a function from one of these to
the other. All splits are gone through at once for both beginnings; the functions
of a file's splits, composed in order, say how each of them really begins. Then
every task finds the records in its own splits. A record over several splits is
put together from their parts alone.

A cell is quoted if it begins with the quote; a doubled quote stands for one. A
quote elsewhere is a plain sign, and what follows the end of a quoted cell, up to
the next delimiter, belongs to it. Records end with a line feed, with or without
a carriage return before it. Empty lines between records are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from dataquay.session import scratch_dir

#: Splits up to which their table may be broadcast; beyond, lines are dealt by split and sorted.
BROADCAST_SPLITS = 100_000
SPLIT = ["path", "start", "size"]


def open_after(line: str, open_: bool, quote: str, sep: str) -> bool:
    """Whether the end of a line is inside a quoted cell, by whether its beginning is."""
    if quote not in line:
        return open_
    at = 0
    if not open_:
        open_ = line.startswith(quote)
        at = len(quote) if open_ else 0
    while True:
        if open_:
            end = line.find(quote, at)
            if end < 0:
                return True
            at = end + len(quote)
            if line.startswith(quote, at):
                at += len(quote)
                continue
        at = line.find(sep, at)
        if at < 0:
            return False
        at += len(sep)
        open_ = line.startswith(quote, at)
        at += len(quote) if open_ else 0


def lines_of(texts: DataFrame) -> DataFrame:
    """path, start, size (of the split), value of the lines of a text scan, in order within a split."""
    place = {"path": "file_path", "start": "file_block_start", "size": "file_block_length"}
    return texts.select(*[F.col(f"_metadata.{c}").alias(name) for name, c in place.items()], F.make_valid_utf8("value").alias("value"))


def _by_split(batches: Iterator[pa.RecordBatch], columns: tuple[str, ...]) -> Iterator[tuple]:
    """Each line as (whether its split is new, *columns); the first two columns tell the split."""
    split = None
    for batch in batches:
        for row in zip(*(batch.column(c).to_pylist() for c in columns)):
            yield (row[:2] != split, *row)
            split = row[:2]


def split_functions(lines: DataFrame, quote: str, sep: str) -> DataFrame:
    """One row per split: its end if it begins at a record, its end if it begins in a cell, and whether that cell ends in it."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, state = [], None
        for new, path, start, size, line in _by_split(batches, (*SPLIT, "value")):
            if new:
                state = [path, start, size, False, True, False]
                found.append(state)
            if quote in line:
                state[3:5] = open_after(line, state[3], quote, sep), open_after(line, state[4], quote, sep)
            state[5] = state[5] or not state[4]
        columns = list(zip(*found)) if found else [()] * 6
        types = (pa.string(), pa.int64(), pa.int64(), pa.bool_(), pa.bool_(), pa.bool_())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=[*SPLIT, "if_closed", "if_open", "ends"])

    return lines.mapInArrow(run, "path string, start long, size long, if_closed boolean, if_open boolean, ends boolean")


def compose(functions: DataFrame) -> DataFrame:
    """path, start, size, open (how each split begins), owner (the split where a record begins that goes on here, if any).

    A split either fixes its end, keeps how it began, or turns it round. So a
    beginning is the end that was last fixed, turned as often as splits have
    turned it since. One short row per split is sorted by file.
    """
    order = Window.partitionBy("path").orderBy("start")
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    fixed = F.col("if_closed") == F.col("if_open")
    turns = (F.col("if_closed") & ~F.col("if_open")).cast("long")
    counted = functions.withColumn("turned", F.sum(turns).over(order.rowsBetween(Window.unboundedPreceding, 0)))
    last = F.last(F.when(fixed, F.struct("if_closed", "turned")), ignorenulls=True).over(before)
    known = counted.withColumn("last", last).withColumn("turned_before", F.coalesce(F.lag("turned").over(order), F.lit(0)))
    odd = (F.col("turned_before") - F.coalesce("last.turned", F.lit(0))) % 2 == 1
    opened = known.withColumn("open", F.coalesce("last.if_closed", F.lit(False)) != odd)
    ends_open = F.when(F.col("open"), F.col("if_open")).otherwise(F.col("if_closed"))
    begins = F.when(ends_open & (~F.col("open") | F.col("ends")), F.col("start"))
    return opened.withColumn("owner", F.last(begins, ignorenulls=True).over(before)).select(*SPLIT, "open", "owner")


def _with_splits(lines: DataFrame, splits: DataFrame) -> DataFrame:
    """Lines with how their split begins, in order within a split.

    A line of a split that was not there when the splits were gone through ends the query.
    """
    if splits.limit(BROADCAST_SPLITS + 1).count() <= BROADCAST_SPLITS:
        placed = lines.join(F.broadcast(splits), SPLIT, "left")
    else:
        placed = lines.withColumn("place", F.monotonically_increasing_id()).join(splits, SPLIT, "left")
        placed = placed.repartition(*SPLIT).sortWithinPartitions(*SPLIT, "place").drop("place")
    changed = F.raise_error(F.lit("The files, or how they are split, have changed since the source was opened")).cast("boolean")
    return placed.withColumn("open", F.coalesce("open", changed))


def _pieces(lines: DataFrame, quote: str, sep: str, parts: bool) -> DataFrame:
    """Records that lie in one split, or the parts of those that don't: path, owner, start, record, first (of its file)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        held: list[str] = []
        split, owner, open_, first = None, None, False, False

        def told() -> pa.RecordBatch:
            columns = list(zip(*out)) if out else [()] * 5
            out.clear()
            return pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.int64(), pa.int64(), pa.string(), pa.bool_()))],
                names=["path", "owner", "start", "record", "first"],
            )

        size = 0
        for new, path, start, began_open, of, line in _by_split(batches, ("path", "start", "open", "owner", "value")):
            if new:
                if held and parts:  # the split before ends in a record that goes on
                    out.append((*split_owner(split, owner), "\n".join(held), first))
                split, owner, open_, held, first = (path, start), of if began_open else None, began_open, [], start == 0
            held.append(line)
            open_ = open_after(line, open_, quote, sep)
            if open_:
                continue
            if (owner is not None) == parts:
                out.append((path, owner, start, "\n".join(held), first))
                size += len(line)
            held, owner, first = [], None, False
            if len(out) >= 10_000 or size > 4_000_000:
                yield told()
                size = 0
        if held and parts:
            out.append((*split_owner(split, owner), "\n".join(held), first))
        yield told()

    def split_owner(split: tuple[str, int], owner: int | None) -> tuple[str, int, int]:
        return split[0], split[1] if owner is None else owner, split[1]

    return lines.select("path", "start", "open", "owner", "value").mapInArrow(run, "path string, owner long, start long, record string, first boolean")


def records(texts: DataFrame, quote: str, sep: str) -> DataFrame:
    """path, start (of the split a record begins in), record, first (of its file), of a text scan with line feeds as separators.

    The table of splits and the records over several splits are written to the
    shared folder; all other records come straight from the scan.
    """
    spark = texts.sparkSession
    lines = lines_of(texts)

    def written(df: DataFrame, label: str) -> DataFrame:
        path = scratch_dir(spark, label)
        df.write.parquet(path)
        return spark.read.schema(df.schema).parquet(path)

    splits = written(compose(split_functions(lines, quote, sep)), "csv-splits")
    placed = _with_splits(lines, splits)
    parts = _pieces(placed, quote, sep, parts=True)
    # A record that begins in a split is its last one; the parts of it are in order of splits.
    whole = parts.groupBy("path", "owner").agg(
        F.array_sort(F.collect_list(F.struct("start", "record"))).alias("parts"), F.min_by("first", "start").alias("first"),
    )
    spanning = written(whole.select(
        "path", F.col("owner").alias("start"), F.concat_ws("\n", "parts.record").alias("record"), "first",
    ), "csv-spanning")
    inside = _pieces(placed, quote, sep, parts=False).select("path", "start", "record", "first")
    found = inside.unionAll(spanning).withColumn("record", F.regexp_replace("record", r"\r\z", ""))
    return found.where("record <> ''")
