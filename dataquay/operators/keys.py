"""Foreign keys as data: read from a catalog, and found in the sources themselves."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquay.operators.relations import KeyPart, count_orphans, join_by_key
from dataquay.session import scratch_dir

#: Column numbers that one word of a set holds.
WORD_BITS = 62
#: How alike the names of a key's columns are at least, from 0 to 1.
LEAST_ALIKE = 0.8


class ForeignKey(NamedTuple):
    """A declared key: the rows of `child` refer to those of `parent`."""

    id: object
    child: object
    parent: object
    parts: tuple[KeyPart, ...]


def declared_keys(keys: DataFrame, pairs: DataFrame, attributes: DataFrame, sources: Sequence[object]) -> list[ForeignKey]:
    """The keys that the catalog declares between the given sources, in order of id.

    keys: id, from_source_id, to_source_id. pairs: foreign_key_id, order,
    direction, from_attribute_id, to_attribute_id. attributes: id,
    data_source_id, name. A pair with direction FROM is read as it stands, one
    with TO the other way round. Attributes must belong to the sources that the
    key names, and a key has one pair at least. Only the keys of these sources
    reach the driver.
    """
    wanted = [F.lit(s) for s in sources]
    keys = keys.where(F.col("from_source_id").isin(*wanted) & F.col("to_source_id").isin(*wanted))
    side = lambda s: attributes.select(F.col("id").alias(f"{s}_attribute_id"), F.col("data_source_id").alias(f"{s}_owner"), F.col("name").alias(f"{s}_name"))
    joined = keys.withColumnRenamed("id", "foreign_key_id").join(pairs, "foreign_key_id", "left")
    joined = joined.join(side("from"), "from_attribute_id", "left").join(side("to"), "to_attribute_id", "left")
    found: dict[object, list] = {}
    for r in joined.collect():
        found.setdefault(r["foreign_key_id"], []).append(r)
    out = []
    for key, rows in sorted(found.items()):
        parts = []
        for r in rows:
            ends = [(r["from_owner"], r["from_name"]), (r["to_owner"], r["to_name"])]
            if r["direction"] == "TO":
                ends.reverse()
            if [owner for owner, _ in ends] != [r["from_source_id"], r["to_source_id"]]:
                raise ValueError(f"Foreign key {key}: its attributes are not those of its sources")
            parts.append(KeyPart(r["order"], ends[0][1], ends[1][1]))
        out.append(ForeignKey(key, rows[0]["from_source_id"], rows[0]["to_source_id"], tuple(sorted(parts))))
    return out


def join_declared(tables: Mapping[object, DataFrame], keys: Sequence[ForeignKey], root: object, how: str = "left") -> DataFrame:
    """A source with the rows it refers to, directly or by way of others, along declared keys.

    Keys are followed outwards from `root`, nearest first; a source that several
    keys reach is joined once, by the first of them. Columns whose names are taken
    get the key's id and an underscore before them.
    """
    joined, reached, names = tables[root], [root], {root: {c: c for c in tables[root].columns}}
    for source in reached:
        for key in keys:
            if key.child != source or key.parent in reached:
                continue
            parent = tables[key.parent]
            renamed = {c: c if c not in joined.columns else f"{key.id}_{c}" for c in parent.columns}
            parts = [KeyPart(p.order, names[source][p.from_attribute], renamed[p.to_attribute]) for p in key.parts]
            joined = join_by_key(joined, parent.withColumnsRenamed(renamed), parts, how)
            names[key.parent] = renamed
            reached.append(key.parent)
    return joined


def count_declared_orphans(tables: Mapping[object, DataFrame], keys: Sequence[ForeignKey]) -> DataFrame:
    """One row (fk, child_rows, orphan_rows) per declared key."""
    counted = [count_orphans(str(k.id), tables[k.child], tables[k.parent], k.parts) for k in keys]
    return reduce(DataFrame.unionAll, counted)


# --- discovery -------------------------------------------------------------

def _kind(dtype: T.DataType) -> str | None:
    """Columns of one kind may refer to each other; fractions, lists and the like are no keys."""
    if isinstance(dtype, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return "whole"
    if isinstance(dtype, T.StringType):
        return "text"
    if isinstance(dtype, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        return "time"
    return None


class Place(NamedTuple):
    table: str
    column: str
    kind: str


def _places(tables: Mapping[str, DataFrame]) -> list[Place]:
    fields = [(name, f.name, _kind(f.dataType)) for name, df in tables.items() for f in df.schema.fields]
    return [Place(*f) for f in fields if f[2]]


def _cell_counts(tables: Mapping[str, DataFrame], places: Sequence[Place]) -> DataFrame:
    """(place, hash, n): how often each value occurs in each column. One pass over each table."""
    parts = []
    for name, df in tables.items():
        mine = [(i, p) for i, p in enumerate(places) if p.table == name]
        if not mine:
            continue
        cells = [F.struct(F.lit(i).alias("place"), F.when(F.col(f"`{p.column}`").isNotNull(), F.xxhash64(F.lit(p.kind), F.col(f"`{p.column}`").cast("string"))).alias("hash")) for i, p in mine]
        parts.append(df.select(F.explode(F.array(*cells)).alias("c")).select("c.*").where("hash IS NOT NULL"))
    return reduce(DataFrame.unionAll, parts).groupBy("place", "hash").agg(F.count("*").alias("n"))


def inclusions(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Pairs of columns of which the first has no value that the second lacks, and the second none twice.

    from_table, from_column, to_table, to_column, from_distinct, to_distinct.
    Every value is hashed once, and told which columns have it, as a set of
    column numbers; a column is included in those that are in the sets of all of
    its values. Two short words per value cross the network, whatever the number
    of pairs. A column without values is included in none. Equal hashes of unequal
    values can only add pairs; :func:`discover` checks those that it reports.
    """
    spark = next(iter(tables.values())).sparkSession
    places = _places(tables)
    shown = "from_table string, from_column string, to_table string, to_column string, from_distinct long, to_distinct long"
    if not places:
        return spark.createDataFrame([], shown)
    path = scratch_dir(spark, "column-values")
    counted = _cell_counts(tables, places)
    counted.write.parquet(path)
    counted = spark.read.schema(counted.schema).parquet(path)
    words = range(-(-len(places) // WORD_BITS))

    def bit(place: Column, word: int) -> Column:
        inside = (place >= word * WORD_BITS) & (place < (word + 1) * WORD_BITS)
        return F.when(inside, F.call_function("shiftleft", F.lit(1).cast("long"), place - word * WORD_BITS)).otherwise(F.lit(0).cast("long"))

    held = counted.groupBy("hash").agg(
        *[F.bit_or(bit(F.col("place"), w)).alias(f"w{w}") for w in words], F.collect_list(F.struct("place", "n")).alias("places"),
    )
    # A list has a place for each column at most.
    each = held.select(F.explode("places").alias("p"), *[f"w{w}" for w in words]).select("p.*", *[f"w{w}" for w in words])
    sets = each.groupBy("place").agg(
        F.count("*").alias("distinct"), F.max("n").alias("most"), *[F.bit_and(f"w{w}").alias(f"w{w}") for w in words],
    ).collect()
    known = {r["place"]: r for r in sets}
    rows = []
    for i, r in known.items():
        for j, parent in known.items():
            if i != j and r[f"w{j // WORD_BITS}"] >> j % WORD_BITS & 1 and parent["most"] == 1:
                rows.append((places[i].table, places[i].column, places[j].table, places[j].column, r["distinct"], parent["distinct"]))
    return spark.createDataFrame(rows, shown)


def alike(a: Column, b: Column) -> Column:
    """How alike two names are: 1 less the share of signs to be edited."""
    return F.lit(1.0) - F.levenshtein(a, b) / F.greatest(F.length(a), F.length(b))


def discover(tables: Mapping[str, DataFrame], least: float = LEAST_ALIKE) -> DataFrame:
    """The foreign keys of one column that the data bear out and the names suggest.

    Of the inclusions of a column in others, the one with the likest names counts
    (then the larger share of the parent's values, then by name). Each key is
    checked for orphans on the values themselves. Rows as of :func:`inclusions`,
    with `alike` and `coverage`, the share of the parent's values that occur.
    """
    shown = inclusions(tables).withColumn("alike", alike(F.col("from_column"), F.col("to_column")))
    shown = shown.withColumn("coverage", F.col("from_distinct") / F.col("to_distinct")).where(F.col("alike") >= least)
    order = F.struct((-F.col("alike")).alias("a"), (-F.col("coverage")).alias("c"), "to_table", "to_column")
    best = shown.groupBy("from_table", "from_column").agg(F.min_by(F.struct("to_table", "to_column", "from_distinct", "to_distinct", "alike", "coverage"), order).alias("best"))
    # One row per column of the sources at most.
    rows = best.select("from_table", "from_column", "best.*").collect()
    held = [r for r in rows if _holds(tables, r)]
    return shown.sparkSession.createDataFrame(held, "from_table string, from_column string, to_table string, to_column string, from_distinct long, to_distinct long, alike double, coverage double")


def _holds(tables: Mapping[str, DataFrame], r) -> bool:
    part = KeyPart(0, r["from_column"], r["to_column"])
    return count_orphans("", tables[r["from_table"]], tables[r["to_table"]], [part]).first()["orphan_rows"] == 0


def as_keys(found: DataFrame) -> list[ForeignKey]:
    """Discovered keys in the form of declared ones, numbered by name."""
    rows = sorted(found.collect(), key=lambda r: (r["from_table"], r["from_column"]))
    return [ForeignKey(i, r["from_table"], r["to_table"], (KeyPart(0, r["from_column"], r["to_column"]),)) for i, r in enumerate(rows)]
