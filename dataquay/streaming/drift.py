"""Incremental ingest of a folder whose files change their columns.

Files of a source come to have new columns, lose some, or carry text where numbers
were. Each new file is read in its own columns; what was declared is converted as
declared, whatever its place in the file; what was not is kept as text beside it; and
each file's differences are listed.
"""

from __future__ import annotations

import json
from collections import defaultdict
from collections.abc import Iterable, Sequence
from dataclasses import replace
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dataquay.functions.convert import ERRORS, convert_columns
from dataquay.functions.locations import without_patterns
from dataquay.sources.readers import BAD_RECORD, SPLIT, SourceSpec, UnsupportedSource, csv_header, read_csv_text

FILE, EXTRA, CELLS = "_file", "_extra", "_cells"
FORMATS = ("CSV", "JSON", "PARQUET")
_ARRIVALS = "path string, modificationTime timestamp, length long, content binary"
_TEXTS = T.MapType(T.StringType(), T.StringType())


def _as_text(df: DataFrame, name: str) -> Column:
    c = F.col(f"`{name}`")
    nested = isinstance(df.schema[name].dataType, (T.ArrayType, T.StructType, T.MapType))
    return (F.to_json(c) if nested else c).cast("string")


def _cells(df: DataFrame, names: Sequence[str], file: Column, bad: Column) -> DataFrame:
    """Rows of one kind of file as (file, bad record, text cells by column name)."""
    pairs = [x for n in names for x in (F.lit(n), _as_text(df, n))]
    cells = F.create_map(*pairs) if pairs else F.lit(None).cast(_TEXTS)
    return df.select(file.alias(FILE), bad.alias(BAD_RECORD), F.coalesce(cells, F.create_map().cast(_TEXTS)).alias(CELLS))


def _csv_kinds(spark: SparkSession, spec: SourceSpec, files: Iterable[str]) -> list[DataFrame]:
    kinds = defaultdict(list)
    for path in files:
        kinds[tuple(csv_header(spark, replace(spec, path=path)))].append(path)
    found = []
    for names, paths in kinds.items():
        rows = read_csv_text(spark, replace(spec, path=paths), names)
        file = F.col(SPLIT)[rows.schema[SPLIT].dataType.fieldNames()[0]]
        found.append(_cells(rows, names, file, F.col(BAD_RECORD)))
    return found


def _parquet_kinds(spark: SparkSession, files: Iterable[str]) -> list[DataFrame]:
    kinds = defaultdict(list)
    for path in files:
        kinds[spark.read.parquet(path).schema.json()].append(path)
    readers = [spark.read.schema(T.StructType.fromJson(json.loads(kind))).parquet(*paths) for kind, paths in kinds.items()]
    return [_cells(df, df.columns, F.col("_metadata.file_path"), F.lit(None).cast("string")) for df in readers]


def _json_rows(spark: SparkSession, files: Sequence[str]) -> DataFrame:
    """JSON lines: each row has its own columns."""
    lines = spark.read.text(list(files)).where(F.trim("value") != "")
    row = F.from_json("value", _TEXTS)
    bad = F.when(F.try_parse_json("value").isNull() | row.isNull(), F.col("value"))
    return lines.select(F.col("_metadata.file_path").alias(FILE), bad.alias(BAD_RECORD), F.coalesce(row, F.create_map().cast(_TEXTS)).alias(CELLS))


def rows_by_name(spark: SparkSession, spec: SourceSpec, files: Sequence[str]) -> DataFrame:
    """The rows of some files in the declared columns, whatever columns each file has.

    Beside them are ``_file``, ``_extra`` (the cells of other columns, as text),
    ``_bad_record`` (a row of a wrong width, or one that is no JSON object) and
    ``_errors`` (cells that do not fit). Names count, places do not. A plan has one
    branch for each different list of columns.
    """
    if spec.format == "JSON":
        kinds = [_json_rows(spark, files)]
    elif spec.format == "CSV":
        kinds = _csv_kinds(spark, spec, files)
    else:
        kinds = _parquet_kinds(spark, files)
    cells = reduce(DataFrame.unionByName, kinds)
    declared = [a.name for a in spec.attributes]
    others = F.map_filter(CELLS, lambda k, v: ~k.isin(declared))
    texts = cells.select(
        *[F.try_element_at(CELLS, F.lit(n)).alias(n) for n in declared],
        FILE, BAD_RECORD, others.alias(EXTRA), F.map_keys(CELLS).alias("_names"),
    )
    return convert_columns(texts, spec.attributes, spec.tokens, keep=[FILE, BAD_RECORD, EXTRA, "_names"])


def file_differences(rows: DataFrame, declared: Sequence[str]) -> DataFrame:
    """One row per file: its rows, those set aside, and its missing, added and misfitting columns.

    A column is missing when no row of the file has it, added when some row has one
    that was not declared, and misfits when a cell does not fit its declared type.
    Rows that cannot be read as such say nothing about columns.
    """
    read = F.col(BAD_RECORD).isNull()
    totals = rows.groupBy(FILE).agg(F.count("*").alias("rows"), F.count_if(~_good()).alias("rejected"))
    # Distinct lists of columns first: a file has few, however many rows.
    names = rows.where(read).select(FILE, F.array_sort("_names").alias("names")).distinct()
    names = names.groupBy(FILE).agg(F.array_distinct(F.flatten(F.collect_set("names"))).alias("names"))
    wrong = rows.where(read).select(FILE, F.explode(ERRORS).alias("message"))
    wrong = wrong.select(FILE, F.substring_index("message", ": <", 1).alias("name")).distinct()
    wrong = wrong.groupBy(FILE).agg(F.array_sort(F.collect_set("name")).alias("misfits"))
    known, none = F.array(*[F.lit(n) for n in declared]), F.array().cast("array<string>")
    return totals.join(names, FILE, "left").join(wrong, FILE, "left").select(
        F.col(FILE).alias("file"), "rows", "rejected",
        F.when(F.col("names").isNotNull(), F.array_sort(F.array_except(known, "names"))).otherwise(none).alias("missing"),
        F.when(F.col("names").isNotNull(), F.array_sort(F.array_except("names", known))).otherwise(none).alias("added"),
        F.coalesce("misfits", none).alias("misfits"),
    )


def _good() -> Column:
    return F.col(BAD_RECORD).isNull() & (F.size(ERRORS) == 0)


def ingest_files(spark: SparkSession, spec: SourceSpec, root: str, max_files: int = 200, **trigger) -> StreamingQuery:
    """Take the new CSV (with headers), JSON-lines or Parquet files of a folder as they come.

    ``root/rows`` has the good rows in the declared columns with ``_file`` and
    ``_extra``; ``root/rejected`` the others with the reasons; ``root/files`` what
    :func:`file_differences` says of each file that has a row. The stream is one of
    file names, and a batch has ``max_files`` of them at most: so many headers or
    footers are read by the driver, one small job each. A batch overwrites the folders of its own number,
    so running it again changes nothing. Empty files have no row anywhere.
    """
    if spec.format not in FORMATS or not spec.attributes:
        raise UnsupportedSource(f"Files of {spec.format} need a reader by name, and declared columns")
    if spec.format == "CSV" and not spec.is_first_line_header:
        raise UnsupportedSource("CSV files without a header have no names to go by")
    arrivals = (
        spark.readStream.format("binaryFile").schema(_ARRIVALS).option("maxFilesPerTrigger", max_files).load(spec.path)
        .where("length > 0").select("path")
    )
    declared = [a.name for a in spec.attributes]

    def take(batch: DataFrame, batch_id: int) -> None:
        # A stream may name a file twice in a batch, as it does when a neighbour's name has signs of a pattern.
        files = sorted({without_patterns(row["path"]) for row in batch.collect()})
        if not files:
            return
        # Written once: rows, rejects and differences are all taken from the copy.
        staged = f"{root}/staged/batch={batch_id}"
        rows_by_name(spark, spec, files).write.mode("overwrite").parquet(staged)
        rows = spark.read.parquet(staged)
        kept = [*declared, FILE, EXTRA]
        rows.where(_good()).select(*kept).write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")
        rows.where(~_good()).drop("_names").write.mode("overwrite").parquet(f"{root}/rejected/batch={batch_id}")
        file_differences(rows, declared).write.mode("overwrite").parquet(f"{root}/files/batch={batch_id}")

    return (
        arrivals.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
