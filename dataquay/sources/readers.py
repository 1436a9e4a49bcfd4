"""Readers: from the description of a source to a DataFrame.

Text formats are read as text columns and converted later, so that a bad cell
can be told from a missing one. Gzip files are read by every reader here.
"""

from __future__ import annotations

import codecs
import re
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field, replace

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquay.functions.cells import missing_tokens
from dataquay.functions.convert import ERRORS, Attribute, convert_columns
from dataquay.functions.text import default_names, header_names, without_nul
from dataquay.functions.typemaps import schema_attributes
from dataquay.operators import infer
from dataquay.operators.catalog import sample_head
from dataquay.sources import multiline
from dataquay.vocabulary import NAMED_DELIMITERS, SAMPLE_ROWS, spark_type

BAD_RECORD = "_bad_record"


@dataclass(frozen=True)
class SourceSpec:
    """The fields of a catalog row that tell how to read a source."""

    format: str
    path: str | None = None
    scheme: str = "file"
    attributes: tuple[Attribute, ...] = ()
    attribute_delimiter: str | None = None
    text_delimiter: str | None = None
    treat_as_missing: str | None = None
    encoding: str | None = None
    is_first_line_header: bool = False
    is_multiline: bool = False
    command: str | None = None
    variables: Mapping[str, str | None] = field(default_factory=dict)
    storage_url: str | None = None
    use_options: Mapping[str, str] = field(default_factory=dict)

    @property
    def delimiter(self) -> str:
        given = self.attribute_delimiter or ","
        return NAMED_DELIMITERS.get(given, given)

    @property
    def tokens(self) -> list[str]:
        return missing_tokens(self.treat_as_missing)


class UnsupportedSource(ValueError):
    """No reader for this scheme and format."""


def exists(spark: SparkSession, path: str) -> bool:
    """Whether a path can be read at all."""
    try:
        spark.read.format("binaryFile").load(path)
    except AnalysisException:
        return False
    return True


def _spark_charset(encoding: str | None) -> str:
    """Charset name the JVM knows, for the names Python takes (utf8, latin1)."""
    name = codecs.lookup(encoding or "utf8").name
    return {"iso8859-1": "ISO-8859-1", "ascii": "US-ASCII"}.get(name, name)


def csv_options(spec: SourceSpec) -> dict[str, str]:
    quote = spec.text_delimiter or '"'
    return {
        "sep": spec.delimiter,
        "quote": quote,
        # Quotes inside quoted text are doubled, not escaped.
        "escape": quote,
        "encoding": _spark_charset(spec.encoding),
        "header": str(spec.is_first_line_header).lower(),
        "enforceSchema": "true",
        "multiLine": str(spec.is_multiline).lower(),
        "mode": "PERMISSIVE",
        "columnNameOfCorruptRecord": BAD_RECORD,
        **spec.use_options,
    }


#: The split a record begins in: its file, and the place there.
SPLIT = "_split"


def read_csv_text(spark: SparkSession, spec: SourceSpec, names: Sequence[str]) -> DataFrame:
    """The cells of a CSV source as text, ``_bad_record`` for rows of a wrong width, and ``_split``.

    Empty cells are empty text or NULL; cells a short row lacks are NULL, and
    cells a long row has too many are cut. Files of any form are read in splits.
    """
    schema = T.StructType([T.StructField(n, T.StringType()) for n in [*names, BAD_RECORD]])
    options = csv_options(spec)
    if not spec.is_multiline or not _splits_at_lines(options):
        rows = spark.read.schema(schema).options(**options).csv(spec.path)
        return rows.withColumn(SPLIT, F.struct("_metadata.file_path", "_metadata.file_block_start"))
    lines = _decoded(spark.read.option("lineSep", "\n").text(spec.path), _spark_charset(spec.encoding))
    found = multiline.records(lines, options["quote"], options["sep"])
    if options["header"] == "true":
        found = found.where("NOT first")
    parsed = F.from_csv("record", schema.simpleString(), {k: v for k, v in options.items() if k not in ("header", "enforceSchema", "encoding")})
    return found.select(parsed.alias("row"), F.struct("path", "start").alias(SPLIT)).select("row.*", SPLIT)


def _splits_at_lines(options: Mapping[str, str]) -> bool:
    """Whether the lines of a file can be told without its quotes, and cells by one quote and one delimiter."""
    plain = not options["encoding"].startswith("utf-1") and not options["encoding"].startswith("utf-3")
    return plain and len(options["quote"]) == 1 and options["escape"] == options["quote"] and not {"lineSep", "comment"} & set(options)


def read_csv(
    spark: SparkSession, spec: SourceSpec, skip_malformed: bool = False
) -> DataFrame:
    """A CSV source in its declared types, with ``_errors`` per row.

    ``skip_malformed`` drops the rows of a wrong width; a cell that does not
    fit its type never drops a row.
    """
    names = [a.name for a in spec.attributes]
    raw = read_csv_text(spark, spec, names)
    if skip_malformed:
        raw = raw.where(F.col(BAD_RECORD).isNull())
    return convert_columns(raw, spec.attributes, spec.tokens)


def read_csv_unschematised(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """A CSV source without declared columns: the first of its cells, which ``;`` ends.

    A quoted cell may hold a ``;``. The header line is skipped, and so are empty lines.
    """
    options = csv_options(replace(spec, attribute_delimiter=";", text_delimiter='"'))
    del options["columnNameOfCorruptRecord"]
    rows = spark.read.schema("row string").options(**options).csv(spec.path)
    return rows.select(F.trim(F.coalesce("row", F.lit(""))).alias("row"))


def _lines(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """The lines of a source, as ``value``. Its encoding must end lines as ASCII does."""
    charset = _spark_charset(spec.encoding)
    if charset.startswith("utf-") and charset != "utf-8":
        raise UnsupportedSource(f"No line reader for encoding {spec.encoding}")
    return _decoded(spark.read.text(spec.path), charset).select("value")


def _decoded(lines: DataFrame, charset: str) -> DataFrame:
    if charset in ("utf-8", "US-ASCII"):
        return lines
    return lines.withColumn("value", F.decode(F.col("value").cast("binary"), charset))


def read_json_lines(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """One JSON object per line: in the declared columns, else as VARIANT.

    VARIANT keeps the shape of every row; a line that is not JSON is NULL. In
    declared columns ``_errors`` lists the values that do not fit their type,
    and a line that is not JSON.
    """
    lines = _lines(spark, spec)
    if not spec.attributes:
        return lines.select(F.try_parse_json("value").alias("value"))
    fields = [T.StructField(n, T.StringType()) for n in [*(a.name for a in spec.attributes), BAD_RECORD]]
    options = {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": BAD_RECORD}
    parsed = lines.where(F.trim("value") != "").select(F.from_json("value", T.StructType(fields), options).alias("row"))
    typed = convert_columns(parsed.select("row.*"), spec.attributes, keep=[BAD_RECORD])
    broken = F.array(F.concat(F.lit("<Invalid row>: `"), F.col(BAD_RECORD), F.lit("`")))
    errors = F.when(F.col(BAD_RECORD).isNull(), F.col(ERRORS)).otherwise(broken)
    return typed.withColumn(ERRORS, errors).drop(BAD_RECORD)


def read_parquet(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """A Parquet file or folder, in its own schema or in declared columns.

    In declared columns ``_errors`` lists the values that do not fit their
    type; they are NULL.
    """
    df = spark.read.parquet(spec.path)
    if not spec.attributes:
        return df
    present = set(df.columns)
    columns, errors = [], []
    for a in spec.attributes:
        target = spark_type(a.type, a.precision, a.scale)
        if a.name not in present:
            value = F.lit(None).cast(target)
        elif df.schema[a.name].dataType == target:
            value = F.col(f"`{a.name}`")
        else:
            given = F.col(f"`{a.name}`")
            value = given.try_cast(target)
            shown = F.concat(F.lit(f"{a.name}: <Invalid data>: `"), F.coalesce(given.try_cast("string"), F.lit("")), F.lit("`"))
            errors.append(F.when(given.isNotNull() & value.isNull(), shown))
        columns.append(value.alias(a.name))
    listed = F.array_compact(F.array(*errors)) if errors else F.array().cast("array<string>")
    return df.select(*columns, listed.alias(ERRORS))


def read_text(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """Lines of text; a TEXT source never has attributes."""
    return _lines(spark, spec)


def run_command(
    spark: SparkSession, command: str, variables: Mapping[str, str | None] | None = None
) -> DataFrame:
    """Run a source's SQL over Spark tables and views.

    Variables are named parameters (``:name``), passed as values and never
    pasted into the text.
    """
    if not command or not command.strip():
        raise ValueError("Data source does not have a command specified")
    return spark.sql(command, args=dict(variables or {}))


def read_command(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """A command-backed source; declared attributes rename columns by position."""
    df = run_command(spark, spec.command, spec.variables)
    return df.toDF(*[a.name for a in spec.attributes]) if spec.attributes else df


def with_defaults(variables: Mapping[str, str | None], defaults: Mapping[str, str | None]) -> dict:
    """Values for a command's variables: the given ones, else their defaults."""
    return {name: variables.get(name) if variables.get(name) is not None else default
            for name, default in defaults.items()}


def jdbc_options(spec: SourceSpec) -> dict[str, str]:
    """Options for Spark's JDBC reader; credentials come from the URL.

    The user and password stand before the host, or else in the query string.
    A read that ``use_options`` partitions takes the command as a derived
    table, which is the form Spark can split.
    """
    from urllib.parse import parse_qs, urlsplit

    url = urlsplit(spec.storage_url or spec.path or "")
    asked = parse_qs(url.query)
    port = f":{url.port}" if url.port else (":3306" if url.scheme == "mysql" else "")
    options = {
        "url": f"jdbc:{url.scheme}://{url.hostname}{port}{url.path}",
        **spec.use_options,
    }
    if "partitionColumn" in options:
        options["dbtable"] = f"({spec.command}) AS source"
    else:
        options["query"] = spec.command or ""
    user = url.username or asked.get("user", [None])[0]
    password = url.password or asked.get("password", [None])[0]
    if user:
        options["user"] = user
    if password:
        options["password"] = password
    return options


def read_jdbc(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """A source behind JDBC. ``use_options`` may set partitionColumn and bounds."""
    return spark.read.format("jdbc").options(**jdbc_options(spec)).load()


def query_attributes(spark: SparkSession, command: str, variables: Mapping[str, str | None] | None = None) -> DataFrame:
    """The attributes a command yields, by analysis alone; nothing runs."""
    return schema_attributes(spark, run_command(spark, command, variables).schema)


def parquet_attributes(spark: SparkSession, path: str) -> DataFrame:
    """The attributes of a Parquet source; only a footer is read."""
    return schema_attributes(spark, spark.read.parquet(path).schema)


Reader = Callable[[SparkSession, SourceSpec], DataFrame]


def _read_local_csv(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """Rows of a wrong width are kept; without declared columns there is one."""
    return read_csv(spark, spec) if spec.attributes else read_csv_unschematised(spark, spec)


def _read_cluster_csv(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """Rows of a wrong width are skipped; undeclared columns come from the header."""
    return read_csv(spark, spec if spec.attributes else inferred_spec(spark, spec), skip_malformed=True)


FILE_READERS: dict[str, Reader] = {
    "JSON": read_json_lines,
    "PARQUET": read_parquet,
    "TEXT": read_text,
}
FILE_SCHEMES = ("file", "hdfs")
READERS: dict[tuple[str, str], Reader] = {
    **{(scheme, f): reader for scheme in FILE_SCHEMES for f, reader in FILE_READERS.items()},
    ("file", "CSV"): _read_local_csv,
    ("hdfs", "CSV"): _read_cluster_csv,
    ("mysql", "JDBC"): read_jdbc,
    ("hive", "HIVE"): read_command,
    ("hive2", "HIVE"): read_command,
}


def read_source(spark: SparkSession, spec: SourceSpec) -> DataFrame:
    """Read a source by its scheme and format."""
    reader = READERS.get((spec.scheme, spec.format))
    if reader is None:
        raise UnsupportedSource(f"Unsupported protocol {spec.scheme} for format {spec.format}")
    return reader(spark, spec)


def sample_source(spark: SparkSession, spec: SourceSpec, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows of a source, in its declared types."""
    return sample_head(read_source(spark, spec), rows)


# --- schema inference ------------------------------------------------------

def _cells_in_record(record: Column, spec: SourceSpec) -> Column:
    """How many cells a raw record has; delimiters in quoted text do not count."""
    quote = spec.text_delimiter or '"'
    quoted = f"\\Q{quote}\\E[^{re.escape(quote)}]*\\Q{quote}\\E"
    bare = F.regexp_replace(record, quoted, "")
    parts = F.length(bare) - F.length(F.replace(bare, F.lit(spec.delimiter), F.lit("")))
    return F.when(record.isNotNull(), F.floor(parts / len(spec.delimiter)) + 1)


def csv_header(spark: SparkSession, spec: SourceSpec) -> list[str]:
    """Attribute names of a CSV source, from its first record.

    One record is read; without a header line the names are ``attr0``, ...
    """
    options = {**csv_options(spec), "header": "false"}
    first = spark.read.options(**options).csv(spec.path).limit(1).collect()
    if not first:
        return []
    cells = [c or "" for c in first[0]]
    return header_names(cells) if spec.is_first_line_header else default_names(len(cells))



def infer_csv(spark: SparkSession, spec: SourceSpec, lines: int | None = None) -> DataFrame:
    """Infer the attributes of a CSV source from all of its records.

    ``lines`` asks for a preview of the first records; a type that a preview
    finds need not hold the rest. Records are in order of file, place in the
    file, and line. Quoted records may span lines when the source says so, and
    short rows say nothing about the columns they lack.
    """
    names = csv_header(spark, spec)
    if not names:
        return spark.createDataFrame([], INFERRED)
    # Header cells may repeat; columns are told apart by position here.
    read = read_csv_text(spark, spec, [f"_{i}" for i in range(len(names))])
    read = read if lines is None else read.limit(lines - int(spec.is_first_line_header))
    cells = [F.coalesce(without_nul(F.col(f"_{i}")), F.lit("")).alias(f"_{i}") for i in range(len(names))]
    width = _cells_in_record(F.col(BAD_RECORD), spec)
    rows = read.select(*cells, BAD_RECORD, "_split")
    inferred = infer.infer_columns(
        rows, [f"_{i}" for i in range(len(names))], missing=spec.tokens, width=width, split=F.col("_split")
    )
    shown = F.get(F.array(*[F.lit(n) for n in names]), F.col("position"))
    return inferred.withColumn("name", shown)


def voted_delimiter(spark: SparkSession, spec: SourceSpec) -> str:
    """The delimiter that occurs most often in all lines of a source; a comma where none does."""
    return infer.infer_delimiter(_lines(spark, spec), "value").first()["delimiter"]


def uploaded_spec(spark: SparkSession, path: str, **options) -> SourceSpec:
    """A CSV file as it was uploaded: the delimiter by vote, names by its first line, types by all of its records."""
    bare = SourceSpec("CSV", path, **options)
    return inferred_spec(spark, replace(bare, attribute_delimiter=voted_delimiter(spark, bare)))


def inferred_spec(spark: SparkSession, spec: SourceSpec) -> SourceSpec:
    """The source with columns named by its header and typed by its records."""
    headed = replace(spec, is_first_line_header=True)
    found = infer_csv(spark, headed).orderBy("position").collect()
    attributes = tuple(Attribute(r["name"], r["type"], r["precision"], r["scale"], r["format"]) for r in found)
    return replace(headed, attributes=attributes)


INFERRED = (
    "position int, name string, type string, size int, precision int, scale int, "
    "format string, nullable boolean"
)


def infer_csv_native(spark: SparkSession, spec: SourceSpec, ratio: float = 1.0) -> DataFrame:
    """The types Spark's own CSV inference finds, as attribute rows."""
    options = {k: v for k, v in csv_options(spec).items() if k != "enforceSchema"}
    df = spark.read.options(**options, inferSchema="true", samplingRatio=str(ratio)).csv(spec.path)
    return schema_attributes(spark, df.schema)


def infer_source(spark: SparkSession, spec: SourceSpec, lines: int | None = None) -> DataFrame:
    """Infer the attributes of a source, for the formats that allow it."""
    if spec.format == "CSV" and spec.scheme in FILE_SCHEMES:
        return infer_csv(spark, spec, lines)
    if spec.format == "PARQUET" and spec.scheme in FILE_SCHEMES:
        return parquet_attributes(spark, spec.path)
    if spec.format == "HIVE":
        return query_attributes(spark, spec.command, spec.variables)
    if spec.format == "JDBC":
        return schema_attributes(spark, read_jdbc(spark, spec).schema)
    raise UnsupportedSource(f"No schema inference for format {spec.format}")
