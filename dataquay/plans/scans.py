"""Sources, sinks, locations and names.

Round trips write a whole table with Spark, read it back through a reader, and
are checked against the table itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquay.functions import documents as D
from dataquay.functions import locations as L
from dataquay.functions import text as X
from dataquay.functions.convert import ERRORS, Attribute, columns_with_errors, convert_columns
from dataquay.operators import uploads as U
from dataquay.operators.profile import profile_missing
from dataquay.plans import stand_ins as S
from dataquay.plans.registry import Tables, query
from dataquay.session import scratch_dir
from dataquay.sources import readers as R
from dataquay.sources import writers as W

ORDER_ATTRIBUTES = (
    Attribute("o_orderkey", "LONG"),
    Attribute("o_custkey", "LONG"),
    Attribute("o_orderstatus", "CHARACTER"),
    Attribute("o_totalprice", "DECIMAL", 18, 2),
    Attribute("o_orderdate", "DATETIME"),
    Attribute("o_orderpriority", "CHARACTER"),
)


def _money(c: str) -> Column:
    """Amounts as text with two places, the same in every engine."""
    return F.col(c).cast("decimal(18,2)").cast("string").alias(c)


def _day(c: str) -> Column:
    return F.date_format(c, "yyyy-MM-dd").alias(c)


def _orders_csv(t: Tables, status: Column | None = None) -> str:
    """Orders as CSV files; returns their folder."""
    path = scratch_dir(t.spark, "orders-csv")
    rows = t.orders.withColumn("o_totalprice", F.col("o_totalprice").cast("decimal(18,2)"))
    if status is not None:
        rows = rows.withColumn("o_orderstatus", status)
    W.export_csv(rows, path)
    return path


def _csv_spec(path: str, **more) -> R.SourceSpec:
    return R.SourceSpec("CSV", path, attributes=ORDER_ATTRIBUTES, is_first_line_header=True, **more)


ORDERS_TEXT = """SELECT o_orderkey, o_custkey, o_orderstatus,
       CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice,
       strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority, CAST(0 AS BIGINT) AS errors
FROM orders"""


def _orders_text(df: DataFrame) -> DataFrame:
    return df.select(
        "o_orderkey", "o_custkey", "o_orderstatus", _money("o_totalprice"), _day("o_orderdate"),
        "o_orderpriority", F.size(ERRORS).cast("long").alias("errors"),
    )


@query("csv_scan", ORDERS_TEXT)
def csv_scan(t: Tables) -> DataFrame:
    return _orders_text(R.read_source(t.spark, _csv_spec(_orders_csv(t))))


@query("csv_scan_limit", "SELECT least(count(*), 1000) AS sampled, least(count(*), 1000) AS known FROM orders")
def csv_scan_limit(t: Tables) -> DataFrame:
    sample = R.sample_source(t.spark, _csv_spec(_orders_csv(t)), 1000)
    known = t.orders.select(F.col("o_orderkey").alias("_key"), F.col("o_custkey").alias("_customer"))
    same = (sample["o_orderkey"] == known["_key"]) & (sample["o_custkey"] == known["_customer"])
    return sample.join(known, same, "left").agg(F.count("*").alias("sampled"), F.count("_key").alias("known"))


@query("csv_scan_cluster", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'""")
def csv_scan_cluster(t: Tables) -> DataFrame:
    """The cluster reader: rows of a wrong width are skipped, whatever the other cells are."""
    return R.read_source(t.spark, R.SourceSpec("CSV", _ragged_csv(t), scheme="hdfs", attributes=ORDER_ATTRIBUTES[:3])).drop(ERRORS)


@query("csv_upload", "SELECT CAST(o_orderkey AS INTEGER) AS o_orderkey, o_orderpriority, CAST(o_custkey AS INTEGER) AS o_custkey FROM orders")
def csv_upload(t: Tables) -> DataFrame:
    """Delimiter, names and types of a new file are all found in it."""
    path = scratch_dir(t.spark, "uploaded-csv")
    t.orders.select("o_orderkey", "o_orderpriority", "o_custkey").write.options(header=True, sep=";").csv(path)
    return R.read_source(t.spark, R.uploaded_spec(t.spark, path)).drop(ERRORS)


@query("missing_tokens", """
SELECT o_orderkey, nullif(nullif(o_orderstatus, 'F'), 'P') AS o_orderstatus, o_orderpriority FROM orders""")
def missing_tokens(t: Tables) -> DataFrame:
    status = F.when(F.col("o_orderstatus") == "F", "NA").when(F.col("o_orderstatus") == "P", "").otherwise("O")
    spec = _csv_spec(_orders_csv(t, status), treat_as_missing="NA,-")
    return R.read_source(t.spark, spec).select("o_orderkey", "o_orderstatus", "o_orderpriority")


def _ragged_csv(t: Tables) -> str:
    """Finished orders lose their last cell, pending ones have one too many."""
    path = scratch_dir(t.spark, "ragged-csv")
    cells = ["o_orderkey", "o_custkey", "o_orderstatus"]
    line = F.concat_ws(",", *cells)
    ragged = F.when(F.col("o_orderstatus") == "F", F.concat_ws(",", *cells[:2]))
    ragged = ragged.when(F.col("o_orderstatus") == "P", F.concat(line, F.lit(",extra"))).otherwise(line)
    t.orders.select(ragged).write.text(path)
    return path


@query("csv_skip_malformed", """
SELECT o_orderkey, o_custkey, o_orderstatus FROM orders WHERE o_orderstatus = 'O'""")
def csv_skip_malformed(t: Tables) -> DataFrame:
    path = _ragged_csv(t)
    spec = R.SourceSpec("CSV", path, attributes=ORDER_ATTRIBUTES[:3])
    return R.read_csv(t.spark, spec, skip_malformed=True).drop(ERRORS)


@query("csv_keep_malformed", """
SELECT o_orderkey, o_custkey, nullif(o_orderstatus, 'F') AS o_orderstatus FROM orders""")
def csv_keep_malformed(t: Tables) -> DataFrame:
    path = _ragged_csv(t)
    spec = R.SourceSpec("CSV", path, attributes=ORDER_ATTRIBUTES[:3])
    return R.read_source(t.spark, spec).drop(ERRORS)


@query("csv_multiline", "SELECT doc_id, trim(text, chr(32)) AS text, lang FROM documents")
def csv_multiline(t: Tables) -> DataFrame:
    """Whole texts with line ends, quotes and delimiters survive a CSV round trip."""
    path = scratch_dir(t.spark, "documents-csv")
    W.export_csv(t.documents.select("doc_id", "text", "lang"), path)
    attributes = (Attribute("doc_id", "LONG"), Attribute("text", "TEXT"), Attribute("lang", "CHARACTER"))
    spec = R.SourceSpec("CSV", path, attributes=attributes, is_first_line_header=True, is_multiline=True)
    return R.read_source(t.spark, spec).drop(ERRORS)


@query("csv_multiline_types", """
SELECT 'doc_id' AS name, 'INTEGER' AS type, CAST(NULL AS INTEGER) AS size UNION ALL
SELECT 'text', CASE WHEN max(length(text)) > 1000 THEN 'TEXT' ELSE 'CHARACTER' END, CAST(max(length(text)) AS INTEGER) FROM documents UNION ALL
SELECT 'lang', 'CHARACTER', CAST(max(length(lang)) AS INTEGER) FROM documents""")
def csv_multiline_types(t: Tables) -> DataFrame:
    """Types and sizes of whole records, as one file of many splits may hold them."""
    path = scratch_dir(t.spark, "documents-csv")
    W.export_csv(t.documents.select("doc_id", "text", "lang"), path)
    spec = R.SourceSpec("CSV", path, is_first_line_header=True, is_multiline=True)
    return R.infer_csv(t.spark, spec).select("name", "type", "size")


@query("csv_unschematised", """
SELECT trim(split_part(line, ';', 1)) AS "row", count(*) AS n
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM documents) WHERE trim(line) <> '' GROUP BY 1""")
def csv_unschematised(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "lines")
    t.documents.select("text").write.text(path)
    rows = R.read_source(t.spark, R.SourceSpec("CSV", path))
    return rows.groupBy("row").agg(F.count("*").alias("n"))


@query("jsonl_scan", """
SELECT json_extract_string(props, '$.k')::BIGINT AS k, count(*) AS n FROM events GROUP BY 1""")
def jsonl_scan(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "jsonl")
    t.events.select("props").write.option("compression", "gzip").text(path)
    rows = R.read_source(t.spark, R.SourceSpec("JSON", path))
    k = F.try_variant_get("value", "$.k", "bigint")
    return rows.select(k.alias("k")).groupBy("k").agg(F.count("*").alias("n"))


@query("jsonl_scan_declared", "SELECT event_id, user_id, event_type, value FROM events")
def jsonl_scan_declared(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "json")
    t.events.select("event_id", "user_id", "event_type", "value").write.json(path)
    attributes = (
        Attribute("event_id", "LONG"), Attribute("user_id", "LONG"),
        Attribute("event_type", "CHARACTER"), Attribute("value", "DOUBLE"),
    )
    return R.read_source(t.spark, R.SourceSpec("JSON", path, attributes=attributes)).drop(ERRORS)


@query("parquet_scan", "SELECT * FROM customer")
def parquet_scan(t: Tables) -> DataFrame:
    return R.read_source(t.spark, R.SourceSpec("PARQUET", t.path("customer")))


@query("parquet_scan_declared", """
SELECT CAST(c_custkey AS INTEGER) AS c_custkey, CAST(c_nationkey AS VARCHAR) AS c_nationkey,
       CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS c_acctbal, CAST(NULL AS VARCHAR) AS c_note
FROM customer""")
def parquet_scan_declared(t: Tables) -> DataFrame:
    attributes = (
        Attribute("c_custkey", "INTEGER"), Attribute("c_nationkey", "CHARACTER"),
        Attribute("c_acctbal", "DECIMAL", 18, 2), Attribute("c_note", "TEXT"),
    )
    rows = R.read_source(t.spark, R.SourceSpec("PARQUET", t.path("customer"), attributes=attributes))
    return rows.withColumn("c_acctbal", F.col("c_acctbal").cast("string")).drop(ERRORS)


@query("text_scan", """
SELECT line AS value, count(*) AS n
FROM (SELECT unnest(string_split(text, chr(10))) AS line FROM benchmark) GROUP BY 1""")
def text_scan(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "text")
    t.benchmark.select("text").write.text(path)
    return R.read_source(t.spark, R.SourceSpec("TEXT", path)).groupBy("value").agg(F.count("*").alias("n"))


# --- commands --------------------------------------------------------------

@query("command_scan", "SELECT o_orderpriority, count(*) AS orders, count(DISTINCT o_custkey) AS customers FROM orders GROUP BY 1")
def command_scan(t: Tables) -> DataFrame:
    t.view("orders")
    command = (
        "SELECT o_orderpriority, count(*) AS orders, count(DISTINCT o_custkey) AS customers "
        "FROM orders GROUP BY o_orderpriority"
    )
    return R.read_source(t.spark, R.SourceSpec("HIVE", scheme="hive2", command=command))


@query("command_scan_renamed", "SELECT c_custkey AS key, n_name AS country FROM customer JOIN nation ON n_nationkey = c_nationkey")
def command_scan_renamed(t: Tables) -> DataFrame:
    t.view("customer", "nation")
    command = "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey"
    names = (Attribute("key", "LONG"), Attribute("country", "CHARACTER"))
    return R.read_source(t.spark, R.SourceSpec("HIVE", scheme="hive2", command=command, attributes=names))


@query("command_scan_params", """
SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey
WHERE n_regionkey = 2 AND c_mktsegment <> 'MACHINERY'""")
def command_scan_params(t: Tables) -> DataFrame:
    t.view("customer", "nation")
    command = (
        "SELECT c_custkey, n_name FROM customer JOIN nation ON n_nationkey = c_nationkey "
        "WHERE n_regionkey = cast(:region AS int) AND c_mktsegment <> :segment"
    )
    values = R.with_defaults({"region": "2"}, {"region": "0", "segment": "MACHINERY"})
    return R.run_command(t.spark, command, values)


def _observed(declared: DataFrame, rows: DataFrame) -> DataFrame:
    """Declared attributes next to what the data shows: rows that lack a value."""
    return declared.join(profile_missing(rows).select("name", "missing_total"), "name").select(
        "position", "name", "type", "missing_total"
    )


@query("probe_query_schema", """
SELECT * FROM (VALUES (0, 'status', 'CHARACTER'), (1, 'total', 'DOUBLE'), (2, 'orders', 'LONG')) v(position, name, type),
(SELECT CAST(0 AS BIGINT) AS missing_total FROM (SELECT count(o_orderkey) FROM orders))""")
def probe_query_schema(t: Tables) -> DataFrame:
    t.view("orders")
    command = "SELECT o_orderstatus AS status, sum(o_totalprice) AS total, count(*) AS orders FROM orders GROUP BY 1"
    return _observed(R.query_attributes(t.spark, command), R.run_command(t.spark, command))


@query("infer_parquet_schema", """
SELECT * FROM (VALUES
  (0, 'event_id', 'LONG', (SELECT count(*) - count(event_id) FROM events)),
  (1, 'ts', 'DATETIME', (SELECT count(*) - count(ts) FROM events)),
  (2, 'user_id', 'LONG', (SELECT count(*) - count(user_id) FROM events)),
  (3, 'event_type', 'CHARACTER', (SELECT count(*) - count(event_type) FROM events)),
  (4, 'value', 'DOUBLE', (SELECT count(*) - count(value) FROM events)),
  (5, 'props', 'CHARACTER', (SELECT count(*) - count(props) FROM events))
) v(position, name, type, missing_total)""")
def infer_parquet_schema(t: Tables) -> DataFrame:
    return _observed(R.parquet_attributes(t.spark, t.path("events")), t.events)


# --- exports ---------------------------------------------------------------

@query("export_csv", """
SELECT c_custkey, c_name, c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) AS c_acctbal, c_mktsegment
FROM customer""")
def export_csv(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "customer-csv")
    W.export_csv(t.customer.withColumn("c_acctbal", F.col("c_acctbal").cast("decimal(18,2)")), path)
    attributes = (
        Attribute("c_custkey", "LONG"), Attribute("c_name", "CHARACTER"), Attribute("c_nationkey", "INTEGER"),
        Attribute("c_acctbal", "CHARACTER"), Attribute("c_mktsegment", "CHARACTER"),
    )
    spec = R.SourceSpec("CSV", path, attributes=attributes, is_first_line_header=True)
    return R.read_source(t.spark, spec).drop(ERRORS)


@query("export_csv_download", """
SELECT 'c_custkey,c_name,c_nationkey,c_acctbal' AS value
UNION ALL SELECT concat_ws(',', c_custkey, c_name, c_nationkey, CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)) FROM customer""")
def export_csv_download(t: Tables) -> DataFrame:
    path = scratch_dir(t.spark, "download")
    W.export_csv_download(t.customer.select("c_custkey", "c_name", "c_nationkey", _money("c_acctbal")), path)
    return t.spark.read.text(path)


@query("compact_parquet", "SELECT * FROM customer")
def compact_parquet(t: Tables) -> DataFrame:
    parts, whole = scratch_dir(t.spark, "parts"), scratch_dir(t.spark, "whole")
    t.customer.repartition(8).write.parquet(parts)
    W.compact_parquet(t.spark, parts, whole)
    return t.spark.read.parquet(whole)


@query("export_name", """
SELECT p_partkey, replace(p_name, ' ', '-') || '.' || lower(p_type)
       || CASE WHEN p_size > 25 THEN '.csv' ELSE '' END AS export_name FROM part""")
def export_name(t: Tables) -> DataFrame:
    name = X.export_name(F.col("p_name"), F.col("p_type"), F.col("p_size") > 25)
    return t.part.select("p_partkey", name.alias("export_name"))


@query("part_names", """
SELECT event_id, event_type || '.part' || lpad(CAST(event_id + 1 AS VARCHAR), 9, '0') AS part_name FROM events""")
def part_names(t: Tables) -> DataFrame:
    return t.events.select("event_id", X.part_name(F.col("event_type"), F.col("event_id") + 1).alias("part_name"))


@query("size_mb", """
SELECT doc_id, CAST(CAST(round(CAST(n_chars AS DECIMAL(20,0)) * 1000 / 1048576, 2) AS DECIMAL(10,2)) AS VARCHAR) AS size_mb FROM documents""")
def size_mb(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.size_in_mb(F.col("n_chars") * 1000).cast("string").alias("size_mb"))


@query("format_from_extension", r"""
SELECT page_id, CASE regexp_extract(lower(file), '\.([^./]+)$', 1)
  WHEN 'csv' THEN 'CSV' WHEN 'tsv' THEN 'CSV' WHEN 'json' THEN 'JSON' WHEN 'xml' THEN 'XML_FILE' WHEN 'txt' THEN 'TEXT'
  ELSE 'UNKNOWN' END AS format
FROM (SELECT page_id, regexp_extract(url, '^[^?#]*', 0) ||
        CASE WHEN contains(url, '?') THEN '.CSV' WHEN contains(url, '#') THEN '.json'
             WHEN contains(url, '/fr/') THEN '.txt' WHEN contains(url, '/de/') THEN '.Xml' ELSE '' END AS file
      FROM pages)""")
def format_from_extension(t: Tables) -> DataFrame:
    url = F.col("url")
    ending = (
        F.when(url.contains("?"), ".CSV").when(url.contains("#"), ".json")
        .when(url.contains("/fr/"), ".txt").when(url.contains("/de/"), ".Xml").otherwise("")
    )
    file = F.concat(F.regexp_extract(url, "^[^?#]*", 0), ending)
    return t.pages.select("page_id", X.format_from_name(file).alias("format"))


# --- uploads ---------------------------------------------------------------

# The five kinds of event stand for the five parts of an upload.
EVENT_KINDS = ("click", "error", "purchase", "signup", "view")


def upload_parts(events: DataFrame) -> DataFrame:
    """Events as part arrivals: the user is the file, the kind the part number."""
    number = F.array_position(F.array(*[F.lit(k) for k in EVENT_KINDS]), F.col("event_type"))
    return events.select(
        F.col("user_id").alias("file"), number.alias("part"), F.lit(len(EVENT_KINDS)).cast("long").alias("total")
    )


UPLOAD_PARTS = f"""parts AS (
  SELECT user_id AS file, CAST(list_position({list(EVENT_KINDS)}, event_type) AS BIGINT) AS part,
         CAST({len(EVENT_KINDS)} AS BIGINT) AS total FROM events)"""


@query("upload_completeness", f"""
WITH {UPLOAD_PARTS}
SELECT file, count(DISTINCT part) AS parts_present, CAST(0 AS BIGINT) AS parts_stray, max(total) AS parts_expected,
       max(total) - count(DISTINCT part) AS parts_missing, count(DISTINCT part) = max(total) AS complete
FROM parts GROUP BY file""")
def upload_completeness(t: Tables) -> DataFrame:
    return U.upload_completeness(upload_parts(t.events), "file", "part", "total")


@query("upload_missing_parts", """
WITH e AS (SELECT l_orderkey AS file, CAST(l_linenumber AS BIGINT) AS part FROM lineitem),
f AS (SELECT file, max(part) AS total FROM e GROUP BY file),
missing AS (SELECT x.file, x.part, x.part - row_number() OVER (PARTITION BY x.file ORDER BY x.part) AS run
  FROM (SELECT file, unnest(range(1, total + 1)) AS part FROM f) x ANTI JOIN e ON e.file = x.file AND e.part = x.part)
SELECT file, min(part) AS first_part, max(part) AS last_part FROM missing GROUP BY file, run""")
def upload_missing_parts(t: Tables) -> DataFrame:
    """Line numbers as parts; an order's largest number is its total."""
    parts = t.lineitem.select(
        F.col("l_orderkey").alias("file"), F.col("l_linenumber").cast("long").alias("part")
    )
    totals = parts.groupBy("file").agg(F.max("part").alias("total"))
    return U.missing_parts(parts.join(totals, "file"), "file", "part", "total")


# --- locations and texts ---------------------------------------------------

@query("resolve_location", f"""
WITH {S.STORED_SOURCES}, {S.STORAGES}
SELECT s.id, CASE WHEN initialization = 'P' THEN 'file:///data/' || CAST(s.id AS VARCHAR)
       WHEN initialization = 'O' THEN 'hdfs://client/' || st.name ELSE st.url END AS location
FROM stored_sources s JOIN storages st ON st.id = storage_id""")
def resolve_location(t: Tables) -> DataFrame:
    """Some sources have a URL, some a blank one, and some storages a client URL."""
    joined = S.stored_sources(t).join(
        S.storages(t).select(F.col("id").alias("storage_id"), F.col("name").alias("storage"), "url"), "storage_id"
    )
    status = F.col("initialization")
    own = F.when(status == "P", F.concat(F.lit("file:///data/"), F.col("id").cast("string"))).when(status == "F", "")
    client = F.when(status == "O", F.concat(F.lit("hdfs://client/"), "storage")).when(status == "F", "")
    return joined.select("id", L.first_filled(own, client, F.col("url")).alias("location"))


@query("url_parts", r"""
SELECT page_id, regexp_extract(url, '^([a-z0-9]+)://', 1) AS scheme,
       regexp_extract(url, '@([^/:?#]+)', 1) AS host,
       CASE WHEN contains(url, ':9000') THEN 9000 ELSE 3306 END AS port,
       'ann' AS username, CASE WHEN contains(url, 's3cret') THEN 's3cret' END AS password,
       regexp_extract(url, '@[^/]+/([^?#]*)', 1) AS database,
       nullif(regexp_extract(url, '\?([^#]*)', 1), '') AS query
FROM (SELECT page_id, regexp_replace(
        CASE WHEN starts_with(url, 'https') THEN replace(url, 'https://', 'mysql://ann:s3cret@')
             ELSE regexp_replace(replace(url, 'http://', 'mysql://ann@'), '(@[^/]+)/', '\1:9000/') END, '/(#|\?|$)', '\1') AS url
      FROM pages)""")
def url_parts(t: Tables) -> DataFrame:
    """Page URLs turned into database URLs, with and without port and password."""
    secure = F.replace("url", F.lit("https://"), F.lit("mysql://ann:s3cret@"))
    open_ = F.regexp_replace(F.replace("url", F.lit("http://"), F.lit("mysql://ann@")), "(@[^/]+)/", "$1:9000/")
    url = F.regexp_replace(F.when(F.col("url").startswith("https"), secure).otherwise(open_), r"/(#|\?|$)", "$1")
    rows = t.pages.select("page_id", url.alias("url"))
    return rows.select("page_id", *[c.alias(n) for n, c in L.url_parts(F.col("url")).items()])


@query("url_query_map", r"""
SELECT page_id, nullif(regexp_extract(url, '[?&]page=([^&#]*)', 1), '') AS page,
       nullif(regexp_extract(url, '[?&]ref=([^&#]*)', 1), '') AS ref,
       nullif(regexp_extract(url, '[?&]utm_source=([^&#]*)', 1), '') AS utm_source FROM pages""")
def url_query_map(t: Tables) -> DataFrame:
    mapped = t.pages.select("page_id", L.query_map(F.col("url")).alias("q"))
    return mapped.select("page_id", *[F.col("q")[k].alias(k) for k in ("page", "ref", "utm_source")])


@query("clean_path", r"""
SELECT page_id, rtrim(regexp_replace(url, '^(https?://)', '\1data/') , '/') AS path FROM pages""")
def clean_path(t: Tables) -> DataFrame:
    doubled = F.regexp_replace("url", "^(https?://)", "$1data//")
    return t.pages.select("page_id", X.clean_path(doubled).alias("path"))


@query("strip_accents", "SELECT doc_id, strip_accents(text) AS text FROM documents")
def strip_accents(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.strip_accents(F.col("text")).alias("text"))


@query("normalise_header", r"""
SELECT doc_id, regexp_replace(lower(left(strip_accents(regexp_replace(text, '^\s+|\s+$', '', 'g')), 100)), '[^\p{L}\p{N}]', '_', 'g') AS header
FROM documents""")
def normalise_header(t: Tables) -> DataFrame:
    return t.documents.select("doc_id", X.normalise_header(F.col("text")).alias("header"))


# --- typed conversion and JSON ---------------------------------------------

EVENT_ATTRIBUTES = (
    Attribute("event_id", "INTEGER"),
    Attribute("amount", "DECIMAL", 18, 2),
    Attribute("rate", "DOUBLE"),
    Attribute("kind", "CHARACTER"),
    Attribute("day", "DATE", format="dd/MM/yyyy"),
)


def _event_cells(t: Tables) -> DataFrame:
    """Events as text cells; errors have a bad amount, views a missing one."""
    value = F.col("value").cast("decimal(18,2)").cast("string")
    kind = F.col("event_type")
    amount = F.when(kind == "error", F.concat(F.lit("x"), value)).when(kind == "view", "NA").otherwise(value)
    rate = F.when(kind == "click", "1.5.5").otherwise(F.concat(F.lit(" "), value, F.lit(" ")))
    return t.events.select(
        F.col("event_id").cast("string").alias("event_id"), amount.alias("amount"), rate.alias("rate"),
        F.concat(F.lit(" "), kind).alias("kind"), F.date_format("ts", "dd/MM/yyyy").alias("day"),
    )


@query("typed_convert", """
SELECT CAST(event_id AS INTEGER) AS event_id,
       CASE WHEN event_type NOT IN ('error', 'view') THEN CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) END AS amount,
       CASE WHEN event_type <> 'click' THEN CAST(CAST(value AS DECIMAL(18,2)) AS DOUBLE) END AS rate,
       event_type AS kind, strftime(ts, '%Y-%m-%d') AS day,
       CASE event_type WHEN 'error' THEN 'amount: <Invalid data>: `x' || CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) || '`'
                       WHEN 'click' THEN 'rate: <Invalid data>: `1.5.5`' ELSE '' END AS errors
FROM events""")
def typed_convert(t: Tables) -> DataFrame:
    typed = convert_columns(_event_cells(t), EVENT_ATTRIBUTES, ["NA"])
    return typed.select(
        "event_id", F.col("amount").cast("string").alias("amount"), "rate", "kind",
        F.date_format("day", "yyyy-MM-dd").alias("day"), F.array_join(ERRORS, "; ").alias("errors"),
    )


@query("cast_warnings", """
SELECT name, bad_cells FROM (
  SELECT 'event_id' AS name, CAST(0 AS BIGINT) AS bad_cells UNION ALL
  SELECT 'amount', count(*) FILTER (event_type = 'error') FROM events UNION ALL
  SELECT 'rate', count(*) FILTER (event_type = 'click') FROM events UNION ALL
  SELECT 'kind', 0 UNION ALL SELECT 'day', 0) WHERE bad_cells > 0""")
def cast_warnings(t: Tables) -> DataFrame:
    return columns_with_errors(_event_cells(t), EVENT_ATTRIBUTES, ["NA"]).where("bad_cells > 0")


@query("json_safe_parse", """
SELECT event_id, CASE WHEN event_type = 'error' THEN NULL ELSE CAST(json_extract_string(props, '$.k') AS BIGINT) END AS k
FROM events""")
def json_safe_parse(t: Tables) -> DataFrame:
    """Errors have a document that is cut off."""
    text = F.when(F.col("event_type") == "error", F.rtrim(F.col("props"), F.lit("}"))).otherwise(F.col("props"))
    return t.events.select("event_id", F.try_variant_get(D.parse_json(text), "$.k", "bigint").alias("k"))


@query("json_extract", """
SELECT event_id, CASE WHEN event_type = 'view' THEN 'user' || CAST(user_id AS VARCHAR) ELSE 'hadoop' END AS "user",
       CASE WHEN event_type <> 'error' THEN event_type = 'click' END AS use_hostname,
       CASE WHEN event_type = 'click' THEN 'a.xml,b.xml' END AS resources
FROM events""")
def json_extract(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    text = (
        F.when(kind == "view", F.concat(F.lit('{"use_hostname": false, "user": "user'), F.col("user_id").cast("string"), F.lit('"}')))
        .when(kind == "click", '{"use_hostname": true, "resources": ["a.xml", "b.xml"]}')
        .when(kind == "error", "{not json")
        .otherwise('{"user": "", "use_hostname": false, "other": 1}')
    )
    parsed = D.storage_params(text)
    return t.events.select(
        "event_id", parsed["user"].alias("user"), parsed["use_hostname"].alias("use_hostname"),
        F.array_join(parsed["resources"], ",").alias("resources"),
    )


# --- encodings -------------------------------------------------------------

@query("csv_encoded", """
SELECT c_custkey, 'Açores ' || c_name AS c_name, c_mktsegment || chr(9) || '"' AS c_mktsegment FROM customer""")
def csv_encoded(t: Tables) -> DataFrame:
    """Latin-1, gzip, a named delimiter and quotes in cells."""
    path = scratch_dir(t.spark, "latin1")
    rows = t.customer.select(
        "c_custkey", F.concat(F.lit("Açores "), "c_name").alias("c_name"),
        F.concat("c_mktsegment", F.lit('\t"')).alias("c_mktsegment"),
    )
    options = {"encoding": "ISO-8859-1", "compression": "gzip", "sep": "\t", "escape": '"', "quote": '"'}
    rows.write.options(**options).csv(path)
    attributes = (Attribute("c_custkey", "LONG"), Attribute("c_name", "CHARACTER"), Attribute("c_mktsegment", "CHARACTER"))
    spec = R.SourceSpec("CSV", path, attributes=attributes, attribute_delimiter="{tab}", encoding="latin1")
    return R.read_source(t.spark, spec).drop(ERRORS)
