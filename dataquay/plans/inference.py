"""Schema inference over whole tables, turned into text cells first."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.functions import cells as C
from dataquay.functions import typemaps as M
from dataquay.operators import infer as I
from dataquay.operators.mutate import replace_attributes as replace
from dataquay.plans.registry import Tables, query
from dataquay.session import scratch_dir
from dataquay.sources import readers as R
from dataquay.sources import writers as W

# --- text cells of every class, from the events ----------------------------

MESSY_COLUMNS = ("id", "mixed", "amount", "day", "stamp", "code", "props")
MISSING = ("NA", "-")


def messy_events(t: Tables) -> DataFrame:
    """Events as text: the kind of event decides how a cell is written."""
    kind = F.col("event_type")
    amount = F.col("value").cast("decimal(18,2)").cast("string")
    whole = F.col("value").cast("int").cast("string")
    mixed = (
        F.when(kind == "click", amount)
        .when(kind == "error", "NA")
        .when(kind == "purchase", F.concat(whole, F.lit("e-7")))
        .when(kind == "signup", F.date_format("ts", "M/d/yyyy"))
        .otherwise(F.concat(F.lit("99"), F.lpad(whole, 9, "0")))
    )
    day = F.when(kind == "click", F.date_format("ts", "dd.MM.yyyy")).otherwise(F.date_format("ts", "yyyy-MM-dd"))
    stamp = F.when(kind == "error", F.date_format("ts", "MM-dd-yyyy HH:mm:ss")).otherwise(
        F.date_format("ts", "yyyy/MM/dd'T'HH:mm:ss.SSS'Z'")
    )
    code = F.when(kind == "click", F.concat(F.lit("0"), whole)).when(kind == "view", "").otherwise(whole)
    return t.events.select(
        F.col("event_id").alias("pos"),
        F.col("event_id").cast("string").alias("id"),
        mixed.alias("mixed"),
        amount.alias("amount"),
        day.alias("day"),
        stamp.alias("stamp"),
        code.alias("code"),
        F.col("props"),
    )


MESSY = """messy AS (
  SELECT event_id AS pos, CAST(event_id AS VARCHAR) AS id,
    CASE event_type WHEN 'click' THEN amt WHEN 'error' THEN 'NA' WHEN 'purchase' THEN whole || 'e-7'
      WHEN 'signup' THEN strftime(ts, '%-m/%-d/%Y') ELSE '99' || lpad(whole, 9, '0') END AS mixed,
    amt AS amount,
    CASE event_type WHEN 'click' THEN strftime(ts, '%d.%m.%Y') ELSE strftime(ts, '%Y-%m-%d') END AS day,
    CASE event_type WHEN 'error' THEN strftime(ts, '%m-%d-%Y %H:%M:%S')
      ELSE strftime(ts, '%Y/%m/%dT%H:%M:%S.%g') || 'Z' END AS stamp,
    CASE event_type WHEN 'click' THEN '0' || whole WHEN 'view' THEN '' ELSE whole END AS code,
    props
  FROM (SELECT *, CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS amt,
               CAST(CAST(trunc(value) AS INTEGER) AS VARCHAR) AS whole FROM events))"""


def _order_cells(t: Tables) -> DataFrame:
    return t.orders.select(
        "o_orderkey",
        F.col("o_custkey").cast("string").alias("o_custkey"),
        "o_orderstatus",
        F.col("o_totalprice").cast("decimal(18,2)").cast("string").alias("o_totalprice"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("o_orderdate"),
        "o_orderpriority",
    )


def cells_sql(relation: str, pos: str, columns) -> str:
    """(column_index, pos, v) rows of a relation."""
    return " UNION ALL ".join(
        f"SELECT {i} AS column_index, {pos} AS pos, {c} AS v FROM {relation}" for i, c in enumerate(columns)
    )


# The rules of classification, restated for DuckDB with its own date parser.
_PATTERNS = [
    (sep.join(p), sep.join(j))
    for p, j in ((("%m", "%d", "%Y"), ("MM", "dd", "yyyy")), (("%Y", "%m", "%d"), ("yyyy", "MM", "dd")),
                 (("%d", "%m", "%Y"), ("dd", "MM", "yyyy")))
    for sep in "/-."
]
_TIMES = [("", ""), ("T%H:%M:%S.%fZ", "THH:mm:ss.Z"), (" %H:%M:%S", " HH:mm:ss")]
_DATE_CASE = "CASE " + " ".join(
    f"WHEN try_strptime(v, '{p}{time}') IS NOT NULL THEN '{j}{label}'"
    for p, j in _PATTERNS for time, label in _TIMES
) + " END"


def classed_sql(cells: str, missing=()) -> str:
    tokens = ", ".join(f"'{m}'" for m in ("", *missing))
    number = r"\s*[+-]?(\d+(_\d+)*(\.(\d+(_\d+)*)?)?|\.\d+(_\d+)*)([eE][+-]?\d+(_\d+)*)?\s*"
    date_like = r"(\d{1,2}[-/.]\d{1,2}[-/.]\d{4}|\d{4}[-/.]\d{1,2}[-/.]\d{1,2})([T ].*)?"
    return f"""numbered AS (
  SELECT column_index, pos, v,
    CASE WHEN regexp_full_match(v, '{number}') THEN try_cast(replace(trim(v), '_', '') AS DOUBLE) END AS num,
    CASE WHEN regexp_full_match(v, '{date_like}') THEN {_DATE_CASE} END AS fmt
  FROM ({cells})),
classed AS (
  SELECT *, CASE WHEN v IS NULL OR v IN ({tokens}) THEN 'MISSING'
    WHEN num IS NULL OR isinf(num) THEN CASE WHEN fmt IS NOT NULL THEN 'DATETIME' ELSE 'CHAR' END
    WHEN v[1] = '0' AND length(v) > 1 AND v[2] <> '.' THEN 'CHAR'
    WHEN num = floor(num) THEN CASE WHEN num > -2147483648 AND num < 2147483647 THEN 'INT32' ELSE 'INT64' END
    WHEN contains(v, '.') THEN 'DECIMAL' ELSE 'TEXT' END AS cell_class
  FROM numbered)"""


# The column fold, restated with the order-dependent parts spelled out.
_FOLDED = r"""marks AS (
  SELECT column_index,
    bool_or(cell_class = 'MISSING') AS nullable,
    min(pos) FILTER (cell_class = 'CHAR') AS first_char,
    coalesce(max(pos) FILTER (cell_class IN ('DATETIME', 'DECIMAL', 'TEXT')), -1) AS p,
    arg_max(cell_class, pos) FILTER (cell_class IN ('DATETIME', 'DECIMAL', 'TEXT')) AS o,
    coalesce(max(pos) FILTER (cell_class = 'INT64'), -1) AS i64,
    coalesce(max(pos) FILTER (cell_class = 'INT32'), -1) AS i32,
    arg_max(fmt, pos) FILTER (cell_class = 'DATETIME') AS fmt,
    max(greatest(a, a + e)) + max(greatest(f, f - e)) AS prec, max(greatest(f, f - e)) AS sc,
    max(length(v)) FILTER (cell_class <> 'MISSING') AS longest
  FROM (SELECT *, length(before) AS a, length(after) AS f,
               CASE WHEN before IS NOT NULL THEN coalesce(try_cast(regexp_extract(n, '[eE](.*)$', 1) AS INTEGER), 0) END AS e
        FROM (SELECT *, regexp_extract(n, '^[+-]?\d*', 0) AS before, regexp_extract(n, '\.(\d*)', 1) AS after
              FROM (SELECT *, CASE WHEN cell_class IN ('DECIMAL', 'INT32', 'INT64', 'TEXT') THEN replace(trim(v), '_', '') END AS n
                    FROM classed)))
  GROUP BY column_index),
sized AS (
  SELECT m.column_index, max(length(v)) FILTER (cell_class <> 'MISSING' AND pos >= first_char) AS size
  FROM marks m JOIN classed c ON c.column_index = m.column_index GROUP BY 1),
folded AS (
  SELECT m.*, s.size,
    CASE WHEN first_char IS NOT NULL THEN CASE WHEN s.size > 1000 THEN 'TEXT' ELSE 'CHARACTER' END
      WHEN o = 'DECIMAL' THEN CASE WHEN prec > 38 THEN 'CHARACTER' ELSE 'DECIMAL' END WHEN i64 > p THEN 'LONG' WHEN i32 > p THEN 'INTEGER'
      ELSE coalesce(o, 'CHARACTER') END AS type
  FROM marks m JOIN sized s ON s.column_index = m.column_index)"""


def folded_sql(ctes: str, cells: str, columns, select: str, missing=()) -> str:
    names = ", ".join(f"({i}, '{c}')" for i, c in enumerate(columns))
    prefix = f"{ctes}, " if ctes else ""
    return (
        f"WITH {prefix}{classed_sql(cells, missing)}, {_FOLDED} "
        f"SELECT {select} FROM folded JOIN (VALUES {names}) n(i, name) ON i = column_index"
    )


ORDER_COLUMNS = ("o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority")
ORDER_CTE = """order_cells AS (
  SELECT o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, o_orderstatus,
         CAST(CAST(o_totalprice AS DECIMAL(18,2)) AS VARCHAR) AS o_totalprice,
         strftime(o_orderdate, '%Y-%m-%d') AS o_orderdate, o_orderpriority FROM orders)"""
FULL = (
    "column_index AS position, name, type, CAST(CASE WHEN first_char IS NOT NULL THEN size "
    "WHEN o = 'DECIMAL' AND prec > 38 THEN longest END AS INTEGER) AS size, "
    "CASE WHEN type = 'DECIMAL' THEN CAST(prec AS INTEGER) END AS precision, "
    "CASE WHEN type = 'DECIMAL' THEN CAST(sc AS INTEGER) END AS scale, "
    "CASE WHEN type = 'DATETIME' THEN fmt END AS format, nullable"
)


@query("infer_cell_class", f"""
WITH {MESSY}, {classed_sql(cells_sql("messy", "pos", MESSY_COLUMNS), MISSING)}
SELECT column_index, pos, v, cell_class FROM classed""")
def infer_cell_class(t: Tables) -> DataFrame:
    cells = I.cell_rows(messy_events(t), MESSY_COLUMNS, "pos")
    return I.classify_cells(cells, MISSING).select("column_index", "pos", "v", "cell_class")


@query("infer_column_type", folded_sql(
    ORDER_CTE, cells_sql("order_cells", "o_orderkey", ORDER_COLUMNS), ORDER_COLUMNS, FULL))
def infer_column_type(t: Tables) -> DataFrame:
    return I.infer_columns(_order_cells(t), ORDER_COLUMNS, "o_orderkey")


@query("infer_mixed_columns", folded_sql(
    MESSY, cells_sql("messy", "pos", MESSY_COLUMNS), MESSY_COLUMNS, FULL, MISSING))
def infer_mixed_columns(t: Tables) -> DataFrame:
    return I.infer_columns(messy_events(t), MESSY_COLUMNS, "pos", MISSING)


_LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate",
)


@query("infer_lineitem", folded_sql("", cells_sql(
    """(SELECT *, CAST(CAST(l_extendedprice AS DECIMAL(18,2)) AS VARCHAR) AS price,
        CAST(CAST(l_discount AS DECIMAL(18,2)) AS VARCHAR) AS discount, CAST(CAST(l_tax AS DECIMAL(18,2)) AS VARCHAR) AS tax,
        CAST(CAST(l_quantity AS DECIMAL(18,1)) AS VARCHAR) AS quantity, strftime(l_shipdate, '%Y-%m-%d') AS shipped FROM lineitem)""",
    "l_orderkey",
    ("CAST(l_orderkey AS VARCHAR)", "CAST(l_partkey AS VARCHAR)", "CAST(l_suppkey AS VARCHAR)",
     "CAST(l_linenumber AS VARCHAR)", "quantity", "price", "discount", "tax", "l_returnflag", "l_linestatus", "shipped")),
    _LINE_COLUMNS, FULL))
def infer_lineitem(t: Tables) -> DataFrame:
    """No column mixes dates with numbers here, so the scan's order will do."""
    cells = t.lineitem.select(*_LINE_COLUMNS).withColumns({
        "l_extendedprice": F.col("l_extendedprice").cast("decimal(18,2)"),
        "l_quantity": F.col("l_quantity").cast("decimal(18,1)"),
        "l_discount": F.col("l_discount").cast("decimal(18,2)"),
        "l_tax": F.col("l_tax").cast("decimal(18,2)"),
        "l_shipdate": F.date_format("l_shipdate", "yyyy-MM-dd"),
    })
    return I.infer_columns(cells)


@query("infer_nullable", folded_sql(
    MESSY, cells_sql("messy", "pos", MESSY_COLUMNS), MESSY_COLUMNS, "name, nullable", MISSING))
def infer_nullable(t: Tables) -> DataFrame:
    return infer_mixed_columns(t).select("name", "nullable")


@query("infer_decimal", folded_sql(
    "", cells_sql("customer", "c_custkey", ("CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR)",
                                             "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || '000000000000000000'",
                                             "CAST(CAST(c_acctbal AS DECIMAL(18,2)) AS VARCHAR) || repeat('0', 36)")),
    ("balance", "padded", "endless"),
    "name, type, CASE WHEN type = 'DECIMAL' THEN CAST(prec AS INTEGER) END AS precision, "
    "CASE WHEN type = 'DECIMAL' THEN CAST(sc AS INTEGER) END AS scale"))
def infer_decimal(t: Tables) -> DataFrame:
    """The third column has more digits than a decimal keeps."""
    balance = F.col("c_acctbal").cast("decimal(18,2)").cast("string")
    cells = t.customer.select(
        "c_custkey", balance.alias("balance"), F.concat(balance, F.lit("0" * 18)).alias("padded"),
        F.concat(balance, F.lit("0" * 36)).alias("endless"),
    )
    found = I.infer_columns(cells, ("balance", "padded", "endless"), "c_custkey")
    return found.select("name", "type", "precision", "scale")


@query("infer_char_size", folded_sql(
    "documents_cells AS (SELECT doc_id AS pos, text, lang, source FROM documents)",
    cells_sql("documents_cells", "pos", ("text", "lang", "source")), ("text", "lang", "source"),
    "name, type, CAST(size AS INTEGER) AS size"))
def infer_char_size(t: Tables) -> DataFrame:
    columns = ("text", "lang", "source")
    return I.infer_columns(t.documents, columns, "doc_id").select("name", "type", "size")


_RENDERED = "CASE o_orderstatus WHEN 'P' THEN strftime(o_orderdate, '%d/%m/%Y') WHEN 'O' THEN strftime(o_orderdate, '%Y.%m.%dT%H:%M:%S.%fZ') ELSE strftime(o_orderdate, '%m-%d-%Y %H:%M:%S') END"


@query("detect_date_format", f"""
WITH {classed_sql(f"SELECT 0 AS column_index, o_orderkey AS pos, {_RENDERED} AS v FROM orders")}
SELECT pos AS o_orderkey, v, fmt AS format FROM classed""")
def detect_date_format(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    def ordered(form: str):
        """The wall-clock time in another order, without a detour through a time zone."""
        return F.regexp_replace(F.col("o_orderdate").cast("string"), r"^(\d+)-(\d+)-(\d+) (\S+)$", form)

    text = (
        F.when(status == "P", ordered("$3/$2/$1"))
        .when(status == "O", ordered("$1.$2.$3T$4.000000Z"))
        .otherwise(ordered("$2-$3-$1 $4"))
    )
    rows = t.orders.select("o_orderkey", text.alias("v"))
    return rows.select("o_orderkey", "v", C.date_pattern(C.date_pattern_index(F.col("v"))).alias("format"))


# --- files -----------------------------------------------------------------

@query("infer_csv_source", folded_sql(
    """texts AS (SELECT doc_id AS pos, CAST(doc_id AS VARCHAR) AS doc_id, text, lang,
              CAST(n_chars AS VARCHAR) AS n_chars FROM documents)""",
    cells_sql("texts", "pos", ("doc_id", "text", "lang", "n_chars")), ("doc_id", "text", "lang", "n_chars"),
    "name, type, CASE WHEN first_char IS NOT NULL THEN CAST(size AS INTEGER) END AS size, nullable"))
def infer_csv_source(t: Tables) -> DataFrame:
    """All records of a CSV source whose quoted texts span lines."""
    path = scratch_dir(t.spark, "documents-csv")
    W.export_csv(t.documents.select(
        F.col("doc_id").alias(" Doc ID"), F.col("text").alias("Téxt"), F.col("lang").alias("LANG"),
        F.col("n_chars").alias("N-chars "),
    ), path)
    spec = R.SourceSpec("CSV", path, is_first_line_header=True, is_multiline=True)
    return R.infer_csv(t.spark, spec).select("name", "type", "size", "nullable")


@query("infer_delimiter", """
WITH c AS (SELECT doc_id, length(text) - length(replace(text, ',', '')) AS a,
  length(text) - length(replace(text, ';', '')) AS b, length(text) - length(replace(text, chr(9), '')) AS c FROM documents)
SELECT doc_id, CASE WHEN a >= b AND a >= c THEN ',' WHEN b >= c THEN ';' ELSE chr(9) END AS delimiter FROM c""")
def infer_delimiter(t: Tables) -> DataFrame:
    return I.infer_delimiter(t.documents, "text", ["doc_id"])


@query("infer_delimiter_by_source", """
WITH c AS (SELECT source, sum(length(text) - length(replace(text, ',', ''))) AS a,
  sum(length(text) - length(replace(text, ';', ''))) AS b, sum(length(text) - length(replace(text, chr(9), ''))) AS c
  FROM documents GROUP BY source)
SELECT source, CASE WHEN a >= b AND a >= c THEN ',' WHEN b >= c THEN ';' ELSE chr(9) END AS delimiter FROM c""")
def infer_delimiter_by_source(t: Tables) -> DataFrame:
    return I.infer_delimiter(t.documents, "text", ["source"])


# --- type names ------------------------------------------------------------

MYSQL_SAMPLE = (
    "TINY", "SHORT", "INT24", "YEAR", "BIT", "LONG", "LONGLONG", "NEWDATE", "NEWDECIMAL", "DECIMAL", "FLOAT",
    "DOUBLE", "DATE", "TIME", "DATETIME", "TIMESTAMP", "VAR_STRING", "BLOB", "JSON", "GEOMETRY",
)
HIVE_SAMPLE = (
    "TINYINT_TYPE", "SMALLINT_TYPE", "INT_TYPE", "BOOLEAN_TYPE", "BIGINT_TYPE", "DECIMAL_TYPE", "FLOAT_TYPE",
    "DOUBLE_TYPE", "DATE_TYPE", "TIMESTAMP_TYPE", "STRING_TYPE", "VARCHAR_TYPE", "ARRAY_TYPE", "int", "bigint",
)


def _named_by_size(t: Tables, names) -> DataFrame:
    """Parts as remote columns: the size picks the type name; large sizes have none."""
    picked = F.coalesce(F.get(F.array(*[F.lit(n) for n in names]), F.col("p_size") - 1), F.lit("UNKNOWN"))
    return t.part.select("p_partkey", picked.alias("type_name"))


def _named_sql(names) -> str:
    listed = ", ".join(f"'{n}'" for n in names)
    return f"named AS (SELECT p_partkey, coalesce(list_extract([{listed}], p_size), 'UNKNOWN') AS type_name FROM part)"


_KEEP = "'DECIMAL', 'FLOAT', 'DOUBLE', 'DATE', 'TIME', 'DATETIME', 'LONG', 'TIMESTAMP'"


@query("map_mysql_types", f"""
WITH {_named_sql(MYSQL_SAMPLE)}
SELECT p_partkey, type_name, CASE WHEN type_name IN ('TINY', 'SHORT', 'INT24', 'YEAR', 'BIT') THEN 'INTEGER'
  WHEN type_name = 'LONGLONG' THEN 'LONG' WHEN type_name = 'NEWDATE' THEN 'DATETIME'
  WHEN type_name = 'NEWDECIMAL' THEN 'DECIMAL' WHEN type_name IN ({_KEEP}) THEN type_name ELSE 'CHARACTER' END AS type
FROM named""")
def map_mysql_types(t: Tables) -> DataFrame:
    return _named_by_size(t, MYSQL_SAMPLE).withColumn("type", M.mysql_type(F.col("type_name")))


@query("map_hive_types", f"""
WITH {_named_sql(HIVE_SAMPLE)}
SELECT p_partkey, type_name, CASE WHEN n IN ('TINYINT', 'SMALLINT', 'INT', 'INTEGER', 'BOOLEAN') THEN 'INTEGER'
  WHEN n = 'BIGINT' THEN 'LONG' WHEN n IN ({_KEEP}) THEN n ELSE 'CHARACTER' END AS type
FROM (SELECT *, upper(replace(type_name, '_TYPE', '')) AS n FROM named)""")
def map_hive_types(t: Tables) -> DataFrame:
    return _named_by_size(t, HIVE_SAMPLE).withColumn("type", M.hive_type(F.col("type_name")))


# --- stored attributes -----------------------------------------------------

_NEW = "SELECT o_orderkey AS id, o_custkey AS data_source_id, 'new' AS name FROM orders WHERE o_orderstatus = 'P'"


@query("replace_attributes", f"""
WITH old AS (SELECT o_orderkey AS id, o_custkey AS data_source_id, o_orderpriority AS name FROM orders),
new AS ({_NEW})
SELECT id, data_source_id, name FROM old WHERE data_source_id NOT IN (SELECT data_source_id FROM new)
UNION ALL SELECT id, data_source_id, name FROM new""")
def replace_attributes(t: Tables) -> DataFrame:
    return _replaced(t)[0]


@query("replace_attributes_privacy", f"""
SELECT o_orderkey AS attribute_id, o_orderstatus AS technique FROM orders
WHERE o_custkey NOT IN (SELECT data_source_id FROM ({_NEW}))""")
def replace_attributes_privacy(t: Tables) -> DataFrame:
    return _replaced(t)[1]


def _replaced(t: Tables):
    old = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("data_source_id"), F.col("o_orderpriority").alias("name")
    )
    new = t.orders.where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("data_source_id"), F.lit("new").alias("name")
    )
    privacy = t.orders.select(F.col("o_orderkey").alias("attribute_id"), F.col("o_orderstatus").alias("technique"))
    return replace(old, privacy, new)
