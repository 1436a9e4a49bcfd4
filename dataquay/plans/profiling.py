"""Column statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquay.operators import profile as P
from dataquay.plans.registry import Tables, query

LINE_COLUMNS = (
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax",
    "l_returnflag", "l_linestatus", "l_shipdate",
)
LINE_NUMBERS = LINE_COLUMNS[:8]


def _fixed(c: str) -> Column:
    """Numbers and number texts with four places, so that engines agree."""
    return F.round(F.col(c).cast("double"), 4).alias(c)


def _stats_sql(table: str, numeric, other=()) -> str:
    rows = []
    for i, c in enumerate(numeric):
        rows.append(
            f"SELECT {i} AS position, '{c}' AS name, count(DISTINCT {c}) AS distinct_values, round(avg({c}), 4) AS mean_value, "
            f"round(quantile_cont(CAST({c} AS DOUBLE), 0.5), 4) AS median_value, round(CAST(max({c}) AS DOUBLE), 4) AS max_value, "
            f"round(CAST(min({c}) AS DOUBLE), 4) AS min_value, round(stddev_samp({c}), 4) AS std_deviation, "
            f"count(*) - count({c}) AS missing_total FROM {table}"
        )
    return " UNION ALL ".join(rows)


def _rounded(df: DataFrame) -> DataFrame:
    return df.select(
        "position", "name", "distinct_values", _fixed("mean_value"), _fixed("median_value"), _fixed("max_value"),
        _fixed("min_value"), _fixed("std_deviation"), "missing_total",
    )


@query("profile_columns", _stats_sql("lineitem", LINE_NUMBERS))
def profile_columns(t: Tables) -> DataFrame:
    return _rounded(P.profile_columns(t.lineitem, LINE_NUMBERS, exact=True))


@query("profile_columns_all", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS name, count(DISTINCT {c}) AS distinct_values, count(*) - count({c}) AS missing_total FROM lineitem"
    for i, c in enumerate(LINE_COLUMNS)))
def profile_columns_all(t: Tables) -> DataFrame:
    """Exact, of every column: numbers, texts and dates."""
    return P.profile_columns(t.lineitem, LINE_COLUMNS, exact=True).select("position", "name", "distinct_values", "missing_total")


@query("profile_events", _stats_sql(
    "(SELECT event_id, user_id, CASE WHEN event_type <> 'error' THEN value END AS value FROM events)",
    ("event_id", "user_id", "value")))
def profile_events(t: Tables) -> DataFrame:
    """A column with NULLs: statistics are over the values, gaps are counted."""
    value = F.when(F.col("event_type") != "error", F.col("value"))
    events = t.events.select("event_id", "user_id", value.alias("value"))
    return _rounded(P.profile_columns(events, exact=True))


@query("profile_texts", """
SELECT position, name, distinct_values, min_value, max_value, missing_total FROM (
  SELECT 0 AS position, 'c_name' AS name, count(DISTINCT c_name) AS distinct_values, min(c_name) AS min_value, max(c_name) AS max_value,
         count(*) - count(c_name) AS missing_total FROM customer UNION ALL
  SELECT 1, 'c_mktsegment', count(DISTINCT c_mktsegment), min(c_mktsegment), max(c_mktsegment), count(*) - count(c_mktsegment) FROM customer)""")
def profile_texts(t: Tables) -> DataFrame:
    found = P.profile_columns(t.customer, ("c_name", "c_mktsegment"), exact=True)
    return found.select("position", "name", "distinct_values", "min_value", "max_value", "missing_total")


@query("profile_columns_quick")
def profile_columns_quick(t: Tables) -> DataFrame:
    """The sketch form; distinct values and medians are approximate."""
    return P.profile_columns(t.lineitem, LINE_COLUMNS)


def _deciles_sql(table: str, columns) -> str:
    points = ", ".join(str(i / 10) for i in range(1, 10))
    rows = [
        f"SELECT {i} AS position, '{c}' AS name, unnest(quantile_cont(CAST({c} AS DOUBLE), [{points}])) AS value, "
        f"unnest(range(1, 10)) AS decile FROM {table}"
        for i, c in enumerate(columns)
    ]
    return f"SELECT position, name, decile, round(value, 4) AS value FROM ({' UNION ALL '.join(rows)})"


@query("profile_deciles", _deciles_sql("lineitem", LINE_NUMBERS))
def profile_deciles(t: Tables) -> DataFrame:
    found = P.deciles(t.lineitem, LINE_COLUMNS, exact=True)
    tall = found.select("position", "name", F.posexplode("deciles").alias("decile", "value"))
    return tall.select("position", "name", (F.col("decile") + 1).cast("long").alias("decile"), _fixed("value"))


_EVENT_CELLS = """(SELECT CAST(event_id AS VARCHAR) AS event_id, nullif(event_type, 'view') AS event_type,
  CASE event_type WHEN 'error' THEN 'NA' WHEN 'click' THEN '' ELSE CAST(value AS VARCHAR) END AS value FROM events)"""


@query("profile_missing", f"""
SELECT 0 AS position, 'event_id' AS name, count(*) FILTER (event_id IS NULL OR event_id IN ('', 'NA')) AS missing_total FROM {_EVENT_CELLS} UNION ALL
SELECT 1, 'event_type', count(*) FILTER (event_type IS NULL OR event_type IN ('', 'NA')) FROM {_EVENT_CELLS} UNION ALL
SELECT 2, 'value', count(*) FILTER (value IS NULL OR value IN ('', 'NA')) FROM {_EVENT_CELLS}""")
def profile_missing(t: Tables) -> DataFrame:
    kind = F.col("event_type")
    value = F.when(kind == "error", "NA").when(kind == "click", "").otherwise(F.col("value").cast("string"))
    cells = t.events.select("event_id", F.nullif("event_type", F.lit("view")).alias("event_type"), value.alias("value"))
    return P.profile_missing(cells, tokens=["NA"])


@query("profile_table", """
SELECT 'lineitem' AS name, count(*) AS estimated_rows FROM lineitem UNION ALL
SELECT 'events', count(*) FROM events""")
def profile_table(t: Tables) -> DataFrame:
    lines = P.profile_table(t.lineitem).select(F.lit("lineitem").alias("name"), "estimated_rows")
    return lines.unionByName(P.profile_table(t.events).select(F.lit("events").alias("name"), "estimated_rows"))


@query("profile_counter", """
SELECT o_orderkey AS id, CAST(1 + CASE WHEN o_orderkey IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') THEN 1 ELSE 0 END AS INTEGER) AS statistics_process_counter
FROM orders""")
def profile_counter(t: Tables) -> DataFrame:
    sources = t.orders.select(F.col("o_orderkey").alias("id"), F.lit(1).alias("statistics_process_counter"))
    profiled = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return P.count_profiling(sources, profiled)
