"""Keys found in the star schema, followed, and the columns that single rows out."""

from __future__ import annotations

from itertools import combinations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.operators import keys as K
from dataquay.operators import uniqueness as U
from dataquay.plans.registry import Tables, query

STAR = ("region", "nation", "customer", "supplier", "part", "orders", "lineitem")
_WHOLE = {
    "region": ("r_regionkey",), "nation": ("n_nationkey", "n_regionkey"), "customer": ("c_custkey", "c_nationkey"),
    "supplier": ("s_suppkey", "s_nationkey"), "part": ("p_partkey", "p_size"), "orders": ("o_orderkey", "o_custkey"),
    "lineitem": ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"),
}
_TEXT = {
    "region": ("r_name",), "nation": ("n_name",), "customer": ("c_name", "c_mktsegment"), "supplier": ("s_name",),
    "part": ("p_name", "p_brand", "p_type"), "orders": ("o_orderstatus", "o_orderpriority"), "lineitem": ("l_returnflag", "l_linestatus"),
}
_CELLS = " UNION ALL ".join(
    f"SELECT '{t}' AS tab, '{c}' AS col, '{kind}' AS kind, CAST({c} AS VARCHAR) AS v FROM {t}"
    for kind, columns in (("whole", _WHOLE), ("text", _TEXT)) for t, names in columns.items() for c in names
)
INCLUSIONS = f"""
cells AS ({_CELLS}),
counted AS (SELECT tab, col, kind, v, count(*) AS n FROM cells WHERE v IS NOT NULL GROUP BY ALL),
sizes AS (SELECT tab, col, count(*) AS values, max(n) AS most FROM counted GROUP BY ALL),
shared AS (SELECT a.tab AS from_table, a.col AS from_column, b.tab AS to_table, b.col AS to_column, count(*) AS n
           FROM counted a JOIN counted b ON a.kind = b.kind AND a.v = b.v AND (a.tab, a.col) <> (b.tab, b.col) GROUP BY ALL),
included AS (SELECT from_table, from_column, to_table, to_column, x.values AS from_distinct, y.values AS to_distinct
             FROM shared s JOIN sizes x ON x.tab = from_table AND x.col = from_column JOIN sizes y ON y.tab = to_table AND y.col = to_column
             WHERE s.n = x.values AND y.most = 1)"""
_RATED = f"""{INCLUSIONS},
rated AS (SELECT *, 1.0::DOUBLE - levenshtein(from_column, to_column)::DOUBLE / greatest(length(from_column), length(to_column)) AS alike,
                 from_distinct::DOUBLE / to_distinct AS coverage FROM included),
best AS (SELECT *, row_number() OVER (PARTITION BY from_table, from_column ORDER BY alike DESC, coverage DESC, to_table, to_column) AS nth
         FROM rated WHERE alike >= {K.LEAST_ALIKE})"""


def _star(t: Tables) -> dict[str, DataFrame]:
    """The columns that may be keys; dates of the star schema are none."""
    return {name: getattr(t, name).select(*_WHOLE[name], *_TEXT[name]) for name in STAR}


@query("fk_inclusions", f"WITH {INCLUSIONS} SELECT * FROM included")
def fk_inclusions(t: Tables) -> DataFrame:
    return K.inclusions(_star(t))


@query("fk_discover", f"""
WITH {_RATED} SELECT from_table, from_column, to_table, to_column, from_distinct, to_distinct, round(alike, 6) AS alike, round(coverage, 6) AS coverage
FROM best WHERE nth = 1""")
def fk_discover(t: Tables) -> DataFrame:
    return K.discover(_star(t)).withColumns({c: F.round(c, 6) for c in ("alike", "coverage")})


def _catalog(t: Tables) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Catalog relations of the discovered keys: the keys, their pairs (every other one the other way round), the attributes."""
    found = K.discover(_star(t))
    name = lambda side: F.concat_ws(".", f"{side}_table", f"{side}_column")
    key = name("from").alias("id")
    keys = found.select(key, F.col("from_table").alias("from_source_id"), F.col("to_table").alias("to_source_id"))
    turned = F.length("from_column") % 2 == 0
    pairs = found.select(
        name("from").alias("foreign_key_id"), F.lit(1).alias("order"), F.when(turned, "TO").otherwise("FROM").alias("direction"),
        F.when(turned, name("to")).otherwise(name("from")).alias("from_attribute_id"), F.when(turned, name("from")).otherwise(name("to")).alias("to_attribute_id"),
    )
    listed = [(f"{table}.{c}", table, c) for table, df in _star(t).items() for c in df.columns]
    return keys, pairs, t.spark.createDataFrame(listed, "id string, data_source_id string, name string")


@query("fk_join_declared", """
SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, p_name, s_name, c_custkey, n_name, r_name FROM lineitem
LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey LEFT JOIN supplier ON s_suppkey = l_suppkey
LEFT JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = s_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def fk_join_declared(t: Tables) -> DataFrame:
    """Lines with all that they refer to, along the keys of a catalog; the supplier's nation is nearer than the customer's."""
    tables = _star(t)
    joined = K.join_declared(tables, K.declared_keys(*_catalog(t), list(tables)), "lineitem")
    return joined.select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "p_name", "s_name", "c_custkey", "n_name", "r_name")


@query("fk_orphans_declared", """
SELECT 'orders.o_custkey' AS fk, count(*) AS child_rows, count(*) FILTER (o_custkey IS NOT NULL AND c_custkey IS NULL) AS orphan_rows
FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_custkey % 10 <> 0""")
def fk_orphans_declared(t: Tables) -> DataFrame:
    """A declared key whose parent has lost every tenth row since."""
    tables = {"orders": t.orders, "customer": t.customer.where("c_custkey % 10 <> 0")}
    keys = [k for k in K.declared_keys(*_catalog(t), list(tables)) if k.id == "orders.o_custkey"]
    return K.count_declared_orphans(tables, keys)


# --- column sets -----------------------------------------------------------

def _unique_sql(table: str, columns: tuple[str, ...], most: int) -> str:
    sets = [s for size in range(1, most + 1) for s in combinations(columns, size)]
    tests = " UNION ALL ".join(
        f"SELECT [{', '.join(repr(c) for c in s)}] AS s, (SELECT max(n) FROM (SELECT count(*) AS n FROM {table} GROUP BY {', '.join(s)})) = 1 AS ok" for s in sets
    )
    return f"""WITH tested AS ({tests})
SELECT array_to_string(s, ',') AS attributes, CAST(len(s) AS INTEGER) AS size FROM tested t
WHERE ok AND NOT EXISTS (SELECT 1 FROM tested o WHERE o.ok AND len(o.s) < len(t.s) AND list_has_all(t.s, o.s))"""


CUSTOMER = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
LINES = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice")


@query("unique_sets_customer", _unique_sql("customer", CUSTOMER, 5))
def unique_sets_customer(t: Tables) -> DataFrame:
    return U.unique_sets(t.customer, CUSTOMER, 5)


@query("unique_sets_lineitem", _unique_sql("lineitem", LINES, 3))
def unique_sets_lineitem(t: Tables) -> DataFrame:
    return U.unique_sets(t.lineitem, LINES, 3)


_QUASI = ("c_nationkey", "c_mktsegment")
_CLASSES = "(SELECT {q}, sum(n) AS k, max(n) AS most FROM (SELECT {q}, floor(c_acctbal / 2000) AS v, count(*) AS n FROM customer GROUP BY {q}, v) GROUP BY {q})"


@query("privacy_risk_impact", f"""
SELECT 'IDENTIFICATION' AS type, round(1.0 / min(k), 6)::DOUBLE AS probability, round(sum(most) / sum(k), 6)::DOUBLE AS impact,
       round(count(*) / sum(k), 6)::DOUBLE AS value, '["c_nationkey", "c_mktsegment"]' AS detail
FROM {_CLASSES.format(q="c_nationkey, c_mktsegment")}""")
def privacy_risk_impact(t: Tables) -> DataFrame:
    found = U.risk(t.customer, _QUASI, F.floor(F.col("c_acctbal") / 2000))
    return found.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("probability", "impact", "value")})


@query("privacy_risk_sets", " UNION ALL ".join(f"""
SELECT '[{", ".join(f'"{c}"' for c in s)}]' AS detail, 'IDENTIFICATION' AS type, round(1.0 / min(k), 6)::DOUBLE AS probability,
       round(sum(most) / sum(k), 6)::DOUBLE AS impact, round(count(*) / sum(k), 6)::DOUBLE AS value, count(*) FILTER (k = 1) AS singled_out
FROM {_CLASSES.format(q=", ".join(s))}""" for size in (1, 2, 3) for s in combinations(("c_nationkey", "c_mktsegment", "c_name"), size)))
def privacy_risk_sets(t: Tables) -> DataFrame:
    found = U.risk_by_set(t.customer, ("c_nationkey", "c_mktsegment", "c_name"), F.floor(F.col("c_acctbal") / 2000))
    return found.withColumns({c: F.round(F.col(c).cast("double"), 6) for c in ("probability", "impact", "value")})
