"""Catalog changes and checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.operators import mutate as M
from dataquay.operators import validate as V
from dataquay.plans import stand_ins as S
from dataquay.plans.registry import Tables, query

OWNER = 42


def _catalog(t: Tables) -> DataFrame:
    """Finished and open orders as the stored catalog."""
    return t.orders.where("o_orderstatus <> 'P'").select(
        F.col("o_orderkey").alias("id"),
        F.concat(F.lit("hdfs://store/"), F.col("o_orderkey").cast("string")).alias("url"),
        F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("format"),
        (F.col("o_orderstatus") == "O").alias("enabled"),
        F.lit(True).alias("read_only"),
        F.lit("INITIALIZED").alias("initialization"),
        F.lit(1).cast("long").alias("storage_id"),
    )


CATALOG = """catalog AS (
  SELECT o_orderkey AS id, 'hdfs://store/' || CAST(o_orderkey AS VARCHAR) AS url, o_custkey AS user_id,
         o_orderpriority AS format, o_orderstatus = 'O' AS enabled, true AS read_only,
         'INITIALIZED' AS initialization, CAST(1 AS BIGINT) AS storage_id
  FROM orders WHERE o_orderstatus <> 'P')"""


@query("create_defaults", f"""
WITH {CATALOG}, {S.STORAGES}
SELECT id, url, user_id, format, enabled, read_only, initialization, storage_id FROM catalog
UNION ALL
SELECT o_orderkey, CASE WHEN o_orderpriority = '1-URGENT' THEN s.url ELSE 'file:///new' END,
       CASE WHEN o_custkey > 100 THEN o_custkey ELSE {OWNER} END,
       CASE WHEN o_orderpriority = '1-URGENT' THEN 'JDBC' ELSE 'CSV' END,
       coalesce(CASE WHEN o_totalprice > 100000 THEN false END, true), true, 'NO_INITIALIZED', o_orderkey % 25
FROM orders JOIN storages s ON s.id = o_orderkey % 25 WHERE o_orderstatus = 'P'""")
def create_defaults(t: Tables) -> DataFrame:
    """Orders in part are new; some fields are left out in some rows."""
    new = t.orders.where("o_orderstatus = 'P'").select(
        F.col("o_orderkey").alias("id"),
        F.lit("file:///new").alias("url"),
        F.when(F.col("o_custkey") > 100, F.col("o_custkey")).alias("user_id"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "JDBC").otherwise("CSV").alias("format"),
        F.when(F.col("o_totalprice") > 100000, False).alias("enabled"),
        (F.col("o_orderkey") % 25).alias("storage_id"),
    )
    return M.create_sources(_catalog(t), new, S.storages(t), OWNER)


@query("create_text_attributes", f"""
WITH {S.ATTRIBUTES}
SELECT data_source_id, name, type FROM attributes
WHERE data_source_id NOT IN (SELECT o_orderkey FROM orders WHERE o_orderpriority = '5-LOW')""")
def create_text_attributes(t: Tables) -> DataFrame:
    text = t.orders.select(
        F.col("o_orderkey").alias("id"), F.when(F.col("o_orderpriority") == "5-LOW", "TEXT").otherwise("CSV").alias("format")
    )
    return M.without_text_attributes(S.attributes(t), text)


@query("upsert", """
WITH old AS (SELECT o_orderkey AS id, 'u' || CAST(o_custkey AS VARCHAR) || '-' || o_orderpriority AS url,
                    o_orderstatus AS name, o_totalprice AS size
             FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey, o_orderpriority ORDER BY o_orderkey) = 1),
new AS (SELECT l_orderkey AS id, 'u' || CAST(l_suppkey AS VARCHAR) || '-5-LOW' AS url, l_returnflag AS name
        FROM lineitem QUALIFY row_number() OVER (PARTITION BY l_suppkey ORDER BY l_shipdate DESC, l_orderkey DESC, l_returnflag DESC) = 1)
SELECT coalesce(old.id, new.id) AS id, coalesce(new.url, old.url) AS url,
       CASE WHEN new.url IS NOT NULL THEN new.name ELSE old.name END AS name, old.size
FROM old FULL JOIN new ON old.url = new.url""")
def upsert(t: Tables) -> DataFrame:
    """The newest line of each supplier replaces or adds a source, by url."""
    url = F.concat(F.lit("u"), F.col("o_custkey").cast("string"), F.lit("-"), F.col("o_orderpriority"))
    named = t.orders.select(
        F.col("o_orderkey").alias("id"), url.alias("url"),
        F.col("o_orderstatus").alias("name"), F.col("o_totalprice").alias("size"), (-F.col("o_orderkey")).alias("age"),
    )
    old = M.latest_per_key(named, ["url"], ["age"]).drop("age")
    new = t.lineitem.select(
        F.col("l_orderkey").alias("id"),
        F.concat(F.lit("u"), F.col("l_suppkey").cast("string"), F.lit("-5-LOW")).alias("url"),
        F.col("l_returnflag").alias("name"), F.col("l_shipdate").alias("updated"),
    )
    return M.upsert(old, new, "url", ["updated", "id"])


@query("upsert_models", """
WITH old AS (SELECT s_suppkey AS id, 'task-' || CAST(s_suppkey AS VARCHAR) AS task_id, s_name AS name, s_acctbal AS score FROM supplier),
new AS (SELECT l_suppkey + l_linenumber * 40 AS number, max(l_shipdate) AS made, max(l_orderkey) AS id FROM lineitem GROUP BY 1)
SELECT coalesce(old.id, new.id) AS id, coalesce(old.task_id, 'task-' || CAST(number AS VARCHAR)) AS task_id,
       CASE WHEN number IS NOT NULL THEN strftime(made, '%Y-%m-%d') ELSE name END AS name, score
FROM old FULL JOIN new ON task_id = 'task-' || CAST(number AS VARCHAR)""")
def upsert_models(t: Tables) -> DataFrame:
    """Models are replaced by the task that made them, and keep their id."""
    old = t.supplier.select(
        F.col("s_suppkey").alias("id"), F.concat(F.lit("task-"), F.col("s_suppkey").cast("string")).alias("task_id"),
        F.col("s_name").alias("name"), F.col("s_acctbal").alias("score"),
    )
    number = F.col("l_suppkey") + F.col("l_linenumber") * 40
    made = t.lineitem.groupBy(number.alias("number")).agg(F.max("l_shipdate").alias("at"), F.max("l_orderkey").alias("id"))
    new = made.select(
        "id", F.concat(F.lit("task-"), F.col("number").cast("string")).alias("task_id"),
        F.date_format("at", "yyyy-MM-dd").alias("name"), "at",
    )
    return M.upsert(old, new, "task_id", ["at"])


@query("partial_update", """
SELECT o_orderkey AS id, CASE WHEN o_orderstatus = 'P' THEN 7 ELSE o_custkey END AS user_id,
       CASE WHEN o_orderstatus = 'P' THEN NULL ELSE o_orderpriority END AS format,
       CASE WHEN o_orderstatus = 'F' THEN CAST(o_custkey AS DOUBLE) ELSE o_totalprice END AS size
FROM orders""")
def partial_update(t: Tables) -> DataFrame:
    """One patch sets a field and clears one; another sets one, after an older patch of it."""
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("user_id"),
        F.col("o_orderpriority").alias("format"), F.col("o_totalprice").alias("size"),
    )
    text = F.col("o_custkey").cast("string")
    none = F.lit(None).cast("string")
    pending = F.create_map(F.lit("user_id"), F.lit("7"), F.lit("format"), none, F.lit("unknown"), F.lit("x"))
    older = F.create_map(F.lit("size"), F.lit("-1"))
    newer = F.create_map(F.lit("size"), text)

    def patch(status: str, version: int, changes) -> DataFrame:
        return t.orders.where(F.col("o_orderstatus") == status).select(
            F.col("o_orderkey").alias("id"), F.lit(version).alias("version"), changes.alias("changes")
        )

    patches = patch("P", 1, pending).unionByName(patch("F", 1, older)).unionByName(patch("F", 2, newer))
    return M.partial_update(rows, patches, "id", ["version"])


@query("soft_delete", f"""
WITH {CATALOG}
SELECT id, user_id, format, enabled AND id NOT IN (SELECT l_orderkey FROM lineitem WHERE l_returnflag = 'R') AS enabled
FROM catalog""")
def soft_delete(t: Tables) -> DataFrame:
    doomed = t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))
    return M.soft_delete(_catalog(t).select("id", "user_id", "format", "enabled"), doomed)


# User 7 asks to change every source with a returned line.
_ASKED = f"""asked AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_returnflag = 'R'),
writable AS (SELECT id, user_id FROM sources WHERE user_id = {S.USER} OR is_public
  OR id IN (SELECT data_source_id FROM grants WHERE user_id = {S.USER} AND permission IN ('MANAGE', 'WRITE')))"""


def _asked(t: Tables) -> DataFrame:
    return t.lineitem.where("l_returnflag = 'R'").select(F.col("l_orderkey").alias("id"))


@query("delete_sources", f"""
WITH {S.SOURCES}, {S.GRANTS}, {_ASKED}
SELECT id, user_id, name, enabled AND NOT (user_id = {S.USER} AND id IN (SELECT id FROM asked)) AS enabled FROM sources""")
def delete_sources(t: Tables) -> DataFrame:
    after, _ = M.delete_sources(S.sources(t), S.grants(t), _asked(t), S.USER)
    return after.select("id", "user_id", "name", "enabled")


@query("delete_outcomes", f"""
WITH {S.SOURCES}, {S.GRANTS}, {_ASKED}
SELECT a.id, CASE WHEN w.id IS NULL THEN 'Not found' WHEN user_id = {S.USER} THEN 'OK' ELSE 'Not authorized' END AS outcome
FROM asked a LEFT JOIN writable w ON w.id = a.id""")
def delete_outcomes(t: Tables) -> DataFrame:
    return M.delete_sources(S.sources(t), S.grants(t), _asked(t), S.USER)[1]


@query("patch_sources", f"""
WITH {S.SOURCES}, {S.GRANTS}, {_ASKED}
SELECT s.id, s.user_id, CASE WHEN w.id IS NOT NULL AND s.id IN (SELECT id FROM asked) THEN 'patched' ELSE s.name END AS name
FROM sources s LEFT JOIN writable w ON w.id = s.id""")
def patch_sources(t: Tables) -> DataFrame:
    """An administrator may change what the user may write."""
    patches = _asked(t).distinct().withColumn("changes", F.create_map(F.lit("name"), F.lit("patched")))
    after, _ = M.patch_sources(S.sources(t).select("id", "user_id", "name", "is_public"), S.grants(t), patches, S.USER, is_admin=True)
    return after.select("id", "user_id", "name")


@query("delete_models", f"""
WITH {S.MODELS}, {S.MODEL_GRANTS}
SELECT id, name, enabled AND NOT (id IN (SELECT s_suppkey FROM supplier WHERE s_acctbal > 5000) AND (user_id = 5
  OR id IN (SELECT model_id FROM model_grants WHERE user_id = 5 AND permission IN ('MANAGE', 'WRITE')))) AS enabled
FROM models""")
def delete_models(t: Tables) -> DataFrame:
    asked = t.supplier.where("s_acctbal > 5000").select(F.col("s_suppkey").alias("id"))
    return M.delete_models(S.models(t), S.model_grants(t), asked, 5).select("id", "name", "enabled")


@query("lookup_violations", f"""
WITH {S.SOURCES}, {S.ATTRIBUTES}
SELECT s.id, s.name, count(a.name) AS attributes FROM sources s LEFT JOIN attributes a ON a.data_source_id = s.id
WHERE is_lookup GROUP BY s.id, s.name HAVING count(a.name) <> 2""")
def lookup_violations(t: Tables) -> DataFrame:
    return M.lookup_violations(S.sources(t), S.attributes(t)).select("id", "name", "attributes")


# Sources that user 7 may manage, and what that user asks for: the lines of
# orders shipped by supplier 7's neighbours become grants.
_MANAGED = f"""managed AS (
  SELECT id FROM sources WHERE user_id = {S.USER} OR is_public
     OR id IN (SELECT data_source_id FROM unique_grants WHERE user_id = {S.USER} AND permission = 'MANAGE'))"""
_REQUESTS = """requests AS (
  SELECT o_orderkey AS data_source_id, o_custkey AS user_id, 'WRITE' AS permission FROM orders
  UNION ALL SELECT l_orderkey, l_suppkey, max('READ') FROM lineitem WHERE l_linestatus = 'O' GROUP BY 1, 2),
wanted AS (SELECT data_source_id, user_id, max(permission) AS permission FROM requests GROUP BY 1, 2)"""


def _share(t: Tables):
    asked = t.orders.select(
        F.col("o_orderkey").alias("data_source_id"), F.col("o_custkey").alias("user_id"), F.lit("WRITE").alias("permission")
    ).unionByName(
        t.lineitem.where("l_linestatus = 'O'").select(
            F.col("l_orderkey").alias("data_source_id"), F.col("l_suppkey").alias("user_id"), F.lit("READ").alias("permission")
        )
    )
    return M.share(S.unique_grants(t), asked, S.sources(t), S.USER)


@query("permission_upsert", f"""
WITH {S.SOURCES}, {S.UNIQUE_GRANTS}, {_MANAGED}, {_REQUESTS},
allowed AS (SELECT * FROM wanted WHERE data_source_id IN (SELECT id FROM managed))
SELECT coalesce(g.data_source_id, a.data_source_id) AS data_source_id, coalesce(g.user_id, a.user_id) AS user_id,
       coalesce(a.permission, g.permission) AS permission
FROM unique_grants g FULL JOIN allowed a ON g.data_source_id = a.data_source_id AND g.user_id = a.user_id""")
def permission_upsert(t: Tables) -> DataFrame:
    return _share(t)[0]


@query("permission_actions", f"""
WITH {S.SOURCES}, {S.UNIQUE_GRANTS}, {_MANAGED}, {_REQUESTS}
SELECT a.data_source_id, a.user_id, a.permission, CASE WHEN g.permission IS NULL THEN 'Added' ELSE 'Updated' END AS action
FROM wanted a LEFT JOIN unique_grants g ON g.data_source_id = a.data_source_id AND g.user_id = a.user_id
WHERE a.data_source_id IN (SELECT id FROM managed)""")
def permission_actions(t: Tables) -> DataFrame:
    return _share(t)[1]


@query("permission_revoke", f"""
WITH {S.SOURCES}, {S.UNIQUE_GRANTS}, {_MANAGED}
SELECT g.* FROM unique_grants g
WHERE NOT (g.data_source_id IN (SELECT id FROM managed)
  AND EXISTS (SELECT 1 FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey = g.data_source_id AND l_suppkey = g.user_id))""")
def permission_revoke(t: Tables) -> DataFrame:
    revoked = t.lineitem.where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("data_source_id"), F.col("l_suppkey").alias("user_id")
    )
    return M.revoke(S.unique_grants(t), revoked, S.sources(t), S.USER)


@query("set_initialization", """
SELECT o_orderkey AS id, CASE WHEN o_orderkey = 7 THEN 'INITIALIZING' ELSE o_orderstatus END AS initialization FROM orders""")
def set_initialization(t: Tables) -> DataFrame:
    return M.set_initialization(S.sources(t).select("id", "initialization"), 7, "INITIALIZING")


@query("touch_parent", """
SELECT o_orderkey AS id, strftime(greatest(o_orderdate, (SELECT max(l_shipdate) FROM lineitem WHERE l_orderkey = o_orderkey)), '%Y-%m-%d') AS updated
FROM orders""")
def touch_parent(t: Tables) -> DataFrame:
    parents = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("updated"))
    children = t.lineitem.select("l_orderkey", F.col("l_shipdate").alias("updated"))
    touched = M.touch_parents(parents, children, "l_orderkey")
    return touched.withColumn("updated", F.date_format("updated", "yyyy-MM-dd"))


def _expiring(t: Tables) -> DataFrame:
    """Open orders are temporary; urgent ones have no readable expiration."""
    day = F.date_format("o_orderdate", "yyyy-MM-dd")
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        (F.col("o_orderstatus") == "O").alias("temporary"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "never").otherwise(day).alias("expiration"),
    )


_OVER = "o_orderstatus = 'O' AND o_orderpriority <> '1-URGENT' AND o_orderdate < TIMESTAMP '1998-01-01'"


@query("expired_sources", f"SELECT o_orderkey AS id FROM orders WHERE {_OVER}")
def expired_sources(t: Tables) -> DataFrame:
    return M.expired(_expiring(t), F.lit("1998-01-01").cast("timestamp_ntz")).select("id")


@query("purge_expired", f"SELECT o_orderkey AS id FROM orders WHERE NOT ({_OVER})")
def purge_expired(t: Tables) -> DataFrame:
    return M.purge_expired(_expiring(t), F.lit("1998-01-01").cast("timestamp_ntz")).select("id")


# --- validation ------------------------------------------------------------

def _drafts(t: Tables) -> DataFrame:
    """Orders as source drafts with gaps, blanks and unknown names."""
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.when(status != "P", F.concat(F.lit("order "), priority)).alias("name"),
        F.when(priority == "5-LOW", "  ").otherwise("file:///x").alias("url"),
        F.when(priority == "1-URGENT", "CSV").when(priority == "2-HIGH", "PARQUET").when(priority != "5-LOW", priority).alias("format"),
        F.when(status == "F", "INITIALIZED").when(status == "O", "started").alias("initialization"),
        F.when(F.col("o_totalprice") > 100000, F.col("o_custkey")).alias("storage_id"),
        F.lit("dropped").alias("no_such_field"),
    )


_MISSING = """concat_ws(';', CASE WHEN o_orderstatus = 'P' THEN 'Missing: name' END,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'Missing: url' END,
  CASE WHEN o_orderpriority = '5-LOW' THEN 'Missing: format' END,
  CASE WHEN NOT o_totalprice > 100000 THEN 'Missing: storage_id' END)"""


@query("validate_required", f"""
SELECT id, errors, nullif(split_part(errors, ';', 1), '') AS first_error FROM (SELECT o_orderkey AS id, {_MISSING} AS errors FROM orders)""")
def validate_required(t: Tables) -> DataFrame:
    checked = V.check_rows(_drafts(t), V.SOURCE_REQUIRED)
    return checked.select("id", F.array_join("errors", ";").alias("errors"), V.first_error().alias("first_error"))


@query("validate_enum", """
SELECT o_orderkey AS id, concat_ws(';',
  CASE WHEN o_orderpriority IN ('3-MEDIUM', '4-NOT SPECIFIED') THEN 'Invalid: format' END,
  CASE WHEN o_orderstatus = 'O' THEN 'Invalid: initialization' END) AS errors
FROM orders""")
def validate_enum(t: Tables) -> DataFrame:
    known = V.known_fields(_drafts(t), ["id", "format", "initialization"])
    return V.check_rows(known, enums=V.SOURCE_ENUMS).select("id", F.array_join("errors", ";").alias("errors"))
