"""Catalog questions: filters, visibility, projections, paging, nesting."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.functions.text import iso_datetime
from dataquay.operators import catalog as K
from dataquay.operators import listing as Q
from dataquay.operators import nested as N
from dataquay.operators import relations as R
from dataquay.plans import stand_ins as S
from dataquay.plans.registry import Tables, query
from dataquay.vocabulary import WRITE_LEVELS

SOURCE_COLUMNS = "id, user_id, name, format, initialization, is_public"


def _listed(df: DataFrame) -> DataFrame:
    return K.project_fields(df, SOURCE_COLUMNS)


# --- projections -----------------------------------------------------------

@query("project_fields", f"WITH {S.SOURCES} SELECT id, name, format FROM sources")
def project_fields(t: Tables) -> DataFrame:
    return K.project_fields(S.sources(t), "id, name , format")


@query("project_simple", f"WITH {S.SOURCES} SELECT id, name, strftime(created, '%Y-%m-%d') AS created, format, user_id FROM sources")
def project_simple(t: Tables) -> DataFrame:
    simple = K.project_preset(S.sources(t), K.SIMPLE_SOURCE_FIELDS)
    return simple.withColumn("created", F.date_format("created", "yyyy-MM-dd"))


@query("project_list", f"WITH {S.SEARCHABLE} SELECT id, name, tags FROM searchable")
def project_list(t: Tables) -> DataFrame:
    return K.project_preset(S.searchable(t), K.LIST_FIELDS)


@query("attribute_names", f"""
WITH {S.SOURCES}, {S.ATTRIBUTES}
SELECT s.id, CAST(0 AS BIGINT) AS part, coalesce(string_agg(a.name, ',' ORDER BY a.name), '') AS attributes
FROM sources s LEFT JOIN attributes a ON a.data_source_id = s.id GROUP BY s.id""")
def attribute_names(t: Tables) -> DataFrame:
    documents = N.nest_children(
        S.sources(t).select("id"), "id",
        {"attributes": N.Children(S.attributes(t), "data_source_id", ("name", "type"))},
    )
    named = K.attribute_names(documents)
    return named.withColumn("attributes", F.array_join("attributes", ","))


@query("mask_by_role", f"""
WITH {S.STORED_SOURCES}, {S.STORAGES}
SELECT s.id, s.user_id,
       CASE WHEN s.user_id = {S.USER} THEN strftime(s.created, '%Y-%m-%d') END AS created,
       st.name AS storage_name,
       CASE WHEN s.user_id = {S.USER} THEN st.url END AS storage_url
FROM stored_sources s JOIN storages st ON st.id = s.storage_id""")
def mask_by_role(t: Tables) -> DataFrame:
    full = N.with_storage(S.stored_sources(t), S.storages(t))
    allowed = K.owner_or_admin(F.col("user_id"), S.USER, is_admin=False)
    hidden = K.hide_unless(full, ["created", "storage.url"], allowed)
    return hidden.select(
        "id", "user_id", F.date_format("created", "yyyy-MM-dd").alias("created"),
        F.col("storage.name").alias("storage_name"), F.col("storage.url").alias("storage_url"),
    )


@query("json_without_nulls", """
SELECT o_orderkey AS id,
       '{"id":' || CAST(o_orderkey AS VARCHAR)
       || CASE WHEN o_orderstatus <> 'P' THEN ',"status":"' || o_orderstatus || '"' ELSE '' END
       || ',"tags":[]}' AS document
FROM orders""")
def json_without_nulls(t: Tables) -> DataFrame:
    rows = t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.nullif("o_orderstatus", F.lit("P")).alias("status"),
        F.array().cast("array<string>").alias("tags"),
    )
    return rows.select("id", K.json_without_nulls(["id", "status", "tags"]).alias("document"))


@query("iso_render", """
SELECT event_id,
       strftime(ts, '%Y-%m-%dT%H:%M:%S')
       || CASE WHEN strftime(ts, '%f') <> '000000' THEN '.' || strftime(ts, '%f') ELSE '' END AS ts,
       CAST(CAST(value AS DECIMAL(18,2)) AS VARCHAR) AS value
FROM events""")
def iso_render(t: Tables) -> DataFrame:
    return t.events.select(
        "event_id", iso_datetime(F.col("ts")).alias("ts"),
        F.col("value").cast("decimal(18,2)").cast("string").alias("value"),
    )


# --- filters ---------------------------------------------------------------

@query("filter_equality", f"WITH {S.SOURCES} SELECT {SOURCE_COLUMNS} FROM sources WHERE format = '2-HIGH' AND user_id = {S.USER}")
def filter_equality(t: Tables) -> DataFrame:
    wanted = {"format": "2-HIGH", "user_id": S.USER, "initialization": " ", "id": None}
    return _listed(K.filter_equal(S.sources(t), **wanted))


@query("filter_flags", f"WITH {S.SOURCES} SELECT {SOURCE_COLUMNS} FROM sources WHERE is_lookup")
def filter_flags(t: Tables) -> DataFrame:
    return _listed(K.filter_flags(S.sources(t), is_lookup="1", is_public="false"))


@query("filter_enabled", f"WITH {S.MODELS} SELECT * FROM models WHERE enabled")
def filter_enabled(t: Tables) -> DataFrame:
    return K.filter_equal(S.models(t), enabled=True)


@query("filter_in", f"WITH {S.SOURCES} SELECT {SOURCE_COLUMNS} FROM sources WHERE format IN ('1-URGENT', '5-LOW')")
def filter_in(t: Tables) -> DataFrame:
    allowed = ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")
    return _listed(K.filter_in(S.sources(t), "format", "1-URGENT,CSV,5-LOW", allowed))


@query("search_text", f"""WITH {S.SEARCHABLE} SELECT * FROM searchable
WHERE name ILIKE '%RED%' OR description ILIKE '%RED%' OR tags ILIKE '%RED%'""")
def search_text(t: Tables) -> DataFrame:
    return K.search_text(S.searchable(t), "RED", ("name", "description", "tags"))


@query("search_like", f"WITH {S.SEARCHABLE} SELECT * FROM searchable WHERE name LIKE '%ring%' OR tags LIKE '%ring%'")
def search_like(t: Tables) -> DataFrame:
    return K.search_like(S.searchable(t), "ring", ("name", "tags"))


# --- visibility ------------------------------------------------------------

@query("visible_sources", f"""
WITH {S.SOURCES}, {S.GRANTS}
SELECT {SOURCE_COLUMNS} FROM sources
WHERE user_id = {S.USER} OR is_public
   OR id IN (SELECT data_source_id FROM grants WHERE user_id = {S.USER})""")
def visible_sources(t: Tables) -> DataFrame:
    return _listed(K.visible_sources(S.sources(t), S.grants(t), S.USER))


@query("visible_sources_write", f"""
WITH {S.SOURCES}, {S.GRANTS}
SELECT {SOURCE_COLUMNS} FROM sources
WHERE user_id = {S.USER}
   OR id IN (SELECT data_source_id FROM grants
             WHERE user_id = {S.USER} AND permission IN ('MANAGE', 'WRITE'))""")
def visible_sources_write(t: Tables) -> DataFrame:
    return _listed(K.visible_sources(S.sources(t), S.grants(t), S.USER, WRITE_LEVELS, consider_public=False))


@query("visible_models", f"""
WITH {S.MODELS}, {S.MODEL_GRANTS}
SELECT * FROM models
WHERE enabled AND (user_id = {S.USER}
   OR id IN (SELECT model_id FROM model_grants WHERE user_id = {S.USER}))""")
def visible_models(t: Tables) -> DataFrame:
    enabled = K.filter_equal(S.models(t), enabled=True)
    return K.visible_models(enabled, S.model_grants(t), S.USER)


@query("shared_sources", f"""
WITH {S.SOURCES}, {S.GRANTS}
SELECT {SOURCE_COLUMNS} FROM sources
WHERE id IN (SELECT data_source_id FROM grants WHERE user_id = {S.USER} AND permission = 'READ')""")
def shared_sources(t: Tables) -> DataFrame:
    return _listed(K.shared_sources(S.sources(t), S.grants(t), S.USER, ["READ"]))


# --- nested documents ------------------------------------------------------

@query("sources_with_attributes", f"""
WITH {S.SOURCES}, {S.ATTRIBUTES}
SELECT s.id, s.name, CAST(0 AS BIGINT) AS part, count(a.name) AS n_attributes,
       coalesce(string_agg(a.name || ':' || a.type, ',' ORDER BY a.name, a.type), '') AS attributes
FROM sources s LEFT JOIN attributes a ON a.data_source_id = s.id GROUP BY s.id, s.name""")
def sources_with_attributes(t: Tables) -> DataFrame:
    documents = N.nest_children(
        S.sources(t).select("id", "name"), "id",
        {"attributes": N.Children(S.attributes(t), "data_source_id", ("name", "type"))},
    )
    text = F.transform("attributes", lambda a: F.concat(a["name"], F.lit(":"), a["type"]))
    return documents.select(
        "id", "name", "part", F.size("attributes").cast("long").alias("n_attributes"),
        F.array_join(text, ",").alias("attributes"),
    )


@query("sources_with_storage", f"""
WITH {S.STORED_SOURCES}, {S.STORAGES}
SELECT s.id, s.name, st.id AS storage_id, st.name AS storage_name, st.url AS storage_url
FROM stored_sources s JOIN storages st ON st.id = s.storage_id""")
def sources_with_storage(t: Tables) -> DataFrame:
    joined = N.with_storage(S.stored_sources(t), S.storages(t))
    return joined.select(
        "id", "name", "storage_id", F.col("storage.name").alias("storage_name"),
        F.col("storage.url").alias("storage_url"),
    )


def _privacy(t: Tables) -> DataFrame:
    """Orders that are not finished have a privacy setting, by status."""
    return t.orders.where("o_orderstatus <> 'F'").select(
        F.col("o_orderkey").alias("attribute_id"),
        F.when(F.col("o_orderstatus") == "O", "MASK").otherwise("SUPPRESSION").alias("technique"),
        F.when(F.col("o_totalprice") > 100000, "SENSITIVE").otherwise("QUASI_IDENTIFIER").alias("privacy_type"),
    )


PRIVACY = """privacy AS (
  SELECT o_orderkey AS attribute_id,
         CASE o_orderstatus WHEN 'O' THEN 'MASK' ELSE 'SUPPRESSION' END AS technique,
         CASE WHEN o_totalprice > 100000 THEN 'SENSITIVE' ELSE 'QUASI_IDENTIFIER' END AS privacy_type
  FROM orders WHERE o_orderstatus <> 'F')"""


def _customer_attributes(t: Tables) -> DataFrame:
    """Orders as the attributes of the customer that placed them."""
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("data_source_id"),
        F.concat(F.lit("attr"), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderpriority").alias("type"),
    )


CUSTOMER_ATTRIBUTES = """customer_attributes AS (
  SELECT o_orderkey AS id, o_custkey AS data_source_id,
         'attr' || CAST(o_orderkey AS VARCHAR) AS name, o_orderpriority AS type
  FROM orders)"""


@query("attributes_with_privacy", f"""
WITH {CUSTOMER_ATTRIBUTES}, {PRIVACY}
SELECT a.id, a.data_source_id, a.name, a.type, p.technique, p.privacy_type
FROM customer_attributes a LEFT JOIN privacy p ON p.attribute_id = a.id""")
def attributes_with_privacy(t: Tables) -> DataFrame:
    joined = N.with_privacy(_customer_attributes(t), _privacy(t))
    return joined.select("id", "data_source_id", "name", "type", "privacy.technique", "privacy.privacy_type")


def _customer_sources(t: Tables) -> DataFrame:
    return t.customer.select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        (F.col("c_acctbal") > 0).alias("enabled"),
        (F.col("c_mktsegment") != "MACHINERY").alias("privacy_aware"),
    )


@query("privacy_view", f"""
WITH {CUSTOMER_ATTRIBUTES}, {PRIVACY}
SELECT c_custkey AS data_source_id, c_name AS data_source_name, a.id AS attribute_id, a.name, a.type,
       p.technique, p.privacy_type
FROM customer JOIN customer_attributes a ON a.data_source_id = c_custkey
JOIN privacy p ON p.attribute_id = a.id
WHERE c_acctbal > 0 AND c_mktsegment <> 'MACHINERY'""")
def privacy_view(t: Tables) -> DataFrame:
    return N.privacy_view(_customer_sources(t), _customer_attributes(t), _privacy(t))


@query("privacy_group_expand", """
WITH policies AS (
  SELECT o_custkey AS group_id, max(o_orderkey) AS id FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1),
chosen AS (
  SELECT p.group_id, o_orderpriority AS technique FROM policies p JOIN orders ON o_orderkey = p.id)
SELECT o_orderkey AS id, o_custkey AS group_id, technique
FROM orders LEFT JOIN chosen ON group_id = o_custkey""")
def privacy_group_expand(t: Tables) -> DataFrame:
    attributes = t.orders.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("group_id"))
    policies = t.orders.where("o_orderstatus <> 'F'").select(
        F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("group_id"),
        F.col("o_orderpriority").alias("technique"),
    )
    return N.expand_groups(attributes, policies)


@query("source_document", f"""
WITH {S.STORED_SOURCES}, {S.STORAGES}, {S.ATTRIBUTES}, {S.UNIQUE_GRANTS},
att AS (SELECT data_source_id, string_agg(name, ',' ORDER BY name) AS names FROM attributes GROUP BY 1),
per AS (SELECT data_source_id, string_agg(CAST(user_id AS VARCHAR) || ':' || permission, ',' ORDER BY user_id) AS granted
        FROM unique_grants GROUP BY 1),
var AS (SELECT data_source_id, string_agg(name, ',' ORDER BY name) AS names
        FROM (SELECT DISTINCT l_orderkey AS data_source_id, l_returnflag AS name FROM lineitem) GROUP BY 1)
SELECT s.id, s.name, st.name AS storage_name, CAST(0 AS BIGINT) AS part, coalesce(att.names, '') AS attributes,
       coalesce(var.names, '') AS variables, coalesce(per.granted, '') AS permissions
FROM stored_sources s JOIN storages st ON st.id = s.storage_id
LEFT JOIN att ON att.data_source_id = s.id LEFT JOIN per ON per.data_source_id = s.id
LEFT JOIN var ON var.data_source_id = s.id""")
def source_document(t: Tables) -> DataFrame:
    variables = t.lineitem.select(
        F.col("l_orderkey").alias("data_source_id"), F.col("l_returnflag").alias("name")
    ).distinct()
    documents = N.source_documents(
        S.stored_sources(t), S.storages(t),
        {
            "attributes": N.Children(S.attributes(t), "data_source_id", ("name", "type")),
            "variables": N.Children(variables, "data_source_id", ("name",)),
            "permissions": N.Children(S.unique_grants(t), "data_source_id", ("user_id", "permission")),
        },
    )

    def names(column: str):
        return F.array_join(F.transform(column, lambda x: x["name"]), ",").alias(column)

    granted = F.transform(
        "permissions", lambda p: F.concat_ws(":", p["user_id"].cast("string"), p["permission"])
    )
    return documents.select(
        "id", "name", F.col("storage.name").alias("storage_name"), "part",
        names("attributes"), names("variables"), F.array_join(granted, ",").alias("permissions"),
    )


# --- foreign keys and lookups ----------------------------------------------

@query("fk_join", """
SELECT l_orderkey, l_partkey, l_linenumber, l_quantity, o_custkey, c_name
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey""")
def fk_join(t: Tables) -> DataFrame:
    orders = R.join_by_key(t.lineitem, t.orders, [R.KeyPart(0, "l_orderkey", "o_orderkey")])
    full = R.join_by_key(orders, t.customer, [R.KeyPart(0, "o_custkey", "c_custkey")])
    return full.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "o_custkey", "c_name")


@query("fk_orphans", """
SELECT 'lineitem-part' AS fk, count(l_partkey) AS child_rows,
       count(l_partkey) FILTER (NOT EXISTS (SELECT 1 FROM part WHERE p_size > 10 AND p_partkey = l_partkey)) AS orphan_rows
FROM lineitem
UNION ALL
SELECT 'lineitem-supplier+nation', count(*),
       count(*) FILTER (s_nationkey IS NOT NULL AND NOT EXISTS (
         SELECT 1 FROM supplier x WHERE x.s_acctbal > 0 AND x.s_suppkey = l_suppkey AND x.s_nationkey = s.s_nationkey))
FROM lineitem LEFT JOIN supplier s ON s.s_suppkey = l_suppkey""")
def fk_orphans(t: Tables) -> DataFrame:
    parts = t.part.where("p_size > 10")
    one = R.count_orphans("lineitem-part", t.lineitem, parts, [R.KeyPart(0, "l_partkey", "p_partkey")])
    # A key of two columns; the declared order of its parts decides the pairs.
    shipped = t.lineitem.join(t.supplier, F.col("l_suppkey") == F.col("s_suppkey"), "left").select(
        "l_suppkey", F.col("s_nationkey").alias("l_nationkey")
    )
    two = R.count_orphans(
        "lineitem-supplier+nation", shipped, t.supplier.where("s_acctbal > 0"),
        [R.KeyPart(1, "l_nationkey", "s_nationkey"), R.KeyPart(0, "l_suppkey", "s_suppkey")],
    )
    return one.unionByName(two)


@query("fk_orphan_rows", """
SELECT l_orderkey, l_partkey, l_linenumber FROM lineitem
WHERE NOT EXISTS (SELECT 1 FROM part WHERE p_size > 10 AND p_partkey = l_partkey)""")
def fk_orphan_rows(t: Tables) -> DataFrame:
    parts = t.part.where("p_size > 10")
    found = R.orphans(t.lineitem, parts, [R.KeyPart(0, "l_partkey", "p_partkey")])
    return found.select("l_orderkey", "l_partkey", "l_linenumber")


@query("lookup_enrich", """
SELECT c_custkey, c_name, c_nationkey, n_name AS nation
FROM customer LEFT JOIN nation ON n_nationkey = c_nationkey""")
def lookup_enrich(t: Tables) -> DataFrame:
    lookup = t.nation.select("n_nationkey", "n_name")
    decoded = R.decode(t.customer, "c_nationkey", lookup, "nation")
    return decoded.select("c_custkey", "c_name", "c_nationkey", "nation")


# --- sorting, paging, sampling ---------------------------------------------

SORT_KEYS = ("created", "id", "user_id")


@query("page_summary", f"WITH {S.SOURCES} SELECT count(*) AS total, CAST(ceil(count(*) / 20.0) AS BIGINT) AS pages FROM sources WHERE is_public")
def page_summary(t: Tables) -> DataFrame:
    return K.page_summary(S.sources(t).where("is_public"))


def _paged(df: DataFrame) -> DataFrame:
    return df.select("rank", "id", "user_id", "name")


@query("sort_page", f"""WITH {S.SOURCES}, r AS (
  SELECT row_number() OVER (ORDER BY created, id) AS rank, id, user_id, name FROM sources)
SELECT * FROM r WHERE rank BETWEEN 41 AND 60""")
def sort_page(t: Tables) -> DataFrame:
    return _paged(K.page(S.sources(t), K.sort_columns("created", SORT_KEYS), number=3))


@query("sort_page_desc", f"""WITH {S.SOURCES}, r AS (
  SELECT row_number() OVER (ORDER BY id DESC) AS rank, id, user_id, name FROM sources)
SELECT * FROM r WHERE rank BETWEEN 11 AND 20""")
def sort_page_desc(t: Tables) -> DataFrame:
    order = K.sort_columns("no_such_column", SORT_KEYS, ascending=False)
    return _paged(K.page(S.sources(t), order, number=2, size=10))


@query("page_deep", f"""WITH {S.SOURCES}, {S.GRANTS}, pairs AS (
  SELECT row_number() OVER (ORDER BY created, id, g.user_id, permission) AS rank,
         id, g.user_id, permission
  FROM sources JOIN grants g ON data_source_id = id)
SELECT * FROM pairs WHERE rank BETWEEN 40001 AND 50000""")
def page_deep(t: Tables) -> DataFrame:
    granted = S.grants(t).join(
        S.sources(t).select("id", "created"), F.col("data_source_id") == F.col("id")
    )
    order = [F.col(c) for c in ("created", "id", "user_id", "permission")]
    return K.rows_between(granted, order, 40_000, 50_000, K.Lead("created")).select("rank", "id", "user_id", "permission")


@query("page_deep_desc", """
WITH r AS (SELECT row_number() OVER (ORDER BY value DESC, event_id) AS rank, event_id, user_id FROM events)
SELECT * FROM r WHERE rank BETWEEN 3001 AND 5000""")
def page_deep_desc(t: Tables) -> DataFrame:
    order = [F.col("value").desc(), F.col("event_id")]
    return K.rows_between(t.events, order, 3000, 5000, K.Lead("value", False)).select("rank", "event_id", "user_id")


@query("page_fallback", f"""WITH {S.SOURCES}, r AS (
  SELECT row_number() OVER (ORDER BY created, id) AS rank, id, user_id, name
  FROM sources WHERE user_id = {S.USER})
SELECT rank, id, user_id, name FROM r WHERE rank <= 20 AND (SELECT count(*) FROM r) < 20
   OR rank BETWEEN 41 AND 60 AND (SELECT count(*) FROM r) >= 20""")
def page_fallback(t: Tables) -> DataFrame:
    mine = K.filter_equal(S.sources(t), user_id=S.USER)
    return _paged(K.page_or_first(mine, K.sort_columns("created", SORT_KEYS), number=3))


@query("sample_head", "SELECT least(count(*), 100) AS sampled, least(count(*), 100) AS known FROM orders")
def sample_head(t: Tables) -> DataFrame:
    sample = K.sample_head(t.orders)
    known = t.orders.select(F.col("o_orderkey").alias("_key"), F.lit(True).alias("_known"))
    joined = sample.join(known, sample["o_orderkey"] == known["_key"], "left")
    return joined.agg(F.count("*").alias("sampled"), F.count("_known").alias("known"))


# --- whole requests --------------------------------------------------------

_VISIBLE = f"""visible AS (
  SELECT * FROM sources
  WHERE enabled AND name ILIKE '%order 1%' AND (user_id = {S.USER} OR is_public
     OR id IN (SELECT data_source_id FROM grants WHERE user_id = {S.USER})))"""


def _request(**more) -> Q.Request:
    return Q.Request(S.USER, text="ORDER 1", enabled="true", sort="user_id", ascending=False, **more)


@query("list_sources", f"""
WITH {S.SOURCES}, {S.GRANTS}, {S.ATTRIBUTES}, {_VISIBLE},
ranked AS (SELECT row_number() OVER (ORDER BY user_id DESC, id) AS rank, id, name, user_id FROM visible),
att AS (SELECT data_source_id, string_agg(name || ':' || type, ',' ORDER BY name, type) AS listed FROM attributes GROUP BY 1)
SELECT rank, id, name, user_id, coalesce(listed, '') AS attributes
FROM ranked LEFT JOIN att ON data_source_id = id WHERE rank BETWEEN 51 AND 100""")
def list_sources(t: Tables) -> DataFrame:
    rows, _ = Q.list_sources(S.sources(t), S.grants(t), S.attributes(t), _request(page=2, size=50))
    text = F.transform("attributes", lambda a: F.concat_ws(":", a["name"], a["type"]))
    return rows.select("rank", "id", "name", "user_id", F.array_join(text, ",").alias("attributes"))


@query("list_sources_summary", f"""
WITH {S.SOURCES}, {S.GRANTS}, {_VISIBLE}
SELECT count(*) AS total, CAST(ceil(count(*) / 50.0) AS BIGINT) AS pages FROM visible""")
def list_sources_summary(t: Tables) -> DataFrame:
    return Q.list_sources(S.sources(t), S.grants(t), S.attributes(t), _request(size=50, simple=True))[1]


@query("list_models", f"""
WITH {S.MODELS}, {S.MODEL_GRANTS}, {S.STORAGES}, ranked AS (
  SELECT row_number() OVER (ORDER BY name, id) AS rank, * FROM models
  WHERE enabled AND name LIKE '%Supplier%' AND (user_id = 5 OR id IN (SELECT model_id FROM model_grants WHERE user_id = 5)))
SELECT rank, r.id, r.name, st.name AS storage_name FROM ranked r JOIN storages st ON st.id = r.user_id WHERE rank <= 20""")
def list_models(t: Tables) -> DataFrame:
    models = S.models(t).withColumns({"type": F.lit("KERAS"), "storage_id": F.col("user_id")})
    rows, _ = Q.list_models(models, S.model_grants(t), S.storages(t), Q.Request(5, text="Supplier", types="KERAS"))
    return rows.select("rank", "id", "name", F.col("storage.name").alias("storage_name"))


@query("list_storages", f"""
WITH {S.STORAGES}, ranked AS (SELECT row_number() OVER (ORDER BY name DESC, id) AS rank, id, name FROM storages WHERE name ILIKE '%nation_1%')
SELECT * FROM ranked WHERE rank BETWEEN 6 AND 10""")
def list_storages(t: Tables) -> DataFrame:
    typed = S.storages(t).withColumn("type", F.lit("HDFS"))
    request = Q.Request(S.USER, text="nation_1", sort="name", ascending=False, page=2, size=5)
    return Q.list_storages(typed, request)[0].drop("type")


@query("source_by_id", f"""
WITH {S.STORED_SOURCES}, {S.STORAGES}, {S.ATTRIBUTES}, {S.GRANTS}
SELECT s.id, s.name, st.name AS storage_name, CASE WHEN s.user_id = {S.USER} THEN st.url END AS storage_url,
       (SELECT coalesce(string_agg(a.name, ',' ORDER BY a.name), '') FROM attributes a WHERE a.data_source_id = s.id) AS attributes
FROM stored_sources s JOIN storages st ON st.id = s.storage_id
WHERE s.id = (SELECT min(id) FROM stored_sources WHERE user_id = {S.USER})""")
def source_by_id(t: Tables) -> DataFrame:
    """The user's own source: its locations show."""
    return _document(t, S.sources(t).where(F.col("user_id") == S.USER).agg(F.min("id")).first()[0])


@query("source_by_id_shared", f"""
WITH {S.STORED_SOURCES}, {S.STORAGES}, {S.ATTRIBUTES}, {S.GRANTS}
SELECT s.id, s.name, st.name AS storage_name, CAST(NULL AS VARCHAR) AS storage_url,
       (SELECT coalesce(string_agg(a.name, ',' ORDER BY a.name), '') FROM attributes a WHERE a.data_source_id = s.id) AS attributes
FROM stored_sources s JOIN storages st ON st.id = s.storage_id
WHERE s.id = (SELECT min(g.data_source_id) FROM grants g JOIN stored_sources o ON o.id = g.data_source_id
              WHERE g.user_id = {S.USER} AND o.user_id <> {S.USER})""")
def source_by_id_shared(t: Tables) -> DataFrame:
    """A source of someone else that the user may read: its locations are hidden."""
    shared = S.grants(t).where(F.col("user_id") == S.USER).select(F.col("data_source_id").alias("id"))
    others = S.sources(t).where(F.col("user_id") != S.USER).join(shared, "id", "left_semi")
    return _document(t, others.agg(F.min("id")).first()[0])


def _document(t: Tables, key: int) -> DataFrame:
    document = Q.source_by_id(
        S.stored_sources(t), S.grants(t), S.storages(t), {"attributes": S.attributes(t)}, key, S.USER
    )
    names = F.array_join(F.transform("attributes", lambda a: a["name"]), ",")
    return document.select(
        "id", "name", F.col("storage.name").alias("storage_name"), F.col("storage.url").alias("storage_url"),
        names.alias("attributes"),
    )
