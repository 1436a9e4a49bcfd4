"""Catalog relations made from the test tables, in Spark and in SQL.

Orders play data sources, line items their attributes and grants, nations the
storages, suppliers the models.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.plans.registry import Tables

USER = 7


def sources(t: Tables) -> DataFrame:
    status = F.col("o_orderstatus")
    return t.orders.select(
        F.col("o_orderkey").alias("id"),
        F.col("o_custkey").alias("user_id"),
        F.concat(F.lit("order "), F.col("o_orderkey").cast("string")).alias("name"),
        F.col("o_orderpriority").alias("format"),
        status.alias("initialization"),
        (status == "P").alias("is_public"),
        (status != "F").alias("enabled"),
        (F.col("o_orderpriority") == "1-URGENT").alias("is_lookup"),
        F.col("o_totalprice").alias("size"),
        F.col("o_orderdate").alias("created"),
    )


SOURCES = """sources AS (
  SELECT o_orderkey AS id, o_custkey AS user_id,
         'order ' || CAST(o_orderkey AS VARCHAR) AS name,
         o_orderpriority AS format, o_orderstatus AS initialization,
         o_orderstatus = 'P' AS is_public, o_orderstatus <> 'F' AS enabled,
         o_orderpriority = '1-URGENT' AS is_lookup,
         o_totalprice AS size, o_orderdate AS created
  FROM orders)"""


def _level():
    flag = F.col("l_returnflag")
    return F.when(flag == "R", "READ").when(flag == "A", "WRITE").otherwise("MANAGE")


def grants(t: Tables) -> DataFrame:
    return t.lineitem.select(
        F.col("l_orderkey").alias("data_source_id"),
        F.col("l_suppkey").alias("user_id"),
        _level().alias("permission"),
    )


GRANTS = """grants AS (
  SELECT l_orderkey AS data_source_id, l_suppkey AS user_id,
         CASE l_returnflag WHEN 'R' THEN 'READ' WHEN 'A' THEN 'WRITE' ELSE 'MANAGE' END AS permission
  FROM lineitem)"""


def unique_grants(t: Tables) -> DataFrame:
    """One permission per (source, user): the first by name.

    The minimum is taken over numbers, which Spark aggregates by hash; for text
    it would sort.
    """
    names = ("MANAGE", "READ", "WRITE")
    listed = F.array(*[F.lit(n) for n in names])
    place = F.array_position(listed, F.col("permission"))
    first = grants(t).groupBy("data_source_id", "user_id").agg(F.min(place).alias("place"))
    return first.select("data_source_id", "user_id", F.element_at(listed, F.col("place").cast("int")).alias("permission"))


UNIQUE_GRANTS = f"""{GRANTS}, unique_grants AS (
  SELECT data_source_id, user_id, min(permission) AS permission FROM grants GROUP BY 1, 2)"""


def attributes(t: Tables) -> DataFrame:
    """Line items as attributes; equal rows count once."""
    lines = t.lineitem.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_linestatus").distinct()
    return lines.select(
        F.col("l_orderkey").alias("data_source_id"),
        F.concat_ws("_", F.lit("a"), "l_partkey", "l_suppkey", "l_linenumber").alias("name"),
        F.col("l_linestatus").alias("type"),
    )


ATTRIBUTES = """attributes AS (
  SELECT DISTINCT l_orderkey AS data_source_id,
         concat_ws('_', 'a', l_partkey, l_suppkey, l_linenumber) AS name,
         l_linestatus AS type
  FROM lineitem)"""


def storages(t: Tables) -> DataFrame:
    return t.nation.select(
        F.col("n_nationkey").alias("id"),
        F.col("n_name").alias("name"),
        F.concat(F.lit("hdfs://"), F.lower("n_name"), F.lit(":9000/data")).alias("url"),
    )


STORAGES = """storages AS (
  SELECT n_nationkey AS id, n_name AS name,
         'hdfs://' || lower(n_name) || ':9000/data' AS url
  FROM nation)"""


def stored_sources(t: Tables) -> DataFrame:
    """Sources with the storage of their owner's nation."""
    owners = t.customer.select("c_custkey", F.col("c_nationkey").alias("storage_id"))
    joined = sources(t).join(owners, F.col("user_id") == F.col("c_custkey"))
    return joined.drop("c_custkey")


STORED_SOURCES = f"""{SOURCES}, stored_sources AS (
  SELECT s.*, c_nationkey AS storage_id FROM sources s JOIN customer ON user_id = c_custkey)"""


def searchable(t: Tables) -> DataFrame:
    return t.part.select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("name"),
        F.col("p_brand").alias("description"),
        F.col("p_type").alias("tags"),
        F.col("p_size").alias("user_id"),
    )


SEARCHABLE = """searchable AS (
  SELECT p_partkey AS id, p_name AS name, p_brand AS description, p_type AS tags,
         p_size AS user_id
  FROM part)"""


def models(t: Tables) -> DataFrame:
    return t.supplier.select(
        F.col("s_suppkey").alias("id"),
        F.col("s_name").alias("name"),
        F.col("s_nationkey").cast("long").alias("user_id"),
        (F.col("s_acctbal") > 0).alias("enabled"),
    )


MODELS = """models AS (
  SELECT s_suppkey AS id, s_name AS name, CAST(s_nationkey AS BIGINT) AS user_id,
         s_acctbal > 0 AS enabled
  FROM supplier)"""


def model_grants(t: Tables) -> DataFrame:
    """Each supplier is shared with the owners of the parts it ships."""
    return t.lineitem.select(
        F.col("l_suppkey").alias("model_id"),
        F.col("l_linenumber").cast("long").alias("user_id"),
        _level().alias("permission"),
    )


MODEL_GRANTS = """model_grants AS (
  SELECT l_suppkey AS model_id, CAST(l_linenumber AS BIGINT) AS user_id,
         CASE l_returnflag WHEN 'R' THEN 'READ' WHEN 'A' THEN 'WRITE' ELSE 'MANAGE' END AS permission
  FROM lineitem)"""
