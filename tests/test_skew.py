"""Queries with joins and groups, on tables where one key holds a third of the rows.

Broadcasts are off and AQE splits partitions of any size, so that the plans
are those of large tables.
"""

import pytest
from compare import TABLES, compare, duckdb_connection
from conftest import SF_DIR

from dataquay.plans import QUERIES, Tables

SKEWED = {
    "customer": "SELECT * REPLACE (CASE WHEN c_custkey % 3 = 0 THEN 3 ELSE c_nationkey END::INTEGER AS c_nationkey) FROM customer",
    "orders": "SELECT * REPLACE (CASE WHEN o_orderkey % 3 = 0 THEN 7 ELSE o_custkey END AS o_custkey) FROM orders",
    "lineitem": """SELECT * REPLACE (CASE WHEN l_partkey % 3 = 0 THEN 7 ELSE l_orderkey END AS l_orderkey,
                   CASE WHEN l_partkey % 3 = 1 THEN 7 ELSE l_suppkey END AS l_suppkey) FROM lineitem""",
    "events": "SELECT * REPLACE (CASE WHEN event_id % 3 = 0 THEN 7 ELSE user_id END AS user_id) FROM events",
    "documents": """SELECT * REPLACE (CASE WHEN doc_id % 3 = 0 THEN (SELECT text FROM documents WHERE doc_id = 1) ELSE text END AS text,
                    CASE WHEN doc_id % 3 = 0 THEN 'src0' ELSE source END AS source) FROM documents""",
}
GROUPED = (
    "anonymize_hierarchy", "attribute_names", "attributes_with_privacy", "create_text_attributes", "delete_outcomes",
    "delete_sources", "fk_join", "fk_orphan_rows", "fk_orphans", "infer_delimiter_by_source", "infer_mixed_columns",
    "k_anonymity", "l_diversity", "l_diversity_lines", "list_sources", "lookup_enrich", "lookup_violations", "page_deep",
    "partial_update", "patch_sources", "permission_actions", "permission_revoke", "permission_upsert", "privacy_group_expand",
    "privacy_risk", "privacy_view", "profile_columns", "profile_deciles", "replace_attributes", "resolve_location",
    "shared_sources", "soft_delete", "source_document", "sources_with_attributes", "sources_with_storage",
    "stream_upload_completeness", "touch_parent", "upload_completeness", "upload_missing_parts", "upsert", "upsert_models",
    "visible_models", "visible_sources", "visible_sources_write",
)
LARGE_PLANS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "4k",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "4k",
}


@pytest.fixture(scope="module")
def skewed(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("skewed")
    con = duckdb_connection(SF_DIR)
    for name in TABLES:
        con.execute(f"COPY ({SKEWED.get(name, f'SELECT * FROM {name}')}) TO '{folder}/{name}.parquet' (FORMAT parquet)")
    for key, value in LARGE_PLANS.items():
        spark.conf.set(key, value)
    yield Tables(spark, str(folder)), duckdb_connection(str(folder))
    for key in LARGE_PLANS:
        spark.conf.unset(key)


def test_a_third_of_the_rows_share_a_key(skewed):
    tables, _ = skewed
    for table, key, hot in (("lineitem", "l_orderkey", 7), ("orders", "o_custkey", 7), ("events", "user_id", 7)):
        rows = getattr(tables, table)
        assert rows.where(f"{key} = {hot}").count() >= rows.count() // 3


@pytest.mark.parametrize("name", GROUPED)
def test_skewed_tables(skewed, name):
    tables, con = skewed
    assert compare(QUERIES[name].run(tables), con, QUERIES[name].sql) is None
