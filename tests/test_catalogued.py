"""From catalog rows to lists, documents and data, end to end."""

import pytest
from pyspark.sql import functions as F

from dataquay.operators import listing as L
from dataquay.sources import catalogued as C
from dataquay.sources import readers as R

PEOPLE = "id;name;joined\n1;Bob;2018-01-31\n2;NA;2019-02-28\nx;Eve;\n"


@pytest.fixture(scope="module")
def catalog(spark, tmp_path_factory):
    folder = tmp_path_factory.mktemp("data")
    (folder / "people.csv").write_text(PEOPLE)
    url = f"file://{folder}/people.csv"
    sources = spark.createDataFrame(
        [
            (1, "people", "staff list", "hr", "CSV", url, 10, True, False, 1, ";", "NA", True, None),
            (2, "totals", None, "hr", "HIVE", "", 11, True, True, 2, None, None, False, "SELECT :a AS x, 2 AS y"),
            (3, "old", None, None, "CSV", "file:///gone", 11, False, False, 1, None, None, False, None),
        ],
        "id long, name string, description string, tags string, format string, url string, user_id long, enabled boolean, "
        "is_public boolean, storage_id long, attribute_delimiter string, treat_as_missing string, "
        "is_first_line_header boolean, command string",
    ).withColumns({"is_lookup": F.lit(False), "use_in_workflow": F.col("id") == 1})
    storages = spark.createDataFrame(
        [(1, "disk", "LOCAL", True, "file:///data", None), (2, "warehouse", "HIVE", True, "x", "hive2://h:1/db")],
        "id long, name string, type string, enabled boolean, url string, client_url string",
    )
    attributes = spark.createDataFrame(
        [("a", 2, 0, "x", "CHARACTER"), ("b", 2, 1, "y", "INTEGER"), ("c", 1, 0, "stale", "INTEGER")],
        "id string, data_source_id long, position int, name string, type string",
    ).withColumns({"precision": F.lit(None).cast("int"), "scale": F.lit(None).cast("int"), "format": F.lit(None).cast("string")})
    grants = spark.createDataFrame([(3, 10, "READ")], "data_source_id long, user_id long, permission string")
    variables = spark.createDataFrame([(2, "a", "7")], "data_source_id long, name string, default_value string")
    privacy = spark.createDataFrame([("a", "MASK"), ("c", "MASK")], "attribute_id string, technique string")
    return dict(sources=sources, storages=storages, attributes=attributes, grants=grants, variables=variables, privacy=privacy)


def listed(catalog, **asked):
    rows, summary = L.list_sources(catalog["sources"], catalog["grants"], catalog["attributes"], L.Request(**asked))
    return [r["id"] for r in rows.orderBy("rank").collect()], tuple(summary.first())


def test_lists(catalog, monkeypatch):
    assert listed(catalog, user=10) == ([3, 1, 2], (3, 1))
    assert listed(catalog, user=10, enabled="true", size=1, page=2) == ([2], (2, 2))
    assert listed(catalog, user=10, enabled="false") == ([3], (1, 1))
    assert listed(catalog, user=11, text="TOT") == ([2], (1, 1))
    assert listed(catalog, user=0, formats="CSV,NOPE", sort="id", ascending=False) == ([3, 1], (2, 1))
    assert listed(catalog, user=0, use_in_workflow="1", lookup="0") == ([1], (1, 1))
    assert listed(catalog, user=0, equal=(("user_id", 11), ("format", ""))) == ([3, 2], (2, 1))
    rows, _ = L.list_sources(catalog["sources"], catalog["grants"], catalog["attributes"], L.Request(10, text="totals"))
    assert [a["name"] for a in rows.first()["attributes"]] == ["x", "y"]
    monkeypatch.setattr(L, "FILTER_IDS", 1)
    assert listed(catalog, user=10) == ([3, 1, 2], (3, 1))


def test_presets(catalog):
    def columns(**asked):
        return L.list_sources(catalog["sources"], catalog["grants"], catalog["attributes"], L.Request(10, **asked))[0].columns

    assert columns(simple=True) == ["id", "name", "description", "tags", "format", "user_id", "rank"]
    assert columns(fields="id, tags") == ["id", "tags", "rank"]


def test_whole_lists(catalog):
    def listed_ids(**asked):
        request = L.Request(0, sort="id", **asked)
        rows = L.list_sources(catalog["sources"], catalog["grants"], catalog["attributes"], request)[0]
        return rows.columns, sorted(r["id"] for r in rows.collect())

    columns, ids = listed_ids(page=None)
    assert ids == [1, 2, 3] and "rank" not in columns and "attributes" in columns
    assert listed_ids(names_only=True) == (["id", "name", "tags"], [1, 2, 3])
    assert listed_ids(page=None, fields="id") == (["id"], [1, 2, 3])


def test_storages(catalog):
    rows, summary = L.list_storages(catalog["storages"], L.Request(5, text="hive"))
    assert rows.columns == ["id", "name", "type", "enabled", "client_url", "rank"] and rows.first()["name"] == "warehouse"
    assert "url" in L.list_storages(catalog["storages"], L.Request(1))[0].columns
    assert [r["id"] for r in L.list_storages(catalog["storages"], L.Request(1, ascending=False))[0].orderBy("rank").collect()] == [2, 1]


def test_models(spark, catalog):
    models = spark.createDataFrame(
        [(1, "tree", "KERAS", True, 10, 1), (2, "net", "MLEAP", True, 11, 2), (3, "off", "KERAS", False, 10, 1)],
        "id long, name string, type string, enabled boolean, user_id long, storage_id long",
    )
    grants = spark.createDataFrame([(2, 10, "READ"), (2, 10, "MANAGE")], "model_id long, user_id long, permission string")
    rows, summary = L.list_models(models, grants, catalog["storages"], L.Request(10, types="KERAS,MLEAP"))
    assert [(r["id"], r["storage"]["name"]) for r in rows.orderBy("rank").collect()] == [(2, "warehouse"), (1, "disk")]
    assert tuple(summary.first()) == (2, 1)
    assert L.list_models(models, grants, catalog["storages"], L.Request(10, text="NET", simple=True))[0].count() == 0


def test_document_hides_locations(catalog):
    def document(user, **more):
        return L.source_by_id(
            catalog["sources"], catalog["grants"], catalog["storages"],
            {"attributes": catalog["attributes"], "permissions": catalog["grants"]}, 3, user, **more,
        ).first()

    mine = document(11)
    assert (mine["url"], mine["storage"]["url"], mine["attributes"]) == ("file:///gone", "file:///data", [])
    assert [p["user_id"] for p in mine["permissions"]] == [10]
    shared = document(10)
    assert (shared["url"], shared["storage"]["url"], shared["storage"]["name"]) == (None, None, "disk")
    assert document(10, is_admin=True)["url"] == "file:///gone"
    assert document(12) is None


def test_infer_store_and_sample(spark, catalog):
    attributes, privacy = C.store_inferred(
        catalog["sources"], catalog["storages"], catalog["attributes"], catalog["privacy"], 1
    )
    assert [r["attribute_id"] for r in privacy.collect()] == ["a"]
    spec = C.source_spec(catalog["sources"], catalog["storages"], attributes, 1)
    assert [(a.name, a.type, a.format) for a in spec.attributes] == [
        ("id", "CHARACTER", None), ("name", "CHARACTER", None), ("joined", "DATETIME", "yyyy-MM-dd")
    ]
    rows = R.sample_source(spark, spec, 2).collect()
    assert [(r["id"], r["name"], str(r["joined"])) for r in rows] == [
        ("1", "Bob", "2018-01-31 00:00:00"), ("2", None, "2019-02-28 00:00:00")
    ]


def test_command_with_variables(spark, catalog):
    def read(**values):
        spec = C.source_spec(catalog["sources"], catalog["storages"], catalog["attributes"], 2, catalog["variables"], values)
        assert (spec.scheme, spec.path) == ("hive2", "hive2://h:1/db")
        return R.sample_source(spark, spec).first()

    assert tuple(read()) == ("7", 2) and tuple(read(a="9")) == ("9", 2)


def test_unknown_source(catalog):
    with pytest.raises(LookupError):
        C.source_spec(catalog["sources"], catalog["storages"], catalog["attributes"], 99)
