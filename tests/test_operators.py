"""Catalog, nesting, positions, changes, privacy, uploads and streams on small data."""

import itertools
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquay.functions.convert import Attribute
from dataquay.operators import catalog as K
from dataquay.operators import mutate as M
from dataquay.operators import nested as N
from dataquay.operators import positions as P
from dataquay.operators import privacy as X
from dataquay.operators import profile as S
from dataquay.operators import relations as R
from dataquay.operators import uploads as U
from dataquay.operators import validate as V
from dataquay.sources.readers import SourceSpec
from dataquay.streaming.ingest import ingest_csv
from dataquay.streaming.uploads import UploadTracker


@pytest.fixture(scope="module")
def sources(spark):
    rows = [(1, 10, False, "a"), (2, 11, True, "b"), (3, 11, False, "c"), (4, 11, False, "d")]
    return spark.createDataFrame(rows, "id long, user_id long, is_public boolean, name string")


@pytest.fixture(scope="module")
def grants(spark):
    rows = [(3, 10, "READ"), (3, 10, "WRITE"), (4, 12, "MANAGE"), (None, 10, "READ")]
    return spark.createDataFrame(rows, "data_source_id long, user_id long, permission string")


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


# --- catalog ---------------------------------------------------------------

def test_visibility(sources, grants):
    assert ids(K.visible_sources(sources, grants, 10)) == [1, 2, 3]
    assert ids(K.visible_sources(sources, grants, 10, ["MANAGE"])) == [1, 2]
    assert ids(K.visible_sources(sources, grants, 10, consider_public=False)) == [1, 3]
    assert ids(K.visible_sources(sources, grants, 0)) == ids(K.visible_sources(sources, grants, 1)) == [1, 2, 3, 4]
    assert ids(K.shared_sources(sources, grants, 10)) == [3]
    models, shared = sources, grants.withColumnRenamed("data_source_id", "model_id")
    assert ids(K.visible_models(models, shared, 10)) == [1, 3]


def test_grant_test_is_an_existence_join(sources, grants):
    plan = K.visible_sources(sources, grants, 10)._jdf.queryExecution().optimizedPlan().toString()
    assert "ExistenceJoin" in plan


def test_filters(sources):
    assert ids(K.filter_in(sources, "name", "zz,a", ["a", "b"])) == [1]
    assert ids(K.filter_in(sources, "name", "zz", ["a", "b"])) == [1, 2, 3, 4]
    assert ids(K.filter_flags(sources, is_public="TRUE")) == [2]
    assert ids(K.filter_flags(sources, is_public="0")) == [1, 2, 3, 4]
    assert ids(K.filter_equal(sources, is_public=K.parse_flag("false"))) == [1, 3, 4]
    assert ids(K.search_text(sources, "_", ("name",))) == [1, 2, 3, 4]


def test_fields_must_exist(sources):
    with pytest.raises(Exception, match="nope"):
        K.project_fields(sources, "id, nope")


def test_pages(sources):
    order = K.sort_columns("name", ("name", "id"), ascending=False)
    assert [(r["rank"], r["id"]) for r in K.page(sources, order, 2, 3).collect()] == [(4, 1)]
    assert K.page(sources, order, 9, 3).count() == 0
    assert ids(K.page_or_first(sources, order, 9, 20)) == [1, 2, 3, 4]
    assert K.page_or_first(sources, order, 9, 3).count() == 0
    total = K.page_summary(sources, 3).first()
    assert (total["total"], total["pages"]) == (4, 2)
    with pytest.raises(ValueError):
        K.page(sources, order, 0)


def test_hidden_members(spark):
    df = spark.createDataFrame([(1, (5, "u")), (2, (6, "v"))], "user_id long, storage struct<id:int,url:string>")
    shown = K.hide_unless(df, ["storage.url"], K.owner_or_admin(F.col("user_id"), 1, False))
    assert [tuple(r["storage"]) for r in shown.orderBy("user_id").collect()] == [(5, "u"), (6, None)]
    everyone = K.hide_unless(df, ["storage.url"], K.owner_or_admin(F.col("user_id"), 1, True))
    assert [r["storage"]["url"] for r in everyone.orderBy("user_id").collect()] == ["u", "v"]


# --- positions -------------------------------------------------------------

def test_deep_rows_agree_with_a_sort(spark):
    rng = random.Random(1)
    rows = [(rng.choice([0, 0, 0, rng.randint(0, 50)]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "a int, id long").repartition(7)
    got = P.rows_between(df, [F.col("a"), F.col("id").desc()], 700, 1900).orderBy("rank").collect()
    expected = sorted(rows, key=lambda r: (r[0], -r[1]))[700:1900]
    assert [(r["a"], r["id"]) for r in got] == expected
    assert [r["rank"] for r in got] == list(range(701, 1901))
    assert P.rows_between(df, [F.col("id")], 5000, 6000).count() == 0


@pytest.mark.parametrize("ascending", [True, False])
@pytest.mark.parametrize("start, stop", [(0, 10), (990, 1010), (4990, 6000), (2500, 2600), (7000, 7100)])
def test_a_band_holds_all_wanted_rows(spark, ascending, start, stop):
    rng = random.Random(9)
    rows = [(rng.choice([0.5, 0.5, rng.random() * 100]), i) for i in range(5000)]
    df = spark.createDataFrame(rows, "a double, id long").repartition(3)
    lead = F.col("a").asc() if ascending else F.col("a").desc()
    got = P.rows_between(df, [lead, F.col("id")], start, stop, P.Lead("a", ascending)).orderBy("rank").collect()
    expected = sorted(rows, key=lambda r: (r[0] if ascending else -r[0], r[1]))[start:stop]
    assert [(r["a"], r["id"], r["rank"]) for r in got] == [(a, i, start + n + 1) for n, (a, i) in enumerate(expected)]


def test_a_band_is_narrow_and_nulls_forbid_one(spark):
    df = spark.range(100_000).withColumn("t", F.timestamp_seconds("id").cast("timestamp_ntz"))
    for column in ("id", "t"):
        band, before = P._band(df, P.Lead(column), 50_000, 50_100)
        assert band.count() < 500 and 49_000 < before <= 50_000
    gaps = df.withColumn("n", F.when(F.col("id") > 5, F.col("id")))
    assert P._band(gaps, P.Lead("n"), 10, 20)[0] is gaps
    text = df.select(F.col("id").cast("string").alias("s"))
    assert P._band(text, P.Lead("s"), 10, 20)[0] is text


def test_other_parts_of_the_sort_are_not_read_again(spark):
    got = P.rows_between(spark.range(1000).repartition(5), [F.col("id")], 10, 20)
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "(_part" in plan.split("PushedFilters: [")[1]


def test_deep_pages_use_the_distributed_way(spark, monkeypatch):
    monkeypatch.setattr(K, "SHALLOW_ROWS", 50)
    df = spark.range(1000).repartition(5)
    got = K.page(df, [F.col("id")], 10, 20).orderBy("rank").collect()
    assert [(r["rank"], r["id"]) for r in got] == [(i + 1, i) for i in range(180, 200)]


def test_quantiles_agree_with_numpy(spark):
    rng = np.random.default_rng(2)
    groups = {0: rng.normal(size=501), 1: np.repeat([1.0, 2.0], [400, 3]), 2: np.array([5.0]), 3: rng.integers(0, 9, 1000) * 1.0}
    rows = [(g, float(v)) for g, vs in groups.items() for v in vs]
    counts = spark.createDataFrame(rows, "g int, v double").groupBy("g", "v").agg(F.count("*").alias("n"))
    for row in P.quantiles(counts, "g", "v", "n", S.DECILES).collect():
        values = groups[row["g"]]
        assert row["quantiles"] == pytest.approx(np.quantile(values, S.DECILES).tolist())
        assert row["distinct_values"] == len(set(values.tolist()))


def test_ranges_longer_than_a_block(spark, monkeypatch):
    monkeypatch.setattr(P, "RANGE_BLOCK", 4)
    df = spark.createDataFrame([("a", 9), ("b", 1), ("c", 8), ("d", 0), ("e", None)], "k string, n int")
    got = sorted((r["k"], r["i"]) for r in P.explode_range(df, "i", F.col("n"), first=1).collect())
    assert got == [(k, i) for k, n in (("a", 9), ("b", 1), ("c", 8)) for i in range(1, n + 1)]


# --- nesting ---------------------------------------------------------------

def test_one_parent_with_a_third_of_all_children(spark):
    parents = spark.createDataFrame([(i,) for i in range(50)], "id long")
    owner = [7] * 1000 + [i % 49 for i in range(2000)]
    children = spark.createDataFrame([(o, n) for n, o in enumerate(owner)], "parent long, name int")
    tags = spark.createDataFrame([(7, f"t{i}") for i in range(5)], "parent long, tag string")
    documents = N.nest_children(
        parents, "id", {"items": N.Children(children, "parent", ("name",)), "tags": N.Children(tags, "parent", ("tag",))},
        part_rows=100,
    ).collect()
    seen = sorted(x["name"] for r in documents for x in r["items"])
    assert seen == list(range(3000))
    hot = [r for r in documents if r["id"] == 7]
    assert sorted(r["part"] for r in hot) == list(range(len(hot))) and len(hot) == 11
    assert max(len(r["items"]) for r in hot) < 160
    assert sorted(x["tag"] for r in hot for x in r["tags"]) == [f"t{i}" for i in range(5)]
    rest = [r for r in documents if r["id"] != 7]
    assert [r["part"] for r in rest] == [0] * 49
    assert next(r for r in rest if r["id"] == 49)["items"] == []


def test_many_large_families(spark, monkeypatch):
    monkeypatch.setattr(N, "KNOWN_LARGE", 3)
    parents = spark.range(10)
    children = spark.range(1000).select((F.col("id") % 10).alias("parent"), F.col("id").alias("name"))
    documents = N.nest_children(parents, "id", {"items": N.Children(children, "parent", ("name",))}, part_rows=20)
    assert sorted(x["name"] for r in documents.collect() for x in r["items"]) == list(range(1000))


def test_small_families_need_one_shuffle_of_the_children(tables):
    children = {"a": N.Children(tables.lineitem, "l_orderkey", ("l_partkey", "l_linenumber"))}
    # Broadcasts off: at scale neither side is small.
    tables.spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        documents = N.nest_children(tables.orders, "o_orderkey", children)
        plan = documents._jdf.queryExecution().executedPlan().toString()
    finally:
        tables.spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert plan.count("Exchange hashpartitioning(") == 2


# --- relations -------------------------------------------------------------

def test_orphans_skip_incomplete_keys(spark):
    child = spark.createDataFrame([(1, 1), (2, None), (3, 9), (3, 9)], "id int, p int")
    parent = spark.createDataFrame([(1,), (1,)], "p int").withColumnRenamed("p", "key")
    parts = [R.KeyPart(0, "p", "key")]
    assert ids(R.orphans(child, parent, parts)) == [3, 3]
    row = R.count_orphans("fk", child, parent, parts).first()
    assert (row["child_rows"], row["orphan_rows"]) == (4, 2)
    with pytest.raises(ValueError):
        R.decode(child, "p", child.withColumn("x", F.lit(1)), "y")


# --- changes ---------------------------------------------------------------

def test_upsert_keeps_the_id(spark):
    old = spark.createDataFrame([(1, "u1", "a", 5), (2, "u2", "b", 6)], "id long, url string, name string, size int")
    new = spark.createDataFrame([(9, "u1", "x", 1), (8, "u1", "y", 2), (7, "u3", None, 1)], "id long, url string, name string, v int")
    rows = sorted(tuple(r) for r in M.upsert(old, new, "url", ["v"]).collect())
    assert rows == [(1, "u1", "y", 5), (2, "u2", "b", 6), (7, "u3", None, None)]
    shared = spark.createDataFrame([(5, "u1", "b", 0), (3, "u1", "a", 0), (4, None, "c", 0)], old.schema)
    rows = sorted(tuple(r) for r in M.upsert(shared, new, "url", ["v"]).collect())
    assert rows == [(3, "u1", "y", 0), (4, None, "c", 0), (5, "u1", "b", 0), (7, "u3", None, None)]


def test_partial_update_tells_absent_from_null(spark):
    rows = spark.createDataFrame([(1, "a", 2, ["x"]), (2, "b", 3, None)], "id int, name string, n int, tags array<string>")
    patches = spark.createDataFrame([(1, {"name": None, "tags": '["y", "z"]', "other": "1"}), (5, {"n": "1"})], "id int, changes map<string,string>")
    assert sorted(tuple(r) for r in M.partial_update(rows, patches).collect()) == [(1, None, 2, ["y", "z"]), (2, "b", 3, None)]


def test_sharing_needs_manage(spark, sources, grants):
    kept = grants.where("data_source_id IS NOT NULL").dropDuplicates(["data_source_id", "user_id"])
    asked = spark.createDataFrame([(4, 77, "READ"), (4, 12, "READ"), (3, 77, "READ")], "data_source_id long, user_id long, permission string")
    after, actions = M.share(kept, asked, sources, 12)
    assert sorted(tuple(r) for r in actions.collect()) == [(4, 12, "READ", "Updated"), (4, 77, "READ", "Added")]
    assert after.count() == kept.count() + 1
    named = asked.withColumns({"user_name": F.lit("Bo"), "user_login": F.lit("bo")})
    after_named, _ = M.share(kept.withColumns({"user_name": F.lit("old"), "user_login": F.lit("o")}), named, sources, 12)
    held = {(r["data_source_id"], r["user_id"]): r["user_name"] for r in after_named.collect()}
    assert (held[4, 77], held[4, 12]) == ("Bo", "Bo") and list(held.values()).count("old") == kept.count() - 1
    revoked = asked.select("data_source_id", "user_id")
    # The update took user 12's own right to manage away; the owner still has it.
    assert M.revoke(after, revoked, sources, 12).count() == after.count()
    assert ids(M.revoke(after, revoked, sources, 11), "data_source_id") == [3]


def test_changes_need_owner_or_administrator(spark, sources, grants):
    live = sources.withColumn("enabled", F.lit(True))
    asked = spark.createDataFrame([(1,), (2,), (3,), (4,), (9,)], "id long")

    def outcomes(user, **more):
        after, rows = M.delete_sources(live, grants, asked, user, **more)
        return {r["id"]: r["outcome"] for r in rows.collect()}, ids(after.where("not enabled"))

    assert outcomes(10) == ({1: "OK", 2: "Not authorized", 3: "Not authorized", 4: "Not found", 9: "Not found"}, [1])
    assert outcomes(10, is_admin=True) == ({1: "OK", 2: "OK", 3: "OK", 4: "Not found", 9: "Not found"}, [1, 2, 3])
    patches = asked.withColumn("changes", F.create_map(F.lit("name"), F.lit("new")))
    after, _ = M.patch_sources(live, grants, patches, 11)
    assert ids(after.where("name = 'new'")) == [2, 3, 4]
    dated = live.withColumns({"updated": F.lit("old"), "is_lookup": F.lit(False)})
    attributes = spark.createDataFrame([(2, "a"), (2, "b"), (3, "a")], "data_source_id long, name string")
    patches = asked.withColumn("changes", F.create_map(F.lit("is_lookup"), F.lit("true")))
    after, rows = M.patch_sources(dated, grants, patches, 11, attributes=attributes, now=F.lit("now"))
    assert ids(after.where("is_lookup AND updated = 'now'")) == ids(after.where("updated = 'now'")) == [2]
    assert {r["id"]: r["outcome"] for r in rows.collect()}[3] == "Invalid lookup"


def test_statuses_are_checked(spark):
    df = spark.createDataFrame([(1, "INITIALIZED")], "id int, initialization string")
    assert M.set_initialization(df, 1, "INITIALIZING").first()["initialization"] == "INITIALIZING"
    with pytest.raises(ValueError):
        M.set_initialization(df, 1, "DONE")


def test_only_visible_sources_are_initialized(spark, sources, grants):
    rows = sources.withColumns({"initialization": F.lit("NO_INITIALIZED"), "enabled": F.lit(True)})
    seen = M.set_initialization(rows, 4, "INITIALIZED", grants, 10)
    assert ids(seen.where("initialization = 'INITIALIZED'")) == []
    assert ids(M.set_initialization(rows, 4, "INITIALIZED", grants, 11).where("initialization = 'INITIALIZED'")) == [4]


def test_new_sources_belong_to_the_caller_and_are_never_initialized(spark):
    columns = "id long, url string, format string, storage_id long, user_id long, user_login string, user_name string, initialization string, estimated_rows long, created string, updated string"
    none = spark.createDataFrame([], columns)
    new = spark.createDataFrame([(1, "u", "CSV", 1, "INITIALIZED", 5)], "id long, url string, format string, storage_id long, initialization string, estimated_rows long")
    storages = spark.createDataFrame([(1, "hdfs://s")], "id long, url string")
    row = M.create_sources(none, new, storages, 42, login="ann", name_="Ann", now=F.lit("now")).first()
    assert tuple(row) == (1, "u", "CSV", 1, 42, "ann", "Ann", "NO_INITIALIZED", 0, "now", "now")


def test_lookups_and_hierarchies_never_multiply_rows(spark):
    rows, codes = spark.createDataFrame([(1, "a"), (2, "z")], "id int, c string"), spark.createDataFrame([("a", "y"), ("a", "x")], "c string, d string")
    assert sorted(tuple(r) for r in R.decode(rows, "c", codes, "shown").collect()) == [(1, "a", "x"), (2, "z", None)]
    assert sorted(r["id"] for r in X.generalize_by(rows, "c", codes).collect()) == [1, 2]
    with pytest.raises(ValueError):
        X.hashed(F.col("c"), None)


def test_latest_rows_of_a_hot_key(spark):
    df = spark.range(10_000).select(F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id")).alias("k"), F.col("id").alias("v"))
    latest = M.latest_per_key(df, ["k"], ["v"])
    assert latest.where("k = 0").first()["v"] == 9999
    assert latest.count() == df.select("k").distinct().count()


def test_latest_rows_may_hold_maps(spark):
    df = spark.sql("SELECT * FROM VALUES (1, 1, map('a', 1)), (1, 2, map('b', 2)) AS t(k, v, m)")
    assert [tuple(r) for r in M.latest_per_key(df, ["k"], ["v"]).collect()] == [(1, 2, {"b": 2})]


# --- validation ------------------------------------------------------------

def test_checks(spark):
    df = spark.createDataFrame([("a", " ", "CSV"), (None, "u", "NOPE")], "name string, url string, format string")
    rows = V.check_rows(df, V.SOURCE_REQUIRED, V.SOURCE_ENUMS).withColumn("first", V.first_error()).collect()
    assert rows[0]["errors"] == ["Missing: storage_id", "Missing: url"]
    assert rows[1]["errors"] == ["Missing: storage_id", "Missing: name", "Invalid: format"]
    assert rows[0]["first"] == "Missing: storage_id"


# --- privacy ---------------------------------------------------------------

def test_policies(spark):
    df = spark.createDataFrame([(1, "Ab-12", 1234.5, "x")], "id int, name string, pay double, kind string")
    policies = [
        X.Policy("name", "MASK"), X.Policy("pay", "GENERALIZATION", hierarchy='{"band": 100}'),
        X.Policy("id", "NO_TECHNIQUE", "IDENTIFIER"), X.Policy("kind", "GENERALIZATION", hierarchy='{"categories": {"x": "letters"}}'),
    ]
    assert tuple(X.anonymize(df, policies).first()) == (None, "Xx-nn", 1200.0, "letters")
    with pytest.raises(ValueError):
        X.anonymize(df, [X.Policy("name", "SHRED")])
    with pytest.raises(ValueError):
        X.anonymize(df, [X.Policy("name", "GENERALIZATION", hierarchy="{}")])


def test_risk(spark):
    df = spark.createDataFrame([("a", 1), ("a", 1), ("a", 2), ("b", 1)], "q string, s int")
    risk = X.identification_risk(df, ["q"]).first()
    assert (risk["probability"], risk["value"]) == (1.0, 0.5)
    assert [tuple(r) for r in X.k_anonymity_violations(df, ["q"], 2).collect()] == [("b", 1)]
    assert sorted(tuple(r) for r in X.l_diversity(df, ["q"], F.col("s")).collect()) == [("a", 2, 3), ("b", 1, 1)]


# --- profiling -------------------------------------------------------------

def test_profile_of_mixed_types(spark):
    df = spark.sql("""SELECT * FROM VALUES (1, 9007199254740993, 'x', 1.50BD, true), (2, 9007199254740992, NULL, 2.50BD, true),
                      (2, NULL, 'x', NULL, false) AS t(i, big, s, d, b)""")
    rows = {r["name"]: r for r in S.profile_columns(df, exact=True).collect()}
    assert [rows[c]["distinct_values"] for c in ("i", "big", "s", "d", "b")] == [2, 2, 1, 2, 2]
    assert [rows[c]["missing_total"] for c in ("i", "big", "s", "d", "b")] == [0, 1, 1, 1, 0]
    assert (rows["i"]["median_value"], rows["d"]["median_value"], rows["s"]["median_value"]) == ("2.0", "2.0", None)
    assert (rows["s"]["mean_value"], rows["b"]["max_value"]) == (None, "true")
    text = S.deciles(df, ["i"], exact=True).select(S.deciles_json(F.col("deciles")).alias("j")).first()["j"]
    assert text.startswith("[1.2000,1.4000,")
    empty = S.profile_columns(df.where("i > 5"), exact=True).collect()
    assert [r["distinct_values"] for r in empty] == [0] * 5


# --- uploads and streams ---------------------------------------------------

PARTS = [("f", 1, 3), ("f", 2, 3), ("f", 2, 3), ("f", 3, 3), ("g", 1, 2), ("g", 1, 2), ("h", 2, 4)]


def test_uploads(spark):
    df = spark.createDataFrame(PARTS, "file string, part long, total long")
    status = {r["file"]: (r["parts_present"], r["parts_missing"], r["complete"]) for r in U.upload_completeness(df, "file", "part", "total").collect()}
    assert status == {"f": (3, 0, True), "g": (1, 1, False), "h": (1, 3, False)}
    missing = sorted(tuple(r) for r in U.missing_parts(df, "file", "part", "total").collect())
    assert missing == [("g", 2, 2), ("h", 1, 1), ("h", 3, 4)]
    assert [r["part"] for r in U.parts_in_order(df.where("file = 'f'"), "file", "part").collect()] == [1, 2, 3]


def test_part_numbers_outside_the_total_are_strays(spark, monkeypatch):
    monkeypatch.setattr(U, "PART_BLOCK", 3)
    rows = [("f", p, 5) for p in (1, 2, 3, 4, 9)] + [("g", p, 3) for p in (1, 2, 8, 9)] + [("h", p, 20) for p in (2, 7, 8, 15)] + [("i", 0, 2)]
    df = spark.createDataFrame(rows, "file string, part long, total long")
    status = {r["file"]: (r["parts_present"], r["parts_stray"], r["parts_missing"], r["complete"]) for r in U.upload_completeness(df, "file", "part", "total").collect()}
    assert status == {"f": (4, 1, 1, False), "g": (2, 2, 1, False), "h": (4, 0, 16, False), "i": (0, 1, 2, False)}
    missing = sorted(tuple(r) for r in U.missing_parts(df, "file", "part", "total").collect())
    assert missing == [("f", 5, 5), ("g", 3, 3), ("h", 1, 1), ("h", 3, 6), ("h", 9, 14), ("h", 16, 20), ("i", 1, 2)]


@pytest.mark.parametrize("time", [None, "at"])
def test_stream_over_several_runs(spark, tmp_path, time):
    """Parts in three batches, some sent again later: as many complete files as in batch."""
    schema = T.StructType.fromDDL("file string, part long, total long, at timestamp_ntz")
    folder, root = str(tmp_path / "in"), str(tmp_path / "out")
    tracker = UploadTracker(spark, root, schema["file"])
    done = []
    for chunk in (PARTS[:2], PARTS[2:5], [("f", 1, 3), *PARTS[5:], ("g", 2, 2)]):
        rows = spark.createDataFrame(chunk, "file string, part long, total long")
        rows.withColumn("at", F.lit("2020-01-01").cast("timestamp_ntz")).coalesce(1).write.mode("append").parquet(folder)
        stream = spark.readStream.schema(schema).parquet(folder)
        tracker.start(stream, "part", "total", time=time).awaitTermination()
        done.append(ids(tracker.complete_files(), "file"))
    assert done == [[], ["f"], ["f", "g"]]


def test_a_batch_may_run_again(spark, tmp_path):
    schema = T.StructType.fromDDL("file string")
    tracker = UploadTracker(spark, str(tmp_path), schema["file"])
    rows = "file string, part long, parts_expected long"
    first = spark.createDataFrame([("f", 1, 2)], rows)
    second = spark.createDataFrame([("f", 2, 2)], rows)
    for batch, number in itertools.chain([(first, 0), (second, 1)], [(second, 1), (first, 0), (second, 1)]):
        tracker._take(batch, number)
    assert [tuple(r) for r in tracker.complete_files().collect()] == [("f", 2, 2)]


def test_ingest_takes_new_files_only(spark, tmp_path):
    source, root = tmp_path / "in", str(tmp_path / "out")
    source.mkdir()
    spec = SourceSpec("CSV", str(source), attributes=(Attribute("id", "INTEGER"), Attribute("v", "DOUBLE")))
    (source / "a.csv").write_text("1,1.5\n2,x\n3\n")
    ingest_csv(spark, spec, root).awaitTermination()
    (source / "b.csv").write_text("4,2.5\n")
    ingest_csv(spark, spec, root).awaitTermination()
    assert ids(spark.read.parquet(f"{root}/rows")) == [1, 4]
    rejected = spark.read.parquet(f"{root}/rejected").orderBy("id").collect()
    assert [(r["id"], r["_errors"], r["_bad_record"]) for r in rejected] == [
        (2, ["v: <Invalid data>: `x`"], None), (3, [], "3")
    ]


def test_sharing_keeps_every_grant_and_sorts_none(spark):
    """Also grants that come twice, or that lack a person; the requests are held by hash."""
    shape = "data_source_id int, user_id int, permission string, user_name string"
    held = [(1, 5, "READ", "e"), (1, 5, "READ", "again"), (1, None, "READ", "n"), (2, 5, "READ", "e"), (None, 5, "READ", "x"), (1, 6, "READ", None)]
    asked = [(1, 5, "WRITE", None), (1, 5, "MANAGE", "late"), (1, 7, "READ", "g"), (1, None, "WRITE", "m"), (2, 5, "WRITE", "no"), (None, 5, "WRITE", "no")]
    sources = spark.createDataFrame([(1, 3, False), (2, 4, False)], "id int, user_id int, is_public boolean")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        requests = spark.createDataFrame(asked, shape).withColumn("note", F.lit("not kept"))
        after, actions = M.share(spark.createDataFrame(held, shape).withColumn("login", F.lit("l")), requests, sources, 3)
        plan = after._jdf.queryExecution().executedPlan().toString()
        found = sorted(map(str, map(tuple, after.collect())))
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert after.columns == ["data_source_id", "user_id", "permission", "user_name", "login"]
    wanted = [
        (1, 5, "WRITE", "e", "l"), (1, 5, "WRITE", "again", "l"), (1, None, "READ", "n", "l"), (2, 5, "READ", "e", "l"), (None, 5, "READ", "x", "l"),
        (1, 6, "READ", None, "l"), (1, 7, "READ", "g", None), (1, None, "WRITE", "m", None),
    ]
    assert found == sorted(map(str, wanted))
    assert sorted((r["user_id"] or 0, r["action"]) for r in actions.collect()) == [(0, "Added"), (5, "Updated"), (7, "Added")]
    # Above the requests there is one join, by hash.
    assert plan.count("FullOuter") == 1 and "ShuffledHashJoin [data_source_id" in plan.split("FullOuter")[0] and "LeftOuter" not in plan
