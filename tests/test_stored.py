"""Statistics kept per file, positions laid out once, and postings: right, and read sparingly."""

import datetime
import os
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dataquay.operators import increments as I
from dataquay.operators import pages, postings
from dataquay.operators.catalog import search_text
from dataquay.operators.profile import profile_columns
from dataquay.session import scratch_dir

MIXED = "a long, b double, c string, d date, e decimal(20,6), g boolean"


def mixed_rows(n, seed):
    draw = random.Random(seed)

    def some(value):
        return None if draw.random() < 0.1 else value

    return [
        (some(2**40 + draw.randrange(1000)), some(draw.choice([1e9 + draw.random(), -3.5])), some(draw.choice(["x", "é", "", "long " * 20])),
         some(datetime.date(2020, 1, 1) + datetime.timedelta(draw.randrange(900))), some(Decimal(draw.randrange(10**9)) / 10**6), some(draw.random() < 0.5))
        for _ in range(n)
    ]


def by_name(df):
    return {r["name"]: r for r in df.collect()}


def agrees(merged, whole):
    for name, expected in by_name(whole).items():
        row = merged[name]
        assert row["missing_total"] == expected["missing_total"], name
        assert (row["min_value"], row["max_value"]) == (expected["min_value"], expected["max_value"]), name
        assert row["distinct_values"] == pytest.approx(expected["distinct_values"], rel=0.06), name
        for field in ("mean_value", "std_deviation"):
            assert (row[field] is None) == (expected[field] is None), name
            if row[field] is not None:
                assert row[field] == pytest.approx(expected[field], rel=1e-6), name


def test_new_files_alone_are_read_and_dropped_ones_forgotten(spark):
    root = scratch_dir(spark, "test")
    source, store = f"{root}/in here", f"{root}/store"
    parts = [spark.createDataFrame(mixed_rows(n, seed), MIXED) for seed, n in enumerate((3000, 500, 1200))]
    for i, part in enumerate(parts[:2]):
        part.coalesce(2).write.parquet(f"{source}/day={i}")
    assert I.add_new_files(spark, store, source) == 4 and I.add_new_files(spark, store, source) == 0
    agrees(by_name(I.merged_profile(spark, store, source)), profile_columns(spark.read.parquet(source), exact=True))

    parts[2].coalesce(1).write.mode("overwrite").parquet(f"{source}/day=1")
    assert I.add_new_files(spark, store, source) == 1
    found = by_name(I.merged_profile(spark, store, source))
    assert found["a"]["rows"] == 4200 and found["day"]["max_value"] == "1"
    agrees(found, profile_columns(spark.read.parquet(source), exact=True))
    # Five files were read in all, each once.
    assert spark.read.parquet(f"{store}/pieces").where("name = 'a'").count() == 5


def test_merged_quantiles_have_ranks_near_the_asked(spark, tables):
    root = scratch_dir(spark, "test")
    tables.lineitem.repartition(7).write.parquet(f"{root}/in")
    points = (0.0, 0.1, 0.5, 0.9, 1.0)
    found = by_name(I.profile_files(spark, f"{root}/store", f"{root}/in", ("l_extendedprice", "l_shipdate"), points).coalesce(1))
    values = sorted(r[0] for r in tables.lineitem.select(F.col("l_extendedprice").cast("double")).collect())
    for p, q in zip(points, found["l_extendedprice"]["quantiles"]):
        below, up_to = sum(v < q for v in values), sum(v <= q for v in values)
        assert below / len(values) - 0.01 <= p <= up_to / len(values) + 0.01
    assert found["l_shipdate"]["quantiles"] is None


def test_extremes_of_a_profile(spark):
    root = scratch_dir(spark, "test")
    rows = [(float("nan"), None, 9), (float("inf"), None, 10), (1.5, None, None)]
    big = [2**62, 2**62 + 1, 2**62 - 1]
    for i, row in enumerate(rows):
        spark.createDataFrame([(*row, big[i])], "x double, `n.o` string, k int, big long").coalesce(1).write.parquet(f"{root}/in/f={i}")
    spark.createDataFrame([], "x double, `n.o` string, k int, big long").write.parquet(f"{root}/in/f=3")
    found = by_name(I.profile_files(spark, f"{root}/store", f"{root}/in"))
    assert (found["k"]["min_value"], found["k"]["max_value"], found["k"]["mean_value"]) == ("9", "10", 9.5)
    assert (found["big"]["min_value"], found["big"]["max_value"]) == (str(2**62 - 1), str(2**62 + 1))
    assert (found["x"]["min_value"], found["x"]["max_value"]) == ("1.5", "NaN")
    assert (found["n.o"]["missing_total"], found["n.o"]["distinct_values"], found["n.o"]["min_value"]) == (3, 0, None)
    assert found["k"]["std_deviation"] == pytest.approx(0.5**0.5) and found["n.o"]["quantiles"] is None


def test_a_broken_run_leaves_nothing_that_counts(spark):
    root = scratch_dir(spark, "test")
    spark.range(10).coalesce(1).write.parquet(f"{root}/in")
    stale = I.list_files(spark, f"{root}/in").withColumn("length", F.col("length") + 1)
    with pytest.raises(RuntimeError, match="changed"):
        I.add_new_files(spark, f"{root}/store", f"{root}/in", files=stale)
    assert I.merged_profile(spark, f"{root}/store", f"{root}/in").count() == 0
    assert by_name(I.profile_files(spark, f"{root}/store", f"{root}/in"))["id"]["rows"] == 10


def test_pages_of_an_index(spark):
    path = scratch_dir(spark, "test")
    df = spark.range(0, 5000, numPartitions=6).select((F.col("id") * 7919 % 13).alias("k"), "id")
    pages.index_positions(df, [F.col("k").desc(), "id"], path)
    wanted = [tuple(r) for r in df.orderBy(F.col("k").desc(), "id").collect()]
    assert pages.row_count(spark, path) == 5000
    for start, stop in ((0, 1), (0, 5000), (613, 1900), (4990, 6000), (5000, 5001), (7, 7)):
        found = pages.read_positions(spark, path, start, stop).orderBy("rank").collect()
        assert [r["rank"] for r in found] == list(range(start + 1, min(stop, 5000) + 1))
        assert [(r["k"], r["id"]) for r in found] == wanted[start:stop]
    found = pages.read_page(spark, path, 3, 20).orderBy("rank").collect()
    assert [(r["k"], r["id"]) for r in found] == wanted[40:60]


def test_a_page_reads_its_ranges_alone(spark):
    path = scratch_dir(spark, "test")
    pages.index_positions(spark.range(0, 100_000, numPartitions=8), ["id"], path)
    parts = [d for d in os.listdir(f"{path}/rows") if d.startswith("_part=")]
    page = pages.read_positions(spark, path, 60_000, 60_050)
    plan = page._jdf.queryExecution().explainString(page._sc._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))
    assert len(parts) > 2 and "PartitionFilters: [isnotnull(_part" in plan or "_part#" in plan.split("PartitionFilters")[1].split("\n")[0]
    assert "Sort" not in plan and "Exchange hashpartitioning" not in plan
    assert page.count() == 50


def test_index_of_nothing_and_of_clashing_names(spark):
    path = scratch_dir(spark, "test")
    pages.index_positions(spark.createDataFrame([], "id long"), ["id"], path)
    assert pages.row_count(spark, path) == 0 and pages.read_positions(spark, path, 0, 9).count() == 0
    with pytest.raises(ValueError, match="rank"):
        pages.index_positions(spark.range(1).withColumn("Rank", F.lit(1)), ["id"], path + "x")
    with pytest.raises(ValueError, match="begin at 1"):
        pages.read_page(spark, path, 0, 5)


TEXTS = [
    (1, "Grüße aus KÖLN", "a"), (2, "grüsse", None), (3, None, "xköLNx"), (4, "100% sure_thing", ""), (5, "", "ab"), (6, "ΟΔΟΣ οδος", "tail\\end"),
    (None, "köln ohne Schlüssel", None), (7, "İstanbul", "köl"), (8, "k" * 50_000 + "öln", "x"), (1, "other row of one key", "köln"), (9, "köl", "öln"),
]


@pytest.mark.parametrize("term", ["köln", "KÖLN", "ß", "%", "", "k_ln", "rüß%köln", "100\\%", "sure\\_t", "sure_t", "ΔΟΣ", "οδος", "istanbul", "zzz", "kkk", "tail\\\\e"])
def test_indexed_search_finds_what_a_search_of_all_texts_finds(spark, term):
    df = spark.createDataFrame(TEXTS, "id long, name string, `de.tail` string").withColumnRenamed("de.tail", "detail")
    path = scratch_dir(spark, "test")
    postings.index_texts(df, "id", ("name", "detail"), path)
    found = postings.search_indexed(df, term, "id", ("name", "detail"), path)
    assert sorted(map(str, found.collect())) == sorted(map(str, search_text(df, term, ("name", "detail")).collect()))


def test_runs_of_a_pattern():
    assert postings.literal_runs("%ab\\%c_d\\\\%%") == ["ab%c", "d\\"]
    assert postings.literal_runs("%%") == []


def test_postings_are_written_by_the_tasks_that_read_the_texts(spark, monkeypatch):
    """No text and no posting moves between tasks, and a task holds a stretch at a time."""
    monkeypatch.setattr(postings, "STRETCH", 100)
    path = scratch_dir(spark, "test")
    rows = [(i, f"Text {i * 7919} 𝔘ß {'x' * (i % 4)}") for i in range(300)] + [(0, "again"), (None, "no key"), (7, None), (8, "ab")]
    df = spark.createDataFrame(rows, "id long, name string")
    shares = spark.sparkContext.parallelize(range(5), 5).flatMap(lambda p: [tuple(r) for r in rows[p::5]]).toDF(df.schema)
    postings.index_texts(shares, "id", ("name",), path)
    written = spark.read.parquet(path).select("*", F.input_file_name().alias("file")).collect()
    wanted = sorted((postings.gram_number(g), 0, i) for i, t in rows if i is not None and t for g in {t.lower()[k:k + 3] for k in range(len(t) - 2)})
    assert sorted((r["gram"], r["place"], r["key"]) for r in written) == wanted
    files = {}
    for r in written:
        files.setdefault(r["file"], []).append(r)
    assert len(files) == 5
    for found in files.values():
        assert len({r["key"] % 5 for r in found if r["key"] > 8}) == 1
        falls = sum(a["gram"] > b["gram"] for a, b in zip(found, found[1:]))
        assert len(found) / 130 - 1 <= falls <= len(found) / 100
    assert sorted(r["id"] for r in postings.search_indexed(df, "𝔘ß x", "id", ("name",), path).collect()) == [i for i in range(300) if i % 4]
