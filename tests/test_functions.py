"""Scalar functions."""

import random
import sys

import pytest
from pyspark.sql import functions as F

from dataquay import vocabulary as V
from dataquay.functions import documents as D
from dataquay.functions import locations as L
from dataquay.functions import text as X
from dataquay.functions import typemaps as M
from dataquay.functions.convert import Attribute, convert
from dataquay.operators.privacy import calendar_unit


def column(spark, values, fn):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r["x"] for r in rows.select("i", fn(F.col("v")).alias("x")).orderBy("i").collect()]


def test_accents_in_every_script(spark):
    """The table agrees with full decomposition wherever one character is left."""
    chars = [chr(c) for c in range(1, sys.maxunicode + 1) if not 0xD800 <= c <= 0xDFFF and chr(c).isalpha()]
    simple = [c for c in chars if len(X.plain_letters(c)) <= 1]
    blocks = ["x".join(simple[i:i + 500]) for i in range(0, len(simple), 500)]
    assert column(spark, blocks, X.strip_accents) == [X.plain_letters(b) for b in blocks]
    odd = ["한국어 ação", "éậ", None]
    assert column(spark, odd, X.strip_accents_full) == [X.plain_letters(odd[0]), "ea", None]
    assert column(spark, odd[1:], X.strip_accents) == ["ea", None]


def test_header_column_agrees_with_header_name(spark):
    rng = random.Random(5)
    pool = "aZ09 _-$()éÀçñüßø漢字\t.½²"
    texts = ["".join(rng.choices(pool, k=rng.randint(0, 130))) for _ in range(500)] + [" Ação Total (R$) ", " x "]
    assert column(spark, texts, X.normalise_header) == [X.header_name(t) for t in texts]


def test_default_names():
    assert X.default_names(3) == ["attr0", "attr1", "attr2"]


@pytest.mark.parametrize("path, clean", [
    ("hdfs://h:9000//a///b/", "hdfs://h:9000/a/b"), ("/a/b", "/a/b"), ("file:///tmp/x/", "file:///tmp/x"),
])
def test_clean_path(spark, path, clean):
    assert column(spark, [path], X.clean_path) == [clean]


def test_names_and_sizes(spark):
    assert column(spark, ["My Data Set"], lambda v: X.export_name(v, F.lit("PARQUET"), F.lit(True))) == ["My-Data-Set.parquet.csv"]
    assert column(spark, ["f.csv"], lambda v: X.part_name(v, F.lit(12))) == ["f.csv.part000000012"]
    assert [str(x) for x in column(spark, ["1572864", "1", "0"], lambda v: X.size_in_mb(v.cast("long")))] == ["1.50", "0.00", "0.00"]
    names = ["a.CSV", "b.tsv", "c.json", "d.xml", "e.txt", "f.parquet", "noext", "dir.csv/file"]
    assert column(spark, names, X.format_from_name) == [
        "CSV", "CSV", "JSON", "XML_FILE", "TEXT", "UNKNOWN", "UNKNOWN", "UNKNOWN"
    ]


def test_url_parts(spark):
    urls = ["mysql://ann:p:w@db.example/shop", "hive2://h/", "hdfs://nn:8020/a/b?x=1", "not a url", None]
    rows = spark.createDataFrame([(i, u) for i, u in enumerate(urls)], "i int, u string")
    parts = rows.select("i", *[c.alias(n) for n, c in L.url_parts(F.col("u")).items()]).orderBy("i").collect()
    assert parts[0][1:] == ("mysql", "db.example", 3306, "ann", "p:w", "shop", None)
    assert parts[1][1:] == ("hive2", "h", 10000, None, None, None, None)
    assert parts[2][1:] == ("hdfs", "nn", 8020, None, None, "a/b", "x=1")
    assert parts[3][1:] == (None,) * 7 and parts[4][1:] == (None,) * 7


def test_query_map_keeps_the_last_value(spark):
    found = column(spark, ["http://h/?a=1&b=&a=2&c", "http://h/", None], L.query_map)
    assert found == [{"b": "", "a": "2", "c": None}, None, None]


def test_first_filled(spark):
    assert column(spark, ["", "x", None], lambda v: L.first_filled(v, F.lit(""), F.lit("z"))) == ["z", "x", "z"]


def test_storage_params(spark):
    found = column(spark, ['{"user": "u", "resources": ["a"]}', "{}", "junk", None], D.storage_params)
    assert [(r["user"], r["use_hostname"], r["resources"]) for r in found] == [
        ("u", None, ["a"]), ("hadoop", None, None), ("hadoop", None, None), ("hadoop", None, None)
    ]


def test_iso_datetime(spark):
    found = column(spark, ["2020-01-02 03:04:05", "2020-01-02 03:04:05.5"], lambda v: X.iso_datetime(v.cast("timestamp_ntz")))
    assert found == ["2020-01-02T03:04:05", "2020-01-02T03:04:05.500000"]


def test_skipped_hours_are_read_and_written(spark):
    """A wall-clock time that the session's zone leaves out is a time like others."""
    spark.conf.set("spark.sql.session.timeZone", "America/Sao_Paulo")
    try:
        attribute = Attribute("c", "DATETIME", format="dd/MM/yyyy HH:mm:ss")
        read = column(spark, ["15/10/1995 00:30:00"], lambda v: convert(v, attribute).cast("string"))
        assert read == ["1995-10-15 00:30:00"]
        assert column(spark, ["1995-10-15 00:30:00"], lambda v: X.iso_datetime(v.cast("timestamp_ntz"))) == ["1995-10-15T00:30:00"]
        hour = column(spark, ["1995-10-15 00:30:00"], lambda v: calendar_unit(v.cast("timestamp_ntz"), "hour").cast("string"))
        assert hour == ["1995-10-15 00:00:00"]
    finally:
        spark.conf.set("spark.sql.session.timeZone", "UTC")


@pytest.mark.parametrize("unit, start", [
    ("year", "2020-01-01 00:00:00"), ("quarter", "2020-04-01 00:00:00"), ("month", "2020-05-01 00:00:00"),
    ("week", "2020-05-04 00:00:00"), ("day", "2020-05-06 00:00:00"), ("hour", "2020-05-06 07:00:00"),
    ("minute", "2020-05-06 07:08:00"), ("second", "2020-05-06 07:08:09"),
])
def test_calendar_units(spark, unit, start):
    found = column(spark, ["2020-05-06 07:08:09.5"], lambda v: calendar_unit(v.cast("timestamp_ntz"), unit).cast("string"))
    assert found == [start]


@pytest.mark.parametrize("text, attribute, value", [
    ("31/2/2020", Attribute("c", "DATE", format="dd/MM/yyyy"), None),
    ("3.4.2020", Attribute("c", "DATE", format="dd.MM.yyyy"), "2020-04-03"),
    ("3x4x2020", Attribute("c", "DATE", format="dd.MM.yyyy"), None),
    ("2020-01-02 25:00:00", Attribute("c", "DATETIME", format="yyyy-MM-dd HH:mm:ss"), None),
    (" 12 ", Attribute("c", "INTEGER"), "12"), ("1.5", Attribute("c", "INTEGER"), None),
    ("1.239", Attribute("c", "DECIMAL", 5, 2), "1.24"), ("3", Attribute("c", "DECIMAL"), "3." + "0" * 18),
    ("3/4/2020 1:2:3", Attribute("c", "DATETIME", format="dd/MM/yyyy HH:mm:ss"), "2020-04-03 01:02:03"),
    ("2020-01-02T03:04:05.25Z", Attribute("c", "TIMESTAMP", format="yyyy-MM-ddTHH:mm:ss.Z"), "2020-01-02 03:04:05.25"),
    ("[\"a\", \"b\"]", Attribute("c", "VECTOR"), "[a, b]"), ("{\"lat\": 1, \"lon\": 2}", Attribute("c", "LAT_LONG"), "{1.0, 2.0}"),
    ("23:59", Attribute("c", "TIME"), "23:59"), ("x", Attribute("c", "DOUBLE"), None),
])
def test_convert(spark, text, attribute, value):
    assert column(spark, [text], lambda v: convert(v, attribute).cast("string")) == [value]


def test_type_names(spark):
    assert column(spark, ["YEAR", "LONG", "LONGLONG", "BLOB"], M.mysql_type) == ["INTEGER", "LONG", "LONG", "CHARACTER"]
    assert column(spark, ["int", "BIGINT_TYPE", "STRING_TYPE", "timestamp"], M.hive_type) == [
        "INTEGER", "LONG", "CHARACTER", "TIMESTAMP"
    ]


def test_every_logical_type_has_a_spark_type():
    assert V.spark_type("DECIMAL").simpleString() == "decimal(38,18)"
    assert V.spark_type("TIME").simpleString() == "string"
    for name in V.LOGICAL_TYPES:
        V.spark_type(name)
    with pytest.raises(ValueError):
        V.spark_type("COLOUR")
