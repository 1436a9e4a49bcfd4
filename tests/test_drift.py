"""Files of changing columns: read by name, what is new kept, differences listed, each file once."""

import pytest
from pyspark.sql import functions as F

from dataquay.functions.convert import Attribute
from dataquay.sources.readers import SourceSpec, UnsupportedSource
from dataquay.streaming.drift import ingest_files

ATTRIBUTES = (Attribute("id", "LONG"), Attribute("v", "DOUBLE"), Attribute("note", "CHARACTER"))


def ingest(spark, source, root, fmt):
    spec = SourceSpec(fmt, str(source), attributes=ATTRIBUTES, is_first_line_header=True)
    ingest_files(spark, spec, str(root)).awaitTermination()


def contents(spark, root):
    rows = spark.read.parquet(f"{root}/rows").orderBy("id").collect()
    rejected = spark.read.parquet(f"{root}/rejected").collect()
    files = spark.read.parquet(f"{root}/files").withColumn("file", F.substring_index("file", "/", -1)).orderBy("file").collect()
    return rows, rejected, files


def test_csv_files_of_other_columns(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.csv").write_text("id,v,note\n1,1.5,x\n2,,\"y,z\"\n")
    (source / "empty.csv").write_text("")
    ingest(spark, source, root, "CSV")
    (source / "b[1] c.csv").write_text("Note,ID,colour\nq,3,red\nr,4\n")
    (source / "c.csv").write_text("v,id,note\nhigh,5,x\n2.5,6,\n")
    (source / "d.csv").write_text("id,v,note\n")
    ingest(spark, source, root, "CSV")
    ingest(spark, source, root, "CSV")
    rows, rejected, files = contents(spark, root)
    assert [(r["id"], r["v"], r["note"], r["_extra"]) for r in rows] == [
        (1, 1.5, "x", {}), (2, None, "y,z", {}), (3, None, "q", {"colour": "red"}), (6, 2.5, None, {}),
    ]
    assert sorted((r["id"], r["_bad_record"], tuple(r["_errors"])) for r in rejected) == [(4, "r,4", ()), (5, None, ("v: <Invalid data>: `high`",))]
    assert [(f["rows"], f["rejected"], f["missing"], f["added"], f["misfits"]) for f in files] == [
        (2, 0, [], [], []), (2, 1, ["v"], ["colour"], []), (2, 1, [], [], ["v"]),
    ]


def test_json_rows_have_their_own_columns(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "out"
    source.mkdir()
    (source / "a.json").write_text('{"id": 1, "v": 2.5, "k": {"deep": [1]}}\n\n{"id": 2, "note": "n", "k": null}\n[1]\nnone\n')
    (source / "b.json").write_text('{"id": "x", "v": "3"}\n')
    ingest(spark, source, root, "JSON")
    rows, rejected, files = contents(spark, root)
    assert [(r["id"], r["v"], r["note"], r["_extra"]) for r in rows] == [
        (1, 2.5, None, {"k": '{"deep":[1]}'}), (2, None, "n", {"k": None}),
    ]
    assert sorted(str(r["_bad_record"]) for r in rejected) == ["None", "[1]", "none"]
    assert [(f["rows"], f["rejected"], f["missing"], f["added"], f["misfits"]) for f in files] == [
        (4, 2, [], ["k"], []), (1, 1, ["note"], [], ["id"]),
    ]


def test_parquet_files_of_other_types(spark, tmp_path):
    source, root = tmp_path / "in", tmp_path / "out"
    deliveries = [
        spark.createDataFrame([(1, 1.5, "a")], "id int, v float, note string"),
        spark.createDataFrame([("2", [1, 2]), ("two", None)], "id string, v2 array<int>"),
    ]
    for i, df in enumerate(deliveries):
        df.coalesce(1).write.parquet(f"{source}/{i}")
    ingest(spark, f"{source}/*", root, "PARQUET")
    rows, rejected, files = contents(spark, root)
    assert [(r["id"], r["v"], r["note"], r["_extra"]) for r in rows] == [(1, 1.5, "a", {}), (2, None, None, {"v2": "[1,2]"})]
    assert [r["_errors"] for r in rejected] == [["id: <Invalid data>: `two`"]]
    assert sorted((f["rows"], tuple(f["missing"]), tuple(f["added"]), tuple(f["misfits"])) for f in files) == [
        (1, (), (), ()), (2, ("note", "v"), ("v2",), ("id",)),
    ]


def test_sources_without_names_are_refused(spark, tmp_path):
    for spec in (
        SourceSpec("CSV", str(tmp_path), attributes=ATTRIBUTES),
        SourceSpec("TEXT", str(tmp_path), attributes=ATTRIBUTES),
        SourceSpec("JSON", str(tmp_path)),
    ):
        with pytest.raises(UnsupportedSource):
            ingest_files(spark, spec, str(tmp_path / "out"))
