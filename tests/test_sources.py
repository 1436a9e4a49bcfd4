"""Readers, schema inference of files, exports."""

import csv
import gzip
import io
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from dataquay.functions.convert import ERRORS, Attribute
from dataquay.operators.uploads import source_size
from dataquay.sources import readers as R
from dataquay.sources import writers as W

PEOPLE = "id,name,date,salary\n1,Bob,2018-01-01,12344.43\n2,Alice,2011-04-12,21312.99\n2,Sarah,2016-05-21,11312.00\n"
PEOPLE_ATTRIBUTES = (
    Attribute("id", "INTEGER"), Attribute("name", "CHARACTER"),
    Attribute("date", "DATETIME", format="yyyy-MM-dd"), Attribute("salary", "DECIMAL", 7, 2),
)


def write(tmp_path, text, name="data.csv", encoding="utf8"):
    path = tmp_path / name
    path.write_bytes(text.encode(encoding))
    return str(path)


def facts(df):
    return [(r["name"], r["type"], r["nullable"]) for r in df.orderBy("position").collect()]


def test_infer_golden_file(spark, tmp_path):
    spec = R.SourceSpec("CSV", write(tmp_path, PEOPLE), is_first_line_header=True)
    rows = R.infer_source(spark, spec).orderBy("position").collect()
    assert [(r["name"], r["type"]) for r in rows] == [
        ("id", "INTEGER"), ("name", "CHARACTER"), ("date", "DATETIME"), ("salary", "DECIMAL")
    ]
    assert (rows[1]["size"], rows[2]["format"], rows[3]["precision"], rows[3]["scale"]) == (5, "yyyy-MM-dd", 7, 2)


def test_infer_without_header_and_with_named_delimiter(spark, tmp_path):
    path = write(tmp_path, "1\tx\n\n2\ty\n")
    assert facts(R.infer_csv(spark, R.SourceSpec("CSV", path, attribute_delimiter="{tab}"))) == [
        ("attr0", "INTEGER", False), ("attr1", "CHARACTER", False)
    ]


def test_short_rows_say_nothing_about_their_missing_cells(spark, tmp_path):
    text = 'a,b,c\n1,2,3\n4\n5,6,\n"x,y",7\n'
    spec = R.SourceSpec("CSV", write(tmp_path, text), is_first_line_header=True)
    assert facts(R.infer_csv(spark, spec)) == [("a", "CHARACTER", False), ("b", "INTEGER", False), ("c", "INTEGER", True)]


def test_infer_header_names_may_repeat(spark, tmp_path):
    text = " Ação Total (R$) ,x,X\n1,2,3\n"
    spec = R.SourceSpec("CSV", write(tmp_path, text), is_first_line_header=True)
    assert [f[0] for f in facts(R.infer_csv(spark, spec))] == ["acao_total__r__", "x", "x_2"]
    read = replace(spec, attributes=tuple(Attribute(f[0], f[1]) for f in facts(R.infer_csv(spark, spec))))
    assert R.read_source(spark, read).select("x", "x_2").first() == (2, 3)


def test_infer_looks_at_all_lines_unless_asked_for_a_preview(spark, tmp_path):
    text = "n\n" + "1\n" * 1999 + "late\n"
    spec = R.SourceSpec("CSV", write(tmp_path, text), is_first_line_header=True)
    assert facts(R.infer_csv(spark, spec, lines=1000)) == [("n", "INTEGER", False)]
    assert facts(R.infer_source(spark, spec)) == [("n", "CHARACTER", False)]
    undeclared = R.read_source(spark, replace(spec, scheme="hdfs"))
    assert undeclared.where("n IS NOT NULL").count() == 2000


@pytest.mark.parametrize("long_file", ["a.csv", "b.csv"])
def test_infer_orders_a_folder_by_file_name(spark, tmp_path, long_file):
    (tmp_path / "in").mkdir()
    for name, cell in (("a.csv", "2018-01-01"), ("b.csv", "7")):
        write(tmp_path / "in", f"{cell}\n" * (500 if name == long_file else 2), name)
    assert facts(R.infer_csv(spark, R.SourceSpec("CSV", str(tmp_path / "in")))) == [("attr0", "INTEGER", False)]


def test_quotes_that_mean_something_in_patterns(spark, tmp_path):
    for quote in "^]\\-":
        spec = R.SourceSpec("CSV", write(tmp_path, f"a,b\n1,2\n{quote}x,y{quote},7\n3\n"), is_first_line_header=True, text_delimiter=quote)
        assert facts(R.infer_csv(spark, spec)) == [("a", "CHARACTER", False), ("b", "INTEGER", False)]


def test_infer_drops_nul_and_honours_missing_tokens(spark, tmp_path):
    text = "a,b\n1\0,NA\n2,3\n"
    spec = R.SourceSpec("CSV", write(tmp_path, text), is_first_line_header=True, treat_as_missing="NA, -")
    assert facts(R.infer_csv(spark, spec)) == [("a", "INTEGER", False), ("b", "INTEGER", True)]


def test_quoted_records_may_span_lines(spark, tmp_path):
    text = 'id,note\n1,"two\nlines, ""quoted"""\n2,plain\n'
    spec = R.SourceSpec("CSV", write(tmp_path, text), is_first_line_header=True, is_multiline=True)
    size = R.infer_csv(spark, spec).where("name = 'note'").first()["size"]
    assert size == len('two\nlines, "quoted"')
    read = replace(spec, attributes=(Attribute("id", "INTEGER"), Attribute("note", "TEXT")))
    assert [r["note"] for r in R.read_source(spark, read).orderBy("id").collect()] == ['two\nlines, "quoted"', "plain"]


def test_typed_read_of_encoded_gzip(spark, tmp_path):
    path = tmp_path / "people.csv.gz"
    path.write_bytes(gzip.compress(PEOPLE.replace("Bob", "Bãob").encode("latin1")))
    spec = R.SourceSpec("CSV", str(path), attributes=PEOPLE_ATTRIBUTES, is_first_line_header=True, encoding="latin1")
    rows = R.read_source(spark, spec).orderBy("date").collect()
    assert [(r["id"], r["name"], str(r["date"]), str(r["salary"]), r[ERRORS]) for r in rows] == [
        (2, "Alice", "2011-04-12 00:00:00", "21312.99", []),
        (2, "Sarah", "2016-05-21 00:00:00", "11312.00", []),
        (1, "Bãob", "2018-01-01 00:00:00", "12344.43", []),
    ]


def test_bad_cells_are_reported_and_missing_ones_are_not(spark, tmp_path):
    path = write(tmp_path, "1,a,2018-01-01,x\n,NA,nope,2.5\n5.0,c,,\n")
    spec = R.SourceSpec("CSV", path, attributes=PEOPLE_ATTRIBUTES, treat_as_missing="NA")
    rows = R.read_source(spark, spec).collect()
    assert [r[ERRORS] for r in rows] == [
        ["salary: <Invalid data>: `x`"], ["date: <Invalid data>: `nope`"], ["id: <Invalid data>: `5.0`"]
    ]
    assert rows[1]["name"] is None and rows[1]["id"] is None


def test_malformed_rows(spark, tmp_path):
    path = write(tmp_path, "1,a\n2\n3,c,extra\n")
    spec = R.SourceSpec("CSV", path, attributes=PEOPLE_ATTRIBUTES[:2])
    assert [r["id"] for r in R.read_csv(spark, spec, skip_malformed=True).collect()] == [1]
    kept = R.read_csv(spark, spec).collect()
    assert [(r["id"], r["name"]) for r in kept] == [(1, "a"), (2, None), (3, "c")]


def test_cluster_files_skip_malformed_rows_and_name_their_columns(spark, tmp_path):
    path = write(tmp_path, "id,When\n1,2020-01-02\n2\n3,31/01/2020\n")
    declared = R.SourceSpec("CSV", path, scheme="hdfs", attributes=PEOPLE_ATTRIBUTES[:2], is_first_line_header=True)
    assert [r["id"] for r in R.read_source(spark, declared).collect()] == [1, 3]
    rows = R.read_source(spark, R.SourceSpec("CSV", path, scheme="hdfs")).collect()
    # The last pattern seen is the column's; the other date is reported.
    assert [(r["id"], str(r["when"]), r[ERRORS]) for r in rows] == [
        (1, "None", ["when: <Invalid data>: `2020-01-02`"]), (3, "2020-01-31 00:00:00", [])
    ]


def test_header_only_and_empty_files(spark, tmp_path):
    header = R.SourceSpec("CSV", write(tmp_path, "a,b\n"), is_first_line_header=True)
    assert facts(R.infer_csv(spark, header)) == [("a", "CHARACTER", False), ("b", "CHARACTER", False)]
    empty = R.SourceSpec("CSV", write(tmp_path, "", "empty.csv"), attributes=PEOPLE_ATTRIBUTES)
    assert R.read_source(spark, empty).count() == 0
    assert R.infer_csv(spark, R.SourceSpec("CSV", empty.path)).count() == 0


def test_unschematised_and_json_rows(spark, tmp_path):
    lines = R.SourceSpec("CSV", write(tmp_path, ' a b ;c\nplain\n"a;b";c\n'))
    assert [r["row"] for r in R.read_source(spark, lines).collect()] == ["a b", "plain", "a;b"]
    headed = replace(lines, is_first_line_header=True)
    assert [r["row"] for r in R.read_source(spark, headed).collect()] == ["plain", "a;b"]
    path = write(tmp_path, '{"a": 1}\n{"b": [1, 2]}\nbroken\n', "rows.json")
    rows = R.read_source(spark, R.SourceSpec("JSON", path)).select(F.to_json("value").alias("j")).collect()
    assert [r["j"] for r in rows] == ['{"a":1}', '{"b":[1,2]}', None]
    declared = R.SourceSpec("JSON", write(tmp_path, '{"a": 1, "b": "é"}\n{"a": "x"}\nbroken\n{}\n', "l1.json", "latin1"),
                            attributes=(Attribute("a", "INTEGER"), Attribute("b", "CHARACTER")), encoding="latin1")
    assert [tuple(r) for r in R.read_source(spark, declared).collect()] == [
        (1, "é", []), (None, None, ["a: <Invalid data>: `x`"]), (None, None, ["<Invalid row>: `broken`"]), (None, None, [])
    ]
    text = R.SourceSpec("TEXT", write(tmp_path, "né\n", "t.txt", "latin1"), encoding="latin1")
    assert R.read_source(spark, text).first()["value"] == "né"
    with pytest.raises(R.UnsupportedSource):
        R.read_source(spark, replace(text, encoding="utf-16"))


def test_parquet_in_declared_columns(spark, tmp_path):
    path = str(tmp_path / "p")
    spark.sql("SELECT 3000000000 AS big, '12' AS text, array(1, 2) AS list").write.parquet(path)
    attributes = (Attribute("text", "INTEGER"), Attribute("big", "INTEGER"), Attribute("none", "DATE"))
    row = R.read_source(spark, R.SourceSpec("PARQUET", path, attributes=attributes)).first()
    assert tuple(row) == (12, None, None, ["big: <Invalid data>: `3000000000`"])
    types = [r["type"] for r in R.infer_source(spark, R.SourceSpec("PARQUET", path)).orderBy("position").collect()]
    assert types == ["LONG", "CHARACTER", "VECTOR"]


def test_types_without_a_logical_type_are_refused(spark, tmp_path):
    path = str(tmp_path / "m")
    spark.sql("SELECT map('a', 1) AS m").write.parquet(path)
    with pytest.raises(ValueError, match="Unsupported data type"):
        R.parquet_attributes(spark, path)


def test_dispatch(spark, tmp_path):
    with pytest.raises(R.UnsupportedSource):
        R.read_source(spark, R.SourceSpec("SHAPEFILE", "x"))
    with pytest.raises(R.UnsupportedSource):
        R.read_source(spark, R.SourceSpec("CSV", "x", scheme="ftp"))
    with pytest.raises(R.UnsupportedSource):
        R.infer_source(spark, R.SourceSpec("JSON", "x"))
    assert R.exists(spark, write(tmp_path, "x")) and not R.exists(spark, str(tmp_path / "gone"))


def test_commands(spark):
    with pytest.raises(ValueError):
        R.run_command(spark, " ")
    spec = R.SourceSpec("HIVE", scheme="hive2", command="SELECT 1 AS a, 'x' AS b, CAST(2.5 AS DECIMAL(5,2)) AS c")
    rows = R.infer_source(spark, spec).orderBy("position").collect()
    assert [(r["name"], r["type"], r["precision"], r["scale"]) for r in rows] == [
        ("a", "INTEGER", None, None), ("b", "CHARACTER", None, None), ("c", "DECIMAL", 5, 2)
    ]
    assert R.with_defaults({"a": None, "z": "9"}, {"a": "1", "b": "2"}) == {"a": "1", "b": "2"}


def test_jdbc_options_take_credentials_from_either_place():
    spec = R.SourceSpec("JDBC", "mysql://ann:s3@db/shop", scheme="mysql", command="SELECT 1")
    assert R.jdbc_options(spec) == {"url": "jdbc:mysql://db:3306/shop", "query": "SELECT 1", "user": "ann", "password": "s3"}
    spec = R.SourceSpec("JDBC", "mysql://db:3307/shop?user=bo&password=x", scheme="mysql", command="SELECT 1")
    assert R.jdbc_options(spec) == {"url": "jdbc:mysql://db:3307/shop", "query": "SELECT 1", "user": "bo", "password": "x"}
    split = {"partitionColumn": "id", "lowerBound": "0", "upperBound": "9", "numPartitions": "3"}
    spec = R.SourceSpec("JDBC", "mysql://db/shop", scheme="mysql", command="SELECT * FROM t", use_options=split)
    assert R.jdbc_options(spec) == {"url": "jdbc:mysql://db:3306/shop", "dbtable": "(SELECT * FROM t) AS source", **split}


def test_sample_has_a_maximum(spark, tmp_path):
    spec = R.SourceSpec("TEXT", write(tmp_path, "a\nb\nc\n"))
    assert R.sample_source(spark, spec, 2).count() == 2
    with pytest.raises(ValueError):
        R.sample_source(spark, spec, 1001)


def test_download_has_one_header(spark, tmp_path):
    rows = spark.range(100).repartition(4).select("id", F.lit('say "hi", you').alias("a, b"), F.lit("").alias("e"), F.lit(None).cast("int").alias("n"))
    W.export_csv_download(rows, str(tmp_path / "out"))
    files = sorted((tmp_path / "out").glob("part-*"))
    assert len(files) == 5
    whole = "".join(f.read_text() for f in files)
    assert whole.splitlines()[0] == 'id,"a, b",e,n' and len(whole.splitlines()) == 101
    read = list(csv.DictReader(io.StringIO(whole)))
    assert sorted(int(r["id"]) for r in read) == list(range(100))
    assert {(r["a, b"], r["e"], r["n"]) for r in read} == {('say "hi", you', "", "")}


def test_compaction(spark, tmp_path):
    source, small, split = (str(tmp_path / n) for n in ("in", "small", "split"))
    spark.range(10_000).repartition(6).write.parquet(source)
    assert W.compact_parquet(spark, source, small) == 1
    assert len(list((tmp_path / "small").glob("*.parquet"))) == 1
    assert W.compact_parquet(spark, source, split, file_bytes=20_000) > 1
    assert spark.read.parquet(split).distinct().count() == 10_000


def test_compaction_counts_files_of_any_name(spark, tmp_path):
    source, out = tmp_path / "in", str(tmp_path / "out")
    spark.range(10_000).repartition(3).write.parquet(str(source))
    for i, file in enumerate(sorted(source.glob("part-*.parquet"))):
        file.rename(source / f"{i:06}_0")
    assert W.compact_parquet(spark, str(source), out, file_bytes=20_000) > 1
    assert spark.read.parquet(out).distinct().count() == 10_000


def test_source_size(spark, tmp_path):
    (tmp_path / "sub").mkdir()
    write(tmp_path, "x" * 1048576)
    write(tmp_path / "sub", "y" * 524288)
    row = source_size(spark, str(tmp_path)).first()
    assert (row["files"], str(row["size_mb"])) == (2, "1.50")


def test_native_inference(spark, tmp_path):
    spec = R.SourceSpec("CSV", write(tmp_path, PEOPLE), is_first_line_header=True)
    assert [r["type"] for r in R.infer_csv_native(spark, spec).orderBy("position").collect()] == [
        "INTEGER", "CHARACTER", "DATE", "DOUBLE"
    ]
