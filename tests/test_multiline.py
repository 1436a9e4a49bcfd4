"""CSV records over several lines, whatever the splits."""

import csv
import io
import random
from contextlib import contextmanager

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from dataquay.functions.convert import Attribute
from dataquay.sources import multiline, readers
from dataquay.sources.readers import SourceSpec

SIZE = "spark.sql.files.maxPartitionBytes"


@contextmanager
def split_size(spark, size: int):
    before = spark.conf.get(SIZE)
    spark.conf.set(SIZE, str(size))
    try:
        yield
    finally:
        spark.conf.set(SIZE, before)


def cells(seed: int, rows: int, most: int = 40) -> list[list[str]]:
    r = random.Random(seed)
    signs = ["a", "b", "é", '"', ",", "\n", "\r\n", '""', " ", '",', ',"', "x y"]
    return [[str(i), "".join(r.choices(signs, k=r.randint(0, most))), r.choice(["", "q", '"'])] for i in range(rows)]


def written(path, rows, header=("id", "text", "kind"), end="\n", sep=",", encoding="utf-8") -> str:
    out = io.StringIO(newline="")
    csv.writer(out, lineterminator=end, delimiter=sep).writerows([list(header), *rows] if header else rows)
    path.write_bytes(out.getvalue().encode(encoding))
    return str(path)


def spec(path, **options) -> SourceSpec:
    attributes = (Attribute("id", "LONG"), Attribute("text", "TEXT"), Attribute("kind", "TEXT"))
    return SourceSpec("CSV", path, **{"attributes": attributes, "is_first_line_header": True, "is_multiline": True, **options})


def read_all(spark, source, size):
    with split_size(spark, size):
        return sorted(map(tuple, readers.read_csv_text(spark, source, ["id", "text", "kind"]).select("id", "text", "kind").collect()), key=str)


def read_by_one_task(spark, source):
    """Spark's own reading of whole files."""
    fields = "id string, text string, kind string"
    return sorted(map(tuple, spark.read.schema(fields).options(**readers.csv_options(source)).csv(source.path).collect()), key=str)


def full(rows) -> list[tuple]:
    return sorted(tuple(c or "" for c in r) for r in rows)


@pytest.mark.parametrize("size, n, end", [(3, 6, "\n"), (11, 20, "\r\n"), (64, 60, "\n"), (500, 300, "\n"), (500, 300, "\r\n"), (1 << 20, 60, "\n")])
def test_records_are_the_same_whatever_the_splits(spark, tmp_path, size, n, end):
    rows = cells(size, n)
    source = spec(written(tmp_path / "a.csv", rows, end=end))
    found = read_all(spark, source, size)
    if end == "\n":  # in other files Spark's own reader turns line ends inside cells into line feeds
        assert found == read_by_one_task(spark, source)
    assert full(found) == full(rows)


def test_a_cell_over_very_many_splits(spark, tmp_path):
    long = "\n".join(f'line {i}, "said"' for i in range(60))
    rows = [["1", long, ""], ["2", "short", "q"], ["3", long + "\n", long]]
    source = spec(written(tmp_path / "a.csv", rows))
    with split_size(spark, 50):
        assert spark.read.text(source.path).rdd.getNumPartitions() > 8
    assert full(read_all(spark, source, 50)) == full(rows)


def test_no_task_reads_a_whole_file(spark, tmp_path):
    source = spec(written(tmp_path / "a.csv", cells(5, 4000)))
    with split_size(spark, 4000):
        rows = readers.read_csv_text(spark, source, ["id", "text", "kind"])
        by_task = rows.groupBy(F.spark_partition_id()).count().collect()
        assert sum(r["count"] for r in by_task) == 4000 and max(r["count"] for r in by_task) < 1000


def test_every_file_has_its_header_and_own_state(spark, tmp_path):
    folder = tmp_path / "many"
    folder.mkdir()
    expected = []
    for k in range(4):
        rows = cells(k, 12)
        written(folder / f"{k}.csv", rows, header=("id", "te\nxt", "kind"))
        expected += [tuple(r) for r in rows]
    (folder / "empty.csv").write_text("")
    (folder / "open.csv").write_text('id,text,kind\n7,"never\nends')  # no quotes left over for other files
    assert full(read_all(spark, spec(str(folder)), 40)) == full([*expected, ("7", "never\nends", "")])


def test_quotes_inside_plain_cells_are_plain(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text,kind\n1,5" disk,"a\nb"\n2,it"s,x\n\n3,"a""\n""b",y\n4,c\n')
    for size in (9, 1000):
        assert read_all(spark, spec(str(path)), size) == [("1", '5" disk', "a\nb"), ("2", 'it"s', "x"), ("3", 'a"\n"b', "y"), ("4", "c", None)]


def test_short_and_long_rows_are_reported_and_skipped(spark, tmp_path):
    path = tmp_path / "a.csv"
    path.write_text('id,text,kind\n1,"a\nb",x\n2,"c\nd"\n3,"e\nf",y,z\nx,"g\nh",w\n')
    source = spec(str(path))
    with split_size(spark, 10):
        kept = readers.read_csv(spark, source).orderBy("text").collect()
        assert [(r.id, r.text) for r in kept] == [(1, "a\nb"), (2, "c\nd"), (3, "e\nf"), (None, "g\nh")]
        assert [len(r._errors) for r in kept] == [0, 0, 0, 1]
        skipped = readers.read_csv(spark, source, skip_malformed=True)
        assert sorted(r.text for r in skipped.collect()) == ["a\nb", "g\nh"]


def test_other_delimiters_and_encodings(spark, tmp_path):
    rows = [["1", "é;\nß", "q"], ["2", "x'y", ""]]
    path = written(tmp_path / "a.csv", rows, sep=";", encoding="latin-1")
    source = spec(path, attribute_delimiter=";", encoding="latin1")
    assert full(read_all(spark, source, 5)) == full(rows)
    wide = spec(written(tmp_path / "b.csv", rows, encoding="utf-16"), encoding="utf-16")
    assert full(read_all(spark, wide, 5)) == full(rows)


def test_inference_sees_whole_records(spark, tmp_path):
    rows = [[str(i), f"a\n{i}", "1.5" if i % 2 else "2"] for i in range(50)]
    source = spec(written(tmp_path / "a.csv", rows), attributes=())
    with split_size(spark, 30):
        found = {r["name"]: (r["type"], r["size"]) for r in readers.infer_csv(spark, source).collect()}
    assert found == {"id": ("INTEGER", None), "text": ("CHARACTER", 4), "kind": ("DECIMAL", None)}


def test_beyond_the_broadcast_lines_are_dealt(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(multiline, "BROADCAST_SPLITS", 0)
    rows = cells(8, 40)
    assert full(read_all(spark, spec(written(tmp_path / "a.csv", rows)), 100)) == full(rows)


def test_a_change_of_splits_is_an_error(spark, tmp_path):
    source = spec(written(tmp_path / "a.csv", cells(3, 60)))
    with split_size(spark, 100):
        rows = readers.read_csv_text(spark, source, ["id", "text", "kind"])
    with split_size(spark, 33), pytest.raises(PySparkException, match="have changed"):
        rows.collect()


@pytest.mark.parametrize("line, if_closed, if_open", [
    ("a,b", False, True), ('a,"b', True, False), ('"a""', True, False), ('a"b,c', False, False), ('"a"x"y,z', False, False),
    ('","', False, True), ('""', False, True), ("", False, True), ('"', True, False), ('x,""', False, True),
])
def test_how_a_line_ends(line, if_closed, if_open):
    assert multiline.open_after(line, False, '"', ",") == if_closed
    assert multiline.open_after(line, True, '"', ",") == if_open


def test_uploads_are_read_by_vote(spark, tmp_path):
    path = tmp_path / "up.csv"
    path.write_text("id;name\n1;a,b\n2;c\n3;d\n")
    source = readers.uploaded_spec(spark, str(path))
    assert source.attribute_delimiter == ";" and [(a.name, a.type) for a in source.attributes] == [("id", "INTEGER"), ("name", "CHARACTER")]
    (tmp_path / "empty.csv").write_text("")
    assert readers.voted_delimiter(spark, SourceSpec("CSV", str(tmp_path / "empty.csv"))) == ","


def test_compaction_goes_by_size(spark, tmp_path):
    """One large file and many small ones give files of like sizes, and lose no row."""
    import os

    from dataquay.sources import writers

    folder, rows = tmp_path / "in", spark.range(60_000).select("id", F.sha2(F.col("id").cast("string"), 256).alias("text"))
    rows.where("id < 40000").coalesce(1).write.option("parquet.block.size", 200_000).parquet(str(folder))
    rows.where("id >= 40000").repartition(40).write.mode("append").parquet(str(folder))
    total = sum(f.stat().st_size for f in folder.glob("*.parquet"))
    n = writers.compact_parquet(spark, str(folder), str(tmp_path / "out"), total // 6)
    sizes = [os.path.getsize(f) for f in (tmp_path / "out").glob("*.parquet")]
    assert 6 <= len(sizes) <= n <= 12 and max(sizes) <= 2 * total // 6
    assert spark.read.parquet(str(tmp_path / "out")).exceptAll(rows).isEmpty()
    assert writers.compact_parquet(spark, str(folder), str(tmp_path / "one")) == 1
