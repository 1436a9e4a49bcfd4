"""Classification of cells, and the column fold."""

import datetime
import itertools
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from dataquay.functions import cells as C
from dataquay.functions.convert import Attribute, convert_columns
from dataquay.operators import infer as I

GOLDEN = [
    # value, class, date pattern, (precision, scale)
    ("", "MISSING", None, None), ("NA", "MISSING", None, None), (None, "MISSING", None, None),
    ("0", "INT32", None, None), ("007", "CHAR", None, None), ("00.5", "CHAR", None, None),
    ("0e5", "CHAR", None, None), (" 07", "INT32", None, None), ("0.5", "DECIMAL", None, (2, 1)),
    ("2147483646", "INT32", None, None), ("2147483647", "INT64", None, None),
    ("-2147483648", "INT64", None, None), ("-2147483647", "INT32", None, None),
    ("01/02/2018", "DATETIME", "MM/dd/yyyy", None), ("31/12/2018", "DATETIME", "dd/MM/yyyy", None),
    ("2018-01-02 03:04:05", "DATETIME", "yyyy-MM-dd HH:mm:ss", None),
    ("2019/02/30", "CHAR", None, None), ("2018.02.29", "CHAR", None, None),
    ("2020.02.29", "DATETIME", "yyyy.MM.dd", None), ("1900-02-29", "CHAR", None, None),
    ("2000-02-29", "DATETIME", "yyyy-MM-dd", None), ("29-02-2020", "DATETIME", "dd-MM-yyyy", None),
    ("02-29-2019", "CHAR", None, None), ("31.04.2020", "CHAR", None, None), ("0000-01-01", "CHAR", None, None),
    ("-1.5", "DECIMAL", None, (3, 1)), (".5", "DECIMAL", None, (1, 1)), ("1.25e1", "DECIMAL", None, (5, 4)),
    ("1e5", "INT32", None, None), ("1e-5", "TEXT", None, None), ("5.0", "INT32", None, None),
    ("5.", "INT32", None, None), ("1_000", "INT32", None, None), ("nan", "CHAR", None, None),
    ("inf", "CHAR", None, None), ("1e400", "CHAR", None, None), ("1__0", "CHAR", None, None),
    ("1d", "CHAR", None, None), ("+", "CHAR", None, None), ("0x1F", "CHAR", None, None),
    ("1/2/2018", "DATETIME", "MM/dd/yyyy", None), ("1/2/18", "CHAR", None, None),
    ("2018-01-02T03:04:05.1Z", "DATETIME", "yyyy-MM-ddTHH:mm:ss.Z", None),
    ("2018-01-02T03:04:05Z", "CHAR", None, None), ("2018-01-02 24:00:00", "CHAR", None, None),
    ("2018-01/02", "CHAR", None, None), ("Bob", "CHAR", None, None),
]


def classified(spark, values, missing=("NA",)):
    rows = spark.createDataFrame(list(enumerate(values)), "pos long, v string").withColumns({"column_index": F.lit(0), "split": F.struct(F.lit(0))})
    out = I.classify_cells(rows, missing).withColumn("format", C.date_pattern(F.col("format_index")))
    return sorted(out.collect(), key=lambda r: r["pos"])


def test_golden_cells(spark):
    for row, (value, cls, pattern, digits) in zip(classified(spark, [g[0] for g in GOLDEN]), GOLDEN):
        assert (row["v"], row["cell_class"], row["format"]) == (value, cls, pattern)
        assert ((row["precision"], row["scale"]) if digits else None) == digits


def test_numbers_are_what_python_reads(spark):
    alphabet = ["0", "1", "9", ".", "_", "e", "E", "+", "-", " ", "d", "f"]
    rng = random.Random(7)
    texts = ["".join(t) for n in (1, 2, 3) for t in itertools.product(alphabet, repeat=n)]
    texts += ["".join(rng.choices(alphabet, k=rng.randint(4, 9))) for _ in range(3000)]
    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    got = {r["v"]: r["n"] for r in rows.select("v", C.numeric_value(F.col("v")).alias("n")).collect()}
    for text in texts:
        try:
            expected = float(text)
        except ValueError:
            expected = None
        assert got[text] == expected, text


def test_dates_are_what_strptime_reads(spark):
    rng = random.Random(11)

    def date():
        parts = [rng.choice(["0", "1", "01", "2", "02", "4", "11", "12", "13", "28", "29", "30", "31", "32"]) for _ in range(2)]
        parts.insert(rng.choice([0, 2, 1]), rng.choice(["2019", "2020", "1900", "2000", "20", "0000"]))
        seps = rng.choice(["//", "--", "..", "/-"])
        time = rng.choice(["", "", " 1:2:3", "  23:59:59", " 24:00:00", " 1:60:0", "T01:02:03.5Z", "T01:02:03.1234567Z", "T1:2:3Z", " "])
        return parts[0] + seps[0] + parts[1] + seps[1] + parts[2] + time

    texts = sorted({date() for _ in range(6000)})
    orders = [("%m", "%d", "%Y"), ("%Y", "%m", "%d"), ("%d", "%m", "%Y")]
    times = {"": "", "T%H:%M:%S.%fZ": "THH:mm:ss.Z", " %H:%M:%S": " HH:mm:ss"}
    names = {"%m": "MM", "%d": "dd", "%Y": "yyyy"}

    def expected(text):
        for order, sep, time in itertools.product(orders, "/-.", times):
            try:
                datetime.datetime.strptime(text, sep.join(order) + time)
            except ValueError:
                continue
            return sep.join(names[f] for f in order) + times[time]
        return None

    rows = spark.createDataFrame([(t,) for t in texts], "v string")
    pattern = C.date_pattern(C.date_pattern_index(F.col("v")))
    for row in rows.select("v", pattern.alias("p")).collect():
        assert row["p"] == expected(row["v"]), row["v"]


# --- the fold against a walk over the cells --------------------------------

SAMPLES = {
    "CHAR": ["x", "abcd", "hello world"], "DATETIME": ["2018-01-01", "31/12/2018"],
    "DECIMAL": ["1.5", "-22.75"], "TEXT": ["1e-5"], "INT32": ["7", "123456"], "INT64": ["9999999999"], "MISSING": [""],
}


def walk(cells):
    """The column state after one cell at a time."""
    state, size = None, None
    for cls, text in cells:
        if cls == "MISSING":
            continue
        if state == "CHARACTER":
            size = max(size, len(text))
        elif cls == "CHAR":
            state, size = "CHARACTER", len(text)
        elif cls == "INT32":
            state = state if state in ("DECIMAL", "LONG") else "INTEGER"
        elif cls == "INT64":
            state = state if state == "DECIMAL" else "LONG"
        else:
            state = cls
    return state or "CHARACTER", size


def test_fold_agrees_with_a_walk(spark):
    rng = random.Random(3)
    classes = list(SAMPLES)
    columns = [[rng.choice(classes)] for _ in range(7)] + [
        rng.choices(classes, weights=rng.choices([0, 1, 3], k=len(classes)) if i % 2 else None, k=rng.randint(2, 9))
        if i % 2 == 0 else [rng.choice([c for c in classes if c != "CHAR"]) for _ in range(rng.randint(2, 9))]
        for i in range(400)
    ]
    cells = [[(cls, rng.choice(SAMPLES[cls])) for cls in column] for column in columns]
    rows = [(i, pos, text) for i, column in enumerate(cells) for pos, (_, text) in enumerate(column)]
    rng.shuffle(rows)
    # Positions need an order only; they may be negative and have gaps.
    rows = [(i, pos * 3 - 20, text) for i, pos, text in rows]
    df = spark.createDataFrame(rows, "column_index int, pos long, v string").repartition(5)
    df = df.withColumn("split", F.struct(F.lit(0)))
    got = {r["column_index"]: r for r in I.fold_cells(I.classify_cells(df)).collect()}
    for i, column in enumerate(cells):
        kind, size = walk(column)
        assert (got[i]["type"], got[i]["size"]) == (kind, size), column
        assert got[i]["nullable"] == any(cls == "MISSING" for cls, _ in column)


@pytest.mark.parametrize("values, kind, size", [
    (["1", "2018-01-01"], "DATETIME", None), (["2018-01-01", "1"], "INTEGER", None), (["1.5", "1"], "DECIMAL", None),
    (["9999999999", "1"], "LONG", None), (["1e-5", "7"], "INTEGER", None), (["x", "1"], "CHARACTER", 1),
    (["7", "abcd", "123456"], "CHARACTER", 6), (["1234567", "abcd"], "CHARACTER", 4), (["", ""], "CHARACTER", None),
    (["y" * 1001], "TEXT", 1001), (["y" * 1000], "CHARACTER", 1000),
])
def test_golden_columns(spark, values, kind, size):
    df = spark.createDataFrame(list(enumerate(values)), "pos long, c string")
    row = I.infer_columns(df, ["c"], "pos").first()
    assert (row["type"], row["size"]) == (kind, size)


def test_facts_belong_to_their_type(spark):
    """A pattern or digits seen before a later cell changed the type are not kept."""
    df = spark.createDataFrame([(0, "2018-01-01", "1.25"), (1, "5", "2018-01-01")], "pos long, a string, b string")
    a, b = I.infer_columns(df, ["a", "b"], "pos").orderBy("position").collect()
    assert (a["type"], a["format"]) == ("INTEGER", None)
    assert (b["type"], b["format"], b["precision"], b["scale"]) == ("DATETIME", "yyyy-MM-dd", None, None)


def test_decimals_have_room_for_every_number(spark):
    cells = ["123456.1", "1.12345", "98765432", "1e-7", "2.5e3", "-1_000.25"]
    df = spark.createDataFrame(list(enumerate(cells)), "pos long, c string")
    row = I.infer_columns(df, ["c"], "pos").first()
    assert (row["type"], row["precision"], row["scale"]) == ("DECIMAL", 15, 7)
    read = convert_columns(df.select("c"), [Attribute("c", "DECIMAL", row["precision"], row["scale"])]).collect()
    assert [r["c"] for r in read] == [Decimal(c.replace("_", "")) for c in cells] and not any(r["_errors"] for r in read)


def test_decimals_that_would_be_rounded_are_listed(spark):
    df = spark.createDataFrame([("1.12345",), ("1.12300",), ("123e-3",), ("1234e-4",)], "c string")
    read = convert_columns(df, [Attribute("c", "DECIMAL", 10, 3)]).collect()
    assert [r["_errors"] for r in read] == [["c: <Rounded>: `1.12345`"], [], [], ["c: <Rounded>: `1234e-4`"]]
    undeclared = convert_columns(df, [Attribute("c", "DECIMAL")]).collect()
    assert str(undeclared[0]["c"]).startswith("1.12345") and not any(r["_errors"] for r in undeclared)


def test_digits_beyond_a_decimal_are_characters(spark):
    df = spark.createDataFrame([(0, "123456789012345678.123456789012345678")], "pos long, c string")
    # So many digits are a whole number as a double; a short fraction is not.
    assert I.infer_columns(df, ["c"], "pos").first()["type"] == "LONG"
    df = spark.createDataFrame([(0, "1.5" + "0" * 30, "1.5" + "0" * 40)], "pos long, c string, d string")
    c, d = I.infer_columns(df, ["c", "d"], "pos").orderBy("position").collect()
    assert (c["type"], c["precision"], c["scale"]) == ("DECIMAL", 32, 31)
    assert (d["type"], d["size"], d["precision"]) == ("CHARACTER", 43, None)


def test_columns_without_rows_are_characters(spark):
    df = spark.createDataFrame([], "a string, b string")
    rows = I.infer_columns(df).orderBy("position").collect()
    assert [(r["name"], r["type"], r["nullable"]) for r in rows] == [("a", "CHARACTER", False), ("b", "CHARACTER", False)]


@pytest.mark.parametrize("text, delimiter", [
    ("a,b;c;d", ";"), ("a\tb\tc,d", "\t"), ("a,b;c", ","), ("nothing", ","), ("a;b\tc", ";"),
])
def test_delimiter_vote(spark, text, delimiter):
    df = spark.createDataFrame([(text,)], "t string")
    assert I.infer_delimiter(df, "t").first()["delimiter"] == delimiter
