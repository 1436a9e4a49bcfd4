"""Keys from a catalog and from the data, column sets that single rows out, and the impact of a risk."""

import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest
from pyspark.sql import functions as F

from dataquay.operators import keys as K
from dataquay.operators import uniqueness as U
from dataquay.operators.relations import KeyPart

KEYS = "id int, from_source_id int, to_source_id int"
PAIRS = "foreign_key_id int, `order` int, direction string, from_attribute_id int, to_attribute_id int"
ATTRIBUTES = "id int, data_source_id int, name string"


@pytest.fixture(scope="module")
def catalog(spark):
    attributes = [(1, 10, "a"), (2, 10, "b"), (3, 20, "x"), (4, 20, "y"), (5, 20, "up"), (6, 30, "id"), (7, 10, "z")]
    return (
        spark.createDataFrame([(1, 10, 20), (2, 20, 30), (3, 10, 99)], KEYS),
        spark.createDataFrame([(1, 2, "FROM", 2, 4), (1, 1, "TO", 3, 1), (2, 1, "FROM", 5, 6), (3, 1, "FROM", 7, 6)], PAIRS),
        spark.createDataFrame(attributes, ATTRIBUTES),
    )


def test_pairs_are_read_in_order_and_direction(catalog):
    found = K.declared_keys(*catalog, [10, 20, 30])
    assert found == [K.ForeignKey(1, 10, 20, (KeyPart(1, "a", "x"), KeyPart(2, "b", "y"))), K.ForeignKey(2, 20, 30, (KeyPart(1, "up", "id"),))]
    assert [k.id for k in K.declared_keys(*catalog, [20, 30])] == [2] and K.declared_keys(*catalog, [30]) == []


def test_pairs_of_other_sources_are_refused(spark, catalog):
    keys, _, attributes = catalog
    for pair in [(1, 1, "FROM", 3, 1), (1, 1, "FROM", 7, 6), (1, 1, "FROM", None, 3)]:
        with pytest.raises(ValueError, match="Foreign key 1"):
            K.declared_keys(keys, spark.createDataFrame([pair], PAIRS), attributes, [10, 20])
    with pytest.raises(ValueError, match="Foreign key 2"):
        K.declared_keys(keys, spark.createDataFrame([], PAIRS), attributes, [20, 30])


def test_keys_of_several_columns_are_followed(spark, catalog):
    tables = {
        10: spark.createDataFrame([(1, 1, "p"), (1, 2, "q"), (9, 9, "r"), (None, 1, "s")], "a int, b int, z string"),
        20: spark.createDataFrame([(1, 1, 7), (1, 2, 8)], "x int, y int, up int"),
        30: spark.createDataFrame([(7, "seven")], "id int, z string"),
    }
    keys = K.declared_keys(*catalog, [10, 20, 30])
    joined = K.join_declared(tables, keys, 10)
    assert joined.columns == ["a", "b", "z", "x", "y", "up", "id", "2_z"]
    assert sorted((r["z"], r["up"], r["2_z"]) for r in joined.collect()) == [("p", 7, "seven"), ("q", 8, None), ("r", None, None), ("s", None, None)]
    assert K.join_declared(tables, keys, 10, "inner").count() == 1 and K.join_declared(tables, keys, 30).columns == ["id", "z"]
    found = {r["fk"]: (r["child_rows"], r["orphan_rows"]) for r in K.count_declared_orphans(tables, keys).collect()}
    assert found == {"1": (4, 1), "2": (2, 1)}


def plain_inclusions(tables: dict[str, list[dict]]) -> set:
    columns = {(t, c): [r[c] for r in rows if r[c] is not None] for t, rows in tables.items() for c in (rows[0] if rows else {})}
    return {
        (*a, *b, len(set(x)), len(set(y))) for a, x in columns.items() for b, y in columns.items()
        if a != b and x and len(set(y)) == len(y) and {(type(v), v) for v in x} <= {(type(v), v) for v in y}
    }


@pytest.mark.parametrize("seed, width", [(1, 3), (2, 30)])
def test_inclusions_are_those_of_a_plain_search(spark, seed, width):
    """Also with more columns than one word of a set holds."""
    r = random.Random(seed)
    cell = lambda k, top: None if r.random() < 0.05 else (r.randint(1, top) if k % 3 else str(r.randint(1, top)))
    rows = {f"t{t}": [{"id": i, **{f"c{k}": cell(k, 2 + k) for k in range(width)}} for i in range(1, 25 * (t + 1))] for t in range(3)}
    schema = "id long, " + ", ".join(f"c{k} {'long' if k % 3 else 'string'}" for k in range(width))
    tables = {t: spark.createDataFrame([tuple(x.values()) for x in v], schema) for t, v in rows.items()}
    assert {tuple(x) for x in K.inclusions(tables).collect()} == plain_inclusions(rows)


def test_the_likest_name_is_the_key(spark):
    parent = spark.createDataFrame([(i, i, f"n{i}") for i in range(9)], "cust_id int, old_id int, name string")
    child = spark.createDataFrame([(i % 5, i % 3, 0.5, None) for i in range(20)], "custid int, size int, price double, name string")
    found = K.discover({"parent": parent, "child": child})
    assert [tuple(r)[:6] for r in found.collect()] == [("child", "custid", "parent", "cust_id", 5, 9)]
    key, = K.as_keys(found)
    assert K.join_declared({"parent": parent, "child": child}, [key], "child").where("cust_id = custid").count() == 20
    assert K.discover({"child": child}).count() == 0
    assert K.inclusions({"prices": child.select("price")}).count() == 0
    assert K.inclusions({"a": parent.where("false"), "b": child.where("false")}).count() == 0


def plain_unique(rows, names, most):
    found = []
    for size in range(1, most + 1):
        for s in combinations(range(len(names)), size):
            if not any(set(u) <= set(s) for u in found) and len({tuple(r[i] for i in s) for r in rows}) == len(rows):
                found.append(s)
    return [tuple(names[i] for i in s) for s in found]


@pytest.mark.parametrize("seed", range(4))
def test_unique_sets_are_those_of_a_plain_search(spark, seed):
    r = random.Random(seed)
    names = ["a", "b", "c", "d e", "f.g"]
    rows = list({tuple(r.choice([None, *range(top)]) for top in (2, 5, 9, 30, 300)) for _ in range(60)})
    df = spark.createDataFrame(rows, "a int, b int, c int, `d e` int, `f.g` int")
    assert U.minimal_unique_sets(df, names, 4) == plain_unique(rows, names, 4)
    assert U.unique_sets(df, names, 4).count() == len(plain_unique(rows, names, 4))


def test_one_pair_of_equal_rows_among_many(spark):
    df = spark.range(20_000).select(F.when(F.col("id") == 777, 776).otherwise(F.col("id")).alias("a"), (F.col("id") % 2).alias("b"))
    assert U.minimal_unique_sets(df, ["a", "b"]) == [("a", "b")]
    assert U.minimal_unique_sets(df.where("a < 0"), ["a"]) == [()] == U.minimal_unique_sets(df.limit(1), ["a"])


def test_impact_is_the_chance_of_a_right_guess(spark):
    rows = [("x", 1, "u")] * 3 + [("x", 1, "v")] + [("y", 2, "w")] * 2 + [("z", 3, None)]
    df = spark.createDataFrame(rows, "city string, age int, illness string")
    found = U.risk(df, ["city"], F.col("illness")).first()
    assert (found.probability, found.impact, found.value) == (1.0, pytest.approx(6 / 7), pytest.approx(3 / 7))
    by_set = {r.detail: r for r in U.risk_by_set(df, ["city", "age"], F.col("illness"), 2).collect()}
    assert set(by_set) == {'["city"]', '["age"]', '["city", "age"]'} and {r.singled_out for r in by_set.values()} == {1}
    sizes, most = Counter(r[0] for r in rows), defaultdict(Counter)
    for city, _, illness in rows:
        most[city][illness] += 1
    assert by_set['["city"]'].impact == pytest.approx(sum(max(c.values()) for c in most.values()) / sum(sizes.values()))
    assert U.risk(df.where("false"), ["city"], F.col("illness")).first().impact is None


@pytest.mark.parametrize("hashes", [1, 2, 3])
def test_equal_hashes_of_unequal_values_prove_nothing(spark, monkeypatch, hashes):
    monkeypatch.setattr(U, "_hash", lambda columns: F.pmod(F.xxhash64(*U._named(columns)), F.lit(hashes)))
    df = spark.range(30).select("id", (F.col("id") % 7).alias("d e"), F.when(F.col("id") > 3, F.col("id")).alias("f.g"))
    assert U.is_unique(df, ["id"]) and U.is_unique(df, ["d e", "id"]) and not U.is_unique(df, ["d e"]) and not U.is_unique(df, ["f.g"])


def test_different_hashes_settle_a_set(spark, monkeypatch):
    """No values are counted; missing values have their place."""
    monkeypatch.setattr(U, "_has_equal", lambda *_: pytest.fail("values were counted"))
    df = spark.createDataFrame([(i, None) for i in range(50)] + [(None, i) for i in range(50)] + [(i, i) for i in range(50)], "a int, b int")
    assert U.is_unique(df, ["a", "b"])


def test_text_that_is_equal_by_its_collation(spark):
    df = spark.createDataFrame([("a",), ("A",), ("b",)], "t string")
    assert U.is_unique(df, ["t"]) and not U.is_unique(df.select(F.col("t").try_cast("string collate UTF8_LCASE").alias("t")), ["t"])


def test_sketches_are_made_of_sets_that_are_not_refuted(spark, monkeypatch):
    made = []
    sketch = F.hll_sketch_agg
    monkeypatch.setattr(U.F, "hll_sketch_agg", lambda *a: made.append(a) or sketch(*a))
    df = spark.range(20_000).select("id", (F.col("id") % 9_000).alias("a"), (F.col("id") % 5_000).alias("b"))
    assert U.minimal_unique_sets(df, ["id", "a", "b"], 2) == [("id",), ("a", "b")]
    assert len(made) == 2
