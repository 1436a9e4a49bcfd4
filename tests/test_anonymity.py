"""Lattice search against a plain search of all nodes, and odd tables."""

import random
from collections import Counter, defaultdict
from itertools import product

import pytest
from pyspark.sql import functions as F

from dataquay.operators import anonymity as A

SCHEMA = "age int, city string, day timestamp_ntz, illness string, extra int"
LADDERS = [
    A.ladder("age", '{"levels": [{"band": 10}, {"band": 50}]}'),
    A.ladder("city", '{"categories": {"a": "x", "b": "x", "c": "y"}}'),
]


def table(seed: int, n: int):
    r = random.Random(seed)
    return [(r.choice([None, *range(20, 70)]), r.choice("abc"), None, r.choice("uvw"), i) for i in range(n)]


def level(value, step: int, kind: str):
    if value is None:
        return None
    if kind == "age":
        return [value, value // 10 * 10, value // 50 * 50, None][step]
    return [value, {"a": "x", "b": "x", "c": "y"}[value], None][step]


def plain_nodes(rows, model: A.Model):
    """Safe nodes without a safe node below them, best first."""
    safe = {}
    for node in product(range(4), range(3)):
        sizes, kinds = Counter(), defaultdict(set)
        for age, city, _, illness, _ in rows:
            key = (level(age, node[0], "age"), level(city, node[1], "city"))
            sizes[key] += 1
            kinds[key].add(illness)
        small = sum(n for key, n in sizes.items() if n < model.k or len(kinds[key]) < model.l)
        if small <= model.suppress * len(rows):
            big = [n for key, n in sizes.items() if n >= model.k and len(kinds[key]) >= model.l]
            safe[node] = ((node[0] / 3 + node[1] / 2) / 2, small, len(big), min(big, default=None), sum(n * n for n in big))
    least = [n for n in safe if not any(o != n and o[0] <= n[0] and o[1] <= n[1] for o in safe)]
    return [(n, *safe[n]) for n in sorted(least, key=lambda n: (round(safe[n][0], 12), safe[n][4], n))]


@pytest.mark.parametrize("seed, model", [(1, A.Model(3)), (2, A.Model(8, 1, 0.1)), (3, A.Model(4, 3)), (4, A.Model(2, 2, 0.3)), (5, A.Model(30))])
def test_search_finds_what_a_search_of_all_nodes_finds(spark, seed, model):
    rows = table(seed, 90)
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    expected = plain_nodes(rows, model)
    assert [(n.levels, pytest.approx(n.loss), *n[2:]) for n in A.safe_nodes(df, LADDERS, model, F.col("illness"))] == expected
    done = A.anonymised(df, LADDERS, model, F.col("illness"))
    assert done.columns == df.columns and done.dtypes[1:] == df.dtypes[1:]
    found = done.collect()
    assert len(found) == 90 - expected[0][2]
    groups = defaultdict(list)
    for r in found:
        groups[r.age, r.city].append(r.illness)
        source = rows[r.extra]
        assert (r.age, r.city) == (level(source[0], expected[0][0][0], "age"), level(source[1], expected[0][0][1], "city"))
    assert all(len(g) >= model.k and len(set(g)) >= model.l for g in groups.values())


def test_dates_climb_calendar_units(spark):
    rows = [(1, f"2020-0{m}-0{d} 00:00:00") for m in (1, 2) for d in (1, 2, 3)]
    df = spark.createDataFrame(rows, "one int, day string").withColumn("day", F.to_timestamp_ntz("day"))
    steps = [A.ladder("day", '{"levels": [{"unit": "day"}, {"unit": "month"}, {"unit": "year"}]}')]
    assert [n.levels for n in A.safe_nodes(df, steps, A.Model(3))] == [(2,)]
    assert {str(r.day) for r in A.anonymised(df, steps, A.Model(3)).collect()} == {"2020-01-01 00:00:00", "2020-02-01 00:00:00"}


def test_too_few_rows_leave_none(spark):
    df = spark.createDataFrame(table(1, 3), SCHEMA)
    assert A.safe_nodes(df, LADDERS, A.Model(4)) == []
    assert A.anonymised(df, LADDERS, A.Model(4)).count() == 0
    empty = df.where("false")
    assert A.anonymised(empty, LADDERS, A.Model(4)).count() == 0
    assert A.safe_nodes(empty, LADDERS, A.Model(4))[0].levels == (0, 0)


def test_missing_values_agree_with_each_other(spark):
    df = spark.createDataFrame([(None, "a", None, "u", i) for i in range(5)], SCHEMA)
    assert [n.levels for n in A.safe_nodes(df, LADDERS, A.Model(5))] == [(0, 0)]
    assert [n.levels for n in A.safe_nodes(df, LADDERS, A.Model(5, 2), F.col("illness"))] == []


def test_a_rule_that_splits_is_refused(spark):
    df = spark.createDataFrame(table(1, 60), SCHEMA)
    with pytest.raises(ValueError, match="Level 2 of age splits"):
        A.safe_nodes(df, [A.ladder("age", '{"levels": [{"band": 10}, {"band": 15}]}')], A.Model(2))
    with pytest.raises(ValueError, match="needs a quasi"):
        A.safe_nodes(df, [], A.Model(2))
    with pytest.raises(ValueError, match="nodes"):
        A.safe_nodes(df, [A.Ladder("age", ('{"band": 1}',) * 20)] * 4, A.Model(2))


def test_the_newest_setting_and_the_strictest_model_hold(spark):
    rows = [
        (1, "age", "QUASI_IDENTIFIER", '{"band": 7}', "K_ANONYMITY", '{"k": 99}'),
        (2, "age", "QUASI_IDENTIFIER", '{"band": 10}', "K_ANONYMITY", '{"k": 3, "suppress": 0.2}'),
        (3, "city", "QUASI_IDENTIFIER", None, "L_DIVERSITY", '{"l": 2}'),
        (4, "illness", "SENSITIVE", None, None, '{"k": 50}'),
        (5, "other", "QUASI_IDENTIFIER", None, "K_ANONYMITY", '{"k": 40}'),
    ]
    fields = "id int, attribute_name string, privacy_type string, hierarchy string, privacy_model_technique string, privacy_model_parameters string"
    settings = spark.createDataFrame(rows, fields)
    ladders, model, sensitive = A.stored_model(settings, ["age", "city", "illness"])
    assert [(s.attribute, s.height) for s in ladders] == [("age", 2), ("city", 1)]
    assert model == A.Model(3, 2, 0.0) and sensitive == "illness"
    done = A.apply_model(spark.createDataFrame(table(6, 80), SCHEMA), settings).groupBy("age", "city").agg(F.count("*").alias("k"), F.count_distinct("illness").alias("l"))
    assert done.where("k < 3 OR l < 2").isEmpty() and not done.isEmpty()
