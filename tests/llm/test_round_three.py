"""Spelling variants, importance resampling and SimHash groups: queries against plain versions, and odd input."""

import random
import zlib

import numpy as np
import pytest
from conftest import SF_DIR
from llm import brute
from llm.test_edges import SCHEMA, empty, odd, odd_rows, pairs, same, words  # noqa: F401
from pyspark.sql import functions as F

import corpus_pipeline
from dataquay.llm import resampling, simhash, spelling

QUERIES = corpus_pipeline.QUERIES
SPELT = ("word", "form", "root", "n", "n_near", "form_n")
DRAWN = ("doc_id", "n_features", "weight", "score", "rank")


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text").collect()]


def told(df, columns):
    return [tuple(r[c] for c in columns) for r in df.collect()]


def test_spelling_query(spark, docs):
    found = told(QUERIES["op11_spelling_variants"].run(spark, SF_DIR), SPELT)
    same(found, brute.spelling_variants(brute.spelt_words(docs)))


def test_resampling_query(spark, docs):
    target = [r.text for r in spark.read.parquet(f"{SF_DIR}/benchmark.parquet").collect()]
    same(told(QUERIES["op12_importance_resampling"].run(spark, SF_DIR), DRAWN), brute.resampled(docs, target))


def test_simhash_query(spark, docs):
    found = told(QUERIES["op13_simhash_groups"].run(spark, SF_DIR), ("doc_id", "fingerprint", "component_id"))
    same(found, brute.hamming_components(docs))


# Spelling variants

def test_spelling_of_odd_rows(odd, empty):  # noqa: F811
    same(told(spelling.spelling_variants(odd), SPELT), brute.spelling_variants(brute.spelt_words(pairs(odd_rows()))))
    assert spelling.spelling_variants(empty).count() == 0


def test_a_typo_shortens_the_run(spark):
    texts = [(i, "Straße ÄRGER abcdefgh " * 6) for i in range(60)] + [(None, "abcdefgh " * 5), (7, None), (8, "")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    found = dict(told(spelling.word_counts(df, typo_in=7), ("word", "n")))
    assert found == brute.spelt_words(texts, one_in=7) and any(w.startswith("abc") and len(w) == 7 for w in found)
    assert set(dict(told(spelling.word_counts(df, typo_in=0, least_signs=5), ("word", "n")))) == {"straße", "abcdefgh", "Ärger"}


def vocabulary(seed: int, n: int, alphabet: str = "abcé", least: int = 1, most: int = 9) -> dict[str, int]:
    r = random.Random(seed)
    return {"".join(r.choices(alphabet, k=r.randint(least, most))): r.choice((1, 1, 2, 5, 10, 10, 60, 400)) for _ in range(n)}


@pytest.mark.parametrize("block", [spelling.BLOCK, 7])
def test_near_words_of_a_dense_vocabulary(spark, monkeypatch, block):
    """Short words of four letters: lists are full, and cut into blocks in the second run."""
    monkeypatch.setattr(spelling, "BLOCK", block)
    counts = vocabulary(1, 700)
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    same(told(spelling.variants(df), SPELT), brute.spelling_variants(counts))


def test_ties_and_chains(spark):
    counts = {"abcdef": 1, "abcdeg": 5, "abcdxf": 5, "abcdegh": 25, "abcdeghi": 125, "zzzzzz": 4, "日本語日本語": 1, "日本語日本": 5}
    found = {r[0]: r for r in told(spelling.variants(spark.createDataFrame([*counts.items(), (None, 3)], "word string, n long")), SPELT)}
    assert found["abcdef"] == ("abcdef", "abcdeg", "abcdeghi", 1, 2, 5)
    assert found["abcdxf"][1:] == (None, "abcdxf", 5, 1, None)
    assert found["zzzzzz"][1:] == (None, "zzzzzz", 4, 0, None)
    assert found["日本語日本語"][1] == "日本語日本" and len(found) == 8


def test_the_scan_skips_and_goes_on():
    r = random.Random(3)
    lines = sorted({"".join(r.choices("abc", k=r.choice((4, 5)))) for _ in range(200)})
    queries = sorted(x for x in lines if len(x) == 4)
    found = set(spelling.near_in_list(queries, lines))
    assert found == {(i, j) for i, q in enumerate(queries) for j, w in enumerate(lines) if q == w or brute.one_edit(q, w)}
    assert spelling.near_in_list([], lines) == [] == spelling.near_in_list(queries, [])


# Importance resampling

@pytest.mark.parametrize("most", [1, 2, 3])
def test_payloads_compose_to_the_crc_of_runs(most):
    texts = ["The cat, the CAT; naïve 日本 x", "", None, "one", "é" * 3000 + " a b", "a-b-a-b", "\x00\n"]
    for text, (n, found) in zip(texts, resampling.text_features(texts, 1 << 20, most)):
        split = resampling.delimited(text).split()
        runs = [" ".join(split[k:k + m]) for m in range(1, most + 1) for k in range(len(split) - m + 1)]
        assert n == len(split) and found.tolist() == [zlib.crc32(x.encode()) % (1 << 20) for x in runs]


def test_a_word_is_not_found_inside_another():
    d = resampling.Dictionary([" a ab aba b "])
    assert len(d.scan(" aba ab a ")) == 3
    assert resampling.zeros_behind(0).tolist() == [1 << k for k in range(32)]


@pytest.mark.parametrize("most, slice_", [(1, 50), (2, resampling.SLICE)])
def test_resampling_of_odd_rows(spark, monkeypatch, odd, empty, most, slice_):  # noqa: F811
    monkeypatch.setattr(resampling, "SLICE", slice_)
    target = [words(1, 60), None, ""]
    df = spark.createDataFrame([(i, t, 5) for i, t in enumerate(target)], "item_id long, text string, n_words int")
    options = {"buckets": 500, "most": most, "least_words": 3, "percent": 40}
    found = resampling.resample(odd, df, **options)
    expected = brute.resampled(pairs(odd_rows()), target, 500, most, 3, 40)
    same(told(found, DRAWN), expected)
    kept = resampling.drawn(odd, df, **options)
    assert kept.columns == odd.columns and {r.doc_id for r in kept.collect()} == {r[0] for r in expected if r[4]}
    assert resampling.resample(empty, df).count() == 0 and resampling.drawn(empty, df).count() == 0
    nothing = resampling.resample(odd, df.where("item_id < 0"))
    same(told(nothing, DRAWN), brute.resampled(pairs(odd_rows()), []))


def test_more_texts_like_the_target_are_drawn(spark):
    r = random.Random(5)
    like, other = "alpha beta gamma delta".split(), "one two three four five six".split()
    rows = [(i, " ".join(r.choices(like if i % 4 == 0 else other, k=30))) for i in range(400)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    target = spark.createDataFrame([(" ".join(like * 20),)], "text string")
    ranks = [x for x in resampling.resample(df, target).collect() if x.rank]
    assert sorted(x.rank for x in ranks) == list(range(1, 41))
    assert sum(x.doc_id % 4 == 0 for x in ranks) >= 30


# SimHash

def test_fingerprints_are_those_of_spark_hashes(spark):
    text = words(3, 50)
    split = text.split()
    grams = [" ".join(split[k:k + 4]) for k in range(47)]
    hashes = [r[0] for r in spark.createDataFrame([(g,) for g in grams], "g string").select(F.xxhash64("g")).collect()]
    expected = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > 47)
    assert simhash.fingerprint(text) == expected == brute.simhash(text)
    assert simhash.fingerprint(None) == simhash.fingerprint(" \n") == 0
    assert simhash.fingerprint("a b") == brute.simhash("a b")


def test_counting_in_parts(monkeypatch):
    text = words(6, 200)
    monkeypatch.setattr(simhash, "COUNTED", 13)
    assert simhash.fingerprint(text) == brute.simhash(text)


@pytest.mark.parametrize("distance", [0, 1, 2, 3, 4, 7])
def test_segments_leave_no_pair_out(distance):
    for count in range(1, 9):
        for interleaved in (False, True):
            cut = simhash.segments(count, distance, interleaved)
            assert sum(m for m, _ in cut) == (1 << 64) - 1
            assert sum(r + 1 for _, r in cut) == distance + 1 and min(r for _, r in cut) >= 0


def around(r: random.Random, centres: int, each: int, flips: int, within: int = 64) -> list[int]:
    out = set()
    for _ in range(centres):
        c = r.getrandbits(64)
        out |= {c ^ sum(1 << b for b in r.sample(range(within), r.randint(0, flips))) for _ in range(each)}
    return sorted(out)


def linked(prints, links):
    parent = {x: x for x in prints}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[root(a)] = root(b)
    groups = {}
    for x in prints:
        groups.setdefault(root(x), []).append(x)
    return sorted(map(sorted, groups.values()))


@pytest.mark.parametrize("count, many, block", [(2, 64, 1024), (3, 64, 1024), (4, 3, 8), (5, 1, 5), (3, 0, 4)])
def test_links_connect_what_is_near(spark, monkeypatch, count, many, block):
    """Whatever the segments, and whether buckets are joined, dealt anew or cut into blocks."""
    monkeypatch.setattr(simhash, "MANY", many)
    monkeypatch.setattr(simhash, "BLOCK", block)
    r = random.Random(count)
    prints = around(r, 30, 4, 6) + around(r, 3, 60, 9, 20) + [0, (1 << 64) - 1, 1 << 63, 7 << 61]
    prints = sorted(set(prints))
    df = spark.createDataFrame([(int(np.uint64(x).view(np.int64)),) for x in prints], "node long")
    found = [(a % (1 << 64), b % (1 << 64)) for a, b in simhash.links(df, 4, count).distinct().collect()]
    assert all((a ^ b).bit_count() <= 4 for a, b in found)
    every = [(a, b) for i, a in enumerate(prints) for b in prints[:i] if (a ^ b).bit_count() <= 4]
    assert linked(prints, found) == linked(prints, every)


def test_a_full_bucket_gives_few_links():
    r = random.Random(9)
    nodes = np.array(around(r, 1, 3000, 8, 12), np.uint64)
    a, b = simhash.forest(nodes, 4)
    assert len(a) < len(nodes) and (np.bitwise_count(a ^ b) <= 4).all()
    assert all(len(x) == 0 for x in simhash.forest(nodes[:0], 4)) and len(simhash.forest(nodes[:1], 4)[0]) == 0


def test_simhash_of_odd_rows(odd, empty):  # noqa: F811
    found = simhash.near_groups(odd)
    same(told(found, ("doc_id", "fingerprint", "component_id")), brute.hamming_components(pairs(odd_rows())))
    assert simhash.near_groups(empty).count() == 0
    expected = brute.hamming_components(pairs(odd_rows()))
    kept = simhash.deduplicate(odd)
    assert kept.columns == odd.columns
    assert sorted(str(r.doc_id) for r in kept.collect()) == sorted(str(i) for i, _, c in expected if i == c)


def test_null_ids_alone(spark):
    df = spark.createDataFrame([(None, "a b c d e"), (None, "a b c d e"), (None, None), (3, "")], "doc_id long, text string")
    found = told(simhash.near_groups(df), ("doc_id", "component_id"))
    same(found, [(None, None), (None, None), (None, 3), (3, 3)])
    assert simhash.deduplicate(df).count() == 3
