"""The numbered queries against SQL and against plain versions of their contracts."""

from collections import Counter, defaultdict

import pytest
from compare import compare, duckdb_connection
from conftest import SF_DIR
from llm import brute

import corpus_pipeline
from dataquay.llm import machine, pieces

QUERIES = corpus_pipeline.QUERIES


@pytest.fixture(scope="module")
def con():
    return duckdb_connection(SF_DIR)


@pytest.fixture(scope="module")
def docs(spark):
    return [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").select("doc_id", "text", "source").collect()]


def rows_of(spark, name):
    return [r.asDict() for r in QUERIES[name].run(spark, SF_DIR).collect()]


def same(found, expected):
    assert sorted(found, key=str) == sorted(expected, key=str)


@pytest.mark.parametrize("name", sorted(n for n, q in QUERIES.items() if q.sql))
def test_query_agrees_with_sql(spark, con, name):
    assert compare(QUERIES[name].run(spark, SF_DIR), con, QUERIES[name].sql) is None


def test_secrets_match_the_plain_patterns(spark, docs):
    found = rows_of(spark, "op1_secret_ownership")
    same([(r["doc_id"], r["n_assign"], r["n_access"], r["n_hex"], r["base_sha256"]) for r in found],
         [(i, *brute.base_secrets(t)) for i, t, _ in docs])


def test_scores_of_held_out_documents(spark):
    found = {r["doc_id"]: r for r in rows_of(spark, "op2_factorisation_machine")}
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    assert all(r["held_out"] == (brute.crc(str(i)) % 4 == 2) for i, r in found.items())
    assert all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= machine.ACCEPT) for r in found.values())
    held = [(found[i]["predicted"], label) for i, label in labels.items() if found[i]["held_out"]]
    assert sum(a == b for a, b in held) >= 0.9 * len(held)


def test_shards(spark, docs):
    found = rows_of(spark, "op3_interleaved_shards")
    by = defaultdict(list)
    for r in found:
        by[r["shard"]].append(r["slot"])
    assert sorted(by) == list(range(24))
    assert max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(slots) == list(range(len(slots))) for slots in by.values())
    same([(r["doc_id"], r["size"], r["text_crc32"]) for r in found], [(i, len(t.encode()) + 8, brute.crc(t)) for i, t, _ in docs])
    source = {i: s for i, _, s in docs}
    rows = Counter(source.values())
    for (s, _), n in Counter((source[r["doc_id"]], r["shard"]) for r in found).items():
        assert abs(n - rows[s] / 24) < 2  # every shard matches the mixture


def test_repeats(spark, docs):
    found = rows_of(spark, "op5_recompressed_repeats")
    same([tuple(r[c] for c in ("doc_id", "n_words", "n_removed", "kept_sha256")) for r in found],
         brute.windows_removed([(i, t) for i, t, _ in docs]))


def test_conversations(spark):
    turns = [tuple(r) for r in spark.read.parquet(f"{SF_DIR}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    said = "</s>[INST] ok [/INST]"
    found = rows_of(spark, "op6_chat_parts")
    same([tuple(r[c] for c in ("conv_id", "n_turns", "turns_sha256", "loss_chars", "loss_sha256")) for r in found],
         brute.conversations([*turns, (-7, 0, "user", said), (-7, 1, "assistant", said)]))


def test_near_groups(spark, docs):
    found = rows_of(spark, "op7_setsketch_groups")
    same([tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in found],
         brute.near_components([(i, t) for i, t, _ in docs], 4))


def test_pieces_give_the_texts_back(spark, docs):
    encoded = QUERIES["op8_sampled_pieces"].run(spark, SF_DIR)
    assert encoded.where("NOT lossless").isEmpty()
    texts = {r.doc_id: r.text for r in pieces.decode(encoded).collect()}
    assert texts == {i: t for i, t, _ in docs}


def test_rule_counts(spark, docs):
    found = rows_of(spark, "op9_adaptive_rules")
    names = ("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")
    same([tuple(r[c] for c in names) for r in found], [(i, *brute.rule_counts(t)) for i, t, _ in docs])
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{SF_DIR}/labels.parquet").collect()}
    good = [r["kept"] for r in found if labels.get(r["doc_id"]) == 1 and not r["base_failed"]]
    assert sum(good) >= 0.97 * len(good)


def test_owners(spark, docs):
    found = rows_of(spark, "op10_trie_owners")
    same([tuple(r[c] for c in ("doc_id", "keep_id", "group_size", "kept", "text_sha256")) for r in found],
         brute.owners([(i, t) for i, t, _ in docs]))


def test_pipeline_against_plain_stages(spark, docs):
    """Rules and mixing as their queries say on what came before; exact and near dedup by the plain versions."""
    rows = spark.read.parquet(f"{SF_DIR}/documents.parquet")
    columns = rows.columns
    stages = dict(corpus_pipeline.STAGES)
    good = stages["quality rules"](spark, rows, SF_DIR)
    kept = {r["doc_id"] for r in rows_of(spark, "op9_adaptive_rules") if r["kept"]}
    assert good.columns == columns and {r.doc_id for r in good.collect()} == kept
    texts = [(i, t) for i, t, _ in docs if i in kept]
    distinct = stages["exact dedup"](spark, good, SF_DIR)
    staying = {i for i, _, _, stays, _ in brute.owners(texts) if stays}
    assert distinct.columns == columns and sorted(r.doc_id for r in distinct.collect()) == sorted(staying)
    texts = [(i, t) for i, t in texts if i in staying]
    apart = stages["near dedup"](spark, distinct, SF_DIR)
    staying = sorted(i for i, _, _, stays in brute.near_components(texts, 5) if stays)
    assert apart.columns == columns and sorted(r.doc_id for r in apart.collect()) == staying
    mixed = stages["mixing"](spark, apart, SF_DIR)
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.columns == columns and set(times) <= set(staying) and max(times.values()) <= 2
    encoded = stages["encoding"](spark, mixed, SF_DIR)
    assert Counter(r.doc_id for r in encoded.collect()) == times and encoded.where("NOT lossless").isEmpty()
