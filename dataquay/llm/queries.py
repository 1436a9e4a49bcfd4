"""The numbered queries over the test tables, and SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from dataquay.llm import (
    chat, machine, mixing, near, pieces, recompression, resampling, rules, secrets, sharding, simhash, spelling, sql, tries,
)
from dataquay.llm.common import documents


class Query(NamedTuple):
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None = None


def secret_ownership(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Owners are sources; a repository is the part of a source in one language."""
    repository = F.concat_ws("/", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    found = secrets.find_secrets(documents(spark, sf_dir), owner="source", repository=repository)
    of_kind = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        "doc_id", *[of_kind(kind.name).alias(f"n_{kind.name}") for kind in secrets.BASE],
        F.sha2(secrets.listed(F.col("base")), 256).alias("base_sha256"), secrets.listed(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda s: s["live"])).cast("long").alias("n_live"),
        F.size(F.filter("spans", lambda s: ~s["live"])).cast("long").alias("n_copied"),
    )


def shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(documents(spark, sf_dir), 24).select(
        "doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot",
        F.lit(None).cast("int").alias("grown_shard"),
    )


def mixture(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_plan(documents(spark, sf_dir)).select("doc_id", "size", "source_size", "target", "taken")


def chat_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    tricky = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    typed = turns.unionByName(tricky).withColumn("parts", chat.text_part(F.col("text")))
    return chat.conversation_digests(chat.format_conversations(typed))


def adaptive_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rules.judge(documents(spark, sf_dir)).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept",
    )


def trie_owners(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tries.membership(documents(spark, sf_dir))


def factorisation_machine(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = documents(spark, sf_dir).select("doc_id", "text")
    learned = machine.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return machine.score(docs, learned).select(
        "row.doc_id", machine.held_out(F.col("row.doc_id")).alias("held_out"), "score", "predicted",
    )


def recompressed_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recompression.without_repeats(documents(spark, sf_dir)).select("doc_id", "n_words", "n_removed", "kept_sha256")


def setsketch_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near.near_groups(documents(spark, sf_dir), words=4).select("doc_id", "n_shingles", "component_id", "kept")


def sampled_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(documents(spark, sf_dir))


def spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.spelling_variants(documents(spark, sf_dir))


def importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    ranked = resampling.resample(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return ranked.select("doc_id", "n_features", "weight", "score", "rank")


def simhash_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_groups(documents(spark, sf_dir)).select("doc_id", "fingerprint", "component_id")


QUERIES: dict[str, Query] = {
    "op1_secret_ownership": Query(secret_ownership, sql.SECRETS),
    "op2_factorisation_machine": Query(factorisation_machine),
    "op3_interleaved_shards": Query(shards, sql.SHARDS),
    "op4_source_mixture": Query(mixture, sql.MIXTURE),
    "op5_recompressed_repeats": Query(recompressed_repeats, sql.REPEATS),
    "op6_chat_parts": Query(chat_parts, sql.CHATS),
    "op7_setsketch_groups": Query(setsketch_groups, sql.NEAR),
    "op8_sampled_pieces": Query(sampled_pieces),
    "op9_adaptive_rules": Query(adaptive_rules, sql.RULES),
    "op10_trie_owners": Query(trie_owners, sql.OWNERS),
    "op11_spelling_variants": Query(spelling_variants, sql.SPELLING),
    "op12_importance_resampling": Query(importance_resampling, sql.RESAMPLING),
    "op13_simhash_groups": Query(simhash_groups),
}
