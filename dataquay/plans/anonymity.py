"""Anonymisation and risk over the customers."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.operators import privacy as X
from dataquay.plans.registry import Tables, query

QUASI = ("c_nationkey", "c_mktsegment")
KEY = "pepper"
_MASK = "regexp_replace(regexp_replace(regexp_replace({c}, '[a-z]', 'x', 'g'), '[A-Z]', 'X', 'g'), '[0-9]', 'n', 'g')"


def _one(t: Tables, policy: X.Policy) -> DataFrame:
    return X.anonymize(t.customer.select("c_custkey", "c_name", "c_acctbal", "c_mktsegment"), [policy])


@query("anonymize_mask", f"SELECT c_custkey, {_MASK.format(c='c_name')} AS c_name, c_acctbal, c_mktsegment FROM customer")
def anonymize_mask(t: Tables) -> DataFrame:
    return _one(t, X.Policy("c_name", "MASK"))


@query("anonymize_suppress", "SELECT c_custkey, CAST(NULL AS VARCHAR) AS c_name, c_acctbal, c_mktsegment FROM customer")
def anonymize_suppress(t: Tables) -> DataFrame:
    return _one(t, X.Policy("c_name", "SUPPRESSION"))


@query("anonymize_generalize", "SELECT c_custkey, c_name, CAST(floor(c_acctbal / 1000) * 1000 AS BIGINT) AS c_acctbal, c_mktsegment FROM customer")
def anonymize_generalize(t: Tables) -> DataFrame:
    banded = _one(t, X.Policy("c_acctbal", "GENERALIZATION", hierarchy='{"band": 1000}'))
    return banded.withColumn("c_acctbal", F.col("c_acctbal").cast("long"))


@query("anonymize_hierarchy", """
SELECT c_custkey, CAST(r_name AS VARCHAR) AS c_nationkey FROM customer
LEFT JOIN nation ON n_nationkey = c_nationkey LEFT JOIN region ON r_regionkey = n_regionkey""")
def anonymize_hierarchy(t: Tables) -> DataFrame:
    """A nation is generalised to its region through a hierarchy relation."""
    hierarchy = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "r_name")
    return X.generalize_by(t.customer.select("c_custkey", "c_nationkey"), "c_nationkey", hierarchy)


@query("anonymize_hash", f"SELECT c_custkey, sha256('{KEY}' || c_name) AS c_name, c_acctbal, c_mktsegment FROM customer")
def anonymize_hash(t: Tables) -> DataFrame:
    return _one(t, X.Policy("c_name", "ENCRYPTION", key=KEY))


@query("anonymize_encrypt", "SELECT c_custkey, c_name, true AS hidden FROM customer")
def anonymize_encrypt(t: Tables) -> DataFrame:
    """Reversible encryption gives the value back to who has the key."""
    key = F.lit("0123456789abcdef")
    sealed = t.customer.select("c_custkey", F.col("c_name").alias("name"), X.encrypted(F.col("c_name"), key).alias("code"))
    return sealed.select(
        "c_custkey", X.decrypted(F.col("code"), key).alias("c_name"), (F.col("code") != F.col("name")).alias("hidden")
    )


# The newest policy of each column, read from a policy relation: the nations
# stand in for policies, older versions included.
@query("anonymize", f"""
SELECT {_MASK.format(c='c_mktsegment')} AS c_mktsegment, sha256('{KEY}' || CAST(c_custkey AS VARCHAR)) AS c_custkey,
       CAST(NULL AS VARCHAR) AS c_name, CAST(floor(c_acctbal / 500) * 500 AS BIGINT) AS c_acctbal, c_nationkey
FROM customer""")
def anonymize(t: Tables) -> DataFrame:
    place = F.col("n_nationkey")
    names = ("c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment")
    name = F.get(F.array(*[F.lit(n) for n in names]), place % len(names))
    old = place < len(names)
    technique = (
        F.when(old, "SUPPRESSION").when(name == "c_custkey", "ENCRYPTION").when(name == "c_acctbal", "GENERALIZATION")
        .when(name == "c_mktsegment", "MASK").otherwise("NO_TECHNIQUE")
    )
    privacy = F.when(name == "c_name", "IDENTIFIER").when(name == "c_acctbal", "SENSITIVE").otherwise("QUASI_IDENTIFIER")
    policies = t.nation.select(
        place.alias("id"), name.alias("attribute_name"), technique.alias("technique"), privacy.alias("privacy_type"),
        F.lit('{"band": 500}').alias("hierarchy"), F.lit(KEY).alias("key"),
    )
    done = X.anonymize(t.customer, policies)
    return done.withColumn("c_acctbal", F.col("c_acctbal").cast("long"))


@query("privacy_risk", """
SELECT 'IDENTIFICATION' AS type, round(1.0 / min(k), 6) AS probability, round(count(*) / sum(k), 6) AS value,
       '["c_nationkey", "c_mktsegment"]' AS detail
FROM (SELECT count(*) AS k FROM customer GROUP BY c_nationkey, c_mktsegment)""")
def privacy_risk(t: Tables) -> DataFrame:
    risk = X.identification_risk(t.customer, QUASI)
    return risk.select(
        "type", F.round("probability", 6).cast("double").alias("probability"), F.round("value", 6).alias("value"), "detail"
    )


@query("k_anonymity", """
SELECT c_nationkey, c_mktsegment, count(*) AS k FROM customer GROUP BY 1, 2 HAVING count(*) < 10""")
def k_anonymity(t: Tables) -> DataFrame:
    return X.k_anonymity_violations(t.customer, QUASI, 10)


@query("l_diversity", """
SELECT c_nationkey, c_mktsegment, count(DISTINCT floor(c_acctbal / 1000)) AS l, count(*) AS k FROM customer GROUP BY 1, 2""")
def l_diversity(t: Tables) -> DataFrame:
    return X.l_diversity(t.customer, QUASI, X.band(F.col("c_acctbal"), 1000))


@query("l_diversity_lines", """
SELECT l_returnflag, l_linestatus, count(DISTINCT l_partkey) AS l, count(*) AS k FROM lineitem GROUP BY 1, 2""")
def l_diversity_lines(t: Tables) -> DataFrame:
    """Very few, very large groups."""
    return X.l_diversity(t.lineitem, ("l_returnflag", "l_linestatus"), F.col("l_partkey"))
