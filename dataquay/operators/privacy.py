"""Anonymisation by policy, and measures of re-identification risk.

A catalog only names the techniques and privacy models; what they do is
defined here:

* MASK: letters and digits become X, x and n.
* SUPPRESSION: the value becomes NULL.
* GENERALIZATION: a value becomes its band, calendar unit or category, by the
  policy's ``hierarchy`` text: ``{"band": 1000}``, ``{"unit": "month"}`` or
  ``{"categories": {"value": "category"}}``.
* ENCRYPTION: SHA-256 of the policy's key and the value; the same value always
  gives the same code, so joins survive.
* NO_TECHNIQUE: unchanged, except that an IDENTIFIER without technique is
  suppressed.
"""

from __future__ import annotations

import json
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquay.vocabulary import TECHNIQUES


class Policy(NamedTuple):
    """How to treat one attribute."""

    attribute_name: str
    technique: str
    privacy_type: str = "NON_SENSITIVE"
    hierarchy: str | None = None
    key: str | None = None


def mask(c: Column) -> Column:
    return F.mask(c.cast("string"))


def suppress(c: Column, dtype: T.DataType) -> Column:
    # The test on c keeps the column nullable in the result's schema.
    return F.when(F.lit(False), c).cast(dtype)


def band(c: Column, width: float) -> Column:
    """Lower bound of the band of the given width a number falls in."""
    return F.floor(c / F.lit(width)) * F.lit(width)


def calendar_unit(c: Column, unit: str) -> Column:
    """Start of the calendar unit a wall-clock time is in, without any time zone."""
    day = c.cast("date")
    if unit in ("year", "quarter", "month", "week"):
        return F.trunc(day, unit).cast("timestamp_ntz")
    zero = F.lit(0)
    clock = {
        "day": (zero, zero, zero),
        "hour": (F.hour(c), zero, zero),
        "minute": (F.hour(c), F.minute(c), zero),
        "second": (F.hour(c), F.minute(c), F.second(c)),
    }
    return day.cast("timestamp_ntz") + F.make_dt_interval(zero, *clock[unit])


def category(c: Column, categories: dict[str, str]) -> Column:
    """Category of a value, NULL when the hierarchy does not list it."""
    pairs = [F.lit(x) for pair in categories.items() for x in pair]
    return F.try_element_at(F.create_map(*pairs), c.cast("string"))


def hashed(c: Column, key: str | None) -> Column:
    """SHA-256 of key and value. Without a key anyone could try out values, so one must be set."""
    if not key:
        raise ValueError("ENCRYPTION needs a key")
    return F.sha2(F.concat(F.lit(key), c.cast("string")), 256)


def encrypted(c: Column, key: Column) -> Column:
    """Reversible form, for keys of 16, 24 or 32 bytes; see :func:`decrypted`."""
    return F.base64(F.aes_encrypt(c.cast("string"), key))


def decrypted(c: Column, key: Column) -> Column:
    return F.aes_decrypt(F.unbase64(c), key).cast("string")


def generalize(c: Column, hierarchy: str | None) -> Column:
    rule = json.loads(hierarchy or "{}")
    if "band" in rule:
        return band(c, rule["band"])
    if "unit" in rule:
        return calendar_unit(c, rule["unit"])
    if "categories" in rule:
        return category(c, rule["categories"])
    raise ValueError(f"A hierarchy names a band, a unit or categories: {hierarchy}")


def generalize_by(df: DataFrame, column: str, hierarchy: DataFrame) -> DataFrame:
    """Replace a value by its category from a (value, category) relation.

    A value that is listed twice has the first of its categories by name.
    A broadcast is left to Spark, which knows the size of the hierarchy.
    """
    value, cat = hierarchy.columns
    steps = hierarchy.groupBy(F.col(value).alias("_value")).agg(F.min(cat).alias("_category"))
    joined = df.join(steps, df[column] == steps["_value"], "left")
    return joined.withColumn(column, F.col("_category")).drop("_value", "_category")


def apply_policy(c: Column, dtype: T.DataType, policy: Policy) -> Column:
    if policy.technique not in TECHNIQUES:
        raise ValueError(f"Unknown technique: {policy.technique}")
    if policy.technique == "MASK":
        return mask(c)
    if policy.technique == "ENCRYPTION":
        return hashed(c, policy.key)
    if policy.technique == "GENERALIZATION":
        return generalize(c, policy.hierarchy)
    if policy.technique == "SUPPRESSION" or policy.privacy_type == "IDENTIFIER":
        return suppress(c, dtype)
    return c


def read_policies(policies: DataFrame, columns: Sequence[str]) -> list[Policy]:
    """The newest policy (largest id) of each of the columns.

    At most one row per column reaches the driver.
    """
    fields = Policy._fields
    newest = (
        policies.where(F.col("attribute_name").isin(list(columns)))
        .groupBy("attribute_name")
        .agg(F.max_by(F.struct(*fields), F.col("id")).alias("p"))
        .select("p.*")
    )
    return [Policy(**row.asDict()) for row in newest.collect()]


def anonymize(df: DataFrame, policies: Sequence[Policy] | DataFrame) -> DataFrame:
    """Apply a policy table to a source in one projection."""
    if isinstance(policies, DataFrame):
        policies = read_policies(policies, df.columns)
    by_name = {p.attribute_name: p for p in policies}
    columns = []
    for field in df.schema.fields:
        c = F.col(f"`{field.name}`")
        if field.name in by_name:
            c = apply_policy(c, field.dataType, by_name[field.name])
        columns.append(c.alias(field.name))
    return df.select(*columns)


def equivalence_classes(df: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """Size of each group of rows that agree on the quasi-identifiers."""
    return df.groupBy(*quasi).agg(F.count("*").alias("k"))


def identification_risk(df: DataFrame, quasi: Sequence[str]) -> DataFrame:
    """Risk of singling out a row: worst case (probability) and mean (value).

    A row's risk is 1/k in a group of k, so the mean over rows is the number of
    groups over the number of rows.
    """
    groups = equivalence_classes(df, quasi)
    return groups.agg(
        F.lit("IDENTIFICATION").alias("type"),
        (F.lit(1.0) / F.min("k")).alias("probability"),
        (F.count("*") / F.sum("k")).alias("value"),
        F.lit(json.dumps(list(quasi))).alias("detail"),
    )


def k_anonymity_violations(df: DataFrame, quasi: Sequence[str], k: int) -> DataFrame:
    """Groups of fewer than ``k`` rows."""
    return equivalence_classes(df, quasi).where(F.col("k") < k)


def l_diversity(df: DataFrame, quasi: Sequence[str], sensitive: Column) -> DataFrame:
    """Distinct sensitive values in each group."""
    return (
        df.withColumn("_sensitive", sensitive)
        .groupBy(*quasi)
        .agg(F.count_distinct("_sensitive").alias("l"), F.count("*").alias("k"))
    )
