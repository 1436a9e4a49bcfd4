"""JSON in text columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DEFAULT_STORAGE_USER = "hadoop"
EXTRA_PARAMS = "user string, use_hostname boolean, resources array<string>"


def parse_json(c: Column) -> Column:
    """The JSON value of a text as VARIANT, NULL when the text is not JSON."""
    return F.try_parse_json(c)


def storage_params(c: Column) -> Column:
    """User, use_hostname and resources of a storage's extra parameters."""
    parsed = F.from_json(c, EXTRA_PARAMS, {"mode": "PERMISSIVE"})
    return F.struct(
        F.coalesce(F.nullif(parsed["user"], F.lit("")), F.lit(DEFAULT_STORAGE_USER)).alias("user"),
        parsed["use_hostname"].alias("use_hostname"),
        parsed["resources"].alias("resources"),
    )
