"""Locations: which URL counts, and what is in it."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

# Ports used when the URL names none.
DEFAULT_PORTS = {"mysql": 3306, "hive": 10000, "hive2": 10000}


def without_patterns(path: str) -> str:
    """A path that Spark's readers take as it stands: some signs are patterns to them."""
    return re.sub(r"([\\{}\[\]*?])", r"\\\1", path)


def first_filled(*candidates: Column) -> Column:
    """The first candidate that is neither NULL nor empty."""
    return F.coalesce(*[F.nullif(c, F.lit("")) for c in candidates])


def url_parts(url: Column) -> dict[str, Column]:
    """Scheme, host, port, user, password, database and query of a URL."""

    def part(name: str) -> Column:
        return F.try_parse_url(url, F.lit(name))

    scheme = part("PROTOCOL")
    port = F.regexp_extract(part("AUTHORITY"), r":(\d+)$", 1).try_cast("int")
    default = F.lit(None).cast("int")
    for name, number in DEFAULT_PORTS.items():
        default = F.when(scheme == name, number).otherwise(default)
    user = part("USERINFO")
    return {
        "scheme": scheme,
        "host": part("HOST"),
        "port": F.coalesce(port, default),
        "username": F.nullif(F.substring_index(user, ":", 1), F.lit("")),
        "password": F.when(user.contains(":"), F.regexp_extract(user, ":(.*)$", 1)),
        "database": F.nullif(F.regexp_replace(part("PATH"), "^/+", ""), F.lit("")),
        "query": part("QUERY"),
    }


def query_map(url: Column) -> Column:
    """The query string of a URL as a map; the last value of a name wins."""
    query = F.try_parse_url(url, F.lit("QUERY"))
    pairs = F.transform(
        F.filter(F.split(query, "&"), lambda p: p != ""),
        lambda p: F.struct(
            F.substring_index(p, "=", 1).alias("key"),
            F.when(p.contains("="), F.regexp_extract(p, "=(.*)$", 1)).alias("value"),
        ),
    )
    # A name may repeat, which map construction refuses: keep its last place.
    last = F.filter(
        pairs,
        lambda p, i: ~F.exists(
            F.slice(pairs, i + 2, F.greatest(F.size(pairs) - i - 1, F.lit(0))),
            lambda later: later["key"] == p["key"],
        ),
    )
    return F.map_from_entries(last)
