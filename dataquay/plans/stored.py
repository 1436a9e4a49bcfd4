"""What is kept beside a source so that a second question costs less: statistics per file, positions, postings."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.operators import increments, pages, postings
from dataquay.plans.profiling import LINE_COLUMNS
from dataquay.plans.registry import Tables, query
from dataquay.session import scratch_dir

_NUMBERS = set(LINE_COLUMNS[:8])


def _measures(c: str) -> str:
    if c in _NUMBERS:
        return f"round(avg({c}), 4) AS mean_value, round(stddev_samp({c}), 4) AS std_deviation, round(CAST(min({c}) AS DOUBLE), 4) AS low, round(CAST(max({c}) AS DOUBLE), 4) AS high"
    return "CAST(NULL AS DOUBLE) AS mean_value, CAST(NULL AS DOUBLE) AS std_deviation, CAST(NULL AS DOUBLE) AS low, CAST(NULL AS DOUBLE) AS high"


@query("profile_incremental", " UNION ALL ".join(
    f"SELECT {i} AS position, '{c}' AS name, count(*) AS rows, count(*) - count({c}) AS missing_total, {_measures(c)} FROM lineitem"
    for i, c in enumerate(LINE_COLUMNS)))
def profile_incremental(t: Tables) -> DataFrame:
    """A source in three deliveries; the third run reads the last one alone, and a delivery sent in error is gone by then."""
    source, store = scratch_dir(t.spark, "deliveries"), scratch_dir(t.spark, "profiles")
    lines = t.lineitem.select(*LINE_COLUMNS)
    for delivery, flags in (("1", "AN"), ("2", "N"), ("2", "R")):
        rows = lines.where(F.col("l_returnflag").isin(*flags))
        rows.write.mode("overwrite").parquet(f"{source}/delivery={delivery}")
        found = increments.profile_files(t.spark, store, source, LINE_COLUMNS)

    def fixed(c: str, name: str):
        return F.round(F.col(c).try_cast("double"), 4).alias(name)

    return found.select(
        "position", "name", "rows", "missing_total", fixed("mean_value", "mean_value"), fixed("std_deviation", "std_deviation"),
        fixed("min_value", "low"), fixed("max_value", "high"),
    )


#: First positions of the pages asked for: early, deep, and over the end.
PAGE_STARTS = (0, 4_321, 5_900)
PAGE_ROWS = 250


@query("page_indexed", f"""
WITH r AS (SELECT row_number() OVER (ORDER BY l_extendedprice DESC, l_orderkey, l_linenumber) AS rank, l_orderkey, l_linenumber FROM lineitem)
SELECT * FROM r WHERE {' OR '.join(f'rank BETWEEN {s + 1} AND {s + PAGE_ROWS}' for s in PAGE_STARTS)}""")
def page_indexed(t: Tables) -> DataFrame:
    """Several pages of one order, from one sort."""
    path = scratch_dir(t.spark, "positions")
    pages.index_positions(t.lineitem, [F.col("l_extendedprice").desc(), "l_orderkey", "l_linenumber"], path)
    found = [pages.read_positions(t.spark, path, s, s + PAGE_ROWS) for s in PAGE_STARTS]
    return reduce(DataFrame.unionByName, found).select("rank", "l_orderkey", "l_linenumber")


#: A plain term, an umlaut in capitals, both wildcards, and one too short for the index.
TERMS = ("password", "ÇÉ", "ANEN%ment", "o_blet", "ü")


@query("search_indexed", " UNION ALL ".join(
    f"SELECT '{term}' AS term, doc_id FROM documents WHERE text ILIKE '%{term}%' OR source ILIKE '%{term}%'" for term in TERMS))
def search_indexed(t: Tables) -> DataFrame:
    """Five searches of all documents by one index."""
    path, columns = scratch_dir(t.spark, "postings"), ("text", "source")
    postings.index_texts(t.documents, "doc_id", columns, path)
    found = [
        postings.search_indexed(t.documents, term, "doc_id", columns, path).select(F.lit(term).alias("term"), "doc_id")
        for term in TERMS
    ]
    return reduce(DataFrame.unionByName, found)
