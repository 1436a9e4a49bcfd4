"""Secret scans with corpus-wide ownership, in DataFrame functions only.

Candidates of a text are found by patterns. The hash of each is counted over
the corpus: in how many repositories, and by how many owners, it occurs. What
few own looks live; what many copied is an example. Tokens without a keyword
are too weak to report by their looks alone, and become spans only if they
are owner-specific.
"""

from __future__ import annotations

from collections.abc import Callable
from typing import NamedTuple

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquay.llm.common import staged, whole_text


class Kind(NamedTuple):
    """A pattern; the value of a match is a group of it, and must have so many characters."""

    name: str
    pattern: str
    group: int
    least: int


#: In the order in which kinds at one place are listed.
BASE = (
    Kind("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    Kind("access", r"AKIA[A-Z0-9]+", 0, 20),
    Kind("hex", r"[0-9a-f]{24,}", 0, 24),  # shorter runs would fail and end where they end now
)
#: Runs of token characters; those with a digit, a small and a capital letter are candidates.
LOOSE = Kind("loose", r"[A-Za-z0-9+/_=-]{20,}", 0, 20)
MIXED = r"^(?=.*[0-9])(?=.*[a-z])(?=.*[A-Z])"
#: A value with more owners, or in more repositories, is a copied example.
MOST_OWNERS = 2
MOST_REPOSITORIES = 4

_SPAN = "struct<start:long,rank:int,end:long,kind:string,value:string>"
_HASHED = "array<struct<start:long,rank:int,end:long,kind:string,hash:string>>"


def _running(items: Column, add: Callable[[Column, Column], Column]) -> Column:
    """The array with each item replaced by `add` over all items up to it.

    Each step adds the item twice as far back as the step before, so that n
    items take n log n additions and no array grows by one item at a time.
    """
    def step(acc: Column, back: Column) -> Column:
        told = F.transform(acc, lambda x, i: F.when(i >= back, add(F.get(acc, i - back), x)).otherwise(x))
        return F.when(back < F.size(acc), told).otherwise(acc)

    return F.aggregate(F.array(*[F.lit(1 << k) for k in range(31)]), items, step)


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once a row, whatever lambdas use it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def spans_of(text: Column, kind: Kind, rank: int) -> Column:
    """The spans of a kind, leftmost and not overlapping, as an array of structs; code points.

    The texts between matches and the matches themselves, laid end to end, give
    the places, so that a text is searched twice and no more.
    """
    matches = F.regexp_extract_all(text, F.lit(kind.pattern), F.lit(0))
    pieces = F.arrays_zip(F.split(text, kind.pattern, -1).alias("gap"), matches.alias("match"))
    found = _running(
        F.transform(F.filter(pieces, lambda x: x["match"].isNotNull()), lambda x: F.struct(
            (F.length(x["gap"]) + F.length(x["match"])).cast("long").alias("end"), x["match"].alias("match"),
        )),
        lambda before, x: F.struct((before["end"] + x["end"]).alias("end"), x["match"].alias("match")),
    )
    value = lambda x: F.regexp_extract(x["match"], kind.pattern, kind.group)
    named = F.transform(found, lambda x: F.struct(
        (x["end"] - F.length(x["match"])).alias("start"), F.lit(rank).alias("rank"), x["end"].alias("end"),
        F.lit(kind.name).alias("kind"), value(x).alias("value"),
    ))
    kept = F.filter(named, lambda x: F.length(x["value"]) >= kind.least)
    return F.when(text.rlike(kind.pattern), kept).otherwise(F.array()).cast(f"array<{_SPAN}>")


def _outside(spans: Column, base: Column) -> Column:
    """The spans that overlap none of `base`, which is sorted by start.

    Of the base spans that start before a span ends, found by halving, the
    furthest end tells.
    """
    def alone(x: Column, reach: Column) -> Column:
        before = F.aggregate(F.array(*[F.lit(1 << k) for k in reversed(range(30))]), F.lit(0), lambda n, step: F.when(
            F.get(reach, n + step - 1)["start"] < x["end"], n + step,
        ).otherwise(n))
        return ~F.coalesce(F.get(reach, before - 1)["end"] > x["start"], F.lit(False))

    ends = F.transform(base, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end")))
    furthest = _running(ends, lambda before, b: F.struct(b["start"].alias("start"), F.greatest(before["end"], b["end"]).alias("end")))
    found = _let(furthest, lambda reach: F.filter(spans, lambda x: alone(x, reach)))
    return F.when((F.size(spans) > 0) & (F.size(base) > 0), found).otherwise(spans)


def _loose(text: Column) -> Column:
    found = spans_of(text, LOOSE, len(BASE))
    return F.filter(found, lambda x: x["value"].rlike(MIXED))


def _hashed(spans: Column) -> Column:
    """The spans with the hash of each value in its place: no secret is written to a table."""
    return F.transform(spans, lambda x: F.struct(
        x["start"].alias("start"), x["rank"].alias("rank"), x["end"].alias("end"), x["kind"].alias("kind"),
        F.sha2(x["value"], 256).alias("hash"),
    )).cast(_HASHED)


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | str = "source", repository: Column | str = "source") -> DataFrame:
    """Per row: row_id, doc_id, owner, repository, base and loose spans. A written table, so that row ids hold."""
    text = whole_text(text_col)
    column = lambda c: (F.col(c) if isinstance(c, str) else c).cast("string")
    base = F.array_sort(F.concat(*[spans_of(text, kind, i) for i, kind in enumerate(BASE)]))
    rows = docs.select(
        F.monotonically_increasing_id().alias("row_id"), F.col(id_col).alias("doc_id"), column(owner).alias("owner"),
        column(repository).alias("repository"), _hashed(base).alias("base"), _hashed(_loose(text)).alias("loose"),
    )
    return staged(rows.withColumn("loose", _outside(F.col("loose"), F.col("base"))), "secret-spans")


def ownership(scanned: DataFrame, most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES) -> DataFrame:
    """Per candidate hash: n_rows, n_owners, n_repositories, live.

    Counted in two steps, by (hash, owner, repository) and then by hash, so that
    a value in a third of all rows is summed before it is shuffled. Null owners
    and repositories count as one each.
    """
    found = scanned.select("owner", "repository", F.explode(F.concat("base", "loose")).alias("span"))
    pairs = found.groupBy("span.hash", "owner", "repository").agg(F.count("*").alias("n"))
    owners = F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col("owner")), F.lit("")))
    repositories = F.count_distinct(F.coalesce(F.concat(F.lit("="), F.col("repository")), F.lit("")))
    counts = pairs.groupBy("hash").agg(F.sum("n").alias("n_rows"), owners.alias("n_owners"), repositories.alias("n_repositories"))
    return counts.withColumn("live", (F.col("n_owners") <= most_owners) & (F.col("n_repositories") <= most_repositories))


def find_secrets(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner: Column | str = "source",
    repository: Column | str = "source", most_owners: int = MOST_OWNERS, most_repositories: int = MOST_REPOSITORIES,
) -> DataFrame:
    """One row per row of `docs`: doc_id, base spans, all spans with `hash`, owner counts and `live`.

    Base spans stay whatever their ownership; loose ones are there only if they
    are live. Null texts are empty; texts of any length are searched whole;
    repeated rows give repeated results. An empty table gives no rows.
    """
    scanned = scan(docs, id_col, text_col, owner, repository)
    verdicts = ownership(scanned, most_owners, most_repositories)
    # Only rows with candidates take part in the join; a hot value splits, as its rows differ in row_id.
    spans = scanned.select("row_id", F.explode(F.concat("base", "loose")).alias("span")).withColumn("hash", F.col("span.hash"))
    told = spans.join(verdicts, "hash").where((F.col("span.rank") < len(BASE)) | F.col("live"))
    by_row = told.groupBy("row_id").agg(F.array_sort(F.collect_list(F.struct(
        "span.start", "span.rank", "span.end", "span.kind", "hash", "n_rows", "n_owners", "n_repositories", "live",
    ))).alias("spans"))
    return scanned.join(by_row, "row_id", "left").select(
        "doc_id", "base", F.coalesce("spans", F.array().cast(by_row.schema["spans"].dataType)).alias("spans"),
    )


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")
