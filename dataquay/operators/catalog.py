"""Catalog questions: filters, search, visibility, projections, sorting, paging."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from dataquay.operators.positions import Lead, rows_between
from dataquay.vocabulary import PAGE_SIZE, PERMISSIONS, SAMPLE_MAX, SAMPLE_ROWS, SYSTEM_USERS

# The columns of the preset lists.
SIMPLE_SOURCE_FIELDS = (
    "id", "name", "description", "created", "tags", "format", "user_name",
    "permissions", "user_id", "privacy_aware", "download_token",
)
SIMPLE_MODEL_FIELDS = ("id", "name", "created", "user_name", "user_id")
SIMPLE_STORAGE_FIELDS = ("id",)
LIST_FIELDS = ("id", "name", "tags")

# Beyond this many rows a page is cut out of a distributed sort, since the
# quick way keeps page start + page size rows in one place.
SHALLOW_ROWS = 100_000


# --- projections -----------------------------------------------------------

def project_fields(df: DataFrame, fields: str) -> DataFrame:
    """Keep the columns of a comma list; blanks around names do not count."""
    return df.select(*[name.strip() for name in fields.split(",")])


def project_preset(df: DataFrame, preset: Sequence[str]) -> DataFrame:
    """Keep the columns of a preset that the relation has."""
    return df.select(*[name for name in preset if name in df.columns])


def attribute_names(documents: DataFrame, attributes: str = "attributes") -> DataFrame:
    """Replace nested attributes by the list of their names."""
    return documents.withColumn(attributes, F.transform(attributes, lambda a: a["name"]))


def owner_or_admin(owner: Column, user: int, is_admin: bool) -> Column:
    return F.lit(is_admin) | (owner == F.lit(user))


def hide_unless(df: DataFrame, columns: Iterable[str], allowed: Column) -> DataFrame:
    """NULL the columns in the rows where the caller may not see them.

    A dotted name hides a member of a struct column.
    """
    for name in columns:
        outer, _, inner = name.partition(".")
        if inner:
            nulled = F.col(outer).withField(inner, F.lit(None).cast(df.select(name).schema[0].dataType))
            df = df.withColumn(outer, F.when(allowed, F.col(outer)).otherwise(nulled))
        else:
            df = df.withColumn(name, F.when(allowed, F.col(name)))
    return df


def json_without_nulls(columns: Iterable[str]) -> Column:
    """One JSON object per row; NULL members are left out, empty lists stay."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "true"})


# --- filters ---------------------------------------------------------------

TRUE_WORDS = ("1", "true")


def parse_flag(text: str) -> bool:
    return text.strip().lower() in TRUE_WORDS


def filter_equal(df: DataFrame, **wanted: object) -> DataFrame:
    """Keep rows that equal every given value; None or blank text asks nothing."""
    asked = {k: v for k, v in wanted.items() if v is not None and str(v).strip() != ""}
    return reduce(lambda d, kv: d.where(F.col(kv[0]) == F.lit(kv[1])), asked.items(), df)


def filter_flags(df: DataFrame, **flags: str | None) -> DataFrame:
    """Keep rows whose boolean column is set, for every flag switched on."""
    for column, text in flags.items():
        if text is not None and parse_flag(text):
            df = df.where(F.col(column))
    return df


def filter_in(df: DataFrame, column: str, members: str, allowed: Sequence[str] | None = None) -> DataFrame:
    """Keep rows whose value is in a comma list.

    Members outside ``allowed`` are ignored, and a list with no valid member
    asks nothing.
    """
    wanted = [m for m in members.split(",") if m and (allowed is None or m in allowed)]
    return df.where(F.col(column).isin(wanted)) if wanted else df


def search_text(df: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Case-insensitive "contains" over any of the columns; % and _ are wildcards."""
    hits = [F.col(c).ilike(f"%{term}%") for c in columns]
    return df.where(reduce(Column.__or__, hits))


def search_like(df: DataFrame, term: str, columns: Sequence[str]) -> DataFrame:
    """Case-sensitive form of :func:`search_text`."""
    hits = [F.col(c).like(f"%{term}%") for c in columns]
    return df.where(reduce(Column.__or__, hits))


# --- visibility ------------------------------------------------------------

def granted_ids(grants: DataFrame, user: int, levels: Sequence[str], object_id: str) -> DataFrame:
    """The ids of the objects shared with a user at one of the levels."""
    return (
        grants.where((F.col("user_id") == user) & F.col("permission").isin(*levels))
        .select(object_id)
    )


def visible_sources(
    sources: DataFrame,
    grants: DataFrame,
    user: int,
    levels: Sequence[str] = PERMISSIONS,
    consider_public: bool = True,
) -> DataFrame:
    """Sources a user owns, was granted, or that are public.

    The grant test is an IN subquery under OR, which Catalyst turns into an
    existence join: a source never repeats, however many grants it has.
    """
    if user in SYSTEM_USERS:
        return sources
    seen = (F.col("user_id") == user) | F.col("id").isin(
        granted_ids(grants, user, levels, "data_source_id")
    )
    if consider_public:
        seen = seen | F.col("is_public")
    return sources.where(seen)


def visible_models(
    models: DataFrame, grants: DataFrame, user: int, levels: Sequence[str] = PERMISSIONS
) -> DataFrame:
    """Models a user owns or was granted; users 0 and 1 see all. One row per model."""
    if user in SYSTEM_USERS:
        return models
    granted = granted_ids(grants, user, levels, "model_id")
    return models.where((F.col("user_id") == user) | F.col("id").isin(granted))


def shared_sources(
    sources: DataFrame, grants: DataFrame, user: int, levels: Sequence[str] = PERMISSIONS
) -> DataFrame:
    """Only the sources shared with a user."""
    granted = granted_ids(grants, user, levels, "data_source_id")
    return sources.join(granted, sources["id"] == granted["data_source_id"], "left_semi")


# --- sorting, paging, sampling ---------------------------------------------

def sort_lead(sort: str, allowed: Sequence[str], ascending: bool = True, key: str = "id") -> Lead:
    """The column a list is sorted by first: an allowed one, else the key."""
    return Lead(sort if sort in allowed else key, ascending)


def sort_columns(sort: str, allowed: Sequence[str], ascending: bool = True, key: str = "id") -> list[Column]:
    """Sort by an allowed column, else by the key; the key breaks ties."""
    chosen = sort_lead(sort, allowed, ascending, key).name
    first = F.col(chosen).asc() if ascending else F.col(chosen).desc()
    return [first] if chosen == key else [first, F.col(key).asc()]


def page(
    df: DataFrame,
    order: Sequence[Column],
    number: int = 1,
    size: int = PAGE_SIZE,
    lead: Lead | None = None,
) -> DataFrame:
    """Rows of one page in a total order, with their ``rank`` in the whole list.

    Early pages use Spark's top-k, which never sorts the relation. A page deep
    in the list is cut out of a distributed sort instead, so that the rows
    before it are never gathered in one task; ``lead`` makes that cheaper.
    """
    if number < 1 or size < 1:
        raise ValueError("page number and size start at 1")
    start = (number - 1) * size
    if start + size > SHALLOW_ROWS:
        return rows_between(df, order, start, start + size, lead)
    rows = df.orderBy(*order).offset(start).limit(size)
    # No more rows than one page get here.
    rank = F.row_number().over(Window.orderBy(*order)).cast("long") + F.lit(start)
    return rows.withColumn("rank", rank)


def page_summary(df: DataFrame, size: int = PAGE_SIZE) -> DataFrame:
    """Total rows and number of pages of a list."""
    return df.agg(F.count("*").alias("total")).select(
        "total", F.ceil(F.col("total") / size).cast("long").alias("pages")
    )


def page_or_first(
    df: DataFrame,
    order: Sequence[Column],
    number: int,
    size: int = PAGE_SIZE,
    lead: Lead | None = None,
) -> DataFrame:
    """Like :func:`page`; a list shorter than one page always shows page 1."""
    if number > 1 and df.limit(size).count() < size:
        number = 1
    return page(df, order, number, size, lead)


def sample_head(df: DataFrame, rows: int = SAMPLE_ROWS) -> DataFrame:
    """The first rows a scan yields; more than the maximum is an error."""
    if rows > SAMPLE_MAX:
        raise ValueError(f"The maximum number of records allowed is {SAMPLE_MAX}")
    return df.limit(rows)
