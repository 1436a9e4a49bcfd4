"""Whole catalog questions: filter, search, visibility, sort, page, nest.

The page is found first; children are then read only for its rows, with the
ids in a filter that reaches the scan.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from dataquay.operators import catalog as K
from dataquay.operators.nested import Children, nest_children, with_storage
from dataquay.vocabulary import DATA_SOURCE_FORMATS, PAGE_SIZE, SYSTEM_USERS

# The columns lists may be sorted and searched by.
SOURCE_SORTS = ("name", "id", "user_id", "user_name")
MODEL_SORTS = ("name", "id", "user_id", "user_name", "type")
STORAGE_SORTS = ("name", "id", "type")
SOURCE_TEXTS = ("name", "description", "tags")
MODEL_TEXTS = ("name", "type")
STORAGE_TEXTS = ("name", "type")

# Up to this many ids go into a filter; a longer page is joined instead.
FILTER_IDS = 1000


@dataclass(frozen=True)
class Request:
    """What a caller asks of a list. Text flags are ``1`` or ``true``."""

    user: int
    text: str | None = None
    equal: tuple[tuple[str, object], ...] = ()
    formats: str = ""
    types: str = ""
    enabled: str | None = None
    lookup: str | None = None
    use_in_workflow: str | None = None
    sort: str | None = None
    ascending: bool = True
    page: int | None = 1  # None asks for the whole list, which has no ranks
    size: int = PAGE_SIZE
    fields: str | None = None
    simple: bool = False
    names_only: bool = False


def _shaped(df: DataFrame, request: Request, preset: tuple[str, ...]) -> DataFrame:
    """The asked columns, and the rank that orders a page."""
    if request.fields:
        return K.project_fields(df, request.fields + (", rank" if "rank" in df.columns else ""))
    return K.project_preset(df, (*preset, "rank")) if request.simple else df


def _paged(
    df: DataFrame, request: Request, allowed: tuple[str, ...], default: str, first_if_short: bool = False
) -> DataFrame:
    order = _order(request, allowed, default)
    if request.page is None:
        return df.orderBy(*order)
    lead = K.sort_lead(request.sort or default, allowed, request.ascending)
    turn = K.page_or_first if first_if_short else K.page
    return turn(df, order, request.page, request.size, lead)


def _enabled(df: DataFrame, request: Request) -> DataFrame:
    if request.enabled is None or not request.enabled.strip():
        return df
    return K.filter_equal(df, enabled=K.parse_flag(request.enabled))


def _order(request: Request, allowed: tuple[str, ...], default: str) -> list[Column]:
    return K.sort_columns(request.sort or default, allowed, request.ascending)


def matching_sources(sources: DataFrame, grants: DataFrame, request: Request) -> DataFrame:
    """The sources a list would show, before paging."""
    rows = K.filter_equal(_enabled(sources, request), **dict(request.equal))
    rows = K.filter_flags(rows, is_lookup=request.lookup, use_in_workflow=request.use_in_workflow)
    if request.text:
        rows = K.search_text(rows, request.text, [c for c in SOURCE_TEXTS if c in rows.columns])
    rows = K.visible_sources(rows, grants, request.user)
    return K.filter_in(rows, "format", request.formats, DATA_SOURCE_FORMATS)


def of_parents(children: DataFrame, foreign_key: str, parents: DataFrame, size: int | None) -> DataFrame:
    """The children of a page of at most ``size`` parents; None is no bound."""
    if size is None or size > FILTER_IDS:
        return children.join(parents.select(F.col("id").alias(foreign_key)), foreign_key, "left_semi")
    return children.where(F.col(foreign_key).isin([r["id"] for r in parents.select("id").collect()]))


def list_sources(
    sources: DataFrame, grants: DataFrame, attributes: DataFrame, request: Request
) -> tuple[DataFrame, DataFrame]:
    """One page of sources with their attributes, and the summary of the whole list."""
    rows = matching_sources(sources, grants, request)
    summary = K.page_summary(rows, request.size)
    if request.names_only:
        return K.project_preset(rows.orderBy(*_order(request, SOURCE_SORTS, "name")), K.LIST_FIELDS), summary
    shown = _paged(rows, request, SOURCE_SORTS, "name", first_if_short=True)
    if request.simple or request.fields:
        return _shaped(shown, request, K.SIMPLE_SOURCE_FIELDS), summary
    fields = [c for c in attributes.columns if c != "data_source_id"]
    mine = of_parents(attributes, "data_source_id", shown, None if request.page is None else request.size)
    return nest_children(shown, "id", {"attributes": Children(mine, "data_source_id", fields)}), summary


def list_models(
    models: DataFrame, grants: DataFrame, storages: DataFrame, request: Request
) -> tuple[DataFrame, DataFrame]:
    """One page of enabled models with their storage, and the summary of the whole list."""
    rows = K.visible_models(K.filter_equal(models, enabled=True), grants, request.user)
    rows = K.filter_equal(rows, **dict(request.equal))
    if request.text:
        rows = K.search_like(rows, request.text, MODEL_TEXTS)
    rows = K.filter_in(rows, "type", request.types)
    shown = _paged(rows, request, MODEL_SORTS, "name")
    if not (request.simple or request.fields):
        shown = with_storage(shown, storages)
    return _shaped(shown, request, K.SIMPLE_MODEL_FIELDS), K.page_summary(rows, request.size)


def list_storages(storages: DataFrame, request: Request) -> tuple[DataFrame, DataFrame]:
    """One page of storages, and the summary; only system users see where they are."""
    rows = _enabled(storages, request)
    if request.text:
        rows = K.search_text(rows, request.text, STORAGE_TEXTS)
    shown = _paged(rows, request, STORAGE_SORTS, "id")
    if request.user not in SYSTEM_USERS:
        shown = shown.drop("url")
    return _shaped(shown, request, K.SIMPLE_STORAGE_FIELDS), K.page_summary(rows, request.size)


def source_by_id(
    sources: DataFrame,
    grants: DataFrame,
    storages: DataFrame,
    children: dict[str, DataFrame],
    key: object,
    user: int,
    is_admin: bool = False,
) -> DataFrame:
    """The full document of one visible source; its locations only for owner and administrator.

    ``children`` maps a list's name to its relation, keyed by ``data_source_id``.
    """
    found = K.visible_sources(K.filter_equal(sources, id=key), grants, user)
    document = with_storage(found, storages)
    kinds = {
        name: Children(
            K.filter_equal(rows, data_source_id=key), "data_source_id",
            [c for c in rows.columns if c != "data_source_id"],
        )
        for name, rows in children.items()
    }
    document = nest_children(document, "id", kinds)
    private = [c for c in ("url",) if c in sources.columns]
    private += [f"storage.{c}" for c in ("url", "client_url", "extra_params") if c in storages.columns]
    return K.hide_unless(document, private, K.owner_or_admin(F.col("user_id"), user, is_admin))
