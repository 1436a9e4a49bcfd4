"""Catalog changes, as functions from one snapshot to the next.

A snapshot is never changed in place: write each result to a new location.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from dataquay.operators.catalog import owner_or_admin, visible_models, visible_sources
from dataquay.vocabulary import INITIALIZATION_STATUSES, SHARE_LEVELS, WRITE_LEVELS

# What a new source gets for the fields it leaves out.
SOURCE_DEFAULTS = {
    "enabled": True,
    "statistics_process_counter": 0,
    "read_only": True,
    "privacy_aware": False,
    "temporary": False,
    "is_public": False,
    "is_first_line_header": False,
    "is_multiline": False,
    "is_lookup": False,
    "use_in_workflow": False,
    "initialization": "NO_INITIALIZED",
}


def _has_order(dtype: T.DataType) -> bool:
    """Whether values of a type can be compared; maps and variants cannot."""
    text = dtype.simpleString()
    return "map<" not in text and "variant" not in text


def latest_per_key(df: DataFrame, keys: Sequence[str], order: Sequence[str]) -> DataFrame:
    """One row per key: the last in the given order, other columns breaking ties.

    An aggregate rather than a window, so that the rows of a hot key are
    reduced before they are shuffled.
    """
    rest = [c for c in df.columns if c not in keys]
    rank = [*order, *[c for c in rest if c not in order and _has_order(df.schema[c].dataType)]]
    best = F.max_by(F.struct(*rest), F.struct(*rank)).alias("_row")
    picked = df.groupBy(*keys).agg(best)
    return picked.select(*[c if c in keys else F.col("_row")[c].alias(c) for c in df.columns])


def create_sources(
    existing: DataFrame,
    new: DataFrame,
    storages: DataFrame,
    owner: int,
    defaults: Mapping[str, object] = SOURCE_DEFAULTS,
    login: str | None = None,
    name_: str | None = None,
    now: Column | None = None,
) -> DataFrame:
    """Append new sources, with defaults for what they leave out.

    The caller, with ``login`` and ``name_``, becomes the owner where none is
    given; a JDBC source takes its storage's URL. A new source is never
    initialized, whatever the caller says, and has no estimated rows; it is
    created and updated ``now``.
    """
    filled = {"user_id": F.coalesce("user_id", F.lit(owner)) if "user_id" in new.columns else F.lit(owner)}
    forced = {"initialization": F.lit("NO_INITIALIZED"), "estimated_rows": F.lit(0), "created": now, "updated": now}
    filled |= {n: v for n, v in forced.items() if n in existing.columns and v is not None}
    for column, value in (("user_login", login), ("user_name", name_)):
        if column in existing.columns:
            given = F.col(column) if column in new.columns else F.lit(None)
            filled[column] = F.coalesce(given, F.lit(value))
    for name, value in defaults.items():
        if name in filled:
            continue
        if name in existing.columns:
            filled[name] = F.coalesce(F.col(name), F.lit(value)) if name in new.columns else F.lit(value)
    complete = new.withColumns(filled)
    urls = storages.select(F.col("id").alias("storage_id"), F.col("url").alias("_storage_url"))
    located = complete.join(urls, "storage_id", "left")
    is_jdbc = F.col("format") == "JDBC"
    located = located.withColumn("url", F.when(is_jdbc, F.col("_storage_url")).otherwise(F.col("url")))
    return existing.unionByName(located.drop("_storage_url"), allowMissingColumns=True).select(*existing.columns)


def without_text_attributes(attributes: DataFrame, sources: DataFrame) -> DataFrame:
    """Drop the attributes of TEXT sources, which never have any."""
    text = sources.where(F.col("format") == "TEXT").select(F.col("id").alias("data_source_id"))
    return attributes.join(text, "data_source_id", "left_anti")


def upsert(
    old: DataFrame, new: DataFrame, key: str, order: Sequence[str], id_column: str = "id"
) -> DataFrame:
    """Replace rows by natural key, keeping their id; rows with a new key are added.

    Several new rows for one key: the last in ``order`` wins. Of old rows that
    share a key, the one with the smallest id is replaced and the others stay.
    Columns the new rows do not have keep their old value.

    The patch learns the id of the row it replaces, from old keys that are
    reduced first; old rows are then matched by id, so that a key that many of
    them share never meets in one task.
    """
    firsts = old.groupBy(F.col(key).alias("_key")).agg(F.min(id_column).alias("_first"))
    patch = latest_per_key(new, [key], order).select(F.struct(*new.columns).alias("n"))
    placed = patch.join(firsts, F.col("n")[key] == F.col("_key"), "left").drop("_key")
    left = old.select(F.struct(*old.columns).alias("o"))
    known = placed.where(F.col("_first").isNotNull())
    kept = left.join(known, F.col("o")[id_column] == F.col("_first"), "left").drop("_first")
    added = placed.where(F.col("_first").isNull()).select(F.lit(None).cast(kept.schema["o"].dataType).alias("o"), "n")
    joined = kept.unionByName(added)
    columns = []
    for name in old.columns:
        if name == id_column:
            taken = F.coalesce(F.col("o")[name], F.col("n")[name] if name in new.columns else F.lit(None))
        elif name in new.columns:
            taken = F.when(F.col("n").isNotNull(), F.col("n")[name]).otherwise(F.col("o")[name])
        else:
            taken = F.col("o")[name]
        columns.append(taken.alias(name))
    return joined.select(*columns)


def _from_text(text: Column, dtype: T.DataType) -> Column:
    if isinstance(dtype, (T.ArrayType, T.StructType, T.MapType)):
        return F.from_json(text, dtype)
    return text.try_cast(dtype)


def partial_update(
    rows: DataFrame, patches: DataFrame, key: str = "id", order: Sequence[str] = ()
) -> DataFrame:
    """Change only the supplied fields.

    A patch row is (key, changes), where ``changes`` maps a field to its new
    value as text (JSON for lists). A field that is mapped to NULL becomes
    NULL; a field that is not mapped stays. Unknown fields are ignored. Of
    several patches of one field of a row, the last in ``order`` wins.
    """
    fields = [c for c in rows.columns if c != key]
    entries = patches.select(key, *order, F.explode("changes").alias("_field", "_value")).where(
        F.col("_field").isin(fields)
    )
    newest = latest_per_key(entries, [key, "_field"], order)
    # One entry per field of the relation is left for a row.
    merged = newest.groupBy(key).agg(
        F.map_from_entries(F.collect_list(F.struct("_field", "_value"))).alias("_changes")
    )
    joined = rows.join(merged, key, "left")
    columns = [F.col(key)]
    for name in fields:
        supplied = F.coalesce(F.map_contains_key("_changes", F.lit(name)), F.lit(False))
        value = _from_text(F.col("_changes")[name], rows.schema[name].dataType)
        columns.append(F.when(supplied, value).otherwise(F.col(name)).alias(name))
    return joined.select(*columns).select(*rows.columns)


def soft_delete(rows: DataFrame, doomed: DataFrame, key: str = "id") -> DataFrame:
    """Disable the rows whose key is listed."""
    marks = doomed.select(key).distinct().withColumn("_doomed", F.lit(True))
    joined = rows.join(marks, key, "left")
    return joined.withColumn("enabled", F.col("enabled") & F.col("_doomed").isNull()).select(*rows.columns)


def change_outcomes(
    asked: DataFrame, sources: DataFrame, grants: DataFrame, user: int, is_admin: bool = False
) -> DataFrame:
    """One row (id, outcome) per source a caller wants to change or delete.

    ``OK`` for the owner or an administrator, ``Not authorized`` for others who
    see it with write access, ``Not found`` for the rest.
    """
    seen = visible_sources(sources, grants, user, WRITE_LEVELS).select(
        "id", owner_or_admin(F.col("user_id"), user, is_admin).alias("_may"), F.lit(True).alias("_seen")
    )
    outcome = F.when(F.col("_seen").isNull(), "Not found").when(F.col("_may"), "OK").otherwise("Not authorized")
    return asked.select("id").distinct().join(seen, "id", "left").select("id", outcome.alias("outcome"))


def delete_sources(
    sources: DataFrame, grants: DataFrame, asked: DataFrame, user: int, is_admin: bool = False
) -> tuple[DataFrame, DataFrame]:
    """Disable the listed sources that the caller may delete; also the outcomes."""
    outcomes = change_outcomes(asked, sources, grants, user, is_admin)
    return soft_delete(sources, outcomes.where("outcome = 'OK'")), outcomes


def patch_sources(
    sources: DataFrame,
    grants: DataFrame,
    patches: DataFrame,
    user: int,
    is_admin: bool = False,
    order: Sequence[str] = (),
    attributes: DataFrame | None = None,
    now: Column | None = None,
) -> tuple[DataFrame, DataFrame]:
    """Apply the patches the caller may make; also the outcomes.

    With ``attributes``, a patch that would leave a lookup source without
    exactly two attributes is refused as ``Invalid lookup``. With ``now``,
    ``updated`` is raised on the sources that change. Attributes of sources
    that become TEXT go by :func:`without_text_attributes`.
    """
    outcomes = change_outcomes(patches, sources, grants, user, is_admin)
    if attributes is not None:
        allowed = patches.join(outcomes.where("outcome = 'OK'"), "id", "left_semi")
        wrong = lookup_violations(partial_update(sources, allowed, "id", order), attributes).select(F.col("id").alias("_wrong")).distinct()
        checked = outcomes.join(wrong, F.col("id") == F.col("_wrong"), "left")
        refused = (F.col("outcome") == "OK") & F.col("_wrong").isNotNull()
        outcomes = checked.select("id", F.when(refused, "Invalid lookup").otherwise(F.col("outcome")).alias("outcome"))
    accepted = outcomes.where("outcome = 'OK'")
    after = partial_update(sources, patches.join(accepted, "id", "left_semi"), "id", order)
    if now is not None:
        marks = accepted.select(F.col("id").alias("_id"))
        after = after.join(marks, F.col("id") == F.col("_id"), "left")
        after = after.withColumn("updated", F.when(F.col("_id").isNotNull(), now).otherwise(F.col("updated"))).select(*sources.columns)
    return after, outcomes


def delete_models(models: DataFrame, grants: DataFrame, asked: DataFrame, user: int) -> DataFrame:
    """Disable the listed models that the caller owns or may write."""
    allowed = visible_models(models, grants, user, WRITE_LEVELS).join(asked.select("id"), "id", "left_semi")
    return soft_delete(models, allowed)


def replace_attributes(
    attributes: DataFrame, privacy: DataFrame, new: DataFrame
) -> tuple[DataFrame, DataFrame]:
    """Replace all attributes of the sources that ``new`` describes.

    Returns the next attributes and privacy settings; settings of replaced
    attributes are gone.
    """
    renewed = new.select("data_source_id").distinct()
    kept = attributes.join(renewed, "data_source_id", "left_anti")
    gone = attributes.join(renewed, "data_source_id", "left_semi").select(F.col("id").alias("attribute_id"))
    settings = privacy.join(gone, "attribute_id", "left_anti")
    return kept.unionByName(new, allowMissingColumns=True), settings


PERMISSION_KEY = ("data_source_id", "user_id")


def share(
    grants: DataFrame, requests: DataFrame, sources: DataFrame, caller: int, order: Sequence[str] = ()
) -> tuple[DataFrame, DataFrame]:
    """Grant or change permissions on the sources the caller may manage.

    A new grant takes the person's name and login from its request; a changed
    one takes those that the request has. Returns the next grants, and one row per accepted request with the action
    taken, ``Added`` or ``Updated``.
    """
    managed = visible_sources(sources, grants, caller, SHARE_LEVELS).select(
        F.col("id").alias("data_source_id")
    )
    allowed = requests.join(managed, "data_source_id", "left_semi")
    wanted = latest_per_key(allowed, list(PERMISSION_KEY), order)
    rest = [c for c in wanted.columns if c not in PERMISSION_KEY]
    asked = wanted.select(*PERMISSION_KEY, F.struct(*rest).alias("_asked"))
    # The requests of a task are held by hash, and its grants pass by: neither is sorted, however many grants a source has.
    joined = grants.join(asked.hint("shuffle_hash"), list(PERMISSION_KEY), "full")
    after = joined.select(*[
        c if c in PERMISSION_KEY or c not in rest else F.coalesce(F.col("_asked")[c], F.col(c)).alias(c) for c in grants.columns
    ])
    held = grants.select(*PERMISSION_KEY).distinct().withColumn("_held", F.lit(True))
    matched = wanted.join(held, list(PERMISSION_KEY), "left")
    action = F.when(F.col("_held").isNull(), "Added").otherwise("Updated")
    return after, matched.select(*PERMISSION_KEY, "permission", action.alias("action"))


def revoke(grants: DataFrame, revoked: DataFrame, sources: DataFrame, caller: int) -> DataFrame:
    """Remove (source, user) grants on the sources the caller may manage."""
    managed = visible_sources(sources, grants, caller, SHARE_LEVELS).select(
        F.col("id").alias("data_source_id")
    )
    doomed = revoked.join(managed, "data_source_id", "left_semi").select(*PERMISSION_KEY)
    return grants.join(doomed, list(PERMISSION_KEY), "left_anti")


def set_initialization(
    rows: DataFrame, key: object, status: str, grants: DataFrame | None = None, user: int | None = None
) -> DataFrame:
    """Set the initialization status of one source; unknown statuses are an error.

    With ``grants`` and ``user``, only a source that the user sees is changed.
    """
    if status not in INITIALIZATION_STATUSES:
        raise ValueError(f"Unknown initialization status: {status}")
    changed = F.when(F.col("id") == F.lit(key), F.lit(status)).otherwise(F.col("initialization"))
    if grants is None:
        return rows.withColumn("initialization", changed)
    one = rows.where(F.col("id") == F.lit(key))
    seen = visible_sources(one, grants, user).select("id").distinct().withColumn("_seen", F.lit(True))
    joined = rows.join(seen, "id", "left")
    value = F.when(F.col("_seen"), changed).otherwise(F.col("initialization"))
    return joined.withColumn("initialization", value).select(*rows.columns)


def touch_parents(parents: DataFrame, children: DataFrame, foreign_key: str) -> DataFrame:
    """Raise the parent's ``updated`` to that of its newest child."""
    newest = children.groupBy(F.col(foreign_key).alias("_key")).agg(F.max("updated").alias("_newest"))
    joined = parents.join(newest, parents["id"] == newest["_key"], "left")
    return joined.withColumn("updated", F.greatest("updated", "_newest")).select(*parents.columns)


def expired(sources: DataFrame, now: Column) -> DataFrame:
    """Temporary sources past their expiration, which is ISO text."""
    return sources.where(F.col("temporary") & (F.col("expiration").try_cast("timestamp_ntz") < now))


def purge_expired(sources: DataFrame, now: Column) -> DataFrame:
    """The sources that are left after a purge."""
    over = F.col("temporary") & (F.col("expiration").try_cast("timestamp_ntz") < now)
    return sources.where(~F.coalesce(over, F.lit(False)))


def lookup_violations(sources: DataFrame, attributes: DataFrame) -> DataFrame:
    """Lookup sources that do not have exactly two attributes."""
    counts = attributes.groupBy(F.col("data_source_id").alias("id")).agg(F.count("*").alias("attributes"))
    joined = sources.where("is_lookup").join(counts, "id", "left")
    filled = joined.withColumn("attributes", F.coalesce("attributes", F.lit(0)))
    return filled.where(F.col("attributes") != 2)
