"""From a source's catalog rows to its data, and back to attribute rows."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from dataquay.functions.convert import Attribute
from dataquay.functions.locations import first_filled
from dataquay.operators.mutate import replace_attributes
from dataquay.sources.readers import SourceSpec, infer_source, with_defaults


def located(sources: DataFrame, storages: DataFrame) -> DataFrame:
    """Sources with the ``location`` that counts: their own, else the storage's."""
    for name in ("client_url", "url"):
        if name not in storages.columns:
            storages = storages.withColumn(name, F.lit(None).cast("string"))
    places = storages.select(
        F.col("id").alias("storage_id"),
        F.col("client_url").alias("_client"),
        F.col("url").alias("_storage"),
    )
    joined = sources.join(places, "storage_id")
    location = first_filled(F.col("url"), F.col("_client"), F.col("_storage"))
    return joined.withColumns({
        "location": location,
        "scheme": F.coalesce(F.try_parse_url(location, F.lit("PROTOCOL")), F.lit("file")),
        "storage_url": first_filled(F.col("_client"), F.col("_storage")),
    }).drop("_client", "_storage")


def _get(row: Row, name: str):
    return row[name] if name in row else None


def source_spec(
    sources: DataFrame,
    storages: DataFrame,
    attributes: DataFrame,
    key: object,
    variables: DataFrame | None = None,
    values: Mapping[str, str | None] | None = None,
) -> SourceSpec:
    """How to read the source with an id.

    One catalog row and the source's schema reach the driver.
    """
    row = located(sources.where(F.col("id") == F.lit(key)), storages).first()
    if row is None:
        raise LookupError(f"Data source {key} not found")
    columns = attributes.where(F.col("data_source_id") == F.lit(key)).orderBy("position").collect()
    defaults = {}
    if variables is not None:
        mine = variables.where(F.col("data_source_id") == F.lit(key))
        defaults = {v["name"]: v["default_value"] for v in mine.collect()}
    return SourceSpec(
        format=row["format"],
        path=row["location"],
        scheme=row["scheme"],
        attributes=tuple(
            Attribute(a["name"], a["type"], _get(a, "precision"), _get(a, "scale"), _get(a, "format"))
            for a in columns
        ),
        attribute_delimiter=_get(row, "attribute_delimiter"),
        text_delimiter=_get(row, "text_delimiter"),
        treat_as_missing=_get(row, "treat_as_missing"),
        encoding=_get(row, "encoding"),
        is_first_line_header=bool(_get(row, "is_first_line_header")),
        is_multiline=bool(_get(row, "is_multiline")),
        command=_get(row, "command"),
        variables=with_defaults(values or {}, defaults),
        storage_url=row["storage_url"],
    )


def store_inferred(
    sources: DataFrame, storages: DataFrame, attributes: DataFrame, privacy: DataFrame, key: object
) -> tuple[DataFrame, DataFrame]:
    """Infer a source's schema and replace its stored attributes.

    Returns the next attributes and privacy settings.
    """
    spec = source_spec(sources, storages, attributes, key)
    found = infer_source(sources.sparkSession, spec)
    new = found.withColumn("data_source_id", F.lit(key)).withColumn(
        # Ids are unique per source and position.
        "id", F.concat_ws(":", F.lit(key).cast("string"), F.col("position").cast("string"))
    )
    return replace_attributes(attributes, privacy, new)
