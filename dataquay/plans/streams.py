"""Streaming forms, run to the end of the table's files."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from dataquay.functions.convert import Attribute
from dataquay.plans.registry import Tables, query
from dataquay.plans.scans import EVENT_KINDS, UPLOAD_PARTS, upload_parts
from dataquay.session import scratch_dir
from dataquay.sources import readers as R
from dataquay.sources import writers as W
from dataquay.streaming.drift import ingest_files
from dataquay.streaming.ingest import ingest_csv
from dataquay.streaming.uploads import UploadTracker


@query("stream_upload_completeness", f"""
WITH {UPLOAD_PARTS}
SELECT file, count(DISTINCT part) AS parts_present, max(total) AS parts_expected
FROM parts GROUP BY file HAVING count(DISTINCT part) = {len(EVENT_KINDS)}""")
def stream_upload_completeness(t: Tables) -> DataFrame:
    # A glob, since a stream takes a folder or a pattern, and a table may be one file.
    events = t.spark.readStream.schema(t.events.schema).parquet(f"{t.folder}/event[s].parquet")
    arrivals = upload_parts(events)
    tracker = UploadTracker(t.spark, scratch_dir(t.spark, "uploads"), arrivals.schema["file"])
    tracker.start(arrivals, "part", "total").awaitTermination()
    return tracker.complete_files()


INGEST_ATTRIBUTES = (
    Attribute("event_id", "LONG"), Attribute("user_id", "LONG"),
    Attribute("event_type", "CHARACTER"), Attribute("value", "DOUBLE"),
)


@query("stream_ingest", """
SELECT 'rows' AS side, event_id FROM events WHERE event_type <> 'error' UNION ALL
SELECT 'rejected', event_id FROM events WHERE event_type = 'error'""")
def stream_ingest(t: Tables) -> DataFrame:
    """Errors have a value that is no number, and are set aside."""
    source, root = scratch_dir(t.spark, "incoming"), scratch_dir(t.spark, "ingested")
    value = F.when(F.col("event_type") == "error", "broken").otherwise(F.col("value").cast("string"))
    W.export_csv(t.events.select("event_id", "user_id", "event_type", value.alias("value")), source)
    spec = R.SourceSpec("CSV", source, attributes=INGEST_ATTRIBUTES, is_first_line_header=True)
    ingest_csv(t.spark, spec, root).awaitTermination()
    rows = t.spark.read.parquet(f"{root}/rows").select(F.lit("rows").alias("side"), "event_id")
    rejected = t.spark.read.parquet(f"{root}/rejected").select(F.lit("rejected").alias("side"), "event_id")
    return rows.unionByName(rejected)


def _drifting(fmt: str):
    def run(t: Tables) -> DataFrame:
        """Three deliveries: as declared, with a column more and in another order, and with one less and text for a number."""
        source, root = scratch_dir(t.spark, "drifting"), scratch_dir(t.spark, "ingested")
        kind, base = F.col("event_type"), ("event_id", "user_id", "event_type")
        text = F.when(kind == "error", "broken").otherwise(F.col("value").cast("string")).alias("value")
        spec = R.SourceSpec(fmt, f"{source}/*", attributes=INGEST_ATTRIBUTES, is_first_line_header=True)
        deliveries = (
            t.events.where("event_type = 'click'").select(*base, "value"),
            t.events.where("event_type = 'view'").select("value", F.lit("shop").alias("channel"), *base),
            t.events.where("event_type NOT IN ('click', 'view') OR event_type IS NULL").select("event_type", text, "event_id"),
        )
        for i, rows in enumerate(deliveries):
            writer = rows.write.option("header", True)
            {"CSV": writer.csv, "JSON": writer.json, "PARQUET": writer.parquet}[fmt](f"{source}/{i}")
            ingest_files(t.spark, spec, root).awaitTermination()
        sides = [
            t.spark.read.parquet(f"{root}/{side}").select(F.lit(side).alias("side"), "event_id", "user_id", F.try_element_at("_extra", F.lit("channel")).alias("channel"))
            for side in ("rows", "rejected")
        ]
        return sides[0].unionByName(sides[1])

    return run


for _format in ("CSV", "JSON", "PARQUET"):
    query(f"stream_drift_{_format.lower()}", """
    SELECT CASE WHEN event_type = 'error' THEN 'rejected' ELSE 'rows' END AS side, event_id,
           CASE WHEN event_type IN ('click', 'view') THEN user_id END AS user_id, CASE WHEN event_type = 'view' THEN 'shop' END AS channel
    FROM events""")(_drifting(_format))
