"""Incremental ingest of new files of one source."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dataquay.functions.convert import ERRORS, convert_columns
from dataquay.sources.readers import BAD_RECORD, SourceSpec, csv_options


def ingest_csv(spark: SparkSession, spec: SourceSpec, root: str, **trigger) -> StreamingQuery:
    """Convert the new CSV files of a folder to the declared schema.

    Good rows go to ``root/rows``; rows of a wrong width, or with a cell that
    does not fit, go to ``root/rejected`` with the reasons. A batch overwrites
    the folders of its own number, so running it again changes nothing.
    """
    names = [a.name for a in spec.attributes]
    fields = [T.StructField(n, T.StringType()) for n in [*names, BAD_RECORD]]
    raw = spark.readStream.schema(T.StructType(fields)).options(**csv_options(spec)).csv(spec.path)

    def take(batch: DataFrame, batch_id: int) -> None:
        # Both sides come from one parse of the files.
        checked = convert_columns(batch, spec.attributes, spec.tokens, keep=[BAD_RECORD]).persist()
        good = F.col(BAD_RECORD).isNull() & (F.size(ERRORS) == 0)
        rows = checked.where(good).drop(BAD_RECORD, ERRORS)
        rows.write.mode("overwrite").parquet(f"{root}/rows/batch={batch_id}")
        checked.where(~good).write.mode("overwrite").parquet(f"{root}/rejected/batch={batch_id}")
        checked.unpersist()

    return (
        raw.writeStream.foreachBatch(take)
        .option("checkpointLocation", f"{root}/checkpoint")
        .trigger(**(trigger or {"availableNow": True}))
        .start()
    )
