"""Multi-part uploads as a stream of part arrivals."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from dataquay.operators.uploads import upload_completeness


# Batches after which counts are summed.
COMPACT_EVERY = 20


class UploadTracker:
    """Follows part arrivals, and lists each file once all its parts are there.

    The stream's state is keyed by (file, part): a part sent twice counts once,
    and a file with very many parts is spread over tasks. What is kept per
    batch is one row per file with the number of its new parts; the sum over
    batches tells whether a file is complete. A batch overwrites the folders of
    its own number when it runs again, so a lost executor or a restart neither
    drops nor repeats a part.

    Every ``COMPACT_EVERY`` batches the counts so far are summed per file, so
    that a batch reads the last sums and few folders of counts, however long
    the stream has run.
    """

    def __init__(self, spark: SparkSession, root: str, file: T.StructField):
        self.spark = spark
        self.root = root
        self.file = file.name
        self.stored = T.StructType([
            T.StructField(file.name, file.dataType),
            T.StructField("parts_present", T.LongType()),
            T.StructField("parts_expected", T.LongType()),
            T.StructField("batch", T.LongType()),
        ])

    def _folder(self, kind: str, batch_id: int | None = None) -> str:
        base = f"{self.root}/{kind}"
        return base if batch_id is None else f"{base}/batch={batch_id}"

    def _read(self, kind: str) -> DataFrame:
        return self.spark.read.schema(self.stored).parquet(self._folder(kind))

    def start(
        self,
        arrivals: DataFrame,
        part: str,
        total: str,
        time: str | None = None,
        resend_within: str = "7 days",
        **trigger,
    ) -> StreamingQuery:
        """Follow a stream of (file, part, total) rows.

        Every part ever seen is remembered, unless ``time`` names an arrival
        time: parts are then forgotten after ``resend_within``, which bounds
        the state, and the stream ignores arrivals that are older than that,
        re-sent or not. :meth:`reconcile` finds the files that such arrivals
        complete, from the stored parts.
        """
        arrivals = arrivals.where(F.col(part).between(1, F.col(total)))  # other numbers are strays
        columns = [self.file, part, F.col(total).cast("long").alias("parts_expected")]
        if time is None:
            new = arrivals.select(*columns).dropDuplicates([self.file, part])
        else:
            timed = arrivals.select(*columns, F.col(time).cast("timestamp").alias("_time"))
            new = timed.withWatermark("_time", resend_within).dropDuplicatesWithinWatermark([self.file, part])
        return (
            new.writeStream.outputMode("append")
            .foreachBatch(self._take)
            .option("checkpointLocation", f"{self.root}/checkpoint")
            .trigger(**(trigger or {"availableNow": True}))
            .start()
        )

    def _take(self, batch: DataFrame, batch_id: int) -> None:
        counts = batch.groupBy(self.file).agg(
            F.count("*").alias("parts_present"), F.max("parts_expected").alias("parts_expected")
        )
        counts.write.mode("overwrite").parquet(self._folder("counts", batch_id))
        # A batch that runs again must not see later ones.
        summed = batch_id // COMPACT_EVERY * COMPACT_EVERY - 1  # the last batch in the sums
        if batch_id % COMPACT_EVERY == 0 and batch_id:
            self._sums(summed - COMPACT_EVERY, summed).write.mode("overwrite").parquet(self._folder("sums", summed))
        counts = self._read("counts").where(F.col("batch") == batch_id)
        status = self._sums(summed, batch_id).join(counts.select(self.file), self.file, "left_semi")
        done = status.where(F.col("parts_present") == F.col("parts_expected"))
        done.write.mode("overwrite").parquet(self._folder("complete", batch_id))

    def _sums(self, summed: int, batch_id: int) -> DataFrame:
        """Parts per file up to a batch, from the sums up to another and the counts since."""
        since = self._read("counts").where((F.col("batch") > summed) & (F.col("batch") <= batch_id))
        if summed >= 0:
            since = since.unionByName(self._read("sums").where(F.col("batch") == summed))
        return since.groupBy(self.file).agg(
            F.sum("parts_present").alias("parts_present"), F.max("parts_expected").alias("parts_expected")
        )

    def reconcile(self, parts: DataFrame, part: str, total: str) -> DataFrame:
        """Files whose stored parts are all there but which the stream has not listed."""
        status = upload_completeness(parts, self.file, part, total).where("complete")
        return status.join(self.complete_files().select(self.file), self.file, "left_anti")

    def complete_files(self) -> DataFrame:
        """The files that are complete so far."""
        return self._read("complete").drop("batch")
