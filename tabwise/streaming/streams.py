"""Streaming forms: file intake, masking on the way out, failure alerts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from tabwise.functions.exprs import mask_text, q
from tabwise.operators.clean import Cleaned, clean, row_digests
from tabwise.operators.dates import resolve_dates
from tabwise.operators.profile import ROW_ID, profile_columns, value_counts
from tabwise.operators.sensitive import mask_columns
from tabwise.session import checkpoint_cut, settle


def intake(
    spark: SparkSession, path: str, schema, handle: Callable[[DataFrame, int], None], checkpoint: str,
    fmt: str = "parquet", files_per_batch: int = 1000, **options: str,
) -> StreamingQuery:
    """Process every file that arrives in ``path`` exactly once.

    ``handle(batch, batch_id)`` takes one micro-batch, such as ``Intake.absorb``; the checkpoint
    remembers which files are done, and the trigger stops when nothing is left.
    """
    stream = spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_batch).options(**options).load(path)
    return (
        stream.writeStream.foreachBatch(handle).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


class Intake:
    """A table that arrives in micro-batches, cleaned as one table.

    Every batch leaves its rows and two mergeable states: value counts, which the profile and the date formats are made
    of, and digests of rows, which tell copies in whatever batch they come.  Types, fill values, bounds and removed
    copies are decided from the merged states, so they do not depend on how the files fell into batches.  A batch
    that is repeated after a failure overwrites what it had left.
    """

    def __init__(self, out: str, row_id: str, leave_out: list[str] = ()):
        self.out, self.row_id, self.leave_out = out, row_id, list(leave_out)

    def absorb(self, batch: DataFrame, batch_id: int) -> None:
        table = checkpoint_cut(batch.drop(*self.leave_out).withColumnRenamed(self.row_id, ROW_ID))
        for name, part in (("landed", table), ("counts", value_counts(table)), ("digests", row_digests(table))):
            part.write.mode("overwrite").parquet(f"{self.out}/{name}/_batch={batch_id}")

    def _all(self, spark: SparkSession, name: str) -> DataFrame:
        return spark.read.parquet(f"{self.out}/{name}").drop("_batch")

    def counts(self, spark: SparkSession) -> DataFrame:
        """Value counts of all batches."""
        parts = self._all(spark, "counts")
        return parts.groupBy("column", "value").agg(F.sum("n").alias("n"), F.min("first_row").alias("first_row"))

    def digests(self, spark: SparkSession) -> DataFrame:
        """Row digests of all batches."""
        return self._all(spark, "digests").groupBy("digest").agg(F.sum("n").alias("n"))

    def publish(self, spark: SparkSession) -> Cleaned:
        """Profile and clean what has landed, and write ``profile``, ``cleaned`` and ``removed``."""
        table, counts = self._all(spark, "landed"), checkpoint_cut(self.counts(spark))
        profile, dates = settle(profile_columns(table, counts=counts)), resolve_dates(table, counts=counts)
        cleaned = clean(table, profile, dates, digests=self.digests(spark))
        for name, part in (("profile", profile), ("cleaned", cleaned.table), ("removed", cleaned.removed)):
            part.write.mode("overwrite").parquet(f"{self.out}/{name}")
        return cleaned


def masked_stream(stream: DataFrame, pii: dict[str, str], texts: list[str] = ()) -> DataFrame:
    """Mask personal columns and free texts of a stream; stateless, append mode."""
    out = mask_columns(stream, pii)
    return out.withColumns({c: mask_text(q(c)) for c in texts}) if texts else out


def failure_alerts(metrics: DataFrame) -> DataFrame:
    """Failed runs of a run-metrics stream, as they arrive."""
    return metrics.where(F.col("status") == "failed").select("run_id", "stage", "status", "created_at")


def failure_counts(metrics: DataFrame, window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, failures): failed runs per tumbling window, late rows up to the watermark."""
    return (
        metrics.where(F.col("status") == "failed").withWatermark("created_at", late)
        .groupBy(F.window("created_at", window)).agg(F.count("*").alias("failures"))
    )
