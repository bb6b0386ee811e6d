"""The masked copy as a stream: late data up to the overlap, each id once, and no commit when a batch fails."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakfield.operators.sync import SyncError, append_new, one_each, split_quarantine


def masked_stream(raw: DataFrame, mask, masked_path: str, quarantine_path: str, checkpoint: str, key: str, time: str, overlap: str = "1 hour", origin: str = "raw"):
    """Starts the copy for what is there now and returns the query.

    A batch that holds rows which cannot be masked writes them to quarantine and then raises, so its
    offsets are not committed; the retry adds nothing twice, since writes skip ids that are there.  Targets are
    partitioned by day and a batch is compared with its own days alone.
    """
    stamped = raw.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", overlap)
    once = stamped.dropDuplicatesWithinWatermark([key]).drop("__time")

    def write(batch: DataFrame, _: int) -> None:
        first, last, n = batch.agg(F.min(time), F.max(time), F.count(F.lit(1))).first()
        if not n:
            return
        good, bad = split_quarantine(mask(batch), "masking_failure", origin)
        written = append_new(one_each(bad, key, time), quarantine_path, key, time, first, last)
        if written["old"] + written["new"]:
            raise SyncError("documents of this batch are in quarantine")
        append_new(one_each(good, key, time), masked_path, key, time, first, last)

    return once.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(events: DataFrame, time: str, key: str, window: str = "1 hour", slide: str | None = None, late: str = "1 hour") -> DataFrame:
    """Counts by event-time window and key; an addition, since the batch engine has histograms instead."""
    stamped = events.withColumn("__time", F.col(time).cast("timestamp")).withWatermark("__time", late)
    w = F.window("__time", window, slide) if slide else F.window("__time", window)
    return stamped.groupBy(w, key).agg(F.count(F.lit(1)).alias("doc_count"))
