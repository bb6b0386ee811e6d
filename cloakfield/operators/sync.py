"""Incremental copy of a raw stream to a masked one, with quarantine, reconciliation and retention.

A run takes the window from the checkpoint less an overlap up to ``as_of``, masks it, sends what cannot be
masked to quarantine as it is, and appends what is new.  It fails closed: a document in quarantine, an
unreadable count or a mismatch leaves the checkpoint where it was.

Targets are partitioned by the day of a document's time (``DAY``), which never changes: a run compares ids with the
days of its window alone, retention drops whole days, and a deletion writes again only the days that it touches.  Rows
are counted by the passes that write them.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import dataclass
from datetime import datetime, timedelta

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from cloakfield.sources.policy import Policy, drift

#: The partition column of masked and quarantined rows.
DAY = "sync_day"
OVERLAP, FIRST_LOOKBACK = timedelta(hours=1), timedelta(hours=24)


class SyncError(RuntimeError):
    """A run that must not move the checkpoint."""


@dataclass(frozen=True)
class Window:
    start: datetime
    end: datetime


def next_window(checkpoint: datetime | None, as_of: datetime, overlap: timedelta = OVERLAP, lookback: timedelta = FIRST_LOOKBACK) -> Window:
    return Window(as_of - lookback if checkpoint is None else checkpoint - overlap, as_of)


def preflight(wanted: Policy, deployed: Policy | None) -> None:
    """Refuses a run under another policy than the deployed one: its tokens would not fit the rows that are there."""
    if deployed is None:
        raise SyncError("no policy is deployed")
    found = [f"{k}: {', '.join(v)}" for k, v in drift(wanted, deployed).items() if v]
    if found or wanted.fingerprint() != deployed.fingerprint():
        raise SyncError(f"the deployed policy differs ({'; '.join(found) or 'settings'})")


def leftovers(masked: DataFrame) -> DataFrame:
    """One row (leftover): rows of the masked table that are flagged as failed and belong into quarantine."""
    return masked.agg(F.count(F.when(F.coalesce("masking_error", F.lit(False)), 1)).alias("leftover"))


def window_rows(raw: DataFrame, time: str, window: Window) -> DataFrame:
    """Rows of the window; the bounds are literals of the column's type and reach the scan."""
    kind = raw.schema[time].dataType
    lo, hi = (F.lit(x.isoformat(sep=" ")).cast(kind) for x in (window.start, window.end))
    return raw.where((F.col(time) >= lo) & (F.col(time) <= hi))


def new_only(rows: DataFrame, existing: DataFrame, key: str) -> DataFrame:
    """Rows whose id the target does not have: create, never overwrite."""
    return rows.join(existing.select(key), key, "left_anti").select(*rows.columns)


def split_quarantine(rows: DataFrame, error: str, origin: str) -> tuple[DataFrame, DataFrame]:
    """Masked rows, and rows that failed: kept as they are, with where they came from and why."""
    good = rows.where(F.col(error).isNull()).drop(error)
    bad = rows.where(F.col(error).isNotNull()).withColumns(
        {"masking_error": F.lit(True), "quarantine_origin": F.lit(origin), "quarantine_reason": F.when(F.col(error) == "", "unknown").otherwise(F.col(error))}
    )
    return good, bad.drop(error)


def reconcile(source: DataFrame, masked: DataFrame, quarantine: DataFrame, key: str) -> DataFrame:
    """One row (source, masked, quarantined, missing): missing counts source ids that neither target has."""
    done = masked.select(key).unionByName(quarantine.select(key)).distinct()
    one = lambda df, name: df.agg(F.count(F.lit(1)).alias(name))
    missing = one(source.select(key).join(done, key, "left_anti"), "missing")
    out = one(source, "source").join(F.broadcast(one(masked, "masked")))  # one row each
    return out.join(F.broadcast(one(quarantine, "quarantined"))).join(F.broadcast(missing))


def retain(rows: DataFrame, time: str, as_of: datetime, days: int) -> DataFrame:
    """What a retention of ``days`` keeps."""
    limit = F.lit((as_of - timedelta(days=days)).isoformat(sep=" ")).cast(rows.schema[time].dataType)
    return rows.where(F.col(time) >= limit)


class Checkpoints:
    """High-water marks by tenant: one small JSON row each in a folder that Spark can reach."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder.rstrip("/")

    def read(self, tenant: str) -> datetime | None:
        """The mark, or None where there is none; one that cannot be read stops the run, which would skip what lies before the first lookback."""
        try:
            row = self.spark.read.text(f"{self.folder}/{tenant}").first()
        except Exception as e:
            if "PATH_NOT_FOUND" in str(e):
                return None
            raise
        try:
            return datetime.fromisoformat(json.loads(row["value"])["checkpoint"])
        except (TypeError, ValueError, KeyError) as e:
            raise SyncError(f"the mark of {tenant} is damaged") from e

    def write(self, tenant: str, mark: datetime) -> None:
        row = json.dumps({"tenant": tenant, "checkpoint": mark.isoformat()})
        self.spark.createDataFrame([(row,)], "value string").coalesce(1).write.mode("overwrite").text(f"{self.folder}/{tenant}")


def _table(spark: SparkSession, path: str, like: DataFrame | None = None) -> DataFrame | None:
    try:
        return spark.read.parquet(path)
    except Exception as e:
        if "PATH_NOT_FOUND" in str(e) or "UNABLE_TO_INFER" in str(e):
            return like.limit(0) if like is not None else None
        raise


def in_days(table: DataFrame, start: datetime, end: datetime) -> DataFrame:
    """The rows of a target in the days from ``start`` to ``end``; a filter on the partition, so other days are not read."""
    return table.where(F.col(DAY).between(F.lit(start.date()), F.lit(end.date()))) if DAY in table.columns else table


def one_each(rows: DataFrame, key: str, time: str) -> DataFrame:
    """One row for each id: the earliest, and of those the one with the least hash, so that reruns agree."""
    first = F.min_by(F.struct(*rows.columns), F.struct(F.col(time), F.xxhash64(*rows.columns)))
    return rows.groupBy(key).agg(first.alias("__row")).select("__row.*")


def append_new(rows: DataFrame, path: str, key: str, time: str, start: datetime, end: datetime) -> dict[str, int]:
    """Appends the rows whose id the target lacks in those days; how many were there, and how many are new, as the write saw them."""
    there = in_days(_table(rows.sparkSession, path, rows), start, end).select(F.col(key).alias("__key"), F.lit(True).alias("__there")).distinct()
    seen = Observation()
    marked = rows.join(there, F.col(key) == F.col("__key"), "left").observe(seen, F.count_if("__there").alias("old"), F.count_if(F.col("__there").isNull()).alias("new"))
    new = marked.where("__there IS NULL").select(*rows.columns, F.to_date(time).alias(DAY))
    new.write.mode("append").partitionBy(DAY).parquet(path)
    return dict(seen.get)


def sync(raw: DataFrame, mask, tenant: str, marks: Checkpoints, masked_path: str, quarantine_path: str, key: str, time: str, as_of: datetime, origin: str = "raw", strict: bool = True) -> dict:
    """One run.  ``mask`` maps rows to masked rows with a column ``masking_failure``, null where masking worked.

    The window is masked once, into a table beside the target that goes when the run ends; both targets are written
    from it.  Gives rows of the window (source, without_id), ids in each target (masked, quarantined), of those the new
    ones (masked_new, quarantined_new), missing ids and the window.
    """
    spark = raw.sparkSession
    window = next_window(marks.read(tenant), as_of)
    staged = f"{masked_path.rstrip('/')}-run-{uuid.uuid4().hex}"
    seen = Observation()
    source = window_rows(raw, time, window).observe(seen, F.count(F.lit(1)).alias("source"), F.count_if(F.col(key).isNull()).alias("without_id"))
    try:
        mask(source).write.parquet(staged)
        counts = dict(seen.get)
        if counts["without_id"]:
            raise SyncError(f"{counts['without_id']} documents of the window have no id; nothing is written and the checkpoint stays")
        rows = spark.read.parquet(staged)
        for part, path, name in zip(split_quarantine(rows, "masking_failure", origin), (masked_path, quarantine_path), ("masked", "quarantined")):
            written = append_new(one_each(part, key, time), path, key, time, window.start, window.end)
            counts |= {name: written["old"] + written["new"], f"{name}_new": written["new"]}
        if strict:
            done = [in_days(_table(spark, path, rows), window.start, window.end).select(key) for path in (masked_path, quarantine_path)]
            counts["missing"] = rows.select(key).join(done[0].unionByName(done[1]), key, "left_anti").count()
            if counts["missing"]:
                raise SyncError(f"{counts['missing']} documents of the window are in neither target; the checkpoint stays")
    finally:
        _delete(spark, staged)
    if counts["quarantined"]:
        raise SyncError(f"{counts['quarantined']} documents of the window are in quarantine; the checkpoint stays")
    marks.write(tenant, window.end)
    return counts | {"start": window.start, "end": window.end}


def migrate(masked_path: str, quarantine_path: str, spark: SparkSession, key: str) -> int:
    """Moves rows that are flagged as failed out of the masked table; refuses to delete unless all were copied."""
    masked = spark.read.parquet(masked_path)
    flagged = masked.where("masking_error")
    n = flagged.count()
    if not n:
        return 0
    target = _table(spark, quarantine_path, flagged)
    added = new_only(flagged, target, key).write.mode("append")
    (added.partitionBy(DAY) if DAY in flagged.columns else added).parquet(quarantine_path)
    copied = spark.read.parquet(quarantine_path).join(flagged.select(key), key, "left_semi").count()
    if copied < n:
        raise SyncError(f"{n - copied} flagged rows were not copied; nothing is deleted")
    delete_where(spark, masked_path, F.col("masking_error"))
    return n


def _fs(spark: SparkSession, path: str):
    """A path and its file system."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    return place, place.getFileSystem(spark._jsc.hadoopConfiguration())


def _delete(spark: SparkSession, path: str) -> None:
    place, fs = _fs(spark, path)
    fs.delete(place, True)


def _swap(spark: SparkSession, new: str | None, path: str) -> None:
    """Puts ``new`` in the place of ``path`` by renaming; the old one goes last, so the rows are there whatever fails."""
    place, fs = _fs(spark, path)
    old = f"{path}-old"
    for a, b in ((path, old), *([(new, path)] if new else [])):
        if not fs.rename(_fs(spark, a)[0], _fs(spark, b)[0]):
            raise OSError(f"{a} was not renamed to {b}")
    fs.delete(_fs(spark, old)[0], True)


def days_of(spark: SparkSession, path: str) -> dict[str, str]:
    """The days of a target and their folders; a listing, no read."""
    place, fs = _fs(spark, path)
    if not fs.exists(place):
        return {}
    names = [f.getPath().getName() for f in fs.listStatus(place)]
    return {n.removeprefix(f"{DAY}="): f"{path.rstrip('/')}/{n}" for n in sorted(names) if n.startswith(f"{DAY}=") and not n.endswith("-old")}


def drop_days(spark: SparkSession, path: str, as_of: datetime, days: int) -> list[str]:
    """Retention by partition: deletes the folders of days that end before the last ``days`` begin, and names them."""
    limit = (as_of - timedelta(days=days)).date().isoformat()
    gone = [day for day, folder in days_of(spark, path).items() if day < limit]
    for day in gone:
        _delete(spark, f"{path.rstrip('/')}/{DAY}={day}")
    spark.catalog.refreshByPath(path)
    return gone


def delete_where(spark: SparkSession, path: str, test: Column) -> None:
    """Deletes the rows of a table that pass ``test``; null does not pass.

    Of a table by days only the days that hold such rows are read and written again, one folder each; another is written
    again whole.  What stays is written beside the table, and folders are swapped by renaming.
    """
    path = path.rstrip("/")
    table, kept = spark.read.parquet(path), f"{path}-kept-{uuid.uuid4().hex}"
    goes = F.coalesce(test, F.lit(False))
    if DAY not in table.columns:
        table.where(~goes).write.parquet(kept)
        _swap(spark, kept, path)
        spark.catalog.refreshByPath(path)
        return
    touched = [r[0] for r in table.where(goes).select(DAY).distinct().collect()]  # a row a day
    if not touched:
        return
    table.where(F.col(DAY).isin(*touched)).where(~goes).write.partitionBy(DAY).parquet(kept)
    for day in touched:
        new = f"{kept}/{DAY}={day.isoformat()}"
        place, fs = _fs(spark, new)
        _swap(spark, new if fs.exists(place) else None, f"{path}/{DAY}={day.isoformat()}")
    _delete(spark, kept)
    spark.catalog.refreshByPath(path)
