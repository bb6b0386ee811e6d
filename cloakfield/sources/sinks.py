"""Text and JSON sinks: an audit log of what was shown, its export, and reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CLIP = 2000
#: A log line starts with a time, a tenant and one of these words.
STATES = ("MASKED", "BLOCKED", "RAW")
HEADER = r"^\S+ \S+ RAW(?: |$)"


def log_lines(answers: DataFrame, time: str, tenant: str, state: str, text: str, clip: int = CLIP) -> DataFrame:
    """One line an answer: header and clipped text, with line breaks as spaces so that a line stays a line."""
    body = F.substring(F.regexp_replace(text, r"[\r\n]+", " "), 1, clip)
    stamp = F.date_format(time, "yyyy-MM-dd'T'HH:mm:ss")
    return answers.where(F.col(state).isin(*STATES)).select(F.concat_ws(" ", stamp, tenant, state, body).alias("value"))


def append_log(lines: DataFrame, folder: str, keep_raw: bool = False) -> None:
    """Appends to the log; raw answers only where that is asked for."""
    (lines if keep_raw else lines.where(~F.col("value").rlike(HEADER))).write.mode("append").text(folder)


def export_log(spark: SparkSession, folder: str) -> DataFrame:
    """The log without raw lines, told by their header and not by their text."""
    return spark.read.text(folder).where(~F.col("value").rlike(HEADER))


def write_report(report: DataFrame, path: str) -> None:
    """A compliance report as JSON lines."""
    report.write.mode("overwrite").json(path)
