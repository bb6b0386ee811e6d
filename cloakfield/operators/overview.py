"""Findings overview: the whole severity scale with its zeros, agents, titles and categories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Severities, most severe first, and how many rows a top list may have.
SEVERITIES = ("critical", "high", "medium", "low", "informational")
TOP_MAX = 1000


def check_top(n: int) -> int:
    if isinstance(n, bool) or not isinstance(n, int) or not 0 < n <= TOP_MAX:
        raise ValueError(f"a top list has 1 to {TOP_MAX} rows")
    return n


def _scale(df: DataFrame) -> DataFrame:
    entries = F.array(*[F.struct(F.lit(s).alias("level"), F.lit(i).alias("rank")) for i, s in enumerate(SEVERITIES)])
    return df.sparkSession.range(1).select(F.explode(entries).alias("x")).select("x.*")


def severity(findings: DataFrame) -> DataFrame:
    """Rows (level, rank, doc_count) for every level of the scale; a level that did not occur is a measured 0."""
    observed = findings.groupBy("level").agg(F.count(F.lit(1)).alias("doc_count"))
    return _scale(findings).join(observed, "level", "left").select("level", "rank", F.coalesce("doc_count", F.lit(0)).alias("doc_count"))


def unknown_levels(findings: DataFrame) -> DataFrame:
    """Values that are not on the scale, compared as they are spelled, most frequent first."""
    observed = findings.where(F.col("level").isNotNull()).groupBy("level").agg(F.count(F.lit(1)).alias("doc_count"))
    return observed.join(F.broadcast(_scale(findings)), "level", "left_anti").orderBy(F.desc("doc_count"), "level")


def top(findings: DataFrame, column: str, n: int) -> DataFrame:
    counts = findings.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("doc_count"))
    return counts.orderBy(F.desc("doc_count"), column).limit(check_top(n))


def cross_tab(findings: DataFrame, n: int) -> DataFrame:
    """The top agents with a column for each level; levels off the scale are in ``other``."""
    agents = top(findings, "agent", n).select("agent", F.col("doc_count").alias("total"))
    counts = findings.where(F.col("agent").isNotNull()).groupBy("agent").agg(
        *[F.count(F.when(F.col("level") == s, 1)).alias(s) for s in SEVERITIES],
        F.count(F.when(~F.coalesce(F.col("level").isin(*SEVERITIES), F.lit(False)), 1)).alias("other"),
    )
    return agents.join(counts, "agent")


def categories(findings: DataFrame, known: tuple[str, ...] = ()) -> DataFrame:
    """Counts and shares of each category; a known one that did not occur is 0."""
    counts = findings.where(F.col("category").isNotNull()).groupBy("category").agg(F.count(F.lit(1)).alias("doc_count"))
    if known:
        every = findings.sparkSession.range(1).select(F.explode(F.array(*[F.lit(k) for k in known])).alias("category"))
        counts = every.join(counts, "category", "full").fillna(0, ["doc_count"])
    return counts.withColumn("pct", F.round(100.0 * F.col("doc_count") / F.sum("doc_count").over(Window.partitionBy()), 6))
