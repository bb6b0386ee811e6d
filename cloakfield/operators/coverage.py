"""Schema discovery, and field coverage with drift, from one scan.

All fields are counted in the same pass, for the whole table and for the time window together, however many they
are: a row gives the numbers of the fields it has, of which a document of a schema of thousands has some tens, and
these are counted by number with partial aggregation.  What is shuffled is a row a field and task.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakfield.functions.values import COMPLETE, DRIFT, NEVER, PARTIAL, SPARSE, UNMEASURABLE, coverage_category, drift, drift_label, percent, percent_label
from cloakfield.sources.catalog import flatten, present_sql

CATEGORIES = (COMPLETE, PARTIAL, SPARSE, NEVER, UNMEASURABLE)


def schema_fields(df: DataFrame, prefix: str = "") -> DataFrame:
    """Rows (field, type) in order of name."""
    rows = sorted((f, t) for f, t in flatten(df.schema) if f.startswith(prefix) and not f.startswith("_"))
    return df.sparkSession.createDataFrame(rows, "field string, type string")


def presence(df: DataFrame, fields: list[str], window: Column | None = None) -> DataFrame:
    """Rows (field, total_docs, window_docs, grand_total, window_total), from one scan."""
    inside = F.lit(True) if window is None else F.coalesce(window, F.lit(False))
    # one SQL text, since thousands of column objects are thousands of calls to the JVM; -1 stands for the document itself
    numbers = F.expr("array(-1" + "".join(f", CASE WHEN {present_sql(df, f)} THEN {i} END" for i, f in enumerate(fields)) + ")")
    counts = df.select(F.explode(F.array_compact(numbers)).alias("n"), inside.alias("inside")).groupBy("n").agg(F.count(F.lit(1)).alias("docs"), F.count_if("inside").alias("window"))
    found = counts.agg(F.map_from_entries(F.collect_list(F.struct("n", F.struct("docs", "window")))).alias("m"))  # a row a field
    names = F.posexplode(F.from_json(F.lit(json.dumps(fields)), "array<string>")).alias("n", "field")
    of = lambda number, what: F.coalesce(F.try_element_at("m", number)[what], F.lit(0).cast("bigint"))
    rows = found.select("m", names)
    return rows.select(
        "field", of(F.col("n"), "docs").alias("total_docs"), of(F.col("n"), "window").alias("window_docs"), of(F.lit(-1), "docs").alias("grand_total"), of(F.lit(-1), "window").alias("window_total")
    )


def populated(df: DataFrame, fields: list[str]) -> DataFrame:
    """Fields with at least one document, most documents first."""
    return presence(df, fields).where("total_docs > 0").select("field", F.col("total_docs").alias("doc_count")).orderBy(F.desc("doc_count"), "field")


def coverage(df: DataFrame, fields: list[str], window: Column, facts: DataFrame | None = None, sample: int = 10, order: str | None = None) -> DataFrame:
    """One row a field: counts, shares, drift and category.

    ``facts`` has (field, declared_in, unindexed_in, doc_values_disabled_in).  A field that no backing table
    indexes cannot be counted; it is looked for in the first ``sample`` documents in order of ``order``
    instead, and its shares are null, never 0.
    """
    rows = presence(df, fields, window)
    if facts is None:
        facts = df.sparkSession.createDataFrame([], "field string, declared_in long, unindexed_in long, doc_values_disabled_in long")
    rows = rows.join(facts, "field", "left")
    unindexed = F.coalesce((F.col("declared_in") > 0) & (F.col("unindexed_in") >= F.col("declared_in")), F.lit(False))
    blind = F.coalesce((F.col("doc_values_disabled_in") > 0) & (F.col("total_docs") == 0) & (F.col("window_docs") == 0), F.lit(False))
    rows = rows.withColumn("measurable", ~unindexed & ~blind)
    rows = rows.withColumn("partially_indexed", F.coalesce((F.col("unindexed_in") > 0) & (F.col("unindexed_in") < F.col("declared_in")), F.lit(False)))
    sampled = presence(df.orderBy(order).limit(sample) if order else df.limit(sample), fields)
    sampled = sampled.select("field", F.col("total_docs").alias("sample_hits"), F.col("grand_total").alias("sample_size"))
    rows = rows.join(sampled, "field")
    seen = lambda c: F.when(F.col("measurable"), F.col(c))
    rows = rows.withColumn("window_pct", percent(seen("window_docs"), F.col("window_total"))).withColumn("total_pct", percent(seen("total_docs"), F.col("grand_total")))
    rows = rows.withColumn("drift", drift(F.col("window_pct"), F.col("total_pct")))
    effective = F.coalesce("window_pct", "total_pct")
    rows = rows.withColumn("effective_pct", effective).withColumn("category", coverage_category(F.col("measurable"), effective))
    return rows.select(
        "field", "window_docs", "window_total", "total_docs", "grand_total", "measurable", "partially_indexed", "window_pct", "total_pct", "drift", "effective_pct", "category",
        percent_label(seen("window_docs"), F.col("window_total")).alias("window_label"), percent_label(seen("total_docs"), F.col("grand_total")).alias("total_label"),
        drift_label(F.col("drift")).alias("drift_label"),
        F.when(~F.col("measurable"), F.col("sample_hits")).alias("sample_hits"), F.when(~F.col("measurable"), F.col("sample_size")).alias("sample_size"),
    )


def sort_coverage(rows: DataFrame) -> DataFrame:
    """What cannot be measured last, then the best covered first."""
    docs = F.when(F.col("window_total") > 0, F.col("window_docs")).otherwise(F.col("total_docs"))
    return rows.orderBy(F.when(F.col("measurable"), 0).otherwise(1), F.coalesce("effective_pct", F.lit(0.0)).desc(), docs.desc(), "field")


def min_docs(rows: DataFrame, n: int) -> tuple[DataFrame, DataFrame]:
    """Rows with n documents or more, and one row (hidden, hidden_empty) about the others; what cannot be measured is never hidden."""
    docs = F.when(F.col("window_total") > 0, F.col("window_docs")).otherwise(F.col("total_docs"))
    keep = ~F.col("measurable") | (docs >= n)
    hidden = rows.where(~keep).agg(F.count(F.lit(1)).alias("hidden"), F.count(F.when(docs == 0, 1)).alias("hidden_empty"))
    return rows.where(keep), hidden


def drifted(rows: DataFrame, n: int = 10) -> DataFrame:
    """The fields whose coverage in the window differs most from the whole."""
    return rows.where(F.abs("drift") > DRIFT).orderBy(F.abs("drift").desc(), "field").limit(n)


def category_counts(rows: DataFrame) -> DataFrame:
    every = rows.sparkSession.range(1).select(F.explode(F.array(*[F.lit(c) for c in CATEGORIES])).alias("category"))
    counts = rows.groupBy("category").agg(F.count(F.lit(1)).alias("fields"))
    return every.join(counts, "category", "left").fillna(0, ["fields"])
