"""What an answer does not show: empty, partial, truncated or misdirected results, as rows (code, subject, detail)."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakfield.operators.aggs import AggResult, join_keys

SCHEMA = "code string, subject string, detail string"


#: Buckets that are a page, a choice or an overlap, so that what they leave out is no gap.
PAGED = ("ip_range", "geohash_grid", "geotile_grid", "composite", "rare_terms", "significant_terms", "significant_text", "filters", "range", "date_range")


def notices_frame(spark: SparkSession, rows: list[tuple[str, str, str]]) -> DataFrame:
    return spark.createDataFrame(rows, SCHEMA)


def partial_coverage(result: AggResult, path: str) -> DataFrame:
    """One row for each parent whose buckets cover fewer documents than are in scope: (agg, parents..., scope, covered, missing, pct)."""
    parents = [k for k in result.keys[:-1] if k in result.scope.columns]
    covered = (result.df.groupBy(*parents) if parents else result.df.groupBy()).agg(F.sum("doc_count").alias("shown"))
    joined = join_keys(result.scope, covered, parents, "left")
    if result.other is not None:
        joined = join_keys(joined, result.other, parents, "left")
    else:
        joined = joined.withColumn("sum_other_doc_count", F.lit(0))
    total = (F.coalesce("shown", F.lit(0)) + F.coalesce("sum_other_doc_count", F.lit(0))).cast("bigint")
    rows = joined.select(F.lit(path).alias("agg"), *parents, F.col("scope"), total.alias("covered"))
    rows = rows.where(F.col("covered") < F.col("scope"))
    return rows.withColumn("missing", F.col("scope") - F.col("covered")).withColumn("pct", F.round(100.0 * F.col("covered") / F.col("scope"), 1))


def empty_aggregations(result: AggResult, path: str) -> DataFrame:
    """One row for each parent with documents in scope and no bucket: (agg, parents..., scope)."""
    parents = [k for k in result.keys[:-1] if k in result.scope.columns]
    n = (result.df.groupBy(*parents) if parents else result.df.groupBy()).agg(F.sum("doc_count").alias("n"))
    joined = join_keys(result.scope, n, parents, "left")
    return joined.where((F.coalesce("n", F.lit(0)) == 0) & (F.col("scope") > 0)).select(F.lit(path).alias("agg"), *parents, "scope")


def aggregation_notices(results: dict[str, AggResult], shadowed: dict[str, str] | None = None) -> DataFrame | None:
    """The notices of all bucket levels, as one frame; ``shadowed`` maps namespaces that are mapped and never filled to those that are."""
    frames = []
    for path, r in results.items():
        if r.scope is None or r.node.kind in ("top_hits", "filter", "missing", "sampler", "diversified_sampler", "children"):
            continue
        e = empty_aggregations(r, path)
        source = r.fields.get(r.keys[-1], "") if r.keys else ""
        hint = next((f"; {source} is mapped and never filled, use {new}{source[len(old) :]}" for old, new in (shadowed or {}).items() if source.startswith(old)), "")
        frames.append(e.select(F.lit("[EMPTY AGGREGATION]").alias("code"), F.col("agg").alias("subject"), F.concat(F.format_string("no bucket although %d documents are in scope", "scope"), F.lit(hint)).alias("detail")))
        if r.node.kind in PAGED:
            continue
        p = partial_coverage(r, path)
        text = F.format_string("buckets cover %d of %d documents (%.1f%%); %d lack the field", "covered", "scope", "pct", "missing")
        frames.append(p.where("covered > 0").select(F.lit("[PARTIAL AGGREGATION COVERAGE]").alias("code"), F.col("agg").alias("subject"), text.alias("detail")))
    return reduce(DataFrame.unionByName, frames) if frames else None


def total_hits(df: DataFrame, exact: bool, cap: int = 10_000) -> DataFrame:
    """One row (value, relation): an exact count, or one that is cut at the cap.

    Both count all rows: a task sends one number, while a limit would send up to a cap of rows from every task to one.
    """
    n = F.count(F.lit(1))
    if exact:
        return df.agg(n.alias("value")).select("value", F.lit("eq").alias("relation"))
    return df.agg(n.alias("n")).select(F.least("n", F.lit(cap)).alias("value"), F.when(F.col("n") > cap, "gte").otherwise("eq").alias("relation"))


def shard_failures(lost: dict[str, tuple[list[str], int]]) -> list[tuple[str, str, str]]:
    """A notice for each table with files that could not be read: what is counted there is a lower bound."""
    return [("[SHARD FAILURES]", name, f"{len(files)} of {n} files could not be read; counts are lower bounds") for name, (files, n) in lost.items() if files]


def safety_banner(masking_active: bool, has_fields: bool, gate: str, index: str, raw_tables: list[str], external: bool = False) -> list[tuple[str, str, str]]:
    """Conditions that a reader must know before trusting a masked answer."""
    out = []
    if not masking_active or not has_fields:
        out.append(("[MASKING OFF]", index, "values are shown as they are stored"))
    if external and gate == "off":
        out.append(("[GATE OFF]", index, "parts that cannot be masked by field are let through"))
    if any(t in raw_tables for t in index.split(",")):
        out.append(("[RAW STREAM]", index, "this table holds unmasked events"))
    return out
