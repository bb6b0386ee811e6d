"""Aggregation trees as flat DataFrames: one frame a path, keys of all levels as columns.

A bucket level is one ``groupBy`` over its parents' keys and its own, with partial aggregation before the
shuffle; metric children are computed in the same pass.  Per-parent top buckets come from a window over
bucket counts, which are small, and the next level reads only the rows of buckets that were returned.
Ties are broken by key.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from datetime import datetime
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakfield.operators.filters import clause, instant
from cloakfield.operators import pipeline
from cloakfield.operators.selection import exact_percentiles
from cloakfield.plans.dsl import METRICS, PARENT, SIBLING, AggNode
from cloakfield.sources.catalog import RequestError, field, field_type, present

UNITS = {"second": "second", "minute": "minute", "hour": "hour", "day": "day", "week": "week", "month": "month", "quarter": "quarter", "year": "year"}
SHORT = {"1s": "second", "1m": "minute", "1h": "hour", "1d": "day", "1w": "week", "1M": "month", "1q": "quarter", "1y": "year"}
FIXED = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400}

PERCENTS = [1, 5, 25, 50, 75, 95, 99]
#: What significant_text counts.
WORD = r"[\p{L}\p{N}_]+"


@dataclass
class AggResult:
    """Buckets of one path; fields names the source field of each key column."""

    node: AggNode
    df: DataFrame
    fields: dict[str, str]
    keys: tuple[str, ...] = ()
    #: doc_count of what is outside the returned buckets, by parent, for terms
    other: DataFrame | None = None
    #: what the level's buckets are shares of
    scope: DataFrame | None = None


def metric_columns(df: DataFrame, node: AggNode) -> dict[str, Column]:
    """Aggregate columns of a metric, by output name."""
    name, kind, p = node.name, node.kind, node.params
    c = field(df, p["field"]) if "field" in p else None
    simple = {"avg": F.avg, "sum": F.sum, "min": F.min, "max": F.max, "value_count": F.count}
    if kind in simple:
        return {name: simple[kind](c)}
    if kind == "cardinality":
        return {name: F.approx_count_distinct(c, p.get("rsd", 0.05)) if p.get("approximate") else F.count_distinct(c)}
    if kind in ("stats", "extended_stats"):
        out = {f"{name}_{k}": f(c) for k, f in (("count", F.count), ("min", F.min), ("max", F.max), ("avg", F.avg), ("sum", F.sum))}
        if kind == "extended_stats":
            sigma = p.get("sigma", 2)
            out |= {
                f"{name}_sum_of_squares": F.sum(c * c), f"{name}_variance": F.var_pop(c), f"{name}_std_deviation": F.stddev_pop(c),
                f"{name}_upper": F.avg(c) + sigma * F.stddev_pop(c), f"{name}_lower": F.avg(c) - sigma * F.stddev_pop(c),
            }
        return out
    if kind == "percentiles":
        at = p.get("percents", PERCENTS)
        # a sketch of bounded size; exact ones are selected apart
        return {} if p.get("exact") else {f"{name}_{q:g}".replace(".", "_"): F.percentile_approx(c, q / 100, p.get("accuracy", 10_000)) for q in at}
    if kind == "percentile_ranks":
        return {f"{name}_{v:g}".replace(".", "_"): 100 * F.avg((c <= v).cast("double")) for v in p["values"]}
    if kind == "matrix_stats":
        cols = {f: field(df, f).cast("double") for f in p["fields"]}
        out = {}
        for f, x in cols.items():
            out |= {f"{name}_{f}_{k}": g(x) for k, g in (("count", F.count), ("mean", F.avg), ("variance", F.var_samp), ("skewness", F.skewness))}
            out[f"{name}_{f}_kurtosis"] = F.kurtosis(x) + 3
        for i, f in enumerate(p["fields"]):
            for g in p["fields"][:i]:
                out |= {f"{name}_{g}_{f}_covariance": F.covar_samp(cols[g], cols[f]), f"{name}_{g}_{f}_correlation": F.corr(cols[g], cols[f])}
        return out
    if kind in ("geo_bounds", "geo_centroid"):
        lat, lon = field(df, p["field"] + ".lat"), field(df, p["field"] + ".lon")
        if kind == "geo_centroid":
            return {f"{name}_lat": F.avg(lat), f"{name}_lon": F.avg(lon), f"{name}_count": F.count(lat)}
        return {f"{name}_top": F.max(lat), f"{name}_left": F.min(lon), f"{name}_bottom": F.min(lat), f"{name}_right": F.max(lon)}
    raise RequestError(f"no such aggregation: {kind}")


def _with_exact(buckets: DataFrame, rows: DataFrame, nodes: tuple[AggNode, ...], level: list[str]) -> DataFrame:
    """``buckets`` with the exact percentiles that ``nodes`` ask for, selected over the ``rows`` of the buckets."""
    for n in nodes:
        if n.kind == "percentiles" and n.params.get("exact"):
            at = {f"{n.name}_{q:g}".replace(".", "_"): q for q in n.params.get("percents", PERCENTS)}
            inside = rows.join(buckets.select(*level), level, "left_semi") if level else rows
            found = exact_percentiles(inside, field(rows, n.params["field"]), at, level)
            buckets = buckets.join(found, level, "left") if level else buckets.join(F.broadcast(found), how="left")  # one row
    return buckets


def _single(df: DataFrame, path: str) -> tuple[Column, bool]:
    """A field's column, and whether a document has several values of it."""
    return field(df, path), isinstance(field_type(df, path), T.ArrayType)


def _with_key(df: DataFrame, name: str, path: str, words: bool = False) -> DataFrame:
    """Adds a key column without nulls; a document with several values, or ``words`` in lower case, is in several buckets, once each."""
    c, many = _single(df, path)
    if words:
        c, many = F.regexp_extract_all(F.lower(F.array_join(c, "\n") if many else c), F.lit(WORD), 0), True
    df = df.withColumn(name, F.explode(F.array_distinct(c)) if many else c)
    return df.where(F.col(name).isNotNull())


def _date_bucket(c: Column, p: dict) -> Column:
    unit = p.get("calendar_interval")
    if unit:
        return F.date_trunc(SHORT.get(unit, UNITS.get(unit, unit)), c)
    length = p["fixed_interval"]
    number = length.rstrip("msdh")
    step = int(number) * FIXED[length[len(number) :]]
    at = F.unix_micros(c.cast("timestamp")) / 1_000_000
    return F.timestamp_seconds(F.floor(at / step) * step).cast("timestamp_ntz")


def _top(counts: DataFrame, by: list[str], order: list[Column], size: int) -> DataFrame:
    if not by:
        return counts.orderBy(*order).limit(size)
    rank = F.row_number().over(Window.partitionBy(*by).orderBy(*order))
    return counts.withColumn("__rank", rank).where(F.col("__rank") <= size).drop("__rank")


def join_keys(left: DataFrame, right: DataFrame, by: list[str], how: str = "inner", small: bool = False) -> DataFrame:
    """Joins on ``by``, and where that is empty one row with one row; ``small`` says that the right side has a proven bound."""
    if not by:
        return left.join(F.broadcast(right), how=how)  # one row
    named = right.select(*[F.col(k).alias(f"__{k}") for k in by], *[c for c in right.columns if c not in by])
    # null-safe, since the test for nulls of a plain join would enter the scan and keep Spark from reading it once
    same = reduce(Column.__and__, [F.col(k).eqNullSafe(F.col(f"__{k}")) for k in by])
    return left.join(F.broadcast(named) if small else named, same, how).drop(*[f"__{k}" for k in by])


def key_columns(df: DataFrame, node: AggNode) -> list[tuple[str, str, Column, bool]]:
    """Name, field, value and whether the value is one of the field's own, for each key of a level whose keys are its fields'."""
    p, name = node.params, node.name
    if node.kind in ("histogram", "date_histogram"):
        c = field(df, p["field"])
        return [(name, p["field"], _date_bucket(c, p) if node.kind == "date_histogram" else F.floor(c / p["interval"]) * F.lit(p["interval"]), False)]
    if node.kind == "multi_terms":
        return [(f"{name}_{i}", t["field"], field(df, t["field"]), True) for i, t in enumerate(p["terms"])]
    if node.kind != "composite":
        return [(name, p["field"], field(df, p["field"]), True)]
    out = []
    for s in p["sources"]:
        k, spec = next(iter(s.items()))
        how, q = next(iter(spec.items()))
        out += [(k, f, c, own) for _, f, c, own in key_columns(df, AggNode(k, how, q))]
    return out


def chosen(counts: DataFrame, node: AggNode, by: list[str], keys: list[str]) -> tuple[DataFrame, DataFrame | None]:
    """The buckets of a level that are returned, by parent, and for terms what the others hold."""
    p, size = node.params, node.params.get("size", 10)
    if node.kind == "rare_terms":
        return counts.where(F.col("doc_count") <= p.get("max_doc_count", 1)), None
    if node.kind in ("histogram", "date_histogram"):
        return counts.where(F.col("doc_count") >= p.get("min_doc_count", 1)), None
    if node.kind == "composite":
        if "after" in p:
            counts = counts.where(F.struct(*keys) > F.struct(*[F.lit(p["after"][k]).cast(counts.schema[k].dataType).alias(k) for k in keys]))
        return _top(counts, by, [F.col(k).asc() for k in keys], size), None
    if node.kind == "multi_terms":
        top = _top(counts, by, [F.col("doc_count").desc(), *[F.col(k).asc() for k in keys]], size)
        return top.withColumn(f"{node.name}_as_string", F.concat_ws("|", *[F.col(k).cast("string") for k in keys])), None
    counts = counts.where(F.col("doc_count") >= p.get("min_doc_count", 1))
    what, way = next(iter(p.get("order", {"_count": "desc"}).items()))
    lead = F.col({"_count": "doc_count", "_key": node.name}.get(what, what))
    top = _top(counts, by, [lead.asc() if way == "asc" else lead.desc(), F.col(node.name).asc()], size)
    all_ = (counts.groupBy(*by) if by else counts.groupBy()).agg(F.sum("doc_count").alias("all"))
    shown = (top.groupBy(*by) if by else top.groupBy()).agg(F.sum("doc_count").alias("shown"))
    rest = F.coalesce("all", F.lit(0)) - F.coalesce("shown", F.lit(0))
    return top, join_keys(all_, shown, by).select(*by, rest.alias("sum_other_doc_count"))


class Aggregator:
    """Compiles the aggregations of one request over one filtered scan."""

    def __init__(self, background: Callable[[], DataFrame] | None = None, as_of: datetime | None = None, id_field: str | None = None, children: dict[str, tuple[DataFrame, str, str]] | None = None):
        self.background, self.as_of, self.id_field, self.children = background, as_of, id_field, children or {}

    def run(self, df: DataFrame, nodes: tuple[AggNode, ...], by: tuple[str, ...] = (), path: str = "", fields: dict[str, str] | None = None) -> dict[str, AggResult]:
        out: dict[str, AggResult] = {}
        metrics = [n for n in nodes if n.kind in METRICS or n.kind == "top_metrics"]
        if metrics and not by:
            sources: dict[str, str] = {}
            columns = {k: v for n in metrics for k, v in self._columns(df, n, sources).items()}
            lead = next((n for n in metrics if n.opaque), metrics[0])
            made = df.agg(*[v.alias(k) for k, v in columns.items()] or [F.count(F.lit(1)).alias("__n")])
            out[path or "metrics"] = AggResult(lead, _with_exact(made, df, tuple(metrics), []).drop("__n"), sources)
        for node in nodes:
            if node.kind in METRICS | PARENT | SIBLING or node.kind == "top_metrics":
                continue
            here = f"{path}>{node.name}" if path else node.name
            out |= self._bucket(df, node, list(by), here, dict(fields or {}))
        for node in nodes:
            if node.kind in SIBLING:
                beside, _, value = node.params["buckets_path"].partition(">")
                found = out.get(f"{path}>{beside}" if path else beside)
                if found is None:
                    raise RequestError(f"{node.name}: no aggregation {beside!r} beside it")
                made = pipeline.over_siblings(found.df, node, list(by), value or "_count")
                out[f"{path}>{node.name}" if path else node.name] = AggResult(node, made, {k: v for k, v in found.fields.items() if k in by}, tuple(by))
        return out

    def _columns(self, df: DataFrame, node: AggNode, sources: dict[str, str]) -> dict[str, Column]:
        """Aggregate columns of a metric; ``sources`` gets the fields of those that are values of documents."""
        if node.kind != "top_metrics":
            return metric_columns(df, node)
        found = pipeline.top_metrics(df, node, self.id_field)
        sources |= {k: f for k, (_, f) in found.items()}
        return {k: c for k, (c, _) in found.items()}

    def _measures(self, df: DataFrame, node: AggNode, sources: dict[str, str]) -> list[Column]:
        columns = {k: v for n in node.children if n.kind in METRICS or n.kind == "top_metrics" for k, v in self._columns(df, n, sources).items()}
        return [F.count(F.lit(1)).alias("doc_count"), *[v.alias(k) for k, v in columns.items()]]

    def _scope(self, df: DataFrame, by: list[str]) -> DataFrame:
        return (df.groupBy(*by) if by else df.groupBy()).agg(F.count(F.lit(1)).alias("scope"))

    def _bucket(self, df: DataFrame, node: AggNode, by: list[str], path: str, fields: dict[str, str]) -> dict[str, AggResult]:
        kind, p, name = node.kind, node.params, node.name
        keys, other, scope = [name], None, self._scope(df, by)
        if kind in ("terms", "rare_terms", "significant_terms", "significant_text"):
            fields[name] = p["field"]
            rows = _with_key(df, name, p["field"], kind == "significant_text")
            counts = rows.groupBy(*by, name).agg(*self._measures(rows, node, fields))
            if kind in ("terms", "rare_terms"):
                top, other = chosen(counts, node, by, keys)
            else:
                top = self._significant(df, counts, by, node)
        elif kind in ("multi_terms", "composite", "histogram", "date_histogram"):
            keys, rows = [], df
            for k, f, value, own in key_columns(df, node):
                rows = _with_key(rows, k, f) if own else rows.withColumn(k, value).where(F.col(k).isNotNull())
                keys.append(k)
                if kind in ("multi_terms", "composite"):
                    fields[k] = f
            top, _ = chosen(rows.groupBy(*by, *keys).agg(*self._measures(rows, node, fields)), node, by, keys)
        elif kind in ("geohash_grid", "geotile_grid"):
            rows = df.withColumn(name, pipeline.cell_key(df, node)).where(F.col(name).isNotNull())
            top = _top(rows.groupBy(*by, name).agg(*self._measures(rows, node, fields)), by, [F.col("doc_count").desc(), F.col(name).asc()], node.params.get("size", 10_000))
        elif kind in ("range", "date_range", "filters", "ip_range"):
            rows, labels = self._labelled(df, node)
            top = rows.groupBy(*by, name).agg(*self._measures(rows, node, fields))
            # a bucket without documents is a bucket, below every parent
            parents = scope.select(*by) if by else df.sparkSession.range(1)
            every = parents.select(*by, F.explode(F.array(*[F.lit(x) for x in labels])).alias(name))
            top = every.join(top, [*by, name], "left").fillna(0, ["doc_count"])
        elif kind in ("filter", "missing"):
            test = clause(df, p, self.as_of) if kind == "filter" else ~present(df, p["field"])
            rows = df.where(test).withColumn(name, F.lit(name))
            top = (rows.groupBy(*by) if by else rows.groupBy()).agg(*self._measures(rows, node, fields))
            top, keys = top.withColumn(name, F.lit(name)), []
        elif kind in ("sampler", "diversified_sampler"):
            rows = self._sample(df, node, by).withColumn(name, F.lit(name))
            top = (rows.groupBy(*by) if by else rows.groupBy()).agg(*self._measures(rows, node, fields))
            top, keys = top.withColumn(name, F.lit(name)), []
        elif kind == "children":
            child, left, right = self.children[p["type"]]
            rows = df.select(*by, F.col(left).alias("__parent")).join(child, F.col("__parent") == F.col(right)).drop("__parent")
            top = (rows.groupBy(*by) if by else rows.groupBy()).agg(*self._measures(rows, node, fields))
            keys = []
        elif kind == "top_hits":
            return {path: AggResult(node, self._top_hits(df, node, by), fields, tuple(by), scope=scope)}
        else:
            raise RequestError(f"no such aggregation: {kind}")
        top = _with_exact(top, rows, node.children, [*by, *keys])
        steps = [c for c in node.children if c.kind in PARENT]
        for step in steps:
            top = pipeline.over_buckets(top, step, by, keys)
        out = {path: AggResult(node, top, fields, (*by, *keys), other, scope)}
        below = tuple(c for c in node.children if c.kind not in METRICS | PARENT and c.kind != "top_metrics")
        if below:
            level = [*by, *keys]
            fewer = any(s.kind in ("bucket_selector", "bucket_sort") for s in steps)
            if fewer and keys or kind in ("terms", "multi_terms", "composite", "rare_terms", "significant_terms", "significant_text"):
                rows = rows.join(top.select(*level), level, "left_semi")
            out |= self.run(rows, below, tuple(level), path, fields)
        return out

    def _labelled(self, df: DataFrame, node: AggNode) -> tuple[DataFrame, list[str]]:
        """Rows once for each range or named filter that they fall in."""
        p, tests = node.params, {}
        if node.kind == "ip_range":
            tests = pipeline.address_tests(df, p)
        elif node.kind == "filters":
            named = p["filters"]
            tests = {str(k): clause(df, q, self.as_of) for k, q in (named.items() if isinstance(named, dict) else enumerate(named))}
        else:
            c = field(df, p["field"])
            put = (lambda v: F.lit(instant(v, self.as_of).isoformat(sep=" ")).cast(field_type(df, p["field"]))) if node.kind == "date_range" else F.lit
            for r in p["ranges"]:
                lo, hi = r.get("from"), r.get("to")
                test = c.isNotNull()
                test = test & (c >= put(lo)) if lo is not None else test
                test = test & (c < put(hi)) if hi is not None else test
                tests[r.get("key", f"{'*' if lo is None else lo}-{'*' if hi is None else hi}")] = test
        hits = F.array_compact(F.array(*[F.when(t, k) for k, t in tests.items()]))
        return df.withColumn(node.name, F.explode(hits)), list(tests)

    def _sample(self, df: DataFrame, node: AggNode, by: list[str]) -> DataFrame:
        """A sample by order of id, so that it is the same each time."""
        n = node.params.get("shard_size", 100)
        order = [F.col(self.id_field)] if self.id_field else [F.lit(0)]
        if node.kind == "diversified_sampler":
            k = field(df, node.params["field"])
            rank = F.row_number().over(Window.partitionBy(*by, k).orderBy(*order))
            df = df.withColumn("__rank", rank).where(F.col("__rank") <= node.params.get("max_docs_per_value", 1)).drop("__rank")
        return _top(df, by, order, n)

    def _top_hits(self, df: DataFrame, node: AggNode, by: list[str]) -> DataFrame:
        p = node.params
        order = []
        for s in p.get("sort", []):
            f, how = next(iter(s.items()))
            way = how.get("order", "asc") if isinstance(how, dict) else how
            order.append(field(df, f).desc() if way == "desc" else field(df, f).asc())
        order += [F.col(self.id_field).asc()] if self.id_field else []
        top = _top(df, by, order or [F.lit(0)], p.get("size", 3))
        source = p.get("_source")
        source = source.get("includes") if isinstance(source, dict) else source
        return top.select(*by, *[field(top, f).alias(f) for f in source]) if source else top

    def _significant(self, df: DataFrame, counts: DataFrame, by: list[str], node: AggNode) -> DataFrame:
        """Terms more frequent here than in the whole table, by (fg - bg) * (fg / bg), the JLH score."""
        back = self.background() if self.background else df
        name, f = node.name, node.params["field"]
        base = _with_key(back, name, f, node.kind == "significant_text").groupBy(name).agg(F.count(F.lit(1)).alias("bg_count"))
        total = back.groupBy().agg(F.count(F.lit(1)).alias("bg_total"))
        scope = self._scope(df, by)
        rows = counts.join(base, name).join(F.broadcast(total))  # one row
        rows = rows.join(scope, by) if by else rows.join(F.broadcast(scope))  # one row
        fg, bg = F.col("doc_count") / F.col("scope"), F.col("bg_count") / F.col("bg_total")
        rows = rows.withColumn("score", (fg - bg) * (fg / bg)).where(F.col("score") > 0).where(F.col("doc_count") >= node.params.get("min_doc_count", 3))
        return _top(rows.drop("bg_total", "scope"), by, [F.col("score").desc(), F.col(name).asc()], node.params.get("size", 10))
