"""Nested buckets in one scan: grouping sets over the key paths of a tree.

A row is counted once for each path of keys that it has, by one aggregation with partial aggregation before the
shuffle.  Its result holds the buckets of all levels with their metrics, and with them what the levels are
shares of: the buckets of a level are the scope of the level below.  Which buckets are returned is decided on
these counts from the root down, and the result is read as often as a frame needs it while the table is scanned
once a job, since Spark shares the shuffle that all the readers have in common.

This holds for levels whose keys are single values and for metrics whose state has a fixed size.  What else a
request asks for is computed level by level.  A metric is computed on the rows of all paths, and a level is
counted below all parents, also those that are not returned: more groups in the shuffle against fewer scans.
"""

from __future__ import annotations

from collections import Counter
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cloakfield.operators.aggs import Aggregator, AggResult, chosen, join_keys, key_columns, metric_columns
from cloakfield.plans.dsl import METRICS, SIBLING, AggNode
from cloakfield.sources.catalog import field_type

LEVELS = frozenset("terms rare_terms multi_terms composite histogram date_histogram".split())
#: Metrics whose state does not grow with the values.
FIXED = METRICS - {"cardinality", "percentiles"}
#: Parents up to this number are broadcast, where the sizes of the request prove it.
SMALL = 10_000


@dataclass
class Level:
    """A bucket level of a tree; ``keys`` are its own, as (name, field, value), and ``above`` is the number of its parent."""

    node: AggNode
    path: str
    above: int
    keys: list[tuple[str, str, Column]]


def _fits(df: DataFrame, node: AggNode, names: tuple[str, ...] = ()) -> bool:
    if node.kind not in LEVELS:
        return False
    keys = key_columns(df, node)
    names += tuple(k for k, *_ in keys)
    if len(set(names)) < len(names) or any(isinstance(field_type(df, f), T.ArrayType) for _, f, *_ in keys):
        return False
    return all(c.kind in FIXED or _fits(df, c, names) for c in node.children)


def _levels(df: DataFrame, root: AggNode) -> list[Level]:
    out: list[Level] = []

    def visit(node: AggNode, above: int, path: str) -> None:
        path = f"{path}>{node.name}" if path else node.name
        out.append(Level(node, path, above, [(k, f, c) for k, f, c, _ in key_columns(df, node)]))
        number = len(out)
        for c in node.children:
            if c.kind in LEVELS:
                visit(c, number, path)

    visit(root, 0, "")
    return out


def _line(levels: list[Level], number: int) -> list[int]:
    """Numbers of the levels from the root to this one; the whole table has the number 0."""
    return [*_line(levels, levels[number - 1].above), number] if number else []


def counted_paths(df: DataFrame, levels: list[Level]) -> DataFrame:
    """Rows (level, keys by number, measures), one for each path of keys; level 0 counts the table."""
    lines = {n: _line(levels, n) for n in range(1, len(levels) + 1)}
    values = {(n, i): c for n, level in enumerate(levels, 1) for i, (_, _, c) in enumerate(level.keys)}
    has = {n: reduce(Column.__and__, [c.isNotNull() for (m, _), c in values.items() if m in line]) for n, line in lines.items()}
    rows = df.withColumn("__level", F.explode(F.array_compact(F.array(F.lit(0), *[F.when(test, F.lit(n)) for n, test in has.items()]))))
    keys = [F.when(F.col("__level").isin([k for k, line in lines.items() if n in line]), c).alias(f"__key_{n}_{i}") for (n, i), c in values.items()]
    measures = [F.count(F.lit(1)).alias("doc_count")]
    for n, level in enumerate(levels, 1):
        measures += [c.alias(f"{n}_{k}") for m in level.node.children if m.kind in FIXED for k, c in metric_columns(df, m).items()]
    # the level as an aggregate and the measures as one value: so each reader asks for the same aggregation, which then runs once
    return rows.groupBy("__level", *keys).agg(F.max("__level").alias("level"), F.struct(*measures).alias("measures")).drop("__level")


def _bound(levels: list[Level], number: int) -> int | None:
    """The most buckets that a level returns, if its request bounds them."""
    line = [levels[n - 1].node for n in _line(levels, number)]
    if any(n.kind not in ("terms", "multi_terms", "composite") for n in line):
        return None
    return reduce(int.__mul__, [n.params.get("size", 10) for n in line], 1)


def _narrows(node: AggNode) -> bool:
    """Whether a level leaves out buckets."""
    return node.kind not in ("histogram", "date_histogram") or node.params.get("min_doc_count", 1) > 1


def bucket_tree(df: DataFrame, root: AggNode) -> dict[str, AggResult]:
    """Results of all levels of a tree, by path."""
    levels = _levels(df, root)
    counted = counted_paths(df, levels)
    out: dict[int, AggResult] = {}
    for number, level in enumerate(levels, 1):
        line = _line(levels, number)
        above, own = out.get(level.above), [k for k, *_ in level.keys]
        by = list(above.keys) if above else []
        names = [F.col(f"__key_{n}_{i}").alias(k) for n in line for i, (k, *_) in enumerate(levels[n - 1].keys)]
        metrics = [k for m in level.node.children if m.kind in FIXED for k in metric_columns(df, m)]
        counts = counted.where(F.col("level") == number).select(*names, F.col("measures.doc_count"), *[F.col(f"measures.`{number}_{k}`").alias(k) for k in metrics])
        if above and any(_narrows(levels[n - 1].node) for n in line[:-1]):
            bound = _bound(levels, level.above)
            counts = join_keys(counts, above.df.select(*by), by, "left_semi", bound is not None and bound <= SMALL)
        top, other = chosen(counts, level.node, by, own)
        if above:
            scope = above.df.select(*by, F.col("doc_count").alias("scope"))
        else:
            scope = counted.where("level = 0").groupBy().agg(F.coalesce(F.sum("measures.doc_count"), F.lit(0)).alias("scope"))
        shown = {k: f for n in line if levels[n - 1].node.kind not in ("histogram", "date_histogram") for k, f, _ in levels[n - 1].keys}
        out[number] = AggResult(level.node, top, shown, (*by, *own), other, scope)
    return {levels[n - 1].path: r for n, r in out.items()}


def aggregate(aggregator: Aggregator, df: DataFrame, nodes: tuple[AggNode, ...]) -> dict[str, AggResult]:
    """All aggregations of a request: nested levels that fit by :func:`bucket_tree`, the others by ``aggregator``."""
    beside = {n.params["buckets_path"].partition(">")[0] for n in nodes if n.kind in SIBLING}
    twice = {k for k, n in Counter(n.name for n in nodes).items() if n > 1}
    trees = [n for n in nodes if n.name not in beside | twice and any(c.kind in LEVELS for c in n.children) and _fits(df, n)]
    out = aggregator.run(df, tuple(n for n in nodes if n not in trees))
    for root in trees:
        out |= bucket_tree(df, root)
    return out
