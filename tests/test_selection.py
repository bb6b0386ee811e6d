"""Exact percentiles against sorted values: ties, few values, nulls, groups, and passes that narrow."""

import random

import pytest
from pyspark.sql import functions as F

from cloakfield.engine import Engine
from cloakfield.operators.selection import exact_percentiles
from cloakfield.sources.catalog import Catalog

PERCENTS = {"lo": 0, "p1": 1, "q": 25, "mid": 50, "p99": 99.9, "hi": 100}


def by_hand(values, q):
    values = sorted(v for v in values if v is not None)
    if not values:
        return None
    at = (len(values) - 1) * (q / 100)
    a = values[int(at)]
    return a + (values[min(int(at) + 1, len(values) - 1)] - a) * (at - int(at))


def check(rows, groups):
    for r in rows:
        for name, q in PERCENTS.items():
            assert r[name] == pytest.approx(by_hand(groups[r["g"]], q), abs=1e-9), (r["g"], name)


@pytest.mark.parametrize("enough, grid", [(1_000_000, 512), (20, 16)])
def test_groups(spark, enough, grid):
    rng = random.Random(4)
    groups = {
        "normal": [rng.gauss(0, 1e6) for _ in range(3000)], "ties": [float(rng.randrange(3)) for _ in range(2000)], "one": [7.5], "two": [1.0, 2.0], "same": [4.0] * 500,
        "wide": [10.0 ** rng.randrange(-300, 300) * rng.choice([-1, 1]) for _ in range(1500)], "nulls": [None, 3.0, None], None: [float(i) for i in range(50)],
    }
    df = spark.createDataFrame([(g, v) for g, vs in groups.items() for v in vs], "g string, v double").withColumn("g", F.coalesce("g", F.lit("none"))).repartition(3)
    groups["none"] = groups.pop(None)
    rows = exact_percentiles(df, F.col("v"), PERCENTS, ["g"], enough, grid).collect()
    assert {r["g"] for r in rows} == set(groups)
    for r in rows:
        for name, q in PERCENTS.items():
            assert r[name] == pytest.approx(by_hand(groups[r["g"]], q), rel=1e-9, abs=1e-9), (r["g"], name)


def test_whole_tables_and_empty_ones(spark):
    df = spark.range(1001).select((F.col("id") * 2).alias("v"))
    r = exact_percentiles(df, F.col("v"), PERCENTS, enough=10, grid=8).first()
    assert [r[k] for k in PERCENTS] == pytest.approx([0, 20, 500, 1000, 1998, 2000])
    assert [r[k] for k in PERCENTS for r in exact_percentiles(df.limit(0), F.col("v"), PERCENTS).collect()] == [None] * 6


def test_below_buckets_and_beside_other_metrics(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], float(i)) for i in range(11)], "id int, k string, v double")
    exact = {"percentiles": {"field": "v", "percents": [50], "exact": True}}
    e = Engine(spark, Catalog({"t": df}))
    out = e.search("t", {"size": 0, "aggs": {"k": {"terms": {"field": "k"}, "aggs": {"p": exact, "m": {"max": {"field": "v"}}}}, "p": exact, "n": {"value_count": {"field": "v"}}}}).aggs
    assert {tuple(r) for r in out["k"].df.select("k", "doc_count", "m", "p_50").collect()} == {("a", 6, 10.0, 5.0), ("b", 5, 9.0, 5.0)}
    assert out["metrics"].df.first().asDict() == {"n": 11, "p_50": 5.0}
