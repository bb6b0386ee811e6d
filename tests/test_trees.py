"""Bucket trees in one scan: equal to the levels one by one, and one scan in the plan that runs."""

import random
from datetime import datetime, timedelta

import pytest

from cloakfield.engine import Engine
from cloakfield.operators.aggs import Aggregator
from cloakfield.operators.trees import aggregate, bucket_tree
from cloakfield.plans.dsl import parse_body
from cloakfield.sources.catalog import Catalog

METRICS = {"most": {"max": {"field": "n"}}, "total": {"sum": {"field": "n"}}, "all": {"stats": {"field": "n"}}}
TREES = {
    "three terms": {"a": {"terms": {"field": "a", "size": 3}, "aggs": METRICS | {"b": {"terms": {"field": "b", "size": 2}, "aggs": {"c": {"terms": {"field": "n", "size": 2}, "aggs": METRICS}}}}}},
    "two branches": {"a": {"terms": {"field": "a"}, "aggs": {"b": {"terms": {"field": "b", "order": {"total": "asc"}, "size": 2}, "aggs": METRICS}, "n": {"histogram": {"field": "n", "interval": 3, "min_doc_count": 2}}}}},
    "days above": {"d": {"date_histogram": {"field": "t", "calendar_interval": "day"}, "aggs": {"h": {"date_histogram": {"field": "t", "fixed_interval": "6h"}, "aggs": {"b": {"terms": {"field": "b", "size": 1}}}}}}},
    "pairs above": {"ab": {"multi_terms": {"terms": [{"field": "a"}, {"field": "b"}], "size": 4}, "aggs": {"r": {"rare_terms": {"field": "n", "max_doc_count": 2}, "aggs": {"m": {"min": {"field": "n"}}}}}}},
    "pages": {"p": {"composite": {"sources": [{"x": {"terms": {"field": "a"}}}, {"y": {"histogram": {"field": "n", "interval": 5}}}], "size": 5, "after": {"x": "a0", "y": 5}}, "aggs": {"b": {"terms": {"field": "b", "min_doc_count": 2}}}}},
    "absent field": {"a": {"terms": {"field": "a"}, "aggs": {"z": {"terms": {"field": "no.such"}}}}},
    "rare above": {"r": {"rare_terms": {"field": "n", "max_doc_count": 9}, "aggs": {"a": {"terms": {"field": "a", "size": 1}, "aggs": {"b": {"terms": {"field": "b", "size": 1}}}}}}},
    "nested field": {"a": {"terms": {"field": "a"}, "aggs": {"q": {"terms": {"field": "s.q"}, "aggs": {"share": {"percentile_ranks": {"field": "n", "values": [4]}}}}}}},
}


@pytest.fixture(scope="module")
def rows(spark):
    r = random.Random(5)
    some = lambda x: None if r.random() < 0.15 else x
    made = [(i, some(f"a{min(r.randrange(8), 4)}"), some(f"b{r.randrange(4)}"), some(r.randrange(12)), some(datetime(2024, 1, 1) + timedelta(hours=r.randrange(90))), {"q": some(r.choice("xyz"))}, ["m", "n"]) for i in range(400)]
    return spark.createDataFrame(made, "id long, a string, b string, n int, t timestamp_ntz, s struct<q string>, many array<string>").repartition(4)


def nodes(aggs):
    return parse_body({"size": 0, "aggs": aggs}, 100, "block").aggs


def content(df):
    return None if df is None else (sorted(df.columns), sorted((str(sorted(r.asDict().items())) for r in df.collect())))


@pytest.mark.parametrize("name", TREES)
@pytest.mark.parametrize("empty", [False, True])
def test_tree_equals_levels(rows, name, empty):
    df = rows.limit(0) if empty else rows
    one, many = bucket_tree(df, nodes(TREES[name])[0]), Aggregator().run(df, nodes(TREES[name]))
    assert list(one) == list(many)
    for path, level in many.items():
        tree = one[path]
        assert (tree.keys, tree.fields) == (level.keys, level.fields)
        for part in ("df", "other", "scope"):
            assert content(getattr(tree, part)) == content(getattr(level, part)), (path, part)


def scans(df):
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return plan.split("== Initial Plan ==")[0].count("FileScan")


def test_one_scan_a_frame(spark, data):
    e = Engine(spark, Catalog.of_parquet(spark, data, ["orders"]))
    terms = lambda f, **below: {"terms": {"field": f, "size": 2}, "aggs": below}
    tree = {"s": terms("o_orderstatus", p=terms("o_orderpriority", c=terms("o_custkey", most={"max": {"field": "o_totalprice"}})))}
    out = e.search("orders", {"size": 0, "aggs": tree})
    assert {k for k in out.aggs} == {"s", "s>p", "s>p>c"}
    for r in out.aggs.values():
        assert [scans(x) for x in (r.df, r.other, r.scope)] == [1, 1, 1]
    assert scans(out.notices) == 2  # the total and all notices of the tree


def test_what_does_not_fit_goes_level_by_level(rows):
    aggs = {
        "many": {"terms": {"field": "many"}, "aggs": {"b": {"terms": {"field": "b"}}}},
        "exact": {"terms": {"field": "a"}, "aggs": {"b": {"terms": {"field": "b"}, "aggs": {"n": {"cardinality": {"field": "n"}}}}}},
        "flat": {"terms": {"field": "a"}},
        "tree": {"terms": {"field": "a"}, "aggs": {"b": {"terms": {"field": "b"}}}},
        "top": {"max": {"field": "n"}},
    }
    got, want = aggregate(Aggregator(), rows, nodes(aggs)), Aggregator().run(rows, nodes(aggs))
    assert set(got) == set(want)
    for path in want:
        assert content(got[path].df) == content(want[path].df), path
    plan = lambda p: got[p].df._jdf.queryExecution().optimizedPlan().toString()
    assert "__level" in plan("tree>b") and not any("__level" in plan(p) for p in ("many>b", "exact>b", "flat"))
