"""Pipelines over buckets, address ranges, map cells and top metrics, which run where the gate is off."""

import ipaddress
import random

import pytest
from pyspark.sql import functions as F

from cloakfield.engine import Engine
from cloakfield.operators import pipeline as L
from cloakfield.plans.dsl import parse_body
from cloakfield.sources import policy as P
from cloakfield.sources.catalog import Catalog, RequestError

SALT = "unit-test-salt-of-more-than-32-characters"


@pytest.fixture(scope="module")
def engine(spark):
    rows = [(i, "ab"[i % 2], i % 5, float(i), f"10.0.{i % 3}.{i}", (float(i), float(-i)), f"u{i % 4}") for i in range(20)]
    df = spark.createDataFrame(rows, "id int, k string, day int, v double, ip string, at struct<lat:double,lon:double>, u string")
    policy = P.Policy("t", SALT, (P.FieldSpec("u", "USER"),))
    return lambda masked=False: Engine(spark, Catalog({"t": df}), policy if masked else None, P.Settings(gate="off"), ids={"t": "id"})


def run(engine, aggs, path, masked=False):
    return [r.asDict() for r in engine(masked).search("t", {"size": 0, "aggs": aggs}).aggs[path].df.collect()]


def test_parent_pipelines(engine):
    steps = {
        "sum": {"sum": {"field": "v"}}, "per": {"bucket_script": {"buckets_path": {"s": "sum", "n": "_count"}, "script": "params.s / (params.n * 2)"}},
        "run": {"cumulative_sum": {"buckets_path": "sum"}}, "step": {"derivative": {"buckets_path": "sum"}}, "two": {"serial_diff": {"buckets_path": "sum", "lag": 2}}, "mean": {"moving_avg": {"buckets_path": "sum", "window": 2}},
    }
    rows = sorted(run(engine, {"d": {"histogram": {"field": "day", "interval": 1}, "aggs": steps}}, "d"), key=lambda r: r["d"])
    sums = [sum(float(i) for i in range(20) if i % 5 == d) for d in range(5)]
    assert [r["per"] for r in rows] == [s / 8 for s in sums] and [r["run"] for r in rows] == [sum(sums[: d + 1]) for d in range(5)]
    assert [r["step"] for r in rows] == [None, 4.0, 4.0, 4.0, 4.0] and [r["two"] for r in rows][:3] == [None, None, 8.0] and rows[1]["mean"] == (sums[0] + sums[1]) / 2


def test_selected_and_sorted_buckets_have_no_others_below(engine):
    below = {"terms": {"field": "k"}}
    chosen = {"d": {"histogram": {"field": "day", "interval": 1}, "aggs": {"s": {"sum": {"field": "v"}}, "k": below, "only": {"bucket_selector": {"buckets_path": {"s": "s"}, "script": {"source": "params.s > 34 && !(params.s > 42)"}}}}}}
    assert sorted(r["d"] for r in run(engine, chosen, "d")) == [2, 3] and {r["d"] for r in run(engine, chosen, "d>k")} == {2, 3}
    ordered = {"k": {"terms": {"field": "k"}, "aggs": {"d": {"terms": {"field": "day"}, "aggs": {"s": {"sum": {"field": "v"}}, "cut": {"bucket_sort": {"sort": [{"s": {"order": "desc"}}], "from": 1, "size": 2}}}}}}}
    assert {(r["k"], r["d"]) for r in run(engine, ordered, "k>d")} == {("a", 1), ("a", 4), ("b", 2), ("b", 0)}


def test_sibling_pipelines(engine):
    aggs = {"d": {"histogram": {"field": "day", "interval": 1}, "aggs": {"s": {"sum": {"field": "v"}}}}, "most": {"max_bucket": {"buckets_path": "d>s"}}, "all": {"stats_bucket": {"buckets_path": "d>_count"}}}
    assert run(engine, aggs, "most") == [{"most": 46.0}] and run(engine, aggs, "all") == [{"all_count": 5, "all_min": 4, "all_max": 4, "all_avg": 4.0, "all_sum": 20}]
    inner = {"k": {"terms": {"field": "k"}, "aggs": {"d": {"terms": {"field": "day"}}, "n": {"sum_bucket": {"buckets_path": "d>_count"}}}}}
    assert sorted(r["n"] for r in run(engine, inner, "k>n")) == [10, 10]
    with pytest.raises(RequestError):
        run(engine, {"n": {"sum_bucket": {"buckets_path": "gone"}}}, "n")


@pytest.mark.parametrize("text", ["params.x", "import java", "params.s; 1", "params.s +", "doc['u'].value", "params.s) or (1"])
def test_scripts_are_arithmetic_only(engine, text):
    with pytest.raises(Exception):
        run(engine, {"d": {"terms": {"field": "day"}, "aggs": {"s": {"sum": {"field": "v"}}, "p": {"bucket_script": {"buckets_path": {"s": "s"}, "script": text}}}}}, "d")


def test_address_ranges(engine, spark):
    ranges = [{"mask": "10.0.1.0/24"}, {"from": "10.0.0.5", "to": "10.0.0.10"}, {"key": "all", "mask": "::/0"}, {"key": "none", "mask": "192.168.0.0/16"}, {"to": "10.0.1.0"}]
    got = {r["r"]: r["doc_count"] for r in run(engine, {"r": {"ip_range": {"field": "ip", "ranges": ranges}}}, "r")}
    assert got == {"10.0.1.0/24": 7, "10.0.0.5-10.0.0.10": 2, "all": 20, "none": 0, "*-10.0.1.0": 7}
    rng = random.Random(1)
    some = [str(ipaddress.IPv6Address(rng.getrandbits(128) & rng.choice([-1, 0xFFFF, (1 << 112) - 1, ~0xFFFF0000]))) for _ in range(200)] + ["::", "::1", "1::", "1:2:3:4:5:6:7:8"]
    bad = ["", "1.2.3", "1.2.3.256", ":::", "1::2::3", "1:2:3:4:5:6:7", "1:2:3:4:5:6:7:8:9", ":1", "g::", "x", None]
    rows = spark.createDataFrame([(t,) for t in some + bad], "t string").select("t", L.address_hex(F.col("t")).alias("h")).collect()
    assert all(r["h"] == (f"{int(ipaddress.IPv6Address(r['t'])):032x}" if r["t"] in some else None) for r in rows)
    with pytest.raises(RequestError):
        run(engine, {"r": {"ip_range": {"field": "ip", "ranges": [{"mask": "300.0.0.0/8"}]}}}, "r")


def test_map_cells(engine, spark):
    places = spark.createDataFrame([(57.64911, 10.40744), (-25.382708, -49.265506), (0.0, 0.0), (90.0, 180.0), (None, 1.0)], "lat double, lon double")
    at = F.col("lat"), F.col("lon")
    assert [tuple(r) for r in places.select(L.geohash(*at, 11), L.geohash(*at, 1), L.geotile(*at, 8)).collect()] == [
        ("u4pruydqqvj", "u", "8/135/77"), ("6gkzwgjzn82", "6", "8/92/146"), ("s0000000000", "s", "8/128/128"), ("zzzzzzzzzzz", "z", "8/255/0"), (None, None, None)]
    cells = run(engine, {"c": {"geohash_grid": {"field": "at", "precision": 2}}}, "c")
    assert sum(r["doc_count"] for r in cells) == 20 and all(len(r["c"]) == 2 for r in cells)


def test_top_metrics_are_masked_by_their_field(engine):
    aggs = {"k": {"terms": {"field": "k"}, "aggs": {"last": {"top_metrics": {"metrics": [{"field": "u"}, {"field": "v"}], "sort": {"day": "desc"}}}}}, "first": {"top_metrics": {"metrics": {"field": "u"}, "sort": [{"v": "asc"}]}}}
    assert {(r["k"], r["last_u"], r["last_v"]) for r in run(engine, aggs, "k")} == {("a", "u0", 4.0), ("b", "u1", 9.0)}
    assert run(engine, aggs, "metrics") == [{"first_u": "u0"}]
    assert all(r["last_u"].startswith("[USER_") for r in run(engine, aggs, "k", True)) and run(engine, aggs, "metrics", True)[0]["first_u"].startswith("[USER_")


def test_labels_of_ranges_go_through_the_deep_pass(engine):
    rows = run(engine, {"r": {"ip_range": {"field": "ip", "ranges": [{"mask": "10.0.1.0/24"}]}}}, "r", True)
    assert rows[0]["r"].startswith("[IP_") and rows[0]["r"].endswith("/24") and rows[0]["doc_count"] == 7


@pytest.mark.parametrize("gate", ["block", "drop"])
def test_gates_still_hold(gate):
    body = {"aggs": {"r": {"ip_range": {"field": "ip", "ranges": []}}, "t": {"terms": {"field": "k"}, "aggs": {"s": {"bucket_sort": {}}}}}}
    if gate == "block":
        with pytest.raises(RequestError):
            parse_body(body, gate=gate)
    else:
        assert parse_body(body, gate=gate).aggs == ()
    assert len(parse_body(body, gate="off").aggs) == 2


def test_snippets_are_masked_with_their_own_document(spark):
    rows = [(1, "alice", "long ago alice logged in from host web.example.org at 10.0.0.1 with bob", "x"), (2, "bob", "nothing of interest", "x"), (3, "carol", "Alice LOGGED out", "x")]
    df = spark.createDataFrame(rows, "id int, u string, note string, k string")
    policy = P.Policy("t", SALT, (P.FieldSpec("u", "USER"),))
    body = {"query": {"bool": {"should": [{"match": {"note": "logged"}}, {"term": {"id": 2}}]}}, "highlight": {"fields": {"note": {"fragment_size": 40}, "gone": {}}, "pre_tags": ["["], "post_tags": ["]"]}, "_source": ["id"]}
    e = Engine(spark, Catalog({"t": df}), policy, P.Settings(gate="off"), ids={"t": "id"})
    got = {r["id"]: r["highlight"]["note"] for r in e.search("t", body).hits.collect()}
    raw = {r["id"]: r["highlight"]["note"] for r in Engine(spark, Catalog({"t": df}), None, P.Settings(gate="off"), ids={"t": "id"}).search("t", body).hits.collect()}
    assert raw[1] == ["long ago alice [logged] in from host web."] and raw[2] is None and raw[3] == ["Alice [LOGGED] out"]
    full = e.search("t", {**body, "_source": ["id", "u"]}).hits.collect()
    mine = {r["id"]: r["highlight"]["note"] for r in full}
    assert "alice" not in mine[1][0] and "[USER_" in mine[1][0] and mine[3] == ["Alice [LOGGED] out"]  # another document's name is no name here
    assert got[2] is None


def test_suggestions_of_masked_fields_are_tokens(spark):
    df = spark.createDataFrame([(1, "alice", "see web-1.example.org"), (2, "alisen", "alike"), (3, "alice", None)], "id int, u string, note string")
    policy = P.Policy("t", SALT, (P.FieldSpec("u", "USER"),))
    body = {"size": 0, "suggest": {"a": {"text": "alise", "term": {"field": "u"}}, "b": {"text": "alike", "term": {"field": "note"}}, "c": {"text": "alika", "term": {"field": "note"}}}}
    out = Engine(spark, Catalog({"t": df}), policy, P.Settings(gate="off"), ids={"t": "id"}).search("t", body).suggest
    rows = out["a"].orderBy("rank").collect()
    assert [(r["freq"], r["distance"]) for r in rows] == [(2, 1), (1, 1)] and all(r["option"].startswith("[USER_") for r in rows)
    assert out["b"].count() == 0 and [(r["option"], r["distance"]) for r in out["c"].collect()] == [("alike", 1)]
    plain = Engine(spark, Catalog({"t": df}), None, P.Settings(gate="off")).search("t", body).suggest["a"].orderBy("rank").collect()
    assert [r["option"] for r in plain] == ["alice", "alisen"]
    with pytest.raises(RequestError):
        Engine(spark, Catalog({"t": df}), None, P.Settings(gate="off")).search("t", {"suggest": {"a": {"text": "x"}}})
