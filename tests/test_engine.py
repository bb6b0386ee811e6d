"""Gates, caps, guards, filters, notices, masking, classification and coverage on small rows."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cloakfield.engine import Engine
from cloakfield.functions.freetext import mask_values, residual
from cloakfield.functions.values import drift_label, percent_label, value_kind
from cloakfield.operators import gdpr, overview
from cloakfield.operators.filters import clause, instant
from cloakfield.operators.masking import ResidualError, mask_documents, verify
from cloakfield.plans.dsl import parse_body
from cloakfield.sources import policy as P
from cloakfield.sources.catalog import Catalog, RequestError, check_pattern, check_tenant, field, present
from tests.by_hand import mask_line, mask_opaque

SALT = "unit-test-salt-of-more-than-32-characters"
NOW = datetime(2024, 1, 10)


def test_guards():
    assert check_pattern("events-*, findings") == ["events-*", "findings"]
    for bad in ("", "_all", "a..b", "A", "x" * 256, "a,,b", "a/b"):
        with pytest.raises(RequestError):
            check_pattern(bad)
    for bad in ("", "../x", "a" * 65, ".hidden"):
        with pytest.raises(RequestError):
            check_tenant(bad)


@pytest.mark.parametrize("body", [
    {"aggs": {"x": {"scripted_metric": {}}}}, {"aggregations": {"x": {"scripted_metric": {}}}}, {"aggs": {"x": {"terms": {"script": "1"}}}},
    {"aggs": {"x": {"multi_terms": {"terms": [{"field": "a"}, {"script": "1"}]}}}}, {"aggs": {"x": {"terms": {"field": "a"}, "aggs": {"y": {"bucket_script": {}}}}}},
    {"suggest": {}}, {"highlight": {}}, {"runtime_mappings": {}}, {"script_fields": {}},
])
def test_gate_blocks_drops_and_lets_through(body):
    with pytest.raises(RequestError):
        parse_body(body)
    dropped = parse_body(body, gate="drop")
    assert dropped.aggs == () and dropped.notices
    free = parse_body(body, gate="off")
    assert free.aggs == () and all(n.startswith("[NOT RUN]") for n in free.notices) and bool(free.notices) is not bool({"suggest", "highlight"} & set(body))


def test_caps():
    plan = parse_body({"size": 500, "aggs": {"a": {"terms": {"field": "x", "size": 900}, "aggs": {"b": {"composite": {"size": 900, "sources": []}}, "c": {"rare_terms": {"field": "x", "size": 900}}}}}})
    assert plan.size == 100 and plan.aggs[0].params["size"] == 100 and plan.aggs[0].children[0].params["size"] == 100
    assert plan.aggs[0].children[1].params["size"] == 900 and len(plan.notices) == 3
    assert parse_body({"size": 500}, size_cap=0).size == 500 and parse_body({}).size == 10 and parse_body({"size": 0}).size == 0
    for bad in ("{", "[]", {"size": True}, {"size": -1}, {"aggs": {"x": {"terms": {}, "avg": {}}}}):
        with pytest.raises(RequestError):
            parse_body(bad)


def test_gate_modes():
    assert [P.gate_mode(x) for x in (None, True, "strip", "OFF", False)] == ["block", "block", "drop", "off", "off"]
    with pytest.raises(RequestError):
        P.gate_mode("perhaps")


def test_instants():
    assert instant("now-24h", NOW) == datetime(2024, 1, 9) and instant("now", NOW) == NOW and instant("2024-01-01T01:00:00+01:00", None) == datetime(2024, 1, 1)
    for bad in ("yesterday", "now-1y"):
        with pytest.raises(RequestError):
            instant(bad, NOW)
    with pytest.raises(RequestError):
        instant("now", None)


def nested(spark):
    return spark.createDataFrame(
        [(1, ("alice", ["a", "b"]), "", "x"), (2, (None, []), None, None), (3, None, "z", "y")], "id int, user struct<name:string, tags:array<string>>, note string, `a.b` string"
    )


def test_paths_and_presence(spark):
    df = nested(spark)
    ids = lambda c: [r["id"] for r in df.where(c).collect()]
    assert ids(present(df, "user.name")) == [1] and ids(present(df, "user.tags")) == [1] and ids(present(df, "note")) == [1, 3]
    assert ids(present(df, "a.b")) == [1, 3] and ids(present(df, "no.such")) == []
    assert ids(field(df, "a.b") == "x") == [1]


def test_clauses(spark):
    df = nested(spark)
    ids = lambda q: [r["id"] for r in df.where(clause(df, q, NOW)).orderBy("id").collect()]
    assert ids({"term": {"user.tags": "a"}}) == [1] and ids({"bool": {"must_not": [{"term": {"note": "z"}}]}}) == [1, 2]
    assert ids({"bool": {"should": [{"term": {"id": 1}}, {"term": {"id": 3}}]}}) == [1, 3] and ids({"match_none": {}}) == []
    assert ids({"bool": {"filter": [{"exists": {"field": "note"}}], "should": [{"term": {"id": 9}}]}}) == [1, 3]
    assert ids({"wildcard": {"a.b": "?"}}) == [1, 3] and ids({"range": {"id": {"gt": 1, "lte": 3}}}) == [2, 3]
    with pytest.raises(RequestError):
        clause(df, {"fuzzy": {"note": "z"}})


def test_union_of_tables_and_conflicts(spark):
    a, b = spark.createDataFrame([(1, "x")], "id int, v string"), spark.createDataFrame([(2, 5, 1.0)], "id int, v int, w double")
    catalog = Catalog({"ev-1": a, "ev-2": b.drop("v"), "ev-3": b})
    assert catalog.read("ev-1,ev-2").count() == 2 and catalog.field_types("ev-*")["v"] == ["int", "string"]
    schema, said = Engine(spark, catalog).schema("ev-*")
    assert dict(schema.collect())["v"] == "CONFLICT:int|string" and said == ["[TYPE CONFLICT] v: int|string"]
    with pytest.raises(RequestError):
        catalog.read("none-*")


def test_array_terms_and_empty_table(spark):
    e = Engine(spark, Catalog({"t": nested(spark), "none": nested(spark).limit(0)}), ids={"t": "id"})
    body = {"size": 0, "aggs": {"tags": {"terms": {"field": "user.tags"}}}}
    assert {tuple(r) for r in e.search("t", body).aggs["tags"].df.collect()} == {("a", 1), ("b", 1)}
    empty = e.search("none", body)
    assert empty.aggs["tags"].df.count() == 0 and [r["code"] for r in empty.notices.collect() if r["code"] == "[ZERO HITS]"]


def test_significant_text_counts_words_once_a_document(spark):
    t = spark.createDataFrame([(1, "a", "Red red wine"), (2, "a", "red, wine"), (3, "b", "white wine"), (4, "b", None), (5, "b", "")], "id int, k string, text string")
    body = {"size": 0, "query": {"term": {"k": "a"}}, "aggs": {"w": {"significant_text": {"field": "text", "min_doc_count": 1}}}}
    rows = Engine(spark, Catalog({"t": t}), ids={"t": "id"}).search("t", body).aggs["w"].df.collect()
    assert [(r["w"], r["doc_count"], r["bg_count"]) for r in rows] == [("red", 2, 2), ("wine", 2, 3)]


LINES = [
    ("user=admin attempted", True), ("username: root accepted", True), ("login as operator ok", True), ("authenticated as svc_backup", True), ("login by user marco from host", True),
    ("Failed login from 192.168.1.100", True), ("Prevent access from external hosts", False), ("listen on :9200, version 1.2.3", False), ("uid=0 only", False), ("uid=müller here", True),
    ("user session data", False), ("Accepted publickey for alice from x", True),
]


@pytest.mark.parametrize("line,changes", LINES)
def test_free_text_formulations(line, changes):
    masked = mask_line(line, SALT)
    assert (masked != line) is changes and mask_line(masked, SALT) == masked


def test_profiles_differ_as_stated():
    assert mask_line("user=bob", SALT) == "user=[USER_3c6f0744aa5f8dbd]" and mask_line("user=bob", SALT, profile="stream") == "[USER_3c6f0744aa5f8dbd]"
    assert "Alice" in mask_line("Alice ran", SALT, ["alice"], profile="stream") and "Alice" not in mask_line("Alice ran", SALT, ["alice"])
    assert mask_line("user jane ran", SALT, users=False) == "user jane ran"
    assert mask_line("root saw data", SALT, ["data"]) == "root saw data"


def test_value_types_native_equals_python(spark):
    texts = ["mail a.b@c.example now", "10.0.0.1 and 10.0.0.2", "2001:db8:85a3:0:0:8a2e:370:7334", "", "nothing", "a@b.co 1.2.3.4 c@d.org", None]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("t", mask_values(F.col("t"), SALT).alias("m"), residual(F.col("t")).alias("r"))
    for r in df.collect():
        assert r["m"] == (None if r["t"] is None else mask_line(r["t"], SALT, users=False)), r


def test_opaque_values():
    assert mask_opaque("x", SALT, {"x": "T"}) == "T"
    out = mask_opaque("a@b.co web.example.org 123e4567-e89b-12d3-a456-426614174000", SALT, {})
    assert "[EMAIL_" in out and "[HOST_" in out and "[USER_" in out and "@" not in out


def test_deep_pass_native_equals_python(spark):
    from cloakfield.functions.freetext import mask_deep
    from cloakfield.operators.masking import mask_opaque_values

    texts = ["a@b.co web.example.org 123e4567-e89b-12d3-a456-426614174000 10.0.0.1", "", "plain", None, "http://x.example.com/y"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string")
    for r in df.select("t", mask_deep(F.col("t"), SALT).alias("m")).collect():
        assert r["m"] == (None if r["t"] is None else mask_opaque(r["t"], SALT, {}))
    known = spark.createDataFrame([("plain", "[USER_0123456789abcdef]")], "value string, token string")
    assert {r["i"]: r["t"] for r in mask_opaque_values(df, known, policy()).collect()}[2] == "[USER_0123456789abcdef]"


def policy(**more):
    fields = (P.FieldSpec("user.name", "USER"), P.FieldSpec("user.id", "USER"), P.FieldSpec("source.ip", "IP"), P.FieldSpec("related.user", "USER", True), P.FieldSpec("host.hostname", "HOST"))
    return P.Policy("demo", SALT, fields, ("message",), **more)


def event(spark):
    return spark.createDataFrame(
        [(("alice", 1001), ("192.168.1.50", "192.168.1.50"), (["alice", "bob"], ["abc123def456"]), ("web-01",), "user alice logged in from 192.168.1.50; contact alice@example.com")],
        "user struct<name:string,id:bigint>, source struct<ip:string,address:string>, related struct<user:array<string>,hash:array<string>>, host struct<hostname:string>, message string",
    )


def test_documents_are_masked_at_every_leaf(spark):
    r = mask_documents(event(spark), policy()).first()
    assert r.user.name == "[USER_7d3b5ef69cb0c55d]" and r.source.ip == r.source.address == "[IP_90cdfffaa9a7fb6f]" and r.host.hostname == "[HOST_3f9e090adda45c83]"
    assert r.related.user == ["[USER_7d3b5ef69cb0c55d]", "[USER_3c6f0744aa5f8dbd]"] and r.related.hash == ["abc123def456"]
    assert "alice" not in r.message and "[USER_7d3b5ef69cb0c55d]" in r.message and "[IP_90cdfffaa9a7fb6f]" in r.message
    verify(mask_documents(event(spark), policy()))
    with pytest.raises(ResidualError):
        verify(event(spark))


def test_masking_twice_changes_nothing(spark):
    once = mask_documents(event(spark).drop("user"), policy())
    assert mask_documents(once, policy()).select("source", "related", "host").collect() == once.select("source", "related", "host").collect()


def test_numbers_by_profile(spark):
    from dataclasses import replace

    kind = lambda profile: mask_documents(event(spark), policy(), profile).first().user
    assert str(kind("response").id).startswith("[USER_") and kind("stream").id == 1001
    labels = mask_documents(event(spark), replace(policy(), use_hash=False)).first()
    assert labels.user.name == "[USERNAME]" and labels.host.hostname == "[HOSTNAME]"


def test_policies():
    body = {"tenant": "a", "salt_env": "S", "fields": [{"field": "source.ip"}, "user.name"], "free_text_fields": ["note"]}
    p = P.Policy.parse(body, {"S": "x" * 40})
    assert p.spec("deep.source.ip").family == "IP" and p.free_text == ("message", "note") and not p.warnings()
    q = P.Policy.parse(body | {"fields": ["user.name", "agent.id"]}, {})
    assert P.drift(p, q) == {"missing": ["source.ip"], "extra": ["agent.id"], "changed": []} and q.warnings() and p.fingerprint() != q.fingerprint()
    for bad in ("related.hash", "message"):
        with pytest.raises(RequestError):
            P.Policy.parse(body | {"fields": [bad]}, {})
    assert P.seconds("30d") == P.seconds("43200m") and P.json_diff({"a": [1, 2]}, {"a": [1, 3]}) == ["$.a[1]"]
    assert P.merge_fields(["b", "a"], ["a", "c"]) == ["b", "a", "c"] and P.setting("n", {"n": 1}, 0, {"N": "2"}) == "2"
    assert P.merge_warning("fields", {"OTHER": "1"}) is None and P.merge_warning("fields", {"FIELDS": "a"}).startswith("FIELDS is set")


def test_labels_never_round_to_a_whole(spark):
    rows = spark.createDataFrame([(10, 10), (10238000, 10238381), (1, 100000), (0, 5), (5, 0), (247255, 348247)], "d long, t long")
    assert [r[0] for r in rows.select(percent_label(F.col("d"), F.col("t"))).collect()] == ["100.0%", "99.9%", "<0.1%", "0.0%", "-", "71.0%"]
    points = spark.createDataFrame([(62.94,), (-0.04,), (-20.5,), (None,)], "p double")
    assert [r[0] for r in points.select(drift_label(F.col("p"))).collect()] == ["+62.9pp", "+0.0pp", "-20.5pp", "-"]


def test_value_kinds(spark):
    rows = spark.createDataFrame([(" a@b.co ",), ("10.0.0.1",), ("web.example.org",), ("http://web.example.org",), ("text",), ("",), (None,)], "v string")
    assert [r[0] for r in rows.select(value_kind(F.col("v"))).collect()] == ["EMAIL", "IP_ADDRESS", "HOSTNAME", None, None, None, None]


def test_severities_keep_zeros_and_spelling(spark):
    rows = spark.createDataFrame([("medium",)] * 3 + [("low",), ("Medium",), (None,)], "level string")
    assert {r["level"]: r["doc_count"] for r in overview.severity(rows).collect()} == {"critical": 0, "high": 0, "medium": 3, "low": 1, "informational": 0}
    assert [tuple(r) for r in overview.unknown_levels(rows).collect()] == [("Medium", 1)]
    for bad in (0, 1001, True):
        with pytest.raises(ValueError):
            overview.check_top(bad)


def test_custom_rules(spark):
    df = spark.createDataFrame([(1, "K-12", "plain")], "id int, code string, other string")
    found = lambda *rules: {r["field"]: r["kind"] for r in gdpr.classify(df, "id", rules).collect()}
    assert found(gdpr.Rule("code", "USER_ID", "low", r"^K-\d+$")) == {"code": "USER_ID"} and found(gdpr.Rule("code", "USER_ID", "low", r"^Z")) == {}
    assert found(gdpr.Rule("co*", "USER_ID", "low", "(")) == {"code": "USER_ID"}


def test_posture(spark):
    e = Engine(spark, Catalog({}), policy())
    assert dict((a, b) for a, b, _ in e.posture(policy()))["fingerprint"] == "OK"
    assert dict((a, b) for a, b, _ in Engine(spark, Catalog({})).posture())["masking policy"] == "WARN"


def test_strict_addresses(spark):
    texts = ["at 10:00:01 from ::1", "fe80::1 and 2001:db8::8a2e:370:7334", "aa:bb:cc:dd:ee:ff"]
    rows = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(mask_values(F.col("t"), SALT, strict_ipv6=True)).collect()]
    assert "10:00:01" in rows[0] and rows[0].count("[IP_") == 1 and rows[1].count("[IP_") == 2 and rows[2] == texts[2]


def test_mapping_facts_reach_coverage(spark):
    from pyspark.sql import types as T

    schema = T.StructType([T.StructField("id", T.LongType()), T.StructField("ts", T.TimestampNTZType()), T.StructField("raw", T.StringType(), metadata={"index": False})])
    df = spark.createDataFrame([(1, NOW, "x"), (2, NOW, None)], schema)
    e = Engine(spark, Catalog({"t": df}), as_of=NOW, ids={"t": "id"}, times={"t": "ts"})
    rows = {r["field"]: r for r in e.field_coverage("t")["coverage"].collect()}
    assert e.catalog.mapping_facts("t")[1] == ("raw", 1, 1, 0) and rows["raw"]["category"] == "unmeasurable" and rows["raw"]["sample_hits"] == 1 and rows["raw"]["total_pct"] is None
    assert rows["id"]["total_label"] == "100.0%"


def test_shadowed_fields_are_named(spark):
    df = spark.createDataFrame([(1, None)], "id int, agent struct<name:string>")
    said = Engine(spark, Catalog({"t": df}), shadowed={"agent.": "node.agent."}).search("t", {"size": 0, "aggs": {"a": {"terms": {"field": "agent.name"}}}}).notices.collect()
    assert any("use node.agent.name" in r["detail"] for r in said if r["code"] == "[EMPTY AGGREGATION]")


def test_log_keeps_raw_lines_out(spark, tmp_path):
    from cloakfield.sources.sinks import append_log, export_log, log_lines

    df = spark.createDataFrame([(NOW, "a", "MASKED", "x RAW\ny"), (NOW, "a", "RAW", "secret"), (NOW, "a", "BLOCKED", "z")], "t timestamp, tenant string, state string, text string")
    append_log(log_lines(df, "t", "tenant", "state", "text"), str(tmp_path / "log"), keep_raw=True)
    lines = sorted(r["value"] for r in export_log(spark, str(tmp_path / "log")).collect())
    assert lines == ["2024-01-10T00:00:00 a BLOCKED z", "2024-01-10T00:00:00 a MASKED x RAW y"]


@pytest.mark.parametrize("text", ["c." * 100_000 + "com", "a@b" + ".c" * 500_000 + ".com", "a." * 100_000 + "@", "user" + " " * 500_000 + "x", "1." * 100_000, "ab:" * 100_000, "a-" * 100_000 + ".x", "😀a" * 100_000])
def test_long_runs_end(spark, text):
    """A long run of one alphabet neither overflows the stack nor takes the square of its length."""
    import time

    from cloakfield.functions.freetext import mask_deep
    from cloakfield.functions.values import embeds_personal_data

    began = time.time()
    c = F.col("t")
    row = spark.createDataFrame([(text,)], "t string").select(value_kind(c).alias("k"), F.length(mask_deep(c, SALT)).alias("n"), embeds_personal_data(c).alias("e"), residual(c).alias("r")).first()
    assert row["n"] > 0 and time.time() - began < 30


def test_examples_show_tokens_only(spark):
    from cloakfield.operators.masking import masking_examples, masking_report

    policy = P.Policy("t", SALT, (P.FieldSpec("u", "USER"), P.FieldSpec("gone", "HOST")))
    df = spark.createDataFrame([("ann",), ("ann",), ("bob",), ("cy",), (None,), ("",)], "u string")
    rows = sorted(masking_examples(df, policy, 2).collect(), key=lambda r: -r["occurrences"])
    assert [(r["field"], r["occurrences"]) for r in rows] == [("u", 2), ("u", 1)] and all(r["token"].startswith("[USER_") or r["token"].startswith("USER_") for r in rows)
    assert masking_examples(df.limit(0), policy).count() == 0
    assert masking_report(df, P.Policy("t", SALT, (P.FieldSpec("gone", "HOST"),))).count() == 0 and masking_examples(df, P.Policy("t", SALT)).count() == 0


def test_thousands_of_fields_take_one_scan(spark, tmp_path):
    """Presence of a wide schema, lists and maps included, against counts by hand."""
    from cloakfield.operators.coverage import presence
    from cloakfield.sources.catalog import flatten

    rows = [tuple((i * k) % 7 or None for k in range(2400)) + ([1] if i % 2 else [], {"a": 1} if i % 3 else {}, (None, "x" if i % 5 else None)) for i in range(20)]
    schema = ", ".join(f"`f.{k}` int" for k in range(2400)) + ", l array<int>, m map<string,int>, s struct<a:string,b:string>"
    spark.createDataFrame(rows, schema).write.parquet(str(tmp_path / "wide"))
    df = spark.read.parquet(str(tmp_path / "wide"))
    fields = [f for f, _ in flatten(df.schema)]
    out = presence(df, [*fields, "no.such"], F.col("`f.1`") > 3)
    got = {r["field"]: (r["total_docs"], r["window_docs"], r["grand_total"], r["window_total"]) for r in out.collect()}
    inside = [i for i, r in enumerate(rows) if (r[1] or 0) > 3]
    has = lambda i, f: bool(rows[i][int(f[2:])]) if f.startswith("f.") else bool({"l": rows[i][2400], "m": rows[i][2401], "s.a": rows[i][2402][0], "s.b": rows[i][2402][1]}.get(f))
    for f in [*fields, "no.such"]:
        assert got[f] == (sum(has(i, f) for i in range(20)), sum(has(i, f) for i in inside), 20, len(inside)), f
    assert out._jdf.queryExecution().optimizedPlan().toString().count("Relation [") == 1
    assert {r["grand_total"] for r in presence(df.limit(0), fields[:3]).collect()} == {0}


def test_lost_files_are_told_and_the_rest_answers(spark, tmp_path):
    """Of five files one is damaged and one is empty."""
    place = tmp_path / "t.parquet"
    spark.range(100).repartition(4).write.parquet(str(place))
    spark.range(0).coalesce(1).write.mode("append").parquet(str(place))
    whole = Engine(spark, Catalog.of_parquet(spark, str(tmp_path), ["t"], tolerant=True))
    assert not [r for r in whole.search("t", {"size": 0}).notices.collect() if r["code"] == "[SHARD FAILURES]"]
    damaged = max(place.glob("part-*.parquet"), key=lambda f: f.stat().st_size)
    damaged.write_bytes(b"no parquet at all")
    for crc in place.glob(".*.crc"):
        crc.unlink()
    e = Engine(spark, Catalog.of_parquet(spark, str(tmp_path), ["t"], tolerant=True))
    found = e.search("t", {"size": 0, "track_total_hits": True})
    said = [tuple(r)[1:] for r in found.notices.collect() if r["code"] == "[SHARD FAILURES]"]
    n = len(list(place.glob("part-*.parquet")))
    assert said == [("t", f"1 of {n} files could not be read; counts are lower bounds")] and 0 < found.total.first()["value"] < 100
    lost, _ = e.catalog.lost_files("t")
    assert [f.rsplit("/", 1)[1] for f in lost] == [damaged.name]
    with pytest.raises(Exception):
        Engine(spark, Catalog.of_parquet(spark, str(tmp_path), ["t"])).search("t", {"size": 0}).total.collect()
