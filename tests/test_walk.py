"""Masking and checking at any depth: maps, lists of lists, JSON, and the chain of names against plain Python."""

import json
import random
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from cloakfield.engine import Engine
from cloakfield.functions.freetext import mask_text, mask_values, residual
from cloakfield.functions.tokens import token_text
from cloakfield.functions.values import EMAIL, unicode
from cloakfield.operators.masking import ResidualError, guard, mask_documents, residuals, verify
from cloakfield.sources import policy as P
from cloakfield.sources.catalog import Catalog, RequestError
from tests.by_hand import mask_line

SALT = "unit-test-salt-of-more-than-32-characters"
FIELDS = (P.FieldSpec("user.name", "USER"), P.FieldSpec("user.id", "USER"), P.FieldSpec("source.ip", "IP"), P.FieldSpec("related.user", "USER", True))
POLICY = P.Policy("demo", SALT, FIELDS, ("message",))
USER = lambda v: token_text("USER", v, SALT)
SCHEMA = """id int, labels map<string,string>, lists array<array<string>>, deep map<string,array<struct<note:string,user:struct<name:string>>>>, counts map<string,bigint>,
    message array<string>, related array<struct<user:string>>, at timestamp_ntz, raw binary"""


def rows(spark):
    return spark.createDataFrame(
        [(1, {"mail": "bob@corp.com", "addr": "10.1.2.3", "user.name": "carol", "plain": "text"}, [["x@y.org", "ok"], None, [None]],
          {"k": [("from 10.0.0.9", ("dave",)), (None, None)], "none": None}, {"user.id": 7, "n": 8}, ["login as carol failed for alice", None], [("alice",), (None,)], datetime(2024, 1, 1, 10, 0, 0), b"bytes"),
         (2, None, None, None, None, None, None, None, None)], SCHEMA,
    )


def test_leaves_at_any_depth(spark):
    out = {r["id"]: r for r in mask_documents(rows(spark), POLICY).collect()}
    r = out[1]
    assert r["labels"] == {"mail": token_text("EMAIL", "bob@corp.com", SALT), "addr": token_text("IP", "10.1.2.3", SALT), "user.name": USER("carol"), "plain": "text"}
    assert r["lists"] == [[token_text("EMAIL", "x@y.org", SALT), "ok"], None, [None]]
    assert r["deep"]["k"][0]["user"]["name"] == USER("dave") and r["deep"]["k"][0]["note"] == f"from {token_text('IP', '10.0.0.9', SALT)}" and r["deep"]["none"] is None
    assert r["counts"] == {"user.id": USER("7"), "n": "8"} and r["at"] == datetime(2024, 1, 1, 10) and bytes(r["raw"]) == b"bytes"
    # names of maps, lists of structs and nested structs are this document's own
    assert r["message"] == [f"login as {USER('carol')} failed for {USER('alice')}", None] and r["related"][0]["user"] == USER("alice")
    assert all(out[2][c] is None for c in out[2].asDict() if c != "id")
    verify(mask_documents(rows(spark), POLICY))


def test_keys_of_maps_hold_no_address(spark):
    df = spark.createDataFrame([({"a@b.co": "x", "c@d.co": "y", "n": "z"},)], "m map<string,string>")
    assert set(mask_documents(df, POLICY).first()["m"]) == {token_text("EMAIL", "a@b.co", SALT), token_text("EMAIL", "c@d.co", SALT), "n"}
    from dataclasses import replace

    assert mask_documents(df, replace(POLICY, use_hash=False)).first()["m"] .keys() in ({"[EMAIL]", "[EMAIL]#2", "n"}, {"[EMAIL]", "[EMAIL]#3", "n"})
    assert {(r["column"], r["rows_left"]) for r in residuals(df).collect()} == {("m", 1)}


DOCS = [
    {"user": {"name": "alice", "id": 5}, "note": "seen by alice at 10.0.0.1", "message": "alice did it", "list": [["a@b.co", {"source": {"ip": "not an ip"}}], 3.5, None, True]},
    {"related": [{"user": "bob"}, {"user": ["eve", 4]}], "message": ["bob and eve", {"text": "eve"}], "user.name": "dot", "e": {}, "l": []},
    ["10.0.0.1", {"user": {"id": True}}],
    "10.0.0.1", 17, None,
]


def mask_by_hand(value, path, names):
    """The walk over parsed JSON in plain Python."""
    if isinstance(value, dict):
        return {k: mask_by_hand(v, f"{path}.{k}", names) for k, v in value.items()}
    if isinstance(value, list):
        return [mask_by_hand(v, path, names) for v in value]
    spec = POLICY.spec(path)
    if spec and value is not None:
        return token_text(spec.family, str(value), SALT)
    if not isinstance(value, str):
        return value
    free = path.split(".")[-1] in ("message", "text")
    return mask_line(value, SALT, names if free else (), users=free) if free else mask_line(value, SALT, users=False)


def names_of(value, path):
    if isinstance(value, dict):
        return [n for k, v in value.items() for n in names_of(v, f"{path}.{k}")]
    if isinstance(value, list):
        return [n for v in value for n in names_of(v, path)]
    spec = POLICY.spec(path)
    return [value] if isinstance(value, str) and spec and spec.family == "USER" else []


@pytest.mark.parametrize("kind", ["json", "variant"])
def test_json_and_variant_by_path(spark, kind):
    df = spark.createDataFrame([(i, json.dumps(d)) for i, d in enumerate(DOCS)] + [(98, "{broken 10.0.0.1"), (99, None)], "id int, body string")
    if kind == "variant":
        df = df.where("id < 90").withColumn("body", F.parse_json("body"))
        out = mask_documents(df, POLICY).withColumn("body", F.to_json("body"))
    else:
        out = mask_documents(df, POLICY, json=("body",))
    got = {r["id"]: r["body"] for r in out.collect()}
    for i, d in enumerate(DOCS):
        assert json.loads(got[i]) == mask_by_hand(d, "body", names_of(d, "body")), d
    if kind == "json":
        assert got[98] == "{broken " + token_text("IP", "10.0.0.1", SALT) and got[99] is None


def test_json_of_any_depth_keeps_its_form(spark):
    deep = '{"a": ' * 200 + '{"source" : {"ip":"x"}, "b": "10.0.0.1", "u": "\\u00e9\\n", "c@d.co":[1.50,  1e5, true,null,-0]}' + "}" * 200
    twice = '{"user": {"name": "a\\"b"}, "user": {"name": "c", "id": 1.0}} trailing 10.0.0.1'
    df = spark.createDataFrame([(1, deep), (2, twice), (3, "}}],,::\"10.0.0.1"), (4, ""), (5, " ")], "id int, body string")
    out = {r["id"]: r["body"] for r in mask_documents(df, POLICY, json=("body",)).collect()}
    ip = token_text("IP", "10.0.0.1", SALT)
    assert out[1] == deep.replace('"x"', f'"{token_text("IP", "x", SALT)}"').replace("10.0.0.1", ip).replace("c@d.co", token_text("EMAIL", "c@d.co", SALT))
    names = [token_text("USER", n, SALT) for n in ('a"b', "c", "1.0")]
    assert out[2] == '{"user": {"name": "%s"}, "user": {"name": "%s", "id": "%s"}} trailing %s' % (*names, ip)
    assert out[3] == f'}}}}],,::"{ip}' and out[4] == "" and out[5] == " "


def test_a_nested_variant_is_cut_once(spark):
    """The names of a row and its masking read the same pieces, also below a struct."""
    df = spark.range(1).select(F.struct(F.parse_json(F.lit('{"user": {"name": "bob"}, "message": "login as bob"}')).alias("v")).alias("s"), "id")
    plan = mask_documents(df.repartition(2), POLICY)._jdf.queryExecution().analyzed().toString()
    assert plan.count("regexp_extract_all(to_json(") == 1


def test_a_row_group_is_masked_by_many_tasks(spark, data):
    from cloakfield.queries import _people

    people = _people(spark, data)
    assert people.select(F.spark_partition_id().alias("p")).distinct().count() > 1
    assert people.select("c_custkey").exceptAll(spark.read.parquet(f"{data}/customer.parquet").select("c_custkey")).isEmpty() and people.count() == spark.read.parquet(f"{data}/customer.parquet").count()


def test_unknown_types_are_refused(spark):
    df = spark.createDataFrame([(1, b"x")], "id int, user struct<id:int>" if False else "id int, b binary").select(F.struct(F.col("b").alias("id")).alias("user"))
    with pytest.raises(RequestError):
        mask_documents(df, POLICY)
    odd = spark.sql("SELECT make_interval(1) AS i")
    for f in (lambda d: mask_documents(d, POLICY), verify):
        with pytest.raises(RequestError):
            f(odd)


def probe(spark):
    return spark.createDataFrame([(i, {"mail": "bob@corp.com"}, [["x@y.org"]], "10.1.2.3", "k") for i in range(5)], "id int, labels map<string,string>, lists array<array<string>>, addr string, k string")


def engine(spark, df, **more):
    return Engine(spark, Catalog({"t": df}), POLICY, ids={"t": "id"}, **more)


@pytest.mark.parametrize("gate", ["block", "off"])
def test_search_leaks_nothing(spark, gate):
    e = engine(spark, probe(spark), settings=P.Settings(gate=gate))
    found = e.search("t", {"aggs": {"k": {"terms": {"field": "k"}, "aggs": {"top": {"top_hits": {"size": 2}}}}}})
    shown = str(found.hits.collect()) + str(found.aggs["k>top"].df.collect())
    assert "@" not in shown and "10.1.2.3" not in shown and found.hits.count() == 5


def test_what_is_left_fails_the_pass_that_reads_it(spark):
    """Buckets over a field that nobody configured hold addresses as keys."""
    e = engine(spark, probe(spark))
    body = {"size": 0, "aggs": {"a": {"terms": {"field": "addr"}}}}
    with pytest.raises(Exception, match="addresses are left in a: a"):
        e.search("t", body).aggs["a"].df.collect()
    assert e.search("t", body, verified=False).aggs["a"].df.count() == 1
    with pytest.raises(ResidualError):
        verify(probe(spark))
    assert {r["column"]: r["rows_left"] for r in residuals(probe(spark)).collect()} == {"labels": 5, "lists": 5, "addr": 5, "k": 0}
    assert guard(mask_documents(probe(spark), POLICY), "x").count() == 5


def test_answers_are_counted_logged_and_blocked(spark, tmp_path):
    e, log = engine(spark, probe(spark), as_of=datetime(2024, 1, 1)), str(tmp_path / "log")
    fine = e.answer("t", {"size": 2}, log=log)
    assert not fine.blocked and len(fine.parts["hits"]) == 2 and fine.parts["total"][0]["value"] == 5
    bad = e.answer("t", {"size": 2, "aggs": {"a": {"terms": {"field": "addr"}}}}, tool="overview", log=log)
    assert bad.blocked and bad.parts == {} and bad.residuals == {"aggs.a": {"a": 1}} and "10.1" not in bad.notice
    assert {tuple(r) for r in e.compliance().collect()} == {("search", 1, 0), ("overview", 1, 1)}
    lines = sorted(r["value"].split(" ", 3)[1:3] for r in spark.read.text(log).collect())
    assert lines == [["overview", "BLOCKED"], ["search", "MASKED"]] and not any("10.1.2.3" in r["value"] for r in spark.read.text(log).collect())


def test_parents_of_what_is_outside_are_masked(spark):
    df = spark.createDataFrame([(i, f"u{i % 3}", "k") for i in range(9)], "id int, u string, k string")
    e = Engine(spark, Catalog({"t": df}), P.Policy("d", SALT, (P.FieldSpec("u", "USER"),)), ids={"t": "id"})
    r = e.search("t", {"size": 0, "aggs": {"u": {"terms": {"field": "u"}, "aggs": {"k": {"terms": {"field": "k"}}}}}}).aggs["u>k"]
    assert all(x["u"].startswith("[USER_") for f in (r.df, r.other, r.scope) for x in f.collect())


# --- the chain of names -----------------------------------------------------------------------------------

WORDS = ["user", "user=", "username:", "login as", "for", "by", "uid=", "uid = 0", "(uid=0)", "Accepted publickey for", "account", "alice", "Müller", "ALICE", "root", "a@b.co", "10.0.0.1", "data", "system", "-" * 66, "x." * 40, "[USER_0123456789abcdef]", "USER_0123456789abcdef", "\n", '"', "é", "ok,"]


@pytest.fixture(scope="module")
def chained(spark):
    def run(texts, names, profile, users):
        df = spark.createDataFrame([(i, t, names) for i, t in enumerate(texts)], "i int, t string, n array<string>")
        out = {r["i"]: r["m"] for r in df.select("i", mask_text(F.col("t"), SALT, F.col("n"), users, profile).alias("m")).collect()}
        return [out[i] for i in range(len(texts))]

    return run


@pytest.mark.parametrize("profile", ["response", "stream"])
@pytest.mark.parametrize("names, users", [([], True), (["alice", "Müller", "data", "x", "", "[USER_0123456789abcdef]", "a.b$1\\E(", "Ali", None], True), (["alice"], False)])
def test_chain_equals_plain_python(chained, profile, names, users):
    rng = random.Random(len(names))
    texts = [" ".join(rng.choice(WORDS) for _ in range(rng.randrange(9))) for _ in range(3000)]
    assert chained(texts, names, profile, users) == [mask_line(t, SALT, names, users, profile) for t in texts]


def test_chain_has_no_python_in_its_plan(spark):
    df = spark.createDataFrame([("user=bob", ["bob"])], "t string, n array<string>").select(mask_text(F.col("t"), SALT, F.col("n")))
    assert "Python" not in df._jdf.queryExecution().executedPlan().toString()
    assert mask_text_row(spark, None) is None and mask_text_row(spark, "") == ""


def mask_text_row(spark, text):
    return spark.createDataFrame([(text,)], "t string").select(mask_text(F.col("t"), SALT)).first()[0]


def test_matches_are_found_in_one_scan(spark):
    """Also where a text holds the mark that the cut uses, or what a replacement would read as a group."""
    texts = ["\x01a@b.co\x01 10.0.0.1\x01", "\x01", "$0 a@b.co $1", "a@b.co", "a@b.co,c@d.co\\", "user=\x01 login as bob\x01"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i")
    plan = df.select(mask_values(F.col("t"), SALT))
    assert [r[0] for r in plan.collect()][:5] == [mask_line(t, SALT, users=False) for t in texts[:5]]
    assert [r[0] for r in df.select(mask_text(F.col("t"), SALT)).collect()] == [mask_line(t, SALT, ()) for t in texts]
    assert "regexp_extract_all" not in plan._jdf.queryExecution().analyzed().toString()


def test_addresses_of_any_length(spark):
    texts = ["x" * 300 + "@corp.com", "." * 300 + "bob@x.com", "é" + "a" * 300 + ".b@x.com", "é" + "a" * 300 + "@x.com", "a." * 200 + "-@x.com", "+" * 40 + "a@b.co", "%" * 31 + "w" * 40 + "@b.co", "no one@"]
    out = [r["m"] for r in spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").orderBy("i").select(mask_values(F.col("t"), SALT).alias("m")).collect()]
    assert out == [mask_line(t, SALT, users=False) for t in texts]
    left = spark.createDataFrame([(t,) for t in texts], "t string").select(residual(F.col("t")).alias("r")).collect()
    import re

    assert [r["r"] for r in left] == [re.search(EMAIL, t) is not None for t in texts] and unicode(EMAIL) != EMAIL
