"""Registered queries of the engine and the DuckDB SQL each must equal.

The driver's tables stand in for the engine's: events are the raw stream, orders with customers the findings,
documents and conversations the free text.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace
from datetime import datetime, timedelta

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cloakfield.engine import Engine
from cloakfield.functions.freetext import DEEP_TYPES, VALUE_TYPES, mask_deep, mask_text, mask_values, residual
from cloakfield.functions.tokens import LABELS, token, token_sql
from cloakfield.functions.values import DRIFT, EMAIL, FQDN, IPV4, IPV6, USER_AUTH_SEARCH, USER_NOUN_SEARCH, embeds_personal_data, re2, value_kind
from cloakfield.operators import gdpr, notices, overview, sync
from cloakfield.operators.masking import mask_documents, mask_keys, mask_opaque_values, masking_examples, masking_report, registry, residuals
from cloakfield.sources.catalog import Catalog, spread
from cloakfield.sources.policy import FieldSpec, Policy, Settings

SALT = "registered-queries-demo-salt-of-40-chars"
TABLES = "region nation customer supplier part orders lineitem events documents conversations pages".split()
IDS = {"events": "event_id", "orders": "o_orderkey", "customer": "c_custkey", "documents": "doc_id", "supplier": "s_suppkey", "part": "p_partkey", "findings": "o_orderkey"}
TIMES = {"events": "ts", "orders": "o_orderdate", "findings": "o_orderdate"}
POLICY = Policy("demo", SALT, (FieldSpec("user_id", "USER"), FieldSpec("event_type", "HOST"), FieldSpec("c_name", "HOST"), FieldSpec("c_mktsegment", "USER")))

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def put(f):
        _QUERIES[name] = f
        if sql:
            _ORACLES[name] = sql
        return f

    return put


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)


def latest(df: DataFrame, time: str) -> datetime:
    """The newest time of a stream, first, so that windows are literals that reach the scan."""
    return df.agg(F.max(time)).first()[0]


def findings(spark: SparkSession, sf: str) -> DataFrame:
    """Orders as findings: priorities are levels, one of which is off the scale; customers are agents."""
    orders, customer = (spark.read.parquet(f"{sf}/{t}.parquet") for t in ("orders", "customer"))
    p = F.col("o_orderpriority")
    level = F.when(p == "1-URGENT", "critical").when(p == "2-HIGH", "high").when(p == "3-MEDIUM", "medium").when(p == "5-LOW", "low").otherwise(p)
    joined = orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
    return joined.select("o_orderkey", "o_orderdate", level.alias("level"), F.col("c_name").alias("agent"), F.col("o_orderstatus").alias("title"), F.col("c_mktsegment").alias("category"))


FINDINGS_SQL = """WITH findings AS (SELECT o_orderkey, o_orderdate, c_name AS agent, o_orderstatus AS title, c_mktsegment AS category,
  CASE o_orderpriority WHEN '1-URGENT' THEN 'critical' WHEN '2-HIGH' THEN 'high' WHEN '3-MEDIUM' THEN 'medium' WHEN '5-LOW' THEN 'low' ELSE o_orderpriority END AS level
  FROM orders JOIN customer ON o_custkey = c_custkey), scale AS (SELECT * FROM (VALUES ('critical', 0), ('high', 1), ('medium', 2), ('low', 3), ('informational', 4)) t(level, rank))"""


def engine(spark: SparkSession, sf: str, policy: Policy | None = None, as_of: datetime | None = None, **settings) -> Engine:
    catalog = Catalog.of_parquet(spark, sf, TABLES)
    catalog.tables["findings"] = lambda: findings(spark, sf)
    catalog.tables["observed"] = lambda: observed(spark.read.parquet(f"{sf}/events.parquet"))
    children = {"lineitem": (spark.read.parquet(f"{sf}/lineitem.parquet"), "o_orderkey", "l_orderkey")}
    return Engine(spark, catalog, policy, Settings(**settings), as_of, IDS | {"observed": "event_id"}, TIMES | {"observed": "ts"}, children)


def hits(name: str, index: str, body: dict, sql: str, policy: Policy | None = None):
    query(name, sql)(lambda spark, sf: engine(spark, sf, policy).search(index, body).hits)


def agg(name: str, index: str, aggs: dict, path: str, sql: str, q: dict | None = None, policy: Policy | None = None, finish=None, spelling: str = "aggs"):
    def run(spark: SparkSession, sf: str) -> DataFrame:
        out = engine(spark, sf, policy).search(index, {"size": 0, "query": q or {"match_all": {}}, spelling: aggs}).aggs[path]
        return finish(out) if finish else out.df

    query(name, sql)(run)


def rounded(df: DataFrame) -> DataFrame:
    return df.select(*[F.round(c, 6).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


# --- hits -------------------------------------------------------------------------------------------------

hits("hits_match_all", "events", {"query": {"match_all": {}}, "size": 50}, "SELECT * FROM events ORDER BY event_id LIMIT 50")
hits("hits_range_window", "events", {"query": {"range": {"ts": {"gte": "2024-01-05T00:00:00", "lt": "2024-01-06T00:00:00"}}}, "size": 100},
     "SELECT * FROM events WHERE ts >= '2024-01-05' AND ts < '2024-01-06' ORDER BY event_id LIMIT 100")
hits("hits_term", "events", {"query": {"term": {"event_type": "purchase"}}, "size": 100}, "SELECT * FROM events WHERE event_type = 'purchase' ORDER BY event_id LIMIT 100")
hits("hits_terms", "orders", {"query": {"terms": {"o_orderstatus": ["F", "P"]}}, "size": 100}, "SELECT * FROM orders WHERE o_orderstatus IN ('F', 'P') ORDER BY o_orderkey LIMIT 100")
hits("hits_bool", "orders", {"query": {"bool": {"must": [{"term": {"o_orderstatus": "O"}}], "filter": [{"range": {"o_totalprice": {"gte": 1000}}}],
     "should": [{"term": {"o_orderpriority": "1-URGENT"}}, {"term": {"o_orderpriority": "2-HIGH"}}], "minimum_should_match": 1, "must_not": [{"range": {"o_custkey": {"lt": 10}}}]}}, "size": 100},
     "SELECT * FROM orders WHERE o_orderstatus = 'O' AND o_totalprice >= 1000 AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND NOT o_custkey < 10 ORDER BY o_orderkey LIMIT 100")
hits("hits_exists", "observed", {"query": {"exists": {"field": "k_high"}}, "size": 100, "_source": ["event_id", "k_high"]},
     "SELECT event_id, CAST(props->>'$.k' AS INTEGER) AS k_high FROM events WHERE CAST(props->>'$.k' AS INTEGER) > 50 ORDER BY event_id LIMIT 100")
hits("hits_source_includes", "events", {"_source": {"includes": ["event_id", "event_type"]}, "size": 80}, "SELECT event_id, event_type FROM events ORDER BY event_id LIMIT 80")
hits("hits_size_cap", "events", {"size": 5000}, "SELECT * FROM events ORDER BY event_id LIMIT 100")
hits("hits_search_after", "orders", {"size": 50, "sort": [{"o_totalprice": "desc"}, {"o_orderkey": "asc"}], "search_after": [100000.0, 0], "_source": ["o_orderkey", "o_totalprice"]},
     "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice < 100000.0 OR (o_totalprice = 100000.0 AND o_orderkey > 0) ORDER BY o_totalprice DESC, o_orderkey LIMIT 50")
hits("hits_prefix_wildcard", "part", {"query": {"bool": {"must": [{"prefix": {"p_brand": "Brand#1"}}, {"wildcard": {"p_type": "*A*"}}]}}, "size": 100},
     "SELECT * FROM part WHERE starts_with(p_brand, 'Brand#1') AND p_type LIKE '%A%' ORDER BY p_partkey LIMIT 100")


@query("total_exact", "SELECT count(*) AS value, 'eq' AS relation FROM lineitem WHERE l_quantity >= 10")
def _(spark, sf):
    return engine(spark, sf).search("lineitem", {"size": 0, "track_total_hits": True, "query": {"range": {"l_quantity": {"gte": 10}}}}).total


@query("total_capped", "SELECT least(count(*), 10000) AS value, CASE WHEN count(*) > 10000 THEN 'gte' ELSE 'eq' END AS relation FROM lineitem")
def _(spark, sf):
    return engine(spark, sf).search("lineitem", {"size": 0}).total


# --- tokens -----------------------------------------------------------------------------------------------

@query("token_user", f"SELECT c_custkey, {token_sql('USER', 'c_name', SALT)} AS tok FROM customer")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/customer.parquet").select("c_custkey", token("USER", F.col("c_name"), SALT).alias("tok"))


@query("token_all_families", "SELECT s_suppkey, " + ", ".join(f"{token_sql(f, 's_name', SALT)} AS {f.lower()}" for f in ("IP", "USER", "HOST", "AGENT", "EMAIL")) + " FROM supplier")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", *[token(f, F.col("s_name"), SALT).alias(f.lower()) for f in ("IP", "USER", "HOST", "AGENT", "EMAIL")])


@query("token_idempotent", f"SELECT s_suppkey, {token_sql('HOST', 's_name', SALT)} AS once, {token_sql('HOST', 's_name', SALT)} AS twice FROM supplier")
def _(spark, sf):
    once = token("HOST", F.col("s_name"), SALT)
    return spark.read.parquet(f"{sf}/supplier.parquet").select("s_suppkey", once.alias("once")).withColumn("twice", token("USER", F.col("once"), SALT))


@query("token_labels", "SELECT n_nationkey, " + ", ".join(f"'{v}' AS {k.lower()}" for k, v in LABELS.items()) + " FROM nation")
def _(spark, sf):
    return spark.read.parquet(f"{sf}/nation.parquet").select("n_nationkey", *[token(f, F.col("n_name"), SALT, use_hash=False).alias(f.lower()) for f in LABELS])


@query("token_array", f"SELECT s_nationkey, list_aggregate(list_sort(list({token_sql('HOST', 's_name', SALT)})), 'string_agg', ',') AS hosts FROM supplier GROUP BY s_nationkey")
def _(spark, sf):
    hosts = spark.read.parquet(f"{sf}/supplier.parquet").groupBy("s_nationkey").agg(F.collect_list("s_name").alias("related"))
    return hosts.select("s_nationkey", F.array_join(F.sort_array(F.transform("related", lambda x: token("HOST", x, SALT))), ",").alias("hosts"))


# --- bucket aggregations ----------------------------------------------------------------------------------

agg("agg_terms", "events", {"types": {"terms": {"field": "event_type", "size": 3}}}, "types",
    "SELECT event_type AS types, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3")
agg("agg_terms_other", "events", {"users": {"terms": {"field": "user_id", "size": 5}}}, "users",
    "WITH c AS (SELECT user_id, count(*) AS n FROM events GROUP BY 1), t AS (SELECT * FROM c ORDER BY n DESC, user_id LIMIT 5) SELECT CAST((SELECT sum(n) FROM c) - (SELECT sum(n) FROM t) AS BIGINT) AS sum_other_doc_count",
    finish=lambda r: r.other)
agg("agg_terms_order_metric", "orders", {"status": {"terms": {"field": "o_orderpriority", "size": 3, "order": {"total": "desc"}}, "aggs": {"total": {"sum": {"field": "o_totalprice"}}}}}, "status",
    "SELECT o_orderpriority AS status, count(*) AS doc_count, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1 ORDER BY sum(o_totalprice) DESC, 1 LIMIT 3",
    finish=lambda r: r.df.withColumn("total", F.round("total", 2)))
agg("agg_terms_aggregations_spelling", "orders", {"status": {"terms": {"field": "o_orderstatus"}}}, "status",
    "SELECT o_orderstatus AS status, count(*) AS doc_count FROM orders GROUP BY 1", spelling="aggregations")
agg("agg_nested_terms", "events", {"types": {"terms": {"field": "event_type", "size": 3}, "aggs": {"users": {"terms": {"field": "user_id", "size": 2}}}}}, "types>users",
    """WITH t AS (SELECT event_type, count(*) AS n FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3), c AS (SELECT event_type AS types, user_id AS users, count(*) AS doc_count FROM events WHERE event_type IN (SELECT event_type FROM t) GROUP BY 1, 2)
    SELECT types, users, doc_count FROM c QUALIFY row_number() OVER (PARTITION BY types ORDER BY doc_count DESC, users) <= 2""")
agg("agg_nested3", "orders", {"s": {"terms": {"field": "o_orderstatus", "size": 2}, "aggs": {"p": {"terms": {"field": "o_orderpriority", "size": 2}, "aggs": {"c": {"terms": {"field": "o_custkey", "size": 2}, "aggs": {"spent": {"max": {"field": "o_totalprice"}}}}}}}}}, "s>p>c",
    """WITH a AS (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2),
    b AS (SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS n FROM orders WHERE o_orderstatus IN (SELECT s FROM a) GROUP BY 1, 2 QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY count(*) DESC, o_orderpriority) <= 2)
    SELECT o_orderstatus AS s, o_orderpriority AS p, o_custkey AS c, count(*) AS doc_count, max(o_totalprice) AS spent FROM orders JOIN b ON o_orderstatus = s AND o_orderpriority = p GROUP BY 1, 2, 3
    QUALIFY row_number() OVER (PARTITION BY o_orderstatus, o_orderpriority ORDER BY count(*) DESC, o_custkey) <= 2""")
agg("agg_tree_branches", "orders", {"s": {"terms": {"field": "o_orderstatus", "size": 2}, "aggs": {"m": {"date_histogram": {"field": "o_orderdate", "calendar_interval": "year"}, "aggs": {"p": {"terms": {"field": "o_orderpriority", "size": 2}, "aggs": {"most": {"max": {"field": "o_totalprice"}}}}}}, "c": {"terms": {"field": "o_custkey", "size": 3}}}}}, "s>m>p",
    """WITH a AS (SELECT o_orderstatus AS s FROM orders GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 2)
    SELECT s, date_trunc('year', CAST(o_orderdate AS TIMESTAMP)) AS m, o_orderpriority AS p, count(*) AS doc_count, max(o_totalprice) AS most FROM orders JOIN a ON o_orderstatus = s GROUP BY 1, 2, 3
    QUALIFY row_number() OVER (PARTITION BY s, m ORDER BY count(*) DESC, p) <= 2""", finish=lambda r: r.df.withColumn("m", F.col("m").cast("timestamp_ntz")))
agg("agg_tree_other", "events", {"t": {"terms": {"field": "event_type", "size": 3}, "aggs": {"u": {"terms": {"field": "user_id", "size": 4}}}}}, "t>u",
    """WITH a AS (SELECT event_type AS t FROM events GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 3), c AS (SELECT event_type AS t, user_id, count(*) AS n FROM events WHERE event_type IN (SELECT t FROM a) AND user_id IS NOT NULL GROUP BY 1, 2),
    r AS (SELECT t, n, row_number() OVER (PARTITION BY t ORDER BY n DESC, user_id) AS rank FROM c) SELECT t, CAST(coalesce(sum(n) FILTER (WHERE rank > 4), 0) AS BIGINT) AS sum_other_doc_count FROM r GROUP BY 1""",
    finish=lambda r: r.other)
agg("agg_multi_terms", "orders", {"sp": {"multi_terms": {"terms": [{"field": "o_orderstatus"}, {"field": "o_orderpriority"}], "size": 8}}}, "sp",
    "SELECT o_orderstatus AS sp_0, o_orderpriority AS sp_1, count(*) AS doc_count, o_orderstatus || '|' || o_orderpriority AS sp_as_string FROM orders GROUP BY 1, 2 ORDER BY 3 DESC, 1, 2 LIMIT 8")
COMPOSITE = {"pages": {"composite": {"sources": [{"kind": {"terms": {"field": "event_type"}}}, {"user": {"terms": {"field": "user_id"}}}], "size": 40}}}
agg("agg_composite", "events", COMPOSITE, "pages", "SELECT event_type AS kind, user_id AS \"user\", count(*) AS doc_count FROM events GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 40")


@query("agg_composite_page2", "SELECT event_type AS kind, user_id AS \"user\", count(*) AS doc_count FROM events GROUP BY 1, 2 ORDER BY 1, 2 LIMIT 40 OFFSET 40")
def _(spark, sf):
    e = engine(spark, sf)
    last = e.search("events", {"size": 0, "aggs": COMPOSITE}).aggs["pages"].df.orderBy(F.desc("kind"), F.desc("user")).first()
    body = {**COMPOSITE["pages"]["composite"], "after": {"kind": last["kind"], "user": last["user"]}}
    return e.search("events", {"size": 0, "aggs": {"pages": {"composite": body}}}).aggs["pages"].df


agg("agg_date_histogram", "events", {"day": {"date_histogram": {"field": "ts", "calendar_interval": "day"}, "aggs": {"v": {"sum": {"field": "value"}}}}}, "day",
    "SELECT strftime(date_trunc('day', ts), '%Y-%m-%d') AS day, count(*) AS doc_count, round(sum(value), 4) AS v FROM events GROUP BY 1",
    finish=lambda r: r.df.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "doc_count", F.round("v", 4).alias("v")))
agg("agg_date_histogram_fixed", "events", {"slot": {"date_histogram": {"field": "ts", "fixed_interval": "6h"}}}, "slot",
    "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '1970-01-01'), '%Y-%m-%d %H:%M') AS slot, count(*) AS doc_count FROM events GROUP BY 1",
    finish=lambda r: r.df.select(F.date_format("slot", "yyyy-MM-dd HH:mm").alias("slot"), "doc_count"))
agg("agg_histogram", "lineitem", {"q": {"histogram": {"field": "l_quantity", "interval": 5}}}, "q",
    "SELECT CAST(floor(l_quantity / 5) * 5 AS BIGINT) AS q, count(*) AS doc_count FROM lineitem GROUP BY 1", finish=lambda r: r.df.withColumn("q", F.col("q").cast("bigint")))
agg("agg_range", "orders", {"price": {"range": {"field": "o_totalprice", "ranges": [{"key": "low", "to": 50000}, {"key": "mid", "from": 50000, "to": 200000}, {"key": "any", "from": 10000}, {"key": "none", "from": 1e12}]}}}, "price",
    """SELECT unnest(['low', 'mid', 'any', 'none']) AS price, unnest([count(*) FILTER (WHERE o_totalprice < 50000), count(*) FILTER (WHERE o_totalprice >= 50000 AND o_totalprice < 200000),
    count(*) FILTER (WHERE o_totalprice >= 10000), count(*) FILTER (WHERE o_totalprice >= 1e12)]) AS doc_count FROM orders""")
agg("agg_date_range", "events", {"part": {"date_range": {"field": "ts", "ranges": [{"key": "first", "to": "2024-01-10"}, {"key": "rest", "from": "2024-01-10"}]}}}, "part",
    "SELECT CASE WHEN ts < '2024-01-10' THEN 'first' ELSE 'rest' END AS part, count(*) AS doc_count FROM events GROUP BY 1")
agg("agg_filters", "events", {"f": {"filters": {"filters": {"buys": {"term": {"event_type": "purchase"}}, "big": {"range": {"value": {"gte": 50}}}, "never": {"term": {"event_type": "nope"}}}}}}, "f",
    "SELECT unnest(['buys', 'big', 'never']) AS f, unnest([count(*) FILTER (WHERE event_type = 'purchase'), count(*) FILTER (WHERE value >= 50), count(*) FILTER (WHERE event_type = 'nope')]) AS doc_count FROM events")
agg("agg_filter", "orders", {"open": {"filter": {"term": {"o_orderstatus": "O"}}, "aggs": {"mean": {"avg": {"field": "o_totalprice"}}}}}, "open",
    "SELECT 'open' AS \"open\", count(*) AS doc_count, round(avg(o_totalprice), 6) AS mean FROM orders WHERE o_orderstatus = 'O'", finish=lambda r: rounded(r.df))
agg("agg_missing", "observed", {"gone": {"missing": {"field": "k_high"}}}, "gone",
    "SELECT 'gone' AS gone, count(*) AS doc_count FROM events WHERE NOT coalesce(CAST(props->>'$.k' AS INTEGER) > 50, false)")
agg("agg_rare_terms", "events", {"u": {"rare_terms": {"field": "user_id", "max_doc_count": 55}}}, "u",
    "SELECT user_id AS u, count(*) AS doc_count FROM events GROUP BY 1 HAVING count(*) <= 55")
agg("agg_significant_terms", "events", {"u": {"significant_terms": {"field": "user_id", "size": 7}}}, "u",
    """WITH b AS (SELECT user_id, count(*) AS bg FROM events GROUP BY 1), f AS (SELECT user_id, count(*) AS fg FROM events WHERE event_type = 'purchase' GROUP BY 1),
    s AS (SELECT user_id AS u, fg AS doc_count, bg AS bg_count, fg / (SELECT sum(fg) FROM f) AS a, bg / (SELECT sum(bg) FROM b) AS z FROM f JOIN b USING (user_id))
    SELECT u, doc_count, bg_count, round((a - z) * (a / z), 6) AS score FROM s WHERE (a - z) * (a / z) > 0 AND doc_count >= 3 ORDER BY (a - z) * (a / z) DESC, u LIMIT 7""",
    q={"term": {"event_type": "purchase"}}, finish=lambda r: rounded(r.df))
agg("agg_significant_text", "documents", {"w": {"significant_text": {"field": "text", "size": 20}}}, "w",
    r"""WITH d AS (SELECT lang, unnest(list_distinct(regexp_extract_all(lower(text), '[\p{L}\p{N}_]+'))) AS w FROM documents),
    b AS (SELECT w, count(*) AS bg_count, count(*) FILTER (WHERE lang = 'de') AS doc_count FROM d GROUP BY 1),
    s AS (SELECT *, doc_count / (SELECT count(*) FROM documents WHERE lang = 'de') AS a, bg_count / (SELECT count(*) FROM documents) AS z FROM b)
    SELECT w, doc_count, bg_count, round((a - z) * (a / z), 6) AS score FROM s WHERE (a - z) * (a / z) > 0 AND doc_count >= 3 ORDER BY (a - z) * (a / z) DESC, w LIMIT 20""",
    q={"term": {"lang": "de"}}, finish=lambda r: rounded(r.df))
agg("agg_top_hits", "orders", {"s": {"terms": {"field": "o_orderstatus"}, "aggs": {"best": {"top_hits": {"size": 3, "sort": [{"o_totalprice": "desc"}], "_source": ["o_orderkey", "o_totalprice"]}}}}}, "s>best",
    "SELECT o_orderstatus AS s, o_orderkey, o_totalprice FROM orders QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) <= 3")
agg("agg_sampler", "events", {"some": {"sampler": {"shard_size": 200}, "aggs": {"mean": {"avg": {"field": "value"}}}}}, "some",
    "SELECT 'some' AS \"some\", count(*) AS doc_count, round(avg(value), 6) AS mean FROM (SELECT * FROM events ORDER BY event_id LIMIT 200)", finish=lambda r: rounded(r.df))
agg("agg_diversified_sampler", "events", {"some": {"diversified_sampler": {"shard_size": 100, "field": "event_type", "max_docs_per_value": 4}, "aggs": {"top": {"max": {"field": "value"}}}}}, "some",
    "SELECT 'some' AS \"some\", count(*) AS doc_count, max(value) AS top FROM (SELECT * FROM events QUALIFY row_number() OVER (PARTITION BY event_type ORDER BY event_id) <= 4)")
agg("agg_children", "orders", {"s": {"terms": {"field": "o_orderstatus"}, "aggs": {"lines": {"children": {"type": "lineitem"}, "aggs": {"qty": {"sum": {"field": "l_quantity"}}}}}}}, "s>lines",
    "SELECT o_orderstatus AS s, count(*) AS doc_count, round(sum(l_quantity), 2) AS qty FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1", finish=lambda r: r.df.withColumn("qty", F.round("qty", 2)))

agg("agg_nested_filters_keep_empty", "events", {"t": {"terms": {"field": "event_type"}, "aggs": {"f": {"filters": {"filters": {"buys": {"term": {"event_type": "purchase"}}, "never": {"term": {"event_type": "nope"}}}}}}}}, "t>f",
    "SELECT event_type AS t, unnest(['buys', 'never']) AS f, unnest([count(*) FILTER (WHERE event_type = 'purchase'), 0]) AS doc_count FROM events GROUP BY event_type")


@query("hits_search_after_null", "SELECT event_id, amount FROM (SELECT event_id, CASE WHEN event_type = 'purchase' THEN value END AS amount, max(CASE WHEN event_type = 'purchase' THEN value END) OVER () AS top FROM events) WHERE amount IS NULL OR amount > top - 1 ORDER BY amount NULLS LAST, event_id LIMIT 100")
def _(spark, sf):
    """The page behind the last amounts goes on with rows that have none."""
    events = observed(spark.read.parquet(f"{sf}/events.parquet"))
    top = events.agg(F.max("amount")).first()[0]
    body = {"size": 100, "sort": [{"amount": "asc"}, {"event_id": "asc"}], "search_after": [top - 1, 1 << 60], "_source": ["event_id", "amount"]}
    return engine(spark, sf).search("observed", body).hits


# --- metric aggregations ----------------------------------------------------------------------------------

agg("agg_basic_metrics", "lineitem", {"a": {"avg": {"field": "l_quantity"}}, "s": {"sum": {"field": "l_extendedprice"}}, "lo": {"min": {"field": "l_discount"}}, "hi": {"max": {"field": "l_tax"}}, "n": {"value_count": {"field": "l_shipdate"}}}, "metrics",
    "SELECT round(avg(l_quantity), 6) AS a, round(sum(l_extendedprice), 2) AS s, min(l_discount) AS lo, max(l_tax) AS hi, count(l_shipdate) AS n FROM lineitem",
    finish=lambda r: r.df.withColumns({"a": F.round("a", 6), "s": F.round("s", 2)}))
agg("agg_cardinality", "events", {"users": {"cardinality": {"field": "user_id"}}, "kinds": {"cardinality": {"field": "event_type"}}}, "metrics", "SELECT count(DISTINCT user_id) AS users, count(DISTINCT event_type) AS kinds FROM events")


@query("agg_cardinality_approx")
def _(spark, sf):
    return engine(spark, sf).search("events", {"size": 0, "aggs": {"users": {"cardinality": {"field": "user_id", "approximate": True}}}}).aggs["metrics"].df


@query("agg_percentiles_approx")
def _(spark, sf):
    return engine(spark, sf).search("lineitem", {"size": 0, "aggs": {"q": {"percentiles": {"field": "l_extendedprice", "percents": [5, 50, 95]}}}}).aggs["metrics"].df


agg("agg_stats", "orders", {"s": {"terms": {"field": "o_orderstatus"}, "aggs": {"p": {"stats": {"field": "o_totalprice"}}}}}, "s",
    "SELECT o_orderstatus AS s, count(*) AS doc_count, count(o_totalprice) AS p_count, min(o_totalprice) AS p_min, max(o_totalprice) AS p_max, round(avg(o_totalprice), 4) AS p_avg, round(sum(o_totalprice), 2) AS p_sum FROM orders GROUP BY 1",
    finish=lambda r: r.df.withColumns({"p_avg": F.round("p_avg", 4), "p_sum": F.round("p_sum", 2)}))
agg("agg_extended_stats", "events", {"v": {"extended_stats": {"field": "value"}}}, "metrics",
    """SELECT count(value) AS v_count, min(value) AS v_min, max(value) AS v_max, round(avg(value), 5) AS v_avg, round(sum(value), 3) AS v_sum, round(sum(value * value), 2) AS v_sum_of_squares, round(var_pop(value), 5) AS v_variance,
    round(stddev_pop(value), 5) AS v_std_deviation, round(avg(value) + 2 * stddev_pop(value), 5) AS v_upper, round(avg(value) - 2 * stddev_pop(value), 5) AS v_lower FROM events""",
    finish=lambda r: r.df.withColumns({c: F.round(c, {"v_sum": 3, "v_sum_of_squares": 2}.get(c, 5)) for c in r.df.columns if c not in ("v_count", "v_min", "v_max")}))
agg("agg_percentiles", "lineitem", {"q": {"percentiles": {"field": "l_extendedprice", "percents": [5, 50, 95], "exact": True}}}, "metrics",
    "SELECT round(quantile_cont(l_extendedprice, 0.05), 4) AS q_5, round(quantile_cont(l_extendedprice, 0.5), 4) AS q_50, round(quantile_cont(l_extendedprice, 0.95), 4) AS q_95 FROM lineitem",
    finish=lambda r: r.df.select(*[F.round(c, 4).alias(c) for c in r.df.columns]))
agg("agg_percentile_ranks", "events", {"v": {"percentile_ranks": {"field": "value", "values": [10, 50]}}}, "metrics",
    "SELECT round(100.0 * avg(CASE WHEN value <= 10 THEN 1.0 ELSE 0.0 END), 6) AS v_10, round(100.0 * avg(CASE WHEN value <= 50 THEN 1.0 ELSE 0.0 END), 6) AS v_50 FROM events", finish=lambda r: rounded(r.df))
agg("agg_matrix_stats", "lineitem", {"m": {"matrix_stats": {"fields": ["l_quantity", "l_discount"]}}}, "metrics",
    """WITH m AS (SELECT avg(l_quantity) AS qa, avg(l_discount) AS da, var_pop(l_quantity) AS qv, var_pop(l_discount) AS dv FROM lineitem)
    SELECT count(l_quantity) AS m_l_quantity_count, round(avg(l_quantity), 5) AS m_l_quantity_mean, round(var_samp(l_quantity), 5) AS m_l_quantity_variance, round(avg(power(l_quantity - qa, 3)) / power(any_value(qv), 1.5), 5) AS m_l_quantity_skewness, round(kurtosis_pop(l_quantity) + 3, 5) AS m_l_quantity_kurtosis,
    count(l_discount) AS m_l_discount_count, round(avg(l_discount), 5) AS m_l_discount_mean, round(var_samp(l_discount), 5) AS m_l_discount_variance, round(avg(power(l_discount - da, 3)) / power(any_value(dv), 1.5), 5) AS m_l_discount_skewness, round(kurtosis_pop(l_discount) + 3, 5) AS m_l_discount_kurtosis,
    round(covar_samp(l_quantity, l_discount), 5) AS m_l_quantity_l_discount_covariance, round(corr(l_quantity, l_discount), 5) AS m_l_quantity_l_discount_correlation FROM lineitem, m""",
    finish=lambda r: r.df.select(*[F.round(c, 5).alias(c) if t == "double" else F.col(c) for c, t in r.df.dtypes]))


@query("agg_geo", "SELECT max(n_nationkey * 1.5::DOUBLE - 20) AS b_top, min(n_regionkey * 10.0::DOUBLE) AS b_left, min(n_nationkey * 1.5::DOUBLE - 20) AS b_bottom, max(n_regionkey * 10.0::DOUBLE) AS b_right, round(avg(n_nationkey * 1.5::DOUBLE - 20), 6) AS c_lat, round(avg(n_regionkey * 10.0::DOUBLE), 6) AS c_lon, count(*) AS c_count FROM nation")
def _(spark, sf):
    nation = spark.read.parquet(f"{sf}/nation.parquet")
    places = nation.select("n_nationkey", F.struct((F.col("n_nationkey") * 1.5 - 20).alias("lat"), (F.col("n_regionkey") * 10.0).alias("lon")).alias("location"))
    e = Engine(spark, Catalog({"places": places}))
    return rounded(e.search("places", {"size": 0, "aggs": {"b": {"geo_bounds": {"field": "location"}}, "c": {"geo_centroid": {"field": "location"}}}}).aggs["metrics"].df)


# --- behind an open gate ----------------------------------------------------------------------------------

def opened(name: str, index: str, aggs: dict, path: str, sql: str, finish=None):
    @query(name, sql)
    def _(spark, sf):
        out = engine(spark, sf, gate="off").search(index, {"size": 0, "aggs": aggs}).aggs[path]
        return finish(out.df) if finish else out.df


_DAYS = {"date_histogram": {"field": "ts", "calendar_interval": "day"}}
opened("agg_bucket_script_cumulative", "events", {"day": {**_DAYS, "aggs": {
    "v": {"sum": {"field": "value"}}, "per": {"bucket_script": {"buckets_path": {"v": "v", "n": "_count"}, "script": "params.v / params.n"}}, "so_far": {"cumulative_sum": {"buckets_path": "_count"}}, "step": {"derivative": {"buckets_path": "_count"}}}}}, "day",
    """WITH d AS (SELECT date_trunc('day', ts) AS d, count(*) AS doc_count, sum(value) AS s FROM events GROUP BY 1) SELECT strftime(d, '%Y-%m-%d') AS day, doc_count, round(s, 4) AS v, round(s / doc_count, 4) AS per,
    CAST(sum(doc_count) OVER (ORDER BY d) AS BIGINT) AS so_far, doc_count - lag(doc_count) OVER (ORDER BY d) AS step FROM d""",
    lambda df: df.select(F.date_format("day", "yyyy-MM-dd").alias("day"), "doc_count", F.round("v", 4).alias("v"), F.round("per", 4).alias("per"), "so_far", "step"))
_SPENT = {"p": {"terms": {"field": "o_orderpriority"}, "aggs": {"total": {"sum": {"field": "o_totalprice"}}, "big": {"bucket_selector": {"buckets_path": {"t": "total", "n": "_count"}, "script": "params.t / params.n > 100 && params.n >= 2"}}, "cut": {"bucket_sort": {"sort": [{"total": {"order": "desc"}}], "size": 2}}}}}
opened("agg_bucket_selector_sort", "orders", {"s": {"terms": {"field": "o_orderstatus"}, "aggs": _SPENT}}, "s>p",
    """SELECT o_orderstatus AS s, o_orderpriority AS p, count(*) AS doc_count, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1, 2 HAVING avg(o_totalprice) > 100 AND count(*) >= 2
    QUALIFY row_number() OVER (PARTITION BY o_orderstatus ORDER BY sum(o_totalprice) DESC, o_orderpriority) <= 2""", lambda df: df.withColumn("total", F.round("total", 2)))
opened("agg_stats_bucket", "orders", {"s": {"terms": {"field": "o_orderstatus"}, "aggs": {"p": {"terms": {"field": "o_orderpriority"}}, "over": {"stats_bucket": {"buckets_path": "p>_count"}}}}}, "s>over",
    "SELECT s, count(*) AS over_count, min(n) AS over_min, max(n) AS over_max, avg(n) AS over_avg, CAST(sum(n) AS BIGINT) AS over_sum FROM (SELECT o_orderstatus AS s, count(*) AS n FROM orders GROUP BY o_orderstatus, o_orderpriority) GROUP BY 1")
opened("agg_top_metrics", "orders", {"s": {"terms": {"field": "o_orderstatus"}, "aggs": {"last": {"top_metrics": {"metrics": [{"field": "o_orderkey"}, {"field": "o_totalprice"}], "sort": {"o_orderdate": "desc"}}}}}}, "s",
    "SELECT o_orderstatus AS s, count(*) AS doc_count, first(o_orderkey ORDER BY o_orderdate DESC, o_orderkey) AS last_o_orderkey, first(o_totalprice ORDER BY o_orderdate DESC, o_orderkey) AS last_o_totalprice FROM orders GROUP BY 1")


@query("agg_ip_range", """WITH x AS (SELECT (user_id % 4) * 256 + user_id % 250 AS a FROM events) SELECT unnest(['10.0.1.0/24', 'low', 'six']) AS r, unnest([count(*) FILTER (WHERE a >= 256 AND a < 512), count(*) FILTER (WHERE a < 300), 0]) AS doc_count FROM x""")
def _(spark, sf):
    ip = F.concat(F.lit("10.0."), (F.col("user_id") % 4).cast("string"), F.lit("."), (F.col("user_id") % 250).cast("string"))
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", ip.alias("ip"))
    ranges = [{"mask": "10.0.1.0/24"}, {"key": "low", "to": "10.0.1.44"}, {"key": "six", "mask": "2001:db8::/32"}]
    return Engine(spark, Catalog({"seen": events}), settings=Settings(gate="off")).search("seen", {"size": 0, "aggs": {"r": {"ip_range": {"field": "ip", "ranges": ranges}}}}).aggs["r"].df


@query("agg_geotile", """WITH x AS (SELECT user_id % 160 - 80.0 AS lat, (user_id * 7) % 360 - 180.0 AS lon FROM events)
    SELECT '5/' || CAST(floor((lon + 180) / 360 * 32) AS BIGINT) || '/' || CAST(floor((1 - asinh(tan(radians(lat))) / pi()) / 2 * 32) AS BIGINT) AS tile, count(*) AS doc_count FROM x GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 50""")
def _(spark, sf):
    at = F.struct((F.col("user_id") % 160 - 80.0).alias("lat"), ((F.col("user_id") * 7) % 360 - 180.0).alias("lon"))
    events = spark.read.parquet(f"{sf}/events.parquet").select("event_id", at.alias("at"))
    return Engine(spark, Catalog({"seen": events}), settings=Settings(gate="off")).search("seen", {"size": 0, "aggs": {"tile": {"geotile_grid": {"field": "at", "precision": 5, "size": 50}}}}).aggs["tile"].df


@query("hits_highlight", """SELECT p_partkey, regexp_replace(p_name, '\\b(widget|ring)\\b', '<em>\\1</em>', 'gi') AS snippet FROM part WHERE regexp_matches(p_name, '\\b(widget|ring)\\b', 'i') ORDER BY p_partkey LIMIT 60""")
def _(spark, sf):
    body = {"size": 60, "query": {"match": {"p_name": "Widget ring"}}, "highlight": {"fields": {"p_name": {}}}}
    return engine(spark, sf, gate="off").search("part", body).hits.select("p_partkey", F.col("highlight.p_name")[0].alias("snippet"))


@query("suggest_terms", """WITH w AS (SELECT unnest(list_distinct(regexp_extract_all(lower(p_name), '[\\p{L}\\p{N}_]+'))) AS option FROM part), c AS (SELECT option, count(*) AS freq FROM w GROUP BY 1),
    q AS (SELECT unnest(['rin', 'widgat', 'bluu', 'bolts']) AS word), d AS (SELECT word, option, freq, CAST(levenshtein(option, word) AS INTEGER) AS distance FROM c, q WHERE left(option, 1) = left(word, 1))
    SELECT 'like' AS suggest, word, option, freq, distance, CAST(row_number() OVER (PARTITION BY word ORDER BY distance, freq DESC, option) AS INTEGER) AS rank FROM d WHERE distance BETWEEN 1 AND 2 QUALIFY rank <= 5""")
def _(spark, sf):
    body = {"size": 0, "suggest": {"like": {"text": "Rin widgat bluu bolts", "term": {"field": "p_name"}}}}
    return engine(spark, sf, gate="off").search("part", body).suggest["like"]


# --- masked aggregations and documents --------------------------------------------------------------------

agg("masked_terms", "events", {"t": {"terms": {"field": "event_type", "size": 3}}}, "t",
    f"SELECT {token_sql('HOST', 'k', SALT)} AS t, doc_count FROM (SELECT event_type AS k, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 3)", policy=POLICY)
agg("masked_multi_terms_key_as_string", "events", {"m": {"multi_terms": {"terms": [{"field": "event_type"}, {"field": "user_id"}], "size": 20}}}, "m",
    f"""WITH c AS (SELECT event_type AS a, user_id, CAST(user_id AS VARCHAR) AS b, count(*) AS doc_count FROM events GROUP BY 1, 2, 3 ORDER BY 4 DESC, 1, 2 LIMIT 20),
    d AS (SELECT {token_sql('HOST', 'a', SALT)} AS m_0, {token_sql('USER', 'b', SALT)} AS m_1, doc_count FROM c) SELECT *, m_0 || '|' || m_1 AS m_as_string FROM d""", policy=POLICY)
agg("masked_composite_after_key", "events", {"p": {"composite": {"sources": [{"kind": {"terms": {"field": "event_type"}}}], "size": 3}}}, "p",
    f"SELECT {token_sql('HOST', 'k', SALT)} AS kind, doc_count FROM (SELECT event_type AS k, count(*) AS doc_count FROM events GROUP BY 1 ORDER BY 1 LIMIT 3) ORDER BY k DESC LIMIT 1",
    finish=lambda r: mask_keys(replace(r, df=r.df.orderBy(F.desc("kind")).limit(1)), POLICY).df)


agg("masked_nested", "findings", {"c": {"terms": {"field": "category", "size": 2}, "aggs": {"a": {"terms": {"field": "agent", "size": 2}}}}}, "c>a",
    FINDINGS_SQL + f""", t AS (SELECT category, count(*) AS n FROM findings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 2), x AS (SELECT category AS c, agent, count(*) AS doc_count FROM findings WHERE category IN (SELECT category FROM t) GROUP BY 1, 2
    QUALIFY row_number() OVER (PARTITION BY category ORDER BY count(*) DESC, agent) <= 2) SELECT c, {token_sql('HOST', 'agent', SALT)} AS a, doc_count FROM x""", policy=Policy("demo", SALT, (FieldSpec("agent", "HOST"),)))
hits("masked_hits", "customer", {"size": 100, "_source": ["c_custkey", "c_name", "c_mktsegment", "c_acctbal"]},
     f"SELECT c_custkey, {token_sql('HOST', 'c_name', SALT)} AS c_name, {token_sql('USER', 'c_mktsegment', SALT)} AS c_mktsegment, c_acctbal FROM customer ORDER BY c_custkey LIMIT 100", policy=POLICY)


@query("masked_value_registry", f"SELECT DISTINCT value, tok AS token FROM (SELECT c_name AS value, {token_sql('HOST', 'c_name', SALT)} AS tok FROM customer UNION ALL SELECT c_mktsegment, {token_sql('USER', 'c_mktsegment', SALT)} FROM customer)")
def _(spark, sf):
    return registry(spark.read.parquet(f"{sf}/customer.parquet"), POLICY)


PROPS = Policy("demo", SALT, (FieldSpec("props.k", "USER"), FieldSpec("user_id", "USER")))


@query("masked_props", f"""SELECT event_id, ts, {token_sql('USER', 'u', SALT)} AS user_id, event_type, value, '{{"k": "' || {token_sql('USER', 'k', SALT)} || '"}}' AS props
    FROM (SELECT *, CAST(user_id AS VARCHAR) AS u, props->>'$.k' AS k FROM events)""")
def _(spark, sf):
    """JSON text masked by path, next to plain columns."""
    return mask_documents(spread(spark.read.parquet(f"{sf}/events.parquet"), "event_id"), PROPS, json=("props",))


def _people(spark, sf) -> DataFrame:
    """Customers as documents with a map, a list of lists and JSON inside a struct; the same name stands in all of them."""
    name, key = F.col("c_name"), F.col("c_custkey").cast("string")
    mail = F.concat(F.lit("at c"), key, F.lit("@example.org and 10.1.0."), (F.col("c_custkey") % 250).cast("string"))
    text = F.to_json(F.struct(F.struct(name.alias("c_name"), F.array(mail).alias("notes")).alias("who"), F.col("c_acctbal").alias("bal")))
    return spread(spark.read.parquet(f"{sf}/customer.parquet"), "c_custkey").select(
        "c_custkey", F.create_map(F.lit("c_name"), name, F.lit("seen"), mail).alias("m"), F.array(F.array(mail), F.array(name)).alias("l"), F.struct(F.parse_json(text).alias("v")).alias("s")
    )


_MAIL_SQL = f"'at ' || {token_sql('EMAIL', 'e', SALT)} || ' and ' || {token_sql('IP', 'i', SALT)}"


@query("masked_maps_lists_variants", f"""SELECT c_custkey, {token_sql('USER', 'c_name', SALT)} AS in_map, {_MAIL_SQL} AS beside, {_MAIL_SQL} AS in_list, c_name AS not_configured, {token_sql('USER', 'c_name', SALT)} AS in_variant, {_MAIL_SQL} AS in_variant_list, c_acctbal AS number
    FROM (SELECT *, 'c' || c_custkey || '@example.org' AS e, '10.1.0.' || (c_custkey % 250) AS i FROM customer)""")
def _(spark, sf):
    masked = mask_documents(_people(spark, sf), Policy("demo", SALT, (FieldSpec("c_name", "USER"),)))
    at = lambda path, kind="string": F.variant_get("s.v", path, kind)
    return masked.select("c_custkey", F.col("m.c_name").alias("in_map"), F.col("m.seen").alias("beside"), F.col("l")[0][0].alias("in_list"), F.col("l")[1][0].alias("not_configured"),
                         at("$.who.c_name").alias("in_variant"), at("$.who.notes[0]").alias("in_variant_list"), at("$.bal", "double").alias("number"))


@query("verify_nested", "SELECT unnest(['m', 'l', 's']) AS \"column\", unnest([count(*), count(*), count(*)]) AS rows_left FROM customer")
def _(spark, sf):
    """What is left in documents that nobody masked, at any depth."""
    return residuals(_people(spark, sf))


@query("verify_nested_masked", "SELECT unnest(['m', 'l', 's']) AS \"column\", 0::BIGINT AS rows_left")
def _(spark, sf):
    return residuals(mask_documents(_people(spark, sf), Policy("demo", SALT, (FieldSpec("c_name", "USER"),))))


@query("text_mask_names", f"SELECT conv_id, turn, 'seen: ' || {token_sql('USER', 'n', SALT)} || ' did user=' || {token_sql('USER', 'n', SALT)} AS masked FROM (SELECT conv_id, turn, 'r' || conv_id AS n FROM conversations)")
def _(spark, sf):
    """A name of each row inside a list of texts, as an own name and in a formulation."""
    name = F.concat(F.lit("r"), F.col("conv_id").cast("string"))
    turns = spread(spark.read.parquet(f"{sf}/conversations.parquet"), "conv_id", "turn").select("conv_id", "turn", name.alias("who"), F.array(F.concat(F.lit("seen: "), F.upper(F.substring(name, 1, 1)), F.substring(name, 2, 30), F.lit(" did user="), name)).alias("message"))
    return mask_documents(turns, Policy("demo", SALT, (FieldSpec("who", "USER"),))).select("conv_id", "turn", F.col("message")[0].alias("masked"))


# --- notices ----------------------------------------------------------------------------------------------

def observed(events: DataFrame) -> DataFrame:
    """Events with fields that are filled in part: k_high for high payloads, amount for purchases, late in the last days alone, and one that never is."""
    k = F.get_json_object("props", "$.k").cast("int")
    late = F.when(F.col("ts") >= F.lit("2024-01-29").cast("timestamp_ntz"), F.col("event_type"))
    return events.select("event_id", "ts", "user_id", "event_type", "value", k.alias("k"), F.when(k > 50, k).alias("k_high"), F.when(F.col("event_type") == "purchase", F.col("value")).alias("amount"), late.alias("late"), F.lit(None).cast("string").alias("never"))


OBSERVED_SQL = """WITH observed AS (SELECT event_id, ts, user_id, event_type, value, CAST(props->>'$.k' AS INTEGER) AS k, CASE WHEN CAST(props->>'$.k' AS INTEGER) > 50 THEN CAST(props->>'$.k' AS INTEGER) END AS k_high,
  CASE WHEN event_type = 'purchase' THEN value END AS amount, CASE WHEN ts >= '2024-01-29' THEN event_type END AS late, CAST(NULL AS VARCHAR) AS never FROM events)"""
FIELDS = ["event_id", "ts", "user_id", "event_type", "value", "k", "k_high", "amount", "late", "never"]


@query("notice_partial_coverage", OBSERVED_SQL + ", c AS (SELECT count(*) AS scope, count(late) AS covered FROM observed) SELECT 'late' AS agg, scope, covered, scope - covered AS missing, round(100.0 * covered / scope, 1) AS pct FROM c WHERE covered < scope")
def _(spark, sf):
    r = engine(spark, sf).search("observed", {"size": 0, "aggs": {"late": {"terms": {"field": "late", "size": 2}}}}).aggs["late"]
    return notices.partial_coverage(r, "late")


@query("notice_partial_coverage_nested", OBSERVED_SQL + ", c AS (SELECT event_type AS t, count(*) AS scope, count(k_high) AS covered FROM observed GROUP BY 1) SELECT 't>k' AS agg, t, scope, covered, scope - covered AS missing, round(100.0 * covered / scope, 1) AS pct FROM c WHERE covered < scope")
def _(spark, sf):
    r = engine(spark, sf).search("observed", {"size": 0, "aggs": {"t": {"terms": {"field": "event_type"}, "aggs": {"k": {"terms": {"field": "k_high"}}}}}}).aggs["t>k"]
    return notices.partial_coverage(r, "t>k")


@query("notice_empty_agg", "SELECT 'never' AS agg, count(*) AS scope FROM events")
def _(spark, sf):
    r = engine(spark, sf).search("observed", {"size": 0, "aggs": {"never": {"terms": {"field": "never"}}}}).aggs["never"]
    return notices.empty_aggregations(r, "never")


@query("notice_zero_hits", "SELECT '[ZERO HITS]' AS code, 'events' AS subject")
def _(spark, sf):
    return engine(spark, sf).search("events", {"query": {"term": {"event_type": "nope"}}}).notices.where("code = '[ZERO HITS]'").select("code", "subject")


@query("notice_truncated_total", "SELECT '[TOTAL COUNT TRUNCATED]' AS code, 'lineitem' AS subject FROM (SELECT count(*) AS n FROM lineitem) WHERE n > 10000")
def _(spark, sf):
    return engine(spark, sf).search("lineitem", {"size": 0}).notices.where("code = '[TOTAL COUNT TRUNCATED]'").select("code", "subject")


# --- findings overview ------------------------------------------------------------------------------------

@query("findings_severity", FINDINGS_SQL + " SELECT s.level, rank, count(f.level) AS doc_count FROM scale s LEFT JOIN findings f ON s.level = f.level GROUP BY 1, 2")
def _(spark, sf):
    return overview.severity(findings(spark, sf))


@query("findings_unknown_levels", FINDINGS_SQL + " SELECT level, count(*) AS doc_count FROM findings WHERE level NOT IN (SELECT level FROM scale) GROUP BY 1")
def _(spark, sf):
    return overview.unknown_levels(findings(spark, sf))


@query("findings_agents_topn", FINDINGS_SQL + " SELECT agent, count(*) AS doc_count FROM findings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 15")
def _(spark, sf):
    return overview.top(findings(spark, sf), "agent", 15)


@query("findings_titles_topn", FINDINGS_SQL + " SELECT title, count(*) AS doc_count FROM findings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf):
    return overview.top(findings(spark, sf), "title", 10)


CROSS_SQL = ", ".join(f"count(*) FILTER (WHERE level = '{s}') AS {s}" for s in overview.SEVERITIES)


@query("findings_cross_tab", FINDINGS_SQL + f" SELECT agent, count(*) AS total, {CROSS_SQL}, count(*) FILTER (WHERE level NOT IN (SELECT level FROM scale)) AS other FROM findings GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10")
def _(spark, sf):
    return overview.cross_tab(findings(spark, sf), 10)


@query("findings_categories", FINDINGS_SQL + " SELECT category, count(*) AS doc_count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS pct FROM findings GROUP BY 1")
def _(spark, sf):
    return overview.categories(findings(spark, sf))


HOURS = 24 * 90


@query("findings_overview_window", FINDINGS_SQL + f" SELECT s.level, rank, count(f.level) AS doc_count FROM scale s LEFT JOIN (SELECT * FROM findings WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL {HOURS} HOURS) f ON s.level = f.level GROUP BY 1, 2")
def _(spark, sf):
    as_of = latest(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderdate")
    return engine(spark, sf, as_of=as_of).findings_overview("findings", HOURS)["severity"]


@query("findings_overview_masked", FINDINGS_SQL + f", t AS (SELECT agent AS a, count(*) AS total, {CROSS_SQL}, count(*) FILTER (WHERE level NOT IN (SELECT level FROM scale)) AS other FROM findings WHERE o_orderdate >= (SELECT max(o_orderdate) FROM orders) - INTERVAL {HOURS} HOURS GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10) SELECT {token_sql('HOST', 'a', SALT)} AS agent, * EXCLUDE a FROM t")
def _(spark, sf):
    as_of = latest(spark.read.parquet(f"{sf}/orders.parquet"), "o_orderdate")
    return engine(spark, sf, POLICY, as_of).findings_overview("findings", HOURS)["agents"]


# --- schema and coverage ----------------------------------------------------------------------------------

@query("schema_fields", "SELECT column_name AS field FROM (DESCRIBE SELECT * FROM lineitem)")
def _(spark, sf):
    return engine(spark, sf).schema("lineitem")[0].select("field")


@query("schema_populated", OBSERVED_SQL + ", n AS (SELECT " + ", ".join(f"count({f}) AS {f}" for f in FIELDS) + " FROM observed), u AS (UNPIVOT n ON COLUMNS(*) INTO NAME field VALUE doc_count) SELECT field, doc_count FROM u WHERE doc_count > 0")
def _(spark, sf):
    return engine(spark, sf).schema("observed", only_populated=True)[0]


@query("schema_mapped_empty", OBSERVED_SQL + ", n AS (SELECT " + ", ".join(f"count({f}) AS {f}" for f in FIELDS) + " FROM observed), u AS (UNPIVOT n ON COLUMNS(*) INTO NAME field VALUE doc_count) SELECT field FROM u WHERE doc_count = 0")
def _(spark, sf):
    return engine(spark, sf).schema_empty("observed")


COVERAGE_HOURS = 48
_COUNTS = " UNION ALL ".join(f"SELECT '{f}' AS field, count({f}) FILTER (WHERE ts >= m - INTERVAL {COVERAGE_HOURS} HOURS) AS window_docs, count(*) FILTER (WHERE ts >= m - INTERVAL {COVERAGE_HOURS} HOURS) AS window_total, count({f}) AS total_docs, count(*) AS grand_total FROM observed, newest" for f in FIELDS)
COVERAGE_SQL = OBSERVED_SQL + f""", newest AS (SELECT max(ts) AS m FROM events), counts AS ({_COUNTS}),
  shares AS (SELECT *, 100.0 * window_docs / nullif(window_total, 0) AS w, 100.0 * total_docs / nullif(grand_total, 0) AS t FROM counts),
  rows AS (SELECT *, w - t AS d, coalesce(w, t) AS e, CASE WHEN coalesce(w, t) >= 99 THEN 'complete' WHEN coalesce(w, t) >= 50 THEN 'partial' WHEN coalesce(w, t) > 0 THEN 'sparse' ELSE 'never' END AS category FROM shares)"""


def _coverage(spark, sf, **options):
    as_of = latest(spark.read.parquet(f"{sf}/events.parquet"), "ts")
    return engine(spark, sf, as_of=as_of).field_coverage("observed", hours=COVERAGE_HOURS, **options)


@query("field_coverage", COVERAGE_SQL + """ SELECT field, window_docs, window_total, total_docs, grand_total, round(w, 6) AS window_pct, round(t, 6) AS total_pct, category,
  CASE WHEN window_docs = window_total THEN '100.0%' WHEN w >= 99.95 THEN '99.9%' WHEN w > 0 AND w < 0.05 THEN '<0.1%' ELSE printf('%.1f%%', w) END AS window_label FROM rows""")
def _(spark, sf):
    rows = _coverage(spark, sf)["coverage"]
    return rows.select("field", "window_docs", "window_total", "total_docs", "grand_total", F.round("window_pct", 6).alias("window_pct"), F.round("total_pct", 6).alias("total_pct"), "category", "window_label")


@query("coverage_drift", COVERAGE_SQL + f" SELECT field, round(d, 6) AS drift, printf('%+.1fpp', d) AS drift_label FROM rows WHERE abs(d) > {DRIFT} ORDER BY abs(d) DESC, field LIMIT 10")
def _(spark, sf):
    return _coverage(spark, sf)["drifted"].select("field", F.round("drift", 6).alias("drift"), "drift_label")


@query("coverage_category_counts", COVERAGE_SQL + " SELECT c.category, count(r.field) AS fields FROM (SELECT unnest(['complete', 'partial', 'sparse', 'never', 'unmeasurable']) AS category) c LEFT JOIN rows r USING (category) GROUP BY 1")
def _(spark, sf):
    return _coverage(spark, sf)["categories"]


@query("coverage_min_docs", COVERAGE_SQL + " SELECT field FROM rows WHERE window_docs >= 100")
def _(spark, sf):
    return _coverage(spark, sf, min_docs=100)["coverage"].select("field")


@query("coverage_min_docs_hidden", COVERAGE_SQL + " SELECT count(*) AS hidden, count(*) FILTER (WHERE window_docs = 0) AS hidden_empty FROM rows WHERE window_docs < 100")
def _(spark, sf):
    return _coverage(spark, sf, min_docs=100)["hidden"]


@query("coverage_unmeasurable", OBSERVED_SQL + ", s AS (SELECT * FROM observed ORDER BY event_id LIMIT 10) SELECT 'k_high' AS field, 'unmeasurable' AS category, count(k_high) AS sample_hits, count(*) AS sample_size FROM s UNION ALL SELECT 'never', 'unmeasurable', count(never), count(*) FROM s")
def _(spark, sf):
    facts = spark.createDataFrame([("k_high", 2, 2, 0), ("never", 2, 0, 2), ("amount", 2, 1, 0)], "field string, declared_in long, unindexed_in long, doc_values_disabled_in long")
    return _coverage(spark, sf, facts=facts)["coverage"].where("not measurable").select("field", "category", "sample_hits", "sample_size")


# --- free text --------------------------------------------------------------------------------------------

def masked_text_sql(table: str, keys: str, column: str, types=VALUE_TYPES) -> str:
    sql, name = f"WITH s AS (SELECT {keys}, {column} AS t FROM {table})", "s"
    for i, (family, pattern) in enumerate(types):
        pattern = re2(pattern)
        tok = token_sql(family, "x", SALT)
        cut = f"regexp_split_to_array(t, '{pattern}')"
        found = f"regexp_extract_all(t, '{pattern}')"
        sql += f""", p{i} AS (SELECT {keys}, t, {cut} AS a, list_transform({found}, lambda x: {tok}) AS b FROM {name}),
  q{i} AS (SELECT {keys}, CASE WHEN len(b) = 0 THEN t ELSE list_aggregate(list_transform(list_zip(a, b), lambda z: coalesce(z[1], '') || coalesce(z[2], '')), 'string_agg', '') END AS t FROM p{i})"""
        name = f"q{i}"
    return sql + f" SELECT {keys}, t AS masked FROM {name}"


@query("text_mask_value_types", masked_text_sql("documents", "doc_id", "text"))
def _(spark, sf):
    return spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", mask_values(F.col("text"), SALT).alias("masked"))


@query("text_mask_conversations", masked_text_sql("conversations", "conv_id, turn", "text"))
def _(spark, sf):
    return spark.read.parquet(f"{sf}/conversations.parquet").select("conv_id", "turn", mask_values(F.col("text"), SALT).alias("masked"))


_OPAQUE_SQL = masked_text_sql("customer", "c_custkey, c_name", "'see ' || c_name || ' at host' || c_custkey || '.example.org and 10.0.0.' || (c_custkey % 250)", DEEP_TYPES)


@query("masked_opaque_values", f"SELECT c_custkey, {token_sql('HOST', 'c_name', SALT)} AS known, masked AS embedded FROM ({_OPAQUE_SQL})")
def _(spark, sf):
    customer = spread(spark.read.parquet(f"{sf}/customer.parquet"), "c_custkey")
    key = F.col("c_custkey").cast("string")
    line = F.concat(F.lit("see "), F.col("c_name"), F.lit(" at host"), key, F.lit(".example.org and 10.0.0."), (F.col("c_custkey") % 250).cast("string"))
    opaque = customer.select("c_custkey", F.col("c_name").alias("known"), line.alias("embedded"))
    return mask_opaque_values(opaque, registry(customer, POLICY), POLICY)


@query("text_mask_deep", masked_text_sql("pages", "page_id", "url", DEEP_TYPES))
def _(spark, sf):
    return spark.read.parquet(f"{sf}/pages.parquet").select("page_id", mask_deep(F.col("url"), SALT).alias("masked"))


_LINE_SQL = "'Accepted publickey for ' || {user} || ' from ' || {ip} || ' user=' || {user} || ' did ' || event_type"


@query("text_mask_users", "SELECT event_id, " + _LINE_SQL.format(user=token_sql("USER", "u", SALT), ip=token_sql("IP", "a", SALT)) + " AS masked FROM (SELECT *, 'u' || user_id AS u, '10.0.0.' || (user_id % 250) AS a FROM events)")
def _(spark, sf):
    events = spread(spark.read.parquet(f"{sf}/events.parquet"), "event_id")
    name = F.concat(F.lit("u"), F.col("user_id").cast("string"))
    line = F.concat(F.lit("Accepted publickey for "), name, F.lit(" from 10.0.0."), (F.col("user_id") % 250).cast("string"), F.lit(" user="), name, F.lit(" did "), F.col("event_type"))
    return events.select("event_id", mask_text(line, SALT, F.array(name)).alias("masked"))


_RESIDUAL_SQL = " OR ".join(f"regexp_matches(text, '{p}')" for p in (EMAIL, IPV4, IPV6))


@query("text_residual_scan", f"SELECT source, count(*) AS docs, count(*) FILTER (WHERE {_RESIDUAL_SQL}) AS with_addresses FROM documents GROUP BY 1")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.groupBy("source").agg(F.count(F.lit(1)).alias("docs"), F.count(F.when(residual(F.col("text")), 1)).alias("with_addresses"))


@query("masking_report", "SELECT 'HOST' AS family, 'c_name' AS field, count(*) AS occurrences, count(DISTINCT c_name) AS distinct_values FROM customer UNION ALL SELECT 'USER', 'c_mktsegment', count(*), count(DISTINCT c_mktsegment) FROM customer")
def _(spark, sf):
    return masking_report(spark.read.parquet(f"{sf}/customer.parquet"), POLICY)


@query("masking_examples", f"""WITH v AS (SELECT 'HOST' AS family, 'c_name' AS field, c_name AS v, count(*) AS occurrences FROM customer GROUP BY c_name
    UNION ALL SELECT 'USER', 'c_mktsegment', c_mktsegment, count(*) FROM customer GROUP BY c_mktsegment),
    t AS (SELECT * FROM v QUALIFY row_number() OVER (PARTITION BY family, field ORDER BY occurrences DESC, v) <= 3)
    SELECT family, field, CASE family WHEN 'HOST' THEN {token_sql('HOST', 'v', SALT)} ELSE {token_sql('USER', 'v', SALT)} END AS token, occurrences FROM t""")
def _(spark, sf):
    return masking_examples(spark.read.parquet(f"{sf}/customer.parquet"), POLICY)


# --- personal-data fields ---------------------------------------------------------------------------------

def _hosts(df: DataFrame) -> DataFrame:
    return df.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1).alias("host"))


_VALUE_SQL = f"CASE WHEN regexp_full_match(host, '{EMAIL}') THEN 'EMAIL' WHEN regexp_full_match(host, '{IPV4}') OR regexp_full_match(host, '{IPV6}') THEN 'IP_ADDRESS' WHEN regexp_full_match(host, '{re2(FQDN)}') THEN 'HOSTNAME' END"


@query("gdpr_value_kinds", f"SELECT page_id, host, {_VALUE_SQL} AS kind FROM (SELECT page_id, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) AS host FROM pages)")
def _(spark, sf):
    return _hosts(spark.read.parquet(f"{sf}/pages.parquet")).withColumn("kind", value_kind(F.col("host")))


_EMBED_SQL = " OR ".join(f"regexp_matches(text, '{p}')" for p in (IPV4, IPV6, EMAIL, USER_AUTH_SEARCH, USER_NOUN_SEARCH))


@query("gdpr_freetext_embeds", f"SELECT lang, count(*) FILTER (WHERE {_EMBED_SQL}) AS embeds FROM documents GROUP BY 1")
def _(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    return docs.groupBy("lang").agg(F.count(F.when(embeds_personal_data(F.col("text")), 1)).alias("embeds"))


def _profile(spark, sf):
    """Pages as documents with telling field names and values."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    host = F.regexp_extract("url", "^[a-z]+://([^/?#]*)", 1)
    return pages.select("page_id", F.struct(host.alias("name"), F.concat(F.lit("10.1.2."), (F.col("page_id") % 200).cast("string")).alias("addr")).alias("source"), F.struct(host.alias("domain")).alias("url"), F.concat(F.lit("seen from 10.0.0."), (F.col("page_id") % 200).cast("string")).alias("description"), (F.col("page_id") * 2).alias("size"))


@query("gdpr_classify", "SELECT unnest(['description', 'source.addr', 'source.name', 'url.domain']) AS field, unnest(['FREETEXT', 'IP_ADDRESS', 'HOSTNAME', 'DOMAIN']) AS kind, unnest(['low', 'high', 'medium', 'medium']) AS priority, unnest(['embedded in text', 'sampled values', 'sampled values', 'field name']) AS evidence, unnest(['[USERNAME]', '[IP_ADDRESS]', '[HOSTNAME]', '[HOSTNAME]']) AS suggested_mask, false AS already_configured")
def _(spark, sf):
    return gdpr.classify(_profile(spark, sf), "page_id")


@query("gdpr_scan_hits", "SELECT 'url.domain' AS field, 'DOMAIN' AS kind, 'medium' AS priority")
def _(spark, sf):
    return spark.createDataFrame(gdpr.scan_names(_profile(spark, sf)), "field string, kind string, priority string")


# --- masked copy ------------------------------------------------------------------------------------------

def _sync_window(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    as_of = latest(events, "ts")
    return events, as_of, sync.next_window(as_of - timedelta(hours=47), as_of)


_WINDOW_SQL = "events.ts >= (SELECT max(ts) FROM events) - INTERVAL 48 HOURS"


@query("sync_window", f"SELECT * FROM events WHERE {_WINDOW_SQL}")
def _(spark, sf):
    events, _, window = _sync_window(spark, sf)
    return sync.window_rows(events, "ts", window)


@query("sync_masked_new_only", f"SELECT event_id, {token_sql('USER', 'u', SALT)} AS user_id FROM (SELECT event_id, CAST(user_id AS VARCHAR) AS u FROM events WHERE {_WINDOW_SQL} AND ts > (SELECT max(ts) FROM events) - INTERVAL 30 HOURS)")
def _(spark, sf):
    events, as_of, window = _sync_window(spark, sf)
    target = sync.window_rows(events, "ts", sync.Window(datetime(1970, 1, 1), as_of - timedelta(hours=30)))  # what an earlier run has copied
    rows = sync.new_only(sync.window_rows(events, "ts", window), target, "event_id")
    return rows.select("event_id", token("USER", F.col("user_id"), SALT).alias("user_id"))


def _failing(events: DataFrame) -> DataFrame:
    k = F.get_json_object("props", "$.k").cast("int")
    return events.withColumn("masking_failure", F.when(k > 90, F.format_string("k is %d", k)))


@query("sync_quarantine_split", "SELECT event_id, true AS masking_error, 'raw' AS quarantine_origin, 'k is ' || (props->>'$.k') AS quarantine_reason FROM events WHERE CAST(props->>'$.k' AS INTEGER) > 90")
def _(spark, sf):
    _, bad = sync.split_quarantine(_failing(spark.read.parquet(f"{sf}/events.parquet")), "masking_failure", "raw")
    return bad.select("event_id", "masking_error", "quarantine_origin", "quarantine_reason")


@query("sync_reconcile", "SELECT count(*) AS source, count(*) FILTER (WHERE NOT coalesce(k > 90, false) AND NOT late) AS masked, count(*) FILTER (WHERE k > 90) AS quarantined, count(*) FILTER (WHERE NOT coalesce(k > 90, false) AND late) AS missing FROM (SELECT *, CAST(props->>'$.k' AS INTEGER) AS k, ts > (SELECT max(ts) FROM events) - INTERVAL 1 HOURS AS late FROM events)")
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    good, bad = sync.split_quarantine(_failing(events), "masking_failure", "raw")
    before = sync.Window(datetime(1970, 1, 1), latest(events, "ts") - timedelta(hours=1))  # the last hour has not been copied
    return sync.reconcile(events, sync.window_rows(good, "ts", before), bad, "event_id")


@query("sync_leftovers", "SELECT count(*) FILTER (WHERE CAST(props->>'$.k' AS INTEGER) > 90) AS leftover FROM events")
def _(spark, sf):
    good, bad = sync.split_quarantine(_failing(spark.read.parquet(f"{sf}/events.parquet")), "masking_failure", "raw")
    return sync.leftovers(good.unionByName(bad, allowMissingColumns=True))


@query("sync_retention","SELECT strftime(ts, '%Y-%m-%d') AS day, count(*) AS docs FROM events WHERE ts >= (SELECT max(ts) FROM events) - INTERVAL 7 DAYS GROUP BY 1")
def _(spark, sf):
    events = spark.read.parquet(f"{sf}/events.parquet")
    kept = sync.retain(events, "ts", latest(events, "ts"), 7)
    return kept.groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(F.count(F.lit(1)).alias("docs"))
