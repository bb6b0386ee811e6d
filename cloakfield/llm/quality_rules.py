"""Quality rules with adaptive thresholds from mergeable quantile sketches.

Each (language, source) pair gets a sketch of every metric; sketches merge by adding counts, so the
sketch of a language, or of the whole corpus, is the sum of its parts.  A sketch is a log-linear
histogram: an integer keeps its leading seven bits, which bounds the relative error of any quantile
by 1/64 with at most 64 counters per power of two.  A group's quartiles are blended with its language's, and
those with the corpus's, by numbers of rows, so thresholds move smoothly from the whole to the group as it grows.  Being counts, sketches do not depend on the order
of rows and reruns agree.  All steps are DataFrame functions.

Defined results: a null, empty or blank text has no words, fails the base rules and is not kept.  A
null language or source is a group of its own.  Repeated rows each get the same verdict and count once
each in the sketches.  An empty table gives an empty result.  Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakfield.llm._shared import WS_CHARS, materialize, table, words

WINDOW = 5
#: Rows that a group's parent counts for: a group of n rows has the weight n / (n + PRIOR) in its own quartiles, its language
#: the rest, and a language is blended with the corpus in the same way.
PRIOR = 100
#: A threshold lies SPREAD interquartile ranges outside the quartiles; a range counts as SLACK at least.  In thousandths.
SPREAD = 4
METRICS = {
    # name: (numerator, denominator, slack, has a lower bound)
    "word_length": ("word_chars", "n_words", 500, True),
    "symbols": ("n_symbols", "n_words", 75, False),
    "dup_lines": ("n_dup_lines", "n_lines", 100, False),
    "repeats": ("n_repeat_words", "n_words", 50, False),
}


def _repeat_words(df: DataFrame) -> DataFrame:
    """n_repeat_words from __words: sorts window hashes within the row and measures the union of the repeated windows."""
    w = F.col("__words")
    hashes = F.transform(
        F.sequence(F.lit(0), F.size(w) - WINDOW),
        lambda i: F.struct(F.xxhash64(*[F.get(w, i + k) for k in range(WINDOW)]).alias("h"), i.alias("p")),
    )
    df = df.withColumn("__sorted", F.sort_array(F.when(F.size(w) >= WINDOW, hashes)))
    s = F.col("__sorted")
    same = F.filter(s, lambda x, k: (x["h"] == F.get(s, k - 1)["h"]) | (x["h"] == F.get(s, k + 1)["h"]))
    df = df.withColumn("__at", F.sort_array(F.transform(same, lambda x: x["p"])))
    at = F.col("__at")
    spans = F.transform(at, lambda p, k: F.coalesce(F.least(F.lit(WINDOW), F.get(at, k + 1) - p), F.lit(WINDOW)))
    total = F.aggregate(spans, F.lit(0).cast("long"), lambda a, x: a + x)
    return df.withColumn("n_repeat_words", F.coalesce(total, F.lit(0).cast("long"))).drop("__words", "__sorted", "__at")


def measure(docs: DataFrame, keys: list[str], text: str = "text") -> DataFrame:
    """``keys`` and the base metrics of every whole text, with base_failed."""
    t = F.col("__text")
    lines = F.filter(F.split(t, "\n"), lambda x: F.trim(x, F.lit(WS_CHARS)) != "")
    df = docs.select(*keys, F.coalesce(F.col(text), F.lit("")).alias("__text"))
    df = df.select(
        *keys,
        words(t).alias("__words"),
        F.length(F.translate(t, WS_CHARS, "")).cast("long").alias("word_chars"),
        (F.length(t) - F.length(F.translate(t, "#*$%&|<>", ""))).cast("long").alias("n_symbols"),
        lines.alias("__lines"),
    )
    df = df.withColumn("n_lines", F.size("__lines").cast("long"))
    df = df.withColumn("n_dup_lines", (F.col("n_lines") - F.size(F.array_distinct("__lines"))).cast("long")).drop("__lines")
    df = _repeat_words(df.withColumn("n_words", F.size("__words").cast("long")))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    return df.withColumn("base_failed", failed)


def _bucket(v: Column) -> Column:
    """Keeps the leading seven bits."""
    shift = F.greatest(F.length(F.bin(v)) - 7, F.lit(0))
    return v - F.pmod(v, F.call_function("shiftleft", F.lit(1).cast("bigint"), shift))


def _value(name: str) -> Column:
    top, bottom, _, _ = METRICS[name]
    return F.floor(1000 * F.col(top) / F.greatest(F.col(bottom), F.lit(1))).cast("long")


def sketches(measured: DataFrame) -> DataFrame:
    """Rows (lang, source, metric, bucket, n): one sketch for each group and metric, over the texts that pass the base rules."""
    one = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), _bucket(_value(m)).alias("bucket")) for m in METRICS])).alias("x")
    rows = measured.where(~F.col("base_failed")).select("lang", "source", one)
    return rows.groupBy("lang", "source", F.col("x.metric").alias("metric"), F.col("x.bucket").alias("bucket")).agg(F.count(F.lit(1)).alias("n"))


def _blend(n: Column, own: Column, parent: Column) -> Column:
    """A whole number between a quartile and its parent's, by weight."""
    return F.floor((n * own + PRIOR * parent) / (n + PRIOR)).cast("bigint")


def thresholds(sketch: DataFrame) -> DataFrame:
    """Rows (lang, source, lo_*, hi_*) for each group, from its quartiles blended with its language's, and those with the corpus's."""
    merged = (
        sketch.withColumn("lv", F.lit(0))
        .unionByName(sketch.withColumn("lv", F.lit(1)).withColumn("source", F.lit(None).cast("string")))
        .unionByName(sketch.withColumn("lv", F.lit(2)).withColumn("source", F.lit(None).cast("string")).withColumn("lang", F.lit(None).cast("string")))
        .groupBy("lv", "lang", "source", "metric", "bucket")
        .agg(F.sum("n").alias("n"))
    )
    group = Window.partitionBy("lv", "lang", "source", "metric")
    upto = group.orderBy("bucket").rowsBetween(Window.unboundedPreceding, 0)
    ranked = merged.withColumn("upto", F.sum("n").over(upto)).withColumn("all", F.sum("n").over(group))
    quart = ranked.groupBy("lv", "lang", "source", "metric").agg(
        F.first("all").alias("rows"),
        F.min(F.when(4 * F.col("upto") >= F.col("all"), F.col("bucket"))).alias("q1"),
        F.min(F.when(4 * F.col("upto") >= 3 * F.col("all"), F.col("bucket"))).alias("q3"),
    )
    corpus = {r["metric"]: r for r in quart.where("lv = 2").collect()}  # a row a metric
    # without a sketch there is no group either
    whole = {q: F.create_map(*[F.lit(x) for m in METRICS for x in (m, corpus[m][q] if corpus else 0)])[F.col("metric")] for q in ("q1", "q3")}
    lang = quart.where("lv = 1").select(F.col("lang").alias("l_lang"), F.col("metric").alias("l_metric"), *[_blend(F.col("rows"), F.col(q), whole[q]).alias(f"l_{q}") for q in ("q1", "q3")])
    own = quart.where("lv = 0").join(lang, F.col("lang").eqNullSafe(F.col("l_lang")) & (F.col("metric") == F.col("l_metric")))
    own = own.select("lang", "source", "metric", *[_blend(F.col("rows"), F.col(q), F.col(f"l_{q}")).alias(q) for q in ("q1", "q3")])
    slack = F.create_map(*[F.lit(x) for m, v in METRICS.items() for x in (m, v[2])])
    reach = SPREAD * F.greatest(F.col("q3") - F.col("q1"), slack[F.col("metric")])
    bounds = own.withColumn("lo", F.col("q1") - reach).withColumn("hi", F.col("q3") + reach)
    wide = bounds.groupBy("lang", "source").agg(*[F.max(F.when(F.col("metric") == m, F.col(e))).alias(f"{e}_{m}") for m in METRICS for e in ("lo", "hi")])
    return wide.select(F.col("lang").alias("t_lang"), F.col("source").alias("t_source"), F.struct(*[F.col(f"{e}_{m}") for m in METRICS for e in ("lo", "hi")]).alias("cut"))


def verdicts(measured: DataFrame, cuts: DataFrame) -> DataFrame:
    """Adds kept: the text passes the base rules and lies inside its group's thresholds.

    The table of thresholds has one row a group; Spark broadcasts it only while its measured size is
    under the session's threshold, and otherwise joins by shuffle with skewed groups split.
    """
    joined = measured.join(cuts, measured["lang"].eqNullSafe(cuts["t_lang"]) & measured["source"].eqNullSafe(cuts["t_source"]), "left")
    inside = F.lit(True)
    for m, (_, _, _, lower) in METRICS.items():
        inside = inside & (_value(m) <= F.col(f"cut.hi_{m}"))
        if lower:
            inside = inside & (_value(m) >= F.col(f"cut.lo_{m}"))
    return joined.withColumn("kept", ~F.col("base_failed") & F.coalesce(inside, F.lit(True))).drop("t_lang", "t_source", "cut")


def quality_rules(docs: DataFrame) -> DataFrame:
    """Metrics and verdict of every document.

    Every text is measured once: the measures, a few numbers a document, go to the shared folder and
    serve both the sketches and the verdicts.
    """
    measured = materialize(measure(docs, ["doc_id", "lang", "source"]), "quality")
    return verdicts(measured, thresholds(sketches(measured)))


def keep_quality(docs: DataFrame) -> DataFrame:
    """The input's rows that the rules keep."""
    marked = docs.withColumn("__mark", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    measured = materialize(measure(marked, ["doc_id", "__mark", "lang", "source"]), "quality")
    kept = verdicts(measured, thresholds(sketches(measured))).where("kept")
    kept = kept.select(F.col("doc_id").alias("k_id"), F.col("__mark").alias("k_mark"), F.col("lang").alias("k_lang"), F.col("source").alias("k_source"))
    same = [marked[a].eqNullSafe(kept[b]) for a, b in (("doc_id", "k_id"), ("__mark", "k_mark"), ("lang", "k_lang"), ("source", "k_source"))]
    return marked.join(kept, same, "left_semi").select(*docs.columns)


def query(spark, sf_dir):
    out = quality_rules(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def _oracle() -> str:
    """The same rules in DuckDB."""
    value = lambda m: f"CAST(floor(1000 * {METRICS[m][0]} / greatest({METRICS[m][1]}, 1)) AS BIGINT)"
    ones = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS metric, {value(m)} AS v FROM m WHERE NOT base_failed" for m in METRICS)
    slack = "CASE metric " + " ".join(f"WHEN '{m}' THEN {v[2]}" for m, v in METRICS.items()) + " END"
    edges = ", ".join(f"max({e}) FILTER (WHERE metric = '{m}') AS {e}_{m}" for m in METRICS for e in ("lo", "hi"))
    blend = lambda q, n, parent: f"({n} * {q} + {PRIOR} * {parent}) // ({n} + {PRIOR})"
    tests = " AND ".join(f"{value(m)} <= hi_{m}" + (f" AND {value(m)} >= lo_{m}" if v[3] else "") for m, v in METRICS.items())
    return rf"""
WITH d AS (SELECT doc_id, lang, source, coalesce(text, '') AS t FROM documents),
w AS (SELECT *, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS w, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM d),
each AS (SELECT doc_id, unnest(w) AS x, generate_subscripts(w, 1) AS i FROM w),
windows AS (SELECT doc_id, i, concat_ws(' ', x, lead(x, 1) OVER o, lead(x, 2) OVER o, lead(x, 3) OVER o, lead(x, 4) OVER o) AS g, lead(x, 4) OVER o IS NOT NULL AS whole FROM each WINDOW o AS (PARTITION BY doc_id ORDER BY i)),
grams AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS n FROM windows WHERE whole),
covered AS (SELECT doc_id, count(DISTINCT p) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2, i + 3, i + 4]) AS p FROM grams WHERE n > 1) GROUP BY 1),
b AS (SELECT w.doc_id, lang, source, len(w) AS n_words, coalesce(CAST(list_sum(list_transform(w, lambda x: length(x))) AS BIGINT), 0) AS word_chars,
  len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, len(l) AS n_lines, len(l) - len(list_distinct(l)) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words FROM w LEFT JOIN covered USING (doc_id)),
m AS MATERIALIZED (SELECT *, n_words < 10 OR 100 * n_repeat_words > 20 * n_words AS base_failed FROM b),
ones AS ({ones}),
leaf AS (SELECT lang, source, metric, v - v % (1::BIGINT << greatest(length(bin(v)) - 7, 0)) AS bucket, count(*) AS n FROM ones GROUP BY 1, 2, 3, 4),
merged AS (SELECT 0 AS lv, * FROM leaf UNION ALL SELECT 1, lang, NULL, metric, bucket, sum(n) FROM leaf GROUP BY 2, 4, 5 UNION ALL SELECT 2, NULL, NULL, metric, bucket, sum(n) FROM leaf GROUP BY 4, 5),
ranked AS (SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, metric ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lv, lang, source, metric) AS every FROM merged),
quart AS (SELECT lv, lang, source, metric, any_value(every) AS n, min(bucket) FILTER (WHERE 4 * upto >= every) AS q1, min(bucket) FILTER (WHERE 4 * upto >= 3 * every) AS q3 FROM ranked GROUP BY 1, 2, 3, 4),
langs AS (SELECT l.lang, l.metric, {blend("l.q1", "l.n", "c.q1")} AS q1, {blend("l.q3", "l.n", "c.q3")} AS q3 FROM quart l JOIN quart c ON l.lv = 1 AND c.lv = 2 AND l.metric = c.metric),
own AS (SELECT o.lang, o.source, o.metric, {blend("o.q1", "o.n", "l.q1")} AS q1, {blend("o.q3", "o.n", "l.q3")} AS q3 FROM quart o JOIN langs l ON o.lv = 0 AND o.metric = l.metric AND o.lang IS NOT DISTINCT FROM l.lang),
bounds AS (SELECT *, q1 - {SPREAD} * greatest(q3 - q1, {slack}) AS lo, q3 + {SPREAD} * greatest(q3 - q1, {slack}) AS hi FROM own),
wide AS (SELECT lang, source, {edges} FROM bounds GROUP BY 1, 2)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND coalesce({tests}, true) AS kept
FROM m LEFT JOIN wide a ON a.lang IS NOT DISTINCT FROM m.lang AND a.source IS NOT DISTINCT FROM m.source
"""


ORACLE = _oracle()
