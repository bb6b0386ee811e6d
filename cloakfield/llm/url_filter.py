"""URL filtering: rules first, gradient-boosted trees on lexical features for the rest.

A rule names a host, with all its subdomains, and the start of a path; the longest rule that fits decides.
Other URLs go to gradient-boosted trees over lexical features: length, depth, digit ratio, character
entropy, parameter counts, host shape, and statistics of the host's suffixes, the path's first segment and
its extension.  A statistic is the smoothed share of blocked URLs among all labelled URLs with that value.
Trees are trained on a hashed sample of the labelled URLs of about ``TRAIN_ROWS`` rows; the statistics count
all of them, in training all but those of the row's own fold.  Labels come with the call.  No table of the query has URL labels, so the query trains on
:func:`seed_urls`, a labelled set made by rule whose classes overlap in every trait.  Features, rules and predictions are DataFrame functions and
JVM models throughout.

Defined results: a null URL, or one without ``://``, has an empty host and path, fits no rule and is judged
by the method like any other.  Without labels of both kinds every URL that no rule fits is allowed.
Repeated rows each get the same verdict.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakfield.llm._shared import ascii_lower, materialize, table

#: Rules of the registered query.
RULES = (
    ("allow", "com/"),
    ("block", "example.com/en/"),
    ("allow", "www.example.com/en/"),
    ("block", "net/es/"),
    ("block", "net/fr/"),
)
#: Rules are literals of the plan; more than this many belong in a table.
MOST_RULES = 500
#: Bound of the training sample.
TRAIN_ROWS = 20_000
TREES, DEPTH, SEED = 12, 3, 7
#: Weight of the overall share in a statistic.
PRIOR = 20.0
#: Parts of the labelled rows; a training row's statistics come from the other parts.
FOLDS = 4
STATISTICS = ("suffix1", "suffix2", "segment", "extension")


#: Suffixes of the seed set with their weights among allowed and blocked URLs: all occur in both.
SUFFIXES = (
    ("com", 8, 4), ("org", 6, 2), ("net", 4, 3), ("edu", 5, 1), ("io", 5, 1), ("co.uk", 5, 1), ("fr", 5, 1), ("de", 5, 1),
    ("info", 1, 4), ("biz", 1, 4), ("top", 1, 6), ("xyz", 1, 6), ("site", 1, 6), ("club", 1, 6),
)
#: Weights of a count of 0, 1, 2, ... among allowed and among blocked seed URLs.
HYPHENS = ((12, 3, 1), (2, 4, 5, 3))
HOST_DIGITS = ((14, 1, 1), (2, 2, 3, 4, 4))
SUBDOMAINS = ((8, 6, 1), (3, 4, 5, 3))
SEGMENTS = ((2, 5, 5, 2, 1), (1, 1, 2, 3, 5, 6))
PARAMETERS = ((14, 4, 1, 1), (2, 1, 3, 4, 4, 4))
PATH_DIGITS = ((5, 3, 3, 2, 1, 1), (1, 1, 2, 2, 3, 4, 4, 4))
PLAIN = ((1, 8), (3, 1))
EXTENSIONS = (("", 10, 6), (".html", 5, 2), (".htm", 1, 1), (".pdf", 2, 1), (".php", 2, 5), (".zip", 1, 2), (".exe", 1, 3))
SEEDS = 8_192


def seed_urls(spark) -> DataFrame:
    """Labelled URLs (url, label), made by rule from random names: each trait is drawn from its class's weights.

    Hyphens, digits, labels, depth, parameters, suffix, extension and scheme occur in both classes, in other
    shares, so that no one of them decides.  Names are random letters; no word or host is given.
    """
    k = F.col("id")
    h = lambda name: F.shiftrightunsigned(F.xxhash64(F.lit(name), k), 8)
    draw = lambda name, values, weights: F.get(F.array(*[F.lit(v) for v, w in zip(values, weights) for _ in range(w)]), F.pmod(h(name), F.lit(sum(weights))).cast("int"))
    both = lambda of: F.when(F.col("label") == 1, of(1)).otherwise(of(0))
    count = lambda name, weights: both(lambda c: draw(name, range(len(weights[c])), weights[c]))
    choice = lambda name, rows: both(lambda c: draw(name, [r[0] for r in rows], [r[1 + c] for r in rows]))
    word = lambda name: F.translate(F.substr(F.conv(h(name).cast("string"), 10, 16), F.lit(1), F.pmod(h(name + "n"), F.lit(6)) + 3), "0123456789ABCDEF", "aeioulnrstmdpbcg")
    number = lambda name, n: F.substr(h(name).cast("string"), F.lit(3), n)
    many = lambda name, n, most, each: F.concat(*[F.when(n > i, each(f"{name}{i}")).otherwise("") for i in range(most)])
    host = F.concat(
        many("sub", count("subs", SUBDOMAINS), 3, lambda x: F.concat(word(x), F.lit("."))),
        word("name"), many("part", count("hyphens", HYPHENS), 3, lambda x: F.concat(F.lit("-"), word(x))), number("nh", count("host", HOST_DIGITS)),
        F.lit("."), choice("suffix", SUFFIXES),
    )
    path = F.concat(
        F.lit("/"), many("segment", count("segments", SEGMENTS), 5, lambda x: F.concat(word(x), F.lit("/"))),
        number("np", count("digits", PATH_DIGITS)), choice("extension", EXTENSIONS),
    )
    parameters = many("p", count("parameters", PARAMETERS), 5, lambda x: F.concat(F.lit("?" if x == "p0" else "&"), word(x), F.lit("="), number("v" + x, F.lit(4))))
    url = F.concat(F.when(count("plain", PLAIN) == 0, "http://").otherwise("https://"), host, path, parameters, F.when(h("end") % 8 == 0, "#top").otherwise(""))
    return spark.range(SEEDS).withColumn("label", (k % 2).cast("double")).select(url.alias("url"), "label")


def split_url(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL."""
    rest = F.coalesce(F.regexp_extract(url, "^(?s:.*?)://((?s:.*))$", 1), F.lit(""))
    host = ascii_lower(F.regexp_extract(rest, "^[^/?#]*", 0))
    return host, F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def match_rules(df: DataFrame, rules=RULES) -> DataFrame:
    """Adds rule and rule_verdict, null where no rule fits; needs host and path."""
    if len(rules) > MOST_RULES:
        raise ValueError(f"{len(rules)} rules; at most {MOST_RULES} can be literals of a plan")
    fit = rule = None
    for verdict, text in sorted(rules, key=lambda r: (-len(r[1]), r[1])):
        host, slash, path = text.partition("/")
        test = ((F.col("host") == host) | F.col("host").endswith("." + host)) & F.col("path").startswith(slash + path)
        fit = F.when(test, verdict) if fit is None else fit.when(test, verdict)
        rule = F.when(test, text) if rule is None else rule.when(test, text)
    none = F.lit(None).cast("string")
    return df.withColumn("rule", rule if rules else none).withColumn("rule_verdict", fit if rules else none)


def _let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often ``body`` uses it."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _entropy(c: Column) -> Column:
    """Shannon entropy of the characters, in bits: in sorted order a run ends where the next character differs."""

    def of_ends(ends: Column) -> Column:
        n = F.element_at(ends, -1)
        runs = F.transform(ends, lambda e, i: (e - F.coalesce(F.get(ends, i - 1), F.lit(0))) / n)
        return F.aggregate(runs, F.lit(0.0), lambda a, p: a - p * F.log2(p))

    def ends_of(chars: Column) -> Column:
        ends = F.transform(chars, lambda x, i: F.when(F.coalesce(x != F.get(chars, i + 1), F.lit(True)), i + 1))
        return _let(F.array_compact(ends), of_ends)

    return F.when(F.length(c) > 0, _let(F.sort_array(F.split(c, "")), ends_of)).otherwise(0.0)


def lexical_features(df: DataFrame) -> DataFrame:
    """Adds the lexical features and the keys of the statistics; needs url, host and path."""
    url = F.coalesce(F.col("url"), F.lit(""))
    n = F.greatest(F.length(url), F.lit(1))
    labels = F.split("host", r"\.")
    query = F.regexp_extract(url, r"\?([^#]*)", 1)
    digits = F.length(F.regexp_replace(url, r"[^0-9]", ""))
    numbers = {
        "f_length": F.length(url),
        "f_host_length": F.length("host"),
        "f_host_labels": F.size(labels),
        "f_host_hyphens": F.length("host") - F.length(F.translate("host", "-", "")),
        "f_depth": F.length("path") - F.length(F.translate("path", "/", "")),
        "f_path_length": F.length("path"),
        "f_digit_ratio": digits / n,
        "f_symbol_ratio": F.length(F.regexp_replace(url, r"[A-Za-z0-9]", "")) / n,
        "f_entropy": _entropy(url),
        "f_host_entropy": _entropy(F.col("host")),
        "f_parameters": F.when(query == "", 0).otherwise(F.size(F.split(query, "&"))),
        "f_query_length": F.length(query),
        "f_fragment": F.contains(url, F.lit("#")).cast("int"),
        "f_secure": F.startswith(url, F.lit("https:")).cast("int"),
    }
    keys = {
        "suffix1": F.substring_index("host", ".", -1),
        "suffix2": F.substring_index("host", ".", -2),
        "segment": F.get(F.split("path", "/"), 1),
        "extension": F.regexp_extract("path", r"\.([A-Za-z0-9]+)/?$", 1),
    }
    return df.withColumns({k: v.cast("double") for k, v in numbers.items()} | {k: F.coalesce(v, F.lit("")) for k, v in keys.items()})


def _fold() -> Column:
    return F.pmod(F.xxhash64(F.lit("fold"), "url"), F.lit(FOLDS))


def _with_statistics(rows: DataFrame, labelled: DataFrame, share: float, own: bool = False) -> DataFrame:
    """Adds s_* and c_*: the smoothed blocked share and the count of each key among the labelled rows.

    With ``own`` the rows are labelled ones themselves, and those of a row's own fold do not count: a key that
    one URL alone has would otherwise tell its label.
    """
    for key in STATISTICS:
        values = (F.count(F.lit(1)).alias("n"), F.sum("label").alias("b"))
        if own:
            every = Window.partitionBy("__key")
            stats = labelled.groupBy(F.col(key).alias("__key"), _fold().alias("__fold")).agg(*values)
            stats = stats.withColumns({c: F.sum(c).over(every) - F.col(c) for c in ("n", "b")})
            on = (rows[key] == stats["__key"]) & (_fold() == stats["__fold"])
        else:
            stats = labelled.groupBy(F.col(key).alias("__key")).agg(*values)
            on = rows[key] == stats["__key"]
        smooth = (F.coalesce("b", F.lit(0.0)) + PRIOR * share) / (F.coalesce("n", F.lit(0)) + PRIOR)
        rows = rows.join(stats, on, "left")
        rows = rows.withColumn(f"s_{key}", smooth).withColumn(f"c_{key}", F.log1p(F.coalesce("n", F.lit(0)).cast("double"))).drop("__key", "__fold", "n", "b")
    return rows


def _parts(urls: DataFrame, *keep: str) -> DataFrame:
    host, path = split_url(F.col("url"))
    return urls.select(*keep, "url").withColumn("host", host).withColumn("path", path)


def feature_names(rows: DataFrame) -> list[str]:
    """The features of the trees, in the order of the model's feature importances."""
    return [c for c in rows.columns if c.startswith("f_")] + [f"{x}_{k}" for k in STATISTICS for x in ("s", "c")]


def _fit(put: VectorAssembler, known: DataFrame, n: int, share: float) -> GBTClassificationModel:
    """The trees of n labelled rows with features, fitted on their hashed sample."""
    rate = min(1.0, TRAIN_ROWS / n)
    sample = known.where(F.pmod(F.xxhash64(F.lit("train"), "url"), F.lit(1 << 20)) < int(rate * (1 << 20)))
    train = put.transform(_with_statistics(sample, known, share, own=True)).select("__features", "label")
    trees = GBTClassifier(featuresCol="__features", labelCol="label", maxIter=TREES, maxDepth=DEPTH, seed=SEED)
    return trees.fit(materialize(train.repartition(8), "url-train"))


def url_filter(urls: DataFrame, key: str, labelled: DataFrame | None = None, rules=RULES) -> DataFrame:
    """Rows (key, url, host, path, rule, verdict, score): every URL judged.

    ``labelled`` has url and label (1.0: block); without it the rules' own verdicts are the labels.
    score is the method's probability that the URL is to be blocked.
    """
    judged = match_rules(_parts(urls, key), rules)
    rows = materialize(lexical_features(judged), "urls")
    if labelled is None:
        known = rows.where(F.col("rule").isNotNull()).withColumn("label", (F.col("rule_verdict") == "block").cast("double"))
    else:
        known = materialize(lexical_features(_parts(labelled, "label")).withColumn("label", F.col("label").cast("double")), "labelled-urls")
    n, blocked = known.agg(F.count(F.lit(1)), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    if not 0 < blocked < n:
        allowed = rows.withColumn("score", F.lit(0.0))
        return allowed.select(key, "url", "host", "path", "rule", F.coalesce("rule_verdict", F.lit("allow")).alias("verdict"), "score")

    put = VectorAssembler(inputCols=feature_names(rows), outputCol="__features")
    model = _fit(put, known, n, blocked / n)
    scored = model.transform(put.transform(_with_statistics(rows, known, blocked / n)))
    scored = scored.withColumn("score", F.get(vector_to_array("probability"), 1))
    verdict = F.coalesce("rule_verdict", F.when(F.col("score") > 0.5, "block").otherwise("allow"))
    return scored.select(key, "url", "host", "path", "rule", verdict.alias("verdict"), "score")


def query(spark, sf_dir):
    return url_filter(table(spark, sf_dir, "pages"), "page_id", seed_urls(spark)).select("page_id", "host", "path", "rule", "verdict", "score")
