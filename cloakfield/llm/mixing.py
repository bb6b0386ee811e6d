"""Mixing sources to target weights along a curriculum.

Every source has a weight that moves in time; its integral over training is the source's share of the
words.  Water-filling turns shares into targets: no source gives more than ``max_repeats`` times its
words, and what it cannot give is reshared by weight among the others.  Documents stand in a hashed order
within their source; the running sum of their sizes, read as cumulative demand, is inverted through the
integral of the schedule and gives each taken copy its time, and time its position in training: the share of
all words of the mix that are seen by then.  All steps are DataFrame functions and depend on the rows alone,
so reruns agree.  The plan of sources is made over one row a source, in one task: it is meant for sources that
a person can weigh, up to some millions.

Defined results: a null or blank text has size 0 and is never taken.  A null source is a source, last in
order.  Rows that repeat are rows of their own, each with its own place in the order.  Empty tables give empty
results; other columns are ignored by :func:`plan_mix` and kept by :func:`mix`.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakfield.llm._shared import WORD, materialize, running, table

#: Mean weights of the sources in code point order, repeating, and how far each moves from its mean over training.
WEIGHTS = (5.0, 2.0, 1.0)
TILTS = (-0.5, 0.0, 0.5)


def source_targets(sizes: DataFrame, share: float = 1.5, max_repeats: float = 2.0, weights=WEIGHTS, tilts=TILTS) -> DataFrame:
    """Rows (source, source_size, target, tilt, drift), from rows (source, size); drift is the tilt of all sources together.

    A source's cap over its weight is the level at which it is full.  In the order of that level, the
    first source that the remaining budget does not fill sets the level of all that follow.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    every = Window.orderBy(F.col("source").asc_nulls_last())  # over one row a source
    pick = (F.row_number().over(every) - 1) % len(weights)
    at = lambda xs: F.element_at(F.array(*[F.lit(float(x)) for x in xs]), pick + 1)
    per = per.withColumn("weight", at(weights)).withColumn("tilt", at(tilts)).withColumn("cap", F.col("source_size") * F.lit(max_repeats))
    per = per.withColumn("full_at", F.col("cap") / F.col("weight"))
    order = Window.orderBy("full_at", F.col("source").asc_nulls_last())
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(0, Window.unboundedFollowing)
    budget = F.lit(share) * F.sum("source_size").over(Window.partitionBy())
    level = (budget - F.coalesce(F.sum("cap").over(before), F.lit(0.0))) / F.sum("weight").over(after)
    per = per.withColumn("level", level)
    common = F.max(F.when(F.col("level") <= F.col("full_at"), F.col("level"))).over(Window.partitionBy())
    target = F.least(F.col("cap"), F.coalesce(common * F.col("weight"), F.col("cap")))
    per = per.withColumn("target", target)
    every = Window.partitionBy().orderBy(F.col("source").asc_nulls_last()).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    drift = F.coalesce(F.sum(F.col("target") * F.col("tilt")).over(every) / F.nullif(F.sum("target").over(every), F.lit(0.0)), F.lit(0.0))
    return per.select("source", "source_size", "target", "tilt", drift.alias("drift"))


def _position(share: Column, tilt: Column, drift: Column) -> Column:
    """The share of all words seen when a source has given ``share`` of its own.

    A source of weight 1 + tilt * (2t - 1) has given t + tilt * (t*t - t) at time t in [0, 1]; its inverse
    gives t, and the same integral with the tilt of all sources gives the words seen by t.
    """
    b = 1 - tilt
    t = 2 * share / (b + F.sqrt(b * b + 4 * tilt * share))
    return t + drift * (t * t - t)


def place(doc_id: Column, text: Column) -> Column:
    """A document's place in the order of its source: 60 bits of a hash that SQL engines share."""
    name = F.concat_ws(":", F.lit("mix"), F.coalesce(doc_id.cast("string"), F.lit("")), F.md5(F.encode(text, "UTF-8")))
    return F.conv(F.substring(F.md5(F.encode(name, "UTF-8")), 1, 15), 16, 10).cast("bigint")


def plan_mix(docs: DataFrame, share: float = 1.5, max_repeats: int = 2, weights=WEIGHTS, tilts=TILTS) -> DataFrame:
    """Rows (doc_id, source, mark, size, source_size, target, taken, positions), one for each document; positions has one training position a taken copy."""
    text = F.coalesce(F.col("text"), F.lit(""))
    size = F.regexp_count(text, F.lit(WORD)).cast("bigint")
    rows = docs.select("doc_id", "source", F.xxhash64(text).alias("mark"), size.alias("size"), place(F.col("doc_id"), text).alias("place"))
    rows = materialize(rows, "mix")
    targets = source_targets(rows, share, max_repeats, weights, tilts)
    rows = running(rows, "source", "place", ["doc_id", "mark"], "size", "before", rows.count())
    t = targets.withColumnRenamed("source", "t_source")
    rows = rows.join(t, rows["source"].eqNullSafe(t["t_source"]))
    middle = [F.lit(k) * F.col("source_size") + F.col("before") + F.col("size") / 2 for k in range(max_repeats)]
    spots = F.array(*[F.when((F.col("size") > 0) & (m < F.col("target")), _position(m / F.col("target"), F.col("tilt"), F.col("drift"))) for m in middle])
    rows = rows.withColumn("positions", F.array_compact(spots))
    taken = F.size("positions") * F.col("size")
    return rows.select("doc_id", "source", "mark", "size", "source_size", F.col("target").cast("double").alias("target"), taken.alias("taken"), "positions")


def _numbered(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Adds ``__n``, which tells rows with equal keys apart."""
    return rows.withColumn("__n", F.row_number().over(Window.partitionBy(*keys).orderBy(F.lit(0))))


def mix(docs: DataFrame, **options) -> DataFrame:
    """The input's rows as the mix takes them: repeated or left out, with ``__position``, range-sorted by it."""
    plan = plan_mix(docs, **options).select(F.col("doc_id").alias("__id"), F.col("mark").alias("__m"), F.col("source").alias("__s"), F.col("positions").alias("__positions"))
    keys, own = ["__id", "__m", "__s"], ["doc_id", "__mark", "source"]
    plan = materialize(_numbered(plan, keys).withColumn("__copies", F.count(F.lit(1)).over(Window.partitionBy(*keys))), "mix-plan")
    marked = docs.withColumn("__mark", F.xxhash64(F.coalesce(F.col("text"), F.lit(""))))
    same = reduce(Column.__and__, [marked[a].eqNullSafe(plan[b]) for a, b in zip(own, keys)])
    taken = marked.join(plan.where((F.col("__copies") == 1) & (F.size("__positions") > 0)), same).select(*docs.columns, "__positions")
    repeated = plan.where("__copies > 1")
    if not repeated.isEmpty():  # rows that are equal in id, text and source: the texts of these alone are numbered
        rows = _numbered(marked.join(repeated.where("__n = 1").select(*keys), same, "left_semi"), own)
        repeated = repeated.withColumnRenamed("__n", "__k")
        taken = taken.unionByName(rows.join(repeated, same & (F.col("__n") == F.col("__k"))).select(*docs.columns, "__positions"))
    taken = taken.withColumn("__position", F.explode("__positions")).drop("__positions")
    return taken.repartitionByRange("__position").sortWithinPartitions("__position")


def query(spark, sf_dir):
    plan = plan_mix(table(spark, sf_dir, "documents"))
    first, again = (F.round(F.get("positions", i), 9).alias(name) for i, name in enumerate(("position", "repeat_position")))
    plan = plan.select("doc_id", "size", "source_size", "target", "taken", first, again)
    # documents of no position stand last, spread by id
    return plan.repartitionByRange(F.col("position").asc_nulls_last(), "doc_id").sortWithinPartitions(F.col("position").asc_nulls_last(), "doc_id")


ORACLE = r"""
WITH d AS (SELECT doc_id, source, coalesce(text, '') AS t FROM documents),
rows AS (SELECT doc_id, source, CAST(len(regexp_extract_all(t, '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(t)), 1, 15) AS BIGINT) AS place FROM d),
per AS (SELECT source, sum(size)::DOUBLE AS s, [5.0, 2.0, 1.0][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS w,
  [-0.5, 0.0, 0.5][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1]::DOUBLE AS tilt FROM rows GROUP BY source),
caps AS (SELECT *, 2 * s AS cap, 2 * s / w AS full_at FROM per),
levels AS (SELECT *, (1.5 * sum(s) OVER () - coalesce(sum(cap) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
  / sum(w) OVER (ORDER BY full_at, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM caps),
targets AS (SELECT source, s, tilt, least(cap, coalesce(max(CASE WHEN level <= full_at THEN level END) OVER () * w, cap)) AS target FROM levels),
drifts AS (SELECT *, coalesce(sum(target * tilt) OVER () / nullif(sum(target) OVER (), 0), 0) AS drift FROM targets),
placed AS (SELECT r.*, t.s, t.target, t.tilt, t.drift, sum(size) OVER (PARTITION BY r.source ORDER BY place, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) - size AS before
  FROM rows r JOIN drifts t ON r.source IS NOT DISTINCT FROM t.source),
shares AS (SELECT *, CASE WHEN size > 0 AND before + size / 2 < target THEN (before + size / 2) / target END AS a, CASE WHEN size > 0 AND s + before + size / 2 < target THEN (s + before + size / 2) / target END AS b FROM placed),
times AS (SELECT *, 2 * a / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * a)) AS t, 2 * b / ((1 - tilt) + sqrt((1 - tilt) * (1 - tilt) + 4 * tilt * b)) AS u FROM shares)
SELECT doc_id, size, CAST(s AS BIGINT) AS source_size, target, size * (CAST(a IS NOT NULL AS BIGINT) + CAST(b IS NOT NULL AS BIGINT)) AS taken,
  round(t + drift * (t * t - t), 9) AS position, round(u + drift * (u * u - u), 9) AS repeat_position
FROM times
"""
