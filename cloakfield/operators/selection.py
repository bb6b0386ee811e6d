"""Exact percentiles by distributed selection.

A first pass takes a sketch of the values, whose splitters bound where each wanted rank must lie; a second pass counts
what is below those bounds and looks only at the values inside, a small part of all, by value.  Where more than
``ENOUGH`` rows of a group are left inside, the sketch is taken again of them alone, which narrows some hundred times
a pass.  No task ever holds the distinct values of a group; equal values are one row whatever their number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Splitters of a sketch, its accuracy, and the rows of a group that one task may put in order.
GRID, ACCURACY, ENOUGH = 512, 10_000, 1_000_000


def exact_percentiles(df: DataFrame, value: Column, percents: dict[str, float], by: list[str] | None = None, enough: int = ENOUGH, grid: int = GRID) -> DataFrame:
    """Rows (by..., a column for each of ``percents``): percentiles in percent, interpolated between neighbours as ``percentile`` does.

    Nulls do not count; a group without values has nulls.  Runs one small job a pass to see whether it is the last.
    """
    by = by or []
    keys = [f"__k{i}" for i in range(len(by))]
    rows = df.select(*[F.col(f"`{b}`").alias(k) for b, k in zip(by, keys)], value.cast("double").alias("__v")).where(F.col("__v").isNotNull())
    steps = [i / grid for i in range(grid + 1)]
    sketch = lambda c: F.percentile_approx(c, steps, ACCURACY)
    grouped = lambda d: d.groupBy(*keys) if keys else d.groupBy()
    names = list(percents)
    # the ranks below and above each percentile, counted from 0
    wanted = [(i, up) for i in range(len(names)) for up in (0, 1)]
    place = lambda n, i: (n - 1) * F.lit(percents[names[i]] / 100.0)
    rank = lambda n, i, up: (F.ceil(place(n, i)) if up else F.floor(place(n, i))).cast("bigint")

    def narrowed(cuts: Column, n: Column, at: Column) -> tuple[Column, Column]:
        """Splitters that lie safely below and above rank ``at`` of ``n``: a step and more apart from it, where a sketch errs by far less."""
        step = F.floor(at / F.greatest(n - 1, F.lit(1)) * grid).cast("int")
        return F.get(cuts, F.greatest(step - 1, F.lit(0))), F.get(cuts, F.least(step + 2, F.lit(grid)))

    first = grouped(rows).agg(F.count(F.lit(1)).alias("n"), sketch(F.col("__v")).alias("cuts")).where("n > 0")
    bounds = first.select(*keys, "n", *[c.alias(f"{what}{j}") for j, (i, up) in enumerate(wanted) for what, c in zip(("lo", "hi"), narrowed(F.col("cuts"), F.col("n"), rank(F.col("n"), i, up)))])

    def joined(d: DataFrame, other: DataFrame) -> DataFrame:
        return d.join(other, keys) if keys else d.join(F.broadcast(other))  # one row without keys

    while True:
        inside = [F.col("__v").between(F.col(f"lo{j}"), F.col(f"hi{j}")) for j in range(len(wanted))]
        both = joined(rows, bounds)
        counts = [F.first("n").alias("n")] + [x for j in range(len(wanted)) for x in (F.first(f"lo{j}").alias(f"lo{j}"), F.first(f"hi{j}").alias(f"hi{j}"), F.count_if(F.col("__v") < F.col(f"lo{j}")).alias(f"below{j}"), F.count_if(inside[j]).alias(f"in{j}"))]
        state = grouped(both).agg(*counts)
        # a group of few distinct values is never split further than to one of them, so a bound that is a value ends it
        open_ = F.greatest(*[F.when(F.col(f"lo{j}") < F.col(f"hi{j}"), F.col(f"in{j}")).otherwise(0) for j in range(len(wanted))], F.lit(0))
        most = state.agg(F.max(open_)).first()[0] or 0
        if most <= enough:
            break
        again = grouped(both).agg(F.first("n").alias("n"), *[x for j in range(len(wanted)) for x in (F.first(f"lo{j}").alias(f"lo{j}"), F.first(f"hi{j}").alias(f"hi{j}"), F.count_if(F.col("__v") < F.col(f"lo{j}")).alias(f"below{j}"), F.count_if(inside[j]).alias(f"in{j}"), sketch(F.when(inside[j], F.col("__v"))).alias(f"cuts{j}"))])
        made = []
        for j, (i, up) in enumerate(wanted):
            lo, hi = narrowed(F.col(f"cuts{j}"), F.col(f"in{j}"), rank(F.col("n"), i, up) - F.col(f"below{j}"))
            # splitters that do not move any more are as close as a sketch gets
            stuck = (lo == F.col(f"lo{j}")) & (hi == F.col(f"hi{j}"))
            made += [lo.alias(f"lo{j}"), hi.alias(f"hi{j}"), stuck.alias(f"s{j}")]
        tried = again.select(*keys, "n", *made)
        if tried.where(" AND ".join(f"(s{j} OR lo{j} = hi{j})" for j in range(len(wanted)))).count() == tried.count():
            break
        bounds = tried.select(*keys, "n", *[f"{w}{j}" for j in range(len(wanted)) for w in ("lo", "hi")])
    hits = F.explode(F.array_compact(F.array(*[F.when(inside[j], j) for j in range(len(wanted))]))).alias("__j")
    values = both.select(*keys, "__v", hits).groupBy(*keys, "__j", "__v").agg(F.count(F.lit(1)).alias("__c"))
    upto = F.sum("__c").over(Window.partitionBy(*keys, "__j").orderBy("__v"))
    values = values.withColumn("__to", upto)
    found = joined(values, state.select(*keys, "n", F.array(*[rank(F.col("n"), i, up) - F.col(f"below{j}") for j, (i, up) in enumerate(wanted)]).alias("__at")))
    at = F.get("__at", F.col("__j"))
    chosen = found.where((at < F.col("__to")) & (at >= F.col("__to") - F.col("__c")))
    pick = lambda j: F.max(F.when(F.col("__j") == j, F.col("__v")))
    total = F.max("n")
    share = lambda i: place(total, i) - F.floor(place(total, i))
    columns = [(pick(2 * i) + (pick(2 * i + 1) - pick(2 * i)) * share(i)).alias(name) for i, name in enumerate(names)]
    return grouped(chosen).agg(*columns).select(*[F.col(k).alias(b) for k, b in zip(keys, by)], *names)
