"""Helpers that the training-data operators share.

Tables that an operator reads more than once are written to the folder that
``spark.checkpoint.dir`` names, which the driver and all executors share, and
read back.  That cuts lineage without any executor-local copy: a lost executor
costs a re-read, never a failed job.
"""

from __future__ import annotations

import math
import os
import re
import tempfile
import time
import uuid

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: White space of the word and line contracts, as a character class body and as plain characters.
WS = r"\x20\x09-\x0D"
WS_CHARS = " \t\n\x0b\x0c\r"
WORD = f"[^{WS}]+"

UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def shared_dir(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only in local mode, where driver and executors are one process."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not spark.conf.get("spark.master", "local").startswith("local["):
        raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    folder = os.path.join(tempfile.gettempdir(), "cloakfield-shared")
    spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def materialize(df: DataFrame, name: str) -> DataFrame:
    """Writes ``df`` once to the shared folder and returns a reader of it."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def clean(spark: SparkSession, older_than_hours: float) -> int:
    """Deletes the tables of :func:`materialize` that were written before the last ``older_than_hours``; the number of them.

    Lazy results read these tables, so the age must exceed that of any result still in use.
    """
    place = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    fs = place.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(place):
        return 0
    limit = (time.time() - 3600 * older_than_hours) * 1000
    old = [f.getPath() for f in fs.listStatus(place) if f.getModificationTime() < limit and re.search("-[0-9a-f]{32}$", f.getPath().getName())]
    for path in old:
        fs.delete(path, True)
    return len(old)


def binary_column(table_, name: str, width: int):
    """A column of byte strings of one width, as a matrix of 64-bit words."""
    import numpy as np

    return np.frombuffer(b"".join(table_.column(name).to_pylist()), np.uint64).reshape(-1, width // 8)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ascii_lower(c: Column) -> Column:
    """Lower-cases A-Z alone."""
    return F.translate(c, UPPER, UPPER.lower())


def words(c: Column) -> Column:
    """The words of a text; an empty array for null and blank texts."""
    return F.filter(F.split(F.coalesce(c, F.lit("")), f"[{WS}]+"), lambda w: w != "")


def uniform_hash(*cols: Column) -> Column:
    """A hash of 62 bits, not negative."""
    return F.shiftrightunsigned(F.xxhash64(*cols), 2)


def bucket_bits(n_rows: int) -> int:
    """Bits of a two-level split: about sqrt(n) buckets of sqrt(n) rows, so neither level outgrows a task."""
    return max(0, math.ceil(math.log2(max(1, n_rows)) / 2))


def running(df: DataFrame, by: str, order: str, tie: list[str], value: str, out: str, n_rows: int) -> DataFrame:
    """Adds ``out``: the sum of ``value`` over the rows of the same ``by`` that come earlier in ``order``.

    ``order`` is a column of :func:`uniform_hash`.  The sum is split by the hash's leading bits: totals
    of buckets give each bucket's start, a window inside a bucket gives the rest.  A ``by`` that holds a
    third of all rows is so spread over all tasks.
    """
    cut = 62 - bucket_bits(n_rows)
    rows = df.withColumn("__bucket", F.shiftright(order, cut))
    totals = rows.groupBy(by, "__bucket").agg(F.sum(value).alias("__total"))
    before = Window.partitionBy(by).orderBy("__bucket").rowsBetween(Window.unboundedPreceding, -1)
    starts = totals.select(F.col(by).alias("__by"), F.col("__bucket").alias("__b"), F.coalesce(F.sum("__total").over(before), F.lit(0)).alias("__start"))
    inside = Window.partitionBy(by, "__bucket").orderBy(order, *tie).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("__inside", F.coalesce(F.sum(value).over(inside), F.lit(0)))
    return (
        rows.join(starts, F.col(by).eqNullSafe(F.col("__by")) & (F.col("__bucket") == F.col("__b")))
        .withColumn(out, F.col("__start") + F.col("__inside"))
        .drop("__bucket", "__by", "__b", "__start", "__inside")
    )


def components(edges: DataFrame, name: str = "components") -> DataFrame:
    """Connected components of ``edges(a, b)``: rows ``(node, root)`` with the smallest node of each component.

    Alternates the large-star and small-star steps of Kiveris et al. (2014) until every node hangs on one root
    that hangs on none, which takes a number of rounds that grows with the logarithm of the component size.
    Each round is written to the shared folder.  Nodes are never gathered on the driver; only one number comes
    back a round.
    """

    def star(both: DataFrame, smaller: bool) -> DataFrame:
        # stored, so that the join below reads two plain shuffles, of which Spark can split a hub's
        least = materialize(both.groupBy("u").agg(F.least(F.col("u"), F.min("v")).alias("m")), name)
        keep = F.col("v") <= F.col("u") if smaller else F.col("v") > F.col("u")
        joined = both.join(least, "u")
        out = joined.where(keep).select(F.col("v").alias("a"), F.col("m").alias("b"))
        if smaller:
            out = out.unionByName(least.select(F.col("u").alias("a"), F.col("m").alias("b")))
        return out.where("a <> b").distinct()

    def settled(edges: DataFrame) -> bool:
        ends = edges.select(F.col("a").alias("u"), F.lit(1).alias("up")).unionByName(edges.select(F.col("b").alias("u"), F.lit(0).alias("up")))
        ends = ends.groupBy("u").agg(F.sum("up").alias("ups"), F.min("up").alias("low"))
        return ends.where("ups > 1 or ups = 1 and low = 0").isEmpty()

    edges = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    edges = materialize(edges, name)
    while not settled(edges):
        both = edges.select(F.col("a").alias("u"), F.col("b").alias("v"))
        both = both.unionByName(both.select(F.col("v").alias("u"), F.col("u").alias("v")))
        large = star(both, False)
        down = large.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
        edges = materialize(star(down, True), name)
    return edges.select(F.col("a").alias("node"), F.col("b").alias("root"))


def groups_in_order(batches, keys: list[str]):
    """Yields a table for each run of rows with equal ``keys``, from batches sorted by them; holds one group and one batch at a time."""
    import numpy as np
    import pyarrow as pa

    pending: list = []
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        columns = [batch.column(k).to_numpy(zero_copy_only=False) for k in keys]
        new = np.zeros(batch.num_rows, bool)
        for c in columns:
            new[1:] |= c[1:] != c[:-1]
        starts = [0, *np.flatnonzero(new), batch.num_rows]
        for a, b in zip(starts, starts[1:]):
            key = tuple(c[a] for c in columns)
            if pending and key != last:
                yield pa.Table.from_batches(pending).combine_chunks()
                pending = []
            last = key
            pending.append(batch.slice(a, b - a))
    if pending:
        yield pa.Table.from_batches(pending).combine_chunks()


def list_column(table_, name: str):
    """Values and offsets of a list column of a combined table."""
    import numpy as np

    column = table_.column(name)
    column = column.chunk(0) if column.num_chunks else column.combine_chunks()
    offsets = column.offsets.to_numpy()
    return column.values.to_numpy(zero_copy_only=False)[offsets[0] : offsets[-1]], np.asarray(offsets - offsets[0])
