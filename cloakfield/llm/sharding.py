"""Sharding by best-fit-decreasing packing of indivisible groups.

Rows with equal texts form a group, and a group stays whole.  Groups enter in falling order of size, each the
shard with the tightest remaining capacity that takes it, found in an ordered tree of remaining capacities.
Groups of one size do so one after another, so the plan is made on counts: a shard that is the tightest stays
the tightest until it is full, and takes as many of them at once.  The driver sees one row a size class.
Sizes below 2**BITS are classes of their own and above it a class keeps the leading BITS bits, so there are
2**(BITS-1) classes a power of two at most, whatever the corpus, and the members of one differ by 1/2048 at
most.  Each group finds its shard from its rank within its class, a running count that no class can overload.
A group above a shard's even share has a shard of its own, and the rest share the others evenly.

Defined results: a null text has no bytes and groups with the empty text.  Repeated rows are rows of their
own.  Rows with one doc_id stand in order of their texts' digests.  Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cloakfield.llm._shared import materialize, running, table, uniform_hash

#: Bits of a size that its class keeps.
BITS = 12


class CapacityTree:
    """Remaining capacities in order, as a tree of sorted leaves that split when full; finds the tightest that fits in logarithmic time."""

    LEAF = 64

    def __init__(self, items: list[tuple[float, int]]):
        items = sorted(items)
        self.leaves = [items[i : i + self.LEAF] for i in range(0, len(items), self.LEAF)]

    def _leaf(self, item: tuple[float, int]) -> int:
        return min(bisect_left([x[-1] for x in self.leaves], item), len(self.leaves) - 1)

    def add(self, item: tuple[float, int]) -> None:
        if not self.leaves:
            self.leaves.append([item])
            return
        k = self._leaf(item)
        leaf = self.leaves[k]
        leaf.insert(bisect_left(leaf, item), item)
        if len(leaf) > 2 * self.LEAF:
            self.leaves[k : k + 1] = [leaf[: self.LEAF], leaf[self.LEAF :]]

    def take(self, size: float) -> tuple[float, int]:
        """Removes and returns the tightest (capacity, shard) of at least ``size``, or the roomiest if none is."""
        k = self._leaf((size, -1))
        leaf = self.leaves[k]
        i = min(bisect_left(leaf, (size, -1)), len(leaf) - 1)
        item = leaf.pop(i)
        if not leaf:
            del self.leaves[k]
        return item


def best_fit_decreasing(classes: list[tuple[int, int, int]], n_shards: int) -> list[tuple[int, int, int]]:
    """Runs (class, first rank, shard) in order, from rows (class, groups, bytes); ranks from one first rank to the next go to that shard."""
    classes = sorted(classes, reverse=True)
    largest = [b / n for _, n, b in classes[:n_shards] for _ in range(min(n, n_shards))][:n_shards]
    capacity = even_share(sum(b for *_, b in classes), n_shards, largest)
    tree, runs = CapacityTree([(capacity, i) for i in range(n_shards)]), []
    for z, n, b in classes:
        size, first = b / n, 0
        while first < n:
            room, shard = tree.take(size)
            many = max(1, min(n - first, int(room // size)))
            tree.add((room - many * size, shard))
            runs.append((z, first, shard))
            first += many
    return sorted(runs)


def even_share(total: int, n_shards: int, largest: list[float]) -> float:
    """The capacity at which groups above it have shards of their own and the others fill the rest evenly."""
    share, rest, shards = total / n_shards, float(total), n_shards
    for size in largest:
        if size <= share or shards == 1:
            break
        rest, shards = rest - size, shards - 1
        share = rest / shards
    return share


def _class(size: Column) -> Column:
    """Keeps the leading BITS bits."""
    shift = F.greatest(F.length(F.bin(size)) - BITS, F.lit(0))
    return size - F.pmod(size, F.call_function("shiftleft", F.lit(1).cast("bigint"), shift))


def shard_documents(docs: DataFrame, n_shards: int = 40) -> DataFrame:
    """Rows (doc_id, size, text_crc32, shard, slot), one for each document."""
    text = F.coalesce(F.col("text"), F.lit(""))
    raw = F.encode(text, "UTF-8")
    rows = docs.select(
        "doc_id",
        (F.octet_length(raw) + 16).cast("bigint").alias("size"),
        F.crc32(raw).alias("text_crc32"),
        F.unhex(F.sha2(raw, 256)).alias("key"),
    )
    rows = materialize(rows, "shard-rows")
    groups = rows.groupBy("key").agg(F.sum("size").alias("bytes"))
    groups = materialize(groups.select("key", "bytes", _class(F.col("bytes")).alias("class"), uniform_hash(F.col("key")).alias("place"), F.lit(1).cast("bigint").alias("one")), "shard-groups")
    classes = groups.groupBy("class").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("bytes")).collect()  # a row a size class
    runs = best_fit_decreasing([tuple(r) for r in classes], n_shards)
    ranked = running(groups, "class", "place", ["key"], "one", "rank", sum(r["n"] for r in classes)).select("key", "class", "rank")
    assigned = ranked.mapInArrow(_placer(runs), "key binary, shard int")
    out = rows.join(assigned, "key").withColumn("place", uniform_hash(F.lit("slot"), F.col("doc_id")))
    out = running(out.withColumn("one", F.lit(1).cast("bigint")), "shard", "place", ["doc_id", "key"], "one", "slot", rows.count())
    return out.select("doc_id", "size", "text_crc32", "shard", "slot")


def _placer(runs: list[tuple[int, int, int]]):
    """Looks up the run of each rank: class number and rank as one number."""
    z, first, shard = (np.array(x, np.int64) for x in zip(*runs)) if runs else (np.zeros(0, np.int64),) * 3
    names = np.unique(z)
    starts = (np.searchsorted(names, z) << 44) + first

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = (np.searchsorted(names, batch.column("class").to_numpy()) << 44) + batch.column("rank").to_numpy()
            out = shard[np.searchsorted(starts, at, "right") - 1].astype(np.int32)
            yield pa.RecordBatch.from_arrays([batch.column("key"), pa.array(out)], names=["key", "shard"])

    return place


def query(spark, sf_dir):
    out = shard_documents(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
