"""Harmonic packing of tokenised documents into sequences, each worker on its own.

A piece of length l is of class k = capacity // l, and every sequence of class k holds exactly k pieces of that
class, so a worker decides with one open sequence a class and never looks at what others do.  Classes below 32 are
single numbers and above 31 single lengths, so a sequence of class k wastes less than one part in k + 1; what would
be wasted in low classes is cut away: pieces of exactly capacity // k leave nothing.  How to cut a length is a table
of ``capacity`` rows found by dynamic programming: it minimises wasted tokens plus ``cut_cost`` for each piece
beyond the first, and depends on the capacity alone.

The first pass tokenises, cuts and fills in one scan without a shuffle.  Sequences that a task leaves open, one a
class at most, are filled in the second pass from the ranks of their pieces in each class, which are two-level
running counts that no class can overload.  The last pieces, fewer than k a class and so fewer than 4,700 at a
capacity of 1024 whatever the input, are packed best-fit on the driver.

Defined results: a null or empty text is the single id 0.  Repeated rows are packed each.  Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakfield.llm._shared import materialize, running, table, uniform_hash
from cloakfield.llm.packing import _encoder

PIECES = "doc_id bigint, start bigint, length bigint, ids_crc32 bigint, doc_tokens bigint"
PLACED = PIECES + ", sequence_id bigint, offset bigint"
#: Ids of sequences: those of a task from its number times this on, those of the later passes above all tasks'.
TASK_IDS, SECOND_PASS, LAST_PASS = 1 << 32, 1 << 60, 1 << 61
#: What a cut may cost, in wasted tokens.
CUT_COST = 8


@lru_cache(maxsize=4)
def cut_table(capacity: int, cut_cost: float = CUT_COST) -> tuple[tuple[int, ...], ...]:
    """For each length up to ``capacity`` the lengths to cut it into, the longest first."""
    exact = sorted({capacity // k for k in range(1, capacity + 1)})
    cost, pieces = [0.0], [()]
    for z in range(1, capacity + 1):
        k = capacity // z
        best, how = capacity / k - z, (z,)
        for c in exact:
            if c >= z:
                break
            k = capacity // c
            other = capacity / k - c + cut_cost + cost[z - c]
            if other < best:
                best, how = other, (c, *pieces[z - c])
        cost.append(best)
        pieces.append(tuple(sorted(how, reverse=True)))
    return tuple(pieces)


def _fill(path: str, capacity: int, cut_cost: float, with_ids: bool):
    def placed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        encode, table_ = _encoder(path), cut_table(capacity, cut_cost)
        next_id = TaskContext.get().partitionId() * TASK_IDS
        open_: dict[int, list[tuple]] = {}  # by class, fewer than k pieces each
        done: list[tuple] = []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            columns = list(zip(*[r[:7] for r in rows])) or [()] * 7
            arrays = [pa.array(c, pa.int64()) for c in columns]
            if with_ids:
                cuts = np.r_[0, np.cumsum([len(r[7]) for r in rows])].astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*[r[7] for r in rows], np.zeros(0, np.int32)]).astype(np.int32))))
                names.append("ids")
            return pa.RecordBatch.from_arrays(arrays, names=names)

        for batch in batches:
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                ids = np.array([*encode(text or ""), 0], "<u4")
                n, at = len(ids), 0
                whole, rest = divmod(n, capacity)
                for z in (*[capacity] * whole, *table_[rest]):
                    part = ids[at : at + z]
                    k = capacity // z
                    held = open_.setdefault(k, [])
                    held.append((doc, at, z, zlib.crc32(part.tobytes()), n, part if with_ids else None))
                    at += z
                    if len(held) == k:
                        offset = 0
                        for d, start, length, crc, total, own in held:
                            done.append((d, start, length, crc, total, next_id, offset, own))
                            offset += length
                        next_id += 1
                        held.clear()
                if len(done) > 20_000 or with_ids and len(done) > 2_000:
                    yield batch_of(done)
                    done = []
        done += [(*p[:5], None, None, p[5]) for held in open_.values() for p in held]
        if done:
            yield batch_of(done)

    return placed


def _best_fit(lengths: list[int], capacity: int) -> list[tuple[int, int]]:
    """(sequence, offset) of each length, the longest first into the tightest gap."""
    gaps: list[tuple[int, int]] = []
    places, n = [(0, 0)] * len(lengths), 0
    for i in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        k = bisect_left(gaps, (lengths[i], -1))
        gap, bin_ = gaps.pop(k) if k < len(gaps) else (capacity, n)
        n += bin_ == n
        places[i] = (bin_, capacity - gap)
        if gap > lengths[i]:
            insort(gaps, (gap - lengths[i], bin_))
    return places


def _second(open_: DataFrame, capacity: int) -> DataFrame:
    """Places for the pieces that the tasks left open; ``open_`` must be stored (it is read three times)."""
    spark = open_.sparkSession
    rows = open_.withColumn("__class", (F.lit(capacity) / F.col("length")).cast("bigint")).withColumn("__one", F.lit(1).cast("bigint"))
    counts = {r["__class"]: r["n"] for r in rows.groupBy("__class").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a class
    rows = rows.withColumn("__place", uniform_hash(F.lit("harmonic"), F.col("doc_id"), F.col("start"), F.col("ids_crc32")))
    ranked = running(rows, "__class", "__place", ["doc_id", "start"], "__one", "__rank", sum(counts.values()))
    ranked = materialize(ranked.withColumn("__bin", F.floor(F.col("__rank") / F.col("__class")).cast("bigint")).drop("__place", "__one"), "harmonic-ranks")
    base, at = [], 0
    for k, n in sorted(counts.items()):
        base.append((k, SECOND_PASS + at, n // k))
        at += n // k
    plan = spark.createDataFrame(base, "__class bigint, __base bigint, __bins bigint")
    ranked = ranked.join(F.broadcast(plan), "__class")  # a row a class
    before = Window.partitionBy("__class", "__bin").orderBy("__rank").rowsBetween(Window.unboundedPreceding, -1)
    full = ranked.where("__bin < __bins").withColumn("sequence_id", F.col("__base") + F.col("__bin")).withColumn("offset", F.coalesce(F.sum("length").over(before), F.lit(0).cast("bigint")))
    last = ranked.where("__bin >= __bins").select(*open_.columns).orderBy(F.desc("length"), "doc_id", "start", "ids_crc32").collect()  # fewer than k a class
    places = _best_fit([r["length"] for r in last], capacity)
    ends = [(*r, LAST_PASS + bin_, offset) for r, (bin_, offset) in zip(last, places)]
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in open_.schema) + ", sequence_id bigint, offset bigint"
    return full.select(*open_.columns, "sequence_id", "offset").unionByName(spark.createDataFrame(ends, schema))


def harmonic_packing(docs: DataFrame, path: str, capacity: int = 1024, cut_cost: float = CUT_COST, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset[, ids]): the pieces of every whole text and their places.

    ``path`` names a tokenizers file.  ``cut_cost`` says how many wasted tokens a cut may cost; 0 cuts most.
    """
    placed = docs.select("doc_id", "text").mapInArrow(_fill(path, capacity, cut_cost, with_ids), PLACED + ", ids array<int>" * with_ids)
    placed = materialize(placed, "harmonic")
    open_ = placed.where("sequence_id is null").drop("sequence_id", "offset")
    return placed.where("sequence_id is not null").unionByName(_second(open_, capacity))


def query(spark, sf_dir):
    import public_tokenizers

    return harmonic_packing(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")), 1024)
