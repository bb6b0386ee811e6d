"""Best-fit packing of tokenised documents into sequences of fixed capacity.

Documents become token ids closed by one id 0; only a document longer than the capacity is cut, into full
pieces with the shorter one first.  How many pieces there are of each length is a table of at most
``capacity`` rows, so the packing itself is planned on the driver over lengths, not pieces: pieces above
one third of the capacity pair at most twice per bin, the longest with the longest that fits beside it, and
shorter ones go, longest first, to the tightest gap.  The plan says, for each length, which ranks go to
which bins; every piece then finds its place from its rank among pieces of its length, a two-level running
count that no length can overload.

Token ids come from the vocabulary in a ``tokenizers`` JSON file.  Texts run through tiktoken over that same
vocabulary, which gives the same ids about four times faster; texts that hold a special token's string go
through ``tokenizers`` itself.

Defined results: a null or empty text is the single id 0.  Repeated rows are packed each.  Empty tables give
empty results; other columns are ignored.
"""

from __future__ import annotations

import json
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakfield.llm._shared import materialize, running, table, uniform_hash

PIECES = "doc_id bigint, piece int, start bigint, length bigint, ids_crc32 bigint"


@lru_cache(maxsize=2)
def _encoder(path: str):
    """A function from a text to its token ids."""
    import tiktoken
    from public_tokenizers import PATTERN
    from tokenizers import Tokenizer

    with open(path, encoding="utf-8") as f:
        model = json.load(f)
    # byte-level vocabularies spell bytes as printable characters: those that are printable as themselves, the others from 256 up
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spelled = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(b for b in range(256) if b not in set(plain))}
    special = {x["content"] for x in model.get("added_tokens", [])}
    ranks = {bytes(spelled[c] for c in t): i for t, i in model["model"]["vocab"].items() if t not in special}
    fast = tiktoken.Encoding("from-json", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    exact = Tokenizer.from_file(path)

    def ids(text: str) -> list[int]:
        if any(s in text for s in special):
            return exact.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return ids


def _cut(path: str, capacity: int, with_ids: bool):
    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(path)
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            kept: list = []
            seen: dict[str, np.ndarray] = {}
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                text = text or ""
                ids = seen.get(text)
                if ids is None:
                    ids = np.array([*encode(text), 0], "<u4")
                    if len(text) < 1 << 16:
                        seen[text] = ids
                head = len(ids) % capacity or capacity
                ends = range(head, len(ids) + 1, capacity)
                for k, end in enumerate(ends):
                    start = end - capacity if k else 0
                    part = ids[start:end]
                    for column, x in zip(rows, (doc, k, start, end - start, zlib.crc32(part.tobytes()))):
                        column.append(x)
                    if with_ids:
                        kept.append(part.astype(np.int32))
            kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
            names = ["doc_id", "piece", "start", "length", "ids_crc32"]
            arrays = [pa.array(x, t) for x, t in zip(rows, kinds)]
            if with_ids:
                cuts = np.r_[0, np.cumsum([len(x) for x in kept])].astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(cuts), pa.array(np.concatenate([*kept, np.zeros(0, np.int32)]))))
                names.append("ids")
            yield pa.RecordBatch.from_arrays(arrays, names=names)

    return pieces


def tokenize(docs: DataFrame, path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32[, ids]): the pieces of every whole text."""
    schema = PIECES + ", ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(_cut(path, capacity, with_ids), schema)


def plan_bins(counts: dict[int, int], capacity: int) -> list[tuple[int, list[tuple[int, int]]]]:
    """Bins as (how many, [(length, how many of it in the bin), ...]); works on counts by length, so its cost depends on ``capacity`` alone."""
    left = {z: n for z, n in counts.items() if n > 0}
    gaps: dict[int, list[tuple[int, list[tuple[int, int]]]]] = {}
    open_gaps: list[int] = []
    full: list[tuple[int, list[tuple[int, int]]]] = []

    def keep(n: int, bin_: list[tuple[int, int]], gap: int) -> None:
        if gap == 0:
            full.append((n, bin_))
            return
        if gap not in gaps:
            gaps[gap] = []
            insort(open_gaps, gap)
        gaps[gap].append((n, bin_))

    # the large: each with the largest that fits beside it, at most two in a bin
    large = sorted(z for z in left if 3 * z > capacity)
    while large:
        a = large[-1]
        k = bisect_left(large, capacity - a + 1) - 1
        if k < 0:
            keep(left.pop(a), [(a, 1)], capacity - a)
            large.pop()
            continue
        b = large[k]
        if a == b:
            n, odd = divmod(left[a], 2)
            if n:
                keep(n, [(a, 2)], capacity - 2 * a)
            left[a] = odd
            if odd:  # the last one of its length pairs with the next below, if there is one
                k -= 1
                if k < 0:
                    keep(1, [(a, 1)], capacity - a)
                else:
                    b = large[k]
                    keep(1, [(a, 1), (b, 1)], capacity - a - b)
                    left[b] -= 1
                    if not left[b]:
                        large.remove(b)
                        del left[b]
            del left[a]
            large.remove(a)
            continue
        n = min(left[a], left[b])
        keep(n, [(a, 1), (b, 1)], capacity - a - b)
        for z in (a, b):
            left[z] -= n
            if not left[z]:
                large.remove(z)
                del left[z]

    # the small: longest first, each to the tightest gap
    for z in sorted(left, reverse=True):
        n = left[z]
        while n:
            k = bisect_left(open_gaps, z)
            if k == len(open_gaps):
                gap, bins, bin_ = capacity, n, []
            else:
                gap = open_gaps[k]
                bins, bin_ = gaps[gap].pop()
                if not gaps[gap]:
                    del gaps[gap]
                    open_gaps.pop(k)
            each = gap // z
            used = min(bins, n // each)
            if used:
                keep(used, [*bin_, (z, each)], gap - each * z)
                n -= used * each
            rest = bins - used if bin_ else int(n > 0 and n < each)
            if rest and 0 < n < each:
                keep(1, [*bin_, (z, n)], gap - n * z)
                n, rest = 0, rest - 1
            if rest and bin_:
                keep(rest, bin_, gap)
    for entries in gaps.values():
        full.extend(entries)
    return full


def _places(bins: list[tuple[int, list[tuple[int, int]]]]) -> tuple[np.ndarray, ...]:
    """For each run of ranks of one length: length and first rank as one number, how many to a bin, first bin, offset."""
    rank: dict[int, int] = {}
    runs, base = [], 0
    for n, items in bins:
        offset = 0
        for z, each in items:
            first = rank.get(z, 0)
            runs.append(((z << 48) + first, each, base, offset))
            rank[z] = first + n * each
            offset += z * each
        base += n
    runs.sort()
    return tuple(np.array(x, np.int64) for x in zip(*runs)) if runs else tuple(np.zeros(0, np.int64) for _ in range(4))


def pack(pieces: DataFrame, capacity: int = 2048) -> DataFrame:
    """Adds sequence_id and offset to ``pieces``, which must be stored (it is read three times)."""
    by_length = pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()  # capacity rows at most
    counts = {r["length"]: r["n"] for r in by_length}
    first, each, base, offset = _places(plan_bins(counts, capacity))
    ranked = pieces.withColumn("__one", F.lit(1).cast("bigint"))
    ranked = ranked.withColumn("__place", uniform_hash(F.lit("pack"), F.col("doc_id"), F.col("piece"), F.col("ids_crc32")))
    ranked = running(ranked, "length", "__place", ["doc_id", "piece"], "__one", "__rank", sum(counts.values())).drop("__one", "__place")
    names = [*pieces.columns, "sequence_id", "offset"]

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            z, rank = batch.column("length").to_numpy(), batch.column("__rank").to_numpy()
            k = np.searchsorted(first, (z << 48) + rank, "right") - 1
            nth = rank - (first[k] & ((1 << 48) - 1))
            own = [batch.column(c) for c in names[:-2]]
            yield pa.RecordBatch.from_arrays([*own, pa.array(base[k] + nth // each[k]), pa.array(offset[k] + nth % each[k] * z)], names=names)

    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in pieces.schema)
    return ranked.mapInArrow(place, f"{schema}, sequence_id bigint, offset bigint")


def pack_documents(docs: DataFrame, path: str, capacity: int = 2048, with_ids: bool = False) -> DataFrame:
    """Tokenises and packs ``docs``: rows (doc_id, piece, start, length, ids_crc32[, ids], sequence_id, offset)."""
    return pack(materialize(tokenize(docs, path, capacity, with_ids), "pieces"), capacity)


def query(spark, sf_dir):
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), str(public_tokenizers.path("byte_bpe_50k.json")))
