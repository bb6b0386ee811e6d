"""Line deduplication over range-partitioned line hashes.

Lines become (hash, document, position) rows.  The rows are range-partitioned by hash and document and
sorted within partitions, so a line that a third of all documents hold spreads over many partitions.  A
streaming pass sees each line's documents in order.  A run of one hash that lies inside a batch is decided
at once; the two runs at a batch's ends may go on in its neighbours, so they are passed on with their
counts and decided by the sum.  What leaves is a sparse bitmap of 64-bit words a document, never text.

Defined results: a null or empty text is one empty line.  Lines whose key is shorter than ``min_chars``
always stay.  Repeated rows of one document count as one document and get the same bitmap.  A null
document id counts as one document.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakfield.llm._shared import WS_CHARS, ascii_lower, materialize, table

SEGMENT = "h1 bigint, h2 bigint, decided boolean, n_docs bigint, ids array<bigint>, marks array<bigint>, at array<int>"
#: Rows of a range partition of line hashes.
ROWS_PER_PARTITION = 500_000


def _lines(docs: DataFrame, min_chars: int) -> DataFrame:
    """Rows (h1, h2, doc_id, mark, pos); mark tells apart rows that share a document id but not a text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    df = docs.select("doc_id", F.xxhash64(text).alias("mark"), F.posexplode(F.split(text, "\n")).alias("pos", "line"))
    df = df.select("doc_id", "mark", "pos", ascii_lower(F.trim("line", F.lit(WS_CHARS))).alias("key"))
    df = df.where(F.length("key") >= max(1, min_chars))
    return df.select(F.xxhash64("key").alias("h1"), F.xxhash64(F.lit("line"), "key").alias("h2"), "doc_id", "mark", "pos")


def _stream(min_docs: int):
    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None
        for batch in batches:
            if not batch.num_rows:
                continue
            h1, h2, mark, pos = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("h1", "h2", "mark", "pos"))
            ids = batch.column("doc_id")
            plain, null = ids.fill_null(0).to_numpy(), ids.is_null().to_numpy(zero_copy_only=False)
            new_run = np.r_[True, (h1[1:] != h1[:-1]) | (h2[1:] != h2[:-1])]
            new_doc = new_run | np.r_[True, (plain[1:] != plain[:-1]) | (null[1:] != null[:-1])]
            first = (h1[0], h2[0], plain[0], null[0])
            if last == first:  # the document was counted at the end of the batch before
                new_doc[0] = False
            last = (h1[-1], h2[-1], plain[-1], null[-1])
            start = np.flatnonzero(new_run)
            stop = np.r_[start[1:], len(h1)]
            n_docs = np.add.reduceat(new_doc.astype(np.int64), start)
            edge = np.zeros(len(start), bool)
            edge[[0, -1]] = True
            out = np.flatnonzero(edge | (n_docs >= min_docs))
            rows = np.concatenate([np.arange(start[k], stop[k]) for k in out])
            cuts = pa.array(np.r_[0, np.cumsum(stop[out] - start[out])], pa.int32())
            arrays = [pa.ListArray.from_arrays(cuts, x) for x in (ids.take(pa.array(rows)), pa.array(mark[rows]), pa.array(pos[rows]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array(h1[start[out]]), pa.array(h2[start[out]]), pa.array(~edge[out]), pa.array(n_docs[out]), *arrays],
                names=["h1", "h2", "decided", "n_docs", "ids", "marks", "at"],
            )

    return segments


def drop_bitmaps(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """Rows (doc_id, mark, bits): for each document that loses lines, a map of word number to 64 bits, one bit a dropped line."""
    lines = materialize(_lines(docs, min_chars), "lines")
    parts = max(8, -(-lines.count() // ROWS_PER_PARTITION))
    key = ["h1", "h2", "doc_id"]
    runs = lines.repartitionByRange(parts, *key).sortWithinPartitions(*key, "mark", "pos")
    segments = materialize(runs.mapInArrow(_stream(min_docs), SEGMENT), "segments")
    entries = F.arrays_zip(F.col("ids").alias("ids"), F.col("marks").alias("marks"), F.col("at").alias("at"))
    segments = segments.select("h1", "h2", "decided", "n_docs", entries.alias("entries"))
    first = F.get("entries", 0)
    settled = segments.where("decided").select("entries", first.alias("first"))
    open_ = segments.where("not decided")
    sums = open_.groupBy("h1", "h2").agg(F.sum("n_docs").alias("docs"), F.min(first).alias("first")).where(F.col("docs") >= min_docs)
    dropped = settled.unionByName(open_.join(sums.drop("docs"), ["h1", "h2"]).select("entries", "first"))
    one = dropped.select(F.explode("entries").alias("e"), "first")
    if keep_first:
        one = one.where(F.col("e") != F.col("first"))
    bit = F.call_function("shiftleft", F.lit(1).cast("bigint"), F.col("e.at") % 64)
    one = one.select(F.col("e.ids").alias("doc_id"), F.col("e.marks").alias("mark"), F.shiftright("e.at", 6).alias("word"), bit.alias("bit"))
    packed = one.groupBy("doc_id", "mark", "word").agg(F.bit_or("bit").alias("bits"))
    return packed.groupBy("doc_id", "mark").agg(F.map_from_entries(F.collect_list(F.struct("word", "bits"))).alias("bits"))


def line_dedup(docs: DataFrame, min_docs: int = 10, min_chars: int = 1, keep_first: bool = False) -> DataFrame:
    """The input's columns, with text reduced to the kept lines, and a struct ``__lines`` of n_lines and n_dropped.

    A line's key is the line stripped of white space and with A-Z lower-cased.  A key found in ``min_docs``
    documents or more loses all its lines, or all but its first with ``keep_first``.  A text without a
    dropped line comes back as it was.
    """
    bitmaps = drop_bitmaps(docs, min_docs, min_chars, keep_first)
    text = F.coalesce(F.col("text"), F.lit(""))
    marked = docs.withColumn("__mark", F.xxhash64(text))
    maps = bitmaps.select(F.col("doc_id").alias("__id"), F.col("mark").alias("__m"), F.col("bits").alias("__bits"))
    joined = marked.join(maps, marked["doc_id"].eqNullSafe(maps["__id"]) & (F.col("__mark") == F.col("__m")), "left")
    joined = joined.withColumn("__all", F.split(text, "\n"))
    word = lambda i: F.coalesce(F.try_element_at("__bits", F.shiftright(i, 6)), F.lit(0).cast("bigint"))
    stays = F.filter("__all", lambda _, i: F.call_function("shiftright", word(i), i % 64) % 2 == 0)
    joined = joined.withColumn("__kept", F.when(F.col("__bits").isNull(), F.col("__all")).otherwise(stays))
    n_lines, n_kept = F.size("__all").cast("bigint"), F.size("__kept").cast("bigint")
    return joined.select(
        *[F.when(F.col("__bits").isNull(), F.col("text")).otherwise(F.array_join("__kept", "\n")).alias(c) if c == "text" else F.col(c) for c in docs.columns],
        F.struct(n_lines.alias("n_lines"), (n_lines - n_kept).alias("n_dropped")).alias("__lines"),
    )


def query(spark, sf_dir):
    out = line_dedup(table(spark, sf_dir, "documents").select("doc_id", "text"), 10, 1)
    digest = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    return out.select("doc_id", "__lines.n_lines", "__lines.n_dropped", digest.alias("kept_sha256"))


ORACLE = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line,
         generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k FROM lines),
common AS (SELECT k FROM keyed WHERE length(k) >= 1 GROUP BY k HAVING count(DISTINCT doc_id) >= 10),
marked AS (SELECT *, k IN (SELECT k FROM common) AS dropped FROM keyed)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY doc_id
"""
