"""Divergence of sources within a language, by term: dense group-by-term tiles of numpy integers.

Terms are counted inside the tasks that read the texts, as occurrences and as documents per language, source and
term, and summed by Spark.  The terms that enough documents of a language hold are dealt into blocks by hash; a tile
is the dense matrix of counts of all groups of each language for the terms of one block.  A tile gives, for each
pair of groups, the part of their divergence that its terms make, by broadcasting one group axis against the other,
and, for each group, the terms that set it most apart from its language.  Partial pair values are summed and the
per-group heaps of tiles are merged by a window that Spark limits before its shuffle.

Where a language has more sources than ``SIDE`` the tile is cut along its sources too, and pairs of parts are tiles
of their own, so a tile never holds more than ``2 * SIDE`` rows by about ``BLOCK`` columns.  The counts of a source
that holds a third of all documents are spread over the blocks like any other's.

All arithmetic is in 64-bit integers and exact while a language has fewer than 9 * 10**15 words: a share of
10**9 * c / t is a long division by three digits at a time.

Defined results: null text, language and source are the empty string.  Repeated rows are documents of their own.  A
group whose documents have no terms takes part with counts of 0; a language that keeps no terms has pairs of value 0.
A language of one source has no rows.  Ties go by the item's UTF-8 bytes.  Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cloakfield.llm._shared import materialize, table

#: Terms of a tile, and sources of a part of one.
BLOCK, SIDE = 2048, 256
#: Terms that a task counts before it passes them on, and bytes of a text that are split at once.
HELD, CHUNK = 400_000, 1 << 20
SCALE = 1_000_000_000

COUNTS = "lang string, source string, term binary, n bigint, docs bigint"
TILE = "lang string, a string, b string, term binary, value bigint"

#: A-Z to a-z, other letters and all bytes of non-ASCII characters as they are, the rest to blanks.
_LETTERS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms_of(text: str | None) -> Iterator[list[bytes]]:
    """The terms of a text as UTF-8, in lists of about ``CHUNK`` bytes."""
    raw = (text or "").encode().translate(_LETTERS)
    at = 0
    while at < len(raw):
        end = len(raw) if len(raw) - at <= CHUNK else raw.rfind(b" ", at, at + CHUNK) + 1
        if end <= at:  # one term longer than a chunk
            end = raw.find(b" ", at + CHUNK) + 1 or len(raw)
        yield raw[at:end].split()
        at = end


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of occurrences and documents by group and term, and a row without term for each group."""
    groups: dict[tuple[str, str], tuple[Counter, Counter]] = {}
    held = 0

    def rows() -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, docs) in groups.items():
            size = len(n) + 1
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array([lang] * size), pa.array([source] * size), pa.array([None, *n], pa.binary()),
                    pa.array([0, *n.values()], pa.int64()), pa.array([0, *(docs[t] for t in n)], pa.int64()),
                ],
                names=["lang", "source", "term", "n", "docs"],
            )

    for batch in batches:
        for text, lang, source in zip(*(batch.column(c).to_pylist() for c in ("text", "lang", "source"))):
            n, docs = groups.setdefault((lang or "", source or ""), (Counter(), Counter()))
            before, seen = len(n), set()
            for found in terms_of(text):
                n.update(found)
                seen.update(found)
            docs.update(seen)
            held += len(n) - before
            if held > HELD:
                yield from rows()
                groups, held = {}, 0
    yield from rows()


def term_counts(docs: DataFrame, min_docs: int) -> DataFrame:
    """Rows (lang, source, term, n, total, first): kept terms of groups, and each group once with a null term.

    total is the term's count in its language, first is set for one of its rows.
    """
    read = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit("")).alias("lang"), F.coalesce(F.col("source").cast("string"), F.lit("")).alias("source"))
    counts = read.mapInArrow(_count, COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    term = Window.partitionBy("lang", "term")  # a row a source
    counts = counts.withColumn("__docs", F.sum("docs").over(term)).withColumn("total", F.sum("n").over(term))
    counts = counts.withColumn("first", F.row_number().over(term.orderBy("source")) == 1)
    return counts.where(F.col("term").isNull() | (F.col("__docs") >= min_docs)).drop("docs", "__docs")


def share(count: np.ndarray, total: np.ndarray) -> np.ndarray:
    """1 + floor(10**9 * count / total) for 0 <= count <= total < 9 * 10**15."""
    rest, out = np.broadcast_to(count, np.broadcast_shapes(count.shape, total.shape)).copy(), np.int64(0)
    for _ in range(3):
        rest *= 1000
        out = out * 1000 + rest // total
        rest %= total
    return out + 1


def distance(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    d = p - q
    return d * d // (p + q)


def _pairs(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    """The sums over terms of the distances of each row of ``p`` to each row of ``q``."""
    out = np.zeros((len(p), len(q)), np.int64)
    step = max(1, (1 << 19) // max(1, out.size))
    for at in range(0, p.shape[1], step):
        out += distance(p[:, None, at : at + step], q[None, :, at : at + step]).sum(2)
    return out


def _tile(top: int, parts: int):
    def tile(key, counts: pa.Table, groups: pa.Table) -> pa.Table:
        number = key[0].as_py()
        block, left, right = number // parts**2, number // parts % parts, number % parts
        names = [np.array(groups.column(c).to_pylist(), object) for c in ("lang", "source")]
        part, n, lang_n, v, in_block = (groups.column(c).to_numpy() for c in ("part", "n", "lang_n", "v", "in_block"))
        out: tuple[list, ...] = ([], [], [], [], [])

        def put(*values) -> None:
            for column, x in zip(out, values):
                column.extend(x)

        of_lang: dict[str, list[int]] = {}
        for i, lang in enumerate(names[0]):
            of_lang.setdefault(lang, []).append(i)
        row_of = {key_: i for i, key_ in enumerate(zip(*names))}
        group = np.array([row_of[x] for x in zip(counts.column("lang").to_pylist(), counts.column("source").to_pylist())], np.int64)
        lang_at = names[0][group] if len(group) else np.empty(0, object)
        terms = np.array(counts.column("term").to_pylist() or [b""], object)[: len(group)]
        number_of, total_of = counts.column("n").to_numpy(), counts.column("total").to_numpy()
        for lang, members in of_lang.items():
            mine = np.flatnonzero(lang_at == lang)
            kept, column = np.unique(terms[mine], return_inverse=True) if len(mine) else (np.empty(0, object), np.empty(0, int))
            members = np.array(sorted(members, key=lambda i: names[1][i].encode()))
            place = dict(zip(members.tolist(), range(len(members))))
            dense = np.zeros((len(members), len(kept)), np.int64)
            dense[[place[i] for i in group[mine].tolist()], column] = number_of[mine]
            p = share(dense + 2, (n[members] + 2 * v[members])[:, None]) if len(kept) else dense
            sides = [np.flatnonzero(part[members] == side) for side in (left, right)]
            sums = _pairs(p[sides[0]], p[sides[1]])
            absent = in_block[members[0]] - len(kept)  # terms of the block that only other parts hold
            if absent:
                never = share(np.full((len(members), 1), 2), (n[members] + 2 * v[members])[:, None])
                sums += absent * _pairs(never[sides[0]], never[sides[1]])
            if left == right:
                first, second = np.triu_indices(len(sides[0]), 1)
            else:
                first, second = (x.ravel() for x in np.indices(sums.shape))
            worth = np.flatnonzero((sums[first, second] > 0) | (block == 0))
            first, second = first[worth], second[worth]
            source = names[1][members]
            put([lang] * len(worth), source[sides[0][first]], source[sides[1][second]], [None] * len(worth), sums[first, second].tolist())
            if left == right and len(kept):
                total = np.zeros(len(kept), np.int64)
                total[column] = total_of[mine]
                q = share(total + 2, lang_n[members[:1]] + 2 * v[members[:1]])
                for i in sides[0]:
                    above = np.flatnonzero((dense[i] > 0) & (p[i] > q))
                    value = distance(p[i, above], q[above])
                    best = np.lexsort((above, -value))[:top]  # terms are in order of their bytes
                    put([lang] * len(best), [source[i]] * len(best), [None] * len(best), kept[above[best]], value[best].tolist())
        kinds = (pa.string(), pa.string(), pa.string(), pa.binary(), pa.int64())
        return pa.table([pa.array(list(x), kind) for x, kind in zip(out, kinds)], names=["lang", "a", "b", "term", "value"])

    return tile


def source_divergence(docs: DataFrame, min_docs: int = 10, top: int = 10, block: int = BLOCK, side: int = SIDE) -> DataFrame:
    """Rows (lang, source, part, item, value, rank).

    Part ``pair`` has every other source of the language with the sum over kept terms of the distance of their shares;
    part ``term`` has the ``top`` terms of the group that its language has less of.  A share is
    p = 1 + floor(10**9 * (count + 2) / (N + 2 * V)), a distance floor((p - q)**2 / (p + q)).
    """
    counts = materialize(term_counts(docs, min_docs), "divergence-counts")
    given = F.col("term").isNotNull()
    groups = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.count(F.when(given & F.col("first"), 1)).alias("__v"))
    lang = Window.partitionBy("lang")  # a row a source
    groups = materialize(groups.withColumns({"lang_n": F.sum("n").over(lang), "v": F.sum("__v").over(lang), "__size": F.count(F.lit(1)).over(lang)}).drop("__v"), "divergence-groups")
    n_terms, widest = counts.where(given).count(), groups.agg(F.max("__size")).first()[0] or 1
    blocks, parts = max(1, -(-n_terms // block)), -(-widest // side)
    part = F.pmod(F.xxhash64("source"), F.lit(parts))
    others = F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))
    # each pair of parts once, the lower first
    pair = F.explode(F.transform(others, lambda o: F.least(part, o) * parts + F.greatest(part, o))).alias("__pair")
    rows = counts.where(given).withColumn("__block", F.pmod(F.xxhash64("lang", "term"), F.lit(blocks)))
    in_block = rows.where("first").groupBy("lang", "__block").agg(F.count(F.lit(1)).alias("in_block"))
    rows = rows.select("lang", "source", "term", "n", "total", "__block", pair)
    rows = rows.select("lang", "source", "term", "n", "total", (F.col("__block") * parts**2 + F.col("__pair")).alias("tile"))
    sides = groups.select("lang", "source", "n", "lang_n", "v", part.alias("part"), F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(blocks - 1).cast("bigint"))).alias("__block"), pair)
    sides = sides.join(in_block, ["lang", "__block"], "left").fillna(0, ["in_block"])
    sides = sides.select("lang", "source", "n", "lang_n", "v", "part", "in_block", (F.col("__block") * parts**2 + F.col("__pair")).alias("tile"))
    tiles = materialize(rows.groupBy("tile").cogroup(sides.groupBy("tile")).applyInArrow(_tile(top, parts), TILE), "divergence-tiles")
    sums = tiles.where("b is not null").groupBy("lang", "a", "b").agg(F.sum("value").alias("value"))
    ends = F.explode(F.array(F.struct(F.col("a").alias("source"), F.col("b").alias("item")), F.struct(F.col("b").alias("source"), F.col("a").alias("item")))).alias("e")
    pairs = sums.select("lang", "value", ends).select("lang", "e.source", F.lit("pair").alias("part"), "e.item", "value")
    heaps = tiles.where("b is null").select("lang", F.col("a").alias("source"), F.lit("term").alias("part"), F.col("term").cast("string").alias("item"), "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    ranked = [x.withColumn("rank", F.row_number().over(order)) for x in (pairs, heaps)]
    return ranked[0].unionByName(ranked[1].where(F.col("rank") <= top))


def query(spark, sf_dir):
    return source_divergence(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH d AS (
  SELECT coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
kept AS (SELECT lang, term FROM (SELECT lang, unnest(list_distinct(terms)) AS term FROM d) GROUP BY 1, 2 HAVING count(*) >= 10),
c AS (SELECT lang, source, term, count(*) AS n FROM (SELECT lang, source, unnest(terms) AS term FROM d) SEMI JOIN kept USING (lang, term) GROUP BY 1, 2, 3),
v AS (SELECT lang, count(*) AS v FROM kept GROUP BY 1),
x AS (
  SELECT g.lang, g.source, kept.term, coalesce(c.n, 0) AS n, v.v, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, g.source) AS tn,
         sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang, kept.term) AS ln, sum(coalesce(c.n, 0)) OVER (PARTITION BY g.lang) AS ltn
  FROM g JOIN kept USING (lang) JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = kept.term),
s AS (
  SELECT lang, source, term, n, 1 + (1000000000 * (n + 2)::HUGEINT) // (tn + 2 * v)::HUGEINT AS p, 1 + (1000000000 * (ln + 2)::HUGEINT) // (ltn + 2 * v)::HUGEINT AS q FROM x),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(((a.p - b.p) * (a.p - b.p)) // (a.p + b.p)) AS value
  FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY 1, 2, 3),
every AS (SELECT a.lang, a.source, b.source AS item, coalesce(p.value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs p ON p.lang = a.lang AND p.source = a.source AND p.item = b.source),
heap AS (SELECT lang, source, term AS item, ((p - q) * (p - q)) // (p + q) AS value FROM s WHERE n > 0 AND p > q),
both_ AS (SELECT lang, source, 'pair' AS part, item, value FROM every UNION ALL SELECT lang, source, 'term', item, value FROM heap)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank
FROM both_ QUALIFY part = 'pair' OR rank <= 10
"""
