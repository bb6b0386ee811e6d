"""Embedding near-dedup by lattice hashing.

Unit vectors are projected at random to eight dimensions and decoded to the nearest point of the E8 lattice;
a cell is two such points of independent projections together, in several independent tables.  A vector is
stored in its own cell of each table and also looks into the neighbouring cells that lie nearest to its
projections, both taken together.  Vectors that meet in a cell are compared by cosine in double precision, so
no reported link is below the threshold; how many of the true ones are found is a matter of the tables.
:func:`settings` makes cells finer as the vectors become more, without a step, and takes as many tables as keep
the chance of a pair at a cosine of 0.9 to be found above 0.99.

Only ids go to cells first.  Cells in which nothing can meet are dropped, and vectors are fetched for the
rest, once a cell; what cells a vector has is computed again where it is asked, which is exact, since projections
are made of numbers whose sums have no rounding.  A pair is compared where it meets first, by table and cell, so a task can report counts
and the links that connect its vectors, and never a row a pair.  Equal vectors are one class that enters
once, with its count.  A cell with many vectors is cut into blocks and every pair of blocks is a task, so no
cell meets in one place.

Defined results: vectors that are null, empty, zero or hold a null or non-finite component link with
nothing, as does a row without a vec_id.  Vectors of different lengths do not link.  Rows that repeat with
the same vec_id count once.  Empty tables give empty results; other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cloakfield.llm._shared import components, groups_in_order, list_column, materialize, table, uniform_hash

THRESHOLD, SEED = 0.9, 8
#: Vectors of a block of a cell, and linked vectors whose cells are computed together.
BLOCK, TOGETHER = 256, 4096


def _nearest_d8(x: np.ndarray) -> np.ndarray:
    """The nearest integer points with even sums: round, and where the sum is odd round the worst coordinate the other way."""
    near = np.rint(x)
    off = x - near
    row = np.flatnonzero(near.sum(1) % 2)
    worst = np.abs(off[row]).argmax(1)
    near[row, worst] += np.where(off[row, worst] >= 0, 1.0, -1.0)
    return near


def nearest_e8(x: np.ndarray) -> np.ndarray:
    """The nearest points of E8, which is D8 together with D8 moved by one half in every coordinate."""
    whole, half = _nearest_d8(x), _nearest_d8(x - 0.5) + 0.5
    closer = ((x - whole) ** 2).sum(1) <= ((x - half) ** 2).sum(1)
    return np.where(closer[:, None], whole, half)


@cache
def e8_neighbours() -> np.ndarray:
    """The 240 shortest lattice vectors: two coordinates of one, or all of one half with an even number of minuses."""
    pairs = [s * np.eye(8)[i] + t * np.eye(8)[j] for i in range(8) for j in range(i) for s in (1, -1) for t in (1, -1)]
    signs = np.array([[-0.5 if m >> k & 1 else 0.5 for k in range(8)] for m in range(256)])
    return np.concatenate([np.array(pairs), signs[(signs < 0).sum(1) % 2 == 0]])


def _cell(points: np.ndarray, table_number: int) -> np.ndarray:
    """Lattice points as numbers: their doubled coordinates, six bits each (finer scales wrap, which only merges far cells)."""
    code = np.full(points.shape[:-1], table_number, np.int64)
    for k in range(8):
        code = (code << 6) | ((2 * points[..., k]).astype(np.int64) & 63)
    return code


#: The chance that two vectors at a cosine of 0.9 meet in one table, with four probes, by scale (measured).
MEETING = {0.45: 0.049, 0.55: 0.132, 0.65: 0.238, 0.75: 0.362, 0.9: 0.524, 1.0: 0.608}
#: Bits after the point of what is projected, so that sums of products are exact in a double.
BITS = 20


def settings(n: int) -> dict:
    """Scale of the lattice, cells probed a table, and tables, for n vectors.

    The share of all pairs that meet falls about as exp(16 * scale), so this scale lets it fall with the root of n.
    """
    scale = min(1.0, max(0.45, 0.755 - 0.0307 * math.log(max(1, n) / 1_000_000)))
    chance = float(np.interp(scale, list(MEETING), list(MEETING.values())))
    return {"scale": scale, "probes": 4, "tables": math.ceil(math.log(0.008) / math.log(1 - chance))}


def _unit(v: np.ndarray) -> np.ndarray:
    v = v.astype(np.float64)
    v /= np.abs(v).max(1, keepdims=True)  # first by the largest component, whose square might be too small for a double
    return v / np.linalg.norm(v, axis=1, keepdims=True)


def _grid(x: np.ndarray) -> np.ndarray:
    return np.rint(x * 2.0**BITS) / 2.0**BITS


@cache
def _projections(dim: int, scale: float, tables: int) -> np.ndarray:
    """Two projections a table; the first tables are the same whatever their number."""
    return _grid(np.random.default_rng((SEED, dim)).normal(0, 1 / (np.sqrt(8) * scale), (tables, 2, dim, 8)))


def _cells(unit: np.ndarray, scale: float, probes: int, tables: int) -> np.ndarray:
    """Cells of unit vectors in the first ``tables`` tables, as (vector, table, cell) with a vector's own cell first.

    The same vector gets the same cells in any batch: all sums are exact and ties go by order.
    """
    projections, neighbours, unit = _projections(unit.shape[1], scale, tables), e8_neighbours(), _grid(unit)
    order = np.arange(len(neighbours)) * 2.0 ** (-2 * BITS - 9)
    out = np.empty((len(unit), tables, probes + 1), np.int64)
    for k in range(tables):
        sides = []
        for projection in projections[k]:
            x = unit @ projection
            own = nearest_e8(x)
            further = 2 - 2 * ((x - own) @ neighbours.T) + order  # by how much a neighbour is further than the own point
            near = np.argpartition(further, probes, axis=1)[:, :probes]
            more = np.take_along_axis(further, near, 1)
            sort = np.argsort(more, axis=1)
            points = np.concatenate([own[:, None], own[:, None] + neighbours[np.take_along_axis(near, sort, 1)]], 1)
            sides.append((_cell(points, k), np.concatenate([np.zeros((len(x), 1)), np.take_along_axis(more, sort, 1)], 1)))
        (a, more_a), (b, more_b) = sides
        both = ((a.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[:, :, None] ^ b.view(np.uint64)[:, None, :]).reshape(len(unit), -1)
        more = (more_a[:, :, None] + more_b[:, None, :]).reshape(len(unit), -1)
        more[:, 0] = -1  # the own cell
        out[:, k] = np.take_along_axis(both, np.argsort(more, axis=1, kind="stable")[:, : probes + 1], 1).view(np.int64)
    return out


def _hash(scale: float, probes: int, tables: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            t = pa.Table.from_batches([batch]).combine_chunks()
            if not t.num_rows:
                continue
            values, at = list_column(t, "embedding")
            length, ids = np.diff(at), t.column("rep").to_numpy()
            for dim in np.unique(length):
                mine = np.flatnonzero(length == dim)
                cells = _cells(_unit(values[at[mine][:, None] + np.arange(dim)]), scale, probes, tables)
                each = tables * (probes + 1)
                number = np.tile(np.repeat(np.arange(tables, dtype=np.int16), probes + 1), len(mine))
                own = np.tile(np.arange(each) % (probes + 1) == 0, len(mine))
                columns = [np.repeat(ids[mine], each), np.full(len(number), dim, np.int32), cells.ravel(), number, own]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "dim", "cell", "number", "own"])

    return rows


def _first_here(cells: np.ndarray, p: np.ndarray, q: np.ndarray, table_number: int, cell: int) -> np.ndarray:
    """Whether pairs of rows meet for the first time in this table and cell."""
    own = cells[:, :, 0]
    upto = cells[:, : table_number + 1]
    first = np.zeros(len(p), bool)
    for a in range(0, len(p), 8192):
        x, y = p[a : a + 8192], q[a : a + 8192]
        in_y = (own[x, : table_number + 1, None] == upto[y]).any(2)
        in_x = (own[y, : table_number + 1, None] == upto[x]).any(2)
        before = (in_x | in_y)[:, :-1].any(1)
        twice = in_x[:, -1] & in_y[:, -1]
        first[a : a + 8192] = ~before & (~twice | (np.minimum(own[x, table_number], own[y, table_number]) == cell))
    return first


def _compare(threshold: float, scale: float, probes: int):
    def settle(waiting: list[tuple]) -> Iterator[pa.RecordBatch]:
        """What the links of several groups add up to, each counted where its vectors meet first."""
        if not waiting:
            return
        cells = _cells(np.concatenate([w[4] for w in waiting]), scale, probes, 1 + max(w[0] for w in waiting))
        parts, at = [], 0
        for number, cell, ids, copies, _, p, q in waiting:
            here = _first_here(cells[at : at + len(ids)], p, q, number, cell)
            at += len(ids)
            p, q = p[here], q[here]
            others = np.zeros(len(ids), np.int64)
            np.add.at(others, p, copies[q])
            np.add.at(others, q, copies[p])
            hub = np.arange(len(ids))
            while True:
                old = hub.copy()
                np.minimum.at(hub, p, hub[q])
                np.minimum.at(hub, q, hub[p])
                if (hub == old).all():
                    break
            rows = np.flatnonzero(others)
            parts.append((ids[rows], others[rows], ids[hub[rows]]))
        columns = [pa.array(np.concatenate(c)) for c in zip(*parts)]
        yield pa.RecordBatch.from_arrays(columns, names=["rep", "others", "hub"])

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: list[tuple] = []
        for t in groups_in_order(batches, ["cell", "dim", "i", "j"]):
            own = t.column("own").to_numpy(zero_copy_only=False)
            a, b = np.flatnonzero(own), np.flatnonzero(~own)
            i, j, cell, number = (t.column(c)[0].as_py() for c in ("i", "j", "cell", "number"))
            block, ids, copies = (t.column(c).to_numpy() for c in ("block", "rep", "copies"))
            v = _unit(list_column(t, "embedding")[0].reshape(len(ids), -1))
            found = []
            # residents of block i with residents and visitors of block j, and where the blocks differ the other way round
            for x, y in ((i, j), (j, i))[: 1 + (i != j)]:
                left = a[block[a] == x]
                for right in (a[block[a] == y] if (x, y) == (i, j) else a[:0], b[block[b] == y]):
                    if len(left) and len(right):
                        p, q = np.nonzero(v[left] @ v[right].T >= threshold)
                        p, q = left[p], right[q]
                        twice = own[q] & (i == j)  # residents of one block meet in both orders
                        keep = ~twice | (ids[p] < ids[q])
                        found.append((p[keep], q[keep]))
            if not found:
                continue
            p, q = (np.concatenate(x) for x in zip(*found))
            if not len(p):
                continue
            linked, ends = np.unique(np.concatenate([p, q]), return_inverse=True)
            if waiting and (waiting[0][4].shape[1] != v.shape[1] or sum(len(w[2]) for w in waiting) > TOGETHER):
                yield from settle(waiting)
                waiting = []
            waiting.append((number, cell, ids[linked], copies[linked], v[linked], ends[: len(p)], ends[len(p) :]))
        yield from settle(waiting)

    return pairs


def embedding_links(classes: DataFrame, threshold: float, scale: float, probes: int, tables: int) -> DataFrame:
    """Rows (rep, others, hub) from rows (rep, copies, embedding): parts of the number of vectors that rep links with, and links that connect what is linked."""
    rows = classes.select("rep", "embedding").mapInArrow(_hash(scale, probes, tables), "rep bigint, dim int, cell bigint, number smallint, own boolean")
    rows = materialize(rows, "vector-cells")
    sizes = rows.groupBy("cell", "dim", "number").agg(F.count(F.when(F.col("own"), 1)).alias("residents"), F.count(F.lit(1)).alias("all"))
    # a cell without a resident, or with nothing but one, compares nothing
    sizes = sizes.where("residents > 0 and all > 1").select("cell", "dim", "number", F.ceil(F.col("all") / BLOCK).cast("int").alias("n_blocks"))
    sizes = materialize(sizes, "cells")  # stored, so that Spark can split a cell that many vectors share
    rows = rows.join(sizes, ["cell", "dim", "number"])
    rows = rows.withColumn("block", F.pmod(uniform_hash(F.lit("block"), F.col("rep")), F.col("n_blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)))
    rows = rows.select("cell", "dim", "number", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"), "block", "own", "rep")
    rows = rows.join(classes.select("rep", "copies", "embedding"), "rep")
    keys = ["cell", "dim", "i", "j"]
    parts = max(8, int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(_compare(threshold, scale, probes), "rep bigint, others bigint, hub bigint")


def embedding_dedup(vectors: DataFrame, threshold: float = THRESHOLD, **options) -> DataFrame:
    """Rows (vec_id, n_links, component_id, kept), one for each row of ``vectors``; options override :func:`settings`."""
    v = F.col("embedding")
    odd = F.exists(v, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")))
    good = v.isNotNull() & ~F.coalesce(odd, F.lit(True)) & F.exists(v, lambda x: x != 0)
    rows = vectors.select("vec_id", F.when(good & F.col("vec_id").isNotNull(), v).alias("embedding"))
    rows = rows.withColumn("f1", F.when(F.col("embedding").isNotNull(), F.xxhash64("embedding"))).withColumn("f2", F.when(F.col("embedding").isNotNull(), F.xxhash64(F.lit("v"), "embedding")))
    sound = rows.where(F.col("f1").isNotNull()).dropDuplicates(["vec_id", "f1", "f2"])
    first = F.min(F.struct("vec_id", "embedding")).alias("first")
    classes = sound.groupBy("f1", "f2").agg(first, F.count(F.lit(1)).alias("copies"))
    classes = materialize(classes.select("f1", "f2", "copies", F.col("first.vec_id").alias("rep"), "first.embedding"), "vector-classes")
    links = materialize(embedding_links(classes, threshold, **(settings(classes.count()) | options)), "vector-links")
    roots = components(links.select(F.col("rep").alias("a"), F.col("hub").alias("b")), "vector-components").withColumnRenamed("node", "rep")
    others = links.groupBy("rep").agg(F.sum("others").alias("others"))
    classes = classes.drop("embedding").join(others, "rep", "left").join(roots, "rep", "left")
    classes = classes.select(
        F.col("f1").alias("c1"), F.col("f2").alias("c2"),
        (F.col("copies") - 1 + F.coalesce("others", F.lit(0))).alias("n_links"), F.coalesce("root", "rep").alias("component_id"),
    )
    out = rows.select("vec_id", "f1", "f2").join(classes, (F.col("f1") == F.col("c1")) & (F.col("f2") == F.col("c2")), "left")
    component = F.coalesce("component_id", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0)).cast("bigint").alias("n_links"), component.alias("component_id"), F.coalesce(F.col("vec_id") == component, F.lit(True)).alias("kept"))


def query(spark, sf_dir):
    return embedding_dedup(table(spark, sf_dir, "embeddings"))


#: What the query returns when every link is found; on tables where a link is missed the two differ by that link.
ORACLE = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
r AS (SELECT vec_id AS d, vec_id AS o FROM v UNION SELECT r.d, l.b FROM r JOIN l ON r.o = l.a),
c AS (SELECT d, min(o) AS component_id FROM r GROUP BY 1)
SELECT vec_id, (SELECT count(*) FROM l WHERE l.a = vec_id) AS n_links, component_id, vec_id = component_id AS kept FROM v JOIN c ON d = vec_id
"""
