"""N-gram Jaccard join with signature trees.

Documents are sets of word shingles; two link when intersection over union reaches 3/4.  Equal sets are one
class and enter the join once.  Nodes of the trees are rows of a set's size and token bitmap; sets move only
to where bitmaps and sizes leave a link possible.

1. Roots.  Sets that share a band of minhashes are the members of one tree.  A single tree over a corpus of
   unrelated texts cannot prune, since the OR of a few hundred unrelated bitmaps has all its bits; members of
   a band mostly resemble each other.  A pair at the threshold shares none of the BANDS bands with a chance of
   (1 - 0.75**ROWS)**BANDS, 6e-12.  What a band adds beyond true links costs time, never a wrong link.
2. First pass.  Every member meets the head of its tree, in a stream of members behind each head: by bitmap and
   size first, then the sets of what is left, exactly.  A group of near copies so costs its size, not its
   square.
   Large trees that this leaves in many components meet more heads, each from outside the largest one.
3. Second pass.  Trees whose members are still in several components are cut by size into blocks of about BLOCK
   members, the largest component apart, since it need not meet itself, so wide that a link stays in a size class or joins two that adjoin.  Each pair of blocks that may
   meet is a task.  A block is a tree over its members in order of component and size: each node holds the OR
   of its members' bitmaps, the range of their sizes, the least number of bits of a member and its component
   if it has but one.  Two trees are walked together; a pair of nodes is dropped when it is of one component,
   or when even the largest overlap that bitmaps and sizes allow misses the threshold.  Pairs of members that
   an earlier band has met are left to it.  Only then the sets of what is left are fetched and intersected
   exactly, and pairs that found links connect are not compared again.
4. The found links' connected components, and back from classes to documents.

Defined results: texts without words, or null, have the empty set and link with nothing; a text with fewer
words than a shingle is one shingle.  Repeated rows are copies.  A row with a null doc_id has a null
component and links with nothing; it does not change the components of other rows.  Empty tables give empty results; other
columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cloakfield.llm._shared import ascii_lower, binary_column, components, groups_in_order, list_column, materialize, table, uniform_hash, words

SHINGLE = 5
BANDS, ROWS = 68, 4
#: Sets of a block, bits of a bitmap, sets of a leaf.
BLOCK, BITS, LEAF = 256, 2048, 16
#: Ratio of a size class; linked sets differ in size by 4/3 at most, so a little more keeps rounding out of it.
CLASS = 1.34
#: Trees that pairs of blocks would copy more than MOST_COPIES times meet more heads first, MOST_HEADS at most.
MOST_COPIES, MOST_HEADS = 4, 12
SEED = 20


def shingle_set(text: Column) -> tuple[Column, Column]:
    """The lower-cased words, and from a column ``__words`` of them the sorted set of 64-bit shingle hashes."""
    w = F.col("__words")
    last = F.greatest(F.size(w) - SHINGLE, F.lit(0))
    some = F.transform(F.sequence(F.lit(0), last), lambda i: F.xxhash64(*[F.get(w, i + k) for k in range(SHINGLE)]))
    hashes = F.when(F.size(w) >= SHINGLE, some).when(F.size(w) > 0, F.array(F.xxhash64(w))).otherwise(F.array().cast("array<bigint>"))
    return words(ascii_lower(text)), F.sort_array(F.array_distinct(hashes))


def _bands(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces each set by its band keys."""
    rng = np.random.default_rng(SEED)
    flip = rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64)
    odd = rng.integers(0, 1 << 64, (BANDS * ROWS, 1), np.uint64) | np.uint64(1)
    mix = np.uint64(0x9E3779B97F4A7C15)
    number = np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)
    for batch in batches:
        t = pa.Table.from_batches([batch])
        values, at = list_column(t, "set") if batch.num_rows else (np.zeros(0, np.int64), np.zeros(1, np.int64))
        values = values.view(np.uint64)
        keys = np.zeros((batch.num_rows, BANDS), np.uint64)
        for i in range(batch.num_rows):
            own = values[at[i] : at[i + 1]]
            if not len(own):
                continue
            least = np.full(BANDS * ROWS, np.uint64(0xFFFFFFFFFFFFFFFF))
            for a in range(0, len(own), 4096):  # keeps the matrix small for very long texts
                np.minimum(least, ((own[a : a + 4096] ^ flip) * odd).min(1), out=least)
            least = least.reshape(BANDS, ROWS)
            key = number.copy()
            for r in range(ROWS):
                key = (key ^ least[:, r]) * mix
                key ^= key >> np.uint64(31)
            keys[i] = key
        lists = pa.ListArray.from_arrays(pa.array(np.arange(batch.num_rows + 1, dtype=np.int32) * BANDS), pa.array(keys.ravel().view(np.int64)))
        names = ["doc_id", "mark", "n", "f1", "f2", "bands"]
        yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in names[:-1]], lists], names=names)


def bitmaps(sets: list[np.ndarray]) -> np.ndarray:
    """One row of BITS bits a set."""
    maps = np.zeros((len(sets), BITS // 64), np.uint64)
    for m, s in zip(maps, sets):
        bit = s.view(np.uint64) % np.uint64(BITS)
        np.bitwise_or.at(m, (bit >> np.uint64(6)).astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return maps


def _with_maps(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the bitmap of each set."""
    for batch in batches:
        if batch.num_rows:
            values, at = list_column(pa.Table.from_batches([batch]), "set")
            maps = bitmaps([values[a:b] for a, b in zip(at, at[1:])])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array([m.tobytes() for m in maps], pa.binary())], names=[*batch.schema.names, "map"])


class _Tree:
    """Signature tree over members in order: level 0 has the members, the next level leaves of LEAF members, then pairs.

    A level is (bitmaps, least size, greatest size, least bits, component or -1).
    """

    def __init__(self, sizes: np.ndarray, maps: np.ndarray, parts: np.ndarray):
        self.sizes, self.maps, self.parts = sizes, maps, parts
        self.bits = np.bitwise_count(maps).sum(1).astype(np.int64)
        level = [maps, sizes, sizes, self.bits, parts]
        self.levels = []
        for width in [LEAF] + [2] * 64:
            starts = np.arange(0, len(level[0]), width)
            low, high = np.minimum.reduceat(level[4], starts), np.maximum.reduceat(level[4], starts)
            level = [np.bitwise_or.reduceat(level[0], starts), np.minimum.reduceat(level[1], starts), np.maximum.reduceat(level[2], starts), np.minimum.reduceat(level[3], starts), np.where(low == high, low, -1)]
            self.levels.append(level)
            if len(level[0]) == 1:
                break


def _possible(common, size_a, size_b, bits_a, bits_b, least_a, least_b):
    """Whether an overlap can reach the threshold: sizes are upper bounds, bits and least sizes lower bounds.

    Every bit of a member that the other side lacks stands for a token that is not shared.
    """
    most = np.minimum(size_a - np.maximum(bits_a - common, 0), size_b - np.maximum(bits_b - common, 0))
    most = np.minimum(most, np.minimum(size_a, size_b))
    return 7 * most >= 3 * (least_a + least_b)


def _leaf_pairs(a: _Tree, b: _Tree, same: bool) -> Iterator[tuple[int, int]]:
    """Walks both trees from their roots and yields the pairs of leaves that may hold a link."""
    stack = [(len(a.levels) - 1, 0, len(b.levels) - 1, 0)]
    while stack:
        la, i, lb, j = stack.pop()
        maps_a, lo_a, hi_a, bits_a, part_a = (x[i] for x in a.levels[la])
        maps_b, lo_b, hi_b, bits_b, part_b = (x[j] for x in b.levels[lb])
        if 4 * hi_a < 3 * lo_b or 4 * hi_b < 3 * lo_a or part_a == part_b >= 0:
            continue
        common = int(np.bitwise_count(maps_a & maps_b).sum())
        if not _possible(common, hi_a, hi_b, bits_a, bits_b, lo_a, lo_b):
            continue
        if la == lb == 0:
            yield i, j
            continue
        down_a = [i] if la == 0 else [k for k in (2 * i, 2 * i + 1) if k < len(a.levels[la - 1][0])]
        down_b = [j] if lb == 0 else [k for k in (2 * j, 2 * j + 1) if k < len(b.levels[lb - 1][0])]
        na, nb = max(0, la - 1), max(0, lb - 1)
        stack.extend((na, x, nb, y) for x in down_a for y in down_b if not (same and na == nb and x > y))


def _member_pairs(a: _Tree, b: _Tree, same: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of members of different components that may link, leaf pair by leaf pair."""
    for i, j in _leaf_pairs(a, b, same):
        x, y = np.arange(i * LEAF, min((i + 1) * LEAF, len(a.sizes))), np.arange(j * LEAF, min((j + 1) * LEAF, len(b.sizes)))
        common = np.bitwise_count(a.maps[x][:, None] & b.maps[y][None]).sum(2).astype(np.int64)
        sa, sb = a.sizes[x][:, None], b.sizes[y][None]
        may = _possible(common, sa, sb, a.bits[x][:, None], b.bits[y][None], sa, sb) & (a.parts[x][:, None] != b.parts[y][None])
        p, q = np.nonzero(may)
        u, v = x[p], y[q]
        if same:
            u, v = u[u < v], v[u < v]
        if len(u):
            yield u, v


def _linked(s: np.ndarray, t: np.ndarray) -> bool:
    both = len(s) + len(t) - len(np.unique(np.concatenate((s, t))))
    return 4 * both >= 3 * (len(s) + len(t) - both)


def _sorted_tree(sizes: np.ndarray, maps: np.ndarray, parts: np.ndarray) -> tuple[np.ndarray, _Tree]:
    order = np.lexsort((sizes, parts))
    return order, _Tree(sizes[order], maps[order], parts[order])


def join_blocks(a: list[np.ndarray], b: list[np.ndarray], same: bool, parts_a: np.ndarray | None = None, parts_b: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between two blocks of sorted sets (or within one): enough of them to connect what is linked, given the components so far."""
    parts_a = np.arange(len(a)) if parts_a is None else parts_a
    parts_b = (parts_a if same else np.arange(len(b)) + len(a)) if parts_b is None else parts_b
    order_a, tree_a = _sorted_tree(np.array([len(s) for s in a], np.int64), bitmaps(a), parts_a)
    order_b, tree_b = (order_a, tree_a) if same else _sorted_tree(np.array([len(s) for s in b], np.int64), bitmaps(b), parts_b)
    parent = {int(p): int(p) for p in np.concatenate((parts_a, parts_b))}

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    links = []
    for us, vs in _member_pairs(tree_a, tree_b, same):
        for u, v in zip(us, vs):
            ru, rv = root(int(tree_a.parts[u])), root(int(tree_b.parts[v]))
            if ru != rv and _linked(a[order_a[u]], b[order_b[v]]):
                parent[ru] = rv
                links.append((int(order_a[u]), int(order_b[v])))
    return links


def _sides(t: pa.Table) -> tuple[np.ndarray, np.ndarray, bool]:
    """The rows of the two blocks of a task."""
    block, i, j = t.column("block").to_numpy(), t.column("i")[0].as_py(), t.column("j")[0].as_py()
    left = np.flatnonzero(block == i)
    return left, left if i == j else np.flatnonzero(block == j), i == j


def _prune(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks of two blocks, by bitmaps and sizes: the members that some pair leaves over."""
    for t in groups_in_order(batches, ["root", "i", "j"]):
        left, right, same = _sides(t)
        if not len(left) or not len(right):
            continue
        sizes, parts, maps = t.column("n").to_numpy(), t.column("part").to_numpy(), binary_column(t, "map", BITS // 8)
        band = t.column("band")[0].as_py()
        values, at = list_column(t, "bands")
        earlier = values.reshape(len(at) - 1, -1)[:, :band]
        orders, trees = zip(*(_sorted_tree(sizes[x], maps[x], parts[x]) for x in ((left,) if same else (left, right))))
        stay = np.zeros(t.num_rows, bool)
        for u, v in _member_pairs(trees[0], trees[-1], same):
            x, y = left[orders[0][u]], right[orders[-1][v]]
            new = ~(earlier[x] == earlier[y]).any(1)
            stay[x[new]] = stay[y[new]] = True
        if stay.any():
            yield pa.RecordBatch.from_arrays([t.column(c).combine_chunks().filter(pa.array(stay)) for c in PRUNED], names=PRUNED)


PRUNED = ["root", "i", "j", "block", "rep", "part"]


def _join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tasks of two blocks, with sets: the links."""
    for t in groups_in_order(batches, ["root", "i", "j"]):
        left, right, same = _sides(t)
        if not len(left) or not len(right):
            continue
        values, at = list_column(t, "set")
        ids, parts = t.column("rep").to_numpy(), t.column("part").to_numpy()
        sides = [[values[at[k] : at[k + 1]] for k in x] for x in (left, right)]
        links = join_blocks(*sides, same, parts[left], parts[right])
        if links:
            x, y = np.array(links).T
            yield pa.RecordBatch.from_arrays([pa.array(ids[left[x]]), pa.array(ids[right[y]])], names=["a", "b"])


def _behind_heads(test):
    """Streams the members behind each head, which comes first, and yields (hub, share, rep) of those that pass ``test``; holds one head and one batch."""

    def stream(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hub, head = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            hubs, lead, rep = (t.column(c).to_numpy() for c in ("hub", "lead", "rep"))
            rows = test(t)
            stay = np.zeros(t.num_rows, bool)
            for k in range(t.num_rows):
                if lead[k] == 0:
                    hub, head = hubs[k], rows.take(k)
                else:
                    stay[k] = hub == hubs[k] and rows.fits(head, k)
            stay = pa.array(stay)
            yield pa.RecordBatch.from_arrays([batch.column(c).filter(stay) for c in ("hub", "share", "rep")], names=["hub", "share", "rep"])

    return stream


class _ByMap:
    """Members of a batch by size and bitmap."""

    def __init__(self, t: pa.Table):
        self.n, self.map = t.column("n").to_numpy(), binary_column(t, "map", BITS // 8)
        self.bits = np.bitwise_count(self.map).sum(1).astype(np.int64)

    def take(self, k: int):
        return self.n[k], self.map[k].copy(), self.bits[k]

    def fits(self, head, k: int) -> bool:
        n, m, bits = head
        common = int(np.bitwise_count(m & self.map[k]).sum())
        return bool(_possible(common, n, self.n[k], bits, self.bits[k], n, self.n[k]))


class _BySet:
    """Members of a batch by their sets."""

    def __init__(self, t: pa.Table):
        self.values, self.at = list_column(t, "set")

    def _set(self, k: int) -> np.ndarray:
        return self.values[self.at[k] : self.at[k + 1]]

    def take(self, k: int) -> np.ndarray:
        return self._set(k).copy()

    def fits(self, head: np.ndarray, k: int) -> bool:
        return _linked(head, self._set(k))


def _stars(pairs: DataFrame, nodes: DataFrame, payload: list[str], test, parts: int) -> DataFrame:
    """The rows (hub, share, rep) of ``pairs`` that pass a test of the payloads of both; a hub's payload goes once to each of its shares."""
    members = pairs.join(nodes.select("rep", *payload), "rep").select("hub", "share", F.lit(1).alias("lead"), "rep", *payload)
    heads = pairs.select("hub", "share").distinct().join(nodes.select(F.col("rep").alias("hub"), *payload), "hub")
    heads = heads.select("hub", "share", F.lit(0).alias("lead"), F.col("hub").alias("rep"), *payload)
    rows = heads.unionByName(members).repartition(parts, "hub", "share").sortWithinPartitions("hub", "share", "lead")
    return rows.mapInArrow(_behind_heads(test), "hub bigint, share bigint, rep bigint")


def _number(block_class: Column, k: Column) -> Column:
    """One number for block k of a size class."""
    return F.shiftleft(block_class, 32) + k


def _blocks(sizes: DataFrame) -> DataFrame:
    """Rows (root, size_class, major, block_class, n_blocks, near) from rows (root, size_class, major, sets).

    near lists the classes, with their numbers of blocks, that a block of this class meets: those of adjoining
    sizes, but not two of the tree's largest component.  A tree that fits one block is one class.  The windows
    see two rows a size class, some dozens a tree.
    """
    tree = Window.partitionBy("root")
    one = F.sum("sets").over(tree) <= BLOCK
    kind = F.col("size_class") + F.when(F.col("major"), F.lit(1 << 20)).otherwise(0)
    df = sizes.withColumn("block_class", F.when(one, 0).otherwise(kind)).withColumn("n_blocks", F.when(one, 1).otherwise(F.ceil(F.col("sets") / BLOCK)))
    df = df.withColumn("every", F.collect_set(F.struct("block_class", "n_blocks", "size_class", "major")).over(tree)).withColumn("one", one)
    meets = lambda x: (F.abs(x["size_class"] - F.col("size_class")) <= 1) & ~(x["major"] & F.col("major")) | F.col("one")
    near = F.array_distinct(F.transform(F.filter("every", meets), lambda x: F.struct(x["block_class"].alias("block_class"), x["n_blocks"].alias("n_blocks"))))
    return df.select("root", "size_class", "major", "block_class", "n_blocks", near.alias("near"))


def _open_trees(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Members (root, band, rep, part) of trees that are in several components by the links so far, and those trees as (root, g, largest, most)."""
    roots = components(links, "links").select(F.col("node").alias("rep"), F.col("root").alias("__part"))
    left = members.join(roots, "rep", "left").select("root", "band", "rep", F.coalesce("__part", "rep").alias("part"))
    left = materialize(left, "parted-members")
    several = left.groupBy("root").agg(F.min("part").alias("lo"), F.max("part").alias("hi")).where("lo < hi").select("root")
    left = materialize(left.join(materialize(several, "open-roots"), "root"), "open-members")
    parts = left.groupBy("root", "part").agg(F.count(F.lit(1)).alias("n"))
    trees = parts.groupBy("root").agg(F.sum("n").alias("g"), F.max(F.struct("n", "part")).alias("top"))
    return left, materialize(trees.select("root", "g", F.col("top.part").alias("largest"), F.col("top.n").alias("most")), "open-trees")


def _head_links(pairs: DataFrame, nodes: DataFrame, parts: int) -> DataFrame:
    """The links among distinct pairs (hub, rep), as (a, b)."""
    pairs = materialize(pairs, "pairs")
    sizes = materialize(pairs.groupBy("hub").agg(F.ceil(F.count(F.lit(1)) / BLOCK).alias("shares")), "heads")
    pairs = pairs.join(sizes, "hub").select("hub", "rep", F.pmod(uniform_hash(F.lit("share"), F.col("rep")), F.col("shares")).alias("share"))
    near = materialize(_stars(materialize(pairs, "shares"), nodes, ["n", "map"], _ByMap, parts), "near-heads")
    return materialize(_stars(near, nodes, ["set"], _BySet, parts).select(F.col("rep").alias("a"), F.col("hub").alias("b")), "head-links")


def ngram_join(docs: DataFrame) -> DataFrame:
    """Rows (doc_id, n_shingles, component_id), one for each document."""
    lower, hashes = shingle_set(F.col("text"))
    text = F.coalesce(F.col("text"), F.lit(""))
    sets = docs.select("doc_id", F.xxhash64(text).alias("mark"), lower.alias("__words")).withColumn("set", hashes)
    sets = sets.select("doc_id", "mark", F.size("set").cast("bigint").alias("n"), F.xxhash64("set").alias("f1"), F.xxhash64(F.lit("set"), "set").alias("f2"), "set")
    schema = "doc_id bigint, mark bigint, n bigint, f1 bigint, f2 bigint, bands array<bigint>"
    every = materialize(sets.mapInArrow(_bands, schema), "shingle-bands")

    first = F.min(F.struct("doc_id", "mark", "bands")).alias("first")
    classes = every.where("n > 0 and doc_id is not null").groupBy("n", "f1", "f2").agg(first)
    classes = materialize(classes.select("n", "f1", "f2", F.col("first.doc_id").alias("rep"), "first.mark", "first.bands"), "shingle-classes")

    parts = max(8, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    rows = classes.select("rep", F.posexplode("bands").alias("band", "root"))
    shared = rows.groupBy("root").agg(F.min("rep").alias("hub"), F.count(F.lit(1)).alias("many")).where("many > 1")
    shared = materialize(shared.drop("many"), "shared-bands")  # stored, so that Spark can split a band that many sets share
    members = materialize(rows.join(shared, "root"), "tree-members")

    ids = members.select("rep").distinct().join(classes.select("rep", "mark", "n", "bands"), "rep").select("rep", F.col("mark").alias("m"), "n", "bands")
    texts = docs.select("doc_id", "text", F.xxhash64(text).alias("mark"))
    # the marks are compared behind the join, so that it deals by id alone and one row an id is found without another shuffle
    found = texts.join(ids, F.col("doc_id") == F.col("rep")).where(F.col("mark").bitwiseXOR(F.col("m")) == 0).dropDuplicates(["rep"])
    found = found.select("rep", "n", "bands", lower.alias("__words")).withColumn("set", hashes).select("rep", "n", "bands", "set")
    nodes = materialize(found.mapInArrow(_with_maps, "rep bigint, n bigint, bands array<bigint>, set array<bigint>, map binary"), "tree-nodes")

    links = _head_links(members.where("rep <> hub").select("hub", "rep").distinct(), nodes, parts)
    members = members.select("root", "band", "rep")
    for k in range(MOST_HEADS):
        left, trees = _open_trees(members, links)
        # rows that pairs of blocks would copy, against the members there are
        minor = F.col("g") - F.col("most")
        copies = F.when(F.col("g") <= BLOCK, F.col("g")).otherwise(minor * F.ceil(F.col("g") / BLOCK) + F.col("most") * F.ceil(minor / BLOCK))
        n, many = trees.agg(F.coalesce(F.sum("g"), F.lit(0)), F.coalesce(F.sum(copies), F.lit(0))).first()
        if many <= MOST_COPIES * n:
            break
        # trees that blocks would copy much meet another head, from outside the largest component
        wide = left.join(trees.where(copies > MOST_COPIES * F.col("g")), "root")
        heads = wide.where("part <> largest").groupBy("root").agg(F.min_by(F.struct("rep", "part"), uniform_hash(F.lit(k), F.col("rep"))).alias("head"))
        heads = materialize(heads.select("root", F.col("head.rep").alias("hub"), F.col("head.part").alias("hub_part")), "more-heads")
        pairs = wide.select("root", "rep", "part").join(heads, "root").where("part <> hub_part").select("hub", "rep").distinct()
        links = links.unionByName(_head_links(pairs, nodes, parts))

    left = left.join(trees.select("root", "largest"), "root").select("root", "band", "rep", "part", (F.col("part") == F.col("largest")).alias("major"))
    left = left.join(nodes.select("rep", "n"), "rep").withColumn("size_class", F.floor(F.ln("n") / math.log(CLASS)).cast("bigint"))
    left = materialize(left, "sized-members")
    # stored, so that Spark can split a class that many sets share
    blocks = materialize(_blocks(left.groupBy("root", "size_class", "major").agg(F.count(F.lit(1)).alias("sets"))), "blocks")
    left = left.join(blocks, ["root", "size_class", "major"])
    block = _number(F.col("block_class"), F.pmod(uniform_hash(F.lit("block"), F.col("rep")), F.col("n_blocks")))
    others = F.transform("near", lambda x: F.transform(F.sequence(F.lit(0).cast("bigint"), x["n_blocks"] - 1), lambda k: _number(x["block_class"], k)))
    left = left.withColumn("block", block).withColumn("other", F.explode(F.flatten(others)))
    left = left.select("root", "band", "rep", "part", "block", F.least("block", "other").alias("i"), F.greatest("block", "other").alias("j"))
    keys = ["root", "i", "j"]
    left = left.join(nodes.select("rep", "n", "map", "bands"), "rep").repartition(parts, *keys).sortWithinPartitions(*keys)
    left = materialize(left.mapInArrow(_prune, "root bigint, i bigint, j bigint, block bigint, rep bigint, part bigint"), "unpruned")
    left = left.join(nodes.select("rep", "set"), "rep").repartition(parts, *keys).sortWithinPartitions(*keys)
    more = materialize(left.mapInArrow(_join, "a bigint, b bigint"), "block-links")
    roots = components(links.unionByName(more), "links")

    roots = roots.withColumnRenamed("node", "rep")
    classes = classes.select("n", "f1", "f2", "rep").join(roots, "rep", "left").select(*[F.col(c).alias(f"c_{c}") for c in ("n", "f1", "f2")], F.coalesce("root", "rep").alias("component"))
    same = (F.col("n") == F.col("c_n")) & (F.col("f1") == F.col("c_f1")) & (F.col("f2") == F.col("c_f2"))
    return every.select("doc_id", "n", "f1", "f2").join(classes, same, "left").select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("component", "doc_id")).alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The input's rows less all documents of a component but the one with the smallest id; rows without an id stay."""
    gone = ngram_join(docs).where("component_id <> doc_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


def query(spark, sf_dir):
    return ngram_join(table(spark, sf_dir, "documents"))


ORACLE = r"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, unnest(range(1, greatest(len(w) - 3, 2))) AS i, w FROM w WHERE len(w) > 0),
s AS (SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS g FROM starts),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
pairs AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS d, doc_id AS o FROM documents UNION SELECT r.d, pairs.b FROM r JOIN pairs ON r.o = pairs.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(o) FROM r WHERE r.d = d.doc_id) AS component_id FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id
"""
