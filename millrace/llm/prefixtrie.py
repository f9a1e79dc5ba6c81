"""Prefix trie of conversations: union-find over the edges between sorted neighbours.

A conversation is a sequence of items, each 24 bytes: 16 of the SHA-256 of role and text, 8 of the text's length.

1. ``numbered``: turns get their places by a range sort and the row counts of the ranges before, so that no conversation meets in one task.
2. ``_blocks``: sequences are cut every ``BLOCK`` turns; a block also holds the next item (behind a full last block comes an empty one), and the ``root`` (a sum of hashes of the blocks before) in whose trie it lies. So rows
   stay small, however long a conversation is. Equal blocks become one row with a count before anything else is done.
3. ``_forest``: blocks are range-sorted. Two sorted neighbours of one root have an edge, which weighs as many items as they share. Every range takes its edges in descending
   weight; a union-find component that merges becomes a node of that depth, its parts are the node's children. What a component needs (members, leaves, bytes) are sums over its interval.
4. ``_merge``: nodes whose interval reaches a border that they cross are open, at most two paths per range. These are contracted to one row each and merged by their prefix across borders.
5. Blocks behind the first come first: what lies below their root is added, block by block from behind, to the conversations that go on there.

Defined results: turns are ordered by turn (null first), then role, the first 64 characters and the hash of the text; rows that are equal in all are interchangeable. Null role or text is the
empty string. Rows with a null conversation are left out. An empty table has no node. Conversations without a turn are members of the root alone. Only the named columns are read.
Items are told apart by 128 bits of SHA-256, roots by sums of three 40-bit words of it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from millrace.llm.joined import joined_sha256, sortable
from millrace.session import cut_lineage

BLOCK = 32  # turns
ITEM = 24  # bytes
ROWS = 50_000  # of a range
SLICE = 1024  # blocks of a conversation summed together


def _ranged(rows: DataFrame, columns: list[Column]) -> DataFrame:
    """The rows in order, with the range (``part``) and place (``at``, without gaps in a range) of each, as a table."""
    rows = cut_lineage(rows)
    parts = max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-rows.count() // ROWS))
    placed = rows.repartitionByRange(parts, *columns).sortWithinPartitions(*columns)
    return cut_lineage(placed.withColumn("part", F.spark_partition_id().cast("long")).withColumn("at", F.monotonically_increasing_id()))


def item(role: Column, text: Column) -> Column:
    """24 bytes that stand for a turn."""
    whole = F.concat_ws(":", F.octet_length(role).cast("string"), F.concat(role, text))
    size = F.lpad(F.hex(F.octet_length(text).cast("long")), 16, "0")
    return F.unhex(F.concat(F.substring(F.sha2(whole, 256), 1, 32), size))


def numbered(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """The turns in order (``conv``, ``item``, ``part``, ``at``), and for each conversation and range the ``shift`` that makes ``at + shift`` the place from 1, with ``n`` rows."""
    who, what = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    rows = df.select(F.col(conv).cast("long").alias("conv"), F.col(turn).alias("turn"), who.alias("role"), F.substring(what, 1, 64).alias("head"), item(who, what).alias("item"))
    order = [F.col("conv"), F.col("turn").asc_nulls_first(), F.col("role"), F.col("head"), F.col("item")]
    placed = _ranged(rows.where("conv IS NOT NULL"), order).select("conv", "item", "part", "at")
    counts = placed.groupBy("conv", "part").agg(F.count("*").alias("n"), F.min("at").alias("first"))
    before = Window.partitionBy("conv").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row per range of a conversation
    shift = F.coalesce(F.sum("n").over(before), F.lit(0)) - F.col("first") + 1
    return placed, cut_lineage(counts.select("conv", "part", "n", shift.alias("shift")))


def rebuilt(placed: DataFrame, places: DataFrame, every: int = 5, heads: int = 9) -> DataFrame:
    """``conv``, ``place`` and ``item`` of conversations that share heads: the first ``h`` turns of conversation ``c - c % every``, then ``c``'s own turns behind its first ``h``.

    ``h`` is the CRC-32 of the decimal number modulo ``heads``. Every conversation also has a row with place 0 and no item.
    """
    h = F.crc32(F.col("conv").cast("string")) % heads
    most = heads - 1
    first = placed.where(F.col("conv") % every == 0).join(places, ["conv", "part"]).withColumn("place", F.col("at") + F.col("shift"))
    first = first.where(F.col("place") <= most).groupBy("conv").agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("head"))  # at most 8
    first = first.select(F.col("conv").alias("base"), "head")
    convs = places.select("conv").distinct().withColumn("h", h).withColumn("base", F.col("conv") - F.col("conv") % every)
    convs = convs.join(first, "base", "left").withColumn("head", F.when(F.col("h") > 0, F.slice("head", 1, F.greatest("h", F.lit(1)))))
    convs = cut_lineage(convs.select("conv", "h", "head", F.coalesce(F.when(F.col("head").isNotNull(), F.size("head")), F.lit(0)).alias("taken")))
    mark = F.array(F.struct(F.lit(0).cast("long").alias("place"), F.lit(None).cast("binary").alias("item")))
    heads_of = convs.select("conv", F.explode(F.concat(mark, F.coalesce("head", F.slice(mark, 1, 0)))).alias("s")).select("conv", "s.place", "s.item")
    moved = cut_lineage(places.join(convs.select("conv", "h", "taken"), "conv").drop("n"))
    own = placed.join(moved, ["conv", "part"]).withColumn("place", F.col("at") + F.col("shift") - F.col("h"))
    return heads_of.union(own.where("place > 0").select("conv", F.col("place") + F.col("taken"), "item"))


def _before(rows: DataFrame, columns: list[str], behind: bool = False) -> DataFrame:
    """Each of ``columns`` replaced by its sum over the blocks of the conversation before (or ``behind``) this one; slices of blocks are summed on their own."""
    rows = cut_lineage(rows.withColumn("_slice", F.floor(F.col("m") / SLICE).cast("long")))
    along = [F.col(c).desc() if behind else F.col(c) for c in ("_slice", "m")]
    sums = rows.groupBy("conv", "_slice").agg(*[F.sum(c).alias(c) for c in columns])
    outer = Window.partitionBy("conv").orderBy(along[0]).rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("conv", "_slice", *[F.coalesce(F.sum(c).over(outer), F.lit(0)).alias(f"_{c}") for c in columns])
    inner = Window.partitionBy("conv", "_slice").orderBy(along[1]).rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.select("*", *[F.coalesce(F.sum(c).over(inner), F.lit(0)).alias(f"_i_{c}") for c in columns]).drop(*columns)
    rows = rows.join(sums, ["conv", "_slice"])
    return rows.select("*", *[(F.col(f"_i_{c}") + F.col(f"_{c}")).alias(c) for c in columns]).drop("_slice", *[f"{p}{c}" for p in ("_i_", "_") for c in columns])


def _blocks(turns: DataFrame) -> DataFrame:
    """``conv``, ``m`` (number of the block), ``root``, ``key`` (its items and the next one) and ``size`` (items in the key), as a table."""
    m = F.when(F.col("place") > 0, F.floor((F.col("place") - 1) / BLOCK)).otherwise(0).cast("long")
    here = F.struct(m.alias("m"), "place", "item")
    also = F.struct((m - 1).alias("m"), "place", "item")
    mark = F.struct((m + 1).alias("m"), "place", F.lit(None).cast("binary").alias("item"))  # a full block is followed by one, if an empty one
    several = F.when((F.col("place") > 1) & ((F.col("place") - 1) % BLOCK == 0), F.array(also, here)).otherwise(F.array(here))
    several = F.when((F.col("place") > 0) & (F.col("place") % BLOCK == 0), F.array(here, mark)).otherwise(several)
    laid = turns.select("conv", F.explode(several).alias("s")).select("conv", "s.*")
    listed = laid.groupBy("conv", "m").agg(F.sort_array(F.collect_list(F.struct("place", "item"))).alias("list"))  # at most BLOCK + 2 (a mark, the items, the next one)
    key = F.unhex(F.array_join(F.transform("list", lambda x: F.hex(x["item"])), ""))
    blocks = cut_lineage(listed.select("conv", "m", key.alias("key")).withColumn("size", (F.length("key") / ITEM).cast("int")))
    several = (F.col("m") > 0) | (F.col("size") >= BLOCK)
    marked = F.sha2(F.concat(F.encode(F.concat(F.col("m").cast("string"), F.lit(":")), "UTF-8"), F.substring("key", 1, BLOCK * ITEM)), 256)
    words = [F.conv(F.substring(marked, 1 + 10 * i, 10), 16, 10).cast("long").alias(f"w{i}") for i in range(3)]
    rooted = _before(blocks.where(several).select("*", *words), ["w0", "w1", "w2"])
    root = F.unhex(F.concat(*[F.lpad(F.hex(f"w{i}"), 16, "0") for i in range(3)]))
    columns = ["conv", "m", "root", "key", "size"]
    at_first = F.lit(b"").alias("root")
    single = blocks.where(~several).withColumn("root", at_first)
    return cut_lineage(single.select(columns).union(rooted.withColumn("root", F.when(F.col("m") == 0, at_first).otherwise(root)).select(columns)))


def _end_id() -> Column:
    text = F.concat(F.encode(F.concat(F.col("m").cast("string"), F.lit(":")), "UTF-8"), F.col("root"), F.col("key"))
    return F.unhex(F.substring(F.sha2(text, 256), 1, 32))


def _shared(key: np.ndarray, first: np.ndarray, size: np.ndarray, same: np.ndarray) -> np.ndarray:
    """For each row the number of items it shares with the row before, -1 where ``same`` says that this has another root."""
    out = np.where(same, 0, -1)
    live = np.flatnonzero(same)
    depth = 0
    while len(live):
        live = live[(size[live] > depth) & (size[live - 1] > depth)]
        live = live[(key[first[live] + depth] == key[first[live - 1] + depth]).all(axis=1)]
        depth += 1
        out[live] = depth
    return out


class _Components:
    """Union-find over rows in sorted order. A component is a node of the trie: an interval of rows and its depth."""

    def __init__(self, depth: np.ndarray, conv: np.ndarray):
        rows = len(depth)
        self.up = list(range(rows))  # of rows
        self.node = list(range(rows))  # of the component a row stands for
        self.left, self.right = list(range(rows)), list(range(rows))  # by node, as are those below
        self.depth, self.conv = depth.tolist(), conv.tolist()
        self.edges, self.parent, self.low = [0] * rows, [-1] * rows, [0] * rows

    def find(self, row: int) -> int:
        while self.up[row] != row:
            self.up[row] = self.up[self.up[row]]
            row = self.up[row]
        return row

    def merge(self, edges: list[int], depth: int) -> None:
        """Edges to the row before, all of weight ``depth``; those of greater weight have been merged."""
        nodes: dict[int, list[int]] = {}
        for row in edges:
            a, b = self.find(row - 1), self.find(row)
            parts = nodes.pop(a, [self.node[a]]) + nodes.pop(b, [self.node[b]])
            self.up[b] = a
            nodes[a] = parts
        for row, parts in nodes.items():
            new = len(self.depth)
            self.left.append(min(self.left[p] for p in parts))
            self.right.append(max(self.right[p] for p in parts))
            self.depth.append(depth)
            self.conv.append(min(self.conv[p] for p in parts))
            self.edges.append(len(parts) - 1)
            self.parent.append(-1)
            self.low.append(0)
            self.node[row] = new
            for p in parts:
                self.parent[p], self.low[p] = new, depth + 1


NODES = (
    "part long, piece long, parent_piece long, m long, inner long, conv long, parent_conv long, n long, edges long, ended long, leaves long, saved long, "
    "end_id binary, node_id binary"
)


def _range_forest(table: pa.Table) -> pa.Table:
    """The nodes of one range, whose table also has the last row before it and the first behind it (``side`` -1 and 1)."""
    table = table.sort_by([("side", "ascending"), ("at", "ascending")]).combine_chunks()
    part, side, m, n, conv, x_saved, x_leaves = (table[c].to_numpy() for c in ("part", "side", "m", "n", "conv", "x_saved", "x_leaves"))
    roots, keys, ends = (table[c].to_pylist() for c in ("root", "key", "end_id"))
    size = np.array([len(k) // ITEM for k in keys], np.int64)
    first = np.cumsum(size) - size
    items = np.frombuffer(b"".join(keys), ">u8").reshape(-1, 3)
    same = np.array([False, *(m[i] == m[i - 1] and roots[i] == roots[i - 1] for i in range(1, len(m)))])
    shared = _shared(items, first, size, same)
    sums = np.concatenate(([0], np.cumsum(items[:, 2].astype(np.int64))))
    held = np.minimum(size, BLOCK)
    total = sums[first + held] - sums[first]
    fresh = total - (sums[first + np.maximum(shared, 0)] - sums[first])  # bytes of the items that the row before does not share
    behind = np.append(shared[1:], -1)
    leaf = (size < BLOCK) & (behind < size)  # of full blocks the next ones tell

    low = int(np.count_nonzero(side < 0))
    high = len(side) - int(np.count_nonzero(side > 0))
    own = slice(low, high)
    left, right = int(shared[low]), int(behind[high - 1])  # items shared across the borders
    key_of, root_of, end_of = keys[own], roots[own], ends[own]
    m, n, conv, size, first, held, total, fresh, shared = (x[own] for x in (m, n, conv, size, first, held, total, fresh, shared))
    c = _Components(held, conv)
    inside = np.arange(1, len(m))[shared[1:] >= 0]
    inside = inside[np.argsort(-shared[inside], kind="stable")]
    levels = np.flatnonzero(np.diff(shared[inside], prepend=-2)) if len(inside) else []
    for begin, end in zip(levels, [*levels[1:], len(inside)]):
        c.merge(inside[begin:end].tolist(), int(shared[inside[begin]]))

    depth, lowest = np.array(c.depth, np.int64), np.array(c.low, np.int64)
    many = np.maximum(depth - lowest + 1, 0)  # none for a row that ends at a node of several
    node = np.repeat(np.arange(len(depth)), many)
    at = np.arange(len(node)) - np.repeat(np.cumsum(many) - many, many) + lowest[node]
    l, r = np.array(c.left, np.int64)[node], np.array(c.right, np.int64)[node]
    parent, member = np.array(c.parent, np.int64), np.array(c.conv, np.int64)

    def over(values: np.ndarray, start: np.ndarray) -> np.ndarray:
        summed = np.concatenate(([0], np.cumsum(values.astype(np.int64))))
        return summed[r + 1] - summed[start]

    def opened(l: np.ndarray, r: np.ndarray, at: np.ndarray) -> np.ndarray:
        return ((l == 0) & (left >= at)) | ((r == len(m) - 1) & (right >= at))

    members = over(n, l)
    above = sums[first[l] + np.maximum(at - 1, 0)] - sums[first[l]]
    later = (l == 0) & (left >= at)  # the node begins in a range before
    distinct = np.where(later, over(fresh, l), total[l] - above + over(fresh, np.minimum(l + 1, r + 1)))
    saved = over(n * total + x_saved[own], l) - members * above - distinct
    deepest = at == depth[node]
    edges = np.where(deepest, np.array(c.edges, np.int64)[node], 0) + ((l == 0) & (left == at))
    ended = size[l] == at
    is_open = opened(l, r, at)
    top = at == lowest[node]
    parent_node = np.where(top, parent[node], node)
    has_parent = at > 0
    pl, pr = np.array(c.left, np.int64)[parent_node], np.array(c.right, np.int64)[parent_node]
    parent_open = has_parent & opened(np.where(top, pl, l), np.where(top, pr, r), at - 1)
    piece = node * (BLOCK + 1) + at
    parent_piece = parent_node * (BLOCK + 1) + at - 1

    ids: list[bytes | None] = [None] * len(node)
    for i in np.flatnonzero(is_open).tolist():
        row = int(l[i])
        ids[i] = hashlib.sha256(b"%d:%d:" % (m[row], at[i]) + root_of[row] + key_of[row][: ITEM * int(at[i])]).digest()[:16]
    end_ids = [end_of[row] if e else None for row, e in zip(l.tolist(), ended.tolist())]
    columns = [
        pa.array(np.full(len(node), part[0], np.int64)), pa.array(piece, mask=~is_open), pa.array(parent_piece, mask=~parent_open), pa.array(m[l]), pa.array(at),
        pa.array(member[node]), pa.array(member[parent_node], mask=~has_parent | parent_open), pa.array(members), pa.array(edges), pa.array(ended.astype(np.int64)),
        pa.array(over(leaf[own] + x_leaves[own], l)), pa.array(saved), pa.array(end_ids, pa.binary()), pa.array(ids, pa.binary()),
    ]
    return pa.table(columns, names=[f.split()[0] for f in NODES.split(", ")])


ROW = ["m", "root", "key", "n", "conv", "end_id", "x_saved", "x_leaves", "at"]


def _forest(rows: DataFrame) -> DataFrame:
    """The nodes of the tries of all roots, from distinct blocks: ``m``, ``inner`` (depth in the block), ``conv``, ``parent_conv``, ``n``, ``edges``, ``ended``, ``leaves``, ``saved``, ``end_id``."""
    placed = _ranged(rows, [F.col("m"), F.col("root"), F.col("key")])
    whole = F.struct(*ROW)
    borders = cut_lineage(placed.groupBy("part").agg(F.min_by(whole, "at").alias("first"), F.max_by(whole, "at").alias("last")))
    present = sorted(r["part"] for r in borders.select("part").collect())  # one number per range
    links = rows.sparkSession.createDataFrame(list(zip(present, present[1:])), "part long, next long")
    before = borders.join(links, "part").select(F.col("next").alias("part"), F.lit(-1).alias("side"), "last.*")
    behind = links.join(borders.select(F.col("part").alias("next"), "first"), "next").select("part", F.lit(1).alias("side"), "first.*")
    sided = placed.select("part", F.lit(0).alias("side"), *ROW).union(before).union(behind)
    return _merge(cut_lineage(sided.groupBy("part").applyInArrow(_range_forest, NODES)))


def _merge(pieces: DataFrame) -> DataFrame:
    """Open pieces become one row per node; parents that are open get their smallest member."""
    columns = ["m", "inner", "conv", "parent_conv", "n", "edges", "ended", "leaves", "saved", "end_id"]
    open_pieces = pieces.where("piece IS NOT NULL")
    sums = [F.sum(c).alias(c) for c in ("n", "edges", "leaves", "saved")]
    link = F.min(F.when(F.col("parent_piece").isNotNull(), F.struct("part", "parent_piece"))).alias("link")
    whole = open_pieces.groupBy("node_id").agg(
        F.first("m").alias("m"), F.first("inner").alias("inner"), F.min("conv").alias("conv"), *sums, F.max("ended").alias("ended"), F.max("end_id").alias("end_id"), link
    )
    whole = cut_lineage(whole)
    known = open_pieces.select("part", "piece", "node_id").join(whole.select("node_id", "conv"), "node_id")
    known = cut_lineage(known.select("part", F.col("piece").alias("parent_piece"), F.col("conv").alias("parent_conv")))
    merged = whole.select("*", "link.part", "link.parent_piece").join(known, ["part", "parent_piece"], "left")
    closed = pieces.where("piece IS NULL")
    hanging = closed.where("parent_piece IS NOT NULL").drop("parent_conv").join(known, ["part", "parent_piece"], "left")
    return merged.select(columns).union(hanging.select(columns)).union(closed.where("parent_piece IS NULL").select(columns))


def _distinct(blocks: DataFrame) -> DataFrame:
    return blocks.groupBy("m", "root", "key").agg(
        F.count("*").alias("n"), F.min("conv").alias("conv"), F.sum("x_saved").alias("x_saved"), F.sum("x_leaves").alias("x_leaves")
    ).withColumn("end_id", _end_id())


def trie(turns: DataFrame) -> DataFrame:
    """One row per node from ``conv``, ``place`` (from 1; 0 marks a conversation) and ``item``.

    ``conv_id`` (smallest member), ``depth``, ``parent_conv_id``, ``n_convs``, ``n_children``, ``n_leaves``, ``saved_tokens`` and ``ends_sha256``.
    """
    blocks = _blocks(turns)
    none = [F.lit(0).cast("long").alias(c) for c in ("x_saved", "x_leaves")]
    below = _forest(_distinct(blocks.where("m > 0").select("*", *none))).where("inner = 0")
    below = below.select("conv", "m", F.col("saved").alias("x_saved"), F.col("leaves").alias("x_leaves"))
    several = (F.col("m") > 0) | (F.col("size") >= BLOCK)
    rest = blocks.where(several).join(cut_lineage(below), ["conv", "m"], "left").fillna(0, ["x_saved", "x_leaves"])
    rest = _before(rest, ["x_saved", "x_leaves"], behind=True)
    rows = blocks.where(~several).select("*", *none).unionByName(rest)
    nodes = _forest(_distinct(rows)).where("m = 0 OR inner > 0")
    last = (F.col("size") <= BLOCK) & ((F.col("m") == 0) | (F.col("size") > 0))
    ended = joined_sha256(blocks.where(last).select(_end_id().alias("group"), sortable(F.col("conv")).alias("order"), F.col("conv").cast("string").alias("value")))
    hashed = nodes.where("end_id IS NOT NULL").join(ended.select(F.col("group").alias("end_id"), "sha256"), "end_id")
    columns = [
        F.col("conv").alias("conv_id"), (F.col("m") * BLOCK + F.col("inner")).alias("depth"), F.col("parent_conv").alias("parent_conv_id"), F.col("n").alias("n_convs"),
        (F.col("edges") + 1 - F.col("ended")).alias("n_children"), F.col("leaves").alias("n_leaves"), F.col("saved").alias("saved_tokens"),
    ]
    return hashed.select(*columns, F.col("sha256").alias("ends_sha256")).union(nodes.where("end_id IS NULL").select(*columns, F.sha2(F.lit(""), 256)))
