"""A trie of conversations: the nodes are their distinct prefixes, found in sorted order with a sparse table.

Conversations become sequences of turn digests and are sorted as strings are, so the members of a prefix stand together. A block of
them knows how many turns each one shares with the one before it; a sparse table of these numbers gives the least of any range
at once. Each candidate prefix, a conversation and a depth, finds how far its members reach to the left and to the right by two
binary searches of its own in that table, without a stack; of equal ones the leftmost counts. In that order the nodes below a node
are a range, so what is summed over subtrees is a difference of prefix sums.

A node that touches an edge of its block may go on in the next one. Blocks hand on their first and last conversation with what is
counted so far at each such depth, and these, far fewer, are sorted into blocks in turn, until one block is left. What lies inside a
block is final at once; only the parent's conv_id may be known later, and is joined then. Blocks are cut out of a sorted
stream, at CELLS turns (but at least LEAST conversations), so neither a first turn nor a conversation that many share makes a task
larger; ids of equal conversations are hashed in pieces, one after the other, in as much memory as one piece takes.

A conversation is one row of about 20 bytes a turn, whatever the length of its texts; turns are told apart by 128-bit digests. Turns
are ordered by number (null first), those of equal number by digest. Null roles and texts are empty ones; rows without a conv_id belong to no
conversation; a repeated row is a turn of its own. An empty table gives an empty result. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from hashlib import md5, sha256

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Conversations of c's hundred give the first h turns, h below HEADS.
HUNDRED, HEADS = 100, 6
#: Turns and roots of a block, and the fewest conversations of one.
CELLS, LEAST = 200_000, 16
#: Bytes of sorted sequences that a task reads.
TASK_BYTES = 16 << 20
#: Ids of one conversation's copies that are passed on together.
IDS = 4096
#: Nodes that are broadcast at most when parents are looked up.
BROADCAST = 100_000

DIGEST = 16
#: What a block knows of one depth of a conversation: characters of the turn, members, the smallest of them, and of what is final below: children, leaves, tokens.
CHARS, MEMBERS, LEAST_ID, KIDS, LEAVES, SAVED = range(6)
NOBODY = np.iinfo(np.int64).max

OUT = "kind int, node binary, parent binary, conv_id long, depth long, parent_conv_id long, n_convs long, n_children long, n_leaves long, saved_tokens long, ends_sha256 string, first long, key binary, cells binary, ids binary"
NODE, EDGE, ENDS = range(3)


def rebuilt(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, key, chars): each conversation's digests in a row, and the code points of its texts, after the head of another one took the place of its own."""
    role_, text_ = F.coalesce(F.col(role), F.lit("")), F.coalesce(F.col(text), F.lit(""))
    each = conversations.filter(F.col(conv).isNotNull()).select(
        F.col(conv).cast("long").alias("c"), F.col(turn).alias("turn"), F.md5(F.concat(F.octet_length(role_).cast("string"), F.lit(":"), role_, text_)).alias("digest"), F.length(text_).alias("chars")
    )
    own = each.withColumn("b", F.col("c") - F.col("c") % HUNDRED).repartition("b").groupBy("b", "c").agg(F.sort_array(F.collect_list(F.struct("turn", "digest", "chars"))).alias("turns"))
    # at most 199 conversations have the same b, of a few turns each that are looked at
    heads = own.withColumn("head", F.expr("max(case when c = b then slice(turns, 1, 5) end) over (partition by b)"))
    h = (F.crc32(F.col("c").cast("string")) % HEADS).cast("int")
    head = F.when(h > 0, F.slice(F.coalesce("head", F.slice("turns", 1, 0)), 1, F.greatest(h, F.lit(1)))).otherwise(F.slice("turns", 1, 0))
    # slice takes no length of 0 from a column, and starts at 1
    rest = F.slice("turns", h + 1, F.greatest(F.size("turns"), F.lit(1)))
    turns = heads.select("c", F.concat(head, rest).alias("turns"))
    return turns.select(F.col("c").alias("conv_id"), F.unhex(F.array_join(F.transform("turns", lambda t: t["digest"]), "")).alias("key"), F.transform("turns", lambda t: t["chars"]).alias("chars"))


class Block:
    """Sorted sequences with the cells of their depths 0 .. length."""

    def __init__(self, keys: list[bytes], cells: list[np.ndarray]):
        self.keys, self.n = keys, len(keys)
        self.cells = np.concatenate(cells)
        self.sizes = np.array([len(c) for c in cells])
        self.first = np.concatenate([[0], np.cumsum(self.sizes)])
        shared = np.array([_shared(a, b) for a, b in zip(keys[:-1], keys[1:], strict=True)], np.int64)
        self.shared = np.concatenate([[-1], shared, [-1]])  # shared[i]: depths that i - 1 and i have in common
        self.table = [self.shared]
        while 1 << len(self.table) <= len(self.shared):
            half = 1 << (len(self.table) - 1)
            self.table.append(np.minimum(self.table[-1][:-half], self.table[-1][half:]))

    def least(self, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
        """The least of shared[lo .. hi], element by element."""
        k = np.frexp((hi - lo + 1).astype(float))[1] - 1
        out = np.empty(len(lo), np.int64)
        for level in np.unique(k):
            at = k == level
            t = self.table[level]
            out[at] = np.minimum(t[lo[at]], t[hi[at] - (1 << level) + 1])
        return out

    def extents(self, at: np.ndarray, depth: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The first and last sequence that begins like sequence at up to depth."""
        lo, hi = np.zeros(len(at), np.int64), at.copy()  # the smallest l with shared[l + 1 .. at] >= depth
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_]) // 2
            fine = self.least(mid + 1, at[open_]) >= depth[open_]
            hi[open_] = np.where(fine, mid, hi[open_])
            lo[open_] = np.where(fine, lo[open_], mid + 1)
        left = lo
        lo, hi = at.copy(), np.full(len(at), self.n - 1)
        while (open_ := np.flatnonzero(lo < hi)).size:
            mid = (lo[open_] + hi[open_] + 1) // 2
            fine = self.least(at[open_] + 1, mid) >= depth[open_]
            lo[open_] = np.where(fine, mid, lo[open_])
            hi[open_] = np.where(fine, hi[open_], mid - 1)
        return left, lo


def _shared(a: bytes, b: bytes) -> int:
    """Turns that two sequences begin with in common."""
    n = min(len(a), len(b))
    if a[:n] == b[:n]:
        return n // DIGEST
    x, y = np.frombuffer(a, np.uint8, n), np.frombuffer(b, np.uint8, n)
    return int(np.argmax(x != y)) // DIGEST


def fold(block: Block, ids: np.ndarray | None, last: bool) -> Iterator[dict]:
    """Rows of OUT: the nodes that end within a block, the sequences that go on, and ids of conversations that may go on.

    ids: the conversations' own, where they are sequences that end here. last: whether nothing lies outside of the block.
    """
    row = np.repeat(np.arange(block.n), block.sizes)
    depth = np.arange(len(row)) - np.repeat(block.first[:-1], block.sizes)
    left, right = block.extents(row, depth)
    own = left == row  # each node by its leftmost candidate, in preorder
    number = np.cumsum(own) - 1
    owner = number[block.first[left] + depth]
    at = np.flatnonzero(own)
    n, where, deep, to = len(at), row[at], depth[at], right[at]
    up = np.where(deep > 0, owner[np.maximum(at - 1, 0)], -1)
    opened = np.zeros(n, bool) if last else (where == 0) | (to == block.n - 1)

    members, kids, leaves, saved = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    smallest = np.full(n, NOBODY)
    for total, column in ((members, MEMBERS), (kids, KIDS), (leaves, LEAVES), (saved, SAVED)):
        np.add.at(total, owner, block.cells[:, column])
    np.minimum.at(smallest, owner, block.cells[:, LEAST_ID])
    closed = ~opened
    np.add.at(kids, up[closed & (up >= 0)], 1)

    # what is final goes to the nearest node above that is not
    own_leaf, own_saved = np.where(closed, kids == 0, 0), np.where(closed, (members - 1) * block.cells[at, CHARS], 0)
    gained_leaves, gained_saved = leaves + own_leaf, saved + own_saved
    last_below = np.searchsorted(where, to, "right") - 1  # nodes are sorted by their leftmost sequence
    leaves_sum, saved_sum = np.concatenate([[0], np.cumsum(gained_leaves)]), np.concatenate([[0], np.cumsum(gained_saved)])
    below_leaves, below_saved = leaves_sum[last_below + 1] - leaves_sum[np.arange(n)], saved_sum[last_below + 1] - saved_sum[np.arange(n)]
    if not last:
        open_count = np.bincount(row, weights=opened[owner], minlength=block.n).astype(np.int64)
        nearest = owner[block.first[where] + np.maximum(open_count[where] - 1, 0)]
        np.add.at(leaves, nearest[closed], gained_leaves[closed])
        np.add.at(saved, nearest[closed], gained_saved[closed])

    ends = _ends(block, ids, owner) if ids is not None else {}
    names: dict[int, bytes] = {}

    def name(node: int) -> bytes:
        if node not in names:
            names[node] = md5(block.keys[where[node]][: DIGEST * int(deep[node])]).digest()
        return names[node]

    for x in np.flatnonzero(closed).tolist():
        p = int(up[x])
        known = p < 0 or closed[p]
        yield {
            "kind": NODE, "node": name(x) if ids is None else None, "parent": None if known else name(p), "conv_id": int(smallest[x]), "depth": int(deep[x]), "parent_conv_id": int(smallest[p]) if p >= 0 and known else None,
            "n_convs": int(members[x]), "n_children": int(kids[x]), "n_leaves": int(below_leaves[x]), "saved_tokens": int(below_saved[x]), "ends_sha256": None if ids is None else sha256(b",".join(_pieces(ends.get(x)))).hexdigest(),
        }
    if last:
        return
    for x, found in ends.items():
        if opened[x]:
            for lo in range(0, len(found), IDS):
                yield {"kind": ENDS, "node": name(x), "first": int(found[lo]), "ids": b",".join(_pieces(found[lo : lo + IDS]))}
    told = np.zeros(n, bool)
    for i in dict.fromkeys((0, block.n - 1)):
        mine = owner[block.first[i] : block.first[i + 1]]
        mine = mine[opened[mine]]
        cells = np.zeros((int(block.sizes[i]), 6), np.int64)
        cells[:, LEAST_ID] = NOBODY
        cells[:, CHARS] = block.cells[block.first[i] : block.first[i + 1], CHARS]
        new = np.flatnonzero(~told[mine])
        for column, total in ((MEMBERS, members), (LEAST_ID, smallest), (KIDS, kids), (LEAVES, leaves), (SAVED, saved)):
            cells[new, column] = total[mine[new]]
        told[mine] = True
        yield {"kind": EDGE, "key": block.keys[i], "cells": cells.astype("<i8").tobytes()}


def _pieces(ids: np.ndarray | None) -> list[bytes]:
    return [] if ids is None else [b"%d" % i for i in ids.tolist()]


def _ends(block: Block, ids: np.ndarray, owner: np.ndarray) -> dict[int, np.ndarray]:
    """The ids of the conversations that end at each node, ascending."""
    node = owner[block.first[1:] - 1]
    order = np.lexsort((ids, node))
    cut = np.flatnonzero(np.concatenate([[True], np.diff(node[order]) > 0, [True]]))
    return {int(node[order[a]]): ids[order[a:b]] for a, b in zip(cut[:-1], cut[1:], strict=True)}


def _folded(rows: DataFrame, last: bool = False) -> DataFrame:
    """rows: (key, id, raw), sorted within partitions; raw is chars where there is an id, and cells where there is none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("kind", pa.int32()), *[(c, pa.binary()) for c in ("node", "parent")], *[(c, pa.int64()) for c in ("conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens")], ("ends_sha256", pa.string()), ("first", pa.int64()), *[(c, pa.binary()) for c in ("key", "cells", "ids")]])
        keys, cells, ids, total = [], [], [], 0

        def told() -> Iterator[pa.RecordBatch]:
            some = []
            for r in fold(Block(keys, cells), np.array(ids) if ids[0] is not None else None, last):
                some.append(r)
                if len(some) >= 2000:
                    yield pa.RecordBatch.from_pylist(some, schema)
                    some = []
            if some:
                yield pa.RecordBatch.from_pylist(some, schema)

        for b in batches:
            for key, i, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if i is None:
                    cell = np.frombuffer(raw, "<i8").reshape(-1, 6)
                else:
                    cell = np.zeros((len(key) // DIGEST + 1, 6), np.int64)
                    cell[1:, CHARS] = np.frombuffer(raw, "<i4")
                    cell[:, MEMBERS], cell[:, LEAST_ID] = 1, i
                keys.append(key)
                cells.append(cell)
                ids.append(i)
                total += len(cell)
                if total >= CELLS and len(keys) >= LEAST and not last:
                    yield from told()
                    keys, cells, ids, total = [], [], [], 0
        if keys:
            yield from told()

    return rows.mapInArrow(run, OUT)


def _sorted(rows: DataFrame, *by: str) -> DataFrame:
    """rows in sorted partitions: by size, but with so many rows in each that its edges are few beside them."""
    n, size = rows.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("key") + F.octet_length("raw")), F.lit(0))).first()
    parts = min(-(-n // (4 * LEAST)), max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-size // TASK_BYTES)))
    return rows.repartitionByRange(max(1, parts), *by).sortWithinPartitions(*by)


def _packed(column: str) -> Column:
    """An array of integers as bytes, little end first."""
    return F.unhex(F.array_join(F.transform(column, lambda x: F.concat(*[F.lpad(F.hex(F.shiftright(x, 8 * k).bitwiseAND(F.lit(255))), 2, "0") for k in range(4)])), ""))


def trie(conversations: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """A row for each node: conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens, ends_sha256."""
    spark = conversations.sparkSession
    common.small_batches(spark)
    sequences = common.stored(rebuilt(conversations, conv, turn, role, text).select("key", F.col("conv_id").alias("id"), _packed("chars").alias("raw")))
    levels = [common.stored(_folded(_sorted(sequences, "key", "id")))]
    while True:
        edges = levels[-1].filter(F.col("kind") == EDGE).select("key", F.lit(None).cast("long").alias("id"), F.col("cells").alias("raw"))
        n, size = edges.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("raw")), F.lit(0))).first()
        last = n <= 2 * LEAST or size <= CELLS * 48
        if n:
            levels.append(common.stored(_folded(edges.repartition(1).sortWithinPartitions("key") if last else _sorted(edges, "key"), last)))
        if last:
            break
    inner, tops = levels[0].filter(F.col("kind") == NODE), None
    for level in levels[1:]:
        some = level.filter(F.col("kind") == NODE)
        tops = some if tops is None else tops.unionByName(some)
    columns = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]
    if tops is None:
        return inner.select(*columns)
    ends = _hashed(levels[0].filter(F.col("kind") == ENDS).select("node", "first", "ids"))
    tops = common.stored(tops.drop("ends_sha256").join(ends, "node", "left").withColumn("ends_sha256", F.coalesce("ends_sha256", F.sha2(F.lit(""), 256))).select("node", "parent", *columns))
    above = tops.select(F.col("node").alias("parent"), F.col("conv_id").alias("above"))
    if tops.count() <= BROADCAST:
        above = F.broadcast(above)  # at most BROADCAST rows of 24 bytes
    every = inner.select("parent", *columns).unionByName(tops.drop("node"))
    return every.join(above, "parent", "left").withColumn("parent_conv_id", F.coalesce("parent_conv_id", "above")).select(*columns)


def _hashed(chunks: DataFrame) -> DataFrame:
    """(node, ends_sha256): pieces of ids of each node, hashed one after the other."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, digest = None, None
        for b in batches:
            nodes, hashes = [], []
            for node, ids in zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True):
                if node != now:
                    if now is not None:
                        nodes.append(now)
                        hashes.append(digest.hexdigest())
                    now, digest = node, sha256(ids)
                else:
                    digest.update(b"," + ids)
            if nodes:
                yield pa.RecordBatch.from_arrays([pa.array(nodes, pa.binary()), pa.array(hashes)], ["node", "ends_sha256"])
        if now is not None:
            yield pa.RecordBatch.from_arrays([pa.array([now], pa.binary()), pa.array([digest.hexdigest()])], ["node", "ends_sha256"])

    return chunks.repartition("node").sortWithinPartitions("node", "first").mapInArrow(run, "node binary, ends_sha256 string")


def op11_prefix_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return trie(common.read(spark, sf_dir, "conversations"))


ORACLE = r"""
with turns as (
    select conv_id as c, turn, md5(cast(strlen(coalesce(role, '')) as varchar) || ':' || coalesce(role, '') || coalesce(text, '')) as digest, length(coalesce(text, '')) as chars
    from conversations where conv_id is not null
), own as (
    select c, c - c % 100 as b, list({'digest': digest, 'chars': chars} order by turn nulls first, digest) as turns,
        xor(cast(4294967295 as bigint), list_reduce(list_prepend(cast(4294967295 as bigint), list_transform(string_split(cast(c as varchar), ''), lambda x: cast(ascii(x) as bigint))),
            lambda a, x: list_reduce(list_prepend(xor(a, x), range(8)), lambda y, i: xor(y >> 1, 3988292384 * (y & 1))))) % 6 as h
    from turns group by c
), built as (
    select own.c, list_concat(coalesce(heads.turns[1:own.h], []), own.turns[own.h + 1:]) as turns from own left join own heads on heads.c = own.b
), prefixes as (
    select c, len(turns) as n, d, list_transform(turns[1:d], lambda x: x.digest) as p, coalesce(turns[d].chars, 0) as chars
    from (select *, unnest(range(0, len(turns) + 1)) as d from built)
), nodes as (
    select p, d, min(c) as conv_id, count(*) as n_convs, any_value(chars) as chars, sha256(coalesce(string_agg(cast(c as varchar), ',' order by c) filter (where n = d), '')) as ends_sha256
    from prefixes group by p, d
), kids as (select p[1:d - 1] as p, count(*) as n_children from nodes where d > 0 group by 1),
told as (select nodes.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * (case when d = 0 then 0 else chars end) as own from nodes left join kids using (p)),
below as (select p[1:a] as p, count(*) filter (where n_children = 0) as n_leaves, cast(sum(own) as bigint) as saved_tokens from (select *, unnest(range(0, d + 1)) as a from told) group by 1)
select t.conv_id, t.d as depth, up.conv_id as parent_conv_id, t.n_convs, t.n_children, n_leaves, saved_tokens, t.ends_sha256
from told t join below on below.p = t.p left join told up on t.d > 0 and up.p = t.p[1:t.d - 1]
"""
