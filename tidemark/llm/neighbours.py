"""Approximate nearest neighbours: an NN-descent graph, searched greedily.

Equal vectors are one node, with the few smallest of their ids that a result can need. The graph starts from groups of
nodes that lie together on random projections; each round joins every node with its neighbours and those it is a neighbour
of, compares the neighbours of a node with each other where one of the two is new, and keeps the DEGREE nearest of each
node. Of a node that many others have as neighbour only some are drawn, in the tasks already; nodes without a new neighbour
sit out; a pair only goes on if it is nearer than the farthest edge that one of the two has. Tasks keep the best candidates
of each node before they shuffle them. Rounds end when few edges change.

A query walks the graph: from its entry nodes (its own node's place in the graph where it is indexed, and a few fixed ones) it
looks at the neighbours (either way) of the BEAM nearest nodes found so far that it has not looked at yet, until nothing nearer
turns up.
Every row is indexed; the graph's random choices depend on seeds only. Graph and walk use vectors of 32-bit floats, scaled by
the largest component (of 64-bit floats where vectors are so unlike in size that the small ones would vanish); distances in results are computed in double precision from the original vectors.

Vectors that are null, zero, or hold null or non-finite components take no part, nor do those of another length than most; rows
with a null id don't either. Ties go to the smaller id. Rows that are repeated with their id count once; equal vectors of
different ids are each other's nearest. With fewer candidates than asked for, all are returned; an empty table gives an empty
one. Other columns are left out, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

DEGREE = 24
#: Neighbours of a node, each way, that a round compares with each other.
COMPARED = 16
ROUNDS = 6
#: Random projections that the graph starts from, and nodes that lie together on one.
TREES, LEAF = 4, 48
#: Rounds end when less than this share of the edges is new.
SETTLED = 0.02
BEAM, WALKS, ENTRIES = 128, 16, 8
#: Edges that a walk may take against their direction at a node: the nearest.
BACK = 24
#: Bytes of distinct vectors that a task holds before it passes them on.
HELD_BYTES = 64 << 20

#: A vector so many times as large as the smallest makes the graph use 64-bit floats; what is further out lies at FAR.
SPREAD, FAR = 1e25, 1e120

EDGES = "array<struct<d:double,to:bigint,new:boolean>>"


def sound(vectors: DataFrame, key: str, vector: str) -> DataFrame:
    """(id, v): rows whose vectors take part, as doubles."""
    v = F.col(vector).cast("array<double>")
    fine = F.col(key).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf"))) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(fine).select(F.col(key).cast("long").alias("id"), v.alias("v"))
    length = rows.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").limit(1).select("n").collect()
    return rows.filter(F.size("v") == (length[0][0] if length else 0))


def nodes(rows: DataFrame, k: int) -> DataFrame:
    """(node, v, ids): distinct vectors, each with its smallest ids (k + 1, enough when one of them is the query)."""

    def least(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[bytes, list[int]] = {}
        for b in batches:
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                ids = held.setdefault(raw := np.array(v).tobytes(), [])
                ids.append(i)
                if len(ids) > 4 * k:
                    ids[:] = sorted(set(ids))[: k + 1]
                if len(held) * (len(raw) + 200) > HELD_BYTES:
                    yield from told(held)
                    held = {}
        yield from told(held)

    def told(held: dict[bytes, list[int]]) -> Iterator[pa.RecordBatch]:
        if held:
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.binary()), pa.array([sorted(set(x))[: k + 1] for x in held.values()], pa.list_(pa.int64()))], ["v", "ids"])

    some = (rows.select("id", F.transform("v", lambda x: x + F.lit(0.0)).alias("v"))).mapInArrow(least, "v binary, ids array<long>")
    ids = F.slice(F.array_sort(F.array_distinct(F.flatten(F.collect_list("ids")))), 1, k + 1)
    return some.groupBy("v").agg(ids.alias("ids")).select(F.get("ids", F.lit(0)).alias("node"), "v", "ids")


def _stack(column: pa.Array, kind: type = np.float64) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1).astype(np.float64) if len(column) else np.zeros((0, 1))


def scaled(rows: DataFrame, vector: str, scale: float, out: str, kind: type = np.float32) -> DataFrame:
    """rows with a vector of doubles as one of floats of the given kind, between -1 and 1, or what is FAR beyond."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = np.clip(_stack(b.column(b.schema.names.index(vector))) / scale, -FAR, FAR)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([x.tobytes() for x in v.astype(kind)], pa.binary())], [*b.schema.names, out])

    return rows.mapInArrow(run, common.plus(rows, **{out: "binary"}))


class Best:
    """The nearest candidates of each node that a task has seen."""

    def __init__(self, keep: int, most: int = 400_000):
        self.keep, self.most, self.held, self.n = keep, most, [], 0

    def add(self, a: np.ndarray, b: np.ndarray, d: np.ndarray) -> None:
        self.held.append((a, b, d))
        self.n += len(a)
        if self.n > self.most:
            self.held = [self.best()]
            self.n = len(self.held[0][0])
            self.most = max(self.most, 2 * self.n)

    def best(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        a, b, d = (np.concatenate([h[i] for h in self.held]) if self.held else np.zeros(0, t) for i, t in enumerate((np.int64, np.int64, np.float64)))
        order = np.lexsort((b, d, a))
        a, b, d = a[order], b[order], d[order]
        once = np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])]) if len(a) else np.zeros(0, bool)
        a, b, d = a[once], b[once], d[once]
        first = np.searchsorted(a, a)
        near = np.arange(len(a)) - first < self.keep
        return a[near], b[near], d[near]

    def batches(self) -> Iterator[pa.RecordBatch]:
        a, b, d = self.best()
        for lo in range(0, len(a), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[lo : lo + 100_000]) for x in (a, b, d)], ["node", "to", "d"])


def _compare(best: Best, ids: np.ndarray, v: np.ndarray, fresh: np.ndarray, bound: np.ndarray) -> None:
    """All pairs of some nodes of which one is fresh, both ways, as far as nearer than the first one's bound."""
    length = (v**2).sum(1)
    d = np.sqrt(np.maximum(length[:, None] + length[None] - 2 * v @ v.T, 0))
    a, b = np.nonzero((fresh[:, None] | fresh[None]) & (ids[:, None] != ids[None]) & (d < bound[:, None]))
    best.add(ids[a], ids[b], d[a, b])


def start(points: DataFrame, dims: int, seed: int, kind: type = np.float32) -> DataFrame:
    """(node, to, d): candidates among nodes that lie together on random projections."""
    lines = np.random.default_rng(seed).normal(size=(TREES, 2, dims))

    def project(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            v = _stack(b.column(1), kind)
            for t, line in enumerate(lines):
                at = v @ line.T
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(v), t, np.int32)), *b.columns, pa.array(at[:, 0]), pa.array(at[:, 1])], ["tree", *b.schema.names, "x", "y"])

    def leaves(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(DEGREE)
        for b in batches:  # sorted by tree and x: strips of them, and within a strip neighbours on the other line
            tree, ids, v, y = b.column(0).to_numpy(), b.column(1).to_numpy(), _stack(b.column(2), kind), b.column(4).to_numpy()
            ends = np.unique(np.concatenate([np.arange(0, len(ids), 32 * LEAF), np.flatnonzero(np.diff(tree)) + 1, [len(ids)]]))
            for lo, hi in zip(ends[:-1], ends[1:], strict=True):
                strip = lo + np.argsort(y[lo:hi], kind="stable")
                for at in range(0, len(strip), LEAF // 2):
                    leaf = strip[at : at + LEAF]
                    _compare(best, ids[leaf], v[leaf], np.ones(len(leaf), bool), np.full(len(leaf), np.inf))
        yield from best.batches()

    placed = points.mapInArrow(project, "tree int, node long, v binary, x double, y double")
    return placed.repartitionByRange("tree", "x", "node").sortWithinPartitions("tree", "x", "node").mapInArrow(leaves, "node long, to long, d double")


def keep_nearest(edges: DataFrame, degree: int) -> DataFrame:
    """(node, edges): the nearest of each node; an edge found twice is as old as the older."""
    once = edges.repartition("node").groupBy("node", "to").agg(F.min("d").alias("d"), F.min("new").alias("new"))
    near = once.withColumn("r", F.row_number().over(Window.partitionBy("node").orderBy("d", "to"))).filter(F.col("r") <= degree)
    return near.groupBy("node").agg(F.array_sort(F.collect_list(F.struct("d", "to", "new"))).alias("edges"))


def graph(points: DataFrame, dims: int, degree: int = DEGREE, rounds: int = ROUNDS, seed: int = 11, kind: type = np.float32) -> DataFrame:
    """points: (node, h), h a vector of floats of that kind. (node, edges) with the degree nearest nodes that NN-descent finds."""

    def descend(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best, held = Best(degree), None
        for b in batches:
            table = pa.Table.from_batches([b] if held is None else [held, b]).combine_chunks()
            b = table.to_batches()[0]
            at = b.column(0).to_numpy()
            edge = int(np.searchsorted(at, at[-1]))  # the last node's rows may go on
            _descend(best, b.slice(0, edge))
            held = b.slice(edge)
        if held is not None:
            _descend(best, held)
        yield from best.batches()

    def _descend(best: Best, b: pa.RecordBatch) -> None:
        if b.num_rows:
            at, ids, new, bound, v = b.column(0).to_numpy(), b.column(1).to_numpy(), b.column(2).to_numpy(zero_copy_only=False), b.column(4).to_numpy(), _stack(b.column(3), kind)
            cut = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1], [True]]))
            for lo, hi in zip(cut[:-1], cut[1:], strict=True):
                _compare(best, ids[lo:hi], v[lo:hi], new[lo:hi], bound[lo:hi])

    now = common.cut(keep_nearest(start(points, dims, seed, kind).withColumn("new", F.lit(True)), degree))
    for turn in range(rounds):
        edges = now.select("node", F.explode("edges").alias("e")).select("node", "e.d", "e.to", "e.new")
        both = edges.select("node", "to", "new").unionByName(edges.select(F.col("to").alias("node"), F.col("node").alias("to"), "new"))
        drawn = F.row_number().over(Window.partitionBy("node").orderBy(F.desc("new"), F.xxhash64(F.col("to"), F.lit(seed + turn)), "to"))
        some = both.withColumn("r", drawn).filter(F.col("r") <= 2 * COMPARED).withColumn("any", F.max("new").over(Window.partitionBy("node"))).filter("any")
        bound = F.when(F.size("edges") < degree, F.lit(float("inf"))).otherwise(F.get("edges", F.lit(degree - 1))["d"])
        known = points.join(now.select("node", bound.alias("bound")), "node").select(F.col("node").alias("to"), "h", "bound")
        with_vectors = some.select("node", "to", "new").join(known, "to").select("node", "to", "new", "h", "bound")
        found = with_vectors.repartition("node").sortWithinPartitions("node").mapInArrow(descend, "node long, to long, d double")
        old = edges.select("node", "to", "d").withColumn("new", F.lit(False))
        now = common.cut(keep_nearest(old.unionByName(found.withColumn("new", F.lit(True))), degree))
        share = now.select(F.explode("edges.new").alias("n")).agg(F.avg(F.col("n").cast("double"))).first()[0]
        if (share or 0) < SETTLED:
            break
    return now


def walk(queries: DataFrame, points: DataFrame, links: DataFrame, beam: int = BEAM, walks: int = WALKS, kind: type = np.float32) -> DataFrame:
    """queries: (query, qh, at): vector and entry nodes; points: (node, h). (query, found): the nearest nodes of a greedy search, as (d, to)."""
    edges = links.select("node", F.explode("edges").alias("e")).select("node", "e.to", "e.d")
    nearest = F.row_number().over(Window.partitionBy("to").orderBy("d", "node"))
    back = edges.withColumn("r", nearest).filter(F.col("r") <= BACK).select(F.col("to").alias("node"), F.col("node").alias("to"))
    ways = common.cut(edges.select("node", "to").unionByName(back).groupBy("node").agg(F.collect_set("to").alias("next")))
    vectors = points.select(F.col("node").alias("to"), "h")
    states = "array<struct<d:double,to:bigint,seen:boolean>>"

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.sqrt(((_stack(b.column(2), kind) - _stack(b.column(3), kind)) ** 2).sum(1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], ["query", "to", "d"])

    state = queries.select("query", "qh", F.array().cast(states).alias("found"), F.col("at").alias("open"))
    for _ in range(walks):
        fresh = state.select("query", "qh", F.explode(F.array_except("open", F.transform("found", lambda x: x["to"]))).alias("to")).join(vectors, "to")
        near = fresh.select("query", "to", "qh", "h").mapInArrow(measure, "query long, to long, d double")
        more = near.groupBy("query").agg(F.collect_list(F.struct("d", "to", F.lit(False).alias("seen"))).alias("more"))
        all_ = F.slice(F.array_sort(F.concat("found", F.coalesce("more", F.array().cast(states)))), 1, beam)
        merged = common.cut(state.drop("open").join(more, "query", "left").select("query", "qh", all_.alias("found")))
        steps = merged.select("query", F.explode(F.filter("found", lambda x: ~x["seen"])).alias("s")).select("query", F.col("s.to").alias("node"))
        ahead = steps.join(ways, "node").groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("next"))).alias("open"))
        seen = F.transform("found", lambda x: F.struct(x["d"].alias("d"), x["to"].alias("to"), F.lit(True).alias("seen")))
        state = common.cut(merged.join(ahead, "query", "left").select("query", "qh", seen.alias("found"), F.coalesce("open", F.array().cast("array<bigint>")).alias("open"), F.exists("found", lambda x: ~x["seen"]).alias("moved")))
        if not state.filter("moved").limit(1).count():
            break
        state = state.drop("moved")
    return state.select("query", "qh", "found")


def search(vectors: DataFrame, wanted: F.Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """For each row that wanted holds for: its k nearest other rows. query_id, rank, vec_id, score."""
    common.small_batches(vectors.sparkSession)
    rows = sound(vectors, key, vector)
    size = F.array_max(F.transform("v", F.abs))
    largest, smallest, dims = rows.agg(F.max(size), F.min(size), F.max(F.size("v"))).first()
    if not dims:
        return vectors.sparkSession.createDataFrame([], f"query_id long, rank int, `{key}` long, score double")
    kind = np.float32 if largest / SPREAD <= smallest else np.float64
    scale = min(largest, smallest * 1e100)  # even then the squares of the smallest are above zero
    whole = common.cut(scaled(nodes(rows, k), "v", scale, "h", kind))
    points = whole.select("node", "h")
    links = graph(points, dims, kind=kind)

    asked = vectors.filter(wanted).select(F.col(key).cast("long").alias("query")).join(rows.withColumnRenamed("id", "query"), "query")

    def packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([(np.array(v) + 0.0).tobytes() for v in b.column(1).to_pylist()], pa.binary())], ["query", "qv"])

    def exact(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            d = np.sqrt(((_stack(b.column(2)) - _stack(b.column(3))) ** 2).sum(1)) if b.num_rows else np.zeros(0)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(d)], ["query", "ids", "d"])

    asked = common.cut(scaled(asked.dropDuplicates(["query"]).mapInArrow(packed, "query long, qv binary"), "qv", scale, "qh", kind))
    entries = [r[0] for r in points.select("node").orderBy(F.xxhash64("node"), "node").limit(ENTRIES).collect()]
    own = asked.join(whole.select("node", "v"), F.col("qv") == F.col("v"), "left").select("query", "qh", F.array_compact(F.array(F.col("node"), *map(F.lit, entries))).cast("array<bigint>").alias("at"))
    found = walk(own, points, links, kind=kind).select("query", F.explode("found").alias("f")).select("query", F.col("f.to").alias("node"))
    met = found.join(whole.select("node", "v", "ids"), "node").join(asked.select("query", "qv"), "query").select("query", "ids", "qv", "v")
    each = met.mapInArrow(exact, "query long, ids array<long>, d double").select("query", "d", F.explode("ids").alias("vec_id")).filter("vec_id <> query")
    best = each.groupBy("query").agg(F.slice(F.array_sort(F.collect_list(F.struct("d", "vec_id"))), 1, k).alias("best"))
    return best.select(F.col("query").alias("query_id"), F.posexplode("best").alias("i", "b")).select("query_id", (F.col("i") + 1).alias("rank"), F.col("b.vec_id").alias(key), F.col("b.d").alias("score"))


def op1_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)
