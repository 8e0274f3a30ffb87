"""Ranked lexical search: exact inner products of sparse vectors, by best-first search of ball trees.

A document is a vector over the terms of the queries: of each term its impact, (1000000000 * tf) div (1000 * tf + 20 * m), with m from
the document's length against the mean one. A query gives each of its terms a weight, from the number of documents that hold it.
The score is the sum of weight times impact, in 64-bit integers.

Each task gathers its documents' vectors into ball trees: a node is a set of documents with the centroid of their vectors and the
radius around it, halved along the line between two far members. In the tree an impact is multiplied by its term's weight, so that
a query is a vector of ones. The centroid's product plus radius times the query's length bounds all scores below a node; so does
the centroid's plus the radius in each of the query's own terms, which is less where vectors are long and queries short. The smaller
of the two counts, with room for the rounding of floating-point numbers. A query opens the node with the largest bound first and ends once that is
less than its k-th best score; documents in leaves are scored in integers. The best of a task go on to the next tree, then to the
other tasks' best.

One pass counts terms and stores the vectors, which gives the statistics of all documents; a second pass searches. Items are taken
in blocks of about QUERY_BYTES of text, by hash; terms and weights of one block are broadcast, and each block is one pass.

Terms are told apart by 64-bit hashes. Null texts and texts without a term are no documents: they count nowhere. Texts of any length are
read whole, in pieces. Each row is a document of its own, also where rows are equal; equal scores are ordered by id, a null id last. Items
that repeat id and text count once; an item without a term, or whose terms no document holds, has no rows. Empty tables give an
empty result. Other columns are left out.
"""

from __future__ import annotations

import heapq
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from . import common

K = 50
QUERY_BYTES = 4 << 20
#: Documents of a tree, entries of their vectors at most (or one document), and documents of a leaf.
DOCS, ENTRIES, LEAF = 4096, 1_000_000, 48
#: Tables that the best of all tasks are gathered in before the last.
SALTS = 32

#: Bytes of terms: digits, ASCII letters, and all bytes of other characters.
INSIDE = np.zeros(256, bool)
INSIDE[48:58] = INSIDE[65:91] = INSIDE[97:123] = INSIDE[128:] = True


def _pieces(data: np.ndarray, most: int = 4 * common.CHUNK_BYTES) -> Iterator[np.ndarray]:
    """The bytes of one text in parts that don't cut a term, unless it is longer than a part by itself."""
    lo = 0
    while lo < len(data):
        hi = lo + most
        if hi < len(data):
            out = np.flatnonzero(~INSIDE[data[lo:hi]])
            while not len(out) and hi < len(data):
                hi += most
                out = np.flatnonzero(~INSIDE[data[lo:hi]])
            hi = lo + int(out[-1]) + 1 if len(out) else len(data)
        yield data[lo:hi]
        lo = hi


def _hashes(data: np.ndarray, offsets: np.ndarray) -> common.Words:
    return common.words(data, offsets, lower=True, inside=INSIDE)


def _items(rows: list) -> tuple[np.ndarray, list[np.ndarray]]:
    """All terms of some items, sorted, and of each item the places of its terms in these."""
    each = [np.unique(np.concatenate([_hashes(p, np.array([0, len(p)])).hashes for p in _pieces(np.frombuffer((r.text or "").encode(), np.uint8))] or [np.zeros(0, np.uint64)])) for r in rows]
    terms = np.unique(np.concatenate(each)) if each else np.zeros(0, np.uint64)
    return terms, [np.searchsorted(terms, x) for x in each]


def vectors(docs: DataFrame, terms, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(id, n, terms, tf): each document's number of terms, and those of the broadcast terms that it holds, with their counts, as 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = terms.value
        width = max(1, len(known))

        def places(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
            at = np.minimum(np.searchsorted(known, hashes), width - 1)
            hit = known[at] == hashes if len(known) else np.zeros(len(hashes), bool)
            return at, hit

        for b in batches:
            for lo, hi, data, offsets in common.text_chunks(b.column(1)):
                if hi == lo + 1 and len(data) > 4 * common.CHUNK_BYTES:
                    n, counts = 0, np.zeros(width, np.int64)
                    for part in _pieces(data):
                        h = _hashes(part, np.array([0, len(part)])).hashes
                        at, hit = places(h)
                        n, counts = n + len(h), counts + np.bincount(at[hit], minlength=width)
                    cells, totals, ns = np.flatnonzero(counts), counts[counts > 0], np.array([n])
                else:
                    w = _hashes(data, offsets)
                    at, hit = places(w.hashes)
                    cells, totals = np.unique(w.doc[hit] * width + at[hit], return_counts=True)
                    ns = np.diff(w.first)
                ends = np.searchsorted(cells // width, np.arange(hi - lo + 1))
                raw = [(cells % width).astype("<i4"), totals.astype("<i4")]
                cut = [pa.array([x[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary()) for x in raw]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array(ns.astype(np.int64)), *cut], ["id", "n", "terms", "tf"])

    return docs.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, n long, terms binary, tf binary")


def _frequencies(found: DataFrame, width: int) -> np.ndarray:
    """The number of documents that hold each term."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(width, np.int64)
        for b in batches:
            counts += np.bincount(np.frombuffer(b"".join(b.column(0).to_pylist()), "<i4"), minlength=width)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(counts[at])], ["term", "n"])

    out = np.zeros(width, np.int64)
    for r in found.select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")).collect():  # a row a term of the items
        out[r.term] = r.n
    return out


class Tree:
    """Documents in an order in which each node is a range; centroid and radius of each node."""

    def __init__(self, first: np.ndarray, terms: np.ndarray, impacts: np.ndarray, weights: np.ndarray, leaf: int = LEAF):
        self.width = len(weights)
        self.order, self.nodes = np.zeros(0, np.int64), []
        y = impacts * weights[terms].astype(float)
        self._split(np.arange(len(first) - 1), first, terms, y, leaf)
        rows = self.order
        self.first = np.concatenate([[0], np.cumsum(np.diff(first)[rows])])
        at = _cells(first, rows)
        self.terms, self.impacts = terms[at], impacts[at]

    def _split(self, rows: np.ndarray, first: np.ndarray, terms: np.ndarray, y: np.ndarray, leaf: int) -> int:
        """Appends the node of some rows, whose vectors are given, and all below it; its number."""
        starts, n = first[:-1], len(rows)
        centroid = np.bincount(terms, weights=y, minlength=self.width) / n
        length = np.add.reduceat(y * y, starts)

        def apart(v: np.ndarray) -> np.ndarray:
            return length - 2 * np.add.reduceat(y * v[terms], starts) + v @ v

        far = apart(centroid)
        # the products are exact to some 1e-10 of the lengths, whose sum times 1e-9 stays above that
        radius = math.sqrt(max(0.0, float((np.maximum(far, 0) + 1e-9 * (length + centroid @ centroid)).max())))
        number, lo = len(self.nodes), len(self.order)
        peak = np.zeros(self.width)  # centroid plus the radius in each term's own direction
        np.maximum.at(peak, terms, y)
        self.nodes.append((centroid, radius, peak, lo, lo + n, -1, -1))
        if n <= leaf:
            self.order = np.concatenate([self.order, rows])
            return number

        def dense(i: int) -> np.ndarray:
            v = np.zeros(self.width)
            v[terms[first[i] : first[i + 1]]] = y[first[i] : first[i + 1]]
            return v

        one = apart(dense(int(far.argmax())))
        other = apart(dense(int(one.argmax())))
        side = np.argsort(one - other, kind="stable")
        below = []
        for part in (side[: n // 2], side[n // 2 :]):
            at = _cells(first, part)
            below.append(self._split(rows[part], np.concatenate([[0], np.cumsum(np.diff(first)[part])]), terms[at], y[at], leaf))
        self.nodes[number] = (centroid, radius, peak, lo, lo + n, *below)
        return number

    def bound(self, node: int, query: np.ndarray) -> float:
        """What no document below a node scores more than."""
        centroid, radius, peak = self.nodes[node][:3]
        return min(float(centroid[query].sum()) + math.sqrt(len(query)) * radius, float(peak[query].sum())) * (1 + 1e-9) + 1

    def search(self, query: np.ndarray, weights: np.ndarray, best: Best, ids: np.ndarray, null: np.ndarray) -> int:
        """Puts what is among the best of a query into best; the number of leaves that were scored. weights: those of the query's terms, 0 for others."""
        heap, scored = [(-self.bound(0, query), 0)], 0
        while heap:
            bound, node = heapq.heappop(heap)
            if -bound < best.least:
                break
            lo, hi, left, right = self.nodes[node][3:]
            if left >= 0:
                for child in (left, right):
                    if (b := self.bound(child, query)) >= best.least:
                        heapq.heappush(heap, (-b, child))
                continue
            scored += 1
            a, z = self.first[lo], self.first[hi]
            scores = np.add.reduceat(weights[self.terms[a:z]] * self.impacts[a:z], self.first[lo:hi] - a)
            if scores.max() >= best.least:
                at = np.flatnonzero(scores >= best.least)
                best.add(scores[at], ids[self.order[lo + at]], null[self.order[lo + at]])
        return scored


def _cells(first: np.ndarray, rows: np.ndarray) -> np.ndarray:
    """Where the cells of some rows lie, row after row."""
    n = first[rows + 1] - first[rows]
    return np.repeat(first[rows] - np.cumsum(n) + n, n) + np.arange(n.sum())


class Best:
    """The k documents that score most: higher scores, then smaller ids, null last."""

    def __init__(self, k: int):
        self.k, self.least = k, 1
        self.scores, self.ids, self.null = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, bool)

    def add(self, scores: np.ndarray, ids: np.ndarray, null: np.ndarray) -> None:
        scores, ids, null = np.concatenate([self.scores, scores]), np.concatenate([self.ids, ids]), np.concatenate([self.null, null])
        top = np.lexsort((ids, null, -scores))[: self.k]
        self.scores, self.ids, self.null = scores[top], ids[top], null[top]
        if len(top) == self.k:
            self.least = int(self.scores[-1])


def _trees(batches: Iterator[pa.RecordBatch], documents: int, length: int, weights: np.ndarray) -> Iterator[tuple[Tree, np.ndarray, np.ndarray]]:
    """Trees over a task's documents, with their ids and which of these are null."""
    held: list[tuple[int | None, int, bytes, bytes]] = []
    entries = 0

    def tree() -> tuple[Tree, np.ndarray, np.ndarray]:
        sizes = np.array([len(t) // 4 for _, _, t, _ in held])
        terms, tf = (np.frombuffer(b"".join(h[i] for h in held), "<i4").astype(np.int64) for i in (2, 3))
        m = np.array([100 - 50 + (50 * h[1] * documents) // length for h in held], np.int64)
        impacts = 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, sizes))
        null = np.array([h[0] is None for h in held])
        return Tree(np.concatenate([[0], np.cumsum(sizes)]), terms, impacts, weights), np.array([h[0] or 0 for h in held], np.int64), null

    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns), strict=True):
            held.append(row)
            entries += len(row[2]) // 4
            if len(held) >= DOCS or entries >= ENTRIES:
                yield tree()
                held, entries = [], 0
    if held:
        yield tree()


def search(docs: DataFrame, items: DataFrame, k: int = K, key: str = "doc_id", text: str = "text", item: str = "item_id", item_text: str = "text") -> DataFrame:
    """item_id, rank, doc_id, score: the k documents that score most for each item."""
    common.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    asked = items.select(F.col(item).cast("long").alias("item"), F.col(item_text).alias("text")).filter("text is not null").distinct()
    blocks = -(-common.text_bytes(asked, "text") // QUERY_BYTES)
    parts = [_search_block(docs, asked.filter(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == i), k, key, text) for i in range(blocks)]
    out = spark.createDataFrame([], "item long, rank int, id long, score long")
    for part in parts:
        out = out.unionByName(part)
    return out.select(F.col("item").alias(item), "rank", F.col("id").alias(key), "score")


def _search_block(docs: DataFrame, asked: DataFrame, k: int, key: str, text: str) -> DataFrame:
    spark = docs.sparkSession
    rows = asked.orderBy("item", "text").collect()  # about QUERY_BYTES of text
    terms, queries = _items(rows)
    found = common.stored(vectors(docs, spark.sparkContext.broadcast(terms), key, text))
    total = found.agg(F.count_if(F.col("n") > 0).alias("documents"), F.coalesce(F.sum("n"), F.lit(0)).alias("length")).first()
    held = found.filter(F.octet_length("terms") > 0)
    df = _frequencies(held, len(terms))
    weights = np.array([math.floor(1000 * math.log((2 * total.documents + 2) / (2 * int(n) + 1))) for n in df], np.int64)
    shared = spark.sparkContext.broadcast((weights, queries))
    documents, length = total.documents, total.length

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        weights, queries = shared.value
        best, mine = [Best(k) for _ in queries], np.zeros(len(weights), np.int64)
        for tree, ids, null in _trees(batches, documents, length, weights):
            for query, b in zip(queries, best, strict=True):
                if len(query):
                    mine[query] = weights[query]
                    tree.search(query, mine, b, ids, null)
                    mine[query] = 0
        for lo in range(0, len(best), 200):
            some = best[lo : lo + 200]
            number = np.repeat(np.arange(lo, lo + len(some)), [len(b.ids) for b in some])
            yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(np.concatenate([b.ids for b in some]), mask=np.concatenate([b.null for b in some])), pa.array(np.concatenate([b.scores for b in some]))], ["number", "id", "score"])

    order = [F.desc("score"), F.asc_nulls_last("id")]
    top = held.mapInArrow(run, "number long, id long, score long").withColumn("salt", F.spark_partition_id() % SALTS)
    for by in (("number", "salt"), ("number",)):
        top = top.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("rank") <= k)
    names = spark.createDataFrame([(i, r.item) for i, r in enumerate(rows)], "number long, item long")
    return top.join(F.broadcast(names), "number").select("item", "rank", "id", "score")  # a row an item of the block is broadcast


def op12_lexical(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))


ORACLE = r"""
with words as (
    select doc_id, row_number() over () as row, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as terms
    from documents where text is not null
), docs as (select doc_id, row, len(terms) as n, terms from words where len(terms) > 0),
total as (select count(*) as documents, cast(sum(n) as bigint) as length from docs),
counted as (select row, doc_id, n, term, count(*) as tf from (select row, doc_id, n, unnest(terms) as term from docs) group by all),
asked as (
    select distinct item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as term
    from benchmark where text is not null
), weighed as (
    select term, cast(floor(1000 * ln((2 * documents + 2) / (2 * count(*) + 1))) as bigint) as w
    from counted, total group by term, documents
), scored as (
    select item_id, row, doc_id, cast(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (100 - 50 + (50 * n * documents) // length)))) as bigint) as score
    from asked join weighed using (term) join counted using (term), total group by item_id, row, doc_id
)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as integer) as rank, doc_id, score
from scored where score > 0 qualify rank <= 50
"""
