"""Near-duplicate documents by DartMinHash signatures, banded joins and exact verification.

A text's elements are its distinct 5-word shingles (all its words, if fewer), each with weight 1, as in the verification.
Onto each element's weight axis hashed darts fall as a Poisson process in time; a text of total weight W looks at the darts
before t / W that hit below its weights, about t of them, and keeps the earliest of each of K coordinates. Equal coordinates
have the probability of Jaccard similarity, at a cost that is the same for texts of any length.

Texts that are equal are one node. Nodes that agree in a band of ROWS coordinates meet at the most central node of their
bucket (the one whose buckets are largest: in a group of edited copies, the original), at the most central one of those
that agree in the next band as well, and, in small buckets, at each other. Pairs are verified by the exact Jaccard similarity of their
shingle sets (``least`` or more), and what is linked becomes one class. A large bucket that is one class by then is settled.
The nodes of all others go through an exact prefix-filter join: two sets of similarity ``least`` share one of their rarest
shingles, so nodes meet at these, first one central node of each, then all that are still in different classes, as far as
sizes, places and parity bitmaps (each an exact bound) allow ``least``. So no pair that shares a band is left out, in buckets
of any size; a pair of similarity 0.8 shares one with probability 0.9998.

Result: a row per document with class_id (the smallest id in the class), class_size, n_verified (links of its text that were
verified: enough to tell its class, in large classes not all there are) and kept (true for one row of each class, that of the
smallest id). A null text counts as empty; empty texts equal each other and nothing else; rows without an id come after those
with one; repeated rows are each other's copies. Texts of any length are read whole; an empty table gives an empty one. Other
columns are left out by ``classes``, whatever their names, and kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64, mix

SHINGLE = 5
LEAST = 0.8
K, ROWS = 64, 4
BANDS = K // ROWS
#: Darts that a text looks at: so many leave a coordinate empty in about one text of fifty, which then looks further.
DARTS = K * (np.log(K) + 4)
#: In buckets of up to so many nodes all pairs are verified at once; larger ones meet at hubs first.
SMALL = 16
#: 64-bit words of a set's parity bitmap.
BITMAP = 8
#: Nodes of one shingle that a row of the prefix join meets in one task.
SALTED = 512
#: Sets that are packed together, as a power of two, and bytes of sets that a bucket of shingles answers for, on average.
GROUP_BITS, BUCKET_BYTES = 8, 8 << 20


def shingles(w: common.Words) -> tuple[np.ndarray, np.ndarray]:
    """(document, shingle) of all shingles; texts of fewer words have all their words as one."""
    starts, grams = w.grams(SHINGLE)
    doc, sizes = w.doc[starts], np.diff(w.first)
    for n in range(1, SHINGLE):
        if (few := np.flatnonzero(sizes == n)).size:
            grams = np.concatenate([grams, common.window_hashes(w.hashes, w.first[few], n)])
            doc = np.concatenate([doc, few])
    return doc, grams


def distinct(doc: np.ndarray, grams: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    order = np.lexsort((grams, doc))
    doc, grams = doc[order], grams[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (grams[1:] != grams[:-1])
    at = np.flatnonzero(new)
    return doc[at], grams[at], np.diff(np.append(at, len(doc)))


def signatures(doc: np.ndarray, elements: np.ndarray, weights: np.ndarray, n: int, darts: float = DARTS) -> np.ndarray:
    """K coordinates for each of n texts; those of texts without elements are 0."""
    total = np.bincount(doc, weights, n)
    out = np.zeros((n, K), U64)
    wanted, limit = total > 0, darts / np.maximum(total, 1e-12)
    while wanted.any():
        own = np.flatnonzero(wanted[doc])
        filled = _earliest(doc[own], elements[own], weights[own], limit, out)
        wanted &= np.bincount(filled, minlength=n) < K
        limit = np.where(wanted, limit * 2, limit)
    return out


def _earliest(doc: np.ndarray, elements: np.ndarray, weights: np.ndarray, limit: np.ndarray, out: np.ndarray) -> np.ndarray:
    cells = np.ceil(weights).astype(np.int64)  # unit pieces of each weight axis
    which = np.repeat(np.arange(len(doc)), cells)
    cell = np.arange(len(which)) - np.repeat(np.cumsum(cells) - cells, cells)
    key = mix(elements[which] + cell.astype(U64) * U64(0x9E3779B97F4A7C15))
    height, rest, owner = weights[which] - cell, limit[doc[which]], doc[which]
    time, darts = np.zeros(len(key)), []
    while len(key):
        key = mix(key + U64(0xD1B54A32D192ED03))  # the next dart of each cell
        time = time - np.log(((key >> U64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        near = time < rest
        key, time, rest, owner, height = key[near], time[near], rest[near], owner[near], height[near]
        more = mix(key ^ U64(0xA0761D6478BD642F))
        hit = (more >> U64(40)).astype(np.float64) * 2.0**-24 < height
        darts.append((owner[hit] * K + (more[hit] % U64(K)).astype(np.int64), time[hit], more[hit]))
    place, time, name = (np.concatenate([d[i] for d in darts]) for i in range(3))
    order = np.lexsort((time, place))
    place, name = place[order], name[order]
    first = np.ones(len(place), bool)
    first[1:] = place[1:] != place[:-1]
    out.reshape(-1)[place[first]] = name[first]
    return place[first] // K


def bands(signature: np.ndarray) -> np.ndarray:
    powers = np.array([pow(0x9E3779B97F4A7C15, i + 1, 1 << 64) for i in range(ROWS)], U64)
    parts = signature.reshape(len(signature), BANDS, ROWS)
    return mix((parts * powers).sum(axis=2, dtype=U64) + np.arange(BANDS, dtype=U64) * U64(0xBF58476D1CE4E5B9)).view(np.int64)


def _signed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offsets in common.text_chunks(b.column(3)):
            w = common.words(data, offsets)
            doc, grams, _ = distinct(*shingles(w))
            keys = bands(signatures(doc, grams, np.ones(len(doc)), hi - lo))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (hi - lo) * BANDS + 1, BANDS), pa.int32()), pa.array(keys.reshape(-1)), mask=pa.array(np.diff(w.first) == 0))
            yield pa.RecordBatch.from_arrays([*(b.column(i).slice(lo, hi - lo) for i in range(3)), lists], ["uid", "id", "same", "bands"])


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for lo, hi, data, offsets in common.text_chunks(b.column(1)):
            doc, grams, _ = distinct(*shingles(common.words(data, offsets)))
            ends = np.searchsorted(doc, np.arange(hi - lo + 1))
            yield pa.RecordBatch.from_arrays([b.column(0).slice(lo, hi - lo), pa.array([grams[s:e].tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)], pa.binary())], ["uid", "shingles"])


def _alike(least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = []
            for x, y in zip(b.column(2), b.column(3), strict=True):
                p, q = np.frombuffer(x.as_buffer(), U64), np.frombuffer(y.as_buffer(), U64)
                common_ = len(p) + len(q) - len(np.unique(np.concatenate([p, q])))
                good.append(len(p) + len(q) > 0 and common_ >= least * (len(p) + len(q) - common_))
            yield b.select(["a", "b"]).filter(pa.array(good, pa.bool_()))

    return run


def met_in(nodes: DataFrame) -> DataFrame:
    """(bucket, uid, next, n) of the nodes (uid, bands) of all buckets of at least two."""
    flat = nodes.select("uid", F.posexplode("bands").alias("i", "bucket"), F.get("bands", (F.col("i") + 1) % BANDS).alias("next")).select("uid", "bucket", "next")
    large = flat.groupBy("bucket").agg(F.count("*").alias("n")).filter("n > 1")
    return common.cut(flat.join(large, "bucket"))


def pairs(met: DataFrame) -> DataFrame:
    """Distinct pairs (a < b) of nodes to verify first."""
    central = met.groupBy("uid").agg(F.sum("n").alias("weight"))
    ranked = met.join(central, "uid").withColumn("order", F.struct("weight", (-F.col("uid")).alias("minus")))
    finer = ranked.filter(F.col("n") > SMALL).withColumn("bucket", F.xxhash64("bucket", "next"))

    def star(rows: DataFrame) -> DataFrame:
        hub = rows.groupBy("bucket").agg((-F.max("order")["minus"]).alias("hub"))
        return rows.join(hub, "bucket").filter("uid <> hub").select(F.least("uid", "hub").alias("a"), F.greatest("uid", "hub").alias("b"))

    few = met.filter(F.col("n") <= SMALL).groupBy("bucket").agg(F.array_sort(F.collect_list("uid")).alias("all"))
    each = few.select("all", F.posexplode("all").alias("i", "a")).select("a", F.explode(F.slice("all", F.col("i") + 2, SMALL)).alias("b"))
    return star(ranked.filter(F.col("n") > SMALL)).unionByName(star(finer)).unionByName(each).distinct()


def verified(found: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) whose sets are alike."""
    left, right = sets.select(F.col("uid").alias("a"), F.col("shingles").alias("x")), sets.select(F.col("uid").alias("b"), F.col("shingles").alias("y"))
    return common.cut(found.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(_alike(least), "a long, b long"))


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[pa.RecordBatch]]]:
    """The rows of each run of equal values of the column group."""
    held, now = [], None
    for b in batches:
        group = b.column(b.schema.names.index("group")).to_numpy()
        edges = np.concatenate([[0], np.flatnonzero(np.diff(group)) + 1, [len(group)]]) if len(group) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if group[lo] != now and held:
                yield now, held
                held = []
            now = int(group[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, held


def _dealt(grams: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct shingles in order of their buckets, their buckets, how often each is there, and the place of each given one."""
    kind, of, counts = np.unique(grams, return_inverse=True, return_counts=True)
    bucket = (kind % U64(buckets)).astype(np.int64)
    order = np.argsort(bucket, kind="stable")
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    return kind[order], bucket[order], counts[order], place[of]


def _grams(rows: list[pa.RecordBatch], column: int) -> list[np.ndarray]:
    return [np.frombuffer(x.as_buffer(), U64) for b in rows for x in b.column(column)]


def _asked(buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for group, rows in _groups(batches):
            kind, bucket, counts, _ = _dealt(np.concatenate(_grams(rows, 1)), buckets)
            edges = np.searchsorted(bucket, np.arange(buckets + 1))
            parts = np.flatnonzero(np.diff(edges)).tolist()
            packed = [pa.array([x[edges[i] : edges[i + 1]].tobytes() for i in parts], pa.binary()) for x in (kind, counts.astype("<u4"))]
            yield pa.RecordBatch.from_arrays([pa.array(parts, pa.int32()), pa.array([group] * len(parts), pa.int64()), *packed], ["bucket", "group", "grams", "counts"])

    return run


def _counted(table: pa.Table) -> pa.Table:
    """One bucket: answers each group with the number of sets, of all groups, that have its shingles."""
    grams = [np.frombuffer(x.as_buffer(), U64) for x in table["grams"]]
    kind, of = np.unique(np.concatenate(grams), return_inverse=True)
    total = np.bincount(of, np.concatenate([np.frombuffer(x.as_buffer(), "<u4") for x in table["counts"]]), len(kind)).astype("<i8")[of]
    ends = np.cumsum([0, *map(len, grams)])
    return pa.table({"group": table["group"], "bucket": table["bucket"], "counts": pa.array([total[x:y].tobytes() for x, y in zip(ends[:-1], ends[1:], strict=True)], pa.binary())})


def _posted(least: float, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in _groups(batches):  # sorted: answers first
            told = {i: np.frombuffer(c.as_buffer(), "<i8") for b in rows for i, c in zip(b.column(2).to_pylist(), b.column(3), strict=True) if c.is_valid}
            sets = [b.filter(b.column(1).is_valid()) for b in rows]
            uids, grams = np.concatenate([b.column(0).to_numpy() for b in sets]), _grams(sets, 1)
            _, bucket, _, place = _dealt(np.concatenate(grams), buckets)
            often = np.concatenate([told[i] for i in np.unique(bucket).tolist()])[place]
            at, out = 0, []
            for uid, own in zip(uids.tolist(), grams, strict=True):
                n, c = len(own), often[at : at + len(own)]
                at += n
                prefix = np.arange(int((c == 1).sum()), n - int(np.ceil(n * least - 1e-9)) + 1)  # what is nowhere else comes first
                if len(prefix):
                    bits = np.packbits(np.bincount((own % U64(BITMAP * 64)).astype(np.int64), minlength=BITMAP * 64).astype(np.uint8) & 1).view(np.int64)
                    out.append((own[np.lexsort((own, c))[prefix]].view(np.int64), np.full(len(prefix), uid), np.full(len(prefix), n), prefix, np.tile(bits, len(prefix))))
            if out:
                shingle, uid, n, prefix, bits = (np.concatenate(x) for x in zip(*out, strict=True))
                maps = pa.ListArray.from_arrays(pa.array(np.arange(0, len(bits) + 1, BITMAP), pa.int32()), pa.array(bits))
                yield pa.RecordBatch.from_arrays([pa.array(shingle), pa.array(uid), pa.array(n), pa.array(prefix), maps], ["shingle", "uid", "size", "place", "map"])

    return run


def postings(sets: DataFrame, least: float) -> DataFrame:
    """(shingle, uid, size, place, map) of those shingles of each set's prefix that other sets (uid, shingles) have too.

    In the order of their number of sets, a set of n shingles has a prefix of n - ceil(least n) + 1; place counts from 0.
    The numbers come from buckets of shingles, each of which gets a shingle once from a group of sets, however many have it.
    """
    rows = common.cut(sets.select("uid", "shingles")).withColumn("group", F.shiftright(F.monotonically_increasing_id(), GROUP_BITS))
    buckets = max(1, -(-common.text_bytes(rows, "shingles") // BUCKET_BYTES))
    asked = rows.mapInArrow(_asked(buckets), "bucket int, group long, grams binary, counts binary")
    told = asked.groupBy("bucket").applyInArrow(_counted, "group long, bucket int, counts binary")
    both = rows.unionByName(told, allowMissingColumns=True).select("uid", "shingles", "bucket", "counts", "group")
    met = both.repartition("group").sortWithinPartitions("group", F.col("uid").isNotNull(), "uid")
    return common.cut(met.mapInArrow(_posted(least, buckets), "shingle long, uid long, size long, place long, map array<long>"))


def can_be(x: str, y: str, least: float) -> F.Column:
    """Whether postings x and y of one shingle can be of sets of similarity least: by classes, sizes, places and bitmaps."""
    at = lambda side, name: F.col(f"{side}.{name}")
    total = at(x, "size") + at(y, "size")
    after = F.least(at(x, "size") - at(x, "place"), at(y, "size") - at(y, "place"))
    differ = sum((F.bit_count(F.get(at(x, "map"), F.lit(i)).bitwiseXOR(F.get(at(y, "map"), F.lit(i)))) for i in range(BITMAP)), F.lit(0))
    sizes = F.least(at(x, "size"), at(y, "size")) >= F.greatest(at(x, "size"), at(y, "size")) * least - 1e-6
    # the first common shingle in order bounds what is in common; a later one may be refused, as the first is not
    return (at(x, "root") != at(y, "root")) & sizes & (after >= total * (least / (1 + least)) - 1e-6) & (differ <= total * ((1 - least) / (1 + least)) + 1e-6)


def finished(met: DataFrame, nodes: DataFrame, links: DataFrame, sets: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """All links, and (uid, root) of all nodes, once what hubs left of the large buckets is compared exactly."""
    root = common.cut(nodes.select("uid").join(components(links), "uid", "left").select("uid", F.coalesce("root", "uid").alias("root")))
    large = met.filter(F.col("n") > SMALL).select("bucket", "uid").join(root, "uid")
    open_ = large.groupBy("bucket").agg(F.min("root").alias("low"), F.max("root").alias("high")).filter("low < high").select("bucket")
    left = common.cut(large.join(open_, "bucket").select("uid").distinct())
    if not left.limit(1).count():
        return links, root
    posted = postings(sets.join(left, "uid"), least)

    def across(root: DataFrame) -> DataFrame:
        """Postings of the shingles that several classes have, with the number of them."""
        rows = common.cut(posted.join(root, "uid"))
        several = rows.groupBy("shingle").agg(F.count("*").alias("n"), F.min("root").alias("low"), F.max("root").alias("high"), F.min_by(F.struct("uid", "root", "size", "place", "map"), F.xxhash64("uid", "shingle")).alias("hub"))
        return rows.join(several.filter("low < high").drop("low", "high"), "shingle")

    def merged(root: DataFrame, new: DataFrame) -> DataFrame:
        ends = new.join(root.select(F.col("uid").alias("a"), F.col("root").alias("p")), "a").join(root.select(F.col("uid").alias("b"), F.col("root").alias("q")), "b")
        top = components(ends.filter("p <> q").select(F.col("p").alias("a"), F.col("q").alias("b")).distinct())
        return common.cut(root.join(top.select(F.col("uid").alias("root"), F.col("root").alias("top")), "root", "left").select("uid", F.coalesce("top", "root").alias("root")))

    pair = lambda x, y: (F.least(x, y).alias("a"), F.greatest(x, y).alias("b"))
    star = across(root).filter(F.col("n") > SMALL).alias("x").filter(can_be("x", "hub", least)).select(*pair("x.uid", "hub.uid")).distinct()
    by_hub = verified(star, sets, least)
    if by_hub.limit(1).count():
        root, links = merged(root, by_hub), links.unionByName(by_hub)
    rows = common.cut(across(root).drop("hub").withColumn("parts", F.ceil(F.col("n") / SALTED).cast("int")))
    x = rows.withColumn("salt", F.pmod(F.xxhash64("uid"), "parts").cast("int")).alias("x")
    y = rows.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).alias("y")
    same = (F.col("x.shingle") == F.col("y.shingle")) & (F.col("x.salt") == F.col("y.salt")) & (F.col("x.uid") < F.col("y.uid"))
    rest = verified(x.join(y, same & can_be("x", "y", least)).select(F.col("x.uid").alias("a"), F.col("y.uid").alias("b")).distinct(), sets, least)
    if rest.limit(1).count():
        root, links = merged(root, rest), links.unionByName(rest)
    return links.distinct(), root


def components(edges: DataFrame) -> DataFrame:
    """(uid, root) for each node of undirected edges (a, b): the smallest node it is linked with."""
    both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
    both = common.cut(both)
    root = common.cut(both.groupBy("a").agg(F.least("a", F.min("b")).alias("root")).select(F.col("a").alias("uid"), "root"))
    while True:
        seen = both.join(root, both["b"] == root["uid"]).groupBy("a").agg(F.min("root").alias("near"))
        jump = root.select(F.col("uid").alias("at"), F.col("root").alias("further"))
        step = root.join(seen, root["uid"] == seen["a"]).join(jump, root["root"] == jump["at"])
        new = common.cut(step.select("uid", F.least("near", "further", "root").alias("new"), "root"))
        changed = new.filter("new <> root").limit(1).count()
        root = new.select("uid", F.col("new").alias("root"))
        if not changed:
            return root


def classes(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, repeatable: bool = False) -> DataFrame:
    """A row per document: key, class_id, class_size, n_verified, kept. repeatable: as in common.numbered."""
    return _classes(common.numbered(docs.select(F.col(key), F.col(text)), "uid", repeatable), key, text, least).drop("uid")


def _classes(numbered: DataFrame, key: str, text: str, least: float) -> DataFrame:
    rows = numbered.select("uid", F.col(key).alias("id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    signed = rows.select("uid", "id", F.sha2("text", 256).alias("same"), "text").mapInArrow(_signed, f"uid long, id {kind}, same string, bands array<long>")
    signed = common.cut(signed)
    order = F.struct(F.col("id").isNull().alias("none"), F.col("id").alias("id"), F.col("uid").alias("uid"))
    nodes = common.cut(signed.groupBy("same").agg(F.min(order).alias("first"), F.count("*").alias("n"), F.first("bands").alias("bands")).select("same", "first", "first.uid", "n", "bands"))

    met = met_in(nodes)
    found = common.cut(pairs(met))
    wanted = found.select(F.col("a").alias("uid")).union(found.select(F.col("b").alias("uid"))).distinct()
    sets = common.cut(rows.select("uid", "text").join(wanted, "uid").mapInArrow(_sets, "uid long, shingles binary"))
    links, root = finished(met, nodes, verified(found, sets, least), sets, least)

    degree = links.select(F.explode(F.array("a", "b")).alias("uid")).groupBy("uid").agg(F.count("*").alias("n_verified"))
    known = nodes.join(root, "uid").join(degree, "uid", "left").select("same", "first", "n", "root", F.coalesce("n_verified", F.lit(0)).alias("n_verified"))
    whole = known.groupBy("root").agg(F.min("first").alias("head"), F.sum("n").alias("class_size"))
    texts = known.join(whole, "root").select("same", "head", "class_size", "n_verified")
    return signed.select("uid", "id", "same").join(texts, "same").select("uid", F.col("id").alias(key), F.col("head.id").alias("class_id"), "class_size", "n_verified", (F.col("uid") == F.col("head.uid")).alias("kept"))


def keep_one(docs: DataFrame, key: str = "doc_id", text: str = "text", least: float = LEAST, repeatable: bool = False) -> DataFrame:
    """The rows of docs that stay: one of each class."""
    rows = common.numbered(docs, "_tm_uid", repeatable)
    stay = _classes(rows.select(F.col("_tm_uid").alias("uid"), key, text), key, text, least).filter("kept").select(F.col("uid").alias("_tm_uid"))
    return rows.join(stay, "_tm_uid", "left_semi").drop("_tm_uid")


def op5_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(common.read(spark, sf_dir, "documents").select("doc_id", "text"), repeatable=True)
