"""Removal of repeated word runs by fixed-block anchors.

A window is WINDOW consecutive words of one document. Each document is cut into blocks of BLOCK = (WINDOW + 1) // 2 words that
don't overlap: every window holds a whole one. The blocks are the index; every rolling run of BLOCK words of every document
probes it, by hash. A block that is hit from anywhere else is an anchor, and hits are extended: of each window around an
anchor a wide hash of all its words is compared with those of all other such windows, so what is found are exactly the
windows that occur twice or more, and overlapping ones make up the maximal exact repeats. Every word of them goes.

Index and probes meet by hash bucket as packed arrays (six to ten bytes a word), never as pairs: each bucket only tells which
of its entries are not alone. Equal entries that a task sees together know so at once: they need no answer, and one of them
goes to the bucket for all. So a passage that a third of all documents share reaches its bucket once from each task's buffer,
and buckets are as many as the input's size asks for. Documents without an anchor don't take part in the later steps; a
Bloom filter of at most ``FILTER_BYTES`` of the others spares them the shuffle (with more documents than it can tell apart it
lets more through, and nothing is lost).

A null text counts as empty, as does one of white space. Repeated rows are each other's copies. Texts of any length are read
whole; an empty table gives an empty one. Columns of the input stay; the text becomes the kept words, joined by one space;
result columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import compress

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64, mix

WINDOW = 35
FILTER_BYTES = 32 << 20
#: Words that a task packs at a time.
FLUSH = 1_000_000
#: Bytes of text that a bucket holds entries of, on average.
BUCKET_BYTES = 8 << 20
OTHER_BASE = U64(0xA24BAED4963EE407)
PACKED = "bucket int, uids binary, counts binary, words binary, keys binary"


def small(values: np.ndarray) -> bytes:
    """Whole numbers in two, four or eight bytes each, with a byte that tells which."""
    least, most = (int(values.min()), int(values.max())) if len(values) else (0, 0)
    kind = "<i8" if least < 0 or most >> 32 else "<u4" if most >> 16 else "<u2"
    return kind[-1].encode() + values.astype(kind).tobytes()


def large(raw: pa.Scalar) -> np.ndarray:
    data = raw.as_buffer()
    return np.frombuffer(data, {b"2": "<u2", b"4": "<u4", b"8": "<i8"}[data[0:1].to_pybytes()], -1, 1).astype(np.int64)


class Packer:
    """Collects (document, word, bucket, key) entries and packs them by bucket, equal ones as one."""

    def __init__(self, buckets: int, kind: str, block: int):
        self.buckets, self.kind, self.block = buckets, kind, block
        self.clear()

    def clear(self) -> None:
        self.uid, self.at, self.key, self.bucket, self.words = [], [], [], [], 0

    def add(self, uids: np.ndarray, first: np.ndarray, at: np.ndarray, bucket: np.ndarray, key: np.ndarray) -> None:
        """at: places among the words of these documents, ascending; first: the first word of each document."""
        doc = np.searchsorted(first, at, "right") - 1
        self.uid.append(uids[doc])
        self.at.append(at - first[doc])
        self.bucket.append((bucket % U64(self.buckets)).astype(np.int64))
        self.key.append(key.astype(self.kind))
        self.words += int(first[-1])

    def flush(self) -> Iterator[pa.RecordBatch]:
        if self.words:
            uid, at, key, bucket = (np.concatenate(x) for x in (self.uid, self.at, self.key, self.bucket))
            self.clear()
            indexed = at % self.block == 0
            whole = key if self.kind == "<u8" else bucket.astype(U64) << U64(33) | key.astype(U64) << U64(1) | (~indexed).astype(U64)
            order = np.argsort(whole)  # of equal entries, those of the index first
            same = key[order]
            first = np.flatnonzero(np.concatenate([[True], (same[1:] != same[:-1]) | (bucket[order][1:] != bucket[order][:-1])])) if len(same) else np.zeros(0, np.int64)
            n = np.diff(np.append(first, len(order)))
            told, sent = np.zeros(len(order), bool), np.zeros(len(order), bool)
            told[order] = np.repeat((n > 1) & indexed[order[first]], n)
            sent[order[first]] = True
            if len(known := np.flatnonzero(told & indexed)):
                yield self._rows(np.array([int(mix(uid[known[:1]].view(U64))[0] % U64(self.buckets))]), [known], uid, at, None)
            left = np.flatnonzero(sent)
            left = left[np.argsort(bucket[left].astype(np.uint16) if self.buckets <= 1 << 16 else bucket[left], kind="stable")]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket[left])) + 1, [len(left)]]) if len(left) else np.zeros(1, np.int64)
            for lo in range(0, len(edges) - 1, 16):
                some = [left[a:z] for a, z in zip(edges[lo : lo + 16], edges[lo + 1 : lo + 17], strict=False)]
                yield self._rows(np.array([bucket[x[0]] for x in some]), some, uid, at, key)

    def _rows(self, buckets: np.ndarray, parts: list[np.ndarray], uid: np.ndarray, at: np.ndarray, key: np.ndarray | None) -> pa.RecordBatch:
        uids, counts = [], []
        for x in parts:
            new = np.flatnonzero(np.diff(uid[x], prepend=-1))
            uids.append(uid[x[:1]].astype("<i8").tobytes() + small(np.diff(uid[x[new]])))
            counts.append(small(np.diff(np.append(new, len(x)))))
        keys = [None if key is None else key[x].tobytes() for x in parts]
        return pa.RecordBatch.from_arrays([pa.array(buckets, pa.int32()), *(pa.array(c, pa.binary()) for c in (uids, counts, [small(at[x]) for x in parts], keys))], ["bucket", "uids", "counts", "words", "keys"])


def _places(uids: pa.Scalar, counts: pa.Scalar, words: pa.Scalar) -> tuple[np.ndarray, np.ndarray]:
    raw = uids.as_buffer()
    first = np.frombuffer(raw, "<i8", 1)
    steps = large(pa.scalar(raw[8:].to_pybytes(), pa.binary()))
    return np.repeat(np.cumsum(np.concatenate([first, steps])), large(counts)), large(words)


def unpacked(table: pa.Table, kind: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(uid, word in the document, key) of all entries, and (uid, word) of those that are known to be repeated."""
    found: list[list[np.ndarray]] = [[np.zeros(0, np.int64)], [np.zeros(0, np.int64)], [np.zeros(0, kind)], [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]]
    for uids, counts, words, keys in zip(*(table[c] for c in ("uids", "counts", "words", "keys")), strict=True):
        uid, at = _places(uids, counts, words)
        if keys.is_valid:
            found[0].append(uid)
            found[1].append(at)
            found[2].append(np.frombuffer(keys.as_buffer(), kind))
        else:
            found[3].append(uid)
            found[4].append(at)
    return tuple(np.concatenate(f) for f in found)


def repeated(key: np.ndarray, indexed: np.ndarray) -> np.ndarray:
    """Which entries share their key with another one, one of the two being indexed."""
    if not len(key):
        return np.zeros(0, bool)
    order = np.argsort(key, kind="stable")
    first = np.flatnonzero(np.concatenate([[True], key[order][1:] != key[order][:-1]]))
    n = np.diff(np.append(first, len(key)))
    good = (n > 1) & (np.add.reduceat(indexed[order].astype(np.int64), first) > 0)
    out = np.zeros(len(key), bool)
    out[order] = np.repeat(good, n)
    return out


def replies(uid: np.ndarray, at: np.ndarray, parts: int) -> pa.Table:
    """Answers to documents, packed by the part that their uid hashes to."""
    part = (mix(uid.view(U64)) % U64(parts)).astype(np.int64)
    order = np.lexsort((at, uid, part))
    ends = np.searchsorted(part[order], np.arange(parts + 1))
    rows = [(i, order[a:z]) for i, (a, z) in enumerate(zip(ends[:-1], ends[1:], strict=True)) if z > a]
    return pa.Table.from_arrays(
        [pa.array([i for i, _ in rows], pa.int32()), pa.array([np.diff(uid[o], prepend=0).astype("<i8").tobytes() for _, o in rows], pa.binary()), pa.array([small(at[o]) for _, o in rows], pa.binary())],
        ["part", "uids", "at"],
    )


def by_document(table: pa.Table) -> pa.Table:
    """(uid, at): the answers to each document of a part, ascending."""
    uid = np.concatenate([np.cumsum(np.frombuffer(x.as_buffer(), "<i8")) for x in table["uids"]])
    at = np.concatenate([large(x) for x in table["at"]])
    order = np.lexsort((at, uid))
    uid, at = uid[order], at[order]
    once = np.concatenate([[True], (uid[1:] != uid[:-1]) | (at[1:] != at[:-1])])
    uid, at = uid[once], at[once]
    first = np.flatnonzero(np.concatenate([[True], uid[1:] != uid[:-1]]))
    cut = [small(x) for x in np.split(at, first[1:])]
    return pa.Table.from_arrays([pa.array(uid[first]), pa.array(cut, pa.binary())], ["uid", "at"])


def _anchors(kind: str, block: int, parts: int):
    def run(table: pa.Table) -> pa.Table:
        uid, at, key, told, told_at = unpacked(table, kind)
        aligned = at % block == 0
        hit = repeated(key, aligned) & aligned
        return replies(np.concatenate([uid[hit], told]), np.concatenate([at[hit], told_at]) // block, parts)

    return run


def _twice(kind: str, parts: int):
    def run(table: pa.Table) -> pa.Table:
        uid, at, key, told, told_at = unpacked(table, kind)
        hit = repeated(key, np.ones(len(key), bool))
        return replies(np.concatenate([uid[hit], told]), np.concatenate([at[hit], told_at]), parts)

    return run


def answered(packed: DataFrame, run) -> DataFrame:
    told = packed.groupBy("bucket").applyInArrow(run, "part int, uids binary, at binary")
    return common.cut(told.groupBy("part").applyInArrow(by_document, "uid long, at binary"))


def _rolling(window: int, block: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packer(buckets, "<u4", block)
        for b in batches:
            uids = b.column(0).to_numpy(zero_copy_only=False)
            for lo, hi, data, offsets in common.text_chunks(b.column(1)):
                w = common.words(data, offsets)
                counts = np.diff(w.first)
                starts, grams = w.grams(block)
                long = np.repeat(counts >= window, counts)[starts]
                out.add(uids[lo:hi], w.first, starts[long], grams[long] & U64(0xFFFFFFFF), grams[long] >> U64(32))
                if out.words >= FLUSH:
                    yield from out.flush()
        yield from out.flush()

    return run


def _extended(window: int, block: int, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out = Packer(buckets, "<u8", 1)
        for b in batches:
            uids, anchors = b.column(0).to_numpy(zero_copy_only=False), b.column(2)
            for lo, hi, data, offsets in common.text_chunks(b.column(1)):
                w = common.words(data, offsets)
                marks = np.zeros(int(w.first[-1]) + 1, np.int64)  # how many anchors each window has, as steps
                for i in range(lo, hi):
                    begin = int(w.first[i - lo])
                    blocks = large(anchors[i]) * block
                    np.add.at(marks, begin + np.maximum(blocks - (window - block), 0), 1)
                    np.add.at(marks, begin + blocks + 1, -1)
                all_starts = common.window_starts(w.first, window)
                starts = all_starts[np.cumsum(marks)[all_starts] > 0]
                out.add(uids[lo:hi], w.first, starts, common.window_hashes(w.hashes, starts, window, OTHER_BASE), common.window_hashes(w.hashes, starts, window))
                if out.words >= FLUSH:
                    yield from out.flush()
        yield from out.flush()

    return run


class Members:
    """A Bloom filter of uids: a slice for each part."""

    def __init__(self, uids: DataFrame, parts: int):
        n = uids.count()
        self.parts, self.slots = parts, max(64, min(16 * n, 8 * FILTER_BYTES) // parts // 8 * 8)
        self.bits = np.zeros(self.slots * parts // 8, np.uint8)
        slots = self.slots

        def run(table: pa.Table) -> pa.Table:
            marks = np.zeros(slots, bool)
            uid = table["uid"].to_numpy()
            for j in range(3):
                marks[_slot(uid, j, slots)] = True
            return pa.table({"part": pa.array([int(_part(uid[:1], parts)[0])], pa.int32()), "slice": [np.packbits(marks, bitorder="little").tobytes()]})

        for row in _with_part(uids, parts).groupBy("part").applyInArrow(run, "part int, slice binary").toLocalIterator():
            self.bits[row.part * slots // 8 :][: slots // 8] = np.frombuffer(row.slice, np.uint8)

    def has(self, uid: np.ndarray) -> np.ndarray:
        base, found = _part(uid, self.parts) * self.slots, np.ones(len(uid), bool)
        for j in range(3):
            at = base + _slot(uid, j, self.slots)
            found &= (self.bits[at >> 3] >> (at & 7).astype(np.uint8)) & 1 == 1
        return found


def _part(uid: np.ndarray, parts: int) -> np.ndarray:
    return (mix(uid.astype(np.int64).view(U64)) % U64(parts)).astype(np.int64)


def _slot(uid: np.ndarray, j: int, slots: int) -> np.ndarray:
    return (mix(uid.astype(np.int64).view(U64) ^ U64(0x51ED270B35F1 + j * 0x9E3779B97F4A7C15 & 0xFFFFFFFFFFFFFFFF)) % U64(slots)).astype(np.int64)


def _with_part(uids: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(_part(b.column(0).to_numpy(), parts), pa.int32())], ["uid", "part"])

    return uids.mapInArrow(run, "uid long, part int")


def _only(members, wanted: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            uid = b.column(b.schema.names.index("_tm_uid")).to_numpy(zero_copy_only=False)
            yield b.filter(pa.array(members.value.has(uid) == wanted))

    return run


def _finish(window: int, text: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            names = b.schema.names
            texts, starts = b.column(names.index(text)), b.column(names.index("_tm_at"))
            out, total, gone = [], [], []
            for t, s in zip(texts, starts, strict=True):
                words = (t.as_py() or "").encode().split()
                total.append(len(words))
                if s.is_valid:
                    at = large(s)
                    cover = np.zeros(len(words) + 1, np.int64)
                    cover[at] += 1
                    np.add.at(cover, at + window, -1)
                    left = np.cumsum(cover[:-1]) == 0
                    words = list(compress(words, left))
                gone.append(total[-1] - len(words))
                out.append(b" ".join(words))
            columns = [c for c, n in zip(b.columns, names, strict=True) if n != "_tm_at"]
            columns[names.index(text)] = pa.array(out, pa.binary()).cast(pa.string())
            kept = [n for n in names if n != "_tm_at"]
            yield pa.RecordBatch.from_arrays([*columns, pa.array(total, pa.int64()), pa.array(gone, pa.int64())], [*kept, "n_words", "n_removed"])

    return run


def dedup(docs: DataFrame, text: str = "text", window: int = WINDOW, repeatable: bool = False) -> DataFrame:
    """docs with their texts as they are after removal, n_words (before) and n_removed. repeatable: as in common.numbered."""
    spark, block = docs.sparkSession, (window + 1) // 2
    rows = common.numbered(docs.drop("n_words", "n_removed"), "_tm_uid", repeatable)
    buckets = max(1, -(-common.text_bytes(rows, text) // BUCKET_BYTES))
    told = max(1, buckets // 8)  # an answer is packed for each bucket and each of the fewer parts
    texts = rows.select("_tm_uid", F.col(text).alias("text"))
    anchors = answered(texts.mapInArrow(_rolling(window, block, buckets), PACKED), _anchors("<u4", block, told))

    members = spark.sparkContext.broadcast(Members(anchors.select("uid"), told))  # at most FILTER_BYTES
    touched = texts.mapInArrow(_only(members, True), texts.schema).join(anchors, F.col("_tm_uid") == F.col("uid")).select("uid", "text", "at")
    windows = answered(touched.mapInArrow(_extended(window, block, buckets), PACKED), _twice("<u8", told))

    inside = rows.mapInArrow(_only(members, True), rows.schema).join(windows.select(F.col("uid").alias("_tm_found"), F.col("at").alias("_tm_at")), F.col("_tm_uid") == F.col("_tm_found"), "left").drop("_tm_found")
    outside = rows.mapInArrow(_only(members, False), rows.schema).withColumn("_tm_at", F.lit(None).cast("binary"))
    joined = inside.unionByName(outside).drop("_tm_uid")
    return joined.mapInArrow(_finish(window, text), common.plus(joined.drop("_tm_at"), n_words="long", n_removed="long"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = dedup(common.read(spark, sf_dir, "documents").select("doc_id", "text"), repeatable=True)
    return found.select("doc_id", "n_words", "n_removed", F.sha2("text", 256).alias("kept_sha256"))


ORACLE = f"""
with split as (
  select doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x09-\\x0D ]+'), lambda w: w <> '') as words from documents),
windows as (select doc_id, words, unnest(range(1, len(words) - {WINDOW} + 2)) as i from split where len(words) >= {WINDOW}),
keyed as (select doc_id, i, md5(array_to_string(list_slice(words, i, i + {WINDOW - 1}), ' ')) as k from windows),
twice as (select doc_id, i from keyed qualify count(*) over (partition by k) > 1),
gone as (select distinct doc_id, unnest(range(i, i + {WINDOW})) as i from twice),
flat as (select doc_id, unnest(words) as w, generate_subscripts(words, 1) as i from split),
kept as (
  select f.doc_id, count(*) filter (g.i is not null) as n_removed, string_agg(w, ' ' order by f.i) filter (g.i is null) as text
  from flat f left join gone g on f.doc_id = g.doc_id and f.i = g.i group by f.doc_id)
select s.doc_id, len(s.words)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed, sha256(coalesce(k.text, '')) as kept_sha256
from split s left join kept k on s.doc_id = k.doc_id
"""
