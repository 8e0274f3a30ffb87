"""Token ids in binary shards, with a minimal perfect hash index for access by document key.

Layout of a folder (its path may be of any file system that pyarrow.fs opens):

* ``data/NNNNN.ids``: raw ids of documents in ascending key order, as little-endian unsigned integers of 16 bits where
  the vocabulary allows it, else of 32 bits; no header, nothing in between.
* ``manifest``: Parquet; per shard its number, documents, ids, and how many ids all shards before it hold.
* ``index/NNNNN.mph``: for the keys that hash to this part, a minimal perfect hash (levels of bits; a key's place is the
  rank of its bit) and, by place, a fingerprint of the key, shard, offset and number of ids, and how many documents share
  the key. A key that was never written is told by its fingerprint, and costs the same constant time.

A null text is one end id, and so is an empty one; texts of any length are encoded whole, words at a time. Null keys sort first and are keys like others. Documents of one key are numbered from 0 in the
order of their texts; (key, number) is what the index holds, and looking a key up gives them all. Extra columns are left
out. An empty table gives an empty folder and no rows.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64, mix

#: Text of one shard, on average; there are at least as many shards as shuffle partitions.
SHARD_BYTES = 128 << 20
#: Keys of one index part; a part is built and loaded whole.
KEYS_A_PART = 1 << 15
#: Bits of a level for each key that is still without a place.
GAMMA = 2
LEVELS = 64
#: Words that a worker remembers from now, and about as many from before.
REMEMBERED = 300_000
#: Punctuation that may be cut off from the words around it.
CUT = re.compile(rb"[!-&(-/:-@\[-`{-~](?<=[a-z].)[!-&(-/:-@\[-`{-~]*(?=[\sa-z]|$)")
#: Words that the tokenizer's normalization and splitting leave as they are, but for the cut before punctuation.
PLAIN = re.compile(r"([a-z\u00df-\u00f6\u00f8-\u00ff]+)([!-&(-/:-@\[-`{-~]*)").fullmatch

ENTRY = np.dtype([("print", "<u4"), ("shard", "<u4"), ("offset", "<u8"), ("n", "<u8"), ("same", "<u4")])


def files(uri: str) -> tuple[pafs.FileSystem, str]:
    if uri.startswith("file:"):
        return pafs.LocalFileSystem(), re.sub(r"^file:/*", "/", uri)
    return pafs.FileSystem.from_uri(re.sub(r"^s3[an]:", "s3:", uri))


def key_hashes(keys: np.ndarray, null: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The hash that finds a (key, number)'s place, and an independent one for its fingerprint."""
    base = mix(keys.astype(np.int64).view(U64) + U64(1)) ^ (null.astype(U64) * U64(0xA5A5A5A5A5A5A5A5))
    base = mix(base + number.astype(U64) * U64(0x9E3779B97F4A7C15))
    return base, mix(base ^ U64(0x5851F42D4C957F2D)) & U64(0xFFFFFFFF)


def part_of(keys: np.ndarray, null: np.ndarray, parts: int) -> np.ndarray:
    return (key_hashes(keys, null, np.zeros(len(keys), np.int64))[1] % U64(parts)).astype(np.int64)


def _level(h: np.ndarray, level: int, bits: int) -> np.ndarray:
    return (mix(h + U64(level * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) % U64(bits)).astype(np.int64)


class PerfectHash:
    """Levels of bit arrays: at each level a key that no other meets sets its bit; the others go on to the next."""

    def __init__(self, levels: list[np.ndarray]):
        self.levels = levels
        flat = np.concatenate([np.zeros(1, np.int64), *[x.astype(np.int64) for x in levels]])
        self.rank = np.cumsum(flat)  # set bits before each bit
        self.base = np.cumsum([0, *map(len, levels)])

    @classmethod
    def build(cls, h: np.ndarray) -> PerfectHash:
        levels = []
        while len(h):
            if len(levels) == LEVELS:
                raise ValueError("two keys have the same 64-bit hash")
            bits = max(64, GAMMA * len(h))
            at = _level(h, len(levels), bits)
            alone = np.bincount(at, minlength=bits) == 1
            levels.append(alone)
            h = h[~alone[at]]
        return cls(levels)

    def places(self, h: np.ndarray) -> np.ndarray:
        """The place of each key; -1 for some keys that aren't held."""
        found, open_ = np.full(len(h), -1, np.int64), np.arange(len(h))
        for k, bits in enumerate(self.levels):
            at = _level(h[open_], k, len(bits))
            hit = bits[at]
            found[open_[hit]] = self.rank[self.base[k] + at[hit]]
            open_ = open_[~hit]
        return found


def dump_part(keys: np.ndarray, null: np.ndarray, entries: np.ndarray, number: np.ndarray) -> bytes:
    h, prints = key_hashes(keys, null, number)
    perfect = PerfectHash.build(h)
    table = np.zeros(len(h), ENTRY)
    entries["print"] = prints
    table[perfect.places(h)] = entries
    sizes = np.array([len(perfect.levels), *map(len, perfect.levels)], "<u8")
    return sizes.tobytes() + b"".join(np.packbits(x, bitorder="little").tobytes() for x in perfect.levels) + table.tobytes()


def load_part(raw: bytes) -> tuple[PerfectHash, np.ndarray]:
    n = int(np.frombuffer(raw, "<u8", 1)[0])
    sizes, at, levels = np.frombuffer(raw, "<u8", n, 8).astype(np.int64), 8 + 8 * n, []
    for size in sizes:
        length = -(-int(size) // 8)
        levels.append(np.unpackbits(np.frombuffer(raw, np.uint8, length, at), count=int(size), bitorder="little").astype(bool))
        at += length
    return PerfectHash(levels), np.frombuffer(raw[at:], ENTRY)


class WordEncoder:
    """Encodes texts word by word with the tokenizers library, remembering what it has seen.

    That gives the ids of the whole text for a vocabulary that drops white space, ignores case, and never joins letters
    with punctuation: then ASCII letters may be put in lower case first, and punctuation (but apostrophes) that stands
    between a letter and a space or letter may be cut off. Texts that could hold a special token are left as they are. New
    words of small letters skip normalization and the splitting pattern, which would leave them as they are.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.library = Tokenizer.from_file(path)
        self.plain = Tokenizer(self.library.model)
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.digit = self.library.encode("0", add_special_tokens=False).ids  # one id that no letters or symbols give
        self.size = np.dtype("<u2" if self.library.get_vocab_size() <= 1 << 16 else "<u4")
        self.border = next(((i, t.content) for i, t in self.library.get_added_tokens_decoder().items() if t.special and "<|" in t.content), None)
        self.known: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _learn(self, words: set[bytes]) -> dict[bytes, bytes]:
        """The ids of words that aren't known; they are from now on."""
        told = {w: self.older[w] for w in words & self.older.keys()} if self.older else {}
        plain, other = [], []
        for w in words - told.keys():
            text = w.decode()
            (plain if PLAIN(text) else other).append((w, text))
        for some, encode in ((plain, self._encode_plain), (other, self._encode)):
            for lo in range(0, len(some), 2_000):
                part = some[lo : lo + 2_000]
                told.update(zip((w for w, _ in part), encode([t for _, t in part]), strict=True))
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        self.known.update(told)
        return told

    def _encode_plain(self, words: list[str]) -> list[bytes]:
        text = " 0 ".join([" ".join(PLAIN(w).groups()) for w in words])
        return self._cut(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.digit[0])

    def _encode(self, words: list[str]) -> list[bytes]:
        """The ids of each word. Words without special tokens go through the library as one text, with one in between."""
        if self.border is None or any("<|" in w for w in words):
            found = self.library.encode_batch_fast(words, add_special_tokens=False)
            return [np.array(x.ids, self.size).tobytes() for x in found]
        return self._cut(self.library.encode_batch_fast([self.border[1].join(words)], add_special_tokens=False)[0].ids, self.border[0])

    def _cut(self, ids: list[int], border: int) -> list[bytes]:
        ids = np.array(ids, self.size)
        at, raw, n = np.flatnonzero(ids == border).tolist(), ids.tobytes(), self.size.itemsize
        return [raw[a * n : b * n] for a, b in zip([0, *[x + 1 for x in at]], [*at, len(ids)], strict=True)]

    def __call__(self, texts: list[bytes]) -> list[bytes]:
        return common.remembered([(t if b"<|" in t else CUT.sub(rb" \g<0> ", t.lower())).split() for t in texts], self.known, self._learn)


@lru_cache(2)
def word_encoder(path: str) -> WordEncoder:
    return WordEncoder(path)


def write(docs: DataFrame, folder: str, tokenizer: str, end: int, key: str = "doc_id", text: str = "text", shards: int | None = None) -> DataFrame:
    """Writes data, manifest and index below folder; returns the manifest."""
    common.small_batches(docs.sparkSession)
    spark = docs.sparkSession
    shards = shards or max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-common.text_bytes(docs, text) // SHARD_BYTES))
    fs, root = files(folder)
    for d in ("data", "index"):
        fs.create_dir(f"{root}/{d}", recursive=True)

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, task = word_encoder(tokenizer), TaskContext.get()
        fs, root = files(folder)
        shard, offset, last, number = task.partitionId(), 0, (), 0
        name = f"{root}/data/{shard:05d}.ids"
        stop, out = np.array([end], encode.size).tobytes(), None
        for batch in batches:
            for lo, hi, data, offsets in common.text_chunks(batch.column(1)):
                raw = data.tobytes()
                found = encode([raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)])
                out = out or fs.open_output_stream(f"{name}.{task.taskAttemptId()}")
                out.write(b"".join(chain.from_iterable((x, stop) for x in found)))
                keys, rows = batch.column(0)[lo:hi].to_pylist(), []
                for k, ids in zip(keys, found, strict=True):
                    number = number + 1 if (k,) == last else 0
                    last = (k,)
                    n = len(ids) // encode.size.itemsize + 1
                    rows.append((number, offset, n))
                    offset += n
                number_, offset_, n_ = zip(*rows, strict=True)
                yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(number_, pa.int64()), pa.array([shard] * len(keys), pa.int32()), pa.array(offset_, pa.int64()), pa.array(n_, pa.int64())], ["key", "number", "shard", "offset", "n"])
        if out:
            out.close()
            fs.move(f"{name}.{task.taskAttemptId()}", name)

    placed = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text")).repartitionByRange(shards, "key").sortWithinPartitions("key", "text")
    placed.mapInArrow(put, "key long, number long, shard int, offset long, n long").write.parquet(f"{folder}/places")
    placed = spark.read.schema("key long, number long, shard int, offset long, n long").parquet(f"{folder}/places")

    totals = placed.groupBy("shard").agg(F.count("*").alias("docs"), F.sum("n").alias("ids"))
    before = F.coalesce(F.expr("sum(ids) over (order by shard rows between unbounded preceding and 1 preceding)"), F.lit(0)).alias("before")
    totals.select("*", before).coalesce(1).write.parquet(f"{folder}/manifest")  # a row for each shard

    parts = max(1, -(-placed.count() // KEYS_A_PART))
    same = placed.groupBy("key").agg(F.count("*").alias("same"))
    indexed = placed.join(same.filter("same > 1"), placed["key"].eqNullSafe(same["key"]), "left").select(placed["*"], F.coalesce("same", F.lit(1)).alias("same"))

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = files(folder)
        for part, rows in _by_part(batches):
            entries = np.zeros(len(rows["key"]), ENTRY)
            for name in ("shard", "offset", "n", "same"):
                entries[name] = rows[name]
            name = f"{root}/index/{part:05d}.mph"
            with fs.open_output_stream(mine := f"{name}.{TaskContext.get().taskAttemptId()}") as out:
                out.write(dump_part(rows["key"], rows["null"], entries, rows["number"]))
            fs.move(mine, name)
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "keys": pa.array([len(entries)], pa.int64())})

    (_with_part(indexed, parts).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(build, "part int, keys long").write.parquet(f"{folder}/parts"))
    return spark.read.parquet(f"{folder}/manifest")


def _with_part(keys: DataFrame, parts: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            k, null = _keys(b.column(b.schema.names.index("key")))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(part_of(k, null, parts), pa.int32())], [*b.schema.names, "part"])

    return keys.mapInArrow(run, common.plus(keys, part="int"))


def _keys(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    return column.fill_null(0).to_numpy(zero_copy_only=False), column.is_null().to_numpy(zero_copy_only=False)


def _by_part(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, dict[str, np.ndarray]]]:
    """The rows of each part in a sorted stream; the rows of one part are in memory at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        parts = b.column(b.schema.names.index("part")).to_numpy(zero_copy_only=False)
        edges = np.concatenate([[0], np.flatnonzero(np.diff(parts)) + 1, [len(parts)]]) if len(parts) else []
        for lo, hi in zip(edges[:-1], edges[1:], strict=True):
            if parts[lo] != now and held:
                yield now, _columns(held)
                held = []
            now = int(parts[lo])
            held.append(b.slice(lo, hi - lo))
    if held:
        yield now, _columns(held)


def _columns(held: list[pa.RecordBatch]) -> dict[str, np.ndarray]:
    table = pa.Table.from_batches(held).combine_chunks()
    found = {n: table[n].combine_chunks() for n in table.column_names}
    key, null = _keys(found.pop("key"))
    return {"key": key, "null": null} | {n: v.to_numpy(zero_copy_only=False) for n, v in found.items()}


def lookup(keys: DataFrame, folder: str, key: str = "doc_id") -> DataFrame:
    """For each distinct key that the folder holds: key, number, shard, offset, n, by way of the index."""
    spark = keys.sparkSession
    parts = max(1, -(-_documents(spark, folder) // KEYS_A_PART))

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = files(folder)
        for part, rows in _by_part(batches):
            name = f"{root}/index/{part:05d}.mph"
            if fs.get_file_info(name).type == pafs.FileType.NotFound:
                continue
            with fs.open_input_file(name) as f:
                perfect, table = load_part(f.read())
            open_, number = np.arange(len(rows["key"])), 0
            while len(open_):
                h, prints = key_hashes(rows["key"][open_], rows["null"][open_], np.full(len(open_), number))
                at = perfect.places(h)
                hit = (at >= 0) & (table["print"][at] == prints)
                open_, at = open_[hit], at[hit]
                if len(open_):
                    e = table[at]
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rows["key"][open_], pa.int64(), mask=rows["null"][open_]), pa.array(np.full(len(open_), number), pa.int64())] + [pa.array(e[c].astype(np.int64), t) for c, t in (("shard", pa.int32()), ("offset", pa.int64()), ("n", pa.int64()))],
                        ["key", "number", "shard", "offset", "n"],
                    )
                number += 1
                more = e["same"] > number if len(open_) else np.zeros(0, bool)
                open_ = open_[more]

    wanted = keys.select(F.col(key).cast("long").alias("key")).distinct()
    return _with_part(wanted, parts).repartition(parts, "part").sortWithinPartitions("part").mapInArrow(find, "key long, number long, shard int, offset long, n long")


def _documents(spark: SparkSession, folder: str) -> int:
    return spark.read.parquet(f"{folder}/manifest").agg(F.coalesce(F.sum("docs"), F.lit(0))).first()[0]


def fetch(keys: DataFrame, folder: str, tokenizer: str, key: str = "doc_id") -> DataFrame:
    """For each key held: key, number, start (ids of all documents before it), n, ids (32-bit little-endian)."""
    manifest = F.broadcast(keys.sparkSession.read.parquet(f"{folder}/manifest").select("shard", "before"))  # a row a shard

    def payload(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        (fs, root), size, name, source = files(folder), word_encoder(tokenizer).size, None, None
        for b in batches:
            ids = []
            for shard, offset, n in zip(b.column(2).to_pylist(), b.column(3).to_pylist(), b.column(4).to_pylist(), strict=True):
                if shard != name:
                    name, source = shard, fs.open_input_file(f"{root}/data/{shard:05d}.ids")
                raw = source.read_at(n * size.itemsize, offset * size.itemsize)
                ids.append(np.frombuffer(raw, size).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(ids, pa.binary())], [*b.schema.names, "ids"])

    places = lookup(keys, folder, key).repartition("shard").sortWithinPartitions("shard", "offset")
    found = places.mapInArrow(payload, common.plus(places, ids="binary"))
    return found.join(manifest, "shard").select(F.col("key").alias(key), "number", (F.col("before") + F.col("offset")).alias("start"), "n", "ids")


def op6_token_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as public

    docs, path = common.read(spark, sf_dir, "documents"), public.path("word_bpe_49k.json")
    folder = common.scratch(spark, "token-shards")
    write(docs.select("doc_id", "text"), folder, path, end=2)
    return fetch(docs.select("doc_id"), folder, path).select("doc_id", "start", F.col("n").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
