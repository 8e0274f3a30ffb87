"""What the operators of this package share: reading tables, cutting lineage, and hashing words with numpy.

Words here are runs of bytes other than the six ASCII white-space characters, of UTF-8 text.
"""

from __future__ import annotations

import re
import tempfile
import uuid
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Text is hashed in pieces of about this many bytes (one document at least), which bounds a task's memory.
CHUNK_BYTES = 1 << 18
#: Rows that go to a Python worker at a time, at most: Spark's own number makes batches of texts large.
BATCH_ROWS = 2000

U64 = np.uint64
BYTE_BASE = U64(0x9E3779B97F4A7C15)
WORD_BASE = U64(0xD1342543DE82EF95)
SPACES = np.zeros(256, bool)
SPACES[[9, 10, 11, 12, 13, 32]] = True


def small_batches(spark: SparkSession) -> None:
    """Has the session send rows to Python workers in batches of at most BATCH_ROWS; a smaller setting stays."""
    name = "spark.sql.execution.arrow.maxRecordsPerBatch"
    if not 0 < int(spark.conf.get(name)) <= BATCH_ROWS:
        spark.conf.set(name, str(BATCH_ROWS))


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    small_batches(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share, as the session names it; one of our own only where there is one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        return folder.rstrip("/")
    if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    if not getattr(spark, "_tidemark_scratch", None):
        spark._tidemark_scratch = tempfile.mkdtemp(prefix="tidemark-")
        spark.sparkContext.setCheckpointDir(spark._tidemark_scratch)
    return f"file://{spark._tidemark_scratch}"


def scratch(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing else uses."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def drop(spark: SparkSession, path: str) -> None:
    """Deletes what a path holds, on whatever store."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)


@contextmanager
def _freeing(spark: SparkSession) -> Iterator[None]:
    """The files of the shuffles of what is planned and run inside are freed at its end, not when the driver happens to collect its garbage."""
    freed = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(freed, "false")
    spark.conf.set(freed, "true")
    try:
        yield
    finally:
        spark.conf.set(freed, before)


def cut(df: DataFrame) -> DataFrame:
    """df, computed once and stored in the shared folder, without its lineage; the files of its shuffles are freed as soon as it is stored."""
    shared_folder(df.sparkSession)
    with _freeing(df.sparkSession):
        return df.select("*").checkpoint(eager=True)  # planned anew, as the setting holds for what is planned under it


def stored(df: DataFrame) -> DataFrame:
    """df, computed once and stored as a table in the shared folder; the files of its shuffles are freed as soon as it is written."""
    spark, path = df.sparkSession, scratch(df.sparkSession, "stored")
    with _freeing(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def numbered(docs: DataFrame, name: str, repeatable: bool) -> DataFrame:
    """docs with a number for each row, the same whenever it is computed again, after the loss of an executor too.

    repeatable: whether the rows come in the same order each time, as they do when they are read from files without a
    shuffle. Others are stored once in the shared folder and read from there.
    """
    small_batches(docs.sparkSession)
    if not repeatable:
        path = scratch(docs.sparkSession, "numbered")
        docs.write.parquet(path)
        docs = docs.sparkSession.read.schema(docs.schema).parquet(path)
    return docs.withColumn(name, F.monotonically_increasing_id())


def text_bytes(docs: DataFrame, text: str) -> int:
    """Bytes of all texts, by which the number of parts of a hashed table is chosen."""
    return docs.agg(F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()[0]


def plus(df: DataFrame, **columns: str) -> str:
    """The schema of df and further columns, as a DDL string."""
    return ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema.fields] + [f"`{n}` {t}" for n, t in columns.items()])


def doc_bucket(column: str, n: int) -> F.Column:
    """crc32 of an id as text, modulo n; 0 for a null id."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % n, F.lit(0))


def mix(h: np.ndarray) -> np.ndarray:
    """Spreads the bits of 64-bit values (a bijection)."""
    h = h ^ (h >> U64(33))
    h = h * U64(0xFF51AFD7ED558CCD)
    h ^= h >> U64(33)
    h *= U64(0xC4CEB9FE1A85EC53)
    h ^= h >> U64(33)
    return h


class Powers:
    """base^i and base^-i modulo 2^64, for as many i as were asked for."""

    def __init__(self, base: np.uint64):
        self.base, self.inverse = base, U64(pow(int(base), -1, 1 << 64))
        self.up = self.down = np.ones(0, U64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, 1 << 16)
            up, down = np.full(size, self.base, U64), np.full(size, self.inverse, U64)
            up[0] = down[0] = 1
            self.up, self.down = np.cumprod(up, dtype=U64), np.cumprod(down, dtype=U64)
        return self.up[:n], self.down[:n]


_bytes_powers, _word_powers = Powers(BYTE_BASE), Powers(WORD_BASE)


@dataclass
class Words:
    """The words of some documents in a row. first[d] .. first[d + 1] are those of document d."""

    data: np.ndarray  # the bytes of all these documents
    starts: np.ndarray  # of each word, in data
    ends: np.ndarray
    hashes: np.ndarray
    first: np.ndarray

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), np.diff(self.first))

    def grams(self, n: int, values: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Where each run of n words of one document starts, and its hash."""
        values = self.hashes if values is None else values
        starts = window_starts(self.first, n)
        return starts, window_hashes(values, starts, n)


def window_starts(first: np.ndarray, n: int) -> np.ndarray:
    total = int(first[-1])
    room = np.repeat(first[1:], np.diff(first)) - np.arange(total)
    return np.flatnonzero(room >= n)


def window_hashes(values: np.ndarray, starts: np.ndarray, n: int, base: np.uint64 | None = None) -> np.ndarray:
    powers = _word_powers if base is None else _powers_of(base)
    up, down = powers(len(values))
    total = np.concatenate([np.zeros(1, U64), np.cumsum(values * up, dtype=U64)])
    return mix((total[starts + n] - total[starts]) * down[starts])


_other_powers: dict[int, Powers] = {}


def _powers_of(base: np.uint64) -> Powers:
    return _other_powers.setdefault(int(base), Powers(base))


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32


def words(data: np.ndarray, offsets: np.ndarray, lower: bool = False, inside: np.ndarray | None = None) -> Words:
    """inside: which bytes belong to words; all but white space unless given."""
    if lower:
        data = LOWER[data]
    flags = (~SPACES if inside is None else inside)[data]
    n = len(data)
    edge = np.zeros(n + 1, bool)
    edge[offsets] = True
    before = np.zeros(n, bool)
    before[1:] = flags[:-1]
    starts = np.flatnonzero(flags & (~before | edge[:n]))
    after = np.zeros(n, bool)
    after[:-1] = flags[1:]
    ends = np.flatnonzero(flags & (~after | edge[1:])) + 1
    up, down = _bytes_powers(n)
    total = np.concatenate([np.zeros(1, U64), np.cumsum((data.astype(U64) + U64(1)) * up, dtype=U64)])
    hashes = mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U64)) if n else np.zeros(0, U64)
    return Words(data, starts, ends, hashes, np.searchsorted(starts, offsets).astype(np.int64))


def text_chunks(column: pa.Array, most: int = CHUNK_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Rows lo .. hi of a string column, their bytes and the offsets of each in these; null is empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    kind = np.int64 if pa.types.is_large_string(column.type) else np.int32
    offsets = np.frombuffer(offsets, kind)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    data = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    lo = 0
    while lo < len(column):
        hi = max(lo + 1, int(np.searchsorted(offsets, offsets[lo] + most, "right")) - 1)
        yield lo, hi, data[offsets[lo] : offsets[hi]], offsets[lo : hi + 1] - offsets[lo]
        lo = hi


def remembered(split: list[list], known: dict, learn: Callable[[set], dict]) -> list[bytes]:
    """For each list of keys what is known of them, joined; learn tells the rest, all at once."""
    found = [list(map(known.get, keys)) for keys in split]
    holes = [[i for i, x in enumerate(f) if x is None] for f in found]
    if new := {keys[i] for keys, h in zip(split, holes, strict=True) for i in h}:
        told = learn(new)
        for keys, f, h in zip(split, found, holes, strict=True):
            for i in h:
                f[i] = told[keys[i]]
    return [b"".join(f) for f in found]


def hash_words(text: str, lower: bool = False) -> np.ndarray:
    data = np.frombuffer(text.encode(), np.uint8)
    return words(data, np.array([0, len(data)]), lower).hashes
