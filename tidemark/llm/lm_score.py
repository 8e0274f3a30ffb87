"""Language-model scores from a log-frequency Bloom filter of quantised n-gram counts, held in slices.

Tokens are words in lower case (A-Z) and one end per document. Documents are read in blocks of bounded size; each sends its
distinct 1-, 2- and 3-grams, with how often its training documents have them, to the slices that their hashes name. A slice
adds the counts up and builds its part of the filter: a count c has level 1 + floor(log2 c), and the filter holds (n-gram, 1)
... (n-gram, level), so that a count is read back, to its power of two, by probing one level after the other. The slice
probes it for all that the blocks have sent and answers with the levels, and for words with their exact counts. The
blocks' documents meet these answers and are scored. So no filter is larger than a slice, whatever the corpus, what is gathered
grows with the corpus, and no n-gram is left out. (One filter sent to every worker, as the method has it, would have to be
cut off at some size.) An n-gram goes to a slice once from each block, so a very frequent one is no hot spot.

The model is Dirichlet-smoothed: p(w|uv) = (c(uvw) + M p(w|v)) / (c(uv) + M), p(w|v) = (c(vw) + M p(w)) / (c(v) + M), p(w) =
(c(w) + 1) / (N + V + 1); before the first token stands a start that occurs once a training document. M is that of ``WEIGHTS``
under which the training documents are likeliest when each n-gram's count is lowered by one (its own occurrence).

A null text is a document of one end; a null id counts as training; repeated rows each count and each give a row; texts of any
length are read whole; an empty table gives an empty one. Without training documents N = V = 0 and every score is that of the formula.
Words are told apart by 64-bit hashes, 2- and 3-grams by 32 bits within a slice: of the up to 2 million n-grams of one, about one in 2,000 coincides.
Columns besides id and text are left out, so names may clash with those of the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64, mix

ORDER = 3
#: Bits of the filter for each entry, and probes.
BITS, PROBES = 8, 5
#: Smoothing weights to choose from.
WEIGHTS = (2.0, 10.0, 50.0, 500.0)
#: Bytes of text that a slice answers for, on average, and of a block (one document at least).
SLICE_BYTES, BLOCK_BYTES = 8 << 20, 2 << 20
#: Documents whose blocks are kept together.
GROUP_BITS = 12
LEVELS = 64
END, START = U64(0x5BD1E9955BD1E995), U64(0xC2B2AE3D27D4EB4F)


def level(counts: np.ndarray) -> np.ndarray:
    return np.frexp(counts.astype(np.float64))[1]  # 0 for 0, 1 for 1, 2 for 2 and 3, ...


def middle(levels: np.ndarray) -> np.ndarray:
    """What a level stands for: the mean of its least and its greatest count; 0 for level 0."""
    low = np.exp2(np.maximum(levels, 1) - 1.0)
    return np.where(levels > 0, (3 * low - 1) / 2, 0.0)


@dataclass
class Tokens:
    doc: np.ndarray
    token: np.ndarray
    grams: list[np.ndarray]  # the 2-gram and the 3-gram that end with each token
    start: np.ndarray  # whether a token is the first of its document


def tokens(data: np.ndarray, offsets: np.ndarray) -> Tokens:
    w = common.words(data, offsets, lower=True)
    n = len(offsets) - 1
    counts = np.diff(w.first) + 1
    ends = np.cumsum(counts)
    token = np.full(ends[-1], END)
    inner = np.ones(ends[-1], bool)
    inner[ends - 1] = False
    token[inner] = w.hashes
    start = np.zeros(len(token), bool)
    start[ends - counts] = True
    grams, last = [], token
    for k in range(2, ORDER + 1):
        before = np.empty_like(token)
        before[1:] = last[:-1]
        before[start] = START  # nothing stands before a document's start, whatever the order
        last = mix(before * U64(0x9E3779B97F4A7C15) + mix(token + U64(k)))
        grams.append(last)
    return Tokens(np.repeat(np.arange(n), counts), token, grams, start)


@dataclass
class Block:
    """What a block of documents asks the slices for: its distinct words and n-grams, by slice."""

    words: np.ndarray
    word_slice: np.ndarray
    grams: np.ndarray
    gram_slice: np.ndarray
    word_of: np.ndarray  # of each token, its place among the words
    gram_of: np.ndarray  # of each order's n-grams, one order after the other, the place


def block(t: Tokens, slices: int) -> Block:
    def dealt(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        kind, of = np.unique(values, return_inverse=True)
        part = ((kind >> U64(32)) % U64(slices)).astype(np.int32)
        order = np.argsort(part, kind="stable")
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        return kind[order], part[order], place[of]

    words, word_slice, word_of = dealt(t.token)
    grams, gram_slice, gram_of = dealt(np.concatenate(t.grams))
    return Block(words, word_slice, grams, gram_slice, word_of, gram_of)


class Gather:
    """Puts rows, whose last column is the text, together into blocks: where a block ends depends on its own rows only."""

    def __init__(self):
        self.rows: list[pa.RecordBatch] = []
        self.size = 0

    def add(self, b: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        lo = 0
        for i, n in enumerate(pc.binary_length(b.column(b.num_columns - 1)).to_pylist()):
            if self.size + n > BLOCK_BYTES and (self.rows or i > lo):
                self.rows.append(b.slice(lo, i - lo))
                yield from self.rest()
                lo = i
            self.size += n
        if b.num_rows > lo:
            self.rows.append(b.slice(lo))

    def rest(self) -> Iterator[pa.RecordBatch]:
        if self.rows:
            whole = pa.Table.from_batches(self.rows).combine_chunks().to_batches()[0]
            self.rows, self.size = [], 0
            yield whole


def read_tokens(b: pa.RecordBatch) -> Tokens:
    (_, _, data, offsets), *_ = common.text_chunks(b.column(b.num_columns - 1), 1 << 62)
    return tokens(data, offsets)


def parts(*keys: np.ndarray) -> list[tuple[int, int]]:
    """Runs of rows that agree in all keys."""
    new = np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1
    edges = [0, *new.tolist(), len(keys[0])]
    return [(a, z) for a, z in zip(edges[:-1], edges[1:], strict=True) if z > a]


def _narrow(counts: np.ndarray) -> bytes:
    """Counts in one, four or eight bytes each, with a byte that tells which."""
    kind = next(k for k in ("<u1", "<u4", "<u8") if counts.max(initial=0) <= np.iinfo(k).max)
    return kind[-1].encode() + counts.astype(kind).tobytes()


def _wide(raw: pa.Scalar) -> np.ndarray:
    data = raw.as_buffer()
    return np.frombuffer(data, f"<u{data[0:1].to_pybytes().decode()}", -1, 1)


ASKED = "slice int, block long, words binary, word_counts binary, grams binary, gram_counts binary"


def _ask(slices: int):
    """From (uid, training, text): what each block asks each slice for. A block is named by its first uid."""

    def asked(b: pa.RecordBatch) -> pa.RecordBatch:
        uid, training, t = b.column(0)[0].as_py(), b.column(1).to_numpy(zero_copy_only=False), read_tokens(b)
        own = block(t, slices)
        counted = training[t.doc]
        words = np.bincount(own.word_of[counted], minlength=len(own.words))
        grams = np.bincount(own.gram_of[np.tile(counted, ORDER - 1)], minlength=len(own.grams))
        w, g = (np.searchsorted(x, np.arange(slices + 1)) for x in (own.word_slice, own.gram_slice))
        rows = np.flatnonzero((np.diff(w) > 0) | (np.diff(g) > 0)).tolist()
        low = own.grams.astype("<u4")  # the lower half: the upper one names the slice
        columns = [[own.words[w[i] : w[i + 1]].tobytes() for i in rows], [_narrow(words[w[i] : w[i + 1]]) for i in rows], [low[g[i] : g[i + 1]].tobytes() for i in rows], [_narrow(grams[g[i] : g[i + 1]]) for i in rows]]
        return pa.RecordBatch.from_arrays([pa.array(rows, pa.int32()), pa.array([uid] * len(rows), pa.int64()), *(pa.array(c, pa.binary()) for c in columns)], ["slice", "block", "words", "word_counts", "grams", "gram_counts"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, now = Gather(), None
        for b in batches:
            group = b.column(0).to_numpy(zero_copy_only=False) >> GROUP_BITS
            for a, z in parts(group):
                if group[a] != now:
                    yield from map(asked, held.rest())
                    now = group[a]
                yield from map(asked, held.add(b.slice(a, z - a)))
        yield from map(asked, held.rest())

    return run


@dataclass
class Filter:
    """A slice of the filter: (n-gram, level) entries in ``slots`` bits."""

    bits: np.ndarray

    @classmethod
    def build(cls, hashes: np.ndarray, levels: np.ndarray) -> Filter:
        bits = np.zeros(max(64, BITS * int(levels.sum())), bool)
        for k in range(1, int(levels.max(initial=0)) + 1):
            hashes, levels = hashes[levels >= k], levels[levels >= k]
            for j in range(PROBES):
                bits[places(hashes, k, j, len(bits))] = True
        return cls(bits)

    def levels(self, hashes: np.ndarray) -> np.ndarray:
        found, open_ = np.zeros(len(hashes), np.uint8), np.arange(len(hashes))
        for k in range(1, LEVELS):
            for j in range(PROBES):
                open_ = open_[self.bits[places(hashes[open_], k, j, len(self.bits))]]
            if not len(open_):
                break
            found[open_] = k
        return found


def places(hashes: np.ndarray, level: int, probe: int, slots: int) -> np.ndarray:
    return mix(hashes + U64(level * 0x9FB21C651E98DF25 + probe * 0xD6E8FEB86659FD93 & 0xFFFFFFFFFFFFFFFF)) % U64(slots)


def _summed(hashes: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes, the sum of each one's counts, and the place of each given hash among them."""
    kind, of = np.unique(hashes, return_inverse=True)
    return kind, np.bincount(of, counts, len(kind)).astype(np.int64), of


TOLD = "block long, slice int, words binary, grams binary, n long, kinds long"


def _answer(table: pa.Table) -> pa.Table:
    """One slice: sums the counts of all blocks, builds its filter and probes it for each block."""
    words = [np.frombuffer(x.as_buffer(), U64) for x in table["words"]]
    grams = [np.frombuffer(x.as_buffer(), "<u4") for x in table["grams"]]
    kind, total, of = _summed(np.concatenate(words), np.concatenate([_wide(x) for x in table["word_counts"]]).astype(np.float64))
    gram, times, gram_of = _summed(np.concatenate(grams), np.concatenate([_wide(x) for x in table["gram_counts"]]).astype(np.float64))
    gram = gram.astype(U64)
    seen = times > 0
    levels = Filter.build(gram[seen], level(times[seen])).levels(gram)[gram_of]
    counts = total[of]
    w, g = (np.cumsum([0, *map(len, x)]) for x in (words, grams))
    n = table.num_rows
    return pa.table(
        {
            "block": table["block"], "slice": table["slice"],
            "words": pa.array([_narrow(counts[w[i] : w[i + 1]]) for i in range(n)], pa.binary()), "grams": pa.array([levels[g[i] : g[i + 1]].tobytes() for i in range(n)], pa.binary()),
            "n": pa.array([int(total.sum())] + [0] * (n - 1), pa.int64()), "kinds": pa.array([int((total > 0).sum())] + [0] * (n - 1), pa.int64()),
        }
    )


def log_probabilities(t: Tokens, words: np.ndarray, levels: list[np.ndarray], documents: float, n: int, kinds: int, weight: float, less: np.ndarray) -> np.ndarray:
    """log10 of each token's probability. words: exact counts; levels: of the 2- and 3-grams; less: what to take off the counts."""
    p = (np.maximum(words - less, 0) + 1) / (n + kinds + 1)
    history = words
    for k, own in enumerate(levels):
        before = np.empty(len(p))
        before[1:] = history[:-1]
        before[t.start] = documents
        c, before = np.maximum(middle(own) - less, 0), np.maximum(before - less, 0)
        p = (c + weight * p) / (np.maximum(before, c) + weight)
        history = middle(levels[k])
    return np.log10(np.minimum(p, 1.0))


def _score(slices: int, n: int, kinds: int):
    """From answers and documents, sorted by group, answers first: a row for each document."""
    whole = np.log10(n + kinds + 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        told: dict[tuple[int, int], tuple] = {}
        held, now = Gather(), None
        for b in batches:
            group, is_doc = (b.column(b.schema.names.index(c)).to_numpy(zero_copy_only=False) for c in ("group", "is_doc"))
            for a, z in parts(group, is_doc):
                if group[a] != now:
                    yield from (scored(x, told) for x in held.rest())
                    told, now = {}, group[a]
                part = b.slice(a, z - a)
                if is_doc[a]:
                    yield from (scored(x, told) for x in held.add(part.select(["uid", "training", "id", "text"])))
                else:
                    for at, i, w, g in zip(*(part.column(part.schema.names.index(c)) for c in ("uid", "slice", "words", "grams")), strict=True):
                        told[at.as_py(), i.as_py()] = (_wide(w), np.frombuffer(g.as_buffer(), np.uint8))
        yield from (scored(x, told) for x in held.rest())

    def scored(b: pa.RecordBatch, told: dict) -> pa.RecordBatch:
        at, training, t, size = b.column(0)[0].as_py(), b.column(1).to_numpy(zero_copy_only=False), read_tokens(b), b.num_rows
        own = block(t, slices)
        words = np.concatenate([told[at, i][0] for i in np.unique(own.word_slice).tolist()]).astype(np.float64)[own.word_of]
        levels = np.concatenate([told[at, i][1] for i in np.unique(own.gram_slice).tolist()])[own.gram_of].astype(np.int64)
        levels = np.split(levels, ORDER - 1)
        base = np.bincount(t.doc, np.log10(words + 1) - whole, size)
        documents = words[np.flatnonzero(t.token == END)[0]]
        less = training[t.doc].astype(np.float64)
        scores = [np.bincount(t.doc, log_probabilities(t, words, levels, documents, n, kinds, m, np.zeros(len(less))), size) for m in WEIGHTS]
        unseen = [float(log_probabilities(t, words, levels, documents, n, kinds, m, less)[less > 0].sum()) for m in WEIGHTS]
        lists = pa.ListArray.from_arrays(pa.array(np.arange(0, (size + 1) * len(WEIGHTS), len(WEIGHTS)), pa.int32()), pa.array(np.stack(scores, axis=1).reshape(-1)))
        fits = pa.ListArray.from_arrays(pa.array([0, *[len(WEIGHTS)] * size], pa.int32()), pa.array(unseen))  # the block's, on its first row
        return pa.RecordBatch.from_arrays(
            [b.column(2), pa.array(np.bincount(t.doc, minlength=size)), pa.array(np.bincount(t.doc, words > 0, size).astype(np.int64)), pa.array(base), lists, fits],
            ["id", "n_tokens", "n_known", "base", "scores", "fits"],
        )

    return run


def score(docs: DataFrame, training: F.Column, key: str = "doc_id", text: str = "text", repeatable: bool = False) -> DataFrame:
    """A row per document: key, n_tokens, n_known, train_tokens, base_score, score. repeatable: as in common.numbered."""
    rows = common.numbered(docs.select(F.col(key).alias("id"), F.coalesce(training, F.lit(True)).alias("training"), F.coalesce(F.col(text), F.lit("")).alias("text")), "uid", repeatable)
    slices = max(1, -(-common.text_bytes(rows, "text") // SLICE_BYTES))
    kind = rows.schema["id"].dataType.simpleString()
    asked = rows.select("uid", "training", "text").mapInArrow(_ask(slices), ASKED)
    told = common.stored(asked.groupBy("slice").applyInArrow(_answer, TOLD))
    n, kinds = told.agg(F.coalesce(F.sum("n"), F.lit(0)), F.coalesce(F.sum("kinds"), F.lit(0))).first()
    answers = told.select(F.col("block").alias("uid"), F.lit(False).alias("is_doc"), "slice", "words", "grams")
    both = answers.unionByName(rows.withColumn("is_doc", F.lit(True)), allowMissingColumns=True).withColumn("group", F.shiftright("uid", GROUP_BITS))
    met = both.repartition("group").sortWithinPartitions("group", "is_doc", "uid")
    found = common.cut(met.mapInArrow(_score(slices, n, kinds), f"id {kind}, n_tokens long, n_known long, base double, scores array<double>, fits array<double>"))
    fits = found.agg(*[F.sum(F.get("fits", F.lit(i))) for i in range(len(WEIGHTS))]).first()
    best = max(range(len(WEIGHTS)), key=lambda i: (fits[i] if fits[i] is not None else 0.0, i))
    return found.select(F.col("id").alias(key), "n_tokens", "n_known", F.lit(n).cast("long").alias("train_tokens"), F.col("base").alias("base_score"), F.get("scores", F.lit(best)).alias("score"))


def op7_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held = common.doc_bucket("doc_id", 7) == 2
    return score(common.read(spark, sf_dir, "documents").select("doc_id", "text"), ~held, repeatable=True).withColumn("held_out", held)
