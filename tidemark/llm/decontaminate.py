"""Benchmark decontamination: n-gram seeds find passages of test items, local alignment scores them.

Words are compared in lower case and without punctuation. An item's seeds are all its 3-grams, however common, so that no
leaked copy, edited or not, loses them by how often others have leaked. One pass joins the documents' 3-grams to the seeds;
where at least two different seeds of one item (one, for items of fewer than six words) lie close together and the words in
common could give the score, Smith-Waterman alignment of item and surroundings gives it: 2 for equal words, -1 for different
or missing ones, divided by what the whole item would get. A document is contaminated by an item if that is at least ``least``.

The items are broadcast in blocks of a fixed number of words, each block meeting all documents: benchmarks of any size are
searched whole, at one pass over the documents for each block. Nothing of the documents is shuffled. Where items have a beginning in
common, its seeds lead to all of them; a document full of such seeds first leaves out the items of whose words it has too few, and the
rest is looked at in parts of bounded size.

A passage with a word put in after every two has no 3-gram left and isn't found, though its alignment may score 0.5 or more; with
one put in after every third word, or a word in eight replaced, it is.

Null texts count as empty; items without words match nothing; an item of fewer than three words must occur as a whole. Repeated
documents and repeated items each give their own rows; of several places with the best score in one document the first counts.
Texts of any length are read whole. Without items or documents there are no rows. Other columns are left out by ``find``,
whatever their names, and kept by ``clean``.
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
from .common import SPACES, Words

N = 3
#: Words of the items of one block, which is broadcast.
BLOCK_WORDS = 1_000_000
LEAST = 0.5
#: Pairs of a hit and an item that are looked at together.
PAIRS = 1_000_000
_INSIDE = ~SPACES
_INSIDE[[*range(48), *range(58, 65), *range(91, 97), *range(123, 128)]] = False


def plain_words(texts: pa.Array, most: int = common.CHUNK_BYTES) -> Iterator[tuple[int, Words]]:
    """Pieces of a column of texts: the first row, and the words to compare. Documents and items both come this way."""
    lower = pc.replace_substring(pc.utf8_lower(texts), "ς", "σ")  # a sigma at a word's end is one like others
    for lo, _, data, offsets in common.text_chunks(lower, most):
        yield lo, common.words(data, offsets, inside=_INSIDE)


@dataclass
class Block:
    """Items with their words, and seeds: for each hash, the items that have it."""

    ids: list
    words: list[np.ndarray]
    hashes: np.ndarray  # sorted, one for each (hash, item)
    items: np.ndarray
    vocabulary: np.ndarray  # all words, sorted; then one row for each (word, item): place of the word, item, times
    word: np.ndarray
    holder: np.ndarray
    times: np.ndarray

    @property
    def sizes(self) -> np.ndarray:
        return np.array([*map(len, self.words)])

    def possible(self, words: np.ndarray, least: float) -> np.ndarray:
        """Of each item: whether a document of these words has enough of the item's own ones for it."""
        at = np.minimum(np.searchsorted(self.vocabulary, words), len(self.vocabulary) - 1)
        have = np.bincount(at[self.vocabulary[at] == words], minlength=len(self.vocabulary))
        shared = np.bincount(self.holder, weights=np.minimum(have[self.word], self.times), minlength=len(self.words))
        return shared >= least * self.sizes


def blocks(benchmark: DataFrame, key: str, text: str, most: int = BLOCK_WORDS) -> Iterator[Block]:
    ids, texts, size = [], [], 0
    for row in benchmark.select(F.col(key).alias("k"), F.col(text).alias("t")).filter("t is not null").toLocalIterator():
        if size and size + len(row.t) // 2 > most:
            yield block(ids, texts)
            ids, texts, size = [], [], 0
        ids.append(row.k)
        texts.append(row.t)
        size += len(row.t) // 2 + 1
    if ids:
        yield block(ids, texts)


def block(ids: list, texts: list[str]) -> Block:
    ((_, w),) = plain_words(pa.array(texts, pa.large_string()), 1 << 62)
    each = [w.hashes[a:b] for a, b in zip(w.first[:-1], w.first[1:], strict=True)]
    starts, grams = w.grams(N)
    items = w.doc[starts]
    short = [i for i, x in enumerate(each) if 0 < len(x) < N]
    grams = np.concatenate([grams, np.array([_whole(each[i]) for i in short], np.uint64)])
    items = np.concatenate([items, np.array(short, np.int64)])
    pairs = np.unique(np.stack([grams.view(np.int64), items]), axis=1) if len(grams) else np.zeros((2, 0), np.int64)
    order = np.argsort(pairs[0].view(np.uint64), kind="stable")
    vocabulary, at = np.unique(w.hashes, return_inverse=True)
    cells, times = np.unique(at * max(1, len(each)) + w.doc, return_counts=True)
    return Block(ids, each, pairs[0].view(np.uint64)[order], pairs[1][order], vocabulary, cells // max(1, len(each)), cells % max(1, len(each)), times)


def _whole(words: np.ndarray) -> np.uint64:
    return common.window_hashes(words, np.array([0]), len(words))[0]


def seed_hits(w: Words, hashes: np.ndarray, short: set[int]) -> tuple[np.ndarray, np.ndarray]:
    """Where grams of these documents are in a sorted array of hashes: word, and first index of the hash."""
    found = []
    for n in (N, *sorted(short)):
        starts, grams = w.grams(n)
        at = np.minimum(np.searchsorted(hashes, grams), len(hashes) - 1)
        hit = hashes[at] == grams
        found.append((starts[hit], at[hit]))
    return np.concatenate([f[0] for f in found]), np.concatenate([f[1] for f in found])


def in_common(item: np.ndarray, words: np.ndarray) -> int:
    """How many words an alignment can match at most."""
    kind, wanted = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(kind, words), len(kind) - 1)
    return int(np.minimum(wanted, np.bincount(at[kind[at] == words], minlength=len(kind))).sum())


def align(item: np.ndarray, words: np.ndarray) -> tuple[int, int, int]:
    """Smith-Waterman with scores 2, -1, -1: the best score, and the words of the text that it spans."""
    best, end = _best(item, words)
    if best == 0:
        return 0, 0, 0
    _, back = _best(item[::-1], words[: end + 1][::-1], best)
    return best, end - back, end + 1


def _best(item: np.ndarray, words: np.ndarray, stop: int | None = None) -> tuple[int, int]:
    """The best score and the last word of the first alignment that has it; with stop, the first that reaches it."""
    steps = np.arange(len(words) + 1)
    row, best, at = np.zeros(len(words) + 1, np.int64), 0, 0
    for word in item:
        new = np.zeros_like(row)
        new[1:] = np.maximum(np.maximum(row[:-1] + np.where(words == word, 2, -1), row[1:] - 1), 0)
        row = np.maximum.accumulate(new + steps) - steps
        top = int(row.argmax())
        if row[top] > best:
            best, at = int(row[top]), top - 1
            if stop is not None and best >= stop:
                break
    return best, at


def find(docs: DataFrame, benchmark: DataFrame, key: str = "doc_id", text: str = "text", item_key: str = "item_id", item_text: str = "text", least: float = LEAST, most: int = BLOCK_WORDS) -> DataFrame:
    """A row for each document and item that it holds: key, item_key, score, n_seeds, first_word, last_word."""
    common.small_batches(docs.sparkSession)
    kind, item_kind = docs.schema[key].dataType.simpleString(), benchmark.schema[item_key].dataType.simpleString()
    schema = f"`{key}` {kind}, `{item_key}` {item_kind}, score double, n_seeds int, first_word long, last_word long"
    parts = docs.select(F.col(key), F.col(text).alias("text"))
    found = docs.sparkSession.createDataFrame([], schema)
    for one in blocks(benchmark, item_key, item_text, most):
        if len(one.hashes):
            shared = docs.sparkSession.sparkContext.broadcast(one)  # of about `most` words
            found = found.unionByName(parts.mapInArrow(_finder(shared, least, (key, item_key)), schema))
    return found


def _finder(shared, least: float, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = shared.value
        short = {len(x) for x in one.words if 0 < len(x) < N}
        for b in batches:
            rows, out = [], []
            for lo, w in plain_words(b.column(1)):
                for doc, hit in matches(w, one, short, least):
                    rows.append(lo + doc)
                    out.append(hit)
            if rows:
                item, score, seeds, first, last = zip(*out, strict=True)
                yield pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(rows)), pa.array([one.ids[i] for i in item]), pa.array(score, pa.float64()), pa.array(seeds, pa.int32()), pa.array(first, pa.int64()), pa.array(last, pa.int64())],
                    [*names, "score", "n_seeds", "first_word", "last_word"],
                )

    return run


def matches(w: Words, one: Block, short: set[int], least: float) -> Iterator[tuple[int, tuple]]:
    """For each document and item with seeds close together: the best alignment, if it is good enough.

    A seed of many items meets all of them, so a document with many such seeds is taken alone: only items of which it has
    enough words at all go on, in parts with at most PAIRS pairs of hit and item (or one item)."""
    words, at = seed_hits(w, one.hashes, short)
    if not len(words):
        return
    order = np.lexsort((at, words))  # by document, too
    words, at = words[order], at[order]
    many = np.searchsorted(one.hashes, one.hashes[at], "right") - at
    docs = w.doc[words]
    edges = np.append(np.flatnonzero(np.diff(docs, prepend=-1)), len(docs))
    before = np.concatenate([[0], np.cumsum(many)])
    lo = 0
    for k in range(1, len(edges)):
        a, z = edges[lo], edges[k]
        if k + 1 < len(edges) and before[edges[k + 1]] - before[a] <= PAIRS:
            continue
        if before[z] - before[a] <= PAIRS:
            yield from _aligned(w, one, words[a:z], at[a:z], many[a:z], np.arange(len(one.items)), least)
        else:
            d = int(docs[a])
            fine = np.flatnonzero(one.possible(w.hashes[w.first[d] : w.first[d + 1]], least))
            yield from _in_parts(w, one, words[a:z], at[a:z], many[a:z], fine, least)
        lo = k


def _in_parts(w: Words, one: Block, words: np.ndarray, at: np.ndarray, many: np.ndarray, fine: np.ndarray, least: float) -> Iterator[tuple[int, tuple]]:
    """Matches of one document with some items."""
    if not len(fine):
        return
    kept = np.zeros(len(one.words), bool)
    kept[fine] = True
    entries = kept[one.items]
    upto = np.concatenate([[0], np.cumsum(entries)])
    start, some = upto[at], upto[at + many] - upto[at]
    if some.sum() > PAIRS and len(fine) > 1:
        for part in np.array_split(fine, 2):
            yield from _in_parts(w, one, words, at, many, part, least)
    else:
        hit = some > 0
        yield from _aligned(w, one, words[hit], start[hit], some[hit], np.flatnonzero(entries), least)


def _aligned(w: Words, one: Block, words: np.ndarray, at: np.ndarray, many: np.ndarray, entries: np.ndarray, least: float) -> Iterator[tuple[int, tuple]]:
    """Hits at words; at and many: which of entries (places in the seeds) each has."""
    word = np.repeat(words, many)
    seed = entries[np.repeat(at, many) + np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)]
    item, doc = one.items[seed], w.doc[word]
    order = np.lexsort((word, item, doc))
    word, seed, item, doc = word[order], seed[order], item[order], doc[order]
    sizes = one.sizes
    new = np.ones(len(word), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (word[1:] - word[:-1] > sizes[item[1:]])
    edges = np.append(np.flatnonzero(new), len(word))
    best: dict[tuple[int, int], tuple] = {}
    for a, z in zip(edges[:-1], edges[1:], strict=True):
        d, i, size = int(doc[a]), int(item[a]), int(sizes[item[a]])
        seeds = len(np.unique(seed[a:z]))
        if seeds < (2 if size >= 6 else 1):
            continue
        lo, hi = max(int(w.first[d]), int(word[a]) - size), min(int(w.first[d + 1]), int(word[z - 1]) + N + size)
        if in_common(one.words[i], w.hashes[lo:hi]) < least * size:
            continue
        got, first, last = align(one.words[i], w.hashes[lo:hi])
        score = got / (2 * size)
        if score >= least and score > best.get((d, i), (0, -1.0))[1]:
            best[d, i] = (i, score, seeds, lo + first - int(w.first[d]), lo + last - 1 - int(w.first[d]))
    for (d, _), hit in best.items():
        yield d, hit


def clean(docs: DataFrame, benchmark: DataFrame, text: str = "text", repeatable: bool = False, **how) -> DataFrame:
    """The rows of docs that hold no item. repeatable: as in common.numbered."""
    rows = common.numbered(docs, "_tm_uid", repeatable)
    found = find(rows.select("_tm_uid", text), benchmark, "_tm_uid", text, **how).select("_tm_uid").distinct()
    return rows.join(found, "_tm_uid", "left_anti").drop("_tm_uid")


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find(common.read(spark, sf_dir, "documents"), common.read(spark, sf_dir, "benchmark"))
