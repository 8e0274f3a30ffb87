"""Quality classifier: support vectors on naive Bayes features.

A text's features are indicators of the word 1- and 2-grams in it (lower case) and of 1- to 3-grams of word shapes (case,
digits, symbols, length, and whether a word repeats the one before it), hashed to 2**BITS columns. Each indicator is
scaled by the log ratio of the column's smoothed class frequencies; rows are scaled to unit length. On these a linear
model with hinge loss is fitted by dual coordinate descent, and a logistic curve, fitted on rows that the model hasn't
seen, turns margins into scores.

The model is fitted on a bounded sample of labelled documents (at most ``most`` different ones, taken evenly by a hash of the
id), in the driver; scoring covers every row, looks at whole texts only, and shuffles nothing. A null text counts as empty; an
empty text has no features and gets the curve's value at the intercept. Labels that are null or of no document are left out; of
several for one id the highest counts; a document that is repeated with its id counts once. With fewer than two classes among the labels
every score is the share of good labels, or 0.5 without labels. An empty table gives an empty one. Columns of the input stay;
result columns replace those of the same name.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common
from .common import U64, Words, mix

BITS = 18
#: Bound of the labelled sample that the model is fitted on.
SAMPLE = 8_000
GOOD = 0.7

_KIND = np.zeros((5, 256), np.int32)  # lower, upper, digit, other ASCII, the rest
_KIND[0, 97:123] = _KIND[1, 65:91] = _KIND[2, 48:58] = 1
_KIND[4, 128:] = 1
_KIND[3] = 1 - _KIND[0] - _KIND[1] - _KIND[2] - _KIND[4]


def shapes(w: Words) -> np.ndarray:
    """A number for each word's shape."""
    code = np.zeros(len(w.starts), np.int64)
    for kind in _KIND:
        total = np.concatenate([[0], np.cumsum(kind[w.data], dtype=np.int64)])
        code = code * 3 + np.minimum(total[w.ends] - total[w.starts], 2)
    first = w.data[w.starts] if len(w.starts) else np.zeros(0, np.uint8)
    code = code * 2 + ((first >= 65) & (first < 91))
    code = code * 4 + np.digitize(w.ends - w.starts, [3, 8, 16])
    again = np.zeros(len(code), bool)
    again[1:] = (w.hashes[1:] == w.hashes[:-1]) & (w.doc[1:] == w.doc[:-1])
    return code * 2 + again


def features(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Pieces of the column: the first row, and for each distinct (row, column of the model) both, rows from 0."""
    mask = (1 << BITS) - 1
    for lo, _, data, offsets in common.text_chunks(column):
        plain = common.words(data, offsets)
        shape = mix(shapes(plain).astype(U64) + U64(1))
        w = common.words(data, offsets, lower=True)
        doc, found = w.doc, []
        for values, n, salt in ((w.hashes, 1, 1), (w.hashes, 2, 2), (shape, 1, 3), (shape, 2, 4), (shape, 3, 5)):
            starts, h = w.grams(n, values)
            found.append((doc[starts] << BITS) | (mix(h + U64(salt)).astype(np.int64) & mask))
        keys = np.unique(np.concatenate(found))
        yield lo, keys >> BITS, keys & mask


@dataclass
class Model:
    weights: np.ndarray  # of each column, its ratio included
    ratios: np.ndarray
    intercept: float
    slope: float
    shift: float

    def scores(self, rows: np.ndarray, columns: np.ndarray, n: int) -> np.ndarray:
        norm = np.sqrt(np.bincount(rows, self.ratios[columns] ** 2, n))
        margin = np.bincount(rows, self.weights[columns], n) / np.maximum(norm, 1e-12) + self.intercept
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -50, 50)))


def fit(rows: list[np.ndarray], labels: np.ndarray, cost: float = 1.0, epochs: int = 12, seed: int = 7) -> Model:
    """rows: the columns of each document; labels: 0 or 1."""
    n, width = len(rows), 1 << BITS
    if n == 0 or labels.min() == labels.max():
        share = float(labels.mean()) if n else 0.5
        return Model(np.zeros(width, np.float32), np.zeros(width, np.float32), 0.0, 0.0, float(np.log((share + 1e-9) / (1 - share + 1e-9))))
    order = np.random.default_rng(seed).permutation(n)
    kept = order[n // 4 :] if n >= 40 else order
    counts = [np.ones(width), np.ones(width)]
    for i in kept:
        counts[labels[i]][rows[i]] += 1
    size = np.bincount(labels[kept], minlength=2)
    ratios = np.log((counts[1] / (size[1] + 2)) / (counts[0] / (size[0] + 2)))
    norm = np.array([max(1e-12, np.sqrt((ratios[r] ** 2).sum())) for r in rows])
    w, bias, alpha = np.zeros(width), 0.0, np.zeros(n)
    most = cost * len(kept) / (2 * np.maximum(size, 1))
    sign = labels * 2 - 1
    turns = np.random.default_rng(seed + 1)
    for _ in range(epochs):
        moved = 0.0
        for i in turns.permutation(kept):
            at, v, y = rows[i], ratios[rows[i]], sign[i]
            slope = y * (w[at] @ v / norm[i] + bias) - 1
            new = min(max(alpha[i] - slope / 2, 0.0), most[labels[i]])  # a row and the constant have length 1 each
            if new != alpha[i]:
                step = (new - alpha[i]) * y
                w[at] += step / norm[i] * v
                bias += step
                moved = max(moved, abs(step))
                alpha[i] = new
        if moved < 1e-3:
            break
    margins = np.array([w[rows[i]] @ ratios[rows[i]] / norm[i] + bias for i in order])
    unseen = margins[: n // 4], labels[order[: n // 4]]
    slope, shift = curve(*(unseen if n >= 40 and len(set(unseen[1])) == 2 else (margins, labels[order])))
    return Model((w * ratios).astype(np.float32), ratios.astype(np.float32), float(bias), slope, shift)


def curve(margins: np.ndarray, labels: np.ndarray) -> tuple[float, float]:
    """Slope and shift of the logistic curve that fits best, with softened targets."""
    n1, n0 = labels.sum(), (1 - labels).sum()
    target = np.where(labels == 1, (n1 + 1) / (n1 + 2), 1 / (n0 + 2))
    a, b = 1.0, 0.0
    for _ in range(60):
        p = 1 / (1 + np.exp(-np.clip(a * margins + b, -50, 50)))
        d, v = target - p, p * (1 - p) + 1e-9
        h = np.array([[(v * margins**2).sum() + 1e-6, (v * margins).sum()], [(v * margins).sum(), v.sum() + 1e-6]])
        step = np.linalg.solve(h, [(d * margins).sum(), d.sum()])
        a, b = a + np.clip(step[0], -5, 5), b + np.clip(step[1], -5, 5)
    return float(a), float(b)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", key: str = "doc_id", text: str = "text", most: int = SAMPLE) -> Model:
    one = labels.filter(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("_tm_key")).agg(F.max(label).alias("_tm_label"))
    texts = docs.select(F.col(key).alias("_tm_key"), F.xxhash64(text).alias("_tm_digest"), F.col(text).alias("text"))
    some = texts.select("_tm_key", "_tm_digest").distinct().join(one, "_tm_key").orderBy(F.xxhash64("_tm_key"), "_tm_key", "_tm_digest").limit(most)
    taken = texts.join(F.broadcast(some), ["_tm_key", "_tm_digest"])  # at most `most` rows are broadcast
    once = taken.groupBy("_tm_key", "_tm_digest").agg(F.first("text").alias("text"), F.first("_tm_label").alias("_tm_label"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            t, marks, order = (b.column(i) for i in range(3))
            for lo, rows, columns in features(t):
                ends = np.searchsorted(rows, np.arange(int(rows.max(initial=-1)) + 2))
                cut = [columns[s:e].astype("<i4").tobytes() for s, e in zip(ends[:-1], ends[1:], strict=True)]
                yield pa.RecordBatch.from_arrays([order.slice(lo, len(cut)), marks.slice(lo, len(cut)).cast(pa.int32()), pa.array(cut, pa.binary())], ["order", "label", "columns"])

    found = once.select("text", "_tm_label", F.xxhash64("_tm_key", "_tm_digest").alias("order")).mapInArrow(run, "order long, label int, columns binary").toArrow()
    order = np.argsort(found["order"].to_numpy(), kind="stable")
    columns = [np.frombuffer(x.as_buffer(), "<i4") for x in found["columns"]]
    return fit([columns[i] for i in order], (found["label"].to_numpy() > 0).astype(np.int64)[order])


def score(docs: DataFrame, model: Model, text: str = "text", column: str = "score") -> DataFrame:
    """docs with the score of each text."""
    common.small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # 2 * 2**BITS numbers of 4 bytes, at any size of input

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = np.zeros(b.num_rows)
            t = b.column(b.schema.names.index(text))
            spans = list(_with_ends(features(t), b.num_rows))
            for lo, hi, rows, columns in spans:
                out[lo:hi] = shared.value.scores(rows, columns, hi - lo)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(out)], [*b.schema.names, column])

    kept = docs.drop(column)
    return kept.mapInArrow(run, common.plus(kept, **{column: "double"}))


def _with_ends(pieces: Iterator[tuple[int, np.ndarray, np.ndarray]], n: int) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    last = None
    for piece in pieces:
        if last:
            yield last[0], piece[0], *last[1:]
        last = piece
    if last:
        yield last[0], n, *last[1:]


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs with held_out, score and predicted; learns from the labels of rows that aren't held out."""
    held = common.doc_bucket("doc_id", 4) == 2
    model = train(docs.filter(~held), labels.filter(~held))
    return score(docs.drop("held_out", "predicted"), model).withColumn("held_out", held).withColumn("predicted", F.when(F.col("score") >= GOOD, 1).otherwise(0))


def op2_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents").select("doc_id", "text")
    return classify(docs, common.read(spark, sf_dir, "labels")).select("doc_id", "held_out", "score", "predicted")
