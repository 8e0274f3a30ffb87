"""Language identification by compression: a text belongs to the language whose dictionary makes it smallest.

Each language has a raw-content dictionary for zstandard, made of pieces of its texts. A text, reduced to lower-case letters
with single spaces between its words, is cut into blocks, so that a long text can't become its own dictionary; each block is
compressed with each dictionary, and the sizes are summed. The smallest sum wins; with equal sums the language that was more
frequent in training does, then the smaller name. A decision whose runner-up is less than MARGIN larger is marked as not accepted.

Dictionaries are fitted on a bounded sample: of each of the LANGUAGES most frequent languages about ROWS different texts, chosen
by hash, and of each of these one piece of at most PIECE letters from a place chosen by hash. Copies count once. The sample is
all that reaches the driver, and the dictionaries, LANGUAGES times DICTIONARY bytes at most, are all that is broadcast.

A null text, and one without a letter, is `und` with score 0; so is every text where nothing could be learned. With one language
learned its score is 1. Texts of any length are read whole; repeated rows get equal results; an empty table gives an empty one.
Rows without a language teach nothing. Other columns stay; those named lang_pred, score or accepted are replaced.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

LANGUAGES, ROWS, PIECE, DICTIONARY = 200, 400, 300, 1 << 16
#: Bytes that are compressed at a time, and how hard.
BLOCK, LEVEL = 4096, 6
#: Share of the smallest size by which the next must be larger.
MARGIN = 0.01

#: What a hash is compared with to draw a sample.
SPAN = 1 << 50


def letters(text: str) -> Column:
    """Lower-case letters of a text, runs of other characters as one space; empty without a letter."""
    return F.trim(F.regexp_replace(F.lower(F.coalesce(F.col(text), F.lit(""))), r"[^\p{L}]+", " "))


def train(docs: DataFrame, text: str = "text", lang: str = "lang") -> list[tuple[str, bytes]]:
    """(language, dictionary), the more frequent first."""
    spark = docs.sparkSession
    rows = docs.select(F.col(lang).cast("string").alias("lang"), F.col(text).alias("text"), F.xxhash64(text).alias("h")).filter(F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}"))
    found = rows.groupBy("lang").agg(F.count("*").alias("n"), F.approx_count_distinct("h").alias("different")).orderBy(F.desc("n"), "lang").limit(LANGUAGES).collect()
    if not found:
        return []
    limits = spark.createDataFrame([(r.lang, min(SPAN, SPAN * ROWS // max(1, r.different))) for r in found], "lang string, most long")
    drawn = rows.join(F.broadcast(limits), "lang").filter(F.pmod("h", F.lit(SPAN)) < F.col("most"))  # a row a language is broadcast
    at = 1 + F.pmod(F.xxhash64("h"), F.greatest(F.length("text") - PIECE, F.lit(1))).cast("int")
    once = drawn.withColumn("text", letters("text")).withColumn("piece", F.substring("text", at, F.lit(PIECE))).groupBy("lang", "h").agg(F.min("piece").alias("piece"))
    pieces: dict[str, list[str]] = {}
    for r in sorted(once.collect(), key=lambda r: (r.lang, r.h)):
        pieces.setdefault(r.lang, []).append(r.piece)
    return [(r.lang, " ".join(pieces[r.lang]).encode()[:DICTIONARY]) for r in found if r.lang in pieces]


@lru_cache(4)
def _compressors(dictionaries: tuple[bytes, ...]) -> list[zstandard.ZstdCompressor]:
    out = []
    for raw in dictionaries:
        d = zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT)
        d.precompute_compress(level=LEVEL)
        out.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_dict_id=False))
    return out


def sizes(text: bytes, dictionaries: tuple[bytes, ...]) -> list[int]:
    """Bytes of a text compressed with each dictionary."""
    blocks = [text[at : at + BLOCK] for at in range(0, len(text), BLOCK)]
    return [sum(len(c.compress(b)) for b in blocks) for c in _compressors(dictionaries)]


def verdict(found: list[int]) -> tuple[int, float, bool]:
    """Which is smallest, the share of belief it gets (half for each byte that another is larger), and whether the next is MARGIN larger."""
    best = min(range(len(found)), key=lambda i: (found[i], i))
    share = 1 / float(np.exp2(-np.minimum(np.array(found, float) - found[best], 60)).sum())
    others = [s for i, s in enumerate(found) if i != best]
    return best, share, not others or min(others) >= found[best] * (1 + MARGIN)


def identify(docs: DataFrame, model: list[tuple[str, bytes]], text: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and accepted (whether the margin is wide enough)."""
    spark = docs.sparkSession
    common.small_batches(spark)
    names, shared = [name for name, _ in model], spark.sparkContext.broadcast(tuple(d for _, d in model))

    @F.pandas_udf("lang_pred string, score double, accepted boolean")
    def guess(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for texts in batches:
            rows = []
            for t in texts:
                if t and names:
                    best, share, wide = verdict(sizes(t.encode(), shared.value))
                    rows.append((names[best], share, wide))
                else:
                    rows.append(("und", 0.0, False))
            yield pd.DataFrame(rows, columns=["lang_pred", "score", "accepted"])

    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "score", "accepted")]
    return docs.withColumn("_tm_guess", guess(letters(text))).select(*[F.col(f"`{c}`") for c in kept], "_tm_guess.*")


def op13_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    held = common.doc_bucket("doc_id", 3) == 1
    model = train(docs.filter(~held))
    return identify(docs.select("doc_id", "text", held.alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score", "accepted")
