"""Byte-level BPE encoding in linear time, and decoding.

Bytes are mapped to Latin-1 characters, so that an Aho-Corasick automaton over the vocabulary gives the longest token at a
place. An encoding is built from the left: the longest token whose pair with the token before it is one that the merges
would keep; where none fits, the encoder steps back and takes a shorter one. Whether two tokens may stand side by side
depends on them alone and is remembered, and no place is tried twice after it has failed, so the time is linear. The
result is that of applying merges in rank order.

The new pieces of many texts go through the automaton as one string, with a character in between that no token has. Pieces
whose longest tokens all fit are done then; the others step back from the first pair that doesn't.

A null text counts as empty and gives no ids; repeated rows give repeated results; an empty table gives an empty one. Texts
are encoded whole, of any length: what is encoded at a time is bounded, by document. Other columns stay, result columns
replace those of the same name. The vocabulary's path must be readable on each executor.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable, Iterator
from functools import lru_cache
from itertools import chain

import ahocorasick
import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import common

#: Encodings of pieces that a worker remembers from now, and as many from before.
REMEMBERED = 200_000
#: Pairs of tokens of which a worker remembers whether they may stand side by side.
REMEMBERED_PAIRS = 200_000
#: Rows that are decoded at a time.
ROWS = 1000
#: Longer pieces are neither remembered nor encoded together with others.
REMEMBERED_CHARS = 40
#: Pieces that are encoded together.
TOGETHER = 20_000
#: Stands between them: no Latin-1 character.
BETWEEN = "\u0100"

# White space as the splitting pattern has it (Unicode White_Space).
WHITE = r"\t-\r \x85\xa0  -     　"


class Vocabulary:
    """Tokens by rank, and which pairs of them the merges leave side by side."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}
        self.bytes = [b""] * (max(self.rank.values()) + 1)
        for token, r in self.rank.items():
            self.bytes[r] = token
        self.most = max(map(len, self.rank))
        self.trie = ahocorasick.Automaton()
        for token, r in self.rank.items():
            self.trie.add_word(token.decode("latin-1"), r)
        self.trie.make_automaton()
        self.sizes = np.array([*map(len, self.bytes)], np.int64)
        self.pairs: dict[tuple[int, int], int] = {}  # what a pair merges into
        self.halves: dict[int, tuple[int, int] | None] = {}
        self.fits: dict[int, bool] = {}
        self.shorter = [self._prefix(t) for t in self.bytes]
        self.begun: dict[str, int] = {}  # the longest token that each beginning of a token begins with
        for token in self.rank:
            for n in range(1, len(token) + 1):
                text = token[:n].decode("latin-1")
                if text not in self.begun:
                    self.begun[text] = self.rank.get(token[:n], self.begun.get(text[:-1], -1))
        for r in sorted(self.rank.values()):
            self._split(r)

    def _prefix(self, token: bytes) -> int:
        """The longest token that begins this one and isn't all of it."""
        for n in range(len(token) - 1, 0, -1):
            if (r := self.rank.get(token[:n])) is not None:
                return r
        return -1

    def _split(self, r: int) -> None:
        """The two tokens whose merge makes this one: of all cuts, the one where the parts stay apart until then."""
        token, left = self.bytes[r], self.shorter[r]
        self.halves[r] = None
        while left >= 0:
            right = self.rank.get(token[len(self.bytes[left]) :])
            if right is not None and left < r and right < r and self._stay(left, right):
                self.halves[r] = (left, right)
                self.pairs[left, right] = r
                return
            left = self.shorter[left]

    def _stay(self, left: int, right: int) -> bool:
        """Whether no merge crosses the border of two tokens, when the text is just these two.

        The merges that make the two tokens are undone from the last to the first. At each point the pieces that touch
        the border could merge with each other; that happens if their pair ranks before what was undone so far.
        """
        before = 1 << 62
        while True:
            joined = self.pairs.get((left, right))
            if joined is not None and joined < before:
                return False
            a, b = self.halves.get(left), self.halves.get(right)
            if a is None and b is None:
                return True
            if b is None or a is not None and left > right:  # the later merge is undone first
                before, left = left, a[1]
            else:
                before, right = right + 1, b[0]

    def apart(self, pair: int) -> bool:
        """Whether two tokens may stand side by side; pair: the left one in the upper 32 bits, the right one in the lower."""
        known = self.fits.get(pair)
        if known is None:
            if len(self.fits) > REMEMBERED_PAIRS:
                self.fits.clear()
            known = self.fits[pair] = self._stay(pair >> 32, pair & 0xFFFFFFFF)
        return known

    def longest(self, text: str, at: int) -> int:
        """The longest token that starts at a place. The trie tells how far the text goes along with any token."""
        along = text[at : at + self.most]
        token = self.begun.get(along[: self.trie.longest_prefix(along)], -1)
        if token < 0:
            raise ValueError(f"no token for byte {ord(text[at])}")
        return token

    def encode(self, piece: bytes, found: Iterable[int] = ()) -> list[int]:
        """The ids of one piece that the splitting pattern matched; found: its first tokens, each the longest that fits."""
        if (whole := self.rank.get(piece)) is not None:
            return [whole]
        text, n, found = piece.decode("latin-1"), len(piece), list(found)
        failed, size, fits = bytearray(n + 1), self.bytes, self.fits
        at = sum(len(size[t]) for t in found)
        token = self.longest(text, at)
        while at < n:
            end = at + len(size[token])
            if not failed[end]:
                pair = found[-1] << 32 | token if found else -1
                if pair < 0 or (fits[pair] if pair in fits else self.apart(pair)):
                    found.append(token)
                    at = end
                    if at < n:
                        token = self.longest(text, at)
                    continue
            token = self.shorter[token]
            while token < 0:  # nothing fits here: take the last token back and try a shorter one
                failed[at] = 1
                last = found.pop()
                at -= len(size[last])
                token = self.shorter[last]
        return found

    def encode_all(self, pieces: list[bytes]) -> list[bytes]:
        """The ids of many short pieces, each as little-endian unsigned 32-bit integers."""
        matched = self.trie.iter_long(BETWEEN.join([p.decode("latin-1") for p in pieces]))
        last, ids = np.fromiter(chain.from_iterable(matched), np.int64).reshape(-1, 2).T
        sizes = np.array([*map(len, pieces)], np.int64)
        borders = np.cumsum(sizes + 1) - 1
        piece = np.searchsorted(borders, last)
        first = np.searchsorted(piece, np.arange(len(pieces) + 1))
        pairs, place = np.unique((ids[:-1] << 32 | ids[1:])[inner := np.flatnonzero(piece[:-1] == piece[1:])], return_inverse=True)
        bad = inner[~np.fromiter(map(self.apart, pairs.tolist()), bool, len(pairs))[place]]
        raw, at = ids.astype("<u4").tobytes(), first.tolist()
        out = [raw[4 * a : 4 * z] for a, z in zip(at[:-1], at[1:], strict=True)]
        again = dict(zip(piece[bad[::-1]].tolist(), bad[::-1].tolist(), strict=True))  # the first bad pair of each piece
        again |= dict.fromkeys(np.flatnonzero(np.bincount(piece, self.sizes[ids], len(pieces)) != sizes).tolist(), -1)  # some byte has no token
        for i, b in again.items():
            out[i] = np.array(self.encode(pieces[i], ids[at[i] : b + 1].tolist() if b >= 0 else ()), "<u4").tobytes()
        return out


class Encoder:
    """Encodes texts, remembering the pieces that the pattern matched."""

    def __init__(self, path: str, pattern: str):
        self.vocabulary = Vocabulary(path)
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\S", f"[^{WHITE}]").replace(r"\s", f"[{WHITE}]")).findall
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """The ids of pieces that aren't known. Short ones are known from now on."""
        told = {p: self.older[p] for p in pieces & self.older.keys()} if self.older else {}
        new = list(pieces - told.keys())
        short = [p for p in new if len(p) <= REMEMBERED_CHARS]
        for lo in range(0, len(short), TOGETHER):
            some = short[lo : lo + TOGETHER]
            told.update(zip(some, self.vocabulary.encode_all([p.encode() for p in some]), strict=True))
        if len(self.known) > REMEMBERED:
            self.older, self.known = self.known, {}
        self.known.update(told)
        return told | {p: np.array(self.vocabulary.encode(p.encode()), "<u4").tobytes() for p in new if len(p) > REMEMBERED_CHARS}

    def __call__(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as little-endian unsigned 32-bit integers."""
        return common.remembered([self.split(t) for t in texts], self.known, self._learn)


@lru_cache(2)
def encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def _with(batch: pa.RecordBatch, column: str, values: list, kind: pa.DataType) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([*batch.columns, pa.array(values, kind)], [*batch.schema.names, column])


def _texts(batches: Iterator[pa.RecordBatch], column: str) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Rows of bounded size, one at least, and their texts."""
    for b in batches:
        for lo, hi, data, offsets in common.text_chunks(b.column(b.schema.names.index(column))):
            raw = data.tobytes()
            yield b.slice(lo, hi - lo), [raw[x:y].decode("utf-8", "replace") for x, y in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]


def encode(docs: DataFrame, path: str, pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = None) -> DataFrame:
    """docs with the ids of each text, in one binary value as little-endian unsigned 32-bit integers.

    With ``decoded``, also the bytes that decoding the ids gives, in the same pass: one Python worker a task, not two.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        one = encoder(path, pattern)
        for batch, texts in _texts(batches, text):
            found = one(texts)
            out = _with(batch, ids, found, pa.binary())
            yield out if decoded is None else _with(out, decoded, [decode_ids(x, one.vocabulary.bytes) for x in found], pa.binary())

    common.small_batches(docs.sparkSession)
    new = {ids: "binary"} | ({decoded: "binary"} if decoded else {})
    kept = docs.drop(*new)
    return kept.mapInArrow(run, common.plus(kept, **new))


def decode_ids(ids: bytes, tokens: list[bytes]) -> bytes:
    return b"".join(map(tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def decode(docs: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """docs with the bytes that the ids of each row stand for."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        token = _tokens(path)
        for batch in (b.slice(lo, ROWS) for b in batches for lo in range(0, b.num_rows, ROWS)):
            values = batch.column(batch.schema.names.index(ids))
            yield _with(batch, decoded, [decode_ids(v.as_py() or b"", token) for v in values], pa.binary())

    kept = docs.drop(decoded)
    return kept.mapInArrow(run, common.plus(kept, **{decoded: "binary"}))


@lru_cache(2)
def _tokens(path: str) -> list[bytes]:
    with open(path, "rb") as f:
        rank = {int(b): base64.b64decode(a) for a, b in map(bytes.split, filter(None, f.read().splitlines()))}
    return [rank.get(i, b"") for i in range(max(rank) + 1)]


def digest(docs: DataFrame, vocabulary: str = "byte_bpe_50k.tiktoken") -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of each document; what is decoded comes from the ids."""
    import public_tokenizers as public

    ids = encode(docs.select("doc_id", "text"), public.path(vocabulary), public.PATTERN, decoded="decoded")
    return ids.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(common.read(spark, sf_dir, "documents"))
