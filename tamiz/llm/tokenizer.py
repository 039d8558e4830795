"""Encoding of a corpus with a public byte-level BPE vocabulary, in two tiers.

A text is cut into pre-tokens by the vocabulary's pattern.  Tier one looks the distinct pre-tokens
of a batch up in a minimal perfect hash of the vocabulary (one slot a token, no empty slot; the
stored bytes are compared, so a foreign string is a miss and never a wrong id).  Tier two merges the
bytes of the misses: a heap of candidate merges over a linked list of parts, lowest rank first and
leftmost among equals.

Null and empty texts give an empty list.  Texts that look like special tokens are ordinary text.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: where the vocabulary files are; every function takes another folder or file
FOLDER = "/opt/tokenizers"
BYTE_BPE_50K = f"{FOLDER}/byte_bpe_50k.tiktoken"
#: fixed value: the pattern that cuts text before the merges of this vocabulary
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: merged misses that a worker keeps
CACHE = 200_000


def _words(tokens: list[bytes], width: int) -> tuple[np.ndarray, np.ndarray]:
    """The tokens as rows of 64-bit words, and their lengths."""
    size = np.fromiter(map(len, tokens), np.int64, len(tokens))
    return np.array(tokens, f"S{8 * width}").view(np.uint64).reshape(len(tokens), width), size


def _hash(words: np.ndarray, size: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = size.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
        for i in range(words.shape[1]):
            h ^= words[:, i]
            h *= np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(29)
        h *= np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(32))


def _displaced(h: np.ndarray, shift: np.ndarray, n: int) -> np.ndarray:
    """The slots of hashes at a displacement."""
    with np.errstate(over="ignore"):
        x = (h >> np.uint64(7)) + shift.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93)
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return ((x ^ (x >> np.uint64(32))) % np.uint64(n)).astype(np.int64)


class PerfectHash:
    """Minimal perfect hash of byte strings by hash and displace; ``find`` gives a value or -1."""

    def __init__(self, tokens: list[bytes], values: np.ndarray):
        n = len(tokens)
        self.width = -(-max(map(len, tokens)) // 8)
        words, size = _words(tokens, self.width)
        h = _hash(words, size)
        if len(np.unique(h)) != n:
            raise ValueError("two tokens of one 64-bit hash")
        self.buckets = max(1, n // 4)
        bucket = (h % np.uint64(self.buckets)).astype(np.int64)
        self.shift = np.zeros(self.buckets, np.int64)
        slot, free = np.empty(n, np.int64), np.ones(n, bool)
        order = np.argsort(bucket, kind="stable")
        begin = np.searchsorted(bucket[order], np.arange(self.buckets + 1))
        sizes = np.diff(begin)
        tries = np.arange(512)
        for k in np.argsort(-sizes, kind="stable"):
            rows = order[begin[k] : begin[k + 1]]
            if len(rows) < 2:
                break
            base = 0
            while True:
                at = _displaced(h[rows][None, :], (tries + base)[:, None], n)
                fine = free[at].all(1)
                s = np.sort(at, 1)
                fine &= (s[:, 1:] != s[:, :-1]).all(1)
                if fine.any():
                    t = int(fine.argmax())
                    self.shift[k], slot[rows] = base + t, at[t]
                    free[at[t]] = False
                    break
                base += len(tries)
        left = np.flatnonzero(free)
        single = np.flatnonzero(sizes == 1)
        rows = order[begin[single]]
        slot[rows] = left[: len(single)]
        self.shift[single] = -left[: len(single)] - 1  # a lone token's slot is stored outright
        self.words, self.size, self.value = np.empty_like(words), np.empty(n, np.int64), np.empty(n, np.int32)
        self.words[slot], self.size[slot], self.value[slot] = words, size, values

    def find(self, tokens: list[bytes]) -> np.ndarray:
        out = np.full(len(tokens), -1, np.int32)
        short = [i for i, t in enumerate(tokens) if len(t) <= 8 * self.width]
        if not short:
            return out
        n = len(self.value)
        words, size = _words([tokens[i] for i in short], self.width)
        h = _hash(words, size)
        shift = self.shift[(h % np.uint64(self.buckets)).astype(np.int64)]
        slot = np.where(shift < 0, -shift - 1, _displaced(h, shift, n))
        same = (self.size[slot] == size) & (self.words[slot] == words).all(1)
        out[np.array(short)] = np.where(same, self.value[slot], -1)
        return out


class Vocabulary:
    def __init__(self, raw: bytes):
        pairs = [line.split() for line in raw.splitlines() if line]
        self.rank = {base64.b64decode(t): int(r) for t, r in pairs}
        self.hash = PerfectHash(list(self.rank), np.fromiter(self.rank.values(), np.int32, len(self.rank)))
        self.cache: dict[bytes, list[int]] = {}

    def merged(self, piece: bytes) -> list[int]:
        """Token ids of the bytes: the lowest-ranked neighbouring pair is merged until none is left."""
        rank, n = self.rank, len(piece)
        end = list(range(1, n + 1))  # end[i]: where the part that begins at i ends; 0 once it is swallowed
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 1, i + 2) for i in range(n - 1) if (r := rank.get(piece[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if end[a] != b or b >= n or end[b] != c:
                continue
            end[a], end[b] = c, 0
            if c < n:
                before[c] = a
                if (r := rank.get(piece[a : end[c]])) is not None:
                    heapq.heappush(heap, (r, a, c, end[c]))
            p = before[a]
            if p >= 0 and (r := rank.get(piece[p:c])) is not None:
                heapq.heappush(heap, (r, p, a, c))
        out, i = [], 0
        while i < n:
            out.append(rank[piece[i : end[i]]])
            i = end[i]
        return out

    def misses(self, piece: bytes) -> list[int]:
        got = self.cache.get(piece)
        if got is None:
            got = self.merged(piece)
            if len(self.cache) < CACHE and len(piece) <= 64:
                self.cache[piece] = got
        return got

    def encode(self, texts: pa.Array) -> pa.ListArray:
        """int32 lists, one for each text."""
        import regex

        cut = _pattern(regex).findall
        pieces: list[str] = []
        ends = np.zeros(len(texts) + 1, np.int64)
        for i, t in enumerate(texts.to_pylist()):
            if t:
                pieces += cut(t)
            ends[i + 1] = len(pieces)
        if not pieces:
            return pa.ListArray.from_arrays(pa.array(np.zeros(len(texts) + 1, np.int32)), pa.array([], pa.int32()))
        coded = pa.array(pieces, pa.large_string()).dictionary_encode()
        codes = coded.indices.to_numpy()
        distinct = [p.encode("utf-8", "surrogatepass") for p in coded.dictionary.to_pylist()]
        ids = self.hash.find(distinct)
        size = np.ones(len(distinct), np.int64)
        more: dict[int, list[int]] = {}
        for i in np.flatnonzero(ids < 0):
            more[int(i)] = self.misses(distinct[i])
            size[i] = len(more[int(i)])
        begin = np.r_[0, np.cumsum(size)]
        flat = np.empty(begin[-1], np.int32)
        flat[begin[:-1]] = ids
        for i, v in more.items():
            flat[begin[i] : begin[i + 1]] = v
        n = size[codes]
        out_end = np.r_[0, np.cumsum(n)]
        at = np.arange(out_end[-1]) + np.repeat(begin[codes] - out_end[:-1], n)
        return pa.ListArray.from_arrays(pa.array(out_end[ends].astype(np.int32)), pa.array(flat[at]))


@lru_cache(maxsize=2)
def _pattern(regex):
    return regex.compile(PATTERN)


@lru_cache(maxsize=2)
def vocabulary(raw: bytes) -> Vocabulary:
    return Vocabulary(raw)


def encoder(path: str = BYTE_BPE_50K, counts: bool = False):
    """An Arrow UDF from text to ``array<int>`` (or to the number of tokens); the file is read on the driver and sent along."""
    with open(path, "rb") as f:
        raw = f.read()

    def ids(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        v = vocabulary(raw)
        for texts in batches:
            for got in [v.encode(texts)]:
                yield got.value_lengths().cast(pa.int64()) if counts else got

    ids.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf("bigint" if counts else "array<int>")(ids)


def encoded(docs: DataFrame, text: str = "text", name: str = "ids", path: str = BYTE_BPE_50K) -> DataFrame:
    """``docs`` with the token ids of ``text``; a column of that name raises ``ValueError``."""
    if name in docs.columns:
        raise ValueError(f"{name!r} is a column of the table")
    return docs.withColumn(name, encoder(path)(F.col(text)))


def token_count(text: Column, path: str = BYTE_BPE_50K) -> Column:
    return encoder(path, counts=True)(text)
