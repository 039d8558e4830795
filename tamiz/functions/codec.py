"""Codecs of posting lists: variable bytes, Elias gamma, and lists of both; numpy in Arrow batches."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPAN = 65536


def _bit_lengths(v: np.ndarray) -> np.ndarray:
    """Bits of each number, 0 of 0."""
    n = np.zeros(len(v), np.int64)
    x = v.astype(np.uint64)
    for k in (32, 16, 8, 4, 2, 1):
        big = x >= np.uint64(1) << np.uint64(k)
        n[big] += k
        x = np.where(big, x >> np.uint64(k), x)
    return n + (x > 0)


def vbyte_sizes(values: np.ndarray) -> np.ndarray:
    return np.maximum((_bit_lengths(values) + 6) // 7, 1)


def vbyte_encode(values: np.ndarray) -> bytes:
    """Seven bits a byte, most significant group first, the last byte of a number with its high bit set."""
    v = np.asarray(values, np.uint64)
    n = vbyte_sizes(v)
    left = np.repeat(np.cumsum(n), n) - np.arange(n.sum()) - 1
    out = ((np.repeat(v, n) >> (np.uint64(7) * left.astype(np.uint64))) & np.uint64(127)).astype(np.uint8)
    out[left == 0] |= 128
    return out.tobytes()


def vbyte_decode(data: bytes) -> np.ndarray:
    b = np.frombuffer(data, np.uint8)
    ends = np.flatnonzero(b & 128)
    if not len(ends):
        if len(b):
            raise ValueError("the last number has no end")
        return np.empty(0, np.int64)
    if ends[-1] != len(b) - 1:
        raise ValueError("the last number has no end")
    n = np.diff(np.r_[-1, ends])
    left = np.repeat(ends, n) - np.arange(len(b))
    return np.add.reduceat((b & 127).astype(np.int64) << (7 * left), np.r_[0, ends[:-1] + 1])


def _bits(values: np.ndarray) -> np.ndarray:
    """Gamma code of numbers from 1, as an array of bits."""
    v = np.asarray(values, np.int64)
    if len(v) and v.min() < 1:
        raise ValueError("gamma codes begin at 1")
    k = _bit_lengths(v)
    n = 2 * k - 1
    left = np.repeat(np.cumsum(n), n) - np.arange(n.sum()) - 1
    return ((np.repeat(v, n) >> np.minimum(left, 62)) & 1).astype(np.uint8) * (left < np.repeat(k, n))


def gamma_encode(values: np.ndarray) -> bytes:
    """k zeros and k + 1 bits a number, zeros at the end to the next byte."""
    return np.packbits(_bits(values)).tobytes()


def _jumps(step: np.ndarray, start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """For each start the first ``count`` positions of the chain start, step[start], ..., end to end.

    Chains are followed by doubling: after i rounds a jump spans 2 ** i steps, so a chain of n takes log n rounds.
    """
    most = int(count.max(initial=0))
    if not most:
        return np.empty(0, np.int64)
    at = np.empty((len(start), most), np.int64)
    at[:, 0] = start
    have, jump = 1, step
    while have < most:
        more = min(have, most - have)
        at[:, have : have + more] = jump[at[:, :more]]
        have += more
        jump = jump[jump]
    return at[np.arange(most)[None, :] < count[:, None]]


def _numbers(bits: np.ndarray, begin: np.ndarray, width: np.ndarray) -> np.ndarray:
    """The numbers of ``width`` bits that begin at the positions ``begin``."""
    if not len(begin):
        return np.empty(0, np.int64)
    left = np.repeat(np.cumsum(width), width) - np.arange(width.sum()) - 1
    at = np.repeat(begin + width, width) - left - 1
    return np.add.reduceat(bits[at].astype(np.int64) << left, np.r_[0, np.cumsum(width)[:-1]])


def _next_one(bits: np.ndarray) -> np.ndarray:
    """For each position that of the next set bit, itself included; the length where there is none."""
    n = len(bits)
    return np.minimum.accumulate(np.where(bits[::-1] > 0, np.arange(n)[::-1], n))[::-1] if n else np.empty(0, np.int64)


def _gamma_rows(data: np.ndarray, begin: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The gamma numbers of many streams: stream i begins at byte begin[i] of ``data`` and holds count[i]."""
    bits = np.unpackbits(data)
    n = len(bits)
    one = _next_one(bits)
    # a number's code ends where its ones begin, as far on again, and one more; n stands for nowhere
    step = np.append(np.where(one < n, np.minimum(2 * one - np.arange(n) + 1, n), n), n)
    at = _jumps(step, begin * 8, count)
    if len(at) and (at.max() >= n or (one[at] >= n).any() or (2 * one[at] - at + 1 > n).any()):
        raise EOFError("the bits end inside a number")
    return _numbers(bits, one[at] if len(at) else at, (one[at] - at + 1) if len(at) else at)


def gamma_decode(data: bytes, count: int) -> np.ndarray:
    return _gamma_rows(np.frombuffer(data, np.uint8), np.zeros(1, np.int64), np.array([count]))


def hybrid_encode(gaps: np.ndarray, freqs: np.ndarray) -> bytes:
    """One stream of bits: the variable bytes of a gap, then the gamma code of its frequency, not aligned."""
    g, f = np.asarray(gaps, np.int64), np.asarray(freqs, np.int64)
    if not len(g):
        return b""
    left, right = np.unpackbits(np.frombuffer(vbyte_encode(g), np.uint8)), _bits(f)
    n, m = 8 * vbyte_sizes(g), 2 * _bit_lengths(f) - 1
    end = np.cumsum(n + m)
    out = np.empty(int(end[-1]), np.uint8)
    mine = np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(end - m - n, n)
    out[mine] = left
    out[np.arange(len(right)) - np.repeat(np.cumsum(m) - m, m) + np.repeat(end - m, m)] = right
    return np.packbits(out).tobytes()


def hybrid_decode(data: bytes, count: int) -> tuple[np.ndarray, np.ndarray]:
    bits = np.unpackbits(np.frombuffer(data, np.uint8))
    n = len(bits)
    one = _next_one(bits)
    # the byte of a gap that is marked as its last one, from each position in steps of a byte
    last = np.full(n + 8, n, np.int64)
    for phase in range(8):
        own = np.arange(phase, n, 8)
        marks = np.where(bits[own] > 0, own, n)
        last[own] = np.minimum.accumulate(marks[::-1])[::-1]
    after = np.minimum(last[:n] + 8, n)  # where the gamma code begins
    first = np.append(one, n)[after]
    step = np.append(np.where(first < n, np.minimum(2 * first - after + 1, n), n), n)
    at = _jumps(step, np.zeros(1, np.int64), np.array([count]))
    if len(at) and (at.max() >= n or (first[at] >= n).any()):
        raise EOFError("the bits end inside a number")
    freqs = _numbers(bits, first[at], first[at] - after[at] + 1) if len(at) else at
    size = (after[at] - at) // 8 if len(at) else at
    row = np.repeat(np.arange(len(at)), size)
    byte = np.arange(len(row)) - np.repeat(np.cumsum(size) - size, size)
    start = (at[row] + 8 * byte)[:, None] + np.arange(1, 8)[None, :]
    seven = (bits[start].astype(np.int64) << np.arange(6, -1, -1)[None, :]).sum(1) if len(row) else row
    gaps = np.zeros(len(at), np.int64)
    np.add.at(gaps, row, seven << (7 * (size[row] - 1 - byte)))
    return gaps, freqs


def blocks(posts: DataFrame) -> DataFrame:
    """(term, block, docs, tfs): lists in blocks of SPAN document ids, sorted; a block holds at most SPAN postings, however long its list."""
    pairs = F.array_sort(F.collect_list(F.struct("doc_id", "tf")))
    b = posts.groupBy("term", F.floor(F.col("doc_id") / SPAN).alias("block")).agg(pairs.alias("p"))
    return b.select("term", "block", F.col("p.doc_id").alias("docs"), F.col("p.tf").alias("tfs"))


def _lists(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All values of a list column end to end, and the length of each list."""
    return a.flatten().to_numpy(zero_copy_only=False).astype(np.int64), a.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)


def _binaries(data: bytes, size: np.ndarray) -> pa.Array:
    return pa.Array.from_buffers(pa.large_binary(), len(size), [None, pa.py_buffer(np.r_[0, np.cumsum(size)].astype(np.int64).tobytes()), pa.py_buffer(data)]).cast(pa.binary())


def _sums(values: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Sums of stretches of n values; empty ones give 0."""
    return np.diff(np.r_[0, np.cumsum(values)][np.r_[0, np.cumsum(n)]])


def encoder(gapped: bool = True) -> Column:
    """All lists of a batch are coded at once."""

    def run(docs: pa.Array, tfs: pa.Array) -> pa.Array:
        d, n = _lists(docs)
        f, _ = _lists(tfs)
        if gapped and len(d):
            head = (np.cumsum(n) - n)[n > 0]
            g = np.diff(d, prepend=0)
            g[head] = d[head]
            d = g
        ids = _binaries(vbyte_encode(d), _sums(vbyte_sizes(d), n))
        # every list's bits are filled up to whole bytes
        bits, size = _bits(f), _sums(2 * _bit_lengths(f) - 1, n)
        full = -(-size // 8)
        out = np.zeros(int(full.sum()) * 8, np.uint8)
        out[np.arange(len(bits)) + np.repeat((np.cumsum(full) - full) * 8 - (np.cumsum(size) - size), size)] = bits
        return pa.StructArray.from_arrays([ids, _binaries(np.packbits(out).tobytes(), full)], ["ids", "freqs"])

    run.__annotations__ = {"docs": pa.Array, "tfs": pa.Array, "return": pa.Array}
    return F.arrow_udf("ids binary, freqs binary")(run)


def compressed(posts: DataFrame, gapped: bool = True) -> DataFrame:
    """(term, block, n, ids, freqs): split codec of every block."""
    b = blocks(posts).withColumn("c", encoder(gapped)("docs", "tfs"))
    return b.select("term", "block", F.size("docs").alias("n"), "c.ids", "c.freqs")


def _flat(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a binary column end to end, and where each value begins."""
    size = pc.binary_length(a).to_numpy(zero_copy_only=False).astype(np.int64)
    return np.frombuffer(b"".join(a.to_pylist()), np.uint8), np.cumsum(size) - size


def decompressed(lists: DataFrame, gapped: bool = True) -> DataFrame:
    """(term, doc_id, tf) again; all lists of a batch are decoded at once."""

    def run(ids: pa.Array, freqs: pa.Array, n: pa.Array) -> pa.Array:
        k = n.to_numpy(zero_copy_only=False).astype(np.int64)
        d = vbyte_decode(_flat(ids)[0].tobytes())
        if gapped and len(d):
            total = np.cumsum(d)
            d = total - np.repeat(np.r_[0, total][np.cumsum(k) - k], k)
        # long lists by themselves: chains of one length are followed together
        data, begin = _flat(freqs)
        f = np.empty(len(d), np.int64)
        ends = np.cumsum(k)
        size = np.ceil(np.log2(np.maximum(k, 1))).astype(int)
        for s in np.unique(size):
            rows = np.flatnonzero(size == s)
            at = np.arange(int(k[rows].sum())) - np.repeat(np.cumsum(k[rows]) - k[rows], k[rows]) + np.repeat((ends - k)[rows], k[rows])
            f[at] = _gamma_rows(data, begin[rows], k[rows])
        off = pa.array(np.r_[0, ends].astype(np.int32))
        return pa.StructArray.from_arrays([pa.ListArray.from_arrays(off, pa.array(d)), pa.ListArray.from_arrays(off, pa.array(f))], ["docs", "tfs"])

    run.__annotations__ = {"ids": pa.Array, "freqs": pa.Array, "n": pa.Array, "return": pa.Array}
    udf = F.arrow_udf("docs array<bigint>, tfs array<bigint>")(run).asNondeterministic()
    got = lists.select("term", udf("ids", "freqs", "n").alias("c"))
    return got.select("term", F.explode(F.arrays_zip(F.col("c.docs").alias("doc_id"), F.col("c.tfs").alias("tf"))).alias("p")).select("term", "p.doc_id", "p.tf")
