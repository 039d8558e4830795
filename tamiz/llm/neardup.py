"""Near-duplicate records: an exact Jaccard join of shingle sets.

The named method - pivots, Voronoi regions, triangle-inequality windows - is kept as far as it prunes.
Document pivots do not: distances between unrelated pages lie close together (0.8 to 0.97), so that a
window of width 0.5 around any of them holds nearly every document (figures in the README).  The regions here are
projections of the metric space, joined on their own and exactly:

* Shingles are dealt to ``groups`` groups.  If J(x, y) >= t, then J >= t holds for the parts of x and
  y in at least one group (the bounds on common shingles add up over groups); so each region
  joins parts, and what no region finds cannot be a pair.
* Inside a region single shingles are the pivots: a part belongs to the cells of its prefix, rarest
  shingles first, as long as a partner of similarity t can require.  To a cell travels a posting of
  fixed size, not the part: the set's name, the shingle and its place, the part's size and 128 bits of it.
  Cells are hashed to as many regions a group as memory asks for; as a posting goes to one region, what
  travels does not depend on their number.  The empty set's triangle inequality gives a window of sizes.
* Pairs that meet in a cell pass a bound from the 128 bits; all pairs that do so are compared over whole
  sets, which are sent once for each pair.
* Groups are joined a few at a time, and pairs are compared in turns; the files of one turn are deleted before
  the next, so that the disk in use at once is bounded by a multiple of the sets.

Nothing is sampled and no list is capped, so every pair is found; orders and counts decide
the cost only.  Records with equal shingle sets form one class; classes are joined, not records, and
known by the hash of their set, so that keys need not be unique.

Shingles are 48-bit hashes; two of one record collide with a chance under 1e-9.

Edge cases: records with a null key, a null or empty text, or a text of fewer words than a shingle
have no set and are no cases; a key that occurs twice counts as two records of that key; other columns are not read; empty
tables give empty results.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm import boilerplate as bp
from tamiz.session import checkpointed, passing

WORDS, THRESHOLD = 3, 0.5
GROUPS, BYTES = 12, 6
REGION = 8 << 20  # bytes of shingles in a region
TURNS, TURN = 3, 4 << 20  # most turns over the groups, and the bytes of shingles from which one more pays
CHUNK = 262_144  # postings joined at once in a region: memory, not results
CELLS = (1 << 20, 1 << 24)  # least and most of the count sketch, a byte each
BITS = (1 << 20, 1 << 27)  # least and most of the bitmap of sets to compare
TURN_PAIRS = 50_000  # pairs compared in a turn, at least; else half the number of records
COMPARED = 4_000  # pairs compared at once, under 65,536
SLICE = 20_000  # classes in a block of postings, under 65,536
LIST = 512  # members of a class in one list


def _mixed(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return h ^ (h >> np.uint64(31))


def shingles(lines: pa.Array, page: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(page, shingle hash), sorted and distinct: runs of k words read across lines, lower-cased letters and digits."""
    import xxhash

    w = pc.split_pattern_regex(pc.utf8_lower(pc.fill_null(lines.cast(pa.large_string()), "")), r"[^\p{L}\p{N}]+")
    coded = w.flatten().dictionary_encode()
    words = coded.dictionary.to_pylist()
    code = coded.indices.to_numpy(zero_copy_only=False)
    doc = np.repeat(page, w.value_lengths().to_numpy(zero_copy_only=False))
    full = np.fromiter((x != "" for x in words), bool, len(words))[code] if len(words) else np.zeros(0, bool)
    code, doc = code[full], doc[full]  # splitting leaves empty strings at the ends
    if len(code) < k:
        return np.empty(0, np.int64), np.empty(0, np.uint64)
    h = np.fromiter((xxhash.xxh64_intdigest(x) for x in words), np.uint64, len(words))[code]
    n = len(h) - k + 1
    with np.errstate(over="ignore"):
        s = np.zeros(n, np.uint64)
        for i in range(k):
            s = _mixed(s * np.uint64(0x9E3779B97F4A7C15) + h[i : i + n])
        s >>= np.uint64(16)
    keep = doc[:n] == doc[k - 1 :]
    d, s = doc[:n][keep], s[keep]
    o = np.lexsort((s, d))
    d, s = d[o], s[o]
    first = np.r_[True, (d[1:] != d[:-1]) | (s[1:] != s[:-1])] if len(d) else np.zeros(0, bool)
    return d[first], s[first]


def _packed(h: np.ndarray, ends: np.ndarray) -> pa.Array:
    """Six bytes a shingle."""
    data = np.ascontiguousarray(h.view(np.uint16).reshape(-1, 4)[:, :3])
    return pa.Array.from_buffers(pa.binary(), len(ends) - 1, [None, pa.py_buffer((ends * 6).astype(np.int32).tobytes()), pa.py_buffer(data.tobytes())])


def _hashes(a: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The shingles of all rows end to end, and how many each row has."""
    three, n = _blob(a, np.uint16)
    out = np.zeros((len(three) // 3, 4), np.uint16)
    out[:, :3] = three.reshape(-1, 3)
    return out.view(np.uint64).reshape(-1), n // 3


def _set_rows(key: pa.Array, lines: pa.Array, page: np.ndarray, k: int) -> pa.RecordBatch:
    d, s = shingles(lines, page, k)
    size = np.bincount(d, minlength=len(key))
    ends = np.r_[0, np.cumsum(size)]
    with np.errstate(over="ignore"):
        sums = np.r_[np.uint64(0), np.cumsum(_mixed(s + np.uint64(1)), dtype=np.uint64)]
        sig = _mixed(sums[ends[1:]] - sums[ends[:-1]])
    some = np.flatnonzero(size)
    blob = _packed(s, ends)
    return pa.record_batch([key.take(pa.array(some)), pa.array(sig[some].view(np.int64)), pa.array(size[some].astype(np.int32)), blob.take(pa.array(some))], names=["rec_no", "sig", "size", "hashes"])


def page_sets(pages: DataFrame, key: str = "rec_no", text: str = "text", k: int = WORDS) -> DataFrame:
    """(rec_no, sig, size, hashes) of the main bodies of pages; those without a shingle are left out."""
    raw = bp.weights()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = bp.load(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lines, cut = bp.furniture(model, part.column(1))
                kept = lines.at[~cut]
                yield _set_rows(part.column(0), lines.raw.take(pa.array(kept)), lines.page_all[kept], k)

    rows = pages.select(F.col(key).cast("bigint").alias("rec_no"), F.col(text).alias("text")).where((F.length("text") > 0) & F.col("rec_no").isNotNull())
    return rows.mapInArrow(run, "rec_no bigint, sig bigint, size int, hashes binary")


def text_sets(texts: DataFrame, key: str, text: str, k: int = 5) -> DataFrame:
    """As :func:`page_sets`, of whole texts and ``k`` words."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                yield _set_rows(part.column(0), part.column(1), np.arange(part.num_rows), k)

    rows = texts.select(F.col(key).cast("bigint").alias("rec_no"), F.col(text).alias("text")).where((F.length("text") > 0) & F.col("rec_no").isNotNull())
    return rows.mapInArrow(run, "rec_no bigint, sig bigint, size int, hashes binary")


def _blob(a: pa.Array, dtype) -> tuple[np.ndarray, np.ndarray]:
    """The values of a binary array laid end to end, and how many each row has."""
    a = a.combine_chunks() if isinstance(a, pa.ChunkedArray) else a
    if not len(a):
        return np.empty(0, dtype), np.empty(0, np.int64)
    width = np.int64 if pa.types.is_large_binary(a.type) else np.int32
    off = np.frombuffer(a.buffers()[1], width)[a.offset : a.offset + len(a) + 1].astype(np.int64)
    data = np.frombuffer(a.buffers()[2], np.uint8)[off[0] : off[-1]] if a.buffers()[2] is not None else np.empty(0, np.uint8)
    return data.view(dtype), np.diff(off) // np.dtype(dtype).itemsize


def _summed(rows: DataFrame, make, cells: int) -> np.ndarray:
    """A fixed-size array made by each partition, added up in blocks."""
    block = 1 << 16

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(cells, np.uint8)
        for batch in batches:
            make(total, batch)
        at = [i for i in range(0, cells, block) if total[i : i + block].any()]
        if at:
            yield pa.record_batch([pa.array([i // block for i in at], pa.int32()), pa.array([total[i : i + block].tobytes() for i in at])], names=["block", "part"])

    def join(key, parts):
        out = None
        for batch in parts:
            for p in batch.column("part"):
                x = np.frombuffer(p.as_py(), np.uint8)
                out = x.astype(np.uint32) if out is None else out + x
        yield pa.record_batch([pa.array([key[0].as_py()], pa.int32()), pa.array([np.minimum(out, 0xFFFFFFFF).astype(np.uint32).tobytes()])], names=["block", "part"])

    def joined(key, parts: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from join(key, parts)

    joined.__annotations__ = {"key": tuple[pa.Scalar, ...], "parts": Iterator[pa.RecordBatch], "return": Iterator[pa.RecordBatch]}
    got = rows.mapInArrow(run, "block int, part binary").groupBy("block").applyInArrow(joined, "block int, part binary")
    out = np.zeros(cells, np.uint32)
    with passing(rows.sparkSession):
        summed = got.select("*").collect()  # cells / 65536 rows at most
    for r in summed:
        out[r.block * block : (r.block + 1) * block] = np.frombuffer(bytes(r.part), np.uint32)
    return out


def rarity(sets: DataFrame, total: int) -> np.ndarray:
    """For each cell of a count sketch over all sets, 0 for a single use, else four times the logarithm of the uses."""
    cells = 1 << int(np.clip(math.ceil(math.log2(max(total, 1) / 32)), *(x.bit_length() - 1 for x in CELLS)))
    drop = np.uint64(48 - (cells.bit_length() - 1))

    def count(sums: np.ndarray, batch: pa.RecordBatch) -> None:
        h, _ = _hashes(batch.column("hashes"))
        n = np.bincount((h >> drop).astype(np.int64), minlength=cells)
        np.copyto(sums, np.minimum(sums.astype(np.int64) + n, 255).astype(np.uint8))

    uses = _summed(sets.select("hashes"), count, cells)
    return np.minimum(np.ceil(4 * np.log2(np.maximum(uses, 1))), 255).astype(np.uint8)


def base_prefix(n: np.ndarray, t: float) -> np.ndarray:
    """How many of a part's first shingles hold one that any partner of similarity t shares."""
    return n - np.ceil(n * t - 1e-9).astype(np.int64) + 1


def _blocks(region: np.ndarray, part: np.ndarray, about: tuple, token: np.ndarray, pos: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(32-bit words, ends, region): a block for each region, of postings sorted by region and part.

    A block is the number of its parts, then for each the set's name, two words of 64 bits and the size, then for each posting the
    shingle, and its place and the number of its part in the block.
    """
    new_row = np.r_[True, region[1:] != region[:-1]]
    new = new_row | np.r_[True, part[1:] != part[:-1]]
    row, one = np.cumsum(new_row) - 1, np.flatnonzero(new)
    parts, posts = np.bincount(row[one]), np.bincount(row)
    size = 1 + 7 * parts + 2 * posts
    ends = np.r_[0, np.cumsum(size)]
    words = np.empty(ends[-1], np.uint32)
    words[ends[:-1]] = parts
    local = np.cumsum(new) - 1 - (np.cumsum(parts) - parts)[row]
    at = ends[row[one]] + 1 + 7 * local[one]
    for k, x in enumerate(about[:3]):
        x = x.view(np.uint64)[part[one]]
        words[at + 2 * k], words[at + 2 * k + 1] = x & np.uint64(0xFFFFFFFF), x >> np.uint64(32)
    words[at + 6] = about[3][part[one]]
    at = (ends[:-1] + 1 + 7 * parts)[row] + 2 * (np.arange(len(row)) - (np.cumsum(posts) - posts)[row])
    words[at] = token
    words[at + 1] = np.minimum(pos, 65535) << 16 | local  # a smaller place only weakens the bound
    return words, ends, region[new_row]


def _postings(blocks: pa.Array) -> tuple[tuple, np.ndarray, np.ndarray, np.ndarray]:
    """((name, bits, bits, size) of parts, part, shingle, place of postings), of all blocks."""
    words, size = _blob(blocks, np.uint32)
    start = np.cumsum(size) - size
    parts = words[start].astype(np.int64)
    posts = (size - 1 - 7 * parts) // 2
    before = np.cumsum(parts) - parts
    at = np.repeat(start + 1 - 7 * before, parts) + 7 * np.arange(int(parts.sum()))
    wide = [words[at + k].astype(np.uint64) | words[at + k + 1].astype(np.uint64) << np.uint64(32) for k in (0, 2, 4)]
    about = wide[0].view(np.int64), wide[1], wide[2], words[at + 6].astype(np.int64)
    at = np.repeat(start + 1 + 7 * parts - 2 * (np.cumsum(posts) - posts), posts) + 2 * np.arange(int(posts.sum()))
    last = words[at + 1].astype(np.int64)
    return about, (last & 65535) + np.repeat(before, posts), words[at].astype(np.int64), last >> 16


def _emitter(rank: np.ndarray, groups: int, cells: int, t: float, label: np.ndarray, begin: int = 0, end: int | None = None):
    """The postings of the prefixes of each class in the groups from ``begin`` to ``end``: one row a batch and region.

    A partition emits a class once, so that copies of one text, however many, give their postings once a partition.
    """
    drop = np.uint64(48 - int(np.log2(len(rank))))
    end = groups if end is None else end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in (x.slice(at, SLICE) for x in batches for at in range(0, x.num_rows, SLICE)):
            sig = batch.column("sig").to_pylist()
            fresh = [i for i, x in enumerate(sig) if not (x in seen or seen.add(x))]
            if len(fresh) < len(sig):
                batch = batch.take(pa.array(fresh, pa.int64()))
            h, n = _hashes(batch.column("hashes"))
            doc, g = np.repeat(np.arange(len(n)), n), (h % np.uint64(groups)).astype(np.int64)
            if begin > 0 or end < groups:
                mine = np.flatnonzero((g >= begin) & (g < end))
                h, doc, g = h[mine], doc[mine], g[mine]
            if not len(h):
                continue
            # shingles of a set are stored in order, so that a stable sort leaves those of a rank in order
            o = np.argsort(((g - begin) * len(n) + doc) * 256 + rank[(h >> drop).astype(np.int64)], kind="stable")
            h, doc, g = h[o], doc[o], g[o]
            first = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (g[1:] != g[:-1])])
            size = np.diff(np.r_[first, len(h)])
            mixed = _mixed(h)
            bit, upper = np.uint64(1) << (mixed >> np.uint64(58)), mixed & np.uint64(1 << 57) > 0
            bits, more = (np.bitwise_or.reduceat(np.where(x, bit, np.uint64(0)), first) for x in (~upper, upper))
            part = np.repeat(np.arange(len(first)), size)
            pos = np.arange(len(h)) - first[part]
            use = np.flatnonzero(pos < base_prefix(size, t)[part])
            region = (g[use] - begin) * cells + (mixed[use] % np.uint64(cells)).astype(np.int64)
            o = np.argsort(region, kind="stable")
            use, region, part = use[o], region[o], part[use[o]]
            name = batch.column("sig").to_numpy(zero_copy_only=False)[doc[first]]
            words, ends, row = _blocks(region, part, (name, bits, more, size), mixed[use] >> np.uint64(32), pos[use])
            blob = pa.Array.from_buffers(pa.large_binary(), len(row), [None, pa.py_buffer((ends * 4).astype(np.int64).tobytes()), pa.py_buffer(words.tobytes())])
            yield pa.record_batch([pa.array(label[row]), blob.cast(pa.binary())], names=["region", "part"])

    return run


def candidates(blocks: pa.Array, t: float) -> tuple[np.ndarray, np.ndarray]:
    """(a, b), a < b, distinct: sets whose parts meet in a shingle of a region's postings and may have similarity t.

    Shingles are known by 32 bits beside their region: two that agree can only add candidates.
    """
    share = t / (1 + t)
    about, doc, token, pos = _postings(blocks)
    sig, one, same = np.unique(about[0], return_index=True, return_inverse=True)
    width, doc = max(1, len(sig)), same[doc]
    bits, more_bits, n_of = (x[one] for x in about[1:])
    o = np.lexsort((pos, doc, n_of[doc], token))
    doc, token, pos = doc[o], token[o], pos[o]
    if len(doc):  # a class comes from each partition that has it
        new = np.flatnonzero(np.r_[True, (doc[1:] != doc[:-1]) | (token[1:] != token[:-1])])
        doc, token, pos = doc[new], token[new], pos[new]
    doc, z = doc.astype(np.int32), n_of[doc]
    # were this the first common shingle, at most z - pos are common: that bounds the partner's size
    reach = (z - pos + 1e-3) / share - z
    # lists run by size and document: partners of a posting are the run after it up to a size
    span = int(z.max(initial=0)) + 2
    most = np.floor(np.minimum(reach, (z + 1e-3) / t)).astype(np.int64)
    stop = np.searchsorted(token * span + z, token * span + np.minimum(most, span - 1), "right") - np.arange(len(z)) - 1
    core = np.flatnonzero((stop > 0) & (most >= z))
    low = reach.astype(np.float32)
    # similarity t needs that many common shingles; the differing bits bound how many there can be
    bits, more_bits, n = bits[doc], more_bits[doc], z.astype(np.int32)
    need = np.ceil(np.arange(2 * span + 1) * share - 1e-9)
    slack = np.floor(np.arange(2 * span + 1) - 2 * need).astype(np.int8 if span < 60 else np.int32)  # most differing bits for a sum of sizes
    found = [np.empty(0, np.int64)]
    for begin in range(0, len(core), CHUNK):
        at = core[begin : begin + CHUNK]
        at = at[np.argsort(-stop[at], kind="stable")].astype(np.int32)
        more, size, mine, mine_too, first_of = -stop[at], n[at], bits[at], more_bits[at], doc[at]
        keys, d = [], np.int32(1)
        while (m := int(np.searchsorted(more, -d, "right"))) > 0:
            b = at[:m] + d
            total = size[:m] + n[b]
            ok = np.flatnonzero((np.bitwise_count(mine[:m] ^ bits[b]) <= slack[total]) & (low[b] >= size[:m]))
            if len(ok):
                x = mine[:m][ok] ^ bits[b[ok]], mine_too[:m][ok] ^ more_bits[b[ok]]
                ok = ok[np.bitwise_count(x[0]).astype(np.int32) + np.bitwise_count(x[1]) <= slack[total[ok]]]
            if len(ok):
                x, y = first_of[ok].astype(np.int64), doc[b[ok]].astype(np.int64)
                keys.append(np.minimum(x, y) * width + np.maximum(x, y))  # sig is sorted, so the smaller is a
            d += np.int32(1)
        if keys:
            found.append(np.unique(np.concatenate(keys)))
    pair = np.unique(np.concatenate(found))
    return sig[pair // width], sig[pair % width]


def _joiner(t: float):
    def run(table: pa.Table) -> pa.Table:
        a, b = candidates(table.column("part"), t)
        return pa.table({"a": pa.array(a), "b": pa.array(b)})

    run.__annotations__ = {"table": pa.Table, "return": pa.Table}
    return run


def _labels(spark, n: int) -> np.ndarray:
    """n numbers that hash to n different partitions of n, so that each region is a task of its own."""
    got = np.full(n, -1, np.int64)
    begin, step = 0, 16 * n
    while (got < 0).any():
        rows = spark.range(begin, begin + step).select(F.pmod(F.hash("id"), F.lit(n)).alias("p"), "id").groupBy("p").agg(F.min("id").alias("id")).collect()  # n rows
        for r in rows:
            if got[r.p] < 0:
                got[r.p] = r.id
        begin += step
    return got


def cells_for(total: int, groups: int, region: int = REGION) -> int:
    """Cells a group, so that a region holds about ``region`` bytes of shingles.

    A posting goes to one cell, so what is emitted does not depend on the number of cells.
    """
    return max(1, math.ceil(total * BYTES / groups / region))


def _exact():
    def common(a: pa.Array, b: pa.Array) -> np.ndarray:
        x, n = _hashes(a)
        y, m = _hashes(b)
        row = np.arange(len(n), dtype=np.uint64) << np.uint64(48)  # above the 48 bits of a shingle
        both = np.sort(np.concatenate([x | np.repeat(row, n), y | np.repeat(row, m)]))
        twice = both[1:][both[1:] == both[:-1]]
        return np.bincount((twice >> np.uint64(48)).astype(np.int64), minlength=len(n)).astype(np.int32)

    def run(a: pa.Array, b: pa.Array) -> pa.Array:
        got = [common(a.slice(at, COMPARED), b.slice(at, COMPARED)) for at in range(0, len(a), COMPARED)]
        return pa.array(np.concatenate([np.empty(0, np.int32), *got]))

    run.__annotations__ = {"a": pa.Array, "b": pa.Array, "return": pa.Array}
    return F.arrow_udf("int")(run)


def _marked(rows: DataFrame, bits: int) -> np.ndarray:
    """A bitmap of fixed size, a byte for eight bits, of the names in ``rows.sig``."""
    i = F.pmod("sig", F.lit(bits)) + 1
    got = rows.groupBy(F.bitmap_bucket_number(i).alias("block")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(i)).alias("part"))
    out = np.zeros((bits >> 15, 1 << 12), np.uint8)
    for r in got.collect():  # bits / 32768 rows at most
        out[r.block - 1] = np.frombuffer(bytes(r.part), np.uint8)
    return out.reshape(-1)


def _chosen(marks: np.ndarray):
    """The classes that a bitmap names, once a partition."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            sig = batch.column("sig").to_numpy(zero_copy_only=False)
            i = sig & (len(marks) * 8 - 1)
            hit = np.flatnonzero(marks[i >> 3] >> (i & 7).astype(np.uint8) & 1)
            fresh = [j for j, x in zip(hit.tolist(), sig[hit].tolist()) if not (x in seen or seen.add(x))]
            yield batch.take(pa.array(fresh, pa.int64()))

    return run


def _compared(near: DataFrame, full: DataFrame, t: float) -> DataFrame:
    """The pairs of ``near`` whose sets have similarity t."""
    side = lambda c: full.select(F.col("sig").alias(c), F.col("hashes").alias(f"h{c}"), F.col("size").alias(f"n{c}"))
    both = near.join(side("a"), "a").join(side("b"), "b").select("a", "b", (F.col("na") + F.col("nb")).alias("size"), _exact()("ha", "hb").alias("n"))
    return both.where(F.col("n") >= F.ceil(F.col("size") * (t / (1 + t)) - 1e-9)).select("a", "b")


def class_pairs(sets: DataFrame, t: float = THRESHOLD, groups: int = GROUPS, region: int = REGION) -> DataFrame:
    """(a, b): pairs of classes, by their ``sig``, a < b; ``sets`` is read several times."""
    spark = sets.sparkSession
    all_ = sets.agg(F.coalesce(F.sum("size"), F.lit(0)).alias("n"), F.count(F.lit(1)).alias("records")).first()
    rank, cells = rarity(sets, all_.n), cells_for(all_.n, groups, region)
    step = math.ceil(groups / int(np.clip(all_.n * BYTES // TURN, 1, min(TURNS, groups))))
    label = _labels(spark, step * cells)
    near = []
    for begin in range(0, groups, step):
        run = _emitter(rank, groups, cells, t, label, begin, min(groups, begin + step))
        parts = sets.select("sig", "hashes").mapInArrow(run, "region bigint, part binary").repartition(step * cells, F.col("region"))
        with passing(spark):
            near.append(checkpointed(parts.groupBy("region").applyInArrow(_joiner(t), "a bigint, b bigint").distinct()))
    if len(near) > 1:
        with passing(spark):
            near = [checkpointed(reduce(DataFrame.unionByName, near).distinct())]
    pairs = near[0].count()
    turns = max(1, math.ceil(pairs / max(TURN_PAIRS, all_.records // 2)))
    bits = 1 << int(np.clip(pairs // turns * 32, *BITS) - 1).bit_length()
    got = []
    for turn in range(turns):
        mine = near[0].where(F.pmod(F.xxhash64("a", "b"), F.lit(turns)) == turn) if turns > 1 else near[0]
        marks = _marked(mine.select(F.explode(F.array("a", "b")).alias("sig")), bits)
        full = sets.select("sig", "size", "hashes").mapInArrow(_chosen(marks), "sig bigint, size int, hashes binary").dropDuplicates(["sig"])
        with passing(spark):
            got.append(checkpointed(_compared(mine, full, t)))
    return reduce(DataFrame.unionByName, got)


def classes(sets: DataFrame) -> DataFrame:
    """(sig, class, members): records of equal sets, under the smallest key of them."""
    return sets.groupBy("sig").agg(F.min("rec_no").alias("class"), F.count(F.lit(1)).alias("members"))


def record_pairs(sets: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """(rec_no_a, rec_no_b), smaller first: every pair of records, copies expanded.

    Classes are expanded in lists of about ``LIST`` members: a class of any size is many rows, none of them large, and
    each pair of lists is one row until it is written out.
    """
    known = classes(sets).select("sig", F.ceil(F.col("members") / LIST).cast("int").alias("lists"), "members")
    pick = F.pmod(F.xxhash64("rec_no", "n"), F.col("lists")).cast("int")
    # a key found twice under one text counts twice, hence the row number beside it
    rows = sets.select("sig", "rec_no", F.monotonically_increasing_id().alias("n")).join(known.select("sig", "lists"), "sig").withColumn("list", pick)
    lists = rows.groupBy("sig", "list").agg(F.collect_list(F.struct("rec_no", "n")).alias("recs"))
    pairs = class_pairs(sets, t).unionByName(known.where("members > 1").select(F.col("sig").alias("a"), F.col("sig").alias("b")))
    size = lambda c: known.select(F.col("sig").alias(c), F.col("lists").alias(f"l{c}"))
    upto = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    blocks = pairs.join(size("a"), "a").join(size("b"), "b").withColumn("i", upto("la")).withColumn("j", upto("lb")).where("a <> b or i <= j")
    blocks = blocks.join(lists.select(F.col("sig").alias("a"), F.col("list").alias("i"), F.col("recs").alias("xs")), ["a", "i"])
    blocks = blocks.join(lists.select(F.col("sig").alias("b"), F.col("list").alias("j"), F.col("recs").alias("ys")), ["b", "j"])
    got = blocks.select("a", "b", "i", "j", "ys", F.explode("xs").alias("x")).select("a", "b", "i", "j", "x", F.explode("ys").alias("y"))
    got = got.where("a <> b or i <> j or x.n < y.n")
    return got.select(F.least("x.rec_no", "y.rec_no").alias("rec_no_a"), F.greatest("x.rec_no", "y.rec_no").alias("rec_no_b"))


def found(pages: DataFrame) -> DataFrame:
    return record_pairs(checkpointed(page_sets(pages)))


def groups(sets: DataFrame, t: float = THRESHOLD) -> DataFrame:
    """(rec_no, class, links, group_id): one row a record; links are those of its class to other classes, group_id the smallest record connected.

    Labels spread along links, each round's result checkpointed, until none changes.
    """
    known = checkpointed(classes(sets).select("sig", "class"))
    pairs = class_pairs(sets, t)
    named = pairs.join(known.select(F.col("sig").alias("a"), F.col("class").alias("ca")), "a").join(known.select(F.col("sig").alias("b"), F.col("class").alias("cb")), "b")
    both = checkpointed(named.select(F.inline(F.array(F.struct("a", "b", "cb"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), F.col("ca").alias("cb"))))))
    # a label is (smallest record, its class): two classes may share a record's key
    label = both.groupBy("a").agg(F.count(F.lit(1)).alias("links"), F.min(F.struct(F.col("cb").alias("c"), F.col("b").alias("s"))).alias("near"))
    label = checkpointed(label.join(known.withColumnRenamed("sig", "a"), "a").select("a", "links", F.least("near", F.struct(F.col("class").alias("c"), F.col("a").alias("s"))).alias("l")))
    while True:  # a label only falls, so this ends
        near = both.join(label.select(F.col("a").alias("b"), "l"), "b").groupBy("a").agg(F.min("l").alias("m"))
        step = label.join(near, "a").select("a", "links", "l", F.least("l", "m").alias("m"))
        # what a class sees is passed to its label, and the label's own label is taken: long chains shrink in any order
        hook = step.groupBy(F.col("l.s").alias("a")).agg(F.min("m").alias("h"))
        step = step.join(hook, "a", "left").select("a", "links", "l", F.least("m", "h").alias("m"))
        jump = step.join(label.select(F.col("a").alias("s"), F.col("l").alias("j")), F.col("m.s") == F.col("s"), "left")
        jump = jump.select("a", "links", F.least("m", F.coalesce("j", "m")).alias("l"), (F.least("m", F.coalesce("j", "m")) < F.col("l")).alias("moved"))
        jump = checkpointed(jump)
        label = jump.drop("moved")
        if jump.where("moved").isEmpty():
            break
    got = known.join(label.select(F.col("a").alias("sig"), "links", F.col("l.c").alias("l")), "sig", "left")
    got = got.select("sig", "class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("l", "class").alias("group_id"))
    return sets.select("sig", "rec_no").join(got, "sig").select("rec_no", "class", "links", "group_id")
