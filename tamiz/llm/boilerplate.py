"""Main body of web pages: boilerplate lines are cut off by a minimum cut.

Every line of a page is a node.  A classifier's costs are the terminal capacities; edges join
neighbouring lines and lines two apart, stronger inside a block, between lines of one shape, between a
heading and its text, and along a hard-wrapped paragraph.  A maximum flow separates furniture from
main body.

The classifier is a logistic regression in two steps (weights in ``boilerplate_weights.npz``, made by
:mod:`tamiz.llm.boilerplate_train` from a bounded sample of weakly labelled pages): words, first and
last word and shape of a line give three scores (furniture, heading of a list of other articles, byline); those
of a line and its neighbours, with blank lines and position, give its cost.

Null and empty texts have no lines that are cases; lines of blanks only are never cases; repeated
pages give repeated rows; pages of any length are handled whole.
"""

from __future__ import annotations

import html
import io
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm.mincut import source_side

SCORES = 3  # furniture, heading of a list, byline
REACH = 3  # neighbours on either side


class Lines:
    """The lines of a batch of texts: ``page`` and ``number`` of each, and those that are not blank."""

    def __init__(self, texts: pa.Array):
        parts = pc.split_pattern(pc.fill_null(texts.cast(pa.large_string()), ""), "\n")
        flat = parts.flatten()
        size = parts.value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        if len(flat) and pc.any(pc.match_substring(flat, "<")).as_py():
            flat = pc.replace_substring_regex(flat, r"</?[A-Za-z][^<>]*>", "")
        marked = pc.match_substring_regex(flat, "&#?[0-9A-Za-z]+;") if len(flat) else None
        if marked is not None and pc.any(marked).as_py():
            flat = pc.replace_with_mask(flat, marked, pa.array([html.unescape(x) for x in flat.filter(marked).to_pylist()], flat.type))
        flat = pc.utf8_trim_whitespace(flat)
        self.raw = parts.flatten()
        self.page_all = np.repeat(np.arange(len(texts)), size)
        begin = np.cumsum(size) - size
        self.number_all = np.arange(len(flat)) - np.repeat(begin, size)
        self.at = np.flatnonzero(pc.binary_length(flat).to_numpy(zero_copy_only=False) > 0)
        self.page, self.number = self.page_all[self.at], self.number_all[self.at]
        coded = flat.take(pa.array(self.at)).dictionary_encode()
        self.code = coded.indices.to_numpy(zero_copy_only=False)
        self.distinct = coded.dictionary


def words_of(lines: pa.Array) -> tuple[pa.Array, np.ndarray, np.ndarray]:
    """(distinct words, code of each word, offsets by line)."""
    w = pc.split_pattern_regex(pc.utf8_lower(lines), r"[^\p{L}©]+")
    off = w.offsets.to_numpy(zero_copy_only=False).astype(np.int64)
    d = w.flatten().dictionary_encode()
    return d.dictionary, d.indices.to_numpy(zero_copy_only=False), off - off[0]


def shapes(lines: pa.Array) -> np.ndarray:
    """Shape features of distinct lines, one row a line."""
    f = lambda x: x.to_numpy(zero_copy_only=False).astype(np.float32)
    n = f(pc.utf8_length(lines))
    last, first = pc.utf8_slice_codeunits(lines, -1), pc.utf8_slice_codeunits(lines, 0, 1)
    one = lambda x, marks: f(pc.is_in(x, pa.array(list(marks), pa.large_string())))
    sep = f(pc.count_substring(lines, " · ")) + f(pc.count_substring(lines, " | ")) + f(pc.count_substring(lines, " - ")) + f(pc.count_substring(lines, " / "))
    digits = f(pc.count_substring_regex(lines, "[0-9]"))
    return np.stack(
        [
            n < 15, (n >= 15) & (n < 30), (n >= 30) & (n < 60), (n >= 60) & (n < 100), (n >= 100) & (n < 200), n >= 200,
            one(last, ".!?"), one(last, ":"), one(last, "»\"”)"), one(first, "•*-–"), one(first, "«>“\""),
            np.minimum(sep, 6), f(pc.match_substring(lines, " » ")) + f(pc.match_substring(lines, " > ")), f(pc.match_substring(lines, "   ")),
            np.minimum(digits / np.maximum(n, 1) * 5, 3), f(pc.utf8_is_upper(lines)), f(pc.utf8_is_lower(first)),
        ],
        1,
    ).astype(np.float32)


ENDED, BULLET, LOWER = 6, 9, 16  # columns of shapes()


def scores_of(model: dict, lines: pa.Array, shape: np.ndarray) -> np.ndarray:
    """(lines, SCORES) logits of distinct lines."""
    words, code, off = words_of(lines)
    row = pc.fill_null(pc.index_in(words, value_set=model["vocab"]), len(model["vocab"])).to_numpy(zero_copy_only=False)
    code = row[code]
    full = off[1:] > off[:-1]
    z = shape @ model["S"] + model["b"]
    if full.any():
        at = off[:-1][full]
        z[full] += np.add.reduceat(model["W"][code], at, 0)[:, :]
        z[full] += model["Wf"][code[at]] + model["Wl"][code[off[1:][full] - 1]]
    return np.clip(z, -12, 12)


def context(z: np.ndarray, shape: np.ndarray, page: np.ndarray, number: np.ndarray) -> np.ndarray:
    """Features of each line from its own and its neighbours' scores; z and shape already by line."""
    n = len(page)
    p = 1 / (1 + np.exp(-z))
    headline = (1 - shape[:, ENDED]) * (1 - shape[:, LOWER]) * (1 - shape[:, 7])
    text = shape[:, ENDED] * (shape[:, 3] + shape[:, 4] + shape[:, 5]) + (1 - shape[:, ENDED]) * (shape[:, 3] + shape[:, 4]) * 0.5
    cols = [z[:, 0], p[:, 1], p[:, 2], headline, text]
    first = np.r_[True, page[1:] != page[:-1]]
    start = np.maximum.accumulate(np.where(first, np.arange(n), 0))
    size = np.bincount(page, minlength=int(page[-1]) + 1)[page]
    i = np.arange(n) - start
    cols += [i == 0, i == 1, i == size - 1, i < 4, i >= size - 4, i / np.maximum(size, 1)]
    for d in (*range(-REACH, 0), *range(1, REACH + 1)):
        j = np.arange(n) + d
        ok = (j >= 0) & (j < n)
        j = np.clip(j, 0, n - 1)
        ok &= page[j] == page
        near = ok & (np.abs(number[j] - number) == abs(d))
        f, r, b, h, t = (np.where(ok, x[j], y) for x, y in ((p[:, 0], 0.5), (p[:, 1], 0), (p[:, 2], 0), (headline, 0), (text, 0)))
        cols += [f, near * (f - 0.5), near * r, near * b, ok, near, headline * near * r, headline * near * b, headline * near * t, headline * near * h, headline * near * (f > 0.8)]
        if d < 0:  # a list goes on: everything since its heading is a headline
            run = near.copy()
            for e in range(d + 1, 0):
                k = np.clip(np.arange(n) + e, 0, n - 1)
                run &= (headline[k] > 0.5) & (p[k, 2] < 0.5)
            cols.append(headline * run * r)
    return np.stack([np.asarray(c, np.float32) for c in cols], 1)


#: weights of edges, in units of the classifier's logits: other block, same block, both headlines, heading and text, hard wrap, two apart
EDGES = {"far": 0.15, "near": 0.5, "headlines": 0.7, "heading": 0.8, "wrap": 3.0, "second": 0.25}
SCALE = 1000


def edges(shape: np.ndarray, page: np.ndarray, number: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Capacities to the next line and to the next but one."""
    n = len(page)
    headline = (shape[:, ENDED] + shape[:, LOWER] + shape[:, BULLET] + shape[:, 7] == 0) & (length < 160)
    one, two = np.zeros(n, np.float32), np.zeros(n, np.float32)
    if n > 1:
        a, b = slice(0, n - 1), slice(1, n)
        same, near = page[a] == page[b], number[b] - number[a] == 1
        w = np.where(near, EDGES["near"], EDGES["far"])
        w = w + EDGES["headlines"] * (near & headline[a] & headline[b])
        w = w + EDGES["heading"] * (near & headline[a] & (length[b] > 60) & ~headline[b])
        w = w + EDGES["wrap"] * (near & (shape[a, ENDED] == 0) & (shape[b, LOWER] > 0) & (length[a] > 40))
        one[a] = np.where(same, w, 0)
    if n > 2:
        a, b = slice(0, n - 2), slice(2, n)
        alike = (headline[a] == headline[b]) & (shape[a, BULLET] == shape[b, BULLET])
        two[a] = np.where((page[a] == page[b]) & (number[b] - number[a] == 2) & alike, EDGES["second"], 0)
    return np.round(one * SCALE).astype(np.int64), np.round(two * SCALE).astype(np.int64)


def furniture(model: dict, texts: pa.Array) -> tuple[Lines, np.ndarray]:
    """The non-blank lines of a batch and whether each is furniture."""
    lines = Lines(texts)
    if not len(lines.at):
        return lines, np.zeros(0, bool)
    by_line = shapes(lines.distinct)
    z = scores_of(model, lines.distinct, by_line)[lines.code]
    shape = by_line[lines.code]
    cost = context(z, shape, lines.page, lines.number) @ model["C"] + model["c"]
    length = pc.utf8_length(lines.distinct).to_numpy(zero_copy_only=False)[lines.code]
    one, two = edges(shape, lines.page, lines.number, length)
    return lines, source_side(np.round(np.clip(cost, -9, 9) * SCALE).astype(np.int64), one, two)


@lru_cache(maxsize=2)
def load(raw: bytes) -> dict:
    with np.load(io.BytesIO(raw)) as z:
        model = {k: z[k].astype(np.float32) for k in z.files if k != "vocab"}
        model["vocab"] = pa.array([str(w) for w in z["vocab"]], pa.large_string())
    return model


def weights() -> bytes:
    """The classifier, under 200 KB whatever the data."""
    return Path(__file__).with_name("boilerplate_weights.npz").read_bytes()


def _marker(raw: bytes):
    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = load(raw)
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                lines, cut = furniture(model, part.column(1))
                yield pa.record_batch([part.column(0).take(pa.array(lines.page[cut])), pa.array(lines.number[cut].astype(np.int32))], names=["rec_no", "line_no"])

    return mark


def found(pages: DataFrame, key: str = "rec_no", text: str = "text") -> DataFrame:
    """(rec_no, line_no) of the lines that are not main body."""
    rows = pages.select(F.col(key).cast("bigint").alias("rec_no"), F.col(text).alias("text")).where(F.length("text") > 0)
    return rows.mapInArrow(_marker(weights()), "rec_no bigint, line_no int")


def bodies(model: dict, texts: pa.Array) -> list[str]:
    """The main bodies: lines that are not furniture, blank ones between them kept once."""
    lines, cut = furniture(model, texts)
    keep = ~cut
    raw = lines.raw.take(pa.array(lines.at[keep])).to_pylist()
    page, number = lines.page[keep], lines.number[keep]
    ends = np.searchsorted(page, np.arange(len(texts) + 1))
    out = []
    for i in range(len(texts)):
        a, b = ends[i], ends[i + 1]
        gap = np.r_[False, np.diff(number[a:b]) > 1] if b > a else []
        out.append("\n".join(("\n" if g and k else "") + r.rstrip("\r") for k, (r, g) in enumerate(zip(raw[a:b], gap))))
    return out


def main_bodies(pages: DataFrame, key: str = "rec_no", text: str = "text") -> DataFrame:
    """(rec_no, body): null stays null, a page without main body gives an empty one."""
    raw = weights()

    def body(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        model = load(raw)
        for texts in batches:
            got = bodies(model, texts)
            yield pa.array([b if v else None for b, v in zip(got, pc.is_valid(texts).to_pylist())], pa.string())

    body.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return pages.select(F.col(key), F.arrow_udf("string")(body)(F.col(text)).alias("body"))
