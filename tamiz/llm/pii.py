"""Personal information in free text: find typed spans and replace them by placeholders.

A character BiLSTM with CRF transitions (:mod:`tamiz.llm.pii_net`) tags every character of every
text.  Texts are cut at line ends (no span crosses one); longer lines are cut into overlapping
windows, each window is decoded on its own, and neighbouring windows are joined at the position
inside their overlap, nearest to its middle, where both decoded the same tag outside any span.
A check of form follows (:func:`settle`): it trims blanks and marks, widens to whole words, and drops
spans that cannot be of their kind (an e-mail without a host, a phone of under seven digits, ...);
it adds no spans of its own.

Edge cases: null and empty texts give no span and stay as they are; repeated rows give repeated
output; other columns pass through ``redact`` untouched, a clash with an output name raises
``ValueError``.
"""

from __future__ import annotations

import io
import re
from collections.abc import Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.llm import pii_net as net
from tamiz.llm.pii_labels import KINDS

WINDOW, OVERLAP, COLUMNS = 480, 80, 768
_EDGE = " \t\r\n,;:!?\"'“”«»<>[]{}"


# --- fixed values: where an address of either sort ends -----------------------------------------
_MAIL = re.compile(r"[^\s@(\[]+\s?(?:@|[(\[]\s?(?:at|arroba|arobase)\s?[)\]])\s?[\w-]+(?:(?:\.|\s?[(\[]\s?(?:dot|punto|ponto|point)\s?[)\]]\s?)[\w-]+)*", re.I)
_DOOR = {"andar", "bis", "ter", "izquierda", "derecha", "izq", "dcha", "esquerdo", "direito", "gauche", "droite", "fondo"}
# ------------------------------------------------------------------------------------------------


@lru_cache(maxsize=2)
def load(raw: bytes) -> dict[str, np.ndarray]:
    with np.load(io.BytesIO(raw)) as z:
        return net.fuse({k: z[k].astype(np.float32) for k in z.files})


def weights() -> bytes:
    """The trained parameters, some 100 KB whatever the data."""
    return Path(__file__).with_name("pii_weights.npz").read_bytes()


def _tag_windows(q: dict, rows: list[np.ndarray]) -> list[np.ndarray]:
    """Tags of each window; windows of like length share a batch."""
    out: list[np.ndarray] = [np.empty(0, np.int8)] * len(rows)
    order = sorted(range(len(rows)), key=lambda i: len(rows[i]))
    pad = net.PAD * net.N_CLASS
    for at in range(0, len(order), COLUMNS):
        part = order[at : at + COLUMNS]
        n = np.array([len(rows[i]) for i in part])
        ids = np.full((int(n.max()), len(part)), pad, np.int32)
        for j, i in enumerate(part):
            ids[: n[j], j] = rows[i]
        e = net.emissions(q, ids)
        live = np.arange(len(ids))[:, None] < n[None, :]
        e[:, :, 0] += np.where(live, 0, 1e4)
        todo = np.flatnonzero(~net.surely_blank(q, e))
        for j in np.setdiff1d(np.arange(len(part)), todo):
            out[part[j]] = np.zeros(n[j], np.int8)
        if len(todo):
            tags = net.viterbi(q, np.ascontiguousarray(e[:, todo]), n[todo])
            for c, j in enumerate(todo):
                out[part[j]] = tags[: n[j], c]
    return out


def _join(parts: list[np.ndarray], starts: list[int], length: int) -> np.ndarray:
    """One tag a character from overlapping windows."""
    tags = np.zeros(length, np.int8)
    tags[: len(parts[0])] = parts[0]
    for a, left, b, right in zip(starts, parts, starts[1:], parts[1:]):
        end = a + len(left)
        x, y = left[b - a :], right[: end - b]
        same = np.flatnonzero((x == 0) & (y == 0))
        cut = int(same[np.abs(same - len(x) // 2).argmin()]) if len(same) else len(x) // 2
        tags[b + cut : b + len(right)] = right[cut:]
    return tags


def settle(text: str, a: int, b: int, kind: str) -> tuple[int, int] | None:
    """The span with whole words and without marks at its ends; None if its form is impossible."""
    while a > 0 and text[a - 1].isalnum() and text[a].isalnum():
        a -= 1
    while b < len(text) and text[b].isalnum() and text[b - 1].isalnum():
        b += 1
    while a < b and (text[a] in _EDGE or text[a] in ".)-/" or text[a] == "(" and kind != "phone"):
        a += 1
    while a < b and (text[b - 1] in _EDGE or text[b - 1] in "(-/" or text[b - 1] == ")" and text[a:b].count("(") < text[a:b].count(")")):
        b -= 1
    if kind in ("email", "phone", "ident") or kind == "name" and len(text[a:b].split(" ")[-1]) > 2:
        while a < b and text[b - 1] == ".":
            b -= 1
    if kind == "address" and (m := re.search(r"(?<=\.)\. |(?<=\d)\. (?=[A-ZÀ-Ý])", text[a:b])):
        b = a + m.start()  # no sentence ends inside an address
    if kind == "address" and re.search(r"\b(?:Rd|St|Ave|Ln|Dr)$", text[a:b]) and text[b : b + 1] == ".":
        b += 1
    if kind == "email" and (m := _MAIL.match(text[a:b])):
        b = a + m.end()
    while kind == "address" and (m := re.search(r"\s([^\W\d_]+)$", text[a:b])) and m[1].islower() and m[1] not in _DOOR:
        b = a + m.start()  # words that follow the address
    if kind == "ident" and re.match(r"\d \d\d ", text[a:b]) and (m := re.match(r"(?: \d{2,3})+(?!\w)", text[b:])):
        b += m.end()  # groups of one spaced number stay together
    v = text[a:b]
    if v.startswith("(") and ")" not in v:
        a, v = a + 1, v[1:]
    digits = sum(c.isdigit() for c in v)
    fine = {
        "email": bool(re.search(r"@|[(\[] ?(?:at|arroba|arobase) ?[)\]]", v, re.I)) and bool(re.search(r"\.|dot|punto|ponto|point", v, re.I)),
        "phone": 7 <= digits <= 18,
        "ident": 5 <= digits <= 20,
        "address": digits >= 1 and any(c.isupper() for c in v),
        "name": digits == 0 and sum(c.isalpha() for c in v) >= 3,
    }[kind]
    return (a, b) if fine and a < b else None


def tag_lines(q: dict, lines: list[str]) -> list[list[tuple[int, int, str]]]:
    """Spans (start, end, kind) of each line."""
    rows, plan = [], []
    for line in lines:
        letter, cls = net.encode(line)
        ids = letter.astype(np.int32) * net.N_CLASS + cls
        n = len(ids)
        starts = [0] if n <= WINDOW else [*range(0, n - WINDOW, WINDOW - OVERLAP), n - WINDOW]
        plan.append((len(rows), starts, n))
        rows += [ids[a : a + WINDOW] for a in starts]
    tags = _tag_windows(q, rows) if rows else []
    out = []
    for line, (at, starts, n) in zip(lines, plan):
        parts = tags[at : at + len(starts)]
        found: list[tuple[int, int, str]] = []
        if any(p.any() for p in parts):
            t = parts[0] if len(parts) == 1 else _join(parts, starts, n)
            kind = (t + 1) // 2
            begin = (t > 0) & ((t % 2 == 1) | (np.r_[0, kind[:-1]] != kind))
            for a in np.flatnonzero(begin):
                k, b = int(kind[a]), int(a) + 1
                while b < n and t[b] == 2 * k:
                    b += 1
                if (s := settle(line, int(a), b, KINDS[k - 1])) and (not found or s[0] >= found[-1][1]):
                    found.append((*s, KINDS[k - 1]))
        out.append(found)
    return out


def tag_texts(q: dict, texts: list[str | None]) -> list[list[tuple[int, int, str]]]:
    """Spans of each text; equal lines are decoded once."""
    lines: dict[str, int] = {}
    cut = [[] if not t else t.split("\n") for t in texts]
    for c in cut:
        for line in c:
            if line:
                lines.setdefault(line, len(lines))
    found = tag_lines(q, list(lines))
    out = []
    for c in cut:
        at, spans = 0, []
        for line in c:
            if line:
                spans += [(at + a, at + b, k) for a, b, k in found[lines[line]]]
            at += len(line) + 1
        out.append(spans)
    return out


def redacted(text: str, spans: list[tuple[int, int, str]]) -> str:
    out, at = [], 0
    for a, b, kind in spans:
        out += [text[at:a], f"[{kind.upper()}]"]
        at = b
    return "".join([*out, text[at:]])


_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("begin", pa.int32()), ("end", pa.int32()), ("pii_text", pa.string())]))
_RESULT = pa.struct([("pii", _SPANS), ("redacted", pa.string())])


def _tagger(raw: bytes):
    def tag(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        q = load(raw)
        for batch in batches:
            texts = batch.to_pylist()
            rows = []
            for text, spans in zip(texts, tag_texts(q, texts)):
                rows.append({"pii": [{"kind": k, "begin": a, "end": b, "pii_text": text[a:b]} for a, b, k in spans], "redacted": text if not spans else redacted(text, spans)})
            yield pa.array(rows, _RESULT)

    tag.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf("pii array<struct<kind:string,begin:int,end:int,pii_text:string>>, redacted string")(tag).asNondeterministic()  # else it is evaluated once more in a filter


def redact(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs`` with ``pii`` (spans) and ``redacted`` (text with ``[EMAIL]`` and the like)."""
    if clash := {"pii", "redacted"} & set(docs.columns):
        raise ValueError(f"columns already there: {sorted(clash)}")
    got = docs.withColumn("__r", _tagger(weights())(F.col(text)))
    return got.select(*[F.col(f"`{c}`") for c in docs.columns], "__r.pii", "__r.redacted")


def found(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Distinct (key, kind, pii_text)."""
    got = docs.select(F.col(key), F.col(text)).where(F.length(text) > 0)
    got = got.withColumn("__r", _tagger(weights())(F.col(text))).select(key, F.explode("__r.pii").alias("p"))
    return got.select(key, "p.kind", "p.pii_text").distinct()
