"""Fits the line classifier: ``python -m tamiz.llm.boilerplate_train READ_CORPUS.parquet``.

At most ``MAX_PAGES`` pages are read; a fifth is held out.  Labels are those of
:mod:`tamiz.llm.boilerplate_labels`; both logistic regressions are fitted by Adam in numpy.
"""

from __future__ import annotations

import random
import sys
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from tamiz.llm import boilerplate as bp
from tamiz.llm import boilerplate_labels as lab

MAX_PAGES, LEAST = 8000, 8
OUT = Path(__file__).with_name("boilerplate_weights.npz")


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.k = p, rate, 0
        self.m, self.v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, g: dict, rate: float) -> None:
        self.k += 1
        for k, d in g.items():
            self.m[k] = 0.9 * self.m[k] + 0.1 * d
            self.v[k] = 0.99 * self.v[k] + 0.01 * d * d
            self.p[k] -= self.rate * rate * (self.m[k] / (1 - 0.9**self.k)) / (np.sqrt(self.v[k] / (1 - 0.99**self.k)) + 1e-8)


def _targets(pages: list[str], menu: set[str]) -> np.ndarray:
    out = []
    for t in pages:
        for s, y in zip(map(lab.tidy, t.split("\n")), lab.labels(t, menu)):
            if y >= 0:
                out.append((y, bool(lab.RELATED.match(s)) and y, bool(lab.BYLINE.match(s))))
    return np.array(out, np.float32)


def main(path: str) -> None:
    import pandas as pd

    pages = [t for t in pd.read_parquet(path, columns=["text"]).text.dropna().head(MAX_PAGES) if t.strip()]
    menu = lab.menu_words(pages)
    random.Random(3).shuffle(pages)
    held, pages = pages[: len(pages) // 5], pages[len(pages) // 5 :]
    lines, y = bp.Lines(pa.array(pages)), _targets(pages, menu)
    assert len(lines.at) == len(y)
    shape = bp.shapes(lines.distinct)
    words, code, off = bp.words_of(lines.distinct)
    count = np.bincount(code, minlength=len(words))
    kept = np.flatnonzero(count >= LEAST)
    row = np.full(len(words), len(kept))
    row[kept] = np.arange(len(kept))
    code = row[code]
    u, v = len(lines.distinct), len(kept)
    line_of = np.repeat(np.arange(u), np.diff(off))
    full = np.flatnonzero(off[1:] > off[:-1])
    first, last = code[off[:-1][full]], code[off[1:][full] - 1]
    weight = np.bincount(lines.code, minlength=u).astype(np.float32)
    target = np.stack([np.bincount(lines.code, weights=y[:, k], minlength=u) / weight for k in range(3)], 1)
    wt = np.sqrt(weight)[:, None] / np.sqrt(weight).sum()
    p = {k: np.zeros((v + 1, 3)) for k in ("W", "Wf", "Wl")} | {"S": np.zeros((shape.shape[1], 3)), "b": np.zeros(3)}
    opt, rounds = Adam(p, 0.08), 250
    for i in range(rounds):
        z = shape @ p["S"] + p["b"]
        for k in range(3):
            z[:, k] += np.bincount(line_of, weights=p["W"][code, k], minlength=u)
        z[full] += p["Wf"][first] + p["Wl"][last]
        d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - target) * wt
        g = {"S": shape.T @ d, "b": d.sum(0)}
        for name, at, rows in (("W", code, line_of), ("Wf", first, full), ("Wl", last, full)):
            g[name] = np.stack([np.bincount(at, weights=d[rows, k], minlength=v + 1) for k in range(3)], 1) + 3e-7 * p[name]
        opt.step(g, 0.1 + 0.9 * (1 - i / rounds))
    model = {k: x.astype(np.float32) for k, x in p.items()} | {"vocab": words.take(pa.array(kept))}
    z = bp.scores_of(model, lines.distinct, shape)[lines.code]
    print("line scores alone:", float(((z[:, 0] > 0) == (y[:, 0] > 0.5)).mean()))
    x = bp.context(z, shape[lines.code], lines.page, lines.number).astype(np.float64)
    q = {"C": np.zeros(x.shape[1]), "c": np.zeros(1)}
    opt, rounds = Adam(q, 0.08), 500
    for i in range(rounds):
        d = (1 / (1 + np.exp(-np.clip(x @ q["C"] + q["c"], -30, 30))) - y[:, 0]) / len(y)
        opt.step({"C": x.T @ d + 1e-6 * q["C"], "c": d.sum(keepdims=True)}, 0.1 + 0.9 * (1 - i / rounds))
    model |= {"C": q["C"].astype(np.float32), "c": q["c"].astype(np.float32)}
    np.savez_compressed(OUT, vocab=np.array(model["vocab"].to_pylist()), **{k: v.astype(np.float16) for k, v in model.items() if k != "vocab"})
    print("vocabulary", v, "with context:", float(((x @ q["C"] + q["c"] > 0) == (y[:, 0] > 0.5)).mean()))
    report(bp.load(OUT.read_bytes()), held, menu)


def report(model: dict, pages: list[str], menu: set[str], show: int = 0) -> None:
    lines, cut = bp.furniture(model, pa.array(pages))
    y = _targets(pages, menu)[:, 0] > 0.5
    hit = (cut & y).sum()
    print(f"held out {len(pages)} pages, {len(y)} lines: precision {hit / cut.sum():.5f} recall {hit / y.sum():.5f}")
    text = lines.distinct.take(pa.array(lines.code)).to_pylist()
    for i in np.flatnonzero(cut != y)[:show]:
        same = [j for j in range(max(0, i - 2), min(len(text), i + 3)) if lines.page[j] == lines.page[i]]
        print("cut " if cut[i] else "kept", [("" if j != i else "*") + text[j][:60] for j in same])


if __name__ == "__main__":
    main(sys.argv[1])
