"""Trains the tagger: ``python -m tamiz.llm.pii_train DOCUMENTS.parquet [SECONDS [RATE]]``; a rate continues from the stored weights.

Labels are weak ones (:mod:`tamiz.llm.pii_labels`) on at most ``MAX_DOCS`` documents, one in ten of
which is held out, with generated values in part of them and generated lines beside them (:mod:`tamiz.llm.pii_values`;
given names also from ``name_hints.parquet`` beside the documents).  Gradients of the BiLSTM and of the CRF are written out; Adam updates.
Writes ``pii_weights.npz`` beside this file.
"""

from __future__ import annotations

import random
import re
import sys
import time
from pathlib import Path

import numpy as np

from tamiz.llm import pii_net as net
from tamiz.llm import pii_values
from tamiz.llm.pii_labels import KINDS, augment, spans

MAX_DOCS, HIDDEN, WINDOW, BATCH, SEED = 10_000, 48, 176, 160, 7
OUT = Path(__file__).with_name("pii_weights.npz")


def split(texts: list[str]) -> tuple[list, list]:
    """Lines with spans and lines without."""
    some, none = [], []
    for t in texts:
        for line in t.split("\n"):
            if line.strip():
                (some if (s := spans(line)) else none).append((line, s))
    return some, none


def sample(texts: list[str], rnd: random.Random) -> list[tuple[str, list[tuple[int, int, str]]]]:
    """Lines with spans, and nearly as many without."""
    some, none = split(texts)
    rnd.shuffle(none)
    return some + none[: int(0.8 * len(some))]


def lookalikes(none: list) -> list:
    """Lines without spans that have long numbers, capitals in a row, capitals after the first word, or a mail sign."""
    return [x for x in none if re.search(r"\d\W?\d{4}|\d{3}\W\d{3}|[A-Z]{4}|@|[a-z»] \(?[A-ZÀ-Ý]", x[0])] or none


def revalued(line: str, found: list, rnd: random.Random, hints: list[str]) -> tuple[str, list]:
    """The line with some of its names, phones, and addresses replaced by generated ones."""
    out, new, at = "", [], 0
    for a, b, kind in found:
        v = line[a:b]
        if rnd.random() < 0.15:
            if kind == "name" and " " in v and "," not in v:
                v = pii_values.name(rnd, hints)
            elif kind == "phone" and v[:1] in "+(0":
                v = pii_values.digits(rnd.choice(pii_values.PHONES), rnd)
            elif kind == "email" and "@" in v:
                v = pii_values.email(rnd)
        out += line[at:a]
        new.append((len(out), len(out) + len(v), kind))
        out, at = out + v, b
    return out + line[at:], new


def window(line: str, found: list, rnd: random.Random) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    line, found = augment(line, found, rnd)
    a = 0
    if len(line) > WINDOW:
        a = rnd.randint(0, len(line) - WINDOW)
        if found and rnd.random() < 0.9:
            x = rnd.choice(found)
            a = min(max(0, x[0] - rnd.randint(0, WINDOW - 60)), len(line) - WINDOW)
    letter, cls = net.encode(line)
    tag = np.zeros(len(line), np.int8)
    for x, y, kind in found:
        k = KINDS.index(kind)
        tag[x:y], tag[x] = 2 + 2 * k, 1 + 2 * k
    tag = tag[a : a + WINDOW]
    if a and tag[0] and tag[0] % 2 == 0:  # a span cut by the window's edge
        n = next((i for i, v in enumerate(tag) if v != tag[0]), len(tag))
        tag[:n] = 0
        letter = letter.copy()
        a2 = a + n
        return letter[a2 : a + WINDOW], cls[a2 : a + WINDOW], tag[n:]
    return letter[a : a + WINDOW], cls[a : a + WINDOW], tag


def batch(items: list, rnd: random.Random):
    w = [x for x in (window(l, s, rnd) for l, s in items) if len(x[0])]
    t = max(len(x[0]) for x in w)
    ids, cls, tag, n = np.full((t, len(w)), net.PAD, np.int16), np.zeros((t, len(w)), np.int8), np.zeros((t, len(w)), np.int8), np.array([len(x[0]) for x in w])
    for j, (a, b, c) in enumerate(w):
        ids[: len(a), j], cls[: len(a), j], tag[: len(a), j] = a, b, c
    return ids, cls, tag, n


def init(rnd: np.random.Generator) -> dict[str, np.ndarray]:
    h = HIDDEN
    p = {}
    for d in "fb":
        p["L" + d] = rnd.normal(0, 0.3, (net.N_LETTER, 4 * h))
        p["C" + d] = rnd.normal(0, 0.3, (net.N_CLASS, 4 * h))
        p["U" + d] = rnd.normal(0, h**-0.5, (h, 4 * h))
        p["b" + d] = np.concatenate([np.zeros(h), np.ones(h), np.zeros(2 * h)])
    p |= {"W": rnd.normal(0, 0.1, (2 * h, net.TAGS)), "c": np.eye(net.TAGS)[0] * 2, "T": np.zeros((net.TAGS, net.TAGS)), "s": np.zeros(net.TAGS)}
    return {k: v.astype(np.float32) for k, v in p.items()}


def _sig(x):
    return 0.5 * np.tanh(0.5 * x) + 0.5


def lstm(p, d, ids, cls, live):
    t, b = ids.shape
    h = HIDDEN
    x = p["L" + d][ids] + p["C" + d][cls] + p["b" + d]
    hs, cs = np.zeros((t + 1, b, h), np.float32), np.zeros((t + 1, b, h), np.float32)
    gates = np.empty((t, b, 4 * h), np.float32)
    for i in range(t):
        z = x[i] + hs[i] @ p["U" + d]
        z[:, : 3 * h] = _sig(z[:, : 3 * h])
        z[:, 3 * h :] = np.tanh(z[:, 3 * h :])
        gates[i] = z
        m = live[i][:, None]
        cs[i + 1] = m * (z[:, h : 2 * h] * cs[i] + z[:, :h] * z[:, 3 * h :])
        hs[i + 1] = m * z[:, 2 * h : 3 * h] * np.tanh(cs[i + 1])
    return hs, cs, gates


def lstm_back(p, g, d, ids, cls, live, hs, cs, gates, dout):
    t, b = ids.shape
    h = HIDDEN
    dz = np.empty_like(gates)
    dh, dc = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
    for i in range(t - 1, -1, -1):
        z, m = gates[i], live[i][:, None]
        dh = (dh + dout[i]) * m
        tc = np.tanh(cs[i + 1])
        dc = (dc + dh * z[:, 2 * h : 3 * h] * (1 - tc * tc)) * m
        q = dz[i]
        q[:, :h] = dc * z[:, 3 * h :] * z[:, :h] * (1 - z[:, :h])
        q[:, h : 2 * h] = dc * cs[i] * z[:, h : 2 * h] * (1 - z[:, h : 2 * h])
        q[:, 2 * h : 3 * h] = dh * tc * z[:, 2 * h : 3 * h] * (1 - z[:, 2 * h : 3 * h])
        q[:, 3 * h :] = dc * z[:, :h] * (1 - z[:, 3 * h :] ** 2)
        dc = dc * z[:, h : 2 * h]
        dh = q @ p["U" + d].T
    flat = dz.reshape(-1, 4 * h)
    g["U" + d] = hs[:-1].reshape(-1, h).T @ flat
    g["b" + d] = flat.sum(0)
    for name, at, rows in (("L", ids, net.N_LETTER), ("C", cls, net.N_CLASS)):
        one = np.zeros((rows, flat.shape[0]), np.float32) if rows < 16 else None
        if one is not None:
            one[at.reshape(-1), np.arange(flat.shape[0])] = 1
            g[name + d] = one @ flat
        else:
            order = np.argsort(at.reshape(-1), kind="stable")
            srt = at.reshape(-1)[order]
            first = np.flatnonzero(np.r_[True, srt[1:] != srt[:-1]])
            out = np.zeros((rows, 4 * h), np.float32)
            out[srt[first]] = np.add.reduceat(flat[order], first, 0)
            g[name + d] = out


def _lse(x, axis):
    m = x.max(axis, keepdims=True)
    return (np.log(np.exp(x - m).sum(axis, keepdims=True)) + m).squeeze(axis)


def crf(p, g, e, tag, n, live):
    """Mean negative log-likelihood and its gradient with respect to e."""
    t, b, k = e.shape
    tr, st = p["T"] + net.allowed(), p["s"] + net.start_mask()
    a, z = np.empty((t, b, k), np.float32), np.zeros((t, b, k), np.float32)
    a[0] = e[0] + st
    for i in range(1, t):
        a[i] = np.where(live[i][:, None], _lse(a[i - 1][:, :, None] + tr, 1) + e[i], a[i - 1])
    for i in range(t - 2, -1, -1):
        z[i] = np.where(live[i + 1][:, None], _lse(tr + (e[i + 1] + z[i + 1])[:, None, :], 2), 0)
    total = _lse(a[-1], 1)
    de = np.exp(a + z - total[None, :, None]) * live[:, :, None]
    rows = np.arange(b)
    gold = e[0, rows, tag[0]] + st[tag[0]]
    gt, gs = np.zeros((k, k), np.float32), de[0].sum(0)
    np.add.at(gs, tag[0], -1)
    for i in range(1, t):
        pair = np.exp(a[i - 1][:, :, None] + tr + (e[i] + z[i])[:, None, :] - total[:, None, None]) * live[i][:, None, None]
        gt += pair.sum(0)
        m = live[i]
        np.add.at(gt, (tag[i - 1][m], tag[i][m]), -1)
        gold += m * (e[i, rows, tag[i]] + tr[tag[i - 1], tag[i]])
    ti, bi = np.nonzero(live)
    de[ti, bi, tag[ti, bi]] -= 1
    g["T"], g["s"] = gt, gs
    return float((total - gold).mean()), de


def step(p, ids, cls, tag, n):
    t, b = ids.shape
    live = np.arange(t)[:, None] < n[None, :]
    f = lstm(p, "f", ids, cls, live)
    r = lstm(p, "b", ids[::-1], cls[::-1], live[::-1])
    both = np.concatenate([f[0][1:], r[0][1:][::-1]], 2)
    e = both @ p["W"] + p["c"]
    g: dict[str, np.ndarray] = {}
    loss, de = crf(p, g, e, tag, n, live)
    flat = de.reshape(-1, net.TAGS)
    g["W"], g["c"] = both.reshape(-1, 2 * HIDDEN).T @ flat, flat.sum(0)
    db = de @ p["W"].T
    lstm_back(p, g, "f", ids, cls, live, *f, db[:, :, :HIDDEN])
    lstm_back(p, g, "b", ids[::-1], cls[::-1], live[::-1], *r, db[::-1, :, HIDDEN:])
    return loss, {k: v / b for k, v in g.items()}


def f1(p, items) -> tuple[float, float, float]:
    from tamiz.llm.pii import tag_lines

    hit = got = want = 0
    for (line, s), found in zip(items, tag_lines(net.fuse(p), [l for l, _ in items])):
        a, b = set(s), set(found)
        hit, got, want = hit + len(a & b), got + len(b), want + len(a)
    return hit / max(got, 1), hit / max(want, 1), 2 * hit / max(got + want, 1)


def main(path: str, seconds: float = 300, rate: float = 0) -> None:
    import pandas as pd

    rnd, nrnd = random.Random(SEED), np.random.default_rng(SEED)
    texts = [t for t in pd.read_parquet(path, columns=["text"]).text.dropna().head(MAX_DOCS) if t]
    near = Path(path).with_name("name_hints.parquet")
    hints = [str(x) for x in pd.read_parquet(near).given_name.dropna()] if near.exists() else []
    rnd.shuffle(texts)
    held, (some, none) = sample(texts[: len(texts) // 10], rnd), split(texts[len(texts) // 10 :])
    hard = lookalikes(none)
    print(len(some), len(none), len(hard), "lines,", len(held), "held out", flush=True)
    p = init(nrnd)
    if rate:
        with np.load(OUT) as z:
            p = {q: z[q].astype(np.float32) for q in z.files}
    m, v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}
    began, k, epoch = time.time(), 0, 0
    while (done := (time.time() - began) / seconds) < 1:
        items = [revalued(*x, rnd, hints) for x in some] + rnd.choices(none, k=len(some) // 2) + (rnd.choices(hard, k=len(some) // 2) if rate else [])
        items += [pii_values.line(rnd, hints) for _ in range(len(some) // 5)]
        rnd.shuffle(items)
        losses = []
        for i in range(0, len(items), BATCH):
            done = (time.time() - began) / seconds
            if done >= 1:
                break
            now = (rate or 8e-3) * min(1, (k + 1) / 30) * (0.03 + 0.97 * 0.5 * (1 + np.cos(np.pi * done)))
            loss, g = step(p, *batch(items[i : i + BATCH], rnd))
            norm = float(np.sqrt(sum((x * x).sum() for x in g.values())))
            k += 1
            for q in p:
                d = g[q] * min(1, 5 / norm)
                m[q] = 0.9 * m[q] + 0.1 * d
                v[q] = 0.99 * v[q] + 0.01 * d * d
                p[q] = p[q] - (now * (m[q] / (1 - 0.9**k)) / (np.sqrt(v[q] / (1 - 0.99**k)) + 1e-8)).astype(np.float32)
            losses.append(loss)
        epoch += 1
        print(f"epoch {epoch} step {k} {time.time() - began:.0f}s loss {np.mean(losses):.3f} held-out P R F1", *(f"{x:.4f}" for x in f1(p, held[:600])), flush=True)
        np.savez_compressed(OUT, **{q: x.astype(np.float16) for q, x in p.items()})
    print("held-out P R F1", *(f"{x:.4f}" for x in f1(p, held)))


if __name__ == "__main__":
    main(sys.argv[1], *map(float, sys.argv[2:]))
