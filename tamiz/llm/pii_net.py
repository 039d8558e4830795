"""Character BiLSTM with CRF transitions in numpy: shared forward pass and batched Viterbi.

A character enters as the sum of two learned rows, one of its folded letter and one of its class
(lower, upper, digit, blank, mark, other), so that upper-case spellings share what is learned for
lower case.  Both rows already hold the input weights of the four gates, so a step costs one
``h @ U`` product only.
"""

from __future__ import annotations

import unicodedata
from functools import lru_cache

import numpy as np

from tamiz.llm.pii_labels import KINDS

TAGS = 1 + 2 * len(KINDS)  # O, then B and I of each kind
#: fixed values: the characters with a row of their own; row 0 is any other
LETTERS = "abcdefghijklmnopqrstuvwxyz0123456789 \t.,;:!?¡¿'\"’“”«»()[]{}<>@+-_/\\|=*&%$#ºª°·•…–—~^`áéíóúàèìòùâêîôûäëïöüãõñçœæß"
PAD = len(LETTERS) + 1
N_LETTER, N_CLASS = PAD + 1, 7


def _class(c: str) -> int:
    if c.isupper():
        return 1
    if c.islower():
        return 2
    if c.isdigit():
        return 3
    if c.isspace():
        return 4
    return 5 if unicodedata.category(c)[0] in "PS" else 6


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    n = 0x3000
    letter, cls = np.zeros(n + 1, np.int16), np.full(n + 1, 6, np.int8)
    rows = {c: i + 1 for i, c in enumerate(LETTERS)}
    for i in range(n):
        c = chr(i)
        low = c.lower()
        letter[i] = rows.get(c, rows.get(low if len(low) == 1 else c, 0))
        cls[i] = _class(c)
    letter[10] = letter[13] = rows[" "]
    letter[0xA0] = rows[" "]
    return letter, cls


def encode(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Letter rows and classes of each code point."""
    letter, cls = _tables()
    code = np.minimum(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32), 0x3000)
    return letter[code], cls[code]


def allowed() -> np.ndarray:
    """Additive mask: I of a kind follows only B or I of that kind."""
    m = np.zeros((TAGS, TAGS), np.float32)
    for k in range(len(KINDS)):
        i = 2 + 2 * k
        m[:, i] = -1e4
        m[i - 1, i] = m[i, i] = 0
    return m


def start_mask() -> np.ndarray:
    m = np.zeros(TAGS, np.float32)
    m[2::2] = -1e4
    return m


def fuse(p: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Inference parameters: one row per (letter, class), sigmoids as tanh(x / 2)."""
    h = p["Uf"].shape[0]
    half = np.concatenate([np.full(3 * h, 0.5, np.float32), np.ones(h, np.float32)])
    out = {}
    for d in "fb":
        x = (p["L" + d][:, None, :] + p["C" + d][None, :, :] + p["b" + d]).reshape(-1, 4 * h)
        out["X" + d], out["U" + d] = np.ascontiguousarray(x * half, np.float32), np.ascontiguousarray(p["U" + d] * half, np.float32)
    out |= {k: p[k].astype(np.float32) for k in ("W", "c", "T", "s")}
    out["T"], out["s"] = out["T"] + allowed(), out["s"] + start_mask()
    return out


def emissions(q: dict[str, np.ndarray], ids: np.ndarray) -> np.ndarray:
    """ids: (T, B) fused rows; gives (T, B, TAGS)."""
    t, b = ids.shape
    h = q["Uf"].shape[0]
    out = np.empty((t, b, TAGS), np.float32)
    out[:] = q["c"]
    for d, steps in (("f", range(t)), ("b", range(t - 1, -1, -1))):
        x, u, w = q["X" + d], q["U" + d], q["W"][:h] if d == "f" else q["W"][h:]
        hs, c = np.zeros((b, h), np.float32), np.zeros((b, h), np.float32)
        for i in steps:
            z = hs @ u
            z += x[ids[i]]
            np.tanh(z, out=z)
            g = z[:, : 3 * h]
            g *= 0.5
            g += 0.5
            c *= z[:, h : 2 * h]
            c += z[:, :h] * z[:, 3 * h :]
            hs = np.tanh(c)
            hs *= z[:, 2 * h : 3 * h]
            out[i] += hs @ w
    return out


def viterbi(q: dict[str, np.ndarray], e: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Best tags (T, B) of emissions (T, B, TAGS) with true lengths n; positions past the length are O."""
    t, b, k = e.shape
    tr = q["T"]
    back = np.empty((t, b, k), np.int8)
    v = e[0] + q["s"]
    for i in range(1, t):
        s = v[:, :, None] + tr
        back[i] = s.argmax(1)
        v = np.where((i < n)[:, None], s.max(1) + e[i], v)
    tags = np.zeros((t, b), np.int8)
    cur, rows = v.argmax(1), np.arange(b)
    for i in range(t - 1, -1, -1):
        live = i < n
        tags[i] = np.where(live, cur, 0)
        if i:
            cur = np.where(live, back[i, rows, cur], cur)
    return tags


def surely_blank(q: dict[str, np.ndarray], e: np.ndarray) -> np.ndarray:
    """Columns whose best path is O throughout, by a bound on what transitions can add (exact)."""
    tr, s = q["T"], q["s"]
    gain = 2 * max(float((tr - tr[0, 0]).max()), 0.0) + max(float((s - s[0]).max()), 0.0)
    return ((e[:, :, 0] - e[:, :, 1:].max(2)).min(0)) > gain
