"""Tokenisers, stemmers, codecs and URLs against plain Python."""

from __future__ import annotations

import random
import re

import numpy as np
import pytest
from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from tamiz.functions import codec, stem, urls
from tamiz.functions import text as tx

SAMPLES = ["hola chau rojo azul", "", "Año nuevo, x² ½ ⅷ áb", "ver http://a.b.com/x?y=1#z y mail a.b@c.org, tel 011-4444-5555 el 12/03/2021", "EE.UU. y la NASA: Juan Perez 3,14 El Sol", None]


def _cascade(t: str) -> dict[str, list[str]]:
    """The cascade in Python, with the patterns of the module."""
    import regex

    out = {}
    for name, p in (("email", tx.EMAIL), ("url", tx.URL), ("date", tx.DATE), ("phone", tx.PHONE[2]), ("number", tx.NUMBER), ("abbreviation", tx.ABBREVIATION[2]), ("acronym", tx.ACRONYM), ("name", tx.PROPER_NAME)):
        out[name] = regex.findall(p, t)
        t = regex.sub(p, "", t)
    return out | {"letters": regex.findall(tx.LETTERS, t.lower())}


GOLDEN = {
    "ver http://a.b.com/x?y=1#z y mail a.b@c.org, tel 011-4444-5555 el 12/03/2021": {"email": ["a.b@c.org"], "url": ["http://a.b.com/x?y=1#z"], "date": ["12/03/2021"], "phone": ["011-4444-5555"], "letters": ["ver", "y", "mail", "tel", "el"]},
    "EE.UU. y la NASA: Juan Perez 3,14 El Sol": {"number": ["3,14"], "abbreviation": [], "acronym": ["EE", "UU", "NASA"], "name": ["Juan Perez", "El Sol"], "letters": ["y", "la"]},
    "Av. Q. 99 y Dr. Año": {"number": ["99"], "abbreviation": ["Av.", "Q.", "Dr."], "name": [], "letters": ["y", "año"]},
}


@pytest.mark.parametrize("text", GOLDEN)
def test_cascade_golden(spark, text):
    cols = tx.structured("text")
    got = spark.createDataFrame([(text,)], "text string").select(*[c.alias(k) for k, c in cols.items()]).first()
    steps = tx.structured_columns(spark.createDataFrame([(text,)], "text string"), "text").first()
    for k, want in GOLDEN[text].items():
        assert got[k] == want and steps[k] == want, k


def test_tokens(spark):
    df = spark.createDataFrame([(i, t) for i, t in enumerate(SAMPLES)], "i int, text string")
    got = {r[0]: r[1] for r in df.select("i", tx.tokens("text")).collect()}
    for i, t in enumerate(SAMPLES):
        assert got[i] == (None if t is None else re.findall(r"[^\W\d_]+", t.lower()))


def test_cascade_matches_python(spark):
    rnd = random.Random(4)
    bits = ["NASA", "Juan Perez", "12/03/2021", "a.b@c.org", "http://a.b/c", "3,14", "EE.UU.", "x", "²", " ", "-", "año", "11-4444", "+54 11 4444", "\n", "_", "É", "Q.", "99"]
    texts = [t for t in SAMPLES if t is not None] + ["".join(rnd.choice(bits) + rnd.choice(["", " "]) for _ in range(12)) for _ in range(150)]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, text string")
    cols = tx.structured("text")
    for r in df.select("i", *[c.alias(k) for k, c in cols.items()]).collect():
        want = _cascade(texts[r.i])
        assert {k: r[k] for k in cols} == want, texts[r.i]


@pytest.mark.parametrize(
    ("f", "pairs"),
    [
        (stem.porter, "caresses:caress ponies:poni cats:cat feed:feed agreed:agre plastered:plaster motoring:motor sing:sing conflated:conflat hopping:hop falling:fall filing:file happy:happi sky:sky relational:relat conditional:condit digitizer:digit operator:oper triplicate:triplic formalize:formal hopeful:hope revival:reviv allowance:allow adoption:adopt probate:probat rate:rate controll:control roll:roll"),
        (stem.lancaster, "maximum:maxim presumably:presum multiply:multiply provision:provid owed:ow ear:ear saying:say crying:cry string:string meant:meant cement:cem"),
        (stem.spanish, "chica:chic chicas:chic cheposo:chepos torreón:torreon torneros:torner comiendo:com lógica:logic lentamente:lent comprándolo:compr"),
    ],
)
def test_stemmers(f, pairs):
    for p in pairs.split():
        w, s = p.split(":")
        assert f(w) == s, w


def test_stems_of_distinct_terms(spark):
    df = spark.createDataFrame([("gatos",), ("gatos",), (None,), ("",)], "term string")
    assert rows(stem.stems(df, "spanish")) == [("", ""), ("gatos", "gat")]


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(0, 1 << 40), max_size=40))
def test_vbyte_roundtrip(values):
    assert list(codec.vbyte_decode(codec.vbyte_encode(np.array(values, np.int64)))) == values


def test_vbyte_bytes():
    assert codec.vbyte_encode(np.array([0, 127, 128, 16383, 16384])) == bytes([0x80, 0xFF, 0x01, 0x80, 0x7F, 0xFF, 0x01, 0x00, 0x80])
    with pytest.raises(ValueError):
        codec.vbyte_decode(bytes([1]))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.integers(1, 1 << 30), max_size=30))
def test_gamma_and_hybrid_roundtrip(values):
    v = np.array(values, np.int64)
    assert list(codec.gamma_decode(codec.gamma_encode(v), len(v))) == values
    g, f = codec.hybrid_decode(codec.hybrid_encode(v * 3, v), len(v))
    assert list(g) == [3 * x for x in values] and list(f) == values


def test_gamma_errors():
    with pytest.raises(ValueError):
        codec.gamma_encode(np.array([0]))
    with pytest.raises(EOFError):
        codec.gamma_decode(b"\x00", 1)


def test_posting_list_codec(spark):
    p = spark.createDataFrame([("a", d, f) for d, f in [(0, 3), (5, 1), (100, 7), (101, 2), (5000, 10), (200_000, 1)]], "term string, doc_id bigint, tf bigint")
    for gapped in (True, False):
        assert rows(codec.decompressed(codec.compressed(p, gapped), gapped)) == rows(p)


def test_urls(spark):
    data = ["http://u@a.b:80/x/y.html?q=1#f", "https://h/a.tar/b", "/rel/p.PHP", "nonsense ^^", "http://h", "", None, "HTTP://H/d/?x"]
    df = spark.createDataFrame([(u,) for u in data], "u string")
    got = df.select(urls.authority("u"), urls.depth("u"), urls.extension("u"), urls.query("u"), urls.page_class("u"), urls.web_scheme("u")).collect()
    assert [tuple(r) for r in got[:6]] == [("u@a.b:80", 2, "html", "q=1", "dynamic", True), ("h", 2, "tar/b", "", "unknown", True), ("", 2, "php", "", "dynamic", False), ("", 1, "", "", "static", False), ("h", 0, "", "", "static", True), ("", 0, "", "", "static", False)]
    s = F.array(F.lit("a.b"))
    sub = spark.createDataFrame([("http://x.a.b/",), ("http://a.b/",), ("http://ca.b/",)], "u string").select(urls.under_seed("u", s)).collect()
    assert [r[0] for r in sub] == [True, True, False]
