"""Main bodies, near duplicates, encoding, mixing, personal information."""

from __future__ import annotations

import random
import re
import time
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F

from tamiz import session
from tamiz.llm import boilerplate as bp
from tamiz.llm import mincut, mixing, neardup, pii, pii_labels, pii_net, tokenizer

PAGE = "Inicio · Foro · Ayuda\nInicio > Notas > Bapel\n\nLa consulta larga resume el bloque ordenado\nPor Redacción Pegaulm, 2024-05-01\nEl disco externo conserva la lista de documentos con cuatro procesos. La cátedra revisa todo.\n\nLo más leído\nLa tabla de saltos ordena el disco externo\nEl tokenizador nuevo reduce la cola de descarga\n\n© 2021 Pegaulm. Todos los derechos reservados."


def test_minimum_cut_against_all_labelings():
    rng = np.random.default_rng(0)
    for _ in range(200):
        n = int(rng.integers(1, 9))
        ex, e1, e2 = rng.integers(-9, 10, n), rng.integers(0, 6, n), rng.integers(0, 4, n)
        e1[n - 1 :], e2[max(n - 2, 0) :] = 0, 0

        def cost(m):
            own = sum(max(ex[i], 0) if not m[i] else max(-ex[i], 0) for i in range(n))  # noqa: B023
            return own + sum(e1[i] for i in range(n - 1) if m[i] != m[i + 1]) + sum(e2[i] for i in range(n - 2) if m[i] != m[i + 2])  # noqa: B023

        best = min(cost([(k >> i) & 1 for i in range(n)]) for k in range(1 << n))
        assert cost(list(mincut.source_side(ex, e1, e2))) == best
    assert len(mincut.source_side(np.array([], int), np.array([], int), np.array([], int))) == 0


def test_cuts_of_many_graphs_are_those_of_each():
    rng = np.random.default_rng(1)
    parts = []
    for _ in range(60):
        n = int(rng.integers(1, 30))
        ex, e1, e2 = rng.integers(-5, 6, n), rng.integers(0, 6, n), rng.integers(0, 4, n)
        e1[n - 1 :], e2[max(n - 2, 0) :] = 0, 0
        parts.append((ex, e1, e2))
    whole = mincut.source_side(*(np.concatenate([p[i] for p in parts]) for i in range(3)))
    assert (whole == np.concatenate([mincut.source_side(*p) for p in parts])).all()


def test_graphs_alone_give_the_same_cuts():
    rng = np.random.default_rng(2)
    for _ in range(150):
        n = int(rng.integers(1, 40))
        ex, e1, e2 = rng.integers(-9, 10, n), rng.integers(0, 6, n), rng.integers(0, 4, n)
        e1[n - 1 :], e2[max(n - 2, 0) :] = 0, 0
        one = mincut.alone(np.maximum(ex, 0), np.maximum(-ex, 0), e1[: n - 1], e1[: n - 1], e2[: max(n - 2, 0)], e2[: max(n - 2, 0)])
        assert (one == mincut.source_side(ex, e1, e2)).all()


@pytest.mark.parametrize("kind", ["one sink", "many sinks", "random"])
def test_long_chains_take_linear_time(kind):
    n = 20_000
    ex = np.ones(n, np.int64)
    if kind == "one sink":
        ex[-1] = -9_000
    elif kind == "many sinks":
        ex[n // 2 :] = -1
    else:
        ex = np.random.default_rng(0).integers(-9000, 9000, n)
    e1, e2 = np.full(n, 5_000), np.full(n, 250)
    e1[-1], e2[-2:] = 0, 0
    began = time.process_time()
    cut = mincut.source_side(ex, e1, e2)
    assert time.process_time() - began < 4
    assert cut.any()


def test_furniture_of_a_page(spark):
    text = "rec_no bigint, text string, line_no int, body string"
    df = spark.createDataFrame([(1, PAGE, 9, ""), (2, None, 9, ""), (3, "", 9, ""), (4, " \n\t\n", 9, ""), (5, PAGE.replace("\n", "\r\n"), 9, ""), (None, PAGE, 9, ""), (1, PAGE, 9, "")], text)
    want = {0, 1, 7, 8, 9, 11}
    got = rows(bp.found(df))
    for key, times in ((1, 2), (5, 1), (None, 1)):
        assert sorted(x for k, x in got if k == key) == sorted(list(want) * times)
    assert not {k for k, _ in got} & {2, 3, 4}
    assert rows(bp.found(df.where("false"))) == []
    body = {r[0]: r[1] for r in bp.main_bodies(df.where("rec_no > 0")).collect()}
    assert body[2] is None and body[3] == "" and body[4] == ""
    assert body[1].split("\n")[0] == "La consulta larga resume el bloque ordenado" and "©" not in body[1]


def test_long_tags_and_entities_are_not_text():
    link = '<a href="http://x.example/' + "y" * 300 + '" title="z">'
    lines = bp.Lines(pa.array([f"{link}Inicio</a> · Foro\nR&amp;D &laquo;uno&raquo;&nbsp;\n&nbsp;\na < b y c > d"]))
    assert lines.distinct.to_pylist() == ["Inicio · Foro", "R&D «uno»", "a < b y c > d"]


def test_very_long_page():
    long = "\n".join([PAGE] * 400) + "\n" + "palabra " * 50_000
    lines, cut = bp.furniture(bp.load(bp.weights()), pa.array([long, "x"]))
    assert len(cut) == len(lines.at) and 400 < cut.sum() < len(cut)


def test_held_out_pages_agree_with_labels(small):
    import pandas as pd

    from tamiz.llm import boilerplate_labels as lab

    pages = [t for t in pd.read_parquet(small.replace("0.001", "0.01") + "/read_corpus.parquet").text.dropna() if t.strip()]
    menu = lab.menu_words(pages, 4)
    lines, cut = bp.furniture(bp.load(bp.weights()), pa.array(pages))
    y = np.array([x for t in pages for x in lab.labels(t, menu) if x >= 0], bool)
    assert (cut & y).sum() / cut.sum() > 0.98 and (cut & y).sum() / y.sum() > 0.98


def _sets(texts: dict, k: int = 3) -> dict:
    out = {}
    for r, t in texts.items():
        w = re.findall(r"[^\W_]+", (t or "").lower())
        if s := {tuple(w[i : i + k]) for i in range(len(w) - k + 1)}:
            out[r] = s
    return out


def _brute(sets: dict, t: float) -> set:
    keys = sorted(sets)
    return {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= t * len(sets[a] | sets[b])}


def _edited(seed: int, n: int) -> dict:
    rnd = random.Random(seed)
    base = [[f"w{rnd.randint(0, 60)}" for _ in range(rnd.randint(3, 60))] for _ in range(n // 5)]
    out = {}
    for i in range(n):
        w = list(rnd.choice(base))
        for _ in range(rnd.randint(0, len(w) // 4)):
            w[rnd.randrange(len(w))] = f"w{rnd.randint(0, 60)}"
        out[i] = " ".join(w)
    return out | {9001: None, 9002: "", 9003: "w1 w2", 9004: " ".join(f"v{i}" for i in range(20_000)), 9005: " ".join(f"v{i}" for i in range(20_001))}


@pytest.mark.parametrize(("t", "region"), [(0.5, 1 << 20), (0.5, 2000), (0.8, 1 << 20), (0.8, 2000)])
def test_pairs_against_brute_force(spark, t, region):
    texts = _edited(int(t * 10), 220)
    df = spark.createDataFrame(list(texts.items()), "k bigint, body string")
    sets = neardup.text_sets(df, "k", "body", 3).cache()
    want = _sets(texts)
    pairs = {(a, b) for a, b in _brute(want, t)}
    first = {}
    for r in sorted(want):
        first.setdefault(frozenset(want[r]), r)
    reps = set(first.values())
    name = {r.sig: r["class"] for r in neardup.classes(sets).collect()}
    found = rows(neardup.class_pairs(sets, t, region=region))
    assert {tuple(sorted((name[a], name[b]))) for a, b in found} == {(a, b) for a, b in pairs if a in reps and b in reps}
    assert len(set(found)) == len(found)
    if region > 2000:
        assert rows(neardup.record_pairs(sets, t)) == sorted(pairs)


def test_regions_split_by_cells():
    assert neardup.cells_for(0, 12) == 1 and neardup.cells_for(10**9, 12, 48 << 20) == 10


@pytest.mark.parametrize("cells", [1, 4, 64])
def test_emitted_bytes_are_linear(cells):
    """Every part travels a number of times that its length bounds, at any number of records."""
    rng = np.random.default_rng(8)

    def emitted(docs: int) -> int:
        lines = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 50_000, 200)) for _ in range(docs)])
        batch = neardup._set_rows(pa.array(np.arange(docs)), lines, np.arange(docs), 3)
        run = neardup._emitter(np.zeros(1 << 20, np.uint8), 12, cells, 0.5, np.arange(12 * cells))
        return sum(b.column("part").nbytes for b in run(iter([batch])))

    one, two, four = (emitted(n) / n for n in (200, 400, 800))
    assert abs(two / one - 1) < 0.03 and abs(four / one - 1) < 0.03
    assert one < 198 * 6 * min(cells, 198 / 12 / 2 + 2) + 12 * 8 * cells


def test_emitted_bytes_do_not_grow_with_regions():
    rng = np.random.default_rng(9)
    lines = pa.array([" ".join(f"w{x}" for x in rng.integers(0, 50_000, 200)) for _ in range(400)])
    batch = neardup._set_rows(pa.array(np.arange(400)), lines, np.arange(400), 3)

    def emitted(cells: int) -> int:
        run = neardup._emitter(np.zeros(1 << 20, np.uint8), 12, cells, 0.5, np.arange(12 * cells))
        return sum(c.nbytes for b in run(iter([batch])) for c in b.columns)

    sets = batch.column("hashes").nbytes
    # the most is a posting of 8 bytes with a part of 28 of its own, for half the shingles; before, half a part's length times the sets
    assert max(emitted(x) for x in (1, 16, 64, 256)) < 4 * sets


def test_turns_find_every_pair(spark, monkeypatch):
    monkeypatch.setattr(neardup, "TURN", 1)
    monkeypatch.setattr(neardup, "TURN_PAIRS", 40)
    texts = _edited(11, 200)
    sets = neardup.text_sets(spark.createDataFrame(list(texts.items()), "k bigint, body string"), "k", "body", 3).cache()
    assert rows(neardup.record_pairs(sets, 0.5)) == sorted(_brute(_sets(texts), 0.5))


def test_part_of_more_shingles_than_a_place_can_say(spark):
    df = spark.createDataFrame([(i, " ".join(f"v{x}" for x in range(i, 150_000 + i))) for i in (0, 40_000, 80_000)], "k bigint, body string")
    sets = neardup.text_sets(df, "k", "body", 3).cache()
    name = {r.sig: r["class"] for r in neardup.classes(sets).collect()}
    found = {tuple(sorted((name[a], name[b]))) for a, b in rows(neardup.class_pairs(sets, 0.5, groups=1))}
    assert found == {(0, 40_000), (40_000, 80_000)}


def test_shuffle_files_of_a_turn_are_deleted(spark):
    folders = list(spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().localDirs())
    files = lambda: {str(p) for f in folders for p in Path(f.getPath()).rglob("shuffle_*.data")}
    was, before = spark.conf.get(session.CLEANUP, None), files()
    with session.passing(spark):
        done = session.checkpointed(spark.range(1000).repartition(3, "id").distinct())
    assert spark.conf.get(session.CLEANUP, None) == was and done.count() == 1000
    written = files() - before
    kept = session.checkpointed(spark.range(1000).repartition(3, "id").distinct())
    for _ in range(50):
        time.sleep(0.1)
        if not (written & files()):
            break
    assert not (written & files()) and files() - before - written and kept.count() == 1000


def test_keys_that_occur_twice_lose_no_link(spark):
    a, b = "uno dos tres cuatro cinco seis siete ocho", "alfa beta gama delta eps zeta eta teta"
    df = spark.createDataFrame([(1, a), (1, b), (2, b + " iota"), (3, a + " nueve")], "k bigint, body string")
    sets = neardup.text_sets(df, "k", "body", 3).cache()
    assert rows(neardup.record_pairs(sets, 0.5)) == [(1, 2), (1, 3)]
    assert {(r[0], r[3]) for r in rows(neardup.groups(sets, 0.5))} == {(1, 1), (2, 1), (3, 1)}
    twice = spark.createDataFrame([(1, a), (1, a), (2, a)], "k bigint, body string")
    assert rows(neardup.record_pairs(neardup.text_sets(twice, "k", "body", 3).cache(), 0.5)) == [(1, 1), (1, 2), (1, 2)]


def test_large_class_of_copies(spark):
    df = spark.range(1300).selectExpr("id as k", "'uno dos tres cuatro cinco seis' as body").union(spark.createDataFrame([(9000, "uno dos tres cuatro cinco seis siete")], "k bigint, body string"))
    got = neardup.record_pairs(neardup.text_sets(df, "k", "body", 3).cache(), 0.5)
    assert got.count() == 1301 * 1300 // 2 and got.where("rec_no_a >= rec_no_b").count() == 0


def test_copies_and_groups(spark):
    a, b = "uno dos tres cuatro cinco seis siete ocho", "uno dos tres cuatro cinco seis siete nueve"
    df = spark.createDataFrame([(5, a), (3, a), (9, a.upper()), (7, b), (1, "otra cosa muy distinta de todo"), (2, None)], "k bigint, body string")
    sets = neardup.text_sets(df, "k", "body", 3).cache()
    assert set(rows(neardup.record_pairs(sets, 0.5))) == {(3, 5), (3, 9), (5, 9), (3, 7), (5, 7), (7, 9)}
    assert rows(neardup.groups(sets, 0.5)) == [(1, 1, 0, 1), (3, 3, 1, 3), (5, 3, 1, 3), (7, 7, 1, 3), (9, 3, 1, 3)]
    empty = neardup.text_sets(df.where("false"), "k", "body", 3)
    assert rows(neardup.record_pairs(empty, 0.5)) == [] and rows(neardup.groups(empty, 0.5)) == []


def test_page_pairs_against_brute_force(spark, small):
    pages = spark.read.parquet(small + "/read_corpus.parquet")
    data = pages.where("text is not null").select("rec_no", "text").toPandas()
    body = dict(zip(map(int, data.rec_no), bp.bodies(bp.load(bp.weights()), pa.array(list(data.text)))))
    assert set(rows(neardup.found(pages))) == _brute(_sets(body), 0.5)


def test_long_chain_is_one_group(spark):
    words = [f"w{i}" for i in range(60)]
    df = spark.createDataFrame([(i, " ".join(words[i : i + 12])) for i in range(48)], "k bigint, body string")
    got = rows(neardup.groups(neardup.text_sets(df, "k", "body", 3).cache(), 0.7))
    assert {r[3] for r in got} == {0}


def test_chain_out_of_order_is_one_group(spark, monkeypatch):
    ids = [0, *range(39, 0, -1)]
    links = spark.createDataFrame([(min(x, y), max(x, y)) for x, y in zip(ids, ids[1:])], "a bigint, b bigint")
    monkeypatch.setattr(neardup, "class_pairs", lambda *_: links)
    sets = spark.createDataFrame([(i, i) for i in ids], "rec_no bigint, sig bigint")
    assert {r[3] for r in rows(neardup.groups(sets))} == {0}


@pytest.fixture(scope="module")
def vocab():
    with open(tokenizer.BYTE_BPE_50K, "rb") as f:
        return tokenizer.Vocabulary(f.read())


def test_perfect_hash_is_minimal(vocab):
    h = vocab.hash
    tokens = list(vocab.rank)
    assert len(h.value) == len(tokens) and (h.find(tokens) == list(vocab.rank.values())).all()
    assert (h.find([b"\xff\xfe\xfd\xfc", b"zzqqzzqq", b"x" * 500]) == -1).all()


def test_encoding_matches_the_library(vocab, small):
    import pandas as pd
    import tiktoken

    enc = tiktoken.Encoding("own", pat_str=tokenizer.PATTERN, mergeable_ranks=vocab.rank, special_tokens={})
    texts = [t for t in pd.read_parquet(small + "/documents.parquet").text.dropna()] + ["", "a" * 3000, "ñandú 𝔘   \u0000 مرحبا", "<|endoftext|>", "  \n\n  x", "it's WE'LL 12345678901234567890" * 40]
    assert vocab.encode(pa.array(texts)).to_pylist() == [enc.encode_ordinary(t) for t in texts]
    assert b"".join(enc.decode_single_token_bytes(i) for i in vocab.encode(pa.array(["é ü"])).to_pylist()[0]) == "é ü".encode()


def test_encoding_of_null_and_empty(spark, vocab):
    df = spark.createDataFrame([(1, None), (2, ""), (3, "hola"), (None, "x")], "doc_id bigint, text string")
    got = {r[0]: r[1] for r in tokenizer.encoded(df).select("doc_id", "ids").collect()}
    assert got[1] == [] and got[2] == [] and len(got[3]) > 0
    assert dict(tokenizer.encoded(df).dtypes)["ids"] == "array<int>"
    with pytest.raises(ValueError):
        tokenizer.encoded(df, name="text")
    assert tokenizer.encoded(df.where("false")).count() == 0


def _mix_docs(spark, rnd):
    data = [(i, " ".join(rnd.choice(["uno", "dos", "tres"]) + str(rnd.randint(0, 999)) for _ in range(rnd.randint(5, 60))), rnd.choice("aaaaabbc")) for i in range(900)]
    data += [(5000 + i, data[i][1], "b") for i in range(40)] + [(6000, None, "a"), (6001, "", "a"), (6002, "solo", None), (6003, "aparte", "z")]
    return data, spark.createDataFrame(data, "doc_id bigint, text string, source string")


def test_mixture(spark):
    data, docs = _mix_docs(spark, random.Random(2))
    w = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 4), ("c", 0.1, 5), ("none", 0.1, 2)], "source string, target_share double, max_repeats int")
    got = mixing.mixture(docs, w, block=64).collect()
    text = {i: t for i, t, _ in data}
    cap = {"a": 1, "b": 4, "c": 5}
    uses = {}
    for r in got:
        uses[text[r.doc_id]] = uses.get(text[r.doc_id], 0) + 1
        assert uses[text[r.doc_id]] <= cap[r.source]
    total = sum(r.n_tokens for r in got)
    for s, share in (("a", 0.5 / 0.9), ("b", 0.3 / 0.9), ("c", 0.1 / 0.9)):
        assert abs(sum(r.n_tokens for r in got if r.source == s) / total - share) < 0.002
    assert len({(r.slot, r.source) for r in got}) == len({r.slot for r in got})
    again = mixing.mixture(docs, w, block=64).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, again))
    rep = {r.source: r for r in mixing.shares(mixing.mixture(docs, w, block=64), w).collect()}
    assert rep["none"].tokens == 0 and abs(sum(r.actual_share for r in rep.values()) - 1) < 1e-9


def test_every_share_is_within_a_text(spark, small):
    d = small.replace("0.001", "0.01")
    docs, w = (spark.read.parquet(f"{d}/{t}.parquet") for t in ("documents", "source_weights"))
    mixed = mixing.mixture(docs, w).cache()
    longest = {r.source: r.n for r in mixed.groupBy("source").agg(F.max("n_tokens").alias("n")).collect()}
    rep = mixing.shares(mixed, w).collect()
    total = sum(r.tokens for r in rep)
    for r in rep:
        assert r.scaled_share is None or abs(r.actual_share - r.scaled_share) <= max(0.01 * r.scaled_share, longest[r.source] / total)
        assert r.most_uses <= r.max_repeats
    texts = mixing.sized(docs).collect()
    cap = {r.source: r.max_repeats for r in w.collect()}
    full = [s for s in cap if sum(r.n_tokens for r in mixed.where(F.col("source") == s).collect()) == sum(t.n_tokens for t in texts if t.source == s) * cap[s] > 0]
    assert full  # the scarcest source is used up: the total is the largest possible


def test_mixture_of_a_few_words(spark):
    docs = spark.createDataFrame([(1, "uno dos tres cuatro", "a"), (2, "cinco seis siete ocho nueve", "b")], "doc_id bigint, text string, source string")
    w = spark.createDataFrame([("a", 0.98, 9), ("b", 0.02, 1)], "source string, target_share double, max_repeats int")
    got = mixing.shares(mixing.mixture(docs, w), w).collect()
    assert {r.source: r.most_uses for r in got}["a"] == 9


def test_mixture_of_a_wanted_total_and_of_nothing(spark):
    _, docs = _mix_docs(spark, random.Random(3))
    w = spark.createDataFrame([("a", 0.5, 1), ("b", 0.5, 9), (None, 0.2, 1), ("c", None, 1)], "source string, target_share double, max_repeats int")
    got = mixing.mixture(docs, w, total=2000, block=50)
    assert 1900 < got.agg(F.sum("n_tokens")).first()[0] < 2100
    assert mixing.mixture(docs.where("false"), w).count() == 0
    assert mixing.mixture(docs, w.where("false")).count() == 0
    assert mixing.shares(mixing.mixture(docs.where("false"), w), w).count() == 4


def test_bilstm_gradients():
    from tamiz.llm import pii_train as tr

    rnd = random.Random(1)
    p = {k: v.astype(np.float64) for k, v in tr.init(np.random.default_rng(0)).items()}
    batch = tr.batch(tr.sample(["Escribir a juan@x.com hoy. Según Ana Tovero, la corrida.\nTel.: 5550-1234 hola"] * 3, rnd), rnd)
    _, g = tr.step(p, *batch)
    for k in p:
        at = np.unravel_index(np.abs(g[k]).argmax(), g[k].shape)
        up, down = ({a: v.copy() for a, v in p.items()} for _ in range(2))
        up[k][at] += 1e-2
        down[k][at] -= 1e-2
        assert abs((tr.step(up, *batch)[0] - tr.step(down, *batch)[0]) / 2e-2 - g[k][at]) < 2e-2 * abs(g[k][at])


def test_viterbi_against_all_paths():
    rng = np.random.default_rng(3)
    q = {"T": rng.normal(size=(pii_net.TAGS,) * 2).astype(np.float32) + pii_net.allowed(), "s": pii_net.start_mask()}
    e = rng.normal(size=(3, 5, pii_net.TAGS)).astype(np.float32)
    got = pii_net.viterbi(q, e, np.array([3] * 5))
    for b in range(5):
        score = lambda p: q["s"][p[0]] + sum(e[i, b, t] for i, t in enumerate(p)) + sum(q["T"][x, y] for x, y in zip(p, p[1:]))  # noqa: B023, E731
        best = max(((i, j, k) for i in range(11) for j in range(11) for k in range(11)), key=score)
        assert tuple(got[:, b]) == best


def test_blank_windows_are_blank():
    q = pii.load(pii.weights())
    rng = np.random.default_rng(5)
    e = rng.normal(size=(20, 40, pii_net.TAGS)).astype(np.float32) * 3
    e[:, ::2, 0] += 40
    sure = pii_net.surely_blank(q, e)
    assert sure.any() and not pii_net.viterbi(q, e, np.full(40, 20))[:, sure].any()


def test_windows_join_where_both_are_blank():
    a, b = np.zeros(100, np.int8), np.zeros(100, np.int8)
    a[90:], b[10:30] = 1, 3
    got = pii._join([a, b], [0, 60], 160)
    assert len(got) == 160 and got[70] == 3 and got[89] == 3 and not got[90:].any()


CASES = "Escribir a sofia.tovena@correo.example por la tarde.\nTel.: +54 11 5550-7643\nFigura con DNI 99.812.443 en la planilla.\nVive en Calle Aromos 3917, cerca del laboratorio.\nEl juicio lo revisó Dr. Ramiro Wendiego la semana pasada.\nEl nodo Clara respondió en 56 ms y el nodo Bruno en 7."


def test_spans_of_each_kind():
    q = pii.load(pii.weights())
    found = {(k, CASES[a:b]) for a, b, k in pii.tag_texts(q, [CASES])[0]}
    assert found == {("email", "sofia.tovena@correo.example"), ("phone", "+54 11 5550-7643"), ("ident", "99.812.443"), ("address", "Calle Aromos 3917"), ("name", "Ramiro Wendiego")}


DISGUISED = {
    "Escribir a lambinho-96 (arroba) lab-ri (punto) example (punto) net por la tarde.": "lambinho-96 (arroba) lab-ri (punto) example (punto) net",
    "Contato: felipe.ostikov (arroba) lab-ri (ponto) example (ponto) net": "felipe.ostikov (arroba) lab-ri (ponto) example (ponto) net",
    "mon adresse est wendero_r (arobase) example (point) com et je la lis souvent.": "wendero_r (arobase) example (point) com",
    "Contacto: clara.tovena [arroba] correo [punto] example": "clara.tovena [arroba] correo [punto] example",
}


@pytest.mark.parametrize("text", DISGUISED)
def test_addresses_in_words_of_other_languages(text):
    want = DISGUISED[text]
    assert [text[a:b] for a, b, k in pii_labels.spans(text) if k == "email"] == [want]
    assert pii.settle(text, text.index(want), text.index(want) + len(want), "email") is not None
    assert ("email", want) in {(k, text[a:b]) for a, b, k in pii.tag_texts(pii.load(pii.weights()), [text])[0]}


@pytest.mark.parametrize(("text", "want"), [("Regards, hugo lambalba", "hugo lambalba"), ("The judgement was reviewed by iván maldinho last week.", "iván maldinho"), ("this is renata lambuoz and I cannot open it", "renata lambuoz")])
def test_names_in_lower_case(text, want):
    assert [text[a:b] for a, b, k in pii_labels.spans(text) if k == "name"] == [want]
    assert ("name", want) in {(k, text[a:b]) for a, b, k in pii.tag_texts(pii.load(pii.weights()), [text])[0]}


def test_local_parts_are_not_names_in_lower_case():
    for text in ("my address is querralba-62@mail.example.org", "Contacto: harlirier-27 (arroba) example (punto) com", "mi correo es dora ostena@example.com"):
        assert not [s for s in pii_labels.spans(text) if s[2] == "name"]


def test_long_lines_are_read_to_the_end():
    q = pii.load(pii.weights())
    filler = "La tabla de saltos reduce el disco externo antes de fusionar. "
    text = filler * 300 + "Escribir a sofia.tovena@correo.example por la tarde. " + filler * 40 + "Tel.: +54 11 5550-7643"
    assert {text[a:b] for a, b, _ in pii.tag_texts(q, [text])[0]} >= {"sofia.tovena@correo.example", "+54 11 5550-7643"}


def test_redaction(spark):
    df = spark.createDataFrame([(1, CASES, "a"), (2, None, "b"), (3, "", "c"), (4, "nada aquí", "d"), (1, CASES, "a")], "doc_id bigint, text string, kind string")
    got = {r.doc_id: r.redacted for r in pii.redact(df).collect()}
    assert got[2] is None and got[3] == "" and got[4] == "nada aquí"
    assert "[EMAIL]" in got[1] and "[NAME]" in got[1] and "Wendiego" not in got[1] and "El nodo Clara" in got[1]
    assert len(rows(pii.found(df))) == 5
    assert rows(pii.found(df.where("false"))) == []
    with pytest.raises(ValueError):
        pii.redact(df.withColumn("pii", F.lit(1)))


def test_held_out_agreement(small):
    """Against the weak labels on texts that were not trained on."""
    import pandas as pd

    texts = list(pd.read_parquet(small.replace("0.001", "0.01") + "/documents.parquet").text.dropna())[:400]
    hit = got = want = 0
    for t, f in zip(texts, pii.tag_texts(pii.load(pii.weights()), texts)):
        a, b = set(pii_labels.spans(t)), set(f)
        hit, got, want = hit + len(a & b), got + len(b), want + len(a)
    assert hit / got > 0.96 and hit / want > 0.96


def test_hand_written_sentences():
    """Recall on sentences whose values occur in no table; the figures by kind are in the README."""
    from llm import pii_cases

    got = pii_cases.score(pii.load(pii.weights()))
    found, true, both = (sum(v[i] for v in got.values()) for i in range(3))
    assert both / true > 0.7 and both / found > 0.75


def test_generated_lines_hold_their_spans():
    from tamiz.llm import pii_train, pii_values

    rnd = random.Random(1)
    for _ in range(300):
        text, spans = pii_values.line(rnd, ["Zoe"])
        text, spans = pii_train.revalued(text, spans, rnd, ["Zoe"])
        assert all(text[a:b].strip() == text[a:b] != "" for a, b, _ in spans)
        assert all(x[1] <= y[0] for x, y in zip(spans, spans[1:]))
