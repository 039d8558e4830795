"""Term counts, top N and term weights: edge cases and brute force."""

from __future__ import annotations

import math
import random
import time
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from conftest import rows
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.llm import ngrams, topn, weights

POST = "term_id bigint, docid bigint, freq bigint, df string, cf int"


def test_term_counts_edges(spark):
    df = spark.createDataFrame([(1, 1, 2, "", 0), (1, 1, 2, "", 0), (1, 2, None, "", 0), (2, 1, 5, "", 0), (None, 1, 5, "", 0), (3, None, 5, "", 0)], POST)
    assert rows(ngrams.term_counts(df)) == [(1, 2, 2), (2, 5, 1)]
    assert rows(ngrams.term_counts(df.where("false"))) == []


def test_marks(spark):
    df = spark.createDataFrame([(1, d, 1, "", 0) for d in range(30)] + [(2, d, 1, "", 0) for d in range(3)] + [(3, 0, 1, "", 0), (4, 0, 1, "", 0), (4, 1, 1, "", 0)], POST)
    got = ngrams.marked(ngrams.term_counts(df), df.select("docid"))
    assert rows(got, "term_id", "mark") == [(1, "common"), (2, "common"), (3, "rare"), (4, "rare")]


@pytest.mark.parametrize("sigma", [1, 2, 3])
def test_phrases_against_brute_force(spark, sigma):
    rnd = random.Random(sigma)
    texts = [(i, " ".join(rnd.choice("aabbcde") for _ in range(rnd.randint(0, 9)))) for i in range(200)] + [(500, None), (501, ""), (502, "a " * 3000)]
    want_cf, want_df = Counter(), defaultdict(set)
    for i, t in texts:
        w = (t or "").split()
        for n in range(1, sigma + 1):
            for j in range(len(w) - n + 1):
                g = tuple(w[j : j + n])
                want_cf[g] += 1
                want_df[g].add(i)
    got = rows(ngrams.phrase_counts(spark.createDataFrame(texts, "k bigint, t string"), "k", "t", sigma))
    assert {tuple(g): (cf, df) for g, cf, df in got} == {g: (want_cf[g], len(want_df[g])) for g in want_cf}
    assert len(got) == len(want_cf)


def test_stack_across_batches():
    """One open prefix is carried from batch to batch."""
    schema = pa.schema([("gram", pa.list_(pa.int64())), ("cf", pa.int64()), ("df", pa.int64())])
    data = sorted([(t, r) for t in (9, 5, 1) for r in range(7)], key=lambda x: (-x[0], x[1]))
    for size in (1, 2, 3, 5, 21):
        batches = [pa.record_batch([pa.array([t for t, _ in data[i : i + size]]), pa.array([r for _, r in data[i : i + size]]), pa.array([2] * len(data[i : i + size]))], names=["s0", "record", "weight"]) for i in range(0, len(data), size)]
        out = [r for b in ngrams._stack(1, schema)(iter(batches)) for r in b.to_pylist()]
        assert sorted((r["gram"][0], r["cf"], r["df"]) for r in out) == [(1, 14, 7), (5, 14, 7), (9, 14, 7)]


def test_stack_time_is_linear():
    """Four million rows of one term: the state does not grow with its records."""
    schema = pa.schema([("gram", pa.list_(pa.int64())), ("cf", pa.int64()), ("df", pa.int64())])
    n, size = 4_000_000, 10_000
    term, weight = pa.array(np.full(size, 7)), pa.array(np.ones(size, np.int64))
    batches = (pa.record_batch([term, pa.array(np.arange(i, i + size) // 2), weight], names=["s0", "record", "weight"]) for i in range(0, n, size))
    began = time.process_time()
    assert [r for b in ngrams._stack(1, schema)(batches) for r in b.to_pylist()] == [{"gram": [7], "cf": n, "df": n // 2}]
    assert time.process_time() - began < 3


def test_phrases_of_a_key_read_twice(spark):
    df = spark.createDataFrame([(1, "a b a"), (1, "a b a"), (2, "a b")], "k bigint, t string")
    assert {" ".join(g): (cf, n) for g, cf, n in rows(ngrams.phrase_counts(df, "k", "t", 2))} == {"a": (5, 2), "b": (3, 2), "a b": (3, 2), "b a": (2, 1)}


RUN = "qid string, model string, docno string, score double, extra string"


def test_top_n_ties_repeats_and_bad_scores(spark):
    nan = float("nan")
    data = [("q", "m", "b", 1.0, ""), ("q", "m", "a", 1.0, ""), ("q", "m", "a", 3.0, ""), ("q", "m", "é", 1.0, ""), ("q", "m", "z", 1.0, ""), ("q", "m", "c", None, ""), ("q", "m", "d", nan, ""), ("q", "m", None, 9.0, ""), ("q", None, "a", 1.0, ""), ("p", "m", "x", -1.0, "")]
    got = rows(topn.top_n(spark.createDataFrame(data, RUN), ["qid", "model"], "docno", "score", 3), "qid", "model", "docno", "rank")
    assert got == [("p", "m", "x", 1), ("q", None, "a", 1), ("q", "m", "a", 1), ("q", "m", "b", 2), ("q", "m", "z", 3)]
    assert rows(topn.top_n(spark.createDataFrame([], RUN), ["qid", "model"], "docno", "score")) == []
    with pytest.raises(ValueError):
        topn.top_n(spark.createDataFrame([], RUN).withColumnRenamed("model", "rank"), ["qid", "rank"], "docno", "score")


def test_top_n_large_group(spark):
    df = spark.range(40_000).select(F.when(F.col("id") % 3 == 0, F.concat(F.lit("g"), F.col("id").cast("string"))).otherwise("hot").alias("qid"), F.lit("m").alias("model"), F.concat(F.lit("d"), (F.col("id") % 15_000).cast("string")).alias("docno"), (F.col("id") % 97).cast("double").alias("score"))
    got = rows(topn.top_n(df, ["qid", "model"], "docno", "score", 10).where("qid = 'hot'"), "docno", "score")
    best = {}
    for r in df.where("qid = 'hot'").collect():
        best[r.docno] = max(best.get(r.docno, -1), r.score)
    assert got == sorted(sorted(best.items(), key=lambda x: (-x[1], x[0]))[:10])


def test_head_across_batches():
    data = [("a", i) for i in range(5)] + [("b", 0)] + [("c", i) for i in range(4)]
    for size in (1, 2, 3, 10):
        batches = [pa.record_batch([pa.array([g for g, _ in data[i : i + size]]), pa.array([v for _, v in data[i : i + size]])], names=["g", "v"]) for i in range(0, len(data), size)]
        out = [(r["g"], r["v"]) for b in topn._head(1, 2)(iter(batches)) for r in b.to_pylist()]
        assert out == [("a", 0), ("a", 1), ("b", 0), ("c", 0), ("c", 1)]


def test_best_terms(spark):
    data = [(1, 1, 2), (1, 2, 2), (2, 1, 1), (3, 1, 1), (3, 3, 4), (4, 3, 4), (None, 9, 1), (5, None, 1), (3, 3, 4), (4, 3, 9), (2, 1, 3)]
    df = spark.createDataFrame([(t, d, f, "", 0) for t, d, f in data], POST)
    posts = {(t, d, f) for t, d, f in data if t is not None and d is not None}
    n, dfs = len({d for _, d, _ in posts}), Counter(t for t, _ in {(t, d) for t, d, _ in posts})
    want = {}
    for t, d, f in posts:
        s = round(f * math.log(n / dfs[t]), 6)
        if d not in want or (-s, t) < want[d]:
            want[d] = (-s, t)
    assert rows(weights.best_terms(df), "docid", "term_id") == sorted((d, t) for d, (_, t) in want.items())
    assert rows(weights.best_terms(df.where("false"))) == []


def test_scores_of_zero_frequencies(spark):
    df = spark.createDataFrame([(1, 1, 0, "", 0), (1, 2, None, "", 0), (2, 2, 1, "", 0)], POST)
    got = {(d, t): s for d, t, s in rows(weights.scores(df), "docid", "term_id", "score")}
    assert got[1, 1] is None and got[2, 2] == 1.0 and got[2, 1] == 0.0


def test_hot_term_is_joined_apart(spark):
    df = spark.range(9000).select(F.when(F.col("id") % 3 == 0, F.col("id")).otherwise(-1).cast("bigint").alias("term_id"), (F.col("id") % 4000).alias("docid"), F.lit(1).cast("bigint").alias("freq"))
    once = weights.pairs(df)
    got = weights.with_df(once)
    want = df.select("term_id", "docid").distinct().groupBy("term_id").count()
    assert got.join(want, "term_id").where("df <> count").count() == 0 and got.count() == once.count()


def test_types_are_kept(spark):
    df = spark.createDataFrame([("q", "m", "a", 1.0, "")], RUN)
    assert topn.top_n(df, ["qid", "model"], "docno", "score").schema["rank"].dataType == T.IntegerType()
