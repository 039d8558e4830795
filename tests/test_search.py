"""Boolean retrieval, ranking, evaluation, laws, graph: golden cases."""

from __future__ import annotations

import math
import random

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tamiz.operators import blocks, boolean, evaluate, graph, langid, laws, rank, stats
from tamiz.operators import index as ix

DOCS = {0: "a b", 1: "a", 2: "b c", 3: "c", 4: ""}


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(DOCS.items()), "doc_id bigint, text string")


@pytest.fixture(scope="module")
def posts(docs):
    return stats.postings(stats.occurrences(docs)).cache()


@pytest.mark.parametrize(
    ("q", "want"),
    [("a AND b", {0}), ("a OR c", {0, 1, 2, 3}), ("NOT a", {2, 3, 4}), ("a AND NOT b", {1}), ("NOT zz", {0, 1, 2, 3, 4}), ("zz", set()), ("", set()), ("(a OR b) AND c", {2}), ("a OR b AND c", {0, 1, 2}), ("NOT (a OR c)", {4}), ("a NOT b", {1, 3, 4}), ("(a", set()), ("a OR b c", {0, 2, 3}), ("a AND b NOT c", {0}), ("c a) AND b", {0}), ("a NOT NOT b", {1, 3, 4})],
)
def test_boolean_loose(docs, posts, q, want):
    assert {r[0] for r in rows(boolean.search(q, posts, docs))} == want


def test_boolean_strict(docs, posts):
    assert {r[0] for r in rows(boolean.search("a NOT b", posts, docs, strict=True))} == {1}
    assert {r[0] for r in rows(boolean.search("NOT NOT a", posts, docs, strict=True))} == {0, 1}
    for bad in ("(a", "a b", "a AND", ")a("):
        with pytest.raises(ValueError):
            boolean.parse(bad, strict=True)
    with pytest.raises(ValueError):
        boolean.parse("NOT NOT a")


def test_boolean_lexer():
    assert boolean.lex("ORACLE (a)") == ["OR", "ACLE", "(", "a", ")"]
    assert boolean.patterns(["x", "y", "z"])[1] == "(x OR y) NOT z"


def test_known_queries(spark, posts):
    q = spark.createDataFrame([("1", ["a", "b"]), ("2", ["a", "q"]), ("3", ["a"]), ("4", ["a", "a"])], "qid string, words array<string>")
    assert [r[0] for r in rows(boolean.known_queries(q, stats.vocabulary(posts)), "qid")] == ["1", "4"]


def test_scan_words_golden(spark):
    df = spark.createDataFrame([(1, "hola chau rojo azul"), (2, "centro opuesto punta"), (3, "hola, como estas? / me voy chau.")], "doc_id bigint, text string")
    got = dict(rows(stats.word_count(stats.occurrences(df))))
    assert got.pop("hola") == 2 and got.pop("chau") == 2 and len(got) == 9 and set(got.values()) == {1}


def test_statistics_of_nothing(spark):
    df = spark.createDataFrame([], "doc_id bigint, text string")
    p = stats.postings(stats.occurrences(df))
    assert tuple(stats.corpus_stats(df, p).first()) == (0, 0, 0)
    assert stats.summary(df, p).first().mean_term_length is None


def test_top_ties(spark):
    v = spark.createDataFrame([("a", 2, 1), ("b", 2, 1), ("c", 1, 1)], "term string, cf bigint, df bigint")
    assert [r[0] for r in stats.top_terms(v, 2).collect()] == ["b", "a"]
    assert [r[0] for r in stats.bottom_terms(v, 2).collect()] == ["c", "a"]


def test_cosine_zero_norms_and_unknown_terms(spark, docs, posts):
    i = rank.Index(posts, docs)
    q = rank.query_terms(spark.createDataFrame([("1", "a b"), ("2", "zz"), ("3", "")], "qid string, query string"))
    got = rows(rank.cosine(i, q), "qid", "doc_id", "score")
    assert {r[0] for r in got} == {"1"} and max(r[2] for r in got) == 1.0
    everywhere = spark.createDataFrame([(0, "x"), (1, "x")], "doc_id bigint, text string")
    p = stats.postings(stats.occurrences(everywhere))
    assert {r[2] for r in rows(rank.cosine(rank.Index(p, everywhere), rank.query_terms(spark.createDataFrame([("1", "x")], "qid string, query string"))), "qid", "doc_id", "score")} == {0.0}


def test_metrics_golden(spark):
    run = spark.createDataFrame([("1", f"d{i}", i, "m") for i in range(1, 5)] + [("2", "d1", 1, "m")], "qid string, docno string, rank int, model string")
    qrels = spark.createDataFrame([("1", "d1", 1), ("1", "d3", 2), ("1", "d9", 1), ("1", "d2", 0)], "qid string, docno string, label int")
    got = {r.qid: r for r in evaluate.metrics(run, qrels, ["model"]).collect()}
    one = got["1"]
    assert (one.n_rel, one.retrieved) == (3, 4)
    assert one.ap == round((1 + 2 / 3) / 3, 6) and one.p10 == 0.5 and one.p10_trec == 0.2 and one.recall == round(2 / 3, 6)
    assert one.ndcg_v1 == round((1 + 1 / math.log2(3)) / (1 + 1 + 1 / math.log2(3)), 6)
    assert one.ndcg_trec == round((1 + 2 / 2) / (2 + 1 / math.log2(3) + 1 / 2), 6)
    assert got["2"].ap == 0 and got["2"].ndcg_v1 == 0


def test_spearman(spark):
    p = spark.createDataFrame([("k", 1.0, 2.0), ("k", 2.0, 4.0), ("k", 3.0, 3.0), ("c", 1.0, 1.0), ("c", 1.0, 2.0)], "g string, x double, y double")
    assert rows(evaluate.spearman(p, ["g"])) == [("c", 2, None), ("k", 3, 0.5)]


def test_gaps_and_skips(spark):
    p = spark.createDataFrame([("t", d, 1) for d in (0, 3, 70_000, 70_001, 200_000)], "term string, doc_id bigint, tf bigint")
    assert [r[0] for r in ix.gaps(p).orderBy("doc_id").select("gap").collect()] == [0, 3, 69_997, 1, 129_999]
    v = spark.createDataFrame([("t", 9, 9), ("u", 1, 1)], "term string, cf bigint, df bigint")
    assert rows(ix.skip_pointers(v)) == [("t", 0, 3), ("t", 3, 6)] + [("t", i, i + 3) for i in (6,) if i + 3 < 9]


def test_index_on_disk(spark, posts, tmp_path):
    ix.write_index(posts, str(tmp_path / "ix"))
    again = spark.read.parquet(str(tmp_path / "ix"))
    assert rows(again) == rows(posts)
    assert rows(ix.read_postings(again, "a"), "doc_id") == [(0,), (1,)]
    assert "PushedFilters" in again.where("term = 'a'")._jdf.queryExecution().toString()


def test_ranks(spark):
    v = spark.createDataFrame([(f"w{i:03d}", i % 5 + 1) for i in range(200)], "term string, cf bigint")
    got = [r[0] for r in laws.ranked(v).orderBy("rank").select("term").collect()]
    assert got == [t for t, _ in sorted(((r[0], r[1]) for r in rows(v)), key=lambda x: (-x[1], x[0]))]


def _fifo(link, seeds, per_domain, logical, physical, total):
    ids, depth, queue, edges, used = {}, {}, [], [], {}
    dom = lambda u: u.split("://", 1)[1].split("/", 1)[0]
    for s in dict.fromkeys(seeds):
        ids[s], depth[s] = len(ids), 0
        used[dom(s)] = used.get(dom(s), 0) + 1
        queue.append(s)
    while queue:
        u = queue.pop(0)
        for h in link.get(u, []):
            if h not in ids and h.startswith("http") and depth[u] < logical and h.split("://", 1)[1].count("/") <= physical and used.get(dom(h), 0) < per_domain and len(ids) < total:
                ids[h], depth[h] = len(ids), depth[u] + 1
                used[dom(h)] = used.get(dom(h), 0) + 1
                queue.append(h)
    for u in ids:
        edges += [(ids[u], ids[h]) for h in link.get(u, []) if h in ids]
    return {(i, u, depth[u]) for u, i in ids.items()}, sorted(edges)


def test_crawl_matches_queue(spark):
    rnd = random.Random(5)
    names = [f"http://h{rnd.randint(0, 3)}/p{i}" for i in range(40)] + ["ftp://h1/x", "/rel"]
    link = {u: [rnd.choice(names) for _ in range(rnd.randint(0, 5))] for u in names[:35]}
    df = spark.createDataFrame([(u, i, h) for u, hs in link.items() for i, h in enumerate(hs)], "url string, pos int, href string")
    nodes, edges = graph.crawl(df, [names[0], names[1]], 6, 3, 2, 15)
    want = _fifo(link, [names[0], names[1]], 6, 3, 2, 15)
    assert {tuple(r) for r in rows(nodes)} == want[0] and rows(edges) == want[1]


def test_pagerank_sums_to_one_with_dangling_nodes(spark):
    e = spark.createDataFrame([(1, 2), (1, 2), (2, 2), (2, 3), (3, 1), (3, 4)], "src bigint, dst bigint")
    got = dict(rows(graph.pagerank(e, 10)))
    assert abs(sum(got.values()) - 1) < 1e-9 and len(got) == 4
    h = {r.id: r for r in graph.hits(e, 8).collect()}
    assert abs(sum(r.hub for r in h.values()) - 1) < 1e-9 and h[4].hub == 0
    assert rows(graph.pagerank(e.where("src > 9"))) == [] and rows(graph.hits(e.where("src > 9"))) == []


def test_language_of_empty_lines(spark):
    m = spark.createDataFrame([("es", "casa ñandú hola"), ("en", "the house with"), (None, "x")], "lang string, text string")
    q = spark.createDataFrame([(1, "the"), (2, "ñandú"), (3, "12"), (4, "a")], "k int, t string")
    assert dict(rows(langid.detect_letters(q, langid.letter_model(m), "k", "t")))[3] == "unknown"
    got = dict(rows(langid.detect_bigrams(q, langid.bigram_model(m), "k", "t")))
    assert got == {1: "en", 2: "es", 3: "en", 4: "en"}


def test_overlap(spark):
    a = spark.createDataFrame([("x", 3.0), ("y", 2.0), ("z", 1.0)], "id string, s double")
    b = spark.createDataFrame([("y", 3.0), ("x", 2.0), ("w", 1.0)], "id string, t double")
    assert rows(graph.overlap(a, b, "id", "s", "t", 3)) == [(1, 0.0), (2, 100.0), (3, round(200 / 3, 6))]


def test_lenient_links(spark):
    p = spark.createDataFrame([("u", "<A HREF=x>1</A><a name=n><a href='y?a&amp;b'>"), ("v", None)], "url string, html string")
    assert [r[2] for r in rows(graph.links_lenient(p))] == ["x", "y?a&b"]


def test_no_cartesian_product_in_ranking(spark, docs, posts):
    q = rank.query_terms(spark.createDataFrame([("1", "a b")], "qid string, query string"))
    plan = rank.bm25(rank.Index(posts, docs), q)._jdf.queryExecution().toString()
    assert "CartesianProduct" not in plan and "PythonUDF" not in plan


def test_p_values(spark):
    """Against published values of Student's t: 2.228 at 10 degrees of freedom is 0.05, 12.706 at 1 and 1.96 at many."""
    import numpy as np

    got = evaluate._beta_tail(np.array([2.228139, 12.706205, 1.959964, 0.0]), np.array([10.0, 1.0, 1e7, 5.0]))
    assert np.allclose(got, [0.05, 0.05, 0.05, 1.0], atol=1e-5)
    r = spark.createDataFrame([(2, 1.0), (5, 1.0), (5, None), (12, 0.5)], "n bigint, rho double")
    assert [x.p for x in evaluate.with_p_value(r).collect()][:3] == [None, 0.0, None]


def test_heaps_by_token(spark):
    p = spark.createDataFrame([(3, 0, "a"), (3, 1, "b"), (3, 2, "a"), (7, 0, "b"), (7, 1, "c")], "doc_id bigint, pos int, term string")
    assert rows(laws.heaps_tokens(p)) == [(1, 1), (2, 2), (3, 2), (4, 2), (5, 3)]
    assert [(r.term, r["rank"]) for r in laws.ranked_by_appearance(p).orderBy("rank").collect()] == [("a", 1), ("b", 2), ("c", 3)]


def test_ungapped_over_spans(spark):
    p = spark.createDataFrame([("t", i, 2) for i in (0, 1, 65_535, 65_536, 200_000)] + [("u", 0, 5)], "term string, position bigint, gap bigint")
    assert [r[2] for r in rows(ix.ungapped(p)) if r[0] == "t"] == [2, 4, 6, 8, 10]


def test_skips_read_few_blocks(spark, tmp_path):
    df = spark.createDataFrame([(i, "a" + (" b" if i % 7 == 0 else "") + (" c" if i in (70, 700) else "")) for i in range(1000)], "doc_id bigint, text string")
    ix.build(df, str(tmp_path / "i"))
    posts, skips = (spark.read.parquet(str(tmp_path / "i" / t)) for t in ("postings", "skips"))
    assert [r[0] for r in rows(ix.skip_and(posts, skips, ["c", "b", "a"]))] == [70, 700]
    assert rows(ix.skip_and(posts, skips, ["c", "nosuch"])) == []
    t = spark.createDataFrame([("b", 8), ("b", 994), ("b", 995), ("zz", 1)], "term string, target bigint")
    assert rows(ix.advance(posts, skips, t)) == [("b", 8, 14), ("b", 994, 994), ("b", 995, None), ("zz", 1, None)]
    plan = ix.read_postings(posts, "c")._jdf.queryExecution().executedPlan().toString()
    assert "In(term" in plan or "EqualTo(term" in plan


def _many(spark, n=3000):
    """Documents of equal and of different scores, in several blocks, and topics of which some have the same terms."""
    docs = spark.createDataFrame([(i, " ".join(["a", *(["b"] if i % 3 == 0 else []), *(["c"] * (i % 5)), *(["d"] if i % 700 == 0 else [])])) for i in range(n)], "doc_id bigint, text string")
    topics = spark.createDataFrame([(f"{k}-{q}", q) for k in range(3) for q in ("a", "b a", "a b", "c c d", "d zz", "b c d", "zz")], "qid string, query string")
    return docs, stats.postings(stats.occurrences(docs)), rank.query_terms(topics)


def test_ranking_by_blocks_is_exact(spark):
    import numpy as np

    docs, posts, q = _many(spark)
    tf, terms = {}, {}
    for r in posts.collect():
        tf.setdefault(r.term, {})[r.doc_id] = r.tf
    for r in q.collect():
        terms.setdefault(r.qid, {})[r.term] = r.qtf
    size = {}
    for x in tf.values():
        for i, n in x.items():
            size[i] = size.get(i, 0) + n
    mean, want = np.mean(list(size.values())), []
    for qid, words in terms.items():
        s = {}
        for t, n in sorted(words.items()):
            df = len(tf.get(t, {}))
            for i, f in tf.get(t, {}).items():
                s[i] = s.get(i, 0) + n * math.log(1 + (3000 - df + 0.5) / (df + 0.5)) * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[i] / mean))
        want += [(qid, i, at + 1) for at, (i, _) in enumerate(sorted(s.items(), key=lambda x: (-round(x[1], 8), x[0]))[:7])]
    index = rank.Index(posts, docs)
    assert rows(rank.bm25(index, q, 7), "qid", "doc_id", "rank") == sorted(want)
    assert rows(rank.bm25(index, q, 300).where("rank <= 7"), "qid", "doc_id", "rank") == sorted(want)
    assert rank.bm25(index, q.where("qid = '0-a'"), None).agg(F.max("rank")).first()[0] == 3000
    all_d = {r.doc_id: (round(r.score, 8), r.doc_id) for r in rank.cosine(index, q.where("qid = '1-d zz'"), None).collect()}
    assert set(all_d) == {0, 700, 1400, 2100, 2800}
    best = sorted(all_d.values(), reverse=True)[:2]
    assert rows(rank.cosine(index, q.where("qid = '1-d zz'"), 2), "rank", "doc_id") == [(i + 1, d) for i, (_, d) in enumerate(best)]


def test_ranking_has_no_row_for_each_query_and_document(spark):
    docs, posts, q = _many(spark, 200)
    plan = rank.bm25(rank.Index(posts, docs), q)._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and not any("Aggregate" in line and "doc_id" in line for line in plan.splitlines())


def test_boolean_batch_counts_in_blocks(spark):
    docs, posts, _ = _many(spark)
    asked = {"x": ("b", "c"), "y": ("c", "b"), "z": ("d", "c", "b"), "again": ("b", "c")}
    q = spark.createDataFrame([(k, i, t, 1) for k, words in asked.items() for i, t in enumerate(words)], "qid string, i int, term string, qtf bigint")
    has = {t: {r.doc_id for r in posts.where(F.col("term") == t).collect()} for t in "bcd"}
    want = []
    for k, words in asked.items():
        bits = [sum(1 << b for b, t in enumerate(words) if i in has[t]) for i in range(3000)]
        want.append((k, *(bits.count(m) for m in range(1, 8))))
    index = rank.Index(posts, docs)
    of, one = blocks.distinct(q, index.vocab, "i")
    got = blocks.told_apart(blocks.membership(one, index.folder), of)
    assert one.count() == 3 and rows(got, "qid", *(f"m{i}" for i in range(1, 8))) == sorted(want)


def test_metrics_of_judged_results_alone(spark):
    run = spark.createDataFrame([(q, f"d{i}", i, "m") for q in "12" for i in range(1, 31)], "qid string, docno string, rank int, model string")
    qrels = spark.createDataFrame([("1", f"d{i}", i % 4) for i in range(2, 40, 5)] + [("3", "d1", 1)], "qid string, docno string, label int")
    few = run.join(qrels.where("label != 0"), ["qid", "docno"], "left_semi")
    n = run.groupBy("model", "qid").agg(F.count(F.lit(1)).alias("retrieved"))
    assert few.count() < 8 and rows(evaluate.metrics(few, qrels, ["model"], n)) == rows(evaluate.metrics(run, qrels, ["model"]))
