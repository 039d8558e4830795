"""Ranked retrieval over postings: TF-IDF cosines, BM25, language models.

Every model is a weight of a posting and a finish of the sums; :mod:`tamiz.operators.blocks` adds up the weights of each query over
blocks of postings and keeps the best ``k``, so that no row is made for each query and document that meet.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions import text as tx
from tamiz.operators import blocks, stats
from tamiz.operators import index as ix
from tamiz.session import broadcast_if_small, checkpointed, passing  # noqa: F401  (the first for the plans)


class Index:
    """Postings with their vocabulary, totals and packed blocks; made here from postings, or read from a stored index.

    ``names``: (doc_id, docno), for rankings of names.
    """

    def __init__(self, posts: DataFrame, docs: DataFrame, names: DataFrame | None = None):
        spark = posts.sparkSession
        self.folder = blocks.scratch(spark)
        with passing(spark):
            lengths = checkpointed(stats.document_lengths(posts))
            self.vocab = checkpointed(stats.vocabulary(posts))
        t = lengths.agg(F.count(F.lit(1)).alias("n"), F.coalesce(F.sum("doc_len"), F.lit(0)).alias("t")).first()
        self._totals(docs.count(), t.t, t.n)
        with passing(spark):
            full = checkpointed(ix.norms(posts.join(lengths, "doc_id"), self.vocab, max(self.n_docs, 1)))
            full = full.withColumn("name", F.lit(None)) if names is None else full.join(names.withColumnRenamed("docno", "name"), "doc_id", "left")
            blocks.write(posts, full, self.folder, t.n)

    @classmethod
    def stored(cls, spark: SparkSession, folder: str) -> "Index":
        """Of :func:`tamiz.operators.index.build`."""
        got = cls.__new__(cls)
        got.posts, got.vocab = (spark.read.parquet(f"{folder}/{t}") for t in ("postings", "vocab"))
        t = spark.read.parquet(f"{folder}/totals").first()
        got._totals(t.n_docs, t.n_tokens, t.n_full)
        got.folder = f"{folder}/blocks"
        return got

    def _totals(self, n_docs: int, n_tokens: int, n_full: int) -> None:
        self.n_docs, self.n_tokens, self.mean_length = n_docs, n_tokens, n_tokens / max(n_full, 1)


def query_terms(topics: DataFrame, pattern: str = tx.LETTERS, least: int = 1, most: int = 1 << 30) -> DataFrame:
    """(qid, term, qtf) of topics (qid, query); queries without terms vanish."""
    t = topics.select("qid", F.explode(tx.tokens("query", pattern)).alias("term")).where(tx.kept_length(least, most))
    return t.groupBy("qid", "term").agg(F.count(F.lit(1)).alias("qtf"))


def latest_topics(rows: DataFrame) -> DataFrame:
    """(qid, query): of a topic read several times the latest with a query."""
    q = rows.where("qid is not null and query is not null")
    return q.groupBy("qid").agg(F.max_by("query", F.struct("read_at", "query")).alias("query"))


def _ranked(index: Index, queries: DataFrame, k: int | None, models: list, down: bool = False, damp=lambda qtf: qtf) -> DataFrame:
    """(setting, qid, doc_id, score, rank): the first k (None: all) by score rounded to 8 places, then document."""
    of, one = blocks.distinct(queries, index.vocab)
    got, done = blocks.best(one, index.folder, k, models, down, damp=damp)
    if not done:
        doc = F.col("doc_id").desc() if down else F.col("doc_id").asc()
        got = got.withColumn("rank", F.row_number().over(Window.partitionBy("setting", "rep").orderBy(F.desc("score"), doc)))
        got = got if k is None else got.where(F.col("rank") <= k)
    return blocks.told_apart(got, of).select("setting", "qid", "doc_id", "score", "rank")


def _one(index: Index, queries: DataFrame, k: int | None, model: tuple, *more) -> DataFrame:
    return _ranked(index, queries, k, [model], *more).drop("setting")


def _plain(weight) -> tuple:
    """A model whose score is the sum of its weights."""
    return weight, lambda s, d, q: s, lambda block: block.lens, lambda q: q.length


def cosine(index: Index, queries: DataFrame, k: int | None = 10, log_tf: bool = False) -> DataFrame:
    """TF-IDF cosine; ``log_tf``: 1 + ln tf for tf.  Zero norms give score 0 (documents of terms found everywhere)."""
    n = index.n_docs
    damp = (lambda c: 1.0 + np.log(c)) if log_tf else (lambda c: c)

    def own(q: blocks.Queries) -> np.ndarray:
        w = q.qtf * np.log(n / q.df[q.code])
        return np.sqrt(np.add.reduceat(w * w, q.ends[:-1]))

    def finish(s: np.ndarray, d: np.ndarray, q: float) -> np.ndarray:
        return np.divide(s, d * q, out=np.zeros(len(s)), where=d * q > 0)

    model = lambda tf, size, cf, df: damp(tf) * np.log(n / df) ** 2, finish, lambda b: b.log_norm if log_tf else b.norm, own
    return _one(index, queries, k, model, True, damp)


def _bm25(index: Index, k1: float = 1.2, b: float = 0.75) -> tuple:
    n, mean = index.n_docs, index.mean_length
    return _plain(lambda tf, size, cf, df: np.log(1.0 + (n - df + 0.5) / (df + 0.5)) * tf * (k1 + 1.0) / (tf + k1 * (1.0 - b + b * size / mean)))


def _tf_idf(index: Index, k1: float = 1.2, b: float = 0.75) -> tuple:
    n, mean = index.n_docs, index.mean_length
    return _plain(lambda tf, size, cf, df: k1 * tf / (tf + k1 * (1.0 - b + b * size / mean)) * np.log(n / df + 1.0))


def _hiemstra(index: Index, lam: float = 0.5) -> tuple:
    t = index.n_tokens
    return _plain(lambda tf, size, cf, df: np.log(1.0 + lam * tf * t / ((1.0 - lam) * cf * size)))


def _dirichlet(index: Index, mu: float = 2500.0) -> tuple:
    t = index.n_tokens
    return (lambda tf, size, cf, df: np.log(1.0 + tf * t / (mu * cf))), (lambda s, d, q: s + q * d), (lambda b: np.log(mu / (b.lens + mu))), (lambda q: q.length)


def bm25(index: Index, queries: DataFrame, k: int | None = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Robertson's BM25 with idf ln(1 + (N - df + 0.5) / (df + 0.5))."""
    return _one(index, queries, k, _bm25(index, k1, b))


def tf_idf(index: Index, queries: DataFrame, k: int | None = 10, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """Robertson's tf times ln(N / df + 1)."""
    return _one(index, queries, k, _tf_idf(index, k1, b))


def hiemstra(index: Index, queries: DataFrame, k: int | None = 10, lam: float = 0.5) -> DataFrame:
    """Hiemstra's language model, ``lam`` on the document: sum of ln(1 + lam tf T / ((1 - lam) cf |d|))."""
    return _one(index, queries, k, _hiemstra(index, lam))


def dirichlet(index: Index, queries: DataFrame, k: int | None = 10, mu: float = 2500.0) -> DataFrame:
    """Dirichlet smoothing (Zhai and Lafferty): sum of ln(1 + tf T / (mu cf)) plus |q| ln(mu / (|d| + mu))."""
    return _one(index, queries, k, _dirichlet(index, mu))


GRID = (("tf_idf", None), ("bm25", None), ("hiemstra", 0.2), ("hiemstra", 0.5), ("hiemstra", 0.9), ("dirichlet", 50.0), ("dirichlet", 500.0), ("dirichlet", 2500.0))


def _models(index: Index, settings) -> list[tuple]:
    make = {"tf_idf": _tf_idf, "bm25": _bm25, "hiemstra": _hiemstra, "dirichlet": _dirichlet}
    return [make[m](index) if x is None else make[m](index, x) for m, x in settings]


def _named(rows: DataFrame, settings) -> DataFrame:
    """``model`` and ``param`` in place of the number of a setting."""
    at = lambda values, kind: F.element_at(F.array(*[F.lit(v).cast(kind) for v in values]), F.col("setting") + 1)
    return rows.select(at([m for m, _ in settings], "string").alias("model"), at([x for _, x in settings], "double").alias("param"), *[c for c in rows.columns if c != "setting"])


def grid(index: Index, queries: DataFrame, k: int | None = 1000, settings=GRID) -> DataFrame:
    """(model, param, qid, doc_id, score, rank) of every setting."""
    return _named(_ranked(index, queries, k, _models(index, settings)), settings)


def grid_names(index: Index, queries: DataFrame, k: int = 1000, settings=GRID) -> tuple[DataFrame, DataFrame]:
    """((model, param, rep, docno, rank), (qid, rep)): the names of the first k documents of every setting, a name once with its best
    place, for one topic of each set of terms; the topics it stands for."""
    of, one = blocks.distinct(queries, index.vocab)
    return _named(blocks.best(one, index.folder, k, _models(index, settings), names=True)[0].drop("score"), settings), of
