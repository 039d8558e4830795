"""Evaluation of rankings against judgements.

A run is (qid, docno, rank); judgements are (qid, docno, label).  Extra key columns of a run (such as
``model``) are kept.  Topics without relevant documents count with zeros.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def judgements(rows: DataFrame) -> DataFrame:
    """(qid, docno, label): keys trimmed, blank or null ones and null labels left out, the highest label of repeated judgements."""
    t = lambda c: F.nullif(F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""), F.lit("")).alias(c)
    return rows.select(t("qid"), t("docno"), "label").dropna().groupBy("qid", "docno").agg(F.max("label").alias("label"))


def judged(run: DataFrame, qrels: DataFrame, keys: list[str]) -> DataFrame:
    """The run with ``rel`` (label over 0), and running ``hits`` and ``precision`` by rank."""
    j = run.join(qrels, ["qid", "docno"], "left").withColumn("label", F.coalesce("label", F.lit(0)))
    w = Window.partitionBy(*keys, "qid").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    j = j.withColumn("rel", (F.col("label") > 0).cast("int")).withColumn("hits", F.sum("rel").over(w))
    return j.withColumn("precision", F.col("hits") / F.col("rank"))


def _ideal(qrels: DataFrame) -> DataFrame:
    """(qid, n_rel)."""
    return qrels.groupBy("qid").agg(F.count_if(F.col("label") > 0).alias("n_rel"))


def metrics(run: DataFrame, qrels: DataFrame, keys: list[str], retrieved: DataFrame | None = None) -> DataFrame:
    """Per topic: ap, p10 (of what was retrieved), p10_trec (of ten), ndcg_v1, ndcg_trec, recall, n_rel, retrieved.

    ndcg_v1: binary gains, the first rank undiscounted, rank r by log2(r); ndcg_trec: graded gains by
    log2(r + 1).  Results without a label add nothing: with ``retrieved`` (keys, qid, retrieved) the run need not hold them.
    """
    j = judged(run, qrels, keys)
    first = F.col("rank") <= 10
    v1 = F.when(F.col("rank") == 1, F.col("rel") * 1.0).otherwise(F.col("rel") / F.log2(F.greatest("rank", F.lit(2))))
    per = j.groupBy(*keys, "qid").agg(
        F.count(F.lit(1)).alias("retrieved"), F.sum(F.col("rel") * F.col("precision")).alias("sum_p"), F.sum("rel").alias("found"),
        F.sum(F.when(first, F.col("rel"))).alias("hits10"), F.sum(F.when(first, v1)).alias("dcg1"), F.sum(F.when(first, F.col("label") / F.log2(F.col("rank") + 1))).alias("dcg2"),
    )
    if retrieved is not None:
        per = retrieved.join(per.drop("retrieved"), [*keys, "qid"], "left")
    top = Window.partitionBy("qid").orderBy(F.desc("label"), "docno")
    best = qrels.where("label > 0").withColumn("r", F.row_number().over(top)).where("r <= 10").groupBy("qid").agg(F.sum(F.col("label") / F.log2(F.col("r") + 1)).alias("ideal2"))
    i1 = F.expr("aggregate(sequence(1, cast(least(n_rel, 10) as int)), 0D, (a, r) -> a + if(r = 1, 1D, 1D / log2(r)))")
    got = per.join(_ideal(qrels), "qid", "left").join(best, "qid", "left").withColumn("n_rel", F.coalesce("n_rel", F.lit(0)))
    zero = lambda c: F.round(F.coalesce(c, F.lit(0.0)), 6)
    return got.select(
        *keys, "qid", "retrieved", "n_rel", zero(F.try_divide("sum_p", "n_rel")).alias("ap"), zero(F.try_divide(F.col("hits10") * 1.0, F.least("retrieved", F.lit(10)))).alias("p10"),
        zero(F.col("hits10") / 10).alias("p10_trec"), zero(F.when(F.col("n_rel") > 0, F.col("dcg1") / i1)).alias("ndcg_v1"), zero(F.try_divide("dcg2", "ideal2")).alias("ndcg_trec"), zero(F.try_divide("found", "n_rel")).alias("recall"),
    )


def means(per_topic: DataFrame, keys: list[str]) -> DataFrame:
    """Mean of every measure over the topics of a run."""
    m = ("ap", "p10", "p10_trec", "ndcg_v1", "ndcg_trec", "recall")
    return per_topic.groupBy(*keys).agg(F.count(F.lit(1)).alias("topics"), *[F.round(F.avg(c), 6).alias(c if c != "ap" else "map") for c in m])


def recall_precision(run: DataFrame, qrels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, level, precision): interpolated precision at recall 0.0, 0.1, ..., 1.0, averaged over topics."""
    j = judged(run, qrels, keys).join(_ideal(qrels), "qid", "left")
    levels = [i / 10 for i in range(11)]
    per = j.groupBy(*keys, "qid").agg(*[F.coalesce(F.max(F.when(F.round(F.try_divide("hits", "n_rel"), 9) >= r, F.col("precision"))), F.lit(0.0)).alias(f"p{i}") for i, r in enumerate(levels)])
    wide = per.groupBy(*keys).agg(*[F.round(F.avg(f"p{i}"), 6).alias(f"p{i}") for i in range(11)])
    return wide.select(*keys, F.inline(F.array(*[F.struct(F.lit(r).alias("level"), F.col(f"p{i}").alias("precision")) for i, r in enumerate(levels)])))


def by_rank(run: DataFrame, qrels: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, rank, topics, precision, recall): means over the topics with so many results."""
    j = judged(run, qrels, keys).join(_ideal(qrels), "qid", "left")
    r = F.coalesce(F.try_divide("hits", "n_rel"), F.lit(0.0))
    return j.groupBy(*keys, "rank").agg(F.count(F.lit(1)).alias("topics"), F.round(F.avg("precision"), 6).alias("precision"), F.round(F.avg(r), 6).alias("recall"))


def describe(per_topic: DataFrame, keys: list[str], measure: str) -> DataFrame:
    """Count, mean, sample deviation, least, quartiles and greatest of a measure."""
    q = lambda p, n: F.round(F.percentile(measure, p), 6).alias(n)
    f = lambda c, n: F.round(c, 6).alias(n)
    return per_topic.groupBy(*keys).agg(F.count(measure).alias("count"), f(F.avg(measure), "mean"), f(F.stddev_samp(measure), "std"), f(F.min(measure), "min"), q(0.25, "q25"), q(0.5, "q50"), q(0.75, "q75"), f(F.max(measure), "max"))


def average_rank(value: str, keys: list[str]) -> "F.Column":
    """Rank of a value among its keys, equal ones sharing the mean of their ranks."""
    w = Window.partitionBy(*keys)
    return F.rank().over(w.orderBy(value)) + (F.count(F.lit(1)).over(Window.partitionBy(*keys, value)) - 1) / 2.0


def spearman(pairs: DataFrame, keys: list[str], x: str = "x", y: str = "y") -> DataFrame:
    """(keys, n, rho) of paired values; null for constant ones."""
    r = pairs.select(*keys, average_rank(x, keys).alias("rx"), average_rank(y, keys).alias("ry"))
    c = r.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"), F.stddev_pop("rx").alias("sx"), F.stddev_pop("ry").alias("sy"), F.covar_pop("rx", "ry").alias("c"))
    return c.select(*keys, "n", F.round(F.try_divide("c", F.col("sx") * F.col("sy")), 6).alias("rho"))


def _beta_tail(t: np.ndarray, n: np.ndarray) -> np.ndarray:
    """Two-sided tail of Student's t with n degrees of freedom, by the continued fraction of the incomplete beta function."""
    a, b = n / 2.0, np.full(len(n), 0.5)
    x = n / (n + t * t)
    swap = x > (a + 1) / (a + b + 2)
    p, q, y = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    log = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(log(p + q) - log(p) - log(q) + p * np.log(y) + q * np.log1p(-y)) / p
        c, d = np.ones(len(n)), 1 / (1 - (p + q) * y / (p + 1))
        h = d.copy()
        for m in range(1, 300):
            for e in (m * (q - m) * y / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * y / ((p + 2 * m) * (p + 2 * m + 1))):
                d, c = 1 / (1 + e * d), 1 + e / c
                h = h * c * d
        got = np.where((y <= 0) | (y >= 1), np.where(y <= 0, 0.0, 1.0), front * h)
    return np.where(swap, 1 - got, got)


def with_p_value(correlations: DataFrame) -> DataFrame:
    """Rows (n, rho, ...) with ``p``: the two-sided p-value of no correlation; 0 at rho of 1 or -1, null under three pairs or without rho."""

    @F.pandas_udf("double")
    def tail(rho: pd.Series, n: pd.Series) -> pd.Series:
        r, k = rho.to_numpy(float), n.to_numpy(float) - 2
        ok = (k > 0) & (np.abs(r) < 1)
        out = np.where((k > 0) & (np.abs(r) == 1), 0.0, np.nan)
        out[ok] = _beta_tail(r[ok] * np.sqrt(k[ok] / (1 - r[ok] ** 2)), k[ok])
        return pd.Series(out)

    return correlations.withColumn("p", F.nullif(F.round(tail("rho", "n"), 6), F.lit(float("nan"))))


def spearman_measures(per_topic: DataFrame, measure: str = "ap") -> DataFrame:
    """(model_a, model_b, n, rho): the measure of two models paired by topic."""
    a = per_topic.select("qid", F.col("model").alias("model_a"), F.col(measure).alias("x"))
    b = per_topic.select("qid", F.col("model").alias("model_b"), F.col(measure).alias("y"))
    return spearman(a.join(b, "qid").where("model_a < model_b"), ["model_a", "model_b"])


def spearman_ids(run: DataFrame, doc: str, k: int) -> DataFrame:
    """(qid, model_a, model_b, n, rho): the document ids at each rank, as they are, of two models' first k."""
    top = run.where(F.col("rank") <= k)
    a = top.select("qid", "rank", F.col("model").alias("model_a"), F.col(doc).alias("x"))
    b = top.select("qid", "rank", F.col("model").alias("model_b"), F.col(doc).alias("y"))
    return spearman(a.join(b, ["qid", "rank"]).where("model_a < model_b"), ["qid", "model_a", "model_b"])


def ranked_run(rows: DataFrame, k: int | None = None) -> DataFrame:
    """(qid, model, docno, score, rank) of scored results: a document once with its highest score; null and NaN scores and null keys are left out.  ``k``: only the first k of a topic and model, else all."""
    ok = rows.where("qid is not null and model is not null and docno is not null and score is not null and not isnan(score)")
    one = ok.groupBy("qid", "model", "docno").agg(F.max("score").alias("score"))
    r = F.row_number().over(Window.partitionBy("qid", "model").orderBy(F.desc("score"), "docno"))
    got = one.withColumn("rank", r)
    return got if k is None else got.where(F.col("rank") <= k)


def query_buckets(queries: DataFrame, lengths: DataFrame, vocab: DataFrame) -> DataFrame:
    """(length_bucket, size_bucket, queries, mean_terms, mean_postings) of topics by number of terms and by mean list length.

    ``queries``: (qid, term, qtf); ``lengths``: (qid, n_terms) of every topic, also those without terms,
    which fall into ``2-3`` as they always did.
    """
    sizes = queries.join(vocab.select("term", "df"), "term").groupBy("qid").agg(F.avg("df").alias("avg_df"))
    q = lengths.join(sizes, "qid", "left").withColumn("avg_df", F.coalesce("avg_df", F.lit(0.0)))
    by_len = F.when(F.col("n_terms") == 1, "1").when(F.col("n_terms") <= 3, "2-3").otherwise("4+")
    by_size = F.when(F.col("avg_df") < 5, "<5").when(F.col("avg_df") < 10, "<10").otherwise("10+")
    return q.groupBy(by_len.alias("length_bucket"), by_size.alias("size_bucket")).agg(F.count(F.lit(1)).alias("queries"), F.round(F.avg("n_terms"), 6).alias("mean_terms"), F.round(F.avg("avg_df"), 6).alias("mean_postings"))
