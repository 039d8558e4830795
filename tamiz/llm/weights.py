"""How characteristic a term is of a record: term frequency times logarithmic inverse document frequency.

Document frequencies come from distinct (term, record) pairs and are joined back to the postings.
Terms that own more than ``1 / HOT`` of all pairs are joined by a broadcast table (fewer than ``HOT`` of them by
construction, whatever the data), all others by a shuffled join that such terms cannot skew.
The postings are read once: their distinct pairs are written to the checkpoint folder, and counted and weighted from there.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.session import checkpointed

HOT = 2000


def pairs(rows: DataFrame, greatest: bool = False, term: str = "term_id", record: str = "docid", freq: str = "freq") -> DataFrame:
    """(term_id, docid, freq): distinct pairs with the sum of their distinct frequencies, or with the greatest one.

    Rows with a null term or record are left out; a null freq counts as 0; a posting written again counts once.
    """
    got = rows.select(F.col(term).alias("term_id"), F.col(record).alias("docid"), F.coalesce(F.col(freq), F.lit(0)).cast("bigint").alias("freq")).dropna(subset=["term_id", "docid"])
    if greatest:
        return got.groupBy("term_id", "docid").agg(F.max("freq").alias("freq"))
    # both aggregates find their rows together
    return got.repartition("term_id", "docid").dropDuplicates().groupBy("term_id", "docid").agg(F.sum("freq").alias("freq"))


def with_df(once: DataFrame) -> DataFrame:
    """Distinct pairs (term_id, docid, ...) with their term's ``df``; ``once`` is read several times."""
    df = once.groupBy("term_id").agg(F.count(F.lit(1)).alias("df"))
    total = once.select(F.count(F.lit(1))).scalar()
    hot = F.broadcast(df.where(F.col("df") * HOT > total))
    marked = once.join(hot, "term_id", "left")
    cold = marked.where("df is null").drop("df").join(df.where(F.col("df") * HOT <= total), "term_id")
    return marked.where("df is not null").unionByName(cold)


def tf_idf(rows: DataFrame, smooth: bool = True, normal: bool = True, greatest: bool = False) -> DataFrame:
    """(docid, term_id, score): frequency times inverse document frequency of the term.

    ``smooth``: ln((1 + N) / (1 + df)) + 1, else ln(N / df), N the number of records; ``normal``: divided by the record's
    Euclidean norm, null where that is zero; ``greatest``: of several frequencies of a pair the greatest
    counts, else their sum.  Scores are rounded to 6 places.
    """
    once = checkpointed(pairs(rows, greatest))
    n = once.select(F.countDistinct("docid").cast("double")).scalar()
    idf: Column = F.ln((1.0 + n) / (1.0 + F.col("df"))) + 1.0 if smooth else F.ln(n / F.col("df"))
    raw = with_df(once).select("docid", "term_id", (F.col("freq") * idf).alias("w"))
    if not normal:
        return raw.select("docid", "term_id", F.round("w", 6).alias("score"))
    norm = raw.groupBy("docid").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return raw.join(norm, "docid").select("docid", "term_id", F.expr("round(try_divide(w, norm), 6)").alias("score"))


def best_terms(rows: DataFrame) -> DataFrame:
    """(docid, term_id, score): per record the term of the highest ``round(freq * ln(N / df), 6)``, ties to the smaller term."""
    scored = tf_idf(rows, smooth=False, normal=False, greatest=True)
    # a maximum combines before the shuffle; idf is never negative, so a pair's greatest frequency is its best
    top = F.max(F.struct("score", (-F.col("term_id")).alias("neg")))
    return scored.groupBy("docid").agg(top.alias("m")).select("docid", (-F.col("m.neg")).alias("term_id"), F.col("m.score").alias("score"))


def scores(rows: DataFrame) -> DataFrame:
    """(docid, term_id, score) smoothed and normalised."""
    return tf_idf(rows)
