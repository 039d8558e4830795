"""Zipf and Heaps: ranks, masses, fits and running vocabulary."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

_STRETCH = 65536


def ranked(vocab: DataFrame, value: str = "cf", item: str = "term") -> DataFrame:
    """The rows with ``rank`` 1..V by value descending, item ascending.

    Two steps keep this off one task: rows are counted by value, and ranked inside equal values
    (salted by range of the item through a sort only among equals).  Distinct values of a Zipfian
    list are few; those are prefix-summed in one small window.
    """
    per = vocab.groupBy(value).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.partitionBy(F.lit(0)).orderBy(F.desc(value)).rowsBetween(Window.unboundedPreceding, -1)
    base = per.select(value, F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__base"))
    # equal values are split by the first bytes of the item, so that the hapax tail is not one task
    split = vocab.withColumn("__h", F.substring(F.hex(F.encode(item, "UTF-8")), 1, 6))
    parts = split.groupBy(value, "__h").agg(F.count(F.lit(1)).alias("__m"))
    inner = Window.partitionBy(value).orderBy("__h").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(value, "__h", F.coalesce(F.sum("__m").over(inner), F.lit(0)).alias("__off"))
    row = F.row_number().over(Window.partitionBy(value, "__h").orderBy(item))
    got = split.withColumn("__r", row).join(parts, [value, "__h"]).join(base, value)
    return got.select(*vocab.columns, (F.col("__base") + F.col("__off") + F.col("__r")).cast("bigint").alias("rank"))


def zipf_fit(vocab: DataFrame) -> DataFrame:
    """Least squares of ln(cf) on ln(rank): slope, intercept, r2."""
    r = ranked(vocab).select(F.ln("rank").alias("x"), F.ln("cf").alias("y"))
    return r.agg(F.round(F.regr_slope("y", "x"), 6).alias("slope"), F.round(F.regr_intercept("y", "x"), 6).alias("intercept"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))


def cumulative(rows: DataFrame, weight: Column, rank: str = "rank", name: str = "cum") -> DataFrame:
    """Rows with the running sum of ``weight`` by rank, in two steps over stretches of ranks."""
    got = rows.withColumn("__w", weight).withColumn("__s", F.floor((F.col(rank) - 1) / _STRETCH))
    sums = got.groupBy("__s").agg(F.sum("__w").alias("__t"))
    base = sums.select("__s", F.coalesce(F.sum("__t").over(Window.partitionBy(F.lit(0)).orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    run = F.sum("__w").over(Window.partitionBy("__s").orderBy(rank).rowsBetween(Window.unboundedPreceding, 0))
    return got.withColumn("__r", run).join(base, "__s").withColumn(name, F.col("__b") + F.col("__r")).drop("__w", "__s", "__r", "__b")


def zipf_mass(vocab: DataFrame, shares: tuple[float, ...] = (0.1, 0.2, 0.3, 0.5, 0.9)) -> DataFrame:
    """(mass, actual_rank, zipf_rank): 1 + the ranks whose cumulative share stays below the mass, as counted and by Zipf's law with exponent 1."""
    r = ranked(vocab)
    total, harmonic = vocab.agg(F.sum("cf")).scalar(), r.agg(F.sum(1.0 / F.col("rank"))).scalar()
    c = cumulative(cumulative(r, F.col("cf"), name="cf_to"), 1.0 / F.col("rank"), name="h_to")
    both = c.select((F.col("cf_to") / total).alias("a"), (F.col("h_to") / harmonic).alias("z"))
    count = lambda col, p: (F.count_if(F.round(col, 9) < p) + 1)
    wide = both.agg(*[x for i, p in enumerate(shares) for x in (count("a", p).alias(f"a{i}"), count("z", p).alias(f"z{i}"))])
    rows = F.array(*[F.struct(F.lit(p).alias("mass"), F.col(f"a{i}").alias("actual_rank"), F.col(f"z{i}").alias("zipf_rank")) for i, p in enumerate(shares)])
    return wide.select(F.inline(rows))


def pruned(vocab: DataFrame, mass: float) -> DataFrame:
    """(term, cf, rank) without the head that holds ``mass`` of all occurrences."""
    c = cumulative(ranked(vocab), F.col("cf"), name="cf_to")
    total = vocab.agg(F.sum("cf")).scalar()
    head = c.where(F.round(F.col("cf_to") / total, 9) < mass).select(F.count(F.lit(1)) + 1).scalar()
    return c.where(F.col("rank") > head).select("term", "cf", "rank")


def head_overlap(vocab: DataFrame, stop: DataFrame, mass: float) -> DataFrame:
    """(head_terms, stop_in_head, share): how much of the head are stop words."""
    c = cumulative(ranked(vocab), F.col("cf"), name="cf_to")
    total = vocab.agg(F.sum("cf")).scalar()
    last = c.where(F.round(F.col("cf_to") / total, 9) < mass).select(F.count(F.lit(1)) + 1).scalar()
    head = c.where(F.col("rank") <= last).join(stop.select("term", F.lit(1).alias("s")).distinct(), "term", "left")
    return head.agg(F.count(F.lit(1)).alias("head_terms"), F.count("s").alias("stop_in_head"), F.round(F.try_divide(F.count("s"), F.count(F.lit(1))), 6).alias("share"))


def ranked_by_appearance(positions: DataFrame) -> DataFrame:
    """(term, cf, rank) by frequency, equal ones in the order of their first occurrence (``positions``: doc_id, pos, term; both from 0)."""
    v = positions.groupBy("term").agg(F.count(F.lit(1)).alias("cf"), F.min(F.struct("doc_id", "pos")).alias("at"))
    # fixed-width numbers sort as text in their own order
    return ranked(v.select("term", "cf", F.concat(F.lpad(F.col("at.doc_id").cast("string"), 19, "0"), F.lpad(F.col("at.pos").cast("string"), 10, "0")).alias("first")), "cf", "first").select("term", "cf", "rank")


def heaps_tokens(positions: DataFrame) -> DataFrame:
    """(n, v): tokens read and distinct terms seen after each token, in order of doc_id and pos.

    Sums over documents give each document its base; inside a document its own tokens are counted.
    """
    first = positions.groupBy("term").agg(F.min(F.struct("doc_id", "pos")).alias("at")).select("at.doc_id", "at.pos", F.lit(1).alias("new"))
    base = heaps_curve(positions).select("doc_id", F.col("n").alias("to"), F.col("v").alias("seen"))
    seen = positions.select("doc_id", "pos").join(first, ["doc_id", "pos"], "left")
    back = Window.partitionBy("doc_id").orderBy(F.desc("pos")).rowsBetween(Window.unboundedPreceding, -1)
    # counted from a document's end, where the sums over documents stand
    left = seen.select("doc_id", F.count(F.lit(1)).over(back).alias("after"), F.coalesce(F.sum("new").over(back), F.lit(0)).alias("later"))
    return left.join(base, "doc_id").select((F.col("to") - F.col("after")).alias("n"), (F.col("seen") - F.col("later")).alias("v"))


def heaps_curve(positions: DataFrame) -> DataFrame:
    """(doc_id, n, v): tokens read and distinct terms seen after each document, in order of doc_id.

    ``positions``: (doc_id, pos, term).  A term is new where it first occurs; both running sums go
    over documents in two steps.
    """
    first = positions.groupBy("term").agg(F.min("doc_id").alias("doc_id"))
    new = first.groupBy("doc_id").agg(F.count(F.lit(1)).alias("new_terms"))
    per = positions.groupBy("doc_id").agg(F.count(F.lit(1)).alias("tokens")).join(new, "doc_id", "left").fillna(0, ["new_terms"])
    per = per.withColumn("rank", F.floor(F.col("doc_id") / 1).cast("bigint") + 1)
    return cumulative(cumulative(per, F.col("tokens"), name="n"), F.col("new_terms"), name="v").select("doc_id", F.col("n").cast("bigint").alias("n"), F.col("v").cast("bigint").alias("v"))


def heaps_fit(curve: DataFrame) -> DataFrame:
    """ln(v) on ln(n): beta, k, r2."""
    x = curve.select(F.ln("n").alias("x"), F.ln("v").alias("y"))
    return x.agg(F.round(F.regr_slope("y", "x"), 6).alias("beta"), F.round(F.exp(F.regr_intercept("y", "x")), 6).alias("k"), F.round(F.regr_r2("y", "x"), 6).alias("r2"))
