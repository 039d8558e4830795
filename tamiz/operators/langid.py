"""Language identification from letter and letter-bigram models.

Models are small tables (languages times letters, or pairs of letters).  Letters run on across blanks
and lines of a text, so bigrams cross word boundaries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import text as tx
from tamiz.session import broadcast_if_small

FLOOR = 1e-6


def _letters(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    return rows.select(*keys, tx.tokens(text, r"\p{L}").alias("ch"))


def letter_model(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, ch, n, p): letter frequencies by language; rows without a language are left out."""
    c = _letters(docs.where(F.col(lang).isNotNull()), [lang], text).select(F.col(lang).alias("lang"), F.explode("ch").alias("ch")).groupBy("lang", "ch").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang")))  # one row a letter


def _bigrams(rows: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, x, y), a row for each neighbouring pair of letters."""
    n = F.size("ch")
    pairs = F.when(n >= 2, F.arrays_zip(F.slice("ch", F.lit(1), n - 1).alias("x"), F.slice("ch", F.lit(2), n - 1).alias("y")))
    return rows.select(*keys, F.explode(pairs).alias("b")).select(*keys, "b.x", "b.y")


def bigram_model(docs: DataFrame, lang: str = "lang", text: str = "text") -> DataFrame:
    """(lang, x, y, n, p): probability of a letter after another."""
    rows = _letters(docs.where(F.col(lang).isNotNull()), [lang], text).withColumnRenamed(lang, "lang")
    c = _bigrams(rows, ["lang"]).groupBy("lang", "x", "y").agg(F.count(F.lit(1)).alias("n"))
    return c.withColumn("p", F.col("n") / F.sum("n").over(Window.partitionBy("lang", "x")))


def detect_letters(lines: DataFrame, model: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lang): least Euclidean distance over all letters of line and model, ties by language; ``unknown`` without letters.

    The distance to a language is its own square sum, corrected at the letters of the line only.
    """
    c = _letters(lines, [key], text).select(key, F.explode("ch").alias("ch")).groupBy(key, "ch").agg(F.count(F.lit(1)).alias("n"))
    total = c.groupBy(key).agg(F.sum("n").alias("t"))
    q = c.join(total, key).select(key, "ch", (F.col("n") / F.col("t")).alias("q"))
    own = model.groupBy("lang").agg(F.sum(F.col("p") * F.col("p")).alias("own"))
    langs = own.agg(F.collect_list(F.struct("lang", "own")).alias("l"))  # one entry a language
    near = q.withColumn("m", F.explode(langs.scalar())).select(key, "ch", "q", "m.lang", "m.own")
    d = near.join(broadcast_if_small(model.select("lang", "ch", "p")), ["lang", "ch"], "left").withColumn("p", F.coalesce("p", F.lit(0.0)))
    diff = (F.col("p") - F.col("q")) * (F.col("p") - F.col("q")) - F.col("p") * F.col("p")
    s = d.groupBy(key, "lang").agg(F.round(F.first("own") + F.sum(diff), 9).alias("d"))
    best = s.groupBy(key).agg(F.min(F.struct("d", "lang")).alias("b"))
    return lines.select(key).join(best, key, "left").select(key, F.coalesce("b.lang", F.lit("unknown")).alias("lang"))


def detect_bigrams(lines: DataFrame, model: DataFrame, key: str, text: str) -> DataFrame:
    """(key, lang): greatest sum of log probabilities, unseen pairs at 1e-6, ties by language.

    Lines under two letters score 0 for every language and go to the first one.
    """
    langs = model.agg(F.array_sort(F.collect_set("lang")).alias("l"))  # one entry a language
    b = _bigrams(_letters(lines, [key], text), [key]).groupBy(key, "x", "y").agg(F.count(F.lit(1)).alias("n"))
    near = b.withColumn("lang", F.explode(langs.scalar()))
    s = near.join(broadcast_if_small(model.select("lang", "x", "y", "p")), ["lang", "x", "y"], "left")
    score = F.round(F.sum(F.col("n") * F.ln(F.coalesce("p", F.lit(FLOOR)))), 6)
    best = s.groupBy(key, "lang").agg(score.alias("s")).groupBy(key).agg(F.min(F.struct((-F.col("s")).alias("s"), "lang")).alias("b"))
    return lines.select(key).join(best, key, "left").select(key, F.coalesce("b.lang", langs.select(F.col("l")[0]).scalar()).alias("lang"))
