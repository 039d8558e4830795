"""Mixing sources to target shares of the total tokens.

Texts are made distinct first (a text found under several records or sources belongs to the one of
its smallest id), so a text is used at most ``max_repeats`` times of its source.  Each source's
texts are laid out in a shuffled order, ``max_repeats`` times over with another shuffle each time, and cut
into blocks of equal tokens.  The schedule deals slots to sources: slot ``i`` takes the source in
whose stretch of the cumulative weights the point ``frac(i * golden ratio)`` lies, and the ``j``-th
slot of a source takes its ``j``-th block.  A source ends at the text end nearest to its wanted tokens, whatever the
blocks, so its share is off by half a text at most; slots are dealt, by the bound on the discrepancy of the golden
ratio, until every block has one, and those left over stay empty.

Offsets come from two prefix sums: one over buckets of the shuffle (some ``TEXTS`` texts each), one inside each
bucket; no task orders a whole source.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.llm.tokenizer import BYTE_BPE_50K, token_count
from tamiz.session import checkpointed

GOLDEN = (5**0.5 - 1) / 2
BLOCK, TEXTS = 2048, 4096
SOURCES = 100_000  # listed sources whose plan is broadcast


def sized(docs: DataFrame, path: str = BYTE_BPE_50K, key: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """Distinct texts: (doc_id, source, n_tokens); null, empty and source-less ones are left out."""
    rows = docs.where(F.col(source).isNotNull() & (F.length(text) > 0))
    rows = rows.select(F.col(key).alias("doc_id"), F.col(source).alias("source"), F.sha2(F.col(text), 256).alias("h"), token_count(F.col(text), path).alias("n_tokens"))
    first = rows.groupBy("h").agg(F.min_by(F.struct("doc_id", "source", "n_tokens"), F.struct("doc_id", "source")).alias("d"))
    return first.select("d.*").where("n_tokens > 0")


def plan(texts: DataFrame, weights: DataFrame, total: int | None = None, block: int = BLOCK) -> DataFrame:
    """One row for each source that has texts and a weight: shares, wanted tokens, rounds, and the block size.

    Target shares are scaled to the sources that have texts.  ``total`` defaults to the largest one at
    which every source reaches its share within its repeats.  Blocks are shorter than ``block`` where the smallest
    share would have under 16 of them.
    """
    have = texts.groupBy("source").agg(F.sum("n_tokens").alias("tokens"), F.count(F.lit(1)).alias("texts"))
    w = weights.where("source is not null and target_share > 0 and max_repeats > 0").groupBy("source").agg(F.max("target_share").alias("target_share"), F.max("max_repeats").cast("int").alias("max_repeats"))
    got = have.join(w, "source")
    everything = Window.partitionBy(F.lit(0))  # one row a source
    got = got.withColumn("share", F.col("target_share") / F.sum("target_share").over(everything))
    most = F.min(F.col("tokens") * F.col("max_repeats") / F.col("share")).over(everything)
    got = got.withColumn("total", F.least(F.floor(most), F.lit(total)) if total is not None else F.floor(most))
    got = got.withColumn("want", F.col("share") * F.col("total")).withColumn("least", F.min("share").over(everything))
    got = got.withColumn("rounds", F.greatest(F.lit(1), F.least(F.col("max_repeats"), F.ceil(F.col("want") / F.col("tokens")).cast("int"))))
    got = got.withColumn("block", F.greatest(F.lit(1), F.least(F.lit(block), F.floor(F.col("least") * F.col("total") / 16))).cast("bigint"))
    got = got.withColumn("buckets", F.ceil(F.col("texts") / TEXTS).cast("int"))
    return got.withColumn("weight_to", F.sum("share").over(everything.orderBy("source").rowsBetween(Window.unboundedPreceding, 0))).withColumn("weight_from", F.col("weight_to") - F.col("share"))


def mixture(docs: DataFrame, weights: DataFrame, total: int | None = None, block: int = BLOCK, seed: int = 17, path: str = BYTE_BPE_50K) -> DataFrame:
    """(slot, source, block, at, doc_id, repeat, n_tokens): the mixed sequence, ordered by slot and ``at``.

    A text belongs to the block in which its first token lies.  Sources without texts get no slot;
    with no usable source the result is empty.
    """
    texts = checkpointed(sized(docs, path))
    p = checkpointed(plan(texts, weights, total, block))  # one row a listed source
    few = F.broadcast(p) if p.count() <= SOURCES else p
    copies = texts.join(few.select("source", "rounds", "buckets", "want", F.col("block").alias("size")), "source")
    copies = copies.select("doc_id", "source", "n_tokens", "buckets", "want", "size", F.explode(F.sequence(F.lit(0), F.col("rounds") - 1)).alias("repeat"))
    copies = copies.withColumn("r", F.xxhash64("doc_id", "repeat", F.lit(seed))).withColumn("bucket", F.pmod("r", F.col("buckets")).cast("int"))
    sums = copies.groupBy("source", "repeat", "bucket").agg(F.sum("n_tokens").alias("s"))
    order = Window.partitionBy("source").orderBy("repeat", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = sums.select("source", "repeat", "bucket", F.coalesce(F.sum("s").over(order), F.lit(0)).alias("base"))
    inside = Window.partitionBy("source", "repeat", "bucket").orderBy("r", "doc_id").rowsBetween(Window.unboundedPreceding, -1)
    placed = copies.withColumn("in", F.coalesce(F.sum("n_tokens").over(inside), F.lit(0))).join(base, ["source", "repeat", "bucket"]).withColumn("at", F.col("base") + F.col("in"))
    placed = placed.where(F.col("at") + F.col("n_tokens") / 2 <= F.col("want")).withColumn("block", F.floor(F.col("at") / F.col("size")))
    return placed.join(schedule(p), ["source", "block"]).select("slot", "source", "block", "at", "doc_id", "repeat", "n_tokens")


def schedule(p: DataFrame) -> DataFrame:
    """(slot, source, block): the sources' slots, ranked inside each source; every source gets its blocks at least.

    An interval of length s holds n s points of n, give or take twice 3 + 3.53 ln n (Niederreiter's bound for
    partial quotients of 1); so many more points are dealt that the smallest share has its blocks.
    Ranks come from two steps: slots are counted by stretch of 4,096, and numbered inside stretches.
    """
    spark = p.sparkSession
    n = p.agg(F.max(F.col("total") / F.col("block")).alias("n"), F.min("least").alias("least")).where("n > 0")
    more = lambda x: F.col("n") + (8 + 7.1 * F.ln(x + 2)) / F.col("least")
    n = n.select(F.ceil(more(more(more(F.col("n"))))).alias("n"))
    i = n.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.floor((F.col("n") - 1) / 4096))).alias("stretch"), "n")
    i = i.repartition(max(2, spark.sparkContext.defaultParallelism), "stretch").select("stretch", "n", F.explode(F.sequence(F.col("stretch") * 4096, F.least(F.col("stretch") * 4096 + 4095, F.col("n") - 1))).alias("slot"))
    point = (F.col("slot") + 1) * F.lit(GOLDEN) % 1.0
    # one entry a source, in one array; the list of weights bounds it
    stretches = p.agg(F.array_sort(F.collect_list(F.struct("weight_from", "source"))).alias("s")).scalar()
    i = i.select("stretch", "slot", stretches.alias("s"))
    dealt = i.select("stretch", "slot", F.element_at(F.filter("s", lambda x: x["weight_from"] <= point), -1)["source"].alias("source"))
    per = dealt.groupBy("source", "stretch").agg(F.count(F.lit(1)).alias("c"))
    base = per.select("source", "stretch", F.coalesce(F.sum("c").over(Window.partitionBy("source").orderBy("stretch").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("base"))
    rank = F.row_number().over(Window.partitionBy("source", "stretch").orderBy("slot")) - 1
    return dealt.withColumn("k", rank).join(base, ["source", "stretch"]).select("slot", "source", (F.col("base") + F.col("k")).alias("block"))


def shares(mixed: DataFrame, weights: DataFrame) -> DataFrame:
    """(source, target_share, max_repeats, tokens, texts, most_uses, scaled_share, actual_share) for every listed source.

    ``scaled_share`` is the target among the sources that have texts, null for the others.
    """
    uses = mixed.groupBy("source", "doc_id").agg(F.sum("n_tokens").alias("t"), F.count(F.lit(1)).alias("u"))
    got = uses.groupBy("source").agg(F.sum("t").alias("tokens"), F.count(F.lit(1)).alias("texts"), F.max("u").alias("most_uses"))
    both = weights.select("source", "target_share", "max_repeats").join(got, "source", "left").fillna(0, ["tokens", "texts", "most_uses"])
    everything = Window.partitionBy(F.lit(0))  # one row a source
    here = F.when(F.col("tokens") > 0, F.col("target_share"))
    return both.withColumn("scaled_share", here / F.sum(here).over(everything)).withColumn("actual_share", F.try_divide("tokens", F.sum("tokens").over(everything)))
