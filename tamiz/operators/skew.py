"""Per-key results where a few keys own most rows.

Rows are range-partitioned on a composite key (key columns, then a secondary order) with boundaries
at quantiles that Spark samples from every input partition, so a heavy key spans several partitions
and a task holds about its share of the rows whatever the keys look like.  Equal composite keys
stay together, hence distinct values of the secondary order can be counted where they are; each
partition then gives one partial state for each key it holds, and a small aggregate stitches the
states of keys that a boundary cut.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def distinct_counts(df: DataFrame, keys: list[str], order: list[str], name: str = "n", partitions: int | None = None) -> DataFrame:
    """``keys`` and the number of distinct ``order`` values of each key.

    Rows with a null in any of these columns are no cases and are left out.  Repeated rows count
    once; an empty table gives an empty result; other columns are not read.  ``partitions`` fixes
    the number of ranges, else the session and adaptive execution decide.
    """
    cols = [*keys, *order]
    if name in cols:
        raise ValueError(f"{name!r} is a column of the table")
    rows = df.select(*cols).dropna(subset=cols)
    ranged = rows.repartitionByRange(partitions, *cols) if partitions else rows.repartitionByRange(*cols)
    # the range partitioning on exactly these columns satisfies this aggregate: no second shuffle
    once = ranged.groupBy(*cols).agg(F.lit(True).alias("__seen"))
    # partial counts are made in the same stage, one row a key and range; only those are shuffled
    return once.groupBy(*keys).agg(F.count(F.lit(1)).alias(name))


def list_lengths(postings: DataFrame) -> DataFrame:
    """(index_no, term_id, length): the true length of every posting list."""
    return distinct_counts(postings, ["index_no", "term_id"], ["docid"], "length")


def heavy_lists(postings: DataFrame, share: float = 0.02) -> DataFrame:
    """(index_no, term_id, length, index_postings) of lists with at least ``share`` of their index."""
    lengths = list_lengths(postings)
    total = lengths.groupBy("index_no").agg(F.sum("length").alias("index_postings"))
    return lengths.join(total, "index_no").where(F.col("length") >= share * F.col("index_postings"))


def length_audit(postings: DataFrame, stored: DataFrame) -> DataFrame:
    """True length of each list beside the smallest and largest stored one.

    ``state`` is ``equal``, ``stale`` (a stored length differs), ``no length`` (only nulls stored),
    ``unlisted`` (no entry) or ``no postings`` (an entry without postings, true length 0).
    Entries with a null index_no or term_id are left out; entries listed twice count once.
    """
    kept = stored.dropna(subset=["index_no", "term_id"]).groupBy("index_no", "term_id").agg(F.min("length").alias("stored_min"), F.max("length").alias("stored_max"), F.lit(True).alias("listed"))
    both = list_lengths(postings).join(kept, ["index_no", "term_id"], "full")
    n = F.coalesce("length", F.lit(0))
    state = (
        F.when(F.col("listed").isNull(), "unlisted")
        .when(F.col("length").isNull(), "no postings")
        .when(F.col("stored_min").isNull(), "no length")
        .when((F.col("stored_min") == n) & (F.col("stored_max") == n), "equal")
        .otherwise("stale")
    )
    return both.select("index_no", "term_id", n.alias("length"), "stored_min", "stored_max", state.alias("state"))


HOT = 2000


def join_counts(rows: DataFrame, per_key: DataFrame, key: str, count: str) -> DataFrame:
    """``rows`` joined with a table of one row a key, whose ``count`` says how many rows the key has.

    Keys that own more than ``1 / HOT`` of all rows are joined by broadcast (fewer than ``HOT`` of them), the others by a shuffle that
    such keys cannot skew.  Rows of unknown keys are left out.
    """
    total = per_key.agg(F.sum(count)).scalar()
    hot = F.broadcast(per_key.where(F.col(count) * HOT > total))
    known = [c for c in per_key.columns if c != key]
    marked = rows.join(hot, key, "left")
    cold = marked.where(F.col(count).isNull()).drop(*known).join(per_key.where(F.col(count) * HOT <= total), key)
    return marked.where(F.col(count).isNotNull()).unionByName(cold)
