"""References to records that do not exist, are deleted, or arrive later.

References and parent records are brought into one stream, co-partitioned by key and sorted by
(key, time), and merged linearly: while the stream of a key passes, the latest end of any validity
interval begun so far is carried along, and a reference is alive when that end lies after it.  The
carried values are running maxima, so no group is buffered.

A key named by more than ``1 / HOT`` of all references is salted: its references are dealt to
as many parts as its share asks for, each of at most ``1 / HOT`` of all, and its (already merged) parent rows are
copied to each.  There are fewer than ``HOT`` such keys, and fewer than ``2 HOT`` parts, by construction,
which bounds what is broadcast.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

HOT = 1000
_END = "timestamp'9999-12-31 00:00:00'"


def trimmed(c: str) -> Column:
    """The key without blanks and tabs around it; null if nothing is left."""
    return F.nullif(F.regexp_replace(c, r"^[ \t]+|[ \t]+$", ""), F.lit(""))


def references(refs: DataFrame, key: str, at: str, fields: list[str]) -> DataFrame:
    """One row for each reference: (id, at, ref_field, ref_key)."""
    pairs = F.explode(F.array(*[F.struct(F.lit(f).alias("ref_field"), trimmed(f).alias("ref_key")) for f in fields]))
    out = refs.select(F.col(key).alias("id"), F.col(at).cast("timestamp_ntz").alias("at"), pairs.alias("r"))
    return out.select("id", "at", "r.ref_field", "r.ref_key").where("ref_key is not null")


def parents(tables: dict[str, tuple[DataFrame, str]], begin: str, end: str) -> DataFrame:
    """Validity intervals (ref_field, ref_key, begin, end): open ones merged to the earliest of a key."""
    out = None
    for field, (df, key) in tables.items():
        one = df.select(F.lit(field).alias("ref_field"), F.col(key).alias("ref_key"), F.col(begin).cast("timestamp_ntz").alias("begin"), F.col(end).cast("timestamp_ntz").alias("end"))
        out = one if out is None else out.unionByName(one)
    return out.where("ref_key is not null and begin is not null").groupBy("ref_field", "ref_key", "end").agg(F.min("begin").alias("begin"))


def resolve(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Every reference with its ``status``: living, deleted, late or missing.

    deleted: a parent began before, and all of those had ended; late: the first parent begins after
    the reference; missing: no parent at any time.  A reference without a time is never living; it is late
    if the key has any parent, else missing.  Empty inputs give empty or all-missing results;
    repeated references give repeated rows.
    """
    keys = ["ref_field", "ref_key"]
    n = refs.groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    total = refs.select(F.count(F.lit(1))).scalar()
    hot = n.where(F.col("n") * HOT > total).select(*keys, F.ceil(F.col("n") * HOT / total).cast("int").alias("parts"))
    hot = F.broadcast(hot)  # fewer than HOT rows
    left = refs.join(hot, keys, "left").withColumn("salt", F.coalesce(F.pmod(F.xxhash64("id"), F.col("parts")), F.lit(0)).cast("int")).drop("parts")
    first = known.groupBy(*keys).agg(F.min("begin").alias("first_begin"))
    events = known.select(*keys, F.col("begin").alias("at"), F.lit(1).alias("kind"), F.coalesce("end", F.expr(f"cast({_END} as timestamp_ntz)")).alias("until"), F.lit(None).cast("timestamp_ntz").alias("first_begin"))
    # the summary row of a key comes before everything else of it
    events = events.unionByName(first.select(*keys, F.lit(None).cast("timestamp_ntz").alias("at"), F.lit(0).alias("kind"), F.lit(None).cast("timestamp_ntz").alias("until"), "first_begin"))
    events = events.join(hot, keys, "left").withColumn("salt", F.explode(F.when(F.col("parts").isNotNull(), F.sequence(F.lit(0), F.col("parts") - 1)).otherwise(F.array(F.lit(0))))).drop("parts")
    stream = left.select(*keys, "salt", "at", F.lit(2).alias("kind"), "id").unionByName(events, allowMissingColumns=True)
    so_far = Window.partitionBy(*keys, "salt").orderBy(F.col("at").asc_nulls_first(), "kind").rowsBetween(Window.unboundedPreceding, 0)
    merged = stream.select("*", F.max("until").over(so_far).alias("alive_until"), F.max("first_begin").over(so_far).alias("known_from")).where("kind = 2")
    status = F.when(F.col("alive_until") > F.col("at"), "living").when(F.col("alive_until").isNotNull(), "deleted").when(F.col("known_from").isNotNull(), "late").otherwise("missing")
    return merged.select("id", "at", *keys, status.alias("status"))


def orphans(refs: DataFrame, known: DataFrame) -> DataFrame:
    return resolve(refs, known).where("status <> 'living'")


def orphan_report(refs: DataFrame, known: DataFrame) -> DataFrame:
    """Orphans per referenced table and month: (ref_field, month, missing, deleted, late, orphans)."""
    count = lambda s: F.count_if(F.col("status") == s).alias(s)
    got = orphans(refs, known).groupBy("ref_field", F.date_format("at", "yyyy-MM").alias("month"))
    return got.agg(count("missing"), count("deleted"), count("late"), F.count(F.lit(1)).alias("orphans"))
