"""Frequencies of all terms and n-grams by suffix sorting.

Every truncated suffix (up to ``sigma`` terms) of every record's sequence is routed by its first
term, sorted in reverse lexicographic order and read once with a stack of ``sigma`` open prefixes:
a prefix is closed, and its total and number of records are final, as soon as a suffix that does not begin
with it goes by.  Records are counted where a row is its record's first under the prefix, so that no set of
records is held, however many share a term.  Routing is by ranges of (first term, record), so a first term that owns a large share of
the rows is cut at record boundaries; the partial counts of one gram in several ranges concern
disjoint records and are simply added (a row a gram and range goes through that last shuffle).
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _changes(cols: list[pa.Array], n: int) -> np.ndarray:
    """Where a row differs from the one before in any column; the first row counts as different."""
    out = np.ones(n, bool)
    if n > 1:
        out[1:] = False
        for c in cols:
            a, b = c.slice(1), c.slice(0, n - 1)
            differ = pc.or_kleene(pc.fill_null(pc.not_equal(a, b), False), pc.xor(pc.is_null(a), pc.is_null(b)))
            out[1:] |= differ.to_numpy(zero_copy_only=False)
    return out


def _stack(sigma: int, schema: pa.Schema):
    """Streams sorted suffixes; the state kept across batches is four values for each length.

    Columns: the terms, the record, its weight, and for each length but the longest whether the row is the first
    of its record under that prefix.  Under the longest prefix records come sorted, so a record is new where
    it differs from the one before.
    """
    kind = schema.field(0).type

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple | None] = [None] * sigma  # (prefix, cf, df, last record) by length

        def told(level: int) -> pa.RecordBatch:
            prefix, cf, df, _ = held[level]
            return pa.record_batch([pa.array([list(prefix)], kind), pa.array([cf], pa.int64()), pa.array([df], pa.int64())], schema=schema)

        for batch in batches:
            n = batch.num_rows
            if not n:
                continue
            cols = [batch.column(i) for i in range(sigma)]
            record, weight = (batch.column(sigma + i).to_numpy(zero_copy_only=False) for i in range(2))
            differs = np.zeros(n, bool)
            for level in range(sigma):
                differs |= _changes([cols[level]], n)
                # rows too short for this length close nothing: they follow the longer ones of their prefix
                live = np.flatnonzero(pc.is_valid(cols[level]).to_numpy(zero_copy_only=False))
                if not len(live):
                    continue
                seg = np.cumsum(differs)[live]
                first = np.flatnonzero(np.r_[True, seg[1:] != seg[:-1]])
                at = live[first]
                prefix = lambda i: tuple(c[int(at[i])].as_py() for c in cols[: level + 1])  # noqa: B023, E731
                goes_on = held[level] is not None and held[level][0] == prefix(0)
                rec = record[live]
                if level < sigma - 1:
                    new = batch.column(sigma + 2 + level).to_numpy(zero_copy_only=False)[live].astype(np.int64)
                else:
                    new = np.r_[True, rec[1:] != rec[:-1]].astype(np.int64)
                    new[first] = 1
                    if goes_on and rec[0] == held[level][3]:
                        new[0] = 0
                cf, df = np.add.reduceat(weight[live], first), np.add.reduceat(new, first)
                if goes_on:
                    cf[0] += held[level][1]
                    df[0] += held[level][2]
                elif held[level] is not None:
                    yield told(level)
                last, width = len(first) - 1, level + 1
                held[level] = (prefix(last), int(cf[last]), int(df[last]), rec[-1])
                if last:
                    take = pa.array(at[:last])
                    flat = pc.take(pa.concat_arrays([pc.take(c, take) for c in cols[:width]]), pa.array((np.arange(last)[:, None] + last * np.arange(width)[None, :]).reshape(-1)))
                    grams = pa.ListArray.from_arrays(pa.array(np.arange(0, last * width + 1, width), pa.int32()), flat)
                    yield pa.record_batch([grams.cast(kind), pa.array(cf[:last].astype(np.int64)), pa.array(df[:last])], schema=schema)
        for level in range(sigma):
            if held[level] is not None:
                yield told(level)

    return run


def gram_counts(suffixes: DataFrame, sigma: int, term_type: T.DataType) -> DataFrame:
    """(gram, cf, df) from rows (s0, ..., record, weight): total weight and number of records."""
    s = [f"s{i}" for i in range(sigma)]
    ranged = suffixes.repartitionByRange("s0", "record")
    # equal rows of a record are one; the range partitioning serves this aggregate, and the windows, without a shuffle
    rows = ranged.groupBy(*s, "record", "part").agg(F.first("weight").alias("weight")).drop("part") if "part" in suffixes.columns else ranged
    # rows of a first term and record lie in one partition: one sort numbers them under each of their prefixes
    number = lambda k: F.row_number().over(Window.partitionBy("s0", "record", *s[1:k]).orderBy(*s[k:]))
    rows = rows.select(*s, "record", "weight", *[(number(k) == 1).alias(f"f{k}") for k in range(1, sigma)])
    rows = rows.sortWithinPartitions(*[F.col(c).desc_nulls_last() for c in s], "record")
    out = T.StructType([T.StructField("gram", T.ArrayType(term_type)), T.StructField("cf", T.LongType()), T.StructField("df", T.LongType())])
    kind = {"bigint": pa.int64(), "string": pa.string()}[term_type.simpleString()]
    schema = pa.schema([("gram", pa.list_(kind)), ("cf", pa.int64()), ("df", pa.int64())])
    partial = rows.mapInArrow(_stack(sigma, schema), out)
    return partial.groupBy("gram").agg(F.sum("cf").alias("cf"), F.sum("df").alias("df"))


def term_counts(postings: DataFrame, term: str = "term_id", record: str = "docid", freq: str = "freq") -> DataFrame:
    """(term_id, cf, df) over distinct (term, record, freq).

    Rows with a null term or record are left out; a null freq adds nothing to ``cf`` but its record
    counts in ``df``.  A posting written again with an equal freq counts once.
    """
    rows = postings.select(F.col(term).alias("s0"), F.col(record).alias("record"), F.col(freq).alias("part"), F.coalesce(freq, F.lit(0)).cast("bigint").alias("weight")).dropna(subset=["s0", "record"])
    got = gram_counts(rows, 1, T.LongType())
    return got.select(F.col("gram")[0].alias(term), "cf", "df")


def phrase_counts(texts: DataFrame, key: str, text: str, sigma: int = 3) -> DataFrame:
    """(gram, cf, df) of all runs of up to ``sigma`` words; words are lower-cased letters and digits.

    Null and empty texts have no words.  A text read twice under one key counts as one record.
    """
    words = F.regexp_extract_all(F.lower(F.col(text)), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))
    at = texts.select(F.xxhash64(key).alias("record"), words.alias("w")).select("record", "w", F.posexplode("w").alias("i", "s0"))
    rows = at.select("s0", *[F.get("w", F.col("i") + k).alias(f"s{k}") for k in range(1, sigma)], "record", F.lit(1).cast("bigint").alias("weight"))
    return gram_counts(rows, sigma, T.StringType())


def marked(counts: DataFrame, records: DataFrame, rare: int = 3, common: float = 0.1) -> DataFrame:
    """``counts`` with ``mark``: ``rare`` under ``rare`` records, ``common`` from that share of ``records``, else null."""
    n = records.distinct().select(F.count(F.lit(1))).scalar()
    return counts.withColumn("mark", F.when(F.col("df") < rare, "rare").when(F.col("df") >= common * n, "common"))
