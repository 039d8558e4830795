"""Incremental index: postings and vocabulary of documents as they arrive (an extension; batch is the norm)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from tamiz.operators import stats


def append_postings(docs: DataFrame, folder: str, checkpoint: str) -> DataStreamWriter:
    """Writer that appends each micro-batch's postings under ``folder/batch=N``.

    A batch that is repeated after a failure overwrites its own folder, so the index stays exact.
    A document belongs to one batch; a later version of it is a document of its own.
    """

    def write(batch: DataFrame, number: int) -> None:
        stats.postings(stats.occurrences(batch)).sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(f"{folder}/batch={number}")

    return docs.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)


def read_vocabulary(spark, folder: str) -> DataFrame:
    """(term, cf, df) over all batches so far."""
    return stats.vocabulary(spark.read.parquet(folder))


def windowed_counts(events: DataFrame, at: str, kind: str, value: str, late: str = "1 hour", size: str = "1 hour") -> DataFrame:
    """Counts and sums by window and kind; rows later than ``late`` are dropped once their window closed."""
    w = events.withWatermark(at, late).groupBy(F.window(at, size).alias("w"), kind)
    return w.agg(F.count(F.lit(1)).alias("n"), F.sum(value).alias("total")).select(F.col("w.start").alias("start"), kind, "n", "total")
