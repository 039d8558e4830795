"""The N best items of every group by secondary sort.

Each item's best score is found first (a hash aggregate on group and item, which no large group
can skew).  Those partitions are sorted by group, score and item and streamed as Arrow batches that
keep N rows a group; so at most N rows of a group leave a partition.  They are hash-partitioned by group,
sorted and streamed in the same way.  Nothing is held but the current group's running rank.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tamiz.llm.ngrams import _changes


def _head(width: int, n: int):
    """Keeps the first n rows of each run of equal values in the first ``width`` columns."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen = None, 0
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            cols = [batch.column(i) for i in range(width)]
            first = np.flatnonzero(_changes(cols, rows))
            rank = np.arange(rows) - np.repeat(first, np.diff(np.r_[first, rows]))
            begin = tuple(c[0].as_py() for c in cols)
            if begin == group:
                rank[: first[1] if len(first) > 1 else rows] += seen
            group, seen = tuple(c[rows - 1].as_py() for c in cols), int(rank[-1]) + 1
            keep = np.flatnonzero(rank < n)
            if len(keep):
                yield batch.take(pa.array(keep))

    return run


def top_n(rows: DataFrame, groups: list[str], item: str, score: str, n: int = 10) -> DataFrame:
    """(groups, item, score, rank): an item counts once, with its highest score; equal scores go by item ascending.

    Rows with a null or NaN score or a null item are ignored; a null group value forms a group of
    its own (filter before where it is no case).  Groups with fewer items give fewer rows.
    """
    if "rank" in (*groups, item, score):
        raise ValueError("'rank' is the name of the result's last column")
    usable = rows.select(*groups, item, score).where(F.col(score).isNotNull() & ~F.isnan(score) & F.col(item).isNotNull())
    best = usable.groupBy(*groups, item).agg(F.max(score).alias(score))
    order = [*groups, F.col(score).desc(), F.col(item).asc()]
    head = _head(len(groups), n)
    local = best.sortWithinPartitions(*order).mapInArrow(head, best.schema)
    top = local.repartition(*groups).sortWithinPartitions(*order).mapInArrow(_ranked(len(groups), n), T.StructType([*best.schema.fields, T.StructField("rank", T.IntegerType())]))
    return top


def _ranked(width: int, n: int):
    head = _head(width, n)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, seen = None, 0
        for batch in head(batches):
            rows = batch.num_rows
            cols = [batch.column(i) for i in range(width)]
            first = np.flatnonzero(_changes(cols, rows))
            rank = np.arange(rows) - np.repeat(first, np.diff(np.r_[first, rows]))
            if tuple(c[0].as_py() for c in cols) == group:
                rank[: first[1] if len(first) > 1 else rows] += seen
            group, seen = tuple(c[rows - 1].as_py() for c in cols), int(rank[-1]) + 1
            yield pa.record_batch([*batch.columns, pa.array(rank.astype(np.int32) + 1)], names=[*batch.schema.names, "rank"])

    return run
