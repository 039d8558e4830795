"""Text, CSV and Parquet reports.  Every writer replaces what is there."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tamiz.operators import stats


def term_list(vocab: DataFrame, folder: str) -> None:
    """``term cf df`` lines, terms ascending; files in order of name."""
    vocab.orderBy("term").select(F.concat_ws(" ", "term", F.col("cf").cast("string"), F.col("df").cast("string")).alias("line")).write.mode("overwrite").text(folder)


def statistics(summary: DataFrame, folder: str) -> None:
    """The six lines of a corpus summary."""
    s = lambda *c: F.concat_ws(" ", *[F.coalesce(F.col(x).cast("string"), F.lit("0")) for x in c])
    lines = F.array(s("num_docs"), s("num_tokens"), s("tokens_per_doc"), s("mean_term_length"), s("min_doc_tokens", "max_doc_tokens"), s("hapax"))
    summary.select(F.explode(lines).alias("line")).coalesce(1).write.mode("overwrite").text(folder)


def frequencies(vocab: DataFrame, folder: str, n: int = 10) -> None:
    """The n most frequent terms, then the n least frequent ones."""
    top = stats.top_terms(vocab, n).select(F.lit(0).alias("k"), (-F.col("cf")).alias("o"), "term", "cf")
    low = stats.bottom_terms(vocab, n).select(F.lit(1).alias("k"), F.col("cf").alias("o"), "term", "cf")
    rows = top.unionByName(low).coalesce(1).sortWithinPartitions("k", "o", F.when(F.col("k") == 0, F.col("term")).desc_nulls_last(), "term")
    rows.select(F.concat_ws(" ", "term", F.col("cf").cast("string")).alias("line")).write.mode("overwrite").text(folder)


def csv(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").option("header", "true").csv(folder)


def per_query(run: DataFrame, folder: str, key: str = "qid") -> None:
    """A folder for each query; rows are brought together by query first, so that each writes few files."""
    run.repartition(key).sortWithinPartitions(key, "rank").write.mode("overwrite").partitionBy(key).option("header", "true").csv(folder)


def human_bytes(n: Column) -> Column:
    """A number of bytes with one decimal in B, KB, MB, GB or TB."""
    out = F.format_string("%.1f TB", n / float(1 << 40))
    for power, unit in ((3, "GB"), (2, "MB"), (1, "KB"), (0, "B")):
        out = F.when(n < float(1 << 10 * (power + 1)), F.format_string(f"%.1f {unit}", n / float(1 << 10 * power))).otherwise(out)
    return out


def table(rows: DataFrame, folder: str) -> None:
    rows.write.mode("overwrite").parquet(folder)


def graph(nodes: DataFrame, edges: DataFrame, folder: str) -> None:
    table(nodes, f"{folder}/nodes")
    table(edges, f"{folder}/edges")


def load_graph(spark, folder: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{folder}/nodes"), spark.read.parquet(f"{folder}/edges")
