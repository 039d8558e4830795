"""Corpus statistics: frequencies of terms, documents and collections."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tamiz.functions import text as tx
from tamiz.session import broadcast_if_small


def occurrences(docs: DataFrame, pattern: str = tx.LETTERS, key: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, term), a row for each token."""
    return docs.select(F.col(key).alias("doc_id"), F.explode(tx.tokens(text, pattern)).alias("term"))


def filtered(tokens: DataFrame, stop: DataFrame | None = None, least: int = 1, most: int = 1 << 30) -> DataFrame:
    """Tokens of a length in bounds that are not stop words (``stop``: column ``term``)."""
    got = tokens.where(tx.kept_length(least, most))
    return got if stop is None else got.join(broadcast_if_small(stop.select("term").distinct()), "term", "left_anti")


def stop_words(source: DataFrame, text: str = "text") -> DataFrame:
    """Stop words of a free text, as runs of a to z of its lower-cased lines."""
    return source.select(F.explode(tx.tokens(text, tx.ASCII)).alias("term")).distinct()


def word_count(tokens: DataFrame) -> DataFrame:
    return tokens.groupBy("term").agg(F.count(F.lit(1)).alias("cf"))


def postings(tokens: DataFrame) -> DataFrame:
    """(term, doc_id, tf)."""
    return tokens.groupBy("term", "doc_id").agg(F.count(F.lit(1)).alias("tf"))


def vocabulary(posts: DataFrame) -> DataFrame:
    """(term, cf, df)."""
    return posts.groupBy("term").agg(F.sum("tf").alias("cf"), F.count(F.lit(1)).alias("df"))


def document_lengths(posts: DataFrame) -> DataFrame:
    return posts.groupBy("doc_id").agg(F.sum("tf").alias("doc_len"))


def corpus_stats(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """One row: num_docs, num_terms, num_tokens."""
    v = vocabulary(posts).agg(F.count(F.lit(1)).alias("num_terms"), F.coalesce(F.sum("cf"), F.lit(0)).alias("num_tokens"))
    return v.select(docs.select(F.count(F.lit(1))).scalar().alias("num_docs"), "num_terms", "num_tokens")


def summary(docs: DataFrame, posts: DataFrame) -> DataFrame:
    """Six figures: documents, tokens, tokens a document, mean term length over the vocabulary, shortest and longest document, terms that occur once.

    Averages of nothing are null, not errors.
    """
    n = document_lengths(posts).agg(F.min("doc_len").alias("min_doc_tokens"), F.max("doc_len").alias("max_doc_tokens"))
    v = vocabulary(posts).agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("num_tokens"), F.avg(F.length("term")).alias("mean_term_length"), F.count_if(F.col("cf") == 1).alias("hapax"))
    docs_n = docs.select(F.count(F.lit(1))).scalar()
    one = lambda c: n.select(c).scalar().alias(c)
    return v.select(docs_n.alias("num_docs"), "num_tokens", F.round(F.try_divide("num_tokens", docs_n), 6).alias("tokens_per_doc"), F.round("mean_term_length", 6).alias("mean_term_length"), one("min_doc_tokens"), one("max_doc_tokens"), "hapax")


def top_terms(vocab: DataFrame, n: int = 10) -> DataFrame:
    """Highest cf first; equal ones by term descending."""
    return vocab.select("term", "cf").orderBy(F.desc("cf"), F.desc("term")).limit(n)


def bottom_terms(vocab: DataFrame, n: int = 10) -> DataFrame:
    return vocab.select("term", "cf").orderBy("cf", "term").limit(n)


def surface_df(tokens: DataFrame, stems: DataFrame) -> DataFrame:
    """Document frequency of stems counted per distinct surface form and document, so it can exceed the number of documents (``stems``: term, stem)."""
    return tokens.distinct().join(stems, "term").groupBy("stem").agg(F.count(F.lit(1)).alias("df"))
