"""Queries p1, p3 to p6 and p8 to p10, and their SQL where there is any."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.llm import boilerplate, mixing, neardup, ngrams, pii, tokenizer, topn, weights
from tamiz.session import checkpointed, spread, table


def _p1_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.found(table(spark, d, "read_corpus"))


def _p1_bodies(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.main_bodies(table(spark, d, "read_corpus"))


def _p3_found(spark: SparkSession, d: str) -> DataFrame:
    rows = table(spark, d, "posting_chunk")
    counts = ngrams.term_counts(rows)
    got = ngrams.marked(counts, rows.where("term_id is not null and docid is not null").select("docid"))
    return got.where("mark is not null").select("term_id", "mark")


def _p3_term_counts(spark: SparkSession, d: str) -> DataFrame:
    return ngrams.term_counts(table(spark, d, "posting_chunk"))


def _p3_phrase_counts(spark: SparkSession, d: str) -> DataFrame:
    got = ngrams.phrase_counts(table(spark, d, "read_queries").where("qid is not null").select("qid", "query", "read_at").withColumn("k", F.concat_ws("|", "qid", F.col("read_at").cast("string"))), "k", "query", 2)
    return got.select(F.array_join("gram", " ").alias("gram"), "cf", "df")


def _p4_found(spark: SparkSession, d: str) -> DataFrame:
    return neardup.found(table(spark, d, "read_corpus"))


def _p4_groups(spark: SparkSession, d: str) -> DataFrame:
    return neardup.groups(checkpointed(neardup.page_sets(table(spark, d, "read_corpus"))))


def _p5_found(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "run_results").where("qid is not null"), ["qid", "model"], "docno", "score").select("qid", "model", "docno")


def _p5_ranked(spark: SparkSession, d: str) -> DataFrame:
    return topn.top_n(table(spark, d, "run_results").where("qid is not null"), ["qid", "model"], "docno", "score")


def _p6_found(spark: SparkSession, d: str) -> DataFrame:
    return weights.best_terms(table(spark, d, "posting_chunk")).select("docid", "term_id")


def _p6_scores(spark: SparkSession, d: str) -> DataFrame:
    return weights.scores(table(spark, d, "posting_chunk"))


def _p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokenizer.encoded(table(spark, d, "documents").select("doc_id", "text")).select("doc_id", "ids")


def _p8_token_counts(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", tokenizer.token_count(F.col("text")).alias("n_tokens"))


def _p9_mixture(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mixture(table(spark, d, "documents"), table(spark, d, "source_weights"))


def _p9_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.shares(_p9_mixture(spark, d), table(spark, d, "source_weights"))


def _p10_found(spark: SparkSession, d: str) -> DataFrame:
    return pii.found(spread(table(spark, d, "documents").select("doc_id", "text")))


def _p10_redacted(spark: SparkSession, d: str) -> DataFrame:
    return pii.redact(spread(table(spark, d, "documents").select("doc_id", "text"))).select("doc_id", "redacted", F.size("pii").alias("n_found"))


QUERIES = {
    "p1_found": _p1_found,
    "p1_bodies": _p1_bodies,
    "p3_found": _p3_found,
    "p3_term_counts": _p3_term_counts,
    "p3_phrase_counts": _p3_phrase_counts,
    "p4_found": _p4_found,
    "p4_groups": _p4_groups,
    "p5_found": _p5_found,
    "p5_ranked": _p5_ranked,
    "p6_found": _p6_found,
    "p6_scores": _p6_scores,
    "p8_ids": _p8_ids,
    "p8_token_counts": _p8_token_counts,
    "p9_mixture": _p9_mixture,
    "p9_shares": _p9_shares,
    "p10_found": _p10_found,
    "p10_redacted": _p10_redacted,
}

_COUNTS = "select term_id, sum(coalesce(freq, 0))::bigint as cf, count(distinct docid) as df from (select distinct term_id, docid, freq from posting_chunk where term_id is not null and docid is not null) group by term_id"
_TOP = """with b as (select qid, model, docno, max(score) as score from run_results where qid is not null and docno is not null and score is not null and not isnan(score) group by all)
  select qid, model, docno{} from (select *, row_number() over (partition by qid, model order by score desc, docno) as rank from b) where rank <= 10"""
_POST = "select distinct term_id, docid, coalesce(freq, 0) as freq from posting_chunk where term_id is not null and docid is not null"
_DF = "select term_id, count(distinct docid) as df from p group by term_id"

SQL = {
    "p3_found": f"""with c as ({_COUNTS}), n as (select count(distinct docid) as n from posting_chunk where term_id is not null and docid is not null)
  select term_id, mark from (select term_id, case when df < 3 then 'rare' when df >= 0.1 * n then 'common' end as mark from c, n) where mark is not null""",
    "p3_term_counts": _COUNTS,
    "p3_phrase_counts": r"""with q as (select row_number() over () as r, qid, regexp_extract_all(lower(query), '[\p{L}\p{N}]+') as w, concat_ws('|', qid, cast(read_at as varchar)) as k from read_queries where qid is not null),
  i as (select k, w, unnest(generate_series(1, len(w))) as i from q), g as (select k, w[i] as gram from i union all select k, w[i] || ' ' || w[i + 1] from i where i < len(w))
  select gram, count(*) as cf, count(distinct k) as df from g group by gram""",
    "p5_found": _TOP.format(""),
    "p5_ranked": _TOP.format(", score, rank::int as rank"),
    "p6_found": f"""with p as ({_POST}), d as ({_DF}), n as (select count(distinct docid) as n from p),
  s as (select docid, term_id, round(freq * ln(n::double / df), 6) as score from p join d using (term_id), n)
  select docid, term_id from (select *, row_number() over (partition by docid order by score desc, term_id) as r from s) where r = 1""",
    "p6_scores": f"""with p0 as ({_POST}), p as (select term_id, docid, sum(freq) as freq from p0 group by all), d as ({_DF}), n as (select count(distinct docid) as n from p),
  w as (select docid, term_id, freq * (ln((1.0 + n) / (1.0 + df)) + 1) as w from p join d using (term_id), n)
  select docid, term_id, round(w / nullif(sqrt(sum(w * w) over (partition by docid)), 0), 6) as score from w""",
}
