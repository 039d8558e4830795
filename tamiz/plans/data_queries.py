"""Queries p2 and p7 and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.operators import references as ref
from tamiz.operators import skew
from tamiz.session import table


def _p2_found(spark: SparkSession, d: str) -> DataFrame:
    return skew.heavy_lists(table(spark, d, "posting_chunk")).select("index_no", "term_id")


def _p2_list_lengths(spark: SparkSession, d: str) -> DataFrame:
    return skew.list_lengths(table(spark, d, "posting_chunk"))


def _p2_length_audit(spark: SparkSession, d: str) -> DataFrame:
    return skew.length_audit(table(spark, d, "posting_chunk"), table(spark, d, "disk_posting_list"))


def _p7(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    refs = ref.references(table(spark, d, "read_qrels"), "judgment_id", "judged_at", ["docno", "qid"])
    known = ref.parents({"docno": (table(spark, d, "read_corpus"), "docno"), "qid": (table(spark, d, "read_queries"), "qid")}, "read_at", "removed_at")
    return refs, known


def _p7_found(spark: SparkSession, d: str) -> DataFrame:
    return ref.orphans(*_p7(spark, d)).select(F.col("id").alias("judgment_id"), "ref_field")


def _p7_orphan_report(spark: SparkSession, d: str) -> DataFrame:
    return ref.orphan_report(*_p7(spark, d))


QUERIES = {
    "p2_found": _p2_found,
    "p2_list_lengths": _p2_list_lengths,
    "p2_length_audit": _p2_length_audit,
    "p7_found": _p7_found,
    "p7_orphan_report": _p7_orphan_report,
}

_LENGTHS = """select index_no, term_id, count(distinct docid) as length from posting_chunk
  where index_no is not null and term_id is not null and docid is not null group by all"""
_REFS = """select judgment_id, judged_at, f as ref_field, nullif(trim(k, ' ' || chr(9)), '') as k
  from (select judgment_id, judged_at, 'docno' as f, docno as k from read_qrels union all select judgment_id, judged_at, 'qid', qid from read_qrels)"""
_PARENTS = "select 'docno' as f, docno as k, read_at, removed_at from read_corpus union all select 'qid', qid, read_at, removed_at from read_queries"

SQL = {
    "p2_found": f"with l as ({_LENGTHS}) select index_no, term_id from (select *, sum(length) over (partition by index_no) as n from l) where length >= 0.02 * n",
    "p2_list_lengths": _LENGTHS,
    "p2_length_audit": f"""with l as ({_LENGTHS}), s as (select index_no, term_id, min(length) as stored_min, max(length) as stored_max, true as listed from disk_posting_list where index_no is not null and term_id is not null group by all)
  select index_no, term_id, coalesce(length, 0) as length, stored_min, stored_max,
    case when listed is null then 'unlisted' when length is null then 'no postings' when stored_min is null then 'no length'
      when stored_min = length and stored_max = length then 'equal' else 'stale' end as state
  from l full join s using (index_no, term_id)""",
    "p7_found": f"""with r as ({_REFS}), p as ({_PARENTS}) select judgment_id, ref_field from r where k is not null and not exists
  (select 1 from p where p.f = r.ref_field and p.k = r.k and read_at <= judged_at and (removed_at is null or removed_at > judged_at))""",
    "p7_orphan_report": f"""with r as ({_REFS}), p as ({_PARENTS}),
  s as (select ref_field, judged_at, exists (select 1 from p where p.f = r.ref_field and p.k = r.k and read_at <= judged_at and (removed_at is null or removed_at > judged_at)) as living,
    exists (select 1 from p where p.f = r.ref_field and p.k = r.k and read_at <= judged_at) as before, exists (select 1 from p where p.f = r.ref_field and p.k = r.k and read_at is not null) as ever from r where k is not null)
  select ref_field, strftime(judged_at, '%Y-%m') as month, count(*) filter (not ever) as missing, count(*) filter (before) as deleted, count(*) filter (ever and not before) as late, count(*) as orphans
  from s where not living group by all""",
}
