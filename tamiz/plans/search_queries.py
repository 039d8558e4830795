"""Boolean and ranked retrieval over ``documents`` by the topics of ``read_queries``; evaluation of ``run_results``; their SQL.

Retrieval reads a stored index of ``documents``, which is built on first use; the model grid is run on the postings of
``posting_chunk`` and evaluated on ``read_qrels``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions import codec, stem
from tamiz.functions import text as tx
from tamiz.operators import blocks, boolean, evaluate, rank, stats
from tamiz.operators import index as ix
from tamiz.plans import lexical_queries as lx
from tamiz.session import checkpointed, table

ENTRY_QUERY = "the of and"


def _folder(spark: SparkSession, d: str) -> str:
    return ix.stored(spark, lx.docs(spark, d), "documents")


def _index(spark: SparkSession, d: str) -> rank.Index:
    return rank.Index.stored(spark, _folder(spark, d))


def _part(name: str):
    return lambda s, d: s.read.parquet(f"{_folder(s, d)}/{name}")


_posts, _skips = _part("postings"), _part("skips")


def _topics(spark: SparkSession, d: str) -> DataFrame:
    return rank.latest_topics(table(spark, d, "read_queries"))


def _terms(spark: SparkSession, d: str) -> DataFrame:
    return rank.query_terms(_topics(spark, d))


def tfidf_topk(spark: SparkSession, d: str, query: str = ENTRY_QUERY, k: int = 10) -> DataFrame:
    """The k best documents for one query."""
    q = spark.range(1).select(F.lit("q").alias("qid"), F.lit(query).alias("query"))
    return rank.cosine(_index(spark, d), rank.query_terms(q), k).select("doc_id", "score", "rank")


def _bool(query: str, strict: bool = False):
    return lambda s, d: boolean.search(query, _posts(s, d), lx.docs(s, d), strict)


def _bool_batch(spark: SparkSession, d: str) -> DataFrame:
    """(qid, form, n): result sizes of the three forms for every topic of two or three distinct known terms."""
    index = _index(spark, d)
    words = _topics(spark, d).select("qid", tx.tokens("query").alias("words"))
    known = boolean.known_queries(words.where(F.size(F.array_distinct("words")) == F.size("words")), index.vocab)
    t = known.select("qid", F.posexplode("words").alias("i", "term")).withColumn("qtf", F.lit(1).cast("bigint"))
    of, one = blocks.distinct(t, index.vocab, "i")
    m = lambda *bits: sum((F.col(f"m{i}") for i in bits[1:]), F.col(f"m{bits[0]}"))
    n = blocks.told_apart(blocks.membership(one, index.folder), of).join(known.select("qid", F.size("words").alias("size")), "qid")
    total = lx.docs(spark, d).select(F.countDistinct("doc_id")).scalar()
    forms = lambda *f: F.array(*[F.struct(F.lit(k).alias("form"), v.alias("n")) for k, v in f])
    two = forms(("a AND b", m(3)), ("a OR b", m(1, 2, 3)), ("a NOT b", total - m(2, 3)))
    three = forms(("a AND b AND c", m(7)), ("(a OR b) NOT c", m(1, 2, 3)), ("(a AND b) OR c", m(3, 4, 5, 6, 7)))
    return n.select("qid", F.inline(F.when(F.col("size") == 2, two).otherwise(three)))


def _stored_lists(spark: SparkSession, d: str) -> DataFrame:
    """(term, df, cf, ids) of the stored compressed lists, decoded."""
    back = codec.decompressed(_part("compressed")(spark, d))
    return back.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.sum("doc_id").alias("ids"))


def _targets(spark: SparkSession, d: str) -> DataFrame:
    """Every hundredth document as a target in three lists."""
    at = lx.docs(spark, d).where("doc_id % 100 = 0").select("doc_id").distinct()
    return at.select(F.explode(F.array(*map(F.lit, ("memoria", "disco", "bloque")))).alias("term"), F.col("doc_id").alias("target"))


def _skip_check(spark: SparkSession, d: str) -> DataFrame:
    """(n_linear, n_skip): the sizes of a conjunction found on whole lists and by skips."""
    terms = ["memoria", "disco", "bloque"]
    linear = boolean.search(" AND ".join(terms), _posts(spark, d), lx.docs(spark, d))
    n = lambda df: df.select(F.count(F.lit(1))).scalar()
    return spark.range(1).select(n(linear).alias("n_linear"), n(ix.skip_and(_posts(spark, d), _skips(spark, d), terms)).alias("n_skip"))


def _named(spark: SparkSession, d: str) -> rank.Index:
    """The index of ``posting_chunk`` with the terms of ``term_dict`` and its documents' names."""
    words = table(spark, d, "term_dict").where("term is not null").groupBy(F.lower("term").alias("term")).agg(F.min("term_id").alias("term_id"))
    rows = table(spark, d, "posting_chunk").where("term_id is not null and docid is not null and freq > 0").groupBy("term_id", F.col("docid").alias("doc_id")).agg(F.max("freq").alias("tf"))
    posts = rows.join(rank.broadcast_if_small(words), "term_id").select("term", "doc_id", "tf")
    names = table(spark, d, "doc_index").where("docno is not null").select(F.col("docid").alias("doc_id"), "docno")
    return rank.Index(checkpointed(posts), rows.select("doc_id").distinct(), names)


def _grid_run(spark: SparkSession, d: str) -> DataFrame:
    """(model, param, qid, docno, rank): the first thousand documents of every setting, by name; a name counts once, with its best rank."""
    run, of = rank.grid_names(_named(spark, d), _terms(spark, d))
    return blocks.told_apart(run, of).select("model", "param", "qid", "docno", "rank")


def _grid_means(spark: SparkSession, d: str) -> DataFrame:
    run, of = rank.grid_names(_named(spark, d), _terms(spark, d))
    run, qrels = run.select(F.concat_ws(":", "model", F.col("param").cast("string")).alias("setting"), "rep", "docno", "rank"), checkpointed(_qrels(spark, d))
    retrieved = blocks.told_apart(run.groupBy("setting", "rep").agg(F.count(F.lit(1)).alias("retrieved")), of)
    # of the ranking only judged documents travel further; it is not stored
    labelled = rank.broadcast_if_small(qrels.where("label != 0").join(of, "qid").select("rep", "docno", "qid"))
    found = checkpointed(run.join(labelled, ["rep", "docno"]).select("setting", "qid", "docno", "rank"))
    return evaluate.means(evaluate.metrics(found, qrels, ["setting"], retrieved), ["setting"])


def _run(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.ranked_run(table(spark, d, "run_results"))


def _qrels(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.judgements(table(spark, d, "read_qrels"))


def _metrics(spark: SparkSession, d: str) -> DataFrame:
    return evaluate.metrics(_run(spark, d), _qrels(spark, d), ["model"])


def _spearman_ids(spark: SparkSession, d: str) -> DataFrame:
    top = _run(spark, d).select("qid", "model", "rank", F.substring("docno", 4, 8).cast("bigint").alias("n"))
    return evaluate.spearman_ids(top, "n", 10)


def _buckets(spark: SparkSession, d: str) -> DataFrame:
    sizes = _topics(spark, d).select("qid", F.size(tx.tokens("query")).alias("n_terms"))
    return evaluate.query_buckets(_terms(spark, d), sizes, lx.vocab(spark, d))


def _porter(spark: SparkSession, d: str) -> DataFrame:
    """BM25 on Porter stems without stop words, on both sides."""
    index = rank.Index(checkpointed(lx._stemmed(spark, d)), lx.docs(spark, d))
    t = stats.filtered(_terms(spark, d), lx._stop(spark, d))
    q = t.join(stem.stems(t, "porter"), "term").groupBy("qid", F.col("stem").alias("term")).agg(F.sum("qtf").alias("qtf"))
    return rank.bm25(index, q)


QUERIES = {
    "tfidf_topk": tfidf_topk,
    "bool_and": _bool("memoria AND disco"),
    "bool_or": _bool("memoria OR disco"),
    "bool_not": _bool("NOT memoria"),
    "bool_and3": _bool("memoria AND disco AND bloque"),
    "bool_or_not": _bool("(memoria OR disco) NOT bloque", strict=True),
    "bool_and_or": _bool("(memoria AND disco) OR bloque"),
    "bool_top_of_stack": _bool("memoria NOT disco"),
    "bool_batch": _bool_batch,
    "posting_lookup": lambda s, d: ix.read_postings(_posts(s, d), "memoria", "nosuchterm").select("term", "doc_id", "tf"),
    "index_roundtrip": lambda s, d: _posts(s, d).select("term", "doc_id", "tf", "doc_len"),
    "index_norms": lambda s, d: _part("docs")(s, d).select("doc_id", "doc_len", F.round("norm", 6).alias("norm"), F.round("log_norm", 6).alias("log_norm")),
    "index_skips": _skips,
    "index_compressed": _stored_lists,
    "chunk_counts": lambda s, d: ix.chunk_counts(table(s, d, "posting_chunk")),
    "posting_ge": lambda s, d: ix.advance(_posts(s, d), _skips(s, d), _targets(s, d)),
    "skip_and": lambda s, d: ix.skip_and(_posts(s, d), _skips(s, d), ["memoria", "disco"]),
    "skip_and3": lambda s, d: ix.skip_and(_posts(s, d), _skips(s, d), ["bloque", "memoria", "disco"]),
    "skip_check": _skip_check,
    "cosine_all": lambda s, d: rank.cosine(_index(s, d), s.range(1).select(F.lit("q").alias("qid"), F.lit("memoria").alias("term"), F.lit(1).cast("bigint").alias("qtf")), None).select("doc_id", "score", "rank"),
    "tfidf_cosine": lambda s, d: rank.cosine(_index(s, d), _terms(s, d)),
    "logtfidf_cosine": lambda s, d: rank.cosine(_index(s, d), _terms(s, d), log_tf=True),
    "tfidf_model_topk": lambda s, d: rank.tf_idf(_index(s, d), _terms(s, d)),
    "bm25_topk": lambda s, d: rank.bm25(_index(s, d), _terms(s, d)),
    "hiemstra_topk": lambda s, d: rank.hiemstra(_index(s, d), _terms(s, d)),
    "dirichlet_topk": lambda s, d: rank.dirichlet(_index(s, d), _terms(s, d)),
    "model_grid": lambda s, d: rank.grid(_index(s, d), _terms(s, d)),
    "grid_run": _grid_run,
    "grid_means": _grid_means,
    "query_buckets": _buckets,
    "qrels": _qrels,
    "ranked_run": _run,
    "topic_metrics": _metrics,
    "model_means": lambda s, d: evaluate.means(_metrics(s, d), ["model"]),
    "rp_11": lambda s, d: evaluate.recall_precision(_run(s, d), _qrels(s, d), ["model"]),
    "mean_pr_by_rank": lambda s, d: evaluate.by_rank(_run(s, d), _qrels(s, d), ["model"]),
    "metric_describe": lambda s, d: evaluate.describe(_metrics(s, d), ["model"], "ap"),
    "spearman_ap": lambda s, d: evaluate.spearman_measures(_metrics(s, d), "ap"),
    "spearman_ids": _spearman_ids,
    "spearman_ap_p": lambda s, d: evaluate.with_p_value(evaluate.spearman_measures(_metrics(s, d), "ap")),
    "porter_topk": _porter,
}

_T = lx._T
_P = lx._P
_TOPICS = "select qid, query from (select *, row_number() over (partition by qid order by read_at desc nulls last, query desc) as r from read_queries where qid is not null and query is not null) where r = 1"
_QT = f"select qid, term, count(*) as qtf from (select qid, unnest(regexp_extract_all(lower(replace(query, chr(304), 'i' || chr(775))), '{tx.LETTERS}')) as term from ({_TOPICS})) group by all"
_IN = "select distinct doc_id from ({}) where term = '{}'"
_NUM = "(select count(*)::double from documents)"
_BASE = f"p as materialized ({_P}), v as materialized (select term, sum(tf)::double as cf, count(*)::double as df from p group by term), l as materialized (select doc_id, sum(tf)::double as doc_len from p group by doc_id), q as materialized ({_QT})"
_TOPK = "select qid, doc_id, score, rank from (select *, row_number() over (partition by qid order by score desc, doc_id {}) as rank from ({})) where rank <= {}"


def _sum(expr: str, extra: str = "") -> str:
    return f"select qid, doc_id, round(sum(qtf * ({expr})){extra}, 8) as score from p join q using (term) join v using (term) join l using (doc_id) group by qid, doc_id"


_MEAN, _ALL = "(select avg(doc_len) from l)", "(select sum(tf)::double from p)"
_LEN = f"(1.2 * (0.25 + 0.75 * doc_len / {_MEAN}))"
_MODEL = {
    "tf_idf": lambda _: _sum(f"1.2 * tf / (tf + {_LEN}) * ln({_NUM} / df + 1)"),
    "bm25": lambda _: _sum(f"ln(1 + ({_NUM} - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + {_LEN})"),
    "hiemstra": lambda x: _sum(f"ln(1 + {x}::double * tf * {_ALL} / ((1 - {x}::double) * cf * doc_len))"),
    "dirichlet": lambda x: f"select qid, doc_id, round(s + n * ln({x}::double / (doc_len + {x}::double)), 8) as score from (select qid, doc_id, any_value(doc_len) as doc_len, sum(qtf * ln(1 + tf * {_ALL} / ({x}::double * cf))) as s from p join q using (term) join v using (term) join l using (doc_id) group by qid, doc_id) join (select qid, sum(qtf) as n from q group by qid) using (qid)",
}


def _cosine(tf: str, qtf: str, queries: str, cols: str = "qid, doc_id", k: int = 10) -> str:
    return f"""with p as materialized ({_P}), v as (select term, ln({_NUM} / count(*)) as idf from p group by term), q0 as ({queries}),
  w as materialized (select term, doc_id, {tf} * idf as w from p join v using (term)), n as (select doc_id, sqrt(sum(w * w)) as norm from w group by doc_id),
  q as (select qid, term, {qtf} * idf as wq from q0 join v using (term)), m as (select qid, sqrt(sum(wq * wq)) as qn from q group by qid),
  s as (select qid, doc_id, round(coalesce(sum(w * wq) / nullif(any_value(norm) * any_value(qn), 0), 0), 8) as score from w join q using (term) join n using (doc_id) join m using (qid) group by qid, doc_id)
  select {cols}, score, rank from ({_TOPK.format('desc', 'select * from s', k)})"""


def _ranked(model: str, x=None, k: int = 10) -> str:
    return f"with {_BASE} {_TOPK.format('asc', _MODEL[model](x), k)}"


_QR = r"select qid, docno, max(label) as label from (select nullif(trim(qid, ' ' || chr(9)), '') as qid, nullif(trim(docno, ' ' || chr(9)), '') as docno, label from read_qrels) where qid is not null and docno is not null and label is not null group by all"
_RUN = "select qid, model, docno, score, row_number() over (partition by qid, model order by score desc, docno) as rank from (select qid, model, docno, max(score) as score from run_results where qid is not null and model is not null and docno is not null and score is not null and not isnan(score) group by all)"
_J = f"""qr as materialized ({_QR}), i as (select qid, count(*) filter (label > 0) as n_rel from qr group by qid),
  j0 as (select r.*, coalesce(label, 0) as label, (coalesce(label, 0) > 0)::int as rel from ({_RUN}) r left join qr using (qid, docno)),
  j as materialized (select *, sum(rel) over (partition by model, qid order by rank) as hits, sum(rel) over (partition by model, qid order by rank)::double / rank as precision from j0)"""
_M = f"""{_J}, b as (select qid, sum(label / log2(r + 1)) as ideal2 from (select *, row_number() over (partition by qid order by label desc, docno) as r from qr where label > 0) where r <= 10 group by qid),
  a as (select model, qid, count(*) as retrieved, sum(rel * precision) as sp, sum(rel) as found, coalesce(sum(rel) filter (rank <= 10), 0) as h10,
    sum(case when rank = 1 then rel else rel / log2(greatest(rank, 2)) end) filter (rank <= 10) as d1, sum(label / log2(rank + 1)) filter (rank <= 10) as d2 from j group by all),
  m as materialized (select model, qid, retrieved, coalesce(n_rel, 0) as n_rel, round(coalesce(sp / nullif(n_rel, 0), 0), 6) as ap, round(h10::double / least(retrieved, 10), 6) as p10, round(h10 / 10.0::double, 6) as p10_trec,
    round(case when n_rel > 0 then d1 / list_sum(list_transform(range(1, least(n_rel, 10) + 1), lambda r: case when r = 1 then 1.0::double else 1.0::double / log2(r) end)) else 0 end, 6) as ndcg_v1,
    round(coalesce(d2 / nullif(ideal2, 0), 0), 6) as ndcg_trec, round(coalesce(found::double / nullif(n_rel, 0), 0), 6) as recall from a left join i using (qid) left join b using (qid))"""
_NAMED_P = """select w.term, p.docid as doc_id, p.tf from (select term_id, docid, max(freq) as tf from posting_chunk where term_id is not null and docid is not null and freq > 0 group by all) p
  join (select lower(term) as term, min(term_id) as term_id from term_dict where term is not null group by 1) w using (term_id)"""
_NAMED_N = "(select count(distinct docid)::double from posting_chunk where term_id is not null and docid is not null and freq > 0)"
_NAMED = f"""{_BASE.replace(f'({_P})', f'({_NAMED_P})')}, g0 as ({' union all '.join(f"select '{m}' as model, {'null' if x is None else x}::double as param, * from ({_TOPK.format('asc', _MODEL[m](x), 1000)})" for m, x in rank.GRID)}),
  g1 as (select model, param, qid, docno, min(rank) as f from g0 join (select docid as doc_id, docno from doc_index where docno is not null) using (doc_id) group by all), gr as materialized (select model, param, qid, docno, row_number() over (partition by model, param, qid order by f) as rank from g1)""".replace(_NUM, _NAMED_N)
_AVG_RANK = "rank() over (partition by {k} order by {x}) + (count(*) over (partition by {k}, {x}) - 1) / 2.0::double"


def _rho(pairs: str, keys: str) -> str:
    r = f"select {keys}, {_AVG_RANK.format(k=keys, x='x')} as rx, {_AVG_RANK.format(k=keys, x='y')} as ry from ({pairs})"
    return f"select {keys}, count(*) as n, round(covar_pop(rx, ry) / nullif(stddev_pop(rx) * stddev_pop(ry), 0), 6) as rho from ({r}) group by {keys}"


SQL = {
    "tfidf_topk": _cosine("tf", "qtf", f"select 'q' as qid, term, count(*) as qtf from (select unnest(regexp_extract_all('{ENTRY_QUERY}', '[a-z]+')) as term) group by term", "doc_id"),
    "bool_and": f"{_IN.format(_T, 'memoria')} intersect {_IN.format(_T, 'disco')}",
    "bool_or": f"{_IN.format(_T, 'memoria')} union {_IN.format(_T, 'disco')}",
    "bool_not": f"select distinct doc_id from documents except {_IN.format(_T, 'memoria')}",
    "bool_and3": f"({_IN.format(_T, 'memoria')} intersect {_IN.format(_T, 'disco')}) intersect {_IN.format(_T, 'bloque')}",
    "bool_or_not": f"({_IN.format(_T, 'memoria')} union {_IN.format(_T, 'disco')}) except {_IN.format(_T, 'bloque')}",
    "bool_and_or": f"({_IN.format(_T, 'memoria')} intersect {_IN.format(_T, 'disco')}) union {_IN.format(_T, 'bloque')}",
    "bool_top_of_stack": f"select distinct doc_id from documents except {_IN.format(_T, 'disco')}",
    "bool_batch": f"""with p as materialized ({_P}), w as (select qid, regexp_extract_all(lower(query), '{tx.LETTERS}') as w from ({_TOPICS})), v as (select distinct term from p),
  k as (select qid, len(w) as size, w[1] as a, w[2] as b, w[3] as c from w where len(w) in (2, 3) and len(list_distinct(w)) = len(w) and w[1] in (select term from v) and w[2] in (select term from v) and (len(w) = 2 or w[3] in (select term from v))),
  h as (select qid, size, doc_id, max(term = a) as ha, max(term = b) as hb, coalesce(max(term = c), false) as hc from k join p on term in (a, b, c) group by all),
  n as (select qid, size, count(*) filter (ha and hb) as ab, count(*) as o, count(*) filter (hb) as nb, count(*) filter (ha and hb and hc) as abc, count(*) filter ((ha or hb) and not hc) as onot, count(*) filter (ha and hb or hc) as ando from h group by all),
  t as (select count(distinct doc_id) as t from documents)
  select qid, unnest(case when size = 2 then ['a AND b', 'a OR b', 'a NOT b'] else ['a AND b AND c', '(a OR b) NOT c', '(a AND b) OR c'] end) as form, unnest(case when size = 2 then [ab, o, t - nb] else [abc, onot, ando] end) as n from n, t""",
    "posting_lookup": f"select * from ({_P}) where term in ('memoria', 'nosuchterm')",
    "index_roundtrip": f"with p as ({_P}) select term, doc_id, tf, sum(tf) over (partition by doc_id)::bigint as doc_len from p",
    "index_norms": f"with p as ({_P}), v as (select term, ln({_NUM} / count(*)) as idf from p group by term) select doc_id, sum(tf)::bigint as doc_len, round(sqrt(sum((tf * idf) ** 2)), 6) as norm, round(sqrt(sum(((1 + ln(tf)) * idf) ** 2)), 6) as log_norm from p join v using (term) group by doc_id",
    "index_compressed": f"select term, count(*) as df, sum(tf)::bigint as cf, sum(doc_id)::bigint as ids from ({_P}) group by term",
    "chunk_counts": "select index_no, count(distinct chunk_id) as chunks, count(*) as records from posting_chunk where index_no is not null group by index_no",
    "index_skips": f"""with p as ({_P}), r as (select *, row_number() over (partition by term order by doc_id) - 1 as i, greatest(1, floor(sqrt(count(*) over (partition by term)))) as step from p)
  select term, floor(i / step)::int as block, count(*) as size, min(doc_id) as first_doc, max(doc_id) as last_doc from r group by 1, 2""",
    "posting_ge": f"with p as materialized ({_P}), t as (select unnest(['memoria', 'disco', 'bloque']) as term, doc_id as target from (select distinct doc_id from documents where doc_id % 100 = 0)) select term, target, (select min(doc_id) from p where p.term = t.term and p.doc_id >= t.target) as doc_id from t",
    "skip_and": f"{_IN.format(_T, 'memoria')} intersect {_IN.format(_T, 'disco')}",
    "skip_and3": f"({_IN.format(_T, 'memoria')} intersect {_IN.format(_T, 'disco')}) intersect {_IN.format(_T, 'bloque')}",
    "skip_check": f"select n as n_linear, n as n_skip from (select count(*) as n from (({_IN.format(_T, 'memoria')} intersect {_IN.format(_T, 'disco')}) intersect {_IN.format(_T, 'bloque')}))",
    "cosine_all": _cosine("tf", "qtf", "select 'q' as qid, 'memoria' as term, 1 as qtf", "doc_id", 1 << 40),
    "tfidf_cosine": _cosine("tf", "qtf", _QT),
    "logtfidf_cosine": _cosine("(1 + ln(tf))", "(1 + ln(qtf))", _QT),
    "tfidf_model_topk": _ranked("tf_idf"),
    "bm25_topk": _ranked("bm25"),
    "hiemstra_topk": _ranked("hiemstra", 0.5),
    "dirichlet_topk": _ranked("dirichlet", 2500.0),
    "model_grid": f"with {_BASE} " + " union all ".join(f"select '{m}' as model, {'null' if x is None else x}::double as param, * from ({_TOPK.format('asc', _MODEL[m](x), 1000)})" for m, x in rank.GRID),
    "grid_run": f"with {_NAMED} select model, param, qid, docno, rank from gr",
    "grid_means": f"""with {_NAMED}, {_M.replace(f"({_RUN}) r", "(select concat_ws(':', model, param::varchar) as model, qid, docno, rank from gr) r")}
  select model as setting, count(*) as topics, round(avg(ap), 6) as map, round(avg(p10), 6) as p10, round(avg(p10_trec), 6) as p10_trec, round(avg(ndcg_v1), 6) as ndcg_v1, round(avg(ndcg_trec), 6) as ndcg_trec, round(avg(recall), 6) as recall from m group by model""",
    "query_buckets": f"""with q as ({_QT}), v as (select term, count(*) as df from ({_P}) group by term), n as (select qid, len(regexp_extract_all(lower(query), '{tx.LETTERS}')) as n_terms from ({_TOPICS})),
  s as (select qid, avg(df) as a from q join v using (term) group by qid), j as (select n_terms, coalesce(a, 0) as a from n left join s using (qid))
  select case when n_terms = 1 then '1' when n_terms <= 3 then '2-3' else '4+' end as length_bucket, case when a < 5 then '<5' when a < 10 then '<10' else '10+' end as size_bucket,
    count(*) as queries, round(avg(n_terms), 6) as mean_terms, round(avg(a), 6) as mean_postings from j group by 1, 2""",
    "qrels": _QR,
    "ranked_run": _RUN,
    "topic_metrics": f"with {_M} select * from m",
    "model_means": f"with {_M} select model, count(*) as topics, round(avg(ap), 6) as map, round(avg(p10), 6) as p10, round(avg(p10_trec), 6) as p10_trec, round(avg(ndcg_v1), 6) as ndcg_v1, round(avg(ndcg_trec), 6) as ndcg_trec, round(avg(recall), 6) as recall from m group by model",
    "rp_11": f"""with {_J}, lv as (select unnest(range(0, 11)) / 10.0::double as level), t as (select distinct model, qid from j),
  x as (select t.model, level, coalesce(max(precision) filter (round(hits::double / nullif(n_rel, 0), 9) >= level), 0) as p from t, lv join j on j.model = t.model and j.qid = t.qid left join i on i.qid = t.qid group by t.model, t.qid, level)
  select model, level, round(avg(p), 6) as precision from x group by model, level""",
    "mean_pr_by_rank": f"with {_J} select model, rank, count(*) as topics, round(avg(precision), 6) as precision, round(avg(coalesce(hits::double / nullif(n_rel, 0), 0)), 6) as recall from j left join i using (qid) group by model, rank",
    "metric_describe": f"with {_M} select model, count(ap) as count, round(avg(ap), 6) as mean, round(stddev_samp(ap), 6) as std, round(min(ap), 6) as min, round(quantile_cont(ap, 0.25), 6) as q25, round(quantile_cont(ap, 0.5), 6) as q50, round(quantile_cont(ap, 0.75), 6) as q75, round(max(ap), 6) as max from m group by model",
    "spearman_ap": f"with {_M}, pr as (select a.model as model_a, b.model as model_b, a.ap as x, b.ap as y from m a join m b using (qid) where a.model < b.model) {_rho('select * from pr', 'model_a, model_b')}",
    "spearman_ids": f"with r as (select qid, model, rank, substr(docno, 4, 8)::bigint as n from ({_RUN}) where rank <= 10), pr as (select a.qid, a.model as model_a, b.model as model_b, a.n as x, b.n as y from r a join r b using (qid, rank) where a.model < b.model) {_rho('select * from pr', 'qid, model_a, model_b')}",
}
