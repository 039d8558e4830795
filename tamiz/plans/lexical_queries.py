"""Queries on tokens, statistics, laws, index and compression over ``documents``, and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import stem
from tamiz.functions import text as tx
from tamiz.operators import index as ix
from tamiz.operators import laws, stats
from tamiz.session import spread, table


def docs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("doc_id", "text")


def tokens(spark: SparkSession, d: str, pattern: str = tx.LETTERS) -> DataFrame:
    return stats.occurrences(docs(spark, d), pattern)


def posts(spark: SparkSession, d: str) -> DataFrame:
    return stats.postings(tokens(spark, d))


def vocab(spark: SparkSession, d: str) -> DataFrame:
    return stats.vocabulary(posts(spark, d))


def _stop(spark: SparkSession, d: str) -> DataFrame:
    """The commonest terms stand in for a stop-word file: those of the first fifty ranks."""
    return laws.ranked(stats.word_count(tokens(spark, d))).where("rank <= 50").select("term")


def _filtered(spark: SparkSession, d: str) -> DataFrame:
    return stats.filtered(tokens(spark, d, tx.SPANISH), _stop(spark, d), 3, 23)


def _positions(spark: SparkSession, d: str) -> DataFrame:
    return docs(spark, d).select("doc_id", F.posexplode(tx.tokens("text", tx.SPANISH)).alias("pos", "term"))


def _class(name: str, version: int = 2):
    def q(spark: SparkSession, d: str) -> DataFrame:
        t = tx.structured_columns(spread(docs(spark, d)), "text", version).select("doc_id", F.explode(name).alias("token"))
        return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))

    return q


def _alone(pattern: str):
    """Matches of a pattern on the whole text."""

    def q(spark: SparkSession, d: str) -> DataFrame:
        t = docs(spark, d).select("doc_id", F.explode(tx.matches("text", pattern)).alias("token"))
        return t.groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("doc_id").alias("docs"))

    return q


def _structured(version: int):
    def q(spark: SparkSession, d: str) -> DataFrame:
        c = tx.structured_columns(spread(docs(spark, d)), "text", version)
        return c.select("doc_id", *[F.size(k).alias(f"n_{k}") for k in c.columns if k not in ("doc_id", "text")])

    return q


def _stemmed(spark: SparkSession, d: str) -> DataFrame:
    """Postings of Porter stems of the terms that are no stop words."""
    t = stats.filtered(tokens(spark, d), _stop(spark, d))
    return stats.postings(t.join(stem.stems(t, "porter"), "term").select("doc_id", F.col("stem").alias("term")))


def _structured_terms(spark: SparkSession, d: str) -> DataFrame:
    """(term, cf): structured tokens, the letters that remain as Porter stems."""
    c = tx.structured("text", 2)
    rest = docs(spark, d).select(F.explode(c["letters"]).alias("term"))
    whole = docs(spark, d).select(F.explode(F.concat(*[v for k, v in c.items() if k != "letters"])).alias("term"))
    return stats.word_count(whole.unionByName(rest.join(stem.stems(rest, "porter"), "term").select(F.col("stem").alias("term"))))


QUERIES = {
    "word_count": lambda s, d: stats.word_count(tokens(s, d, tx.WORD)),
    "word_count_ascii": lambda s, d: stats.word_count(tokens(s, d, tx.ASCII)),
    "word_count_spanish": lambda s, d: stats.word_count(tokens(s, d, tx.SPANISH)),
    "doc_freq": lambda s, d: vocab(s, d).select("term", "df"),
    "corpus_stats": lambda s, d: stats.corpus_stats(docs(s, d), posts(s, d)),
    "term_cf_df": lambda s, d: vocab(s, d),
    "filtered_terms": lambda s, d: stats.vocabulary(stats.postings(_filtered(s, d))),
    "corpus_summary": lambda s, d: stats.summary(docs(s, d), posts(s, d)),
    "doc_lengths": lambda s, d: stats.document_lengths(posts(s, d)),
    "top_terms": lambda s, d: stats.top_terms(vocab(s, d)),
    "bottom_terms": lambda s, d: stats.bottom_terms(vocab(s, d)),
    "hapax": lambda s, d: vocab(s, d).where("cf = 1").select("term"),
    "postings": posts,
    "posting_length_stats": lambda s, d: ix.length_stats(vocab(s, d)),
    "posting_hist": lambda s, d: ix.length_histogram(vocab(s, d)),
    "posting_cdf": lambda s, d: ix.length_cdf(vocab(s, d)),
    "skip_pointers": lambda s, d: ix.skip_pointers(vocab(s, d)),
    "index_size": lambda s, d: ix.index_metrics(docs(s, d), vocab(s, d)),
    "dgaps": lambda s, d: ix.gaps(posts(s, d)),
    "compressed_lists": lambda s, d: ix.compressed_sizes(posts(s, d)),
    "compress_ratio": lambda s, d: ix.size_report(ix.compressed_sizes(posts(s, d))),
    "zipf_ranks": lambda s, d: laws.ranked(vocab(s, d).select("term", "cf")),
    "zipf_fit": lambda s, d: laws.zipf_fit(vocab(s, d).select("term", "cf")),
    "zipf_mass": lambda s, d: laws.zipf_mass(vocab(s, d).select("term", "cf")),
    "zipf_prune": lambda s, d: laws.pruned(vocab(s, d).select("term", "cf"), 0.3),
    "stopword_share": lambda s, d: laws.head_overlap(vocab(s, d).select("term", "cf"), _stop(s, d), 0.3),
    "heaps_curve": lambda s, d: laws.heaps_curve(_positions(s, d)),
    "heaps_tokens": lambda s, d: laws.heaps_tokens(_positions(s, d)),
    "heaps_fit": lambda s, d: laws.heaps_fit(laws.heaps_tokens(_positions(s, d))),
    "heaps_fit_docs": lambda s, d: laws.heaps_fit(laws.heaps_curve(_positions(s, d))),
    "zipf_ranks_first": lambda s, d: laws.ranked_by_appearance(_positions(s, d)),
    "porter_terms": lambda s, d: stats.vocabulary(_stemmed(s, d)),
    "structured_terms": _structured_terms,
    "tok_email": _alone(tx.EMAIL),
    "tok_url": _alone(tx.URL),
    "tok_acronym": _alone(tx.ACRONYM),
    "tok_date": _class("date"),
    "tok_phone_v1": _class("phone", 1),
    "tok_phone": _class("phone"),
    "tok_number": _class("number"),
    "tok_abbreviation": _class("abbreviation"),
    "tok_names": _class("name"),
    "structured_tokens_v1": _structured(1),
    "structured_tokens": _structured(2),
}

# DuckDB lowers U+0130 to a plain i, Spark (and Python) to i and a combining dot
_TOK = "select doc_id, unnest(regexp_extract_all(lower(replace(text, chr(304), 'i' || chr(775))), '{}')) as term from documents"
_T = _TOK.format(tx.LETTERS)
_P = f"select term, doc_id, count(*) as tf from ({_T}) group by all"
_V = f"select term, sum(tf)::bigint as cf, count(*) as df from ({_P}) group by term"
_R = f"select term, cf, row_number() over (order by cf desc, term) as rank from ({_V})"
_C = f"select *, sum(cf) over (order by rank) as cf_to, sum(1.0::double / rank) over (order by rank) as h_to, sum(cf) over () as t, sum(1.0::double / rank) over () as h from ({_R})"
_COUNT = "select term, count(*) as cf from ({}) group by term"
_G = f"select term, doc_id, tf, doc_id - coalesce(lag(doc_id) over (partition by term order by doc_id), 0) as gap from ({_P})"
_BL = "length(bin({}))"
_SIZES = f"""select term, count(*) as df, sum(ceil({_BL.format('doc_id')} / 7.0))::bigint as id_bytes, sum(ceil({_BL.format('gap')} / 7.0))::bigint as gap_bytes,
  ceil(sum(2 * {_BL.format('tf')} - 1) / 8.0)::bigint as freq_bytes, ceil((sum(ceil({_BL.format('gap')} / 7.0)) * 8 + sum(2 * {_BL.format('tf')} - 1)) / 8.0)::bigint as hybrid_bytes from ({_G}) group by term"""
_H = f"""select doc_id, sum(n) over (order by doc_id)::bigint as n, sum(coalesce(k, 0)) over (order by doc_id)::bigint as v from (select doc_id, count(*) as n from ({_TOK.format(tx.SPANISH)}) group by doc_id)
  left join (select doc_id, count(*) as k from (select term, min(doc_id) as doc_id from ({_TOK.format(tx.SPANISH)}) group by term) group by doc_id) using (doc_id)"""
_PO = f"""select row_number() over (order by doc_id, i) as n, t[i] as term from (select doc_id, t, unnest(range(1, len(t) + 1)) as i
  from (select doc_id, regexp_extract_all(lower(replace(text, chr(304), 'i' || chr(775))), '{tx.SPANISH}') as t from documents))"""
_HT = f"select n, sum((f = n)::int) over (order by n)::bigint as v from (select n, min(n) over (partition by term) as f from ({_PO}))"
_FOUND = "select token, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest({}) as token from documents) group by token"
_STOP = f"select term from ({_R}) where rank <= 50"



def _cascade_sql(version: int) -> str:
    """CTEs s0 to s8: the text after each class is deleted, and c1 to c9 the tokens of each class.

    RE2 knows no look-around, so runs of word characters are marked with characters 1 and 2 where the boundaries are patterns'.
    """
    nd = r"\p{Nd}"
    marked = {
        "date": rf"\x01{nd}{{1,4}}\x02[-/]\x01{nd}{{1,2}}\x02[-/]\x01{nd}{{1,4}}\x02",
        "number": rf"\x01{nd}+(?:\x02[\.,]\x01{nd}+)?\x02",
        "abbreviation": {1: r"(?:\x01[A-Z]+[a-z]*\x02\.)+(?:\x01[A-Z]+)?", 2: r"(?:\x01[A-Z][a-z]*\x02\.)+"}[version],
        "acronym": r"\x01[A-Z]{2,}\x02",
        "name": r"\x01[A-Z][a-z]+(?:\x02 \x01[A-Z][a-z]+)*\x02",
    }
    mark = r"regexp_replace(t, '([\p{L}\p{N}_]+)', chr(1) || '\1' || chr(2), 'g')"
    bare = lambda e: f"replace(replace({e}, chr(1), ''), chr(2), '')"
    out, kept = ["s0 as (select doc_id, text as t from documents)"], []
    for i, (name, pattern) in enumerate(tx._classes(version), 1):
        if name in marked:
            found = f"list_transform(regexp_extract_all({mark}, '{marked[name]}'), lambda x: {bare('x')})"
            rest = bare(f"regexp_replace({mark}, '{marked[name]}', '', 'g')")
        else:
            found, rest = f"regexp_extract_all(t, '{pattern}')", f"regexp_replace(t, '{pattern}', '', 'g')"
        out.append(f"s{i} as materialized (select doc_id, {''.join(k + ', ' for k in kept)}{found} as c_{name}, {rest} as t from s{i - 1})")
        kept.append(f"c_{name}")
    out.append(f"s9 as (select *, regexp_extract_all(lower(replace(t, chr(304), 'i' || chr(775))), '{tx.LETTERS}') as c_letters from s8)")
    return "with " + ", ".join(out)


def _class_sql(name: str, version: int = 2) -> str:
    return f"{_cascade_sql(version)} select token, count(*) as n, count(distinct doc_id) as docs from (select doc_id, unnest(c_{name}) as token from s9) group by token"


def _structured_sql(version: int) -> str:
    names = [k for k, _ in tx._classes(version)] + ["letters"]
    return f"{_cascade_sql(version)} select doc_id, {', '.join(f'len(c_{k})::int as n_{k}' for k in names)} from s9"


SQL = {
    "tok_date": _class_sql("date"),
    "tok_phone_v1": _class_sql("phone", 1),
    "tok_phone": _class_sql("phone"),
    "tok_number": _class_sql("number"),
    "tok_abbreviation": _class_sql("abbreviation"),
    "tok_names": _class_sql("name"),
    "structured_tokens_v1": _structured_sql(1),
    "structured_tokens": _structured_sql(2),
    "word_count": _COUNT.format(_TOK.format(tx.WORD)),
    "word_count_ascii": _COUNT.format(_TOK.format(tx.ASCII)),
    "word_count_spanish": _COUNT.format(_TOK.format(tx.SPANISH)),
    "doc_freq": f"select term, df from ({_V})",
    "corpus_stats": f"select (select count(*) from documents) as num_docs, count(*) as num_terms, sum(cf)::bigint as num_tokens from ({_V})",
    "term_cf_df": _V,
    "filtered_terms": f"""select term, sum(tf)::bigint as cf, count(*) as df from (select term, doc_id, count(*) as tf from ({_TOK.format(tx.SPANISH)}) where length(term) between 3 and 23 and term not in ({_STOP}) group by all) group by term""",
    "corpus_summary": f"""with v as ({_V}), l as (select sum(tf)::bigint as n from ({_P}) group by doc_id)
  select (select count(*) from documents) as num_docs, sum(cf)::bigint as num_tokens, round(sum(cf)::double / (select count(*) from documents), 6) as tokens_per_doc, round(avg(length(term)), 6) as mean_term_length,
    (select min(n) from l) as min_doc_tokens, (select max(n) from l) as max_doc_tokens, count(*) filter (cf = 1) as hapax from v""",
    "doc_lengths": f"select doc_id, sum(tf)::bigint as doc_len from ({_P}) group by doc_id",
    "top_terms": f"select term, cf from ({_V}) order by cf desc, term desc limit 10",
    "bottom_terms": f"select term, cf from ({_V}) order by cf, term limit 10",
    "hapax": f"select term from ({_V}) where cf = 1",
    "postings": _P,
    "posting_length_stats": f"select count(*) as n_terms, sum(df)::bigint as n_postings, min(df) as min_len, round(quantile_cont(df, 0.5), 6) as median_len, round(avg(df), 6) as mean_len, round(quantile_cont(df, 0.9), 6) as p90_len, max(df) as max_len from ({_V})",
    "posting_hist": f"select floor(round(log10(df) * 4, 9))::int as bin, count(*) as lists, min(df) as lo, max(df) as hi from ({_V}) group by 1",
    "posting_cdf": f"select df, lists, round(sum(lists) over (order by df) / (select count(*) from ({_V}))::double, 6) as share from (select df, count(*) as lists from ({_V}) group by df)",
    "skip_pointers": f"select term, src, src + step as dst from (select term, step, unnest(range(0, (df - step)::bigint, step)) as src from (select term, df, greatest(1, floor(sqrt(df)))::bigint as step from ({_V})) where df > step)",
    "index_size": f"select (select count(*) from documents) as num_docs, count(*) as num_terms, sum(df)::bigint as num_postings, sum(df)::bigint * 8 as index_bytes, (select sum(strlen(text))::bigint from documents) as corpus_bytes, round(sum(df) * 8.0::double / (select sum(strlen(text)) from documents), 6) as overhead from ({_V})",
    "dgaps": _G,
    "compressed_lists": _SIZES,
    "compress_ratio": f"""with t as (select sum(df) as n, sum(id_bytes) as i, sum(gap_bytes) as g, sum(freq_bytes) as f, sum(hybrid_bytes) as h from ({_SIZES})),
  r as (select 'plain' as variant, n * 8 as b, n from t union all select 'split', i + f, n from t union all select 'split_gaps', g + f, n from t union all select 'hybrid', h, n from t)
  select variant, b::bigint as bytes, round(b::double / (n * 8), 6) as ratio from r""",
    "zipf_ranks": _R,
    "zipf_fit": f"select round(regr_slope(y, x), 6) as slope, round(regr_intercept(y, x), 6) as intercept, round(regr_r2(y, x), 6) as r2 from (select ln(rank) as x, ln(cf) as y from ({_R}))",
    "zipf_mass": f"select m as mass, 1 + count(*) filter (round(cf_to::double / t, 9) < m) as actual_rank, 1 + count(*) filter (round(h_to / h, 9) < m) as zipf_rank from ({_C}), (select unnest([0.1, 0.2, 0.3, 0.5, 0.9])::double as m) group by m",
    "zipf_prune": f"with c as ({_C}) select term, cf, rank from c where rank > (select 1 + count(*) from c where round(cf_to::double / t, 9) < 0.3)",
    "stopword_share": f"with c as ({_C}), h as (select term from c where rank <= (select 1 + count(*) from c where round(cf_to::double / t, 9) < 0.3)) select count(*) as head_terms, count(*) filter (term in ({_STOP})) as stop_in_head, round(count(*) filter (term in ({_STOP}))::double / count(*), 6) as share from h",
    "heaps_curve": _H,
    "heaps_fit": f"select round(regr_slope(y, x), 6) as beta, round(exp(regr_intercept(y, x)), 6) as k, round(regr_r2(y, x), 6) as r2 from (select ln(n) as x, ln(v) as y from ({_HT}))",
    "heaps_tokens": _HT,
    "heaps_fit_docs": f"select round(regr_slope(y, x), 6) as beta, round(exp(regr_intercept(y, x)), 6) as k, round(regr_r2(y, x), 6) as r2 from (select ln(n) as x, ln(v) as y from ({_H}))",
    "zipf_ranks_first": f"select term, cf, row_number() over (order by cf desc, f) as rank from (select term, count(*) as cf, min(n) as f from ({_PO}) group by term)",
    "tok_email": _FOUND.format(f"regexp_extract_all(text, '{tx.EMAIL}')"),
    "tok_url": _FOUND.format(f"regexp_extract_all(text, '{tx.URL}')"),
    "tok_acronym": _FOUND.format(f"list_filter(regexp_extract_all(text, '{tx.WORD}'), lambda x: regexp_full_match(x, '[A-Z]{{2,}}'))"),
}
