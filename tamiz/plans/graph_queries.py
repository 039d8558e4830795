"""Language identification, stemming, codecs and the web graph, and their SQL.

The web is derived from ``read_corpus``: a page for each docno (under its first site) with ports, query strings, extensions and
paths of several depths, and with anchors in several spellings: to pages of its site and its home page, to pages of others, to
nowhere, and some that are no web pages.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamiz.functions import codec, stem, urls
from tamiz.operators import graph, langid, stats
from tamiz.plans import lexical_queries as lx
from tamiz.plans import search_queries as sq
from tamiz.session import checkpointed, kept, table
from tamiz.sources import sinks

def _labelled(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "documents").select("lang", "text")


# --- fixed values: the invented pages, as expressions that Spark and DuckDB read alike; k is the page's number ---
_URL = """concat(case when k % 10 = 0 then 'http' else 'https' end, '://', site, case when k % 13 = 0 then ':8080' else '' end,
  case k % 4 when 0 then '/' when 1 then '/notas/' when 2 then concat('/a/', lower(substr(docno, 1, 3)), '/') else '/x/y/z/w/' end, docno,
  case k % 7 when 0 then '.php' when 1 then '.pdf' when 2 then '.asp' when 3 then '/' when 4 then '.tar.gz' else '.html' end,
  case when k % 7 = 0 then concat('?p=', cast(k % 5 as varchar(9)), '&q=x') else '' end)"""
_HTML = """concat('<html><head><link href="s.css"></head><body><a name="top"></a><abbr href="no">x</abbr>',
  case when a is null then '' else concat('<p><a class="x" href="', replace(a, '&', '&amp;'), '">page</a></p>') end,
  case when b is null then '' else concat('<P><A HREF = ', chr(39), replace(b, '&', '&amp;'), chr(39), ' id=n>page</A></P>') end,
  case when c is null then '' else concat('<a rel=next href=', c, '>page</a>') end,
  case when k % 6 = 0 and a is not null then concat('<a href="', replace(a, '&', '&amp;'), '">again</a>') else '' end,
  case when k % 9 = 0 then concat('<a href="mailto:x@', site, '">mail</a>') else '' end, case when k % 8 = 0 then concat('<a href="/rel/', docno, '.html">near</a>') else '' end,
  case when k % 15 = 0 then concat('<a href="ftp://', site, '/f">file</a>') else '' end, case when k % 5 = 0 then concat('<a href="', replace(url, '&', '&amp;'), '">here</a>') else '' end,
  '<a href="https://', site, '/">home</a></body></html>')"""
_PAGES = f"""select url, {_HTML} as html from (select *, lead(url, 1) over (partition by site, g order by docno) as a, lead(url, 3) over (partition by site, g order by docno) as b, lead(url, 2) over (partition by g order by reverse(docno)) as c
  from (select *, {_URL} as url from (select *, cast(floor(k / 500) as int) as g from (select docno, min(site) as site, cast(substr(docno, 4, 8) as int) as k from read_corpus where docno is not null and site is not null group by docno))))
  union all select concat('https://', site, '/') as url, '<html><body>no links</body></html>' as html from (select distinct site from (select docno, min(site) as site from read_corpus where docno is not null and site is not null group by docno))"""
# ---------------------------------------------------------------------------------------------
SEEDS = 17
CRAWL = {"per_domain": 2000, "logical": 5, "physical": 10, "total": 500}


def pages(spark: SparkSession, d: str) -> DataFrame:
    """(url, html)."""
    return spark.sql(_PAGES.replace("read_corpus", "{rows}"), rows=table(spark, d, "read_corpus"))


def _edges(spark: SparkSession, d: str) -> DataFrame:
    """Links between pages of the web."""
    p = pages(spark, d)
    return graph.links(p).join(p.select(F.col("url").alias("href")), "href", "left_semi").select(F.col("url").alias("src"), F.col("href").alias("dst"))


def _seeds(spark: SparkSession, d: str) -> list[str]:
    """The first pages of the first sites: a list of fixed length."""
    return [r.url for r in pages(spark, d).groupBy(urls.authority("url").alias("host")).agg(F.min("url").alias("url")).orderBy("host").limit(SEEDS).collect()]


def _crawl(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The crawl's graph, saved once and loaded after that."""

    def save(folder: str) -> None:
        sinks.graph(*graph.crawl(graph.links(checkpointed(pages(spark, d))), _seeds(spark, d), **CRAWL), folder)

    return sinks.load_graph(spark, kept(spark, table(spark, d, "read_corpus"), "crawl", save))


def _scores(spark: SparkSession, d: str, name: str, f) -> DataFrame:
    """Scores of the web's pages, saved once and loaded after that."""
    return spark.read.parquet(kept(spark, table(spark, d, "read_corpus"), name, lambda folder: sinks.table(f(_edges(spark, d)), f"{folder}/scores")) + "/scores")


def _parts(spark: SparkSession, d: str) -> DataFrame:
    return pages(spark, d).select("url", urls.authority("url").alias("domain"), urls.depth("url").alias("depth"), urls.extension("url").alias("ext"), urls.query("url").alias("query"), urls.page_class("url").alias("class"))


def _round(df: DataFrame, *cols: str) -> DataFrame:
    return df.select("id", *[F.round(c, 9).alias(c) for c in cols])


def _pagerank(spark: SparkSession, d: str) -> DataFrame:
    return _round(_scores(spark, d, "pagerank", graph.pagerank), "score")


def _hits(spark: SparkSession, d: str) -> DataFrame:
    return _round(_scores(spark, d, "hits", graph.hits), "hub", "authority")


def _overlap(spark: SparkSession, d: str) -> DataFrame:
    return graph.overlap(_pagerank(spark, d), _hits(spark, d), "id", "score", "authority")


def _crawl_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _crawl(spark, d)[0]


def _crawl_edges(spark: SparkSession, d: str) -> DataFrame:
    return _crawl(spark, d)[1]


def _stem(name: str):
    return lambda s, d: stem.stems(lx.tokens(s, d), name)


def _stem_compare(spark: SparkSession, d: str) -> DataFrame:
    """(stemmer, terms, stems, ratio)."""
    t, out = lx.tokens(spark, d).select("term").distinct(), None
    for name in stem.STEMMERS:
        s = stem.stems(t, name).agg(F.count(F.lit(1)).alias("terms"), F.countDistinct("stem").alias("stems"))
        s = s.select(F.lit(name).alias("stemmer"), "terms", "stems", F.round(F.try_divide("stems", "terms"), 6).alias("ratio"))
        out = s if out is None else out.unionByName(s)
    return out


def _codec(gapped: bool):
    def q(spark: SparkSession, d: str) -> DataFrame:
        back = codec.decompressed(codec.compressed(lx.posts(spark, d), gapped), gapped)
        return back.groupBy("term").agg(F.count(F.lit(1)).alias("df"), F.sum("tf").alias("cf"), F.sum("doc_id").alias("ids"))

    return q


QUERIES = {
    "letter_freq": lambda s, d: langid.letter_model(_labelled(s, d)).select("lang", "ch", "n", F.round("p", 9).alias("p")),
    "bigram_model": lambda s, d: langid.bigram_model(_labelled(s, d)).select("lang", "x", "y", "n", F.round("p", 9).alias("p")),
    "lang_unigram": lambda s, d: langid.detect_letters(sq._topics(s, d), langid.letter_model(_labelled(s, d)), "qid", "query"),
    "lang_bigram": lambda s, d: langid.detect_bigrams(sq._topics(s, d), langid.bigram_model(_labelled(s, d)), "qid", "query"),
    "stem_porter": _stem("porter"),
    "stem_lancaster": _stem("lancaster"),
    "stem_spanish": _stem("spanish"),
    "stemmed_df": lambda s, d: stats.surface_df(lx.tokens(s, d), stem.stems(lx.tokens(s, d), "spanish")),
    "stem_compare": _stem_compare,
    "codec_roundtrip": _codec(True),
    "codec_roundtrip_ids": _codec(False),
    "links": lambda s, d: graph.links(pages(s, d)),
    "links_lenient": lambda s, d: graph.links_lenient(pages(s, d)),
    "url_parts": _parts,
    "page_class": lambda s, d: _parts(s, d).groupBy("class").agg(F.count(F.lit(1)).alias("pages")),
    "depth_hist": lambda s, d: _parts(s, d).groupBy("depth").agg(F.count(F.lit(1)).alias("pages")),
    "graph_stats": lambda s, d: graph.graph_stats(graph._nodes(_edges(s, d)), _edges(s, d)),
    "digraph_edges": lambda s, d: graph.digraph(_edges(s, d)),
    "crawl_nodes": _crawl_nodes,
    "crawl_edges": _crawl_edges,
    "pagerank": _pagerank,
    "hits": _hits,
    "rank_overlap": _overlap,
    "pagerank_top10": lambda s, d: graph.top(_pagerank(s, d), "id", "score"),
    "authority_top10": lambda s, d: graph.top(_hits(s, d).select("id", "authority"), "id", "authority"),
    "logical_depth_hist": lambda s, d: _crawl_nodes(s, d).groupBy("logical_depth").agg(F.count(F.lit(1)).alias("pages")),
}

_CH = "select {}, unnest(regexp_extract_all(lower(replace({}, chr(304), 'i' || chr(775))), '\\p{{L}}')) as ch from {}"
_LET = f"select lang, ch, count(*) as n from ({_CH.format('lang', 'text', '(select * from documents where lang is not null)')}) group by all"
_LM = f"select lang, ch, n, n::double / sum(n) over (partition by lang) as p from ({_LET})"


def _pairs(key: str, text: str, source: str) -> str:
    return f"select {key}, ch[i] as x, ch[i + 1] as y from (select {key}, ch, unnest(range(1, len(ch))) as i from (select {key}, regexp_extract_all(lower(replace({text}, chr(304), 'i' || chr(775))), '\\p{{L}}') as ch from {source}))"


_BM = f"select lang, x, y, n, n::double / sum(n) over (partition by lang, x) as p from (select lang, x, y, count(*) as n from ({_pairs('lang', 'text', '(select * from documents where lang is not null)')}) group by all)"
_TOP = f"({sq._TOPICS})"
_ANCHOR = urls._ANCHOR.replace("'", "''")
_PLAIN = "case when v[1] in ('\"', '''') then v[2:-2] else v end"
for _e, _x in urls._ENTITIES:
    _PLAIN = f"replace({_PLAIN}, '{_e.replace(chr(39), chr(39) * 2)}', '{_x.replace(chr(39), chr(39) * 2)}')"
_LN = f"select url, pos, {_PLAIN} as href from (select url, unnest(range(0, len(h))) as pos, unnest(h) as v from (select url, regexp_extract_all(html, '{_ANCHOR}', 1) as h from ({_PAGES})))"
_PATH = r"regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1)"
_PARTS = rf"""select url, domain, depth, ext, query, case when query <> '' or ext in ({str(urls.DYNAMIC)[1:-1]}) then 'dynamic' when ext in ({str(urls.STATIC)[1:-1]}) then 'static' else 'unknown' end as class from
  (select url, regexp_extract(url, '^[a-z]+://([^/?#]*)', 1) as domain, len(list_filter(string_split({_PATH}, '/'), lambda x: x <> ''))::int as depth, lower(regexp_extract({_PATH}, '\.([^.]*)$', 1)) as ext, regexp_extract(url, '\?([^#]*)', 1) as query from ({_PAGES}))"""
_RAW = f"pg as materialized ({_PAGES}), l as materialized ({_LN.replace(f'({_PAGES})', 'pg')}), k as materialized (select url as src, href as dst from l where href in (select url from pg))"
_E = f"{_RAW}, e as materialized (select distinct src, dst from k where src <> dst), n as materialized (select src as id from e union select dst from e)"
_PR = f"""with recursive {_E}, o as materialized (select src, count(*) as c from e group by src), t as (select count(*) as n from n),
  r(i, id, s, err) as (select 0, id, 1.0::double / t.n, 1e9::double from n, t union all
    select i + 1, id, v, sum(abs(v - old)) over () from (select x.i, n.id, x.s as old,
        0.15::double / t.n + 0.85::double * (coalesce(f.v, 0) + (select coalesce(sum(s), 0) from r where id not in (select src from o)) / t.n) as v
      from n join r x on x.id = n.id cross join t left join (select dst, sum(s / c) as v from e join o using (src) join r on r.id = e.src group by dst) f on f.dst = n.id where x.i < 200 and x.err >= t.n * 1e-6)),
  p as materialized (select id, round(s, 9) as score from r where i = (select max(i) from r))"""
_HITS_STEP = "(select n.id, coalesce(h.s, 0) as s from n left join (select e.src, sum(a.s) as s from e join (select e.dst, sum(q.s) as s from e join {} q on q.id = e.src group by e.dst) a on a.dst = e.dst group by e.src) h on h.src = n.id)"
_HITS4 = "r"
for _ in range(4):
    _HITS4 = _HITS_STEP.format(_HITS4)
_HT = f"""w(i, id, s, err) as (select 0, id, 1.0::double, 1e9::double from n union all
    select i + 1, id, v, sum(abs(v - old)) over () from (select x.i, x.id, x.s as old, q.s / max(q.s) over () as v from w x join {_HITS4.replace('join r q', 'join w q')} q on q.id = x.id where x.i < 50 and x.err >= 1e-6)),
  hb as materialized (select id, s from w where i = (select max(i) from w)), au as materialized (select n.id, coalesce(a.s, 0) as s from n left join (select e.dst, sum(hb.s) as s from e join hb on hb.id = e.src group by e.dst) a on a.dst = n.id),
  ht as materialized (select hb.id, round(hb.s / (select sum(s) from hb), 9) as hub, round(au.s / (select sum(s) from au), 9) as authority from hb join au using (id))"""
_HITS = f"with recursive {_E}, {_HT}"


def _crawl_sql() -> str:
    """The crawl level by level: (id, url, logical_depth) as c and the links l."""
    host = "regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)"
    deep = r"len(list_filter(string_split(regexp_extract({}, '^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*([^?#]*)', 1), '/'), lambda x: x <> ''))"
    steps = [_RAW, f"c0 as materialized (select row_number() over (order by h) - 1 as id, url, 0 as logical_depth from (select {host.format('url')} as h, min(url) as url from pg group by 1 order by 1 limit {SEEDS}))"]
    for i in range(1, CRAWL["logical"] + 1):
        steps.append(f"""f{i} as materialized (select href as url, min((c.id, l.pos)) as o from l join c{i - 1} c on c.url = l.url and c.logical_depth = {i - 1} group by href),
  g{i} as (select url, o, {host.format('url')} as h, row_number() over (partition by {host.format('url')} order by o) as r from f{i} where regexp_matches(url, '^(?i)https?:') and {deep.format('url')} <= {CRAWL['physical']} and url not in (select url from c{i - 1})),
  c{i} as materialized (select * from c{i - 1} union all select id, url, {i} from (select row_number() over (order by o) - 1 + (select count(*) from c{i - 1}) as id, url from g{i} where r + (select count(*) from c{i - 1} u where {host.format('u.url')} = g{i}.h) <= {CRAWL['per_domain']}) where id < {CRAWL['total']})""")
    return f"with {', '.join(steps)}, c as (select id::bigint as id, url, logical_depth from c{CRAWL['logical']})"


SQL = {
    "letter_freq": f"select lang, ch, n, round(p, 9) as p from ({_LM})",
    "bigram_model": f"select lang, x, y, n, round(p, 9) as p from ({_BM})",
    "lang_unigram": f"""with m as materialized ({_LM}), t as {_TOP}, c as (select qid, ch, count(*) as n from ({_CH.format('qid', 'query', 't')}) group by all), q as (select qid, ch, n::double / sum(n) over (partition by qid) as q from c),
  k as (select distinct qid from q), lg as (select distinct lang from m), u as (select ch from m union select ch from q),
  d as (select k.qid, lg.lang, round(sum((coalesce(m.p, 0) - coalesce(q.q, 0)) ** 2), 9) as d from k cross join lg cross join u left join m on m.lang = lg.lang and m.ch = u.ch left join q on q.qid = k.qid and q.ch = u.ch group by all)
  select t.qid, coalesce(b.lang, 'unknown') as lang from t left join (select qid, lang from (select *, row_number() over (partition by qid order by d, lang) as r from d) where r = 1) b using (qid)""",
    "lang_bigram": f"""with m as materialized ({_BM}), t as {_TOP}, b as (select qid, x, y, count(*) as n from ({_pairs('qid', 'query', 't')}) group by all), l as (select distinct lang from m),
  s as (select b.qid, l.lang, round(sum(b.n * ln(coalesce(m.p, 1e-6))), 6) as s from b, l left join m on m.lang = l.lang and m.x = b.x and m.y = b.y group by all)
  select t.qid, coalesce(k.lang, (select min(lang) from l)) as lang from t left join (select qid, lang from (select *, row_number() over (partition by qid order by s desc, lang) as r from s) where r = 1) k using (qid)""",
    "codec_roundtrip": f"select term, count(*) as df, sum(tf)::bigint as cf, sum(doc_id)::bigint as ids from ({lx._P}) group by term",
    "codec_roundtrip_ids": f"select term, count(*) as df, sum(tf)::bigint as cf, sum(doc_id)::bigint as ids from ({lx._P}) group by term",
    "links": _LN,
    "links_lenient": _LN,
    "url_parts": _PARTS,
    "page_class": f"select class, count(*) as pages from ({_PARTS}) group by class",
    "depth_hist": f"select depth, count(*) as pages from ({_PARTS}) group by depth",
    "graph_stats": f"with {_RAW} select (select count(*) from (select src from k union select dst from k)) as nodes, (select count(*) from k) as edges",
    "digraph_edges": f"with {_E} select src, dst from e",
    "crawl_nodes": f"{_crawl_sql()} select * from c",
    "crawl_edges": f"{_crawl_sql()} select a.id as src, b.id as dst from l join c a on a.url = l.url join c b on b.url = l.href",
    "logical_depth_hist": f"{_crawl_sql()} select logical_depth, count(*) as pages from c group by logical_depth",
    "pagerank": f"{_PR} select id, score from p",
    "hits": f"{_HITS} select id, hub, authority from ht",
    "pagerank_top10": f"{_PR} select row_number() over (order by score desc, id) as rank, id, score from p order by score desc, id limit 10",
    "authority_top10": f"{_HITS} select row_number() over (order by authority desc, id) as rank, id, authority from ht order by authority desc, id limit 10",
    "rank_overlap": f"""{_PR}, {_HT}, a as materialized (select id, row_number() over (order by score desc, id) as r from p), b as (select id, row_number() over (order by authority desc, id) as s from ht),
  m as (select greatest(r, s) as k, count(*) as c from a join b using (id) group by 1) select a.r::int as k, round(sum(coalesce(c, 0)) over (order by a.r) * 100.0::double / a.r, 6) as share from a left join m on m.k = a.r""",
}
