"""Web graph: links, bounded breadth-first crawl over stored pages, PageRank, HITS, overlap of rankings."""

from __future__ import annotations

from html.parser import HTMLParser

import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.functions import urls
from tamiz.operators import laws
from tamiz.session import bytes_of, checkpointed


def links(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """(url, pos, href): raw link targets of well-formed pages."""
    return pages.select(F.col(url).alias("url"), F.posexplode(urls.hrefs(html)).alias("pos", "href"))


class _Anchors(HTMLParser):
    def __init__(self) -> None:
        super().__init__()
        self.found: list[str] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "a":
            self.found += [v for k, v in attrs if k == "href" and v is not None]


def links_lenient(pages: DataFrame, url: str = "url", html: str = "html") -> DataFrame:
    """As :func:`links` with a full HTML parser, for pages that are not well formed."""

    @F.pandas_udf("array<string>")
    def anchors(texts: pd.Series) -> pd.Series:
        def one(t: str | None) -> list[str]:
            p = _Anchors()
            p.feed(t or "")
            return p.found

        return texts.map(one)

    return pages.select(F.col(url).alias("url"), F.posexplode(anchors(html)).alias("pos", "href"))


def resolved(link: DataFrame) -> DataFrame:
    """Relative targets of (url, pos, href) completed with the page's scheme and authority."""
    root = F.regexp_extract("url", r"^([A-Za-z][A-Za-z0-9+.-]*://[^/?#]*)", 1)
    full = F.when(F.col("href").rlike(r"^[A-Za-z][A-Za-z0-9+.-]*:"), F.col("href")).when(F.col("href").startswith("/"), F.concat(root, F.col("href"))).otherwise(F.concat(root, F.lit("/"), F.col("href")))
    return link.withColumn("href", full)


def crawl(link: DataFrame, seeds: list[str], per_domain: int, logical: int, physical: int, total: int | None = None, stay: bool = False) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a first-in-first-out crawl over stored links (url, pos, href).

    A level is one step: candidates in order of (parent, position), first occurrence each, static
    filters (web scheme, physical depth, seed domains if ``stay``), then the domain's and the global
    cap.  Rejections are permanent in first-in-first-out order, so levels give the same ids.  Nodes:
    (id, url, logical_depth); edges: (src, dst) of every link occurrence between nodes.
    """
    spark = link.sparkSession
    hosts = sorted({s.split("://", 1)[-1].split("/", 1)[0] for s in seeds})
    limit = total if total is not None else 1 << 60
    rows = list(dict.fromkeys(seeds))[:limit]
    nodes = checkpointed(spark.createDataFrame([(i, u, 0) for i, u in enumerate(rows)], "id bigint, url string, logical_depth int"))
    count = len(rows)
    for level in range(1, logical + 1):
        near = link.join(nodes.where(F.col("logical_depth") == level - 1).select("id", "url"), "url")
        first = near.groupBy("href").agg(F.min(F.struct("id", "pos")).alias("at")).select(F.col("href").alias("url"), "at")
        ok = first.where(urls.web_scheme("url") & (urls.depth("url") <= physical)).join(nodes.select("url"), "url", "left_anti")
        if stay:
            ok = ok.where(urls.under_seed("url", F.array(*map(F.lit, hosts))))
        used = nodes.groupBy(urls.authority("url").alias("domain")).agg(F.count(F.lit(1)).alias("used"))
        ok = ok.withColumn("domain", urls.authority("url")).join(used, "domain", "left").fillna(0, ["used"])
        ok = ok.withColumn("r", F.row_number().over(Window.partitionBy("domain").orderBy("at"))).where(F.col("r") + F.col("used") <= per_domain)
        new = _numbered(checkpointed(ok.select("url", "at.id", "at.pos"))).where(F.col("n") + count <= limit)
        new = checkpointed(new.select((F.col("n") + count - 1).cast("bigint").alias("id"), "url", F.lit(level).alias("logical_depth")))
        got = new.count()
        if not got:
            break
        count += got
        nodes = checkpointed(nodes.unionByName(new))
    edges = link.join(nodes.select(F.col("id").alias("src"), "url"), "url").join(nodes.select(F.col("id").alias("dst"), F.col("url").alias("href")), "href").select("src", "dst")
    return nodes, edges


def _numbered(found: DataFrame) -> DataFrame:
    """(url, n): rows (url, id, pos) numbered from 1 by id and position.

    In three steps, so that no task orders a level: inside a parent, over the parents of a stretch of ids, over stretches.
    """
    per = found.groupBy("id").agg(F.count(F.lit(1)).alias("c")).withColumn("s", F.floor(F.col("id") / 65536))
    stretch = per.groupBy("s").agg(F.sum("c").alias("t"))
    before = lambda c, w: F.coalesce(F.sum(c).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    base = stretch.select("s", before("t", Window.partitionBy(F.lit(0)).orderBy("s")).alias("b"))
    per = per.select("id", "s", before("c", Window.partitionBy("s").orderBy("id")).alias("o")).join(base, "s")
    row = found.withColumn("r", F.row_number().over(Window.partitionBy("id").orderBy("pos")))
    return row.join(per, "id").select("url", (F.col("b") + F.col("o") + F.col("r")).alias("n"))


def digraph(edges: DataFrame) -> DataFrame:
    """Edges once each, without loops."""
    return edges.where("src <> dst").distinct()


def graph_stats(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(nodes, edges): edges with their multiplicity."""
    return nodes.select(F.count(F.lit(1)).alias("nodes"), edges.select(F.count(F.lit(1))).scalar().alias("edges"))


def _nodes(edges: DataFrame) -> DataFrame:
    return edges.select(F.explode(F.array("src", "dst")).alias("id")).distinct()


def _held(df: DataFrame, key: str) -> DataFrame:
    """``df`` partitioned by ``key`` and kept for the rounds; what is lost with an executor is made again from the checkpoint below."""
    return df.repartition(key).persist(StorageLevel.DISK_ONLY if bytes_of(df) > 1 << 34 else StorageLevel.MEMORY_AND_DISK)


def pagerank(edges: DataFrame, rounds: int = 200, tol: float | None = 1e-6, damping: float = 0.85) -> DataFrame:
    """(id, score) on the digraph of ``edges``; dangling mass and teleport are uniform, scores sum to 1.

    Stops after ``rounds`` or, with ``tol``, when the total change of a round falls under nodes * tol.  Every round is one plan
    of the same size: the edges stay partitioned by source and the nodes by id, only scores and flows
    move, and the scores are checkpointed.
    """
    e = checkpointed(digraph(edges))
    nodes = _nodes(e).join(e.groupBy(F.col("src").alias("id")).agg(F.count(F.lit(1)).alias("out")), "id", "left")
    nodes, e = _held(checkpointed(nodes), "id"), _held(e, "src")
    n = nodes.count()
    try:
        r = nodes.select("id", "out", F.lit(1.0 / max(n, 1)).alias("score"))
        for _ in range(rounds if n else 0):
            loose = r.where("out is null").agg(F.coalesce(F.sum("score"), F.lit(0.0))).first()[0]
            given = r.where("out is not null").select(F.col("id").alias("src"), (F.col("score") / F.col("out")).alias("f"))
            flow = e.join(given, "src").groupBy(F.col("dst").alias("id")).agg(F.sum("f").alias("in"))
            new = (1 - damping) / n + damping * (F.coalesce("in", F.lit(0.0)) + loose / n)
            was = r.select("id", F.col("score").alias("was"))
            r = checkpointed(nodes.join(flow, "id", "left").join(was, "id").select("id", "out", new.alias("score"), F.abs(new - F.col("was")).alias("change")))
            if tol is not None and r.agg(F.sum("change")).first()[0] < n * tol:
                break
        return checkpointed(r.select("id", "score")) if not n or not rounds else r.select("id", "score")
    finally:
        e.unpersist()
        nodes.unpersist()


def hits(edges: DataFrame, rounds: int = 200, tol: float | None = 1e-6, every: int = 4) -> DataFrame:
    """(id, hub, authority) on the digraph of ``edges``; both sum to 1.

    Hubs are scaled by their greatest every ``every`` rounds, which are one linear plan; with ``tol`` the rounds end when such a
    stretch changes the scaled hubs by less than ``tol`` in total.  ``rounds`` is rounded up to whole stretches.
    """
    e = checkpointed(digraph(edges))
    nodes, by_src, by_dst = _held(_nodes(e), "id"), _held(e, "src"), _held(e, "dst")
    n = nodes.count()
    try:
        hub = checkpointed(nodes.select("id", F.lit(1.0).alias("hub")))
        for _ in range(-(-rounds // every) if n else 0):
            h = hub
            for _ in range(every):
                auth = by_src.join(h.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a"))
                h = by_dst.join(auth.select(F.col("id").alias("dst"), "a"), "dst").groupBy(F.col("src").alias("id")).agg(F.sum("a").alias("hub"))
            got = checkpointed(nodes.join(h, "id", "left").join(hub.select("id", F.col("hub").alias("was")), "id").select("id", F.coalesce("hub", F.lit(0.0)).alias("hub"), "was"))
            top = got.agg(F.max("hub")).first()[0] or 1.0
            hub = got.select("id", (F.col("hub") / top).alias("hub"))
            if tol is not None and got.agg(F.sum(F.abs(F.col("hub") / top - F.col("was")))).first()[0] < tol:
                break
        auth = e.join(hub.select(F.col("id").alias("src"), "hub"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum("hub").alias("a"))
        both = checkpointed(hub.join(auth, "id", "left").select("id", "hub", F.coalesce("a", F.lit(0.0)).alias("a")))
        h, a = both.agg(F.sum("hub")).scalar(), both.agg(F.sum("a")).scalar()
        return both.select("id", F.try_divide("hub", h).alias("hub"), F.try_divide("a", a).alias("authority"))
    finally:
        for x in (nodes, by_src, by_dst):
            x.unpersist()


def top(scores: DataFrame, item: str, score: str, n: int = 10) -> DataFrame:
    """(rank, item, score): the report of the n best, equal ones by item."""
    best = scores.orderBy(F.desc(score), item).limit(n)
    return best.select(F.row_number().over(Window.orderBy(F.desc(score), item)).alias("rank"), item, score)  # n rows


def overlap(a: DataFrame, b: DataFrame, item: str, score_a: str, score_b: str, k: int | None = None) -> DataFrame:
    """(k, share): per cent of the first k of one ranking among the first k of the other, for k = 1, 2, ... up to ``k`` or all items; ties by item."""
    first = laws.ranked(a.select(item, score_a), score_a, item).select(item, F.col("rank").alias("r"))
    second = laws.ranked(b.select(item, score_b), score_b, item).select(item, F.col("rank").alias("s"))
    n = first.join(second, item).groupBy(F.greatest("r", "s").alias("rank")).agg(F.count(F.lit(1)).alias("n"))
    every = first.select(F.col("r").alias("rank")).join(n, "rank", "left").fillna(0, ["n"])
    if k is not None:
        every = every.where(F.col("rank") <= k)
    run = laws.cumulative(every, F.col("n"))
    return run.select(F.col("rank").cast("int").alias("k"), F.round(F.col("cum") * 100.0 / F.col("rank"), 6).alias("share"))
