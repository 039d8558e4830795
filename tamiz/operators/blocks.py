"""Many queries against many documents without a row for each query and document that meet.

Postings are packed into blocks of documents, a few bytes a posting, and stored once (:func:`write`).  A task has some
queries and reads the blocks of some documents one after another: it adds up a query's scores in one array a block and
keeps the best ``k`` so far, exactly, with the ties in the order asked for.  So nothing is shuffled but the queries and what is kept.
Topics with the same terms are one query and are told apart at the end.

The blocks lie in the shared checkpoint folder and are read by pyarrow on the executors (a shared path, hdfs, s3 or gs).
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator
from urllib.parse import unquote, urlparse

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tamiz.session import bytes_of, checkpointed, shared_folder

DOCS = 16_384  # documents of a block, about; under 65,536 in any block of two bytes a place
QUERIES = 20_000  # queries of a task, at most
KEPT = 6_000_000  # results that a task holds, about
FEW = 200  # results a query up to which blocks are dealt to tasks and merged; beyond, a task reads them all
SCALE = 1e8  # scores count to 8 places
ROWS = 100_000  # rows handed to Spark at once

_PACKED = "db int, docs binary, lens binary, norm binary, log_norm binary, names array<string>, terms array<string>, starts binary, ids binary, tfs binary"


def _pack(posts: pa.Table, docs: pa.Table) -> pa.Table:
    """One row: the documents of a block in order, and for each term the places of its documents and their tf."""
    docs = docs.sort_by("doc_id")
    doc = docs["doc_id"].to_numpy()
    place = np.searchsorted(doc, posts["doc_id"].to_numpy())
    coded = posts["term"].combine_chunks().dictionary_encode()
    coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
    code = coded.indices.to_numpy(zero_copy_only=False)
    o = np.lexsort((place, code))
    tf = posts["tf"].to_numpy()[o]
    starts = np.r_[0, np.cumsum(np.bincount(code, minlength=len(coded.dictionary)))].astype(np.int32)
    narrow = lambda x: x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.int64) if x.max(initial=0) <= np.iinfo(t).max)).tobytes()
    f = lambda c: docs[c].to_numpy().astype(np.float64).tobytes()
    db = (posts if len(posts) else docs)["db"][0].as_py()
    row = {"db": [db], "docs": [doc.astype(np.int64).tobytes()], "lens": [f("doc_len")], "norm": [f("norm")], "log_norm": [f("log_norm")], "names": [docs["name"].to_pylist()]}
    row |= {"terms": [coded.dictionary.to_pylist()], "starts": [starts.tobytes()], "ids": [narrow(place[o])], "tfs": [narrow(tf)]}
    kinds = {"db": pa.int32(), "names": pa.list_(pa.string()), "terms": pa.list_(pa.string())}
    return pa.table({k: pa.array(v, kinds.get(k, pa.binary())) for k, v in row.items()})


def write(posts: DataFrame, docs: DataFrame, folder: str, n_docs: int) -> None:
    """Blocks of postings (term, doc_id, tf) and of all their documents (doc_id, doc_len, norm, log_norm, name), a file each."""
    cores = posts.sparkSession.sparkContext.defaultParallelism
    n = max(1, math.ceil(n_docs / min(DOCS, max(1024, n_docs // (2 * cores) + 1))))
    db = F.pmod(F.xxhash64("doc_id"), F.lit(n)).cast("int").alias("db")
    p = posts.select(db, "term", F.col("doc_id").cast("bigint").alias("doc_id"), F.col("tf").cast("bigint").alias("tf")).groupBy("db")
    d = docs.select(db, F.col("doc_id").cast("bigint").alias("doc_id"), *[F.col(c).cast("double").alias(c) for c in ("doc_len", "norm", "log_norm")], F.col("name").cast("string").alias("name")).groupBy("db")
    packed = p.cogroup(d).applyInArrow(lambda a, b: _pack(a, b), _PACKED)
    packed.repartitionById(n, F.col("db")).write.mode("overwrite").parquet(folder)


def scratch(spark) -> str:
    return f"{shared_folder(spark)}/tamiz-blocks-{uuid.uuid4().hex}"


def _opened(uri: str):
    import pyarrow.fs as fs
    import pyarrow.parquet as pq

    at = urlparse(uri)
    system, path = (fs.LocalFileSystem(), unquote(at.path)) if at.scheme in ("", "file") else fs.FileSystem.from_uri(uri)
    return pq.ParquetFile(system.open_input_file(path))


class Block:
    """A stored block; ``of(terms)``: where the postings of those terms begin and end (0, 0: none here)."""

    def __init__(self, row: dict):
        get = lambda c, t: np.frombuffer(row[c][0].as_buffer(), t)
        self.docs, self.lens, self.norm, self.log_norm = get("docs", np.int64), *(get(c, np.float64) for c in ("lens", "norm", "log_norm"))
        self.names, self.terms, self.starts = row["names"][0].values, row["terms"][0].values, get("starts", np.int32).astype(np.int64)
        n = int(self.starts[-1])
        wide = lambda c: get(c, {1: np.uint8, 2: np.uint16, 4: np.uint32, 8: np.int64}[len(row[c][0].as_buffer()) // max(n, 1)] if n else np.uint8)
        self.ids, self.tf = wide("ids").astype(np.int32), wide("tfs").astype(np.float64)

    def only(self, terms: pa.Array) -> np.ndarray:
        """Keeps the postings of ``terms`` alone; the term's number of each of them."""
        code = pc.index_in(self.terms, value_set=terms).to_numpy(zero_copy_only=False)
        code = np.where(np.isnan(code), -1, code).astype(np.int64) if code.dtype.kind == "f" else code.astype(np.int64)
        size = np.diff(self.starts)
        use = np.repeat(code >= 0, size)
        self.ids, self.tf = self.ids[use], self.tf[use]
        mine = np.flatnonzero(code >= 0)
        ends = np.cumsum(size[mine])
        self.begin, self.end = (np.zeros(len(terms), np.int64) for _ in range(2))
        self.begin[code[mine]], self.end[code[mine]] = ends - size[mine], ends
        return np.repeat(code[mine], size[mine])


def blocks_of(files: list[str]) -> Iterator[Block]:
    for f in files:
        with _opened(f) as file:
            for batch in file.iter_batches(batch_size=1):
                yield Block({c: batch.column(c) for c in batch.schema.names})


class Queries:
    """The queries of a task, their terms end to end."""

    def __init__(self, batches: list[pa.RecordBatch]):
        t = pa.Table.from_batches(batches).combine_chunks()
        flat = lambda c: pc.list_flatten(t[c]).combine_chunks()
        self.rep, self.length = t["rep"].combine_chunks(), t["q_len"].to_numpy()
        self.ends = np.r_[0, np.cumsum(pc.list_value_length(t["terms"]).to_numpy())].tolist()
        coded = flat("terms").dictionary_encode()
        coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
        self.terms, self.code = coded.dictionary, coded.indices.to_numpy(zero_copy_only=False)
        self.qtf, cf, df = (flat(c).to_numpy(zero_copy_only=False).astype(np.float64) for c in ("qtfs", "cfs", "dfs"))
        self.cf, self.df = np.zeros(len(self.terms)), np.zeros(len(self.terms))
        self.cf[self.code], self.df[self.code] = cf, df


def distinct(queries: DataFrame, vocab: DataFrame, order: str = "term") -> tuple[DataFrame, DataFrame]:
    """((qid, rep), (rep, terms, qtfs, cfs, dfs, q_len)): topics of equal terms have one representative; unknown terms count in q_len only."""
    per = queries.where("qid is not null").groupBy("qid").agg(F.sort_array(F.collect_list(F.struct(*dict.fromkeys([order, "term", "qtf"])))).alias("words"))
    of = checkpointed(per.withColumn("rep", F.min("qid").over(Window.partitionBy("words"))))
    one = of.where("qid = rep").select("rep", F.expr("aggregate(words, 0D, (a, w) -> a + w.qtf)").alias("q_len"), F.explode("words").alias("w"))
    known = one.select("rep", "q_len", "w.*").join(vocab.select("term", "cf", "df"), "term")
    got = known.groupBy("rep", "q_len").agg(F.sort_array(F.collect_list(F.struct(*dict.fromkeys([order, "term", "qtf", "cf", "df"])))).alias("w"))
    return of.select("qid", "rep"), checkpointed(got.select("rep", F.col("w.term").alias("terms"), *[F.col(f"w.{c}").cast("array<double>").alias(f"{c}s") for c in ("qtf", "cf", "df")], "q_len"))


def told_apart(rows: DataFrame, of: DataFrame) -> DataFrame:
    """Rows of representatives for each of their topics, ``qid`` in place of ``rep``."""
    return rows.join(F.broadcast(of) if of.count() <= 1_000_000 or bytes_of(of) <= 64 << 20 else of, "rep").drop("rep")


def over(queries: DataFrame, folder: str, kept: int, whole: bool, run: Callable[[list[str], Queries], Iterator[pa.RecordBatch]], schema: str) -> tuple[DataFrame, bool]:
    """``run`` for tasks of some queries and the files of some blocks; whether a task sees all documents.

    ``kept``: results a query that a task holds.  Unless a task is to see the ``whole`` collection, the blocks are dealt to tasks too.
    """
    spark = queries.sparkSession
    files = sorted(spark.read.parquet(folder).inputFiles())
    n, cores = max(1, queries.count()), spark.sparkContext.defaultParallelism
    groups = 1 if whole else min(len(files), 2 * cores)
    parts = max(math.ceil(n / QUERIES), math.ceil(n * kept / KEPT), min(n, 2 * cores) if groups == 1 else 1)
    part = F.pmod(F.xxhash64("rep"), F.lit(parts))
    rows = queries.withColumn("group", F.explode(F.sequence(F.lit(0), F.lit(groups - 1)))).withColumn("task", (part * groups + F.col("group")).cast("int"))

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mine = [b for b in batches if b.num_rows]
        if mine:
            yield from run(files[mine[0].column("group")[0].as_py() :: groups], Queries(mine))

    return rows.repartitionById(parts * groups, F.col("task")).mapInArrow(each, schema), groups == 1


def _merged(block: Block, q: Queries, j: int, begin: list, end: list, weight: np.ndarray, total: np.ndarray, seen: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(place, sum of weights) of the documents of query j."""
    at = [(begin[i], end[i], q.qtf[i]) for i in range(q.ends[j], q.ends[j + 1]) if end[i]]
    if not at:
        return block.ids[:0], weight[:0]
    if len(at) == 1:
        b, e, x = at[0]
        return block.ids[b:e], weight[b:e] * x
    for b, e, x in at:
        total[block.ids[b:e]] += weight[b:e] * x
    if sum(e - b for b, e, _ in at) * 16 < len(total):
        place = np.unique(np.concatenate([block.ids[b:e] for b, e, _ in at]))
    else:
        for b, e, _ in at:
            seen[block.ids[b:e]] = True
        place = np.flatnonzero(seen)
        seen[place] = False
    s = total[place]
    total[place] = 0
    return place, s


def best(queries: DataFrame, folder: str, k: int | None, models: list, down: bool = False, names: bool = False, damp: Callable = lambda qtf: qtf) -> tuple[DataFrame, bool]:
    """(setting, rep, doc_id or docno, score, rank) of the first ``k`` documents (None: all) of each query by score to 8 places, then document.

    ``models``: for each setting the weight(tf, doc_len, cf, df) of a posting, the finish(sums, part of the documents, part of the query)
    of a score, and what gives those parts of a block and of the queries.  The second value says whether ranks are final; else
    they are those of parts of the documents.  ``names``: documents by name, a name once with its best place of the first k, and
    ranks of names.  ``damp``: the weight of a term in the query.
    """

    def trim(r: np.ndarray, at: np.ndarray, docs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        if k is None or len(r) <= k:
            return r, at
        last = np.partition(r, len(r) - k)[len(r) - k]
        sure, tied = np.flatnonzero(r > last), np.flatnonzero(r == last)
        if (need := k - len(sure)) < len(tied):
            o = np.argsort(docs[at[tied]], kind="stable")
            tied = tied[o[-need:] if down else o[:need]]
        use = np.r_[sure, tied]
        return r[use], at[use]

    def emitted(held: list[list], q: Queries, docs: np.ndarray, coded, number) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []

        def flush() -> pa.RecordBatch:
            size = [len(x[2]) for x in out]
            col = lambda i: np.concatenate([x[i] for x in out])
            rep = q.rep.take(pa.array(np.repeat([x[1] for x in out], size)))
            setting = pa.array(np.repeat(np.array([x[0] for x in out], np.int32), size))
            doc = coded.dictionary.take(pa.array(col(2))) if names else pa.array(col(2))
            got = pa.record_batch([setting, rep, doc, pa.array(col(3)), pa.array(col(4).astype(np.int32))], names=["setting", "rep", "docno" if names else "doc_id", "score", "rank"])
            out.clear()
            return got

        rows = 0
        for m, mine in enumerate(held):
            for j, x in enumerate(mine):
                if x is None:
                    continue
                mine[j] = None
                r, at = x[:2]
                d = docs[at]
                o = np.lexsort((-d if down else d, -r))
                r, at, d = r[o], at[o], d[o]
                if names:
                    d = number[at]
                    _, first = np.unique(d, return_index=True)
                    first = np.sort(first)
                    first = first[d[first] >= 0]
                    r, d = r[first], d[first]
                if len(r):
                    out.append((m, j, d, r / SCALE, np.arange(1, len(r) + 1)))
                    rows += len(r)
                if rows >= ROWS:
                    yield flush()
                    rows = 0
        if out:
            yield flush()

    def run(files: list[str], q: Queries) -> Iterator[pa.RecordBatch]:
        n = len(q.rep)
        held: list[list] = [[None] * n for _ in models]
        q.qtf = damp(q.qtf)
        own = [m[3](q) for m in models]
        docs, called = np.zeros(0, np.int64), []
        for block in blocks_of(files):
            base = len(docs)
            docs = np.r_[docs, block.docs]
            if names:
                called.append(block.names)
            code = block.only(q.terms)
            begin, end = block.begin[q.code].tolist(), block.end[q.code].tolist()
            total, seen, lens = np.zeros(len(block.docs)), np.zeros(len(block.docs), bool), block.lens[block.ids]
            for m, (weight, finish, of_docs, _) in enumerate(models):
                w, mine, ends = weight(block.tf, lens, q.cf[code], q.df[code]), held[m], of_docs(block)
                for j in range(n):
                    place, s = _merged(block, q, j, begin, end, w, total, seen)
                    if not len(place):
                        continue
                    s = finish(s, ends[place], own[m][j])
                    was = mine[j]
                    if was is not None and len(was[0]) == k:
                        some = np.flatnonzero(s >= (was[2] - 1) / SCALE)
                        if not len(some):
                            continue
                        place, s = place[some], s[some]
                    r, at = trim(np.rint(s * SCALE), (place + base).astype(np.int32), docs)
                    if was is not None:
                        r, at = trim(np.r_[was[0], r], np.r_[was[1], at], docs)
                    mine[j] = r, at, r.min()
            if k is None:  # nothing to compare with further blocks
                yield from emitted(held, q, docs, None, None)
        coded = number = None
        if names:
            coded = pa.chunked_array(called, pa.string()).combine_chunks().dictionary_encode() if called else pa.array([], pa.string()).dictionary_encode()
            coded = coded.combine_chunks() if isinstance(coded, pa.ChunkedArray) else coded
            number = coded.indices.fill_null(-1).to_numpy(zero_copy_only=False)

        yield from emitted(held, q, docs, coded, number)

    kind = "docno string" if names else "doc_id bigint"
    kept = 0 if k is None else k * len(models)
    return over(queries, folder, kept, names or kept > FEW, run, f"setting int, rep string, {kind}, score double, rank int")


def membership(queries: DataFrame, folder: str) -> DataFrame:
    """(rep, m1 to m7): how many documents hold just those of a query's at most three terms whose bits (1, 2, 4, in the query's order) are in m's number."""

    def run(files: list[str], q: Queries) -> Iterator[pa.RecordBatch]:
        count = np.zeros((len(q.rep), 8), np.int64)
        for block in blocks_of(files):
            block.only(q.terms)
            begin, end = block.begin[q.code].tolist(), block.end[q.code].tolist()
            mark = np.zeros(len(block.docs), np.uint8)
            for j in range(len(q.rep)):
                lists = [block.ids[begin[i] : end[i]] for i in range(q.ends[j], q.ends[j + 1])]
                for bit, x in enumerate(lists):
                    mark[x] |= 1 << bit
                for x in lists:  # a document counts with its first list
                    count[j] += np.bincount(mark[x], minlength=8)
                    mark[x] = 0
        count[:, 0] = 0
        yield pa.record_batch([q.rep, *(pa.array(count[:, i]) for i in range(1, 8))], names=["rep", *(f"m{i}" for i in range(1, 8))])

    got, _ = over(queries, folder, 0, False, run, "rep string, " + ", ".join(f"m{i} bigint" for i in range(1, 8)))
    return got.groupBy("rep").agg(*[F.sum(f"m{i}").alias(f"m{i}") for i in range(1, 8)])
