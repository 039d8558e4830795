"""Inverted index: build, lengths, skips, gaps and sizes under compression."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tamiz.functions import codec
from tamiz.functions import text as tx
from tamiz.operators import blocks, skew, stats
from tamiz.session import checkpointed, kept, passing

_SPAN = 65536


def write_index(posts: DataFrame, folder: str) -> None:
    """Postings sorted by term and document, range-partitioned by both, as Parquet (replaces what is there).

    A term is found through row-group statistics; a term longer than a partition spans several files.
    """
    posts.repartitionByRange("term", "doc_id").sortWithinPartitions("term", "doc_id").write.mode("overwrite").parquet(folder)


def build(docs: DataFrame, folder: str, pattern: str = tx.LETTERS) -> None:
    """Writes a whole index of ``docs`` (doc_id, text) under ``folder``: what queries need is computed once, here.

    postings: (term, doc_id, tf, doc_len, block), sorted and range-partitioned by term and document; vocab:
    (term, cf, df); docs: (doc_id, doc_len, norm, log_norm), the norms of both TF-IDF weightings; skips: (term,
    block, size, first_doc, last_doc), blocks of the whole root of the list's length; blocks: the postings packed by
    documents for ranking (:mod:`tamiz.operators.blocks`); compressed: the lists in the codecs of
    :mod:`tamiz.functions.codec`; totals: one row, written last, which marks the index as complete.
    """
    with passing(docs.sparkSession):  # the shuffle files of a table go when it is written
        posts = checkpointed(stats.postings(stats.occurrences(docs, pattern)))
        stats.vocabulary(posts).repartitionByRange("term").sortWithinPartitions("term").write.mode("overwrite").parquet(f"{folder}/vocab")
        vocab, lengths = docs.sparkSession.read.parquet(f"{folder}/vocab"), stats.document_lengths(posts)
        n = docs.count()
        write_index(_blocked(posts, vocab).join(lengths, "doc_id"), f"{folder}/postings")
        done = docs.sparkSession.read.parquet(f"{folder}/postings")
        norms(done, vocab, n).write.mode("overwrite").parquet(f"{folder}/docs")
        blocks.write(done, docs.sparkSession.read.parquet(f"{folder}/docs").withColumn("name", F.lit(None)), f"{folder}/blocks", n)
        skips = done.groupBy("term", "block").agg(F.count(F.lit(1)).alias("size"), F.min("doc_id").alias("first_doc"), F.max("doc_id").alias("last_doc"))
        skips.repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{folder}/skips")
        codec.compressed(done.select("term", "doc_id", "tf")).repartitionByRange("term", "block").sortWithinPartitions("term", "block").write.mode("overwrite").parquet(f"{folder}/compressed")
        t = vocab.agg(F.coalesce(F.sum("cf"), F.lit(0)).alias("n_tokens"), F.count(F.lit(1)).alias("n_terms"))
        t.select(F.lit(n).cast("bigint").alias("n_docs"), "n_tokens", "n_terms", F.lit(lengths.count()).cast("bigint").alias("n_full")).coalesce(1).write.mode("overwrite").parquet(f"{folder}/totals")


def norms(posts: DataFrame, vocab: DataFrame, n_docs: int) -> DataFrame:
    """(doc_id, doc_len, norm, log_norm) of postings that carry their document's length."""
    idf = F.ln(F.lit(float(n_docs)) / F.col("df"))
    w = skew.join_counts(posts, vocab, "term", "df").select("doc_id", "doc_len", (F.col("tf") * idf).alias("w"), ((1.0 + F.ln("tf")) * idf).alias("l"))
    norm = lambda c: F.sqrt(F.sum(F.col(c) * F.col(c)))
    return w.groupBy("doc_id").agg(F.first("doc_len").alias("doc_len"), norm("w").alias("norm"), norm("l").alias("log_norm"))


def _blocked(posts: DataFrame, vocab: DataFrame) -> DataFrame:
    """Postings with their skip block: position in the list over the whole root of its length.

    Positions come from counts of spans and ranks inside spans, so a long list is not one task's.
    """
    cut = posts.withColumn("__s", F.floor(F.col("doc_id") / _SPAN))
    spans = cut.groupBy("term", "__s").agg(F.count(F.lit(1)).alias("__n"))
    spans = spans.select("term", "__s", F.coalesce(F.sum("__n").over(Window.partitionBy("term").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    spans = spans.join(vocab.select("term", F.greatest(F.lit(1), F.floor(F.sqrt("df"))).alias("__step")), "term")
    row = cut.withColumn("__r", F.row_number().over(Window.partitionBy("term", "__s").orderBy("doc_id")))
    return row.join(spans, ["term", "__s"]).select("term", "doc_id", "tf", F.floor((F.col("__b") + F.col("__r") - 1) / F.col("__step")).cast("int").alias("block"))


def stored(spark: SparkSession, docs: DataFrame, key: str, again: bool = False) -> str:
    """The folder of the index of ``docs``; built if it is not there or is to be built ``again``."""
    return kept(spark, docs, f"index-{key}", lambda folder: build(docs, folder), again)


def read_postings(index: DataFrame, *terms: str) -> DataFrame:
    """Postings of some terms; unknown terms have none.  The filter reaches the Parquet scan."""
    return index.where(F.col("term").isin(*terms))


def held_postings(index: DataFrame, *terms: str) -> DataFrame:
    """As :func:`read_postings`, kept in memory (and on disk beyond it) for repeated reads; ``unpersist`` lets them go."""
    return read_postings(index, *terms).persist(StorageLevel.MEMORY_AND_DISK)


def chunk_counts(chunks: DataFrame) -> DataFrame:
    """(index_no, chunks, records) of spilled runs; records without an index are left out."""
    return chunks.where("index_no is not null").groupBy("index_no").agg(F.countDistinct("chunk_id").alias("chunks"), F.count(F.lit(1)).alias("records"))


def advance(posts: DataFrame, skips: DataFrame, targets: DataFrame) -> DataFrame:
    """(term, target, doc_id): the first document of a term's list from ``target`` on; null where the list ends before.

    Skips name the one block to read: the first whose last document is not below the target.
    """
    at = targets.join(skips, "term").where(F.col("last_doc") >= F.col("target")).groupBy("term", "target").agg(F.min("block").alias("block"))
    hit = at.join(posts.select("term", "block", "doc_id"), ["term", "block"]).where(F.col("doc_id") >= F.col("target")).groupBy("term", "target").agg(F.min("doc_id").alias("doc_id"))
    return targets.distinct().join(hit, ["term", "target"], "left").select("term", "target", "doc_id")


def skip_and(posts: DataFrame, skips: DataFrame, terms: list[str]) -> DataFrame:
    """(doc_id) in the lists of all ``terms``, in the order given: of each further list only blocks that can hold a hit are read.

    Hits and blocks meet on spans of documents; blocks without a hit's document between their ends are skipped.
    """
    hits = read_postings(posts, terms[0]).select("doc_id")
    for t in terms[1:]:
        spans = F.explode(F.sequence(F.floor(F.col("first_doc") / _SPAN), F.floor(F.col("last_doc") / _SPAN)))
        block = read_postings(skips, t).select("block", "first_doc", "last_doc", spans.alias("s"))
        near = hits.withColumn("s", F.floor(F.col("doc_id") / _SPAN)).join(block, "s").where(F.col("doc_id").between(F.col("first_doc"), F.col("last_doc")))
        hits = near.select("doc_id", "block").join(read_postings(posts, t).select("doc_id", "block"), ["doc_id", "block"]).select("doc_id")
    return hits


def length_stats(vocab: DataFrame) -> DataFrame:
    p = lambda q: F.round(F.percentile("df", q), 6)
    return vocab.agg(F.count(F.lit(1)).alias("n_terms"), F.sum("df").alias("n_postings"), F.min("df").alias("min_len"), p(0.5).alias("median_len"), F.round(F.avg("df"), 6).alias("mean_len"), p(0.9).alias("p90_len"), F.max("df").alias("max_len"))


def length_histogram(vocab: DataFrame, per_decade: int = 4) -> DataFrame:
    """(bin, lists, lo, hi) of list lengths in log-spaced bins."""
    b = F.floor(F.round(F.log10("df") * per_decade, 9)).cast("int")
    return vocab.groupBy(b.alias("bin")).agg(F.count(F.lit(1)).alias("lists"), F.min("df").alias("lo"), F.max("df").alias("hi"))


def length_cdf(vocab: DataFrame) -> DataFrame:
    """(df, lists, share): share of lists no longer than df."""
    per = vocab.groupBy("df").agg(F.count(F.lit(1)).alias("lists"))
    run = F.sum("lists").over(Window.partitionBy(F.lit(0)).orderBy("df").rowsBetween(Window.unboundedPreceding, 0))
    return per.select("df", "lists", F.round(run / vocab.select(F.count(F.lit(1))).scalar(), 6).alias("share"))


def skip_pointers(vocab: DataFrame) -> DataFrame:
    """(term, src, dst): positions i and i + interval, interval the whole root of the list's length, at least 1."""
    step = F.greatest(F.lit(1), F.floor(F.sqrt("df"))).cast("bigint")
    v = vocab.select("term", "df", step.alias("step")).where(F.col("df") > F.col("step"))
    return v.select("term", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("df") - F.col("step") - 1, "step")).alias("src"), "step").select("term", "src", (F.col("src") + F.col("step")).alias("dst"))


def gaps(posts: DataFrame) -> DataFrame:
    """(term, doc_id, tf, gap): difference to the list's previous document, the first one's own id.

    Lists are cut into spans of documents; a span's first posting takes the previous span's last
    document from a small table, so a long list is not one task's.
    """
    cut = posts.withColumn("__s", F.floor(F.col("doc_id") / _SPAN))
    spans = cut.groupBy("term", "__s").agg(F.max("doc_id").alias("__last"))
    spans = spans.select("term", "__s", F.lag("__last").over(Window.partitionBy("term").orderBy("__s")).alias("__before"))
    before = F.lag("doc_id").over(Window.partitionBy("term", "__s").orderBy("doc_id"))
    got = cut.withColumn("__p", before).join(spans, ["term", "__s"])
    return got.select("term", "doc_id", "tf", (F.col("doc_id") - F.coalesce("__p", "__before", F.lit(0))).alias("gap"))


def ungapped(rows: DataFrame) -> DataFrame:
    """(term, position, doc_id) again from (term, position, gap): running sums of the gaps, in two steps over spans of positions."""
    cut = rows.withColumn("__s", F.floor(F.col("position") / _SPAN))
    spans = cut.groupBy("term", "__s").agg(F.sum("gap").alias("__t"))
    spans = spans.select("term", "__s", F.coalesce(F.sum("__t").over(Window.partitionBy("term").orderBy("__s").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("__b"))
    run = F.sum("gap").over(Window.partitionBy("term", "__s").orderBy("position").rowsBetween(Window.unboundedPreceding, 0))
    return cut.withColumn("__r", run).join(spans, ["term", "__s"]).select("term", "position", (F.col("__b") + F.col("__r")).alias("doc_id"))


def bit_length(n: Column) -> Column:
    return F.length(F.bin(n))


def vbyte_bytes(n: Column) -> Column:
    """Bytes of a number in groups of seven bits; 0 takes one."""
    return F.ceil(bit_length(n) / 7).cast("bigint")


def gamma_bits(n: Column) -> Column:
    """Bits of a number from 1 in Elias gamma code."""
    return (2 * bit_length(n) - 1).cast("bigint")


def compressed_sizes(posts: DataFrame) -> DataFrame:
    """(term, df, id_bytes, gap_bytes, freq_bytes, hybrid_bytes): sizes of each list in the codecs, from closed forms."""
    g = gaps(posts)
    to_bytes = lambda bits: F.ceil(bits / 8).cast("bigint")
    per = g.groupBy("term").agg(
        F.count(F.lit(1)).alias("df"), F.sum(vbyte_bytes(F.col("doc_id"))).alias("id_bytes"), F.sum(vbyte_bytes(F.col("gap"))).alias("gap_bytes"), F.sum(gamma_bits(F.col("tf"))).alias("fb")
    )
    return per.select("term", "df", "id_bytes", "gap_bytes", to_bytes(F.col("fb")).alias("freq_bytes"), to_bytes(F.col("gap_bytes") * 8 + F.col("fb")).alias("hybrid_bytes"))


def size_report(sizes: DataFrame) -> DataFrame:
    """(variant, bytes, ratio): totals against the plain layout of eight bytes a posting."""
    t = sizes.agg(F.sum("df").alias("n"), F.sum("id_bytes").alias("i"), F.sum("gap_bytes").alias("g"), F.sum("freq_bytes").alias("f"), F.sum("hybrid_bytes").alias("h"))
    row = lambda name, e: F.struct(F.lit(name).alias("variant"), e.cast("bigint").alias("bytes"), F.round(F.try_divide(e, F.col("n") * 8), 6).alias("ratio"))
    return t.select(F.inline(F.array(row("plain", F.col("n") * 8), row("split", F.col("i") + F.col("f")), row("split_gaps", F.col("g") + F.col("f")), row("hybrid", F.col("h")))))


def index_metrics(docs: DataFrame, vocab: DataFrame, text: str = "text") -> DataFrame:
    """One row: documents, terms, postings, bytes of postings and of text, overhead ratio."""
    t = docs.agg(F.count(F.lit(1)).alias("num_docs"), F.sum(F.octet_length(text)).alias("corpus_bytes"))
    v = vocab.agg(F.count(F.lit(1)).alias("num_terms"), F.sum("df").alias("num_postings"))
    one = lambda c: v.select(c).scalar()
    size = one("num_postings") * 8
    return t.select("num_docs", one("num_terms").alias("num_terms"), one("num_postings").alias("num_postings"), size.alias("index_bytes"), "corpus_bytes", F.round(F.try_divide(size, "corpus_bytes"), 6).alias("overhead"))
