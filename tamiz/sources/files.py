"""File sources: plain texts, TREC collections, topics, judgements, queries, stop words."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def texts(spark: SparkSession, path: str, glob: str | None = "*.txt", encoding: str = "UTF-8", distinct_names: bool = False) -> DataFrame:
    """(path, name, text) of the files under a folder, or of one file.

    ``glob``: names to take (None: all).  ``distinct_names``: of files of one name the first by path.
    Unreadable files are skipped.
    """
    reader = spark.read.option("recursiveFileLookup", "true").option("ignoreCorruptFiles", "true")
    if glob:
        reader = reader.option("pathGlobFilter", glob)
    raw = reader.format("binaryFile").load(path).select("path", F.regexp_extract("path", r"[^/]*$", 0).alias("name"), F.decode("content", encoding).alias("text"))
    if not distinct_names:
        return raw
    first = raw.groupBy("name").agg(F.min("path").alias("path"))
    return raw.join(first, ["name", "path"]).select("path", "name", "text")


def numbered(files: DataFrame) -> DataFrame:
    """(doc_id, name, text), ids from 0 in order of path.

    The order is found over paths only, which are few and small beside the texts.
    """
    ids = files.select("path").withColumn("doc_id", F.row_number().over(Window.orderBy("path")).cast("bigint") - 1)
    return files.join(ids, "path").select("doc_id", "name", "text")


def count_files(spark: SparkSession, path: str, suffix: str = ".html") -> int:
    """Files under a folder whose name ends in ``suffix``, whatever its case; contents are not read."""
    names = spark.read.option("recursiveFileLookup", "true").format("binaryFile").load(path).select("path")
    return names.where(F.lower("path").endswith(suffix)).count()


def blocks(spark: SparkSession, path: str, end: str = "</DOC>") -> DataFrame:
    """(text) of the records of large files, cut behind ``end``: a file of any size is many rows and many tasks.

    ``trec`` and ``topics`` (with ``end="</top>"``) read these rows as they read files.
    """
    rows = spark.read.option("lineSep", end).option("recursiveFileLookup", "true").text(path)
    return rows.select(F.concat("value", F.lit(end)).alias("text"))


def trec(files: DataFrame, keep_docno: bool = False) -> DataFrame:
    """(docno, text) of ``<DOC>`` blocks.

    ``keep_docno``: blocks without a DOCNO stay (null) and all tags become blanks, the number remaining in
    the text; else such blocks are skipped and only the DOCNO element is taken out.
    """
    docs = files.select(F.explode(F.regexp_extract_all("text", F.lit(r"(?is)<DOC>(.*?)</DOC>"), F.lit(1))).alias("b"))
    no = F.nullif(F.trim(F.regexp_extract("b", r"(?is)<DOCNO>(.*?)</DOCNO>", 1)), F.lit(""))
    if keep_docno:
        return docs.select(no.alias("docno"), F.regexp_replace("b", r"<[^>]+>", " ").alias("text"))
    return docs.select(no.alias("docno"), F.regexp_replace(F.regexp_replace("b", r"(?is)<DOCNO>.*?</DOCNO>", ""), r"^\s+|\s+$", "").alias("text")).where("docno is not null")


def topics(files: DataFrame, most: int | None = None) -> DataFrame:
    """(qid, query) of ``<top>`` blocks with a number and a title."""
    t = files.select(F.posexplode(F.regexp_extract_all("text", F.lit(r"(?is)<top>(.*?)</top>"), F.lit(1))).alias("i", "b"))
    t = t.select("i", F.regexp_extract("b", r"(?is)<num>[^0-9]*([0-9]+)", 1).alias("qid"), F.trim(F.regexp_replace(F.regexp_extract("b", r"(?is)<title>(.*?)(?:</title>|<|$)", 1), r"\s+", " ")).alias("query"))
    t = t.where("qid <> '' and query <> ''")
    return (t if most is None else t.orderBy("i").limit(most)).select("qid", "query")


def qrels(spark: SparkSession, path: str, graded: bool = True, valid: DataFrame | None = None) -> DataFrame:
    """(qid, docno, label) of lines of at least four fields; not ``graded``: labels over 0 only; ``valid``: column qid."""
    f = F.split(F.trim("value"), r"\s+")
    rows = spark.read.text(path).where(F.size(f) >= 4).select(f[0].alias("qid"), f[2].alias("docno"), f[3].try_cast("int").alias("label"))
    rows = rows.where("label is not null") if graded else rows.where("label > 0")
    return rows if valid is None else rows.join(valid.select("qid").distinct(), "qid", "left_semi")


def numbered_queries(spark: SparkSession, path: str) -> DataFrame:
    """(qid, words) of lines ``N:text``, lower-cased."""
    v = spark.read.text(path).where(F.trim("value") != "")
    return v.select(F.regexp_extract("value", r"^(\d+):", 1).alias("qid"), F.split(F.trim(F.lower(F.regexp_replace("value", r"^\d+:", ""))), r"\s+").alias("words"))


def plain_queries(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.trim("value").alias("query")).where("query <> ''")


def stop_words(spark: SparkSession, path: str, pattern: str = r"[a-z]+") -> DataFrame:
    """(term) of a free text; the default pattern splits at accents."""
    return spark.read.text(path).select(F.explode(F.regexp_extract_all(F.lower("value"), F.lit(pattern), F.lit(0))).alias("term")).distinct()


def language_texts(spark: SparkSession, path: str) -> DataFrame:
    """(lang, text) of Latin-1 files whose stem is the language; of one stem the last by path."""
    f = texts(spark, path, None, "ISO-8859-1").withColumn("lang", F.regexp_replace("name", r"\.[^.]*$", ""))
    return f.groupBy("lang").agg(F.max_by("text", "path").alias("text"))


def language_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line_num, line) of a Latin-1 file of cases."""
    one = texts(spark, path, None, "ISO-8859-1").select(F.posexplode(F.split("text", r"\r?\n")).alias("i", "line"))
    return one.select((F.col("i") + 1).alias("line_num"), "line").where("line <> ''")


def measures(spark: SparkSession, path: str, measure: str = "AP") -> DataFrame:
    """(qid, value) of one measure of a per-query CSV."""
    rows = spark.read.option("header", "true").csv(path)
    return rows.where(F.col("measure") == measure).select("qid", F.col("value").cast("double").alias("value"))
