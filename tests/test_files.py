"""File sources, sinks and the incremental index."""

from __future__ import annotations

from conftest import rows
from pyspark.sql import functions as F

from tamiz.operators import stats
from tamiz.sources import files, sinks
from tamiz.streaming import postings as stream


def _write(folder, **texts):
    folder.mkdir(parents=True, exist_ok=True)
    for name, t in texts.items():
        (folder / name.replace("_", ".")).write_bytes(t if isinstance(t, bytes) else t.encode())
    return str(folder)


def test_texts(spark, tmp_path):
    d = _write(tmp_path / "c", a_txt="uno", b_TXT="dos")
    _write(tmp_path / "c" / "sub", a_txt="tres")
    assert [r[0] for r in rows(files.texts(spark, d), "text")] == ["tres", "uno"]
    assert len(rows(files.texts(spark, d, None))) == 3
    assert [r[0] for r in rows(files.texts(spark, d, distinct_names=True), "text")] == ["uno"]
    assert [r[0] for r in rows(files.numbered(files.texts(spark, d)), "doc_id")] == [0, 1]


def test_trec(spark, tmp_path):
    d = _write(tmp_path / "t", x_sgm="<DOC><DOCNO> A1 </DOCNO><p>hola</p></DOC>\n<DOC>sin</DOC><DOC>\n<docno>B2</docno> fin</DOC>")
    f = files.texts(spark, d, None)
    assert rows(files.trec(f)) == [("A1", "<p>hola</p>"), ("B2", "fin")]
    kept = rows(files.trec(f, keep_docno=True))
    assert len(kept) == 3 and "A1" in kept[1][1] and "<" not in kept[1][1]


def test_topics_and_qrels(spark, tmp_path):
    t = _write(tmp_path / "q", t_xml="<top><num> Number: 12 </num><title> dos\n palabras </title></top><top><num>13</num></top><top><num>14</num><title>x</title></top>")
    assert rows(files.topics(files.texts(spark, t, None))) == [("12", "dos palabras"), ("14", "x")]
    assert rows(files.topics(files.texts(spark, t, None), 1)) == [("12", "dos palabras")]
    q = _write(tmp_path / "r", q_txt="12 0 A 1\n12 0 B 0\nbad line\n13 0 C 2 extra\n12 0 D x\n")
    assert rows(files.qrels(spark, q)) == [("12", "A", 1), ("12", "B", 0), ("13", "C", 2)]
    valid = spark.createDataFrame([("12",)], "qid string")
    assert rows(files.qrels(spark, q, graded=False, valid=valid)) == [("12", "A", 1)]


def test_query_files_and_stop_words(spark, tmp_path):
    d = _write(tmp_path / "n", n_txt="1:Hola  Mundo\n\n2:x\n")
    assert rows(files.numbered_queries(spark, d)) == [("1", ["hola", "mundo"]), ("2", ["x"])]
    assert rows(files.plain_queries(spark, d))[0] == ("1:Hola  Mundo",)
    s = _write(tmp_path / "s", s_txt="Año, de\nla")
    assert [r[0] for r in rows(files.stop_words(spark, s))] == ["a", "de", "la", "o"]


def test_language_files(spark, tmp_path):
    d = _write(tmp_path / "l", es_txt="ñandú".encode("latin-1"), en_txt=b"house")
    assert rows(files.language_texts(spark, d)) == [("en", "house"), ("es", "ñandú")]
    assert rows(files.language_lines(spark, d + "/es.txt")) == [(1, "ñandú")]


def test_measures(spark, tmp_path):
    d = _write(tmp_path / "m", m_csv="qid,measure,value\n1,AP,0.5\n1,P,0.1\n2,AP,0.25\n")
    assert rows(files.measures(spark, d)) == [("1", 0.5), ("2", 0.25)]


def test_sinks(spark, tmp_path):
    df = spark.createDataFrame([(1, "b a a"), (2, "b c")], "doc_id bigint, text string")
    p = stats.postings(stats.occurrences(df))
    sinks.term_list(stats.vocabulary(p), str(tmp_path / "terms"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "terms")).orderBy("value").collect()] == ["a 2 1", "b 2 2", "c 1 1"]
    sinks.statistics(stats.summary(df, p), str(tmp_path / "s"))
    assert [r[0] for r in spark.read.text(str(tmp_path / "s")).collect()] == ["2", "5", "2.5", "1.0", "2 3", "1"]
    sinks.frequencies(stats.vocabulary(p), str(tmp_path / "f"), 2)
    assert [r[0] for r in spark.read.text(str(tmp_path / "f")).collect()] == ["b 2", "a 2", "c 1", "a 2"]
    run = spark.createDataFrame([("1", "x", 1), ("2", "y", 1)], "qid string, docno string, rank int")
    sinks.per_query(run, str(tmp_path / "run"))
    assert {p.name for p in (tmp_path / "run").iterdir() if p.is_dir()} == {"qid=1", "qid=2"}
    sinks.graph(run, run, str(tmp_path / "g"))
    assert sinks.load_graph(spark, str(tmp_path / "g"))[0].count() == 2


def test_incremental_postings(spark, tmp_path):
    a, b = [(1, "x y"), (2, "x")], [(3, "y y")]
    src, out = str(tmp_path / "in"), str(tmp_path / "ix")
    for part in (a, b):
        spark.createDataFrame(part, "doc_id bigint, text string").write.mode("append").parquet(src)
        docs = spark.readStream.schema("doc_id bigint, text string").parquet(src)
        stream.append_postings(docs, out, str(tmp_path / "cp")).trigger(availableNow=True).start().awaitTermination()
    assert rows(stream.read_vocabulary(spark, out)) == [("x", 2, 2), ("y", 3, 2)]


def test_windowed_counts(spark):
    e = spark.createDataFrame([("2024-01-01 00:10:00", "a", 1.0), ("2024-01-01 00:50:00", "a", 2.0), ("2024-01-01 01:00:00", "a", 4.0)], "t string, k string, v double").withColumn("t", F.col("t").cast("timestamp"))
    assert [r[2:] for r in rows(stream.windowed_counts(e, "t", "k", "v"))] == [(2, 3.0), (1, 4.0)]


def test_blocks_of_large_files(spark, tmp_path):
    (tmp_path / "c").mkdir()
    (tmp_path / "c" / "x.trec").write_text("<DOC><DOCNO> A1 </DOCNO>uno\ndos</DOC>\n<DOC><DOCNO>B2</DOCNO>tres</DOC>\n")
    (tmp_path / "c" / "y.HTML").write_text("x")
    assert rows(files.trec(files.blocks(spark, str(tmp_path / "c")))) == [("A1", "uno\ndos"), ("B2", "tres")]
    assert files.count_files(spark, str(tmp_path / "c")) == 1


def test_human_bytes(spark):
    from pyspark.sql import functions as F

    got = spark.createDataFrame([(0,), (1023,), (1536,), (5 << 20,), (3 << 40,)], "n bigint").select(sinks.human_bytes(F.col("n"))).collect()
    assert [r[0] for r in got] == ["0.0 B", "1023.0 B", "1.5 KB", "5.0 MB", "3.0 TB"]
