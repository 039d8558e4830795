"""Heavy lists and orphan references: edge cases."""

from __future__ import annotations

from datetime import datetime as D

import pytest
from conftest import rows
from pyspark.sql import functions as F

from tamiz.operators import references as ref
from tamiz.operators import skew

POST = "index_no int, term_id bigint, docid bigint, freq bigint, n string"


def test_list_lengths_nulls_repeats_and_foreign_columns(spark):
    df = spark.createDataFrame([(0, 1, 5, 1, "a"), (0, 1, 5, 1, "a"), (0, 1, 6, None, None), (0, None, 7, 1, "x"), (0, 2, None, 1, "x"), (None, 2, 1, 1, ""), (1, 1, 5, 2, "")], POST)
    assert rows(skew.list_lengths(df)) == [(0, 1, 2), (1, 1, 1)]


def test_list_lengths_of_nothing(spark):
    df = spark.createDataFrame([], POST)
    assert rows(skew.list_lengths(df)) == [] and rows(skew.heavy_lists(df)) == []


def test_one_key_holds_nearly_all(spark):
    df = spark.range(30_000).select(F.lit(0).alias("index_no"), F.when(F.col("id") % 10 == 0, F.col("id") % 100).otherwise(7).cast("bigint").alias("term_id"), (F.col("id") % 9_000).alias("docid"))
    want = rows(df.groupBy("index_no", "term_id").agg(F.countDistinct("docid")))
    assert rows(skew.list_lengths(df)) == want
    parts = skew.distinct_counts(df, ["index_no", "term_id"], ["docid"], partitions=8)
    assert rows(parts) == want


def test_heavy_share_is_inclusive(spark):
    df = spark.createDataFrame([(0, 1 if i < 2 else 100 + i, i, 1, "") for i in range(100)], POST)
    assert rows(skew.heavy_lists(df), "term_id", "length", "index_postings") == [(1, 2, 100)]


def test_name_clash_is_refused(spark):
    df = spark.createDataFrame([(0, 1, 5, 1, "a")], POST)
    with pytest.raises(ValueError):
        skew.distinct_counts(df, ["index_no"], ["docid"], "docid")


def test_length_audit_states(spark):
    post = spark.createDataFrame([(0, 1, 1, 1, ""), (0, 2, 1, 1, ""), (0, 2, 2, 1, ""), (0, 3, 1, 1, ""), (0, 4, 9, 1, "")], POST)
    stored = spark.createDataFrame([(0, 1, 1), (0, 1, 1), (0, 2, 5), (0, 3, None), (0, 9, 4), (None, 1, 1)], "index_no int, term_id bigint, length bigint")
    assert rows(skew.length_audit(post, stored), "term_id", "length", "state") == [(1, 1, "equal"), (2, 2, "stale"), (3, 1, "no length"), (4, 1, "unlisted"), (9, 0, "no postings")]


REFS = "judgment_id bigint, qid string, docno string, judged_at timestamp_ntz, status string"
PAR = "docno string, read_at timestamp_ntz, removed_at timestamp_ntz"


def _resolve(spark, refs, parents):
    r = ref.references(spark.createDataFrame(refs, REFS), "judgment_id", "judged_at", ["docno"])
    return {x[0]: x[1] for x in rows(ref.resolve(r, ref.parents({"docno": (spark.createDataFrame(parents, PAR), "docno")}, "read_at", "removed_at")), "id", "status")}


def test_reference_states(spark):
    t = lambda d: D(2024, 1, d)
    parents = [("A", t(5), None), ("B", t(2), t(4)), ("B", t(8), t(9)), ("C", t(20), None), (None, t(1), None), ("D", None, None), ("E", t(3), t(3))]
    refs = [
        (1, "q", "A", t(5), "x"), (2, "q", " A\t", t(6), "x"), (3, "q", "A", t(4), "x"), (4, "q", "B", t(4), "x"), (5, "q", "B", t(3), "x"), (6, "q", "B", t(8), "x"), (7, "q", "B", t(10), "x"),
        (8, "q", "C", t(10), "x"), (9, "q", "Z", t(10), "x"), (10, "q", None, t(10), "x"), (11, "q", " \t ", t(10), "x"), (12, "q", "A", None, "x"), (13, "q", "D", t(10), "x"), (14, "q", "a", t(10), "x"), (15, "q", "E", t(3), "x"),
    ]
    want = {1: "living", 2: "living", 3: "late", 4: "deleted", 5: "living", 6: "living", 7: "deleted", 8: "late", 9: "missing", 12: "late", 13: "missing", 14: "missing", 15: "deleted"}
    assert _resolve(spark, refs, parents) == want


def test_references_against_nothing(spark):
    assert _resolve(spark, [(1, "q", "A", D(2024, 1, 1), None)], []) == {1: "missing"}
    assert _resolve(spark, [], [("A", D(2024, 1, 1), None)]) == {}


def test_hot_reference_key(spark):
    refs = [(i, "q", "A" if i % 3 else f"K{i}", D(2024, 1, 1 + i % 20), "") for i in range(3000)]
    got = _resolve(spark, refs, [("A", D(2024, 1, 5), D(2024, 1, 10)), ("A", D(2024, 1, 15), None)])
    for i, _, k, at, _ in refs:
        day = at.day
        assert got[i] == ("missing" if k != "A" else "living" if 5 <= day < 10 or day >= 15 else "late" if day < 5 else "deleted")


def test_report_by_month(spark):
    refs = ref.references(spark.createDataFrame([(1, "q", "Z", D(2024, 1, 3), ""), (2, "q", "Z", D(2024, 2, 3), ""), (3, "q", "Y", D(2024, 2, 4), "")], REFS), "judgment_id", "judged_at", ["docno"])
    known = ref.parents({"docno": (spark.createDataFrame([("Y", D(2024, 5, 1), None)], PAR), "docno")}, "read_at", "removed_at")
    assert rows(ref.orphan_report(refs, known)) == [("docno", "2024-01", 1, 0, 0, 1), ("docno", "2024-02", 1, 0, 1, 2)]
