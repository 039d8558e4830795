"""Queries of the subpackage against their SQL on the smallest tables."""

from __future__ import annotations

import pytest
from parity import connect, difference

from tamiz.llm import queries as q


@pytest.fixture(scope="module")
def con(small):
    return connect(small)


@pytest.mark.parametrize("name", [k for k in q.QUERIES if k in q.SQL])
def test_equal(spark, con, small, name):
    assert difference(spark, con, small, q.QUERIES[name], q.SQL[name]) == ""


@pytest.mark.parametrize(("name", "columns"), [("p1_found", ["rec_no", "line_no"]), ("p4_found", ["rec_no_a", "rec_no_b"]), ("p8_ids", ["doc_id", "ids"]), ("p10_found", ["doc_id", "kind", "pii_text"]), ("p9_shares", None), ("p9_mixture", None), ("p4_groups", None), ("p1_bodies", None), ("p10_redacted", None), ("p8_token_counts", None)])
def test_runs(spark, small, name, columns):
    df = q.QUERIES[name](spark, small)
    assert df.count() > 0 and (columns is None or df.columns == columns)


def test_nothing_else_imports_the_subpackage():
    from pathlib import Path

    import tamiz

    root = Path(tamiz.__file__).parent
    for p in root.rglob("*.py"):
        if "llm" not in p.relative_to(root).parts:
            assert "tamiz.llm" not in p.read_text(), p
