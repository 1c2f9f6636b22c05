"""The catalogue, with and without the subpackage for training text."""

import importlib
import os
import sys

import duckdb
import pytest

D = "/root/testdata/sf0.001"


def test_entry_points():
    e = importlib.import_module("__spark_entry__")
    q, s = e.queries(), e.oracle_sql()
    assert set(s) <= set(q) and len(q) > 130 and len(set(q) - set(s)) < 25
    assert all(n in q for n in ("p1_found", "p3_found"))


def test_without_subpackage(monkeypatch):
    e = importlib.import_module("__spark_entry__")
    monkeypatch.setitem(sys.modules, "inkwell.llm", None)
    monkeypatch.setitem(sys.modules, "inkwell.llm.queries", None)
    monkeypatch.delattr("inkwell.llm", raising=False)
    assert "p1_found" in e.queries() and "p2_found" not in e.queries() and "p6_decoded" not in e.oracle_sql()


@pytest.mark.skipif(not os.path.exists(D), reason="no test data")
@pytest.mark.parametrize("name", ["math_issue_lines", "table_segments", "plain_text", "top_regions", "job_progress", "merged_sections", "segment_headers", "workbook_facts", "line_links", "refined_pages", "document_tables", "log_shapes", "layout_csv", "p1_typed", "p3_compacted"])
def test_against_sql(spark, name):
    e = importlib.import_module("__spark_entry__")
    con = duckdb.connect()
    for f in os.listdir(D):
        con.sql(f"CREATE VIEW {f.split('.')[0]} AS SELECT * FROM '{D}/{f}'")
    rel = con.sql(e.oracle_sql()[name])
    cols = sorted(rel.columns)
    want = sorted(str(tuple(dict(zip(rel.columns, r))[c] for c in cols)) for r in rel.fetchall())
    got = sorted(str(tuple(r[c] for c in cols)) for r in e.queries()[name](spark, D).collect())
    assert got == want
