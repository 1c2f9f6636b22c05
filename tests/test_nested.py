"""Problem 1 against plain loops."""

import datetime as dt
import json

from inkwell.operators.delivery import latest_delivery
from inkwell.operators.nested import flatten_layouts, flatten_raw, linked_tables, parse_raw

SCHEMA = (
    "layout_id bigint, tables array<struct<cells:array<struct<row:int,col:int,row_span:int,col_span:int,contents:string,box:array<int>>>>>, "
    "paragraphs array<struct<contents:string,role:string,box:array<int>,score:double>>, "
    "detections array<struct<content:string,points:array<array<int>>,box:array<int>,rec_score:double,det_score:double>>, "
    "figures array<struct<box:array<int>>>, ingested_at timestamp, extra string"
)
T = dt.datetime(2024, 1, 1)


def det(text, points=None):
    return (text, points, None, 0.5, None)


def brute(rows):
    out = set()
    for r in rows:
        for k, t in enumerate(r[1] or []):
            if t is not None:
                out.add((r[0], "table", k, -1))
                out |= {(r[0], "cell", k, j) for j, c in enumerate(t[0] or []) if c is not None}
        out |= {(r[0], "paragraph", k, -1) for k, p in enumerate(r[2] or []) if p is not None}
        for k, d in enumerate(r[3] or []):
            if d is not None:
                out.add((r[0], "detection", k, -1))
                out |= {(r[0], "point", k, j) for j, p in enumerate(d[1] or []) if p is not None}
        out |= {(r[0], "figure", k, -1) for k, f in enumerate(r[4] or []) if f is not None}
    return out


ROWS = [
    (1, [([(1, 1, 1, 1, "a", [0, 0, 1, 1]), None, (1, 2, None, None, None, None)],), None, (None,), ([],)], None, [det("x", [[1, 2], None, [3], []]), None, det(None), det("y", [])], [None, ([1, 2, 3, 4],)], T, "e"),
    (2, None, [("p", None, None, 0.1), None], [], None, T, None),
    (3, None, None, None, None, None, None),
    (4, [], [None], [None, None], [(None,)], T, "x" * 70_000),
]


def keys(df):
    got = [tuple(r) for r in df.select("layout_id", "kind", "parent_no", "child_no").collect()]
    assert len(got) == len(set(got))
    return set(got)


def test_typed(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    assert keys(flatten_layouts(df, payload=False)) == brute(ROWS)
    flat = flatten_layouts(df)
    assert keys(flat) == brute(ROWS)
    t = linked_tables(flat)
    assert {(r.detection_no, r.point_no, r.x, r.y) for r in t["points"].collect()} == {(0, 0, 1, 2), (0, 2, 3, None), (0, 3, None, None)}
    assert [(r.table_no, r.cell_no, r.content, r.box) for r in t["cells"].orderBy("cell_no").collect()] == [(0, 0, "a", [0, 0, 1, 1]), (0, 2, None, None)]
    assert {r.content for r in t["detections"].collect()} == {"x", None, "y"}


def test_empty(spark):
    assert flatten_layouts(spark.createDataFrame([], SCHEMA)).count() == 0
    assert flatten_raw(spark.createDataFrame([], "layout_id bigint, raw string")).count() == 0


def test_large_batches_keep_positions(spark):
    rows = [(i, None, None, [det(str(j), [[j, i]] * (j % 3)) if (i + j) % 5 else None for j in range(i % 7)], None, T, None) for i in range(3000)]
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    flat = flatten_layouts(df)
    assert keys(flat) == brute(rows)
    assert linked_tables(flat)["detections"].where("content <> cast(detection_no as string)").count() == 0
    assert linked_tables(flat)["points"].where("x <> detection_no or y <> layout_id").count() == 0


PAGE = {"detections": [{"content": "a", "points": [{"x": 1, "y": "2"}, None, [3.0, 4]], "box": ["1", 2, 3, 4.7]}, None], "tables": [{"cells": [{"row": "1"}, None]}, {}, None]}
WANT = {("detection", 0, -1), ("point", 0, 0), ("point", 0, 2), ("table", 0, -1), ("table", 1, -1), ("cell", 0, 0)}


def test_raw_wrappings(spark):
    j = json.dumps(PAGE)
    good = [j, "﻿" + j, json.dumps(j), json.dumps([PAGE]), json.dumps({"pages": [PAGE]}), json.dumps({"result": PAGE, "meta": {"dpi": 200}}), json.dumps(json.dumps([PAGE]))]
    bad = [None, "", "null", "[]", "{}", j[:-5], json.dumps(j)[:-9], "7", '"x"']
    df = spark.createDataFrame([(i, r, "clash") for i, r in enumerate(good + bad)], "layout_id bigint, raw string, kind string")
    flat = flatten_raw(df, rows=3)
    got = keys(flat)
    for i in range(len(good)):
        assert {k[1:] for k in got if k[0] == i} == WANT, i
    assert {k[0] for k in got} == set(range(len(good)))
    pt = {(r.x, r.y) for r in flat.where("kind = 'point'").collect()}
    assert pt == {(1, 2), (3, 4)}
    assert flat.where("kind = 'detection'").first().box == [1, 2, 3, 4]


def test_wrapped_arrays():
    n = lambda **k: {a: len(v) for a, v in parse_raw(json.dumps(k)).items() if v}
    assert n(detections='[{"content": "a"}, null]', figures={"items": [{"box": [1]}, {"box": [2]}]}) == {"detections": 2, "figures": 2}
    assert n(tables={"cells": [{"row": 1}]}, paragraphs={"0": {"contents": "a"}, "1": None}) == {"tables": 1, "paragraphs": 2}
    assert n(tables="oops", detections=5, figures=[{}]) == {"figures": 1}
    assert parse_raw(json.dumps({"data": json.dumps({"figures": [{}]}), "note": "text"}))["figures"] == [{"box": None}]


def test_several_pages_are_strung_together():
    two = parse_raw(json.dumps([PAGE, PAGE]))
    assert [d and d["content"] for d in two["detections"]] == ["a", None, "a", None]


def test_latest_delivery(spark):
    rows = [(1, 1, "old"), (1, 2, "new"), (2, 1, "only"), (None, 1, "n1"), (None, 1, "n2"), (3, None, "z"), (3, 0, "dated"), (4, 5, "b"), (4, 5, "a")]
    df = spark.createDataFrame(rows, "k int, o int, v string")
    assert sorted(r.v for r in latest_delivery(df, "k", "o", "v").collect()) == ["a", "dated", "n1", "n2", "new", "only"]


def test_pages_at_any_depth_and_beside_arrays():
    from inkwell.operators import nested as N

    page = {"detections": [{"content": "a"}]}
    deep = page
    for k in range(20):
        deep = [deep] if k % 2 else {"result": deep}
    assert N.pages_of(deep) == [page]
    mixed = {"figures": [], "result": page, "more": json.dumps([{"tables": []}])}
    assert N.pages_of(mixed) == [mixed, page, {"tables": []}]
