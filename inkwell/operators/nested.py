"""Problem 1: deeply nested page records into flat, linked tables.

A batch is flattened in Arrow buffers: list lengths give the offsets, ``list_parent_indices`` the parent of
each child, and the keys follow by a vectorised ``take``. No row is looked at in Python, except that raw JSON
texts must be parsed once; what they hold then goes through the same kernels.

Results for odd input:
  * null or empty arrays give no rows; null elements give no row but keep their position;
  * a null detection has no points, a null table no cells;
  * raw texts that are null, empty or no complete JSON give no rows; a byte-order mark is ignored;
  * JSON inside JSON strings, lists of pages and wrapping objects are unwrapped; the arrays of several
    pages in one record are strung together in their order;
  * a number written as a string, or as a float, is read as a number; what is no number is null;
  * other columns of the input are ignored.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

ARRAYS = ("tables", "paragraphs", "detections", "figures")

_BOX = pa.list_(pa.int32())
LAYOUT = pa.schema(
    [
        ("layout_id", pa.int64()),
        ("tables", pa.list_(pa.struct([("cells", pa.list_(pa.struct([("row", pa.int32()), ("col", pa.int32()), ("row_span", pa.int32()), ("col_span", pa.int32()), ("contents", pa.string()), ("box", _BOX)])))]))),
        ("paragraphs", pa.list_(pa.struct([("contents", pa.string()), ("role", pa.string()), ("box", _BOX), ("score", pa.float64())]))),
        ("detections", pa.list_(pa.struct([("content", pa.string()), ("points", pa.list_(pa.list_(pa.int32()))), ("box", _BOX), ("rec_score", pa.float64()), ("det_score", pa.float64())]))),
        ("figures", pa.list_(pa.struct([("box", _BOX)]))),
    ]
)

KEYS = pa.schema([("layout_id", pa.int64()), ("kind", pa.string()), ("parent_no", pa.int32()), ("child_no", pa.int32())])
#: Columns beside the keys, by kind: output name -> field of the element.
PAYLOAD = {
    "detection": {"content": "content", "box": "box", "rec_score": "rec_score", "det_score": "det_score"},
    "paragraph": {"content": "contents", "role": "role", "box": "box", "score": "score"},
    "table": {},
    "figure": {"box": "box"},
    "cell": {"content": "contents", "row": "row", "col": "col", "row_span": "row_span", "col_span": "col_span", "box": "box"},
    "point": {},
}
FLAT = pa.schema(
    [*KEYS, ("content", pa.string()), ("role", pa.string()), ("box", _BOX), ("row", pa.int32()), ("col", pa.int32()), ("row_span", pa.int32()), ("col_span", pa.int32()),
     ("score", pa.float64()), ("rec_score", pa.float64()), ("det_score", pa.float64()), ("x", pa.int32()), ("y", pa.int32())]
)

KEYS_DDL = "layout_id bigint, kind string, parent_no int, child_no int"
FLAT_DDL = KEYS_DDL + (
    ", content string, role string, box array<int>, row int, col int, row_span int, col_span int, score double, rec_score double, det_score double, x int, y int"
)


def children(lists: pa.Array) -> tuple[np.ndarray, np.ndarray, pa.Array]:
    """Of a list array: each child's parent index, its position in its list, and the child values."""
    size = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
    start = np.cumsum(size) - size
    parent = np.asarray(pc.list_parent_indices(lists), dtype=np.int64)
    return parent, np.arange(len(parent)) - start[parent], pc.list_flatten(lists)


def _field(values: pa.Array, name: str) -> pa.Array:
    return pc.struct_field(values, [name])  # a null struct gives a null field


def _emit(kind: str, key: pa.Array, at: np.ndarray, parent_no: np.ndarray, child_no: np.ndarray, values: pa.Array, payload: bool) -> pa.RecordBatch:
    keep = np.asarray(pc.is_valid(values), dtype=bool)
    sel = pa.array(np.flatnonzero(keep))
    n = len(sel)
    cols = [key.take(pa.array(at[keep])), pa.array([kind]).take(pa.array(np.zeros(n, dtype=np.int64))), pa.array(parent_no[keep].astype(np.int32)), pa.array(child_no[keep].astype(np.int32))]
    if not payload:
        return pa.RecordBatch.from_arrays(cols, schema=KEYS)
    live = values.take(sel)
    for f in list(FLAT)[4:]:
        if kind == "point" and f.name in ("x", "y"):
            k = "xy".index(f.name)
            long = np.asarray(pc.fill_null(pc.list_value_length(live), 0)) > k
            got = pc.list_element(live.filter(pa.array(long)), k) if long.any() else pa.array([], pa.int32())
            where = pa.array(np.where(long, np.cumsum(long) - 1, 0), mask=~long)
            cols.append(got.take(where).cast(f.type))
        elif f.name in PAYLOAD[kind]:
            cols.append(_field(live, PAYLOAD[kind][f.name]).cast(f.type))
        else:
            cols.append(pa.nulls(n, f.type))
    return pa.RecordBatch.from_arrays(cols, schema=FLAT)


def flatten_batch(batch: pa.RecordBatch, payload: bool) -> Iterator[pa.RecordBatch]:
    """All elements of the four arrays of a batch, and the points and cells below them."""
    key = batch.column("layout_id")
    for kind, array, below in (("detection", "detections", ("point", "points")), ("paragraph", "paragraphs", None), ("table", "tables", ("cell", "cells")), ("figure", "figures", None)):
        at, no, values = children(batch.column(array))
        yield _emit(kind, key, at, no, np.full(len(no), -1), values, payload)
        if below:
            parent, child, leaf = children(_field(values, below[1]))
            yield _emit(below[0], key, at[parent], no[parent], child, leaf, payload)


def flatten_layouts(layouts: DataFrame, payload: bool = True) -> DataFrame:
    """Typed records (``layout_id`` and the four arrays) into one tall table of elements."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield from flatten_batch(b, payload)

    return layouts.select("layout_id", *ARRAYS).mapInArrow(run, FLAT_DDL if payload else KEYS_DDL)


# ---- raw JSON


def pages_of(x: object) -> list[dict]:
    """The page objects in a parsed JSON value, however wrapped and however deep; also those beside the arrays of another."""
    found, rest = [], [x]
    while rest:
        x = rest.pop()
        if isinstance(x, str):
            try:
                rest.append(json.loads(x.lstrip("\ufeff")))
            except (ValueError, RecursionError):
                pass
        elif isinstance(x, list):
            rest += [y for y in reversed(x) if isinstance(y, dict | list | str)]
        elif isinstance(x, dict):
            if any(k in x for k in ARRAYS):
                found.append(x)
            inner = [y for k, y in x.items() if k not in ARRAYS]
            rest += [y for y in reversed(inner) if isinstance(y, dict | list) or isinstance(y, str) and y.lstrip("\ufeff \n\t\r")[:1] in ("{", "[")]
    return found


# Fields by which a lone element is told from a wrapping object.
_OWN = {"tables": ("cells",), "paragraphs": ("contents", "role"), "detections": ("content", "points", "det_score", "rec_score"), "figures": ("box",)}


def elements_of(array: str, x: object) -> list:
    """The elements of one of the arrays, if it is JSON text, wrapped in an object, numbered by keys, or one element."""
    if isinstance(x, str):
        try:
            return elements_of(array, json.loads(x))
        except ValueError:
            return []
    if isinstance(x, dict):
        if any(k in x for k in _OWN[array]):
            return [x]
        inner = list(x.values())
        return elements_of(array, inner[0]) if len(inner) == 1 and isinstance(inner[0], list) else inner
    return x if isinstance(x, list) else []


def _int(x: object) -> int | None:
    try:
        v = int(float(x)) if x is not None and not isinstance(x, bool) else None  # type: ignore[arg-type]
    except (TypeError, ValueError, OverflowError):
        return None
    return v if v is not None and -(2**31) <= v < 2**31 else None


def _float(x: object) -> float | None:
    try:
        return float(x) if x is not None and not isinstance(x, bool) else None  # type: ignore[arg-type]
    except (TypeError, ValueError):
        return None


def _str(x: object) -> str | None:
    if x is None or isinstance(x, str):
        return x if x is None else x.encode("utf-8", "replace").decode("utf-8")
    return json.dumps(x, ensure_ascii=False)


def _list(x: object) -> list:
    return x if isinstance(x, list) else list(x.values()) if isinstance(x, dict) else []


def _ints(x: object) -> list[int | None] | None:
    return None if x is None else [_int(v) for v in _list(x)]


def _point(x: object) -> list[int | None] | None:
    if x is None:
        return None
    return [_int(x.get("x")), _int(x.get("y"))] if isinstance(x, dict) and "x" in x else [_int(v) for v in _list(x)]


def _obj(x: object, text: str) -> dict:
    """An element that is no object stands for its text."""
    return x if isinstance(x, dict) else {text: x}


def _cell(x: object) -> dict | None:
    if x is None:
        return None
    o = _obj(x, "contents")
    return {k: _int(o.get(k)) for k in ("row", "col", "row_span", "col_span")} | {"contents": _str(o.get("contents")), "box": _ints(o.get("box"))}


def _table(x: object) -> dict | None:
    if x is None:
        return None
    cells = x.get("cells") if isinstance(x, dict) else x
    return {"cells": None if cells is None else [_cell(c) for c in _list(cells)]}


def _paragraph(x: object) -> dict | None:
    if x is None:
        return None
    o = _obj(x, "contents")
    return {"contents": _str(o.get("contents")), "role": _str(o.get("role")), "box": _ints(o.get("box")), "score": _float(o.get("score"))}


def _detection(x: object) -> dict | None:
    if x is None:
        return None
    o = _obj(x, "content")
    pts = o.get("points")
    return {"content": _str(o.get("content")), "points": None if pts is None else [_point(p) for p in _list(pts)], "box": _ints(o.get("box")), "rec_score": _float(o.get("rec_score")), "det_score": _float(o.get("det_score"))}


def _figure(x: object) -> dict | None:
    return None if x is None else {"box": _ints(_obj(x, "box").get("box"))}


_ONE = {"tables": _table, "paragraphs": _paragraph, "detections": _detection, "figures": _figure}


def parse_raw(text: str | None) -> dict | None:
    """One raw record as the four typed arrays, or None."""
    if not text:
        return None
    try:
        value = json.loads(text.lstrip("﻿"))
    except (ValueError, RecursionError):
        return None
    pages = pages_of(value)
    return {a: [_ONE[a](e) for p in pages for e in elements_of(a, p.get(a))] for a in ARRAYS} if pages else None


def flatten_raw(raw: DataFrame, payload: bool = True, rows: int = 512) -> DataFrame:
    """Raw records (``layout_id`` and JSON text ``raw``) into the same tall table."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, texts = b.column("layout_id").to_pylist(), b.column("raw").to_pylist()
            for k in range(0, len(ids), rows):
                got = [{"layout_id": i} | p for i, t in zip(ids[k : k + rows], texts[k : k + rows]) if (p := parse_raw(t))]
                if got:
                    for x in pa.Table.from_pylist(got, schema=LAYOUT).combine_chunks().to_batches():
                        yield from flatten_batch(x, payload)

    return raw.select("layout_id", "raw").mapInArrow(run, FLAT_DDL if payload else KEYS_DDL)


def linked_tables(elements: DataFrame) -> dict[str, DataFrame]:
    """The related flat tables. ``detection_no`` and ``table_no`` link points and cells to their parents."""
    link = {"point": "detection_no", "cell": "table_no"}
    out = {}
    for kind, cols in PAYLOAD.items():
        keys = [F.col("parent_no").alias(link.get(kind, f"{kind}_no"))] + ([F.col("child_no").alias(f"{kind}_no")] if kind in link else [])
        out[f"{kind}s"] = elements.where(F.col("kind") == kind).select("layout_id", *keys, *(("x", "y") if kind == "point" else cols))
    return out
