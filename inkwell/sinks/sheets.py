"""Tables and texts as the sheets of workbooks, for ``office.workbooks``.

A workbook gets at most ``per_book`` sheets; a document that has more becomes several volumes, so that no document has to
fit into one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import table_name, typed_value
from ..functions.text import plain_text
from ..operators import tables as T
from ..operators.ranks import numbered
from .office import SHEETS

ROW = "array<struct<i:bigint,d:double,dt:date,s:string,fmt:string>>"


def _typed(v: Column) -> Column:
    t = typed_value(v)
    return F.struct(t["i"].alias("i"), t["d"].alias("d"), t["dt"].alias("dt"), v.alias("s"), t["fmt"].alias("fmt"))


def _plain(v: Column) -> Column:
    null = lambda t: F.lit(None).cast(t)
    return F.struct(null("bigint").alias("i"), null("double").alias("d"), null("date").alias("dt"), v.alias("s"), null("string").alias("fmt"))


def _volumes(sheets: DataFrame, doc: str, order: str, per_book: int) -> DataFrame:
    """(file, sheets) from rows of (doc, order, sheet)."""
    volume = F.floor((F.col(order) - 1) / per_book).cast("int")
    name = F.concat(F.col(doc), F.when(F.col("__v") == 0, "").otherwise(F.concat(F.lit("_"), (F.col("__v") + 1).cast("string"))), F.lit(".xlsx"))
    per = sheets.withColumn("__v", volume).groupBy(doc, "__v").agg(F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), "sheet"))).alias("s"))
    return per.select(name.alias("file"), F.transform("s", lambda x: x["sheet"]).cast(SHEETS).alias("sheets"))


def segment_sheets(named: DataFrame, review: bool = True, typed: bool = True, per_book: int = 200, doc: str = "doc_id") -> DataFrame:
    """SNK-06: from ``tables.sheets``: one sheet per segment, a table each, with a review column (SNK-09)."""
    one = _typed if typed else _plain
    header = F.transform("header", _plain)
    status = F.col("width") + 3 if review else F.lit(None).cast("int")
    if review:
        header = F.concat(header, F.transform(F.array(F.lit(""), F.lit(""), F.lit("ステータス")), _plain))
    rows = F.concat(F.array(header), F.transform("data", lambda r: F.transform(r, one)))
    table = table_name(F.concat(F.lit("sheet_"), F.col("sheet"), F.lit("_tbl")), F.concat(F.lit("sheet_"), F.col("segment_no").cast("string")))
    # names of tables must differ within a workbook
    named = T.unique_names(named.withColumn("__table", table), [doc], ["segment_no"], "__table", "table", 255)
    sheet = F.struct(F.col("sheet").alias("name"), "table", rows.cast(f"array<{ROW}>").alias("rows"), F.lit(None).cast("array<array<int>>").alias("merges"), F.col("width").cast("int").alias("width"), status.cast("int").alias("status"))
    return _volumes(named.select(doc, "segment_no", sheet.alias("sheet")), doc, "segment_no", per_book)


def layout_sheets(cells: DataFrame, prefix: str = "table", typed: bool = True, per_book: int = 200, keys: Sequence[str] = T.KEYS) -> DataFrame:
    """SNK-05: one sheet per table as it is laid out: texts at the corners of their cells, spans merged; a table only where
    nothing is merged."""
    one = _typed if typed else _plain
    c = T.defaults(cells).withColumn("__plain", plain_text(F.col("text")))
    merged = F.struct("row", "col", (F.col("row") + F.col("row_span") - 1).alias("bottom"), (F.col("col") + F.col("col_span") - 1).alias("right"))
    corners = F.map_from_entries(F.collect_list(F.struct(F.struct("row", "col"), "__plain")))
    first = F.row_number().over(Window.partitionBy(*keys, "row", "col").orderBy(F.col("idx").desc())) == 1
    spans = c.where("row_span > 1 or col_span > 1").groupBy(*keys).agg(F.array_sort(F.collect_list(merged)).alias("m"))
    grid = c.withColumn("__f", first).where("__f and row >= 1 and col >= 1").groupBy(*keys).agg(corners.alias("at"))
    t = grid.join(T.extents(cells, keys), list(keys)).join(spans, list(keys), "left")
    n = numbered(grid.select(*keys), [keys[0]], list(keys[1:]), "no").select(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)], "no")
    t = t.join(n, [t[k].eqNullSafe(n[f"__k{i}"]) for i, k in enumerate(keys)])
    value = lambda r, k: F.coalesce(F.col("at")[F.struct(r.alias("row"), k.alias("col"))], F.lit(""))
    rows = F.transform(F.sequence(F.lit(1), F.col("max_row")), lambda r: F.transform(F.sequence(F.lit(1), F.col("max_col")), lambda k: one(value(r, k))))
    merges = F.transform("m", lambda x: F.array(x["row"], x["col"], x["bottom"], x["right"]))
    name = F.concat(F.lit(prefix + "_"), F.col("no").cast("string"))
    table = F.when(F.col("m").isNull(), F.concat(name, F.lit("_tbl")))
    sheet = F.struct(name.alias("name"), table.alias("table"), rows.cast(f"array<{ROW}>").alias("rows"), merges.cast("array<array<int>>").alias("merges"), F.col("max_col").cast("int").alias("width"), F.lit(None).cast("int").alias("status"))
    return _volumes(t.select(keys[0], "no", sheet.alias("sheet")), keys[0], "no", per_book)


def text_sheets(paragraphs: DataFrame, doc: str = "doc_id", per_sheet: int = 100_000) -> DataFrame:
    """SNK-07: documents without tables: their paragraphs in one column."""
    n = F.floor((F.col("paragraph") - 1) / per_sheet).cast("int") + 1
    per = paragraphs.withColumn("no", n).groupBy(doc, "no").agg(F.array_sort(F.collect_list(F.struct("paragraph", "text"))).alias("p"))
    rows = F.concat(F.array(F.array(_plain(F.lit("本文")))), F.transform("p", lambda x: F.array(_plain(x["text"]))))
    name = F.concat(F.lit("本文"), F.when(F.col("no") == 1, "").otherwise(F.col("no").cast("string")))
    sheet = F.struct(name.alias("name"), F.lit(None).cast("string").alias("table"), rows.cast(f"array<{ROW}>").alias("rows"), F.lit(None).cast("array<array<int>>").alias("merges"), F.lit(1).alias("width"), F.lit(None).cast("int").alias("status"))
    return _volumes(per.select(doc, "no", sheet.alias("sheet")), doc, "no", 200)
