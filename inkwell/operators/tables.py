"""Operators on tables of cells: spans, grids, row structure, segments, headers and names.

``cells`` have the keys of their table and ``idx`` (list position), ``row``, ``col`` (1-based), ``row_span``,
``col_span`` and ``text``. Null rows and columns count as 1, null and smaller spans as 1, null texts as empty. A table
is the unit of all windows and groups.
"""

from __future__ import annotations

from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import file_name, is_blank, is_symbol, sheet_title, typed_value
from ..functions.text import plain_text, strip
from ..session import materialize
from .ranks import numbered

KEYS = ("doc_id", "page", "table_no")


def defaults(cells: DataFrame) -> DataFrame:
    """SRC-07, ARR-03: defaults of optional fields, texts trimmed."""
    one = lambda c: F.coalesce(F.col(c), F.lit(1))
    return (
        cells.withColumn("row", one("row"))
        .withColumn("col", one("col"))
        .withColumn("row_span", F.greatest(one("row_span"), F.lit(1)))
        .withColumn("col_span", F.greatest(one("col_span"), F.lit(1)))
        .withColumn("text", strip(F.coalesce("text", F.lit(""))))
    )


def extents(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """AGG-01."""
    c = defaults(cells)
    return c.groupBy(*keys).agg(
        F.greatest(F.lit(1), F.max(F.col("row") + F.col("row_span") - 1)).alias("max_row"), F.greatest(F.lit(1), F.max(F.col("col") + F.col("col_span") - 1)).alias("max_col")
    )


def grid(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """ARR-01, AGG-03, JON-12: covered coordinates with their owner (first cell) and value (first text that isn't empty)."""
    spread = (
        defaults(cells)
        .select(*keys, "idx", "text", "col", "col_span", F.explode(F.sequence(F.col("row"), F.col("row") + F.col("row_span") - 1)).alias("r"))
        .select(*keys, "idx", "text", "r", F.explode(F.sequence(F.col("col"), F.col("col") + F.col("col_span") - 1)).alias("c"))
        .where("r >= 1 and c >= 1")
    )
    value = F.min(F.when(F.col("text") != "", F.struct("idx", "text")))["text"]
    return spread.groupBy(*keys, "r", "c").agg(F.min("idx").alias("owner"), F.coalesce(value, F.lit("")).alias("value"))


def signature(owners: Column) -> Column:
    """AGG-04: lengths of the runs of one owner; a place without owner is a run of its own."""
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.array().cast("array<int>").alias("sig"))
    named = F.transform(owners, lambda o, k: F.coalesce(o.cast("bigint"), -(k.cast("bigint") + 1)))

    def step(acc: Column, o: Column) -> Column:
        n = F.size(acc["sig"])
        longer = F.concat(F.slice(acc["sig"], 1, F.greatest(n - 1, F.lit(0))), F.array(F.element_at(acc["sig"], -1) + 1))
        return F.struct(o.alias("last"), F.when((n > 0) & (acc["last"] == o), longer).otherwise(F.concat(acc["sig"], F.array(F.lit(1)))).alias("sig"))

    return F.aggregate(named, start, step, lambda acc: acc["sig"])


def rows_of(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """The rows of each grid: arrays of owners and values over all its columns, structure, and whether a symbol is in it."""
    by_row = grid(cells, keys).groupBy(*keys, "r").agg(F.map_from_entries(F.collect_list(F.struct("c", F.struct("owner", "value")))).alias("m"))
    full = by_row.join(extents(cells, keys), list(keys))
    at = F.transform(F.sequence(F.lit(1), F.col("max_col")), lambda c: F.col("m")[c])
    out = full.withColumn("__a", at).select(
        *keys, "r", "max_row", "max_col", F.transform("__a", lambda x: x["owner"]).alias("owners"), F.transform("__a", lambda x: F.coalesce(x["value"], F.lit(""))).alias("values")
    )
    return out.withColumn("blank", is_blank(F.col("values"))).withColumn("signature", F.when(~F.col("blank"), signature(F.col("owners")))).withColumn("has_symbol", F.exists("values", is_symbol))


def segments_of(rows: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """WIN-06, WIN-07: adds ``segment`` (from 1) and ``role`` (header or data) to the rows that belong to a segment.

    Runs are rows of one structure without a blank row between. In tables with symbols, a run has data from its first
    row with a symbol on; in others the longest runs are data. Other rows are headers of the next data; headers
    without data behind them are dropped.
    """
    w = Window.partitionBy(*keys).orderBy("r")
    upto = w.rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*keys)
    body = rows.where(~F.col("blank"))
    new = F.when((F.lag("signature").over(w) == F.col("signature")) & (F.lag("r").over(w) == F.col("r") - 1), 0).otherwise(1)
    body = body.withColumn("__new", new).withColumn("__run", F.sum("__new").over(upto))
    run = Window.partitionBy(*keys, "__run")
    body = (
        body.withColumn("__symbols", F.max(F.col("has_symbol").cast("int")).over(whole) == 1)
        .withColumn("__first", F.min(F.when(F.col("has_symbol"), F.col("r"))).over(run))
        .withColumn("__length", F.count(F.lit(1)).over(run))
        .withColumn("__longest", F.max("__length").over(whole))
        .withColumn("__data_run", F.when(F.col("__symbols"), F.col("__first").isNotNull()).otherwise(F.col("__length") == F.col("__longest")))
        .withColumn("__is_data", F.col("__data_run") & (~F.col("__symbols") | (F.col("r") >= F.col("__first"))))
        .withColumn("__runs", F.sum(F.when((F.col("__new") == 1) & F.col("__data_run"), 1).otherwise(0)).over(upto))
        .withColumn("__total", F.max("__runs").over(whole))
        .withColumn("segment", F.col("__runs") - F.when(F.col("__data_run"), 1).otherwise(0) + 1)
        .where("segment <= __total")
        .withColumn("role", F.when(F.col("__is_data"), "data").otherwise("header"))
    )
    return body.select(*keys, "segment", "role", "r", "max_row", "max_col", "owners", "values", "signature")


def trim_columns(values: Column, max_col: Column) -> Column:
    """WIN-14: last column with text in any of the rows (array of arrays); all columns if there is none."""
    last = F.array_max(F.transform(values, lambda row: F.array_max(F.transform(row, lambda v, k: F.when(strip(v) != "", k + 1).otherwise(0)))))
    return F.when(F.coalesce(last, F.lit(0)) > 0, last).otherwise(max_col)


def unique_in(names: Column, max_len: int = 255) -> Column:
    """WIN-12 within one array: repeated names get ``_2``, ``_3``, ... that are not taken yet."""
    start = F.struct(F.array().cast("array<string>").alias("used"))

    def step(acc: Column, base: Column) -> Column:
        tries = F.transform(F.sequence(F.lit(2), F.size(acc["used"]) + 2), lambda i: F.concat(F.left(base, F.lit(max_len) - F.length(F.concat(F.lit("_"), i.cast("string")))), F.lit("_"), i.cast("string")))
        free = F.filter(tries, lambda t: ~F.array_contains(acc["used"], t))
        return F.struct(F.concat(acc["used"], F.array(F.when(F.array_contains(acc["used"], base), free[0]).otherwise(base))).alias("used"))

    return F.aggregate(names, start, step, lambda acc: acc["used"])


def merged_header(rows: Column, width: Column) -> Column:
    """ARR-02, AGG-11: header rows (array of arrays) merged column by column, ``col_i`` where nothing is, made unique."""
    none = F.array().cast("array<string>")

    def column(c: Column) -> Column:
        texts = F.filter(F.transform(rows, lambda row: strip(F.get(row, c - 1))), lambda t: t != "")
        parts = F.aggregate(texts, none, lambda acc, t: F.when((F.size(acc) > 0) & (F.get(acc, F.size(acc) - 1) == t), acc).otherwise(F.concat(acc, F.array(t))))
        joined = strip(F.replace(F.array_join(parts, " / "), F.lit("\n"), F.lit(" ")))
        return F.when(joined == "", F.concat(F.lit("col_"), c.cast("string"))).otherwise(joined)

    return unique_in(F.transform(F.sequence(F.lit(1), width), column))


def segments(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """SNK-04/06: one row per segment: rows, trimmed width, header, name of the first data cell, data."""
    rows = segments_of(rows_of(cells, keys), keys)
    one = F.array_sort(F.collect_list(F.struct("r", "role", "values")))
    s = rows.groupBy(*keys, "segment", "max_row", "max_col").agg(one.alias("rows"))
    pick = lambda role: F.filter("rows", lambda x: x["role"] == role)
    s = s.withColumn("__h", pick("header")).withColumn("__d", pick("data"))
    s = s.withColumn("header_rows", F.transform("__h", lambda x: x["r"])).withColumn("data_rows", F.transform("__d", lambda x: x["r"]))
    s = s.withColumn("width", trim_columns(F.transform("rows", lambda x: x["values"]), F.col("max_col")))
    firsts = F.filter(F.transform("__d", lambda x: strip(x["values"][0])), lambda v: v != "")
    plain = lambda v: plain_text(v)
    s = s.withColumn("header", F.transform(merged_header(F.transform("__h", lambda x: x["values"]), F.col("width")), plain))
    s = s.withColumn("name", F.coalesce(F.get(firsts, F.lit(0)), F.lit("")))
    s = s.withColumn("data", F.transform("__d", lambda x: F.transform(F.slice(x["values"], 1, F.col("width")), plain)))
    return s.select(*keys, "segment", "max_row", "max_col", "header_rows", "data_rows", "width", "header", "name", "data")


def unique_names(df: DataFrame, group: Sequence[str], order: Sequence[str], base: str, out: str, max_len: int) -> DataFrame:
    """WIN-12: names that are unique within a group, in order: the first keeps its name, the next get ``_2``, ``_3``, ...

    The suffix is the row number among equal names, however many there are (``ranks.numbered``). Only
    families of names (what they are without such suffixes) in which a suffixed name meets a name that was there, or
    gets too long, are gone through one by one.
    """
    stem = F.left(F.regexp_replace(F.col(base), r"(?:_[0-9]+)+$", ""), F.lit(max(1, max_len - 12)))
    made = F.when(F.col("__n") == 1, F.col(base)).otherwise(F.concat_ws("_", F.col(base), F.col("__n").cast("string")))
    at = numbered(df.withColumn("__family", stem), [*group, base], order, "__n").withColumn(out, made)
    keys = [*group, "__family"]
    clash = at.groupBy(*keys, out).agg(F.count(F.lit(1)).alias("__c")).where((F.col("__c") > 1) | (F.length(out) > max_len)).select(*keys).distinct().withColumn("__odd", F.lit(True))
    at = at.join(clash, keys, "left")
    plain = at.where("__odd is null").drop("__family", "__odd", "__n")

    def one(pdf: pd.DataFrame) -> pd.DataFrame:
        used: set[str] = set()
        names = []
        pdf = pdf.sort_values(list(order), kind="stable")
        for b in pdf[base]:
            k, name = 1, b
            while name in used:
                k += 1
                tail = f"_{k}"
                name = b[: max_len - len(tail)] + tail
            used.add(name)
            names.append(name)
        return pdf.assign(**{out: names}).drop(columns=["__family", "__odd", "__n"])

    schema = plain.schema
    hard = at.where("__odd").groupBy(*keys).applyInPandas(one, schema)
    return plain.unionByName(hard)


def sheets(cells: DataFrame, prefix: str = "sheet", keys: Sequence[str] = KEYS) -> DataFrame:
    """SNK-04, SNK-06: segments with the names of their sheets and files, unique within a document."""
    s = segments(cells, keys)
    doc, order = [keys[0]], [*keys[1:], "segment"]
    fallback = F.concat(F.lit(prefix + "_"), F.col("segment_no").cast("string"))
    name = F.when(F.col("name") == "", fallback).otherwise(F.col("name"))
    n = numbered(s.select(*keys, "segment", "name"), doc, order, "segment_no")
    n = n.select(*keys, "segment", "segment_no", sheet_title(name, fallback).alias("__sheet"), F.concat(F.col(keys[0]), F.lit("__"), file_name(name, fallback)).alias("__file"))
    # names are made on a narrow table of their own, which is read several times
    n = unique_names(materialize(n, "names"), doc, ["segment_no"], "__sheet", "sheet", 31)
    n = unique_names(n, doc, ["segment_no"], "__file", "file", 200).drop("__sheet", "__file")
    same = [s[k].eqNullSafe(n[k]) for k in (*keys, "segment")]
    return s.join(n, same).select(*[s[c] for c in s.columns], "segment_no", "sheet", "file")


def typed_cells(s: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """TYP-01 over the data of segments: one row per cell."""
    return (
        s.select(*keys, "segment", F.posexplode("data").alias("__r", "__row"))
        .select(*keys, "segment", (F.col("__r") + 1).alias("data_row"), F.posexplode("__row").alias("__c", "raw"))
        .select(*keys, "segment", "data_row", (F.col("__c") + 1).alias("col"), "raw", typed_value(F.col("raw")).alias("v"))
    )


def layout_rows(cells: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """SNK-04 in layout mode: the grid itself as plain text, empty columns and rows at its ends dropped."""
    rows = rows_of(cells, keys).select(*keys, "r", "max_col", "values", "blank")
    per = rows.groupBy(*keys).agg(trim_columns(F.collect_list("values"), F.first("max_col")).alias("width"), F.greatest(F.lit(1), F.coalesce(F.max(F.when(~F.col("blank"), F.col("r"))), F.lit(1))).alias("last_row"))
    # rows that no cell covers are rows all the same
    every = per.select(*keys, "width", F.explode(F.sequence(F.lit(1), F.col("last_row"))).alias("r"))
    full = every.join(rows.select(*keys, "r", "values"), [*keys, "r"], "left")
    values = F.coalesce(F.slice("values", 1, F.col("width")), F.array_repeat(F.lit(""), F.col("width")))
    return full.select(*keys, "r", F.transform(values, plain_text).alias("values"))


def column_widths(s: DataFrame, keys: Sequence[str] = KEYS) -> DataFrame:
    """AGG-02: the width of each column of a segment by its longest text, header included; columns without text have none."""
    from ..functions.cells import width_bucket

    rows = s.select(*keys, "segment", F.explode(F.concat(F.array("header"), F.col("data"))).alias("row")).select(*keys, "segment", F.posexplode("row").alias("c", "v")).where("v <> ''")
    return rows.groupBy(*keys, "segment", (F.col("c") + 1).alias("col")).agg(F.max(F.length("v")).alias("longest")).withColumn("width", width_bucket(F.col("longest")))
