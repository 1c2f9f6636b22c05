"""Operators on lines: islands, fills, limits and block types.

Windows run within one page or one document; the keys say which. Null texts have no lines.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.cells import is_table_line
from ..functions.text import PAGE_HEADING, count_of, lines_of, rstrip, split_row, strip


def explode_lines(df: DataFrame, *keep: str, text: str = "text") -> DataFrame:
    """One row per line: the kept columns, ``line`` from 1, and the line in ``text``."""
    return df.select(*keep, F.posexplode(lines_of(F.col(text))).alias("__pos", "text")).withColumn("line", F.col("__pos") + 1).select(*keep, "line", "text")


def islands(lines: DataFrame, keys: Sequence[str], flag: Column, order: str = "line") -> DataFrame:
    """WIN-03, WIN-04: runs of consecutive rows for which ``flag`` holds, as half-open ranges of 0-based positions."""
    w = Window.partitionBy(*keys).orderBy(order)
    at = lines.withColumn("__flag", F.coalesce(flag, F.lit(False))).withColumn("__n", F.row_number().over(w) - 1)
    marked = at.where("__flag").withColumn("__island", F.col("__n") - F.row_number().over(w))
    return marked.groupBy(*keys, "__island").agg(F.min("__n").alias("start"), (F.max("__n") + 1).alias("end"), F.count(F.lit(1)).alias("n_lines")).drop("__island")


def runs(rows: DataFrame, keys: Sequence[str], order: str, value: Column) -> DataFrame:
    """WIN-06: adds ``run``, the number of the run of equal values a row belongs to."""
    w = Window.partitionBy(*keys).orderBy(order)
    changed = F.when(F.lag(value).over(w).eqNullSafe(value) & (F.row_number().over(w) > 1), 0).otherwise(1)
    return rows.withColumn("__new", changed).withColumn("run", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0))).drop("__new")


def paragraphs(lines: DataFrame, keys: Sequence[str], order: str = "line") -> DataFrame:
    """WIN-05: paragraphs between blank lines, in order from 1."""
    w = Window.partitionBy(*keys).orderBy(order)
    blank = strip(F.col("text")) == ""
    marked = lines.withColumn("__p", F.sum(F.when(blank, 1).otherwise(0)).over(w.rowsBetween(Window.unboundedPreceding, 0))).where(~blank)
    joined = marked.groupBy(*keys, "__p").agg(F.min(order).alias("first_line"), F.array_sort(F.collect_list(F.struct(order, rstrip(F.col("text")).alias("t")))).alias("t"))
    text = strip(F.array_join(F.transform("t", lambda x: x["t"]), "\n"))
    return joined.select(*keys, F.row_number().over(Window.partitionBy(*keys).orderBy("first_line")).alias("paragraph"), "first_line", text.alias("text"))


def fill_forward(rows: DataFrame, keys: Sequence[str], order: str, value: Column, name: str) -> DataFrame:
    """WIN-02: the last value that is not null."""
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(value, ignorenulls=True).over(w))


def page_of_lines(lines: DataFrame, keys: Sequence[str], order: str = "line") -> DataFrame:
    """WIN-02: adds ``page``, the page whose heading came last, and whether the line is one."""
    s = strip(F.col("text"))
    number = F.when(s.rlike(PAGE_HEADING), F.regexp_extract(s, PAGE_HEADING, 1).cast("int"))
    return fill_forward(lines, keys, order, number, "page").withColumn("is_heading", number.isNotNull())


def demote(lines: DataFrame, keys: Sequence[str], order: str = "line") -> DataFrame:
    """WIN-01 on rows: the first-level headings behind a page heading become second-level ones."""
    from ..functions.text import H1

    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    page = strip(F.col("text")).rlike(PAGE_HEADING)
    seen = F.max(page.cast("int")).over(w) == 1
    inner = F.concat(F.regexp_extract("text", H1, 1), F.lit("## "), strip(F.regexp_extract("text", H1, 2)))
    return lines.withColumn("__seen", seen).withColumn("text", F.when(~page & F.col("__seen") & F.col("text").rlike(H1), inner).otherwise(F.col("text"))).drop("__seen")


def limit_blanks(lines: DataFrame, keys: Sequence[str], order: str = "line", most: int = 2) -> DataFrame:
    """WIN-10: of consecutive blank lines the first ``most``."""
    w = Window.partitionBy(*keys).orderBy(order)
    blank = strip(F.col("text")) == ""
    since = F.row_number().over(w) - F.coalesce(F.max(F.when(~blank, F.col("__n"))).over(w.rowsBetween(Window.unboundedPreceding, 0)), F.lit(0))
    return lines.withColumn("__n", F.row_number().over(w)).withColumn("__since", since).where(~blank | (F.col("__since") <= most)).drop("__n", "__since")


# Fixed value: an ordered item.
ORDERED = r"(?U)^(\d+)[.)]\s+(.*)"


def block_kind(text: Column) -> Column:
    """WIN-16: the type of a line of Markdown, by precedence."""
    s = strip(text)
    return (
        F.when(s == "", "blank")
        .when(s.rlike(PAGE_HEADING), "page")
        .when(s.startswith("#"), "heading")
        .when(is_table_line(text), "table")
        .when(s.startswith("- ") | s.startswith("* "), "bullet")
        .when(s.rlike(ORDERED), "ordered")
        .when(s.rlike(r'<img[^>]*src="[^"]+"[^>]*>|!\[[^\]]*\]\([^)]+\)'), "image")
        .otherwise("paragraph")
    )


def blocks(lines: DataFrame, keys: Sequence[str], order: str = "line") -> DataFrame:
    """SNK-10, WIN-16: the block stream of a document: tables and paragraphs as one block each, other lines one by one."""
    w = Window.partitionBy(*keys).orderBy(order)
    typed = lines.withColumn("kind", block_kind(F.col("text")))
    joins = F.col("kind").isin("table", "paragraph")
    new = F.when(joins & (F.lag("kind").over(w) == F.col("kind")), 0).otherwise(1)
    numbered = typed.withColumn("__new", new).withColumn("block", F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = strip(F.col("text"))
    level = F.length(F.regexp_extract(s, "^(#+)", 1))
    body = (
        F.when(F.col("kind") == "heading", strip(F.regexp_replace(s, "^#+", "")))
        .when(F.col("kind") == "bullet", strip(F.substring(s, 3, 1 << 30)))
        .when(F.col("kind") == "ordered", F.concat(F.regexp_extract(s, ORDERED, 1), F.lit(". "), strip(F.regexp_extract(s, ORDERED, 2))))
        .otherwise(s)
    )
    out = numbered.withColumn("__body", body).withColumn("__level", F.when(F.col("kind") == "heading", F.least(level, F.lit(4))).when(F.col("kind") == "page", 1))
    merged = out.where("kind <> 'blank'").groupBy(*keys, "block", "kind").agg(F.min(order).alias("first_line"), F.max("__level").alias("level"), F.array_sort(F.collect_list(F.struct(order, "__body"))).alias("b"))
    joined = F.transform("b", lambda x: x["__body"])
    return merged.select(*keys, "block", "kind", "first_line", "level", F.when(F.col("kind") == "table", F.array_join(joined, "\n")).otherwise(strip(F.array_join(joined, " "))).alias("text"))


def image_references(lines: DataFrame, *keep: str) -> DataFrame:
    """SNK-16: the images that lines refer to, in order, HTML ones first, with their width attribute."""
    html = F.transform(F.regexp_extract_all("text", F.lit(r'<img[^>]*src="[^"]+"[^>]*>'), 0), lambda t: F.struct(F.regexp_extract(t, r'src="([^"]+)"', 1).alias("src"), t.alias("tag")))
    md = F.transform(F.regexp_extract_all("text", F.lit(r"!\[[^\]]*\]\(([^)]+)\)"), 1), lambda u: F.struct(u.alias("src"), F.lit(None).cast("string").alias("tag")))
    refs = lines.select(*keep, "line", F.posexplode(F.concat(html, md)).alias("n", "r"))
    return refs.select(*keep, "line", "n", strip(F.col("r.src")).alias("src"), F.col("r.tag").alias("tag"))


def table_cells(lines: DataFrame, *keep: str) -> DataFrame:
    """TXT-16: cells of lines that have bars, by position."""
    rows = lines.where(count_of(F.col("text"), "|") >= 2)
    return rows.select(*keep, "line", F.posexplode(split_row(F.col("text"))).alias("pos", "value")).select(*keep, "line", (F.col("pos") + 1).alias("col"), "value")
