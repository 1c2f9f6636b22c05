"""Page parts to pages, pages to documents, and what needs a second look in them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import RATIO_WORDS, SCRIPT, issue
from ..functions.text import clean_document, strip
from .compact import PAGE_NAME, path_parts
from .lines import explode_lines


def parse_pages(files: DataFrame) -> DataFrame:
    """SRC-03: page and part from the names of page files; other files are left out."""
    name = F.element_at(path_parts(F.col("path")), -1)
    part = F.regexp_extract("__name", PAGE_NAME, 2)
    named = files.where("path is not null").withColumn("__name", name).where(F.col("__name").rlike(PAGE_NAME))
    return named.withColumn("page", F.regexp_extract("__name", PAGE_NAME, 1).cast("int")).withColumn("part", F.when(part == "", 0).otherwise(part.cast("int"))).drop("__name")


def normal_name(page: str = "page", part: str = "part") -> Column:
    """ORC-06: the regular name of a page file; the first part has no suffix."""
    return F.concat(F.format_string("page_%03d", F.col(page)), F.when(F.col(part) <= 1, "").otherwise(F.format_string("_p%02d", F.col(part))), F.lit(".md"))


def merge_parts(parts: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """AGG-12: one text per page: its parts in order, trimmed, blank ones left out, with a blank line between. Pages
    without text are left out."""
    trimmed = parts.withColumn("__t", strip(F.coalesce("text", F.lit("")))).where("__t <> ''")
    ordered = F.array_sort(F.collect_list(F.struct("part", "path", F.col("__t").alias("t"))))
    return trimmed.groupBy(*keys, "page").agg(ordered.alias("p")).select(*keys, "page", F.array_join(F.transform("p", lambda x: x["t"]), "\n\n").alias("text"))


def sections(pages: DataFrame, keys: Sequence[str] = ("doc_id",), headings: bool = True) -> DataFrame:
    """SNK-01, WIN-13: the section of each page as it stands in the merged document; the first has no line before its heading.

    A document is its sections in the order of ``page``. It is written section by section, never put together in memory.
    """
    # the first page is found by an aggregate, which combines before it shuffles: no folder is sorted by one task
    lead = pages.groupBy(*[F.col(k).alias(f"__k{i}") for i, k in enumerate(keys)]).agg(F.min("page").alias("__first"))
    pages = pages.join(lead, [pages[k].eqNullSafe(lead[f"__k{i}"]) for i, k in enumerate(keys)])
    heading = F.concat(F.when(F.col("page").eqNullSafe(F.col("__first")), "").otherwise("\n"), F.lit("# Page "), F.col("page").cast("string"), F.lit("\n\n")) if headings else F.lit("")
    return pages.select(*keys, "page", F.concat(heading, F.col("text"), F.lit("\n\n")).alias("section"))


def math_issues(pages: DataFrame, keys: Sequence[str] = ("doc_id", "page"), words: Sequence[str] = RATIO_WORDS, script: str = SCRIPT) -> DataFrame:
    """PRD-06: lines of merged pages that need review, with the reason."""
    lines = explode_lines(pages, *keys).withColumn("text", strip(F.col("text"))).withColumn("reason", issue(F.col("text"), words, script))
    return lines.where("reason is not null").select(*keys, "line", "reason", "text")


def merge(files: DataFrame, keys: Sequence[str] = ("doc_id",)) -> tuple[DataFrame, DataFrame]:
    """ORC-18: page files to cleaned merged pages, and the list of issues; cleaning is done twice, as existing documents were."""
    pages = merge_parts(parse_pages(files), keys)
    cleaned = pages.withColumn("text", clean_document(clean_document(F.col("text"))))
    return cleaned, math_issues(pages, [*keys, "page"])


def latest_folder(inputs: DataFrame, folders: DataFrame) -> DataFrame:
    """JON-11, WIN-11: for each input (``stem``) the newest folder (``name``, ``mtime``) whose name is the stem, alone or
    with a tail that begins with ``_``. Null if there is none.

    An equi-join on the names' prefixes up to each ``_``: no comparison of every input with every folder.
    """
    cuts = F.transform(F.sequence(F.lit(1), F.size(F.split("name", "_"))), lambda k: F.array_join(F.slice(F.split("name", "_"), 1, k), "_"))
    prefixes = folders.select("name", "mtime", F.explode(cuts).alias("stem"))
    best = inputs.join(prefixes, "stem", "left").groupBy("stem").agg(F.max_by("name", F.struct("mtime", "name")).alias("folder"))
    return inputs.join(best, "stem", "left")


# Fixed value: which output is shown first.
PRIORITY = {".docx": 1, ".xlsx": 2, ".csv": 3, ".md": 4}


def best_files(files: DataFrame, key: str = "doc_id", name: str = "name") -> DataFrame:
    """ORC-12: the best output of each folder by kind, then name."""
    rank = F.lit(None).cast("int")
    for ext, r in PRIORITY.items():
        rank = F.when(F.lower(name).endswith(ext), r).otherwise(rank)
    ranked = files.withColumn("__p", rank).where("__p is not null")
    return ranked.groupBy(key).agg(F.min_by(name, F.struct("__p", name)).alias("best"))


def recent(folders: DataFrame, n: int = 10) -> DataFrame:
    """SRC-17, SRT-05: the ``n`` newest folders (one at least)."""
    return folders.orderBy(F.col("mtime").desc(), "name").limit(max(1, n))


def tables_or_text(tables: DataFrame, texts: DataFrame, keys: Sequence[str] = ("doc_id",)) -> DataFrame:
    """JON-09, SNK-07: texts of the documents that have no table."""
    return texts.join(tables.select(*keys).distinct(), list(keys), "left_anti")


def distinct_in_order(rows: DataFrame, key: Sequence[str], order: str) -> DataFrame:
    """SET-04: each value once, where it came first."""
    return rows.groupBy(*key).agg(F.min(order).alias(order))


def page_numbers(images: DataFrame, start: int = 1, keys: Sequence[str] = ("doc_id",), name: str = "name") -> DataFrame:
    """ORC-17: pages numbered by name from ``start``."""
    return images.withColumn("page", F.row_number().over(Window.partitionBy(*keys).orderBy(name)) + (start - 1))


def page_span(first: Column, last: Column, total: Column) -> Column:
    """SRC-11: the pages of a range, within those there are; none if it lies outside."""
    lo, hi = F.greatest(F.coalesce(first, F.lit(1)), F.lit(1)), F.least(F.coalesce(last, total), total)
    return F.when(lo <= hi, F.sequence(lo, hi)).otherwise(F.array().cast("array<int>"))
