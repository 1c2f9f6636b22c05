"""Operators on recognized regions and formulas: gates, top-k, matching and pairing.

Pages are keyed by folder and number (``doc_id``, ``page``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.formulas import RATIO_WORDS, formula_block, looks_math, math_features
from ..functions.geometry import aspect, padded, polygon_box, upright
from ..functions.text import PAGE_HEADING, match_form, render_formula, strip
from .lines import limit_blanks

PAGE = ("doc_id", "page")


def candidates(pages: DataFrame, *keep: str, words: Sequence[str] = RATIO_WORDS) -> DataFrame:
    """SET-02: paragraphs and detections that look like math as regions with box, score, text and position ``ord``."""
    p = pages.select(*keep, F.posexplode("paragraphs").alias("ord", "p")).select(
        *keep, F.lit(0).alias("src_no"), "ord", F.col("p.box").alias("box"), F.coalesce("p.score", F.lit(0.5)).alias("score"), F.col("p.contents").alias("text")
    )
    d = pages.select(*keep, F.posexplode("detections").alias("ord", "d")).select(
        *keep, F.lit(1).alias("src_no"), "ord", polygon_box(F.col("d.points")).alias("box"), F.coalesce("d.rec_score", "d.det_score", F.lit(0.5)).alias("score"), F.col("d.content").alias("text")
    )
    return p.unionByName(d).where(F.col("text").isNotNull() & looks_math(F.col("text"), words))


def gate(regions: DataFrame, min_score: float = 0.6, min_ops: int = 1, max_chars: int = 120, max_aspect: float = 6.0) -> DataFrame:
    """PRD-03: regions with an upright box of bearable proportions, short text, enough signs and a good score."""
    f = math_features(F.col("text"))
    r = regions.withColumn("box", upright(F.col("box"))).where("box is not null and score is not null and text is not null")
    return r.where((aspect(F.col("box")) <= max_aspect) & (F.length("text") <= max_chars) & ((f["ops"] >= min_ops) | f["has_base"] | (f["digit_ratio"] >= 0.4)) & (F.col("score") >= min_score))


def top_regions(regions: DataFrame, keys: Sequence[str] = PAGE, k: int = 20, tie: Sequence[str] = ("src_no", "ord")) -> DataFrame:
    """WIN-09, SRT-03: of each page the ``k`` best by score, then top, then left, then list order; numbered."""
    by = [F.col("score").desc(), F.col("box")[1], F.col("box")[0], *tie]
    return regions.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*by))).where(F.col("rank") <= k)


def snippet_names(top: DataFrame, keys: Sequence[str] = PAGE, padding: int = 6, width: int = 2480, height: int = 3508) -> DataFrame:
    """SNK-13, TYP-04: name and padded crop rectangle of each snippet."""
    name = F.format_string("eq_page%03d_%02d.png", F.col(keys[-1]), F.col("rank"))
    return top.withColumn("name", name).withColumn("crop", padded(F.col("box"), padding, F.lit(width), F.lit(height)))


def with_images(regions: DataFrame, images: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """JON-02: regions of pages that have an image."""
    return regions.join(images.select(*keys).distinct(), list(keys), "left_semi")


def first_location(pages: DataFrame, images: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """JON-03: the image of a page at the best of several places. ``images`` has ``path`` and ``priority``; null if none."""
    best = images.groupBy(*keys).agg(F.min_by("path", F.struct("priority", "path")).alias("path"))
    return pages.join(best, list(keys), "left")


def contained(lines: DataFrame, snippets: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """JON-05, candidates: lines that contain a snippet of their page, in the form texts are compared by."""
    a = lines.withColumn("__line", match_form(F.col("text"))).where("__line <> ''").select(*keys, "line", "__line")
    b = snippets.withColumn("__s", match_form(F.col("text"))).where("__s <> ''").select(*keys, "rank", "name", "__s")
    return a.join(b, list(keys)).where(F.instr(F.col("__line"), F.col("__s")) > 0).select(*keys, "line", "rank", "name")


def match_snippets(lines: DataFrame, snippets: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """JON-05: each line takes the first snippet of its page that it contains and that no earlier line took.

    Snippets that no line took have a null ``line``: they go to the end of the page. The assignment is a fold over a page's
    candidates in the order of lines and ranks; a page is bounded.
    """
    pairs = contained(lines, snippets, keys)
    per = pairs.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("line", "rank"))).alias("p"))
    line_t, rank_t = pairs.schema["line"].dataType.simpleString(), pairs.schema["rank"].dataType.simpleString()
    start = F.array().cast(f"array<struct<line:{line_t},rank:{rank_t}>>")

    def step(acc: Column, x: Column) -> Column:
        taken = F.exists(acc, lambda t: (t["line"] == x["line"]) | (t["rank"] == x["rank"]))
        return F.when(taken, acc).otherwise(F.concat(acc, F.array(x)))

    chosen = per.select(*keys, F.explode(F.aggregate("p", start, step)).alias("c")).select(*keys, "c.line", "c.rank")
    return snippets.select(*keys, "rank", "name").join(chosen, [*keys, "rank"], "left").select(*keys, "line", "rank", "name")


def insert_links(lines: DataFrame, snippets: DataFrame, keys: Sequence[str] = PAGE) -> DataFrame:
    """ORC-10: page lines with links to their snippets put in: old links away (SET-06), new ones behind their lines with
    blank lines around, the rest at the page's end, and no more than two blank lines in a row (WIN-10)."""
    old = F.col("text").contains("eq_page")
    kept = lines.where(~old)
    body = kept.where(~strip(F.col("text")).rlike(PAGE_HEADING))
    placed = match_snippets(body, snippets, keys)
    link = F.concat(F.lit("![eq](figures/"), F.col("name"), F.lit(")"))
    added = placed.select(*keys, F.coalesce("line", F.lit(2**31 - 1)).alias("line"), F.col("rank").alias("k"), F.posexplode(F.array(F.lit(""), link, F.lit(""))).alias("j", "text"))
    every = kept.select(*keys, "line", F.lit(0).alias("k"), F.lit(0).alias("j"), "text").unionByName(added)
    w = Window.partitionBy(*keys).orderBy("line", "k", "j")
    return limit_blanks(every.withColumn("line", F.row_number().over(w)).select(*keys, "line", "text"), keys)


def formula_blocks(lines: DataFrame, keys: Sequence[str], order: str = "line") -> DataFrame:
    """WIN-03: adds ``block``, the ordinal of the run of formula-like lines that a line is in (null outside)."""
    w = Window.partitionBy(*keys).orderBy(order)
    flagged = lines.withColumn("__f", F.coalesce(formula_block(F.col("text")), F.lit(False)))
    new = F.col("__f") & ~F.coalesce(F.lag("__f").over(w), F.lit(False))
    flagged = flagged.withColumn("__new", new.cast("int"))
    return flagged.withColumn("block", F.when(F.col("__f"), F.sum("__new").over(w.rowsBetween(Window.unboundedPreceding, 0)))).drop("__f", "__new")


def pair_by_order(left: DataFrame, right: DataFrame, keys: Sequence[str], left_by: Sequence[Column], right_by: Sequence[Column]) -> DataFrame:
    """JON-06: the k-th row of the left with the k-th of the right; what is over on either side has nulls."""
    a = left.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*left_by)))
    b = right.withColumn("n", F.row_number().over(Window.partitionBy(*keys).orderBy(*right_by)))
    return a.join(b, [*keys, "n"], "full_outer")


def refine_page(lines: DataFrame, formulas: DataFrame, keys: Sequence[str] = PAGE, order: str = "line", min_score: float = 0.65) -> DataFrame:
    """ORC-09: the k-th block of formula-like lines of a page gives way to its k-th recognized formula from the top.

    ``formulas``: keys, ``latex``, ``isolated``, ``score``, ``y_center``, ``ord``. Blocks without a formula stay.
    """
    good = formulas.where((F.col("score") >= min_score) & (strip(F.col("latex")) != ""))
    ranked = good.withColumn("block", F.row_number().over(Window.partitionBy(*keys).orderBy("y_center", "ord"))).select(*keys, "block", render_formula(F.col("latex"), F.col("isolated")).alias("__r"))
    marked = formula_blocks(lines, keys, order).join(ranked, [*keys, "block"], "left")
    first = F.row_number().over(Window.partitionBy(*keys, "block").orderBy(order)) == 1
    marked = marked.withColumn("__first", first)
    return marked.where("__r is null or __first").withColumn("text", F.coalesce("__r", "text")).select(*keys, order, "text", F.col("__r").isNotNull().alias("replaced"))


def refine_counts(lines: DataFrame, formulas: DataFrame, keys: Sequence[str] = PAGE, order: str = "line", min_score: float = 0.65) -> DataFrame:
    """AGG-13: of each page the formulas used and left over."""
    n_blocks = formula_blocks(lines, keys, order).groupBy(*keys).agg(F.coalesce(F.max("block"), F.lit(0)).cast("bigint").alias("blocks"))
    n_formulas = formulas.where((F.col("score") >= min_score) & (strip(F.col("latex")) != "")).groupBy(*keys).agg(F.count(F.lit(1)).alias("formulas"))
    both = n_blocks.join(n_formulas, list(keys), "full_outer")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0))
    return both.select(*keys, F.least(zero("blocks"), zero("formulas")).alias("replaced"), F.greatest(F.lit(0), zero("formulas") - zero("blocks")).alias("unused"))
