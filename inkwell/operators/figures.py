"""Operators on figures: names, statistics, decisions, tone and symbols. Pixels are rows or arrays of integers."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.geometry import IconRules, icon_decision, icon_removed, inner, luma

# Fixed value: names that recognizers give to figure files: page, part, number, suffix.
RAW_FIGURE = r"^(?:.*_)?page_(\d+)(?:_p(\d+))?_figure_(\d+)(\.[A-Za-z0-9]+)$"


def renumber(files: DataFrame, keys: Sequence[str] = ("doc_id",), name: str = "name") -> DataFrame:
    """WIN-08: figures of a page numbered by part and index, with their new names. Other files are left out."""
    part = F.regexp_extract(name, RAW_FIGURE, 2)
    f = files.where(F.col(name).rlike(RAW_FIGURE)).select(
        *keys, F.col(name).alias("old"), F.regexp_extract(name, RAW_FIGURE, 1).cast("int").alias("page"), F.when(part == "", 0).otherwise(part.cast("int")).alias("part"),
        F.regexp_extract(name, RAW_FIGURE, 3).cast("int").alias("n"), F.lower(F.regexp_extract(name, RAW_FIGURE, 4)).alias("ext"),
    )
    k = F.row_number().over(Window.partitionBy(*keys, "page").orderBy("part", "n", "old"))
    return f.select(*keys, "page", "old", F.concat(F.format_string("fig_page%03d_%02d", F.col("page"), k), F.col("ext")).alias("new"))


def renamed_map(renames: DataFrame, keys: Sequence[str] = ("doc_id", "page")) -> DataFrame:
    """JON-04: the names of each page as one map, for ``rewrite_links``."""
    return renames.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("old", "new"))).alias("names"))


def figure_statistics(pixels: DataFrame, keys: Sequence[str], rules: IconRules = IconRules()) -> DataFrame:
    """AGG-05, TYP-09: statistics of figures from rows of pixels ``r``, ``g``, ``b`` with ``width`` and ``height``, and
    optionally ``page_width`` and ``page_height`` (ratios are 0 without).

    Colours are counted before pixels of a figure meet in one place. More colours than are counted (``max_color_samples``)
    give 0 colours and no dominant one.
    """
    extra = [c for c in ("page_width", "page_height") if c in pixels.columns]
    per_colour = pixels.groupBy(*keys, "width", "height", *extra, "r", "g", "b").agg(F.count(F.lit(1)).alias("n"))
    n, grey = F.col("n"), luma(F.col("r"), F.col("g"), F.col("b"))
    s = per_colour.groupBy(*keys, "width", "height", *extra).agg(
        F.count(F.lit(1)).alias("__colours"), F.max("n").alias("__most"), F.sum("n").alias("__n"),
        *[F.sum(n * F.col(c)).alias(f"__s{c}") for c in "rgb"], *[F.sum(n * F.col(c) * F.col(c)).alias(f"__q{c}") for c in "rgb"],
        F.sum(n * grey).alias("__luma"), F.sum(F.when(grey >= 250, n).otherwise(0)).alias("__white"),
    )
    area, total = (F.col("width") * F.col("height")).cast("bigint"), F.col("__n")
    std = lambda c: F.sqrt(F.greatest(F.lit(0.0), F.col(f"__q{c}") / total - (F.col(f"__s{c}") / total) * (F.col(f"__s{c}") / total)))
    unique = F.when(F.col("__colours") > rules.max_color_samples, 0).otherwise(F.col("__colours"))
    ratio = lambda a, b: F.bround(F.when(b > 0, a / b).otherwise(0.0), 6) if b is not None else F.lit(0.0)
    pw, ph = (F.col(c) if c in extra else None for c in ("page_width", "page_height"))
    return s.select(
        *keys, "width", "height", area.alias("area"), (F.col("width") / F.col("height")).alias("aspect_ratio"), unique.alias("unique_colors"),
        F.bround((std("r") + std("g") + std("b")) / 3, 4).alias("avg_std"), F.bround(F.col("__luma") / total, 4).alias("mean_luma"),
        F.bround(F.greatest(F.lit(0.0), F.least(F.lit(1.0), (area - F.col("__white")) / area)), 4).alias("non_white_ratio"),
        F.bround(F.when(unique > 0, F.col("__most") / area).otherwise(0.0), 4).alias("dominant_ratio"),
        ratio(F.col("width"), pw).alias("width_ratio"), ratio(F.col("height"), ph).alias("height_ratio"),
        ratio(area, pw * ph if pw is not None and ph is not None else None).alias("area_ratio"),
    )


def decide(statistics: DataFrame, rules: IconRules = IconRules()) -> DataFrame:
    """ORC-07, PRD-13, PRD-14: adds the decision about each figure and whether it is removed."""
    cols = [c for c in statistics.columns]
    s = F.struct(*cols)
    return statistics.withColumn("decision", icon_decision(s, rules)).withColumn("removed", icon_removed(F.col("decision"), rules))


def tone_curves(pixels: DataFrame, tile: Sequence[str], value: str = "v", clip_limit: float = 2.0, grid_size: int = 8) -> DataFrame:
    """AGG-08: the clipped, normalized cumulative histogram of each tile: the new value of each value that occurs."""
    counts = pixels.groupBy(*tile, value).agg(F.count(F.lit(1)).alias("n"))
    w = Window.partitionBy(*tile).orderBy(value).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(*tile)
    c = counts.withColumn("cdf", F.sum("n").over(w)).withColumn("__total", F.sum("n").over(whole))
    clip = F.col("__total") * clip_limit / grid_size
    c = c.withColumn("__c", F.least(F.col("cdf").cast("double"), clip))
    # values below the first that occurs have a cumulative count of 0
    low = F.when(F.min(value).over(whole) > 0, F.lit(0.0)).otherwise(F.min("__c").over(whole))
    span = F.greatest(F.lit(1.0), F.max("__c").over(whole) - low)
    return c.select(*tile, value, "n", "cdf", F.floor((F.col("__c") - low) / span * 255.0 + 0.5).cast("int").alias("to"))


def black_ratio(pixels: Column) -> Column:
    """AGG-06: share of black pixels in an array of 0 and 255."""
    return F.when(F.size(pixels) > 0, F.size(F.filter(pixels, lambda p: p == 0)) / F.size(pixels)).otherwise(0.0)


# Shares and thresholds of rings.
RING_INK, RING_CENTRE, RING_EDGE, RING_CONTRAST, RING_BALANCE, RING_LEAST = (0.01, 0.25), (0.3, 0.7), 0.15, 1.8, (0.6, 1.6), 8


def ring_measures(pixels: DataFrame, keys: Sequence[str]) -> DataFrame:
    """AGG-06: from rows of pixels (``x``, ``y``, ``v`` of 0 or 255, ``width``, ``height``) the share of black of each picture,
    in its centre, in the bands along its edges (corners count for both), and in its halves; and whether that is a ring."""
    w, h, x, y = (F.col(c) for c in ("width", "height", "x", "y"))
    black = (F.col("v") == 0).cast("int")
    band = F.greatest(F.lit(1), (F.least(w, h) * RING_EDGE).cast("int"))
    lo, hi = RING_CENTRE
    centre = (y >= (h * lo).cast("int")) & (y < (h * hi).cast("int")) & (x >= (w * lo).cast("int")) & (x < (w * hi).cast("int"))
    times = sum((t.cast("int") for t in (y < band, y >= h - band, x < band, x >= w - band)), F.lit(0))
    share = lambda part: F.coalesce(F.avg(F.when(part, black)), F.lit(0.0))
    halves = {"left": x < F.floor(w / 2), "right": x >= F.floor(w / 2), "top": y < F.floor(h / 2), "bottom": y >= F.floor(h / 2)}
    m = pixels.groupBy(*keys, "width", "height").agg(
        share(F.lit(True)).alias("ink"), share(centre).alias("centre"), (F.sum(black * times) / F.sum(times)).alias("edge"), *[share(c).alias(n) for n, c in halves.items()]
    )
    ratio = lambda a, b: (F.col(a) / F.greatest(F.col(b), F.lit(1e-6))).between(*RING_BALANCE)
    ring = (F.least(w, h) >= RING_LEAST) & F.col("ink").between(*RING_INK) & (F.col("edge") > F.col("centre") * RING_CONTRAST) & ratio("left", "right") & ratio("top", "bottom")
    return m.withColumn("ring", ring)


# Side of the raster that outlines are judged on, least hole, size of a corner and how much ink makes it one.
RASTER, LEAST_HOLE, CORNER, LEAST_CORNER = 64, 20, 0.18, 0.06


def _spread(mask: np.ndarray) -> np.ndarray:
    """A stack of masks (picture, y, x), each place or-ed with its four neighbours."""
    out = mask.copy()
    out[:, 1:] |= mask[:, :-1]
    out[:, :-1] |= mask[:, 1:]
    out[:, :, 1:] |= mask[:, :, :-1]
    out[:, :, :-1] |= mask[:, :, 1:]
    return out


def _raster(black: np.ndarray) -> np.ndarray:
    """A mask with its ink grown by two places in every direction, at the size of the raster."""
    ink = np.pad(black, 2)
    for axis in (0, 1):
        n = black.shape[axis]
        ink = np.logical_or.reduce([np.take(ink, range(k, k + n), axis=axis) for k in range(5)])
    at = [((np.arange(RASTER) + 0.5) * n / RASTER).astype(int) for n in black.shape]
    return ink[np.ix_(*at)]


def outline_symbols(pictures: Sequence[np.ndarray]) -> list[str | None]:
    """ARR-04, ARR-05: ``○`` or ``□`` for each picture (0 and 255) whose ink encloses background, else None.

    All pictures of a batch are judged at once: background that is connected with the border is found by growing it from
    there until it stays as it is, the rest is the hole; the ink in the corners of the outline tells a square.
    """
    if not len(pictures):
        return []
    ink = np.stack([_raster(np.asarray(a) == 0) for a in pictures])
    outer = np.zeros_like(ink)
    outer[:, [0, -1], :] = outer[:, :, [0, -1]] = True
    outer &= ~ink
    while True:
        grown = _spread(outer) & ~ink
        if (grown == outer).all():
            break
        outer = grown
    hole = (~ink & ~outer).sum(axis=(1, 2))
    # ink of every rectangle from its corner sums
    total = np.zeros((len(ink), RASTER + 1, RASTER + 1), np.int64)
    total[:, 1:, 1:] = ink.cumsum(axis=1).cumsum(axis=2)
    ends = lambda m: (m.argmax(axis=1), RASTER - 1 - m[:, ::-1].argmax(axis=1))
    (top, bottom), (left, right) = ends(ink.any(axis=2)), ends(ink.any(axis=1))
    side = np.maximum(2, np.rint(np.minimum(right - left + 1, bottom - top + 1) * CORNER).astype(int))
    density, n = np.zeros(len(ink)), np.arange(len(ink))
    for y in (top, np.maximum(0, bottom - side + 1)):
        for x in (left, np.maximum(0, right - side + 1)):
            v, u = np.minimum(y + side, RASTER), np.minimum(x + side, RASTER)
            density += (total[n, v, u] - total[n, y, u] - total[n, v, x] + total[n, y, x]) / ((v - y) * (u - x)) / 4
    return [None if a < LEAST_HOLE or not b else "□" if c >= LEAST_CORNER else "○" for a, b, c in zip(hole, ink.any(axis=(1, 2)), density)]


def filtered(a: np.ndarray, kind: str, size: int = 3, percent: int = 120, threshold: int = 3) -> np.ndarray:
    """ARR-05: minimum and median filters over squares, an unsharp mask over the mean of a square, and a sharpening by a
    factor of ``percent``; edges are repeated."""
    h = size // 2
    p = np.pad(a.astype(float), h, mode="edge")
    stack = np.stack([p[i : i + a.shape[0], j : j + a.shape[1]] for i in range(size) for j in range(size)])
    if kind == "min":
        return stack.min(0).astype(a.dtype)
    if kind == "median":
        return np.median(stack, 0).astype(a.dtype)
    if kind == "unsharp":
        d = a - stack.mean(0)
        return np.clip(np.where(np.abs(d) >= threshold, a + d * percent / 100, a), 0, 255).astype(a.dtype)
    if kind == "sharpen":  # away from a smoothed picture whose centre weighs five times its neighbours
        weight = np.ones(size * size)
        weight[len(weight) // 2] = 5
        smooth = np.tensordot(weight / weight.sum(), stack, 1)
        return np.clip(np.rint(smooth + (a - smooth) * percent / 100), 0, 255).astype(a.dtype)
    raise ValueError(f"unknown filter: {kind}")


def symbols(crops: DataFrame, keys: Sequence[str], threshold: int = 235, min_black: float = 0.012) -> DataFrame:
    """ARR-09, JON-08: the symbol drawn in each crop (``width``, ``height``, ``pixels`` in grey), or null."""
    types = dict(crops.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out: list[str | None] = [None] * len(pdf)
            some = {}
            for k, (w, h, px) in enumerate(zip(pdf["width"], pdf["height"], pdf["pixels"])):
                if px is None or not len(px) or len(px) != w * h:
                    continue
                a = np.asarray(px, dtype=float).reshape(h, w)
                lo, hi = a.min(), a.max()
                a = np.floor((a - lo) * 255 / (hi - lo)) if hi > lo else a
                if (a < 210).mean() >= min_black:
                    some[k] = np.where(a < threshold, 0, 255)
            for k, symbol in zip(some, outline_symbols(list(some.values()))):
                out[k] = symbol
            yield pdf[list(keys)].assign(symbol=out)

    return crops.select(*keys, "width", "height", "pixels").mapInPandas(run, ", ".join(f"`{k}` {types[k]}" for k in keys) + ", symbol string")


def filtered_pixels(pictures: DataFrame, keys: Sequence[str], kind: str, size: int = 3) -> DataFrame:
    """ARR-05 on rows of ``width``, ``height`` and ``pixels`` (grey, row by row); pictures of another size than said are null."""
    types = dict(pictures.dtypes)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            out = [filtered(np.asarray(px).reshape(h, w), kind, size).ravel() if px is not None and len(px) and len(px) == w * h else None for w, h, px in zip(pdf["width"], pdf["height"], pdf["pixels"])]
            yield pdf[[*keys, "width", "height"]].assign(pixels=out)

    head = ", ".join(f"`{k}` {types[k]}" for k in (*keys, "width", "height"))
    return pictures.select(*keys, "width", "height", "pixels").mapInPandas(run, f"{head}, pixels array<int>")


def fill_empty_cells(cells: DataFrame, found: DataFrame, keys: Sequence[str]) -> DataFrame:
    """JON-08: empty cells get the symbol found at their place."""
    return cells.join(found.select(*keys, "symbol"), list(keys), "left").withColumn("text", F.when(F.trim(F.coalesce("text", F.lit(""))) == "", F.coalesce("symbol", "text")).otherwise(F.col("text"))).drop("symbol")


def cell_crops(cells: DataFrame) -> DataFrame:
    """JON-08, TYP-05: the inner rectangle of every empty cell that has a box."""
    empty = F.trim(F.coalesce("text", F.lit(""))) == ""
    return cells.where(empty & (F.size("box") == 4)).withColumn("crop", inner(F.col("box")))


def png_size(content: Column) -> Column:
    """SRC-19: width, height and area from the header of a PNG file; null for other files."""
    h = F.hex(F.substring(content, 1, 24))
    w, t = (F.conv(F.substring(h, a, 8), 16, 10).cast("bigint") for a in (33, 41))
    return F.when(h.startswith("89504E470D0A1A0A"), F.struct(w.alias("width"), t.alias("height"), (w * t).alias("area")))


def variants(images: DataFrame, profiles: DataFrame) -> DataFrame:
    """ORC-11: every image by every profile (a table of a few rows), with the size it gets."""
    from ..functions.geometry import colour_mode

    scale = F.col("target_long_edge") / F.greatest("width", "height")
    size = F.when(F.greatest("width", "height") == F.col("target_long_edge"), F.array("width", "height")).otherwise(F.array((F.col("width") * scale).cast("int"), (F.col("height") * scale).cast("int")))
    # each image becomes one row per profile: no pairing of two large sides
    listed = profiles.agg(F.collect_list(F.struct(*profiles.columns)).alias("p")).first()["p"]
    every = images.withColumn("p", F.explode(F.array(*[F.struct(*[F.lit(r[c]).alias(c) for c in profiles.columns]) for r in listed])))
    return every.select(*images.columns, "p.*").withColumn("mode", colour_mode(F.col("grayscale"), F.col("keep_color"))).withColumn("size", size)
