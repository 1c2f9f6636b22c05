"""Boxes, crops, sizes and tone curves. A box is an array of left, top, right, bottom."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, fields, replace

from pyspark.sql import Column
from pyspark.sql import functions as F


def polygon_box(points: Column) -> Column:
    """AGG-09: the box around the points of a polygon that has four or more, else null. Null points are left out."""
    p = F.filter(points, lambda x: x.isNotNull() & (F.size(x) >= 2))
    xs, ys = F.transform(p, lambda x: x[0]), F.transform(p, lambda x: x[1])
    return F.when(F.size(points) >= 4, F.array(F.array_min(xs), F.array_min(ys), F.array_max(xs), F.array_max(ys)))


def upright(box: Column) -> Column:
    """A box with its sides in order; null unless it has four."""
    b = [F.get(box, F.lit(k)) for k in range(4)]
    return F.when(F.size(box) == 4, F.array(F.least(b[0], b[2]), F.least(b[1], b[3]), F.greatest(b[0], b[2]), F.greatest(b[1], b[3])))


def aspect(box: Column) -> Column:
    w, h = F.greatest(F.lit(1), box[2] - box[0]), F.greatest(F.lit(1), box[3] - box[1])
    return F.greatest(w / h, h / w)


def padded(box: Column, padding: int, width: Column, height: Column) -> Column:
    """TYP-04."""
    return F.array(F.greatest(F.lit(0), box[0] - padding), F.greatest(F.lit(0), box[1] - padding), F.least(width, box[2] + padding), F.least(height, box[3] + padding))


def inner(box: Column, margin: float = 0.18) -> Column:
    """TYP-05: the box without a margin, or the box itself where nothing would be left."""
    m = [F.greatest(F.lit(1), F.bround(F.greatest(F.lit(1), box[k + 2] - box[k]) * F.lit(margin)).cast("int")) for k in (0, 1)]
    cut = F.array(box[0] + m[0], box[1] + m[1], box[2] - m[0], box[3] - m[1])
    return F.when((cut[2] <= cut[0]) | (cut[3] <= cut[1]), box).otherwise(cut)


def parse_crop(text: Column) -> Column:
    """TYP-02: ``l,t,w,h`` within 0 to 1 as a struct of doubles; null if there are not four numbers or nothing is left."""
    p = F.split(text, ",")
    v = [F.trim(F.get(p, F.lit(k))).try_cast("double") for k in range(4)]
    left, top = (F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)) for x in v[:2])
    width, height = F.least(F.greatest(F.lit(0.0), v[2]), 1.0 - left), F.least(F.greatest(F.lit(0.0), v[3]), 1.0 - top)
    ok = (F.size(p) == 4) & v[0].isNotNull() & v[1].isNotNull() & v[2].isNotNull() & v[3].isNotNull()
    return F.when(ok & (width > 0) & (height > 0), F.struct(left.alias("left"), top.alias("top"), width.alias("width"), height.alias("height")))


def crop_pixels(crop: Column, width: Column, height: Column) -> Column:
    """TYP-03: a relative crop as pixels, halves to the even side."""
    r = lambda x: F.bround(x).cast("int")
    left, top = r(crop["left"] * width), r(crop["top"] * height)
    return F.array(left, top, r((crop["left"] + crop["width"]) * width), r((crop["top"] + crop["height"]) * height))


def resized(width: Column, height: Column, target: int) -> Column:
    """TYP-06 for recognition: the long edge at ``target``, truncating, smaller images grown."""
    scale = F.lit(float(target)) / F.greatest(width, height)
    new = F.array((width * scale).cast("int"), (height * scale).cast("int"))
    return F.when(F.lit(target <= 0) | (F.greatest(width, height) == target), F.array(width, height)).otherwise(new)


def preview_size(width: Column, height: Column, target: int) -> Column:
    """TYP-06 for previews: never grown, rounded, one pixel at least."""
    scale = F.lit(float(target)) / F.greatest(width, height)
    new = F.array(*[F.greatest(F.lit(1), F.bround(x * scale).cast("int")) for x in (width, height)])
    return F.when(F.lit(target <= 0) | (F.greatest(width, height) <= target), F.array(width, height)).otherwise(new)


def gamma_curve(gamma: float) -> Column:
    """TYP-07: the 256 values of a gamma curve."""
    return F.transform(F.sequence(F.lit(0), F.lit(255)), lambda i: F.least(F.lit(255), (F.pow(i / 255.0, F.lit(1.0 / gamma)) * 255 + 0.5).cast("int")))


def luma(r: Column, g: Column, b: Column) -> Column:
    """ARR-10: grey value of a colour."""
    return ((r * 299 + g * 587 + b * 114) / 1000).cast("int")


def binarized(pixels: Column, threshold: int = 210) -> Column:
    """ARR-08: contrast stretched to the whole range, then black below the threshold."""
    lo, hi = F.array_min(pixels), F.array_max(pixels)
    stretch = lambda p: F.when(hi > lo, ((p - lo) * 255.0 / (hi - lo)).cast("int")).otherwise(p)
    return F.transform(pixels, lambda p: F.when(stretch(p) < threshold, 0).otherwise(255))


def median_threshold(pixels: Column) -> Column:
    """AGG-07: the upper median plus ten, within 110 and 200."""
    return F.greatest(F.lit(110), F.least(F.lit(200), F.element_at(F.array_sort(pixels), (F.size(pixels) / 2).cast("int") + 1) + 10))


def colour_mode(grayscale: Column, keep_color: Column) -> Column:
    """ARR-10."""
    return F.when(grayscale & ~keep_color, "L").otherwise("RGB")


@dataclass(frozen=True)
class Profile:
    """ORC-20: how an image variant is made. The three profiles below."""

    key: str
    target_long_edge: int = 2400
    grayscale: bool = True
    keep_color: bool = False
    contrast: float = 1.0
    brightness: float = 1.0
    sharpness: float = 1.0
    denoise_size: int = 0
    binarize: bool = False
    gamma: float | None = None
    clahe: bool = False


PROFILES = {
    p.key: p
    for p in (
        Profile("ocr_default", 2600, True, False, 1.35, 1.05, 1.15, 3, True),
        Profile("presentation_color", 2600, False, True, 1.1, 1.0, 1.05, 3, False),
        Profile("chalkboard_strong", 2800, True, False, 2.2, 1.0, 1.2, 5, True, 0.7, True),
    )
}


def get_profile(key: str) -> Profile:
    if key not in PROFILES:
        raise KeyError(f"unknown profile: {key}")
    return PROFILES[key]


@dataclass(frozen=True)
class IconRules:
    """ORC-15: thresholds of the decision about figures. The defaults."""

    policy: str = "auto"
    max_width: int = 1000
    max_height: int = 1000
    max_area: int = 1_000_000
    max_width_ratio: float = 0.35
    max_height_ratio: float = 0.25
    max_area_ratio: float = 0.1
    auto_drop_area: int = 2_500
    auto_drop_area_ratio: float = 0.002
    auto_drop_unique_colors: int = 20
    auto_drop_avg_std: float = 10.0
    likely_area: int = 100_000
    likely_area_ratio: float = 0.1
    likely_unique_colors: int = 80
    likely_avg_std: float = 18.0
    likely_dominant_ratio: float = 0.7
    whitespace_mean_luma: float = 245.0
    whitespace_non_white_ratio: float = 0.05
    max_color_samples: int = 4_096

    def with_(self, **changes: object) -> IconRules:
        """Unknown names are refused."""
        unknown = set(changes) - {f.name for f in fields(self)}
        if unknown:
            raise ValueError(f"unknown settings: {sorted(unknown)}")
        return replace(self, **changes)  # type: ignore[arg-type]

    @classmethod
    def layered(cls, *layers: dict[str, object] | str) -> tuple[IconRules, list[str]]:
        """SET-05, ORC-22: later layers win; names that are not known are left out and reported."""
        known = {f.name for f in fields(cls)}
        out, unknown = asdict(cls()), []
        for layer in layers:
            layer = json.loads(layer) if isinstance(layer, str) else layer
            for k, v in layer.items():
                if k in known:
                    out[k] = v
                else:
                    unknown.append(k)
        return cls(**out), unknown


def icon_decision(s: Column, c: IconRules = IconRules()) -> Column:
    """PRD-13 on a struct of figure statistics."""
    large = (s["width"] > c.max_width) | (s["height"] > c.max_height) | (s["area"] > c.max_area) | (s["width_ratio"] > c.max_width_ratio) | (s["height_ratio"] > c.max_height_ratio) | (s["area_ratio"] > c.max_area_ratio)
    white = (s["mean_luma"] >= c.whitespace_mean_luma) & (s["non_white_ratio"] <= c.whitespace_non_white_ratio)
    drop = (s["area"] <= c.auto_drop_area) & (s["area_ratio"] <= c.auto_drop_area_ratio) & (s["unique_colors"] <= c.auto_drop_unique_colors) & (s["avg_std"] <= c.auto_drop_avg_std)
    likely = (s["area"] <= c.likely_area) & (s["area_ratio"] <= c.likely_area_ratio) & ((s["unique_colors"] <= c.likely_unique_colors) | (s["dominant_ratio"] >= c.likely_dominant_ratio)) & (s["avg_std"] <= c.likely_avg_std)
    return F.when((s["area"] == 0) | large, "keep").when(white, "too_whitespace").when(drop, "auto_drop").when(likely, "likely_icon").otherwise("keep")


def icon_removed(decision: Column, c: IconRules = IconRules()) -> Column:
    """PRD-14."""
    if c.policy == "keep":
        return F.lit(False)
    return decision.isin("auto_drop", "too_whitespace", *(["likely_icon"] if c.policy == "auto" else []))
