"""Boxes, regions, segments and poses in normalised picture coordinates, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from courtline.functions.geometry import clamp


def corner_detection(x1: Column, y1: Column, x2: Column, y2: Column, is_person: Column) -> dict[str, Column]:
    """Clamped corners, the centre of the clamped box, and the foot (bottom centre) of persons."""
    a, b, c, d = (clamp(v) for v in (x1, y1, x2, y2))
    cx = (a + c) / 2
    return {"x1": a, "y1": b, "x2": c, "y2": d, "cx": cx, "cy": (b + d) / 2, "foot_x": F.when(is_person, cx), "foot_y": F.when(is_person, d)}


def crop_to_frame(offset: float, inside: Column, crop: float, frame: float) -> Column:
    """A coordinate normalised to a crop (pixels offset, offset + crop) as one normalised to the frame."""
    return (offset + inside * crop) / frame


def flip_vertical(y: Column, h: Column) -> Column:
    """Top of a box whose y was measured from the bottom edge."""
    return 1 - (y + h)


def rim(y: Column, h: Column, offset: float = 0.025) -> Column:
    """Threshold under the rim of a hoop given by its centre and height."""
    return y - h / 2 + offset


def rim_band(w: Column, h: Column, expand: float) -> tuple[Column, Column]:
    """Width and height of the band in which a ball counts as crossing the rim."""
    return w * expand, F.greatest(h * 0.15, F.lit(0.02))


def search_region(x: Column, y: Column, w: Column, h: Column, expand: float = 3.5) -> tuple[Column, Column, Column, Column]:
    """Corners of a centre box grown by `expand`, cut at the picture's edges."""
    dx, dy = w * expand / 2, h * expand / 2
    return clamp(x - dx), clamp(y - dy), clamp(x + dx), clamp(y + dy)


def contains(outer: tuple[Column, ...], inner: tuple[Column, ...], eps: float = 1e-6) -> Column:
    """Whether a corner box lies in another; boxes without area contain nothing and lie in nothing."""
    (a, b, c, d), (p, q, r, s) = outer, inner
    return (c > a) & (d > b) & (r > p) & (s > q) & (p >= a - eps) & (q >= b - eps) & (r <= c + eps) & (s <= d + eps)


def clip_segment(xa: Column, ya: Column, xb: Column, yb: Column) -> tuple[Column, Column]:
    """Parameters (from, to) of the part of a segment inside the unit square, null if it stays outside.

    Each edge bounds the parameter from below or above by the sign of the direction; a segment along an axis is bounded by its place.
    """
    low, high, inside = F.lit(0.0), F.lit(1.0), F.lit(True)
    for start, end in ((xa, xb), (ya, yb)):
        d = end - start
        at0, at1 = F.try_divide(-start, d), F.try_divide(1 - start, d)
        low = F.greatest(low, F.when(d > 0, at0).when(d < 0, at1).otherwise(0.0))
        high = F.least(high, F.when(d > 0, at1).when(d < 0, at0).otherwise(1.0))
        inside = inside & ((d != 0) | start.between(0, 1))
    ok = inside & (low <= high)
    return F.when(ok, low), F.when(ok, high)


def foot_of_pose(left: tuple[Column, Column, Column], right: tuple[Column, Column, Column], box: tuple[Column, Column, Column, Column], least: float = 0.4) -> tuple[Column, Column]:
    """Midpoint of both ankles (x, y, conf) if they are sure and near the box, else the box's bottom centre."""
    x1, y1, x2, y2 = box
    good = F.lit(True)
    for x, y, conf in (left, right):
        good = good & (conf >= least) & x.between(x1 - 0.05, x2 + 0.05) & y.between(y1, F.least(F.lit(1.0), y2 + 0.08))
    return F.when(good, (left[0] + right[0]) / 2).otherwise((x1 + x2) / 2), F.when(good, (left[1] + right[1]) / 2).otherwise(y2)


def torso_box(points: Column, least_conf: float = 0.4, least_points: int = 3, pad: float = 0.12, least_side: float = 4.0) -> Column:
    """Padded box round the sure shoulder and hip points of a 17-point pose in pixels; null if too few points or too small."""
    four = F.array(*[F.try_element_at(points, F.lit(i + 1)) for i in (5, 6, 11, 12)])
    sure = F.filter(four, lambda p: p.isNotNull() & (p["conf"] >= least_conf) & ~((p["x"] <= 0) & (p["y"] <= 0)))
    xs, ys = F.transform(sure, lambda p: p["x"]), F.transform(sure, lambda p: p["y"])
    w, h = F.array_max(xs) - F.array_min(xs), F.array_max(ys) - F.array_min(ys)
    box = F.struct((F.array_min(xs) - w * pad).alias("x1"), (F.array_min(ys) - h * 0.042).alias("y1"), (F.array_max(xs) + w * pad).alias("x2"), (F.array_max(ys) + h * 0.018).alias("y2"))
    return F.when((F.size(sure) >= least_points) & (box["x2"] - box["x1"] >= least_side) & (box["y2"] - box["y1"] >= least_side), box)


def attempt_confidence(speed: Column, up: Column, near: Column, ball: Column, hoop: Column) -> Column:
    """Speed counts three tenths, the signs (up, near, ball, hoop) the rest."""
    signs = 0.3 * up.cast("int") + 0.3 * near.cast("int") + 0.2 * ball + 0.2 * hoop
    return F.round(0.3 * F.least(speed / 0.08, F.lit(1.0)) + 0.7 * signs, 3)


def centre_detection(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float) -> dict[str, Column]:
    """Centre and size of a pixel box in parts of the picture, not clamped."""
    return {"x": (x1 + x2) / 2 / width, "y": (y1 + y2) / 2 / height, "w": (x2 - x1) / width, "h": (y2 - y1) / height}


def region_in_parent(inner: tuple[Column, ...], parent: tuple[Column, ...]) -> tuple[Column, ...]:
    """A top-left region (x, y, w, h) in parts of its parent's."""
    (x, y, w, h), (px, py, pw, ph) = inner, parent
    return (x - px) / pw, (y - py) / ph, w / pw, h / ph


def crop_bounds(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> tuple[Column, ...]:
    """Pixel bounds of a region, cut towards zero and clamped to the picture."""
    return tuple(F.greatest(F.lit(0), F.least(F.lit(size), (v * size).cast("int"))) for v, size in ((x, width), (y, height), (x + w, width), (y + h, height)))


def pixel_box(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> tuple[Column, ...]:
    """Pixel bounds of a region, rounded, halves to even."""
    return tuple(F.bround(v * size).cast("int") for v, size in ((x, width), (y, height), (x + w, width), (y + h, height)))


def roi_pixels(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> tuple[Column, ...]:
    """Pixel corners of a centre box, cut towards zero."""
    return tuple((v * size).cast("int") for v, size in ((x - w / 2, width), (y - h / 2, height), (x + w / 2, width), (y + h / 2, height)))


def segment_points(xa: Column, ya: Column, xb: Column, yb: Column, steps: int = 24) -> Column:
    """Array of evenly spaced points (x, y) of a segment, both ends included."""
    parts = F.array(*[F.lit(k / (steps - 1)) for k in range(steps)])
    return F.transform(parts, lambda t: F.struct(((1 - t) * xa + t * xb).alias("x"), ((1 - t) * ya + t * yb).alias("y")))


def torso_crop(x1: Column, y1: Column, x2: Column, y2: Column, width: float, height: float, inset: float = 0.22, top: float = 0.18, bottom: float = 0.48, least: int = 4) -> Column:
    """Pixel bounds (cx1, cx2, cy1, cy2) of the upper body in a player's box, cut towards zero; null under `least` pixels."""
    left, right, up, down = x1 * width, x2 * width, y1 * height, y2 * height
    sides = (left + (right - left) * inset, right - (right - left) * inset, up + (down - up) * top, up + (down - up) * bottom)
    a, b, c, d = (F.greatest(F.lit(0), F.least(F.lit(int(size)), v.cast("int"))) for v, size in zip(sides, (width, width, height, height), strict=True))
    return F.when((b - a >= least) & (d - c >= least), F.struct(a.alias("cx1"), b.alias("cx2"), c.alias("cy1"), d.alias("cy2")))
