"""Boxes, polygons and plane transforms as column expressions."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F


def box_iou(a: Sequence[Column], b: Sequence[Column]) -> Column:
    """Intersection over union of corner boxes; 0 without overlap or area."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda x: F.greatest(x[2] - x[0], F.lit(0.0)) * F.greatest(x[3] - x[1], F.lit(0.0))
    union = area(a) + area(b) - w * h
    return F.when(union > 0, w * h / union).otherwise(0.0)


def in_polygon(x: Column, y: Column, corners: Sequence[tuple[float, float]]) -> Column:
    """Ray casting by the parity of crossed edges; fewer than three corners hold every point."""
    if len(corners) < 3:
        return F.lit(True)
    inside = F.lit(False)
    for (ax, ay), (bx, by) in zip(corners, [corners[-1], *corners[:-1]], strict=True):
        crossing = ((F.lit(ay) > y) != (F.lit(by) > y)) & (x < F.lit(bx - ax) * (y - ay) / F.lit(by - ay + 1e-12) + ax)
        inside = inside != crossing
    return inside


def project(x: Column, y: Column, h: Sequence[float]) -> tuple[Column, Column]:
    """A point through a 3x3 homography in row order; null where the third coordinate vanishes."""
    w = h[6] * x + h[7] * y + h[8]
    ok = F.abs(w) > 1e-12
    return F.when(ok, (h[0] * x + h[1] * y + h[2]) / w), F.when(ok, (h[3] * x + h[4] * y + h[5]) / w)


def within_court(x: Column, y: Column, length: float, width: float, margin: float) -> Column:
    return x.between(-margin, length + margin) & y.between(-margin, width + margin)


def similarity(tx: float = 0, ty: float = 0, degrees: float = 0, scale: float = 1, flip_x: bool = False, pivot: tuple[float, float] = (0, 0)) -> list[float]:
    """Matrix (row order) that flips, scales and turns about a pivot, then shifts."""
    c, s = math.cos(math.radians(degrees)) * scale, math.sin(math.radians(degrees)) * scale
    to, back = np.array([[1, 0, -pivot[0]], [0, 1, -pivot[1]], [0, 0, 1.0]]), np.array([[1, 0, pivot[0]], [0, 1, pivot[1]], [0, 0, 1.0]])
    turn, flip = np.array([[c, -s, 0], [s, c, 0], [0, 0, 1.0]]), np.diag([-1.0 if flip_x else 1.0, 1.0, 1.0])
    return (np.array([[1, 0, tx], [0, 1, ty], [0, 0, 1.0]]) @ back @ turn @ flip @ to).ravel().tolist()


def solve_homography(source: Sequence[tuple[float, float]], target: Sequence[tuple[float, float]]) -> list[float]:
    """Least-squares homography of four or more point pairs (normalised direct linear transform), last entry 1."""

    def normal(p: np.ndarray) -> np.ndarray:
        mean, spread = p.mean(0), max(np.sqrt(((p - p.mean(0)) ** 2).sum(1)).mean(), 1e-12)
        k = math.sqrt(2) / spread
        return np.array([[k, 0, -k * mean[0]], [0, k, -k * mean[1]], [0, 0, 1]])

    a, b = np.asarray(source, float), np.asarray(target, float)
    if len(a) < 4 or a.shape != b.shape:
        raise ValueError("four or more pairs of points are needed")
    na, nb = normal(a), normal(b)
    pa, pb = np.c_[a, np.ones(len(a))] @ na.T, np.c_[b, np.ones(len(b))] @ nb.T
    zero = np.zeros((len(a), 3))
    rows = np.concatenate([np.c_[-pa, zero, pb[:, :1] * pa], np.c_[zero, -pa, pb[:, 1:2] * pa]])
    h = np.linalg.inv(nb) @ np.linalg.svd(rows)[2][-1].reshape(3, 3) @ na
    return (h / h[2, 2]).ravel().tolist()


def bottom_centre(x1: Column, x2: Column, y2: Column) -> tuple[Column, Column]:
    return (x1 + x2) / 2, y2


def clamp(x: Column, lo: float = 0.0, hi: float = 1.0) -> Column:
    return F.greatest(F.lit(lo), F.least(F.lit(hi), x))
