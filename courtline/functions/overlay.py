"""Court overlays from four keypoints: court dimensions, paint quads, the homography of a quad in closed form, and its score."""

from __future__ import annotations

from dataclasses import dataclass
from itertools import permutations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql.types import IntegerType, LongType, StringType, StructType


@dataclass(frozen=True)
class Court:
    """Metres; x runs along the length of a full court, and along the base line of a half one."""

    layout: str
    length: float
    width: float
    paint_width: float
    free_throw: float


# The two rule books' courts.
FIBA = Court("full", 28.0, 15.0, 4.9, 5.8)
NBA = Court("full", 28.65, 15.24, 4.88, 5.79)
#: Pixels of the picture that the least paint area is given for, and that area.
REFERENCE, LEAST_PAINT = 640.0 * 360.0, 8.0


def paint_quads(court: Court) -> list[list[tuple[float, float]]]:
    """Corners of each paint: left and right on the base line, right and left on the free-throw line."""
    c, half = court, court.paint_width / 2
    if c.layout == "half":
        lo, hi = c.length / 2 - half, c.length / 2 + half
        return [[(lo, 0.0), (hi, 0.0), (hi, c.free_throw), (lo, c.free_throw)]]
    lo, hi = c.width / 2 - half, c.width / 2 + half
    return [[(base, lo), (base, hi), (line, hi), (line, lo)] for base, line in ((0.0, c.free_throw), (c.length, c.length - c.free_throw))]


def in_paint(court: Court, quad: list[tuple[float, float]], point: tuple[float, float]) -> tuple[float, float]:
    """The point in the paint's own axes, where its corners are (0, 0), (1, 0), (1, 1) and (0, 1)."""
    (ox, oy), along, away = quad[0], (quad[1][0] - quad[0][0], quad[1][1] - quad[0][1]), (quad[3][0] - quad[0][0], quad[3][1] - quad[0][1])
    d = (point[0] - ox, point[1] - oy)
    return tuple((d[0] * v[0] + d[1] * v[1]) / (v[0] ** 2 + v[1] ** 2) for v in (along, away))


def outline(court: Court) -> list[tuple[float, float]]:
    return [(0.0, 0.0), (court.length, 0.0), (court.length, court.width), (0.0, court.width)]


def signed_area(points: list[tuple]):
    """Half the sum of cross products: of numbers, or of columns."""
    return sum(x * points[(k + 1) % len(points)][1] - points[(k + 1) % len(points)][0] * y for k, (x, y) in enumerate(points)) * 0.5


def scores(court: Court, quad: int, points: np.ndarray, width: float, height: float) -> np.ndarray:
    """Score of each row of four points (rows x 4 x 2, pixels) as the corners of a paint; minus infinity for what can't be.

    The outline's corners near the picture, the areas, and the way round count. Impossible are fewer than three corners near,
    a tiny paint, a court hardly larger than it, and three points on a line. The homography takes the paint's (0, 0), (1, 0),
    (1, 1), (0, 1) to the four points, in closed form.
    """
    x, y = [points[:, k, 0] for k in range(4)], [points[:, k, 1] for k in range(4)]
    paint = paint_quads(court)[quad]
    with np.errstate(divide="ignore", invalid="ignore"):
        dx1, dx2, dy1, dy2 = x[1] - x[2], x[3] - x[2], y[1] - y[2], y[3] - y[2]
        sx, sy = (v[0] - v[1] + v[2] - v[3] for v in (x, y))
        det = dx1 * dy2 - dx2 * dy1
        det = np.where(det == 0, np.nan, det)
        g, h = (sx * dy2 - dx2 * sy) / det, (dx1 * sy - sx * dy1) / det
        corners = []
        for u, v in (in_paint(court, paint, p) for p in outline(court)):
            w = g * u + h * v + 1.0
            w = np.where(w == 0, np.nan, w)
            corners.append(tuple(((z[1] - z[0] + g * z[1]) * u + (z[3] - z[0] + h * z[3]) * v + z[0]) / w for z in (x, y)))
        inside = sum(((p > -0.25 * width) & (p < 1.25 * width) & (q > -0.25 * height) & (q < 1.25 * height)).astype(int) for p, q in corners)
        own, whole = signed_area([*zip(x, y, strict=True)]), np.abs(signed_area(corners))
        good = (inside >= 3) & (np.abs(own) >= LEAST_PAINT * width * height / REFERENCE) & (whole >= np.abs(own) * 1.15)
        value = inside * 10.0 + np.minimum(whole / (width * height), 2.0) * 5.0 + whole / np.abs(own) + np.where(own * signed_area(paint) > 0, 20.0, 0.0)
    return np.where(good, value, -np.inf)


def best_fits(rows: DataFrame, keys: list[str], xs: str, ys: str, court: Court, width: float, height: float, orders: list[tuple[int, ...]] | None = None) -> DataFrame:
    """(keys, cost, paint, keypoints): of all paints and orders of four keypoints (arrays `xs` and `ys`) the best, the first of
    equals; rows without a possible one are left out. The cost is the score in millionths, negated.

    Rows are independent, so nothing is shuffled; a batch is scored as arrays, as 48 candidates of a row in column
    expressions are planned for minutes.
    """
    tried = [(q, order) for q in range(len(paint_quads(court))) for order in orders or permutations(range(4))]
    schema = StructType([rows.schema[k] for k in keys]).add("cost", LongType()).add("paint", IntegerType()).add("keypoints", StringType())

    def run(batches):
        for part in batches:
            points = np.stack([np.array([*part[xs]], float).reshape(-1, 4), np.array([*part[ys]], float).reshape(-1, 4)], 2)
            value = np.stack([scores(court, q, points[:, order], width, height) for q, order in tried], 1)
            cost = np.floor(-value * 1000000 + 0.5)
            best, some = cost.argmin(1), cost.min(1) <= 0
            made = part.loc[some, keys].assign(cost=cost.min(1)[some].astype("int64"))
            yield made.assign(paint=[tried[k][0] for k in best[some]], keypoints=[",".join(map(str, tried[k][1])) for k in best[some]])

    return rows.select(*keys, xs, ys).where(f"{xs} IS NOT NULL AND {ys} IS NOT NULL").mapInPandas(run, schema)
