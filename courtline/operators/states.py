"""Stateful folds of a video's frames: smoothed quads, the hoop in play, a gated ball filter."""

from __future__ import annotations

from collections.abc import Callable, Iterable
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

Point = tuple[float, float]


@dataclass
class QuadSmoother:
    """Follows a quad by a moving average and adopts it only when it has drifted, over a ramp of frames.

    Drift is the mean distance of the corners. Three drifts of `limit` adopt at once (two frames); one drift that lasts for
    `patience` usable frames adopts slowly (eight). Frames without a usable quad move a ramp on and change nothing else.
    """

    alpha: float = 0.25
    limit: float = 0.012
    patience: int = 3
    average: np.ndarray | None = None
    shown: np.ndarray | None = None
    count: int = 0
    left: int = 0
    target: np.ndarray | None = field(default=None, repr=False)

    def step(self, quad: Iterable[Point] | None) -> np.ndarray | None:
        if quad is not None:
            q = np.asarray(quad, float)
            self.average = q if self.average is None else self.alpha * q + (1 - self.alpha) * self.average
            if self.shown is None:
                self.shown = self.average
            elif not self.left:
                self._decide()
        if self.left:
            self.shown = self.shown + (self.target - self.shown) / self.left
            self.left -= 1
        return self.shown

    def _decide(self) -> None:
        drift = float(np.hypot(*(self.average - self.shown).T).mean())
        self.count = self.count + 1 if drift >= self.limit else 0
        frames = 2 if drift >= 3 * self.limit else 8 if self.count >= self.patience else 0
        if frames:
            self.target, self.left, self.count = self.average, frames, 0


@dataclass
class ActiveHoop:
    """The hoop in play: what is detected, unless it jumps on its own side of the midline; else, for a ball that is seen, the last good
    hoop of the ball's side, if ball and hoop belong to one court hoop, for up to `hold` frames a side (0: for good); else the
    court hoop nearest to the ball, or the one before without a ball."""

    court: list[float]
    jump: float = 0.15
    hold: int = 0
    apart: float = 0.20
    anchors: dict[bool, float] = field(default_factory=dict)
    held: dict[bool, int] = field(default_factory=dict)
    index: int = 0

    def _nearest(self, x: float) -> int:
        return min(range(len(self.court)), key=lambda k: abs(self.court[k] - x))

    def _right(self, x: float) -> bool:
        return x >= (self.court[0] + self.court[-1]) / 2

    def _kept(self, ball: float) -> float | None:
        side = self._right(ball)
        anchor = self.anchors.get(side)
        if anchor is None:
            return None
        if not (self._nearest(ball) == self._nearest(anchor) if len(self.court) > 1 else abs(ball - anchor) <= self.apart):
            return None
        used = self.held.get(side, 0)
        goes_on = self.hold <= 0 or used < self.hold
        self.held[side] = used + 1 if goes_on else 0
        return anchor if goes_on else None

    def step(self, ball: float | None, seen: float | None) -> tuple[int, float]:
        if seen is not None and abs(seen - self.anchors.get(self._right(seen), seen)) <= self.jump:
            self.anchors[self._right(seen)], self.held[self._right(seen)] = seen, 0
            self.index = self._nearest(seen)
            return self.index, seen
        if ball is not None:
            kept = self._kept(ball)
            if kept is not None:
                return self._nearest(kept), kept
            self.index = self._nearest(ball)
        return self.index, self.court[self.index]


class GatedBall:
    """Constant-velocity filter that shows filtered places, locks anew when the ball is beyond the gate, and gives up after some misses."""

    def __init__(self, gate: float = 0.18, misses: int = 12) -> None:
        self.gate, self.misses, self.missed = gate, misses, 0
        self.q, self.r = np.diag([0.02, 0.02, 0.08, 0.08]), 0.04 * np.eye(2)
        self.x: np.ndarray | None = None
        self.p = np.eye(4)

    def _lock(self, at: Point) -> None:
        self.x, self.p, self.missed = np.array([*at, 0.0, 0.0]), np.eye(4), 0

    def step(self, at: Point | None, dt: float) -> tuple[float, float, bool] | None:
        """x, y and whether they were predicted; None without a lock."""
        if self.x is None:
            if at is None:
                return None
            self._lock(at)
            return *at, False
        a = np.eye(4)
        a[0, 2] = a[1, 3] = dt
        self.x, self.p = a @ self.x, a @ self.p @ a.T + self.q
        if at is None:
            self.missed += 1
            if self.missed > self.misses:
                self.x = None
                return None
        elif np.hypot(*(np.array(at) - self.x[:2])) > self.gate:
            self._lock(at)
        else:
            gain = self.p[:, :2] @ np.linalg.inv(self.p[:2, :2] + self.r)
            self.x, self.p, self.missed = self.x + gain @ (np.array(at) - self.x[:2]), self.p - gain @ self.p[:2], 0
        x, y = np.clip(self.x[:2], 0, 1)
        return float(x), float(y), at is None


def fold(rows: DataFrame, key: str, order: list[str], run: Callable[[pd.DataFrame], pd.DataFrame], schema: str) -> DataFrame:
    """Applies `run` to each key's rows in order. One key's rows make one task's input, as its state runs through them all."""
    return rows.groupBy(key).applyInPandas(lambda part: run(part.sort_values(order)), schema)


def smooth_quads(rows: DataFrame) -> DataFrame:
    """(track_id, frame, quad) from (track_id, t, frame, quad), quad an array of x, y, x, y, ... or null."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        state, shown = QuadSmoother(), []
        for q in part.quad:
            out = state.step(None if q is None else np.reshape(np.asarray(q, float), (-1, 2)))
            shown.append(None if out is None else out.ravel().tolist())
        return part.assign(quad=shown)[["track_id", "frame", "quad"]]

    return fold(rows.select("track_id", "t", "frame", "quad"), "track_id", ["t", "frame"], run, "track_id bigint, frame bigint, quad array<double>")


def active_hoops(rows: DataFrame, court: list[float], hold: int = 0) -> DataFrame:
    """(track_id, frame, hoop, x) from (track_id, t, frame, ball, seen)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        state = ActiveHoop(court, hold=hold)
        made = [state.step(*(None if pd.isna(v) else float(v) for v in pair)) for pair in zip(part.ball, part.seen, strict=True)]
        return part.assign(hoop=[m[0] for m in made], x=[m[1] for m in made])[["track_id", "frame", "hoop", "x"]]

    return fold(rows.select("track_id", "t", "frame", "ball", "seen"), "track_id", ["t", "frame"], run, "track_id bigint, frame bigint, hoop int, x double")


def gated_ball(rows: DataFrame, dt: float = 0.1, least_conf: float = 0.2) -> DataFrame:
    """(track_id, frame, x, y, predicted) of the frames with a lock, from (track_id, t, frame, px, py, conf)."""

    def run(part: pd.DataFrame) -> pd.DataFrame:
        state, made = GatedBall(), []
        for i, f, x, y, c in zip(part.track_id, part.frame, part.px, part.py, part.conf, strict=True):
            if (out := state.step((x, y) if c >= least_conf else None, dt)) is not None:
                made.append((i, f, *out))
        return pd.DataFrame(made, columns=["track_id", "frame", "x", "y", "predicted"])

    return fold(rows.select("track_id", "t", "frame", "px", "py", "conf"), "track_id", ["t", "frame"], run, "track_id bigint, frame bigint, x double, y double, predicted boolean")
