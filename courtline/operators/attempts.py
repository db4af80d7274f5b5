"""Shot attempts: what each row shows of the ball at the rim as columns, and the automaton that takes the rows in order."""

from __future__ import annotations

from dataclasses import dataclass, replace

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.operators import lookback
from courtline.operators.folds import Rearm
from courtline.operators.tracks import by_time, rim_signals


@dataclass(frozen=True)
class Config:
    """Limits of the gates, and how far a hoop may jump and a ball lie off before the side changes."""

    expand: float = 1.5
    exit_depth: float = 0.07
    approach_depth: float = 0.08
    least_below: float = 0.012
    rise: float = 0.005
    cooldown: float = 1.0
    most_jump: float = 0.18
    side_apart: float = 0.12


#: Wheelchair games differ in the stability of hoops only.
PRESETS = {"running": Config(), "wheelchair": replace(Config(), most_jump=0.12, side_apart=0.16)}

_AT_RIM = ("crossed_up", "crossed_down", "rim_tube")


def judged(points: DataFrame, hoop: float, width: float, threshold: float, detected: Column, config: Config = PRESETS["running"]) -> DataFrame:
    """Adds signal (of the five, the first that holds), candidate (all gates hold but the automaton's), low, speed, up and near.

    A track's first row is no candidate. Under a rim signal the ball may be deeper under the rim, and need not come nearer
    once it is within the widened half width.
    """
    c, half = config, width / 2 * config.expand
    x, y, valid = F.col("px"), F.col("py"), F.col("conf") >= 0.2
    rows = lookback.converging(lookback.resumed(rim_signals(points, threshold), valid, detected), F.abs(x - hoop), valid, half)
    risen = F.coalesce((F.col("deepest") >= threshold + c.least_below) & (y <= F.col("deepest") - c.rise), F.lit(False))
    resume = F.col("resumed") & (y <= threshold + c.approach_depth) & risen
    approach = lookback.approaching(y, F.col("deepest"), threshold, valid, c.approach_depth, c.least_below, c.rise)
    w = by_time()
    vx, vy = (F.coalesce((F.col(k) - F.lag(k, 2).over(w)) / 2, F.lit(0.0)) for k in ("px", "py"))
    rows = rows.withColumns({
        "signal": F.coalesce("signal", F.when(approach, "approach").when(resume, "resume")),
        "up": F.coalesce(y < F.lag("py").over(w), F.lit(False)), "__n": F.row_number().over(w), "vx": vx, "vy": vy,
    })
    at_rim = F.coalesce(F.col("signal").isin(*_AT_RIM), F.lit(False))
    close = lookback.near_hoop(x, y, hoop, width, threshold, at_rim, c.expand, relaxed_depth=c.approach_depth)
    inside = F.abs(x - hoop) <= half
    candidate = valid & (F.col("__n") > 1) & F.col("signal").isNotNull() & close & ((at_rim & inside) | F.col("converging"))
    return rows.withColumns({
        "near": inside, "candidate": candidate, "low": valid & (y > threshold + c.exit_depth), "speed": F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")),
    }).drop("__n", "vx", "vy")


def shot_attempts(rows: DataFrame, threshold: float, cooldown: float, exit_depth: float = PRESETS["running"].exit_depth) -> DataFrame:
    """Rows of `judged` that the automaton accepts. Only rows that may change its state reach it: candidates, and the first
    of each run of low rows, some few of a track, which is one task's as its state passes from row to row."""
    matters = rows.where("candidate OR low").withColumn("__before", F.lag("candidate").over(by_time()))
    matters = matters.where("candidate OR coalesce(__before, true)").drop("__before")

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part, state = part.sort_values(["t", "frame"]), Rearm(threshold, exit_depth, cooldown)
        return part.loc[[state.step(t, y, True, s) for t, y, s in zip(part.t, part.py, part.candidate, strict=True)]]

    return matters.groupBy("track_id").applyInPandas(run, matters.schema)
