"""Ordered operators over track points: gaps, filling, smoothing, cadence, folds, sessions."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

def by_time():
    return Window.partitionBy("track_id").orderBy("t", "frame")



def gaps(points: DataFrame, longest: float) -> DataFrame:
    """Pairs of neighbouring points of a track that lie more than `longest` apart."""
    return points.withColumn("t_start", F.lag("t").over(by_time())).where(F.col("t") - F.col("t_start") > longest).select("track_id", "t_start", F.col("t").alias("t_end"), "frame")


def fill_gaps(points: DataFrame, step: float, longest: float, columns: tuple[str, ...] = ("px", "py")) -> DataFrame:
    """Adds evenly spaced points between neighbours that are over 1.5 steps and at most `longest` apart."""
    ahead = points.withColumn("next_t", F.lead("t").over(by_time()))
    for c in columns:
        ahead = ahead.withColumn(f"next_{c}", F.lead(c).over(by_time()))
    dt = F.col("next_t") - F.col("t")
    steps = F.when((dt > 1.5 * step) & (dt <= longest), F.bround(dt / step).cast("int")).otherwise(1)
    places = F.when(steps > 1, F.sequence(F.lit(0), steps - 1)).otherwise(F.array(F.lit(0)))
    rows = ahead.withColumn("steps", steps).withColumn("i", F.explode(places))
    share = F.col("i") / F.col("steps")
    lerp = lambda c: F.when(F.col("i") == 0, F.col(c)).otherwise(F.col(c) + (F.col(f"next_{c}") - F.col(c)) * share)
    return rows.select("track_id", lerp("t").alias("t"), "frame", "i", *[lerp(c).alias(c) for c in columns], (F.col("i") > 0).alias("interpolated"))


def keep_long(points: DataFrame, least: int) -> DataFrame:
    """Tracks of `least` points or more; the count is an aggregate that joins back, so long tracks may be split."""
    sizes = points.groupBy("track_id").agg(F.count("*").alias("n")).where(F.col("n") >= least).select("track_id")
    return points.join(sizes, "track_id", "left_semi")


def smooth(points: DataFrame, window: int = 5, columns: tuple[str, ...] = ("px", "py")) -> DataFrame:
    """Centred moving averages, cut at the ends of a track; tracks of fewer than three points stay as they are."""
    order = Window.partitionBy("track_id").orderBy("t", "frame", "i")
    whole, half = Window.partitionBy("track_id"), window // 2
    enough = (F.count("*").over(whole) >= 3) & F.lit(window >= 3)
    out = points.withColumn("smoothed", enough)
    for c in columns:
        out = out.withColumn(f"s_{c}", F.when(enough, F.avg(c).over(order.rowsBetween(-half, half))).otherwise(F.col(c)))
    return out


def cadence(points: DataFrame, every: int) -> DataFrame:
    return points.withColumn("seen", F.row_number().over(by_time())).where((F.col("seen") - 1) % every == 0)


def ema(points: DataFrame, column: str, alpha: float) -> DataFrame:
    """Exponential moving average of each track after its last point, folded in time order."""
    folded = F.aggregate(
        F.array_sort(F.collect_list(F.struct("t", "frame", F.col(column).alias("x")))), F.lit(None).cast("double"),
        lambda acc, p: F.when(acc.isNull(), p["x"]).otherwise(F.lit(alpha) * p["x"] + F.lit(1 - alpha) * acc),
    )
    return points.groupBy("track_id").agg(folded.alias("ema"))


def as_of_sample(points: DataFrame, is_sample: Column, value: str) -> DataFrame:
    """The value of the latest sample at or before each point, or of the track's first sample before it."""
    q = F.when(is_sample, F.col(value))
    whole = by_time().rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return points.withColumn("sampled", F.coalesce(F.last(q, ignorenulls=True).over(by_time()), F.first(q, ignorenulls=True).over(whole)))


def sessions(attempts: DataFrame, longest: float, apart: float) -> DataFrame:
    """Joins a row to the row before it if it follows within `longest` and moved at most `apart`; the primary of each
    session is its lowest, then latest, then surest row."""
    dt, dx = F.col("t") - F.lag("t").over(by_time()), F.abs(F.col("px") - F.lag("px").over(by_time()))
    joins = F.coalesce((dt > 0) & (dt <= longest) & (dx <= apart), F.lit(False))
    out = attempts.withColumn("session", F.sum((~joins).cast("int")).over(by_time()))
    best = Window.partitionBy("track_id", "session").orderBy("py", F.desc("t"), F.desc("conf"), "frame")
    return out.withColumn("primary_frame", F.first("frame").over(best)).withColumn("deduped", F.col("frame") != F.col("primary_frame"))


def rim_signals(points: DataFrame, threshold: float, depth: float = 0.03) -> DataFrame:
    """Look-back columns over the eight rows before each row: deepest below the rim, nearest above it, tube entry, speed."""
    back = by_time().rowsBetween(-8, -1)
    y, valid = F.col("py"), F.col("conf") >= 0.2
    tube = valid & y.between(threshold - depth, threshold + depth)
    deepest = F.max(F.when(valid & (y > threshold), y)).over(back)
    above = F.last(F.when(valid & (y <= threshold), y), ignorenulls=True).over(back)
    outside = F.max((valid & ~tube).cast("int")).over(back)
    out = points.withColumns({"deepest": deepest, "last_above": above, "was_outside": F.coalesce(outside, F.lit(0)), "speed": F.coalesce((F.col("px") - F.lag("px", 2).over(by_time())) / 2, F.lit(0.0))})
    down = valid & (y > threshold) & (y >= F.col("last_above") + 0.003)
    up = valid & (y <= threshold) & (y <= F.greatest("deepest", F.lit(threshold)) - 0.005) & F.col("deepest").isNotNull()
    signal = F.when(down, "crossed_down").when(up, "crossed_up").when(tube & (F.col("was_outside") == 1), "rim_tube")
    return out.withColumn("signal", signal)


def running_ema(points: DataFrame, columns: tuple[str, ...], alpha: float) -> DataFrame:
    """Every row with the exponential moving average of its track up to it, as ema_<column>; the first row stays as it is.

    alpha >= 1 leaves the values, alpha <= 0 holds the first. A track is cut into stretches over which the weights stay
    within a double's range; a stretch is a running sum of weighted values, and what came before enters by the ends of
    the two stretches before it (older ones weigh under 1e-80). So no track is gathered in a row.
    """
    if alpha >= 1:
        return points.withColumns({f"ema_{c}": F.col(c) for c in columns})
    if alpha <= 0:
        return points.withColumns({f"ema_{c}": F.first(c).over(by_time()) for c in columns})
    keep = 1 - alpha
    length = max(8, math.ceil(-92 / math.log(keep)))
    rows = points.withColumn("__n", F.row_number().over(by_time()) - 1)
    rows = rows.withColumns({"__part": F.floor(F.col("__n") / length), "__at": (F.col("__n") % length).cast("double")})
    within = Window.partitionBy("track_id", "__part").orderBy("__at")
    weight = F.when(F.col("__n") == 0, 1.0).otherwise(alpha)
    rows = rows.withColumns({f"ema_{c}": F.sum(weight * F.col(c) * F.pow(F.lit(keep), -F.col("__at"))).over(within) * F.pow(F.lit(keep), F.col("__at")) for c in columns})
    across = Window.partitionBy("track_id").orderBy("__part")
    ends = rows.groupBy("track_id", "__part").agg(*[F.max_by(f"ema_{c}", "__at").alias(f"__end_{c}") for c in columns])
    before = {f"__end_{c}": F.coalesce(F.lag(f"__end_{c}").over(across), F.lit(0.0)) + keep**length * F.coalesce(F.lag(f"__end_{c}", 2).over(across), F.lit(0.0)) for c in columns}
    rows = rows.join(ends.withColumns(before), ["track_id", "__part"])
    rows = rows.withColumns({f"ema_{c}": F.col(f"ema_{c}") + F.pow(F.lit(keep), F.col("__at") + 1) * F.col(f"__end_{c}") for c in columns})
    return rows.drop("__n", "__part", "__at", *[f"__end_{c}" for c in columns])


def sampled(points: DataFrame, every: int, fps: float, start: float = 0.0, end: float | None = None) -> DataFrame:
    """Every `every`-th frame from the seek origin `start` (seconds) on, with its time from the start of the video, up to the last at or before `end`."""
    origin = math.ceil(start * fps)
    rows = points.where((F.col("frame") >= origin) & ((F.col("frame") - origin) % every == 0)).withColumn("at", start + (F.col("frame") - origin) / fps)
    return rows if end is None else rows.where(F.col("at") <= end)


def last_stride(points: DataFrame, least: float = 0.05) -> DataFrame:
    """The last step of each track whose squared length is over `least`, as (track_id, frame, x0, y0, x1, y1)."""
    rows = points.withColumns({"x0": F.lag("px").over(by_time()), "y0": F.lag("py").over(by_time())})
    rows = rows.where((F.col("px") - F.col("x0")) ** 2 + (F.col("py") - F.col("y0")) ** 2 > least)
    return rows.groupBy("track_id").agg(F.max_by(F.struct("frame", "x0", "y0", F.col("px").alias("x1"), F.col("py").alias("y1")), F.struct("t", "frame")).alias("s")).select("track_id", "s.*")


def assembled(points: DataFrame, sure: Column) -> DataFrame:
    """(track_id, label, points, first_seen): the label of a track's last point, its size, and its first sure frame."""
    at = F.struct("t", "frame")
    return points.groupBy("track_id").agg(F.max_by("label", at).alias("label"), F.count("*").alias("points"), F.min(F.when(sure, F.col("frame"))).alias("first_seen"))


def search_anchor(points: DataFrame, ball: str, hoop: str, marked: list[float]) -> DataFrame:
    """Adds anchor: of the marked hoops the nearest to the last known ball before the row (the first if there is none),
    without marked hoops the last known hoop before it."""
    before = by_time().rowsBetween(Window.unboundedPreceding, -1)
    if not marked:
        return points.withColumn("anchor", F.last(hoop, ignorenulls=True).over(before))
    last = F.last(ball, ignorenulls=True).over(before)
    rows = points.withColumn("__ball", last)
    near = F.array_min(F.array(*[F.struct(F.abs(F.col("__ball") - x), F.lit(k), F.lit(x).alias("x")) for k, x in enumerate(marked)]))["x"]
    return rows.withColumn("anchor", F.when(F.col("__ball").isNull(), marked[0]).otherwise(near)).drop("__ball")
