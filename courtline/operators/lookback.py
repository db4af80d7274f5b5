"""Look-back rules over ordered points, limited holds, and choices among few candidates."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from courtline.operators.tracks import by_time


def velocity(points: DataFrame, column: str) -> DataFrame:
    """Change a row over the last two rows; zero for a track's first two."""
    return points.withColumn("velocity", F.coalesce((F.col(column) - F.lag(column, 2).over(by_time())) / 2, F.lit(0.0)))


def resumed(points: DataFrame, valid: Column, detected: Column) -> DataFrame:
    """Rows seen again after a predicted row among the last three, or right after a row that was not seen; from the third row on."""
    rows = points.withColumns({"__v": valid, "__d": detected})
    guessed = F.max((F.col("__v") & ~F.col("__d")).cast("int")).over(by_time().rowsBetween(-3, -1)) == 1
    unseen = ~(F.lag("__v").over(by_time()) & F.lag("__d").over(by_time()))
    third = F.row_number().over(by_time()) > 2
    return rows.withColumn("resumed", F.col("__d") & third & (guessed | unseen)).drop("__v", "__d")


def converging(points: DataFrame, distance: Column, valid: Column, half_band: float, slack: float = 0.005) -> DataFrame:
    """Whether a point comes nearer: not moving off the row before, and within the inner band or nearer than the earliest of eight rows."""
    rows = points.withColumns({"__d": distance, "__v": valid})
    d, w = F.col("__d"), by_time()
    away = F.coalesce(F.lag("__v").over(w) & (d > F.lag("__d").over(w) + slack), F.lit(False))
    first = F.first(F.when(F.col("__v"), d), ignorenulls=True).over(w.rowsBetween(-8, -1))
    return rows.withColumn("converging", ~away & ((d <= 0.4 * half_band) | F.coalesce(d < first - slack, F.lit(False)))).drop("__d", "__v")


def held(rows: DataFrame, value: str, key: str, order: str, longest: int = 2) -> DataFrame:
    """Unknown values take the last known one for up to `longest` rows. `order` numbers the rows of a key without holes."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(order)
    at = F.last(F.when(F.col(value).isNotNull(), F.col(order)), ignorenulls=True).over(w)
    return rows.withColumn("held", F.when(F.col(order) - at <= longest, F.last(value, ignorenulls=True).over(w)))


def interpolated(rows: DataFrame, value: str, key: str, t: str, slack: float = 2.5) -> DataFrame:
    """Falling clocks between two known readings, where the fall fits the time passed; halves round to even."""
    from pyspark.sql import Window

    w = Window.partitionBy(key).orderBy(t)
    ahead = w.rowsBetween(0, Window.unboundedFollowing)
    known_t = F.when(F.col(value).isNotNull(), F.col(t))
    a, ta = F.last(value, ignorenulls=True).over(w), F.last(known_t, ignorenulls=True).over(w)
    b, tb = F.first(value, ignorenulls=True).over(ahead), F.first(known_t, ignorenulls=True).over(ahead)
    rows = rows.withColumns({"__a": a, "__b": b, "__ta": ta, "__tb": tb})
    drop, dt = F.col("__a") - F.col("__b"), F.col("__tb") - F.col("__ta")
    due = F.bround(F.col("__a") - drop * (F.col(t) - F.col("__ta")) / dt).cast("bigint")
    fits = (drop >= 0) & (drop <= dt + slack + 1)
    return rows.withColumn("filled", F.when(F.col(value).isNotNull(), F.col(value)).when(fits, due)).drop("__a", "__b", "__ta", "__tb")


def ema_where(points: DataFrame, column: str, alpha: float, where: Column) -> DataFrame:
    """Exponential moving average over the rows that meet `where`; others neither update it nor count."""
    from courtline.operators.tracks import ema

    return ema(points.where(where), column, alpha)


def text_score(text: Column, conf: Column, pattern: str) -> Column:
    """How likely a reading is right: its confidence, more for the expected form, less for no or long text."""
    n = F.length(text)
    more = F.when(text.rlike(pattern), 1.0).otherwise(0.0) + F.when(text.contains(":"), 0.5).otherwise(0.0) + F.when(text.rlike(r"^\d{1,3}$"), 0.2).otherwise(0.0)
    return conf + more - F.when(n == 0, 1.0).when(n > 6, 0.5).otherwise(0.0)


def nearest_with_margin(distances: list[Column], names: list[str], margin: float) -> Column:
    """The name of the least distance, the first of equals; null if the second least is closer than `margin`."""
    at = F.array_sort(F.array(*[F.struct(d.alias("d"), F.lit(k).alias("k")) for k, d in enumerate(distances)]))
    clear = at[1]["d"] - at[0]["d"] >= margin if len(names) > 1 else F.lit(True)
    return F.when(clear, F.element_at(F.array(*[F.lit(n) for n in names]), at[0]["k"] + 1))


def match_names(distances: list[tuple[float, int, str]]) -> dict[int, str]:
    """Names of clusters: of two and two the pairing of the least sum, else the nearest pairs first, each name once;
    clusters that are left over take their nearest name."""
    clusters, names = sorted({c for _, c, _ in distances}), sorted({n for _, _, n in distances})
    d = {(c, n): x for x, c, n in distances}
    if len(clusters) == len(names) == 2:
        straight, crossed = ([*zip(clusters, order, strict=True)] for order in (names, names[::-1]))
        return dict(min((straight, crossed), key=lambda p: sum(d[k] for k in p)))
    out: dict[int, str] = {}
    for _, c, n in sorted(distances):
        if c not in out and n not in out.values():
            out[c] = n
    return {c: out.get(c) or min(names, key=lambda n: d[c, n]) for c in clusters}


def name_clusters(distances: DataFrame) -> DataFrame:
    """(group_id, cluster, name) from (group_id, cluster, name, distance), by match_names in each group."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        made = match_names([*zip(rows.distance, rows.cluster, rows.name, strict=True)])
        return pd.DataFrame({"group_id": rows.group_id.iloc[0], "cluster": list(made), "name": list(made.values())})

    return distances.groupBy("group_id").applyInPandas(run, "group_id bigint, cluster bigint, name string")




def approaching(y: Column, deepest: Column, threshold: float, valid: Column, depth: float = 0.08, least_below: float = 0.012, rise: float = 0.005) -> Column:
    """A ball just under the rim that has risen from a point deep enough below it; false where nothing was below."""
    return F.coalesce(valid & (y > threshold) & (y <= threshold + depth) & (deepest >= threshold + least_below) & (y <= deepest - rise), F.lit(False))


def near_hoop(x: Column, y: Column, hoop: float, width: float, threshold: float, relaxed: Column, expand: float = 1.5, depth: float = 0.03, relaxed_depth: float = 0.08) -> Column:
    """Within the hoop's widened half width, and no deeper under the rim than the signal allows."""
    return (F.abs(x - hoop) <= width / 2 * expand) & (y <= threshold + F.when(relaxed, relaxed_depth).otherwise(depth))
