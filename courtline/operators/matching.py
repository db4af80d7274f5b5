"""Joins, votes and groupings of observations."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from courtline.functions.geometry import box_iou


def best_overlap(left: DataFrame, right: DataFrame, least: float = 0.25) -> DataFrame:
    """Each left box with the right box of its frame of highest overlap above `least`, the first on a tie; unmatched rows stay."""
    r = right.select("video_id", "frame", F.col("idx").alias("r_idx"), *[F.col(c).alias(f"r_{c}") for c in ("x1", "y1", "x2", "y2")])
    iou = box_iou([F.col(c) for c in ("x1", "y1", "x2", "y2")], [F.col(f"r_{c}") for c in ("x1", "y1", "x2", "y2")])
    hits = left.join(r, ["video_id", "frame"]).withColumn("iou", iou).where(F.col("iou") > least)
    best = hits.groupBy("video_id", "frame", "idx").agg(F.max(F.struct("iou", (-F.col("r_idx")).alias("n"))).alias("b"))
    return left.join(best, ["video_id", "frame", "idx"], "left").select(*left.columns, (-F.col("b.n")).alias("r_idx"))


def in_any_interval(rows: DataFrame, events: DataFrame, length: float, key: str = "track_id", slice_: float | None = None) -> DataFrame:
    """Rows whose time lies within `length` after any event of their key; both sides meet in time slices of that length."""
    width = slice_ or length
    e = events.select(key, F.col("t").alias("e_t")).withColumn("slice", F.explode(F.array(F.floor(F.col("e_t") / width), F.floor(F.col("e_t") / width) + 1)))
    r = rows.withColumn("slice", F.floor(F.col("t") / width))
    e = e.withColumnRenamed(key, "e_key").withColumnRenamed("slice", "e_slice")
    return r.join(e, (r[key] == e.e_key) & (r["slice"] == e.e_slice) & (r["t"] >= e.e_t) & (r["t"] <= e.e_t + length), "left_semi").drop("slice")


def nearest_hoop(x, hoops: Sequence[float]):
    """Index of the nearest of a few fixed places by |dx|, the first on a tie."""
    away = [F.struct(F.abs(x - F.lit(h)).alias("d"), F.lit(k).alias("k")) for k, h in enumerate(hoops)]
    return F.least(*away)["k"] if len(away) > 1 else F.lit(0)


def top_per_group(rows: DataFrame, group: Sequence[str], order: Sequence, k: int) -> DataFrame:
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= k)


def largest_gap_split(rows: DataFrame, group: str, x: str, least: float = 0.12) -> DataFrame:
    """Splits each group's sorted values at the first largest gap of `least` or more: side 0 before, 1 from there on."""
    order = Window.partitionBy(group).orderBy(x, "idx")
    ranked = rows.withColumn("n", F.row_number().over(order)).withColumn("gap", F.col(x) - F.lag(x).over(order))
    cut = ranked.where(F.col("gap") >= least).groupBy(group).agg(F.max(F.struct("gap", (-F.col("n")).alias("m"))).alias("c")).select(group, (-F.col("c.m")).alias("cut"))
    return ranked.join(cut, group, "left").withColumn("side", F.coalesce((F.col("n") >= F.col("cut")).cast("int"), F.lit(0)))


def weighted_vote(votes: DataFrame, key: str, value: str, weight: str, share: float = 0.6, least: int = 2) -> DataFrame:
    """The value of highest total weight of each key, null unless it has `share` of the weight and `least` votes."""
    each = votes.groupBy(key, value).agg(F.sum(weight).alias("w"), F.count("*").alias("n"))
    total = each.groupBy(key).agg(F.max(F.struct("w", (-F.col(value)).alias("v"), "n")).alias("b"), F.sum("w").alias("all"))
    return total.select(key, F.when((F.col("b.w") >= share * F.col("all")) & (F.col("b.n") >= least), -F.col("b.v")).alias(value))


def prototypes(vectors: DataFrame, label: str, vector: str) -> DataFrame:
    """The mean vector of each label, a partial aggregate by position."""
    parts = vectors.select(label, F.posexplode(vector).alias("i", "x")).groupBy(label, "i").agg(F.avg(F.col("x").cast("double")).alias("x"))
    return parts.groupBy(label).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda p: p["x"]).alias("prototype"))


def unit_prototypes(vectors: DataFrame, label: str, vector: str, eps: float = 1e-8) -> DataFrame:
    """prototypes() of length one; lengths under `eps` count as `eps`."""
    size = F.sqrt(F.aggregate("prototype", F.lit(0.0), lambda s, x: s + x * x))
    return prototypes(vectors, label, vector).withColumn("prototype", F.transform("prototype", lambda x: x / F.greatest(size, F.lit(eps))))


def cosine(a, b):
    dot = lambda x, y: F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q), F.lit(0.0), lambda s, v: s + v)
    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def nearest_prototype(vectors: DataFrame, book: DataFrame, most_labels: int = 1000) -> DataFrame:
    """Each vector with the label of highest cosine, the least on a tie. The book travels in blocks of about `most_labels` labels, a row each."""
    blocks = max(1, -(-book.count() // most_labels))
    numbered = book.withColumn("block", F.pmod(F.xxhash64("label"), F.lit(blocks)))
    out, best = vectors, None
    for k in range(blocks):
        one = numbered.where(F.col("block") == k).agg(F.array_sort(F.collect_list(F.struct(F.col("label").alias("l"), F.col("prototype").alias("p")))).alias("book"))
        scored = F.array_min(F.transform("book", lambda b: F.struct((-cosine(F.col("embedding"), b["p"])).alias("d"), b["l"].alias("l"))))
        out = out.crossJoin(F.broadcast(one)).withColumn("best", scored if best is None else F.least(F.col("best"), scored)).drop("book")
        best = "best"
    return out.withColumn("kit", F.col("best")["l"]).drop("best")
