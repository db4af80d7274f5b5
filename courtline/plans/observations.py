"""More observation queries, entered in the catalogue: boxes and poses, look-back rules, folds, documents and streams."""

from __future__ import annotations

from pyspark.sql import functions as F

from courtline.functions import boxes as fb
from courtline.operators import lookback, matching, states, tracks
from courtline.plans.catalogue import _CLOCK, HOOPS, _micro, query
from courtline.sources import documents
from courtline.sources.views import boxes, read, readings, track_points
from courtline.streaming import stateful

_KEY = ["video_id", "frame", "idx"]
_CORNERS = ("x1", "y1", "x2", "y2")


def _c01(x: str) -> str:
    return f"least(greatest({x}, 0.0::double), 1.0::double)"


def _rounded(df, keep, columns):
    """`keep` and the columns as whole millionths."""
    return df.select(*keep, *[F.expr(_micro(c)).alias(c) for c in columns])


@query(f"""WITH c AS (SELECT video_id, frame, idx, label, {_c01('x1 - 0.1::double')} AS x1, {_c01('y1 - 0.1::double')} AS y1, {_c01('x2 + 0.2::double')} AS x2, {_c01('y2 + 0.2::double')} AS y2 FROM boxes),
 d AS (SELECT *, (x1 + x2) / 2 AS cx, (y1 + y2) / 2 AS cy FROM c)
SELECT video_id, frame, idx, {', '.join(f'{_micro(c)} AS {c}' for c in (*_CORNERS, 'cx', 'cy'))}, CASE WHEN label = 'N' THEN {_micro('cx')} END AS foot_x, CASE WHEN label = 'N' THEN {_micro('y2')} END AS foot_y FROM d""")
def box_detections(spark, d):
    b = boxes(spark, d)
    made = fb.corner_detection(b.x1 - 0.1, b.y1 - 0.1, b.x2 + 0.2, b.y2 + 0.2, b.label == "N")
    return _rounded(b.select(*_KEY, *[v.alias(k) for k, v in made.items()]), _KEY, made)


@query(f"SELECT video_id, frame, idx, {_micro('(160.0::double + x1 * 320.0::double) / 1280.0::double')} AS x, {_micro('(1 - (y1 + (y2 - y1)))')} AS flipped FROM boxes")
def region_remap(spark, d):
    b = boxes(spark, d)
    return _rounded(b.select(*_KEY, fb.crop_to_frame(160.0, b.x1, 320.0, 1280.0).alias("x"), fb.flip_vertical(b.y1, b.y2 - b.y1).alias("flipped")), _KEY, ["x", "flipped"])


@query(f"""SELECT video_id, frame, idx, {_micro(_c01('x1 - w * 3.5::double / 2'))} AS left_edge, {_micro(_c01('y1 + h * 3.5::double / 2'))} AS bottom_edge, {_micro('w * 1.5::double')} AS band_w,
 {_micro('greatest(h * 0.15::double, 0.02::double)')} AS band_h, {_micro('(y1 - h / 2 + 0.025::double)')} AS rim FROM (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM boxes)""")
def hoop_regions(spark, d):
    b = boxes(spark, d).withColumns({"w": F.col("x2") - F.col("x1"), "h": F.col("y2") - F.col("y1")})
    left, _, _, bottom = fb.search_region(b.x1, b.y1, b.w, b.h)
    band_w, band_h = fb.rim_band(b.w, b.h, 1.5)
    rows = b.select(*_KEY, left.alias("left_edge"), bottom.alias("bottom_edge"), band_w.alias("band_w"), band_h.alias("band_h"), fb.rim(b.y1, b.h).alias("rim"))
    return _rounded(rows, _KEY, ["left_edge", "bottom_edge", "band_w", "band_h", "rim"])


@query("""SELECT a.video_id, a.frame, a.idx, b.frame AS inner_frame, b.idx AS inner_idx FROM boxes a JOIN boxes b ON a.video_id = b.video_id AND (a.frame, a.idx) <> (b.frame, b.idx)
 WHERE b.x1 >= a.x1 - 0.000001::double AND b.y1 >= a.y1 - 0.000001::double AND b.x2 <= a.x2 + 0.000001::double AND b.y2 <= a.y2 + 0.000001::double""")
def region_containment(spark, d):
    a = boxes(spark, d).select(*_KEY, *_CORNERS)
    b = a.select("video_id", F.col("frame").alias("inner_frame"), F.col("idx").alias("inner_idx"), *[F.col(c).alias(f"i_{c}") for c in _CORNERS])
    inside = fb.contains([F.col(c) for c in _CORNERS], [F.col(f"i_{c}") for c in _CORNERS])
    return a.join(b, "video_id").where(inside & ~((F.col("frame") == F.col("inner_frame")) & (F.col("idx") == F.col("inner_idx")))).select(*_KEY, "inner_frame", "inner_idx")


@query("""SELECT kind, count(*) AS n FROM (SELECT CASE label WHEN 'A' THEN 'ball' WHEN 'N' THEN 'hoop' ELSE 'player' END AS kind, conf FROM boxes)
 WHERE conf >= CASE kind WHEN 'ball' THEN 0.05::double WHEN 'hoop' THEN 0.6::double ELSE 0.2::double END GROUP BY kind""")
def class_thresholds(spark, d):
    kind = F.when(F.col("label") == "A", "ball").when(F.col("label") == "N", "hoop").otherwise("player")
    least = F.when(F.col("kind") == "ball", 0.05).when(F.col("kind") == "hoop", 0.6).otherwise(0.2)
    return boxes(spark, d).withColumn("kind", kind).where(F.col("conf") >= least).groupBy("kind").agg(F.count("*").alias("n"))


@query("SELECT video_id, frame, CASE WHEN max(CASE WHEN label = 'A' AND conf >= 0.2::double THEN 1 ELSE 0 END) = 1 THEN 'positive' ELSE 'negative' END AS split FROM boxes GROUP BY 1, 2")
def positive_split(spark, d):
    hit = F.max(((F.col("label") == "A") & (F.col("conf") >= 0.2)).cast("int")) == 1
    return boxes(spark, d).groupBy("video_id", "frame").agg(F.when(hit, "positive").otherwise("negative").alias("split"))


_CLIP = "greatest(0.0::double, -(x1 - 0.3::double) / dx, -(y1 - 0.3::double) / dy) AS low, least(1.0::double, (1 - (x1 - 0.3::double)) / dx, (1 - (y1 - 0.3::double)) / dy) AS high"


@query(f"""SELECT video_id, frame, idx, CASE WHEN low <= high THEN {_micro('low')} END AS low, CASE WHEN low <= high THEN {_micro('high')} END AS high
 FROM (SELECT *, {_CLIP} FROM (SELECT *, x2 - (x1 - 0.3::double) AS dx, y2 - (y1 - 0.3::double) AS dy FROM boxes))""")
def segment_clip(spark, d):
    b = boxes(spark, d)
    low, high = fb.clip_segment(b.x1 - 0.3, b.y1 - 0.3, b.x2, b.y2)
    return _rounded(b.select(*_KEY, low.alias("low"), high.alias("high")), _KEY, ["low", "high"])


@query(f"""WITH a AS (SELECT *, y2 + (frame - 3) * 0.04::double AS ay FROM boxes), g AS (SELECT *, conf >= 0.4::double AND ay >= y1 AND ay <= least(1.0::double, y2 + 0.08::double) AS good FROM a)
SELECT video_id, frame, idx, {_micro('CASE WHEN good THEN (x1 + x2) / 2 ELSE (x1 + x2) / 2 END')} AS fx, {_micro('CASE WHEN good THEN (ay + ay) / 2 ELSE y2 END')} AS fy FROM g""")
def foot_of_pose(spark, d):
    b = boxes(spark, d)
    ay = b.y2 + (b.frame - 3) * 0.04
    x, y = fb.foot_of_pose((b.x1, ay, b.conf), (b.x2, ay, b.conf), (b.x1, b.y1, b.x2, b.y2))
    return _rounded(b.select(*_KEY, x.alias("fx"), y.alias("fy")), _KEY, ["fx", "fy"])


@query(f"""SELECT track_id, {_micro('CAST(sum(CAST(px BETWEEN 0.1::double AND 0.9::double AS integer)) AS double) / count(*)')} AS share, {_micro('(arg_max(frame, (t, frame)) + 1) / max(t)')} AS fps,
 CASE WHEN (arg_min(px, (t, frame)) + arg_max(px, (t, frame))) / 2 < 0.5::double THEN 'left' ELSE 'right' END AS side FROM trk GROUP BY track_id""")
def track_summary(spark, d):
    at = F.struct("t", "frame")
    on = F.sum(F.col("px").between(0.1, 0.9).cast("int")).cast("double") / F.count("*")
    middle = (F.min_by("px", at) + F.max_by("px", at)) / 2
    out = track_points(spark, d).groupBy("track_id").agg(on.alias("share"), ((F.max_by("frame", at) + 1) / F.max("t")).alias("fps"), F.when(middle < 0.5, "left").otherwise("right").alias("side"))
    return _rounded(out, ["track_id", "side"], ["share", "fps"])


@query("SELECT team, median(r) AS r, median(g) AS g FROM (SELECT track_id, track_id % 2 AS team, median(frame * 37 % 256) AS r, median(frame * 91 % 256) AS g FROM trk GROUP BY 1, 2) GROUP BY team")
def team_colours(spark, d):
    own = track_points(spark, d).groupBy("track_id").agg(F.median(F.col("frame") * 37 % 256).alias("r"), F.median(F.col("frame") * 91 % 256).alias("g"))
    return own.groupBy((F.col("track_id") % 2).alias("team")).agg(F.median("r").alias("r"), F.median("g").alias("g"))


@query("""WITH k AS (SELECT track_id, frame, [abs(px - 0.2::double), abs(px - 0.5::double), abs(px - 0.7::double)] AS l FROM trk)
SELECT track_id, frame, CASE WHEN list_sort(l)[2] - list_sort(l)[1] >= 0.12::double THEN ['red', 'white', 'blue'][list_position(l, list_min(l))] END AS kit FROM k""")
def kit_margin(spark, d):
    return track_points(spark, d).select("track_id", "frame", lookback.nearest_with_margin([F.abs(F.col("px") - x) for x in (0.2, 0.5, 0.7)], ["red", "white", "blue"], 0.12).alias("kit"))


@query()
def cluster_names(spark, d):
    """Per track, day thirds as clusters against three kits by the distance of their mean place."""
    means = track_points(spark, d).groupBy(F.col("track_id").alias("group_id"), (F.col("frame") % 3).alias("cluster")).agg((F.floor(F.avg("px") * 1000) / 1000).alias("m"))
    kits = F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.lit(x).alias("at")) for n, x in (("red", 0.4), ("white", 0.5), ("blue", 0.6))]))
    rows = means.withColumn("k", kits).select("group_id", "cluster", "k.name", F.abs(F.col("m") - F.col("k.at")).alias("distance"))
    return lookback.name_clusters(rows)


@query(f"SELECT track_id, frame, {_micro('coalesce((px - lag(px, 2) OVER (PARTITION BY track_id ORDER BY t, frame)) / 2, 0)')} AS velocity FROM trk")
def windowed_velocity(spark, d):
    return _rounded(lookback.velocity(track_points(spark, d), "px"), ["track_id", "frame"], ["velocity"])


@query("""WITH f AS (SELECT *, conf >= 0.1::double AS v, conf >= 0.3::double AS s FROM trk), b AS (SELECT *, max(CAST(v AND NOT s AS integer)) OVER (PARTITION BY track_id ORDER BY t, frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) AS g,
 lag(v AND s) OVER w AS p, row_number() OVER w AS n FROM f WINDOW w AS (PARTITION BY track_id ORDER BY t, frame)) SELECT track_id, frame FROM b WHERE s AND n > 2 AND (g = 1 OR NOT p)""")
def resume_signal(spark, d):
    return lookback.resumed(track_points(spark, d), F.col("conf") >= 0.1, F.col("conf") >= 0.3).where("resumed").select("track_id", "frame")


@query("""WITH f AS (SELECT *, conf >= 0.2::double AS v, abs(px - 0.5::double) AS x FROM trk), b AS (SELECT *, coalesce(lag(v) OVER w AND x > lag(x) OVER w + 0.005::double, false) AS away,
 first_value(CASE WHEN v THEN x END IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY t, frame ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS first FROM f WINDOW w AS (PARTITION BY track_id ORDER BY t, frame))
SELECT track_id, frame FROM b WHERE NOT away AND (x <= 0.4::double * 0.2::double OR coalesce(x < first - 0.005::double, false))""")
def convergence(spark, d):
    return lookback.converging(track_points(spark, d), F.abs(F.col("px") - 0.5), F.col("conf") >= 0.2, 0.2).where("converging").select("track_id", "frame")


@query(f"WITH e AS (SELECT track_id, list_reduce(list(px ORDER BY t, frame), lambda a, x: 0.5::double * x + 0.5::double * a) AS ema FROM trk WHERE px BETWEEN 0.1::double AND 0.9::double GROUP BY track_id) SELECT track_id, {_micro('ema')} AS ema FROM e")
def court_ema(spark, d):
    return _rounded(lookback.ema_where(track_points(spark, d), "px", 0.5, F.col("px").between(0.1, 0.9)), ["track_id"], ["ema"])


_KNOWN = _CLOCK + ", k AS (SELECT video_id, idx, CASE WHEN idx % 4 = 1 THEN s[1] END AS v FROM v)"


def _known(spark, d):
    from courtline.functions import text

    rows = readings(spark, d)
    return rows.select("video_id", "idx", F.when(F.col("idx") % 4 == 1, F.try_element_at(text.clock_candidates(F.col("raw")), F.lit(1))).alias("v"))


@query(f"""{_KNOWN}, w AS (SELECT *, last_value(v IGNORE NULLS) OVER o AS l, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER o AS since FROM k WINDOW o AS (PARTITION BY video_id ORDER BY idx))
SELECT video_id, idx, CASE WHEN idx - since <= 2 THEN l END AS held FROM w""")
def limited_hold(spark, d):
    return lookback.held(_known(spark, d), "v", "video_id", "idx").select("video_id", "idx", "held")


@query(f"""{_KNOWN}, w AS (SELECT *, last_value(v IGNORE NULLS) OVER o AS a, last_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER o AS ta,
 first_value(v IGNORE NULLS) OVER p AS b, first_value(CASE WHEN v IS NOT NULL THEN idx END IGNORE NULLS) OVER p AS tb FROM k
 WINDOW o AS (PARTITION BY video_id ORDER BY idx), p AS (PARTITION BY video_id ORDER BY idx ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING))
SELECT video_id, idx, CAST(CASE WHEN v IS NOT NULL THEN v WHEN a - b >= 0 AND a - b <= (tb - ta) * 60 + 3.5 THEN round_even(a - (a - b) * ((idx - ta) * 60.0::double) / ((tb - ta) * 60.0::double), 0) END AS bigint) AS filled FROM w""")
def clock_interpolated(spark, d):
    rows = _known(spark, d).withColumn("t", F.col("idx") * 60.0)
    return lookback.interpolated(rows, "v", "video_id", "t").select("video_id", "idx", F.col("filled").cast("bigint").alias("filled"))


@query("""SELECT video_id, arg_min(raw, (-s, idx)) AS raw FROM (SELECT *, round(idx % 7 / 10.0::double + (CASE WHEN regexp_matches(raw, '^[0-9]{3,4}$') THEN 1.0::double ELSE 0 END + 0.0::double
 + CASE WHEN regexp_matches(raw, '^[0-9]{1,3}$') THEN 0.2::double ELSE 0 END), 6) AS s FROM reads) GROUP BY video_id""")
def ocr_best(spark, d):
    rows = readings(spark, d)
    more = lookback.text_score(F.col("raw"), F.lit(0.0), "^[0-9]{3,4}$")
    score = F.round(F.col("idx") % 7 / 10.0 + more, 6)
    return rows.withColumn("s", score).groupBy("video_id").agg(F.min_by("raw", F.struct((-F.col("s")).alias("s"), "idx")).alias("raw"))


@query("SELECT video_id, idx, CASE WHEN length(raw) <= 2 THEN raw END AS jersey FROM reads WHERE idx % 3 > 0")
def jersey_text(spark, d):
    digits = F.regexp_replace("raw", "[^0-9]", "")
    return readings(spark, d).where("idx % 3 > 0").select("video_id", "idx", F.when(digits.rlike(r"^\d{1,2}$"), digits).alias("jersey"))


@query("SELECT o_orderkey AS image FROM orders o WHERE NOT EXISTS (SELECT 1 FROM lineitem l WHERE l.l_orderkey = o.o_orderkey AND l.l_linenumber = 2)")
def unlabelled_images(spark, d):
    labels = boxes(spark, d).where("frame = 2").select(F.col("video_id").alias("image"))
    return read(spark, d, "orders").select(F.col("o_orderkey").alias("image")).join(labels, "image", "left_anti")


@query("SELECT label, arg_min(frame, (t, frame)) AS frame FROM trk GROUP BY label")
def first_of_key(spark, d):
    return matching.top_per_group(track_points(spark, d), ["label"], ["t", "frame"], 1).select("label", "frame")


@query("SELECT track_id, t, frame, px, conf FROM trk")
def document_round_trip(spark, d):
    rows = track_points(spark, d).select("track_id", "t", "frame", "px", "conf")
    child = rows.drop("track_id").schema
    return documents.unnest(documents.nest(rows, "track_id", ["t", "frame"]), "track_id", child)


@query()
def quad_smoother(spark, d):
    p, none = track_points(spark, d), F.lit(None).cast("array<double>")
    quad = F.when(F.col("conf") >= 0.2, F.array("px", "py", F.col("px") + 0.1, "py", F.col("px") + 0.1, F.col("py") + 0.1, "px", F.col("py") + 0.1)).otherwise(none)
    out = states.smooth_quads(p.withColumn("quad", quad))
    return out.select("track_id", "frame", F.transform("quad", lambda x: F.round(x, 6)).alias("quad"))


@query()
def active_hoop(spark, d):
    p = track_points(spark, d).withColumns({"ball": F.when(F.col("conf") >= 0.2, F.col("px")), "seen": F.when(F.col("frame") % 3 == 0, F.col("py"))})
    return states.active_hoops(p, HOOPS)


@query()
def gated_ball(spark, d):
    return states.gated_ball(track_points(spark, d)).withColumns({c: F.round(c, 6) for c in ("x", "y")})


def _event_stream(spark, d):
    schema = read(spark, d, "events").schema
    return spark.readStream.schema(schema).option("pathGlobFilter", "events.parquet").parquet(d)


@query(f"WITH e AS (SELECT track_id, list_reduce(list(px ORDER BY t, frame), lambda a, x: 0.3::double * x + 0.7::double * a) AS ema FROM trk GROUP BY track_id) SELECT track_id, {_micro('ema')} AS ema FROM e")
def stream_foot_ema(spark, d):
    events = _event_stream(spark, d).select(
        F.col("user_id").alias("track_id"), F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1000000D").alias("t"),
        F.col("event_id").alias("frame"), (F.col("event_id") * 37 % 1000 / 1000.0).alias("px"),
    )
    out = stateful.drained(stateful.ema_stream(events, 0.3), "update")
    last = matching.top_per_group(out, ["track_id"], [F.desc("t"), F.desc("frame")], 1)
    return _rounded(last, ["track_id"], ["ema"])


@query("SELECT date_diff('day', timestamp '2024-01-01 00:00:00', ts) AS day, event_type, count(*) AS n FROM events GROUP BY 1, 2")
def stream_daily_counts(spark, d):
    seconds = F.expr("timestampdiff(MICROSECOND, timestamp_ntz'2024-01-01 00:00:00', ts) / 1000000D")
    events = _event_stream(spark, d).select(F.timestamp_seconds(seconds).alias("at"), "event_type")
    out = stateful.drained(stateful.windowed_counts(events, "at", "event_type", "1 day", "1 day"), "update")
    last = out.groupBy("start", "event_type").agg(F.max("n").alias("n"))  # a window's count only grows
    return last.select(F.floor(F.unix_timestamp("start") / 86_400).alias("day"), "event_type", "n")
