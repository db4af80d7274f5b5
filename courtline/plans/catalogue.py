"""Every observation query by name, with the DuckDB SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from courtline.functions import boxes as fb
from courtline.functions import geometry, text
from courtline.operators import attempts, folds, matching, tracks
from courtline.sources.views import boxes, read, readings, track_points, with_views

HOUR = 3600.0
QUAD = [(0.2, 0.2), (0.8, 0.3), (0.7, 0.9), (0.1, 0.7)]
H = [28.0, 2.0, -1.0, 1.5, 15.0, -0.5, 0.1, 0.05, 1.0]
HOOPS = [0.25, 0.5, 0.75]
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = with_views(sql)
        return f

    return add


def _micro(c: str) -> str:
    """A double as whole millionths, where engines may differ in the last bit."""
    return f"CAST(floor({c} * 1000000 + 0.5) AS bigint)"


def _filled(spark, d):
    return tracks.fill_gaps(track_points(spark, d), HOUR, 10 * HOUR)


_FILLED = """gaps AS (SELECT *, lead(t) OVER w AS nt, lead(px) OVER w AS npx, lead(py) OVER w AS npy FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY t, frame)),
 sized AS (SELECT *, CASE WHEN nt - t > 5400 AND nt - t <= 36000 THEN CAST(round_even((nt - t) / 3600, 0) AS integer) ELSE 1 END AS steps FROM gaps),
 filled AS (SELECT track_id, CASE WHEN i = 0 THEN t ELSE t + (nt - t) * (i / steps::double) END AS t, frame, CAST(i AS integer) AS i,
   CASE WHEN i = 0 THEN px ELSE px + (npx - px) * (i / steps::double) END AS px, CASE WHEN i = 0 THEN py ELSE py + (npy - py) * (i / steps::double) END AS py, i > 0 AS interpolated
   FROM (SELECT *, unnest(range(steps)) AS i FROM sized))"""


@query(f"""WITH {_FILLED}, sizes AS (SELECT *, count(*) OVER (PARTITION BY track_id) AS n FROM filled)
SELECT track_id, frame, i, {_micro('t')} AS t_us, {_micro('avg(px) OVER w')} AS sx, {_micro('avg(py) OVER w')} AS sy, interpolated FROM sizes WHERE n >= 8
WINDOW w AS (PARTITION BY track_id ORDER BY t, frame, i ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING)""")
def trajectories_smoothed(spark, d):
    out = tracks.smooth(tracks.keep_long(_filled(spark, d), 8))
    return out.selectExpr("track_id", "frame", "i", f"{_micro('t')} AS t_us", f"{_micro('s_px')} AS sx", f"{_micro('s_py')} AS sy", "interpolated")


@query(f"WITH {_FILLED} SELECT track_id, frame, i, {_micro('t')} AS t_us, {_micro('px')} AS x, {_micro('py')} AS y, interpolated FROM filled")
def trajectories_filled(spark, d):
    return _filled(spark, d).selectExpr("track_id", "frame", "i", f"{_micro('t')} AS t_us", f"{_micro('px')} AS x", f"{_micro('py')} AS y", "interpolated")


@query("WITH g AS (SELECT *, lag(t) OVER (PARTITION BY track_id ORDER BY t, frame) AS t_start FROM trk) SELECT track_id, t_start, t AS t_end, frame FROM g WHERE t - t_start > 36000")
def track_gaps(spark, d):
    return tracks.gaps(track_points(spark, d), 10 * HOUR)


@query("WITH g AS (SELECT *, lag(t) OVER (PARTITION BY track_id ORDER BY t, frame) AS p FROM trk) SELECT track_id, count(*) AS n_gaps, CAST(sum(CAST(floor(t - p) AS bigint)) AS bigint) AS seconds FROM g WHERE t - p > 36000 GROUP BY track_id")
def gap_totals(spark, d):
    return tracks.gaps(track_points(spark, d), 10 * HOUR).groupBy("track_id").agg(F.count("*").alias("n_gaps"), F.sum(F.floor(F.col("t_end") - F.col("t_start")).cast("bigint")).alias("seconds"))


@query("SELECT * FROM (SELECT track_id, frame, CAST(row_number() OVER (PARTITION BY track_id ORDER BY t, frame) AS integer) AS seen FROM trk) WHERE (seen - 1) % 5 = 0")
def cadence(spark, d):
    return tracks.cadence(track_points(spark, d), 5).select("track_id", "frame", "seen")


@query("SELECT frame, track_id, frame / 10.0::double AS t FROM trk WHERE frame % 10 = 0 AND frame <= 5000")
def fixed_rate_sampling(spark, d):
    return track_points(spark, d).where("frame % 10 = 0 AND frame <= 5000").select("frame", "track_id", (F.col("frame") / 10.0).alias("t"))


@query("SELECT frame, track_id, frame / 10.0::double AS t FROM trk WHERE frame % 10 = 0")
def fixed_rate_sampling_whole(spark, d):
    """fixed_rate_sampling without its end: every tenth frame of the whole table."""
    return track_points(spark, d).where("frame % 10 = 0").select("frame", "track_id", (F.col("frame") / 10.0).alias("t"))


@query(f"WITH e AS (SELECT track_id, list_reduce(list(px ORDER BY t, frame), lambda a, x: 0.3::double * x + 0.7::double * a) AS ema FROM trk GROUP BY track_id) SELECT track_id, {_micro('ema')} AS ema FROM e")
def foot_ema(spark, d):
    return tracks.ema(track_points(spark, d), "px", 0.3).selectExpr("track_id", f"{_micro('ema')} AS ema")


_POLYGON = " + ".join(f"CAST(({ay}::double > py) <> ({by}::double > py) AND px < {bx - ax}::double * (py - {ay}::double) / {by - ay + 1e-12}::double + {ax}::double AS integer)" for (ax, ay), (bx, by) in zip(QUAD, [QUAD[-1], *QUAD[:-1]], strict=True))


@query(f"SELECT track_id, frame FROM trk WHERE ({_POLYGON}) % 2 = 1")
def polygon_filter(spark, d):
    return track_points(spark, d).where(geometry.in_polygon(F.col("px"), F.col("py"), QUAD)).select("track_id", "frame")


_W = f"({H[6]}::double * px + {H[7]}::double * py + {H[8]}::double)"
_X, _Y = (f"(({H[k]}::double * px + {H[k + 1]}::double * py + {H[k + 2]}::double) / {_W})" for k in (0, 3))


@query(f"SELECT track_id, frame, CASE WHEN {_X} BETWEEN 0 AND 28 AND {_Y} BETWEEN 0 AND 15 THEN {_micro(_X)} END AS x, CASE WHEN {_X} BETWEEN 0 AND 28 AND {_Y} BETWEEN 0 AND 15 THEN {_micro(_Y)} END AS y FROM trk")
def homography_project(spark, d):
    x, y = geometry.project(F.col("px"), F.col("py"), H)
    points = track_points(spark, d).withColumns({"hx": x, "hy": y})
    on = geometry.within_court(F.col("hx"), F.col("hy"), 28, 15, 0)
    return points.select("track_id", "frame", F.when(on, F.expr(_micro("hx"))).alias("x"), F.when(on, F.expr(_micro("hy"))).alias("y"))


_T = geometry.similarity(0.1, -0.2, 30, 1.5, True, (0.5, 0.5))


@query(f"SELECT track_id, frame, {_micro(f'({_T[0]!r}::double * px + {_T[1]!r}::double * py + {_T[2]!r}::double)')} AS x, {_micro(f'({_T[3]!r}::double * px + {_T[4]!r}::double * py + {_T[5]!r}::double)')} AS y FROM trk")
def similarity_transform(spark, d):
    x, y = geometry.project(F.col("px"), F.col("py"), _T)
    return track_points(spark, d).select("track_id", "frame", x.alias("x0"), y.alias("y0")).selectExpr("track_id", "frame", f"{_micro('x0')} AS x", f"{_micro('y0')} AS y")


@query("""WITH s AS (SELECT track_id, t, frame, px FROM trk WHERE frame % 7 = 0), f AS (SELECT track_id, arg_min(px, (t, frame)) AS first FROM s GROUP BY track_id)
SELECT a.track_id, a.frame, coalesce(s.px, f.first) AS sampled FROM trk a ASOF LEFT JOIN s ON a.track_id = s.track_id AND a.t >= s.t LEFT JOIN f ON f.track_id = a.track_id""")
def asof_quad(spark, d):
    return tracks.as_of_sample(track_points(spark, d), F.col("frame") % 7 == 0, "px").select("track_id", "frame", "sampled")


_IOU = "(greatest(least(a.x2, b.x2) - greatest(a.x1, b.x1), 0) * greatest(least(a.y2, b.y2) - greatest(a.y1, b.y1), 0))"


@query(f"""WITH a AS (SELECT *, {{k}} FROM boxes), p AS (SELECT video_id, 0 AS frame, frame * 100 + idx AS idx, x1, y1, x2, y2 FROM boxes),
 hits AS (SELECT a.video_id, a.idx, b.idx AS r_idx, {_IOU} / ((a.x2 - a.x1) * (a.y2 - a.y1) + (b.x2 - b.x1) * (b.y2 - b.y1) - {_IOU}) AS iou FROM p a JOIN p b ON a.video_id = b.video_id AND a.idx % 2 = 1 AND b.idx % 2 = 0),
 best AS (SELECT *, row_number() OVER (PARTITION BY video_id, idx ORDER BY iou DESC, r_idx) AS n FROM hits WHERE iou > 0.25)
SELECT p.video_id, p.idx, best.r_idx FROM p LEFT JOIN best ON p.video_id = best.video_id AND p.idx = best.idx AND n = 1 WHERE p.idx % 2 = 1""".replace("a AS (SELECT *, {k} FROM boxes), ", ""))
def pose_match_iou(spark, d):
    p = boxes(spark, d).select("video_id", F.lit(0).alias("frame"), (F.col("frame") * 100 + F.col("idx")).alias("idx"), "x1", "y1", "x2", "y2")
    return matching.best_overlap(p.where("idx % 2 = 1"), p.where("idx % 2 = 0")).select("video_id", "idx", "r_idx")


@query("SELECT track_id, frame FROM trk a WHERE EXISTS (SELECT 1 FROM trk b WHERE b.track_id = a.track_id AND b.frame % 11 = 0 AND a.t >= b.t AND a.t <= b.t + 7200)")
def flash_semi(spark, d):
    p = track_points(spark, d)
    return matching.in_any_interval(p, p.where("frame % 11 = 0"), 7200.0).select("track_id", "frame")


@query("SELECT track_id, frame, CAST(list_position(l, list_min(l)) - 1 AS integer) AS hoop FROM (SELECT track_id, frame, [abs(px - 0.25::double), abs(px - 0.5::double), abs(px - 0.75::double)] AS l FROM trk)")
def nearest_hoop(spark, d):
    return track_points(spark, d).select("track_id", "frame", matching.nearest_hoop(F.col("px"), HOOPS).alias("hoop"))


@query("""WITH h AS (SELECT *, CASE WHEN conf >= 0.5::double THEN CAST(list_position(l, list_min(l)) - 1 AS integer) END AS k FROM (SELECT *, [abs(px - 0.25::double), abs(px - 0.5::double), abs(px - 0.75::double)] AS l FROM trk))
SELECT track_id, frame, coalesce(last_value(k IGNORE NULLS) OVER (PARTITION BY track_id ORDER BY t, frame ROWS UNBOUNDED PRECEDING), 0) AS hoop FROM h""")
def hoop_forward_fill(spark, d):
    k = F.when(F.col("conf") >= 0.5, matching.nearest_hoop(F.col("px"), HOOPS))
    w = tracks.by_time().rowsBetween(tracks.Window.unboundedPreceding, 0)
    return track_points(spark, d).select("track_id", "frame", F.coalesce(F.last(k, ignorenulls=True).over(w), F.lit(0)).alias("hoop"))


@query("""WITH r AS (SELECT video_id, frame * 100 + idx AS idx, x1, row_number() OVER w AS n, x1 - lag(x1) OVER w AS gap FROM boxes WINDOW w AS (PARTITION BY video_id ORDER BY x1, frame * 100 + idx)),
 c AS (SELECT video_id, arg_min(n, (-gap, n)) AS cut FROM r WHERE gap >= 0.12::double GROUP BY video_id)
SELECT r.video_id, coalesce(CAST(n >= cut AS integer), 0) AS side, median(x1) AS x, count(*) AS n FROM r LEFT JOIN c ON r.video_id = c.video_id GROUP BY 1, 2""")
def hoop_clusters(spark, d):
    rows = boxes(spark, d).select("video_id", (F.col("frame") * 100 + F.col("idx")).alias("idx"), "x1")
    return matching.largest_gap_split(rows, "video_id", "x1").groupBy("video_id", "side").agg(F.median("x1").alias("x"), F.count("*").alias("n"))


@query("SELECT video_id, frame, label, idx FROM (SELECT *, row_number() OVER (PARTITION BY video_id, label ORDER BY conf DESC, frame, idx) AS n FROM boxes) WHERE n = 1")
def top1_per_label(spark, d):
    return matching.top_per_group(boxes(spark, d), ["video_id", "label"], [F.desc("conf"), "frame", "idx"], 1).select("video_id", "frame", "label", "idx")


@query("SELECT track_id, frame, CAST(n AS integer) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY conf DESC, frame) AS n FROM trk) WHERE n <= 12")
def topk_crops(spark, d):
    return matching.top_per_group(track_points(spark, d), ["track_id"], [F.desc("conf"), "frame"], 12).select("track_id", "frame", "rank")


@query("SELECT thr, count(*) AS n, count(DISTINCT video_id) AS videos FROM boxes, (SELECT unnest([0.1, 0.15, 0.2, 0.25, 0.3, 0.35]::double[]) AS thr) WHERE conf >= thr GROUP BY thr")
def conf_sweep(spark, d):
    rows = boxes(spark, d).withColumn("thr", F.explode(F.array(*[F.lit(x) for x in (0.1, 0.15, 0.2, 0.25, 0.3, 0.35)]))).where("conf >= thr")
    return rows.groupBy("thr").agg(F.count("*").alias("n"), F.count_distinct("video_id").alias("videos"))


@query("SELECT label, count(*) AS n, CAST(sum(CAST(conf >= 0.2::double AS integer)) AS bigint) AS detected, CAST(round(sum(CASE WHEN conf >= 0.2::double THEN conf * 100 ELSE 0 END)) AS bigint) AS conf_sum FROM trk GROUP BY label")
def detector_eval(spark, d):
    hit = F.col("conf") >= 0.2
    return track_points(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.sum(hit.cast("int")).alias("detected"), F.round(F.sum(F.when(hit, F.col("conf") * 100).otherwise(0.0))).cast("bigint").alias("conf_sum"))


@query("""WITH v AS (SELECT track_id, frame % 4 AS number, sum((frame * 53) % 100) AS w, count(*) AS n FROM trk WHERE frame % 4 < 1 + track_id % 3 GROUP BY 1, 2),
 b AS (SELECT *, sum(w) OVER (PARTITION BY track_id) AS a, row_number() OVER (PARTITION BY track_id ORDER BY w DESC, number) AS k FROM v)
SELECT track_id, CASE WHEN w >= 0.6::double * a AND n >= 2 THEN number END AS number FROM b WHERE k = 1""")
def jersey_vote(spark, d):
    votes = track_points(spark, d).where("frame % 4 < 1 + track_id % 3").select("track_id", (F.col("frame") % 4).alias("number"), (F.col("frame") * 53 % 100).alias("w0"))
    return matching.weighted_vote(votes.withColumnRenamed("w0", "weight"), "track_id", "number", "weight")


@query("SELECT track, label AS team FROM (SELECT *, row_number() OVER (PARTITION BY track ORDER BY n DESC, label) AS k FROM (SELECT vec_id % 50 AS track, label, count(*) AS n FROM embeddings GROUP BY 1, 2)) WHERE k = 1")
def majority_vote(spark, d):
    counts = read(spark, d, "embeddings").groupBy((F.col("vec_id") % 50).alias("track"), "label").agg(F.count("*").alias("n"))
    return matching.top_per_group(counts, ["track"], [F.desc("n"), "label"], 1).select("track", F.col("label").alias("team"))


@query("""WITH s AS (SELECT *, t - lag(t) OVER w AS dt, abs(px - lag(px) OVER w) AS dx FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY t, frame)),
 n AS (SELECT *, sum(CASE WHEN dt > 0 AND dt <= 36000 AND dx <= 0.3::double THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY t, frame ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT track_id, frame, first_value(frame) OVER (PARTITION BY track_id, session ORDER BY py, t DESC, conf DESC, frame) AS primary_frame FROM n""")
def dedupe_sessions(spark, d):
    return tracks.sessions(track_points(spark, d), 10 * HOUR, 0.3).select("track_id", "frame", "primary_frame")


@query("""WITH f AS (SELECT *, conf >= 0.2::double AS v, conf >= 0.2::double AND py BETWEEN 0.45::double - 0.03::double AND 0.45::double + 0.03::double AS tube FROM trk),
 b AS (SELECT *, max(CASE WHEN v AND py > 0.45::double THEN py END) OVER w AS deepest, last_value(CASE WHEN v AND py <= 0.45::double THEN py END IGNORE NULLS) OVER w AS above,
  max(CASE WHEN v AND NOT tube THEN 1 ELSE 0 END) OVER w AS outside FROM f WINDOW w AS (PARTITION BY track_id ORDER BY t, frame ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING))
SELECT track_id, frame, signal FROM (SELECT track_id, frame, CASE WHEN v AND py > 0.45::double AND py >= above + 0.003::double THEN 'crossed_down'
 WHEN v AND py <= 0.45::double AND deepest IS NOT NULL AND py <= greatest(deepest, 0.45::double) - 0.005::double THEN 'crossed_up' WHEN tube AND outside = 1 THEN 'rim_tube' END AS signal FROM b) WHERE signal IS NOT NULL""")
def rim_signals(spark, d):
    return tracks.rim_signals(track_points(spark, d), 0.45).where("signal IS NOT NULL").select("track_id", "frame", "signal")


#: Rows of all points with the signals, the gates that look back, and what the automaton needs; then its steps, one row of each track at a time.
_JUDGED = """f AS (SELECT *, conf >= 0.2::double AS v, conf >= 0.3::double AS d, abs(px - 0.5::double) AS x, conf >= 0.2::double AND py BETWEEN 0.45::double - 0.03::double AND 0.45::double + 0.03::double AS tube FROM trk),
 b AS (SELECT *, max(CASE WHEN v AND py > 0.45::double THEN py END) OVER back AS deepest, last_value(CASE WHEN v AND py <= 0.45::double THEN py END IGNORE NULLS) OVER back AS above,
  max(CASE WHEN v AND NOT tube THEN 1 ELSE 0 END) OVER back AS outside, first_value(CASE WHEN v THEN x END IGNORE NULLS) OVER back AS first,
  coalesce(lag(v) OVER w AND x > lag(x) OVER w + 0.005::double, false) AS away, row_number() OVER w AS n, coalesce(py < lag(py) OVER w, false) AS up,
  d AND row_number() OVER w > 2 AND (max(CAST(v AND NOT d AS integer)) OVER (PARTITION BY track_id ORDER BY t, frame ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING) = 1 OR NOT lag(v AND d) OVER w) AS again,
  coalesce((px - lag(px, 2) OVER w) / 2, 0) AS vx, coalesce((py - lag(py, 2) OVER w) / 2, 0) AS vy
  FROM f WINDOW w AS (PARTITION BY track_id ORDER BY t, frame), back AS (PARTITION BY track_id ORDER BY t, frame ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING)),
 r AS (SELECT *, coalesce(deepest >= 0.45::double + 0.012::double AND py <= deepest - 0.005::double, false) AS risen FROM b),
 s AS (SELECT *, CASE WHEN v AND py > 0.45::double AND py >= above + 0.003::double THEN 'crossed_down' WHEN v AND py <= 0.45::double AND deepest IS NOT NULL AND py <= greatest(deepest, 0.45::double) - 0.005::double THEN 'crossed_up'
  WHEN tube AND outside = 1 THEN 'rim_tube' WHEN v AND py > 0.45::double AND py <= 0.45::double + 0.08::double AND risen THEN 'approach' WHEN again AND py <= 0.45::double + 0.08::double AND risen THEN 'resume' END AS signal FROM r),
 g AS (SELECT *, x <= (0.2::double / 2 * 1.5::double) AS near, v AND py > 0.45::double + 0.07::double AS low, v AND n > 1 AND signal IS NOT NULL AND x <= (0.2::double / 2 * 1.5::double)
  AND py <= 0.45::double + CASE WHEN signal IN ('crossed_up', 'crossed_down', 'rim_tube') THEN 0.08::double ELSE 0.03::double END
  AND (signal IN ('crossed_up', 'crossed_down', 'rim_tube') OR (NOT away AND (x <= 0.4::double * (0.2::double / 2 * 1.5::double) OR coalesce(x < first - 0.005::double, false)))) AS candidate FROM s),
 steps AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t, frame) AS k FROM g WHERE candidate OR low),
 runs AS (SELECT track_id, 0::bigint AS k, true AS armed, -1e300::double AS last, NULL::bigint AS hit FROM (SELECT DISTINCT track_id FROM steps)
  UNION ALL SELECT s.track_id, s.k, CASE WHEN NOT r.armed THEN s.low ELSE NOT (s.candidate AND s.t - r.last >= 3600) END, CASE WHEN r.armed AND s.candidate AND s.t - r.last >= 3600 THEN s.t ELSE r.last END,
   CASE WHEN r.armed AND s.candidate AND s.t - r.last >= 3600 THEN s.frame END FROM runs r JOIN steps s ON s.track_id = r.track_id AND s.k = r.k + 1),
 shots AS (SELECT s.*, sqrt(vx * vx + vy * vy) AS speed FROM runs r JOIN steps s ON s.track_id = r.track_id AND s.k = r.k WHERE r.hit IS NOT NULL)"""
_CONFIDENCE = "0.3::double * least(speed / 0.08::double, 1.0::double) + 0.7::double * (0.3::double * up::integer + 0.3::double * near::integer + 0.2::double * d::integer + 0.2::double * (frame % 2 = 0)::integer)"


def _shots(spark, d):
    detected = F.col("conf") >= 0.3
    rows = attempts.judged(track_points(spark, d), 0.5, 0.2, 0.45, detected)
    rows = rows.withColumn("confidence", fb.attempt_confidence(F.col("speed"), F.col("up"), F.col("near"), detected.cast("int"), (F.col("frame") % 2 == 0).cast("int")))
    return attempts.shot_attempts(rows, 0.45, HOUR)


@query(f"WITH RECURSIVE {_JUDGED} SELECT track_id, frame, signal, {_micro('speed')} AS speed, CAST(floor(({_CONFIDENCE}) * 1000 + 0.5) AS bigint) AS confidence FROM shots")
def shot_attempts(spark, d):
    """All six gates and five signals of each track's rows, with the entry speed and the soft score of each attempt."""
    return _shots(spark, d).select("track_id", "frame", "signal", F.expr(_micro("speed")).alias("speed"), F.floor(F.col("confidence") * 1000 + 0.5).alias("confidence"))


@query(f"""WITH RECURSIVE {_JUDGED}, e AS (SELECT *, t - lag(t) OVER w AS dt, abs(px - lag(px) OVER w) AS dx FROM shots WINDOW w AS (PARTITION BY track_id ORDER BY t, frame)),
 o AS (SELECT *, sum(CASE WHEN dt > 0 AND dt <= 36000 AND dx <= 0.3::double THEN 0 ELSE 1 END) OVER (PARTITION BY track_id ORDER BY t, frame ROWS UNBOUNDED PRECEDING) AS session FROM e)
SELECT track_id, count(*) AS attempts, count(DISTINCT session) AS kept, sum(CAST(signal IN ('approach', 'resume') AS integer)) AS away_from_rim, min(frame) AS least_frame FROM o GROUP BY track_id""")
def attempt_summary(spark, d):
    """From points to attempts to sessions: how many attempts a track has, and how many are left when repeats are taken out."""
    rows = tracks.sessions(_shots(spark, d), 10 * HOUR, 0.3)
    away = F.sum(F.col("signal").isin("approach", "resume").cast("int"))
    return rows.groupBy("track_id").agg(F.count("*").alias("attempts"), F.count_distinct("session").alias("kept"), away.alias("away_from_rim"), F.min("frame").alias("least_frame"))


@query()
def ball_kalman(spark, d):
    return folds.ball_track(track_points(spark, d)).withColumns({c: F.round(c, 6) for c in ("x", "y")})


@query()
def merge_tracks(spark, d):
    ends = track_points(spark, d).withColumn("part", F.floor(F.col("t") / 86_400)).groupBy("track_id", "part").agg(
        F.min("t").alias("t0"), F.min_by("px", F.struct("t", "frame")).alias("x0"), F.min_by("py", F.struct("t", "frame")).alias("y0"),
        F.max("t").alias("t1"), F.max_by("px", F.struct("t", "frame")).alias("x1"), F.max_by("py", F.struct("t", "frame")).alias("y1"),
    )
    team = F.when(F.col("track_id") % 3 > 0, F.concat(F.lit("team"), F.col("track_id") % 3))
    rows = ends.select((F.col("track_id") % 10).alias("video_id"), (F.col("track_id") * 100 + F.col("part")).alias("track_id"), "t0", "x0", "y0", "t1", "x1", "y1", team.alias("team"), F.lit(None).cast("string").alias("jersey"))
    return folds.merge_tracks(rows, 6 * HOUR)


_CLOCK = """WITH d AS (SELECT *, length(raw) AS n FROM reads),
 c AS (SELECT video_id, idx, CASE
  WHEN n = 3 THEN [[raw[1], raw[2:3]]] WHEN n = 4 THEN [[raw[1], raw[3:4]], [raw[1], raw[2:3]], [raw[1], raw[2] || raw[4]], [raw[1:2], raw[3:4]]]
  WHEN n = 5 THEN [[raw[1], raw[3:4]], [raw[1], raw[4:5]], [raw[1:2], raw[3:4]]] ELSE []::varchar[][] END AS p FROM d),
 v AS (SELECT video_id, idx, list_transform(list_filter(p, lambda x: x[1]::int <= 15 AND x[2]::int <= 59), lambda x: x[1]::int * 60 + x[2]::int) AS s FROM c)"""


@query(f"{_CLOCK} SELECT video_id, idx, coalesce(array_to_string(list_sort(list_distinct(s)), ','), '') AS seconds, s[1] AS first FROM v")
def clock_candidates(spark, d):
    s = text.clock_candidates(F.col("raw"))
    return readings(spark, d).select("video_id", "idx", F.array_join(F.array_sort(s).cast("array<string>"), ",").alias("seconds"), F.try_element_at(s, F.lit(1)).alias("first"))


@query(f"{_CLOCK} SELECT video_id, idx, CASE WHEN len(s) > 0 THEN (s[1] // 60)::varchar || ':' || lpad((s[1] % 60)::varchar, 2, '0') END AS clock FROM v")
def clock_canonical(spark, d):
    return readings(spark, d).select("video_id", "idx", text.format_clock(F.try_element_at(text.clock_candidates(F.col("raw")), F.lit(1))).alias("clock"))


@query(f"""{_CLOCK} SELECT r.video_id, r.idx, CASE WHEN len(s) > 0 THEN s[1] WHEN length(raw) <= 2 AND raw::int <= 35 THEN raw::int END AS clock,
 CASE WHEN raw::int <= 999 THEN raw::int END AS score, raw[1]::int AS quarter FROM reads r JOIN v USING (video_id, idx)""")
def parse_fields(spark, d):
    raw = F.col("raw")
    return readings(spark, d).select("video_id", "idx", text.parse_clock(raw).alias("clock"), text.parse_score(raw).alias("score"), text.parse_quarter(raw).alias("quarter"))


@query()
def clock_track(spark, d):
    rows = readings(spark, d).select("video_id", "idx", F.col("idx").cast("double").alias("t"), text.clock_candidates(F.col("raw")).alias("candidates"))
    return folds.clock_track(rows)


@query(f"{_CLOCK} SELECT video_id, s[1] AS clock, min(idx) AS idx FROM v WHERE len(s) > 0 GROUP BY 1, 2")
def clock_to_video(spark, d):
    rows = readings(spark, d).withColumn("clock", F.try_element_at(text.clock_candidates(F.col("raw")), F.lit(1)))
    return rows.where("clock IS NOT NULL").groupBy("video_id", "clock").agg(F.min("idx").alias("idx"))


@query("""SELECT video_id, frame, idx, printf('0 %.6f %.6f %.6f %.6f', x1, y1, x2 - 0.25::double, y2 - 0.25::double) AS line FROM boxes WHERE label <> 'R' AND x2 - 0.25::double > 0 AND y2 - 0.25::double > 0""")
def label_line_validate(spark, d):
    line = F.concat_ws(" ", F.when(F.col("label") == "R", "1").otherwise("0"), "x1", "y1", F.col("x2") - 0.25, F.col("y2") - 0.25)
    return boxes(spark, d).select("video_id", "frame", "idx", text.label_line(line).alias("line")).where("line IS NOT NULL")


@query("SELECT CASE WHEN vec_id % 10 = 3 THEN 'valid' ELSE 'train' END AS split, label, count(*) AS n FROM embeddings GROUP BY 1, 2")
def dataset_split(spark, d):
    split = F.when(F.col("vec_id") % 10 == 3, "valid").otherwise("train")
    return read(spark, d, "embeddings").groupBy(split.alias("split"), "label").agg(F.count("*").alias("n"))


@query("""SELECT page_id, lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)) AS host, CASE WHEN NOT regexp_matches(lower(url), '^https?://') THEN 'error'
 WHEN regexp_matches(lower(regexp_extract(url, '^[a-zA-Z][a-zA-Z0-9+.-]*://([^/?#:]+)', 1)), '(^|[.])(youtube[.]com|youtu[.]be)$') THEN 'youtube'
 WHEN regexp_matches(lower(regexp_replace(url, '[?#].*$', '')), '[.](mp4|mov|mkv|webm)$') THEN 'direct' ELSE 'probe' END AS kind FROM pages""")
def url_kind(spark, d):
    return read(spark, d, "pages").select("page_id", text.url_host(F.col("url")).alias("host"), text.url_kind(F.col("url")).alias("kind"))


@query("SELECT label, count(*) AS n, count(DISTINCT track_id) AS tracks FROM trk GROUP BY label")
def class_counts(spark, d):
    return track_points(spark, d).groupBy("label").agg(F.count("*").alias("n"), F.count_distinct("track_id").alias("tracks"))


@query("""WITH m AS (SELECT label, i, avg(x::double) AS x FROM (SELECT label, unnest(embedding) AS x, generate_subscripts(embedding, 1) AS i FROM embeddings) GROUP BY 1, 2),
 p AS (SELECT label, list(x ORDER BY i) AS p FROM m GROUP BY label),
 s AS (SELECT vec_id, p.label, list_cosine_similarity(embedding::double[], p) AS c FROM embeddings, p)
SELECT vec_id, arg_min(label, (-c, label)) AS kit FROM s GROUP BY vec_id""")
def prototype_match(spark, d):
    e = read(spark, d, "embeddings")
    return matching.nearest_prototype(e.select("vec_id", "embedding"), matching.prototypes(e, "label", "embedding")).select("vec_id", "kit")


@query("SELECT video_id, min(x1) AS x1, min(y1) AS y1, max(x2) AS x2, max(y2) AS y2, arg_max(frame * 100 + idx, (conf, -frame * 100 - idx)) AS best FROM boxes GROUP BY video_id")
def union_box(spark, d):
    n = F.col("frame") * 100 + F.col("idx")
    return boxes(spark, d).groupBy("video_id").agg(F.min("x1").alias("x1"), F.min("y1").alias("y1"), F.max("x2").alias("x2"), F.max("y2").alias("y2"), F.max_by(n, F.struct("conf", -n)).alias("best"))
