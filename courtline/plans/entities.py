"""Queries of single records and of whole documents: conversions, regions, colours, lookups by key, running averages, the engine's documents."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from courtline.functions import boxes as fb
from courtline.functions import colour, geometry, text
from courtline.operators import lookback, matching, tracks
from courtline.plans.catalogue import _POLYGON, _X, _Y, QUAD, H, _micro, query
from courtline.plans.observations import _CORNERS, _KEY, _rounded
from courtline.sources import typed
from courtline.sources.views import boxes, read, readings, track_points

_SIZE = ("x", "y", "w", "h")
_AT = ["track_id", "frame"]


def _micros(columns: dict[str, str]) -> str:
    return ", ".join(f"{_micro(f'({v})')} AS {k}" for k, v in columns.items())


def _near(c: str) -> str:
    """A double as whole hundred-thousandths, cut where no decimal of few places lies: for sums in another order than the engine compared with."""
    return f"CAST(floor({c} * 100000 + 0.50037193) AS bigint)"


# records -----------------------------------------------------------------------------------------------------------

_KINDS = ["video/mp4; codecs=avc1", " Video/QuickTime ", "video/x-matroska", "video/webm;q=1", "video/ogg", "text/html", "image/png"]


@query(f"""SELECT event_id, CASE k WHEN 'video/mp4' THEN '.mp4' WHEN 'video/quicktime' THEN '.mov' WHEN 'video/x-matroska' THEN '.mkv' WHEN 'video/webm' THEN '.webm'
 ELSE CASE WHEN starts_with(k, 'video/') THEN '.mp4' END END AS extension
 FROM (SELECT event_id, lower(trim(split_part({_KINDS}[event_id % 7 + 1], ';', 1))) AS k FROM events)""")
def content_extensions(spark, d):
    kind = F.element_at(F.array(*[F.lit(k) for k in _KINDS]), (F.col("event_id") % 7 + 1).cast("int"))
    return read(spark, d, "events").select("event_id", text.content_extension(kind).alias("extension"))


@query("SELECT frame, track_id, 20.0::double + (frame - 200) / 10.0::double AS at FROM trk WHERE frame >= 200 AND (frame - 200) % 5 = 0")
def seek_sampling(spark, d):
    return tracks.sampled(track_points(spark, d), 5, 10.0, start=20.0).select("frame", "track_id", "at")


@query("SELECT track_id, min(sec) AS first_at, max(sec) AS last_at, count(*) AS n FROM (SELECT track_id, frame / 10.0::double AS sec FROM trk WHERE frame % 2 = 0) WHERE sec <= 60 GROUP BY track_id")
def seek_with_end(spark, d):
    """Samples up to a video's end time, which is a time and no number of rows."""
    rows = tracks.sampled(track_points(spark, d), 2, 10.0, end=60.0)
    return rows.groupBy("track_id").agg(F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.count("*").alias("n"))


@query(f"SELECT video_id, frame, idx, {_micros({'x': '(x1 * 1280 + x2 * 1280) / 2 / 1920', 'y': '(y1 * 720 + y2 * 720) / 2 / 1080', 'w': '(x2 * 1280 - x1 * 1280) / 1920', 'h': '(y2 * 720 - y1 * 720) / 1080'})} FROM boxes")
def centre_detections(spark, d):
    b = boxes(spark, d)
    made = fb.centre_detection(b.x1 * 1280, b.y1 * 720, b.x2 * 1280, b.y2 * 720, 1920, 1080)
    return _rounded(b.select(*_KEY, *[v.alias(k) for k, v in made.items()]), _KEY, _SIZE)


_FOOT = _POLYGON.replace("px", "fx").replace("py", "fy")


@query(f"""WITH f AS (SELECT *, (least(greatest(x1, 0), 1) + least(greatest(x2, 0), 1)) / 2 AS fx, least(greatest(y2, 0), 1) AS fy FROM boxes WHERE idx = 1 AND label IN ('A', 'N'))
SELECT video_id, frame, CASE label WHEN 'A' THEN 'player' ELSE 'referee' END AS label, {_micros({'foot_x': 'fx', 'foot_y': 'fy'})} FROM f WHERE ({_FOOT}) % 2 = 1""")
def player_observations(spark, d):
    """Boxes with an id and a known label whose foot is on the court."""
    b = boxes(spark, d).where("idx = 1 AND label IN ('A', 'N')")
    made = fb.corner_detection(b.x1, b.y1, b.x2, b.y2, F.lit(True))
    rows = b.select("video_id", "frame", F.when(b.label == "A", "player").otherwise("referee").alias("label"), made["foot_x"].alias("foot_x"), made["foot_y"].alias("foot_y"))
    return _rounded(rows.where(geometry.in_polygon(F.col("foot_x"), F.col("foot_y"), QUAD)), ["video_id", "frame", "label"], ["foot_x", "foot_y"])


@query(f"SELECT video_id, frame, idx, {_micros({'x': '(x1 + x2) / 2', 'y': '(y1 + y2) / 2', 'w': 'x2 - x1', 'h': 'y2 - y1'})} FROM boxes WHERE label = 'N'")
def detection_to_roi(spark, d):
    """Hoop detections as centre regions: columns renamed, confidence dropped."""
    b = boxes(spark, d).where("label = 'N'")
    return _rounded(b.select(*_KEY, ((b.x1 + b.x2) / 2).alias("x"), ((b.y1 + b.y2) / 2).alias("y"), (b.x2 - b.x1).alias("w"), (b.y2 - b.y1).alias("h")), _KEY, _SIZE)


@query(f"""SELECT video_id, frame, idx, {_micros({'x': '(x1 - 0.1::double) / 0.8::double', 'y': '(y1 - 0.2::double) / 0.5::double', 'w': '(x2 - x1) / 0.8::double', 'h': '(y2 - y1) / 0.5::double'})},
 {_micros({'back_x': '0.1::double + (x1 - 0.1::double) / 0.8::double * 0.8::double', 'back_y': '0.2::double + (y1 - 0.2::double) / 0.5::double * 0.5::double'})} FROM boxes""")
def region_in_parent(spark, d):
    b, parent = boxes(spark, d), tuple(F.lit(v) for v in (0.1, 0.2, 0.8, 0.5))
    x, y, w, h = fb.region_in_parent((b.x1, b.y1, b.x2 - b.x1, b.y2 - b.y1), parent)
    rows = b.select(*_KEY, *[v.alias(k) for k, v in zip(_SIZE, (x, y, w, h), strict=True)])
    rows = rows.withColumns({"back_x": parent[0] + F.col("x") * parent[2], "back_y": parent[1] + F.col("y") * parent[3]})
    return _rounded(rows, _KEY, [*_SIZE, "back_x", "back_y"])


def _edge(x: str) -> str:
    return f"least(greatest({x}, 0.0::double), 1.0::double)"


@query(f"SELECT video_id, frame, idx, {_micros({'l': _edge('x1 - w * 3.5::double / 2'), 't': _edge('y1 - h * 3.5::double / 2'), 'r': _edge('x1 + w * 3.5::double / 2'), 'b': _edge('y1 + h * 3.5::double / 2')})} FROM (SELECT *, x2 - x1 AS w, y2 - y1 AS h FROM boxes)")
def search_regions(spark, d):
    b = boxes(spark, d)
    edges = fb.search_region(b.x1, b.y1, b.x2 - b.x1, b.y2 - b.y1)
    return _rounded(b.select(*_KEY, *[v.alias(k) for k, v in zip("ltrb", edges, strict=True)]), _KEY, list("ltrb"))


def _bound(v: str, size: int) -> str:
    return f"greatest(0, least({size}, CAST(trunc(({v}) * {size}) AS integer)))"


@query(f"""SELECT video_id, frame, idx, {_bound('x1 - 0.2::double', 1280)} AS left_px, {_bound('x1 - 0.2::double + (x2 - x1) * 2', 1280)} AS right_px,
 CAST(round_even(x1 * 1280, 0) AS integer) AS box_l, CAST(round_even((x1 + (x2 - x1)) * 1280, 0) AS integer) AS box_r, CAST(trunc((x1 - (x2 - x1) / 2) * 1280) AS integer) AS roi_l FROM boxes""")
def pixel_bounds(spark, d):
    b = boxes(spark, d)
    w, h = b.x2 - b.x1, b.y2 - b.y1
    crop, box, roi = fb.crop_bounds(b.x1 - 0.2, b.y1, w * 2, h, 1280, 720), fb.pixel_box(b.x1, b.y1, w, h, 1280, 720), fb.roi_pixels(b.x1, b.y1, w, h, 1280, 720)
    return b.select(*_KEY, crop[0].alias("left_px"), crop[2].alias("right_px"), box[0].alias("box_l"), box[2].alias("box_r"), roi[0].alias("roi_l"))


@query(f"""SELECT video_id, frame, idx, k, {_micros({'x': '(1 - k / 23.0::double) * x1 + k / 23.0::double * x2', 'y': '(1 - k / 23.0::double) * y1 + k / 23.0::double * y2'})}
 FROM (SELECT *, CAST(unnest(range(24)) AS integer) AS k FROM boxes WHERE label = 'R')""")
def segment_samples(spark, d):
    b = boxes(spark, d).where("label = 'R'")
    rows = b.select(*_KEY, F.posexplode(fb.segment_points(b.x1, b.y1, b.x2, b.y2)).alias("k", "p"))
    return _rounded(rows.select(*_KEY, "k", "p.*"), [*_KEY, "k"], ["x", "y"])


_LINEAR = {c: f"CASE WHEN {c} / 255.0::double > 0.04045::double THEN pow(({c} / 255.0::double + 0.055::double) / 1.055::double, 2.4::double) ELSE {c} / 255.0::double / 12.92::double END" for c in "rgb"}


def _bent(x: str) -> str:
    return f"CASE WHEN {x} > 0.008856::double THEN cbrt({x}) ELSE 7.787::double * {x} + 16.0::double / 116.0::double END"


@query(f"""WITH c AS (SELECT frame, (frame * 37) % 256 AS r, (frame * 91) % 256 AS g, (frame * 53) % 256 AS b FROM trk), l AS (SELECT frame, {', '.join(f'{v} AS {k}' for k, v in _LINEAR.items())} FROM c),
 x AS (SELECT frame, {', '.join(f"({' + '.join(f'{w}::double * {c}' for w, c in zip(row, 'rgb', strict=True))}) / {white}::double AS {n}" for n, row, white in zip('xyz', colour._XYZ, colour._WHITE, strict=True))} FROM l),
 f AS (SELECT frame, y, {', '.join(f'{_bent(c)} AS f{c}' for c in 'xyz')} FROM x)
SELECT frame, {_near('(CASE WHEN y > 0.008856::double THEN 116 * cbrt(y) - 16 ELSE 903.3::double * y END) * 2.55::double')} AS l, {_near('(500 * (fx - fy) + 128)')} AS a, {_near('(200 * (fy - fz) + 128)')} AS b FROM f""")
def lab_colours(spark, d):
    at = F.col("frame")
    made = colour.lab(at * 37 % 256, at * 91 % 256, at * 53 % 256)
    return track_points(spark, d).select("frame", *[v.alias(k) for k, v in zip("lab", made, strict=True)]).selectExpr("frame", *[f"{_near(k)} AS {k}" for k in "lab"])


@query(f"SELECT video_id, frame, idx, {_micros({'crop': '(y2 - y1) * (0.35::double + conf * 255 / 255.0::double)', 'jersey': '(y2 - y1) * least(conf * 500 / 100.0::double, 3.0::double)'})} FROM boxes")
def crop_scores(spark, d):
    b = boxes(spark, d)
    rows = b.select(*_KEY, colour.crop_quality(b.y2 - b.y1, b.conf * 255).alias("crop"), colour.jersey_sharpness(b.y2 - b.y1, b.conf * 500).alias("jersey"))
    return _rounded(rows, _KEY, ["crop", "jersey"])


@query("""WITH s AS (SELECT track_id, median((frame * 37) % 120) AS sat, median((frame * 91) % 90) AS spread, abs(median(px) - 0.5::double) < 0.01::double AS near FROM trk GROUP BY track_id)
SELECT track_id, CASE WHEN (sat < 28 OR (spread >= 40 AND sat < 50)) AND NOT near THEN 'referee' ELSE 'player' END AS label FROM s""")
def appearance_referees(spark, d):
    s = track_points(spark, d).groupBy("track_id").agg(F.median(F.col("frame") * 37 % 120).alias("sat"), F.median(F.col("frame") * 91 % 90).alias("spread"), (F.abs(F.median("px") - 0.5) < 0.01).alias("near"))
    return s.select("track_id", F.when(colour.looks_like_referee(F.col("sat"), F.col("spread"), F.col("near")), "referee").otherwise("player").alias("label"))


_ORDERS = ["0,1,2,3", " 3, 2,1 ,0", "auto", "", "0,1,2", "0,1,1,3", "1,0,3,x", None]
_ORDER_LIST = "[" + ", ".join("NULL" if o is None else f"'{o}'" for o in _ORDERS) + "]"


@query(f"""SELECT frame, CASE WHEN list_sort(p) = [0, 1, 2, 3] THEN array_to_string(p, '') END AS keypoints
 FROM (SELECT frame, list_transform(string_split({_ORDER_LIST}[frame % 8 + 1], ','), lambda x: try_cast(trim(x) AS integer)) AS p FROM trk)""")
def keypoint_orders(spark, d):
    given = F.element_at(F.array(*[F.lit(o) for o in _ORDERS]), (F.col("frame") % 8 + 1).cast("int"))
    return track_points(spark, d).select("frame", F.array_join(text.keypoint_order(given), "").alias("keypoints"))


_CLOCKS = ["9:58", "10:07", "0:61", "12:5", "x", "58", "7:00"]
_PERIODS = ["1st", "Q3", "OT", "2OT", "ot", "half", "4"]


@query(f"""SELECT frame, CASE WHEN regexp_matches(c, '^[0-9]+:[0-9]{{1,2}}$') AND split_part(c, ':', 2)::integer <= 59 THEN split_part(c, ':', 1)::integer * 60 + split_part(c, ':', 2)::integer END AS seconds,
 CASE WHEN contains(upper(p), 'OT') THEN 4 + coalesce(try_cast(nullif(regexp_extract(upper(p), '([0-9])?OT', 1), '') AS integer), 1) ELSE try_cast(nullif(regexp_extract(p, '([0-9])', 1), '') AS integer) END AS quarter
 FROM (SELECT frame, {_CLOCKS}[frame % 7 + 1] AS c, {_PERIODS}[frame % 7 + 1] AS p FROM trk)""")
def clocks_and_periods(spark, d):
    pick = lambda values: F.element_at(F.array(*[F.lit(v) for v in values]), (F.col("frame") % 7 + 1).cast("int"))
    rows = track_points(spark, d).select("frame", pick(_CLOCKS).alias("c"), pick(_PERIODS).alias("p"))
    return rows.select("frame", text.clock_seconds(F.col("c")).alias("seconds"), text.parse_quarter(F.col("p")).alias("quarter"))


_CORNERS_OF_COURT = [(0.0, 0.0), (28.0, 0.0), (28.0, 15.0), (0.0, 15.0)]


@query("SELECT track_id, frame FROM trk WHERE conf >= 0.2::double OR NOT ((CASE WHEN frame % 3 = 0 THEN 0 ELSE px END) = 0 AND (CASE WHEN frame % 3 = 0 THEN 0 ELSE py END) = 0)")
def valid_ball(spark, d):
    """A ball that is seen, or one at another place than the origin, which stands for none."""
    x, y = (F.when(F.col("frame") % 3 == 0, 0.0).otherwise(F.col(c)) for c in ("px", "py"))
    return track_points(spark, d).where((F.col("conf") >= 0.2) | ~((x == 0) & (y == 0))).select(*_AT)


# lookups and selections --------------------------------------------------------------------------------------------


@query(f"""WITH p AS (SELECT track_id, frame, label, CASE WHEN {_X} BETWEEN 0 AND 28 AND {_Y} BETWEEN 0 AND 15 THEN 1 ELSE 0 END AS court FROM trk)
SELECT track_id, count(*) AS n, CAST(sum(court) AS bigint) AS n_court FROM p GROUP BY track_id HAVING count(*) >= 15 AND sum(court)::double / count(*) >= 0.2::double""")
def kept_tracks(spark, d):
    """Tracks of enough points with enough of them on the court."""
    x, y = geometry.project(F.col("px"), F.col("py"), H)
    on = geometry.within_court(F.col("hx"), F.col("hy"), 28, 15, 0)
    rows = track_points(spark, d).withColumns({"hx": x, "hy": y}).groupBy("track_id").agg(F.count("*").alias("n"), F.sum(F.coalesce(on, F.lit(False)).cast("int")).alias("n_court"))
    return rows.where((F.col("n") >= 15) & (F.col("n_court") / F.col("n") >= 0.2))


@query(f"""WITH b AS (SELECT *, (x1 + x2) / 2 AS px, (y1 + y2) / 2 AS py, row_number() OVER (PARTITION BY video_id, frame ORDER BY conf DESC, idx) AS k FROM boxes)
SELECT video_id, frame, idx FROM b WHERE k = 1 AND ({_POLYGON}) % 2 = 1""")
def ball_on_court(spark, d):
    """The surest box of a frame if it is on the court; the next best is not looked at."""
    best = matching.top_per_group(boxes(spark, d), ["video_id", "frame"], [F.desc("conf"), "idx"], 1)
    return best.where(geometry.in_polygon((F.col("x1") + F.col("x2")) / 2, (F.col("y1") + F.col("y2")) / 2, QUAD)).select(*_KEY)


@query(f"SELECT track_id, frame FROM trk WHERE ({_POLYGON}) % 2 = 1 AND {_X} BETWEEN 0 AND 28 AND {_Y} BETWEEN 0 AND 15")
def polygon_and_projection(spark, d):
    x, y = geometry.project(F.col("px"), F.col("py"), H)
    rows = track_points(spark, d).where(geometry.in_polygon(F.col("px"), F.col("py"), QUAD)).withColumns({"hx": x, "hy": y})
    return rows.where(geometry.within_court(F.col("hx"), F.col("hy"), 28, 15, 0)).select(*_AT)


@query("""WITH t AS (SELECT DISTINCT track_id FROM trk), m AS (SELECT track_id, track_id % 2 AS team FROM t WHERE track_id % 3 > 0), j AS (SELECT track_id, track_id % 100 AS jersey FROM t WHERE track_id % 5 > 1)
SELECT t.track_id, team, jersey FROM t LEFT JOIN m ON m.track_id = t.track_id LEFT JOIN j ON j.track_id = t.track_id""")
def track_attributes(spark, d):
    """Tracks with their team and jersey number, where known."""
    t = track_points(spark, d).select("track_id").distinct()
    team = t.where("track_id % 3 > 0").select("track_id", (F.col("track_id") % 2).alias("team"))
    jersey = t.where("track_id % 5 > 1").select("track_id", (F.col("track_id") % 100).alias("jersey"))
    return t.join(team, "track_id", "left").join(jersey, "track_id", "left")


@query("""SELECT f.track_id, f.frame, coalesce(b.conf, 0) >= 0.5::double AS detected, coalesce(a.n, 0) AS attempts FROM trk f
 LEFT JOIN (SELECT frame, conf FROM trk WHERE frame % 2 = 0) b ON b.frame = f.frame LEFT JOIN (SELECT frame, 1 AS n FROM trk WHERE frame % 7 = 0) a ON a.frame = f.frame""")
def frame_lookup(spark, d):
    """Frames with the ball seen in them and the attempts made, none where there is none."""
    p = track_points(spark, d)
    ball, attempt = p.where("frame % 2 = 0").select("frame", "conf"), p.where("frame % 7 = 0").select("frame", F.lit(1).alias("n"))
    rows = p.select(*_AT).join(ball, "frame", "left").join(attempt, "frame", "left")
    return rows.select(*_AT, (F.coalesce("conf", F.lit(0.0)) >= 0.5).alias("detected"), F.coalesce("n", F.lit(0)).alias("attempts"))


@query(f"""WITH r AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t, frame) AS n FROM trk)
SELECT f.track_id, f.frame, {_micros({'hoop_x': 'h.px', 'rim': 'h.py - 0.045::double + 0.025::double'})} FROM r f JOIN r h ON f.track_id = h.track_id AND f.n = h.n""")
def hoop_snapshots(spark, d):
    """Frames and active hoops side by side by place; a track that lacks one of the other fails."""
    n = F.row_number().over(tracks.by_time())
    frames = track_points(spark, d).select("track_id", "frame", n.alias("n"))
    hoops = track_points(spark, d).select("track_id", n.alias("n"), F.col("px").alias("hoop_x"), fb.rim(F.col("py"), F.lit(0.09)).alias("rim"))
    both = frames.join(hoops, ["track_id", "n"], "full")
    checked = F.when(F.col("frame").isNotNull() & F.col("hoop_x").isNotNull(), F.col("frame")).otherwise(F.raise_error(F.lit("frames and hoops differ in number")).cast("bigint"))
    return _rounded(both.withColumn("frame", checked), _AT, ["hoop_x", "rim"])


@query(f"""SELECT k, {_micros({'x': "x", 'y': "y"})} FROM (SELECT 0 AS k, 0.0::double AS px, 0.0::double AS py UNION ALL SELECT 1, 28.0, 0.0 UNION ALL SELECT 2, 28.0, 15.0 UNION ALL SELECT 3, 0.0, 15.0) c, LATERAL (SELECT {_X} / 1280 AS x, {_Y} / 720 AS y) o""")
def court_outline(spark, d):
    """The court's corners in the picture."""
    corners = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(_CORNERS_OF_COURT)], "k int, px double, py double")
    x, y = geometry.project(F.col("px"), F.col("py"), H)
    return _rounded(corners.select("k", (x / 1280).alias("x"), (y / 720).alias("y")), ["k"], ["x", "y"])


@query("""SELECT video_id, arg_min(struct_pack(f := frame, i := idx), (-conf, frame, idx)).f AS frame, arg_min(struct_pack(f := frame, i := idx), (-conf, frame, idx)).i AS idx, max(conf) AS conf
 FROM boxes WHERE (frame + idx) % 5 <> 0 GROUP BY video_id""")
def best_court(spark, d):
    """The surest court of a video with exactly four keypoints, the first of equals."""
    b = boxes(spark, d)
    points = F.slice(F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))]), 1, F.when((b.frame + b.idx) % 5 == 0, 3).otherwise(4))
    whole = b.withColumn("keypoints", points).where(F.size("keypoints") == 4)
    best = whole.groupBy("video_id").agg(F.min(F.struct((-F.col("conf")).alias("c"), "frame", "idx")).alias("b"))
    return best.select("video_id", "b.frame", "b.idx", (-F.col("b.c")).alias("conf"))


@query(f"""SELECT video_id, frame, k, {_micros({'x': 'p.x', 'y': 'p.y'})}, 0.15::double AS conf, 'flow' AS source
 FROM (SELECT video_id, frame, unnest([{{'x': x1, 'y': y1}}, {{'x': x2, 'y': y1}}, {{'x': x2, 'y': y2}}, {{'x': x1, 'y': y2}}]) AS p, CAST(unnest(range(4)) AS integer) AS k FROM boxes WHERE idx = 1)""")
def flow_keypoints(spark, d):
    b = boxes(spark, d).where("idx = 1")
    points = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    rows = b.select("video_id", "frame", F.posexplode(points).alias("k", "p")).select("video_id", "frame", "k", "p.*", F.lit(0.15).alias("conf"), F.lit("flow").alias("source"))
    return _rounded(rows, ["video_id", "frame", "k", "conf", "source"], ["x", "y"])


# rates, votes, orders ----------------------------------------------------------------------------------------------


@query("""SELECT label, CAST(floor(sum(CAST(conf >= 0.2::double AS integer))::double / count(*) * 1000000 + 0.5) AS bigint) AS rate, CAST(floor(sum(CAST(conf < 0.2::double AND frame % 2 = 0 AS integer))::double / count(*) * 1000000 + 0.5) AS bigint) AS predicted,
 CAST(floor(avg(CASE WHEN conf >= 0.2::double THEN conf END) * 1000000 + 0.5) AS bigint) AS mean_conf, sum(CAST(conf >= 0.2::double AS integer))::double / count(*) >= 0.6::double AS rate_ok, avg(CASE WHEN conf >= 0.2::double THEN conf END) >= 0.35::double AS conf_ok
 FROM trk GROUP BY label""")
def detection_rates(spark, d):
    """Shares of seen and of guessed balls, mean confidence of those seen, and whether both gates are passed."""
    seen = F.col("conf") >= 0.2
    share = lambda flag: F.coalesce(F.sum(flag.cast("int")).cast("double") / F.count("*"), F.lit(0.0))
    out = track_points(spark, d).groupBy("label").agg(share(seen).alias("rate"), share(~seen & (F.col("frame") % 2 == 0)).alias("predicted"), F.avg(F.when(seen, F.col("conf"))).alias("mean_conf"))
    return _rounded(out.withColumns({"rate_ok": F.col("rate") >= 0.6, "conf_ok": F.col("mean_conf") >= 0.35}), ["label", "rate_ok", "conf_ok"], ["rate", "predicted", "mean_conf"])


@query(f"""WITH v AS (SELECT track_id, floor(px * 3) AS cluster, count(*) AS n FROM trk GROUP BY 1, 2), b AS (SELECT *, sum(n) OVER (PARTITION BY track_id) AS a, row_number() OVER (PARTITION BY track_id ORDER BY n DESC, cluster) AS k FROM v),
 c AS (SELECT floor(px * 3) AS cluster, avg(px) AS centre FROM trk GROUP BY 1)
SELECT track_id, CAST(CASE WHEN n >= 0.36::double * a THEN b.cluster END AS bigint) AS cluster, CASE WHEN n >= 0.36::double * a THEN {_micro('centre')} END AS centre FROM b JOIN c ON b.cluster = c.cluster WHERE k = 1""")
def vote_to_centroid(spark, d):
    """Each track's commonest cluster, the least on a tie, with the cluster's centre, if it has enough of the votes."""
    p = track_points(spark, d).withColumn("cluster", F.floor(F.col("px") * 3))
    centre = p.groupBy("cluster").agg(F.avg("px").alias("centre"))
    each = p.groupBy("track_id", "cluster").agg(F.count("*").alias("n"))
    best = each.groupBy("track_id").agg(F.min(F.struct((-F.col("n")).alias("m"), "cluster")).alias("b"), F.sum("n").alias("a"))
    rows = best.select("track_id", F.col("b.cluster").alias("cluster"), (-F.col("b.m") >= 0.36 * F.col("a")).alias("ok")).join(centre, "cluster")
    return rows.select("track_id", F.when(F.col("ok"), F.col("cluster")).alias("cluster"), F.when(F.col("ok"), F.expr(_micro("centre"))).alias("centre"))


@query(f"""WITH x AS (SELECT label, unnest(embedding)::double AS x, unnest(range(len(embedding))) AS i FROM embeddings), m AS (SELECT label, i, avg(x) AS x FROM x GROUP BY 1, 2)
SELECT label, CAST(i AS integer) AS i, {_micro('x / greatest(sqrt(sum(x * x) OVER (PARTITION BY label)), 1e-8::double)')} AS x FROM m""")
def unit_prototypes(spark, d):
    rows = matching.unit_prototypes(read(spark, d, "embeddings"), "label", "embedding").select("label", F.posexplode("prototype").alias("i", "x"))
    return _rounded(rows, ["label", "i"], ["x"])


@query("SELECT video_id, frame, idx, CAST(row_number() OVER (PARTITION BY video_id, frame ORDER BY conf DESC, idx) AS integer) AS by_conf, CAST(row_number() OVER (PARTITION BY video_id, frame ORDER BY x1, idx) AS integer) AS by_x FROM boxes")
def detection_orders(spark, d):
    by = lambda *order: F.row_number().over(Window.partitionBy("video_id", "frame").orderBy(*order))
    return boxes(spark, d).select(*_KEY, by(F.desc("conf"), "idx").alias("by_conf"), by("x1", "idx").alias("by_x"))


@query("SELECT track_id, frame, t, 'a' AS source FROM trk WHERE frame % 2 = 0 UNION ALL SELECT CASE WHEN track_id % 4 = 3 THEN track_id - 1 ELSE track_id END, frame, t, 'b' FROM trk WHERE frame % 3 = 0")
def union_merged_tracks(spark, d):
    """Points of two passes, the second under the number of the track that it was merged into."""
    p = track_points(spark, d)
    merged = F.when(F.col("track_id") % 4 == 3, F.col("track_id") - 1).otherwise(F.col("track_id"))
    second = p.where("frame % 3 = 0").select(merged.alias("track_id"), "frame", "t", F.lit("b").alias("source"))
    return p.where("frame % 2 = 0").select("track_id", "frame", "t", F.lit("a").alias("source")).unionByName(second)


@query(f"SELECT track_id, frame, {_micros({'x0': 'x0', 'y0': 'y0', 'x1': 'px', 'y1': 'py'})} FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t DESC, frame DESC) AS k FROM (SELECT *, lag(px) OVER w AS x0, lag(py) OVER w AS y0 FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY t, frame)) WHERE (px - x0) * (px - x0) + (py - y0) * (py - y0) > 0.05::double) WHERE k = 1")
def last_strides(spark, d):
    return _rounded(tracks.last_stride(track_points(spark, d)), _AT, ["x0", "y0", "x1", "y1"])


def _ema_sql(alpha: float, where: str = "") -> str:
    each = ", ".join(f"list_transform(range(1, len(f) + 1), lambda i: list_reduce(l{c}[1:i], lambda a, v: {alpha}::double * v + {1 - alpha}::double * a)) AS e{c}" for c in "xy")
    return f"""WITH l AS (SELECT track_id, list(frame ORDER BY t, frame) AS f, list(px ORDER BY t, frame) AS lx, list(py ORDER BY t, frame) AS ly FROM trk {where} GROUP BY track_id),
 e AS (SELECT track_id, f, {each} FROM l), u AS (SELECT track_id, unnest(f) AS frame, unnest(ex) AS x, unnest(ey) AS y FROM e) SELECT track_id, frame, {_near('x')} AS x, {_near('y')} AS y FROM u"""


@query(_ema_sql(0.3))
def foot_ema_rows(spark, d):
    rows = tracks.running_ema(track_points(spark, d), ("px", "py"), 0.3)
    return rows.selectExpr(*_AT, f"{_near('ema_px')} AS x", f"{_near('ema_py')} AS y")


@query(_ema_sql(0.4, "WHERE px BETWEEN 0.1::double AND 0.9::double"))
def court_ema_rows(spark, d):
    """Only points on the court enter and are given back."""
    rows = tracks.running_ema(track_points(spark, d).where(F.col("px").between(0.1, 0.9)), ("px", "py"), 0.4)
    return rows.selectExpr(*_AT, f"{_near('ema_px')} AS x", f"{_near('ema_py')} AS y")


@query(f"""WITH v AS (SELECT track_id, frame, py, conf, px, coalesce((px - lag(px, 2) OVER w) / 2, 0) AS vx, coalesce((py - lag(py, 2) OVER w) / 2, 0) AS vy, coalesce(py < lag(py) OVER w, false) AS up FROM trk WINDOW w AS (PARTITION BY track_id ORDER BY t, frame)),
 s AS (SELECT *, sqrt(vx * vx + vy * vy) AS speed FROM v)
SELECT track_id, frame, {_micro('speed')} AS speed, CAST(floor((0.3::double * least(speed / 0.08::double, 1.0::double) + 0.7::double * (0.3::double * up::integer + 0.3::double * (abs(px - 0.5::double) <= 0.1::double)::integer + 0.2::double * (conf >= 0.2::double)::integer + 0.2::double * (frame % 2 = 0)::integer)) * 1000 + 0.5) AS bigint) AS confidence FROM s""")
def attempt_emission(spark, d):
    """Entry speed over two rows in both axes, and the soft score of an attempt at each row."""
    w = tracks.by_time()
    rows = track_points(spark, d)
    v = {f"v{c}": F.coalesce((F.col(f"p{c}") - F.lag(f"p{c}", 2).over(w)) / 2, F.lit(0.0)) for c in "xy"}
    rows = rows.withColumns(v | {"up": F.coalesce(F.col("py") < F.lag("py").over(w), F.lit(False))})
    rows = rows.withColumn("speed", F.sqrt(F.col("vx") * F.col("vx") + F.col("vy") * F.col("vy")))
    score = fb.attempt_confidence(F.col("speed"), F.col("up"), F.abs(F.col("px") - 0.5) <= 0.1, (F.col("conf") >= 0.2).cast("int"), (F.col("frame") % 2 == 0).cast("int"))
    return rows.select(*_AT, F.expr(_micro("speed")).alias("speed"), F.floor(score * 1000 + 0.5).alias("confidence"))


@query("""WITH v AS (SELECT track_id, frame, t, px, py, conf, conf >= 0.2::double AS ok FROM trk), b AS (SELECT *, max(CASE WHEN ok AND py > 0.5::double THEN py END) OVER (PARTITION BY track_id ORDER BY t, frame ROWS BETWEEN 8 PRECEDING AND 1 PRECEDING) AS deepest FROM v)
SELECT track_id, frame, ok AND py > 0.5::double AND py <= 0.58::double AND deepest >= 0.512::double AND py <= deepest - 0.005::double IS TRUE AS approach, abs(px - 0.5::double) <= 0.05::double * 1.5::double AND py <= 0.5::double + CASE WHEN frame % 2 = 0 THEN 0.08::double ELSE 0.03::double END AS near FROM b WHERE deepest IS NOT NULL""")
def rim_approach(spark, d):
    """Rise from the deepest point in the zone under the rim, and nearness to the hoop with the depth that the signal allows."""
    rows = track_points(spark, d)
    deepest = F.max(F.when((F.col("conf") >= 0.2) & (F.col("py") > 0.5), F.col("py"))).over(tracks.by_time().rowsBetween(-8, -1))
    rows = rows.withColumn("deepest", deepest).where("deepest IS NOT NULL")
    near = lookback.near_hoop(F.col("px"), F.col("py"), 0.5, 0.1, 0.5, F.col("frame") % 2 == 0)
    return rows.select(*_AT, lookback.approaching(F.col("py"), F.col("deepest"), 0.5, F.col("conf") >= 0.2).alias("approach"), near.alias("near"))


# documents ---------------------------------------------------------------------------------------------------------


@query(f"""WITH c AS (SELECT video_id, label, count(*) AS n FROM boxes GROUP BY 1, 2), b AS (SELECT *, {', '.join(f'{_edge(c)} AS c_{c}' for c in _CORNERS)} FROM boxes)
SELECT b.video_id, CAST(row_number() OVER (PARTITION BY b.video_id ORDER BY frame, idx) - 1 AS integer) AS place, frame, idx, b.label, conf, {_micros({'cx': '(c_x1 + c_x2) / 2'})}, n AS class_count FROM b JOIN c ON c.video_id = b.video_id AND c.label = b.label""")
def detections_document(spark, d):
    b = boxes(spark, d)
    made = fb.corner_detection(b.x1, b.y1, b.x2, b.y2, b.label == "N")
    rows = b.select("video_id", "frame", "idx", "label", "conf", *[v.alias(k) for k, v in made.items()])
    item = F.struct("frame", "idx", "label", "conf", *made)
    docs = rows.groupBy("video_id").agg(typed.counts_by(F.col("label")).alias("classCounts"), typed.ordered(["frame", "idx"], item).alias("detections"))
    back = typed.parse(typed.write(docs, "detections"), "detections").select("video_id", "classCounts", F.posexplode("detections").alias("place", "x"))
    return back.select("video_id", "place", "x.frame", "x.idx", "x.label", "x.conf", F.expr(_micro("x.cx")).alias("cx"), F.element_at("classCounts", F.col("x.label")).alias("class_count"))


@query("""SELECT label, CAST(dense_rank() OVER (PARTITION BY label ORDER BY track_id) - 1 AS integer) AS player, track_id, CAST(row_number() OVER (PARTITION BY label, track_id ORDER BY t, frame) - 1 AS integer) AS place, frame, t, conf < 0.1::double AS missing FROM trk""")
def tracks_document(spark, d):
    p = track_points(spark, d).withColumn("missing", F.col("conf") < 0.1)
    own = p.groupBy("label", "track_id").agg(typed.ordered(["t", "frame"], F.struct("frame", "t", "px", "py", "conf", "missing")).alias("points"))
    docs = own.groupBy("label").agg(typed.ordered(["track_id"], F.struct("track_id", "points")).alias("players"))
    back = typed.parse(typed.write(docs, "tracks"), "tracks").select("label", F.posexplode("players").alias("player", "o"))
    back = back.select("label", "player", "o.track_id", F.posexplode("o.points").alias("place", "x"))
    return back.select("label", "player", "track_id", "place", "x.frame", "x.t", "x.missing")


@query(f"""WITH p AS (SELECT *, px BETWEEN 0.1::double AND 0.9::double AS court FROM trk), s AS (SELECT *, sum(court::integer) OVER (PARTITION BY track_id)::double / count(*) OVER (PARTITION BY track_id) AS share, row_number() OVER (PARTITION BY track_id ORDER BY t, frame) - 1 AS place FROM p)
SELECT track_id, CAST(floor(share * 10000 + 0.5) AS bigint) AS share, CAST(place AS integer) AS place, frame, {_micros({'x': 'CASE WHEN court THEN px END'})} FROM s""")
def court_tracks_document(spark, d):
    on = F.col("px").between(0.1, 0.9)
    p = track_points(spark, d).withColumns({"x": F.when(on, F.col("px")), "y": F.when(on, F.col("py"))})
    share = F.sum(on.cast("int")).cast("double") / F.count("*")
    docs = p.groupBy("track_id").agg(F.round(share, 4).alias("onCourtFraction"), typed.ordered(["t", "frame"], F.struct("frame", "t", "x", "y")).alias("points"))
    back = typed.parse(typed.write(docs, "court_tracks"), "court_tracks").select("track_id", "onCourtFraction", F.posexplode("points").alias("place", "p"))
    return back.select("track_id", F.floor(F.col("onCourtFraction") * 10000 + 0.5).alias("share"), "place", "p.frame", F.expr(_micro("p.x")).alias("x"))


@query(f"SELECT track_id, CAST(row_number() OVER (PARTITION BY track_id ORDER BY t, frame) - 1 AS integer) AS place, track_id AS player_id, label, t, {_micros({'x': 'px', 'y': 'py'})}, frame, conf < 0.2::double AS interpolated FROM trk")
def trajectories_document(spark, d):
    p = track_points(spark, d)
    item = F.struct(F.col("track_id").alias("player_id"), "label", "t", F.col("px").alias("x"), F.col("py").alias("y"), "frame", (F.col("conf") < 0.2).alias("interpolated"))
    docs = p.groupBy("track_id").agg(typed.ordered(["t", "frame"], item).alias("trajectory"))
    back = typed.parse(typed.write(docs, "trajectories"), "trajectories").select("track_id", F.posexplode("trajectory").alias("place", "p")).select("track_id", "place", "p.*")
    return _rounded(back, ["track_id", "place", "player_id", "label", "t", "frame", "interpolated"], ["x", "y"])


@query("""SELECT track_id, count(*) OVER o AS n, CAST(floor(sum((conf >= 0.2::double)::integer) OVER o::double / count(*) OVER o * 1000000 + 0.5) AS bigint) AS rate, frame, t, conf, conf < 0.2::double AS predicted FROM trk WINDOW o AS (PARTITION BY track_id)""")
def ball_track_document(spark, d):
    p, seen = track_points(spark, d), F.col("conf") >= 0.2
    item = F.struct("frame", F.col("t").alias("tSec"), F.col("px").alias("x"), F.col("py").alias("y"), F.col("conf").alias("confidence"), (~seen).alias("predicted"))
    docs = p.groupBy("track_id").agg(F.count("*").alias("frameCount"), (F.sum(seen.cast("int")).cast("double") / F.count("*")).alias("detectionRate"), typed.ordered(["t", "frame"], item).alias("frames"))
    back = typed.parse(typed.write(docs, "ball_track"), "ball_track").select("track_id", "frameCount", "detectionRate", F.explode("frames").alias("p"))
    return back.select("track_id", F.col("frameCount").alias("n"), F.expr(_micro("detectionRate")).alias("rate"), "p.frame", F.col("p.tSec").alias("t"), F.col("p.confidence").alias("conf"), "p.predicted")


@query(f"""SELECT track_id, count(*) OVER (PARTITION BY track_id) AS n, frame, t, {_micros({'x': 'px', 'y': 'py'})}, CASE WHEN frame % 10 = 0 THEN 'rim_tube' ELSE 'crossed_down' END AS signal FROM trk WHERE frame % 5 = 0""")
def attempts_document(spark, d):
    p = track_points(spark, d).where("frame % 5 = 0")
    kind = F.when(F.col("frame") % 10 == 0, "rim_tube").otherwise("crossed_down")
    item = F.struct("frame", F.col("t").alias("tSec"), F.col("conf").alias("confidence"), F.lit(0.1).alias("entrySpeed"), F.struct(F.col("px").alias("x"), F.col("py").alias("y")).alias("ballPos"), kind.alias("signalKind"))
    docs = p.groupBy("track_id").agg(F.count("*").alias("attemptCount"), typed.ordered(["t", "frame"], item).alias("attempts"))
    back = typed.parse(typed.write(docs, "attempts"), "attempts").select("track_id", "attemptCount", F.explode("attempts").alias("p"))
    return back.select("track_id", F.col("attemptCount").alias("n"), "p.frame", F.col("p.tSec").alias("t"), F.expr(_micro("p.ballPos.x")).alias("x"), F.expr(_micro("p.ballPos.y")).alias("y"), F.col("p.signalKind").alias("signal"))


@query("""WITH b AS (SELECT *, row_number() OVER (PARTITION BY video_id ORDER BY conf DESC, frame, idx) AS k FROM boxes)
SELECT b.video_id, f.frame AS best_frame, f.idx AS best_idx, b.frame, b.idx, b.conf FROM b JOIN b f ON f.video_id = b.video_id AND f.k = 1""")
def court_detect_document(spark, d):
    b = boxes(spark, d)
    points = F.array(*[F.struct(F.col(x).alias("x"), F.col(y).alias("y")) for x, y in (("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2"))])
    frames = typed.ordered(["frame", "idx"], F.struct("frame", "idx", "conf", points.alias("keypoints")))
    docs = b.groupBy("video_id").agg(F.min_by(F.struct("frame", "idx", "conf"), F.struct((-F.col("conf")).alias("c"), "frame", "idx")).alias("best"), frames.alias("frames"))
    back = typed.parse(typed.write(docs, "court_detect"), "court_detect").select("video_id", "best", F.explode("frames").alias("p"))
    return back.select("video_id", F.col("best.frame").alias("best_frame"), F.col("best.idx").alias("best_idx"), "p.frame", "p.idx", "p.conf")


@query("""WITH r AS (SELECT *, (600 - idx) // 60 || ':' || lpad(CAST((600 - idx) % 60 AS varchar), 2, '0') AS clock FROM reads)
SELECT video_id, idx / 1.0::double AS at, clock, raw, min(idx / 1.0::double) OVER (PARTITION BY video_id, clock) AS first_at FROM r""")
def scoreboard_document(spark, d):
    r = readings(spark, d).withColumns({"at": F.col("idx").cast("double"), "clock": text.format_clock(F.lit(600) - F.col("idx"))})
    first = r.groupBy("video_id", "clock").agg(F.min("at").alias("at")).groupBy("video_id").agg(typed.ordered(["at"], F.struct(F.col("clock").alias("gameClock"), F.col("at").alias("videoTimeSec"))).alias("clockMap"))
    own = typed.ordered(["at"], F.struct("at", "clock", "raw"))  # maps have no order, so they are made afterwards
    item = lambda x: F.struct(x["at"].alias("videoTimeSec"), x["clock"].alias("gameClock"), F.create_map(F.lit("game_clock"), x["raw"]).alias("rawOcr"))
    docs = r.groupBy("video_id").agg(F.transform(own, item).alias("readings")).join(first, "video_id")
    back = typed.parse(typed.write(docs, "scoreboard"), "scoreboard").select("video_id", "clockMap", F.explode("readings").alias("p"))
    when = F.element_at(F.filter("clockMap", lambda m: m["gameClock"] == F.col("p.gameClock")), 1)["videoTimeSec"]
    return back.select("video_id", F.col("p.videoTimeSec").alias("at"), F.col("p.gameClock").alias("clock"), F.element_at("p.rawOcr", F.lit("game_clock")).alias("raw"), when.alias("first_at"))


@query(f"SELECT video_id, frame, idx, printf('0 %.6f %.6f %.6f %.6f', (x1 + x2) / 2, (y1 + y2) / 2, x2 - x1, y2 - y1) AS line FROM boxes")
def label_lines(spark, d):
    """Detections as label lines: class, centre and size with six decimals."""
    b = boxes(spark, d)
    return b.select(*_KEY, F.format_string("0 %.6f %.6f %.6f %.6f", (b.x1 + b.x2) / 2, (b.y1 + b.y2) / 2, b.x2 - b.x1, b.y2 - b.y1).alias("line"))
