"""Queries of whole stages: court fits, hand-made settings, data sets, assembled tracks, crops and summaries."""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import functions as F

from courtline.functions import boxes as fb
from courtline.functions import colour, datasets, geometry, overlay, text
from courtline.operators import matching, tracks
from courtline.plans.catalogue import _FILLED, _X, _Y, H, HOOPS, _filled, _micro, query
from courtline.plans.entities import _LINEAR, _bent, _near
from courtline.plans.observations import _KEY
from courtline.sources import settings
from courtline.sources.views import boxes, read, readings, track_points

_W, _H = 640.0, 360.0


# courts ------------------------------------------------------------------------------------------------------------

_POINTS = (("x1", "y1"), ("x2", "y1 + 0.02::double"), ("x2 - 0.03::double", "y2"), ("x1 + 0.05::double", "y2"))


def _area(points: list[tuple[str, str]]) -> str:
    return "(0 + " + " + ".join(f"({x} * {points[(k + 1) % 4][1]} - {points[(k + 1) % 4][0]} * {y})" for k, (x, y) in enumerate(points)) + ") * 0.5::double"


def _fit_sql(court: overlay.Court) -> str:
    rows = []
    for n, (q, order) in enumerate((q, o) for q in range(len(overlay.paint_quads(court))) for o in permutations(range(4))):
        quad = overlay.paint_quads(court)[q]
        ends = [f"{v!r}::double" for p in overlay.outline(court) for v in overlay.in_paint(court, quad, p)]
        rows.append(f"({n}, {q}, '{','.join(map(str, order))}', {overlay.signed_area(quad)!r}::double, {', '.join(str(i + 1) for i in order)}, {', '.join(ends)})")
    corners, own = [(f"p{k}", f"q{k}") for k in range(4)], [(f"x{k}", f"y{k}") for k in range(4)]
    near = " + ".join(f"coalesce(p{k} > {-0.25 * _W}::double AND p{k} < {1.25 * _W}::double AND q{k} > {-0.25 * _H}::double AND q{k} < {1.25 * _H}::double, false)::integer" for k in range(4))
    return f"""WITH tried(n, paint, keypoints, turn, i0, i1, i2, i3, u0, v0, u1, v1, u2, v2, u3, v3) AS (VALUES {', '.join(rows)}),
 b AS (SELECT video_id, frame, [{', '.join(f'({x}) * {_W}::double' for x, _ in _POINTS)}] AS xs, [{', '.join(f'({y}) * {_H}::double' for _, y in _POINTS)}] AS ys FROM boxes WHERE idx = 1),
 c AS (SELECT *, {', '.join(f'xs[i{k}] AS x{k}, ys[i{k}] AS y{k}' for k in range(4))} FROM b, tried),
 d AS (SELECT *, {', '.join(f'{c}1 - {c}2 AS d{c}1, {c}3 - {c}2 AS d{c}2, {c}0 - {c}1 + {c}2 - {c}3 AS s{c}' for c in 'xy')} FROM c),
 e AS (SELECT *, nullif(dx1 * dy2 - dx2 * dy1, 0) AS det, {_area(own)} AS own FROM d),
 f AS (SELECT *, (sx * dy2 - dx2 * sy) / det AS g, (dx1 * sy - sx * dy1) / det AS h FROM e),
 k AS (SELECT *, x1 - x0 + g * x1 AS a1, x3 - x0 + h * x3 AS b1, y1 - y0 + g * y1 AS a2, y3 - y0 + h * y3 AS b2, {', '.join(f'nullif(g * u{k} + h * v{k} + 1, 0) AS w{k}' for k in range(4))} FROM f),
 l AS (SELECT *, {', '.join(f'(a1 * u{k} + b1 * v{k} + x0) / w{k} AS p{k}, (a2 * u{k} + b2 * v{k} + y0) / w{k} AS q{k}' for k in range(4))} FROM k),
 m AS (SELECT *, {near} AS inside, abs({_area(corners)}) AS whole FROM l),
 s AS (SELECT *, CASE WHEN inside >= 3 AND abs(own) >= 8.0::double AND whole >= abs(own) * 1.15::double
  THEN inside * 10.0::double + least(whole / {_W * _H}::double, 2.0::double) * 5 + whole / abs(own) + CASE WHEN own * turn > 0 THEN 20 ELSE 0 END ELSE -1e9::double END AS score FROM m),
 o AS (SELECT *, CAST(floor(-score * 1000000 + 0.5::double) AS bigint) AS cost FROM s)
SELECT video_id, frame, cost, paint, keypoints FROM (SELECT *, row_number() OVER (PARTITION BY video_id, frame ORDER BY cost, n) AS place FROM o) WHERE place = 1 AND cost <= 0"""


def _fits(spark, d, court):
    point = [(F.expr(f"({x.replace('::double', 'D')}) * {_W}D"), F.expr(f"({y.replace('::double', 'D')}) * {_H}D")) for x, y in _POINTS]
    rows = boxes(spark, d).where("idx = 1").withColumns({"xs": F.array(*[x for x, _ in point]), "ys": F.array(*[y for _, y in point])})
    return overlay.best_fits(rows, ["video_id", "frame"], "xs", "ys", court, _W, _H)


@query(_fit_sql(overlay.FIBA))
def overlay_fit(spark, d):
    """The best paint and keypoint order of each frame, over both paints and all orders."""
    return _fits(spark, d, overlay.FIBA)


_HALF = overlay.Court("half", 15.0, 14.0, 4.9, 5.8)


@query(_fit_sql(_HALF))
def overlay_fit_half(spark, d):
    return _fits(spark, d, _HALF)


@query(f"SELECT track_id, frame, i, {_micro('t')} AS t_us, {_near(_X)} AS x, {_near(_Y)} AS y, interpolated FROM filled".replace("SELECT", f"WITH {_FILLED} SELECT", 1))
def filled_on_court(spark, d):
    """Gaps are filled in the picture and every point is projected anew, as a straight line there is none on a moving camera's court."""
    x, y = geometry.project(F.col("px"), F.col("py"), H)
    rows = _filled(spark, d).withColumns({"x": x, "y": y})
    return rows.selectExpr("track_id", "frame", "i", f"{_micro('t')} AS t_us", f"{_near('x')} AS x", f"{_near('y')} AS y", "interpolated")


# settings ----------------------------------------------------------------------------------------------------------


def _hoop_documents(spark, d):
    b = boxes(spark, d).where("idx = 1 AND frame <= 3")
    hoop = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(0.1).alias("w"), F.lit(0.05).alias("h"))
    by = lambda k: F.max(F.when(F.col("frame") == k, hoop))
    listed = F.transform(F.array_sort(F.collect_list(F.struct("frame", hoop.alias("h")))), lambda s: s["h"])
    corners = F.transform(listed, lambda h: F.struct(h["x"].alias("x"), h["y"].alias("y")))
    kind = F.col("video_id") % 4
    rows = b.groupBy("video_id").agg(listed.alias("all"), by(1).alias("one"), by(2).alias("two"), corners.alias("courtPolygon"))
    parts = [F.when(kind == 0, F.col("all")).alias("courtHoops"), F.when(kind == 1, F.col("one")).alias("leftHoop"), F.when(kind == 1, F.col("two")).alias("rightHoop"), F.when(kind == 2, F.col("one")).alias("hoopRoi"), F.col("courtPolygon")]
    return rows.select("video_id", F.to_json(F.struct(*parts)).alias("document"))


@query("""WITH b AS (SELECT video_id, frame, x1 FROM boxes WHERE idx = 1 AND frame <= 3), n AS (SELECT video_id, count(*) AS corners FROM b GROUP BY 1)
SELECT video_id, CASE video_id % 4 WHEN 3 THEN NULL ELSE array_to_string(list(CAST(x1 * 1000 + 0.5::double AS integer) ORDER BY x1, frame) FILTER (WHERE video_id % 4 = 0 OR (video_id % 4 = 1 AND frame <= 2) OR (video_id % 4 = 2 AND frame = 1)), ',') END AS hoops,
 any_value(CASE WHEN corners >= 3 THEN corners END) AS corners FROM b JOIN n USING (video_id) GROUP BY video_id""".replace("CAST(x1 * 1000 + 0.5::double AS integer)", "CAST(floor(x1 * 1000 + 0.5::double) AS integer)"))
def marked_hoops(spark, d):
    """Hand-marked hoops from JSON: all, else left and right, else the single one; polygons need three corners."""
    rows = settings.parsed(_hoop_documents(spark, d), "hoops").withColumns({"found": settings.marked_hoops(), "polygon": settings.court_polygon()})
    shown = F.array_join(F.transform("found", lambda h: F.floor(h["x"] * 1000 + 0.5).cast("int").cast("string")), ",")
    return rows.select("video_id", F.when(F.size("found") > 0, shown).alias("hoops"), F.when(F.col("polygon").isNotNull(), F.size("polygon")).cast("bigint").alias("corners"))


@query("SELECT video_id, frame, label || idx AS region, x1, y1 FROM boxes WHERE frame = 1")
def scoreboard_regions(spark, d):
    """Regions by name from a scoreboard's JSON."""
    b = boxes(spark, d).where("frame = 1")
    region = F.struct(F.col("x1").alias("x"), F.col("y1").alias("y"), F.lit(0.1).alias("w"), F.lit(0.1).alias("h"))
    docs = b.groupBy("video_id", "frame").agg(F.map_from_entries(F.collect_list(F.struct(F.concat("label", "idx"), region))).alias("regions"))
    rows = settings.parsed(docs.select("video_id", "frame", F.to_json(F.struct("regions")).alias("document")), "regions")
    return rows.select("video_id", "frame", F.explode("regions").alias("region", "v")).select("video_id", "frame", "region", F.col("v.x").alias("x1"), F.col("v.y").alias("y1"))


@query(f"""WITH c AS (SELECT video_id, count(*) AS n, CASE WHEN video_id % 3 = 0 THEN 14.0::double ELSE 28.0::double END AS l, CASE WHEN video_id % 2 = 0 THEN 3.28084::double ELSE 1.0::double END AS k FROM boxes GROUP BY video_id)
SELECT video_id, CASE WHEN video_id % 5 = 0 THEN 'full' WHEN l < 20 THEN 'half' ELSE 'full' END AS layout, {_micro('(l * k)')} AS length, {_micro('(15.0::double * k)')} AS width, n >= 4 AS usable FROM c""")
def calibrated_courts(spark, d):
    """Layout, sizes in feet and usability of calibrations from JSON, with the defaults for what is missing."""
    pair = F.struct(F.struct(F.col("x1").alias("x"), F.col("y1").alias("y")).alias("court"), F.struct(F.col("x2").alias("x"), F.col("y2").alias("y")).alias("pixel"))
    v = F.col("video_id")
    court = F.struct(F.when(v % 3 == 0, 14.0).alias("length"), F.when(v % 2 == 0, "m").otherwise("ft").alias("unit"), F.when(v % 5 == 0, "full").otherwise("auto").alias("layout"))
    docs = boxes(spark, d).groupBy("video_id").agg(F.collect_list(pair).alias("points")).select("video_id", F.to_json(F.struct(court.alias("court"), "points")).alias("document"))
    rows = settings.parsed(docs, "calibration").withColumns(settings.calibrated_court())
    return rows.select("video_id", "layout", F.expr(_micro("length_ft")).alias("length"), F.expr(_micro("width_ft")).alias("width"), "usable")


@query(f"""SELECT track_id, 'own' AS name, min(frame) % 256 AS r, 16 AS g, 255 AS b FROM trk WHERE track_id % 2 = 0 GROUP BY track_id
UNION ALL SELECT track_id, 'own', list_sort(list(frame % 256))[(count(*) + 1) // 2], list_sort(list(frame * 3 % 256))[(count(*) + 1) // 2], list_sort(list(frame * 7 % 256))[(count(*) + 1) // 2] FROM trk WHERE track_id % 2 = 1 GROUP BY track_id""")
def kit_book(spark, d):
    """Kits from JSON: their stated colour, else the median of the samples."""
    f = F.col("frame")
    rows = track_points(spark, d).groupBy("track_id").agg(F.collect_list(F.array(*[(f * k % 256).cast("int") for k in (1, 3, 7)])).alias("samples"), F.min("frame").alias("least"))
    stated = F.when(F.col("track_id") % 2 == 0, F.concat(F.lit("#"), F.lpad(F.lower(F.hex(F.col("least") % 256)), 2, "0"), F.lit("10ff")))
    docs = rows.select("track_id", F.to_json(F.struct(F.array(F.struct(F.lit("own").alias("name"), stated.alias("color"), "samples")).alias("kits"))).alias("document"))
    kits = settings.parsed(docs, "kits").select("track_id", F.explode(settings.kit_colours()).alias("k"))
    return kits.select("track_id", "k.name", *[F.col(f"k.{c}").cast("bigint").alias(c) for c in "rgb"])


# data sets ---------------------------------------------------------------------------------------------------------


@query("""WITH r AS (SELECT label, vec_id, row_number() OVER (PARTITION BY label ORDER BY md5(vec_id || ':7'), vec_id) AS k, count(*) OVER (PARTITION BY label) AS n FROM embeddings)
SELECT vec_id, label, CASE WHEN n >= 2 AND k <= least(greatest(1, CAST(round_even(n * 0.2::double, 0) AS bigint)), n - 1) THEN 'val' ELSE 'train' END AS split FROM r""")
def train_val_split(spark, d):
    """A fifth of each label for validation, at least one and not all, by a seeded hash of the id."""
    return datasets.split(read(spark, d, "embeddings"), ["label"], "vec_id", 0.2, 7).select("vec_id", "label", "split")


@query("""WITH l AS (SELECT video_id, frame, label <> 'R' AND x2 - 0.25::double > 0 AND y2 - 0.25::double > 0 AS ok, label <> 'A' AS written FROM boxes),
 g AS (SELECT video_id, frame, sum(written::integer) AS lines, sum((written AND ok)::integer) AS kept FROM l GROUP BY 1, 2)
SELECT video_id, frame, CASE WHEN lines = 0 THEN 'negative' WHEN kept = 0 THEN 'skip' ELSE 'positive' END AS kind, kept::bigint AS kept FROM g""")
def label_files(spark, d):
    """Label files of frames: empty ones are negatives, those without a valid line are left out, others keep their valid lines."""
    line = F.concat_ws(" ", F.when(F.col("label") == "R", "1").otherwise("0"), "x1", "y1", F.col("x2") - 0.25, F.col("y2") - 0.25)
    files = boxes(spark, d).groupBy("video_id", "frame").agg(F.array_join(F.collect_list(F.when(F.col("label") != "A", line)), "\n").alias("text"))
    return datasets.classified(files, "text").select("video_id", "frame", "kind", F.size("lines").cast("bigint").alias("kept"))


# assembled tracks --------------------------------------------------------------------------------------------------


@query("""SELECT track_id, arg_max(label, (t, frame)) AS label, count(*) AS points, min(frame) FILTER (WHERE conf >= 0.2::double) AS first_seen FROM trk GROUP BY track_id""".replace("arg_max(label, (t, frame))", "last(label ORDER BY t, frame)"))
def assembled_players(spark, d):
    """Players by their number: the label last seen, how many points, and the first that is sure."""
    return tracks.assembled(track_points(spark, d), F.col("conf") >= 0.2)


@query(f"""WITH b AS (SELECT *, last_value(CASE WHEN conf >= 0.2::double THEN px END IGNORE NULLS) OVER w AS ball, last_value(CASE WHEN frame % 3 = 0 THEN py END IGNORE NULLS) OVER w AS seen FROM trk
 WINDOW w AS (PARTITION BY track_id ORDER BY t, frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING))
SELECT track_id, frame, CASE WHEN track_id % 2 = 0 THEN seen WHEN ball IS NULL THEN {HOOPS[0]}::double WHEN abs(ball - {HOOPS[0]}::double) <= abs(ball - {HOOPS[1]}::double) AND abs(ball - {HOOPS[0]}::double) <= abs(ball - {HOOPS[2]}::double) THEN {HOOPS[0]}::double
 WHEN abs(ball - {HOOPS[1]}::double) <= abs(ball - {HOOPS[2]}::double) THEN {HOOPS[1]}::double ELSE {HOOPS[2]}::double END AS anchor FROM b""")
def search_anchors(spark, d):
    """Where a frame's ball is looked for: the marked hoop nearest to the ball before it, else the hoop that was seen last."""
    rows = track_points(spark, d).withColumns({"ball": F.when(F.col("conf") >= 0.2, F.col("px")), "hoop": F.when(F.col("frame") % 3 == 0, F.col("py"))})
    marked = tracks.search_anchor(rows, "ball", "hoop", HOOPS).where("track_id % 2 = 1")
    return marked.unionByName(tracks.search_anchor(rows, "ball", "hoop", []).where("track_id % 2 = 0")).select("track_id", "frame", "anchor")


@query("""WITH s AS (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY t, frame) AS n FROM trk), q AS (SELECT *, py * (0.35::double + conf) AS quality FROM s WHERE (n - 1) % 3 = 0 AND py >= 0.2::double)
SELECT track_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY track_id ORDER BY quality DESC, frame) AS k FROM q) WHERE k <= 4""")
def crop_samples(spark, d):
    """Every third sight of a player that is high enough, the four best of them."""
    rows = tracks.cadence(track_points(spark, d), 3).where("py >= 0.2").withColumn("quality", colour.crop_quality(F.col("py"), F.col("conf") * 255))
    return matching.top_per_group(rows, ["track_id"], [F.desc("quality"), "frame"], 4).select("track_id", "frame")


_EDGES = {"cx1": f"(x1 * {_W}::double + (x2 * {_W}::double - x1 * {_W}::double) * 0.22::double)", "cx2": f"(x2 * {_W}::double - (x2 * {_W}::double - x1 * {_W}::double) * 0.22::double)",
          "cy1": f"(y1 * {_H}::double + (y2 * {_H}::double - y1 * {_H}::double) * 0.18::double)", "cy2": f"(y1 * {_H}::double + (y2 * {_H}::double - y1 * {_H}::double) * 0.48::double)"}


@query(f"""WITH c AS (SELECT video_id, frame, idx, {', '.join(f'greatest(0, least({int(_W if "x" in k else _H)}, CAST(trunc({v}) AS integer))) AS {k}' for k, v in _EDGES.items())} FROM boxes)
SELECT * FROM c WHERE cx2 - cx1 >= 4 AND cy2 - cy1 >= 4""")
def torso_crops(spark, d):
    """Pixel bounds of the upper body inside a player's box; none under four pixels."""
    crop = fb.torso_crop(*[F.col(c) for c in ("x1", "y1", "x2", "y2")], _W, _H)
    return boxes(spark, d).withColumn("c", crop).where("c IS NOT NULL").select(*_KEY, "c.*")


@query("""WITH p AS (SELECT frame, frame % 180 AS h, frame * 37 % 256 AS s, frame * 91 % 256 AS v FROM trk), m AS (SELECT *, h BETWEEN 3 AND 18 AND s BETWEEN 40 AND 180 AND v >= 80 AS skin, v > 245 AND s < 40 AS blown FROM p)
SELECT frame, NOT skin AND NOT blown AND s >= 40 AND v >= 40 AS bright, NOT skin AND NOT blown AND (s >= 40 AND v >= 40 OR s >= 20 AND v >= 15 AND v < 40) AS any_dye FROM m""")
def chromatic_pixels(spark, d):
    """Pixels like dyed cloth: no skin, no blown white, no shadow; dark cloth too if asked for."""
    f = F.col("frame")
    hsv = f % 180, f * 37 % 256, f * 91 % 256
    return track_points(spark, d).select("frame", colour.chromatic(*hsv).alias("bright"), colour.chromatic(*hsv, dark=True).alias("any_dye"))


_KITS = {"home": (200, 30, 40), "away": (30, 60, 190), "third": (235, 235, 230)}


@query(f"""WITH p AS (SELECT frame, (frame * 37) % 256 AS r, (frame * 91) % 256 AS g, (frame * 53) % 256 AS b FROM trk UNION ALL (VALUES {', '.join(f'({-k - 1}, {r}, {g}, {b})' for k, (r, g, b) in enumerate(_KITS.values()))})),
 l AS (SELECT frame, {', '.join(f'{v} AS {k}' for k, v in _LINEAR.items())} FROM p),
 x AS (SELECT frame, {', '.join(f"({' + '.join(f'{w}::double * {c}' for w, c in zip(row, 'rgb', strict=True))}) / {white}::double AS {n}" for n, row, white in zip('xyz', colour._XYZ, colour._WHITE, strict=True))} FROM l),
 f AS (SELECT frame, y, {', '.join(f'{_bent(c)} AS f{c}' for c in 'xyz')} FROM x),
 lab AS (SELECT frame, floor((CASE WHEN y > 0.008856::double THEN 116 * cbrt(y) - 16 ELSE 903.3::double * y END) * 2.55::double + 0.5) AS l, floor(500 * (fx - fy) + 128.5) AS a, floor(200 * (fy - fz) + 128.5) AS b FROM f),
 n AS (SELECT p.frame, k.frame AS kit, sqrt((p.l - k.l) * (p.l - k.l) + (p.a - k.a) * (p.a - k.a) + (p.b - k.b) * (p.b - k.b)) AS far FROM lab p, lab k WHERE p.frame >= 0 AND k.frame < 0),
 o AS (SELECT *, row_number() OVER (PARTITION BY frame ORDER BY far, kit DESC) AS place, lead(far) OVER (PARTITION BY frame ORDER BY far, kit DESC) AS second FROM n)
SELECT frame, CASE WHEN second - far >= 12 THEN {list(_KITS)}[-kit] END AS kit FROM o WHERE place = 1""")
def kit_by_colour(spark, d):
    """The kit whose colour is nearest in 8-bit Lab; none if the second is hardly farther."""
    f = F.col("frame")
    rows = track_points(spark, d).select("frame", *[v.alias(n) for n, v in zip(("l", "a", "b"), colour.lab8(f * 37 % 256, f * 91 % 256, f * 53 % 256), strict=True)])
    return rows.select("frame", colour.nearest_kit([F.col(c) for c in "lab"], _KITS, 12.0).alias("kit"))


# sources and summaries ---------------------------------------------------------------------------------------------


@query("""WITH s AS (SELECT video_id, idx, idx * 5 AS a, CASE WHEN idx % 3 > 0 THEN idx * 7 % 40 END AS b FROM reads)
SELECT video_id, idx, CASE WHEN b > a THEN '*' || a || '-' || b WHEN a > 0 AND b IS NULL THEN '*' || a || '-inf' END AS section, 'bv*[height<=' || (idx * 100) || '][ext=mp4]/b[height<=' || (idx * 100) || '][ext=mp4]/bv*[height<=' || (idx * 100) || ']/b[height<=' || (idx * 100) || ']' AS format FROM s""")
def stream_sections(spark, d):
    """The part of a remote video to ask for, and the picture formats up to a height."""
    start, end = F.col("idx") * 5, F.when(F.col("idx") % 3 > 0, F.col("idx") * 7 % 40)
    return readings(spark, d).select("video_id", "idx", text.stream_section(start, end).alias("section"), text.stream_format(F.col("idx") * 100).alias("format"))


@query("""SELECT video_id, count(*) AS readings, count(DISTINCT raw) AS texts, first(raw ORDER BY idx) AS first_raw, last(raw ORDER BY idx) AS last_raw, sum((length(raw) >= 3)::integer)::bigint AS clocks FROM reads GROUP BY video_id""")
def reading_summary(spark, d):
    """What a run read of each scoreboard: how many, the first and the last."""
    out = readings(spark, d).groupBy("video_id").agg(F.count("*").alias("readings"), F.count_distinct("raw").alias("texts"), F.min_by("raw", "idx").alias("first_raw"), F.max_by("raw", "idx").alias("last_raw"), F.sum((F.length("raw") >= 3).cast("bigint")).alias("clocks"))
    return out
