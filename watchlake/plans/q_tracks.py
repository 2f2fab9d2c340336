"""Queries of track analytics. Frames per second: 25; the line: 810; the trap's lines: 600 and 1300."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.functions import columns as C
from watchlake.operators import tracks as K
from watchlake.params import CrossingParams, SpeedParams, TrapParams
from watchlake.plans.fixtures import cte, view
from watchlake.plans.registry import query

FPS, W, H, TOTAL = 25.0, 1920, 1080, 4_000_000
LOW = CrossingParams(dwell_s=0.08)  # two frames, as the fixture's tracks jump


def det(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_det")


def boxes(spark: SparkSession, d: str) -> DataFrame:
    return K.with_boxes(det(spark, d))


def events(spark: SparkSession, d: str) -> DataFrame:
    return K.motion_events(view(spark, d, "fx_motion"), FPS)


_M = "WITH " + cte("fx_motion") + """,
g AS (SELECT video, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY video ORDER BY frame) > 75 THEN 1 ELSE 0 END AS s FROM (SELECT DISTINCT * FROM fx_motion)),
r AS (SELECT video, frame, sum(s) OVER (PARTITION BY video ORDER BY frame) AS clip_index FROM g),
ev AS (SELECT video, CAST(clip_index AS BIGINT) AS clip_index, min(frame) AS start_frame, max(frame) AS end_frame, (max(frame) - min(frame)) / 25.0 AS duration_s FROM r GROUP BY video, clip_index),
ec AS (SELECT *, CASE WHEN duration_s >= 0.8 THEN 'significant' WHEN duration_s >= 0.2 THEN 'insignificant' ELSE 'noise' END AS class FROM ev),
ew AS (SELECT *, row_number() OVER (PARTITION BY video ORDER BY start_frame) - 1 AS k FROM ec WHERE class = 'significant'),
win AS (SELECT video, k AS clip_index, start_frame, end_frame, CAST(CASE WHEN k = 0 AND start_frame <= 40 THEN 0 ELSE greatest(0, start_frame - CASE WHEN duration_s > 6 THEN 25 ELSE 37 END) END AS BIGINT) AS padded_start,
  CAST(least(4000000, end_frame + CASE WHEN duration_s > 6 THEN 25 ELSE 37 END) AS BIGINT) AS padded_end, CASE WHEN duration_s <= 12 THEN 1 ELSE 2 END AS tracker_stride, CASE WHEN duration_s > 6 THEN 2 ELSE 1 END AS output_stride FROM ew)"""


@query("W01_motion_sessions", f"{_M} SELECT video, clip_index, start_frame, end_frame, CAST(duration_s AS DOUBLE) AS duration_s FROM ev")
def w01(spark: SparkSession, d: str) -> DataFrame:
    return events(spark, d).drop("class")


@query("A24_event_classes", f"{_M} SELECT video, CASE WHEN bool_or(class = 'significant') THEN 'continue' WHEN bool_or(class = 'insignificant') THEN 'no_significant_motion' ELSE 'no_motion' END AS status, count(*) AS events FROM ec GROUP BY video")
def a24(spark: SparkSession, d: str) -> DataFrame:
    e = events(spark, d)
    return K.clip_motion_status(e).join(e.groupBy("video").agg(F.count("*").alias("events")), "video")


@query("P22_event_windows", f"{_M} SELECT * FROM win")
def p22(spark: SparkSession, d: str) -> DataFrame:
    cols = "video clip_index start_frame end_frame padded_start padded_end tracker_stride output_stride".split()
    return K.event_windows(events(spark, d), FPS, TOTAL).select(F.col("clip_index").cast("long").alias("clip_index"), *(c for c in cols if c != "clip_index"))


@query("J06_frames_in_windows", f"{_M} SELECT video, clip_index, count(*) AS frames, sum(frame) AS total FROM (SELECT m.video, w.clip_index, CAST(m.frame AS BIGINT) AS frame FROM (SELECT DISTINCT * FROM fx_motion) m JOIN win w ON m.video = w.video AND m.frame >= w.padded_start AND m.frame < w.padded_end) GROUP BY video, clip_index".replace("sum(frame)", "CAST(sum(frame) AS BIGINT)"))
def j06(spark: SparkSession, d: str) -> DataFrame:
    rows = K.in_windows(view(spark, d, "fx_motion").distinct(), K.event_windows(events(spark, d), FPS, TOTAL))
    return rows.groupBy("video", F.col("clip_index").cast("long").alias("clip_index")).agg(F.count("*").alias("frames"), F.sum("frame").alias("total"))


@query("P21_stride_sampling", f"{_M} SELECT m.video, w.clip_index, m.frame FROM (SELECT DISTINCT * FROM fx_motion) m JOIN win w ON m.video = w.video AND m.frame >= w.padded_start AND m.frame < w.padded_end WHERE (m.frame - w.padded_start) % w.tracker_stride = 0")
def p21(spark: SparkSession, d: str) -> DataFrame:
    rows = K.in_windows(view(spark, d, "fx_motion").distinct(), K.event_windows(events(spark, d), FPS, TOTAL))
    return K.every_nth(rows, F.col("tracker_stride"), F.col("padded_start")).select("video", F.col("clip_index").cast("long").alias("clip_index"), "frame")


@query("P23_output_frames", f"{_M} SELECT m.video, w.clip_index, m.frame FROM (SELECT DISTINCT * FROM fx_motion) m JOIN win w ON m.video = w.video AND m.frame >= w.padded_start AND m.frame < w.padded_end WHERE (m.frame - w.padded_start) % w.output_stride = 0 OR m.frame % 50 = 0")
def p23(spark: SparkSession, d: str) -> DataFrame:
    rows = K.in_windows(view(spark, d, "fx_motion").distinct(), K.event_windows(events(spark, d), FPS, TOTAL))
    marked = view(spark, d, "fx_motion").where("frame % 50 = 0")
    return K.output_frames(rows, marked).select("video", F.col("clip_index").cast("long").alias("clip_index"), "frame")


@query("A32_output_duration", f"{_M} SELECT m.video, w.clip_index, count(*) / 25.0 AS seconds FROM (SELECT DISTINCT * FROM fx_motion) m JOIN win w ON m.video = w.video AND m.frame >= w.padded_start AND m.frame < w.padded_end GROUP BY m.video, w.clip_index")
def a32(spark: SparkSession, d: str) -> DataFrame:
    rows = K.in_windows(view(spark, d, "fx_motion").distinct(), K.event_windows(events(spark, d), FPS, TOTAL))
    return rows.groupBy("video", F.col("clip_index").cast("long").alias("clip_index")).agg((F.count("*") / FPS).alias("seconds"))


_D = "WITH " + cte("fx_det")
_B = _D + ", b AS (SELECT *, cx - 20 AS x1, cy - 60 AS y1, cx + 20 AS x2, cy + 60 AS y2 FROM fx_det)"


@query("P11_class_confidence", f"{_D} SELECT video, frame, track_id FROM fx_det WHERE conf >= 0.5 AND cls IN ('person')")
def p11(spark: SparkSession, d: str) -> DataFrame:
    return K.confident(det(spark, d), 0.5, ["person"]).select("video", "frame", "track_id")


@query("P12_impossible_cars", f"{_B} SELECT video, frame, track_id FROM b WHERE cls <> 'car' OR y2 <= 870")
def p12(spark: SparkSession, d: str) -> DataFrame:
    return K.possible_cars(boxes(spark, d), 870).select("video", "frame", "track_id")


@query("P13_point_in_polygon", f"{_D} SELECT video, frame, (cx >= 100 AND cx <= 900 AND cy >= 790 AND cy <= 830 AND NOT (cx > 400 AND cx < 600 AND cy > 800)) AS inside FROM fx_det")
def p13(spark: SparkSession, d: str) -> DataFrame:
    # a box with a notch cut from above
    points = [(100, 790), (900, 790), (900, 830), (600, 830), (600, 800), (400, 800), (400, 830), (100, 830)]
    polygon = F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in points))
    return det(spark, d).select("video", "frame", C.in_polygon(F.col("cx").cast("int"), F.col("cy").cast("int"), polygon).alias("inside"))


_POLY = "WITH p AS (SELECT o_orderkey AS id, CAST(o_custkey % 3000 AS INTEGER) AS w, CAST(o_custkey % 1500 + 200 AS INTEGER) AS h FROM orders)"


def _polygons(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    w, h = (F.col("o_custkey") % 3000).cast("int"), (F.col("o_custkey") % 1500 + 200).cast("int")
    corner = lambda x, y: F.array(x, y)
    return o.select(F.col("o_orderkey").alias("id"), F.array(corner(F.lit(10), F.lit(20)), corner(w, F.lit(20)), corner(w, h), corner(F.lit(10), h)).alias("roi"))


_FITS = "CASE WHEN greatest(w, 10) <= {W} AND greatest(h, 20) <= {H} THEN {v} WHEN greatest(w, 10) // 2 <= {W} AND greatest(h, 20) // 2 <= {H} THEN {v} // 2 ELSE {rest} END"


def _fit(v: str, size: tuple[int, int], rest: str) -> str:
    return f"CAST({_FITS.format(W=size[0], H=size[1], v=v, rest=rest)} AS INTEGER)"


@query("P14_roi_rescale", _POLY + f" SELECT id, {_fit('w', (W, H), 'least(w // 2, 1919)')} AS x, {_fit('h', (W, H), 'least(h // 2, 1079)')} AS y FROM p")
def p14(spark: SparkSession, d: str) -> DataFrame:
    r = _polygons(spark, d).select("id", C.rescale(F.col("roi"), F.lit(W), F.lit(H)).alias("r"))
    return r.select("id", F.col("r")[2][0].alias("x"), F.col("r")[2][1].alias("y"))


_HIGH = "greatest(w, 10) > 2500 OR greatest(h, 20) > 1400"
_SCALED = "least(CAST(trunc(CAST({v} AS FLOAT) * CAST({size}.0 / CASE WHEN " + _HIGH + " THEN {full} ELSE {half} END AS FLOAT)) AS INTEGER), {size} - 1)"


@query("P14_roi_rescale_small", _POLY + f" SELECT id, {_fit('w', (640, 360), _SCALED.format(v='w', size=640, full=3840, half=1920))} AS x, {_fit('h', (640, 360), _SCALED.format(v='h', size=360, full=2160, half=1080))} AS y FROM p")
def p14s(spark: SparkSession, d: str) -> DataFrame:
    r = _polygons(spark, d).select("id", C.rescale_small(F.col("roi"), F.lit(640), F.lit(360)).alias("r"))
    return r.select("id", F.col("r")[2][0].alias("x"), F.col("r")[2][1].alias("y"))


@query("P15_roi_bounds", _POLY + " SELECT id, CAST(greatest(0, least(10, w) - 15) AS INTEGER) AS x1, CAST(greatest(0, least(20, h) - 15) AS INTEGER) AS y1, CAST(least(1920, greatest(10, w) + 15) AS INTEGER) AS x2, CAST(least(1080, greatest(20, h) + 15) AS INTEGER) AS y2 FROM p")
def p15(spark: SparkSession, d: str) -> DataFrame:
    return _polygons(spark, d).select("id", C.bounds(F.col("roi"), F.lit(15), F.lit(W), F.lit(H)).alias("b")).select("id", "b.*")


_SIZES = [(3840, 2160), (1920, 1080), (640, 360), (896, 512), (640, 480), (3800, 2099)]


@query("P16_clip_profile", """WITH c AS (SELECT o_orderkey AS id, o_custkey % 6 AS k, o_orderkey % 2 = 0 AS fast, [3840, 1920, 640, 896, 640, 3800][o_custkey % 6 + 1] AS w, [2160, 1080, 360, 512, 480, 2099][o_custkey % 6 + 1] AS h FROM orders)
SELECT id, CASE WHEN k = 0 THEN '4k' WHEN k IN (1, 5) THEN '1080p' WHEN k IN (2, 3) THEN 'low' ELSE 'unsupported' END AS profile, CASE WHEN k = 4 THEN 'no_motion' END AS status,
 CAST(CASE WHEN k = 0 THEN 1600 WHEN k <> 4 THEN 810 END AS DOUBLE) AS line_y, CAST(CASE WHEN k = 0 THEN 12 WHEN k <> 4 THEN 6 END AS DOUBLE) AS tolerance,
 CAST(CASE WHEN k = 0 THEN 7200 WHEN k IN (1, 5) THEN 1800 WHEN k IN (2, 3) THEN greatest(60, trunc(7200 * (w * h / (3840.0 * 2160.0)) * 0.5)) END AS DOUBLE) AS least_area,
 CAST(CASE WHEN k = 0 THEN 60 WHEN k IN (1, 5) THEN 30 WHEN k IN (2, 3) THEN greatest(6, trunc(60 * (w / 3840.0))) END AS DOUBLE) AS padding,
 CAST(CASE WHEN k = 0 THEN 20 WHEN k <> 4 THEN 10 END AS DOUBLE) AS roi_padding, CAST(CASE WHEN k = 0 THEN 40 WHEN k <> 4 THEN 20 END AS DOUBLE) AS reid_tolerance,
 CAST(CASE WHEN k = 0 THEN 20 WHEN k <> 4 THEN 12 END AS DOUBLE) AS reid_padding, CASE WHEN k = 0 THEN '2300,900' WHEN k <> 4 THEN '1150,450' END AS hotspot,
 CAST(CASE WHEN fast THEN 3 WHEN k = 0 THEN 2 ELSE 1 END AS INTEGER) AS stride FROM c""")
def p16(spark: SparkSession, d: str) -> DataFrame:
    from watchlake.sources.configs import clip_profile

    o = spark.read.parquet(f"{d}/orders.parquet")
    pick = lambda k: F.element_at(F.array(*(F.lit(x[k]) for x in _SIZES)), (F.col("o_custkey") % 6 + 1).cast("int"))
    rows = o.select(F.col("o_orderkey").alias("id"), pick(0).alias("width"), pick(1).alias("height"), (F.col("o_orderkey") % 2 == 0).alias("fast"))
    numbers = (F.col(c).cast("double").alias(c) for c in ("line_y", "tolerance", "least_area", "padding", "roi_padding", "reid_tolerance", "reid_padding"))
    return clip_profile(rows).select("id", "profile", "status", *numbers, F.concat_ws(",", "hotspot.x", "hotspot.y").alias("spot"), "stride").select("*", F.nullif("spot", F.lit("")).alias("hotspot")).drop("spot")


_CONTOURS = "SELECT l_orderkey AS video, CAST(l_quantity AS DOUBLE) * 100 AS area, CAST(l_quantity AS DOUBLE) * 100 * (1 + 5 * CAST(l_discount AS DOUBLE)) AS hull_area FROM "


@query("P17_contour_areas", f"WITH c AS ({_CONTOURS} lineitem) SELECT video, count(*) AS contours FROM c WHERE area > 2500 * 0.25 GROUP BY video")
def p17(spark: SparkSession, d: str) -> DataFrame:
    return K.moving_contours(_contours(spark, d), 2500, 0.5).groupBy("video").agg(F.count("*").alias("contours"))


def _contours(spark: SparkSession, d: str) -> DataFrame:
    return spark.sql(_CONTOURS + "{lineitem}", lineitem=spark.read.parquet(f"{d}/lineitem.parquet"))


@query("P17_solid_contours", f"WITH c AS ({_CONTOURS} lineitem) SELECT video, count(*) AS contours FROM c WHERE area >= 2000 AND area / hull_area >= 0.8 GROUP BY video")
def p17s(spark: SparkSession, d: str) -> DataFrame:
    return K.solid_contours(_contours(spark, d)).groupBy("video").agg(F.count("*").alias("contours"))


@query("P18_box_geometry", f"""{_B}, n AS (SELECT *, lead(x1) OVER w AS a1, lead(y1) OVER w AS b1, lead(x2) OVER w AS a2, lead(y2) OVER w AS b2 FROM b WINDOW w AS (PARTITION BY video ORDER BY frame)),
i AS (SELECT *, greatest(0, least(x2, a2) - greatest(x1, a1)) * greatest(0, least(y2, b2) - greatest(y1, b1)) AS o FROM n WHERE a1 IS NOT NULL)
SELECT video, frame, round(o / (40 * 120 * 2 - o), 6) AS iou, round(sqrt((x1 - a1) * (x1 - a1) + (y1 - b1) * (y1 - b1)), 6) AS distance, round(sqrt(1600.0 + 14400.0), 6) AS diagonal FROM i""")
def p18(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("video").orderBy("frame")
    a = [F.col(c) for c in ("x1", "y1", "x2", "y2")]
    rows = boxes(spark, d).withColumns({f"n_{c}": F.lead(c).over(w) for c in ("x1", "y1", "x2", "y2")}).where("n_x1 IS NOT NULL")
    b = [F.col(f"n_{c}") for c in ("x1", "y1", "x2", "y2")]
    r = lambda c, n: F.round(c, 6).alias(n)
    return rows.select("video", "frame", r(C.iou(a, b), "iou"), r(C.center_distance(a, b), "distance"), r(C.diagonal(a), "diagonal"))


@query("P19_hotspot", f"{_B} SELECT video, frame FROM b WHERE cls = 'car' AND 500 BETWEEN x1 AND x2 AND 800 BETWEEN y1 AND y2")
def p19(spark: SparkSession, d: str) -> DataFrame:
    return K.cars_over(boxes(spark, d), 500, 800).select("video", "frame")


@query("P20_crop_rectangle", f"{_B}, c AS (SELECT video, frame, CAST(greatest(0, x1 - 30) AS INTEGER) AS x1, CAST(greatest(0, y1 - 30) AS INTEGER) AS y1, CAST(least(1920, x2 + 30) AS INTEGER) AS x2, CAST(least(880, y2 + 30) AS INTEGER) AS y2 FROM b WHERE y2 <= 890) SELECT * FROM c WHERE x2 > x1 AND y2 > y1")
def p20(spark: SparkSession, d: str) -> DataFrame:
    return K.crop_rectangles(boxes(spark, d), 30, W, 880, lowest=890).select("video", "frame", "x1", "y1", "x2", "y2")


@query("S10_detection_lists", "WITH " + cte("fx_det3") + " SELECT video, frame, track_id, cls, conf, cx - 20 + 100 AS x1, cy + 60 + 50 AS y2 FROM fx_det3")
def s10(spark: SparkSession, d: str) -> DataFrame:
    rows = K.with_boxes(view(spark, d, "fx_det3"))
    item = F.struct(F.array("x1", "y1", "x2", "y2").alias("b"), "track_id", "cls", "conf")
    lists = rows.groupBy("video", "frame").agg(F.collect_list(item).alias("r"))
    lists = lists.select("video", "frame", F.col("r.b").alias("boxes"), F.col("r.track_id").alias("ids"), F.col("r.cls").alias("classes"), F.col("r.conf").alias("confs"))
    return K.from_lists(lists, 100.0, 50.0).select("video", "frame", "track_id", "cls", "conf", "x1", "y2")


@query("T05_confidence_rank", "WITH " + cte("fx_det3") + " SELECT video, frame, track_id, cx, row_number() OVER (PARTITION BY video, frame ORDER BY conf DESC, track_id, cx) AS rank FROM fx_det3")
def t05(spark: SparkSession, d: str) -> DataFrame:
    return K.ranked(view(spark, d, "fx_det3")).select("video", "frame", "track_id", "cx", F.col("rank").cast("long").alias("rank"))


@query("W02_plain_crossing", f"""{_D}, l AS (SELECT *, lag(cy) OVER (PARTITION BY video, track_id ORDER BY frame) AS p FROM fx_det)
SELECT video, track_id, frame, CASE WHEN p < 810 AND cy >= 810 THEN 'down' ELSE 'up' END AS direction FROM l WHERE (p < 810 AND cy >= 810) OR (p > 810 AND cy <= 810)""")
def w02(spark: SparkSession, d: str) -> DataFrame:
    return K.plain_crossings(det(spark, d), 810)


@query("W03_band_crossing", f"""{_D}, l AS (SELECT *, lag(cy) OVER (PARTITION BY video, track_id ORDER BY frame) AS p FROM fx_det)
SELECT video, track_id, frame, CASE WHEN p <= 804 THEN 'down' ELSE 'up' END AS direction FROM l WHERE (p <= 804 AND cy >= 816) OR (p >= 816 AND cy <= 804)""")
def w03(spark: SparkSession, d: str) -> DataFrame:
    return K.band_crossings(det(spark, d))


_SIDE = _D + """, s0 AS (SELECT *, abs(cy - 810) <= 6 AS band, (cy <= 804 OR cy >= 816) AND lag(cy) OVER (PARTITION BY video, track_id ORDER BY frame) IS NOT NULL AS out FROM fx_det),
s1 AS (SELECT *, count(*) FILTER (WHERE NOT out) OVER (PARTITION BY video, track_id ORDER BY frame) AS run FROM s0),
s2 AS (SELECT *, CASE WHEN out THEN count(*) FILTER (WHERE out) OVER (PARTITION BY video, track_id, run ORDER BY frame) ELSE 0 END AS streak FROM s1),
s3 AS (SELECT *, CASE WHEN streak >= 2 THEN CASE WHEN cy <= 804 THEN 'above' ELSE 'below' END END AS qualified FROM s2),
s4 AS (SELECT *, last_value(qualified IGNORE NULLS) OVER (PARTITION BY video, track_id ORDER BY frame) AS side FROM s3)"""


@query("W04_stable_side", _SIDE + " SELECT video, track_id, frame, band, streak, side FROM s4")
def w04(spark: SparkSession, d: str) -> DataFrame:
    return K.stable_sides(det(spark, d)).select("video", "track_id", "frame", "band", F.col("streak").cast("long").alias("streak"), "side")


@query("W05_dwell_confirmation", _SIDE + """, q1 AS (SELECT *, CASE WHEN qualified = lag(qualified) OVER (PARTITION BY video, track_id ORDER BY frame) THEN 0 ELSE 1 END AS nw FROM s4 WHERE qualified IS NOT NULL),
q2 AS (SELECT *, sum(nw) OVER (PARTITION BY video, track_id ORDER BY frame) AS isl FROM q1),
q3 AS (SELECT video, track_id, isl, qualified, min(frame) AS frame, max(frame) AS until FROM q2 GROUP BY ALL),
q4 AS (SELECT *, isl = max(isl) OVER (PARTITION BY video, track_id) AS lst FROM q3),
fin AS (SELECT video, track_id, arg_max(CASE WHEN cy < 810 THEN 'above' ELSE 'below' END, frame) AS final FROM fx_det GROUP BY ALL)
SELECT video, track_id, frame, CASE qualified WHEN 'below' THEN 'down' ELSE 'up' END AS direction FROM q4 JOIN fin USING (video, track_id) WHERE isl > 1 AND (until - frame >= 2 OR (lst AND final = qualified))""")
def w05(spark: SparkSession, d: str) -> DataFrame:
    return K.confirmed_crossings(det(spark, d), FPS, LOW)


@query("W06_highlight_window", f"""{_D}, h0 AS (SELECT *, abs(cy - 810) <= 6 AS band, row_number() OVER (PARTITION BY video, track_id ORDER BY frame) AS nth FROM fx_det),
h AS (SELECT *, nth > 2 AND lag(band) OVER (PARTITION BY video, track_id ORDER BY frame) AS was FROM h0),
h2 AS (SELECT *, max(frame + 5) FILTER (WHERE band AND NOT was AND nth > 1) OVER (PARTITION BY video, track_id ORDER BY frame) AS until FROM h)
SELECT video, track_id, frame FROM h2 WHERE band OR frame <= until""")
def w06(spark: SparkSession, d: str) -> DataFrame:
    return K.highlights(det(spark, d))


# detections of a video's tracks that change hands: the tracker id goes on in another entity after each 40 frames
_TEAM = _D + ", e AS (SELECT *, track_id * 1000 + frame // 40 AS entity_id FROM fx_det)"


def _team(spark: SparkSession, d: str) -> DataFrame:
    return det(spark, d).withColumn("entity_id", F.col("track_id") * 1000 + F.floor(F.col("frame") / 40))


@query("W05_reacquired", _TEAM + """, a AS (SELECT *, row_number() OVER w AS nth, lag(cy) OVER w AS p, CASE WHEN cy < 810 THEN 'above' ELSE 'below' END AS side FROM e WINDOW w AS (PARTITION BY video, entity_id ORDER BY frame)),
b AS (SELECT *, CASE WHEN (p < 810 AND cy >= 810) OR (p > 810 AND cy <= 810) THEN NULL ELSE side END AS kept FROM a),
c AS (SELECT *, last_value(kept IGNORE NULLS) OVER (PARTITION BY video, track_id ORDER BY frame ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS known FROM b)
SELECT video, entity_id, frame, known AS start_side, CASE side WHEN 'below' THEN 'down' ELSE 'up' END AS direction FROM c WHERE nth = 1 AND known <> side""")
def w05r(spark: SparkSession, d: str) -> DataFrame:
    return K.reacquired(_team(spark, d), 810)


@query("W07_track_trust", f"""{_D}, t1 AS (SELECT *, row_number() OVER w AS n, sqrt((cx - first_value(cx) OVER w) ** 2 + (cy - first_value(cy) OVER w) ** 2) AS drift, avg(conf) OVER w AS mean FROM fx_det WINDOW w AS (PARTITION BY video, track_id ORDER BY frame)),
t2 AS (SELECT *, max(drift) OVER (PARTITION BY video, track_id ORDER BY frame) AS far FROM t1)
SELECT video, track_id, frame, CASE WHEN bool_or(n >= 20 AND far <= 900 AND mean < 0.8) OVER w THEN 'suppressed' WHEN bool_or(far > 900 OR (n >= 20 AND mean >= 0.8)) OVER w THEN 'trusted' ELSE 'probation' END AS state FROM t2 WINDOW w AS (PARTITION BY video, track_id ORDER BY frame)""")
def w07(spark: SparkSession, d: str) -> DataFrame:
    from watchlake.params import TrustParams

    return K.trust(det(spark, d), TrustParams(drift_px=900.0))


_NET = _D + """, cr AS (SELECT video, track_id, frame, cy, lag(cy) OVER (PARTITION BY video, track_id ORDER BY frame) AS p FROM fx_det),
cd AS (SELECT video, track_id, bool_or(p < 810 AND cy >= 810) AS downs, bool_or(p > 810 AND cy <= 810) AS ups FROM cr GROUP BY ALL),
en AS (SELECT video, track_id, arg_min(cy, frame) < 810 AS a, arg_max(cy, frame) < 810 AS z FROM fx_det GROUP BY ALL),
net AS (SELECT video, track_id, CASE WHEN (NOT a AND z) OR (a = z AND ups AND downs) THEN 1 ELSE 0 END AS up, CASE WHEN (a AND NOT z) OR (a = z AND ups AND downs) THEN 1 ELSE 0 END AS down FROM en JOIN cd USING (video, track_id))"""


def _net(spark: SparkSession, d: str) -> DataFrame:
    rows = det(spark, d)
    return K.net_directions(rows, K.plain_crossings(rows, 810), 810)


query("A27_net_direction", _NET + " SELECT video, track_id, up, down FROM net")(_net)


@query("A28_clip_status", _NET + """, pf AS (SELECT video, count(DISTINCT frame) FILTER (WHERE cls = 'person') AS frames FROM fx_det GROUP BY video), mv AS (SELECT video, CAST(sum(up) AS BIGINT) AS u, CAST(sum(down) AS BIGINT) AS d FROM net GROUP BY video)
SELECT video, u AS persons_up, d AS persons_down, CASE WHEN frames < 40 THEN 'no_person' WHEN u + d > 0 THEN 'gate_crossing' ELSE 'significant_motion' END AS status,
 CASE WHEN frames >= 40 THEN CASE WHEN u > 0 AND d > 0 THEN 'both' WHEN u > 0 THEN 'up' WHEN d > 0 THEN 'down' END END AS direction FROM pf JOIN mv USING (video)""")
def a28(spark: SparkSession, d: str) -> DataFrame:
    frames = det(spark, d).groupBy("video").agg(F.count_distinct(F.when(F.col("cls") == "person", F.col("frame"))).alias("frames"))
    return K.clip_result(_net(spark, d), frames, CrossingParams(person_frames=40))


_EVENTS = _D + """, ev AS (SELECT *, frame // 30 AS clip_index FROM fx_det), kept AS (SELECT video, clip_index, count(DISTINCT frame) AS frames FROM ev WHERE cls = 'person' AND cx BETWEEN 200 AND 1500 AND cy BETWEEN 780 AND 830 GROUP BY ALL HAVING count(DISTINCT frame) >= 10),
bad AS (SELECT video, clip_index, track_id FROM ev GROUP BY ALL HAVING avg(conf) < 0.64)"""
_ROI = [(200, 780), (1500, 780), (1500, 830), (200, 830)]


def _events(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = det(spark, d).withColumn("clip_index", F.floor(F.col("frame") / 30))
    kept = K.person_frames(rows, F.array(*(F.array(F.lit(x), F.lit(y)) for x, y in _ROI)))
    return rows, kept, K.low_confidence(rows, 0.64)


@query("A25_unique_objects", _EVENTS + """, p AS (SELECT video, track_id, cls FROM ev SEMI JOIN kept USING (video, clip_index) WHERE cls = 'car' UNION ALL
 SELECT video, track_id, cls FROM ev SEMI JOIN kept USING (video, clip_index) ANTI JOIN bad USING (video, clip_index, track_id) WHERE cls = 'person')
SELECT video, count(DISTINCT track_id) FILTER (WHERE cls = 'person') AS persons, count(DISTINCT track_id) FILTER (WHERE cls = 'car') AS cars FROM p GROUP BY video""")
def a25(spark: SparkSession, d: str) -> DataFrame:
    return K.unique_objects(*_events(spark, d))


@query("A26_person_frames", f"{_EVENTS} SELECT video, clip_index, frames FROM kept")
def a26(spark: SparkSession, d: str) -> DataFrame:
    return _events(spark, d)[1]


@query("X04_suppressed_tracks", f"{_EVENTS} SELECT DISTINCT video, clip_index, track_id FROM ev ANTI JOIN bad USING (video, clip_index, track_id) WHERE cls = 'person'")
def x04(spark: SparkSession, d: str) -> DataFrame:
    rows, _, bad = _events(spark, d)
    return K.without_suppressed(rows.where("cls = 'person'").select("video", "clip_index", "track_id").distinct(), bad)


@query("A31_tracking_table", f"""{_D}, l AS (SELECT *, lag(cy) OVER (PARTITION BY video, track_id ORDER BY frame) AS p FROM fx_det), c AS (SELECT video, count(DISTINCT track_id) FILTER (WHERE cls = 'person') AS persons, count(DISTINCT track_id) FILTER (WHERE cls = 'car') AS cars,
 count(*) FILTER (WHERE cls = 'person' AND p > 810 AND cy <= 810) AS ups, count(*) FILTER (WHERE cls = 'person' AND p < 810 AND cy >= 810) AS downs, max(frame) AS total FROM l GROUP BY video)
SELECT video, persons, cars, ups, downs, round(CASE WHEN video % 7 > 0 THEN total / (video % 7 / 4.0) ELSE 0 END, 6) AS fps FROM c""")
def a31(spark: SparkSession, d: str) -> DataFrame:
    rows = det(spark, d)
    timings = rows.groupBy("video").agg(F.max("frame").alias("total_frames")).withColumn("seconds", F.col("video") % 7 / 4.0)
    return K.tracking_table(rows, timings, 810).withColumn("fps", F.round("fps", 6))


def in_events(spark: SparkSession, d: str) -> DataFrame:
    """Detections in events of twenty frames."""
    return det(spark, d).withColumn("clip_index", F.floor(F.col("frame") / 20))


_DE = _D + ", de AS (SELECT *, frame // 20 AS clip_index FROM fx_det)"
_SP = _DE + """, v1 AS (SELECT *, cx - lag(cx) OVER w AS dx, cy - lag(cy) OVER w AS dy, frame - lag(frame) OVER w AS df FROM de WINDOW w AS (PARTITION BY video, clip_index, track_id ORDER BY frame)),
v2 AS (SELECT video, clip_index, track_id, frame, sqrt(dx * dx + 0.35 * dy * 0.35 * dy) AS px, df, 0.0051 * least(2.2, greatest(0.55, 1 + 1.1 * (0.6 - cy / 1079))) * (1 + 1.1 * pow(abs(cx / 1919 - 0.5) / 0.5, 2)) AS mpp FROM v1 WHERE df > 0 AND df <= 25),
v3 AS (SELECT video, clip_index, track_id, frame, CASE WHEN px < 2.5 THEN 0 ELSE least(100, px / (df / 25.0) * mpp * 3.6) END AS raw FROM v2),
v4 AS (SELECT *, CAST(CAST(quantile_cont(CAST(CAST(raw AS FLOAT) AS DOUBLE), 0.5) OVER (PARTITION BY video, clip_index, track_id ORDER BY frame ROWS 5 PRECEDING) AS FLOAT) AS DOUBLE) AS median FROM v3)"""
_EMA = """, o AS (SELECT *, row_number() OVER (PARTITION BY video, clip_index, track_id ORDER BY frame) AS i FROM v4),
e AS (SELECT video, clip_index, track_id, frame, i, median AS speed FROM o WHERE i = 1 UNION ALL SELECT o.video, o.clip_index, o.track_id, o.frame, o.i, 0.25 * o.median + 0.75 * e.speed FROM e JOIN o ON o.video = e.video AND o.clip_index = e.clip_index AND o.track_id = e.track_id AND o.i = e.i + 1)"""


@query("W08_raw_speed", _SP + " SELECT video, clip_index, track_id, frame, round(raw, 5) AS raw FROM v3")
def w08(spark: SparkSession, d: str) -> DataFrame:
    return K.raw_speeds(in_events(spark, d), FPS, W, H).withColumn("raw", F.round("raw", 5))


@query("W09_rolling_median", _SP + " SELECT video, clip_index, track_id, frame, round(median, 4) AS median FROM v4")
def w09(spark: SparkSession, d: str) -> DataFrame:
    return K.rolling_median(K.raw_speeds(in_events(spark, d), FPS, W, H)).select("video", "clip_index", "track_id", "frame", F.round("median", 4).alias("median"))


@query("W10_smoothed_speed", _SP.replace("WITH ", "WITH RECURSIVE ", 1) + _EMA + " SELECT video, clip_index, track_id, frame, round(speed, 4) AS speed FROM e")
def w10(spark: SparkSession, d: str) -> DataFrame:
    return K.smoothed(K.rolling_median(K.raw_speeds(in_events(spark, d), FPS, W, H))).withColumn("speed", F.round("speed", 4))


@query("W11_trail", _SP.replace("WITH ", "WITH RECURSIVE ", 1) + _EMA + """,
t AS (SELECT video, clip_index, track_id, frame, count(*) OVER w AS points, CAST(first_value(cx) OVER w AS INTEGER) AS from_x, CAST(sum(cy) OVER w AS BIGINT) AS sum_y FROM de WINDOW w AS (PARTITION BY video, clip_index, track_id ORDER BY frame ROWS 17 PRECEDING)),
k AS (SELECT t.*, last_value(e.speed IGNORE NULLS) OVER (PARTITION BY t.video, t.clip_index, t.track_id ORDER BY t.frame) AS speed FROM t LEFT JOIN e ON t.video = e.video AND t.clip_index = e.clip_index AND t.track_id = e.track_id AND t.frame = e.frame)
SELECT video, clip_index, track_id, frame, points, from_x, sum_y, coalesce(speed >= 5, false) AS shown FROM k""")
def w11(spark: SparkSession, d: str) -> DataFrame:
    rows = in_events(spark, d)
    t = K.labelled_trails(K.trails(rows), K.smoothed(K.rolling_median(K.raw_speeds(rows, FPS, W, H))))
    total = F.aggregate("trail", F.lit(0).cast("long"), lambda s, x: s + x["y"])
    return t.select("video", "clip_index", "track_id", "frame", F.size("trail").cast("long").alias("points"), F.col("trail")[0]["x"].alias("from_x"), total.alias("sum_y"), "shown")


@query("W12_speed_trap", f"""{_DE}, x AS (SELECT *, lag(cx) OVER (PARTITION BY video, clip_index, track_id ORDER BY frame) AS px FROM de),
hit AS (SELECT video, clip_index, track_id, frame, l.line, CASE WHEN cx > px THEN l.v ELSE -l.v END AS o FROM x, (VALUES (1, 600.0), (2, 1300.0)) l(line, v) WHERE px <> cx AND (px - l.v) * (cx - l.v) <= 0),
s AS (SELECT *, lag(line) OVER w AS f, frame - lag(frame) OVER w AS df FROM hit WINDOW w AS (PARTITION BY video, clip_index, track_id ORDER BY frame, o))
SELECT video, clip_index, track_id, frame, round(5.0 / (df / 25.0) * 3.6, 6) AS kmh, CASE f WHEN 1 THEN '->' ELSE '<-' END AS direction FROM s WHERE f <> line AND df > 0 AND 5.0 / (df / 25.0) * 3.6 <= 100""")
def w12(spark: SparkSession, d: str) -> DataFrame:
    return K.speed_trap(in_events(spark, d), FPS, TrapParams(x1=600.0, x2=1300.0)).withColumn("kmh", F.round("kmh", 6))


_LOCAL = """, lf AS (SELECT DISTINCT ON (video, track_id) video, track_id, cls, frame, conf FROM fx_det ORDER BY video, track_id, frame, conf DESC, cls),
lo AS (SELECT video, track_id, cls, row_number() OVER (PARTITION BY video, cls ORDER BY frame, conf DESC, track_id) AS local_id FROM lf)"""


@query("W13_local_ids", f"{_D}{_LOCAL} SELECT video, track_id, cls, local_id FROM lo")
def w13(spark: SparkSession, d: str) -> DataFrame:
    return K.local_ids(det(spark, d)).withColumn("local_id", F.col("local_id").cast("long"))


# tracks stand for another entity every seven frames; of the events of twenty frames every third is kept, but none in some videos
_SHOWN = _D + _LOCAL + """, p AS (SELECT f.video, f.frame // 20 AS clip_index, f.frame, f.conf, f.track_id, (f.track_id + f.frame // 7) % 3 AS entity_id, lo.local_id FROM fx_det f JOIN lo USING (video, track_id) WHERE f.cls = 'person'),
e0 AS (SELECT video, min(clip_index) AS e0 FROM p WHERE video % 5 > 0 AND (clip_index + video) % 3 = 0 GROUP BY video),
q AS (SELECT p.*, e0 FROM p LEFT JOIN e0 USING (video)),
early AS (SELECT *, min((frame, -conf, local_id, entity_id)) OVER (PARTITION BY video, clip_index, entity_id) AS a FROM q WHERE e0 IS NULL OR clip_index <= e0),
num AS (SELECT *, dense_rank() OVER (PARTITION BY video, clip_index ORDER BY a) AS display_id FROM early),
seed AS (SELECT video, local_id, arg_min(display_id, (frame, -conf, local_id, entity_id)) AS display_id FROM num WHERE clip_index = e0 GROUP BY video, local_id),
mx AS (SELECT video, max(display_id) AS m FROM seed GROUP BY video),
nw AS (SELECT video, local_id, min((clip_index, frame, -conf, local_id)) AS a FROM q WHERE clip_index > e0 AND (video, local_id) NOT IN (SELECT (video, local_id) FROM seed) GROUP BY video, local_id),
ids AS (SELECT video, local_id, display_id FROM seed UNION ALL SELECT nw.video, local_id, coalesce(m, 0) + row_number() OVER (PARTITION BY nw.video ORDER BY a) FROM nw LEFT JOIN mx ON mx.video = nw.video)"""


@query("W14_display_ids", _SHOWN + " SELECT video, clip_index, frame, track_id, entity_id, display_id FROM num UNION ALL SELECT q.video, clip_index, frame, track_id, entity_id, display_id FROM q JOIN ids USING (video, local_id) WHERE clip_index > e0")
def w14(spark: SparkSession, d: str) -> DataFrame:
    rows = in_events(spark, d)
    people = rows.where("cls = 'person'").join(K.local_ids(rows).select("video", "track_id", "local_id"), ["video", "track_id"])
    people = people.withColumn("entity_id", (F.col("track_id") + F.floor(F.col("frame") / 7)) % 3)
    kept = people.where("video % 5 > 0 AND (clip_index + video) % 3 = 0").select("video", "clip_index").distinct()
    return K.display_ids(people, kept).select("video", "clip_index", "frame", "track_id", "entity_id", F.col("display_id").cast("long").alias("display_id"))


@query("W15_flicker_frames", "WITH " + cte("fx_presence") + """, s AS (SELECT *, max_person_conf >= 0.6 AS seen FROM fx_presence),
g AS (SELECT *, sum(CASE WHEN seen THEN 1 ELSE 0 END) OVER (PARTITION BY video ORDER BY frame) AS k FROM s),
r AS (SELECT *, row_number() OVER (PARTITION BY video, k ORDER BY frame) - 2 AS o, count(*) OVER (PARTITION BY video, k) - 1 AS gap, k = max(k) OVER (PARTITION BY video) AS lst FROM g WHERE k > 0)
SELECT video, frame FROM r WHERE NOT seen AND NOT lst AND gap BETWEEN 1 AND 60 AND o % 4 = 0""")
def w15(spark: SparkSession, d: str) -> DataFrame:
    return K.flicker_frames(view(spark, d, "fx_presence"))


@query("W22_sample_caps", "WITH " + cte("fx_det3") + ", b AS (SELECT video, frame, cx, (SELECT count(*) FROM fx_det3 f WHERE f.video = d.video AND f.frame < d.frame) AS bf FROM fx_det3 d) SELECT video, frame, cx FROM b WHERE bf < 20")
def w22(spark: SparkSession, d: str) -> DataFrame:
    return K.capped_samples(view(spark, d, "fx_det3"), 20).select("video", "frame", "cx")


@query("W22_entity_cap", _TEAM + " SELECT video, entity_id, frame FROM (SELECT *, row_number() OVER (PARTITION BY video, entity_id ORDER BY frame) AS k FROM e) WHERE k <= 12")
def w22e(spark: SparkSession, d: str) -> DataFrame:
    return K.capped_entities(_team(spark, d).withColumn("clip_index", F.lit(0)), 12).select("video", "entity_id", "frame")


@query("W23_recording_tail", _M + """, fr AS (SELECT video, frame FROM (SELECT DISTINCT * FROM fx_motion) UNION SELECT video, frame + 40 FROM fx_motion),
mo AS (SELECT DISTINCT video, frame FROM fx_motion), l AS (SELECT f.video, f.frame, max(m.frame) AS motion FROM fr f JOIN mo m ON m.video = f.video AND m.frame <= f.frame GROUP BY ALL),
k AS (SELECT *, CASE WHEN frame - lag(motion) OVER (PARTITION BY video ORDER BY frame) > 50 THEN 1 ELSE 0 END AS nw FROM l WHERE frame - motion <= 50)
SELECT video, frame, CAST(1 + sum(nw) OVER (PARTITION BY video ORDER BY frame) AS BIGINT) AS segment FROM k""")
def w23(spark: SparkSession, d: str) -> DataFrame:
    m = view(spark, d, "fx_motion")
    later = m.select("video", (F.col("frame") + 40).alias("frame"))
    return K.record_with_tail(m, m.unionAll(later), FPS)
