"""Track analytics: motion events, filters, crossings, trust, speed, clip classes. All are expressions and windows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchlake.functions import columns as C
from watchlake.params import CrossingParams, MotionParams, SpeedParams, TrapParams, TrustParams


# ---- motion events


def motion_events(frames: DataFrame, fps: float, p: MotionParams = MotionParams()) -> DataFrame:
    """(video, clip_index, start_frame, end_frame, duration_s, class): a gap over ``gap_s`` starts a new event.

    Frames of a video are first merged within blocks of as many frames as the largest gap, so that a busy video's
    window runs over blocks, not frames; equal frames count once.
    """
    gap = int(p.gap_s * fps)
    block = F.floor(F.col("frame") / (gap + 1))
    w = Window.partitionBy("video").orderBy("block")
    blocks = frames.groupBy("video", block.alias("block")).agg(F.min("frame").alias("lo"), F.max("frame").alias("hi"))
    starts = F.coalesce(F.col("lo") - F.lag("hi").over(w) > p.gap_s * fps, F.lit(True))
    runs = blocks.withColumn("run", F.sum(starts.cast("int")).over(w))
    out = runs.groupBy("video", (F.col("run") - 1).alias("clip_index")).agg(F.min("lo").alias("start_frame"), F.max("hi").alias("end_frame"))
    return classify_events(out.withColumn("duration_s", (F.col("end_frame") - F.col("start_frame")) / fps), p)


def classify_events(events: DataFrame, p: MotionParams = MotionParams()) -> DataFrame:
    d = F.col("duration_s")
    return events.withColumn("class", F.when(d >= p.significant_s, "significant").when(d >= p.insignificant_s, "insignificant").otherwise("noise"))


def clip_motion_status(events: DataFrame) -> DataFrame:
    """(video, status): continue if any event is significant, else by whether any is longer than noise."""
    got = events.groupBy("video").agg(F.bool_or(F.col("class") == "significant").alias("s"), F.bool_or(F.col("class") == "insignificant").alias("i"))
    return got.select("video", F.when(F.col("s"), "continue").when(F.col("i"), "no_significant_motion").otherwise("no_motion").alias("status"))


def event_windows(events: DataFrame, fps: float, total_frames: int, full_s: float = 6.0, skip_s: float = 12.0, warmup: int = 15, p: MotionParams = MotionParams()) -> DataFrame:
    """Significant events with padded frames and strides; clips are numbered again, and an early first one starts at 0."""
    w = Window.partitionBy("video").orderBy("start_frame")
    kept = events.where(F.col("class") == "significant").withColumn("clip_index", F.row_number().over(w) - 1)
    long_ = F.col("duration_s") > full_s
    pad = F.when(long_, int(1.0 * fps)).otherwise(int(p.padding_s * fps))
    early = (F.col("clip_index") == 0) & (F.col("start_frame") <= warmup + fps)
    return kept.withColumns({
        "padded_start": F.when(early, 0).otherwise(F.greatest(F.lit(0), F.col("start_frame") - pad)).cast("long"),
        "padded_end": F.least(F.lit(total_frames), F.col("end_frame") + pad).cast("long"),
        "tracker_stride": F.when(F.col("duration_s") <= skip_s, 1).otherwise(2),
        "output_stride": F.when(long_, 2).otherwise(1),
    })


def in_windows(rows: DataFrame, windows: DataFrame, bucket: int = 1024) -> DataFrame:
    """Rows whose frame lies in an event's padded window, end excluded.

    Windows are cut at multiples of ``bucket`` frames and meet rows by (video, bucket), so a video's frames spread over its
    buckets, and each meets the windows of its own one only, however many the video has.
    """
    w = windows.select("video", "clip_index", "padded_start", "padded_end", "tracker_stride", "output_stride").where("padded_end > padded_start")
    w = w.withColumn("_bucket", F.explode(F.sequence(F.floor(F.col("padded_start") / bucket), F.floor((F.col("padded_end") - 1) / bucket))))
    rows = rows.withColumn("_bucket", F.floor(F.col("frame") / bucket))
    return rows.join(w, ["video", "_bucket"]).where("frame >= padded_start AND frame < padded_end").drop("_bucket")


def record_with_tail(motion: DataFrame, rows: DataFrame, fps: float, tail_s: float = 2.0) -> DataFrame:
    """Rows up to ``tail_s`` after the last motion frame at or before them, with the number of their segment."""
    tail, by_video = int(tail_s * fps), Window.partitionBy("video")
    marked = rows.select("video", "frame").distinct().join(motion.select("video", "frame").distinct().withColumn("moves", F.lit(True)), ["video", "frame"], "full_outer")
    before = F.last(F.when(F.col("moves"), F.col("frame")), ignorenulls=True).over(by_video.orderBy("frame"))
    kept = marked.withColumn("motion", before).where(F.col("frame") - F.col("motion") <= tail)
    new = F.coalesce(F.col("frame") - F.lag("motion").over(by_video.orderBy("frame")) > tail, F.lit(True))
    return kept.withColumn("segment", F.sum(new.cast("int")).over(by_video.orderBy("frame"))).select("video", "frame", "segment")


# ---- detections


def with_boxes(det: DataFrame, half_w: float = 20.0, half_h: float = 60.0) -> DataFrame:
    """Boxes around centres."""
    return det.withColumns({"x1": F.col("cx") - half_w, "y1": F.col("cy") - half_h, "x2": F.col("cx") + half_w, "y2": F.col("cy") + half_h})


def from_lists(frames: DataFrame, dx: float = 0.0, dy: float = 0.0) -> DataFrame:
    """One row per detection from parallel lists (boxes, ids, classes, confs), moved from crop to frame coordinates."""
    rows = frames.select("video", "frame", F.inline(F.arrays_zip("boxes", "ids", "classes", "confs")))
    b = F.col("boxes")
    return rows.select("video", "frame", F.col("ids").alias("track_id"), F.col("classes").alias("cls"), F.col("confs").alias("conf"),
                       (b[0] + dx).alias("x1"), (b[1] + dy).alias("y1"), (b[2] + dx).alias("x2"), (b[3] + dy).alias("y2"))


def confident(det: DataFrame, least: float, classes: list[str]) -> DataFrame:
    return det.where((F.col("conf") >= least) & F.col("cls").isin(*classes))


def possible_cars(det: DataFrame, line_y: float) -> DataFrame:
    """Without cars whose lower edge is beyond the line."""
    return det.where(~((F.col("cls") == "car") & (F.col("y2") > line_y)))


def ranked(det: DataFrame) -> DataFrame:
    """Place of each detection in its frame, most confident first."""
    return det.withColumn("rank", F.row_number().over(Window.partitionBy("video", "frame").orderBy(F.desc("conf"), "track_id", "cx")))


def moving_contours(contours: DataFrame, least_area: float, scale: float = 1.0) -> DataFrame:
    """Contours with more area than ``least_area``, which is given for the unscaled frame."""
    return contours.where(F.col("area") > least_area * scale**2)


def solid_contours(contours: DataFrame, least_area: float = 2000.0, solidity: float = 0.8) -> DataFrame:
    """Contours of ``least_area`` or more that fill enough of their hull; a hull without area is never filled."""
    return contours.where((F.col("area") >= least_area) & (F.coalesce(F.try_divide("area", "hull_area"), F.lit(0.0)) >= solidity))


def cars_over(det: DataFrame, x: float, y: float) -> DataFrame:
    """Cars whose box holds the point, edges included."""
    return det.where((F.col("cls") == "car") & F.lit(x).between(F.col("x1"), F.col("x2")) & F.lit(y).between(F.col("y1"), F.col("y2")))


def crop_rectangles(det: DataFrame, pad: int, width: int, height: int, lowest: int | None = None) -> DataFrame:
    """``det`` with padded whole-pixel boxes inside the frame; boxes that end below ``lowest`` and empty ones have no row."""
    pixel = lambda c: F.col(c).cast("int")
    rows = det if lowest is None else det.where(pixel("y2") <= lowest)
    rows = rows.withColumns({
        "x1": F.greatest(F.lit(0), pixel("x1") - pad), "y1": F.greatest(F.lit(0), pixel("y1") - pad),
        "x2": F.least(F.lit(width), pixel("x2") + pad), "y2": F.least(F.lit(height), pixel("y2") + pad),
    })
    return rows.where("x2 > x1 AND y2 > y1")


def output_frames(rows: DataFrame, marked: DataFrame) -> DataFrame:
    """Rows of padded windows that are shown: every ``output_stride``-th frame, and the ``marked`` (video, frame) ones.

    Marked are frames with a crossing or a highlight.
    """
    at = marked.select("video", "frame").distinct().withColumn("shown", F.lit(True))
    in_step = (F.col("frame") - F.col("padded_start")) % F.col("output_stride") == 0
    return rows.join(at, ["video", "frame"], "left").where(in_step | F.col("shown")).drop("shown")


def person_frames(det: DataFrame, polygon: Column, least: int = CrossingParams.person_frames) -> DataFrame:
    """(video, clip_index, frames) of events with ``least`` or more frames in which a person's centre is in the polygon."""
    inside = C.in_polygon(F.col("cx").cast("int"), F.col("cy").cast("int"), polygon)
    found = det.where((F.col("cls") == "person") & inside).groupBy("video", "clip_index").agg(F.count_distinct("frame").alias("frames"))
    return found.where(F.col("frames") >= least)


def low_confidence(det: DataFrame, least: float) -> DataFrame:
    """(video, clip_index, track_id) of tracks whose mean confidence in an event is below ``least``.

    Confidences are added up by frame, so that a mean at the limit doesn't depend on the order in which rows come. A track
    has a row or a few for each of an event's frames, so its list is short.
    """
    rows = det.groupBy("video", "clip_index", "track_id").agg(F.array_sort(F.collect_list(F.struct("frame", "conf"))).alias("seen"))
    mean = F.aggregate("seen", F.lit(0.0), lambda s, x: s + x["conf"]) / F.size("seen")
    return rows.where(mean < least).select("video", "clip_index", "track_id")


def without_suppressed(rows: DataFrame, suppressed: DataFrame) -> DataFrame:
    """Rows whose track of that event isn't suppressed."""
    return rows.join(suppressed.select("video", "clip_index", "track_id"), ["video", "clip_index", "track_id"], "left_anti")


def unique_objects(det: DataFrame, kept: DataFrame, suppressed: DataFrame) -> DataFrame:
    """(video, persons, cars): different tracks in kept events; tracks that were suppressed don't count as persons, also not before.

    ``det`` has video, clip_index, track_id, cls; ``kept`` (video, clip_index); ``suppressed`` (video, clip_index, track_id).
    """
    tracks = det.select("video", "clip_index", "track_id", "cls").distinct().join(kept.select("video", "clip_index").distinct(), ["video", "clip_index"], "left_semi")
    persons = without_suppressed(tracks.where("cls = 'person'"), suppressed)
    one = lambda c: F.count_distinct(F.when(F.col("cls") == c, F.col("track_id"))).alias(f"{c}s")
    return persons.unionByName(tracks.where("cls = 'car'")).groupBy("video").agg(one("person"), one("car"))


def tracking_table(det: DataFrame, timings: DataFrame, line_y: float) -> DataFrame:
    """(video, persons, cars, ups, downs, fps): one row per clip; people's steps over the line, and frames done a second.

    ``timings`` has video, total_frames and seconds; a clip without a time has 0 frames a second.
    """
    w = _track()
    rows = det.withColumn("y", _row()).withColumn("before", F.lag("y").over(w))
    person = F.col("cls") == "person"
    one = lambda c: F.count_distinct(F.when(F.col("cls") == c, F.col("track_id"))).alias(f"{c}s")
    counts = rows.groupBy("video").agg(
        one("person"), one("car"), F.count_if(person & (F.col("before") > line_y) & (F.col("y") <= line_y)).alias("ups"),
        F.count_if(person & (F.col("before") < line_y) & (F.col("y") >= line_y)).alias("downs"),
    )
    rate = F.when(F.col("seconds") > 0, F.try_divide(F.col("total_frames").cast("double"), F.col("seconds")))
    return counts.join(timings.select("video", F.coalesce(rate, F.lit(0.0)).alias("fps")), "video", "left").fillna(0.0, ["fps"])


def local_ids(det: DataFrame) -> DataFrame:
    """(video, track_id, cls, local_id): one number a track, counted among the tracks that were first seen in its first class.

    Tracks are counted by first appearance: frame, then confidence, falling. A track that changes its class keeps its
    number and takes none in the other.
    """
    at = F.struct("frame", -F.col("conf"), "cls")
    first = det.groupBy("video", "track_id").agg(F.min(at).alias("at")).withColumn("cls", F.col("at.cls"))
    w = Window.partitionBy("video", "cls").orderBy("at", "track_id")
    return first.select("video", "track_id", "cls", F.row_number().over(w).alias("local_id"))


def display_ids(people: DataFrame, kept: DataFrame) -> DataFrame:
    """``people`` (video, clip_index, frame, conf, entity_id, local_id) with display_id.

    Up to the first event of ``kept`` (video, clip_index), entities are numbered from 1 in each event, by first appearance.
    That event's map from local ids to numbers (the number of the entity that a local id first stood for) then goes on
    through the rest of the video, where local ids that it doesn't have take the numbers after its largest one, by first
    appearance, in kept events or not.
    """
    at = F.struct("clip_index", "frame", -F.col("conf"), "local_id", "entity_id")
    rows = people.join(kept.groupBy("video").agg(F.min("clip_index").alias("_first")), "video", "left")
    early = rows.where("_first IS NULL OR clip_index <= _first")
    numbers = early.groupBy("video", "clip_index", "entity_id").agg(F.min(at).alias("at"))
    numbers = numbers.withColumn("display_id", F.row_number().over(Window.partitionBy("video", "clip_index").orderBy("at"))).drop("at")
    first = early.where("clip_index = _first").groupBy("video", "clip_index", "local_id").agg(F.min_by("entity_id", at).alias("entity_id"))
    seed = first.join(numbers, ["video", "clip_index", "entity_id"]).select("video", "local_id", "display_id")
    most = seed.groupBy("video").agg(F.max("display_id").alias("_most"))
    new = rows.where("clip_index > _first").groupBy("video", "local_id").agg(F.min(at).alias("at")).join(seed, ["video", "local_id"], "left_anti").join(most, "video", "left")
    place = F.row_number().over(Window.partitionBy("video").orderBy("at"))
    later = seed.unionByName(new.select("video", "local_id", (F.coalesce("_most", F.lit(0)) + place).alias("display_id")))
    before = early.join(numbers, ["video", "clip_index", "entity_id"])
    return before.unionByName(rows.where("clip_index > _first").join(later, ["video", "local_id"])).drop("_first")


# ---- crossings


def _track(key: str = "track_id") -> Window:
    return Window.partitionBy("video", key).orderBy("frame")


def _row() -> Column:
    """A centre's pixel row."""
    return F.col("cy").cast("long")


def _steps(det: DataFrame, key: str, down: Column, up: Column) -> DataFrame:
    """(video, key, frame, direction) of the samples where one of the conditions over ``y`` and ``before`` holds."""
    rows = det.withColumn("y", _row()).withColumn("before", F.lag("y").over(_track(key)))
    return rows.withColumn("direction", F.when(down, "down").when(up, "up")).where("direction IS NOT NULL").select("video", key, "frame", "direction")


def plain_crossings(det: DataFrame, line_y: float, key: str = "track_id") -> DataFrame:
    """Steps over the line; landing on it counts as over."""
    y, before = F.col("y"), F.col("before")
    return _steps(det, key, (before < line_y) & (y >= line_y), (before > line_y) & (y <= line_y))


def band_crossings(det: DataFrame, p: CrossingParams = CrossingParams(), key: str = "track_id") -> DataFrame:
    """Steps from one edge of the tolerance band, or beyond it, to the other edge or beyond."""
    lo, hi, y, before = p.line_y - p.tolerance, p.line_y + p.tolerance, F.col("y"), F.col("before")
    return _steps(det, key, (before <= lo) & (y >= hi), (before >= hi) & (y <= lo))


def stable_sides(det: DataFrame, p: CrossingParams = CrossingParams(), key: str = "track_id") -> DataFrame:
    """Adds band (within the tolerance), streak (samples in a row at an edge or beyond) and side (the stable one so far).

    The edges belong to the band and to their side. The first sample of a track only tells where it appeared: it
    doesn't count towards a streak. A streak goes on when the side changes.
    """
    w, y = _track(key), F.col("y")
    rows = det.withColumn("y", _row()).withColumn("first", F.row_number().over(w) == 1)
    rows = rows.withColumn("band", F.abs(y - p.line_y) <= p.tolerance).withColumn("out", (F.abs(y - p.line_y) >= p.tolerance) & ~F.col("first"))
    rows = rows.withColumn("run", F.sum((~F.col("out")).cast("int")).over(w))
    streak = F.sum(F.col("out").cast("int")).over(Window.partitionBy("video", key, "run").orderBy("frame"))
    rows = rows.withColumn("streak", F.when(F.col("out"), streak).otherwise(0))
    now = F.when(F.col("out") & (F.col("streak") >= p.stable), F.when(y < p.line_y, "above").otherwise("below"))
    return rows.withColumn("qualified", now).withColumn("side", F.last("qualified", ignorenulls=True).over(w)).drop("run", "out", "first", "y")


def confirmed_crossings(det: DataFrame, fps: float, p: CrossingParams = CrossingParams(), key: str = "track_id") -> DataFrame:
    """(video, key, frame, direction): changes of the stable side that last ``dwell_s``, or hold to the end.

    Runs of equal qualified sides are islands; a run after another one is a crossing at its first frame. It counts
    if a qualified sample comes ``dwell_s`` later, or if it is the track's last run and the last sample is on its side.
    """
    rows = stable_sides(det, p, key)
    w = _track(key)
    ends = rows.groupBy("video", key).agg(F.max_by(F.when(_row() < p.line_y, "above").otherwise("below"), "frame").alias("final"))
    q = rows.where("qualified IS NOT NULL")
    q = q.withColumn("new", F.coalesce(F.col("qualified") != F.lag("qualified").over(w), F.lit(True)).cast("int"))
    runs = q.withColumn("run", F.sum("new").over(w)).groupBy("video", key, "run", "qualified").agg(F.min("frame").alias("frame"), F.max("frame").alias("until"))
    last = F.lead("run").over(Window.partitionBy("video", key).orderBy("run")).isNull()
    runs = runs.withColumn("last", last).join(ends, ["video", key])
    ok = (F.col("until") - F.col("frame") >= int(p.dwell_s * fps)) | (F.col("last") & (F.col("final") == F.col("qualified")))
    way = F.when(F.col("qualified") == "below", "down").otherwise("up")
    return runs.where((F.col("run") > 1) & ok).select("video", key, "frame", way.alias("direction"))


def with_known_side(det: DataFrame, line_y: float) -> DataFrame:
    """Adds y, side, nth (the sample's place in its entity) and known (the side where the tracker id was last seen before).

    A sample that steps over the line isn't remembered as the tracker id's last side.
    """
    rows = det.withColumns({"y": _row(), "nth": F.row_number().over(_track("entity_id"))})
    rows = rows.withColumns({"side": F.when(F.col("y") < line_y, "above").otherwise("below"), "before": F.lag("y").over(_track("entity_id"))})
    steps = F.expr(f"(before < {line_y} AND y >= {line_y}) OR (before > {line_y} AND y <= {line_y})")
    rows = rows.withColumn("kept", F.when(~F.coalesce(steps, F.lit(False)), F.col("side")))
    earlier = _track().rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("known", F.last("kept", ignorenulls=True).over(earlier)).drop("before", "kept")


def reacquired(det: DataFrame, line_y: float) -> DataFrame:
    """(video, entity_id, frame, start_side, direction): entities whose first sample is across the line from where its tracker id was."""
    rows = with_known_side(det, line_y).where("nth = 1 AND known <> side")
    return rows.select("video", "entity_id", "frame", F.col("known").alias("start_side"), F.when(F.col("side") == "below", "down").otherwise("up").alias("direction"))


def entity_crossings(det: DataFrame, fps: float, p: CrossingParams = CrossingParams()) -> DataFrame:
    """(video, entity_id, up, down): each entity's net directions from all signs of a crossing.

    ``det`` has video, entity_id, track_id, frame, cy of trusted people. Signs are steps over the band, confirmed changes
    of the stable side and re-acquisition on the other side, which also moves the entity's start to the side left.
    """
    found = reacquired(det, p.line_y)
    signs = band_crossings(det, p, "entity_id").unionByName(confirmed_crossings(det, fps, p, "entity_id")).unionByName(found.drop("start_side"))
    return net_directions(det, signs, p.line_y, "entity_id", found.select("video", "entity_id", "start_side"))


def highlights(det: DataFrame, p: CrossingParams = CrossingParams(), key: str = "track_id") -> DataFrame:
    """(video, key, frame) in the band, or within some frames after its last entry.

    A track's first sample opens no window, and a second sample in the band counts as an entry.
    """
    w = _track(key)
    rows = det.withColumn("band", F.abs(_row() - p.line_y) <= p.tolerance).withColumn("nth", F.row_number().over(w))
    rows = rows.withColumn("was", (F.col("nth") > 2) & F.lag("band").over(w))
    opened = F.max(F.when(F.col("band") & ~F.col("was") & (F.col("nth") > 1), F.col("frame") + p.highlight_frames)).over(w)
    return rows.withColumn("until", opened).where("band OR frame <= until").select("video", key, "frame")


def trust(det: DataFrame, p: TrustParams = TrustParams(), key: str = "track_id") -> DataFrame:
    """(video, key, frame, state): probation, trusted or suppressed after each update; suppression is for good."""
    w = _track(key)
    first = lambda c: F.first(c).over(w)
    drift = F.sqrt(F.pow(F.col("cx") - first("cx"), 2) + F.pow(F.col("cy") - first("cy"), 2))
    rows = det.withColumns({"n": F.row_number().over(w), "drift": drift, "mean": F.avg("conf").over(w)}).withColumn("far", F.max("drift").over(w))
    bad = (F.col("n") >= p.updates) & (F.col("far") <= p.drift_px) & (F.col("mean") < p.confidence)
    good = (F.col("far") > p.drift_px) | ((F.col("n") >= p.updates) & (F.col("mean") >= p.confidence))
    rows = rows.withColumns({"bad": F.max(bad).over(w), "good": F.max(good).over(w)})
    return rows.select("video", key, "frame", F.when(F.col("bad"), "suppressed").when(F.col("good"), "trusted").otherwise("probation").alias("state"))


def net_directions(det: DataFrame, crossings: DataFrame, line_y: float, key: str = "track_id", starts: DataFrame | None = None) -> DataFrame:
    """(video, key, up, down): one by the change of side from start to end; one each if equal and both were crossed.

    ``starts`` (video, key, start_side) says where some of them started, if that isn't their first sample's side.
    """
    side = F.when(_row() < line_y, "above").otherwise("below")
    ends = det.groupBy("video", key).agg(F.min_by(side, "frame").alias("start"), F.max_by(side, "frame").alias("final"))
    if starts is not None:
        ends = ends.join(starts, ["video", key], "left").withColumn("start", F.coalesce("start_side", "start"))
    seen = crossings.groupBy("video", key).agg(F.bool_or(F.col("direction") == "up").alias("ups"), F.bool_or(F.col("direction") == "down").alias("downs"))
    rows = ends.join(seen, ["video", key], "left")
    both = F.coalesce(F.col("ups") & F.col("downs"), F.lit(False)) & (F.col("start") == F.col("final"))
    return rows.select(
        "video", key, ((F.expr("start = 'below' AND final = 'above'")) | both).cast("int").alias("up"),
        ((F.expr("start = 'above' AND final = 'below'")) | both).cast("int").alias("down"),
    )


def clip_result(directions: DataFrame, person_frames: DataFrame, p: CrossingParams = CrossingParams()) -> DataFrame:
    """(video, persons_up, persons_down, status, direction): no_person below the least number of person frames."""
    moves = directions.groupBy("video").agg(F.sum("up").alias("persons_up"), F.sum("down").alias("persons_down"))
    rows = person_frames.join(moves, "video", "left").fillna(0, ["persons_up", "persons_down"])
    up, down, seen = F.col("persons_up") > 0, F.col("persons_down") > 0, F.col("frames") >= p.person_frames
    status = F.when(~seen, "no_person").when(up | down, "gate_crossing").otherwise("significant_motion")
    way = F.when(seen & up & down, "both").when(seen & up, "up").when(seen & down, "down")
    return rows.select("video", "persons_up", "persons_down", status.alias("status"), way.alias("direction"))


# ---- speed


def metres_per_pixel(x: Column, y: Column, width: int, height: int, p: SpeedParams) -> Column:
    xn = F.least(F.lit(1.0), F.greatest(F.lit(0.0), x / (width - 1)))
    yn = F.least(F.lit(1.0), F.greatest(F.lit(0.0), y / (height - 1)))
    row = F.least(F.lit(p.most_scale), F.greatest(F.lit(p.least_scale), 1.0 + p.row_gain * (p.reference_row - yn)))
    edge = F.abs(xn - 0.5) / 0.5
    return p.metres_per_pixel * row * (1.0 + p.edge_gain * edge * edge)


EVENT_TRACK = ["video", "clip_index", "track_id"]


def _event_track() -> Window:
    """Speed and trap know a track within one event only."""
    return Window.partitionBy(*EVENT_TRACK).orderBy("frame")


def raw_speeds(det: DataFrame, fps: float, width: int, height: int, p: SpeedParams = SpeedParams()) -> DataFrame:
    """Speed samples of consecutive centres of a track in an event; gaps over ``gap_s`` give none."""
    w = _event_track()
    d = lambda c: F.col(c) - F.lag(c).over(w)
    rows = det.withColumns({"dx": d("cx"), "dy": d("cy"), "df": d("frame")})
    rows = rows.where((F.col("df") > 0) & (F.col("df") / fps <= p.gap_s))
    px = F.sqrt(F.col("dx") * F.col("dx") + F.pow(p.dy_weight * F.col("dy"), 2))
    kmh = px / F.nullif(F.col("df") / fps, F.lit(0.0)) * metres_per_pixel(F.col("cx"), F.col("cy"), width, height, p) * 3.6
    return rows.withColumn("raw", F.when(px < p.least_px, 0.0).otherwise(F.least(kmh, F.lit(p.cap)))).select(*EVENT_TRACK, "frame", "raw")


def rolling_median(samples: DataFrame, p: SpeedParams = SpeedParams()) -> DataFrame:
    """Medians of the last samples, in single precision."""
    found = F.percentile(F.col("raw").cast("float"), 0.5).over(_event_track().rowsBetween(1 - p.window, 0))
    return samples.withColumn("median", found.cast("float").cast("double"))


def smoothed(medians: DataFrame, p: SpeedParams = SpeedParams()) -> DataFrame:
    """(video, clip_index, track_id, frame, speed): exponential smoothing from the first median on.

    A step is the map s -> alpha * median + (1 - alpha) * s, and steps are composed in blocks: within a block a row's value is
    a weighted running sum, and what the blocks before add is their last value times a power of 1 - alpha. Blocks are so
    long that after three of them a weight is beyond a double's precision, and so short that no weight overflows.
    """
    keep = 1 - p.alpha
    size = max(1, math.ceil(53 * math.log(2) / (-2 * math.log(keep)))) if 0 < keep < 1 else 1
    rows = medians.withColumn("_i", F.row_number().over(_event_track()) - 1)
    rows = rows.withColumns({"_block": F.floor(F.col("_i") / size), "_off": F.col("_i") % size})
    value = F.when(F.col("_i") == 0, F.col("median")).otherwise(p.alpha * F.col("median"))
    block = Window.partitionBy(*EVENT_TRACK, "_block").orderBy("frame")
    rows = rows.withColumn("_own", F.pow(F.lit(keep), F.col("_off")) * F.sum(value * F.pow(F.lit(keep), -F.col("_off"))).over(block)) if keep > 0 else rows.withColumn("_own", F.col("median"))
    ends = Window.partitionBy(*EVENT_TRACK).orderBy("_block")
    last = rows.where(F.col("_off") == size - 1).select(*EVENT_TRACK, "_block", F.col("_own").alias("_end"))
    carry = sum((F.pow(F.lit(keep), F.lit(k * size)) * F.coalesce(F.lag("_end", k).over(ends), F.lit(0.0)) for k in (1, 2)), F.col("_end"))
    carry = last.select(*EVENT_TRACK, (F.col("_block") + 1).alias("_block"), carry.alias("_carry"))
    both = rows.join(carry, [*EVENT_TRACK, "_block"], "left")
    speed = F.col("_own") + F.coalesce(F.col("_carry") * F.pow(F.lit(keep), F.col("_off") + 1), F.lit(0.0))
    return both.select(*EVENT_TRACK, "frame", speed.alias("speed"))


def trails(det: DataFrame, p: SpeedParams = SpeedParams()) -> DataFrame:
    """The last centres of a track in an event at each frame, oldest first."""
    centre = F.struct(F.col("cx").cast("int").alias("x"), F.col("cy").cast("int").alias("y"))
    return det.select(*EVENT_TRACK, "frame", F.collect_list(centre).over(_event_track().rowsBetween(1 - p.trail, 0)).alias("trail"))


def labelled_trails(trails_: DataFrame, speeds: DataFrame, p: SpeedParams = SpeedParams()) -> DataFrame:
    """Trails with the track's last known speed in the event and ``shown``: whether it is fast enough for a label and a trail.

    ``speeds`` has (video, clip_index, track_id, frame, speed); frames without a sample keep the speed before them.
    """
    rows = trails_.join(speeds, [*EVENT_TRACK, "frame"], "left")
    rows = rows.withColumn("speed", F.last("speed", ignorenulls=True).over(_event_track()))
    return rows.withColumn("shown", F.coalesce(F.col("speed") >= p.label_from, F.lit(False)))


def speed_trap(det: DataFrame, fps: float, p: TrapParams = TrapParams()) -> DataFrame:
    """(video, clip_index, track_id, frame, kmh, direction) of passes from one line to the other within an event."""
    rows = det.withColumn("px", F.lag("cx").over(_event_track())).where("px IS NOT NULL AND px <> cx")
    line = lambda v, k: F.when((F.col("px") - v) * (F.col("cx") - v) <= 0, F.struct(F.lit(k).alias("line"), F.lit(v).alias("x")))
    hits = rows.withColumn("hit", F.explode(F.array_compact(F.array(line(p.x1, 1), line(p.x2, 2)))))
    order = F.when(F.col("cx") > F.col("px"), F.col("hit.x")).otherwise(-F.col("hit.x"))
    w = Window.partitionBy(*EVENT_TRACK).orderBy("frame", "order")
    hits = hits.select(*EVENT_TRACK, "frame", "hit.line", order.alias("order"))
    hits = hits.withColumns({"from": F.lag("line").over(w), "df": F.col("frame") - F.lag("frame").over(w)}).where("from <> line AND df > 0")
    kmh = p.metres / F.nullif(F.col("df") / fps, F.lit(0.0)) * 3.6  # conditions may be merged and tried in any order
    way = F.when(F.col("from") == 1, "->").otherwise("<-")
    return hits.withColumn("kmh", kmh).where((F.col("kmh") > 0) & (F.col("kmh") <= p.cap)).select(*EVENT_TRACK, "frame", "kmh", way.alias("direction"))


# ---- samples and presence


def every_nth(rows: DataFrame, stride: Column, start: Column) -> DataFrame:
    return rows.where((F.col("frame") - start) % stride == 0)


def capped_samples(rows: DataFrame, most: int) -> DataFrame:
    """Samples until a clip has ``most``; those of the frame that passes it are kept whole."""
    w = Window.partitionBy("video").orderBy("frame").rangeBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("before", F.coalesce(F.count("*").over(w), F.lit(0))).where(F.col("before") < most).drop("before")


def capped_entities(rows: DataFrame, most: int = 400) -> DataFrame:
    """The first ``most`` rows of each entity of an event, by frame."""
    w = Window.partitionBy("video", "clip_index", "entity_id").orderBy("frame")
    return rows.withColumn("nth", F.row_number().over(w)).where(F.col("nth") <= most).drop("nth")


def flicker_frames(presence: DataFrame, conf: float = 0.6, most: int = 60, stride: int = 4) -> DataFrame:
    """(video, frame): every ``stride``-th frame of absences of 1 to ``most`` frames between two sightings."""
    w = Window.partitionBy("video").orderBy("frame")
    rows = presence.withColumn("seen", F.col("max_person_conf") >= conf)
    rows = rows.withColumns({
        "prior": F.last(F.when(F.col("seen"), F.col("frame")), ignorenulls=True).over(w),
        "next": F.first(F.when(F.col("seen"), F.col("frame")), ignorenulls=True).over(w.rowsBetween(0, Window.unboundedFollowing)),
    })
    gap = F.col("next") - F.col("prior") - 1
    return rows.where(~F.col("seen") & gap.between(1, most) & ((F.col("frame") - F.col("prior") - 1) % stride == 0)).select("video", "frame")
