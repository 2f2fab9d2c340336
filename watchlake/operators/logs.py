"""Log analytics: lines to entries, entries to one row per video, videos to day statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchlake.functions import columns as C
from watchlake.operators import presence
from watchlake.operators.graph import written
from watchlake.params import LogParams

LINE = r"^(\[W\] )?(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) - ([A-Z]+) - (.*)$"
MESSAGE = r"^\[([^\]]+)\]\s*(\[W\] )?(.*)$"

# The patterns of the log's messages. A user may pass more; each gives a column of the named type. The
# last item is a text that every match holds: only lines with it are matched at all.
PATTERNS: dict[str, tuple[str, int, str, str]] = {
    "status": (r"Status:\s*([a-z_]+)", 1, "string", "Status:"),
    "full_s": (r"Full processing took ([0-9]+\.[0-9]+|[0-9]+) seconds", 1, "double", "Full processing took "),
    "raw_events": (r"Found (\d+) raw motion event\(s\)", 1, "int", "raw motion event(s)"),
    "md_s": (r"Motion detection took ([0-9]+\.[0-9]+|[0-9]+) seconds", 1, "double", "Motion detection took "),
    "gate_dir": (r"Gate crossing detected! Direction: (up|down|both)", 1, "string", "Gate crossing detected! Direction: "),
    "gate_up": (r"Gate crossing detected! Direction: (?:up|down|both)\. Persons Up: (\d+), Down: (\d+)", 1, "int", "Persons Up: "),
    "gate_down": (r"Gate crossing detected! Direction: (?:up|down|both)\. Persons Up: (\d+), Down: (\d+)", 2, "int", "Persons Up: "),
    "is_new": (r"^New file detected:", 0, "boolean", "New file detected:"),
    "fast": (r"fast_processing=True", 0, "boolean", "fast_processing=True"),
    "saved_frame": (r"Saved \w+ frame to ", 0, "boolean", "Saved "),
    "away": (r"Reaction detected: object went away", 0, "boolean", "Reaction detected: object went away"),
    "back": (r"Reaction detected: object came back", 0, "boolean", "Reaction detected: object came back"),
    "removed": (r"Reaction removed\.", 0, "boolean", "Reaction removed."),
    "speed": (r"SpeedTrap (\d+) km/h", 1, "int", "SpeedTrap "),
    "soc": (r"SoC fetched: (\d+)%", 1, "int", "SoC fetched: "),
}
_NEW = r"ReID result:\s*matched=(True|False),\s*pos=([0-9]*\.?[0-9]+),\s*neg=([0-9]*\.?[0-9]+),\s*delta=(-?[0-9]*\.?[0-9]+),\s*thr=[0-9]*\.?[0-9]+,\s*margin=[0-9]*\.?[0-9]+"
_OLD = r"ReID result:\s*matched=(True|False),\s*best_score=([0-9]*\.?[0-9]+),\s*threshold=[0-9]*\.?[0-9]+"


def _parts(text: Column, pattern: str, groups: int) -> Column:
    """The groups of a pattern that is about a whole text, from one match; the text itself alone where it doesn't match.

    As a generated column it is computed once a row: conditions on it stay above it and don't match again.
    """
    mark = "\x01\x02"
    return F.explode(F.array(F.split(F.regexp_replace(text, pattern, mark.join(f"${k + 1}" for k in range(groups))), mark, groups)))


def parse_lines(lines: DataFrame, line: str = "line") -> DataFrame:
    """(n, day, ts, level, video, content, worker) of the lines that match and carry their file's date.

    A line is matched once, and its message once.
    """
    part = lambda c, k: F.get(c, F.lit(k))  # noqa: E731  (null beyond the end)
    m = lines.select("n", "day", _parts(F.col(line), LINE, 4).alias("parts"))
    m = m.select("n", "day", *(part("parts", k).alias(c) for k, c in enumerate(("prefix", "stamp", "level", "message"))))
    m = m.where(F.startswith("stamp", F.date_format("day", "yyyy-MM-dd")))
    m = m.select("n", "day", "prefix", "level", "message", F.try_to_timestamp("stamp", F.lit("yyyy-MM-dd HH:mm:ss")).alias("ts"), _parts(F.col("message"), MESSAGE, 3).alias("found"))
    has = part("found", 2).isNotNull()
    return m.where("ts IS NOT NULL").select(
        "n", "day", "ts", "level", F.when(has, part("found", 0)).alias("video"), F.coalesce(part("found", 2), "message").alias("content"),
        ((F.col("prefix") != "") | (has & (part("found", 1) != ""))).alias("worker"),
    )


def with_metrics(entries: DataFrame, patterns: dict[str, tuple] | None = None) -> DataFrame:
    """The entries and one column for each pattern; flags are false and values null where nothing matches.

    A pattern is (expression, group, type) and may name a text without which it can't match.
    """
    out, content = {}, F.col("content")
    for name, (pattern, group, kind, *text) in (patterns or PATTERNS).items():
        may = content.contains(text[0]) if text else F.lit(True)
        if kind == "boolean":
            out[name] = may if text and pattern in (text[0], text[0].replace(".", "\\.")) else may & content.rlike(pattern)
        else:
            out[name] = F.when(may, C.some(F.regexp_extract("content", pattern, group)).try_cast(kind))
    is_reid = content.contains("ReID result:")
    new, old = (lambda k: C.some(F.regexp_extract("content", _NEW, k))), (lambda k: C.some(F.regexp_extract("content", _OLD, k)))
    out["reid_matched"] = F.when(is_reid, F.coalesce(new(1), old(1)) == "True")
    out["reid_best"] = F.when(is_reid, F.coalesce(new(2), old(2)).cast("double"))
    out["reid_neg"], out["reid_delta"] = F.when(is_reid, new(3).cast("double")), F.when(is_reid, new(4).cast("double"))
    found = entries.withColumns(out)
    reaction = F.when(F.col("away"), "away").when(F.col("back"), "back").when(F.col("removed"), "remove")
    failed = F.coalesce(F.col("status") == "error", F.lit(False)) | F.col("level").isin("ERROR", "CRITICAL")
    return found.withColumns({"reaction": reaction, "failed": failed})


def last(c: str, order: str = "n") -> Column:
    """The column's last value that isn't null."""
    return F.max_by(c, F.when(F.col(c).isNotNull(), F.col(order)))


def _video_folds() -> list[Column]:
    real = F.when(F.col("status") != "error", F.col("n"))
    return [
        F.max_by("status", real).alias("real_status"), F.min(real).alias("first_real"), F.max(F.when(F.col("failed"), F.col("n"))).alias("last_error"),
        F.min_by("ts", F.when(F.col("is_new"), F.col("n"))).alias("first_seen"),
        F.bool_or("fast").alias("fast"), F.bool_or("worker").alias("worker"), F.bool_or("saved_frame").alias("has_frames"),
        F.max(F.when(F.col("speed") > 0, F.col("speed"))).alias("top_speed"), *(last(c).alias(name) for name, c in LASTS.items()),
    ]


#: what counts is the last value that isn't null: name of the result, and of the column
LASTS = {c: c for c in "full_s md_s raw_events reid_best reid_neg reid_delta reid_matched gate_dir gate_up gate_down".split()} | {"last_reaction": "reaction"}


def video_states(metrics: DataFrame) -> DataFrame:
    """(day, video, ...): what ``video_summary`` needs of some lines, so that it can be merged with that of others.

    A value that counts by its place in the log keeps that place beside it, so parts merge in any order.
    """
    n = F.col("n")
    at = lambda c, ok: F.when(ok, F.struct(n.alias("n"), c.alias("value")))
    status, real = F.col("status"), F.col("status") != "error"
    lasts = [F.max(at(F.col(c), F.col(c).isNotNull())).alias(name) for name, c in LASTS.items()]
    return metrics.where("video IS NOT NULL").groupBy("day", "video").agg(
        F.max(at(status, real)).alias("real_status"), F.min(F.when(real, n)).alias("first_real"), F.max(F.when(F.col("failed"), n)).alias("last_error"),
        F.min(at(F.col("ts"), F.col("is_new"))).alias("first_seen"), F.bool_or("fast").alias("fast"), F.bool_or("worker").alias("worker"),
        F.bool_or("saved_frame").alias("has_frames"), F.max(F.when(F.col("speed") > 0, F.col("speed"))).alias("top_speed"), *lasts,
    )


def merged_videos(states: DataFrame) -> DataFrame:
    """The rows of ``video_summary`` from any number of ``video_states`` of its lines, each line in one of them."""
    least = {"first_real", "first_seen"}
    folds = [(F.min if c in least else F.max)(c).alias(c) for c in states.columns if c not in ("day", "video")]
    rows = states.groupBy("day", "video").agg(*folds)
    rows = rows.withColumns({c: F.col(c)["value"] for c in ("real_status", "first_seen", *LASTS)})
    return rows.select("day", "video", *_video_columns())


def _video_columns() -> list[Column]:
    return [
        F.coalesce("real_status", F.when(F.col("last_error").isNotNull(), "error")).alias("status"),
        F.coalesce(F.col("last_error") >= F.col("first_real"), F.lit(False)).alias("pipeline_error"),
        *map(F.col, ("full_s", "md_s")), F.coalesce("md_s", "full_s").alias("processing_s"),
        *map(F.col, ("raw_events", "first_seen", "fast", "worker", "has_frames")), F.nullif("last_reaction", F.lit("remove")).alias("reaction"),
        *map(F.col, ("reid_best", "reid_neg", "reid_delta", "reid_matched", "top_speed", "gate_dir", "gate_up", "gate_down")),
    ]


def video_summary(metrics: DataFrame) -> DataFrame:
    """One row per (day, video), in a single aggregation that combines before its shuffle."""
    rows = metrics.where("video IS NOT NULL").groupBy("day", "video").agg(*_video_folds())
    return rows.select("day", "video", *_video_columns())


COUNTED = "status IS NOT NULL OR full_s IS NOT NULL OR raw_events IS NOT NULL"


def video_groups(metrics: DataFrame, p: LogParams = LogParams()) -> DataFrame:
    """As ``video_summary``, with a row for each day's lines without a video, and what they add to the day's statistics.

    The columns g_min, g_max, g_sum, g_n (motion times, capped in the sum), g_up and g_down are about these lines;
    ``events`` are the row's reactions (ts, n, type), which are few.
    """
    md, way = F.col("md_s"), F.col("gate_dir")
    more = [
        F.min(md).alias("g_min"), F.max(md).alias("g_max"), F.sum(_capped(md, p)).alias("g_sum"), F.count(md).alias("g_n"),
        F.count_if(way.isin("up", "both")).alias("g_up"), F.count_if(way.isin("down", "both")).alias("g_down"),
        F.collect_list(F.when(F.col("video").isNotNull() & F.col("reaction").isNotNull(), F.struct("ts", "n", F.col("reaction").alias("type")))).alias("events"),
    ]
    rows = metrics.groupBy("day", "video").agg(*_video_folds(), *more)
    return rows.select("day", "video", *_video_columns(), "g_min", "g_max", "g_sum", "g_n", "g_up", "g_down", "events")


def counted(videos: DataFrame) -> DataFrame:
    """The videos that count: those with a status, a full time or raw events."""
    return videos.where(COUNTED)


def gate_counts(metrics: DataFrame) -> DataFrame:
    """(day, up, down): a video counts by its last direction, a line without a video by itself; both counts twice."""
    return _by_day(video_groups(metrics)).select("day", "up", "down")


def _capped(value: Column, p: LogParams) -> Column:
    """A time, but no more than the cap; null stays null."""
    return F.when(value.isNotNull(), F.least(value, F.lit(p.cap_seconds)))


def _by_day(groups: DataFrame, p: LogParams = LogParams()) -> DataFrame:
    return groups.groupBy("day").agg(*_day_folds(p))


def _day_folds(p: LogParams) -> list[Column]:
    alone = F.col("video").isNull()
    either = lambda mine, theirs: F.when(alone, theirs).otherwise(mine)
    own = lambda c: F.when(~alone, c)
    gate = lambda way: F.sum(either(F.coalesce(F.col("gate_dir").isin(way, "both"), F.lit(False)).cast("long"), F.col(f"g_{way}")))
    times = F.sum(either(F.col("md_s").isNotNull().cast("long"), F.col("g_n")))
    return [
        F.count_if(~alone & F.expr(COUNTED)).alias("videos_total"),
        F.min(either(F.col("md_s"), F.col("g_min"))).alias("md_min"), F.max(either(F.col("md_s"), F.col("g_max"))).alias("md_max"),
        F.try_divide(F.sum(either(_capped(F.col("md_s"), p), F.col("g_sum"))), times).alias("md_avg"),
        F.min(own(F.col("full_s"))).alias("full_min"), F.max(own(F.col("full_s"))).alias("full_max"), F.avg(own(_capped(F.col("full_s"), p))).alias("full_avg"),
        gate("up").alias("up"), gate("down").alias("down"),
    ]


def day_statistics(metrics: DataFrame, p: LogParams = LogParams()) -> DataFrame:
    """Totals, capped statistics and gate counts of each day: one aggregation by (day, video), and one by day on top."""
    return _by_day(video_groups(metrics, p), p)


def chart_rows(videos: DataFrame) -> DataFrame:
    """(day, place, video, time, seconds, status): videos with a processing time, in the day's order, seconds at two digits."""
    rows = ordered_videos(videos.where("processing_s IS NOT NULL"))
    return rows.select("day", "place", "video", C.hhmmss(F.col("video"), F.col("first_seen")).alias("time"), F.round("processing_s", 2).alias("seconds"), "status")


def reaction_lists(videos: DataFrame) -> DataFrame:
    """(day, reaction, place, video): the videos whose latest reaction is away or back, sorted by name."""
    w = Window.partitionBy("day", "reaction").orderBy("video")
    return videos.where("reaction IS NOT NULL").select("day", "reaction", F.row_number().over(w).alias("place"), "video")


def day_bundle(metrics: DataFrame, p: LogParams = LogParams()) -> DataFrame:
    """One row per day: statistics, status_counts, and the chart rows and the away intervals as arrays.

    The log is read once: everything is built from one written row per video, all but the intervals in one aggregation by
    day. A bundle's arrays are as long as the day.
    """
    groups = written(video_groups(metrics, p), "groups")
    videos = groups.where("video IS NOT NULL")
    row = F.struct("first_seen", "video", C.hhmmss(F.col("video"), F.col("first_seen")).alias("time"), F.round("processing_s", 2).alias("seconds"), "status")
    lists = [
        F.collect_list(F.when(F.col("video").isNotNull() & F.col("processing_s").isNotNull(), row)).alias("chart"),
        F.collect_list(F.when(F.col("video").isNotNull(), F.col("status"))).alias("statuses"),
    ]
    days = groups.groupBy("day").agg(*_day_folds(p), *lists)
    each = F.transform(F.array_sort(F.array_distinct("statuses")), lambda s: F.struct(s, F.size(F.filter("statuses", lambda x: x == s)).cast("long")))
    rest = F.col("videos_total") - F.size("statuses")
    counts = F.map_concat(F.map_from_entries(each), F.when(rest > 0, F.create_map(F.lit("unknown"), rest)).otherwise(F.create_map().cast("map<string,bigint>")))
    days = days.withColumns({"status_counts": counts, "chart": F.transform(F.array_sort("chart"), lambda x: x.dropFields("first_seen"))}).drop("statuses")
    events = videos.select("day", "video", F.inline("events")).withColumnRenamed("type", "reaction")
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("pos", "start", "end", "dur"))), lambda x: x.dropFields("pos"))
    return days.join(presence.intervals(presence.interval_events(events)).groupBy("day").agg(pairs.alias("intervals")), "day", "left")


def day_entries(videos: DataFrame, p: LogParams = LogParams()) -> DataFrame:
    """(day, videos_total, status_counts with the unknown rest, md_avg, full_avg): averages over videos only."""
    c = F.when(F.expr("status IS NOT NULL OR full_s IS NOT NULL OR raw_events IS NOT NULL"), 1)
    totals = videos.groupBy("day").agg(
        F.count(c).alias("videos_total"), F.count("status").alias("known"), F.avg(_capped(F.col("md_s"), p)).alias("md_avg"),
        F.avg(_capped(F.col("full_s"), p)).alias("full_avg"),
    )
    counts = videos.where("status IS NOT NULL").groupBy("day", "status").count()
    maps = counts.groupBy("day").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("status", "count")))).alias("m"))
    rest = F.col("videos_total") - F.col("known")
    known = F.coalesce("m", F.create_map().cast("map<string,bigint>"))
    more = F.when(rest > 0, F.map_concat(known, F.create_map(F.lit("unknown"), rest))).otherwise(known)
    return totals.join(maps, "day", "left").select("day", "videos_total", more.alias("status_counts"), "md_avg", "full_avg")


def filter_day(metrics: DataFrame, severity: str | None = None, statuses: list[str] | None = None, gate: str | None = None, video: str | None = None) -> DataFrame:
    """Entries by severity, their video's status, its gate direction (or both) and its name.

    Where videos have a say, the entries are written first, so the log is parsed once.
    """
    out = metrics = written(metrics, "metrics") if statuses or gate else metrics
    videos = video_summary(metrics)
    if severity:
        out = out.where(F.col("level") == severity)
    if statuses:
        out = out.join(videos.where(F.col("status").isin(*statuses)).select("day", "video"), ["day", "video"], "left_semi")
    if gate:
        out = out.join(videos.where(F.col("gate_dir").isin(gate, "both")).select("day", "video"), ["day", "video"], "left_semi")
    if video:
        out = out.where(F.col("video") == video)
    return out


def ordered_videos(videos: DataFrame) -> DataFrame:
    """Place of each video within its day: unseen ones first, then by first sight, then by name."""
    w = Window.partitionBy("day").orderBy(F.asc_nulls_first("first_seen"), "video")
    return videos.withColumn("place", F.row_number().over(w))


def status_order(counts: DataFrame) -> DataFrame:
    """(status, place): the preferred order, then others by name, unknown last."""
    # The preferred order of statuses.
    preferred = ["no_motion", "no_significant_motion", "no_person", "significant_motion", "gate_crossing", "error"]
    at = F.array_position(F.array(*map(F.lit, preferred)), F.col("status"))
    group = F.when(F.col("status") == "unknown", 2).when(at > 0, 0).otherwise(1)
    rows = counts.select("status").distinct()
    return rows.withColumn("place", F.row_number().over(Window.orderBy(group, F.when(at > 0, at).otherwise(0), "status")))
