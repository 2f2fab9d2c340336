"""Away and back: points, intervals, heatmaps and the current state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchlake.functions import columns as C


def points(metrics: DataFrame) -> DataFrame:
    """(day, n, video, type, ts, hhmmss, minute): away and back reactions of videos without a removal that day.

    The log is read once: only reactions go through a window by video.
    """
    rows = metrics.where("video IS NOT NULL AND reaction IS NOT NULL").select("day", "n", "video", "ts", "reaction", "away", "removed")
    gone = F.max("removed").over(Window.partitionBy("day", "video"))
    rows = rows.withColumn("gone", gone).where("NOT gone AND reaction <> 'remove'")
    rows = rows.withColumn("at", C.stamp_or(F.col("video"), F.col("ts")))
    return rows.select(
        "day", "n", "video", F.col("reaction").alias("type"), "ts", F.date_format("at", "HH:mm:ss").alias("hhmmss"),
        (F.hour("at") * 60 + F.minute("at")).alias("minute"),
    )


def interval_events(reactions: DataFrame) -> DataFrame:
    """Reactions left after removals, and the last one of each run of one type per video (day, video, type, label, minute, ts, n).

    ``reactions`` has day, video, ts, n and reaction; rows without a video or a reaction don't count.
    """
    rows = reactions.where("video IS NOT NULL AND reaction IS NOT NULL")
    rows = rows.select("day", "n", "video", "ts", F.col("reaction").alias("type"), C.hhmm(F.col("video"), F.col("ts")).alias("label"))
    parts = F.split("label", ":")
    rows = rows.withColumn("minute", parts[0].cast("int") * 60 + parts[1].cast("int"))
    by_video = Window.partitionBy("day", "video")
    rows = rows.withColumns({
        "last_type": F.max_by("type", F.struct("minute", "ts", "n")).over(by_video),
        "last_removal": F.max(F.when(F.col("type") == "remove", F.col("minute"))).over(by_video),
    })
    left = rows.where("last_type <> 'remove' AND type <> 'remove' AND (last_removal IS NULL OR minute > last_removal)")
    nxt = F.lead("type").over(by_video.orderBy("minute", "ts", "n"))
    return left.withColumn("next_type", nxt).where("next_type IS NULL OR next_type <> type").select("day", "video", "type", "label", "minute", "ts", "n")


def intervals(events: DataFrame) -> DataFrame:
    """(day, pos, start, end, dur): away and back paired like a stack; what can't be paired stays open.

    A day's events are folded in order as one array: few a day, and days go to different tasks.
    """
    item = F.struct("minute", "ts", "n", "type", "label")
    days = events.groupBy("day").agg(F.array_sort(F.collect_list(item)).alias("events"))
    pair = "array<struct<start:string,end:string>>"
    zero = F.struct(F.array().cast("array<struct<minute:int,label:string>>").alias("open"), F.array().cast(pair).alias("out"))
    emit = lambda start, end: F.array(F.struct(start.cast("string").alias("start"), end.cast("string").alias("end")))

    def step(acc: Column, e: Column) -> Column:
        open_, out = acc["open"], acc["out"]
        top = F.try_element_at(open_, F.lit(-1))
        closes = top.isNotNull() & (e["minute"] > top["minute"])
        pushed = F.concat(open_, F.array(F.struct(e["minute"].alias("minute"), e["label"].alias("label"))))
        popped = F.slice(open_, 1, F.greatest(F.size(open_) - 1, F.lit(0)))
        new_open = F.when(e["type"] == "away", pushed).when(closes, popped).otherwise(open_)
        new_out = F.when((e["type"] == "back") & (F.size(open_) == 0), F.concat(out, emit(F.lit(None), e["label"]))).when(
            (e["type"] == "back") & closes, F.concat(out, emit(top["label"], e["label"]))
        )
        return F.struct(new_open.alias("open"), new_out.otherwise(out).alias("out"))

    folded = days.select("day", F.aggregate("events", zero, step).alias("f"))
    rest = F.transform("f.open", lambda o: F.struct(o["label"].alias("start"), F.lit(None).cast("string").alias("end")))
    rows = folded.select("day", F.posexplode(F.concat("f.out", rest)).alias("k", "x")).select("day", "k", "x.start", "x.end")
    minute = lambda c: F.split(c, ":")[0].cast("int") * 60 + F.split(c, ":")[1].cast("int")
    rows = rows.withColumn("dur", F.when(F.expr("start IS NOT NULL AND end IS NOT NULL"), C.duration_text(minute("end") - minute("start"))))
    w = Window.partitionBy("day").orderBy(F.coalesce(minute("start"), minute("end")), "k")
    return rows.withColumn("pos", F.row_number().over(w)).select("day", "pos", "start", "end", "dur")


def heatmap(pts: DataFrame, minutes: int = 15, start: int = 360, bins: int = 72) -> DataFrame:
    """(bin, any_days, away_days, back_days): distinct days with a point in each bin; bins without any have 0."""
    spark = pts.sparkSession
    hit = pts.where(F.col("minute").between(start, start + bins * minutes - 1)).withColumn("bin", F.floor((F.col("minute") - start) / minutes))
    days = lambda t: F.count_distinct(F.when(F.col("type").isin(*t), F.col("day")))
    got = hit.groupBy("bin").agg(days(["away", "back"]).alias("any_days"), days(["away"]).alias("away_days"), days(["back"]).alias("back_days"))
    return spark.range(bins).withColumnRenamed("id", "bin").join(got, "bin", "left").fillna(0)


def maxima(grid: DataFrame, *columns: str) -> DataFrame:
    """One row: the largest value of each column of a heatmap, 0 if it is empty."""
    return grid.agg(*(F.coalesce(F.max(c), F.lit(0)).alias(f"max_{c}") for c in columns))


def weekday_heatmap(pts: DataFrame, log_days: DataFrame, first_hour: int = 6, hours: int = 18) -> DataFrame:
    """(weekday, hour, days, log_days, share): how many of a weekday's log days have a point in the hour. Monday is 0."""
    spark = pts.sparkSession
    of = log_days.select("day").distinct().groupBy(F.weekday("day").alias("weekday")).agg(F.count("*").alias("log_days"))
    got = pts.groupBy(F.weekday("day").alias("weekday"), F.floor(F.col("minute") / 60).alias("hour")).agg(F.count_distinct("day").alias("days"))
    grid = spark.range(7 * hours).select(F.floor(F.col("id") / hours).cast("int").alias("weekday"), (F.col("id") % hours + first_hour).alias("hour"))
    out = grid.join(F.broadcast(of), "weekday", "left").join(got, ["weekday", "hour"], "left").fillna(0, ["days", "log_days"])
    return out.withColumn("share", F.coalesce(F.try_divide("days", "log_days"), F.lit(0.0)))


def current_state(pts: DataFrame) -> DataFrame:
    """(day, state, at_minute, events): the type of the point latest by event time, whatever its place in the log."""
    at = F.struct("minute", "ts", "n")
    return pts.groupBy("day").agg(F.max_by("type", at).alias("state"), F.max("minute").alias("at_minute"), F.count("*").alias("events"))
