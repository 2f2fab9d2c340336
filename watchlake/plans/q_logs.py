"""Queries of log analytics and presence."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.functions import columns as C
from watchlake.operators import logs as L
from watchlake.operators import presence as P
from watchlake.operators.graph import written
from watchlake.plans.fixtures import cte, view
from watchlake.plans.registry import query


def entries(spark: SparkSession, d: str) -> DataFrame:
    return L.parse_lines(view(spark, d, "fx_log"))


def metrics(spark: SparkSession, d: str) -> DataFrame:
    return L.with_metrics(entries(spark, d))


def videos(spark: SparkSession, d: str) -> DataFrame:
    return L.video_summary(metrics(spark, d))


_ENT = (
    "WITH "
    + cte("fx_log")
    + r""",
lm AS (SELECT n, day, line, regexp_extract(line, '^(\[W\] )?(\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2}) - ([A-Z]+) - (.*)$', ['p','s','l','m']) AS g FROM fx_log
  WHERE regexp_matches(line, '^(\[W\] )?\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} - [A-Z]+ - ')),
e0 AS (SELECT n, day, try_strptime(g.s, '%Y-%m-%d %H:%M:%S') AS ts, g.l AS level, g.p AS p, g.m AS m,
  regexp_matches(g.m, '^\[[^\]]+\]') AS has, regexp_extract(g.m, '^\[([^\]]+)\]\s*(\[W\] )?(.*)$', ['v','w','c']) AS h FROM lm),
ent AS (SELECT n, day, ts, level, CASE WHEN has THEN h.v END AS video, CASE WHEN has THEN h.c ELSE m END AS content, p <> '' OR (has AND h.w <> '') AS worker
  FROM e0 WHERE ts IS NOT NULL AND CAST(ts AS DATE) = day)"""
)
_MET = _ENT + r""",
met AS (SELECT *, nullif(regexp_extract(content, 'Status:\s*([a-z_]+)', 1), '') AS status,
  TRY_CAST(nullif(regexp_extract(content, 'Full processing took (\d+\.?\d*) seconds', 1), '') AS DOUBLE) AS full_s,
  TRY_CAST(nullif(regexp_extract(content, 'Found (\d+) raw motion event', 1), '') AS INTEGER) AS raw_events,
  TRY_CAST(nullif(regexp_extract(content, 'Motion detection took (\d+\.?\d*) seconds', 1), '') AS DOUBLE) AS md_s,
  nullif(regexp_extract(content, 'Gate crossing detected! Direction: (up|down|both)', 1), '') AS gate_dir,
  TRY_CAST(nullif(regexp_extract(content, 'Persons Up: (\d+), Down', 1), '') AS INTEGER) AS gate_up,
  TRY_CAST(nullif(regexp_extract(content, 'Persons Up: \d+, Down: (\d+)', 1), '') AS INTEGER) AS gate_down,
  starts_with(content, 'New file detected:') AS is_new, contains(content, 'fast_processing=True') AS fast, regexp_matches(content, 'Saved \w+ frame to ') AS saved_frame,
  CASE WHEN contains(content, 'Reaction detected: object went away') THEN 'away' WHEN contains(content, 'Reaction detected: object came back') THEN 'back'
    WHEN contains(content, 'Reaction removed.') THEN 'remove' END AS reaction,
  TRY_CAST(nullif(regexp_extract(content, 'SpeedTrap (\d+) km/h', 1), '') AS INTEGER) AS speed,
  nullif(regexp_extract(content, 'ReID result:\s*matched=(True|False)', 1), '') = 'True' AS reid_matched,
  TRY_CAST(nullif(regexp_extract(content, 'ReID result:.*(pos|best_score)=([0-9.]+)', 2), '') AS DOUBLE) AS reid_best,
  TRY_CAST(nullif(regexp_extract(content, 'ReID result:.* neg=([0-9.]+)', 1), '') AS DOUBLE) AS reid_neg,
  TRY_CAST(nullif(regexp_extract(content, 'ReID result:.* delta=(-?[0-9.]+)', 1), '') AS DOUBLE) AS reid_delta,
  TRY_CAST(nullif(regexp_extract(content, 'SoC fetched: (\d+)%', 1), '') AS INTEGER) AS soc,
  (coalesce(regexp_extract(content, 'Status:\s*([a-z_]+)', 1) = 'error', false) OR level IN ('ERROR', 'CRITICAL')) AS failed FROM ent)"""
_VID = _MET + """,
vid AS (SELECT day, video, coalesce(last(status ORDER BY n) FILTER (WHERE status <> 'error'), CASE WHEN bool_or(failed) THEN 'error' END) AS status,
  coalesce(max(n) FILTER (WHERE failed) >= min(n) FILTER (WHERE status <> 'error'), false) AS pipeline_error,
  arg_max(full_s, n) FILTER (WHERE full_s IS NOT NULL) AS full_s, arg_max(md_s, n) FILTER (WHERE md_s IS NOT NULL) AS md_s,
  arg_max(raw_events, n) FILTER (WHERE raw_events IS NOT NULL) AS raw_events, arg_min(ts, n) FILTER (WHERE is_new) AS first_seen,
  bool_or(fast) AS fast, bool_or(worker) AS worker, bool_or(saved_frame) AS has_frames,
  nullif(arg_max(reaction, n) FILTER (WHERE reaction IS NOT NULL), 'remove') AS reaction,
  arg_max(reid_best, n) FILTER (WHERE reid_best IS NOT NULL) AS reid_best, arg_max(reid_neg, n) FILTER (WHERE reid_neg IS NOT NULL) AS reid_neg,
  arg_max(reid_delta, n) FILTER (WHERE reid_delta IS NOT NULL) AS reid_delta, arg_max(reid_matched, n) FILTER (WHERE reid_matched IS NOT NULL) AS reid_matched,
  max(speed) FILTER (WHERE speed > 0) AS top_speed, arg_max(gate_dir, n) FILTER (WHERE gate_dir IS NOT NULL) AS gate_dir,
  arg_max(gate_up, n) FILTER (WHERE gate_up IS NOT NULL) AS gate_up, arg_max(gate_down, n) FILTER (WHERE gate_down IS NOT NULL) AS gate_down
  FROM met WHERE video IS NOT NULL GROUP BY day, video)"""
_ST = "strftime({}, '%Y-%m-%d %H:%M:%S')"
_DAY = "CAST(day AS VARCHAR) AS day"


def _text(c: str) -> F.Column:
    return F.date_format(c, "yyyy-MM-dd HH:mm:ss")


def _day(df: DataFrame) -> DataFrame:
    return df.withColumn("day", F.col("day").cast("string"))


#: Columns that may be null leave as doubles and texts, which all readers show alike.
_SAFE = {c: f"CAST({c} AS DOUBLE) AS {c}" for c in ("raw_events", "gate_up", "gate_down", "speed", "soc", "top_speed")}
_SAFE |= {"reid_matched": "CAST(reid_matched AS STRING) AS reid_matched"}


def _safe(cols: str) -> str:
    return ", ".join(_SAFE.get(c, c) for c in cols.split())


def reactions(spark: SparkSession, d: str) -> DataFrame:
    """What presence needs of each line, written: days and points are both told from it."""
    return written(metrics(spark, d).select("day", "n", "video", "ts", "reaction", "away", "removed"), "reactions")


def _simple(name: str, source, cols: str, sql: str) -> None:
    """A query that takes columns of a shared frame, as SQL expressions."""

    @query(name, sql)
    def run(spark: SparkSession, d: str) -> DataFrame:
        return _day(source(spark, d)).selectExpr(*(_SAFE.get(x.strip(), x.strip()) for x in cols.split(";")))


# ---- sources and projections
_simple("S02_log_scan", entries, "n; day; date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS ts; level; video; content; worker",
        f"{_ENT} SELECT n, {_DAY}, {_ST.format('ts')} AS ts, level, video, content, worker FROM ent")


@query("S01_log_discovery", "WITH " + cte("fx_log") + r""", named AS (SELECT n, day, line, CASE WHEN day = (SELECT max(day) FROM fx_log) THEN 'video_processor.log' ELSE 'video_processor_' || CAST(day AS VARCHAR) || '.log' END AS file FROM fx_log)
SELECT file, coalesce(nullif(regexp_extract(file, '^video_processor_(\d{4}-\d{2}-\d{2})\.log$', 1), ''),
  arg_min(nullif(regexp_extract(line, '^(?:\[W\] )?(\d{4}-\d{2}-\d{2}) \d{2}:\d{2}:\d{2} - [A-Z]+ - ', 1), ''), n) FILTER (WHERE regexp_matches(line, '^(\[W\] )?\d{4}-\d{2}-\d{2} \d{2}:\d{2}:\d{2} - [A-Z]+ - '))) AS day, count(*) AS lines
FROM named GROUP BY file""")
def s01(spark: SparkSession, d: str) -> DataFrame:
    from watchlake.sources.logs import file_days

    lines = view(spark, d, "fx_log")
    newest = lines.agg(F.max("day").alias("newest"))
    rotated = F.concat(F.lit("video_processor_"), F.col("day").cast("string"), F.lit(".log"))
    named = lines.join(F.broadcast(newest)).withColumn("file", F.when(F.col("day") == F.col("newest"), "video_processor.log").otherwise(rotated))
    return file_days(named.select("file", "n", "line"), "video_processor")


def text_lines(spark: SparkSession, d: str) -> DataFrame:
    """The log as text files, a folder a day, written in order and read back."""
    from watchlake.sources.logs import daily_lines, read_lines
    from watchlake.sources.store import DayStore

    path = DayStore.temporary(spark).path
    view(spark, d, "fx_log").repartitionByRange("day", "n").sortWithinPartitions("day", "n").select("day", "line").write.partitionBy("day").text(path)
    return daily_lines(read_lines(spark, path), "video_processor")


@query("S01_text_files", "WITH " + cte("fx_log") + " SELECT CAST(day AS VARCHAR) AS day, count(*) AS lines FROM fx_log GROUP BY day")
def s01t(spark: SparkSession, d: str) -> DataFrame:
    return _day(text_lines(spark, d).groupBy("day").agg(F.count("*").alias("lines")))


_simple("S02_text_scan", lambda s, d: L.parse_lines(text_lines(s, d)), "day; date_format(ts, 'yyyy-MM-dd HH:mm:ss') AS ts; level; video; content; worker",
        f"{_ENT} SELECT {_DAY}, {_ST.format('ts')} AS ts, level, video, content, worker FROM ent")
_simple("A01_from_text_files", lambda s, d: L.video_summary(L.with_metrics(L.parse_lines(text_lines(s, d)))), "day; video; status; pipeline_error; full_s; reaction",
        f"{_VID} SELECT {_DAY}, video, status, pipeline_error, full_s, reaction FROM vid")


@query("S02_one_day", "WITH " + cte("fx_log") + """, dd AS (SELECT DISTINCT day FROM fx_log), pick AS (SELECT (SELECT min(day) FROM dd) AS a, (SELECT max(day) FROM dd) AS b)
SELECT CAST(day AS VARCHAR) AS day, count(*) AS lines, 1 AS opened, (SELECT count(*) FROM dd) AS files FROM fx_log, pick WHERE day IN (a, b) GROUP BY day""")
def s02d(spark: SparkSession, d: str) -> DataFrame:
    """The first day's lines, from a rotated file, and the newest's, from the running one: each opens its own file alone."""
    from watchlake.plans.fixtures import place_files
    from watchlake.sources.logs import day_lines, log_files
    from watchlake.sources.store import DayStore

    path = DayStore.temporary(spark).path
    lines = view(spark, d, "fx_log")
    newest = lines.agg(F.max("day").alias("newest"))
    name = F.when(F.col("day") == F.col("newest"), "video_processor.log").otherwise(F.concat(F.lit("video_processor_"), F.col("day").cast("string"), F.lit(".log")))
    named = lines.join(F.broadcast(newest)).select(name.alias("name"), "n", "line")
    named.repartition("name").sortWithinPartitions("name", "n").select("name", "line").write.partitionBy("name").text(f"{path}/staged")
    place_files(spark, f"{path}/staged", f"{path}/logs", lambda x: x)
    files = log_files(spark, f"{path}/logs", "video_processor")
    n, first, last = files.agg(F.count("*"), F.min("day"), F.max("day")).first()
    parts = [day_lines(spark, files, day) for day in (first, last)]
    counts = [x.groupBy("day").agg(F.count("*").alias("lines")).withColumn("opened", F.lit(len(x.inputFiles()))) for x in parts]
    return _day(counts[0].unionAll(counts[1])).withColumn("files", F.lit(n))


@query("S03_day_list", _ENT + " SELECT CAST(day AS VARCHAR) AS day, row_number() OVER (ORDER BY day = (SELECT max(day) FROM ent) DESC, day DESC) AS place FROM (SELECT DISTINCT day FROM ent)")
def s03(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    days = written(entries(spark, d).select("day").distinct(), "days")
    newest = days.agg(F.max("day").alias("newest"))
    rows = days.join(F.broadcast(newest))
    place = F.row_number().over(Window.orderBy(F.desc(F.col("day") == F.col("newest")), F.desc("day")))
    return rows.select(F.col("day").cast("string").alias("day"), place.cast("long").alias("place"))


_simple("P01_message_split", entries, "n; video; content; worker", f"{_ENT} SELECT n, video, content, worker FROM ent")
_P2 = "status full_s raw_events md_s gate_dir gate_up gate_down is_new fast saved_frame reaction speed reid_matched reid_best reid_neg reid_delta soc failed".split()
_simple("P02_metric_extraction", metrics, "; ".join(["n", *_P2]), f"{_MET} SELECT n, {_safe(' '.join(_P2))} FROM met")
_STAMP = r"try_strptime(nullif(regexp_extract(video, '(\d{14})', 1), ''), '%Y%m%d%H%M%S')"
_LABELS = _ENT + f""",
lab AS (SELECT n, video, ts, {_STAMP} AS tm, regexp_extract(video, '^(\\d\\d)M(\\d\\d)S', ['a','b']) AS o FROM ent WHERE video IS NOT NULL)"""


def labelled(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).where("video IS NOT NULL")


@query("P03_time_from_path", "WITH " + cte("fx_log") + """, b AS (SELECT event_id AS n, user_id AS u, ts FROM events),
p AS (SELECT n, u, ts, CASE WHEN u % 2 = 0 THEN strftime(ts, '%Y/%m/%d') || '/Cam_00_' || strftime(ts, '%Y%m%d%H%M%S') || '.mp4' WHEN u % 3 = 0 THEN 'x/notes.mp4' ELSE strftime(ts, '%Y%m%d%H') || '/' || strftime(ts, '%MM%SS') || '_1.mp4' END AS path FROM b)
SELECT n, path, CASE WHEN u % 2 = 0 OR u % 3 <> 0 THEN strftime(date_trunc('second', ts), '%Y-%m-%d %H:%M:%S') END AS tm FROM p""")
def p03(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    new = F.concat(F.date_format("ts", "yyyy/MM/dd"), F.lit("/Cam_00_"), F.date_format("ts", "yyyyMMddHHmmss"), F.lit(".mp4"))
    old = F.concat(F.date_format("ts", "yyyyMMddHH"), F.lit("/"), F.date_format("ts", "mm"), F.lit("M"), F.date_format("ts", "ss"), F.lit("S_1.mp4"))
    path = F.when(F.col("user_id") % 2 == 0, new).when(F.col("user_id") % 3 == 0, "x/notes.mp4").otherwise(old)
    rows = e.select(F.col("event_id").alias("n"), path.alias("path"))
    return rows.withColumn("tm", F.date_format(C.time_from_path(F.col("path")), "yyyy-MM-dd HH:mm:ss"))


@query("P04_P06_name_labels", _LABELS + """ SELECT n, CASE WHEN o.a <> '' THEN strftime(ts, '%H') || ':' || o.a ELSE strftime(coalesce(tm, ts), '%H:%M') END AS hhmm,
  strftime(coalesce(tm, ts), '%H:%M:%S') AS hhmmss, CASE WHEN o.a <> '' THEN o.a || 'M' || o.b || 'S' ELSE strftime(coalesce(tm, ts), '%MM%SS') END AS mm_ss FROM lab""")
def p04(spark: SparkSession, d: str) -> DataFrame:
    v, ts = F.col("video"), F.col("ts")
    return labelled(spark, d).select("n", C.hhmm(v, ts).alias("hhmm"), C.hhmmss(v, ts).alias("hhmmss"), C.mm_ss(v, ts).alias("mm_ss"))


@query("P07_minute_of_day", _LABELS + " SELECT n, CAST(hour(coalesce(tm, ts)) * 60 + minute(coalesce(tm, ts)) AS INTEGER) AS minute FROM lab")
def p07(spark: SparkSession, d: str) -> DataFrame:
    return labelled(spark, d).select("n", C.minute_of_day(C.hhmmss(F.col("video"), F.col("ts"))).alias("minute"))


@query("P08_caption_stamp", _ENT + " SELECT n, '_' || strftime(ts, '%H') || 'h' || strftime(ts, '%M') || 'm:_' AS caption FROM ent")
def p08(spark: SparkSession, d: str) -> DataFrame:
    return entries(spark, d).select("n", C.caption_stamp(F.col("ts")).alias("caption"))


_BUTTON = """SELECT event_id AS n, CASE CAST(user_id % 4 AS INT) WHEN 0 THEN concat({fmt}(ts, '{day}'), '/Cam_00_', {fmt}(ts, '{stamp}'), '.mp4') WHEN 1 THEN concat('box', lpad(CAST(user_id % 100 AS STRING), 2, '0'), '/', lpad(CAST(event_id % 60 AS STRING), 2, '0'), 'M09S_1.mp4')
 WHEN 2 THEN concat('x', CAST(user_id AS STRING), 'y/12', lpad(CAST(event_id % 60 AS STRING), 2, '0'), '.mp4') ELSE 'notes.mp4' END AS path FROM """


@query("P08_button_stamp", "WITH b AS (" + _BUTTON.format(fmt="strftime", day="%Y/%m/%d", stamp="%Y%m%d%H%M%S") + """ events)
SELECT n, CASE CAST(user_id % 4 AS INT) WHEN 0 THEN strftime(ts, '%HH%MM') WHEN 1 THEN lpad(CAST(user_id % 100 AS VARCHAR), 2, '0') || 'H' || lpad(CAST(n % 60 AS VARCHAR), 2, '0') || 'M' WHEN 2 THEN '00H12M' ELSE '00H00M' END AS stamp FROM b JOIN events ON n = event_id""")
def p08b(spark: SparkSession, d: str) -> DataFrame:
    sql = _BUTTON.format(fmt="date_format", day="yyyy/MM/dd", stamp="yyyyMMddHHmmss")
    rows = spark.sql(sql + "{events}", events=spark.read.parquet(f"{d}/events.parquet"))
    return rows.select("n", C.button_stamp(F.col("path")).alias("stamp"))


@query("P09_day_filter", _VID + """ SELECT n, CAST(day AS VARCHAR) AS day, video, content FROM met SEMI JOIN (SELECT day, video FROM vid WHERE status IN ('no_person', 'gate_crossing') AND gate_dir IN ('up', 'both')) k USING (day, video)
WHERE level = 'INFO'""")
def p09(spark: SparkSession, d: str) -> DataFrame:
    return _day(L.filter_day(metrics(spark, d), "INFO", ["no_person", "gate_crossing"], "up")).select("n", "day", "video", "content")


@query("P10_video_entries", _ENT + " SELECT n, video, row_number() OVER (PARTITION BY day, video ORDER BY n) AS pos FROM ent WHERE video IS NOT NULL AND level = 'ERROR'")
def p10(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    w = Window.partitionBy("day", "video").orderBy("n")
    return labelled(spark, d).where("level = 'ERROR'").select("n", "video", F.row_number().over(w).cast("long").alias("pos"))


# ---- per video
for name, cols in {
    "A01_final_status": "status", "A02_pipeline_error": "pipeline_error", "A03_full_time": "full_s", "A04_motion_time": "md_s", "A05_raw_events": "raw_events",
    "A07_flags": "fast worker has_frames", "A08_reaction_state": "reaction", "A09_reid_fields": "reid_best reid_neg reid_delta reid_matched",
    "A10_top_speed": "top_speed", "A11_gate_fields": "gate_dir gate_up gate_down",
}.items():
    _simple(name, videos, "; ".join(["day", "video", *cols.split()]), f"{_VID} SELECT {_DAY}, video, {_safe(cols)} FROM vid")
_simple("A08_reaction_lists", lambda s, d: L.reaction_lists(videos(s, d)), "day; reaction; CAST(place AS BIGINT) AS place; video",
        f"{_VID} SELECT {_DAY}, reaction, row_number() OVER (PARTITION BY day, reaction ORDER BY video) AS place, video FROM vid WHERE reaction IS NOT NULL")
_simple("A06_first_seen", videos, "day; video; date_format(first_seen, 'yyyy-MM-dd HH:mm:ss') AS first_seen", f"{_VID} SELECT {_DAY}, video, {_ST.format('first_seen')} AS first_seen FROM vid")
_simple("A15_processing_time", videos, "day; video; processing_s", f"{_VID} SELECT {_DAY}, video, coalesce(md_s, full_s) AS processing_s FROM vid")
_simple("ST10_last_run_wins", videos, "day; video; gate_dir; CAST(gate_up + gate_down AS DOUBLE) AS persons", f"{_VID} SELECT {_DAY}, video, gate_dir, CAST(gate_up + gate_down AS DOUBLE) AS persons FROM vid")
_simple("J03_video_row", lambda s, d: videos(s, d).where("status IS NOT NULL OR processing_s IS NOT NULL"),
        "day; video; status; round(processing_s, 2) AS processing_s; round(reid_best, 3) AS reid_best; fast; worker; gate_dir; top_speed",
        f"{_VID} SELECT {_DAY}, video, status, round(coalesce(md_s, full_s), 2) AS processing_s, round(reid_best, 3) AS reid_best, fast, worker, gate_dir, CAST(top_speed AS DOUBLE) AS top_speed FROM vid WHERE status IS NOT NULL OR md_s IS NOT NULL OR full_s IS NOT NULL")
_simple("X01_key_union", lambda s, d: videos(s, d).where("status IS NOT NULL OR full_s IS NOT NULL OR md_s IS NOT NULL OR first_seen IS NOT NULL"), "day; video",
        f"{_VID} SELECT {_DAY}, video FROM vid WHERE status IS NOT NULL UNION SELECT {_DAY}, video FROM vid WHERE full_s IS NOT NULL UNION SELECT {_DAY}, video FROM vid WHERE md_s IS NOT NULL UNION SELECT {_DAY}, video FROM vid WHERE first_seen IS NOT NULL")


@query("J01_drop_removed", _MET + " SELECT n, CAST(day AS VARCHAR) AS day, video FROM met WHERE video IS NOT NULL AND (day, video) NOT IN (SELECT (day, video) FROM met WHERE reaction = 'remove' AND video IS NOT NULL)")
def j01(spark: SparkSession, d: str) -> DataFrame:
    m = written(metrics(spark, d).where("video IS NOT NULL").select("n", "day", "video", "removed"), "metrics")
    return _day(m.join(m.where("removed").select("day", "video"), ["day", "video"], "left_anti")).select("n", "day", "video")


@query("J02_allowed_videos", _VID + " SELECT n, CAST(day AS VARCHAR) AS day, video FROM met WHERE (day, video) IN (SELECT (day, video) FROM vid WHERE gate_dir IN ('down', 'both'))")
def j02(spark: SparkSession, d: str) -> DataFrame:
    return _day(L.filter_day(metrics(spark, d), gate="down")).select("n", "day", "video")


@query("T01_video_order", _VID + " SELECT CAST(day AS VARCHAR) AS day, video, row_number() OVER (PARTITION BY day ORDER BY first_seen NULLS FIRST, video) AS place FROM vid")
def t01(spark: SparkSession, d: str) -> DataFrame:
    return _day(L.ordered_videos(videos(spark, d))).select("day", "video", F.col("place").cast("long").alias("place"))


# ---- per day
_COUNTED = "(status IS NOT NULL OR full_s IS NOT NULL OR raw_events IS NOT NULL)"
_GATE = "gate AS (SELECT day, gate_dir FROM vid UNION ALL SELECT day, gate_dir FROM met WHERE video IS NULL)"


@query("A12_gate_counts", f"{_VID}, {_GATE} SELECT {_DAY}, count(*) FILTER (WHERE gate_dir IN ('up','both')) AS up, count(*) FILTER (WHERE gate_dir IN ('down','both')) AS down FROM gate GROUP BY day")
def a12(spark: SparkSession, d: str) -> DataFrame:
    return _day(L.gate_counts(metrics(spark, d)))


@query("A13_status_counts", f"{_VID} SELECT {_DAY}, status, count(*) AS videos FROM vid WHERE status IS NOT NULL GROUP BY day, status")
def a13(spark: SparkSession, d: str) -> DataFrame:
    return _day(videos(spark, d).where("status IS NOT NULL").groupBy("day", "status").agg(F.count("*").alias("videos")))


_MDALL = "mdall AS (SELECT day, md_s FROM vid WHERE md_s IS NOT NULL UNION ALL SELECT day, md_s FROM met WHERE video IS NULL AND md_s IS NOT NULL)"
_DAYS = f"""{_VID}, {_GATE}, {_MDALL},
ds AS (SELECT d.day, coalesce(v.n, 0) AS videos_total, md_min, md_max, md_avg, full_min, full_max, full_avg, coalesce(up, 0) AS up, coalesce(down, 0) AS down
 FROM (SELECT DISTINCT day FROM met) d LEFT JOIN (SELECT day, count(*) AS n FROM vid WHERE {_COUNTED} GROUP BY day) v USING (day)
 LEFT JOIN (SELECT day, min(md_s) AS md_min, max(md_s) AS md_max, avg(least(md_s, 300)) AS md_avg FROM mdall GROUP BY day) m USING (day)
 LEFT JOIN (SELECT day, min(full_s) AS full_min, max(full_s) AS full_max, avg(least(full_s, 300)) AS full_avg FROM vid WHERE full_s IS NOT NULL GROUP BY day) f USING (day)
 LEFT JOIN (SELECT day, count(*) FILTER (WHERE gate_dir IN ('up','both')) AS up, count(*) FILTER (WHERE gate_dir IN ('down','both')) AS down FROM gate GROUP BY day) g USING (day))"""
_S6 = "round(md_min, 6) AS md_min; round(md_max, 6) AS md_max; round(md_avg, 6) AS md_avg; round(full_min, 6) AS full_min; round(full_max, 6) AS full_max; round(full_avg, 6) AS full_avg"


def stats(spark: SparkSession, d: str) -> DataFrame:
    return L.day_statistics(metrics(spark, d))


_simple("A14_time_stats", stats, "day; " + _S6, f"{_DAYS} SELECT {_DAY}, {_S6.replace(';', ',')} FROM ds")
_simple("A16_videos_total", stats, "day; videos_total", f"{_DAYS} SELECT {_DAY}, videos_total FROM ds")
_ENTRY = f"""{_VID}, k AS (SELECT day, status, count(*) AS c FROM vid WHERE status IS NOT NULL GROUP BY day, status),
t AS (SELECT day, count(*) FILTER (WHERE {_COUNTED}) AS videos_total, count(status) AS known, avg(least(md_s, 300)) FILTER (WHERE md_s IS NOT NULL) AS md_avg, avg(least(full_s, 300)) FILTER (WHERE full_s IS NOT NULL) AS full_avg FROM vid GROUP BY day),
u AS (SELECT * FROM k UNION ALL SELECT day, 'unknown', videos_total - known FROM t WHERE videos_total > known)
SELECT {_DAY}, videos_total, round(md_avg, 6) AS md_avg, round(full_avg, 6) AS full_avg, status, coalesce(c, 0) AS videos FROM t LEFT JOIN u USING (day)"""


@query("A17_day_entry", _ENTRY)
def a17(spark: SparkSession, d: str) -> DataFrame:
    rows = L.day_entries(videos(spark, d)).select("day", "videos_total", F.round("md_avg", 6).alias("md_avg"), F.round("full_avg", 6).alias("full_avg"), F.explode_outer("status_counts").alias("status", "videos"))
    return _day(rows).fillna(0, ["videos"])


@query("X02_cached_and_today", _ENTRY)
def x02(spark: SparkSession, d: str) -> DataFrame:
    """Closed days from a written store, the newest computed again."""
    from watchlake.sources.store import DayStore

    rows = L.day_entries(videos(spark, d))
    store = DayStore.temporary(spark)
    newest = rows.agg(F.max("day")).first()[0]
    store.write(rows.where(F.col("day") < F.lit(newest)))
    both = store.read().unionByName(rows.where(F.col("day") == F.lit(newest)))
    return _day(both.select("day", "videos_total", F.round("md_avg", 6).alias("md_avg"), F.round("full_avg", 6).alias("full_avg"), F.explode_outer("status_counts").alias("status", "videos"))).fillna(0, ["videos"])


@query("S04_day_store", f"{_VID} SELECT {_DAY}, count(*) FILTER (WHERE {_COUNTED}) AS videos_total FROM vid WHERE day >= (SELECT max(day) FROM vid) - 20 GROUP BY day")
def s04(spark: SparkSession, d: str) -> DataFrame:
    from watchlake.sources.store import DayStore

    store = DayStore.temporary(spark, keep_days=20)
    rows = L.day_entries(videos(spark, d))
    store.write(rows)
    store.write(rows.where(F.dayofmonth("day") == 5))  # a day that is written again is replaced
    return _day(store.read()).select("day", "videos_total")


@query("A23_status_order", _VID + """ , s AS (SELECT DISTINCT status FROM vid WHERE status IS NOT NULL UNION ALL SELECT 'unknown' UNION ALL SELECT 'archived'),
o AS (SELECT status, list_position(['no_motion','no_significant_motion','no_person','significant_motion','gate_crossing','error'], status) AS rk FROM s)
SELECT status, row_number() OVER (ORDER BY CASE WHEN status = 'unknown' THEN 2 WHEN rk > 0 THEN 0 ELSE 1 END, rk, status) AS place FROM o""")
def a23(spark: SparkSession, d: str) -> DataFrame:
    found = videos(spark, d).where("status IS NOT NULL").select("status")
    more = spark.sql("SELECT explode(array('unknown', 'archived')) AS status")
    return L.status_order(found.unionAll(more)).select("status", F.col("place").cast("long").alias("place"))


# ---- presence
_PTS = _MET + f""",
pts AS (SELECT day, n, video, reaction AS type, ts, strftime(coalesce({_STAMP}, ts), '%H:%M:%S') AS hhmmss,
 CAST(hour(coalesce({_STAMP}, ts)) * 60 + minute(coalesce({_STAMP}, ts)) AS INTEGER) AS minute FROM met
 WHERE reaction IN ('away', 'back') AND video IS NOT NULL AND (day, video) NOT IN (SELECT (day, video) FROM met WHERE reaction = 'remove' AND video IS NOT NULL))"""


def pts(spark: SparkSession, d: str) -> DataFrame:
    return P.points(metrics(spark, d))


_simple("ST01_away_back_points", pts, "day; n; video; type; hhmmss; minute", f"{_PTS} SELECT {_DAY}, n, video, type, hhmmss, minute FROM pts")
_EV = _MET + f""",
ev0 AS (SELECT day, n, video, ts, reaction AS type, CASE WHEN regexp_matches(video, '^\\d\\dM\\d\\dS') THEN strftime(ts, '%H') || ':' || video[1:2] ELSE strftime(coalesce({_STAMP}, ts), '%H:%M') END AS label FROM met WHERE reaction IS NOT NULL AND video IS NOT NULL),
ev1 AS (SELECT *, CAST(label[1:2] AS INTEGER) * 60 + CAST(label[4:5] AS INTEGER) AS minute FROM ev0),
ev2 AS (SELECT *, last_value(type) OVER w AS last_type, max(minute) FILTER (WHERE type = 'remove') OVER (PARTITION BY day, video) AS gone FROM ev1
  WINDOW w AS (PARTITION BY day, video ORDER BY minute, ts, n ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING)),
ev3 AS (SELECT *, lead(type) OVER (PARTITION BY day, video ORDER BY minute, ts, n) AS nxt FROM ev2 WHERE last_type <> 'remove' AND type <> 'remove' AND (gone IS NULL OR minute > gone)),
ev AS (SELECT day, n, video, ts, type, label, minute FROM ev3 WHERE nxt IS DISTINCT FROM type)"""
_simple("W16_collapse_runs", lambda s, d: P.interval_events(metrics(s, d)), "day; n; video; type; label; minute", f"{_EV} SELECT {_DAY}, n, video, type, label, minute FROM ev")


_AWAY = _EV.replace("WITH ", "WITH RECURSIVE ", 1) + f""",
seq AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY minute, ts, n) AS i, type, label, minute FROM ev),
f AS (SELECT day, CAST(0 AS BIGINT) AS i, CAST([] AS STRUCT(m INTEGER, l VARCHAR)[]) AS s, CAST(NULL AS STRUCT(a VARCHAR, b VARCHAR)) AS o FROM (SELECT DISTINCT day FROM seq)
 UNION ALL SELECT f.day, q.i, CASE WHEN q.type = 'away' THEN list_append(f.s, {{'m': q.minute, 'l': q.label}}) WHEN len(f.s) > 0 AND f.s[-1].m < q.minute THEN f.s[1:-2] ELSE f.s END,
  CASE WHEN q.type = 'back' AND len(f.s) = 0 THEN {{'a': CAST(NULL AS VARCHAR), 'b': q.label}} WHEN q.type = 'back' AND f.s[-1].m < q.minute THEN {{'a': f.s[-1].l, 'b': q.label}} END
  FROM f JOIN seq q ON q.day = f.day AND q.i = f.i + 1),
closed AS (SELECT day, i AS k, o.a AS start, o.b AS fin FROM f WHERE o IS NOT NULL),
left_ AS (SELECT day, 1000000000 + j AS k, s[j].l AS start, CAST(NULL AS VARCHAR) AS fin FROM (SELECT day, arg_max(s, i) AS s FROM f GROUP BY day), LATERAL (SELECT unnest(range(1, len(s) + 1)) AS j)),
al AS (SELECT *, CAST(start[1:2] AS INTEGER) * 60 + CAST(start[4:5] AS INTEGER) AS a, CAST(fin[1:2] AS INTEGER) * 60 + CAST(fin[4:5] AS INTEGER) AS b FROM (SELECT * FROM closed UNION ALL SELECT * FROM left_)),
iv AS (SELECT day, row_number() OVER (PARTITION BY day ORDER BY coalesce(a, b), k) AS pos, start, fin,
 CASE WHEN a IS NOT NULL AND b IS NOT NULL THEN CASE WHEN b - a >= 60 THEN CAST((b - a) // 60 AS VARCHAR) || 'h' ELSE '' END || CASE WHEN (b - a) % 60 > 0 OR b - a < 60 THEN CAST((b - a) % 60 AS VARCHAR) || 'm' ELSE '' END END AS dur FROM al)"""


@query("ST05_away_intervals", f'{_AWAY} SELECT {_DAY}, pos, start, fin AS "end", dur FROM iv')
def st05(spark: SparkSession, d: str) -> DataFrame:
    return _day(P.intervals(P.interval_events(metrics(spark, d)))).withColumn("pos", F.col("pos").cast("long"))


_CHART = f"""ch AS (SELECT day, count(*) AS chart_rows, md5(string_agg(concat_ws('|', video, coalesce(strftime(coalesce({_STAMP}, first_seen), '%H:%M:%S'), ''), CAST(round(coalesce(md_s, full_s), 2) AS VARCHAR), coalesce(status, '')), ';' ORDER BY first_seen NULLS FIRST, video)) AS chart
  FROM vid WHERE md_s IS NOT NULL OR full_s IS NOT NULL GROUP BY day),
sk AS (SELECT day, status, count(*) AS c FROM vid WHERE status IS NOT NULL GROUP BY day, status UNION ALL SELECT * FROM (SELECT day, 'unknown', count(*) FILTER (WHERE {_COUNTED}) - count(status) AS c FROM vid GROUP BY day) WHERE c > 0),
sc AS (SELECT day, string_agg(status || '=' || CAST(c AS VARCHAR), ',' ORDER BY status) AS statuses FROM sk GROUP BY day),
aw AS (SELECT day, string_agg(coalesce(start, '') || '-' || coalesce(fin, '') || '=' || coalesce(dur, ''), ',' ORDER BY pos) AS away FROM iv GROUP BY day)"""
_BUNDLE = f"{_AWAY}{_DAYS[len(_MET):]}, {_CHART} SELECT {_DAY}, videos_total, up, down, {_S6.replace(';', ',')}, statuses, chart_rows, chart, away FROM ds LEFT JOIN ch USING (day) LEFT JOIN sc USING (day) LEFT JOIN aw USING (day)"


@query("A18_day_bundle", _BUNDLE)
def a18(spark: SparkSession, d: str) -> DataFrame:
    b = L.day_bundle(metrics(spark, d))
    text = lambda c: F.coalesce(c, F.lit(""))
    row = lambda x: F.concat_ws("|", x["video"], text(x["time"]), x["seconds"].cast("string"), text(x["status"]))
    pair = lambda x: F.concat(text(x["start"]), F.lit("-"), text(x["end"]), F.lit("="), text(x["dur"]))
    count = lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))
    return _day(b).select(
        "day", "videos_total", "up", "down", *(F.round(c, 6).alias(c) for c in ("md_min", "md_max", "md_avg", "full_min", "full_max", "full_avg")),
        F.array_join(F.array_sort(F.transform(F.map_entries("status_counts"), count)), ",").alias("statuses"), F.size("chart").cast("long").alias("chart_rows"),
        F.md5(F.array_join(F.transform("chart", row), ";")).alias("chart"), F.array_join(F.transform("intervals", pair), ",").alias("away"),
    )


def _heat_sql(minutes: int, bins: int) -> str:
    return f"""{_PTS}, h AS (SELECT (minute - 360) // {minutes} AS bin, day, type FROM pts WHERE minute BETWEEN 360 AND 1439),
hb AS (SELECT bin, count(DISTINCT day) AS any_days, count(DISTINCT day) FILTER (WHERE type = 'away') AS away_days, count(DISTINCT day) FILTER (WHERE type = 'back') AS back_days FROM h GROUP BY bin),
grid AS (SELECT i AS bin, coalesce(any_days, 0) AS any_days, coalesce(away_days, 0) AS away_days, coalesce(back_days, 0) AS back_days FROM range({bins}) r(i) LEFT JOIN hb ON hb.bin = i)"""


_simple_day = lambda name, f, sql: query(name, sql)(f)
_simple_day("A19_heatmap_15min", lambda s, d: P.heatmap(pts(s, d)), _heat_sql(15, 72) + " SELECT * FROM grid")
_simple_day("A20_heatmap_hourly", lambda s, d: P.heatmap(pts(s, d), 60, 360, 18), _heat_sql(60, 18) + " SELECT * FROM grid")
_simple_day("A20_heatmap_maxima", lambda s, d: P.maxima(P.heatmap(pts(s, d), 60, 360, 18), "any_days", "away_days", "back_days"),
            _heat_sql(60, 18) + " SELECT max(any_days) AS max_any_days, max(away_days) AS max_away_days, max(back_days) AS max_back_days FROM grid")
_WEEK = _PTS + """, ld AS (SELECT isodow(day) - 1 AS weekday, count(*) AS log_days FROM (SELECT DISTINCT day FROM met) GROUP BY 1),
wd AS (SELECT isodow(day) - 1 AS weekday, minute // 60 AS hour, count(DISTINCT day) AS days FROM pts GROUP BY 1, 2)
SELECT CAST(w.i AS INTEGER) AS weekday, h.i AS hour, coalesce(days, 0) AS days, coalesce(log_days, 0) AS log_days, round(coalesce(days / nullif(log_days, 0), 0), 6) AS share
FROM range(7) w(i) CROSS JOIN range(6, 24) h(i) LEFT JOIN ld ON ld.weekday = w.i LEFT JOIN wd ON wd.weekday = w.i AND wd.hour = h.i"""


@query("A21_weekday_heatmap", _WEEK)
def a21(spark: SparkSession, d: str) -> DataFrame:
    m = reactions(spark, d)
    return P.weekday_heatmap(P.points(m), m.select("day")).withColumn("share", F.round("share", 6)).select("weekday", "hour", "days", "log_days", "share")


@query("A21_weekday_maximum", f"SELECT max(share) AS max_share FROM ({_WEEK})")
def a21m(spark: SparkSession, d: str) -> DataFrame:
    return P.maxima(a21(spark, d), "share")


@query("A22_cell_share", _heat_sql(60, 18) + ", nd AS (SELECT count(DISTINCT day) AS n FROM met) SELECT bin, round(100.0 * any_days / n, 6) AS percent, round(any_days / max(any_days) OVER (), 6) AS of_max FROM grid, nd")
def a22(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    m = reactions(spark, d)
    n = m.agg(F.count_distinct("day").alias("n"))
    grid = P.heatmap(P.points(m), 60, 360, 18).join(F.broadcast(n))
    every = F.max("any_days").over(Window.partitionBy())
    return grid.select("bin", F.round(100 * F.col("any_days") / F.col("n"), 6).alias("percent"), F.round(F.col("any_days") / every, 6).alias("of_max"))


@query("ST06_current_state", f"{_PTS} SELECT {_DAY}, arg_max(type, (minute, ts, n)) AS state, max(minute) AS at_minute, count(*) AS events FROM pts WHERE minute >= 600 GROUP BY day")
def st06(spark: SparkSession, d: str) -> DataFrame:
    since = C.flexible_time(F.lit("10:00"), F.col("day"))
    rows = pts(spark, d).where(F.col("minute") >= F.hour(since) * 60 + F.minute(since))
    return _day(P.current_state(rows))


@query("SC1_SC4_helpers", _ENT + """ SELECT n, CASE WHEN hour(ts) > 0 THEN CAST(hour(ts) AS VARCHAR) || 'h' ELSE '' END || CASE WHEN minute(ts) > 0 OR hour(ts) = 0 THEN CAST(minute(ts) AS VARCHAR) || 'm' ELSE '' END AS dur,
  strftime(CASE n % 3 WHEN 2 THEN date_trunc('minute', ts) ELSE ts END, '%Y-%m-%d %H:%M:%S') AS since FROM ent""")
def sc(spark: SparkSession, d: str) -> DataFrame:
    e = entries(spark, d)
    form = F.when(F.col("n") % 3 == 0, F.date_format("ts", "yyyy-MM-dd HH:mm:ss")).when(F.col("n") % 3 == 1, F.date_format("ts", "HH:mm:ss")).otherwise(F.date_format("ts", "HH:mm"))
    return e.select("n", C.duration_text(F.hour("ts") * 60 + F.minute("ts")).alias("dur"), F.date_format(C.flexible_time(form, F.col("day")), "yyyy-MM-dd HH:mm:ss").alias("since"))
