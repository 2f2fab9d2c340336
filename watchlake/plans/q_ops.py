"""Queries of pipeline-state and media analytics. "Now" is 1998-08-02 in the file listing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.functions.ranks import numbered
from watchlake.operators import media as M
from watchlake.operators import ops as O
from watchlake.operators.graph import written
from watchlake.plans import q_logs
from watchlake.plans.fixtures import cte, view
from watchlake.plans.registry import query
from watchlake.sources import configs, listing, store, tree

_VID_DONE = q_logs._MET + ", k AS (SELECT *, contains(content, 'Motion detection complete. Status:') AS done FROM met WHERE video IS NOT NULL)"
GALLERY_SQL = "SELECT '2024/Cam_' || CAST(o_orderkey AS VARCHAR) || '_reid_best0.jpg' AS path, o_custkey % 3 = 0 AS present FROM orders"
_LED = "WITH " + cte("fx_ledger")
_STATE = _LED + """, st AS (SELECT path, CASE WHEN bool_or(status = 'completed') THEN 'completed' WHEN arg_max(status, seq) <> 'queued' THEN arg_max(status, seq)
 WHEN arg_max(status, seq) FILTER (WHERE status <> 'queued') = 'started' THEN 'started' ELSE 'queued' END AS status, max(seq) FILTER (WHERE status = 'completed') AS end_ts, max(seq) FILTER (WHERE status = 'started') AS start_ts FROM fx_ledger GROUP BY path)"""


def ledger_rows(spark: SparkSession, d: str) -> DataFrame:
    u = view(spark, d, "fx_ledger")
    return u.withColumns({"end_ts": F.when(F.col("status") == "completed", F.col("seq")), "start_ts": F.when(F.col("status") == "started", F.col("seq"))})


def ledger(spark: SparkSession, d: str) -> DataFrame:
    return O.ledger_state(ledger_rows(spark, d), ("end_ts", "start_ts"))


@query("ST02_ledger_state", _STATE + " SELECT path, status, CAST(end_ts AS DOUBLE) AS end_ts, CAST(start_ts AS DOUBLE) AS start_ts FROM st")
def st02(spark: SparkSession, d: str) -> DataFrame:
    return ledger(spark, d).select("path", "status", F.col("end_ts").cast("double").alias("end_ts"), F.col("start_ts").cast("double").alias("start_ts"))


@query("T02_recent_rows", _STATE + " SELECT path, status, CAST(coalesce(end_ts, start_ts) AS DOUBLE) AS ts FROM st ORDER BY coalesce(end_ts, start_ts) DESC NULLS LAST, path LIMIT 10")
def t02(spark: SparkSession, d: str) -> DataFrame:
    rows = O.most_recent(ledger(spark, d).withColumn("detected_ts", F.lit(0.0)))
    return rows.select("path", "status", F.col("at").alias("ts"))


@query("T03_keep_latest", _STATE + " SELECT path FROM st ORDER BY coalesce(end_ts, start_ts) DESC NULLS LAST, path LIMIT 100")
def t03(spark: SparkSession, d: str) -> DataFrame:
    return O.keep_latest(ledger(spark, d), 100, F.desc_nulls_last(F.coalesce("end_ts", "start_ts")), F.col("path")).select("path")


@query("T03_message_map", """SELECT 'many' AS kind, path, seq FROM (SELECT o_custkey AS path, o_orderkey AS seq FROM orders ORDER BY seq DESC LIMIT 200)
UNION ALL SELECT 'few', o_custkey, o_orderkey FROM orders WHERE o_orderkey <= 399""")
def t03m(spark: SparkSession, d: str) -> DataFrame:
    """A map that has grown beyond 400 entries, and one that hasn't."""
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("seq"))
    parts = [O.pruned_messages(x).withColumn("kind", F.lit(k)) for k, x in (("many", rows), ("few", rows.where("seq <= 399")))]
    return parts[0].unionByName(parts[1])


@query("T03_rotated_logs", """WITH f AS (SELECT DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'logs/video_processor_' || strftime(o_orderdate, '%Y-%m-%d') || '.log' WHEN 1 THEN 'logs/video_processor.log.' || strftime(o_orderdate, '%Y-%m-%d')
 END AS path, CAST(o_orderdate AS DATE) AS mtime FROM orders WHERE o_orderkey % 4 < 2) SELECT path FROM f ORDER BY mtime DESC, path DESC OFFSET 60""")
def t03r(spark: SparkSession, d: str) -> DataFrame:
    """Rotated logs of both names beyond the 60 newest; the running log and other logs are never among them."""
    day, k = F.date_format("o_orderdate", "yyyy-MM-dd"), F.col("o_orderkey") % 4
    name = F.when(k == 0, F.concat(F.lit("video_processor_"), day, F.lit(".log"))).when(k == 1, F.concat(F.lit("video_processor.log."), day)).when(k == 2, F.concat(F.lit("other_"), day, F.lit(".log"))).otherwise("video_processor.log")
    rows = spark.read.parquet(f"{d}/orders.parquet").select(F.concat(F.lit("logs/"), name).alias("path"), F.to_date("o_orderdate").alias("mtime")).distinct()
    return O.rotated_to_delete(rows, "video_processor.log").select("path")


_FILES = _STATE + ", fl AS (SELECT DISTINCT o_custkey AS path, min(CAST(o_orderdate AS DATE)) AS mday FROM orders WHERE o_orderkey % 3 <> 0 GROUP BY o_custkey)"


def files(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").where("o_orderkey % 3 <> 0")
    return o.groupBy(F.col("o_custkey").alias("path")).agg(F.min(F.to_date("o_orderdate")).alias("mday"))


@query("J10_pending_files", _FILES + " SELECT path, 'pending' AS kind FROM fl WHERE path NOT IN (SELECT path FROM st WHERE status = 'completed') UNION ALL SELECT path, 'on_disk' FROM st WHERE path IN (SELECT path FROM fl)")
def j10(spark: SparkSession, d: str) -> DataFrame:
    f, led = files(spark, d), ledger(spark, d)
    a = O.pending(f, led).select("path", F.lit("pending").alias("kind"))
    return a.unionByName(O.on_disk(led, f).select("path", F.lit("on_disk").alias("kind")))


_LIST = "WITH " + cte("fx_listing")


def media(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_listing")


@query("X03_recovery_candidates", _LIST + """, c AS (SELECT path, id, mday, 0 AS src FROM fx_listing WHERE id % 5 = 0 UNION ALL SELECT path, id + 1, mday, 1 FROM fx_listing WHERE id % 3 = 0 UNION ALL SELECT path, id + 3, mday, 3 FROM fx_listing WHERE id % 7 = 0),
o AS (SELECT path, id + 2 AS id, 2 AS src FROM fx_listing WHERE id % 2 = 0 UNION ALL SELECT path, id + 3, 3 FROM fx_listing WHERE id % 7 = 0)
SELECT 'files' AS window, path, arg_min(id, src) AS ts FROM c GROUP BY path UNION ALL SELECT 'quiet', path, id + 3 FROM fx_listing WHERE id % 7 = 0 UNION ALL SELECT 'other layout', path, arg_min(id, src) FROM o GROUP BY path""")
def x03(spark: SparkSession, d: str) -> DataFrame:
    """A window with files; a quiet one, whose day folder is there; and one without day folders, where the fallback counts."""
    m = media(spark, d)
    part = lambda k, add: m.where(F.col("id") % k == 0).select("path", (F.col("id") + add).alias("at"))
    none, day = part(5, 0).where("false"), m.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path"))
    cases = {"files": (part(5, 0), part(3, 1), day), "quiet": (none, none, day), "other layout": (none, none, day.where("false"))}
    found = [O.recovery_candidates(*x, part(2, 2), part(7, 3)).select(F.lit(k).alias("window"), "path", F.col("at").alias("ts")) for k, x in cases.items()]
    return found[0].unionAll(found[1]).unionAll(found[2])


@query("ST09_recovery_sources", _LIST + """, f AS (SELECT 'r/' || path AS path, CAST(mday AS TIMESTAMP) AS t, CAST(mday AS TIMESTAMP) AS folder, id % 17 = 0 AS done FROM fx_listing
UNION ALL SELECT 'r/' || strftime(mday, '%Y%m%d') || '08/x' || CAST(id AS VARCHAR) || '.mp4', CAST(mday AS TIMESTAMP), CAST(mday AS TIMESTAMP) + INTERVAL 8 HOUR, false FROM fx_listing WHERE id % 4 = 0)
SELECT DISTINCT path FROM f WHERE NOT done AND t >= TIMESTAMP '1997-06-01 00:00:00' - INTERVAL 180 SECOND AND t <= TIMESTAMP '1998-08-02 00:00:00' AND folder <= TIMESTAMP '1998-08-02 00:00:00'""")
def st09s(spark: SparkSession, d: str) -> DataFrame:
    """From a directory tree with day and hour folders, files that aren't clips, and a ledger, to the work list."""
    m, at = media(spark, d), F.col("mday").cast("timestamp")
    clips = m.select(F.concat(F.lit("r/"), "path").alias("path"), at.alias("mtime"), "id")
    hours = m.where("id % 4 = 0").select(F.concat(F.lit("r/"), F.date_format("mday", "yyyyMMdd"), F.lit("08/x"), F.col("id").cast("string"), F.lit(".mp4")).alias("path"), at.alias("mtime"))
    notes = m.where("id % 3 = 0").select(F.concat(F.lit("r/"), "path", F.lit(".txt")).alias("path"), at.alias("mtime"))
    files_ = clips.select("path", "mtime").unionAll(hours).unionAll(notes).withColumn("is_dir", F.lit(False))
    dirs = files_.select(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path")).distinct().select("path", F.lit(None).cast("timestamp").alias("mtime"), F.lit(True).alias("is_dir"))
    led = clips.where("id % 17 = 0 OR id % 19 = 0").select("path", F.when(F.col("id") % 17 == 0, "completed").otherwise("started").alias("status"), F.col("mtime").alias("at"))
    since, now = (F.lit(x).cast("timestamp") for x in ("1997-06-01 00:00:00", "1998-08-02 00:00:00"))
    found = O.recovery_candidates(*O.recovery_sources(files_.unionByName(dirs), "r", led, since, now))
    return O.recovery_list(found, led, since, now).select("path")


@query("ST09_recovery_list", _LIST + """ SELECT path FROM fx_listing WHERE CAST(mday AS TIMESTAMP) >= TIMESTAMP '1997-06-01 00:00:00' - INTERVAL 180 SECOND AND mday <= DATE '1998-08-02' AND id % 17 <> 0""")
def st09(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d).select("path", F.col("mday").cast("timestamp").alias("at"), "id")
    done = m.where("id % 17 = 0").select("path", F.lit("completed").alias("status"))
    return O.recovery_list(m, done, F.lit("1997-06-01 00:00:00").cast("timestamp"), F.lit("1998-08-02 00:00:00").cast("timestamp")).select("path")


@query("T08_work_list_order", _LIST + " SELECT path, row_number() OVER (ORDER BY mday, path) AS pos FROM fx_listing")
def t08(spark: SparkSession, d: str) -> DataFrame:
    return numbered(media(spark, d), "pos", F.col("mday"), F.col("path")).select("path", "pos")


@query("X05_day_folders", "SELECT strftime(o_orderdate, '%Y%m%d') AS folder FROM orders WHERE o_orderkey % 3 <> 0 AND CAST(o_orderdate AS DATE) < DATE '1998-08-02' - 600")
def x05d(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    name = F.when(F.col("o_orderkey") % 3 == 0, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyyMMdd"))
    return O.expired_days(o.select(name.alias("folder")), F.lit("1998-08-02").cast("date"), 600)


@query("X05_retention", _LIST + """, f AS (SELECT DISTINCT path[1:10] AS folder FROM fx_listing) SELECT path AS name, 'video' AS kind FROM fx_listing WHERE mday < DATE '1998-08-02' - 900
UNION ALL SELECT folder, 'folder' FROM f WHERE folder NOT IN (SELECT path[1:10] FROM fx_listing WHERE mday >= DATE '1998-08-02' - 900)""")
def x05(spark: SparkSession, d: str) -> DataFrame:
    m = media(spark, d)
    old = O.expired(m, F.lit("1998-08-02").cast("date"), 900)
    left = m.join(old.select("path"), "path", "left_anti")
    empty = O.empty_folders(_folders(m), left)
    return old.select(F.col("path").alias("name"), F.lit("video").alias("kind")).unionAll(empty.select("path", F.lit("folder")))


def _folders(files_: DataFrame) -> DataFrame:
    """Day, month and year folders of the listing."""
    return files_.select(F.explode(F.array(*(F.substring("path", 1, k) for k in (4, 7, 10)))).alias("path")).distinct()


@query("X05_fileless_folders", _LIST + """, f AS (SELECT DISTINCT path[1:k] AS path FROM fx_listing, (VALUES (4), (7), (10)) v(k))
SELECT path FROM f WHERE NOT EXISTS (SELECT 1 FROM fx_listing l WHERE starts_with(l.path, f.path) AND l.mday >= DATE '1995-07-01')""")
def x05f(spark: SparkSession, d: str) -> DataFrame:
    """Years, months and days that hold nothing any more once old files are gone."""
    m = media(spark, d)
    return O.fileless_folders(_folders(m), m.where("mday >= DATE '1995-07-01'"))


@query("X05_directory_tree", """SELECT 'a=' || CAST(o_custkey % 3 AS VARCHAR) AS path, 'folder' AS kind, 0 AS files FROM orders GROUP BY 1
UNION ALL SELECT 'a=' || CAST(o_custkey % 3 AS VARCHAR) || '/b=' || CAST(o_orderkey % 5 AS VARCHAR), 'folder', 1 FROM orders GROUP BY 1""")
def x05t(spark: SparkSession, d: str) -> DataFrame:
    """Folders that Spark has written, listed from their root down, with the data files that lie in each."""
    root = store.DayStore.temporary(spark).path
    o = spark.read.parquet(f"{d}/orders.parquet").select((F.col("o_custkey") % 3).alias("a"), (F.col("o_orderkey") % 5).alias("b"), "o_orderkey")
    o.repartition("a", "b").write.partitionBy("a", "b").parquet(root)
    found = tree.list_tree(spark, root).withColumn("path", F.substring("path", len(root) + 2, 1 << 20))
    held = tree.files(found).where("path LIKE '%/part-%'").groupBy(F.regexp_extract("path", "^(.*)/[^/]*$", 1).alias("path")).agg(F.count("*").cast("int").alias("files"))
    return tree.folders(found).join(held, "path", "left").select("path", F.lit("folder").alias("kind"), F.coalesce("files", F.lit(0)).alias("files"))


@query("S07_daily_files", _LIST + ", p AS (SELECT strftime(mday, '%Y%m%d') AS day, id FROM fx_listing WHERE id % 4 < 3) SELECT day || '/clip_' || CAST(id AS VARCHAR) || '.mp4' AS path, day FROM p")
def s07(spark: SparkSession, d: str) -> DataFrame:
    day = F.date_format("mday", "yyyyMMdd")
    m = media(spark, d)
    path = F.when(F.col("id") % 4 < 3, F.concat(day, F.lit("/clip_"), F.col("id").cast("string"), F.lit(".mp4"))).otherwise(F.concat(F.lit("x/"), day, F.lit(".mp4")))
    return listing.daily_files(m.select(path.alias("path"))).select("path", "day")


@query("S05_ledger_json", "SELECT CAST(o_orderkey AS VARCHAR) AS path, CASE WHEN o_orderkey % 2 = 0 THEN 'completed' ELSE 'queued' END AS status, CAST(o_custkey AS DOUBLE) AS end_ts FROM orders WHERE o_orderkey % 10 <> 3")
def s05(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    text = F.format_string('{"%d": {"status": "%s", "end_ts": %d}}', "o_orderkey", F.when(F.col("o_orderkey") % 2 == 0, "completed").otherwise("queued"), "o_custkey")
    broken = F.when(F.col("o_orderkey") % 10 == 3, F.lit("{not json")).otherwise(text)
    return store.read_ledger(o.select(broken.alias("value"))).select("path", "status", "end_ts")


@query("S05_ledger_sink", _STATE + " SELECT CAST(path AS VARCHAR) AS path, status, CAST(end_ts AS DOUBLE) AS end_ts, CAST(start_ts AS DOUBLE) AS start_ts FROM st")
def s05s(spark: SparkSession, d: str) -> DataFrame:
    """The ledger's state, saved and loaded again."""
    path = store.DayStore.temporary(spark).path
    store.save_ledger(ledger(spark, d).withColumn("path", F.col("path").cast("string")), path)
    return store.load_ledger(spark, path).select("path", "status", "end_ts", "start_ts")


@query("S06_roi_config", "SELECT o_orderkey AS id, CAST(CASE WHEN o_orderkey % 3 < 2 THEN 1 END AS DOUBLE) AS points, CAST(CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS DOUBLE) AS line_y FROM orders")
def s06(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").withColumnRenamed("o_orderkey", "id")
    whole = F.format_string('{"motion_detection_roi": [[%d, 7]], "line_y": %d}', "id", "o_custkey")
    text = F.when(F.col("id") % 3 == 0, whole).when(F.col("id") % 3 == 1, F.format_string("[[%d, 9]]", "id")).otherwise("nothing")
    r = configs.parse_roi(o.select("id", text.alias("value")))
    return r.select("id", F.when(F.col("motion_roi").isNotNull(), F.size("motion_roi")).cast("double").alias("points"), F.col("line_y").cast("double").alias("line_y"))


@query("W17_offline_streak", "WITH " + cte("fx_health") + ", o AS (SELECT host, max((ts, n)) FILTER (WHERE status <> 'offline') AS ok FROM fx_health GROUP BY host) SELECT host, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS since, count(*) AS samples FROM fx_health JOIN o USING (host) WHERE ok IS NULL OR (ts, n) > ok GROUP BY host")
def w17(spark: SparkSession, d: str) -> DataFrame:
    got = O.offline_since(view(spark, d, "fx_health"))
    return got.select(F.col("host").cast("long").alias("host"), F.date_format("since", "yyyy-MM-dd HH:mm:ss").alias("since"), "samples")


@query("W18_stable_files", "WITH " + cte("fx_poll") + """, s AS (SELECT *, size > 0 AND size = lag(size) OVER w AND lag(size) OVER w = lag(size, 2) OVER w AS ok FROM fx_poll WINDOW w AS (PARTITION BY path ORDER BY poll))
SELECT path, CAST(min(poll) AS BIGINT) AS poll FROM s WHERE ok GROUP BY path""")
def w18(spark: SparkSession, d: str) -> DataFrame:
    return O.first_stable(view(spark, d, "fx_poll")).select("path", F.col("poll").cast("long").alias("poll"))


@query("W19_backlog", "WITH RECURSIVE " + cte("fx_queue") + """, q AS (SELECT day, n, step, row_number() OVER (PARTITION BY day ORDER BY n) AS i FROM fx_queue),
f AS (SELECT day, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS i, CAST(0 AS BIGINT) AS depth, false AS fast FROM (SELECT DISTINCT day FROM q)
UNION ALL SELECT q.day, q.n, q.i, CAST(greatest(0, f.depth + q.step) AS BIGINT), CASE WHEN q.step > 0 AND f.depth >= 8 THEN true WHEN q.step < 0 AND greatest(0, f.depth + q.step) <= 5 THEN false ELSE f.fast END FROM f JOIN q ON q.day = f.day AND q.i = f.i + 1)
SELECT CAST(day AS VARCHAR) AS day, n, depth, fast FROM f WHERE i > 0""")
def w19(spark: SparkSession, d: str) -> DataFrame:
    r = O.backlog(view(spark, d, "fx_queue"))
    return r.select(F.col("day").cast("string").alias("day"), "n", F.col("depth").cast("long").alias("depth"), "fast")


_CLIPS = "SELECT event_id AS n, CAST(ts AS DATE) AS day, event_type = 'purchase' AS significant, concat('c', CAST(event_id AS {S})) AS text FROM {e}"


@query("W20_message_batches", "WITH c AS (" + _CLIPS.format(S="VARCHAR", e="events") + """), r AS (SELECT *, sum(CASE WHEN significant THEN 1 ELSE 0 END) OVER (PARTITION BY day ORDER BY n) AS run FROM c),
k AS (SELECT *, (row_number() OVER (PARTITION BY day, run ORDER BY n) - 1) // 4 AS part FROM r WHERE NOT significant)
SELECT min(n) AS first_n, string_agg(text, chr(10) ORDER BY n) AS text, count(*) AS clips FROM k GROUP BY day, run, part""")
def w20(spark: SparkSession, d: str) -> DataFrame:
    clips = spark.sql(_CLIPS.replace("{S}", "STRING").replace("{e}", "{events}"), events=spark.read.parquet(f"{d}/events.parquet"))
    return O.message_groups(clips).select("first_n", "text", "clips")


@query("ST07_burst_throttle", "WITH RECURSIVE " + cte("fx_burst") + """, q AS (SELECT *, row_number() OVER (PARTITION BY key, day ORDER BY at, n) AS i FROM fx_burst),
f AS (SELECT key, day, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS l, CAST(0 AS BIGINT) AS held, CAST(NULL AS BIGINT) AS o FROM (SELECT DISTINCT key, day FROM q)
UNION ALL SELECT q.key, q.day, q.n, q.i, CASE WHEN f.l IS NULL OR q.at - f.l >= 3600 THEN q.at ELSE f.l END, CASE WHEN f.l IS NULL OR q.at - f.l >= 3600 THEN 0 ELSE f.held + 1 END, CASE WHEN f.l IS NULL OR q.at - f.l >= 3600 THEN f.held END FROM f JOIN q ON q.key = f.key AND q.day = f.day AND q.i = f.i + 1)
SELECT key, n, o AS suppressed FROM f WHERE o IS NOT NULL""".replace(" at,", " \"at\",").replace("q.at", "q.\"at\"").replace("ORDER BY at", "ORDER BY \"at\""))
def st07(spark: SparkSession, d: str) -> DataFrame:
    return O.throttled(view(spark, d, "fx_burst"), 3600, "key", "day").select("key", "n", "suppressed")


@query("A30_stage_profile", "WITH " + cte("fx_stage") + """, s AS (SELECT stage, sum(seconds) AS t, sum(n) AS n, row_number() OVER (ORDER BY round(sum(seconds), 9) DESC, stage) AS k FROM fx_stage GROUP BY stage)
SELECT CASE WHEN k <= 5 THEN stage ELSE 'other' END AS stage, round(sum(t), 4) AS total, CAST(sum(n) AS BIGINT) AS n, round(100 * sum(t) / (SELECT sum(t) FROM s), 4) AS percent, round(1000 * sum(t) / sum(n), 4) AS mean_ms FROM s GROUP BY 1""")
def a30(spark: SparkSession, d: str) -> DataFrame:
    r = O.stage_profile(view(spark, d, "fx_stage"))
    return r.select("stage", "n", *(F.round(c, 4).alias(c) for c in ("total", "percent", "mean_ms")))


@query("J11_as_of_reading", """WITH e AS (SELECT event_id AS n, user_id AS host, CAST(epoch(ts) AS BIGINT) AS t, value AS v, event_type FROM events), r AS (SELECT host, t, max(v) AS v FROM e WHERE event_type = 'purchase' GROUP BY host, t)
SELECT e.n, CASE WHEN e.t - r.t <= 172800 THEN r.v END AS value FROM e ASOF LEFT JOIN r ON e.host = r.host AND e.t >= r.t WHERE e.event_type <> 'purchase'""")
def j11(spark: SparkSession, d: str) -> DataFrame:
    """Times to the nearest second."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("n"), F.col("user_id").alias("host"), F.rint(F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).cast("long").alias("at"), "value", "event_type")
    return O.as_of(e.where("event_type <> 'purchase'"), e.where("event_type = 'purchase'"), 172_800, "host").select("n", "value")


@query("A33_gallery_signature", "SELECT o_custkey AS gallery, sha1(string_agg(concat_ws('|', 'f' || CAST(o_orderkey AS VARCHAR), CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), CAST(CAST(o_orderdate AS DATE) AS VARCHAR)), chr(10) ORDER BY concat_ws('|', 'f' || CAST(o_orderkey AS VARCHAR), CAST(CAST(floor(o_totalprice) AS BIGINT) AS VARCHAR), CAST(CAST(o_orderdate AS DATE) AS VARCHAR)))) AS signature FROM orders GROUP BY o_custkey")
def a33(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet")
    f = o.select(F.col("o_custkey").alias("gallery"), F.concat(F.lit("f"), F.col("o_orderkey").cast("string")).alias("name"), F.floor("o_totalprice").cast("long").alias("size"), F.to_date("o_orderdate").alias("mtime"))
    return O.signature(f, "gallery")


@query("S11_gallery_refresh", "SELECT label AS gallery, vec_id AS path, CASE WHEN label % 2 = 0 THEN 'old' ELSE 'new' END AS version FROM embeddings")
def s11(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/embeddings.parquet").select(F.col("label").alias("gallery"), F.col("vec_id").alias("path"), F.col("embedding").alias("vector"))
    sig = F.concat(F.lit("s"), F.col("gallery").cast("string"))
    stored = e.withColumn("signature", F.when(F.col("gallery") % 2 == 0, sig).otherwise("stale")).withColumn("vector", F.slice("vector", 1, 1))
    now = e.select("gallery").distinct().withColumn("signature", sig)
    r = listing.refresh_gallery(stored, now, e)
    return r.select("gallery", "path", F.when(F.size("vector") == 1, "old").otherwise("new").alias("version"))


@query("J12_replay", """SELECT o_orderkey AS file, CASE o_custkey % 4 WHEN 0 THEN 'gate_crossing' WHEN 1 THEN 'no_person' ELSE 'unknown' END AS prior_status,
 CASE WHEN o_orderkey % 5 = 0 THEN 'file_missing' WHEN o_orderkey % 3 = 0 THEN 'no_person' ELSE 'unknown' END AS new_status FROM orders WHERE o_custkey % 4 <> 2""")
def j12(spark: SparkSession, d: str) -> DataFrame:
    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").alias("file"), (F.col("o_custkey") % 4).alias("k"))
    prior = F.when(F.col("k") == 0, "gate_crossing").when(F.col("k") == 1, "no_person").when(F.col("k") == 2, "no_motion")
    results = o.where("file % 3 = 0").select("file", F.lit("no_person").alias("status"))
    return O.replay_work(o.select("file", prior.alias("prior_status")), o.where("file % 5 <> 0"), results)


@query("J12_prior_status", _VID_DONE + " SELECT video AS file, arg_max(status, n) FILTER (WHERE done AND status IS NOT NULL) AS prior_status FROM k GROUP BY video HAVING bool_or(is_new)")
def j12p(spark: SparkSession, d: str) -> DataFrame:
    return O.prior_status(q_logs.metrics(spark, d))


@query("S12_replay_sink", "SELECT CAST(o_orderkey AS VARCHAR) AS timestamp_filename, 'no_person' AS prior_status, 'unknown' AS new_status FROM orders")
def s12(spark: SparkSession, d: str) -> DataFrame:
    import uuid

    from watchlake.sources.store import DayStore

    o = spark.read.parquet(f"{d}/orders.parquet").select(F.col("o_orderkey").cast("string").alias("file"), F.lit("no_person").alias("prior_status"), F.lit("unknown").alias("new_status"))
    path = f"{DayStore.temporary(spark).path}-{uuid.uuid4().hex}"
    listing.append_results(o.where("hash(file) % 2 = 0"), path)
    listing.append_results(o.where("hash(file) % 2 <> 0"), path)
    return spark.read.option("header", True).schema("timestamp_filename string, prior_status string, new_status string").csv(path)


# ---- projections
@query("P27_routing", "SELECT event_id AS n, CASE WHEN event_type IN ('click', 'view') THEN 'skip' WHEN hour(ts) < 9 OR hour(ts) > 19 THEN 'offpeak' WHEN hour(ts) <= 13 THEN 'main' ELSE 'fallback' END AS route FROM events")
def p27(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    status = F.when(F.col("event_type") == "click", "no_motion").when(F.col("event_type") == "view", "gate_crossing").otherwise("significant_motion")
    return e.select(F.col("event_id").alias("n"), O.route(status, F.hour("ts")).alias("route"))


@query("P28_clip_summary", """WITH e AS (SELECT event_id AS n, CASE WHEN event_id % 13 > 0 THEN (event_id % 250) / 1000.0::DOUBLE END AS score, CASE event_id % 3 WHEN 0 THEN true WHEN 1 THEN false END AS matched FROM events),
p AS (SELECT *, CAST(round_even(coalesce(score, 0) * 100, 0) AS INTEGER) AS percent FROM e)
SELECT n, concat_ws(' ', 'P' || CAST(n % 3 AS VARCHAR), 'C' || CAST(n % 2 AS VARCHAR), CASE WHEN n % 4 > 0 THEN 'up ' || CAST(n % 4 AS VARCHAR) || '/0' END,
 CASE WHEN matched OR (NOT matched AND percent <> 0) THEN CAST(percent AS VARCHAR) || '%' END, CASE WHEN n % 7 = 0 THEN repeat('d', 512) || '...' ELSE 'short' END) AS text FROM p""")
def p28(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    score, matched = F.when(n % 13 > 0, (n % 250) / 1000.0), F.when(n % 3 == 0, True).when(n % 3 == 1, False)
    text = O.summary_text(n % 3, n % 2, F.when(n % 4 > 0, "up"), n % 4, F.lit(0), score, matched, F.when(n % 7 == 0, F.repeat(F.lit("d"), 1024)).otherwise("short"))
    return spark.read.parquet(f"{d}/events.parquet").select(n.alias("n"), text.alias("text"))


@query("P29_auto_event", "SELECT event_id AS n, CASE WHEN event_id % 2 = 0 THEN CASE event_id % 6 WHEN 0 THEN 'away' WHEN 2 THEN 'back' WHEN 4 THEN CASE WHEN user_id % 2 = 0 THEN 'away' ELSE 'back' END END END AS event FROM events")
def p29(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    way = F.when(n % 6 == 0, "up").when(n % 6 == 2, "down").when(n % 6 == 4, "both")
    return spark.read.parquet(f"{d}/events.parquet").select(n.alias("n"), O.auto_event(n % 2 == 0, way, F.when(F.col("user_id") % 2 == 0, "up").otherwise("down")).alias("event"))


# Reactions before and after, by a message's number: each has one of these sets.
_SETS = [[O.UP], [O.DOWN, O.THINKING], [O.SHRUG + "\u200d\u2642\ufe0f"], [], [O.UP, O.DOWN], [O.THINKING], [O.SHRUG], ["\u2764"]]
_LISTS = "[" + ", ".join("[" + ", ".join(f"'{e}'" for e in x) + "]::VARCHAR[]" for x in _SETS) + "]"


@query("P30_reactions", f"""WITH r AS (SELECT event_id AS message_id, event_id % 3 = 0 AS same_day, {_LISTS}[CAST(event_id % 8 + 1 AS INTEGER)] AS new, {_LISTS}[CAST((event_id // 8) % 8 + 1 AS INTEGER)] AS old FROM events)
SELECT message_id, 'away' AS kind FROM r WHERE same_day AND list_contains(new, '{O.UP}') UNION ALL SELECT message_id, 'back' FROM r WHERE same_day AND list_contains(new, '{O.DOWN}')
UNION ALL SELECT message_id, 'further' FROM r WHERE list_contains(new, '{O.THINKING}') UNION ALL SELECT message_id, 'negative' FROM r WHERE len(list_filter(new, lambda x: starts_with(x, '{O.SHRUG}'))) > 0
UNION ALL SELECT message_id, 'remove' FROM r WHERE same_day AND list_has_any(old, ['{O.UP}', '{O.DOWN}']) OR len(list_filter(old, lambda x: starts_with(x, '{O.SHRUG}'))) > 0""")
def p30(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    sets = F.array(*(F.array(*map(F.lit, x)).cast("array<string>") for x in _SETS))
    pick = lambda k: F.element_at(sets, (k + 1).cast("int"))
    rows = spark.read.parquet(f"{d}/events.parquet").select(n.alias("message_id"), (n % 3 == 0).alias("same_day"), pick(n % 8).alias("new"), pick(F.floor(n / 8) % 8).alias("old"))
    return O.reaction_events(rows)


@query("P31_message_day", "SELECT event_id AS n, CASE event_id % 3 WHEN 0 THEN '20230101' WHEN 1 THEN strftime(ts, '%Y%m%d') ELSE '20220203' END AS day FROM events")
def p31(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("event_id")
    day = O.message_day(F.when(n % 3 == 0, "20230101"), F.when(n % 3 == 1, F.col("ts")).cast("timestamp"), F.lit("Cam_00_20220203040506.mp4"))
    return spark.read.parquet(f"{d}/events.parquet").select(n.alias("n"), day.alias("day"))


@query("P25_path_translation", """SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN '/mnt/nas/d' || CAST(o_custkey AS VARCHAR) || '/a.mp4' WHEN 1 THEN 'E:/other/' || CAST(o_custkey AS VARCHAR) ELSE 'C:/NASTY/x.mp4' END AS worker,
 CASE o_orderkey % 3 WHEN 0 THEN 'C:' || chr(92) || 'NAS' || chr(92) || 'out' || chr(92) || CAST(o_custkey AS VARCHAR) || '.mp4' WHEN 1 THEN '/MNT/nas/b.mp4' ELSE 'C:' || chr(92) || 'NAS' || chr(92) || 'k' || chr(92) || 'c.mp4' END AS clip,
 CASE WHEN o_orderkey % 2 = 0 THEN 'C:' || chr(92) || 'NAS' || chr(92) || 'out' || chr(92) || 'best.jpg' ELSE '' END AS best, 'C:' || chr(92) || 'NAS' || chr(92) || 'out' || chr(92) || 'f.jpg,/tmp/elsewhere.jpg' AS frames FROM orders""")
def p25(spark: SparkSession, d: str) -> DataFrame:
    """Paths on the way to a worker, and a worker's result on the way back: copied files, paths of the share, and others."""
    o, k, c = spark.read.parquet(f"{d}/orders.parquet"), F.col("o_orderkey") % 3, F.col("o_custkey").cast("string")
    there = F.when(k == 0, F.concat(F.lit("c:\\nas\\d"), c, F.lit("\\a.mp4"))).when(k == 1, F.concat(F.lit("E:\\other\\"), c)).otherwise("C:\\NASTY\\x.mp4")
    clip = F.when(k == 0, F.concat(F.lit("/tmp/run/"), c, F.lit(".mp4"))).when(k == 1, "/MNT/nas/b.mp4").otherwise("/mnt/nas/k/c.mp4")
    best = F.when(F.col("o_orderkey") % 2 == 0, "/tmp/run/best.jpg").otherwise("")
    frames = F.array(F.lit("/tmp/run/f.jpg"), F.lit("/tmp/elsewhere.jpg"))
    result = F.struct(clip.alias("clip_path"), frames.alias("insignificant_frames"), F.struct(best.alias("best_path"), F.lit(0.5).alias("score")).alias("reid"))
    rows = o.select(F.col("o_orderkey").alias("id"), O.to_worker_path(there, "C:\\NAS\\", "/mnt/nas/").alias("worker"), result.alias("result"))
    rows = rows.withColumn("result", O.translate_result(F.col("result"), "/tmp/run", "/mnt/nas/out", "C:\\NAS\\", "/mnt/nas/"))
    return rows.select("id", "worker", F.col("result.clip_path").alias("clip"), F.col("result.reid.best_path").alias("best"), F.array_join("result.insignificant_frames", ",").alias("frames"))


@query("P26_worker_tag", "WITH " + cte("fx_log") + r""" SELECT n, CASE WHEN regexp_matches(line, ' - [A-Z]+ - \[[^\]]+\]') THEN regexp_replace(line, '^(.*? - [A-Z]+ - \[[^\]]+\])\s*', '\1 [W] ') WHEN regexp_matches(line, ' - [A-Z]+ - ') THEN regexp_replace(line, '^(.*? - [A-Z]+ - )', '\1[W] ') ELSE '[W] ' || line END AS line FROM fx_log""")
def p26(spark: SparkSession, d: str) -> DataFrame:
    return view(spark, d, "fx_log").select("n", O.tag_worker(F.col("line")).alias("line"))


@query("P32_result_json", """SELECT event_id AS n, '{"status":"' || event_type || '","persons":' || CAST(event_id % 3 AS VARCHAR) || ',"crops":2}' AS json FROM events""")
def p32(spark: SparkSession, d: str) -> DataFrame:
    e = spark.read.parquet(f"{d}/events.parquet")
    crops = F.array(F.lit("a"), F.lit("b"))
    return e.select(F.col("event_id").alias("n"), F.to_json(F.struct(F.col("event_type").alias("status"), (F.col("event_id") % 3).alias("persons"), F.size(crops).alias("crops"))).alias("json"))


@query("S08_recursive_listing", "SELECT strftime(ts, '%Y-%m-%d') AS day, 1 AS folders FROM events GROUP BY 1")
def s08(spark: SparkSession, d: str) -> DataFrame:
    """The events are written into a folder a day, and the folders' files are listed without their contents."""
    root = store.DayStore.temporary(spark).path
    e = spark.read.parquet(f"{d}/events.parquet").withColumn("day", F.date_format("ts", "yyyy-MM-dd"))
    e.repartition("day").write.partitionBy("day").parquet(root)
    found = listing.list_files(spark, root, "*.parquet").where("length > 0")
    return found.groupBy(F.regexp_extract("path", r"day=([0-9-]+)/", 1).alias("day")).agg(F.count_distinct(F.regexp_extract("path", "^(.*)/", 1)).cast("int").alias("folders"))


# ---- media
_ENDS = ["_reid_best0_m.jpg", "_reid_best1.jpg", "_reid_best2.JPG", "_reid_best3.jpg", "_pose_1.mp4", "_insignificant_0.jpg", "_no_person_1.PNG", ".jpg", ".mp4", "_reid_1.jpg", ".txt"]


def _media_files(spark: SparkSession, d: str) -> DataFrame:
    """Crops, frames, poses, highlights and others of three clips a month, some in two days' folders, some too deep."""
    month, k = F.trunc("mday", "month"), F.floor(F.col("id") / 3) % len(_ENDS)
    stem = F.concat(F.lit("Cam_00_"), F.date_format(month, "yyyyMMdd"), F.lit("101010_"), (F.col("id") % 3).cast("string"))
    end = F.element_at(F.array(*map(F.lit, _ENDS)), (k + 1).cast("int"))
    name = F.concat(F.when(k.isin(5, 6), "08H").otherwise(""), stem, end)
    day = F.date_format(F.date_add(month, (F.col("id") % 2).cast("int")), "yyyyMMdd")
    deep = F.when(F.col("id") % 13 == 0, "sub/").otherwise("")
    rows = media(spark, d).select(F.concat(F.lit("t/"), day, F.lit("/"), deep, name).alias("path")).distinct()
    return written(rows, "listing")  # a listing is a table; as an expression it would be repeated in all that is told from a path


_MEDIA = _LIST + f""", m0 AS (SELECT date_trunc('month', mday) AS mo, id, CAST((id // 3) % {len(_ENDS)} AS INTEGER) AS k FROM fx_listing),
m1 AS (SELECT DISTINCT 'Cam_00_' || strftime(mo, '%Y%m%d') || '101010_' || CAST(id % 3 AS VARCHAR) AS stem, strftime(mo + INTERVAL 1 DAY * CAST(id % 2 AS INTEGER), '%Y%m%d') AS day, k, {_ENDS}[k + 1] AS fin, strftime(mo, '%Y%m%d') AS own FROM m0 WHERE id % 13 <> 0),
mf AS (SELECT *, CASE WHEN k IN (5, 6) THEN '08H' ELSE '' END || stem || fin AS name FROM m1 WHERE k < 10),
mi AS (SELECT CASE WHEN k < 4 THEN 'crop' WHEN k = 4 THEN 'pose' WHEN k IN (5, 6) THEN 'frame' WHEN k = 8 THEN 'highlight' ELSE 'image' END AS kind, CASE WHEN k NOT IN (7, 9) THEN stem END AS stem, name, 't/' || max(day) || '/' || name AS path, count(*) AS files FROM mf GROUP BY k, stem, name)"""


@query("J05_media_index", _MEDIA + " SELECT kind, stem, name, path, files FROM mi")
def j05(spark: SparkSession, d: str) -> DataFrame:
    return M.media_index(_media_files(spark, d))


_CROPS = q_logs._VID + r""", cv AS (SELECT DISTINCT regexp_replace(video, '\.[^.]*$', '') AS stem, TRY_CAST(regexp_extract(video, '(\d)(0000)?\.mp4$', 1) AS INTEGER) % 3 AS k FROM ent WHERE video IS NOT NULL),
cr AS (SELECT stem, CASE k WHEN 1 THEN stem || '_reid_best0.jpg' ELSE stem || '_reid_best0.jpg,' || stem || '_reid_best1_m.jpg,' || stem || '_reid_best1_m.jpg' END AS crops FROM cv WHERE k > 0)
SELECT row_number() OVER (ORDER BY first_seen DESC NULLS LAST, video DESC) AS place, video, strftime(coalesce(try_strptime(nullif(regexp_extract(video, '(\d{14})', 1), ''), '%Y%m%d%H%M%S'), first_seen), '%H:%M:%S') AS time,
 gate_dir AS direction, CAST(gate_up AS DOUBLE) AS persons_up, CAST(gate_down AS DOUBLE) AS persons_down, status, CAST(reid_matched AS VARCHAR) AS reid_matched, round(reid_best, 3) AS reid_score, round(reid_neg, 3) AS reid_neg, reaction AS away_back, crops
FROM vid JOIN cr ON regexp_replace(video, '\.[^.]*$', '') = cr.stem WHERE day = (SELECT max(day) FROM vid) AND (status IS NOT NULL OR first_seen IS NOT NULL)"""


@query("J04_crossings_with_crops", _CROPS)
def j04(spark: SparkSession, d: str) -> DataFrame:
    """The newest day's videos with crops: those of every third clip have none, of another third a crop in two days' folders."""
    v = q_logs.videos(spark, d)
    k = F.regexp_extract("video", r"(\d)(0000)?\.mp4$", 1).try_cast("int") % 3
    stem = F.regexp_replace("video", r"\.[^.]*$", "")
    file = lambda day, end: F.concat(F.lit(f"t/{day}/"), stem, F.lit(end))
    crops = F.when(k == 1, F.array(file(20240101, "_reid_best0.jpg"))).when(k == 2, F.array(file(20240101, "_reid_best0.jpg"), file(20240101, "_reid_best1_m.jpg"), file(20240102, "_reid_best1_m.jpg")))
    names = q_logs.entries(spark, d).where("video IS NOT NULL").select("video").distinct()
    newest = v.join(F.broadcast(v.agg(F.max("day").alias("newest")))).where("day = newest")
    found = M.crossings_with_crops(newest, M.media_index(names.select(F.explode(crops).alias("path"))))
    up, down = (F.col(c).cast("double").alias(c) for c in ("persons_up", "persons_down"))
    return found.select("place", "video", "time", "direction", up, down, "status", F.col("reid_matched").cast("string").alias("reid_matched"), "reid_score", "reid_neg", "away_back", F.array_join("crops", ",").alias("crops"))


def _clips(spark: SparkSession, d: str) -> DataFrame:
    """Clips of two in three of the listing's stems."""
    stem = F.concat(F.lit("v/Cam_00_"), F.date_format(F.trunc("mday", "month"), "yyyyMMdd"), F.lit("101010_"), (F.col("id") % 3).cast("string"), F.lit(".mp4"))
    return media(spark, d).where("id % 3 < 2").select(stem.alias("video")).distinct()


_PICK = _MEDIA + """, c AS (SELECT stem, 't/' || day || '/' || name AS path, name, k, row_number() OVER (PARTITION BY stem ORDER BY name) AS place FROM mf WHERE k IN (0, 1, 3) AND day = own AND stem[-1] <> '2'),
cm AS (SELECT stem, path FROM c WHERE k = 0)"""


@query("J13_gallery_copies", _PICK + " SELECT stem, path, 2 AS most FROM c WHERE place <= 2 UNION ALL SELECT stem, path, 3 FROM c UNION ALL SELECT stem, path, 0 FROM c WHERE place <= 1 UNION ALL SELECT stem, path, -1 FROM cm")
def j13(spark: SparkSession, d: str) -> DataFrame:
    """The first two crops, three (all there are), one where none is asked for, and matched ones only."""
    clips, files_ = _clips(spark, d), _media_files(spark, d)
    parts = [M.gallery_copies(clips, files_, k).withColumn("most", F.lit(k)) for k in (2, 3, 0)]
    parts.append(M.gallery_copies(clips, files_, only_matched=True).withColumn("most", F.lit(-1)))
    return parts[0].unionAll(parts[1]).unionAll(parts[2]).unionAll(parts[3])


@query("J13_gallery_split", GALLERY_SQL)
def j13g(spark: SparkSession, d: str) -> DataFrame:
    """Crops by whether the gallery already has a file of their name."""
    o = spark.read.parquet(f"{d}/orders.parquet")
    copies = o.select(F.format_string("2024/Cam_%d_reid_best0.jpg", "o_orderkey").alias("path"))
    gallery = o.where("o_custkey % 3 = 0").select(F.format_string("gallery/pos/Cam_%d_reid_best0.jpg", "o_orderkey").alias("path"))
    there, new = (M.copies_in_gallery(copies, gallery, x).withColumn("present", F.lit(x)) for x in (True, False))
    return there.unionByName(new)


@query("J14_source_video", _MEDIA + " SELECT stem || '.mp4' AS video, min('t/' || day || '/' || name) AS path FROM mf WHERE k = 8 AND stem[-1] <> '2' GROUP BY stem")
def j14(spark: SparkSession, d: str) -> DataFrame:
    names = _clips(spark, d).select(F.substring("video", 3, 100).alias("video"))
    return M.first_source(names, _media_files(spark, d).where("path NOT LIKE '%/sub/%'"))


@query("W21_nth_frame", "WITH " + cte("fx_presence") + """, f AS (SELECT CASE WHEN video % 7 = 0 THEN 'x' || CAST(video % 5 AS VARCHAR) ELSE 'a/b' || CAST(video % 3 AS VARCHAR) || '/' || CAST(video % 5 AS VARCHAR) END AS parent,
 CASE WHEN video % 4 = 0 THEN CAST(video AS VARCHAR) || '.mp4' ELSE 'cam_' || CAST(video * 37 % 1009 AS VARCHAR) || '.mp4' END AS name, CASE WHEN video % 4 > 0 THEN video * 37 % 1009 END AS stamp FROM fx_presence WHERE frame = 30),
d AS (SELECT DISTINCT parent || '/' || name AS path, regexp_extract(parent, '([^/]*)$', 1) AS folder, stamp FROM f) SELECT row_number() OVER (ORDER BY folder, stamp NULLS LAST, path) AS place, path FROM d""")
def w21(spark: SparkSession, d: str) -> DataFrame:
    """Clips whose name ends in a number after _, and others, which go last in their folder."""
    v = F.col("video")
    text = lambda c: c.cast("string")
    parent = F.when(v % 7 == 0, F.concat(F.lit("x"), text(v % 5))).otherwise(F.concat(F.lit("a/b"), text(v % 3), F.lit("/"), text(v % 5)))
    name = F.when(v % 4 == 0, F.concat(text(v), F.lit(".mp4"))).otherwise(F.concat(F.lit("cam_"), text(v * 37 % 1009), F.lit(".mp4")))
    p = view(spark, d, "fx_presence")
    return M.nth_frames(p.select(F.concat(parent, F.lit("/"), name).alias("path"), "frame"))
