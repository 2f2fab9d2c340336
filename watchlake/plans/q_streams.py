"""Queries that run a stream over a table to its end, and the entity resolver."""

from __future__ import annotations

from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.operators import entities
from watchlake.operators import logs as L
from watchlake.operators import tracks as K
from watchlake.operators.graph import written
from watchlake.params import CrossingParams, TrustParams
from watchlake.plans import q_logs, q_ops
from watchlake.plans.fixtures import cte, view, write_files
from watchlake.plans.registry import query
from watchlake.sources.store import DayStore, LiveDayStore
from watchlake.streaming import streams as S

CHUNKS = 4


def write_chunks(rows: DataFrame, path: str, order: str, turns: tuple[int, ...] = (0, 1, 2, 3), closing: DataFrame | None = None) -> Iterator[None]:
    """``rows`` as chunks that appear one after the other, in the given turns: ranges of ``order``. Goes on after each of them.

    A chunk has as many files as tasks wrote it. ``closing`` rows come last, twice: the first move the watermark, and the
    batch of the second sees that.
    """
    x = F.col(order).cast("double")
    rows = written(rows, "stream-rows")
    cuts = sorted(set(rows.select(x.alias("x")).approxQuantile("x", [k / CHUNKS for k in range(1, CHUNKS)], 0.02)))
    ends = list(zip([None, *cuts], [*cuts, None]))
    for k in [*(t for t in turns if t < len(ends)), *(k for k in range(len(ends)) if k not in turns)]:
        lo, hi = ends[k]
        part = rows if lo is None else rows.where(x > lo)
        part = part if hi is None else part.where(x <= hi)
        part.write.mode("append").parquet(path)
        yield
    for _ in range(2 if closing is not None else 0):
        closing.coalesce(1).write.mode("append").parquet(path)
        yield


@contextmanager
def setting(spark: SparkSession, name: str, value: str) -> Iterator[None]:
    """A session's setting for as long as a query runs; its own comes back."""
    old = spark.conf.get(name, None)
    spark.conf.set(name, value)
    try:
        yield
    finally:
        spark.conf.set(name, old) if old else spark.conf.unset(name)


def rocks(spark: SparkSession):
    """State in RocksDB, as state processors need it."""
    return setting(spark, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")


SHUFFLED = (2, 0, 3, 1)


def streamed(spark: SparkSession, rows: DataFrame, run, mode: str, order: str, key: str | None = None, **chunks) -> DataFrame:
    """Write ``rows`` in chunks, as ``write_chunks`` does, stream each through ``run`` once it is there, and return what the sink holds.

    A chunk is one batch, however many files it has: so the number of batches doesn't grow with the rows, and the rows of one
    of its files can't move the watermark past those of another. The stream goes on from its checkpoint.
    In update mode each batch's rows are kept with the batch's number, and the last row of a key counts.
    """
    root = DayStore.temporary(spark).path
    source, out, at = f"{root}/in", f"{root}/out", f"{root}/checkpoint"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("batch", F.lit(number)).write.mode("append").parquet(out)

    for _ in write_chunks(rows, source, order, **chunks):
        stream = run(spark.readStream.schema(rows.schema).parquet(source))
        writer = stream.writeStream.option("checkpointLocation", at).trigger(availableNow=True).outputMode(mode)
        writer = writer.format("parquet").option("path", out) if mode == "append" else writer.foreachBatch(keep)
        writer.start().awaitTermination()
    if mode == "append":
        return spark.read.schema(stream.schema).parquet(out)
    got = spark.read.schema(stream.schema.add("batch", "integer")).parquet(out)
    names = [c for c in got.columns if c not in ("batch", *key.split(","))]
    last = got.groupBy(*key.split(",")).agg(F.max_by(F.struct(*names), "batch").alias("r"))
    return last.select(*key.split(","), "r.*")


@query("ST03_streaming_sessions", "WITH " + cte("fx_motion") + """, g AS (SELECT video, frame, CASE WHEN frame - lag(frame) OVER (PARTITION BY video ORDER BY frame) > 75 THEN 1 ELSE 0 END AS s FROM (SELECT DISTINCT * FROM fx_motion)),
r AS (SELECT video, frame, sum(s) OVER (PARTITION BY video ORDER BY frame) AS k FROM g), ev AS (SELECT video, min(frame) AS a, max(frame) AS b FROM r GROUP BY video, k) SELECT video, a AS start_frame, b AS end_frame FROM ev WHERE b + 75 <= (SELECT max(frame) FROM fx_motion) - 250""")
def st03(spark: SparkSession, d: str) -> DataFrame:
    """Sessions that the watermark has passed by the end of the stream."""
    m = view(spark, d, "fx_motion").distinct()
    rows = m.select("video", F.timestamp_millis(F.col("frame") * 40).alias("ts"))
    got = streamed(spark, rows, lambda s: S.motion_sessions(s, "3 seconds", "10 seconds"), "append", "ts")
    frame = lambda c: F.floor(F.unix_millis(c) / 40).cast("long")
    last = m.agg(F.max("frame").alias("m"))
    found = got.select("video", frame("start").alias("start_frame"), frame("end").alias("end_frame"))
    # the last files may move the watermark in one more batch than the sink saw; what counts is passed for sure
    return found.join(F.broadcast(last)).where(F.col("end_frame") + 75 <= F.col("m") - 250).drop("m")


@query("ST02_streaming_ledger", q_ops._STATE + " SELECT path, status, CAST(end_ts AS DOUBLE) AS end_ts, CAST(start_ts AS DOUBLE) AS start_ts FROM st")
def st02s(spark: SparkSession, d: str) -> DataFrame:
    """Updates with extras, in chunks that come out of order."""
    rows = q_ops.ledger_rows(spark, d)
    with rocks(spark):
        return streamed(spark, rows, lambda s: S.ledger_updates(s, ("end_ts", "start_ts")), "update", "seq", "path", turns=SHUFFLED)


@query("ST07_streaming_throttle", "WITH RECURSIVE " + cte("fx_burst").replace(" AS at ", " AS tm ") + """, q AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY tm, n) AS i FROM fx_burst),
f AS (SELECT key, CAST(0 AS BIGINT) AS n, CAST(0 AS BIGINT) AS i, CAST(NULL AS BIGINT) AS l, CAST(0 AS BIGINT) AS held, CAST(NULL AS BIGINT) AS o FROM (SELECT DISTINCT key FROM q)
UNION ALL SELECT q.key, q.n, q.i, CASE WHEN f.l IS NULL OR q.tm - f.l >= 3600 THEN q.tm ELSE f.l END, CASE WHEN f.l IS NULL OR q.tm - f.l >= 3600 THEN 0 ELSE f.held + 1 END, CASE WHEN f.l IS NULL OR q.tm - f.l >= 3600 THEN f.held END FROM f JOIN q ON q.key = f.key AND q.i = f.i + 1)
SELECT key, n, o AS suppressed FROM f WHERE o IS NOT NULL""")
def st07s(spark: SparkSession, d: str) -> DataFrame:
    """Rows in chunks that come out of order, late by the whole table; a row from 2100 moves the watermark past all."""
    rows = view(spark, d, "fx_burst").select("key", F.timestamp_seconds("at").alias("ts"), "at", "n")
    closing = spark.sql("SELECT 'closing' AS key, TIMESTAMP '2100-01-01 00:00:00' AS ts, 4102444800L AS at, -1L AS n").select(*(F.col(c).cast(t) for c, t in rows.dtypes))
    with rocks(spark):
        return streamed(spark, rows, lambda s: S.throttled_stream(s, 3600, "7000 days"), "append", "at", turns=SHUFFLED, closing=closing)


@query("ST08_live_summary", q_logs._VID + " SELECT CAST(day AS VARCHAR) AS day, video, status, pipeline_error, full_s, reaction, gate_dir FROM vid")
def st08(spark: SparkSession, d: str) -> DataFrame:
    got = streamed(spark, view(spark, d, "fx_log"), S.live_video_summary, "update", "n", "day,video")
    return got.select(F.col("day").cast("string").alias("day"), "video", "status", "pipeline_error", "full_s", "reaction", "gate_dir")


@query("ST06_live_state", q_logs._PTS + " SELECT CAST(day AS VARCHAR) AS day, arg_max(type, (minute, ts, n)) AS state, max(minute) AS at_minute, count(*) AS events FROM pts GROUP BY day")
def st06s(spark: SparkSession, d: str) -> DataFrame:
    got = streamed(spark, q_logs.pts(spark, d), S.live_state, "update", "n", "day")
    return got.withColumn("day", F.col("day").cast("string"))


@query("S09_new_file_stream", "SELECT CAST(event_id AS BIGINT) AS n FROM events")
def s09(spark: SparkSession, d: str) -> DataFrame:
    """The file source over files as they lie there, exact repeats dropped within the watermark."""
    e = spark.read.parquet(f"{d}/events.parquet").select(F.col("event_id").alias("n"), F.col("ts").cast("timestamp").alias("ts"))
    return streamed(spark, e.unionAll(e), lambda s: S.once(s, "n", late="400 days"), "append", "ts").select("n")


@query("S09_mp4_stream", "SELECT 'cam_' || CAST(user_id AS VARCHAR) || '.mp4' AS name, count(*) AS length FROM events GROUP BY user_id")
def s09m(spark: SparkSession, d: str) -> DataFrame:
    """New .mp4 files below a folder, whatever else lies there: a file for each user, with a byte for each event.

    All of them are there already, so a batch takes many.
    """
    from watchlake.sources.listing import new_files

    e = spark.read.parquet(f"{d}/events.parquet").groupBy("user_id").agg(F.count("*").alias("n"))
    root = DayStore.temporary(spark).path
    rows = e.select(F.explode(F.array(F.lit("mp4"), F.lit("tmp"))).alias("ending"), "user_id", F.repeat(F.lit("x"), F.col("n").cast("int") - 1).alias("value"))
    rows = rows.select(F.concat(F.lit("cam_"), F.col("user_id").cast("string"), F.lit("."), F.col("ending")).alias("name"), "value")
    write_files(spark, rows, f"{root}/in/2024")
    stream = new_files(spark, f"{root}/in", 20_000).select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    tasks = spark.sparkContext.defaultParallelism  # a batch's many small files are looked up and read by a few tasks, not one each
    writer = stream.coalesce(tasks).writeStream.format("parquet").option("path", f"{root}/out").option("checkpointLocation", f"{root}/checkpoint")
    with setting(spark, "spark.sql.sources.parallelPartitionDiscovery.parallelism", str(4 * tasks)):
        writer.outputMode("append").trigger(availableNow=True).start().awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{root}/out")


@query("ST08_day_store", q_logs._ENTRY)
def st08d(spark: SparkSession, d: str) -> DataFrame:
    """Day statistics kept up to date while log lines arrive out of order: each batch adds the states of its own lines.

    Half of the days are closed at the end, so statistics come from the kept ones and from states.
    """
    root, store, rows = DayStore.temporary(spark).path, LiveDayStore.temporary(spark), view(spark, d, "fx_log")
    for _ in write_chunks(rows, f"{root}/in", "n", turns=SHUFFLED):
        stream = spark.readStream.schema(rows.schema).parquet(f"{root}/in")
        writer = stream.writeStream.foreachBatch(S.day_store_sink(store)).option("checkpointLocation", f"{root}/checkpoint")
        writer.trigger(availableNow=True).start().awaitTermination()
    first, last = store.videos().agg(F.min("day"), F.max("day")).first()
    if first is not None:
        store.close(F.lit(first + (last - first) / 2))
    found = store.entries().select("day", "videos_total", F.round("md_avg", 6).alias("md_avg"), F.round("full_avg", 6).alias("full_avg"), F.explode_outer("status_counts").alias("status", "videos"))
    return found.withColumn("day", F.col("day").cast("string")).fillna(0, ["videos"])


def _people(spark: SparkSession, d: str) -> DataFrame:
    return K.with_boxes(view(spark, d, "fx_det3")).where("cls = 'person'").withColumn("clip_index", F.floor(F.col("frame") / 100))


_TRUST = TrustParams(drift_px=300.0, updates=4, confidence=0.64)


@query("ST04_entity_resolver")
def st04(spark: SparkSession, d: str) -> DataFrame:
    """Sequential: held against a plain fold in the tests."""
    return entities.resolve(_people(spark, d), 25.0, trust=_TRUST)


@query("ST04_streaming_resolver")
def st04x(spark: SparkSession, d: str) -> DataFrame:
    """The resolver over a stream of chunks that come out of order: the tests hold it against the batch resolver."""
    rows = _people(spark, d).select("video", "clip_index", F.timestamp_millis(F.col("frame") * 40 + 86_400_000).alias("ts"), "frame", "track_id", "conf", "x1", "y1", "x2", "y2")
    closing = rows.limit(1).withColumns({"video": F.lit(-1).cast(rows.schema["video"].dataType), "ts": F.lit("2100-01-01 00:00:00").cast("timestamp")})
    with rocks(spark):
        return streamed(spark, rows, lambda s: S.resolved_stream(s, 25.0, trust=_TRUST, late="7000 days"), "append", "frame", turns=SHUFFLED, closing=closing)


@query("ST04_entity_states")
def st04s(spark: SparkSession, d: str) -> DataFrame:
    """Crossings of trusted entities, on top of the resolver."""
    return entities.entity_states(entities.resolve(_people(spark, d), 25.0, trust=_TRUST), 25.0, CrossingParams(dwell_s=0.08))


@query("A25_resolved_objects")
def a25r(spark: SparkSession, d: str) -> DataFrame:
    """Different people of the kept events, without the tracks of entities that the resolver suppressed."""
    people = _people(spark, d)
    found = written(entities.resolve(people, 25.0, trust=_TRUST), "resolved")
    kept = people.groupBy("video", "clip_index").agg(F.count_distinct("frame").alias("frames")).where("frames >= 10")
    return K.unique_objects(people, kept, entities.suppressed_tracks(found))
