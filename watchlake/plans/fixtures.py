"""Views that derive the operators' inputs from the given tables, alike in Spark and DuckDB."""

from __future__ import annotations

from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import DataFrame, Row, SparkSession

_LOG = """
WITH b AS (
 SELECT event_id AS n, user_id AS u, ts, CAST(ts AS DATE) AS day, CAST(CAST(value AS DECIMAL(10,2)) AS STRING) AS v,
  CASE WHEN user_id % 3 = 2
   THEN concat(lpad(CAST(user_id % 60 AS STRING),2,'0'),'M',lpad(CAST(hour(ts) AS STRING),2,'0'),'S_',CAST(user_id AS STRING),'.mp4')
   ELSE concat('Cam',CAST(user_id % 3 AS STRING),'_00_',$FMT(date_trunc('hour',ts),'$F14'),'.mp4') END AS video
 FROM {events}),
c AS (SELECT *, CASE CAST(n % 16 AS INT)
  WHEN 0 THEN concat('New file detected: x/', video)
  WHEN 1 THEN concat('Motion detection complete. Status: ', CASE CAST(u % 5 AS INT) WHEN 0 THEN 'no_motion' WHEN 1 THEN 'no_significant_motion' WHEN 2 THEN 'no_person' WHEN 3 THEN 'significant_motion' ELSE 'gate_crossing' END)
  WHEN 2 THEN concat('Full processing took ', v, ' seconds. Detected: 1 persons, 0 cars.')
  WHEN 3 THEN concat('Found ', CAST(u % 7 AS STRING), ' raw motion event(s). Filtering by duration...')
  WHEN 4 THEN concat('Motion detection took ', v, ' seconds.')
  WHEN 5 THEN concat('Gate crossing detected! Direction: ', CASE CAST(u % 4 AS INT) WHEN 0 THEN 'up. Persons Up: 1, Down: 0.' WHEN 1 THEN 'down. Persons Up: 0, Down: 2.' WHEN 2 THEN 'both. Persons Up: 1, Down: 1.' ELSE 'up' END)
  WHEN 6 THEN concat('Queuing motion detection... (motion_queue_depth=3, fast_processing=', CASE WHEN u % 2 = 0 THEN 'True' ELSE 'False' END, ')')
  WHEN 7 THEN 'Saved no_person frame to /x.jpg'
  WHEN 8 THEN 'Reaction detected: object went away.'
  WHEN 9 THEN 'AUTO Reaction detected: object came back.'
  WHEN 10 THEN CASE WHEN u % 10 = 0 THEN 'Reaction removed.' ELSE 'Reaction detected: object went away.' END
  WHEN 11 THEN concat('ReID result: matched=', CASE WHEN u % 2 = 0 THEN 'True' ELSE 'False' END, ', pos=0.', lpad(CAST(n % 1000 AS STRING),3,'0'), ', neg=0.250, delta=-0.100, thr=0.600, margin=0.080.')
  WHEN 12 THEN concat('SpeedTrap ', CAST(10 + n % 70 AS STRING), ' km/h ->, car_id=1, df=9 frames, dt=0.36s')
  WHEN 13 THEN 'Telegram send failed. Status: error'
  WHEN 14 THEN concat('ReID result: matched=False, best_score=0.', lpad(CAST(n % 1000 AS STRING),3,'0'), ', threshold=0.600')
  ELSE concat('Tesla SoC fetched: ', CAST(n % 100 AS STRING), '%') END AS content FROM b)
SELECT n, day, CASE WHEN n % 101 = 0 THEN 'Traceback (most recent call last):'
 ELSE concat(CASE WHEN n % 97 = 0 THEN '[W] ' ELSE '' END, $FMT(ts,'$FTS'), ' - ', CASE WHEN n % 16 = 13 THEN 'ERROR' WHEN n % 16 = 7 THEN 'WARNING' ELSE 'INFO' END, ' - ',
  CASE WHEN n % 16 = 15 THEN '' ELSE concat('[',video,'] ') END, CASE WHEN u % 4 = 0 THEN '[W] ' ELSE '' END, content) END AS line
FROM c"""
_MOTION = "SELECT user_id AS video, CAST(floor($EPOCH/600) AS BIGINT) AS frame FROM {events}"
_DET = """
SELECT user_id AS video, CAST(floor((rn - 1) / $PER) AS BIGINT) AS frame, user_id*10 + event_id % 2 AS track_id,
       CASE WHEN event_type='purchase' THEN 'car' ELSE 'person' END AS cls,
       CAST(35 + event_id % 60 AS DOUBLE)/100 AS conf,
       CAST((event_id*13 + user_id*97) % 1900 AS DOUBLE) AS cx,
       CAST(780 + (event_id*7 + user_id*31) % 61 AS DOUBLE) AS cy
FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS rn FROM {events}) e"""
_EMB = """
SELECT vec_id, v, label, CASE label WHEN 0 THEN 'pos' WHEN 1 THEN 'neg' ELSE 'probe' END AS role, CAST(floor((vec_id % 100000) / 25) AS BIGINT) AS video,
       CAST((vec_id*7919) % 1000 AS DOUBLE)/10 AS sharpness
FROM (SELECT vec_id, CAST(embedding AS $DOUBLES) AS v, label FROM {embeddings}
 UNION ALL SELECT vec_id + 100000, $NOISY, label FROM {embeddings} WHERE vec_id % 5 = 0) x"""
_LEDGER = """
SELECT o_custkey AS path, o_orderkey AS seq,
       CASE WHEN o_orderkey % 17 = 0 THEN 'completed' WHEN o_orderkey % 5 = 0 THEN 'failed'
            WHEN o_orderkey % 2 = 0 THEN 'started' ELSE 'queued' END AS status FROM {orders}"""
_LISTING = """
SELECT concat($FMT(CAST(o_orderdate AS TIMESTAMP),'$FD'), '/Cam_00_', $FMT(CAST(o_orderdate AS TIMESTAMP),'$F14'), '_', CAST(o_orderkey AS STRING), '.mp4') AS path,
       CAST(o_orderdate AS DATE) AS mday, CAST(floor(o_totalprice) AS BIGINT) AS length, o_orderkey AS id FROM {orders}"""
_POLL = """
SELECT l_orderkey AS path,
       row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS poll,
       CAST(floor(l_quantity/20) AS BIGINT) AS size FROM {lineitem}"""
_HEALTH = "SELECT event_id AS n, ts, user_id AS host, CASE event_type WHEN 'error' THEN 'offline' ELSE 'ok' END AS status FROM {events}"
_STAGE = "SELECT concat(l_returnflag, l_linestatus, CAST(l_linenumber AS STRING)) AS stage, CAST(l_quantity AS DOUBLE)/1000 AS seconds, 1 AS n FROM {lineitem}"
_PRESENCE = """
SELECT user_id AS video, CAST(row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS BIGINT) AS frame,
       CASE WHEN event_type IN ('click','view') THEN 0.9D ELSE 0.1D END AS max_person_conf FROM {events}"""
_QUEUE = "SELECT event_id AS n, CAST(ts AS DATE) AS day, CASE WHEN event_type IN ('click','view','signup') THEN 1 ELSE -1 END AS step FROM {events}"
_BURST = "SELECT event_id AS n, event_type AS key, CAST(ts AS DATE) AS day, CAST(floor($EPOCH) AS BIGINT) AS at FROM {events}"

_VIEWS = {
    "fx_log": _LOG, "fx_motion": _MOTION, "fx_det": _DET, "fx_det3": _DET, "fx_emb": _EMB, "fx_ledger": _LEDGER, "fx_listing": _LISTING,
    "fx_poll": _POLL, "fx_health": _HEALTH, "fx_stage": _STAGE, "fx_presence": _PRESENCE, "fx_queue": _QUEUE, "fx_burst": _BURST,
}
_WORDS = {
    "spark": {
        "$FMT": "date_format", "$F14": "yyyyMMddHHmmss", "$FTS": "yyyy-MM-dd HH:mm:ss", "$FD": "yyyy/MM/dd", "$EPOCH": "unix_timestamp(CAST(ts AS TIMESTAMP))",
        "$DOUBLES": "ARRAY<DOUBLE>", "$NOISY": "transform(embedding, (x,i) -> CAST(x AS DOUBLE) + (i % 3 - 1)*0.01D)",
    },
    "duck": {
        "$FMT": "strftime", "$F14": "%Y%m%d%H%M%S", "$FTS": "%Y-%m-%d %H:%M:%S", "$FD": "%Y/%m/%d", "$EPOCH": "epoch(ts)", "$DOUBLES": "DOUBLE[]",
        "$NOISY": "list_transform(CAST(embedding AS DOUBLE[]), lambda x, i: x + ((i-1) % 3 - 1)*0.01)", "0.9D": "0.9", "0.1D": "0.1",
    },
}


def _sql(name: str, dialect: str) -> str:
    sql = _VIEWS[name].replace("$PER", "3" if name == "fx_det3" else "1")
    for k, v in _WORDS[dialect].items():
        sql = sql.replace(k, v)
    return sql


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One view over the tables in ``sf_dir``."""
    sql = _sql(name, "spark")
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in ("events", "embeddings", "orders", "lineitem") if "{" + t + "}" in sql}
    return spark.sql(sql, **tables)


def cte(*names: str) -> str:
    """The views as a WITH list for DuckDB."""
    plain = {t: t for t in ("events", "embeddings", "orders", "lineitem")}
    return ", ".join(f"{n} AS ({_sql(n, 'duck').format(**plain)})" for n in names)


def place_files(spark: SparkSession, staged: str, target: str, name_of) -> None:
    """Move the one file of each folder ``name=...`` below ``staged`` to ``target``, under the name that ``name_of`` gives.

    Spark names the files that it writes; this gives them the names that a listing is about. Files are moved by the shared
    file system, which all machines see: tasks list them, and some threads have them renamed, as each waits for the file system.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path
    fs = path(staged).getFileSystem(conf)
    fs.mkdirs(path(target))
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "part-*").load(staged).select("path")

    def move(row: Row) -> None:
        name = row["path"].rsplit("/", 2)[1].partition("=")[2]
        if not fs.rename(path(row["path"]), path(f"{target}/{name_of(name)}")):
            raise OSError(f"{row['path']} can't be renamed")

    with ThreadPoolExecutor(16) as threads:
        for _ in threads.map(move, files.toLocalIterator()):
            pass


def write_files(spark: SparkSession, rows: DataFrame, target: str) -> None:
    """A file in ``target`` for each row (name, value), with the value as its one line.

    On a file system that is mounted on all machines, tasks write the files under their names. On others Spark stages them.
    """
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    path = jvm.org.apache.hadoop.fs.Path(target)
    fs = path.getFileSystem(conf)
    uri = fs.makeQualified(path).toUri()
    if uri.getScheme() != "file":
        rows.repartition("name").write.partitionBy("name").text(f"{target}-staged")
        place_files(spark, f"{target}-staged", target, lambda name: name)
        return
    fs.mkdirs(path)
    folder = uri.getPath()

    def write(mine: Iterator[Row]) -> None:
        for name, value in mine:
            with open(f"{folder}/{name}", "w", encoding="utf-8") as f:
                f.write(f"{value}\n")

    rows.select("name", "value").foreachPartition(write)
