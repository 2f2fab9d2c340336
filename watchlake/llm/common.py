"""Helpers that the training-data operators share."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterable, Iterator
from contextlib import contextmanager, suppress
from functools import wraps

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """One of the input tables, read by Spark (``sf_dir`` may be any path that Spark understands)."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: ``spark.checkpoint.dir``.

    Where the session names none and Spark runs on one machine, a temporary folder is made and kept for the session.
    """
    sc = spark.sparkContext
    found = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not found:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        found = "file://" + tempfile.mkdtemp(prefix="watchlake-")
        sc.setCheckpointDir(found)
        found = sc.getCheckpointDir()
    return found


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path in the shared folder, deleted when the driver ends."""
    path = f"{shared_dir(spark).rstrip('/')}/watchlake/{tag}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    hadoop = jvm.org.apache.hadoop.fs.Path(path)
    fs = hadoop.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(hadoop)
    return path


def materialize(df: DataFrame, tag: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back.

    Cuts the lineage in one pass over ``df``: the files outlive any executor and later jobs start from them.
    """
    path = shared_path(df.sparkSession, tag)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def listed(rows: DataFrame, most: int = 1_000_000) -> DataFrame:
    """``rows`` of a few numbers each, to be broadcast if they are ``most`` or fewer (tens of MB), and joined by shuffles beyond.

    For written tables only, as the rows are counted. A list against which long texts are held then leaves the texts in place.
    """
    return F.broadcast(rows) if rows.limit(most + 1).count() <= most else rows


@contextmanager
def arrow_batches(spark: SparkSession, most: int = 4 << 20, rows: int = 1024) -> Iterator[None]:
    """What is written inside sends rows to Python in batches of ``most`` bytes, or of one row; the session's limit holds again after.

    A batch is held twice, by the executor outside its heap and by the worker, for each of its tasks. A lower limit of the session stays.
    Parquet files are read ``rows`` rows at a time, which the heap holds, long texts and all, in arrays that double as they fill.
    """
    conf = spark._jsparkSession.sessionState().conf()
    now = conf.arrowMaxBytesPerBatch()
    wanted = {
        "spark.sql.execution.arrow.maxBytesPerBatch": min(most, now) if now > 0 else most,
        "spark.sql.parquet.columnarReaderBatchSize": min(rows, conf.parquetVectorizedReaderBatchSize()),
    }
    before = {key: spark.conf.get(key) for key in wanted}
    for key, value in wanted.items():
        spark.conf.set(key, str(value))
    try:
        yield
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)


def give_back() -> None:
    """Return to the system what this process has freed."""
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):  # another C library than glibc
        ctypes.CDLL(None).malloc_trim(0)


def lean(run: Callable[[Iterator], Iterator]) -> Callable[[Iterator], Iterator]:
    """``run`` for ``mapInArrow`` or ``mapInPandas``; the worker gives back what it has freed after the last batch.

    Spark keeps workers for later tasks, and idle ones would hold the memory of their largest task beside an executor that needs it.
    """

    @wraps(run)
    def whole(batches: Iterator) -> Iterator:
        yield from run(batches)
        give_back()

    return whole


def ascii_lower(text: Column) -> Column:
    """Lower-case A-Z and nothing else."""
    return F.translate(text, UPPER, LOWER)


def fold(doc_id: Column, k: int = 5) -> Column:
    """crc32 of the id as text, modulo ``k``; null ids count as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % k


def free_name(taken: Iterable[str], wanted: str) -> str:
    """``wanted``, with underscores before it until no column has that name (Spark ignores case)."""
    names = {x.lower() for x in taken}
    while wanted.lower() in names:
        wanted = "_" + wanted
    return wanted
