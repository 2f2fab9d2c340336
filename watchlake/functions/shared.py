"""The folder that driver and executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import SparkSession


def shared_path(spark: SparkSession, tag: str) -> str:
    """A new path below ``spark.checkpoint.dir``, deleted when the driver ends.

    A temporary folder stands in only where Spark runs on one machine.
    """
    sc = spark.sparkContext
    root = sc.getConf().get("spark.checkpoint.dir") or sc.getCheckpointDir()
    if not root:
        if not sc.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all machines share")
        root = "file://" + tempfile.mkdtemp(prefix="watchlake-")
        sc.setCheckpointDir(root)
        root = sc.getCheckpointDir()
    path = f"{root.rstrip('/')}/{tag}-{uuid.uuid4().hex}"
    hadoop = sc._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(sc._jsc.hadoopConfiguration()).deleteOnExit(hadoop)
    return path
