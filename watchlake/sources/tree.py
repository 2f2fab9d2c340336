"""Directory trees as tables, empty folders included."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.operators.graph import written

ENTRY = "path string, is_dir boolean, length long, mtime timestamp"


def list_tree(spark: SparkSession, root: str, tasks: int | None = None) -> DataFrame:
    """(path, is_dir, length, mtime) of everything below ``root``: files and folders, empty ones too.

    Folders of one depth are listed by tasks, each its share, and the next depth starts from what they found; so the
    number of jobs is the tree's depth, and nothing but that passes through the driver. ``root`` may lie in any file
    system that Arrow opens; paths come back below it as it was written. Its own row isn't in the table.
    """
    root = root.rstrip("/")

    def children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow.fs import FileSelector, FileSystem, FileType

        fs, base = FileSystem.from_uri(root if ":" in root.split("/")[0] else "file://" + root)
        base = base.rstrip("/")
        for b in batches:
            for path in b.column(0).to_pylist():
                found = fs.get_file_info(FileSelector(base + path[len(root) :], recursive=False))
                rows = [(root + x.path[len(base) :], x.type == FileType.Directory, x.size, x.mtime_ns and x.mtime_ns // 1000) for x in found]
                cols = list(zip(*rows)) if rows else ([],) * 4
                kinds = (pa.string(), pa.bool_(), pa.int64(), pa.timestamp("us", "UTC"))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["path", "is_dir", "length", "mtime"])

    n = tasks or spark.sparkContext.defaultParallelism
    level, levels = spark.createDataFrame([(root,)], "path string"), []
    while True:
        found = written(level.mapInArrow(children, ENTRY), "tree")
        levels.append(found)
        level = found.where("is_dir").select("path").repartition(n, "path")
        if not found.where("is_dir").limit(1).count():
            return reduce(DataFrame.unionByName, levels)


def folders(tree: DataFrame) -> DataFrame:
    return tree.where("is_dir").select("path")


def files(tree: DataFrame) -> DataFrame:
    return tree.where(~F.col("is_dir")).select("path", "length", "mtime")
