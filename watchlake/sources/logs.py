"""Log files as tables of lines."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.functions import columns as C
from watchlake.operators.graph import written
from watchlake.sources.listing import list_files

DATED_LINE = r"^(?:\[W\] )?(\d{4}-\d{2}-\d{2}) \d{2}:\d{2}:\d{2} - [A-Z]+ - "


def read_lines(spark: SparkSession, path: str | list[str]) -> DataFrame:
    """(file, n, line): the lines of text files below ``path``, or of some paths, with their order.

    Files are read in splits, many tasks a file; ``n`` is the file, the split's start and the line's place in the split.
    It orders lines like a number and is never counted out over a file.
    """
    rows = spark.read.option("recursiveFileLookup", "true").text(path).select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("id"), F.col("value").alias("line")
    )
    return rows.select("file", F.struct("file", "start", "id").alias("n"), "line")


def file_days(lines: DataFrame, stem: str) -> DataFrame:
    """(file, day, lines): rotated files by their name (the last part of a path), the current one by its first dated line."""
    rotated = C.some(F.regexp_extract(C.basename(F.col("file")), rf"^{stem}_(\d{{4}}-\d{{2}}-\d{{2}})\.log$", 1))
    dated = C.some(F.regexp_extract("line", DATED_LINE, 1))
    found = lines.groupBy("file").agg(F.min_by(dated, F.when(dated.isNotNull(), F.col("n"))).alias("first"), F.count("*").alias("lines"))
    return found.select("file", F.coalesce(rotated, "first").alias("day"), "lines")


def log_files(spark: SparkSession, path: str, stem: str) -> DataFrame:
    """(file, day, length) of the log files below ``path``: the current one and rotated ones.

    Names and sizes come from the listing. Only the current file, whose name has no day, is looked into, for its first
    dated line; a file without one has no row.
    """
    name = C.basename(F.col("path"))
    day = C.some(F.regexp_extract(name, rf"^{stem}_(\d{{4}}-\d{{2}}-\d{{2}})\.log$", 1))
    rows = list_files(spark, path, f"{stem}*.log").select(F.col("path").alias("file"), name.alias("name"), day.alias("day"), "length")
    rows = written(rows.where((F.col("name") == f"{stem}.log") | F.col("day").isNotNull()).drop("name"), "log-files")
    undated = [r["file"] for r in rows.where("day IS NULL").select("file").collect()]  # a running log a folder
    if not undated:
        return rows
    first = file_days(read_lines(spark, undated), stem).select("file", F.col("day").alias("first"))
    return rows.join(first, "file", "left").select("file", F.coalesce("day", "first").alias("day"), "length").where("day IS NOT NULL")


def day_lines(spark: SparkSession, files: DataFrame, day: str) -> DataFrame:
    """(n, day, line) of one day: only that day's files, as ``log_files`` lists them, are opened."""
    paths = [r["file"] for r in files.where(F.col("day") == day).select("file").collect()]  # a day's files
    if not paths:
        return spark.createDataFrame([], "n struct<file:string,start:long,id:long>, day date, line string")
    return read_lines(spark, paths).select("n", F.lit(day).cast("date").alias("day"), "line")


def daily_lines(lines: DataFrame, stem: str) -> DataFrame:
    """(n, day, line): each file's lines under the file's day, ready for the parser."""
    days = file_days(lines, stem).select("file", F.to_date("day").alias("day"))
    return lines.join(written(days, "file-days"), "file").select("n", "day", "line")  # Spark sees how many files there are
