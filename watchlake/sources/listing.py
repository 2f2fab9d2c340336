"""Listings of files, galleries and result sinks."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.operators.ops import stale_folders


def list_files(spark: SparkSession, path: str, glob: str = "*.mp4") -> DataFrame:
    """(path, modificationTime, length) of files below ``path``; their contents aren't read."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true").load(path).select("path", "modificationTime", "length")


def daily_files(listing: DataFrame) -> DataFrame:
    """Files in folders named YYYYMMDD, with that day, newest first."""
    day = F.regexp_extract("path", r"(?:^|/)(\d{8})/[^/]*$", 1)
    return listing.withColumn("day", day).where("day <> ''").orderBy(F.desc("day"), "path")


def new_files(spark: SparkSession, path: str, files_per_trigger: int = 100) -> DataFrame:
    """A stream of .mp4 files as they appear."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    reader = spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", "*.mp4").option("recursiveFileLookup", "true")
    return reader.option("maxFilesPerTrigger", files_per_trigger).load(path).select("path", "modificationTime", "length")


def append_results(rows: DataFrame, path: str) -> None:
    """Replay results as CSV with a header: timestamp_filename, prior_status, new_status."""
    rows.select(F.col("file").alias("timestamp_filename"), "prior_status", "new_status").write.mode("append").option("header", True).csv(path)


def refresh_gallery(stored: DataFrame, listing: DataFrame, vectors: DataFrame) -> DataFrame:
    """(gallery, path, vector, signature): stored rows of unchanged galleries, new ones for the rest.

    ``stored`` has these columns, ``listing`` (gallery, signature), ``vectors`` (gallery, path, vector).
    """
    same = stored.join(listing, ["gallery", "signature"], "left_semi").select("gallery", "path", "vector", "signature")
    stale = stale_folders(listing, stored.select("gallery", "signature").distinct(), "gallery")
    return same.unionByName(vectors.join(stale, "gallery").select("gallery", "path", "vector", "signature"))
