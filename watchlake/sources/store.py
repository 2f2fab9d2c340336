"""Tables that operators keep: day statistics, ledgers."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.functions.shared import shared_path
from watchlake.operators import logs


class DayStore:
    """Statistics by day as Parquet; writing a day replaces it, and reading leaves out days that are too old."""

    def __init__(self, spark: SparkSession, path: str, keep_days: int = 90):
        self.spark, self.path, self.keep_days = spark, path, keep_days

    @classmethod
    def temporary(cls, spark: SparkSession, keep_days: int = 90) -> DayStore:
        return cls(spark, shared_path(spark, "day-store"), keep_days)

    def write(self, rows: DataFrame) -> None:
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day").parquet(self.path)

    def read(self) -> DataFrame:
        rows = self.spark.read.parquet(self.path).withColumn("day", F.col("day").cast("date"))
        newest = rows.agg(F.max("day")).first()[0]
        return rows.where(F.col("day") >= F.date_sub(F.lit(newest), self.keep_days)) if newest else rows


class LiveDayStore:
    """Statistics of days whose log is still growing, as states that are merged when they are read.

    Each batch of lines adds the states of its own videos below its number, so it reads nothing but itself, and a batch that
    is tried again replaces what it wrote. A day that is closed is merged once and kept as statistics.
    """

    def __init__(self, spark: SparkSession, path: str, keep_days: int = 90):
        self.spark, self.path = spark, path
        self.closed = DayStore(spark, f"{path}/closed", keep_days)

    @classmethod
    def temporary(cls, spark: SparkSession, keep_days: int = 90) -> LiveDayStore:
        return cls(spark, shared_path(spark, "live-days"), keep_days)

    def add(self, metrics: DataFrame, batch: int) -> None:
        states = logs.video_states(metrics).withColumn("batch", F.lit(batch).cast("long"))
        states.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(f"{self.path}/open")

    def videos(self) -> DataFrame:
        """The summaries of the open days' videos."""
        rows = self.spark.read.parquet(f"{self.path}/open")
        return logs.merged_videos(rows.withColumn("day", F.col("day").cast("date")).drop("batch"))

    def close(self, before: Column) -> None:
        """Keep the statistics of the days before ``before``; their states aren't read any more."""
        self.closed.write(logs.day_entries(self.videos().where(F.col("day") < before)))

    def entries(self) -> DataFrame:
        """Statistics by day: kept ones of closed days, and the others from their states."""
        try:
            kept = self.closed.read()
        except AnalysisException:  # none is closed yet
            return logs.day_entries(self.videos())
        done = kept.select("day").distinct()
        return kept.unionByName(logs.day_entries(self.videos().join(done, "day", "left_anti")))


def read_ledger(text: DataFrame, value: str = "value") -> DataFrame:
    """(path, status, ...) of a ledger kept as one JSON map from path to entry; broken text has no rows."""
    entry = "status string, detected_ts double, start_ts double, end_ts double, fast_processing boolean, telegram_status string"
    parsed = F.from_json(F.col(value), f"map<string, struct<{', '.join(x.replace(' ', ': ', 1) for x in entry.split(', ')) }>>")
    return text.select(F.explode(parsed).alias("path", "entry")).select("path", "entry.*")


def save_ledger(rows: DataFrame, path: str) -> None:
    """A ledger, with a row a path, as text that ``read_ledger`` understands: a JSON map with one entry a line.

    Null fields are left out. What ``path`` held before is replaced, so rows read from there must be written elsewhere first.
    """
    entry = F.struct(*(c for c in rows.columns if c != "path"))
    rows.select(F.to_json(F.create_map(F.col("path"), entry)).alias("value")).write.mode("overwrite").text(path)


def load_ledger(spark: SparkSession, path: str) -> DataFrame:
    return read_ledger(spark.read.text(path))
