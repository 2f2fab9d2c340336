"""Connected components over a table of links."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchlake.functions.shared import shared_path


def written(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written to the folder that ``spark.checkpoint.dir`` names and read back: a cut of its lineage."""
    spark = df.sparkSession
    path = shared_path(spark, tag)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def connected(pairs: DataFrame, rounds: int = 60) -> DataFrame:
    """(node, component): every node of a link (i, j) with the least node that it reaches.

    Each round, labels move over all links and then jump to their label's label; it ends when none changes.
    Combined before the shuffle, a hub's links count as one row a task. Rounds are written out. Their number grows with the
    logarithm of the longest path; after ``rounds``, which no graph of this world needs, an error is raised.
    """
    both = pairs.select("i", "j").unionAll(pairs.select(F.col("j").alias("i"), F.col("i").alias("j")))
    links = written(both.distinct(), "links")
    labels = written(links.groupBy("i").agg(F.least(F.min("j"), F.first("i")).alias("label")), "labels")
    for _ in range(rounds):
        near = links.join(labels.select(F.col("i").alias("j"), "label"), "j").groupBy("i").agg(F.min("label").alias("near"))
        step = labels.join(near, "i").select("i", "label", F.least("label", "near").alias("best"))
        jump = labels.select(F.col("i").alias("best"), F.col("label").alias("far"))
        new = written(step.join(jump, "best").select("i", F.least("best", "far").alias("label"), "label").toDF("i", "label", "old"), "labels")
        labels = new.select("i", "label")
        if not new.where("label <> old").limit(1).count():
            return labels.select(F.col("i").alias("node"), F.col("label").alias("component"))
    raise RuntimeError(f"labels still change after {rounds} rounds")
