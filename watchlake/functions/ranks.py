"""Numbers over a whole table without a single task that sees it all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchlake.operators.graph import written


def numbered(df: DataFrame, name: str, *order: Column) -> DataFrame:
    """``df`` with its rows' places, from 1, in an order that tells all rows apart.

    Tasks sort ranges of the order; a row's place is its place in its range plus the rows of the ranges before,
    of which the driver sees one count a task.
    """
    rows = df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id())
    rows = written(rows, "ranges").withColumn("_task", F.shiftright("_id", 33))
    before, starts = 0, []
    for r in rows.groupBy("_task").count().orderBy("_task").collect():
        starts.append((r["_task"], before))
        before += r["count"]
    offsets = df.sparkSession.createDataFrame(starts, "_task long, _start long")
    place = F.col("_start") + F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)) + 1
    return rows.join(F.broadcast(offsets), "_task").withColumn(name, place).drop("_id", "_task", "_start")
