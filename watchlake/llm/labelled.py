"""Labelled samples and calibration, as the classifiers share them."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from watchlake.llm.common import fold

BOUND = 20_000


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, text: str = "text", bound: int = BOUND) -> DataFrame:
    """(text, label, lot): the texts of labelled documents to learn from, ``bound`` of them or so.

    Only rows whose crc32(doc_id as text) modulo 5 isn't 0 are used. If there are more, those with the least
    hash of doc_id are taken. Labels of an id that repeats are the larger one; null ids and labels are left out.
    ``lot`` is a number from 0 to 99 that hangs on the id only, for splits. The ids are broadcast: ``bound``
    is their number at most, give or take the hash's chance.
    """
    known = labels.select(F.col("doc_id").alias("label_id"), F.col(label).cast("double").alias("label")).where("label_id IS NOT NULL AND label IS NOT NULL")
    known = known.where(fold(F.col("label_id")) != 0).groupBy("label_id").agg(F.max("label").alias("label"))
    n = known.count()
    share = int(min(1.0, bound / max(1, n)) * (1 << 30))
    known = known.where(F.pmod(F.xxhash64("label_id", F.lit(5)), F.lit(1 << 30)) <= share)
    rows = docs.select(F.col("doc_id").alias("label_id"), F.col(text).alias("text")).join(F.broadcast(known), "label_id")
    return rows.select("text", "label", F.pmod(F.xxhash64("label_id", F.lit(9)), F.lit(100)).cast("int").alias("lot"))


class Isotonic:
    """A rising step function fitted by pooling neighbours, on a bounded sample of (margin, label)."""

    def __init__(self, margin: np.ndarray, label: np.ndarray):
        order = np.argsort(margin, kind="stable")
        x, starts = np.unique(margin[order], return_index=True)
        n = np.diff(np.append(starts, len(order))).astype(float)
        y = np.add.reduceat(label[order].astype(float), starts) / n if len(x) else n
        pools: list[list[float]] = []  # mean, weight, first x, last x
        for xi, yi, ni in zip(x.tolist(), y.tolist(), n.tolist()):
            pools.append([yi, ni, xi, xi])
            while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
                b, a = pools.pop(), pools.pop()
                w = a[1] + b[1]
                pools.append([(a[0] * a[1] + b[0] * b[1]) / w, w, a[2], b[3]])
        # a prior of two rows at the overall mean keeps small pools off 0 and 1
        mean = float(label.mean()) if len(label) else 0.5
        self.x = [v for p in pools for v in (p[2], p[3])] or [0.0]
        self.y = [(p[0] * p[1] + 2 * mean) / (p[1] + 2) for p in pools for _ in (0, 1)] or [mean]
        self.y = np.maximum.accumulate(self.y).tolist()

    def __call__(self, margin: np.ndarray) -> np.ndarray:
        """Linear between pools. A hundredth of the score keeps the order of margins within a pool."""
        rank = 1 / (1 + np.exp(-np.clip(margin, -30, 30)))
        return np.clip(0.99 * np.interp(margin, self.x, self.y) + 0.01 * rank, 0.0, 1.0)
