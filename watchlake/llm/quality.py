"""Quality scores: ridge regression on random Fourier features of document statistics, with isotonic calibration.

The features approximate a Gaussian kernel over standardised statistics. Each partition sums its own normal
equations; the sums are added row by row over several tasks, and the driver solves one system of fixed size.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.llm.common import arrow_batches, fold, free_name, lean, materialize, table
from watchlake.llm.labelled import BOUND, Isotonic, labelled_sample

LETTER = re.compile(r"[^\W\d_]+")
DIGIT = re.compile(r"\d+")
SIGN = re.compile(r"[^\w\s]+")
UPPER = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
ODD_END = re.compile(r"[%&$#*|@~^=<>]+(?=\s|$)")
STATISTICS = (
    "log_words log_mean_length log_sd_length distinct top_share repeats letters digits signs upper odd_ends exclamations bars log_lines "
    "log_line_words same_lines entropy stops"
).split()


def statistics(text: str | None) -> list[float]:
    """Numbers about a text; one without words has zeros."""
    text = text or ""
    words = text.split()
    if not words:
        return [0.0] * len(STATISTICS)
    n, chars = len(words), len(text)
    counts = Counter(words)
    sizes = np.fromiter(map(len, words), float, n)
    lines = [x for x in text.split("\n") if x.strip()]
    left = lambda pattern: (chars - len(pattern.sub("", text))) / chars
    shares = np.fromiter(counts.values(), float, len(counts)) / n
    return [
        math.log1p(n), math.log1p(float(sizes.mean())), math.log1p(float(sizes.std())), len(counts) / n, float(shares.max()),
        sum(map(str.__eq__, words, words[1:])) / n, left(LETTER), left(DIGIT), left(SIGN), left(UPPER), len(ODD_END.findall(text)) / n,
        text.count("!") / n, text.count("|") / n, math.log1p(len(lines)), math.log1p(n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)), float(-(shares * np.log(shares)).sum()) / math.log(n + 1), (text.count(". ") + text.count(".\n")) / n,
    ]


REACH = 6.0  # deviations from the mean at which a statistic stops to count


class QualityModel:
    """Standardisation, frequencies, weights and calibration; scores without labels, language, source or id."""

    def __init__(self, mean, scale, omega, phase, weights, isotonic: Isotonic | None, constant: float | None = None, reach: float = REACH):
        self.mean, self.scale, self.omega, self.phase, self.weights, self.isotonic, self.constant, self.reach = mean, scale, omega, phase, weights, isotonic, constant, reach

    def features(self, x: np.ndarray) -> np.ndarray:
        """Fourier features and a constant. A statistic further than ``reach`` deviations from its mean counts as that far: the kernel is flat there."""
        z = np.clip((x - self.mean) / self.scale, -self.reach, self.reach)
        return np.hstack([np.sqrt(2 / self.omega.shape[1]) * np.cos(z @ self.omega + self.phase), np.ones((len(x), 1))])

    def margin(self, x: np.ndarray) -> np.ndarray:
        return 8 * (self.features(x) @ self.weights - 0.5)

    def score(self, docs: DataFrame, name: str = "score", text: str = "text") -> DataFrame:
        """``docs`` and the score of each row.

        A null text scores as an empty one; texts of any length are read whole. Repeated rows and equal texts score alike.
        An empty table stays empty. A column called ``name`` is replaced; other columns may have any names.
        """
        docs = docs.drop(name)
        schema = docs.select("*").schema.add(name, "double")
        at, names = docs.columns.index(text), [*docs.columns, name]

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for start in range(0, whole.num_rows, 512):
                    b = whole.slice(start, 512)
                    if self.constant is not None:
                        made = np.full(b.num_rows, self.constant)
                    else:
                        made = self.isotonic(self.margin(np.array([statistics(t.as_py()) for t in b.column(at)])))
                    yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.float64())], names=names)

        return docs.mapInArrow(lean(run), schema)


def with_statistics(sample: DataFrame) -> DataFrame:
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"x": [statistics(t) for t in pdf["text"]], "label": pdf["label"], "lot": pdf["lot"]})

    return sample.select("text", "label", "lot").mapInPandas(lean(run), "x array<double>, label double, lot int")


def normal_equations(rows: DataFrame, model: QualityModel, fan_in: int = 8, parts: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """The sums of z z' and z y over ``rows``: one packed matrix for each partition that has rows, added in a tree.

    ``rows`` is a bounded sample, however many files it lies in; it is read in ``parts`` partitions (as many as there are
    cores). A task adds ``fan_in`` matrices at most, and the driver the last ``fan_in``. Rows need x and label, without nulls; repeated
    ones count each; without rows the sums are zero.
    """
    size = model.omega.shape[1] + 1
    parts = parts or max(1, rows.sparkSession.sparkContext.defaultParallelism)

    def per_partition(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        total = None
        for pdf in batches:
            if len(pdf):
                z = model.features(np.stack(pdf["x"].to_numpy()))
                now = z.T @ np.hstack([z, pdf["label"].to_numpy(float)[:, None]])
                total = now if total is None else total + now
        if total is not None:
            yield pd.DataFrame({"total": [total.tobytes()]})

    def add(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        total = np.sum([np.frombuffer(x, float) for x in pdf["total"]], axis=0)
        return pd.DataFrame({"part": [key[0]], "total": [total.tobytes()]})

    sums = rows.select("x", "label").coalesce(parts).mapInPandas(lean(per_partition), "total binary").select(F.spark_partition_id().cast("long").alias("part"), "total")
    while parts > fan_in:
        sums = sums.withColumn("part", F.floor(F.col("part") / fan_in)).groupBy("part").applyInPandas(add, "part long, total binary")
        parts = -(-parts // fan_in)
    total = sum((np.frombuffer(r["total"], float).reshape(size, size + 1) for r in sums.select("total").collect()), np.zeros((size, size + 1)))
    return total[:, :size], total[:, size]


def fit_quality(docs: DataFrame, labels: DataFrame, bound: int = BOUND, dim: int = 256, ridge: float = 1e-3, seed: int = 3, reach: float = REACH) -> QualityModel:
    """Learn from the labelled sample of ``docs``: the ridge on three quarters, the calibration on the rest.

    Null ids, null labels and labels without a document are left out; null and empty texts are texts without words.
    Repeated ids take the larger label, and each of their rows is learned from. If the sample is empty or has one class
    only, the model is a constant: the share of good rows with one row of each class added. Only doc_id and text of
    ``docs`` and doc_id and quality of ``labels`` are read, whatever other columns there are.
    """
    rows = materialize(with_statistics(labelled_sample(docs, labels, "quality", bound=bound)), "quality-sample")
    k = len(STATISTICS)
    moments = rows.select(*(F.col("x")[i].alias(f"x{i}") for i in range(k)), "label")
    got = moments.agg(F.count("*"), F.sum("label"), *(F.avg(f"x{i}") for i in range(k)), *(F.stddev_pop(f"x{i}") for i in range(k))).first()
    n, pos = got[0], got[1] or 0.0
    if not 0 < pos < n:
        return QualityModel(None, None, None, None, None, None, (pos + 1) / (n + 2))
    rng = np.random.default_rng(seed)
    mean, scale = np.array(got[2 : 2 + k], float), np.maximum(np.array(got[2 + k :], float), 1e-6)
    omega = rng.normal(size=(k, dim)) / (0.8 * math.sqrt(k))
    model = QualityModel(mean, scale, omega, rng.uniform(0, 2 * math.pi, dim), None, None, reach=reach)
    train = rows.where("lot < 75")
    a, b = normal_equations(train, model)
    model.weights = np.linalg.solve(a + ridge * max(1.0, a[-1, -1]) * np.eye(len(a)), b)
    held = rows.where("lot >= 75").toPandas()
    x = np.stack(held["x"].to_numpy()) if len(held) else np.zeros((0, k))
    model.isotonic = Isotonic(model.margin(x), held["label"].to_numpy(float))
    return model


def keep_quality(docs: DataFrame, labels: DataFrame, threshold: float = 0.3) -> DataFrame:
    """``docs`` without the rows that score under ``threshold``, with their own columns.

    Rows of null or repeated ids are judged by their own texts; null and empty texts score as texts without words. An
    empty table gives an empty result. Without labels of both classes nothing can be told apart, and every row stays.
    The rows that stay are written here, as only so long texts reach Python in small batches.
    """
    name = free_name(docs.columns, "quality_score")
    with arrow_batches(docs.sparkSession):
        model = fit_quality(docs, labels)
        if model.constant is not None:
            return docs
        return materialize(model.score(docs, name).where(F.col(name) >= threshold).select(*docs.columns), "good")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document; null and empty texts are scored too, repeated rows each on its own, an empty table stays empty."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit_quality(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.3).cast("int").alias("predicted"))
