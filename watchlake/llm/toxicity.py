"""Toxicity scores: gradient-boosted trees over dense features of a text, with isotonic calibration.

A lexicon is learned from the labelled sample: words and beginnings of words that toxic documents hold far more
often. Features: densities of the lexicon and of a fixed one, how close second-person words are to hits,
capitals, punctuation and obfuscation rates. While the trees are fitted, the features of each half of the
sample come from the lexicon of the other half.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from itertools import chain, islice

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from watchlake.llm.common import arrow_batches, fold, free_name, lean, materialize, table
from watchlake.llm.labelled import BOUND, Isotonic, labelled_sample

# Common insults of English.
INSULTS = frozenset(
    "idiot idiots idiotic stupid moron morons moronic imbecile dumb dumbass fool loser losers scum trash garbage worthless pathetic "
    "disgusting clown coward liar jerk creep pig filth filthy vermin parasite freak bastard bitch whore slut asshole "
    "retard retarded hate kill die shut ugly fat nazi".split()
)
# Words for the person spoken to, in four languages.
SECOND_PERSON = frozenset(
    "you your yours yourself yourselves u ur ya tu te toi vous votre vos ton ta tes du dich dir dein deine ihr euch euer "
    "tú ti usted ustedes vosotros vuestro tus".split()
)
LEET = str.maketrans({"0": "o", "1": "i", "3": "e", "4": "a", "5": "s", "7": "t", "@": "a", "$": "s", "!": "i"})
LETTERS = re.compile(r"[^\W\d_]")
NOT_LETTERS = re.compile(r"[\W\d_]+")
EDGES = re.compile(r"^[\W_]+|[\W_]+$")
NEAR = 5  # words
FEATURES = (
    "hits max_weight sum_weight distinct_hits insults near_second second capitals all_caps punctuation exclamations obfuscated "
    "obfuscated_hits log_words long_runs"
).split()


def units(word: str) -> list[str]:
    """What the lexicon may hold of a word: its beginnings of 4 to 8 letters, marked, and itself."""
    return [word] + [word[:k] + "*" for k in (4, 5, 6, 7, 8) if len(word) > k]


def plain(token: str) -> tuple[str, bool]:
    """A token's word in lower case, and whether it hides letters behind digits or signs."""
    core = EDGES.sub("", token)
    if core.isalpha():
        return core.lower(), False
    if not LETTERS.search(core):
        return "", False
    return NOT_LETTERS.sub("", core.lower().translate(LEET)), "'" not in core and "’" not in core and "-" not in core


class Tokens(dict):
    """Token -> its row in a table of numbers about tokens. Tokens of equal numbers share a row, those that hit have their own."""

    COLUMNS = "weight hit insult second hidden hidden_hit caps upper signs exclamations long_runs letters".split()

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.heads = lexicon, {u[:4] for u in lexicon}
        self.rows: dict[tuple, int] = {}
        self.table = np.zeros((len(self.COLUMNS), 0))

    def __missing__(self, token: str) -> int:
        size = len(token)
        signs = 0 if token.isalpha() else 1 if token[-1] in ".,;:" and token[:-1].isalpha() else -1
        word = token[:-1] if signs == 1 else token
        if signs >= 0 and word.islower():  # most tokens: a word in small letters, with a sign after it or not
            hides = caps = False
            upper = exclamations = 0
        else:
            word, hides = plain(token)
            caps = size > 1 and token.isupper() and token.isalpha()
            upper, signs, exclamations = size - len(UPPER_RUN.sub("", token)), size - len(SIGNS.sub("", token)), token.count("!")
        weight = max((self.lexicon.get(u, 0.0) for u in units(word)), default=0.0) if word[:4] in self.heads else 0.0
        insult = word in INSULTS
        hit = bool(weight or insult)
        runs = len(LONG_RUN.findall(token)) if len(set(token)) <= size - 3 else 0
        numbers = (weight, hit, insult, word in SECOND_PERSON, hides, hides and hit, caps, upper, signs, exclamations, runs, size)
        self[token] = at = self.rows.setdefault((*numbers, token if hit else None), len(self.rows))
        return at

    def numbers(self) -> np.ndarray:
        if len(self.rows) > self.table.shape[1]:
            fresh = [x[:-1] for x in islice(self.rows, self.table.shape[1], None)]
            self.table = np.hstack([self.table, np.array(fresh, float).T])
        return self.table


class Extractor:
    """Features of texts under a lexicon (unit -> weight). A token is looked at once and then read from a table."""

    def __init__(self, lexicon: dict[str, float]):
        self.lexicon, self.tokens = lexicon, Tokens(lexicon)

    def __getstate__(self):
        return {"lexicon": self.lexicon}

    def __setstate__(self, state):
        self.__init__(state["lexicon"])

    def __call__(self, text: str | None) -> list[float]:
        return self.many([text])[0].tolist()

    def many(self, texts: list[str | None]) -> np.ndarray:
        """A row of features for each text; texts without words have zeros."""
        out = np.zeros((len(texts), len(FEATURES)))
        split = [(t or "").split() for t in texts]
        full = np.flatnonzero([len(ws) > 0 for ws in split])
        if not len(full):
            return out
        if len(self.tokens) > 50_000:  # bounds memory; tokens come back as they are seen
            self.tokens = Tokens(self.lexicon)
        sizes = np.array([len(split[i]) for i in full], np.int64)
        at = np.fromiter(map(self.tokens.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        columns = dict(zip(Tokens.COLUMNS, self.tokens.numbers()))
        starts = np.cumsum(sizes) - sizes
        total = {c: np.add.reduceat(v[at], starts) for c, v in columns.items()}
        doc = np.repeat(np.arange(len(full)), sizes)
        hit, you = columns["hit"][at] > 0, columns["second"][at] > 0
        distinct = np.bincount(np.unique(doc[hit] * len(self.tokens.rows) + at[hit]) // len(self.tokens.rows), minlength=len(full))
        near = np.bincount(doc[_beside(np.flatnonzero(hit & ~you), np.flatnonzero(you), doc)], minlength=len(full))
        n, chars = sizes.astype(float), np.array([len(texts[i]) for i in full], float)
        out[full] = np.column_stack([
            total["hit"] / n, np.maximum.reduceat(columns["weight"][at], starts), total["weight"] / n, distinct, total["insult"] / n,
            near / np.maximum(1.0, total["hit"]), total["second"] / n, total["upper"] / chars, total["caps"] / n, total["signs"] / chars,
            total["exclamations"] / n, total["hidden"] / n, total["hidden_hit"] / n, np.log1p(n), total["long_runs"] / total["letters"],
        ])
        return out


def _beside(hits: np.ndarray, yous: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """The places in ``hits`` with one of ``yous`` in the same text within ``NEAR`` words before or after."""
    if not len(yous):
        return hits[:0]
    k = np.searchsorted(yous, hits)
    ok = np.zeros(len(hits), bool)
    for other in (yous[np.maximum(k - 1, 0)], yous[np.minimum(k, len(yous) - 1)]):
        ok |= (np.abs(other - hits) <= NEAR) & (doc[other] == doc[hits])
    return hits[ok]


UPPER_RUN = re.compile(r"[A-ZÀ-ÖØ-Þ]+")
SIGNS = re.compile(r"[!-/:-@\[-`{-~]+")
LONG_RUN = re.compile(r"([^\W\d_])\1{3,}")


def lexicon_counts(sample: DataFrame, flush: int = 100_000) -> DataFrame:
    """(unit, pos0, neg0, pos1, neg1): documents of either half of the sample that hold a unit, by label."""
    names = ("pos0", "neg0", "pos1", "neg1")

    def rows(counts: list[Counter]) -> pa.RecordBatch:
        every = list(set().union(*counts))
        made = [pa.array([x[u] for u in every], pa.int64()) for x in counts]
        return pa.RecordBatch.from_arrays([pa.array(every, pa.string()), *made], names=["unit", *names])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: list[Counter] = [Counter() for _ in names]
        known: dict[str, list[str]] = {}
        for b in batches:
            for text, label, lot in zip(*(c.to_pylist() for c in b.columns)):
                held: set[str] = set()
                for token in set((text or "").split()):
                    if (got := known.get(token)) is None:
                        word = plain(token)[0]
                        got = known[token] = units(word) if word else []
                    held.update(got)
                counts[2 * (lot % 2) + (label < 0.5)].update(held)
                if max(len(known), *map(len, counts)) > flush:  # bounds memory: counts are added up after the shuffle
                    yield rows(counts)
                    counts = [Counter() for _ in names]
                    known.clear()
        yield rows(counts)

    some = sample.select("text", "label", "lot").mapInArrow(lean(run), "unit string, pos0 long, neg0 long, pos1 long, neg1 long")
    return some.groupBy("unit").agg(*(F.sum(c).alias(c) for c in names))


def lexicons(sample: DataFrame, least: float = 0.8, sureness: float = 2.2) -> list[dict[str, float]]:
    """Lexicons of half 0, of half 1 and of both: all units whose log odds have a lower bound above ``least``.

    The sample is bounded, and so is what can pass the bound.
    """
    sizes = sample.groupBy().agg(*(F.count_if(F.expr(f"lot % 2 = {h} AND label {'>=' if y else '<'} 0.5")) for h in (0, 1) for y in (1, 0))).first()
    p0, n0, p1, n1 = (float(x) for x in sizes)

    def weight(pos: str, neg: str, p: float, n: float) -> Column:
        return F.expr(f"log(({pos} + 0.5) / {p + 1}) - log(({neg} + 0.5) / {n + 1}) - {sureness} * sqrt(1 / ({pos} + 0.5) + 1 / ({neg} + 0.5))")

    sides = [("pos0", "neg0", p0, n0), ("pos1", "neg1", p1, n1), ("pos0 + pos1", "neg0 + neg1", p0 + p1, n0 + n1)]
    found = lexicon_counts(sample).select("unit", *(weight(*side).alias(f"w{k}") for k, side in enumerate(sides)))
    out: list[dict[str, float]] = [{}, {}, {}]
    for r in found.where(" OR ".join(f"w{k} > {least}" for k in range(3))).collect():
        for k, lexicon in enumerate(out):
            if r[f"w{k}"] > least:
                lexicon[r["unit"]] = r[f"w{k}"]
    return out


def with_features(docs: DataFrame, extractor: Extractor, name: str, text: str = "text") -> DataFrame:
    """``docs`` and an array of the text's features."""
    schema = docs.select("*").schema.add(name, ArrayType(DoubleType()))
    at, names = docs.columns.index(text), [*docs.columns, name]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for start in range(0, whole.num_rows, 512):
                b = whole.slice(start, 512)
                x = extractor.many(b.column(at).to_pylist())
                made = pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))
                yield pa.RecordBatch.from_arrays([*b.columns, made], names=names)

    return docs.mapInArrow(lean(run), schema)


class ToxicityModel:
    """A lexicon, boosted trees and a calibration; ``constant`` if the sample has one class only."""

    def __init__(self, extractor: Extractor, trees, isotonic: Isotonic | None, constant: float | None):
        self.extractor, self.trees, self.isotonic, self.constant = extractor, trees, isotonic, constant

    def score(self, docs: DataFrame, name: str = "score", text: str = "text") -> DataFrame:
        """``docs`` and the score of each row.

        Null and empty texts are scored as texts without words; a text of any length is read whole. Repeated rows and
        equal texts score alike. An empty table stays empty. A column called ``name`` is replaced; other columns may
        have any names, as the columns made on the way take free ones.
        """
        from pyspark.ml.functions import array_to_vector, vector_to_array

        docs = docs.drop(name)
        if self.constant is not None:
            return docs.withColumn(name, F.lit(self.constant))
        features = free_name([*docs.columns, name], "toxicity_features")
        raw = [free_name([*docs.columns, name, features], f"toxicity_{x}") for x in ("vector", "raw", "probability", "prediction")]
        found = with_features(docs, self.extractor, features, text).withColumn(raw[0], array_to_vector(features))
        trees = self.trees.setFeaturesCol(raw[0]).setRawPredictionCol(raw[1]).setProbabilityCol(raw[2]).setPredictionCol(raw[3])
        margin = free_name([*docs.columns, name, features, *raw], "toxicity_margin")
        made = trees.transform(found).withColumn(margin, vector_to_array(raw[1])[1])
        rank = 1 / (1 + F.exp(-F.col(margin)))
        calibrated = 0.99 * between(F.col(margin), self.isotonic.x, self.isotonic.y) + 0.01 * rank
        return made.select(*docs.columns, calibrated.alias(name))


def between(x: Column, xs: list[float], ys: list[float]) -> Column:
    """Linear interpolation between points of rising x; level beyond the ends."""
    out = F.when(x <= xs[0], F.lit(float(ys[0])))
    for a, b, ya, yb in zip(xs, xs[1:], ys, ys[1:]):
        if b > a:
            out = out.when(x <= b, F.lit(float(ya)) + (x - a) * ((yb - ya) / (b - a)))
    return out.otherwise(F.lit(float(ys[-1])))


def fit_toxicity(docs: DataFrame, labels: DataFrame, bound: int = BOUND, trees: int = 24, depth: int = 3) -> ToxicityModel:
    """Learn from the labelled sample of ``docs``: trees on three quarters, the calibration on the rest.

    Null ids, null labels and labels without a document are left out; null and empty texts are texts without words.
    Repeated ids take the larger label, and each of their rows is learned from. If the sample is empty or has one class
    only, the model is a constant: the share of toxic rows with one row of each class added. Only doc_id and text of
    ``docs`` and doc_id and toxic of ``labels`` are read, whatever other columns there are.
    """
    from pyspark.ml.classification import GBTClassifier
    from pyspark.ml.functions import array_to_vector, vector_to_array

    sample = materialize(labelled_sample(docs, labels, "toxic", bound=bound), "toxic-sample")
    n, pos = sample.agg(F.count("*"), F.coalesce(F.sum("label"), F.lit(0.0))).first()
    first, second, both = lexicons(sample) if 0 < pos < n else ({}, {}, {})
    if not 0 < pos < n:
        return ToxicityModel(Extractor(both), None, None, (pos + 1) / (n + 2))
    crossed = [with_features(sample.where(f"lot % 2 = {h}"), Extractor(lex), "features") for h, lex in ((0, second), (1, first))]
    # the bounded sample's numbers, in one order whatever the partitions were: reruns grow the same trees
    rows = crossed[0].unionByName(crossed[1]).select("features", "label", "lot").repartition(1).sortWithinPartitions("lot", "label", "features")
    rows = materialize(rows.withColumn("features", array_to_vector("features")), "toxic-features")
    fitted = GBTClassifier(featuresCol="features", labelCol="label", maxIter=trees, maxDepth=depth, stepSize=0.2, seed=5, minInstancesPerNode=2)
    model = fitted.fit(rows.where("lot < 75"))
    held = model.transform(rows.where("lot >= 75")).select(vector_to_array("rawPrediction")[1].alias("m"), "label").toPandas()
    return ToxicityModel(Extractor(both), model, Isotonic(held["m"].to_numpy(float), held["label"].to_numpy(float)), None)


def drop_toxic(docs: DataFrame, labels: DataFrame, threshold: float = 0.5) -> DataFrame:
    """``docs`` without the rows that score ``threshold`` or more, with their own columns.

    Rows of null or repeated ids are judged by their own texts; null and empty texts score as texts without words. An
    empty table gives an empty result. Without labels of both classes nothing can be told apart, and every row stays.
    The rows that stay are written here, as only so long texts reach Python in small batches.
    """
    name = free_name(docs.columns, "toxicity_score")
    with arrow_batches(docs.sparkSession):
        model = fit_toxicity(docs, labels)
        if model.constant is not None:
            return docs
        return materialize(model.score(docs, name).where(F.col(name) < threshold).select(*docs.columns), "not-toxic")


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The table's documents; null and empty texts are scored too, and repeated rows each on its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    scored = fit_toxicity(docs, table(spark, sf_dir, "labels")).score(docs)
    return scored.select("doc_id", (fold(F.col("doc_id")) == 0).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
