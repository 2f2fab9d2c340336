"""Embedding analytics: matches against galleries, decisions per clip, diverse choices, duplicate groups."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from watchlake.functions import columns as C
from watchlake.operators.graph import connected, written
from watchlake.params import ReidParams

BLOCK = 4096  # vectors of a side in one task
BLOCKS = 24  # a row goes to so many other blocks at most, until blocks are GROWN times as large
GROWN = 8


def _unit(v: pd.Series) -> np.ndarray:
    m = np.stack(v.to_numpy()).astype(float)
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return m / np.where(n > 0, n, 1.0)


def _blocks(df: DataFrame, n: int) -> tuple[Column, int]:
    """A block for each row by hash of its id, and how many there are."""
    k = max(1, -(-n // BLOCK))
    return F.pmod(F.xxhash64("id"), F.lit(k)).cast("int"), k


def best_match(probes: DataFrame, gallery: DataFrame, *also: str) -> DataFrame:
    """(id, also, best, best_id): each probe's largest cosine to a gallery vector, 0 at least, and whose it is (least id of equals).

    Both sides have (id, v). They are cut into blocks; a task gets one block of each and multiplies matrices; the
    blocks' best are combined. Rows of one id count as one probe if they agree on the columns ``also`` as well. A probe without any positive cosine has best 0 and no best_id.
    """
    pb, np_ = _blocks(probes, probes.count())
    gb, ng = _blocks(gallery, gallery.count())
    key = ["id", *also]
    grid = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    a = probes.select("id", *also, "v", pb.alias("p")).withColumn("g", grid(ng))
    b = gallery.select(F.col("id").alias("g_id"), F.col("v").alias("g_v"), gb.alias("g")).withColumn("p", grid(np_))

    def top(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return x[key].assign(best=0.0, best_id=None)
        y = y.sort_values("g_id")
        s = np.round(_unit(x["v"]) @ _unit(y["g_v"]).T, 12)
        k = s.argmax(axis=1)
        best = s[np.arange(len(x)), k]
        return x[key].assign(best=np.maximum(best, 0.0), best_id=[i if s_ > 0 else None for i, s_ in zip(y["g_id"].to_numpy()[k], best)])

    kind = gallery.schema["id"].dataType.simpleString()
    own = ", ".join(f"{c} {probes.schema[c].dataType.simpleString()}" for c in key)
    found = a.groupBy("p", "g").cogroup(b.groupBy("p", "g")).applyInPandas(top, f"{own}, best double, best_id {kind}")
    return found.groupBy(*key).agg(F.max("best").alias("best"), F.min_by("best_id", F.struct(-F.col("best"), "best_id")).alias("best_id"))


def identify(probes: DataFrame, positives: DataFrame, negatives: DataFrame, p: ReidParams = ReidParams(), also: tuple[str, ...] = ()) -> DataFrame:
    """(id, also, pos, pos_id, neg, neg_id, matched): matched if pos reaches the threshold and leads neg by the margin."""
    pos = best_match(probes, positives, *also).toDF("id", *also, "pos", "pos_id")
    neg = best_match(probes, negatives, *also).toDF("id", *also, "neg", "neg_id")
    rows = pos.join(neg, ["id", *also], "left").fillna(0.0, ["neg"])
    return rows.withColumn("matched", (F.col("pos") >= p.threshold) & (F.col("pos") - F.col("neg") >= p.margin))


def clip_decision(scored: DataFrame, p: ReidParams = ReidParams()) -> DataFrame:
    """(video, best_pos, best_id, max_neg, samples, matched): over all crops of a clip, scores at four digits."""
    rows = scored.groupBy("video").agg(
        F.max("pos").alias("best_pos"), F.min_by("id", F.struct(-F.col("pos"), "id")).alias("best_id"), F.max("neg").alias("max_neg"), F.count("*").alias("samples")
    )
    matched = (F.col("best_pos") >= p.threshold) & (F.col("best_pos") - F.col("max_neg") >= p.margin)
    return rows.select("video", F.round("best_pos", 4).alias("best_pos"), "best_id", F.round("max_neg", 4).alias("max_neg"), "samples", matched.alias("matched"))


class Space:
    """Leading axes of a sample of unit vectors, and boxes of a kd-tree over their coordinates there.

    Any orthogonal axes bound distances from below, and boxes cover all of space, so the sample decides how much work is
    saved and nothing else.
    """

    def __init__(self, sample: np.ndarray, axes: int, cells: int, split: int = 3):
        self.split = split  # cells that are cut on few axes are narrow there, and so lie apart
        self.axes = np.linalg.eigh(np.cov(sample.T).reshape(sample.shape[1], -1))[1][:, ::-1][:, :axes] if len(sample) > 1 else np.eye(sample.shape[1])[:, :axes]
        x = sample @ self.axes
        lo, hi = np.full(x.shape[1], -np.inf), np.full(x.shape[1], np.inf)
        self.cuts: list[tuple[int, float, int, int]] = []  # axis, place, node below, node above; a leaf's axis is -1 and its place the cell
        self.boxes: list[tuple[np.ndarray, np.ndarray]] = []
        self._grow(x, lo, hi, cells)

    def _grow(self, x: np.ndarray, lo: np.ndarray, hi: np.ndarray, cells: int) -> int:
        me = len(self.cuts)
        self.cuts.append((-1, len(self.boxes), 0, 0))
        axis = int(np.ptp(x[:, : self.split], axis=0).argmax()) if len(x) > 1 else 0
        at = float(np.median(x[:, axis])) if len(x) > 1 else 0.0
        below = x[:, axis] < at if len(x) > 1 else np.zeros(0, bool)
        if cells < 2 or not below.any():
            self.boxes.append((lo, hi))
            return me
        edge = hi.copy()
        edge[axis] = at
        left = self._grow(x[below], lo, edge, cells // 2)
        edge = lo.copy()
        edge[axis] = at
        right = self._grow(x[~below], edge, hi, cells - cells // 2)
        self.cuts[me] = (axis, at, left, right)
        return me

    def cell(self, x: np.ndarray) -> np.ndarray:
        """The cell of each row of coordinates."""
        node = np.zeros(len(x), np.int64)
        axis, at, left, right = (np.array(c) for c in zip(*self.cuts))
        while (axis[node] >= 0).any():
            inner = axis[node] >= 0
            below = x[np.arange(len(x)), np.maximum(axis[node], 0)] < at[node]
            node = np.where(inner, np.where(below, left[node], right[node]), node)
        return at[node].astype(np.int64)

    def near(self, radius: float) -> list[tuple[int, int]]:
        """Cells a <= b whose boxes are ``radius`` apart or less."""
        lo, hi = (np.array(c) for c in zip(*self.boxes))
        out = []
        for a in range(len(lo)):
            gap = np.maximum(0, np.maximum(lo[a:] - hi[a], lo[a] - hi[a:]))
            out += [(a, a + int(k)) for k in np.flatnonzero((gap * gap).sum(axis=1) <= radius * radius)]
        return out


def grown_block(total: int, block: int) -> int:
    """The rows of a block: more of them in larger tables, so that what is shuffled grows with the rows and not with their square."""
    return max(block, min(-(-total // BLOCKS), GROWN * block))


def close_pairs(x: np.ndarray, px: np.ndarray, y: np.ndarray, py: np.ndarray, threshold: float, radius: float) -> tuple[np.ndarray, np.ndarray, np.ndarray, int]:
    """Rows of x and y with a cosine of ``threshold`` or more, their cosines, and how many pairs were compared in full.

    px and py are the coordinates on the leading axes; pairs further apart there than ``radius`` are left out. Where these
    are few, the rest are compared all at once.
    """
    found, compared = [], 0
    sq = (py * py).sum(axis=1)
    step = max(16, min(512, (1 << 21) // max(1, len(y))))  # a few matrices of 16 MB
    for at in range(0, len(x), step):
        p = px[at : at + step]
        near = (p * p).sum(axis=1)[:, None] + sq - 2 * (p @ py.T) <= radius * radius
        if near.mean() > 0.2:
            s = x[at : at + step] @ y.T
            a, b = np.nonzero(s >= threshold)
            compared += s.size
            found.append((a + at, b, s[a, b]))
            continue
        a, b = np.nonzero(near)
        compared += len(a)
        s = np.einsum("ij,ij->i", x[at + a], y[b])
        found.append((a[s >= threshold] + at, b[s >= threshold], s[s >= threshold]))
    a, b, s = (np.concatenate(c) for c in zip(*found)) if found else (np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0))
    return a, b, s, compared


def similar_pairs(vectors: DataFrame, threshold: float, axes: int = 16, block: int = BLOCK, cells: int = 256, sample: int = 4096) -> DataFrame:
    """(i, j, similarity) of vectors (id, v) with i < j and a cosine of ``threshold`` or more.

    Exact. Unit vectors of that cosine are sqrt(2 - 2 * threshold) apart at most, on any axes. The ``axes`` leading ones
    of a bounded sample and a kd-tree over it cut space into cells; only cells whose boxes are that near meet, and cells of
    more than ``block`` rows, or what ``grown_block`` makes of it, meet in blocks of that size, so no task gets more. In a task, pairs that are too far apart on
    the leading axes aren't compared in full. Vectors of zeros are similar to nothing, but to all at a threshold of 0 or less.
    """
    rows = written(vectors.select("id", "v"), "vectors")
    total = rows.count()
    block = grown_block(total, block)
    some = rows.where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) <= int(min(1.0, sample / max(1, total)) * (1 << 20))).orderBy(F.xxhash64("id")).limit(sample).toPandas()
    if not len(some):
        return vectors.sparkSession.createDataFrame([], "i long, j long, similarity double")
    space = Space(_unit(some["v"]), axes, min(cells, -(-total // block)))
    radius = float(np.sqrt(2 - 2 * threshold)) + 1e-9 if threshold > 0 else float("inf")

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            if len(pdf):
                yield pdf.assign(cell=space.cell(_unit(pdf["v"]) @ space.axes))

    rows = written(rows.mapInPandas(place, StructType([*rows.schema.fields, StructField("cell", LongType())])), "cells")
    sizes = {r["cell"]: -(-r["count"] // block) for r in rows.groupBy("cell").count().collect()}  # a row a cell
    meet = [(a, b, sizes[a], sizes[b]) for a, b in space.near(radius) if a in sizes and b in sizes]
    meet = vectors.sparkSession.createDataFrame(meet, "a long, b long, na long, nb long")
    one, two = rows.join(F.broadcast(meet), rows["cell"] == meet["a"]), rows.join(F.broadcast(meet), rows["cell"] == meet["b"])
    part = lambda n: F.pmod(F.xxhash64("id"), F.col(n))
    others = lambda lo, hi: F.explode(F.when(lo <= hi, F.sequence(lo, hi)))
    one = one.withColumn("x", part("na")).withColumn("y", others(F.when(F.col("a") == F.col("b"), F.col("x")).otherwise(0), F.col("nb") - 1))
    two = two.withColumn("y", part("nb")).withColumn("x", others(F.lit(0).cast("long"), F.when(F.col("a") == F.col("b"), F.col("y")).otherwise(F.col("na") - 1)))
    key = ["a", "b", "x", "y"]

    def near(x: pd.DataFrame, y: pd.DataFrame) -> pd.DataFrame:
        if not len(x) or not len(y):
            return pd.DataFrame({"i": [], "j": [], "similarity": []})
        u, w = _unit(x["v"]), _unit(y["v2"])
        a, b, s, _ = close_pairs(u, u @ space.axes, w, w @ space.axes, threshold, radius)
        i, j = x["id"].to_numpy()[a], y["id2"].to_numpy()[b]
        one_block = x["a"].iloc[0] == x["b"].iloc[0] and x["x"].iloc[0] == x["y"].iloc[0]
        keep = i < j if one_block else i != j
        return pd.DataFrame({"i": np.minimum(i, j)[keep], "j": np.maximum(i, j)[keep], "similarity": s[keep]})

    named = {c: c + "2" for c in ["id", "v", *key]}  # other names than on the left side
    right = two.select(*(F.col(c).alias(k) for c, k in named.items())).groupBy(*(named[c] for c in key))
    return one.select("id", "v", *key).groupBy(*key).cogroup(right).applyInPandas(near, "i long, j long, similarity double")


def duplicate_groups(pairs: DataFrame, vectors: DataFrame, least: int = 2) -> DataFrame:
    """(component, id, size, keep): members of groups of ``least`` or more; the sharpest is kept, the least id of equals."""
    members = connected(pairs).select("component", F.col("node").alias("id")).join(vectors.select("id", "sharpness"), "id")
    group = Window.partitionBy("component")
    rank = F.row_number().over(group.orderBy(F.desc("sharpness"), "id"))
    rows = members.withColumns({"size": F.count("*").over(group), "keep": rank == 1})
    return rows.where(F.col("size") >= max(2, least)).select("component", "id", "size", "keep")


def group_report(pairs: DataFrame, groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """(images, pairs, groups, members): one row of totals."""
    one = lambda df, c: df.agg(c)
    parts = [one(vectors, F.count("*").alias("images")), one(pairs, F.count("*").alias("pairs")), one(groups, F.count_distinct("component").alias("groups")), one(groups, F.count("*").alias("members"))]
    out = parts[0]
    for x in parts[1:]:
        out = out.join(F.broadcast(x))  # single rows
    return out


def kept_similarity(groups: DataFrame, vectors: DataFrame) -> DataFrame:
    """(component, id, keep, similarity): each member's cosine to the member that its group keeps, 1 for that one itself."""
    own = groups.join(vectors.select("id", "v"), "id")
    kept = own.where("keep").select("component", F.col("v").alias("kept_v"))
    cosine = C.dot(C.l2_normalize(F.col("v")), C.l2_normalize(F.col("kept_v")))
    return own.join(kept, "component").select("component", "id", "keep", F.when(F.col("keep"), 1.0).otherwise(cosine).alias("similarity"))


def pick_diverse(scores: list[float], vectors: np.ndarray, entities: list, matched: bool, p: ReidParams) -> list[tuple[int, bool]]:
    """Places of the chosen crops, matched ones first; the lists are in order of score, best first."""
    n = len(scores)
    to_best = vectors @ vectors[0]
    pool = [i for i in range(n) if matched and (to_best[i] >= p.same_person or (entities[0] is not None and entities[i] == entities[0]))]
    in_pool = set(pool)
    others = [i for i in range(n) if i not in in_pool]
    sim = lambda i, j: float(vectors[i] @ vectors[j])  # noqa: E731  (only chosen ones, of which there are few, are compared with)
    own: list[int] = []
    rest: list[int] = []
    apart = lambda i, chosen: all(1 - sim(i, j) >= p.diversity for j in chosen)
    for i in pool:
        if len(own) >= min(p.matched, p.top):
            break
        if apart(i, own):
            own.append(i)
    slots = p.top - len(own)
    first, seen = [], set()
    for i in others:
        if len(first) >= 2 * slots:
            break
        if entities[i] is None or entities[i] not in seen:
            seen.add(entities[i])
            first.append(i)
    for i in first:
        if len(rest) >= slots:
            break
        if all(sim(i, j) < p.same_person for j in own + rest):
            rest.append(i)
    for i in others:
        if len(rest) >= slots:
            break
        if i not in rest and apart(i, own + rest):
            rest.append(i)
    for i in pool:
        if len(own) + len(rest) >= p.top:
            break
        if i not in own and apart(i, own + rest):
            own.append(i)
    return [(i, True) for i in own] + [(i, False) for i in rest]


def diverse_crops(crops: DataFrame, p: ReidParams = ReidParams()) -> DataFrame:
    """(video, pos, id, is_match): up to ``top`` crops a clip from (video, id, v, score, entity_id, matched).

    Of a clip's crops the ``samples`` of best score take part (the least id of equals), so a greedy choice is over a
    bounded group, and compares with the chosen ones only.
    """
    best = F.row_number().over(Window.partitionBy("video").orderBy(F.desc("score"), "id"))
    crops = crops.withColumn("nth", best).where(F.col("nth") <= p.samples).drop("nth")

    def choose(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["score", "id"], ascending=[False, True]).reset_index(drop=True)
        entity = [None if e is None or e != e else int(e) for e in pdf["entity_id"]]
        got = pick_diverse(pdf["score"].tolist(), _unit(pdf["v"]), entity, bool(pdf["matched"].iloc[0]), p)
        return pd.DataFrame({"video": pdf["video"].iloc[0], "pos": range(len(got)), "id": [pdf["id"][i] for i, _ in got], "is_match": [m for _, m in got]})

    return crops.groupBy("video").applyInPandas(choose, "video long, pos int, id long, is_match boolean")


def matched_direction(matches: DataFrame, crossings: DataFrame) -> DataFrame:
    """Matches with the crossing direction of their entity, if it crossed."""
    return matches.join(crossings.select("video", "entity_id", "direction"), ["video", "entity_id"], "left")
