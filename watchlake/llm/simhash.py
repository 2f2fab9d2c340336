"""SimHash near-duplicates, found with vantage-point trees.

Texts become 64-bit fingerprints. Two fingerprints within ``radius`` bits of each other also lie within
``radius // blocks`` bits in at least one of ``blocks`` groups of bits (pigeonhole), and Hamming distance over
one group is a metric. So one vantage-point tree is grown per group: an inner node holds a vantage point and
a distance, its left side the fingerprints up to that distance, its right side the others. The leaves are the
shards. A fingerprint lives in one shard of each tree. Where the triangle bound lets a partner lie beyond a
node's boundary, a copy visits the shards there; all other branches are pruned. Inside a shard the same tree
goes on to small leaves, where all 64 bits are compared exactly.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchlake.llm.common import free_name, listed, materialize
from watchlake.llm.graph import components
from watchlake.llm.jaccard import majority, similar_rows

BITS = 64


# ---------------------------------------------------------------- fingerprints


def fingerprint(text: bytes | None, width: int = 4, seed: int = 42) -> int:
    """The SimHash of one text: the bits set in over half of its shingles' XXH64 values."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()  # bytes: A-Z only, and exactly the six ASCII white-space bytes
    if not words:
        return 0
    shingles = [b" ".join(words)] if len(words) < width else map(b" ".join, zip(*(words[i:] for i in range(width))))
    n = max(1, len(words) - width + 1)
    return majority(np.fromiter((xxh64_intdigest(x, seed) for x in shingles), np.uint64, n))


def with_fingerprint(docs: DataFrame, text: str = "text", keep: list[str] | None = None, width: int = 4) -> DataFrame:
    """The kept columns of ``docs`` and ``fp``, the fingerprint as a signed long.

    Null and empty texts have 0; texts of any length are read whole. Equal texts have equal fingerprints, repeated rows stay
    repeated, and an empty table stays empty. Other columns may have any names; of the kept ones none may be called fp.
    """
    keep = ["doc_id"] if keep is None else keep
    schema = docs.select(*keep).schema.add("fp", "long")
    body = free_name(keep, "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(b.schema.names.index(body))
            fps = np.fromiter((fingerprint(x.as_py(), width) for x in texts), np.uint64, b.num_rows)
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, pa.array(fps.view(np.int64))], names=[*keep, "fp"])

    return docs.select(*keep, F.col(text).cast("binary").alias(body)).mapInArrow(run, schema)


def hex16(fp: Column) -> Column:
    """A fingerprint as 16 lower-case hex digits."""
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


# ---------------------------------------------------------------- trees


def masks(blocks: int) -> list[int]:
    """``blocks`` groups of neighbouring bits that cover all 64."""
    cuts = [BITS * i // blocks for i in range(blocks + 1)]
    return [((1 << (b - a)) - 1) << a for a, b in zip(cuts, cuts[1:])]


def _distance(fps: np.ndarray, point: np.uint64, mask: np.uint64) -> np.ndarray:
    return np.bitwise_count((fps ^ point) & mask)


def _vantage(fps: np.ndarray, mask: np.uint64, tries: int = 8) -> tuple[np.uint64, int] | None:
    """The tried point whose median cuts the points most evenly, and the median; None if all lie equally far."""
    best = None
    for point in fps[np.linspace(0, len(fps) - 1, tries).astype(int)]:
        d = _distance(fps, point, mask)
        for cut in {int(np.median(d)), int(np.median(d)) - 1}:
            left = int((d <= cut).sum())
            if 0 < left < len(fps) and (best is None or min(left, len(fps) - left) > best[0]):
                best = (min(left, len(fps) - left), point, cut)
    return best and best[1:]


def grow(sample: np.ndarray, mask: int, depth: int) -> list[tuple[int, int, int, int]]:
    """A tree over the sample: (vantage point, distance, left, right) by node; a side under 0 is shard -1-side."""
    nodes: list[tuple[int, int, int, int]] = []
    shards = [0]

    def build(fps: np.ndarray, level: int) -> int:
        cut = _vantage(fps, np.uint64(mask)) if level and len(fps) > 1 else None
        if cut is None:
            shards[0] += 1
            return -shards[0]
        at = len(nodes)
        nodes.append((0, 0, 0, 0))
        near = _distance(fps, cut[0], np.uint64(mask)) <= cut[1]
        nodes[at] = (int(cut[0]), cut[1], build(fps[near], level - 1), build(fps[~near], level - 1))
        return at

    build(np.unique(sample), depth)
    return nodes


def _sides(d_res: np.ndarray, d_vis: np.ndarray, cut: int, radius: int):
    """Who goes left and right. Of a pair across the boundary, the left one crosses; visitors go wherever they must."""
    d_res, d_vis = d_res.astype(np.int64), d_vis.astype(np.int64)
    return d_res <= cut, (d_res <= cut) & (d_res + radius > cut), d_vis - radius <= cut, d_vis + radius > cut


def route(fps: np.ndarray, nodes: list[tuple[int, int, int, int]], mask: int, radius: int, lives: np.ndarray | None = None):
    """(shard, index of the fingerprint, whether it lives there) for each shard that a fingerprint must reach.

    Where ``lives`` says so, fingerprints live elsewhere already and only visit.
    """
    todo = [(0 if nodes else -1, np.flatnonzero(lives), np.flatnonzero(~lives))] if lives is not None else [(0 if nodes else -1, np.arange(len(fps)), np.empty(0, np.int64))]
    while todo:
        at, res, vis = todo.pop()
        if not len(res) and not len(vis):
            continue
        if at < 0:
            yield -1 - at, res, True
            yield -1 - at, vis, False
            continue
        point, cut, left, right = nodes[at]
        m, p = np.uint64(mask), np.uint64(point)
        near, cross, to_left, to_right = _sides(_distance(fps[res], p, m), _distance(fps[vis], p, m), cut, radius)
        todo.append((left, res[near], vis[to_left]))
        todo.append((right, res[~near], np.concatenate([res[cross], vis[to_right]])))


def _merge(labels: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Join the classes of i and j in place; labels are least members."""
    a, b = labels[i], labels[j]
    while len(a):
        lo = np.minimum(a, b)
        np.minimum.at(labels, a, lo)
        np.minimum.at(labels, b, lo)
        while not np.array_equal(nxt := labels[labels], labels):
            labels[:] = nxt
        a, b = labels[a], labels[b]
        differ = a != b
        a, b = a[differ], b[differ]


def link_shard(fps: np.ndarray, lives: np.ndarray, mask: int, radius: int, near: int, leaf: int = 192) -> np.ndarray:
    """Least position in the class of each fingerprint, for pairs of which one lives in this shard at least.

    ``near``: how close partners are under ``mask``. Where the masked bits can't divide a node any more, all
    64 bits with the whole radius take over.
    """
    labels = np.arange(len(fps))
    full = (1 << BITS) - 1
    todo = [(np.flatnonzero(lives), np.flatnonzero(~lives), mask, near)]
    while todo:
        res, vis, m, r = todo.pop()
        if not len(res) or len(res) + len(vis) < 2:
            continue
        cut = _vantage(fps[res], np.uint64(m)) if len(res) > leaf else None
        if len(res) > leaf and m != full and (cut is None or len(res) < 4 * leaf and len(vis) > 64 * len(res)):
            todo.append((res, vis, full, radius))
            continue
        if cut is not None:
            d = _distance(fps[res], cut[0], np.uint64(m))
            balanced = min((d <= cut[1]).sum(), (d > cut[1]).sum()) * 50 > len(res)
            if balanced:
                nearer, cross, to_left, to_right = _sides(d, _distance(fps[vis], cut[0], np.uint64(m)), cut[1], r)
                todo.append((res[nearer], vis[to_left], m, r))
                todo.append((res[~nearer], np.concatenate([res[cross], vis[to_right]]), m, r))
                continue
        others = np.concatenate([res, vis])
        step = max(1, (1 << 20) // max(1, len(others)))
        for at in range(0, len(res), step):
            some = res[at : at + step]
            i, j = np.nonzero(np.bitwise_count(fps[some][:, None] ^ fps[others][None, :]) <= radius)
            i, j = some[i], others[j]
            new = labels[i] != labels[j]
            _merge(labels, i[new], j[new])
    return labels


# ---------------------------------------------------------------- the join


TOP_DEPTH, SUB_DEPTH = 10, 11  # levels of the trees that the driver grows, and of those that shards grow
SAMPLE = 1 << 16  # fingerprints that the driver samples at most
SUB_SAMPLE = 1 << 14  # fingerprints that a shard's own tree grows from
KEY = "xxhash64(fp, 7)"


def links(fps: DataFrame, radius: int = 4, blocks: int = 3, shard_rows: int = 4096, per_shard: int = 32, most_rows: int = 100_000, top_depth: int = TOP_DEPTH) -> DataFrame:
    """(u, v): links that connect all pairs of fingerprints within ``radius`` bits, a spanning forest for each shard.

    ``fps`` has a long column fp, distinct and without nulls, in a table that is cheap to read twice; an empty one has no links.
    ``shard_rows``: fingerprints that should live in a shard. The driver grows trees of ``top_depth`` levels at most from
    ``per_shard`` sampled fingerprints a shard, ``SAMPLE`` in all, whatever the input. Shards that more than ``most_rows``
    fingerprints reach then grow trees of their own, each in a task from a sample of its own, until all are small enough.
    Those that no tree cuts any more (many that agree in a group of bits) are dealt into blocks, and tasks get pairs of
    blocks; so no task sees a whole dense shard, and no pair is lost.
    """
    n = fps.count()
    depth = min(top_depth, max(0, int(np.ceil(np.log2(max(1, n / shard_rows))))))
    share = min(0.25, min(SAMPLE, max(4096, per_shard << depth)) / max(1, n))
    near, all_masks = radius // blocks, masks(blocks)
    sample = np.empty(0, np.uint64)
    if depth:
        some = fps.where(F.expr(f"pmod({KEY}, 1048576) < {int(share * (1 << 20)) + 1}")).toPandas()
        sample = np.sort(some["fp"].to_numpy(np.int64)).view(np.uint64)
    forest = [grow(sample, m, depth) if len(sample) else [] for m in all_masks]

    def batch(shard: int, fp: np.ndarray, lives: np.ndarray | bool) -> pa.RecordBatch:
        cols = [np.full(len(fp), shard, np.int64), fp, np.full(len(fp), lives)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], names=["shard", "fp", "lives"])

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = b.column(0).to_numpy(zero_copy_only=False).astype(np.int64)
            for k, (nodes, m) in enumerate(zip(forest, all_masks)):
                for shard, idx, lives in route(fp.view(np.uint64), nodes, m, near):
                    if len(idx):
                        yield batch(k | shard << 4, fp[idx], lives)

    def search(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:  # key: shard and two of its blocks
        fp = pdf["fp"].to_numpy(np.int64)
        labels = link_shard(fp.view(np.uint64), pdf["lives"].to_numpy(bool), all_masks[key[0] & 15], radius, near)
        has = np.flatnonzero(labels != np.arange(len(labels)))
        return pd.DataFrame({"u": fp[has], "v": fp[labels[has]]})

    rows, dense = _divided(materialize(fps.select("fp").mapInArrow(deal, "shard long, fp long, lives boolean"), "dealt"), all_masks, near, most_rows, batch)
    rows = rows.withColumns({"a": F.lit(0).cast("long"), "b": F.lit(0).cast("long")})
    if dense is not None:
        many = dense.withColumn("mine", F.expr(f"pmod({KEY}, k)"))
        many = many.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("k") - 1)))
        rows = rows.unionByName(many.select("shard", "fp", "lives", F.least("mine", "other").alias("a"), F.greatest("mine", "other").alias("b")))
    return rows.groupBy("shard", "a", "b").applyInPandas(search, "u long, v long")


def _divided(dealt: DataFrame, all_masks: list[int], near: int, most_rows: int, batch) -> tuple[DataFrame, DataFrame | None]:
    """Rows of shards that are small enough, and, with their number of blocks k, those of dense shards that no tree cuts.

    A shard's number has its group of bits in the lowest 4 and a level's place in 12 more for each level.
    """

    def tree(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        fp = np.sort(pdf["fp"].to_numpy(np.int64)).view(np.uint64)
        levels = min(SUB_DEPTH, max(1, int(np.ceil(np.log2(pdf["count"].iloc[0] / most_rows))) + 1))
        nodes = grow(fp, all_masks[key[0] & 15], levels)
        return pd.DataFrame({"of": [key[0]], "tree": [[str(x) for node in nodes for x in node]]})  # vantage points are unsigned

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            shard, fp = (b.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in (0, 1))
            lives = b.column(2).to_numpy(zero_copy_only=False).astype(bool)
            for one in np.unique(shard).tolist():
                at = np.flatnonzero(shard == one)
                flat = [int(x) for x in b.column(3)[int(at[0])].as_py()]
                nodes = [tuple(flat[i : i + 4]) for i in range(0, len(flat), 4)]
                for sub, idx, there in route(fp[at].view(np.uint64), nodes, all_masks[one & 15], near, lives[at]):
                    if len(idx):
                        yield batch((one & 15) | ((one >> 4 << 12 | sub + 1) << 4), fp[at[idx]], there)

    small, stuck = [], []
    for _ in range(4):
        counts = dealt.groupBy("shard").agg(F.count("*").alias("count"), F.count_if("lives").alias("own"))
        dense = materialize(counts.where(F.col("count") > most_rows).withColumnRenamed("shard", "of"), "dense")
        if not dense.limit(1).count():
            return reduce(DataFrame.unionByName, [*small, dealt]), reduce(DataFrame.unionByName, stuck) if stuck else None
        small.append(dealt.join(dense, dealt["shard"] == dense["of"], "left_anti"))
        large = dealt.join(dense, dealt["shard"] == dense["of"])
        some = large.where("lives").where(F.expr(f"pmod(xxhash64(fp, 13), 1048576) < 1048576.0 * {SUB_SAMPLE} / own"))
        trees = materialize(some.groupBy("of").applyInPandas(tree, "of long, tree array<string>"), "trees")
        cut = trees.where(F.size("tree") > 0)
        left = dense.join(cut, "of", "left_anti").select("of", F.ceil(2 * F.col("count") / most_rows).alias("k"))
        stuck.append(dealt.join(left, dealt["shard"] == left["of"]).select("shard", "fp", "lives", "k"))
        parts = dealt.join(cut, dealt["shard"] == cut["of"]).select("shard", "fp", "lives", "tree")
        dealt = materialize(parts.mapInArrow(again, "shard long, fp long, lives boolean"), "dealt")
    counts = dealt.groupBy("shard").count().select(F.col("shard").alias("of"), F.ceil(2 * F.col("count") / most_rows).alias("k"))
    stuck.append(dealt.join(counts.where("k > 2"), F.col("shard") == F.col("of")).select("shard", "fp", "lives", "k"))
    small.append(dealt.join(counts.where("k > 2"), F.col("shard") == F.col("of"), "left_anti"))
    return reduce(DataFrame.unionByName, small), reduce(DataFrame.unionByName, stuck)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text: str = "text", radius: int = 4, width: int = 4) -> DataFrame:
    """(doc_id, fp, component_id): one row per row of ``docs``.

    component_id is the least id among all documents that fingerprint links reach. Fingerprints link at
    ``radius`` differing bits or fewer; equal texts always have one component. Null and empty texts have
    fingerprint 0 and link like any other. Repeated rows stay repeated. A null id is ignored when the least id
    is taken; a component of null ids only has a null component_id. An empty table gives an empty result.
    Columns besides id and text aren't read, whatever their names.
    """
    rows = materialize(with_fingerprint(docs.select(F.col(id_col).alias("doc_id"), F.col(text).alias("text")), width=width), "fps")
    reps = materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "reps")
    roots = components(links(reps.select("fp"), radius))
    named = reps.join(roots, reps["fp"] == roots["node"], "left").select("fp", "least", F.coalesce("root", "fp").alias("root"))
    lowest = named.groupBy("root").agg(F.min("least").alias("component_id"))
    by_fp = named.join(lowest, "root").select("fp", "component_id")
    return rows.join(by_fp, "fp").select("doc_id", "fp", "component_id")


def drop_near_duplicates(docs: DataFrame) -> DataFrame:
    """``docs`` with one document of each group of near copies: the one with the least doc_id, then text hash.

    Near copies share at least 0.8 of their five-word shingles (Jaccard, compared exactly); groups are what such
    pairs connect. Fingerprints of these shingles are linked by the vantage-point trees, and linked texts are compared; as texts
    that share 0.8 may differ in more bits than the trees can look for, an exact filter then finds the pairs that are left. Rows that repeat id and text count as one
    document; other texts of a repeated id are documents of their own. Rows without a doc_id are held against each
    other alone: one of each group stays. Null and empty texts are copies of each other. An empty table stays empty, and further
    columns may have any names.
    """
    ids, roots = similar_rows(docs, links)
    by_fp = ids.groupBy("fp", F.isnull("doc_id").alias("no_id")).agg(F.min(F.struct("doc_id", "text_key")).alias("least"))
    named = by_fp.join(roots, by_fp["fp"] == roots["node"], "left")
    stay = named.groupBy(F.coalesce("root", "fp").alias("root"), "no_id").agg(F.min("least").alias("least"))
    stay = materialize(stay.select(F.col("least.doc_id").alias("i"), F.col("least.text_key").alias("k")), "stay")
    same = lambda x, y: x["doc_id"].eqNullSafe(y["i"]) & (x["text_key"] == y["k"])
    # both lists are written and counted first: texts move only where the lists are long
    counted = ids.groupBy("doc_id", "text_key").count()
    counted = materialize(counted.join(stay.withColumn("stays", F.lit(True)), same(counted, stay), "left").select(F.col("doc_id").alias("i"), F.col("text_key").alias("k"), "count", F.coalesce("stays", F.lit(False)).alias("stays")), "found")
    gone = materialize(counted.where("NOT stays").select("i", "k"), "gone")
    twice = materialize(counted.where("stays AND count > 1").select("i", "k"), "twice")
    key = free_name(docs.columns, "text_key")
    rows = docs.withColumn(key, F.xxhash64("text"))
    gone, twice = listed(gone), listed(twice)
    match = lambda y: rows["doc_id"].eqNullSafe(y["i"]) & (rows[key] == y["k"])
    known = rows.join(gone, match(gone), "left_anti")
    if twice.limit(1).count():
        known = known.join(twice, match(twice), "left_anti").unionByName(known.join(twice, match(twice), "left_semi").dropDuplicates(["doc_id", key]))
    return known.select(*docs.columns)
