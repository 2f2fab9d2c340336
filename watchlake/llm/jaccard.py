"""Near copies by the Jaccard similarity of their word shingles, found exactly.

A text becomes the set of its five-word shingles (hashed to 64 bits). All sets are sorted by one order of
shingles. Of two sets of which each shares at least 4/5 with the other, each has one of the shared shingles among
its first n // 5 + 1 (prefix filter), so no pair is lost. The order puts shingles last that are common in a sample or
that many first ones share, as those of a passage that many texts hold: texts that have such ones among their first get
others instead. The order decides how many candidates there are and nothing else. Candidates are first compared on the leading bits of
their shingles, which bound what they share from above and take an eighth or a quarter of the bytes; those that pass
are compared on their full sets.
Texts of equal sets are one node. Pairs that the caller finds by the sets' fingerprints are compared first, and what they
connect isn't looked for again. A shingle's first text leads it. Each text is then compared with one leader, the one
of most of its shingles, then with all leaders and at last with all candidates that still lie in another component;
so a large group of near copies costs about one comparison a member. At last a shingle's texts meet by size class, the
smaller partner only if the shingle is in the first ninth of its set, and never within the shingle's largest component;
tasks that hold sketches do this for shingles that many texts still share.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from watchlake.llm.common import arrow_batches, give_back, lean, listed, materialize
from watchlake.llm.graph import components

WIDTH = 5
OVER, UNDER = 4, 5  # similar: shared * UNDER >= union * OVER
SEED = 11
MANY = 16  # texts that may share a first shingle before it goes last
CROWD, BLOCK = 64, 2000  # texts of a shingle that are joined; postings of a shingle that a task looks at
SLICE = 1 << 16  # postings of a bucket that are sorted at once
LARGE = 1000  # shingles of a set whose sketch has sixteen bits of each


def shingle_set(text: bytes | None, width: int = WIDTH) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles; of all its words together if they are fewer."""
    from xxhash import xxh64_intdigest

    words = (text or b"").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxh64_intdigest(b" ".join(words), SEED)], np.uint64)
    known: dict[bytes, int] = {}
    w = np.fromiter((known[x] if x in known else known.setdefault(x, xxh64_intdigest(x, SEED)) for x in words), np.uint64, len(words))
    n = len(w) - width + 1
    h = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        for i in range(width):
            h = (h ^ w[i : i + n]) * np.uint64(0x9E3779B97F4A7C15)
            h ^= h >> np.uint64(29)
    return np.unique(h)


def majority(h: np.ndarray) -> int:
    """The SimHash of 64-bit hashes: the bits set in over half of them; 0 for none."""
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 14):
        part = h[at : at + (1 << 14)].view(np.uint8).reshape(-1, 8)
        ones += np.unpackbits(part, axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(ones * 2 > len(h), bitorder="little").view(np.uint64)[0])


def set_key(s: np.ndarray) -> int:
    """64 bits that tell sets apart; 0 for the empty set."""
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(s.tobytes(), SEED) if len(s) else 0


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    shared = len(np.intersect1d(a, b, assume_unique=True))
    return shared * UNDER >= (len(a) + len(b) - shared) * OVER


def prefix(s: np.ndarray, common: np.ndarray) -> np.ndarray:
    """The first shingles by (common, hash), one of which any similar set has among its own first ones."""
    n = len(s) * (UNDER - OVER) // UNDER + 1 if len(s) else 0
    if not len(common):
        return s[:n]
    often = common[np.minimum(np.searchsorted(common, s), len(common) - 1)] == s
    return np.concatenate([s[~often], s[often]])[:n]


def sketch(s: np.ndarray) -> bytes:
    """The leading bits of the set's shingles, in order: eight of each, or sixteen in large sets."""
    return (s >> np.uint64(56)).astype(np.uint8).tobytes() if len(s) < LARGE else (s >> np.uint64(48)).astype(np.uint16).tobytes()


def may_be_similar(n: int, a: memoryview, m: int, b: memoryview) -> bool:
    """Whether sets of n and m shingles with these sketches can be similar: they share no more than their leading bits do."""
    x, y = (np.frombuffer(v, np.uint8 if k < LARGE else np.uint16) for k, v in ((n, a), (m, b)))
    if min(n, m) < LARGE <= max(n, m):
        x, y = (v if v.itemsize == 1 else (v >> 8).astype(np.uint8) for v in (x, y))
    size = 1 << (8 * x.itemsize)
    shared = int(np.minimum(np.bincount(x, minlength=size), np.bincount(y, minlength=size)).sum())
    return shared * UNDER >= (n + m - shared) * OVER


def _pack(fp: np.ndarray, n: np.ndarray, counts: np.ndarray, s: np.ndarray, at: np.ndarray) -> bytes:
    """Postings of some texts: each text's key, size and number of postings, and the postings' shingles and places."""
    at = at.astype(np.uint16 if not len(at) or at.max() < 1 << 16 else np.uint32)
    head = np.array([len(fp), len(s), at.itemsize], np.int64)
    return b"".join(x.tobytes() for x in (head, fp.astype(np.int64), n.astype(np.int32), counts.astype(np.int32), s, at))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(s, fp, n, at), one of each for each posting."""
    docs, postings, width = np.frombuffer(blob, np.int64, 3).tolist()
    at, out = 24, []
    for kind, k in ((np.int64, docs), (np.int32, docs), (np.int32, docs), (np.uint64, postings), (np.uint16 if width == 2 else np.uint32, postings)):
        out.append(np.frombuffer(blob, kind, k, at))
        at += out[-1].nbytes
    fp, n, counts, s, place = out
    return s, np.repeat(fp, counts), np.repeat(n, counts), place.astype(np.int32)


def _several(blobs: list[pa.Buffer]) -> pa.Table:
    """(s, fp, n, at) of the postings whose shingle several texts have, of packed ones that hold all of their shingles.

    Shingles are dealt into parts of about ``SLICE`` postings, and one part is unpacked and sorted after the other.
    """
    parts = sum(int(np.frombuffer(b, np.int64, 2)[1]) for b in blobs) // SLICE + 1
    made = []
    for part in range(parts):
        columns: tuple[list[np.ndarray], ...] = ([], [], [], [])
        for blob in blobs:
            found = _unpack(blob)
            mine = (found[0] >> np.uint64(44)) % np.uint64(parts) == part
            for c, x in zip(columns, found):
                c.append(x[mine])
        s, fp, n, at = map(np.concatenate, columns)
        if not len(s):
            continue
        order = np.lexsort((fp, s))
        s, fp = s[order], fp[order]
        new = np.ones(len(s), bool)
        new[1:] = (s[1:] != s[:-1]) | (fp[1:] != fp[:-1])
        order, s, fp = order[new], s[new], fp[new]
        same = s[1:] == s[:-1]
        has = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        # of two similar texts the smaller has its first shared shingle in the first ninth: others lead to no pair
        group = np.cumsum(np.concatenate([[True], ~same])) - 1
        near = at[order] * (OVER + UNDER) <= n[order]
        has &= np.bincount(group, near)[group] > 0
        order = order[has]
        made.append(pa.RecordBatch.from_arrays([pa.array(x) for x in (s[has].view(np.int64), fp[has], n[order], at[order])], names=["s", "fp", "n", "at"]))
    return pa.Table.from_batches(made, pa.schema([("s", pa.int64()), ("fp", pa.int64()), ("n", pa.int32()), ("at", pa.int32())]))


def common_shingles(docs: DataFrame, sample_docs: int = 2000, times: int = 4) -> np.ndarray:
    """Shingles that several documents of a sample have; only the order of shingles hangs on them."""
    n = max(1, docs.count())
    some = docs.where(F.pmod(F.xxhash64("text", F.lit(5)), F.lit(1 << 20)) < int(min(1.0, sample_docs / n) * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [shingle_set(x.as_py()) for x in b.column(0)]
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate([np.empty(0, np.uint64), *sets]).view(np.int64))], names=["s"])

    found = some.select(F.col("text").cast("binary")).mapInArrow(lean(run), "s long").groupBy("s").count().where(F.col("count") >= times)
    return np.sort(found.select("s").toPandas()["s"].to_numpy(np.int64).view(np.uint64))


def _sets(texts: DataFrame) -> DataFrame:
    """(fp, body): the key and the packed set of each text."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [shingle_set(x.as_py()) for x in b.column(0)]
            keys = np.fromiter(map(set_key, sets), np.uint64, len(sets)).view(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([s.tobytes() for s in sets], pa.binary())], names=["fp", "body"])

    return texts.mapInArrow(lean(run), "fp long, body binary")


def _verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs whose full sets are similar."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            a, c = b.column(2), b.column(3)
            get = lambda x: np.frombuffer(x.as_buffer(), np.uint64)
            yield b.select(["u", "v"]).filter(pa.array([similar(get(x), get(y)) for x, y in zip(a, c)], pa.bool_()))

    both = pairs.join(sets.select(F.col("fp").alias("u"), F.col("body").alias("a")), "u").join(sets.select(F.col("fp").alias("v"), F.col("body").alias("b")), "v")
    return both.select("u", "v", "a", "b").mapInArrow(lean(run), "u long, v long")


def _plausible(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """The pairs whose sketches allow that they are similar. ``rows`` has fp, n and sketch, and may repeat."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            n, m = (b.column(k).to_pylist() for k in (2, 4))
            ok = [may_be_similar(x, a.as_buffer(), y, c.as_buffer()) for x, a, y, c in zip(n, b.column(3), m, b.column(5))]
            yield b.select(["u", "v"]).filter(pa.array(ok, pa.bool_()))

    members = materialize(pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct(), "members")
    own = materialize(rows.join(listed(members), "fp", "left_semi").groupBy("fp").agg(F.first("n").alias("n"), F.first("sketch").alias("sketch")), "sketches")
    side = lambda k, n, x: own.select(F.col("fp").alias(k), F.col("n").alias(n), F.col("sketch").alias(x))
    both = pairs.join(side("u", "n", "a"), "u").join(side("v", "m", "b"), "v")
    return both.select("u", "v", "n", "a", "m", "b").mapInArrow(lean(run), "u long, v long")


def _open(rows: DataFrame, roots: DataFrame) -> DataFrame:
    """The prefix shingles (s, fp, n, at) that texts of different components share, with each text's root."""
    named = rows.select("s", "fp", "n", "at").join(roots, rows["fp"] == roots["node"], "left").select("s", "fp", "n", "at", F.coalesce("root", "fp").alias("root"))
    several = named.groupBy("s").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo < hi").select("s")
    return materialize(named.join(several, "s", "left_semi"), "open")


def _across(rows: DataFrame, room: Callable[[str, str], Column], sketches: DataFrame) -> DataFrame:
    """Pairs (u, v), u > v, of texts whose postings share a shingle, lie in different components and have room for enough others.

    Room asks of the smaller text that the shingle is in the first ninth of its set, and of both that their sizes differ by
    a quarter at most: so only postings in the first ninth are smaller partners, and only those of their size class and the
    next one meet them. Of a shingle's postings in its largest component none meet each other. Shingles of ``CROWD`` texts or
    fewer are joined. Those of more are looked at by tasks, in blocks, which hold the texts' sketches (fp, n, sketch) and
    let go only of pairs that may be similar, at the first shingle that they share (none before it is among both texts' own).
    """
    stats = rows.groupBy("s", "root").count().groupBy("s").agg(F.max_by("root", F.struct("count", "root")).alias("most"), F.sum("count").alias("texts"))
    size = F.floor(F.log("n") / math.log(1.26)).cast("int")  # sizes a quarter apart differ by one class at most
    rows = materialize(rows.join(stats, "s").withColumns({"c": size, "minor": F.col("root") != F.col("most")}).drop("most"), "postings")
    small = rows.where(F.col("n") >= (OVER + UNDER) * F.col("at")).withColumn("c", F.explode(F.array("c", F.col("c") + 1)))
    apart = F.expr("a.root <> b.root AND (a.n > b.n OR a.n = b.n AND a.fp > b.fp)")
    few = F.col("texts") <= CROWD
    sides = ((rows.where("minor"), small), (rows.where("NOT minor"), small.where("minor")))
    met = [a.where(few).alias("a").join(b.where(few).alias("b"), ["s", "c"]).where(apart).where(room("a", "b")) for a, b in sides]
    pairs = met[0].select("a.fp", "b.fp").unionAll(met[1].select("a.fp", "b.fp")).toDF("x", "y")
    pairs = pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v"))
    crowded = rows.where(~few)
    return pairs.unionByName(_crowds(rows, crowded, small.where(~few), sketches)) if crowded.limit(1).count() else pairs


def _crowds(rows: DataFrame, large: DataFrame, small: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs of ``_across`` of shingles that many texts share."""
    members = materialize(large.select("fp").distinct(), "members")
    own = sketches.join(listed(members), "fp", "left_semi").groupBy("fp").agg(F.first("sketch").alias("sketch"))
    lists = rows.join(listed(members), "fp", "left_semi").groupBy("fp").agg(F.collect_list(F.struct("at", "s")).alias("firsts"))
    lists = lists.select("fp", F.col("firsts.at").alias("places"), F.col("firsts.s").alias("firsts"))  # plain arrays, which tasks hold in few bytes
    known = materialize(own.join(lists, "fp"), "known")
    cols = ["s", "c", "fp", "n", "at", "root", "minor"]
    both = large.select(*cols, F.lit(0).alias("side")).unionAll(small.select(*cols, F.lit(1).alias("side")))
    blocks = both.groupBy("s", "c").agg(F.ceil(F.count("*") / BLOCK).alias("k"))
    both = both.join(blocks, ["s", "c"]).withColumn("mine", F.pmod(F.xxhash64("fp"), "k"))
    other = F.sequence(F.lit(0).cast("long"), F.col("k") - 1)  # a block of one side meets each of the other
    both = both.withColumn("cell", F.explode(F.transform(other, lambda o: F.when(F.col("side") == 0, F.col("mine") * F.col("k") + o).otherwise(o * F.col("k") + F.col("mine")))))

    def meet(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x, y = ({c: pdf[c].to_numpy()[pdf["side"].to_numpy() == k] for c in pdf.columns} for k in (0, 1))
        out = []
        counts = [np.stack([np.bincount(np.frombuffer(v, np.uint8), minlength=256) if n < LARGE else np.zeros(256, np.int64) for n, v in zip(z["n"], z["sketch"])]).astype(np.int32) if len(z["n"]) else None for z in (x, y)]
        for at in range(0, len(x["fp"]) if len(y["fp"]) else 0, 256):
            n, fp, place, root, minor = (x[c][at : at + 256, None] for c in ("n", "fp", "at", "root", "minor"))
            ok = (root != y["root"]) & (minor.astype(bool) | y["minor"].astype(bool)) & ((n > y["n"]) | ((n == y["n"]) & (fp > y["fp"])))
            ok &= (OVER + UNDER) * np.minimum(n - place, y["n"] - y["at"]) >= OVER * (n + y["n"])
            i, j = np.nonzero(ok)
            i += at
            for k in range(0, len(i), 4096):
                a, b = i[k : k + 4096], j[k : k + 4096]
                least = np.minimum(counts[0][a], counts[1][b]).sum(axis=1)
                may = UNDER * least >= OVER * (x["n"][a] + y["n"][b] - least)
                for q in np.flatnonzero((x["n"][a] >= LARGE) | (y["n"][b] >= LARGE)).tolist():
                    may[q] = may_be_similar(int(x["n"][a[q]]), memoryview(x["sketch"][a[q]]), int(y["n"][b[q]]), memoryview(y["sketch"][b[q]]))
                out += [(x["fp"][p], y["fp"][q]) for p, q in zip(a[may].tolist(), b[may].tolist()) if not np.isin(x["firsts"][p][x["places"][p] < x["at"][p]], y["firsts"][q]).any()]
        u, v = np.array(out, np.int64).reshape(-1, 2).T
        return pd.DataFrame({"u": np.maximum(u, v), "v": np.minimum(u, v)})

    return both.join(known, "fp").groupBy("s", "c", "cell").applyInPandas(meet, "u long, v long")


def keyed(docs: DataFrame) -> DataFrame:
    """``docs`` as doc_id, text and text_key, which tells texts apart."""
    return docs.select("doc_id", "text", F.xxhash64("text").alias("text_key"))


def _shared(prefixes: DataFrame, bucket_postings: int) -> DataFrame:
    """(s, fp, n, at) of the prefix shingles that several texts have; ``prefixes`` has fp, n and prefix, and may repeat."""
    total = prefixes.agg(F.sum(F.length("prefix"))).first()[0] or 0
    buckets = int(total // (8 * bucket_postings)) + 1

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches, 2048):
            fp, one = np.unique(b.column(0).to_numpy(zero_copy_only=False), return_index=True)
            sizes = b.column(1).to_numpy(zero_copy_only=False)[one].astype(np.int64)
            firsts = [np.frombuffer(b.column(2)[int(i)].as_buffer(), np.uint64) for i in one]
            lens = np.array([len(x) for x in firsts], np.int64)
            s = np.concatenate([np.empty(0, np.uint64), *firsts])
            at = np.arange(len(s)) - np.repeat(np.cumsum(lens) - lens, lens)
            text = np.repeat(np.arange(len(fp)), lens)
            part = ((s >> np.uint64(20)) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(part, kind="stable")
            part = part[order]
            cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(0, np.int64)
            out = []
            for x, y in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
                mine = order[x:y]
                texts, counts = np.unique(text[mine], return_counts=True)
                out.append((int(part[x]), _pack(fp[texts], sizes[texts], counts, s[mine], at[mine])))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in out], pa.int32()), pa.array([x for _, x in out], pa.binary())], names=["bucket", "blob"])

    def shared_of(found: pa.Table) -> pa.Table:
        made = _several([x.as_buffer() for x in found.column("blob")])
        give_back()
        return made

    dealt = prefixes.mapInArrow(lean(deal), "bucket int, blob binary")
    return materialize(dealt.groupBy("bucket").applyInArrow(shared_of, "s long, fp long, n int, at int"), "shared")


def _without_hot(docs: DataFrame, ids: DataFrame, prefixes: DataFrame, common: np.ndarray, bucket_postings: int, most_hot: int = 1_000_000) -> DataFrame:
    """The shared prefix shingles, after those that more than ``MANY`` texts share were put last in the order.

    These are broadcast, the ``most_hot`` most shared ones at most (8 MB): any set of them makes an order, and so a right
    result. A text whose prefix has none keeps its prefix, as the order of the others stays; the rest are shingled again.
    """
    shared = _shared(prefixes, bucket_postings)
    counts = shared.groupBy("s").count().where(F.col("count") > MANY)
    hot = materialize(counts.orderBy(F.desc("count"), "s").limit(most_hot).select("s"), "hot")
    late = hot.toPandas()["s"].to_numpy(np.int64).view(np.uint64)
    if not len(late):
        return shared
    late = np.union1d(late, common)
    touched = materialize(shared.join(hot, "s", "left_semi").select("fp").distinct(), "touched")

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [shingle_set(x.as_py()) for x in b.column(0)]
            keys = np.fromiter(map(set_key, sets), np.uint64, len(sets)).view(np.int64)
            made = pa.array([prefix(x, late).tobytes() for x in sets], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([len(x) for x in sets], pa.int32()), made], names=["fp", "n", "prefix"])

    changed = materialize(_texts(docs, ids, touched).mapInArrow(lean(again), "fp long, n int, prefix binary"), "changed")
    return _shared(prefixes.join(listed(touched), "fp", "left_anti").unionByName(changed), bucket_postings)


def _slices(batches: Iterator[pa.RecordBatch], rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Batches in parts of some rows, so that a task holds the sets of few texts at once."""
    for b in batches:
        for at in range(0, b.num_rows, rows):
            yield b.slice(at, rows)


def _texts(docs: DataFrame, ids: DataFrame, fps: DataFrame) -> DataFrame:
    """One text of each of the fps, and others that share its text_key."""
    chosen = ids.join(listed(fps), "fp", "left_semi").groupBy("fp").agg(F.min("text_key").alias("text_key")).select("text_key")
    return keyed(docs).join(listed(materialize(chosen, "chosen")), "text_key", "left_semi").select(F.col("text").cast("binary"))


def _fingerprint_pairs(rows: DataFrame, near: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(u, v), u > v: sets (fp) of one fingerprint (sim) with the least of them, and the least ones of fingerprints that ``near`` links."""
    sims = materialize(rows.where("n > 0").select("fp", "sim").distinct(), "sims")
    least = materialize(sims.groupBy("sim").agg(F.min("fp").alias("least")), "least")
    found = materialize(near(least.select(F.col("sim").alias("fp"))), "near")
    same = sims.join(least, "sim").select(F.col("fp").alias("x"), F.col("least").alias("y"))
    side = lambda k, name: least.select(F.col("sim").alias(k), F.col("least").alias(name))
    linked = found.join(side("u", "x"), "u").join(side("v", "y"), "v").select("x", "y")
    pairs = same.unionAll(linked).where("x <> y")
    return pairs.select(F.greatest("x", "y").alias("u"), F.least("x", "y").alias("v")).distinct()


def similar_rows(docs: DataFrame, near: Callable[[DataFrame], DataFrame], bucket_postings: int = 500_000) -> tuple[DataFrame, DataFrame]:
    """(doc_id, text_key, fp) of every row of ``docs``, and (node, root) of the fps that are similar to others.

    ``docs`` needs doc_id and text. Null and empty texts have fp 0, which is similar to nothing else. Rows that repeat an id or
    a text are told apart by (doc_id, text_key); null ids are kept. An empty table gives two empty ones, and other columns
    aren't read. A text of any length is one set in one task. ``near`` links distinct fingerprints (fp) as (u, v): what it finds
    is compared first, and what it doesn't find is found by the prefix filter. ``bucket_postings``: prefix shingles a task looks through
    at once; the number of tasks grows with the input.
    """
    with arrow_batches(docs.sparkSession):  # all steps are written here
        return _similar_rows(docs, near, bucket_postings)


def _similar_rows(docs: DataFrame, near: Callable[[DataFrame], DataFrame], bucket_postings: int) -> tuple[DataFrame, DataFrame]:
    common = common_shingles(docs)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in _slices(batches):
            sets = [shingle_set(x.as_py()) for x in b.column(2)]
            keys = np.fromiter(map(set_key, sets), np.uint64, len(sets)).view(np.int64)
            sims = np.fromiter(map(majority, sets), np.uint64, len(sets)).view(np.int64)
            made = [pa.array(keys), pa.array(sims), pa.array([len(s) for s in sets], pa.int32())]
            made += [pa.array([f(s) for s in sets], pa.binary()) for f in (lambda s: prefix(s, common).tobytes(), sketch)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *made], names=["doc_id", "text_key", "fp", "sim", "n", "prefix", "sketch"])

    source = keyed(docs).select("doc_id", "text_key", F.col("text").cast("binary").alias("body"))
    schema = source.select("doc_id", "text_key").schema.add("fp", "long").add("sim", "long").add("n", "integer").add("prefix", "binary").add("sketch", "binary")
    rows = materialize(source.mapInArrow(lean(scan), schema), "prefixes")
    ids = rows.select("doc_id", "text_key", "fp")
    shared = _without_hot(docs, ids, rows.select("fp", "n", "prefix"), common, bucket_postings)

    def check(pairs: DataFrame) -> DataFrame:
        """The similar ones of the pairs. Texts are shingled again for those whose sketches pass, one text a set."""
        pairs = materialize(_plausible(pairs, rows.select("fp", "n", "sketch")), "plausible")
        members = materialize(pairs.select(F.col("u").alias("fp")).union(pairs.select("v")).distinct(), "members")
        texts = _texts(docs, ids, members)
        return materialize(_verified(pairs, materialize(_sets(texts).dropDuplicates(["fp"]), "sets")), "links")

    # positions as the prefix filter has them: the first shared shingle leaves room for enough others
    room = lambda x, y: F.expr(f"{OVER + UNDER} * least({x}.n - {x}.at, {y}.n - {y}.at) >= {OVER} * ({x}.n + {y}.n)")
    named = lambda rows: rows.select(F.col("a.fp").alias("u"), F.col("b.fp").alias("v"))
    tried = materialize(_fingerprint_pairs(rows, near), "pairs")
    links = check(tried)
    roots = materialize(components(links), "roots")
    left = shared
    for kind in ("one leader", "leaders", "all"):
        left = _open(left, roots)
        if kind == "all":
            pairs = _across(left, room, rows.select("fp", "sketch"))
        else:
            lead = left.groupBy("s").agg(F.min(F.struct("fp", "n", "at", "root")).alias("l")).selectExpr("s", "l.fp", "l.n", "l.at", "l.root").alias("b")
            pairs = named(left.alias("a").join(lead, "s").where(F.expr("a.fp > b.fp AND a.root <> b.root")).where(room("a", "b")))
        if kind == "one leader":
            pairs = pairs.groupBy("u", "v").agg(F.count("*").alias("c")).groupBy("u").agg(F.max_by("v", F.struct("c", -F.col("v"))).alias("v"))
        pairs = materialize(pairs.distinct(), "pairs")
        pairs = materialize(pairs.join(tried, ["u", "v"], "left_anti"), "untried")
        if pairs.limit(1).count():
            links, tried = links.unionByName(check(pairs)), tried.unionByName(pairs)
            roots = materialize(components(links), "roots")
    return ids, roots
