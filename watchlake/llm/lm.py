"""Language-model scores: an interpolated modified Kneser-Ney bigram model.

Spark counts the model. Tasks count word pairs in runs of text, sorted and packed, and deal them to parts by
the first word; the pairs of the few commonest first words are dealt by both words, so that no part grows with
one word's share. A part adds its pairs up and writes them as sorted hash arrays into the folder that all
machines share. From there it deals what it knows of each second word to the parts of the words, which write
theirs. Workers map these files into memory and look words and pairs up by binary search; only pages that
are asked for are read, and machines keep one copy for all their workers.

The model's order is 2 (see the README for why no higher one is registered).
"""

from __future__ import annotations

import mmap
import os
import uuid
from collections import OrderedDict
from collections.abc import Iterator
from urllib.parse import urlparse

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.llm.common import fold, free_name, shared_path, table

#: Hashes of what no word can be: white space is never in a word.
BEGIN_WORD, END_WORD = b" ", b"\n"
RUN_TOKENS = 1_500_000  # counted or scored at once in a task


def _hash(word: bytes) -> int:
    from xxhash import xxh64_intdigest

    return xxh64_intdigest(word)


def tokens(texts: list[bytes | None]) -> tuple[np.ndarray, np.ndarray]:
    """Word hashes of all texts, an end after each text, and how many each text has."""
    from xxhash import xxh64_intdigest

    split = [(x or b"").lower().split() for x in texts]
    sizes = np.fromiter((len(ws) + 1 for ws in split), np.int64, len(split))
    out = np.full(int(sizes.sum()), _hash(END_WORD), np.uint64)
    at = 0
    for ws, n in zip(split, sizes.tolist()):
        out[at : at + n - 1] = np.fromiter(map(xxh64_intdigest, ws), np.uint64, n - 1)
        at += n
    return out, sizes


def before(h: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The hash before each token; the begin mark at the start of a text."""
    out = np.empty_like(h)
    out[1:] = h[:-1]
    out[np.cumsum(sizes) - sizes] = _hash(BEGIN_WORD)
    return out


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = a * np.uint64(0x9E3779B97F4A7C15) + (b ^ (b >> np.uint64(31)))
        x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
        return x ^ (x >> np.uint64(32))


def _runs(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple[pa.RecordBatch, list]]:
    """Slices of batches with about RUN_TOKENS tokens each (six bytes a token)."""
    for b in batches:
        texts = b.column(column)
        start = size = 0
        for i in range(b.num_rows):
            size += len(texts[i].as_buffer() or b"") if texts[i].is_valid else 0
            if size >= 6 * RUN_TOKENS or i + 1 == b.num_rows:
                part = b.slice(start, i + 1 - start)
                yield part, part.column(column).to_pylist()
                start, size = i + 1, 0


def _sum_by(key: np.ndarray, *values: np.ndarray) -> tuple[np.ndarray, ...]:
    """Distinct keys in order, and the sums of the values of each."""
    order = np.argsort(key, kind="stable")
    key = key[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
    return (key[starts], *(np.add.reduceat(v[order], starts) if len(key) else v for v in values))


def _narrow(x: np.ndarray) -> np.ndarray:
    """Numbers of 0 or more in the fewest bytes that hold them."""
    top = int(x.max()) if len(x) else 0
    return x.astype(next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if top <= np.iinfo(t).max))


def _pack(*arrays: np.ndarray) -> bytes:
    """Arrays of unsigned numbers after a head that says how many there are, how long each is and how wide its numbers are."""
    head = [len(arrays), *(v for a in arrays for v in (len(a), a.itemsize))]
    return b"".join([np.array(head, np.int64).tobytes(), *(np.ascontiguousarray(a).tobytes() for a in arrays)])


def _unpack(blob) -> list[np.ndarray]:
    k = int(np.frombuffer(blob, np.int64, 1)[0])
    head, at, out = np.frombuffer(blob, np.int64, 2 * k, 8).tolist(), 8 + 16 * k, []
    for n, width in zip(head[::2], head[1::2]):
        out.append(np.frombuffer(blob, f"u{width}", n, at))
        at += n * width
    return out


#: Files of sorted hashes, and how many numbers they hold of each: a pair's count; a first word's total and how many
#: of its pairs have the counts 1, 2 and more; a word's number of words before it and its count.
FAMILIES = {"pair": 1, "first": 4, "word": 2}
MOST_MAPS = 4096  # files that a worker has mapped at once
RADIX = 1024  # parts that a run of text is dealt to at once
GATHER = 256  # parts whose common words' totals are added up in one group


def _cuts(part: np.ndarray) -> Iterator[tuple[int, int]]:
    """Where runs of equal numbers begin and end."""
    cuts = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(0, np.int64)
    yield from zip(cuts[:-1].tolist(), cuts[1:].tolist())


def _deal_pairs(part: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray) -> Iterator[tuple[int, bytes]]:
    """The pairs of each part, each first word written once."""
    order = np.lexsort((a, part))
    part, a, b, n = part[order], a[order], b[order], n[order]
    for x, y in _cuts(part):
        starts = np.array([i for i, _ in _cuts(a[x:y])], np.int64)
        yield int(part[x]), _pack(a[x:y][starts], _narrow(np.diff(np.append(starts, y - x))), b[x:y], _narrow(n[x:y]))


def _deal(part: np.ndarray, keys: np.ndarray, *values: np.ndarray) -> Iterator[tuple[int, bytes]]:
    order = np.argsort(part, kind="stable")
    part = part[order]
    for x, y in _cuts(part):
        yield int(part[x]), _pack(keys[order[x:y]], *(_narrow(v[order[x:y]]) for v in values))


def _write(folder: str, family: str, part: int, keys: np.ndarray, *values: np.ndarray) -> None:
    """Whole or not at all: a task that runs twice writes the same bytes and renames them into place."""
    path = f"{folder}/{family}-{part}"
    with open(tmp := f"{path}.{uuid.uuid4().hex}", "wb") as f:
        f.write(_pack(keys, *map(_narrow, values)))
    os.replace(tmp, path)


class Model:
    """What scoring needs: the folder of the arrays, numbers of parts, totals, discounts, the common words' totals."""

    def __init__(self, folder: str, parts: int, common: np.ndarray, totals: dict):
        self.folder, self.parts, self.common = folder, parts, common
        self.tokens, self.types, self.pairs = totals["tokens"], totals["types"], totals["pairs"]
        self.common_first: dict[int, tuple] = totals["common_first"]
        self.pair_discounts, self.word_discounts = discounts(totals["pair_counts"]), discounts(totals["word_counts"])
        self.word_open = float(np.dot(self.word_discounts[1:], totals["word_up_to"]))
        self._maps: OrderedDict[tuple, list[np.ndarray] | None] = OrderedDict()

    def __getstate__(self):
        return self.__dict__ | {"_maps": OrderedDict()}

    def _arrays(self, family: str, part: int) -> list[np.ndarray] | None:
        """The arrays of a file. Those used last stay mapped, ``MOST_MAPS`` of them."""
        if (family, part) in self._maps:
            self._maps.move_to_end((family, part))
        else:
            if len(self._maps) >= MOST_MAPS:
                self._maps.popitem(last=False)
            got = None
            try:
                with open(f"{self.folder}/{family}-{part}", "rb") as f:
                    got = _unpack(mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ, trackfd=False))
            except FileNotFoundError:  # no key fell into this part
                pass
            self._maps[family, part] = got
        return self._maps[family, part]

    def look_up(self, family: str, keys: np.ndarray, part: np.ndarray) -> list[np.ndarray]:
        """Values of sorted or unsorted distinct keys; 0 where there is none."""
        out = [np.zeros(len(keys), np.int64) for _ in range(FAMILIES[family])]
        order = np.lexsort((keys, part))
        part = part[order]
        for a, b in _cuts(part):
            if (arrays := self._arrays(family, int(part[a]))) is None or not len(arrays[0]):
                continue
            idx = order[a:b]
            at = np.minimum(np.searchsorted(arrays[0], keys[idx]), len(arrays[0]) - 1)
            has = arrays[0][at] == keys[idx]
            for o, values in zip(out, arrays[1:]):
                o[idx[has]] = values[at[has]]
        return out

    def score(self, texts: list[bytes | None]) -> tuple[np.ndarray, ...]:
        """n_tokens, n_known, base_score and score of each text."""
        h, sizes = tokens(texts)
        prev = before(h, sizes)
        words, at = np.unique(h, return_inverse=True)
        left, count = self.look_up("word", words, (words % np.uint64(self.parts)).astype(np.int64))
        uniform = 1.0 / (self.types + 1)
        pairs = max(1, self.pairs)
        p1 = (left - self.word_discounts[np.minimum(left, 3)]) / pairs + (self.word_open / pairs if self.pairs else 1.0) * uniform
        base = np.log10((count + 0.5) / (self.tokens + 0.5 * (self.types + 1)))
        firsts, at_first = np.unique(prev, return_inverse=True)
        n, c1, c2, c3 = self.look_up("first", firsts, (firsts % np.uint64(self.parts)).astype(np.int64))
        for i in np.flatnonzero(np.isin(firsts, self.common)):
            n[i], c1[i], c2[i], c3[i] = self.common_first.get(int(firsts[i]), (0, 0, 0, 0))
        d = self.pair_discounts
        open_ = np.where(n > 0, (d[1] * c1 + d[2] * c2 + d[3] * c3) / np.maximum(n, 1), 1.0)
        keys, one, at_pair = np.unique(mix(prev, h), return_index=True, return_inverse=True)
        (c,) = self.look_up("pair", keys, pair_part(prev[one], h[one], self.common, self.parts))
        c = c[at_pair]
        total = np.maximum(n, 1)[at_first]
        p = (c - d[np.minimum(c, 3)]) / total + open_[at_first] * p1[at]
        starts = np.cumsum(sizes) - sizes
        add = lambda x: np.add.reduceat(x, starts) if len(starts) else x[:0]
        return sizes, add((count > 0)[at].astype(np.int64)), add(base[at]), add(np.log10(p))


def discounts(n: list[int]) -> np.ndarray:
    """The discounts of counts 0, 1, 2 and 3 or more, from how many have the counts 1 to 4."""
    if min(n[:3]) <= 0:  # too little text for the estimate
        return np.array([0.0, 0.5, 0.75, 0.9])
    y = n[0] / (n[0] + 2 * n[1])
    d = [1 - 2 * y * n[1] / n[0], 2 - 3 * y * n[2] / n[1], 3 - 4 * y * n[3] / n[2]]
    return np.array([0.0, *(min(max(x, 0.05), k + 0.95) for k, x in enumerate(d))])


def pair_part(a: np.ndarray, b: np.ndarray, common: np.ndarray, parts: int) -> np.ndarray:
    return (np.where(np.isin(a, common), mix(b, a), a) % np.uint64(parts)).astype(np.int64)


def common_words(docs: DataFrame, text: str, n: int, sample_docs: int = 1000, share: float = 0.0005) -> np.ndarray:
    """Hashes of words with at least that share of a sample's tokens, and the begin mark. Only where pairs are kept hangs on them."""
    some = docs.where(F.pmod(F.xxhash64(F.col(text), F.lit(3)), F.lit(1 << 20)) < int(min(1.0, sample_docs / max(1, n)) * (1 << 20)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _runs(batches, 0):
            words, counts = np.unique(tokens(texts)[0], return_counts=True)
            often = np.argsort(-counts, kind="stable")[: int(2 / share)]
            yield pa.RecordBatch.from_arrays([pa.array(words[often].view(np.int64)), pa.array(counts[often].astype(np.int64))], names=["w", "c"])

    found = some.select(F.col(text).cast("binary")).mapInArrow(run, "w long, c long").groupBy("w").agg(F.sum("c").alias("c"))
    total = found.agg(F.sum("c")).first()[0] or 0
    top = found.where(F.col("c") >= share * total).select("w").toPandas()["w"].to_numpy(np.int64)  # at most 1 / share rows
    return np.unique(np.append(top.view(np.uint64), np.uint64(_hash(BEGIN_WORD))))


def train(docs: DataFrame, text: str = "text", part_bytes: int = 12_000_000, radix: int = RADIX) -> Model:
    """Count ``docs`` and write the model's arrays below ``spark.checkpoint.dir``, which must be mounted as files.

    The number of parts grows with the text: a part gets the pairs of ``part_bytes`` of it or so (about two million
    tokens), whatever the session's settings are. A run of text is dealt to ``radix`` parts or so at once; where there are more,
    pairs are dealt in two rounds, so the number of blobs follows the text and not its square. Null and empty texts are one end each; texts of any length are counted
    whole, and every row counts, repeated ones too. An empty table gives a model of nothing. Columns besides ``text``
    aren't read.
    """
    spark = docs.sparkSession
    where = urlparse(shared_path(spark, "lm"))
    if where.scheme not in ("", "file"):
        raise ValueError(f"workers map the model's files into memory, so the shared folder must be mounted: {where.geturl()}")
    folder = where.path
    os.makedirs(folder)
    n, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length(text)), F.lit(0))).first()
    parts = 1 + (size + n) // part_bytes
    wide = -(-parts // radix)  # neighbouring parts that a run is dealt to as one, and that are told apart in a second round
    common = common_words(docs, text, n)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, texts in _runs(batches, 0):
            h, sizes = tokens(texts)
            prev = before(h, sizes)
            _, one, n = np.unique(mix(prev, h), return_index=True, return_counts=True)
            a, b = prev[one], h[one]
            dealt = list(_deal_pairs(pair_part(a, b, common, parts) // wide, a, b, n))
            yield pa.RecordBatch.from_arrays([pa.array([k for k, _ in dealt], pa.int64()), pa.array([x for _, x in dealt], pa.binary())], names=["part", "blob"])

    def again(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Pairs of neighbouring parts, of many runs at a time, dealt to their own parts."""
        held: dict[int, list] = {}
        size: dict[int, int] = {}

        def flush(part: int) -> pa.RecordBatch:
            got = [(np.repeat(heads, counts), b, n) for heads, counts, b, n in map(_unpack, held.pop(part))]
            a, b, n = (np.concatenate(x) for x in zip(*got))
            size.pop(part)
            _, one, at = np.unique(mix(a, b), return_index=True, return_inverse=True)
            total = np.bincount(at, n.astype(np.float64)).astype(np.int64)  # exact below 2 ** 53
            dealt = list(_deal_pairs(pair_part(a[one], b[one], common, parts), a[one], b[one], total))
            return pa.RecordBatch.from_arrays([pa.array([k for k, _ in dealt], pa.int64()), pa.array([x for _, x in dealt], pa.binary())], names=["part", "blob"])

        for batch in batches:
            for part, blob in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held.setdefault(part, []).append(blob)
                size[part] = size.get(part, 0) + len(blob)
                if size[part] >= part_bytes:
                    yield flush(part)
        for part in list(held):
            yield flush(part)

    def pairs(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        got = [(np.repeat(heads, counts), b, n) for heads, counts, b, n in map(_unpack, pdf["blob"])]
        a, b, n = (np.concatenate(x) for x in zip(*got))
        del got
        k = mix(a, b)
        order = np.argsort(k, kind="stable")
        k = k[order]
        starts = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
        n = np.add.reduceat(n[order].astype(np.int64), starts)
        a, b, k = a[order[starts]], b[order[starts]], k[starts]
        _write(folder, "pair", key[0], k, n)
        first = _sum_by(a, n, (n == 1).astype(np.int64), (n == 2).astype(np.int64), (n > 2).astype(np.int64))
        shared = np.isin(first[0], common)
        _write(folder, "first", key[0], *(x[~shared] for x in first))
        stats = np.array([len(k), *((n == i).sum() for i in (1, 2, 3, 4))], np.uint64)
        words = _sum_by(b, np.ones(len(b), np.int64), n)
        rows = list(_deal((words[0] % np.uint64(parts)).astype(np.int64), *words))
        rows.append((-1 - key[0] // GATHER, _pack(stats, *(x[shared].astype(np.uint64) for x in first))))
        return pd.DataFrame(rows, columns=["part", "blob"])

    def words_(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        if key[0] < 0:
            got = [_unpack(blob) for blob in pdf["blob"]]
            stats = np.sum([x[0].astype(np.int64) for x in got], axis=0)
            firsts = _sum_by(*(np.concatenate(x) if k == 0 else np.concatenate(x).astype(np.int64) for k, x in enumerate(zip(*(x[1:] for x in got)))))
            rows = [("pairs", 0, *stats.tolist(), 0, 0)] + [("first", w, *v, 0, 0, 0) for w, *v in zip(firsts[0].view(np.int64).tolist(), *(x.tolist() for x in firsts[1:]))]
            return pd.DataFrame(rows, columns=names)
        w, left, n = (np.concatenate(x) for x in zip(*map(_unpack, pdf["blob"])))
        w, left, n = _sum_by(w, left.astype(np.int64), n.astype(np.int64))
        _write(folder, "word", key[0], w, left, n)
        stats = [len(w), n.sum(), *((left == i).sum() for i in (1, 2, 3, 4)), (left >= 3).sum()]
        return pd.DataFrame([("words", 0, *(int(x) for x in stats))], columns=names)

    names = ["kind", "word", *(f"s{k}" for k in range(7))]
    blobs = docs.select(F.col(text).cast("binary")).mapInArrow(count, "part long, blob binary")
    if wide > 1:
        blobs = blobs.repartition(min(radix, parts), "part").mapInArrow(again, "part long, blob binary")
    # as many tasks as parts, whatever the session's settings are
    dealt = blobs.repartition(parts, "part").groupBy("part").applyInPandas(pairs, "part long, blob binary")
    done = dealt.repartition(parts, "part").groupBy("part").applyInPandas(words_, "kind string, word long, " + ", ".join(f"s{k} long" for k in range(7)))
    rows = done.groupBy("kind", "word").agg(*(F.sum(f"s{k}").alias(f"s{k}") for k in range(7))).collect()  # two rows and one a common word
    sums = {r["kind"]: list(r)[2:] for r in rows if r["kind"] != "first"}
    word, stats = sums.get("words", [0] * 7), sums.get("pairs", [0] * 5)
    totals = {"tokens": word[1], "types": word[0], "pairs": stats[0], "pair_counts": stats[1:5], "word_counts": word[2:6], "word_up_to": [word[2], word[3], word[6]]}
    totals["common_first"] = {int(np.int64(r["word"]).view(np.uint64)): tuple(r)[2:6] for r in rows if r["kind"] == "first"}
    return Model(folder, parts, common, totals)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text") -> DataFrame:
    """The kept columns, n_tokens, n_known, base_score and score (log10 probabilities): one row per row of ``docs``.

    A null text is empty: its end is its only token. Texts of any length are scored whole, and texts that repeat score
    alike. A model of no text gives every token probability 1. An empty table stays empty. Other columns may have any
    names; those that are kept should differ from the new ones.
    """
    added = ["n_tokens", "n_known", "base_score", "score"]
    schema = docs.select(*keep).schema.add("n_tokens", "long").add("n_known", "long").add("base_score", "double").add("score", "double")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b, texts in _runs(batches, len(keep)):
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            yield pa.RecordBatch.from_arrays([*cols, *(pa.array(x) for x in model.score(texts))], names=[*keep, *added])

    return docs.select(*keep, F.col(text).cast("binary").alias(free_name([*keep, *added], "body"))).mapInArrow(run, schema)


def op9_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every document by a model of four fifths of them; a null id is in training. Other cases as in ``train`` and ``score``."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", (fold(F.col("doc_id")) == 1).alias("held_out"))
    model = train(docs.where("NOT held_out"))
    found = score(docs, model, ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "n_tokens", "n_known", F.lit(model.tokens).cast("long").alias("train_tokens"), "base_score", "score")
