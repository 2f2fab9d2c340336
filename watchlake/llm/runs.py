"""Periodic runs of words, found by multi-scale minimizers.

A run is a stretch of words with smallest period q that holds at least two periods and that no neighbouring word
extends. Periods below ``SHORT`` are found by comparing the text with itself at that lag. Longer ones belong to the
scale W with W <= q < 2W. A scale looks at grams of W/2 words and marks those that are least in some window of W words.
Windows at distance q inside a run hold the same words, so the marks repeat at distance q, and the first window of a run
and the one a period later always lie in it: every run has a pair of equal marks at distance q, a seed. Seeds are
extended to both sides by the longest common extension at lag q.
Where a text repeats with a short period, equal marks form chains of even steps. A chain needs no pairs of its own at
this scale (a period that is a multiple of a shorter one isn't smallest), and two chains need one pair for each distance,
so single words that repeat a thousand times cost no more than others.
A document is one row, and its runs hang on its own words alone: there is no shuffle, and any number of rows of any
source is spread as the table is.
"""

from __future__ import annotations

import hashlib
from binascii import crc32
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchlake.llm.common import free_name, table

SHORT = 8  # periods below this are found by comparing at that lag
LEAST = 12  # words of the shortest run
BASE = np.uint64(0x9E3779B97F4A7C15)


def word_ids(words: list[bytes]) -> np.ndarray:
    """A number for each word, the same for equal words."""
    known: dict[bytes, int] = {}
    return np.fromiter((known.setdefault(w, len(known)) for w in words), np.int64, len(words))


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _sliding(a: np.ndarray, w: int, least: bool) -> np.ndarray:
    """Least (or greatest) of each ``w`` consecutive values, by running minima of blocks from both ends."""
    pick = np.minimum if least else np.maximum
    n = len(a)
    blocks = np.full(-(-n // w) * w, np.iinfo(np.uint64).max if least else 0, np.uint64)
    blocks[:n] = a
    blocks = blocks.reshape(-1, w)
    ahead = pick.accumulate(blocks, axis=1).ravel()
    back = pick.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return pick(back[: n - w + 1], ahead[w - 1 : n])


def marks(h: np.ndarray, w: int) -> np.ndarray:
    """Places whose value is least in some window of ``w`` values."""
    least = _sliding(h, w, True)
    padded = np.zeros(len(h) + w - 1, np.uint64)
    padded[w - 1 : w - 1 + len(least)] = least
    return np.flatnonzero(_sliding(padded, w, False) == h)


def seeds(h: np.ndarray, at: np.ndarray, scale: int) -> tuple[np.ndarray, np.ndarray]:
    """(place, distance) of equal marks with scale <= distance < 2 * scale: for each two chains, one pair a distance."""
    order = np.lexsort((at, h[at]))
    at, key = at[order], h[at][order]
    same = np.zeros(len(at), bool)
    same[1:] = key[1:] == key[:-1]
    if not same.any():
        return np.empty(0, np.int64), np.empty(0, np.int64)
    step = np.zeros(len(at), np.int64)
    step[1:] = at[1:] - at[:-1]
    close = same & (step <= scale // 4)
    # a mark joins its predecessor's chain at the same step; after a step that changes, a new chain begins
    joined = close.copy()
    joined[1:] &= ~close[:-1] | (step[1:] == step[:-1])
    first = np.flatnonzero(~joined)
    count = np.diff(np.append(first, len(at)))
    lo, hi, kind = at[first], at[first + count - 1], key[first]
    stride = np.where(count > 1, (hi - lo) // np.maximum(count - 1, 1), 0)
    places, lags = [], []
    t = 1
    while t < len(first):
        a, b = np.arange(len(first) - t), np.arange(t, len(first))
        near = (kind[a] == kind[b]) & (lo[b] - hi[a] < 2 * scale)
        if not near.any():
            break
        a, b = a[near], b[near]
        d = np.maximum(stride[a], stride[b])
        odd = (stride[a] > 0) & (stride[b] > 0) & (stride[a] != stride[b])
        for i, j in zip(a[odd].tolist(), b[odd].tolist()):  # chains of unlike steps: all distances
            left, right = np.arange(lo[i], hi[i] + 1, stride[i]), np.arange(lo[j], hi[j] + 1, stride[j])
            for p in left.tolist():
                gap = right - p
                gap = gap[(gap >= scale) & (gap < 2 * scale)]
                places.append(np.full(len(gap), p))
                lags.append(gap)
        a, b, d = a[~odd], b[~odd], np.maximum(d[~odd], 1)
        # distances lo_b - hi_a + k * d; the pair is (hi_a, some b) as far as b reaches, then (some a, hi_b)
        base = lo[b] - hi[a]
        from_k = np.maximum(0, -((base - scale) // d))
        to_k = np.minimum((hi[b] - lo[a] - base) // d, (2 * scale - 1 - base) // d)
        many = np.maximum(0, to_k - from_k + 1)
        row = np.repeat(np.arange(len(a)), many)
        k = np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many) + from_k[row]
        gap = base[row] + k * d[row]
        places.append(np.where(hi[a][row] + gap <= hi[b][row], hi[a][row], hi[b][row] - gap))
        lags.append(gap)
        t += 1
    return (np.concatenate(x) if x else np.empty(0, np.int64) for x in (places, lags))


class _Texts:
    """Compares stretches of one sequence by prefix sums of powers."""

    def __init__(self, x: np.ndarray):
        n = len(x)
        self.n, self.power = n, np.full(n + 1, BASE)
        self.power[0] = 1
        self.power = np.multiply.accumulate(self.power)
        self.sums = np.zeros(n + 1, np.uint64)
        np.cumsum(_mixed(x.astype(np.uint64) + np.uint64(1)) * self.power[:n], out=self.sums[1:])

    def equal(self, i: np.ndarray, j: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Whether the ``size`` words from i and from j > i are the same."""
        return (self.sums[i + size] - self.sums[i]) * self.power[j - i] == self.sums[j + size] - self.sums[j]

    def _most(self, ok, most: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros_like(most), most.copy()
        while (lo < hi).any():
            mid = (lo + hi + 1) // 2
            good = ok(mid)
            lo, hi = np.where(good, mid, lo), np.where(good, hi, mid - 1)
        return lo

    def extents(self, at: np.ndarray, lag: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and last place + 1 of the stretch round ``at`` whose words equal those ``lag`` further on."""
        j = at + lag
        ahead = self._most(lambda s: self.equal(at, j, s), self.n - j)
        back = self._most(lambda s: self.equal(at - s, j - s, s), at)
        return at - back, at + ahead


def _stretch(x: np.ndarray, at: int, lag: int) -> tuple[int, int]:
    """``extents`` of one pair by plain comparison, in growing blocks."""
    ends = []
    for forward in (True, False):
        done, block, limit = 0, 64, len(x) - at - lag if forward else at
        while done < limit:
            size = min(block, limit - done)
            i = at + done if forward else at - done - size
            unlike = np.flatnonzero(x[i : i + size] != x[i + lag : i + lag + size])
            if len(unlike):
                done += int(unlike[0]) if forward else size - 1 - int(unlike[-1])
                break
            done, block = done + size, block * 2
        ends.append(done)
    return at - ends[1], at + ends[0]


def find_runs(x: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run, by start, then period."""
    n = len(x)
    found: dict[tuple[int, int], int] = {}

    def keep(start: int, end: int, q: int) -> None:
        if end - start >= max(least, 2 * q):
            found[start, end] = min(q, found.get((start, end), q))

    for q in range(1, min(SHORT, n // 2 + 1)):
        same = np.zeros(n - q + 2, np.int8)
        same[1:-1] = x[q:] == x[:-q]
        turn = np.diff(same)
        for start, end in zip(np.flatnonzero(turn == 1).tolist(), np.flatnonzero(turn == -1).tolist()):
            keep(start, end + q, q)
    scale = SHORT
    if 2 * scale <= n:
        texts = _Texts(x)
        h = _mixed(x.astype(np.uint64) + np.uint64(1))
        for size in (1, 2):  # grams of four words
            h = _mixed(h[:-size] * BASE + h[size:])
    while 2 * scale <= n:
        at, lag = seeds(h, marks(h, scale // 2 + 1), scale)
        if len(at):
            start, end = texts.extents(at, lag)
            long = end - start >= np.maximum(lag, least - lag)
            for s, e, q in sorted(set(zip(start[long].tolist(), end[long].tolist(), lag[long].tolist()))):
                if np.array_equal(x[s:e], x[s + q : e + q]):
                    keep(s, e + q, q)
                    continue
                for a in at[(start == s) & (end == e) & (lag == q)].tolist():  # unlike words of equal sums
                    low, high = _stretch(x, a, q)
                    keep(low, high + q, q)
        h = _mixed(h[: -(scale // 2)] * BASE + h[scale // 2 :])
        scale *= 2
    return sorted((s, e - s, q) for (s, e), q in found.items())


def collapsed(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """Which of ``n`` words stay: those that no run contains after its first period."""
    stay = np.ones(n, bool)
    for start, length, period in runs:
        stay[start + period : start + length] = False
    return stay


def planted(doc_id: int | None, words: list[bytes]) -> list[bytes]:
    """The words that the query looks at: in a tenth of the documents, by id, the text ends in a repeated stretch."""
    h = crc32(str(doc_id).encode()) if doc_id is not None else 1
    n, g = len(words), h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return words[:a] + [words[a + i % p] for i in range(n - a)]


SCHEMA = "n_words long, n_runs long, start long, length long, period long, runs_sha256 string, collapsed_sha256 string"


def with_runs(df: DataFrame, text: str = "text", least: int = LEAST, rewrite: str | None = None, collapse: bool = False) -> DataFrame:
    """``df`` with the runs of words of its text column.

    New columns: n_words, n_runs, start, length and period of the longest run (ties: smallest start, then period; null
    without one), runs_sha256 of the lines ``start,length,period`` of all runs, collapsed_sha256 of the words that stay,
    joined by one space; with ``collapse`` also runs, an array of (start, length, period), and collapsed, the words that
    stay. Words are runs of other characters than the six ASCII white-space ones, told apart as they are. ``rewrite``
    names an id column; see ``planted``, which leaves null ids alone.

    A null or empty text has no words and no run. A text of any length is one row's work, in memory of about a hundred
    bytes a word. Repeated rows give repeated results, an empty table an empty one. Own columns that have the name of a new one
    stay, and the new one gets an underscore.
    """
    schema = T.StructType.fromDDL(SCHEMA + (", runs array<struct<start:long,length:long,period:long>>, collapsed string" if collapse else ""))
    names = []
    for f in schema.fields:
        names.append(free_name([*df.columns, *names], f.name))
    body, ident = free_name([*df.columns, *names], "body"), free_name([*df.columns, *names], "ident")
    more = T.StructType([T.StructField(x, f.dataType) for x, f in zip(names, schema.fields)])

    def of(doc_id: int | None, raw: bytes | None) -> tuple:
        words = (raw or b"").split()
        if rewrite:
            words = planted(doc_id, words)
        runs = find_runs(word_ids(words), least)
        start, length, period = max(runs, key=lambda r: (r[1], -r[0], -r[2])) if runs else (None, None, None)
        lines = "".join(f"{s},{k},{q}\n" for s, k, q in runs).encode()
        rest = b" ".join(w for w, s in zip(words, collapsed(len(words), runs).tolist()) if s) if runs else b" ".join(words)
        row = (len(words), len(runs), start, length, period, hashlib.sha256(lines).hexdigest(), hashlib.sha256(rest).hexdigest())
        return (*row, [dict(zip(("start", "length", "period"), r)) for r in runs], rest.decode("utf-8", "replace")) if collapse else row

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = None
        for b in batches:
            for k in range(0, b.num_rows, 256):
                part = b.slice(k, 256)
                rows = [of(i.as_py(), t.as_py()) for i, t in zip(part.column(part.num_columns - 1), part.column(part.num_columns - 2))]
                kinds = kinds or to_arrow_schema(more)
                new = [pa.array(c, f.type) for c, f in zip(zip(*rows), kinds)]
                yield pa.RecordBatch.from_arrays([*part.columns[:-2], *new], names=[*part.schema.names[:-2], *names])

    source = df.withColumns({body: F.col(f"`{text}`").cast("binary"), ident: F.col(f"`{rewrite}`").cast("long") if rewrite else F.lit(None).cast("long")})
    return source.mapInArrow(run, T.StructType([*df.schema.fields, *more.fields]))


def to_arrow_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema as convert

    return convert(schema)


def op11_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of every document, for the texts that ``planted`` makes; cases as in ``with_runs``."""
    found = with_runs(table(spark, sf_dir, "documents").select("doc_id", "text"), rewrite="doc_id")
    exponent = F.floor(F.lit(1000) * F.col("length") / F.col("period")).cast("long")
    return found.select("doc_id", "n_runs", "start", "length", "period", exponent.alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
