import hashlib
import random
from binascii import crc32

import numpy as np
import pytest
from watchlake.llm import runs as R
from watchlake.llm.entry import QUERIES


def plain(x, least=12):
    """Every run by its definition: for each period, the maximal stretches; the smallest period of a stretch counts."""
    n, found = len(x), {}
    for q in range(1, n // 2 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            if j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q), q)
            i = j + 1
    return sorted((s, e - s, q) for (s, e), q in found.items())


def strings():
    rng = random.Random(11)
    yield from ([], [1], [1] * 11, [1] * 12, [1] * 400, [1, 2] * 200, list(range(100)) * 2, list(range(100)) * 2 + [5])
    yield ([1, 2] * 60 + [1]) + [1] + [2, 1] * 60  # two zones of one period meet out of step
    yield [0] * 60 + [1] + [0] * 60 + [1] + [0] * 60
    yield ([0, 1, 2] * 20 + [7]) * 5
    t = [0]
    for _ in range(9):
        t += [1 - b for b in t]  # no two sums of powers of this sequence's halves differ, so the plain comparison is needed
    yield t
    yield t + t
    f, g = [0], [0, 1]
    for _ in range(11):
        f, g = g, g + f
    yield g  # Fibonacci words hold as many runs as any
    for k in range(250):
        size, letters = rng.choice([30, 90, 300]), rng.choice([2, 3, 8, 60])
        x = [rng.randrange(letters) for _ in range(size)]
        for _ in range(rng.randrange(4)):
            a, p = rng.randrange(size), rng.randrange(1, 1 + size // 3)
            b = min(size, a + p * rng.randrange(2, 6))
            x[a:b] = [x[a + (i - a) % p] for i in range(a, b)]
        yield x


def test_runs_are_those_of_the_definition():
    for x in strings():
        assert R.find_runs(np.array(x, np.int64)) == plain(x), x


def test_seeds_of_repetitive_texts_grow_with_the_text_alone():
    x = np.zeros(20000, np.int64)
    x[10000] = 1
    h = x.astype(np.uint64) + np.uint64(1)
    for scale in (64, 1024, 4096):
        at, lag = R.seeds(h, R.marks(h, scale // 2 + 1), scale)
        assert len(at) <= 4 * scale


def test_sliding_extremes():
    rng = np.random.default_rng(3)
    for n, w in ((5, 5), (17, 4), (64, 9), (3, 1)):
        a = rng.integers(0, 50, n).astype(np.uint64)
        for least, pick in ((True, min), (False, max)):
            assert R._sliding(a, w, least).tolist() == [pick(a[i : i + w].tolist()) for i in range(n - w + 1)]


ROWS = [
    (1, "a b c " * 8, "own"), (2, None, "own"), (3, "", "own"), (4, " \t\n", "own"), (None, "x " * 40, None), (1, "a b c " * 8, "own"),
    (10**15, "é ü " * 9 + "end", "x"), (5, "one two " * 20, "x"), (6, " ".join(map(str, range(3000))) + " " + " ".join(map(str, range(3000))), "y"),
]


def test_columns_edges_and_names(spark):
    df = spark.createDataFrame(ROWS, "doc_id long, text string, n_runs string")
    got = R.with_runs(df, collapse=True)
    assert got.columns[:3] == df.columns and "_n_runs" in got.columns
    rows = got.collect()
    assert len(rows) == len(ROWS)
    for r in rows:
        words = (r["text"] or "").encode().split()
        want = plain(words)
        assert [tuple(x) for x in r["runs"]] == want and r["_n_runs"] == len(want) and r["n_words"] == len(words)
        stay = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in want)]
        assert r["collapsed"].encode() == b" ".join(stay) and r["collapsed_sha256"] == hashlib.sha256(b" ".join(stay)).hexdigest()
    assert R.with_runs(df.limit(0)).count() == 0


def brute(doc_id, text):
    words = (text or "").encode().split()
    n, h = len(words), crc32(str(doc_id).encode())
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    found = plain(words)
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None,) * 3)
    stay = [w for i, w in enumerate(words) if not any(s + q <= i < s + k for s, k, q in found)]
    lines = "".join(f"{s},{k},{q}\n" for s, k, q in found)
    return (len(found), *best, best[1] and 1000 * best[1] // best[2], hashlib.sha256(lines.encode()).hexdigest(), hashlib.sha256(b" ".join(stay)).hexdigest())


def test_query_against_brute_force(spark, sf_dir):
    got = QUERIES["op11_runs"](spark, sf_dir)
    assert got.columns == ["doc_id", "n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256"]
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()}
    rows = got.collect()
    assert len(rows) == len(docs) and any(r["n_runs"] for r in rows)
    for r in rows:
        if len((docs[r["doc_id"]] or "").split()) < 1500:
            assert tuple(r)[1:] == brute(r["doc_id"], docs[r["doc_id"]]), r["doc_id"]


@pytest.mark.parametrize("words", [20000])
def test_long_texts(words):
    x = np.array([i % 5000 for i in range(words)] + [1] * words + list(range(words)) * 2, np.int64)
    found = R.find_runs(x)
    assert (0, words, 5000) in found and (words, words, 1) in found and any(q == words and k >= 2 * words for _, k, q in found)
