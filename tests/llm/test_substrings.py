import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F
from watchlake.llm import substrings as S

SCHEMA = "doc_id long, text string, kept_sha256 string"


def brute(rows, depth):
    """rows: (doc_id, text, text_key). Each row's words and those that stay, by a table of all windows."""
    order = sorted(range(len(rows)), key=lambda i: (rows[i][0] is not None, rows[i][0] or 0, rows[i][2]))
    seen, out = set(), []
    for i in order:
        words = (rows[i][1] or "").encode().split()
        keep = [True] * len(words)
        for k in range(len(words) - depth + 1):
            w = tuple(words[k : k + depth])
            if w in seen:
                keep[k : k + depth] = [False] * depth
            seen.add(w)
        stay = [w for w, x in zip(words, keep) if x]
        out.append((rows[i][0], len(words), len(words) - len(stay), hashlib.sha256(b" ".join(stay)).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, letters):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(letters)}" if rng.random() < 0.95 else "é"
    passages = [[word() for _ in range(rng.choice([4, 7, 12, 30]))] for _ in range(6)]
    rows = []
    for k in range(120):
        words = []
        for _ in range(rng.randrange(5)):
            words += rng.choice(passages) if rng.random() < 0.6 else [word() for _ in range(rng.randrange(20))]
        rows.append((rng.randrange(200), rng.choice([" ", "\n", "\t  "]).join(words)))
    rows += [rows[3], rows[3], (None, rows[5][1]), (None, None), (7, ""), (8, None), (500, "a " * 200), (501, rows[4][1]), (502, rows[4][1] + " x")]
    rows += [(600 + k, " ".join([word(), word(), *passages[3], word(), word()])) for k in range(60)]
    return [(i, t, "own") for i, t in rows]


@pytest.mark.parametrize("letters, sizes", [
    (1000, {}), (3, {"group_bytes": 500, "pack_bytes": 600}), (40, {"group_bytes": 300, "pack_bytes": 2000, "hot": 3}), (2, {"group_bytes": 1000, "pack_bytes": 300, "hot": 1}),
])
def test_words_that_stay(spark, letters, sizes):
    df = spark.createDataFrame(corpus(letters, letters), SCHEMA).repartition(3)
    rows = [(r["doc_id"], r["text"], r["key"]) for r in df.withColumn("key", F.xxhash64("text")).collect()]
    for depth in (5, 8) if sizes.get("hot") else (8,):
        got = sorted(map(tuple, S.without_repeats(df, depth=depth, **sizes).collect()), key=str)
        assert got == brute(rows, depth)


def test_prefixes_of_many_segments_are_lengthened(spark):
    rows = corpus(5, 1000)
    source = spark.createDataFrame(rows, SCHEMA).select("doc_id", F.xxhash64("text"), F.col("text").cast("binary"))
    hot = S._hot_prefixes(source.where("doc_id >= 600"), 8, 1 << 20, 20)
    assert len(hot)
    pack = S.Pack([t.encode() for _, t, _ in rows[-60:]])
    prefix, first, last = S.segments(pack, 8, hot)
    assert not np.isin(prefix, hot).any() and ((last - first + 1).sum(), len(S.segments(pack, 8, hot[:0])[0])) == ((np.bincount(pack.doc) - 7).sum(), len({*S.segments(pack, 8, hot[:0])[1].tolist()}))


def test_packs_have_the_words_of_their_texts():
    texts = [b"", b"  one\ttwo\n", "é x \x0b\x0cy".encode(), b"\n", b"last"]
    p = S.Pack(texts)
    words = [w for t in texts for w in t.split()]
    assert [p.text[a : b - 1] for a, b in zip(p.begin, p.end)] == words and p.text == b"".join(w + b" " for w in words)
    assert p.doc.tolist() == [i for i, t in enumerate(texts) for _ in t.split()]
    h = dict(zip(words, p.words().tolist()))
    q = S.Pack([b" ".join(reversed(words))])
    assert len(set(h.values())) == len(set(words)) and [h[w] for w in reversed(words)] == q.words().tolist()


def test_deep_nodes_against_a_table():
    rng = np.random.default_rng(4)
    for letters, n in ((2, 300), (5, 500), (50, 50)):
        x = rng.integers(0, letters, n)
        for depth in (1, 2, 5, 6):
            starts, seen = np.arange(n - depth + 1), {}
            want = [seen.setdefault(tuple(x[k : k + depth].tolist()), k) for k in starts.tolist()]
            assert S.deep_nodes(x, starts, depth).tolist() == want


def test_empty_table_and_texts(spark):
    df = spark.createDataFrame([], SCHEMA)
    assert S.without_repeats(df).collect() == []
    got = S.without_repeats(spark.createDataFrame([(1, "a b\n" * 20, ""), (2, None, "")], SCHEMA), texts=True).collect()
    assert {(r["doc_id"], r["kept"], r["n_removed"]) for r in got} == {(1, "a b", 38), (2, "", 0)}
