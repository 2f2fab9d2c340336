import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from watchlake.llm import lm


def toks(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w] + ["\n"]


class Brute:
    """The model by plain dictionaries."""

    def __init__(self, texts):
        self.pairs, self.words = Counter(), Counter()
        for t in texts:
            ws = toks(t)
            self.words.update(ws)
            self.pairs.update(zip([" ", *ws], ws))
        self.left = Counter(b for _, b in self.pairs)
        self.d2 = lm.discounts([sum(c == k for c in self.pairs.values()) for k in (1, 2, 3, 4)])
        self.d1 = lm.discounts([sum(c == k for c in self.left.values()) for k in (1, 2, 3, 4)])

    def unigram(self, w):
        n = len(self.pairs)
        if not n:
            return 1.0
        open_ = sum(self.d1[min(c, 3)] for c in self.left.values()) / n
        c = self.left[w]
        return (c - self.d1[min(c, 3)]) / n + open_ / (len(self.words) + 1)

    def p(self, a, w):
        after = {b: c for (x, b), c in self.pairs.items() if x == a}
        if not after:
            return self.unigram(w)
        n = sum(after.values())
        c = after.get(w, 0)
        return (c - self.d2[min(c, 3)]) / n + sum(self.d2[min(x, 3)] for x in after.values()) / n * self.unigram(w)

    def score(self, text):
        ws = toks(text)
        n = sum(self.words.values())
        base = sum(math.log10((self.words[w] + 0.5) / (n + 0.5 * (len(self.words) + 1))) for w in ws)
        return len(ws), sum(self.words[w] > 0 for w in ws), base, sum(math.log10(self.p(a, w)) for a, w in zip([" ", *ws], ws))


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{k}" for k in range(60)] + ["É", "Zz", "the", "the", "the"]
    return [" ".join(rng.choices(vocabulary, weights=[1 / (k + 1) for k in range(len(vocabulary))], k=rng.randint(0, 25))) for _ in range(n)]


@pytest.mark.parametrize(("part_bytes", "radix", "maps"), [(10**9, 1024, 4096), (2000, 1024, 4096), (2000, 3, 2)])
def test_equals_brute_force(spark, monkeypatch, part_bytes, radix, maps):
    monkeypatch.setattr(lm, "MOST_MAPS", maps)
    train = [*corpus(1), None, "", "The THE the\tthe", "x " * 3000]
    test = [*corpus(2, 30), None, "", "never seen words", "x x x y"]
    model = lm.train(spark.createDataFrame([(t, 1) for t in train], "text string, score int"), part_bytes=part_bytes, radix=radix)
    assert model.parts == 1 if part_bytes > 10**8 else model.parts > 5
    brute = Brute(train)
    assert (model.tokens, model.types, model.pairs) == (sum(brute.words.values()), len(brute.words), len(brute.pairs))
    df = spark.createDataFrame([(k, t, 2.0) for k, t in enumerate(test)], "doc_id long, text string, base_score double")
    for r in lm.score(df, model, ["doc_id"]).collect():
        want = brute.score(test[r["doc_id"]])
        assert (r["n_tokens"], r["n_known"]) == want[:2]
        assert (r["base_score"], r["score"]) == pytest.approx(want[2:], rel=1e-9)
    words = list(brute.words)
    for a in [" ", "the", "w1", "nowhere"]:  # probabilities of all words and one unknown word add up to 1
        assert sum(brute.p(a, w) for w in words) + brute.p(a, "unknown") == pytest.approx(1)


def test_empty_training(spark):
    df = spark.createDataFrame([(1, "a b")], "doc_id long, text string")
    model = lm.train(df.limit(0))
    r = lm.score(df, model, ["doc_id"]).first()
    assert (r["n_tokens"], r["n_known"], r["base_score"], r["score"]) == (3, 0, 0.0, 0.0)
    assert lm.score(df.limit(0), model, ["doc_id"]).count() == 0


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    fold = {r["doc_id"]: zlib.crc32(str(r["doc_id"]).encode()) % 5 for r in docs}
    brute = Brute([r["text"] for r in docs if fold[r["doc_id"]] != 1])
    got = lm.op9_lm(spark, sf_dir).toPandas().set_index("doc_id")
    assert (got["train_tokens"] == sum(brute.words.values())).all()
    assert all(got.loc[d, "held_out"] == (f == 1) for d, f in fold.items())
    n = sum(brute.words.values())
    for r in docs:
        ws = toks(r["text"])
        assert got.loc[r["doc_id"], "n_tokens"] == len(ws) and got.loc[r["doc_id"], "n_known"] == sum(brute.words[w] > 0 for w in ws)
        assert got.loc[r["doc_id"], "base_score"] == pytest.approx(sum(math.log10((brute.words[w] + 0.5) / (n + 0.5 * (len(brute.words) + 1))) for w in ws))
    held = got[got["held_out"]]
    assert held["score"].sum() > held["base_score"].sum() and np.isfinite(got["score"]).all()


def test_totals_of_many_parts_come_as_a_few_rows(spark, monkeypatch):
    """More parts than one group adds up: the model is that of one part."""
    monkeypatch.setattr(lm, "GATHER", 16)
    df = spark.createDataFrame([(t,) for t in corpus(3, 200)], "text string")
    one, many = lm.train(df), lm.train(df, part_bytes=100, radix=20)
    assert many.parts > 60 and one.common_first == {k: v for k, v in many.common_first.items() if k in one.common_first}
    assert (one.tokens, one.types, one.pairs) == (many.tokens, many.types, many.pairs)
    assert np.array_equal(one.pair_discounts, many.pair_discounts) and np.array_equal(one.word_discounts, many.word_discounts)


def test_packed_numbers_are_narrow_and_whole():
    for top in (0, 200, 70_000, 5_000_000_000):
        x = np.array([0, 1, top], np.int64)
        (got,) = lm._unpack(lm._pack(lm._narrow(x)))
        assert (got == x).all() and got.itemsize == {0: 1, 200: 1, 70_000: 4, 5_000_000_000: 8}[top]
    a, b, n = np.array([9, 5, 9, 5], np.uint64), np.arange(4, dtype=np.uint64), np.array([1, 2, 3, 400])
    got = {k: lm._unpack(x) for k, x in lm._deal_pairs(np.array([1, 0, 1, 0]), a, b, n)}
    assert {k: (v[0].tolist(), v[1].tolist(), v[2].tolist(), v[3].tolist()) for k, v in got.items()} == {0: ([5], [2], [1, 3], [2, 400]), 1: ([9], [2], [0, 2], [1, 3])}
    assert list(lm._deal_pairs(np.array([], int), *(np.array([], np.uint64),) * 3)) == []
