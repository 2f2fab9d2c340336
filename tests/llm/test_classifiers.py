import math

import numpy as np
import pytest
from pyspark.sql import functions as F
from watchlake.llm import quality, toxicity
from watchlake.llm.labelled import Isotonic

BIG = "/root/testdata/sf0.1"


def auc(score, label):
    rank = np.argsort(np.argsort(score, kind="stable")) + 1
    pos = label == 1
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.mark.parametrize(("query", "label", "least"), [(toxicity.op5_toxicity, "toxic", 0.95), (quality.op7_quality, "quality", 0.97)])
def test_held_out(spark, query, label, least):
    got = query(spark, BIG).toPandas()
    assert len(got) == spark.read.parquet(f"{BIG}/documents.parquet").count() and got["score"].between(0, 1).all()
    known = got.merge(spark.read.parquet(f"{BIG}/labels.parquet").toPandas(), on="doc_id")
    held = known[known["held_out"]]
    assert auc(held["score"].to_numpy(), held[label].to_numpy()) > least
    assert (held["predicted"] == held[label]).mean() > 0.97


def small(spark):
    rows = [(k, "you are an idiot and a moron " * 3 if k % 2 else "a calm and friendly sentence about gardens " * 3) for k in range(200)]
    rows += [(1000, None), (1001, ""), (1002, "x " * 60000), (1002, "x " * 60000), (None, "you idiot")]
    docs = spark.createDataFrame([(*r, "en", 1.0, [2.0]) for r in rows], "doc_id long, text string, label string, score double, toxicity_features array<double>")
    labels = spark.createDataFrame([(k, k % 2, 1 - k % 2) for k in range(200)] + [(5, None, None), (None, 1, 1)], "doc_id long, toxic int, quality int")
    return docs, labels


def test_edges(spark):
    docs, labels = small(spark)
    for keep, drop in ((toxicity.drop_toxic, True), (quality.keep_quality, False)):
        kept = keep(docs, labels)
        assert kept.columns == docs.columns
        texts = [r["text"] for r in kept.collect()]
        assert not any(t and "moron" in t for t in texts) and sum(bool(t) and "calm" in t for t in texts) == 100, drop
        assert keep(docs.limit(0), labels).count() == 0
        assert keep(docs, labels.limit(0)).count() == keep(docs, labels.where("toxic = 1")).count() == keep(docs, labels.withColumn("doc_id", F.lit(None).cast("long"))).count() == docs.count()
    scored = toxicity.fit_toxicity(docs, labels).score(docs, "score2")
    assert scored.where("score2 IS NULL").count() == 0 and scored.count() == docs.count()


def test_features():
    x = dict(zip(toxicity.FEATURES, toxicity.Extractor({"scum": 2.0})("You 1d1ot! SCUM scum, s.c.u.m calm words")))
    assert x["max_weight"] == 2 and x["second"] > 0 and x["near_second"] > 0 and x["obfuscated"] > 0 and x["obfuscated_hits"] > 0 and x["insults"] > 0
    assert len(toxicity.Extractor({})(None)) == len(toxicity.FEATURES) and len(quality.statistics(None)) == len(quality.STATISTICS) == len(quality.statistics("a b\na"))


def test_isotonic_rises_and_is_least_squares():
    rng = np.random.default_rng(1)
    m = rng.normal(size=400)
    y = (rng.random(400) < 1 / (1 + np.exp(-2 * m))).astype(float)
    f = Isotonic(m, y)
    p = f(np.sort(m))
    assert (np.diff(p) >= -1e-12).all() and 0 <= p.min() and p.max() <= 1 and ((f(m) - y) ** 2).mean() < ((y.mean() - y) ** 2).mean()
    assert 0 <= Isotonic(np.zeros(0), np.zeros(0))(np.zeros(1))[0] <= 1


@pytest.mark.parametrize(("files", "parts", "fan_in"), [(7, None, 8), (40, 30, 3), (40, 9, 2), (1, 5, 2)])
def test_normal_equations_are_sums(spark, files, parts, fan_in):
    """Also over a tree of several levels, with empty partitions, and without any row."""
    rng = np.random.default_rng(2)
    x, y = rng.normal(size=(300, 3)), rng.random(300)
    model = quality.QualityModel(np.zeros(3), np.ones(3), rng.normal(size=(3, 5)), rng.random(5), None, None)
    rows = spark.createDataFrame([(a.tolist(), float(b)) for a, b in zip(x, y)], "x array<double>, label double").repartition(files)
    a, b = quality.normal_equations(rows, model, fan_in, parts)
    z = model.features(x)
    assert np.allclose(a, z.T @ z) and np.allclose(b, z.T @ y)
    few = rows.where(F.col("label") < 0.02)
    n = few.count()
    a, b = quality.normal_equations(few, model, fan_in, parts)
    assert n and np.isclose(a[-1, -1], n)
    a, b = quality.normal_equations(rows.limit(0), model, fan_in, parts)
    assert not a.any() and not b.any()


def brute_features(lexicon, text):
    """The features of one text, token by token."""
    import re

    toks = (text or "").split()
    if not toks:
        return [0.0] * len(toxicity.FEATURES)
    plain = [toxicity.plain(t) for t in toks]
    weight = [max([lexicon.get(u, 0.0) for u in toxicity.units(w)] + [0.0]) if w else 0.0 for w, _ in plain]
    insult = [w in toxicity.INSULTS for w, _ in plain]
    hit = [bool(a or b) for a, b in zip(weight, insult)]
    you = [w in toxicity.SECOND_PERSON for w, _ in plain]
    near = sum(h and not u and any(you[j] for j in range(max(0, i - 5), min(len(toks), i + 6))) for i, (h, u) in enumerate(zip(hit, you)))
    n, size = len(toks), len(text)
    signs = sum(c in "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~" for c in text)
    return [
        sum(hit) / n, max(weight), sum(weight) / n, len({t for t, h in zip(toks, hit) if h}), sum(insult) / n, near / max(1, sum(hit)), sum(you) / n,
        len(re.findall("[A-ZÀ-ÖØ-Þ]", text)) / size, sum(len(t) > 1 and t.isupper() and t.isalpha() for t in toks) / n, signs / size, text.count("!") / n,
        sum(h for _, h in plain) / n, sum(a and h for a, (_, h) in zip(hit, plain)) / n, np.log1p(n), sum(len(re.findall(r"([^\W\d_])\1{3,}", t)) for t in toks) / sum(map(len, toks)),
    ]


def test_features_equal_brute_force():
    rng = np.random.default_rng(5)
    some = ["you", "YOU", "idiot", "1d10t!", "scum,", "SCUM", "stupidly", "stupid", "calm", "noooooo", "Été", "s.c.u.m", "don't", "x", "--", "42", "wörd;", "ST@R"]
    lexicon = {"scum": 2.0, "stup*": 1.5, "calm": 0.9, "you": 0.1}
    texts = [" ".join(rng.choice(some, rng.integers(1, 60))) for _ in range(200)] + [None, "", " \n", "\x1c you scum", "you scum " * 9000]
    got = toxicity.Extractor(lexicon).many(texts)
    assert np.allclose(got, [brute_features(lexicon, t) for t in texts])


def test_score_replaces_a_column_of_its_name(spark):
    docs, labels = small(spark)
    for model in (toxicity.fit_toxicity(docs, labels), quality.fit_quality(docs, labels), toxicity.fit_toxicity(docs, labels.limit(0))):
        got = model.score(docs)
        assert sorted(got.columns) == sorted(docs.columns) and got.count() == docs.count() and got.where("score = 1.0 AND doc_id = 0").count() == 0


def plain_statistics(text):
    """The statistics by walking over characters and words one by one."""
    text = text or ""
    words, word = [], ""
    for c in text + " ":
        if c.isspace():
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    if not words:
        return [0.0] * 18
    n, chars = len(words), len(text)
    times = {w: words.count(w) for w in words}
    mean = sum(len(w) for w in words) / n
    deviation = (sum((len(w) - mean) ** 2 for w in words) / n) ** 0.5
    share = lambda test: sum(map(test, text)) / chars
    letter = lambda c: c.isalnum() and not c.isdecimal()
    lines = [x for x in text.split("\n") if x.strip()]
    odd = sum(w[-1] in "%&$#*|@~^=<>" for w in words)
    stops = sum(text[i] == "." and text[i + 1] in " \n" for i in range(chars - 1))
    entropy = -sum(k / n * math.log(k / n) for k in times.values())
    return [
        math.log(1 + n), math.log(1 + mean), math.log(1 + deviation), len(times) / n, max(times.values()) / n, sum(words[i] == words[i - 1] for i in range(1, n)) / n,
        share(letter), share(str.isdecimal), share(lambda c: not (c.isalnum() or c == "_" or c.isspace())), share(lambda c: "A" <= c <= "Z" or "À" <= c <= "Þ" and c != "×"),
        odd / n, sum(c == "!" for c in text) / n, sum(c == "|" for c in text) / n, math.log(1 + len(lines)), math.log(1 + n / max(1, len(lines))),
        1 - len(set(lines)) / max(1, len(lines)), entropy / math.log(n + 1), stops / n,
    ]


def test_statistics_against_plain_ones(spark, sf_dir):
    texts = [r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").select("text").limit(60).collect()]
    texts = [t[:4000] if t else t for t in texts] + [None, "", " \n\t", "A", "One. Two.\nTwo.\nÄrger & Öl_9 99% <b> x|y!! a_b ×", "same same same", "é" * 50 + "\n\n\n"]
    for t in texts:
        assert quality.statistics(t) == pytest.approx(plain_statistics(t), abs=1e-12), t


def test_the_reach_of_statistics_is_a_parameter():
    model = [quality.QualityModel(np.zeros(2), np.ones(2), np.eye(2), np.zeros(2), np.ones(3), None, reach=r) for r in (6.0, np.inf)]
    x = np.array([[7.0, 0.5]])
    assert np.allclose(model[0].features(x), model[0].features(np.array([[6.0, 0.5]]))) and np.allclose(model[1].features(x)[0, :2], np.cos(x[0]))
