import random

import numpy as np
import pytest
from watchlake.llm import mixing as M

SCHEMA = "doc_id long, text string, source string, size string, copies int"


def waterfill(sizes):
    """sizes: source -> size. The rule by plain repetition."""
    order = sorted((s for s in sizes if s is not None), key=lambda s: s.encode()) + [None] * (None in sizes)
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}
    left, stopped = 1.5 * sum(sizes.values()), {}
    while True:
        open_ = [s for s in order if s not in stopped]
        if not open_:
            return stopped
        rate = left / sum(weight[s] for s in open_)
        over = [s for s in open_ if weight[s] * rate > 2 * sizes[s]]
        if not over:
            return stopped | {s: weight[s] * rate for s in open_}
        for s in over:
            stopped[s] = 2 * sizes[s]
            left -= stopped[s]


def corpus(n=3000, seed=2):
    rng = random.Random(seed)
    rows = []
    for k in range(n):
        source = rng.choice(["hot"] * 6 + ["b", "ü", "c", "d", None, "A"])
        rows.append((k, " ".join(["w"] * rng.choice([0, 1, 5, 30, 200])) + rng.choice(["", "\n", "\t "]), source, "x", 3))
    return rows + [(7, "same row twice", "b", "x", 3)] * 2 + [(None, "a b", "b", "x", 3), (n + 1, None, "z", "x", 3), (n + 2, "one", "one", "x", 3)]


def test_targets_sizes_and_sums(spark):
    rows = corpus()
    sizes = {}
    for _, text, source, *_ in rows:
        sizes[source] = sizes.get(source, 0) + len((text or "").split())
    want = waterfill(sizes)
    got = M.mix(spark.createDataFrame(rows, SCHEMA), bucket_rows=100, fan_in=4).toPandas()
    assert len(got) == len(rows)
    for source, part in got.groupby("source", dropna=False):
        source = None if source != source else source
        assert part["target"].iloc[0] == pytest.approx(want[source]) and part["source_size"].iloc[0] == sizes[source]
        assert abs(part["taken"].sum() - want[source]) <= part["size"].max()
        rate = want[source] / sizes[source] if sizes[source] else 0
        copies = part["copies"][part["size"] > 0]
        assert copies.isin([int(rate), int(rate) + 1]).all()
    assert (got["taken"] == got["size"] * got["copies"]).all() and (got["taken"] <= 2 * got["size"]).all()


def test_reruns_agree_on_other_partitions(spark):
    df = spark.createDataFrame(corpus(800), SCHEMA)
    key = lambda d: sorted(map(tuple, M.mix(d, bucket_rows=50, fan_in=4).fillna(-1).select("doc_id", "size", "taken").collect()))
    assert key(df.repartition(3)) == key(df.repartition(7, "size")) == key(df.orderBy("text"))


def test_rounding_keeps_sums_and_means():
    rng = np.random.default_rng(0)
    size = rng.integers(1, 50, 200).astype(float)
    p = np.full(200, 0.3)
    total = np.zeros(200)
    for _ in range(2000):
        x = M.pivot(size, p, rng.random(200))
        assert ((x > 0) & (x < 1)).sum() <= 1 and (size * x).sum() == pytest.approx((size * p).sum())
        total += x
    assert np.abs(total / 2000 - 0.3).max() < 0.06


def test_mixed_documents_and_empty(spark):
    df = spark.createDataFrame(corpus(300), SCHEMA)
    got = M.mixed_documents(df)
    assert got.columns[:5] == df.columns and {"_size", "_copies", "taken"} <= set(got.columns)
    direct = M.mix(df, content=M._content(df)).where("copies > 0")  # the same lots
    assert got.count() == direct.count() and got.agg({"taken": "sum"}).first()[0] == direct.agg({"taken": "sum"}).first()[0]
    assert M.mix(df.limit(0)).count() == 0 == M.mixed_documents(df.limit(0)).count()
    assert M.mix(df.where("text IS NULL")).first()["taken"] == 0


def test_null_ids_and_repeats_are_spread_and_decided_alike(spark):
    """No id keeps its rows in one bucket, and which text is kept hangs on the rows only."""
    rows = [(None, f"text {k} " + "w " * (k % 9), "hot" if k % 3 else "b", "x", 3) for k in range(600)] + [(5, "the same row", "b", "x", 3)] * 40
    df = spark.createDataFrame(rows, SCHEMA)
    numbered = M._numbered(df.select("doc_id", "text"), chunk=7)
    assert numbered.count() == len(rows) and numbered.where("doc_id = 5").agg({"nth": "max"}).first()[0] == 39
    assert numbered.where("doc_id = 5").select("nth").distinct().count() == 40
    kept = lambda d: sorted((r["text"], r["taken"]) for r in M.mixed_documents(d, bucket_rows=50, fan_in=4).collect())
    assert kept(df.repartition(3)) == kept(df.repartition(7, "text")) == kept(df.orderBy("text"))


def test_columns_that_have_no_hash(spark):
    df = spark.createDataFrame([(1, "a b", "s", {"k": 1}), (1, "a b", "s", {"k": 2}), (1, "a b", "s", {"k": 2})], "doc_id long, text string, source string, m map<string,int>")
    got = M.mixed_documents(df).collect()
    assert all(r["copies"] > 0 for r in got) and sum(r["taken"] for r in got) in (8, 10)
