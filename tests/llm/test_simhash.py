import numpy as np
import pyarrow as pa
import pytest
import xxhash
from watchlake.llm import jaccard, simhash

WHITE = " \t\n\x0b\x0c\r"


def brute_fingerprint(text):
    words, word = [], ""
    for c in text or "":
        c = c.lower() if "A" <= c <= "Z" else c
        if c in WHITE:
            words, word = words + [word] * bool(word), ""
        else:
            word += c
    words += [word] * bool(word)
    if not words:
        return 0
    shingles = [" ".join(words[i : i + 4]) for i in range(max(1, len(words) - 3))]
    hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute_components(rows, radius=4):
    """rows: (doc_id, fingerprint)."""
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if (rows[i][1] ^ rows[j][1]).bit_count() <= radius:
                root[find(i)] = find(j)
    out = []
    for i in range(len(rows)):
        ids = [d for k, (d, _) in enumerate(rows) if find(k) == find(i) and d is not None]
        out.append((rows[i][0], min(ids, default=None)))
    return out


@pytest.mark.parametrize("text", [None, "", " \n", "One", "a b C", "A b c d", "É À a b c\td\x0be f\x1cg " * 30, "x y " * 40000])
def test_fingerprint_follows_the_rule(text):
    assert simhash.fingerprint(None if text is None else text.encode()) == brute_fingerprint(text)


def test_spark_hashes_agree(spark):
    assert spark.sql("select xxhash64('a b c d') h").first()["h"] & (2**64 - 1) == xxhash.xxh64(b"a b c d", seed=42).intdigest()


def clustered(n, seed):
    rng = np.random.default_rng(seed)
    base = rng.integers(0, 2**63, n // 6, dtype=np.uint64) * np.uint64(2)
    fps = set()
    for b in base:
        for _ in range(6):
            x = int(b)
            for bit in rng.choice(64, rng.integers(0, 8), replace=False):
                x ^= 1 << int(bit)
            fps.add(x)
    dense = int(base[0])
    fps |= {dense ^ (1 << i) ^ (1 << j) for i in range(24) for j in range(24)}
    return np.array(sorted(fps), np.uint64)


@pytest.mark.parametrize(("shard_rows", "most_rows", "top"), [(64, 100_000, 10), (100_000, 100_000, 10), (64, 150, 10), (100_000, 700, 10), (64, 400, 2), (64, 90, 1)])
def test_links_equal_brute_force(spark, shard_rows, most_rows, top):
    """Also where dense shards grow trees of their own, and where those that none cuts are dealt into blocks."""
    fps = clustered(3000, 5)
    df = spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long")
    found = simhash.components(simhash.links(df, shard_rows=shard_rows, most_rows=most_rows, top_depth=top)).collect()
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 4
    label = np.arange(len(fps))
    while True:
        nxt = np.array([label[row].min() for row in near])
        if (nxt == label).all():
            break
        label = nxt
    want = {}
    for x, k in zip(fps.view(np.int64), label):
        want.setdefault(int(k), set()).add(int(x))
    got = {}
    for r in found:
        got.setdefault(r["root"], set()).add(r["node"])
    assert sorted(map(sorted, got.values())) == sorted(sorted(g) for g in want.values() if len(g) > 1)


def test_query_shapes(spark):
    w = "lorem ipsum dolor sit amet consectetur adipiscing elit sed do eiusmod tempor " * 20
    rows = [(1, w), (2, w), (None, w), (3, w + "x"), (4, None), (5, ""), (6, "alone in here"), (6, "alone in here"), (None, "z"), (7, "aa " * 9000)]
    df = spark.createDataFrame([(d, t, "en", 9, "no") for d, t in rows], "doc_id long, text string, FP string, component_id int, Body string")
    got = sorted(((r["doc_id"], r["component_id"]) for r in simhash.near_duplicates(df).collect()), key=str)
    assert got == sorted(brute_components([(d, brute_fingerprint(t)) for d, t in rows]), key=str)
    kept = simhash.drop_near_duplicates(df)
    assert kept.columns == df.columns
    ids = [r["doc_id"] for r in kept.collect()]
    assert sorted(x for x in ids if x is not None) == sorted({c for d, c in got if d == c and d is not None}) and ids.count(None) == 2
    assert simhash.near_duplicates(df.limit(0)).count() == 0 == simhash.drop_near_duplicates(df.limit(0)).count()


def test_documents(spark, sf_dir):
    from watchlake.llm import entry

    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text").collect()
    want = brute_components([(r["doc_id"], brute_fingerprint(r["text"])) for r in docs])
    got = entry.op1_simhash(spark, sf_dir).collect()
    assert sorted((r["doc_id"], r["component_id"]) for r in got) == sorted(want)
    assert {r["doc_id"]: r["fingerprint"] for r in got} == {r["doc_id"]: f"{brute_fingerprint(r['text']):016x}" for r in docs}


def brute_sets(text):
    ws = "".join(" " if c in WHITE else c.lower() if "A" <= c <= "Z" else c for c in text or "").split(" ")
    ws = [w for w in ws if w]
    return {tuple(ws[i : i + 5]) for i in range(max(1, len(ws) - 4))} if ws else set()


def brute_stage(rows):
    """Distinct (doc_id, text) rows that stay at Jaccard 0.8: the least id of each component."""
    rows = sorted(set(rows), key=lambda r: r[0])
    sets, root = [brute_sets(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            shared = len(sets[i] & sets[j])
            if 5 * shared >= 4 * (len(sets[i]) + len(sets[j]) - shared):
                root[max(find(i), find(j))] = min(find(i), find(j))
    return {rows[i] for i in range(len(rows)) if find(i) == i}


def test_stage_equals_brute_force_at_four_fifths(spark):
    rng = np.random.default_rng(8)
    word = lambda: f"w{rng.integers(0, 3000)}"
    line = " the same line that closes many pages of the same site"
    rows = []
    for g in range(25):
        base = [word() for _ in range(rng.integers(3, 150))]
        for _ in range(8):
            text = list(base)
            for at in rng.integers(0, len(base), rng.integers(0, 1 + len(base) // 25)):
                text[at] = word()
            rows.append((len(rows), " ".join(text) + line * int(g % 2)))
    rows += [(len(rows), None), (len(rows) + 1, " ")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    assert got == {d for d, _ in brute_stage(rows)}
    near = {c for d, c in brute_components([(d, brute_fingerprint(t)) for d, t in rows])}
    assert got != near  # op1's four bits are another rule


def test_stage_decides_by_row(spark):
    """Of a repeated id only the text that is a copy goes, and every group keeps one row."""
    a, b, c = (" ".join(f"{x}{i}" for i in range(40)) for x in "abc")
    rows = [(1, a), (2, a), (2, b), (3, b), (4, c), (4, c), (None, c + " z"), (None, c + " z"), (None, "other words")]
    got = [tuple(r) for r in simhash.drop_near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(1, a), (2, b), (4, c), (None, c + " z"), (None, "other words")], key=str)


def test_sketches_never_lose_similar_sets():
    rng = np.random.default_rng(9)
    for n in (0, 1, 5, 400, 990, 1005, 3000, 40_000):
        a = np.unique(rng.integers(0, 1 << 64, n, np.uint64))
        for gone in {0, n // 20, n // 11, n // 9, n // 3}:
            b = np.unique(np.concatenate([a[gone:], rng.integers(0, 1 << 64, gone, np.uint64)]))
            may = jaccard.may_be_similar(len(a), jaccard.sketch(a), len(b), jaccard.sketch(b))
            assert may or not jaccard.similar(a, b)
            assert not may or gone <= n // 9 or n < 400  # and few others pass
    s = np.unique(rng.integers(0, 1 << 64, 70_001, np.uint64))
    for counts in ([3, 0, 2], [0], [70_001], [1]):
        k, fp = sum(counts), np.arange(len(counts)) - 5
        at = np.arange(k) + (70_000 if k < 3 else 0)
        got = jaccard._unpack(jaccard._pack(fp, fp + 50, np.array(counts), s[:k], at))
        want = (s[:k], np.repeat(fp, counts), np.repeat(fp + 50, counts), at)
        assert all(np.array_equal(x, y) for x, y in zip(got, want))


@pytest.mark.parametrize(("many", "crowd", "block", "large"), [(2, 64, 4000, 1000), (16, 1, 5, 1000), (16, 3, 9, 60)])
def test_stage_with_passages_that_many_texts_share(spark, monkeypatch, many, crowd, block, large):
    """Shared passages make no duplicates, near copies among such texts are found, and hot shingles change no result."""
    for name, value in (("MANY", many), ("CROWD", crowd), ("BLOCK", block), ("LARGE", large)):
        monkeypatch.setattr(jaccard, name, value)
    monkeypatch.setattr(jaccard, "common_shingles", lambda docs: np.empty(0, np.uint64))
    rng = np.random.default_rng(12)
    word = lambda: f"v{rng.integers(0, 5000)}"
    passages = [" ".join(word() for _ in range(60)) for _ in range(3)]
    rows = []
    for g in range(60):
        base = [word() for _ in range(rng.integers(20, 120))]
        for copy in range(1 + g % 3):
            text = list(base)
            for at in rng.integers(0, len(base), rng.integers(0, 1 + len(base) // 20)):
                text[at] = word()
            rows.append((len(rows), " ".join(text[:10]) + f" {passages[g % 3]} " + " ".join(text[10:])))
    rows += [(len(rows) + k, passages[0] + f" end {k}") for k in range(20)]
    wide = [word() for _ in range(40)]  # a group of copies near the threshold: some are similar to a few others only
    rows += [(len(rows) + k, " ".join(w if rng.random() > 0.03 else word() for w in wide)) for k in range(40)]
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()} == {d for d, _ in brute_stage(rows)}


def test_stage_gets_close_copies_from_the_trees(spark, monkeypatch):
    """Without the filter that follows, groups are what the trees link; whatever they link, texts are compared exactly."""
    rng = np.random.default_rng(21)
    rows = []
    for _ in range(12):
        words = [f"t{x}" for x in rng.integers(0, 50_000, 3000)]
        for k in range(2):
            rows.append((len(rows), " ".join([*words[:1500], f"changed{k}", *words[1501:]])))
    rows += [(len(rows), None), (len(rows) + 1, "")]
    want = {d for d, _ in brute_stage(rows)}
    df = spark.createDataFrame(rows, "doc_id long, text string")
    stage = lambda: {r["doc_id"] for r in simhash.drop_near_duplicates(df).collect()}
    real, seen = simhash.links, []
    monkeypatch.setattr(simhash, "links", lambda fps: (seen.append(fps.count()), real(fps))[1])
    assert len(want) == 13 and stage() == want and seen[0] >= 12
    with monkeypatch.context() as m:
        m.setattr(jaccard, "_without_hot", lambda docs, *a: spark.createDataFrame([], "s long, fp long, n int, at int"))
        assert stage() == want
    pairs = lambda fps: fps.select(fps["fp"].alias("u")).crossJoin(fps.select(fps["fp"].alias("v")))
    for linked in (pairs, lambda fps: pairs(fps).limit(0)):
        monkeypatch.setattr(simhash, "links", linked)
        assert stage() == want


def test_postings_of_a_bucket_are_sorted_in_parts(monkeypatch):
    """Before, a task expanded and sorted a bucket's postings at once, which took over 100 bytes a posting."""
    import tracemalloc

    rng = np.random.default_rng(4)
    own, both = rng.integers(0, 1 << 63, 200_000, np.int64).view(np.uint64), rng.integers(0, 1 << 63, 400, np.int64).view(np.uint64)
    both = np.concatenate([both, np.full(1, 7, np.uint64)])
    blobs, want, left = [], [], {}
    for at in range(0, 200):
        mine = np.concatenate([own[at * 1000 : at * 1000 + 1000], both[at // 2 * 4 : at // 2 * 4 + 4], both[-1:], both[-1:]])  # the last one is held by all, and twice
        place = np.arange(len(mine))
        blobs.append(jaccard._pack(np.array([at]), np.array([9 * len(mine)]), np.array([len(mine)]), mine, place))
        left[at] = len(mine)
        want += [(int(s.view(np.int64)), at, 9 * len(mine), 1000 + k) for k, s in enumerate(mine[1000:1005])]
    whole = jaccard._several([pa.py_buffer(b) for b in blobs]).to_pylist()
    assert sorted(tuple(r.values()) for r in whole) == sorted(want)
    monkeypatch.setattr(jaccard, "SLICE", 1000)
    assert sorted(tuple(r.values()) for r in jaccard._several(blobs).to_pylist()) == sorted(want)
    monkeypatch.setattr(jaccard, "SLICE", 1 << 14)
    tracemalloc.start()
    jaccard._several(blobs)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 30 * 200_000  # all at once take more than twice that
