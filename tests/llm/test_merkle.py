import hashlib
from binascii import crc32

import pytest
from pyspark.sql import functions as F
from watchlake.llm import merkle as M

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return H(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def tree(nodes, fan=2):
    """(root, steps of each node) by plain levels."""
    paths, now, level = [[] for _ in nodes], list(nodes), 0
    while len(now) > 1:
        for i in range(len(nodes)):
            at = i // fan**level
            run = at // fan * fan
            paths[i].append(("".join(now[run:at]), "".join(now[at + 1 : run + fan])))
        now = [H(*now[k : k + fan]) for k in range(0, len(now), fan)]
        level += 1
    return (now[0] if now else None), paths


def expected(rows, fan=2):
    groups = {}
    for r in rows:
        groups.setdefault(r[2], []).append(r)
    key = lambda r: (r[0] is not None, r[0] or 0, leaf(*r))
    order = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    subs = {g: tree([leaf(*r) for r in sorted(groups[g], key=key)], fan) for g in order}
    root, ups = tree([subs[g][0] for g in order], fan)
    out = []
    for g, up in zip(order, ups):
        for r, path in zip(sorted(groups[g], key=key), subs[g][1]):
            path = path + up
            h = leaf(*r)
            if r[0] is not None and crc32(str(r[0]).encode()) % 7 == 0 and r[3] is not None:
                h = leaf(*r[:3], r[3] + 1, r[4])
            for left, right in path:
                h = H(left, h, right)
            out.append((r[0], leaf(*r), subs[g][0], root, H(*(x + y for x, y in path)), h, h == root))
    return sorted(out, key=str)


def rows(n):
    langs = ["en"] * 5 + ["de", "ü", None]
    made = [(k * 3 % 997, "s" if k % 4 else None, langs[k % 8], k if k % 5 else None, f"text é {k}" if k % 6 else None) for k in range(n)]
    return made + [(5, "s", "en", 1, "same")] * 2 + [(5, "s", "en", 2, "other"), (None, None, "en", None, ""), (1, "a", "lone", 3, "x")]


def query(df, **more):
    plain = M.leaf_hash(*(F.col(c) for c in M.FIELDS))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    seen = F.when(hit, M.leaf_hash(*((F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in M.FIELDS)))
    found = M.manifest(df.withColumn("seen", seen), plain, "lang", F.col("doc_id"), keep=("doc_id", "seen"), **more)
    found = M.verified(found, F.coalesce("seen", "leaf"))
    return sorted(map(tuple, found.select("doc_id", "leaf", "subroot", "root", M.proof_hash(F.col("path")), "folded_root", "verified").collect()), key=str)


@pytest.mark.parametrize("n, fan, levels", [(9, 2, 1), (150, 2, 3), (60, 3, 2)])
def test_manifest_against_plain_levels(spark, n, fan, levels):
    df = spark.createDataFrame(rows(n), SCHEMA).repartition(3)
    assert query(df, fan=fan, levels=levels) == expected(rows(n), fan)


def test_one_group_one_row_and_none(spark):
    one = [(7, "s", "en", 1, "x")]
    assert query(spark.createDataFrame(one, SCHEMA), levels=2) == expected(one)
    many = [(k, "s", "en", k, "x") for k in range(33)]
    assert query(spark.createDataFrame(many, SCHEMA), levels=2) == expected(many)
    assert query(spark.createDataFrame([], SCHEMA), levels=2) == []


def test_rows_in_any_partitions_give_one_manifest(spark):
    df = spark.createDataFrame(rows(200), SCHEMA)
    assert query(df.repartition(7), levels=4) == query(df.orderBy("text"), levels=4)


def test_names_that_clash(spark):
    df = spark.createDataFrame([("a", "b", "r", "x")], "folded_root string, leaf string, root string, verified string").withColumn("path", F.array().cast(f"array<{M.STEP}>"))
    got = M.verified(df, F.col("leaf"))
    assert got.columns[-2:] == ["_folded_root", "_verified"] and got.first()["folded_root"] == "a"
