import random
import re

from watchlake.llm import licenses as S


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", text)


def base(text):
    ws, places = words(text), []
    for phrase, label in S.PHRASES.items():
        p = phrase.split()
        places += [(i, label) for i in range(len(ws) - len(p) + 1) if ws[i : i + len(p)] == p]
    return len(ws), sorted(places)


SCAN = S.Scanner(S.licence_templates(), S.PHRASES)


def test_base_places_equal_brute_force():
    rng = random.Random(3)
    vocabulary = "cc by nc general public license all rights reserved gnu the mit x é under licensed 4 0".split()
    for _ in range(400):
        text = rng.choice([" ", "-", ", "]).join(rng.choices(vocabulary, k=rng.randint(0, 60)))
        got = SCAN.scan(text.encode())
        assert (got["n_words"], sorted(got["places"])) == base(text)


def test_automaton_gives_matching_statistics():
    rng = random.Random(5)
    lists = [[rng.choice("abc").encode() for _ in range(rng.randint(1, 14))] for _ in range(5)]
    sam = S.Automaton(lists)
    runs = {tuple(x[i:j]) for x in lists for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    assert all(sam.find(list(r)) is not None for r in runs)
    for _ in range(300):
        r = tuple(rng.choice("abcd").encode() for _ in range(rng.randint(1, 6)))
        at = sam.find(list(r))
        assert (at is not None) == (r in runs)
        if at:
            assert sam.ends[at] == places_of(r, lists)


def places_of(run, lists):
    found = {k: [j for j in range(len(run), len(x) + 1) if tuple(x[j - len(run) : j]) == tuple(run)] for k, x in enumerate(lists)}
    return {k: v for k, v in found.items() if v}


def brute_spans(lists, ws, least, gap):
    """(list, start, end, words covered) of the chains, from matches that are found by trying all runs."""
    runs = {tuple(x[i:j]) for x in lists for i in range(len(x)) for j in range(i + 1, len(x) + 1)}
    longest = [max((n for n in range(1, i + 1) if tuple(ws[i - n : i]) in runs), default=0) for i in range(len(ws) + 1)]
    open_, out = {}, []
    for end in range(1, len(ws) + 1):
        size = longest[end]
        if size < least or end < len(ws) and longest[end + 1] == size + 1:
            continue
        for k, ends in places_of(ws[end - size : end], lists).items():
            start, upto, place, covered = open_.get(k, (0, -(10**9), 0, 0))
            later = [e for e in ends if e > place] if end - size - upto <= gap else []
            if later:
                open_[k] = (start, end, later[0], covered + later[0] - max(place, later[0] - size))
            else:
                if k in open_:
                    out.append((k, start, upto, covered))
                open_[k] = (end - size, end, ends[0], size)
    return sorted(out + [(k, a, b, n) for k, (a, b, _, n) in open_.items()])


def test_spans_equal_brute_force():
    rng = random.Random(6)
    for _ in range(150):
        lists = [" ".join(rng.choices("abcde", k=rng.randint(3, 25))) for _ in range(3)]
        scan = S.Scanner([(f"l{k}", x) for k, x in enumerate(lists)], {}, least=2, gap=3)
        text = rng.choices("abcdefg", k=rng.randint(0, 50))
        for x in rng.sample(lists, 2):  # parts of the lists in it
            at = rng.randint(0, len(text))
            text[at:at] = x.split()[rng.randint(0, 3) :]
        want = brute_spans([x.split() for x in lists], text, 2, 3)
        got = scan.scan(" ".join(text).encode())["spans"]
        assert got == sorted((f"l{k}", a, b, min(1.0, n / len(lists[k].split()))) for k, a, b, n in want)


def test_whole_licences_are_found():
    texts = dict(S.licence_templates())
    rng = random.Random(1)
    for label in ("gpl-3.0", "apache-2.0", "mit-license", "lgpl-2.1", "bsd"):
        ws = (S.files("watchlake.llm") / "licences" / f"{label}.txt").read_text().split()
        for _ in range(len(ws) // 60):
            ws[rng.randrange(len(ws))] = "changed"
        got = SCAN.scan((" ".join(["before"] * 9 + ws + ["after"])).encode())
        span = max((s for s in got["spans"] if s[0] == label), key=lambda s: s[2] - s[1])
        assert span[3] >= 0.75 and span[1] <= 14 and span[2] >= got["n_words"] - 6, label
    assert len(texts) >= 12
    prose = "the terms of this story are that the author may go to any place and do the same thing as a condition of the end " * 20
    assert not [s for s in SCAN.scan(prose.encode())["spans"] if s[3] >= SCAN.cover]


def test_spans():
    mit = S.TEMPLATES["mit-license"][2]
    got = SCAN.scan(("intro " * 5 + mit.replace("copy", "copy (or more)").title() + " end").encode())
    span = next(s for s in got["spans"] if s[0] == "mit-license" and s[3] > 0.75)
    assert span[1] == 5 and span[2] == 5 + len(mit.split()) + 2
    assert not [s for s in SCAN.scan(b"free of charge to any person")["spans"] if s[3] >= SCAN.cover]


def test_columns(spark):
    rows = [(1, None), (2, ""), (3, "All rights reserved. CC-BY. ALL RIGHTS RESERVED"), (3, "All rights reserved."), (None, "cc by"), (4, "licensed under cc by nc 4.0 " * 5000)]
    df = spark.createDataFrame([(*r, 1, "clash") for r in rows], "doc_id long, text string, n_words int, labels string")
    got = S.scan_licenses(df, ["doc_id"]).collect()
    assert len(got) == len(rows)
    by = {(r["doc_id"], r["n_words"]): r for r in got}
    r = by[3, 8]
    assert (r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == (3, 0, 5, ["cc-by", "reserved"]) and r["score"] == 1
    assert by[1, 0]["labels"] == [] and by[1, 0]["first_word"] is None and by[2, 0]["score"] == 0
    assert "cc-by-nc-4.0" in by[4, 35000]["labels"] and by[4, 35000]["n_base"] == 5000
    assert S.scan_licenses(df.limit(0), ["doc_id"]).count() == 0
    table = spark.createDataFrame([("mine", "free to all who ask"), (None, "x"), ("none", None), ("blank", " . ")], "label string, text string")
    own = S.scan_licenses(spark.createDataFrame([(1, "It is FREE, to all who ask."), (2, "all rights reserved")], "doc_id long, text string"), ["doc_id"], templates=table)
    assert sorted((r["doc_id"], r["labels"]) for r in own.collect()) == [(1, ["mine"]), (2, ["reserved"])]
    try:
        S.scan_licenses(df, ["doc_id"], templates=table, most_words=1)
        raise AssertionError
    except ValueError:
        pass


def test_query(spark, sf_dir):
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    for r in S.op8_licenses(spark, sf_dir).collect():
        n, places = base(docs[r["doc_id"]])
        starts = [a for a, _ in places]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(places), min(starts, default=None), max(starts, default=None))
        assert r["base_labels"] == ",".join(sorted({b for _, b in places}))
        spans = SCAN.scan((docs[r["doc_id"]] or "").encode())["spans"]
        assert r["labels"] == ",".join(sorted({b for _, b in places} | {s[0] for s in spans if s[3] >= 0.75})) and r["score"] == max((s[3] for s in spans), default=0)
