from watchlake.llm import decontaminate as D


def words(text):
    text = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        text = text.replace(c, " ")
    return [w for w in text.split(" ") if w]


def grams(ws, k):
    return {" ".join(ws[i : i + k]) for i in range(len(ws) - k + 1)}


def brute(docs, items):
    out = {}
    for d, text in docs:
        for i, item in items:
            iw = words(item)
            if iw:
                k = min(5, len(iw))
                s = grams(iw, k)
                hit = len(s & grams(words(text), k))
                if hit >= 0.8 * len(s) - 1e-9:
                    out[d, i] = max(out.get((d, i), (0, 0)), (hit / len(s), hit))
    return {k: v[1] for k, v in out.items()}


def rows_of(df):
    return {(r["doc_id"], r["item_id"]): r["matched"] for r in df.collect()}


ITEM = "one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty alpha beta gamma delta"


def test_cases(spark):
    changed = ITEM.replace("ten ", "TEN\t").replace("beta", "bravo")
    docs = [(1, "x " * 30000 + ITEM + " y" * 30000), (2, ITEM.upper()), (3, changed), (4, ITEM.replace("ten", "10")), (5, ITEM.replace("ten", "10").replace("five", "5")),
            (6, None), (7, ""), (8, "short one"), (9, ITEM), (9, ITEM), (None, ITEM), (10, ITEM + " " + ITEM), (11, "eight nine short one here")]
    items = [(100, ITEM), (101, "short one"), (102, None), (103, " "), (100, ITEM), (104, ITEM + " " + ITEM), (None, "eight nine short")]
    d = spark.createDataFrame([(*r, 1, "s", 2) for r in docs], "doc_id long, text string, m int, shingle string, item_id int")
    i = spark.createDataFrame([(*r, "clash") for r in items], "item_id long, text string, doc_id string")
    want = brute(docs, items)
    assert rows_of(D.contained_items(d, i)) == want
    assert rows_of(D.contained_items(d, i, broadcast_rows=0)) == want
    bad = {k[0] for k in want}
    kept = D.decontaminate(d, i)
    assert kept.columns == d.columns
    assert sorted(str(r["doc_id"]) for r in kept.collect()) == sorted(str(x) for x, _ in docs if x not in bad)


def test_empty_tables(spark):
    d = spark.createDataFrame([(1, ITEM)], "doc_id long, text string")
    i = spark.createDataFrame([(1, ITEM)], "item_id long, text string")
    assert D.contained_items(d.limit(0), i).count() == 0 == D.contained_items(d, i.limit(0)).count()
    assert D.decontaminate(d, i.limit(0)).count() == 1


def test_query(spark, sf_dir):
    get = lambda t, c: [(r[c], r["text"]) for r in spark.read.parquet(f"{sf_dir}/{t}.parquet").collect()]
    want = brute(get("documents", "doc_id"), get("benchmark", "item_id"))
    assert rows_of(D.op3_decontaminate(spark, sf_dir)) == want and want


def test_other_texts_of_the_id_stay(spark):
    docs = [(None, ITEM), (None, "clean one"), (None, None), (1, ITEM), (1, "clean two"), (2, "clean three")]
    d = spark.createDataFrame([(*r, 0) for r in docs], "doc_id long, text string, text_key int")
    kept = D.decontaminate(d, spark.createDataFrame([(1, ITEM)], "item_id long, text string"))
    assert kept.columns == d.columns and sorted(((r[0], r[1]) for r in kept.collect()), key=str) == sorted((r for r in docs if r[1] != ITEM), key=str)
