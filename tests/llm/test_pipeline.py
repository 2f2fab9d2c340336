import corpus_pipeline
from pyspark.sql import functions as F
from watchlake.llm.common import materialize, table


SF = "/root/testdata/sf0.01"  # enough labels to learn from


def test_stages(spark):
    sf_dir = SF
    docs = table(spark, sf_dir, "documents")
    columns, item = docs.columns, spark.read.parquet(f"{sf_dir}/benchmark.parquet").first()["text"]
    clean = "A plain report about gardens, rivers and old roads that nobody would object to. " * 6
    planted = [(900001, clean + " first", "en", "src1", 1), (900002, clean + " first", "en", "src1", 1), (900003, clean[:200] + item + clean, "en", "src2", 1),
               (900004, "you idiot scum moron pathetic loser " * 8, "en", "src3", 1), (900005, None, "en", "src1", 0), (900006, "", None, None, 0)]
    docs = docs.unionByName(spark.createDataFrame(planted, docs.schema))
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = materialize(stage(spark, docs, sf_dir), name)
        seen[name] = {r["doc_id"] for r in docs.select("doc_id").collect()}
        assert docs.columns[: len(columns)] == columns
        assert name == "mixing" or docs.columns == columns
    assert 900004 not in seen["toxicity"] and {900001, 900003} <= seen["toxicity"]
    assert len({900001, 900002} & seen["near_duplicates"]) <= 1
    assert 900003 not in seen["decontamination"]
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert all(seen[b] <= seen[a] for a, b in zip(names, names[1:]))
    assert docs.where("copies < 1 OR taken <> size * copies").count() == 0


def test_run_is_the_stages(spark, sf_dir):
    got = corpus_pipeline.run(spark, sf_dir)
    assert got.count() > 0 and {"copies", "taken", "target"} <= set(got.columns) and corpus_pipeline.ORACLE_SQL is None


def test_clashing_columns_nulls_and_no_rows(spark, sf_dir):
    """Columns that are called like what the stages make, long texts, rows of nulls, and a table without rows."""
    clash = "score double, size string, copies int, taken int, fp long, text_key string, label double, body string, h long, features string, item_id long, ws string, mix_key long, bucket int, toxicity_score int"
    docs = table(spark, sf_dir, "documents").limit(120).withColumns({c.split()[0]: F.lit(None).cast(c.split()[1]) for c in clash.split(", ")})
    docs = docs.unionByName(docs.limit(3)).unionByName(docs.limit(1).withColumns({c: F.lit(None).cast(t) for c, t in docs.dtypes}))
    docs = docs.unionByName(docs.limit(1).withColumn("text", F.expr("repeat('long words of a very long text ', 40000)")))
    for name, stage in corpus_pipeline.STAGES:
        for rows in (docs, docs.limit(0)):
            out = stage(spark, rows, sf_dir)
            assert out.columns[: len(docs.columns)] == docs.columns, name
            assert out.count() <= (2 * docs.count() if rows is docs else 0), name


def test_large_texts_reach_python_in_small_batches(spark):
    """Before, a batch had up to 64 MB in each task, outside the executor's heap, whatever memory the executor has."""
    from watchlake.llm.common import arrow_batches

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before = spark.conf.get(key)
    docs = spark.range(0, 400, 1, 1).select(F.expr("repeat('x', 50000)").alias("text"))
    sizes = lambda: [r["n"] for r in docs.mapInArrow(lambda bs: (b.from_pydict({"n": [b.nbytes]}) for b in bs), "n long").collect()]
    with arrow_batches(spark, 1 << 20):
        assert sum(small := sizes()) >= 400 * 50_000 and max(small) < 2 << 20
    assert max(sizes()) > 2 << 20 and spark.conf.get(key) == before


def test_near_duplicates_uses_small_batches_and_leaves_the_session_as_it_was(spark, monkeypatch):
    from watchlake.llm import jaccard, simhash

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key), []
    real = jaccard.materialize
    monkeypatch.setattr(jaccard, "materialize", lambda df, tag: (seen.append(spark.conf.get(key)), real(df, tag))[1])
    jaccard.similar_rows(table(spark, "/root/testdata/sf0.001", "documents").limit(50), simhash.links)
    assert seen and {int(x) for x in seen} == {4 << 20} and spark.conf.get(key) == before


def test_reading_in_small_parts_leaves_the_session_as_it_was(spark):
    """Before, 4096 texts were read at a time, in arrays of the executor's heap."""
    from watchlake.llm.common import arrow_batches

    key = "spark.sql.parquet.columnarReaderBatchSize"
    before = spark.conf.get(key)
    with arrow_batches(spark):
        assert int(spark.conf.get(key)) == 1024
        with arrow_batches(spark, rows=4096):
            assert int(spark.conf.get(key)) == 1024
    assert spark.conf.get(key) == before


def test_idle_workers_give_their_memory_back():
    """Before, a worker kept what its largest task had freed. In a process of its own, as a task has one."""
    import subprocess
    import sys

    code = """
import re, sys
from watchlake.llm.common import lean

def held():
    return int(re.search(r"RssAnon:\\s+(\\d+)", open("/proc/self/status").read())[1]) / 1024

def run(batches):
    many = [bytes(60_000) for _ in range(2000)]
    kept.append(many[-1])  # it lies above the others, which the allocator then keeps
    yield len(many)

for f in (run, lean(run)):
    kept, before = [], held()
    list(f([]))
    print(held() - before)
"""
    plain, given = map(float, subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout.split())
    assert plain > 80 and given < 0  # what the first left is given back, too


def test_classifier_stages_send_small_batches(spark, monkeypatch):
    """Before, their scores were computed outside, with batches as large as the session allows."""
    from watchlake.llm import quality, toxicity

    key = "spark.sql.execution.arrow.maxBytesPerBatch"
    before, seen = spark.conf.get(key), {}
    for module, stage in ((toxicity, corpus_pipeline.toxicity), (quality, corpus_pipeline.quality)):
        real = module.materialize
        monkeypatch.setattr(module, "materialize", lambda df, tag, real=real: (seen.update({tag: spark.conf.get(key)}), real(df, tag))[1])
        stage(spark, table(spark, SF, "documents"), SF)
    assert {"not-toxic", "good"} <= set(seen) and {int(x) for x in seen.values()} == {4 << 20} and spark.conf.get(key) == before
