"""Mixing sources to target weights by pivotal dependent rounding.

A source's copy rate is its target over its size. Every document takes the whole part of the rate as copies,
and the fraction is the probability of one copy more. Pivotal rounding settles the fractions: two open
documents meet, and words are moved from one to the other, in a random direction whose odds keep both
expectations, until one of them is 0 or 1. The words expected in total stay as they are, so a source's taken
words miss its target by less than one document. Each bucket of documents is settled on its own and leaves
one open document at most; those meet again in the buckets of the next level, and so on to one a source.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from watchlake.llm.common import free_name, materialize, table

WEIGHTS = (5.0, 2.0, 1.0)
SHARE, MOST = 1.5, 2.0


def n_words(text: Column) -> Column:
    """Number of runs of characters other than the six ASCII white-space ones; 0 for null."""
    blank = F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\x20\x09-\x0D]+", "x")
    return F.length(F.regexp_replace(blank, r"[\x20\x09-\x0D]+", "")).cast("long")


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) for (source, source_size); sources are distinct and may include null.

    The weights go round over the sources in code point order, null last. The sources are sorted by range over
    many tasks and numbered from the tasks' counts, so no task sees them all. Sources whose target would pass
    ``most`` times their size stop there, and what is left is dealt again among the others until none passes.
    """
    order = [F.col("source").isNull(), F.col("source")]
    sorted_ = sizes.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("at", F.monotonically_increasing_id())
    # the id's upper bits are the task, its lower 33 bits the row within the task
    numbered = materialize(sorted_, "sources").withColumn("task", F.shiftright("at", 33))
    before, offsets = 0, []
    for r in numbered.groupBy("task").count().orderBy("task").collect():
        offsets.append((r["task"], before))
        before += r["count"]
    if not offsets:
        return sizes.select("source", "source_size", F.lit(0.0).alias("target"))
    start = sizes.sparkSession.createDataFrame(offsets, "task long, start long")
    rank = F.col("start") + F.col("at").bitwiseAND(F.lit((1 << 33) - 1))
    weight = F.element_at(F.array(*map(F.lit, weights)), (rank % len(weights) + 1).cast("int"))
    weighed = numbered.join(start, "task").select("source", "source_size", weight.alias("weight"))
    rest, rate, full = None, None, F.lit(False)
    while True:  # ends: each round stops another source, or none
        open_ = weighed.agg(
            F.sum("source_size").alias("all"),
            F.sum(F.when(full, F.col("source_size"))).alias("stopped"),
            F.sum(F.when(~full, F.col("weight"))).alias("weight"),
            F.sum(F.when(full, 1).otherwise(0)).alias("n"),
        ).first()
        if rest == open_["n"] or not open_["weight"]:
            break
        rest = open_["n"]
        rate = (share * (open_["all"] or 0) - most * (open_["stopped"] or 0)) / open_["weight"]
        full = F.col("weight") * F.lit(rate) > most * F.col("source_size")
    target = F.when(full, most * F.col("source_size")).otherwise(F.col("weight") * F.lit(rate))
    return weighed.select("source", "source_size", target.cast("double").alias("target"))


def _uniform(keys: np.ndarray, salt: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the keys only (a finaliser over 64-bit keys)."""
    with np.errstate(over="ignore"):
        x = keys.astype(np.uint64) + np.uint64(0x9E3779B97F4A7C15) * np.uint64(salt + 1)
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)) / float(1 << 53)


def pivot(size: np.ndarray, p: np.ndarray, u: np.ndarray) -> np.ndarray:
    """Settle the probabilities of one bucket in order; at most one stays between 0 and 1."""
    out, held = p.astype(float).copy(), -1
    for i in range(len(out)):
        if not 0 < out[i] < 1:
            continue
        if held < 0:
            held = i
            continue
        a, b = size[held] * out[held], size[i] * out[i]
        up = min(size[held] - a, b)  # words that held can gain from i
        down = min(a, size[i] - b)  # words that held can give
        gain = up if u[i] * (up + down) < down else -down
        # the side that reaches its bound is set to it, so that rounding errors leave nothing open
        if gain > 0:
            done_held, done_i = size[held] - a <= b, b <= size[held] - a
            out[held] = 1.0 if done_held else (a + gain) / size[held]
            out[i] = 0.0 if done_i else (b - gain) / size[i]
        else:
            done_held, done_i = a <= size[i] - b, size[i] - b <= a
            out[held] = 0.0 if done_held else (a + gain) / size[held]
            out[i] = 1.0 if done_i else (b - gain) / size[i]
        if not 0 < out[held] < 1:
            held = i if 0 < out[i] < 1 else -1
    return out


def _settler(salt: int):
    """Settles a bucket's open documents, long ones first, so that the one that stays open is short."""

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", "key"], ascending=[False, True], kind="stable")
        keys = pdf["key"].to_numpy(np.int64).view(np.uint64)
        pdf["p"] = pivot(pdf["size"].to_numpy(float), pdf["p"].to_numpy(float), _uniform(keys, salt))
        return pdf

    return settle


def _numbered(rows: DataFrame, chunk: int = 100_000) -> DataFrame:
    """Rows with ``nth``, their number among equal rows: counted first, so that many equal rows are one row a task."""
    counted = rows.groupBy(*rows.columns).agg(F.count("*").alias("rows"))
    chunks = counted.withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("rows") - 1) / chunk))))
    nth = F.sequence(F.col("chunk") * chunk, F.least("rows", (F.col("chunk") + 1) * chunk) - 1)
    return chunks.select(*rows.columns, F.explode(nth).alias("nth"))


def mix(
    docs: DataFrame, id_col: str = "doc_id", text: str = "text", source: str = "source", weights: tuple[float, ...] = WEIGHTS, share: float = SHARE,
    most: float = MOST, bucket_rows: int = 2000, fan_in: int = 64, seed: int = 11, content: Column | None = None,
) -> DataFrame:
    """(doc_id, size, source, content, source_size, target, copies, taken): one row per row of ``docs``.

    Empty and null texts have size 0 and take no words; texts are measured whole, however long. A null source is a
    source like any other. Null and repeated ids are allowed: each row is rounded on its own, by a lot that hangs on
    its id, its source and ``content`` (a long; the text's hash if not given) and, among rows that are equal in all of
    these, on its number. So reruns agree, wherever rows are stored. An empty table gives an empty result. Columns
    besides id, text and source aren't read. ``bucket_rows``: documents that are settled together; a hot source has
    as many more buckets, and no id and no text keeps its rows in one of them.
    """
    rows = docs.select(
        F.col(id_col).alias("doc_id"), F.col(source).alias("source"), n_words(F.col(text)).alias("size"),
        (F.xxhash64(F.col(text)) if content is None else content).alias("content"),
    )
    rows = materialize(_numbered(rows), "sizes")
    sizes = rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("n"))
    sizes = materialize(sizes, "source_sizes")
    targets = source_targets(sizes.select("source", "source_size"), weights, share, most).withColumnRenamed("source", "to_source")
    same = F.col("source").eqNullSafe(F.col("to_source"))
    plan = sizes.select("source", "n").join(targets, same).select("source", "n", "source_size", "target")
    levels = 1
    most_rows = sizes.agg(F.max("n")).first()[0] or 0
    while fan_in ** (levels - 1) * bucket_rows < most_rows:
        levels += 1
    plan = materialize(plan.withColumn("rate", F.when(F.col("source_size") > 0, F.try_divide("target", "source_size")).otherwise(0.0)), "plan")
    key = F.xxhash64(F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.col("doc_id").isNull(), "source", "content", "nth", F.lit(seed))
    plan_ = plan.withColumnRenamed("source", "s")
    all_ = rows.join(plan_, rows["source"].eqNullSafe(plan_["s"])).select(
        "doc_id", "source", "size", "content", "source_size", "target", key.alias("key"),
        F.floor("rate").cast("int").alias("whole"), (F.col("rate") - F.floor("rate")).alias("p"),
        F.pmod(F.xxhash64(key, F.lit(seed + 1)), F.greatest(F.lit(1), F.ceil(F.col("n") / bucket_rows)).cast("long")).alias("bucket"),
    )
    # empty texts are settled without a lot: they move no words
    all_ = all_.withColumn("p", F.when(F.col("size") > 0, F.col("p")).otherwise(0.0))
    schema, settled = all_.schema, None
    for level in range(levels):
        settle = _settler(level * 2 + seed)
        now = materialize(all_.groupBy("source", "bucket").applyInPandas(settle, schema), f"settled{level}")
        open_ = (F.col("p") > 0) & (F.col("p") < 1)
        done = now.where(~open_)
        settled = done if settled is None else settled.unionByName(done)
        all_ = now.where(open_).withColumn("bucket", F.floor(F.col("bucket") / fan_in) if level + 2 < levels else F.lit(0).cast("long"))

    def last(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:  # one open document a source is left
        for pdf in batches:
            pdf["p"] = (_uniform(pdf["key"].to_numpy(np.int64).view(np.uint64), 999 + seed) < pdf["p"]).astype(float)
            yield pdf

    result = settled.unionByName(all_.mapInPandas(last, schema))
    copies = (F.col("whole") + F.col("p").cast("int")).cast("int")
    return result.select("doc_id", "size", "source", "content", "source_size", "target", copies.alias("copies"), (copies * F.col("size")).alias("taken"))


def _content(docs: DataFrame) -> Column:
    """A hash of all columns of a row; maps, which have no hash, by their text."""
    cols = [F.to_json(F.struct(f.name)) if "map" in f.dataType.simpleString() else F.col(f"`{f.name}`") for f in docs.schema]
    return F.xxhash64(*cols, F.concat(*(F.col(f"`{c}`").isNull().cast("string") for c in docs.columns)))


def mixed_documents(docs: DataFrame, **options) -> DataFrame:
    """The documents that the mix takes, with (size, source_size, target, copies, taken) beside their own columns.

    ``docs`` has doc_id, text and source. Own columns that are called like new ones are kept and the new ones get an
    underscore. Null and empty texts take no words; rows without any word stay if their source takes whole copies. Each
    row of a repeated id is decided by itself, and rows that are equal in all columns are interchangeable. An empty
    table gives an empty result. Texts move once, to their decisions.
    """
    key, other = (free_name(docs.columns, c) for c in ("mix_key", "mix_other"))
    own = docs.withColumn(key, _content(docs))
    found = mix(docs, content=_content(docs), **options)
    names = {c: free_name(docs.columns, c) for c in ("size", "source_size", "target", "copies", "taken")}
    found = materialize(found.select(F.col("content").alias(key), *(F.col(c).alias(n) for c, n in names.items())), "mixed")
    twice = materialize(found.groupBy(key).count().where("count > 1").select(F.col(key).alias(other)), "twice")
    taken = found.where(F.col(names["copies"]) > 0)
    out = [*docs.columns, *names.values()]
    if not twice.limit(1).count():
        return own.join(taken, key).select(*out)
    # of equal rows one is kept, and it is joined to all their decisions
    repeats = F.col(key) == F.col(other)
    single = own.join(twice, repeats, "left_anti").join(taken.join(twice, repeats, "left_anti"), key)
    again = own.join(twice, repeats, "left_semi").dropDuplicates([key]).join(taken.join(twice, repeats, "left_semi"), key)
    return single.select(*out).unionByName(again.select(*out))


def op4_mixing(spark, sf_dir: str) -> DataFrame:
    """What the mix takes of every document; nulls, ties, repeats and empty tables as in ``mix``."""
    return mix(table(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")
