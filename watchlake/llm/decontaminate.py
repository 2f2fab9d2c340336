"""Benchmark decontamination: MinHash containment search by size class, verified on exact shingles.

An item is contained in a document if the document has at least ``threshold`` of the item's distinct word
shingles. A MinHash sketch is a set's shingles of least hash. Of an item with m shingles the document may
miss at most floor((1 - threshold) * m); so of any L shingles of the item, L less that number at least are in every
document that contains it. Items are partitioned into size classes; each class keeps a few more than its largest
size's misses as sketch, those that few items share first. Documents are partitioned by the same classes: a document's
sketch holds its hashes up to the largest one in the sketches of all classes that are small enough to fit in it. A
document becomes a candidate of an item when their sketches share as many hashes as they must; nothing is lost, whatever
the ratio of their lengths, and a hash collision can only add a candidate. Candidates alone are shingled again as
strings and compared in full.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchlake.llm.common import LOWER, UPPER, ascii_lower, free_name, materialize, table

WIDTH, THRESHOLD = 5, 0.8


def words(text: Column) -> Column:
    """The lower-cased (A-Z) runs of characters other than ASCII white space; null if there are none."""
    body = F.btrim(ascii_lower(F.coalesce(text, F.lit(""))), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(body != "", F.split(body, r"[\x20\x09-\x0D]+"))


def shingles(ws: Column, width: int) -> Column:
    """Runs of ``width`` words joined by spaces, repeats included; empty for shorter texts."""
    n = F.size(ws) - (width - 1)
    some = F.transform(F.sequence(F.lit(1), n), lambda i: F.array_join(F.slice(ws, i, width), " "))
    return F.when(n >= 1, some).otherwise(F.array().cast("array<string>"))


def hashed(words_: list[Column]) -> Column:
    """The hash of a shingle from its words."""
    return F.xxhash64(*words_)


def item_shingles(items: DataFrame, width: int = WIDTH) -> DataFrame:
    """(item_key, item_id, width, m, shingle, h): the distinct shingles of every item, with their hashes.

    Items of fewer than ``width`` words are one shingle of all their words; items without words have none.
    """
    rows = items.select("item_id", F.xxhash64("item_id", "text").alias("item_key"), words(F.col("text")).alias("ws"))
    rows = rows.where("ws IS NOT NULL").dropDuplicates(["item_key"])
    own = F.array_distinct(F.when(F.size("ws") >= width, shingles(F.col("ws"), width)).otherwise(F.array(F.array_join("ws", " "))))
    rows = rows.select("item_key", "item_id", F.least(F.size("ws"), F.lit(width)).alias("width"), own.alias("own"))
    rows = rows.select("item_key", "item_id", "width", F.size("own").alias("m"), F.explode("own").alias("shingle"))
    parts = F.split("shingle", " ")
    h = F.coalesce(*(F.when(F.col("width") == k, hashed([F.element_at(parts, i + 1) for i in range(k)])) for k in range(1, width + 1)))
    return rows.withColumn("h", h)


def sketched(found: DataFrame, threshold: float = THRESHOLD, spare: int = 3, few: int = 4) -> DataFrame:
    """Adds ``need`` (shingles that a document must have), ``size_class``, ``in_sketch`` and ``hits`` (of the sketch) by the size class.

    ``spare``: how many more shingles than may be missed a sketch has; ``few``: shingles that more items share come last.
    """
    size_class = F.ceil(F.log2(F.col("m"))).cast("int")
    upper = F.pow(F.lit(2.0), size_class)  # the class's largest size
    length = F.least(F.col("m"), (F.floor((1 - threshold) * upper + 1e-9) + spare).cast("int"))
    missed = F.floor((1 - threshold) * F.col("m") + 1e-9).cast("int")
    often = F.count("*").over(Window.partitionBy("width", "h")) > few
    at = F.row_number().over(Window.partitionBy("item_key").orderBy("often", "h", "shingle"))
    need = F.ceil(threshold * F.col("m") - 1e-9)
    rows = found.withColumn("often", often).withColumns({"need": need, "size_class": size_class, "in_sketch": at <= length})
    return rows.withColumn("hits", F.greatest(F.lit(1), length - missed)).drop("often")


def _held(rows: DataFrame, widths: list[int], keep: list[str]) -> DataFrame:
    """The kept columns and every shingle of the given widths of every row's text."""
    w = rows.select(*keep, words(F.col("text")).alias("ws")).where("ws IS NOT NULL")
    each = F.concat(*(shingles(F.col("ws"), k) for k in widths)) if len(widths) > 1 else shingles(F.col("ws"), widths[0])
    return w.select(*keep, F.explode(each).alias("shingle"))


def document_hashes(docs: DataFrame, width: int, limits: list[tuple[int, int]]) -> DataFrame:
    """(doc_id, n, h): the MinHash sketch of every row, its shingle hashes up to the limit of its size class.

    ``limits``: (shingles from which on it counts, hash), both rising. A row of n shingles has the last limit that counts.
    The words of all places are laid side by side, so that no lambda runs for a place.
    """
    w = docs.select("doc_id", words(F.col("text")).alias("ws")).where(F.size("ws") >= width)
    n = F.size("ws") - (width - 1)
    limit = F.lit(None).cast("long")
    for least, top in limits:
        limit = F.when(n >= least, F.lit(top)).otherwise(limit)
    # the width's words of each place; the last places, where they run out, have nulls
    side = F.arrays_zip(*(F.slice("ws", i + 1, F.size("ws")).alias(f"w{i}") for i in range(width)))
    rows = w.select("doc_id", n.alias("n"), limit.alias("top"), F.inline(side).alias(*(f"w{i}" for i in range(width)))).where(f"w{width - 1} IS NOT NULL")
    return rows.withColumn("h", hashed([F.col(f"w{i}") for i in range(width)])).where("h <= top").select("doc_id", "n", "h")


def _candidates(docs: DataFrame, sketch: DataFrame, width: int, near) -> DataFrame:
    """(doc_id, item_key) whose sketches share enough, for items of one width. ``sketch`` is small: a row per kept shingle."""
    tops = sketch.groupBy("size_class").agg(F.min("need").alias("least"), F.max("h").alias("top")).orderBy("size_class").collect()
    limits, top = [], None  # a row for each size class, a power of two
    for r in tops:
        top = r["top"] if top is None else max(top, r["top"])
        limits.append((int(r["least"]), top))
    found = document_hashes(docs, width, limits).join(near(sketch.select("item_key", "h", "need", "hits")), "h").where("n >= need")
    counts = found.groupBy("doc_id", "item_key", "hits").agg(F.count_distinct("h").alias("shared"))
    return counts.where("shared >= hits").select("doc_id", "item_key")


def contained_pairs(
    docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, width: int = WIDTH, broadcast_rows: int = 500_000
) -> DataFrame:
    """(doc_id, text_key, item_key, item_id, m, matched): one row per text of a document and item that it contains.

    ``docs`` needs doc_id and text, ``items`` item_id and text; other columns aren't read. Null and empty texts
    contain nothing and are contained nowhere. Repeated rows of either side count once. Documents with a null
    id are found too, under the null id. Texts that share an id are measured and reported apart, by
    text_key. Texts of any length are read whole; an empty table of either side gives an empty result. Item shingles
    are broadcast only up to ``broadcast_rows`` counted rows, else joined by shuffle.
    """
    index = materialize(sketched(item_shingles(items, width), threshold), "items")
    n, widths = index.count(), sorted(r["width"] for r in index.select("width").distinct().collect())
    if not n:
        kinds = (f"{c} {df.schema[c].dataType.simpleString()}" for df, c in ((docs, "doc_id"), (items, "item_id")))
        doc, item = kinds
        return docs.sparkSession.createDataFrame([], f"{doc}, text_key long, item_key long, {item}, m int, matched long")
    near = (lambda df: F.broadcast(df)) if n <= broadcast_rows else (lambda df: df)
    rows = docs.select("doc_id", "text")
    sketch = index.where("in_sketch").select("item_key", "width", "h", "need", "hits", "size_class").distinct()
    candidates = None
    for k in widths:
        some = _candidates(rows, sketch.where(F.col("width") == k), k, near)
        candidates = some if candidates is None else candidates.unionByName(some)
    candidates = materialize(candidates.distinct(), "candidates")
    ids = materialize(candidates.select(F.col("doc_id").alias("id")).distinct(), "candidate-ids")
    again = rows.withColumn("text_key", F.xxhash64("text")).join(ids, rows["doc_id"].eqNullSafe(ids["id"]), "left_semi")
    hits = _held(again, widths, ["doc_id", "text_key"]).join(near(index.select("item_key", "item_id", "m", "shingle")), "shingle")
    pairs = hits.groupBy("doc_id", "text_key", "item_key", "item_id", "m").agg(F.count_distinct("shingle").alias("matched"))
    pairs = pairs.where(F.col("matched") >= threshold * F.col("m") - 1e-9)
    c = candidates.select(F.col("doc_id").alias("c_id"), F.col("item_key").alias("c_key"))
    return pairs.join(c, pairs["doc_id"].eqNullSafe(c["c_id"]) & (pairs["item_key"] == c["c_key"]), "left_semi")


def contained_items(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """(doc_id, item_id, item_shingles, matched, containment): one row per document and item that it contains.

    Texts that share an id are reported once, by the better one; the rest is as in ``contained_pairs``.
    """
    pairs = contained_pairs(docs, items, **options)
    best = pairs.groupBy("doc_id", "item_id").agg(F.max(F.struct(F.col("matched") / F.col("m"), "m", "matched")).alias("b"))
    return best.select("doc_id", "item_id", F.col("b.m").alias("item_shingles"), F.col("b.matched").alias("matched"), F.col("b.col1").alias("containment"))


def decontaminate(docs: DataFrame, items: DataFrame, **options) -> DataFrame:
    """``docs`` without the rows whose text contains an item; other texts of the same (or no) id stay.

    Null and empty texts stay, repeated rows go or stay together, and an empty table gives an empty result. Own
    columns may have any names.
    """
    # written first, so that the planner knows its size: texts move only if the keys are too many to broadcast
    bad = contained_pairs(docs, items, **options).select(F.col("doc_id").alias("bad_id"), F.col("text_key").alias("bad_key")).distinct()
    bad = materialize(bad, "contaminated")
    key = free_name(docs.columns, "text_key")
    rows = docs.withColumn(key, F.xxhash64("text"))
    return rows.join(bad, rows["doc_id"].eqNullSafe(bad["bad_id"]) & (rows[key] == bad["bad_key"]), "left_anti").select(*docs.columns)


def op3_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document and benchmark item that it contains; nulls, repeats, ties, long texts and empty tables as in ``contained_items``."""
    return contained_items(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP3_SQL = rf"""
WITH d AS (SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM documents),
i AS (SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS w FROM benchmark),
b AS (SELECT item_id, w, least(len(w), 5) AS k FROM i WHERE len(w) > 0),
ks AS (SELECT DISTINCT k FROM b),
ds AS (SELECT DISTINCT doc_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM d, ks WHERE len(w) >= k),
bs AS (SELECT DISTINCT item_id, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i+k-1], ' '))) AS s FROM b),
m AS (SELECT item_id, count(*) AS m FROM bs GROUP BY item_id)
SELECT doc_id, item_id, CAST(m AS INTEGER) AS item_shingles, count(*) AS matched, count(*) / CAST(m AS DOUBLE) AS containment
FROM ds JOIN bs USING (k, s) JOIN m USING (item_id) GROUP BY doc_id, item_id, m HAVING count(*) >= 0.8 * m - 1e-9
"""
