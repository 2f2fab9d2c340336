"""A Merkle manifest of a table: leaf hashes, a tree a group, a tree over the groups, and a proof for every row.

Rows of a group are numbered by range sorting, and slots are cut into blocks of ``fan ** levels`` slots. Within a block
all levels are computed by windows over (group, block) in the order of slots: a node of level l lies on the row of its
first leaf, so its siblings are the rows at fixed offsets of ``fan ** l`` rows before and behind it. Lag and lead columns
at these offsets, masked by the place in the run and by the number of nodes that the group has at the level, are the
siblings; rows of first children hash them to parents. The blocks' tops are the slots of the next round, until every
group is one node. On the way back a node hands its path to its children by the same offsets.
A group of any size is spread over its blocks, each of which is a few thousand rows of hashes; the texts are hashed where
they are read and are never shuffled.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from watchlake.llm.common import free_name, materialize, table

FAN, LEVELS = 2, 12
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
STEP = "struct<l:string,r:string>"


def sha(*parts: Column) -> Column:
    """Lowercase hex sha256 of the parts, one after the other."""
    return F.sha2(F.concat(*parts) if len(parts) > 1 else parts[0], 256)


def leaf_hash(*values: Column) -> Column:
    """Hash of the values: each its UTF-8 byte count, a colon and itself; ``-`` stands for null."""
    text = [v.cast("string") for v in values]
    return sha(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in text))


def slots(rows: DataFrame, group: str, *order: Column) -> DataFrame:
    """``rows`` with slot, from 0 in each group, and n, the rows of the group.

    Tasks sort ranges of (group, order). A slot is the place in the range plus the group's rows in the ranges before,
    which are counted by range and group first and added up over the ranges by a window a group: one row a range.
    """
    by = [F.col(group).asc_nulls_first(), *order]
    kept = rows.repartitionByRange(*by).sortWithinPartitions(*by).withColumn("_id", F.monotonically_increasing_id())
    kept = materialize(kept, "slots").withColumn("_task", F.shiftright("_id", 33)).withColumn("_at", F.col("_id").bitwiseAND(F.lit((1 << 33) - 1)))
    counts = kept.groupBy(F.col(group).alias("_group"), "_task").agg(F.count("*").alias("_n"), F.min("_at").alias("_first"))
    before = Window.partitionBy("_group").orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).withColumn("n", F.sum("_n").over(Window.partitionBy("_group")))
    on = kept[group].eqNullSafe(counts["_group"]) & (kept["_task"] == counts["_task"])
    numbered = kept.join(counts, on).withColumn("slot", F.col("_before") + F.col("_at") - F.col("_first"))
    return numbered.select(*rows.columns, "slot", "n")


def _round(nodes: DataFrame, fan: int, levels: int) -> DataFrame:
    """``nodes`` (grp, slot, n, hash) with top, the hash of their block's last level, and path, the steps to it."""
    w = Window.partitionBy("grp", "block").orderBy("slot")
    df = nodes.withColumn("block", F.expr(f"slot div {fan**levels}")).withColumn("h0", F.col("hash"))
    # the nodes of level l are on the rows whose slot is a multiple of fan^l; above the group's root nothing changes
    count = lambda k: F.expr(f"(n + {fan**k - 1}) div {fan**k}")
    for k in range(levels):
        at = F.expr(f"slot div {fan**k}")
        mine = (F.col("slot") % fan**k == 0) & (count(k) > 1)
        place = at % fan
        left = [F.when(mine & (place >= d), F.lag(f"h{k}", d * fan**k).over(w)) for d in range(fan - 1, 0, -1)]
        right = [F.when(mine & (place + d < fan) & (at + d < count(k)), F.lead(f"h{k}", d * fan**k).over(w)) for d in range(1, fan)]
        df = df.withColumns({f"l{k}": F.concat_ws("", *left), f"r{k}": F.concat_ws("", *right)})
        parent = F.when(mine & (place == 0), sha(F.col(f"h{k}"), F.col(f"r{k}"))).when(count(k) <= 1, F.col(f"h{k}"))
        df = df.withColumn(f"h{k + 1}", parent)
    df = df.withColumn("path", F.array().cast(f"array<{STEP}>"))
    for k in reversed(range(levels)):
        place = F.expr(f"slot div {fan**k}") % fan
        above = reduce(lambda c, d: c.when(place == d, F.lag("path", d * fan**k).over(w)), range(1, fan), F.when(place == 0, F.col("path")))
        step = F.array(F.struct(F.col(f"l{k}").alias("l"), F.col(f"r{k}").alias("r")))
        df = df.withColumn("path", F.when(F.col("slot") % fan**k == 0, F.when(count(k) > 1, F.concat(step, above)).otherwise(above)))
    top = F.first(f"h{levels}").over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))  # it is on the block's first row
    return df.select(*nodes.columns, "block", top.alias("top"), "path")


def trees(nodes: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """``nodes`` (grp, slot, n, hash and others) with root, that of their group, and path, the steps to it.

    Slots go from 0 to n - 1 in a group; grp may be null. A step is the hashes left and right of the node in its run, empty
    where there are none. A group's only node is its root. An empty table gives an empty one.
    """
    done = materialize(_round(nodes, fan, levels), "tree")
    most = done.agg(F.max("n")).first()[0]
    if most is None or most <= fan**levels:
        return done.withColumnRenamed("top", "root").drop("block")
    tops = done.where(F.col("slot") % fan**levels == 0)
    size = F.expr(f"(n + {fan**levels - 1}) div {fan**levels}")
    above = trees(tops.select("grp", F.col("block").alias("slot"), size.alias("n"), F.col("top").alias("hash")), fan, levels)
    above = above.select(F.col("grp").alias("_grp"), F.col("slot").alias("_block"), "root", F.col("path").alias("_path"))
    both = done.join(above, done["grp"].eqNullSafe(above["_grp"]) & (done["block"] == above["_block"]))
    return both.select(*nodes.columns, "root", F.concat("path", "_path").alias("path"))


def fold_path(leaf: Column, path: Column) -> Column:
    """The root that a leaf and its steps lead to."""
    return F.aggregate(path, leaf, lambda h, s: sha(s["l"], h, s["r"]))


def proof_hash(path: Column) -> Column:
    """Hash of a proof: its siblings, level by level, left to right."""
    return sha(F.array_join(F.transform(path, lambda s: F.concat(s["l"], s["r"])), ""))


def manifest(df: DataFrame, leaf: Column, group: str, *order: Column, fan: int = FAN, levels: int = LEVELS, keep: tuple[str, ...] = ()) -> DataFrame:
    """(the columns of ``keep``, leaf, subroot, root, path) of every row of ``df``.

    Each value of ``group``, null included, has a tree over its rows by ``order``, then leaf; rows that agree in both are the
    same leaf, and their places among each other don't show. The groups' roots, in byte order, null first, are the leaves
    of the last tree. ``path`` has the steps up to the root. An empty table gives an empty manifest. Texts of any length
    are hashed by the task that reads them, and only ``keep``, ``order``, group and leaf are shuffled. ``keep`` may not
    have the names of the new columns.
    """
    names = [f"_k{i}" for i in range(len(order))]
    rows = df.select(*keep, F.col(f"`{group}`").alias("grp"), leaf.alias("hash"), *(c.alias(x) for c, x in zip(order, names)))
    leaves = slots(rows, "grp", *(F.col(x).asc_nulls_first() for x in names), F.col("hash")).drop(*names)
    low = materialize(trees(leaves, fan, levels).withColumnRenamed("root", "subroot"), "paths")
    roots = low.where("slot = 0").select(F.lit(0).alias("all"), "grp", "subroot")
    roots = materialize(slots(roots, "all", F.col("grp").asc_nulls_first()), "subroots")
    high = trees(roots.select(F.col("all").alias("grp"), "slot", "n", F.col("subroot").alias("hash"), F.col("grp").alias("of")), fan, levels)
    both = low.join(high.select("of", "root", F.col("path").alias("up")), F.col("grp").eqNullSafe(F.col("of")))
    return both.select(*keep, F.col("hash").alias("leaf"), "subroot", "root", F.concat("path", "up").alias("path"))


def verified(found: DataFrame, seen: Column) -> DataFrame:
    """``found`` with folded_root, from the leaf ``seen`` now and the steps of the manifest, and whether it is the root."""
    folded = free_name(found.columns, "folded_root")
    found = found.withColumn(folded, fold_path(seen, F.col("path")))
    return found.withColumn(free_name(found.columns, "verified"), F.col(folded) == F.col("root"))


def op12_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Proofs of every document, and whether the tampered table still has the root; a null doc_id isn't tampered with."""
    docs = table(spark, sf_dir, "documents").select(*FIELDS)
    plain = leaf_hash(*(F.col(c) for c in FIELDS))
    hit = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0, F.lit(False))
    seen = F.when(hit, leaf_hash(*((F.col(c) + 1 if c == "n_chars" else F.col(c)) for c in FIELDS)))
    found = manifest(docs.withColumn("seen", seen), plain, "lang", F.col("doc_id"), keep=("doc_id", "seen"))
    found = verified(found, F.coalesce("seen", "leaf"))
    return found.select("doc_id", "leaf", "subroot", "root", proof_hash(F.col("path")).alias("proof_sha256"), "folded_root", "verified")


OP12_SQL = r"""
WITH RECURSIVE tab AS (
  SELECT list(list_reduce([b, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY b) AS t
  FROM range(256) AS r(b)
), d AS (
  SELECT doc_id, lang, sha256(concat(a, s, l, c, x)) AS leaf, sha256(concat(a, s, l, c2, x)) AS seen,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, sha256(concat(a, s, l, c, x))) - 1 AS slot
  FROM (SELECT doc_id, lang, coalesce(strlen(doc_id::VARCHAR) || ':' || doc_id, '-') AS a, coalesce(strlen(source) || ':' || source, '-') AS s,
      coalesce(strlen(lang) || ':' || lang, '-') AS l, coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') AS c,
      coalesce(strlen(text) || ':' || text, '-') AS x,
      CASE WHEN xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(doc_id::VARCHAR, ''), lambda k: ascii(k)::BIGINT)),
        lambda h, k: xor(h >> 8, t[(xor(h, k) & 255) + 1])), 4294967295) % 7 = 0
        THEN coalesce(strlen((n_chars + 1)::VARCHAR) || ':' || (n_chars + 1), '-') ELSE coalesce(strlen(n_chars::VARCHAR) || ':' || n_chars, '-') END AS c2
    FROM documents, tab)
), low AS (
  SELECT lang, 0 AS lvl, slot, leaf AS hash, count(*) OVER (PARTITION BY lang) AS n FROM d
  UNION ALL
  SELECT lang, lvl + 1, slot // 2, sha256(string_agg(hash, '' ORDER BY slot)), (any_value(n) + 1) // 2 FROM low WHERE n > 1 GROUP BY lang, lvl, slot // 2
), subs AS (
  SELECT lang, hash AS subroot, lvl AS depth, row_number() OVER (ORDER BY lang NULLS FIRST) - 1 AS place FROM low WHERE n = 1
), high AS (
  SELECT 0 AS lvl, place AS slot, subroot AS hash, count(*) OVER () AS n FROM subs
  UNION ALL
  SELECT lvl + 1, slot // 2, sha256(string_agg(hash, '' ORDER BY slot)), (any_value(n) + 1) // 2 FROM high WHERE n > 1 GROUP BY lvl, slot // 2
), steps AS (
  SELECT d.lang, d.slot, k AS lvl, (d.slot >> k) & 1 AS side, coalesce(low.hash, '') AS sib
  FROM d JOIN subs ON d.lang IS NOT DISTINCT FROM subs.lang CROSS JOIN range(64) AS r(k)
  LEFT JOIN low ON low.lang IS NOT DISTINCT FROM d.lang AND low.lvl = k AND low.slot = xor(d.slot >> k, 1)
  WHERE k < subs.depth
), ups AS (
  SELECT subs.lang, k AS lvl, (subs.place >> k) & 1 AS side, coalesce(high.hash, '') AS sib
  FROM subs CROSS JOIN range(64) AS r(k)
  LEFT JOIN high ON high.lvl = k AND high.slot = xor(subs.place >> k, 1)
  WHERE k < (SELECT max(lvl) FROM high)
), lists AS (
  SELECT lang, slot, list({'s': side, 'h': sib} ORDER BY lvl) AS p FROM steps GROUP BY lang, slot
), uplists AS (
  SELECT lang, list({'s': side, 'h': sib} ORDER BY lvl) AS p FROM ups GROUP BY lang
), paths AS (
  SELECT d.*, subs.subroot, list_concat(coalesce(lists.p, []), coalesce(uplists.p, [])) AS p
  FROM d JOIN subs ON d.lang IS NOT DISTINCT FROM subs.lang LEFT JOIN lists ON d.lang IS NOT DISTINCT FROM lists.lang AND d.slot = lists.slot
  LEFT JOIN uplists ON d.lang IS NOT DISTINCT FROM uplists.lang
), folded AS (
  SELECT doc_id, leaf, subroot, sha256(coalesce(array_to_string(list_transform(p, lambda q: q.h), ''), '')) AS proof_sha256,
    list_reduce(list_prepend({'s': 0, 'h': seen}, list_transform(p, lambda q: {'s': q.s::INT, 'h': q.h})),
      lambda h, q: {'s': 0, 'h': sha256(CASE WHEN q.s = 1 THEN q.h || h.h ELSE h.h || q.h END)}).h AS folded_root
  FROM paths
)
SELECT doc_id, leaf, subroot, (SELECT hash FROM high WHERE n = 1) AS root, proof_sha256, folded_root,
  folded_root = (SELECT hash FROM high WHERE n = 1) AS verified
FROM folded
"""
