"""Passages of words that stand earlier already, found by prefix-partitioned suffix trees.

Every window of ``depth`` words hangs on one suffix: the one that begins at its least gram of ``GRAM`` words, by a hash.
Windows of equal words hang on equal suffixes at equal places, so no repeat is lost, though only a tenth of all suffixes
take part. Consecutive windows that hang on one suffix are a segment: the suffix with as many words before and behind it
as its windows have.
Suffixes are dealt to groups by their first words, and each group fits in memory. A prefix that too many segments share is
lengthened: its windows are dealt one by one, by all their words. Before anything is dealt, equal segments of a pack of
documents become one, the earliest; so a passage that all documents hold is shuffled once a pack.
A group looks only at prefixes that several segments share, grows the tree of their windows from the root down, a few
words at a time, and drops branches with a single leaf. What is left at ``depth`` words are the deep internal nodes: all
leaves of one but the earliest are repeats, and repeats that follow each other make up the maximal ones.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from watchlake.llm.common import free_name, materialize, table

DEPTH, GRAM = 20, 4
GROUP_BYTES = 8 << 20  # bytes of text whose segments a group gets
PACK_BYTES = 4 << 20  # bytes of text that are cut into segments at once
HOT = 4096  # segments, counted in packs that have two or more, from which a prefix is lengthened
MOST_HOT = 1 << 20  # prefixes in the broadcast list, 8 MB; those of most segments
NO_ID = -(1 << 63)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


class Pack:
    """Texts one after the other, with single spaces, and where their words are."""

    def __init__(self, texts: list[bytes]):
        raw = np.frombuffer(b"\n".join([*texts, b""]), np.uint8)
        ends = np.cumsum([len(t) + 1 for t in texts])
        blank = (raw == 32) | ((raw >= 9) & (raw <= 13))
        word = ~blank
        begins = word.copy()
        begins[1:] &= blank[:-1]
        stops = blank.copy()
        stops[1:] &= word[:-1]
        stops[:1] = False
        kept = raw[word | stops].copy()
        at_begin, at_stop = np.flatnonzero(begins), np.flatnonzero(stops)
        lengths = at_stop - at_begin
        self.end = np.cumsum(lengths + 1)  # place behind the space after each word
        self.begin = self.end - lengths - 1
        kept[self.end - 1] = 32
        self.text = kept.tobytes()
        self.doc = np.searchsorted(ends, at_begin, side="right")
        self.first = np.searchsorted(self.doc, np.arange(len(texts)))  # each text's first word

    def words(self) -> np.ndarray:
        """A hash of each word, from the sums of powers of its bytes. It decides where words go, and nothing else."""
        b = np.frombuffer(self.text, np.uint8)
        up = np.full(len(b) + 1, MULTIPLIER)
        up[:1] = 1
        up = np.multiply.accumulate(up)
        down = np.full(len(b) + 1, np.uint64(pow(int(MULTIPLIER), -1, 1 << 64)))
        down[:1] = 1
        down = np.multiply.accumulate(down)
        sums = np.zeros(len(b) + 1, np.uint64)
        np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
        return mixed((sums[self.end] - sums[self.begin]) * down[self.begin])


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def chained(h: np.ndarray, size: int) -> np.ndarray:
    """A hash of each ``size`` consecutive values."""
    n = max(0, len(h) - size + 1)
    g = np.zeros(n, np.uint64)
    for i in range(size):
        g = mixed((g ^ h[i : i + n]) * MULTIPLIER)
    return g


def segments(pack: Pack, depth: int, hot: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(prefix, first window, last window) of the pack's segments; windows of hot prefixes are segments of their own."""
    empty = np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    h = pack.words()
    n = len(h) - depth + 1
    if n <= 0:
        return empty
    grams = chained(h, min(GRAM, depth))
    span = depth - min(GRAM, depth) + 1
    low = np.uint64((1 << span.bit_length()) - 1)
    best = grams[:n] | low
    best ^= low
    for k in range(1, span):
        np.minimum(best, (grams[k : k + n] & ~low) | np.uint64(k), out=best)
    at = (best & low).astype(np.int64) + np.arange(n)
    window = np.flatnonzero(pack.doc[:n] == pack.doc[depth - 1 :])
    if not len(window):
        return empty
    at = at[window]
    key = grams[at]
    is_hot = np.isin(key, hot) if len(hot) else np.zeros(len(at), bool)
    new = np.ones(len(at), bool)
    new[1:] = (at[1:] != at[:-1]) | (window[1:] != window[:-1] + 1) | is_hot[1:]
    first = np.flatnonzero(new)
    last = np.append(first[1:] - 1, len(at) - 1)
    prefix = key[first]
    if is_hot.any():
        prefix = np.where(is_hot[first], chained(h, depth)[window[first]], prefix)
    return prefix, window[first], window[last]


def deep_nodes(x: np.ndarray, starts: np.ndarray, depth: int) -> np.ndarray:
    """For each start, the least start whose first ``depth`` symbols are the same. Branches with one leaf are left early."""
    out = starts.copy()
    node, live, done = np.zeros(len(starts), np.int64), np.arange(len(starts)), 0
    while done < depth and len(live):
        step = 1 if done < 2 else 2  # two more symbols at a time, as one number
        step = min(step, depth - done)
        sym = x[starts[live] + done]
        if step == 2:
            sym = np.unique(sym * (int(x.max()) + 1) + x[starts[live] + done + 1], return_inverse=True)[1]
        node, count = np.unique(node * (int(sym.max()) + 1) + sym, return_inverse=True, return_counts=True)[1:]
        several = count[node] > 1
        node, live, done = node[several], live[several], done + step
    if len(live):
        order = np.lexsort((starts[live], node))
        node, live = node[order], live[order]
        head = np.ones(len(node), bool)
        head[1:] = node[1:] != node[:-1]
        out[live] = starts[live][np.flatnonzero(head)[np.cumsum(head) - 1]]
    return out


def _spans(doc: np.ndarray, key: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[tuple[int, int, bytes]]:
    """(doc_id, text_key, spans) a document: its stretches of words as pairs of 32-bit numbers."""
    order = np.lexsort((start, key, doc))
    doc, key, both = doc[order], key[order], np.stack([start[order], end[order]], 1).astype(np.int32)
    cut = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (key[1:] != key[:-1]), [True]])) if len(doc) else np.zeros(0, np.int64)
    return [(int(doc[a]), int(key[a]), both[a:b].tobytes()) for a, b in zip(cut[:-1].tolist(), cut[1:].tolist())]


def _pack_up(doc, key, start, prefix, bodies: list[bytes]) -> bytes:
    """Segments as one compressed blob."""
    import zstandard

    head = np.array([len(bodies)], np.int64)
    sizes = np.fromiter(map(len, bodies), np.int32, len(bodies))
    parts = [head, doc.astype(np.int64), key.astype(np.int64), prefix, start.astype(np.int32), sizes]
    return zstandard.ZstdCompressor(1).compress(b"".join([*(p.tobytes() for p in parts), *bodies]))


def _unpack(blob: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray, bytes]:
    """(doc_id, text_key, prefix, start, place of each segment's text and of the end, texts)."""
    import zstandard

    raw = zstandard.ZstdDecompressor().decompress(blob)
    n, at, out = int(np.frombuffer(raw, np.int64, 1)[0]), 8, []
    for kind in (np.int64, np.int64, np.uint64, np.int32, np.int32):
        out.append(np.frombuffer(raw, kind, n, at))
        at += out[-1].nbytes
    return (*out[:4], np.concatenate([[0], np.cumsum(out[4], dtype=np.int64)]), raw[at:])


def _packs(batches: Iterator[pa.RecordBatch], pack_bytes: int) -> Iterator[tuple[np.ndarray, np.ndarray, Pack]]:
    """(doc_id, text_key, texts) of about ``pack_bytes`` at a time, by doc_id and text_key, each such pair once."""

    def flush(rows: dict) -> tuple[np.ndarray, np.ndarray, Pack]:
        keys = sorted(rows)
        return np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int64), Pack([rows[k] for k in keys])

    rows, size = {}, 0
    for b in batches:
        for i, k, t in zip(b.column(0), b.column(1), b.column(2)):
            text = t.as_py() or b""
            rows[i.as_py(), k.as_py()] = text
            size += len(text) + 1
            if size >= pack_bytes:
                yield flush(rows)
                rows, size = {}, 0
    if rows:
        yield flush(rows)


def _hot_prefixes(source: DataFrame, depth: int, pack_bytes: int, hot: int) -> np.ndarray:
    """Prefixes of more than ``hot`` segments, counted over all packs that have two or more different ones.

    The list decides where segments are dealt and nothing else, so it may be cut to the ``MOST_HOT`` most frequent.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        none = np.empty(0, np.uint64)
        for _, _, pack in _packs(batches, pack_bytes):
            prefix, first, last = segments(pack, depth, none)
            order = np.argsort(prefix, kind="stable")
            prefix, first, last = prefix[order], first[order], last[order]
            same = np.zeros(len(prefix), bool)
            same[1:] = prefix[1:] == prefix[:-1]
            many = np.flatnonzero(same | np.append(same[1:], False))
            seen = {(int(prefix[i]), pack.text[pack.begin[first[i]] : pack.end[last[i] + depth - 1]]) for i in many.tolist()}
            found, n = np.unique(np.array([p for p, _ in seen], np.uint64), return_counts=True)
            found, n = found[n > 1], n[n > 1]
            yield pa.RecordBatch.from_arrays([pa.array(found.view(np.int64)), pa.array(n)], names=["prefix", "n"])

    counts = source.mapInArrow(count, "prefix long, n long").groupBy("prefix").agg(F.sum("n").alias("n")).where(F.col("n") > hot)
    found = counts.orderBy(F.desc("n"), "prefix").limit(MOST_HOT).select("prefix").toPandas()["prefix"]
    return np.sort(found.to_numpy(np.int64).view(np.uint64))


def repeats(docs: DataFrame, depth: int = DEPTH, group_bytes: int = GROUP_BYTES, pack_bytes: int = PACK_BYTES, hot: int = HOT) -> DataFrame:
    """(doc_id, text_key, spans) of the documents with windows of ``depth`` words that start earlier too.

    ``docs`` needs doc_id and text. Earlier: at a smaller doc_id, or earlier in the same document. Documents of one id are
    told apart, and ordered, by text_key, the XXH64 of the text; null ids come first, as the least number. Rows that
    repeat id and text are one document. spans are pairs of 32-bit numbers, first word and last word + 1; a document may
    have several rows, and spans may overlap. Null and empty texts have no windows; an empty table gives no rows.
    """
    ident = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long"))
    source = docs.select(ident.alias("doc_id"), F.xxhash64("text").alias("text_key"), F.col("text").cast("binary").alias("text"))
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    groups = int(size // group_bytes) + 1
    lengthened = _hot_prefixes(source, depth, pack_bytes, hot)

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for doc, key, pack in _packs(batches, pack_bytes):
            prefix, first, last = segments(pack, depth, lengthened)
            bodies = [pack.text[a:b] for a, b in zip(pack.begin[first].tolist(), (pack.end[last + depth - 1] - 1).tolist())]
            earliest: dict[bytes, int] = {}
            new = np.fromiter((earliest.setdefault(t, i) == i for i, t in enumerate(bodies)), bool, len(bodies))
            owner = pack.doc[first]
            start = first - pack.first[owner]
            again = ~new
            rows = [(int(d ^ k) % groups, d, k, s, None) for d, k, s in _spans(doc[owner[again]], key[owner[again]], start[again], (start + last - first + depth)[again])]
            chosen = np.flatnonzero(new)
            part = (prefix[chosen] >> np.uint64(8)) % np.uint64(groups)
            order = np.argsort(part, kind="stable")
            chosen, part = chosen[order], part[order]
            cut = np.flatnonzero(np.concatenate([[True], part[1:] != part[:-1], [True]])) if len(part) else np.zeros(0, np.int64)
            for a, b in zip(cut[:-1].tolist(), cut[1:].tolist()):
                mine = chosen[a:b]
                blob = _pack_up(doc[owner[mine]], key[owner[mine]], start[mine], prefix[mine], [bodies[i] for i in mine.tolist()])
                rows.append((int(part[a]), 0, 0, None, blob))  # no nulls in numbers, which pandas would turn into floats
            kinds = (pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.binary())
            cols = zip(*rows) if rows else ([],) * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], names=["part", "doc_id", "text_key", "spans", "blob"])

    def grow(rows: pd.DataFrame) -> pd.DataFrame:
        done = rows[rows["blob"].isna()]
        out = list(zip(done["doc_id"], done["text_key"], done["spans"]))
        blobs = rows["blob"].dropna().tolist()
        prefixes = np.concatenate([np.empty(0, np.uint64), *(_unpack(b)[2] for b in blobs)])
        found, n = np.unique(prefixes, return_counts=True)
        shared = found[n > 1]
        doc, key, start, bodies = [], [], [], []
        for blob in blobs:
            d, k, p, s, at, text = _unpack(blob)
            mine = np.flatnonzero(np.isin(p, shared))
            doc.append(d[mine])
            key.append(k[mine])
            start.append(s[mine].astype(np.int64))
            bodies += [text[a:b] for a, b in zip(at[mine].tolist(), at[mine + 1].tolist())]
        if bodies:
            out += _spans(*repeated(np.concatenate(doc), np.concatenate(key), np.concatenate(start), bodies, depth))
        return pd.DataFrame(out, columns=["doc_id", "text_key", "spans"])

    dealt = source.mapInArrow(deal, "part long, doc_id long, text_key long, spans binary, blob binary")
    return dealt.groupBy("part").applyInPandas(grow, "doc_id long, text_key long, spans binary")


def repeated(doc: np.ndarray, key: np.ndarray, start: np.ndarray, bodies: list[bytes], depth: int) -> tuple[np.ndarray, ...]:
    """(doc, key, first word, last word + 1) of the stretches in segments that stand in an earlier one, or earlier in it."""
    order = np.lexsort((start, key, doc))
    doc, key, start, bodies = doc[order], key[order], start[order], [bodies[i] for i in order.tolist()]
    words = [b.split(b" ") for b in bodies]
    length = np.fromiter(map(len, words), np.int64, len(words))
    known: dict[bytes, int] = {}
    # a row that stands twice is one document, and of equal segments only the first has leaves in the tree
    twin = np.zeros(len(doc), bool)
    twin[1:] = (doc[1:] == doc[:-1]) & (key[1:] == key[:-1]) & (start[1:] == start[:-1])
    earliest: dict[bytes, int] = {}
    copy = np.fromiter((earliest.setdefault(b, i) != i for i, b in enumerate(bodies)), bool, len(bodies)) & ~twin
    own = np.flatnonzero(~copy & ~twin)
    x = np.fromiter((known.setdefault(w, len(known)) for i in own.tolist() for w in words[i]), np.int64, int(length[own].sum()))
    many = length[own] - depth + 1
    base = np.cumsum(length[own]) - length[own]
    seg = np.repeat(np.arange(len(own)), many)
    off = np.arange(len(seg)) - np.repeat(np.cumsum(many) - many, many)
    starts = base[seg] + off
    later = deep_nodes(x, starts, depth) != starts
    seg, off = seg[later], off[later]
    head = np.ones(len(seg), bool)
    head[1:] = (seg[1:] != seg[:-1]) | (off[1:] != off[:-1] + 1)
    first = np.flatnonzero(head)
    last = np.append(first[1:] - 1, len(seg) - 1) if len(seg) else first
    row = own[seg[first]]
    whole = np.flatnonzero(copy)
    rows = np.concatenate([row, whole])
    begin = np.concatenate([start[row] + off[first], start[whole]])
    end = np.concatenate([start[row] + off[last] + depth, start[whole] + length[whole]])
    return doc[rows], key[rows], begin, end


def without_repeats(docs: DataFrame, depth: int = DEPTH, texts: bool = False, **sizes: int) -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row of ``docs``, with ``texts`` also kept, the words that stay.

    A word goes if a window of ``depth`` words covers it that starts earlier too, as ``repeats`` says; windows are judged on
    the texts as they are given. Words are runs of other characters than the six ASCII white-space ones, told apart as
    they are; those that stay are joined by one space. Of rows that repeat id and text one is judged so, and the others,
    which start later, lose all words, if they have ``depth`` at least. Null and empty texts have no words. An empty table
    gives an empty result; other columns of ``docs`` don't matter. A text of any length is one row's work here.
    """
    docs = docs.select("doc_id", "text")
    found = repeats(docs, depth, **sizes).groupBy(F.col("doc_id").alias("_doc"), F.col("text_key").alias("_key")).agg(F.collect_list("spans").alias("spans"))
    found = materialize(found, "spans")
    rows = docs.groupBy("doc_id", F.xxhash64("text").alias("_key")).agg(F.first("text").alias("text"), F.count("*").alias("_copies"))
    rows = rows.withColumn("_doc", F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID).cast("long")))
    both = rows.join(found, ["_doc", "_key"], "left").select("doc_id", F.col("text").cast("binary").alias("text"), "spans", "_copies")
    schema = T.StructType([docs.schema["doc_id"], *T.StructType.fromDDL("n_words long, n_removed long, kept_sha256 string" + ", kept string" * texts + ", copies long").fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                out = []
                for doc, t, spans, copies in zip(*(b.column(k) for k in range(4))):
                    words = (t.as_py() or b"").split()
                    stay = words
                    if spans.is_valid:
                        keep = np.ones(len(words), bool)
                        for s in spans.as_py():
                            for x, y in np.frombuffer(s, np.int32).reshape(-1, 2).tolist():
                                keep[x:y] = False
                        stay = [words[i] for i in np.flatnonzero(keep).tolist()]
                    out += [_kept(doc.as_py(), words, stay, texts, 1)]
                    if copies.as_py() > 1:
                        out += [_kept(doc.as_py(), words, words if len(words) < depth else [], texts, copies.as_py() - 1)]
                kinds = [f.type for f in pa_schema(schema)]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), kinds)], names=schema.names)

    done = both.mapInArrow(run, schema)
    n = free_name(done.columns, "n")
    return done.withColumn(n, F.explode(F.expr("sequence(1L, copies)"))).drop(n, "copies")


def pa_schema(schema: T.StructType) -> pa.Schema:
    from pyspark.sql.pandas.types import to_arrow_schema

    return to_arrow_schema(schema)


def _kept(doc: int | None, words: list[bytes], stay: list[bytes], texts: bool, copies: int) -> tuple:
    text = b" ".join(stay)
    row = (doc, len(words), len(words) - len(stay), hashlib.sha256(text).hexdigest())
    return (*row, text.decode("utf-8", "replace"), copies) if texts else (*row, copies)


def op13_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the words of windows that start earlier too; cases as in ``without_repeats``."""
    return without_repeats(table(spark, sf_dir, "documents"))


OP13_SQL = r"""
WITH d AS (
  SELECT doc_id, row_number() OVER (ORDER BY doc_id NULLS FIRST) AS place, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS words FROM documents
), w AS (
  SELECT place, i, words[i : i + 19] AS grams FROM (SELECT place, words, unnest(range(1, len(words) - 18)) AS i FROM d)
), later AS (
  SELECT place, i FROM (SELECT place, i, row_number() OVER (PARTITION BY grams ORDER BY place, i) AS k FROM w) WHERE k > 1
), gone AS (
  SELECT place, list(DISTINCT i + k) AS g FROM later, range(20) AS r(k) GROUP BY place
), kept AS (
  SELECT doc_id, words, CASE WHEN g IS NULL THEN words ELSE list_filter(words, lambda x, k: NOT list_contains(g, k)) END AS stay FROM d LEFT JOIN gone USING (place)
)
SELECT doc_id, len(words)::BIGINT AS n_words, (len(words) - len(stay))::BIGINT AS n_removed, sha256(array_to_string(stay, ' ')) AS kept_sha256 FROM kept
"""
