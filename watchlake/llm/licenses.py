"""License scans with a generalised suffix automaton.

Templates are a table of labels and texts; those that come along are whole licences, each a file in the folder
``licences``, and short notices. The automaton holds every run of words of all templates. A text is streamed through it once; at each word it
tells the longest run of words that ends there and occurs in a template (the matching statistics). Long
matches that follow each other in the text and in a template are chained, each at its first place in the template
behind the chain; a chain that covers enough of a template labels the text with it.
"""

from __future__ import annotations

from bisect import bisect_right
from collections.abc import Iterator
from importlib.resources import files

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from watchlake.llm.common import free_name, table

# Phrases whose every place counts, and their labels.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

# Wordings of notices, by the label that they give (lower case, words only).
TEMPLATES = {
    "mit-license": [
        "released under the mit license",
        "licensed under the mit license",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction",
    ],
    "apache-2.0": [
        "licensed under the apache license version 2 0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    ],
    "gpl-3.0": [
        "licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public "
        "license as published by the free software foundation",
    ],
    "cc-by-nc-4.0": ["licensed under cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "cc-by-4.0": ["licensed under cc by 4 0", "creative commons attribution 4 0 international license"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
    ],
    "all-rights-reserved": ["all rights reserved"],
}

#: Bytes that end a word become blanks; A-Z become a-z; bytes of longer characters stay.
BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(BYTES).split()


class Automaton:
    """A generalised suffix automaton over lists of words, with where each state's runs end in each list."""

    def __init__(self, lists: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[dict[int, list[int]]] = [{}]  # list -> ends (words up to there), rising
        for k, ws in enumerate(lists):
            last = 0
            for i, w in enumerate(ws):
                last = self._add(last, w)
                self.ends[last].setdefault(k, []).append(i + 1)
        for v in sorted(range(1, len(self.link)), key=lambda v: -self.length[v]):
            if (up := self.link[v]) > 0:
                for k, found in self.ends[v].items():
                    self.ends[up].setdefault(k, []).extend(found)
        for found in self.ends:
            for k in found:
                found[k] = sorted(set(found[k]))

    def _state(self, length: int, link: int, nxt: dict) -> int:
        self.next.append(nxt)
        self.length.append(length)
        self.link.append(link)
        self.ends.append({})
        return len(self.next) - 1

    def _split(self, p: int, w: bytes, q: int) -> int:
        """The state for the runs that end in w after p's longest one, cut off from q if q holds longer ones too."""
        if self.length[q] == self.length[p] + 1:
            return q
        clone = self._state(self.length[p] + 1, self.link[q], dict(self.next[q]))
        self.link[q] = clone
        while p >= 0 and self.next[p].get(w) == q:
            self.next[p][w] = clone
            p = self.link[p]
        return clone

    def _add(self, last: int, w: bytes) -> int:
        if (q := self.next[last].get(w)) is not None:  # known from an earlier list
            return self._split(last, w, q)
        cur, p = self._state(self.length[last] + 1, 0, {}), last
        while p >= 0 and w not in self.next[p]:
            self.next[p][w] = cur
            p = self.link[p]
        if p >= 0:
            self.link[cur] = self._split(p, w, self.next[p][w])
        return cur

    def find(self, ws: list[bytes]) -> int | None:
        at = 0
        for w in ws:
            if (at := self.next[at].get(w)) is None:
                return None
        return at


def licence_templates() -> list[tuple[str, str]]:
    """(label, text) of the templates that come along."""
    whole = [(f.name[: -len(".txt")], f.read_text(errors="replace")) for f in files(__package__).joinpath("licences").iterdir() if f.name.endswith(".txt")]
    return sorted(whole) + [(label, text) for label, texts in sorted(TEMPLATES.items()) for text in texts]


class Scanner:
    """``least``: words of a match worth chaining; ``gap``: words that a chain may skip; ``cover``: share of a template."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str], least: int = 3, gap: int = 16, cover: float = 0.75):
        some = [(label, ws) for label, text in templates if (ws := words(text.encode()))]
        self.labels, self.lists = [label for label, _ in some], [ws for _, ws in some]
        self.least, self.gap, self.cover = least, gap, cover
        base = [(words(p.encode()), label) for p, label in sorted(phrases.items())]
        self.sam = Automaton(self.lists + [ws for ws, _ in base])
        homes = {self.sam.find(ws): (len(ws), label) for ws, label in base}
        # phrases that end where a state's run ends: the state itself and those that its links reach
        self.base: list[tuple] = []
        for v in range(len(self.sam.link)):
            found, u = [], v
            while u > 0:
                found += [homes[u]] if u in homes else []
                u = self.sam.link[u]
            self.base.append(tuple(found))

    def scan(self, text: bytes | None) -> dict:
        """n_words, places (start, label) of phrases, spans (label, start, end, covered share) of chained matches."""
        ws = words(text)
        step, link, length, base, ends = self.sam.next, self.sam.link, self.sam.length, self.base, self.sam.ends
        known, state, run = step[0], 0, 0
        places, matches = [], []
        for i, w in enumerate(ws):
            if w not in known:  # every template word leaves the first state
                if run >= self.least:
                    matches.append((i, run, state))
                state = run = 0
                continue
            nxt = step[state].get(w)
            if nxt is None:
                if run >= self.least:
                    matches.append((i, run, state))
                while nxt is None:
                    state = link[state]
                    run = length[state]
                    nxt = step[state].get(w)
            state, run = nxt, run + 1
            for size, label in base[state]:
                if run >= size:
                    places.append((i + 1 - size, label))
        if run >= self.least:
            matches.append((len(ws), run, state))
        open_: dict[int, list] = {}
        spans = []
        for end, size, v in matches:
            for k, found in ends[v].items():
                if k >= len(self.lists):
                    continue
                c = open_.get(k)
                at = bisect_right(found, c[2]) if c and end - size - c[1] <= self.gap else len(found)
                if at < len(found):  # the chain goes on at the first place behind it
                    c[3] += found[at] - max(c[2], found[at] - size)
                    c[1], c[2] = end, found[at]
                else:
                    if c:
                        spans.append((k, c[0], c[1], c[3] / len(self.lists[k])))
                    open_[k] = [end - size, end, found[0], size]
        spans += [(k, c[0], c[1], c[3] / len(self.lists[k])) for k, c in open_.items()]
        return {"n_words": len(ws), "places": places, "spans": sorted((self.labels[k], a, b, min(1.0, x)) for k, a, b, x in spans)}


SCAN = (
    "n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, "
    "spans array<struct<label string, start long, end long, covered double>>"
)


def scan_licenses(
    docs: DataFrame, keep: list[str], text: str = "text", templates: DataFrame | list[tuple[str, str]] | None = None, phrases: dict | None = None,
    most_words: int = 1_000_000, **limits,
) -> DataFrame:
    """The kept columns and the columns of ``SCAN``: one row per row of ``docs``.

    Null and empty texts have no words, no labels and score 0; texts of any length are streamed whole. Repeated rows
    stay repeated, an empty table stays empty, and other columns may have any names; those that are kept should differ
    from the new ones. ``spans`` holds the chains that reach the covered share of a template, by start and end word;
    ``score`` is the largest share that any chain covers. ``templates`` is a table of label and text (null ones don't
    count), or a list; the driver builds the automaton, so a table of more than ``most_words`` words is refused.
    """
    if isinstance(templates, DataFrame):
        rows = templates.where("label IS NOT NULL AND text IS NOT NULL").select("label", "text")
        size = rows.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        if size > 8 * most_words:
            raise ValueError(f"templates of {size} bytes are too many for one automaton")
        templates = sorted((r["label"], r["text"]) for r in rows.collect())
    scanner = Scanner(licence_templates() if templates is None else templates, phrases or PHRASES, **limits)
    from pyspark.sql.pandas.types import to_arrow_schema

    schema = docs.select(*keep).schema
    for f in docs.sparkSession.createDataFrame([], SCAN).schema:
        schema = schema.add(f)
    arrow, added = to_arrow_schema(schema), [f.name for f in schema][len(keep) :]
    body = free_name([*keep, *added], "body")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for raw in b.column(b.num_columns - 1):
                x = scanner.scan(raw.as_py())
                places = x["places"]
                starts = [a for a, _ in places]
                base = {label for _, label in places}
                spans = [s for s in x["spans"] if s[3] >= scanner.cover]
                rows.append((
                    x["n_words"], len(places), min(starts, default=None), max(starts, default=None), sorted(base),
                    sorted(base | {s[0] for s in spans}), max((s[3] for s in x["spans"]), default=0.0),
                    [dict(zip(("label", "start", "end", "covered"), s)) for s in spans],
                ))
            cols = [b.column(i) for i in range(b.num_columns - 1)]
            cols += [pa.array([r[i] for r in rows], arrow.field(c).type) for i, c in enumerate(added)]
            yield pa.RecordBatch.from_arrays(cols, names=[*keep, *added])

    return docs.select(*keep, F.col(text).cast("binary").alias(body)).mapInArrow(run, schema)


def op8_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Base phrases, labels and score of every document; nulls, repeats, long texts and empty tables as in ``scan_licenses``."""
    found = scan_licenses(table(spark, sf_dir, "documents"), ["doc_id"])
    return found.select(
        "doc_id", "n_words", "n_base", "first_word", "last_word",
        F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score",
    )
