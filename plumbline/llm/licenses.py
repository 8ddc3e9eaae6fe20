"""Licence scan: a generalised suffix automaton over licence templates, streamed with document words.

The automaton is built once from word templates (small, a parameter) and sent to the tasks. A
document is read word by word; at each word the automaton gives the matching statistic, the length
of the longest run of words ending there that occurs in some template. Runs that end in a whole
base phrase are counted as places of that phrase; maximal long runs are chained, per template, into
spans whose covered share of the template's words decides whether its label applies.

Words that no template has reset the automaton, so only stretches of known words are streamed. A
text is one row; its state is a few integers, and nothing depends on the other rows.

Null and empty texts have no words, no places and no labels, score 0. Columns other than the id and
the text are ignored, so their names cannot clash.
"""

from __future__ import annotations

import re
from collections import defaultdict

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE_PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

#: Label to template wordings, matched in part; the usual notices of well-known public licences.
TEMPLATES = {
    "mit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files",
        "released under the mit license",
        "licensed under the mit license",
    ],
    "apache-2": [
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
        "licensed under the apache license version 2 0",
    ],
    "gpl-3": [
        "this work is licensed under the gnu general public license version 3",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license",
    ],
    "gpl-2": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license",
        "licensed under the gnu general public license version 2",
    ],
    "lgpl": ["licensed under the gnu lesser general public license"],
    "agpl-3": ["licensed under the gnu affero general public license version 3"],
    "bsd": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
        "licensed under the bsd license",
    ],
    "mpl-2": ["this source code form is subject to the terms of the mozilla public license v 2 0"],
    "cc-by-nc": [
        "licensed under cc by nc 4 0",
        "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    ],
    "cc-by-sa": [
        "licensed under cc by sa 4 0",
        "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    ],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "unlicense": ["this is free and unencumbered software released into the public domain"],
}

WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


class LicenseAutomaton:
    """A generalised suffix automaton of word ids: every run of words of every template is a path."""

    def __init__(self, base: dict[str, str] | None = None, templates: dict[str, list[str]] | None = None):
        base, templates = base or BASE_PHRASES, templates or TEMPLATES
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length = [-1], [0]
        self.ends: list[list[tuple[int, int]]] = [[]]  # (template, end) pairs that a state stands for
        self.templates = [(label, text.encode().split(), False) for label, all_ in templates.items() for text in all_]
        self.templates += [(label, text.encode().split(), True) for text, label in base.items()]
        for number, (_, words, _) in enumerate(self.templates):
            last = 0
            for i, word in enumerate(words):
                last = self._extend(last, word)
                self.ends[last].append((number, i + 1))
        for state in sorted(range(1, len(self.link)), key=lambda s: -self.length[s]):
            self.ends[self.link[state]] += self.ends[state]
        self.ends[0] = []
        #: By state: (words, label) of the base phrases that end in it, itself or through a suffix link.
        self.phrases: list[list[tuple[int, str]]] = [[] for _ in self.link]
        whole = [[] for _ in self.link]
        for number, (label, words, is_base) in enumerate(self.templates):
            if is_base:
                state = 0
                for word in words:
                    state = self.next[state][word]
                whole[state].append((len(words), label))
        for state in sorted(range(1, len(self.link)), key=lambda s: self.length[s]):
            self.phrases[state] = whole[state] + self.phrases[self.link[state]]
        self.known = frozenset(w for edges in self.next for w in edges)
        self.least = min([2, *(n for ends in self.phrases for n, _ in ends)])  # words of the shortest run worth a look

    def _new(self, length: int) -> int:
        self.next.append({})
        self.link.append(0)
        self.length.append(length)
        self.ends.append([])
        return len(self.link) - 1

    def _split(self, p: int, q: int, word: bytes) -> int:
        clone = self._new(self.length[p] + 1)
        self.next[clone] = dict(self.next[q])
        self.link[clone] = self.link[q]
        self.link[q] = clone
        while p >= 0 and self.next[p].get(word) == q:
            self.next[p][word] = clone
            p = self.link[p]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            q = self.next[last][word]
            return q if self.length[q] == self.length[last] + 1 else self._split(last, q, word)
        new = self._new(self.length[last] + 1)
        p = last
        while p >= 0 and word not in self.next[p]:
            self.next[p][word] = new
            p = self.link[p]
        if p < 0:
            return new
        q = self.next[p][word]
        self.link[new] = q if self.length[q] == self.length[p] + 1 else self._split(p, q, word)
        return new

    def statistics(self, words: list[bytes]):
        """(position, length, state) of each word that extends or restarts a match."""
        state = length = 0
        for i, word in enumerate(words):
            while state and word not in self.next[state]:
                state = self.link[state]
                length = self.length[state]
            if word in self.next[state]:
                state, length = self.next[state][word], length + 1
            yield i, length, state

    def scan(self, words: list[bytes], min_words: int = 3, min_share: float = 0.6, gap: int = 4) -> dict:
        """Base places, labels with their covered shares, and the spans that gave them."""
        known = [i for i, w in enumerate(words) if w in self.known]
        places: list[tuple[int, str]] = []
        long: list[tuple[int, int, int]] = []  # (end, length, state) of maximal runs
        at = 0
        while at < len(known):
            stop = at + 1
            while stop < len(known) and known[stop] == known[stop - 1] + 1:
                stop += 1
            begin, before = known[at], (0, 0, 0)
            if stop - at >= self.least:
                for i, length, state in self.statistics(words[begin : known[stop - 1] + 1]):
                    places += [(begin + i + 1 - n, label) for n, label in self.phrases[state] if n <= length]
                    if before[1] >= min_words and length <= before[1]:
                        long.append(before)
                    before = (begin + i + 1, length, state)
                if before[1] >= min_words:
                    long.append(before)
            at = stop
        shares, spans = self._chains(long, min_share, gap)
        return {"places": sorted(places), "shares": shares, "spans": spans}

    def _chains(self, long: list[tuple[int, int, int]], min_share: float, gap: int):
        """Per template: chain runs that keep its order in both, at most ``gap`` words apart; cover is the chain's share."""
        hits = defaultdict(list)
        for end, length, state in long:
            for number, t_end in self.ends[state]:
                hits[number].append((end - length, end, t_end - length, t_end))
        shares: dict[str, float] = {}
        spans = []
        for number, runs in hits.items():
            label, words, is_base = self.templates[number]
            if is_base:
                continue
            runs.sort()
            best: list[tuple[int, int]] = []  # (covered words, where the chain starts)
            near = 0
            for k, (d0, d1, t0, t1) in enumerate(runs):
                cover, start = t1 - t0, d0
                while runs[near][0] < d0 - gap - len(words):  # too far back to reach this run
                    near += 1
                for j in range(near, k):
                    e0, e1, u0, u1 = runs[j]
                    skip = max(0, e1 - d0, u1 - t0)
                    if e0 < d0 and e1 < d1 and u0 < t0 and u1 < t1 and d0 - e1 <= gap and t0 - u1 <= gap and best[j][0] + t1 - t0 - skip > cover:
                        cover, start = best[j][0] + t1 - t0 - skip, best[j][1]
                best.append((cover, start))
                share = min(1.0, cover / len(words))
                if share >= min_share and cover >= 4:
                    spans.append((label, start, d1, share))
                    shares[label] = max(shares.get(label, 0.0), share)
        return shares, spans


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", base: dict | None = None, templates: dict | None = None, min_words: int = 3, min_share: float = 0.6) -> DataFrame:
    """One row per document: words, base places, labels, score, and the covered spans with their labels.

    ``score`` is the largest covered share of a template, 1 where a base phrase stands whole.
    Repeated rows give repeated results.
    """
    automaton = LicenseAutomaton(base, templates)
    kind = docs.schema[id_col].dataType.simpleString()
    out = pa.schema([("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("label", pa.string()), ("start", pa.int64()), ("stop", pa.int64()), ("share", pa.float64())])))])

    def one(text: bytes) -> dict:
        words = WORD.findall(text.lower())
        found = automaton.scan(words, min_words, min_share)
        places, shares = found["places"], found["shares"]
        own = {label for _, label in places}
        return {
            "n_words": len(words), "n_base": len(places), "first_word": places[0][0] if places else None, "last_word": places[-1][0] if places else None,
            "base_labels": ",".join(sorted(own)), "labels": ",".join(sorted(own | set(shares))), "score": 1.0 if own else max(shares.values(), default=0.0),
            "spans": [{"label": a, "start": b, "stop": c, "share": d} for a, b, c, d in found["spans"]],
        }

    def run(batches):
        for batch in batches:
            rows = [one(x or b"") for x in batch.column(1).cast(pa.binary()).to_pylist()]
            columns = [pa.array([r[f.name] for r in rows], f.type) for f in out]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names=["id", *out.names])

    scanned = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text")).mapInArrow(
        run, f"id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<label:string,start:long,stop:long,share:double>>"
    )
    return scanned.withColumnRenamed("id", id_col)


def query(spark, sf_dir: str) -> DataFrame:
    """op1: every document's licence digest."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return scan_licenses(docs).drop("spans")
