"""License notices in word windows, by an exact set-similarity join with templates."""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .common import rows_of, table, words

#: Phrases whose every place counts, with their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices, with their labels.
TEMPLATES = [
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "Licensed under the Apache License, Version 2.0."),
    ("gpl", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("lgpl", "This library is licensed under the GNU Lesser General Public License."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License."),
    ("cc-by", "Licensed under CC BY 4.0."),
    ("cc-by-sa", "Licensed under CC BY-SA 4.0."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nd", "Licensed under CC BY-ND 4.0."),
    ("cc0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("reserved", "All rights reserved."),
]
CONTAINMENT = 0.9


def template_sets(templates: list[tuple[str, str]]) -> list[tuple[str, frozenset[bytes]]]:
    return [(label, frozenset(words(t.encode()))) for label, t in templates if words(t.encode())]


def token_counts(docs: DataFrame, templates: list[tuple[str, str]], *, text: str = "text") -> dict[bytes, int]:
    """In how many texts of the whole table each template word stands. The
    result has a row for each word of the templates at most."""
    vocab = frozenset().union(*[s for _, s in template_sets(templates)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in rows_of(batches):
            for t in batch.column(0):
                seen.update(vocab.intersection(words(t.as_py())))
        if seen:
            yield pa.RecordBatch.from_arrays([pa.array([w.decode() for w in seen], pa.string()), pa.array(seen.values(), pa.int64())], names=["w", "n"])

    src = docs.select(F.col(text).cast("binary").alias("t")).where("t is not null")
    counted = src.mapInArrow(run, "w string, n bigint").groupBy("w").agg(F.sum("n").alias("n"))
    return {r.w.encode(): r.n for r in counted.collect()}


class TemplateIndex:
    """Finds the templates that windows of a text contain by at least ``least``.

    A block is a window over the words of the whole text, line ends ignored, as
    long as a text can be of which the template is ``least``: its length in words
    over ``least``. Every place of a window is compared.

    Words are ordered from rare to common in the whole corpus. A template of n
    words that a window contains has an overlap of at least m = ceil(least * n),
    with the window and so with the text. The text then has one of the template's
    n - m + 1 rarest words (prefix), m words of templates at all (length), and
    after the first common word each side still has enough words (position). For
    what passes, windows slide over the places of the template's words.
    """

    def __init__(self, templates: list[tuple[str, str]], counts: dict[bytes, int], least: float):
        sets = template_sets(templates)
        every = sorted(frozenset().union(*[s for _, s in sets]), key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: i for i, w in enumerate(every)}
        self.vocab = frozenset(every)
        self.sets = [(label, s, math.ceil(least * len(s) - 1e-9)) for label, s in sets]
        self.width = [math.ceil(len(ws) / least - 1e-9) for _, t in templates if (ws := words(t.encode()))]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}
        for k, (_, s, m) in enumerate(self.sets):
            for at, w in enumerate(sorted(s, key=self.rank.get)[:len(s) - m + 1]):
                self.prefix.setdefault(w, []).append((k, at))
        self.fewest = min((m for _, _, m in self.sets), default=1)

    def candidates(self, distinct: set[bytes]) -> list[int]:
        """Templates that the words of a text contain, wherever they stand."""
        mine = self.vocab & distinct
        if len(mine) < self.fewest or self.prefix.keys().isdisjoint(mine):
            return []
        found, seen = [], set()
        ordered = sorted(mine, key=self.rank.get)
        for j, w in enumerate(ordered):
            for k, at in self.prefix.get(w, ()):
                if k in seen:
                    continue
                seen.add(k)
                _, s, m = self.sets[k]
                if min(len(s) - at, len(ordered) - j) >= m and len(s & mine) >= m:
                    found.append(k)
        return sorted(found)

    def spans(self, k: int, at: list[tuple[int, bytes]]) -> list[tuple[int, int, int]]:
        """(first word, last word, overlap) of windows of template k, given the
        places of its words in a text: the best first, then the shortest, then the
        foremost, each clear of those before it."""
        _, _, m = self.sets[k]
        hits, have, left = [], {}, 0
        for i, w in at:
            have[w] = have.get(w, 0) + 1
            # what is too far, or stands again later in the window, leaves
            while i - at[left][0] >= self.width[k] or have[at[left][1]] > 1:
                old = at[left][1]
                have[old] -= 1
                if not have[old]:
                    del have[old]
                left += 1
            if len(have) >= m:
                hits.append((-len(have), i - at[left][0], at[left][0]))
        out, taken = [], set()
        for n, long, first in sorted(hits):
            if taken.isdisjoint(range(first, first + long + 1)):
                taken.update(range(first, first + long + 1))
                out.append((first, first + long, -n))
        return sorted(out)

    def matches(self, ws: list[bytes], distinct: set[bytes]) -> list[dict]:
        """All matches in the words of a text, ``block`` the first word of each.
        ``within`` marks those whose words all belong to matches of larger
        templates with theirs as a part: those name the license."""
        found = self.candidates(distinct)
        if not found:
            return []
        wanted = frozenset().union(*[self.sets[k][1] for k in found])
        at = [(i, w) for i, w in enumerate(ws) if w in wanted]
        spans = {k: self.spans(k, [x for x in at if x[1] in self.sets[k][1]]) for k in found}
        out = []
        for k in found:
            _, s, _ = self.sets[k]
            larger = {i for j in found if s < self.sets[j][1] for lo, hi, _ in spans[j] for i in range(lo, hi + 1)}
            out += [{"block": lo, "template": k, "containment": n / len(s), "within": larger.issuperset(range(lo, hi + 1))} for lo, hi, n in spans[k]]
        return out


def places(ws: list[bytes], phrases: list[tuple[list[bytes], str]]) -> tuple[list[int], set[str]]:
    """Starts of all places of the phrases, and their labels."""
    starts, labels = [], set()
    for phrase, label in phrases:
        last, n, at = phrase[-1], len(phrase), 0
        while True:
            try:
                at = ws.index(last, at) + 1
            except ValueError:
                break
            if at >= n and ws[at - n:at] == phrase:
                starts.append(at - n)
                labels.add(label)
    return starts, labels


def scan(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, least: float = CONTAINMENT) -> DataFrame:
    """Per row: doc_id, n_words, n_base, first_word, last_word, base_labels,
    labels, score, and matches: (block, template, containment, within) for windows
    over the words of the whole text, line ends or not, whose containment of a
    template is at least ``least``; block is the first word. Matches of a template
    do not overlap. A match within larger templates' matches gives no label.

    n_base counts all places of the phrases in the whole text, line ends or not.
    score is the largest containment found, or 1 where a phrase stands. Null and
    empty texts have no words, places or labels, and score 0. Repeated rows are
    scanned each; no rows give none.

    Templates are a stated list and go to every task; texts stream past them.
    """
    sets = template_sets(templates)
    counts = token_counts(docs, templates, text=text)
    spoken = [(words(p.encode()), label) for p, label in phrases.items()]
    ends = {p[-1] for p, _ in spoken}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = TemplateIndex(templates, counts, least)
        for batch in rows_of(batches):
            out = []
            for t in batch.column(1):
                t = t.as_py() or b""
                ws = words(t)
                distinct = set(ws)
                starts, base = places(ws, spoken) if not ends.isdisjoint(distinct) else ([], set())
                found = index.matches(ws, distinct)
                labels = base | {sets[m["template"]][0] for m in found if not m["within"]}
                score = 1.0 if starts else max((m["containment"] for m in found), default=0.0)
                out.append((len(ws), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, found))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct({"block": pa.int64(), "template": pa.int64(), "containment": pa.float64(), "within": pa.bool_()}))]
            cols = [pa.array(list(c), k) for c, k in zip(zip(*out), kinds, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), *cols], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    src = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).cast("binary").alias("t"))
    kind = docs.schema[doc_id].dataType.simpleString()
    return src.mapInArrow(run, f"doc_id {kind}, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double, matches array<struct<block:bigint,template:bigint,containment:double,within:boolean>>")


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents")).drop("matches")
