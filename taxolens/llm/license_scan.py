"""License scans: phrase places and an exact set-similarity join with license templates.

Words are runs of 0-9, a-z (A-Z lower-cased) and non-ASCII characters. The base finds the places where a phrase's
words stand consecutively. The join finds every text block (a line) that holds at least ``THETA`` of a template's
distinct words. Tokens are ordered by their frequency over the whole corpus, rarest first; a block that meets the
threshold of a template of t words shares one of its t - ceil(THETA t) + 1 rarest words (prefix filter), has at least
ceil(THETA t) distinct template words (length filter), and enough words after the first shared one on both sides
(positional filter). What passes the filters is compared exactly, so the join loses and adds nothing.

The templates are a fixed set; only counts of their words travel. Defined cases: a null text is empty; an empty text
has no words, labels '' and score 0; a phrase may overlap another, each place counts; null ids keep their row; other
columns are unread.
"""

from __future__ import annotations

import math
from collections import Counter

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from taxolens.llm.common import ascii_words, whole_text

THETA = 0.8

#: Phrases of the base and their labels.
PHRASES = (
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
)

#: License notices (their public wording) and their labels.
TEMPLATES = (
    ("Licensed under the Apache License, Version 2.0", "Apache-2.0"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is "
     "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND", "Apache-2.0"),
    ("Released under the MIT License", "MIT"),
    ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
     "documentation files", "MIT"),
    ("This work is licensed under the GNU General Public License, version 3", "GPL-3.0"),
    ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
     "Public License as published by the Free Software Foundation", "GPL"),
    ("GNU Lesser General Public License as published by the Free Software Foundation", "LGPL"),
    ("Licensed under CC BY-NC 4.0", "CC-BY-NC-4.0"),
    ("This work is licensed under a Creative Commons Attribution 4.0 International License", "CC-BY-4.0"),
    ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
     "the following conditions are met", "BSD"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
     "granted", "ISC"),
    ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "MPL-2.0"),
    ("This is free and unencumbered software released into the public domain", "Unlicense"),
    ("All rights reserved", "all-rights-reserved"),
)


def template_words(templates=TEMPLATES) -> list[tuple[frozenset[bytes], str]]:
    return [(frozenset(ascii_words(t)), label) for t, label in templates]


def least(size: int, theta: float = THETA) -> int:
    """Fewest words of a template of ``size`` words that meet the threshold."""
    return max(1, math.ceil(theta * size - 1e-9))


def word_counts(docs: DataFrame, vocabulary: set[bytes], text_col: str = "text") -> dict[bytes, int]:
    """Occurrences of the given words over all texts (a bounded table from each task)."""
    def run(batches):
        n: Counter = Counter()
        for pdf in batches:
            for t in pdf[text_col]:
                n.update(w for w in ascii_words(t) if w in vocabulary)
        if n:
            yield pd.DataFrame({"w": [w.decode() for w in n], "n": list(n.values())})

    got = (docs.select(whole_text(text_col)).mapInPandas(run, "w string, n long")
           .groupBy("w").agg(F.sum("n").alias("n")).collect())
    return {r["w"].encode(): r["n"] for r in got}


class TemplateIndex:
    """Templates as word lists in global order (rarest first) with an inverted index of their prefixes."""

    def __init__(self, templates, counts: dict[bytes, int], theta: float = THETA):
        self.theta = theta
        words = sorted({w for t, _ in templates for w in t}, key=lambda w: (counts.get(w, 0), w))
        self.rank = {w: k for k, w in enumerate(words)}
        self.templates = [(sorted(self.rank[w] for w in t), label) for t, label in templates]
        self.prefix: dict[int, list[tuple[int, int]]] = {}
        for k, (t, _) in enumerate(self.templates):
            for i in range(len(t) - least(len(t), theta) + 1):
                self.prefix.setdefault(t[i], []).append((k, i))
        self.rare = {w for w, r in self.rank.items() if r in self.prefix}

    def join(self, block: list[bytes]) -> list[tuple[str, float]]:
        """Labels and containments of the templates that a block meets."""
        mine = sorted({self.rank[w] for w in block if w in self.rank})
        out, seen = [], set()
        for j, r in enumerate(mine):
            for k, i in self.prefix.get(r, ()):
                t, label = self.templates[k]
                need = least(len(t), self.theta)
                if k in seen or len(mine) < need or 1 + min(len(t) - i - 1, len(mine) - j - 1) < need:
                    continue
                seen.add(k)
                shared = len(set(mine).intersection(t))
                if shared >= need:
                    out.append((label, shared / len(t)))
        return out


def phrase_places(words: list[bytes], phrases) -> list[tuple[int, str]]:
    """``(first word, label)`` of every place where a phrase's words stand consecutively."""
    line = b" " + b" ".join(words) + b" "
    out = []
    for phrase, label in phrases:
        at = line.find(phrase)
        while at >= 0:
            out.append((line.count(b" ", 0, at + 1) - 1, label))
            at = line.find(phrase, at + 1)
    return out


def scan(docs: DataFrame, templates=TEMPLATES, phrases=PHRASES, theta: float = THETA, id_col: str = "doc_id",
         text_col: str = "text") -> DataFrame:
    """``doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score`` of every document.

    ``score`` is 1 if a phrase stands in the text, else the largest containment of a template that a block meets, or 0.
    """
    sets = template_words(templates)
    index = TemplateIndex(sets, word_counts(docs, {w for t, _ in sets for w in t}, text_col), theta)
    shared = docs.sparkSession.sparkContext.broadcast(index)
    wanted = [(b" " + b" ".join(ascii_words(p)) + b" ", label) for p, label in phrases]
    heads = {p.split()[0] for p, _ in wanted}

    def run(batches):
        ix = shared.value
        for pdf in batches:
            rows = []
            for d, text in zip(pdf["doc_id"], pdf["text"]):
                words = ascii_words(text)
                places = [] if heads.isdisjoint(words) else phrase_places(words, wanted)
                met: list[tuple[str, float]] = []
                if not ix.rare.isdisjoint(words):
                    for line in text.split("\n"):
                        met += ix.join(ascii_words(line))
                base = sorted({x for _, x in places})
                rows.append((d, len(words), len(places), min((p for p, _ in places), default=None),
                             max((p for p, _ in places), default=None), ",".join(base),
                             ",".join(sorted({*base, *(x for x, _ in met)})),
                             1.0 if places else max((c for _, c in met), default=0.0)))
            out = pd.DataFrame(rows, columns=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels",
                                              "labels", "score"])
            for c in ("first_word", "last_word"):
                out[c] = pd.array([None if v is None or np.isnan(v) else int(v) for v in out[c]], dtype="Int64")
            yield out

    src = docs.select(F.col(id_col).cast("long").alias("doc_id"), whole_text(text_col).alias("text"))
    return src.mapInPandas(run, "doc_id long, n_words long, n_base long, first_word long, last_word long, "
                                "base_labels string, labels string, score double")


def scan_sql(templates=TEMPLATES, phrases=PHRASES, theta: float = THETA) -> str:
    """DuckDB SQL for the rows of :func:`scan` over ``documents``."""
    word = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

    def words(text: str) -> str:
        return "[" + ", ".join("'" + w.decode() + "'" for w in ascii_words(text)) + "]"

    places = " || ".join(
        f"list_transform(list_filter(range(0, len(ws) - {len(p.split()) - 1}), "
        f"lambda i: ws[i + 1:i + {len(p.split())}] = {words(p)}), lambda i: {{'at': i, 'label': '{label}'}})"
        for p, label in phrases)
    values = ", ".join(f"(list_distinct({words(t)}), '{label}', {least(len(set(ascii_words(t))), theta)})"
                       for t, label in templates)
    return f"""
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t
           FROM documents),
w AS (SELECT doc_id, t, regexp_extract_all(t, {word}) AS ws FROM d),
b AS (SELECT doc_id, t, len(ws) AS n_words, {places} AS places FROM w),
lines AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split(t, chr(10))), {word})) AS toks FROM d),
templates(toks, label, need) AS (VALUES {values}),
met AS (SELECT l.doc_id, m.label, len(list_intersect(l.toks, m.toks)) / len(m.toks) AS share
        FROM lines l, templates m WHERE len(list_intersect(l.toks, m.toks)) >= m.need),
labels AS (SELECT doc_id, list(label) AS labels, max(share) AS share FROM met GROUP BY doc_id)
SELECT b.doc_id, n_words::BIGINT AS n_words, len(places)::BIGINT AS n_base,
       list_min(list_transform(places, lambda p: p.at))::BIGINT AS first_word,
       list_max(list_transform(places, lambda p: p.at))::BIGINT AS last_word,
       array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label))), ',') AS base_labels,
       array_to_string(list_sort(list_distinct(list_transform(places, lambda p: p.label) || coalesce(l.labels, []))), ',')
           AS labels,
       CASE WHEN len(places) > 0 THEN 1.0 ELSE coalesce(l.share, 0.0) END::DOUBLE AS score
FROM b LEFT JOIN labels l ON l.doc_id = b.doc_id"""
