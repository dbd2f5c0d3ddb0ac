"""Licence scan by a positional index of rare licence words.

Templates are licence notices, each with mandatory key phrases.  The words of all templates get an inverse document
frequency over the templates; a template's ``RARE`` words of highest frequency weight (ties by the word) are its
postings, with their positions.  A file's words are looked up in them; each hit votes for the template starting at
(position in the file - position in the template).  A start with at least ``min(VOTES, rare words of the template)``
votes is aligned word by word: the mandatory phrases must stand in full at their places, and at least ``LEAST`` of the
template's words must match.  Every such occurrence is a row; where occurrences of several templates start and end within
one another, all are given.

Nulls: a null, empty or wordless text has no rows.  A null id stays null, repeated rows are scanned each by itself, an
empty table gives an empty result; other columns are not read.  A text that holds a notice many times has a row each.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from ._shared import documents, small_batches, table
from ._text import WORD_SQL, Words, blocks, hash_words

RARE, VOTES, LEAST = 4, 2, 0.8
SCHEMA = "doc_id bigint, licence string, start_word int, end_word int, matched int, score double"

#: name: (notice, mandatory phrases)
TEMPLATES: dict[str, tuple[str, tuple[str, ...]]] = {
    "Apache-2.0": ("Licensed under the Apache License, Version 2.0", ("Apache License Version 2 0",)),
    "Apache-1.1": ("Licensed under the Apache Software License, Version 1.1", ("Apache Software License Version 1 1",)),
    "MIT": ("Released under the MIT License", ("MIT License",)),
    "MIT-grant": (
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        ("hereby granted free of charge", "copy of this software"),
    ),
    "ISC": (
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        ("copy modify and or distribute this software", "with or without fee"),
    ),
    "GPL-2.0": ("This work is licensed under the GNU General Public License, version 2", ("GNU General Public License version 2",)),
    "GPL-3.0": ("This work is licensed under the GNU General Public License, version 3", ("GNU General Public License version 3",)),
    "LGPL-2.1": ("This work is licensed under the GNU Lesser General Public License, version 2.1", ("GNU Lesser General Public License version 2 1",)),
    "LGPL-3.0": ("This work is licensed under the GNU Lesser General Public License, version 3", ("GNU Lesser General Public License version 3",)),
    "AGPL-3.0": ("This work is licensed under the GNU Affero General Public License, version 3", ("GNU Affero General Public License version 3",)),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        ("Mozilla Public License v 2 0",),
    ),
    "BSD-clauses": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        ("source and binary forms", "following conditions are met"),
    ),
    "EPL-2.0": ("made available under the terms of the Eclipse Public License 2.0", ("Eclipse Public License 2 0",)),
    "Unlicense": ("This is free and unencumbered software released into the public domain", ("unencumbered software", "public domain")),
    "CC0-1.0": ("Licensed under CC0 1.0 Universal", ("CC0 1 0 Universal",)),
    "CC-BY-4.0": ("Licensed under CC BY 4.0", ("CC BY 4 0",)),
    "CC-BY-SA-4.0": ("Licensed under CC BY-SA 4.0", ("CC BY SA 4 0",)),
    "CC-BY-NC-4.0": ("Licensed under CC BY-NC 4.0", ("CC BY NC 4 0",)),
    "CC-BY-ND-4.0": ("Licensed under CC BY-ND 4.0", ("CC BY ND 4 0",)),
    "CC-BY-NC-SA-4.0": ("Licensed under CC BY-NC-SA 4.0", ("CC BY NC SA 4 0",)),
    "CC-BY-NC-ND-4.0": ("Licensed under CC BY-NC-ND 4.0", ("CC BY NC ND 4 0",)),
}


def words_of(text: str) -> list[str]:
    return re.findall("[0-9a-z\x80-\U0010ffff]+", text.lower())


class Index:
    """Postings of the templates: ``postings`` (word, template, position), ``words`` and ``must`` by template."""

    def __init__(self, templates: dict[str, tuple[str, tuple[str, ...]]]):
        self.names = sorted(templates)
        self.words = [words_of(templates[n][0]) for n in self.names]
        self.must: list[list[int]] = []
        for name, words in zip(self.names, self.words):
            places: set[int] = set()
            for phrase in templates[name][1]:
                p = words_of(phrase)
                at = next((i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p), None)
                if at is None or not p:
                    raise ValueError(f"{name}: its phrase {phrase!r} isn't in its notice")
                places |= set(range(at, at + len(p)))
            self.must.append(sorted(places))
        df = Counter(w for words in self.words for w in set(words))
        self.idf = {w: math.log(len(self.words) / n) for w, n in df.items()}
        self.postings: list[tuple[str, int, int]] = []
        self.votes: list[int] = []
        for t, words in enumerate(self.words):
            rare = sorted(set(words), key=lambda w: (-self.idf[w], w))[:RARE]
            self.postings += [(w, t, p) for p, w in enumerate(words) if w in rare]
            self.votes.append(min(VOTES, len(rare)))
        keys = sorted({w for w, _, _ in self.postings})
        by = dict(zip(keys, hash_words(keys).tolist()))
        places = defaultdict(list)
        for w, t, p in self.postings:
            places[by[w]].append((t, p))
        self.places = dict(places)
        self.sorted = np.sort(np.array(list(by.values()), np.uint64))
        self.template_hashes = [hash_words(w) for w in self.words]
        self.table = np.zeros(1 << 16, bool)  # first look: by the hash's top 16 bits
        self.table[(self.sorted >> np.uint64(48)).astype(np.int64)] = True

    def scan(self, h: np.ndarray, hits: np.ndarray) -> list[tuple[int, int, int]]:
        """(template, start, words that match) in a file's word hashes; ``hits`` are its rare words' places."""
        votes: Counter = Counter()
        for p in hits.tolist():
            for t, q in self.places[int(h[p])]:
                votes[t, p - q] += 1
        out = []
        for (t, start), n in votes.items():
            own = self.template_hashes[t]
            if n < self.votes[t] or start < 0 or start + len(own) > len(h):
                continue
            same = h[start : start + len(own)] == own
            if same[self.must[t]].all() and same.sum() >= LEAST * len(own) - 1e-9:
                out.append((t, start, int(same.sum())))
        return out


def _scan(templates):
    def run(batches):
        index = Index(templates)
        for batch in blocks(batches):
            w = Words(batch.column("text"))
            maybe = np.flatnonzero(index.table[(w.hash >> np.uint64(48)).astype(np.int64)])
            at = np.minimum(np.searchsorted(index.sorted, w.hash[maybe]), len(index.sorted) - 1)
            hits = maybe[index.sorted[at] == w.hash[maybe]]
            doc = np.searchsorted(w.first, hits, "right") - 1
            rows = []
            for d in np.unique(doc):
                own = hits[doc == d] if len(doc) < 1000 else hits[np.searchsorted(doc, d) : np.searchsorted(doc, d, "right")]
                a, b = w.first[d], w.first[d + 1]
                rows += [(d, index.names[t], s, s + len(index.words[t]), n, n / len(index.words[t])) for t, s, n in index.scan(w.hash[a:b], own - a)]
            if rows:
                d, name, s, e, n, score = zip(*rows)
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").take(pa.array(d)), pa.array(name), *(pa.array(x, pa.int32()) for x in (s, e, n)), pa.array(score)],
                    ["doc_id", "licence", "start_word", "end_word", "matched", "score"],
                )

    return run


def scan_licences(docs: DataFrame, templates: dict[str, tuple[str, tuple[str, ...]]] | None = None) -> DataFrame:
    """(doc_id, licence, start_word, end_word, matched, score); see the module's text."""
    small_batches(docs.sparkSession)
    return documents(docs).mapInArrow(_scan(templates or TEMPLATES), SCHEMA)


def op7_licence_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licences(table(spark, sf_dir, "documents"))


def _sql() -> str:
    index = Index(TEMPLATES)
    postings = ", ".join(f"('{w}', {t}, {p})" for w, t, p in index.postings)
    words = ", ".join(f"({t}, {p}, '{w}', {str(p in index.must[t]).lower()})" for t, own in enumerate(index.words) for p, w in enumerate(own))
    names = ", ".join(f"({t}, '{n}', {index.votes[t]}, {len(index.words[t])})" for t, n in enumerate(index.names))
    return f"""
WITH postings(w, t, p) AS (VALUES {postings}), words(t, p, w, must) AS (VALUES {words}), names(t, licence, votes, size) AS (VALUES {names}),
d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(lower(text), '{WORD_SQL}') AS ws FROM documents),
f AS (SELECT r, unnest(ws) AS w, generate_subscripts(ws, 1) - 1 AS pos FROM d),
v0 AS (SELECT r, t, pos - p AS start, count(*) AS n FROM f JOIN postings USING (w) GROUP BY ALL),
v AS (SELECT r, t, start FROM v0 JOIN names USING (t) WHERE n >= votes),
c AS (SELECT v.r, v.t, v.start, count(*) FILTER (f.w = words.w) AS matched, bool_and(f.w = words.w OR NOT must) AS whole, count(f.w) AS there
      FROM v JOIN words ON words.t = v.t LEFT JOIN f ON f.r = v.r AND f.pos = v.start + words.p WHERE v.start >= 0 GROUP BY ALL)
SELECT doc_id, licence, CAST(start AS INT) AS start_word, CAST(start + size AS INT) AS end_word, CAST(matched AS INT) AS matched, matched / size AS score
FROM c JOIN names USING (t) JOIN d USING (r) WHERE whole AND there = size AND matched >= {LEAST} * size - 1e-9"""


SQL = {"op7_licence_scan": _sql()}
