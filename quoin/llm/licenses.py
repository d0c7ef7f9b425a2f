"""Licence scans with a positional index of rare tokens.

A-Z are lower-cased; words are runs of digits, a-z and characters beyond ASCII. Each template (a licence notice, or a base phrase) is indexed by its RARE words of
highest IDF, where document frequencies of the templates' words are counted over all documents. A file's words are looked up; each hit votes for the template at a start
(its position less the word's in the template); where votes agree, the template's words are compared at their relative positions and a mandatory key phrase has to stand at its
place; other words of a notice may be SLACK places off. A label holds if a place covers enough of the template. The base phrases are templates of themselves, and are found at all their places.

Null and empty texts have no words and no labels. Rows are handled one by one, so ids may be null or repeated. Only doc_id and text are read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quoin.llm.license_texts import TEXTS
from quoin.runtime import arrow_limits

#: Phrases and labels that are always reported.
BASE = [("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved")]
#: Notices in public use: label, mandatory key phrase, text.
NOTICES = [
    ("apache-2.0", "apache license", "Licensed under the Apache License, Version 2.0"),
    ("apache-2.0", "apache license", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("mit", "mit license", "Released under the MIT License"),
    ("mit", "permission is hereby granted", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction"),
    ("gpl", "general public license", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("gpl-3.0", "general public license version 3", "licensed under the GNU General Public License, version 3"),
    ("cc-by", "creative commons attribution", "This work is licensed under a Creative Commons Attribution 4.0 International License"),
    ("cc-by-nc", "cc by nc", "Licensed under CC BY-NC 4.0"),
    ("cc-by-sa", "cc by sa", "Licensed under CC BY-SA 4.0"),
    ("bsd", "redistribution and use", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2.0", "mozilla public license", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("unlicense", "public domain", "This is free and unencumbered software released into the public domain"),
]
ALL = NOTICES + TEXTS
Templates = list[tuple[str, str, str]]
RARE, COVER, SLACK = 8, 0.6, 3
_WORDS = bytes(b if 48 <= b <= 57 or 97 <= b <= 122 or b > 127 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def words(text: bytes | None) -> list[bytes]:
    return (text or b"").translate(_WORDS).split()


class Index:
    """Templates and the postings of their rarest words."""

    def __init__(self, df: dict[bytes, int], n: int, templates: Templates):
        own = [(label, words(t.encode()), words(k.encode()), COVER) for label, k, t in templates]
        self.templates = [(label, words(p.encode()), words(p.encode()), 1.0) for p, label in BASE] + [t for t in own if t[1]]
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for _, t, _, _ in self.templates for w in t}
        self.need = []
        for i, (_, t, key, _) in enumerate(self.templates):
            rare = sorted(set(t), key=lambda w: (-self.idf[w], w))[:RARE]
            for at, w in enumerate(t):
                if w in rare:
                    self.postings[w].append((i, at))
            self.need.append(_key_at(t, key))

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, str]], set[str], float]:
        """Places of base phrases as (word, label), labels, best coverage by IDF."""
        hits = self.postings.keys() & set(ws)
        if not hits:
            return [], set(), 0.0
        votes: Counter = Counter()
        for at, w in enumerate(ws):
            if w in hits:
                for i, own in self.postings[w]:
                    votes[i, at - own] += 1
        base, labels, score = [], set(), 0.0
        for (i, start), _ in votes.items():
            label, t, key, cover = self.templates[i]
            at = self.need[i]
            if start + at < 0 or ws[start + at : start + at + len(key)] != key:
                continue
            slack = 0 if i < len(BASE) else SLACK
            found = sum(self.idf[w] for j, w in enumerate(t) if w in ws[max(0, start + j - slack) : max(0, start + j + slack + 1)]) / sum(self.idf[w] for w in t)
            if found + 1e-9 >= cover:
                labels.add(label)
                score = max(score, min(1.0, found))
                if i < len(BASE):
                    base.append((start, label))
        return base, labels, score


def _key_at(t: list[bytes], key: list[bytes]) -> int:
    """Where a template's words have its key phrase; without it nothing could be verified, so such a template is refused."""
    at = next((i for i in range(len(t)) if t[i : i + len(key)] == key), None) if key else None
    if at is None:
        raise ValueError(f"the key phrase {b' '.join(key)!r} doesn't stand in its template {b' '.join(t[:8])!r}")
    return at


def frequencies(docs: DataFrame, templates: Templates = ALL) -> tuple[dict[bytes, int], int]:
    """Document frequencies of the templates' words over all documents, and the number of documents."""
    vocabulary = {w for p in [b[0] for b in BASE] + [t for _, _, t in templates] for w in words(p.encode())}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: Counter = Counter()
        for batch in batches:
            seen[b""] += batch.num_rows
            for text in batch.column(0):
                seen.update(vocabulary.intersection((text.as_py() or b"").translate(_WORDS).split()))
        yield pa.RecordBatch.from_pydict({"word": pa.array(seen.keys(), pa.binary()), "n": pa.array(seen.values(), pa.int64())})

    got = docs.select(F.col("text").cast("binary")).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    df = {bytes(r["word"]): r["n"] for r in got}
    return df, df.pop(b"", 0)


_SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64())])


def _scan(df: dict[bytes, int], n: int, templates: Templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(df, n, templates)
        for batch in batches:
            out: tuple[list, ...] = tuple([] for _ in _SCHEMA)
            for doc, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ws = words(text.as_py())
                base, labels, score = index.scan(ws)
                row = (doc, len(ws), len(base), min((p for p, _ in base), default=None), max((p for p, _ in base), default=None), ",".join(sorted({x for _, x in base})), ",".join(sorted(labels)), score)
                for c, v in zip(out, row, strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(out, _SCHEMA, strict=True)], schema=_SCHEMA)

    return run


def licenses(docs: DataFrame, templates: Templates = ALL) -> DataFrame:
    """n_words, n_base, first_word, last_word, base_labels, labels and score of every row.

    templates (label, mandatory key phrase, text) are control data that every worker holds: notices, whole short licence texts and the opening of long ones unless others are given. The base phrases are always looked for.
    A template whose key phrase isn't a run of its own words is refused (ValueError); one without words is left out. Very long texts are scanned whole, and an empty table gives no rows.
    """
    for _, key, text in templates:
        if t := words(text.encode()):
            _key_at(t, words(key.encode()))
    arrow_limits(docs.sparkSession)
    df, n = frequencies(docs, templates)
    schema = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text")).mapInArrow(_scan(df, n, templates), schema)
