r"""Licence scans by a positional index of rare template words.

The templates are short: notices and the opening terms of well-known licences. For each of
their words the document frequency over all documents is counted (one row a word reaches the
driver), which gives the words' IDF. A document's rarest licence words are looked up in the
templates' postings (template, position); each of their places proposes where the template would
start in the document, and places that propose the same start, give or take ``SLACK`` words, are
intersected. A template is reported where its rarest words agree on a start in a share of at
least ``COVER`` by IDF and its mandatory key phrases stand near that start.

Base places come beside these: wherever the words of a base phrase stand consecutively. Words
are runs outside \x00-\x2F, \x3A-\x60, \x7B-\x7F after lower-casing A-Z.

Defined cases: null and empty texts have no words (n_* 0, no labels, score 0); texts are scanned
whole; repeated rows each get their result; places overlap freely and all count; an empty
table gives an empty table; other columns pass through, added names that clash get a leading underscore.
score is the best share by which a reported template was covered, at least 0.5 with a base place, else 0.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import fresh, small_batches, table

BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Label, template, key phrases that must stand in it.
TEMPLATES = (
    ("mit", "released under the mit license", ("mit license",)),
    ("mit", "licensed under the mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("with or without fee is hereby granted",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("bsd", "released under the bsd license", ("bsd license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("gpl", "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("gnu general public license",)),
    ("lgpl", "under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights", ("waived all copyright and related",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)
RAREST, COVER, SLACK = 6, 0.7, 2
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))
VOCABULARY = frozenset(w.encode() for _, text, _ in TEMPLATES for w in text.split()) | frozenset(w.encode() for text, _ in BASE for w in text.split())


def words(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TABLE).split() if text else []


def frequencies(docs: DataFrame, text: str) -> tuple[dict[bytes, int], int]:
    """In how many documents each licence word stands, over all documents; and how many there are."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found, n = Counter(), 0
        for batch in batches:
            for t in batch.column(0).to_pylist():
                found.update(VOCABULARY.intersection(words(t)))
                n += 1
        found[b""] = n
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], names=["word", "n"])

    rows = docs.select(text).mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    got = {bytes(r["word"]): r["n"] for r in rows}
    return got, got.pop(b"", 0)


class Index:
    """Postings of the templates' rarest words."""

    def __init__(self, df: dict[bytes, int], n: int):
        self.idf = {w: math.log((n + 1) / (df.get(w, 0) + 1)) + 1 for w in VOCABULARY}
        self.base = [(tuple(w.encode() for w in text.split()), label) for text, label in BASE]
        self.templates = []
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        for i, (label, text, keys) in enumerate(TEMPLATES):
            tokens = [w.encode() for w in text.split()]
            rare = sorted(range(len(tokens)), key=lambda p: (-self.idf[tokens[p]], p))[:RAREST]
            for p in rare:
                self.postings.setdefault(tokens[p], []).append((i, p))
            self.templates.append((label, len(tokens), {p: self.idf[tokens[p]] for p in rare}, [tuple(w.encode() for w in k.split()) for k in keys]))
        self.wanted = VOCABULARY

    def scan(self, tokens: list[bytes]) -> tuple[list[tuple[int, str]], set[str], float]:
        """Base places (start, label), labels of templates, and the best coverage."""
        here = self.wanted.intersection(tokens)
        if len(here) < 2:
            return [], set(), 0.0
        at: dict[bytes, list[int]] = {w: [] for w in here}
        for i, w in enumerate(tokens):
            if w in here:
                at[w].append(i)

        def phrase(words: tuple[bytes, ...]) -> list[int]:
            if not here.issuperset(words):
                return []
            return [i for i in at[words[0]] if tokens[i : i + len(words)] == list(words)]

        base = sorted((i, label) for words, label in self.base for i in phrase(words))
        # places that agree on a template's start: votes by (template, start)
        votes: dict[int, list[tuple[int, int]]] = {}
        for w in sorted(here.intersection(self.postings), key=lambda w: -self.idf[w]):
            for template, p in self.postings[w]:
                votes.setdefault(template, []).extend((i - p, p) for i in at[w])
        labels, best = set(), 0.0
        for template, proposed in votes.items():
            label, size, rare, keys = self.templates[template]
            places = [phrase(k) for k in keys]
            if not all(places):
                continue
            proposed.sort()
            total = sum(rare.values())
            low, inside = 0, Counter()
            for high, (start, p) in enumerate(proposed):
                inside[p] += 1
                while proposed[low][0] < start - SLACK:
                    inside[proposed[low][1]] -= 1
                    low += 1
                share = sum(rare[q] for q, c in inside.items() if c > 0) / total
                if share >= COVER and all(_near(x, start - SLACK, start + size + SLACK) for x in places):
                    labels.add(label)
                    best = max(best, share)
        return base, labels, min(1.0, best)


def _near(places: list[int], low: int, high: int) -> bool:
    i = bisect_left(places, low)
    return i < len(places) and places[i] <= high


ADDED = (
    ("n_words", T.LongType()), ("n_base", T.LongType()), ("first_word", T.LongType()), ("last_word", T.LongType()),
    ("base_labels", T.StringType()), ("labels", T.StringType()), ("score", T.DoubleType()),
)


def scan_licenses(docs: DataFrame, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs (or its columns keep) with the columns of ADDED."""
    small_batches(docs.sparkSession)
    keep = docs.columns if keep is None else keep
    index = docs.sparkSession.sparkContext.broadcast(Index(*frequencies(docs, text)))
    names = fresh(keep, *(n for n, _ in ADDED))
    schema = T.StructType([*docs.select(*keep).schema.fields, *(T.StructField(n, kind) for n, (_, kind) in zip(names, ADDED))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = index.value
        for whole in batches:
            for low in range(0, whole.num_rows, 1024):
                batch, rows = whole.slice(low, 1024), []
                for t in batch.column(batch.schema.get_field_index(text)).to_pylist():
                    tokens = words(t)
                    base, labels, best = own.scan(tokens)
                    plain = {label for _, label in base}
                    score = max(best, 0.5 if base else 0.0)
                    rows.append((len(tokens), len(base), base[0][0] if base else None, base[-1][0] if base else None, ",".join(sorted(plain)), ",".join(sorted(plain | labels)), score))
                added = [pa.array(x, kind) for x, kind in zip(zip(*rows), (pa.int64(),) * 4 + (pa.string(),) * 2 + (pa.float64(),))]
                if rows:
                    yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(c)) for c in keep), *added], names=[*keep, *names])

    return docs.select(*dict.fromkeys([*keep, text])).mapInArrow(run, schema)


def op7_licenses(spark, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents").select("doc_id", "text"), keep=["doc_id"])
