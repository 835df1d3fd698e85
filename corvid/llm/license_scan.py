"""Licence scan: a positional rare-token index over licence notices.

The index maps each word of the notices to its (template, position) postings. In a file, those of its licence words are
looked up that are rarest in the corpus: of each template so many, by IDF, that a placement without any of them can't
reach the weight asked for. Postings that agree on file position minus template position give a placement; it counts when
enough of the notice's weight stands there and its mandatory phrases stand in their places.
"""

from __future__ import annotations

import math
import re
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corvid.llm.shared import in_slices, table

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = {c: c + 32 for c in range(65, 91)}

# Phrases, labels and the notices' public wording.
BASE = (("mit license", "mit"), ("apache license", "apache"), ("general public license", "gpl"))
NOTICES = (
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0", ("apache org licenses license 2 0",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4 0",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("boost", "boost software license version 1 0", ("boost software license",)),
    ("cc0", "cc0 1 0 universal", ("cc0 1 0 universal",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("epl-2.0", "eclipse public license v 2 0", ("eclipse public license",)),
    ("gpl-2.0", "licensed under gplv2", ("licensed under gplv2",)),
    ("gpl-3.0", "licensed under gplv3", ("licensed under gplv3",)),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ("general public license version 2",)),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ("general public license version 3",)),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", ("under the terms of the gnu general public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", ("permission is hereby granted free of charge",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("in no event will the authors be held liable",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
)


#: Identifiers that may follow `SPDX-License-Identifier:`, as words, and their labels.
SPDX = (
    ("mit", "mit"), ("apache 2 0", "apache-2.0"), ("bsd 2 clause", "bsd"), ("bsd 3 clause", "bsd"), ("isc", "isc"), ("zlib", "zlib"), ("mpl 2 0", "mpl-2.0"), ("epl 2 0", "epl-2.0"), ("bsl 1 0", "boost"),
    ("gpl 2 0", "gpl-2.0"), ("gpl 3 0", "gpl-3.0"), ("lgpl 2 1", "lgpl"), ("lgpl 3 0", "lgpl"), ("agpl 3 0", "agpl"), ("cc0 1 0", "cc0"), ("unlicense", "unlicense"),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[str, ...]
    #: (position in words, length) of each mandatory phrase
    mandatory: tuple[tuple[int, int], ...]
    base: bool


def templates() -> list[Template]:
    out = [Template(label, w := tuple(p.split()), ((0, len(w)),), True) for p, label in BASE]
    tags = [(label, f"spdx license identifier {x}", (f"spdx license identifier {x}",)) for x, label in SPDX]
    for label, text, phrases in (*NOTICES, *tags):
        w, spots = tuple(text.split()), []
        for p in phrases:
            p = tuple(p.split())
            spots.append((next(i for i in range(len(w)) if w[i : i + len(p)] == p), len(p)))
        out.append(Template(label, w, tuple(spots), False))
    return out


class Index:
    """Postings of the templates' words."""

    def __init__(self, idf: dict[str, float], least: float = 0.7):
        self.templates, self.idf, self.least = templates(), idf, least
        self.postings: dict[str, dict[int, list[int]]] = defaultdict(lambda: defaultdict(list))
        self.weight = [sum(idf[w] for w in t.words) for t in self.templates]
        self.must = []
        for n, t in enumerate(self.templates):
            for p, w in enumerate(t.words):
                self.postings[w][n].append(p)
            self.must.append(frozenset(w for p, k in t.mandatory for w in t.words[p : p + k]))
        self.vocabulary = frozenset(self.postings)
        #: A file with a template has one of these: each template's rarest mandatory word.
        self.rarest = frozenset(max(m, key=lambda w: (idf[w], w)) for m in self.must)

    def lookups(self, have: frozenset[str]) -> dict[str, list[tuple[int, int]]]:
        """Postings (template, position) to look up in a file with these licence words, by word: of each template that can
        stand there the words of highest IDF, until what the others weigh is less than a placement needs."""
        out: dict[str, list[tuple[int, int]]] = defaultdict(list)
        for n, t in enumerate(self.templates):
            if not self.must[n] <= have:
                continue
            left, need = sum(self.idf[w] for w in t.words if w in have), self.least * self.weight[n]
            for w in sorted(have.intersection(t.words), key=lambda w: (-self.idf[w], w)):
                if left < need - 1e-9:
                    break
                out[w] += [(n, p) for p in self.postings[w][n]]
                left -= self.idf[w] * len(self.postings[w][n])
                if t.base:  # all its words are mandatory: the rarest is in each placement
                    break
        return out

    def scan(self, text: str | None) -> tuple[int, list[tuple[int, int, float]]]:
        """The number of words, and (start, template, share of its weight) of each placement found, sorted."""
        words = WORD.findall((text or "").translate(LOWER))
        have = self.vocabulary.intersection(words)
        if not have or self.rarest.isdisjoint(have) or not (asked := self.lookups(have)):
            return len(words), []
        places = {(n, at - p) for at, w in enumerate(words) if w in asked for n, p in asked[w]}
        found = []
        for n, start in places:
            t = self.templates[n]
            if all(start + p >= 0 and tuple(words[start + p : start + p + k]) == t.words[p : p + k] for p, k in t.mandatory):
                here = words[max(0, start) : start + len(t.words)]
                skipped = max(0, -start)
                share = sum(self.idf[x] for x, y in zip(t.words[skipped:], here, strict=False) if x == y) / self.weight[n]
                if share >= self.least:
                    found.append((start, n, min(1.0, share)))
        return len(words), sorted(found)


def word_idf(docs: DataFrame, text: str = "text") -> dict[str, float]:
    """log(1 + N / (1 + documents with the word)) over all documents, for the templates' words alone (a bounded set)."""
    vocabulary = frozenset(w for t in templates() for w in t.words)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        have: Counter[str] = Counter()
        for b in in_slices(batches, "text"):
            for t in b.column("text").to_pylist():
                have[""] += 1
                have.update(vocabulary.intersection(WORD.findall((t or "").translate(LOWER))))
        yield pa.RecordBatch.from_arrays([pa.array(list(have), pa.string()), pa.array(list(have.values()), pa.int64())], ["word", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(count, "word string, n bigint").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {r["word"]: r["n"] for r in rows}
    return {w: math.log(1 + n.get("", 0) / (1 + n.get(w, 0))) + 1e-9 for w in sorted(vocabulary)}


def scan_licenses(docs: DataFrame, least: float = 0.7, text: str = "text") -> DataFrame:
    """Per row of docs: doc_id, n_words, places array<struct<start,label,base,share>>.

    Null and empty texts have no words and no places; repeated rows and null ids stay; other columns are not read.
    An empty table gives an empty result.
    """
    index = Index(word_idf(docs, text), least=least)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = pa.list_(pa.struct([("start", pa.int64()), ("label", pa.string()), ("base", pa.bool_()), ("share", pa.float64())]))
        for b in in_slices(batches, "text"):
            n, places = [], []
            for t in b.column("text").to_pylist():
                count, found = index.scan(t)
                n.append(count)
                places.append([{"start": s, "label": (x := index.templates[k]).label, "base": x.base, "share": share} for s, k, share in found])
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(n, pa.int64()), pa.array(places, kind)], ["doc_id", "n_words", "places"])

    kept = docs.select("doc_id", F.col(text).cast("string").alias("text"))
    return kept.mapInArrow(run, f"doc_id {kept.schema['doc_id'].dataType.simpleString()}, n_words bigint, places array<struct<start:bigint,label:string,base:boolean,share:double>>")


def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Digest of scan_licenses over all documents."""
    found = scan_licenses(table(spark, sf_dir, "documents"))
    base = F.filter("places", lambda x: x["base"])
    names = lambda a: F.concat_ws(",", F.array_sort(F.array_distinct(F.transform(a, lambda x: x["label"]))))
    starts = F.transform(base, lambda x: x["start"])
    return found.select(
        "doc_id",
        "n_words",
        F.size(base).cast("long").alias("n_base"),
        F.array_min(starts).alias("first_word"),
        F.array_max(starts).alias("last_word"),
        names(base).alias("base_labels"),
        names(F.col("places")).alias("labels"),
        F.coalesce(F.array_max(F.transform("places", lambda x: x["share"])), F.lit(0.0)).alias("score"),
    )
