"""Licence scan with a positional rare-token index (op1).

TEMPLATES are licence notices: a label, words, and mandatory key phrases (the base phrases are templates that are their own key phrase). The index holds, for each
template, the places of its ANCHORS rarest words by inverse document frequency, counted over the whole corpus in a first pass (the vocabulary is the templates'
own few hundred words, so the counts that are collected are bounded). In the second pass, a file's highest-IDF licence words, those of its words that are anchors, are looked up, all of
them, so that a file with many notices loses none; each hit at word p for
a template's word q proposes that the template starts at p - q, and proposals of one template that agree (within TOLERANCE words) are intersected. A proposal
stands if every key phrase is found, word for word, near where it should be. Its score is the idf-weighted share of the template's words found in order there.
Phrases of a single place are exact: their rarest word is in the index, so every place is proposed.

Only texts with an anchor word are looked at closer. No text is shuffled.

Null or empty text: no words, no labels, score 0. Repeated rows get equal results. An empty table gives no rows. Other columns are ignored, or passed through by
scan() with the columns it adds.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from larkspar.llm.common import ALNUM_BYTES, map_texts, raw, table, without

ANCHORS, TOLERANCE, MIN_SCORE = 4, 2, 0.6
#: Base phrases and their labels.
BASE = (("cc-by", "cc by"), ("gpl", "general public license"), ("reserved", "all rights reserved"))
#: Wordings that licences give for notices. Label, wording, key phrases.
NOTICES = (
    ("mit", "mit license", ("mit license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "any person obtaining a copy")),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    ("apache-2.0", "apache license version 2 0", ("apache license", "version 2 0")),
    ("apache-1.1", "apache software license version 1 1", ("apache software license", "version 1 1")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ("redistribution and use in source and binary forms",)),
    ("bsd-3-clause", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products", ("neither the name of", "endorse or promote products")),
    ("gpl-2.0", "gnu general public license version 2", ("general public license version 2",)),
    ("gpl-2.0", "gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "either version 2")),
    ("gpl-3.0", "gnu general public license version 3", ("general public license version 3",)),
    ("gpl-3.0", "gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "either version 3")),
    ("lgpl", "gnu lesser general public license", ("lesser general public license",)),
    ("agpl", "gnu affero general public license", ("affero general public license",)),
    ("mpl-2.0", "mozilla public license version 2 0", ("mozilla public license", "version 2 0")),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("epl-2.0", "eclipse public license version 2 0", ("eclipse public license", "version 2 0")),
    ("cc0", "cc0 1 0 universal public domain dedication", ("cc0 1 0",)),
    ("cc-by-4.0", "creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-sa", "cc by sa", ("cc by sa",)),
    ("cc-by-nc", "cc by nc", ("cc by nc",)),
    ("cc-by-nd", "cc by nd", ("cc by nd",)),
    ("cc-by-sa", "creative commons attribution sharealike", ("creative commons attribution sharealike",)),
    ("cc-by-nc", "creative commons attribution noncommercial", ("creative commons attribution noncommercial",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
    ("bsl-1.0", "boost software license version 1 0", ("boost software license",)),
    ("artistic-2.0", "the artistic license 2 0", ("artistic license 2 0",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable", ("without any express or implied warranty", "authors be held liable")),
    ("odc-by", "open data commons attribution license", ("open data commons attribution",)),
)


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    keys: tuple[tuple[bytes, ...], ...]
    is_base: bool


def _words(text: str) -> tuple[bytes, ...]:
    return tuple(text.encode().translate(ALNUM_BYTES).split())


TEMPLATES = tuple(Template(label, _words(p), (_words(p),), True) for label, p in BASE) + tuple(Template(label, _words(t), tuple(map(_words, keys)), False) for label, t, keys in NOTICES)


class Index:
    """Positional postings of the templates' rarest words."""

    def __init__(self, frequency: dict[bytes, int], n_docs: int, templates: tuple[Template, ...] = TEMPLATES, anchors: int = ANCHORS):
        self.templates = templates
        self.idf = {w: math.log((1 + n_docs) / (1 + frequency.get(w, 0))) + 1 for t in templates for w in t.words}
        self.postings: dict[bytes, list[tuple[int, int]]] = {}
        self.need: list[int] = []
        for k, t in enumerate(templates):
            rare = sorted(set(t.words), key=lambda w: (-self.idf[w], w))[: anchors if not t.is_base else 1]
            self.need.append(1 if len(rare) < 3 else 2)
            for q, w in enumerate(t.words):
                if w in rare:
                    self.postings.setdefault(w, []).append((k, q))

    def _stands(self, t: Template, words: list[bytes], start: int) -> float:
        """The score of a template that starts about there; 0 without one of its key phrases."""
        reach = 0 if t.is_base else TOLERANCE
        low, high = max(0, start - reach), start + len(t.words) + reach
        near = words[low:high]
        for key in t.keys:
            if not any(tuple(near[i : i + len(key)]) == key for i in range(len(near) - len(key) + 1)):
                return 0.0
        found, place = 0.0, 0
        for w in t.words:
            try:
                place = near.index(w, place) + 1
                found += self.idf[w]
            except ValueError:
                pass
        return min(1.0, found / sum(self.idf[w] for w in t.words))

    def scan(self, words: list[bytes]) -> tuple[list[tuple[str, int, int]], dict[str, float]]:
        """All places of base phrases as (label, start, words), and the best score of each other label."""
        base: list[tuple[str, int, int]] = []
        scores: dict[str, float] = {}
        if self.postings.keys().isdisjoint(words):
            return base, scores
        starts: dict[int, list[tuple[int, int]]] = {}
        for p, w in enumerate(words):
            if w in self.postings:
                for k, q in self.postings[w]:
                    starts.setdefault(k, []).append((p - q, q))
        for k, proposed in starts.items():
            t = self.templates[k]
            proposed.sort()
            if t.is_base:
                base += [(t.label, s, len(t.words)) for s in sorted({s for s, _ in proposed}) if s >= 0 and tuple(words[s : s + len(t.words)]) == t.words]
                continue
            i = 0
            while i < len(proposed):
                j = i
                while j < len(proposed) and proposed[j][0] - proposed[i][0] <= TOLERANCE:
                    j += 1
                if len({q for _, q in proposed[i:j]}) >= self.need[k] and (score := self._stands(t, words, proposed[i][0])) >= MIN_SCORE:
                    scores[t.label] = max(score, scores.get(t.label, 0.0))
                i += 1 if j == i + 1 or proposed[j - 1][0] != proposed[i][0] else j - i
        return base, scores


def _frequencies(batches: Iterator[pa.RecordBatch], vocabulary: frozenset[bytes]) -> Iterator[pa.RecordBatch]:
    times, n = dict.fromkeys(vocabulary, 0), 0
    for b in batches:
        for text in raw(b):
            n += 1
            for w in vocabulary.intersection(text.translate(ALNUM_BYTES).split()):
                times[w] += 1
    yield pa.RecordBatch.from_arrays([pa.array(["", *(w.decode() for w in times)]), pa.array([n, *times.values()], pa.int64())], ["word", "n"])


def build_index(docs: DataFrame, templates: tuple[Template, ...] = TEMPLATES) -> Index:
    vocabulary = frozenset(w for t in templates for w in t.words)
    counts = map_texts(docs.select("text"), lambda x: _frequencies(x, vocabulary), "word string, n long").groupBy("word").agg(F.sum("n")).collect()
    got = {w: n for w, n in counts}
    return Index({w: got.get(w.decode(), 0) for w in vocabulary}, got.get("", 0), templates)


FIELDS = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The named columns of docs (all, if none are named) with FIELDS."""
    index = build_index(docs)
    own = without(docs, *(f.split()[0] for f in FIELDS.split(", ")))
    columns = own.columns if columns is None else columns
    own = own.select(*columns, *([] if "text" in columns else ["text"]))

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out = []
            for text in raw(b):
                words = text.translate(ALNUM_BYTES).split()
                base, scores = index.scan(words)
                firsts = [s for _, s, _ in base]
                names = {x for x, _, _ in base}
                best = 1.0 if base else max(scores.values(), default=0.0)
                out.append((len(words), len(base), min(firsts, default=None), max(firsts, default=None), ",".join(sorted(names)), ",".join(sorted(names | scores.keys())), best))
            types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64()]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in range(len(columns))), *(pa.array([r[i] for r in out], t) for i, t in enumerate(types))], [*columns, *(f.split()[0] for f in FIELDS.split(", "))])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in own.schema.fields[: len(columns)])
    return map_texts(own, rows, f"{schema}, {FIELDS}")


def op1_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan(table(spark, sf_dir, "documents"), ["doc_id"])
