"""License scans by a positional rare-token index.

``postings`` reads each whole text once: it counts words, finds the base phrases and the
templates' mandatory key phrases (every word of them, in a row), and lists where words of the
license templates stand (function words left out). Document frequencies of
those words, over all documents, give their IDF. ``labelled`` then works on these lists alone:
for each file, its words of highest IDF are looked up in the templates' rare postings: those of
a template's rarest words without all of which it can't reach the least score. The templates so
found are tried first, and others only while they can beat the best score; template and
file positions that agree on one offset are intersected; the best offset's share of the
template's IDF is the score; a label also needs the template's mandatory key phrases, whole and
near that offset. Where a longer key phrase stands, a shorter one within it does not count: a
"creative commons attribution sharealike" is no "creative commons attribution".

Defined results: null text is empty; no license words give score 0 and no labels; ties of a
score go to the first template by label; repeated rows are judged alike and each counts as a
document; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import math
from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import checkpointed, prepare, tidy

#: Phrases of the base rule and their labels.
BASE = (("gnu general public license", "gpl"), ("apache license", "apache"), ("cc by", "cc-by"), ("mit license", "mit"))
#: Label, notice, mandatory key phrases.
TEMPLATES = (
    ("agpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", ("gnu affero general public license",)),
    ("all-rights-reserved", "all rights reserved", ("rights reserved",)),
    ("apache", "licensed under the apache license version 2 0 you may not use this file except in compliance with the license", ("apache license",)),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("source and binary forms", "following conditions are met")),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution",)),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial",)),
    ("cc-by-nc-nd", "this work is licensed under a creative commons attribution noncommercial noderivatives 4 0 international license", ("creative commons attribution noncommercial noderivatives",)),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", ("cc by nc nd",)),
    ("cc-by-nc-sa", "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license", ("creative commons attribution noncommercial sharealike",)),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", ("cc by nc sa",)),
    ("cc-by-nd", "this work is licensed under a creative commons attribution noderivatives 4 0 international license", ("creative commons attribution noderivatives",)),
    ("cc-by-nd", "licensed under cc by nd 4 0", ("cc by nd",)),
    ("cc-by-sa", "licensed under cc by sa 4 0", ("cc by sa",)),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike",)),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("waived all copyright and related or neighboring rights",)),
    ("boost", "distributed under the boost software license version 1 0", ("boost software license",)),
    ("epl", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at", ("eclipse public license",)),
    ("gpl", "this work is licensed under the gnu general public license version 3", ("gnu general public license",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify",)),
    ("lgpl", "licensed under the gnu lesser general public license version 2 1", ("gnu lesser general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", ("gnu lesser general public license",)),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu library general public license as published by the free software foundation", ("gnu library general public license",)),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mit", "released under the mit license", ("mit license",)),
    ("mpl", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software", ("without any express or implied warranty", "held liable for any damages arising from the use")),
    *((label, f"spdx license identifier {name}", (f"spdx license identifier {name}",)) for label, name in (("agpl", "agpl 3 0"), ("apache", "apache 2 0"), ("bsd", "bsd 2 clause"), ("bsd", "bsd 3 clause"), ("boost", "bsl 1 0"), ("cc-by", "cc by 4 0"), ("cc-by-nc", "cc by nc 4 0"), ("cc-by-nc-nd", "cc by nc nd 4 0"), ("cc-by-nc-sa", "cc by nc sa 4 0"), ("cc-by-nd", "cc by nd 4 0"), ("cc-by-sa", "cc by sa 4 0"), ("cc0", "cc0 1 0"), ("epl", "epl 2 0"), ("gpl", "gpl 2 0"), ("gpl", "gpl 3 0"), ("isc", "isc"), ("lgpl", "lgpl 2 1"), ("lgpl", "lgpl 3 0"), ("mit", "mit"), ("mpl", "mpl 2 0"), ("unlicense", "unlicense"), ("zlib", "zlib"))),
)
#: Function words: they are no rare tokens; key phrases need them like any other word.
COMMON = frozenset("a all an and any are as at be by can for form from in is it may not of on or out that the this to use with without you".split())
#: The share of a template's IDF that must stand at one offset, and the shift allowed there.
LEAST_SCORE, SLACK = 0.6, 2

_UPPER = bytes(range(65, 91))
#: Bytes to small letters, and to blanks where no word character stands; bytes over 127 stay.
_TABLE = bytes(b + 32 if b in _UPPER else b if b > 127 or chr(b).isalnum() else 32 for b in range(256))

VOCABULARY = sorted({w for _, text, _ in TEMPLATES for w in text.split() if w not in COMMON})
KEYS = sorted({key for _, _, keys in TEMPLATES for key in keys})
#: For each key phrase, the longer ones that hold it, and how many words further on it stands in them.
WITHIN = {k: [(longer, j) for longer in KEYS if longer != k for j in range(len(longer.split())) if longer.split()[j : j + len(k.split())] == k.split()] for k in KEYS}
_NUMBER = {w.encode(): i for i, w in enumerate(VOCABULARY)}
_KEY_NUMBER = {key: i for i, key in enumerate(KEYS)}
_BASE_LABEL = dict(BASE)


def words_of(text: str | None) -> list[bytes]:
    """Words as UTF-8, small letters."""
    return (text or "").encode("utf-8", "surrogatepass").translate(_TABLE).split()


def places(words: list[bytes], phrases: Iterable[str]) -> dict[str, list[int]]:
    """Phrase to the places, ascending, where its words stand in a row; phrases that have none are left out."""
    line, found = b" " + b" ".join(words) + b" ", {}
    for phrase in phrases:
        needle, at, own = b" " + phrase.encode() + b" ", 0, []
        seen = upto = 0
        while (at := line.find(needle, at)) >= 0:
            seen, upto = seen + line.count(b" ", upto, at), at
            own.append(seen)
            at += 1
        if own:
            found[phrase] = own
    return found


def standing(found: dict[str, list[int]]) -> dict[str, list[int]]:
    """The places of key phrases that are not within a longer one."""
    out = {}
    for key, own in found.items():
        inner = {p + j for longer, j in WITHIN[key] for p in found.get(longer, ())}
        out[key] = [p for p in own if p not in inner]
    return out


@tidy
def _posted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    vocabulary = frozenset(_NUMBER)
    for batch in batches:
        rows = []
        for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1)):
            words = words_of(text.as_py())
            hits: list[int] = []
            keys: list[int] = []
            base: dict[str, list[int]] = {}
            if not vocabulary.isdisjoint(words):  # every base and key phrase holds a word of the vocabulary
                hits = [x for i, w in enumerate(words) if w in vocabulary for x in (_NUMBER[w], i)]
                keys = [x for key, own in standing(places(words, KEYS)).items() for p in own for x in (_KEY_NUMBER[key], p)]
                base = places(words, _BASE_LABEL)
            all_base = [p for own in base.values() for p in own]
            rows.append((doc_id, len(words), len(all_base), min(all_base, default=None), max(all_base, default=None), sorted({_BASE_LABEL[b] for b in base}), hits, keys))
        if rows:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), _TYPES)], _NAMES)


_NAMES = ["doc_id", "n_words", "n_base", "first_word", "last_word", "base", "hits", "keys"]
_TYPES = [*[pa.int64()] * 5, pa.list_(pa.string()), pa.list_(pa.int64()), pa.list_(pa.int64())]
_SCHEMA = "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base array<string>, hits array<bigint>, keys array<bigint>"


def postings(docs: DataFrame) -> DataFrame:
    """Per document: base figures, ``hits``, (word number, place) in turn, for template words, and ``keys`` likewise for key phrases."""
    prepare(docs.sparkSession)
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(_posted, _SCHEMA)


def frequencies(posted: DataFrame) -> tuple[int, dict[int, int]]:
    """Documents in all, and of each vocabulary word; the vocabulary bounds what is collected."""
    words = F.array_distinct(F.filter("hits", lambda x, i: i % 2 == 0))
    return posted.count(), {r[0]: r[1] for r in posted.select(F.explode(words).alias("w")).groupBy("w").count().collect()}


class Index:
    """Template postings with IDF."""

    def __init__(self, documents: int, df: dict[int, int]):
        self.idf = [math.log((1 + documents) / (1 + df.get(i, 0))) + 1 for i in range(len(VOCABULARY))]
        self.total, self.keys, self.words = [], [], []
        number = {w: i for i, w in enumerate(VOCABULARY)}
        for _, text, keys in TEMPLATES:
            self.words.append([(number[w], q) for q, w in enumerate(text.split()) if w in number])
            self.total.append(sum(self.idf[w] for w, _ in self.words[-1]))
            self.keys.append([_KEY_NUMBER[key] for key in keys])
        #: Rare word to the templates that have it among the rarest, without all of which they stay below the least score.
        self.rare: dict[int, list[int]] = defaultdict(list)
        for t, words in enumerate(self.words):
            left = self.total[t]
            for w in sorted({w for w, _ in words}, key=lambda w: -self.idf[w]):
                if left < LEAST_SCORE * self.total[t] - 1e-9:
                    break
                self.rare[w].append(t)
                left -= self.idf[w] * sum(1 for x, _ in words if x == w)

    def judge(self, hits: list[int], keys: list[int]) -> tuple[list[str], float]:
        """(labels, best score) of a file's template words and key phrases."""
        starts: dict[int, list[int]] = defaultdict(list)
        for k, p in zip(keys[::2], keys[1::2]):
            starts[k].append(p)
        at: dict[int, set[int]] = defaultdict(set)
        for w, p in zip(hits[::2], hits[1::2]):
            at[w].add(p)
        best, labels = 0.0, set()
        first = dict.fromkeys(t for w in sorted(at, key=lambda w: -self.idf[w]) for t in self.rare.get(w, ()))
        most = [min(1.0, sum(self.idf[w] for w, _ in words if w in at) / total) for words, total in zip(self.words, self.total)]
        for t in [*first, *sorted((t for t in range(len(most)) if t not in first), key=lambda t: -most[t])]:
            if most[t] < LEAST_SCORE and most[t] <= best:
                continue
            got = self._shares(t, at)
            best = max(best, max(got.values(), default=0.0))
            enough = [o for o, share in got.items() if share >= LEAST_SCORE]
            if enough and TEMPLATES[t][0] not in labels:
                if any(all(self._near(starts[k], o, t) for k in self.keys[t]) for o in enough):
                    labels.add(TEMPLATES[t][0])
        return sorted(labels), round(float(best), 6)

    def _shares(self, t: int, at: dict[int, set[int]]) -> dict[int, float]:
        """Share of the template's IDF at each offset where one of its words stands exactly."""
        got = dict.fromkeys((p - q for w, q in self.words[t] for p in at.get(w, ())), 0.0)
        for w, q in self.words[t]:
            for o in {p - q + s for p in at.get(w, ()) for s in range(-SLACK, SLACK + 1)} & got.keys():
                got[o] += self.idf[w]
        return {o: min(1.0, x / self.total[t]) for o, x in got.items()}

    @staticmethod
    def _near(starts: list[int], offset: int, t: int) -> bool:
        """Whether one of the (sorted) starts is within the template's reach."""
        i = bisect_left(starts, offset - SLACK)
        return i < len(starts) and starts[i] <= offset + len(TEMPLATES[t][1].split()) + SLACK


def labelled(posted: DataFrame, index: Index) -> DataFrame:
    """The base figures with base_labels, labels and score."""
    spark = prepare(posted.sparkSession)
    shared = spark.sparkContext.broadcast(index)

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            base, labels, scores = [], [], []
            for own, hits, keys in zip(*(batch.column(i).to_pylist() for i in (5, 6, 7))):
                more, best = shared.value.judge(hits, keys) if hits else ([], 0.0)
                base.append(",".join(own))
                labels.append(",".join(sorted({*own, *more})))
                scores.append(best)
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(base, pa.string()), pa.array(labels, pa.string()), pa.array(scores, pa.float64())], [*_NAMES[:5], "base_labels", "labels", "score"])

    return posted.mapInArrow(run, "doc_id bigint, n_words bigint, n_base bigint, first_word bigint, last_word bigint, base_labels string, labels string, score double")


def scan(docs: DataFrame) -> DataFrame:
    """License labels of all documents; texts are read once, their postings twice."""
    posted = checkpointed(postings(docs))
    return labelled(posted, Index(*frequencies(posted)))
