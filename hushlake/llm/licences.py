"""License scans by a positional index of rare tokens.

A template is a licence's own wording with the key phrases it cannot do without.
The index lists, for each word of the templates, where it stands in them. A word's
weight is its inverse document frequency over the whole corpus. Of each template
the heaviest places are looked up, so many that no file with the least share in
place can be without all of them, whatever else it holds; a word at place p of the
file and q of a template speaks for the template beginning at p - q. The wording is
compared place by place around there, and the key phrases are verified word for word.

Three phrases are the base: wherever their words stand one after another, their
label is given, whatever the index finds. Null and empty texts have no words and
no labels. Repeated rows and null ids come back as they are, an empty table
gives no row, other columns are not read.
"""

from __future__ import annotations

import math
from collections import Counter, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The base phrases and their labels.
BASE = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Licence wordings, each with its key phrases. Where a licence has several wordings they are listed apart.
TEMPLATES: list[tuple[str, str, tuple[str, ...]]] = [
    ("mit", "released under the mit license", ("mit license",)),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated "
        "documentation files the software to deal in the software without restriction including without limitation the "
        "rights to use copy modify merge publish distribute sublicense and or sell copies of the software",
        ("permission is hereby granted free of charge", "to deal in the software without restriction"),
    ),
    ("apache-2", "licensed under the apache license version 2 0", ("apache license version 2",)),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with "
        "the license you may obtain a copy of the license at http www apache org licenses license 2 0",
        ("apache license version 2", "except in compliance with the license"),
    ),
    ("gpl-3", "licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general "
        "public license as published by the free software foundation either version",
        ("gnu general public license", "free software foundation"),
    ),
    (
        "lgpl",
        "redistribute it and or modify it under the terms of the gnu lesser general public license as published by the "
        "free software foundation",
        ("gnu lesser general public license",),
    ),
    (
        "agpl-3",
        "under the terms of the gnu affero general public license as published by the free software foundation",
        ("gnu affero general public license",),
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the "
        "following conditions are met",
        ("redistribution and use in source and binary forms", "provided that the following conditions are met"),
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted",
        ("for any purpose with or without fee is hereby granted",),
    ),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0",
        ("mozilla public license v 2",),
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", ("cc by nc",)),
    ("cc-by", "licensed under cc by 4 0", ("cc by 4",)),
    (
        "cc-by",
        "this work is licensed under a creative commons attribution 4 0 international license",
        ("creative commons attribution 4 0",),
    ),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("free and unencumbered software",)),
]
#: The share of a wording's weight that must be in place.
LEAST = 0.6

_KEPT = b"abcdefghijklmnopqrstuvwxyz0123456789"
#: Bytes of words, with A-Z in lower case; all other ASCII becomes a blank, all else is part of words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or b in _KEPT else 32 for b in range(256))


def words(text: str | None) -> list[bytes]:
    r"""Words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` of the text with A-Z in lower case, in UTF-8."""
    return (text or "").encode().translate(_TABLE).split()


@dataclass(frozen=True)
class Template:
    label: str
    words: tuple[bytes, ...]
    phrases: tuple[tuple[bytes, ...], ...]


def templates(listed: list[tuple[str, str, tuple[str, ...]]]) -> list[Template]:
    split = lambda s: tuple(words(s))
    return [Template(label, split(text), tuple(map(split, phrases))) for label, text, phrases in listed]


def find(phrase: tuple[bytes, ...], listed: list[bytes], begin: int = 0, end: int | None = None) -> list[int]:
    """Every place in ``listed[begin:end]`` where the phrase's words stand one after another."""
    out, at, size = [], begin, len(phrase)
    stop = (len(listed) if end is None else min(end, len(listed))) - size + 1
    first, rest = phrase[0], list(phrase)
    while at < stop:
        try:
            at = listed.index(first, at, stop)
        except ValueError:
            break
        if listed[at : at + size] == rest:
            out.append(at)
        at += 1
    return out


class Index:
    """Postings of the templates' words, weighted by their rarity in the corpus."""

    def __init__(self, listed: list[Template], weights: dict[bytes, float]) -> None:
        self.templates, self.weights = listed, weights
        self.total = [sum(weights[w] for w in t.words) for t in listed]
        self.vocabulary = frozenset(w for t in listed for w in t.words)
        self.postings: dict[bytes, list[tuple[int, int]]] = defaultdict(list)
        for number, template in enumerate(listed):
            # More than 1 - LEAST of the weight lies on these places, so a wording found has one of them in place.
            rest = (1 - LEAST + 1e-9) * self.total[number]
            for place, word in sorted(enumerate(template.words), key=lambda x: (-weights[x[1]], x)):
                if rest < 0:
                    break
                self.postings[word].append((number, place))
                rest -= weights[word]
        # A template whose phrase words are not all in a file cannot be verified there.
        self.needed = [frozenset(w for p in t.phrases for w in p) for t in listed]

    def scan(self, listed: list[bytes]) -> dict[str, float]:
        """Labels found, each with the best share of a wording's weight in place."""
        present = self.vocabulary.intersection(listed)
        open_ = {i for i, needed in enumerate(self.needed) if needed <= present}
        if not open_:
            return {}
        begins: set[tuple[int, int]] = set()
        looked_up = present.intersection(self.postings)
        for place, word in enumerate(listed):
            if word in looked_up:
                begins.update((number, place - at) for number, at in self.postings[word] if number in open_)
        found: dict[str, float] = {}
        for number, begin in begins:
            template = self.templates[number]
            held = sum(
                self.weights[w] for q, w in enumerate(template.words) if 0 <= begin + q < len(listed) and listed[begin + q] == w
            )
            share = held / self.total[number]
            if share < LEAST or share <= found.get(template.label, 0):
                continue
            low, high = max(0, begin - 2), begin + len(template.words) + 2
            if all(find(phrase, listed, low, high) for phrase in template.phrases):
                found[template.label] = share
        return found


def weights(docs: DataFrame, listed: list[Template]) -> dict[bytes, float]:
    """Inverse document frequency of each word of the templates over all rows of ``docs``."""
    vocabulary = frozenset(w for t in listed for w in t.words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts: Counter = Counter()
        rows = 0
        for batch in batches:
            for text in batch.column(0).to_pylist():
                counts.update(vocabulary.intersection(words(text)))
                rows += 1
        counts[b""] = rows
        yield pa.record_batch(
            [pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"]
        )

    texts = docs.select(docs["text"].cast("string").alias("text"))
    summed = texts.mapInArrow(run, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    known = {bytes(r.word): r.n for r in summed}  # as many rows as the templates have words
    rows = known.get(b"", 0)
    return {w: math.log((rows + 1) / (known.get(w, 0) + 0.5)) for w in vocabulary}


def scan(docs: DataFrame, listed: list[tuple[str, str, tuple[str, ...]]] | None = None) -> DataFrame:
    """doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score for every row of ``docs``."""
    made = templates(TEMPLATES if listed is None else listed)
    phrases = [(tuple(words(p)), label) for p, label in BASE.items()]
    rarity = weights(docs, made)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = Index(made, rarity)
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64())
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        for batch in batches:
            rows = []
            for text in batch.column(1).to_pylist():
                split = words(text)
                places = [(at, label) for phrase, label in phrases for at in find(phrase, split)]
                base = {label for _, label in places}
                found = index.scan(split)
                rows.append(
                    (
                        len(split), len(places), min(places)[0] if places else None, max(places)[0] if places else None,
                        ",".join(sorted(base)), ",".join(sorted(base | set(found))),
                        1.0 if base else min(1.0, max(found.values(), default=0.0)),
                    )
                )
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            yield pa.record_batch([batch.column(0), *columns], names=["doc_id", *names])

    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text"))
    return texts.mapInArrow(
        run,
        "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double",
    )
