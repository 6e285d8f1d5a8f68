"""Licence scan by a positional index of rare licence words.

Inverse document frequencies over the whole corpus rank the words of all templates.
In a file, the licence words with the highest ones are looked up, as many a template
as may be out of place there and a few more; their postings (template, position) are
intersected by relative position, within the slack that inserted and missing words
need. Where enough of them agree, the template's mandatory key phrases are verified,
the first byte by byte at its place and the others near theirs, and then its other words.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.llm import kernel

#: Phrases that count as base places, with their labels.
BASE = (("cc by", "cc-by"), ("general public license", "gpl"), ("all rights reserved", "reserved"))
#: Openings of public licences and notices as (label, words, mandatory key phrases in their order).
NOTICES = (
    ("agpl-3.0", "under the terms of the gnu affero general public license version 3", ("gnu affero general public license version 3",)),
    ("agpl-3.0", "redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license", ("gnu affero general public license", "version 3 of the license")),
    ("apache-2.0", "licensed under the apache license version 2 0", ("apache license version 2 0",)),
    ("apache-2.0", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license", ("apache license", "you may not use this file except in compliance")),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", ("redistribution and use", "source and binary forms")),
    ("cc-by-4.0", "this work is licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0",)),
    ("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    ("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0",)),
    ("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    ("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0",)),
    ("cc0-1.0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", ("to the extent possible under law", "waived all copyright")),
    ("gpl-2.0", "under the terms of the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-2.0", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license", ("gnu general public license", "version 2 of the license")),
    ("gpl-2.0", "this work is licensed under the gnu general public license version 2", ("gnu general public license version 2",)),
    ("gpl-3.0", "under the terms of the gnu general public license version 3", ("gnu general public license version 3",)),
    ("gpl-3.0", "redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license", ("gnu general public license", "version 3 of the license")),
    ("gpl-3.0", "this work is licensed under the gnu general public license version 3", ("gnu general public license version 3",)),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ("permission to use copy modify", "with or without fee")),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge",)),
    ("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license v 2 0",)),
    ("unlicense", "this is free and unencumbered software released into the public domain", ("released into the public domain",)),
)
#: Least share of a notice's words that must stand in place, and how many words they may stand away from it.
SHARE, SLACK = 0.7, 3
#: Looked-up words that must agree on a place; a file's rarest ones are looked up until so many cannot be out of place.
VOTES = 2


@dataclass
class Template:
    label: str
    base: bool
    words: list[bytes]
    keys: list[tuple[int, list[bytes]]]

    def __post_init__(self) -> None:
        self.hashes = _hash(self.words)
        self.slack = 0 if self.base else SLACK
        self.least = len(self.words) if self.base else math.ceil(SHARE * len(self.words) - 1e-9)
        #: distinct words that may be out of place
        self.spare = len(self.words) - self.least
        self.votes = min(VOTES, len(set(self.words)) - self.spare)


def _hash(words: list[bytes]) -> np.ndarray:
    return kernel.Block([b" ".join(words)], kernel.ALNUM).hashes()


def templates() -> list[Template]:
    out = []
    for label, text, keys, base in [(label, text, (text,), True) for text, label in BASE] + [(*x, False) for x in NOTICES]:
        words = text.encode().split()
        places, low = [], 0
        for phrase in keys:
            p = phrase.encode().split()
            low = next(k for k in range(low, len(words)) if words[k : k + len(p)] == p)
            places.append((low, p))
        out.append(Template(label, base, words, places))
    return out


def _vocabulary() -> list[bytes]:
    return sorted({w for t in templates() for w in t.words})


def document_frequency(docs: DataFrame, text_col: str = "text") -> dict[bytes, int]:
    """Documents that have each licence word, over all rows; at most one row a word reaches the driver."""
    words = _vocabulary()
    known = _hash(words)
    order = np.argsort(known)
    ordered = known[order]

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = np.zeros(len(words), dtype=np.int64)
        for batch in batches:
            for _, raw in kernel.blocks(batch.column(0)):
                block = kernel.Block(raw, kernel.ALNUM)
                h = block.hashes()
                at = np.minimum(np.searchsorted(ordered, h), len(ordered) - 1)
                hit = np.flatnonzero(ordered[at] == h)
                doc = np.searchsorted(block.first, hit, side="right") - 1
                pairs = np.unique(doc * len(words) + order[at[hit]])
                seen += np.bincount(pairs % len(words), minlength=len(words))
        yield pa.RecordBatch.from_arrays([pa.array(range(len(words)), pa.int32()), pa.array(seen)], names=["word", "n"])

    rows = docs.select(text_col).mapInArrow(count, "word int, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    return {words[r.word]: r.n for r in rows}


class Matcher:
    """The positional index of all templates, and the scan of a block of documents."""

    def __init__(self, frequency: dict[bytes, int]):
        self.templates = templates()
        rarest = sorted(_vocabulary(), key=lambda w: (frequency.get(w, 0), w))
        number = {w: k for k, w in enumerate(rarest)}
        h = _hash(rarest)
        order = np.argsort(h)
        self.known, self.number = h[order], order
        #: of each template: its distinct words, rarest first, those of its key phrases, and its postings (word, position)
        self.words = [np.array(sorted({number[w] for w in t.words})) for t in self.templates]
        self.keys = [np.array(sorted({number[w] for _, p in t.keys for w in p})) for t in self.templates]
        self.postings = [[(number[w], k) for k, w in enumerate(t.words)] for t in self.templates]

    def scan(self, block: kernel.Block) -> list[dict[tuple[int, int], float]]:
        """For each document, (template, first word) of every verified place, with the share of words in place."""
        found: list[dict[tuple[int, int], float]] = [{} for _ in range(len(block))]
        h = block.hashes()
        if not len(h):
            return found
        at = np.minimum(np.searchsorted(self.known, h), len(self.known) - 1)
        place = np.flatnonzero(self.known[at] == h)
        word = self.number[at[place]]
        doc = np.searchsorted(block.first, place, side="right") - 1
        have = np.zeros((len(block), len(self.known)), dtype=bool)
        have[doc, word] = True
        for t, template in enumerate(self.templates):
            own = have[:, self.words[t]]
            may = have[:, self.keys[t]].all(axis=1) & (own.sum(axis=1) >= len(self.words[t]) - template.spare)
            if not may.any():
                continue
            # the file's rarest words of the template; more than the spare ones, so some are in place
            asked = np.zeros_like(have)
            asked[:, self.words[t]] = own & may[:, None] & (np.cumsum(own, axis=1) <= template.spare + template.votes)
            hit = np.flatnonzero(asked[doc, word])
            for d, start in self._places(template, self.postings[t], place[hit], word[hit], doc[hit]):
                low, high = int(block.first[d]), int(block.first[d + 1])
                if (share := self._verify(block, h, template, start, low, high)) is not None:
                    found[d][(t, start - low)] = share
        return found

    @staticmethod
    def _places(template: Template, postings: list[tuple[int, int]], place: np.ndarray, word: np.ndarray, doc: np.ndarray) -> list[tuple[int, int]]:
        """(document, start) where enough looked-up words agree on the start, within the slack."""
        parts = [(doc[m], place[m] - k) for w, k in postings for m in [word == w]]
        doc, start = (np.concatenate(x) for x in zip(*parts))
        order = np.lexsort((start, doc))
        doc, start = doc[order], start[order]
        key = doc * (1 << 40) + start
        agree = np.searchsorted(key, key + 2 * template.slack, side="right") - np.arange(len(key)) >= template.votes
        tried = (key[agree][:, None] + np.arange(-template.slack, template.slack + 1)).ravel()
        return [divmod(x, 1 << 40) if x % (1 << 40) < 1 << 39 else (x // (1 << 40) + 1, x % (1 << 40) - (1 << 40)) for x in np.unique(tried).tolist()]

    @staticmethod
    def _verify(block: kernel.Block, h: np.ndarray, template: Template, start: int, low: int, high: int) -> float | None:
        """The share of words in place, if key phrases and enough words are."""

        def stands(p: int, phrase: list[bytes]) -> bool:
            return low <= p and p + len(phrase) <= high and all(block.data[block.starts[p + j] : block.ends[p + j]] == w for j, w in enumerate(phrase))

        slack = range(-template.slack, template.slack + 1)
        (first, phrase), *others = template.keys
        if not stands(start + first, phrase) or not all(any(stands(start + at + j, p) for j in slack) for at, p in others):
            return None
        near = lambda k: h[max(low, start + k - template.slack) : max(low, min(high, start + k + template.slack + 1))]
        n = sum(bool((near(k) == x).any()) for k, x in enumerate(template.hashes))
        return n / len(template.words) if n >= template.least else None


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Licence labels and base places of every whole text.

    Returns doc_id, n_words, n_base, first_word, last_word, base_labels, labels,
    score (largest share of a template's words in place, else 0) and places (label
    and first word of every verified place; below 0 where a notice's opening is cut off).
    A place of a notice has its first key phrase word for word, the other key phrases and
    at least SHARE of all words at most SLACK words away. Null and empty texts have no
    words, no places, empty labels and score 0. Repeated rows are judged alike and other
    columns are not read; an empty table gives no rows. One pass over the texts counts
    words, one scans; no shuffle carries text. A very long text takes about 25 bytes a byte.
    """
    frequency = document_frequency(docs, text_col)

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        matcher = Matcher(frequency)
        for batch in batches:
            for at, raw in kernel.blocks(batch.column(1)):
                block = kernel.Block(raw, kernel.ALNUM)
                rows = []
                for n, found in zip(block.counts.tolist(), matcher.scan(block)):
                    base = sorted(k for (t, k) in found if matcher.templates[t].base)
                    labels = sorted({matcher.templates[t].label for t, _ in found})
                    own = sorted({matcher.templates[t].label for t, _ in found if matcher.templates[t].base})
                    places = [{"label": matcher.templates[t].label, "word": k} for t, k in sorted(found, key=lambda x: (x[1], x[0]))]
                    rows.append((n, len(base), base[0] if base else None, base[-1] if base else None, ",".join(own), ",".join(labels), max(found.values(), default=0.0), places))
                columns = list(zip(*rows))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64(), pa.list_(pa.struct([("label", pa.string()), ("word", pa.int64())]))]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, len(raw)), *[pa.array(c, k) for c, k in zip(columns, kinds)]], names=["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "places"])

    kind = dict(docs.dtypes)[id_col]
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(scan, f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, places array<struct<label:string,word:long>>")
