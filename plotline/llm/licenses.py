"""Operator 6, license scans by an exact set-similarity join.

A text block is any window of consecutive words, a quarter longer than the template it is compared with; it matches if it holds
at least ``THRESHOLD`` of the template's words (as a multiset). The words of the templates are ordered by their frequency in the
whole corpus, the rarest first. A matching block must hold one of a template's first few words in that order (prefix
filter), and be long enough for the overlap where the text's ends cut it (length filter). Of a block whose first common word in
that order is this one, only its words from there on in the order can be common: around the word some window must hold
enough of them (positional filter). What is left is counted exactly. No matching window is missed: its first common word passes all
three. Beside the windows, fixed phrases are found where their words stand one after another.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from plotline.llm.common import id_as_text, id_restored, text_or_empty

THRESHOLD, SLACK = 0.9, 1.25
#: Phrases that name a license by themselves.
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}
#: Notices of public licenses, as words.
TEMPLATES = [
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("cc-by-nc", "this work is licensed under a creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-sa", "this work is licensed under a creative commons attribution sharealike 4 0 international license"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
]
#: ASCII bytes that are no digit and no lower-case letter separate words; bytes of other characters belong to words.
_SEPARATORS = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 or 0x7B <= b <= 0x7F else b for b in range(256))


class Span(NamedTuple):
    """A block that matches a template: its best window."""

    label: str
    first_word: int
    n_words: int
    containment: float


def words(text: str) -> list[bytes]:
    """Lower-case (ASCII) words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` in UTF-8."""
    return text.encode().lower().translate(_SEPARATORS).split()


class Templates:
    """Templates with their words in global order and their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int], threshold: float = THRESHOLD):
        self.items = []
        self.rank: list[dict[bytes, int]] = []
        self.by_prefix: dict[bytes, list[int]] = {}
        #: occurrences of prefix words that came to each filter
        self.seen = {"prefix": 0, "length": 0, "positional": 0}
        for k, (label, text) in enumerate(templates):
            bag = Counter(words(text))
            order = sorted(bag, key=lambda w: (frequency.get(w, 0), w))
            size = bag.total()
            least = math.ceil(threshold * size - 1e-9)
            self.items.append((label, bag, size, least, max(least, math.ceil(SLACK * size))))
            self.rank.append({w: i for i, w in enumerate(order)})
            passed = 0
            for w in order:
                if size - passed < least:  # what is left after the rarer ones is too little
                    break
                self.by_prefix.setdefault(w, []).append(k)
                passed += bag[w]
        self.prefix = frozenset(self.by_prefix)

    def spans(self, found: list[bytes]) -> list[Span]:
        """Every template's matching blocks in these words; overlapping windows of one template give the best of them."""
        if self.prefix.isdisjoint(found):
            return []
        near: dict[int, list[tuple[int, int]]] = {}
        for i, w in enumerate(found):
            for k in self.by_prefix.get(w, ()):
                label, bag, size, least, window = self.items[k]
                low, high = max(0, i - window + 1), min(len(found), i + window)
                if self._may_match(found, i, low, high, k):
                    spans = near.setdefault(k, [])
                    if spans and low <= spans[-1][1]:
                        spans[-1] = (spans[-1][0], max(spans[-1][1], high))
                    else:
                        spans.append((low, high))
        out = []
        for k, spans in near.items():
            label, bag, size, least, window = self.items[k]
            for low, high in spans:
                out += self._windows(found, low, high, label, bag, size, least, window)
        return out

    def _may_match(self, found: list[bytes], i: int, low: int, high: int, k: int) -> bool:
        """Whether a block of which found[i] is the first common word, in the order of all words, can match template ``k``."""
        _, _, _, least, window = self.items[k]
        self.seen["prefix"] += 1
        if high - low < least:
            return False
        self.seen["length"] += 1
        rank = self.rank[k]
        first = rank[found[i]]
        after = [rank.get(w, -1) >= first for w in found[low:high]]
        now = sum(after[:window])
        best = now
        for j in range(window, len(after)):
            now += after[j] - after[j - window]
            best = max(best, now)
        if best < least:
            return False
        self.seen["positional"] += 1
        return True

    @staticmethod
    def _windows(found, low, high, label, bag, size, least, window) -> Iterator[Span]:
        have: Counter = Counter()
        common = 0
        best: tuple[int, int] | None = None  # overlap, start
        for j in range(low, high):
            w = found[j]
            if w in bag:
                have[w] += 1
                common += have[w] <= bag[w]
            i = j - window + 1
            if i > low:
                w = found[i - 1]
                if w in bag:
                    common -= have[w] <= bag[w]
                    have[w] -= 1
            start = max(i, low)
            if best and (start > best[1] + window or common < least and start > best[1]):
                yield Span(label, best[1], window, best[0] / size)
                best = None
            if common >= least and (best is None or common > best[0]):
                best = (common, start)
        if best:
            yield Span(label, best[1], min(window, len(found) - best[1]), best[0] / size)


def phrase_places(found: list[bytes], phrases: dict[str, str] = PHRASES) -> list[tuple[int, str]]:
    """(word, label) for each place where a phrase's words stand consecutively."""
    text = b" " + b" ".join(found) + b" "
    out = []
    for phrase, label in phrases.items():
        key = b" " + phrase.encode() + b" "
        at = text.find(key)
        while at >= 0:
            out.append((text.count(b" ", 0, at), label))
            at = text.find(key, at + 1)
    return out


def word_frequency(docs: DataFrame, vocabulary: set[bytes]) -> dict[bytes, int]:
    """How often each word of ``vocabulary`` stands in the whole corpus; counted in the tasks, then summed.

    Null texts have no word, repeated rows count as often as they stand, and of an empty table all words are as rare.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n: Counter = Counter()
        for pdf in batches:
            for t in pdf["text"]:
                n.update(w for w in words(t) if w in vocabulary)
        if n:
            yield pd.DataFrame({"word": [w.decode() for w in n], "n": list(n.values())})

    counts = docs.select(text_or_empty().alias("text")).mapInPandas(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {r["word"].encode(): r["n"] for r in counts.collect()}  # as many rows as the templates have words


def scan(docs: DataFrame, *, templates: list[tuple[str, str]] = TEMPLATES, phrases: dict[str, str] = PHRASES, threshold: float = THRESHOLD) -> DataFrame:
    """doc_id, n_words, places (array of word, label), spans (array of label, first_word, n_words, containment) for every row.

    Whole texts; null is empty and has none. Repeated rows each get a row. An empty table gives no row.
    """
    vocabulary = {w for _, text in templates for w in words(text)}
    table = Templates(templates, word_frequency(docs, vocabulary), threshold)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            n, places, spans = [], [], []
            for t in pdf["text"]:
                found = words(t)
                n.append(len(found))
                places.append([{"word": w, "label": x} for w, x in phrase_places(found, phrases)])
                spans.append([s._asdict() for s in table.spans(found)])
            yield pd.DataFrame({"doc_id": pdf["doc_id"], "n_words": n, "places": places, "spans": spans})

    schema = "doc_id string, n_words long, places array<struct<word long, label string>>, spans array<struct<label string, first_word long, n_words long, containment double>>"
    return id_restored(id_as_text(docs, text_or_empty().alias("text")).mapInPandas(run, schema), docs)


def summary(scanned: DataFrame) -> DataFrame:
    """One row for each row of ``scan``: n_base, first_word, last_word, base_labels, labels, score (best containment; a phrase counts as 1)."""
    starts = F.transform("places", lambda p: p["word"])
    base = F.transform("places", lambda p: p["label"])
    every = F.concat(base, F.transform("spans", lambda s: s["label"]))
    joined = lambda a: F.array_join(F.array_sort(F.array_distinct(a)), ",")
    score = F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.array_max(F.transform("spans", lambda s: s["containment"])), F.lit(0.0)))
    return scanned.select(
        "doc_id", "n_words", F.size("places").cast("long").alias("n_base"), F.array_min(starts).alias("first_word"), F.array_max(starts).alias("last_word"),
        joined(base).alias("base_labels"), joined(every).alias("labels"), score.alias("score"), F.size("spans").alias("n_blocks"),
    )
