"""Licence scans with a generalised suffix automaton of licence templates.

All templates, as words, go into one suffix automaton; each state knows the templates its words occur in and where they
first end there. A document's words are streamed through it, which gives the matching statistics: for every word the
longest run of words up to it that stands in some template. Runs of `least` words or more that can't be longer are
chained per template, in the order of both texts and over gaps of at most `gap` words; the covered share of the template
is the chain's score. A template counts as found from a share of `share` on. Base phrases are looked up word by word,
apart from the chains.

A document is one streaming pass; the automaton holds only the templates. Rules: null and empty texts have no words and
score 0; repeated rows and null ids are scanned like any others; other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Phrases of the contract and their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}
# Public notices of common licences, (label, text); one label may have several.
TEMPLATES = (
    ("mit", "Released under the MIT License."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so"),
    ("apache-2", "Licensed under the Apache License, Version 2.0."),
    ("apache-2", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                 "compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3", "This work is licensed under the GNU General Public License, version 3."),
    ("gpl-3", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
              "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
              "option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
            "the following conditions are met"),
    ("mpl-2", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("cc-by", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-sa", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("cc-by-nc", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
)
LEAST, GAP, SHARE = 4, 12, 0.8
#: Separators of words in lower-cased UTF-8 become blanks.
BLANKS = bytes(0x20 if b < 0x30 or 0x3A <= b < 0x61 or 0x7B <= b < 0x80 else b for b in range(256))


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").lower().translate(BLANKS).split() if text else []


class Automaton:
    """Suffix automaton of several word sequences; ends[state] maps a template to the first end of the state's words."""

    def __init__(self, sequences: list[list[bytes]]):
        self.next: list[dict[bytes, int]] = [{}]
        self.link, self.length, self.ends = [-1], [0], [{}]
        for number, sequence in enumerate(sequences):
            last = 0
            for place, word in enumerate(sequence):
                last = self._extend(last, word)
                self.ends[last].setdefault(number, place)
        # a shorter suffix ends wherever a longer one does; its first end is the smallest
        for state in sorted(range(1, len(self.next)), key=self.length.__getitem__, reverse=True):
            up = self.ends[self.link[state]]
            for number, place in self.ends[state].items():
                up[number] = min(place, up.get(number, place))

    def _state(self, length: int, moves: dict[bytes, int], link: int) -> int:
        self.next.append(moves), self.link.append(link), self.length.append(length), self.ends.append({})
        return len(self.next) - 1

    def _split(self, state: int, word: bytes) -> int:
        """The state behind `word` from `state` with just one word more: itself, or a new one that takes over."""
        target = self.next[state][word]
        if self.length[target] == self.length[state] + 1:
            return target
        clone = self._state(self.length[state] + 1, dict(self.next[target]), self.link[target])
        self.link[target] = clone
        while state >= 0 and self.next[state].get(word) == target:
            self.next[state][word] = clone
            state = self.link[state]
        return clone

    def _extend(self, last: int, word: bytes) -> int:
        if word in self.next[last]:
            return self._split(last, word)
        new = self._state(self.length[last] + 1, {}, 0)
        while last >= 0 and word not in self.next[last]:
            self.next[last][word] = new
            last = self.link[last]
        self.link[new] = self._split(last, word) if last >= 0 else 0
        return new

    def runs(self, words: list[bytes], least: int) -> Iterator[tuple[int, int, int]]:
        """(state, end, length) of all runs of `least` words or more that the next word doesn't lengthen."""
        state = length = 0
        known, moves = self.next[0], self.next
        for at, word in enumerate(words):
            if length == 0 and word not in known:
                continue
            if word in moves[state]:
                state, length = moves[state][word], length + 1
                continue
            if length >= least:
                yield state, at - 1, length
            while state and word not in moves[state]:
                state = self.link[state]
            length = min(length, self.length[state])
            if word in moves[state]:
                state, length = moves[state][word], length + 1
        if length >= least:
            yield state, len(words) - 1, length


def chains(automaton: Automaton, words: list[bytes], sizes: list[int], least: int, gap: int) -> list[tuple[int, int, int, float]]:
    """(template, first word, last word, covered share) of all chains, in the order of their ends."""
    open_: dict[int, list[int]] = {}
    done = []

    def close(number: int) -> None:
        first, last, _, covered = open_.pop(number)
        done.append((number, first, last, covered / sizes[number]))

    for state, end, length in automaton.runs(words, least):
        for number, place in automaton.ends[state].items():
            size = min(length, place + 1)
            chain = open_.get(number)
            if chain and end - size - chain[1] <= gap and place > chain[2]:
                fresh = min(size, place - chain[2], end - chain[1])
                chain[1], chain[2], chain[3] = end, place, chain[3] + fresh
            else:
                if chain:
                    close(number)
                open_[number] = [end - size + 1, end, place, size]
    for number in list(open_):
        close(number)
    return done


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """Starts of a phrase among words."""
    size = len(phrase)
    return [k for k, w in enumerate(words) if w == phrase[0] and words[k : k + size] == phrase]


SCANNED = (
    "doc_id long, n_words long, base array<struct<label:string,first:long>>, "
    "spans array<struct<label:string,first:long,last:long,share:double>>"
)


def _scanned(templates, phrases, least: int, gap: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sequences = [words_of(t) for _, t in templates]
        automaton, sizes = Automaton(sequences), [len(s) for s in sequences]
        wanted = [(words_of(p), p.encode(), label) for p, label in phrases.items()]
        kinds = [pa.int64(), pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64())])), pa.list_(pa.struct(
            [("label", pa.string()), ("first", pa.int64()), ("last", pa.int64()), ("share", pa.float64())]))]
        for batch in batches:
            rows = [], [], []
            for text in batch.column("text").to_pylist():
                words = words_of(text)
                joined = b" ".join(words)
                base = [{"label": label, "first": k} for phrase, plain, label in wanted if plain in joined for k in places(words, phrase)]
                spans = [{"label": templates[t][0], "first": a, "last": b, "share": s} for t, a, b, s in chains(automaton, words, sizes, least, gap)]
                rows[0].append(len(words)), rows[1].append(base), rows[2].append(spans)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(r, k) for r, k in zip(rows, kinds, strict=True))],
                                             names=["doc_id", "n_words", "base", "spans"])

    return run


def scan(docs: DataFrame, templates=TEMPLATES, phrases=None, least: int = LEAST, gap: int = GAP) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, base places of phrases, and all chains with their covered share."""
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return rows.mapInArrow(_scanned(templates, PHRASES if phrases is None else phrases, least, gap), SCANNED)


def digest(scanned: DataFrame, share: float = SHARE) -> DataFrame:
    """One row per document: counts and labels of the base, labels of base and chains together, the best share."""
    base = F.array_sort(F.array_distinct(F.col("base.label")))
    found = F.transform(F.filter("spans", lambda s: s["share"] >= share), lambda s: s["label"])
    best = F.coalesce(F.array_max(F.col("spans.share")), F.lit(0.0))
    return scanned.select(
        "doc_id", "n_words", F.size("base").cast("long").alias("n_base"), F.array_min(F.col("base.first")).alias("first_word"),
        F.array_max(F.col("base.first")).alias("last_word"), F.array_join(base, ",").alias("base_labels"),
        F.array_join(F.array_sort(F.array_distinct(F.concat(F.col("base.label"), found))), ",").alias("labels"),
        F.least(F.lit(1.0), F.greatest(F.when(F.size("base") > 0, F.lit(1.0)).otherwise(F.lit(0.0)), best)).alias("score"))
