"""License scans: a generalised suffix automaton of licence tokens, streamed over whole files.

Documents give matching statistics against the automaton of all templates; long matches are
chained into covered spans of a template. The automaton is built from the fixed templates below,
so what is sent to executors does not grow with the data.

Defined results: null and empty texts have no words, no matches, empty labels and score 0;
repeated rows give repeated results; columns beyond doc_id and text are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillsieve.llm.automaton import SuffixAutomaton
from quillsieve.llm.shared import small_batches

# Phrases whose consecutive words count as base matches, with their labels.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Notices of public licences by label, each with the words in it that no sibling of the licence has.
TEMPLATES = {
    "agpl-3": [
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["affero", "version 3"]),
    ],
    "apache-2": [
        ("Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ["version 2"]),
        ("Licensed under the Apache License, Version 2.0.", ["version 2"]),
    ],
    "bsd-2-clause": [
        ("Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", ["redistributions in binary form"]),
    ],
    "bsd-3-clause": [
        ("Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", ["endorse or promote products"]),
    ],
    "cc-by": [
        ("This work is licensed under a Creative Commons Attribution 4.0 International License.", ["attribution 4"]),
        ("Licensed under CC BY 4.0.", ["by 4"]),
    ],
    "cc-by-nc": [
        ("This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", ["noncommercial 4"]),
        ("Licensed under CC BY-NC 4.0.", ["nc 4"]),
    ],
    "cc-by-nc-sa": [
        ("This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.", ["noncommercial sharealike"]),
        ("Licensed under CC BY-NC-SA 4.0.", ["nc sa"]),
    ],
    "cc-by-nd": [
        ("This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License.", ["attribution noderivatives"]),
        ("Licensed under CC BY-ND 4.0.", ["by nd"]),
    ],
    "cc-by-sa": [
        ("This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", ["attribution sharealike"]),
        ("Licensed under CC BY-SA 4.0.", ["by sa"]),
    ],
    "cc0-1": [
        ("To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", ["waived all copyright"]),
        ("CC0 1.0 Universal Public Domain Dedication", ["cc0 1"]),
    ],
    "gpl-2": [
        ("This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", ["gnu general", "version 2"]),
    ],
    "gpl-3": [
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["gnu general", "version 3"]),
    ],
    "isc": [
        ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", ["with or without fee"]),
    ],
    "lgpl-2.1": [
        ("This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", ["lesser", "version 2 1"]),
    ],
    "lgpl-3": [
        ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", ["lesser", "version 3"]),
    ],
    "mit": [
        ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:", ["free of charge"]),
        ("Released under the MIT License.", ["mit"]),
        ("Licensed under the MIT License.", ["mit"]),
    ],
    "mpl-2": [
        ("This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.", ["v 2 0"]),
    ],
    "unlicense": [
        ("This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.", ["free and unencumbered software"]),
    ],
}

#: A licence whose notices hold another's whole: the other's label goes.
HOLDS = {"bsd-3-clause": "bsd-2-clause"}

#: Lower-cases A-Z; makes every byte that is no word byte a space. Word bytes: 0-9, a-z, all above 0x7F.
_WORD = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))


def words(text: bytes | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of a text in lower case."""
    return text.translate(_WORD).split() if text else []


@dataclass
class Scanner:
    """The automaton with what its states say of templates and phrases."""

    min_match: int = 4
    min_cover: float = 0.5
    max_gap: int = 12

    def __post_init__(self) -> None:
        self.ids: dict[bytes, int] = {}
        sequences = [(label, [self.ids.setdefault(w, len(self.ids)) for w in words(text.encode())]) for label, texts in TEMPLATES.items() for text, _ in texts]
        telling = [[[self.ids[w] for w in words(x.encode())] for x in own] for texts in TEMPLATES.values() for _, own in texts]
        # Of each template the places (first and last word) of the words that tell it from its siblings.
        self.telling = [[next((k, k + len(x) - 1) for k in range(len(tokens)) if tokens[k : k + len(x)] == x) for x in own] for (_, tokens), own in zip(sequences, telling, strict=True)]
        self.phrases = [(label, [self.ids.setdefault(w, len(self.ids)) for w in words(text.encode())]) for text, label in PHRASES.items()]
        sequences += self.phrases
        self.telling += [[(0, len(x) - 1)] for _, x in self.phrases]
        self.labels, self.sizes = [x for x, _ in sequences], [len(x) for _, x in sequences]
        self.sam = SuffixAutomaton(keep_owners=True)
        n = len(self.ids)
        self.pairs = np.zeros(n * n, dtype=bool)
        for k, (_, tokens) in enumerate(sequences):
            self.sam.add(tokens, owner=k)
            self.pairs[np.array(tokens[:-1]) * n + np.array(tokens[1:])] = True
        self.sam.finish()
        self.ends: list[list[int]] = [[] for _ in self.sam.length]  # phrases that end a state's longest string
        roots = {}
        for k, (_, tokens) in enumerate(self.phrases):
            *_, (state, _) = self.sam.matches(tokens)
            roots.setdefault(state, []).append(k)
        for s in range(1, len(self.ends)):
            p = s
            while p > 0:
                self.ends[s] += roots.get(p, [])
                p = self.sam.link[p]

    def runs(self, found: list[bytes]) -> Iterator[tuple[int, list[int]]]:
        """Stretches in which every two neighbours are neighbours in some template: no longer match leaves one."""
        if len(found) < 2:
            return
        tokens = np.fromiter((self.ids.get(w, -1) for w in found), dtype=np.int64, count=len(found))
        known = (tokens[:-1] >= 0) & (tokens[1:] >= 0)
        good = np.zeros(len(found) + 1, dtype=bool)
        at = np.flatnonzero(known)
        good[1 + at] = self.pairs[tokens[at] * len(self.ids) + tokens[at + 1]]
        edges = np.flatnonzero(good[1:] != good[:-1])
        for start, end in zip(edges[::2], edges[1::2], strict=True):  # good pairs start..end-1, so words start..end
            yield int(start), tokens[start : end + 1].tolist()

    def scan(self, found: list[bytes]) -> tuple[list[tuple[int, int]], list[tuple[int, int, int, int]]]:
        """Base matches (phrase, first word) and matches (first word, length, state) no longer one contains."""
        base, spans = [], []
        for start, tokens in self.runs(found):
            open_at = None
            for k, (state, size) in enumerate(self.sam.matches(tokens)):
                base += [(p, start + k + 1 - len(self.phrases[p][1])) for p in self.ends[state] if len(self.phrases[p][1]) <= size]
                first = start + k + 1 - size
                if open_at is not None and first != open_at[0]:
                    spans.append(open_at)
                    open_at = None
                if size >= self.min_match:
                    open_at = (first, size, state)
            if open_at is not None:
                spans.append(open_at)
        return base, spans

    def chain(self, spans: list[tuple[int, int, int]]) -> dict[int, float]:
        """For each template the largest share that a chain of its matches covers: in order in both, small gaps.

        Only chains count that match all words which tell the template from its siblings, each in one match.
        """
        best: dict[int, float] = {}
        open_chains: dict[int, tuple[int, int, int, frozenset]] = {}  # template: last document word, last template word, covered, told
        for first, size, state in spans:
            for t, end in (self.sam.owners[state] or {}).items():
                last = open_chains.get(t)
                begin = end + 1 - size
                told = frozenset(k for k, (a, b) in enumerate(self.telling[t]) if begin <= a and b <= end)
                if last and first - last[0] <= self.max_gap and begin > last[1] - size and end > last[1]:
                    covered, told = last[2] + min(size, end - last[1]), last[3] | told
                else:
                    covered = size
                open_chains[t] = (first + size, end, covered, told)
                if len(told) == len(self.telling[t]):
                    best[t] = max(best.get(t, 0.0), min(1.0, covered / self.sizes[t]))
        return best

    def digest(self, text: bytes | None) -> tuple:
        found = words(text)
        base, spans = self.scan(found)
        cover = self.chain(spans)
        base_labels = {self.phrases[p][0] for p, _ in base}
        labels = base_labels | {self.labels[t] for t, share in cover.items() if share >= self.min_cover}
        labels -= {less for more, less in HOLDS.items() if more in labels}
        starts = [at for _, at in base]
        score = max([float(bool(base)), *cover.values()])
        return (
            len(found), len(base), min(starts, default=None), max(starts, default=None),
            ",".join(sorted(base_labels)), ",".join(sorted(labels)), score,
            [(first, size, round(share, 6), label) for (first, size, state) in spans for label, share in self._of(state, cover)],
        )

    def _of(self, state: int, cover: dict[int, float]) -> list[tuple[str, float]]:
        shares: dict[str, float] = {}
        for t in self.sam.owners[state] or ():
            if t in cover:
                shares[self.labels[t]] = max(shares.get(self.labels[t], 0.0), cover[t])
        return sorted(shares.items())


@lru_cache(maxsize=4)
def scanner(min_match: int, min_cover: float, max_gap: int) -> Scanner:
    return Scanner(min_match, min_cover, max_gap)


SCHEMA = "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, spans array<struct<first_word:long,n_words:long,cover:double,label:string>>"
_ARROW = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()), ("spans", pa.list_(pa.struct([("first_word", pa.int64()), ("n_words", pa.int64()), ("cover", pa.float64()), ("label", pa.string())])))])


def scan_licenses(docs: DataFrame, min_match: int = 4, min_cover: float = 0.5, max_gap: int = 12) -> DataFrame:
    """Per document its words, base matches, labels, score and matched spans (first word, words, template cover, label).

    A match counts for chaining from `min_match` words; a chain may skip `max_gap` words; a
    template whose words are covered to `min_cover`, with all that tell it from its siblings, gives its label.
    """

    small_batches(docs.sparkSession)

    def run(batches):
        scan = scanner(min_match, min_cover, max_gap)
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for at in range(0, batch.num_rows, 1000):
                part = texts.slice(at, 1000)
                rows = list(zip(*[scan.digest(x.as_py()) for x in part], strict=True))
                columns = [ids.slice(at, 1000), *(pa.array(rows[k], type=_ARROW.field(k + 1).type) for k in range(7))]
                spans = [[dict(zip(("first_word", "n_words", "cover", "label"), s, strict=True)) for s in x] for x in rows[7]]
                yield pa.RecordBatch.from_arrays([*columns, pa.array(spans, type=_ARROW.field(8).type)], schema=_ARROW)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary")).mapInArrow(run, SCHEMA)
