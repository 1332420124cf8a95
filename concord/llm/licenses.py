"""Licence scan with a generalised suffix automaton of licence texts.

The automaton holds every run of words of all templates. Streaming a file through it gives the matching statistics: at
each word the longest run ending there that some template holds. Runs that cannot be extended are matches; matches of
one template that follow each other in file and template, with small gaps, are chained, and the share of the template
that a chain covers decides on a label and a span. A notice that stands at several places has a span for each.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from concord.llm.common import WORDS, id_and_bytes

#: Phrases whose every place is reported, and their labels.
PHRASES = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

#: Notices as their licences ask to put them into files.
TEMPLATES = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
        rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
        persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
        this permission notice shall be included in all copies or substantial portions of the Software.""",
    "apache": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
        with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.""",
    "gpl": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
        version. This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the
        implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.""",
    "bsd": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
        following conditions are met: Redistributions of source code must retain the above copyright notice, this list of
        conditions and the following disclaimer.""",
    "isc": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby
        granted, provided that the above copyright notice and this permission notice appear in all copies.""",
    "mpl": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.""",
    "cc": """This work is licensed under the Creative Commons Attribution 4.0 International License. To view a copy of this
        license, visit http://creativecommons.org/licenses/by/4.0/""",
}

#: Words a match must have, the largest gap (in words, on either side) inside a chain, and the covered share for a label.
LEAST, GAP, COVER = 3, 12, 0.5


def words_of(text: bytes) -> list[bytes]:
    return text.translate(WORDS).split()


class Automaton:
    """Generalised suffix automaton over word numbers (0 is a word of no template)."""

    def __init__(self, templates: list[tuple[str, str]], phrases: dict[str, str]):
        self.vocab: dict[bytes, int] = {}
        self.link, self.length, self.next = [-1], [0], [{}]
        self.templates = [(label, self.numbers(words_of(text.encode()))) for label, text in templates]
        self.phrases = [(label, self.numbers(words_of(text.encode()))) for text, label in phrases.items()]
        for _, numbers in self.templates + self.phrases:
            last = 0
            for w in numbers:
                last = self.extend(last, w)
        n = len(self.link)
        # where in the templates each state's runs end; sets are small, as templates are
        self.ends: list[list[tuple[int, int]]] = [[] for _ in range(n)]
        for t, (_, numbers) in enumerate(self.templates):
            state = 0
            for at, w in enumerate(numbers):
                state = self.next[state][w]
                up = state
                while up > 0:
                    self.ends[up].append((t, at))
                    up = self.link[up]
        # phrases that end with each state's runs: (words, label)
        at_state = {}
        for label, numbers in self.phrases:
            state = 0
            for w in numbers:
                state = self.next[state][w]
            at_state.setdefault(state, []).append((len(numbers), label))
        self.phrase: list[list[tuple[int, str]]] = [[] for _ in range(n)]
        for state in sorted(range(1, n), key=self.length.__getitem__):
            self.phrase[state] = at_state.get(state, []) + self.phrase[self.link[state]]

    def numbers(self, words: list[bytes]) -> list[int]:
        return [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words]

    def clone(self, state: int, length: int) -> int:
        self.link.append(self.link[state])
        self.length.append(length)
        self.next.append(dict(self.next[state]))
        return len(self.link) - 1

    def redirect(self, state: int, word: int, old: int) -> int:
        """A state of its own for the run that ends with `word` after `state`, where `old` also holds longer ones."""
        new = self.clone(old, self.length[state] + 1)
        while state >= 0 and self.next[state].get(word) == old:
            self.next[state][word] = new
            state = self.link[state]
        self.link[old] = new
        return new

    def extend(self, last: int, word: int) -> int:
        old = self.next[last].get(word)
        if old is not None:
            return old if self.length[old] == self.length[last] + 1 else self.redirect(last, word, old)
        new = len(self.link)
        self.link.append(0)
        self.length.append(self.length[last] + 1)
        self.next.append({})
        state = last
        while state >= 0 and word not in self.next[state]:
            self.next[state][word] = new
            state = self.link[state]
        if state >= 0:
            old = self.next[state][word]
            self.link[new] = old if self.length[old] == self.length[state] + 1 else self.redirect(state, word, old)
        return new

    def scan(self, words: list[bytes]) -> tuple[list[tuple[int, str]], list[tuple[int, int, int]]]:
        """Places of phrases (start, label), and maximal matches (last word, words, state)."""
        get = self.vocab.get
        numbers = np.fromiter((get(w, 0) for w in words), np.int32, len(words))
        # a run of one known word between unknown ones can hold neither a phrase nor a match
        known = np.flatnonzero(numbers)
        if len(known) < 2:
            return [], []
        breaks = np.flatnonzero(np.diff(known) > 1)
        starts, stops = np.r_[known[0], known[breaks + 1]], np.r_[known[breaks], known[-1]] + 1
        long = stops - starts >= 2
        places, matches = [], []
        nxt, link, length, phrase = self.next, self.link, self.length, self.phrase
        for a, b in zip(starts[long].tolist(), stops[long].tolist(), strict=True):
            state = size = 0
            for at, w in enumerate(numbers[a:b].tolist(), a):
                to = nxt[state].get(w)
                if to is None:
                    if size >= LEAST:
                        matches.append((at - 1, size, state))
                    while to is None:
                        state = link[state]
                        to = nxt[state].get(w)
                    size = length[state]
                state, size = to, size + 1
                if phrase[state]:
                    places.extend((at - n + 1, label) for n, label in phrase[state] if n <= size)
            if size >= LEAST:
                matches.append((b - 1, size, state))
        return places, matches

    def chains(self, matches: list[tuple[int, int, int]]) -> list[tuple[str, float, int, int]]:
        """Chains that cover enough of a template and do not overlap a better one of it: label, covered share, first word,
        word after the last."""
        by_template = defaultdict(list)
        for at, size, state in matches:
            # the state may stand for shorter runs too; its end places hold the whole match
            for t, end in self.ends[state]:
                by_template[t].append((at - size + 1, at + 1, end - size + 1, end + 1))
        out = []
        for t, parts in by_template.items():
            label, numbers = self.templates[t]
            least, found, waiting = COVER * len(numbers), [], [parts]
            while waiting:
                parts = sorted(waiting.pop())
                if sum(b - a for a, b, _, _ in parts) < least:
                    continue
                taken: list[tuple[int, int, int]] = []  # first word, word after the last, covered words
                for covered, start, stop in sorted(linked(parts, len(numbers)), reverse=True):
                    if covered < least:
                        break
                    i = bisect_left(taken, (start,))
                    if (not i or taken[i - 1][1] <= start) and (i == len(taken) or stop <= taken[i][0]):
                        taken.insert(i, (start, stop, covered))
                if not taken:
                    continue
                found += taken
                # between those taken, chains may have been hidden by better ones that reach over the border
                low = 0
                for high, after, _ in [*taken, (parts[-1][0] + len(numbers) + 1, 0, 0)]:
                    inside = parts[max(0, bisect_left(parts, (low - len(numbers),))) : bisect_left(parts, (high,))]
                    waiting.append([(max(a, low), min(b, high), c + max(0, low - a), d - max(0, b - high)) for a, b, c, d in inside if b > low])
                    low = after
            out += [(label, min(1.0, covered / len(numbers)), start, stop) for start, stop, covered in sorted(found)]
        return out


def linked(parts: list[tuple[int, int, int, int]], size: int) -> list[tuple[int, int, int]]:
    """The best chain that ends with each of the sorted parts, the later one of equals: covered words, first word, word after
    the last."""
    best: list[tuple[int, int]] = []
    first = 0
    for i, (a, b, c, d) in enumerate(parts):
        while parts[first][1] + GAP + size < a:
            first += 1
        most = (b - a, a)
        for j in range(first, i):
            a2, b2, c2, d2 = parts[j]
            if a2 < a and c2 < c and b2 < b and d2 < d and a - b2 <= GAP and c - d2 <= GAP:
                gain = (b - a) - max(0, b2 - a, d2 - c)
                most = max(most, (best[j][0] + gain, best[j][1]))
        best.append(most)
    return [(covered, start, part[1]) for (covered, start), part in zip(best, parts, strict=True)]


@lru_cache(maxsize=4)
def automaton(templates: tuple, phrases: tuple) -> Automaton:
    return Automaton(list(templates), dict(phrases))


SCHEMA = (
    "id long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, "
    "spans array<struct<label: string, score: double, start: long, stop: long>>"
)
SPAN = pa.list_(pa.struct([("label", pa.string()), ("score", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]))


def license_scan(
    df: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    templates: dict[str, str] | None = None,
    phrases: dict[str, str] | None = None,
) -> DataFrame:
    """Per row: words, places of the phrases, labels, a score and the covered spans (in words) of templates.

    One pass without a shuffle. `score` is 1 if a phrase stands in the text, else the largest covered share of a
    template, 0 without a chain. A null text counts as empty (no words, empty label strings, no spans); repeated rows
    give repeated rows; an empty table gives no row.
    """
    templates = tuple((templates or TEMPLATES).items())
    phrases = tuple((phrases or PHRASES).items())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = automaton(templates, phrases)
        for batch in batches:
            rows = []
            for value in batch.column(1):
                words = words_of(value.as_py())
                places, matches = scanner.scan(words)
                spans = scanner.chains(matches) if matches else []
                base = sorted({label for _, label in places})
                starts = [at for at, _ in places]
                score = 1.0 if places else max((s for _, s, _, _ in spans), default=0.0)
                labels = sorted({*base, *(label for label, *_ in spans)})
                rows.append((len(words), len(places), min(starts, default=None), max(starts, default=None), ",".join(base), ",".join(labels), score, [dict(zip(("label", "score", "start", "stop"), s, strict=True)) for s in spans]))
            kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), SPAN]
            columns = [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)]
            names = ["id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "spans"]
            yield pa.RecordBatch.from_arrays([batch.column(0), *columns], names)

    return id_and_bytes(df, id_col, text_col).mapInArrow(run, SCHEMA).withColumnRenamed("id", id_col)
