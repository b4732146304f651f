"""Licence scans by sentence-rule recognition.

A text is a sequence of lower-case words of letters and digits.  Known licence sentences
become identifiers where their words stand, those of fewer than ``FREE`` words only
between two cuts; cuts are line ends, white space after ``. ! ? ; :`` or a URL, and list
marks at the start of a line.  What stands inside a sentence doesn't matter: a line end
there is white space, and comment marks are no words, so wrapped and commented texts are
recognised as one-line ones are.  The
identifiers of a document, in order, are matched against ordered rules: the identifiers
of a rule in order, at most ``gap`` other sentences between neighbours (these end at
``. ! ?`` and blank lines).  A match that lies inside a longer one counts for the longer
only.  Sentence numbers, as they are reported, count line ends as ends too.

Sentences are recognised by 64-bit hashes over whole batches of text, where two
words begin a known one; only documents with a hit are looked at one by one.  Rules are a fixed table of the program (or the
caller's), not of the data.

Nulls: a null text has no sentences; a null doc_id passes.  Rows that repeat a doc_id
each have a row.  Documents without a licence have empty lists.  Empty tables give empty
results; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .textbytes import BYTE_VALUE, LOWER, SPACE, hash_spans, pieces, spans, sums
from .work import table

GAP = 2
FREE = 16

SENTENCES: dict[str, list[str]] = {
    "apache-short": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the \"License\");", "Licensed under the Apache License, Version 2.0", "Released under the Apache License, Version 2.0."],
    "apache-use": ["you may not use this file except in compliance with the License."],
    "apache-copy": ["You may obtain a copy of the License at", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "apache-basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied."],
    "apache-see": ["See the License for the specific language governing permissions and limitations under the License."],
    "mit-short": ["Released under the MIT License.", "Licensed under the MIT License.", "This project is licensed under the MIT License.", "MIT License", "The MIT License (MIT)"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software."],
    "mit-as-is": ["THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT."],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.", "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer."],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.", "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "gpl3-short": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "Licensed under the GNU GPL v3."],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."],
    "gpl-see": ["See the GNU General Public License for more details."],
    "lgpl-short": ["Licensed under the GNU Lesser General Public License, version 3."],
    "mpl2": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "This Source Code Form is subject to the terms of the Mozilla Public License, v."],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "unlicense": ["This is free and unencumbered software released into the public domain."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0.", "This work is licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "cc-by": ["Licensed under CC BY 4.0.", "This work is licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc0": ["To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.", "SPDX-License-Identifier: CC0-1.0"],
    "reserved": ["All rights reserved."],
    "spdx-apache": ["SPDX-License-Identifier: Apache-2.0"],
    "spdx-mit": ["SPDX-License-Identifier: MIT"],
    "spdx-bsd3": ["SPDX-License-Identifier: BSD-3-Clause"],
    "spdx-gpl3": ["SPDX-License-Identifier: GPL-3.0-or-later", "SPDX-License-Identifier: GPL-3.0-only"],
}


@dataclass(frozen=True)
class Rule:
    license: str
    name: str
    sentences: tuple[str, ...]


RULES = (
    Rule("Apache-2.0", "notice", ("apache-short", "apache-use", "apache-copy", "apache-basis", "apache-see")),
    Rule("Apache-2.0", "short", ("apache-short",)),
    Rule("Apache-2.0", "spdx", ("spdx-apache",)),
    Rule("MIT", "text", ("mit-grant", "mit-notice", "mit-as-is")),
    Rule("MIT", "titled text", ("mit-short", "mit-grant", "mit-notice", "mit-as-is")),
    Rule("MIT", "short", ("mit-short",)),
    Rule("MIT", "spdx", ("spdx-mit",)),
    Rule("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse")),
    Rule("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary")),
    Rule("BSD-3-Clause", "spdx", ("spdx-bsd3",)),
    Rule("GPL-3.0", "short", ("gpl3-short",)),
    Rule("GPL-3.0", "notice", ("gpl-free", "gpl-hope", "gpl-see")),
    Rule("GPL-2.0", "notice", ("gpl2-free", "gpl-hope", "gpl-see")),
    Rule("GPL-3.0", "spdx", ("spdx-gpl3",)),
    Rule("LGPL-3.0", "short", ("lgpl-short",)),
    Rule("MPL-2.0", "notice", ("mpl2",)),
    Rule("ISC", "text", ("isc-grant",)),
    Rule("Unlicense", "text", ("unlicense",)),
    Rule("CC-BY-NC-4.0", "short", ("cc-by-nc",)),
    Rule("CC-BY-4.0", "short", ("cc-by",)),
    Rule("CC-BY-SA-4.0", "short", ("cc-by-sa",)),
    Rule("CC0-1.0", "notice", ("cc0",)),
    Rule("LicenseRef-all-rights-reserved", "short", ("reserved",)),
)

_PLAIN = np.zeros(256, bool)
_PLAIN[48:58] = _PLAIN[65:91] = _PLAIN[97:123] = _PLAIN[128:] = True
_STOP = np.zeros(256, bool)
_STOP[[ord(c) for c in ".!?"]] = True


_PAUSE = np.zeros(256, bool)
_PAUSE[[ord(c) for c in ";:"]] = True
_MARK = np.zeros(256, bool)
_MARK[[ord(c) for c in ".)"]] = True


class Words:
    """The words of a piece: prefix sums of their hashes, rows, sentence numbers and cuts."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        s, e, self.at = spans(_PLAIN[data], off)
        self.n = len(s)
        self.prefix = sums(hash_spans(sums(BYTE_VALUE[LOWER[data]]), s, e))
        self.row = np.searchsorted(self.at, np.arange(self.n), "right") - 1
        before = lambda inside: np.concatenate([[0], np.cumsum(inside)])[s]
        new = lambda number: np.concatenate([[True], (number[1:] != number[:-1]) | (self.row[1:] != self.row[:-1])])[: self.n]
        stop, pause = np.zeros(len(data), bool), np.zeros(len(data), bool)
        stop[:-1] = _STOP[data[:-1]] & SPACE[data[1:]]
        pause[:-1] = _PAUSE[data[:-1]] & SPACE[data[1:]]
        line, stops = before(data == 0x0A), before(stop)
        #: first words of sentences that end at line ends and stops
        self.first = np.flatnonzero(new(line + stops))
        self.sentence = np.cumsum(new(stops) | (np.diff(line, prepend=0) > 1))
        self.cut = new(line + stops) | new(before(pause))
        mark = np.flatnonzero(new(line) & (e - s <= 3))
        mark = mark[mark + 1 < self.n]
        self.cut[mark[_MARK[data[e[mark]]] & SPACE[data[np.minimum(e[mark] + 1, len(data) - 1)]]] + 1] = True
        url = np.flatnonzero(data == 0x3A)
        url = url[url + 2 < len(data)]
        url = url[(data[url + 1] == 0x2F) & (data[url + 2] == 0x2F)]
        if len(url):
            space = np.flatnonzero(SPACE[data])
            after = np.searchsorted(space, url)
            word = np.searchsorted(s, space[after[after < len(space)]])
            self.cut[word[word < self.n]] = True
        self.cut = np.append(self.cut, True)

    def find(self, book: Book) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(first words, words past the last, indexes of names) of known sentences, short ones between cuts, the longest of a name at a word."""
        past = self.at[self.row + 1] if self.n else self.row
        start = np.flatnonzero(np.arange(self.n) + book.head <= past)
        start = start[np.isin(hash_spans(self.prefix, start, start + book.head), book.heads)]
        got: dict[tuple[int, int], int] = {}
        for n, (hashes, names) in book.lengths.items():
            a = start[start + n <= past[start]]
            if n < FREE:
                a = a[self.cut[a] & (self.cut[a + n] | (a + n == past[a]))]
            h = hash_spans(self.prefix, a, a + n)
            on = np.isin(h, hashes)
            for w, name in zip(a[on].tolist(), names[np.searchsorted(hashes, h[on])].tolist()):
                got[w, name] = max(got.get((w, name), 0), w + n)
        found = np.array(sorted((w, end, name) for (w, name), end in got.items()), np.int64).reshape(-1, 3)
        return found[:, 0], found[:, 1], found[:, 2]


class Book:
    """Known sentences by their numbers of words and hashes, and rules over their identifiers."""

    def __init__(self, known: dict[str, list[str]] = SENTENCES, rules: tuple[Rule, ...] = RULES, gap: int = GAP):
        self.gap = gap
        self.names = list(known)
        which, texts = zip(*((k, t) for k, v in enumerate(known.values()) for t in v))
        raw = [t.encode() for t in texts]
        words = Words(np.frombuffer(b"".join(raw), np.uint8), np.concatenate([[0], np.cumsum([len(r) for r in raw])]))
        count = np.diff(words.at)
        self.head = min(2, int(count.min()))
        self.heads = np.unique(hash_spans(words.prefix, words.at[:-1], words.at[:-1] + self.head))
        h = hash_spans(words.prefix, words.at[:-1], words.at[1:])
        self.lengths: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in np.unique(count).tolist():
            hashes, at = np.unique(h[count == n], return_index=True)
            self.lengths[n] = hashes, np.array(which)[count == n][at]
        self.starts: dict[str, list[Rule]] = {}
        for r in rules:
            self.starts.setdefault(r.sentences[0], []).append(r)

    def _next(self, ids: list[str], hits: list[tuple[int, ...]], ends: list[int], want: str) -> list[int]:
        """Where ``want`` stands after one of ``ends`` with no wider gap."""
        out: dict[int, None] = {}
        for at in ends:
            for j in range(at + 1, len(ids)):
                if hits[j][2] - hits[at][3] > self.gap + 1:
                    break
                if ids[j] == want and hits[j][0] > hits[at][1]:
                    out[j] = None
        return sorted(out)

    def match(self, ids: list[str], number: list[int], hits: list[tuple[int, ...]] | None = None) -> list[tuple[str, str, int, int]]:
        """(license, rule, first sentence, last sentence) of the longest matches.  hits: (first and last word, first and last sentence for gaps,
        number of the last sentence); without them each identifier is a sentence as numbered."""
        hits = hits or [(n,) * 5 for n in number]
        got = []
        for k, first in enumerate(ids):
            for rule in self.starts.get(first, ()):
                ends = [k]  # where the part of the rule so far may end
                for want in rule.sentences[1:]:
                    ends = self._next(ids, hits, ends, want)
                if ends:
                    at = ends[0]
                    got.append((rule.license, rule.name, number[k], hits[at][4], len(rule.sentences), hits[k][0], hits[at][1]))
        got.sort(key=lambda g: (g[5], -g[4], g[6]))
        out, reach = [], -1
        for g in got:
            if g[6] > reach:
                out.append(g[:4])
                reach = g[6]
        return out


def licenses(docs: DataFrame, book: Book | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, n_sentences, licenses (distinct, sorted), matches (license, rule, from_sentence, to_sentence)."""
    book = book or Book()
    shape = "doc_id long, n_sentences long, licenses array<string>, matches array<struct<license: string, rule: string, from_sentence: int, to_sentence: int>>"
    match = pa.struct([("license", pa.string()), ("rule", pa.string()), ("from_sentence", pa.int32()), ("to_sentence", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = np.zeros(batch.num_rows, np.int64)
            found: list[list[tuple[str, str, int, int]]] = [[] for _ in range(batch.num_rows)]
            for a, b, data, off in pieces(batch.column(1)):
                words = Words(data, off)
                rows = np.searchsorted(words.first, words.at)
                n[a:b] = np.diff(rows)
                w0, w1, name = words.find(book)
                row, w1 = words.row[w0], w1 - 1
                from_, to = (np.searchsorted(words.first, w, "right") - 1 - rows[row] for w in (w0, w1))
                hits = np.stack([w0, w1, words.sentence[w0], words.sentence[w1], to], 1)
                for r in np.unique(row).tolist():
                    mine = slice(*np.searchsorted(row, [r, r + 1]).tolist())
                    found[a + r] = book.match([book.names[k] for k in name[mine].tolist()], from_[mine].tolist(), list(map(tuple, hits[mine].tolist())))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(n), pa.array([sorted({f[0] for f in x}) for x in found], pa.list_(pa.string())), pa.array([[dict(zip(("license", "rule", "from_sentence", "to_sentence"), f)) for f in x] for x in found], pa.list_(match))],
                ["doc_id", "n_sentences", "licenses", "matches"],
            )

    return docs.select(F.col(key).cast("long").alias("doc_id"), text).mapInArrow(run, shape)


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    got = licenses(table(spark, sf_dir, "documents"))
    return got.select("doc_id", "n_sentences", F.size("matches").cast("long").alias("n_matches"), F.concat_ws(",", "licenses").alias("licenses"), F.to_json("matches").alias("matches"))
