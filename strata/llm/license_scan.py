"""Licence scans with a positional index of rare words.

Licence texts and notices are templates with mandatory key phrases. The index maps each template word to the templates and
places where it stands. A file is looked up by its own words, those of highest IDF first (document frequencies are counted
over all documents): a key phrase's rarest word brings its template in, and for each template so found the rarest LOOK words
that the file shares with it are followed. Each occurrence of such a word and each of its postings propose a place of the
template in the file; proposals are intersected by relative position, so that places stay for which at least half of these
words propose one within the template's slack. There all key phrases must stand, word for word, each within the slack of its
own place.
"""

from __future__ import annotations

import math
from bisect import bisect_left, bisect_right
from collections import Counter
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from strata.llm.common import map_rows, texts

# Lower-cases A-Z and turns every byte outside the word class [^\x00-\x2F\x3A-\x60\x7B-\x7F] into a space.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
#: Rare words of a file that are followed for a template; of a base phrase all are.
LOOK = 6
#: A match of so many words found is worth half of one without end.
EVIDENCE = 10


@dataclass(frozen=True)
class Template:
    """A notice; keys are phrases of it that must stand. base: one of the three phrases whose places are counted."""

    label: str
    text: str
    keys: tuple[str, ...]
    base: bool = False

    def slack(self, n_words: int) -> int:
        """Words by which parts of a template of n_words may be moved against each other: a quarter of it; none in a base phrase."""
        return 0 if self.base else max(4, n_words // 4)


# The phrases of the base rule, and the usual short notices of public licences.
BASE = (
    Template("mit", "MIT License", ("mit license",), True),
    Template("apache", "Apache License", ("apache license",), True),
    Template("gpl", "General Public License", ("general public license",), True),
)
NOTICES = (
    Template("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", ("permission is hereby granted free of charge", "this software and associated documentation files")),
    Template("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", ("distribute this software for any purpose with or without fee is hereby granted",)),
    Template("apache-2.0", "Licensed under the Apache License, Version 2.0", ("apache license version 2 0",)),
    Template("gpl-2.0", "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", ("gnu general public license", "version 2 of the license")),
    Template("gpl-2.0", "licensed under the GNU General Public License, version 2", ("gnu general public license version 2",)),
    Template("gpl-3.0", "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", ("gnu general public license", "version 3 of the license")),
    Template("gpl-3.0", "licensed under the GNU General Public License, version 3", ("gnu general public license version 3",)),
    Template("lgpl", "under the terms of the GNU Lesser General Public License", ("gnu lesser general public license",)),
    Template("agpl-3.0", "under the terms of the GNU Affero General Public License", ("gnu affero general public license",)),
    Template("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met", ("redistribution and use in source and binary forms", "the following conditions are met")),
    Template("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", ("mozilla public license v 2 0",)),
    Template("cc0-1.0", "To the extent possible under law, the author has dedicated all copyright to the public domain under CC0 1.0", ("cc0 1 0",)),
    Template("cc-by-4.0", "Licensed under CC BY 4.0", ("cc by 4 0",)),
    Template("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0", ("cc by sa 4 0",)),
    Template("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0", ("cc by nc 4 0",)),
    Template(
        "mit",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, "
        "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
        "subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
        "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. "
        "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
        "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
        ("to deal in the software without restriction", "the software is provided as is", "arising from out of or in connection with the software"),
    ),
    Template(
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. "
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, "
        "NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
        ("the author disclaims all warranties with regard to this software", "resulting from loss of use data or profits"),
    ),
    Template(
        "bsd",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, "
        "this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other "
        "materials provided with the distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF "
        "MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.",
        ("redistributions in binary form must reproduce the above copyright notice", "are disclaimed"),
    ),
    Template(
        "bsd-3-clause",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
        ("to endorse or promote products derived from this software without specific prior written permission",),
    ),
    Template(
        "zlib",
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
        "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions: "
        "The origin of this software must not be misrepresented; you must not claim that you wrote the original software.",
        ("to alter it and redistribute it freely", "the origin of this software must not be misrepresented"),
    ),
    Template("unlicense", "This is free and unencumbered software released into the public domain", ("free and unencumbered software released into the public domain",)),
)


def split_words(text: str) -> list[bytes]:
    return text.encode("utf-8", "replace").translate(FOLD).split()


@dataclass
class Index:
    """word -> template -> its places there; of each template the place of each key phrase."""

    templates: tuple[Template, ...]
    idf: dict[bytes, float] = field(default_factory=dict)

    def __post_init__(self):
        self.words = [split_words(t.text) for t in self.templates]
        self.slack = [t.slack(len(w)) for t, w in zip(self.templates, self.words, strict=True)]
        self.keys = [[tuple(split_words(k)) for k in t.keys] for t in self.templates]
        self.at = [[next(i for i in range(len(w)) if tuple(w[i : i + len(k)]) == k) for k in ks] for w, ks in zip(self.words, self.keys, strict=True)]
        self.postings: dict[bytes, dict[int, list[int]]] = {}
        for t, w in enumerate(self.words):
            for q, x in enumerate(w):
                self.postings.setdefault(x, {}).setdefault(t, []).append(q)
        self.vocabulary = frozenset(self.postings)
        # a key phrase is looked up by its rarest word, a template by that of its first key phrase
        self.rarest = [[max(range(len(k)), key=lambda i, k=k: (self.rarity(k[i]), -i)) for k in ks] for ks in self.keys]
        self.brings: dict[bytes, list[int]] = {}
        for t, (ks, rs) in enumerate(zip(self.keys, self.rarest, strict=True)):
            self.brings.setdefault(ks[0][rs[0]], []).append(t)
        self.needed = [frozenset(x for k in ks for x in k) for ks in self.keys]

    def rarity(self, word: bytes) -> float:
        return self.idf.get(word, math.inf)

    def followed(self, has: set[bytes]) -> dict[int, list[bytes]]:
        """Of each template that the file's words bring in the words to follow: the rarest ones that both have."""
        found: dict[int, list[bytes]] = {t: [] for x in has if x in self.brings for t in self.brings[x] if self.needed[t] <= has}
        for x in sorted(has, key=lambda x: (-self.rarity(x), x)) if found else ():
            here = self.postings[x]
            for t, follow in found.items():
                if t in here and (self.templates[t].base or len(follow) < LOOK):
                    follow.append(x)
        return found

    def agreed(self, t: int, follow: list[bytes], where: dict[bytes, list[int]]) -> list[tuple[int, int]]:
        """Ranges of places of the template for which enough of the words propose one within the slack."""
        slack, steps = self.slack[t], []
        for x in follow:
            end = None
            for o in sorted({p - q for p in where[x] for q in self.postings[x][t]}):
                if end is None or o - slack > end + 1:
                    if end is not None:
                        steps.append((end + 1, -1))
                    steps.append((o - slack, 1))
                end = o + slack
            if end is not None:
                steps.append((end + 1, -1))
        enough, n, start, ranges = len(follow) if not slack else (len(follow) + 1) // 2, 0, None, []
        for at, step in sorted(steps):  # ends come first at a place
            n += step
            if n >= enough and start is None:
                start = at
            elif n < enough and start is not None:
                ranges.append((start, at - 1))
                start = None
        return ranges

    def matches(self, t: int, follow: list[bytes], where: dict[bytes, list[int]], words: list[bytes]) -> list[int]:
        """Where the first key phrase of a template stands at an agreed place, with the other key phrases near theirs: in order."""
        ranges = self.agreed(t, follow, where)
        if not ranges:
            return []
        slack, starts, keys = self.slack[t], [a for a, _ in ranges], []
        for k, r, at in zip(self.keys[t], self.rarest[t], self.at[t], strict=True):
            keys.append([p - r - at for p in where[k[r]] if p >= r and tuple(words[p - r : p - r + len(k)]) == k])
        near = lambda places, o: (i := bisect_left(places, o - slack)) < len(places) and places[i] <= o + slack
        inside = lambda o: (i := bisect_right(starts, o)) > 0 and o <= ranges[i - 1][1]
        return [o + self.at[t][0] for o in keys[0] if inside(o) and all(near(x, o) for x in keys[1:])]

    def strength(self, t: int, start: int, words: list[bytes]) -> float:
        """The share of the template's words that stand in the file in its order, each within the slack of the one before;
        less for short templates, so that a name of a licence counts for less than its text."""
        at, found, slack = max(0, start - self.slack[t]), 0, self.slack[t]
        for i, x in enumerate(self.words[t]):
            stop = at + slack + 1 if found else max(0, start + i) + slack + 1
            here = next((p for p in range(at, min(stop, len(words))) if words[p] == x), None)
            if here is not None:
                at, found = here + 1, found + 1
        return found / len(self.words[t]) * found / (found + EVIDENCE)

    def scan(self, words: list[bytes]) -> tuple[list[int], set[str], set[str], float, list[tuple[int, int]]]:
        """Places of the base phrases, their labels, all labels, score, and the (template, start) matches."""
        if self.brings.keys().isdisjoint(words):
            return [], set(), set(), 0.0, []
        alive = self.followed(self.vocabulary.intersection(words))
        where: dict[bytes, list[int]] = {x: [] for t, follow in alive.items() for x in (*follow, *(k[r] for k, r in zip(self.keys[t], self.rarest[t], strict=True)))}
        for p, w in enumerate(words):
            if w in where:
                where[w].append(p)
        base, base_labels, labels, score, found = [], set(), set(), 0.0, []
        for t, follow in sorted(alive.items()):
            best = len(self.words[t]) / (len(self.words[t]) + EVIDENCE)
            for place in self.matches(t, follow, where, words):
                start = place - self.at[t][0]
                found.append((t, max(0, start)))
                labels.add(self.templates[t].label)
                if self.templates[t].base:
                    base.append(place)
                    base_labels.add(self.templates[t].label)
                if score < best:
                    score = max(score, self.strength(t, start, words))
        return sorted(base), base_labels, labels, score, found


def document_frequencies(docs: DataFrame, vocabulary: frozenset[bytes]) -> dict[bytes, float]:
    """IDF of the index's words over all documents; as many rows reach the driver as the index has words."""
    def make():
        def handle(batch):
            seen: Counter = Counter()
            for text in batch["text"]:
                seen.update(vocabulary.intersection(split_words(text)))
                seen[b""] += 1
            yield from seen.items()
        return handle

    rows = map_rows(texts(docs).select("text"), make, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n")).collect()
    n = {bytes(r["word"]): r["n"] for r in rows}
    total = n.pop(b"", 0)
    return {w: math.log(1 + total / (1 + n.get(w, 0))) for w in vocabulary}


def scan_licenses(docs: DataFrame, templates: tuple[Template, ...] = BASE + NOTICES) -> DataFrame:
    """doc_id, n_words, base_places (array), base_labels, labels (arrays, sorted), score and matches of every whole text.

    docs: doc_id, text; other columns are ignored. Whole texts are scanned, however long. A null or empty text has no words
    and no labels, score 0; repeated rows, also of null id, give repeated rows; an empty table gives an empty one. Which words
    are followed depends on the documents, by their frequencies, and on LOOK; parts of a template may be moved against each
    other by its slack. score: of the matches the largest share of a template's words that stand in order, f of them found,
    times f / (f + EVIDENCE). matches: array of (label, first word).
    """
    plain = Index(templates)
    index = Index(templates, document_frequencies(docs, plain.vocabulary))

    def make():
        def handle(batch):
            for doc, text in zip(batch["doc_id"], batch["text"], strict=True):
                words = split_words(text)
                base, base_labels, labels, score, found = index.scan(words)
                yield doc, len(words), base, sorted(base_labels), sorted(labels), score, [{"label": templates[t].label, "first": s} for t, s in found]
        return handle

    return map_rows(texts(docs), make, "doc_id long, n_words long, base_places array<long>, base_labels array<string>, labels array<string>, score double, matches array<struct<label:string,first:long>>")
