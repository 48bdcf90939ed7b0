"""License texts and notices, found by conditional compression and confirmed by wording.

A candidate block is a run of lines that mention a license or are made of license words.
In it are places where a template may stand: for whole texts, stretches as long as the text
in which enough of its rare three-word sequences lie at their distances; for short notices,
windows of words round each mention. A template whose words a place can't hold is passed
over. The words of each place are compressed alone and with the place's template as a raw
zstandard dictionary, and places are ranked by the bytes that saves. They are confirmed in
that order by comparing words: a place counts if it repeats enough of the template and no
difference touches a word that tells licenses apart (a version, ``affero``, ...). Of notices
that save nearly as much as the best one, that with fewest words left over is named. What is
reported are the winner, its reduction and the exact differences.

Blocks are made of one document's lines. Nothing is shuffled, and whole texts are
searched. A block longer than ``BLOCK_WORDS``, or than four of the longest texts, is cut
into stretches that overlap by more than the longest text, so that no notice is lost. A
place is compressed and compared once, however many texts a file bundles.

Edge cases: null and empty texts have no blocks. Repeated rows each get their results.
Spans count code points, end exclusive. The bytes are those of the words of the span,
compressed without and with the template. Other columns are not read.
"""

from __future__ import annotations

import difflib
import re
from bisect import bisect_left, bisect_right
from collections import Counter
from collections.abc import Iterator
from importlib import resources
from itertools import accumulate
from typing import NamedTuple

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: License name -> notices and texts by which it is granted, as their publishers word them.
#: Fixed values.
TEMPLATES: dict[str, list[str]] = {
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this '
        "file except in compliance with the License. You may obtain a copy of the License at "
        "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed "
        'to in writing, software distributed under the License is distributed on an "AS IS" '
        "BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the "
        "License for the specific language governing permissions and limitations under the License.",
    ],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License."],
    "CC-BY-4.0": [
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    ],
    "CC-BY-NC-4.0": [
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 "
        "International License.",
    ],
    "GPL-3.0": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms "
        "of the GNU General Public License as published by the Free Software Foundation, either "
        "version 3 of the License, or (at your option) any later version.",
    ],
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this "
        'software and associated documentation files (the "Software"), to deal in the Software '
        "without restriction, including without limitation the rights to use, copy, modify, "
        "merge, publish, distribute, sublicense, and/or sell copies of the Software, and to "
        "permit persons to whom the Software is furnished to do so, subject to the following "
        "conditions:",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If "
        "a copy of the MPL was not distributed with this file, You can obtain one at "
        "http://mozilla.org/MPL/2.0/.",
    ],
}

_CREATIVE_COMMONS = {
    "BY-SA": "Attribution-ShareAlike",
    "BY-ND": "Attribution-NoDerivatives",
    "BY-NC-SA": "Attribution-NonCommercial-ShareAlike",
    "BY-NC-ND": "Attribution-NonCommercial-NoDerivatives",
}
for _code, _name in _CREATIVE_COMMONS.items():
    TEMPLATES[f"CC-{_code}-4.0"] = [
        f"Licensed under CC {_code} 4.0.",
        f"This work is licensed under a Creative Commons {_name} 4.0 International License.",
    ]
_GNU = {
    "GPL": ("program", "GNU General Public License", ("2", "3")),
    "LGPL": ("library", "GNU Lesser General Public License", ("2.1", "3")),
    "AGPL": ("program", "GNU Affero General Public License", ("3",)),
}
for _code, (_kind, _name, _versions) in _GNU.items():
    for _version in _versions:
        _grants = [
            f"This {kind} is free software{mark} you can redistribute it and/or modify it under the "
            f"terms of the {_name} as published by the Free Software Foundation{end}"
            for kind, mark in {(_kind, ":"), (_kind, ";"), ("program", ":")}
            for end in (
                f", either version {_version} of the License, or (at your option) any later version.",
                f"; either version {_version} of the License, or (at your option) any later version.",
                f", version {_version} of the License.",
            )
        ]
        _full = _version if "." in _version else f"{_version}.0"
        TEMPLATES.setdefault(f"{_code}-{_full}", []).extend(
            [f"This work is licensed under the {_name}, version {_version}.", *sorted(_grants)]
        )
TEMPLATES["LGPL-2.0"] = [
    "This library is free software; you can redistribute it and/or modify it under the terms of "
    "the GNU Library General Public License as published by the Free Software Foundation; either "
    "version 2 of the License, or (at your option) any later version.",
]
TEMPLATES["MPL-1.1"] = [
    'The contents of this file are subject to the Mozilla Public License Version 1.1 (the "License"); '
    "you may not use this file except in compliance with the License.",
]
TEMPLATES["CC0-1.0"] = [
    "To the extent possible under law, the person who associated CC0 with this work has waived all "
    "copyright and related or neighboring rights to this work.",
    "Released under the CC0 1.0 Universal License.",
]
TEMPLATES["ISC"] = ["Released under the ISC License."]
TEMPLATES["Unlicense"] = [
    "Released under the Unlicense.",
    "This is free and unencumbered software released into the public domain.",
]
# The publishers' whole texts, and the identifiers.
for _file in (resources.files("airtide.llm") / "licenses").iterdir():
    TEMPLATES[_file.name.removesuffix(".txt")].append(_file.read_text(encoding="utf-8"))
for _name, _notices in TEMPLATES.items():
    _kinds = ("", "-only", "-or-later", "+") if "GPL" in _name else ("",)
    _notices += [f"SPDX-License-Identifier: {_name}{kind}" for kind in _kinds]
    if len(_kinds) == 1:
        _notices.append(f"Licensed under the {_name.replace('-', ' ', 1)} license.")

#: A line with one of these starts a block.
MENTIONS = (
    "licen", "permission is hereby", "permission to use", "redistribution and use", "spdx",
    "creative commons", "public domain", "cc0",
)
#: A neighbouring line belongs to a block if this share of its words are template words.
VOCABULARY_SHARE = 0.6
MIN_WORDING = 0.8
BLOCK_WORDS = 1000
#: Notices of more words are texts, looked for in a whole block.
NOTICE_WORDS = 100
#: A text may stand where this share of its rare sequences lies; such occur a few times.
MIN_ANCHORS = 0.25
RARE = 4
#: Notices that save so much of what the best saves are all compared.
NEAR_BEST = 0.9
#: Words that tell licenses apart, in notices and texts; and in notices all versions.
TELLING = {
    "affero", "lesser", "library", "noncommercial", "sharealike", "noderivatives", "noderivs",
    "attribution", "endorse", "apache", "mozilla", "mit", "isc", "bsd", "gnu",
}
_WORD = re.compile(r"[^\W_]+(?:[-.][^\W_]+)*")
_VERSION = re.compile(r"v?\d{1,2}(?:\.\d+)*|.*-\d.*|\d-clause|by(?:-\w+)*")
_LINE = re.compile(r"[^\n]+")

FOUND = T.StructType(
    [
        T.StructField("start", T.LongType()),
        T.StructField("end", T.LongType()),
        T.StructField("license", T.StringType()),
        T.StructField("plain_bytes", T.LongType()),
        T.StructField("with_template_bytes", T.LongType()),
        T.StructField("reduction", T.DoubleType()),
        T.StructField("wording", T.DoubleType()),
        T.StructField("exact", T.BooleanType()),
        T.StructField("differences", T.StringType()),
    ]
)


class Template:
    """A notice or text of a license, with a compressor that has it as its dictionary."""

    def __init__(self, name: str, words: list[str], bag: Counter, compressor):
        self.name, self.words, self.bag, self.compressor = name, words, bag, compressor
        self.is_text = len(words) > NOTICE_WORDS
        self.n_rare = 0


class Place(NamedTuple):
    """Words ``first`` to ``last`` (exclusive) of a block, where a template may stand."""

    first: int
    last: int
    template: Template
    data: bytes = b""


def _overlap(place: Place, other: Place) -> bool:
    """Whether most of one of them lies in the other."""
    shared = min(place.last, other.last) - max(place.first, other.first)
    return 2 * shared > min(place.last - place.first, other.last - other.first)


def _rare_sequences(texts: list[Template]) -> dict[tuple, list[tuple[Template, int]]]:
    """Three words -> (text, place) for sequences that a text holds a few times at most."""
    anchors: dict[tuple, list[tuple[Template, int]]] = {}
    for text in texts:
        places: dict[tuple, list[int]] = {}
        for at, sequence in enumerate(zip(text.words, text.words[1:], text.words[2:])):
            places.setdefault(sequence, []).append(at)
        for sequence, found in places.items():
            if len(found) <= RARE:
                text.n_rare += len(found)
                anchors.setdefault(sequence, []).extend((text, at) for at in found)
    return anchors


def _equal_blocks(a: list[str], b: list[str]) -> list[difflib.Match]:
    """Matching blocks in order; around sequences that both hold once, then between them."""
    if len(b) <= NOTICE_WORDS:
        return _matches(a, b, 0, 0)
    chain: list[tuple[int, int]] = []
    tails: list[int] = []  # longest rising chain of (place in a, place in b)
    back: list[int] = []
    ends: list[int] = []
    pairs = _once_in_both(a, b)
    for k, (_, at) in enumerate(pairs):
        i = bisect_left(tails, at)
        back.append(ends[i - 1] if i else -1)
        tails[i : i + 1], ends[i : i + 1] = [at], [k]
    k = ends[-1] if ends else -1
    while k >= 0:
        chain.append(pairs[k])
        k = back[k]
    blocks: list[difflib.Match] = []
    x = y = 0
    for i, j in reversed(chain):
        if i < x or j < y:
            if blocks and i - blocks[-1].a == j - blocks[-1].b and i + _ANCHOR > x:
                grown = i + _ANCHOR - blocks[-1].a
                blocks[-1] = blocks[-1]._replace(size=grown)
                x, y = blocks[-1].a + grown, blocks[-1].b + grown
            continue
        blocks += _matches(a[x:i], b[y:j], x, y)
        blocks.append(difflib.Match(i, j, _ANCHOR))
        x, y = i + _ANCHOR, j + _ANCHOR
    return blocks + _matches(a[x:], b[y:], x, y)


_ANCHOR = 4


def _once_in_both(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Places of the sequences that occur once in both, in order of the first."""

    def once(words: list[str]) -> dict[tuple, int]:
        found: dict[tuple, int] = {}
        for at, sequence in enumerate(zip(*(words[i:] for i in range(_ANCHOR)))):
            found[sequence] = -1 if sequence in found else at
        return {sequence: at for sequence, at in found.items() if at >= 0}

    in_b = once(b)
    return [(at, in_b[sequence]) for sequence, at in once(a).items() if sequence in in_b]


def _matches(a: list[str], b: list[str], x: int, y: int) -> list[difflib.Match]:
    if not a or not b:
        return []
    matcher = difflib.SequenceMatcher(None, a, b, autojunk=False)
    return [difflib.Match(m.a + x, m.b + y, m.size) for m in matcher.get_matching_blocks() if m.size]


class LicenseScanner:
    """Find the templates' notices in texts; zstandard objects are made where it runs."""

    def __init__(self, templates: dict[str, list[str]], level: int = 3):
        import zstandard

        def compressor(notice: list[str]):
            words = zstandard.ZstdCompressionDict(
                " ".join(notice).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT
            )
            return zstandard.ZstdCompressor(level=level, dict_data=words)

        self._plain = zstandard.ZstdCompressor(level=level)
        self._notices = {
            name: [[m[0].lower() for m in _WORD.finditer(notice)] for notice in notices]
            for name, notices in templates.items()
        }
        self._bags = [
            Template(name, notice, Counter(notice), compressor(notice))
            for name, notices in self._notices.items()
            for notice in notices
        ]
        self._anchors = _rare_sequences([t for t in self._bags if t.is_text])
        self._vocabulary = {w for notices in self._notices.values() for n in notices for w in n}
        self._overlap = 2 * max(len(n) for notices in self._notices.values() for n in notices)
        self._block_words = max(BLOCK_WORDS, 2 * self._overlap)

    def blocks(self, text: str) -> Iterator[list[tuple[str, int, int]]]:
        """Candidate blocks as lists of (word, start, end)."""
        lower = text.lower()
        if not any(mention in lower for mention in MENTIONS):
            return
        block, mentioned = [], False
        for line in [*_LINE.finditer(text), None]:
            words, mentions, fits = [], False, False
            if line:
                mentions = any(mention in line[0].lower() for mention in MENTIONS)
                words = [(m[0].lower(), *m.span()) for m in _WORD.finditer(text, *line.span())]
                known = sum(word[0] in self._vocabulary for word in words)
                fits = known >= VOCABULARY_SHARE * len(words)
            if line and (mentions or fits):
                block, mentioned = block + words, mentioned or mentions
                continue
            if mentioned:
                step = self._block_words - self._overlap
                for at in range(0, max(1, len(block) - self._overlap), step):
                    yield block[at : at + self._block_words]
            block, mentioned = [], False

    def scan(self, text: str | None) -> list[tuple]:
        found = set()
        for block in self.blocks(text or ""):
            found.update(self._scan_block(block))
        # What a stretch of a block cuts off is whole in the next one.
        out, end = [], 0
        for result in sorted(found, key=lambda f: (f[0], -f[1])):
            if result[1] > end:
                out.append(result)
                end = result[1]
        return out

    def _scan_block(self, block: list) -> Iterator[tuple]:
        may = self._holdable([word[0] for word in block], self._bags)
        texts = [t for t in may if t.is_text]
        notices = [t for t in may if not t.is_text]
        taken = []  # stretches of the block that are whole texts
        if texts:
            for _, place in self._ranked(self._text_places(block, texts)):
                if not any(_overlap(place, other) for other in taken):
                    if hit := self._confirmed(block, place):
                        yield hit[0]
                        taken.append(Place(hit[1], hit[2], place.template))
        done = 0
        for place in [*sorted(taken, key=lambda t: t.first), None]:
            yield from self._scan_notices(block[done : place.first if place else None], notices)
            done = place.last if place else done

    def _text_places(self, block: list, texts: list[Template]) -> list[Place]:
        """Stretches in which a text's rare sequences lie near one diagonal."""
        words = [word[0] for word in block]
        wanted = {id(t) for t in texts}
        hits: dict[int, list[tuple[int, int]]] = {}
        for at, sequence in enumerate(zip(words, words[1:], words[2:])):
            for template, offset in self._anchors.get(sequence, ()):
                if id(template) in wanted:
                    hits.setdefault(id(template), []).append((at - offset, at))
        places = []
        for template in texts:
            found = np.array(sorted(hits.get(id(template), [])), np.int64).reshape(-1, 2)
            n = len(template.words)
            while len(found):
                until = np.searchsorted(found[:, 0], found[:, 0] + n // 2, side="right")
                near = until - np.arange(len(found))
                first = int(near.argmax())
                if near[first] < MIN_ANCHORS * template.n_rare:
                    break
                diagonals = found[first : until[first], 0]
                begin = max(0, int(diagonals[0]) - n // 8)
                end = int(diagonals[-1]) + n + n // 8
                places.append(Place(begin, min(len(block), end), template))
                found = np.delete(found, slice(first, until[first]), axis=0)
        words_of = lambda p: words[p.first : p.last]
        return [Place(p.first, p.last, p.template, " ".join(words_of(p)).encode()) for p in places]

    def _scan_notices(self, block: list, notices: list[Template]) -> Iterator[tuple]:
        words = [word[0] for word in block]
        done = 0
        for i in _mentions(words) if notices else ():
            if i < done:
                continue
            places = []
            for template in notices:
                reach = len(template.words) + max(2, len(template.words) // 4)
                at = max(done, i - reach)
                window = words[at : i + reach + 1]
                if self._holdable(window, [template]):
                    places.append(Place(at, at + len(window), template, " ".join(window).encode()))
            if hit := self._winner(block, places, i):
                yield hit[0]
                done = hit[2]

    def _ranked(self, places: list[Place]) -> list[tuple[int, Place]]:
        """(bytes saved, place), by falling savings."""
        plain = {data: len(self._plain.compress(data)) for data in {p.data for p in places}}
        saved = [(plain[p.data] - len(p.template.compressor.compress(p.data)), p) for p in places]
        return sorted(saved, key=lambda s: (-s[0], -len(s[1].template.words), s[1].first))

    def _winner(self, block: list, places: list[Place], mention: int) -> tuple | None:
        """The first by savings that is confirmed; of those near the best, the fullest match."""
        ranked = self._ranked(places)
        if not ranked:
            return None
        near = [p for saved, p in ranked if saved >= NEAR_BEST * ranked[0][0]]
        covers = lambda hit: hit and hit[1] <= mention < hit[2]
        hits = [h for h in (self._confirmed(block, p) for p in near) if covers(h)]
        if hits:
            return max(hits, key=lambda h: h[3])
        later = (self._confirmed(block, p) for _, p in ranked[len(near) :])
        return next((h for h in later if covers(h)), None)

    @staticmethod
    def _holdable(words: list[str], templates: list[Template]) -> list[Template]:
        """The templates of which ``words`` hold as many words as a confirmation takes."""
        have = Counter(words)
        return [
            t
            for t in templates
            if sum(min(n, have[w]) for w, n in t.bag.items()) >= MIN_WORDING * len(t.words)
        ]

    def _confirmed(self, block: list, place: Place) -> tuple | None:
        """(result, first and last word, words explained) if the wording is near enough."""
        window = block[place.first : place.last]
        match = self._compare([word[0] for word in window], place.template.words)
        if not match:
            return None
        wording, matched, first, last, differences = match
        data = " ".join(word[0] for word in window[first:last]).encode()
        plain, size = (len(c.compress(data)) for c in (self._plain, place.template.compressor))
        result = (
            window[first][1],
            window[last - 1][2],
            place.template.name,
            plain,
            size,
            1 - size / plain,
            wording,
            not differences,
            differences,
        )
        explained = (matched, wording, plain - size)
        return result, place.first + first, place.first + last, explained

    def _compare(self, words: list[str], notice: list[str]) -> tuple | None:
        """Share of a notice's words that a block has in order, where, and what differs."""
        equal = _equal_blocks(words, notice)
        if not equal:
            return None
        anchor = max(equal, key=lambda m: m.size)
        # Other matches count if they are as near to the anchor as the notice is long.
        near = [
            m
            for m in equal
            if abs((m.a - anchor.a) - (m.b - anchor.b)) <= max(2, len(notice) // 4)
        ]
        matched = sum(m.size for m in near)
        first, last = near[0].a, near[-1].a + near[-1].size
        inserted = (last - first) - matched
        wording = matched / (len(notice) + inserted)
        if wording < MIN_WORDING:
            return None
        differences, a, b = [], first, 0
        short = len(notice) <= NOTICE_WORDS
        for m in [*near, difflib.Match(last, len(notice), 0)]:
            for word in [*words[a : m.a], *notice[b : m.b]]:
                if word in TELLING or short and _VERSION.fullmatch(word):
                    return None
            if a < m.a:
                differences.append("+" + " ".join(words[a : m.a]))
            if b < m.b:
                differences.append("-" + " ".join(notice[b : m.b]))
            a, b = m.a + m.size, m.b + m.size
        return wording, matched, first, last, "; ".join(differences)


def _mentions(words: list[str]) -> list[int]:
    """The words at which a mention begins."""
    joined = " ".join(words)
    starts = [0, *accumulate(len(word) + 1 for word in words)]
    return sorted(
        {
            bisect_right(starts, m.start()) - 1
            for mention in MENTIONS
            for m in re.finditer(re.escape(mention), joined)
        }
    )


def find_licenses(
    docs: DataFrame, *, text: str = "text", templates: dict[str, list[str]] = TEMPLATES
) -> DataFrame:
    """One row per document: ``row`` (as it was) and ``licenses``, an array of FOUND."""

    shared = docs.sparkSession.sparkContext.broadcast(templates)  # a fixed list

    @F.pandas_udf(T.ArrayType(FOUND))
    def scan(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        scanner = LicenseScanner(shared.value)
        for texts in batches:
            yield texts.map(lambda t: [dict(zip(FOUND.names, f)) for f in scanner.scan(t)])

    out = docs.select(F.struct("*").alias("row"), F.col(f"`{text}`").cast("string").alias("text"))
    return out.select("row", scan(F.coalesce("text", F.lit(""))).alias("licenses"))


def licenses_query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One row per notice found."""
    found = find_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    found = found.select("row.doc_id", F.explode("licenses").alias("found"))
    return found.select("doc_id", "found.*")
