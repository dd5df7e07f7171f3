"""Licence scans by patience alignment.

Text and template are sequences of lower-case words. A stretch of both is aligned from the words that occur once in
each: of these anchors the longest run that rises in both is kept, and the gaps between kept anchors are aligned in
the same way, where other words may have become unique. Gaps without such words are closed by equal words from their
ends. Coverage is the share of the template's words that are matched; the span reaches from the first to the
last matched word of the densest stretch.

The templates are whole licences, file headers and one-line notices. A whole licence is looked for in parts of about
``PART`` words, each of which must reach the coverage; parts that follow each other in the text are one finding, whose
coverage is of the whole licence. So a document that holds only the later part is found, with a low coverage.
Kin are told apart twice. The phrases that name a licence (name, version, NC, SA) must be among the matched words,
one after the other; templates of at most ``SHORT`` words without such phrases need all their words. And where another
template matches more words of at least half the stretch, the finding goes; kin that match equally many all stay.

Templates meet only texts that can reach the coverage: a text must hold enough of the part's distinct words,
which one dictionary lookup a word and one look at a table of counts decide. Within a text the alignment looks at stretches around the template's words,
``slack`` times the template long, so a notice is found anywhere in a long text, and each place of several.

Defined results: null and empty texts have no findings. Every row is scanned on its own; extra columns pass through.
Templates without words are refused. Findings of one template do not overlap; those of different templates may.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Iterable, Iterator
from importlib.resources import files

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, types as T

from scour.llm.common import fresh

WORD = re.compile(r"[a-z0-9]+(?:[.'-][a-z0-9]+)*")
# Whole licences are looked for in parts of about so many words (short ones in up to three), so a document that holds only some of them is found.
PART = 100
# Templates of so few words need all of them, unless ``REQUIRED`` names the words that count.
SHORT = 12


def _texts() -> dict[str, str]:
    """The whole licence texts that come with the package."""
    folder = files("scour.llm") / "licence_texts"
    return {f.name.removesuffix(".txt"): f.read_text(encoding="utf-8") for f in sorted(folder.iterdir(), key=lambda f: f.name) if f.name.endswith(".txt")}


_GNU = "it under the terms of the GNU {0}General Public License as published by the Free Software Foundation"
# Notices and file headers of public licences, each with the phrases that tell it from its kin.
_NOTICES = {
    "MIT-notice": ("Released under the MIT License.", ["mit license"]),
    "ISC-notice": ("Released under the ISC License.", ["isc license"]),
    "Zlib-notice": ("Released under the zlib License.", ["zlib license"]),
    "BSD-notice": ("Released under the BSD License.", ["bsd license"]),
    "BSD-2-Clause-notice": ("Released under the BSD 2-Clause License.", ["bsd 2-clause"]),
    "BSD-3-Clause-notice": ("Released under the BSD 3-Clause License.", ["bsd 3-clause"]),
    "Apache-2.0-header": (
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at",
        ["apache", "2.0"],
    ),
    "Apache-2.0-notice": ("Licensed under the Apache License, Version 2.0.", ["apache license", "2.0"]),
    "MPL-1.1-notice": ("Licensed under the Mozilla Public License, Version 1.1.", ["mozilla public license", "1.1"]),
    "MPL-2.0-notice": ("Licensed under the Mozilla Public License, Version 2.0.", ["mozilla public license", "2.0"]),
    "MPL-2.0-header": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at",
        ["mozilla public license", "2.0"],
    ),
    "CC0-1.0-notice": ("Licensed under CC0 1.0.", ["cc0 1.0"]),
    **{
        f"{kind}GPL-{version}-{form}": (text, [*words, version])
        for kind, name, versions in (("", "", ("1.0", "2.0", "3.0")), ("L", "Lesser ", ("2.1", "3.0")), ("L", "Library ", ("2.0",)), ("A", "Affero ", ("3.0",)))
        for version in versions
        for form, text, words in (
            (
                "header",
                f"This {'library' if kind == 'L' else 'program'} is free software: you can redistribute it and/or modify {_GNU.format(name)}, "
                f"either version {version.removesuffix('.0')} of the License, or (at your option) any later version.",
                [f"{name}general public".strip().lower()],
            ),
            ("notice", f"{'Licensed' if kind else 'This work is licensed'} under the GNU {name}General Public License, version {version.removesuffix('.0')}.", [f"gnu {name}general public license".lower()]),
        )
    },
    **{f"CC-{kind}-{version}-notice": (f"Licensed under CC {kind} {version}.", [f"cc {kind} {version}"]) for kind in ("BY", "BY-SA", "BY-NC", "BY-ND", "BY-NC-SA", "BY-NC-ND") for version in ("3.0", "4.0")},
    **{
        f"CC-{kind}-4.0-name": (f"Creative Commons {name} 4.0 International Public License", [f"{name} 4.0 international"])
        for kind, name in (
            ("BY", "Attribution"), ("BY-SA", "Attribution-ShareAlike"), ("BY-NC", "Attribution-NonCommercial"), ("BY-ND", "Attribution-NoDerivatives"),
            ("BY-NC-SA", "Attribution-NonCommercial-ShareAlike"), ("BY-NC-ND", "Attribution-NonCommercial-NoDerivatives"),
        )
    },
}
TEMPLATES = _texts() | {name: text for name, (text, _) in _NOTICES.items()}
REQUIRED = {name: phrases for name, (_, phrases) in _NOTICES.items()} | {"BSD-3-Clause": ["endorse"]}


def words_of(text: str) -> list[str]:
    """Words in lower case; a version number loses its v and a last .0."""
    return [_plain(w) for w in WORD.findall(_lowered(text))]


def _plain(word: str) -> str:
    if not (word[0].isdigit() or word[0] == "v" and word[1:2].isdigit()):
        return word
    return word.removeprefix("v").removesuffix(".0")


def rising(values: list[int]) -> list[int]:
    """Indices of a longest strictly increasing subsequence, by patience sorting."""
    tops: list[int] = []
    piles: list[int] = []
    back: list[int] = []
    for i, v in enumerate(values):
        k = bisect_left(tops, v)
        back.append(piles[k - 1] if k else -1)
        if k == len(tops):
            tops.append(v)
            piles.append(i)
        else:
            tops[k], piles[k] = v, i
    out, i = [], piles[-1] if piles else -1
    while i >= 0:
        out.append(i)
        i = back[i]
    return out[::-1]


def aligned(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Pairs of places with equal words, rising in both, by patience alignment."""
    out: list[tuple[int, int]] = []
    gaps = [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_a, in_b = Counter(a[a0:a1]), Counter(b[b0:b1])
        place = {w: j for j, w in enumerate(b[b0:b1], b0) if in_b[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(a[a0:a1], a0) if in_a[w] == 1 and w in place]
        kept = [anchors[k] for k in rising([j for _, j in anchors])]
        out += kept
        edges = [(a0 - 1, b0 - 1), *kept, (a1, b1)]
        if kept:
            gaps += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(edges, edges[1:], strict=False) if i + 1 < k and j + 1 < m]
    return sorted(out)


class Scanner:
    """Templates as sequences of word numbers, in parts."""

    def __init__(self, templates: dict[str, str], coverage: float, slack: float, required: dict[str, list[str]] | None = None):
        self.coverage, self.slack = coverage, slack
        self.numbers: dict[str, int] = {}
        self.templates: dict[str, list[int]] = {}
        self.required: dict[str, list[list[int]]] = {}
        self.parts: list[tuple[str, int, list[int], Counter, float]] = []
        named = REQUIRED if required is None else required
        for name, text in templates.items():
            words = [self.numbers.setdefault(w, len(self.numbers)) for w in words_of(text)]
            if not words:
                raise ValueError(f"template {name} has no words")
            self.templates[name] = words
            phrases = [[self.numbers.get(w, -1) for w in words_of(p)] for p in named.get(name, [])]
            self.required[name] = phrases or ([[w] for w in words] if len(words) <= SHORT else [])
            n = max(1, min(3, 2 * len(words) // PART - 1), len(words) // PART)
            for k in range(n):
                low = k * len(words) // n
                part = words[low : (k + 1) * len(words) // n]
                self.parts.append((name, low, part, Counter(part), -(-coverage * len(part) // 1)))
        self.needed = np.zeros((len(self.numbers), len(self.parts)), np.uint16)
        for p, (_, _, _, needed, _) in enumerate(self.parts):
            for w, n in needed.items():
                self.needed[w, p] = n
        self.least = np.array([least for *_, least in self.parts])

    def findings(self, text: str) -> list[tuple[str, float, int, int]]:
        """(template, coverage, start, end) in code points, by start and template."""
        spans, words = [], []
        for m in WORD.finditer(_lowered(text)):
            words.append(self.numbers.get(_plain(m.group()), -1))
            spans.append(m.span())
        held = Counter(words)
        held.pop(-1, None)
        if sum(held.values()) < self.least.min(initial=1):
            return []
        counts = np.minimum(np.fromiter(held.values(), np.int64, len(held)), 65_535).astype(np.uint16)
        reach = np.minimum(self.needed[np.fromiter(held, np.int64, len(held))], counts[:, None]).sum(0, dtype=np.int64)
        found: dict[str, list] = {}
        for p in np.flatnonzero(reach >= self.least).tolist():
            name, low, part, needed, least = self.parts[p]
            whole = len(part) == len(self.templates[name])
            for i, j, pairs in self._places(words, part, needed, least, name if whole else None):
                found.setdefault(name, []).append((i, low, j, low + len(part), [(a, low + b) for a, b in pairs]))
        chains = [(name, *c) for name, parts in found.items() for c in self._chains(name, parts)]
        chains = [c for c in chains if not any(self._outdone(c, d) for d in chains)]
        return sorted(((name, n / len(self.templates[name]), spans[i][0], spans[j][1]) for name, i, j, n in chains), key=lambda f: (f[2], f[0]))

    def _chains(self, name: str, parts: list) -> Iterator[tuple[int, int, int]]:
        """(first word, last word, matched words) of the parts of one licence that follow each other."""
        open_: list = []
        for i, low, j, high, pairs in [*sorted(parts, key=lambda p: p[:2]), (float("inf"), 0, 0, 0, [])]:
            if open_ and low >= open_[3] and i - open_[1] <= PART + self.slack * (low - open_[3]):
                open_ = [open_[0], max(j, open_[1]), open_[2], high, open_[4] + pairs]
                continue
            if open_ and self._told(name, open_[4], open_[2], open_[3]):
                yield open_[0], open_[1], len({b for _, b in open_[4]})
            open_ = [i, j, low, high, pairs]

    def _told(self, name: str, pairs: list[tuple[int, int]], low: int, high: int) -> bool:
        """Whether each phrase that the template needs and has from ``low`` to ``high`` is matched somewhere, word after word."""
        template, at = self.templates[name], {b: a for a, b in pairs}
        for phrase in self.required[name]:
            starts = [b for b in range(low, high - len(phrase) + 1) if template[b : b + len(phrase)] == phrase]
            if starts and not any(b in at and all(at.get(b + k) == at[b] + k for k in range(len(phrase))) for b in starts):
                return False
        return True

    @staticmethod
    def _outdone(c: tuple[str, int, int, int], d: tuple[str, int, int, int]) -> bool:
        """Whether another template explains more words of the text at the same place."""
        return c[0] != d[0] and d[3] > c[3] and 2 * (min(c[2], d[2]) - max(c[1], d[1]) + 1) >= c[2] - c[1] + 1

    def _places(self, words: list[int], template: list[int], needed: Counter, least: float, name: str | None = None) -> Iterator[tuple[int, int, list[tuple[int, int]]]]:
        """Stretches that cover the template, from left to right: first and last word, matched pairs."""
        width = max(int(self.slack * len(template)), len(template))
        own = [i for i, w in enumerate(words) if w in needed]
        done = 0
        have: Counter = Counter()
        hits = lead = 0
        k = 0
        while k < len(own):
            # The window of words from own[k]; hits counts its words of the template, with multiplicity.
            if lead < k:
                lead, have, hits = k, Counter(), 0
            while lead < len(own) and own[lead] < own[k] + width:
                w = words[own[lead]]
                have[w] += 1
                hits += have[w] <= needed[w]
                lead += 1
            if hits >= least and own[k] >= done:
                begin, end = own[k], own[lead - 1] + 1
                pairs = [(begin + a, b) for a, b in aligned(words[begin:end], template)]
                if len(pairs) >= least and (name is None or self._told(name, pairs, 0, len(template))):
                    first, last = self._dense([i for i, _ in pairs], least)
                    # The first window that holds enough may stop short of the end: look again from the first match.
                    again = [(first + a, b) for a, b in aligned(words[first : first + width], template)]
                    if len(again) > len(pairs):
                        pairs = again
                        first, last = self._dense([i for i, _ in pairs], least)
                    yield first, last, pairs
                    done = last + 1
            w = words[own[k]]
            hits -= have[w] <= needed[w]
            have[w] -= 1
            k += 1

    @staticmethod
    def _dense(places: list[int], least: float) -> tuple[int, int]:
        """The matched places without stragglers that lie far off while enough remain."""
        first, last = 0, len(places) - 1
        while last - first + 1 > least:
            left, right = places[first + 1] - places[first], places[last] - places[last - 1]
            if max(left, right) <= 2 + len(places) // 4:
                break
            first, last = (first + 1, last) if left >= right else (first, last - 1)
        return places[first], places[last]


def _lowered(text: str) -> str:
    """A-Z in lower case; nothing else changes, so places stay."""
    return text.translate(_LOWER)


_LOWER = {c: c + 32 for c in range(65, 91)}


def scan_licences(df: DataFrame, templates: dict[str, str] | None = None, coverage: float = 0.8, slack: float = 1.5, text: str = "text", name: str = "licences", required: dict[str, list[str]] | None = None) -> tuple[DataFrame, str]:
    """All columns and, under a free name that is returned too, an array of (template, coverage, start, end)."""
    name = fresh(df, name)
    at = df.columns.index(text)
    chosen = dict(templates or TEMPLATES)
    needed = dict((REQUIRED if templates is None else {}) if required is None else required)
    Scanner(chosen, coverage, slack, needed)
    finding = T.StructType([T.StructField("template", T.StringType()), T.StructField("coverage", T.DoubleType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    kind = pa.list_(pa.struct([("template", pa.string()), ("coverage", pa.float64()), ("start", pa.int64()), ("end", pa.int64())]))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(chosen, coverage, slack, needed)
        for batch in batches:
            found = [[dict(zip(finding.names, f, strict=True)) for f in scanner.findings(t or "")] for t in batch.column(at).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, kind)], [*batch.schema.names, name])

    return df.mapInArrow(run, T.StructType([*df.schema.fields, T.StructField(name, T.ArrayType(finding))])), name
