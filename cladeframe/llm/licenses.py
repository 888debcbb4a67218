"""Licence scans: a paragraph classifier whose predictions are confirmed against templates.

Paragraphs are the lines of a text, and beside them the runs of neighbouring lines that a wrapped
notice may fill: from a line made of a notice's word pairs on, up to a blank line or twice the
longest notice.  A confirmed run counts as one paragraph predicted and confirmed.  A sparse
multinomial logistic model (FTRL, elastic net) on word unigrams and bigrams tells licence families from
one another and from ``unknown``; it is trained on the notices below, whole and with words left out,
against a bounded sample of corpus paragraphs, and calibrated by temperature on held-back rows.  A
paragraph predicted as a family is confirmed when enough of one of the family's notices stands in it.

A paragraph is given to the classifier only if its telling words and pairs (those of notices, whose
weights speak for a family more than for ``unknown``) would make it a family's by themselves; any
other is unknown.  Texts without such a paragraph, and without a line that may begin a wrapped notice,
are found by word hashes, as arrays; the others are read line by line.

Defined results: a null or empty text has no paragraphs and no licence; blank lines are no
paragraphs; a text may carry several families, listed in order; of families or paragraphs of equal
probability the first wins; very long texts are scanned whole; repeated documents are scanned each; an
empty table gives no rows, and a model of the notices alone; other columns are not read.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import sampled, ship
from .ftrl import FTRL, logits, softmax, temperature
from .words import Hash, flat, mix, places, slices, tidy

#: Notices by family, besides those that ``notices`` makes of names and sentences.
TEMPLATES = {
    "agpl": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Affero General Public License along with this program.",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ],
    "apache": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND.",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "bsd": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
        "Released under the BSD 3-Clause License.",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "boost": [
        "Distributed under the Boost Software License, Version 1.0.",
        "SPDX-License-Identifier: BSL-1.0",
    ],
    "cc": [
        "Licensed under CC BY-NC 4.0.",
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike License.",
    ],
    "epl": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0.",
        "SPDX-License-Identifier: EPL-2.0",
    ],
    "gpl": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU General Public License along with this program.",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "isc": [
        "Released under the ISC License.",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
        "SPDX-License-Identifier: ISC",
    ],
    "lgpl": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation.",
        "You should have received a copy of the GNU Lesser General Public License along with this library.",
        "SPDX-License-Identifier: LGPL-3.0-or-later",
    ],
    "mit": [
        "Released under the MIT License.",
        "Licensed under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
        "SPDX-License-Identifier: MIT",
    ],
    "mpl": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Released under the Mozilla Public License 2.0.",
    ],
    "proprietary": [
        "All rights reserved.",
        "Copyright by the company. All rights reserved.",
        "This software is proprietary and confidential.",
        "Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ],
    "unlicense": [
        "This is free and unencumbered software released into the public domain.",
        "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary.",
        "SPDX-License-Identifier: Unlicense",
    ],
    "zlib": [
        "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
        "Altered source versions must be plainly marked as such, and must not be misrepresented as being the original software.",
        "SPDX-License-Identifier: Zlib",
    ],
}
#: Names of the licences of a family, and sentences that name one.
NAMES = {
    "agpl": ["GNU Affero General Public License", "AGPL", "AGPLv3"],
    "apache": ["Apache License 2.0", "Apache License, Version 2.0", "Apache-2.0 license"],
    "boost": ["Boost Software License", "BSL-1.0"],
    "bsd": ["BSD License", "BSD 2-Clause License", "BSD 3-Clause License"],
    "cc": ["Creative Commons Attribution License", "Creative Commons Attribution-ShareAlike 4.0 License", "CC BY 4.0"],
    "epl": ["Eclipse Public License", "EPL 2.0"],
    "gpl": ["GNU General Public License", "GPL", "GPLv2", "GPLv3"],
    "isc": ["ISC License"],
    "lgpl": ["GNU Lesser General Public License", "LGPL", "LGPLv3"],
    "mit": ["MIT License"],
    "mpl": ["Mozilla Public License 2.0", "MPL 2.0"],
    "unlicense": ["Unlicense"],
    "zlib": ["zlib License"],
}
SENTENCES = [
    "Released under the {}.",
    "Licensed under the {}.",
    "This project is licensed under the {}.",
    "Distributed under the terms of the {}.",
    "This software is made available under the {}, see the LICENSE file.",
    "Use of this source code is governed by the {}.",
    "The code in this repository is covered by the {}.",
]
FAMILIES = sorted(TEMPLATES)


def notices(sentences: list[str] = SENTENCES) -> dict[str, list[str]]:
    """All notices by family: the templates, and each name in each sentence."""
    return {f: list(dict.fromkeys([*TEMPLATES[f], *(x.format(n) for n in NAMES.get(f, ()) for x in sentences)])) for f in FAMILIES}


NOTICES = notices()
CLASSES = [*FAMILIES, "unknown"]
BITS = 18
#: Background lines of the classifier, about: a hash sample of all lines of the sampled documents.
LINES = 3000
_WORD = regex.compile(r"[\p{L}\p{N}]+")


def words(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def grams(w: list[str]) -> list[str]:
    return w + [f"{a} {b}" for a, b in zip(w, w[1:])]


def bucket(gram: str) -> int:
    return zlib.crc32(gram.encode("utf-8", "surrogatepass")) & ((1 << BITS) - 1)


def vector(w: list[str]) -> tuple[np.ndarray, np.ndarray]:
    at = np.unique(np.array([bucket(g) for g in grams(w)], np.int64))
    return at, np.full(len(at), 1 / max(1.0, len(at)) ** 0.5)


def _template_sets() -> list[tuple[int, frozenset]]:
    return [(k, frozenset(grams(words(t)))) for k, f in enumerate(FAMILIES) for t in NOTICES[f]]


_SETS = _template_sets()


def template_match(w: list[str]) -> tuple[int, float]:
    """(family, share of its best notice's n-grams that stand in the paragraph)."""
    have = set(grams(w))
    share, k = max((len(s & have) / len(s), -k) for k, s in _SETS)
    return -k, share


#: Where candidates are looked for, words are ASCII letters and digits and all other bytes above ASCII;
#: texts with bytes of _ODD, which may be signs, are read in any case.
_OTHER = np.array([not chr(b).isalnum() and b < 128 for b in range(256)])
_ODD = np.array([b == 0xC2 or b >= 0xE2 for b in range(256)])
_HASH = Hash(31)


def _pair(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    return mix(left * np.uint64(3) ^ right)


class _Numbers:
    """Numbers of some hashes, found for whole arrays."""

    def __init__(self, hashes: np.ndarray):
        self.order = np.argsort(hashes)
        self.sorted = hashes[self.order]
        self.low = np.zeros(1 << 16, bool)
        self.low[(hashes & np.uint64(0xFFFF)).astype(np.int64)] = True

    def of(self, h: np.ndarray) -> np.ndarray:
        out = np.full(len(h), -1, np.int64)
        at = np.flatnonzero(self.low[(h & np.uint64(0xFFFF)).astype(np.int64)])
        if len(at) and len(self.sorted):
            k = np.minimum(np.searchsorted(self.sorted, h[at]), len(self.sorted) - 1)
            out[at] = np.where(self.sorted[k] == h[at], self.order[k], -1)
        return out


def _hashes(words_: list[str]) -> np.ndarray:
    return np.array([_HASH.plain(w.encode()) for w in words_], np.uint64)


def _distinct_by_line(line: np.ndarray, h: np.ndarray, lines: int) -> np.ndarray:
    """How many different hashes each line has."""
    k = np.sort((line.astype(np.uint64) << np.uint64(32)) | (h >> np.uint64(32)))
    new = np.concatenate([[True], k[1:] != k[:-1]]) if len(k) else np.empty(0, bool)
    return np.bincount((k[new] >> np.uint64(32)).astype(np.int64), minlength=lines)


class Model:
    def __init__(self, w: np.ndarray, bias: np.ndarray, t: float, notices: dict[str, list[str]]):
        self.bias, self.t = bias, t
        at = np.flatnonzero(np.abs(w).sum(1) > 0)
        self.w = {int(i): w[i] for i in at}
        gain = w[:, :-1] - w[:, -1:]
        cut = [words(x) for f in notices for x in notices[f]]
        speaks = lambda gram: gain[bucket(gram)].max() > 0
        #: What a family lacks against ``unknown`` where nothing speaks for it.
        self.margin = bias[-1] - bias[:-1]
        ones = sorted({x for c in cut for x in c if speaks(x)})
        twos = sorted({p for c in cut for p in zip(c, c[1:]) if speaks(" ".join(p))})
        self.one = {x: i for i, x in enumerate(ones)}
        self.two = {p: len(ones) + i for i, p in enumerate(twos)}
        self.gain = np.array([gain[bucket(x)] for x in [*ones, *map(" ".join, twos)]]).reshape(-1, len(self.margin))
        self.words = _Numbers(_hashes(ones))
        every = sorted(_PAIRS)
        self.pairs = _Numbers(_pair(_hashes([a for a, _ in every]), _hashes([b for _, b in every])))
        self.pair_row = np.array([self.two.get(p, -1) for p in every] or [-1], np.int64)

    def may(self, w: list[str]) -> bool:
        """Whether a paragraph's telling words and pairs make it a family's by themselves."""
        rows = {self.one[x] for x in w if x in self.one} | {self.two[p] for p in zip(w, w[1:]) if p in self.two}
        n = len(set(w)) + len(set(zip(w, w[1:])))
        z = self.gain[sorted(rows)].sum(0) if rows else np.zeros(len(self.margin))
        return bool((z / max(1, n) ** 0.5 > self.margin).any())

    def candidates(self, column: pa.Array) -> np.ndarray:
        """Texts of a column in which ``may`` holds for a line, or a wrapped notice may begin, or that are
        not plain enough to tell."""
        if (self.margin <= 0).any():
            return np.ones(len(column), bool)
        raw, at = flat(column)
        starts, ends, first = places(raw, at, None, _OTHER)
        out = np.zeros(len(column), bool)
        odd = np.flatnonzero(_ODD[raw])
        out[np.searchsorted(at, odd, side="right") - 1] = True
        if not len(starts):
            return out
        h = _HASH.prefix(raw, starts, ends)
        text = np.repeat(np.arange(len(column)), np.diff(first))
        line = np.searchsorted(np.flatnonzero(raw == 10), starts) + text
        line -= line[0]
        lines = int(line[-1]) + 1
        p = _pair(h[:-1], h[1:])
        alike, inside = text[1:] == text[:-1], line[1:] == line[:-1]
        n = _distinct_by_line(line, h, lines) + _distinct_by_line(line[:-1][inside], p[inside], lines)
        one, two = self.words.of(h), self.pairs.of(p)
        known = np.flatnonzero(two >= 0)
        row = np.full(len(p), -1, np.int64)
        row[known] = self.pair_row[two[known]]
        a, b = np.flatnonzero(one >= 0), np.flatnonzero((row >= 0) & inside)
        rows = max(1, len(self.gain))
        found = np.unique(np.concatenate([line[a] * rows + one[a], line[:-1][b] * rows + row[b]]))
        to_text = np.zeros(lines, np.int64)
        to_text[line] = text
        if len(found):
            at_line = found // rows
            begin = np.flatnonzero(np.concatenate([[True], at_line[1:] != at_line[:-1]]))
            z = np.add.reduceat(self.gain[found % rows], begin, axis=0)
            which = at_line[begin]
            good = (z / np.sqrt(n[which])[:, None] > self.margin - 1e-6).any(1)
            out[to_text[which[good]]] = True
        # Lines of which half the pairs, the one to the next line included, stand in notices.
        total = np.bincount(line[:-1][alike], minlength=lines)
        part = np.bincount(line[:-1][alike & (two >= 0)], minlength=lines)
        out[to_text[np.flatnonzero((part > 0) & (2 * part >= total))]] = True
        return out

    def predict(self, w: list[str]) -> tuple[int, float]:
        """(class, calibrated probability) of a paragraph's words."""
        at, val = vector(w)
        z = self.bias.copy()
        for i, v in zip(at.tolist(), val.tolist()):
            if (x := self.w.get(i)) is not None:
                z = z + v * x
        p = softmax(z / self.t)
        k = int(np.argmax(p))
        return k, float(p[k])


def fit(docs: DataFrame, *, doc_id: str = "doc_id", text: str = "text", bound: int = 200, seed: int = 3, notices: dict[str, list[str]] = NOTICES) -> Model:
    """Train on ``notices`` (by family) and on about ``LINES`` different lines of about ``bound`` documents."""
    ship(docs.sparkSession)
    n = docs.count()
    lines = sampled(docs.where(F.col(text).isNotNull()), n, bound, doc_id).select(F.explode(F.split(F.col(text), "\n")).alias("p")).distinct()
    sample = sampled(lines, lines.count(), LINES, "p").collect()
    rng = np.random.default_rng(seed)
    plain = sorted(r["p"] for r in sample if r["p"].strip())
    other = [w for p in plain if (w := words(p)) and template_match(w)[1] < 0.5]
    rng.shuffle(other)
    rows, y = [], []
    most = max(map(len, notices.values()))
    for k, f in enumerate(FAMILIES):
        for t in notices.get(f, ()):
            w = words(t)
            # Families of few notices are shown as often as those of many.
            for turn in range(24 * -(-most // len(notices[f]))):
                keep = [x for x in w if turn == 0 or rng.random() > 0.15]
                if other and turn % 3 == 2:
                    more = other[int(rng.integers(len(other)))][:12]
                    keep = [*more, *keep] if turn % 2 else [*keep, *more]
                rows.append(vector(keep))
                y.append(k)
    # Single words of notices, and words that any text may hold, are not enough for a licence.
    for f in FAMILIES:
        for t in notices.get(f, ()):
            for x in words(t):
                rows.append(vector([x]))
                y.append(len(FAMILIES))
    for w in other:
        rows.append(vector(w))
        y.append(len(FAMILIES))
    labels = np.array(y, np.int64)
    held = np.arange(len(rows)) % 5 == 4
    model = FTRL(len(CLASSES), 1 << BITS, alpha=0.5, l1=0.3, l2=0.01).fit([rows[i] for i in np.flatnonzero(~held)], labels[~held], epochs=3)
    w, bias = model.weights()
    back = np.flatnonzero(held)
    return Model(w, bias, temperature(logits([rows[i] for i in back], w, bias), labels[back]), notices)


OUT = "doc_id long, n_paragraphs long, n_predicted long, n_confirmed long, family string, families array<string>, score double"


def scan_text(text: str | None, model: Model, limit: float = 0.5, share: float = 0.6) -> tuple:
    """The columns of OUT after the id."""
    lines = [words(x) if x.strip() else None for x in text.split("\n")] if text else []
    best, found = (0.0, None), set()
    states, starts = [0] * len(lines), []

    def judged(w: list[str]) -> int:
        """0 unknown, 1 predicted, 2 confirmed."""
        nonlocal best
        k, p_k = model.predict(w)
        if k == len(FAMILIES) or p_k < limit:
            return 0
        family, much = template_match(w)
        if much < share or family != k:
            return 1
        found.add(FAMILIES[k])
        if p_k > best[0]:
            best = p_k, FAMILIES[k]
        return 2

    for i, w in enumerate(lines):
        if w is None:
            continue
        after = lines[i + 1] if i + 1 < len(lines) else None
        if after is not None:
            pairs = list(zip(w, [*w[1:], *after[:1]]))
            if pairs and 2 * sum(x in _PAIRS for x in pairs) >= len(pairs):
                starts.append(i)
        if not model.may(w):
            continue
        states[i] = judged(w)
    done, wrapped = 0, 0
    for i in starts:
        if i < done or states[i] == 2:
            continue
        run, j = list(lines[i]), i + 1
        while j < len(lines) and lines[j] is not None and states[j] != 2 and len(run) <= 2 * _LONGEST:
            run += lines[j]
            j += 1
            if template_match(run)[1] >= share and judged(run) == 2:
                # The rest of the notice belongs to it.
                much = template_match(run)[1]
                while j < len(lines) and lines[j] is not None and states[j] != 2 and (more := template_match([*run, *lines[j]])[1]) > much:
                    run, much, j = [*run, *lines[j]], more, j + 1
                states[i:j] = [0] * (j - i)
                wrapped += 1
                done = j
                break
    confirmed = states.count(2) + wrapped
    return sum(w is not None for w in lines), states.count(1) + confirmed, confirmed, best[1], sorted(found), best[0]


#: Words of the longest notice.
_LONGEST = max(len(words(t)) for f in FAMILIES for t in NOTICES[f])
#: Word pairs of the notices.
_PAIRS = {(a, b) for f in FAMILIES for t in NOTICES[f] for w in [words(t)] for a, b in zip(w, w[1:])}


def scan(docs: DataFrame, model: Model, *, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: its paragraphs, those predicted and confirmed as licences, the family of
    the surest confirmed paragraph, all confirmed families and the calibrated score."""
    ship(docs.sparkSession)
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = sent.value
        for batch in batches:
            for lo, hi in slices(batch.column(1)):
                texts = batch.column(1).slice(lo, hi - lo)
                may = m.candidates(texts)
                got = [scan_text(t, m) if x else (lines(t), 0, 0, None, [], 0.0) for t, x in zip(texts.to_pylist(), may.tolist())]
                kinds = [pa.int64()] * 3 + [pa.string(), pa.list_(pa.string()), pa.float64()]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(lo, hi - lo), *(pa.array(list(c), k) for c, k in zip(zip(*got), kinds))],
                    ["doc_id", "n_paragraphs", "n_predicted", "n_confirmed", "family", "families", "score"],
                )
        tidy()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text)).mapInArrow(run, OUT)


def lines(text: str | None) -> int:
    """The lines of a text that are not blank."""
    return sum([not x.isspace() for x in text.split("\n") if x]) if text else 0
