"""Licence notices in documents: a trained paragraph classifier whose hits templates confirm.

Paragraphs are lines with a word. A sparse softmax regression over hashed one- to three-word features names the licence
family of a paragraph or "none". It is trained here on the templates, on excerpts and respellings of them, and on a bounded
sample of paragraphs of the corpus itself, which count as "none" unless they hold a cue word. The confidence is calibrated on
held-out examples of models that each have never seen a third of the families: a temperature, and the probability below which
a paragraph is of the unknown class, which parts notices of known families best from those of families left out and misses
MISSED of the former at most. A family is reported if enough of a template of that family is found in the paragraph in order
(COVER of the template's words by longest common subsequence, words that few families use weighing most, or of the
paragraph's words if it is an excerpt), and no other family has more of its words there.

A notice can stand anywhere in a paragraph of any length: where the paragraph as a whole isn't one, the stretches that align
with a template, near words that hint at one, are judged without the text around them. A paragraph has a row for each family.
A notice may also be wrapped over lines without a blank one between: stretches that align with a template across line ends are
judged too, and reported as a paragraph from the start of the first of their lines, whose number it has, to the end of the last,
unless one of those lines holds that family by itself.

Null texts and texts without words have no paragraphs. Only paragraphs that are not "none" are returned: family is null for
the unknown class, which holds at least two cue words but no confirmed family. Repeated rows are each scanned. Trained on
an empty table it still knows the templates. Only doc_id and text are read, so other columns may have any name.
"""

from __future__ import annotations

import math
import random
import re
import zlib
from bisect import bisect_left, bisect_right
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cuemill.llm.common import small_batches

NONE = "none"
#: Short notices by which licences are granted.
NOTICES = {
    "MIT": [
        "Released under the MIT License.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction",
        "Available under the terms of the MIT license",
        "MIT licensed",
    ],
    "Apache-2.0": [
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "under the terms of the Apache 2.0 license",
    ],
    "BSD": [
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Released under the BSD 3-Clause License.",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "ISC": [
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
        "Released under the ISC License.",
    ],
    "GPL": [
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "GNU GPL version 2 or, at your option, any later version",
    ],
    "LGPL": [
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Lesser General Public License, version 2.1.",
    ],
    "AGPL": [
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "Licensed under the GNU Affero General Public License, version 3.",
    ],
    "MPL-2.0": [
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License 2.0.",
    ],
    "EPL": [
        "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0",
        "Licensed under the Eclipse Public License, version 2.0.",
        "Eclipse Public License v2.0",
    ],
    "EUPL": [
        "Licensed under the EUPL, Version 1.2 only",
        "Licensed under the European Union Public Licence, version 1.2.",
    ],
    "CDDL": ["The contents of this file are subject to the terms of the Common Development and Distribution License"],
    "MS-PL": ["Licensed under the Microsoft Public License."],
    "BSL-1.0": ["Distributed under the Boost Software License, Version 1.0."],
    "Zlib": ["This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software"],
    "Artistic": ["This is free software; you may redistribute it under the terms of the Artistic License 2.0"],
    "WTFPL": ["Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed"],
    "PSF": ["Licensed under the Python Software Foundation License."],
    "OFL": ["This Font Software is licensed under the SIL Open Font License, Version 1.1."],
    "GFDL": ["Permission is granted to copy, distribute and/or modify this document under the terms of the GNU Free Documentation License"],
    "CC-BY": ["This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA": ["This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND": ["This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "Released into the public domain under CC0 1.0 Universal."],
    "all-rights-reserved": ["All rights reserved.", "Copyright (c) the authors. All rights reserved. No part of this work may be reproduced without permission."],
}
#: The names that SPDX tags give licences.
TAGS = {
    "MIT": ("MIT",), "Apache-2.0": ("Apache-2.0",), "BSD": ("BSD-2-Clause", "BSD-3-Clause"), "ISC": ("ISC",), "GPL": ("GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later"),
    "LGPL": ("LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later"), "AGPL": ("AGPL-3.0-only", "AGPL-3.0-or-later"), "MPL-2.0": ("MPL-2.0",), "EPL": ("EPL-1.0", "EPL-2.0"), "EUPL": ("EUPL-1.2",), "CDDL": ("CDDL-1.0",),
    "MS-PL": ("MS-PL",), "BSL-1.0": ("BSL-1.0",), "Zlib": ("Zlib",), "Artistic": ("Artistic-2.0",), "WTFPL": ("WTFPL",), "PSF": ("PSF-2.0",), "OFL": ("OFL-1.1",), "public-domain": ("CC0-1.0", "Unlicense"),
}
CC_VERSIONS = ("3.0", "4.0")


def _templates() -> dict[str, list[str]]:
    """The notices of each family, its tags, and for licences that go by versions those of each version."""
    out = {f: [*ts, *(f"SPDX-License-Identifier: {tag}" for tag in TAGS.get(f, ()))] for f, ts in NOTICES.items()}
    for f in out:
        if f.startswith("CC-BY"):
            for v in CC_VERSIONS:
                out[f] += [f"Licensed under CC {f[3:]} {v}.", f"available under CC {f[3:]} {v}", f"SPDX-License-Identifier: {f}-{v}"]
    return out


TEMPLATES = _templates()
#: Words that hint at a licence. Fixed values.
CUES = ("license", "licensed", "licence", "licenced", "licenses", "copyright", "rights", "reserved", "permission", "redistribution", "spdx", "public", "warranty", "gnu", "mit", "apache", "bsd", "mozilla", "cc", "commons")
FEATURES = 1 << 14
SAMPLE, ROUNDS, RATE, DECAY = 2_500, 150, 2.0, 1e-5
#: Variants of a template to learn from, and parts that the families are split in, each left out once.
VARIANTS, PARTS = 16, 3
MISSED, COVER, ALONE = 0.1, 0.8, 0.75
TEMPERATURES = (0.25, 0.5, 0.7, 1.0, 1.4, 2.0, 3.0, 4.0)
LONGEST = 400
#: Words that are judged at once, the step between such stretches, and what a word between a template's words costs.
STRETCH, STRIDE, GAP = 40, 10, 0.2
_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")
_RESULT = "doc_id bigint, paragraph bigint, start bigint, end bigint, family string, probability double, cover double"


def words_in(paragraph: str) -> list[str]:
    return _WORD.findall(paragraph.lower())


def features(words: list[str]) -> list[int]:
    """Hashed runs of one to three words, each once, a bias first."""
    runs = {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}
    return [0, *sorted({1 + zlib.crc32(r.encode()) % (FEATURES - 1) for r in runs})]


def negatives(docs: DataFrame, size: int = SAMPLE) -> list[str]:
    """Paragraphs of the corpus, at most size, the same for the same rows: one by hash from each of the chosen documents."""
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(r"\w"))
    rows = docs.select(F.xxhash64("doc_id", "text").alias("h"), lines.alias("lines")).where(F.size("lines") > 0)
    # The hash also thins the rows to about twice as many as are wanted, so that few travel however many documents there are.
    steps = 1 << 30
    rows = rows.where(F.pmod(F.xxhash64("h"), F.lit(steps)) < min(steps, 2 * size * steps // max(docs.count(), 1) + 1))
    some = rows.select("h", F.substring(F.get("lines", F.pmod("h", F.size("lines")).cast("int")), 1, 4 * LONGEST).alias("line"))
    return [r["line"] for r in some.orderBy("h", "line").limit(size).collect()]


def hints() -> re.Pattern:
    """Finds paragraphs that can be notices: those with a cue or a long word of a template. Eight words in a row of any
    template hold one, so the others are "none" without asking the model."""
    long = {w for ts in TEMPLATES.values() for t in ts for w in words_in(t) if len(w) >= 6}
    return re.compile(r"\b(?:" + "|".join(map(re.escape, sorted({*CUES, *long}, key=lambda w: (-len(w), w)))) + r")\b")


class Classifier:
    def __init__(self, negatives: list[str], seed: int = 11):
        rng = random.Random(seed)
        self.families = [NONE, *TEMPLATES]
        self.templates = {f: [words_in(t) for t in ts] for f, ts in TEMPLATES.items()}
        self.all = [(f, t) for f, ts in self.templates.items() for t in ts]
        families = {w: {f for f, t in self.all if w in t} for _, t in self.all for w in t}
        self.rare = {w: math.log((len(TEMPLATES) + 1) / len(fs)) for w, fs in families.items()}
        self.by_word = defaultdict(list)
        for k, (_, t) in enumerate(self.all):
            for w in {w for w in t if len(w) >= 6 or w in CUES}:
                self.by_word[w].append(k)
        examples = [(0, ws) for p in negatives if not set(ws := words_in(p)[:LONGEST]) & set(CUES)]
        plain = [w for _, ws in examples[:2000] for w in ws] or ["lorem", "ipsum"]
        for k, f in enumerate(TEMPLATES, 1):
            for t in self.templates[f]:
                for n in range(VARIANTS):
                    ws = list(t)
                    if n % 4 == 1 and len(ws) > 8:  # an excerpt
                        a = rng.randrange(len(ws) - 7)
                        ws = ws[a : a + rng.randrange(7, len(ws))]
                    if n % 4 == 2:  # a word lost or respelt
                        ws[rng.randrange(len(ws))] = rng.choice(plain)
                    if n % 4 == 3:  # inside other text
                        ws = rng.choices(plain, k=rng.randrange(1, 9)) + ws + rng.choices(plain, k=rng.randrange(1, 9))
                    examples.append((k, ws))
        # Cue words alone are no licence.
        for _ in range(400):
            ws = rng.choices(plain, k=rng.randrange(3, 15))
            ws.insert(rng.randrange(len(ws)), rng.choice(CUES))
            examples.append((0, ws))
        rng.shuffle(examples)
        held = len(examples) // 5
        self._calibrate(examples[held:], examples[:held])
        self.weights = self._fit(examples[held:])

    @staticmethod
    def _rows(examples: list[list[str]]) -> tuple[np.ndarray, np.ndarray]:
        """Feature numbers of all examples one after another, and where each starts."""
        each = [features(ws) for ws in examples]
        return np.array([x for e in each for x in e]), np.cumsum([0, *(len(e) for e in each[:-1])])

    @staticmethod
    def _logits(weights: np.ndarray, flat: np.ndarray, starts: np.ndarray) -> np.ndarray:
        return np.add.reduceat(weights[flat], starts, axis=0)

    @staticmethod
    def _softmax(x: np.ndarray) -> np.ndarray:
        e = np.exp(x - x.max(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    def _fit(self, examples: list[tuple[int, list[str]]], rounds: int = ROUNDS) -> np.ndarray:
        """Weights by Adagrad on the whole batch; classes weigh the same."""
        labels = np.array([k for k, _ in examples])
        flat, starts = self._rows([ws for _, ws in examples])
        owner = np.repeat(np.arange(len(examples)), np.diff([*starts, len(flat)]))
        counts = np.bincount(labels, minlength=len(self.families))
        weight = ((len(labels) / np.maximum(counts, 1) / np.count_nonzero(counts))[labels][:, None] / len(labels)).astype(np.float32)
        weights = np.zeros((FEATURES, len(self.families)), np.float32)
        order = np.argsort(flat, kind="stable")
        used, first = np.unique(flat[order], return_index=True)
        past = np.full((len(used), 1), 1e-6, np.float32)
        for _ in range(rounds):
            error = self._softmax(self._logits(weights, flat, starts))
            error[np.arange(len(labels)), labels] -= 1
            gradient = np.add.reduceat((error * weight)[owner[order]], first, axis=0) + np.float32(DECAY) * weights[used]
            past += (gradient**2).sum(axis=1, keepdims=True)
            weights[used] -= np.float32(RATE * 0.1) * gradient / np.sqrt(past)
        return weights

    def _calibrate(self, examples: list[tuple[int, list[str]]], held: list[tuple[int, list[str]]]) -> None:
        """The temperature, and the least probability of a known family. Families are left out in PARTS: what a model makes of
        families that it has never seen is what the unknown class is for, and what it makes of held-out examples of the others
        is what it is not for."""
        true, lost, losses = [], [], np.zeros(len(TEMPERATURES))
        for part in range(PARTS):
            out = lambda k: k > 0 and k % PARTS == part  # noqa: E731,B023
            weights = self._fit([e for e in examples if not out(e[0])], ROUNDS // 2)
            logits, labels = self._logits(weights, *self._rows([ws for _, ws in held])), np.array([k for k, _ in held])
            seen = np.array([not out(k) for k in labels])
            losses += [-np.log(self._softmax(logits[seen] / t)[np.arange(seen.sum()), labels[seen]] + 1e-12).sum() for t in TEMPERATURES]
            true.append((logits[seen & (labels > 0)], labels[seen & (labels > 0)]))
            lost.append(logits[~seen])
        self.temperature = TEMPERATURES[int(np.argmin(losses))]
        p = np.concatenate([self._softmax(x / self.temperature)[np.arange(len(k)), k] for x, k in true])
        strange = np.concatenate([self._softmax(x / self.temperature)[:, 1:].max(axis=1) for x in lost])
        # Of the cutoffs that miss MISSED of the true examples at most, the one that parts them best from the strange ones.
        cuts = np.unique(np.quantile(p, np.linspace(0, MISSED, 21), method="lower")) if len(p) else np.array([0.5])
        kept, let = ((x[:, None] >= cuts).mean(axis=0) if len(x) else np.zeros(len(cuts)) for x in (p, strange))
        best = int(np.argmax(kept - let))
        self.least, self.missed, self.strange = float(cuts[best]), 1 - float(kept[best]), float(let[best])

    def probabilities(self, paragraphs: list[list[str]]) -> np.ndarray:
        return self._softmax(self._logits(self.weights, *self._rows(paragraphs)) / self.temperature)

    def _common(self, template: list[str], words: list[str], weights: dict[str, float] | None) -> float:
        """The weight, or the number, of the words that both have in order."""
        row = [0.0] * (len(template) + 1)
        for w in words:
            if w in self.rare:
                before, weight = 0.0, weights[w] if weights else 1.0
                for i, x in enumerate(template, 1):
                    before, row[i] = row[i], before + weight if w == x else max(row[i], row[i - 1])
        return row[-1]

    def cover(self, family: str, words: list[str]) -> tuple[float, float]:
        """How much of a template is there in order, and the weight of that. Words that few families use weigh most: without
        its own name a licence isn't covered, nor by its name alone. Eight words and more may be an excerpt: then the share of
        these words counts, those of no template weighing as much as a name."""
        best, strange = (0.0, 0.0), math.log(len(TEMPLATES) + 1)
        whole = sum(self.rare.get(w, strange) for w in words)
        for t in self.templates[family]:
            weight, number = self._common(t, words, self.rare), self._common(t, words, None)
            share = min(weight / sum(self.rare[w] for w in t), number / len(t) / ALONE)
            if len(words) >= 8:
                share = max(share, min(weight / whole, number / len(words) / ALONE))
            best = max(best, (share, weight))
        return best

    def confirmed(self, family: str, words: list[str]) -> float:
        """The cover of the family, 0 if another one is covered too and more of its words are there, as with look-alikes."""
        cover, matched = self.cover(family, words)
        if cover >= COVER:
            for other in {f for f, _ in self.near(words)} - {family}:
                theirs, more = self.cover(other, words)
                if theirs >= COVER and more > matched:
                    return 0.0
        return cover

    def near(self, words: list[str]) -> list[tuple[str, list[str]]]:
        """The templates that have one of the words that hint at a licence."""
        found = {k for w in {*words} for k in self.by_word.get(w, ())}
        return [self.all[k] for k in sorted(found)]


def scanned(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph, start, end (code points), family, probability, cover: paragraphs that are licence notices."""
    shipped = docs.sparkSession.sparkContext.broadcast(Classifier(negatives(docs)))
    hint = hints()

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shipped.value
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0), batch.column(1), strict=True):
                out += [(doc_id.as_py(), *found) for found in _notices(model, text.as_py() or "", hint)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True) if out else [[]] * 7, [pa.int64()] * 4 + [pa.string(), pa.float64(), pa.float64()], strict=True)], names=["doc_id", "paragraph", "start", "end", "family", "probability", "cover"])

    return small_batches(docs).select("doc_id", "text").mapInArrow(scan, _RESULT)


def _aligned(template: list[str], words: list[str]) -> list[tuple[int, int]]:
    """Stretches of words that align with the template or a part of it, none over another; the cover is yet to be judged."""
    known, least = set(template), 0.75 * min(COVER * len(template), COVER * 8)
    if sum(w in known for w in words) < least:
        return []
    n = len(template)
    score, start = [0.0] * (n + 1), [0] * (n + 1)
    ends = []
    for j, w in enumerate(words):
        if w not in known:
            score = [x - GAP if x > GAP else 0.0 for x in score]
            continue
        before, since, best = 0.0, j, (0.0, 0)
        for i, x in enumerate(template, 1):
            own, begun = (score[i] - GAP, start[i]) if score[i] > GAP else (0.0, j + 1)
            if w == x:
                new = (before + 1, since if before > 0 else j)
                best = max(best, new)
                own, begun = max((own, begun), new)
            if i > 1 and score[i - 1] > own:
                own, begun = score[i - 1], start[i - 1]
            before, since = score[i], start[i]
            score[i], start[i] = own, begun
        if best[0] >= least:
            ends.append((best[0], best[1], j + 1))
    found: list[tuple[int, int]] = []
    for _, a, b in sorted(ends, key=lambda x: (-x[0], x[1] - x[2])):
        if all(b <= c or d <= a for c, d in found):
            found.append((a, b))
    return found


def _near(places: list[int], n: int) -> list[tuple[int, int]]:
    """The words at most STRETCH from one of places (ascending), as stretches of the n words."""
    out: list[tuple[int, int]] = []
    for p in places:
        a, b = max(p - STRETCH, 0), min(p + STRETCH + 1, n)
        if out and a <= out[-1][1]:
            out[-1] = out[-1][0], b
        else:
            out.append((a, b))
    return out


def _passages(marked: list[int], lines: list[str], words_of: Callable[[int], list[str]]) -> list[tuple[int, int]]:
    """First and last line around each of marked (ascending), STRETCH words to either side or up to a blank line."""
    out: list[tuple[int, int]] = []
    for k in marked:
        ends = []
        for step in (-1, 1):
            at, n = k, 0
            while n < STRETCH and 0 <= at + step < len(lines) and lines[at + step].strip():
                at += step
                n += len(words_of(at))
            ends.append(at)
        if out and ends[0] <= out[-1][1]:
            out[-1] = out[-1][0], max(ends[1], out[-1][1])
        else:
            out.append((ends[0], ends[1]))
    return out


def _notices(model: Classifier, text: str, hint: re.Pattern) -> list[tuple]:
    """(paragraph, start, end, family, probability, cover) of one text: a row for each family that a paragraph holds, or one
    without family if it is of the unknown class."""
    lines = text.split("\n")
    bounds, at = [], 0
    for line in lines:
        bounds.append((at, at + len(line)))
        at += len(line) + 1
    wholes, parts = [], []
    known: dict[int, list[str]] = {}
    for number, line in enumerate(lines):
        low = line.lower()
        if marks := [m.start() for m in hint.finditer(low)]:
            spans = list(_WORD.finditer(low))
            words, starts = [m.group() for m in spans], [m.start() for m in spans]
            known[number] = words
            places = sorted({max(bisect_right(starts, m) - 1, 0) for m in marks})
            for i in range(0, max(len(words) - STRETCH, 0) + STRIDE, STRIDE):
                if bisect_left(places, i) < bisect_left(places, i + STRETCH):
                    wholes.append((number, words[i : i + STRETCH]))
                if i + STRETCH >= len(words):
                    break
            parts.append((number, words, places))
    if not wholes:
        return []
    sure: dict[int, dict[str, tuple]] = defaultdict(dict)
    unknown: dict[int, tuple] = {}

    def judged(stretches: list[list[str]]) -> Iterator[tuple[float, str, float]]:
        """Probability, family and cover of each."""
        for words, p in zip(stretches, model.probabilities(stretches), strict=True):
            k = int(p.argmax())
            yield float(p[k]), model.families[k], model.confirmed(model.families[k], words) if k and p[k] >= model.least else 0.0

    def aligned(words: list[str], places: list[int]) -> list[tuple[int, int]]:
        return sorted({(a + c, a + d) for a, b in _near(places, len(words)) for _, t in model.near(words[a:b]) for c, d in _aligned(t, words[a:b])})

    for stretches in (wholes, [(number, words[c:d]) for number, words, places in parts for c, d in aligned(words, places)]):
        for (number, words), (p, family, cover) in zip(stretches, judged([w for _, w in stretches]) if stretches else (), strict=True):
            if family != NONE:
                if p >= model.least and cover >= COVER:
                    sure[number][family] = max(sure[number].get(family, (0.0,)), (p, *bounds[number], family, cover))
                elif len(set(words) & set(CUES)) > 1:
                    unknown[number] = max(unknown.get(number, (0.0,)), (p, *bounds[number], "", cover))

    def words_of(number: int) -> list[str]:
        if number not in known:
            known[number] = words_in(lines[number])
        return known[number]

    wrapped, marks_of = [], {number: places for number, _, places in parts}
    for first, last in _passages(list(marks_of), lines, words_of):
        if first == last:
            continue
        owner = [k for k in range(first, last + 1) for _ in words_of(k)]
        words = [w for k in range(first, last + 1) for w in words_of(k)]
        places = [bisect_left(owner, k) + m for k in range(first, last + 1) for m in marks_of.get(k, ())]
        wrapped += [(owner[c], owner[d - 1], words[c:d]) for c, d in aligned(words, places) if owner[c] < owner[d - 1]]
    held = {(n, family) for n, found in sure.items() for family in found}
    for (p, family, cover), a, b in sorted(((x, a, b) for (a, b, _), x in zip(wrapped, judged([w for *_, w in wrapped]) if wrapped else (), strict=True)), key=lambda x: (-x[0][0], *x[1:])):
        if family != NONE and p >= model.least and cover >= COVER and not any((k, family) in held for k in range(a, b + 1)):
            sure[a][family] = (p, bounds[a][0], bounds[b][1], family, cover)
            held.update((k, family) for k in range(a, b + 1))
    told = {n for n, _ in held}
    rows = [(n, *x) for n, found in sure.items() for x in found.values()] + [(n, *x) for n, x in unknown.items() if n not in told]
    return [(n, s, e, f or None, p, c) for n, p, s, e, f, c in sorted(rows, key=lambda x: (x[0], x[4]))]
