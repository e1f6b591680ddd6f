"""Licence scan: a trained paragraph classifier confirmed by comparison with templates.

A paragraph is a line, or consecutive lines with words that hold a hard-wrapped notice together. Its sparse features are the words and word pairs that occur in the licence templates, and how
many of its words do not. A multinomial logistic regression over licence families and an unknown class is trained on
variants of the templates (words dropped, their start cut, swapped, added, owners and years before them) and on lines of other text;
a temperature set on variants it has not seen calibrates the probabilities, that of unknown included. A predicted
family is confirmed by a template of that family: enough of the template's word pairs must be in the paragraph, a version in
its name must be there, and no template of another family may explain better what the two do not share.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from stratigraph.session import ship

#: Least probability of a family, least share of a template's word pairs.
LEAST_PROBABILITY, LEAST_SHARE = 0.5, 0.6
#: Variants of each template, documents whose lines are examples of other text (at most, by least hash of doc_id).
VARIANTS, PLAIN_DOCS = 40, 400
UNKNOWN = "unknown"
#: Short notices by family.
TEMPLATES = {
    "MIT": ["Released under the MIT License.", "Licensed under the MIT License.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files", "The software is provided as is, without warranty of any kind, express or implied"],
    "Apache-2.0": ["Licensed under the Apache License, Version 2.0.", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License.", "You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"],
    "BSD": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "BSD-2-Clause": ["Released under the BSD 2-Clause License.", "Licensed under the Simplified BSD License (2-Clause)."],
    "BSD-3-Clause": ["Released under the BSD 3-Clause License.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."],
    "GPL-2.0": ["This work is licensed under the GNU General Public License, version 2.", "Licensed under the GNU General Public License, version 2.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License", "Released under the GPL v2."],
    "GPL-3.0": ["This work is licensed under the GNU General Public License, version 3.", "Licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License", "Released under the GPL v3."],
    "LGPL": ["This library is free software; you can redistribute it under the terms of the GNU Lesser General Public License"],
    "LGPL-2.1": ["Licensed under the GNU Lesser General Public License, version 2.1.", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License", "Released under the LGPL v2.1."],
    "LGPL-3.0": ["Licensed under the GNU Lesser General Public License, version 3.", "This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License", "Released under the LGPL v3."],
    "AGPL-3.0": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License", "Released under the AGPL v3.", "Licensed under the GNU Affero General Public License, version 3.", "under the terms of the GNU Affero General Public License as published by the Free Software Foundation"],
    "MPL-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.", "Licensed under the Mozilla Public License, version 2.0."],
    "CC-BY": ["Licensed under CC BY 4.0.", "This work is licensed under a Creative Commons Attribution 4.0 International License."],
    "CC-BY-SA": ["Licensed under CC BY-SA 4.0.", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "CC-BY-NC": ["Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."],
    "CC-BY-ND": ["Licensed under CC BY-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NoDerivatives 4.0 International License."],
    "CC-BY-NC-SA": ["Licensed under CC BY-NC-SA 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License."],
    "CC-BY-NC-ND": ["Licensed under CC BY-NC-ND 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License."],
    "ISC": ["Licensed under the ISC License.", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."],
    "Unlicense": ["Released under the Unlicense.", "This is free and unencumbered software released into the public domain."],
    "EPL-2.0": ["Licensed under the Eclipse Public License, version 2.0.", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0"],
    "CC0": ["Released under CC0 1.0 Universal.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "This work is dedicated to the public domain."],
    "proprietary": ["All rights reserved.", "Copyright. All rights reserved.", "No part of this publication may be reproduced without prior written permission of the publisher."],
}
FAMILIES = [*TEMPLATES, UNKNOWN]
WORD = re.compile(r"[^\W_]+(?:[.'][^\W_]+)*")


def words_of(line: str) -> list[str]:
    return WORD.findall(line.lower())


def pairs_of(words: list[str]) -> list[str]:
    return [f"{a} {b}" for a, b in zip(["^", *words], [*words, "$"], strict=True)]


def _vocabulary() -> dict[str, int]:
    told = [words_of(t) for texts in TEMPLATES.values() for t in texts]
    seen = {g for words in told for g in words + pairs_of(words)}
    return {g: k for k, g in enumerate(sorted(seen))}


VOCABULARY = _vocabulary()
SINGLE = {g for g in VOCABULARY if " " not in g}
#: (family, word pairs) of each template, inner pairs only.
SHAPES = [(family, {p for p in pairs_of(words_of(t)) if "^" not in p and "$" not in p}) for family, texts in TEMPLATES.items() for t in texts]
#: Numbers of the templates that hold a word pair, words of the longest template.
HOLDERS = {p: [k for k, (_, shape) in enumerate(SHAPES) if p in shape] for _, own in SHAPES for p in own}
LONGEST = max(len(words_of(t)) for texts in TEMPLATES.values() for t in texts)
WIDTH = len(VOCABULARY) + 3


def features(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Columns and values: known words and pairs, unknown words (log count), share known, bias."""
    at = {VOCABULARY[g] for g in [*words, *pairs_of(words)] if g in VOCABULARY}
    known = sum(w in SINGLE for w in words)
    tail = [np.log1p(len(words) - known), known / max(1, len(words)), 1.0]
    return np.array([*sorted(at), WIDTH - 3, WIDTH - 2, WIDTH - 1]), np.array([1.0] * len(at) + tail)


def _share(k: int, own: set[str]) -> float:
    """Share of the word pairs of template k among ``own``; 0 if its family names a version that ``own`` does not."""
    family, shape = SHAPES[k]
    numbers = {p for p in shape if any(c.isdigit() for c in p)} if any(c.isdigit() for c in family.partition("-")[2]) else set()
    return 0.0 if numbers and not numbers & own else len(own & shape) / max(1, len(shape))


def _confirmed(family: str, own: set[str]) -> float | None:
    """Share of the family's best template, or None where that is too small or another family explains the text better.

    Templates of different families may share most of their words (versions, clauses, Affero and Lesser, NoDerivatives), so
    two that both fit are held against each other only by the word pairs that just one of them has.
    """
    shares = [_share(k, own) for k in range(len(SHAPES))]
    best = max((k for k, (f, _) in enumerate(SHAPES) if f == family), key=lambda k: shares[k])
    if shares[best] < LEAST_SHARE:
        return None
    part = lambda pairs: len(own & pairs) / len(pairs) if pairs else 0.5
    mine = SHAPES[best][1]
    for k, (f, other) in enumerate(SHAPES):
        if f != family and shares[k] >= LEAST_SHARE and part(other - mine) > part(mine - other):
            return None
    return shares[best]


@dataclass
class LicenceModel:
    weights: np.ndarray
    heat: float = 1.0

    def probabilities(self, words: list[str]) -> np.ndarray:
        at, x = features(words)
        z = x @ self.weights[at] / self.heat
        e = np.exp(z - z.max())
        return e / e.sum()

    def classify(self, line: str) -> tuple[str, float, float] | None:
        """(family, probability, share of its best template), or None if unknown or not confirmed."""
        return self.classify_words(words_of(line))

    def classify_words(self, words: list[str]) -> tuple[str, float, float] | None:
        if not any(w in SINGLE for w in words):
            return None  # none of a template's words: no template can confirm it
        p = self.probabilities(words)
        best = int(p.argmax())
        if FAMILIES[best] == UNKNOWN or p[best] < LEAST_PROBABILITY:
            return None
        share = _confirmed(FAMILIES[best], set(pairs_of(words)))
        return None if share is None else (FAMILIES[best], float(p[best]), share)


def variants(rng: np.random.Generator, times: int) -> Iterator[tuple[list[str], int]]:
    """Changed templates with their family."""
    owners = "copyright (c) 2019 2021 the authors project team contributors university by holder notice".split()
    for k, texts in enumerate(TEMPLATES.values()):
        for text in texts:
            base = words_of(text)
            yield base, k
            for _ in range(times):
                first = int(rng.integers(1, 4)) if rng.random() < 0.3 and len(base) > 6 else 0
                words = [w for w in base[first:] if rng.random() > 0.06]
                if rng.random() < 0.3 and len(words) > 3:
                    at = int(rng.integers(len(words) - 1))
                    words[at : at + 2] = words[at : at + 2][::-1]
                if rng.random() < 0.4:
                    words = [str(x) for x in rng.choice(owners, int(rng.integers(1, 5)))] + words
                if rng.random() < 0.3:
                    words += [f"x{int(x)}" for x in rng.integers(0, 9999, int(rng.integers(1, 6)))]
                yield words, k


def unknowns(rng: np.random.Generator, times: int) -> Iterator[tuple[list[str], int]]:
    """Template words in random order, and sentences about licences that grant nothing."""
    single = sorted(SINGLE)
    about = ["driver license renewal office", "the license plate was lost", "a public library in general", "all rights to appeal were reserved for later", "version 3 of the report", "the copyright office is closed", "permission to enter was granted", "software for the general public"]
    yield from ((words_of(line), len(FAMILIES) - 1) for line in about * 8)
    for _ in range(times * 10):
        words = [single[int(k)] if rng.random() < 0.5 else f"y{int(k)}" for k in rng.integers(0, len(single), int(rng.integers(1, 25)))]
        yield words, len(FAMILIES) - 1


def train(plain: list[tuple[np.ndarray, np.ndarray]], seed: int = 5, rounds: int = 120) -> LicenceModel:
    """Fit by full gradients (Adam) on four rows of five, set the temperature on the fifth.

    ``plain``: features of lines of other text.
    """
    rng = np.random.default_rng(seed)
    data = [*variants(rng, VARIANTS), *unknowns(rng, VARIANTS)]
    rows = [*(features(w) for w, _ in data), *plain]
    labels = np.array([*(y for _, y in data), *[len(FAMILIES) - 1] * len(plain)])
    row = np.repeat(np.arange(len(rows)), [len(a) for a, _ in rows])
    at, x = np.concatenate([a for a, _ in rows]), np.concatenate([v for _, v in rows])
    dense = np.zeros((len(rows), WIDTH), np.float32)
    dense[row, at] = x
    apart = np.arange(len(rows)) % 5 == 4
    fit, y = dense[~apart], np.eye(len(FAMILIES), dtype=np.float32)[labels[~apart]]
    w, first, second = (np.zeros((WIDTH, len(FAMILIES)), np.float32) for _ in range(3))
    for k in range(1, rounds + 1):
        z = fit @ w
        e = np.exp(z - z.max(1, keepdims=True))
        grad = fit.T @ (e / e.sum(1, keepdims=True) - y) / len(fit) + 1e-4 * w
        first, second = 0.9 * first + 0.1 * grad, 0.99 * second + 0.01 * grad**2
        w = w - 0.1 * (first / (1 - 0.9**k)) / (np.sqrt(second / (1 - 0.99**k)) + 1e-8)
    z = dense[apart] @ w

    def loss(heat: float) -> float:
        s = z / heat
        s = s - s.max(1, keepdims=True)
        return float(-(s[np.arange(len(s)), labels[apart]] - np.log(np.exp(s).sum(1))).mean())

    return LicenceModel(w, float(min(np.geomspace(0.2, 5, 61), key=loss)))


def _strength(lines: list[list[str]], family: str) -> int:
    """Most word pairs of a template of the family that the joined lines hold."""
    own = set(pairs_of([w for line in lines for w in line]))
    return max(len(own & shape) for f, shape in SHAPES if f == family)


def _wrapped(lines: list[list[str]], model: LicenceModel, single: dict[int, tuple[str, float, float]]) -> Iterator[tuple[int, int, str, float, float]]:
    """(first line, number of lines, family, probability, share) of notices that stand on several lines together.

    ``lines`` are their words, ``single`` the lines that are notices of their own. A notice begins and ends with lines
    that add to what it holds of a template, and holds more of it than the single notices inside hold of theirs; a further
    line may change the family (a version at the end). Its
    inner lines have at most twice the words of the longest template.
    """
    inner = [{p for p in map(" ".join, zip(words, words[1:], strict=False)) if p in HOLDERS} for words in lines]
    cross = [{f"{a[-1]} {b[0]}"} & HOLDERS.keys() if a and b else set() for a, b in zip(lines, lines[1:], strict=False)] + [set()]
    at = 0
    while at < len(lines):
        hit, strength, words, end = None, 0, [], at
        if inner[at] or cross[at]:
            own, seen = set(), [0] * len(SHAPES)
            while end < len(lines) and lines[end] and len(words) - len(lines[at]) <= 2 * LONGEST:
                words += lines[end]
                new = (inner[end] | (cross[end - 1] if end > at else set())) - own
                own |= new
                for k in (k for p in new for k in HOLDERS[p]):
                    seen[k] += 1
                end += 1
                if end - at < 2 or not new or not any(n >= LEAST_SHARE * len(shape) for n, (_, shape) in zip(seen, SHAPES, strict=True)):
                    continue
                got = model.classify_words(words)
                if got is None:
                    continue
                now = _strength(lines[at:end], got[0])
                rest = [_strength(lines[at + 1 : end], got[0]), _strength(lines[at : end - 1], got[0]), strength, *(_strength([lines[k]], single[k][0]) for k in range(at, end) if k in single)]
                if now > max(rest):
                    hit, strength = (at, end - at, *got), now
        if hit:
            yield hit
        at += hit[1] if hit else 1


def _notices(text: str | None, model: LicenceModel) -> list[tuple[int, int, str, float, float]]:
    """(line, number of lines, family, probability, share) of the notices of a whole text, in order."""
    lines = [words_of(line) for line in (text or "").split("\n")]
    single = {k: hit for k, words in enumerate(lines) if (hit := model.classify_words(words))}
    wrapped = list(_wrapped(lines, model, single))
    covered = {k for at, n, *_ in wrapped for k in range(at, at + n)}
    return sorted([*((k, 1, *hit) for k, hit in single.items() if k not in covered), *wrapped])


def _found(batches: Iterator[pd.DataFrame], model: LicenceModel) -> Iterator[pd.DataFrame]:
    for batch in batches:
        out = [(d, *hit) for d, text in zip(batch["doc_id"], batch["text"], strict=True) for hit in _notices(text, model)]
        made = pd.DataFrame(out, columns=["doc_id", "paragraph", "n_lines", "family", "probability", "template_share"])
        made["doc_id"] = made["doc_id"].astype("Int64")
        yield made


def _plain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Features of the lines of whole texts that share fewer than two word pairs with the templates."""
    shapes = set().union(*(s for _, s in SHAPES))
    for batch in batches:
        lines = [words_of(line) for t in batch["text"] for line in (t or "").split("\n")]
        rows = [features(words) for words in lines if len(shapes.intersection(pairs_of(words))) < 2]
        yield pd.DataFrame({"at": [a.astype("<i8").tobytes() for a, _ in rows], "x": [x.astype("<f8").tobytes() for _, x in rows]})


def scan(docs: DataFrame) -> DataFrame:
    """Licence paragraphs: (doc_id, paragraph, n_lines, family, probability, template_share), one row each.

    ``paragraph`` is its first line, counted in the whole text from 0, n_lines how many it stands on. Null and empty texts have none, repeated rows give theirs
    each, a null doc_id stays null, an empty table gives an empty result; other columns are not looked at. The
    classifier sees at most ``PLAIN_DOCS`` documents as other text; all documents are scanned.
    """
    ship(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    chosen = F.broadcast(rows.select("doc_id").orderBy(F.xxhash64("doc_id"), "doc_id").limit(PLAIN_DOCS).distinct().withColumnsRenamed({"doc_id": "plain_id"}))
    got = rows.join(chosen, F.col("doc_id") == F.col("plain_id")).select("text").mapInPandas(_plain, "at binary, x binary").distinct().toPandas().sort_values(["at", "x"])
    plain = [(np.frombuffer(a, "<i8"), np.frombuffer(x, "<f8")) for a, x in zip(got["at"], got["x"], strict=True)]
    model = train(plain)
    return rows.mapInPandas(lambda batches: _found(batches, model), "doc_id long, paragraph long, n_lines long, family string, probability double, template_share double")
