"""License scan with a trained paragraph classifier.

A paragraph ends at a blank line.  It is read in windows of words that overlap
by half, those of each line and, where it has several lines, those that run
across its line ends.  A window's features are its word 1- to 3-grams among
those of known licence statements, each weighted by one over the root of the
window's words.  Multinomial logistic regression gives each licence family and
an unknown class a probability; the unknown class is learnt from a bounded
sample of the corpus's windows, and its bias is calibrated on all of them so
that few pass as a licence.  A prediction counts only if a template of the
family is found in the window.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops
from tidemark.llm.shared import bounded_sample

#: Windows of corpus documents that train the unknown class, at most, and the documents that they come from.
SAMPLE_WINDOWS, SAMPLE_DOCS = 3000, 1500
#: Words of a window; a longer line or paragraph is read in windows that overlap by half.
WINDOW = 60
#: Share of corpus windows that may pass as a licence before templates are compared.
PASSING = 0.002
#: A window with this share of a template's grams is no example of the unknown class.
ALIKE = 0.4
#: Share of a template's grams that a paragraph must have.
CONFIRMED = 0.6

# Statements by which licences are usually declared, by family.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "AGPL": (
        "This program is licensed under the GNU Affero General Public License, version 3.",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-or-later",
    ),
    "Apache-2.0": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License.",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "BSD": (
        "Released under the 3-clause BSD License.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "CC-BY": (
        "Licensed under CC BY 4.0.",
        "This work is licensed under a Creative Commons Attribution 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "CC-BY-NC": (
        "Licensed under CC BY-NC 4.0.",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ),
    "CC-BY-SA": (
        "Licensed under CC BY-SA 4.0.",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
        "Text is available under the Creative Commons Attribution-ShareAlike License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ),
    "CC0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
        "Released under CC0 1.0 Universal, dedicated to the public domain.",
        "This is free and unencumbered software released into the public domain.",
        "SPDX-License-Identifier: CC0-1.0",
    ),
    "GPL": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation",
        "Released under the GNU GPL v2 or later.",
        "SPDX-License-Identifier: GPL-3.0-only",
    ),
    "LGPL": (
        "This library is licensed under the GNU Lesser General Public License, version 2.1.",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-only",
    ),
    "MIT": (
        "Released under the MIT License.",
        "Licensed under the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
        "SPDX-License-Identifier: MIT",
    ),
    "MPL-2.0": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
        "Licensed under the Mozilla Public License, version 2.0.",
        "SPDX-License-Identifier: MPL-2.0",
    ),
    "Proprietary": (
        "All rights reserved. No part of this publication may be reproduced or distributed without prior written permission of the publisher.",
        "This software is proprietary and confidential. Unauthorized copying of this file is strictly prohibited.",
        "All rights reserved.",
    ),
}
FAMILIES = sorted(TEMPLATES)
# Words that carry no licence on their own.
_STOP = frozenset("a an and any are as at be by can for from has have in is it may no not of on or that the this to under was with you your work program software file source code use free license licensed released version terms 0 1 2 3 4".split())
#: Every byte that is neither a letter nor a digit parts words; a line end also parts paragraphs.
_BLANK = np.arange(256, dtype=np.uint8)
_BLANK[[b for b in range(128) if not chr(b).isalnum() and b != 10]] = 32
_U64 = np.uint64


def _plain(text: str) -> np.ndarray:
    return _BLANK[textops.ascii_lower(np.frombuffer(text.encode(), np.uint8))]


def _hashes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start, end, first = textops.words(data, at)
    return textops.span_hash(textops.prefix_hash(data), start, end), first


def _gram(hashed: np.ndarray, n: int) -> np.ndarray:
    """Hashes of n words in a row, by the first."""
    out = hashed[: max(0, len(hashed) - n + 1)].copy()
    for k in range(1, n):
        out = textops.mix(out * _U64(3) + hashed[k : k + len(out)])
    return out


@dataclass
class Model:
    """Known grams (sorted), their weights by class (families, then unknown), biases, and templates' gram numbers."""

    grams: np.ndarray
    templates: list[list[np.ndarray]]
    weights: np.ndarray
    bias: np.ndarray


def _known_grams() -> tuple[np.ndarray, list[list[np.ndarray]]]:
    found: dict[int, None] = {}
    templates: list[list[np.ndarray]] = []
    for family in FAMILIES:
        own = []
        for text in TEMPLATES[family]:
            words = _plain(text).tobytes().decode().split()
            hashed, _ = _hashes(_plain(text), np.array([0, len(text.encode())]))
            keep = []
            for n in (1, 2, 3):
                for i, h in enumerate(_gram(hashed, n).tolist()):
                    if not all(w in _STOP for w in words[i : i + n]):
                        found[h] = None
                        keep.append(h)
            own.append(np.unique(np.array(keep, np.uint64)))
        templates.append(own)
    grams = np.array(sorted(found), np.uint64)
    return grams, [[np.searchsorted(grams, t) for t in own] for own in templates]


def _windows(hashed: np.ndarray, grams: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Windows (from, to) of paragraphs of words, and pairs (window, gram) of the known grams in them."""
    size = end - begin
    count = np.maximum(1, -(-(size - WINDOW) // (WINDOW // 2)) + 1)
    para = np.repeat(np.arange(len(size)), count)
    step = np.arange(len(para)) - np.repeat(np.cumsum(count) - count, count)
    lo = begin[para] + step * (WINDOW // 2)
    hi = np.minimum(lo + WINDOW, end[para])
    pairs = []
    for n in (1, 2, 3):
        rolled = _gram(hashed, n)
        at = np.minimum(np.searchsorted(grams, rolled), len(grams) - 1)
        hit = np.flatnonzero(grams[at] == rolled)
        for back in (0, 1):  # a word lies in at most two windows
            w = np.searchsorted(lo, hit, "right") - 1 - back
            ok = (w >= 0) & (hit >= lo[np.maximum(w, 0)]) & (hit + n <= hi[np.maximum(w, 0)])
            pairs.append(np.stack([w[ok], at[hit[ok]]], axis=1))
    both = np.unique(np.concatenate(pairs), axis=0) if len(hashed) else np.zeros((0, 2), np.int64)
    return lo, hi, para, both


@dataclass
class _Windows:
    """The windows of a block that hold known grams: their place, and their grams one after another."""

    row: np.ndarray
    paragraph: np.ndarray
    size: np.ndarray
    first: np.ndarray
    grams: np.ndarray
    paragraphs: np.ndarray
    total: int

    def of(self, k: int) -> np.ndarray:
        return self.grams[self.first[k] : self.first[k + 1]]


def _read(raw: np.ndarray, at: np.ndarray, grams: np.ndarray) -> _Windows:
    """All windows of a block's texts; ``paragraphs`` counts each text's, ``total`` the windows with or without known grams."""
    data = _BLANK[textops.ascii_lower(raw)]
    hashed, first = _hashes(data, at)
    start, _, _ = textops.words(data, at)
    row = np.repeat(np.arange(len(at) - 1), np.diff(first))
    ends = np.cumsum(np.append(0, raw == 10))[start] if len(start) else np.zeros(0, np.int64)
    other = np.ones(len(start), bool)
    other[1:] = row[1:] != row[:-1]
    new_line, new_paragraph = other.copy(), other.copy()
    new_line[1:] |= np.diff(ends) >= 1
    new_paragraph[1:] |= np.diff(ends) >= 2
    line, paragraph = np.flatnonzero(new_line), np.flatnonzero(new_paragraph)
    number = np.cumsum(new_paragraph) - 1
    line_end, paragraph_end = np.append(line[1:], len(start)), np.append(paragraph[1:], len(start))
    several = np.bincount(number[line], minlength=len(paragraph)) > 1
    row_of, number_of, size, pairs, total = [], [], [], [], 0
    for begin, end in ((line, line_end), (paragraph[several], paragraph_end[several])):
        if not len(begin):
            continue
        lo, hi, segment, both = _windows(hashed, grams, begin, end)
        hit, slot = np.unique(both[:, 0], return_inverse=True)
        pairs.append(np.stack([slot + sum(map(len, size)), both[:, 1]], axis=1))
        row_of.append(row[begin[segment[hit]]])
        number_of.append(number[begin[segment[hit]]])
        size.append((hi - lo)[hit])
        total += len(lo)
    some = np.concatenate(pairs) if pairs else np.zeros((0, 2), np.int64)
    join = lambda parts: np.concatenate(parts) if parts else np.zeros(0, np.int64)
    n = sum(map(len, size))
    return _Windows(join(row_of), join(number_of), join(size), np.searchsorted(some[:, 0], np.arange(n + 1)), some[:, 1], np.bincount(row[paragraph], minlength=len(at) - 1) if len(paragraph) else np.zeros(len(at) - 1, np.int64), total)


def _logits(windows: _Windows, model: Model) -> np.ndarray:
    n = len(windows.size)
    out = np.zeros((n, len(model.bias)))
    np.add.at(out, np.repeat(np.arange(n), np.diff(windows.first)), model.weights[windows.grams])
    return out / np.sqrt(np.maximum(1, windows.size))[:, None] + model.bias


def _plain_windows(windows: _Windows, templates: list[list[np.ndarray]], n_grams: int) -> np.ndarray:
    """Which windows are like no template."""
    listed = [t for own in templates for t in own]
    member = np.zeros((n_grams, len(listed)), np.int32)
    for k, t in enumerate(listed):
        member[t, k] = 1
    shared = np.zeros((len(windows.size), len(listed)), np.int32)
    np.add.at(shared, np.repeat(np.arange(len(windows.size)), np.diff(windows.first)), member[windows.grams])
    return (shared < ALIKE * member.sum(axis=0)).all(axis=1)


def _sampled(batches: Iterator[pa.RecordBatch], grams: np.ndarray, templates: list[list[np.ndarray]]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for _, raw, at in textops.blocks(batch, "text"):
            windows = _read(raw, at, grams)
            keep = np.flatnonzero(_plain_windows(windows, templates, len(grams)))
            lists = pa.array([windows.of(k).tolist() for k in keep], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(windows.size[keep].astype(np.int32)), lists], names=["size", "grams"])


def fit(sizes: list[int], found: list[list[int]], seed: int = 3) -> Model:
    """A model from the templates, whole and with words missing, alone and amid the grams of plain windows, and from plain windows (their words, and their known grams)."""
    rng = np.random.default_rng(seed)
    grams, templates = _known_grams()
    plain = list(zip(sizes, found, strict=True))
    rows, size, label = [], [], []

    def grams_of(words: list[str]) -> np.ndarray:
        data = _plain(" ".join(words))
        hashed, _ = _hashes(data, np.array([0, len(data)]))
        own = np.concatenate([_gram(hashed, n) for n in (1, 2, 3)])
        at = np.minimum(np.searchsorted(grams, own), len(grams) - 1)
        return np.unique(at[grams[at] == own])

    for f, family in enumerate(FAMILIES):
        for text in TEMPLATES[family]:
            for k in range(24):
                words = text.split()
                if k and len(words) > 4:
                    words = [w for w in words if rng.random() > 0.08]
                own, n = grams_of(words), len(words)
                if k > 2:
                    more = rng.integers(0, 40)
                    n += more
                    if plain:
                        s, g = plain[rng.integers(len(plain))]
                        own = np.union1d(own, [x for x in g if rng.random() < more / max(1, s)]).astype(int)
                rows.append(own)
                size.append(n)
                label.append(f)
    # words of licences out of order say nothing
    mixed = [w for own in TEMPLATES.values() for t in own for w in t.split()]
    for _ in range(400):
        some = [*rng.choice(mixed, rng.integers(1, 5)), *["lorem"] * rng.integers(4, 30)]
        rows.append(grams_of(list(rng.permutation(some))))
        size.append(len(some))
        label.append(len(FAMILIES))
    for s, g in plain:
        rows.append(np.array(g, int))
        size.append(s)
        label.append(len(FAMILIES))
    x = np.zeros((len(rows), len(grams)), np.float32)
    for i, (r, s) in enumerate(zip(rows, size, strict=True)):
        x[i, r] = 1 / np.sqrt(min(WINDOW, max(1, s)))
    y = np.eye(len(FAMILIES) + 1, dtype=np.float32)[label]
    w, b = np.zeros((len(grams), y.shape[1]), np.float32), np.zeros(y.shape[1], np.float32)
    vw, vb = np.zeros_like(w), np.zeros_like(b)
    for _ in range(250):  # gradient descent with momentum on the whole sample
        z = x @ w + b
        z -= z.max(axis=1, keepdims=True)
        q = np.exp(z)
        q /= q.sum(axis=1, keepdims=True)
        vw = 0.9 * vw - 8.0 * (x.T @ (q - y) / len(x) + 1e-5 * w)
        vb = 0.9 * vb - 1.0 * (q - y).mean(axis=0)
        w, b = w + vw, b + vb
    return Model(grams, templates, w, b)


#: Bins of margins, each of this width, from -_BINS / 2 of them on.
_BINS, _BIN = 4000, 0.02


def _margins(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    """How many plain windows of a task have a margin in each bin; windows without known grams count in the first."""
    counts = np.zeros(_BINS, np.int64)
    for batch in batches:
        for _, raw, at in textops.blocks(batch, "text"):
            windows = _read(raw, at, model.grams)
            plain = _plain_windows(windows, model.templates, len(model.grams))
            z = _logits(windows, model)[plain]
            margin = z[:, :-1].max(axis=1) - z[:, -1] if len(z) else np.zeros(0)
            np.add.at(counts, np.clip(np.floor(margin / _BIN).astype(int) + _BINS // 2, 0, _BINS - 1), 1)
            counts[0] += windows.total - len(windows.size)
    has = np.flatnonzero(counts)
    yield pa.RecordBatch.from_arrays([pa.array(has.astype(np.int32)), pa.array(counts[has])], names=["bin", "n"])


def calibrated(model: Model, docs: DataFrame) -> Model:
    """The model with the unknown class's bias at which a share of ``PASSING`` of all plain windows of ``docs`` pass, at most."""
    bins = docs.select("text").mapInArrow(partial(_margins, model=model), "bin int, n long").groupBy("bin").agg(F.sum("n").alias("n")).collect()  # a row a bin
    total, passing = sum(r.n for r in bins), 0
    for r in sorted(bins, key=lambda r: -r.bin):
        passing += r.n
        if passing > PASSING * total:
            model.bias[-1] += max(0.0, (r.bin + 1 - _BINS // 2) * _BIN)
            break
    return model


def learn(docs: DataFrame, seed: int = 3) -> Model:
    """Fits the model with at most ``SAMPLE_WINDOWS`` plain windows of at most ``SAMPLE_DOCS`` whole documents, by smallest hash, and calibrates it on all documents."""
    grams, templates = _known_grams()
    sample = bounded_sample(docs.select("doc_id", "text").where("text IS NOT NULL"), ["doc_id", "text"], SAMPLE_DOCS, seed, [F.col("text")])
    windows = sample.mapInArrow(partial(_sampled, grams=grams, templates=templates), "size int, grams array<int>")
    windows = windows.select("size", "grams", F.xxhash64("size", "grams", F.lit(seed)).alias("_h")).orderBy("_h").limit(SAMPLE_WINDOWS).collect()
    return calibrated(fit([r.size for r in windows], [list(r.grams) for r in windows], seed), docs)


_RESULT = "doc_id long, n_paragraphs long, n_licensed long, license string, licenses string, probability double, similarity double"


def _scan(batches: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for part, raw, at in textops.blocks(batch, "text"):
            yield _scan_block(part, raw, at, model)


def _scan_block(part: pa.RecordBatch, raw: np.ndarray, at: np.ndarray, model: Model) -> pa.RecordBatch:
    windows = _read(raw, at, model.grams)
    logits = _logits(windows, model)
    best = logits.argmax(axis=1) if len(logits) else np.zeros(0, int)
    found: dict[int, dict[int, list[tuple[float, float, str]]]] = {}
    for k in np.flatnonzero(best < len(FAMILIES)).tolist():
        likeness = max(len(np.intersect1d(windows.of(k), t, assume_unique=True)) / len(t) for t in model.templates[best[k]])
        if likeness >= CONFIRMED:
            chance = np.exp(logits[k] - logits[k].max())
            row = found.setdefault(int(windows.row[k]), {})
            p = int(windows.paragraph[k])
            row.setdefault(p, []).append((likeness, float(chance.max() / chance.sum()), FAMILIES[best[k]]))
    n = part.num_rows
    tops = [max(x for own in found[r].values() for x in own) if r in found else None for r in range(n)]
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            pa.array(windows.paragraphs.astype(np.int64)),
            pa.array([len(found.get(r, ())) for r in range(n)], pa.int64()),
            pa.array([t and t[2] for t in tops], pa.string()),
            pa.array([",".join(sorted({x[2] for own in found[r].values() for x in own})) if r in found else None for r in range(n)], pa.string()),
            pa.array([t and t[1] for t in tops], pa.float64()),
            pa.array([t and t[0] for t in tops], pa.float64()),
        ],
        names=["doc_id", "n_paragraphs", "n_licensed", "license", "licenses", "probability", "similarity"],
    )


def scan_licenses(docs: DataFrame, model: Model | None = None) -> DataFrame:
    """One row per document: ``doc_id, n_paragraphs, n_licensed, license, licenses, probability, similarity``.

    A paragraph is a stretch of lines with words, up to a blank line; it is read
    in overlapping windows, so texts are covered whole and a notice may run over
    several lines.  ``n_licensed`` counts paragraphs with a window whose
    predicted family a template confirms; ``license`` is the
    best confirmed one with its probability and template likeness, ``licenses``
    all of them in order of name, null where there is none (the unknown class).

    A null or empty text has no paragraphs.  Repeated rows and null ids give a
    row each; other columns are ignored; an empty table gives an empty result.
    """
    model = model or learn(docs)
    return docs.select("doc_id", "text").mapInArrow(partial(_scan, model=model), _RESULT)
