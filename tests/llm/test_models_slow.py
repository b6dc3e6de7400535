"""The two learnt scans against slow references: licence windows by words, the risk's slope by differences, figures text by text."""

import random
import re

import numpy as np
import pyarrow as pa
import pytest

from tidemark.llm import licenses, quality, textops

NOTICES = [
    "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation, either version 3 of the License.",
    "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:",
    "Use of this source code is governed by a\nBSD-style license that can be\nfound in the LICENSE file.",
]


@pytest.fixture(scope="module")
def model(spark):
    rng = random.Random(1)
    docs = [(i, "\n".join(" ".join(rng.choice("the of a and river license version stone free work 1 x".split()) for _ in range(rng.randint(1, 80))) for _ in range(9))) for i in range(60)]
    return licenses.learn(spark.createDataFrame(docs, "doc_id long, text string"))


def scan(model, texts):
    rows = pa.RecordBatch.from_pydict({"doc_id": list(range(len(texts))), "text": texts})
    return next(licenses._scan(iter([rows]), model)).to_pylist()


def slow(model, text):
    """Windows word by word, grams as sets, one at a time."""
    number = {int(g): k for k, g in enumerate(model.grams)}
    blank = lambda t: re.sub(r"[^a-z0-9\n\x80-\U0010ffff]", " ", re.sub("[A-Z]", lambda m: m[0].lower(), t))
    paragraphs = [p for p in re.split(r"\n[ \t\r\f\v]*\n", blank(text).replace("\n", "\n")) if p.split()]
    found = []
    for k, p in enumerate(paragraphs):
        lines = [ln.split() for ln in p.split("\n") if ln.split()]
        for words in [*lines, *([p.split()] if len(lines) > 1 else [])]:
            for a in range(0, max(1, len(words) - 30), 30):
                some = words[a : a + 60]
                data = np.frombuffer(" ".join(some).encode(), np.uint8)
                hashed, _ = licenses._hashes(data, np.array([0, len(data)]))
                own = sorted({number[int(g)] for n in (1, 2, 3) for g in licenses._gram(hashed, n) if int(g) in number})
                z = model.weights[own].astype(float).sum(axis=0) / np.sqrt(len(some)) + model.bias
                if own and z.argmax() < len(licenses.FAMILIES):
                    likeness = max(len(set(own) & set(t.tolist())) / len(t) for t in model.templates[z.argmax()])
                    if likeness >= licenses.CONFIRMED:
                        found.append((k, licenses.FAMILIES[z.argmax()], likeness))
    return len(paragraphs), len({k for k, _, _ in found}), ",".join(sorted({f for _, f, _ in found})) or None


def test_scan_against_slow_reference(model):
    rng = random.Random(7)
    templates = [t for own in licenses.TEMPLATES.values() for t in own]
    texts = []
    for _ in range(120):
        parts = []
        for _ in range(rng.randint(0, 6)):
            part = [rng.choice("the of stone license permission é free 3 GNU".split()) for _ in range(rng.randint(0, 90))]
            if rng.random() < 0.4:
                at = rng.randint(0, len(part))
                part[at:at] = rng.choice(templates).split()
            parts.append("".join(w + rng.choice([" "] * 12 + ["\n", ", "]) for w in part))
        texts.append(rng.choice(["\n\n", "\n", "\n \t\n"]).join(parts))
    for text, got in zip(texts, scan(model, texts), strict=True):
        assert (got["n_paragraphs"], got["n_licensed"], got["licenses"]) == slow(model, text), text


def test_notices_over_several_lines(model):
    got = scan(model, [f"Title\n\n{n}\n\nAnd then the text." for n in NOTICES] + ["All rights reserved.", None])
    assert [r["license"] for r in got] == ["GPL", "BSD", "BSD", "Proprietary", None]
    assert [r["n_licensed"] for r in got] == [1, 1, 1, 1, 0]


def test_risk_slope_by_differences():
    rng = np.random.default_rng(2)
    xp, xu = rng.normal(1, 1, (40, 5)), rng.normal(0, 1, (50, 5))
    for scale, away in ((0.1, False), (30.0, True)):
        weights = [rng.normal(0, 0.5, (5, 4)), rng.normal(0, 0.1, 4), rng.normal(0, 0.5, 4) * scale, np.zeros(1)]
        if away:  # a scorer that calls all positives and no unlabelled row positive
            weights = [np.array([[50.0]] + [[0.0]] * 4), np.array([-25.0]), np.array([20.0]), np.zeros(1)]
            xp[:, 0], xu[:, 0] = 1, 0
        positive, negative, slopes = quality.risk(weights, xp, xu, 0.6)
        assert (negative < 0) == away
        value = lambda w: (lambda p, n, _: -n if away else p + n)(*quality.risk(w, xp, xu, 0.6))
        for k, w in enumerate(weights):
            for i in np.ndindex(w.shape):
                old = w[i]
                w[i] = old + 1e-5
                up = value(weights)
                w[i] = old - 1e-5
                down = value(weights)
                w[i] = old
                assert abs((up - down) / 2e-5 - slopes[k][i]) < 1e-5


@pytest.mark.parametrize("prior", [0.2, 0.5, 0.9])
def test_prior_from_positives_and_unlabelled(prior):
    rng = np.random.default_rng(4)
    p, n = rng.normal(2, 1, 5000), rng.normal(-2, 1, 5000)
    u = np.where(rng.random(5000) < prior, rng.permutation(p), n)
    assert abs(quality.estimated_prior(rng.normal(2, 1, 5000), u) - prior) < 0.06


def test_negative_labels_are_not_used(spark):
    docs = spark.createDataFrame([(i, f"word{i % 7} and {i} more of it " * (i % 9 + 1)) for i in range(60)], "doc_id long, text string")
    yes = [(i, 1) for i in range(0, 60, 2)]
    first = quality.learn(docs, spark.createDataFrame(yes, "doc_id long, quality int"))
    again = quality.learn(docs, spark.createDataFrame([*yes, *((i, 0) for i in range(1, 60, 2))], "doc_id long, quality int"))
    assert all(np.array_equal(a, b) for a, b in zip(first.weights, again.weights, strict=True))


def test_figures_text_by_text():
    rng = random.Random(3)
    texts = ["", " \n", "One. Two! two two", *("".join(rng.choice("abé AB1.,!\n\n  ") for _ in range(rng.randint(0, 300))) for _ in range(60))]
    data, at = textops.text_bytes(pa.array(texts))
    got = quality.features(data, at)
    for k, text in enumerate(texts):
        raw, words = np.frombuffer(text.encode(), np.uint8), text.split()
        assert np.allclose(got[k], quality.features(raw, np.array([0, len(raw)]))[0])
        assert np.isclose(got[k, 2], sum(c.isdigit() for c in text) / max(1, len(raw)))
        assert np.isclose(got[k, 10], np.log1p(len(raw))) and np.isclose(got[k, 11], np.log1p(len(words)))
        assert np.isclose(got[k, 14], len({w.lower().replace("É", "É") for w in words}) / max(1, len(words)))
        lines = text.split("\n") if text else []
        lines = [ln + "\n" for ln in lines[:-1]] + ([lines[-1]] if lines and lines[-1] else [])
        assert np.isclose(got[k, 24], 1 - len(set(lines)) / max(1, len(lines)))
        assert np.isclose((got[k, 26:90] ** 2).sum(), 1 if words else 0)
