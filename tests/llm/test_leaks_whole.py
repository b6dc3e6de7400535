"""Benchmark decontamination with production parameters: short items, edits anywhere, texts that repeat themselves."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa

from tests.llm.test_text_operators import near
from tidemark.llm import decontaminate, textops

Q, WINDOW, EDITS, LEAST = 12, 80, 5, 12


def found(docs, items, least=LEAST):
    out = set()
    data, at = textops.text_bytes(pa.array([t for _, t in docs]))
    points, ends, _ = decontaminate.normalised(data, at)
    for bench in decontaminate.Benchmark.build([i for i, _ in items], [" ".join(t.split()) for _, t in items], Q, WINDOW, EDITS, least):
        got = decontaminate.leaks(points, ends, bench, bench.filter())
        out |= {(docs[r][0], int(bench.ids[i])) for r, i in zip(got["row"].tolist(), got["item"].tolist(), strict=True)}
    return out


def test_every_width_against_brute_force():
    rng = random.Random(11)
    letters = "abcdefghijkl "
    items = [(w, "".join(rng.choice(letters[:-1]) if k in (0, w - 1) or k % 6 else " " for k in range(w))) for w in range(12, 91)]
    docs = []
    for k in range(160):
        _, text = items[rng.randrange(len(items))] if k % 2 else items[4 + k % 20]  # every other one from the widths where the plain bound fails
        piece = list(text)
        for _ in range(rng.randint(0, 6)):
            at = rng.randrange(len(piece))
            piece[at : at + rng.randint(0, 1)] = rng.choice(["", "z", "yy"])
        docs.append((k, "".join(rng.choice(letters) for _ in range(20)) + "".join(piece) + "".join(rng.choice(letters) for _ in range(20))))
    want = set()
    for d, t in docs:
        t = " ".join(t.split())
        for i, s in items:
            s = " ".join(s.split())
            w = min(WINDOW, len(s))
            if any(near(s[a : a + w], t) <= EDITS * w // WINDOW for a in range(len(s) - w + 1)):
                want.add((d, i))
    assert found(docs, items) == want
    assert len({i for _, i in want}) > 30


def test_cases_once_missed():
    items = [(1, "what is the capital"), (2, "abcdefghijklmnopqrstuvwxyz 0123456"), (3, "short one")]
    edited = list(items[1][1])
    edited[10], edited[21] = "#", "#"
    docs = [(1, "well: what is tha capital, then"), (2, "".join(edited)), (3, "a short one")]
    assert found(docs, items) == {(1, 1), (2, 2)}
    assert found(docs, items, 1) == {(1, 1), (2, 2), (3, 3)}


def test_texts_that_repeat_themselves_stay_small():
    items = [(1, "-" * 1000), (2, "=-" * 400 + " the end of it"), (3, "every good boy does fine and then some more of it, as the saying goes, always and ever")]
    docs = [(1, "-" * 10_000), (2, "=-" * 30_000), (3, items[2][1] * 300), (4, "nothing of the kind " * 500)]
    tracemalloc.start()
    assert found(docs, items) == {(1, 1), (2, 2), (3, 3)}
    assert tracemalloc.get_traced_memory()[1] < 500 << 20
    tracemalloc.stop()


def test_pieces_of_hits_lose_nothing(monkeypatch):
    rng = np.random.default_rng(3)
    items = [(i, "the same prompt before every question of this set: " + "".join(rng.choice(list("abcdef "), 60))) for i in range(30)]
    docs = [(k, " ".join("".join(rng.choice(list("abcdef"), 6)) for _ in range(20)) + " " + items[k][1] + " tail " * 9) for k in range(30)]
    whole = found(docs, items)
    monkeypatch.setattr(decontaminate, "_HITS", 500)
    assert found(docs, items) == whole and {(k, k) for k in range(30)} <= whole
