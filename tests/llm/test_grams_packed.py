"""Grams leave a task packed by the bucket of their node, and infrequent edges go where they have met."""

import random
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tests.llm.test_lines_phrases_draws import phrases_by_hand
from tidemark.llm import collocations as phrases


@pytest.fixture(scope="module")
def meshed():
    """Frequent words and pairs whose triples are mostly infrequent, in two languages."""
    rng = random.Random(8)
    return [(lang, ", ".join(" ".join(rng.choice(vocabulary) for _ in range(rng.randint(1, 9))) for _ in range(40))) for lang in ("en", "dé\n|") for vocabulary in [[f"{lang[0]}w{i}" for i in range(16)]] for _ in range(60)]


def counts(rows, longest):
    f = Counter()
    for lang, text in rows:
        for piece in text.split(", "):
            w = piece.split(" ")
            f.update((lang, " ".join(w[i : i + k])) for k in range(1, longest + 1) for i in range(len(w) - k + 1))
    return f


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_infrequent_edges_are_cut(spark, meshed, longest):
    """No infrequent edge is written down, every gram is one row, and the nodes' counts are what the text has."""
    docs = spark.createDataFrame(meshed, "lang string, text string").repartition(5)
    tables = []
    for _ in range(1, longest):
        tables.append(phrases.frequent_bits(docs, 10, tables))
    grams = phrases.longest_grams(docs, longest, tables)
    rows = [tuple(r) for r in grams.select("lang", "gram", "k", "c").collect()]
    assert len({r[:2] for r in rows}) == len(rows)
    assert all(c >= 10 for _, _, k, c in rows if k == longest)
    want = counts(meshed, longest)
    assert longest == 2 or sum(c < 10 for (_, g), c in want.items() if g.count(" ") == longest - 1) > 500
    for k, flow in phrases.node_flow(grams, longest).items():
        assert {(r.lang, r.gram): r.f for r in flow.where("f >= 10").collect()} == {g: c for g, c in want.items() if g[1].count(" ") == k - 1 and c >= 10}
    assert {lang: c for lang, _, k, c in rows if k == 0} == {lang: sum(c for (at, g), c in want.items() if at == lang and " " not in g) for lang in ("en", "dé\n|")}


@pytest.mark.parametrize("longest", [2, 3])
def test_small_gathers(spark, meshed, monkeypatch, longest):
    """Tasks that tell their counts often, into many buckets, and sums in many stretches change nothing."""
    monkeypatch.setattr(phrases, "_GRAMS", 40)
    monkeypatch.setattr(phrases, "_BUCKET", 1 << 10)
    docs = spark.createDataFrame(meshed, "lang string, text string").repartition(5)
    got = sorted(map(tuple, phrases.collocations(docs, longest).collect()))
    assert got and got == phrases_by_hand(meshed, longest)


def test_packed_grams_are_small(spark):
    """A gram that leaves a task takes a few bytes, with its count (21 as a row of its own)."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    known = spark.sparkContext.broadcast([])
    n, size = phrases.packed_grams(docs, 3, known, 3).agg(F.sum("n"), F.sum(F.octet_length("packed"))).first()
    assert n > 100_000 and size < 12 * n


def test_packing_comes_back():
    grams = ["", "a", "é b", "zz \x0e c", "a"]
    rows = pa.table({"lang": ["x", "x", "y", "x", "y"], "gram": grams, "node": pa.array([1, (1 << 64) - 1, 5, (1 << 63) + 1, 1 << 63], pa.uint64()), "c": pa.array([1 << 40, 2, 3, 4, 5], pa.int64())})
    back = [(r["lang"], r["bucket"], *x.values()) for r in phrases._packed(rows, 3).to_pylist() for x in phrases._unpacked(r["n"], r["size"], r["packed"]).to_pylist()]
    assert sorted(back) == [("x", 0, "", 1 << 40), ("x", 4, "zz \x0e c", 4), ("x", 7, "a", 2), ("y", 0, "é b", 3), ("y", 4, "a", 5)]


def test_node_hashes():
    """All that leaves or ends in one node has its hash, at every length."""
    data = np.frombuffer(b"a b c d, a b e, a b, a", np.uint8)
    words = phrases._Words(data, np.array([0, len(data)]), np.array([0]))
    full = np.full(1 << (phrases._BITS - 6), (1 << 64) - 1, np.uint64)
    ahead, _, _, node = phrases._grown(words, ["en"], [full, full], 3)
    assert ahead.tolist() == [3, 3, 2, 1, 3, 2, 1, 2, 1, 1]
    assert node[0] == node[4] == node[7] and len({*node.tolist()}) == 8
