"""A join of a few documents is few files and few rounds, however many partitions a shuffle has."""

import numpy as np
import pytest

from tidemark.llm import components as comp
from tidemark.llm import jaccard_join
from tidemark.llm.shared import staged


@pytest.fixture
def many_partitions(spark):
    held = {k: spark.conf.get(k) for k in ("spark.sql.shuffle.partitions", "spark.sql.adaptive.coalescePartitions.enabled")}
    spark.conf.set("spark.sql.shuffle.partitions", "40")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    yield spark
    for k, v in held.items():
        spark.conf.set(k, v)


def test_few_files(many_partitions, some_docs, monkeypatch):
    files = {}

    def counted(frame, name):
        out = staged(frame, name)
        files[name] = max(files.get(name, 0), len(out.inputFiles()))
        return out

    monkeypatch.setattr(jaccard_join, "staged", counted)
    monkeypatch.setattr(comp, "staged", counted)
    got = sorted(tuple(r) for r in jaccard_join.jaccard_components(some_docs).collect())
    assert any(d != c for d, _, c in got)
    assert max(files.values()) <= max(8, many_partitions.sparkContext.defaultParallelism), files


def test_links_that_come_later(spark):
    rng = np.random.default_rng(4)
    roots, seen = None, []
    for k in range(3):
        some = [(int(a), int(b)) for a, b in rng.integers(0, 90, (25, 2)) if a != b]
        seen += some
        roots = comp.joined(roots, staged(spark.createDataFrame(some, "u long, v long"), "links"))
        want = {r.node: r.root for r in comp.components(spark.createDataFrame(seen, "u long, v long")).collect()}
        assert {r.node: r.root for r in roots.collect()} == want
        assert roots.count() == len(want)
