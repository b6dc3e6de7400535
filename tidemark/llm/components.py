"""Connected components of a link table, without gathering links anywhere."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import discard, few, light, staged


#: Links that a task looks at together at most, but for one batch more.
_GATHERED = 1 << 18


def _gathered(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    held, size = [], 0
    for batch in batches:
        held.append((batch.column("u").to_numpy(), batch.column("v").to_numpy()))
        size += batch.num_rows
        if size >= _GATHERED:
            yield tuple(np.concatenate(x) for x in zip(*held, strict=True))
            held, size = [], 0
    if size:
        yield tuple(np.concatenate(x) for x in zip(*held, strict=True))


def _forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Replaces some links of a task at a time by links from every node to the smallest node it reaches by them."""
    for u, v in _gathered(batches):
        nodes, back = np.unique(np.concatenate([u, v]), return_inverse=True)
        a, b = back[: len(u)], back[len(u) :]
        label = np.arange(len(nodes))
        while True:
            low = np.minimum(label[a], label[b])
            before = label.copy()
            np.minimum.at(label, label[a], low)
            np.minimum.at(label, label[b], low)
            np.minimum.at(label, a, low)
            np.minimum.at(label, b, low)
            label = label[label]
            if np.array_equal(before, label):
                break
        far = label != np.arange(len(nodes))
        yield pa.RecordBatch.from_arrays([pa.array(nodes[far]), pa.array(nodes[label[far]])], names=["u", "v"])


def joined(roots: DataFrame | None, links: DataFrame) -> DataFrame:
    """Components ``(node, root)`` of all links so far: of those that gave ``roots`` (none at first) and of ``links(u, v)``.

    The new links are looked at between the components that they join, so what
    is settled already is not gone through again.  Both are tables.
    """
    if roots is None:
        return components(links)
    n = roots.count()
    root_of = lambda end: light(roots.select(F.col("node").alias(end), F.col("root").alias(f"{end}_root")), n)
    ends = links.join(root_of("u"), "u", "left").join(root_of("v"), "v", "left")
    ends = staged(few(ends.select(F.coalesce("u_root", "u").alias("u"), F.coalesce("v_root", "v").alias("v")).distinct(), links.count()), "links")
    above = components(ends)
    m = above.count()
    old = roots.join(light(above.select(F.col("node").alias("root"), F.col("root").alias("top")), m), "root", "left").select("node", F.coalesce("top", "root").alias("root"))
    new = above.join(light(roots.select("node"), n), "node", "left_anti").select("node", "root")
    out = staged(few(old.union(new), n + m), "roots")
    discard(ends, above)
    return out


def components(links: DataFrame, max_rounds: int = 60) -> DataFrame:
    """Rows ``(node, root)`` for every node of ``links(u, v)``; ``root`` is the smallest node that it reaches.

    Alternates two steps until nothing changes: every node hands the smallest
    of its neighbours to its larger neighbours, then to its smaller ones.  The
    smallest neighbour is an aggregate with map-side combine, so a node with
    very many links is no hot task.  Links may repeat and point either way;
    self-links say nothing.  An empty table gives an empty table.
    """
    edges = (
        links.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        .where("u <> v")
        .mapInArrow(_forest, "u long, v long")
        .distinct()
    )
    n = links.count()
    edges = staged(few(edges, n), "links")
    seen = None
    for _ in range(max_rounds):
        both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        low = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        larger = both.where("v > u").join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
        larger = larger.where("u <> v").distinct()
        low = larger.groupBy("u").agg(F.min("v").alias("m"))
        smaller = larger.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).union(low.select("u", F.col("m").alias("v")))
        before, edges = edges, staged(few(smaller.where("u <> v").distinct(), 2 * n), "links")
        discard(before)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.count_if(F.col("u") < F.col("v"))).first()
        if now == seen:
            break
        seen = now
    else:
        raise RuntimeError(f"components did not settle in {max_rounds} rounds")
    roots = edges.select(F.col("u").alias("node"), F.col("v").alias("root"))
    out = staged(few(roots.union(roots.select(F.col("root").alias("node"), "root").distinct()), 2 * n), "roots")
    discard(edges)
    return out
