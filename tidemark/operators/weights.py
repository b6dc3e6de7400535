"""Overlap of events, their uniqueness, and sample weights.

Events may begin and end between the rows of their series; one without an end
runs to the last row.  Rows without a price add nothing to return weights.
Empty event lists give empty results, and no row is covered.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.operators.running import numbered, running
from tidemark.session import staged


def concurrency(events: DataFrame, series: DataFrame) -> DataFrame:
    """How many events cover each row of the series, both ends included: a sweep over starts and ends, no range join.

    A null ``t1`` runs to the series' end.
    """
    starts = events.select("symbol", F.col("t0").alias("us"), F.lit(0).alias("kind"), F.lit(1).alias("d"))
    ends = events.where("t1 IS NOT NULL").select("symbol", F.col("t1").alias("us"), F.lit(2).alias("kind"), F.lit(-1).alias("d"))
    rows = series.select("symbol", "us", F.lit(1).alias("kind"), F.lit(0).alias("d"))
    # ties count together: marks are summed by (time, kind) first, so the sweep's rows are few and its order is total
    marks = starts.union(ends).groupBy("symbol", "us", "kind").agg(F.sum("d").alias("d")).union(rows.select("symbol", "us", "kind", F.col("d").cast("long")))
    return running(marks, ["us", "kind"], {"c": ("sum", F.col("d"))}).where("kind = 1").select("symbol", "us", "c")


#: Later than any row: where an event without an end is taken to end.
_OPEN_END = 1 << 62


def _between(events: DataFrame, rows: DataFrame, sums: list[str]) -> DataFrame:
    """Events with ``n`` rows of a series in [t0, t1] and the sums of its columns over them.

    Both ends of an event are marks in one sweep with the rows, so an event may
    begin and end at any time; prefix sums are taken where the marks stand.
    Events that repeat are swept once.
    """
    spans = events.groupBy("symbol", "t0", "t1").agg(F.count("*").cast("int").alias("_many"))
    ends = F.array(F.struct(F.col("t0").alias("us"), F.lit(0).alias("kind")), F.struct(F.coalesce("t1", F.lit(_OPEN_END)).alias("us"), F.lit(2).alias("kind")))
    marks = spans.select("symbol", "t0", "t1", "_many", F.explode(ends).alias("e")).select("symbol", "t0", "t1", "_many", "e.*")
    marks = marks.unionByName(rows.select("symbol", "us", F.lit(1).alias("kind"), *sums), allowMissingColumns=True)
    totals = {f"_{c}": ("sum", F.coalesce(c, F.lit(0.0))) for c in sums} | {"_n": ("sum", F.when(F.col("kind") == 1, 1).otherwise(0))}
    swept = running(marks, ["us", "kind"], totals).where("kind <> 1")
    over = lambda c: F.sum(F.when(F.col("kind") == 2, F.col(c)).otherwise(-F.col(c)))
    both = swept.groupBy("symbol", "t0", "t1").agg(F.first("_many").alias("_many"), over("_n").alias("n"), *(over(f"_{c}").alias(c) for c in sums))
    return both.withColumn("_each", F.explode(F.array_repeat(F.lit(1), F.col("_many")))).drop("_each", "_many")


def average_uniqueness(events: DataFrame, counts: DataFrame) -> DataFrame:
    """``tw``: the mean over an event's rows of one over their concurrency; null for an event that no row falls into."""
    shares = counts.select("symbol", "us", F.when(F.col("c") > 0, 1 / F.col("c")).alias("share"))
    return _between(events, shares, ["share"]).select("symbol", "t0", "t1", F.try_divide(F.col("share"), F.col("n")).alias("tw"))


def return_weights(events: DataFrame, counts: DataFrame, series: DataFrame) -> DataFrame:
    """``w``: size of the concurrency-shared log returns over an event, scaled to a mean of one per symbol."""
    r = running(series.join(counts, ["symbol", "us"]).select("symbol", "us", "price", "c"), ["us"], {"_before": ("last", F.col("price"))}, before=True)
    shares = r.select("symbol", "us", F.when(F.col("c") > 0, F.log(F.col("price") / F.col("_before")) / F.col("c")).alias("share"))
    rows = staged(_between(events, shares, ["share"]).select("symbol", "t0", "t1", F.abs("share").alias("raw")), "raw")
    every = rows.groupBy("symbol").agg(F.count("*").alias("_n"), F.sum("raw").alias("_sum"))
    return rows.join(every, "symbol").select("symbol", "t0", "t1", "raw", F.try_divide(F.col("raw") * F.col("_n"), F.col("_sum")).alias("w"))


def time_decay(weights: DataFrame, last: float) -> DataFrame:
    """``decay``: from 1 for the newest down to ``last`` for the oldest along cumulative uniqueness; below zero, the oldest share gets nothing."""
    if last <= -1 or last > 1:
        raise ValueError("last must be above -1 and at most 1")
    weights = staged(weights, "weights")
    rows = running(weights, ["t0"], {"_c": ("sum", F.col("tw"))}).join(weights.groupBy("symbol").agg(F.sum("tw").alias("_t")), "symbol")
    rows = rows.withColumn("_s", (1 - last) / F.col("_t") if last >= 0 else 1 / ((last + 1) * F.col("_t")))
    return rows.withColumn("decay", F.greatest(F.lit(0.0), 1 - F.col("_s") * F.col("_t") + F.col("_s") * F.col("_c"))).drop("_c", "_t", "_s")


def indicator(events: DataFrame, series: DataFrame, bucket: int) -> DataFrame:
    """The 0/1 matrix of events and rows as its non-zero cells."""
    from tidemark.operators.labels import paths

    return paths(events.where("t1 IS NOT NULL").select("symbol", "t0", "t1"), series, bucket).select("symbol", "t0", F.col("_us").alias("us"))


def matrix_uniqueness(cells: DataFrame) -> DataFrame:
    """Mean over an event's cells of one over the row's number of events."""
    held = cells.groupBy("symbol", "us").agg(F.count("*").alias("c"))
    return cells.join(held, ["symbol", "us"]).groupBy("symbol", "t0").agg(F.count("*").alias("rows"), F.avg(1 / F.col("c")).alias("u"))


#: Children of a node in the trees over events.
_FAN = 64


class _Chances:
    """Chances of events in a tree of sums: changed at leaves, drawn from the root down."""

    def __init__(self, chance: np.ndarray):
        self.n, self.levels = len(chance), []
        level = chance.astype(float)
        while True:
            padded = np.zeros(-(-len(level) // _FAN) * _FAN)
            padded[: len(level)] = level
            self.levels.append(padded)
            if len(padded) == _FAN:
                break
            level = padded.reshape(-1, _FAN).sum(1)

    def add(self, at: np.ndarray, delta: np.ndarray) -> None:
        for level in self.levels:
            np.add.at(level, at, delta)
            at = at // _FAN

    def find(self, u: float) -> int:
        """The event at the share ``u`` of all chances, in their order."""
        node, left = 0, u * self.levels[-1].sum()
        for level in reversed(self.levels):
            sums = np.cumsum(level[node * _FAN : (node + 1) * _FAN])
            child = min(int(np.searchsorted(sums, left, "right")), _FAN - 1)
            left -= sums[child - 1] if child else 0.0
            node = node * _FAN + child
        return min(node, self.n - 1)


class _Spans:
    """Events in order of their starts, in a tree of latest ends: finds those that meet a span without looking at the others."""

    def __init__(self, starts: np.ndarray, ends: np.ndarray):
        self.order = np.argsort(starts, kind="stable")
        self.starts, self.levels = starts[self.order], []
        level = ends[self.order]
        while True:
            padded = np.full(-(-len(level) // _FAN) * _FAN, -1, np.int64)
            padded[: len(level)] = level
            self.levels.append(padded)
            if len(padded) == _FAN:
                break
            level = padded.reshape(-1, _FAN).max(1)

    def meeting(self, a: int, b: int) -> np.ndarray:
        most = int(np.searchsorted(self.starts, b, "right"))  # events from here on start later
        nodes = np.arange(_FAN)
        for depth in range(len(self.levels) - 1, -1, -1):
            nodes = nodes[(nodes * _FAN**depth < most) & (self.levels[depth][nodes] >= a)]
            if depth:
                nodes = (nodes[:, None] * _FAN + np.arange(_FAN)).ravel()
        return self.order[nodes]


def draw_sequential(starts: np.ndarray, ends: np.ndarray, rows: int, draws: int, rng: np.random.Generator) -> np.ndarray:
    """Sequential bootstrap: each draw is likelier for events that overlap less with those drawn (repeats count).

    A draw changes the chances of the events that it overlaps, and no others:
    it costs the length of the event, the number of overlaps, and a path
    through two flat trees.
    """
    held = np.zeros(rows)
    size = (ends - starts + 1).astype(float)
    chances, spans = _Chances(np.ones(len(starts))), _Spans(starts, ends)
    out = np.empty(draws, np.int64)
    for k in range(draws):
        i = out[k] = chances.find(rng.random())
        a, b = int(starts[i]), int(ends[i])
        here = held[a : b + 1]
        lost = np.concatenate([[0.0], np.cumsum(1 / (2 + here) - 1 / (1 + here))])
        here += 1
        near = spans.meeting(a, b)
        lo, hi = np.maximum(starts[near], a) - a, np.minimum(ends[near], b) - a + 1
        chances.add(near, (lost[hi] - lost[lo]) / size[near])
    return out


def uniqueness_of(starts: np.ndarray, ends: np.ndarray, rows: int, drawn: np.ndarray) -> float:
    """Mean uniqueness of drawn events."""
    held = np.zeros(rows + 1)
    np.add.at(held, starts[drawn], 1)
    np.add.at(held, ends[drawn] + 1, -1)
    held = np.cumsum(held)[:rows]
    prefix = np.concatenate([[0.0], np.cumsum(np.where(held > 0, 1 / np.maximum(held, 1), 0))])
    return float(np.mean((prefix[ends[drawn] + 1] - prefix[starts[drawn]]) / (ends[drawn] - starts[drawn] + 1)))


def bootstrap(events: DataFrame, series: DataFrame, group: list[str], seed: int = 7) -> DataFrame:
    """Sequential and uniform draws, as many as events, over the rows of the series: mean uniqueness of both, by group.

    Every draw depends on all draws before it, so a group is one task, with the
    ends of its events (two numbers each) and a count for each row between the
    first and the last; a draw costs what it overlaps, not the group.  ``group``
    must hold ``symbol`` and may cut finer.  Open events are left out.
    """
    place = numbered(series.select("symbol", "us"), "pos")
    rows = events.where("t1 IS NOT NULL").join(place.select("symbol", F.col("us").alias("t0"), F.col("pos").alias("a")), ["symbol", "t0"])
    rows = rows.join(place.select("symbol", F.col("us").alias("t1"), F.col("pos").alias("b")), ["symbol", "t1"])

    def run(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(["a", "b"])
        a, b = rows["a"].to_numpy(), rows["b"].to_numpy()
        low = a.min()
        a, b = a - low, b - low
        n = int(b.max()) + 1
        rng = np.random.default_rng([seed, *(int.from_bytes(str(k).encode()[-6:], "big") for k in key)])
        sequential = draw_sequential(a, b, n, len(a), rng)
        uniform = rng.integers(0, len(a), len(a))
        return pd.DataFrame([[*key, len(a), uniqueness_of(a, b, n, uniform), uniqueness_of(a, b, n, sequential), len(np.unique(sequential))]])

    kinds = dict(rows.dtypes)
    schema = ", ".join([*(f"{g} {kinds[g]}" for g in group), "events long, u_standard double, u_sequential double, distinct_drawn long"])
    return rows.groupBy(*group).applyInPandas(run, schema)


def standard_draws(events: DataFrame, seed: int = 7) -> DataFrame:
    """Events ``symbol, t0, t1`` that uniform draws with replacement take, as many as a symbol has events, with the ``times`` that each is drawn.

    Events are numbered from 0, each draws a number by its hash, and numbers
    are counted before they meet the events.  Rows without ``t0`` are left out.
    """
    rows = staged(running(events.select("symbol", "t0", "t1"), ["t0", "t1"], {"k": ("sum", F.lit(1))}), "numbered").withColumn("k", F.col("k") - 1)
    n = rows.groupBy("symbol").agg(F.count("*").alias("n"))
    draw = F.pmod(F.xxhash64("symbol", "t0", "k", F.lit(seed)), F.col("n"))
    drawn = rows.join(n, "symbol").select("symbol", draw.alias("k")).groupBy("symbol", "k").agg(F.count("*").alias("times"))
    return rows.join(drawn, ["symbol", "k"]).select("symbol", "t0", "t1", "times")


def random_spans(rng: np.random.Generator, events: int, rows: int, longest: int) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of random events among ``rows`` rows, lengths from 1 to below ``longest``; of equal starts the last drawn stays."""
    start = rng.integers(0, rows, events)
    end = start + rng.integers(1, longest, events)
    keep = {int(a): int(b) for a, b in zip(start, end, strict=True)}
    a = np.array(sorted(keep))
    return a, np.array([keep[int(x)] for x in a])


def uniqueness_trials(trials: DataFrame, events: int, longest: int, seed: int = 7) -> DataFrame:
    """For every row ``(trial, rows)`` random events among so many rows, drawn uniformly and in sequence: ``trial, u_standard, u_sequential``."""

    def run(batches):
        for batch in batches:
            out = []
            for trial, rows in batch[["trial", "rows"]].itertuples(index=False):
                rng = np.random.default_rng([seed, trial & ((1 << 63) - 1)])
                a, b = random_spans(rng, events, max(1, rows), longest)
                n = int(b.max()) + 1
                out.append((trial, uniqueness_of(a, b, n, rng.integers(0, len(a), len(a))), uniqueness_of(a, b, n, draw_sequential(a, b, n, len(a), rng))))
            yield pd.DataFrame(out, columns=["trial", "u_standard", "u_sequential"])

    return trials.select("trial", "rows").mapInPandas(run, "trial long, u_standard double, u_sequential double")
