"""Sequential kernels over sorted series: state moves from batch to batch, so memory does not grow with the series."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.running import blocked, unblocked
from tidemark.session import staged
from tidemark.sources.tapes import DAY


def scan_series(frame: DataFrame, keys: list[str], order: list[str], start: Callable[[pd.DataFrame], object], step: Callable[[object, pd.DataFrame], tuple[object, pd.DataFrame]], schema: str) -> DataFrame:
    """Runs ``step(state, rows)`` over every key's rows in order, a batch at a time.

    Rows are dealt by key and sorted (on disk where need be); a key's state
    starts anew with ``start(rows)`` of its first rows.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, state = None, None
        for batch in batches:
            if not len(batch):
                continue
            marks = batch[keys].ne(batch[keys].shift()).any(axis=1).to_numpy()
            marks[0] = True
            cuts = [*np.flatnonzero(marks), len(batch)]
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                part = batch.iloc[a:b]
                own = tuple(part[keys].iloc[0])
                if own != key:
                    key, state = own, start(part)
                state, out = step(state, part)
                if len(out):
                    yield out

    return frame.repartition(*keys).sortWithinPartitions(*keys, *order).mapInPandas(run, schema)


def _decayed(state: tuple, x: np.ndarray, keep: float) -> tuple[tuple, np.ndarray]:
    """Moves an EWM state ``(weight, weight of squares, mean, sum of squares)`` over values; also the deviation after each.

    A missing value (NaN) ages the weights and adds nothing.
    """
    out = []
    step = max(1, min(len(x), int(60 / -np.log(keep))))  # powers of ``keep`` stay far from the ends of a double
    for a in range(0, len(x), step):
        w, w2, m, s = state
        part = x[a : a + step]
        seen = ~np.isnan(part)
        if w == 0 and seen.any():
            m = part[seen][0]
        y = np.where(seen, part - m, 0.0)
        p = keep ** np.arange(1, len(y) + 1)
        ws, ws2 = p * (w + np.cumsum(seen / p)), p**2 * (w2 + np.cumsum(seen / p**2))
        first, second = p * np.cumsum(y / p), p * (s + np.cumsum(y**2 / p))
        some = np.where(ws > 0, ws, 1)
        square = np.maximum(0, second - first**2 / some)
        bias = ws - ws2 / some
        out.append(np.where(bias > 1e-12 * ws, np.sqrt(square / np.where(bias > 0, bias, 1)), np.nan))
        state = (ws[-1], ws2[-1], m + first[-1] / some[-1], square[-1])
    return state, np.concatenate(out)


def ewm_std(frame: DataFrame, value: str, span: int, out: str = "vol") -> DataFrame:
    """Exponentially weighted standard deviation, bias-corrected, with weights that start at the first row (per symbol, by ``us``).

    A row without a value ages the weights of those before it, adds nothing,
    and shows the deviation that stands; null until there are two values.

    Two levels: a day's own state is an aggregate, the states of days are
    chained (one row a day), and every day's rows go on from the state before it.
    """
    keep = 1 - 2 / (span + 1)
    known = F.nanvl(F.col(value).cast("double"), F.lit(None).cast("double"))
    rows = staged(frame.select("symbol", "us", "price", known.alias(value), F.floor(F.col("us") / DAY).cast("long").alias("_day")), "returns")
    day = Window.partitionBy("symbol", "_day")
    after = F.row_number().over(day.orderBy(F.desc("us"))) - 1
    part = rows.select("symbol", "_day", value, F.avg(value).over(day).alias("_c"), F.pow(F.lit(keep), after).alias("_p")).withColumn("_y", F.col(value) - F.col("_c"))
    weight = F.when(F.col(value).isNotNull(), F.col("_p")).otherwise(0.0)
    total = lambda c: F.coalesce(F.sum(c), F.lit(0.0))
    own = part.groupBy("symbol", "_day").agg(F.count("*").cast("double").alias("n"), F.sum(weight).alias("w"), F.sum(weight**2).alias("w2"), F.coalesce(F.first("_c"), F.lit(0.0)).alias("c"), total(F.col("_p") * F.col("_y")).alias("s1"), total(F.col("_p") * F.col("_y") ** 2).alias("s2"))

    def chain(state, days):
        before = []
        for n, bw, bw2, c, s1, s2 in days[["n", "w", "w2", "c", "s1", "s2"]].itertuples(index=False):
            before.append(state)
            w, w2, m, s = state
            aged, aged2, faded = w * keep**n, w2 * keep ** (2 * n), s * keep**n
            if bw == 0:  # a day without a value
                state = (aged, aged2, m, faded)
                continue
            mean, square = c + s1 / bw, max(0.0, s2 - s1 * s1 / bw)
            gap, total = mean - m, aged + bw
            state = (total, aged2 + bw2, m + gap * bw / total, faded + square + gap * gap * aged * bw / total)
        done = days[["symbol", "_day"]].copy()
        done[["_w", "_w2", "_m", "_s"]] = np.array(before).reshape(-1, 4)
        return state, done

    empty = (0.0, 0.0, 0.0, 0.0)
    before = scan_series(own, ["symbol"], ["_day"], lambda _: empty, chain, "symbol string, _day long, _w double, _w2 double, _m double, _s double")

    def step(state, part):
        state, values = _decayed(state, part[value].to_numpy(float), keep)
        done = part[["symbol", "us", "price", value]].copy()
        done[out] = values
        return state, done

    begin = lambda part: tuple(part[c].iloc[0] for c in ("_w", "_w2", "_m", "_s"))
    done = scan_series(rows.join(before, ["symbol", "_day"]), ["symbol", "_day"], ["us"], begin, step, f"symbol string, us long, price long, {value} double, {out} double")
    return done.withColumn(value, F.nanvl(value, F.lit(None).cast("double"))).withColumn(out, F.nanvl(out, F.lit(None).cast("double")))


def walk(state: tuple[float, float, float], values: list[float], thresholds: list[float], positive_first: bool = False, on_levels: bool = True) -> tuple[tuple[float, float, float], list[tuple[int, int]]]:
    """Moves the sums ``(up, down, last value)`` over values; the places that pass their thresholds, with the side."""
    up, down, last = state
    hits = []
    for i, (x, h) in enumerate(zip(values, thresholds, strict=True)):
        d, last = (x - last if on_levels else x), x
        if d != d:
            up = down = 0.0
            continue
        up, down = max(0.0, up + d), min(0.0, down + d)
        low, high = down < -h, up > h
        if low and not (positive_first and high):
            down = 0.0
            hits.append((i, -1))
        elif high:
            up = 0.0
            hits.append((i, 1))
    return (up, down, last), hits


#: Rows of a chunk of a CUSUM series, and rounds after which what is left of a series runs in order.
CHUNK_ROWS, ROUNDS = 1 << 16, 6

_EVENT = "symbol string, chunk long, us long, price long, direction int"


def _first_runs(moves: DataFrame, positive_first: bool) -> DataFrame:
    """Every chunk from zero sums: its events, and rows of direction 0 with the sums where a batch ends."""

    def step(state, rows):
        sums, hits = walk((*state, float("nan")), rows["d"].tolist(), rows["h"].tolist(), positive_first, False)
        picked = rows.iloc[[*(i for i, _ in hits), len(rows) - 1]][["symbol", "chunk", "us", "price"]].copy()
        picked["direction"] = np.array([*(s for _, s in hits), 0], np.int32)
        picked["up"], picked["down"] = sums[0], sums[1]
        return sums[:2], picked

    return scan_series(moves, ["symbol", "chunk"], ["us"], lambda _: (0.0, 0.0), step, f"{_EVENT}, up double, down double")


def _runs_again(moves: DataFrame, positive_first: bool) -> DataFrame:
    """Chunks from the sums ``n_up, n_down`` until they agree with the run from ``o_up, o_down``: events up to there, then rows of direction 0 whose ``met`` tells whether they do."""

    def start(rows):
        return tuple(rows[c].iloc[0] for c in ("n_up", "n_down", "o_up", "o_down"))

    def step(state, rows):
        picks, sides = [], []
        if state is not None:
            new, old = (*state[:2], float("nan")), (*state[2:], float("nan"))
            for i, (d, h) in enumerate(zip(rows["d"].tolist(), rows["h"].tolist(), strict=True)):
                new, hit = walk(new, [d], [h], positive_first, False)
                old, _ = walk(old, [d], [h], positive_first, False)
                if hit:
                    picks.append(i)
                    sides.append(hit[0][1])
                if new[:2] == old[:2]:
                    break
            state = None if new[:2] == old[:2] else (*new[:2], *old[:2])
            done = rows.iloc[[*picks, i]][["symbol", "chunk", "us", "price"]].copy()
            done["direction"] = np.array([*sides, 0], np.int32)
            done["up"], done["down"], done["met"] = new[0], new[1], state is None
            return state, done
        return None, rows.iloc[:0]

    return scan_series(moves, ["symbol", "chunk"], ["us"], start, step, f"{_EVENT}, up double, down double, met boolean")


def cusum(frame: DataFrame, value: str, threshold: str, positive_first: bool = False, on_levels: bool = True) -> DataFrame:
    """Symmetric CUSUM events (per symbol, by ``us``): rows where the sum of moves passes the threshold of the row.

    A missing move sets both sums to zero.  The side that fires starts again
    from zero, the other goes on; the negative side is looked at first unless
    ``positive_first``.  ``on_levels`` takes moves as differences of ``value``.

    A series is cut into chunks that all run at once from zero sums.  A chunk
    whose true sums at its start are others runs again from those, only until
    both runs have the same sums (a sum that is cut off at zero, or a reset):
    from there on they agree to the last bit.  Sums at the ends of chunks are
    handed on until none changes.  What is not settled after ``ROUNDS`` rounds
    (sums that never come back to zero) goes on in order from the last chunk
    that is.
    """
    rows, w = blocked(frame.select("symbol", "us", "price", F.col(value).cast("double").alias("_v"), F.col(threshold).cast("double").alias("h")), 1)
    move = F.col("_v") - F.lag("_v").over(w) if on_levels else F.col("_v")
    chunk = F.floor(F.col("_pos") / CHUNK_ROWS).cast("long")
    moves = rows.withColumn("d", F.coalesce(move, F.lit(float("nan")))).withColumn("chunk", chunk)
    moves = staged(unblocked(moves, 1).select("symbol", "chunk", "us", "price", "d", "h"), "moves")
    runs = staged(_first_runs(moves, positive_first), "runs")
    events = runs.where("direction <> 0").select(*(c.split()[0] for c in _EVENT.split(", ")))
    ends = runs.where("direction = 0").groupBy("symbol", "chunk").agg(F.max_by(F.struct("up", "down"), "us").alias("e"))
    ends = ends.select("symbol", "chunk", F.lit(0.0).alias("o_up"), F.lit(0.0).alias("o_down"), "e.up", "e.down")
    before = Window.partitionBy("symbol").orderBy("chunk")

    def unsettled(ends: DataFrame) -> DataFrame:
        """Chunks that did not run from the sums that the chunk before them ends with: a few numbers a chunk."""
        due = ends.withColumn("n_up", F.coalesce(F.lag("up").over(before), F.lit(0.0))).withColumn("n_down", F.coalesce(F.lag("down").over(before), F.lit(0.0)))
        return due.where("n_up <> o_up OR n_down <> o_down")

    for _ in range(ROUNDS):
        due = staged(unsettled(ends).select("symbol", "chunk", "n_up", "n_down", "o_up", "o_down"), "due")
        if not due.limit(1).count():
            break
        again = staged(_runs_again(moves.join(due, ["symbol", "chunk"]), positive_first), "again")
        last = again.where("direction = 0").groupBy("symbol", "chunk").agg(F.max_by(F.struct("up", "down", "met", "us"), "us").alias("e"))
        cut = last.select("symbol", "chunk", F.when(F.col("e.met"), F.col("e.us")).otherwise(F.lit((1 << 63) - 1)).alias("_cut"))
        kept = events.join(cut, ["symbol", "chunk"], "left").where("_cut IS NULL OR us > _cut").drop("_cut")
        events = staged(kept.unionByName(again.where("direction <> 0").drop("up", "down", "met")), "events")
        fresh = due.select("symbol", "chunk", "n_up", "n_down").join(last, ["symbol", "chunk"], "left")
        fresh = fresh.select("symbol", "chunk", "n_up", "n_down", F.when(~F.col("e.met"), F.col("e.up")).alias("_up"), F.when(~F.col("e.met"), F.col("e.down")).alias("_down"))
        ends = ends.join(fresh, ["symbol", "chunk"], "left")
        ends = staged(ends.select("symbol", "chunk", F.coalesce("n_up", "o_up").alias("o_up"), F.coalesce("n_down", "o_down").alias("o_down"), F.coalesce("_up", "up").alias("up"), F.coalesce("_down", "down").alias("down")), "ends")
    else:
        left = staged(unsettled(ends).groupBy("symbol").agg(F.min_by(F.struct("chunk", "n_up", "n_down"), "chunk").alias("s")).select("symbol", F.col("s.chunk").alias("_from"), "s.n_up", "s.n_down"), "left")
        if left.limit(1).count():

            def on(state, rows):
                sums, hits = walk((*state, float("nan")), rows["d"].tolist(), rows["h"].tolist(), positive_first, False)
                picked = rows.iloc[[i for i, _ in hits]][["symbol", "chunk", "us", "price"]].copy()
                picked["direction"] = np.array([s for _, s in hits], np.int32)
                return sums[:2], picked

            rest = scan_series(moves.join(left, "symbol").where("chunk >= _from"), ["symbol"], ["us"], lambda rows: (rows["n_up"].iloc[0], rows["n_down"].iloc[0]), on, _EVENT)
            events = events.join(left.select("symbol", "_from"), "symbol", "left").where("_from IS NULL OR chunk < _from").drop("_from").unionByName(rest)
    return events.select("symbol", "us", "price", "direction")
