"""Benchmark decontamination by the q-gram lemma.

Two strings of ``window`` characters within ``edits`` edits of each other share
at least ``window - q + 1 - q * edits`` q-grams, on diagonals that differ by
``edits`` at most.  So the q-grams of a text are looked up among those of the
benchmark; hits are counted in overlapping diagonal bands, within stretches of
one window's length; and only regions that meet the bound are aligned, inside
their band.  A document leaks an item if some window of the item aligns with
it within the budget.

Items too short for the bound to be positive at ``q`` are looked up by shorter
grams.  Windows that repeat, in an item or in a text, are looked at once, and
hits are counted in pieces of bounded number, so a ruler line takes no more
memory than other text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache, partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from tidemark.llm import textops

#: Benchmark characters that are sent to the executors at a time; a larger benchmark takes several passes.
SHARD_CHARS = 2_000_000
_FILTER_BITS = 22
#: Alignments of one step.
_AT_ONCE = 4096
#: Hits and window starts that are held together.
_HITS = 1 << 20


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Lower case of every code point (white space becomes a blank), and a random 64-bit code for each."""
    low = np.arange(0x110000, dtype=np.uint32)
    for c in range(0x20000):
        ch = chr(c)
        if ch.isspace():
            low[c] = 32
        elif len(small := ch.lower()) == 1:
            low[c] = ord(small)
    return low, textops.mix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)


def normalised(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Lower-cased code points with runs of white space as one blank, row offsets, and each one's place in its original text."""
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    starts = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[at]
    low = _tables()[0][points]
    keep = np.ones(len(low), bool)
    blank = low == 32
    keep[1:] = ~(blank[1:] & blank[:-1])
    inner = starts[(starts > 0) & (starts < len(low))]
    keep[inner] = True
    place = np.flatnonzero(keep)
    return low[keep], np.searchsorted(place, starts), place - np.repeat(starts[:-1], np.diff(np.searchsorted(place, starts)))


def _grams(points: np.ndarray, q: int) -> np.ndarray:
    n = len(points) - q + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    sums = np.empty(len(points) + 1, np.uint64)
    sums[0] = 0
    np.cumsum(_tables()[1][points] * textops.powers(len(points)), out=sums[1:])
    return textops.mix((sums[q:] - sums[:-q]) * textops.powers(n, inverse=True))


def gram_width(width: np.ndarray, q: int, window: int, edits: int) -> np.ndarray:
    """The grams by which items of these compared widths are found: ``q``, or a power of two at which the lemma's bound is positive."""
    most = width // (edits * width // window + 1)
    return np.where(most >= q, q, 1 << np.maximum(0, np.floor(np.log2(np.maximum(most, 1)))).astype(np.int64))


def _first_windows(points: np.ndarray, at: np.ndarray, width: np.ndarray) -> np.ndarray:
    """Which points lie in a window (of its row's width) that is the first of its kind in its row."""
    row = np.repeat(np.arange(len(at) - 1), np.diff(at))
    start = np.flatnonzero(np.arange(len(points)) + width[row] <= at[row + 1])
    end = start + width[row[start]]
    sums = np.concatenate([[np.uint64(0)], np.cumsum(_tables()[1][points] * textops.powers(len(points)), dtype=np.uint64)])
    key = textops.span_hash(sums, start, end) ^ textops.mix(row[start].astype(np.uint64) + np.uint64(1))
    once = np.unique(key, return_index=True)[1]
    mark = np.zeros(len(points) + 1, np.int64)
    np.add.at(mark, start[once], 1)
    np.add.at(mark, end[once], -1)
    return np.cumsum(mark)[:-1] > 0


@dataclass
class Benchmark:
    """Items' normalised characters, and where each distinct q-gram stands in them."""

    points: np.ndarray
    at: np.ndarray
    ids: np.ndarray
    grams: np.ndarray
    first: np.ndarray
    places: np.ndarray
    q: int
    window: int
    edits: int

    @classmethod
    def build(cls, ids: list[int], texts: list[str], q: int, window: int, edits: int, least: int) -> list[Benchmark]:
        """The items by the width of their grams; those of fewer than ``least`` characters are left out."""
        data, at = textops.text_bytes(pa.array(texts, pa.string()))
        points, at, _ = normalised(data, at)
        size = np.diff(at)
        own = np.where(size >= max(1, least), gram_width(np.minimum(size, window), q, window, edits), 0)
        return [cls._of(np.asarray(ids, np.int64)[own == k], points[np.repeat(own == k, size)], np.append(0, np.cumsum(size[own == k])), int(k), window, edits) for k in np.unique(own[own > 0])]

    @classmethod
    def _of(cls, ids: np.ndarray, points: np.ndarray, at: np.ndarray, q: int, window: int, edits: int) -> Benchmark:
        hashed = _grams(points, q)
        end = np.repeat(at[1:], np.diff(at))[: len(hashed)]
        # a window that an item repeats says nothing new
        fresh = _first_windows(points, at, np.minimum(window, np.diff(at)))[: len(hashed)]
        inside = np.flatnonzero(fresh & (np.arange(len(hashed)) + q <= end))
        order = inside[np.argsort(hashed[inside], kind="stable")]
        grams, first = np.unique(hashed[order], return_index=True)
        return cls(points, at, ids, grams, np.append(first, len(order)), order, q, window, edits)

    def filter(self) -> np.ndarray:
        mark = np.zeros(1 << _FILTER_BITS, bool)
        mark[(self.grams >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)] = True
        return mark


def _aligned(bench: Benchmark, item_from: np.ndarray, width: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray, diagonal: np.ndarray) -> np.ndarray:
    """Least edits of each item window against its text row, over the diagonals ``diagonal .. diagonal + 4 * edits``."""
    reach = 4 * bench.edits + 1
    lane = np.arange(reach)
    cost = np.zeros((len(item_from), reach), np.int32)
    best = np.full(len(item_from), 1 << 20)
    for i in range(int(width.max(initial=0))):
        y = item_from[:, None] + i + diagonal[:, None] + lane
        inside = (y >= low[:, None]) & (y < high[:, None])
        x = bench.points[np.minimum(item_from + i, len(bench.points) - 1)]
        hit = inside & (text[np.clip(y, 0, len(text) - 1)] == x[:, None])
        new = cost + ~hit
        new[:, :-1] = np.minimum(new[:, :-1], cost[:, 1:] + 1)
        cost = np.minimum.accumulate(new - lane, axis=1) + lane
        done = width == i + 1
        best[done] = cost[done].min(axis=1)
    return best


_NONE = {k: np.zeros(0, np.int64) for k in ("row", "item", "text_from", "item_from", "width", "edits", "shared")}


def leaks(points: np.ndarray, at: np.ndarray, bench: Benchmark, mark: np.ndarray) -> dict[str, np.ndarray]:
    """Leaks of one block: row, item and the best aligned window of each."""
    q = bench.q
    hashed = _grams(points, q)
    near = np.flatnonzero(mark[(hashed >> np.uint64(64 - _FILTER_BITS)).astype(np.int64)])
    slot = np.searchsorted(bench.grams, hashed[near])
    true = bench.grams[np.minimum(slot, len(bench.grams) - 1)] == hashed[near] if len(bench.grams) else np.zeros(len(near), bool)
    near, slot = near[true], slot[true]
    row = np.searchsorted(at, near, "right") - 1
    whole = near + q <= at[row + 1]
    near, slot, row = near[whole], slot[whole], row[whole]
    count = bench.first[slot + 1] - bench.first[slot]
    reach = bench.window + 2 * bench.edits + q  # what an alignment spans of a text, at most
    if count.sum() > _HITS:  # stretches that a text repeats say nothing new
        fresh = _first_windows(points, at, np.minimum(reach, np.diff(at)))[near]
        near, slot, row, count = near[fresh], slot[fresh], row[fresh], count[fresh]
    found, a = [], 0
    total = np.concatenate([[0], np.cumsum(count)])
    while a < len(near):
        b = max(int(np.searchsorted(total, total[a] + _HITS, "right")) - 1, int(np.searchsorted(near, near[a] + 2 * reach)))
        found.append(_leaks_of(near[a:b], slot[a:b], row[a:b], points, at, bench))
        if b >= len(near):
            break
        a = int(np.searchsorted(near, near[b] - reach))
    if not found:
        return _NONE
    return _best({k: np.concatenate([x[k] for x in found]) for k in _NONE}, len(bench.ids))


def _best(out: dict[str, np.ndarray], items: int) -> dict[str, np.ndarray]:
    """One window of each row and item: that with the fewest edits, the first of these."""
    order = np.lexsort((out["item_from"], out["edits"], out["item"], out["row"]))
    key = out["row"][order] * items + out["item"][order]
    once = np.ones(len(order), bool)
    once[1:] = key[1:] != key[:-1]
    return {k: v[order[once]] for k, v in out.items()}


def _leaks_of(near: np.ndarray, slot: np.ndarray, row: np.ndarray, points: np.ndarray, at: np.ndarray, bench: Benchmark) -> dict[str, np.ndarray]:
    """Leaks among some hits of a block."""
    q, e = bench.q, bench.edits
    count = bench.first[slot + 1] - bench.first[slot]
    ends = np.cumsum(count)
    j = bench.places[np.arange(ends[-1]) + np.repeat(bench.first[slot] - ends + count, count)]
    i, row = np.repeat(near, count), np.repeat(row, count)
    item = np.searchsorted(bench.at, j, "right") - 1
    length = np.diff(bench.at)[item]
    width = np.minimum(bench.window, length)
    budget = e * width // bench.window
    need = width - q + 1 - q * budget  # positive by the choice of q

    # every hit counts in the two bands that hold its diagonal
    step = max(1, e)
    band = np.concatenate([(i - j) // step, (i - j) // step - 1])
    i, j, row, item, width, need = (np.concatenate([x, x]) for x in (i, j, row, item, width, need))
    order = np.lexsort((j, band, item, row))
    i, j, row, item, width, need, band = (x[order] for x in (i, j, row, item, width, need, band))
    new = np.ones(len(j), bool)
    new[1:] = (row[1:] != row[:-1]) | (item[1:] != item[:-1]) | (band[1:] != band[:-1])
    group = np.cumsum(new) - 1
    far = np.minimum(np.arange(len(j)) + need - 1, len(j) - 1)
    enough = (np.arange(len(j)) + need <= len(j)) & (group[far] == group) & (j[far] - j <= width - q)
    n = np.flatnonzero(enough)
    if not len(n):
        return _NONE
    # possible window starts by candidate, the best supported tried first
    start_low = np.maximum(j[far[n]] + q - width[n], bench.at[item[n]])
    start_high = np.minimum(j[n], bench.at[item[n] + 1] - width[n])
    last = np.searchsorted(group * (len(bench.points) + 1) + j, group[n] * (len(bench.points) + 1) + np.minimum(j[n] + width[n] - q, len(bench.points)), "right")
    support = last - n
    pair = np.flatnonzero(np.diff(row[n] * len(bench.ids) + item[n], prepend=-1))
    pair_of = np.repeat(np.arange(len(pair)), np.diff(np.append(pair, len(n))))
    best = np.lexsort((-support, pair_of))[np.searchsorted(pair_of, np.arange(len(pair)))]
    found = {k: [] for k in _NONE}

    def test(which: np.ndarray, start: np.ndarray) -> np.ndarray:
        passed = np.zeros(len(which), bool)
        for a in range(0, len(which), _AT_ONCE):
            w, s = which[a : a + _AT_ONCE], start[a : a + _AT_ONCE]
            m = n[w]
            diagonal = band[m] * step - e
            cost = _aligned(bench, s, width[m], points, at[row[m]], at[row[m] + 1], diagonal)
            good = (cost <= e * width[m] // bench.window) & (s >= start_low[w]) & (s <= start_high[w])
            passed[a : a + len(w)] = good
            for k, v in (("row", row[m]), ("item", item[m]), ("text_from", np.maximum(at[row[m]], s + i[m] - j[m])), ("item_from", s), ("width", width[m]), ("edits", cost), ("shared", support[w])):
                found[k].append(v[good])
        return passed

    settled = np.zeros(len(pair), bool)
    settled[pair_of[best[test(best, start_high[best])]]] = True
    # every other start that the bound allows, each place and band once
    spread = np.maximum(0, start_high - start_low + 1)
    rest, a = np.flatnonzero(~settled[pair_of]), 0
    while a < len(rest):
        b = max(a + 1, int(np.searchsorted(np.cumsum(spread[rest[a:]]), _HITS, "right")) + a)
        some = rest[a:b]
        some = some[~settled[pair_of[some]]]
        a = b
        if not len(some):
            continue
        ends = np.cumsum(spread[some])
        which, start = np.repeat(some, spread[some]), np.arange(ends[-1]) + np.repeat(start_low[some] - ends + spread[some], spread[some])
        order = np.lexsort((start, band[n[which]], pair_of[which]))
        which, start = which[order], start[order]
        once = np.ones(len(which), bool)
        once[1:] = (start[1:] != start[:-1]) | (band[n[which[1:]]] != band[n[which[:-1]]]) | (pair_of[which[1:]] != pair_of[which[:-1]])
        which, start = which[once], start[once]
        settled[pair_of[which[test(which, start)]]] = True
    return _best({k: np.concatenate(v) for k, v in found.items()}, len(bench.ids))


_LEAKS = "doc_id long, item_id long, doc_start long, doc_end long, item_start long, item_end long, edits int, shared_grams int"


def _report(batches: Iterator[pa.RecordBatch], shard: list[Benchmark]) -> Iterator[pa.RecordBatch]:
    marks = [bench.filter() for bench in shard]
    for batch in batches:
        for part, data, at in textops.blocks(batch, "text"):
            points, ends, place = normalised(data, at)
            for bench, mark in zip(shard, marks, strict=True):
                got = leaks(points, ends, bench, mark)
                if len(got["row"]):
                    yield _reported(part, ends, place, bench, got)


def _reported(part: pa.RecordBatch, ends: np.ndarray, place: np.ndarray, bench: Benchmark, got: dict[str, np.ndarray]) -> pa.RecordBatch:
    a = np.minimum(got["text_from"], ends[got["row"] + 1] - 1)
    b = np.minimum(got["text_from"] + got["width"], ends[got["row"] + 1]) - 1
    item_start = got["item_from"] - bench.at[got["item"]]
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id").take(pa.array(got["row"])),
            pa.array(bench.ids[got["item"]]),
            pa.array(place[a].astype(np.int64)),
            pa.array(place[np.maximum(a, b)].astype(np.int64) + 1),
            pa.array(item_start),
            pa.array(item_start + got["width"]),
            pa.array(got["edits"].astype(np.int32)),
            pa.array(got["shared"].astype(np.int32)),
        ],
        names=["doc_id", "item_id", "doc_start", "doc_end", "item_start", "item_end", "edits", "shared_grams"],
    )


def _without(batches: Iterator[pa.RecordBatch], shard: list[Benchmark]) -> Iterator[pa.RecordBatch]:
    marks = [bench.filter() for bench in shard]
    for batch in batches:
        for part, data, at in textops.blocks(batch, "text"):
            points, ends, _ = normalised(data, at)
            clean = np.ones(part.num_rows, bool)
            for bench, mark in zip(shard, marks, strict=True):
                clean[leaks(points, ends, bench, mark)["row"]] = False
            yield part.filter(pa.array(clean))


def _shards(benchmark: DataFrame, q: int, window: int, edits: int, least: int) -> Iterator[list[Benchmark]]:
    """The benchmark in pieces of bounded size, read one after another."""
    ids, texts, size = [], [], 0
    for item in benchmark.where("text IS NOT NULL").select("item_id", "text").orderBy("item_id", "text").toLocalIterator():
        ids.append(-1 if item.item_id is None else item.item_id)
        texts.append(" ".join(item.text.split()))
        size += len(item.text)
        if size >= SHARD_CHARS:
            yield Benchmark.build(ids, texts, q, window, edits, least)
            ids, texts, size = [], [], 0
    if ids:
        yield Benchmark.build(ids, texts, q, window, edits, least)


def find_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 12, window: int = 80, edits: int = 5, least: int = 12) -> DataFrame:
    """One row per document and item that it leaks, with the best aligned window.

    Texts and items are compared by lower-cased characters with runs of white
    space as one blank.  A document leaks an item if ``window`` characters of
    the item in a row (a shorter item: all of it, with the budget in
    proportion) align with a stretch of the document within ``edits`` edits.
    ``doc_start, doc_end`` are approximate places in the original text,
    ``item_start, item_end`` places in the compared item.

    Items of fewer than ``least`` characters are too short to tell a leak from
    common words and never match; a smaller ``least`` looks for them as well.  Null and empty texts or items match nothing; a null item_id shows as -1.
    Rows that repeat a document report alike, rows that repeat an item_id
    report each.  Empty tables give an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    out = None
    for shard in _shards(benchmark, q, window, edits, least):
        part = docs.select("doc_id", "text").mapInArrow(partial(_report, shard=shard), _LEAKS)
        out = part if out is None else out.union(part)
    return spark.createDataFrame([], _LEAKS) if out is None else out


def without_leaks(docs: DataFrame, benchmark: DataFrame, q: int = 12, window: int = 80, edits: int = 5, least: int = 12) -> DataFrame:
    """The documents that leak no item, with all their columns (see :func:`find_leaks`)."""
    for shard in _shards(benchmark, q, window, edits, least):
        docs = docs.mapInArrow(partial(_without, shard=shard), docs.schema)
    return docs
