"""Exact removal of repeated substrings with suffix arrays.

A byte goes if some ``length``-byte string that covers it also starts earlier.
Sorting all suffixes of a corpus in one place is not possible, so the suffixes
are dealt out by content first:

1. Every window of ``length`` bytes picks an anchor, the gram of ``GRAM`` bytes
   with the smallest hash in it.  Windows next to each other share one, so a
   document has an anchor every few dozen bytes, each with a context: the
   stretch of text that its windows span.  Equal windows have equal anchors at
   equal places.
2. Anchors are sorted by hash.  Contexts that are equal throughout form a
   class; its earliest occurrence owns the class, and all others go at once.
   An anchor with one class needs nothing more.
3. The owners of the other anchors' classes are cut into lanes by the bytes
   around the anchor, finer for anchors with many classes, so that a lane holds
   texts which share at least their core.  All texts of a lane form one suffix
   array (:mod:`tidemark.llm.lyndon`).  Windows that are equal stand next to
   each other in it; all but the earliest of a run go.  Where a part is a single
   window, a lane's texts are all equal: no text moves, each block keeps only
   its earliest, and the earliest of all is found in one pass over the rest.
4. The removed stretches return to their documents.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.llm import textops
from tidemark.llm.lyndon import suffix_arrays
from tidemark.llm.shared import id_order, partitions, staged

#: Bytes of an anchor gram.
GRAM = 20
#: Text of one step of suffix sorting, and of the lanes gathered to sort those of like length together.
_SORT_BYTES, _GATHER_BYTES = 1 << 19, 6 << 20
#: Anchors with up to so many classes are cut into so many parts; beyond the last, every window is a part.
_PARTS = ((64, 2), (2048, 8))

_U64 = np.uint64


def _with_key(docs: DataFrame) -> DataFrame:
    """doc_id (null: before all others) and a text check of 64 bits, which keeps rows apart that have no id or repeat one with another text; ``row`` is the whole row but its text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    row = F.struct(*(F.col(c) for c in docs.columns if c != "text"))
    return docs.select(id_order("doc_id").alias("doc"), F.xxhash64(text).alias("check"), row.alias("row"), text.alias("text"))


def _windows(data: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First window, last window and anchor of every context of a block."""
    n = len(data) - GRAM + 1
    if n < length - GRAM + 1:
        return (np.zeros(0, np.int64),) * 3
    hashed = textops.gram_hash(data, GRAM)
    row_end = np.repeat(at[1:], np.diff(at))
    hashed |= np.where(np.arange(GRAM, n + GRAM) > row_end[:n], ~_U64(0), _U64(0))
    least = textops.rightmost_least(hashed, length - GRAM + 1)
    window = np.flatnonzero(np.arange(length, len(least) + length) <= row_end[: len(least)])
    if not len(window):
        return (np.zeros(0, np.int64),) * 3
    anchor = least[window]
    fresh = np.ones(len(window), bool)
    fresh[1:] = (anchor[1:] != anchor[:-1]) | (window[1:] != window[:-1] + 1)
    start = np.flatnonzero(fresh)
    return window[start], window[np.append(start[1:], len(window)) - 1], anchor[start]


_ANCHORS = "anchor long, context long, doc long, place long, check long, again int"


def _anchors(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """place: start (32 bits), anchor's offset (8) and number of windows less one (8).

    Text that repeats itself gives one anchor and context over and over; all
    but the first of such a run go, whatever other documents hold.  The run's
    rest is one row, with its windows in ``again`` and a key of its own, so a
    repetitive document makes no anchor frequent.
    """
    for batch in batches:
        for part, data, at in textops.blocks(batch, "text"):
            first, last, anchor = _windows(data, at, length)
            if not len(first):
                continue
            row = np.searchsorted(at, first, "right") - 1
            sums = textops.prefix_hash(data)
            start = first - at[row]
            check = part.column("check").to_numpy()[row]
            place = (start << 16) | ((anchor - first) << 8) | (last - first)
            gram = textops.span_hash(sums, anchor, anchor + GRAM)
            context = textops.span_hash(sums, first, last + length)
            again = np.zeros(len(first), np.int64)
            same = np.zeros(len(first), bool)
            same[1:] = (gram[1:] == gram[:-1]) & (context[1:] == context[:-1]) & (row[1:] == row[:-1]) & (first[1:] == last[:-1] + 1)
            if same.any():
                lead = same.copy()
                lead[1:] &= ~same[:-1]
                ends = same.copy()
                ends[:-1] &= ~same[1:]
                again[lead] = last[ends] - first[lead] + 1
                gram[lead] = textops.mix(gram[lead] ^ place[lead].view(np.uint64) ^ check[lead].view(np.uint64))
                keep = ~same | lead
                gram, context, place, check, row, again = gram[keep], context[keep], place[keep], check[keep], row[keep], again[keep]
            yield pa.RecordBatch.from_arrays(
                [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(part.column("doc").to_numpy()[row]), pa.array(place), pa.array(check), pa.array(again.astype(np.int32))],
                names=["anchor", "context", "doc", "place", "check", "again"],
            )


_FOUND = "doc long, check long, start long, windows int, anchor long, offset int, classes int"


def _classes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by anchor, context, doc, place and check: those that go at once (classes 0), and the owners of anchors with several classes.

    The owners of the last anchor wait until its classes are counted, or until
    they are so many that the number no longer matters.
    """
    kept = [np.zeros(0, np.int64)] * 5
    done = 0  # the first of kept, which are out already
    most = max(m for m, _ in _PARTS)

    def runs(rows: list[np.ndarray]) -> pa.RecordBatch:
        fresh = np.ones(len(rows[0]), bool)
        fresh[1:] = np.any([x[1:] != x[:-1] for x in rows], axis=0)
        anchor, _, doc, place, check, again = (x[fresh] for x in rows)
        return found(doc, place, check, again, anchor, np.zeros(len(doc), np.int64))

    def found(doc: np.ndarray, place: np.ndarray, check: np.ndarray, windows: np.ndarray, anchor: np.ndarray, classes: np.ndarray) -> pa.RecordBatch:
        columns = [doc, check, place >> 16, windows.astype(np.int32), anchor, ((place >> 8) & 0xFF).astype(np.int32), classes.astype(np.int32)]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["doc", "check", "start", "windows", "anchor", "offset", "classes"])

    def look(rows: list[np.ndarray], end: bool) -> pa.RecordBatch:
        nonlocal kept, done
        anchor, context, doc, place, check = rows
        new_anchor = np.ones(len(anchor), bool)
        new_anchor[1:] = anchor[1:] != anchor[:-1]
        new_class = new_anchor.copy()
        new_class[1:] |= context[1:] != context[:-1]
        number = np.cumsum(new_class) - 1
        head = np.flatnonzero(new_class)
        start = place >> 16
        later = (doc > doc[head][number]) | (start > start[head][number])
        repeat = np.zeros(len(anchor), bool)
        repeat[1:] = ~new_class[1:] & (doc[1:] == doc[:-1]) & (place[1:] == place[:-1]) & (check[1:] == check[:-1])
        owner = ~later & ~repeat
        which = np.cumsum(new_anchor) - 1
        count = np.bincount(which[new_class], minlength=which[-1] + 1)
        if done:
            count[0] = max(count[0], most + 1)
        classes = count[which]
        open_ = (which == which[-1]) & (not end) & (classes <= most)
        out = (later & ~repeat) | (owner & ~open_ & (classes > 1))
        out[:done] = False
        out = np.flatnonzero(out)
        if count[-1] > most:
            stay = np.unique([head[-1], np.flatnonzero(owner)[-1]])
            kept, done = [x[stay] for x in rows], len(stay)
        else:
            kept, done = [x[open_ & owner] for x in rows], 0
        return found(doc[out], place[out], check[out], (place[out] & 0xFF) + 1, anchor[out], np.where(later[out], 0, classes[out]))

    held: list[list[np.ndarray]] = []
    for batch in batches:
        again = batch.column("again").to_numpy()
        if again.any():
            yield runs([batch.column(i).to_numpy()[again > 0] for i in range(6)])
        if (again == 0).any():
            held.append([batch.column(i).to_numpy()[again == 0] for i in range(5)])
            if sum(len(x[0]) for x in held) >= len(kept[0]):
                yield look([np.concatenate(x) for x in zip(kept, *held, strict=True)], False)
                held.clear()
    if held or len(kept[0]):
        yield look([np.concatenate(x) for x in zip(kept, *held, strict=True)], True)


_LANES = "lane long, doc long, check long, start long, windows int, bytes binary"


def _single(lane: np.ndarray, doc: np.ndarray, check: np.ndarray, start: np.ndarray) -> pa.RecordBatch:
    """Rows of lanes without text: what a block's other windows show to go (windows above 0, under keys of their own), and each lane's earliest, still open (windows 0)."""
    order = np.lexsort((check, start, doc, lane))
    lane, doc, check, start = lane[order], doc[order], check[order], start[order]
    fresh = np.ones(len(lane), bool)
    fresh[1:] = lane[1:] != lane[:-1]
    head = np.flatnonzero(fresh)[np.cumsum(fresh) - 1]
    later = (doc > doc[head]) | (start > start[head])
    first = np.flatnonzero(~later)
    gone = np.flatnonzero(later)
    gone = gone[np.lexsort((start[gone], check[gone], doc[gone]))]
    cut = np.ones(len(gone), bool)
    a, b = gone[1:], gone[:-1]
    step = start[a] - start[b]
    cut[1:] = (doc[a] != doc[b]) | (check[a] != check[b]) | (step > 1)
    begin = gone[cut]
    last = gone[np.append(np.flatnonzero(cut)[1:], len(gone)) - 1] if len(gone) else gone
    key = textops.mix(start[begin].view(np.uint64) ^ check[begin].view(np.uint64))
    rows = np.append(first, begin)
    return pa.RecordBatch.from_arrays(
        [
            pa.array(np.append(lane[first], key.view(np.int64))),
            pa.array(doc[rows]),
            pa.array(check[rows]),
            pa.array(start[rows]),
            pa.array(np.append(np.zeros(len(first), np.int64), start[last] - start[begin] + 1).astype(np.int32)),
            pa.nulls(len(rows), pa.binary()),
        ],
        names=["lane", "doc", "check", "start", "windows", "bytes"],
    )


def _lanes(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Owners with their documents' texts: the bytes of each part of a context, under the hash of the part's core."""
    widest = length - GRAM
    for batch in batches:
        for part, data, at in textops.blocks(_unpacked(batch), "text"):
            found = part.column("found")
            lists = np.diff(found.offsets.to_numpy())
            if not lists.sum():
                continue
            row = np.repeat(np.arange(part.num_rows), lists)
            flat = found.flatten()
            first = flat.field("start").to_numpy() + at[row]
            windows = flat.field("windows").to_numpy().astype(np.int64)
            offset = flat.field("offset").to_numpy().astype(np.int64)
            anchor = flat.field("anchor").to_numpy()
            classes = flat.field("classes").to_numpy()
            place = first + offset
            sums = textops.prefix_hash(data)
            parts = np.full(len(row), widest + 1)
            for most, into in reversed(_PARTS):
                parts[classes <= most] = into
            for into in np.unique(parts):
                pick = np.flatnonzero(parts == into)
                single = []
                edges = (np.arange(into + 1) * (widest + 1)) // into  # offsets of the anchor in a window, by part
                for j in range(into):
                    lo, hi = np.maximum(first[pick], place[pick] - edges[j + 1] + 1), np.minimum(first[pick] + windows[pick] - 1, place[pick] - edges[j])
                    some = lo <= hi
                    if not some.any():
                        continue
                    own, lo, hi = pick[some], lo[some], hi[some]
                    core = textops.span_hash(sums, place[own] - edges[j], place[own] - edges[j + 1] + 1 + length)
                    lane = textops.mix(core ^ anchor[own].view(np.uint64) ^ _U64(into * 1009 + j))
                    if into == widest + 1:
                        single.append((lane.view(np.int64), part.column("doc").to_numpy()[row[own]], part.column("check").to_numpy()[row[own]], lo - at[row[own]]))
                        continue
                    size = hi - lo + length
                    ends = np.concatenate([[0], np.cumsum(size)])
                    taken = data[np.arange(ends[-1]) + np.repeat(lo - ends[:-1], size)]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array(lane.view(np.int64)),
                            pa.array(part.column("doc").to_numpy()[row[own]]),
                            pa.array(part.column("check").to_numpy()[row[own]]),
                            pa.array(lo - at[row[own]]),
                            pa.array(np.zeros(len(own), np.int32)),
                            pa.Array.from_buffers(pa.binary(), len(own), [None, pa.py_buffer(ends.astype(np.int32).tobytes()), pa.py_buffer(taken.tobytes())]),
                        ],
                        names=["lane", "doc", "check", "start", "windows", "bytes"],
                    )
                if single:
                    yield _single(*(np.concatenate(x) for x in zip(*single, strict=True)))


def _sorted_lanes(rows: list[np.ndarray], checks: pa.ListArray, data: np.ndarray, ends: np.ndarray, length: int) -> pa.RecordBatch:
    """Suffix arrays of whole lanes: the windows that also start earlier, as stretches."""
    lane, doc, start = rows
    size = np.diff(ends)
    fresh = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
    symbols = np.zeros(len(data) + len(size), np.int32)
    at = ends[:-1] + np.arange(len(size))
    text_of = np.repeat(np.arange(len(size)), size + 1)
    letters = np.ones(len(symbols), bool)
    letters[at + size] = False
    symbols[letters] = data.astype(np.int32) + 1
    order = suffix_arrays(symbols, np.append(at[fresh], len(symbols)))
    own = text_of[order]
    window = order + length <= at[own] + size[own]
    order, own = order[window], own[window]
    view = np.lib.stride_tricks.sliding_window_view(symbols.astype(np.int16), length)
    same = np.zeros(len(order), bool)
    for a in range(1, len(order), 1 << 16):
        b = min(len(order), a + (1 << 16))
        same[a:b] = (view[order[a:b]] == view[order[a - 1 : b - 1]]).all(axis=1) & (lane[own[a:b]] == lane[own[a - 1 : b - 1]])
    run = np.cumsum(~same) - 1
    begin = start[own] + order - at[own]
    rank = np.lexsort((begin, doc[own], run))
    head = np.flatnonzero(np.diff(run[rank], prepend=-1))
    low = rank[head]
    gone = (doc[own] > doc[own][low][run]) | (begin > begin[low][run])
    hit = np.sort(order[gone])
    if len(hit):
        cut = np.concatenate([[True], (np.diff(hit) > 1) | (text_of[hit][1:] != text_of[hit][:-1])])
        a = hit[cut]
        windows = np.diff(np.append(np.flatnonzero(cut), len(hit)))
    else:
        a, windows = hit, hit
    t = text_of[a]
    every = checks.take(pa.array(t))
    many = np.repeat(np.arange(len(t)), np.diff(every.offsets.to_numpy()))
    return pa.RecordBatch.from_arrays(
        [pa.array(doc[t][many]), every.flatten(), pa.array((start[t] + a - at[t])[many]), pa.array(windows.astype(np.int32)[many])],
        names=["doc", "check", "start", "windows"],
    )


def _once(batch: pa.RecordBatch) -> pa.RecordBatch:
    """Rows of one lane, doc, start and text as one, with all their checks."""
    data, ends = textops.text_bytes(batch.column("bytes"))
    lane, doc, start = (batch.column(c).to_numpy() for c in ("lane", "doc", "start"))
    text, size = textops.span_hash(textops.prefix_hash(data), ends[:-1], ends[1:]), np.diff(ends)
    fresh = np.ones(batch.num_rows, bool)
    fresh[1:] = np.any([x[1:] != x[:-1] for x in (lane, doc, start, text, size)], axis=0)
    head = np.flatnonzero(fresh)
    check = batch.column("check").to_numpy()
    group = np.cumsum(fresh) - 1
    order = np.lexsort((check, group))
    check, group = check[order], group[order]
    new = np.ones(len(check), bool)
    new[1:] = (check[1:] != check[:-1]) | (group[1:] != group[:-1])
    offsets = np.concatenate([[0], np.cumsum(np.bincount(group[new], minlength=len(head)))]).astype(np.int32)
    lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(check[new]))
    return pa.RecordBatch.from_arrays([pa.array(lane[head]), pa.array(doc[head]), lists, pa.array(start[head]), batch.column("bytes").take(pa.array(head))], names=["lane", "doc", "checks", "start", "bytes"])


def _suffix_sort(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by lane, doc, start and bytes.  Lanes of one text are done; the others are sorted by length and worked off in blocks.

    A lane with texts has at most as many different ones as ``_PARTS`` allows
    classes, so it is gathered; a lane without is one pass that remembers its
    earliest row.
    """
    low = np.zeros((3, 0), np.int64)
    held: list[pa.RecordBatch] = []
    gathered, limit = 0, _GATHER_BYTES

    def work(last: bool) -> Iterator[pa.RecordBatch]:
        nonlocal held, gathered, limit
        batch = pa.concat_batches(held)
        lane = batch.column("lane").to_numpy()
        head = np.flatnonzero(np.concatenate([[True], lane[1:] != lane[:-1]]))
        stop = batch.num_rows if last else int(head[-1])
        held = [batch.slice(stop)] if stop < batch.num_rows else []
        data, ends = textops.text_bytes(batch.column("bytes"))
        gathered = int(ends[-1] - ends[stop])
        limit = max(_GATHER_BYTES, 2 * gathered)
        head = head[head < stop]
        count = np.diff(np.append(head, stop))
        weight = ends[head + count] - ends[head]
        several = np.flatnonzero(count > 1)
        several = several[np.argsort(weight[several], kind="stable")]
        todo = np.cumsum(weight[several]) // _SORT_BYTES
        for chosen in np.split(several, np.flatnonzero(np.diff(todo)) + 1):
            if not len(chosen):
                continue
            rows = np.repeat(head[chosen] - np.concatenate([[0], np.cumsum(count[chosen])[:-1]]), count[chosen]) + np.arange(count[chosen].sum())
            size = ends[rows + 1] - ends[rows]
            own_ends = np.concatenate([[0], np.cumsum(size)])
            own_data = data[np.arange(own_ends[-1]) + np.repeat(ends[rows] - own_ends[:-1], size)]
            yield _sorted_lanes([batch.column(c).to_numpy()[rows] for c in ("lane", "doc", "start")], batch.column("checks").take(pa.array(rows)), own_data, own_ends, length)

    for batch in batches:
        without = batch.column("bytes").is_null().to_numpy(zero_copy_only=False)
        if without.any():
            lane, doc, check, start, windows = (batch.column(i).to_numpy()[without] for i in range(5))
            open_ = np.flatnonzero(windows == 0)
            rows = np.concatenate([low, [lane[open_], doc[open_], start[open_]]], axis=1)
            if rows.shape[1]:
                fresh = np.ones(rows.shape[1], bool)
                fresh[1:] = rows[0, 1:] != rows[0, :-1]
                head = rows[:, np.flatnonzero(fresh)[np.cumsum(fresh) - 1]]
                windows[open_] = ((rows[1:] > head[1:]).any(axis=0))[low.shape[1] :]
                low = head[:, -1:]
            some = windows > 0
            yield pa.RecordBatch.from_arrays([pa.array(x[some]) for x in (doc, check, start, windows)], names=["doc", "check", "start", "windows"])
            batch = batch.filter(pa.array(~without))
        if not batch.num_rows:
            continue
        batch = _once(batch)
        held.append(batch)
        gathered += batch.column("bytes").nbytes
        if gathered >= limit:
            yield from work(False)
    if held:
        yield from work(True)


def _packed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts compressed one by one, for the shuffle."""
    press = zstandard.ZstdCompressor(level=3)
    for batch in batches:
        packed = pa.array([press.compress(x.as_buffer()) for x in batch.column("text").cast(pa.binary())], pa.binary())
        yield pa.RecordBatch.from_arrays([batch.column("doc"), batch.column("check"), batch.column("row"), packed], names=["doc", "check", "row", "packed"])


def _unpacked(batch: pa.RecordBatch) -> pa.RecordBatch:
    open_ = zstandard.ZstdDecompressor()
    names = [n for n in batch.schema.names if n != "packed"]
    text = pa.array([open_.decompress(x.as_buffer()) for x in batch.column("packed")], pa.binary())
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), text], names=[*names, "text"])


def _cut(batches: Iterator[pa.RecordBatch], length: int, with_text: bool) -> Iterator[pa.RecordBatch]:
    """Documents with the stretches that go: what stays."""
    for batch in batches:
        for part, data, at in textops.blocks(_unpacked(batch), "text"):
            gone = part.column("gone")
            lists = np.diff(gone.offsets.to_numpy())
            row = np.repeat(np.arange(part.num_rows), lists)
            flat = gone.flatten()
            first = flat.field("start").to_numpy() + at[row]
            depth = np.zeros(len(data) + 1, np.int64)
            np.add.at(depth, first, 1)
            np.add.at(depth, first + flat.field("windows").to_numpy() + length - 1, -1)
            out = np.cumsum(depth)[:-1] > 0
            begins = out.copy()
            begins[1:] &= ~out[:-1]
            inner = at[(at > 0) & (at < len(data))]
            begins[inner] = out[inner]
            removed = np.concatenate([[0], np.cumsum(out)])
            spans = np.concatenate([[0], np.cumsum(begins)])
            n_removed, n_spans = removed[at[1:]] - removed[at[:-1]], spans[at[1:]] - spans[at[:-1]]
            kept = [(data[a:b][~out[a:b]] if k else data[a:b]).tobytes() for a, b, k in zip(at[:-1], at[1:], n_removed, strict=True)]
            texts = [x.decode("utf-8", "ignore") for x in kept] if with_text else [None] * len(kept)
            yield pa.RecordBatch.from_arrays(
                [part.column("row"), pa.array(np.diff(at)), pa.array(n_removed), pa.array(n_spans), pa.array([hashlib.sha256(x).hexdigest() for x in kept]), pa.array(texts, pa.string())],
                names=["row", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"],
            )


def remove_repeats(docs: DataFrame, length: int = 100, with_text: bool = False) -> DataFrame:
    """One row per document: ``row`` (its columns but the text), ``n_bytes, n_removed, n_spans, kept_sha256`` and, if asked for, ``kept``.

    ``kept`` is what stays as text; where a cut runs through a character of
    several bytes, the rest of that character goes too.

    Texts are UTF-8 bytes; a null is an empty text.  A byte goes if a string of
    ``length`` bytes that covers it also starts earlier: in a document with a
    smaller doc_id, or in the same one further left.  Strings are judged on
    the input and never cross documents; overlapping repeats count.

    A null doc_id stands before every other.  Rows that repeat a doc_id stand
    at the same place in that order, so at equal starts neither is earlier and
    repeated rows of one document keep their text alike.  Documents shorter
    than ``length`` stay as they are.  Long documents are worked on whole.  An
    empty table gives an empty result; other columns are ignored.
    """
    spark = docs.sparkSession
    spread = partitions(spark)
    keyed = _with_key(docs)
    anchors = keyed.drop("row").mapInArrow(partial(_anchors, length=length), _ANCHORS)
    anchors = anchors.repartition(spread, "anchor").sortWithinPartitions("anchor", "context", "doc", "place", "check")
    found = staged(anchors.mapInArrow(_classes, _FOUND), "repeats")

    packed = keyed.mapInArrow(_packed, T.StructType([*keyed.drop("text").schema.fields, T.StructField("packed", T.BinaryType())]))
    owners = found.where("classes > 0").groupBy("doc", "check").agg(F.collect_list(F.struct("start", "windows", "anchor", "offset", "classes")).alias("found"))
    lanes = packed.drop("row").join(owners.hint("shuffle_hash"), ["doc", "check"]).mapInArrow(partial(_lanes, length=length), _LANES)
    lanes = lanes.repartition(spread, "lane").sortWithinPartitions("lane", "doc", "start", "bytes")
    more = lanes.mapInArrow(partial(_suffix_sort, length=length), "doc long, check long, start long, windows int")
    gone = found.where("classes = 0").select("doc", "check", "start", "windows").union(more)
    gone = gone.groupBy("doc", "check").agg(F.collect_list(F.struct("start", "windows")).alias("gone"))
    joined = packed.join(gone.hint("shuffle_hash"), ["doc", "check"], "left").withColumn("gone", F.coalesce("gone", F.array().cast("array<struct<start:bigint,windows:int>>")))
    figures = [T.StructField(c, T.LongType()) for c in ("n_bytes", "n_removed", "n_spans")] + [T.StructField(c, T.StringType()) for c in ("kept_sha256", "kept")]
    return joined.mapInArrow(partial(_cut, length=length, with_text=with_text), T.StructType([packed.schema["row"], *figures]))
