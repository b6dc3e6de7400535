"""Importance resampling towards a target: hashed word features, weights from two histograms, exact ranks by regular sampling.

Features of all documents and of all target texts fall into ``buckets`` by
their CRC-32.  The log ratio of the two smoothed histograms is one number a
bucket, an array that every task holds; a document's weight is the mean over
its features.  A seeded draw is added to the weight, and the highest of all are
drawn without replacement.  Their ranks are exact: sorted runs are written, a
regular sample of all runs gives splitters, rows move once to the segment they
belong to and are merged there, and counts of the segments before it tell a
segment's first rank.

A null text has no features and a weight of 0.  A null id is drawn for like an
empty one and wins ties against all others; rows that repeat a ``doc_id`` are
ranked each.  Long texts are blocks of their own.  An empty table gives an
empty result, an empty target flat gains.  Other columns are left out unless
``carry`` names them, and then stand in ``row`` whatever their names.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textops
from tidemark.llm.shared import id_order, partitions, staged

BUCKETS = 10_000
#: Samples that the runs give for each splitter; so many times the partitions, and one a run, reach the driver.
OVERSAMPLING = 64
#: Words of more bytes are hashed one by one.
_LONG_WORD = 48
_POLYNOMIAL = 0xEDB88320
_U32 = np.uint32


def _crc_table() -> np.ndarray:
    value = np.arange(256, dtype=_U32)
    for _ in range(8):
        value = np.where(value & _U32(1), (value >> _U32(1)) ^ _U32(_POLYNOMIAL), value >> _U32(1))
    return value.astype(_U32)


_TABLE = _crc_table()
#: Bytes of a word: digits, a-z, and everything outside ASCII.
_IN_WORD = np.zeros(256, dtype=bool)
_IN_WORD[0x30:0x3A] = _IN_WORD[0x61:0x7B] = _IN_WORD[0x80:] = True


def crc_onward(state: np.ndarray, data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 values carried on over the bytes [start, end) of each row."""
    size = end - start
    out = state.copy()
    order = np.argsort(-size, kind="stable")
    order = order[(size[order] <= _LONG_WORD) & (size[order] > 0)]
    begin, left, value = start[order], size[order], ~state[order]
    active = np.searchsorted(-left, -np.arange(_LONG_WORD), "left")  # rows with more than j bytes stand first
    for j in range(_LONG_WORD):
        m = int(active[j])
        if m == 0:
            break
        head = value[:m]
        value[:m] = _TABLE[(head ^ data[begin[:m] + j]) & _U32(255)] ^ (head >> _U32(8))
    out[order] = ~value
    for i in np.flatnonzero(size > _LONG_WORD).tolist():
        out[i] = zlib.crc32(data[start[i] : end[i]].tobytes(), int(state[i]))
    return out


def features(data: np.ndarray, at: np.ndarray, buckets: int = BUCKETS) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Buckets of a block's words and of the pairs that they begin (-1 where a text's last word has no next), each row's first word (n+1 values), and its number of words."""
    data = textops.ascii_lower(data)
    inside = np.zeros(len(data) + 2, dtype=bool)
    inside[1:-1] = _IN_WORD[data]
    begins, ends = inside[1:-1] & ~inside[:-2], inside[1:-1] & ~inside[2:]
    cut = at[(at > 0) & (at < len(data))]
    begins[cut] = inside[1:-1][cut]
    ends[cut - 1] = inside[1:-1][cut - 1]
    start, end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
    first = np.searchsorted(start, at)
    single = crc_onward(np.zeros(len(start), _U32), data, start, end)
    pair = np.full(len(start), -1, np.int64)
    has_next = np.ones(len(start), dtype=bool)
    has_next[first[1:][first[1:] > first[:-1]] - 1] = False
    where = np.flatnonzero(has_next)
    if len(where):
        blank = ~single[where]
        blank = ~(_TABLE[(blank ^ _U32(0x20)) & _U32(255)] ^ (blank >> _U32(8)))
        pair[where] = crc_onward(blank, data, start[where + 1], end[where + 1]) % _U32(buckets)
    return (single % _U32(buckets)).astype(np.int64), pair, first, np.diff(first)


def histogram(rows: DataFrame, column: str = "text", buckets: int = BUCKETS) -> np.ndarray:
    """Features of all texts by bucket: an array of ``buckets`` numbers, summed in the tasks before it comes to the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, data, at in textops.blocks(batch, "text"):
                single, pair, _, _ = features(data, at, buckets)
                total += np.bincount(single, minlength=buckets) + np.bincount(pair[pair >= 0], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.record_batch({"bucket": pa.array(held, pa.int64()), "n": pa.array(total[held], pa.int64())})

    parts = rows.select(F.col(column).alias("text")).mapInArrow(run, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for bucket, n in parts.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # at most one row a bucket
        out[bucket] = n
    return out


def gains(have: np.ndarray, want: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of two histograms with one added to every bucket, floored."""
    n, s, t = len(have), float(have.sum()), float(want.sum())
    return np.array([math.floor(1000 * math.log((float(b) + 1) * (s + n) / ((float(a) + 1) * (t + n)))) for a, b in zip(have.tolist(), want.tolist(), strict=True)], np.int64)


def weighed(docs: DataFrame, gain: np.ndarray, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` (and ``row``) of every document, the gains as an array in every task."""
    columns = [F.col("doc_id").cast("long").alias("doc_id"), F.col("text").alias("text")]
    row = docs.select(*columns, *([F.struct(*carry).alias("row")] if carry else []))
    kind = f", row {row.schema['row'].dataType.simpleString()}" if carry else ""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, data, at in textops.blocks(batch, "text"):
                single, pair, first, words = features(data, at, len(gain))
                one = gain[single] + np.where(pair >= 0, gain[np.maximum(pair, 0)], 0)
                total = np.concatenate([[0], np.cumsum(one)])
                n = np.where(words > 0, 2 * words - 1, 0)
                weight = np.where(n > 0, (total[first[1:]] - total[first[:-1]]) // np.maximum(n, 1), 0)
                out = {"doc_id": part.column("doc_id"), "n_words": pa.array(words, pa.int64()), "n_features": pa.array(n, pa.int64()), "weight": pa.array(weight, pa.int64())}
                yield pa.record_batch(out | ({"row": part.column("row")} if carry else {}))

    return row.mapInArrow(run, f"doc_id long, n_words long, n_features long, weight long{kind}")


def drawn_score(weight: Column, doc_id: Column, seed: int) -> Column:
    """The weight with the seeded noise of a document's id added, in thousandths."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double")
    return weight + F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0)))).cast("long")


_ORDER = ["_key", "_doc", "_tag"]


def splitters(runs: DataFrame, n: int, parts: int) -> np.ndarray:
    """``parts - 1`` rows that cut all runs into segments of about equal size, from every stride-th row of each sorted run."""
    stride = max(1, n // (parts * OVERSAMPLING))
    at = F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)
    picked = runs.select(*_ORDER, at.alias("_at")).where(F.col("_at") % stride == stride // 2).select(*_ORDER).toPandas().to_numpy(np.int64).reshape(-1, 3)
    picked = picked[np.lexsort(picked.T[::-1])]
    where = np.arange(1, parts) * len(picked) // parts
    return np.unique(picked[where], axis=0) if len(picked) else picked


def segment_of(rows: np.ndarray, cuts: np.ndarray) -> np.ndarray:
    """How many of the sorted ``cuts`` stand at or before each row, both by all columns in turn."""
    low, high = np.searchsorted(cuts[:, 0], rows[:, 0], "left"), np.searchsorted(cuts[:, 0], rows[:, 0], "right")
    out = low.copy()
    tied = np.flatnonzero(high > low)
    kind = np.dtype([(f"f{i}", np.int64) for i in range(3)])
    flat = np.ascontiguousarray(cuts).view(kind).ravel()
    out[tied] = np.searchsorted(flat, np.ascontiguousarray(rows[tied]).view(kind).ravel(), "right")
    return out


def exact_ranks(runs: DataFrame, out: str = "rank") -> DataFrame:
    """Adds each row's place from 1 in the order of ``_key, _doc, _tag`` (unique), by parallel sorting by regular sampling.

    ``runs`` is a written table whose parts are sorted by those columns.
    """
    parts = partitions(runs.sparkSession)
    n = runs.count()
    cuts = splitters(runs, n, parts)
    names = runs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys = np.stack([batch.column(c).to_numpy(zero_copy_only=False) for c in _ORDER], axis=1).astype(np.int64)
            segment = segment_of(keys, cuts) if len(cuts) else np.zeros(len(keys), np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(segment, pa.int64())], [*names, "_segment"])

    dealt = runs.mapInArrow(run, f"{', '.join(f'{f.name} {f.dataType.simpleString()}' for f in runs.schema.fields)}, _segment long")
    inside = Window.partitionBy("_segment").orderBy(*_ORDER)  # a segment is about one part in ``parts`` of all rows
    sizes = dealt.groupBy("_segment").agg(F.count("*").alias("_n"))
    before = sizes.select("_segment", F.coalesce(F.sum("_n").over(Window.orderBy("_segment").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))  # a row a segment
    placed = dealt.withColumn(out, F.row_number().over(inside).cast("long")).join(F.broadcast(before), "_segment")
    return placed.withColumn(out, F.col(out) + F.col("_before")).drop("_segment", "_before")


def resample(docs: DataFrame, target: DataFrame, percent: int = 25, least_words: int = 20, seed: int = 7, buckets: int = BUCKETS, carry: tuple[str, ...] = ()) -> DataFrame:
    """``doc_id, n_features, weight, score, rank`` of every document: those with enough words compete, ``percent`` in a hundred of them are drawn and have a rank from 1.

    Equal scores go to the smaller ``doc_id``.  With ``carry`` the named
    columns of ``docs`` come along as ``row``.
    """
    gain = gains(histogram(docs, buckets=buckets), histogram(target, buckets=buckets))
    rows = weighed(docs, gain, carry)
    rows = rows.withColumn("score", drawn_score(F.col("weight"), F.col("doc_id"), seed)).withColumn("_tag", F.monotonically_increasing_id())
    rows = rows.withColumn("_key", -F.col("score")).withColumn("_doc", id_order("doc_id")).withColumn("_in", F.col("n_words") >= least_words)
    runs = staged(rows.sortWithinPartitions("_in", *_ORDER), "runs")
    ranked = exact_ranks(runs.where("_in"))
    most = F.lit(percent * runs.where("_in").count() // 100)
    columns = ["doc_id", "n_features", "weight", "score", *(["row"] if carry else [])]
    drawn = ranked.select(*columns, F.when(F.col("rank") <= most, F.col("rank")).alias("rank"))
    return drawn.unionByName(runs.where("NOT _in").select(*columns, F.lit(None).cast("long").alias("rank")))
