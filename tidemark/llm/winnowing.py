"""Document fingerprints by winnowing.

A text's k-grams are hashed as they roll by; of every window of ``window``
hashes the smallest is chosen, the rightmost where several are equal, and kept
with its position.  So any stretch of ``window + k - 1`` bytes that two texts
share gives both the same hash at the same place in the stretch, and no match
shorter than ``k`` counts.  A text of fewer than ``k`` bytes gives the hash of
all of it; one with fewer than ``window`` grams gives their smallest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops
from tidemark.llm.shared import id_order, partitions

GRAM, WINDOW = 16, 32
#: Bytes of text that are looked at together.
_BLOCK = 2 << 20


def chosen(data: np.ndarray, at: np.ndarray, k: int = GRAM, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Chosen hashes (32 bits), their positions in their texts, and row offsets, for all texts of a block."""
    rows = np.arange(len(at) - 1)
    size = np.diff(at)
    grams = np.maximum(size - k + 1, 0)
    hashed = textops.gram_hash(data, k)
    n = len(hashed)
    # windows at a text's start may hold fewer grams only if the text has no more: pad by comparing inside the text
    row_of = np.repeat(rows, size)[:n]
    inside = np.arange(n) + k <= at[row_of + 1]
    key = np.where(inside, hashed, ~np.uint64(0))
    least = textops.rightmost_least(key, window)
    full = np.flatnonzero(np.arange(len(least)) + window + k - 1 <= at[np.repeat(rows, size)[: len(least)] + 1])
    place = least[full]
    short = np.flatnonzero((grams > 0) & (grams < window))
    extra = []
    for r in short.tolist():
        own = key[at[r] : at[r] + grams[r]] >> np.uint64(24)
        extra.append(at[r] + int(len(own) - 1 - np.argmin(own[::-1])))
    tiny = np.flatnonzero((grams == 0) & (size > 0))
    fresh = np.ones(len(place), bool)
    fresh[1:] = place[1:] != place[:-1]
    place = np.concatenate([place[fresh], np.asarray(extra, np.int64), at[tiny]])
    place = np.sort(place)
    owner = np.searchsorted(at, place, "right") - 1
    value = np.append(hashed, np.uint64(0))[np.minimum(place, n)]
    small = size[owner] < k
    value[small] = textops.span_hash(textops.prefix_hash(data), place[small], at[owner[small] + 1])
    value >>= np.uint64(32)
    return value.astype(np.uint32), (place - at[owner]).astype(np.uint32), np.searchsorted(owner, np.arange(len(at)))


def likeness(a: np.ndarray, a_at: np.ndarray, b: np.ndarray, b_at: np.ndarray) -> np.ndarray:
    """Per row, twice the shared chosen hashes over all chosen hashes (as multisets); 1 for two empty texts."""
    n = len(a_at) - 1

    def counted(v: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.unique((np.repeat(np.arange(n, dtype=np.uint64), np.diff(at)) << np.uint64(32)) | v, return_counts=True)

    ka, ca = counted(a, a_at)
    kb, cb = counted(b, b_at)
    where = np.minimum(np.searchsorted(kb, ka), max(0, len(kb) - 1))
    both = np.minimum(ca, cb[where]) * (kb[where] == ka) if len(kb) else np.zeros(len(ka))
    shared = np.bincount((ka >> np.uint64(32)).astype(np.int64), both, n)
    total = np.diff(a_at) + np.diff(b_at)
    return np.where(total > 0, 2 * shared / np.maximum(total, 1), 1.0)


def _text(value: np.ndarray, place: np.ndarray, at: np.ndarray) -> list[str]:
    """Hash and position of every chosen gram, eight hexadecimal digits each."""
    both = np.stack([value, place], axis=1).astype(">u4").tobytes().hex()
    ends = (at * 16).tolist()
    return [both[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


_RESULT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"


def _prints(batches: Iterator[pa.RecordBatch], k: int, window: int) -> Iterator[pa.RecordBatch]:
    """Rows sorted by part and rank; every part ends with the next document after its last, which only gives its text."""
    held: list[tuple] = []
    gathered = 0

    def work(last: bool) -> pa.RecordBatch | None:
        nonlocal held, gathered
        rows, held = held, [] if last else held[-1:]
        gathered = sum(len(r[3]) for r in held)
        texts = [r[3] for r in rows]
        turned = [i for i in range(len(rows) - 1) if rows[i][0] == rows[i + 1][0] and not rows[i][4]]
        if not turned:
            return None
        edited, chars = [], []
        for i in turned:
            own, following = texts[i].decode(), texts[i + 1].decode()
            half = len(own) // 2
            chars.append(len(own))
            edited.append((own[: len(own) - half] + following[:half]).encode())
        pack = lambda xs: (np.frombuffer(b"".join(xs), np.uint8), np.concatenate([[0], np.cumsum([len(x) for x in xs])]).astype(np.int64))
        value, place, at = chosen(*pack(texts), k, window)
        value_e, place_e, at_e = chosen(*pack(edited), k, window)
        own = _text(value, place, at)
        row = np.asarray(turned)
        pick = lambda r: (value[np.arange(np.diff(at)[r].sum()) + np.repeat(at[r] - np.concatenate([[0], np.cumsum(np.diff(at)[r])[:-1]]), np.diff(at)[r])], np.concatenate([[0], np.cumsum(np.diff(at)[r])]))
        mine, mine_at = pick(row)
        return pa.RecordBatch.from_arrays(
            [
                pa.array([rows[i][1] for i in turned], pa.int64()),
                pa.array(chars, pa.int64()),
                pa.array([hashlib.sha256(x).hexdigest() for x in edited]),
                pa.array([own[i] for i in turned]),
                pa.array(_text(value_e, place_e, at_e)),
                pa.array(likeness(mine, mine_at, value_e, at_e)),
                pa.array(likeness(mine, mine_at, *pick(row + 1))),
            ],
            names=["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"],
        )

    for batch in batches:
        for row in zip(batch.column("part").to_pylist(), batch.column("doc_id").to_pylist(), batch.column("rank").to_pylist(), (x.as_buffer().to_pybytes() for x in batch.column("text").cast(pa.binary())), batch.column("guest").to_pylist(), strict=True):
            held.append(row)
            gathered += len(row[3])
            if gathered >= _BLOCK and len(held) > 1:
                if (out := work(False)) is not None:
                    yield out
    if len(held) > 1 and (out := work(True)) is not None:
        yield out


def fingerprints(docs: DataFrame, k: int = GRAM, window: int = WINDOW) -> DataFrame:
    """One row per document, with its fingerprint, its edited text's, and how like they are.

    Documents stand in a ring by descending doc_id (a null id last, rows that
    repeat an id by their text).  The edited text has its last
    ``floor(n_chars / 2)`` code points replaced by the first as many (or all) of
    the next document's.  Fingerprints are over the UTF-8 bytes: 16 hexadecimal
    digits for each chosen gram, hash before position, so equal texts have
    equal fingerprints and an empty text an empty one.  ``near_edited`` and
    ``near_next`` compare the document's chosen hashes with those of its edited
    text and of the next document: twice the shared ones over all, 1 if neither
    has any.

    A null text is an empty one.  A single document is its own next.  Repeated
    rows give a result row each.  An empty table gives an empty result; other
    columns are ignored.
    """
    spark = docs.sparkSession
    text = F.coalesce("text", F.lit(""))
    rows = docs.select("doc_id", (-1 - id_order("doc_id")).alias("rank"), text.alias("text"))
    # ranges of the ring, a few to a partition; every range also gets the first document of the range after it
    ranges = 4 * partitions(spark)
    at = rows.approxQuantile("rank", [i / ranges for i in range(1, ranges)], 0.25 / ranges)
    splits = [-float("inf"), *(sorted(set(at)) or [0.0]), float("inf")]
    number = Bucketizer(splits=splits, inputCol="at", outputCol="number")
    rows = number.transform(rows.withColumn("at", F.col("rank").cast("double"))).withColumn("part", F.col("number").cast("int")).drop("at", "number")
    heads = rows.groupBy("part").agg(F.min("rank").alias("rank")).orderBy("part").collect()  # as many as there are ranges
    if not heads:
        return spark.createDataFrame([], _RESULT)
    closes = [(int(h.rank), int(heads[i - 1].part)) for i, h in enumerate(heads)]
    closes = spark.createDataFrame(closes, "rank long, closed int")
    guests = rows.join(F.broadcast(closes), "rank").groupBy("closed", "rank").agg(F.min("text").alias("text"))
    guests = guests.select(F.lit(None).cast("long").alias("doc_id"), "rank", "text", F.col("closed").alias("part"), F.lit(True).alias("guest"))
    both = rows.withColumn("guest", F.lit(False)).unionByName(guests)
    dealt = both.repartition(partitions(spark), "part").sortWithinPartitions("part", "guest", "rank", "text")
    return dealt.mapInArrow(partial(_prints, k=k, window=window), _RESULT)
