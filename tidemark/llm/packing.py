"""Packing token sequences by first-fit decreasing over a tournament tree.

Documents are tokenised and cut into full sequences and a rest.  Every rest
goes to a random group; a group packs its rests alone, so groups run in
parallel and a group's size is bounded whatever the corpus holds.  The bins of
a group are the leaves of a tournament tree whose inner nodes hold the largest
free capacity below them: the first bin that has room is found by going down
from the root, always left where the left side has room.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm import textops
from tidemark.llm.shared import staged
from tidemark.llm.tokens import WordTokens

_tokens: dict[tuple[str, int], WordTokens] = {}


def _tokenizer(path: str, end_id: int) -> WordTokens:
    """One tokenizer per worker."""
    if (path, end_id) not in _tokens:
        _tokens[path, end_id] = WordTokens(path, end_id)
    return _tokens[path, end_id]


def _pieces(batches: Iterator[pa.RecordBatch], path: str, end_id: int, width: int, with_ids: bool) -> Iterator[pa.RecordBatch]:
    """Documents to pieces of at most ``width`` ids, with check sums."""
    tokens = _tokenizer(path, end_id)
    for batch in batches:
        for part, data, at in textops.blocks(batch, "text"):
            ids, ends = tokens(data, at)
            wide = ids.astype("<u4")
            starts = np.concatenate([[0], ends[:-1]])
            size = ends - starts
            count = -(-size // width)
            row = np.repeat(np.arange(len(size)), count)
            place = (np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)) * width
            length = np.minimum(width, size[row] - place)
            begin = starts[row] + place
            columns = [
                part.column("doc_id").take(pa.array(row)),
                pa.array(place),
                pa.array(length),
                pa.array([zlib.crc32(wide[a : a + n]) for a, n in zip(begin.tolist(), length.tolist(), strict=True)], pa.int64()),
                pa.array(size[row]),
                pa.array([wide[a : a + n].tolist() for a, n in zip(begin.tolist(), length.tolist(), strict=True)] if with_ids else [None] * len(row), pa.list_(pa.int32())),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", "start", "length", "ids_crc32", "doc_tokens", "ids"])


def first_fit_decreasing(sizes: np.ndarray, capacity: int) -> np.ndarray:
    """The bin of every item: largest first, each into the first bin that has room.

    Ties keep their order.  Every size is between 1 and ``capacity``.
    """
    n = len(sizes)
    leaves = 1 << max(0, (n - 1).bit_length())
    free = [capacity] * (2 * leaves)
    bins = np.zeros(n, np.int64)
    for item in np.argsort(-sizes, kind="stable").tolist():
        need = int(sizes[item])
        node = 1
        while node < leaves:
            node *= 2
            if free[node] < need:
                node += 1
        bins[item] = node - leaves
        free[node] -= need
        while node > 1:
            node //= 2
            most = max(free[2 * node], free[2 * node + 1])
            if free[node] == most:
                break
            free[node] = most
    return bins


def _pack(table: pa.Table, capacity: int) -> pa.Table:
    """One group's pieces into sequences; numbers carry the group above 32 bits."""
    size = table.column("length").to_numpy()
    bins = first_fit_decreasing(size, capacity)
    order = np.argsort(bins, kind="stable")
    ends = np.cumsum(size[order])
    begin = ends - size[order]
    head = np.flatnonzero(np.diff(bins[order], prepend=-1))
    base = np.repeat(begin[head], np.diff(np.append(head, len(order))))
    offset = np.empty(len(size), np.int64)
    offset[order] = begin - base
    group = table.column("group").to_numpy()
    return table.drop_columns(["group"]).append_column("sequence_id", pa.array((group.astype(np.int64) << 32) | bins)).append_column("offset", pa.array(offset))


def pack_documents(docs: DataFrame, tokenizer_path: str, end_id: int = 2, width: int = 4096, group_pieces: int = 4096, seed: int = 11, with_ids: bool = False) -> DataFrame:
    """One row per piece: ``doc_id, start, length, ids_crc32, doc_tokens, ids, sequence_id, offset``.

    A document is its text's ids (null text: none) and ``end_id``; ``doc_tokens``
    counts them.  A document of more than ``width`` ids is cut every ``width``
    ids.  ``ids_crc32`` is that of the piece's ids as little-endian unsigned
    32-bit numbers; ``ids`` holds the ids themselves if asked for.  Pieces of
    one ``sequence_id`` lie side by side from ``offset`` 0 without gaps and
    have ``width`` ids together at most.  A consumer pads a sequence to ``width``
    unless its length is a power of two.

    Full pieces and rests alike are dealt to random groups of about
    ``group_pieces`` pieces by a hash of the row's content and place, so that
    repeated rows (or ids, or nulls) spread like any others.  Repeated rows are
    packed once each; a null doc_id is kept.  An empty table gives an empty
    result; other columns are ignored.
    """
    pieces = docs.select("doc_id", "text").mapInArrow(
        partial(_pieces, path=tokenizer_path, end_id=end_id, width=width, with_ids=with_ids),
        "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>",
    )
    pieces = staged(pieces.withColumn("spread", F.xxhash64("doc_id", "start", "ids_crc32", F.monotonically_increasing_id(), F.lit(seed))), "pieces")
    groups = max(1, round(pieces.count() / group_pieces))
    schema = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, ids array<int>, sequence_id long, offset long"
    dealt = pieces.withColumn("group", F.pmod("spread", F.lit(groups))).drop("spread")
    return dealt.groupBy("group").applyInArrow(lambda table: _pack(table, width), schema)
