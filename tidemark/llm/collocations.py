"""Collocations from a weighted de Bruijn graph of words.

Only the longest grams are counted from text: a gram of ``longest`` words is an
edge between the two nodes (grams one word shorter) that overlap in it.  Every
word of a piece starts exactly one gram, cut short where the piece ends.  All
shorter counts follow from the graph: a node's count is the flow over the edges
that leave it plus the pieces that end there.  Paths whose inner nodes have one
way in and one way out, and no piece that starts or ends in them, are compacted
into one row of words with one weight, and everything about their inner nodes
is read off that row.

A gram that occurs fewer than ``least`` times is in no phrase that counts, so
grams are cut short before they hold one as a node or less: to the flow through
frequent nodes that is a piece that ends there.  Level by level up to the nodes,
a table of 2**24 bits over the hashes of frequent grams (2 MB, whatever the
input) tells them; a gram that shares a bit with a frequent one stays, and falls
with its counts.  An edge that turns out infrequent once its tasks' counts meet
is cut to its node then, where all that leaves or ends there has met too, so no
table ever holds it.

A null text has no words, a null language is ``und``; documents are judged
whole, and repeated rows and ids count each.  Null ids are no hindrance; other
columns are left out.  A very long text is a block of its own.  An empty table
gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textops
from tidemark.llm.shared import buckets, discard, staged

LONGEST, LEAST, TOP = 3, 10, 2000
#: A phrase goes when a longer one that holds it has at least this many hundredths of its count.
COVERED = 50
#: Bytes of text that a task looks at together.
_BLOCK = 1 << 20
#: Buckets, and grams, with counts that a task gathers over its blocks before they leave it.
_GATHERED, _GRAMS = 2 << 20, 1 << 18
#: Bytes of text for each bucket of nodes.
_BUCKET = 32 << 20
_BITS = 24
#: Parts of a language whose best phrases are found apart before they meet.
_SALTS = 64

#: Bytes that end a piece, and bytes between the words of one.
_ENDS = np.zeros(256, dtype=bool)
_ENDS[[*b".,;:!?", *range(0x0A, 0x0E)]] = True
_BLANK = np.zeros(256, dtype=bool)
_BLANK[[0x20, 0x09]] = True


class _Words:
    """The words of a block: their bytes joined by single blanks, their hashes, their languages, and where pieces end."""

    def __init__(self, data: np.ndarray, at: np.ndarray, lang: np.ndarray):
        data = textops.ascii_lower(data)
        ends = _ENDS[data]
        inside = ~(ends | _BLANK[data])
        padded = np.zeros(len(data) + 2, dtype=bool)
        padded[1:-1] = inside
        begins, stops = inside & ~padded[:-2], inside & ~padded[2:]
        cut = at[(at > 0) & (at < len(data))]
        begins[cut] = inside[cut]
        stops[cut - 1] = inside[cut - 1]
        start, stop = np.flatnonzero(begins), np.flatnonzero(stops) + 1
        size = stop - start
        self.n = len(start)
        row = np.searchsorted(at, start, "right") - 1
        self.lang = lang[row] if self.n else np.zeros(0, np.int64)
        piece = np.concatenate([[0], np.cumsum(ends)])[start]
        self.joined = np.ones(max(0, self.n - 1), dtype=bool)  # whether the word after stands in the same piece
        if self.n:
            self.joined &= (piece[1:] == piece[:-1]) & (row[1:] == row[:-1])
        self.start = np.concatenate([[0], np.cumsum(size + 1)])[:-1]
        self.stop = self.start + size
        self.data = np.full(int(size.sum()) + self.n, 0x20, np.uint8)
        self.data[np.arange(int(size.sum())) + np.repeat(np.arange(self.n), size)] = data[inside]
        self.hash = textops.span_hash(textops.prefix_hash(self.data), self.start, self.stop)

    def numbers(self) -> np.ndarray:
        """Every word's number among the block's distinct words, from 1; equal hashes are held against bytes."""
        _, example, number = np.unique(self.hash, return_index=True, return_inverse=True)
        like = example[number]
        size = self.stop - self.start
        alike = size == size[like]
        # bytes of all words against those of their examples; the shift from one to the other is the same along a word
        held = np.arange(len(self.data), dtype=np.int32 if len(self.data) < 1 << 31 else np.int64)
        shift = np.repeat((self.start[like] - self.start).astype(held.dtype), size + 1)
        odd = self.data != self.data[np.clip(held + shift, 0, len(self.data) - 1)]
        odd[self.stop] = False  # the blank after a word
        alike &= np.add.reduceat(odd, self.start, dtype=np.int64) == 0 if self.n else alike
        number = number.astype(np.int64) + 1
        for i in np.flatnonzero(~alike).tolist():  # two words under one hash
            number[i] = int(number.max()) + 1
        return number


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[_Words, list[str]]]:
    """Words of blocks of rows ``text, lang``, and the names behind their language numbers."""
    held, size = [], 0

    def flush() -> tuple[_Words, list[str]]:
        table = pa.Table.from_batches(held).combine_chunks().to_batches()[0]
        langs = table.column("lang").dictionary_encode()
        data, at = textops.text_bytes(table.column("text"))
        return _Words(data, at, langs.indices.to_numpy(zero_copy_only=False).astype(np.int64)), langs.dictionary.to_pylist()

    for batch in batches:
        for part, data, _ in textops.blocks(batch, "text", _BLOCK):
            if held and size + len(data) > _BLOCK:
                yield flush()
                held, size = [], 0
            held.append(part)
            size += len(data)
    if held:
        yield flush()


def _named(names: list[str]) -> np.ndarray:
    """Hashes of languages."""
    return np.array([textops.span_hash(textops.prefix_hash(b), np.array([0]), np.array([len(b)]))[0] for b in (np.frombuffer(x.encode() + b"|", np.uint8) for x in names)], np.uint64)


def _mixed(words: _Words, names: list[str]) -> np.ndarray:
    """Hashes of words in their languages."""
    return textops.mix(words.hash + _named(names)[words.lang]) if words.n else words.hash


def _grown(words: _Words, names: list[str], tables: list[np.ndarray], most: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """How many words (up to ``most``) a gram from each place may have, where one of ``most`` begins, with its hash, and the hash of the node from each place: the gram of ``most - 1`` words or less.

    A gram of k words may be frequent only if its two parts of k - 1 are, and
    if its own bit is set in the k-th table, where there is one.
    """
    own = _mixed(words, names)
    h, node, ok, ahead = own, own, np.ones(words.n, dtype=bool), np.zeros(words.n, np.int64)
    for k in range(1, most + 1):
        if k > 1:
            ok = ok & np.append(ok[1:], False)
            if k == 2:
                ok &= np.append(words.joined, False)
            h = textops.mix(h * np.uint64(0x9E3779B97F4A7C15) + np.concatenate([own[k - 1 :], np.zeros(min(k - 1, words.n), np.uint64)]))
        if k <= len(tables):
            bit = h & np.uint64((1 << _BITS) - 1)
            ok = ok & ((tables[k - 1][(bit >> np.uint64(6)).astype(np.int64)] >> (bit & np.uint64(63))) & np.uint64(1) == 1)
        ahead[ok] = k
        if 1 < k < most:
            node = np.where(ok, h, node)
    return ahead, ok, h, node


#: Hashed grams are counted in 2**32 buckets, dealt by their upper half; a row carries the lower halves of one block's buckets under one upper half.
_UPPER, _LOWER = 16, 16


def frequent_bits(docs: DataFrame, least: int, tables: list[np.ndarray]) -> np.ndarray:
    """One table more: of bits in which every gram of ``len(tables) + 1`` words that occurs ``least`` times or more in its language has its own set.

    Buckets of hashes are counted, not grams: two bytes and a count for each
    that a block has.  A bucket that several grams share may let infrequent
    ones through, never keep a frequent one out.
    """
    k = len(tables) + 1
    known = docs.sparkSession.sparkContext.broadcast(tables)
    enough = min(least, 255)  # a block's count beyond what is asked for need not be told
    if least > 255:
        raise ValueError("least is at most 255")

    def told(parts: list[tuple[np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        bucket, at = np.unique(np.concatenate([x for x, _ in parts]), return_inverse=True)
        n = np.bincount(at, np.concatenate([c for _, c in parts]), len(bucket))
        upper = (bucket >> np.uint32(_LOWER)).astype(np.int64)
        cuts = np.flatnonzero(np.append(True, upper[1:] != upper[:-1])) if len(bucket) else np.zeros(0, np.int64)
        at = np.append(cuts, len(bucket)).astype(np.int32)
        lower, small = (bucket & np.uint32((1 << _LOWER) - 1)).astype("<u2"), np.minimum(n, enough).astype(np.uint8)
        places = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(at * np.int32(2)), pa.py_buffer(lower)])
        counts = pa.Array.from_buffers(pa.binary(), len(cuts), [None, pa.py_buffer(at), pa.py_buffer(small)])
        return pa.RecordBatch.from_arrays([pa.array(upper[cuts], pa.int32()), places, counts], ["upper", "places", "counts"])

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for words, names in _blocks(batches):
            _, ok, h, _ = _grown(words, names, known.value, k)
            bucket, n = np.unique((h[ok] & np.uint64(0xFFFFFFFF)).astype(np.uint32), return_counts=True)
            parts.append((bucket, np.minimum(n, enough).astype(np.uint8)))
            size += len(bucket)
            if size > _GATHERED:
                yield told(parts)
                parts, size = [], 0
        if parts:
            yield told(parts)

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums a sorted partition, one upper half after the other, in an array of 2**16 counts."""
        now, held, found, size = -1, np.zeros(1 << _LOWER, np.int64), [], 0

        def flush() -> pa.RecordBatch:
            bit = np.concatenate(found) & np.uint64((1 << _BITS) - 1)
            word, at = np.unique(bit >> np.uint64(6), return_inverse=True)
            bits = np.zeros(len(word), np.uint64)
            np.bitwise_or.at(bits, at, np.uint64(1) << (bit & np.uint64(63)))
            return pa.RecordBatch.from_arrays([pa.array(word.astype(np.int64)), pa.array(bits.view(np.int64))], ["word", "bits"])

        for batch in batches:
            for upper, places, counts in zip(batch.column("upper").to_pylist(), batch.column("places"), batch.column("counts"), strict=True):
                if upper != now:
                    if now >= 0:
                        found.append((np.uint64(now) << np.uint64(_LOWER)) | np.flatnonzero(held >= least).astype(np.uint64))
                        size += len(found[-1])
                        held[:] = 0
                    now = upper
                # a row's places are distinct
                held[np.frombuffer(places.as_buffer(), "<u2")] += np.frombuffer(counts.as_buffer(), np.uint8)
            if size > 1 << 18:
                yield flush()
                found, size = [], 0
        if now >= 0:
            found.append((np.uint64(now) << np.uint64(_LOWER)) | np.flatnonzero(held >= least).astype(np.uint64))
            yield flush()

    parts = docs.mapInArrow(count, "upper int, places binary, counts binary").repartition("upper").sortWithinPartitions("upper")
    words = parts.mapInArrow(total, "word long, bits long").groupBy("word").agg(F.bit_or("bits").alias("bits"))
    table = np.zeros(1 << (_BITS - 6), np.int64)
    rows = words.toArrow()  # at most 2**18 rows of two numbers
    table[rows.column("word").to_numpy()] = rows.column("bits").to_numpy()
    known.destroy()
    return table.view(np.uint64)


def _strings(data: np.ndarray, start: np.ndarray, stop: np.ndarray) -> pa.Array:
    """The byte spans [start, stop) as strings."""
    size = stop - start
    at = np.concatenate([[0], np.cumsum(size)])
    where = np.arange(at[-1]) + np.repeat(start - at[:-1], size)
    return pa.LargeStringArray.from_buffers(len(start), pa.py_buffer(at.astype(np.int64)), pa.py_buffer(data[where])).cast(pa.string())


def _packed(rows: pa.Table, bits: int) -> pa.RecordBatch:
    """Grams ``lang, gram, node, c`` by language and bucket of their nodes (the upper ``bits`` of the hash): counts, then the grams node by node, a line each, compressed."""
    langs = rows.column("lang").combine_chunks().dictionary_encode()
    code, node = langs.indices.to_numpy(), rows.column("node").to_numpy()
    order = np.lexsort((node, code))
    code, bucket = code[order], (node[order] >> np.uint64(64 - bits)).astype(np.int64)
    cuts = np.flatnonzero(np.append(True, (code[1:] != code[:-1]) | (bucket[1:] != bucket[:-1])))
    data, at = textops.text_bytes(rows.column("gram").combine_chunks().take(pa.array(order)))
    lines, counts = np.insert(data, at[1:], 0x0A).tobytes(), rows.column("c").to_numpy()[order].astype("<i8")
    raw = [counts[i:j].tobytes() + lines[at[i] + i : at[j] + j] for i, j in zip(cuts, [*cuts[1:], len(code)], strict=True)]
    n, size = np.diff([*cuts, len(code)]), [len(x) for x in raw]
    packed = [pa.compress(x, codec="zstd", asbytes=True) for x in raw]
    return pa.RecordBatch.from_arrays(
        [langs.dictionary.take(pa.array(code[cuts])), pa.array(bucket[cuts], pa.int32()), pa.array(n, pa.int32()), pa.array(size, pa.int32()), pa.array(packed, pa.binary())], ["lang", "bucket", "n", "size", "packed"]
    )


def _unpacked(n: int, size: int, packed: bytes) -> pa.Table:
    """Grams ``gram, c`` of one row of ``_packed``."""
    raw = np.frombuffer(pa.decompress(packed, decompressed_size=size, codec="zstd"), np.uint8)
    counts, lines = raw[: 8 * n].view("<i8"), raw[8 * n :]
    ends = lines == 0x0A  # no word holds one
    at = np.append(0, np.flatnonzero(ends) - np.arange(n))
    return pa.table({"gram": pa.LargeStringArray.from_buffers(n, pa.py_buffer(at), pa.py_buffer(lines[~ends])), "c": pa.array(counts)})


def _summed(parts: list[pa.Table]) -> pa.Table:
    """The counts ``c`` of equal rows in one."""
    keys = [x for x in parts[0].column_names if x != "c"]
    rows = pa.concat_tables(parts).group_by(keys, use_threads=False).aggregate([("c", "sum")])
    return rows.select([*keys, "c_sum"]).rename_columns([*keys, "c"])


def packed_grams(docs: DataFrame, longest: int, known, bits: int) -> DataFrame:
    """``lang, bucket, n, size, packed``: what tasks have counted of the longest grams, for 2**bits buckets of nodes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for words, names in _blocks(batches):
            total = np.bincount(words.lang, minlength=len(names))
            parts.append(_rows(np.arange(len(names)), names, pa.array([""] * len(names), pa.string()), _named(names), total))
            ahead, _, _, node = _grown(words, names, known.value, longest)
            pick = np.flatnonzero(ahead)
            if not len(pick):
                continue
            number = words.numbers()
            base = int(number.max()) + 1
            key = (words.lang * base + number)[pick]
            for k in range(1, longest):
                # keys stay exact: they are numbered anew where the next might not fit
                if int(key.max()) >= (1 << 62) // base:
                    key = np.unique(key, return_inverse=True)[1].astype(np.int64)
                key = key * base + np.where(ahead[pick] > k, number[np.minimum(pick + k, words.n - 1)], 0)
            _, example, count = np.unique(key, return_index=True, return_counts=True)
            at = pick[example]
            parts.append(_rows(words.lang[at], names, _strings(words.data, words.start[at], words.stop[at + ahead[at] - 1]), node[at], count))
            size += parts[-1].num_rows
            if size > 2 * _GRAMS:
                parts = [_summed(parts)]
                size = parts[0].num_rows
                if size > _GRAMS:
                    yield _packed(parts.pop(), bits)
                    size = 0
        if parts:
            yield _packed(_summed(parts), bits)

    return docs.mapInArrow(run, "lang string, bucket int, n int, size int, packed binary")


def longest_grams(docs: DataFrame, longest: int, tables: list[np.ndarray], least: int = LEAST) -> DataFrame:
    """``lang, gram, k, c``, a row a gram: grams of ``longest`` words that occur ``least`` times or more, shorter ones where a piece ends or is cut, with their counts; and with ``k = 0`` all words of a language.

    Edges meet in the bucket of the node that they leave, with the pieces that
    end there: infrequent ones are cut to it as soon as they are counted.
    """
    known = docs.sparkSession.sparkContext.broadcast(tables)
    bits = buckets(docs, "text", _BUCKET).bit_length() - 1

    def whole(lang: str, parts: list[pa.Table]) -> Iterator[pa.RecordBatch]:
        rows = _summed(parts)
        words = pc.add(pc.count_substring(rows.column("gram"), " "), 1)
        few = pc.and_(pc.equal(words, longest), pc.less(rows.column("c"), least))
        cut = rows.filter(few)
        node = pc.list_element(pc.split_pattern(cut.column("gram"), " ", max_splits=1, reverse=True), 0)
        rows = _summed([rows.filter(pc.invert(few)), cut.set_column(0, "gram", node)])
        for batch in rows.to_batches(max_chunksize=1 << 16):
            gram = batch.column("gram")
            k = pc.if_else(pc.equal(gram, ""), 0, pc.add(pc.count_substring(gram, " "), 1))
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), gram.cast(pa.string()), k.cast(pa.int32()), batch.column("c")], ["lang", "gram", "k", "c"])

    def total(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Sums a sorted partition, one bucket after the other."""
        now, parts, size = None, [], 0
        for batch in batches:
            for lang, bucket, *row in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                if (lang, bucket) != now:
                    if parts:
                        yield from whole(now[0], parts)
                    now, parts, size = (lang, bucket), [], 0
                parts.append(_unpacked(*row))
                size += parts[-1].num_rows
                if size > 4 * _GRAMS:
                    parts, size = [_summed(parts)], 0
        if parts:
            yield from whole(now[0], parts)

    met = packed_grams(docs, longest, known, bits).repartition("lang", "bucket").sortWithinPartitions("lang", "bucket")
    out = met.mapInArrow(total, "lang string, gram string, k int, c long")
    out._known = known  # for who is done with it
    return out


def _rows(lang: np.ndarray, names: list[str], grams: pa.Array, node: np.ndarray, count: np.ndarray) -> pa.Table:
    langs = pa.DictionaryArray.from_arrays(pa.array(lang, pa.int32()), pa.array(names, pa.string())).cast(pa.string())
    return pa.table({"lang": langs, "gram": grams, "node": pa.array(node, pa.uint64()), "c": pa.array(count, pa.int64())})


def _head(k: int, phrase: str = "gram") -> Column:
    """The first ``k`` words of a phrase."""
    return F.substring_index(phrase, " ", k)


def _tail(k: int, phrase: str = "gram") -> Column:
    return F.substring_index(phrase, " ", -k)


def node_flow(edges: DataFrame, longest: int) -> dict[int, DataFrame]:
    """Counts ``lang, gram, f`` by number of words: of the edges themselves, and level by level of the nodes, from the flow that leaves them and the pieces that end in them."""
    level = {longest: edges.where(F.col("k") == longest).select("lang", "gram", F.col("c").alias("f"))}
    for k in range(longest - 1, 0, -1):
        leaving = level[k + 1].select("lang", _head(k).alias("gram"), "f")
        ending = edges.where(F.col("k") == k).select("lang", "gram", F.col("c").alias("f"))
        level[k] = staged(leaving.unionByName(ending).groupBy("lang", "gram").agg(F.sum("f").alias("f")), f"flow{k}")
    return level


def compacted(edges: DataFrame, nodes: DataFrame, longest: int) -> DataFrame:
    """Unary paths ``lang, words, f, f_head, f_tail``: their words, the weight of all their edges, the counts of their first and last node.

    An inner node has the same count as the edge before and the edge after it:
    then nothing else enters or leaves it, and no piece starts or ends there.
    Paths are found by pointer doubling over such edges alone; they are never
    longer than a piece, and never circles, as an occurrence has to begin somewhere.
    """
    at = lambda gram, name: nodes.select("lang", F.col("gram").alias(gram), F.col("f").alias(name)).hint("merge")
    rows = edges.select("lang", "gram", "f", _head(longest - 1).alias("head"), _tail(longest - 1).alias("tail"))
    rows = staged(rows.join(at("head", "f_head"), ["lang", "head"]).join(at("tail", "f_tail"), ["lang", "tail"]), "core")
    before = rows.where("f = f_tail").select("lang", F.col("tail").alias("node"), F.col("gram").alias("first"))
    after = rows.where("f = f_head").select("lang", F.col("head").alias("node"), "gram")
    links = staged(before.join(after.hint("merge"), ["lang", "node"]).select("lang", "gram", "first"), "links")  # every edge has one before it at most
    heads = links.select("lang", F.col("first").alias("gram")).join(links.select("lang", "gram"), ["lang", "gram"], "left_anti")
    place = staged(links.select("lang", "gram", "first", F.lit(1).alias("steps"), F.lit(False).alias("done")).unionByName(heads.select("lang", "gram", F.col("gram").alias("first"), F.lit(0).alias("steps"), F.lit(True).alias("done"))), "place")
    while place.where("NOT done").limit(1).count():
        jump = place.select("lang", F.col("gram").alias("first"), F.col("first").alias("_first"), F.col("steps").alias("_steps"), F.col("done").alias("_done"))
        moved = place.join(jump.hint("merge"), ["lang", "first"]).select("lang", "gram", F.col("_first").alias("first"), (F.col("steps") + F.col("_steps")).alias("steps"), F.col("_done").alias("done"))
        last, place = place, staged(moved, "place")
        discard(last)
    linked = place.join(rows.hint("merge"), ["lang", "gram"]).groupBy("lang", F.col("first").alias("gram")).agg(
        F.array_sort(F.collect_list(F.struct("steps", _tail(1).alias("word")))).alias("path"), F.max("f").alias("f"), F.min_by("f_head", "steps").alias("f_head"), F.max_by("f_tail", "steps").alias("f_tail")
    )
    linked = linked.select("lang", F.concat(F.split(_head(longest - 1), " "), F.col("path.word")).alias("words"), "f", "f_head", "f_tail")
    alone = rows.join(place.select("lang", "gram"), ["lang", "gram"], "left_anti").select("lang", F.split("gram", " ").alias("words"), "f", "f_head", "f_tail")
    return linked.unionByName(alone)


def _windows(paths: DataFrame, width: int) -> DataFrame:
    """Every phrase of ``width`` words along the paths: ``lang, gram, f, f_head, f_tail, i, last``."""
    last = F.size("words") - width
    rows = paths.select("lang", "words", "f", "f_head", "f_tail", F.explode(F.sequence(F.lit(0), last)).alias("i"), last.alias("last"))
    return rows.select("lang", F.array_join(F.slice("words", F.col("i") + 1, width), " ").alias("gram"), "f", "f_head", "f_tail", "i", "last")


def _scored(rows: DataFrame, k: int, level: dict[int, DataFrame], known: dict[tuple[str, int], str]) -> DataFrame:
    """The lowest-scoring cut of every phrase ``lang, gram, f`` of ``k`` words; ``known`` names columns that already hold a part's count."""
    have = dict(known)
    for j in range(1, k):
        for side, n, part in (("l", j, _head(j)), ("r", k - j, _tail(k - j))):
            if (side, j) in have:
                continue
            name = f"_{side}{j}"
            counts = level[n].select("lang", F.col("gram").alias("_part"), F.col("f").alias(name)).hint("merge")
            rows = rows.withColumn("_part", part).join(counts, ["lang", "_part"]).drop("_part")
            have[side, j] = name
    cuts = []
    for j in range(1, k):
        l, r = have["l", j], have["r", j]
        score = f"CAST((CAST(1000000 AS DECIMAL(7,0)) * (CAST(f AS DECIMAL(14,0)) * CAST(f AS DECIMAL(14,0)))) DIV (CAST({l} AS DECIMAL(14,0)) * CAST({r} AS DECIMAL(14,0))) AS BIGINT)"
        cuts.append(F.struct(F.expr(score).alias("score"), F.lit(j).alias("cut"), F.col(l).alias("l"), F.col(r).alias("r")))
    best = F.least(*cuts) if len(cuts) > 1 else cuts[0]
    return rows.select("lang", F.col("gram").alias("phrase"), F.col("f").alias("a"), best.alias("b")).select("lang", "phrase", "a", "b.l", "b.r", "b.score")


def _uncovered(rows: DataFrame, longer: DataFrame, covered: int) -> DataFrame:
    """Phrases of which no longer one ``lang, gram, f`` that holds them has ``covered`` hundredths of their count."""
    most = longer.groupBy("lang", "gram").agg(F.max("f").alias("_most"))
    return rows.join(most.hint("merge"), ["lang", "gram"], "left").where(F.col("_most").isNull() | (100 * F.col("_most") < covered * F.col("f"))).drop("_most")


def collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, covered: int = COVERED, top: int = TOP) -> DataFrame:
    """Each language's best phrases of 2 to ``longest`` words: ``lang, rank, phrase, a, l, r, n, score``.

    ``a``, ``l`` and ``r`` count the phrase and the two parts of its
    lowest-scoring cut, ``n`` all words of the language.
    """
    if longest < 2:
        raise ValueError("a phrase has two words at least")
    docs = docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    tables: list[np.ndarray] = []
    for _ in range(1, longest):
        tables.append(frequent_bits(docs, least, tables))
    grams = longest_grams(docs, longest, tables, least)
    edges = staged(grams, "edges")
    grams._known.destroy()
    level = node_flow(edges, longest)
    often = {k: rows.where(F.col("f") >= least) for k, rows in level.items()}
    paths = staged(compacted(often[longest], often[longest - 1], longest), "paths")
    steps = _windows(paths, longest)
    # what a path knows of the parts of its phrases: inner nodes count what its edges count
    steps = steps.select("lang", "gram", "f", F.when(F.col("i") == 0, F.col("f_head")).otherwise(F.col("f")).alias("_head"), F.when(F.col("i") == F.col("last"), F.col("f_tail")).otherwise(F.col("f")).alias("_tail"))
    parts = [_scored(steps, longest, often, {("l", longest - 1): "_head", ("r", 1): "_tail"})]
    for k in range(longest - 1, 1, -1):
        if k == longest - 1:
            longer = _windows(paths, k).select("lang", "gram", "f")
        else:
            longer = often[k + 1].select("lang", _head(k).alias("gram"), "f").unionByName(often[k + 1].select("lang", _tail(k).alias("gram"), "f"))
        parts.append(_scored(_uncovered(often[k], longer, covered), k, often, {}))
    rows = parts[0]
    for more in parts[1:]:
        rows = rows.unionByName(more)
    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # the best of every part of a language first, so that the last step sees at most _SALTS * top rows of one
    rows = rows.withColumn("_salt", F.pmod(F.xxhash64("phrase"), F.lit(_SALTS)))
    rows = rows.withColumn("_r", F.row_number().over(Window.partitionBy("lang", "_salt").orderBy(*order))).where(F.col("_r") <= top)
    rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    total = edges.where("k = 0").select("lang", F.col("c").alias("n"))
    return rows.join(total, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")
