"""N-gram Jaccard join by vertical partitioning.

The global order of n-grams is the order of their 64-bit hashes, cut into
fragments (hash ranges).  A document's shingle set is dealt out vertically:
each fragment gets only its own segment of every set.  A fragment counts how
many different sets hold each of its n-grams and tells every set which of its
n-grams anyone else has.  A set with fewer than the required share of such
n-grams can have no partner; of the rest only the rarest few n-grams (prefix
filter under the order rarest first) propose pairs.  For each proposed pair the
fragments count partial overlaps separately, and the counts are summed.

Equal sets are one set once their n-grams are counted.  Proposals are made in rounds: each round links every
set of an n-gram's group with the group's most common set and with its neighbour, verified
links merge groups, and what has merged is not compared again.  A last round
proposes the pairs of one group that are still apart and that sizes and places
allow, so no link between different components is missed.  An n-gram with many
rows is dealt into blocks, in every round.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import textops
from tidemark.llm.components import joined
from tidemark.llm.shared import buckets, discard, few, light, partitions, staged

#: Shingles, and sets, that a task gathers at most before it deals them out; a set's number takes 16 bits.
_FLUSH, _SETS = 1 << 20, 1 << 15
#: Rows of one n-gram that are never dealt into blocks.
_LEAST_BLOCK = 1000
#: Bits of a shared n-gram's number inside its fragment; the fragment's number stands above.
_NUMBER = np.uint64(32)
_DEALT = "bucket int, flush long, sizes binary, digests binary, keys binary, owners binary, extra binary"
_NAMES = ["bucket", "flush", "sizes", "digests", "keys", "owners", "extra"]


def _row(bucket: int, flush: int, **parts: np.ndarray) -> list:
    return [bucket, flush, *(parts[k].tobytes() if k in parts else None for k in _NAMES[2:])]


def _batch(rows: list[list]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int64()] + [pa.binary()] * (len(_NAMES) - 2)
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=_NAMES)


def _six(keys: np.ndarray) -> np.ndarray:
    """The low six bytes of sorted keys, byte by byte (the first ones compress well); the fragment holds the high bits."""
    return np.ascontiguousarray(keys.astype("<u8").view(np.uint8).reshape(-1, 8)[:, 5::-1].T)


def _eight(raw: bytes) -> np.ndarray:
    out = np.zeros((len(raw) // 6, 8), np.uint8)
    out[:, 5::-1] = np.frombuffer(raw, np.uint8).reshape(6, -1).T
    return out.view("<u8").ravel()


def _home_of(flush: int) -> int:
    return -1 - int(textops.mix(np.array([flush], np.uint64))[0] >> np.uint64(34))


def _digests(keys: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A 64-bit digest of each set, whatever the order of its n-grams."""
    sums = np.concatenate([[np.uint64(0)], np.cumsum(textops.mix(keys), dtype=np.uint64)])
    end = np.cumsum(size)
    return textops.mix((sums[end] - sums[end - size]) ^ (size.astype(np.uint64) << np.uint64(40)))


_DOCUMENTS = "doc_id long, check long, digest long, n_shingles long"


def _documents(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[pa.RecordBatch]:
    """Every document's set, by digest and size."""
    for batch in batches:
        for part, data, at in textops.blocks(batch, "text"):
            keys, offsets = textops.shingle_sets(data, at, width)
            size = np.diff(offsets)
            yield pa.RecordBatch.from_arrays([part.column("doc_id"), part.column("check"), pa.array(_digests(keys, size).view(np.int64)), pa.array(size.astype(np.int64))], names=["doc_id", "check", "digest", "n_shingles"])


def _deal(batches: Iterator[pa.RecordBatch], n: int, width: int) -> Iterator[pa.RecordBatch]:
    """Sets to segments: a row per fragment and flush, and one that tells the flush's home whose sets these are.

    A flush is some sets of one task in a row; a segment names its owners by
    their number in it, so a shingle takes eight bytes however many fragments
    there are.  Its number is the task's and its own count, the same whenever
    the task runs again.
    """
    shift = np.uint64(64 - n.bit_length() + 1)
    task = TaskContext.get().partitionId() << 32
    held: list[tuple] = []
    gathered = done = 0

    def flush() -> pa.RecordBatch:
        keys = np.concatenate([x[0] for x in held])
        size = np.concatenate([x[1] for x in held])
        digest = _digests(keys, size)
        row = np.repeat(np.arange(len(size)), size)
        sets, once = np.unique(digest, return_index=True)
        number = np.full(len(digest), -1)
        number[once] = np.arange(len(once))
        rows = [_row(_home_of(task + done), task + done, sizes=size[once].astype(np.uint32), digests=sets)]
        keep = number[row] >= 0
        keys, owner = keys[keep], number[row[keep]].astype(np.uint16)
        order = np.argsort(keys)
        keys, owner = keys[order], owner[order]
        fragment = (keys >> shift).astype(np.int64)
        cut = np.flatnonzero(np.diff(fragment)) + 1
        for a, b in zip(np.concatenate([[0], cut]), np.append(cut, len(keys)), strict=True):
            if a < b:
                rows.append(_row(int(fragment[a]), task + done, keys=_six(keys[a:b]), owners=owner[a:b]))
        return _batch(rows)

    for batch in batches:
        for _, data, at in textops.blocks(batch, "text"):
            keys, offsets = textops.shingle_sets(data, at, width)
            size = np.diff(offsets)
            for a in range(0, len(size), _SETS):
                part = size[a : a + _SETS]
                if held and (gathered >= _FLUSH or sum(len(x[1]) for x in held) + len(part) > _SETS):
                    yield flush()
                    held.clear()
                    gathered, done = 0, done + 1
                held.append((keys[offsets[a] : offsets[a + len(part)]], part))
                gathered += int(part.sum())
    if held:
        yield flush()


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, list[dict]]]:
    """Rows of one fragment, or of one flush at its home, together; the rows come sorted."""
    current, rows = None, []
    for batch in batches:
        for row in batch.to_pylist():
            key = row["bucket"] if row["bucket"] >= 0 else (row["bucket"], row["flush"])
            if rows and key != current:
                yield rows[0]["bucket"], rows
                rows = []
            current = key
            rows.append(row)
    if rows:
        yield rows[0]["bucket"], rows


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per fragment: how many sets hold each n-gram; tells the flushes' homes which n-grams of their sets are shared."""
    for bucket, rows in _groups(batches):
        if bucket < 0:
            yield _batch([[r[k] for k in _NAMES] for r in rows])
            continue
        key = np.concatenate([_eight(r["keys"]) for r in rows])
        owner = np.concatenate([np.frombuffer(r["owners"], np.uint16) for r in rows])
        flushes = [r["flush"] for r in rows]
        source = np.repeat(np.arange(len(rows)), [len(r["owners"]) // 2 for r in rows])
        rows.clear()
        order = np.argsort(key, kind="stable")
        key, owner, source = key[order], owner[order], source[order]
        head = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, int)
        many = np.diff(np.append(head, len(key)))
        shared = many >= 2
        number = np.repeat(np.cumsum(shared) - 1, many)
        held = np.repeat(many, many)
        keep = held >= 2
        owner, number, held, source = owner[keep], number[keep], held[keep], source[keep]
        order = np.argsort(source, kind="stable")
        owner, number, held, source = owner[order], number[order], held[order], source[order]
        cut = np.flatnonzero(np.diff(source)) + 1
        out = []
        for a, b in zip(np.concatenate([[0], cut]), np.append(cut, len(source)), strict=True):
            if a < b:
                flush = flushes[source[a]]
                fragment = np.array([bucket], np.uint32)
                out.append(_row(_home_of(flush), flush, sizes=fragment, owners=owner[a:b], keys=number[a:b].astype(np.uint32), extra=held[a:b].astype(np.uint32)))
        if out:
            yield _batch(out)


_HOME = "digest long, size int, common double, grams array<long>"


def _home(batches: Iterator[pa.RecordBatch], percent: int) -> Iterator[pa.RecordBatch]:
    """Per flush: every set that has enough shared n-grams, with these, rarest first."""
    schema = pa.schema([("digest", pa.int64()), ("size", pa.int32()), ("common", pa.float64()), ("grams", pa.list_(pa.int64()))])
    for _, rows in _groups(batches):
        own = next(r for r in rows if r["digests"] is not None)
        told = [r for r in rows if r["digests"] is None]
        if not told:
            continue
        sets, size = np.frombuffer(own["digests"], np.int64), np.frombuffer(own["sizes"], np.uint32).astype(np.int64)
        owner = np.concatenate([np.frombuffer(r["owners"], np.uint16) for r in told]).astype(np.int64)
        gram = np.concatenate([np.frombuffer(r["keys"], np.uint32).astype(np.uint64) | (np.frombuffer(r["sizes"], np.uint32).astype(np.uint64) << _NUMBER) for r in told])
        held = np.concatenate([np.frombuffer(r["extra"], np.uint32) for r in told])
        enough = 100 * np.bincount(owner, minlength=len(sets)) >= percent * size
        keep = enough[owner]
        owner, gram, held = owner[keep], gram[keep], held[keep]
        if not len(owner):
            continue
        order = np.lexsort((gram, held, owner))
        owner, gram, held = owner[order], gram[order], held[order]
        first = np.flatnonzero(np.diff(owner, prepend=-1))
        lists = pa.ListArray.from_arrays(pa.array(np.append(first, len(owner)).astype(np.int32)), pa.array(gram.view(np.int64)))
        who = owner[first]
        common = np.add.reduceat(held.astype(np.float64), first) / size[who]
        yield pa.RecordBatch.from_arrays([pa.array(sets[who]), pa.array(size[who].astype(np.int32)), pa.array(common), lists], schema=schema)


def _verified(pairs: DataFrame, n: int, segments: DataFrame, percent: int) -> DataFrame:
    """Links among a table of ``n`` ``pairs(a, b)``: partial overlaps by fragment, summed per pair; only segments of proposed sets move."""
    of = lambda side: segments.join(light(pairs.select(F.col(side).alias("digest")).distinct(), n), "digest", "left_semi")
    first = of("a").select(F.col("digest").alias("a"), "fragment", F.col("grams").alias("grams_a"), F.col("size").alias("size_a"))
    second = of("b").select(F.col("digest").alias("b"), "fragment", F.col("grams").alias("grams_b"), F.col("size").alias("size_b"))
    part = (
        pairs.join(second, "b")
        .join(first, ["a", "fragment"])
        .select("a", "b", "size_a", "size_b", F.size(F.array_intersect("grams_a", "grams_b")).alias("overlap"))
    )
    summed = part.groupBy("a", "b").agg(F.sum("overlap").alias("overlap"), F.first("size_a").alias("size_a"), F.first("size_b").alias("size_b"))
    return summed.where(f"100 * overlap >= {percent} * (size_a + size_b - overlap)").select(F.col("a").alias("u"), F.col("b").alias("v"))


def jaccard_components(docs: DataFrame, width: int = 5, percent: int = 75, rounds: int = 2, fragments: int = 4) -> DataFrame:
    """One row per document: ``doc_id, n_shingles, component_id``.

    Words are runs of bytes other than space and \\t..\\r, with A-Z lower-cased;
    a set holds the distinct ``width``-word shingles, or the whole sequence of
    a text with fewer words.  Two documents link when
    ``100 * |intersection| >= percent * |union|``; ``component_id`` is the
    smallest doc_id reachable by links.

    A null or empty text, or one of white space only, has an empty set and
    links with nothing.  Repeated rows are kept, one result row each, and link
    like any equal texts.  A null doc_id keeps its row; it is ignored as a
    smallest id unless a component has no other (then component_id is null).
    An empty table gives an empty result.  Columns other than doc_id and text
    are ignored.
    """
    return jaccard_groups(docs, width, percent, rounds, fragments).select("doc_id", "n_shingles", "component_id")


def _segment(f: int, fragments: int, n: int) -> Column:
    """Part ``f`` of a set's ``grams`` under their global order."""
    return F.struct(F.lit(f).alias("fragment"), F.filter("grams", lambda g: F.floor(F.shiftright(g, 32) * fragments / n) == f).alias("grams"))


def _dealt(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows of one n-gram in one block, of a hot one in ``blocks`` of them, by set."""
    salt = F.pmod(F.xxhash64("digest"), F.coalesce("blocks", F.lit(1)))
    return rows.join(F.broadcast(hot.select("gram", "blocks")), "gram", "left").withColumn("block", salt.cast("int"))


def jaccard_groups(docs: DataFrame, width: int = 5, percent: int = 75, rounds: int = 2, fragments: int = 4) -> DataFrame:
    """The rows of :func:`jaccard_components` with two columns more: ``check``, the xxhash64 of the text (null: empty), and ``root``, the component whatever ids it has (null for an empty set)."""
    n = buckets(docs, "text")
    spread = partitions(docs.sparkSession)
    # a fragment or a flush lies in one partition, and a task that takes several goes from one to the next
    tasks = max(n, docs.sparkSession.sparkContext.defaultParallelism)
    texts = docs.select("doc_id", "text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("check"))
    documents = staged(texts.mapInArrow(partial(_documents, width=width), _DOCUMENTS), "documents")
    dealt = docs.select("text").mapInArrow(partial(_deal, n=n, width=width), _DEALT)
    dealt = dealt.repartition(spread, "bucket").sortWithinPartitions("bucket", "flush").coalesce(tasks)
    told = dealt.mapInArrow(_count, _DEALT)
    told = told.repartition(spread, "bucket").sortWithinPartitions("bucket", "flush").coalesce(tasks)
    # equal sets of several flushes are one from here on
    sets = told.mapInArrow(partial(_home, percent=percent), _HOME).groupBy("digest").agg(*(F.first(c).alias(c) for c in ("size", "common", "grams")))
    sets = staged(sets.coalesce(tasks), "sets")

    # The rarest grams propose: what a partner must share at least once, less the grams that nobody shares.
    # left: how many shared grams a set has from this one on; no overlap that begins here can be larger.
    proposing = F.greatest(F.lit(0), F.size("grams") - F.ceil(F.col("size") * percent / F.lit(100.0)).cast("int") + 1)
    prefix = sets.select("digest", "size", "common", F.size("grams").alias("shared"), F.posexplode(F.slice("grams", F.lit(1), proposing)).alias("rank", "gram"))
    prefix = staged(prefix.select("digest", "size", "common", "gram", (F.col("shared") - F.col("rank")).alias("left")), "prefixes")
    # segments: a set's n-grams cut by the global order, without moving any
    cut = F.explode(F.array(*(_segment(f, fragments, n) for f in range(fragments)))).alias("s")
    segments = staged(sets.select("digest", "size", cut).select("digest", "size", "s.*").where(F.size("grams") > 0), "segments")
    discard(sets)
    # n-grams with more rows than a block should hold: as many as there are blocks at most, so they may be sent everywhere
    held = prefix.count()
    most = max(_LEAST_BLOCK, held // (4 * spread))
    hot = prefix.groupBy("gram").agg(F.count("*").alias("c")).where(F.col("c") > most).select("gram", F.ceil(F.col("c") / most).cast("int").alias("blocks"))
    hot = staged(few(hot, held), "hot")

    roots = None
    for k in range(rounds + 1):
        rows = prefix.withColumn("root", F.col("digest"))
        if roots is not None:
            # what has merged under an n-gram stays merged, so its rows are done
            known = light(roots.select(F.col("node").alias("digest"), "root"), roots.count())
            rows = prefix.select("digest", "size", "common", "gram", "left").join(known, "digest", "left").withColumn("root", F.coalesce("root", "digest"))
            apart = staged(few(rows.groupBy("gram").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("gram"), held), "apart")
            open_ = apart.count()
            if not open_:  # no n-gram is left in two components: no link is missing
                discard(apart)
                break
            rows = staged(few(rows.join(light(apart, open_), "gram", "left_semi"), held), "rows")
            discard(prefix, apart)
            prefix = rows
        # the set with the most common grams is the likely hub of its group; later rounds try others
        hub = F.col("common") if k == 0 else F.xxhash64("digest", F.lit(k)).cast("double")
        rows = rows.select("gram", "digest", F.struct(hub.alias("order"), "digest", "size", "left", "root").alias("me"))
        if k < rounds:
            order = Window.partitionBy("gram", "block").orderBy(F.desc("me"))
            near = _dealt(rows, hot).select("gram", "me", F.first("me").over(order).alias("head"), F.lag("me").over(order).alias("before"))
            heads = rows.join(F.broadcast(hot), "gram", "left_semi").groupBy("gram").agg(F.max("me").alias("hub"))
            near = near.join(F.broadcast(heads), "gram", "left")
            pairs = near.select("me", F.explode(F.array_distinct(F.array("head", "before", "hub"))).alias("other")).where("other IS NOT NULL")
            bound = 3 * held
        else:
            pairs = _all_pairs(rows, hot, held, percent)
            bound = 10 * held  # sizes and places leave few pairs of a row
        pairs = (
            pairs.where("me.root <> other.root").where(_may_link("me", "other", percent))
            .select(F.least("me.digest", "other.digest").alias("a"), F.greatest("me.digest", "other.digest").alias("b"))
            .distinct()
        )
        pairs = staged(few(pairs, bound), "pairs")
        proposed = pairs.count()
        if roots is not None and not proposed:
            discard(pairs)
            continue
        found = staged(few(_verified(pairs, proposed, segments, percent), proposed), "links")
        discard(pairs)
        if roots is not None and found.isEmpty():
            discard(found)
            continue
        before, roots = roots, joined(roots, found)
        discard(before, found)
    discard(prefix, segments, hot)

    # a component's smallest id: by set first, then by component, then back; each step's input is a table, so that a skewed key's rows may be split
    every = documents.count()
    own = documents.where("n_shingles > 0").groupBy("digest").agg(F.min("doc_id").alias("first"))
    own = staged(few(own.join(roots.select(F.col("node").alias("digest"), "root"), "digest", "left"), every), "own")
    low = staged(few(own.where("root IS NOT NULL").groupBy("root").agg(F.min("first").alias("least")), every), "least")
    named = staged(few(own.join(low, "root", "left").select("digest", F.coalesce("root", "digest").alias("root"), F.when(F.col("root").isNull(), F.col("first")).otherwise(F.col("least")).alias("component_id")), every), "components")
    discard(roots, own, low)
    return documents.join(named, "digest", "left").select("doc_id", "check", "n_shingles", F.when(F.col("n_shingles") > 0, F.col("root")).alias("root"), F.when(F.col("n_shingles") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))


def _may_link(a: str, b: str, percent: int) -> str:
    """Whether sizes and the n-grams left from the shared one on allow a link."""
    return f"{100 + percent} * least({a}.left, {b}.left) >= {percent} * ({a}.size + {b}.size) AND 100 * least({a}.size, {b}.size) >= {percent} * greatest({a}.size, {b}.size)"


def _all_pairs(rows: DataFrame, hot: DataFrame, held: int, percent: int) -> DataFrame:
    """Pairs of different components of one n-gram that sizes and places allow, but for those inside its most common component.

    Partners differ in size by less than a band, so only sets of the same band
    or the next meet; a hot n-gram's rows meet in blocks.
    """
    band = F.floor(F.log("me.size") / math.log(100 / percent) + 1e-9).cast("int")
    most = rows.groupBy("gram", "me.root").agg(F.count("*").alias("c")).groupBy("gram").agg(F.max_by("root", F.struct("c", "root")).alias("most"), F.count("*").alias("roots"))
    apart = staged(few(most.where("roots > 1").select("gram", "most"), held), "apart")
    rows = rows.join(apart, "gram").withColumn("band", band)
    rest = _dealt(rows.where("me.root <> most"), hot).select("gram", "block", "me", F.explode(F.array(*(F.col("band") + i for i in (-1, 0, 1)))).alias("band"))
    wide = rows.join(F.broadcast(hot), "gram", "left").select("gram", "band", F.col("me").alias("other"), F.explode(F.sequence(F.lit(0), F.coalesce("blocks", F.lit(1)) - 1)).alias("block"))
    return rest.join(wide, ["gram", "band", "block"]).where("me.root <> other.root")
