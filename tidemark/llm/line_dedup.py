"""Line-level deduplication that answers with bitmaps, by DataFrame functions alone.

Every line's key (bare of white space, lower-cased) is hashed to 128 bits.  The
hashes are dealt by range and sorted by hash, document and position, so that a
key's first occurrence streams by before all others.  A key that holds more
than one in ``SHARE`` of all lines is cut into slices of documents: each slice
streams its own first occurrence, and the least of at most ``SLICES`` of them
is the key's.  What a document loses comes back as a compressed bitmap of the
lines it keeps; no text is moved until someone applies one.

Rows that repeat a ``doc_id`` are one document to this operator: a line goes
where a smaller ``doc_id`` holds its key, in every row alike; a null id is
smaller than all others.  A null text is an empty one, and that is one empty
line.  Very long texts are rows like any other.  An empty table gives an empty
result.  Other columns pass through in ``row``, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm.shared import id_order, staged

#: White space that a key is stripped of.
SPACE = " \t\n\x0b\x0c\r"
_UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
#: Keys of fewer code points are never dropped.
LEAST_CHARS = 10
#: A key with more than one in ``SHARE`` of all lines is dealt into ``SLICES`` slices; the sketch that finds them tracks ``_TRACKED`` keys.
SHARE, SLICES, _TRACKED = 1024, 64, 1 << 13


def line_key(line: Column) -> Column:
    """A line stripped of ASCII white space at both ends, A-Z lower-cased."""
    bare = F.trim(line, F.lit(SPACE))
    # lower() changes A-Z alone where all characters are ASCII, and is much faster than translate()
    return F.when(F.octet_length(bare) == F.length(bare), F.lower(bare)).otherwise(F.translate(bare, _UPPER, _UPPER.lower()))


def hashed_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``doc, body, pos, h1, h2``: every line whose key is long enough, with the order of its document, the hash of the text, and its place from 0."""
    own = docs.select(id_order("doc_id").alias("doc"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("body"), F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    keys = own.select("doc", "body", "pos", line_key(F.col("line")).alias("key")).where(F.length("key") >= least)
    return keys.select("doc", "body", "pos", F.xxhash64("key").alias("h1"), F.xxhash64(F.lit(1), "key").alias("h2"))


def _frequent(lines: DataFrame) -> DataFrame:
    """First hashes of keys with more than one in ``SHARE`` of all lines, by a mergeable sketch: fewer than ``SHARE`` rows, whatever the input."""
    top = lines.agg(F.expr(f"approx_top_k(h1, {SHARE}, {_TRACKED})").alias("top"), F.count("*").alias("n"))
    return top.select("n", F.explode("top").alias("t")).where(F.col("t.count") * SHARE > F.col("n")).select(F.col("t.item").alias("h1"), F.lit(1).alias("hot"))


def later_lines(lines: DataFrame) -> DataFrame:
    """``doc, body, pos`` of the lines whose key a smaller document holds."""
    hot = F.when(F.col("hot") == 1, F.pmod(F.xxhash64("doc", "body"), F.lit(SLICES)) + 1).otherwise(0).cast("int")
    cut = lines.join(F.broadcast(_frequent(lines)), "h1", "left").select("doc", "body", "pos", "h1", "h2", hot.alias("slice"))
    # the range partitioning serves the window: rows are dealt once, and sorted by document and position inside
    run = Window.partitionBy("h1", "h2", "slice").orderBy("doc", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    seen = cut.repartitionByRange("h1", "h2", "slice").withColumn("first", F.first("doc").over(run))
    later = staged(seen.where("slice > 0 OR doc > first"), "later")
    least = later.where("slice > 0").groupBy("h1", "h2").agg(F.min("first").alias("least"))  # one row per key that was cut
    return later.join(F.broadcast(least), ["h1", "h2"], "left").where(F.col("doc") > F.coalesce("least", "first")).select("doc", "body", "pos")


def bitmaps(gone: DataFrame) -> DataFrame:
    """Compressed bitmaps of the lines that documents keep: ``doc, body, n_dropped, keep``, a row per document that loses any.

    ``keep`` is a list of runs ``(gap, run, bits)``: after ``gap`` words of 64
    lines that stay whole come ``run`` words that all read ``bits``, the lowest
    bit first; beyond the last run everything stays.
    """
    bit = F.expr("shiftleft(1L, CAST(pos % 64 AS INT))")
    words = gone.groupBy("doc", "body", F.shiftright("pos", 6).alias("word")).agg(F.bit_or(bit).alias("gone"))
    w = Window.partitionBy("doc", "body").orderBy("word")
    goes_on = (F.lag("word").over(w) == F.col("word") - 1) & (F.lag("gone").over(w) == F.col("gone"))
    runs = words.withColumn("fresh", F.when(goes_on, 0).otherwise(1)).withColumn("island", F.sum("fresh").over(w))
    runs = runs.groupBy("doc", "body", "island").agg(F.min("word").alias("start"), F.count("*").cast("int").alias("run"), F.first("gone").alias("gone"))
    lists = runs.groupBy("doc", "body").agg(F.sum(F.bit_count("gone") * F.col("run")).cast("long").alias("n_dropped"), F.array_sort(F.collect_list(F.struct("start", "run", "gone"))).alias("runs"))
    before = "CASE WHEN i = 0 THEN 0 ELSE element_at(runs, i).start + element_at(runs, i).run END"
    return lists.select("doc", "body", "n_dropped", F.expr(f"transform(runs, (r, i) -> named_struct('gap', r.start - {before}, 'run', r.run, 'bits', ~r.gone))").alias("keep"))


def kept_text(text: str, keep: str) -> Column:
    """The text of the lines that a bitmap keeps, joined by line feeds; all of it for a null bitmap."""
    words = f"flatten(transform({keep}, r -> concat(array_repeat(-1L, r.gap), array_repeat(r.bits, r.run))))"
    stays = "shiftright(coalesce(get(dense, shiftright(i, 6)), -1L), i & 63) & 1L = 1L"
    # a list of one makes the words a variable, so that they are unpacked once a text and not once a line
    kept = f"transform(array({words}), dense -> array_join(filter(split({text}, '\\n'), (l, i) -> {stays}), '\\n'))[0]"
    return F.expr(f"CASE WHEN {keep} IS NULL THEN coalesce({text}, '') ELSE {kept} END")


def dedup_lines(docs: DataFrame, least: int = LEAST_CHARS) -> DataFrame:
    """``row, n_lines, n_dropped, keep`` for every row of ``docs``: the row itself, its lines, how many go, and the bitmap of those that stay (null: all)."""
    maps = staged(bitmaps(later_lines(staged(hashed_lines(docs, least), "lines"))), "bitmaps")
    text = F.coalesce("text", F.lit(""))
    n = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    rows = docs.select(F.struct(*docs.columns).alias("row"), n.cast("long").alias("n_lines"), id_order("doc_id").alias("doc"), F.xxhash64(text).alias("body"))
    # bitmaps are the small side and unique by key, so texts are hashed to them and never sorted
    both = rows.join(maps.hint("shuffle_hash"), ["doc", "body"], "left")
    return both.select("row", "n_lines", F.coalesce("n_dropped", F.lit(0)).cast("long").alias("n_dropped"), "keep")
