"""Line bitmaps, collocations and resampling against brute force, on odd rows and on empty tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm import collocations as phrases
from tidemark.llm import line_dedup as lines
from tidemark.llm import resampling as draws

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


@pytest.fixture(scope="module")
def lined(spark):
    """Documents of repeated lines, some of more than 64 lines, with repeated rows and null ids."""
    rng = random.Random(3)
    pool = [" ".join(rng.choice(["Alpha", "beta", "GAMMA", "é", "x"]) for _ in range(rng.randint(1, 5))) for _ in range(60)]
    rows = []
    for i in range(80):
        n = rng.choice([0, 1, 3, 10, 70, 200])
        rows.append((i * 7 - 50, "\n".join(rng.choice(["", " ", "\t", "\r"]) + rng.choice(pool) + rng.choice(["", "  ", "\x0b"]) for _ in range(n))))
    rows += [(rows[-1][0], rows[-1][1]), (rows[-1][0], "Another text\nunder one id, as long as it takes"), (None, pool[0] + "\n" + pool[1] + " and more of it"), (None, pool[0] + "\n" + pool[1] + " and more of it")]
    rows += [(10_000, None), (10_001, ""), (10_002, "\n\n"), (10_003, "a common line, everywhere"), *((20_000 + k, "a common line, everywhere") for k in range(300))]
    return rows


def kept_by_hand(rows, least=10):
    key = lambda s: s.strip(lines.SPACE).translate(LOWER)
    order = lambda i: -(1 << 63) if i is None else i
    first = {}
    for i, t in rows:
        for s in (t or "").split("\n"):
            if len(key(s)) >= least:
                first[key(s)] = min(first.get(key(s), 1 << 63), order(i))
    out = []
    for i, t in rows:
        all_ = (t or "").split("\n")
        kept = [s for s in all_ if not (len(key(s)) >= least and order(i) > first[key(s)])]
        out.append((i, len(all_), len(all_) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def test_lines_by_hand(spark, lined):
    docs = spark.createDataFrame(lined, "doc_id long, text string")
    got = lines.dedup_lines(docs).select("row.doc_id", "n_lines", "n_dropped", lines.kept_text("row.text", "keep").alias("kept")).collect()
    assert sorted((tuple(r) for r in got), key=repr) == kept_by_hand(lined)


def test_lines_without_slices(spark, lined, monkeypatch):
    """Slices are a matter of balance: with none, and with every key cut, the rows are the same."""
    docs = spark.createDataFrame(lined, "doc_id long, text string")
    hashed = lines.hashed_lines(docs)
    want = sorted(map(tuple, lines.later_lines(hashed).collect()))
    for share in (1, 1 << 13):
        monkeypatch.setattr(lines, "SHARE", share)
        assert sorted(map(tuple, lines.later_lines(hashed).collect())) == want


def test_bitmap_is_compressed(spark):
    """A document that loses lines 0 to 63999 and line 70000 has two runs with their gap, not a thousand words."""
    gone = spark.range(64_000).union(spark.range(70_000, 70_001)).select(F.lit(1).cast("long").alias("doc"), F.lit(2).cast("long").alias("body"), F.col("id").cast("int").alias("pos"))
    (row,) = lines.bitmaps(gone).collect()
    assert row.n_dropped == 64_001
    assert [tuple(r) for r in row.keep] == [(0, 1000, 0), (93, 1, ~(1 << (70_000 % 64)))]


def test_lines_odd(spark, odd_docs, no_docs):
    clash = odd_docs.withColumn("keep", F.lit("k")).withColumn("doc", F.lit(1)).withColumn("body", F.lit(2)).withColumn("row", F.lit(3)).withColumn("pos", F.lit(4))
    out = lines.dedup_lines(clash)
    assert out.count() == odd_docs.count()
    assert set(out.select("row.*").columns) == set(clash.columns)
    assert lines.dedup_lines(no_docs).count() == 0


def phrases_by_hand(rows, longest=3, least=10, covered=50, top=2000):
    f, n = defaultdict(Counter), Counter()
    for lang, text in rows:
        lang = lang or "und"
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOWER)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang] += len(w)
            for k in range(1, longest + 1):
                for i in range(len(w) - k + 1):
                    f[lang][tuple(w[i : i + k])] += 1
    out = []
    for lang, count in f.items():
        often = {g: c for g, c in count.items() if c >= least and len(g) > 1}
        holder = defaultdict(int)
        for g, c in often.items():
            for k in range(2, len(g)):
                for i in range(len(g) - k + 1):
                    holder[g[i : i + k]] = max(holder[g[i : i + k]], c)
        best = []
        for g, a in often.items():
            if 100 * holder[g] >= covered * a:
                continue
            cuts = [(1000000 * a * a // (count[g[:j]] * count[g[j:]]), j) for j in range(1, len(g))]
            score, j = min(cuts)
            best.append((-score, -a, " ".join(g).encode(), lang, " ".join(g), a, count[g[:j]], count[g[j:]]))
        for r, (score, _, _, lang, g, a, l, right) in enumerate(sorted(best)[:top], 1):
            out.append((lang, r, g, a, l, right, n[lang], -score))
    return sorted(out)


@pytest.fixture(scope="module")
def wordy():
    rng = random.Random(11)
    vocabulary = ["the", "of", "a", "Über", "naïve", "x\x00y", "zz", "\x0e"] + [f"w{i}" for i in range(12)]
    passage = " ".join(f"p{i}" for i in range(25))
    rows = []
    for k in range(240):
        words = [rng.choice(vocabulary) if rng.random() < 0.9 else f"rare{rng.randrange(900)}" for _ in range(rng.randint(0, 60))]
        text = "".join(w + rng.choice([" ", " ", "  ", "\t", ", ", ".", "\n", " \r "]) for w in words)
        if k % 12 == 0:
            text += ". " + passage + (" onward" if k % 24 else "")
        rows.append((rng.choice(["en", "de", None, "und"]), text))
    return [*rows, (None, None), ("en", ""), ("fr", "ab ab ab ab " * 8), ("long", "one two three " * 30_000)]


@pytest.mark.parametrize("longest", [2, 3, 4])
def test_phrases_by_hand(spark, wordy, longest):
    docs = spark.createDataFrame(wordy, "lang string, text string").repartition(3)
    got = phrases.collocations(docs, longest)
    assert got.columns == ["lang", "rank", "phrase", "a", "l", "r", "n", "score"]
    assert sorted(map(tuple, got.collect())) == phrases_by_hand(wordy, longest)


def test_phrases_limit(spark, wordy):
    docs = spark.createDataFrame(wordy, "lang string, text string")
    assert sorted(map(tuple, phrases.collocations(docs, 3, least=2, top=5).collect())) == phrases_by_hand(wordy, 3, 2, top=5)


def test_paths_are_compacted(spark, wordy):
    """The passage of 25 words, in 20 texts, is one row of the graph; all its edges come back from it."""
    docs = spark.createDataFrame(wordy, "lang string, text string").select(F.lit("all").alias("lang"), F.coalesce("text", F.lit("")).alias("text"))
    tables = []
    for _ in range(2):
        tables.append(phrases.frequent_bits(docs, 10, tables))
    grams = phrases.longest_grams(docs, 3, tables)
    edges = grams.groupBy("lang", "gram", "k").agg(F.sum("c").alias("c"))
    level = phrases.node_flow(edges, 3)
    often = {k: v.where("f >= 10") for k, v in level.items()}
    paths = phrases.compacted(often[3], often[2], 3)
    rows = [(r.words, r.f, r.f_head, r.f_tail) for r in paths.collect()]
    assert ([f"p{i}" for i in range(25)], 20, 20, 20) in rows
    back = sorted((r.lang, r.gram, r.f) for r in phrases._windows(paths, 3).collect())
    assert back == sorted((r.lang, r.gram, r.f) for r in often[3].collect())


def test_words_under_one_hash(monkeypatch):
    """Words whose hashes are equal are told apart by their bytes."""
    import pyarrow as pa

    data = np.frombuffer(b"aa bb aa cc bb cc", np.uint8)
    words = phrases._Words(data, np.array([0, len(data)]), np.array([0]))
    words.hash = np.zeros(words.n, np.uint64)
    number = words.numbers()
    assert number[0] == number[2] and len({number[0], number[1], number[3]}) == 3
    assert pa.types.is_string(phrases._strings(words.data, words.start, words.stop).type)


def test_phrases_odd(spark, odd_docs, no_docs):
    clash = odd_docs.withColumn("gram", F.lit(1)).withColumn("f", F.lit(2)).withColumn("k", F.lit(3))
    rows = clash.select("lang", "text").collect()
    assert sorted(map(tuple, phrases.collocations(clash).collect())) == phrases_by_hand([tuple(r) for r in rows])
    assert phrases.collocations(no_docs).count() == 0


def drawn_by_hand(docs, target, percent=25, least_words=20, seed=7, buckets=10_000):
    def feats(text):
        w = [x.encode() for x in re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))]
        return len(w), [zlib.crc32(x) % buckets for x in w + [a + b" " + b for a, b in zip(w, w[1:])]]

    have, want = Counter(), Counter()
    for _, t in docs:
        have.update(feats(t)[1])
    for t in target:
        want.update(feats(t)[1])
    s, t = float(sum(have.values())), float(sum(want.values()))
    gain = [math.floor(1000 * math.log((want[b] + 1.0) * (s + buckets) / ((have[b] + 1.0) * (t + buckets)))) for b in range(buckets)]
    out = []
    for i, text in docs:
        n, f = feats(text)
        weight = sum(gain[b] for b in f) // len(f) if f else 0
        h = int(hashlib.sha256(f"{seed}:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        out.append((i, n, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    competing = sorted((-x[4], -(1 << 63) if x[0] is None else x[0], k) for k, x in enumerate(out) if x[1] >= least_words)
    rank = {k: r for r, (_, _, k) in enumerate(competing[: percent * len(competing) // 100], 1)}
    return [(x[0], x[2], x[3], x[4], rank.get(k)) for k, x in enumerate(out)]


def test_draws_by_hand(spark):
    rng = random.Random(2)
    word = lambda: "".join(rng.choice("abcé9-X") for _ in range(rng.randint(1, 6)))
    docs = [(i * 5 - 300, " ".join(word() for _ in range(rng.randint(0, 60)))) for i in range(400)] + [(9_000, None), (9_001, ""), (9_002, "y" * 500 + " " + "z" * 49 + " ok"), (None, " ".join(["fresh"] * 25))]
    target = [" ".join(word() for _ in range(30)) for _ in range(20)] + [None]
    frame = spark.createDataFrame(docs, "doc_id long, text string").repartition(7)
    got = draws.resample(frame, spark.createDataFrame([(t,) for t in target], "text string"))
    assert got.columns == ["doc_id", "n_features", "weight", "score", "rank"]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(drawn_by_hand(docs, target), key=repr)


def test_ranks_of_ties(spark):
    """Rows that are all alike but for their tags still have each rank once, in several segments."""
    from tidemark.session import staged

    rows = spark.range(20_000).repartition(6).select((F.col("id") % 3).alias("_key"), F.lit(1).cast("long").alias("_doc"), F.monotonically_increasing_id().alias("_tag"))
    runs = staged(rows.sortWithinPartitions("_key", "_doc", "_tag"), "ties")
    got = draws.exact_ranks(runs).orderBy("rank").collect()
    assert [r["rank"] for r in got] == list(range(1, 20_001))
    assert [(r._key, r._tag) for r in got] == sorted((r._key, r._tag) for r in got)
    cuts = draws.splitters(runs, 20_000, 4)
    sizes = Counter(draws.segment_of(np.array([(r._key, r._doc, r._tag) for r in got]), cuts).tolist())
    assert len(sizes) == 4 and max(sizes.values()) < 2 * 20_000 / 4


def test_draws_odd(spark, odd_docs, no_docs):
    goal = spark.createDataFrame([("same text in two rows",), (None,)], "text string")
    clash = odd_docs.withColumn("weight", F.lit("w")).withColumn("rank", F.lit("r")).withColumn("_key", F.lit(0))
    got = draws.resample(clash, goal, percent=100, least_words=1, carry=tuple(clash.columns))
    assert sorted(r.row.text or "" for r in got.collect()) == sorted(r.text or "" for r in odd_docs.collect())
    assert sorted(r["rank"] for r in got.collect() if r["rank"]) == [1, 2, 3, 4, 5]  # a text of blanks and two without any have no words
    assert draws.resample(no_docs, goal).count() == 0
    assert draws.resample(odd_docs, goal.limit(0)).count() == odd_docs.count()
