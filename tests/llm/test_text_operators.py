"""The text operators against brute force, on odd rows and on empty tables."""

import hashlib
import zlib
from collections import Counter

import duckdb
import numpy as np
import pandas as pd
import pyarrow as pa
import public_tokenizers
import pytest
from tokenizers import Tokenizer

import __spark_entry__ as entry
from tests.conftest import SMALL
from tidemark.llm import decontaminate, html_layout, licenses, packing, quality, queries, shards, sql, substring_dedup, textops, warc, winnowing
from tidemark.llm.components import components
from tidemark.llm.jaccard_join import jaccard_components
from tidemark.llm.substring_dedup import remove_repeats

TOKENS = public_tokenizers.path("word_bpe_49k.json")


def texts(frame):
    return [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]


def run_sql(text, frame):
    con = duckdb.connect()
    con.register("documents", pd.DataFrame(texts(frame), columns=["doc_id", "text"]).astype({"doc_id": "Int64"}))
    return con.sql(text).fetchall()


# components ------------------------------------------------------------------------------------------------------------


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 60, (45, 2))] + [(100 + i, 101 + i) for i in range(30)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    root = {x: x for e in edges for x in e}
    for _ in root:
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    assert got == {x: r for x, r in root.items() if any(x in e and e[0] != e[1] for e in edges)}


# sharding --------------------------------------------------------------------------------------------------------------


def test_shards_round_trip_and_versions(spark, some_docs, tmp_path):
    store = shards.ShardStore(spark, f"file://{tmp_path}/store", target_bytes=1 << 20, least_bytes=4 << 10)
    whole = sorted(texts(some_docs))
    first = store.append(some_docs.where("doc_id % 2 = 0"), 10)
    store.append(some_docs.where("doc_id % 2 = 1"), 10)
    before = store.manifest().count()
    assert store.compact() is not None
    assert store.manifest().count() < before
    assert sorted(texts(store.read())) == whole
    assert sorted(texts(store.read(first))) == [r for r in whole if r[0] % 2 == 0]
    with pytest.raises(shards.Conflict):
        store.commit(store.manifest(), store.versions()[-1])
    assert store.vacuum() == 0 and store.vacuum(lease=0) == 0  # young, then named by the version before the last
    store.append(some_docs.limit(1), 10)
    late = shards.ShardStore(spark, store.root)
    late._written(some_docs.limit(2), 99)
    assert store.vacuum(lease=0) > 0
    assert len(list(store._context.util().listStatus(store._path("intents")))) == 1
    assert late.vacuum(lease=0, abandoned=0) == 1  # the writer that never came back
    assert sorted(texts(store.read())) == sorted([*whole, *texts(some_docs.limit(1))])


def test_stored_documents_by_brute_force(spark):
    """Every row once, every shard in the tier of its size, and no tier below half the target left full."""
    import os

    rows = queries.op1_sharding_size_tiered(spark, SMALL).collect()
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = Counter((d.doc_id, len(d.text.encode()), hashlib.sha256(d.text.encode()).hexdigest(), d.lang, d.source, d.n_chars) for d in docs)
    assert Counter(tuple(r)[:6] for r in rows) == want
    kept = {r.shard: (r.shard_bytes, r.tier) for r in rows}
    tier = lambda n: 0 if n < 1 << 20 else int(np.log(n / (1 << 20)) / np.log(4) + 1e-12) + 1
    assert all(t == tier(n) for n, t in kept.values())
    assert max(Counter(t for n, t in kept.values() if n < 64 << 20).values()) < 4
    assert len({r.version for r in rows}) == 1 and rows[0].version > 5  # five arrivals, and merges
    assert len({r.shard for r in rows}) < 5 and os.path.basename(rows[0].shard) == rows[0].shard


def test_shards_odd(odd_docs, no_docs):
    got = shards.arrive_and_compact(odd_docs.withColumnRenamed("digest", "shard"), most_rows=2)
    assert Counter(texts(got)) == Counter(texts(odd_docs))
    assert shards.arrive_and_compact(no_docs).count() == 0


# WARC ------------------------------------------------------------------------------------------------------------------


def test_warc_odd(spark):
    big = "<p>" + "x" * 200
    rows = [(3, "u", big), (1, None, big), (None, "u", big), (2, "u", "short"), (4, "u", "short"), (5, "u", None), (7, "u", "é" * 99), (7, "u", "é" * 99), (8, "u", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS first")
    got = warc.read_archives(warc.write_archives(pages), with_payload=True).where("kind = 'record'").collect()
    seen = sorted(((r.page_id or 0, r.record_type, r.refers_to, r.payload_bytes) for r in got), key=str)
    assert seen == sorted([(1, "response", None, 203), (3, "revisit", 1, 203), (0, "revisit", 1, 203), (2, "response", None, 5), (4, "response", None, 5), (5, "response", None, 0), (7, "response", None, 198), (7, "revisit", 7, 198), (8, "response", None, 0)], key=str)
    assert all(r.payload_digest == hashlib.sha256((dict((p, h) for p, _, h in rows)[r.page_id] or "").encode()).hexdigest() for r in got)
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def records(n, press=True):
    out = []
    for i in range(n):
        body = f"<html>page {i} WARC/1.0 inside</html>".encode() * 9
        raw = warc.record_bytes(i, f"http://x/{i}", body, hashlib.sha256(body).hexdigest(), None, False, "2024-01-01T00:00:00Z")
        if press:
            c = zlib.compressobj(6, zlib.DEFLATED, 31)
            raw = c.compress(raw) + c.flush()
        out.append(raw)
    return out


@pytest.mark.parametrize("press", [True, False])
def test_salvage(press):
    import io

    members = records(6, press)
    broken = [*members]
    broken[1] = members[1][:40] + bytes(b ^ 0xFF for b in members[1][40:60]) + members[1][60:]
    broken[3] = members[3][: len(members[3]) // 2]
    data = b"junk" + b"".join(broken) + b"tail"
    got = list(warc.salvage(io.BytesIO(data)))
    pages = [x[3][0]["warc-record-id"] for x in got if x[0] == "record"]
    assert pages == [f"<urn:x-page:{i}>" for i in (0, 2, 4, 5)]
    assert sum(x[2] for x in got) == len(data)
    gaps = [(x[1], x[2]) for x in got if x[0] == "gap"]
    assert gaps == [(0, 4), (4 + len(members[0]), len(broken[1])), (4 + sum(map(len, broken[:3])), len(broken[3])), (len(data) - 4, 4)]
    assert list(warc.salvage(io.BytesIO(b""))) == []


# suffix-array dedup ----------------------------------------------------------------------------------------------------


def removed(docs, length=100):
    """Brute force by the contract's words; a null id stands first."""
    key = lambda d: -(1 << 63) if d is None else d
    first = {}
    raw = [(d, (t or "").encode()) for d, t in docs]
    for d, b in raw:
        for p in range(len(b) - length + 1):
            s = b[p : p + length]
            first[s] = min(first.get(s, (1 << 63, 0)), (key(d), p))
    out = []
    for d, b in raw:
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - length + 1):
            if (key(d), p) > first[b[p : p + length]]:
                gone[p : p + length] = True
        spans = int(np.sum(np.diff(np.concatenate([[0], gone.astype(int)])) == 1))
        out.append((d, len(b), int(gone.sum()), spans, hashlib.sha256(np.frombuffer(b, np.uint8)[~gone].tobytes()).hexdigest()))
    return Counter(out)


def dedup(frame):
    return Counter(tuple(r) for r in remove_repeats(frame).select("row.doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect())


def test_repeats_brute_force(some_docs, odd_docs, no_docs):
    assert dedup(some_docs) == removed(texts(some_docs))
    assert dedup(odd_docs) == removed(texts(odd_docs))
    assert dedup(no_docs) == Counter()
    assert sorted(run_sql(sql.REMOVED_REPEATS, some_docs)) == sorted(removed(texts(some_docs)).elements())


def test_repeats_many_without_id(spark):
    rng = np.random.default_rng(4)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    shared = [word(130) for _ in range(20)]
    rows = [(None if k % 3 else 7, word(rng.integers(1, 90)) + (shared[k % 20] if k % 2 else word(rng.integers(1, 120))) + word(rng.integers(0, 60))) for k in range(4000)]
    frame = spark.createDataFrame([*rows, *rows[:40], *((k, t) for k, (_, t) in enumerate(rows[:40]))], "doc_id long, text string")
    assert dedup(frame) == removed(texts(frame))


def hot_docs():
    """One passage with different text around it in very many documents, and one at the head of rows without id."""
    rng = np.random.default_rng(6)
    word = lambda n: "".join(rng.choice(list("abcdefgh "), n))
    hot, head = word(130), word(400)
    rows = [(k * 7 % 3001, word(rng.integers(40, 90)) + hot + word(90)) for k in range(3001)]
    return [*rows, *rows[:30], *((None, head + word(rng.integers(0, 90))) for _ in range(300)), (5, word(30) + head[:250]), (-4, head[120:] + hot[:101])]


def test_repeats_hot(spark):
    rows = hot_docs()
    assert dedup(spark.createDataFrame(rows, "doc_id long, text string")) == removed(rows)


def test_hot_lanes_hold_few_texts(monkeypatch):
    monkeypatch.setattr(substring_dedup, "_PARTS", ((8, 2), (256, 8)))
    rows = [(d, k, t.encode()) for k, (d, t) in enumerate(x for x in hot_docs() if x[0] is not None)]
    doc, check, text = (pa.array(x) for x in zip(*rows, strict=True))
    batch = pa.record_batch([doc, check, text], ["doc", "check", "text"])
    anchors = pa.Table.from_batches(substring_dedup._anchors([batch], 100)).sort_by([(c, "ascending") for c in ("anchor", "context", "doc", "place", "check")])
    found = pa.Table.from_batches(substring_dedup._classes(anchors.to_batches(500))).to_pylist()
    lists = [[] for _ in rows]
    for f in found:
        if f["classes"]:
            lists[f["check"]].append({k: f[k] for k in ("start", "windows", "anchor", "offset", "classes")})
    kind = pa.list_(pa.struct([("start", pa.int64()), ("windows", pa.int32()), ("anchor", pa.int64()), ("offset", pa.int32()), ("classes", pa.int32())]))
    packed = next(substring_dedup._packed([pa.record_batch([doc, check, doc, text], ["doc", "check", "row", "text"])]))
    owners = pa.record_batch([doc, check, packed.column("packed"), pa.array(lists, kind)], ["doc", "check", "packed", "found"])
    assert max(f["classes"] for f in found) > 256
    lanes = pa.Table.from_batches(substring_dedup._lanes([owners], 100))
    assert max(Counter(lanes["lane"].to_pylist()).values()) <= 2 * 256


def test_suffix_arrays():
    from tidemark.llm.lyndon import suffix_arrays

    rng = np.random.default_rng(4)
    for _ in range(300):
        parts = [np.append(rng.integers(1, rng.integers(2, 5), rng.integers(0, 12)), 0) for _ in range(rng.integers(1, 7))]
        cut = np.sort(rng.choice(np.arange(1, len(parts)), rng.integers(0, len(parts)), replace=False)) if len(parts) > 1 else []
        ends = np.cumsum([len(p) for p in parts])
        bounds = np.array([0, *(ends[c - 1] for c in cut), ends[-1]])
        text = np.concatenate(parts)

        def order(i):
            stop = i + int(np.argmax(text[i:] == 0))
            return [*(int(x) for x in text[i:stop] + 1000), stop]

        want = [i for a, b in zip(bounds[:-1], bounds[1:]) for i in sorted(range(a, b), key=order)]
        assert suffix_arrays(text.astype(np.int32), bounds).tolist() == want


# packing ---------------------------------------------------------------------------------------------------------------


def test_packing_round_trip(some_docs, odd_docs, no_docs):
    tok = Tokenizer.from_file(TOKENS)
    for frame in (some_docs, odd_docs):
        got = packing.pack_documents(frame, TOKENS, width=64, group_pieces=16, with_ids=True).toPandas()
        want = Counter((d, tuple(tok.encode(t or "", add_special_tokens=False).ids + [2])) for d, t in texts(frame))
        assert got.doc_tokens[got.start == 0].sum() == sum(len(i) * c for (_, i), c in want.items())
        assert (got.length == got.ids.map(len)).all() and got.length.between(1, 64).all()
        assert all(c == zlib.crc32(np.asarray(i, "<u4").tobytes()) for c, i in zip(got.ids_crc32, got.ids))
        for _, s in got.sort_values("offset").groupby("sequence_id"):
            assert s.offset.tolist() == [0, *np.cumsum(s.length)[:-1]] and s.length.sum() <= 64
        unique = got.groupby(["doc_id", "start"], dropna=False).size()
        for (d, ids), c in want.items():
            if c == 1 and d is not None and unique.get((d, 0)) == 1:
                own = got[got.doc_id == d].sort_values("start")
                assert tuple(x for i in own.ids for x in i) == ids
    assert packing.pack_documents(no_docs, TOKENS).count() == 0


def test_first_fit_decreasing():
    rng = np.random.default_rng(3)
    for _ in range(100):
        size = rng.integers(1, 30, rng.integers(1, 50))
        free, want = [], np.zeros(len(size), int)
        for i in np.argsort(-size, kind="stable"):
            j = next((j for j, f in enumerate(free) if f >= size[i]), len(free))
            free += [30] * (j == len(free))
            free[j] -= size[i]
            want[i] = j
        assert (packing.first_fit_decreasing(size, 30) == want).all()


# decontamination -------------------------------------------------------------------------------------------------------


def near(item, text):
    """Least edits of the item against any stretch of the text."""
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row)


def test_leaks_brute_force(spark):
    import random

    rng = random.Random(1)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7)))
    items = [(i, " ".join(word() for _ in range(8))) for i in range(4)]
    docs = []
    for k in range(40):
        words = [word() for _ in range(12)]
        if k % 2:
            piece = list(items[k % 4][1])
            for _ in range(rng.randint(0, 5)):
                at = rng.randrange(len(piece))
                piece[at : at + rng.randint(0, 1)] = rng.choice(["", "x", "yy"])
            piece = "".join(piece[: rng.choice([len(piece), len(piece) // 2])])
            words.insert(6, piece.upper() if k % 3 else piece.replace(" ", " \n "))
        docs.append((k, " ".join(words)))
    window, edits = 24, 2
    want = set()
    for d, t in docs:
        t = " ".join(t.lower().split())
        for i, s in items:
            w = min(window, len(s))
            if any(near(s[a : a + w], t) <= edits * w // window for a in range(len(s) - w + 1)):
                want.add((d, i))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id) for r in decontaminate.find_leaks(frame, bench, q=5, window=window, edits=edits).collect()}
    assert got == want and 5 < len(want)
    kept = {r.doc_id for r in decontaminate.without_leaks(frame, bench, q=5, window=window, edits=edits).collect()}
    assert kept == {d for d, _ in docs} - {d for d, _ in want}


def test_leaks_odd(spark, odd_docs, no_docs):
    bench = spark.createDataFrame([(1, "Same text in two rows, word for word"), (None, None), (2, ""), (3, "tiny"), (4, "a null id has text too")], "item_id long, text string")
    got = [(r.doc_id, r.item_id) for r in decontaminate.find_leaks(odd_docs, bench).collect()]
    assert sorted(got, key=str) == sorted([(5, 1), (5, 1), (None, 4)], key=str)
    assert decontaminate.find_leaks(no_docs, bench).count() == 0
    assert decontaminate.find_leaks(odd_docs, bench.limit(0)).count() == 0
    assert decontaminate.without_leaks(odd_docs, bench).columns == odd_docs.columns


# Jaccard join ----------------------------------------------------------------------------------------------------------


def test_jaccard(some_docs, odd_docs, no_docs):
    got = sorted(tuple(r) for r in jaccard_components(some_docs).collect())
    assert got == sorted(run_sql(sql.JACCARD_COMPONENTS, some_docs))
    assert any(d != c for d, _, c in got)
    odd = Counter(tuple(r) for r in jaccard_components(odd_docs).collect())
    assert odd == Counter([(1, 0, 1), (2, 0, 2), (None, 2, None), (4, 5, 4), (5, 8, 5), (5, 8, 5), (6, 1, 6), (7, 0, 7)])
    assert jaccard_components(no_docs).count() == 0


# winnowing -------------------------------------------------------------------------------------------------------------


def chosen(b, k, w):
    if not b:
        return []
    raw = np.frombuffer(b, np.uint8)
    hashes = textops.gram_hash(raw, k).tolist() or textops.span_hash(textops.prefix_hash(raw), np.array([0]), np.array([len(b)])).tolist()
    out = {}
    for s in range(max(1, len(hashes) - w + 1)):
        part = [h >> 24 for h in hashes[s : s + w]]
        i = s + max(j for j, h in enumerate(part) if h == min(part))
        out[i] = hashes[i] >> 32
    return sorted((i, h) for i, h in out.items())


def test_winnowing(some_docs, odd_docs, no_docs):
    for frame in (some_docs, odd_docs):
        rows = sorted(texts(frame), key=lambda r: (-(r[0] if r[0] is not None else -(1 << 63)), r[1] or ""))
        got = Counter((r.doc_id, r.n_chars, r.edited_sha256, r.fingerprint) for r in winnowing.fingerprints(frame).collect())
        want = Counter()
        for i, (d, t) in enumerate(rows):
            t, following = t or "", rows[(i + 1) % len(rows)][1] or ""
            half = len(t) // 2
            edited = t[: len(t) - half] + following[:half]
            print_ = "".join(f"{h:08x}{p:08x}" for p, h in chosen(t.encode(), winnowing.GRAM, winnowing.WINDOW)) if len(t) < 3000 else None
            want[d, len(t), hashlib.sha256(edited.encode()).hexdigest(), print_] += 1
        assert {k[:3]: v for k, v in got.items()} == {k[:3]: v for k, v in want.items()}
        for k in want:
            assert k[3] is None or k in got
    assert winnowing.fingerprints(no_docs).count() == 0
    alone = winnowing.fingerprints(some_docs.limit(1)).first()
    assert alone.near_next == 1.0 and alone.near_edited > 0


# HTML ------------------------------------------------------------------------------------------------------------------


@pytest.mark.parametrize(
    ("html", "want"),
    [
        ("<p>One <b>two</b><p>three", "One two\n\nthree"),
        ("<ul><li>a<li>b<ul><li>c</ul></ul><ol start=3><li>q<li>r</ol>", "- a\n- b\n  - c\n\n3. q\n4. r"),
        ("<table><tr><th>Name<th>N<tr><td>Ab cd<td>12</table>x", "Name   N\nAb cd  12\n\nx"),
        ("<table><tr><td rowspan=2>a<td>b<tr><td>c</table>", "a  b\n   c"),
        ("a<pre>\n x  y\nz</pre>b", "a\n\n x  y\nz\n\nb"),
        ("<style>.h,#i{display:none}</style><div class='b h'>no</div><p id=i>no<p hidden>no<p style='visibility: hidden'>no<p>yes", "yes"),
        ("<head><title>no</title></head><script>var t='</p>'</script><noscript>no</noscript>t&amp;u<br>v<!-- no -->", "t&u\nv"),
        ("<details>no<summary>s</summary></details><details open><summary>t</summary>u</details>", "s\n\nt\nu"),
        ("<div>a<div>b</div>c</div></b></p>d", "a\nb\nc\n\nd"),
        ("", ""),
        ("a < b and <", "a < b and <"),
    ],
)
def test_layout(html, want):
    assert html_layout.render(html)[0] == want


def test_html_odd(spark):
    pages = spark.createDataFrame([(1, None, None, 5), (None, "u", "<p>x", 6), (2, "u", "<div>" * 3000 + "deep", 7), (2, "u", "<div>" * 3000 + "deep", 7)], "page_id long, url string, html string, text long")
    got = Counter((r.page_id, r.text) for r in html_layout.extract_text(pages).collect())
    assert got == Counter([(1, ""), (None, "x"), (2, "deep"), (2, "deep")])
    assert html_layout.extract_text(pages.limit(0)).count() == 0


@pytest.mark.parametrize(
    "html",
    ["<blockquote>" * 3000 + "deep", "<ul><li>" * 3000 + "deep", "<ol><li>" * 3000 + "deep", "<dl><dd>" * 3000 + "deep", "<table><tr><td>" * 3000 + "deep", "<table>" * 3000 + "deep", "<pre>" + "<b>" * 3000 + "deep",
     "<blockquote><p>x</p><ul><li>y" * 1000 + "deep"],
)
def test_layout_deep(html):
    assert html_layout.render(html)[0].endswith("deep")


# quality ---------------------------------------------------------------------------------------------------------------


def test_quality_held_out(spark):
    folder = "/root/testdata/sf0.01"
    got = queries.op9_pu_quality_classifier(spark, folder).toPandas()
    truth = pd.read_parquet(f"{folder}/labels.parquet")
    both = got.merge(truth, on="doc_id")
    held = both[both.held_out]
    assert (held.held_out == held.doc_id.map(lambda d: zlib.crc32(str(d).encode()) % 5 == 0)).all()
    assert got.score.between(0, 1).all() and len(got) == 1000
    assert (held.predicted == held.quality).mean() > 0.95
    assert (held[held.quality == 1].predicted == 1).mean() > 0.98


def test_quality_odd(spark, odd_docs, no_docs):
    labels = spark.createDataFrame([(1, 1), (1, 0), (None, 1), (4, None), (5, 1), (6, 0), (7, 1)], "doc_id long, quality int")
    scored = quality.score_documents(odd_docs, quality.learn(odd_docs, labels))
    assert scored.count() == odd_docs.count() and scored.where("score BETWEEN 0 AND 1").count() == odd_docs.count()
    blank = quality.score_documents(odd_docs, quality.learn(odd_docs, labels.limit(0)))
    assert {r.score for r in blank.collect()} == {0.5}
    assert quality.score_documents(no_docs, quality.learn(no_docs, labels)).count() == 0


# licences --------------------------------------------------------------------------------------------------------------


def test_licenses(spark, odd_docs, no_docs):
    plain = ["plain words of no licence at all " * 3, "the driver has a license and drives under the bridge", "Er thing on the and of"] * 50
    model = licenses.learn(spark.createDataFrame(list(enumerate(plain)), "doc_id long, text string"))
    docs = spark.createDataFrame(
        [(1, "Some text here.\nReleased under the MIT License."), (2, "x\nLicensed under the Apache License, Version 2.0.\nReleased under the MIT License."), (3, "He showed his driving license."),
         (4, ("word " * 70) + "This work is licensed under the GNU General Public License, version 3. " + ("word " * 70)), (5, "Licensed under CC BY-NC 4.0."), (6, "")],
        "doc_id long, text string",
    )
    got = {r.doc_id: (r.n_licensed > 0, r.licenses) for r in licenses.scan_licenses(docs, model).collect()}
    assert got == {1: (True, "MIT"), 2: (True, "Apache-2.0,MIT"), 3: (False, None), 4: (True, "GPL"), 5: (True, "CC-BY-NC"), 6: (False, None)}
    odd = licenses.scan_licenses(odd_docs)
    assert odd.count() == odd_docs.count() and odd.where("n_licensed > 0").count() == 0
    assert licenses.scan_licenses(no_docs).count() == 0


# queries and pipeline --------------------------------------------------------------------------------------------------


def test_queries_against_sql(spark):
    con = duckdb.connect()
    for t in ("documents", "pages"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SMALL}/{t}.parquet'")
    for name, text in queries.ORACLES.items():
        want = con.sql(text)
        got = entry.queries()[name](spark, SMALL).select(*want.columns).collect()
        assert Counter(tuple(r) for r in got) == Counter(want.fetchall()), name


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    columns = docs.columns
    truth = {r.doc_id: r.quality for r in spark.read.parquet(f"{SMALL}/labels.parquet").collect()}
    stage = dict(corpus_pipeline.STAGES)
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_copies", "repeats", "leaks", "packing"]

    good = stage["quality"](spark, docs, SMALL).cache()
    kept = {r.doc_id for r in good.select("doc_id").collect()}
    assert good.columns == columns and np.mean([(d in kept) == bool(q) for d, q in truth.items()]) > 0.95

    single = stage["near_copies"](spark, docs, SMALL)
    groups = {r[0]: r[2] for r in run_sql(sql.JACCARD_COMPONENTS, docs) for r in [r]}
    assert single.columns == columns and Counter(r.doc_id for r in single.collect()) == Counter({c: 1 for c in groups.values()})

    cut = {r.doc_id: (r.text, r.n_chars) for r in stage["repeats"](spark, docs, SMALL).collect()}
    for d, n, gone, _, digest in removed(texts(docs)).elements():
        if gone == n and n:
            assert d not in cut
        elif gone == 0:
            assert hashlib.sha256(cut[d][0].encode()).hexdigest() == digest and cut[d][1] == len(cut[d][0])
        else:
            assert len(cut[d][0].encode()) <= n - gone

    leaked = {r.doc_id for r in decontaminate.find_leaks(docs, spark.read.parquet(f"{SMALL}/benchmark.parquet")).collect()}
    clean = stage["leaks"](spark, docs, SMALL)
    assert clean.columns == columns and {r.doc_id for r in clean.collect()} == {d for d, _ in texts(docs)} - leaked and leaked

    packed = corpus_pipeline.run(spark, SMALL).toPandas()
    assert packed.groupby("sequence_id").length.sum().max() <= 4096 and 0 < packed.doc_id.nunique() <= docs.count()


def test_pipeline_odd(spark, odd_docs, no_docs):
    import corpus_pipeline

    for docs, rows in ((odd_docs, None), (no_docs, 0)):
        for name, stage in corpus_pipeline.STAGES:
            out = stage(spark, docs, SMALL)
            n = out.count()
            assert rows is None or n == rows, name
    one = corpus_pipeline.near_copies(spark, odd_docs, SMALL)
    assert one.columns == odd_docs.columns and Counter(r.doc_id for r in one.collect()) == Counter([1, 2, None, 4, 5, 6, 7])


def test_near_copies_without_id(spark):
    import corpus_pipeline

    words = lambda seed: [f"w{x}" for x in np.random.default_rng(seed).integers(0, 10**6, 80)]
    text = lambda seed, end="": " ".join([*words(seed), end])
    rows = [
        (None, ""), (None, text(1, "null copy")), (3, text(1, "with id")), (None, text(2, "one")), (None, text(2, "two")), (None, text(3)), (None, text(3)),
        (4, text(4)), (9, text(4, "near")), (9, text(5, "alone")), (9, text(5, "alone")), (-5, text(6)), (None, text(6)), (7, text(7, "a")), (7, text(7, "b")), (8, " "), (8, None),
    ]
    got = Counter((r.doc_id, r.text) for r in corpus_pipeline.near_copies(spark, spark.createDataFrame(rows, "doc_id long, text string"), SMALL).collect())
    assert sum(got.values()) == len(got) == 10
    assert {(None, ""), (3, text(1, "with id")), (None, text(3)), (4, text(4)), (9, text(5, "alone")), (-5, text(6)), (8, " ")} < set(got)
    assert len({(None, text(2, "one")), (None, text(2, "two"))} & set(got)) == len({(7, text(7, "a")), (7, text(7, "b"))} & set(got)) == 1
