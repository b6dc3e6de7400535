"""Salvage of archives damaged anywhere, and the one response among equal rows wherever Spark puts them."""

import io
import random
import tracemalloc

import pytest

from tests.llm.test_text_operators import records
from tidemark.llm import warc


def checked(data: bytes) -> list:
    got = list(warc.salvage(io.BytesIO(data)))
    at = 0
    for _, offset, size, _ in got:
        assert offset == at and size > 0
        at += size
    assert at == len(data)
    return got


@pytest.mark.parametrize("press", [True, False])
def test_every_byte_flipped(press):
    members = records(3, press)
    data = b"".join(members)
    for k in range(len(members[0]), len(members[0]) + min(len(members[1]), 420)):
        for flip in (0xFF, 0x01):
            broken = bytearray(data)
            broken[k] ^= flip
            ids = [x[3][0]["warc-record-id"] for x in checked(bytes(broken)) if x[0] == "record"]
            assert ids[0] == "<urn:x-page:0>" and ids[-1] == "<urn:x-page:2>"


@pytest.mark.parametrize("change", [(b"Content-Length: ", "Content-Length: ²".encode() + b" "), (b"Content-Length: ", b"Content-Length: " + b"9" * 5000), (b"<urn:x-page:1>", b"<urn:x-page:one>"), (b"WARC-Type: response", b"WARC-Type: revisit")])
def test_odd_fields_are_gaps(change):
    members = records(3, False)
    members[1] = members[1].replace(*change, 1)
    got = checked(b"".join(members))
    assert [x[0] for x in got] == ["record", "gap", "record"]


def test_random_damage_and_noise():
    rng = random.Random(5)
    for _ in range(150):
        data = bytearray(b"".join(records(4, rng.random() < 0.5)))
        for _ in range(rng.randint(1, 6)):
            at = rng.randrange(len(data))
            data[at : at + rng.randint(0, 30)] = bytes(rng.randrange(256) for _ in range(rng.randint(0, 30)))
        checked(bytes(data))
    checked(b"WARC/1.0\r\n" * 20_000)
    checked(b"\x1f\x8b\x08" * 20_000)


def test_memory_does_not_follow_the_block():
    body = b"x" * (40 << 20)
    raw = warc.record_bytes(1, None, body, "", None, False, "2024-01-01T00:00:00Z").replace(b"WARC-Payload-Digest: sha256:\r\n", b"")
    file = io.BytesIO(raw)
    tracemalloc.start()
    kinds = [x[0] for x in warc.salvage(file, keep=False)]
    assert kinds == ["record"] and tracemalloc.get_traced_memory()[1] < 8 << 20
    tracemalloc.stop()


def test_equal_rows_have_one_response(spark):
    rows = [(1, u, "<p>" + "x" * 300) for u in ("a", "b", None) for _ in range(40)] + [(2, "a", "<p>" + "x" * 300)] * 3
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(7)
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(got) == len(rows) and {r.kind for r in got} == {"record"}
    assert [r.page_id for r in got if r.record_type == "response"] == [1]
    assert all(r.refers_to == 1 for r in got if r.record_type == "revisit")
    assert sorted((r.page_id, r.url or "") for r in got) == sorted((p, u or "") for p, u, _ in rows)
