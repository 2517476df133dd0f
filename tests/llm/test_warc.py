"""WARC archives: round trips, revisits, foreign and damaged archives."""

import base64
import glob
import hashlib
import random

import pytest
import zstandard
from pyspark.sql import functions as F

from evtide.llm import warc
from evtide.llm.queries import ORACLES, QUERIES
from oracle_harness import compare

SCHEMA = "page_id bigint, url string, html string"
ROWS = [(1, "http://a.org/", "<p>same</p>"), (2, "http://b.org/", "<p>same</p>"),
        (3, None, None), (4, "", ""), (None, "http://no-id/", "<p>same</p>"),
        (None, "http://no-id/2", "only here"), (None, "http://no-id/3", "only here"),
        (7, "http://twice/", "twice"), (7, "http://twice/", "twice"), (7, "http://twice/b", "twice"),
        (8, "http://x/\r\nWARC-Type: forged\r\n\r\n", "é日本😀\r\n\r\nWARC/1.1\r\n" * 3),
        (9, "http://long/", "long text " * 60_000), (-4, "http://b.org/", "\x00\x1f ctrl")]


def digest(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


def brute(rows):
    groups = {}
    for i, (page, _, html) in enumerate(rows):
        groups.setdefault(html or "", []).append((page is not None, page or 0, i))
    out = []
    for html, ms in groups.items():
        ms.sort()
        known, page, _ = ms[-1]
        for j, (k, p, _) in enumerate(ms):
            first = j == len(ms) - 1
            out.append((p if k else None, len(html.encode()), digest(html.encode()),
                        "response" if first else "revisit",
                        page if known and not first else None))
    return sorted(out, key=str)


def got(df):
    assert df.columns == ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"]
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_round_trip_equals_brute_force(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    for name in ("payload", "sha256", "n", "first", "record_id", "_metadata", "archive"):
        df = df.withColumn(name, F.lit("clash"))
    assert got(warc.round_trip(df)) == brute(ROWS)


def test_many_copies_over_many_archives(spark, tmp_path):
    rng = random.Random(4)
    rows = [(i, f"http://h/{i}", "hot" if i % 3 == 0 else f"page {rng.randrange(300)} " * 9)
            for i in range(900)]
    path = str(tmp_path / "a")
    warc.write_archives(spark.createDataFrame(rows, SCHEMA).repartition(3), path, limit=4_000)
    assert len(glob.glob(path + "/part-*")) > 6
    records = warc.read_archives(spark, path)
    assert got(warc.pages_of(records)) == brute(rows)
    whole = records.where("record_type = 'response'").select("page_id", "payload", "uri").collect()
    texts = {i: h for i, _, h in rows}
    assert all(texts[r.page_id] == r.payload.decode() for r in whole)
    assert all(r.uri == f"http://h/{r.page_id}" for r in whole)


def test_empty_table(spark):
    assert got(warc.round_trip(spark.createDataFrame([], SCHEMA))) == []


def test_an_archive_is_a_dictionary_and_a_frame_per_record(spark, tmp_path):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    path = str(tmp_path / "a")
    warc.write_archives(pages, path, warc.stored_place(pages))
    for f in glob.glob(path + "/part-*"):
        data = open(f, "rb").read()
        parts = list(warc.frames(memoryview(data)))
        assert data[:4] == warc.DICTIONARY_FRAME and not any(e for *_, e in parts)
        size = int.from_bytes(data[4:8], "little")
        d = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(data[8:8 + size]))
        for at, frame, _ in parts:
            if frame[:4] == warc.FRAME:
                text = d.decompress(bytes(frame))
                assert text.startswith(b"WARC/1.1\r\n") and text.endswith(b"\r\n\r\n")
        # a plain reader sees one long stream of records
        n = d.stream_reader(data, read_across_frames=True).read().count(b"WARC/1.1\r\nWARC-Type")
        assert n == sum(f[:4] == warc.FRAME for _, f, _ in parts)


def record(headers=None, block=b"HTTP/1.1 200 OK\r\n\r\nbody", end=b"\r\n\r\n", version="WARC/1.0"):
    h = {"WARC-Type": "response", "WARC-Record-ID": "<urn:x:1>", "WARC-Date": "2020",
         "Content-Type": "application/http;msgtype=response", "Content-Length": str(len(block))}
    h |= headers or {}
    return (version + "\r\n" + "".join(f"{k}: {v}\r\n" for k, v in h.items() if v is not None)
            + "\r\n").encode() + block + end


def read(tmp_path, spark, data):
    p = tmp_path / "foreign"
    p.mkdir()
    (p / "x.warc.zst").write_bytes(data)
    return warc.read_archives(spark, str(p)).orderBy("offset").collect()


@pytest.mark.parametrize("compressed", [False, True])
def test_foreign_archives(spark, tmp_path, compressed):
    rng = random.Random(1)
    samples = [bytes(rng.choices(b"abcdefgh <p>", k=300)) for _ in range(200)]
    d = zstandard.train_dictionary(2048, samples)
    words = zstandard.ZstdCompressor().compress(d.as_bytes()) if compressed else d.as_bytes()
    # no content size in the frame, no checksum; folded and lower-case header lines
    c = zstandard.ZstdCompressor(dict_data=d, write_content_size=False)
    body = b"HTTP/1.1 200 OK\r\ncontent-length: 4\r\n\r\nbody"
    data = warc.DICTIONARY_FRAME + len(words).to_bytes(4, "little") + words
    for r in (record(block=body), record({"X-Long": "one\r\n two", "warc-target-uri": "u"})):
        o = c.compressobj()
        data += o.compress(r) + o.flush() + b"\x50\x2a\x4d\x18\x03\x00\x00\x00abc"
    rows = read(tmp_path, spark, data)
    assert [(r.payload, r.uri, r.error) for r in rows] == [
        (b"body", None, None), (b"body", "u", None)]


BAD = {
    "no WARC version line": record(version="WARC/9"),
    "missing header warc-date": record({"WARC-Date": None}),
    "record length differs from Content-Length": record({"Content-Length": "3"}),
    "malformed length": record({"Content-Length": "-1"}),
    "repeated header warc-type": record({"warc-type": "x"}),
    "malformed header line": record().replace(b"WARC-Date: ", b"WARC-Date "),
    "payload length differs from the HTTP header":
        record(block=b"HTTP/1.1 200 OK\r\nContent-Length: 9\r\n\r\nbody"),
    "no HTTP header": record(block=b"plain"),
    "payload digest differs": record({"WARC-Payload-Digest": "sha1:" + "A" * 32}),
    "block digest differs": record({"WARC-Block-Digest": "sha1:" + "A" * 32}),
    "header without end": b"WARC/1.0\r\nWARC-Type: x",
}


def test_damage_is_told_and_passed_over(spark, tmp_path):
    c = zstandard.ZstdCompressor(write_checksum=True)
    good = c.compress(record())
    bad = bytearray(c.compress(record(block=b"HTTP/1.1 200 OK\r\n\r\n" + b"xyz" * 50)))
    bad[-1] ^= 1                                     # the checksum
    data = good + b"".join(c.compress(r) for r in BAD.values()) + bytes(bad) + good
    rows = read(tmp_path, spark, data + good[:-9])
    errors = [r.error for r in rows]
    assert errors[0] is None and errors[1:1 + len(BAD)] == list(BAD)
    assert "checksum" in errors[-3] and errors[-2] is None and "truncated" in errors[-1]
    with pytest.raises(Exception, match="damaged record"):
        warc.pages_of(warc.read_archives(spark, str(tmp_path / "foreign"))).collect()


def test_garbage_ends_an_archive(spark, tmp_path):
    c = zstandard.ZstdCompressor()
    rows = read(tmp_path, spark, c.compress(record()) + b"garbage" + c.compress(record()))
    assert [r.error for r in rows] == [None, "not a frame"]


def test_query_matches_its_sql(spark):
    got, want, *_ = compare(spark, "op13_warc", "/root/testdata/sf0.001", QUERIES, ORACLES)
    assert got == want
