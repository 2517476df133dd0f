"""WARC archives of web pages, compressed with Zstandard and a dictionary.

An archive is a skippable frame with the dictionary, then one frame per record,
so that any record can be read alone. Tasks build archives of bounded size; Spark's text
writer puts each into a file of its own, whole or not at all, in whatever store
the path is in. (It ends a file with its line separator: an empty skippable
frame, which Zstandard readers pass over.)

Of pages with equal payloads the one with the largest page_id is stored whole,
the others are ``revisit`` records that refer to it. Which is which comes from
a grouped maximum by SHA-256 and a join back; payloads that occur once take no
part in it, and a payload that a third of all pages share is split by adaptive
execution. Rows are told apart by where they are stored, not by page_id: of
rows with one page_id and payload one is the response (any, they differ in
their url at most).

The reader takes archives of other origin, too. It walks the frames by their
block headers, decodes each by itself and checks the version line, the
mandatory headers, block and payload lengths and the digests. A damaged record
is a row with ``error``; the records after it are read if its frame's end is
known. A null html is an empty payload, a null url or page_id has no header.
"""

from __future__ import annotations

import base64
import hashlib
import uuid
from collections.abc import Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from evtide.llm.common import bound_batches, materialise
from evtide.session import scratch_path
from evtide.shipping import ship_package

#: An archive is closed when it has so many bytes (one record may be larger).
ARCHIVE_BYTES = 16 << 20
#: The dictionary is trained on the first characters of so many pages at most;
#: only the size of the archives depends on it.
SAMPLE_PAGES, SAMPLE_CHARS, DICTIONARY_BYTES = 400, 8192, 32 << 10
LEVEL = 3

# Frame types of Zstandard (RFC 8878) and of .warc.zst files.
FRAME = b"\x28\xb5\x2f\xfd"
DICTIONARY_FRAME = b"\x5d\x2a\x4d\x18"
EMPTY_FRAME = "P*M\x18\x00\x00\x00\x00"
VERSIONS = (b"WARC/1.0", b"WARC/1.1")
MANDATORY = ("warc-type", "warc-record-id", "warc-date", "content-length")
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

#: A frame that says it holds more than this is taken for damaged.
MAX_RECORD = 1 << 31
RECORD = ("archive string, offset bigint, record_type string, record_id string, date string, "
          "uri string, page_id bigint, payload_digest string, payload_bytes bigint, "
          "refers_to string, payload binary, error string")
_ARROW = pa.schema([(c, {"string": pa.string(), "bigint": pa.int64(), "binary": pa.binary()}[t])
                    for c, t in (f.split() for f in RECORD.split(", "))])


def sha1_base32(data: bytes) -> str:
    return base64.b32encode(hashlib.sha1(data).digest()).decode()


# ---------------------------------------------------------------- writing
def train_dictionary(pages: DataFrame) -> bytes:
    """A dictionary of a bounded sample; empty if there is too little to train on."""
    heads = (pages.select(F.substring("html", 1, SAMPLE_CHARS).alias("h"))
             .where(F.length("h") > 0).limit(SAMPLE_PAGES).collect())
    try:
        return zstandard.train_dictionary(DICTIONARY_BYTES, [r.h.encode() for r in heads],
                                          k=200, d=8).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def _record(kind: str, record_id: str, date: str, headers: list[tuple[str, str]],
            block: bytes) -> bytes:
    lines = [("WARC-Type", kind), ("WARC-Record-ID", f"<urn:uuid:{uuid.UUID(record_id)}>"),
             ("WARC-Date", date), *headers,
             ("WARC-Block-Digest", f"sha1:{sha1_base32(block)}"), ("Content-Length", len(block))]
    head = "".join(f"{k}: {v}\r\n" for k, v in lines)
    return b"WARC/1.1\r\n" + head.encode() + b"\r\n" + block + b"\r\n\r\n"


def _uri(url: str) -> str:
    """A header holds no line ends."""
    return url.strip().replace("\r", "%0D").replace("\n", "%0A")


def page_record(row: dict, date: str) -> bytes:
    """The response or revisit record of a page."""
    digest = "sha1:" + base64.b32encode(bytes.fromhex(row["sha1"])).decode()
    headers = [] if row["url"] is None else [("WARC-Target-URI", _uri(row["url"]))]
    if row["page_id"] is not None:
        headers.append(("X-Page-ID", str(row["page_id"])))
    headers += [("WARC-Payload-Digest", digest),
                ("Content-Type", "application/http; msgtype=response")]
    block = ("HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n"
             f"Content-Length: {row['n_bytes']}\r\n\r\n").encode()
    if row["refers_to"] is None:
        return _record("response", row["record_id"], date, headers, block + row["payload"])
    headers += [("WARC-Profile", PROFILE),
                ("WARC-Refers-To", f"<urn:uuid:{uuid.UUID(row['refers_to'])}>"),
                ("WARC-Refers-To-Date", date)]
    if row["refers_url"] is not None:
        headers.append(("WARC-Refers-To-Target-URI", _uri(row["refers_url"])))
    return _record("revisit", row["record_id"], date, headers, block)


def _archives(batches: Iterator[pa.RecordBatch], dictionary: bytes, date: str,
              limit: int) -> Iterator[pa.RecordBatch]:
    """A partition's pages as archives, one a row."""
    options = {"level": LEVEL, "write_checksum": True, "write_content_size": True}
    if dictionary:
        d = zstandard.ZstdCompressionDict(dictionary)
        d.precompute_compress(level=LEVEL)
        options["dict_data"] = d
    compress = zstandard.ZstdCompressor(**options).compress
    start = [DICTIONARY_FRAME + len(dictionary).to_bytes(4, "little") + dictionary]
    start = start if dictionary else []

    def closed(frames):
        return pa.RecordBatch.from_arrays([pa.array([b"".join(start + frames)], pa.binary())],
                                          names=["archive"])
    frames, size = [], 0
    for b in batches:
        for row in b.to_pylist():
            if not frames:
                info = b"software: evtide\r\nformat: WARC File Format 1.1\r\n"
                frames = [compress(_record(
                    "warcinfo", hashlib.md5(b"info:" + row["record_id"].encode()).hexdigest(),
                    date, [("Content-Type", "application/warc-fields")], info))]
                size = len(frames[0])
            frames.append(compress(page_record(row, date)))
            size += len(frames[-1])
            if size >= limit:
                yield closed(frames)
                frames, size = [], 0
    if frames:
        yield closed(frames)


def with_first_copies(pages: DataFrame, key: Column) -> DataFrame:
    """Pages with their payload's digests and, where another row of the same
    payload is the response, that row's record id and url."""
    payload = F.coalesce("html", F.lit("")).cast("binary")
    rows = pages.select(
        F.col("page_id").cast("bigint").alias("page_id"), "url", F.md5(
            key.cast("string").cast("binary")).alias("record_id"),
        payload.alias("payload")).withColumn("sha256", F.unhex(F.sha2("payload", 256)))
    repeated = (rows.groupBy("sha256")
                .agg(F.max(F.struct("page_id", "record_id", "url")).alias("first"),
                     F.count(F.lit(1)).alias("n")).where("n > 1")
                # nearly all payloads may be single: then this table is small, and
                # Spark, which knows its size once it is written, broadcasts it
                .select("sha256", F.col("first.record_id").alias("refers_to"),
                        F.col("first.url").alias("refers_url")))
    repeated = materialise(repeated, "repeated-payloads")
    copy = F.col("refers_to") != F.col("record_id")
    return rows.join(repeated, "sha256", "left").select(
        "page_id", "url", "record_id", F.sha1("payload").alias("sha1"),
        F.octet_length("payload").cast("bigint").alias("n_bytes"),
        F.when(copy, F.col("refers_to")).alias("refers_to"),
        F.when(copy, F.col("refers_url")).alias("refers_url"),
        F.when(~F.coalesce(copy, F.lit(False)), F.col("payload")).alias("payload"))


def write_archives(pages: DataFrame, path: str, key: Column | None = None,
                   date: str = "2024-01-01T00:00:00Z", limit: int = ARCHIVE_BYTES) -> None:
    """Write pages (page_id, url, html) as archives under ``path``.

    ``key`` tells rows apart and is the same whenever the table is read (its
    place in a file, say); without one the rows are written down first.
    """
    spark = pages.sparkSession
    ship_package(spark)
    bound_batches(spark)
    if key is None:
        pages = materialise(pages.select("page_id", "url", "html"), "pages")
        key = stored_place(pages)
    dictionary = train_dictionary(pages)
    rows = with_first_copies(pages, key)
    (rows.mapInArrow(lambda it: _archives(it, dictionary, date, limit), "archive binary")
     .select(F.col("archive").cast("string").alias("value"))
     .write.option("maxRecordsPerFile", 1).option("lineSep", EMPTY_FRAME).text(path))


def stored_place(table: DataFrame) -> Column:
    """Where a row of a table read from Parquet is stored."""
    place = table.metadataColumn("_metadata")
    return F.concat_ws("#", place["file_path"], place["row_index"].cast("string"))


# ---------------------------------------------------------------- reading
def frame_end(data: memoryview, at: int) -> int:
    """The end of the frame that begins at ``at``, by its block headers."""
    p = zstandard.get_frame_parameters(data[at:at + 18])
    here = at + zstandard.frame_header_size(data[at:at + 18])
    while True:
        if here + 3 > len(data):
            raise ValueError("truncated frame")
        block = int.from_bytes(data[here:here + 3], "little")
        last, kind, size = block & 1, block >> 1 & 3, block >> 3
        if kind == 3:
            raise ValueError("reserved block type")
        here += 3 + (1 if kind == 1 else size)
        if last:
            here += 4 if p.has_checksum else 0
            if here > len(data):
                raise ValueError("truncated frame")
            return here


def frames(data: memoryview) -> Iterator[tuple[int, memoryview | None, str | None]]:
    """(offset, frame, error) of every frame, the skippable ones included."""
    at = 0
    while at < len(data):
        try:
            if data[at:at + 4] == FRAME:
                end = frame_end(data, at)
            elif (len(data) >= at + 8 and data[at] >> 4 == 5
                  and data[at + 1:at + 4] == DICTIONARY_FRAME[1:]):
                end = at + 8 + int.from_bytes(data[at + 4:at + 8], "little")
                if end > len(data):
                    raise ValueError("truncated skippable frame")
            else:
                raise ValueError("not a frame")
        except (ValueError, zstandard.ZstdError) as e:
            yield at, None, str(e)
            return
        yield at, data[at:end], None
        at = end


def _decompress(decoder: zstandard.ZstdDecompressor, frame: memoryview) -> bytes:
    """A frame's content, whether or not its header states the size."""
    size = zstandard.frame_content_size(frame)
    if size < 0:
        return decoder.decompressobj().decompress(frame)
    if size > MAX_RECORD:
        raise ValueError("record too large")
    return decoder.decompress(frame)


def _headers(head: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    name = None
    for line in head.split(b"\r\n") if head else ():
        if line[:1] in (b" ", b"\t") and name:      # a folded line goes on
            out[name] += " " + line.strip().decode()
            continue
        k, colon, v = line.partition(b":")
        if not colon or not k or k != k.strip():
            raise ValueError("malformed header line")
        name = k.decode().lower()
        if name in out and name in MANDATORY:
            raise ValueError(f"repeated header {name}")
        out[name] = v.strip().decode()
    return out


def _length(text: str) -> int:
    if not (text.isascii() and text.isdigit()):
        raise ValueError("malformed length")
    return int(text)


def _check_digest(stated: str | None, data: bytes, what: str) -> None:
    if stated and stated.lower().startswith("sha1:") and stated[5:].upper() != sha1_base32(data):
        raise ValueError(f"{what} digest differs")


def parse_record(record: bytes, payload_too: bool) -> dict:
    """The fields of one record; ValueError says what is wrong with it."""
    head, blank, rest = record.partition(b"\r\n\r\n")
    version, _, lines = head.partition(b"\r\n")
    if version not in VERSIONS:
        raise ValueError("no WARC version line")
    if not blank:
        raise ValueError("header without end")
    h = _headers(lines)
    missing = [m for m in MANDATORY if not h.get(m)]
    if missing:
        raise ValueError(f"missing header {missing[0]}")
    n = _length(h["content-length"])
    block = rest[:n]
    if len(block) != n or rest[n:] != b"\r\n\r\n":
        raise ValueError("record length differs from Content-Length")
    _check_digest(h.get("warc-block-digest"), block, "block")
    kind, payload = h["warc-type"], block
    if h.get("content-type", "").replace(" ", "").startswith("application/http"):
        http, blank, payload = block.partition(b"\r\n\r\n")
        if not blank or not http.startswith(b"HTTP/"):
            raise ValueError("no HTTP header")
        stated = _headers(http.partition(b"\r\n")[2]).get("content-length")
        if kind == "response" and stated is not None and _length(stated) != len(payload):
            raise ValueError("payload length differs from the HTTP header")
    digest = h.get("warc-payload-digest")
    if kind != "revisit":
        _check_digest(digest, payload, "payload")
    whole = kind in ("response", "resource", "conversion")
    page = h.get("x-page-id")
    return {"record_type": kind, "record_id": h["warc-record-id"], "date": h["warc-date"],
            "uri": h.get("warc-target-uri"), "page_id": None if page is None else int(page),
            "payload_digest": digest.partition(":")[2] if digest else
            sha1_base32(payload) if whole else None,
            "payload_bytes": len(payload) if whole else None,
            "refers_to": h.get("warc-refers-to"),
            "payload": payload if whole and payload_too else None, "error": None}


def archive_records(path: str, content: bytes, payload_too: bool) -> Iterator[dict]:
    """Every record of an archive, damaged ones with their ``error``."""
    decoder = zstandard.ZstdDecompressor()
    none = dict.fromkeys(_ARROW.names)
    for at, frame, error in frames(memoryview(content)):
        place = none | {"archive": path, "offset": at}
        if error:
            yield place | {"error": error}
        elif frame[:4] == DICTIONARY_FRAME and at == 0:
            try:
                words = bytes(frame[8:])
                if words[:4] == FRAME:              # the dictionary itself may be compressed
                    words = _decompress(decoder, words)
                decoder = zstandard.ZstdDecompressor(
                    dict_data=zstandard.ZstdCompressionDict(words))
            except (ValueError, zstandard.ZstdError) as e:
                yield place | {"error": f"dictionary: {e}"}
        elif frame[:4] == FRAME:
            try:
                yield place | parse_record(_decompress(decoder, frame), payload_too)
            except (ValueError, zstandard.ZstdError) as e:
                yield place | {"error": str(e)}


def read_archives(spark: SparkSession, path: str, payload_too: bool = True) -> DataFrame:
    """(archive, offset, record_type, record_id, date, uri, page_id,
    payload_digest, payload_bytes, refers_to, payload, error): one row per
    record of the archives under ``path``. A task holds one archive at a time."""
    ship_package(spark)
    bound_batches(spark)

    def read(batches):
        for b in batches:
            for name, content in zip(b.column(0), b.column(1)):
                rows, size = [], 0
                for r in archive_records(name.as_py(), content.as_py(), payload_too):
                    rows.append(r)
                    size += len(r["payload"] or b"")
                    if size > ARCHIVE_BYTES or len(rows) >= 10_000:
                        yield pa.RecordBatch.from_pylist(rows, _ARROW)
                        rows, size = [], 0
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, _ARROW)
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    return files.where("length > 0").select("path", "content").mapInArrow(read, RECORD)


def pages_of(records: DataFrame) -> DataFrame:
    """Page rows of records: page_id, payload_bytes, payload_digest, record_type
    and, for revisits, refers_to (the page of the response they refer to, which
    also tells their size). Fails on a damaged record or a lost response."""
    sound = F.when(F.col("error").isNull(), F.col("record_type")).otherwise(F.raise_error(
        F.concat(F.lit("damaged record in "), "archive", F.lit(": "), "error")))
    records = materialise(records.withColumn("record_type", sound).select(
        "record_type", "record_id", "page_id", "payload_bytes", "payload_digest",
        "refers_to"), "records")
    responses = records.where("record_type = 'response'")
    to = responses.select(F.col("record_id").alias("refers_to"),
                          F.col("page_id").alias("to_page"), F.col("payload_bytes").alias("size"),
                          F.col("payload_digest").alias("digest"))
    found = F.when(F.col("digest") == F.col("payload_digest"), F.col("size")).otherwise(
        F.raise_error(F.concat(F.lit("no response for revisit "), "record_id")))
    revisits = (records.where("record_type = 'revisit'").drop("payload_bytes")
                .join(to, "refers_to", "left")
                .select("page_id", found.cast("bigint").alias("payload_bytes"), "payload_digest",
                        "record_type", F.col("to_page").alias("refers_to")))
    return responses.select("page_id", "payload_bytes", "payload_digest", "record_type",
                            F.lit(None).cast("bigint").alias("refers_to")).unionByName(revisits)


def round_trip(pages: DataFrame, key: Column | None = None) -> DataFrame:
    """``pages`` written as archives in the shared folder and read back."""
    path = scratch_path(pages.sparkSession, "archives")
    write_archives(pages, path, key)
    return pages_of(read_archives(pages.sparkSession, path, payload_too=False))
