"""WARC archives in Zstandard: one frame a record, a dictionary in the leading skippable frame.

Writing: payloads are compared by SHA-256 and length, so texts move once, to their archive, and only
digests are grouped.  An archive is what one task writes through Spark's text writer, whose lines are
frames and whose line separator is an empty skippable frame, which readers of Zstandard pass over; so
archives go to any store that Spark can write, and a task that is run again leaves no second copy.
The dictionary is trained on a bounded sample of payloads (SAMPLE_PAGES, SAMPLE_BYTES of each) and
changes sizes alone.

Reading: an archive is one row of Spark's binary reader, and a task reads it record by record.  The
dictionary is loaded from the leading skippable frame (itself compressed or not), each frame is decoded
alone, and its record's version line, headers, lengths and digests are held against the block.
What fails is a row with a problem; a frame that cannot be decoded ends its archive.

Records: equal payloads of at least `min_bytes` bytes are one response, that of the smallest id (nulls
last), and revisits of it (identical-payload-digest), which hold the HTTP header alone.

Defined results: null content is empty; a null id is an id of its own, after all others; a null or empty
URL gives no WARC-Target-URI, and what may not stand in a header line is percent-encoded; of repeated
rows of the smallest id one is the response and the others revisit it; an empty table gives no
archive and no row.  Further columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import math
import re
import struct
import uuid

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import TEXT, bounded_batches, checkpointed, fitted, shared_folder, small_slices, table

ARCHIVE_BYTES = 64 << 20  # payload bytes of an archive, about; less where the session asks for more shuffle partitions
SAMPLE_PAGES, SAMPLE_BYTES, DICTIONARY_BYTES = 400, 1 << 15, 1 << 15
# Fixed values of the formats: magic numbers of the dictionary's frame, of the empty frame between records, and of a compressed dictionary.
DICTIONARY_MAGIC, EMPTY_FRAME, ZSTD_MAGIC = b"\x5d\x2a\x4d\x18", "\x50\x2a\x4d\x18\x00\x00\x00\x00", b"\x28\xb5\x2f\xfd"
VERSION, PROFILE = "WARC/1.1", "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
ID = "<urn:page:{}>"


def digest32(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def header_text(value: str) -> str:
    """The value as one header field: control characters and blanks are percent-encoded."""
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(kind: str, page, url: str | None, payload: bytes, date: str, refers_to=None) -> bytes:
    """A response, or a revisit, which leaves out the payload but not its length and digest."""
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http + payload if kind == "response" else http
    head = [VERSION, f"WARC-Type: {kind}", f"WARC-Record-ID: {ID.format(header_text(str(page)))}", f"WARC-Date: {date}"]
    if url:
        head.append(f"WARC-Target-URI: {header_text(url)}")
    if kind == "revisit":
        head += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {ID.format(header_text(str(refers_to)))}"]
    head += [f"WARC-Payload-Digest: sha1:{digest32(payload)}", f"WARC-Block-Digest: sha1:{digest32(block)}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def dictionary_frame(dictionary: bytes) -> bytes:
    held = zstandard.ZstdCompressor(level=10).compress(dictionary)
    return DICTIONARY_MAGIC + struct.pack("<I", len(held)) + held


def leading_dictionary(archive: bytes) -> tuple[bytes | None, int]:
    """(the dictionary or none, where the frames begin)."""
    if archive[:4] != DICTIONARY_MAGIC:
        return None, 0
    size = struct.unpack("<I", archive[4:8])[0]
    held = archive[8 : 8 + size]
    if len(held) < size:
        raise ValueError("the dictionary's frame is cut off")
    return zstandard.ZstdDecompressor().decompressobj().decompress(held) if held[:4] == ZSTD_MAGIC else held, 8 + size


def frames(archive: bytes):
    """(offset, content) of each frame that is not skippable."""
    dictionary, at = leading_dictionary(archive)
    decoder = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(dictionary)) if dictionary else zstandard.ZstdDecompressor()
    view, step = memoryview(archive), 1 << 16
    while at < len(archive):
        if archive[at + 1 : at + 4] == b"\x2a\x4d\x18" and archive[at] >> 4 == 5:  # skippable
            at += 8 + struct.unpack("<I", archive[at + 4 : at + 8].ljust(4, b"\0"))[0]
            continue
        frame, begin, out = decoder.decompressobj(), at, []
        while not frame.eof:
            if at >= len(archive):
                raise ValueError(f"the frame at {begin} is cut off")
            part = view[at : at + step]
            out.append(frame.decompress(part))
            at += len(part) - len(frame.unused_data)
        yield begin, b"".join(out)


def headers_of(raw: bytes) -> dict[str, str]:
    out: dict[str, str] = {}
    for line in raw.decode("utf-8", "replace").split("\r\n"):
        name, colon, value = line.partition(":")
        if not colon or not re.fullmatch(r"[!-9;-~]+", name):
            raise ValueError(f"no header line: {line[:80]!r}")
        if name.lower() in out:
            raise ValueError(f"two headers {name}")
        out[name.lower()] = value.strip()
    return out


def length_in(headers: dict[str, str], of: str) -> int:
    value = headers.get("content-length", "")
    if not re.fullmatch(r"[0-9]+", value):
        raise ValueError(f"no length of {of}: {value[:40]!r}")
    return int(value)


def parsed(raw: bytes) -> dict:
    """The record of a frame; ValueError says what is wrong with it."""
    head, gap, rest = raw.partition(b"\r\n\r\n")
    version, _, fields = head.partition(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", version):
        raise ValueError(f"no WARC record: {raw[:40]!r}")
    h = headers_of(fields)
    if missing := {"warc-type", "warc-record-id", "warc-date"} - set(h):
        raise ValueError(f"headers missing: {sorted(missing)}")
    size = length_in(h, "the block")
    if len(rest) != size + 4 or rest[size:] != b"\r\n\r\n":
        raise ValueError(f"a block of {max(0, len(rest) - 4)} bytes, {size} announced")
    block, kind = rest[:size], h["warc-type"]
    said = lambda name: (h.get(name) or "").removeprefix("sha1:")
    if said("warc-block-digest") and said("warc-block-digest") != digest32(block):
        raise ValueError("the block's digest differs")
    out = {"record_type": kind, "record_id": h["warc-record-id"], "url": h.get("warc-target-uri"), "refers_to": h.get("warc-refers-to"), "payload_bytes": None, "payload_digest": None, "payload": None}
    if kind in ("response", "revisit") and h.get("content-type", "").startswith("application/http"):
        top, gap, payload = block.partition(b"\r\n\r\n")
        status, _, fields = top.partition(b"\r\n")
        if not gap or not status.startswith(b"HTTP/"):
            raise ValueError("no HTTP header")
        size = length_in(headers_of(fields), "the payload")
        if kind == "response":
            if len(payload) != size:
                raise ValueError(f"a payload of {len(payload)} bytes, {size} announced")
            if said("warc-payload-digest") not in ("", digest32(payload)):
                raise ValueError("the payload's digest differs")
            out |= {"payload_bytes": size, "payload_digest": digest32(payload), "payload": payload}
        else:
            if payload:
                raise ValueError("a revisit with a payload")
            if not said("warc-payload-digest") or not out["refers_to"]:
                raise ValueError("a revisit that says neither of what nor of which digest")
            out |= {"payload_bytes": size, "payload_digest": said("warc-payload-digest")}
    return out


def trained_dictionary(pages: DataFrame, html_col: str) -> bytes:
    """Trained by one task on the starts of a bounded sample of payloads; empty where they are too few."""
    text = F.col(f"`{html_col}`").cast("string").cast("binary")
    sample = pages.select(F.substring(text, 1, SAMPLE_BYTES).alias("t")).where("length(t) > 0").select("t", F.xxhash64("t").alias("h")).orderBy("h", "t").limit(SAMPLE_PAGES).select("t")

    def fit(rows):
        texts = rows.column("t").to_pylist()
        try:
            return zstandard.train_dictionary(min(DICTIONARY_BYTES, sum(map(len, texts)) // 8), texts).as_bytes()
        except zstandard.ZstdError:
            return b""

    return fitted(sample, fit)


def write_archives(pages: DataFrame, path: str, id_col: str = "page_id", url_col: str = "url", html_col: str = "html", min_bytes: int = 0, archive_bytes: int = ARCHIVE_BYTES, date: str = "2024-01-01T00:00:00Z", level: int = 3) -> None:
    """Write all pages as archives in a new folder `path`; a row gives a record."""
    bounded_batches(pages.sparkSession)
    content = F.coalesce(F.col(f"`{html_col}`").cast("string"), F.lit("")).cast("binary")
    rows = pages.select(F.col(f"`{id_col}`").alias("id"), F.col(f"`{url_col}`").cast("string").alias("url"), content.alias(TEXT))
    rows = rows.withColumn("digest", F.concat(F.sha2(TEXT, 256), F.lit("-"), F.length(TEXT)))
    key = F.coalesce(F.concat(F.lit("="), F.col("id").cast("string")), F.lit("-"))
    rows = rows.withColumn("key", key)
    keys = checkpointed(rows.select("id", "key", "digest", F.length(TEXT).cast("long").alias("bytes")))
    rank = F.struct(F.col("id").isNull().alias("none"), "id", "key")
    first = keys.where(F.col("bytes") >= min_bytes).groupBy("digest").agg(F.min(rank).alias("first"), F.count("*").alias("n")).where("n > 1").select("digest", "first")
    revisits = keys.join(first, "digest").select("key", "digest", F.col("first.key").alias("target")).distinct()
    n = max(1, math.ceil((keys.agg(F.sum("bytes")).first()[0] or 0) / archive_bytes))
    dealt = rows.repartition(n, "key", "digest").join(revisits.repartition(n, "key", "digest"), ["key", "digest"], "left")
    ordered = dealt.select("key", "digest", "target", "url", TEXT).sortWithinPartitions("key", "digest", F.col("url").asc_nulls_first())
    dictionary = trained_dictionary(pages, html_col)

    def run(batches):
        data = zstandard.ZstdCompressionDict(dictionary) if dictionary else None
        encoder = zstandard.ZstdCompressor(level=level, dict_data=data, write_checksum=True)
        opened, last = not dictionary, None
        for batch in batches:
            for part in small_slices(batch, TEXT):
                made = []
                if not opened:
                    made.append(dictionary_frame(dictionary))
                    opened = True
                for key, digest, target, url, payload in zip(*(part.column(c).to_pylist() for c in ("key", "digest", "target", "url", TEXT)), strict=True):
                    own = target is None or target == key and last != (key, digest)
                    last = (key, digest)
                    made.append(encoder.compress(record("response" if own else "revisit", key[1:], url, payload, date, None if own else target[1:])))
                yield pa.RecordBatch.from_arrays([pa.array(made, pa.binary())], names=["frame"])

    ordered.mapInArrow(run, "frame binary").select(F.col("frame").cast("string").alias("value")).write.option("lineSep", EMPTY_FRAME).text(path)


def read_archives(spark: SparkSession, path: str) -> DataFrame:
    """A row a record: (archive, offset, record_type, record_id, url, refers_to, payload_bytes, payload_digest, payload, problem)."""
    bounded_batches(spark)
    files = spark.read.format("binaryFile").load(path).select("path", "content")
    schema = pa.schema([("archive", pa.string()), ("offset", pa.int64()), ("record_type", pa.string()), ("record_id", pa.string()), ("url", pa.string()), ("refers_to", pa.string()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("payload", pa.binary()), ("problem", pa.string())])

    def run(batches):
        for batch in batches:
            for name, archive in zip(batch.column("path"), batch.column("content"), strict=True):
                held, size = [], 0
                name, found = name.as_py(), frames(archive.as_py())
                while True:
                    try:
                        at, raw = next(found)
                    except StopIteration:
                        break
                    except (ValueError, struct.error, zstandard.ZstdError) as wrong:  # the frames after it can't be found
                        held.append({"archive": name, "problem": str(wrong)})
                        break
                    try:
                        held.append({"archive": name, "offset": at} | parsed(raw))
                    except ValueError as wrong:
                        held.append({"archive": name, "offset": at, "problem": str(wrong)})
                    size += len(raw)
                    if size >= 1 << 20:
                        yield pa.RecordBatch.from_pylist(held, schema)
                        held, size = [], 0
                yield pa.RecordBatch.from_pylist(held, schema)

    kinds = "archive string, offset long, record_type string, record_id string, url string, refers_to string, payload_bytes long, payload_digest string, payload binary, problem string"
    return files.mapInArrow(run, kinds)


def op12_warc(spark, sf_dir):
    path = f"{shared_folder(spark)}/archives-{uuid.uuid4().hex}"
    write_archives(table(spark, sf_dir, "pages").select("page_id", "url", "html"), path)
    got = read_archives(spark, path)
    page = lambda c: F.expr(f"cast(nullif(regexp_extract({c}, '^<urn:page:(.*)>$', 1), '') as long)")
    sound = F.when(F.col("problem").isNull(), F.col("record_type")).otherwise(F.raise_error(F.concat("archive", F.lit(": "), "problem")))
    return got.select(page("record_id").alias("page_id"), "payload_bytes", "payload_digest", sound.alias("record_type"), page("refers_to").alias("refers_to"))


OP12_SQL = """
with p as (select page_id, coalesce(html, '') as h from pages),
g as (select page_id, strlen(h)::bigint as payload_bytes, sha1(h) as hex, min(page_id) over (partition by h) as first from p)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[1 + ((('0x' || hex[(i // 4) * 5 + 1:(i // 4) * 5 + 5])::bigint >> (15 - 5 * (i % 4))) & 31)]), '') as payload_digest,
  case when first = page_id then 'response' else 'revisit' end as record_type, case when first <> page_id then first end as refers_to
from g
"""
