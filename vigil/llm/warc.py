"""WARC archives in Zstandard: one frame per record, the dictionary in a skippable frame at the front.

An archive is the bytes of one .warc.zst file. Spark has no sink for files of raw bytes, so the writer's archives are rows (name, content)
of a table in the shared folder, each of about ``ARCHIVE`` bytes; ``read`` takes such rows, or files of any store as
``spark.read.format("binaryFile")`` gives them. Payloads that are equal are stored once: the record with the smallest id is
the response, the others revisit it.

The reader checks the leading frame, the length of each frame, that a frame holds exactly one record, the version line, the header
fields, the block's length, the blank lines at its end, the HTTP head and the payload's digest. What fails a check is a row with an
``error`` and without a record; the rest of that archive is read as far as its frames can be told apart.

Defined cases: a null payload is empty; payloads shorter than ``least`` bytes are always responses; rows without an id take part
as if they had the smallest, and read back without one; equal rows are records each, all of them responses if they have
the smallest id; a null url is an empty one; other columns are ignored; an empty table gives no archives and no records.
"""

from __future__ import annotations

import base64
import hashlib
import re

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vigil.llm.common import NO_ID, as_bytes, own_id, short_batches, table
from vigil.llm.registry import query
from vigil.streaming.storage import written

ARCHIVE = 8 << 20
LEAST = 0
#: The dictionary is trained on the beginnings of so many payloads.
SAMPLES, SAMPLE_CHARS, DICTIONARY = 500, 8_192, 64 << 10

# fixed values: magic numbers of the formats
SKIPPABLE = 0x184D2A5D
FRAME = b"\x28\xb5\x2f\xfd"

VERSION = b"WARC/1.1"
DATE = "2026-01-01T00:00:00Z"
HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

FIELD = re.compile(rb"([!#$%&'*+.^_`|~0-9A-Za-z-]+):[ \t]*(.*)")


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def record(page_id: int, url: str, payload: bytes, refers_to: int | None) -> bytes:
    """A record: a response with the whole payload, or a revisit of another page's with the HTTP head only."""
    head = HTTP % len(payload)
    block = head if refers_to is not None else head + payload
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"), ("WARC-Record-ID", f"<urn:page:{page_id}>"), ("WARC-Date", DATE),
        ("WARC-Target-URI", re.sub(r"[\r\n]", lambda m: f"%{ord(m[0]):02X}", url)), ("Content-Type", "application/http; msgtype=response"),
        ("WARC-Payload-Digest", f"sha1:{digest(payload)}"), ("Content-Length", str(len(block))),
    ]
    if refers_to is not None:
        fields += [("WARC-Profile", REVISIT), ("WARC-Refers-To", f"<urn:page:{refers_to}>")]
    lines = b"".join(f"{k}: {v}\r\n".encode() for k, v in fields)
    return VERSION + b"\r\n" + lines + b"\r\n" + block + b"\r\n\r\n"


class Bad(ValueError):
    """A record or archive that fails a check."""


def parsed(data: bytes) -> dict:
    """The checked fields of a record."""
    head, gap, rest = data.partition(b"\r\n\r\n")
    lines = head.split(b"\r\n")
    if not gap or not re.fullmatch(rb"WARC/1\.[01]", lines[0]):
        raise Bad("no version line or header")
    fields: dict[str, str] = {}
    for line in lines[1:]:
        if not (m := FIELD.fullmatch(line)):
            raise Bad("a header line is no field")
        fields[m[1].decode().lower()] = m[2].decode("utf-8", "replace").strip()
    for name in ("warc-type", "warc-record-id", "warc-date", "content-length", "warc-payload-digest"):
        if name not in fields:
            raise Bad(f"no {name}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4:
        raise Bad("the block has another length")
    if rest[-4:] != b"\r\n\r\n":
        raise Bad("no blank lines at the end")
    http, gap, payload = rest[:-4].partition(b"\r\n\r\n")
    said = re.search(rb"\r\nContent-Length: (\d+)", http)
    if not gap or not http.startswith(b"HTTP/") or not said:
        raise Bad("no HTTP head")
    kind = fields["warc-type"]
    if kind not in ("response", "revisit"):
        raise Bad("another type of record")
    own, to = _page(fields["warc-record-id"]), None
    found = fields["warc-payload-digest"].removeprefix("sha1:")
    if kind == "response" and (len(payload) != int(said[1]) or digest(payload) != found):
        raise Bad("the payload is not the one that was written")
    if kind == "revisit":
        if payload or "warc-refers-to" not in fields:
            raise Bad("a revisit with a payload or without a reference")
        to = _page(fields["warc-refers-to"])
    return {
        "page_id": own, "url": fields.get("warc-target-uri"), "payload_bytes": int(said[1]), "payload_digest": found,
        "record_type": kind, "refers_to": to, "payload": payload if kind == "response" else None,
    }


def _page(uri: str) -> int:
    if not (m := re.fullmatch(r"<urn:page:(-?\d+)>", uri)):
        raise Bad("no page")
    return int(m[1])


def leading(dictionary: bytes) -> bytes:
    return SKIPPABLE.to_bytes(4, "little") + len(dictionary).to_bytes(4, "little") + dictionary


def unpacked(content: bytes) -> tuple[zstandard.ZstdDecompressor, int]:
    """A decoder with the archive's dictionary, and where the records begin."""
    if int.from_bytes(content[:4], "little") != SKIPPABLE or len(content) < 8:
        raise Bad("no dictionary at the front")
    end = 8 + int.from_bytes(content[4:8], "little")
    if end > len(content):
        raise Bad("the dictionary is cut off")
    found = content[8:end]
    if found[:4] == FRAME:  # it may be compressed itself
        found = zstandard.ZstdDecompressor().decompressobj().decompress(found)
    return zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(found)) if found else zstandard.ZstdDecompressor(), end


def frame_end(content: bytes, at: int) -> int:
    """Where the frame at ``at`` ends, from the sizes of its blocks."""
    if content[at : at + 4] != FRAME:
        raise Bad("no frame")
    try:
        start = content[at : at + 18]
        checksum = zstandard.get_frame_parameters(start).has_checksum
        place, last = at + zstandard.frame_header_size(start), 0
    except zstandard.ZstdError as e:
        raise Bad("a broken frame header") from e
    while not last:
        head = int.from_bytes(content[place : place + 3], "little")
        last, kind, size = head & 1, head >> 1 & 3, head >> 3
        place += 3 + (1 if kind == 1 else size)
        if kind == 3 or place > len(content):
            raise Bad("a frame is cut off")
    if place + 4 * checksum > len(content):
        raise Bad("a frame is cut off")
    return place + 4 * checksum


def records(content: bytes):
    """Each record of an archive as (fields, error)."""
    try:
        decoder, at = unpacked(content)
    except (Bad, zstandard.ZstdError) as e:
        yield None, str(e)
        return
    while at < len(content):
        try:
            end = frame_end(content, at)
        except Bad as e:
            yield None, str(e)
            return
        try:
            yield parsed(decoder.decompressobj().decompress(content[at:end])), None
        except (Bad, zstandard.ZstdError) as e:
            yield None, str(e)
        at = end


def trained(pages: DataFrame) -> bytes:
    """A dictionary from the beginnings of some pages; the fixed parts of a record where they are too few."""
    # ids first: each task offers so many rows
    chosen = [r.page_id for r in pages.select("page_id").orderBy(F.xxhash64("page_id"), "page_id").limit(SAMPLES).collect()]
    beginnings = pages.where(F.col("page_id").isin(chosen)).select("page_id", F.substring("html", 1, SAMPLE_CHARS).alias("x")).limit(SAMPLES)
    found = [record(r.page_id, "http://", r.x.encode(), None) for r in sorted(beginnings.collect())]
    try:
        return zstandard.train_dictionary(DICTIONARY, found).as_bytes()
    except zstandard.ZstdError:
        return record(0, "http://", b"", None) + record(0, "http://", b"", 0)


def archives(pages: DataFrame, least: int = LEAST) -> DataFrame:
    """``name`` and ``content`` of archives with a record per page. ``pages``: page_id, url, html."""
    short_batches(pages.sparkSession)
    rows = pages.select(
        F.coalesce(F.col("page_id").cast("long"), F.lit(NO_ID)).alias("page_id"), F.coalesce("url", F.lit("")).alias("url"), F.coalesce("html", F.lit("")).alias("html")
    )
    dictionary = trained(rows)
    rows = rows.withColumn("sha", F.sha1(F.col("html").cast("binary")))
    copies = rows.where(F.octet_length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1")
    # written, so that its size is known when the join is planned; copies of one payload share a row of it
    told = rows.join(written(copies.select("sha", "first"), "copies"), "sha", "left").select(
        "page_id", "url", "html", F.when((F.octet_length("html") >= least) & (F.col("first") != F.col("page_id")), F.col("first")).alias("to")
    )

    def pack(batches):
        coder = zstandard.ZstdCompressor(level=3, dict_data=zstandard.ZstdCompressionDict(dictionary), write_checksum=True)
        held, size, name = [], 0, ""
        for batch in batches:
            for page, url, html, to in zip(batch.column("page_id").to_pylist(), batch.column("url").to_pylist(), as_bytes(batch.column("html")), batch.column("to").to_pylist(), strict=True):
                frame = coder.compress(record(page, url, html, to))
                name = name or f"pages-{page}-{hashlib.sha1(frame).hexdigest()[:12]}.warc.zst"
                held.append(frame)
                size += len(frame)
                if size >= ARCHIVE:
                    yield archive(name, held)
                    held, size, name = [], 0, ""
        if held:
            yield archive(name, held)

    def archive(name, held):
        return pa.RecordBatch.from_arrays([pa.array([name]), pa.array([b"".join((leading(dictionary), *held))], pa.binary())], ["name", "content"])

    return told.mapInArrow(pack, "name string, content binary")


FIELDS = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, error string"


def read(files: DataFrame) -> DataFrame:
    """The records of archives (``content``), checked."""
    names = [x.split(" ")[0] for x in FIELDS.split(", ")]
    kinds = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    spark = files.sparkSession
    short_batches(spark)

    def unpack(batches):
        for batch in batches:
            for content in batch.column("content"):
                rows: list[tuple] = []
                for fields, error in records(content.as_py() or b""):
                    rows.append(tuple((fields or {}).get(n) for n in names[:-1]) + (error,))
                    if len(rows) == 200:
                        yield packed(rows)
                        rows = []
                if rows:
                    yield packed(rows)

    def packed(rows):
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    return files.select("content").mapInArrow(unpack, FIELDS)


@query("op4_warc_zstd")
def warc_zstd(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the archives of all pages hold, read back."""
    stored = written(archives(table(spark, sf_dir, "pages")), "archives")
    found = read(stored)
    back = F.when(F.col("refers_to") != NO_ID, F.col("refers_to")).alias("refers_to")
    return found.select(own_id("page_id"), "payload_bytes", "payload_digest", "record_type", back, "error")
