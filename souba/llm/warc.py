"""WARC archives compressed with Zstandard: one frame per record, the dictionary in a leading skippable frame.

Archives are rows of a table in storage that Spark reaches (``archive``, ``records``, ``content``); ``write_archives``
cuts them at a size limit, so no task holds more than one. Real ``.warc.zst`` files come in through
``spark.read.format("binaryFile")`` with the content column renamed. Reading finds each frame's end from its block
headers, decodes one frame per record and checks headers and lengths.
"""

from __future__ import annotations

import base64
import hashlib
import re
import struct
from collections.abc import Callable, Iterator

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DICTIONARY_MAGIC = 0x184D2A5D      # skippable frame that holds the dictionary
FRAME_MAGIC = 0xFD2FB528
ARCHIVE_BYTES = 8 << 20            # of records before compression
DICTIONARY_BYTES = 32 << 10
SAMPLE_BYTES = 2 << 20             # of an archive's first records, to train its dictionary
DATE = "2024-01-01T00:00:00Z"
ID = "urn:souba:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

ARCHIVE_SCHEMA = "archive string, records bigint, content binary"
RECORD_SCHEMA = ("page_id bigint, payload_bytes bigint, payload_digest string, record_type string, refers_to bigint, "
                 "target_uri string, payload binary, error string")


def payload_digest(payload: bytes) -> str:
    """Bare upper-case base32 of the SHA-1."""
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


def plan_records(pages: DataFrame, least_bytes: int = 0) -> DataFrame:
    """Which pages become responses and which revisits: ``page_id, url, payload, digest (hex), refers_to, revisit``.

    The payload is the html in UTF-8, null counting as empty. Of pages with equal payloads of at least
    ``least_bytes`` the one with the smallest page_id is the response (null ids are larger than all; rows that repeat
    that id are responses too), the others revisit it. Counting is by digest alone; payloads move once.
    """
    paid = pages.select("page_id", "url", F.coalesce(F.encode("html", "UTF-8"), F.encode(F.lit(""), "UTF-8")).alias("payload"))
    paid = paid.withColumn("digest", F.sha1("payload"))
    firsts = paid.filter(F.octet_length("payload") >= least_bytes).groupBy("digest").agg(
        F.min("page_id").alias("first"), F.count("*").alias("n")).filter("n > 1").drop("n")
    joined = paid.join(firsts, "digest", "left")
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    return joined.select("page_id", "url", "payload", "digest", F.when(revisit, F.col("first")).alias("refers_to"), revisit.alias("revisit"))


def _id(page_id: int | None) -> str:
    return f"<{ID}{'null' if page_id is None else page_id}>"


def record_bytes(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, revisit: bool) -> bytes:
    """One WARC/1.1 record; ``digest`` is bare base32. A revisit keeps the HTTP header, whose length is the payload's."""
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    block = http if revisit else http + payload
    lines = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: {_id(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        lines.append("WARC-Target-URI: " + re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", url))
    lines += [f"WARC-Payload-Digest: sha1:{digest}", f"WARC-Block-Digest: sha1:{payload_digest(block)}", "Content-Type: application/http; msgtype=response"]
    if revisit:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: {_id(refers_to)}"]
    lines.append(f"Content-Length: {len(block)}")
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def pack(records: list[bytes]) -> bytes:
    """One archive: the dictionary's skippable frame, then a frame per record. Too few records train no dictionary;
    the leading frame is then empty."""
    sample, taken = [], 0
    for r in records:
        if taken + len(r) > SAMPLE_BYTES and sample:
            break
        sample.append(r[:128 << 10])
        taken += len(r)
    try:
        trained = zstandard.train_dictionary(DICTIONARY_BYTES, sample, level=3).as_bytes() if len(sample) >= 8 else b""
    except zstandard.ZstdError:
        trained = b""
    given = {"dict_data": zstandard.ZstdCompressionDict(trained)} if trained else {}
    pack_one = zstandard.ZstdCompressor(level=3, write_checksum=True, **given)
    return b"".join([struct.pack("<II", DICTIONARY_MAGIC, len(trained)), trained, *map(pack_one.compress, records)])


def frame_end(content: memoryview, at: int) -> int:
    """Where the Zstandard frame that starts at ``at`` ends, from its header and block headers."""
    if len(content) < at + 6 or struct.unpack_from("<I", content, at)[0] != FRAME_MAGIC:
        raise ValueError(f"no frame at byte {at}")
    flags = content[at + 4]
    single, checksum = flags >> 5 & 1, flags >> 2 & 1
    size_bytes = (1 if single else 0, 2, 4, 8)[flags >> 6]
    pos = at + 5 + (not single) + (0, 1, 2, 4)[flags & 3] + size_bytes
    while True:
        if pos + 3 > len(content):
            raise ValueError(f"frame at byte {at} is cut off")
        head = int.from_bytes(content[pos:pos + 3], "little")
        kind, size = head >> 1 & 3, head >> 3
        if kind == 3:
            raise ValueError(f"reserved block type at byte {pos}")
        pos += 3 + (1 if kind == 1 else size)
        if head & 1:
            break
    pos += 4 * checksum
    if pos > len(content):
        raise ValueError(f"frame at byte {at} is cut off")
    return pos


def unpack(content: bytes) -> Iterator[bytes]:
    """The records of one archive; ValueError where a frame is damaged. Other skippable frames are passed over."""
    view, at, given = memoryview(content), 0, {}
    if len(view) >= 8 and struct.unpack_from("<I", view, 0)[0] == DICTIONARY_MAGIC:
        size = struct.unpack_from("<I", view, 4)[0]
        if 8 + size > len(view):
            raise ValueError("the dictionary is cut off")
        raw, at = bytes(view[8:8 + size]), 8 + size
        if raw[:4] == struct.pack("<I", FRAME_MAGIC):       # the dictionary may itself be compressed
            raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
        given = {"dict_data": zstandard.ZstdCompressionDict(raw)} if raw else {}
    open_one = zstandard.ZstdDecompressor(**given)
    while at < len(view):
        if len(view) >= at + 8 and struct.unpack_from("<I", view, at)[0] & 0xFFFFFFF0 == 0x184D2A50:
            at += 8 + struct.unpack_from("<I", view, at + 4)[0]
            continue
        end = frame_end(view, at)
        try:
            yield open_one.decompressobj().decompress(bytes(view[at:end]))
        except zstandard.ZstdError as e:
            raise ValueError(f"frame at byte {at}: {e}") from e
        at = end


def parse_record(raw: bytes) -> dict[str, object]:
    """One record's fields; ValueError where headers, lengths or digests are wrong."""
    head, found, rest = raw.partition(b"\r\n\r\n")
    lines = head.decode("utf-8", "replace").split("\r\n")
    if not found or not re.fullmatch(r"WARC/1\.[01]", lines[0]):
        raise ValueError("no WARC header")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines[1:])}
    missing = {"warc-type", "warc-record-id", "warc-date", "content-length"} - set(fields)
    if missing:
        raise ValueError(f"header without {sorted(missing)}")
    if not fields["content-length"].isdigit() or len(rest) != int(fields["content-length"]) + 4 or not rest.endswith(b"\r\n\r\n"):
        raise ValueError("Content-Length is not the block's length")
    block = rest[:-4]
    if "warc-block-digest" in fields and fields["warc-block-digest"] != "sha1:" + payload_digest(block):
        raise ValueError("block digest is wrong")
    http, found, payload = block.partition(b"\r\n\r\n")
    length = re.search(rb"(?im)^content-length:\s*(\d+)\s*$", http)
    if not found or not http.startswith(b"HTTP/") or not length:
        raise ValueError("block has no HTTP header with a length")
    kind, size = fields["warc-type"], int(length[1])
    digest = fields.get("warc-payload-digest", "").removeprefix("sha1:")
    if kind == "response" and (len(payload) != size or payload_digest(payload) != digest):
        raise ValueError("payload differs from its length or digest")
    if kind == "revisit" and "warc-refers-to" not in fields:
        raise ValueError("a revisit that refers to nothing")

    def number(name: str) -> int | None:
        m = re.fullmatch(rf"<{ID}(-?\d+)>", fields.get(name, ""))
        return int(m[1]) if m else None
    return {"page_id": number("warc-record-id"), "payload_bytes": size, "payload_digest": digest, "record_type": kind,
            "refers_to": number("warc-refers-to"), "target_uri": fields.get("warc-target-uri"),
            "payload": payload if kind == "response" else None, "error": None}


def _archives(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    from pyspark import TaskContext
    part, made, held, size = TaskContext.get().partitionId(), 0, [], 0

    def flush() -> pa.RecordBatch:
        return pa.RecordBatch.from_pydict({"archive": pa.array([f"part-{part:05d}-{made:05d}.warc.zst"]),
                                           "records": pa.array([len(held)], pa.int64()), "content": pa.array([pack(held)], pa.binary())})
    for batch in batches:
        columns = (batch.column(c) for c in ("page_id", "url", "payload", "digest", "refers_to", "revisit"))
        for page_id, url, payload, digest, refers_to, revisit in zip(*columns):
            bare = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
            held.append(record_bytes(page_id.as_py(), url.as_py(), payload.as_py(), bare, refers_to.as_py(), revisit.as_py()))
            size += len(held[-1])
            if size >= ARCHIVE_BYTES:
                yield flush()
                made, held, size = made + 1, [], 0
    if held:
        yield flush()


def write_archives(plan: DataFrame) -> DataFrame:
    """The records of ``plan_records`` as archives of about 8 MB before compression."""
    return plan.mapInArrow(_archives, ARCHIVE_SCHEMA)


def _records(keep: bool) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()),
                        ("refers_to", pa.int64()), ("target_uri", pa.string()), ("payload", pa.binary()), ("error", pa.string())])

    def checked(raw: bytes) -> dict[str, object]:
        try:
            row = parse_record(raw)
        except ValueError as e:
            return {"error": str(e)}
        return row if keep else row | {"payload": None}

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for content in batch.column("content"):
                rows: list[dict[str, object]] = []
                try:
                    for raw in unpack(content.as_py()):
                        rows.append(checked(raw))
                except ValueError as e:
                    rows.append({"error": str(e)})
                yield pa.RecordBatch.from_pylist(rows, schema=schema)
    return read


def read_archives(archives: DataFrame, payloads: bool = True) -> DataFrame:
    """One row per record of a table with a ``content`` column of archives; ``error`` says what is wrong with a record.

    A record whose header or lengths do not hold gives a row with the error alone; after a damaged frame the rest of
    that archive can't be found, which is one such row. ``payloads=False`` checks payloads but leaves them out.
    """
    return archives.select("content").mapInArrow(_records(payloads), RECORD_SCHEMA)
