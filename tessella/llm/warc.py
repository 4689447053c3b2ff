"""WARC archives in Zstandard: a dictionary from the archive's own records, then a frame per record.

An archive begins with a skippable frame that holds the dictionary; each record after
it is a frame of its own, so one record can be read alone. Payloads that appear again
are revisit records that refer to the first. Archives are rows of a table (archive_id,
content), each of bounded size; ``write_files`` puts them out as .warc.zst files and
``read_files`` reads such files.

Defined cases: a null payload is empty, a null URL is left out of the record; a row
with a null id is a response and nothing refers to it; rows that repeat an id and its
payload are all responses; an empty table gives no archives; other columns are left out.
"""

from __future__ import annotations

import hashlib
import struct
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.llm.common import cut

#: Magic number of the skippable frame that holds a dictionary.
DICTIONARY_FRAME = 0x184D2A5D
ARCHIVE_BYTES, ARCHIVE_RECORDS = 16 << 20, 8192
#: Bytes of the records that an archive's dictionary is built from (every so-manieth of them), and of a dictionary, at most.
SAMPLE_BYTES, DICTIONARY_BYTES = 1 << 20, 32 << 10
ZSTD_MAGIC = b"\x28\xb5\x2f\xfd"
LEVEL = 3
DATE = "2024-01-01T00:00:00Z"
ID = "urn:page:"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"

RECORDS = "page_id long, url string, record_type string, refers_to long, payload binary, payload_digest string"


def mark_revisits(pages: DataFrame, id_col: str = "page_id", url_col: str = "url", payload_col: str = "html", least_bytes: int = 100) -> DataFrame:
    """page_id, url, payload, payload_digest and refers_to (null for responses).

    Digests find the repeated payloads; the marks of revisits are a small table as a
    rule, which Spark broadcasts then, so that payloads are not shuffled.
    """
    payload = F.coalesce(F.col(payload_col).cast("binary"), F.lit(b""))
    rows = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"), payload.alias("payload"))
    rows = rows.withColumn("payload_digest", F.sha2("payload", 256))
    large = rows.where(F.octet_length("payload") >= least_bytes).select("page_id", "payload_digest")
    first = large.groupBy("payload_digest").agg(F.min("page_id").alias("refers_to"), F.max("page_id").alias("last")).where("refers_to < last").drop("last")
    marks = cut(large.join(first, "payload_digest").where("page_id > refers_to").distinct())
    return rows.join(marks, ["page_id", "payload_digest"], "left").select("page_id", "url", "payload", "payload_digest", "refers_to")


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> bytes:
    http = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\n\r\n"
    body = http if refers_to is not None else http + payload
    lines = [
        "WARC/1.1",
        f"WARC-Type: {'response' if refers_to is None else 'revisit'}",
        f"WARC-Record-ID: <{ID}{'' if page_id is None else page_id}>",
        f"WARC-Date: {DATE}",
        f"WARC-Payload-Digest: sha256:{digest}",
        "Content-Type: application/http; msgtype=response",
        f"Content-Length: {len(body)}",
    ]
    if url is not None:
        lines.append(f"WARC-Target-URI: {quote(url, safe=''.join(chr(c) for c in range(33, 127)))}")
    if refers_to is not None:
        lines += [f"WARC-Profile: {PROFILE}", f"WARC-Refers-To: <{ID}{refers_to}>"]
    return "\r\n".join(lines).encode() + b"\r\n\r\n" + body + b"\r\n\r\n"


def archive(records: list[bytes]) -> bytes:
    """A file: the dictionary's frame, and a frame per record."""
    total = sum(map(len, records))
    step = max(1, total // SAMPLE_BYTES)
    samples = records[::step]
    head, dictionary = b"", None
    try:
        # a small archive gets a small dictionary, which its records can earn back
        dictionary = zstandard.train_dictionary(min(DICTIONARY_BYTES, max(1024, total // 64)), samples, k=256, d=8)
        raw = dictionary.as_bytes()
        head = struct.pack("<II", DICTIONARY_FRAME, len(raw)) + raw
    except zstandard.ZstdError:  # too few records for a dictionary: the format allows none
        dictionary = None
    compressor = zstandard.ZstdCompressor(level=LEVEL, dict_data=dictionary, write_checksum=True)
    return head + b"".join(map(compressor.compress, records))


def write_archives(rows: DataFrame) -> DataFrame:
    """Archives (archive_id, content) of rows as :func:`mark_revisits` gives them; each holds about ARCHIVE_BYTES."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[bytes] = []
        size, part, n = 0, TaskContext.get().partitionId(), 0

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array([f"part-{part:05d}-{n:05d}"]), pa.array([archive(held)], pa.binary())], ["archive_id", "content"])

        for batch in batches:
            for page_id, url, payload, digest, refers_to in zip(*(batch.column(i) for i in range(5)), strict=True):
                held.append(record(page_id.as_py(), url.as_py(), payload.as_py(), digest.as_py(), refers_to.as_py()))
                size += len(held[-1])
                if size >= ARCHIVE_BYTES or len(held) >= ARCHIVE_RECORDS:
                    yield out()
                    held, size, n = [], 0, n + 1
        if held:
            yield out()

    columns = ["page_id", "url", "payload", "payload_digest", "refers_to"]
    return rows.select(F.col("page_id").cast("long"), *columns[1:4], F.col("refers_to").cast("long")).mapInArrow(run, "archive_id string, content binary")


def frames(data: memoryview) -> Iterator[memoryview]:
    """The frames of a file, by walking their block headers."""
    at = 0
    while at < len(data):
        (magic,) = struct.unpack_from("<I", data, at)
        if magic & 0xFFFFFFF0 == 0x184D2A50:
            end = at + 8 + struct.unpack_from("<I", data, at + 4)[0]
        else:
            end = at + zstandard.frame_header_size(data[at : at + 18])
            while True:
                block = int.from_bytes(data[end : end + 3], "little")
                end += 3 + (1 if block >> 1 & 3 == 1 else block >> 3)
                if block & 1:
                    break
            end += 4 * zstandard.get_frame_parameters(data[at : at + 18]).has_checksum
        yield data[at:end]
        at = end


def records(content: bytes) -> Iterator[tuple[dict[str, str], bytes]]:
    """Header fields (lower-case names) and block of each record."""
    unpack = zstandard.ZstdDecompressor()
    for frame in frames(memoryview(content)):
        (magic,) = struct.unpack_from("<I", frame)
        if magic == DICTIONARY_FRAME:
            raw = bytes(frame[8:])
            if raw[:4] == ZSTD_MAGIC:  # the format allows a compressed dictionary
                raw = zstandard.ZstdDecompressor().decompressobj().decompress(raw)
            unpack = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(raw))
        elif magic & 0xFFFFFFF0 != 0x184D2A50:
            # a frame need not tell its content's size
            head, _, rest = unpack.decompressobj().decompress(frame).partition(b"\r\n\r\n")
            fields = (line.split(":", 1) for line in head.decode("utf-8", "replace").split("\r\n")[1:] if ":" in line)
            fields = {k.strip().lower(): v.strip() for k, v in fields}
            yield fields, rest[: int(fields.get("content-length", 0))]


def read_archives(archives: DataFrame) -> DataFrame:
    """The records: page_id, url, record_type, refers_to, payload (null for revisits), payload_digest (as archived).

    Of archives that others wrote, records have null ids, a payload is what follows an
    HTTP header, or the whole block, and only SHA-256 digests are checked.
    """

    def number(text: str | None) -> int | None:
        digits = (text or "").removeprefix(f"<{ID}").removesuffix(">")
        return int(digits) if digits.removeprefix("-").isascii() and digits.removeprefix("-").isdigit() else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = (pa.int64(), pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string())
        names = [x.split()[0] for x in RECORDS.split(", ")]

        def out(rows: list) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for batch in batches:
            for content in batch.column(0):
                rows, size = [], 0
                for fields, block in records(content.as_py()):
                    payload = block.partition(b"\r\n\r\n")[2] if fields.get("content-type", "").startswith("application/http") else block
                    kind, stated = fields.get("warc-type"), fields.get("warc-payload-digest")
                    digest = stated and stated.removeprefix("sha256:")
                    if kind == "response" and digest != stated and hashlib.sha256(payload).hexdigest() != digest.lower():
                        raise ValueError(f"record {fields.get('warc-record-id')} is damaged")
                    rows.append((number(fields.get("warc-record-id")), fields.get("warc-target-uri"), kind, number(fields.get("warc-refers-to")), None if kind == "revisit" else payload, digest))
                    size += len(payload)
                    if size > 4 << 20:
                        yield out(rows)
                        rows, size = [], 0
                if rows:
                    yield out(rows)

    return archives.select("content").mapInArrow(run, RECORDS)


def record_lengths(archived: DataFrame) -> DataFrame:
    """Records with payload_bytes in place of their payloads."""
    return archived.select("page_id", "url", "record_type", "refers_to", F.octet_length("payload").cast("long").alias("payload_bytes"), "payload_digest")


def resolve_revisits(own: DataFrame) -> DataFrame:
    """Per record (as :func:`record_lengths` gives them) page_id, url, record_type, refers_to, payload_bytes and payload_digest of the full payload.

    A revisit's length is that of the response it refers to.
    """
    lengths = own.where("record_type = 'response' AND page_id IS NOT NULL").groupBy(F.col("page_id").alias("refers_to"), "payload_digest").agg(F.max("payload_bytes").alias("_bytes"))
    revisits = own.where("record_type = 'revisit'").join(lengths, ["refers_to", "payload_digest"], "left")
    revisits = revisits.select("page_id", "url", "record_type", "refers_to", F.col("_bytes").alias("payload_bytes"), "payload_digest")
    return own.where("record_type = 'response'").unionByName(revisits)


def write_files(archives: DataFrame, folder: str) -> None:
    """Write each archive as ``folder/<archive_id>.warc.zst``; folder is a URI that all executors reach."""

    def put(rows: Iterator) -> None:
        from pyarrow import fs

        system, path = fs.FileSystem.from_uri(folder)
        system.create_dir(path, recursive=True)
        for r in rows:
            with system.open_output_stream(f"{path}/{r.archive_id}.warc.zst", compression=None) as f:
                f.write(bytes(r.content))

    archives.foreachPartition(put)


def read_files(spark: SparkSession, folder: str) -> DataFrame:
    """Archives (archive_id, content) from .warc.zst files."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.zst").load(folder)
    return files.select(F.regexp_extract("path", r"([^/]*)\.warc\.zst$", 1).alias("archive_id"), "content")
