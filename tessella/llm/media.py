"""Media columns: signature sniffing, format validation, carving, and lossless 8-bit storage.

An Aho-Corasick automaton finds all magic bytes of a value in one pass; each find is
confirmed by its format's validator, which walks the structure and gives the length.
A media object that begins at byte 0 is the value's own type and corrects what is
declared; valid objects further in are embedded media, found with offset and length.

Defined cases: a null value has no type and nothing embedded, as an empty one; a value
whose declared type is null is corrected if a type is found; broken structures are no
finds; an object inside a confirmed one is reported only if ``nested``; repeated rows
are judged each; an empty table gives an empty result; columns of the input named like
an output are replaced.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Callable, Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tessella.llm.common import column_buffers, slices

SLICE_BYTES = 4 << 20
SAMPLE_RATE = 8000


def _png(b: bytes, at: int) -> int | None:
    p, first = at + 8, True
    while p + 12 <= len(b):
        (n,) = struct.unpack_from(">I", b, p)
        kind = b[p + 4 : p + 8]
        if p + 12 + n > len(b) or first and (kind != b"IHDR" or n != 13) or zlib.crc32(b[p + 4 : p + 8 + n]) != struct.unpack_from(">I", b, p + 8 + n)[0]:
            return None
        p, first = p + 12 + n, False
        if kind == b"IEND":
            return p - at
    return None


def _jpeg(b: bytes, at: int) -> int | None:
    p = at + 2
    while p + 4 <= len(b) and b[p] == 0xFF:
        marker, n = b[p + 1], struct.unpack_from(">H", b, p + 2)[0]
        if n < 2:
            return None
        p += 2 + n
        if marker == 0xDA:  # entropy-coded data run to the end marker; 0xFF00 and restarts belong to it
            while 0 <= (p := b.find(b"\xff", p)) < len(b) - 1:
                if b[p + 1] == 0xD9:
                    return p + 2 - at
                if b[p + 1] == 0 or 0xD0 <= b[p + 1] <= 0xD7:
                    p += 2
                else:
                    break
            if p < 0:
                return None
    return None


def _gif(b: bytes, at: int) -> int | None:
    if at + 13 > len(b):
        return None
    p = at + 13 + (3 << ((b[at + 10] & 7) + 1) if b[at + 10] & 0x80 else 0)

    def blocks(p: int) -> int | None:
        while p < len(b):
            if not b[p]:
                return p + 1
            p += 1 + b[p]
        return None

    while p is not None and p < len(b):
        if b[p] == 0x3B:
            return p + 1 - at
        if b[p] == 0x21:
            p = blocks(p + 2)
        elif b[p] == 0x2C and p + 10 <= len(b):
            p = blocks(p + 10 + (3 << ((b[p + 9] & 7) + 1) if b[p + 9] & 0x80 else 0) + 1)
        else:
            return None
    return None


def _riff(form: bytes, need: bytes) -> Callable[[bytes, int], int | None]:
    def check(b: bytes, at: int) -> int | None:
        if at + 12 > len(b) or b[at + 8 : at + 12] != form:
            return None
        end = at + 8 + struct.unpack_from("<I", b, at + 4)[0]
        p, kinds = at + 12, []
        while p + 8 <= end <= len(b):
            kinds.append(b[p : p + 4])
            n = struct.unpack_from("<I", b, p + 4)[0]
            p += 8 + n + n % 2
        return end - at if p == end and any(k.startswith(need) for k in kinds) else None

    return check


def _bmp(b: bytes, at: int) -> int | None:
    if at + 54 > len(b):
        return None
    size, reserved, begin, header, width, height, planes, bits, packed = struct.unpack_from("<IIIIiiHHI", b, at + 2)
    rows = (width * bits + 31) // 32 * 4 * abs(height)
    good = not reserved and header in (40, 108, 124) and planes == 1 and bits in (1, 4, 8, 16, 24, 32) and width > 0 and not packed
    return size if good and 14 + header <= begin and begin + rows == size <= len(b) - at else None


def _gzip(b: bytes, at: int) -> int | None:
    unpack = zlib.decompressobj(31)
    try:
        p = at
        while p < len(b) and not unpack.eof:
            unpack.decompress(b[p : p + 65536])
            p += 65536
    except zlib.error:
        return None
    return min(p, len(b)) - len(unpack.unused_data) - at if unpack.eof else None


#: The formats' magic bytes; the validator for each type.
SIGNATURES: list[tuple[bytes, str, Callable[[bytes, int], int | None]]] = [
    (b"\x89PNG\r\n\x1a\n", "image/png", _png),
    (b"\xff\xd8\xff", "image/jpeg", _jpeg),
    (b"GIF87a", "image/gif", _gif),
    (b"GIF89a", "image/gif", _gif),
    (b"BM", "image/bmp", _bmp),
    (b"RIFF", "audio/wav", _riff(b"WAVE", b"data")),
    (b"RIFF", "image/webp", _riff(b"WEBP", b"VP8")),
    (b"\x1f\x8b\x08", "application/gzip", _gzip),
]


@lru_cache(maxsize=1)
def automaton() -> ahocorasick.Automaton:
    a, by = ahocorasick.Automaton(), {}
    for magic, kind, check in SIGNATURES:
        by.setdefault(magic, []).append((kind, check))
    for magic, checks in by.items():
        a.add_word(magic.decode("latin-1"), (len(magic), checks))
    a.make_automaton()
    return a


def find_media(data: bytes, nested: bool = False) -> list[tuple[str, int, int]]:
    """Type, offset and length of each confirmed media object, in order of the offsets."""
    found, free = [], 0
    for end, (size, checks) in automaton().iter(data.decode("latin-1")):
        at = end + 1 - size
        if at < free and not nested:
            continue
        for kind, check in checks:
            if length := check(data, at):
                found.append((kind, at, length))
                free = max(free, at + length)
                break
    return found


PART = T.StructType([T.StructField("type", T.StringType()), T.StructField("offset", T.LongType()), T.StructField("length", T.LongType())])
SNIFFED = T.StructType(
    [
        T.StructField("detected_type", T.StringType()),
        T.StructField("media_length", T.LongType()),
        T.StructField("corrected", T.BooleanType()),
        T.StructField("embedded", T.ArrayType(PART)),
    ]
)


def _map(df: DataFrame, names: list[str], source: str, fields: list[T.StructField], types: list[pa.DataType], make: Callable[[list, pa.RecordBatch], list]) -> DataFrame:
    """Keep the columns ``names`` and add what ``make`` gives for slices of about SLICE_BYTES of ``source``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            _, offsets = column_buffers(whole.column(whole.schema.get_field_index(source)))
            for i, j in slices(offsets, SLICE_BYTES):
                batch = whole.slice(i, j - i)
                rows = make(batch.column(batch.schema.get_field_index(source)).to_pylist(), batch)
                columns = [list(c) for c in zip(*rows, strict=True)]
                kept = [batch.column(batch.schema.get_field_index(n)) for n in names]
                yield pa.RecordBatch.from_arrays([*kept, *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], [*names, *(f.name for f in fields)])

    return df.mapInArrow(run, T.StructType([*(df.schema[n] for n in names), *fields]))


def sniff(df: DataFrame, content_col: str = "content", declared_col: str | None = None, nested: bool = False) -> DataFrame:
    """Add detected_type and media_length (of the object at byte 0), corrected, and embedded (objects further in)."""
    names = [c for c in df.columns if c not in SNIFFED.names]
    part = pa.list_(pa.struct([("type", pa.string()), ("offset", pa.int64()), ("length", pa.int64())]))

    def make(values: list, batch: pa.RecordBatch) -> list:
        declared = batch.column(batch.schema.get_field_index(declared_col)).to_pylist() if declared_col else [None] * len(values)
        out = []
        for value, said in zip(values, declared, strict=True):
            found = find_media(value, nested) if value else []
            own = found[0] if found and found[0][1] == 0 else (None, 0, None)
            inner = [{"type": k, "offset": o, "length": n} for k, o, n in found if o]
            out.append((own[0], own[2], own[0] is not None and own[0] != said, inner))
        return out

    return _map(df, names, content_col, SNIFFED.fields, [pa.string(), pa.int64(), pa.bool_(), part], make)


def carve(sniffed: DataFrame, content_col: str = "content") -> DataFrame:
    """A row for each embedded object of sniffed rows: all their columns, and carved_type, carved_offset, carved."""
    one = sniffed.withColumn("_part", F.explode("embedded"))
    cutout = F.substring(F.col(content_col), (F.col("_part.offset") + 1).cast("int"), F.col("_part.length").cast("int"))
    return one.select("*", F.col("_part.type").alias("carved_type"), F.col("_part.offset").alias("carved_offset"), cutout.alias("carved")).drop("_part")


def wav_header(payload_bytes: int) -> bytes:
    """Header of a mono sound of unsigned 8-bit samples."""
    return struct.pack("<4sI4s4sIHHIIHH4sI", b"RIFF", 36 + payload_bytes, b"WAVE", b"fmt ", 16, 1, 1, SAMPLE_RATE, SAMPLE_RATE, 1, 8, b"data", payload_bytes)


def store_samples(df: DataFrame, text_col: str = "text", block: int = 64, media_col: str = "media") -> DataFrame:
    """Add n_bytes and ``media_col``: the UTF-8 text, zero-padded to a positive multiple of ``block``, as WAV samples."""
    names = [c for c in df.columns if c not in ("n_bytes", media_col)]

    def make(values: list, batch: pa.RecordBatch) -> list:
        out = []
        for value in values:
            raw = (value or "").encode()
            payload = raw.ljust(max(block, -(-len(raw) // block) * block), b"\0")
            out.append((len(raw), wav_header(len(payload)) + payload))
        return out

    fields = [T.StructField("n_bytes", T.LongType()), T.StructField(media_col, T.BinaryType())]
    return _map(df, names, text_col, fields, [pa.int64(), pa.binary()], make)


def wav_chunk(data: bytes, length: int) -> tuple[int, int]:
    """Offset and length of the samples in a validated WAV object."""
    p = 12
    while p + 8 <= length:
        n = struct.unpack_from("<I", data, p + 4)[0]
        if data[p : p + 4] == b"data":
            return p + 8, n
        p += 8 + n + n % 2
    raise ValueError("no samples")


def read_samples(df: DataFrame, media_col: str = "media") -> DataFrame:
    """Add samples (bytes) and feature of rows that :func:`sniff` found to be WAV; null for others."""
    names = [c for c in df.columns if c not in ("samples", "feature")]

    def make(values: list, batch: pa.RecordBatch) -> list:
        kinds = batch.column(batch.schema.get_field_index("detected_type")).to_pylist()
        lengths = batch.column(batch.schema.get_field_index("media_length")).to_pylist()
        out = []
        for value, kind, length in zip(values, kinds, lengths, strict=True):
            if kind != "audio/wav":
                out.append((None, None))
                continue
            at, n = wav_chunk(value, length)
            samples = value[at : at + n]
            x = np.frombuffer(samples, np.uint8)
            moved = np.count_nonzero(x[1:] != x[:-1])
            out.append((samples, f"{kind};samples={n};sum={int(x.sum(dtype=np.int64))};peak={int(x.max(initial=0))};changes={moved}"))
        return out

    fields = [T.StructField("samples", T.BinaryType()), T.StructField("feature", T.StringType())]
    return _map(df, names, media_col, fields, [pa.binary(), pa.string()], make)


def tail(column: str, n: int = 64) -> Column:
    """The last ``n`` bytes of a binary column."""
    return F.substring(F.col(column), F.greatest(F.octet_length(column) - n + 1, F.lit(1)), F.lit(n))
