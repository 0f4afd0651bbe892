"""Tile sources: folders of codestreams, and frames encapsulated in DICOM files."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.pieces import pieces

#: File name extensions of codestreams.
EXTENSIONS = ("j2k", "j2c", "jp2", "jph", "jhc")
#: Value representations whose length takes 32 bits.
WIDE = (b"OB", b"OD", b"OF", b"OL", b"OV", b"OW", b"SQ", b"SV", b"UC", b"UN", b"UR", b"UT", b"UV")
UNDEFINED = 0xFFFFFFFF
ITEM, ITEM_END, LIST_END = (0xFFFE, 0xE000), (0xFFFE, 0xE00D), (0xFFFE, 0xE0DD)
PIXELS, OFFSETS, LENGTHS, COUNT = (0x7FE0, 0x0010), (0x7FE0, 0x0001), (0x7FE0, 0x0002), (0x0028, 0x0008)


class FrameError(ValueError):
    pass


def sniff(content: Column) -> Column:
    """J2k for a JP2 signature or a codestream's first marker, Jpeg for anything else, empty and null included."""
    jp2 = F.hex(F.substring(content, 1, 8)) == "0000000C6A502020"
    return F.when(jp2 | (F.hex(F.substring(content, 1, 2)) == "FF4F"), "J2k").otherwise("Jpeg")


def supported(path: Column) -> Column:
    """Whether a file's extension is a codestream's, in any case."""
    return F.lower(F.substring_index(path, ".", -1)).isin(*EXTENSIONS)


def files(spark: SparkSession, folder: str) -> DataFrame:
    """(path, length, payload, codec, supported) of every file below a folder that isn't empty; contents are read only where used."""
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return f.select("path", "length", F.col("content").alias("payload"), sniff(F.col("content")).alias("codec"), supported(F.col("path")).alias("supported"))


def first_tiles(spark: SparkSession, folder: str, limit: int) -> DataFrame:
    """The first ``limit`` supported files by path; the limit is the feature."""
    return files(spark, folder).filter("supported").orderBy("path").limit(limit)


def _element(data: bytes, at: int) -> tuple[tuple[int, int], int, int]:
    """(tag, where its value starts, the value's length)."""
    if at + 8 > len(data):
        raise FrameError("truncated")
    tag = struct.unpack_from("<HH", data, at)
    if tag[0] == 0xFFFE:
        return tag, at + 8, struct.unpack_from("<I", data, at + 4)[0]
    if data[at + 4 : at + 6] not in WIDE:
        return tag, at + 8, struct.unpack_from("<H", data, at + 6)[0]
    if at + 12 > len(data):
        raise FrameError("truncated")
    return tag, at + 12, struct.unpack_from("<I", data, at + 8)[0]


def _after(data: bytes, at: int, end: tuple[int, int]) -> int:
    """Where a list or item of undefined length ends; nested ones are skipped whole."""
    ends = [end]
    while ends:
        tag, body, n = _element(data, at)
        at = body
        if tag == ends[-1]:
            ends.pop()
        elif n == UNDEFINED:
            ends.append(ITEM_END if tag == ITEM else LIST_END)
        else:
            at = body + n
    return at


def _fragments(data: bytes, at: int) -> list[tuple[int, int]]:
    """(start, length) of each item's value up to the end of the list."""
    out = []
    while True:
        tag, body, n = _element(data, at)
        if tag == LIST_END:
            return out
        if tag != ITEM or n == UNDEFINED:
            raise FrameError("invalid_fragment")
        if body + n > len(data):
            raise FrameError("truncated")
        out.append((body, n))
        at = body + n


def frames(data: bytes, limit: int | None = None) -> list[bytes]:
    """The encapsulated frames of a file, at most ``limit`` of them if given.

    Frames are cut by the extended offset table, else by the basic one; without either, one frame
    takes all fragments, or each fragment is a frame if there are as many as frames.
    """
    if data[128:132] != b"DICM":
        raise FrameError("missing_preamble")
    at, count, starts, sizes = 132, 1, None, None
    while at < len(data):
        tag, body, n = _element(data, at)
        if tag == PIXELS:
            break
        if n == UNDEFINED:
            at = _after(data, body, LIST_END)
            continue
        if body + n > len(data):
            raise FrameError("truncated")
        value = data[body : body + n]
        if tag == COUNT:
            text = value.strip(b" \0") or b"1"
            if not text.isdigit():
                raise FrameError("invalid_frame_count")
            count = int(text)
        elif tag in (OFFSETS, LENGTHS):
            if n % 8:
                raise FrameError("invalid_offsets")
            table = np.frombuffer(value, "<u8").tolist()
            starts, sizes = (table, sizes) if tag == OFFSETS else (starts, table)
        at = body + n
    else:
        raise FrameError("no_pixel_data")
    if n != UNDEFINED:
        raise FrameError("not_encapsulated")
    parts = _fragments(data, body)
    if not parts:
        raise FrameError("no_fragments")
    (first, size), parts = parts[0], parts[1:]
    if starts is None and size:
        if size % 4:
            raise FrameError("invalid_offsets")
        starts = np.frombuffer(data, "<u4", size // 4, first).tolist()
    if starts:
        # offsets count from the item that follows the basic table
        places = np.array([s - 8 - first - size for s, _ in parts], np.int64)
        if starts != sorted(starts) or not np.isin(starts, places).all():
            raise FrameError("invalid_offsets")
        cuts = [*np.searchsorted(places, starts).tolist(), len(parts)]
        groups = [parts[a:b] for a, b in zip(cuts, cuts[1:], strict=False)]
    elif count == 1:
        groups = [parts]
    elif count == len(parts):
        groups = [[p] for p in parts]
    else:
        raise FrameError("ambiguous_frames")
    out = [b"".join(data[s : s + n] for s, n in g) for g in groups[:limit]]
    return [f[:n] for f, n in zip(out, sizes, strict=False)] if sizes and len(sizes) == len(groups) else out


def encapsulate(payloads: list[bytes], table: bool = True, fragment: int = 1 << 16) -> bytes:
    """A minimal file around frames, each in fragments of at most ``fragment`` bytes, padded to even lengths."""

    def element(tag: tuple[int, int], vr: bytes, value: bytes, n: int | None = None) -> bytes:
        size = len(value) if n is None else n
        head = struct.pack("<HH2s", *tag, vr)
        return head + (struct.pack("<HI", 0, size) if vr in WIDE else struct.pack("<H", size)) + value

    def item(value: bytes) -> bytes:
        return struct.pack("<HHI", *ITEM, len(value)) + value

    def even(value: bytes, pad: bytes) -> bytes:
        return value + pad * (len(value) % 2)

    step = fragment - fragment % 2
    bodies = [b"".join(item(even(p[i : i + step], b"\0")) for i in range(0, max(len(p), 1), step)) for p in payloads]
    at = np.cumsum([0, *map(len, bodies)])[:-1].astype("<u4")
    count = element(COUNT, b"IS", even(str(len(payloads)).encode(), b" "))
    pixels = item(at.tobytes() if table else b"") + b"".join(bodies) + struct.pack("<HHI", *LIST_END, 0)
    return bytes(128) + b"DICM" + count + element(PIXELS, b"OB", pixels, UNDEFINED)


def encapsulated(rows: DataFrame, id_col: str, parts: list, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, payload, carried columns): one file per row with a frame per column of ``parts``; a null one is an empty frame."""
    values = [(F.col(p) if isinstance(p, str) else p).cast("binary").alias(f"_{i}") for i, p in enumerate(parts)]
    given, first = rows.select(F.col(id_col).cast("long").alias("id"), *values, *carry), 1 + len(values)
    schema = StructType().add("id", "long").add("payload", "binary")
    for c in carry:
        schema.add(given.schema[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            out = [encapsulate([x or b"" for x in r]) for r in zip(*(c.to_pylist() for c in b.columns[1:first]), strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(out, pa.binary()), *b.columns[first:]], ["id", "payload", *carry])

    return given.mapInArrow(run, schema)


def dicom_frames(rows: DataFrame, id_col: str, content: str = "payload", limit: int | None = None, carry: tuple[str, ...] = ()) -> DataFrame:
    """(id, frame, payload, error, carried columns): a row per frame, or one with the error of a file that can't be cut."""
    given = rows.select(F.col(id_col).cast("long").alias("id"), F.col(content).alias("payload"), *carry)
    schema = StructType().add("id", "long").add("frame", "integer").add("payload", "binary").add("error", "string")
    for c in carry:
        schema.add(given.schema[c])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            row, frame, payload, error = [], [], [], []
            for i, data in enumerate(b.column(1)):
                try:
                    got, why = frames(data.as_py() or b"", limit), None
                except FrameError as e:
                    got, why = [None], str(e)
                row += [i] * len(got)
                frame += range(len(got))
                payload += got
                error += [why] * len(got)
            own = b.select([0, *range(2, b.num_columns)]).take(pa.array(row, pa.int64()))
            yield pa.RecordBatch.from_arrays([own.column(0), pa.array(frame, pa.int32()), pa.array(payload, pa.binary()), pa.array(error, pa.string()), *own.columns[1:]], ["id", "frame", "payload", "error", *carry])

    return given.mapInArrow(run, schema)
