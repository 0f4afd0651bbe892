"""Bounded decompression of container payloads: Deflate, Zstd, MSB-first LZW and raw.

One Arrow-batched function per payload; no output is ever larger than the bound plus one byte.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .pieces import pieces

#: Codes of 8-bit LZW.
CLEAR, STOP, WIDEST = 256, 257, 12


class TooSmall(ValueError):
    def __init__(self, required: int):
        super().__init__(f"output too small: {required} bytes are required")
        self.required = required


def _inflate(data: bytes, bound: int, wbits: int) -> bytes:
    d = zlib.decompressobj(wbits)
    out = d.decompress(data, bound + 1)
    if len(out) > bound:
        raise TooSmall(bound + 1)
    if not d.eof:
        raise zlib.error("stream ends early")
    return out


def deflate(data: bytes, bound: int) -> bytes:
    """zlib, or raw deflate where that fails; not where the bound does."""
    try:
        return _inflate(data, bound, 15)
    except zlib.error as first:
        try:
            return _inflate(data, bound, -15)
        except zlib.error as second:
            raise ValueError(f"zlib: {first}; raw: {second}") from second


def zstd(data: bytes, bound: int) -> bytes:
    import zstandard

    with zstandard.ZstdDecompressor().stream_reader(data, read_across_frames=True) as r:
        out = r.read(bound + 1)
        while len(out) <= bound and (more := r.read(bound + 1 - len(out))):
            out += more
    if len(out) > bound:
        raise TooSmall(bound + 1)
    return out


#: Widths of a table's codes, from the clear code's successor on.
_TABLE = 258 + np.maximum(np.arange(1 << WIDEST) - 1, 0)
_WIDTHS = np.minimum(9 + (_TABLE >= 512) + (_TABLE >= 1024) + (_TABLE >= 2048), WIDEST)
_LAST = np.arange(16) >= 16 - np.arange(WIDEST + 1)[:, None]


def lzw_pack(data: bytes) -> bytes:
    """The writer's side of lzw(): MSB first, widths switched when the table is full, ended by a stop code."""
    codes, fresh, table, nxt = [CLEAR], [1], {}, 258
    cur = -1
    for c in data:
        if cur < 0:
            cur = c
            continue
        key = cur << 8 | c
        known = table.get(key)
        if known is not None:
            cur = known
            continue
        codes.append(cur)
        if nxt < 1 << WIDEST:
            table[key] = nxt
            nxt += 1
        else:
            codes.append(CLEAR)
            fresh.append(len(codes))
            table, nxt = {}, 258
        cur = c
    if cur >= 0:
        codes.append(cur)
    codes.append(STOP)
    # a clear code has the width of its predecessor's table, the first one nine bits
    ends = [*fresh[1:], len(codes)]
    width = np.concatenate([[9], *(_WIDTHS[: b - a] for a, b in zip(fresh, ends, strict=True))])
    # 16 bits of each code, its own ones last
    bits = np.unpackbits(np.array(codes, ">u2").view(np.uint8)).reshape(-1, 16)
    return np.packbits(bits[_LAST[width]]).tobytes()


def lzw(data: bytes, bound: int) -> bytes:
    """Widths grow when the next code needs them, not one code early."""
    out, width, acc, bits = bytearray(), 9, 0, 0
    table: list[bytes] = [bytes([i]) for i in range(256)] + [b"", b""]
    last = b""
    for byte in data:
        acc, bits = acc << 8 | byte, bits + 8
        if bits < width:
            continue
        bits -= width
        code, acc = acc >> bits, acc & ((1 << bits) - 1)
        if code == STOP:
            return bytes(out)
        if code == CLEAR:
            table, width, last = table[:258], 9, b""
            continue
        if code < len(table):
            s = table[code]
        elif code == len(table) and last:
            s = last + last[:1]
        else:
            raise ValueError("invalid LZW code")
        out += s
        if len(out) > bound:
            raise TooSmall(bound + 1)
        if last and len(table) < 1 << WIDEST:
            table.append(last + s[:1])
        if len(table) >= 1 << width and width < WIDEST:
            width += 1
        last = s
    raise ValueError("LZW stream without a stop code")


def raw(data: bytes, bound: int) -> bytes:
    if len(data) > bound:
        raise TooSmall(len(data))
    return data


CODECS = {"deflate": deflate, "zstd": zstd, "lzw": lzw, "uncompressed": raw}


def expected_size(codec: str, data: bytes) -> int | None:
    return len(data) if codec == "uncompressed" else None


def decompress(tiles: DataFrame, codec: str = "codec", payload: str = "payload", bound: str = "bound") -> DataFrame:
    """Adds ``data`` (null on error), ``error`` and ``required`` (bytes, where the bound was too small).

    A null payload, codec or bound gives the error ``null``; an unknown codec ``unsupported``.
    """
    cols = [c for c in tiles.columns]
    at = [cols.index(c) for c in (codec, payload, bound)]
    schema = StructType([*tiles.schema.fields]).add("data", "binary").add("error", "string").add("required", "long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in pieces(batches):
            data, error, required = [], [], []
            for kind, p, n in zip(*(b.column(i).to_pylist() for i in at), strict=True):
                got, why, need = None, None, None
                if kind is None or p is None or n is None:
                    why = "null"
                elif kind not in CODECS:
                    why = "unsupported"
                else:
                    try:
                        got = CODECS[kind](p, n)
                    except TooSmall as e:
                        why, need = "too_small", e.required
                    except Exception as e:
                        why = f"corrupt: {e}"
                data.append(got)
                error.append(why)
                required.append(need)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(data, pa.binary()), pa.array(error, pa.string()), pa.array(required, pa.int64())], [*cols, "data", "error", "required"])

    return tiles.mapInArrow(run, schema)


def compress(rows: DataFrame, codec: str, text: str) -> DataFrame:
    """Adds ``payload``: the UTF-8 text in a container codec (test and export side)."""
    schema = StructType([*rows.schema.fields]).add("payload", "binary")
    at = rows.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import zstandard

        put = {"deflate": zlib.compress, "zstd": lambda d: zstandard.ZstdCompressor().compress(d), "lzw": lzw_pack, "uncompressed": bytes}[codec]
        for b in pieces(batches):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([None if t is None else put(t.encode()) for t in b.column(at).to_pylist()], pa.binary())], [*b.schema.names, "payload"])

    return rows.mapInArrow(run, schema).withColumn("codec", F.lit(codec))
