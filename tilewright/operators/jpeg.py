"""Baseline JPEG tiles: header inspection, encoding and decoding, one Arrow-batched call per tile."""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import entropy

#: Frame kinds by marker.
FRAMES = {0xC0: "Baseline8", 0xC1: "Extended8", 0xC2: "Progressive8", 0xC3: "Lossless"}
#: The public luminance quantiser, in natural order.
LUMA_QUANT = [16, 11, 10, 16, 24, 40, 51, 61, 12, 12, 14, 19, 26, 58, 60, 55, 14, 13, 16, 24, 40, 57, 69, 56, 14, 17, 22, 29, 51, 87, 80, 62, 18, 22, 37, 56, 68, 109, 103, 77, 24, 35, 55, 64, 81, 104, 113, 92, 49, 64, 78, 87, 103, 121, 120, 101, 72, 92, 95, 98, 112, 100, 103, 99]
#: Codes per length of the public luminance tables.
DC_BITS, AC_BITS = [0, 1, 5, 1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 0], [0, 2, 1, 3, 3, 2, 4, 3, 5, 5, 4, 4, 0, 0, 1, 125]
#: The symbols of the public luminance AC table, in code order.
AC_VALUES = [0x01, 0x02, 0x03, 0x00, 0x04, 0x11, 0x05, 0x12, 0x21, 0x31, 0x41, 0x06, 0x13, 0x51, 0x61, 0x07, 0x22, 0x71, 0x14, 0x32, 0x81, 0x91, 0xA1, 0x08, 0x23, 0x42, 0xB1, 0xC1, 0x15, 0x52, 0xD1, 0xF0, 0x24, 0x33, 0x62, 0x72, 0x82, 0x09, 0x0A, 0x16, 0x17, 0x18, 0x19, 0x1A, 0x25, 0x26, 0x27, 0x28, 0x29, 0x2A, 0x34, 0x35, 0x36, 0x37, 0x38, 0x39, 0x3A, 0x43, 0x44, 0x45, 0x46, 0x47, 0x48, 0x49, 0x4A, 0x53, 0x54, 0x55, 0x56, 0x57, 0x58, 0x59, 0x5A, 0x63, 0x64, 0x65, 0x66, 0x67, 0x68, 0x69, 0x6A, 0x73, 0x74, 0x75, 0x76, 0x77, 0x78, 0x79, 0x7A, 0x83, 0x84, 0x85, 0x86, 0x87, 0x88, 0x89, 0x8A, 0x92, 0x93, 0x94, 0x95, 0x96, 0x97, 0x98, 0x99, 0x9A, 0xA2, 0xA3, 0xA4, 0xA5, 0xA6, 0xA7, 0xA8, 0xA9, 0xAA, 0xB2, 0xB3, 0xB4, 0xB5, 0xB6, 0xB7, 0xB8, 0xB9, 0xBA, 0xC2, 0xC3, 0xC4, 0xC5, 0xC6, 0xC7, 0xC8, 0xC9, 0xCA, 0xD2, 0xD3, 0xD4, 0xD5, 0xD6, 0xD7, 0xD8, 0xD9, 0xDA, 0xE1, 0xE2, 0xE3, 0xE4, 0xE5, 0xE6, 0xE7, 0xE8, 0xE9, 0xEA, 0xF1, 0xF2, 0xF3, 0xF4, 0xF5, 0xF6, 0xF7, 0xF8, 0xF9, 0xFA]
#: Natural place of each zig-zag place: along anti-diagonals, every other one upwards.
ZIGZAG = sorted(range(64), key=lambda i: (i // 8 + i % 8, i // 8 if (i // 8 + i % 8) % 2 else i % 8))
_DCT = np.array([[np.sqrt((1 if k == 0 else 2) / 8) * np.cos((2 * n + 1) * k * np.pi / 16) for n in range(8)] for k in range(8)])


class JpegError(ValueError):
    pass


def scaled_table(quality: int) -> np.ndarray:
    q = min(max(quality, 1), 100)
    scale = 5000 // q if q < 50 else 200 - 2 * q
    return np.clip((np.array(LUMA_QUANT) * scale + 50) // 100, 1, 255)


def _codes(bits: list[int], values: list[int]) -> dict[int, tuple[int, int]]:
    """symbol -> (code, length)."""
    out, code, at = {}, 0, 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            out[values[at]] = (code, length)
            code, at = code + 1, at + 1
        code <<= 1
    return out


_DC, _AC = _codes(DC_BITS, list(range(12))), _codes(AC_BITS, AC_VALUES)


def segments(data: bytes) -> Iterator[tuple[int, bytes, int]]:
    """(marker, payload, where the next byte is) up to the first scan's header."""
    if data[:2] != b"\xff\xd8":
        raise JpegError("missing_soi")
    at = 2
    while True:
        if at + 4 > len(data):
            raise JpegError("truncated")
        if data[at] != 0xFF:
            raise JpegError("expected_marker")
        while at < len(data) and data[at] == 0xFF:
            at += 1
        if at >= len(data):
            raise JpegError("truncated")
        marker, at = data[at], at + 1
        if marker == 0x01 or 0xD0 <= marker <= 0xD7:
            continue
        if marker == 0xD9 or at + 2 > len(data):
            raise JpegError("truncated")
        (n,) = struct.unpack_from(">H", data, at)
        if n < 2 or at + n > len(data):
            raise JpegError("truncated")
        yield marker, data[at + 2 : at + n], at + n
        if marker == 0xDA:
            return
        at += n


def inspect(data: bytes) -> dict:
    """Header facts without decoding; JpegError names the first broken rule."""
    info: dict = {"adobe": None, "restart": 0, "quant": {}, "huffman": {}}
    for marker, body, after in segments(data):
        if marker in FRAMES:
            if len(body) < 6 or len(body) < 6 + 3 * body[5]:
                raise JpegError("truncated")
            depth, h, w, n = struct.unpack_from(">BHHB", body)
            if n not in (1, 3, 4):
                raise JpegError("unsupported_components")
            if not (1 <= w <= 65500 and 1 <= h <= 65500):
                raise JpegError("invalid_dimensions")
            kind = FRAMES[marker]
            info |= {"sof": kind[:-1] + "12" if depth == 12 and kind.endswith("8") else kind, "bit_depth": depth, "height": h, "width": w, "components": n, "parts": [(body[6 + 3 * i], body[7 + 3 * i] >> 4, body[7 + 3 * i] & 15, body[8 + 3 * i]) for i in range(n)]}
        elif 0xC5 <= marker <= 0xCF and marker not in (0xC8, 0xCC, 0xC4):
            raise JpegError("unsupported_frame")
        elif marker == 0xDB:
            at = 0
            while at < len(body):
                wide, slot = body[at] >> 4, body[at] & 15
                n = 128 if wide else 64
                if slot > 3 or at + 1 + n > len(body):
                    raise JpegError("invalid_quant_table")
                info["quant"][slot] = np.frombuffer(body, ">u2" if wide else np.uint8, 64, at + 1).astype(np.int64)
                at += 1 + n
        elif marker == 0xC4:
            at = 0
            while at + 17 <= len(body):
                bits = list(body[at + 1 : at + 17])
                info["huffman"][body[at]] = (bits, list(body[at + 17 : at + 17 + sum(bits)]))
                at += 17 + sum(bits)
        elif marker == 0xDD and len(body) >= 2:
            info["restart"] = struct.unpack_from(">H", body)[0]
        elif marker == 0xEE and body[:5] == b"Adobe" and len(body) >= 12:
            info["adobe"] = body[11]
        elif marker == 0xDA:
            info |= {"scan": body, "entropy": after}
    if "width" not in info:
        raise JpegError("missing_frame")
    n, adobe = info["components"], info["adobe"]
    info["colorspace"] = "Gray" if n == 1 else ("YCbCr" if adobe in (None, 1) else "Rgb") if n == 3 else "Ycck" if adobe == 2 else "Cmyk"
    return info


_plans: dict[int, dict[bytes, dict]] = {}
_PLANS = 64


def plan(data: bytes) -> dict:
    """inspect(), remembered by the header's bytes: tiles of one slide share a few headers. A worker keeps _PLANS of them."""
    for size, known in _plans.items():
        info = known.get(data[:size])
        if info is not None:
            return info
    info = inspect(data)
    if sum(map(len, _plans.values())) >= _PLANS:
        _plans.clear()
    _plans.setdefault(info["entropy"], {})[bytes(data[: info["entropy"]])] = info
    return info


def _grid(info: dict) -> tuple[int, int, list[tuple[int, int]]]:
    """(rows and columns of coded units, each component's blocks down and across in one)."""
    factors = [(p[2], p[1]) for p in info["parts"]] if info["components"] > 1 else [(1, 1)]
    v, h = (max(f[i] for f in factors) for i in (0, 1))
    return -(-info["height"] // (8 * v)), -(-info["width"] // (8 * h)), factors


_coded: dict[tuple[int, bytes], tuple[int, int]] = {}
_CODED = 1 << 16


def _block(d: int, ac: bytes) -> tuple[int, int]:
    """(bits, their number) of a block by its DC difference and the bytes of its 63 other coefficients; a worker remembers _CODED of them."""
    known = _coded.get((d, ac))
    if known is not None:
        return known
    acc = size = 0

    def put(code: int, length: int):
        nonlocal acc, size
        acc, size = acc << length | code, size + length

    def signed(v: int, length: int):
        put(v if v >= 0 else v + (1 << length) - 1, length)

    k = abs(d).bit_length()
    put(*_DC[k])
    if k:
        signed(d, k)
    run = 0
    block = np.frombuffer(ac, np.int64).tolist()
    end = max((j + 1 for j in range(63) if block[j]), default=0)
    for v in block[:end]:
        if not v:
            run += 1
            continue
        while run > 15:
            put(*_AC[0xF0])
            run -= 16
        k = abs(v).bit_length()
        put(*_AC[run << 4 | k])
        signed(v, k)
        run = 0
    if end < 63:
        put(*_AC[0])
    if len(_coded) >= _CODED:
        _coded.clear()
    _coded[d, ac] = acc, size
    return acc, size


def encode(planes: np.ndarray, quality: int = 90, restart: int = 0, sampling: tuple[int, int] = (1, 1)) -> bytes:
    """planes: components x height x width of bytes, one component (grey) or three (YCbCr), all full size.

    ``sampling`` says how many chroma samples across and down become one, by their mean.
    """
    return encode_many(planes[None], quality, restart, sampling)[0]


def encode_many(tiles: np.ndarray, quality: int = 90, restart: int = 0, sampling: tuple[int, int] = (1, 1)) -> list[bytes]:
    """encode() of tiles of one shape (tiles x components x height x width), transformed together."""
    count, n, h, w = tiles.shape
    across, down = sampling if n > 1 else (1, 1)
    table = scaled_table(quality)
    parts = [(i + 1, 1 if i else across, 1 if i else down, 0) for i in range(n)]
    tall, wide, factors = _grid({"components": n, "height": h, "width": w, "parts": parts})
    coeff, comps = [], [c for c, (v, hh) in enumerate(factors) for _ in range(v * hh)]
    for c, (v, hh) in enumerate(factors):
        full = np.pad(tiles[:, c], ((0, 0), (0, tall * 8 * down - h), (0, wide * 8 * across - w)), "edge").astype(np.float64)
        small = full.reshape(count, tall * 8 * v, down // v, wide * 8 * hh, across // hh).mean((2, 4))
        blocks = (np.floor(small + 0.5) - 128).reshape(count, tall * v, 8, wide * hh, 8).transpose(0, 1, 3, 2, 4)
        x = (_DCT @ blocks @ _DCT.T).reshape(count, tall * v, wide * hh, 64) / table
        x = np.trunc(x + np.copysign(0.5, x)).astype(np.int64)[..., ZIGZAG]
        coeff.append(x.reshape(count, tall, v, wide, hh, 64).transpose(0, 1, 3, 2, 4, 5).reshape(count, tall * wide, v * hh, 64))
    every = np.ascontiguousarray(np.concatenate(coeff, 2))
    head = [b"\xff\xd8", b"\xff\xdb" + struct.pack(">HB", 67, 0) + table[ZIGZAG].astype(np.uint8).tobytes()]
    if restart:
        head.append(b"\xff\xdd" + struct.pack(">HH", 4, restart))
    head.append(b"\xff\xc0" + struct.pack(">HBHHB", 8 + 3 * n, 8, h, w, n) + b"".join(bytes([i, hh << 4 | v, t]) for i, hh, v, t in parts))
    for kind, bits, values in ((0x00, DC_BITS, list(range(12))), (0x10, AC_BITS, AC_VALUES)):
        head.append(b"\xff\xc4" + struct.pack(">HB", 19 + len(values), kind) + bytes(bits) + bytes(values))
    head.append(b"\xff\xda" + struct.pack(">HB", 6 + 2 * n, n) + b"".join(bytes([i + 1, 0]) for i in range(n)) + b"\x00\x3f\x00")
    first = b"".join(head)
    return [first + _scan(x, comps, restart) + b"\xff\xd9" for x in every]


def _scan(coeff: np.ndarray, comps: list[int], restart: int) -> bytes:
    """Entropy-coded data of a tile's units x blocks x 64 coefficients in zig-zag order."""
    dc, step = coeff[:, :, 0].tolist(), 64 * coeff.itemsize
    raw, at = coeff.tobytes(), 0
    out, acc, size, last = bytearray(), 0, 0, [0] * (max(comps) + 1)

    def flush(fill: bool) -> None:
        """Whole bytes go out; ``fill`` ends the last one with ones."""
        nonlocal acc, size
        if fill and size % 8:
            acc, size = (acc + 1 << 8 - size % 8) - 1, size + 8 - size % 8
        rest = size % 8
        out.extend((acc >> rest).to_bytes(size // 8, "big").replace(b"\xff", b"\xff\0"))
        acc, size = acc & ((1 << rest) - 1), rest

    for i, unit in enumerate(dc):
        if restart and i and i % restart == 0:
            flush(True)
            out += bytes([255, 0xD0 + (i // restart - 1) % 8])
            last = [0] * len(last)
        for c, d in zip(comps, unit, strict=True):
            code, length = _block(d - last[c], raw[at + coeff.itemsize : at + step])
            acc, size, last[c], at = acc << length | code, size + length, d, at + step
        if size > 1 << 12:
            flush(False)
    flush(True)
    return bytes(out)


def restarts(data: bytes) -> list[tuple[int, int, int | None]]:
    """(first coded unit, where its entropy-coded data starts, the marker before it) of each restart segment.

    Markers have to come in their cyclic order. Without an interval there are none.
    """
    info = inspect(data)
    if not info["restart"]:
        return []
    out, at = [(0, info["entropy"], None)], info["entropy"]
    while at + 1 < len(data):
        at = data.find(b"\xff", at)
        if at < 0 or at + 1 >= len(data):
            break
        code = data[at + 1]
        if code in (0, 0xFF):
            at += 1 + (code == 0)
        elif code == 0xD0 + (len(out) - 1) % 8:
            at += 2
            out.append((len(out) * info["restart"], at, code))
        elif 0xD0 <= code <= 0xD7:
            raise JpegError("unexpected_restart")
        else:
            break
    return out


class Scan:
    """What is needed of a sequential tile's scan for a window of its rows of coded units."""

    def __init__(self, data: bytes, top: int = 0, bottom: int | None = None, info: dict | None = None):
        """``top`` and ``bottom`` bound the window in source pixels; a unit's margin on either side is decoded, too."""
        self.info = info = info or plan(data)
        if info["sof"] not in ("Baseline8", "Extended8"):
            raise JpegError("not_implemented")
        if any(not 1 <= f <= 4 for p in info["parts"] for f in p[1:3]):
            raise JpegError("unsupported_sampling")
        n, (tall, self.wide, self.factors) = info["components"], _grid(info)
        scan = info["scan"]
        if len(scan) < 1 + 2 * n or scan[0] != n:
            raise JpegError("unsupported_scan")
        side = 8 * max(v for v, _ in self.factors)
        self.first = max(0, top // side - 1)
        self.last = tall if bottom is None else min(tall, -(-bottom // side) + 1)
        try:
            tables = [(info["huffman"][scan[2 + 2 * i] >> 4], info["huffman"][0x10 | scan[2 + 2 * i] & 15]) for i in range(n)]
            self.quant = [info["quant"][p[3]] for p in info["parts"]]
        except KeyError as e:
            raise JpegError("missing_table") from e
        self.comps = [c for c, (v, h) in enumerate(self.factors) for _ in range(v * h)]
        if "tables" not in info:
            info["tables"] = tuple(tuple((tuple(bits), tuple(values)) for bits, values in tables[c]) for c in self.comps)
        self.tables = info["tables"]
        body = data[info["entropy"] :]
        marks = [i for i in (m.start() for m in re.finditer(rb"\xff[^\x00\xff]", body, re.DOTALL))]
        stops = [m for m in marks if not 0xD0 <= body[m + 1] <= 0xD7]
        end = stops[0] if stops else len(body)
        cuts = [0, *(m + 2 for m in marks if m < end), end + 2]
        total, each = tall * self.wide, info["restart"] or tall * self.wide
        if -(-total // each) > len(cuts) - 1:
            raise JpegError("truncated")
        # segments that end above the window are never read, nor is anything below it
        low, high = self.first * self.wide, self.last * self.wide
        self.lanes, self.units, self.starts = [], [], []
        for p, (a, b) in enumerate(pairwise(cuts)):
            start, stop = p * each, min(total, (p + 1) * each, high)
            if stop > max(start, low):
                self.lanes.append(body[a : b - 2].replace(b"\xff\x00", b"\xff"))
                self.units.append(stop - start)
                self.starts.append(start)

    def window(self, coeff: np.ndarray, errors: list[str | None]) -> np.ndarray:
        """Lanes of coefficients -> the window's units x blocks x 64."""
        if any(errors):
            raise JpegError(next(filter(None, errors)))
        low, rows = self.first * self.wide, self.last - self.first
        if len(coeff) == 1 and self.starts[0] == low:
            return coeff[0][: rows * self.wide]
        every = np.zeros((rows * self.wide, len(self.comps), 64), coeff.dtype)
        for part, start, units in zip(coeff, self.starts, self.units, strict=True):
            a = max(start, low)
            every[a - low : start + units - low] = part[a - start : units]
        return every

    def blocks(self, every: np.ndarray) -> list[np.ndarray]:
        """Windows of scans of this geometry (any number x units x blocks x 64) -> per component rows x columns x 64 in natural order, dequantised."""
        out, at, rows = [], 0, self.last - self.first
        for q, (v, h) in zip(self.quant, self.factors, strict=True):
            natural = np.zeros((len(every), rows * self.wide, v * h, 64), np.int64)
            natural[..., ZIGZAG] = every[:, :, at : at + v * h] * q
            at += v * h
            out.append(natural.reshape(-1, rows, self.wide, v, h, 64).transpose(0, 1, 3, 2, 4, 5).reshape(-1, rows * v, self.wide * h, 64))
        return out


def decode_scans(scans: list[Scan]) -> list[np.ndarray | JpegError]:
    """Each scan's window of coefficients, or what is wrong with it; scans with equal tables are decoded side by side."""
    groups: dict[tuple, list[int]] = {}
    for i, s in enumerate(scans):
        groups.setdefault((tuple(s.comps), s.tables), []).append(i)
    out: list = [None] * len(scans)
    for (comps, tables), members in groups.items():
        try:
            made = {t: entropy.lookup(*t) for pair in set(tables) for t in pair}
            dc, ac = ([made[pair[j]] for pair in tables] for j in (0, 1))
        except entropy.ScanError as e:
            for i in members:
                out[i] = JpegError(str(e))
            continue
        some = 0
        while some < len(members):  # bounded memory: some 64 MB of coefficients at a time
            part, held = [], 0
            while some < len(members) and (not part or held < 1 << 18):
                part.append(members[some])
                held += sum(scans[members[some]].units) * len(comps)
                some += 1
            lanes = [x for i in part for x in scans[i].lanes]
            coeff, errors = entropy.decode(lanes, [u for i in part for u in scans[i].units], list(comps), dc, ac)
            at = 0
            for i in part:
                n = len(scans[i].lanes)
                try:
                    out[i] = scans[i].window(coeff[at : at + n], errors[at : at + n])
                except JpegError as e:
                    out[i] = e
                at += n
    return out


def coefficients(data: bytes) -> tuple[dict, list[np.ndarray]]:
    """(header, per component rows x columns x 64 of dequantised coefficients in natural order) of a sequential tile."""
    scan = Scan(data)
    (got,) = decode_scans([scan])
    if isinstance(got, JpegError):
        raise got
    return scan.info, [c[0] for c in scan.blocks(got[None])]


def _passes() -> dict[int, np.ndarray]:
    """The integer transform's one-dimensional pass, in 13-bit fixed point, by size of the result: rows of weights of the 8 inputs."""
    # fixed values: the public slow integer transform and its reduced forms; odd rows are weights of inputs 1, 3, 5 and 7
    even8 = np.array([[8192, 10703, 8192, 4433], [8192, 4433, -8192, -10704], [8192, -4433, -8192, 10704], [8192, -10703, 8192, -4433]])
    odd8 = np.array([[11363, 9633, 6437, 2260], [9633, -2259, -11362, -6436], [6437, -11362, 2261, 9633], [2260, -6436, 9633, -11363]])
    eight = np.zeros((8, 8), np.int64)
    eight[:4, ::2], eight[7:3:-1, ::2] = even8, even8
    eight[:4, 1::2], eight[7:3:-1, 1::2] = odd8, -odd8
    odd4 = np.array([[20995, 7373, -4926, -4176], [8697, -17799, 11893, -1730]])
    four = np.zeros((4, 8), np.int64)
    four[:, 0] = 1 << 14
    four[:, 2], four[:, 6] = [15137, -15137, -15137, 15137], [-6270, 6270, 6270, -6270]
    four[:2, 1::2], four[3:1:-1, 1::2] = odd4, -odd4
    two = np.zeros((2, 8), np.int64)
    two[:, 0] = 1 << 15
    two[0, 1::2] = [29692, -10426, 6967, -5906]
    two[1, 1::2] = -two[0, 1::2]
    return {8: eight, 4: four, 2: two}


_PASS = {k: v.astype(float) for k, v in _passes().items()}


def _samples(blocks: np.ndarray, denom: int) -> np.ndarray:
    """Planes from their blocks (... x rows x columns x 64) by the exact integer transform of that size; doubles hold every sum exactly."""
    k, (*lead, rows, cols, _) = 8 // denom, blocks.shape
    if k == 1:
        out = (blocks[..., 0] + 4) >> 3
    else:
        m, extra = _PASS[k], denom.bit_length() - 1
        one = np.floor((m @ blocks.reshape(*lead, rows, cols, 8, 8).astype(float) + (1 << (10 + extra))) / (1 << (11 + extra)))
        both = np.floor((one @ m.T + (1 << (17 + extra))) / (1 << (18 + extra)))
        out = both.swapaxes(-3, -2).reshape(*lead, rows * k, cols * k).astype(np.int64)
    return np.clip(out + 128, 0, 255)


def _wider(x: np.ndarray, shift: int, first: int, second: int) -> np.ndarray:
    """Triangle filter to twice the width; rounding alternates between left and right samples."""
    out = np.empty((*x.shape[:-1], 2 * x.shape[-1]), np.int64)
    out[..., ::2] = (3 * x + np.concatenate([x[..., :1], x[..., :-1]], -1) + first) >> shift
    out[..., 1::2] = (3 * x + np.concatenate([x[..., 1:], x[..., -1:]], -1) + second) >> shift
    return out


def upsample(plane: np.ndarray, across: int, down: int) -> np.ndarray:
    """Chroma planes at full size: triangle filters for halves across or both ways, repeated samples otherwise."""
    if (across, down) == (2, 1):
        return _wider(plane, 2, 1, 2)
    if (across, down) == (2, 2):
        up, under = np.concatenate([plane[..., :1, :], plane[..., :-1, :]], -2), np.concatenate([plane[..., 1:, :], plane[..., -1:, :]], -2)
        out = np.empty((*plane.shape[:-2], 2 * plane.shape[-2], 2 * plane.shape[-1]), np.int64)
        out[..., ::2, :], out[..., 1::2, :] = _wider(3 * plane + up, 4, 8, 7), _wider(3 * plane + under, 4, 8, 7)
        return out
    return plane.repeat(down, -2).repeat(across, -1)


def _planes(scan: Scan, every: np.ndarray, denom: int) -> tuple[int, np.ndarray]:
    """(the first row's place on the reduced grid, scans x components x rows x width) of windows of scans of one geometry."""
    info = scan.info
    v, h = (max(f[i] for f in scan.factors) for i in (0, 1))
    if any(v % a or h % b for a, b in scan.factors):
        raise JpegError("unsupported_sampling")
    top = scan.first * 8 * v // denom
    tall, wide = min(-(-info["height"] // denom), scan.last * 8 * v // denom) - top, -(-info["width"] // denom)
    planes = []
    for c, (a, b) in zip(scan.blocks(every), scan.factors, strict=True):
        own = _samples(c, denom)[:, : -(-tall * a // v), : -(-wide * b // h)]
        planes.append(upsample(own, h // b, v // a)[:, :tall, :wide])
    return top, np.stack(planes, 1).astype(np.uint8)


def decode(data: bytes, denom: int = 1) -> tuple[dict, np.ndarray]:
    """(header, components x height x width) of a sequential tile, at full size or reduced by 2, 4 or 8."""
    if denom not in (1, 2, 4, 8):
        raise JpegError("unsupported_scale")
    scan = Scan(data)
    (got,) = decode_scans([scan])
    if isinstance(got, JpegError):
        raise got
    return scan.info, _planes(scan, got[None], denom)[1][0]


def to_rgb(planes: np.ndarray, colorspace: str) -> np.ndarray:
    """... x height x width x 3; 16-bit fixed point, rounded to nearest, where the components are YCbCr."""
    if colorspace == "Gray":
        return np.moveaxis(planes[..., [0, 0, 0], :, :], -3, -1)
    if colorspace == "Rgb":
        return np.moveaxis(planes, -3, -1)
    if colorspace != "YCbCr":
        raise JpegError("unsupported_colorspace")
    y, b, r = np.moveaxis(planes, -3, 0).astype(np.int64)
    b, r, half = b - 128, r - 128, 1 << 15
    out = np.stack([y + ((91881 * r + half) >> 16), y + ((-22554 * b - 46802 * r + half) >> 16), y + ((116130 * b + half) >> 16)], -1)
    return out.clip(0, 255).astype(np.uint8)


class Job:
    """A tile's region to be decoded; checked, and its scan cut to the region's rows, before any entropy decoding."""

    def __init__(self, data: bytes, fmt: str = "Rgb8", roi: tuple[int, int, int, int] | None = None, denom: int = 1, alpha: int = 255):
        if fmt not in ("Rgb8", "Gray8", "Rgba8"):
            raise JpegError("unsupported_bit_depth")
        if fmt == "Rgba8" and denom != 1:
            raise JpegError("downscale_unsupported")
        if denom not in (1, 2, 4, 8):
            raise JpegError("unsupported_scale")
        info = plan(data)
        x, y, w, h = roi or (0, 0, info["width"], info["height"])
        if min(x, y, w, h) < 0 or x + w > info["width"] or y + h > info["height"]:
            raise JpegError("invalid_region")
        self.fmt, self.denom, self.alpha = fmt, denom, alpha
        x0, y0 = x // denom, y // denom
        x1, y1 = (-(-(x + w) // denom), -(-(y + h) // denom)) if w and h else (x0, y0)
        self.rect = (x0, y0, x1 - x0, y1 - y0)
        self.scan = Scan(data, y0 * denom, y1 * denom, info)

    def like(self) -> tuple:
        """Jobs that agree in this are transformed together."""
        s = self.scan
        quant = tuple(np.asarray(q).tobytes() for q in s.quant)
        return (self.fmt, self.denom, self.alpha, s.info["width"], s.info["height"], s.info["colorspace"], s.first, s.last, tuple(s.factors), quant)

    def whole(self, every: np.ndarray) -> tuple[int, np.ndarray]:
        """(first row, jobs x rows x width x channels) of the windows of jobs that are alike."""
        top, planes = _planes(self.scan, every, self.denom)
        colorspace = self.scan.info["colorspace"]
        if self.fmt == "Gray8" and colorspace in ("Gray", "YCbCr"):
            return top, planes[:, 0, :, :, None]
        out = to_rgb(planes, colorspace)
        if self.fmt == "Gray8":
            r, g, b = np.moveaxis(out.astype(np.int64), -1, 0)
            out = ((77 * r + 150 * g + 29 * b + 128) >> 8)[..., None].astype(np.uint8)
        elif self.fmt == "Rgba8":
            out = np.concatenate([out, np.full((*out.shape[:3], 1), self.alpha, np.uint8)], -1)
        return top, out


def decode_many(jobs: list[Job]) -> list[np.ndarray | JpegError]:
    """Each job's height x width x channels of bytes, or what is wrong with it."""
    out: list = decode_scans([j.scan for j in jobs])
    alike: dict[tuple, list[int]] = {}
    for i, j in enumerate(jobs):
        if not isinstance(out[i], JpegError):
            alike.setdefault(j.like(), []).append(i)
    for members in alike.values():
        try:
            top, whole = jobs[members[0]].whole(np.stack([out[i] for i in members]))
        except JpegError as e:
            for i in members:
                out[i] = e
            continue
        for n, i in enumerate(members):
            x, y, w, h = jobs[i].rect
            out[i] = np.ascontiguousarray(whole[n, y - top : y - top + h, x : x + w])
    return out


def decode_pixels(data: bytes, fmt: str = "Rgb8", roi: tuple[int, int, int, int] | None = None, denom: int = 1, alpha: int = 255) -> tuple[tuple[int, int, int, int], np.ndarray]:
    """(the decoded rectangle on the reduced grid, height x width x channels of bytes).

    ``roi`` is (x, y, w, h) in source pixels; its reduced rectangle starts rounded down and ends
    rounded up. Formats are Rgb8, Gray8 and, at full size, Rgba8.
    """
    job = Job(data, fmt, roi, denom, alpha)
    (got,) = decode_many([job])
    if isinstance(got, JpegError):
        raise got
    return job.rect, got


DECODED = "idx long, x long, y long, w long, h long, pixels binary, error string"


def decode_jobs(jobs: DataFrame, fmt: str = "Rgb8") -> DataFrame:
    """Jobs (idx, payload, x, y, w, h, denom) -> (idx, decoded rectangle, tight interleaved pixels, error).

    A null x asks for the whole tile, a null denom for full size. Jobs are independent rows; idx
    keeps their order, and a failed one has only its error.
    """

    def one(r: dict) -> Job | JpegError:
        try:
            return Job(r["payload"] or b"", fmt, None if r["x"] is None else (r["x"], r["y"], r["w"], r["h"]), r["denom"] or 1)
        except JpegError as e:
            return e

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in (whole.slice(i, 1024) for whole in batches for i in range(0, whole.num_rows, 1024)):
            rows, wanted = [], b.to_pylist()
            jobs_ = [one(r) for r in wanted]
            pixels = iter(decode_many([j for j in jobs_ if isinstance(j, Job)]))
            for r, job in zip(wanted, jobs_, strict=True):
                got = next(pixels) if isinstance(job, Job) else job
                rows.append((r["idx"], *(None,) * 5, str(got)) if isinstance(got, JpegError) else (r["idx"], *job.rect, got.tobytes(), None))
            kinds = [*[pa.int64()] * 5, pa.binary(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], [x.split()[0] for x in DECODED.split(", ")])

    return jobs.select("idx", "payload", *(F.col(c).cast("long") for c in ("x", "y", "w", "h", "denom"))).mapInArrow(run, DECODED)


def decode_rows(decoded: DataFrame, channels: int) -> DataFrame:
    """Decoded tiles as one row of pixels each: (idx, y, row)."""
    tall = F.col("h").cast("int")
    wide = (F.col("w") * channels).cast("int")
    return decoded.filter("h > 0 and w > 0").select("idx", F.explode(F.sequence(F.lit(0), tall - 1)).alias("y"), "pixels", wide.alias("_n")).select("idx", "y", F.substring("pixels", F.col("y") * F.col("_n") + 1, F.col("_n")).alias("row"))


def flat_tiles(rows: DataFrame, width: int, height: int) -> DataFrame:
    """(idx, payload): 4:2:0 tiles of one colour from (idx, luma, cb, cr), at the finest quantiser."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            keys, *parts = (b.column(i).to_pylist() for i in range(4))
            colours, some = np.array(parts, np.uint8).T[:, :, None, None], max(1, (1 << 18) // (width * height))
            out = [x for i in range(0, len(keys), some) for x in encode_many(np.broadcast_to(colours[i : i + some], (len(keys[i : i + some]), 3, height, width)), 100, 2, (2, 2))]
            yield pa.RecordBatch.from_arrays([pa.array(keys, pa.int64()), pa.array(out, pa.binary())], ["idx", "payload"])

    return rows.select("idx", "luma", "cb", "cr").mapInArrow(run, "idx long, payload binary")


HEADER = "width long, height long, components int, bit_depth int, sof string, colorspace string, restart long, error string"


def inspect_tiles(tiles: DataFrame, id_col: str, payload: str = "payload") -> DataFrame:
    """Header facts per tile; a broken or null payload has only an error."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for data in b.column(1).to_pylist():
                try:
                    i = inspect(data or b"")
                    rows.append((i["width"], i["height"], i["components"], i["bit_depth"], i["sof"], i["colorspace"], i["restart"], None))
                except JpegError as e:
                    rows.append((None,) * 7 + (str(e),))
            kinds = [pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.int64(), pa.string()]
            cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)]
            yield pa.RecordBatch.from_arrays([b.column(0), *cols], ["id", *(c.split()[0] for c in HEADER.split(", "))])

    return tiles.select(F.col(id_col).cast("long").alias("id"), payload).mapInArrow(run, "id long, " + HEADER)


def round_trip(vectors: DataFrame, quality: int = 95) -> DataFrame:
    """Grey tiles of 64 columns and one to three equal rows: encode, inspect, decode, compare within 24 grey levels."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for i, v in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                row = np.clip(np.floor(np.array(v, float) * 128) + 128, 0, 255).astype(np.uint8)
                tile = np.tile(row, (1, 1 + i % 3, 1))
                try:
                    info, got = decode(encode(tile, quality, restart=3))
                    near = bool(np.abs(got.astype(int) - tile.astype(int)).max() <= 24)
                    rows.append((i, info["width"], info["height"], info["components"], info["bit_depth"], info["sof"], info["colorspace"], None, near))
                except JpegError as e:
                    rows.append((i, *(None,) * 6, str(e), False))
            kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.bool_()]
            names = ["vec_id", "width", "height", "components", "bit_depth", "sof", "colorspace", "error", "close"]
            yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], t) for j, t in enumerate(kinds)], names)

    return vectors.select("vec_id", "embedding").mapInArrow(run, "vec_id long, width long, height long, components int, bit_depth int, sof string, colorspace string, error string, close boolean")
