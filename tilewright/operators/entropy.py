"""Entropy-coded JPEG scans, many at a time.

Every scan, or restart segment of one, is a lane. Lanes of tiles with equal tables go forward side
by side in numpy, one symbol each at a step: a 16-bit window into a lane's bits gives the code's
length and symbol from a table, and its value follows in the same window. A few lanes are decoded
one after another instead, by the same tables.
"""

from __future__ import annotations

import numpy as np

#: From so many lanes on, steps over all of them are the faster way.
SIDE_BY_SIDE = 48
_PAD = 24


class ScanError(ValueError):
    pass


def lookup(bits: tuple[int, ...], values: tuple[int, ...]) -> np.ndarray:
    """For every 16-bit window: code length << 8 | symbol, 0 where no code fits."""
    out = np.zeros(1 << 16, np.int32)
    code = at = 0
    for length, n in enumerate(bits, 1):
        for _ in range(n):
            low = code << (16 - length)
            if low + (1 << (16 - length)) > 1 << 16:
                raise ScanError("invalid_table")
            out[low : low + (1 << (16 - length))] = length << 8 | values[at]
            code, at = code + 1, at + 1
        code <<= 1
    return out


def _one(data: bytes, units: int, comps: list[int], dc: list[list[int]], ac: list[list[int]], out: np.ndarray) -> None:
    """One lane into ``out`` (units x blocks x 64, zig-zag order)."""
    last = [0] * (max(comps) + 1)
    end = len(data) * 8 + 64
    data = data + b"\0" * _PAD
    acc, size, at = 0, 0, 0

    def value(n: int) -> int:
        v = acc >> (size - n) & ((1 << n) - 1)
        return v if v >> (n - 1) else v - (1 << n) + 1

    for u in range(units):
        for b, comp in enumerate(comps):
            row = out[u, b]
            k, tables = 0, dc[b]
            while k < 64:
                if size < 32:
                    if at * 8 - size > end:
                        raise ScanError("truncated")
                    acc = (acc & ((1 << size) - 1)) << 48 | int.from_bytes(data[at : at + 6].ljust(6, b"\0"), "big")
                    size, at = size + 48, at + 6
                entry = tables[acc >> (size - 16) & 0xFFFF]
                if not entry:
                    raise ScanError("invalid_code")
                size -= entry >> 8
                symbol = entry & 255
                if tables is dc[b] and not k:
                    if symbol > 16:
                        raise ScanError("invalid_code")
                    if symbol:
                        last[comp] += value(symbol)
                        size -= symbol
                    row[0] = last[comp]
                    k, tables = 1, ac[b]
                    continue
                if not symbol:
                    break
                k += symbol >> 4
                n = symbol & 15
                if n:
                    if k > 63:
                        raise ScanError("invalid_run")
                    row[k] = value(n)
                    size -= n
                k += 1
    if at * 8 - size > end:
        raise ScanError("truncated")


def _all(lanes: list[bytes], units: np.ndarray, comps: list[int], dc: np.ndarray, ac: np.ndarray, out: np.ndarray) -> list[str | None]:
    size = np.array([len(x) for x in lanes], np.int64)
    start = np.cumsum(size + _PAD) - size - _PAD
    words = np.frombuffer(b"".join(x + b"\0" * _PAD for x in lanes), np.uint8)
    words = np.ndarray((len(words) - 7,), ">u8", words, 0, (1,))
    tables = np.concatenate([dc, ac]).reshape(-1)  # of block b: row b, and row blocks + b
    comp, blocks = np.array(comps), len(comps)
    errors: list[str | None] = [None] * len(lanes)
    pred = np.zeros((len(lanes), max(comps) + 1), np.int64)
    flat, per = out.reshape(-1), out.shape[1] * out.shape[2] * 64
    lane = np.flatnonzero(units > 0)
    pos, end = start[lane] * 8, (start + size)[lane] * 8 + 64
    block = np.zeros(len(lane), np.int64)  # number of the block within the lane
    k = np.zeros(len(lane), np.int64)
    stop = units[lane] * blocks
    while len(lane):
        w = words[pos >> 3].astype(np.uint64) << (pos & 7).astype(np.uint64)
        b, first = block % blocks, k == 0
        entry = tables[((np.where(first, b, b + blocks)) << 16) + (w >> np.uint64(48)).astype(np.int64)]
        length, symbol = entry >> 8, entry & 255
        n = np.where(first, symbol, symbol & 15).astype(np.int64)
        bad = (entry == 0) | (n > 16) | (pos > end)
        n = np.minimum(n, 16)
        v = ((w << length.astype(np.uint64)) >> np.uint64(1) >> (63 - n).astype(np.uint64)).astype(np.int64)
        v = np.where((n > 0) & (v < (1 << np.maximum(n - 1, 0))), v - (1 << n) + 1, v)
        pos = pos + length + n
        now, c = lane[first], comp[b[first]]
        pred[now, c] += v[first]
        v[first] = pred[now, c]
        k = k + np.where(first, 0, symbol >> 4)
        put = first | (n > 0)
        over = put & (k > 63)
        bad |= over
        put &= ~bad
        flat[lane[put] * per + block[put] * 64 + k[put]] = v[put]
        k = np.where(~first & (symbol == 0), 64, k + 1)
        done = k >= 64
        block, k = block + done, np.where(done, 0, k)
        if bad.any():
            for i in np.flatnonzero(bad):
                errors[lane[i]] = "invalid_run" if over[i] else "truncated" if pos[i] > end[i] else "invalid_code"
        go = (block < stop) & ~bad
        if not go.all():
            lane, pos, end, block, k, stop = (x[go] for x in (lane, pos, end, block, k, stop))
    return errors


def decode(lanes: list[bytes], units: list[int], comps: list[int], dc: list[np.ndarray], ac: list[np.ndarray]) -> tuple[np.ndarray, list[str | None]]:
    """(lanes x most units x blocks x 64 of coefficients in zig-zag order, an error or None per lane).

    ``lanes`` hold unstuffed bytes without markers; ``comps``, ``dc`` and ``ac`` are, per block of a
    coded unit, its component and lookup tables. A lane that ends early reads zero bits, as far as
    eight bytes beyond its end.
    """
    out = np.zeros((len(lanes), max(units, default=0), len(comps), 64), np.int32)
    if len(lanes) >= SIDE_BY_SIDE:
        return out, _all(lanes, np.array(units), comps, np.stack(dc), np.stack(ac), out)
    errors: list[str | None] = []
    lists = {id(t): t.tolist() for t in (*dc, *ac)}
    for i, data in enumerate(lanes):
        try:
            _one(data, units[i], comps, [lists[id(t)] for t in dc], [lists[id(t)] for t in ac], out[i])
            errors.append(None)
        except ScanError as e:
            errors.append(str(e))
    return out, errors
