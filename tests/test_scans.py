"""Entropy decoding side by side and one by one, windows of rows, and the integer transform."""

import numpy as np
import pytest

from tilewright.operators import entropy, jpeg


def textured(seed, comps=3, height=45, width=61):
    rng = np.random.default_rng(seed)
    y, x = np.mgrid[0:height, 0:width]
    return np.stack([(x * (c + 2) + y * 3 + rng.integers(0, 60, (height, width))) % 256 for c in range(comps)]).astype(np.uint8)


def slow_bits(data):
    for byte in data + b"\0" * 8:
        for i in range(7, -1, -1):
            yield byte >> i & 1


def slow_scan(scan):
    """Bit by bit, with a dictionary of codes."""
    out = []
    for data, units in zip(scan.lanes, scan.units, strict=True):
        bits, last, lane = slow_bits(data), {}, []
        number = lambda n: sum(next(bits) << (n - 1 - i) for i in range(n))  # noqa: B023, E731

        def symbol(table):
            codes, code, at = {}, 0, 0
            for length, n in enumerate(table[0], 1):
                for _ in range(n):
                    codes[code, length] = table[1][at]
                    code, at = code + 1, at + 1
                code <<= 1
            code = 0
            for length in range(1, 17):
                code = code << 1 | next(bits)  # noqa: B023
                if (code, length) in codes:
                    return codes[code, length]

        signed = lambda n: 0 if not n else v if (v := number(n)) >> (n - 1) else v - (1 << n) + 1  # noqa: B023, E731
        for _ in range(units):
            unit = []
            for c, (dc, ac) in zip(scan.comps, scan.tables, strict=True):
                row = [0] * 64
                last[c] = row[0] = last.get(c, 0) + signed(symbol(dc))
                k = 1
                while k < 64 and (s := symbol(ac)):
                    k += s >> 4
                    if s & 15:
                        row[k] = signed(s & 15)
                    k += 1
                unit.append(row)
            lane.append(unit)
        out.append(lane)
    return out


@pytest.mark.parametrize("sampling,restart", [((1, 1), 0), ((2, 1), 3), ((2, 2), 2), ((2, 2), 0)])
def test_lanes(sampling, restart, monkeypatch):
    scans = [jpeg.Scan(jpeg.encode(textured(i), 80, restart, sampling)) for i in range(4)]
    few = jpeg.decode_scans(scans)
    monkeypatch.setattr(entropy, "SIDE_BY_SIDE", 1)
    many = jpeg.decode_scans(scans)
    assert all((a == b).all() for x, y in zip(few, many, strict=True) for a, b in zip(x, y, strict=True))
    made = {t: entropy.lookup(*t) for pair in scans[0].tables for t in pair}
    got, errors = entropy.decode(scans[0].lanes, scans[0].units, scans[0].comps, *([made[p[j]] for p in scans[0].tables] for j in (0, 1)))
    assert not any(errors)
    for lane, want in zip(got, slow_scan(scans[0]), strict=True):
        assert (lane[: len(want)] == np.array(want)).all()


@pytest.mark.parametrize("limit", [1, 1000])
def test_broken_scans(limit, monkeypatch):
    monkeypatch.setattr(entropy, "SIDE_BY_SIDE", limit)
    good = jpeg.encode(textured(1), 90)
    bad = [good[: len(good) // 2], good[:-40] + b"\xff\xd9", good]
    got = jpeg.decode_scans([jpeg.Scan(x) for x in bad])
    assert [isinstance(x, jpeg.JpegError) for x in got] == [True, True, False]


@pytest.mark.parametrize("restart", [0, 4])
def test_windows_of_rows(restart):
    data = jpeg.encode(textured(5, height=120), 85, restart, (2, 2))
    for denom in (1, 2, 4, 8):
        _, whole = jpeg.decode_pixels(data, "Rgb8", None, denom)
        for roi in ((3, 0, 20, 5), (0, 50, 61, 9), (10, 111, 30, 9), (5, 33, 1, 1)):
            (x, y, w, h), part = jpeg.decode_pixels(data, "Rgb8", roi, denom)
            assert (part == whole[y : y + h, x : x + w]).all()
    assert sum(jpeg.Scan(data, 50, 59).units) < sum(jpeg.Scan(data).units)


def slow_transform(block):
    """The public slow integer transform, a value at a time, 13-bit constants as fixed values."""

    def one(i0, i1, i2, i3, i4, i5, i6, i7, shift):
        z1 = (i2 + i6) * 4433
        e2, e3 = z1 - i6 * 15137, z1 + i2 * 6270
        e0, e1 = (i0 + i4) << 13, (i0 - i4) << 13
        even = e0 + e3, e1 + e2, e1 - e2, e0 - e3
        z5 = (i7 + i3 + i5 + i1) * 9633
        a, b = (i7 + i1) * -7373, (i5 + i3) * -20995
        c, d = (i7 + i3) * -16069 + z5, (i5 + i1) * -3196 + z5
        odd = i1 * 12299 + a + d, i3 * 25172 + b + c, i5 * 16819 + b + d, i7 * 2446 + a + c
        half = 1 << (shift - 1)
        return [(x + y + half) >> shift for x, y in zip(even, odd, strict=True)] + [(x - y + half) >> shift for x, y in zip(even[::-1], odd[::-1], strict=True)]

    cols = [one(*(int(block[8 * r + c]) for r in range(8)), 11) for c in range(8)]
    return np.array([one(*(cols[c][r] for c in range(8)), 18) for r in range(8)]) + 128


def test_integer_transform():
    rng = np.random.default_rng(3)
    blocks = (rng.integers(-300, 300, (2, 3, 64)) * (rng.random((2, 3, 64)) < 0.3)).astype(np.int64)
    got = jpeg._samples(blocks, 1)
    for r in range(2):
        for c in range(3):
            assert (got[8 * r : 8 * r + 8, 8 * c : 8 * c + 8] == slow_transform(blocks[r, c]).clip(0, 255)).all()
    flat = np.zeros((1, 1, 64), np.int64)
    for dc in (-2000, -37, 0, 5, 900):
        flat[0, 0, 0] = dc
        assert {int(x) for d in (1, 2, 4, 8) for x in jpeg._samples(flat, d).ravel()} == {min(255, max(0, ((dc + 4) >> 3) + 128))}
