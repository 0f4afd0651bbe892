import numpy as np
import pytest

from tilewright.operators import containers, jpeg


@pytest.mark.parametrize("n", [0, 1, 255, 5000, 70000])
def test_lzw(n):
    data = np.random.default_rng(n).integers(0, 4, n).astype(np.uint8).tobytes()
    assert containers.lzw(containers.lzw_pack(data), n) == data
    if n:
        with pytest.raises(containers.TooSmall):
            containers.lzw(containers.lzw_pack(data), n - 1)


def test_lzw_streams_of_others():
    """A clear code may come early, and streams without one start."""
    two = containers.lzw_pack(b"ab" * 9)
    bits = "".join(f"{c:09b}" for c in (97, 258, 256, 98, 256, 99, 257)).ljust(64, "0")
    assert containers.lzw(int(bits, 2).to_bytes(8, "big"), 9) == b"aaabc"
    with pytest.raises(ValueError, match="invalid LZW code"):
        containers.lzw(int(f"{259:09b}".ljust(16, "0"), 2).to_bytes(2, "big"), 9)
    with pytest.raises(ValueError, match="without a stop"):
        containers.lzw(two[:-2], 99)


def test_raw_deflate_fallback():
    import zlib

    c = zlib.compressobj(wbits=-15)
    data = c.compress(b"abc" * 100) + c.flush()
    assert containers.deflate(data, 300) == b"abc" * 100
    with pytest.raises(ValueError):
        containers.deflate(b"\xff\xff\xff", 10)


@pytest.mark.parametrize("comps,restart", [(1, 0), (1, 2), (3, 0), (3, 5)])
def test_jpeg_round_trip(comps, restart):
    y, x = np.mgrid[0:29, 0:43]
    tile = np.stack([(x * (c + 2) + y * 3) % 256 // 2 + 40 for c in range(comps)]).astype(np.uint8)
    info, got = jpeg.decode(jpeg.encode(tile, 98, restart))
    assert (info["width"], info["height"], info["components"], info["restart"]) == (43, 29, comps, restart)
    assert np.abs(got.astype(int) - tile).max() <= 12


def test_jpeg_errors():
    good = jpeg.encode(np.zeros((1, 8, 8), np.uint8))
    for bad, why in ((b"", "missing_soi"), (b"\xff\xd8", "truncated"), (good[:20], "truncated")):
        with pytest.raises(jpeg.JpegError, match=why):
            jpeg.inspect(bad)


def test_tiles_coded_together_or_alone():
    """Tiles of one shape are transformed at once, and give the bytes they give alone."""
    r = np.random.default_rng(4)
    for n, restart, sampling in ((1, 0, (1, 1)), (3, 2, (2, 2)), (3, 0, (2, 1))):
        tiles = r.integers(0, 256, (5, n, 21, 34)).astype(np.uint8)
        tiles[1] = 90
        assert jpeg.encode_many(tiles, 80, restart, sampling) == [jpeg.encode(t, 80, restart, sampling) for t in tiles]


def test_regions_are_decoded_by_all_cores(spark):
    """Tiles of one small file were coded and decoded by one task."""
    from tilewright import catalog

    assert catalog.jpeg_region_scaled_decode(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism
