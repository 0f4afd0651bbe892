import numpy as np
import pyarrow as pa
import pytest

from tilewright.operators import codestream, jpeg
from tilewright.sources import frames


@pytest.mark.parametrize("table", [True, False])
def test_frames(table):
    payloads = [b"abc" * 50000, b"", b"xy"] if table else [b"ab", b"c"]
    got = frames.frames(frames.encapsulate(payloads, table))
    assert [g.rstrip(b"\0") for g in got] == payloads
    assert len(frames.frames(frames.encapsulate(payloads, table), 1)) == 1
    assert frames.frames(frames.encapsulate([b"q" * 10], False, 4)) == [b"q" * 10]


def test_frame_errors():
    good = frames.encapsulate([b"ab", b"cd"])
    many = frames.encapsulate([b"abcdef", b"cd"], False, 2)
    for bad, why in ((b"", "missing_preamble"), (good[:150], "truncated"), (good[:140], "truncated"), (good[:142], "no_pixel_data"), (many, "ambiguous_frames")):
        with pytest.raises(frames.FrameError, match=why):
            frames.frames(bad)


def test_frame_rows(spark):
    rows = spark.createDataFrame([(1, bytearray(frames.encapsulate([b"ab", b"cd"]))), (2, None)], "id long, payload binary")
    got = sorted(frames.dicom_frames(rows, "id").collect(), key=lambda r: (r.id, r.frame))
    assert [(r.id, r.frame, r.error) for r in got] == [(1, 0, None), (1, 1, None), (2, 0, "missing_preamble")]
    assert frames.dicom_frames(rows.limit(0), "id").count() == 0


def test_pieces_bound_bytes_and_keep_rows():
    """A worker held a whole Arrow batch of texts, files and frames at once."""
    from tilewright.operators.pieces import pieces

    texts = ["a" * n for n in (3, 0, 9, 50, 1, 1, 1)] + [None] * 30
    b = pa.RecordBatch.from_arrays([pa.array(range(37)), pa.array(texts)], ["id", "text"])
    got = list(pieces(iter([b, b.slice(0, 0)]), 20))
    assert [r for p in got for r in p.column(0).to_pylist()] == list(range(37))
    assert all(p.num_rows == 1 or sum(len(t or "") for t in p.column(1).to_pylist()) <= 20 for p in got)


def test_frame_query_keeps_repeated_and_null_ids(spark, tmp_path):
    """Lengths were joined by id, which lost null ids, multiplied repeated ones, and shuffled every payload."""
    from tilewright import catalog

    spark.createDataFrame([(1, "abc"), (1, "z"), (None, "xy"), (2, None)], "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = catalog.dicom_frame_extraction(spark, str(tmp_path))
    assert sorted((r.id or 0, r.frame, r.n_bytes) for r in got.collect()) == [(0, 0, 2), (0, 1, 4), (1, 0, 2), (1, 0, 4), (1, 1, 4), (1, 1, 4)]
    assert "Join" not in got._jdf.queryExecution().optimizedPlan().toString()


def test_folder(spark, tmp_path):
    data = codestream.write_codestream(9, 9, 1, 8, 64, 0, True, False)
    for name, body in (("b.J2K", data), ("a.jp2", codestream.wrap(data, 17)), ("c.jpg", b"\xff\xd8"), ("d.txt", b"")):  # Spark's reader leaves out empty files
        (tmp_path / name).write_bytes(body)
    got = {r.path.rsplit("/", 1)[-1]: (r.codec, r.supported) for r in frames.files(spark, str(tmp_path)).collect()}
    assert got == {"a.jp2": ("J2k", True), "b.J2K": ("J2k", True), "c.jpg": ("Jpeg", False)}
    assert [r.path.rsplit("/", 1)[-1] for r in frames.first_tiles(spark, str(tmp_path), 1).collect()] == ["a.jp2"]


def test_codestream_errors():
    good = codestream.write_codestream(100, 70, 3, 8, 64, 2, True, True)
    boxed = codestream.wrap(good, 16)
    for bad, why in ((b"", "missing_soc"), (good[:30], "truncated"), (good[:2] + good[51:], "missing_size"), (boxed[:40], "invalid_box"), (boxed[:12] + boxed[32:], "invalid_signature")):
        with pytest.raises(codestream.CodestreamError, match=why):
            codestream.inspect(bad)
    assert codestream.inspect(boxed)["colorspace"] == "SRgb"


def smooth(comps):
    y, x = np.mgrid[0:45, 0:61]
    return np.stack([60 + c * 30 + x + y for c in range(comps)]).clip(0, 255).astype(np.uint8)


@pytest.mark.parametrize("sampling", [(1, 1), (2, 1), (2, 2), (1, 2)])
def test_subsampled(sampling):
    tile = smooth(3)
    data = jpeg.encode(tile, 98, 3, sampling)
    info, got = jpeg.decode(data)
    assert np.abs(got.astype(int) - tile).max() <= 6
    assert len(jpeg.restarts(data)) == -(-np.prod(jpeg._grid(info)[:2]) // 3)
    for denom in (2, 4, 8):
        _, small = jpeg.decode(data, denom)
        want = np.pad(tile, ((0, 0), (0, -45 % denom), (0, -61 % denom)), "edge").reshape(3, -(-45 // denom), denom, -(-61 // denom), denom).mean((2, 4))
        assert small.shape == want.shape and np.abs(small - want)[:, :-1, :-1].max() <= 8


def test_regions():
    data = jpeg.encode(smooth(3), 95, 0, (2, 2))
    whole = jpeg.decode_pixels(data)[1]
    rect, part = jpeg.decode_pixels(data, "Rgba8", (5, 7, 20, 11), alpha=9)
    assert rect == (5, 7, 20, 11) and (part[..., :3] == whole[7:18, 5:25]).all() and (part[..., 3] == 9).all()
    rect, part = jpeg.decode_pixels(data, "Gray8", (5, 7, 20, 11), 4)
    assert rect == (1, 1, 6, 4) and part.shape == (4, 6, 1)
    for args, why in ((("Rgb16",), "unsupported_bit_depth"), (("Rgba8", None, 2), "downscale_unsupported"), (("Rgb8", (60, 0, 2, 1)), "invalid_region")):
        with pytest.raises(jpeg.JpegError, match=why):
            jpeg.decode_pixels(data, *args)


def test_rows(spark):
    jobs = spark.createDataFrame([(1, bytearray(jpeg.encode(smooth(1))), None, None, None, None, None), (2, None, 0, 0, 1, 1, 2)], "idx long, payload binary, x long, y long, w long, h long, denom long")
    out = jpeg.decode_jobs(jobs, "Gray8")
    assert [r.error for r in out.orderBy("idx").collect()] == [None, "missing_soi"]
    rows = jpeg.decode_rows(out, 1).orderBy("y").collect()
    assert len(rows) == 45 and all(len(r.row) == 61 for r in rows)
    assert b"".join(bytes(r.row) for r in rows) == bytes(out.filter("idx = 1").first().pixels)


def test_estimates(spark, tmp_path):
    from tilewright.operators import reports

    for name, median in (("group/b", 5.0), ("group/a", 7.5), ("skipped", None)):
        d = tmp_path / "criterion" / name / "new"
        d.mkdir(parents=True)
        body = {"median": {"point_estimate": median, "confidence_interval": {"lower_bound": median - 1, "upper_bound": median + 1}}} if median else {}
        (d / "estimates.json").write_text(__import__("json").dumps(body))
        (d / "other.json").write_text("{}")
    got = [tuple(r) for r in reports.discover_estimates(spark, str(tmp_path / "criterion")).collect()]
    assert got == [("group/a", 7.5, 6.5, 8.5), ("group/b", 5.0, 4.0, 6.0)]
