"""Nearest neighbours where rows share ids, against brute force."""

import numpy as np

from tilewright.llm import neighbours


def test_rows_that_share_an_id(spark):
    x = np.random.default_rng(11).normal(size=(120, 8)).astype(np.float32)
    ids = [0, *(1 + i % 3 for i in range(119))]
    frame = spark.createDataFrame([(i, v.tolist()) for i, v in zip(ids, x, strict=True)], "vec_id long, embedding array<float>").coalesce(1)
    got = sorted((r["rank"], r.vec_id, r.score) for r in neighbours.nearest(frame, every=100, k=10).collect())
    d = np.sqrt(((x.astype(float) - x[0].astype(float)) ** 2).sum(1))[1:]
    want = np.lexsort((ids[1:], d))[:10]
    assert [r[1] for r in got] == [ids[1 + i] for i in want]
    assert np.allclose([r[2] for r in got], d[want])
