"""Packet orders from headers alone against a sort of all packets: repeated and null tiles, resolutions without a step, bounds, and what is shuffled."""

import pytest
from pyspark.sql import functions as F

from tilewright import catalog
from tilewright.operators import packets


def some_bounds():
    return {"res": (F.lit(1), F.lit(9)), "layer": (F.lit(-1), F.lit(2)), "comp": (F.lit(0), 1 + F.col("tile") % 2)}


@pytest.mark.parametrize("order", packets.ORDERS)
@pytest.mark.parametrize("bounds", [dict, some_bounds])
def test_placed(spark, order, bounds):
    bounds = bounds()
    rows = [(1, 2, 3, 3, 9), (1, 2, 3, 3, 9), (1, 1, 9, 2, 6), (2, 1, 1, 1, 1), (3, 0, 2, 2, 2), (4, 2, None, 2, 2), (None, 1, 2, 2, 5), (None, 1, 2, 2, 5), (5, 1, 9, 1, 5), (6, 2, 9, 3, 23), (7, 3, 4, 3, 8), (8, 1, 8, 2, 1)]
    t = spark.createDataFrame(rows, "tile long, l int, r long, c int, p long")
    sides = [F.col(x) for x in "lrcp"]
    want = packets.ordered(packets.bounded(packets.grid(t, "tile", *sides), **bounds), "tile", order)
    got = packets.placed(t, "tile", *sides, order, **bounds)
    assert got.columns == want.columns and got.dtypes == want.dtypes
    assert sorted(map(str, got.collect())) == sorted(map(str, want.collect()))


@pytest.mark.parametrize("name", [*(f"packet_order_{o}" for o in packets.ORDERS), "packet_bounds"])
def test_packets_are_not_shuffled(spark, name):
    """Every packet of every tile went through a shuffle and a sort; now those of repeated tiles do."""
    plan = catalog.QUERIES[name](spark, "/root/testdata/sf0.001")
    few = plan._jdf.queryExecution().optimizedPlan().children().head().toString()
    assert few.count("Window") == 1 and few.index("Generate explode") < few.index("Window")
