"""Packet progression orders over a grid of layers, resolutions, components and precincts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: The five progressions' sort keys.
ORDERS = {
    "lrcp": ["layer", "res", "comp", "precinct"],
    "rlcp": ["res", "layer", "comp", "precinct"],
    "rpcl": ["res", "y", "x", "comp", "precinct", "layer"],
    "pcrl": ["y", "x", "comp", "res", "precinct", "layer"],
    "cprl": ["comp", "y", "x", "res", "precinct", "layer"],
}


def _corner(res: Column, precinct: Column) -> tuple[Column, Column]:
    step = F.floor(F.lit(64) / F.pow(F.lit(2), res)).cast("long")
    return precinct % 4 * step, F.floor(precinct / 4) * step


def grid(tiles: DataFrame, tile: str, layers: Column, resolutions: Column, comps: Column, precincts: Column) -> DataFrame:
    """One row per packet of each tile; precincts lie in rows of four."""
    out = tiles.select(tile, layers.alias("_l"), resolutions.alias("_r"), comps.alias("_c"), precincts.alias("_p"))
    for bound, name in (("_l", "layer"), ("_r", "res"), ("_c", "comp"), ("_p", "precinct")):
        out = out.filter(F.col(bound) > 0).withColumn(name, F.explode(F.sequence(F.lit(0).cast("long"), F.col(bound).cast("long") - 1)))
    x, y = _corner(F.col("res"), F.col("precinct"))
    return out.select(tile, "layer", "res", "comp", "precinct", x.alias("x"), y.alias("y"))


def bounded(packets: DataFrame, **bounds: tuple[Column, Column]) -> DataFrame:
    """Packets whose named coordinates lie in [low, high)."""
    for name, (low, high) in bounds.items():
        packets = packets.filter((F.col(name) >= low) & (F.col(name) < high))
    return packets


def ordered(packets: DataFrame, tile: str, order: str) -> DataFrame:
    """The place of each packet within its tile, by a sort of all packets."""
    w = Window.partitionBy(tile).orderBy(*ORDERS[order])
    return packets.select(tile, "layer", "res", "comp", "precinct", F.row_number().over(w).cast("long").alias("place"))


def _corners(res: Column, precincts: Column, y: Column, x: Column) -> tuple[Column, Column]:
    """How many of a resolution's precincts have a corner before (y, x), and how many have that one."""
    step = F.floor(F.lit(64) / F.pow(F.lit(2), res)).cast("long")
    side = F.greatest(step, F.lit(1))
    down, across = F.ceil(y / side), F.ceil(x / side)
    in_row, in_column = y % side == 0, x % side == 0
    before = F.least(precincts, 4 * down + F.when(in_row, F.least(F.lit(4), across)).otherwise(0))
    same = F.when(in_row & in_column & (across < 4) & (4 * down + across < precincts), 1).otherwise(0)
    origin = (y == 0) & (x == 0)  # without a step all corners lie there
    return F.when(step > 0, before).when(origin, 0).otherwise(precincts).cast("long"), F.when(step > 0, same).when(origin, precincts).otherwise(0).cast("long")


def placed(tiles: DataFrame, tile: str, layers: Column, resolutions: Column, comps: Column, precincts: Column, order: str, **bounds: tuple[Column, Column]) -> DataFrame:
    """ordered() over bounded() over grid(), with places counted and not sorted: only headers are shuffled, not packets.

    Precincts have no bounds. Headers that share a tile have their packets sorted together.
    """
    sides = dict(zip(("layer", "res", "comp", "precinct"), (layers, resolutions, comps, precincts), strict=True))
    heads = tiles.select(tile, *(c.cast("long").alias(f"_{n}") for n, c in sides.items())).filter(" and ".join(f"_{n} > 0" for n in sides))
    heads = heads.repartition(4 * tiles.sparkSession.sparkContext.defaultParallelism, tile)
    heads = heads.withColumn("_n", F.count(F.lit(1)).over(Window.partitionBy(tile)))
    again = ordered(bounded(grid(heads.filter("_n > 1"), tile, *(F.col(f"_{n}") for n in sides)), **bounds), tile, order)

    one = heads.filter("_n = 1").drop("_n")
    for n in ("layer", "res", "comp"):
        low, high = bounds.get(n, (F.lit(0), F.col(f"_{n}")))
        one = one.withColumn(f"_low_{n}", F.greatest(low.cast("long"), F.lit(0))).withColumn(f"_{n}", F.least(high.cast("long"), F.col(f"_{n}")))
        one = one.filter(F.col(f"_{n}") > F.col(f"_low_{n}")).withColumn(f"_all_{n}", F.col(f"_{n}") - F.col(f"_low_{n}"))

    def every(rows: DataFrame, n: str) -> DataFrame:
        low = F.col(f"_low_{n}") if n != "precinct" else F.lit(0).cast("long")
        return rows.withColumn(n, F.explode(F.sequence(low, F.col(f"_{n}") - 1)))

    one = every(every(one, "res"), "precinct")
    all_l, all_r, all_c, all_p = F.col("_all_layer"), F.col("_all_res"), F.col("_all_comp"), F.col("_precinct")
    layer, res, comp = (F.col(n) - F.col(f"_low_{n}") for n in ("layer", "res", "comp"))
    precinct = F.col("precinct")
    if order in ("lrcp", "rlcp"):
        outer = layer * all_r + res if order == "lrcp" else res * all_l + layer
        place = (outer * all_c + comp) * all_p + precinct
    else:
        x, y = _corner(F.col("res"), precinct)
        own = F.when(F.col("res") > 6, precinct).otherwise(0)  # precincts of the resolution at that corner and before it
        if order == "rpcl":
            before, same = _corners(F.col("res"), all_p, y, x)
            counts = F.struct(before.alias("before"), same.alias("same"), F.lit(0).cast("long").alias("lower"))
        else:
            one = one.withColumn("_x", x).withColumn("_y", y)

            def add(a: Column, r: Column) -> Column:
                before, same = _corners(r, F.col("_precinct"), F.col("_y"), F.col("_x"))
                return F.struct((a["before"] + before).alias("before"), (a["same"] + same).alias("same"), (a["lower"] + F.when(r < F.col("res"), same).otherwise(0)).alias("lower"))

            zero = F.struct(*(F.lit(0).cast("long").alias(n) for n in ("before", "same", "lower")))
            counts = F.aggregate(F.sequence(F.col("_low_res"), F.col("_res") - 1), zero, add)
        one = one.withColumn("_c", counts).withColumn("_own", F.col("_c.lower") + own)
        if order == "cprl":
            place = (comp * all_r * all_p + F.col("_c.before") + F.col("_own")) * all_l + layer
        else:
            outer = res * all_c * all_p if order == "rpcl" else F.lit(0)
            place = (outer + F.col("_c.before") * all_c + comp * F.col("_c.same") + F.col("_own")) * all_l + layer
    one = every(every(one, "comp"), "layer")
    return one.select(tile, *sides, (place + 1).cast("long").alias("place")).union(again)
