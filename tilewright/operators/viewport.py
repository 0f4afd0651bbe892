"""Viewport workloads: bounds and overlapping tiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.geometry import intersects, scaled_covering


def bounds(tiles: DataFrame) -> DataFrame:
    """Per viewport: bounding box, summed area, tiles."""
    return tiles.groupBy("viewport").agg(F.min("x").alias("x0"), F.min("y").alias("y0"), F.max(F.col("x") + F.col("w")).alias("x1"), F.max(F.col("y") + F.col("h")).alias("y1"), F.sum(F.col("w") * F.col("h")).alias("area"), F.count(F.lit(1)).alias("tiles"))


def overlaps(tiles: DataFrame, cell: int = 1024) -> DataFrame:
    """Pairs of overlapping tiles of one viewport, joined by (viewport, grid cell) rather than by viewport alone.

    A pair is reported in the one cell that holds the corner of its intersection.
    """
    t = tiles.select("viewport", "idx", "x", "y", "w", "h")
    spread = t.filter("w > 0 and h > 0").withColumn("cx", F.explode(F.sequence(F.floor(F.col("x") / cell), F.floor((F.col("x") + F.col("w") - 1) / cell)))).withColumn("cy", F.explode(F.sequence(F.floor(F.col("y") / cell), F.floor((F.col("y") + F.col("h") - 1) / cell))))
    a, b = spread.alias("a"), spread.alias("b")
    on = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in ("viewport", "cx", "cy")]
    pair = a.join(b, [*on, F.col("a.idx") < F.col("b.idx")])
    edge = lambda s: (F.col(f"{s}.x"), F.col(f"{s}.y"), F.col(f"{s}.x") + F.col(f"{s}.w"), F.col(f"{s}.y") + F.col(f"{s}.h"))
    own = (F.floor(F.greatest("a.x", "b.x") / cell) == F.col("a.cx")) & (F.floor(F.greatest("a.y", "b.y") / cell) == F.col("a.cy"))
    return pair.filter(intersects(*edge("a"), *edge("b")) & own).select(F.col("a.viewport").alias("viewport"), F.col("a.idx").alias("a"), F.col("b.idx").alias("b"))


def contiguous(viewports: DataFrame, tiles: DataFrame) -> DataFrame:
    """Per viewport (viewport, width, height, denom): whether its tiles fill it without gap or overlap.

    Tiles hold their source region (x, y, w, h) and where it goes (dx, dy, dw, dh). All of them have
    to lie where their reduced source lies within the reduced bounding box of all sources, which
    has the viewport's size; a viewport without tiles is not contiguous.
    """
    box = bounds(tiles).drop("area")
    v = viewports.join(box, "viewport", "left")
    v = v.withColumn("s", scaled_covering(F.col("x0"), F.col("y0"), F.col("x1") - F.col("x0"), F.col("y1") - F.col("y0"), F.col("denom")))
    one = scaled_covering(*map(F.col, ("x", "y", "w", "h", "denom")))
    t = tiles.join(v.select("viewport", "denom", "s", "width", "height"), "viewport").withColumn("o", one)
    right = (F.col("dx") == F.col("o.x") - F.col("s.x")) & (F.col("dy") == F.col("o.y") - F.col("s.y")) & (F.col("dw") == F.col("o.w")) & (F.col("dh") == F.col("o.h"))
    inside = (F.col("dx") + F.col("dw") <= F.col("width")) & (F.col("dy") + F.col("dh") <= F.col("height"))
    placed = t.groupBy("viewport").agg(F.every(right & inside).alias("placed"), F.sum(F.col("dw") * F.col("dh")).alias("area"))
    clash = overlaps(t.select("viewport", "idx", F.col("dx").alias("x"), F.col("dy").alias("y"), F.col("dw").alias("w"), F.col("dh").alias("h"))).groupBy("viewport").agg(F.lit(True).alias("clash"))
    fits = (F.col("s.w") == F.col("width")) & (F.col("s.h") == F.col("height")) & (F.col("area") == F.col("width") * F.col("height"))
    out = v.join(placed, "viewport", "left").join(clash, "viewport", "left")
    return out.select("viewport", F.coalesce(F.col("placed") & fits & F.col("clash").isNull(), F.lit(False)).alias("contiguous"))


def strategy(request: Column, contiguous_: Column, metal: Column) -> Column:
    """How a viewport is put together; null where the request can't be met."""
    shape = F.when(contiguous_, "Contiguous").otherwise("Composite")
    on_device = request.isin("Auto", "Metal") & metal
    return F.when(on_device, F.concat(F.lit("Hybrid"), shape)).when(request.isin("Cpu", "Auto"), F.concat(F.lit("Cpu"), shape))


#: A suggested viewport's tiles, and the scales that are tried, coarsest first.
EDGE, COLUMNS, ROWS, SCALES = 96, 6, 2, (8, 4, 2, 1)


def suggest(images: DataFrame, key: str) -> DataFrame:
    """Images (key, width, height) -> the tiles of a centred viewport at the coarsest scale that fits; none if none does."""
    denom = F.lit(None).cast("long")
    for d in reversed(SCALES):
        denom = F.when((F.col("width") >= EDGE * COLUMNS * d) & (F.col("height") >= EDGE * ROWS * d), F.lit(d).cast("long")).otherwise(denom)

    def origin(extent: str, tiles: int) -> Column:
        centred = F.floor((F.col(extent) - F.col("denom") * (EDGE * tiles)) / 2)
        return centred - centred % F.col("denom")

    out = images.withColumn("denom", denom).filter("denom is not null").select(key, "denom", origin("width", COLUMNS).alias("_x"), origin("height", ROWS).alias("_y"))
    out = out.withColumn("row", F.explode(F.sequence(F.lit(0), F.lit(ROWS - 1)))).withColumn("col", F.explode(F.sequence(F.lit(0), F.lit(COLUMNS - 1))))
    side = F.col("denom") * EDGE
    return out.select(key, "denom", (F.col("_x") + F.col("col") * side).alias("x"), (F.col("_y") + F.col("row") * side).alias("y"), side.alias("side"), (F.col("col") * EDGE).cast("long").alias("dx"), (F.col("row") * EDGE).cast("long").alias("dy"))
