"""Sample planes as arrays: interleaving, windows, alpha, strides, level shifts, palettes and channel order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: The association of a channel that belongs to the whole image.
WHOLE_IMAGE = 65535


def _upto(n: Column) -> Column:
    """0 to n - 1; empty for 0."""
    return F.when(n > 0, F.sequence(F.lit(0).cast("long"), n.cast("long") - 1)).otherwise(F.array().cast("array<bigint>"))


def _at(array: Column, i: Column) -> Column:
    return F.get(array, i.cast("int"))


def interleave(planes: Column) -> Column:
    """Planes of one length -> samples pixel by pixel; no planes give none."""
    c = F.size(planes)
    n = F.coalesce(F.size(F.get(planes, 0)), F.lit(0))
    return F.transform(_upto(n * c), lambda i: _at(_at(planes, i % c), F.floor(i / c)))


def deinterleave(samples: Column, comps: Column) -> Column:
    """Samples pixel by pixel -> planes; an incomplete last pixel is left out."""
    n = F.floor(F.size(samples) / comps)
    return F.transform(_upto(comps), lambda k: F.transform(_upto(n), lambda i: _at(samples, i * comps + k)))


def window(plane: Column, width: Column, x: Column, y: Column, w: Column, h: Column) -> Column:
    """The samples of a rectangle that lies within a plane."""
    return F.transform(_upto(w * h), lambda i: _at(plane, (y + F.floor(i / w)) * width + x + i % w))


def add_alpha(rgb: Column, alpha: Column) -> Column:
    n = F.floor(F.size(rgb) / 3)
    return F.transform(_upto(n * 4), lambda i: F.when(i % 4 == 3, alpha).otherwise(_at(rgb, F.floor(i / 4) * 3 + i % 4)))


def drop_alpha(rgba: Column) -> Column:
    return F.filter(rgba, lambda x, i: i % 4 != 3)


def strided(rows: Column, row: Column, height: Column, stride: Column, fill: Column) -> Column:
    """Tight rows at a stride; the last row ends with its samples. Null if the stride is under a row."""
    n = F.when(height > 0, (height - 1) * stride + row).otherwise(0)
    return F.when(stride >= row, F.transform(_upto(n), lambda i: F.when(i % stride < row, _at(rows, F.floor(i / stride) * row + i % stride)).otherwise(fill)))


def level_shift(plane: Column, depth: Column) -> Column:
    """Half the depth's range is added, whatever the samples' sign."""
    half = F.pow(F.lit(2), depth - 1).cast("long")
    return F.transform(plane, lambda x: x + half)


def level_unshift(plane: Column, depth: Column, signed: Column) -> Column:
    """Before encoding: half the range is taken off unsigned samples."""
    half = F.when(signed, F.lit(0)).otherwise(F.pow(F.lit(2), depth - 1)).cast("long")
    return F.transform(plane, lambda x: x - half)


def resolve_palette(plane: Column, palette: Column) -> Column:
    """Index samples -> one plane per palette column (an array of entries per column); null if an index has no entry."""
    planes = F.transform(palette, lambda column: F.transform(plane, lambda x: F.when((x >= 0) & (x < F.size(column)), _at(column, x))))
    return F.when(~F.exists(planes, lambda p: F.exists(p, lambda x: x.isNull())), planes)


def reorder(planes: Column, associations: Column) -> Column:
    """Planes in the order of their channels' associations, whole-image channels last; ties keep their order."""
    keyed = F.zip_with(associations, _upto(F.size(planes)), lambda a, i: F.struct(F.coalesce(a, F.lit(WHOLE_IMAGE)).cast("long").alias("a"), i.alias("i")))
    return F.transform(F.array_sort(keyed), lambda k: _at(planes, k["i"]))


def repaired_colour(comps: Column, colour_channels: Column, colour: Column, alpha: Column, strict: Column) -> Column:
    """(colour, alpha) for a component count that does not fit the declared colour space; null where none fits."""
    fits = comps == colour_channels + alpha.cast("int")
    spare = ~strict & ~alpha & (comps == colour_channels + 1)
    name = F.when(fits | spare, colour).when((comps == 1) | ((comps == 2) & alpha), "Gray").when(comps == 3, "Rgb").when(comps == 4, F.when(alpha, "Rgb").otherwise("Cmyk"))
    return F.when(name.isNotNull(), F.struct(name.alias("colour"), F.when(fits, alpha).otherwise(alpha | spare).alias("alpha")))
