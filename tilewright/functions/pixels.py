"""Pixel and sample rules as Catalyst expressions; all integer ones are exact."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Channels and bytes per sample of each pixel format.
FORMATS = {"Rgb8": (3, 1), "Rgba8": (4, 1), "Gray8": (1, 1), "Rgb16": (3, 2), "Rgba16": (4, 2), "Gray16": (1, 2)}
#: Denominators of the reduced resolutions.
DENOMINATORS = {"None": 1, "Half": 2, "Quarter": 4, "Eighth": 8}


def _lookup(key: Column, values: dict) -> Column:
    out = F.lit(None)
    for k, v in values.items():
        out = F.when(key == k, F.lit(v)).otherwise(out)
    return out


def channels(fmt: Column) -> Column:
    return _lookup(fmt, {k: c for k, (c, _) in FORMATS.items()})


def bytes_per_pixel(fmt: Column) -> Column:
    return _lookup(fmt, {k: c * b for k, (c, b) in FORMATS.items()})


def denominator(scale: Column) -> Column:
    return _lookup(scale, DENOMINATORS)


def output_block_size(scale: Column) -> Column:
    """Side of an 8x8 block at the reduced resolution."""
    return (F.lit(8) / denominator(scale)).cast("int")


def _byte(x: Column) -> Column:
    return F.greatest(F.lit(0), F.least(F.lit(255), x))


def ycbcr_to_rgb(y: Column, cb: Column, cr: Column) -> Column:
    """16-bit fixed point, rounded to nearest; integer columns in and out."""
    b, r = cb - 128, cr - 128
    half = 1 << 15
    return F.struct(
        _byte(y + F.shiftright(91881 * r + half, 16)).alias("r"),
        _byte(y + F.shiftright(-22554 * b - 46802 * r + half, 16)).alias("g"),
        _byte(y + F.shiftright(116130 * b + half, 16)).alias("b"),
    )


def rgb_to_ycbcr(r: Column, g: Column, b: Column) -> Column:
    half, centre = 1 << 15, (128 << 16) + (1 << 15) - 1
    return F.struct(
        F.shiftright(19595 * r + 38470 * g + 7471 * b + half, 16).alias("y"),
        F.shiftright(-11059 * r - 21709 * g + 32768 * b + centre, 16).alias("cb"),
        F.shiftright(32768 * r - 27439 * g - 5329 * b + centre, 16).alias("cr"),
    )


def luma(r: Column, g: Column, b: Column) -> Column:
    return F.shiftright(77 * r + 150 * g + 29 * b + 128, 8)


def rct(r: Column, g: Column, b: Column) -> Column:
    """The reversible component transform, forwards."""
    return F.struct(F.shiftright(r + 2 * g + b, 2).alias("y"), (b - g).alias("cb"), (r - g).alias("cr"))


def rct_inverse(y: Column, cb: Column, cr: Column) -> Column:
    g = y - F.shiftright(cb + cr, 2)
    return F.struct((cr + g).alias("r"), g.alias("g"), (cb + g).alias("b"))


def magnitude_category(v: Column) -> Column:
    """Bits of |v|; 0 for 0."""
    return F.when(v == 0, 0).otherwise(F.length(F.bin(F.abs(v).cast("long"))))


def magnitude_bits(v: Column) -> Column:
    """The low bits that follow a category: v itself, or v - 1 in as many bits when negative."""
    return F.when(v >= 0, v.cast("long")).otherwise(v.cast("long") + F.pow(F.lit(2), magnitude_category(v)).cast("long") - 1)


def quality_scale(quality: Column) -> Column:
    q = F.greatest(F.lit(1), F.least(F.lit(100), quality))
    return F.when(q < 50, F.expr("5000") / q).otherwise(200 - q * 2).cast("int")


def scaled_quant(base: Column, quality: Column) -> Column:
    return F.greatest(F.lit(1), F.least(F.lit(255), ((base * quality_scale(quality) + 50) / 100).cast("int")))


def widen(sample: Column, depth: Column) -> Column:
    """8 bits or fewer spread over 16, rounded to nearest; deeper samples stay as they are."""
    most = (F.pow(F.lit(2), depth) - 1).cast("long")
    return F.when(depth <= 8, F.floor((sample * 65535 + F.floor(most / 2)) / most)).otherwise(sample).cast("long")


def layout(fmt: Column) -> Column:
    return F.regexp_replace(fmt, "[0-9]+$", "")


def sample_type(fmt: Column) -> Column:
    return _lookup(fmt, {k: "U8" if b == 1 else "U16" for k, (_, b) in FORMATS.items()})


def ict(r: Column, g: Column, b: Column) -> Column:
    """The irreversible component transform, forwards, in doubles."""
    # fixed values: luminance and colour-difference weights
    return F.struct((0.299 * r + 0.587 * g + 0.114 * b).alias("y"), (-0.16875 * r - 0.33126 * g + 0.5 * b).alias("cb"), (0.5 * r - 0.41869 * g - 0.08131 * b).alias("cr"))


def ict_inverse(y: Column, cb: Column, cr: Column) -> Column:
    return F.struct((y + 1.402 * cr).alias("r"), (y - 0.344136 * cb - 0.714136 * cr).alias("g"), (y + 1.772 * cb).alias("b"))


def sycc_to_rgb(y: Column, cb: Column, cr: Column, depth: Column) -> Column:
    """Standard YCC samples to RGB, clamped to the depth, unrounded."""
    half, most = F.pow(F.lit(2.0), depth - 1), F.pow(F.lit(2.0), depth) - 1
    rgb = ict_inverse(y.cast("double"), cb - half, cr - half)
    return F.struct(*[F.greatest(F.lit(0.0), F.least(most, rgb[c])).alias(c) for c in ("r", "g", "b")])


def lab_samples(l: Column, a: Column, b: Column, depth: Column) -> Column:  # noqa: E741
    """CIELab samples of one depth with default ranges, on the scale of the output depth; no profile is applied.

    Null below four bits. Fixed values: ranges 100, 170 and 200; that of b defaults to 170, too, as
    in the results to match.
    """
    most = F.pow(F.lit(2.0), depth) - 1
    out = []
    for name, x, span, zero, offset, scale in (
        ("l", l, 100.0, F.lit(0.0), 0.0, 100.0),
        ("a", a, 170.0, F.pow(F.lit(2.0), depth - 1), 128.0, 255.0),
        ("b", b, 170.0, F.pow(F.lit(2.0), depth - 2) + F.pow(F.lit(2.0), depth - 3), 128.0, 255.0),
    ):
        value = x * span / most - span * zero / most + offset
        out.append((value * most / scale).alias(name))
    return F.when(depth >= 4, F.struct(*out))


def upsample_h2v1(row: Column) -> Column:
    """Triangle filter to twice the width, edges repeated."""
    n = F.size(row)

    def at(i: Column) -> Column:
        return F.get(row, F.greatest(F.lit(0), F.least(n - 1, i)))

    return F.transform(
        F.sequence(F.lit(0), n * 2 - 1),
        lambda k: F.when(k == 0, at(F.lit(0))).when(k == n * 2 - 1, at(n - 1)).when(k % 2 == 0, F.shiftright(3 * at(F.shiftright(k, 1)) + at(F.shiftright(k, 1) - 1) + 1, 2)).otherwise(F.shiftright(3 * at(F.shiftright(k, 1)) + at(F.shiftright(k, 1) + 1) + 2, 2)),
    )


def flag(value: Column) -> Column:
    """Whether a setting's text switches it on."""
    return F.coalesce(F.lower(F.trim(value)).isin("1", "true", "t", "yes", "y", "on", "enable", "enabled"), F.lit(False))


def profile_mode(value: Column) -> Column:
    """What a setting's text asks of a profile: summaries, rows or nothing."""
    return F.when(F.lower(F.trim(value)).isin("summary", "summaries", "aggregate", "aggregates"), "Summary").when(flag(value), "Rows").otherwise("Disabled")
