"""Codec rules as Catalyst expressions: levels, capacities, sample conversions, formats and decoder shapes."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import ceil_div, floor_div

#: Transfer syntaxes by family.
LOSSLESS = ("Jpeg2000Lossless", "HtJpeg2000Lossless")
FAMILY = ("Jpeg2000Lossless", "Jpeg2000", "HtJpeg2000Lossless", "HtJpeg2000")
#: Horizontal and vertical sampling of the first component; all others have 1 x 1.
SAMPLING = {"Gray": (1, 1), "Ybr444": (1, 1), "Ybr422": (2, 1), "Ybr420": (2, 2)}


def is_lossless(syntax: Column) -> Column:
    return F.coalesce(syntax.isin(*LOSSLESS), F.lit(False))


def is_jpeg2000(syntax: Column) -> Column:
    return F.coalesce(syntax.isin(*FAMILY), F.lit(False))


def bit_length(x: Column) -> Column:
    """Bits of a number, 0 for 0."""
    return F.when(x <= 0, 0).otherwise(F.length(F.bin(x.cast("long"))))


def most_levels(width: Column, height: Column) -> Column:
    """How often the shorter side can be halved."""
    return F.greatest(bit_length(F.least(width, height)) - 1, F.lit(0))


def lrcp_levels(width: Column, height: Column) -> Column:
    return F.when(F.least(width, height) < 64, 0).otherwise(1)


def rpcl_levels(width: Column, height: Column) -> Column:
    """Halvings, rounded up, until the shorter side has 64 samples or fewer."""
    return F.least(bit_length(ceil_div(F.least(width, height), F.lit(64)) - 1), most_levels(width, height))


def capped_levels(width: Column, height: Column, asked: Column, policy: Column) -> Column:
    """The levels asked for as far as the sides allow, else the policy's."""
    return F.when(asked.isNull(), policy).when(F.least(width, height) < 64, 0).otherwise(F.least(asked, most_levels(width, height)))


def blocks_per_mcu(subsampling: Column) -> Column:
    out = F.lit(None).cast("long")
    for name, (h, v) in SAMPLING.items():
        out = F.when(subsampling == name, F.lit(h * v + (0 if name == "Gray" else 2)).cast("long")).otherwise(out)
    return out


def entropy_capacity(mcus: Column, blocks: Column, restart: Column) -> Column:
    """Bytes that entropy-coded data may need; null on overflow, a restart interval of 0 is none."""
    restarts = F.when(restart > 0, floor_div(F.greatest(mcus - 1, F.lit(0)), restart)).otherwise(0)
    return F.try_add(F.try_multiply(F.try_multiply(mcus, blocks), F.lit(512).cast("long")), restarts * 2 + 16)


def band_index(origin: Column, local: Column, low: bool) -> Column:
    """The sub-band sample that an output place of an inverse wavelet step reads first."""
    place = origin + local
    return ceil_div(place, F.lit(2)) - ceil_div(origin, F.lit(2)) if low else floor_div(place, F.lit(2)) - floor_div(origin, F.lit(2))


def _most(depth: Column) -> Column:
    return F.pow(F.lit(2.0), F.least(depth, F.lit(16))) - 1


def sample_to_byte(sample: Column, depth: Column) -> Column:
    """A decoded sample as a byte: rounded, clamped, and spread over 0 to 255 where the depth isn't 8."""
    whole = F.greatest(F.lit(0.0), F.least(_most(depth), F.floor(sample + 0.5).cast("double")))
    return F.when(depth == 8, whole.cast("int")).otherwise(F.floor(whole / _most(depth) * 255 + 0.5).cast("int"))


def native_sample(raw: Column, depth: Column, signed: Column) -> Column:
    """Stored bits as a number of this depth."""
    span = F.pow(F.lit(2), depth).cast("long")
    low = F.pmod(raw, span)
    return F.when(signed & (low * 2 >= span), low - span).otherwise(low)


def passthrough_syntax(sof: Column, depth: Column) -> Column:
    """The transfer syntax that a JPEG frame can be copied under, null if none."""
    return F.when((sof == "Baseline8") & (depth == 8), "JpegBaseline8").when(sof.isin("Extended8", "Extended12"), "JpegExtendedSequential")


def format_error(fmt: Column, denom: Column) -> Column:
    """Why a JPEG tile can't be decoded to a format at a scale, null if it can."""
    return F.when(fmt.isin("Rgb16", "Rgba16", "Gray16"), "UnsupportedBitDepth").when((fmt == "Rgba8") & (denom > 1), "DownscaleUnsupported")


def shape(colorspace: Column, max_h: Column, max_v: Column, restart: Column) -> Column:
    """The common colour layouts, null for any other; 4:2:0 only without restarts."""
    colour = colorspace == "YCbCr"
    return F.when(colour & (max_h == 2) & (max_v == 2) & (restart == 0), "420").when(colour & (max_h == 1) & (max_v == 1), "444").when(colour & (max_h == 2) & (max_v == 1), "422")


def row_meets(stripe: Column, unit_height: Column, y: Column, h: Column) -> Column:
    """Whether a row of coded units overlaps a rectangle's rows."""
    return (stripe * unit_height < y + h) & (y < (stripe + 1) * unit_height)
