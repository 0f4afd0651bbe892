"""Queries over pixel formats, sample planes and colour."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import pixels as P
from .operators import planes
from .plans import tiles as T
from .registry import query

_FORMATS = list(P.FORMATS)


@query(f"""WITH f AS (SELECT p_partkey AS idx, {_FORMATS}[p_partkey % 6 + 1] AS fmt, ['None', 'Half', 'Quarter', 'Eighth'][p_partkey % 4 + 1] AS scale FROM part),
g AS (SELECT *, CASE WHEN starts_with(fmt, 'Rgba') THEN 4 WHEN starts_with(fmt, 'Rgb') THEN 3 ELSE 1 END AS c, CASE WHEN ends_with(fmt, '16') THEN 2 ELSE 1 END AS b, CASE scale WHEN 'None' THEN 1 WHEN 'Half' THEN 2 WHEN 'Quarter' THEN 4 ELSE 8 END AS d FROM f)
SELECT idx, c AS channels, c * b AS bytes_per_pixel, regexp_replace(fmt, '[0-9]+$', '') AS layout, CASE b WHEN 1 THEN 'U8' ELSE 'U16' END AS sample, d AS denominator, 8 // d AS block FROM g""")
def pixel_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    fmt = F.element_at(F.array(*map(F.lit, _FORMATS)), (k % 6 + 1).cast("int"))
    scale = F.element_at(F.array(*map(F.lit, P.DENOMINATORS)), (k % 4 + 1).cast("int"))
    return T.table(spark, sf_dir, "part").select(k.alias("idx"), P.channels(fmt).alias("channels"), P.bytes_per_pixel(fmt).alias("bytes_per_pixel"), P.layout(fmt).alias("layout"), P.sample_type(fmt).alias("sample"), P.denominator(scale).alias("denominator"), P.output_block_size(scale).alias("block"))


_PLANES = """p AS (SELECT p_partkey AS k, 1 + p_partkey % 4 AS c, 3 + p_partkey % 3 AS w, 2 + p_partkey % 2 AS h FROM part),
q AS (SELECT *, list_transform(range(c), lambda j: list_transform(range(w * h), lambda i: (k * 31 + j * 17 + i * 7) % 256)) AS planes FROM p)"""


def _planes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One to four planes of 3 to 5 by 2 or 3 samples a part."""
    k = F.col("k")
    p = T.table(spark, sf_dir, "part").select(F.col("p_partkey").alias("k"), (1 + F.col("p_partkey") % 4).alias("c"), (3 + F.col("p_partkey") % 3).alias("w"), (2 + F.col("p_partkey") % 2).alias("h"))
    upto = lambda n: F.sequence(F.lit(0).cast("long"), n - 1)
    return p.withColumn("planes", F.transform(upto(F.col("c")), lambda j: F.transform(upto(F.col("w") * F.col("h")), lambda i: (k * 31 + j * 17 + i * 7) % 256)))


def _text(array: Column) -> Column:
    return F.array_join(F.transform(array, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")


@query(f"""WITH {_PLANES}, i AS (SELECT *, list_transform(range(w * h * c), lambda i: planes[i % c + 1][i // c + 1]) AS samples FROM q)
SELECT k, array_to_string(samples, ',') AS samples, array_to_string(list_transform(range((w - 1) * (h - 1)), lambda i: planes[1][(1 + i // (w - 1)) * w + 1 + i % (w - 1) + 1]), ',') AS part,
array_to_string(list_transform(planes[c], lambda x: x + 128), ',') AS shifted, array_to_string(list_transform(planes[c], lambda x: CASE WHEN k % 2 = 0 THEN x ELSE x - 128 END), ',') AS unshifted, true AS same FROM i""")
def plane_layouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Interleaved samples and back, a window, and level shifts."""
    q = _planes(spark, sf_dir).withColumn("mixed", planes.interleave(F.col("planes")))
    last = F.element_at("planes", -1)
    part = planes.window(F.get("planes", 0), F.col("w"), F.lit(1), F.lit(1), F.col("w") - 1, F.col("h") - 1)
    return q.select("k", _text(F.col("mixed")).alias("samples"), _text(part).alias("part"), _text(planes.level_shift(last, F.lit(8))).alias("shifted"), _text(planes.level_unshift(last, F.lit(8), F.col("k") % 2 == 0)).alias("unshifted"), (planes.deinterleave(F.col("mixed"), F.col("c")) == F.col("planes")).alias("same"))


@query(f"""WITH {_PLANES}, i AS (SELECT k, w, h, list_transform(range(w * h * 3), lambda i: (k * 13 + i * 5) % 256) AS rgb FROM q)
SELECT k, array_to_string(list_transform(range(w * h * 4), lambda i: CASE WHEN i % 4 = 3 THEN 255 ELSE rgb[(i // 4) * 3 + i % 4 + 1] END), ',') AS rgba, array_to_string(rgb, ',') AS rgb,
CASE WHEN k % 5 <> 0 THEN array_to_string(list_transform(range((h - 1) * (w * 3 + 2) + w * 3), lambda i: CASE WHEN i % (w * 3 + 2) < w * 3 THEN rgb[(i // (w * 3 + 2)) * w * 3 + i % (w * 3 + 2) + 1] ELSE 0 END), ',') END AS strided FROM i""")
def alpha_and_strides(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opaque alpha added and dropped, and rows copied at a wider stride; every fifth stride is too small."""
    q = _planes(spark, sf_dir)
    row = F.col("w") * 3
    q = q.withColumn("plain", F.transform(F.sequence(F.lit(0).cast("long"), row * F.col("h") - 1), lambda i: (F.col("k") * 13 + i * 5) % 256))
    rgba = planes.add_alpha(F.col("plain"), F.lit(255).cast("long"))
    stride = row + F.when(F.col("k") % 5 == 0, -1).otherwise(2)
    return q.select("k", _text(rgba).alias("rgba"), _text(planes.drop_alpha(rgba)).alias("rgb"), _text(planes.strided(F.col("plain"), row, F.col("h"), stride, F.lit(0).cast("long"))).alias("strided"))


@query(f"""WITH {_PLANES}, a AS (SELECT *, list_transform(planes[1], lambda x: x % (4 + k % 2)) AS idx, [[9, 8, 7, k], [1, 2, 3, 4]] AS palette, list_transform(range(c), lambda j: CASE WHEN j = k % 4 THEN NULL ELSE (c - j + k) % 3 + 1 END) AS assoc FROM q),
r AS (SELECT *, list_sort(list_transform(range(c), lambda j: coalesce(assoc[j + 1], 65535) * 10 + j)) AS ord FROM a)
SELECT k, CASE WHEN len(list_filter(idx, lambda x: x > 3)) = 0 THEN array_to_string(list_transform(idx, lambda x: palette[1][x + 1]), ',') || ';' || array_to_string(list_transform(idx, lambda x: palette[2][x + 1]), ',') END AS resolved,
array_to_string(list_transform(ord, lambda o: array_to_string(planes[o % 10 + 1], ',')), ';') AS reordered FROM r""")
def palettes_and_channels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Index samples through a palette of two columns, and planes in the order of their associations."""
    q, k = _planes(spark, sf_dir), F.col("k")
    idx = F.transform(F.get("planes", 0), lambda x: x % (4 + k % 2))
    palette = F.array(F.array(*[F.lit(v).cast("long") for v in (9, 8, 7)], k), F.array(*[F.lit(v).cast("long") for v in (1, 2, 3, 4)]))
    assoc = F.transform(F.sequence(F.lit(0).cast("long"), F.col("c") - 1), lambda j: F.when(j != k % 4, (F.col("c") - j + k) % 3 + 1))
    both = lambda p: F.array_join(F.transform(p, _text), ";")
    return q.select("k", both(planes.resolve_palette(idx, palette)).alias("resolved"), both(planes.reorder(F.col("planes"), assoc)).alias("reordered"))


@query(f"""WITH {T.PIXELS_SQL}, t AS (SELECT idx, r, g, b, 0.299 * r + 0.587 * g + 0.114 * b AS y, -0.16875 * r - 0.33126 * g + 0.5 * b AS cb, 0.5 * r - 0.41869 * g - 0.08131 * b AS cr FROM (SELECT idx, CAST(r AS DOUBLE) AS r, CAST(g AS DOUBLE) AS g, CAST(b AS DOUBLE) AS b FROM pixels))
SELECT idx, CAST(floor(y * 100 + 0.25) AS BIGINT) AS y, CAST(floor(cb * 100 + 0.25) AS BIGINT) AS cb, CAST(floor(cr * 100 + 0.25) AS BIGINT) AS cr, true AS near,
CAST(floor(greatest(0, least(255, r + 1.402::DOUBLE * (b - 128))) + 0.25) AS BIGINT) AS red, CAST(floor(greatest(0, least(255, r - 0.344136::DOUBLE * (g - 128) - 0.714136::DOUBLE * (b - 128))) + 0.25) AS BIGINT) AS green, CAST(floor(greatest(0, least(255, r + 1.772::DOUBLE * (g - 128))) + 0.25) AS BIGINT) AS blue FROM t""")
def irreversible_colour(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The irreversible transform in hundredths, its round trip within one level, and samples read as standard YCC."""
    p = T.pixels(spark, sf_dir).select("idx", *(F.col(c).cast("double").alias(c) for c in "rgb"))
    t = p.withColumn("t", P.ict(*map(F.col, "rgb"))).withColumn("s", P.sycc_to_rgb(F.col("r"), F.col("g"), F.col("b"), F.lit(8)))
    back = P.ict_inverse(F.col("t.y"), F.col("t.cb"), F.col("t.cr"))
    near = (F.abs(back["r"] - F.col("r")) < 1) & (F.abs(back["g"] - F.col("g")) < 1) & (F.abs(back["b"] - F.col("b")) < 1)
    hundredths = [F.floor(F.col(f"t.{c}") * 100 + 0.25).alias(c) for c in ("y", "cb", "cr")]
    return t.select("idx", *hundredths, near.alias("near"), *(F.floor(F.col(f"s.{c}") + 0.25).alias(n) for c, n in (("r", "red"), ("g", "green"), ("b", "blue"))))


@query(f"""WITH {T.PIXELS_SQL}, d AS (SELECT *, CASE WHEN idx % 9 = 0 THEN 3 ELSE 8 END AS depth FROM pixels)
SELECT idx, CASE WHEN depth > 3 THEN CAST(floor(r * 1.0::DOUBLE * 100 / 255 * 255 / 100 * 16 + 0.3) AS BIGINT) END AS l, CASE WHEN depth > 3 THEN CAST(floor((g * 170.0::DOUBLE / 255 - 170.0::DOUBLE * 128 / 255 + 128) * 16 + 0.3) AS BIGINT) END AS a,
CASE WHEN depth > 3 THEN CAST(floor((b * 170.0::DOUBLE / 255 - 170.0::DOUBLE * 96 / 255 + 128) * 16 + 0.3) AS BIGINT) END AS b FROM d""")
def lab_scale(spark: SparkSession, sf_dir: str) -> DataFrame:
    """CIELab samples in sixteenths; every ninth pixel has too few bits."""
    p = T.pixels(spark, sf_dir)
    depth = F.when(F.col("idx") % 9 == 0, 3).otherwise(8)
    p = p.withColumn("x", P.lab_samples(F.col("r"), F.col("g"), F.col("b"), depth))
    return p.select("idx", *(F.floor(F.col(f"x.{c}") * 16 + 0.3).alias(c) for c in "lab"))


@query("""WITH c AS (SELECT p_partkey AS k, 1 + p_partkey % 5 AS n, 1 + p_partkey % 4 AS want, p_partkey % 3 = 0 AS alpha, p_partkey % 2 = 0 AS strict, ['Gray', 'Ga', 'Rgb', 'Cmyk'][p_partkey % 4 + 1] AS name FROM part),
d AS (SELECT *, n = want + CAST(alpha AS INT) AS fits, NOT strict AND NOT alpha AND n = want + 1 AS spare FROM c),
e AS (SELECT k, alpha, fits, spare, CASE WHEN fits OR spare THEN name WHEN n = 1 OR (n = 2 AND alpha) THEN 'Gray' WHEN n = 3 THEN 'Rgb' WHEN n = 4 THEN CASE WHEN alpha THEN 'Rgb' ELSE 'Cmyk' END END AS colour FROM d)
SELECT k, colour, CASE WHEN colour IS NOT NULL THEN CASE WHEN fits THEN alpha ELSE alpha OR spare END END AS alpha FROM e""")
def colour_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    name = F.element_at(F.array(*map(F.lit, ("Gray", "Ga", "Rgb", "Cmyk"))), (k % 4 + 1).cast("int"))
    fixed = planes.repaired_colour(1 + k % 5, 1 + k % 4, name, k % 3 == 0, k % 2 == 0)
    return T.table(spark, sf_dir, "part").select(k.alias("k"), fixed.alias("x")).select("k", "x.colour", "x.alpha")


@query("""WITH s AS (SELECT l_orderkey * 8 + l_linenumber AS idx, 1 + l_linenumber % 16 AS depth, l_partkey % (1 << (1 + l_linenumber % 16)) AS v FROM lineitem)
SELECT idx, CASE WHEN depth <= 8 THEN (v * 65535 + ((1 << depth) - 1) // 2) // ((1 << depth) - 1) ELSE v END AS wide FROM s""")
def widened_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    depth = 1 + F.col("l_linenumber") % 16
    v = F.col("l_partkey") % F.pow(F.lit(2), depth).cast("long")
    return T.table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), P.widen(v, depth).alias("wide"))
