"""Tile tables derived from the relational test tables, by rules that plain SQL repeats."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Compressed transfer syntaxes.
SYNTAXES = ["JpegBaseline8", "JpegExtended12", "Jpeg2000Lossless", "Jpeg2000", "HtJpeg2000Lossless"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """Rows dealt evenly to four tasks a core: a small file of keys is read by one task, however long each tile's work takes."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def requests(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One region request per order line."""
    li = table(spark, sf_dir, "lineitem")
    return li.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"),
        (F.col("l_orderkey") % 4096).alias("x"),
        (F.col("l_partkey") % 4096).alias("y"),
        (F.floor("l_quantity") * 16).cast("long").alias("w"),
        (F.col("l_linenumber") * 64).cast("long").alias("h"),
        F.pow(F.lit(2), F.col("l_linenumber") % 4).cast("long").alias("denom"),
        F.col("l_orderkey"),
        F.col("l_suppkey"),
    )


REQUESTS_SQL = """requests AS (SELECT l_orderkey * 8 + l_linenumber AS idx, l_orderkey % 4096 AS x, l_partkey % 4096 AS y, CAST(floor(l_quantity) * 16 AS BIGINT) AS w,
CAST(l_linenumber * 64 AS BIGINT) AS h, CAST(1 << (l_linenumber % 4) AS BIGINT) AS denom, l_orderkey, l_suppkey FROM lineitem)"""


def pixels(spark: SparkSession, sf_dir: str) -> DataFrame:
    li = table(spark, sf_dir, "lineitem")
    return li.select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("idx"), *[(F.col(c) % 256).cast("int").alias(n) for c, n in (("l_orderkey", "r"), ("l_partkey", "g"), ("l_suppkey", "b"))])


PIXELS_SQL = "pixels AS (SELECT l_orderkey * 8 + l_linenumber AS idx, CAST(l_orderkey % 256 AS INT) AS r, CAST(l_partkey % 256 AS INT) AS g, CAST(l_suppkey % 256 AS INT) AS b FROM lineitem)"


def headers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One tile header per part."""
    p = table(spark, sf_dir, "part")
    k = F.col("p_partkey")
    return p.select(
        k.alias("tile"),
        (F.col("p_size").cast("long") * 97 + 1).alias("width"),
        (F.col("p_size").cast("long") * 61 + k % 50).alias("height"),
        F.when(k % 4 == 0, 1).otherwise(3).alias("components"),
        F.when(k % 4 >= 2, 2).otherwise(1).cast("long").alias("max_h"),
        F.when(k % 4 == 3, 2).otherwise(1).cast("long").alias("max_v"),
        F.when(k % 7 == 0, 12).otherwise(8).alias("bit_depth"),
        F.element_at(F.array(*map(F.lit, SYNTAXES)), (k % 5 + 1).cast("int")).alias("transfer_syntax"),
        F.when(k % 11 == 0, 0).otherwise(k * 100).cast("long").alias("bytes"),
    )


HEADERS_SQL = """headers AS (SELECT p_partkey AS tile, CAST(p_size AS BIGINT) * 97 + 1 AS width, CAST(p_size AS BIGINT) * 61 + p_partkey % 50 AS height,
CASE WHEN p_partkey % 4 = 0 THEN 1 ELSE 3 END AS components, CAST(CASE WHEN p_partkey % 4 >= 2 THEN 2 ELSE 1 END AS BIGINT) AS max_h, CAST(CASE WHEN p_partkey % 4 = 3 THEN 2 ELSE 1 END AS BIGINT) AS max_v,
CASE WHEN p_partkey % 7 = 0 THEN 12 ELSE 8 END AS bit_depth, ['JpegBaseline8', 'JpegExtended12', 'Jpeg2000Lossless', 'Jpeg2000', 'HtJpeg2000Lossless'][p_partkey % 5 + 1] AS transfer_syntax,
CAST(CASE WHEN p_partkey % 11 = 0 THEN 0 ELSE p_partkey * 100 END AS BIGINT) AS bytes FROM part)"""


def requirements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One destination per nation; at most a few hundred rows by definition of the table."""
    n = table(spark, sf_dir, "nation")
    k = F.col("n_nationkey")
    return n.select(
        k.alias("dest"),
        F.element_at(F.array(*map(F.lit, SYNTAXES)), (k % 5 + 1).cast("int")).alias("want_syntax"),
        F.when(k % 3 != 0, F.when(k % 2 == 0, 1).otherwise(3)).alias("want_components"),
        F.when(k % 4 == 1, 8).alias("want_depth"),
    )


REQUIREMENTS_SQL = """requirements AS (SELECT n_nationkey AS dest, ['JpegBaseline8', 'JpegExtended12', 'Jpeg2000Lossless', 'Jpeg2000', 'HtJpeg2000Lossless'][n_nationkey % 5 + 1] AS want_syntax,
CASE WHEN n_nationkey % 3 <> 0 THEN CASE WHEN n_nationkey % 2 = 0 THEN 1 ELSE 3 END END AS want_components, CASE WHEN n_nationkey % 4 = 1 THEN 8 END AS want_depth FROM nation)"""
