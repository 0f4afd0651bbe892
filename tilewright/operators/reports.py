"""Profile summaries and benchmark comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Per key: count, sum and integer average."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"), F.sum(value).alias("total")).withColumn("avg", F.floor(F.col("total") / F.col("count")).cast("long"))


def upper_median(rows: DataFrame, keys: list[str], value: str, buckets: int = 4096) -> DataFrame:
    """sorted[n // 2] per key of whole numbers; null values and keys don't count.

    Equal values are counted first. A histogram per key tells which bucket holds the median, and
    only that bucket's values are sorted, so no key's values all meet in one task.
    """
    agg = rows.filter(F.col(value).isNotNull()).groupBy(*keys, F.col(value).cast("long").alias("_v")).agg(F.count(F.lit(1)).alias("_n"))
    size = agg.groupBy(*keys).agg(F.min("_v").alias("_low"), (F.floor((F.max("_v") - F.min("_v")) / buckets) + 1).alias("_width"), F.sum("_n").alias("n"))
    placed = agg.join(size, keys).withColumn("_b", F.floor((F.col("_v") - F.col("_low")) / F.col("_width")))
    histogram = placed.groupBy(*keys, "_b").agg(F.sum("_n").alias("_in"))
    so_far = F.coalesce(F.sum("_in").over(Window.partitionBy(*keys).orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    middle = placed.join(histogram.withColumn("_before", so_far), [*keys, "_b"]).filter("_before <= floor(n / 2) and floor(n / 2) < _before + _in")
    upto = F.col("_before") + F.sum("_n").over(Window.partitionBy(*keys).orderBy("_v"))
    return middle.withColumn("_upto", upto).filter("_upto > floor(n / 2) and _upto - _n <= floor(n / 2)").select(*keys, F.col("_v").alias("median"), "n")


def regression(baseline: DataFrame, current: DataFrame, enforced: Column) -> DataFrame:
    """baseline left join current on id; a confident slow-down of over 10 % and 100 ns counts."""
    b, c = baseline.alias("b"), current.alias("c")
    delta = F.col("c.lower") - F.col("b.upper")
    out = b.join(c, F.col("b.id") == F.col("c.id"), "left").select(F.col("b.id").alias("id"), F.col("b.median").alias("baseline"), F.col("c.median").alias("current"), delta.alias("delta"), enforced.alias("enforced"), F.col("b.upper").alias("_u"))
    return out.withColumn("missing", F.col("current").isNull() & F.col("enforced")).withColumn("regressed", F.coalesce(F.col("enforced") & (F.col("delta") > 100) & (F.col("delta") * 10 > F.col("_u")), F.lit(False))).drop("_u")


def compare(own: Column, other: Column) -> Column:
    """Win, loss or tie; a difference within one per cent is a tie. Null if either was not measured."""
    return F.when(F.abs(own - other) * 100 <= F.greatest(own, other), "tie").when(own < other, "win").when(own > other, "loss")


def counts(rows: DataFrame, keys: list[str]) -> DataFrame:
    """Per key: how many rows; other columns are dropped."""
    return rows.groupBy(*keys).agg(F.count(F.lit(1)).alias("count"))


def rendered(summary_: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """One text line per key, in the keys' order, as (line number from 0, line)."""
    text = F.concat_ws(" ", *[F.concat(F.lit(f"{c}="), F.col(c).cast("string")) for c in [*keys, *values]])
    return numbered(summary_.select(F.struct(*keys).alias("_at"), text.alias("line")), "_at")


def numbered(lines: DataFrame, order: str) -> DataFrame:
    """(n, line) by ``order``. Ranges are sorted apart and numbered from the counts of those before: one count per range is collected."""
    spark = lines.sparkSession
    part = lines.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)))
    before, at = [], 0
    for p, n in sorted(tuple(r) for r in part.groupBy("_p").count().collect()):
        before.append((p, at))
        at += n
    offsets = spark.createDataFrame(before, "_p int, _from long")
    return part.join(F.broadcast(offsets), "_p").select((F.col("_from") + F.col("_i")).alias("n"), "line")


#: Names of enforced benchmarks begin with or contain one of these, and begin with none of the exceptions.
ENFORCED_PREFIXES = ("htj2k_cleanup_decode/", "htj2k_cleanup_encode/", "htj2k_cleanup_encode_distribution/", "htj2k_refinement_fixture_decode/", "htj2k_refinement_block_decode/", "htj2k_refinement_sigprop_phase/", "htj2k_cpuupload_decode_batch/", "htj2k_region_scaled_plan_build/", "htj2k_feeder_coalesce/", "j2k_public_decode/htj2k_")
ENFORCED_PARTS = ("_htj2k_", "/htj2k_")


def is_enforced(id_: Column, exceptions: tuple[str, ...] = ("htj2k_cleanup_encode_parallel_", "htj2k_metal_route/")) -> Column:
    out = F.lit(False)
    for p in ENFORCED_PREFIXES:
        out = out | F.startswith(id_, F.lit(p))
    for p in ENFORCED_PARTS:
        out = out | F.contains(id_, F.lit(p))
    for p in exceptions:
        out = out & ~F.startswith(id_, F.lit(p))
    return out


def fastest(own: Column, others: dict[str, Column], name: str = "own") -> Column:
    """The fastest entrant; within one per cent of the best, ``own`` wins; null if none was measured."""
    best = F.least(own, *others.values())
    out = F.when(own.isNotNull() & (F.greatest(own, best) > 0) & (F.abs(own - best) * 100 <= F.greatest(own, best)), name)
    for other, x in others.items():
        out = out.when(x == best, other)
    return out


def csv_lines(rows: DataFrame, columns: list[str], quoted: tuple[str, ...] = ()) -> DataFrame:
    """Each row as a line of CSV, in input columns' order; nulls are empty; doubled quotes in quoted columns."""
    cells = [F.concat(F.lit('"'), F.replace(F.coalesce(F.col(c).cast("string"), F.lit("")), F.lit('"'), F.lit('""')), F.lit('"')) if c in quoted else F.coalesce(F.col(c).cast("string"), F.lit("")) for c in columns]
    return rows.withColumn("line", F.concat_ws(",", *cells))


def markdown(rows: DataFrame, others: dict[str, str]) -> DataFrame:
    """The win and loss table by operation, as (n, line); rows hold operation, own, each of ``others``, and error."""
    own = F.col("own")
    label = {k: compare(own, F.col(c)) for k, c in others.items()}
    won = fastest(own, {k: F.col(c) for k, c in others.items()})
    aggs = [F.count_if(won == "own").alias("fastest")]
    for k in others:
        aggs += [F.count_if(label[k] == "win").alias(f"{k}_wins"), F.count_if(label[k] == "loss").alias(f"{k}_losses")]
    table = rows.groupBy("operation").agg(*aggs, F.count("error").alias("failures"))
    names = ["operation", "fastest", *(f"{k}_{x}" for k in others for x in ("wins", "losses")), "failures"]
    body = table.select(F.struct(F.lit(1).alias("a"), F.col("operation").alias("b")).alias("_at"), F.concat(F.lit("| "), F.concat_ws(" | ", *names), F.lit(" |")).alias("line"))
    spark = rows.sparkSession
    head = spark.createDataFrame([((0, "0"), f"| {' | '.join(names)} |"), ((0, "1"), "|---|" + "---:|" * (len(names) - 1))], "_at struct<a int, b string>, line string")
    return numbered(head.union(body), "_at")


def discover_estimates(spark, root: str) -> DataFrame:
    """(id, median, lower, upper) of every estimates.json below ``root``, by id: the path between root and file.

    A file without a median estimate is left out.
    """
    kind = "median struct<point_estimate double, confidence_interval struct<lower_bound double, upper_bound double>>"
    found = spark.read.schema(kind).option("recursiveFileLookup", "true").option("pathGlobFilter", "estimates.json").option("multiLine", "true").json(root).select("median", "_metadata.file_path")
    id_ = F.regexp_extract("file_path", ".*?/" + root.rstrip("/").rsplit("/", 1)[-1] + "/(.*)/new/estimates.json$", 1)
    return found.filter("median is not null").select(id_.alias("id"), F.col("median.point_estimate").alias("median"), F.col("median.confidence_interval.lower_bound").alias("lower"), F.col("median.confidence_interval.upper_bound").alias("upper")).filter("id <> ''").orderBy("id")
