"""Order-preserving batches: chunks, grouping of like requests, repeats, and the first error."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def worker_count(batch: Column, workers: Column, available: Column) -> Column:
    """Workers for a batch: one for a single job, else what is asked for or available, at most a job each."""
    return F.when(batch <= 1, F.lit(1).cast("long")).otherwise(F.least(F.greatest(F.coalesce(workers, available), F.lit(1)), batch))


def first_error(results: DataFrame, batch: str, idx: str, error: str) -> DataFrame:
    """Per batch: jobs, and the error with the lowest index."""
    return results.groupBy(batch).agg(F.count(F.lit(1)).alias("jobs"), F.min(F.when(F.col(error).isNotNull(), F.col(idx))).alias("error_idx"), F.min_by(error, F.when(F.col(error).isNotNull(), F.col(idx))).alias("error"))


def groups(requests: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """Like requests; ``first_idx`` orders the groups as they were first seen. Partial aggregation, no ordering of members."""
    out = requests.groupBy(*keys).agg(F.min(idx).alias("first_idx"), F.max(idx).alias("last_idx"), F.count(F.lit(1)).alias("requests"))
    return out


def mark_repeats(requests: DataFrame, keys: list[str], idx: str) -> DataFrame:
    """Each request with the index of the first one that is the same."""
    first = requests.groupBy(*[F.col(k).alias(f"_{k}") for k in keys]).agg(F.min(idx).alias("source_idx"))
    cond = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return requests.join(first, cond).select(*requests.columns, "source_idx")


def checkpoint_at(targets: DataFrame, checkpoints: DataFrame, stream: str, target: str, at: str, span: int = 1 << 12) -> DataFrame:
    """As-of lookup: per target, the greatest checkpoint of its stream that isn't after it.

    Streams are cut into spans of positions. Within one, a union is sorted and carries a running
    maximum; a small table of each span's last checkpoint carries over what lies before. No range
    join, and no stream's rows all meet in one task.
    """
    both = targets.select(stream, F.col(target).alias("_p"), F.lit(None).cast("long").alias("_c"), F.lit(1).alias("_t")).union(checkpoints.select(stream, F.col(at).alias("_p"), F.col(at).cast("long"), F.lit(0)))
    both = both.withColumn("_s", F.floor(F.col("_p") / span))
    w = Window.partitionBy(stream, "_s").orderBy("_p", "_t").rowsBetween(Window.unboundedPreceding, 0)
    own = both.withColumn("_own", F.max("_c").over(w)).filter("_t = 1")
    last = both.groupBy(stream, "_s").agg(F.max("_c").alias("_last"))
    carried = F.max("_last").over(Window.partitionBy(F.col(stream)).orderBy("_s").rowsBetween(Window.unboundedPreceding, -1))
    last = last.select(F.col(stream).alias("_stream"), F.col("_s").alias("_span"), carried.alias("_carried"))
    out = own.join(last, F.col(stream).eqNullSafe(F.col("_stream")) & (F.col("_s") == F.col("_span")))
    return out.select(stream, F.col("_p").alias(target), F.coalesce("_own", "_carried").alias("checkpoint"))
