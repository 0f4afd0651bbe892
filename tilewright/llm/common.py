"""Helpers shared by the training-data operators: shared storage, row keys, vectorised word hashing."""

from __future__ import annotations

import gc
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# ------------------------------------------------------------------ shared storage


def shared_dir(spark: SparkSession) -> str:
    """A fresh folder under ``spark.checkpoint.dir``, which every executor can read.

    Where the session names none (tests on one machine), one below the warehouse is used.
    """
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        base = spark.conf.get("spark.sql.warehouse.dir").rstrip("/") + "/_stages"
    return f"{base.rstrip('/')}/tw-{uuid.uuid4().hex}"


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def materialise(df: DataFrame) -> DataFrame:
    """Write to the shared folder and read back: cuts lineage and survives lost executors."""
    spark = df.sparkSession
    path = shared_dir(spark)
    before = spark.conf.get(_CLEANUP, "false")
    spark.conf.set(_CLEANUP, "true")  # the plan's shuffle files go when it is written
    try:
        df.write.option("compression", "zstd").parquet(path)
    finally:
        spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def release(spark: SparkSession) -> None:
    """Let Spark's cleaner drop shuffle files of plans that nothing refers to any more."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def row_keyed(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame | None]:
    """(rows of ``_k`` long and ``_text``, map from ``_k`` back to the id, or None if ``_k`` is the id).

    With unique non-null ids the id itself is the key and nothing is written. Otherwise rows are
    sorted by (id, text), nulls first, numbered in that order and written to the shared folder, so
    that repeated or null ids keep one row each and the numbering is stable under retries.
    """
    flat = docs.select(F.col(id_col).cast("long").alias("_id"), F.col(text_col).cast("string").alias("_text"))
    repeated = flat.groupBy("_id").agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or _id is null").limit(1).count()
    if not repeated:
        return flat.select(F.col("_id").alias("_k"), "_text"), None
    ordered = flat.repartitionByRange(F.col("_id").asc_nulls_first(), F.col("_text").asc_nulls_first()).sortWithinPartitions(F.col("_id").asc_nulls_first(), F.col("_text").asc_nulls_first())
    keyed = materialise(ordered.withColumn("_k", F.monotonically_increasing_id()))
    return keyed.select("_k", "_text"), keyed.select("_k", "_id")


def unkeyed(result: DataFrame, ids: DataFrame | None, *key_cols: str) -> DataFrame:
    """Replace ``_k`` (and any other key columns) of a result by the ids they stand for."""
    for name, to in ((c, "doc_id" if c == "_k" else c) for c in ("_k", *key_cols)):
        if ids is None:
            result = result.withColumnRenamed(name, to) if name != to else result
        else:
            m = ids.select(F.col("_k").alias("_m"), F.col("_id").alias("_mid"))
            result = result.join(m, F.col(name) == F.col("_m"), "left").drop(name, "_m").withColumnRenamed("_mid", to)
    return result


def with_row_key(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``docs`` with ``_row``, a long that no two rows share, so that results per row can be joined back.

    With unique non-null ids ``_row`` is the id and nothing is written. Otherwise whole rows are
    sorted as row_keyed does, by (id, text), nulls first, then by the other columns and their place
    in the input, numbered in that order and written to the shared folder. The place also spreads
    rows that are equal throughout over partitions.
    """
    key = F.col(id_col).cast("long")
    repeated = docs.groupBy(key.alias("_id")).agg(F.count(F.lit(1)).alias("n")).filter("n > 1 or _id is null").limit(1).count()
    if not repeated:
        return docs.withColumn("_row", key)
    others = [c for c in docs.columns if c not in (id_col, text_col)]
    order = [key.asc_nulls_first(), *(F.col(c).asc_nulls_first() for c in (text_col, *others, "_place"))]
    ordered = docs.withColumn("_place", F.monotonically_increasing_id()).repartitionByRange(*order).sortWithinPartitions(*order)
    return materialise(ordered.drop("_place").withColumn("_row", F.monotonically_increasing_id()))


# ------------------------------------------------------------------ bytes and words

_MASK = (1 << 64) - 1
_BASE = 0x9E3779B97F4A7C15
_INV = pow(_BASE, -1, 1 << 64)
#: Bytes hashed at once; larger inputs are cut at white space.
PIECE = 1 << 20

_pow = np.ones(1, np.uint64)
_inv = np.ones(1, np.uint64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the hash base and of its inverse modulo 2**64, at least n of each."""
    global _pow, _inv
    if len(_pow) < n:
        m = max(n, PIECE + 1)
        with np.errstate(over="ignore"):
            _pow = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, _BASE, np.uint64))])
            _inv = np.concatenate([np.ones(1, np.uint64), np.cumprod(np.full(m, _INV, np.uint64))])
    return _pow, _inv


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every input bit reaches every output bit."""
    h = h ^ (h >> np.uint64(30))
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
#: White space and every ASCII character but digits and letters.
PUNCT = np.zeros(256, bool)
PUNCT[:0x30] = PUNCT[0x3A:0x61] = PUNCT[0x7B:0x80] = True


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; null counts as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_binary())
    if column.null_count:
        column = column.fill_null(b"")
    if not len(column):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = column.buffers()[2]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    return data[off[0] : off[-1]], off - off[0]


def doc_groups(off: np.ndarray, limit: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of consecutive documents of at most ``limit`` bytes together, or one longer document."""
    n, i = len(off) - 1, 0
    while i < n:
        j = max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1)
        yield i, j
        i = j


def word_hashes(data: np.ndarray, off: np.ndarray, breaks: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words (A-Z lower-cased) in order, and each document's first word's index.

    ``data`` and ``off`` as utf8() gives them; no word reaches over a document's end.
    """
    n = len(data)
    if not n:
        return np.zeros(0, np.uint64), np.zeros(len(off), np.int64)
    low = LOWER[data]
    sep = breaks[low]
    first = np.zeros(n + 1, bool)
    first[off[off < n]] = True
    prev = np.empty(n, bool)
    prev[0] = True
    prev[1:] = sep[:-1]
    starts = np.flatnonzero(~sep & (prev | first[:n]))
    nxt = np.empty(n, bool)
    nxt[-1] = True
    nxt[:-1] = sep[1:] | first[1:n]
    ends = np.flatnonzero(~sep & nxt) + 1
    out = np.empty(len(starts), np.uint64)
    a = 0
    with np.errstate(over="ignore"):
        while a < len(starts):
            lo = starts[a]
            b = max(a + 1, int(np.searchsorted(ends, lo + PIECE, "right")))
            hi = ends[b - 1]
            p, inv = powers(int(hi - lo) + 1)
            c = np.zeros(hi - lo + 1, np.uint64)
            np.cumsum((low[lo:hi].astype(np.uint64) + np.uint64(1)) * p[: hi - lo], out=c[1:])
            s, e = starts[a:b] - lo, ends[a:b] - lo
            out[a:b] = mix((c[e] - c[s]) * inv[s] + (e - s).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
            a = b
    return out, np.searchsorted(starts, off)


_GRAM = [0x9FB21C651E98DF25, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3, 0x1D8E4E27C47D124F]


def gram_hashes(words: np.ndarray, k: int) -> np.ndarray:
    """Hash of each k consecutive words; k entries fewer one than words."""
    if len(words) < k:
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        h = np.full(len(words) - k + 1, k, np.uint64)
        for i in range(k):
            h = mix(h + words[i : len(words) - k + 1 + i]) * np.uint64(_GRAM[i % 8])
        return mix(h)


def shingle_sets(data: np.ndarray, off: np.ndarray, k: int) -> Iterator[np.ndarray]:
    """Each document's sorted distinct k-word shingles as hashes; with fewer words the whole sequence as one; without words empty."""
    for i, j in doc_groups(off):
        w, at = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i])
        g = gram_hashes(w, k)
        for d in range(j - i):
            a, b = at[d], at[d + 1]
            if b - a >= k:
                yield np.unique(g[a : b - k + 1])
            elif b > a:
                yield gram_hashes(w[a:b], int(b - a))
            else:
                yield np.zeros(0, np.uint64)
