"""Benchmark decontamination by winnowing, in DataFrame functions only.

Texts become words; every K consecutive words get a hash, and of each W consecutive hashes the
least is kept. A window of W + K - 1 words holds W of those hashes, so the window's least hash is
its fingerprint, and equal windows have equal fingerprints: no occurrence of a window is missed.
Documents are cut into pieces of bounded length that overlap by a window less one word; a piece's
distinct fingerprints are matched with those of benchmark items, and where one matches, the piece's
windows with that fingerprint, and no others, go on and are compared as text. A text is read
once, is never shuffled, and the plan is the same at every size. Items shorter than a window have
one fingerprint, of all their words, matched with the documents' grams of as many words.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import materialise, release, row_keyed, unkeyed

WINDOW, K = 10, 5
#: Benchmark windows go against all documents in blocks of at most so many (and a bounded number of bytes), each broadcast.
BLOCK, BLOCK_BYTES = 500_000, 64 << 20
#: Windows that begin in one piece of a text.
PIECE = 2048

_SPLIT = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: Only characters that lower() leaves alone or that are A-Z.
_PLAIN = r"^[\x00-\x7F\p{Ll}\p{Lo}\p{Mn}\p{Nd}\p{P}\p{Sc}\p{Sm}\p{Zs}]*$"
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _once(value: Column, use) -> Column:
    """use(value), with the value computed once a row though a lambda function reads it again and again."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def _loose(value: Column) -> Column:
    """The same array, copied out of its row: slice() copies an array that lies in a row whole each time."""
    return F.transform(value, lambda x: x)


def words(text: Column) -> Column:
    """``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after lower-casing A-Z; null gives no words."""
    low = F.when(text.rlike(_PLAIN), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(F.coalesce(low, F.lit("")), _SPLIT), "")


def _from(array: Column, n: int) -> Column:
    return F.slice(array, n + 1, F.greatest(F.size(array) - n, F.lit(0)))


def _grams(w: Column, k: int) -> Column:
    """Hash of each k consecutive words, from hashes of 1, 2, 4, ... words; none if there are fewer."""

    def joined(x: Column, y: Column, apart: int) -> Column:
        return F.zip_with(x, _from(y, apart), lambda p, q: F.xxhash64(p, q))

    def grow(h: Column, size: int, done: Column | None, have: int) -> Column:
        if k & size:
            done, have = (h, size) if done is None else (joined(done, h, have), have + size)
        if have == k:
            return F.slice(done, 1, F.greatest(F.size(h) - (k - 1), F.lit(0)))
        return _once(joined(h, h, size), lambda twice: grow(twice, 2 * size, done, have))

    return _once(F.transform(w, lambda x: F.xxhash64(x)), lambda h: grow(h, 1, None, 0))


def _least(grams: Column, width: int) -> Column:
    """The least hash of each ``width`` consecutive ones, the fingerprint of the window that begins there."""

    def grow(x: Column, have: int) -> Column:
        if have == width:
            return F.slice(x, 1, F.greatest(F.size(x) - (width - 1), F.lit(0)))
        step = min(have, width - have)
        return _once(F.zip_with(x, _from(x, step), lambda p, q: F.least(p, q)), lambda y: grow(y, have + step))

    return _once(grams, lambda g: grow(g, 1))


def _prints(w: Column, m: int, window: int, k: int) -> Column:
    """Fingerprints of all windows of m words, in order."""
    return _least(_grams(w, k), window - k + 1) if m == window else _grams(w, m)


def _windows(w: Column, prints: Column, m: Column | int, wanted: Column) -> Column:
    """(place from 0, text) of the windows of m words whose fingerprint is ``wanted``."""
    at = F.filter(F.sequence(F.lit(1), F.size(prints)), lambda i: F.get(prints, i - 1) == wanted)
    return _once(_loose(w), lambda v: F.transform(at, lambda i: F.struct((i - 1).alias("p"), F.array_join(F.slice(v, i, m), " ").alias("window"))))


def _benchmark_windows(benchmark: DataFrame, window: int, k: int) -> tuple[DataFrame, DataFrame]:
    """(distinct windows with their number, length and fingerprint; the items of each window), both written."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("null")).alias("item"), words(F.col("text")).alias("w")).filter(F.size("w") > 0)
    items = items.withColumn("m", F.least(F.size("w"), F.lit(window)))
    each = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("m") + 1), lambda i: F.slice(F.col("w"), i, F.col("m")))
    found = items.select("item", "m", F.explode(each).alias("w"))
    found = found.select("item", "m", F.array_join("w", " ").alias("window"), F.col("w")).distinct()
    whole = F.coalesce(*[F.when(F.size("w") == m, F.array_min(_grams(F.col("w"), k if m == window else m))) for m in range(1, window + 1)])
    found = materialise(found.select("item", "m", "window", whole.alias("f")))
    numbered = materialise(found.select("m", "window", "f").distinct().withColumn("wid", F.monotonically_increasing_id()))
    return numbered, materialise(found.join(numbered, ["m", "window", "f"]).select("wid", "item"))


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, k: int = K, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A window is ``window`` consecutive words of an item, or all of an item that has fewer but not
    none. A document's word inside any occurrence of a window is hit; items are those with an
    occurring window, and items_sha256 is of their ids, sorted as strings and comma-joined. Null
    or empty texts have no words; null item ids count as the id ``null``; repeated item ids are one
    item. Rows with equal or null doc ids are documents of their own; empty tables give no hits or
    no rows; very long texts are read whole, in pieces; other columns are ignored.
    """
    rows, ids = row_keyed(docs, id_col, text_col)
    numbered, of_items = _benchmark_windows(benchmark, window, k)
    total = numbered.agg(F.count(F.lit(1)), F.sum(F.octet_length("window")), F.sort_array(F.collect_set("m"))).first()
    lengths, blocks = total[2], max(1, -(-total[0] // BLOCK), -(-(total[1] or 0) // BLOCK_BYTES))

    def pieces_of(w: Column) -> Column:
        starts = F.sequence(F.lit(0), F.greatest(F.size(w) - 1, F.lit(0)), F.lit(PIECE))
        return F.struct(F.size(w).cast("long").alias("n_words"), F.transform(starts, lambda s: F.struct(s.alias("base"), F.slice(w, s + 1, PIECE + window - 1).alias("w"))).alias("pieces"))

    cut = rows.select("_k", _once(words(F.col("_text")), pieces_of).alias("x"))
    pieces = cut.select("_k", "x.n_words", F.explode_outer("x.pieces").alias("x")).select("_k", "n_words", "x.base", "x.w")

    # a piece holds the windows that begin in it; of shorter ones, it ends after more than PIECE
    kinds = _once(_loose(F.col("w")), lambda w: F.array(*[F.struct(F.lit(m).alias("m"), F.slice(_prints(w, m, window, k), 1, PIECE).alias("prints")) for m in lengths or [window]]))
    kinds = pieces.select("_k", "n_words", "base", "w", F.explode_outer(kinds).alias("x")).select("_k", "n_words", "base", "w", "x.m", "x.prints")
    found = None
    for b in range(blocks):
        part = numbered.filter(F.pmod(F.xxhash64("wid"), F.lit(blocks)) == b) if blocks > 1 else numbered
        # a null fingerprint stands for the document itself, whatever it matches
        itself = (F.col("base") == 0) & (F.col("m") == F.lit((lengths or [window])[0])) & F.lit(b == 0)
        mark = F.when(itself, F.array(F.lit(None).cast("bigint"))).otherwise(F.array().cast("array<bigint>"))
        # explode_outer, as explode would have the arrays computed once more to filter out the empty ones
        spread = kinds.select("_k", "n_words", "base", "w", "m", "prints", F.explode_outer(F.concat(mark, F.array_distinct("prints"))).alias("f"))
        known = part.select("m", "f").distinct().withColumn("hit", F.lit(1))
        met = spread.join(F.broadcast(known), ["m", "f"], "left").filter((F.col("hit") == 1) | (F.col("f").isNull() & itself))
        at = F.when(F.col("f").isNotNull(), _windows(F.col("w"), F.col("prints"), F.col("m"), F.col("f")))
        met = met.select("_k", "n_words", "m", "base", F.explode_outer(at).alias("x")).select("_k", "n_words", "m", (F.col("base") + F.col("x.p")).alias("p"), "x.window")
        met = met.join(F.broadcast(part.select("m", "window", "wid")), ["m", "window"], "left").filter("wid is not null or window is null").select("_k", "n_words", "m", "p", "wid")
        found = met if found is None else found.union(met)
    found = materialise(found)
    release(docs.sparkSession)

    occur = found.filter("wid is not null")
    covered = occur.select("_k", F.explode(F.sequence(F.col("p"), F.col("p") + F.col("m") - 1)).alias("p")).distinct().groupBy("_k").agg(F.count(F.lit(1)).alias("n_hit"))
    which = occur.select("_k", "wid").distinct().join(of_items, "wid").select("_k", "item").distinct().groupBy("_k").agg(F.count(F.lit(1)).alias("n_items"), F.array_join(F.array_sort(F.collect_list("item")), ",").alias("names"))
    out = found.filter("p is null").select("_k", "n_words").join(covered, "_k", "left").join(which, "_k", "left")
    out = out.select("_k", "n_words", F.coalesce("n_hit", F.lit(0)).alias("n_hit"), F.coalesce("n_items", F.lit(0)).alias("n_items"), F.sha2(F.coalesce("names", F.lit("")).cast("binary"), 256).alias("items_sha256"))
    out = out.withColumn("contaminated", F.col("n_hit") > 0)
    return unkeyed(out, ids).select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")
