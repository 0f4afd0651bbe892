"""Near-duplicate groups: a chosen-path set similarity join over word shingles.

Every document is the set of its k-word shingles. Copies of a set fall into one class first, by a
digest of the whole set, and only each class's smallest row goes on. A tree branches a document by
selected minwise tokens: at a node, the path's own hash picks one or two of the signature's
minwise coordinates, and each token found there leads to a child. Because the choice depends on
the path alone, a document finds all its nodes without looking at others. Nodes that hold one
document end there. In every other node, all documents are compared with the node's smallest
one; then, in nodes that still hold more than one component, small ones are compared exhaustively
and large ones branch again. Further trees repeat this; a pair that meets in several small
nodes is compared in one of them.

Signatures only rule pairs out, with a margin of many standard errors; each link is confirmed on
the full sets, recomputed from the texts. A pair at the threshold survives a branching with
probability 0.88 and any depth with over 0.6. All trees draw on the same coordinates, so they don't
miss quite independently: by calculation, all twelve miss a pair at 0.80 with about 4 in 10**7 at
depth 4, 6 in 10**6 at depth 8 and 3 in 10**5 at depth 30, and closer pairs more rarely.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialise, mix, release, row_keyed, shingle_sets, unkeyed, utf8
from .components import components

#: Minwise coordinates. Trees branch by any of them, to 16 bits; the sketch that rules pairs out has the low 8 bits of all.
COORDS = 512
TREES = 12
#: Nodes of at most so many documents are compared exhaustively.
SMALL = 4096
#: Depth of the first nodes, and levels between one look at the nodes and the next.
START = STEP = 2
#: Pairs whose estimated similarity is this much below the threshold aren't confirmed; over four standard errors.
MARGIN = 0.08

_rng = np.random.default_rng(0x5EED)
_A = (_rng.integers(0, 1 << 32, COORDS, np.uint64) | np.uint64(1)).astype(np.uint32)
_B = _rng.integers(0, 1 << 32, COORDS, np.uint64).astype(np.uint32)


def signature(s: np.ndarray) -> np.ndarray:
    """The minwise values of a set of hashes, one of 32 bits per coordinate."""
    out = np.full(COORDS, 0xFFFFFFFF, np.uint32)
    x = (s >> np.uint64(32)).astype(np.uint32)
    rows = np.empty((min(len(x), 128), COORDS), np.uint32)  # stays in the processor's cache
    for i in range(0, len(x), 128):
        part = rows[: len(x) - i]
        np.multiply(x[i : i + 128, None], _A, out=part)
        np.add(part, _B, out=part)
        np.minimum(out, part.min(0), out=out)
    return out


def _seed(tree: int) -> int:
    return (tree + 1) * 0x632BE59BD9B4E019 & ((1 << 64) - 1)


def branch(path: np.ndarray, row: np.ndarray, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The children of nodes ``path``, each holding the document whose coordinates are in row ``row``."""
    with np.errstate(over="ignore"):
        pick = mix(path + np.uint64(0xA5A5A5A5))
        one = (pick >> np.uint64(8)) % np.uint64(COORDS)
        two = (one + np.uint64(1) + (pick >> np.uint64(24)) % np.uint64(COORDS - 1)) % np.uint64(COORDS)
        more = (pick & np.uint64(1)).astype(bool)
        paths = np.concatenate([path, path[more]])
        rows = np.concatenate([row, row[more]])
        at = np.concatenate([one, two[more]])
        token = high[rows, at.astype(np.int64)].astype(np.uint64) << np.uint64(8) | low[rows, at.astype(np.int64)]
        return mix(paths * np.uint64(0x9FB21C651E98DF25) + mix(at * np.uint64(0x100000001B3) + (token << np.uint64(8)))), rows


def _features(k: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            n, digest, low, high = [], [], [], []
            for s in shingle_sets(data, off, k):
                n.append(len(s))
                g = signature(s)
                low.append(g.astype(np.uint8).tobytes())
                high.append((g >> np.uint32(8)).astype(np.uint8).tobytes())
                digest.append(hashlib.blake2b(s.tobytes(), digest_size=16).digest())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), pa.array(digest, pa.binary()), pa.array(low, pa.binary()), pa.array(high, pa.binary())], ["_k", "n", "digest", "low", "high"])

    return run


def _coordinates(column: pa.Array) -> np.ndarray:
    return np.frombuffer(b"".join(column.to_pylist()), np.uint8).reshape(-1, COORDS)


def _nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_k, low, high) -> (node, _k): all nodes at depth START, over all trees."""
    for b in batches:
        if not b.num_rows:
            continue
        low, high = _coordinates(b.column(1)), _coordinates(b.column(2))
        ids = b.column(0).to_numpy(zero_copy_only=False)
        for t in range(TREES):
            row = np.arange(len(ids))
            path = np.full(len(ids), _seed(t), np.uint64)
            for _ in range(START):
                path, row = branch(path, row, low, high)
            yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[row])], ["node", "_k"])


def _children(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(node, _k, low, high) -> (node, _k), STEP levels further."""
    for b in batches:
        if not b.num_rows:
            continue
        low, high = _coordinates(b.column(2)), _coordinates(b.column(3))
        path, row = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64), np.arange(len(low))
        for _ in range(STEP):
            path, row = branch(path, row, low, high)
        ids = b.column(1).to_numpy(zero_copy_only=False)
        yield pa.RecordBatch.from_arrays([pa.array(path.view(np.int64)), pa.array(ids[row])], ["node", "_k"])


def _pairs(least: float):
    """Rows (node, _k, low, root, nodes) sorted by node and _k -> candidate pairs (a, b).

    In a node of at most SMALL rows, every two rows of different components are compared, but for
    those that meet in a node with a smaller number, too: they are compared there. ``nodes`` are
    the row's nodes that this holds for. At most SMALL rows are held.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        node = None
        out_a: list[int] = []
        out_b: list[int] = []

        def flush():
            if held:
                sig = np.frombuffer(b"".join(h[1] for h in held), np.uint8).reshape(-1, COORDS)
                roots = np.array([h[2] for h in held])
                met: dict[int, list[int]] = {}
                for i, h in enumerate(held):
                    apart = roots[:i] != roots[i]
                    for other in h[3]:
                        if other < node:
                            rows = met.setdefault(other, [])
                            apart[rows] = False
                            rows.append(i)
                    other = np.flatnonzero(apart)
                    if len(other):
                        same = np.count_nonzero(sig[other] == sig[i], axis=1)
                        near = other[same >= least * COORDS]
                        out_a.extend([h[0]] * len(near))
                        out_b.extend(held[j][0] for j in near)
                held.clear()

        for b in batches:
            for nd, k, low, root, nodes in zip(*(b.column(i).to_pylist() for i in range(5)), strict=True):
                if nd != node:
                    flush()
                    node = nd
                held.append((k, low, root, nodes))
            if len(out_a) > 4096:
                yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])
                out_a, out_b = [], []
        flush()
        yield pa.RecordBatch.from_arrays([pa.array(out_a, pa.int64()), pa.array(out_b, pa.int64())], ["a", "b"])

    return run


def _with_lead(least: float):
    """(a, b, low_a, low_b) -> the pairs whose signatures don't rule them out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x, y = (_coordinates(b.column(i)) for i in (2, 3))
                yield b.select([0, 1]).filter(pa.array((x == y).mean(1) >= least))

    return run


def _confirm(k: int, percent: int):
    """(a, b, text_a, text_b) in order of b -> links (u, v) with 100 * intersection >= percent * union on full sets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, kept = None, np.zeros(0, np.uint64)
        for b in batches:
            keep = []
            data, off = utf8(b.column(2))
            other, at = utf8(b.column(3))
            names = b.column(1).to_pylist()
            for i, s in enumerate(shingle_sets(data, off, k)):
                if names[i] != last:
                    last = names[i]
                    kept = next(shingle_sets(other[at[i] : at[i + 1]], np.array([0, at[i + 1] - at[i]]), k))
                both = len(np.intersect1d(s, kept, assume_unique=True))
                keep.append(100 * both >= percent * (len(s) + len(kept) - both) and both > 0)
            yield b.select([0, 1]).filter(pa.array(keep, pa.bool_())).rename_columns(["u", "v"])

    return run


def near_duplicates(docs: DataFrame, shingle: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_shingles, component_id (smallest id reachable over links), kept.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z; a set holds the distinct shingles of
    ``shingle`` words, or the whole sequence where there are fewer. Documents with
    100 * intersection >= percent * union are linked. A null or empty text, or one without words,
    has no set and is linked with nothing. Rows with equal or null ids are documents of their own,
    and only one row of a component has kept true. Very long texts are read whole, in pieces. An
    empty table gives no rows. Columns other than the id and the text are ignored.
    """
    spark = docs.sparkSession
    rows, ids = row_keyed(docs, id_col, text_col)
    least = percent / 100 - MARGIN
    feats = materialise(rows.mapInArrow(_features(shingle), "_k long, n long, digest binary, low binary, high binary"))
    release(spark)
    classes = feats.filter("n > 0").groupBy("digest").agg(F.min("_k").alias("root"))
    member = materialise(feats.filter("n > 0").select("_k", "digest").join(classes, "digest").select("_k", "root"))
    reps = feats.join(member.filter("_k = root").select("_k"), "_k", "left_semi").select("_k", "low", "high")
    reps = materialise(reps)
    feats = feats.select("_k", "n")

    nodes = reps.mapInArrow(_nodes, "node long, _k long")
    shared = nodes.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min("_k").alias("lead")).filter("c > 1")
    level = materialise(nodes.join(shared, "node").select("node", "_k", "lead"))
    release(spark)
    alive = level.select("_k").distinct()
    texts = materialise(rows.join(alive, "_k", "left_semi"))
    release(spark)
    low = reps.select("_k", "low")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = materialise(pairs.distinct())
        first = pairs.join(texts.select(F.col("_k").alias("a"), F.col("_text").alias("ta")), "a")
        both = first.join(texts.select(F.col("_k").alias("b"), F.col("_text").alias("tb")), "b")
        return both.select("a", "b", "ta", "tb").mapInArrow(_confirm(shingle, percent), "u long, v long")

    def with_leads(rows_: DataFrame) -> DataFrame:
        """Pairs of a row and its node's lead that the signatures don't rule out."""
        p = rows_.filter("_k <> lead").select(F.col("_k").alias("a"), F.col("lead").alias("b")).distinct()
        p = p.join(low.select(F.col("_k").alias("a"), F.col("low").alias("la")), "a").join(low.select(F.col("_k").alias("b"), F.col("low").alias("lb")), "b")
        return p.select("a", "b", "la", "lb").mapInArrow(_with_lead(least), "a long, b long")

    links = materialise(confirmed(with_leads(level)))
    roots = materialise(components(links))
    release(spark)
    depth = START
    while True:
        depth += STEP
        rooted = level.join(roots, level._k == roots.node, "left").select(level.node, "_k", F.coalesce("root", "_k").alias("root"))
        open_ = rooted.groupBy("node").agg(F.count(F.lit(1)).alias("c"), F.min("root").alias("r0"), F.max("root").alias("r1"), F.min_by("_k", F.xxhash64("_k", F.lit(depth))).alias("lead"))
        open_ = open_.filter("r0 <> r1").select("node", "c", "lead")
        level = materialise(rooted.join(open_, "node").join(low, "_k").select("node", "_k", "low", "root", "lead", "c"))
        if not level.limit(1).count():
            break
        small = level.filter(F.col("c") <= SMALL).select("node", "_k", "low", "root")
        small = small.join(small.groupBy("_k").agg(F.collect_list("node").alias("nodes")), "_k").select("node", "_k", "low", "root", "nodes")
        small = small.repartition("node").sortWithinPartitions("node", "_k").mapInArrow(_pairs(least), "a long, b long")
        large = level.filter(F.col("c") > SMALL)
        more = materialise(confirmed(small.union(with_leads(large.select("node", "_k", "lead")))))
        deeper = large.select("node", "_k").join(reps, "_k").select("node", "_k", "low", "high").mapInArrow(_children, "node long, _k long")
        links = links.union(more)
        if more.limit(1).count():
            links = materialise(links)
            roots = materialise(components(links))
        level = materialise(deeper)
        release(spark)
        if not level.limit(1).count():
            break

    least_of = member.join(roots, member.root == roots.node, "left").select("_k", F.coalesce(roots.root, member.root).alias("component_id"))
    out = feats.join(least_of, "_k", "left").select("_k", F.col("n").alias("n_shingles"), F.coalesce("component_id", "_k").alias("component_id"))
    out = out.withColumn("kept", F.col("component_id") == F.col("_k"))
    return unkeyed(out, ids, "component_id").select("doc_id", "n_shingles", "component_id", "kept")
