"""Repeated-substring removal: prefix doubling over text positions.

Sorting a rank pair for every byte in every round would shuffle some forty bytes a byte of text, so
positions that cannot matter leave first. In the window of each position, the least hash of its
32-byte strings is the position's sieve rank, and neighbouring positions with the same one form a
run. Spark sorts (sieve rank, rank of the run's whole span, position): runs alone with their sieve
rank are unique and end there, runs whose span has come before are repeats throughout. Equal
strings have the same sieve rank, since it depends on the string alone, so no repeat is missed.

The positions still open, each span's first run among others with its sieve rank, are ranked by
prefix doubling. Round one sorts the pairs (rank of 32 bytes, rank of the 32 bytes at offset 32);
places in the sorted order are the dense ranks of 64 bytes, and positions with a rank of their own
end. Round two brings a position's rank and the one at offset 36 together by document, and sorts
these pairs: equal pairs are equal strings of LENGTH bytes, the threshold, and all but a pair's
first position start with a string that has come before. Round one goes over the ranks in PASSES
parts, one after another, which bounds the disk it takes.

Ranks of 32 bytes and of spans are 64-bit fingerprints; a pair holds two of them.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_groups, materialise, mix, powers, release, row_keyed, unkeyed, utf8

LENGTH, GRAM = 100, 32
#: Offset at which round two takes its second rank, of 64 bytes each.
STEP = LENGTH - 2 * GRAM
#: Parts of the rank space that round one sorts in turn.
PASSES = 4
#: Positions of one row of open text at most.
_STRETCH = 1 << 16


def _prefix(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    p, inv = powers(len(data) + 1)
    c = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * p[: len(data)], out=c[1:])
    return c, inv


def _sliding(x: np.ndarray, width: int, op) -> np.ndarray:
    """op over each ``width`` consecutive entries."""
    have = 1
    while have < width:
        step = min(have, width - have)
        x = op(x[: len(x) - step], x[step:])
        have += step
    return x


def runs(data: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first ranks, span ranks, starts, lengths, whether a run may repeat itself) of one text."""
    n = len(data)
    if n < LENGTH:
        z = np.zeros(0, np.int64)
        return z.view(np.uint64), z.view(np.uint64), z, z, z.astype(bool)
    width = LENGTH - GRAM + 1
    with np.errstate(over="ignore"):
        c, inv = _prefix(data)
        h = mix((c[GRAM:] - c[:-GRAM]) * inv[: n - GRAM + 1])
        m = _sliding(h, width, np.minimum)
        start = np.flatnonzero(np.concatenate([[True], m[1:] != m[:-1]]))
        length = np.diff(np.append(start, len(m)))
        end = start + length - 1 + LENGTH
        span = mix((c[end] - c[start]) * inv[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    # positions whose gram is the least of some window: the greatest least of its windows is its own
    top = _sliding(np.concatenate([np.zeros(width - 1, np.uint64), m, np.zeros(width - 1, np.uint64)]), width, np.maximum)
    at = np.flatnonzero(top == h)
    near = np.flatnonzero((h[at[1:]] == h[at[:-1]]) & (at[1:] - at[:-1] <= width))
    twice = np.zeros(len(start), bool)
    for p in (at[near], at[near + 1] - width + 1):
        twice[np.searchsorted(start, np.clip(p, 0, len(m) - 1), "right") - 1] = True
    return m[start], span, start, length, twice | (length > width)


def _runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    names = ["first", "span", "_k", "s", "len", "twice"]
    for b in batches:
        data, off = utf8(b.column(1))
        keys = b.column(0).to_numpy(zero_copy_only=False)
        for i, j in doc_groups(off):
            parts = [runs(data[off[d] : off[d + 1]]) for d in range(i, j)]
            first, span, s, n, twice = (np.concatenate(x) for x in zip(*parts, strict=True))
            k = np.repeat(keys[i:j], [len(p[2]) for p in parts])
            yield pa.RecordBatch.from_arrays([pa.array(first.view(np.int64)), pa.array(span.view(np.int64)), pa.array(k, pa.int64()), pa.array(s.astype(np.int32)), pa.array(n.astype(np.int32)), pa.array(twice)], names)


def _rerank(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs sorted by first rank, span and position -> those that repeat (open false) or are to be ranked byte by byte (open true).

    Holds one row back: the first run of a first rank's first span, until another span shows.
    """
    last_first = last_span = None
    held: tuple | None = None
    for b in batches:
        if not b.num_rows:
            continue
        f, sp, k, s, n = (b.column(i).to_numpy(zero_copy_only=False) for i in range(5))
        twice = b.column(5).to_numpy(zero_copy_only=False)
        new_f, new_s = np.ones(len(f), bool), np.ones(len(f), bool)
        new_f[1:] = f[1:] != f[:-1]
        new_s[1:] = new_f[1:] | (sp[1:] != sp[:-1])
        new_f[0] = f[0] != last_first
        new_s[0] = new_f[0] or sp[0] != last_span
        group = np.cumsum(new_f)  # group 0 goes on from the batch before
        spans = np.bincount(group, new_s, group[-1] + 1)
        opened = new_s & (twice | ~new_f | (spans[group] > 1))
        out = ~new_s | opened
        rows = [(k[out], s[out], n[out], opened[out])]
        if held is not None and spans[0]:
            rows.append(tuple(np.array([x]) for x in held))
            held = None
        if new_f.any():
            i = np.flatnonzero(new_f)[-1]
            held = None if opened[i] else (k[i], s[i], n[i], True)
        last_first, last_span = f[-1], sp[-1]
        cols = [np.concatenate(c) for c in zip(*rows, strict=True)]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.int64()), pa.array(cols[1].astype(np.int32)), pa.array(cols[2].astype(np.int32)), pa.array(cols[3].astype(bool))], ["_k", "s", "len", "open"])


def _open_texts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_k, text, runs) -> a row per stretch of open positions with the bytes their strings cover."""
    for b in batches:
        data, off = utf8(b.column(1))
        for i, found in enumerate(b.column(2).to_pylist()):
            at = np.array(sorted((r["s"], r["len"]) for r in found))
            lo, hi = at[:, 0], at.sum(axis=1)
            cut = np.flatnonzero(lo[1:] != hi[:-1])
            parts = [(x, min(x + _STRETCH, e)) for s, e in zip(lo[np.append(0, cut + 1)], hi[np.append(cut, len(hi) - 1)], strict=True) for x in range(s, e, _STRETCH)]
            for j in range(0, len(parts), 1024):
                some = parts[j : j + 1024]
                text = [data[off[i] + s : off[i] + e - 1 + LENGTH].tobytes() for s, e in some]
                yield pa.RecordBatch.from_arrays([pa.array([b.column(0)[i].as_py()] * len(some), pa.int64()), pa.array([s for s, _ in some], pa.int32()), pa.array(text, pa.binary())], ["_k", "s", "bytes"])


def _pairs(part: int):
    """Stretches -> (a, b, _k, t): ranks of 32 bytes at a position and 32 further on, t = 2 * position, and one more if it isn't open.

    The STEP positions after a stretch are ranked for round two's sake. Only ranks of the given part.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(2))
            keys, starts = b.column(0).to_numpy(zero_copy_only=False), b.column(1).to_numpy(zero_copy_only=False)
            for i, j in doc_groups(off):
                with np.errstate(over="ignore"):
                    c, inv = _prefix(data[off[i] : off[j]])
                    h = mix((c[GRAM:] - c[:-GRAM]) * inv[: len(c) - GRAM])
                base, n = off[i:j] - off[i], np.diff(off[i : j + 1])
                count = n - 2 * GRAM + 1
                row = np.repeat(np.arange(j - i), count)
                within = np.arange(len(row)) - np.repeat(np.cumsum(count) - count, count)
                at = base[row] + within
                mine = np.flatnonzero(h[at] % np.uint64(PASSES) == part)
                row, within, at = row[mine], within[mine], at[mine]
                t = 2 * (starts[i:j][row].astype(np.int64) + within) + (within > n[row] - LENGTH)
                cols = [pa.array(x) for x in (h[at].view(np.int64), h[at + GRAM].view(np.int64), keys[i:j][row], t)]
                yield pa.RecordBatch.from_arrays(cols, ["a", "b", "_k", "t"])

    return run


def _columns(b: pa.RecordBatch) -> list[np.ndarray]:
    return [b.column(i).to_numpy(zero_copy_only=False) for i in range(b.num_columns)]


def _dense(part: int):
    """Pairs sorted by (a, b, _k, t) -> (rank, _k, t) of the positions that share their pair.

    A pair's rank is its place among its task's pairs, after the part and the task. A position that
    two stretches hold counts once. One row is held back: the last, until the next shows its pair.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        base = part << 56 | TaskContext.get().partitionId() << 36
        last: list[np.ndarray] | None = None
        place, shared = 0, False  # of the row held back
        names = ["rank", "_k", "t"]
        for b in batches:
            if not b.num_rows:
                continue
            cols = _columns(b)
            if last is not None:
                cols = [np.concatenate(x) for x in zip(last, cols, strict=True)]
            a, c, k, t = cols
            same = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
            once = np.append(True, ~(same & (k[1:] == k[:-1]) & (t[1:] >> 1 == t[:-1] >> 1)))
            if not once.all():
                a, c, k, t = cols = [x[once] for x in cols]
                same = (a[1:] == a[:-1]) & (c[1:] == c[:-1])
            rank = place + np.append(0, np.cumsum(~same))
            out = np.append(shared, same)
            shared = bool(out[-1])
            out[:-1] |= same
            out = np.flatnonzero(out[:-1])
            last, place = [x[-1:] for x in cols], int(rank[-1])
            yield pa.RecordBatch.from_arrays([pa.array(base + rank[out]), pa.array(k[out]), pa.array(t[out])], names)
        if last is not None and shared:
            yield pa.RecordBatch.from_arrays([pa.array([base + place], pa.int64()), pa.array(last[2]), pa.array(last[3])], names)

    return run


def _advance(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Ranks sorted by (_k, t) -> (rank, rank at STEP further on, _k, s, later) of open positions where both are shared.

    Within a batch all but a pair's first position are later ones and needn't be sorted against the
    rest, so a common pair goes on as one row a batch.
    """
    held: list[np.ndarray] | None = None

    def pairs(cols: list[np.ndarray], upto: int) -> pa.RecordBatch:
        rank, k, t = cols
        key = np.append(0, np.cumsum(k[1:] != k[:-1])) << 32 | t >> 1
        i = np.flatnonzero(t[:upto] & 1 == 0)
        j = np.searchsorted(key, key[i] + STEP)
        hit = key[np.minimum(j, len(key) - 1)] == key[i] + STEP
        i, j = i[hit], j[hit]
        r, q = rank[i], rank[j]
        order = np.lexsort((q, r))  # stable, so a pair's positions stay in order
        later = np.zeros(len(i), bool)
        later[order[1:]] = (r[order[1:]] == r[order[:-1]]) & (q[order[1:]] == q[order[:-1]])
        return pa.RecordBatch.from_arrays([pa.array(r), pa.array(q), pa.array(k[i]), pa.array(t[i] >> 1), pa.array(later)], ["rank", "next", "_k", "s", "later"])

    for b in batches:
        if not b.num_rows:
            continue
        cols = _columns(b)
        if held is not None:
            cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
        rank, k, t = cols
        open_end = (k == k[-1]) & (t >> 1 > (t[-1] >> 1) - STEP)
        upto = int(np.argmax(open_end))
        if upto:
            yield pairs(cols, upto)
        held = [x[upto:] for x in cols]
    if held is not None:
        yield pairs(held, len(held[0]))


def _later(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Pairs sorted by (rank, next, _k, s) -> the positions of each but its first."""
    last = None
    for b in batches:
        if not b.num_rows:
            continue
        r, q, k, s = _columns(b)
        again = np.append((r[0], q[0]) == last, (r[1:] == r[:-1]) & (q[1:] == q[:-1]))
        last = (r[-1], q[-1])
        yield pa.RecordBatch.from_arrays([pa.array(k[again]), pa.array(s[again])], ["_k", "s"])


def _stretches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Positions sorted by (_k, s) -> stretches, cut at the ends of batches."""
    for b in batches:
        if not b.num_rows:
            continue
        k, s = _columns(b)
        edge = np.flatnonzero(np.append(True, (k[1:] != k[:-1]) | (s[1:] != s[:-1] + 1)))
        yield pa.RecordBatch.from_arrays([pa.array(k[edge]), pa.array(s[edge].astype(np.int32)), pa.array(np.diff(np.append(edge, len(s))).astype(np.int32))], ["_k", "s", "len"])


def _cover(found: list[dict] | None, n: int) -> np.ndarray:
    """Which of n bytes lie in a string that starts in one of the stretches."""
    edge = np.zeros(n + 1, np.int64)
    for r in found or ():
        edge[r["s"]] += 1
        edge[r["s"] + r["len"] - 1 + LENGTH] -= 1
    return np.cumsum(edge[:n]) > 0


def _finish(with_text: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            total, removed, spans, digest, texts = [], [], [], [], []
            for i, found in enumerate(b.column(2).to_pylist()):
                t = data[off[i] : off[i + 1]]
                gone = _cover(found, len(t))
                kept = t[~gone].tobytes()
                total.append(len(t))
                removed.append(int(gone.sum()))
                spans.append(int((gone & ~np.concatenate([[False], gone[:-1]])).sum()))
                digest.append(hashlib.sha256(kept).hexdigest())
                texts.append(kept.decode("utf-8", "ignore"))
            cols = [b.column(0), pa.array(total, pa.int64()), pa.array(removed, pa.int64()), pa.array(spans, pa.int64()), pa.array(digest, pa.string()), *([pa.array(texts, pa.string())] * with_text)]
            yield pa.RecordBatch.from_arrays(cols, ["_k", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"][: len(cols)])

    return run


def repeated_stretches(rows: DataFrame) -> DataFrame:
    """(_k, _text) -> (_k, s, len): every position whose LENGTH bytes start earlier, too, as stretches."""
    sparse = rows.mapInArrow(_runs, "first long, span long, _k long, s int, len int, twice boolean")
    ordered = sparse.repartition("first").sortWithinPartitions("first", "span", "_k", "s")
    sieved = materialise(ordered.mapInArrow(_rerank, "_k long, s int, len int, open boolean"))
    release(rows.sparkSession)
    left = sieved.filter("open").groupBy("_k").agg(F.collect_list(F.struct("s", "len")).alias("runs"))
    texts = materialise(rows.join(left, "_k").select("_k", "_text", "runs").mapInArrow(_open_texts, "_k long, s int, bytes binary"))
    release(rows.sparkSession)
    ranks = None
    for part in range(PASSES):
        pairs = texts.mapInArrow(_pairs(part), "a long, b long, _k long, t long").repartition("a", "b").sortWithinPartitions("a", "b", "_k", "t")
        done = materialise(pairs.mapInArrow(_dense(part), "rank long, _k long, t long"))
        ranks = done if ranks is None else ranks.union(done)
        release(rows.sparkSession)
    pairs = materialise(ranks.repartition("_k").sortWithinPartitions("_k", "t").mapInArrow(_advance, "rank long, next long, _k long, s long, later boolean"))
    release(rows.sparkSession)
    firsts = pairs.filter("not later").drop("later").repartition("rank", "next").sortWithinPartitions("rank", "next", "_k", "s")
    later = materialise(firsts.mapInArrow(_later, "_k long, s long"))
    release(rows.sparkSession)
    stretches = later.union(pairs.filter("later").select("_k", "s")).repartition("_k").sortWithinPartitions("_k", "s").mapInArrow(_stretches, "_k long, s int, len int")
    out = materialise(sieved.filter("not open").select("_k", "s", "len").union(stretches))
    release(rows.sparkSession)
    return out


def remove_repeats(docs: DataFrame, with_text: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_bytes, n_removed, n_spans, kept_sha256 (and kept_text, if asked for).

    A byte is removed if it lies in a string of LENGTH bytes that also starts earlier: in a row
    with a smaller id, or earlier in the same text; strings are judged on the input. Null and empty
    texts have no bytes. Rows with equal ids are ordered by text, null ids come first, and identical
    rows count as following one another. kept_text leaves out characters that a cut has split. Texts
    of any length are read whole; an empty table gives no rows; other columns are ignored.
    """
    rows, ids = row_keyed(docs, id_col, text_col)
    found = repeated_stretches(rows).groupBy("_k").agg(F.collect_list(F.struct("s", "len")).alias("found"))
    schema = "_k long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + ", kept_text string" * with_text
    out = rows.join(found, "_k", "left").select("_k", "_text", "found").mapInArrow(_finish(with_text), schema)
    return unkeyed(out, ids).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", *["kept_text"] * with_text)
