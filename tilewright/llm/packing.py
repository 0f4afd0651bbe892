"""Cost-balanced packing of token ids into fixed sequences.

A document of n tokens fills n // capacity sequences of its own; its remainder is packed with
others. Remainders are taken in descending order, and each goes to the sequence with the lowest
estimated attention cost, linear plus quadratic in the lengths of its pieces, among those with
capacity left. As many sequences are open as the group's tokens need at least; what doesn't fit is
cut off and taken again in order. So a group pads fewer tokens than one sequence holds.

Groups are runs of documents within one partition, of bounded size, so nothing is shuffled, a lost
task is simply run again, and no key decides where a row is packed.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .tokens import encoder

#: Remainders packed together at most.
GROUP = 4096
#: Tokens held at once at most, but for a single document's.
HELD = 4_000_000


def assign(lengths: list[int], capacity: int, linear: float = 1.0, quadratic: float = 1.0 / 1024) -> list[tuple[int, int, int, int, int]]:
    """Pieces (item, start, length, sequence, offset) of items shorter than or as long as capacity.

    Ties go to the earlier item and the lower sequence; no items give no pieces.
    """
    total = sum(lengths)
    if not total:
        return []
    count = -(-total // capacity)
    room, cost = [capacity] * count, [(0.0, s) for s in range(count)]
    todo = [(-n, i, 0) for i, n in enumerate(lengths) if n]
    heapq.heapify(todo)
    out = []
    while todo:
        n, i, start = heapq.heappop(todo)
        n = -n
        c, s = heapq.heappop(cost)
        put = min(n, room[s])
        out.append((i, start, put, s, capacity - room[s]))
        room[s] -= put
        if room[s]:
            heapq.heappush(cost, (c + linear * put + quadratic * put * put, s))
        if put < n:
            heapq.heappush(todo, (put - n, i, start + put))
    return out


SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _pack(path: str, end_id: int, capacity: int, with_ids: bool):
    names = [x.split()[0] for x in SCHEMA.split(", ")] + ["ids"] * with_ids
    types = [pa.int64()] * 7 + [pa.binary()] * with_ids

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(path), np.array([end_id], "<u4").tobytes()
        base = TaskContext.get().partitionId() << 40
        used, held, tokens = 0, [], 0

        def flush():
            nonlocal used
            rows = []

            def put(doc, ids, n, start, length, seq, offset):
                part = ids[4 * start : 4 * (start + length)]
                rows.append((doc, start, length, zlib.crc32(part), n, base + seq, offset, *([part] * with_ids)))

            rest = []
            for doc, ids in held:
                n = len(ids) // 4
                for start in range(0, n - n % capacity, capacity):
                    put(doc, ids, n, start, capacity, used, 0)
                    used += 1
                rest.append(n % capacity)
            pieces = assign(rest, capacity)
            for i, start, length, seq, offset in pieces:
                doc, ids = held[i]
                n = len(ids) // 4
                put(doc, ids, n, n - rest[i] + start, length, used + seq, offset)
            used += 1 + max((p[3] for p in pieces), default=-1)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows) if rows else [[]] * len(types), types, strict=True)], names)

        for b in batches:
            texts = b.column(1)
            for i, doc in enumerate(b.column(0).to_pylist()):
                ids = next(coder.packed([texts[i].as_py()])) + end
                held.append((doc, ids))
                tokens += len(ids) // 4
                if len(held) >= GROUP or tokens >= HELD:
                    yield flush()
                    tokens = 0
        yield flush()

    return run


def pack(docs: DataFrame, vocabulary_path: str, end_id: int = 0, capacity: int = 1024, with_ids: bool = False, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per piece: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset (and ids, if asked for).

    A document's ids are its whole text's, then ``end_id``; each id lies in exactly one piece, and
    a sequence's pieces have gapless offsets from 0. A null or empty text is the end id alone.
    Repeated rows and null ids are packed one by one. An empty table gives no rows. Only the order
    of rows within partitions decides ties.
    """
    types = SCHEMA + ", ids binary" * with_ids
    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(_pack(vocabulary_path, end_id, capacity, with_ids), types)
