"""Token ids in directly addressable codes.

Every id is cut into 8-bit chunks, least first. Level l holds the l-th chunks of all ids that have
one, in order, and a bitmap that says which of them continue at the next level; a rank directory
with the ones before each 512 bits gives an id's place there. So any id is read with one lookup
per chunk, and any document with one stretch per level; no block is decoded for it.

File format: rows of Parquet in the shared folder, neither compressed nor dictionary-coded, each
with one segment as ``payload``: header ``TWDA``, version, levels, documents, ids; then the
document directory (row key, first id in the segment), and per level its length, chunks, bitmap
and directory, all little-endian. A segment holds no part of a document that begins in another.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import release, row_keyed, shared_dir, unkeyed
from .tokens import encoder

_HEAD = struct.Struct("<4sHHQQ")
_RANK = 512
#: A segment is closed when it has so many ids or documents; a longer document has its own.
SEGMENT_IDS, SEGMENT_DOCS = 1 << 20, 1 << 14


def encode(ids: np.ndarray, keys: np.ndarray, starts: np.ndarray) -> bytes:
    """One segment; starts are the first ids of the documents within it."""
    levels, left = [], ids.astype("<u4")
    while len(left):
        more = left > 255
        bits = np.packbits(more, bitorder="little")
        padded = np.zeros(-(-len(more) // _RANK) * (_RANK // 8), np.uint8)
        padded[: len(bits)] = bits
        ones = np.bitwise_count(padded).reshape(-1, _RANK // 8).sum(1, dtype=np.int64)
        ranks = np.concatenate([[0], np.cumsum(ones)[:-1]]).astype("<u4")
        levels.append(struct.pack("<Q", len(left)) + left.astype(np.uint8).tobytes() + padded.tobytes() + ranks.tobytes())
        left = left[more] >> np.uint32(8)
    return b"".join([_HEAD.pack(b"TWDA", 1, len(levels), len(keys), len(ids)), keys.astype("<i8").tobytes(), starts.astype("<u8").tobytes(), *levels])


class Segment:
    """Reads a segment; the arrays are views of its bytes, which may be memory-mapped."""

    def __init__(self, payload: bytes | memoryview):
        magic, version, levels, docs, self.n = _HEAD.unpack_from(payload)
        if magic != b"TWDA" or version != 1:
            raise ValueError("not a token segment")
        at = _HEAD.size
        self.keys = np.frombuffer(payload, "<i8", docs, at)
        self.starts = np.frombuffer(payload, "<u8", docs, at + 8 * docs)
        at += 16 * docs
        self.levels = []
        for _ in range(levels):
            (n,) = struct.unpack_from("<Q", payload, at)
            blocks = -(-n // _RANK)
            chunks = np.frombuffer(payload, np.uint8, n, at + 8)
            bits = np.frombuffer(payload, np.uint8, blocks * (_RANK // 8), at + 8 + n)
            ranks = np.frombuffer(payload, "<u4", blocks, at + 8 + n + len(bits))
            at += 8 + n + len(bits) + 4 * blocks
            self.levels.append((chunks, bits, ranks))

    def _rank(self, level: int, i: int) -> int:
        """How many of the level's first i ids go on at the next one."""
        chunks, bits, ranks = self.levels[level]
        block = min(i, len(chunks) - 1) // _RANK
        whole = int(np.bitwise_count(bits[block * (_RANK // 8) : i >> 3]).sum())
        return int(ranks[block]) + whole + (int(bits[i >> 3] & ((1 << (i & 7)) - 1)).bit_count() if i & 7 else 0)

    def id(self, i: int) -> int:
        """The i-th id, by one lookup per level."""
        value = 0
        for level, (chunks, bits, _) in enumerate(self.levels):
            value |= int(chunks[i]) << (8 * level)
            if not bits[i >> 3] >> (i & 7) & 1:
                break
            i = self._rank(level, i)
        return value

    def stretch(self, a: int, b: int) -> np.ndarray:
        """Ids a to b - 1, read from their own stretch of each level."""
        out, at = np.zeros(b - a, "<u4"), np.arange(b - a)
        for level, (chunks, bits, _) in enumerate(self.levels):
            if a == b:
                break
            out[at] |= chunks[a:b].astype("<u4") << np.uint32(8 * level)
            more = np.unpackbits(bits[a >> 3 : (b + 7) >> 3], bitorder="little")[a & 7 : (a & 7) + b - a].astype(bool)
            at = at[more]
            a = self._rank(level, a)
            b = a + len(at)
        return out

    def all(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.n, "<u4")
        at = np.arange(self.n)
        for level, (chunks, bits, _) in enumerate(self.levels):
            out[at] |= chunks.astype("<u4") << np.uint32(8 * level)
            at = at[np.unpackbits(bits, count=len(chunks), bitorder="little").astype(bool)]
        return out


def _write(path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, end = encoder(path), np.array([end_id], "<u4").tobytes()
        part, first, keys, ids, n = TaskContext.get().partitionId(), 0, [], [], 0

        def flush():
            nonlocal first, n
            lengths = np.array([len(x) // 4 for x in ids], np.int64)
            payload = encode(np.frombuffer(b"".join(ids), "<u4"), np.array(keys, np.int64), np.cumsum(lengths) - lengths)
            out = pa.RecordBatch.from_arrays([pa.array([part], pa.int64()), pa.array([first], pa.int64()), pa.array([n], pa.int64()), pa.array([payload], pa.binary())], ["part", "first", "n", "payload"])
            first, n = first + n, 0
            keys.clear()
            ids.clear()
            return out

        for b in batches:
            texts = b.column(1)
            for i, key in enumerate(b.column(0).to_pylist()):
                keys.append(key)
                ids.append(next(coder.packed([texts[i].as_py()])) + end)
                n += len(ids[-1]) // 4
                if n >= SEGMENT_IDS or len(keys) >= SEGMENT_DOCS:
                    yield flush()
        if keys:
            yield flush()

    return run


def write_tokens(docs: DataFrame, vocabulary_path: str, end_id: int, path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame | None:
    """Write all documents' ids in ascending id order (nulls first, ties by text) to ``path``; returns row_keyed()'s map."""
    rows, ids = row_keyed(docs, id_col, text_col)
    ordered = rows.repartitionByRange("_k").sortWithinPartitions("_k")
    ordered.mapInArrow(_write(vocabulary_path, end_id), "part long, first long, n long, payload binary").write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)
    return ids


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for first, offset, payload in zip(*(b.column(i) for i in range(3)), strict=True):
            s = Segment(payload.as_buffer())
            at = s.starts.astype(np.int64)
            to = np.append(at[1:], s.n)
            crc = [zlib.crc32(s.stretch(x, y)) for x, y in zip(at.tolist(), to.tolist(), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(s.keys.copy()), pa.array(at + first.as_py() + offset.as_py()), pa.array(to - at), pa.array(crc, pa.int64())], ["_k", "start", "n_tokens", "ids_crc32"])


def read_digests(segments: DataFrame, ids: DataFrame | None) -> DataFrame:
    """Per document of the files: doc_id, start, n_tokens, ids_crc32. One count per writing task goes to the driver."""
    spark = segments.sparkSession
    parts = sorted(tuple(r) for r in segments.groupBy("part").agg(F.sum("n")).collect())
    before, rows = 0, []
    for part, n in parts:
        rows.append((part, before))
        before += n
    offsets = spark.createDataFrame(rows, "part long, offset long")
    out = segments.join(F.broadcast(offsets), "part").select("first", "offset", "payload").mapInArrow(_digests, "_k long, start long, n_tokens long, ids_crc32 long")
    return unkeyed(out, ids).select("doc_id", "start", "n_tokens", "ids_crc32")


def token_files(docs: DataFrame, vocabulary_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Write the ids of all documents to files, read these back, and return each document's place and checksum.

    A null or empty text is the end id alone. Rows with equal ids are ordered by text, null ids
    come first; an empty table gives no rows; other columns are ignored.
    """
    spark = docs.sparkSession
    path = shared_dir(spark)
    ids = write_tokens(docs, vocabulary_path, end_id, path, id_col, text_col)
    release(spark)
    return read_digests(spark.read.schema("part long, first long, n long, payload binary").parquet(path), ids)
