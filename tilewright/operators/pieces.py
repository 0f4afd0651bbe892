"""Arrow batches in pieces of bounded bytes, so that Python holds few rows' payloads at a time."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of texts and binaries in a piece.
PIECE = 1 << 21


def pieces(batches: Iterator[pa.RecordBatch], limit: int = PIECE) -> Iterator[pa.RecordBatch]:
    """All rows in order, each piece of at most ``limit`` bytes of text and binary, or of one longer row."""
    for b in batches:
        size = np.ones(b.num_rows, np.int64)
        for c in b.columns:
            if pa.types.is_string(c.type) or pa.types.is_binary(c.type) or pa.types.is_large_string(c.type) or pa.types.is_large_binary(c.type):
                size += pc.fill_null(pc.binary_length(c), 0).to_numpy(zero_copy_only=False)
        end, at = np.cumsum(size), 0
        while at < b.num_rows:
            before = end[at - 1] if at else 0
            stop = max(at + 1, int(np.searchsorted(end, before + limit, "right")))
            yield b.slice(at, stop - at)
            at = stop
