"""Greedy longest-match token counts by a linear-time automaton.

The vocabulary's pieces form a trie over bytes and an end-of-word symbol. Where a node has no
child for the next symbol, the greedy match pops pieces: the node's failure link leads to the node
of what is left, and how many pieces are popped on the way is precomputed. Closing the links over
all symbols gives one transition and one count per node and symbol, so that each byte of a text
costs one lookup, pieces are never built, and all words of a batch step side by side.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import LOWER, SPACE, doc_groups, utf8
from .tokens import _visible

END = 256


def load_pieces(path: str) -> list[tuple[int, ...]]:
    """A vocabulary file's pieces as symbols: bytes, and END where a piece closes a word."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    suffix, back = model.get("end_of_word_suffix") or "", {c: b for b, c in enumerate(_visible())}
    out = []
    for t in model["vocab"]:
        stem, end = (t[: -len(suffix)], True) if suffix and t.endswith(suffix) else (t, False)
        if stem and all(c in back for c in stem):
            out.append((*(back[c] for c in stem), *([END] * end)))
    return out


class Automaton:
    """next[node, symbol] and pops[node, symbol]; node 0 is the root, the last one means that no pieces fit.

    ``rest`` is the number of pieces popped from a node when the word is over, -1 if none fit.
    """

    def __init__(self, pieces: list[tuple[int, ...]], symbols: int = END + 1):
        children: list[dict[int, int]] = [{}]
        is_piece, depth = [False], [0]
        for piece in pieces:
            at = 0
            for s in piece:
                if s not in children[at]:
                    children[at][s] = len(children)
                    children.append({})
                    is_piece.append(False)
                    depth.append(depth[at] + 1)
                at = children[at][s]
            is_piece[at] = True
        n = len(children)
        dead = n
        parent, symbol = np.zeros(n, np.int64), np.zeros(n, np.int64)
        for v, kids in enumerate(children):
            for s, c in kids.items():
                parent[c], symbol[c] = v, s
        depth_, piece_ = np.array(depth), np.array(is_piece)
        self.next = np.full((n + 1, symbols), dead, np.int32)
        self.pops = np.zeros((n + 1, symbols), np.int8 if max(depth, default=0) < 127 else np.int16)
        fail, popped = np.full(n + 1, dead), np.zeros(n + 1, np.int64)
        kid = np.arange(1, n)
        for d in range(max(depth, default=0) + 1):
            v = np.flatnonzero(depth_ == d)
            if d:
                # a piece pops itself and leaves nothing; another node what its parent's link, moved on, pops
                up, s = parent[v], symbol[v]
                through = fail[up]
                fail[v] = np.where(piece_[v], 0, self.next[through, s])
                popped[v] = np.where(piece_[v], 1, popped[up] + self.pops[through, s])
                self.next[v] = self.next[fail[v]]
                self.pops[v] = np.where(self.next[v] == dead, 0, popped[v][:, None] + self.pops[fail[v]])
            below = kid[np.isin(parent[kid], v)]
            self.next[parent[below], symbol[below]] = below
            self.pops[parent[below], symbol[below]] = 0
        self.rest = np.full(n + 1, -1, np.int64)
        self.rest[0] = 0
        for d in range(1, max(depth, default=0) + 1):
            v = np.flatnonzero(depth_ == d)
            self.rest[v] = np.where(self.rest[fail[v]] < 0, -1, popped[v] + self.rest[fail[v]])
        self.symbols = symbols

    def counts(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Pieces per word data[start:end] followed by END; -1 where none fit."""
        length = ends - starts
        order = np.argsort(-length, kind="stable")
        first, length = starts[order], length[order]
        state, total = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        flat_next, flat_pops = self.next.reshape(-1), self.pops.reshape(-1)
        live = np.searchsorted(-length, -np.arange(1, (length[0] if len(length) else 0) + 1), "right")
        for i, k in enumerate(live):  # the k longest words have an i-th byte
            at = state[:k] * self.symbols + data[first[:k] + i]
            total[:k] += flat_pops[at]
            state[:k] = flat_next[at]
        at = state * self.symbols + END
        total += flat_pops[at]
        state = flat_next[at]
        total = np.where(self.rest[state] < 0, -1, total + self.rest[state])
        out = np.empty(len(order), np.int64)
        out[order] = total
        return out


_automata: dict[str, Automaton] = {}


def automaton(path: str) -> Automaton:
    if path not in _automata:
        _automata[path] = Automaton(load_pieces(path))
    return _automata[path]


def word_bounds(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lower-cased bytes, starts, ends) of the white-space separated words."""
    low = LOWER[data]
    sep = SPACE[low]
    edge = np.zeros(len(low) + 1, bool)
    edge[off] = True
    prev, nxt = np.ones(len(low), bool), np.ones(len(low), bool)
    prev[1:], nxt[:-1] = sep[:-1], sep[1:]
    return low, np.flatnonzero(~sep & (prev | edge[:-1])), np.flatnonzero(~sep & (nxt | edge[1:])) + 1


def token_counts(docs: DataFrame, vocabulary_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: doc_id, n_words, n_tokens, n_unknown.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z. Each is cut greedily, from its start,
    into the longest pieces of the vocabulary, the last of which must close the word where the
    vocabulary marks ends; a word that can't be cut so is one unknown token. A null or empty text
    has no words. Repeated rows and null ids are counted one by one; an empty table gives no rows;
    very long words and texts are read whole; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto = automaton(vocabulary_path)
        for b in batches:
            data, off = utf8(b.column(1))
            words, tokens, unknown = (np.zeros(b.num_rows, np.int64) for _ in range(3))
            for i, j in doc_groups(off):
                low, starts, ends = word_bounds(data[off[i] : off[j]], off[i : j + 1] - off[i])
                if not len(starts):
                    continue
                n = auto.counts(low, starts, ends)
                at = np.searchsorted(starts, off[i : j + 1] - off[i])
                for out, x in ((words, np.ones(len(n), np.int64)), (tokens, np.where(n < 0, 1, n)), (unknown, (n < 0).astype(np.int64))):
                    c = np.concatenate([[0], np.cumsum(x)])
                    out[i:j] = c[at[1:]] - c[at[:-1]]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(words), pa.array(tokens), pa.array(unknown)], ["doc_id", "n_words", "n_tokens", "n_unknown"])

    return docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).mapInArrow(run, "doc_id long, n_words long, n_tokens long, n_unknown long")
