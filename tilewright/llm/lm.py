"""Language-model scores from an Elias-Fano n-gram trie of order three, built and queried in shards.

The model interpolates trigrams, bigrams and add-one unigrams over hashed words, each with a
Dirichlet prior on the order below: p(w | c) = (n(c w) + K p(w | shorter c)) / (n(c) + K). Trigrams
are kept under contexts seen at least CUTOFF times. A trie has a level of contexts, a level of
monotone pointers to where each context's successors begin, and the successors, made monotone by
adding their context's place; all three are coded by Elias-Fano (low bits packed, high bits in
unary with a rank directory). A successor is searched between its context's two pointers. Shares
n(c w) / (n(c) + K) and back-off weights K / (n(c) + K) are quantised to a byte each. A trie's
levels lie in one memory map; with ``model_path`` they are also written there.

The corpus is cut into blocks of tokens, longer texts over several, and written once. Three rounds
follow, for words, bigrams and trigrams: each block sends each shard its distinct n-grams with
their training counts; the shard adds them up, builds its trie, looks every n-gram up and answers
in the same order. Contexts are dealt to shards by their hash; one that was counted more than
PIECE times in the round before is dealt in as many pieces as its count holds that, by a hash of
the successor, so no context's successors all meet in one task. Neither the counts nor the model
ever have to fit one machine, and what is shuffled grows with the corpus. Within a shard, whose
contexts are bounded in number, a context is a hash of 40 bits, and within a context, of at most
about PIECE counts, a successor is one of 32; words as such are told apart by 64 bits.
"""

from __future__ import annotations

import mmap
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PIECE as TEXT
from .common import SPACE, materialise, mix, release, row_keyed, unkeyed, utf8, word_hashes

#: Bytes of text, or tokens, after which a block is closed; and tokens that a shard stands for.
BLOCK, BLOCK_TOKENS, SHARD = 8 << 20, 1 << 21, 1 << 20
#: The prior's weight in counts, per order, and the least count of a trigram's context.
PRIOR, CUTOFF = {2: 4.0, 3: 4.0}, 2
#: A round deals with this part of the shards at a time: only its messages lie on disk together.
WAVES = 2
#: Counts of a context in one piece.
PIECE = 1 << 16
_START, _END = np.uint64(0x7B1F3C5D9E8A6420), np.uint64(0x1D2C3B4A59687786)
_W = np.uint64(32)
_LOW = np.uint64((1 << 32) - 1)
#: Decades that a quantised probability spans.
_DECADES = 9.0


def quantise(p: np.ndarray) -> np.ndarray:
    """Probabilities to bytes, evenly in their logarithm; 0 stays 0."""
    with np.errstate(divide="ignore"):
        code = np.rint(254 + np.log10(p) * (253 / _DECADES))
    return np.where(p > 0, np.clip(code, 1, 254), 0).astype(np.uint8) + (p > 0).astype(np.uint8)


_VALUES = np.concatenate([[0.0], 10 ** ((np.arange(255) - 254) * (_DECADES / 253))])
_VALUES[1] = _VALUES[2]


def _select(words: np.ndarray, sums: np.ndarray, i: np.ndarray) -> np.ndarray:
    """The place of the i-th set bit; sums are the set bits before each word."""
    word = np.searchsorted(sums, i, "right") - 1
    left, bits, at = i - sums[word], words[word], np.zeros(len(i), np.int64)
    for step in (32, 16, 8, 4, 2, 1):
        under = np.bitwise_count(bits & (((np.uint64(1) << np.uint64(step)) - np.uint64(1)) << at.astype(np.uint64))).astype(np.int64)
        go = left >= under
        left = np.where(go, left - under, left)
        at = np.where(go, at + step, at)
    return word * 64 + at


class EliasFano:
    """A sorted array of 64-bit integers; get() reads entries, find() gives places by successor search."""

    def __init__(self, n: int, bits: int, low: np.ndarray, high: np.ndarray):
        self.n, self.bits, self.low, self.high = n, bits, low, high
        ones = np.bitwise_count(high).astype(np.int64)
        self.ones = np.concatenate([[0], np.cumsum(ones)])
        self.zeros = np.concatenate([[0], np.cumsum(64 - ones)])

    @classmethod
    def of(cls, values: np.ndarray, universe: int) -> "EliasFano":
        n = len(values)
        bits = max(0, min(56, (universe // max(n, 1)).bit_length() - 1))
        low = np.zeros(-(-n * bits // 64) + 2, np.uint64)
        if bits and n:
            part = values & np.uint64((1 << bits) - 1)
            at = np.arange(n) * bits
            word, shift = at >> 6, (at & 63).astype(np.uint64)
            first = np.flatnonzero(np.diff(word, prepend=-1))
            low[word[first]] = np.bitwise_or.reduceat(part << shift, first)
            over = np.flatnonzero(shift + np.uint64(bits) > np.uint64(64))
            low[word[over] + 1] |= part[over] >> (np.uint64(64) - shift[over])
        unary = np.zeros(-(-((int(universe) >> bits) + n + 2) // 64) * 64, np.uint8)
        unary[(values >> np.uint64(bits)).astype(np.int64) + np.arange(n)] = 1
        return cls(n, bits, low.view(np.uint8), np.packbits(unary, bitorder="little").view("<u8"))

    def _lows(self, i: np.ndarray) -> np.ndarray:
        bit = i * self.bits
        words = np.ndarray((len(self.low) - 7,), "<u8", self.low, 0, (1,))
        return (words[bit >> 3] >> (bit & 7).astype(np.uint64)) & np.uint64((1 << self.bits) - 1)

    def get(self, i: np.ndarray) -> np.ndarray:
        """The i-th entries."""
        high = _select(self.high, self.ones, i) - i
        return high.astype(np.uint64) << np.uint64(self.bits) | self._lows(i)

    def _before(self, h: np.ndarray) -> np.ndarray:
        """How many entries have a high part under h."""
        at = _select(~self.high, self.zeros, np.maximum(h - 1, 0))
        return np.where(h > 0, at - (h - 1), 0)

    def find(self, x: np.ndarray, since: np.ndarray | None = None, until: np.ndarray | None = None) -> np.ndarray:
        """The place of each x (between ``since`` and ``until``), -1 where it is none of the entries."""
        if not self.n or not len(x):
            return np.full(len(x), -1, np.int64)
        h = (x >> np.uint64(self.bits)).astype(np.int64)
        want = x & np.uint64((1 << self.bits) - 1)
        at, end = self._before(h), self._before(h + 1)
        if since is not None:
            at, end = np.maximum(at, since), np.minimum(end, until)
        out = np.full(len(x), -1, np.int64)
        todo = np.flatnonzero(at < end)
        while len(todo):
            got = self._lows(at[todo])
            same = got == want[todo]
            out[todo[same]] = at[todo[same]]
            todo = todo[~same & (got < want[todo])]
            at[todo] += 1
            todo = todo[at[todo] < end[todo]]
        return out


class Trie:
    """Contexts, pointers, successors, shares and back-off weights, as views of one buffer.

    Header: ``TWNG``, then per Elias-Fano level its entries and low bits, then per part its place
    and length; the parts follow, each at a multiple of eight bytes.
    """

    _HEAD = struct.Struct("<4s4x6Q16Q")

    def __init__(self, buffer):
        head = self._HEAD.unpack_from(buffer)
        if head[0] != b"TWNG":
            raise ValueError("not a trie")
        whole = np.frombuffer(buffer, np.uint8)
        parts = [whole[head[7 + 2 * i] : head[7 + 2 * i] + head[8 + 2 * i]] for i in range(8)]
        self.contexts, self.pointers, self.successors = (EliasFano(head[1 + 2 * i], head[2 + 2 * i], parts[2 * i], parts[2 * i + 1].view("<u8")) for i in range(3))
        self.shares, self.backs = parts[6], parts[7]

    @classmethod
    def build(cls, contexts: np.ndarray, totals: np.ndarray, keys: np.ndarray, counts: np.ndarray, prior: float) -> "Trie":
        """Sorted distinct contexts with their counts, sorted distinct keys (context's place << 32 | successor) with theirs."""
        of = (keys >> _W).astype(np.int64)
        starts = np.searchsorted(of, np.arange(len(contexts) + 1)).astype(np.uint64)
        levels = EliasFano.of(contexts, 1 << 40), EliasFano.of(starts, len(keys) + 1), EliasFano.of(keys, max(1, len(contexts)) << 32)
        parts = [x for f in levels for x in (f.low, f.high.view(np.uint8))]
        parts += [quantise(counts / (totals[of] + prior)), quantise(prior / (totals + prior))]
        at, places = cls._HEAD.size, []
        for p in parts:
            at += -at % 8
            places += [at, p.nbytes]
            at += p.nbytes
        buffer = mmap.mmap(-1, at)  # anonymous: no file on the executor's own disk
        cls._HEAD.pack_into(buffer, 0, b"TWNG", *(x for f in levels for x in (f.n, f.bits)), *places)
        for p, a in zip(parts, places[::2], strict=True):
            buffer[a : a + p.nbytes] = p.tobytes()
        trie = cls(buffer)
        trie.buffer = buffer
        return trie

    def look(self, contexts: np.ndarray, of: np.ndarray, successors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(back-off byte of each context, share byte of each successor of contexts[of]); unseen ones back off whole, with share 0."""
        c = self.contexts.find(contexts)
        known = np.maximum(c, 0)
        back = np.where(c >= 0, self.backs[known] if len(self.backs) else 0, 255).astype(np.uint8)
        if not self.successors.n:
            return back, np.zeros(len(of), np.uint8)
        since, until = (self.pointers.get(known + i).astype(np.int64) for i in (0, 1))
        until = np.where(c >= 0, until, since)
        at = self.successors.find(known[of].astype(np.uint64) << _W | successors, since[of], until[of])
        return back, np.where(at >= 0, self.shares[np.maximum(at, 0)], 0).astype(np.uint8)


def _pack(x: np.ndarray, kind: str) -> bytes:
    return zlib.compress(np.ascontiguousarray(x.astype(kind)).tobytes(), 1)


def _unpack(x: bytes, kind: str) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), kind)


def _pack_tokens(x: np.ndarray) -> bytes:
    """Small numbers, byte by byte: of all the least byte first."""
    planes = np.ascontiguousarray(x.astype("<u4").view(np.uint8).reshape(-1, 4).T)
    return zlib.compress(planes.tobytes(), 1)


def _unpack_tokens(x: bytes) -> np.ndarray:
    planes = np.frombuffer(zlib.decompress(x), np.uint8).reshape(4, -1)
    return np.ascontiguousarray(planes.T).view("<u4")[:, 0]


def _five(x: np.ndarray) -> bytes:
    """The low 40 bits of each, at five bytes."""
    return np.ascontiguousarray(x.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :5]).tobytes()


def _unfive(x: bytes) -> np.ndarray:
    out = np.zeros((len(x) // 5, 8), np.uint8)
    out[:, :5] = np.frombuffer(x, np.uint8).reshape(-1, 5)
    return out.view("<u8")[:, 0]


def _tokens(text: np.ndarray) -> Iterator[np.ndarray]:
    """A text's word hashes and the end, at most a block's tokens at a time."""
    held: list[np.ndarray] = []
    n, a = 0, 0
    while a < len(text):
        b = min(a + TEXT, len(text))
        while b < len(text):  # on to behind the next white space
            gap = np.flatnonzero(SPACE[text[b : b + 4096]])
            b = b + int(gap[0]) + 1 if len(gap) else min(b + 4096, len(text))
            if len(gap):
                break
        w = word_hashes(text[a:b], np.array([0, b - a]))[0]
        held.append(w)
        n, a = n + len(w), b
        if n >= BLOCK_TOKENS:
            yield np.concatenate(held)
            held, n = [], 0
    yield np.concatenate([*held, np.array([_END])])


_BLOCK = "block long, keys binary, train binary, ends binary, lead binary, cont binary, words binary, tokens binary, n_tokens long"


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(_k, _text, train) -> blocks. A text that goes on from the block before begins with that one's last token, which isn't counted again."""
    number = TaskContext.get().partitionId() << 24
    rows: list[tuple] = []
    size = count = 0

    def flush():
        nonlocal number, size, count
        ends = np.cumsum([len(r[2]) for r in rows])
        lead = np.array([r[3] for r in rows], np.uint64)
        words, place, often = np.unique(np.concatenate([*(r[2] for r in rows), lead, [_START]]), return_inverse=True, return_counts=True)
        by = np.argsort(-often, kind="stable")  # common words get small numbers, which compress
        words, number_of = words[by], np.empty(len(by), np.int64)
        number_of[by] = np.arange(len(by))
        place = number_of[place]
        cells = [np.array([r[0] for r in rows], "<i8"), np.array([r[1] for r in rows], np.uint8), ends.astype("<i8"), place[ends[-1] : -1].astype("<u4"), np.array([r[4] for r in rows], np.uint8), words.astype("<u8")]
        out = pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), *(pa.array([c.tobytes()], pa.binary()) for c in cells), pa.array([_pack_tokens(place[: ends[-1]])], pa.binary()), pa.array([int(ends[-1])], pa.int64())], [x.split()[0] for x in _BLOCK.split(", ")])
        number, size, count = number + 1, 0, 0
        rows.clear()
        return out

    for b in batches:
        data, off = utf8(b.column(1))
        for i, (key, train) in enumerate(zip(b.column(0).to_pylist(), b.column(2).to_pylist(), strict=True)):
            last: list[np.uint64] = [_START, _START]
            begun = False
            for w in _tokens(data[off[i] : off[i + 1]]):
                own = np.concatenate([last[1:], w]).astype(np.uint64) if begun else w
                rows.append((key, train, own, last[0] if begun else _START, begun))
                count += len(own)
                if count >= BLOCK_TOKENS:
                    yield flush()
                last, begun = [*last, *w[-2:]][-2:], True
            size += int(off[i + 1] - off[i])
            if size >= BLOCK and rows:
                yield flush()
    if rows:
        yield flush()


class Block:
    """A block's tokens and what the rounds so far have answered."""

    def __init__(self, row: dict):
        get = lambda n, k: np.frombuffer(row[n], k)
        self.number = row["block"]
        self.keys, self.ends, words = get("keys", "<i8"), get("ends", "<i8"), get("words", "<u8")
        by = np.argsort(words)
        self.words, place = words[by], np.empty(len(by), np.int64)
        place[by] = np.arange(len(by))
        self.token = place[_unpack_tokens(row["tokens"])]
        first = np.concatenate([[0], self.ends[:-1]]).astype(np.int64)
        self.doc = np.repeat(np.arange(len(self.keys)), np.diff(np.append(first, self.ends[-1])))
        self.real = np.ones(len(self.token), bool)
        self.real[first[get("cont", np.uint8).astype(bool)]] = False
        self.learn = self.real & get("train", np.uint8).astype(bool)[self.doc]
        self.before = np.empty(len(self.token), np.int64)
        self.before[1:] = self.token[:-1]
        self.before[first] = place[get("lead", "<u4")]
        self.first = np.zeros(len(self.token), bool)
        self.first[first] = True
        self.start = int(np.searchsorted(self.words, _START))

    def word_counts(self) -> np.ndarray:
        c = np.bincount(self.token[self.learn], minlength=len(self.words))
        c[self.start] = np.count_nonzero(self.learn & self.first)
        return c

    def grams(self, context: np.ndarray, hashes: np.ndarray, totals: np.ndarray, where: np.ndarray) -> "Grams":
        """Distinct (context, token) at the positions ``where``, in the order in which shards see them."""
        pair, at = np.unique(context[where].astype(np.uint64) << np.uint64(32) | self.token[where].astype(np.uint64), return_inverse=True)
        g = Grams()
        c, w = (pair >> np.uint64(32)).astype(np.int64), self.words[(pair & np.uint64(0xFFFFFFFF)).astype(np.int64)]
        counts = np.bincount(at[self.learn[where]], minlength=len(pair))
        pieces = (totals[c] // PIECE + 1).astype(np.uint64)
        with np.errstate(over="ignore"):
            key = mix(hashes[c] + ((w >> np.uint64(5)) % pieces) * np.uint64(0x9E3779B97F4A7C15))
        g.order = np.argsort(key, kind="stable")
        key = key[g.order]
        g.edge = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        g.key, g.successor, g.counts, g.totals = key[g.edge], w[g.order] >> _W, counts[g.order], totals[c[g.order][g.edge]]
        g.kinds = np.diff(np.append(g.edge, len(key)))
        g.at, g.where, g.n = at, where, len(pair)
        return g

    def bigrams(self, counts: np.ndarray) -> "Grams":
        with np.errstate(over="ignore"):
            return self.grams(self.before, mix(self.words * np.uint64(0xD6E8FEB86659FD93)), counts, np.arange(len(self.token)))

    def trigrams(self, two: "Grams", pair_counts: np.ndarray) -> "Grams":
        """Under the bigram that ends one position earlier, where that was counted often enough; pair_counts by its place."""
        context = np.concatenate([[0], two.at[:-1]])
        where = np.flatnonzero(~self.first & (pair_counts[context] >= CUTOFF))
        some = np.empty(two.n, np.int64)
        some[two.at] = np.arange(len(two.at))  # a position of each bigram
        with np.errstate(over="ignore"):
            hashes = mix(self.words[self.before[some]] * np.uint64(0xC2B2AE3D27D4EB4F) + mix(self.words[self.token[some]]))
        return self.grams(context, hashes, pair_counts, where)


class Grams:
    def messages(self, block: int, shards: int, some: range) -> pa.Table:
        edge = np.array([-(-(s << 64) // shards) for s in range(shards)], np.uint64)
        a = np.append(np.searchsorted(self.key, edge), len(self.key))
        b = np.append(self.edge, len(self.successor))[a]
        rows = [(s, block, _five(self.key[a[s] : a[s + 1]]), _pack(self.kinds[a[s] : a[s + 1]], "<u4"), _pack(self.totals[a[s] : a[s + 1]], "<i8"), self.successor[b[s] : b[s + 1]].astype("<u4").tobytes(), _pack(self.counts[b[s] : b[s + 1]], "<u4")) for s in some if a[s + 1] > a[s]]
        return _table(rows, _MESSAGE)

    def pair_counts(self, answers: list[dict]) -> np.ndarray:
        """The count of each distinct pair."""
        counts = np.zeros(self.n, np.int64)
        counts[self.order] = _counts(answers)
        return counts

    def shares(self, answers: list[dict]) -> tuple[np.ndarray, np.ndarray]:
        """Back-off weight and share at each position of ``where``."""
        back, share = (np.frombuffer(b"".join(x[n] for x in answers), np.uint8) for n in ("first", "second"))
        one = np.empty(self.n)
        one[self.order] = np.repeat(_VALUES[back], self.kinds)
        two = np.empty(self.n)
        two[self.order] = _VALUES[share]
        return one[self.at], two[self.at]


_MESSAGE = "shard long, block long, contexts binary, kinds binary, totals binary, successors binary, counts binary"
_ANSWER = "block long, round int, shard long, first binary, second binary, third binary, n long, v long, trie binary"
_TYPES = {"long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "double": pa.float64()}


def _table(rows: list[tuple], schema: str) -> pa.Table:
    names, kinds = zip(*(x.split() for x in schema.split(", ")), strict=True)
    cols = zip(*rows, strict=True) if rows else [[]] * len(names)
    return pa.table([pa.array(c, _TYPES[k]) for c, k in zip(cols, kinds, strict=True)], names=list(names))


def _word_messages(shards: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        edge = np.array([-(-(s << 64) // shards) for s in range(shards)], np.uint64)
        for batch in batches:
            for row in batch.to_pylist():
                b = Block(row)
                counts, a = b.word_counts(), np.append(np.searchsorted(b.words, edge), len(b.words))
                rows = [(s, b.number, b.words[a[s] : a[s + 1]].tobytes(), None, None, None, _pack(counts[a[s] : a[s + 1]], "<u4")) for s in range(shards) if a[s + 1] > a[s]]
                yield from _table(rows, _MESSAGE).to_batches()

    return run


def _word_shard(key, table):
    """Adds up the words of one shard; answers with their counts."""
    rows = table.sort_by([("block", "ascending")]).to_pylist()
    words = [np.frombuffer(r["contexts"], "<u8") for r in rows]
    every, place = np.unique(np.concatenate(words), return_inverse=True)
    counts = np.bincount(place, np.concatenate([_unpack(r["counts"], "<u4") for r in rows]), len(every)).astype(np.int64)
    real = every != _START
    n, v, at, out = int(counts[real].sum()), int((counts[real] > 0).sum()), 0, []
    for i, (r, w) in enumerate(zip(rows, words, strict=True)):
        out.append((r["block"], 1, key[0].as_py(), None, None, _pack(counts[place[at : at + len(w)]], "<i8"), n if not i else 0, v if not i else 0, None))
        at += len(w)
    return _table(out, _ANSWER)


def _gram_shard(order: int, keep: bool):
    def run(key, table):
        """Adds up the n-grams of one shard, builds its trie and answers from it."""
        rows = table.sort_by([("block", "ascending")]).to_pylist()
        contexts = np.concatenate([_unfive(r["contexts"]) for r in rows])
        kinds = np.concatenate([_unpack(r["kinds"], "<u4") for r in rows])
        every, place = np.unique(contexts, return_inverse=True)
        totals = np.zeros(len(every), np.int64)
        totals[place] = np.concatenate([_unpack(r["totals"], "<i8") for r in rows])
        successors = np.concatenate([np.frombuffer(r["successors"], "<u4") for r in rows])
        of = np.repeat(np.arange(len(contexts)), kinds)
        keys, at = np.unique(place[of].astype(np.uint64) << _W | successors, return_inverse=True)
        counts = np.bincount(at, np.concatenate([_unpack(r["counts"], "<u4") for r in rows]), len(keys)).astype(np.int64)
        seen, known = counts > 0, totals > 0
        number = np.cumsum(known) - 1
        held = keys[seen]
        held = number[(held >> _W).astype(np.int64)].astype(np.uint64) << _W | held & _LOW
        trie = Trie.build(every[known], totals[known], held, counts[seen], PRIOR[order])
        back, share = trie.look(every, (keys >> _W).astype(np.int64), keys & _LOW)
        out, c, g = [], 0, 0
        for i, r in enumerate(rows):
            d = c + len(r["contexts"]) // 5
            h = g + len(r["successors"]) // 4
            out.append((r["block"], order, key[0].as_py(), back[place[c:d]].tobytes(), share[at[g:h]].tobytes(), _pack(counts[at[g:h]], "<i8") if order == 2 else None, 0, 0, bytes(trie.buffer) if keep and not i else None))
            c, g = d, h
        return _table(out, _ANSWER)

    return run


def _sorted(answers: pa.Table) -> dict[int, list[dict]]:
    out: dict[int, list[dict]] = {1: [], 2: [], 3: []}
    for r in answers.select(["round", "shard", "first", "second", "third"]).sort_by([("shard", "ascending")]).to_pylist():
        out[r["round"]].append(r)
    return out


def _counts(answers: list[dict]) -> np.ndarray:
    return np.concatenate([_unpack(x["third"], "<i8") for x in answers])


def _gram_messages(order: int, shards: int, some: range):
    def run(blocks, answers):
        if not blocks.num_rows:
            return _table([], _MESSAGE)
        b, got = Block(blocks.to_pylist()[0]), _sorted(answers)
        grams = b.bigrams(_counts(got[1]))
        if order == 3:
            grams = b.trigrams(grams, grams.pair_counts(got[2]))
        return grams.messages(b.number, shards, some)

    return run


def _scores(n: int, v: int):
    schema = "_k long, n_tokens long, n_known long, base_score double, score double"

    def run(blocks, answers):
        if not blocks.num_rows:
            return _table([], schema)
        b, got = Block(blocks.to_pylist()[0]), _sorted(answers)
        counts = _counts(got[1])
        low = (counts[b.token] + 1) / (n + v + 1)
        two = b.bigrams(counts)
        back, share = two.shares(got[2])
        p = share + back * low
        three = b.trigrams(two, two.pair_counts(got[2]))
        back, share = three.shares(got[3])
        p[three.where] = share + back * p[three.where]
        size, real = len(b.keys), b.real
        cols = [np.bincount(b.doc[real], minlength=size), np.bincount(b.doc[real & (counts[b.token] > 0)], minlength=size)]
        cols += [np.bincount(b.doc[real], np.log10(x[real]), size) for x in (low, np.minimum(p, 1.0))]
        return pa.table([pa.array(b.keys), *map(pa.array, cols)], names=[x.split()[0] for x in schema.split(", ")])

    return run, schema


def scores(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", model_path: str | None = None) -> DataFrame:
    """Per row: doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score.

    Words are ``[^\\x20\\x09-\\x0D]+`` after lower-casing A-Z, then one end token; a null or empty text is
    the end alone. Rows whose crc32(id as text) mod 7 is 2 are held out, all others (null ids too)
    are learned from. base_score is the add-one unigram log10 probability, score the trie's. Rows
    with equal or null ids are scored one by one; an empty table gives no rows; words and texts of
    any length are read whole; other columns are ignored. With ``model_path`` the tries are written
    there as rows (order, shard, trie) of Parquet.
    """
    spark = docs.sparkSession
    rows, ids = row_keyed(docs, id_col, text_col)
    rows = rows.withColumn("_id", F.col("_k")) if ids is None else rows.join(ids, "_k")
    held = F.coalesce(F.crc32(F.col("_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    blocks = materialise(rows.select("_k", "_text", (~held).alias("train")).mapInArrow(_blocks, _BLOCK))
    shards = max(1, -(-(blocks.agg(F.sum("n_tokens")).first()[0] or 0) // SHARD))

    def asked(order: int, answers: DataFrame, some: range) -> DataFrame:
        counts = answers.select("block", "round", "shard", F.lit(None).cast("binary").alias("first"), F.lit(None).cast("binary").alias("second"), "third")
        return blocks.groupBy("block").cogroup(counts.groupBy("block")).applyInArrow(_gram_messages(order, shards, some), _MESSAGE)

    answers = materialise(blocks.mapInArrow(_word_messages(shards), _MESSAGE).groupBy("shard").applyInArrow(_word_shard, _ANSWER))
    n, v = (x or 0 for x in answers.agg(F.sum("n"), F.sum("v")).first())
    for order in (2, 3):
        base = answers
        for wave in range(WAVES):
            some = range(shards * wave // WAVES, shards * (wave + 1) // WAVES)
            if some:
                answers = answers.union(materialise(asked(order, base, some).groupBy("shard").applyInArrow(_gram_shard(order, model_path is not None), _ANSWER)))
                release(spark)
    if model_path:
        answers.filter("trie is not null").select(F.col("round").alias("order"), "shard", "trie").write.parquet(model_path)
    run, schema = _scores(n, v)
    parts = blocks.groupBy("block").cogroup(answers.drop("trie").groupBy("block")).applyInArrow(run, schema)
    out = parts.groupBy("_k").agg(*(F.sum(x.split()[0]).alias(x.split()[0]) for x in schema.split(", ")[1:])).withColumn("train_tokens", F.lit(n).cast("long"))
    out = unkeyed(out, ids)
    again = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    return out.select("doc_id", again.alias("held_out"), "n_tokens", "n_known", "train_tokens", "base_score", "score")
