"""Language identification by a bidirectional gated recurrent network over bytes.

Texts are cut into segments of SEGMENT bytes. In each, one gated recurrent layer runs forwards and
one backwards; their states label every byte with a probability per language, and a document's
probabilities are the mean over all its bytes. The network is trained in numpy by backpropagation
through time, on a bounded sample of the labelled rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import doc_groups, utf8

SEGMENT, HIDDEN = 64, 6
#: Segments run side by side.
WIDE = 8192


def _squash(x: np.ndarray) -> np.ndarray:
    """x / (1 + |x|), in place of tanh: as smooth a gate at a third of its cost."""
    d = np.abs(x)
    d += 1
    return np.divide(x, d, out=d)


def _slope(s: np.ndarray) -> np.ndarray:
    """The derivative of _squash where it is s."""
    return (1 - np.abs(s)) ** 2


def _start(languages: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    p = {}
    for d in "fb":
        p["e" + d] = rng.normal(0, 0.5, (3 * HIDDEN, 256))
        p["u" + d] = rng.normal(0, 0.3, (3 * HIDDEN, HIDDEN))
        p["o" + d] = rng.normal(0, 0.3, (languages, HIDDEN))
    p["b"] = np.zeros((languages, 1))
    return {k: v.astype(np.float32) for k, v in p.items()}


def _run(p: dict[str, np.ndarray], d: str, x: np.ndarray, keep: list | None = None) -> Iterator[np.ndarray]:
    """The states after each of x's bytes (steps x segments), in the order given."""
    h = np.zeros((HIDDEN, x.shape[1]), np.float32)
    e, u = p["e" + d], p["u" + d]
    for byte in x:
        a, g = np.take(e, byte, axis=1, mode="clip"), u @ h
        zr = _squash(np.add(a[: 2 * HIDDEN], g[: 2 * HIDDEN], out=a[: 2 * HIDDEN]))
        zr *= 0.5
        zr += 0.5
        z, r = zr[:HIDDEN], zr[HIDDEN:]
        n = _squash(a[2 * HIDDEN :] + r * g[2 * HIDDEN :])
        if keep is not None:
            keep.append((h, z, r, n, g[2 * HIDDEN :]))
        h = n + z * (h - n)
        yield h


def _softmax(x: np.ndarray) -> np.ndarray:
    x = np.exp(x - x.max(0))
    return x / x.sum(0)


def probabilities(p: dict[str, np.ndarray], x: np.ndarray, weight: np.ndarray) -> np.ndarray:
    """Per segment, the sum over its bytes of weight times the byte's probabilities (languages x segments)."""
    back = [p["ob"] @ h for h in _run(p, "b", x[::-1])][::-1]
    total = np.zeros_like(back[0])
    for t, h in enumerate(_run(p, "f", x)):
        total += _softmax(p["of"] @ h + back[t] + p["b"]) * weight[t]
    return total


def _gradients(p: dict[str, np.ndarray], x: np.ndarray, y: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross-entropy of every byte's label."""
    g = {k: np.zeros_like(v) for k, v in p.items()}
    kept, states = {"f": [], "b": []}, {}
    states["f"] = list(_run(p, "f", x, kept["f"]))
    states["b"] = list(_run(p, "b", x[::-1], kept["b"]))
    steps, n = x.shape
    target = np.zeros((len(p["b"]), n), np.float32)
    target[y, np.arange(n)] = 1
    dlogit = []
    for t in range(steps):
        d = (_softmax(p["of"] @ states["f"][t] + p["ob"] @ states["b"][steps - 1 - t] + p["b"]) - target) / (n * steps)
        g["b"] += d.sum(1, keepdims=True)
        dlogit.append(d)
    for d in "fb":
        dh, u = np.zeros((HIDDEN, n), np.float32), p["u" + d]
        for t in range(steps - 1, -1, -1):
            out = dlogit[t] if d == "f" else dlogit[steps - 1 - t]
            byte = x[t] if d == "f" else x[steps - 1 - t]
            g["o" + d] += out @ states[d][t].T
            h, z, r, c, un = kept[d][t]
            dh = dh + p["o" + d].T @ out
            da_n = dh * (1 - z) * _slope(c)
            da = np.concatenate([dh * (h - c) * 0.5 * _slope(2 * z - 1), da_n * un * 0.5 * _slope(2 * r - 1), da_n])
            dg = np.concatenate([da[: 2 * HIDDEN], da_n * r])
            g["u" + d] += dg @ h.T
            for i in range(3 * HIDDEN):
                g["e" + d][i] += np.bincount(byte, da[i], 256)
            dh = dh * z + u.T @ dg
    return g


def fit(x: np.ndarray, y: np.ndarray, languages: int, rounds: int = 160, batch: int = 256, rate: float = 0.02, seed: int = 3) -> dict[str, np.ndarray]:
    """Adam steps over random batches of segments x (segments x SEGMENT bytes) with labels y."""
    rng = np.random.default_rng(seed)
    p = _start(languages, rng)
    m = {k: np.zeros_like(v) for k, v in p.items()}
    v = {k: np.zeros_like(a) for k, a in p.items()}
    for i in range(1, rounds + 1):
        pick = rng.integers(0, len(x), batch)
        for k, d in _gradients(p, np.ascontiguousarray(x[pick].T), y[pick]).items():
            m[k] = 0.9 * m[k] + 0.1 * d
            v[k] = 0.99 * v[k] + 0.01 * d * d
            p[k] = p[k] - (rate * min(1, 2 - 2 * i / (rounds + 1)) * (m[k] / (1 - 0.9**i)) / (np.sqrt(v[k] / (1 - 0.99**i)) + 1e-8)).astype(np.float32)
    return p


def segments(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes by step and segment, weights likewise, each segment's document): every byte has weight 1 once."""
    n = np.diff(off)
    count = -(-n // SEGMENT)
    doc = np.repeat(np.arange(len(n)), count)
    at = (np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)) * SEGMENT
    start = np.maximum(np.minimum(at, n[doc] - SEGMENT), 0)  # a long text's last segment reaches back
    pos = start + np.arange(SEGMENT)[:, None]
    inside = pos < n[doc]
    x = np.where(inside, data[np.minimum(pos + off[doc], len(data) - 1)], 32) if len(doc) else np.zeros((SEGMENT, 0), np.uint8)
    return x, (inside & (pos >= at)).astype(np.float32), doc


def pooled(p: dict[str, np.ndarray], data: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Mean probabilities per document (documents x languages); zeros for an empty one."""
    out = np.zeros((len(off) - 1, len(p["b"])))
    for i, j in doc_groups(off):
        x, w, doc = segments(data[off[i] : off[j]], off[i : j + 1] - off[i])
        for s in range(0, len(doc), WIDE):
            np.add.at(out, doc[s : s + WIDE] + i, probabilities(p, np.ascontiguousarray(x[:, s : s + WIDE]), np.ascontiguousarray(w[:, s : s + WIDE])).T)
    return out / np.maximum(np.diff(off), 1)[:, None]


def train(docs: DataFrame, bound: int = 500, per_text: int = 6) -> tuple[list[str], dict[str, np.ndarray]]:
    """(languages, parameters) from docs (doc_id, text, lang): per language about ``bound`` texts, evenly
    drawn by a hash of the id, and of each at most ``per_text`` segments, evenly spaced over the whole text."""
    known = docs.filter("text is not null and lang is not null and length(text) > 0")
    counts = sorted((r["lang"], r["count"]) for r in known.groupBy("lang").count().collect())
    names = [k for k, _ in counts]
    if len(names) < 2:
        return names, _start(max(1, len(names)), np.random.default_rng(0))
    draw = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1_000_003))
    keep = F.lit(False)
    for lang, n in counts:
        keep = keep | ((F.col("lang") == lang) & (draw < int(min(1.0, bound / n) * 1_000_003)))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            data, off = utf8(b.column(1))
            found = []
            for i in range(b.num_rows):
                x, w, _ = segments(data[off[i] : off[i + 1]], np.array([0, off[i + 1] - off[i]]))
                pick = np.unique(np.linspace(0, x.shape[1] - 1, min(per_text, x.shape[1])).astype(int))
                found.append(x[:, pick].T.astype(np.uint8).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(found, pa.binary())], ["lang", "x"])

    rows = sorted((r["lang"], bytes(r["x"])) for r in known.filter(keep).select("lang", "text").mapInArrow(cut, "lang string, x binary").collect())
    x = np.frombuffer(b"".join(r[1] for r in rows), np.uint8).reshape(-1, SEGMENT)
    y = np.concatenate([np.full(len(r[1]) // SEGMENT, names.index(r[0])) for r in rows])
    # every language is seen equally often
    share = [np.flatnonzero(y == k) for k in range(len(names))]
    most = max(map(len, share))
    pick = np.concatenate([np.resize(s, most) for s in share if len(s)])
    return names, fit(x[pick], y[pick], len(names))


def identify(docs: DataFrame, model: tuple[list[str], dict[str, np.ndarray]]) -> DataFrame:
    """Per row: doc_id, lang_pred, score (its pooled probability).

    ``und`` with score 0 where the text is null, has no letter, or nothing was learned. Whole texts
    are read, however long. Repeated rows and null ids are labelled one by one; an empty table
    gives no rows; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names, p = shared.value
        for b in batches:
            prob = pooled(p, *utf8(b.column(1)))
            best = prob.argmax(1) if prob.shape[0] else np.zeros(0, int)
            lang, score = [], []
            for i, text in enumerate(b.column(1)):
                letter = names and (t := text.as_py()) is not None and next(filter(str.isalpha, t), None)
                lang.append(names[best[i]] if letter else "und")
                score.append(min(1.0, float(prob[i, best[i]])) if letter else 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(lang, pa.string()), pa.array(score, pa.float64())], ["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, lang_pred string, score double")
