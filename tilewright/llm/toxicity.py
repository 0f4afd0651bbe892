"""Toxicity grades by cumulative-link ordinal regression on sparse text features.

The features of a text are its distinct words (A-Z lower-cased, runs of letters, digits and
non-ASCII bytes), hashed to 2**18 weights. All grades share the weights w; K grades have K - 1
ordered thresholds t, and P(grade > k) = sigmoid(w.x - t[k]). The thresholds are kept ordered by
fitting the logarithms of their gaps. The output is the expected severity, sum over k of
P(grade > k), and the grade that most thresholds support.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from .common import PUNCT, doc_groups, utf8, word_hashes

BITS = 18


def features(data: np.ndarray, off: np.ndarray) -> Iterator[np.ndarray]:
    """Each document's distinct hashed words."""
    for i, j in doc_groups(off):
        w, at = word_hashes(data[off[i] : off[j]], off[i : j + 1] - off[i], PUNCT)
        f = (w >> np.uint64(64 - BITS)).astype(np.int64)
        for d in range(j - i):
            yield np.unique(f[at[d] : at[d + 1]])


def _sigmoid(x):
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def fit(rows: list[np.ndarray], grades: np.ndarray, levels: int, rounds: int = 300, rate: float = 0.5, sparsity: float = 1e-3, least: float = 5.0) -> tuple[np.ndarray, np.ndarray]:
    """Weights and ascending thresholds by proximal gradient steps over the ordinal likelihood.

    Each grade weighs the same, whatever its share of the rows. Only words whose share of the
    rows differs between grades by over ``least`` standard errors get a weight, and ``sparsity``
    is an L1 penalty; both keep chance words out.
    """
    n = len(rows)
    row, idx = np.repeat(np.arange(n), [len(r) for r in rows]), np.concatenate([*rows, np.zeros(0, np.int64)]).astype(np.int64)
    keep = np.zeros(1 << BITS, bool)
    df = np.bincount(idx, minlength=1 << BITS)
    for k in range(levels - 1):
        above = grades > k
        a, b = max(above.sum(), 1), max((~above).sum(), 1)
        x = np.bincount(idx[above[row]], minlength=1 << BITS)
        share = (df + 1) / (n + 2)
        keep |= np.abs(x / a - (df - x) / b) > least * np.sqrt(share * (1 - share) * (1 / a + 1 / b))
    keep = (keep & (df >= 3))[idx]
    row, idx = row[keep], idx[keep]
    used, at = np.unique(idx, return_inverse=True)
    w, g2 = np.zeros(len(used)), np.full(len(used), 1e-12)
    weight = (1 / np.bincount(grades, minlength=levels).clip(1) / levels)[grades]
    share = [float(weight[grades > k].sum().clip(1e-3, 1 - 1e-3)) for k in range(levels - 1)]
    t0, gaps = -np.log(share[0] / (1 - share[0])), np.zeros(levels - 2)
    th2 = np.full(levels - 1, 1e-12)
    for _ in range(rounds):
        t = t0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
        p = _sigmoid(np.bincount(row, w[at], n)[:, None] - t)
        edge, slope = np.pad(p, ((0, 0), (1, 1))), np.pad(p * (1 - p), ((0, 0), (1, 1)))
        edge[:, 0] = 1
        i = np.arange(n)
        pull = weight / np.maximum(edge[i, grades] - edge[i, grades + 1], 1e-9)
        g = -np.bincount(at, (pull * (slope[i, grades] - slope[i, grades + 1]))[row], len(used))
        g2 += g * g
        size = rate / np.sqrt(g2)
        w -= size * g
        w = np.sign(w) * np.maximum(np.abs(w) - size * sparsity, 0)
        dt = np.bincount(grades, pull * slope[i, grades], levels)[1:] - np.bincount(grades, pull * slope[i, grades + 1], levels)[:-1]
        grad = np.concatenate([[dt.sum()], np.cumsum(dt[::-1])[::-1][1:] * np.exp(gaps)])
        th2 += grad * grad
        move = 0.2 * grad / np.sqrt(th2)
        t0, gaps = t0 - move[0], gaps - move[1:]
    full = np.zeros(1 << BITS)
    full[used] = w
    return full, t0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])


class Model:
    def __init__(self, weights: np.ndarray, thresholds: np.ndarray, values: list[int]):
        self.weights, self.thresholds, self.values = weights.astype(np.float32), thresholds, values

    def expected(self, data: np.ndarray, off: np.ndarray) -> np.ndarray:
        out = np.zeros(len(off) - 1)
        for i, x in enumerate(features(data, off)):
            if len(x):
                out[i] = _sigmoid(self.weights[x].sum(dtype=np.float64) - self.thresholds).sum()
        return out


def train(docs: DataFrame, labels: DataFrame, label: str = "toxic", bound: int = 10000) -> Model:
    """Fit on at most about ``bound`` labelled texts, evenly drawn by a hash of the id from all labelled rows.

    Rows with a null text, id or label are not learned from. Without two grades the model says 0.
    """
    marked = labels.filter(f"doc_id is not null and {label} is not null").select(F.col("doc_id").cast("long").alias("_d"), F.col(label).cast("int").alias("_y"))
    counts = sorted((r["_y"], r["count"]) for r in marked.groupBy("_y").count().collect())
    values = [v for v, _ in counts]
    if len(values) < 2:
        return Model(np.zeros(1 << BITS), np.full(1, 30.0), [*values, 0, 1][:2])
    each = bound // len(values)
    keep = F.lit(False)
    for v, n in counts:
        keep = keep | ((F.col("_y") == v) & (F.pmod(F.xxhash64("_d"), F.lit(1_000_003)) < int(min(1.0, each / n) * 1_000_003)))
    drawn = marked.filter(keep)
    got = docs.select(F.col("doc_id").cast("long").alias("_d"), F.col("text").alias("_text")).filter("_text is not null").join(F.broadcast(drawn), "_d")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([x.astype(np.int32).tobytes() for x in features(*utf8(b.column(2)))], pa.binary())], ["_d", "_y", "x"])

    found = sorted((r["_d"], r["_y"], bytes(r["x"])) for r in got.select("_d", "_y", "_text").mapInArrow(extract, "_d long, _y int, x binary").collect())
    rows = [np.frombuffer(x, np.int32) for _, _, x in found]
    grades = np.array([values.index(y) for _, y, _ in found])
    if len(set(grades.tolist())) < 2:
        return Model(np.zeros(1 << BITS), np.full(1, 30.0), values)
    w, t = fit(rows, grades, len(values))
    return Model(w, t, values)


def score(docs: DataFrame, model: Model, carry: tuple[str, ...] = ()) -> DataFrame:
    """Per row: doc_id, severity (expected, 0 to K - 1), grade (a learned label value), toxic (severity in the upper half).

    A null or empty text, or one without words, has severity 0. Repeated rows and null ids are
    scored one by one; an empty table gives no rows; other columns are ignored, but for those of
    ``carry``, which follow the row's own results.
    """
    shared = docs.sparkSession.sparkContext.broadcast((model.weights, model.thresholds, model.values))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = Model(*shared.value)
        for b in batches:
            s = m.expected(*utf8(b.column(1)))
            grade = np.array(m.values)[np.rint(s).astype(int)]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s), pa.array(grade, pa.int64()), pa.array(s > (len(m.values) - 1) / 2), *b.columns[2:]], ["doc_id", "severity", "grade", "toxic", *carry])

    schema = StructType.fromDDL("doc_id long, severity double, grade long, toxic boolean")
    for c in carry:
        schema = schema.add(c, docs.schema[c].dataType)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", *carry).mapInArrow(run, schema)
