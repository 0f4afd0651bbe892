"""The reversible 5/3 wavelet of a row as Catalyst expressions over integer arrays; exact both ways."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _each(n: Column, f) -> Column:
    """f(0) to f(n - 1); none for n = 0."""
    return F.when(n > 0, F.transform(F.sequence(F.lit(0), n - 1), f)).otherwise(F.array().cast("array<int>"))


def held(rows: DataFrame, *columns: str) -> DataFrame:
    """The same rows, with these columns computed once: the optimizer doesn't copy expressions through a generator."""
    others = [c for c in rows.columns if c not in columns]
    return rows.select(*others, F.explode(F.array(F.struct(*columns))).alias("_held")).select(*others, *[F.col("_held")[c].alias(c) for c in columns])


def _high(s: Column, n: Column, i: Column) -> Column:
    """High sample i of a row: an odd sample less the mean of its neighbours; the far edge is mirrored."""
    after = F.when(i * 2 + 2 < n, i * 2 + 2).otherwise(i * 2)
    return F.get(s, i * 2 + 1) - F.shiftright(F.get(s, i * 2) + F.get(s, after), 1)


def _even(low: Column, high: Column, i: Column) -> Column:
    """Even sample i from both bands; edges are mirrored."""
    last = F.size(high) - 1
    a, b = F.get(high, F.greatest(i - 1, F.lit(0))), F.get(high, F.least(i, last))
    return F.get(low, i) - F.when(last < 0, 0).otherwise(F.shiftright(a + b + 2, 2))


def forward(rows: DataFrame, samples: str) -> DataFrame:
    """Adds arrays ``low`` and ``high`` of a row of samples that starts at an even place."""
    rows = held(rows, samples)
    s, n = F.col(samples), F.size(samples)
    odd = F.shiftright(n, 1)

    def low(i: Column) -> Column:
        both = _high(s, n, F.greatest(i - 1, F.lit(0))) + _high(s, n, F.least(i, odd - 1))
        return F.get(s, i * 2) + F.when(odd == 0, 0).otherwise(F.shiftright(both + 2, 2))

    bands = rows.withColumns({"low": _each(F.shiftright(n + 1, 1), low), "high": _each(odd, lambda i: _high(s, n, i))})
    return held(bands, "low", "high")


def inverse(rows: DataFrame, low: str = "low", high: str = "high", to: str = "samples") -> DataFrame:
    """Adds the row of samples that ``forward`` has split."""
    rows = held(rows, low, high)
    a, b = F.col(low), F.col(high)

    def sample(k: Column) -> Column:
        i = F.shiftright(k, 1)
        odd = F.get(b, i) + F.shiftright(_even(a, b, i) + _even(a, b, F.least(i + 1, F.size(a) - 1)), 1)
        return F.when(k % 2 == 0, _even(a, b, i)).otherwise(odd)

    return rows.withColumn(to, _each(F.size(a) + F.size(b), sample))
