"""Scalar number functions as Columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def rounded(c: Column | str, digits: int = 4) -> Column:
    """Half toward plus infinity on the binary product; null and NaN give null."""
    x = col(c)
    return F.when(~F.isnan(x), F.floor(x * F.lit(10.0**digits) + 0.5) / F.lit(10.0**digits))


def finite(c: Column | str) -> Column:
    """The value as double, or null where it is no finite number."""
    x = col(c).try_cast("double")
    return F.when(x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")), x)


def pct_change(now: Column | str, then: Column | str, digits: int = 2) -> Column:
    """Change in percent; null on a zero base."""
    a, b = col(now), col(then)
    return F.when(b != 0, rounded((a - b) / b * 100, digits))


def scaled_number(c: Column | str) -> Column:
    """1234567 as 1.2M; null and NaN as a dash."""
    x = col(c)
    parts = [(1e12, "T"), (1e9, "B"), (1e6, "M"), (1e3, "K")]
    out = F.when(x.isNull() | F.isnan(x), F.lit("-"))
    for size, mark in parts:
        out = out.when(F.abs(x) >= size, F.format_string("%.1f" + mark, rounded(x / size, 1)))
    return out.otherwise(F.format_string("%.1f", rounded(x, 1)))


def token_estimate(text: Column | str) -> Column:
    """Tokens of a text at three and a half characters each."""
    return F.ceil(F.length(col(text)) / 3.5)


def decay(age_days: Column | str, half_life: float) -> Column:
    """Exponential weight by age; a negative age counts as none."""
    return F.exp(-F.log(F.lit(2.0)) / half_life * F.greatest(col(age_days).cast("double"), F.lit(0.0)))


def cosine(a: Column | str, b: Column | str) -> Column:
    """Cosine similarity in double; 0 for empty, unequal or zero vectors."""
    x, y = col(a), col(b)
    total = lambda arr: F.aggregate(arr, F.lit(0.0), lambda s, v: s + v)
    dot = total(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")))
    norms = F.sqrt(total(F.transform(x, lambda p: p.cast("double") * p.cast("double")))) * F.sqrt(total(F.transform(y, lambda p: p.cast("double") * p.cast("double"))))
    return F.when((F.size(x) == F.size(y)) & (norms > 0), dot / norms).otherwise(0.0)


def jaccard(a: Column | str, b: Column | str, both_empty: float = 1.0) -> Column:
    """Jaccard similarity of two arrays as sets."""
    x, y = col(a), col(b)
    union = F.size(F.array_union(x, y))
    return F.when(union == 0, F.lit(both_empty)).otherwise(F.size(F.array_intersect(x, y)) / union)
