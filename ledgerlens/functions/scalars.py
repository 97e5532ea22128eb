"""Column expressions with the source semantics for nulls, bins and ratios."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F


def col(c: str | Column) -> Column:
    return F.col(c) if isinstance(c, str) else c


def clean(c: str | Column) -> Column:
    """NaN and infinities become null."""
    x = col(c).cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def flag(condition: Column) -> Column:
    """1 or 0; an unknown comparison is 0."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def safe_ratio(a: str | Column, b: str | Column, fill: float | None = 0.0) -> Column:
    ratio = col(a) / F.nullif(col(b).cast("double"), F.lit(0.0))
    return ratio if fill is None else F.coalesce(ratio, F.lit(fill))


def clip(c: str | Column, low: float | Column | None = None, high: float | Column | None = None) -> Column:
    """Clip and keep nulls; a null bound does not clip."""
    x = out = col(c)
    if low is not None:
        out = F.greatest(out, low if isinstance(low, Column) else F.lit(low))
    if high is not None:
        out = F.least(out, high if isinstance(high, Column) else F.lit(high))
    return F.when(x.isNotNull(), out)


def log1p_from_zero(c: str | Column) -> Column:
    return F.log1p(F.greatest(F.coalesce(col(c).cast("double"), F.lit(0.0)), F.lit(0.0)))


def cut(c: str | Column, edges: Sequence[float], labels: Sequence, right: bool = True) -> Column:
    """Fixed-edge bins; outside all bins is null."""
    x = col(c)
    out = None
    for low, high, label in zip(edges[:-1], edges[1:], labels):
        inside = (x > low) & (x <= high) if right else (x >= low) & (x < high)
        out = F.when(inside, F.lit(label)) if out is None else out.when(inside, F.lit(label))
    return out


def equal_width_bin(c: str | Column, low: Column, high: Column, bins: int) -> Column:
    """0-based right-closed bin of ``bins`` equal parts of [low, high]; low falls in bin 0."""
    x = col(c).cast("double")
    part = (x - low) / F.nullif((high - low).cast("double"), F.lit(0.0)) * bins
    return F.greatest(F.least(F.ceil(F.coalesce(part, F.lit(0.0))) - 1, F.lit(bins - 1)), F.lit(0)).cast("int")


def bin_by_edges(c: str | Column, edges: Sequence[Column]) -> Column:
    """0-based right-closed bin for ascending quantile edges.

    Repeated edges count once, the lowest edge belongs to bin 0, and values
    outside the edges stay in the first or last bin.
    """
    x = col(c).cast("double")
    fresh = [F.lit(True)] + [hi != lo for lo, hi in zip(edges[:-1], edges[1:])]
    below = reduce(lambda a, b: a + b, [(f & (e < x)).cast("int") for f, e in zip(fresh, edges)])
    distinct = reduce(lambda a, b: a + b, [f.cast("int") for f in fresh])
    index = F.greatest(F.least(below - 1, distinct - 2), F.lit(0))
    return F.when(x.isNotNull(), index).cast("int")


def cyclical(c: str | Column, period: int) -> tuple[Column, Column]:
    angle = F.lit(2 * math.pi) * col(c) / period
    return F.sin(angle), F.cos(angle)


def map_values(c: str | Column, mapping: Mapping, default) -> Column:
    """Dictionary lookup with a default for unknown and null."""
    pairs = [F.lit(x) for kv in mapping.items() for x in kv]
    return F.coalesce(F.element_at(F.create_map(*pairs), col(c)), F.lit(default))


def row_sum(columns: Sequence[str | Column]) -> Column:
    """Row-wise sum with nulls as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(col(c).cast("double"), F.lit(0.0)) for c in columns])


def row_count(columns: Sequence[str | Column]) -> Column:
    return reduce(lambda a, b: a + b, [col(c).isNotNull().cast("int") for c in columns])


def row_mean(columns: Sequence[str | Column]) -> Column:
    return row_sum(columns) / F.nullif(row_count(columns), F.lit(0))


def row_std(columns: Sequence[str | Column]) -> Column:
    """Row-wise sample deviation of the non-null cells; null below two cells."""
    mean = row_mean(columns)
    squares = reduce(
        lambda a, b: a + b,
        [F.coalesce((col(c) - mean) * (col(c) - mean), F.lit(0.0)) for c in columns],
    )
    n = row_count(columns)
    return F.when(n > 1, F.sqrt(squares / (n - 1)))


def row_max(columns: Sequence[str | Column]) -> Column:
    return F.greatest(*[col(c) for c in columns])


def floor_two(c: str | Column) -> Column:
    """Floor to two decimals."""
    return (F.floor(col(c) * 100) / 100).cast("double")


def number_or_null(c: str | Column, dtype: str = "double") -> Column:
    return col(c).try_cast(dtype)


def sample_skew(c: str | Column) -> Column:
    """Bias-corrected skewness as an aggregate."""
    x = col(c)
    n = F.count(x).cast("double")
    return F.when(n > 2, F.skewness(x) * F.sqrt(n * (n - 1)) / (n - 2))


def _placed(order: Sequence[str] | Column) -> Column:
    return order if isinstance(order, Column) else F.struct(*[F.col(o) for o in order])


def last_known(value: str | Column, order: Sequence[str] | Column) -> Column:
    """Aggregate: the newest non-null value, by columns or by one number that orders like them."""
    v = col(value)
    return F.max_by(v, F.when(v.isNotNull(), _placed(order)))


def first_known(value: str | Column, order: Sequence[str] | Column) -> Column:
    """Aggregate: the oldest non-null value."""
    v = col(value)
    return F.min_by(v, F.when(v.isNotNull(), _placed(order)))
