"""Encoders, imputers and scalers as fit/apply pairs.

``fit_*`` returns a statistics frame computed on the training rows only;
``apply_*`` joins it to any rows. Joins on fitted keys carry no broadcast hint:
Spark broadcasts them while they are below its size limit and shuffles beyond.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators.ordering import average_ranks, dense_index, only_row, quantile_table


def lookup(df: DataFrame, stats: DataFrame, keys: Sequence[str], values: Mapping[str, Column | float | int | None]) -> DataFrame:
    """Left join of fitted values with a default per value (``{column: default}``)."""
    joined = df.join(stats.select(*keys, *values), list(keys), "left")
    filled = [
        F.col(v) if d is None else F.coalesce(F.col(v), d if isinstance(d, Column) else F.lit(d)).alias(v)
        for v, d in values.items()
    ]
    return joined.select(*[c for c in df.columns], *filled)


# --- target, frequency and ordinal encoding ---------------------------------

def fit_target_rate(train: DataFrame, keys: Sequence[str], target: str, smoothing: float = 0.0) -> DataFrame:
    """Target mean per key, pulled towards the global mean by ``smoothing`` rows.

    Columns: keys, rate, n, global_rate. Null keys have no entry.
    """
    known = train
    for k in keys:
        known = known.where(F.col(k).isNotNull())
    overall = train.agg(F.avg(F.col(target).cast("double")).alias("m")).scalar()
    groups = known.groupBy(*keys).agg(
        F.sum(F.col(target).cast("double")).alias("_hits"), F.count(target).alias("n")
    )
    rate = (F.col("_hits") + smoothing * F.col("global_rate")) / F.nullif(F.col("n") + F.lit(float(smoothing)), F.lit(0.0))
    return groups.withColumn("global_rate", overall).select(*keys, rate.alias("rate"), "n", "global_rate")


def apply_target_rate(df: DataFrame, stats: DataFrame, keys: Sequence[str], name: str, count: str | None = None) -> DataFrame:
    """Rate per key, the training mean for unseen and null keys; optionally the training count (0 if unseen)."""
    default = stats.agg(F.max("global_rate")).scalar()
    named = stats.select(*keys, F.col("rate").alias(name), *([F.col("n").alias(count)] if count else []))
    values: dict[str, Column | int] = {name: default}
    if count:
        values[count] = 0
    return lookup(df, named, keys, values)


def composite_key(columns: Sequence[str], missing: str = "NA") -> Column:
    return F.concat_ws("_", *[F.coalesce(F.col(c).cast("string"), F.lit(missing)) for c in columns])


def fit_frequency(train: DataFrame, column: str) -> DataFrame:
    """Share of each level among the non-null training rows."""
    counts = train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("n"))
    total = counts.agg(F.sum("n")).scalar()
    return counts.select(column, "n", (F.col("n") / total).alias("share"))


def apply_frequency(df: DataFrame, stats: DataFrame, column: str, name: str) -> DataFrame:
    return lookup(df, stats.select(column, F.col("share").alias(name)), [column], {name: 0.0})


def rare_flag(df: DataFrame, stats: DataFrame, column: str, name: str, fewer_than: int = 10) -> DataFrame:
    """1 for levels with fewer training rows than ``fewer_than``; unseen levels count as rare, nulls do not."""
    joined = lookup(df, stats.select(column, F.col("n").alias("_n")), [column], {"_n": 0})
    rare = S.flag(F.col(column).isNotNull() & (F.col("_n") < fewer_than))
    return joined.withColumn(name, rare).drop("_n")


def fit_ordinal(train: DataFrame, column: str) -> DataFrame:
    """Levels numbered from 0 in sorted order."""
    return dense_index(train, column, "code")


def apply_ordinal(df: DataFrame, stats: DataFrame, column: str, name: str, unknown: int = -1) -> DataFrame:
    return lookup(df, stats.select(column, F.col("code").alias(name)), [column], {name: F.lit(unknown).cast("long")})


def fit_top_values(train: DataFrame, column: str, k: int = 8) -> list[str]:
    """The k most frequent levels, ties by value. At most k values reach the driver."""
    rows = (
        train.where(F.col(column).isNotNull())
        .groupBy(column)
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy(F.desc("n"), F.asc(column))
        .limit(k)
        .collect()
    )
    return [r[0] for r in rows]


# --- imputation -------------------------------------------------------------

def fit_medians(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    return quantile_table(train, {c: (c, 0.5) for c in columns})


def fit_modes(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Most frequent value per column, the smallest on ties; one row."""
    picks = []
    for c in columns:
        counts = train.where(F.col(c).isNotNull()).groupBy(c).agg(F.count(F.lit(1)).alias("n"))
        picks.append(counts.agg(F.min_by(F.col(c), F.struct(-F.col("n"), F.col(c)))).scalar().alias(c))
    return train.sparkSession.range(1).select(*picks)


def fill_from(df: DataFrame, stats: DataFrame, columns: Sequence[str], treat_inf: bool = False) -> DataFrame:
    """Fill nulls (and, if asked, infinities) with the fitted value of the same name."""
    fitted = only_row(stats)
    return df.withColumns(
        {c: F.coalesce(S.clean(c) if treat_inf else F.col(c), fitted.getField(c)) for c in columns}
    )


# --- clipping, scaling, bins ------------------------------------------------

def fit_clip(train: DataFrame, columns: Sequence[str], low: float | None, high: float | None) -> DataFrame:
    wanted = {}
    for c in columns:
        if low is not None:
            wanted[f"{c}__low"] = (c, low)
        if high is not None:
            wanted[f"{c}__high"] = (c, high)
    return quantile_table(train, wanted)


def apply_clip(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    fitted = only_row(stats)
    bound = lambda n: fitted.getField(n) if n in fitted else None
    return df.withColumns({c: S.clip(c, bound(f"{c}__low"), bound(f"{c}__high")) for c in columns})


def fit_scale(train: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Mean and population deviation per column; one row."""
    return train.agg(
        *[F.avg(c).alias(f"{c}__mean") for c in columns],
        *[F.stddev_pop(c).alias(f"{c}__std") for c in columns],
    )


def apply_scale(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Standard scores; a constant column is only centred."""
    fitted = only_row(stats)
    return df.withColumns(
        {
            c: (F.col(c) - fitted.getField(f"{c}__mean"))
            / F.coalesce(F.nullif(fitted.getField(f"{c}__std"), F.lit(0.0)), F.lit(1.0))
            for c in columns
        }
    )


def fit_quantile_edges(train: DataFrame, column: str, bins: int) -> DataFrame:
    """The bins+1 quantile edges of a column: one row, columns edge_0 .. edge_bins."""
    return quantile_table(train, {f"edge_{i}": (column, i / bins) for i in range(bins + 1)})


def apply_quantile_bins(df: DataFrame, stats: DataFrame, column: str, name: str) -> DataFrame:
    """0-based quantile bin, see ``bin_by_edges``."""
    fitted = only_row(stats)
    edges = [fitted.getField(f"edge_{i}") for i in range(len(stats.columns))]
    return df.withColumn(name, S.bin_by_edges(column, edges))


def cohort_rank(df: DataFrame, columns: Sequence[str], by: Sequence[str], suffix: str = "__rank", null_rank: float | None = 0.5) -> DataFrame:
    """Average-rank percentiles within a cohort."""
    names = {c: f"{c}{suffix}" for c in columns}
    out = average_ranks(df, names, by)
    if null_rank is not None:
        out = out.withColumns({n: F.coalesce(F.col(n), F.lit(null_rank)) for n in names.values()})
    return out
