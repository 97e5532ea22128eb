"""Small frames that stand behind charts."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators.ordering import dense_index, only_row, quantile_table, rolling, running


def series_band(df: DataFrame, time: str, value: str, n: int = 25, sigmas: float = 2.0) -> DataFrame:
    """Mean, std, min, max per time with a rolling mean and an upper band over the time means."""
    per = df.groupBy(time).agg(F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"), F.max(value).alias("max"))
    rolled = rolling(
        per.join(dense_index(per, time, "_t"), time), [], "_t",
        {"roll_mean": (F.avg("mean"), -(n - 1), 0), "_sd": (F.stddev_samp("mean"), -(n - 1), 0)},
    )
    sd = F.coalesce(F.col("_sd"), F.lit(0.0))
    return rolled.withColumn("upper", F.col("roll_mean") + sigmas * sd).drop("_t", "_sd")


def ribbon(df: DataFrame, time: str, value: str, n: int = 20, sigmas: float = 1.5) -> DataFrame:
    """Rolling mean plus and minus a multiple of the rolling deviation of a series with one row per time."""
    rolled = rolling(
        df.join(dense_index(df, time, "_t"), time), [], "_t",
        {"_m": (F.avg(value), -(n - 1), 0), "_sd": (F.stddev_samp(value), -(n - 1), 0)},
    )
    half = sigmas * F.coalesce(F.col("_sd"), F.lit(0.0))
    return rolled.withColumns({"lower": F.col("_m") - half, "upper": F.col("_m") + half}).drop("_t", "_m", "_sd")


def most_variable(df: DataFrame, entity: str, value: str, k: int) -> DataFrame:
    """The k entities with the largest deviation; at most k rows."""
    return (
        df.groupBy(entity).agg(F.stddev_samp(value).alias("_sd"))
        .orderBy(F.desc_nulls_last("_sd"), entity).limit(k).select(entity)
    )


def heatmap(df: DataFrame, entity: str, time: str, value: str, buckets: int = 30, entities: int = 30) -> DataFrame:
    """Mean value of the most variable entities (rows) per equal time bucket (columns T1..), 0 where empty."""
    ends = only_row(df.agg(F.min(time).alias("a"), F.max(time).alias("b")))
    low, high = ends.getField("a").cast("double"), ends.getField("b").cast("double")
    picked = df.join(most_variable(df, entity, value, entities), entity, "left_semi")
    binned = picked.withColumn("_b", S.equal_width_bin(F.col(time).cast("double"), low, high, buckets))
    means = [F.coalesce(F.avg(F.when(F.col("_b") == i, F.col(value))), F.lit(0.0)).alias(f"T{i + 1}") for i in range(buckets)]
    return binned.groupBy(entity).agg(*means)


def seasonal_boxes(df: DataFrame, time: str, value: str, periods: int = 6) -> DataFrame:
    """Quartiles, mean and deviation of a value per equal part of the time axis."""
    ends = only_row(df.agg(F.min(time).alias("a"), F.max(time).alias("b")))
    low, high = ends.getField("a").cast("double"), ends.getField("b").cast("double")
    parts = df.withColumn("period", S.equal_width_bin(F.col(time).cast("double"), low, high, periods) + 1)
    return box_summary(parts, "period", value)


def box_summary(df: DataFrame, by: str, value: str, clip_p: float | None = None) -> DataFrame:
    """Box-plot numbers per group, optionally after clipping at an upper quantile."""
    rows = df
    if clip_p is not None:
        rows = df.withColumn(value, S.clip(value, None, only_row(quantile_table(df, {"p": (value, clip_p)})).getField("p")))
    quarts = quantile_table(rows, {"q1": (value, 0.25), "median": (value, 0.5), "q3": (value, 0.75)}, [by])
    basic = rows.groupBy(by).agg(
        F.count(value).alias("n"), F.min(value).alias("min"), F.max(value).alias("max"), F.avg(value).alias("mean"), F.stddev_samp(value).alias("std")
    )
    return basic.join(quarts, by)


def histogram(df: DataFrame, value: str, bins: int = 60, low_p: float = 0.01, high_p: float = 0.99) -> DataFrame:
    """Counts per equal-width bin after clipping to two quantiles."""
    row = only_row(quantile_table(df, {"a": (value, low_p), "b": (value, high_p)}))
    low, high = row.getField("a"), row.getField("b")
    clipped = df.where(F.col(value).isNotNull()).select(S.clip(F.col(value).cast("double"), low, high).alias("_v"))
    return clipped.groupBy(S.equal_width_bin("_v", low, high, bins).alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def indexed(df: DataFrame, entity: str, time: str, value: str, base=None, entities: int = 10) -> DataFrame:
    """Series of the most variable entities as percent of their value at a base time.

    The base is the first time of the whole table unless given; an entity
    without a row there uses its own first value.
    """
    start = base if base is not None else only_row(df.agg(F.min(time).alias("a"))).getField("a")
    picked = df.join(most_variable(df, entity, value, entities), entity, "left_semi")
    bases = picked.groupBy(entity).agg(
        F.coalesce(F.max(F.when(F.col(time) == start, F.col(value))), F.min_by(value, time)).alias("_base")
    )
    joined = picked.join(bases, entity).where(F.col("_base") != 0)
    return joined.select(entity, time, (F.col(value) / F.col("_base") * 100).alias("indexed"))


def order_flow(df: DataFrame, time: str, imbalance: str, spread: str) -> DataFrame:
    """Mean imbalance per time as buy and sell pressure, with the mean spread."""
    per = df.groupBy(time).agg(F.coalesce(F.avg(imbalance), F.lit(0.0)).alias("_i"), F.avg(spread).alias("spread"))
    return per.select(time, F.greatest("_i", F.lit(0.0)).alias("buy"), F.abs(F.least("_i", F.lit(0.0))).alias("sell"), "spread")


def waterfall(factors: DataFrame, order: str, factor: str, value: str, base: float) -> DataFrame:
    """Baseline, the factors as steps, and the total of a small factor list, with running levels."""
    steps = running(factors.select(order, factor, value), [], [order], {"level": ("sum", F.col(value))})
    steps = steps.select(F.col(factor).cast("string").alias("step"), F.col(value).cast("double").alias("delta"), (F.col("level") + base).alias("level"))
    total = factors.agg((F.sum(value) + base).alias("level")).select(F.lit("Total").alias("step"), F.col("level").alias("delta"), "level")
    first = total.select(F.lit("Baseline").alias("step"), F.lit(float(base)).alias("delta"), F.lit(float(base)).alias("level"))
    return first.unionByName(steps).unionByName(total)


def market_kpis(df: DataFrame, stock: str, time: str, rv: str) -> DataFrame:
    stocks = df.select(stock).distinct().agg(F.count(stock)).scalar()
    times = df.select(time).distinct().agg(F.count(time)).scalar()
    return df.agg(F.count(F.lit(1)).alias("n_rows"), F.avg(rv).alias("mean_rv")).select(
        stocks.alias("n_stocks"), times.alias("n_times"), "n_rows", "mean_rv"
    )


def scatter_sample(df: DataFrame, x: str, y: str, n: int, unique_id: Sequence[str], seed: int = 42, log_axes: Sequence[str] = ()) -> DataFrame:
    """A random sample of rows, by a hash of their unique id, for a scatter chart with log1p on chosen axes."""
    rows = df.where(F.col(x).isNotNull() & F.col(y).isNotNull()).orderBy(F.xxhash64(*unique_id, F.lit(seed)), *unique_id, x, y).limit(n).select(x, y)
    return rows.withColumns({c: F.log1p(c) for c in log_axes}) if log_axes else rows


def null_map(df: DataFrame, unique_id: str, columns: Sequence[str], n: int, seed: int = 42) -> DataFrame:
    """0/1 missing flags of a random row sample."""
    rows = df.orderBy(F.xxhash64(unique_id, F.lit(seed)), unique_id).limit(n)
    return rows.select(unique_id, *[F.col(c).isNull().cast("int").alias(c) for c in columns])
