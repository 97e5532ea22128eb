"""Joins and grouped aggregates.

Join strategies are left to Spark: small sides are broadcast while they stay
under its size limit, skewed partitions are split by adaptive execution.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators.ordering import positions, quantile_table, running


# --- joins ------------------------------------------------------------------

def attach(fact: DataFrame, dimension: DataFrame, on: str | Sequence[str] | Mapping[str, str], columns: Sequence[str] | None = None, how: str = "left") -> DataFrame:
    """Join the named columns of a dimension; ``on`` may map fact to dimension keys."""
    if isinstance(on, Mapping):
        named = dimension.withColumnsRenamed({d: f for f, d in on.items()})
        keys = list(on)
    else:
        named, keys = dimension, [on] if isinstance(on, str) else list(on)
    wanted = columns if columns is not None else [c for c in named.columns if c not in keys]
    return fact.join(named.select(*keys, *[c for c in wanted if c not in keys]), keys, how)


def known_only(df: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(reference.select(*keys), list(keys), "left_semi")


def unknown_only(df: DataFrame, reference: DataFrame, keys: Sequence[str]) -> DataFrame:
    return df.join(reference.select(*keys), list(keys), "left_anti")


def fill_added(df: DataFrame, columns: Sequence[str], value: float = 0.0) -> DataFrame:
    """Zero-fill only the columns a join added."""
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def assign_round_robin(rows: DataFrame, unique_id: str, targets: DataFrame, target_id: str) -> DataFrame:
    """Give the rows, in id order, one target after the other, starting over at the end."""
    numbered = positions(targets.select(target_id), [target_id], name="_slot")
    n = targets.agg(F.count(F.lit(1))).scalar()
    placed = positions(rows, [unique_id], name="_place").withColumn("_slot", F.pmod(F.col("_place") - 1, n) + 1)
    return placed.join(numbered, "_slot").drop("_slot", "_place")


# --- grouped rates and shares -----------------------------------------------

def rate_by(df: DataFrame, by: Sequence[str | Column], target: str) -> DataFrame:
    return df.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"), F.sum(F.col(target).cast("long")).alias("hits"), F.avg(F.col(target).cast("double")).alias("rate")
    )


def contingency(df: DataFrame, rows: str, columns: str, values: Sequence) -> DataFrame:
    """Counts per row value and listed column value; the list fixes the schema."""
    out = df.groupBy(rows).pivot(columns, list(values)).agg(F.count(F.lit(1)))
    return out.select(rows, *[F.coalesce(F.col(f"`{v}`"), F.lit(0)).alias(str(v)) for v in values])


def row_shares(table: DataFrame, columns: Sequence[str]) -> DataFrame:
    total = S.row_sum([F.col(f"`{c}`") for c in columns])
    return table.withColumns({c: S.safe_ratio(F.col(f"`{c}`"), total) for c in columns})


def share_within(df: DataFrame, group: str, label: str) -> DataFrame:
    """Count per (group, label) and its share of the group."""
    counts = df.groupBy(group, label).agg(F.count(F.lit(1)).alias("n"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy(group)))


def period_sums(df: DataFrame, date: str, value: str, fill_empty: bool = True) -> DataFrame:
    """Monthly sums; empty months between the first and the last appear with 0."""
    sums = df.groupBy(F.to_date(F.trunc(date, "month")).alias("month")).agg(F.sum(value).alias("total"), F.count(F.lit(1)).alias("n"))
    if not fill_empty:
        return sums
    ends = sums.agg(F.min("month").alias("a"), F.max("month").alias("b"))
    calendar = ends.select(F.explode(F.expr("sequence(a, b, interval 1 month)")).alias("month"))
    return fill_added(calendar.join(sums, "month", "left"), ["total", "n"], 0)


def weekday_counts(df: DataFrame, date: str) -> DataFrame:
    """Rows per weekday, Monday first, zero included."""
    days = ["Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday"]
    counts = df.agg(*[F.count_if(F.weekday(date) == i).alias(d) for i, d in enumerate(days)])
    cells = [F.struct(F.lit(i).alias("weekday"), F.lit(d).alias("day_name"), F.col(d).alias("n")) for i, d in enumerate(days)]
    return counts.select(F.inline(F.array(*cells)))


def class_means(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Mean per class 1 and 0 and the difference in percent, one row per column."""
    aggs = []
    for c in columns:
        aggs += [F.avg(F.when(F.col(target) == k, F.col(c))).alias(f"{n}__{c}") for k, n in ((1, "mean_1"), (0, "mean_0"))]
    wide = df.agg(*aggs)
    cells = [
        F.struct(
            F.lit(c).alias("column"), F.col(f"mean_1__{c}").alias("mean_1"), F.col(f"mean_0__{c}").alias("mean_0"),
            (100 * (F.col(f"mean_1__{c}") - F.col(f"mean_0__{c}")) / (F.col(f"mean_0__{c}") + 1e-9)).alias("diff_pct"),
        )
        for c in columns
    ]
    return wide.select(F.inline(F.array(*cells)))


def class_medians(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    return quantile_table(df, {f"{c}_median": (c, 0.5) for c in columns}, [target])


def entity_spread(df: DataFrame, entity: str, value: str) -> DataFrame:
    return df.groupBy(entity).agg(
        F.avg(value).alias("mean"), F.stddev_samp(value).alias("std"), F.min(value).alias("min"),
        F.max(value).alias("max"), F.count(value).alias("n"),
    )


def majority_label(df: DataFrame, entity: str, label: str, name: str = "majority") -> DataFrame:
    """Most frequent label per entity, the smallest on ties."""
    counts = df.where(F.col(label).isNotNull()).groupBy(entity, label).agg(F.count(F.lit(1)).alias("_n"))
    return counts.groupBy(entity).agg(F.min_by(F.col(label), F.struct(-F.col("_n"), F.col(label))).alias(name))


def head_share(df: DataFrame, item: str, top: float = 0.2) -> DataFrame:
    """Share of all rows that belong to the most frequent ``top`` part of the items."""
    counts = df.groupBy(item).agg(F.count(F.lit(1)).alias("_n"))
    placed = running(
        counts.withColumn("_neg", -F.col("_n")), [], ["_neg", item],
        {"_at": ("count", F.lit(1)), "_items": ("total", F.lit(1)), "_rows": ("total", F.col("_n"))},
    )
    inside = F.col("_at") <= F.floor(F.col("_items") * top)
    return placed.agg(
        F.max("_items").alias("n_items"), F.count_if(inside).alias("n_head"),
        (F.sum(F.when(inside, F.col("_n")).otherwise(0)) / F.max("_rows")).alias("head_share"),
    )


def pair_sparsity(df: DataFrame, row: str, column: str, n_rows: Column, n_columns: Column) -> DataFrame:
    """How empty the row x column matrix is, and columns per row."""
    per_row = df.select(row, column).distinct().groupBy(row).agg(F.count(F.lit(1)).alias("_k"))
    return per_row.agg(F.sum("_k").alias("n_pairs"), F.avg("_k").alias("mean_per_row")).select(
        "n_pairs", "mean_per_row", (1 - F.col("n_pairs") / (n_rows * n_columns)).alias("sparsity")
    )


def quantile_labels(df: DataFrame, by: str, value: str, low: float = 0.4, high: float = 0.6, name: str = "label") -> DataFrame:
    """1 at or above the group's high quantile, 0 at or below the low one; the middle is dropped."""
    edges = quantile_table(df, {"_low": (value, low), "_high": (value, high)}, [by])
    v = F.col(value)
    labelled = df.join(edges, by).withColumn(name, F.when(v >= F.col("_high"), 1).when(v <= F.col("_low"), 0))
    return labelled.where(F.col(name).isNotNull()).drop("_low", "_high")


def anova_f(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """One-way F statistic per column, from sums per class."""
    parts = []
    for c in columns:
        x = F.col(c).cast("double")
        parts.append(F.struct(F.lit(c).alias("column"), x.alias("x")))
    long = df.select(label, F.inline(F.array(*parts))).where(F.col("x").isNotNull() & F.col(label).isNotNull())
    classes = long.groupBy("column", label).agg(
        F.count("x").alias("n"), F.avg("x").alias("m"), (F.var_pop("x") * F.count("x")).alias("within")
    )
    total = classes.groupBy("column").agg(
        F.sum("n").alias("N"), F.count(F.lit(1)).alias("k"), F.sum("within").alias("W"),
        (F.sum(F.col("n") * F.col("m") * F.col("m")) - F.pow(F.sum(F.col("n") * F.col("m")), F.lit(2)) / F.sum("n")).alias("B"),
    )
    f = (F.col("B") / (F.col("k") - 1)) / F.nullif(F.col("W") / (F.col("N") - F.col("k")), F.lit(0.0))
    return total.select("column", f.alias("f_value"), F.col("N").alias("n"))


# --- subscriber aggregates --------------------------------------------------

def subscription_aggregate(df: DataFrame, user: str, listed: str, paid: str, days: str, renew: str, cancel: str, expires: str, date: str) -> DataFrame:
    """Payments per user: counts, means, newest dates and the discount on the sums."""
    return df.groupBy(user).agg(
        F.count(F.lit(1)).alias("txn_count"),
        F.avg(days).alias("plan_days_mean"),
        F.avg(listed).alias("plan_price_mean"),
        F.avg(paid).alias("actual_paid_mean"),
        F.avg(renew).alias("auto_renew_rate"),
        F.avg(cancel).alias("cancel_rate"),
        F.max(expires).alias("last_expire_date"),
        F.max(date).alias("last_txn_date"),
        (1 - F.sum(paid) / F.nullif(F.sum(listed), F.lit(0.0))).alias("discount_rate"),
    )


def log_aggregate(df: DataFrame, user: str, means: Sequence[str], sums: Sequence[str] = ()) -> DataFrame:
    """Exact means and sums of daily activity per user."""
    return df.groupBy(user).agg(
        F.count(F.lit(1)).alias("log_days"),
        *[F.avg(c).alias(f"{c}_mean") for c in means],
        *[F.sum(c).alias(f"{c}_sum") for c in sums],
    )


def buy_ratio(trades: DataFrame, category: str, side: str, buy: str = "Buy") -> DataFrame:
    """Number of trades and share of purchases by category."""
    return trades.groupBy(F.col(category).alias("category")).agg(
        F.count(F.lit(1)).alias("n_trades"), F.avg((F.col(side) == buy).cast("double")).alias("buy_ratio")
    )
