"""Features from an entity's own past: velocity, card statistics, statement history."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators.encode import lookup
from ledgerlens.operators.ordering import HEAVY_ROWS, average_rank, dealt, in_order, only_row, packed_order, running


def velocity_features(
    df: DataFrame,
    ts: str,
    unique_id: str,
    amount: str,
    keys: Mapping[str, str],
    epoch: str,
    history: str | None = None,
    heavy: int = HEAVY_ROWS,
) -> DataFrame:
    """``unique_id`` and, for each key set, the earlier rows; for the first also the spend so far and rows per elapsed day.

    ``keys`` maps a short name to a key column. ``history`` names a split column whose values must not see each other;
    by default the history runs across splits. A null key has no history.

    All key sets share one exchange: a row is stacked once per set, narrow, under (set, key), and a second exchange by
    ``unique_id`` brings its results together. Keys too large for a task are cut into slices of time.
    """
    by = ["_set", "_key", *([history] if history else [])]
    sets = [F.struct(F.lit(i).alias("_set"), F.col(k).cast("string").alias("_key")) for i, k in enumerate(keys.values())]
    # a null key of the first set, which also carries the row itself, is a set of its own
    alone = F.struct(F.lit(-1).alias("_set"), F.col(unique_id).cast("string").alias("_key"))
    sets[0] = F.when(F.col(next(iter(keys.values()))).isNotNull(), sets[0]).otherwise(alone)
    start = F.unix_micros(F.lit(epoch).cast("timestamp"))
    days = (F.unix_micros(F.col(ts).cast("timestamp")) - start) / F.lit(86_400_000_000.0)
    rows = df.select(unique_id, ts, *([history] if history else []), F.col(amount).alias("_amount"), days.alias("_days"), F.inline(F.array(*sets)))
    stacked = rows.where(F.col("_key").isNotNull())
    found = in_order(stacked, by, [ts, unique_id], {"_count": ("count", F.lit(1)), "_spend": ("sum", F.when(F.col("_set") == 0, F.col("_amount")))}, heavy)
    before = F.col("_count") - 1
    aggs = []
    for i, short in enumerate(keys):
        own = F.col("_set") == i
        aggs.append(F.max(F.when(own, before)).alias(f"fe_{short}_txn_count"))
        if i == 0:
            aggs.append(F.max(F.when(own, F.col("_spend").cast("double"))).alias(f"fe_{short}_cum_amount"))
            aggs.append(F.max(F.when(own, before / F.greatest("_days", F.lit(1.0)))).alias(f"fe_{short}_txn_freq"))
    narrow = found.select(unique_id, "_set", "_days", "_count", "_spend")
    return dealt(narrow, [unique_id], only_row(df.agg(F.count(F.lit(1)).alias("n"))).value("n") * len(keys)).groupBy(unique_id).agg(*aggs)


def velocity(
    df: DataFrame,
    ts: str,
    unique_id: str,
    amount: str,
    keys: Mapping[str, str],
    epoch: str,
    history: str | None = None,
    heavy: int = HEAVY_ROWS,
) -> DataFrame:
    """All columns of the rows with their :func:`velocity_features`; ``unique_id`` must be unique and not null."""
    return df.join(velocity_features(df, ts, unique_id, amount, keys, epoch, history, heavy), unique_id, "left").select(
        *df.columns, *[f"fe_{short}_{what}" for i, short in enumerate(keys) for what in (("txn_count", "cum_amount", "txn_freq") if i == 0 else ("txn_count",))]
    )


def fit_amount_stats(train: DataFrame, key: str, amount: str, prefix: str, hour: str | None = None, target: str | None = None) -> DataFrame:
    """Mean, deviation (0 for single rows) and count of an amount per key, with optional mean hour and target rate."""
    aggs = [
        F.avg(amount).alias(f"{prefix}_mean_amt"),
        F.coalesce(F.stddev_samp(amount), F.lit(0.0)).alias(f"{prefix}_std_amt"),
        F.count(amount).alias(f"{prefix}_n_txn"),
    ]
    if hour:
        aggs.append(F.avg(hour).alias(f"{prefix}_mean_hour"))
    if target:
        aggs.append(F.avg(F.col(target).cast("double")).alias(f"{prefix}_rate"))
    return train.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def apply_amount_stats(df: DataFrame, stats: DataFrame, key: str, prefix: str, amount: str | None = None) -> DataFrame:
    """Join the statistics; unseen keys get the training rows' mean of each one.

    With ``amount`` also its z-score against the key and an above-mean flag.
    """
    names = [c for c in stats.columns if c != key]
    weight = F.col(f"{prefix}_n_txn")
    means = stats.agg(*[(F.sum(F.col(n) * weight) / F.sum(weight)).alias(n) for n in names])
    row = only_row(means)
    as_double = stats.select(key, *[F.col(n).cast("double").alias(n) for n in names])
    out = lookup(df, as_double, [key], {n: row.getField(n) for n in names})
    if amount is None:
        return out
    mean, std = F.col(f"{prefix}_mean_amt"), F.col(f"{prefix}_std_amt")
    return out.withColumns(
        {
            f"{prefix}_z_score": (F.col(amount) - mean) / (std + 1e-6),
            f"{prefix}_above_mean": S.flag(F.col(amount) > mean),
        }
    )


# --- statement history: one row per (entity, time) --------------------------

def statement_aggregates(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str]) -> DataFrame:
    """Mean, std, min, max, sum, last and the two differences, per entity, in one aggregation."""
    aggs, at = [], F.col("_at")
    for c in columns:
        last, first = S.last_known(c, at), S.first_known(c, at)
        aggs += [
            F.avg(c).alias(f"{c}__mean"),
            F.stddev_samp(c).alias(f"{c}__std"),
            F.min(c).alias(f"{c}__min"),
            F.max(c).alias(f"{c}__max"),
            F.coalesce(F.sum(c), F.lit(0)).alias(f"{c}__sum"),
            last.alias(f"{c}__last"),
            (last - first).alias(f"{c}__diff_last_first"),
            (last - F.avg(c)).alias(f"{c}__diff_last_mean"),
        ]
    return df.withColumn("_at", packed_order(df, order)).groupBy(entity).agg(*aggs)


def newest_rows(df: DataFrame, entity: str, order: Sequence[str], n: int) -> DataFrame:
    """The n newest rows per entity with their reverse position (1 = newest).

    Spark keeps at most n rows per entity before the shuffle.
    """
    back = Window.partitionBy(entity).orderBy(*[F.desc(o) for o in order])
    return df.withColumn("_back", F.row_number().over(back)).where(F.col("_back") <= n)


def recent_statistics(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], spans: Sequence[int] = (3, 6)) -> DataFrame:
    """Mean, std (0 if undefined), min and max over the newest rows of each span."""
    tail = newest_rows(df.select(entity, *order, *[c for c in columns if c not in order]), entity, order, max(spans))
    aggs = []
    for n in spans:
        near = F.col("_back") <= n
        for c in columns:
            v = F.when(near, F.col(c))
            aggs += [
                F.avg(v).alias(f"{c}__last{n}_mean"),
                F.coalesce(F.stddev_samp(v), F.lit(0.0)).alias(f"{c}__last{n}_std"),
                F.min(v).alias(f"{c}__last{n}_min"),
                F.max(v).alias(f"{c}__last{n}_max"),
            ]
    return tail.groupBy(entity).agg(*aggs)


def missingness(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], distinct: Sequence[str] = ()) -> DataFrame:
    """Rows, columns without a last value, columns never filled, distinct values per entity.

    The last value skips nulls, as group-wise "last" does, so the two null
    counts agree; both are kept because callers use both names.
    """
    add = lambda a, b: a + b
    all_null = reduce(add, [S.flag(F.count(c) == 0) for c in columns])
    counts = df.groupBy(entity).agg(
        F.count(F.lit(1)).alias("fe_stmt_count"),
        all_null.alias("fe_last_miss_count"),
        all_null.alias("fe_all_null_count"),
    )
    for c in distinct:
        values = df.where(F.col(c).isNotNull()).select(entity, c).distinct()
        uniq = values.groupBy(entity).agg(F.count(F.lit(1)).alias(f"fe_nuniq_{c}"))
        counts = lookup(counts, uniq, [entity], {f"fe_nuniq_{c}": 0})
    return counts


def own_history_rank(df: DataFrame, entity: str, order: Sequence[str], column: str, name: str | None = None) -> DataFrame:
    """Percentile of the newest known value within the entity's own history (0.5 if it has none)."""
    name = name or f"{column}__user_rank"
    ranked = average_rank(df.select(entity, *order, column), column, [entity], pct="_pct").withColumn("_at", packed_order(df, order))
    return ranked.groupBy(entity).agg(F.coalesce(S.last_known("_pct", F.col("_at")), F.lit(0.5)).alias(name))


def sequence_trend(df: DataFrame, entity: str, order: Sequence[str], columns: Sequence[str], label: str, full: int = 13) -> DataFrame:
    """Mean per sequence number and label over entities with exactly ``full`` rows.

    Entities are chosen by a counted semi-join, so no row of a longer history
    reaches the window.
    """
    whole = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") == full).select(entity)
    seq = Window.partitionBy(entity).orderBy(*order)
    numbered = df.join(whole, entity, "left_semi").withColumn("seq", F.row_number().over(seq))
    return numbered.groupBy("seq", label).agg(*[F.avg(c).alias(f"{c}_mean") for c in columns], F.count(F.lit(1)).alias("n"))


def fit_global_rank(train: DataFrame, column: str) -> DataFrame:
    """Training values in order: value, how many are smaller, how many there are."""
    counts = train.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_ties"))
    ladder = running(counts, [], [column], {"_upto": ("sum", F.col("_ties")), "_of": ("total", F.col("_ties"))})
    return ladder.select(column, (F.col("_upto") - F.col("_ties")).alias("below"), "_upto", "_of")


def apply_global_rank(df: DataFrame, stats: DataFrame, unique_id: str, column: str, name: str, null_rank: float = 0.5) -> DataFrame:
    """Share of training values below each value; values need not occur in training.

    Training values and new rows are merged in one order and the share of
    training values seen so far is carried along.
    """
    marks = stats.select(
        F.col(column).cast("double").alias("_v"), F.lit(1).alias("_kind"), F.lit(None).cast(df.schema[unique_id].dataType).alias(unique_id),
        (F.col("_upto") - F.col("below")).alias("_add"),
    )
    asked = df.where(F.col(column).isNotNull()).select(
        F.col(column).cast("double").alias("_v"), F.lit(0).alias("_kind"), unique_id, F.lit(0).cast("long").alias("_add")
    )
    merged = running(
        marks.unionByName(asked), [], ["_v", "_kind", unique_id],
        {"_below": ("sum", F.col("_add")), "_of": ("total", F.col("_add"))},
    )
    ranks = merged.where("_kind = 0").select(unique_id, (F.col("_below") / F.col("_of")).alias(name))
    return lookup(df, ranks, [unique_id], {name: null_rank})
