"""Splits, folds, sampling and class weights.

Random choices follow a hash of the row's key and a seed: the same rows are
chosen on any number of partitions and when a task is run again.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators.encode import lookup
from ledgerlens.operators.ordering import HEAVY_ROWS, dense_index, hash_order, hash_positions, in_order, only_row, positions, quantile_table
from ledgerlens.operators.relational import majority_label
from ledgerlens.session import cut_lineage


def stratified_split(df: DataFrame, unique_id: str, label: str | None, val: float = 0.2, test: float = 0.0, seed: int = 42, name: str = "split") -> DataFrame:
    """Exact train/val/test shares within each class (or overall without a label)."""
    placed = hash_positions(df, [unique_id], seed, [label] if label else [], "_at", "_of")
    held = F.ceil(F.round((val + test) * F.col("_of"), 9))
    tested = F.ceil(F.round(test / (val + test) * held, 9)) if test else F.lit(0)
    split = F.when(F.col("_at") > held, "train").when(F.col("_at") > tested, "val").otherwise("test")
    return placed.withColumn(name, split).drop("_at", "_of")


def entity_split(df: DataFrame, entities: DataFrame, entity: str, label: str | None, val: float = 0.2, test: float = 0.0, seed: int = 42) -> DataFrame:
    """Split the entity table, then give every row its entity's side; rows of unknown entities are dropped."""
    sides = stratified_split(entities, entity, label, val, test, seed).select(entity, "split")
    return df.join(sides, entity)


def majority_split(df: DataFrame, entity: str, label: str, val: float = 0.15, test: float = 0.15, seed: int = 42) -> DataFrame:
    """Entity split stratified by each entity's most frequent label."""
    return entity_split(df, majority_label(df, entity, label, "_major"), entity, "_major", val, test, seed)


def time_split(df: DataFrame, time: str, train: float = 0.8, val: float = 0.1, name: str = "split") -> DataFrame:
    """Split by the order of distinct times."""
    times = dense_index(df, time, "_t")
    n = only_row(times.agg(F.count(F.lit(1)).alias("n"))).value("n")
    first, second = int(n * train), int(n * (train + val))
    side = F.when(F.col("_t") < first, "train").when(F.col("_t") < second, "val").otherwise("test")
    return df.join(times.select(time, side.alias(name)), time)


def split_at(df: DataFrame, column: str, value, name: str = "split") -> DataFrame:
    """Train before a value, val at it; later rows are left out."""
    side = F.when(F.col(column) < value, "train").when(F.col(column) == value, "val")
    return df.withColumn(name, side).where(F.col(name).isNotNull())


def last_months_split(df: DataFrame, date: str, entity: str, months: int = 3, name: str = "split") -> DataFrame:
    """The last months are val, restricted to entities seen before."""
    newest = only_row(df.agg(F.max(date).alias("d"))).getField("d")
    cutoff = F.add_months(newest, -months)
    tagged = df.withColumn(name, F.when(F.to_date(date) <= cutoff, "train").otherwise("val"))
    known = tagged.where(F.col(name) == "train").select(entity).distinct().withColumn("_known", F.lit(True))
    marked = lookup(tagged, known, [entity], {"_known": F.lit(False)})
    return marked.where((F.col(name) == "train") | F.col("_known")).drop("_known")


def stratified_folds(df: DataFrame, unique_id: str, label: str, k: int = 5, seed: int = 42, name: str = "fold") -> DataFrame:
    """Fold 0..k-1; each class is dealt out evenly."""
    placed = hash_positions(df, [unique_id], seed, [label], "_at")
    return placed.withColumn(name, ((F.col("_at") - 1) % k).cast("int")).drop("_at")


def block_folds(df: DataFrame, time: str, folds: int = 5) -> DataFrame:
    """Expanding time folds in long form: rows, fold, part.

    Times are cut into folds+1 equal blocks (the remainder is unused); fold i
    trains on all blocks before its own and validates on its own.
    """
    times = dense_index(df, time, "_t")
    n = only_row(times.agg(F.count(F.lit(1)).alias("n"))).value("n")
    size = max(1, n // (folds + 1))
    blocks = times.select(time, F.floor(F.col("_t") / size).cast("int").alias("_block"))
    numbers = F.explode(F.array(*[F.lit(i) for i in range(1, folds + 1)])).alias("fold")
    part = F.when(F.col("_block") < F.col("fold"), "train").when(F.col("_block") == F.col("fold"), "val")
    tagged = blocks.select(time, numbers, "_block").withColumn("part", part).where(F.col("part").isNotNull())
    return df.join(tagged.drop("_block"), time)


def split_facts(df: DataFrame, label: str, name: str = "split") -> DataFrame:
    total = df.agg(F.count(F.lit(1))).scalar()
    return df.groupBy(name).agg(
        F.count(F.lit(1)).alias("n"), (100 * F.count(F.lit(1)) / total).alias("pct"),
        F.sum(F.col(label).cast("long")).alias("positives"), F.avg(F.col(label).cast("double")).alias("positive_rate"),
    )


def sample_rows(df: DataFrame, unique_id: str, n: int, seed: int = 42) -> DataFrame:
    """A repeatable random sample of n rows."""
    return df.orderBy(hash_order([unique_id], seed), unique_id).limit(n)


def sample_classes(df: DataFrame, unique_id: str, label: str, fraction: float, seed: int = 42) -> DataFrame:
    """The same exact fraction of every class."""
    placed = hash_positions(df, [unique_id], seed, [label], "_at", "_of")
    return placed.where(F.col("_at") <= F.round(F.col("_of") * fraction)).drop("_at", "_of")


# --- negative sampling ------------------------------------------------------

def _next_prime(n: int) -> int:
    def prime(m: int) -> bool:
        return m > 1 and all(m % d for d in range(2, int(m**0.5) + 1))

    while not prime(n):
        n += 1
    return n


def negative_pairs(positives: DataFrame, items: DataFrame, customer: str, item: str, ratio: int = 4, seed: int = 42) -> DataFrame:
    """Items a customer did not choose: min(available, ratio x chosen) per customer, without building all pairs.

    Each customer walks the item list in an own order i -> (a i + b) mod p with
    p prime. Among the first (ratio+1) x chosen steps at most ``chosen`` hit a
    chosen item, so the wanted number of others is always among them. Steps are
    laid out from the positive rows, so a customer with many of them is spread
    over as many rows; the steps that count are found by position. What is read
    more than once, the item list and the chosen pairs, is computed once.
    """
    chosen = positives.select(customer, item).distinct()
    catalog = cut_lineage(dense_index(items, item, "_i"))
    n_items = only_row(catalog.agg(F.count(F.lit(1)).alias("n"))).value("n")
    prime = _next_prime(max(n_items, 2))
    spare = prime - n_items
    known = cut_lineage(chosen.join(catalog.select(item), item, "left_semi"))
    heavy = HEAVY_ROWS // (ratio + 1)  # chosen rows of a customer whose steps are too many for a task
    placed = in_order(known, [customer], [item], {"_p": ("count", F.lit(1)), "_m": ("total", F.lit(1))}, heavy)
    # the first row also carries the steps that may fall beyond the item list
    extra = F.when(F.col("_p") == 1, F.sequence((ratio + 1) * F.col("_m"), (ratio + 1) * F.col("_m") + spare)).otherwise(F.array().cast("array<bigint>"))
    own = F.sequence((ratio + 1) * (F.col("_p") - 1), (ratio + 1) * F.col("_p") - 1)
    steps = placed.select(customer, "_m", F.explode(F.array_distinct(F.concat(own, extra))).alias("_k")).where(F.col("_k") < prime)
    a = F.pmod(F.xxhash64(F.col(customer), F.lit(seed)), F.lit(prime - 1)) + 1
    b = F.pmod(F.xxhash64(F.col(customer), F.lit(seed + 1)), F.lit(prime))
    walk = steps.select(customer, "_m", "_k", F.pmod(a * F.col("_k") + b, F.lit(prime)).alias("_i")).where(F.col("_i") < n_items)
    fresh = walk.join(catalog, "_i").join(known, [customer, item], "left_anti")
    counted = in_order(fresh, [customer], ["_k"], {"_n": ("count", F.lit(1))}, heavy, known)
    return counted.where(F.col("_n") <= ratio * F.col("_m")).select(customer, item)


def candidate_pairs(trades: DataFrame, items: DataFrame, customer: str, item: str, ratio: int = 4, seed: int = 42) -> DataFrame:
    """Chosen pairs with label 1 and their count, sampled others with label 0, and a query number per customer."""
    positives = cut_lineage(trades.groupBy(customer, item).agg(F.count(F.lit(1)).alias("n")))
    negatives = negative_pairs(positives, items, customer, item, ratio, seed)
    pairs = positives.withColumn("label", F.lit(1)).unionByName(negatives.withColumns({"n": F.lit(0).cast("long"), "label": F.lit(0)}))
    return pairs.join(dense_index(positives, customer, "query_id"), customer)


# --- weights ----------------------------------------------------------------

def class_weights(df: DataFrame, label: str) -> DataFrame:
    """Balanced weight n / (classes x rows of the class), and negatives per positive."""
    counts = df.groupBy(label).agg(F.count(F.lit(1)).alias("n"))
    whole = only_row(counts.agg(
        F.sum("n").alias("total"), F.count(F.lit(1)).alias("k"),
        F.max(F.when(F.col(label) == 1, F.col("n"))).alias("pos"), F.max(F.when(F.col(label) == 0, F.col("n"))).alias("neg")))
    ratio = S.safe_ratio(whole.getField("neg"), whole.getField("pos"), None)
    return counts.select(
        label, "n", (whole.getField("total") / (whole.getField("k") * F.col("n"))).alias("weight"),
        F.when(F.col(label) == 1, ratio).otherwise(1.0).alias("pos_weight"),
    )


def with_class_weight(df: DataFrame, label: str, name: str = "weight") -> DataFrame:
    return lookup(df, class_weights(df, label).select(label, F.col("weight").alias(name)), [label], {name: 1.0})


def relative_error_weights(df: DataFrame, target: str, name: str = "weight") -> DataFrame:
    """1/y squared, scaled to mean 1; values at or below 0 use the first percentile of the positive ones."""
    low = only_row(quantile_table(df.where(F.col(target) > 0), {"e": (target, 0.01)})).value("e")
    y = F.when(F.col(target) > 0, F.col(target)).otherwise(low if low is not None else 1e-6)
    mean = only_row(df.agg(F.avg(1 / (y * y)).alias("m"))).getField("m")
    return df.withColumn(name, 1 / (y * y) / mean)
