"""Customer, asset and pair features for recommendation, and factor scores."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.ml.recommendation import ALS
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators.encode import apply_ordinal, fit_ordinal, lookup
from ledgerlens.operators.history import apply_global_rank, fit_global_rank
from ledgerlens.operators.ordering import dense_index, only_row
from ledgerlens.operators.relational import contingency, majority_label
from ledgerlens.session import cut_lineage


def user_features(customers: DataFrame, trades: DataFrame, customer: str, item: str, side: str, value: str, buy: str = "Buy") -> DataFrame:
    """Buying and selling behaviour per customer, zero for customers without trades."""
    bought = F.col(side) == buy
    per = trades.groupBy(customer).agg(
        F.count_if(bought).alias("user_n_buy_tx"),
        F.coalesce(F.sum(F.when(bought, F.col(value))), F.lit(0.0)).alias("user_total_buy"),
        F.coalesce(F.avg(F.when(bought, F.col(value))), F.lit(0.0)).alias("user_avg_buy"),
        F.coalesce(F.stddev_samp(F.when(bought, F.col(value))), F.lit(0.0)).alias("user_buy_std"),
        F.count_if(~bought).alias("user_n_sell_tx"),
    )
    assets = trades.where(bought).select(customer, item).distinct().groupBy(customer).agg(F.count(F.lit(1)).alias("user_n_assets"))
    both = per.join(assets, customer, "left")
    return lookup(customers, both, [customer], {c: 0 for c in both.columns if c != customer})


def profile_scores(df: DataFrame, maps: Mapping[str, tuple[str, Mapping[str, int], int]]) -> DataFrame:
    """Ordinal codes of profile columns: ``{new: (column, mapping, default)}``."""
    return df.withColumns({n: S.map_values(c, m, d) for n, (c, m, d) in maps.items()})


def preferred_category(trades: DataFrame, assets: DataFrame, customer: str, item: str, category: str, name: str = "user_pref_category") -> DataFrame:
    """Category a customer bought most often, the smallest on ties."""
    return majority_label(lookup(trades, assets, [item], {category: None}), customer, category, name)


def item_features(assets: DataFrame, buys: DataFrame, customer: str, item: str, value: str) -> DataFrame:
    """Buyers, purchases and volume per asset, zero where never bought."""
    volume = buys.groupBy(item).agg(
        F.count(F.lit(1)).alias("item_n_purchases"), F.sum(value).alias("item_total_vol"), F.avg(value).alias("item_avg_vol")
    )
    buyers = buys.select(customer, item).distinct().groupBy(item).agg(F.count(F.lit(1)).alias("item_n_buyers"))
    both = volume.join(buyers, item)
    return lookup(assets, both, [item], {c: 0 for c in both.columns if c != item})


def popularity_rank(items: DataFrame, fit: DataFrame, item: str, column: str = "item_n_buyers", name: str = "item_pop_rank") -> DataFrame:
    """Share of fitted items with a smaller popularity."""
    return apply_global_rank(items, fit_global_rank(fit, column), item, column, name, null_rank=0.0)


def roi_features(df: DataFrame, roi: str, low: str, high: str) -> DataFrame:
    value = F.coalesce(F.col(roi), F.lit(0.0))
    return df.withColumns(
        {
            "item_roi": value,
            "item_roi_range": F.coalesce(F.col(high) - F.col(low), F.lit(0.0)),
            "item_positive_roi": S.flag(value > 0),
        }
    )


def encode_assets(df: DataFrame, fit: DataFrame, columns: Sequence[str]) -> DataFrame:
    out = df
    for c in columns:
        out = apply_ordinal(out, fit_ordinal(fit, c), c, f"item_{c}_enc")
    return out


def category_history(buys: DataFrame, assets: DataFrame, customer: str, item: str, category: str, categories: Sequence[str]) -> DataFrame:
    """Purchases per customer in each listed category."""
    counts = contingency(lookup(buys, assets, [item], {category: None}), customer, category, categories)
    return counts.withColumnsRenamed({str(c): f"inter_cat_{c}" for c in categories})


def pair_features(pairs: DataFrame, buys: DataFrame, customer: str, item: str, date: str, as_of=None, never: int = 9999) -> DataFrame:
    """Earlier purchases of the same asset and days since the last one.

    ``as_of`` leaves out purchases after a date, so that a labelled purchase
    does not describe itself; days count from it or from the newest purchase.
    """
    past = buys if as_of is None else buys.where(F.to_date(date) <= F.lit(as_of).cast("date"))
    reference = F.lit(as_of).cast("date") if as_of is not None else only_row(past.agg(F.to_date(F.max(date)).alias("d"))).getField("d")
    history = past.groupBy(customer, item).agg(F.count(F.lit(1)).alias("inter_repeat_buys"), F.max(date).alias("_last"))
    history = history.withColumn("inter_days_since_last_buy", F.datediff(reference, F.to_date("_last")))
    return lookup(pairs, history, [customer, item], {"inter_repeat_buys": 0, "inter_days_since_last_buy": never})


def feature_matrix(pairs: DataFrame, users: DataFrame, items: DataFrame, customer: str, item: str) -> DataFrame:
    return pairs.join(users, customer, "left").join(items, item, "left")


def popularity_scores(train: DataFrame, item: str, label: str) -> DataFrame:
    return train.where(F.col(label) == 1).groupBy(item).agg(F.count(F.lit(1)).alias("pop_score"))


def svd_scores(positives: DataFrame, pairs: DataFrame, customer: str, item: str, k: int = 50, iterations: int = 5, oversample: int = 10, seed: int = 42, name: str = "svd_score") -> DataFrame:
    """Scores of pairs from a rank-k factorisation of the 0/1 customer x asset matrix R.

    R is approximated by (R V) V^T with V the k leading right singular vectors.
    V comes from subspace iteration, V <- R^T R V: two joins and two grouped sums
    per step on tables keyed by asset or customer. Only (k + oversample) squared
    inner products reach the driver, for orthogonalisation. Unknown customers
    and assets score 0.
    """
    cells = cut_lineage(positives.select(customer, item).distinct())
    width = k + oversample
    cols = [f"_f{j}" for j in range(width)]
    start = [(F.hash(F.col(item), F.lit(seed + j)).cast("double") / float(1 << 31)).alias(c) for j, c in enumerate(cols)]
    v = cells.select(item).distinct().select(item, *start)

    def to_customers(v: DataFrame) -> DataFrame:
        return cells.join(v, item).groupBy(customer).agg(*[F.sum(c).alias(c) for c in v.columns if c != item])

    def to_items(u: DataFrame) -> DataFrame:
        return cells.join(u, customer).groupBy(item).agg(*[F.sum(c).alias(c) for c in u.columns if c != customer])

    def products(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            x = np.stack([c.to_numpy(zero_copy_only=False) for c in batch.columns], axis=1)
            total += x.T @ x
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())], ["cell", "value"])

    def gram(df: DataFrame) -> np.ndarray:
        """Inner products of the columns: one matrix a task, added up by cell, however wide."""
        found = df.select(*cols).mapInArrow(products, "cell int, value double").groupBy("cell").agg(F.sum("value").alias("value"))
        out = np.zeros(width * width)
        for row in found.collect():
            out[row.cell] = row.value
        return out.reshape(width, width)

    def rotate(df: DataFrame, key: str, matrix: np.ndarray) -> DataFrame:
        keep = range(matrix.shape[1])
        mixed = [reduce(lambda x, y: x + y, [F.col(c) * float(matrix[i, j]) for i, c in enumerate(cols)]).alias(cols[j]) for j in keep]
        return df.select(key, *mixed)

    def orthonormal(df: DataFrame, key: str) -> DataFrame:
        values, vectors = np.linalg.eigh(gram(df))
        scale = np.where(values > values.max() * 1e-12, 1 / np.sqrt(np.maximum(values, 1e-300)), 0.0)
        return rotate(df, key, vectors * scale)

    for _ in range(iterations):
        v = orthonormal(cut_lineage(to_items(to_customers(v))), item)
    # directions inside the subspace, the strongest first
    u = cut_lineage(to_customers(v))
    values, vectors = np.linalg.eigh(gram(u))
    turn = vectors[:, np.argsort(-values)[:k]]
    v = rotate(v, item, turn)
    u = rotate(u, customer, turn).withColumnsRenamed({c: f"u{c}" for c in cols[:k]})
    scored = pairs.join(u, customer, "left").join(v, item, "left")
    dot = reduce(lambda x, y: x + y, [F.col(f"u{c}") * F.col(c) for c in cols[:k]])
    return scored.select(*pairs.columns, F.coalesce(dot, F.lit(0.0)).alias(name))


def als_scores(positives: DataFrame, pairs: DataFrame, customer: str, item: str, k: int = 50, seed: int = 42, name: str = "als_score") -> DataFrame:
    """The alternative for catalogues too wide for a column-square matrix: implicit ALS."""
    seen = cut_lineage(positives.select(customer, item).distinct())
    rows, columns = cut_lineage(dense_index(seen, customer, "_r")), cut_lineage(dense_index(seen, item, "_c"))
    # a fit reads its cells several times
    cells = cut_lineage(seen.join(rows, customer).join(columns, item).select(F.col("_r").cast("int"), F.col("_c").cast("int"), F.lit(1.0).alias("rating")))
    model = ALS(rank=k, userCol="_r", itemCol="_c", ratingCol="rating", implicitPrefs=True, seed=seed, coldStartStrategy="nan").fit(cells)
    asked = pairs.join(rows, customer, "left").join(columns, item, "left")
    asked = asked.withColumns({"_r": F.coalesce(F.col("_r"), F.lit(-1)).cast("int"), "_c": F.coalesce(F.col("_c"), F.lit(-1)).cast("int")})
    out = model.transform(asked)
    return out.select(*pairs.columns, F.coalesce(S.clean("prediction"), F.lit(0.0)).alias(name))
