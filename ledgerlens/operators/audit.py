"""Error rates, calibration and discrimination by group, and recommendation audits."""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators.encode import apply_quantile_bins, fit_quantile_edges, lookup
from ledgerlens.operators.metrics import roc_auc
from ledgerlens.operators.ordering import SLICE, hash_order, only_row, running, slice_count


def group_audit(df: DataFrame, group: Sequence[str], label: str, predicted: str, score: str | None = None, min_rows: int = 1, with_auc: bool = False) -> DataFrame:
    """Rows, base rate and errors per group.

    ``fp_share`` and ``fn_share`` divide by all rows of the group, ``fpr`` and
    ``fnr`` by its negatives and positives.
    """
    y, p = F.col(label), F.col(predicted)
    fp, fn = F.count_if((p == 1) & (y == 0)), F.count_if((p == 0) & (y == 1))
    rows = F.count(F.lit(1))
    aggs = [
        rows.alias("count"),
        F.avg(y.cast("double")).alias("base_rate"),
        (fp / rows).alias("fp_share"),
        (fn / rows).alias("fn_share"),
        S.safe_ratio(fp, F.count_if(y == 0)).alias("fpr"),
        S.safe_ratio(fn, F.count_if(y == 1)).alias("fnr"),
        F.avg((y == p).cast("double")).alias("accuracy"),
    ]
    if score:
        aggs += [F.avg(score).alias("mean_score"), (F.avg(score) - F.avg(y.cast("double"))).alias("calibration_gap")]
    out = df.groupBy(*group).agg(*aggs).where(F.col("count") >= min_rows)
    if with_auc and score:
        out = out.join(roc_auc(df, label, score, group), list(group), "left")
    return out


def audit_by_quantile(df: DataFrame, column: str, label: str, predicted: str, bins: int = 4) -> DataFrame:
    """Group audit over quantile bands of a numeric column."""
    banded = apply_quantile_bins(df, fit_quantile_edges(df, column, bins), column, "band")
    return group_audit(banded, ["band"], label, predicted).withColumn("attribute", F.lit(f"{column}_band"))


def audit_attributes(df: DataFrame, attributes: Mapping[str, tuple[str, str]], label: str, predicted: str, score: str, min_rows: int = 10) -> DataFrame:
    """Group audit with AUC for several 0/1 attributes; ``{column: (name of 1, name of 0)}``."""
    cells = [
        F.struct(F.lit(a).alias("attribute"), F.when(F.col(a) == 1, F.lit(yes)).when(F.col(a) == 0, F.lit(no)).alias("group"))
        for a, (yes, no) in attributes.items()
    ]
    long = df.select(label, predicted, score, F.inline(F.array(*cells))).where(F.col("group").isNotNull())
    return group_audit(long, ["attribute", "group"], label, predicted, score, min_rows, with_auc=True)


def audit_tiers(df: DataFrame, column: str, edges: Sequence[float], names: Sequence[str], label: str, predicted: str, score: str, min_rows: int = 10) -> DataFrame:
    """Group audit over fixed right-closed tiers; null counts as 0."""
    tiers = df.withColumn("tier", S.cut(F.coalesce(F.col(column), F.lit(0.0)), edges, names))
    return group_audit(tiers, ["tier"], label, predicted, score, min_rows, with_auc=True)


def high_risk_audit(df: DataFrame, group: str, label: str, predicted: str, high=2, low=0, min_rows: int = 5) -> DataFrame:
    """Per group: share and recall of the high class, low rows called high, accuracy."""
    y, p = F.col(label), F.col(predicted)
    return df.groupBy(group).agg(
        F.count(F.lit(1)).alias("count"),
        F.avg((y == high).cast("double")).alias("pct_high_true"),
        F.avg((p == high).cast("double")).alias("pct_high_pred"),
        F.avg(F.when(y == high, (p == high).cast("double"))).alias("high_recall"),
        F.avg(F.when(y == low, (p == high).cast("double"))).alias("false_alarm_rate"),
        F.avg((y == p).cast("double")).alias("accuracy"),
    ).where(F.col("count") >= min_rows)


def group_auc(df: DataFrame, group: str, label: str, score: str) -> DataFrame:
    """Rows, positive rate and AUC for groups that have both classes."""
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"), F.avg(F.col(label).cast("double")).alias("pos_rate"))
    return sizes.join(roc_auc(df, label, score, [group]), group).where(F.col("auc").isNotNull())


def disparity(audit: DataFrame, attribute: str, rate: str, bound: float = 0.05) -> DataFrame:
    """Largest difference of a rate between the groups of an attribute, flagged above a bound."""
    out = audit.groupBy(attribute).agg((F.max(rate) - F.min(rate)).alias("disparity"), F.avg(rate).alias("mean_rate"), F.count(F.lit(1)).alias("n_groups"))
    return out.withColumn("flagged", S.flag(F.col("disparity") > bound))


# --- recommendations --------------------------------------------------------

def top_items(df: DataFrame, customer: str, item: str, score: str, k: int = 10) -> DataFrame:
    best = Window.partitionBy(customer).orderBy(F.desc(score), F.asc(item))
    return df.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= k).drop("_r")


def diversity(df: DataFrame, customer: str, item: str, score: str, assets: DataFrame, category: str, k: int = 10) -> DataFrame:
    """Distinct categories among each customer's k best items."""
    top = lookup(top_items(df, customer, item, score, k), assets, [item], {category: None})
    return top.groupBy(customer).agg(F.countDistinct(category).alias("categories_in_top"), F.count(F.lit(1)).alias("n_recommendations"))


def diversity_by(diverse: DataFrame, customers: DataFrame, customer: str, group: str) -> DataFrame:
    return diverse.join(customers.select(customer, group), customer).groupBy(group).agg(
        F.avg("categories_in_top").alias("mean_categories"), F.count(F.lit(1)).alias("n_customers")
    )


def popularity_bias(df: DataFrame, train: DataFrame, customer: str, item: str, label: str, score: str, k: int = 10) -> DataFrame:
    """Mean training popularity of recommended against actually chosen items, averaged over customers."""
    bought = train.where(F.col(label) == 1).select(customer, item).distinct()
    popular = bought.groupBy(item).agg(F.count(F.lit(1)).alias("_pop"))
    recommended = lookup(top_items(df, customer, item, score, k), popular, [item], {"_pop": 0})
    chosen = lookup(df.where(F.col(label) == 1), popular, [item], {"_pop": None})
    mean = lambda rows, name: rows.groupBy(customer).agg(F.avg("_pop").alias(name))
    both = mean(recommended, "_rec").join(mean(chosen, "_act"), customer, "left")
    return both.agg(F.avg("_rec").alias("recommended_popularity"), F.avg("_act").alias("actual_popularity"), F.count(F.lit(1)).alias("n_customers"))


# --- importance -------------------------------------------------------------

def permute_column(df: DataFrame, column: str, unique_id: str, seed: int = 42) -> DataFrame:
    """Replace a column by a random rearrangement of its own values.

    In a hashed order every row takes the value of the row before it and the
    first one that of the last: a permutation without a global shuffle by row
    number.
    """
    n = slice_count(df)
    rows = df.withColumn("_u", hash_order([unique_id], seed)).withColumn(SLICE, F.floor(F.col("_u") * n).cast("int"))
    last = only_row(rows.agg(F.max_by(F.struct(F.col(column).alias("v")), F.struct("_u", unique_id)).alias("last")).select("last.v"))
    moved = running(rows.withColumn("_v", F.struct(F.col(column).alias("v"))), [], ["_u", unique_id], {"_prev": ("previous", F.col("_v"))}, sliced=True)
    value = F.when(F.col("_prev").isNull(), last.getField("v")).otherwise(F.col("_prev.v"))
    return moved.withColumn(column, value).select(*df.columns)


def permutation_importance(df: DataFrame, columns: Sequence[str], unique_id: str, label: str, score_fn: Callable[[DataFrame], DataFrame], seed: int = 42) -> DataFrame:
    """Loss of AUC when one column is permuted; ``score_fn`` adds a ``score`` column."""
    base = roc_auc(score_fn(df), label, "score").withColumn("column", F.lit(""))
    parts = [roc_auc(score_fn(permute_column(df, c, unique_id, seed)), label, "score").withColumn("column", F.lit(c)) for c in columns]
    both = reduce(DataFrame.unionByName, parts)
    reference = base.select("auc").scalar()
    return both.select("column", (reference - F.col("auc")).alias("importance"))
