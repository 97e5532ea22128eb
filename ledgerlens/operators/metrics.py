"""Metrics of scored tables.

Curve metrics work on distinct scores: counts per score are grouped first, then
accumulated in score order with ``running``, which needs no global sort in one
task.
"""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators.ordering import (
    assign_slices,
    only_row,
    positions,
    quantile_table,
    rolling,
    row_positions,
    running,
)
from ledgerlens.session import cut_lineage


def score_counts(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Positives and negatives per distinct score."""
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    return known.groupBy(*by, score).agg(
        F.count_if(F.col(label) == 1).alias("pos"), F.count_if(F.col(label) == 0).alias("neg")
    )


def score_curve(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    """Per distinct threshold, from high to low: hits and false alarms at or above it, and the totals."""
    counts = cut_lineage(score_counts(df, label, score, by))  # read for the edges, the cells and the rows
    return running(
        counts, by, [score],
        {"tp": ("sum", F.col("pos")), "fp": ("sum", F.col("neg")), "P": ("total", F.col("pos")), "N": ("total", F.col("neg"))},
        descending=True,
    )


def _d(c: str) -> Column:
    return F.col(c).cast("double")


def roc_auc(df: DataFrame, label: str, score: str, by: Sequence[str] = (), name: str = "auc") -> DataFrame:
    """Area under the ROC curve, ties counted half; null where a group has one class."""
    curve = score_curve(df, label, score, by)
    won = F.sum(_d("pos") * (_d("N") - _d("fp")) + _d("pos") * _d("neg") / 2)
    pairs = F.max(_d("P") * _d("N"))
    return curve.groupBy(*by).agg((won / F.nullif(pairs, F.lit(0.0))).alias(name))


def average_precision(df: DataFrame, label: str, score: str, by: Sequence[str] = ()) -> DataFrame:
    curve = score_curve(df, label, score, by)
    step = _d("pos") / F.nullif(_d("P"), F.lit(0.0)) * _d("tp") / (_d("tp") + _d("fp"))
    return curve.groupBy(*by).agg(F.sum(step).alias("average_precision"))


def curve_points(df: DataFrame, label: str, score: str) -> DataFrame:
    """ROC and precision-recall points per distinct threshold."""
    return score_curve(df, label, score).select(
        F.col(score).alias("threshold"),
        S.safe_ratio("tp", "P").alias("tpr"),
        S.safe_ratio("fp", "N").alias("fpr"),
        S.safe_ratio("tp", F.col("tp") + F.col("fp")).alias("precision"),
    )


def rates(tp: Column, fp: Column, fn: Column, tn: Column) -> dict[str, Column]:
    precision, recall = S.safe_ratio(tp, tp + fp), S.safe_ratio(tp, tp + fn)
    return {
        "precision": precision,
        "recall": recall,
        "f1": S.safe_ratio(2 * tp, 2 * tp + fp + fn),
        "fpr": S.safe_ratio(fp, fp + tn),
        "accuracy": S.safe_ratio(tp + tn, tp + fp + fn + tn),
        "coverage": S.safe_ratio(tp + fp, tp + fp + fn + tn),
    }


def confusion(df: DataFrame, label: str, predicted: str, by: Sequence[str] = ()) -> DataFrame:
    """The four cells and the usual rates, 0 where undefined."""
    y, p = F.col(label), F.col(predicted)
    cells = df.groupBy(*by).agg(
        F.count_if((p == 1) & (y == 1)).alias("tp"), F.count_if((p == 1) & (y == 0)).alias("fp"),
        F.count_if((p == 0) & (y == 1)).alias("fn"), F.count_if((p == 0) & (y == 0)).alias("tn"),
    )
    return cells.withColumns(rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")))


def threshold_sweep(df: DataFrame, label: str, score: str, thresholds: Sequence[float], cost_fp: float = 1.0, cost_fn: float = 10.0) -> DataFrame:
    """Cells, rates and cost at each threshold of a fixed grid, from one pass.

    Rows are counted per grid cell; at most ``len(thresholds) + 1`` cells are
    then accumulated from the top.
    """
    grid = sorted(thresholds)
    rows = df.select(F.col(label).alias("_y"), F.col(score).cast("double").alias("_s")).dropna()
    cells = assign_slices(rows, {"_s": "_k"}, {"_s": grid}).groupBy("_k").agg(
        F.count_if(F.col("_y") == 1).alias("_pos"), F.count_if(F.col("_y") == 0).alias("_neg")
    )
    marks = df.sparkSession.createDataFrame([(i + 1, float(t)) for i, t in enumerate(grid)], "_k int, threshold double")
    top = Window.partitionBy(F.lit(0)).orderBy(F.desc("_k")).rowsBetween(Window.unboundedPreceding, 0)
    whole = Window.partitionBy(F.lit(0))
    # the cell below the lowest threshold only adds to the totals
    full = marks.join(cells, "_k", "full").select(
        "_k", "threshold",
        F.coalesce(F.sum("_pos").over(top), F.lit(0)).alias("tp"), F.coalesce(F.sum("_neg").over(top), F.lit(0)).alias("fp"),
        F.sum("_pos").over(whole).alias("_P"), F.sum("_neg").over(whole).alias("_N"),
    )
    out = full.where(F.col("threshold").isNotNull()).select(
        "threshold", "tp", "fp", (F.col("_P") - F.col("tp")).alias("fn"), (F.col("_N") - F.col("fp")).alias("tn")
    )
    return out.withColumns(
        {**rates(F.col("tp"), F.col("fp"), F.col("fn"), F.col("tn")), "cost": cost_fp * F.col("fp") + cost_fn * F.col("fn")}
    )


def best_threshold(sweep: DataFrame, measure: str = "f1", largest: bool = True) -> DataFrame:
    """The row with the best measure, the lowest threshold on ties."""
    key = F.desc(measure) if largest else F.asc(measure)
    return sweep.orderBy(key, "threshold").limit(1)


F1_GRID = [0.05 + i * 0.01 for i in range(90)]
PERCENT_GRID = [0.01 + i * 0.01 for i in range(98)]


def youden_threshold(df: DataFrame, label: str, score: str) -> DataFrame:
    """Threshold with the largest TPR - FPR, the highest on ties."""
    points = curve_points(df, label, score).withColumn("j", F.col("tpr") - F.col("fpr"))
    best = points.agg(F.max_by(F.struct("threshold", "tpr", "fpr", "j"), F.struct(F.round("j", 12), "threshold")).alias("b"))
    return best.select("b.*")


def capture_rates(df: DataFrame, label: str, score: str, unique_id: str, shares: Sequence[float]) -> DataFrame:
    """Share of all positives among the top ceil(p n) rows, ties by id.

    Scores wholly inside the top are taken from the curve. Only the rows that
    share the boundary score are placed one by one.
    """
    curve = score_curve(df, label, score)
    ask = F.explode(F.array(*[F.lit(float(p)) for p in shares])).alias("share")
    wanted = curve.select("*", ask).withColumn("_top", F.greatest(F.ceil(F.col("share") * (F.col("P") + F.col("N"))), F.lit(1)))
    upto, ahead = F.col("tp") + F.col("fp"), F.col("tp") + F.col("fp") - F.col("pos") - F.col("neg")
    edge = wanted.where((ahead < F.col("_top")) & (upto >= F.col("_top"))).select(
        score, "share", "_top", (F.col("_top") - ahead).alias("_need"), (F.col("tp") - F.col("pos")).alias("_sure"), "P"
    )
    tied = df.join(edge.select(score).distinct(), score, "left_semi").select(score, unique_id, F.col(label).cast("long").alias("_y"))
    placed = running(tied, [score], [unique_id], {"_need": ("count", F.lit(1)), "_some": ("sum", F.col("_y"))})
    out = edge.join(placed.select(score, "_need", "_some"), [score, "_need"])
    return out.select("share", F.col("_top").alias("n_top"), S.safe_ratio(F.col("_sure") + F.col("_some"), "P").alias("capture_rate"))


def card_metric(df: DataFrame, label: str, score: str, unique_id: str) -> DataFrame:
    """Half the normalised Gini plus half the capture rate in the top 4%."""
    gini = roc_auc(df, label, score).select((2 * F.col("auc") - 1).alias("gini"))
    top = capture_rates(df, label, score, unique_id, [0.04]).select("capture_rate").scalar()
    out = gini.withColumn("capture_rate", top)
    both = out.withColumn("card_metric", 0.5 * (F.col("gini") + F.col("capture_rate")))
    return both.select(*[F.coalesce(F.col(c), F.lit(0.0)).alias(c) for c in both.columns])


def position_bins(df: DataFrame, score: str, unique_id: str, bins: int = 10, name: str = "bin") -> DataFrame:
    """Bin 1..bins by position from the highest score: equal parts of the position range."""
    placed = row_positions(df, score, unique_id, True, "_at", "_of")
    part = S.equal_width_bin(F.col("_at") - 1, F.lit(0), F.col("_of") - 1, bins)
    return placed.withColumn(name, part + 1).drop("_at", "_of")


def bin_rates(df: DataFrame, label: str, score: str, unique_id: str, bins: int = 10) -> DataFrame:
    """Label rate per score bin, bin 1 the highest scores."""
    return position_bins(df, score, unique_id, bins, "decile").groupBy("decile").agg(
        F.count(F.lit(1)).alias("n"), F.avg(_d(label)).alias("rate")
    )


def smoothed_precision(df: DataFrame, label: str, score: str) -> DataFrame:
    """Precision per threshold and its envelope: the best precision at this or any higher threshold.

    The artificial end point (precision 1 at recall 0) is left out: with it
    the envelope would be 1 everywhere.
    """
    points = curve_points(df, label, score).select("threshold", "precision", F.col("tpr").alias("recall"))
    return running(points, [], ["threshold"], {"smooth_precision": ("max", F.col("precision"))}, descending=True)


def recall_at_precision(df: DataFrame, label: str, score: str, target: float = 0.8) -> DataFrame:
    """Operating point with the highest recall whose smoothed precision reaches the target."""
    fits = smoothed_precision(df, label, score).where(F.col("smooth_precision") >= target)
    best = fits.agg(F.max_by(F.struct("threshold", "precision", "smooth_precision", "recall"), F.struct("recall", -F.col("threshold"))).alias("b"))
    return best.select("b.*").where(F.col("threshold").isNotNull())


def money_utility(df: DataFrame, label: str, score: str, amount: str, threshold: float, review: float = 5.0, friction: float = 15.0, missed: float = 1.5) -> DataFrame:
    """Alerts, saved and lost money, review and friction cost, and the balance at a threshold."""
    hit, y, money = F.col(score) >= threshold, F.col(label) == 1, F.col(amount)
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    sums = df.agg(
        F.count_if(hit).alias("alerts"),
        (100 * F.count_if(hit) / F.count(F.lit(1))).alias("alert_pct"),
        zero(F.sum(F.when(hit & y, money))).alias("saved"),
        zero(F.sum(F.when(~hit & y, money * missed))).alias("lost"),
        (F.count_if(hit) * review + F.count_if(hit & ~y) * friction).alias("overhead"),
    )
    return sums.withColumn("net", F.col("saved") - F.col("lost") - F.col("overhead"))


def business_impact(df: DataFrame, label: str, score: str, thresholds: Sequence[float], value: float = 150.0, prevented: float = 0.85, alert_cost: float = 12.0) -> DataFrame:
    """Hits and false alarms turned into money at each threshold."""
    sweep = threshold_sweep(df, label, score, thresholds)
    saved, cost = F.col("tp") * value * prevented, F.col("fp") * alert_cost
    return sweep.select(
        "threshold", "tp", "fp", "fn", "precision", "recall",
        saved.alias("losses_saved"), cost.alias("false_alert_cost"), (saved - cost).alias("net_benefit"),
    )


# --- regression -------------------------------------------------------------

def regression_report(df: DataFrame, actual: str, predicted_log: str) -> DataFrame:
    """Relative error on the original scale (rows with 0 left out), the rest on the log scale."""
    y, p = F.col(actual), F.expm1(S.clip(predicted_log, -10.0, 10.0))
    ylog, e = F.log1p(actual), F.log1p(actual) - F.col(predicted_log)
    rel = (p - y) / F.nullif(y, F.lit(0.0))
    return df.agg(
        F.sqrt(F.avg(rel * rel)).alias("rmspe"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"),
        (1 - F.avg(e * e) / F.var_pop(ylog)).alias("r2"), F.count(F.lit(1)).alias("n"),
    )


def residual_summary(df: DataFrame, actual: str, predicted: str) -> DataFrame:
    """Mean bias, correlation, and the spread of the relative error in percent."""
    rows = df.select(F.col(actual).alias("_y"), F.col(predicted).alias("_p")).dropna()
    rel = (F.col("_p") - F.col("_y")) / F.greatest(F.col("_y"), F.lit(1e-9)) * 100
    rows = rows.withColumns({"_rel": rel, "_abs": F.abs(rel)})
    q = only_row(quantile_table(rows, {"p1": ("_rel", 0.01), "p99": ("_rel", 0.99), "p90": ("_abs", 0.9)}))
    clipped = S.clip("_rel", q.getField("p1"), q.getField("p99"))
    return rows.agg(
        F.avg(F.col("_p") - F.col("_y")).alias("mean_bias"), F.corr("_p", "_y").alias("correlation"), F.avg(clipped).alias("mean_rel_clipped"),
        F.count(F.lit(1)).alias("n"),
    ).withColumn("p90_abs_rel", q.getField("p90"))


def entity_errors(df: DataFrame, entity: str, actual: str, predicted: str) -> DataFrame:
    """Relative error, rows and mean per entity."""
    rel = (F.col(predicted) - F.col(actual)) / F.greatest(F.col(actual), F.lit(1e-9))
    return df.groupBy(entity).agg(
        F.sqrt(F.avg(rel * rel)).alias("rmspe"), F.count(actual).alias("count"), F.avg(actual).alias("mean_actual")
    )


def error_disparity(errors: DataFrame) -> DataFrame:
    return errors.agg((F.max("rmspe") / F.greatest(F.min("rmspe"), F.lit(1e-9))).alias("disparity"), F.avg("rmspe").alias("mean_rmspe"))


def diebold_mariano(df: DataFrame, order: str, e1: str, e2: str, h: int = 1) -> DataFrame:
    """Test of equal accuracy of two forecasts on squared errors in ``order``, with h-1 autocovariances."""
    rows = df.select(order, (F.col(e1) * F.col(e1) - F.col(e2) * F.col(e2)).alias("_d"))
    lags = list(range(1, h))
    if lags:
        rows = rolling(positions(rows, [order], name="_at"), [], "_at", {f"_d{k}": (F.max("_d"), -k, -k) for k in lags})
    cov = [(1 - k / (h + 1)) * F.covar_samp("_d", f"_d{k}") for k in lags]
    spread = reduce(lambda a, b: a + b, [2 * c for c in cov], F.var_pop("_d"))
    stat = rows.agg((F.avg("_d") / F.sqrt(spread / F.count("_d"))).alias("dm_stat"), F.count("_d").alias("n"))

    def tail(frames):
        for pdf in frames:
            pdf["p_value"] = [math.erfc(abs(x) / math.sqrt(2)) for x in pdf["dm_stat"]]
            yield pdf

    return stat.mapInPandas(tail, "dm_stat double, n long, p_value double")


# --- several classes --------------------------------------------------------

def class_report(df: DataFrame, label: str, predicted: str, classes: Sequence) -> DataFrame:
    """Precision, recall, F1 and support per class from one grouped count."""
    cells = df.groupBy(F.col(label).alias("_y"), F.col(predicted).alias("_p")).agg(F.count(F.lit(1)).alias("_n"))
    parts = F.array(*[F.lit(c) for c in classes])
    per = cells.select(F.explode(parts).alias("class"), "_y", "_p", "_n").groupBy("class").agg(
        F.coalesce(F.sum(F.when((F.col("_y") == F.col("class")) & (F.col("_p") == F.col("class")), F.col("_n"))), F.lit(0)).alias("tp"),
        F.coalesce(F.sum(F.when(F.col("_p") == F.col("class"), F.col("_n"))), F.lit(0)).alias("_pred"),
        F.coalesce(F.sum(F.when(F.col("_y") == F.col("class"), F.col("_n"))), F.lit(0)).alias("support"),
    )
    return per.select(
        "class", "support",
        S.safe_ratio("tp", "_pred").alias("precision"), S.safe_ratio("tp", "support").alias("recall"),
        S.safe_ratio(2 * F.col("tp"), F.col("_pred") + F.col("support")).alias("f1"),
    )


def class_summary(report: DataFrame) -> DataFrame:
    """Accuracy, macro and support-weighted F1."""
    return report.agg(
        (F.sum(F.col("recall") * F.col("support")) / F.sum("support")).alias("accuracy"),
        F.avg("f1").alias("macro_f1"),
        (F.sum(F.col("f1") * F.col("support")) / F.sum("support")).alias("weighted_f1"),
    )


def one_vs_rest_auc(df: DataFrame, label: str, scores: Mapping) -> DataFrame:
    """AUC per class from its score column."""
    cells = [
        F.struct(F.lit(c).alias("class"), S.flag(F.col(label) == c).alias("_y"), F.col(s).cast("double").alias("_s")) for c, s in scores.items()
    ]
    return roc_auc(df.select(F.inline(F.array(*cells))), "_y", "_s", ["class"])


# --- ranking ----------------------------------------------------------------

def ranking_metrics(df: DataFrame, query: str, item: str, label: str, score: str, k: int = 10, per_query: bool = False) -> DataFrame:
    """NDCG@k, precision@k, recall@k and MRR over queries with a positive, ties by item.

    Only the k best rows per query are ranked; the reciprocal rank counts the
    rows ahead of the best positive. No query is gathered as a whole.
    """
    ranked = Window.partitionBy(query).orderBy(F.desc(score), F.asc(item))
    ideal = Window.partitionBy(query).orderBy(F.desc(label), F.asc(item))
    y = _d(label)

    def gains(window: Window, name: str) -> DataFrame:
        best = df.withColumn("_r", F.row_number().over(window)).where(F.col("_r") <= k)
        return best.groupBy(query).agg(F.sum(y / F.log2(F.col("_r") + 1)).alias(name), F.sum(y).alias(f"{name}_hits"))

    totals = df.groupBy(query).agg(
        F.sum(y).alias("_pos"),
        F.max(F.when(F.col(label) == 1, F.col(score))).alias("_best"),
    ).where(F.col("_pos") > 0)
    # among positives with the best score the smallest item comes first
    lead = df.where(F.col(label) == 1).join(totals.select(query, "_best"), query).where(F.col(score) == F.col("_best"))
    lead = lead.groupBy(query).agg(F.min(item).alias("_item"), F.max("_best").alias("_best"))
    ahead = df.join(lead, query).where(
        (F.col(score) > F.col("_best")) | ((F.col(score) == F.col("_best")) & (F.col(item) < F.col("_item")))
    ).groupBy(query).agg(F.count(F.lit(1)).alias("_ahead"))
    per = (
        totals.join(gains(ranked, "_dcg"), query).join(gains(ideal, "_idcg"), query).join(ahead, query, "left")
        .select(
            query,
            S.safe_ratio("_dcg", "_idcg").alias("ndcg"),
            (F.col("_dcg_hits") / k).alias("precision"),
            (F.col("_dcg_hits") / F.col("_pos")).alias("recall"),
            (1 / (F.coalesce(F.col("_ahead"), F.lit(0)) + 1)).alias("mrr"),
        )
    )
    if per_query:
        return per
    return per.agg(*[F.avg(c).alias(c) for c in ("ndcg", "precision", "recall", "mrr")], F.count(F.lit(1)).alias("n_queries"))


# --- calibration ------------------------------------------------------------

def brier(df: DataFrame, label: str, score: str) -> DataFrame:
    gap = F.col(score) - F.col(label)
    return df.agg(F.avg(gap * gap).alias("brier"))


def calibration_table(df: DataFrame, label: str, score: str, bins: int = 10) -> DataFrame:
    """Mean score, positive rate and their gap per equal-width score bin; empty bins are absent."""
    binned = df.withColumn("bin", S.equal_width_bin(score, F.lit(0.0), F.lit(1.0), bins))
    out = binned.groupBy("bin").agg(F.count(F.lit(1)).alias("n"), F.avg(score).alias("mean_score"), F.avg(_d(label)).alias("positive_rate"))
    return out.withColumn("gap", F.abs(F.col("positive_rate") - F.col("mean_score")))


def separation(df: DataFrame, label: str, score: str) -> DataFrame:
    one, zero = F.avg(F.when(F.col(label) == 1, F.col(score))), F.avg(F.when(F.col(label) == 0, F.col(score)))
    return df.agg(one.alias("mean_positive"), zero.alias("mean_negative"), (one - zero).alias("separation"))
