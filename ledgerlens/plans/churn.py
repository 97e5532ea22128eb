"""Subscriber churn features of the joined member, payment and listening table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import columns as C
from ledgerlens.operators import encode as E
from ledgerlens.operators import relational as R
from ledgerlens.operators.ordering import only_row, quantile_table

SONGS = ["num_25_mean", "num_50_mean", "num_75_mean", "num_985_mean", "num_100_mean"]


def clean_members(members: DataFrame) -> DataFrame:
    """Ages outside 7..100 are unknown, missing gender is a category."""
    return C.fill_category(C.range_to_null(members, "bd", 7, 100), ["gender"])


def build(train: DataFrame, members: DataFrame, payments: DataFrame, logs: DataFrame, user: str = "msno") -> DataFrame:
    return train.join(members, user, "left").join(payments, user, "left").join(logs, user, "left")


def engagement(df: DataFrame) -> DataFrame:
    """Shares of songs heard to a certain point, variety and time, safe for silent users."""
    have = set(df.columns)
    part = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0)) if c in have else F.lit(0.0)
    songs = F.nullif(sum((part(c) for c in SONGS), F.lit(0.0)), F.lit(0.0))
    share = lambda x: S.clip(F.coalesce(x / songs, F.lit(0.0)), 0.0, 1.0)
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return df.withColumns(
        {
            "fe_completion_rate": share(part("num_100_mean")),
            "fe_skip_rate": share(part("num_25_mean")),
            "fe_deep_listen_rate": share(part("num_75_mean") + part("num_985_mean") + part("num_100_mean")),
            "fe_variety_ratio": F.coalesce(F.col("num_unq_mean") / (songs + 1), F.lit(0.0)),
            "fe_log_secs": F.log1p(zero("total_secs_mean")),
            "fe_log_days_log": F.log1p(F.coalesce(F.col("log_days"), F.lit(0))),
            "fe_secs_per_song": F.coalesce(F.col("total_secs_mean") / (zero("num_unq_mean") + 1), F.lit(0.0)),
        }
    )


def fit(train: DataFrame) -> DataFrame:
    """Medians that fill renewals and ages."""
    return quantile_table(train, {"auto_renew_rate": ("auto_renew_rate", 0.5), "bd": ("bd", 0.5)})


def subscription(df: DataFrame, medians: DataFrame) -> DataFrame:
    row = only_row(medians)
    paid, listed = F.col("actual_paid_mean"), F.col("plan_price_mean")
    return df.withColumns(
        {
            "fe_is_discounted": S.flag(paid < listed),
            "fe_discount_depth": S.clip(S.safe_ratio(listed - paid, listed), 0.0, 1.0),
            "fe_is_long_plan": S.flag(F.col("plan_days_mean") >= 30),
            "fe_plan_days_log": F.log1p(F.coalesce(F.col("plan_days_mean"), F.lit(0.0))),
            "fe_txn_count_log": F.log1p(F.coalesce(F.col("txn_count"), F.lit(0))),
            "fe_auto_renew": F.coalesce(F.col("auto_renew_rate"), row.getField("auto_renew_rate")),
            "fe_cancel_rate": F.coalesce(F.col("cancel_rate"), F.lit(0.0)),
        }
    )


def demographics(df: DataFrame, medians: DataFrame, city_rates: DataFrame, channel_rates: DataFrame, city: str = "city", channel: str = "registered_via") -> DataFrame:
    age = F.coalesce(S.clip(F.col("bd").cast("double"), 7.0, 80.0), only_row(medians).getField("bd"), F.lit(30.0))
    out = df.withColumns(
        {
            "fe_age": age,
            "fe_age_bucket_young": S.flag(age < 25),
            "fe_age_bucket_senior": S.flag(age >= 45),
            "fe_is_male": S.flag(F.col("gender") == "male"),
            "fe_is_female": S.flag(F.col("gender") == "female"),
        }
    )
    out = E.apply_target_rate(out, city_rates, [city], "fe_city_risk")
    return E.apply_target_rate(out, channel_rates, [channel], "fe_reg_channel_risk")


PLAN_DAYS = ([0, 7, 30, 90, 180, 365, 9999], ["<7d", "7-30d", "30-90d", "90-180d", "180-365d", ">365d"])


def rate_by_plan_length(df: DataFrame, target: str) -> DataFrame:
    edges, labels = PLAN_DAYS
    bucket = S.cut(F.coalesce(F.col("plan_days_mean"), F.lit(0.0)), edges, labels)
    return R.rate_by(df, [bucket.alias("plan_bucket")], target)
