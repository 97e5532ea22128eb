"""Credit default features of a borrower table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import columns as C
from ledgerlens.operators.neighbours import knn_impute
from ledgerlens.operators.ordering import only_row, quantile_table

LATE = ["DPD_30_59", "DPD_60_89", "DPD_90plus"]
UNKNOWN_CODES = [96, 98]
NEAR = ["DebtRatio", "NumOpenLoans", "NumRealEstate", "age", "NumDependents"]


def clean(df: DataFrame) -> DataFrame:
    """Unknown-code flag, late counts capped at 10, utilisation flag and clip."""
    out = C.clean_codes(df, LATE, UNKNOWN_CODES, cap=10, fill=0, unknown="fe_dpd_unknown")
    return C.flag_then_clip(out, "RevolvingUtil", 0.0, 1.0, "fe_over_limit")


def fit(train: DataFrame) -> DataFrame:
    """Upper caps at the 99.9th percentile."""
    return quantile_table(train, {"DebtRatio": ("DebtRatio", 0.999), "MonthlyIncome": ("MonthlyIncome", 0.999)})


def impute(df: DataFrame, unique_id: str, train: DataFrame | None = None, k: int = 5) -> DataFrame:
    """Missing flags, dependents 0, income from the nearest borrowers."""
    out = C.missing_flags(df, ["MonthlyIncome", "NumDependents"])
    out = out.withColumnsRenamed({"fe_miss_MonthlyIncome": "fe_miss_income", "fe_miss_NumDependents": "fe_miss_dependents"})
    out = out.withColumn("NumDependents", F.coalesce(F.col("NumDependents").cast("double"), F.lit(0.0)))
    donors = None if train is None else train.withColumn("NumDependents", F.coalesce(F.col("NumDependents").cast("double"), F.lit(0.0)))
    return knn_impute(out, unique_id, "MonthlyIncome", NEAR, k, fit=donors)


def features(df: DataFrame, caps: DataFrame) -> DataFrame:
    """Capped amounts, logs, lateness, age and utilisation features of cleaned and filled rows."""
    cap = only_row(caps)
    out = df.withColumns({c: S.clip(F.col(c).cast("double"), 0.0, cap.getField(c)) for c in ("DebtRatio", "MonthlyIncome")})
    age = S.clip(F.col("age").cast("double"), 18.0, 100.0)
    late = S.row_sum(LATE)
    util, debt, income = F.col("RevolvingUtil"), F.col("DebtRatio"), F.col("MonthlyIncome")
    return out.withColumns(
        {
            "fe_log_MonthlyIncome": F.log1p(income),
            "fe_log_DebtRatio": F.log1p(debt),
            "fe_total_dpd": late,
            "fe_dpd_severity": C.severity({LATE[0]: 1, LATE[1]: 2, LATE[2]: 3}),
            "fe_any_delinquency": S.flag(late > 0),
            "fe_chronic_default": S.flag(F.col(LATE[2]) >= 2),
            "fe_age_sq": age * age,
            "fe_prime_earner": S.flag((age >= 35) & (age <= 55)),
            "fe_senior": S.flag(age >= 65),
            "fe_young": S.flag(age < 30),
            "fe_age_bucket": S.cut(age, [0, 30, 40, 50, 60, 70, 200], [0, 1, 2, 3, 4, 5], right=False),
            "fe_util_sq": util * util,
            "fe_high_util": S.flag(util > 0.75),
            "fe_zero_util": S.flag(util == 0),
            "fe_dti_proxy": S.clip(debt * income, None, cap.getField("DebtRatio") * cap.getField("MonthlyIncome")),
            "fe_income_per_dep": income / (F.coalesce(F.col("NumDependents"), F.lit(0)) + 1),
            "fe_loans_per_estate": F.col("NumOpenLoans") / (F.col("NumRealEstate") + 1),
            "fe_util_x_dpd": util * late,
        }
    )
