"""Stock screening: yearly ratios, composites and cohort ranks."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import encode as E
from ledgerlens.operators.ordering import only_row, quantile_table

# Market regime per year, -1 crisis, 0 neutral, 1 bull.
REGIMES = {2018: 0, 2019: 1, 2020: -1, 2021: 1, 2022: -1}


def fit_ratios(train: DataFrame, columns: Sequence[str], p: float = 0.01) -> DataFrame:
    """Clip bounds and median per ratio; one row."""
    wanted = {}
    for c in columns:
        wanted.update({f"{c}__low": (c, p), f"{c}__high": (c, 1 - p), f"{c}__median": (c, 0.5)})
    return quantile_table(train, wanted)


def clip_and_fill(df: DataFrame, stats: DataFrame, columns: Sequence[str]) -> DataFrame:
    row = only_row(stats)
    return df.withColumns(
        {c: F.coalesce(S.clip(F.col(c).cast("double"), row.getField(f"{c}__low"), row.getField(f"{c}__high")), row.getField(f"{c}__median")) for c in columns}
    )


def fit_maxima(train: DataFrame) -> DataFrame:
    return train.agg(F.max("pe_ratio").alias("pe_ratio"), F.max("pb_ratio").alias("pb_ratio"))


def composites(df: DataFrame, maxima: DataFrame) -> DataFrame:
    """Value, growth, quality, profitability and leverage scores."""
    top = only_row(maxima)
    c = F.col
    most = lambda n: F.greatest(top.getField(n), F.lit(1.0))
    growth_scale = F.abs(F.nullif(c("eps_growth"), F.lit(0.0))) * 100 + 1
    cover = F.nullif(F.nullif(c("interest_coverage"), F.lit(0.0)) + 1, F.lit(0.0))
    return df.withColumns(
        {
            "peg_ratio": F.coalesce(S.clip(c("pe_ratio") / growth_scale, -50.0, 50.0), F.lit(0.0)),
            "interest_burden": F.coalesce(1 / cover, F.lit(1.0)),
            "quality_spread": c("roe") - c("debt_equity") * 0.1,
            "value_composite": -(c("pe_ratio") / most("pe_ratio") + c("pb_ratio") / most("pb_ratio")) / 2,
            "growth_composite": S.row_mean(["revenue_growth", "eps_growth"]),
            "profitability_composite": S.row_mean(["roe", "net_margin", "ebitda_margin"]),
            "leverage_risk": c("debt_equity") + c("debt_assets") - c("interest_coverage") * 0.01,
        }
    )


def ranks(df: DataFrame, columns: Sequence[str], year: str = "fiscal_year") -> DataFrame:
    return E.cohort_rank(df, columns, [year])


def regime(df: DataFrame, year: str = "fiscal_year", regimes: dict[int, int] = REGIMES) -> DataFrame:
    code = S.map_values(year, regimes, 0)
    return df.withColumns({"macro_regime": code, "is_crisis_year": S.flag(code == -1), "is_bull_year": S.flag(code == 1)})


def build(train: DataFrame, df: DataFrame, ratios: Sequence[str]) -> DataFrame:
    """All steps, fitted on train and applied to df."""
    stats = fit_ratios(train, ratios)
    fitted = clip_and_fill(train, stats, ratios)
    out = E.apply_ordinal(clip_and_fill(df, stats, ratios), E.fit_ordinal(train, "sector"), "sector", "sector_enc")
    out = composites(out, fit_maxima(fitted))
    return regime(ranks(out, [*ratios, "peg_ratio", "quality_spread", "growth_composite", "profitability_composite"]))
