"""Greenwashing risk: disclosure sentences joined to company scores."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import columns as C
from ledgerlens.operators import encode as E

PILLARS = "esg"
RISK = {"Low": 0, "Medium": 1, "High": 2}


def company_gaps(df: DataFrame) -> DataFrame:
    """Reported minus assessed score per pillar and on average."""
    gaps = {f"{p}_gap": F.col(f"reported_{p}") - F.col(f"{p}_score") for p in PILLARS}
    return df.withColumns({**gaps, "avg_gap": S.row_mean(list(gaps.values()))})


def risk_label(claim: str | Column, gap: str | Column) -> Column:
    """Tier from the sentence claim and the company gap; no random term."""
    c, g = S.col(claim), S.col(gap)
    claimed = F.when(g > 20, "High").when(g > 8, "Medium").otherwise("Low")
    return F.when(c == 1, claimed).otherwise(F.when(g > 25, "Medium").otherwise("Low"))


def gap_features(df: DataFrame) -> DataFrame:
    raised = [S.clip(f"{p}_gap", 0.0) for p in PILLARS]
    clipped = {f"fe_{p}_gap_clipped": S.clip(f"{p}_gap", 0.0) for p in [*PILLARS, "avg"]}
    return df.withColumns(
        {
            **clipped,
            "fe_gap_cv": S.safe_ratio(F.coalesce(S.row_std(raised), F.lit(0.0)), S.row_mean(raised)),
            "fe_max_gap": S.row_max(raised),
            "fe_composite_delta": S.row_mean([f"reported_{p}" for p in PILLARS]) - F.col("composite_esg"),
        }
    )


def score_features(df: DataFrame) -> DataFrame:
    whole = F.col("composite_esg")
    return df.withColumns(
        {
            "fe_composite_esg": whole,
            "fe_esg_low": S.flag(whole < 40),
            "fe_esg_high": S.flag(whole >= 70),
            **{f"fe_{p}_score_norm": F.col(f"{p}_score") / 100 for p in PILLARS},
        }
    )


def financial_features(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "fe_log_market_cap": S.log1p_from_zero("market_cap_bn"),
            "fe_log_revenue": S.log1p_from_zero("revenue_bn"),
            "fe_log_emissions": S.log1p_from_zero("emissions_intensity"),
            "fe_emissions_high": S.flag(F.col("emissions_intensity") > 500),
        }
    )


def fit_sectors(train: DataFrame, k: int = 8) -> tuple[list[str], DataFrame]:
    """The most frequent sectors and the mean risk code per sector."""
    coded = train.withColumn("_risk", S.map_values("greenwashing_risk", RISK, 0))
    return E.fit_top_values(train, "sector", k), E.fit_target_rate(coded, ["sector"], "_risk")


def sector_features(df: DataFrame, top: Sequence[str], rates: DataFrame) -> DataFrame:
    """One column per frequent sector, and the sector's risk; unseen sectors get the mean over sectors."""
    default = rates.agg(F.avg("rate")).scalar()
    out = C.one_hot(df, "sector", top, "fe_sector")
    return E.lookup(out, rates.select("sector", F.col("rate").alias("fe_sector_risk_te")), ["sector"], {"fe_sector_risk_te": default})


def interactions(df: DataFrame) -> DataFrame:
    return df.withColumns(
        {
            "fe_claim_x_gap": F.col("env_claim_label") * F.col("fe_avg_gap_clipped"),
            "fe_gap_x_emissions": F.col("fe_avg_gap_clipped") * F.col("fe_emissions_high"),
        }
    )


def structured_features(df: DataFrame, top: Sequence[str], rates: DataFrame) -> DataFrame:
    return interactions(sector_features(financial_features(score_features(gap_features(df))), top, rates))
