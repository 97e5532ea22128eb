"""Insurance claim features of a policy table with coded column names."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import columns as C
from ledgerlens.operators import encode as E
from ledgerlens.operators.ordering import only_row

# the first pattern that fits decides the group
GROUPS = {
    "ind_bin": r"ps_ind.*_bin", "ind_cat": r"ps_ind.*_cat", "ind_cont": r"ps_ind.*",
    "reg": r"ps_reg.*",
    "car_bin": r"ps_car.*_bin", "car_cat": r"ps_car.*_cat", "car_cont": r"ps_car.*",
    "calc_bin": r"ps_calc.*_bin", "calc_cont": r"ps_calc.*",
}


def column_groups(df: DataFrame) -> dict[str, list[str]]:
    return C.group_columns(df.columns, GROUPS)


def without_sentinels(df: DataFrame) -> DataFrame:
    """-1 means missing in every policy column."""
    return C.sentinel_to_null(df, [c for c in df.columns if c.startswith("ps_")])


class Fitted:
    """What the training policies decide: flagged, encoded and logged columns and their statistics."""

    def __init__(self, train: DataFrame, target: str, flag_rate: float = 0.01, many_levels: int = 10, skewed: float = 1.0):
        groups = column_groups(train)
        self.groups, self.target = groups, target
        self.medians_for = groups["ind_cont"] + groups["reg"] + groups["car_cont"]
        self.modes_for = groups["ind_cat"] + groups["car_cat"]
        columns = [c for g in groups.values() for c in g]
        row = only_row(train.agg(
            *[F.avg(F.col(c).isNull().cast("double")).alias(f"miss__{c}") for c in columns],
            *[S.sample_skew(F.greatest(F.coalesce(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0))).alias(f"skew__{c}") for c in groups["car_cont"]],
        ))
        levels = only_row(train.agg(*[F.count_distinct(F.col(c)).alias(c) for c in self.modes_for])) if self.modes_for else None
        self.flagged = [c for c in columns if row.value(f"miss__{c}") > flag_rate]
        self.logged = groups["reg"] + [c for c in groups["car_cont"] if (row.value(f"skew__{c}") or 0) > skewed]
        self.encoded = [c for c in self.modes_for if levels.value(c) > many_levels]
        self.medians = E.fit_medians(train, self.medians_for) if self.medians_for else None
        self.modes = E.fit_modes(train, self.modes_for) if self.modes_for else None
        filled = self._fill(train)
        self.rates = {c: E.fit_target_rate(filled, [c], target) for c in self.encoded}

    def _fill(self, df: DataFrame) -> DataFrame:
        out = E.fill_from(df, self.medians, self.medians_for) if self.medians is not None else df
        return E.fill_from(out, self.modes, self.modes_for) if self.modes is not None else out

    def apply(self, df: DataFrame) -> DataFrame:
        out = C.missing_flags(df, self.flagged)
        out = self._fill(out)
        out = C.drop_matching(out, [GROUPS["calc_bin"], GROUPS["calc_cont"]])
        for c, stats in self.rates.items():
            out = E.apply_target_rate(out, stats, [c], f"fe_te_{c}")
        g, flags = self.groups, [f"fe_miss_{c}" for c in self.flagged]
        sums = {"fe_n_missing": flags, "fe_n_bin_ind": g["ind_bin"], "fe_n_bin_car": g["car_bin"], "fe_reg_sum": g["reg"], "fe_ind_cont_sum": g["ind_cont"]}
        out = out.withColumns({n: S.row_sum(cols) for n, cols in sums.items() if cols})
        return interactions(out).withColumns({f"fe_log_{c}": S.log1p_from_zero(c) for c in self.logged})


def interactions(df: DataFrame) -> DataFrame:
    have = set(df.columns)
    v = lambda c: F.coalesce(F.col(c).cast("double"), F.lit(0.0))
    wanted = {
        "fe_car13_reg03": (["ps_car_13", "ps_reg_03"], lambda: v("ps_car_13") * v("ps_reg_03")),
        "fe_ind01_car01_sum": (["ps_ind_01", "ps_car_01"], lambda: v("ps_ind_01") + v("ps_car_01")),
        "fe_miss_x_reg": (["fe_n_missing", "fe_reg_sum"], lambda: v("fe_n_missing") * v("fe_reg_sum")),
        "fe_car13_sq": (["ps_car_13"], lambda: v("ps_car_13") * v("ps_car_13")),
    }
    return df.withColumns({n: make() for n, (needs, make) in wanted.items() if have.issuperset(needs)})


def feature_columns(df: DataFrame, exclude: Sequence[str]) -> list[str]:
    return C.numeric_columns(df, exclude)
