"""Table profiles: one small row per column, computed in a few passes whatever the width."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence
from functools import reduce

import numpy as np
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.stat import Correlation
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import scalars as S
from ledgerlens.operators.columns import numeric_columns
from ledgerlens.operators.ordering import average_ranks, exact_quantiles, only_row, quantile_table, running

PERCENT = 100.0


def _melt(agg_row: DataFrame, columns: Sequence[str], measures: Mapping[str, str], key: str = "column") -> DataFrame:
    """Turn one wide row ``{measure}__{column}`` into one row per column."""
    parts = [
        F.struct(F.lit(c).alias(key), *[F.col(f"`{m}__{c}`").cast(t).alias(m) for m, t in measures.items()])
        for c in columns
    ]
    return agg_row.select(F.inline(F.array(*parts)))


def cardinality_class(n_unique: Column, n_rows: Column, scale: str = "fine") -> Column:
    """``fine``: up to 10 low, up to 50 medium. ``coarse``: unique, up to 20 low."""
    out = F.when(n_unique == 1, "constant").when(n_unique == 2, "binary")
    if scale == "coarse":
        return out.when(n_unique == n_rows, "unique").when(n_unique <= 20, "low-cardinality").otherwise("high-cardinality")
    return (
        out.when(n_unique <= 10, "low-cardinality").when(n_unique <= 50, "medium-cardinality").otherwise("high-cardinality")
    )


def value_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per (column, value as text), nulls included."""
    cells = [F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("value")) for c in columns]
    return df.select(F.inline(F.array(*cells))).groupBy("column", "value").agg(F.count(F.lit(1)).alias("n"))


def profile_columns(df: DataFrame, columns: Sequence[str] | None = None, scale: str = "fine", samples: int = 3) -> DataFrame:
    """Type, missing count and percent, distinct values, cardinality class, share of the most common value, samples.

    Samples are the first distinct values in text order, so that a profile is
    repeatable.
    """
    columns = list(columns or df.columns)
    counts = value_counts(df, columns)
    first = Window.partitionBy("column").orderBy("value")
    sampled = (
        counts.where(F.col("value").isNotNull())
        .withColumn("_i", F.row_number().over(first))
        .where(F.col("_i") <= samples)
        .groupBy("column")
        .agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_i", "value"))), lambda x: x["value"]), ", ").alias("sample_values"))
    )
    present = F.col("value").isNotNull()
    per = counts.groupBy("column").agg(
        F.sum("n").alias("n_rows"),
        F.coalesce(F.sum(F.when(~present, F.col("n"))), F.lit(0)).alias("n_missing"),
        F.count("value").alias("n_unique"),
        F.coalesce(F.max(F.when(present, F.col("n"))), F.lit(0)).alias("_top"),
    )
    types = {f.name: f.dataType.simpleString() for f in df.schema.fields}
    return per.join(sampled, "column", "left").select(
        "column",
        S.map_values("column", {c: types[c] for c in columns}, "unknown").alias("dtype"),
        "n_missing",
        (PERCENT * F.col("n_missing") / F.col("n_rows")).alias("pct_missing"),
        "n_unique",
        cardinality_class(F.col("n_unique"), F.col("n_rows"), scale).alias("cardinality_type"),
        (F.col("_top") / F.col("n_rows")).alias("top_share"),
        "sample_values",
    )


def numeric_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Rows, nulls, mean, std, min and max per numeric column in one aggregation."""
    columns = list(columns or numeric_columns(df))
    aggs = []
    for c in columns:
        v = F.col(c).cast("double")
        aggs += [
            F.count(F.lit(1)).alias(f"total_rows__{c}"),
            F.count(v).alias(f"non_null__{c}"),
            F.avg(v).alias(f"mean__{c}"),
            F.stddev_samp(v).alias(f"std__{c}"),
            F.min(v).alias(f"min__{c}"),
            F.max(v).alias(f"max__{c}"),
            F.coalesce(S.sample_skew(v), F.lit(0.0)).alias(f"skew__{c}"),
        ]
    wide = df.agg(*aggs)
    kinds = {"total_rows": "long", "non_null": "long", "mean": "double", "std": "double", "min": "double", "max": "double", "skew": "double"}
    out = _melt(wide, columns, kinds)
    missing = F.col("total_rows") - F.col("non_null")
    return out.withColumns(
        {"null_count": missing, "null_pct": PERCENT * missing / F.greatest(F.col("total_rows"), F.lit(1))}
    )


def describe(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Count, mean, std, min, quartiles and max per column."""
    base = numeric_profile(df, columns).select("column", F.col("non_null").alias("count"), "mean", "std", "min", "max")
    long = exact_quantiles(df, columns, [0.25, 0.5, 0.75])
    pick = lambda p: F.max(F.when(F.col("p") == p, F.col("quantile")))
    quarts = long.groupBy("column").agg(pick(0.25).alias("q25"), pick(0.5).alias("q50"), pick(0.75).alias("q75"))
    return base.join(quarts, "column", "left")


def compare_profiles(before: DataFrame, after: DataFrame) -> DataFrame:
    """Ten measures and their change for numeric columns that both tables have."""
    shared = [c for c in numeric_columns(before) if c in set(numeric_columns(after))]
    measures = ["total_rows", "non_null", "null_count", "null_pct", "mean", "std", "min", "median", "max", "skew"]

    def side(df, name):
        medians = exact_quantiles(df, shared, [0.5]).select("column", F.col("quantile").alias("median"))
        full = numeric_profile(df, shared).join(medians, "column", "left")
        return full.select("column", *[F.col(m).cast("double").alias(f"{m}_{name}") for m in measures])

    both = side(before, "before").join(side(after, "after"), "column")
    return both.select("*", *[(F.col(f"{m}_after") - F.col(f"{m}_before")).alias(f"{m}_delta") for m in measures])


def target_distribution(df: DataFrame, target: str) -> DataFrame:
    counts = df.groupBy(target).agg(F.count(F.lit(1)).alias("count"))
    return counts.withColumn("pct", F.round(PERCENT * F.col("count") / F.sum("count").over(Window.partitionBy(F.lit(0))), 3))


def class_balance(df: DataFrame, target: str) -> DataFrame:
    """Totals, positive rate and negatives per positive."""
    hits = F.count_if(F.col(target) == 1)
    rest = F.count_if(F.col(target) == 0)
    return df.agg(
        F.count(F.lit(1)).alias("total"),
        hits.alias("positives"),
        rest.alias("negatives"),
        F.avg(F.col(target).cast("double")).alias("positive_rate"),
        S.safe_ratio(rest, hits, None).alias("imbalance_ratio"),
    )


def table_facts(df: DataFrame) -> DataFrame:
    """Rows, columns, duplicate rows, columns with nulls, columns per kind."""
    fields = df.schema.fields
    missing = reduce(lambda a, b: a + b, [S.flag(F.count(f.name) < F.count(F.lit(1))) for f in fields])
    distinct = df.groupBy(*df.columns).agg(F.count(F.lit(1)).alias("_n"))
    copies = distinct.agg(F.sum(F.col("_n") - 1)).scalar()
    numeric = sum(isinstance(f.dataType, T.NumericType) for f in fields)
    text = sum(isinstance(f.dataType, T.StringType) for f in fields)
    return df.agg(F.count(F.lit(1)).alias("n_rows"), missing.alias("n_missing_columns")).select(
        "n_rows",
        F.lit(len(fields)).alias("n_columns"),
        F.coalesce(copies, F.lit(0)).alias("n_duplicates"),
        "n_missing_columns",
        F.lit(numeric).alias("n_numeric"),
        F.lit(text).alias("n_text"),
        F.lit(len(fields) - numeric - text).alias("n_other"),
    )


def missing_category(pct: Column) -> Column:
    return (
        F.when(pct == 0, "complete").when(pct < 10, "low (<10%)").when(pct < 50, "medium (10-50%)")
        .when(pct < 90, "high (50-90%)").otherwise("extreme (>90%)")
    )


def missing_report(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Missing count, percent and category per column, one pass."""
    columns = list(columns or df.columns)
    wide = df.agg(
        *[F.count_if(F.col(c).isNull()).alias(f"n_missing__{c}") for c in columns],
        *[(PERCENT * F.count_if(F.col(c).isNull()) / F.count(F.lit(1))).alias(f"pct_missing__{c}") for c in columns],
    )
    out = _melt(wide, columns, {"n_missing": "long", "pct_missing": "double"})
    return out.withColumn("category", missing_category(F.col("pct_missing")))


def missing_only(report: DataFrame) -> DataFrame:
    return report.where(F.col("pct_missing") > 0).orderBy(F.desc("pct_missing"), "column")


def missing_categories(report: DataFrame) -> DataFrame:
    return report.groupBy("category").agg(F.count(F.lit(1)).alias("n_columns"))


def group_statistics(report: DataFrame, groups: Mapping[str, Sequence[str]], fields: Mapping[str, str]) -> DataFrame:
    """Columns, mean missing percent and column types per group."""
    group_of = {c: g for g, names in groups.items() for c in names}
    tagged = report.select(
        S.map_values("column", group_of, "other").alias("group"),
        S.map_values("column", dict(fields), "unknown").alias("dtype"),
        "pct_missing",
    )
    return tagged.groupBy("group").agg(
        F.count(F.lit(1)).alias("n_columns"),
        F.avg("pct_missing").alias("mean_missing"),
        F.array_join(F.array_sort(F.collect_set("dtype")), ",").alias("dtypes"),
    )


def missing_by_prefix(report: DataFrame) -> DataFrame:
    """Mean, max, min missing percent per name prefix and columns with none, some, most missing."""
    prefix = F.split_part("column", F.lit("_"), F.lit(1))
    pct = F.col("pct_missing")
    return report.groupBy(prefix.alias("prefix")).agg(
        F.avg(pct).alias("mean_missing"), F.max(pct).alias("max_missing"), F.min(pct).alias("min_missing"),
        F.count_if(pct == 0).alias("n_complete"), F.count_if((pct > 0) & (pct < 50)).alias("n_below_half"),
        F.count_if(pct >= 50).alias("n_half_or_more"),
    )


def missing_by_class(df: DataFrame, target: str, columns: Sequence[str]) -> DataFrame:
    return df.groupBy(target).agg(*[F.avg(F.col(c).isNull().cast("double")).alias(f"{c}_missing") for c in columns])


def prefix_counts(report: DataFrame) -> DataFrame:
    """Columns per name prefix of a column report."""
    return report.groupBy(F.split_part("column", F.lit("_"), F.lit(1)).alias("prefix")).agg(F.count(F.lit(1)).alias("n_columns"))


def iqr_outliers(df: DataFrame, columns: Sequence[str], k: float = 1.5) -> DataFrame:
    """Quartile fences with factor k and the rows outside them, two passes for all columns."""
    wanted = {}
    for c in columns:
        wanted[f"{c}__q1"], wanted[f"{c}__q3"] = (c, 0.25), (c, 0.75)
    row = only_row(quantile_table(df, wanted))
    aggs = []
    for c in columns:
        v, q1, q3 = F.col(c).cast("double"), row.getField(f"{c}__q1"), row.getField(f"{c}__q3")
        lower, upper = q1 - k * (q3 - q1), q3 + k * (q3 - q1)
        out = F.count_if((v < lower) | (v > upper))
        aggs += [
            F.min(v).alias(f"min__{c}"), F.max(v).alias(f"max__{c}"),
            F.first(q1).alias(f"q1__{c}"), F.first(q3).alias(f"q3__{c}"),
            F.first(lower).alias(f"iqr_lower__{c}"), F.first(upper).alias(f"iqr_upper__{c}"),
            out.alias(f"n_outliers__{c}"),
            (PERCENT * out / F.nullif(F.count(v), F.lit(0))).alias(f"pct_outliers__{c}"),
        ]
    kinds = dict.fromkeys(["min", "max", "q1", "q3", "iqr_lower", "iqr_upper"], "double")
    return _melt(df.agg(*aggs), columns, {**kinds, "n_outliers": "long", "pct_outliers": "double"})


def rule_counts(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """Rows that meet each named rule."""
    wide = df.agg(*[F.count_if(rule).alias(f"n__{name}") for name, rule in rules.items()])
    return _melt(wide, list(rules), {"n": "long"}, key="rule")


def target_correlation(df: DataFrame, columns: Sequence[str], target: str, method: str = "pearson", min_rows: int = 2, min_std: float = 0.0) -> DataFrame:
    """Correlation with the target over complete pairs, one pass (pearson) or on average ranks (spearman).

    Columns with too few pairs or hardly any spread are left out.
    """
    if method == "spearman":
        parts = []
        for c in columns:
            pair = df.select(F.col(c).cast("double").alias("_x"), F.col(target).cast("double").alias("_y")).dropna()
            ranked = average_ranks(pair, {"_x": "_rx", "_y": "_ry"}, pct=False)
            parts.append(
                ranked.agg(F.corr("_rx", "_ry").alias("correlation"), F.count(F.lit(1)).alias("n"), F.stddev_samp("_x").alias("_sd"))
                .withColumn("column", F.lit(c))
            )
        out = reduce(DataFrame.unionByName, parts)
    else:
        aggs = []
        y = F.col(target).cast("double")
        for c in columns:
            x = F.when(y.isNotNull(), F.col(c).cast("double"))
            aggs += [F.corr(x, y).alias(f"correlation__{c}"), F.count(x).alias(f"n__{c}"), F.stddev_samp(x).alias(f"_sd__{c}")]
        out = _melt(df.agg(*aggs), columns, {"correlation": "double", "n": "long", "_sd": "double"})
    kept = out.where((F.col("n") >= min_rows) & (F.col("_sd") > min_std))
    return kept.select("column", "correlation", F.abs("correlation").alias("abs_correlation"), "n")


def strong_columns(correlations: DataFrame, bound: float = 0.05) -> DataFrame:
    return correlations.where(F.col("abs_correlation") > bound)


def point_biserial(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Correlation with a 0/1 target and its two-sided p-value.

    The p-value comes from t = r sqrt((n-2)/(1-r^2)); it is a closed-form
    integral on one small row per column, done with Arrow on that result.
    """
    r = target_correlation(df, columns, target)
    t = F.col("correlation") * F.sqrt((F.col("n") - 2) / F.nullif(1 - F.col("correlation") * F.col("correlation"), F.lit(0.0)))
    rows = r.withColumn("t", t)

    def add_p(batches):
        for pdf in batches:
            exact = pdf["abs_correlation"] == 1  # the statistic is infinite
            pdf["p_value"] = [student_p(math.inf if e else t_, n_ - 2) for t_, n_, e in zip(pdf["t"], pdf["n"], exact)]
            yield pdf

    return rows.mapInPandas(add_p, "column string, correlation double, abs_correlation double, n long, t double, p_value double")


def student_p(t: float | None, dof: float) -> float | None:
    """Two-sided tail of Student's t: the density in the angle atan(t/sqrt(dof)) is a power of its cosine.

    Null without a statistic or with under two rows; two rows always lie on a line and say nothing (1).
    """
    if dof == 0:
        return 1.0
    if t is None or math.isnan(t) or dof < 0:
        return None
    if math.isinf(t):
        return 0.0
    start = math.atan(abs(t) / math.sqrt(dof))
    angle = np.linspace(start, min(math.pi / 2, start + 40 / math.sqrt(dof)), 20_001)
    density = np.cos(angle) ** (dof - 1)
    steps = np.full(angle.size, 2.0)
    steps[1::2], steps[0], steps[-1] = 4.0, 1.0, 1.0
    area = float((density * steps).sum() * (angle[1] - angle[0]) / 3)
    whole = math.exp(math.lgamma(0.5) + math.lgamma(dof / 2) - math.lgamma((dof + 1) / 2))
    return min(1.0, 2 * area / whole)


def correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """Long correlation matrix over rows without nulls: a, b, correlation.

    Pearson needs one pass: all products are summed in one aggregation.
    Spearman replaces the values by their average ranks first.
    """
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    if method == "spearman":
        ranked = average_ranks(rows, {c: f"{c}__rank" for c in columns}, pct=False)
        rows = ranked.select(*[F.col(f"{c}__rank").alias(c) for c in columns])
    pairs = [(a, b) for a in columns for b in columns]
    wide = rows.agg(*[F.corr(a, b).alias(f"{i}") for i, (a, b) in enumerate(pairs)])
    cells = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"`{i}`").alias("correlation")) for i, (a, b) in enumerate(pairs)]
    return wide.select(F.inline(F.array(*cells)))


def wide_correlation_matrix(df: DataFrame, columns: Sequence[str], method: str = "pearson") -> DataFrame:
    """The same through MLlib's statistics for wide tables; the matrix is columns x columns."""
    rows = df.select(*[F.col(c).cast("double").alias(c) for c in columns]).dropna()
    vectors = VectorAssembler(inputCols=list(columns), outputCol="v").transform(rows).select("v")
    matrix = Correlation.corr(vectors, "v", method).first()[0].toArray()
    cells = [(a, b, float(matrix[i, j])) for i, a in enumerate(columns) for j, b in enumerate(columns)]
    return df.sparkSession.createDataFrame(cells, "a string, b string, correlation double")


def correlated_pairs(matrix: DataFrame, columns: Sequence[str], bound: float = 0.85) -> DataFrame:
    """Upper-triangle pairs above a bound."""
    place = {c: i for i, c in enumerate(columns)}
    upper = S.map_values("a", place, 0) < S.map_values("b", place, 0)
    return matrix.where(upper & (F.abs("correlation") > bound))


def near_constant(df: DataFrame, columns: Sequence[str], min_std: float = 0.01, max_share: float = 0.99) -> DataFrame:
    """Columns with hardly any spread or one dominating value."""
    shares = profile_columns(df, columns).select("column", "top_share")
    spread = numeric_profile(df, columns).select("column", "std")
    low, dominated = S.flag(F.col("std") < min_std), S.flag(F.col("top_share") > max_share)
    return shares.join(spread, "column").select("column", "std", "top_share", low.alias("is_low_std"), dominated.alias("is_dominated"))


def empirical_cdf(df: DataFrame, column: str) -> DataFrame:
    """Distinct values with the share of rows at or below each."""
    counts = df.where(F.col(column).isNotNull()).groupBy(column).agg(F.count(F.lit(1)).alias("_n"))
    ladder = running(counts, [], [column], {"_upto": ("sum", F.col("_n")), "_of": ("total", F.col("_n"))})
    return ladder.select(F.col(column).alias("value"), (F.col("_upto") / F.col("_of")).alias("cdf"))


def normal_quantiles(df: DataFrame, column: str) -> DataFrame:
    """Sample against normal quantiles on a fixed grid of 99 points.

    The inverse normal needs no data, so its 99 values are literals.
    """
    from statistics import NormalDist

    grid = [i / 100 for i in range(1, 100)]
    standard = {p: NormalDist().inv_cdf(p) for p in grid}
    row = only_row(df.agg(F.avg(column).alias("mean"), F.stddev_samp(column).alias("std")))
    sample = exact_quantiles(df, [column], grid)
    return sample.select(
        "p",
        F.col("quantile").alias("sample"),
        (row.getField("mean") + row.getField("std") * S.map_values("p", standard, 0.0)).alias("theoretical"),
    )


def moments(df: DataFrame, column: str) -> DataFrame:
    """Skewness (biased and corrected), excess kurtosis, mean and the 99th percentile of one column."""
    p99 = only_row(quantile_table(df, {"p99": (column, 0.99)})).getField("p99")
    return df.agg(
        F.skewness(column).alias("skew"), S.sample_skew(column).alias("skew_corrected"),
        F.kurtosis(column).alias("kurtosis"), F.avg(column).alias("mean"),
    ).withColumn("p99", p99)


def panel_facts(df: DataFrame, entity: str, labels: DataFrame, target: str) -> DataFrame:
    """Rows, entities, rows per entity and target rate of an entity history."""
    per = df.groupBy(entity).agg(F.count(F.lit(1)).alias("_n"))
    rate = labels.agg(F.avg(F.col(target).cast("double"))).scalar()
    return per.agg(
        F.sum("_n").alias("n_rows"), F.count(F.lit(1)).alias("n_entities"),
        F.avg("_n").alias("mean_rows"), F.max("_n").alias("max_rows"), F.min("_n").alias("min_rows"),
    ).withColumn("target_rate", rate)


def data_dictionary(tables: Mapping[str, DataFrame]) -> DataFrame:
    """Profiles of several tables stacked, with the table name."""
    parts = [profile_columns(df).withColumn("table", F.lit(name)) for name, df in tables.items()]
    return reduce(DataFrame.unionByName, parts)


INTEGER_RANGES = [("byte", 2**7), ("short", 2**15), ("int", 2**31)]


def narrow_integers(df: DataFrame) -> DataFrame:
    """Cast whole-number columns to the smallest type that holds their range; doubles stay."""
    whole = [f.name for f in df.schema.fields if isinstance(f.dataType, T.IntegralType)]
    if not whole:
        return df
    row = only_row(df.agg(*[F.min(c).alias(f"{c}__min") for c in whole], *[F.max(c).alias(f"{c}__max") for c in whole]))
    casts = {}
    for c in whole:
        low, high = row.value(f"{c}__min"), row.value(f"{c}__max")
        fits = next((t for t, bound in INTEGER_RANGES if low is not None and -bound <= low and high < bound), None)
        if fits:
            casts[c] = F.col(c).cast(fits)
    return df.withColumns(casts) if casts else df


def category_values(df: DataFrame, columns: Sequence[str], most: int = 10) -> DataFrame:
    """Number of different values of each column, and the first of them in order."""
    pieces = F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).cast("string").alias("v")) for c in columns])).alias("x")
    values = df.select(pieces).select("x.*").where("v is not null").distinct()
    place = F.row_number().over(Window.partitionBy("column").orderBy("v"))
    first = values.withColumn("_i", place).where(F.col("_i") <= most)  # Spark keeps so many a task before the shuffle
    sizes = values.groupBy("column").agg(F.count(F.lit(1)).alias("n_values"))
    listed = first.groupBy("column").agg(F.array_join(F.array_sort(F.collect_list("v")), ", ").alias("values"))
    return sizes.join(listed, "column")
