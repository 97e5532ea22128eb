"""Row-wise cleaning and feature columns. Nothing here shuffles."""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ledgerlens.functions import scalars as S


# --- choosing columns (schema only, no job) ---------------------------------

def numeric_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.NumericType) and f.name not in set(exclude)]


def text_columns(df: DataFrame, exclude: Sequence[str] = ()) -> list[str]:
    return [f.name for f in df.schema.fields if isinstance(f.dataType, T.StringType) and f.name not in set(exclude)]


def group_columns(names: Sequence[str], patterns: Mapping[str, str]) -> dict[str, list[str]]:
    """Names per group; a name belongs to the first pattern it matches in full."""
    groups: dict[str, list[str]] = {g: [] for g in patterns}
    for name in names:
        for group, pattern in patterns.items():
            if re.fullmatch(pattern, name):
                groups[group].append(name)
                break
    return groups


def compare_schemas(before: DataFrame, after: DataFrame) -> dict[str, list[str]]:
    """Kept, new and dropped columns between a raw and an engineered table."""
    old, new = before.columns, after.columns
    return {
        "kept": [c for c in old if c in set(new)],
        "new": [c for c in new if c not in set(old)],
        "dropped": [c for c in old if c not in set(new)],
    }


def align_columns(df: DataFrame, columns: Sequence[str], fill: float = 0.0) -> DataFrame:
    """Exactly these columns: missing ones are filled, extra ones dropped."""
    have = set(df.columns)
    return df.select(*[F.col(c) if c in have else F.lit(fill).alias(c) for c in columns])


def drop_matching(df: DataFrame, patterns: Sequence[str] = (), names: Sequence[str] = (), non_numeric: bool = False, keep: Sequence[str] = ()) -> DataFrame:
    gone = [
        f.name
        for f in df.schema.fields
        if f.name not in set(keep)
        and (
            f.name in set(names)
            or any(re.fullmatch(p, f.name) for p in patterns)
            or (non_numeric and not isinstance(f.dataType, T.NumericType))
        )
    ]
    return df.drop(*gone)


# --- nulls, codes and ranges ------------------------------------------------

def sentinel_to_null(df: DataFrame, columns: Sequence[str], sentinel=-1) -> DataFrame:
    return df.withColumns({c: F.nullif(F.col(c), F.lit(sentinel)) for c in columns})


def clean_codes(df: DataFrame, columns: Sequence[str], codes: Sequence, cap: float, fill: float, unknown: str) -> DataFrame:
    """Codes that mean "unknown" set a flag and become ``fill``; others are capped."""
    any_code = reduce(lambda a, b: a | b, [F.coalesce(F.col(c).isin(*codes), F.lit(False)) for c in columns])
    cleaned = {
        c: F.coalesce(S.clip(F.when(~F.col(c).isin(*codes), F.col(c).cast("double")), None, float(cap)), F.lit(float(fill)))
        for c in columns
    }
    return df.withColumns({unknown: any_code.cast("int"), **cleaned})


def range_to_null(df: DataFrame, column: str, low, high) -> DataFrame:
    return df.withColumn(column, F.when(F.col(column).between(low, high), F.col(column)))


def fill_category(df: DataFrame, columns: Sequence[str], value: str = "unknown") -> DataFrame:
    return df.withColumns({c: F.coalesce(F.col(c), F.lit(value)) for c in columns})


def flag_then_clip(df: DataFrame, column: str, low: float, high: float, over: str) -> DataFrame:
    """Flag values above ``high`` before clipping them away."""
    return df.withColumns({over: S.flag(F.col(column) > high), column: S.clip(column, low, high)})


def missing_flags(df: DataFrame, columns: Sequence[str], prefix: str = "fe_miss_") -> DataFrame:
    return df.withColumns({f"{prefix}{c}": F.col(c).isNull().cast("int") for c in columns})


def floor_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.withColumns({c: S.floor_two(c) for c in columns})


# --- time -------------------------------------------------------------------

def event_time(df: DataFrame, seconds: str, epoch: str, name: str = "event_time") -> DataFrame:
    """Timestamp from seconds after a fixed start."""
    start = F.unix_timestamp(F.lit(epoch).cast("timestamp"))
    return df.withColumn(name, F.timestamp_seconds(start + F.col(seconds)))


def calendar_parts(df: DataFrame, ts: str, epoch: str, prefix: str = "fe_") -> DataFrame:
    """Hour, weekday (Monday 0), weekend, night, cyclical forms and days since ``epoch``."""
    hour, weekday = F.hour(ts), F.weekday(ts)
    hour_sin, hour_cos = S.cyclical(hour, 24)
    dow_sin, dow_cos = S.cyclical(weekday, 7)
    elapsed = F.unix_micros(F.col(ts).cast("timestamp")) - F.unix_micros(F.lit(epoch).cast("timestamp"))
    return df.withColumns(
        {
            f"{prefix}hour": hour,
            f"{prefix}day_of_week": weekday,
            f"{prefix}is_weekend": S.flag(weekday >= 5),
            f"{prefix}is_nighttime": S.flag((hour >= 22) | (hour <= 6)),
            f"{prefix}hour_sin": hour_sin,
            f"{prefix}hour_cos": hour_cos,
            f"{prefix}dow_sin": dow_sin,
            f"{prefix}dow_cos": dow_cos,
            f"{prefix}days_since_start": elapsed / F.lit(86_400_000_000.0),
        }
    )


# --- amounts, flags, composites ---------------------------------------------

def amount_parts(df: DataFrame, amount: str, prefix: str = "fe_") -> DataFrame:
    cents = F.col(amount) % 1
    return df.withColumns(
        {
            f"{prefix}log_amount": F.log1p(amount),
            f"{prefix}amount_cents": cents,
            f"{prefix}amount_is_round": S.flag(cents == 0),
        }
    )


def match_flags(df: DataFrame, columns: Sequence[str], score: str = "fe_match_score") -> DataFrame:
    """T/F/null strings as 1/0/-1, and the number of T."""
    codes = {f"fe_{c.lower()}": F.when(F.col(c) == "T", 1).when(F.col(c) == "F", 0).otherwise(-1) for c in columns}
    hits = reduce(lambda a, b: a + b, [S.flag(F.col(c) == "T") for c in columns])
    return df.withColumns({**codes, score: hits})


def membership_flag(df: DataFrame, column: str, values: Sequence, name: str) -> DataFrame:
    return df.withColumn(name, S.flag(F.col(column).isin(*values)))


def equality_flag(df: DataFrame, a: str, b: str, name: str) -> DataFrame:
    return df.withColumn(name, S.flag(F.col(a) == F.col(b)))


def severity(weights: Mapping[str, float]) -> Column:
    """Weighted sum of counts, nulls as zero."""
    return reduce(lambda a, b: a + b, [F.coalesce(F.col(c).cast("double"), F.lit(0.0)) * w for c, w in weights.items()])


def keep_values(column: str, values: Sequence[str], other: str = "Other") -> Column:
    return F.when(F.col(column).isin(*values), F.col(column)).otherwise(F.lit(other))


def one_hot(df: DataFrame, column: str, values: Sequence[str], prefix: str, other: str | None = "Other") -> DataFrame:
    """0/1 columns for a fixed list of values and one for all the rest."""
    out = {f"{prefix}_{v}": S.flag(F.col(column) == v) for v in values}
    if other:
        out[f"{prefix}_{other}"] = 1 - S.flag(F.col(column).isin(*values))
    return df.withColumns(out)


def search_rows(df: DataFrame, text: str) -> DataFrame:
    """Rows of a small report in which any column contains the text, ignoring case."""
    cells = F.array(*[F.lower(F.col(c).cast("string")) for c in df.columns])
    return df.where(F.exists(cells, lambda x: F.contains(x, F.lit(text.lower()))))


def sparse_columns(train: DataFrame, rate: float = 0.95) -> list[str]:
    """Columns of which more than ``rate`` of the training rows are null, from one pass; none of an empty table."""
    row = train.agg(F.count(F.lit(1)).alias("_n"), *[F.count(F.col(f"`{c}`")).alias(c) for c in train.columns]).first()
    return [c for c in train.columns if row["_n"] and row["_n"] - row[c] > rate * row["_n"]]


def drop_sparse(df: DataFrame, sparse: Sequence[str]) -> DataFrame:
    """Leave out the columns found on the training split."""
    return df.drop(*sparse)


def column_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """Columns that are kept, new and dropped between two frames, in long form."""
    rows = [(kind, c) for kind, names in compare_schemas(before, after).items() for c in names]
    return before.sparkSession.createDataFrame(rows, "kind string, column string")
