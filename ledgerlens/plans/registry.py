"""Registry of the checked queries: a Spark form and, where SQL can say it, a SQL form."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

DIGITS = 6


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[SparkSession, str], DataFrame]
    sql: str | None
    operators: str


QUERIES: dict[str, Query] = {}


class Tables:
    """Lazy access to the parquet tables of one folder: ``Tables(spark, d).orders``."""

    def __init__(self, spark: SparkSession, folder: str):
        self._spark, self._folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return self._spark.read.parquet(f"{self._folder}/{name}.parquet")


# ties such as x.xxxxxx5 are pushed to the same side whatever the order of float additions
NUDGE = 1.000000000001


def settle(df: DataFrame) -> DataFrame:
    """Round doubles to some significant digits, so that the order of additions does not show and small values stay."""

    def rounded(name: str):
        x = F.col(f"`{name}`").cast("double") * NUDGE
        size = F.abs(x)
        steps = F.when(size >= 1e6, F.round(x, 2)).when(size >= 1e3, F.round(x, 4)).when(size >= 1e-2, F.round(x, DIGITS))
        steps = steps.when(size >= 1e-5, F.round(x, DIGITS + 3)).otherwise(F.round(x, DIGITS + 5))
        return (steps + F.lit(0.0)).alias(name)

    return df.select(
        *[
            rounded(f.name) if isinstance(f.dataType, (T.DoubleType, T.FloatType)) else F.col(f"`{f.name}`")
            for f in df.schema.fields
        ]
    )


def settled_sql(sql: str, doubles: Sequence[str]) -> str:
    if not doubles:
        return sql

    def rounded(d: str) -> str:
        x = f'CAST("{d}" AS DOUBLE)*CAST({NUDGE} AS DOUBLE)'
        return (
            f'CASE WHEN abs({x})>=1e6 THEN round({x}, 2) WHEN abs({x})>=1e3 THEN round({x}, 4) '
            f"WHEN abs({x})>=1e-2 THEN round({x}, {DIGITS}) WHEN abs({x})>=1e-5 THEN round({x}, {DIGITS + 3}) "
            f'ELSE round({x}, {DIGITS + 5}) END + 0.0::DOUBLE AS "{d}"'
        )

    return f"SELECT * REPLACE ({', '.join(rounded(d) for d in doubles)}) FROM (\n{sql.strip()}\n) AS result"


def query(name: str, operators: str, sql: str | None = None, doubles: str = ""):
    """Register ``fn(tables) -> DataFrame``; ``doubles`` names the float columns of the SQL."""

    def add(fn: Callable[[Tables], DataFrame]):
        def run(spark: SparkSession, folder: str) -> DataFrame:
            return settle(fn(Tables(spark, folder)))

        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = Query(name, run, settled_sql(sql, doubles.split()) if sql else None, operators)
        return fn

    return add
