"""Card default: one wide row per customer from up to thirteen statements."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import columns as C
from ledgerlens.operators import encode as E
from ledgerlens.operators import history as H

BATCH = 40


class StatementFeatures:
    """Category statistics and value ranks learned on train, applied to any statements."""

    def __init__(self, train: DataFrame, entity: str, order: Sequence[str], numbers: Sequence[str], categories: Sequence[str] = (), ranked: Sequence[str] = ()):
        self.entity, self.order = entity, list(order)
        self.numbers, self.categories, self.ranked = list(numbers), list(categories), list(ranked)
        denoised = C.floor_columns(train, self.numbers)
        last = self._last_categories(denoised)
        self.shares = {c: E.fit_frequency(last, c) for c in self.categories}
        self.codes = {c: E.fit_ordinal(last, c) for c in self.categories}
        means = denoised.groupBy(entity).agg(*[F.avg(c).alias(c) for c in self.ranked]) if self.ranked else None
        self.ladders = {c: H.fit_global_rank(means, c) for c in self.ranked}

    def _last_categories(self, df: DataFrame) -> DataFrame:
        return df.groupBy(self.entity).agg(*[S.last_known(c, self.order).alias(c) for c in self.categories]) if self.categories else df.select(self.entity).distinct()

    def apply(self, df: DataFrame) -> DataFrame:
        """Blocks of at most ``BATCH`` columns keep each aggregate inside generated code; all are keyed by the entity."""
        rows = C.floor_columns(df, self.numbers)
        out = H.missingness(rows, self.entity, self.order, self.numbers)
        for i in range(0, len(self.numbers), BATCH):
            part = self.numbers[i : i + BATCH]
            out = out.join(H.statement_aggregates(rows, self.entity, self.order, part), self.entity, "left")
            out = out.join(H.recent_statistics(rows, self.entity, self.order, part), self.entity, "left")
        last = self._last_categories(rows)
        for c in self.categories:
            last = E.apply_ordinal(E.apply_frequency(last, self.shares[c], c, f"{c}__freq"), self.codes[c], c, f"{c}__ord")
        out = out.join(last.drop(*self.categories), self.entity, "left")
        for c in self.ranked:
            means = rows.groupBy(self.entity).agg(F.avg(c).alias(c))
            ranks = H.apply_global_rank(means, self.ladders[c], self.entity, c, f"{c}__global_rank").drop(c)
            out = out.join(ranks, self.entity, "left")
            out = out.join(H.own_history_rank(rows, self.entity, self.order, c), self.entity, "left")
        return out
