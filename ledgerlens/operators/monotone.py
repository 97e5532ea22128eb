"""Monotone fits: isotonic regression in slices, and a logistic model that a feature can only raise (or lower)."""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence

import pandas as pd
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import Matrices
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.operators.ordering import assign_slices, running, slice_count, slice_edges
from ledgerlens.session import cut_lineage

BLOCK = "low double, high double, n double, y double"


def _pool(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Pool adjacent violators within each slice; rows come in the order of slice and score."""
    current, stack = None, []

    def flush() -> pd.DataFrame:
        return pd.DataFrame(stack, columns=["low", "high", "n", "y"])

    for pdf in frames:
        for place, low, high, n, y in zip(*(pdf[c].tolist() for c in ("_place", "low", "high", "n", "y"))):
            if place != current:
                if stack:
                    yield flush()
                current, stack = place, []
            while stack and stack[-1][3] * n >= y * stack[-1][2]:  # the mean before is not below this one
                before = stack.pop()
                low, n, y = before[0], n + before[2], y + before[3]
            stack.append((low, high, n, y))
    if stack:
        yield flush()


def fit_isotonic(df: DataFrame, score: str, label: str, weight: str | None = None) -> DataFrame:
    """Blocks of the best nondecreasing fit of the label's mean over the score: low, high, rate, n.

    Scores are counted first. Violators are pooled within slices of the score, all slices at once; what then violates
    lies at the edges of slices, so slices are moved by half and joined to wider ones until no edge does. Pooling in
    parts gives the same fit as pooling in one pass. Rows without score or label are left out.
    """
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    known = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    points = known.groupBy(F.col(score).cast("double").alias("low")).agg(F.sum(w).alias("n"), F.sum(w * F.col(label).cast("double")).alias("y"))
    blocks = cut_lineage(points.where(F.col("n") > 0).select("low", F.col("low").alias("high"), "n", "y"))
    pieces = 2 * slice_count(df)
    edges = slice_edges(blocks, {"low": F.col("low")}, pieces)
    width = 2
    while True:
        for shift in (0, width // 2):
            cut = assign_slices(blocks, {"low": "_piece"}, edges).withColumn("_place", F.floor((F.col("_piece") + shift) / width).cast("int"))
            sorted_ = cut.repartition("_place").sortWithinPartitions("_place", "low")
            blocks = cut_lineage(sorted_.select("_place", "low", "high", "n", "y").mapInPandas(_pool, BLOCK))
            if not _violations(blocks, edges):
                return blocks.select("low", "high", (F.col("y") / F.col("n")).alias("rate"), "n")
        width *= 2


def _violations(blocks: DataFrame, edges: Mapping[str, list[float]]) -> int:
    """Pieces whose first block lies below the last one before it; a row a piece reaches the driver."""
    mean = F.col("y") / F.col("n")
    rows = assign_slices(blocks, {"low": "_piece"}, edges).groupBy("_piece").agg(
        F.min_by(mean, "low").alias("first"), F.max_by(mean, "low").alias("last")
    ).orderBy("_piece").collect()
    return sum(a.last >= b.first for a, b in zip(rows, rows[1:]))


def apply_isotonic(df: DataFrame, blocks: DataFrame, score: str, unique_id: str, name: str = "calibrated") -> DataFrame:
    """The block's rate, between blocks a straight line, beyond the ends the end rates; null scores stay null.

    Block ends and rows are merged in one order; what lies before and behind a row are running maxima and minima, as
    rates never fall.
    """
    ends = F.array(*[F.struct(F.lit(i).alias("_kind"), F.col(c).alias("_x"), F.col("rate").alias("_v")) for i, c in ((0, "low"), (1, "high"))])
    marks = blocks.select(F.inline(ends))
    asked = df.where(F.col(score).isNotNull()).select(unique_id, F.col(score).cast("double").alias("_s"))
    rows = asked.select("_s", F.lit(None).cast("double").alias("_x"), F.lit(None).cast("double").alias("_v"), F.lit(2).alias("_kind"), unique_id)
    marks = marks.select(F.col("_x").alias("_s"), "_x", "_v", "_kind", F.lit(None).cast(df.schema[unique_id].dataType).alias(unique_id))
    up = running(marks.unionByName(rows), [], ["_s", "_kind", unique_id], {"_px": ("max", F.col("_x")), "_pv": ("max", F.col("_v"))})
    # from above, marks of a score must come before its rows
    turned = up.withColumn("_back", -F.col("_kind"))
    down = running(turned, [], ["_s", "_back", unique_id], {"_nx": ("min", F.col("_x")), "_nv": ("min", F.col("_v"))}, descending=True)
    part = (F.col("_s") - F.col("_px")) / (F.col("_nx") - F.col("_px"))
    line = F.when(F.col("_px").isNull(), F.col("_nv")).when(F.col("_nx").isNull() | (F.col("_nx") <= F.col("_px")), F.col("_pv"))
    value = line.otherwise(F.col("_pv") + (F.col("_nv") - F.col("_pv")) * part)
    found = down.where("_kind = 2").select(unique_id, value.alias(name))
    return df.join(found, unique_id, "left").select(*df.columns, name)


# --- logistic model with directions ------------------------------------------

def steps(column: str, edges: Sequence[float]) -> dict[str, Column]:
    """Cumulative bins: one indicator per edge, 1 above it; a missing value is above none."""
    return {f"_{column}_{i}": F.coalesce((F.col(column) > e).cast("double"), F.lit(0.0)) for i, e in enumerate(edges)}


class MonotoneModel:
    """Logistic regression on cumulative bins whose coefficients have a sign: +1 raises the score, -1 lowers it, 0 is free."""

    def __init__(self, train: DataFrame, label: str, edges: Mapping[str, Sequence[float]], directions: Mapping[str, int], reg: float = 0.0):
        self.edges = {c: list(e) for c, e in edges.items()}
        names, low, high = [], [], []
        for c, e in self.edges.items():
            d = directions.get(c, 0)
            names += list(steps(c, e))
            low += [0.0 if d > 0 else float("-inf")] * len(e)
            high += [0.0 if d < 0 else float("inf")] * len(e)
        fit = LogisticRegression(featuresCol="_steps", labelCol=label, regParam=reg, standardization=False, probabilityCol="_p", rawPredictionCol="_raw", predictionCol="_class")
        fit.setLowerBoundsOnCoefficients(Matrices.dense(1, len(low), low)).setUpperBoundsOnCoefficients(Matrices.dense(1, len(high), high))
        stages = [VectorAssembler(inputCols=names, outputCol="_steps"), fit]
        self.model: PipelineModel = Pipeline(stages=stages).fit(self._with_steps(train))

    def _with_steps(self, df: DataFrame) -> DataFrame:
        return df.withColumns({n: x for c, e in self.edges.items() for n, x in steps(c, e).items()})

    def apply(self, df: DataFrame, name: str = "score") -> DataFrame:
        out = self.model.transform(self._with_steps(df))
        return out.select(*df.columns, vector_to_array("_p")[1].alias(name))

    def check(self, df: DataFrame, directions: Mapping[str, int]) -> DataFrame:
        """Per feature with a direction: rows whose value could rise to the next edge, and how many scores then go the wrong way."""
        out = None
        for c, d in directions.items():
            if not d:
                continue
            above = F.array(*[F.lit(float(e)) for e in self.edges[c]])
            next_ = F.array_min(F.filter(above, lambda e: e >= F.coalesce(F.col(c).cast("double"), F.lit(float("-inf")))))  # noqa: B023
            pair = self.apply(df.where(next_.isNotNull()).withColumn("_next", next_), "_now")
            moved = self.apply(pair.withColumn(c, F.col("_next") + 1e-9 * (1 + F.abs("_next"))), "_then")
            wrong = (F.col("_then") - F.col("_now")) * d < -1e-12
            row = moved.agg(F.count(F.lit(1)).alias("n"), F.count_if(wrong).alias("violations")).select(F.lit(c).alias("feature"), "n", "violations")
            out = row if out is None else out.unionByName(row)
        return out
