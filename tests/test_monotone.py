"""Isotonic fits against pooling in one pass, and models with directions."""

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.operators import monotone as MO


def pooled(pdf: pd.DataFrame) -> list[tuple]:
    stack = []
    for score, g in pdf.groupby("score"):
        block = [score, score, float(len(g)), float(g.label.sum())]
        while stack and stack[-1][3] * block[2] >= block[3] * stack[-1][2]:
            a = stack.pop()
            block = [a[0], block[1], a[2] + block[2], a[3] + block[3]]
        stack.append(block)
    return [(a, b, y / n, n) for a, b, n, y in stack]


@pytest.mark.parametrize("shape", ["noise", "falling", "rising", "steps"])
def test_isotonic_equals_pooling_in_one_pass(spark, shape):
    rng = np.random.default_rng(len(shape))
    x = rng.random(3000).round(3)
    mean = {"noise": 0.3 + 0 * x, "falling": 1 - x, "rising": x, "steps": (x * 4).astype(int) / 4}[shape]
    pdf = pd.DataFrame({"id": np.arange(3000), "score": x, "label": (rng.random(3000) < mean).astype(float)})
    blocks = MO.fit_isotonic(spark.createDataFrame(pdf), "score", "label")
    got = [tuple(r) for r in blocks.orderBy("low").collect()]
    assert np.allclose(got, pooled(pdf)) and len(got) == len(pooled(pdf))
    asked = pd.DataFrame({"id": np.arange(200), "s": np.append(rng.random(198) * 1.2 - 0.1, [x[0], np.nan])})
    df = spark.createDataFrame(asked).withColumn("s", F.nanvl("s", F.lit(None)))
    out = MO.apply_isotonic(df, blocks, "s", "id").toPandas().sort_values("id")
    ends = [(p, r) for a, b, r, _ in pooled(pdf) for p in (a, b)]
    want = np.interp(asked.s, [p for p, _ in ends], [r for _, r in ends])
    assert np.allclose(out.calibrated[:199], want[:199]) and np.isnan(out.calibrated.iloc[199])


def test_isotonic_of_nothing_and_of_one_score(spark):
    df = spark.createDataFrame([(1, None, 1.0), (2, 0.5, None)], "id long, score double, label double")
    assert MO.fit_isotonic(df, "score", "label").count() == 0
    one = MO.fit_isotonic(df.union(spark.createDataFrame([(3, 0.5, 1.0), (4, 0.5, 0.0)], df.schema)), "score", "label")
    assert [tuple(r) for r in one.collect()] == [(0.5, 0.5, 0.5, 2.0)]


def test_directions_hold_against_the_data(spark):
    """The label falls with a and rises with b; a model told the opposite stays flat, one told the truth follows."""
    rng = np.random.default_rng(2)
    a, b = rng.random(2000), rng.random(2000)
    pdf = pd.DataFrame({"a": a, "b": b, "label": (rng.random(2000) < 0.5 - 0.4 * a + 0.4 * b).astype(float)})
    df = spark.createDataFrame(pdf)
    edges = {"a": [0.25, 0.5, 0.75], "b": [0.25, 0.5, 0.75]}
    for signs in ({"a": -1, "b": 1}, {"a": 1, "b": -1}):
        model = MO.MonotoneModel(df, "label", edges, signs)
        assert all(r.violations == 0 and r.n > 0 for r in model.check(df, signs).collect())
        spread = model.apply(df).agg(F.max("score") - F.min("score")).first()[0]
        assert (spread > 0.3) == (signs["a"] < 0)
