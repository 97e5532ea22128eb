"""Semantic rules on literal frames with hand-computed results."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.functions.lexicons import NEGATIVE, POSITIVE
from ledgerlens.operators import columns as C
from ledgerlens.operators import encode as E
from ledgerlens.operators import history as H
from ledgerlens.operators import market as MK
from ledgerlens.operators import metrics as M
from ledgerlens.operators import profile as P
from ledgerlens.operators import text as X
from ledgerlens.operators.ordering import average_rank, exact_quantiles, quantile_table, rolling

VALUES = [(1, 1.0), (2, 2.0), (3, 2.0), (4, None), (5, 10.0)]


@pytest.fixture
def values(spark):
    return spark.createDataFrame(VALUES, "id long, v double")


def test_percent_rank(values):
    rows = {r["id"]: r["p"] for r in average_rank(values, "v", pct="p").collect()}
    assert rows == {1: 0.25, 2: 0.625, 3: 0.625, 4: None, 5: 1.0}


def test_quantiles_interpolate_and_skip_nulls(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, None, 10.0, 1.0)], "v double")
    row = quantile_table(df, {"q1": ("v", 0.25), "q2": ("v", 0.5), "q9": ("v", 0.9)}).first()
    assert (row["q1"], row["q2"]) == (1.0, 2.0)
    assert math.isclose(row["q9"], 6.8)


def test_quantiles_by_group_match_pandas(spark):
    rng = np.random.default_rng(1)
    pdf = pd.DataFrame({"g": rng.integers(0, 3, 500), "v": rng.normal(size=500).round(1)})
    got = exact_quantiles(spark.createDataFrame(pdf), ["v"], [0.0, 0.1, 0.33, 0.99, 1.0], ["g"]).toPandas()
    for _, r in got.iterrows():
        assert math.isclose(r["quantile"], pdf[pdf.g == r["g"]].v.quantile(r["p"]), abs_tol=1e-12)


def test_skew_is_corrected(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, None, 10.0, 1.0)], "v double")
    assert math.isclose(df.agg(S.sample_skew("v")).first()[0], 2.141565, abs_tol=1e-6)


def test_rolling_counts_positions_not_rows(spark):
    df = spark.createDataFrame([(1, 1.0), (2, 2.0), (3, 2.0), (4, None), (5, 10.0)], "t long, v double")
    out = rolling(df, [], "t", {"m": (F.avg("v"), -2, -1)}, width=2).orderBy("t").collect()
    assert [r["m"] for r in out] == [None, 1.0, 1.5, 2.0, 2.0]


def test_rolling_is_the_same_for_any_block_width(spark):
    df = spark.range(200).select("id", (F.col("id") * 7 % 31).cast("double").alias("v"))
    a = {r["id"]: r["m"] for r in rolling(df, [], "id", {"m": (F.sum("v"), -9, 0)}, width=10).collect()}
    b = {r["id"]: r["m"] for r in rolling(df, [], "id", {"m": (F.sum("v"), -9, 0)}, width=1024).collect()}
    assert a == b


def test_last_known_skips_null(spark):
    df = spark.createDataFrame([(5, 10.0), (6, 1.0), (7, None), (4, None)], "t long, v double")
    row = df.agg(S.last_known("v", ["t"]).alias("l"), S.first_known("v", ["t"]).alias("f")).first()
    assert (row["l"], row["f"]) == (1.0, 10.0)


def test_mode_takes_smallest_on_ties(spark):
    df = spark.createDataFrame([(x,) for x in (1.0, 2.0, 2.0, None, 10.0, 1.0)], "v double")
    assert E.fit_modes(df, ["v"]).first()["v"] == 1.0


def test_bins_are_right_closed(spark):
    df = spark.createDataFrame([(0.0,), (1.0,), (1.5,), (2.0,), (3.0,)], "v double")
    out = [r["b"] for r in df.select(S.cut("v", [0, 1, 2], ["a", "b"]).alias("b")).collect()]
    assert out == [None, "a", "b", "b", None]
    left = [r["b"] for r in df.select(S.cut("v", [0, 1, 2], ["a", "b"], right=False).alias("b")).collect()]
    assert left == ["a", "b", "b", None, None]


def test_quantile_bins_match_pandas(spark):
    pdf = pd.DataFrame({"v": [1.0, 1.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0, 7.0, 8.0]})
    df = spark.createDataFrame(pdf)
    got = E.apply_quantile_bins(df, E.fit_quantile_edges(df, "v", 5), "v", "b").orderBy("v").toPandas().b.tolist()
    assert got == pd.qcut(pdf.v, 5, labels=False, duplicates="drop").tolist()


def test_division_by_zero_is_filled(spark):
    df = spark.createDataFrame([(1.0, 0.0), (1.0, 2.0), (None, 1.0)], "a double, b double")
    assert [r[0] for r in df.select(S.safe_ratio("a", "b")).collect()] == [0.0, 0.5, 0.0]


def test_weekday_starts_on_monday(spark):
    df = spark.createDataFrame([("2024-01-01 23:30:00",), ("2024-01-07 07:00:00",)], "s string").select(F.col("s").cast("timestamp").alias("ts"))
    rows = C.calendar_parts(df, "ts", "2024-01-01").orderBy("ts").collect()
    assert [(r["fe_day_of_week"], r["fe_is_weekend"], r["fe_is_nighttime"]) for r in rows] == [(0, 0, 1), (6, 1, 0)]


def test_unknown_comparison_is_zero(spark):
    df = spark.createDataFrame([(None, 1), (1, 1)], "a int, b int")
    assert [r["m"] for r in C.equality_flag(df, "a", "b", "m").collect()] == [0, 1]


def test_codes_are_flagged_capped_and_filled(spark):
    df = spark.createDataFrame([(96, 1), (12, None), (0, 98)], "x int, y int")
    rows = [tuple(r) for r in C.clean_codes(df, ["x", "y"], [96, 98], 10, 0, "u").collect()]
    assert rows == [(0.0, 1.0, 1), (10.0, 0.0, 0), (0.0, 0.0, 1)]


def test_auc_counts_ties_half(spark):
    df = spark.createDataFrame([(1, 0.5), (0, 0.5), (1, 0.9), (0, 0.1)], "label int, score double")
    assert M.roc_auc(df, "label", "score").first()["auc"] == 0.875


def test_auc_equals_pair_count(spark):
    rng = np.random.default_rng(3)
    y, s = rng.integers(0, 2, 300), rng.integers(0, 40, 300) / 40
    wins = [(a > b) + 0.5 * (a == b) for a in s[y == 1] for b in s[y == 0]]
    df = spark.createDataFrame(pd.DataFrame({"label": y, "score": s}))
    assert math.isclose(M.roc_auc(df, "label", "score").first()["auc"], float(np.mean(wins)), abs_tol=1e-12)


def test_one_class_has_no_auc(spark):
    df = spark.createDataFrame([(1, 0.5), (1, 0.9)], "label int, score double")
    assert M.roc_auc(df, "label", "score").first()["auc"] is None


def test_ndcg(spark):
    df = spark.createDataFrame([(1, "a", 1, 0.9), (1, "b", 0, 0.8), (1, "c", 1, 0.1), (2, "a", 0, 0.3)], "q int, i string, label int, score double")
    row = M.ranking_metrics(df, "q", "i", "label", "score").first()
    assert row["n_queries"] == 1 and row["mrr"] == 1.0
    assert math.isclose(row["ndcg"], (1 + 1 / 2) / (1 + 1 / math.log2(3)), rel_tol=1e-12)


def test_capture_rate_takes_whole_rows(spark):
    df = spark.createDataFrame([(i, int(i == 3), 0.5) for i in range(10)], "id long, label int, score double")
    rows = {r["share"]: (r["n_top"], r["capture_rate"]) for r in M.capture_rates(df, "label", "score", "id", [0.04, 0.4]).collect()}
    assert rows == {0.04: (1, 0.0), 0.4: (4, 1.0)}


def test_student_tail():
    assert math.isclose(P.student_p(2.0, 10), 0.073388, abs_tol=1e-6)
    assert math.isclose(P.student_p(-2.0, 10), P.student_p(2.0, 10))


def test_book_aggregate_of_one_and_two_ticks(spark):
    rows = [(1, 1, 0, 10.0, 12.0, 1.0, 1.0), (2, 1, 0, 10.0, 12.0, 1.0, 3.0), (2, 1, 5, 11.0, 13.0, 1.0, 3.0)]
    book = spark.createDataFrame(rows, "stock int, bucket int, sec int, bid_price1 double, ask_price1 double, bid_size1 double, ask_size1 double")
    out = {r["stock"]: r for r in MK.aggregate_book(book, ["stock", "bucket"], ["sec"], second_level=False).collect()}
    assert out[1]["book_rv"] == 0.0 and out[1]["book_n_ticks"] == 1 and out[1]["book_rv_l2"] is None
    assert math.isclose(out[2]["book_rv"], math.log(11.5 / 10.5))


def test_flesch_and_words(spark):
    df = spark.createDataFrame([("The cat sat. It ran!",), ("",)], "t string")
    rows = [r[0] for r in df.select(X.flesch("t")).collect()]
    # the split leaves an empty part after the last mark, as the source counts it
    assert math.isclose(rows[0], 206.835 - 1.015 * (5 / 3) - 84.6 * (5 / 5)) and rows[1] == 0.0


def test_tokens_drop_stopwords_and_short_words(spark):
    df = spark.createDataFrame([("The bank's NET loss is 5 up by ABC-def",)], "t string")
    assert df.select(X.tokens("t")).first()[0] == ["bank's", "net", "loss", "abc", "def"]


def test_lexicon_counts_distinct_words(spark):
    df = spark.createDataFrame([("gain gain loss not good!",)], "t string")
    row = X.lexical_features(df, "t").first()
    assert (row["lm_positive"], row["lm_negative"], row["has_negation"], row["exclamation_count"]) == (1, 1, 1, 1)
    assert len(set(POSITIVE)) == len(POSITIVE) and len(set(NEGATIVE)) == len(NEGATIVE)


def test_char_grams_stay_inside_words(spark):
    df = spark.createDataFrame([(1, "ab c")], "d long, t string")
    terms = {r["term"]: r["tf"] for r in X.char_terms(df, "d", "t").collect()}
    assert terms == {" a": 1, "ab": 1, "b ": 1, " ab": 1, "ab ": 1, " ab ": 1, " c": 1, "c ": 1, " c ": 1}


def test_global_rank_of_unseen_values(spark):
    train = spark.createDataFrame([(1.0,), (2.0,), (2.0,), (4.0,)], "v double")
    new = spark.createDataFrame([(1, 0.5), (2, 2.0), (3, 3.0), (4, 9.0), (5, None)], "id long, v double")
    out = H.apply_global_rank(new, H.fit_global_rank(train, "v"), "id", "v", "r")
    assert {r["id"]: r["r"] for r in out.collect()} == {1: 0.0, 2: 0.25, 3: 0.75, 4: 1.0, 5: 0.5}
    assert P.student_p(None, 10) is None and P.student_p(1.0, -1) is None and P.student_p(None, 0) == 1.0
    assert P.student_p(math.inf, 3) == 0.0


def test_sparse_columns_are_found_on_training_rows(spark):
    df = spark.createDataFrame([(i, None if i else 1.0, None if i % 2 else 1.0) for i in range(40)], "id long, few double, half double")
    assert C.sparse_columns(df, 0.95) == ["few"] and C.sparse_columns(df.limit(0)) == []
    assert C.drop_sparse(df, C.sparse_columns(df)).columns == ["id", "half"]
