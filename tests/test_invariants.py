"""Properties that must hold on any data: splits, leakage, skew, partition counts, plans."""

import sys

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import audit as A
from ledgerlens.operators import encode as E
from ledgerlens.operators import history as H
from ledgerlens.operators import models as L
from ledgerlens.operators import neighbours as N
from ledgerlens.operators import recommend as RC
from ledgerlens.operators import splits as D
from ledgerlens.operators import ordering
from ledgerlens.operators.ordering import dense_index, positions, row_positions, running
from ledgerlens.plans.catalog import QUERIES


def hot_frame(spark, n=3000):
    """One key holds a third of the rows, one value another third of the values."""
    rng = np.random.default_rng(0)
    key = np.where(np.arange(n) < n // 3, 7, rng.integers(0, 50, n))
    value = np.where(rng.random(n) < 0.33, 5.0, rng.normal(size=n).round(2))
    pdf = pd.DataFrame({"id": np.arange(n), "k": key, "t": rng.integers(0, 400, n), "v": value})
    return pdf, spark.createDataFrame(pdf)


def test_running_measures_match_pandas_on_a_hot_key(spark):
    pdf, df = hot_frame(spark)
    out = running(
        df, ["k"], ["t", "id"],
        {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v")), "low": ("min", F.col("v")), "p": ("previous", F.col("v")), "all": ("total", F.lit(1))},
    ).toPandas().set_index("id").sort_index()
    ordered = pdf.sort_values(["t", "id"])
    g = ordered.groupby("k").v
    want = pd.DataFrame({"id": ordered.id, "n": g.cumcount() + 1, "s": g.cumsum(), "m": g.cummax(), "low": g.cummin(), "p": g.shift(1), "all": g.transform("size")}).set_index("id").sort_index()
    for c in want:
        assert np.allclose(out[c].astype(float), want[c].astype(float), equal_nan=True), c


def test_one_sort_and_slices_agree(spark):
    pdf, df = hot_frame(spark)
    measures = {"n": ("count", F.lit(1)), "s": ("sum", F.col("v")), "m": ("max", F.col("v")), "low": ("min", F.col("v")), "p": ("previous", F.col("v")), "all": ("total", F.lit(1))}
    plain = ordering.in_order(df, ["k"], ["t", "id"], measures)
    cut = ordering.in_order(df, ["k"], ["t", "id"], measures, heavy=100)
    assert [r.k for r in ordering.heavy_keys(df, ["k"], 100).collect()] == [7] and ordering.heavy_keys(df, ["k"]) is None
    a, b = (x.toPandas().sort_values("id").reset_index(drop=True) for x in (plain, cut))
    pd.testing.assert_frame_equal(a, b[a.columns], check_dtype=False)
    text = plain.select("*")._jdf.queryExecution().executedPlan().toString()
    assert text.count("Exchange ") == 1 and text.count("Sort [") == 1 and "Union" not in text


def test_packed_order_is_the_order_of_the_columns(spark):
    rng = np.random.default_rng(3)
    for spread in (1000, 2**45, 2**62):
        rows = [(None if i % 17 == 0 else int(rng.integers(-spread, spread)), int(rng.integers(-5, 5)), i) for i in range(200)]
        df = spark.createDataFrame(rows, "a long, b int, i long")
        got = [r.i for r in df.orderBy(ordering.packed_order(df, ["a", "b", "i"])).collect()]
        assert got == [r.i for r in df.orderBy("a", "b", "i").collect()], spread


def test_velocity_of_null_and_heavy_keys(spark):
    pdf, df = hot_frame(spark, 1500)
    df = df.selectExpr("id", "timestamp_seconds(t * 3600) ts", "v", "case when id % 7 > 0 then k end k", "case when id % 5 > 0 then id % 3 end z")
    rows = [H.velocity(df, "ts", "id", "v", {"card": "k", "mail": "z"}, "1970-01-01", heavy=h).toPandas().sort_values("id").reset_index(drop=True) for h in (1 << 20, 50)]
    pd.testing.assert_frame_equal(*rows)
    want = df.toPandas().sort_values(["ts", "id"])
    for key, name in (("k", "card"), ("z", "mail")):
        want[f"fe_{name}_txn_count"] = want.groupby(key).cumcount().where(want[key].notna())
    want["fe_card_cum_amount"] = want.groupby("k").v.cumsum()
    want = want.sort_values("id").reset_index(drop=True)
    for c in ("fe_card_txn_count", "fe_mail_txn_count", "fe_card_cum_amount"):
        assert np.allclose(rows[0][c].astype(float), want[c].astype(float), equal_nan=True), c


def test_running_descending_and_null_keys(spark):
    df = spark.createDataFrame([(1, None, 5), (2, None, 3), (3, "a", 4)], "id long, k string, t long")
    out = running(df, ["k"], ["t", "id"], {"n": ("count", F.lit(1))}, descending=True).toPandas().set_index("id").n
    assert out.to_dict() == {1: 1, 2: 2, 3: 1}


def test_positions_with_a_hot_score(spark):
    pdf, df = hot_frame(spark)
    out = row_positions(df, "v", "id").toPandas().sort_values("position")
    want = pdf.sort_values(["v", "id"], ascending=[False, True])
    assert out.id.tolist() == want.id.tolist()


def test_dense_index_of_strings_with_shared_prefix(spark):
    names = [f"Customer#{i:05d}" for i in (9, 3, 77, 12, 3)]
    out = dense_index(spark.createDataFrame([(n,) for n in names], "s string"), "s").toPandas().sort_values("index")
    assert out.s.tolist() == sorted(set(names)) and out["index"].tolist() == [0, 1, 2, 3]


def test_results_do_not_depend_on_partitions(spark):
    _, df = hot_frame(spark)
    one = {tuple(r) for r in D.stratified_split(df.repartition(1), "id", "k", 0.2).select("id", "split").collect()}
    many = {tuple(r) for r in D.stratified_split(df.repartition(7), "id", "k", 0.2).select("id", "split").collect()}
    assert one == many
    a = positions(df.repartition(1), ["t", "id"]).orderBy("id").toPandas().position.tolist()
    b = positions(df.repartition(7), ["t", "id"]).orderBy("id").toPandas().position.tolist()
    assert a == b


def test_split_is_complete_and_exact_per_class(spark):
    _, df = hot_frame(spark)
    out = D.stratified_split(df, "id", "k", 0.2, 0.1).toPandas()
    assert len(out) == 3000 and out.id.is_unique
    for _, g in out.groupby("k"):
        held = (g.split != "train").sum()
        assert abs(held - 0.3 * len(g)) <= 1


def test_entity_split_keeps_entities_whole(spark):
    _, df = hot_frame(spark)
    entities = df.select("k").distinct().withColumn("label", F.col("k") % 2)
    out = D.entity_split(df, entities, "k", "label", 0.3).select("k", "split").distinct().toPandas()
    assert out.k.is_unique


def test_folds_are_even(spark):
    _, df = hot_frame(spark)
    sizes = D.stratified_folds(df.withColumn("y", F.col("id") % 3), "id", "y", 5).groupBy("y", "fold").count().toPandas()
    assert sizes["count"].max() - sizes["count"].min() <= 1


def test_fitted_statistics_ignore_val_rows(spark):
    _, df = hot_frame(spark)
    rows = df.withColumn("y", (F.col("v") > 0).cast("int"))
    train = rows.where("t < 300")
    changed = rows.withColumn("v", F.when(F.col("t") >= 300, 1e9).otherwise(F.col("v"))).where("t < 300")
    for fit in (
        lambda d: E.fit_target_rate(d, ["k"], "y", 50),
        lambda d: E.fit_clip(d, ["v"], 0.01, 0.99),
        lambda d: E.fit_medians(d, ["v"]),
        lambda d: E.fit_scale(d, ["v"]),
    ):
        assert sorted(map(tuple, fit(train).collect())) == sorted(map(tuple, fit(changed).collect()))


def test_negatives_are_exact_for_heavy_and_full_customers(spark):
    items = spark.range(30).select(F.col("id").alias("item"))
    rows = [(1, i) for i in range(30)] + [(2, i) for i in range(20)] + [(3, 4)]
    positives = spark.createDataFrame(rows, "c long, item long")
    out = D.negative_pairs(positives, items, "c", "item", 4).toPandas()
    counts = out.groupby("c").item.agg(["size", "nunique"])
    assert 1 not in counts.index
    assert counts.loc[2].tolist() == [10, 10] and counts.loc[3].tolist() == [4, 4]
    assert not set(map(tuple, out[["c", "item"]].values.tolist())) & set(rows)


def test_nearest_matches_brute_force_over_many_blocks(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(400, 3)).round(1)
    x[:130] = x[0]  # a third of all points are equal
    df = spark.createDataFrame([(i, [float(v) for v in r]) for i, r in enumerate(x)], "id long, vec array<double>")
    asks = df.where("id >= 130")
    out = N.nearest(asks, df, "id", "vec", 4, same=True, size=32).toPandas()
    d = np.sqrt(((x[:, None] - x[None]) ** 2).sum(2))
    np.fill_diagonal(d, np.inf)
    for q, g in out.groupby("query"):
        assert len(g) == 4
        assert np.allclose(sorted(g.distance), np.sort(d[q])[:4])


def test_a_part_measures_only_pairs_that_may_count():
    rng = np.random.default_rng(6)
    p = np.concatenate([rng.normal(size=(400, 64)) + 1e5, np.full((9, 64), 1e5), [np.full(64, np.nan)]])
    asks = p[::2] + 0.0
    row, _ = N._candidates(asks - 1e5, p[:-1] - 1e5, 5, None, np.full(len(asks), np.inf))
    assert np.bincount(row, minlength=len(asks)).max() < 20
    limit = np.where(np.arange(len(asks)) % 3 > 0, np.inf, 9.0)
    queries = pd.DataFrame({"_id": np.arange(len(asks)) * 2, "_v": list(asks), "_self": np.arange(len(asks)) % 2 == 0, "_r": limit})
    points = pd.DataFrame({"_id": np.arange(len(p)), "_v": list(p)}).sample(frac=1, random_state=1)
    d = np.sqrt(((asks[:, None] - p[None]) ** 2).sum(axis=2))
    d[queries._self.to_numpy()[:, None] & (queries._id.to_numpy()[:, None] == np.arange(len(p)))] = np.inf
    d[d > limit[:, None]] = np.inf
    want = [(2 * q, int(i), d[q, i]) for q in range(len(asks)) for i in np.argsort(d[q], kind="stable")[:5] if np.isfinite(d[q, i])]
    assert list(N._compare(5)(queries, points).itertuples(index=False, name=None)) == want


def test_negatives_read_their_input_few_times(spark):
    reads = spark.sparkContext.accumulator(0)
    rows = spark.sparkContext.parallelize([(i % 40, i % 97) for i in range(400)], 2)

    def seen(row):
        reads.add(1)
        return row

    trades = spark.createDataFrame(rows.map(seen), "c long, item long")
    items = spark.createDataFrame([(i,) for i in range(120)], "item long")
    out = D.candidate_pairs(trades, items, "c", "item").collect()
    assert len({(r.c, r.item) for r in out}) == len(out) and reads.value <= 800


def test_trades_are_joined_and_texts_split_once(spark, folder, monkeypatch):
    from ledgerlens.plans.catalog import text

    assert "l_orderkey" not in QUERIES["item_features"].run(spark, folder)._jdf.queryExecution().optimizedPlan().toString()
    split, calls = text.X.word_terms, []
    monkeypatch.setattr(text.X, "word_terms", lambda *a, **k: calls.append(1) or split(*a, **k))
    assert QUERIES["combined_features"].run(spark, folder).count() > 0 and len(calls) == 1


def test_pivots_skip_most_parts_of_clustered_points(spark):
    rng = np.random.default_rng(4)
    middles = rng.normal(size=(30, 64)) * 3
    x = middles[np.arange(3000) % 30] + rng.normal(size=(3000, 64)) * 0.3
    df = spark.createDataFrame(pd.DataFrame({"id": np.arange(3000), "v": x.tolist()}))
    asks = df.select(F.col("id").alias("_id"), F.col("v").alias("_v"))
    table = N.pivot_table(asks, 64, 42)
    found = N.search(asks.withColumn("_self", F.lit(True)), table, 5, 64, 42)
    parts, looked = table.parts.count(), found.more.count() + 3000
    assert parts >= 30 and looked < 0.2 * parts * 3000
    out = N.nearest(df, df, "id", "v", 5, same=True, size=64).toPandas().sort_values(["query", "rank"])
    for q in rng.choice(3000, 60, replace=False):
        d = np.sqrt(((x - x[q]) ** 2).sum(axis=1))
        d[q] = np.inf
        assert out[out["query"] == q].neighbour.tolist() == np.argsort(d, kind="stable")[:5].tolist()


def test_pivots_keep_every_point_and_bound_parts(spark):
    rng = np.random.default_rng(8)
    x = np.concatenate([rng.normal(size=(700, 3)), np.ones((500, 3)), np.zeros((1, 3))])
    df = spark.createDataFrame(pd.DataFrame({"_id": np.arange(len(x)), "_v": x.tolist()}))
    table = N.pivot_table(df, 50, 1)
    points = table.points.toPandas()
    assert sorted(points._id) == list(range(len(x))) and points.groupby("_part").size().max() < 120
    (parts,) = table.tables()
    asks = rng.normal(size=(20, 3)) * 2
    least, most = parts.bounds(asks)
    for j, part in enumerate(parts.part):
        own = np.stack(points[points._part == part]._v.to_numpy())
        d = np.sqrt(((asks[:, None] - own[None]) ** 2).sum(axis=2))
        assert (least[:, j] <= d.min(axis=1)).all() and (most[:, j] >= d.max(axis=1)).all()
    assert N.nearest(df.limit(0), df, "_id", "_v", 3).count() == 0 and N.nearest(df, df.limit(0), "_id", "_v", 3).count() == 0


def test_equal_points_find_equal_points(spark):
    df = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(300)], "id long, vec array<double>")
    out = N.nearest(df, df, "id", "vec", 3, same=True, size=32).toPandas()
    assert len(out) == 900 and (out.distance == 0).all() and (out["query"] != out.neighbour).all()


def test_synthetic_rows_lie_between_minority_rows(spark):
    rng = np.random.default_rng(2)
    rows = [(i, int(i < 20), [float(v) for v in rng.normal(size=2)]) for i in range(120)]
    df = spark.createDataFrame(rows, "id long, y int, vec array<double>")
    out = N.smote(df, "id", "y", "vec", ratio=0.5, k=3).toPandas()
    assert len(out) == 30
    points = {i: np.array(v) for i, y, v in rows if y == 1}
    for _, r in out.iterrows():
        a, b, m = points[r.seed_id], points[r.neighbour], np.array(r.vec)
        assert np.isclose(np.linalg.norm(m - a) + np.linalg.norm(b - m), np.linalg.norm(b - a))


def test_svd_scores_match_numpy(spark):
    rng = np.random.default_rng(4)
    matrix = (rng.random((25, 12)) < np.linspace(0.1, 0.9, 12)).astype(float)
    rows = [(int(i), int(j)) for i, j in zip(*np.nonzero(matrix))]
    df = spark.createDataFrame(rows, "c long, item long")
    out = RC.svd_scores(df, df, "c", "item", k=2, iterations=12, oversample=4).toPandas()
    u, s, v = np.linalg.svd(matrix, full_matrices=False)
    best = (u[:, :2] * s[:2]) @ v[:2]
    assert np.allclose(out.svd_score, [best[c, i] for c, i in zip(out.c, out.item)], atol=1e-3)


def test_permutation_keeps_the_values(spark):
    pdf, df = hot_frame(spark, 600)
    out = A.permute_column(df, "v", "id").toPandas().sort_values("id")
    assert sorted(out.v) == sorted(pdf.v) and (out.v.values != pdf.v.values).any()


def test_blend_weights_are_not_negative(spark):
    pdf = pd.DataFrame({"a": np.arange(50.0), "b": -np.arange(50.0) ** 1.5, "y": 2 * np.arange(50.0) + 1})
    wa, wb, intercept = L.blend_weights(spark.createDataFrame(pdf), "a", "b", "y", ridge=1e-6)
    assert wa >= 0 and wb >= 0 and abs(wa - 2) < 1e-3 and abs(intercept - 1) < 1e-2


def test_scaling_keeps_constants(spark):
    df = spark.createDataFrame([(1.0,), (1.0,)], "v double")
    assert [r["v"] for r in E.apply_scale(df, E.fit_scale(df, ["v"]), ["v"]).collect()] == [0.0, 0.0]


def test_plans_have_no_python_and_no_cross_product(spark, folder):
    for name in ("velocity_card", "statement_aggregates", "har_lags", "tfidf", "negatives", "ranking_metrics", "extra_card_aggregates"):
        plan = QUERIES[name].run(spark, folder)._jdf.queryExecution().executedPlan().toString()
        assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan, name
        assert "EvalPython" not in plan and "MapInPandas" not in plan, name


def test_top_rows_are_limited_before_the_shuffle(spark, folder):
    plan = QUERIES["last_n_stats"].run(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan


def test_columns_and_filters_reach_the_scan(spark, folder):
    plan = QUERIES["semi_known"].run(spark, folder)._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(o_orderdate" in plan or "PushedFilters: [IsNotNull(o_orderdate)" in plan
    assert "o_totalprice" not in plan


def test_flag_of_null_is_zero(spark):
    df = spark.createDataFrame([(None,)], "x int")
    assert df.select(S.flag(F.col("x") > 0)).first()[0] == 0


def test_a_shared_value_is_cut_along_the_next_columns(spark):
    rows = spark.range(40_000).select(
        F.when(F.col("id") % 20 == 0, F.col("id")).otherwise(F.lit(7)).alias("v"), F.lit(1).alias("kind"), F.col("id").alias("row"), (F.col("id") % 3).alias("x")
    )
    sliced = ordering.with_slice(rows, ["v", "kind", "row"], 16)
    sizes = [r["count"] for r in sliced.groupBy("_slice").count().collect()]
    assert max(sizes) < 40_000 / 16 * 2.5 and len(sizes) >= 12
    spans = sliced.groupBy("_slice").agg(F.min(F.struct("v", "kind", "row")).alias("a"), F.max(F.struct("v", "kind", "row")).alias("b")).orderBy("_slice").collect()
    assert all(tuple(p.b) < tuple(q.a) for p, q in zip(spans, spans[1:]))
    for down in (False, True):
        got = ordering.running(rows, [], ["v", "kind", "row"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("x"))}, descending=down, slices=16).collect()
        total = 0
        for i, r in enumerate(sorted(got, key=lambda r: (r.v, r.kind, r.row), reverse=down)):
            total += r.x
            assert (r.n, r.s) == (i + 1, total)


def test_many_equal_points_are_taken_by_id(spark):
    rows = [(i, [1.0, 2.0]) for i in range(300)] + [(1000 + i, [float(i), 0.0]) for i in range(20)]
    df = spark.createDataFrame(rows, "vec_id long, v array<double>")
    got = N.nearest(df, df, "vec_id", "v", 3, same=True, size=16).collect()
    by = {}
    for r in sorted(got, key=lambda r: r["rank"]):
        by.setdefault(r.query, []).append(r.neighbour)
    assert by[0] == [1, 2, 3] and by[2] == [0, 1, 3] and all(by[i] == [0, 1, 2] for i in range(3, 300))


def test_grams_of_a_document_in_several_rows_add_up_without_rows_per_gram_in_the_shuffle(spark):
    from ledgerlens.operators import text as X

    rows = spark.createDataFrame([(1, "aB ab\u00a0c"), (2, None), (1, "ab"), (3, "  "), (4, "x")], "doc long, text string")
    terms = X.char_terms(rows, "doc", "text")
    got = {(r.doc, r.term): r.tf for r in terms.collect()}
    word = {" a": 3, "ab": 3, "b ": 3, " ab": 3, "ab ": 3, " ab ": 3}
    assert {t: n for (d, t), n in got.items() if d == 1} == {**word, " c": 1, "c ": 1, " c ": 1}
    assert {t for d, t in got if d == 4} == {" x", "x ", " x "} and {d for d, _ in got} == {1, 4}
    plan = terms._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan and "HashAggregate" not in plan


def test_many_rows_make_more_tasks(spark, monkeypatch):
    monkeypatch.setattr(ordering, "TASK_ROWS", 100)
    rows = spark.range(5000).select((F.col("id") % 50).alias("k"), F.col("id").alias("row"), (F.col("id") % 7).alias("x"))
    for heavy in (1 << 20, 10):
        out = ordering.in_order(rows, ["k"], ["row"], {"n": ("count", F.lit(1)), "s": ("sum", F.col("x"))}, heavy)
        assert out.rdd.getNumPartitions() >= 50
        assert all(r.n == r.row // 50 + 1 and r.s == sum(i % 7 for i in range(r.k, r.row + 1, 50)) for r in out.collect())


def test_ranks_of_several_columns_need_no_join_of_the_wide_rows_per_column(spark):
    rows = spark.createDataFrame(
        [(1, "a", 1.0, 5, 2.0), (2, "a", 1.0, 4, float("nan")), (2, "a", 1.0, 4, float("nan")), (3, "b", None, 4, -0.0), (4, "b", 2.0, None, 0.0), (5, None, 1.0, 1, 1.0)],
        "id int, g string, x double, y int, z double")
    names = {"x": "rx", "y": "ry", "z": "rz"}
    out = ordering.average_ranks(rows, names, ["g"], pct=False)
    assert out.columns == [*rows.columns, *names.values()]
    got = sorted((r.id, r.rx, r.ry, r.rz) for r in out.collect() if r.id != 2)
    assert got == [(1, 2.0, 3.0, 1.0), (3, None, 1.0, 1.5), (4, 1.0, None, 1.5), (5, None, None, None)]
    assert [(r.rx, r.ry, r.rz) for r in out.collect() if r.id == 2] == [(2.0, 1.5, None)] * 2
    joins = out._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert joins <= 2, joins


def test_models_read_rows_that_are_computed_once(spark, monkeypatch):
    from ledgerlens.operators import metrics, recommend

    stored = []
    for module in (L, metrics, recommend):
        real = module.cut_lineage
        monkeypatch.setattr(module, "cut_lineage", lambda df, real=real: stored.append(df.columns) or real(df))
    rows = spark.range(400).select("id", (F.col("id") % 10).cast("double").alias("x"), (F.col("id") % 10 > 4).cast("int").alias("label"))
    L.cross_validate(rows, L.classifier("logistic", ["x"], maxIter=2), "id", k=2).collect()
    assert sum("fold" in c for c in stored) == 1 and sum("pos" in c for c in stored) == 2  # the rows, and each fold's score counts
    stored.clear()
    pairs = spark.createDataFrame([(c, i) for c in range(6) for i in range(5) if (c + i) % 3], "c int, item int")
    recommend.svd_scores(pairs, pairs, "c", "item", k=2, iterations=2, oversample=2).collect()
    assert sum(c[0] == "c" and len(c) == 5 for c in stored) == 1  # the last step serves the products and the scores
    stored.clear()
    recommend.als_scores(pairs, pairs, "c", "item", k=2).collect()
    assert [sorted(c) for c in stored] == [["c", "item"], ["_r", "c"], ["_c", "item"], ["_c", "_r", "rating"]]


@pytest.mark.parametrize("name", ["mllib_ranker", "mllib_models", "mllib_ensemble", "svd_scores", "als_scores", "screening_table", "fraud_table"])
def test_results_stand_on_stored_rows(spark, folder, name, monkeypatch):
    class Stored(Exception):
        pass

    def store(df):
        raise Stored

    fn = QUERIES[name].run.__closure__[0].cell_contents
    monkeypatch.setattr(sys.modules[fn.__module__], "cut_lineage", store)
    with pytest.raises(Stored):
        QUERIES[name].run(spark, folder)


def test_queries_beside_all_points_look_at_few_parts(spark, monkeypatch):
    rng = np.random.default_rng(6)
    p = np.column_stack([rng.uniform(0, 5, 6000), rng.integers(0, 30, 6000), rng.integers(0, 3, 6000), rng.integers(0, 20, 6000) * 4.0])
    q = np.column_stack([rng.uniform(0, 5, 500), rng.integers(0, 30, 500), rng.integers(0, 3, 500), 80 + rng.integers(0, 5, 500) * 4.0])
    points = spark.createDataFrame(pd.DataFrame({"id": np.arange(6000), "v": p.tolist()}))
    asks = spark.createDataFrame(pd.DataFrame({"id": np.arange(1000) + 10_000, "v": [*q.tolist(), *q.tolist()]}))  # each comes twice
    looks, real = [], N._pairwise
    monkeypatch.setattr(N, "_pairwise", lambda asked, points, k: looks.append(asked.count()) or real(asked, points, k))
    out = N.nearest(asks, points, "id", "v", 5, size=64).toPandas().sort_values(["query", "rank"])
    assert sum(looks) < 8 * 500, looks  # of about 100 parts
    got = out.groupby("query").neighbour.agg(list)
    assert len(got) == 1000
    for i in range(500):
        want = np.argsort(np.sqrt(((p - q[i]) ** 2).sum(axis=1)), kind="stable")[:5].tolist()
        assert got[10_000 + i] == want and got[10_500 + i] == want


def test_boxes_take_ties_by_id_and_leave_out_what_is_not_finite(spark):
    nan = float("nan")
    p = [(7, [0.0, 1.0]), (7, [0.0, 1.0]), (3, [0.0, -1.0]), (5, [-0.0, 1.0]), (9, [nan, 1.0]), (8, [None, 1.0]), (4, [6.0, 0.0]), (2, [float("inf"), 0.0])]
    points = spark.createDataFrame(p, "id long, v array<double>")
    asks = spark.createDataFrame([(1, [0.0, 0.0]), (1, [0.0, 0.0]), (2, [-0.0, 1.0]), (6, [nan, 0.0]), (10, [None, 0.0])], "id long, v array<double>")
    rows = lambda q, k: [(r.neighbour, r.distance) for r in N.nearest(asks, points, "id", "v", k, size=2).orderBy("query", "rank").collect() if r["query"] == q]
    assert rows(1, 4) == [(3, 1.0), (3, 1.0), (5, 1.0), (5, 1.0)]  # an id that asks twice finds all twice
    assert rows(2, 3) == [(5, 0.0), (7, 0.0), (7, 0.0)]
    assert len(rows(2, 9)) == 5 and rows(6, 4) == rows(10, 4) == []


def test_leaves_hold_their_points_and_bound_them():
    from ledgerlens.operators.boxes import Boxes

    rng = np.random.default_rng(7)
    x = np.concatenate([rng.normal(size=(600, 3)), rng.integers(0, 2, (300, 3)), np.ones((200, 3))])
    boxes = Boxes(x[::2], 20)
    leaf = boxes.leaf(x)
    parts = sorted(set(leaf))
    boxes.fill(pd.DataFrame({"_part": parts, "_rows": [(leaf == n).sum() for n in parts], "_low": [x[leaf == n].min(axis=0) for n in parts], "_high": [x[leaf == n].max(axis=0) for n in parts]}))
    asks = rng.normal(size=(40, 3)) * 2
    d = np.sqrt(((asks[:, None] - x[None]) ** 2).sum(axis=2))
    kth = np.sort(d, axis=1)[:, 4]
    first, reach = boxes.first(asks, 5)
    assert len(parts) > 30 and boxes.rows[0] == len(x) and (reach >= kth).all() and set(first) <= set(parts)
    query, part = boxes.reached(asks, kth)
    looked = set(zip(query.tolist(), part.tolist()))
    assert all((i, leaf[j]) in looked for i, j in zip(*np.nonzero(d <= kth[:, None]))) and len(looked) < 0.4 * 40 * len(parts)


def test_borrowers_are_stored_before_their_neighbours_are_searched(spark, folder, monkeypatch):
    from ledgerlens.plans import credit
    from ledgerlens.plans.catalog import domains

    stored, real = [], domains.cut_lineage
    monkeypatch.setattr(domains, "cut_lineage", lambda df: stored.append(real(df)) or stored[-1])
    searched, impute = [], credit.impute
    monkeypatch.setattr(credit, "impute", lambda df, *a, **k: searched.append(df) or impute(df, *a, **k))
    QUERIES["credit_imputed"].run(spark, folder)
    assert searched[0] is stored[0]


def brute(x, ids, q, asked, k, same):
    """(query, neighbour, distance) by rank, ties by id."""
    d = np.sqrt(((q[:, None] - x[None]) ** 2).sum(axis=2))
    if same:
        d[asked[:, None] == ids[None, :]] = np.inf
    return {int(a): [(int(ids[j]), float(d[i, j])) for j in np.lexsort((ids, d[i]))[:k] if np.isfinite(d[i, j])] for i, a in enumerate(asked)}


def by_query(out):
    got = {}
    for r in sorted(out.collect(), key=lambda r: (r["query"], r["rank"])):
        got.setdefault(r["query"], []).append((r.neighbour, r.distance))
    return got


def test_vectors_travel_once_a_block_where_all_parts_are_asked_for(spark):
    x = np.random.default_rng(14).normal(size=(2500, 64)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "_id long, _v array<float>")
    table = N.pivot_table(df, 32, 42)
    s = N.search(df.withColumn("_self", F.lit(True)), table, 5, 32, 42)
    asked = sum(int.from_bytes(r._asked).bit_count() for r in s.more.select("_asked").collect())
    blocks = s.more.agg(F.count_distinct("_block")).first()[0]
    assert table.parts.count() > 100 and 5 <= blocks <= 24
    assert s.more.count() <= 2500 * blocks and table.points.join(s.wanted, "_part").count() <= 2500 * 24
    assert asked > 10 * s.more.count()  # each row stands for many parts
    out = N.nearest(df, df, "_id", "_v", 5, same=True, size=32)
    want = brute(x.astype(np.float64), np.arange(2500), x[::50].astype(np.float64), np.arange(2500)[::50], 5, True)
    got = by_query(out)
    assert len(got) == 2500 and all(got[q] == w for q, w in want.items())


@pytest.mark.parametrize("crowded, block, plain", [(64, 1 << 26, 1e15), (0, 1 << 26, 1e15), (64, 1 << 13, 1e15), (64, 1 << 26, 0.0)])
def test_blocks_chunks_and_products_of_either_precision_give_the_same_neighbours(spark, monkeypatch, crowded, block, plain):
    monkeypatch.setattr(N, "CROWDED", crowded), monkeypatch.setattr(N, "BLOCK_BYTES", block), monkeypatch.setattr(N, "PLAIN", plain), monkeypatch.setattr(N, "TILE", 64)
    rng = np.random.default_rng(15)
    x = np.concatenate([rng.integers(0, 2, (300, 20)), rng.normal(size=(300, 20)), rng.normal(size=(100, 20)) * 1e-3 + 1e4]).astype(np.float64)  # ties, no structure, far off
    ids = rng.permutation(700) * 3
    df = spark.createDataFrame([(int(i), v.tolist()) for i, v in zip(ids, x)], "id long, v array<double>")
    assert by_query(N.nearest(df, df, "id", "v", 4, same=True, size=40)) == brute(x, ids, x, ids, 4, True)
    asks = spark.createDataFrame([(i, (x[i] + 0.25).tolist()) for i in range(0, 700, 20)], "id long, v array<double>")  # few queries, not points
    assert by_query(N.nearest(asks, df, "id", "v", 4, size=40)) == brute(x, ids, x[::20] + 0.25, np.arange(0, 700, 20), 4, False)


def test_a_product_in_single_precision_rules_out_no_neighbour():
    rng = np.random.default_rng(16)
    for scale, off in ((1, 0), (1e-25, 0), (1e12, 0), (1, 1e6), (1e160, 0)):
        p, q = rng.normal(size=(200, 30)) * scale + off, rng.normal(size=(50, 30)) * scale + off
        with np.errstate(over="ignore"):
            d = np.sqrt(((q[:, None] - p[None]) ** 2).sum(axis=2))
            limit = np.sort(d, axis=1)[:, 3]
            pairs = N.Tile(p).pairs(q, limit)
        assert pairs is None or set(zip(*np.nonzero(d <= limit[:, None]))) <= set(zip(*pairs))
        assert scale != 1 or off or len(pairs[0]) < 4 * 50 + 20
    assert N.Tile(np.full((3, 2), np.nan)).pairs(np.zeros((1, 2)), np.ones(1)) is None


def test_queries_of_clusters_ask_for_few_blocks_and_parts(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(30, 64))[np.arange(3000) % 30] * 3 + rng.normal(size=(3000, 64)) * 0.3
    df = spark.createDataFrame(pd.DataFrame({"_id": np.arange(3000), "_v": x.tolist()}))
    s = N.search(df.withColumn("_self", F.lit(True)), N.pivot_table(df, 64, 42), 5, 64, 42)
    bits = sum(int.from_bytes(r._asked).bit_count() for r in s.more.select("_asked").collect())
    parts, blocks = s.table.parts.count(), s.wanted.agg(F.count_distinct("_block")).first()[0]
    assert bits + 3000 < 0.2 * parts * 3000 and s.more.count() < 0.6 * blocks * 3000
    assert s.table.points.join(s.wanted, "_part").count() < 3000 * 4


def test_an_id_that_asks_twice_finds_all_twice(spark):
    x = np.random.default_rng(17).normal(size=(60, 20))
    rows = [(i, x[i].tolist()) for i in [*range(60), 7, 7, 8]]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    got = by_query(N.nearest(df, df, "id", "v", 6, same=True, size=8))
    ids = np.array([i for i, _ in rows])
    for q in (7, 8, 9):
        n = int((ids == q).sum())
        d = np.sqrt(((x[q] - x[ids]) ** 2).sum(axis=1))
        want = sorted((float(a), int(i)) for a, i in zip(d, ids) if i != q)
        assert got[q] == [(i, a) for a, i in sorted(want * n)][:6]


def test_adasyn_searches_once_and_seeds_by_the_share_of_majority_neighbours(spark, monkeypatch):
    stored, real = [], N.cut_lineage
    monkeypatch.setattr(N, "cut_lineage", lambda df: stored.append(df.columns) or real(df))
    rng = np.random.default_rng(18)
    x, ids = rng.normal(size=(400, 20)).astype(np.float32), np.arange(400)
    rare = ids % 4 == 0
    df = spark.createDataFrame([(int(i), int(r), v.tolist()) for i, r, v in zip(ids, rare, x)], "id long, y int, v array<float>")
    made = N.adasyn(df, "id", "y", "v", ratio=1.0, k=3)
    assert stored.count(["id", "_hard"]) == 1 and stored.count(["query", "rank", "neighbour"]) == 1  # both are read twice
    x = x.astype(np.float64)
    around, near = brute(x, ids, x[rare], ids[rare], 3, True), brute(x[rare], ids[rare], x[rare], ids[rare], 3, True)
    hard = {q: sum(not rare[i] for i, _ in w) / 3 for q, w in around.items()}
    want = {q: n for q, h in hard.items() if (n := int(np.floor(h / sum(hard.values()) * 200 + 0.5)))}
    rows = made.collect()
    assert {q: sum(r.seed_id == q for r in rows) for q in want} == want and len(rows) == sum(want.values())
    for r in rows:
        a, b, m = x[r.seed_id], x[r.neighbour], np.array(r.v)
        assert r.neighbour in [i for i, _ in near[r.seed_id]] and np.isclose(np.linalg.norm(m - a) + np.linalg.norm(b - m), np.linalg.norm(b - a))


def test_points_are_grouped_by_their_vectors_only_for_queries_that_have_equal_points(spark, monkeypatch):
    calls, real = [], N._equal_points
    monkeypatch.setattr(N, "_equal_points", lambda *a: calls.append(1) or real(*a))
    x = np.random.default_rng(19).normal(size=(90, 20)).round(3)
    points = lambda v: spark.createDataFrame([(i, r.tolist()) for i, r in enumerate(v)], "id long, v array<double>")
    assert by_query(N.nearest(points(x), points(x), "id", "v", 2, same=True, size=16)) == brute(x, np.arange(90), x, np.arange(90), 2, True) and not calls
    x[5:9] = x[4]
    assert by_query(N.nearest(points(x), points(x), "id", "v", 2, same=True, size=16)) == brute(x, np.arange(90), x, np.arange(90), 2, True) and calls
