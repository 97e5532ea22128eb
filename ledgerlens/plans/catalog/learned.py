"""Neighbours, projections and MLlib models on the whole tables."""

from pyspark.ml import Pipeline
from pyspark.ml.feature import SQLTransformer
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import models as L
from ledgerlens.operators import monotone as MO
from ledgerlens.operators import neighbours as N
from ledgerlens.operators import splits as D
from ledgerlens.operators import text as X
from ledgerlens.operators.metrics import roc_auc
from ledgerlens.plans.catalog.market import small_panel
from ledgerlens.plans.catalog.scores import SCORED, scored
from ledgerlens.plans.registry import query
from ledgerlens.session import cut_lineage


@query("nearest_neighbours", "D12 I3", """
WITH e AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), d AS (SELECT a.vec_id AS query, b.vec_id AS neighbour, list_distance(a.v, b.v) AS distance FROM e a, e b WHERE a.vec_id<>b.vec_id)
SELECT query, neighbour, distance, CAST(i AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY distance, neighbour) i FROM d) WHERE i<=5""", "distance")
def nearest_neighbours(t):
    rows = t.embeddings
    return N.nearest(rows, rows, "vec_id", "embedding", 5, same=True)


@query("knn_impute", "I3", """
WITH r AS (SELECT c_custkey, CASE WHEN c_mktsegment<>'BUILDING' THEN c_acctbal END AS y, c_custkey::DOUBLE AS a, sqrt(c_nationkey)*3.1 AS b FROM customer),
n AS (SELECT q.c_custkey, p.y, sqrt((q.a-p.a)**2+(q.b-p.b)**2) AS d, row_number() OVER (PARTITION BY q.c_custkey ORDER BY sqrt((q.a-p.a)**2+(q.b-p.b)**2), p.c_custkey) AS i FROM r q, r p WHERE q.y IS NULL AND p.y IS NOT NULL),
f AS (SELECT c_custkey, coalesce(avg(y) FILTER (d=0), sum(y/nullif(d,0))/sum(1/nullif(d,0))) AS y FROM n WHERE i<=5 GROUP BY 1)
SELECT c_custkey, coalesce(r.y, f.y) AS balance FROM r LEFT JOIN f USING (c_custkey)""", "balance")
def knn_impute(t):
    rows = t.customer.select(
        "c_custkey", F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_acctbal")).alias("balance"),
        F.col("c_custkey").cast("double").alias("a"), (F.sqrt("c_nationkey") * 3.1).alias("b"))
    return N.knn_impute(rows, "c_custkey", "balance", ["a", "b"]).select("c_custkey", "balance")


def labelled_vectors(t):
    return t.embeddings.select("vec_id", "embedding", S.flag(F.col("label") == 0).alias("label"))


def _summary(rows, vector="embedding"):
    total = F.aggregate(vector, F.lit(0.0), lambda a, x: a + x)
    return rows.select("seed_id", "neighbour", "copy", total.alias("total"))


@query("smote", "D12")
def smote(t):
    return _summary(N.smote(labelled_vectors(t), "vec_id", "label", "embedding", ratio=1.0))


@query("adasyn", "D12")
def adasyn(t):
    return _summary(N.adasyn(labelled_vectors(t), "vec_id", "label", "embedding", ratio=1.0))


@query("pca", "Z2")
def pca(t):
    rows = L.as_vector(t.embeddings, "embedding")
    out = L.apply_pca(L.fit_pca(rows, "embedding", 10), rows)
    return out.drop("embedding")


@query("isotonic", "Z4 M16", f"""
WITH {SCORED}, p AS (SELECT row_number() OVER (ORDER BY score) AS i, score, sum(count(*)) OVER (ORDER BY score) AS cn, sum(sum(label)) OVER (ORDER BY score) AS cy, count(*) AS n, sum(label) AS y
  FROM scored WHERE o_orderkey % 5 > 0 GROUP BY score),
m AS (SELECT a.i AS a, b.i AS b, (b.cy-a.cy+a.y)*1.0/(b.cn-a.cn+a.n) AS mean FROM p a JOIN p b ON a.i<=b.i),
g AS (SELECT a, b AS i, min(mean) OVER (PARTITION BY a ORDER BY b DESC) AS low FROM m),
f AS (SELECT score, max(low) AS v FROM g JOIN p USING (i) GROUP BY score),
v AS (SELECT * FROM scored WHERE o_orderkey % 5 = 0)
SELECT v.o_orderkey, v.score, CASE WHEN l.score IS NULL THEN h.v WHEN h.score IS NULL OR h.score=l.score THEN l.v ELSE l.v+(h.v-l.v)*(v.score-l.score)/(h.score-l.score) END AS calibrated
FROM v ASOF LEFT JOIN f l ON v.score>=l.score ASOF LEFT JOIN f h ON v.score<=h.score""", "score calibrated")
def isotonic(t):
    """Fitted on four fifths of the orders, applied to the others."""
    rows = scored(t).select("o_orderkey", "label", "score")
    blocks = MO.fit_isotonic(rows.where("o_orderkey % 5 > 0"), "score", "label")
    return MO.apply_isotonic(rows.where("o_orderkey % 5 = 0"), blocks, "score", "o_orderkey").select("o_orderkey", "score", "calibrated")


EDGES = [30_000.0 * i for i in range(1, 12)]


@query("monotone_scores", "L18", f"""
SELECT 'o_totalprice' AS feature, count(*) AS n, CAST(0 AS BIGINT) AS violations FROM orders WHERE o_totalprice <= {EDGES[-1]} UNION ALL
SELECT 'month', count(*), 0 FROM orders WHERE month(o_orderdate) <= 9""")
def monotone_scores(t):
    """A fitted model whose score never falls with the price and never rises with the month, row by row."""
    rows = t.orders.select("o_totalprice", F.month("o_orderdate").alias("month"), S.flag(F.col("o_orderstatus") == "F").cast("double").alias("label"))
    directions = {"o_totalprice": 1, "month": -1}
    model = MO.MonotoneModel(rows, "label", {"o_totalprice": EDGES, "month": [3.0, 6.0, 9.0]}, directions)
    return model.check(rows, directions)


@query("linear_scores", "L6 L17", """
WITH r AS (SELECT o_orderkey, epoch_us(o_orderdate)/86400000000.0 AS x, o_totalprice AS y FROM orders), f AS (SELECT regr_slope(y,x) AS b, regr_intercept(y,x) AS a FROM r WHERE o_orderkey % 5 > 0)
SELECT o_orderkey, a+b*x AS score FROM r, f WHERE o_orderkey % 5 = 0""", "score")
def linear_scores(t):
    """A least-squares line fitted on four fifths of the orders, applied to the others."""
    days = (F.unix_micros(F.col("o_orderdate").cast("timestamp")) / F.lit(86_400_000_000.0)).alias("x")
    rows = t.orders.select("o_orderkey", days, F.col("o_totalprice").alias("y"))
    model = L.regressor("linear", ["x"], "y", solver="normal").fit(rows.where("o_orderkey % 5 > 0"))
    return L.score_table(model, rows.where("o_orderkey % 5 = 0"), ["o_orderkey"])


@query("forest_scores", "L3 L17", """
WITH r AS (SELECT o_orderkey, o_totalprice, o_orderpriority='1-URGENT' AS urgent, month(o_orderdate) > 6 AS late FROM orders), g AS (SELECT urgent, late, avg(o_totalprice) AS score FROM r GROUP BY ALL)
SELECT o_orderkey, score FROM r JOIN g USING (urgent, late)""", "score")
def forest_scores(t):
    """On two flags a whole tree of depth two ends in the four cells, whose means are its scores."""
    rows = t.orders.select(
        "o_orderkey", "o_totalprice", S.flag(F.col("o_orderpriority") == "1-URGENT").alias("urgent"), S.flag(F.month("o_orderdate") > 6).alias("late"))
    model = L.regressor("forest", ["urgent", "late"], "o_totalprice", numTrees=1, maxDepth=2, bootstrap=False, featureSubsetStrategy="all")
    return L.score_table(model.fit(rows), rows, ["o_orderkey"])


@query("fold_metrics", "L12 L13 M1 M2 M3", f"""
WITH {SCORED}, f AS (SELECT CAST(o_orderkey % 3 AS INTEGER) AS fold, label, score FROM scored),
c AS (SELECT fold, score, count(*) FILTER (label=1) AS pos, count(*) FILTER (label=0) AS neg FROM f GROUP BY 1,2),
w AS (SELECT *, sum(pos) OVER d AS tp, sum(neg) OVER d AS fp, sum(pos) OVER (PARTITION BY fold) AS p, sum(neg) OVER (PARTITION BY fold) AS n FROM c WINDOW d AS (PARTITION BY fold ORDER BY score DESC)),
e AS (SELECT fold, sum(pos*(n-fp)+pos*neg/2.0)/max(p*n*1.0) AS auc, sum(pos*1.0/p*tp/(tp+fp)) AS average_precision,
  sum(pos) FILTER (score>=0.5)*1.0 AS tp, sum(neg) FILTER (score>=0.5)*1.0 AS fp, max(p) AS p, max(n) AS n FROM w GROUP BY 1),
m AS (SELECT unnest(['auc','average_precision','precision','recall','f1','accuracy']) AS metric, unnest([auc, average_precision, tp/(tp+fp), tp/p, 2*tp/(tp+fp+p), (tp+n-fp)/(p+n)]) AS value FROM e)
SELECT metric, avg(value) AS mean, stddev_pop(value) AS std, count(*) AS folds FROM m GROUP BY 1""", "mean std")
def fold_metrics(t):
    """Every fold scored by a pipeline and measured from its scores; the pipeline's score is the scaled price."""
    rows = scored(t).withColumn("fold", (F.col("o_orderkey") % 3).cast("int"))
    numbers = F.explode(F.array(*[F.lit(i) for i in range(3)])).alias("_of")
    dealt = rows.select("*", numbers).withColumn("part", F.when(F.col("fold") == F.col("_of"), "val").otherwise("train"))
    dealt = dealt.drop("fold").withColumnsRenamed({"_of": "fold", "score": "price"})
    model = Pipeline(stages=[SQLTransformer(statement="SELECT *, price AS prediction FROM __THIS__")])
    return L.cross_validate(rows, model, "o_orderkey", folds=dealt)


FEATURES = ["l_quantity", "l_discount", "l_tax", "unit_price"]


def priced_lines(t):
    """A learnable label: lines with an above-average price, from features that nearly decide it."""
    key = F.xxhash64("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    return t.lineitem.select(
        key.alias("row_id"), "l_quantity", "l_discount", "l_tax", (F.col("l_extendedprice") / F.col("l_quantity")).alias("unit_price"),
        S.flag(F.col("l_extendedprice") * (1 - F.col("l_discount")) > 30000).alias("label"))


@query("mllib_models", "L1 L2 L16 L17 D11")
def mllib_models(t):
    split = cut_lineage(D.stratified_split(priced_lines(t), "row_id", "label", 0.2))  # read by the weights, the fits and the scores
    rows = D.with_class_weight(split, "label")
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    models = {
        "logistic": L.classifier("logistic", FEATURES, weight="weight", maxIter=10),
        "tree": L.classifier("tree", FEATURES, weight="weight", maxDepth=4),
    }
    return L.compare_models(train, val, models, "row_id")[0]


@query("mllib_cv", "L12 L1")
def mllib_cv(t):
    return L.cross_validate(priced_lines(t), L.classifier("logistic", FEATURES, maxIter=5), "row_id", k=3)


@query("mllib_time_cv", "L13 L6 D8")
def mllib_time_cv(t):
    p = small_panel(t).withColumns({"row_id": F.xxhash64("stock_id", "time_id"), "label": S.flag(F.col("trade_rv") > 60)})
    folds = D.block_folds(p.na.fill(0.0), "time_id", 3)
    return L.cross_validate(p, L.classifier("logistic", ["book_rv", "book_spread_mean"], maxIter=5), "row_id", folds=folds)


@query("mllib_search", "L14 L15 L3")
def mllib_search(t):
    rows = D.stratified_split(scored(t), "o_orderkey", "label", 0.25)
    train, val = rows.where("split = 'train'"), rows.where("split = 'val'")
    grid = L.parameter_sample({"maxDepth": [2, 3], "numTrees": [5]}, 2)
    build = lambda p: L.classifier("forest", ["o_totalprice", "o_custkey"], **p)
    best, results = L.search(train, val, build, grid, "o_orderkey")
    model = build(best).fit(train)
    return L.score_table(model, val, ["o_orderkey", "label"])


@query("mllib_ensemble", "L7 L8")
def mllib_ensemble(t):
    rows = cut_lineage(D.stratified_split(priced_lines(t), "row_id", "label", 0.2, 0.2))  # read by three fits and their scores
    train, val, test = (rows.where(F.col("split") == s) for s in ("train", "val", "test"))
    svc = L.classifier("svc", FEATURES, maxIter=5).fit(train)
    sigmoid = L.sigmoid_calibration(L.score_table(svc, val, ["row_id", "label"], "margin"), "margin")
    calibrated = sigmoid.transform(L.score_table(svc, test, ["row_id", "label"], "margin"))
    one = calibrated.select("row_id", "label", L.vector_to_array("calibrated")[1].alias("score"))
    two = L.score_table(L.classifier("logistic", FEATURES, maxIter=5).fit(train), test, ["row_id", "label"])
    return L.soft_vote([one, two], "row_id")


@query("mllib_blend", "L9 L6 L4 D8 D13")
def mllib_blend(t):
    p = small_panel(t).na.fill(0.0).withColumn("y", F.log1p("trade_rv"))
    folds = D.block_folds(p, "time_id", 2)
    keys, out = ["stock_id", "time_id"], []
    for i in (1, 2):
        train, val = folds.where((F.col("fold") == i) & (F.col("part") == "train")), folds.where((F.col("fold") == i) & (F.col("part") == "val"))
        a = L.score_table(L.regressor("linear", ["book_rv", "book_spread_mean"], "y", regParam=0.1).fit(train), val, [*keys, "y"], "a")
        b = L.score_table(L.regressor("boosted", ["book_rv", "book_spread_mean"], "y", maxIter=3).fit(train), val, keys, "b")
        out.append(a.join(b, keys))
    oof = out[0].unionByName(out[1])
    weights = L.blend_weights(oof, "a", "b", "y")
    return oof.select(*keys, "y", L.blend("a", "b", weights).alias("blended"))


@query("mllib_network", "L5")
def mllib_network(t):
    rows = D.stratified_split(L.as_vector(t.embeddings, "embedding"), "vec_id", "label", 0.25)
    model = L.classifier("network", "embedding", layers=[64, 8, 10], maxIter=10).fit(rows.where("split = 'train'"))
    return model.transform(rows.where("split = 'val'")).select("vec_id", "label", "prediction")


@query("mllib_bayes", "X12")
def mllib_bayes(t):
    """Naive Bayes on lexical counts, fitted on the training split and applied to the other."""
    rows = X.lexical_features(t.documents.join(t.labels, "doc_id"), "text")
    rows = D.stratified_split(rows, "doc_id", "quality", 0.25)
    names = ["word_count", "lm_positive", "lm_negative", "lm_uncertainty", "has_negation", "exclamation_count"]
    model = L.classifier("bayes", names, label="quality", modelType="complement").fit(rows.where("split = 'train'"))
    return L.score_table(model, rows.where("split = 'val'"), ["doc_id", "quality"])


@query("mllib_ranker", "L11 L4")
def mllib_ranker(t):
    from ledgerlens.plans.catalog.samples import assets, customers, trades
    from ledgerlens.operators import recommend as RC

    made = cut_lineage(trades(t).select("customer_id", "isin", "side", "value"))  # read by pairs, users and items
    bought = made.where("side = 'Buy'")
    pairs = D.candidate_pairs(bought, assets(t), "customer_id", "isin", ratio=1)
    users = RC.user_features(customers(t), made, "customer_id", "isin", "side", "value").select("customer_id", "user_n_buy_tx", "user_total_buy")
    items = RC.item_features(assets(t), bought, "customer_id", "isin", "value").select("isin", "item_n_buyers", "item_total_vol")
    matrix = RC.feature_matrix(pairs, users, items, "customer_id", "isin")
    names = ["user_n_buy_tx", "user_total_buy", "item_n_buyers", "item_total_vol"]
    model = L.classifier("boosted", names, maxIter=3)
    late = F.pmod(F.xxhash64("customer_id"), F.lit(4)) == 0  # whole customers are held out
    rows = cut_lineage(matrix.select("customer_id", "isin", "label", *names, late.alias("_late")))  # a fit reads its rows many times
    fitted = model.fit(rows.where("not _late").drop("_late"))
    return L.score_table(fitted, rows.where("_late").drop("_late"), ["customer_id", "isin", "label"])


@query("tree_importance", "H11 L3")
def tree_importance(t):
    rows = cut_lineage(D.stratified_split(priced_lines(t), "row_id", "label", 0.2))
    model = L.classifier("forest", FEATURES, numTrees=5, maxDepth=4).fit(rows.where("split = 'train'"))
    auc = roc_auc(L.score_table(model, rows.where("split = 'val'"), ["row_id", "label"]), "label", "score").select("auc").scalar()
    return L.importances(model, FEATURES, t._spark).withColumn("auc", auc)
