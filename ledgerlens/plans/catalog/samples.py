"""Splits, folds, negatives, weights and recommendation features."""

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import metrics as M
from ledgerlens.operators import recommend as RC
from ledgerlens.operators import splits as D
from ledgerlens.plans.catalog.transactions import LABELLED, labelled_orders
from ledgerlens.plans.registry import query
from ledgerlens.session import cut_lineage

TRADES = """trades AS (SELECT o_custkey AS customer_id, l_partkey AS isin, CASE WHEN l_returnflag<>'R' THEN 'Buy' ELSE 'Sell' END AS side, l_extendedprice AS value, CAST(o_orderdate AS DATE) AS dated
 FROM lineitem JOIN orders ON l_orderkey=o_orderkey)"""


def trades(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return rows.select(
        F.col("o_custkey").alias("customer_id"), F.col("l_partkey").alias("isin"),
        F.when(F.col("l_returnflag") != "R", "Buy").otherwise("Sell").alias("side"),
        F.col("l_extendedprice").alias("value"), F.to_date("o_orderdate").alias("dated"))


def buys(t):
    return trades(t).where("side = 'Buy'")


def customers(t):
    return t.customer.select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), "c_acctbal")


def assets(t):
    return t.part.select(F.col("p_partkey").alias("isin"), F.col("p_brand").alias("category"), F.col("p_type").alias("sector"), "p_retailprice")


# --- splits -----------------------------------------------------------------

@query("split_stratified", "D1 D9")
def split_stratified(t):
    return D.split_facts(D.stratified_split(labelled_orders(t), "o_orderkey", "label", 0.2), "label").orderBy("split")


@query("split_sizes", "D1 D9", f"""
WITH c AS (SELECT label, count(*) AS n FROM ({LABELLED}) GROUP BY 1), s AS (SELECT label, n, ceil(round(0.3*n,9)) AS held, ceil(round(0.1/0.3*ceil(round(0.3*n,9)),9)) AS tested FROM c)
SELECT label, 'train' AS split, CAST(n-held AS BIGINT) AS n FROM s UNION ALL SELECT label, 'val', CAST(held-tested AS BIGINT) FROM s UNION ALL SELECT label, 'test', CAST(tested AS BIGINT) FROM s""")
def split_sizes(t):
    """The hash decides who is where; how many rows each side gets is exact."""
    return D.stratified_split(labelled_orders(t), "o_orderkey", "label", 0.2, 0.1).groupBy("label", "split").agg(F.count(F.lit(1)).alias("n"))


@query("kfold", "D7", f"""
SELECT label, CAST(f AS INTEGER) AS fold, CAST(floor((n-1-f)/5)+1 AS BIGINT) AS n FROM (SELECT label, count(*) AS n FROM ({LABELLED}) GROUP BY 1), range(5) r(f)""")
def kfold(t):
    return D.stratified_folds(labelled_orders(t), "o_orderkey", "label", 5).groupBy("label", "fold").agg(F.count(F.lit(1)).alias("n"))


@query("split_entity", "D2 J6")
def split_entity(t):
    labels = t.customer.select(F.col("c_custkey").alias("o_custkey"), S.flag(F.col("c_acctbal") < 0).alias("label"))
    out = D.entity_split(t.orders, labels, "o_custkey", "label", 0.2)
    return out.groupBy("split").agg(F.count(F.lit(1)).alias("n"), F.countDistinct("o_custkey").alias("entities"))


@query("split_majority", "D3 A26")
def split_majority(t):
    return D.majority_split(t.orders, "o_custkey", "o_orderstatus").groupBy("split", "o_orderstatus").agg(F.count(F.lit(1)).alias("n"))


@query("split_time", "D4", """
WITH d AS (SELECT d, row_number() OVER (ORDER BY d)-1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(o_orderdate AS DATE) AS d FROM orders))
SELECT o_orderkey, CASE WHEN i<CAST(floor(n*0.8) AS BIGINT) THEN 'train' WHEN i<CAST(floor(n*0.9) AS BIGINT) THEN 'val' ELSE 'test' END AS split FROM orders JOIN d ON CAST(o_orderdate AS DATE)=d""")
def split_time(t):
    rows = t.orders.select("o_orderkey", F.to_date("o_orderdate").alias("d"))
    return D.time_split(rows, "d").select("o_orderkey", "split")


@query("split_year", "D5", """SELECT o_orderkey, CASE WHEN year(o_orderdate)<1999 THEN 'train' ELSE 'val' END AS split FROM orders WHERE year(o_orderdate)<=1999""")
def split_year(t):
    return D.split_at(t.orders.withColumn("y", F.year("o_orderdate")), "y", 1999).select("o_orderkey", "split")


@query("split_temporal", "D6 J6", """
WITH c AS (SELECT CAST(max(CAST(o_orderdate AS DATE)) - INTERVAL 3 MONTH AS DATE) AS cut FROM orders), s AS (SELECT o_orderkey, o_custkey, CASE WHEN CAST(o_orderdate AS DATE)<=cut THEN 'train' ELSE 'val' END AS split FROM orders, c)
SELECT o_orderkey, split FROM s WHERE split='train' OR o_custkey IN (SELECT o_custkey FROM s WHERE split='train')""")
def split_temporal(t):
    return D.last_months_split(t.orders, "o_orderdate", "o_custkey", 3).select("o_orderkey", "split")


@query("block_folds", "D8", """
WITH d AS (SELECT d, row_number() OVER (ORDER BY d)-1 AS i, count(*) OVER () AS n FROM (SELECT DISTINCT CAST(ts AS DATE) AS d FROM events)),
b AS (SELECT d, CAST(i//greatest(n//6,1) AS INTEGER) AS block FROM d), f AS (SELECT CAST(k AS INTEGER) AS fold FROM range(1,6) r(k))
SELECT event_id, fold, CASE WHEN block<fold THEN 'train' ELSE 'val' END AS part FROM events JOIN b ON CAST(ts AS DATE)=d JOIN f ON block<=fold""")
def block_folds(t):
    rows = t.events.select("event_id", F.to_date("ts").alias("d"))
    return D.block_folds(rows, "d").select("event_id", "fold", "part")


@query("sample_classes", "S15", """SELECT label, CAST(floor(count(*)*0.1+0.5) AS BIGINT) AS n FROM (""" + LABELLED + ") GROUP BY 1")
def sample_classes(t):
    return D.sample_classes(labelled_orders(t), "o_orderkey", "label", 0.1).groupBy("label").agg(F.count(F.lit(1)).alias("n"))


@query("sample_rows", "S14")
def sample_rows(t):
    return D.sample_rows(t.orders, "o_orderkey", 1000).select("o_orderkey", "o_totalprice")


@query("class_weights", "D11", f"""
WITH c AS (SELECT label, count(*) AS n FROM ({LABELLED}) GROUP BY 1), w AS (SELECT sum(n) AS total, count(*) AS k, max(n) FILTER (label=1) AS pos, max(n) FILTER (label=0) AS neg FROM c)
SELECT label, n, total*1.0/(k*n) AS weight, CASE WHEN label=1 THEN neg*1.0/pos ELSE 1 END AS pos_weight FROM c, w""", "weight pos_weight")
def class_weights(t):
    return D.class_weights(labelled_orders(t), "label")


@query("rmspe_weights", "D13", """
WITH e AS (SELECT quantile_cont(value,0.01) AS e FROM events WHERE value>0), w AS (SELECT event_id, 1.0/(CASE WHEN value>0 THEN value ELSE e END)**2 AS w FROM events, e)
SELECT event_id, w/(SELECT avg(w) FROM w) AS weight FROM w""", "weight")
def rmspe_weights(t):
    return D.relative_error_weights(t.events.select("event_id", "value"), "value").select("event_id", "weight")


# --- negatives --------------------------------------------------------------

@query("negatives", "J7 D10")
def negatives(t):
    return D.negative_pairs(buys(t), assets(t), "customer_id", "isin")


@query("negative_counts", "J7 D10", f"""
WITH {TRADES}, p AS (SELECT customer_id, count(DISTINCT isin) AS m FROM trades WHERE side='Buy' GROUP BY 1)
SELECT customer_id, least(4*m, (SELECT count(*) FROM part)-m) AS negatives, CAST(0 AS BIGINT) AS also_bought FROM p WHERE least(4*m, (SELECT count(*) FROM part)-m)>0""")
def negative_counts(t):
    """Which assets are drawn depends on a hash; how many, and that none was bought, does not."""
    bought = cut_lineage(buys(t).select("customer_id", "isin").distinct())  # for the draw and for the check
    drawn = D.negative_pairs(bought, assets(t), "customer_id", "isin").distinct()
    tagged = drawn.join(bought.withColumn("hit", F.lit(1)), ["customer_id", "isin"], "left")
    return tagged.groupBy("customer_id").agg(F.count(F.lit(1)).alias("negatives"), F.count("hit").alias("also_bought"))


@query("candidate_pairs", "D10 A12")
def candidate_pairs(t):
    return D.candidate_pairs(buys(t), assets(t), "customer_id", "isin")


# --- recommendation features ------------------------------------------------

@query("user_features", "A9 P17", f"""
WITH {TRADES}, a AS (SELECT customer_id, count(*) FILTER (side='Buy') AS nb, sum(value) FILTER (side='Buy') AS tb, avg(value) FILTER (side='Buy') AS ab, stddev_samp(value) FILTER (side='Buy') AS sb,
  count(*) FILTER (side='Sell') AS ns, count(DISTINCT isin) FILTER (side='Buy') AS na FROM trades GROUP BY 1)
SELECT c_custkey AS customer_id, CASE c_mktsegment WHEN 'BUILDING' THEN 0 WHEN 'HOUSEHOLD' THEN 1 WHEN 'MACHINERY' THEN 2 ELSE 9 END AS user_type_score, coalesce(nb,0) AS user_n_buy_tx, coalesce(tb,0) AS user_total_buy,
 coalesce(ab,0) AS user_avg_buy, coalesce(sb,0) AS user_buy_std, coalesce(ns,0) AS user_n_sell_tx, coalesce(na,0) AS user_n_assets FROM customer LEFT JOIN a ON customer_id=c_custkey""", "user_total_buy user_avg_buy user_buy_std")
def user_features(t):
    out = RC.user_features(customers(t), trades(t), "customer_id", "isin", "side", "value")
    out = RC.profile_scores(out, {"user_type_score": ("segment", {"BUILDING": 0, "HOUSEHOLD": 1, "MACHINERY": 2}, 9)})
    return out.drop("segment", "c_acctbal")


@query("item_features", "A11 W9 E5", f"""
WITH {TRADES}, a AS (SELECT isin, count(*) AS np, count(DISTINCT customer_id) AS nb, sum(value) AS tv, avg(value) AS av FROM trades WHERE side='Buy' GROUP BY 1),
i AS (SELECT p_partkey AS isin, p_brand, coalesce(np,0) AS item_n_purchases, coalesce(tv,0) AS item_total_vol, coalesce(av,0) AS item_avg_vol, coalesce(nb,0) AS item_n_buyers FROM part LEFT JOIN a ON isin=p_partkey),
b AS (SELECT p_brand, row_number() OVER (ORDER BY p_brand)-1 AS code FROM (SELECT DISTINCT p_brand FROM part))
SELECT isin, item_n_purchases, item_total_vol, item_avg_vol, item_n_buyers, (rank() OVER (ORDER BY item_n_buyers)-1)*1.0/count(*) OVER () AS item_pop_rank, code AS item_category_enc FROM i JOIN b USING (p_brand)""",
       "item_total_vol item_avg_vol item_pop_rank")
def item_features(t):
    out = cut_lineage(RC.item_features(assets(t), buys(t), "customer_id", "isin", "value"))  # read for the rank and to apply it
    out = RC.popularity_rank(out, out, "isin")
    out = RC.encode_assets(out, assets(t), ["category"])
    return out.drop("category", "sector", "p_retailprice")


@query("roi_features", "A11 P10", """
WITH s AS (SELECT l_partkey, avg(l_extendedprice/l_quantity) AS a, min(l_extendedprice/l_quantity) AS lo, max(l_extendedprice/l_quantity) AS hi FROM lineitem GROUP BY 1)
SELECT p_partkey AS isin, coalesce(a/p_retailprice-1,0) AS item_roi, coalesce(hi/p_retailprice-lo/p_retailprice,0) AS item_roi_range, CAST(coalesce(a/p_retailprice-1,0)>0 AS INTEGER) AS item_positive_roi
FROM part LEFT JOIN s ON l_partkey=p_partkey""", "item_roi item_roi_range")
def roi_features(t):
    unit = F.col("l_extendedprice") / F.col("l_quantity")
    prices = t.lineitem.groupBy("l_partkey").agg(F.avg(unit).alias("a"), F.min(unit).alias("lo"), F.max(unit).alias("hi"))
    rows = t.part.join(prices, F.col("p_partkey") == F.col("l_partkey"), "left")
    retail = F.col("p_retailprice")
    rows = rows.select(F.col("p_partkey").alias("isin"), (F.col("a") / retail - 1).alias("roi"), (F.col("lo") / retail).alias("roi_min"), (F.col("hi") / retail).alias("roi_max"))
    return RC.roi_features(rows, "roi", "roi_min", "roi_max").drop("roi", "roi_min", "roi_max")


@query("pref_category", "A10 R6", f"""
WITH {TRADES} SELECT customer_id, p_brand AS user_pref_category FROM (SELECT customer_id, p_brand, row_number() OVER (PARTITION BY customer_id ORDER BY count(*) DESC, p_brand) i
 FROM trades JOIN part ON isin=p_partkey WHERE side='Buy' GROUP BY 1,2) WHERE i=1""")
def pref_category(t):
    return RC.preferred_category(buys(t), assets(t), "customer_id", "isin", "category")


@query("category_pivot", "A13", f"""
WITH {TRADES} SELECT customer_id, {", ".join(f"count(*) FILTER (p_brand='Brand#{i}') AS inter_cat_{i}" for i in range(1, 26))} FROM trades JOIN part ON isin=p_partkey WHERE side='Buy' GROUP BY 1""")
def category_pivot(t):
    out = RC.category_history(buys(t), assets(t), "customer_id", "isin", "category", [f"Brand#{i}" for i in range(1, 26)])
    return out.withColumnsRenamed({f"inter_cat_Brand#{i}": f"inter_cat_{i}" for i in range(1, 26)})


@query("pair_features", "A12 J2", f"""
WITH {TRADES}, h AS (SELECT customer_id, isin, count(*) AS n, max(dated) AS d FROM trades WHERE side='Buy' AND dated<=DATE '2000-06-30' GROUP BY 1,2), p AS (SELECT DISTINCT customer_id, isin FROM trades)
SELECT customer_id, isin, coalesce(n,0) AS inter_repeat_buys, CAST(coalesce(date_diff('day', d, DATE '2000-06-30'),9999) AS INTEGER) AS inter_days_since_last_buy FROM p LEFT JOIN h USING (customer_id, isin)""")
def pair_features(t):
    pairs = trades(t).select("customer_id", "isin").distinct()
    return RC.pair_features(pairs, buys(t), "customer_id", "isin", "dated", as_of="2000-06-30")


@query("feature_matrix", "J5 A9 A11 A12", f"""
WITH {TRADES}, b AS (SELECT * FROM trades WHERE side='Buy'), p AS (SELECT customer_id, isin, count(*) AS inter_repeat_buys, date_diff('day', max(dated), (SELECT max(dated) FROM b)) AS d FROM b GROUP BY 1,2),
u AS (SELECT customer_id, count(*) AS user_n_buy_tx, sum(value) AS user_total_buy FROM b GROUP BY 1), i AS (SELECT isin, count(DISTINCT customer_id) AS item_n_buyers FROM b GROUP BY 1)
SELECT customer_id, isin, inter_repeat_buys, CAST(d AS INTEGER) AS inter_days_since_last_buy, user_n_buy_tx, user_total_buy, item_n_buyers FROM p JOIN u USING (customer_id) JOIN i USING (isin)""", "user_total_buy")
def feature_matrix(t):
    b = buys(t)
    pairs = RC.pair_features(b.select("customer_id", "isin").distinct(), b, "customer_id", "isin", "dated")
    users = RC.user_features(customers(t), trades(t), "customer_id", "isin", "side", "value").select("customer_id", "user_n_buy_tx", "user_total_buy")
    items = RC.item_features(assets(t), b, "customer_id", "isin", "value").select("isin", "item_n_buyers")
    return RC.feature_matrix(pairs, users, items, "customer_id", "isin")


@query("popularity_baseline", "L10 M15", f"""
WITH {TRADES}, pop AS (SELECT isin, count(*) AS pop_score FROM trades WHERE side='Buy' AND dated<DATE '2000-01-01' GROUP BY 1),
v AS (SELECT customer_id, isin, max(CAST(side='Buy' AS INTEGER)) AS label FROM trades WHERE dated>=DATE '2000-01-01' GROUP BY 1,2), s AS (SELECT v.*, coalesce(pop_score,0) AS score FROM v LEFT JOIN pop USING (isin)),
r AS (SELECT *, row_number() OVER (PARTITION BY customer_id ORDER BY score DESC, isin) AS i, row_number() OVER (PARTITION BY customer_id ORDER BY label DESC, isin) AS b FROM s),
m AS (SELECT sum(label/log2(i+1)) FILTER (i<=10)/nullif(sum(label/log2(b+1)) FILTER (b<=10),0) AS ndcg, sum(label) FILTER (i<=10)/10.0 AS precision, sum(label) FILTER (i<=10)*1.0/sum(label) AS recall, 1.0/min(i) FILTER (label=1) AS mrr
 FROM r GROUP BY customer_id HAVING sum(label)>0) SELECT avg(ndcg) AS ndcg, avg(precision) AS precision, avg(recall) AS recall, avg(mrr) AS mrr, count(*) AS n_queries FROM m""", "ndcg precision recall mrr")
def popularity_baseline(t):
    rows = trades(t).withColumn("label", S.flag(F.col("side") == "Buy"))
    scores = RC.popularity_scores(rows.where("dated < date '2000-01-01'"), "isin", "label")
    val = rows.where("dated >= date '2000-01-01'").groupBy("customer_id", "isin").agg(F.max("label").alias("label"))
    scored = RC.lookup(val, scores, ["isin"], {"pop_score": 0})
    return M.ranking_metrics(scored, "customer_id", "isin", "label", "pop_score")


@query("svd_scores", "Z3")
def svd_scores(t):
    b = cut_lineage(buys(t).select("customer_id", "isin").distinct())
    return RC.svd_scores(b, b, "customer_id", "isin", k=5, oversample=3)


@query("als_scores", "Z3")
def als_scores(t):
    b = cut_lineage(buys(t).select("customer_id", "isin").distinct())
    return RC.als_scores(b, b, "customer_id", "isin", k=5)
