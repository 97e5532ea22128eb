"""Metrics and audits on orders scored by their scaled price."""

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import audit as A
from ledgerlens.operators import metrics as M
from ledgerlens.operators.ordering import only_row
from ledgerlens.operators.text import words
from ledgerlens.plans.registry import query

# the score is rounded so that many rows share one
SCORED = """scored AS (SELECT o_orderkey, o_orderpriority, o_totalprice, o_custkey, CAST(o_orderstatus='F' AS INTEGER) AS label,
  round(o_totalprice/(SELECT max(o_totalprice) FROM orders), 3) AS score FROM orders)"""
CURVE = SCORED + """,
cnt AS (SELECT score, count(*) FILTER (label=1) AS pos, count(*) FILTER (label=0) AS neg FROM scored GROUP BY 1),
cur AS (SELECT score, pos, neg, sum(pos) OVER (ORDER BY score DESC) AS tp, sum(neg) OVER (ORDER BY score DESC) AS fp, sum(pos) OVER () AS p, sum(neg) OVER () AS n FROM cnt)"""


def scored(t):
    orders = t.orders
    top = only_row(orders.agg(F.max("o_totalprice").alias("m"))).getField("m")
    return orders.select(
        "o_orderkey", "o_orderpriority", "o_totalprice", "o_custkey", S.flag(F.col("o_orderstatus") == "F").alias("label"),
        F.round(F.col("o_totalprice") / top, 3).alias("score"))


def predicted(t):
    return scored(t).withColumn("pred", S.flag(F.col("score") >= 0.5))


PRED = SCORED + ", pr AS (SELECT *, CAST(score>=0.5 AS INTEGER) AS pred FROM scored)"
AUC = "SELECT sum(pos*(n-fp)+pos*neg/2.0)/max(p*n*1.0) AS auc FROM cur"


@query("auc", "M1 M6", f"WITH {CURVE} {AUC}", "auc")
def auc(t):
    return M.roc_auc(scored(t), "label", "score")


@query("avg_precision", "M2", f"WITH {CURVE} SELECT sum(pos*1.0/p*tp/(tp+fp)) AS average_precision FROM cur", "average_precision")
def avg_precision(t):
    return M.average_precision(scored(t), "label", "score")


@query("curve_points", "M8 W13", f"WITH {CURVE} SELECT score AS threshold, tp*1.0/p AS tpr, fp*1.0/n AS fpr, tp*1.0/(tp+fp) AS precision FROM cur", "threshold tpr fpr precision")
def curve_points(t):
    return M.curve_points(scored(t), "label", "score")


_RATES = """coalesce(tp*1.0/nullif(tp+fp,0),0) AS precision, coalesce(tp*1.0/nullif(tp+fn,0),0) AS recall, coalesce(2.0*tp/nullif(2*tp+fp+fn,0),0) AS f1,
 coalesce(fp*1.0/nullif(fp+tn,0),0) AS fpr, coalesce((tp+tn)*1.0/nullif(tp+fp+fn+tn,0),0) AS accuracy, coalesce((tp+fp)*1.0/nullif(tp+fp+fn+tn,0),0) AS coverage"""
RATE_COLS = "precision recall f1 fpr accuracy coverage"


@query("confusion", "M3", f"""
WITH {PRED}, c AS (SELECT count(*) FILTER (pred=1 AND label=1) AS tp, count(*) FILTER (pred=1 AND label=0) AS fp, count(*) FILTER (pred=0 AND label=1) AS fn, count(*) FILTER (pred=0 AND label=0) AS tn FROM pr)
SELECT *, {_RATES} FROM c""", RATE_COLS)
def confusion(t):
    return M.confusion(predicted(t), "label", "pred")


def _sweep(n, start):
    return f"""g AS (SELECT {start}+i*0.01::DOUBLE AS threshold FROM range({n}) r(i)),
s AS (SELECT threshold, count(*) FILTER (score>=threshold AND label=1) AS tp, count(*) FILTER (score>=threshold AND label=0) AS fp,
  count(*) FILTER (score<threshold AND label=1) AS fn, count(*) FILTER (score<threshold AND label=0) AS tn FROM scored, g GROUP BY 1),
sw AS (SELECT *, {_RATES}, fp*1.0+10.0*fn AS cost FROM s)"""


# scores have three digits, so a grid shifted by half a step never meets one
GRID = [0.0105 + i * 0.01 for i in range(98)]
COARSE = [0.0505 + i * 0.01 for i in range(90)]
SWEEP_COLS = f"threshold {RATE_COLS} cost"


@query("threshold_sweep", "M4", f"WITH {SCORED}, {_sweep(98, 0.0105)} SELECT * FROM sw", SWEEP_COLS)
def threshold_sweep(t):
    return M.threshold_sweep(scored(t), "label", "score", GRID)


@query("best_f1_threshold", "M4", f"WITH {SCORED}, {_sweep(90, 0.0505)} SELECT * FROM sw ORDER BY f1 DESC, threshold LIMIT 1", SWEEP_COLS)
def best_f1_threshold(t):
    return M.best_threshold(M.threshold_sweep(scored(t), "label", "score", COARSE), "f1")


@query("cost_threshold", "M5", f"WITH {SCORED}, {_sweep(90, 0.0505)} SELECT * FROM sw ORDER BY cost, threshold LIMIT 1", SWEEP_COLS)
def cost_threshold(t):
    return M.best_threshold(M.threshold_sweep(scored(t), "label", "score", COARSE), "cost", largest=False)


@query("youden", "M7", f"""WITH {CURVE}, j AS (SELECT score AS threshold, tp*1.0/p AS tpr, fp*1.0/n AS fpr, tp*1.0/p-fp*1.0/n AS j FROM cur)
SELECT * FROM j ORDER BY round(j,12) DESC, threshold DESC LIMIT 1""", "threshold tpr fpr j")
def youden(t):
    return M.youden_threshold(scored(t), "label", "score")


SHARES = [i / 100 for i in range(1, 21)]
_RANK = "rk AS (SELECT label, score, o_orderkey, row_number() OVER (ORDER BY score DESC, o_orderkey) AS i, count(*) OVER () AS n, sum(label) OVER () AS p FROM scored)"


@query("capture_rate", "M6 W13", f"""
WITH {SCORED}, {_RANK}, s AS (SELECT unnest([{', '.join(f'{s}::DOUBLE' for s in SHARES)}]) AS share)
SELECT share, CAST(any_value(ceil(share*n)) AS BIGINT) AS n_top, sum(label) FILTER (i<=ceil(share*n))*1.0/any_value(p) AS capture_rate FROM rk, s GROUP BY 1""", "share capture_rate")
def capture_rate(t):
    return M.capture_rates(scored(t), "label", "score", "o_orderkey", SHARES)


@query("card_metric", "M6", f"""
WITH {CURVE}, {_RANK}, a AS ({AUC}), d AS (SELECT sum(label) FILTER (i<=ceil(0.04*n))*1.0/any_value(p) AS capture_rate FROM rk)
SELECT 2*auc-1 AS gini, capture_rate, 0.5*(2*auc-1+capture_rate) AS card_metric FROM a, d""", "gini capture_rate card_metric")
def card_metric(t):
    return M.card_metric(scored(t), "label", "score", "o_orderkey")


@query("decile_rate", "M18 W14 P27", f"""
WITH {SCORED}, {_RANK} SELECT CAST(greatest(least(ceil((i-1)*10.0/(n-1))-1,9),0)+1 AS INTEGER) AS decile, count(*) AS n, avg(label) AS rate FROM rk GROUP BY 1""", "rate")
def decile_rate(t):
    return M.bin_rates(scored(t), "label", "score", "o_orderkey")


SMOOTH = CURVE + ", sm AS (SELECT score AS threshold, tp*1.0/(tp+fp) AS precision, tp*1.0/p AS recall, max(tp*1.0/(tp+fp)) OVER (ORDER BY score DESC) AS smooth_precision FROM cur)"


@query("smoothed_precision", "M9 W15", f"WITH {SMOOTH} SELECT * FROM sm", "threshold precision recall smooth_precision")
def smoothed_precision(t):
    return M.smoothed_precision(scored(t), "label", "score")


@query("recall_at_precision", "M9", f"WITH {SMOOTH} SELECT * FROM sm WHERE smooth_precision>=0.34 ORDER BY recall DESC, threshold LIMIT 1", "threshold precision recall smooth_precision")
def recall_at_precision(t):
    return M.recall_at_precision(scored(t), "label", "score", 0.34)


@query("utility", "M10", f"""
WITH {SCORED}, u AS (SELECT count(*) FILTER (score>=0.5) AS alerts, 100.0*count(*) FILTER (score>=0.5)/count(*) AS alert_pct, sum(o_totalprice) FILTER (score>=0.5 AND label=1) AS saved,
 sum(o_totalprice*1.5) FILTER (score<0.5 AND label=1) AS lost, count(*) FILTER (score>=0.5)*5.0+count(*) FILTER (score>=0.5 AND label=0)*15.0 AS overhead FROM scored)
SELECT *, saved-lost-overhead AS net FROM u""", "alert_pct saved lost overhead net")
def utility(t):
    return M.money_utility(scored(t), "label", "score", "o_totalprice", 0.5)


@query("business_impact", "M11", f"""
WITH {SCORED}, g AS (SELECT unnest([0.5::DOUBLE, 0.3005::DOUBLE]) AS threshold),
s AS (SELECT threshold, count(*) FILTER (score>=threshold AND label=1) AS tp, count(*) FILTER (score>=threshold AND label=0) AS fp, count(*) FILTER (score<threshold AND label=1) AS fn FROM scored, g GROUP BY 1)
SELECT threshold, tp, fp, fn, coalesce(tp*1.0/nullif(tp+fp,0),0) AS precision, coalesce(tp*1.0/nullif(tp+fn,0),0) AS recall, tp*150.0*0.85 AS losses_saved, fp*12.0 AS false_alert_cost, tp*150.0*0.85-fp*12.0 AS net_benefit FROM s""",
       "threshold precision recall losses_saved false_alert_cost net_benefit")
def business_impact(t):
    return M.business_impact(scored(t), "label", "score", [0.5, 0.3005])


@query("calibration", "M16", f"""
WITH {SCORED} SELECT CAST(greatest(least(ceil(score*10)-1,9),0) AS INTEGER) AS bin, count(*) AS n, avg(score) AS mean_score, avg(label) AS positive_rate, abs(avg(label)-avg(score)) AS gap FROM scored GROUP BY 1""", "mean_score positive_rate gap")
def calibration(t):
    return M.calibration_table(scored(t), "label", "score")


@query("brier", "M16 M17", f"""WITH {SCORED} SELECT avg((score-label)**2) AS brier, avg(score) FILTER (label=1) AS mean_positive, avg(score) FILTER (label=0) AS mean_negative,
 avg(score) FILTER (label=1)-avg(score) FILTER (label=0) AS separation FROM scored""", "brier mean_positive mean_negative separation")
def brier(t):
    rows = scored(t)
    return M.separation(rows, "label", "score").withColumn("brier", M.brier(rows, "label", "score").scalar())


# --- regression, classes, ranking -------------------------------------------

FORECAST = """f AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_extendedprice AS y, ln(1+l_quantity*1000) AS plog, l_quantity*1000 AS p1, l_quantity*1100 AS p2 FROM lineitem)"""


def forecasts(t):
    q = F.col("l_quantity")
    return t.lineitem.select("l_suppkey", F.col("l_extendedprice").alias("y"), F.log1p(q * 1000).alias("plog"), (q * 1000).alias("p1"), (q * 1100).alias("p2"))


@query("rmspe_report", "M12", f"""WITH {FORECAST} SELECT sqrt(avg(((exp(least(greatest(plog,-10),10))-1-y)/nullif(y,0))**2)) AS rmspe, sqrt(avg((ln(1+y)-plog)**2)) AS rmse, avg(abs(ln(1+y)-plog)) AS mae,
 1-avg((ln(1+y)-plog)**2)/var_pop(ln(1+y)) AS r2, count(*) AS n FROM f""", "rmspe rmse mae r2")
def rmspe_report(t):
    return M.regression_report(forecasts(t), "y", "plog")


@query("residual_summary", "M20", f"""WITH {FORECAST}, r AS (SELECT y, p1, (p1-y)/greatest(y,1e-9)*100 AS rel FROM f), q AS (SELECT quantile_cont(rel,0.01) a, quantile_cont(rel,0.99) b, quantile_cont(abs(rel),0.9) c FROM r)
SELECT avg(p1-y) AS mean_bias, corr(p1,y) AS correlation, avg(least(greatest(rel,a),b)) AS mean_rel_clipped, count(*) AS n, any_value(c) AS p90_abs_rel FROM r, q""", "mean_bias correlation mean_rel_clipped p90_abs_rel")
def residual_summary(t):
    return M.residual_summary(forecasts(t), "y", "p1")


@query("entity_errors", "M19", f"""WITH {FORECAST} SELECT l_suppkey, sqrt(avg(((p1-y)/greatest(y,1e-9))**2)) AS rmspe, count(y) AS count, avg(y) AS mean_actual FROM f GROUP BY 1""", "rmspe mean_actual")
def entity_errors(t):
    return M.entity_errors(forecasts(t), "l_suppkey", "y", "p1")


@query("error_disparity", "M19", f"""WITH {FORECAST}, e AS (SELECT l_suppkey, sqrt(avg(((p1-y)/greatest(y,1e-9))**2)) AS r FROM f GROUP BY 1) SELECT max(r)/greatest(min(r),1e-9) AS disparity, avg(r) AS mean_rmspe FROM e""", "disparity mean_rmspe")
def error_disparity(t):
    return M.error_disparity(M.entity_errors(forecasts(t), "l_suppkey", "y", "p1"))


def _dm(h):
    lags = "".join(f", lag(d,{k}) OVER (ORDER BY event_id) AS d{k}" for k in range(1, h))
    cov = "".join(f"+2*(1-{k}/{h + 1}.0)*covar_samp(d,d{k})" for k in range(1, h))
    return f"""WITH d AS (SELECT event_id, ((value-50)/100)**2-((value-60)/100)**2 AS d FROM events), l AS (SELECT *{lags} FROM d)
SELECT avg(d)/sqrt((var_pop(d){cov})/count(d)) AS dm_stat, count(d) AS n FROM l"""


def _errors(t):
    v = F.col("value")
    return t.events.select("event_id", ((v - 50) / 100).alias("e1"), ((v - 60) / 100).alias("e2"))


@query("dm_test", "M13", _dm(1), "dm_stat")
def dm_test(t):
    return M.diebold_mariano(_errors(t), "event_id", "e1", "e2").drop("p_value")


@query("dm_test_lags", "M13", _dm(4), "dm_stat")
def dm_test_lags(t):
    return M.diebold_mariano(_errors(t), "event_id", "e1", "e2", h=4).drop("p_value")


CLASSES = """c AS (SELECT doc_id, quality+toxic AS label, CASE WHEN n_chars<500 THEN 0 WHEN n_chars<5000 THEN 1 ELSE 2 END AS pred, n_chars, source FROM documents JOIN labels USING (doc_id))"""


def classified(t):
    n = F.col("n_chars")
    return t.documents.join(t.labels, "doc_id").select(
        "doc_id", (F.col("quality") + F.col("toxic")).alias("label"), F.when(n < 500, 0).when(n < 5000, 1).otherwise(2).alias("pred"), "n_chars", "source", "text")


REPORT = CLASSES + """, r AS (SELECT k AS class, count(*) FILTER (label=k) AS support, coalesce(count(*) FILTER (label=k AND pred=k)*1.0/nullif(count(*) FILTER (pred=k),0),0) AS precision,
 coalesce(count(*) FILTER (label=k AND pred=k)*1.0/nullif(count(*) FILTER (label=k),0),0) AS recall,
 coalesce(2.0*count(*) FILTER (label=k AND pred=k)/nullif(count(*) FILTER (pred=k)+count(*) FILTER (label=k),0),0) AS f1 FROM c, (SELECT unnest([0,1,2]) AS k) GROUP BY 1)"""


@query("multiclass_report", "M14", f"WITH {REPORT} SELECT * FROM r", "precision recall f1")
def multiclass_report(t):
    return M.class_report(classified(t), "label", "pred", [0, 1, 2])


@query("multiclass_summary", "M14", f"WITH {REPORT} SELECT sum(recall*support)/sum(support) AS accuracy, avg(f1) AS macro_f1, sum(f1*support)/sum(support) AS weighted_f1 FROM r", "accuracy macro_f1 weighted_f1")
def multiclass_summary(t):
    return M.class_summary(M.class_report(classified(t), "label", "pred", [0, 1, 2]))


def _ovr(k, s):
    return f"""SELECT {k} AS class, sum(CASE WHEN a.s>b.s THEN 1.0 WHEN a.s=b.s THEN 0.5 ELSE 0 END)/count(*) AS auc
 FROM (SELECT {s}::DOUBLE s FROM c WHERE label={k}) a, (SELECT {s}::DOUBLE s FROM c WHERE label<>{k}) b"""


@query("one_vs_rest_auc", "M14 M1", f"WITH {CLASSES} {_ovr(0, '-n_chars')} UNION ALL {_ovr(1, 'n_chars%1000')} UNION ALL {_ovr(2, 'n_chars')}", "auc")
def one_vs_rest_auc(t):
    n = F.col("n_chars")
    rows = classified(t).select("label", (-n).alias("s0"), (n % 1000).alias("s1"), n.alias("s2"))
    return M.one_vs_rest_auc(rows, "label", {0: "s0", 1: "s1", 2: "s2"})


PAIRS = """prs AS (SELECT o_custkey AS q, l_partkey AS item, max(CAST(l_returnflag<>'R' AS INTEGER)) AS label, round(sum(l_quantity)/10) AS score FROM lineitem JOIN orders ON l_orderkey=o_orderkey GROUP BY 1,2)"""


def ranked_pairs(t):
    trades = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return trades.groupBy(F.col("o_custkey").alias("q"), F.col("l_partkey").alias("item")).agg(
        F.max(S.flag(F.col("l_returnflag") != "R")).alias("label"), F.round(F.sum("l_quantity") / 10).alias("score"))


@query("ranking_metrics", "M15 W17", f"""
WITH {PAIRS}, r AS (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS i, row_number() OVER (PARTITION BY q ORDER BY label DESC, item) AS b FROM prs),
m AS (SELECT q, sum(label/log2(i+1)) FILTER (i<=10)/nullif(sum(label/log2(b+1)) FILTER (b<=10),0) AS ndcg, sum(label) FILTER (i<=10)/10.0 AS precision, sum(label) FILTER (i<=10)*1.0/sum(label) AS recall,
  1.0/min(i) FILTER (label=1) AS mrr FROM r GROUP BY 1 HAVING sum(label)>0)
SELECT avg(ndcg) AS ndcg, avg(precision) AS precision, avg(recall) AS recall, avg(mrr) AS mrr, count(*) AS n_queries FROM m""", "ndcg precision recall mrr")
def ranking_metrics(t):
    return M.ranking_metrics(ranked_pairs(t), "q", "item", "label", "score")


# --- audits -----------------------------------------------------------------

_AUDIT = """count(*) AS count, avg(label) AS base_rate, count(*) FILTER (pred=1 AND label=0)*1.0/count(*) AS fp_share, count(*) FILTER (pred=0 AND label=1)*1.0/count(*) AS fn_share,
 coalesce(count(*) FILTER (pred=1 AND label=0)*1.0/nullif(count(*) FILTER (label=0),0),0) AS fpr, coalesce(count(*) FILTER (pred=0 AND label=1)*1.0/nullif(count(*) FILTER (label=1),0),0) AS fnr,
 avg(CAST(label=pred AS INTEGER)) AS accuracy"""
AUDIT_COLS = "base_rate fp_share fn_share fpr fnr accuracy"
_SCORE = "avg(score) AS mean_score, avg(score)-avg(label) AS calibration_gap"


def _group_auc(g, src):
    return f"""(SELECT {g}, sum(w)/nullif(max(pp)*max(nn),0) AS auc FROM (SELECT {g}, pos*(sum(neg) OVER (PARTITION BY {g} ORDER BY score)-neg/2.0) AS w, (sum(pos) OVER (PARTITION BY {g}))*1.0 AS pp, sum(neg) OVER (PARTITION BY {g}) AS nn
  FROM (SELECT {g}, score, count(*) FILTER (label=1) AS pos, count(*) FILTER (label=0) AS neg FROM {src} GROUP BY ALL)) GROUP BY ALL)"""


@query("audit_quartile", "H1 P28", f"""
WITH {PRED}, e AS (SELECT list_distinct([{', '.join(f'quantile_cont(o_totalprice,{i / 4})' for i in range(5))}]) AS edges FROM scored),
b AS (SELECT *, CAST(greatest(least(len(list_filter(edges, lambda x: x < o_totalprice))-1, len(edges)-2), 0) AS INTEGER) AS band FROM pr, e)
SELECT band, {_AUDIT}, 'o_totalprice_band' AS attribute FROM b GROUP BY 1""", AUDIT_COLS)
def audit_quartile(t):
    return A.audit_by_quantile(predicted(t), "o_totalprice", "label", "pred", 4)


@query("audit_category", "H2", f"WITH {PRED} SELECT o_orderpriority, {_AUDIT} FROM pr GROUP BY 1", AUDIT_COLS)
def audit_category(t):
    return A.group_audit(predicted(t), ["o_orderpriority"], "label", "pred")


BINARY = PRED + """, att AS (SELECT label, pred, score, 'urgent' AS attribute, CASE WHEN o_orderpriority='1-URGENT' THEN 'yes' ELSE 'no' END AS "group" FROM pr
 UNION ALL SELECT label, pred, score, 'large', CASE WHEN o_totalprice>250000 THEN 'large' ELSE 'small' END FROM pr)"""


def binary_audit(t):
    rows = predicted(t).withColumns({"urgent": S.flag(F.col("o_orderpriority") == "1-URGENT"), "large": S.flag(F.col("o_totalprice") > 250000)})
    return A.audit_attributes(rows, {"urgent": ("yes", "no"), "large": ("large", "small")}, "label", "pred", "score")


@query("audit_group_auc", "H3 M1", f"""WITH {BINARY}, a AS (SELECT attribute, "group", {_AUDIT}, {_SCORE} FROM att GROUP BY 1,2) SELECT * FROM a LEFT JOIN {_group_auc('attribute, "group"', 'att')} USING (attribute, "group")""",
       AUDIT_COLS + " mean_score calibration_gap auc")
def audit_group_auc(t):
    return binary_audit(t)


@query("audit_disparity", "H8", f"""WITH {BINARY}, a AS (SELECT attribute, "group", {_AUDIT} FROM att GROUP BY 1,2)
SELECT attribute, max(fpr)-min(fpr) AS disparity, avg(fpr) AS mean_rate, count(*) AS n_groups, CAST(max(fpr)-min(fpr)>0.05 AS INTEGER) AS flagged FROM a GROUP BY 1""", "disparity mean_rate")
def audit_disparity(t):
    return A.disparity(binary_audit(t), "attribute", "fpr")


@query("audit_sector", "H4", f"""WITH {CLASSES} SELECT source, count(*) AS count, avg(CAST(label=2 AS INTEGER)) AS pct_high_true, avg(CAST(pred=2 AS INTEGER)) AS pct_high_pred, avg(CAST(pred=2 AS INTEGER)) FILTER (label=2) AS high_recall,
 avg(CAST(pred=2 AS INTEGER)) FILTER (label=0) AS false_alarm_rate, avg(CAST(label=pred AS INTEGER)) AS accuracy FROM c GROUP BY 1 HAVING count(*)>=5""", "pct_high_true pct_high_pred high_recall false_alarm_rate accuracy")
def audit_sector(t):
    return A.high_risk_audit(classified(t), "source", "label", "pred")


@query("audit_sector_auc", "H5", f"""WITH {SCORED} SELECT o_orderpriority, n, pos_rate, auc FROM (SELECT o_orderpriority, count(*) AS n, avg(label) AS pos_rate FROM scored GROUP BY 1)
 JOIN {_group_auc('o_orderpriority', 'scored')} USING (o_orderpriority) WHERE auc IS NOT NULL""", "pos_rate auc")
def audit_sector_auc(t):
    return A.group_auc(scored(t), "o_orderpriority", "label", "score")


@query("audit_tiers", "H6 P26", f"""WITH {PRED}, ti AS (SELECT p.*, CASE WHEN coalesce(c_acctbal,0)<=0 THEN 'low' WHEN c_acctbal<=5000 THEN 'medium' ELSE 'high' END AS tier FROM pr p LEFT JOIN customer ON o_custkey=c_custkey),
a AS (SELECT tier, {_AUDIT}, {_SCORE} FROM ti GROUP BY 1) SELECT * FROM a LEFT JOIN {_group_auc('tier', 'ti')} USING (tier)""", AUDIT_COLS + " mean_score calibration_gap auc")
def audit_tiers(t):
    rows = predicted(t).join(t.customer.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal"), "o_custkey", "left")
    return A.audit_tiers(rows, "c_acctbal", [float("-inf"), 0.0, 5000.0, float("inf")], ["low", "medium", "high"], "label", "pred", "score")


@query("audit_text_length", "H7 P28", rf"""WITH {CLASSES}, w AS (SELECT label, pred, CAST(len(list_filter(regexp_split_to_array(text, '[\s\x1c-\x1f\x85\pZ]+'), lambda x: x <> '')) AS DOUBLE) AS n FROM c JOIN documents USING (doc_id)),
e AS (SELECT list_distinct([quantile_cont(n,0), quantile_cont(n,1/3), quantile_cont(n,2/3), quantile_cont(n,1)]) AS edges FROM w),
b AS (SELECT label, pred, CAST(greatest(least(len(list_filter(edges, lambda x: x < n))-1, len(edges)-2), 0) AS INTEGER) AS band FROM w, e)
SELECT band, {_AUDIT}, 'n_words_band' AS attribute FROM b GROUP BY 1""", AUDIT_COLS)
def audit_text_length(t):
    rows = classified(t).select("label", "pred", F.size(words("text")).cast("double").alias("n_words"))
    return A.audit_by_quantile(rows, "n_words", "label", "pred", 3)


TOP10 = PAIRS + ", tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, item) AS i FROM prs) WHERE i<=10)"


def part_categories(t):
    return t.part.select(F.col("p_partkey").alias("item"), "p_brand")


@query("diversity_topk", "H9 W17", f"WITH {TOP10} SELECT q, count(DISTINCT p_brand) AS categories_in_top, count(*) AS n_recommendations FROM tp LEFT JOIN part ON item=p_partkey GROUP BY 1")
def diversity_topk(t):
    return A.diversity(ranked_pairs(t), "q", "item", "score", part_categories(t), "p_brand")


@query("diversity_by_segment", "H9", f"""WITH {TOP10}, d AS (SELECT q, count(DISTINCT p_brand) AS k FROM tp LEFT JOIN part ON item=p_partkey GROUP BY 1)
SELECT c_mktsegment, avg(k) AS mean_categories, count(*) AS n_customers FROM d JOIN customer ON q=c_custkey GROUP BY 1""", "mean_categories")
def diversity_by_segment(t):
    d = A.diversity(ranked_pairs(t), "q", "item", "score", part_categories(t), "p_brand")
    return A.diversity_by(d, t.customer.select(F.col("c_custkey").alias("q"), "c_mktsegment"), "q", "c_mktsegment")


@query("popularity_bias", "H10", f"""WITH {TOP10}, pop AS (SELECT item, count(DISTINCT q) AS n FROM prs WHERE label=1 GROUP BY 1),
r AS (SELECT q, avg(coalesce(n,0)) AS a FROM tp LEFT JOIN pop USING (item) GROUP BY 1), c AS (SELECT q, avg(n) AS b FROM prs LEFT JOIN pop USING (item) WHERE label=1 GROUP BY 1)
SELECT avg(a) AS recommended_popularity, avg(b) AS actual_popularity, count(*) AS n_customers FROM r LEFT JOIN c USING (q)""", "recommended_popularity actual_popularity")
def popularity_bias(t):
    rows = ranked_pairs(t)
    return A.popularity_bias(rows, rows, "q", "item", "label", "score")


@query("permutation_importance", "H11")
def permutation_importance(t):
    rows = t.orders.select("o_orderkey", "o_totalprice", "o_custkey", S.flag(F.col("o_totalprice") > 250000).alias("label"))
    score = lambda df: df.withColumn("score", F.col("o_totalprice") + F.col("o_custkey") * 20)
    return A.permutation_importance(rows, ["o_totalprice", "o_custkey"], "o_orderkey", "label", score)
