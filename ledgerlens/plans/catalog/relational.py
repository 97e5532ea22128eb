"""Joins, grouped rates, statement histories and subscriber aggregates."""

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import columns as C
from ledgerlens.operators import encode as E
from ledgerlens.operators import history as H
from ledgerlens.operators import relational as R
from ledgerlens.plans.catalog.transactions import LABELLED, TRAIN_BEFORE, labelled_orders, train
from ledgerlens.plans.registry import query


# --- joins ------------------------------------------------------------------

@query("star_join", "J1 J3 J5", """
SELECT r_name, n_name, count(*) AS n, sum(o_totalprice) AS total, avg(c_acctbal) AS mean_balance
FROM orders JOIN customer ON o_custkey=c_custkey JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY ALL""", "total mean_balance")
def star_join(t):
    rows = R.attach(t.orders, t.customer, {"o_custkey": "c_custkey"}, ["c_nationkey", "c_acctbal"], "inner")
    rows = R.attach(rows, t.nation, {"c_nationkey": "n_nationkey"}, ["n_name", "n_regionkey"], "inner")
    rows = R.attach(rows, t.region, {"n_regionkey": "r_regionkey"}, ["r_name"], "inner")
    return rows.groupBy("r_name", "n_name").agg(
        F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"), F.avg("c_acctbal").alias("mean_balance"))


@query("left_chain", "J1 R19", """
SELECT c_custkey, c_mktsegment, n_name, coalesce(n_orders,0) AS n_orders, coalesce(spent,0) AS spent FROM customer
LEFT JOIN nation ON c_nationkey=n_nationkey
LEFT JOIN (SELECT o_custkey, count(*) n_orders, sum(o_totalprice) spent FROM orders GROUP BY 1) ON o_custkey=c_custkey""", "spent")
def left_chain(t):
    per = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_orders"), F.sum("o_totalprice").alias("spent"))
    rows = R.attach(t.customer, t.nation, {"c_nationkey": "n_nationkey"}, ["n_name"])
    rows = R.attach(rows, per, {"c_custkey": "o_custkey"})
    return R.fill_added(R.fill_added(rows, ["spent"], 0.0), ["n_orders"], 0).select("c_custkey", "c_mktsegment", "n_name", "n_orders", "spent")


@query("two_key_join", "J2", """
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, l_quantity, q.n AS pair_lines FROM lineitem
LEFT JOIN (SELECT l_partkey, l_suppkey, count(*) n FROM lineitem WHERE l_returnflag='R' GROUP BY 1,2) q USING (l_partkey, l_suppkey)""", "l_quantity")
def two_key_join(t):
    lines = t.lineitem
    pairs = lines.where("l_returnflag = 'R'").groupBy("l_partkey", "l_suppkey").agg(F.count(F.lit(1)).alias("pair_lines"))
    return R.attach(lines.select("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity"), pairs, ["l_partkey", "l_suppkey"])


@query("full_join", "J4 J9", """
SELECT coalesce(a.user_id, b.user_id) AS user_id, n_click, n_other FROM
(SELECT user_id, count(*) n_click FROM events WHERE event_type='click' GROUP BY 1) a FULL JOIN
(SELECT user_id, count(*) n_other FROM events WHERE event_type<>'click' GROUP BY 1) b ON a.user_id=b.user_id""")
def full_join(t):
    e = t.events
    block = lambda rows, name: rows.groupBy("user_id").agg(F.count(F.lit(1)).alias(name))
    clicks, others = e.where("event_type = 'click'"), e.where("event_type <> 'click'")
    return R.attach(block(clicks, "n_click"), block(others, "n_other"), "user_id", how="full")


@query("semi_known", "J6 U2", f"""
SELECT o_orderkey, o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '{TRAIN_BEFORE}' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '{TRAIN_BEFORE}')""")
def semi_known(t):
    orders = t.orders
    later = orders.where(F.col("o_orderdate") >= F.lit(TRAIN_BEFORE).cast("timestamp_ntz"))
    return R.known_only(later, train(orders), ["o_custkey"]).select("o_orderkey", "o_custkey")


@query("anti_unbought", "J7", """
SELECT DISTINCT o_custkey, l_partkey FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE l_returnflag='R'
AND NOT EXISTS (SELECT 1 FROM lineitem b JOIN orders p ON b.l_orderkey=p.o_orderkey WHERE b.l_returnflag<>'R' AND p.o_custkey=orders.o_custkey AND b.l_partkey=lineitem.l_partkey)""")
def anti_unbought(t):
    """(customer, asset) pairs that were sold but never bought."""
    trades = R.attach(t.lineitem.select("l_orderkey", "l_partkey", "l_returnflag"), t.orders, {"l_orderkey": "o_orderkey"}, ["o_custkey"], "inner")
    pairs = trades.groupBy("o_custkey", "l_partkey").agg(
        F.count_if(F.col("l_returnflag") == "R").alias("sold"), F.count_if(F.col("l_returnflag") != "R").alias("bought"))
    return R.unknown_only(pairs.where("sold > 0"), pairs.where("bought > 0"), ["o_custkey", "l_partkey"]).select("o_custkey", "l_partkey")


@query("lookup_default", "J8", """
SELECT l_orderkey, l_linenumber, l_partkey, coalesce(r, g) AS part_return_rate FROM lineitem LEFT JOIN
(SELECT l_partkey, avg(CAST(l_returnflag='R' AS INTEGER)) r FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01' GROUP BY 1) USING (l_partkey),
(SELECT avg(CAST(l_returnflag='R' AS INTEGER)) g FROM lineitem WHERE l_shipdate < TIMESTAMP '1999-01-01')""", "part_return_rate")
def lookup_default(t):
    lines = t.lineitem.withColumn("returned", S.flag(F.col("l_returnflag") == "R"))
    stats = E.fit_target_rate(lines.where("l_shipdate < timestamp_ntz '1999-01-01'"), ["l_partkey"], "returned")
    return E.apply_target_rate(lines, stats, ["l_partkey"], "part_return_rate").select("l_orderkey", "l_linenumber", "l_partkey", "part_return_rate")


@query("round_robin", "J11", """
SELECT doc_id, s_suppkey FROM (SELECT doc_id, (row_number() OVER (ORDER BY doc_id)-1) % (SELECT count(*) FROM supplier) + 1 AS slot FROM documents)
JOIN (SELECT s_suppkey, row_number() OVER (ORDER BY s_suppkey) AS slot FROM supplier) USING (slot)""")
def round_robin(t):
    return R.assign_round_robin(t.documents.select("doc_id"), "doc_id", t.supplier, "s_suppkey")


# --- grouped rates and shares -----------------------------------------------

@query("rate_by_month", "A21 A17", """
WITH s AS (SELECT CAST(date_trunc('month', o_orderdate) AS DATE) AS month, sum(o_totalprice) total, count(*) n FROM orders GROUP BY 1)
SELECT CAST(m AS DATE) AS month, coalesce(total,0) AS total, coalesce(n,0) AS n
FROM (SELECT unnest(generate_series(min(month), max(month), INTERVAL 1 MONTH)) AS m FROM s) LEFT JOIN s ON s.month=CAST(m AS DATE)""", "total")
def rate_by_month(t):
    return R.period_sums(t.orders, "o_orderdate", "o_totalprice")


@query("weekday_counts", "A22", """
SELECT CAST(d AS INTEGER) AS weekday, ['Monday','Tuesday','Wednesday','Thursday','Friday','Saturday','Sunday'][d+1] AS day_name, count(o_orderkey) AS n
FROM range(7) r(d) LEFT JOIN orders ON isodow(o_orderdate)-1=d GROUP BY ALL""")
def weekday_counts(t):
    return R.weekday_counts(t.orders, "o_orderdate")


_BALANCE_BINS = "CASE WHEN c_acctbal>-1000 AND c_acctbal<=0 THEN 'owing' WHEN c_acctbal>0 AND c_acctbal<=5000 THEN 'small' WHEN c_acctbal>5000 AND c_acctbal<=10000 THEN 'large' END"


@query("cut_rate", "P26 A18 R7", f"""
SELECT {_BALANCE_BINS} AS bin, count(*) AS n, CAST(sum(CAST(c_mktsegment='BUILDING' AS INTEGER)) AS BIGINT) AS hits, avg(CAST(c_mktsegment='BUILDING' AS INTEGER)) AS rate FROM customer GROUP BY 1""", "rate")
def cut_rate(t):
    rows = t.customer.select(
        S.cut("c_acctbal", [-1000, 0, 5000, 10000], ["owing", "small", "large"]).alias("bin"),
        S.flag(F.col("c_mktsegment") == "BUILDING").alias("label"))
    return R.rate_by(rows, ["bin"], "label")


@query("qcut_rate", "P28 A18 R8", f"""
WITH e AS (SELECT list_distinct([{', '.join(f'quantile_cont(o_totalprice,{i / 8})' for i in range(9))}]) AS edges FROM orders),
b AS (SELECT CAST(greatest(least(len(list_filter(edges, lambda x: x < o_totalprice))-1, len(edges)-2), 0) AS INTEGER) AS bin, label FROM ({LABELLED}), e)
SELECT bin, count(*) AS n, CAST(sum(label) AS BIGINT) AS hits, avg(label) AS rate FROM b GROUP BY 1""", "rate")
def qcut_rate(t):
    rows = labelled_orders(t)
    return R.rate_by(E.apply_quantile_bins(rows, E.fit_quantile_edges(rows, "o_totalprice", 8), "o_totalprice", "bin"), ["bin"], "label")


@query("crosstab_share", "A19 A20", """
WITH p AS (SELECT o_orderpriority, count(*) FILTER (o_orderstatus='F')*1.0 AS f, count(*) FILTER (o_orderstatus='O')*1.0 AS o, count(*) FILTER (o_orderstatus='P')*1.0 AS p FROM orders GROUP BY 1)
SELECT o_orderpriority, f/(f+o+p) AS "F", o/(f+o+p) AS "O", p/(f+o+p) AS "P" FROM p""", "F O P")
def crosstab_share(t):
    table = R.contingency(t.orders, "o_orderpriority", "o_orderstatus", ["F", "O", "P"])
    return R.row_shares(table, ["F", "O", "P"])


PART_TYPES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]


@query("crosstab", "A19", """
SELECT p_brand, """ + ", ".join(f"""count(*) FILTER (p_type='{k}') AS "{k}\"""" for k in PART_TYPES) + " FROM part GROUP BY 1")
def crosstab(t):
    return R.contingency(t.part, "p_brand", "p_type", PART_TYPES)


@query("class_share", "A20 W18", """
SELECT c_nationkey, c_mktsegment, count(*) AS n, count(*)*1.0/sum(count(*)) OVER (PARTITION BY c_nationkey) AS share FROM customer GROUP BY 1,2""", "share")
def class_share(t):
    return R.share_within(t.customer, "c_nationkey", "c_mktsegment")


_CLASS_COLS = ["o_totalprice", "o_custkey"]


@query("class_means", "A27", " UNION ALL ".join(
    f"""SELECT '{c}' AS "column", avg({c}) FILTER (label=1) AS mean_1, avg({c}) FILTER (label=0) AS mean_0,
    100*(avg({c}) FILTER (label=1)-avg({c}) FILTER (label=0))/(avg({c}) FILTER (label=0)+1e-9) AS diff_pct FROM ({LABELLED})""" for c in _CLASS_COLS), "mean_1 mean_0 diff_pct")
def class_means(t):
    return R.class_means(labelled_orders(t), _CLASS_COLS, "label")


@query("class_medians", "A30", """
SELECT l_returnflag, median(l_extendedprice) AS l_extendedprice_median, median(l_quantity) AS l_quantity_median FROM lineitem GROUP BY 1""", "l_extendedprice_median l_quantity_median")
def class_medians(t):
    return R.class_medians(t.lineitem, ["l_extendedprice", "l_quantity"], "l_returnflag")


@query("entity_spread", "A28", """
SELECT user_id, avg(value) AS mean, stddev_samp(value) AS std, min(value) AS min, max(value) AS max, count(value) AS n FROM events GROUP BY 1""", "mean std min max")
def entity_spread(t):
    return R.entity_spread(t.events, "user_id", "value").orderBy(F.desc("mean"))


@query("cohort_spread", "A29", """
SELECT CAST(year(o_orderdate) AS INTEGER) AS fiscal_year, avg(o_totalprice) AS mean, stddev_samp(o_totalprice) AS std, min(o_totalprice) AS min, max(o_totalprice) AS max, count(*) AS n FROM orders GROUP BY 1""", "mean std min max")
def cohort_spread(t):
    return R.entity_spread(t.orders.withColumn("fiscal_year", F.year("o_orderdate")), "fiscal_year", "o_totalprice")


@query("majority_class", "A26 R6", """
SELECT o_custkey, o_orderstatus AS majority FROM (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) i FROM orders GROUP BY 1,2) WHERE i=1""")
def majority_class(t):
    return R.majority_label(t.orders, "o_custkey", "o_orderstatus")


@query("popularity_share", "A24", """
WITH c AS (SELECT l_partkey, count(*) n FROM lineitem GROUP BY 1), r AS (SELECT n, row_number() OVER (ORDER BY n DESC, l_partkey) i, count(*) OVER () k FROM c)
SELECT max(k) AS n_items, count(*) FILTER (i<=floor(k*0.2)) AS n_head, sum(n) FILTER (i<=floor(k*0.2))*1.0/sum(n) AS head_share FROM r""", "head_share")
def popularity_share(t):
    return R.head_share(t.lineitem, "l_partkey")


@query("pair_sparsity", "A23", """
SELECT CAST(sum(k) AS BIGINT) AS n_pairs, avg(k) AS mean_per_row, 1-sum(k)*1.0/((SELECT count(*) FROM customer)*(SELECT count(*) FROM part)) AS sparsity
FROM (SELECT o_custkey, count(DISTINCT l_partkey) k FROM lineitem JOIN orders ON l_orderkey=o_orderkey WHERE l_returnflag<>'R' GROUP BY 1)""", "mean_per_row sparsity")
def pair_sparsity(t):
    buys = R.attach(t.lineitem.where("l_returnflag <> 'R'").select("l_orderkey", "l_partkey"), t.orders, {"l_orderkey": "o_orderkey"}, ["o_custkey"], "inner")
    size = lambda df: df.agg(F.count(F.lit(1))).scalar()
    return R.pair_sparsity(buys, "o_custkey", "l_partkey", size(t.customer), size(t.part))


@query("group_quantile_label", "A31", """
WITH q AS (SELECT year(o_orderdate) y, quantile_cont(o_totalprice,0.4) lo, quantile_cont(o_totalprice,0.6) hi FROM orders GROUP BY 1)
SELECT o_orderkey, CASE WHEN o_totalprice>=hi THEN 1 ELSE 0 END AS outperform FROM orders JOIN q ON year(o_orderdate)=y WHERE o_totalprice>=hi OR o_totalprice<=lo""")
def group_quantile_label(t):
    rows = t.orders.withColumn("fiscal_year", F.year("o_orderdate"))
    return R.quantile_labels(rows, "fiscal_year", "o_totalprice", name="outperform").select("o_orderkey", "outperform")


def _anova(c):
    return f"""SELECT '{c}' AS "column", (b/(k-1))/(w/(n-k)) AS f_value, CAST(n AS BIGINT) AS n FROM (
  SELECT sum(n) n, count(*) k, sum(w) w, sum(n*m*m)-sum(n*m)**2/sum(n) b FROM (
  SELECT count({c}) n, avg({c}) m, var_pop({c})*count({c}) w FROM lineitem GROUP BY l_returnflag))"""


@query("anova_f", "A32", _anova("l_quantity") + " UNION ALL " + _anova("l_extendedprice"), "f_value")
def anova_f(t):
    return R.anova_f(t.lineitem, ["l_quantity", "l_extendedprice"], "l_returnflag")


# --- statement histories ----------------------------------------------------

ORDER = ["ts", "event_id"]
STATEMENTS = """(SELECT user_id, ts, event_id, CASE WHEN event_type<>'error' THEN value END AS v, CASE WHEN event_type='purchase' THEN floor(value) END AS b FROM events) s"""


def statements(t):
    kind = F.col("event_type")
    return t.events.select(
        "user_id", "ts", "event_id", F.when(kind != "error", F.col("value")).alias("v"),
        F.when(kind == "purchase", F.floor("value").cast("double")).alias("b"))


def _stat_sql(c):
    last = f"arg_max({c}, (ts,event_id)) FILTER ({c} IS NOT NULL)"
    first = f"arg_min({c}, (ts,event_id)) FILTER ({c} IS NOT NULL)"
    return f"""avg({c}) AS {c}__mean, stddev_samp({c}) AS {c}__std, min({c}) AS {c}__min, max({c}) AS {c}__max, coalesce(sum({c}),0) AS {c}__sum,
    {last} AS {c}__last, {last}-{first} AS {c}__diff_last_first, {last}-avg({c}) AS {c}__diff_last_mean"""


@query("statement_aggregates", "A5 A6 R5 W11 J9", f"SELECT user_id, {_stat_sql('v')}, {_stat_sql('b')} FROM {STATEMENTS} GROUP BY 1",
       " ".join(f"{c}__{s}" for c in "vb" for s in ("mean", "std", "min", "max", "sum", "last", "diff_last_first", "diff_last_mean")))
def statement_aggregates(t):
    return H.statement_aggregates(statements(t), "user_id", ORDER, ["v", "b"])


@query("diff_features", "A6", f"""
SELECT user_id, arg_max(v,(ts,event_id)) FILTER (v IS NOT NULL)-arg_min(v,(ts,event_id)) FILTER (v IS NOT NULL) AS v__diff_last_first FROM {STATEMENTS} GROUP BY 1""", "v__diff_last_first")
def diff_features(t):
    return H.statement_aggregates(statements(t), "user_id", ORDER, ["v"]).select("user_id", "v__diff_last_first")


def _recent(c, n):
    f = f"FILTER (i<={n})"
    return f"avg({c}) {f} AS {c}__last{n}_mean, coalesce(stddev_samp({c}) {f},0) AS {c}__last{n}_std, min({c}) {f} AS {c}__last{n}_min, max({c}) {f} AS {c}__last{n}_max"


@query("last_n_stats", "A7 W8", f"""
SELECT user_id, {_recent('v', 3)}, {_recent('v', 6)} FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) i FROM {STATEMENTS}) GROUP BY 1""",
       " ".join(f"v__last{n}_{s}" for n in (3, 6) for s in ("mean", "std", "min", "max")))
def last_n_stats(t):
    return H.recent_statistics(statements(t), "user_id", ORDER, ["v"])


@query("missing_features", "A8", f"""
SELECT user_id, count(*) AS fe_stmt_count, CAST(count(v)=0 AS INTEGER)+CAST(count(b)=0 AS INTEGER) AS fe_last_miss_count,
 CAST(count(v)=0 AS INTEGER)+CAST(count(b)=0 AS INTEGER) AS fe_all_null_count, count(DISTINCT b) AS fe_nuniq_b FROM {STATEMENTS} GROUP BY 1""")
def missing_features(t):
    return H.missingness(statements(t), "user_id", ORDER, ["v", "b"], ["b"])


@query("user_rank", "W7 R3", f"""
WITH r AS (SELECT user_id, ts, event_id, v, (rank() OVER (PARTITION BY user_id ORDER BY v)+(count(*) OVER (PARTITION BY user_id, v)-1)/2.0)/count(*) OVER (PARTITION BY user_id) AS p
 FROM {STATEMENTS} WHERE v IS NOT NULL)
SELECT e.user_id, coalesce(p,0.5) AS v__user_rank FROM (SELECT DISTINCT user_id FROM events) e LEFT JOIN (SELECT user_id, arg_max(p,(ts,event_id)) p FROM r GROUP BY 1) u ON u.user_id=e.user_id""", "v__user_rank")
def user_rank(t):
    return H.own_history_rank(statements(t), "user_id", ORDER, "v")


@query("global_rank", "W9", """
WITH m AS (SELECT user_id, avg(value) a FROM events GROUP BY 1), tr AS (SELECT avg(value) a FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id)
SELECT user_id, (SELECT count(*) FROM tr WHERE tr.a<m.a)*1.0/(SELECT count(*) FROM tr) AS v__global_rank FROM m""", "v__global_rank")
def global_rank(t):
    means = lambda df: df.groupBy("user_id").agg(F.avg("value").alias("a"))
    fit = H.fit_global_rank(means(t.events.where("ts < timestamp_ntz '2024-01-16'")), "a")
    return H.apply_global_rank(means(t.events), fit, "user_id", "a", "v__global_rank").select("user_id", "v__global_rank")


@query("sequence_trend", "A25 W12", """
WITH n AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS seq, count(*) OVER (PARTITION BY o_custkey) k FROM orders)
SELECT CAST(seq AS INTEGER) AS seq, o_orderstatus, avg(o_totalprice) AS o_totalprice_mean, count(*) AS n FROM n WHERE k=13 GROUP BY ALL""", "o_totalprice_mean")
def sequence_trend(t):
    return H.sequence_trend(t.orders, "o_custkey", ["o_orderdate", "o_orderkey"], ["o_totalprice"], "o_orderstatus", 13)


@query("rate_by_history_length", "A17 F27", """
SELECT k AS n_stmts, count(*) AS n, CAST(sum(label) AS BIGINT) AS hits, avg(label) AS rate FROM (SELECT o_custkey, count(*) k FROM orders GROUP BY 1)
JOIN (SELECT c_custkey, CAST(c_acctbal<0 AS INTEGER) label FROM customer) ON o_custkey=c_custkey GROUP BY 1""", "rate")
def rate_by_history_length(t):
    sizes = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n_stmts"))
    labels = t.customer.select("c_custkey", S.flag(F.col("c_acctbal") < 0).alias("label"))
    return R.rate_by(R.attach(sizes, labels, {"o_custkey": "c_custkey"}, how="inner"), ["n_stmts"], "label")


@query("denoise", "P16", "SELECT event_id, floor(value*100)/100 AS value FROM events", "value")
def denoise(t):
    return C.floor_columns(t.events.select("event_id", "value"), ["value"])


# --- subscriber aggregates --------------------------------------------------

PAYMENTS = """(SELECT o_custkey AS user_id, l_extendedprice AS listed, l_extendedprice*(1-l_discount) AS paid, l_quantity AS days, CAST(l_linestatus='O' AS INTEGER) AS renew,
 CAST(l_returnflag='R' AS INTEGER) AS cancel, CAST(l_shipdate AS DATE) AS expires, CAST(o_orderdate AS DATE) AS dated FROM lineitem JOIN orders ON l_orderkey=o_orderkey) p"""


def payments(t):
    rows = R.attach(t.lineitem, t.orders, {"l_orderkey": "o_orderkey"}, ["o_custkey", "o_orderdate"], "inner")
    return rows.select(
        F.col("o_custkey").alias("user_id"), F.col("l_extendedprice").alias("listed"),
        (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("paid"), F.col("l_quantity").alias("days"),
        S.flag(F.col("l_linestatus") == "O").alias("renew"), S.flag(F.col("l_returnflag") == "R").alias("cancel"),
        F.to_date("l_shipdate").alias("expires"), F.to_date("o_orderdate").alias("dated"))


@query("subscription_aggregate", "A1", f"""
SELECT user_id, count(*) AS txn_count, avg(days) AS plan_days_mean, avg(listed) AS plan_price_mean, avg(paid) AS actual_paid_mean, avg(renew) AS auto_renew_rate,
 avg(cancel) AS cancel_rate, max(expires) AS last_expire_date, max(dated) AS last_txn_date, 1-sum(paid)/nullif(sum(listed),0) AS discount_rate FROM {PAYMENTS} GROUP BY 1""",
       "plan_days_mean plan_price_mean actual_paid_mean auto_renew_rate cancel_rate discount_rate")
def subscription_aggregate(t):
    return R.subscription_aggregate(payments(t), "user_id", "listed", "paid", "days", "renew", "cancel", "expires", "dated")


DAILY = """(SELECT user_id, CAST(ts AS DATE) AS d, CAST(count(*) FILTER (event_type='click') AS DOUBLE) AS num_25, CAST(count(*) FILTER (event_type='view') AS DOUBLE) AS num_100,
 CAST(count(DISTINCT event_type) AS DOUBLE) AS num_unq, sum(value) AS total_secs FROM events GROUP BY 1,2) d"""


def daily_log(t):
    kind = F.col("event_type")
    return t.events.groupBy("user_id", F.to_date("ts").alias("d")).agg(
        F.count_if(kind == "click").cast("double").alias("num_25"), F.count_if(kind == "view").cast("double").alias("num_100"),
        F.countDistinct(kind).cast("double").alias("num_unq"), F.sum("value").alias("total_secs"))


@query("log_aggregate", "A2 S16", f"""
SELECT user_id, count(*) AS log_days, avg(num_25) AS num_25_mean, avg(num_100) AS num_100_mean, avg(num_unq) AS num_unq_mean, avg(total_secs) AS total_secs_mean, sum(total_secs) AS total_secs_sum
FROM {DAILY} GROUP BY 1""", "num_25_mean num_100_mean num_unq_mean total_secs_mean total_secs_sum")
def log_aggregate(t):
    return R.log_aggregate(daily_log(t), "user_id", ["num_25", "num_100", "num_unq", "total_secs"], ["total_secs"])
