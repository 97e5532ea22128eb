"""Transaction features: calendar, velocity, card statistics, encoders, imputation."""

from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators import columns as C
from ledgerlens.operators import encode as E
from ledgerlens.operators import history as H
from ledgerlens.plans.registry import query

EPOCH = "1995-01-01"
TRAIN_BEFORE = "2000-01-01"


def labelled_orders(t):
    return t.orders.withColumn("label", S.flag(F.col("o_orderstatus") == "F"))


def train(df):
    return df.where(F.col("o_orderdate") < F.lit(TRAIN_BEFORE).cast("timestamp_ntz"))


def orders_with_customer(t):
    return labelled_orders(t).join(t.customer, F.col("o_custkey") == F.col("c_custkey"), "left")


LABELLED = "SELECT *, CAST(o_orderstatus='F' AS INTEGER) AS label FROM orders"
JOINED = f"SELECT * FROM ({LABELLED}) o LEFT JOIN customer ON o_custkey=c_custkey"
IS_TRAIN = f"o_orderdate < TIMESTAMP '{TRAIN_BEFORE}'"


@query("rate_by_weekday", "P6 A17 A22", """
SELECT CAST(isodow(o_orderdate)-1 AS INTEGER) AS weekday, dayname(o_orderdate) AS day_name,
       count(*) AS n, CAST(sum(label) AS BIGINT) AS hits, avg(label) AS rate
FROM (""" + LABELLED + """) GROUP BY ALL""", "rate")
def rate_by_weekday(t):
    return (
        labelled_orders(t)
        .groupBy(F.weekday("o_orderdate").alias("weekday"), F.date_format("o_orderdate", "EEEE").alias("day_name"))
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"), F.avg("label").alias("rate"))
        .orderBy("weekday")
    )


@query("rate_by_category", "A17 T1", """
SELECT o_orderpriority, count(*) AS n, CAST(sum(label) AS BIGINT) AS hits, avg(label) AS rate
FROM (""" + LABELLED + """) GROUP BY ALL""", "rate")
def rate_by_category(t):
    return (
        labelled_orders(t).groupBy("o_orderpriority")
        .agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("hits"), F.avg("label").alias("rate"))
        .orderBy(F.desc("rate"), "o_orderpriority")
    )


@query("calendar_parts", "P6 P7", """
SELECT event_id, CAST(hour(ts) AS INTEGER) AS fe_hour, CAST(isodow(ts)-1 AS INTEGER) AS fe_day_of_week,
  CAST(isodow(ts)>=6 AS INTEGER) AS fe_is_weekend, CAST(hour(ts)>=22 OR hour(ts)<=6 AS INTEGER) AS fe_is_nighttime,
  sin(2*pi()*hour(ts)/24) AS fe_hour_sin, cos(2*pi()*hour(ts)/24) AS fe_hour_cos,
  sin(2*pi()*(isodow(ts)-1)/7) AS fe_dow_sin, cos(2*pi()*(isodow(ts)-1)/7) AS fe_dow_cos,
  (epoch_us(ts)-epoch_us(TIMESTAMP '2024-01-01'))/86400000000.0 AS fe_days_since_start
FROM events""", "fe_hour_sin fe_hour_cos fe_dow_sin fe_dow_cos fe_days_since_start")
def calendar_parts(t):
    return C.calendar_parts(t.events.select("event_id", "ts"), "ts", "2024-01-01").drop("ts")


@query("event_time", "P6", """
SELECT o_orderkey, CAST(hour(e) AS INTEGER) AS event_hour, CAST(e AS DATE) AS event_date
FROM (SELECT o_orderkey, TIMESTAMP '2017-12-01' + to_seconds(CAST(floor(o_totalprice*60) AS BIGINT)) AS e FROM orders)""")
def event_time(t):
    rows = t.orders.select("o_orderkey", F.floor(F.col("o_totalprice") * 60).alias("seconds"))
    timed = C.event_time(rows, "seconds", "2017-12-01")
    return timed.select("o_orderkey", F.hour("event_time").alias("event_hour"), F.to_date("event_time").alias("event_date"))


DECILES = """SELECT list_distinct([""" + ", ".join(
    f"quantile_cont(o_totalprice, {i / 10})" for i in range(11)
) + """]) AS edges FROM orders WHERE """ + IS_TRAIN


@query("amount_parts", "P8 P9 P28 E5 E8", f"""
WITH d AS ({DECILES}),
p AS (SELECT o_orderpriority, row_number() OVER (ORDER BY o_orderpriority)-1 AS code
      FROM (SELECT DISTINCT o_orderpriority FROM orders WHERE {IS_TRAIN}))
SELECT o_orderkey, ln(1+o_totalprice) AS fe_log_amount, o_totalprice % 1 AS fe_amount_cents,
  CAST(o_totalprice % 1 = 0 AS INTEGER) AS fe_amount_is_round,
  CAST(greatest(least(len(list_filter(edges, lambda e: e < o_totalprice))-1, len(edges)-2), 0) AS INTEGER) AS fe_amount_decile,
  ln(1+o_totalprice)*greatest(coalesce(code, 0), 0) AS fe_amount_x_product
FROM orders LEFT JOIN p USING (o_orderpriority), d""", "fe_log_amount fe_amount_cents fe_amount_x_product")
def amount_parts(t):
    orders = t.orders
    fit = train(orders)
    out = C.amount_parts(orders.select("o_orderkey", "o_totalprice", "o_orderpriority"), "o_totalprice")
    out = E.apply_quantile_bins(out, E.fit_quantile_edges(fit, "o_totalprice", 10), "o_totalprice", "fe_amount_decile")
    out = E.apply_ordinal(out, E.fit_ordinal(fit, "o_orderpriority"), "o_orderpriority", "_code")
    out = out.withColumn("fe_amount_x_product", F.col("fe_log_amount") * F.greatest(F.col("_code"), F.lit(0)))
    return out.drop("o_totalprice", "o_orderpriority", "_code")


@query("velocity_card", "W1 W2 W3", f"""
SELECT o_orderkey,
  row_number() OVER c - 1 AS fe_card_txn_count,
  sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS fe_card_cum_amount,
  (row_number() OVER c - 1) / greatest((epoch_us(o_orderdate)-epoch_us(TIMESTAMP '{EPOCH}'))/86400000000.0, 1.0) AS fe_card_txn_freq,
  CASE WHEN c_nationkey IS NOT NULL THEN row_number() OVER (PARTITION BY c_nationkey ORDER BY o_orderdate, o_orderkey) - 1 END AS fe_addr_txn_count,
  CASE WHEN c_mktsegment IS NOT NULL THEN row_number() OVER (PARTITION BY c_mktsegment ORDER BY o_orderdate, o_orderkey) - 1 END AS fe_email_txn_count
FROM ({JOINED}) WINDOW c AS (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey)""",
       "fe_card_cum_amount fe_card_txn_freq")
def velocity_card(t):
    rows = orders_with_customer(t).select("o_orderkey", "o_custkey", "o_orderdate", "o_totalprice", "c_nationkey", "c_mktsegment")
    return H.velocity_features(
        rows, "o_orderdate", "o_orderkey", "o_totalprice",
        {"card": "o_custkey", "addr": "c_nationkey", "email": "c_mktsegment"}, EPOCH,
    )


@query("velocity_by_split", "W1 W2 W3", f"""
SELECT o_orderkey, row_number() OVER c - 1 AS fe_card_txn_count,
  sum(o_totalprice) OVER (PARTITION BY o_custkey, split ORDER BY o_orderdate, o_orderkey ROWS UNBOUNDED PRECEDING) AS fe_card_cum_amount,
  (row_number() OVER c - 1) / greatest((epoch_us(o_orderdate)-epoch_us(TIMESTAMP '{EPOCH}'))/86400000000.0, 1.0) AS fe_card_txn_freq
FROM (SELECT *, CASE WHEN {IS_TRAIN} THEN 'train' ELSE 'val' END AS split FROM orders)
WINDOW c AS (PARTITION BY o_custkey, split ORDER BY o_orderdate, o_orderkey)""", "fe_card_cum_amount fe_card_txn_freq")
def velocity_by_split(t):
    rows = t.orders.select(
        "o_orderkey", "o_custkey", "o_orderdate", "o_totalprice",
        F.when(F.col("o_orderdate") < F.lit(TRAIN_BEFORE).cast("timestamp_ntz"), "train").otherwise("val").alias("split"),
    )
    out = H.velocity(rows, "o_orderdate", "o_orderkey", "o_totalprice", {"card": "o_custkey"}, EPOCH, history="split")
    return out.select("o_orderkey", *[c for c in out.columns if c.startswith("fe_")])


@query("card_stats_zscore", "A3 J8", f"""
WITH s AS (SELECT o_custkey, avg(o_totalprice) m, coalesce(stddev_samp(o_totalprice),0) sd, count(o_totalprice)::DOUBLE n,
             avg(month(o_orderdate)) h FROM orders WHERE {IS_TRAIN} GROUP BY 1),
g AS (SELECT sum(m*n)/sum(n) m, sum(sd*n)/sum(n) sd, sum(n*n)/sum(n) n, sum(h*n)/sum(n) h FROM s),
j AS (SELECT o_orderkey, o_totalprice, coalesce(s.m,g.m) AS fe_card_mean_amt, coalesce(s.sd,g.sd) AS fe_card_std_amt,
        coalesce(s.n,g.n) AS fe_card_n_txn, coalesce(s.h,g.h) AS fe_card_mean_hour
      FROM orders LEFT JOIN s USING (o_custkey), g)
SELECT o_orderkey, fe_card_mean_amt, fe_card_std_amt, fe_card_n_txn, fe_card_mean_hour,
  (o_totalprice-fe_card_mean_amt)/(fe_card_std_amt+1e-6) AS fe_card_z_score,
  CAST(o_totalprice>fe_card_mean_amt AS INTEGER) AS fe_card_above_mean FROM j""",
       "fe_card_mean_amt fe_card_std_amt fe_card_n_txn fe_card_mean_hour fe_card_z_score")
def card_stats_zscore(t):
    # the month stands in for the hour: order times carry no hour
    orders = t.orders.withColumn("period", F.month("o_orderdate"))
    stats = H.fit_amount_stats(train(orders), "o_custkey", "o_totalprice", "fe_card", hour="period")
    out = H.apply_amount_stats(orders, stats, "o_custkey", "fe_card", amount="o_totalprice")
    return out.select("o_orderkey", *[c for c in out.columns if c.startswith("fe_")])


def _extra(col, short):
    return f"""{short} AS (SELECT {col}, avg(o_totalprice) m, coalesce(stddev_samp(o_totalprice),0) sd, count(*)::DOUBLE n, avg(label) r
  FROM j WHERE {IS_TRAIN} AND {col} IS NOT NULL GROUP BY 1),
g{short} AS (SELECT sum(m*n)/sum(n) m, sum(sd*n)/sum(n) sd, sum(n*n)/sum(n) n, sum(r*n)/sum(n) r FROM {short})"""


@query("extra_card_aggregates", "A4", f"""
WITH j AS ({JOINED}), {_extra('c_mktsegment', 'a')}, {_extra('c_nationkey', 'b')}, {_extra('o_orderpriority', 'c')}
SELECT o_orderkey,
 coalesce(a.m,ga.m) fe_card2_mean_amt, coalesce(a.sd,ga.sd) fe_card2_std_amt, coalesce(a.n,ga.n) fe_card2_n_txn, coalesce(a.r,ga.r) fe_card2_rate,
 coalesce(b.m,gb.m) fe_card4_mean_amt, coalesce(b.sd,gb.sd) fe_card4_std_amt, coalesce(b.n,gb.n) fe_card4_n_txn, coalesce(b.r,gb.r) fe_card4_rate,
 coalesce(c.m,gc.m) fe_card6_mean_amt, coalesce(c.sd,gc.sd) fe_card6_std_amt, coalesce(c.n,gc.n) fe_card6_n_txn, coalesce(c.r,gc.r) fe_card6_rate
FROM j LEFT JOIN a USING (c_mktsegment) LEFT JOIN b USING (c_nationkey) LEFT JOIN c USING (o_orderpriority), ga, gb, gc""",
       " ".join(f"fe_card{i}_{s}" for i in (2, 4, 6) for s in ("mean_amt", "std_amt", "n_txn", "rate")))
def extra_card_aggregates(t):
    out = rows = orders_with_customer(t).select(
        "o_orderkey", "o_orderdate", "o_totalprice", "label", "c_mktsegment", "c_nationkey", "o_orderpriority"
    )
    for prefix, key in (("fe_card2", "c_mktsegment"), ("fe_card4", "c_nationkey"), ("fe_card6", "o_orderpriority")):
        stats = H.fit_amount_stats(train(rows), key, "o_totalprice", prefix, target="label")
        out = H.apply_amount_stats(out, stats, key, prefix)
    return out.select("o_orderkey", *[c for c in out.columns if c.startswith("fe_")])


@query("target_encode_smoothed", "E1 J8", f"""
WITH j AS ({JOINED}), g AS (SELECT avg(label) m FROM j WHERE {IS_TRAIN}),
s AS (SELECT c_nationkey, sum(label) h, count(*) n FROM j WHERE {IS_TRAIN} AND c_nationkey IS NOT NULL GROUP BY 1)
SELECT o_orderkey, coalesce((h+50*m)/(n+50), m) AS fe_email_rate FROM j LEFT JOIN s USING (c_nationkey), g""", "fe_email_rate")
def target_encode_smoothed(t):
    rows = orders_with_customer(t).select("o_orderkey", "o_orderdate", "label", "c_nationkey")
    stats = E.fit_target_rate(train(rows), ["c_nationkey"], "label", smoothing=50)
    return E.apply_target_rate(rows, stats, ["c_nationkey"], "fe_email_rate").select("o_orderkey", "fe_email_rate")


@query("target_encode_mean", "E2 J8", f"""
WITH j AS ({LABELLED}), g AS (SELECT avg(label) m FROM j WHERE {IS_TRAIN}),
s AS (SELECT o_custkey, avg(label) r FROM j WHERE {IS_TRAIN} GROUP BY 1)
SELECT o_orderkey, coalesce(r, m) AS fe_te_custkey FROM j LEFT JOIN s USING (o_custkey), g""", "fe_te_custkey")
def target_encode_mean(t):
    rows = labelled_orders(t)
    stats = E.fit_target_rate(train(rows), ["o_custkey"], "label")
    return E.apply_target_rate(rows, stats, ["o_custkey"], "fe_te_custkey").select("o_orderkey", "fe_te_custkey")


@query("uid_rate", "E3", f"""
WITH j AS (SELECT *, concat_ws('_', coalesce(CAST(o_custkey AS VARCHAR),'NA'), coalesce(CAST(c_nationkey AS VARCHAR),'NA')) uid2,
  concat_ws('_', coalesce(CAST(o_custkey AS VARCHAR),'NA'), coalesce(CAST(c_nationkey AS VARCHAR),'NA'), coalesce(o_orderpriority,'NA')) uid3
  FROM ({JOINED})), g AS (SELECT avg(label) m FROM j WHERE {IS_TRAIN}),
a AS (SELECT uid2, avg(label) r, count(*) n FROM j WHERE {IS_TRAIN} GROUP BY 1),
b AS (SELECT uid3, avg(label) r FROM j WHERE {IS_TRAIN} GROUP BY 1)
SELECT o_orderkey, coalesce(a.r, m) AS fe_uid2_rate, coalesce(a.n, 0) AS fe_uid2_txn_count, coalesce(b.r, m) AS fe_uid3_rate
FROM j LEFT JOIN a USING (uid2) LEFT JOIN b USING (uid3), g""", "fe_uid2_rate fe_uid3_rate")
def uid_rate(t):
    rows = orders_with_customer(t).select(
        "o_orderkey", "o_orderdate", "label",
        E.composite_key(["o_custkey", "c_nationkey"]).alias("uid2"),
        E.composite_key(["o_custkey", "c_nationkey", "o_orderpriority"]).alias("uid3"),
    )
    fit = train(rows)
    out = E.apply_target_rate(rows, E.fit_target_rate(fit, ["uid2"], "label"), ["uid2"], "fe_uid2_rate", "fe_uid2_txn_count")
    out = E.apply_target_rate(out, E.fit_target_rate(fit, ["uid3"], "label"), ["uid3"], "fe_uid3_rate")
    return out.select("o_orderkey", "fe_uid2_rate", "fe_uid2_txn_count", "fe_uid3_rate")


@query("freq_encode", "E4", """
WITH f AS (SELECT c_mktsegment, count(*)*1.0/sum(count(*)) OVER () AS share FROM customer WHERE c_acctbal < 8000 GROUP BY 1)
SELECT c_custkey, coalesce(share,0) AS segment_freq FROM customer LEFT JOIN f USING (c_mktsegment)""", "segment_freq")
def freq_encode(t):
    rows = t.customer
    stats = E.fit_frequency(rows.where("c_acctbal < 8000"), "c_mktsegment")
    return E.apply_frequency(rows, stats, "c_mktsegment", "segment_freq").select("c_custkey", "segment_freq")


@query("ordinal_encode", "E5 E6 R20", """
WITH f AS (SELECT c_nationkey, row_number() OVER (ORDER BY c_nationkey)-1 AS code FROM
   (SELECT DISTINCT c_nationkey FROM customer WHERE c_acctbal < 8000 AND c_nationkey<>7)),
h AS (SELECT c_name, row_number() OVER (ORDER BY c_name)-1 AS code FROM (SELECT DISTINCT c_name FROM customer WHERE c_acctbal < 8000))
SELECT c_custkey, coalesce(f.code,-1) AS nation_ord, coalesce(h.code,-1) AS name_ord
FROM customer LEFT JOIN f USING (c_nationkey) LEFT JOIN h USING (c_name)""")
def ordinal_encode(t):
    rows = t.customer
    fit = rows.where("c_acctbal < 8000")
    out = E.apply_ordinal(rows, E.fit_ordinal(fit.where("c_nationkey <> 7"), "c_nationkey"), "c_nationkey", "nation_ord")
    out = E.apply_ordinal(out, E.fit_ordinal(fit, "c_name"), "c_name", "name_ord")
    return out.select("c_custkey", "nation_ord", "name_ord")


@query("onehot_topk", "E7 P30 T2", """
WITH k AS (SELECT c_mktsegment FROM customer GROUP BY 1 ORDER BY count(*) DESC, c_mktsegment LIMIT 3),
r AS (SELECT c_mktsegment, row_number() OVER (ORDER BY n DESC, c_mktsegment) i FROM (SELECT c_mktsegment, count(*) n FROM customer GROUP BY 1))
SELECT c_custkey, CASE WHEN c_mktsegment IN (FROM k) THEN c_mktsegment ELSE 'Other' END AS segment_kept,
 CAST(i=1 AS INTEGER) AS top_1, CAST(i=2 AS INTEGER) AS top_2, CAST(i=3 AS INTEGER) AS top_3, CAST(i>3 AS INTEGER) AS top_other
FROM customer JOIN r USING (c_mktsegment)""")
def onehot_topk(t):
    rows = t.customer
    top = E.fit_top_values(rows, "c_mktsegment", 3)
    out = C.one_hot(rows, "c_mktsegment", top, "seg", "Other")
    return out.select(
        "c_custkey",
        C.keep_values("c_mktsegment", top).alias("segment_kept"),
        *[F.col(f"`seg_{v}`").alias(f"top_{i}") for i, v in enumerate(top, 1)],
        F.col("seg_Other").alias("top_other"),
    )


@query("match_flags", "P15 R15", """
WITH m AS (SELECT o_orderkey, CASE WHEN o_orderstatus='F' THEN 'T' WHEN o_orderstatus='O' THEN 'F' END m1,
   CASE WHEN o_orderpriority IN ('1-URGENT','2-HIGH') THEN 'T' WHEN o_orderpriority<>'5-LOW' THEN 'F' END m2 FROM orders)
SELECT o_orderkey, CASE m1 WHEN 'T' THEN 1 WHEN 'F' THEN 0 ELSE -1 END AS fe_m1, CASE m2 WHEN 'T' THEN 1 WHEN 'F' THEN 0 ELSE -1 END AS fe_m2,
  CAST(coalesce(m1='T',false) AS INTEGER)+CAST(coalesce(m2='T',false) AS INTEGER) AS fe_match_score FROM m""")
def match_flags(t):
    status, urgency = F.col("o_orderstatus"), F.col("o_orderpriority")
    rows = t.orders.select(
        "o_orderkey",
        F.when(status == "F", "T").when(status == "O", "F").alias("M1"),
        F.when(urgency.isin("1-URGENT", "2-HIGH"), "T").when(urgency != "5-LOW", "F").alias("M2"),
    )
    return C.match_flags(rows, ["M1", "M2"]).drop("M1", "M2")


@query("domain_flags", "P18 P19 P20", """
WITH n AS (SELECT p_brand, count(*) n FROM part WHERE p_size > 15 GROUP BY 1)
SELECT p_partkey, CAST(coalesce(p_brand IN ('Brand#1','Brand#2','Brand#3'),false) AS INTEGER) AS is_listed,
 CAST(coalesce(n,0)<30 AS INTEGER) AS is_rare, CAST(coalesce(p_type=upper(split_part(p_name,' ',1)),false) AS INTEGER) AS is_match
FROM part LEFT JOIN n USING (p_brand)""")
def domain_flags(t):
    rows = t.part.withColumn("first_word", F.upper(F.split_part("p_name", F.lit(" "), F.lit(1))))
    out = C.membership_flag(rows, "p_brand", ["Brand#1", "Brand#2", "Brand#3"], "is_listed")
    out = E.rare_flag(out, E.fit_frequency(rows.where("p_size > 15"), "p_brand"), "p_brand", "is_rare", 30)
    return C.equality_flag(out, "p_type", "first_word", "is_match").select("p_partkey", "is_listed", "is_rare", "is_match")


HOLED = """SELECT c_custkey, c_acctbal < 8000 AS is_train, CASE WHEN c_acctbal>=0 THEN c_acctbal END AS balance,
 CASE WHEN c_nationkey>=4 THEN c_nationkey END AS nation, CASE WHEN c_mktsegment<>'BUILDING' THEN c_mktsegment END AS segment FROM customer"""


def holed_customers(t):
    return t.customer.select(
        "c_custkey",
        (F.col("c_acctbal") < 8000).alias("is_train"),
        F.when(F.col("c_acctbal") >= 0, F.col("c_acctbal")).alias("balance"),
        F.when(F.col("c_nationkey") >= 4, F.col("c_nationkey")).alias("nation"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_mktsegment")).alias("segment"),
    )


@query("impute_median", "I1 P25", f"""
WITH h AS ({HOLED}), s AS (SELECT quantile_cont(balance,0.5) b FROM h WHERE is_train)
SELECT c_custkey, coalesce(balance, b) AS balance FROM h, s""", "balance")
def impute_median(t):
    rows = holed_customers(t)
    stats = E.fit_medians(rows.where("is_train"), ["balance"])
    return E.fill_from(rows, stats, ["balance"]).select("c_custkey", "balance")


@query("impute_infinite", "P25 R12", """
WITH h AS (SELECT o_orderkey, CASE WHEN o_totalprice BETWEEN 50000 AND 450000 THEN o_totalprice END AS x FROM orders),
s AS (SELECT quantile_cont(x,0.5) m FROM h) SELECT o_orderkey, coalesce(x, m) AS x FROM h, s""", "x")
def impute_infinite(t):
    price = F.col("o_totalprice")
    rows = t.orders.select(
        "o_orderkey", F.when(price < 50000, float("nan")).when(price > 450000, float("inf")).otherwise(price).alias("x")
    )
    stats = E.fit_medians(rows.withColumn("x", S.clean("x")), ["x"])
    return E.fill_from(rows, stats, ["x"], treat_inf=True)


@query("impute_mode", "I2 R6", f"""
WITH h AS ({HOLED}),
a AS (SELECT nation FROM h WHERE is_train AND nation IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, nation LIMIT 1),
b AS (SELECT segment FROM h WHERE is_train AND segment IS NOT NULL GROUP BY 1 ORDER BY count(*) DESC, segment LIMIT 1)
SELECT c_custkey, coalesce(h.nation, a.nation) AS nation, coalesce(h.segment, b.segment) AS segment FROM h, a, b""")
def impute_mode(t):
    rows = holed_customers(t)
    stats = E.fit_modes(rows.where("is_train"), ["nation", "segment"])
    return E.fill_from(rows, stats, ["nation", "segment"]).select("c_custkey", "nation", "segment")


@query("clip_quantile", "P5 P4", f"""
WITH h AS ({HOLED}), s AS (SELECT quantile_cont(balance,0.01) lo, quantile_cont(balance,0.99) hi FROM h WHERE is_train)
SELECT c_custkey, CASE WHEN balance IS NOT NULL THEN least(greatest(balance, lo), hi) END AS balance FROM h, s""", "balance")
def clip_quantile(t):
    rows = holed_customers(t)
    stats = E.fit_clip(rows.where("is_train"), ["balance"], 0.01, 0.99)
    return E.apply_clip(rows, stats, ["balance"]).select("c_custkey", "balance")


@query("scale", "Z1", f"""
WITH h AS ({HOLED}), s AS (SELECT avg(balance) m, stddev_pop(balance) sd FROM h WHERE is_train)
SELECT c_custkey, (balance-m)/sd AS balance FROM h, s""", "balance")
def scale(t):
    rows = holed_customers(t)
    stats = E.fit_scale(rows.where("is_train"), ["balance"])
    return E.apply_scale(rows, stats, ["balance"]).select("c_custkey", "balance")
