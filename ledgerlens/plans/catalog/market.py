"""Order-book aggregates, the volatility panel and the frames behind its charts.

A stock is a user, a bucket is a day and the quotes are derived from the event value.
"""

from pyspark.sql import functions as F

from ledgerlens.operators import charts as CH
from ledgerlens.operators import encode as E
from ledgerlens.operators import market as M
from ledgerlens.plans.registry import query

KEYS = ["stock_id", "time_id"]
ORDER = ["ts", "event_id"]

TICKS = """ticks AS (SELECT user_id AS stock_id, CAST(ts AS DATE) AS time_id, ts, event_id, value AS price, length(event_type)*1.0 AS size,
  value AS bid_price1, value+0.5 AS ask_price1, value*0.99 AS bid_price2, value*1.01+0.5 AS ask_price2,
  length(event_type)*1.0 AS bid_size1, 6.0 AS ask_size1, 5.0 AS bid_size2, length(event_type)+1.0 AS ask_size2 FROM events)"""
BOOK = TICKS + """,
w AS (SELECT *, (bid_price1*ask_size1+ask_price1*bid_size1)/(bid_size1+ask_size1) AS w1, (bid_price2*ask_size2+ask_price2*bid_size2)/(bid_size2+ask_size2) AS w2 FROM ticks),
r AS (SELECT *, ln(w1/lag(w1) OVER k) AS r1, ln(w2/lag(w2) OVER k) AS r2, (ask_price1-bid_price1)/((bid_price1+ask_price1)/2) AS spread,
  (bid_size1-ask_size1)/(bid_size1+ask_size1) AS imb FROM w WINDOW k AS (PARTITION BY stock_id, time_id ORDER BY ts, event_id)),
book AS (SELECT stock_id, time_id, avg(w1) AS book_wap_mean, stddev_pop(w1) AS book_wap_std, min(w1) AS book_wap_min, max(w1) AS book_wap_max, max(w1)-min(w1) AS book_wap_range,
  sqrt(coalesce(sum(r1*r1),0)) AS book_rv, sqrt(coalesce(sum(r2*r2),0)) AS book_rv_l2, coalesce(avg(r1),0) AS book_lr_mean, coalesce(stddev_pop(r1),0) AS book_lr_std,
  coalesce(max(abs(r1)),0) AS book_lr_max_abs, avg(spread) AS book_spread_mean, max(spread) AS book_spread_max, avg(imb) AS book_vol_imb_mean, coalesce(stddev_samp(imb),0) AS book_vol_imb_std,
  sum(bid_size1) AS book_bid_size1_sum, sum(ask_size1) AS book_ask_size1_sum, count(*) AS book_n_ticks FROM r GROUP BY 1,2)"""
TRADES = """
tr AS (SELECT *, ln(price/lag(price) OVER (PARTITION BY stock_id, time_id ORDER BY ts, event_id)) AS lr FROM ticks),
trade AS (SELECT stock_id, time_id, sqrt(coalesce(sum(lr*lr),0)) AS trade_rv, avg(price) AS trade_price_mean, stddev_pop(price) AS trade_price_std, sum(size) AS trade_size_sum, avg(size) AS trade_size_mean,
  count(*) AS trade_count, sum(size) AS trade_order_count FROM tr GROUP BY 1,2)"""
PANEL = f"{BOOK}, {TRADES}, panel AS (SELECT * FROM book LEFT JOIN trade USING (stock_id, time_id))"
BOOK_DOUBLES = "book_wap_mean book_wap_std book_wap_min book_wap_max book_wap_range book_rv book_rv_l2 book_lr_mean book_lr_std book_lr_max_abs book_spread_mean book_spread_max book_vol_imb_mean book_vol_imb_std book_bid_size1_sum book_ask_size1_sum"


def ticks(t):
    v, size = F.col("value"), F.length("event_type").cast("double")
    return t.events.select(
        F.col("user_id").alias("stock_id"), F.to_date("ts").alias("time_id"), "ts", "event_id",
        v.alias("price"), size.alias("size"), v.alias("bid_price1"), (v + 0.5).alias("ask_price1"),
        (v * 0.99).alias("bid_price2"), (v * 1.01 + 0.5).alias("ask_price2"), size.alias("bid_size1"), F.lit(6.0).alias("ask_size1"),
        F.lit(5.0).alias("bid_size2"), (size + 1).alias("ask_size2"),
    )


def panel(t):
    rows = ticks(t)
    book = M.aggregate_book(rows.drop("price", "size"), KEYS, ORDER)
    trade = M.aggregate_trades(rows.select(*KEYS, *ORDER, "price", "size"), KEYS, ORDER, orders="size")
    return book.join(trade, KEYS, "left")


def small_panel(t):
    """Daily volatility, spread and imbalance without the tick step."""
    return t.events.groupBy(F.col("user_id").alias("stock_id"), F.to_date("ts").alias("time_id")).agg(
        F.stddev_pop("value").alias("book_rv"), F.avg("value").alias("book_spread_mean"),
        F.avg(F.length("event_type") - 5.0).alias("book_vol_imb_mean"), F.max("value").alias("trade_rv"),
    )


SMALL = """panel AS (SELECT user_id AS stock_id, CAST(ts AS DATE) AS time_id, stddev_pop(value) AS book_rv, avg(value) AS book_spread_mean,
  avg(length(event_type)-5.0) AS book_vol_imb_mean, max(value) AS trade_rv FROM events GROUP BY 1,2)"""
SMALL_DOUBLES = "book_rv book_spread_mean book_vol_imb_mean trade_rv"


@query("tick_book", "A14 W10", f"WITH {BOOK} SELECT * FROM book", BOOK_DOUBLES)
def tick_book(t):
    return M.aggregate_book(ticks(t), KEYS, ORDER)


@query("tick_aggregate", "A14 A15 W10 J2", f"WITH {PANEL} SELECT * FROM panel", BOOK_DOUBLES + " trade_rv trade_price_mean trade_price_std trade_size_sum trade_size_mean trade_order_count")
def tick_aggregate(t):
    return panel(t)


@query("har_lags", "W4 J10 U1 U4 R10 R11", f"""
WITH {SMALL}, p AS (SELECT *, dense_rank() OVER (ORDER BY time_id) AS t FROM panel),
l AS (SELECT stock_id, time_id, book_rv,
 avg(book_rv) OVER (PARTITION BY stock_id ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS fe_rv_lag1,
 avg(book_rv) OVER (PARTITION BY stock_id ORDER BY t RANGE BETWEEN 5 PRECEDING AND 1 PRECEDING) AS fe_rv_lag5_mean,
 avg(book_rv) OVER (PARTITION BY stock_id ORDER BY t RANGE BETWEEN 22 PRECEDING AND 1 PRECEDING) AS fe_rv_lag22_mean,
 avg(book_spread_mean) OVER (PARTITION BY stock_id ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS fe_spread_lag1,
 avg(trade_rv) OVER (PARTITION BY stock_id ORDER BY t RANGE BETWEEN 1 PRECEDING AND 1 PRECEDING) AS fe_trade_rv_lag1 FROM p),
m AS (SELECT quantile_cont(book_rv,0.5) med FROM panel)
SELECT stock_id, time_id, fe_rv_lag1, fe_rv_lag5_mean, fe_rv_lag22_mean, fe_spread_lag1, fe_trade_rv_lag1,
 coalesce(book_rv/nullif(coalesce(fe_rv_lag1,med),0),0) AS fe_rv_har_ratio, ln(1+book_rv)-ln(1+coalesce(fe_rv_lag1,0)) AS fe_rv_log_diff_l1,
 coalesce(fe_rv_lag5_mean,0)-coalesce(fe_rv_lag22_mean,0) AS fe_rv_har_slope FROM l, m""",
       "fe_rv_lag1 fe_rv_lag5_mean fe_rv_lag22_mean fe_spread_lag1 fe_trade_rv_lag1 fe_rv_har_ratio fe_rv_log_diff_l1 fe_rv_har_slope")
def har_lags(t):
    out = M.har_lags(small_panel(t), "stock_id", "time_id")
    return out.select("stock_id", "time_id", *[c for c in out.columns if c.startswith("fe_")])


@query("market_cross_section", "A16 J8", f"""
WITH {SMALL}, s AS (SELECT time_id, avg(book_rv) AS fe_market_rv_mean, stddev_samp(book_rv) AS fe_market_rv_std, quantile_cont(book_rv,0.75) AS fe_market_rv_q75,
  avg(book_spread_mean) AS fe_market_spread_mean, avg(book_vol_imb_mean) AS fe_market_vol_imb FROM panel GROUP BY 1),
b AS (SELECT quantile_cont(fe_market_rv_mean,0.75) AS bound FROM s WHERE time_id < DATE '2024-01-22')
SELECT stock_id, time_id, fe_market_rv_mean, fe_market_rv_std, fe_market_rv_q75, fe_market_spread_mean, fe_market_vol_imb,
 coalesce(book_rv/nullif(fe_market_rv_mean,0),0) AS fe_rv_vs_market, coalesce(book_spread_mean/nullif(fe_market_spread_mean,0),0) AS fe_spread_vs_market,
 CAST(fe_market_rv_mean>bound AS INTEGER) AS fe_market_rv_regime FROM panel JOIN s USING (time_id), b""",
       "fe_market_rv_mean fe_market_rv_std fe_market_rv_q75 fe_market_spread_mean fe_market_vol_imb fe_rv_vs_market fe_spread_vs_market")
def market_cross_section(t):
    p = small_panel(t)
    stats = M.fit_cross_section(p, "time_id")
    out = M.apply_cross_section(p, stats, "time_id", fit_times=p.where("time_id < date '2024-01-22'"))
    return out.select("stock_id", "time_id", *[c for c in out.columns if c.startswith("fe_")])


@query("stock_level", "P34 J8", f"""
WITH {SMALL}, f AS (SELECT * FROM panel WHERE time_id < DATE '2024-01-22'), s AS (SELECT stock_id, avg(book_rv) m FROM f GROUP BY 1), g AS (SELECT avg(book_rv) m FROM f)
SELECT stock_id, time_id, coalesce(s.m,g.m) AS fe_stock_mean_rv, coalesce(book_rv/nullif(coalesce(s.m,g.m),0),0) AS fe_rv_vs_stock_mean FROM panel LEFT JOIN s USING (stock_id), g""",
       "fe_stock_mean_rv fe_rv_vs_stock_mean")
def stock_level(t):
    p = small_panel(t)
    out = M.apply_stock_level(p, M.fit_stock_level(p.where("time_id < date '2024-01-22'"), "stock_id"), "stock_id")
    return out.select("stock_id", "time_id", "fe_stock_mean_rv", "fe_rv_vs_stock_mean")


def _pct(c):
    return f"(rank() OVER (PARTITION BY time_id ORDER BY {c})+(count(*) OVER (PARTITION BY time_id, {c})-1)/2.0)/count(*) OVER (PARTITION BY time_id)"


EXTREMES = "panel AS (SELECT user_id AS stock_id, CAST(ts AS DATE) AS time_id, max(value) AS book_rv, min(value) AS book_spread_mean FROM events GROUP BY 1,2)"


@query("rank_in_time", "W7 R3", f"WITH {EXTREMES} SELECT stock_id, time_id, {_pct('book_rv')} AS fe_book_rv_rank, {_pct('book_spread_mean')} AS fe_spread_rank FROM panel", "fe_book_rv_rank fe_spread_rank")
def rank_in_time(t):
    p = t.events.groupBy(F.col("user_id").alias("stock_id"), F.to_date("ts").alias("time_id")).agg(
        F.max("value").alias("book_rv"), F.min("value").alias("book_spread_mean"))
    out = M.rank_in_time(p, "time_id", {"book_rv": "fe_book_rv_rank", "book_spread_mean": "fe_spread_rank"})
    return out.select("stock_id", "time_id", "fe_book_rv_rank", "fe_spread_rank")


_L = lambda x: f"ln(1+{x})"
FEATURES = {
    "fe_book_rv": "book_rv", "fe_log_book_rv": _L("book_rv"), "fe_book_rv_l2": "book_rv_l2", "fe_rv_l2_ratio": "coalesce(book_rv_l2/nullif(book_rv,0),0)",
    "fe_rv_log_accel": _L("book_rv") + "-" + _L("book_rv_l2"), "fe_spread_mean": "book_spread_mean", "fe_log_spread": _L("book_spread_mean"),
    "fe_spread_max": "book_spread_max", "fe_spread_spike": "coalesce(book_spread_max/nullif(book_spread_mean,0),0)", "fe_spread_range": "book_spread_max-book_spread_mean",
    "fe_vol_imb_mean": "book_vol_imb_mean", "fe_vol_imb_abs": "abs(book_vol_imb_mean)", "fe_vol_imb_std": "book_vol_imb_std", "fe_wap_std": "book_wap_std",
    "fe_log_wap_std": _L("book_wap_std"), "fe_wap_range": "book_wap_range", "fe_wap_level": "book_wap_mean", "fe_wap_intraday_range": "book_wap_max-book_wap_min",
    "fe_wap_range_pct": "coalesce((book_wap_max-book_wap_min)/nullif(book_wap_mean,0),0)", "fe_lr_std": "book_lr_std", "fe_lr_max_abs": "book_lr_max_abs", "fe_lr_mean": "book_lr_mean",
    "fe_lr_mean_abs": "abs(book_lr_mean)", "fe_lr_sign": "sign(book_lr_mean)", "fe_lr_sharpe": "coalesce(book_lr_mean/CASE WHEN book_lr_std>1e-12 THEN book_lr_std END,0)",
    "fe_lr_up_proxy": "CASE WHEN book_lr_mean>0 THEN book_lr_mean**2 ELSE 0 END", "fe_lr_down_proxy": "CASE WHEN book_lr_mean<0 THEN book_lr_mean**2 ELSE 0 END",
    "fe_rv_asymmetry": "sign(book_lr_mean)*book_lr_mean**2", "fe_bid_ask_size_ratio": "coalesce(book_bid_size1_sum/nullif(book_ask_size1_sum,0),0)",
    "fe_total_book_volume": "book_bid_size1_sum+book_ask_size1_sum", "fe_log_total_volume": _L("book_bid_size1_sum+book_ask_size1_sum"),
    "fe_book_depth_product": "ln(2+book_bid_size1_sum*book_ask_size1_sum)", "fe_n_ticks": "book_n_ticks", "fe_log_n_ticks": _L("book_n_ticks"), "fe_trade_rv": "trade_rv",
    "fe_log_trade_rv": _L("trade_rv"), "fe_rv_book_trade_ratio": "coalesce(trade_rv/nullif(book_rv,0),0)", "fe_trade_vol_frac": "coalesce(trade_rv/nullif(book_rv+trade_rv,0),0)",
    "fe_trade_volume": "trade_size_sum", "fe_log_trade_volume": _L("trade_size_sum"), "fe_trade_count": "trade_count", "fe_log_trade_count": _L("trade_count"),
    "fe_trade_price_disp": "trade_price_std", "fe_log_trade_price_disp": _L("trade_price_std"), "fe_avg_trade_size": "trade_size_mean", "fe_log_avg_trade_size": _L("trade_size_mean"),
    "fe_order_count": "trade_order_count", "fe_log_order_count": _L("trade_order_count"), "fe_order_fragmentation": "trade_order_count/trade_count",
    "fe_book_trade_price_gap": "book_wap_mean-trade_price_mean", "fe_book_trade_price_gap_abs": "abs(book_wap_mean-trade_price_mean)",
    "fe_spread_x_imb": "book_spread_mean*abs(book_vol_imb_mean)", "fe_volatility_spread_ratio": "coalesce(book_lr_std/nullif(book_spread_mean,0),0)",
    "fe_trade_book_vol_ratio": "coalesce(trade_size_sum/nullif(book_bid_size1_sum+book_ask_size1_sum,0),0)", "fe_price_impact": "coalesce(trade_rv/nullif(ln(1+trade_size_sum),0),0)",
    "log_target": _L("trade_rv"),
}


@query("tick_features", "P34 P8 P10", f"WITH {PANEL} SELECT stock_id, time_id, " + ", ".join(f"{e} AS {n}" for n, e in FEATURES.items() if n != "fe_lr_sharpe") + " FROM panel",
       " ".join(n for n in FEATURES if n != "fe_lr_sharpe"))
def tick_features(t):
    out = M.tick_features(panel(t), target="trade_rv")
    # two ticks give one return: its deviation is float noise and so is the sharpe ratio
    return out.select("stock_id", "time_id", *[n for n in FEATURES if n != "fe_lr_sharpe"])


@query("clip_and_scale", "P5 Z1", f"""
WITH {SMALL}, q AS (SELECT quantile_cont(book_rv,0.01) a, quantile_cont(book_rv,0.99) b FROM panel WHERE time_id < DATE '2024-01-22'),
c AS (SELECT stock_id, time_id, least(greatest(book_rv,a),b) AS x FROM panel, q), s AS (SELECT avg(x) m, stddev_pop(x) sd FROM c WHERE time_id < DATE '2024-01-22')
SELECT stock_id, time_id, (x-m)/sd AS book_rv FROM c, s""", "book_rv")
def clip_and_scale(t):
    p = small_panel(t)
    early = "time_id < date '2024-01-22'"
    out = E.apply_clip(p, E.fit_clip(p.where(early), ["book_rv"], 0.01, 0.99), ["book_rv"])
    out = E.apply_scale(out, E.fit_scale(out.where(early), ["book_rv"]), ["book_rv"])
    return out.select("stock_id", "time_id", "book_rv")


@query("simulated_ohlc", "P33", f"""
WITH {BOOK} SELECT stock_id, time_id, book_wap_mean-book_wap_std*0.5 AS open, book_wap_mean+book_wap_std*0.5 AS close,
 greatest(book_wap_mean+book_wap_range*0.5, book_wap_mean+book_wap_std*0.5) AS high, least(book_wap_mean-book_wap_range*0.5, book_wap_mean-book_wap_std*0.5) AS low FROM book""", "open close high low")
def simulated_ohlc(t):
    book = M.aggregate_book(ticks(t), KEYS, ORDER)
    return M.simulated_ohlc(book, "book_wap_mean", "book_wap_std", "book_wap_range").select(*KEYS, "open", "close", "high", "low")


@query("rolling_band", "W5", f"""
WITH {SMALL}, d AS (SELECT time_id, avg(book_rv) mean, stddev_samp(book_rv) std, min(book_rv) min, max(book_rv) max FROM panel GROUP BY 1)
SELECT *, avg(mean) OVER w AS roll_mean, avg(mean) OVER w + 2*coalesce(stddev_samp(mean) OVER w,0) AS upper FROM d WINDOW w AS (ORDER BY time_id ROWS 24 PRECEDING)""", "mean std min max roll_mean upper")
def rolling_band(t):
    return CH.series_band(small_panel(t), "time_id", "book_rv")


@query("ribbon", "W6", """
WITH d AS (SELECT CAST(o_orderdate AS DATE) AS time_id, avg(o_totalprice) AS actual FROM orders GROUP BY 1)
SELECT *, avg(actual) OVER w - 1.5*coalesce(stddev_samp(actual) OVER w,0) AS lower, avg(actual) OVER w + 1.5*coalesce(stddev_samp(actual) OVER w,0) AS upper
FROM d WINDOW w AS (ORDER BY time_id ROWS 19 PRECEDING)""", "actual lower upper")
def ribbon(t):
    per = t.orders.groupBy(F.to_date("o_orderdate").alias("time_id")).agg(F.avg("o_totalprice").alias("actual"))
    return CH.ribbon(per, "time_id", "actual")


TOP = "top AS (SELECT stock_id FROM panel GROUP BY 1 ORDER BY stddev_samp(book_rv) DESC NULLS LAST, stock_id LIMIT {k})"


@query("indexed100", "W16 T2", f"""
WITH {SMALL}, {TOP.format(k=10)}, p AS (SELECT * FROM panel WHERE stock_id IN (FROM top)),
b AS (SELECT stock_id, coalesce(max(book_rv) FILTER (time_id=(SELECT min(time_id) FROM panel)), arg_min(book_rv, time_id)) base FROM p GROUP BY 1)
SELECT stock_id, time_id, book_rv/base*100 AS indexed FROM p JOIN b USING (stock_id) WHERE base<>0""", "indexed")
def indexed100(t):
    return CH.indexed(small_panel(t), "stock_id", "time_id", "book_rv")


_DAY = "epoch_us(CAST(time_id AS TIMESTAMP))/86400000000"


@query("heatmap_matrix", "A33 P27", f"""
WITH {SMALL}, {TOP.format(k=30)}, e AS (SELECT min({_DAY})::DOUBLE a, max({_DAY})::DOUBLE b FROM panel),
c AS (SELECT stock_id, book_rv, greatest(least(ceil(({_DAY}-a)/(b-a)*10)-1,9),0) AS k FROM panel, e WHERE stock_id IN (FROM top))
SELECT stock_id, {", ".join(f"coalesce(avg(book_rv) FILTER (k={i}),0) AS T{i + 1}" for i in range(10))} FROM c GROUP BY 1""", " ".join(f"T{i + 1}" for i in range(10)))
def heatmap_matrix(t):
    p = small_panel(t).withColumn("time_id", F.unix_date("time_id"))
    return CH.heatmap(p, "stock_id", "time_id", "book_rv", buckets=10)


@query("seasonal_boxes", "P27", f"""
WITH {SMALL}, e AS (SELECT min({_DAY})::DOUBLE a, max({_DAY})::DOUBLE b FROM panel),
c AS (SELECT book_rv AS x, CAST(greatest(least(ceil(({_DAY}-a)/(b-a)*6)-1,5),0)+1 AS INTEGER) AS period FROM panel, e)
SELECT period, count(x) AS n, min(x) AS min, max(x) AS max, avg(x) AS mean, stddev_samp(x) AS std, quantile_cont(x,0.25) AS q1, quantile_cont(x,0.5) AS median, quantile_cont(x,0.75) AS q3 FROM c GROUP BY 1""",
       "min max mean std q1 median q3")
def seasonal_boxes(t):
    return CH.seasonal_boxes(small_panel(t).withColumn("time_id", F.unix_date("time_id")), "time_id", "book_rv")


@query("order_flow", "A17", f"""
WITH {SMALL}, d AS (SELECT time_id, coalesce(avg(book_vol_imb_mean),0) i, avg(book_spread_mean) s FROM panel GROUP BY 1)
SELECT time_id, greatest(i,0) AS buy, abs(least(i,0)) AS sell, s AS spread FROM d""", "buy sell spread")
def order_flow(t):
    return CH.order_flow(small_panel(t), "time_id", "book_vol_imb_mean", "book_spread_mean")


@query("market_kpis", "A28", f"WITH {SMALL} SELECT count(DISTINCT stock_id) AS n_stocks, count(DISTINCT time_id) AS n_times, count(*) AS n_rows, avg(book_rv) AS mean_rv FROM panel", "mean_rv")
def market_kpis(t):
    return CH.market_kpis(small_panel(t), "stock_id", "time_id", "book_rv")


@query("histogram", "P27 P5", """
WITH q AS (SELECT quantile_cont(value,0.01) a, quantile_cont(value,0.99) b FROM events),
c AS (SELECT least(greatest(value,a),b) v, a, b FROM events, q)
SELECT CAST(greatest(least(ceil((v-a)/(b-a)*60)-1,59),0) AS INTEGER) AS bin, count(*) AS n FROM c GROUP BY 1""")
def histogram(t):
    return CH.histogram(t.events, "value")


@query("box_summary", "P5", """
WITH q AS (SELECT quantile_cont(o_totalprice,0.99) p FROM orders), c AS (SELECT o_orderstatus, least(o_totalprice,p) x FROM orders, q)
SELECT o_orderstatus, count(x) AS n, min(x) AS min, max(x) AS max, avg(x) AS mean, stddev_samp(x) AS std, quantile_cont(x,0.25) AS q1, quantile_cont(x,0.5) AS median, quantile_cont(x,0.75) AS q3 FROM c GROUP BY 1""",
       "min max mean std q1 median q3")
def box_summary(t):
    return CH.box_summary(t.orders.select("o_orderstatus", "o_totalprice"), "o_orderstatus", "o_totalprice", clip_p=0.99)


@query("waterfall", "W2", """
WITH f AS (SELECT r_regionkey k, r_name AS step, sum(c_acctbal) AS delta FROM customer JOIN nation ON c_nationkey=n_nationkey JOIN region ON n_regionkey=r_regionkey GROUP BY 1,2)
SELECT step, delta, 100+sum(delta) OVER (ORDER BY k) AS level FROM f UNION ALL SELECT 'Baseline', 100, 100 UNION ALL SELECT 'Total', 100+sum(delta), 100+sum(delta) FROM f""", "delta level")
def waterfall(t):
    nations = t.nation.join(t.region, F.col("n_regionkey") == F.col("r_regionkey"))
    factors = t.customer.join(nations, F.col("c_nationkey") == F.col("n_nationkey")).groupBy("r_regionkey", "r_name").agg(F.sum("c_acctbal").alias("delta"))
    return CH.waterfall(factors, "r_regionkey", "r_name", "delta", 100.0)


@query("scatter_sample", "S14")
def scatter_sample(t):
    return CH.scatter_sample(t.orders, "o_custkey", "o_totalprice", 2000, ["o_orderkey"], log_axes=["o_totalprice"])


@query("null_map", "F5 S14")
def null_map(t):
    rows = t.events.withColumn("value", F.when(F.col("event_type") != "error", F.col("value")))
    return CH.null_map(rows, "event_id", ["value", "props"], 500)
