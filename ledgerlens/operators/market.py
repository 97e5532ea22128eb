"""Order-book ticks, volatility panels and their lags and cross-sections."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerlens.functions import scalars as S
from ledgerlens.operators.encode import cohort_rank, lookup
from ledgerlens.operators.ordering import dense_index, in_order, only_row, quantile_table, rolling


def weighted_price(level: int) -> Column:
    """Price weighted by the size on the other side of the book."""
    bid, ask = F.col(f"bid_price{level}"), F.col(f"ask_price{level}")
    bid_size, ask_size = F.col(f"bid_size{level}"), F.col(f"ask_size{level}")
    return (bid * ask_size + ask * bid_size) / F.nullif((bid_size + ask_size).cast("double"), F.lit(0.0))


def _log_return(now: str, before: str) -> Column:
    ratio = F.col(now) / F.nullif(F.col(before), F.lit(0.0))
    return F.when(ratio > 0, F.log(ratio))


def _volatility(returns: str) -> Column:
    return F.sqrt(F.coalesce(F.sum(F.col(returns) * F.col(returns)), F.lit(0.0)))


def _spread_zero(agg: Column) -> Column:
    return F.coalesce(agg, F.lit(0.0))


def aggregate_book(book: DataFrame, keys: Sequence[str], order: Sequence[str], second_level: bool = True) -> DataFrame:
    """Seventeen statistics per (stock, bucket) from level-one (and two) quotes.

    Returns are taken between consecutive ticks of a bucket; a bucket with one
    tick has return statistics of 0.
    """
    ticks = book.withColumn("_w1", weighted_price(1))
    previous = {"_p1": ("previous", F.col("_w1"))}
    if second_level:
        ticks = ticks.withColumn("_w2", weighted_price(2))
        previous["_p2"] = ("previous", F.col("_w2"))
    bid, ask = F.col("bid_price1"), F.col("ask_price1")
    bid_size, ask_size = F.col("bid_size1").cast("double"), F.col("ask_size1").cast("double")
    ticks = in_order(ticks, keys, order, previous).select(
        *keys, "_w1", bid_size.alias("_bs"), ask_size.alias("_as"),
        _log_return("_w1", "_p1").alias("_r1"),
        *([F.col("_w2"), _log_return("_w2", "_p2").alias("_r2")] if second_level else []),
        ((ask - bid) / F.nullif((bid + ask) / 2, F.lit(0.0))).alias("_spread"),
        ((bid_size - ask_size) / F.nullif(bid_size + ask_size, F.lit(0.0))).alias("_imb"),
    )
    level_two = F.when(F.count("_w2") > 0, _volatility("_r2")) if second_level else F.lit(None).cast("double")
    return ticks.groupBy(*keys).agg(
        F.avg("_w1").alias("book_wap_mean"),
        F.stddev_pop("_w1").alias("book_wap_std"),
        F.min("_w1").alias("book_wap_min"),
        F.max("_w1").alias("book_wap_max"),
        (F.max("_w1") - F.min("_w1")).alias("book_wap_range"),
        _volatility("_r1").alias("book_rv"),
        level_two.alias("book_rv_l2"),
        _spread_zero(F.avg("_r1")).alias("book_lr_mean"),
        _spread_zero(F.stddev_pop("_r1")).alias("book_lr_std"),
        _spread_zero(F.max(F.abs("_r1"))).alias("book_lr_max_abs"),
        F.avg("_spread").alias("book_spread_mean"),
        F.max("_spread").alias("book_spread_max"),
        F.avg("_imb").alias("book_vol_imb_mean"),
        _spread_zero(F.stddev_samp("_imb")).alias("book_vol_imb_std"),
        F.sum("_bs").alias("book_bid_size1_sum"),
        F.sum("_as").alias("book_ask_size1_sum"),
        F.count(F.lit(1)).alias("book_n_ticks"),
    )


def aggregate_trades(trades: DataFrame, keys: Sequence[str], order: Sequence[str], price: str = "price", size: str = "size", orders: str | None = None) -> DataFrame:
    """Realised volatility, price spread, sizes and counts per (stock, bucket)."""
    ticks = in_order(trades, keys, order, {"_before": ("previous", F.col(price))})
    ticks = ticks.withColumn("_r", _log_return(price, "_before"))
    return ticks.groupBy(*keys).agg(
        _volatility("_r").alias("trade_rv"),
        F.avg(price).alias("trade_price_mean"),
        F.stddev_pop(price).alias("trade_price_std"),
        F.sum(F.col(size).cast("double")).alias("trade_size_sum"),
        F.avg(size).alias("trade_size_mean"),
        F.count(F.lit(1)).alias("trade_count"),
        (F.sum(F.col(orders).cast("double")) if orders else F.lit(None).cast("double")).alias("trade_order_count"),
    )


def with_time_rank(panel: DataFrame, time: str, name: str = "_t") -> DataFrame:
    """Place of each time in the global list of times, so that gaps of one stock stay gaps."""
    return panel.join(dense_index(panel, time, name), time)


def har_lags(panel: DataFrame, stock: str, time: str, rv: str = "book_rv", spread: str | None = "book_spread_mean", trade_rv: str | None = "trade_rv", fit: DataFrame | None = None) -> DataFrame:
    """Lag one, mean of five and of twenty-two times before; ratio, log difference and slope.

    A missing lag in the ratio is replaced by the median of ``fit`` (the
    training rows; the panel itself if not given).
    """
    measures = {
        "fe_rv_lag1": (F.avg(rv), -1, -1),
        "fe_rv_lag5_mean": (F.avg(rv), -5, -1),
        "fe_rv_lag22_mean": (F.avg(rv), -22, -1),
    }
    if spread:
        measures["fe_spread_lag1"] = (F.avg(spread), -1, -1)
    if trade_rv:
        measures["fe_trade_rv_lag1"] = (F.avg(trade_rv), -1, -1)
    out = rolling(with_time_rank(panel, time), [stock], "_t", measures).drop("_t")
    median = only_row(quantile_table(panel if fit is None else fit, {"m": (rv, 0.5)})).getField("m")
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.withColumns(
        {
            "fe_rv_har_ratio": S.safe_ratio(zero(rv), F.coalesce(F.col("fe_rv_lag1"), median)),
            "fe_rv_log_diff_l1": F.log1p(zero(rv)) - F.log1p(zero("fe_rv_lag1")),
            "fe_rv_har_slope": zero("fe_rv_lag5_mean") - zero("fe_rv_lag22_mean"),
        }
    )


def fit_cross_section(panel: DataFrame, time: str, rv: str = "book_rv", spread: str = "book_spread_mean", imbalance: str = "book_vol_imb_mean") -> DataFrame:
    """Market-wide statistics per time."""
    basic = panel.groupBy(time).agg(
        F.avg(rv).alias("fe_market_rv_mean"), F.stddev_samp(rv).alias("fe_market_rv_std"),
        F.avg(spread).alias("fe_market_spread_mean"), F.avg(imbalance).alias("fe_market_vol_imb"),
    )
    return basic.join(quantile_table(panel, {"fe_market_rv_q75": (rv, 0.75)}, [time]), time, "left")


def apply_cross_section(panel: DataFrame, stats: DataFrame, time: str, fit_times: DataFrame | None = None, rv: str = "book_rv", spread: str = "book_spread_mean") -> DataFrame:
    """Join market statistics, relative ratios and the high-volatility flag.

    The flag's threshold is the 75th percentile of the market mean over the
    training times (``fit_times``) or over all of them.
    """
    names = [c for c in stats.columns if c != time]
    times = stats if fit_times is None else stats.join(fit_times.select(time).distinct(), time, "left_semi")
    bound = only_row(quantile_table(times, {"b": ("fe_market_rv_mean", 0.75)})).getField("b")
    out = lookup(panel, stats, [time], dict.fromkeys(names))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0.0))
    return out.withColumns(
        {
            "fe_rv_vs_market": S.safe_ratio(zero(rv), "fe_market_rv_mean"),
            "fe_spread_vs_market": S.safe_ratio(zero(spread), "fe_market_spread_mean"),
            "fe_market_rv_regime": S.flag(zero("fe_market_rv_mean") > bound),
        }
    )


def fit_stock_level(train: DataFrame, stock: str, rv: str = "book_rv") -> DataFrame:
    """Mean volatility per stock and over all rows."""
    overall = train.agg(F.avg(rv)).scalar()
    return train.groupBy(stock).agg(F.avg(rv).alias("fe_stock_mean_rv")).withColumn("_overall", overall)


def apply_stock_level(df: DataFrame, stats: DataFrame, stock: str, rv: str = "book_rv") -> DataFrame:
    default = stats.agg(F.max("_overall")).scalar()
    out = lookup(df, stats.select(stock, "fe_stock_mean_rv"), [stock], {"fe_stock_mean_rv": default})
    return out.withColumn("fe_rv_vs_stock_mean", S.safe_ratio(F.coalesce(F.col(rv), F.lit(0.0)), "fe_stock_mean_rv"))


def rank_in_time(df: DataFrame, time: str, columns: dict[str, str]) -> DataFrame:
    """Average-rank percentile among all stocks of a time; nulls stay null."""
    out = cohort_rank(df, list(columns), [time], null_rank=None)
    return out.withColumnsRenamed({f"{c}__rank": n for c, n in columns.items()})


def tick_features(df: DataFrame, target: str | None = None) -> DataFrame:
    """Levels, logs, ratios and proxies from the book and trade aggregates, in one projection."""
    c = F.col
    zero = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(0.0))
    tiny = lambda x: F.coalesce(F.col(x).cast("double"), F.lit(1e-8))
    drift = zero("book_lr_mean")
    up, down = F.when(drift > 0, drift * drift).otherwise(0.0), F.when(drift < 0, drift * drift).otherwise(0.0)
    bids, asks = zero("book_bid_size1_sum"), zero("book_ask_size1_sum")
    span = F.coalesce(c("book_wap_max") - c("book_wap_min"), F.lit(0.0))
    gap = zero("book_wap_mean") - zero("trade_price_mean")
    volume = zero("trade_size_sum")
    out = {
        # volatility
        "fe_book_rv": c("book_rv"),
        "fe_log_book_rv": F.log1p("book_rv"),
        "fe_book_rv_l2": zero("book_rv_l2"),
        "fe_rv_l2_ratio": S.safe_ratio(zero("book_rv_l2"), tiny("book_rv")),
        "fe_rv_log_accel": F.log1p(zero("book_rv")) - F.log1p(zero("book_rv_l2")),
        # spread and imbalance
        "fe_spread_mean": c("book_spread_mean"),
        "fe_log_spread": F.log1p("book_spread_mean"),
        "fe_spread_max": c("book_spread_max"),
        "fe_spread_spike": S.safe_ratio("book_spread_max", "book_spread_mean"),
        "fe_spread_range": F.coalesce(c("book_spread_max") - c("book_spread_mean"), F.lit(0.0)),
        "fe_vol_imb_mean": c("book_vol_imb_mean"),
        "fe_vol_imb_abs": F.abs("book_vol_imb_mean"),
        "fe_vol_imb_std": c("book_vol_imb_std"),
        # price level and returns
        "fe_wap_std": c("book_wap_std"),
        "fe_log_wap_std": F.log1p("book_wap_std"),
        "fe_wap_range": c("book_wap_range"),
        "fe_wap_level": c("book_wap_mean"),
        "fe_wap_intraday_range": span,
        "fe_wap_range_pct": S.safe_ratio(span, "book_wap_mean"),
        "fe_lr_std": c("book_lr_std"),
        "fe_lr_max_abs": c("book_lr_max_abs"),
        "fe_lr_mean": c("book_lr_mean"),
        "fe_lr_mean_abs": F.abs("book_lr_mean"),
        "fe_lr_sign": F.signum("book_lr_mean"),
        "fe_lr_sharpe": S.safe_ratio(drift, tiny("book_lr_std")),
        "fe_lr_up_proxy": up,
        "fe_lr_down_proxy": down,
        "fe_rv_asymmetry": up - down,
        # sizes
        "fe_bid_ask_size_ratio": S.safe_ratio(bids, asks),
        "fe_total_book_volume": bids + asks,
        "fe_log_total_volume": F.log1p(bids + asks),
        "fe_book_depth_product": F.log1p(bids * asks + 1),
        "fe_n_ticks": c("book_n_ticks").cast("double"),
        "fe_log_n_ticks": F.log1p("book_n_ticks"),
        # trades
        "fe_trade_rv": zero("trade_rv"),
        "fe_log_trade_rv": F.log1p(zero("trade_rv")),
        "fe_rv_book_trade_ratio": S.safe_ratio(zero("trade_rv"), tiny("book_rv")),
        "fe_trade_vol_frac": S.safe_ratio(zero("trade_rv"), zero("book_rv") + zero("trade_rv")),
        "fe_trade_volume": volume,
        "fe_log_trade_volume": F.log1p(volume),
        "fe_trade_count": zero("trade_count"),
        "fe_log_trade_count": F.log1p(zero("trade_count")),
        "fe_trade_price_disp": zero("trade_price_std"),
        "fe_log_trade_price_disp": F.log1p(zero("trade_price_std")),
        "fe_avg_trade_size": zero("trade_size_mean"),
        "fe_log_avg_trade_size": F.log1p(zero("trade_size_mean")),
        "fe_order_count": zero("trade_order_count"),
        "fe_log_order_count": F.log1p(zero("trade_order_count")),
        "fe_order_fragmentation": S.safe_ratio(zero("trade_order_count"), F.coalesce(c("trade_count").cast("double"), F.lit(1.0))),
        "fe_book_trade_price_gap": gap,
        "fe_book_trade_price_gap_abs": F.abs(gap),
        # products of the above
        "fe_spread_x_imb": c("book_spread_mean") * F.abs("book_vol_imb_mean"),
        "fe_volatility_spread_ratio": S.safe_ratio("book_lr_std", "book_spread_mean"),
        "fe_trade_book_vol_ratio": S.safe_ratio(volume, bids + asks),
        "fe_price_impact": S.safe_ratio(zero("trade_rv"), F.log1p(volume)),
    }
    if target:
        out["log_target"] = F.log1p(target)
    return df.withColumns(out)


def simulated_ohlc(df: DataFrame, mean: str, std: str | None = None, spread: str | None = None) -> DataFrame:
    """Open, high, low and close guessed from mean, deviation and range."""
    m = F.col(mean)
    half = (F.coalesce(F.col(std), F.lit(0.0)) if std else m * 0.002) / 2
    reach = (F.coalesce(F.col(spread), F.lit(0.0)) if spread else half * 4) / 2
    return df.withColumns(
        {
            "open": m - half, "close": m + half,
            "high": F.greatest(m + reach, m + half), "low": F.least(m - reach, m - half),
        }
    )
