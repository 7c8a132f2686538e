"""Bars: from trades, to coarser bars, and statistics inside bars."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalar import safe_divide

INTERVALS = {"1m": 60_000, "5m": 300_000, "15m": 900_000, "1h": 3_600_000, "4h": 14_400_000, "1d": 86_400_000}


def bucket(ts: str, interval: str):
    ms = INTERVALS[interval]
    return (F.floor(F.col(ts) / ms) * ms).cast("long")


def bars_from_trades(trades: DataFrame, interval: str) -> DataFrame:
    """Trades (trade_id, symbol, price, quantity, transact_time, is_buyer_maker) to bars. The aggressor buys where the
    buyer is not the maker. First and last trade are by (time, id); trades without a price are left out."""
    order = F.struct("transact_time", "trade_id")
    taken = F.when(~F.col("is_buyer_maker"), F.col("quantity"))
    grouped = trades.where("price is not null").groupBy("symbol", bucket("transact_time", interval).alias("open_time"))
    return grouped.agg(
        F.min_by("price", order).alias("open"),
        F.max("price").alias("high"),
        F.min("price").alias("low"),
        F.max_by("price", order).alias("close"),
        F.sum("quantity").cast("double").alias("volume"),
        F.coalesce(F.sum(taken), F.lit(0)).cast("double").alias("taker_buy_volume"),
        F.sum(F.col("price") * F.col("quantity")).alias("quote_volume"),
        F.count("*").alias("trade_count"),
    )


def resample(bars: DataFrame, interval: str) -> DataFrame:
    """Bars to a coarser interval: first open, extremes, last close, sums."""
    grouped = bars.groupBy("symbol", bucket("open_time", interval).alias("_open"))
    out = grouped.agg(F.min_by("open", "open_time").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), F.max_by("close", "open_time").alias("close"), F.sum("volume").alias("volume"), F.sum("taker_buy_volume").alias("taker_buy_volume"), F.sum("trade_count").alias("trade_count"))
    return out.withColumnRenamed("_open", "open_time")


def intrabar(children: DataFrame, interval: str = "4h", breakout: int = 4, least: int = 5) -> DataFrame:
    """Per coarse bar, of its child bars: cvd_sum, cvd_slope (least-squares slope of the running cvd over its index,
    against its largest absolute value or 1), realised volatility (root of summed squared log returns) and the share of
    children whose high or low goes beyond the extremes of the `breakout` before them (0 with fewer than `least` children)."""
    parent = bucket("open_time", interval)
    w = Window.partitionBy("symbol", "parent").orderBy("open_time")
    d = children.select("symbol", "open_time", "high", "low", "close", parent.alias("parent"), (2 * F.col("taker_buy_volume") - F.col("volume")).alias("cvd"))
    prior = w.rowsBetween(-breakout, -1)
    d = d.select(
        "*",
        F.sum("cvd").over(w.rowsBetween(Window.unboundedPreceding, 0)).alias("run"),
        (F.row_number().over(w) - 1).cast("double").alias("i"),
        F.ln(F.col("close") / F.lag("close").over(w)).alias("r"),
        F.when(F.count("*").over(prior) == breakout, (F.col("high") > F.max("high").over(prior)) | (F.col("low") < F.min("low").over(prior))).alias("out"),
    )
    n = F.count("*")
    slope = F.when(n >= 2, F.regr_slope("run", "i"))
    return d.groupBy("symbol", F.col("parent").alias("open_time")).agg(
        F.sum("cvd").alias("cvd_sum"),
        F.coalesce(safe_divide(slope, F.greatest(F.max(F.abs("run")), F.lit(1.0))), F.lit(0.0)).alias("cvd_slope"),
        F.coalesce(F.sqrt(F.sum(F.col("r") * F.col("r"))), F.lit(0.0)).alias("realized_vol"),
        F.when(n >= least, safe_divide(F.sum(F.col("out").cast("int")), F.sum(F.col("out").isNotNull().cast("int")))).otherwise(0.0).alias("breakout_share"),
    )


def augment(bars: DataFrame, children: DataFrame, interval: str = "4h") -> DataFrame:
    """bars with the statistics of their children; zeros where there are none."""
    stats = intrabar(children, interval)
    names = [c for c in stats.columns if c not in ("symbol", "open_time")]
    return bars.join(stats, ["symbol", "open_time"], "left").fillna(0.0, names)
