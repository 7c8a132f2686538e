"""Context from higher timeframes, as of the bars that have closed."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.lineage import cut
from tapeloom.functions.scalar import holds, safe_divide
from tapeloom.operators.bars import INTERVALS
from tapeloom.operators.micro import trend_direction
from tapeloom.operators.series import asof, ewm, on_slices


def context(bars: DataFrame, prefix: str, interval: str) -> DataFrame:
    """What lower timeframes see of these bars, keyed by their close time: regime, adx, direction over 3 bars, mean of
    span 20; hurst and atr_pct where there."""
    d = ewm(bars, "close", 2.0 / 21.0, f"_{prefix}_ema20")
    d = on_slices(d, lambda x, w: x.withColumn("_dir", trend_direction("close", 3, w)), 3)
    have = set(bars.columns)
    return d.select(
        "symbol",
        (F.col("open_time") + INTERVALS[interval]).alias("_closed"),
        (F.col("regime") if "regime" in have else F.lit("unknown")).alias(f"htf_{prefix}_regime"),
        (F.col("adx") if "adx" in have else F.lit(0.0)).alias(f"htf_{prefix}_adx"),
        F.col("_dir").alias(f"htf_{prefix}_trend_dir"),
        F.col(f"_{prefix}_ema20"),
        *(F.col(c).alias(f"htf_{prefix}_{c}") for c in ("hurst", "atr_pct") if c in have),
        F.col("_dir").alias(f"htf_{prefix}_last_n_bars_dir"),
    )


def _join(bars: DataFrame, ctx: DataFrame) -> DataFrame:
    names = [c for c in ctx.columns if c not in ("symbol", "_closed")]
    return asof(bars, ctx, "open_time", "_closed", names)


def for_1h(bars_1h: DataFrame, bars_4h: DataFrame) -> DataFrame:
    """1h bars with the last closed 4h bar's context: distance from its mean, agreement of directions, number of timeframes
    with a direction."""
    d = _join(bars_1h, context(bars_4h, "4h", "4h"))
    d = on_slices(d, lambda x, w: x.withColumn("_own", trend_direction("close", 3, w)), 3)
    far = F.col("htf_4h_trend_dir")
    return d.select(
        "*",
        safe_divide(F.col("close") - F.col("_4h_ema20"), F.col("_4h_ema20")).alias("price_vs_4h_ema20"),
        holds((F.col("_own") == far) & (F.col("_own") != 0)).alias("mtf_1h_4h_aligned"),
        (F.abs("_own") + F.abs(far)).cast("int").alias("mtf_alignment_score"),
    ).drop("_own", "_4h_ema20")


def for_15m(bars_15m: DataFrame, bars_1h: DataFrame, bars_4h: DataFrame) -> DataFrame:
    """15m bars with 1h and 4h context and the 1h session price: how many timeframes have a direction, whether the higher
    two conflict, whether both trend strongly."""
    d = bars_15m
    if "session_vwap" in bars_1h.columns:
        v = bars_1h.select("symbol", (F.col("open_time") + INTERVALS["1h"]).alias("_closed"), F.col("session_vwap").alias("_v"))
        d = _join(d, v).withColumn("htf_1h_vwap_position", safe_divide(F.col("close") - F.col("_v"), F.col("_v"))).drop("_v")
        d = cut(d)
    else:
        d = d.withColumn("htf_1h_vwap_position", F.lit(0.0))
    d = cut(_join(d, context(bars_1h, "1h", "1h")))
    d = cut(_join(d, context(bars_4h, "4h", "4h")))
    d = on_slices(d, lambda x, w: x.withColumn("_own", trend_direction("close", 4, w)), 4)
    one, four = F.col("htf_1h_trend_dir"), F.col("htf_4h_trend_dir")
    return d.select(
        "*",
        (F.abs("_own") + F.abs(one) + F.abs(four)).cast("int").alias("mtf_3tf_alignment"),
        holds(one * four < 0).alias("htf_conflict"),
        holds((F.col("htf_1h_adx") > 25.0) & (F.col("htf_4h_adx") > 25.0)).alias("htf_both_strong_trend"),
    ).drop("_own", "_1h_ema20", "_4h_ema20")
