"""Market regimes: true range, trend strength, volatility rank, Hurst exponent and the labels made of them."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.functions.scalar import safe_divide
from tapeloom.operators.series import SLICE, ewm, on_slices, rolling

REGIMES = ("trend_up", "trend_down", "range", "high_vol")


def true_range(bars: DataFrame) -> DataFrame:
    """true_range, plus_dm and minus_dm of each bar; the first bar's true range is its own range."""

    def step(d, w):
        before = F.lag("close").over(w)
        up, down = F.col("high") - F.lag("high").over(w), F.lag("low").over(w) - F.col("low")
        tr = F.greatest(F.col("high") - F.col("low"), F.abs(F.col("high") - before), F.abs(F.col("low") - before))
        return d.select("*", tr.alias("true_range"), F.coalesce(F.when((up > down) & (up > 0), up), F.lit(0.0)).alias("plus_dm"), F.coalesce(F.when((down > up) & (down > 0), down), F.lit(0.0)).alias("minus_dm"))

    return on_slices(bars, step, 1)


def _wilder(d: DataFrame, value: str, period: int, name: str, start: int) -> DataFrame:
    """Wilder's average from bar `start` on: the mean of the `period` values up to it, then 1 / period of each new one."""
    d = on_slices(d, lambda x, w: x.withColumn("_seed", F.avg(value).over(rolling(w, period))), period)
    return ewm(d, value, 1.0 / period, name, start=start, seed="_seed").drop("_seed")


def atr(bars: DataFrame, period: int = 14) -> DataFrame:
    """Average true range (Wilder); 0 for the first period - 1 bars."""
    d = bars if "true_range" in bars.columns else true_range(bars)
    return _wilder(d, "true_range", period, "atr", period - 1).fillna(0.0, ["atr"])


def adx(bars: DataFrame, period: int = 14) -> DataFrame:
    """Average directional index (Wilder): averages of range and directional moves from bar `period` on, their index, and
    its average from bar 2 * period - 1 on; 0 before."""
    d = bars if "true_range" in bars.columns else true_range(bars)
    for c in ("true_range", "plus_dm", "minus_dm"):
        d = _wilder(d, c, period, f"_{c}", period)
    plus, minus = (safe_divide(F.col(f"_{s}_dm"), F.col("_true_range")) * 100.0 for s in ("plus", "minus"))
    d = d.withColumn("_dx", F.when(F.col("bar_idx") >= period, safe_divide(F.abs(plus - minus), plus + minus) * 100.0))
    d = _wilder(d, "_dx", period, "adx", 2 * period - 1).fillna(0.0, ["adx"])
    return d.drop("_true_range", "_plus_dm", "_minus_dm", "_dx")


def _recurrence(x: np.ndarray, k: float, at: int, seed: float) -> np.ndarray:
    """y = y' + k (x - y') from position `at` on, where it is seed; NaN before."""
    out = np.full(len(x), np.nan)
    if at < len(x):
        out[at] = y = seed
        for i, v in enumerate(x[at + 1 :].tolist(), at + 1):
            out[i] = y = y + k * (v - y)
    return out


def _wilder_of(x: np.ndarray, period: int, start: int, first: int) -> np.ndarray:
    """_wilder() of a run of bars from number `first` on. A run that begins after `start` begins with its first value, which
    has no weight left after its halo."""
    at = max(0, start - first)
    seed = x[max(0, at - period + 1) : at + 1].mean() if start >= first and at < len(x) else x[0]
    return _recurrence(x, 1.0 / period, at, seed)


def percentile_of(x: np.ndarray, lookback: int) -> np.ndarray:
    """Share of the positive values of the last `lookback` that are below the current one; 0.5 without any."""
    seen = np.lib.stride_tricks.sliding_window_view(np.concatenate([np.zeros(lookback - 1), x]), lookback)
    valid = (seen > 0).sum(axis=1)
    return np.where(valid > 0, ((seen > 0) & (seen < x[:, None])).sum(axis=1) / np.maximum(valid, 1), 0.5)


def hurst_of(prices: np.ndarray, shortest: int = 2, longest: int = 20) -> float:
    """Hurst exponent by rescaled ranges: slope of log mean R/S over log chunk length, between 0 and 1; 0.5 if undefined."""
    p = np.asarray(prices, float)
    if len(p) < 11 or not (np.isfinite(p).all() and (p > 0).all()):
        return 0.5
    r = np.diff(np.log(p))
    xs, ys = [], []
    for lag in range(shortest, min(longest, len(r)) + 1):
        chunks = r[: len(r) // lag * lag].reshape(-1, lag)
        walk = np.cumsum(chunks - chunks.mean(axis=1, keepdims=True), axis=1)
        spread, dev = np.ptp(walk, axis=1), chunks.std(axis=1, ddof=1)
        if (dev > 0).any():
            rs = (spread[dev > 0] / dev[dev > 0]).mean()
            if rs > 0:
                xs.append(np.log(lag)), ys.append(np.log(rs))
    if len(xs) < 2:
        return 0.5
    return float(np.clip(np.polyfit(xs, ys, 1)[0], 0.0, 1.0))


def _hurst(windows: pd.Series) -> pd.Series:
    return windows.map(hurst_of)


def hurst(bars: DataFrame, window: int = 300, min_bars: int = 300, every: int = 6) -> DataFrame:
    """Hurst exponent of the last `window` closes, worked out on every sixth bar from min_bars on and held between; 0.5
    before. Only those bars' windows go to Python."""

    def collect(d, w):
        anchor = (F.col("bar_idx") >= min_bars) & ((F.col("bar_idx") - min_bars) % every == 0)
        return d.withColumn("_w", F.when(anchor, F.collect_list("close").over(rolling(w, window))))

    d = on_slices(bars, collect, window, size=max(SLICE, window))
    anchors = d.where("_w is not null").select("symbol", F.col("bar_idx").alias("_at"), F.pandas_udf(_hurst, "double")("_w").alias("hurst"))
    at = F.when(F.col("bar_idx") >= min_bars, F.col("bar_idx") - (F.col("bar_idx") - min_bars) % every)
    return d.drop("_w").withColumn("_at", at).join(anchors, ["symbol", "_at"], "left").drop("_at").fillna(0.5, ["hurst"])


def detect(bars: DataFrame, period: int = 14, lookback: int = 540, min_bars: int = 300, window: int = 300, vol_threshold: float = 0.80, trend_threshold: float = 20.0, every: int = 6) -> DataFrame:
    """regime, hurst, adx, atr_pct, atr_percentile, trend_strength, regime_confidence for every bar.

    high_vol where the true range ranks above vol_threshold; else, with adx above trend_threshold, trend_up or trend_down
    by the slope of an exponential mean over max(2, period // 3) bars; else range. Bars before min_bars are neutral, but
    for adx. All recurrences, ranks and exponents (every sixth bar) of a slice are worked out in one go, with a halo beyond
    which no weight is left in a double.
    """
    slope_bars = max(2, period // 3)
    made = [T.StructField(c, T.DoubleType()) for c in ("atr", "adx", "hurst", "_rank", "_slope")]

    def kernel(t: pa.Table) -> pa.Table:
        t = t.sort_by("bar_idx")
        number = np.asarray(t["bar_idx"].combine_chunks(), np.int64)
        high, low, close = (np.asarray(t[c].cast(pa.float64()).combine_chunks().to_numpy(zero_copy_only=False)) for c in ("high", "low", "close"))
        first = int(number[0])
        before = np.concatenate([[np.nan], close[:-1]])
        up, down = np.concatenate([[0.0], np.diff(high)]), np.concatenate([[0.0], -np.diff(low)])
        spread = np.fmax(np.fmax(high - low, np.abs(high - before)), np.abs(low - before))
        moves = np.where((up > down) & (up > 0), up, 0.0), np.where((down > up) & (down > 0), down, 0.0)
        atr_ = np.nan_to_num(_wilder_of(spread, period, period - 1, first))
        with np.errstate(all="ignore"):
            rng, plus, minus = (_wilder_of(x, period, period, first) for x in (spread, *moves))
            plus, minus = (np.nan_to_num(x / rng, posinf=0.0) * 100.0 for x in (plus, minus))
            index = np.nan_to_num(np.abs(plus - minus) / (plus + minus), posinf=0.0) * 100.0
        index[number < period] = np.nan
        adx_ = np.nan_to_num(_wilder_of(index, period, 2 * period - 1, first))
        mean = _recurrence(close, 2.0 / (period + 1), 0, close[0])
        ago = np.concatenate([np.full(slope_bars, np.nan), mean])[: len(mean)]
        slope = np.where(number >= slope_bars, mean - ago, np.nan_to_num(close - before))
        exponent, own = np.full(len(close), 0.5), np.flatnonzero(np.asarray(t["_shift"].combine_chunks()) == 0)
        if len(own):
            anchors = np.flatnonzero((number >= min_bars) & ((number - min_bars) % every == 0) & (np.arange(len(number)) > own[0] - every))
            for i in anchors:
                exponent[i : i + every] = hurst_of(close[max(0, i - window + 1) : i + 1])
        for f, x in zip(made, (atr_, adx_, exponent, percentile_of(atr_, lookback), slope), strict=True):
            t = t.append_column(f.name, pa.array(x))
        return t

    def step(d: DataFrame, w) -> DataFrame:
        return d.groupBy("symbol", "_slice").applyInArrow(kernel, T.StructType([*d.schema.fields, *made]))

    old = [c for c in ("atr", "adx", "hurst", "regime", "atr_pct", "atr_percentile", "trend_strength", "regime_confidence") if c in bars.columns]
    halo = max(lookback, window) + 96 * period
    d = on_slices(bars.drop(*old), step, halo, size=max(SLICE, halo))
    ready = F.col("bar_idx") >= min_bars
    label = F.when(F.col("_rank") > vol_threshold, "high_vol").when(F.col("adx") > trend_threshold, F.when(F.col("_slope") > 0, "trend_up").otherwise("trend_down")).otherwise("range")
    strength = F.least(F.greatest(0.4 * F.abs(F.col("hurst") - 0.5) * 2.0 + 0.6 * F.least(F.col("adx") / 50.0, F.lit(1.0)), F.lit(0.0)), F.lit(1.0))
    return d.select(
        "*",
        F.when(ready, label).otherwise("range").alias("regime"),
        F.when(ready, safe_divide(F.col("atr"), F.col("close"))).otherwise(0.0).alias("atr_pct"),
        F.when(ready, F.col("_rank")).otherwise(0.5).alias("atr_percentile"),
        F.when(ready, strength).otherwise(0.0).alias("trend_strength"),
        F.when(ready, strength).otherwise(0.0).alias("regime_confidence"),
    ).drop("_rank", "_slope")


def statistics(bars: DataFrame) -> DataFrame:
    """Per regime, those without bars too: share of bars in percent, mean Hurst exponent and mean atr_pct (2, 4, 6 digits)."""
    spark = bars.sparkSession
    dim = spark.createDataFrame([(r,) for r in REGIMES], "regime string")
    got = bars.groupBy("regime").agg(F.count("*").alias("bars"), F.avg("hurst").alias("h"), F.avg("atr_pct").alias("a"))
    total = bars.agg(F.count("*").alias("total"))
    d = F.broadcast(dim).join(got, "regime", "left").crossJoin(F.broadcast(total))  # one row
    return d.select("regime", F.coalesce("bars", F.lit(0)).alias("bars"), F.round(safe_divide(F.coalesce("bars", F.lit(0)) * 100.0, F.col("total")), 2).alias("pct"), F.round(F.coalesce("h", F.lit(0.0)), 4).alias("mean_hurst"), F.round(F.coalesce("a", F.lit(0.0)), 6).alias("mean_atr"))


def transitions(bars: DataFrame, top: int = 10) -> DataFrame:
    """The most frequent changes of regime from bar to bar; ties in order of the names."""
    d = on_slices(bars, lambda x, w: x.withColumn("from_regime", F.lag("regime").over(w)), 1)
    changed = d.where("from_regime is not null and from_regime <> regime")
    return changed.groupBy("from_regime", F.col("regime").alias("to_regime")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "from_regime", "to_regime").limit(top)


def histogram(rows: DataFrame, column: str, bins: int = 10) -> DataFrame:
    """Counts in equal-width bins between the least and the largest value, empty bins too."""
    spark = rows.sparkSession
    ends = rows.agg(F.min(column).alias("lo"), F.max(column).alias("hi"))
    b = F.least(F.floor(safe_divide((F.col(column) - F.col("lo")) * bins, F.col("hi") - F.col("lo"))), F.lit(bins - 1)).cast("int")
    counts = rows.where(F.col(column).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(b.alias("bin")).agg(F.count("*").alias("n"))  # one row
    return spark.range(bins).select(F.col("id").cast("int").alias("bin")).join(counts, "bin", "left").crossJoin(F.broadcast(ends)).select("bin", (F.col("lo") + (F.col("hi") - F.col("lo")) * F.col("bin") / bins).alias("bin_start"), F.coalesce("n", F.lit(0)).alias("n"))


# Share of a full position per regime.
SIZE_OF_REGIME = {"trend_up": 1.0, "trend_down": 1.0, "range": 0.7, "high_vol": 0.5}


def size_multiplier(regime="regime"):
    out = F.lit(0.0)
    for name, v in SIZE_OF_REGIME.items():
        out = F.when(F.col(regime) == name, v).otherwise(out)
    return out
