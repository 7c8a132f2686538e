"""Composite jobs: feature matrices, datasets and back-tests built of the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.lineage import cut
from tapeloom.functions.scalar import safe_divide
from tapeloom.operators import derivs, labels, micro, models, mtf, regime, session
from tapeloom.operators.series import index_bars


def trim(features: DataFrame, lookback: int = 540, base: int = 200) -> DataFrame:
    """Without each symbol's first base + lookback bars; without its first `base` if it has no more than that; its last bar
    alone if it has no more than base."""
    d = features if "bar_idx" in features.columns else index_bars(features)
    n = d.groupBy("symbol").agg(F.max("bar_idx").alias("_last"))
    d = d.join(n, "symbol")
    count = F.col("_last") + 1
    first = F.when(count > base + lookback, base + lookback).when(count > base, base).otherwise(F.col("_last"))
    return d.where(F.col("bar_idx") >= first).drop("_last")


def taker_volume(bars: DataFrame) -> DataFrame:
    """taker_buy_volume: as it is, or from its older name, or half the volume."""
    have = set(bars.columns)
    options = [F.col(c) for c in ("taker_buy_volume", "taker_buy_base_vol") if c in have] + [F.col("volume") * 0.5]
    return bars.withColumn("taker_buy_volume", F.coalesce(*options))


def matrix(bars: DataFrame, funding: DataFrame, metrics: DataFrame, bar_minutes: int = 240, **regime_options) -> DataFrame:
    """The feature matrix of one interval, all symbols: flow, volume, returns, funding, open interest, regimes."""
    d = cut(micro.price_features(micro.volume_features(micro.flow_features(taker_volume(bars)))))
    d = cut(derivs.basis_features(derivs.funding_features(d, funding, bar_minutes)))
    d = cut(derivs.oi_features(d, metrics, bar_minutes))
    return cut(regime.detect(d, **regime_options))


def chain(features: DataFrame, interval: str, bars_1h: DataFrame | None = None, bars_4h: DataFrame | None = None) -> DataFrame:
    """What an interval adds to the matrix: the clock and session prices below 4h, derived features, and higher timeframes'
    context (1h) or opening ranges and context (15m); nothing at 4h."""
    if interval == "4h":
        return features
    d = session.weekday_features(session.funding_clock(session.weekly_vwap(session.session_vwap(session.session_features(features)))))
    d = cut(micro.flow_derived(derivs.oi_derived(derivs.funding_momentum(d))))
    d = cut(session.session_momentum(micro.efficiency_features(micro.volume_session_features(micro.ema_features(micro.candle_features(d))))))
    if interval == "1h":
        return mtf.for_1h(d, bars_4h) if bars_4h is not None else d
    d = cut(session.opening_ranges(d))
    return mtf.for_15m(d, bars_1h, bars_4h) if bars_1h is not None and bars_4h is not None else d


# How regimes are told at an interval below 4h, and the bars that its features need before the first row.
REGIME_1H = {"period": 10, "lookback": 168, "min_bars": 100, "window": 100, "vol_threshold": 0.75, "trend_threshold": 20.0}
WARMUP_1H, BARRIERS_1H = 200, (1.5, 1.0, 6)


def without_warmup(features: DataFrame, bars: int) -> DataFrame:
    """Without each symbol's first bars; a symbol that has no more than them keeps all."""
    d = features if "bar_idx" in features.columns else index_bars(features)
    n = d.groupBy("symbol").agg(F.max("bar_idx").alias("_last"))
    return d.join(n, "symbol").where((F.col("bar_idx") >= bars) | (F.col("_last") < bars)).drop("_last")


def dataset_1h(bars: DataFrame, bars_4h: DataFrame, funding: DataFrame, metrics: DataFrame, warmup: int = WARMUP_1H) -> DataFrame:
    """Labelled 1h rows of all symbols: the feature matrix, the clock, session prices, derived features and the 4h context, without
    the warm-up; decided labels with the splits trend and high_vol."""
    features = chain(matrix(bars, funding, metrics, 60, **REGIME_1H), "1h", bars_4h=bars_4h)
    return dataset(cut(without_warmup(features, warmup).drop("bar_idx")), *BARRIERS_1H, False, "high_vol")


def dataset(features: DataFrame, up: float, down: float, horizon: int, trap_filter: bool, splits: str = "orb") -> DataFrame:
    """Labelled rows with the tags of the splits they belong to: decided labels only, those in a trap zone left out if
    asked (an unknown zone stays), trend by regime, and breakouts (orb) or high volatility."""
    d = labels.target_rows(labels.triple_barrier(features, up, down, horizon))
    if trap_filter:
        d = d.where(~F.coalesce(F.col("is_session_trap_zone"), F.lit(False)))
    trend = F.col("regime").isin("trend_up", "trend_down")
    second = F.col("orb_breakout_bull") | F.col("orb_breakout_bear") if splits == "orb" else F.col("regime") == "high_vol"
    return d.withColumn("splits", F.array_compact(F.array(F.when(trend, "trend"), F.when(second, splits))))


def dataset_summary(rows: DataFrame) -> DataFrame:
    """Per split: rows, share of longs, symbols, time range. A row counts in each of its splits."""
    d = rows.withColumn("split", F.explode("splits"))
    return d.groupBy("split").agg(F.count("*").alias("rows"), F.round(safe_divide(F.count_if(F.col("target") == 1) * 100.0, F.count("*")), 4).alias("long_pct"), F.countDistinct("symbol").alias("symbols"), F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time"))


# The base models' regimes and barriers (up, down, bars).
BASE_MODELS = {"trend": (("trend_up", "trend_down"), (1.25, 1.0, 4)), "high_vol": (("high_vol",), (1.25, 1.0, 6))}


def meta_dataset(features: DataFrame, score, models: dict = BASE_MODELS, cost: float = 0.0006) -> DataFrame:
    """Rows of a meta model: of each base model the bars of its regimes with its barriers' outcome, its probability (score(rows,
    name) adds p_up), direction and confidence, the net return after cost, and whether that is positive."""
    out = None
    for name, (regimes, (up, down, bars)) in models.items():  # a few models
        rows = labels.triple_barrier(features, up, down, bars).where(F.col("regime").isin(*regimes))
        one = labels.meta_labels(score(rows, name), cost).withColumn("base_regime", F.lit(name))
        out = one if out is None else out.unionByName(one, allowMissingColumns=True)
    return out


def meta_summary(rows: DataFrame) -> DataFrame:
    """Of all rows, of each base model and of each symbol: rows, positive ones and their share, mean confidence, mean and
    deviation of the net return."""
    by = rows.groupingSets([[], ["base_regime"], ["symbol"]], "base_regime", "symbol")
    n, good = F.count("*"), F.sum("meta_target")
    return by.agg(n.alias("rows"), good.alias("good"), (good * 100.0 / n).alias("good_pct"), F.avg("base_confidence").alias("mean_confidence"), F.avg("net_return").alias("mean_net"), F.stddev_samp("net_return").alias("std_net"))


def split_by_time(rows: DataFrame, share: float = 0.7) -> DataFrame:
    """role 'train' for the first `share` of the rows in the order of time and 'test' for the rest; rows of one time go
    together, to the side that the first of them is on."""
    times = cut(rows.groupBy("open_time").agg(F.count("*").alias("_k")))
    months = times.groupBy(F.floor(F.col("open_time") / (30 * 86_400_000)).alias("_m")).agg(F.sum("_k").alias("_s"))
    before = months.select("_m", F.coalesce(F.sum("_s").over(Window.orderBy("_m").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_b"))  # a row a month
    inside = times.withColumn("_m", F.floor(F.col("open_time") / (30 * 86_400_000)))
    inside = inside.withColumn("_i", F.coalesce(F.sum("_k").over(Window.partitionBy("_m").orderBy("open_time").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    total = times.agg(F.sum("_k").alias("_t"))
    roles = inside.join(before, "_m").crossJoin(total).select("open_time", F.when(F.col("_b") + F.col("_i") < F.floor(F.col("_t") * share), "train").otherwise("test").alias("role"))  # total: one row
    return rows.join(roles, "open_time")


def meta_model(rows: DataFrame, features: list[str], share: float = 0.7, thresholds: tuple[float, ...] = (0.5, 0.55, 0.6, 0.65, 0.7), kind: str = "logistic"):
    """(model, report, thresholds): a model of meta_target fitted on the first `share` of the time with the classes weighted
    alike; one row of its test: rows, share of good ones, AUC, win rate and profit factor without the gate; and its table of
    thresholds."""
    d = cut(split_by_time(rows, share))
    as_target = d.withColumn("target", F.when(F.col("meta_target") == 1, 1).otherwise(-1))
    model = models.fit(as_target.where("role = 'train'"), features, kind=kind)
    test = cut(models.score(model, as_target.where("role = 'test'").drop("p_up"), features))
    net = F.col("net_return")
    won, lost = F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0.0)), F.coalesce(-F.sum(F.when(net < 0, net)), F.lit(0.0))
    report = test.agg(F.count("*").alias("test_rows"), F.avg("meta_target").alias("base_rate"), F.lit(models.auc(test)).alias("auc"), (F.count_if(net > 0) * 100.0 / F.count("*")).alias("win_rate"), F.when(lost > 0, won / lost).otherwise(F.lit(float("inf"))).alias("profit_factor"))
    return model, report, labels.threshold_table(test, list(thresholds), p="p_up")
