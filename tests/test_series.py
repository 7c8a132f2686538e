"""Series patterns: independence of slices, symbols, order and later bars; undefined values."""

import datetime as dt

import numpy as np
import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tapeloom.functions import scalar as S
from tapeloom.operators import labels, ledger, micro, regime, session
from tapeloom.operators.series import asof, ewm, index_bars, on_slices, rolling, running, zscore

H = 3_600_000


def bars(spark, n=120, symbols=("A", "B"), start=1_704_067_200_000, step=H):
    rng = np.random.default_rng(1)
    rows = []
    for s in symbols:
        close = 100 + np.cumsum(rng.normal(size=n))
        for i in range(n):
            o, c = float(close[max(0, i - 1)]), float(close[i])
            rows.append((s, start + i * step, o, max(o, c) + 0.5, min(o, c) - 0.5, c, float(50 + i % 7), float(20 + i % 5), 10))
    return spark.createDataFrame(rows, "symbol string, open_time long, open double, high double, low double, close double, volume double, taker_buy_volume double, trade_count long")


def rows_of(df, *cols):
    return sorted(tuple(None if v is None else round(v, 9) if isinstance(v, float) else v for v in r) for r in df.select(*cols).collect())


def test_index_is_dense(spark):
    got = index_bars(bars(spark)).groupBy("symbol").agg(F.min("bar_idx"), F.max("bar_idx"), F.countDistinct("bar_idx")).collect()
    assert {tuple(r)[1:] for r in got} == {(0, 119, 120)}


def test_slices_equal_plain_windows(spark):
    b = bars(spark)
    step = lambda d, w: d.select("*", F.avg("close").over(rolling(w, 20)).alias("m"), F.lead("close", 3).over(w).alias("f"), zscore("close", w, 10).alias("z"))
    plain = step(index_bars(b), Window.partitionBy("symbol").orderBy("open_time"))
    for size in (24, 32, 64):
        assert rows_of(on_slices(b, step, 20, 3, size=size), "symbol", "open_time", "m", "f", "z") == rows_of(plain, "symbol", "open_time", "m", "f", "z")
    with pytest.raises(ValueError):
        on_slices(b, step, 20, size=10)


@pytest.mark.parametrize("adjust", [True, False])
def test_exponential_means(spark, adjust):
    b = bars(spark, 900, ("A",))
    x = [r["close"] for r in b.orderBy("open_time").collect()]
    y, num, den, want = None, 0.0, 0.0, []
    for v in x:
        num, den = 0.8 * num + v, 0.8 * den + 1
        y = v if y is None else 0.8 * y + 0.2 * v
        want.append(num / den if adjust else y)
    got = [r["e"] for r in ewm(b, "close", 0.2, "e", adjust=adjust, size=256).orderBy("open_time").collect()]
    assert np.allclose(got, want, rtol=1e-10)


def test_asof_takes_the_latest_at_or_before(spark):
    left = spark.createDataFrame([("A", 10), ("A", 20), ("A", 5), ("B", 7), (None, 9), ("A", None), ("A", 3 * 86_400_000)], "symbol string, t long")
    right = spark.createDataFrame([("A", 10, 1.0), ("A", 10, 2.0), ("A", 19, 3.0), ("A", 21, 4.0), ("C", 1, 9.0), (None, 1, 7.0)], "symbol string, rt long, v double")
    got = {(r["symbol"], r["t"]): r["v"] for r in asof(left, right, "t", "rt", ["v"]).collect()}
    assert got == {("A", 10): 2.0, ("A", 20): 3.0, ("A", 5): None, ("B", 7): None, (None, 9): None, ("A", None): None, ("A", 3 * 86_400_000): 4.0}
    assert asof(left, right.limit(0), "t", "rt", ["v"]).where("v is not null").count() == 0


def test_running_across_spans(spark):
    b = bars(spark).withColumn("x", F.when(F.hour(F.timestamp_millis("open_time")) == 3, F.col("close")))
    w = Window.partitionBy("symbol").orderBy("open_time").rowsBetween(Window.unboundedPreceding, 0)
    plain = b.select("symbol", "open_time", F.sum("volume").over(w).alias("s"), F.max("close").over(w).alias("m"), F.last("x", True).over(w).alias("l"))
    got = running(b, {"s": ("sum", "volume"), "m": ("max", "close"), "l": ("last", "x")})
    assert rows_of(got, "symbol", "open_time", "s", "m", "l") == rows_of(plain, "symbol", "open_time", "s", "m", "l")


def test_no_feature_looks_ahead_or_aside(spark):
    whole, part, alone = bars(spark), bars(spark).where(F.col("open_time") < 1_704_067_200_000 + 80 * H), bars(spark).where("symbol = 'A'")
    chains = [micro.flow_features, micro.volume_features, micro.price_features, micro.efficiency_features, micro.ema_features, micro.volume_session_features, session.session_vwap, session.weekly_vwap, session.opening_ranges]
    for f in chains:
        cols = [c for c in f(whole).columns if c not in ("bar_idx",)]
        full = rows_of(f(whole), *cols)
        assert rows_of(f(part), *cols) == [r for r in full if r[cols.index("open_time")] < 1_704_067_200_000 + 80 * H], f.__name__
        assert rows_of(f(alone), *cols) == [r for r in full if r[cols.index("symbol")] == "A"], f.__name__
        assert f(whole.limit(0)).count() == 0
        assert rows_of(f(whole.orderBy(F.rand(3))), *cols) == full, f.__name__


def test_safe_divide_and_cdf(spark):
    d = spark.createDataFrame([(1.0, 2.0), (1.0, 0.0), (None, 2.0), (float("nan"), 1.0)], "a double, b double")
    assert [r[0] for r in d.select(S.safe_divide("a", "b", 7.0)).collect()] == [0.5, 7.0, 7.0, 7.0]
    z = spark.createDataFrame([(-1.96,), (0.0,), (1.0,)], "z double").select(S.normal_cdf("z")).collect()
    assert np.allclose([r[0] for r in z], [0.0249979, 0.5, 0.8413447], atol=2e-7)
    assert spark.range(1).select(S.normal_symbol(F.lit("btcusdt-perp.x"))).first()[0] == "BTCUSDT"
    assert spark.range(1).select(S.bar_open_of_close(F.lit(14_399_999), 14_400_000)).first()[0] == 0


def test_hurst_bounds():
    rng = np.random.default_rng(2)
    trend = np.exp(np.cumsum(0.01 + 0.001 * rng.normal(size=200)))
    assert regime.hurst_of(trend[:5]) == 0.5 and regime.hurst_of(np.ones(50)) == 0.5 and 0 <= regime.hurst_of(trend) <= 1


def test_regimes_are_labelled(spark):
    d = regime.detect(bars(spark, 200, ("A",)), lookback=60, min_bars=80, window=60)
    assert d.count() == 200 and d.where("bar_idx < 80 and regime <> 'range'").count() == 0
    assert set(r["regime"] for r in d.select("regime").distinct().collect()) <= set(regime.REGIMES)
    assert regime.statistics(d).count() == 4


def close_path(spark, closes, atr=0.01):
    rows = [("A", i * H, float(c), float(c), float(c), float(c), 1.0, atr) for i, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, open_time long, open double, high double, low double, close double, volume double, atr_pct double")


@pytest.mark.parametrize(("closes", "label", "t1"), [([100, 100.5, 102, 90], 1, 2), ([100, 98, 103, 103], -1, 1), ([100, 100.2, 100.1, 100.3], 0, 3)])
def test_triple_barrier_first_touch(spark, closes, label, t1):
    r = labels.triple_barrier(close_path(spark, closes), 1.5, 1.5, 3).first()
    assert (r["label"], r["t1_bar"]) == (label, t1)


def test_uniqueness_weights_average_one(spark):
    d = labels.target_rows(labels.triple_barrier(bars(spark).withColumn("atr_pct", F.lit(0.005)), 1.0, 1.0, 6))
    got = labels.uniqueness_weights(d).groupBy("symbol").agg(F.avg("weight").alias("w")).collect()
    assert all(abs(r["w"] - 1) < 1e-9 for r in got)


def test_split_has_an_embargo(spark):
    s = labels.temporal_split(bars(spark), 1_704_067_200_000 + 60 * H, 24)
    assert {r["role"]: r["count"] for r in s.groupBy("role").count().collect()} == {"train": 72, "test": 120}
    assert labels.leaks(s).first()["clean"]


def test_walk_forward_clamps_month_ends(spark):
    ms = lambda *a: int(dt.datetime(*a, tzinfo=dt.UTC).timestamp() * 1000)
    w = labels.walk_forward_windows(spark, ms(2023, 1, 31), ms(2024, 6, 30), 12, 1, 0).orderBy("fold").collect()
    assert w[0]["test_from"] == ms(2024, 1, 31) and w[0]["test_to"] == ms(2024, 2, 29) and w[1]["train_from"] == ms(2023, 2, 28)


SIG = "id long, symbol string, direction string, entry_price double, stop_loss double, take_profit double, created_at long"


def test_first_touch_prefers_the_stop(spark):
    day = 86_400_000
    b = spark.createDataFrame([("A", 0, 101.0, 99.0), ("A", day, 111.0, 89.0), ("A", 2 * day, 112.0, 95.0)], "symbol string, open_time long, high double, low double")
    s = spark.createDataFrame([(1, "A", "long", 100.0, 90.0, 110.0, 0), (2, "A", "short", 100.0, 120.0, 94.0, 0), (3, "A", "long", 100.0, 10.0, 500.0, 0)], SIG)
    got = {r["id"]: (r["result"], r["close_price"], round(r["pnl_pct"], 6)) for r in ledger.first_touch(s, b).collect()}
    assert got == {1: ("loss", 90.0, -10.0), 2: ("win", 94.0, 6.0)}


def test_performance_of_small_and_winning_ledgers(spark):
    rows = [(i, "A", "long", None, 0.6, 1000 + i, "win", 90_000_000 + i, 1.0, 1.5, 60) for i in range(4)]
    d = spark.createDataFrame(rows, "id long, symbol string, direction string, timeframe string, confidence double, created_at long, result string, closed_at long, pnl_pct double, rr_ratio double, duration_minutes long")
    r = ledger.performance(d, 10**12).first()
    assert r["profit_factor"] is None and r["sharpe"] is None and r["win_rate"] == 1.0
    assert ledger.performance(d.limit(0), 10**12).first()["closed"] == 0


def test_plans_have_no_cartesian_or_single_partition(spark):
    d = session.opening_ranges(micro.price_features(bars(spark)))
    plan = d._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "SinglePartition" not in plan and "Python" not in plan
