"""Surveyed rules on rows worked out by hand or by plain Python loops."""

import math
import random
import statistics

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import scalar
from tapeloom.operators import audit, backtest, bars, derivs, jobs, labels, ledger, models, regime, risk, session, validation
from tapeloom.sources import store
from tapeloom.streaming import streams

DAY = 86_400_000
HOUR = 3_600_000
SIGNALS = "id long, symbol string, direction string, timeframe string, result string, created_at long, closed_at long, pnl_pct double, rr_ratio double, duration_minutes long, confidence double"


def signals(spark, closed, more=()):
    """closed: (result, pnl, day of closing)."""
    rows = [(i, "X", "long", None, r, d * DAY, d * DAY + HOUR, p, 2.0, 90, 0.6) for i, (r, p, d) in enumerate(closed)]
    return spark.createDataFrame([*rows, *more], SIGNALS)


def test_performance_by_hand(spark):
    closed = [("win", 2.0, 0), ("loss", -1.0, 0), ("win", 3.0, 1), ("loss", -2.0, 2), ("breakeven", 0.0, 2), ("win", 1.0, 3), ("loss", -4.0, 4), ("win", 2.0, 5), ("win", 1.0, 6), ("loss", None, 7)]
    d = signals(spark, closed, [(90, "X", "long", "1h", "open", DAY, None, None, None, None, None), (91, "X", "long", "1h", "rejected", DAY, None, None, None, None, 0.9)])
    r = ledger.performance(d, 30 * DAY).first()
    daily = [0.01, 0.03, -0.02, 0.01, -0.04, 0.02, 0.01, 0.0]
    equity, peak, worst = 100.0, 100.0, 0.0
    for x in daily:
        equity *= 1 + x
        peak = max(peak, equity)
        worst = min(worst, (equity - peak) / peak * 100)
    mean, down = statistics.mean(daily), statistics.stdev([-0.02, -0.04])
    assert (r["total"], r["closed"], r["wins"], r["losses"], r["open"], r["rejected"], r["days_tracked"]) == (12, 10, 5, 4, 1, 1, 30)
    want = {"win_rate": 5 / 9, "profit_factor": 9 / 7, "expected_value": 0.2, "total_pnl_pct": equity - 100, "max_drawdown": worst, "sharpe": mean / statistics.stdev(daily) * math.sqrt(365), "sortino": mean / down * math.sqrt(365), "calmar": mean * 365 * 100 / -worst, "avg_rr": 2.0, "avg_hours": 1.5, "avg_confidence": (6.0 + 0.9) / 11}
    assert {k: r[k] for k in want} == pytest.approx(want)


def test_performance_of_few_or_only_winning_signals(spark):
    r = ledger.performance(signals(spark, [("win", 2.0, 0), ("win", 1.0, 1)]), 30 * DAY).first()
    assert r["profit_factor"] is None and r["sharpe"] is None and r["sortino"] is None and r["calmar"] is None and r["max_drawdown"] == 0
    r = ledger.performance(signals(spark, [("breakeven", 0.0, 0)]), 30 * DAY).first()
    assert r["profit_factor"] == 0 and r["win_rate"] == 0
    r = ledger.performance(signals(spark, [("win", 1.0 + k % 2, k) for k in range(12)]), 30 * DAY).first()
    assert r["sortino"] == r["sharpe"] > 0 and r["calmar"] == 0
    r = ledger.performance(signals(spark, []), 30 * DAY).first()
    assert r["total"] == 0 and r["total_pnl_pct"] == 0
    m = ledger.monthly(signals(spark, [("win", 2.0, 0), ("loss", -1.0, 3), ("breakeven", 0.0, 4), ("breakeven", 0.0, 40)])).orderBy("month").collect()
    assert [(x["month"], x["trades"], x["win_rate"]) for x in m] == [("1970-01", 3, 0.5), ("1970-02", 1, 0.0)]


def test_a_day_that_cancels_out_is_no_losing_day(spark):
    """In doubles 0.3 - 0.1 - 0.2 is below 0 and -0.2 - 0.1 + 0.3 is not, by the order of adding alone."""
    rest = [("loss", -1.0, 1), ("loss", -2.0, 2)] + [("win", 1.0, k) for k in range(3, 12)]
    day = [("win", 0.3, 0), ("loss", -0.1, 0), ("loss", -0.2, 0)]
    want = statistics.mean([0.0, -0.01, -0.02] + [0.01] * 9) / statistics.stdev([-0.01, -0.02]) * math.sqrt(365)
    for d in (day, day[::-1], [day[1], day[0], day[2]]):
        r = ledger.performance(signals(spark, d + rest).coalesce(1), 30 * DAY).first()
        assert r["sortino"] == pytest.approx(want)
    d = ledger.daily_equity(signals(spark, day).coalesce(1)).first()
    assert (d["pnl_pct"], d["drawdown_pct"]) == (0.0, 0.0)


def test_first_touch_equals_a_plain_scan(spark):
    rng = random.Random(5)
    tape, price = [], 100.0
    for k in range(900):  # six bars a day, over several blocks of days
        price *= 1 + rng.uniform(-0.01, 0.01)
        tape.append(("X" if k % 2 else "Y", k * 4 * HOUR, price * 1.004, price * 0.996))
    rows = []
    for i in range(300):
        long, entry, t = rng.random() < 0.5, rng.uniform(80, 120), rng.randrange(900) * 4 * HOUR + rng.choice([0, 5])
        a, b = entry * rng.choice([0.5, 0.97, 0.8]), entry * rng.choice([1.5, 1.03, 1.2])
        rows.append((i, rng.choice("XYZ"), "long" if long else "short", entry, a if long else b, b if long else a, t))
    want = {}
    for i, s, way, entry, stop, target, t in rows:
        low, high = math.inf, -math.inf
        for sym, at, h, l in tape:
            if sym == s and at >= t:
                low, high = min(low, l), max(high, h)
                lost, won = (l <= stop, h >= target) if way == "long" else (h >= stop, l <= target)
                if lost or won:
                    mae, mfe = (low - entry, high - entry) if way == "long" else (entry - high, entry - low)
                    want[i] = ("loss" if lost else "win", at + 4 * HOUR, min(mae, 0) / entry * 100, max(mfe, 0) / entry * 100)
                    break
    s = spark.createDataFrame(rows, "id long, symbol string, direction string, entry_price double, stop_loss double, take_profit double, created_at long")
    b = spark.createDataFrame(tape, "symbol string, open_time long, high double, low double")
    out = ledger.first_touch(s, b, 4 * HOUR)
    got = {r["id"]: (r["result"], r["closed_at"], r["mae_pct"], r["mfe_pct"]) for r in out.collect()}
    assert set(got) == set(want) and len(got) > 100
    for i, x in want.items():
        assert got[i][:2] == x[:2] and got[i][2:] == pytest.approx(x[2:]), i


def test_filters_of_the_risk_chain(spark):
    fine = {"drawdown_pct": 1.0, "weekly_pnl_pct": 0.0, "daily_pnl_pct": 0.0, "consecutive_losses": 0, "created_at": 10 * HOUR, "last_loss_at": 0, "open_positions": 0, "confidence": 0.6, "funding_rate": 0.0001, "atr_pct": 0.01, "notional": 100.0, "total_cost_bps": 3.0}
    cases = [({}, None), ({"consecutive_losses": 5, "last_loss_at": 7 * HOUR}, "consecutive_losses"), ({"consecutive_losses": 5, "last_loss_at": 6 * HOUR}, None), ({"consecutive_losses": 5, "last_loss_at": None}, "consecutive_losses"), ({"open_positions": 3}, "max_positions"), ({"confidence": 0.54}, "confidence"), ({"funding_rate": None}, "funding_rate"), ({"notional": 0.0}, "zero_notional"), ({"atr_pct": 0.0015}, None), ({"atr_pct": 0.0014}, "expected_return"), ({"atr_pct": 0.0059, "total_cost_bps": 20.0}, "expected_return"), ({"weekly_pnl_pct": -0.08, "daily_pnl_pct": -0.03}, "weekly_loss")]
    schema = "k int, drawdown_pct double, weekly_pnl_pct double, daily_pnl_pct double, consecutive_losses int, created_at long, last_loss_at long, open_positions int, confidence double, funding_rate double, atr_pct double, notional double, total_cost_bps double"
    d = spark.createDataFrame([(k, *(fine | c).values()) for k, (c, _) in enumerate(cases)], schema)
    got = {r["k"]: (r["reason"], r["approved"]) for r in risk.gated(d).collect()}
    assert got == {k: (w, w is None) for k, (_, w) in enumerate(cases)}
    s = risk.sized(spark.createDataFrame([(100.0, 1.0, "long", 10_000.0), (100.0, 0.01, "short", 10_000.0), (100.0, 0.0, "long", 10_000.0)], "entry_price double, atr double, direction string, equity double")).collect()
    assert s[0]["notional"] == pytest.approx(100 / 1.5 * 100) and s[0]["stop_loss"] == 98.5
    assert s[1]["notional"] == 100_000 and s[1]["leverage"] == 10 and s[2]["notional"] == 0


def test_breaker_router_and_decisions(spark):
    d = spark.createDataFrame([(-0.2, 0.0, 0.0, 0, 1.0, 1.0, 0.0), (0.0, -0.09, 0.0, 0, 1.0, 1.0, 0.0), (0.0, 0.0, -0.025, 0, 1.0, 1.0, 0.0), (-0.11, 0.0, 0.0, 0, 3.0, 1.0, 0.0), (0.0, 0.0, 0.0, 0, 1.0, 1.0, 0.002), (0.0, 0.0, 0.0, 5, 1.0, 0.0, 0.0)], "drawdown double, weekly_pnl_pct double, daily_pnl_pct double, consecutive_losses int, atr double, avg_atr double, funding_rate double")
    assert [(r["breaker"], r["size_multiplier"], r["drawdown_warning"]) for r in risk.breaker(d).collect()] == [("kill", 0.0, True), ("weekly_loss", 0.0, False), ("ok", 0.5, False), ("volatility", 0.5, True), ("funding", 1.0, False), ("loss_streak", 0.0, False)]
    d = spark.createDataFrame([("trend_up", 0.56), ("high_vol", 0.5), ("range", 0.58), ("range", 0.6)], "regime string, confidence double")
    assert [(r["model"], r["routed"]) for r in risk.route(d).collect()] == [("trend", True), ("high_vol", False), ("trend", False), ("trend", True)]
    d = spark.createDataFrame([(True, False, True, "trend_up", 1), (False, False, False, "trend_up", 1), (True, False, False, "range", 1), (True, False, False, "trend_up", -1), (True, False, False, "trend_up", 1), (False, True, False, "trend_down", -1)], "orb_breakout_bull boolean, orb_breakout_bear boolean, is_session_trap_zone boolean, regime string, direction int")
    assert [r["decision"] for r in risk.decide_15m(d).collect()] == ["trap", "no_breakout", "no_trend", "against_breakout", "take", "take"]


def test_round_trips_and_rebased_cash(spark):
    d = spark.createDataFrame([(1, "X", 1, 2.0, 100.0, 0.5, 10, True), (1, "X", 1, 2.0, 110.0, 0.5, 20, False), (2, "X", -1, 1.0, 50.0, 0.1, 11, True)], "order_id long, symbol string, side int, qty double, price double, fee double, ts long, opens boolean")
    r = risk.round_trips(d, 0.0).collect()
    assert len(r) == 1 and r[0]["pnl"] == pytest.approx(19.0) and r[0]["fees"] == 1.0
    s = risk.paper_stats(risk.round_trips(d, 0.0), d, 1000.0).first()
    assert s["equity"] == pytest.approx(1018.9) and (s["total_trades"], s["winning_trades"], s["losing_trades"], s["win_rate"], s["open_positions"]) == (1, 1, 0, 1.0, 1) and s["total_pnl_pct"] == pytest.approx(0.019)
    snap = spark.createDataFrame([("a", 5 * DAY, 1000.0), ("b", 5 * DAY, 50.0)], "account string, ts long, equity double")
    open_ = spark.createDataFrame([("a", 4 * DAY, 30.0), ("a", 4 * DAY, 20.0), ("a", 6 * DAY, 99.0)], "account string, ts long, unrealised double")
    assert {x["account"]: x["cash"] for x in risk.rebased(snap, open_).collect()} == {"a": 950.0, "b": 50.0}


def tape(spark, closes, **columns):
    rows = [("X", k * 15 * 60_000, float(c), *(float(v[k]) for v in columns.values())) for k, c in enumerate(closes)]
    return spark.createDataFrame(rows, "symbol string, open_time long, close double" + "".join(f", {c} double" for c in columns))


def test_open_interest_velocity_by_hand(spark):
    rng = random.Random(2)
    oi, close = [100.0], [10.0]
    for _ in range(60):
        oi.append(max(0.0, oi[-1] + rng.choice([-3, -1, 1, 2, 4])))
        close.append(close[-1] * (1 + rng.uniform(-0.02, 0.02)))
    n, want = 10, []
    for k in range(len(oi)):
        a, b = oi[max(0, k - n + 1) : k + 1], close[max(0, k - n + 1) : k + 1]
        if len(a) < 3:
            want.append((0.0, 0.0, 0.0, 0, 0.0))
            continue
        v = [(y - x) / x if x > 0 else 0.0 for x, y in zip(a, a[1:])]
        r = [(y - x) / x if x > 0 else 0.0 for x, y in zip(b, b[1:])]
        corr = statistics.correlation(v, r) if len(set(v)) > 1 and len(set(r)) > 1 else 0.0
        prior = v[:-1]
        tired = int(len(v) >= 4 and sum(x > 0 for x in prior) >= max(2, int(0.6 * len(prior))) and v[-1] < 0)
        sd = statistics.pstdev(prior)
        want.append((v[-1], v[-1] - v[-2], corr, tired, (v[-1] - statistics.mean(prior)) / sd if sd else 0.0))
    out = derivs.oi_velocity(tape(spark, close, oi_value=oi), n).orderBy("open_time").collect()
    got = [(r["oi_velocity"], r["oi_acceleration"], r["oi_price_divergence"], r["oi_exhaustion"], r["oi_velocity_zscore"]) for r in out]
    assert sum(w[3] for w in want) > 2
    for g, w in zip(got, want, strict=True):
        assert g == pytest.approx(w, abs=1e-9)


def test_basis_and_sentiment_by_hand(spark):
    perp = tape(spark, [101, 102, 100, 0], funding_rate=[0.0003, -0.0001, 0.0001, 0.01])
    spot = tape(spark, [100, 100, 100, 100])
    r = derivs.annualised_basis(perp, spot).orderBy("open_time").collect()
    assert [x["basis_bps"] for x in r] == pytest.approx([100, 200, 0, 0])
    assert [x["basis_annualized"] for x in r] == pytest.approx([32.85, -10.95, 10.95, 0])
    assert [x["basis_extreme_sign"] for x in r] == [-1, 1, 0, 0]
    assert [x["basis_zscore_30d"] for x in r] == pytest.approx([0, 0, (0 - 150) / 50, 0])
    d = spark.createDataFrame([(10, 1.0, math.e**1.5), (90, 2.0, 1.0), (None, None, None), (150, 0.0, 1.0)], "fear_greed int, long_short_ratio double, top_trader_ls_ratio double")
    got = [(x["fear_greed_norm"], x["fear_greed_extreme"], x["ls_divergence"], x["sentiment_score"]) for x in derivs.sentiment(d).collect()]
    lean = math.log(0.5) / 1.5
    for g, w in zip(got, [(0.1, 1, 1.0, -0.48 + 0.4 + 0.2), (0.9, -1, lean, 0.48 + 0.4 * lean - 0.2), (0.5, 0, 0.0, 0.0), (1.0, -1, 0.0, 0.4)], strict=True):
        assert g == pytest.approx(w)


def test_liquidation_clusters_by_hand(spark):
    rows = spark.createDataFrame([("X", 100 * HOUR, 100.0, 10.0), ("Y", 100 * HOUR, 100.0, 10.0), ("X", 10 * HOUR, 0.0, 1.0)], "symbol string, open_time long, close double, atr double")
    orders = [(99, 103.5, 2.0, "SELL"), (98, 107.2, 5.0, "sell"), (90, 109.0, 1.0, "SELL"), (90, 101.5, 0.1, "SELL"), (98.5, 95.5, 4.0, "BUY"), (80, 80.0, 1.0, "BUY"), (70, 99.0, 100.0, "BUY"), (101, 99.0, 100.0, "BUY"), (99, -1.0, 5.0, "BUY"), (99, 99.0, 0.0, "BUY")]
    o = spark.createDataFrame([("X", int(t * HOUR), p, q, s) for t, p, q, s in orders], "symbol string, time long, price double, qty double, side string")
    out = {(r["symbol"], r["open_time"]): r for r in derivs.liquidation_proximity(rows, o).collect()}
    r = out["X", 100 * HOUR]
    long_, short = 2 * 103.5 + 5 * 107.2 + 109.0 + 10.15, 4 * 95.5 + 80.0
    last = 2 * 103.5 + 5 * 107.2 + 4 * 95.5
    assert r["liq_cluster_long_pct"] == pytest.approx(3.5) and r["liq_cluster_short_pct"] == pytest.approx(4.5)
    assert r["liq_imbalance"] == pytest.approx((long_ - short) / (long_ + short)) and r["liq_volume_1h"] == pytest.approx(last) and r["liq_cascade_risk"] == pytest.approx(last / (long_ + short))
    for k in (("Y", 100 * HOUR), ("X", 10 * HOUR)):
        assert all(out[k][c] == 0 for c in r.asDict() if c.startswith("liq_"))


def test_sessions_and_the_first_bars_of_opening_ranges(spark):
    assert session.SESSION_OF_HOUR == [0, 0, 0, 0, 0, 1, 1, 1, 2, 2, 2, 2, 2, 3, 4, 4, 4, 3, 3, 3, 3, 3, 0, 0]
    assert session.HOURS_TO_END == [5, 4, 3, 2, 1, 3, 2, 1, 5, 4, 3, 2, 1, 9, 3, 2, 1, 5, 4, 3, 2, 1, 7, 6]
    closes = [100.0] * 4 + [103.0] + [100.0] * 15
    b = tape(spark, closes, high=[c + 1 for c in closes], low=[c - 1 for c in closes], volume=[1.0] * 20)
    r = session.opening_ranges(b).orderBy("open_time").collect()
    assert r[4]["orb_breakout_bull"] and not r[5]["orb_breakout_bull"]
    assert [x["orb_range_asia_atr_pct"] for x in r[12:14]] == pytest.approx([0.0, 1.0])


def test_intrabar_breakouts_by_extremes(spark):
    high = [10, 10, 10, 10, 12, 11, 11, 11]
    low = [9, 9, 9, 9, 9, 8, 9, 9]
    b = tape(spark, [9.5] * 8, high=high, low=low, volume=[2.0] * 8, taker_buy_volume=[1.0] * 8)
    assert bars.intrabar(b).first()["breakout_share"] == pytest.approx(2 / 4)


def test_random_entries_do_not_depend_on_slices(spark):
    rng = random.Random(1)
    b = tape(spark, [100 + rng.random() for _ in range(700)])
    got = [sorted((r["bar_idx"], r["ret"]) for r in backtest.random_entries(b, 0.3, 5, 7, n).collect()) for n in (16, 64, 4096)]
    assert got[0] == got[1] == got[2] and all(y[0] - x[0] >= 5 for x, y in zip(got[0], got[0][1:])) and len(got[0]) > 80


def test_walk_forward_gate_by_hand(spark):
    w = spark.createDataFrame([(1.0, 0.1), (0.5, 0.2), (-2.0, -0.05)], "sharpe double, total_return double")
    r = backtest.walk_forward_summary(w).first()
    assert r["profitable_pct"] == pytest.approx(66.6667, abs=1e-3) and r["avg_sharpe"] == pytest.approx(-0.5 / 3) and r["worst_sharpe"] == -2.0 and r["sum_return"] == pytest.approx(0.25)
    assert r["failed"] == ["avg_sharpe", "worst_sharpe"] and not r["passed"]


def test_classification_by_hand(spark):
    d = spark.createDataFrame([(1, 1), (1, 1), (1, -1), (-1, -1), (-1, 1)], "t int, p int")
    r = backtest.classification(d, "t", "p").first()
    assert (r["accuracy"], r["precision"], r["recall"]) == (60.0, 60.0, 60.0)


def test_audits_by_hand(spark):
    d = spark.createDataFrame([("a", 0, 10), ("a", 1, 20), ("a", 2, 15), ("b", 0, 5)], "_file string, _pos int, transact_time long")
    assert {r["_file"]: (r["rows"], r["monotonic"], r["max_step_ms"]) for r in audit.clock_drift(d).collect()} == {"a": (3, False, 10), "b": (1, True, 0)}
    p = spark.createDataFrame([("a", '{"last_signal_ts": 1000}'), ("b", '{"last_signal_ts": null}'), ("c", '{"x": 1}'), ("d", '{"last_signal_ts": "zz"}'), ("e", None)], "source string, payload string")
    n = spark.createDataFrame([("a", 400_000)], "source string, newest long")
    assert {r["source"]: (r["kind"], r["lags"]) for r in audit.published(p, n).collect()} == {"a": ("number", True), "b": ("none", False), "c": ("absent", False), "d": ("corrupt", False), "e": ("absent", False)}
    e = spark.createDataFrame([("a", "x"), ("a", "y"), ("b", "x")], "source string, event string")
    last = spark.createDataFrame([("a", "x", 50), ("b", "x", 10)], "source string, event string, alerted_at long")
    assert sorted((r["source"], r["event"]) for r in audit.alerts_due(e, last, 100, 60).collect()) == [("a", "y"), ("b", "x")]


def test_training_rows_and_embargo(spark):
    d = spark.createDataFrame([("X", k * HOUR, "trend_up" if k % 3 else "range", 1 if k % 2 else -1) for k in range(40)] + [("Y", k * HOUR, "trend_up", 1) for k in range(40)], "symbol string, open_time long, regime string, target int")
    got = labels.training_rows(d, 20 * HOUR, ["trend_up"], HOUR, 4).groupBy("symbol", "role").agg(F.count("*").alias("n"), F.min("open_time").alias("a"), F.max("open_time").alias("b")).collect()
    assert sorted((r["symbol"], r["role"], r["n"], r["a"] // HOUR, r["b"] // HOUR) for r in got) == [("X", "test", 13, 20, 38), ("X", "train", 10, 1, 14)]
    e = labels.embargo_fit_end(d.where("symbol = 'X'"), 20 * HOUR, 5 * HOUR).first()
    assert (e["n"], e["fit_end"]) == (20, 15)
    assert labels.embargo_fit_end(d.where("symbol = 'X'"), 20 * HOUR, 18 * HOUR).first()["fit_end"] == 10
    s = labels.sample_size_ok(spark.createDataFrame([(49, 0.5), (400, 0.5), (350, 0.5)], "n int, p double")).collect()
    assert [r["sufficient"] for r in s] == [False, True, False]


def test_ledgers_are_united_and_versioned(spark):
    a = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (2, "z", 1)], "id int, state string, v int")
    assert {r["id"]: r["state"] for r in ledger.latest(a, ["id"], "v").collect()} == {1: "y", 2: "z"}
    u = ledger.union_ledgers(main=a, other=a.select("id"))
    assert u.where("source = 'other'").count() == 3 and u.where("source = 'other' and state is not null").count() == 0


def test_ranked_cells_and_regime_sizes(spark):
    c = spark.createDataFrame([("a", 0.6, 2.0), ("b", 0.9, 150.0), ("c", 0.4, 9.0)], "cell string, win_rate double, profit_factor double")
    assert [(r["cell"], round(r["score"], 6)) for r in models.rank_grid(c).collect()] == [("b", 4.0), ("a", 2.0), ("c", -9.0)]
    d = spark.createDataFrame([(k,) for k in [*regime.SIZE_OF_REGIME, "unknown"]], "regime string").withColumn("m", regime.size_multiplier())
    assert {r["regime"]: r["m"] for r in d.collect()} == {**regime.SIZE_OF_REGIME, "unknown": 0.0}
    assert models.feature_columns(spark.createDataFrame([(1, 2.0, "s", True)], "symbol int, b double, c string, a boolean")) == ["a", "b"]


def test_out_of_sample_report(spark):
    t = spark.createDataFrame([(0, 0.02, True), (1, -0.01, True), (DAY, 0.01, False), (2 * DAY, 0.03, True)], "open_time long, ret double, taken boolean")
    r = validation.out_of_sample_report(t, 0.001).first()
    assert (r["trades"], r["coverage"]) == (3, 0.75) and r["win_rate"] == pytest.approx(200 / 3) and r["profit_factor"] == pytest.approx(0.048 / 0.011) and r["fee_multiple"] == pytest.approx((0.019 - 0.011 + 0.029) / 3 / 0.001)
    one = lambda c, v: spark.createDataFrame([(v,)], f"{c} double")
    v = validation.validation_report(validation.out_of_sample_report(t), one("dsr", 0.96), one("pbo", 0.2), one("t_stat", 2.0)).first()
    assert v["failed"] == ["t_stat", "signals"]


def test_validation_of_1h_models(spark):
    """Enough trades for a margin of 5 %, windows with a profit factor over 1, and thresholds of their own."""
    one = lambda name, v: spark.createDataFrame([(v,)], f"{name} double")
    oos = lambda n, wr: spark.createDataFrame([(n, wr, 1.5, 1.2, 4.0, 0.3)], "trades long, win_rate double, profit_factor double, sharpe double, fee_multiple double, coverage double")
    w = spark.createDataFrame([(55.0, 1.4), (52.0, 1.1), (40.0, 0.7)], "win_rate double, profit_factor double")
    good = validation.validation_report_1h(oos(500, 55.0), w, one("dsr", 0.99), one("pbo", 0.1), one("t_stat", 3.5)).first()
    assert good["passed"] and good["profitable_windows_pct"] == pytest.approx(200 / 3)
    bad = validation.validation_report_1h(oos(300, 50.0), w.limit(0), one("dsr", 0.99), one("pbo", 0.4), one("t_stat", 3.5)).first()
    assert bad["failed"] == ["win_rate", "enough", "profitable_windows_pct", "pbo"]


def test_store_splits_and_funding(spark, tmp_dir):
    d = spark.createDataFrame([("X", 1, 0.2), ("X", 2, 0.8), ("Y", 3, 0.9)], "symbol string, open_time long, p double")
    store.write_splits(d, f"{tmp_dir}/s", {"high": F.col("p") > 0.5, "all": F.lit(True)})
    assert sorted((r["symbol"], r["split"], r["open_time"]) for r in spark.read.parquet(f"{tmp_dir}/s").collect()) == [("X", "all", 1), ("X", "all", 2), ("X", "high", 2), ("Y", "all", 3), ("Y", "high", 3)]
    store.monthly_funding(spark.createDataFrame([("X", 0, 0.1), ("X", 40 * DAY, 0.2)], "symbol string, fundingTime long, fundingRate double"), f"{tmp_dir}/f")
    assert sorted(r["month"] for r in spark.read.option("basePath", f"{tmp_dir}/f").parquet(f"{tmp_dir}/f").select(F.col("month").cast("string")).collect()) == ["1970-01", "1970-02"]


def test_a_replayed_epoch_changes_nothing(spark, tmp_dir):
    run = streams.live_features(f"{tmp_dir}/t", f"{tmp_dir}/o", lambda d: d.withColumn("n", F.count("*").over(__import__("pyspark").sql.Window.partitionBy("symbol"))), 3, HOUR)
    batch = lambda *ks: spark.createDataFrame([("X", k * HOUR, float(k)) for k in ks], "symbol string, open_time long, close double")
    run(batch(1, 2), 0)
    run(batch(3, 4), 1)
    run(batch(3, 4), 1)
    assert spark.read.parquet(f"{tmp_dir}/t").count() == 4
    assert sorted((r["epoch"], r["open_time"] // HOUR, r["n"]) for r in spark.read.parquet(f"{tmp_dir}/o").collect()) == [(0, 2, 2), (1, 4, 3)]


def test_open_times_of_close_times(spark):
    d = spark.createDataFrame([(HOUR - 1,), (HOUR,), (2 * HOUR - 1,)], "t long").select(scalar.bar_open_of_close("t", HOUR).alias("o"))
    assert [r["o"] for r in d.collect()] == [0, 0, HOUR]


def test_meta_model_learns_when_the_base_model_is_right(spark):
    rng = random.Random(4)
    rows = []
    for k in range(1200):
        x, p = rng.random(), rng.random()
        right = rng.random() < (0.9 if x > 0.5 else 0.15)
        up = p >= 0.5
        rows.append(("X" if k % 2 else "Y", (k // 2) * HOUR, x, p, (0.01 if up == right else -0.01), "trend_up"))
    d = labels.meta_labels(spark.createDataFrame(rows, "symbol string, open_time long, x double, p_up double, future_return double, regime string"), 0.0006)
    _, report, table = jobs.meta_model(d, ["x", "hour_sin"], 0.7)
    r = report.first()
    assert r["test_rows"] == 360 and r["auc"] > 0.8
    t = {x["threshold"]: x for x in table.collect()}
    assert t[0.6]["win_rate"] > 0.75 > r["win_rate"] / 100 and 0 < t[0.6]["n_taken"] < 300
    split = jobs.split_by_time(d, 0.7).groupBy("role").agg(F.count("*").alias("n"), F.min("open_time").alias("a"), F.max("open_time").alias("b"))
    s = {x["role"]: x for x in split.collect()}
    assert s["train"]["n"] == 840 and s["train"]["b"] < s["test"]["a"]


def test_queries_with_fixed_dates_or_names_are_not_empty(spark):
    from tapeloom.plans import registry

    names = ["range_scan", "daily_equity", "purged_folds", "walk_forward_windows", "newest_signals", "newest_of_all_ledgers", "performance_cube", "largest_gaps", "funding_settlements", "revenue", "mean_funding", "ledger_freshness", "temporal_split"]
    known = registry.queries()
    assert not [n for n in names if known[n](spark, "/root/testdata/sf0.01").isEmpty()]
