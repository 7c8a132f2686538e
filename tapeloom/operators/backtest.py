"""Equity metrics, gates and table back-tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.lineage import cut
from tapeloom.functions.scalar import DAY_MS, safe_divide
from tapeloom.operators.ledger import first_touch
from tapeloom.operators.risk import with_costs
from tapeloom.operators.series import asof, on_slices


def daily_returns(curve: DataFrame, by: list[str], ts: str = "ts", equity: str = "equity") -> DataFrame:
    """Last equity of each day and its return on the day before (null at first or after equity of 0 or less)."""
    days = curve.groupBy(*by, F.floor(F.col(ts) / DAY_MS).alias("day")).agg(F.max_by(equity, ts).alias("equity"))
    before = F.lag("equity").over(Window.partitionBy(*by).orderBy("day"))
    return days.withColumn("ret", F.when(before > 0, F.col("equity") / before - 1.0))


def equity_metrics(curve: DataFrame, by: list[str], ts: str = "ts", equity: str = "equity", per_year: float = 365.0) -> DataFrame:
    """Sharpe (of daily returns; 0 with fewer than two or without spread), worst drawdown in percent, total and annual
    return, Calmar (0 without a drawdown). A curve is one row per group and time; days are few, so windows run on days
    but for the running peak, which is taken over daily highs, too."""
    d = daily_returns(curve, by, ts, equity)
    r = F.col("ret")
    sharpe = d.groupBy(*by).agg(F.count("ret").alias("_n"), F.avg(r).alias("_m"), F.stddev_samp(r).alias("_s"))
    spans = curve.withColumn("_day", F.floor(F.col(ts) / DAY_MS))
    inside = Window.partitionBy(*by, "_day").orderBy(ts).rowsBetween(Window.unboundedPreceding, 0)
    tops = spans.groupBy(*by, "_day").agg(F.max(equity).alias("_top"))
    earlier = tops.select(*by, "_day", F.max("_top").over(Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, -1)).alias("_before"))
    peak = F.greatest(F.max(equity).over(inside), F.col("_before"))
    down = spans.join(earlier, [*by, "_day"]).withColumn("_peak", peak)
    dd = down.groupBy(*by).agg(F.max(F.when(F.col("_peak") > 0, (F.col("_peak") - F.col(equity)) / F.col("_peak") * 100.0).otherwise(0.0)).alias("max_drawdown"), F.min_by(equity, ts).alias("_e0"), F.max_by(equity, ts).alias("_e1"), F.min(ts).alias("_t0"), F.max(ts).alias("_t1"))
    total = F.when(F.col("_e0") > 0, F.col("_e1") / F.col("_e0") - 1.0)
    days = (F.col("_t1") - F.col("_t0")) / DAY_MS
    annual = F.when((days > 0) & (total > -1), F.pow(1.0 + total, per_year / days) - 1.0)
    return dd.join(sharpe, by).select(
        *by,
        F.when((F.col("_n") >= 2) & (F.col("_s") >= 1e-8), F.col("_m") / F.col("_s") * F.sqrt(F.lit(per_year))).otherwise(0.0).alias("sharpe"),
        "max_drawdown",
        F.coalesce(total, F.lit(0.0)).alias("total_return"),
        F.coalesce(annual, F.lit(0.0)).alias("annual_return"),
        F.when(F.col("max_drawdown") > 0, F.coalesce(annual, F.lit(0.0)) / (F.col("max_drawdown") / 100.0)).otherwise(0.0).alias("calmar"),
    )


def trade_metrics(trades: DataFrame, by: list[str], pnl: str = "pnl") -> DataFrame:
    """Trades, win rate in percent, profit factor (infinite without losses)."""
    won, lost = F.coalesce(F.sum(F.when(F.col(pnl) > 0, F.col(pnl))), F.lit(0.0)), F.coalesce(-F.sum(F.when(F.col(pnl) < 0, F.col(pnl))), F.lit(0.0))
    return trades.groupBy(*by).agg(F.count("*").alias("trades"), (safe_divide(F.count_if(F.col(pnl) > 0), F.count("*")) * 100.0).alias("win_rate"), F.when(lost > 0, won / lost).otherwise(F.lit(float("inf"))).alias("profit_factor"))


def bot_metrics(trades: DataFrame, initial: float, by: list[str] | None = None, pnl: str = "pnl", per_year: float = 6 * 365.0) -> DataFrame:
    """What a bot reports of its closed trades: trades, wins as a share, profit factor (0 without losses), and the Sharpe ratio of
    P&L over the initial equity, by the periods of a year (4h bars); 0 for fewer than two trades or no deviation. A trade that
    gains nothing is a lost one."""
    r = F.col(pnl) / F.lit(float(initial))
    won, lost = F.coalesce(F.sum(F.when(F.col(pnl) > 0, F.col(pnl))), F.lit(0.0)), F.coalesce(F.sum(F.when(~(F.col(pnl) > 0), F.col(pnl))), F.lit(0.0))
    d = trades.where(F.col(pnl).isNotNull()).groupBy(*(by or []))
    return d.agg(
        F.count("*").alias("trades"), safe_divide(F.count_if(F.col(pnl) > 0), F.count("*")).alias("win_rate"), F.when(lost != 0, won / F.abs(lost)).otherwise(0.0).alias("profit_factor"),
        F.when((F.count("*") >= 2) & (F.stddev_samp(r) >= 1e-10), F.avg(r) / F.stddev_samp(r) * F.sqrt(F.lit(per_year))).otherwise(0.0).alias("sharpe"),
    )


def window_performance(rows: DataFrame, by: list[str], ret: str = "future_return", p_up: str = "p_up", threshold: float = 0.55) -> DataFrame:
    """Of rows whose confidence reaches the threshold: win rate in percent (a zero return is no win), profit factor (at most
    999), rate of signals, mean confidence."""
    conf = F.greatest(p_up, 1 - F.col(p_up))
    net = F.col(ret) * F.when(F.col(p_up) >= 0.5, 1).otherwise(-1)
    on = conf >= threshold
    won, lost = F.coalesce(F.sum(F.when(on & (net > 0), net)), F.lit(0.0)), F.coalesce(-F.sum(F.when(on & (net < 0), net)), F.lit(0.0))
    n = F.count_if(on)
    return rows.groupBy(*by).agg(F.count("*").alias("rows"), n.alias("signals"), (safe_divide(F.count_if(on & (net > 0)), n) * 100.0).alias("win_rate"), F.when(lost > 0, F.least(won / lost, F.lit(999.0))).when(won > 0, 999.0).otherwise(0.0).alias("profit_factor"), safe_divide(n, F.count("*")).alias("signal_rate"), F.coalesce(F.avg(F.when(on, conf)), F.lit(0.0)).alias("mean_confidence"))


def classification(rows: DataFrame, truth: str, predicted: str) -> DataFrame:
    """One row: accuracy and support-weighted precision, recall and F1, times 100, two digits."""
    cells = rows.groupBy(F.col(truth).alias("t"), F.col(predicted).alias("p")).agg(F.count("*").alias("n"))
    classes = cells.select(F.col("t").alias("c")).distinct()
    per = classes.crossJoin(F.broadcast(cells)).groupBy("c").agg(*(F.coalesce(F.sum(F.when(x, F.col("n"))), F.lit(0)).alias(name) for name, x in (("tp", (F.col("t") == F.col("c")) & (F.col("p") == F.col("c"))), ("support", F.col("t") == F.col("c")), ("guessed", F.col("p") == F.col("c")))))  # a row per class
    pr, rc = safe_divide("tp", "guessed"), safe_divide("tp", "support")
    d = per.select("tp", "support", pr.alias("pr"), rc.alias("rc"), safe_divide(2 * pr * rc, pr + rc).alias("f1"))
    total = F.sum("support")
    pct = lambda x: F.round(safe_divide(x * 100.0, total), 2)
    return d.agg(pct(F.sum("tp")).alias("accuracy"), *(pct(F.sum(F.col(c) * F.col("support"))).alias(n) for c, n in (("pr", "precision"), ("rc", "recall"), ("f1", "f1"))))


def gate(rows: DataFrame, thresholds: dict[str, tuple[str, float]]) -> DataFrame:
    """passed, and failed: the names of the measures that miss their threshold (name -> ('>=' or '<=', value)); a measure
    that is null misses."""
    tests = [F.when(~F.coalesce(F.col(n) >= v if op == ">=" else F.col(n) <= v, F.lit(False)), n) for n, (op, v) in thresholds.items()]
    failed = F.array_compact(F.array(*tests))
    return rows.select("*", failed.alias("failed"), (F.size(failed) == 0).alias("passed"))


# Go-live thresholds.
BACKTEST_GATE = {"sharpe": (">=", 1.0), "win_rate": (">=", 52.0), "profit_factor": (">=", 1.3), "max_drawdown": ("<=", 20.0)}
MODEL_GATE = {"win_rate": (">=", 52.0), "profit_factor": (">=", 1.3), "signal_rate": (">=", 0.10)}
STATISTICS_GATE = {"dsr": (">=", 0.95), "pbo": ("<=", 0.30), "t_stat": (">=", 3.0), "signals": (">=", 300)}
#: Of models at 1h: the Sharpe ratio, win rate and profit factor out of sample, whether the trades are enough, the share of
#: profitable windows, the mean return as a multiple of the cost, and the statistics. Windows of 12 months and 4 months every
#: 2 months, with 48 bars between them.
VALIDATION_GATE_1H = {"sharpe": (">=", 0.9), "win_rate": (">=", 51.0), "profit_factor": (">=", 1.25), "enough": (">=", 1), "profitable_windows_pct": (">=", 55.0), "fee_multiple": (">=", 3.5), "dsr": (">=", 0.95), "pbo": ("<=", 0.30), "t_stat": (">=", 3.0)}
WINDOWS_1H = {"train_months": 12, "test_months": 4, "step_months": 2, "embargo_bars": 48}
WALK_FORWARD_GATE = {"profitable_pct": (">=", 60.0), "avg_sharpe": (">=", 0.0), "worst_sharpe": (">=", -1.0), "sum_return": (">=", 0.0)}


def walk_forward_summary(windows: DataFrame) -> DataFrame:
    """One row over windows (sharpe, total_return), with the gate."""
    one = windows.agg(F.count("*").alias("windows"), (safe_divide(F.count_if(F.col("total_return") > 0), F.count("*")) * 100.0).alias("profitable_pct"), F.coalesce(F.avg("sharpe"), F.lit(0.0)).alias("avg_sharpe"), F.coalesce(F.min("sharpe"), F.lit(0.0)).alias("worst_sharpe"), F.coalesce(F.sum("total_return"), F.lit(0.0)).alias("sum_return"))
    return gate(one, WALK_FORWARD_GATE)


def next_bar(signals: DataFrame, bars: DataFrame) -> DataFrame:
    """signals (symbol, created_at, ...) with entry_time and entry_price: the open of the first bar after created_at. Those
    without such a bar are left out."""
    ahead = bars.select("symbol", (-F.col("open_time")).alias("_ahead"), F.col("open").alias("entry_price"))
    d = asof(signals.withColumn("_at", -F.col("created_at") - 1), ahead.withColumn("entry_time", -F.col("_ahead")), "_at", "_ahead", ["entry_time", "entry_price"])
    return d.where("entry_price is not null").drop("_at")


def table_backtest(signals: DataFrame, bars: DataFrame, start: float = 10_000.0, risk: float = 0.1, stop: float = 0.02, target: float = 0.03, market: dict[str, float] | None = None, bar_ms: int = DAY_MS) -> DataFrame:
    """One trade per signal (id, symbol, direction, created_at) that ends: entered at the open of the next bar with `risk`
    of the starting equity, left at the first touch of stop or target (fractions of the entry price), net of the fees and
    slippage of both sides and of funding for the hours held. market: daily_volume, volatility and funding_rate."""
    entered = next_bar(signals.select("id", "symbol", "direction", "created_at"), bars)
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    price = F.col("entry_price")
    entered = entered.select("id", "symbol", "direction", "entry_price", (price * (1.0 - sign * stop)).alias("stop_loss"), (price * (1.0 + sign * target)).alias("take_profit"), F.col("entry_time").alias("created_at"))
    closed = first_touch(entered, bars, bar_ms)
    market = {"daily_volume": 30e9, "volatility": 0.6, "funding_rate": 0.0003} | (market or {})
    d = closed.withColumns({k: F.lit(float(v)) for k, v in market.items()} | {"notional": F.lit(start * risk), "hours_held": F.col("duration_minutes") / 60.0, "is_long": F.col("direction") == "long"})
    d = with_costs(d)
    gross = F.col("notional") * F.col("pnl_pct") / 100.0
    return d.select("id", "symbol", "direction", F.col("created_at").alias("entry_time"), "entry_price", "close_price", F.col("closed_at").alias("ts"), "result", gross.alias("gross_pnl"), "total_cost", (gross - F.col("total_cost")).alias("pnl"))


def trade_curve(trades: DataFrame, by: list[str], start: float = 10_000.0, first: DataFrame | None = None) -> DataFrame:
    """Equity (by, ts, equity) after each day's exits. first: (by, ts) of a row with the starting equity, before any exit."""
    days = trades.groupBy(*by, F.floor((F.col("ts") - 1) / DAY_MS).alias("_day")).agg(F.sum("pnl").alias("_pnl"), F.max("ts").alias("ts"))
    w = Window.partitionBy(*by).orderBy("_day").rowsBetween(Window.unboundedPreceding, 0)
    curve = days.select(*by, "ts", (F.lit(start) + F.sum("_pnl").over(w)).alias("equity"))
    return curve if first is None else curve.unionByName(first.select(*by, "ts", F.lit(start).alias("equity")))


def walk_forward_backtest(signals: DataFrame, bars: DataFrame, windows: DataFrame, start: float = 10_000.0, **kw) -> DataFrame:
    """Metrics of the table back-test of every test window (fold, test_from, test_to), all in one job: trades that are entered
    and left inside the window, from the starting equity. Windows without a trade are left out."""
    trades = cut(table_backtest(signals, bars, start, **kw), "trades")
    inside = trades.join(F.broadcast(windows.select("fold", "test_from", "test_to")), (F.col("entry_time") >= F.col("test_from")) & (F.col("ts") <= F.col("test_to")))  # a few windows
    first = inside.select("fold", F.col("test_from").alias("ts")).distinct()
    curve = cut(trade_curve(inside, ["fold"], start, first), "curves")
    return trade_metrics(inside, ["fold"]).join(equity_metrics(curve, ["fold"]), "fold")


def buy_and_hold(bars: DataFrame, start: float = 10_000.0) -> DataFrame:
    """Equity of holding each symbol from its first close on."""
    first = bars.groupBy("symbol").agg(F.min_by("close", "open_time").alias("_c0"))
    return bars.join(first, "symbol").select("symbol", F.col("open_time").alias("ts"), (safe_divide("close", "_c0") * start).alias("equity"))


def random_entries(bars: DataFrame, p: float = 0.05, hold: int = 5, seed: int = 7, slice_bars: int = 4096) -> DataFrame:
    """Bars where a seeded hash says enter (probability p), none within `hold` bars of an earlier entry of its symbol, with
    the return of holding. What an entry rules out depends on the entries before it alone, so bars are thinned slice by
    slice for each of the `hold` distances at which the last entry before a slice may stand, and the slices, a row for each,
    are put together afterwards."""
    d = on_slices(bars, lambda x, w: x.withColumn("_exit", F.lead("close", hold).over(w)), 0, hold)
    u = F.pmod(F.xxhash64("symbol", "open_time", F.lit(seed)), F.lit(1_000_000)) / 1_000_000.0
    near = d.where((u < p) & F.col("_exit").isNotNull())
    s = F.floor(F.col("bar_idx") / slice_bars)
    lists = near.groupBy("symbol", s.alias("s")).agg(F.array_sort(F.collect_list(F.struct("bar_idx", "open_time", "close", "_exit"))).alias("e"))
    # free: the first bar of the slice, counted from its start, that no entry before the slice rules out
    free = lists.select("symbol", "s", "e", F.explode(F.sequence(F.lit(0), F.lit(hold - 1))).alias("free"))
    greedy = F.expr(f"aggregate(e, slice(e, 1, 0), (kept, x) -> if(x.bar_idx - s * {slice_bars} >= free and (size(kept) = 0 or x.bar_idx - element_at(kept, -1).bar_idx >= {hold}), concat(kept, array(x)), kept))")
    thinned = cut(free.select("symbol", "s", "free", greedy.alias("k")), "thinned")
    last = F.get("k", F.size("k") - 1)["bar_idx"]
    left = F.when(F.size("k") > 0, F.greatest(last + hold - (F.col("s") + 1) * slice_bars, F.lit(0))).otherwise(F.lit(0))
    steps = thinned.groupBy("symbol", "s").agg(F.transform(F.array_sort(F.collect_list(F.struct("free", left.cast("int").alias("left")))), lambda x: x["left"]).alias("next"))
    runs = steps.groupBy("symbol").agg(F.array_sort(F.collect_list(F.struct("s", "next"))).alias("r"))
    chain = F.expr("aggregate(r, named_struct('at', cast(-2 as bigint), 'f', 0, 'o', array(named_struct('s', cast(-1 as bigint), 'free', 0))), (a, x) -> named_struct('at', x.s, 'f', element_at(x.next, if(x.s = a.at + 1, a.f, 0) + 1), 'o', concat(a.o, array(named_struct('s', x.s, 'free', if(x.s = a.at + 1, a.f, 0))))), a -> a.o)")
    chosen = runs.select("symbol", F.explode(chain).alias("c")).select("symbol", "c.s", "c.free")
    out = thinned.join(chosen, ["symbol", "s", "free"]).select("symbol", F.explode("k").alias("x"))
    return out.select("symbol", F.col("x.bar_idx").alias("bar_idx"), F.col("x.open_time").alias("open_time"), safe_divide(F.col("x._exit") - F.col("x.close"), F.col("x.close")).alias("ret"))


def backtest_averages(bars: DataFrame) -> DataFrame:
    """Per symbol the mean of the first open and the last close, and the bars."""
    return bars.groupBy("symbol").agg(((F.min_by("open", "open_time") + F.max_by("close", "open_time")) / 2.0).alias("avg_price"), F.count("*").alias("bars"))


def mean_funding(funding: DataFrame, start_ms: int, end_ms: int, fallback: float = 0.0001) -> DataFrame:
    """Mean size of the funding rate per symbol in a window; a constant where there is none."""
    inside = F.col("fundingTime").between(start_ms, end_ms)
    return funding.groupBy("symbol").agg(F.coalesce(F.avg(F.when(inside, F.abs("fundingRate"))), F.lit(fallback)).alias("avg_funding"))
