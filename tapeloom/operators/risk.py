"""Costs, sizing, pre-trade filters, circuit breaker, portfolio accounts, fills."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.scalar import col, safe_divide


@dataclass(frozen=True)
class Fees:
    maker: float = 0.0002
    taker: float = 0.0005
    discount: float = 0.1

    def rate(self, is_maker) -> Column:
        return F.when(is_maker, self.maker * (1 - self.discount)).otherwise(self.taker * (1 - self.discount))


def slippage(notional, daily_volume, sigma) -> Column:
    """One way, by the square root of the share of the day's volume; 0 without volume."""
    q, v = col(notional), col(daily_volume)
    return F.when(v > 0, q * 0.5 * col(sigma) * F.sqrt(safe_divide(q, v))).otherwise(0.0)


def with_costs(rows: DataFrame, fees: Fees = Fees(), notional="notional", daily_volume="daily_volume", sigma="volatility", funding_rate="funding_rate", hours="hours_held", is_long="is_long", is_maker=None) -> DataFrame:
    """Fees of both sides, slippage of both, funding paid (by longs while positive), total, in bps, and three times that."""
    maker = F.lit(False) if is_maker is None else F.col(is_maker)
    fee = F.col(notional) * fees.rate(maker)
    slip = slippage(notional, daily_volume, sigma)
    paid = F.col(notional) * F.col(funding_rate) * F.col(hours) / 8.0 * F.when(F.col(is_long), 1.0).otherwise(-1.0)
    total = fee * 2 + slip * 2 + paid
    bps = F.when(F.col(notional) > 0, safe_divide(total, F.col(notional)) * 10_000.0).otherwise(0.0)
    return rows.select("*", fee.alias("entry_fee"), fee.alias("exit_fee"), slip.alias("entry_slippage"), slip.alias("exit_slippage"), paid.alias("funding_cost"), total.alias("total_cost"), bps.alias("total_cost_bps"), (bps * 3.0).alias("min_required_return_bps"))


def cost_table(rows: DataFrame, sizes: list[float], **kw) -> DataFrame:
    """Costs of every row's market (daily_volume, volatility, funding_rate, hours_held, is_long) at every size, as maker
    and as taker."""
    cells = rows.sparkSession.createDataFrame([(float(s), m) for s in sizes for m in (True, False)], "notional double, is_maker boolean")
    return with_costs(rows.crossJoin(F.broadcast(cells)), is_maker="is_maker", **kw)  # a few cells


def sized(rows: DataFrame, equity="equity", risk: float = 0.01, stop_atrs: float = 1.5, max_leverage: float = 10.0, reward: float = 1.5) -> DataFrame:
    """Position by the true range: contracts, notional and leverage (held at the largest), stop and target prices."""
    stop = F.col("atr") * stop_atrs
    eq, entry = col(equity), F.col("entry_price")
    want = F.when(stop > 0, safe_divide(eq * risk, stop) * entry).otherwise(0.0)
    most = eq * max_leverage
    notional = F.least(want, most)
    sign = F.when(F.col("direction") == "long", 1.0).otherwise(-1.0)
    return rows.select("*", safe_divide(notional, entry).alias("contracts"), notional.alias("notional"), F.when(want > most, F.lit(float(max_leverage))).otherwise(safe_divide(want, eq)).alias("leverage"), (entry - sign * stop).alias("stop_loss"), (entry + sign * stop * reward).alias("take_profit"))


@dataclass(frozen=True)
class Limits:
    max_drawdown_pct: float = 15.0
    weekly: float = -0.08
    daily: float = -0.03
    losses: int = 5
    pause_hours: float = 4.0
    positions: int = 3
    confidence: float = 0.55
    funding: float = 0.001
    atr_pct: float = 0.02
    min_return_bps: float = 15.0


def gated(rows: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """reason (null if none) and approved: the first of the filters that fails, in order; without a
    notional no return covers the costs. An unknown funding rate blocks;
    after a streak of losses a signal is blocked until the pause since the last loss is over, and for good if its time is
    unknown."""
    c = F.col
    since = (c("created_at") - c("last_loss_at")) / 3_600_000
    checks = [
        ("max_drawdown", c("drawdown_pct") > limits.max_drawdown_pct),
        ("weekly_loss", c("weekly_pnl_pct") <= limits.weekly),
        ("daily_loss", c("daily_pnl_pct") <= limits.daily),
        ("consecutive_losses", (c("consecutive_losses") >= limits.losses) & F.coalesce(since < limits.pause_hours, F.lit(True))),
        ("max_positions", c("open_positions") >= limits.positions),
        ("confidence", c("confidence") < limits.confidence),
        ("funding_rate", c("funding_rate").isNull() | (F.abs("funding_rate") > limits.funding)),
        ("volatility", c("atr_pct") > limits.atr_pct),
        ("zero_notional", F.coalesce(c("notional") <= 0, F.lit(True))),
        ("expected_return", c("atr_pct") * 10_000.0 < F.greatest(F.lit(limits.min_return_bps), F.coalesce(c("total_cost_bps") * 3.0, F.lit(0.0)))),
    ]
    reason = F.coalesce(*(F.when(test, name) for name, test in checks))
    return rows.select("*", reason.alias("reason"), reason.isNull().alias("approved"))


def breaker(rows: DataFrame) -> DataFrame:
    """State of the circuit breaker, the gravest first, and the share of a position that it allows."""
    c = F.col
    spike = (c("avg_atr") > 0) & (c("atr") / F.nullif(c("avg_atr"), F.lit(0.0)) > 2.0)
    state = F.coalesce(F.when(c("drawdown") <= -0.15, "kill"), F.when(c("weekly_pnl_pct") <= -0.08, "weekly_loss"), F.when(c("daily_pnl_pct") <= -0.03, "daily_loss"), F.when(c("consecutive_losses") >= 5, "loss_streak"), F.when(spike, "volatility"), F.when(F.abs("funding_rate") > 0.001, "funding"), F.lit("ok"))
    stop = (c("daily_pnl_pct") <= -0.03) | (c("weekly_pnl_pct") <= -0.08) | (c("drawdown") <= -0.15) | (c("consecutive_losses") >= 5)
    half = (c("daily_pnl_pct") <= -0.02) | F.coalesce(spike, F.lit(False))
    return rows.select("*", state.alias("breaker"), F.when(stop, 0.0).when(half, 0.5).otherwise(1.0).alias("size_multiplier"), (c("drawdown") <= -0.10).alias("drawdown_warning"))


def rebased(snapshots: DataFrame, unrealised: DataFrame) -> DataFrame:
    """Cash at each balance snapshot (account, ts, equity): the equity less the unrealised P&L as of then."""
    from tapeloom.operators.series import asof

    u = unrealised.groupBy("account", "ts").agg(F.sum("unrealised").alias("unrealised")).withColumnRenamed("ts", "_uts")
    d = asof(snapshots, u, "ts", "_uts", ["unrealised"], key="account")
    return d.select("*", (F.col("equity") - F.coalesce("unrealised", F.lit(0.0))).alias("cash"))


def round_trips(fills: DataFrame, slip_bps: float = 2.0) -> DataFrame:
    """Entry and exit fills of one order id joined: prices after slippage, fees and net P&L."""
    e = fills.where("opens").select("order_id", "symbol", "side", "qty", F.col("price").alias("p0"), F.col("fee").alias("f0"), F.col("ts").alias("opened_at"))
    x = fills.where("not opens").select("order_id", F.col("price").alias("p1"), F.col("fee").alias("f1"), F.col("ts").alias("closed_at"))
    k = slip_bps / 10_000.0
    entry, exit_ = F.col("p0") * (1 + F.col("side") * k), F.col("p1") * (1 - F.col("side") * k)
    return e.join(x, "order_id").select("order_id", "symbol", "side", "qty", "opened_at", "closed_at", entry.alias("entry"), exit_.alias("exit"), (F.col("f0") + F.col("f1")).alias("fees"), ((exit_ - entry) * F.col("side") * F.col("qty") - F.col("f0") - F.col("f1")).alias("pnl"))


def paper_stats(trips: DataFrame, fills: DataFrame, initial: float = 10_000.0) -> DataFrame:
    """One row over round trips and the fills they are made of: equity, summed P&L and its share of the initial equity, trades,
    won and lost ones (a trade that gains nothing is lost), the share of the won, and positions that are still open. Entry
    fees of open positions are paid."""
    done = trips.agg(F.count("*").alias("total_trades"), F.count_if(F.col("pnl") > 0).alias("winning_trades"), F.coalesce(F.sum("pnl"), F.lit(0.0)).alias("total_pnl"))
    left = fills.where("opens").join(trips.select("order_id"), "order_id", "left_anti").agg(F.count_distinct("symbol").alias("open_positions"), F.coalesce(F.sum("fee"), F.lit(0.0)).alias("_fees"))
    n, won, pnl = F.col("total_trades"), F.col("winning_trades"), F.col("total_pnl")
    return done.crossJoin(left).select((F.lit(float(initial)) + pnl - F.col("_fees")).alias("equity"), F.lit(float(initial)).alias("initial_equity"), pnl, (pnl / F.lit(float(initial))).alias("total_pnl_pct"), n, won, (n - won).alias("losing_trades"), safe_divide(won, n).alias("win_rate"), "open_positions")  # one row each


def route(rows: DataFrame, range_threshold: float = 0.60, threshold: float = 0.55) -> DataFrame:
    """Which model a regime uses and the confidence it asks for; a range asks for more."""
    model = F.when(F.col("regime").isin("trend_up", "trend_down"), "trend").when(F.col("regime") == "high_vol", "high_vol").otherwise("trend")
    least = F.when(F.col("regime") == "range", range_threshold).otherwise(threshold)
    return rows.select("*", model.alias("model"), least.alias("min_confidence"), (F.col("confidence") >= least).alias("routed"))


def decide_15m(rows: DataFrame) -> DataFrame:
    """decision: trap, no_breakout (none or both), no_trend, against_breakout, or take."""
    bull, bear = F.col("orb_breakout_bull"), F.col("orb_breakout_bear")
    way = F.when(bull, 1).otherwise(-1)
    out = F.when(F.col("is_session_trap_zone"), "trap").when(bull == bear, "no_breakout").when(~F.col("regime").isin("trend_up", "trend_down"), "no_trend").when(F.col("direction") != way, "against_breakout").otherwise("take")
    return rows.withColumn("decision", out)
