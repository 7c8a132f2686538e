"""Signal ledgers: closing by first touch, performance, equity, drawdown, per period and timeframe."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.lineage import cut
from tapeloom.functions.scalar import DAY_MS, at, safe_divide

CLOSED = ("win", "loss", "breakeven")
#: Days whose extremes stand together, for the search of first touches.
BLOCK_DAYS = 32


def with_timeframe(signals: DataFrame) -> DataFrame:
    return signals.withColumn("timeframe", F.coalesce("timeframe", F.lit("4h")))


def filter_signals(signals: DataFrame, timeframe: str | None = None, symbol_like: str | None = None, status: str | None = None) -> DataFrame:
    """By timeframe (a missing one counts as 4h), part of the symbol, and status: wins, losses, open, closed."""
    d = with_timeframe(signals)
    if timeframe and timeframe != "all":
        d = d.where(F.col("timeframe") == timeframe)
    if symbol_like:
        d = d.where(F.col("symbol").contains(symbol_like.upper()))
    want = {"wins": ["win"], "losses": ["loss"], "open": ["open"], "closed": list(CLOSED)}.get(status or "")
    return d.where(F.col("result").isin(*want)) if want else d


def page(rows: DataFrame, newest: str = "created_at", limit: int = 20, offset: int = 0) -> DataFrame:
    """Newest first, ids breaking ties."""
    return rows.orderBy(F.desc(newest), F.desc("id")).offset(offset).limit(limit)


def first_touch(signals: DataFrame, bars: DataFrame, bar_ms: int = DAY_MS, skip_recent: int = 0, now_ms: int | None = None) -> DataFrame:
    """Close open signals (id, symbol, direction, entry_price, stop_loss, take_profit, created_at) at the first bar from
    created_at on that touches stop or target, the stop first within a bar; with P&L, adverse and favourable excursion up
    to that bar, ratio of reward to risk and duration. Signals that nothing touches are left out, and so are those
    younger than skip_recent bars.

    Bars stand in a row per symbol and day, days in a row per symbol and block of BLOCK_DAYS, blocks in a row per symbol,
    each with its extremes. A signal meets five such rows at most: its own day, the rest of its own block, the later blocks,
    the days of the first of them that touches, and the bars of the first day that does. No join multiplies rows.
    """
    if now_ms is not None and skip_recent:
        signals = signals.where(F.col("created_at") <= now_ms - skip_recent * bar_ms)
    extremes = F.max("high").alias("high"), F.min("low").alias("low")
    listed = lambda t, name: F.array_sort(F.collect_list(F.struct(F.col(t).alias("t"), "high", "low"))).alias(name)
    day = F.floor(F.col("open_time") / DAY_MS)
    days = cut(bars.groupBy("symbol", day.alias("day")).agg(*extremes, listed("open_time", "bars")), "days")
    blocks = cut(days.groupBy("symbol", F.floor(F.col("day") / BLOCK_DAYS).alias("block")).agg(*extremes, listed("day", "days")), "blocks")
    symbols = blocks.groupBy("symbol").agg(listed("block", "blocks"))

    long = F.col("direction") == "long"
    stop = lambda x: F.when(long, x["low"] <= F.col("stop_loss")).otherwise(x["high"] >= F.col("stop_loss"))
    touch = lambda x: stop(x) | F.when(long, x["high"] >= F.col("take_profit")).otherwise(x["low"] <= F.col("take_profit"))

    def look(d: DataFrame, rows: str, after, name: str, whole: bool = False) -> DataFrame:
        """The first of rows from `after` on that touches, as name, and the extremes of those before it (or with it)."""
        d = d.withColumn("_seen", F.filter(rows, after))
        d = d.withColumn(name, F.get(F.filter("_seen", touch), F.lit(0)))
        until = F.filter("_seen", lambda x: F.col(name).isNull() | ((x["t"] <= F.col(f"{name}.t")) if whole else (x["t"] < F.col(f"{name}.t"))))
        high, low = F.array_max(F.transform(until, lambda x: x["high"])), F.array_min(F.transform(until, lambda x: x["low"]))
        return d.withColumn("_high", F.greatest("_high", high)).withColumn("_low", F.least("_low", low)).drop("_seen", rows)

    own = F.floor(F.col("created_at") / DAY_MS)
    nothing = F.lit(None).cast("double")
    d = signals.withColumns({"_high": nothing, "_low": nothing, "day": own, "block": F.floor(own / BLOCK_DAYS)})
    d = d.join(days.select("symbol", "day", "bars"), ["symbol", "day"], "left")
    d = look(d, "bars", lambda x: x["t"] >= F.col("created_at"), "_hit1", whole=True)
    d = d.join(blocks.select("symbol", "block", "days"), ["symbol", "block"], "left")
    d = d.withColumn("days", F.when(F.col("_hit1").isNull(), F.col("days")))
    d = look(d, "days", lambda x: x["t"] > F.col("day"), "_day2")
    d = d.join(symbols, "symbol", "left")
    d = d.withColumn("blocks", F.when(F.col("_hit1").isNull() & F.col("_day2").isNull(), F.col("blocks")))
    d = look(d, "blocks", lambda x: x["t"] > F.col("block"), "_block3").withColumn("block", F.col("_block3.t"))
    d = d.join(blocks.select("symbol", "block", "days"), ["symbol", "block"], "left")
    d = look(d, "days", lambda x: F.lit(True), "_day4").withColumn("day", F.coalesce("_day2.t", "_day4.t"))
    d = d.join(days.select("symbol", "day", "bars"), ["symbol", "day"], "left")
    d = look(d, "bars", lambda x: F.lit(True), "_hit5", whole=True).withColumn("_hit", F.coalesce("_hit1", "_hit5")).where("_hit is not null")

    won = ~stop(F.col("_hit"))
    price = F.when(won, F.col("take_profit")).otherwise(F.col("stop_loss"))
    entry = F.col("entry_price")
    move = F.when(long, price - entry).otherwise(entry - price)
    adverse = F.when(long, F.col("_low") - entry).otherwise(entry - F.col("_high"))
    favour = F.when(long, F.col("_high") - entry).otherwise(entry - F.col("_low"))
    pct = lambda x: safe_divide(x * 100.0, entry)
    return d.select(
        *signals.columns,
        F.when(won, "win").otherwise("loss").alias("result"),
        price.alias("close_price"),
        (F.col("_hit.t") + bar_ms).alias("closed_at"),
        pct(move).alias("pnl_pct"),
        pct(F.least(adverse, F.lit(0.0))).alias("mae_pct"),
        pct(F.greatest(favour, F.lit(0.0))).alias("mfe_pct"),
        safe_divide(F.abs(F.col("take_profit") - entry), F.abs(entry - F.col("stop_loss"))).alias("rr_ratio"),
        F.floor((F.col("_hit.t") + bar_ms - F.col("created_at")) / 60000).alias("duration_minutes"),
    )


def daily_equity(closed: DataFrame, by: list[str] | None = None, start: float = 100.0) -> DataFrame:
    """Per day of closing: trades, summed P&L in percent (a missing one is 0), the equity that compounds it, and how far, in
    percent (0 or less), that is from its running peak. Rows that never closed are left out. The sum is rounded to nine places,
    so that a day whose gains and losses cancel out is 0 in whatever order they were added."""
    by = by or []
    pnl = F.coalesce("pnl_pct", F.lit(0.0))
    days = closed.where(F.col("result").isin(*CLOSED) & F.col("closed_at").isNotNull()).groupBy(*by, F.to_date(at("closed_at")).alias("date")).agg(F.round(F.sum(pnl), 9).alias("pnl_pct"), F.count("*").alias("trades"))
    w = Window.partitionBy(*by).orderBy("date").rowsBetween(Window.unboundedPreceding, 0)
    d = days.withColumn("equity", F.lit(start) * F.product(1.0 + F.col("pnl_pct") / 100.0).over(w))
    peak = F.greatest(F.max("equity").over(w), F.lit(start))
    return d.select(*by, "date", "trades", "pnl_pct", "equity", ((F.col("equity") - peak) / peak * 100.0).alias("drawdown_pct"))


def _stats():
    """Closed, won and lost rows, and what was gained and lost by them."""
    n = F.count_if(F.col("result").isin(*CLOSED))
    of = lambda kind: F.coalesce(F.sum(F.when(F.col("result") == kind, F.col("pnl_pct"))), F.lit(0.0))
    return n, F.count_if(F.col("result") == "win"), F.count_if(F.col("result") == "loss"), of("win"), -of("loss")


def _profit_factor(gain, cost):
    """Gain over loss; without losses unknown, or 0 if there is no gain either."""
    return F.when(cost != 0, gain / F.abs(cost)).when(gain > 0, F.lit(None)).otherwise(F.lit(0.0))


#: Closed signals from which on ratios are given.
MIN_RATIO_SAMPLE = 10


def performance(signals: DataFrame, as_of_ms: int, days: int | None = None, by: list[str] | None = None, start: float = 100.0) -> DataFrame:
    """Of the signals created up to as_of_ms (of the last `days`): counts, wins among the decided, profit factor (null
    without losses, 0 without gains too), mean P&L, mean ratio, hours and confidence. From the P&L summed per day of closing:
    the total that it compounds to, the worst drawdown (0 or less), and, from ten closed signals on, the Sharpe ratio
    (365 days; 0 for fewer than two days or no deviation), the Sortino ratio (by the sample deviation of losing days; the
    Sharpe ratio if there is none) and the Calmar ratio (0 without a drawdown)."""
    by = by or []
    d = with_timeframe(signals).where(F.col("created_at") <= as_of_ms)
    if days:
        d = d.where(F.col("created_at") >= as_of_ms - days * DAY_MS)
    n, win, loss, gain, cost = _stats()
    closed = F.col("result").isin(*CLOSED)
    mean = lambda c: F.coalesce(F.avg(c), F.lit(0.0))
    base = d.groupBy(*by).agg(
        F.count("*").alias("total"), n.alias("closed"), win.alias("wins"), loss.alias("losses"), F.count_if(F.col("result") == "rejected").alias("rejected"), F.count_if(F.col("result") == "open").alias("open"),
        safe_divide(win, win + loss).alias("win_rate"), _profit_factor(gain, cost).alias("profit_factor"), mean(F.when(closed, F.coalesce("pnl_pct", F.lit(0.0)))).alias("expected_value"),
        mean(F.when(closed, F.col("rr_ratio"))).alias("avg_rr"), (mean(F.when(closed, F.col("duration_minutes"))) / 60.0).alias("avg_hours"), mean("confidence").alias("avg_confidence"), F.min("created_at").alias("live_since"),
        F.greatest(F.lit(1), F.floor((F.lit(as_of_ms) - F.floor(F.min("created_at") / DAY_MS) * DAY_MS) / DAY_MS)).alias("days_tracked"),
    )
    daily = daily_equity(d, by, start).withColumn("r", F.col("pnl_pct") / 100.0)
    down = F.when(F.col("r") < 0, F.col("r"))
    risk = daily.groupBy(*by).agg(F.min("drawdown_pct").alias("max_drawdown"), F.max_by("equity", "date").alias("_e"), F.avg("r").alias("_m"), F.stddev_samp("r").alias("_s"), F.stddev_samp(down).alias("_t"))
    both = base.join(risk, by, "left") if by else base.crossJoin(risk)  # one row each
    year, enough = F.lit(365.0), F.col("closed") >= MIN_RATIO_SAMPLE
    sharpe = F.when(F.col("_s") > 0, F.col("_m") / F.col("_s") * F.sqrt(year)).otherwise(0.0)
    sortino = F.when(F.col("_t") > 0, F.col("_m") / F.col("_t") * F.sqrt(year)).otherwise(sharpe)
    calmar = F.when(F.col("max_drawdown") != 0, F.col("_m") * year * 100.0 / F.abs("max_drawdown")).otherwise(0.0)
    return both.select(*base.columns, F.coalesce((F.col("_e") / start - 1.0) * 100.0, F.lit(0.0)).alias("total_pnl_pct"), F.coalesce("max_drawdown", F.lit(0.0)).alias("max_drawdown"), *(F.when(enough, x).alias(name) for name, x in (("sharpe", sharpe), ("sortino", sortino), ("calmar", calmar))))


def cube(signals: DataFrame, as_of_ms: int, timeframes=("all", "4h", "15m", "1h"), periods=(7, 30, 90)) -> DataFrame:
    """Performance of every timeframe and period in one pass: each signal counts in all cells it belongs to."""
    age = F.lit(as_of_ms) - F.col("created_at")
    d = with_timeframe(signals).where(age >= 0)
    frames = F.array(F.lit("all"), F.col("timeframe"))
    spans = F.filter(F.array(*(F.lit(p) for p in periods)), lambda p: age <= p.cast("long") * DAY_MS)
    d = d.withColumn("tf", F.explode(frames)).withColumn("period_days", F.explode(spans)).where(F.col("tf").isin(*timeframes))
    return performance(d, as_of_ms, by=["tf", "period_days"])


def monthly(closed: DataFrame) -> DataFrame:
    """Per month of closing: trades, wins, losses, summed P&L, and wins among the decided (0 if none is). Rows that never
    closed are left out."""
    d = closed.where(F.col("result").isin(*CLOSED) & F.col("closed_at").isNotNull())
    n, win, loss, gain, cost = _stats()
    return d.groupBy(F.date_format(at("closed_at"), "yyyy-MM").alias("month")).agg(F.count("*").alias("trades"), win.alias("wins"), loss.alias("losses"), F.sum(F.coalesce("pnl_pct", F.lit(0.0))).alias("pnl_pct"), safe_divide(win, win + loss).alias("win_rate"))


def daily_stats(signals: DataFrame) -> DataFrame:
    """Per day of closing and timeframe: trades, wins, P&L, and the equity of that timeframe alone, by date."""
    d = with_timeframe(signals)
    wins = d.where(F.col("result").isin(*CLOSED)).groupBy("timeframe", F.to_date(at("closed_at")).alias("date")).agg(F.count_if(F.col("result") == "win").alias("wins"))
    return daily_equity(d, ["timeframe"]).join(wins, ["timeframe", "date"])


def ledger_stats(signals: DataFrame, by: list[str] | None = None, as_of_ms: int | None = None, days: int = 30) -> DataFrame:
    """Trading statistics of a ledger, of the signals of the last `days` before as_of_ms (None: of all): signals, open and
    other ones (closed), wins, losses, wins among the decided (0 if none is), sum, mean, best and worst of P&L that isn't open
    (0 without any), gains, losses (a number below 0), their ratio (null, for infinity, with gains alone, and 0 without
    either) and the mean confidence."""
    d = signals if as_of_ms is None else signals.where((F.col("created_at") >= as_of_ms - days * DAY_MS) & (F.col("created_at") <= as_of_ms))
    n, open_ = F.count("*"), F.count_if(F.col("result") == "open")
    win, loss = F.count_if(F.col("result") == "win"), F.count_if(F.col("result") == "loss")
    zero = lambda x: F.coalesce(x, F.lit(0.0))
    of = lambda kind: zero(F.sum(F.when(F.col("result") == kind, F.col("pnl_pct"))))
    done = F.when(F.col("result") != "open", F.col("pnl_pct"))
    return d.groupBy(*(by or [])).agg(
        n.alias("total"), open_.alias("open"), (n - open_).alias("closed"), win.alias("wins"), loss.alias("losses"), safe_divide(win, win + loss).alias("win_rate"),
        zero(F.sum(done)).alias("total_pnl"), zero(F.avg(done)).alias("avg_pnl"), zero(F.max(done)).alias("best"), zero(F.min(done)).alias("worst"),
        of("win").alias("gross_win"), of("loss").alias("gross_loss"), _profit_factor(of("win"), of("loss")).alias("profit_factor"), zero(F.avg("confidence")).alias("avg_confidence"),
    )


def merge_stats(parts: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Exact totals of several ledger_stats: counts and sums added, ratios made anew. The mean P&L is by closed signals, the
    mean confidence by decided ones; best is 0 at least and worst 0 at most."""
    s = lambda c: F.sum(c)
    decided = F.col("wins") + F.col("losses")
    return parts.groupBy(*(by or [])).agg(
        *(s(c).alias(c) for c in ("total", "open", "closed", "wins", "losses")), safe_divide(s("wins"), s(decided)).alias("win_rate"), s("total_pnl").alias("total_pnl"), safe_divide(s("total_pnl"), s("closed")).alias("avg_pnl"),
        F.greatest(F.max("best"), F.lit(0.0)).alias("best"), F.least(F.min("worst"), F.lit(0.0)).alias("worst"), s("gross_win").alias("gross_win"), s("gross_loss").alias("gross_loss"),
        _profit_factor(s("gross_win"), s("gross_loss")).alias("profit_factor"), safe_divide(s(F.col("avg_confidence") * decided), s(decided)).alias("avg_confidence"),
    )


def all_time_stats(signals: DataFrame, as_of_ms: int, by: list[str] | None = None) -> DataFrame:
    """Signals, decided ones, wins, losses and open ones, wins among the decided of all time and of those created since the
    day 30 days before as_of_ms (0 if none is), and the summed P&L of the decided."""
    since = F.floor(F.lit(as_of_ms) / DAY_MS) * DAY_MS - 30 * DAY_MS
    won, decided = F.col("result") == "win", F.col("result").isin("win", "loss")
    late = F.col("created_at") >= since
    return signals.groupBy(*(by or [])).agg(
        F.count("*").alias("total"), F.count_if(decided).alias("closed"), F.count_if(won).alias("wins"), F.count_if(F.col("result") == "loss").alias("losses"), F.count_if(F.col("result") == "open").alias("open"),
        safe_divide(F.count_if(won), F.count_if(decided)).alias("win_rate"), safe_divide(F.count_if(won & late), F.count_if(decided & late)).alias("win_rate_30d"), F.coalesce(F.sum(F.when(decided, F.col("pnl_pct"))), F.lit(0.0)).alias("total_pnl"),
    )


def revenue(payments: DataFrame, users: DataFrame, month: str) -> DataFrame:
    """One row: paid totals of all time and of a month ('yyyy-MM'), by method, counts, active premium users."""
    paid = F.col("status") == "paid"
    amount = lambda c: F.coalesce(F.sum(F.when(c, F.col("amount_usd"))), F.lit(0.0))
    p = payments.agg(amount(paid).alias("total_usd"), amount(paid & (F.date_format(at("created_at"), "yyyy-MM") == month)).alias("month_usd"), amount(paid & (F.col("method") == "stars")).alias("stars_usd"), amount(paid & (F.col("method") == "usdt")).alias("usdt_usd"), F.count_if(paid).alias("paid_count"), F.count_if(~paid).alias("pending_count"))
    u = users.agg(F.count_if((F.col("role") == "premium") & ~F.col("banned")).alias("active_premium"), F.count("*").alias("users"))
    return p.crossJoin(u)  # one row each


def snapshot(signals: DataFrame) -> DataFrame:
    """One row: open signals, and the newest signal of all."""
    last = F.max_by(F.struct("id", "symbol", "direction", "created_at"), F.struct("created_at", "id"))
    return signals.agg(F.count_if(F.col("result") == "open").alias("open_signals"), F.count("*").alias("signals"), last.alias("s")).select("open_signals", "signals", F.col("s.id").alias("last_id"), F.col("s.symbol").alias("last_symbol"), F.col("s.direction").alias("last_direction"), F.col("s.created_at").alias("last_created_at"))


def live(signals: DataFrame, metrics: DataFrame) -> DataFrame:
    """One row: the newest snapshot of metrics (equity, daily_pnl, regime, open_positions, updated_at; nulls if there is
    none), the open signals, and the newest signal of all sources."""
    m = metrics.agg(F.max_by(F.struct("equity", "daily_pnl", "regime", "open_positions", "updated_at"), F.col("updated_at")).alias("m"))
    return snapshot(signals).crossJoin(m.select("m.*"))  # one row each


def position_diff(own: DataFrame, exchange: DataFrame, tiny: float = 1e-10, same: float = 1e-8) -> DataFrame:
    """Own against exchange positions (symbol, qty; the sign is the direction): orphan (only there), ghost (only here),
    mismatch (direction, or size by `same` or more), ok. Exchange rows of size `tiny` or less are none."""
    e = exchange.where(F.abs("qty") > tiny).select("symbol", F.col("qty").alias("exchange_qty"))
    d = own.select("symbol", F.col("qty").alias("own_qty")).join(e, "symbol", "full_outer")
    a, b = F.col("own_qty"), F.col("exchange_qty")
    kind = F.when(a.isNull(), "orphan").when(b.isNull(), "ghost").when((F.signum(a) != F.signum(b)) | (F.abs(a - b) >= same), "mismatch").otherwise("ok")
    return d.withColumn("kind", kind)


def union_ledgers(**sources: DataFrame) -> DataFrame:
    """Ledgers with a column that names the source; columns that one lacks are null."""
    out = None
    for name, d in sources.items():
        d = d.withColumn("source", F.lit(name))
        out = d if out is None else out.unionByName(d, allowMissingColumns=True)
    return out


def latest(changes: DataFrame, key: list[str], version: str) -> DataFrame:
    """The row of the highest version of each key: an upsert ledger as appended changes and this view."""
    rest = [c for c in changes.columns if c not in key]
    return changes.groupBy(*key).agg(F.max_by(F.struct(*rest), F.col(version)).alias("_r")).select(*key, "_r.*")


def users_by_role(users: DataFrame, role: str | None = None) -> DataFrame:
    """Users of a role, or of any, that are not banned (an unknown flag is no ban), by id."""
    d = users.where(~F.coalesce("banned", F.lit(False)))
    return (d.where(F.col("role") == role) if role else d).orderBy("user_id")


def pending_payments(payments: DataFrame, method: str | None = None) -> DataFrame:
    """Payments that wait, of one method or of any, the newest first."""
    d = payments.where(F.col("status") == "pending")
    return (d.where(F.col("method") == method) if method else d).orderBy(F.desc("created_at"), F.desc("payment_id"))


def newest_events(events: DataFrame, event_type: str | None = None, limit: int = 50) -> DataFrame:
    """Events of one type or of any, the newest first."""
    d = events.where(F.col("event_type") == event_type) if event_type else events
    return d.orderBy(F.desc("created_at"), F.desc("id")).limit(limit)


def open_page(signals: DataFrame, timeframe: str | None = None, limit: int = 50, offset: int = 0) -> DataFrame:
    """A page of the open signals, of one timeframe or of all, the newest first."""
    return page(filter_signals(signals, timeframe, status="open"), limit=limit, offset=offset)


def created_per_day(signals: DataFrame) -> DataFrame:
    """How many signals were created on each date."""
    return signals.groupBy(F.to_date(at("created_at")).alias("date")).agg(F.count("*").alias("signals"))


def newest_of_all(sources: dict[str, DataFrame], limit: int = 20, offset: int = 0) -> DataFrame:
    """A page of the newest signals over all ledgers."""
    return page(union_ledgers(**sources), limit=limit, offset=offset)


def best_runs(runs: DataFrame, metric: str, top: int = 5, key: str = "run_id") -> DataFrame:
    """The runs with the largest metric, ties by id; a missing metric comes last."""
    return runs.orderBy(F.desc_nulls_last(metric), key).limit(top)
