"""Queries of labels, splits, signal ledgers, audits, risk and validation, each with its SQL where SQL can say it."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.lineage import scratch
from tapeloom.functions.scalar import DAY_MS, HOUR_MS, normal_symbol, rounded
from tapeloom.operators import accounts, audit, backtest, episodes, jobs, labels, ledger, models, risk, validation
from tapeloom.operators.series import index_bars
from tapeloom.plans import tapes as T
from tapeloom.plans.features import regime_ctes
from tapeloom.plans.tapes import DAILY, FUNDING, METRICS, PAYMENTS, SIGNALS, TRADES, USERS, bars_sql, div, out, with_
from tapeloom.sources import ledgers as source_ledgers
from tapeloom.sources import versions

W = "window w as (partition by symbol order by open_time)"
AS_OF = 904_608_000_000  # 1998-09-01
CLOSED = "('win', 'loss', 'breakeven')"


def fixed_horizon(spark, d):
    return rounded(labels.fixed_horizon(T.daily(spark, d), 6).select("symbol", "open_time", "future_return", "target"))


FIXED_SQL = with_(DAILY, f"a as (select *, lead(close, 6) over w as f from bars {W})") + " select symbol, open_time, " + out(f"{div('f - close', 'close')} as future_return") + ", case when f > close then 1 else -1 end as target from a where f is not null"


def _barrier(spark, d):
    bars = T.daily(spark, d).withColumn("atr_pct", F.lit(0.01))
    return labels.triple_barrier(bars, 1.5, 1.0, 8)


def triple_barrier(spark, d):
    return rounded(_barrier(spark, d).select("symbol", "open_time", "label", "future_return", "t1_bar"))


_HITS = ", ".join(f"case when lead(close, {k}) over w >= close * (1 + 1.5 * 0.01) then {k} when lead(close, {k}) over w <= close * (1 - 1.0 * 0.01) then -{k} end" for k in range(1, 9))
_BARRIER = f"""tb0 as (select *, row_number() over w - 1 as k, coalesce({_HITS}) as hit, lead(close, 8) over w as f8, list(close) over (partition by symbol order by open_time rows between 1 following and 8 following) as ahead from bars {W}),
tb as (select symbol, open_time, k, close, coalesce(sign(hit), 0)::int as label, ahead[coalesce(abs(hit), 8)] / close - 1 as future_return, k + coalesce(abs(hit), 8) as t1 from tb0 where f8 is not null)"""
BARRIER_SQL = with_(DAILY, _BARRIER) + " select symbol, open_time, label, " + out("future_return as future_return") + ", t1 as t1_bar from tb"


def triple_barrier_hl(spark, d):
    """Barriers touched by highs and lows."""
    bars = T.daily(spark, d).withColumn("atr_pct", F.lit(0.02))
    return rounded(labels.triple_barrier(bars, 2.0, 1.5, 5, touch="hl").select("symbol", "open_time", "label", "future_return", "t1_bar"))


_HL = ", ".join(f"case when lead(high, {k}) over w >= close * (1 + 2.0 * 0.02) then {k} when lead(low, {k}) over w <= close * (1 - 1.5 * 0.02) then -{k} end" for k in range(1, 6))
BARRIER_HL_SQL = with_(DAILY, f"t0 as (select *, row_number() over w - 1 as k, coalesce({_HL}) as hit, lead(close, 5) over w as f, list(close) over (partition by symbol order by open_time rows between 1 following and 5 following) as ahead from bars {W})") + " select symbol, open_time, coalesce(sign(hit), 0)::int as label, " + out("ahead[coalesce(abs(hit), 5)] / close - 1 as future_return") + ", k + coalesce(abs(hit), 5) as t1_bar from t0 where f is not null"


def label_statistics(spark, d):
    return labels.label_statistics(_barrier(spark, d), ["symbol"])


LABEL_STATS_SQL = with_(DAILY, _BARRIER) + """ select symbol, count(*) as total, count(*) filter (label = 1) as long_n, count(*) filter (label = -1) as short_n, count(*) filter (label = 0) as vertical_n,
 round(100.0 * count(*) filter (label = 1) / count(*), 4) as long_pct, round(100.0 * count(*) filter (label = -1) / count(*), 4) as short_pct, round(100.0 * count(*) filter (label = 0) / count(*), 4) as vertical_pct, round(100.0 * count(*) filter (label <> 0) / count(*), 4) as coverage from tb group by symbol"""


def uniqueness_weights(spark, d):
    rows = labels.target_rows(_barrier(spark, d))
    return rounded(labels.uniqueness_weights(rows).select("symbol", "open_time", "weight"))


_WEIGHTS = (
    DAILY,
    _BARRIER,
    "s as (select * from tb where label <> 0)",
    "l as (select symbol, open_time, unnest(range(k, t1 + 1)) as t from s)",
    "c as (select symbol, t, count(*) as c from l group by 1, 2)",
    "u as (select symbol, open_time, avg(1.0 / c) as u from l join c using (symbol, t) group by 1, 2)",
)
WEIGHTS_SQL = with_(*_WEIGHTS) + " select symbol, open_time, round(u / avg(u) over (partition by symbol), 6) + 0.0 as weight from u"


def weight_summary(spark, d):
    return rounded(labels.weight_summary(labels.uniqueness_weights(labels.target_rows(_barrier(spark, d))), ["symbol"]))


WEIGHT_SUMMARY_SQL = with_(*_WEIGHTS, "ws as (select symbol, u / avg(u) over (partition by symbol) as w from u)") + " select symbol, count(*) as rows, " + out("min(w) as min_weight", "max(w) as max_weight", "avg(w) as mean_weight") + " from ws group by 1"

CUT = 852_076_800_000  # 1997-01-01


def temporal_split(spark, d):
    return labels.temporal_split(T.daily(spark, d), CUT, 24).groupBy("symbol", "role").agg(F.count("*").alias("n"), F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time"))


SPLIT_SQL = with_(DAILY, f"a as (select *, open_time < {CUT} as tr, row_number() over (partition by symbol, open_time < {CUT} order by open_time desc) as back from bars)") + " select symbol, case when tr then 'train' else 'test' end as role, count(*) as n, min(open_time) as first_time, max(open_time) as last_time from a where not tr or back > 24 group by 1, 2"


def default_cut(spark, d):
    return labels.default_cut(T.daily(spark, d), 0.2)


CUT_SQL = with_(DAILY) + " select min(open_time) + cast(floor((max(open_time) - min(open_time)) * (1.0 - 0.2)) as bigint) as cut from bars"

T0, T1 = 788_918_400_000, 1_004_572_800_000  # 1995-01-01 to 2001-11-01


def purged_folds(spark, d):
    folds = labels.fold_table(spark, T0, T1, 5, 0.01)
    return labels.assign_folds(T.daily(spark, d), folds).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time"))


_BLOCK, _GAP = (T1 - T0) / 6, (T1 - T0) * 0.01
FOLDS_SQL = with_(DAILY, "f(fold, train_to, test_from, test_to) as (values " + ", ".join(f"({k}, {int(T0 + k * _BLOCK - _GAP)}, {int(T0 + k * _BLOCK)}, {int(T0 + (k + 1) * _BLOCK)})" for k in range(1, 6)) + ")") + f" select fold, case when open_time >= test_from then 'test' else 'train' end as role, count(*) as n, min(open_time) as first_time, max(open_time) as last_time from bars join f on (open_time >= {T0} and open_time < train_to) or (open_time >= test_from and open_time < test_to) group by 1, 2"


def walk_forward(spark, d):
    windows = labels.walk_forward_windows(spark, 791_424_000_000, T1, 12, 3, 2)  # from Jan 30
    return labels.assign_folds(T.daily(spark, d), windows).groupBy("fold", "role").agg(F.count("*").alias("n"), F.min("open_time").alias("first_time"), F.max("open_time").alias("last_time"))


WALK_SQL = with_(
    DAILY,
    "r(fold, a) as (select 1, make_timestamp(791424000000 * 1000) union all select fold + 1, a + interval 3 month from r where a + interval 3 month + interval 12 month + interval 3 month <= make_timestamp(1004572800000 * 1000))",
    "f as (select fold, epoch_ms(a) as train_from, epoch_ms(a + interval 12 month) - 172800000 as train_to, epoch_ms(a + interval 12 month) as test_from, epoch_ms(a + interval 12 month + interval 3 month) as test_to from r)",
    recursive=True,
) + " select fold, case when open_time >= test_from then 'test' else 'train' end as role, count(*) as n, min(open_time) as first_time, max(open_time) as last_time from bars join f on (open_time >= train_from and open_time < train_to) or (open_time >= test_from and open_time < test_to) group by 1, 2"

GRID = [(1.0, 1.0, 4), (1.5, 1.0, 8)]


def grid_balance(spark, d):
    return labels.grid_balance(T.daily(spark, d).withColumn("atr_pct", F.lit(0.01)), GRID)


def _cell(up, down, h):
    hits = ", ".join(f"case when lead(close, {k}) over w >= close * (1 + {up} * 0.01) then {k} when lead(close, {k}) over w <= close * (1 - {down} * 0.01) then -{k} end" for k in range(1, h + 1))
    return f"select {up}::double as up, {down}::double as down, {h} as horizon, coalesce({hits}) as hit, lead(close, {h}) over w as f from bars {W}"


GRID_SQL = with_(DAILY, "c as (" + " union all ".join(f"(select * from ({_cell(*g)}))" for g in GRID) + ")") + " select up, down, horizon, count(*) as n, round(100.0 * count(*) filter (hit > 0) / count(*), 4) as long_pct, round(100.0 * count(*) filter (hit > 0) / count(*), 4) between 35 and 65 as balanced from c where f is not null and hit is not null group by 1, 2, 3"


def _scored(spark, d):
    """Daily labels with a probability that stands for a model's."""
    b = labels.fixed_horizon(T.daily(spark, d), 6)
    p = 0.3 + F.pmod(F.floor(F.col("close")) + F.col("trade_count"), F.lit(50)) / 100.0
    return b.withColumn("p_up", p).withColumn("regime", F.when(F.col("trade_count") % 2 == 0, "trend_up").otherwise("range"))


_SCORED = f"sc as (select * from (select *, lead(close, 6) over w as f, 0.3 + cast((cast(floor(close) as bigint) + trade_count) % 50 as double) / 100.0 as p_up, case when trade_count % 2 = 0 then 'trend_up' else 'range' end as regime from bars {W}) where f is not null)"


def window_performance(spark, d):
    return rounded(backtest.window_performance(_scored(spark, d), ["symbol"]))


PERF_SQL = with_(
    DAILY,
    _SCORED,
    "x as (select symbol, greatest(p_up, 1 - p_up) as conf, (f - close) / close * case when p_up >= 0.5 then 1 else -1 end as net from sc)",
    "y as (select symbol, count(*) as rows_, count(*) filter (conf >= 0.55) as signals, count(*) filter (conf >= 0.55 and net > 0) as wins, coalesce(sum(net) filter (conf >= 0.55 and net > 0), 0) as g, coalesce(-sum(net) filter (conf >= 0.55 and net < 0), 0) as l, coalesce(avg(conf) filter (conf >= 0.55), 0) as mc from x group by 1)",
) + " select symbol, rows_ as rows, signals, " + out("100.0 * wins / signals as win_rate", "case when l > 0 then least(g / l, 999.0) when g > 0 then 999.0 else 0.0 end as profit_factor", "signals / rows_ as signal_rate", "mc as mean_confidence") + " from y"


def meta_labels(spark, d):
    x = labels.meta_gate(labels.meta_labels(_scored(spark, d)), "base_confidence", 0.55)
    return x.groupBy("symbol", "regime").agg(F.count("*").alias("n"), F.sum("meta_target").alias("good"), F.sum(F.col("take").cast("int")).alias("taken"), F.round(F.sum("size"), 4).alias("size"))


META_SQL = with_(
    DAILY,
    _SCORED,
    "x as (select symbol, regime, greatest(p_up, 1 - p_up) as c, (f - close) / close * case when p_up >= 0.5 then 1 else -1 end - 0.0007 as net from sc)",
) + " select symbol, regime, count(*) as n, sum((net > 0)::int)::bigint as good, sum((c >= 0.55)::int)::bigint as taken, round(sum(case when c >= 0.55 then least(greatest((c - 0.55) / (1 - 0.55), 0.25), 1.0) else 0.0 end), 4) as size from x group by 1, 2"


def threshold_table(spark, d):
    x = labels.meta_labels(_scored(spark, d))
    return rounded(labels.threshold_table(x, [0.5, 0.55, 0.6, 0.65], p="base_confidence"))


THRESHOLD_SQL = with_(
    DAILY,
    _SCORED,
    "x as (select greatest(p_up, 1 - p_up) as c, (f - close) / close * case when p_up >= 0.5 then 1 else -1 end - 0.0007 as net from sc)",
    "t(threshold) as (values (0.5::double), (0.55::double), (0.6::double), (0.65::double))",
    "y as (select threshold, count(*) as n, count(*) filter (c >= threshold) as k, count(*) filter (c >= threshold and net > 0) as good, count(*) filter (net > 0) as pos, coalesce(sum(net) filter (c >= threshold and net > 0), 0) as g, coalesce(-sum(net) filter (c >= threshold and net < 0), 0) as l, coalesce(avg(net) filter (c >= threshold) * 10000, 0) as bps from x, t group by 1)",
) + " select " + out("threshold as threshold") + ", k as n_taken, " + out("k / n as rate", "good / k as precision", "good / pos as recall", "good / k as win_rate", "case when l > 0 then least(g / l, 999.0) when g > 0 then 999.0 else 0.0 end as profit_factor", "bps as mean_bps") + " from y"


def suggested_threshold(spark, d):
    return labels.suggest_threshold(T.signals(spark, d))


SUGGEST_SQL = with_(SIGNALS, "t as (select unnest(range(52, 71)) / 100.0 as threshold)", "c as (select threshold, avg((confidence >= threshold)::int) as c from signals, t group by 1)") + " select coalesce(max(threshold) filter (c between 0.1 and 0.4), 0.55)::double as threshold from c"


def performance(spark, d):
    return rounded(ledger.performance(T.signals(spark, d), AS_OF))


def performance_cube(spark, d):
    return rounded(ledger.cube(T.signals(spark, d), AS_OF))


def _perf_sql(cells: str, keys: str) -> str:
    """Performance per cell; cells is a query over signals that adds the keys."""
    on = " and ".join(f"b.{k} = r.{k}" for k in keys.split(", ")) if keys else "true"
    part, group, lead = (f"partition by {keys} ", f"group by {keys}", f"{keys}, ") if keys else ("", "", "")
    first = "min(created_at) // 86400000 * 86400000"
    return with_(
        SIGNALS,
        f"s as ({cells})",
        f"b as (select {lead}count(*) as total, count(*) filter (result in {CLOSED}) as closed, count(*) filter (result = 'win') as wins, count(*) filter (result = 'loss') as losses, count(*) filter (result = 'rejected') as rejected, count(*) filter (result = 'open') as open, coalesce(sum(pnl_pct) filter (result = 'win'), 0) as g, coalesce(-sum(pnl_pct) filter (result = 'loss'), 0) as l,"
        f" avg(coalesce(pnl_pct, 0)) filter (result in {CLOSED}) as ev, avg(rr_ratio) filter (result in {CLOSED}) as rr, avg(duration_minutes) filter (result in {CLOSED}) / 60.0 as hours, avg(confidence) as conf, min(created_at) as live_since, greatest(1, ({AS_OF} - {first}) // 86400000) as days_tracked from s {group})",
        f"d as (select {lead}closed_at // 86400000 as day, round(sum(coalesce(pnl_pct, 0)), 9) as p from s where result in {CLOSED} and closed_at is not null group by {lead}closed_at // 86400000)",
        f"e as (select *, 100 * product(1 + p / 100) over ({part}order by day) as eq from d)",
        f"f as (select *, greatest(max(eq) over ({part}order by day), 100.0) as peak from e)",
        f"r as (select {lead}min((eq - peak) / peak * 100) as mdd, arg_max(eq, day) as eq, avg(p / 100) as m, stddev_samp(p / 100) as sd, stddev_samp(p / 100) filter (p < 0) as dsd from f {group})",
        f"j as (select b.*, r.mdd, r.eq, r.m, case when r.sd > 0 then r.m / r.sd * sqrt(365) else 0.0 end as sh, r.dsd from b left join r on {on})",
    ) + f" select {lead}total, closed, wins, losses, rejected, open, live_since, days_tracked, " + out(
        "case when wins + losses > 0 then wins / (wins + losses) else 0.0 end as win_rate", "case when l <> 0 then g / abs(l) when g > 0 then null else 0.0 end as profit_factor", "coalesce(ev, 0.0) as expected_value", "coalesce(rr, 0.0) as avg_rr", "coalesce(hours, 0.0) as avg_hours", "coalesce(conf, 0.0) as avg_confidence",
        "coalesce((eq / 100 - 1) * 100, 0.0) as total_pnl_pct", "coalesce(mdd, 0.0) as max_drawdown", "case when closed >= 10 then sh end as sharpe", "case when closed >= 10 then case when dsd > 0 then m / dsd * sqrt(365) else sh end end as sortino", "case when closed >= 10 then case when mdd <> 0 then m * 365 * 100 / abs(mdd) else 0.0 end end as calmar",
    ) + " from j"


PERFORMANCE_SQL = _perf_sql(f"select * from signals where created_at <= {AS_OF}", "")
CUBE_SQL = _perf_sql(f"select s.*, tf, period_days from (select *, unnest(['all', coalesce(timeframe, '4h')]) as tf from signals where created_at <= {AS_OF}) s join (values (7), (30), (90)) v(period_days) on {AS_OF} - created_at <= period_days::bigint * 86400000 where tf in ('all', '4h', '15m', '1h')", "tf, period_days")


def daily_equity(spark, d):
    return rounded(ledger.daily_equity(T.signals(spark, d), ["symbol"]))


EQUITY_SQL = with_(
    SIGNALS,
    f"d as (select symbol, cast(make_timestamp(closed_at * 1000) as date) as date, count(*) as trades, sum(pnl_pct) as p from signals where result in {CLOSED} group by 1, 2)",
    "e as (select *, 100 * product(1 + p / 100) over (partition by symbol order by date) as eq from d)",
    "f as (select *, greatest(max(eq) over (partition by symbol order by date), 100.0) as peak from e)",
) + " select symbol, date, trades, " + out("p as pnl_pct", "eq as equity", "(eq - peak) / peak * 100 as drawdown_pct") + " from f"


def monthly_pnl(spark, d):
    return rounded(ledger.monthly(T.signals(spark, d)))


MONTHLY_SQL = with_(SIGNALS) + f" select strftime(make_timestamp(closed_at * 1000), '%Y-%m') as month, count(*) as trades, count(*) filter (result = 'win') as wins, count(*) filter (result = 'loss') as losses, " + out("sum(pnl_pct) as pnl_pct", "case when count(*) filter (result in ('win', 'loss')) > 0 then count(*) filter (result = 'win') / count(*) filter (result in ('win', 'loss')) else 0.0 end as win_rate") + f" from signals where result in {CLOSED} and closed_at is not null group by 1"


def ledger_stats(spark, d):
    return rounded(ledger.ledger_stats(T.signals(spark, d), ["symbol"]))


_GAIN, _COST = "coalesce(sum(pnl_pct) filter (result = 'win'), 0)", "coalesce(sum(pnl_pct) filter (result = 'loss'), 0)"
_LSTATS = "count(*) as total, count(*) filter (result = 'open') as open, count(*) filter (result <> 'open') as closed, count(*) filter (result = 'win') as wins, count(*) filter (result = 'loss') as losses, " + out(
    "case when count(*) filter (result in ('win', 'loss')) = 0 then 0.0 else count(*) filter (result = 'win') / count(*) filter (result in ('win', 'loss')) end as win_rate", "coalesce(sum(pnl_pct) filter (result <> 'open'), 0) as total_pnl", "coalesce(avg(pnl_pct) filter (result <> 'open'), 0) as avg_pnl", "coalesce(max(pnl_pct) filter (result <> 'open'), 0) as best",
    "coalesce(min(pnl_pct) filter (result <> 'open'), 0) as worst", f"{_GAIN} as gross_win", f"{_COST} as gross_loss", f"case when {_COST} <> 0 then {_GAIN} / abs({_COST}) when {_GAIN} > 0 then null else 0.0 end as profit_factor", "coalesce(avg(confidence), 0) as avg_confidence",
)
LEDGER_SQL = with_(SIGNALS) + f" select symbol, {_LSTATS} from signals group by 1"


def trading_stats(spark, d):
    """Thirty days of each symbol and timeframe."""
    return rounded(ledger.ledger_stats(ledger.with_timeframe(T.signals(spark, d)), ["symbol", "timeframe"], AS_OF - 60 * DAY_MS, 30))


TRADING_SQL = with_(SIGNALS) + f" select symbol, coalesce(timeframe, '4h') as timeframe, {_LSTATS} from signals where created_at >= {AS_OF - 90 * DAY_MS} and created_at <= {AS_OF - 60 * DAY_MS} group by 1, 2"


def all_time_stats(spark, d):
    return rounded(ledger.all_time_stats(T.signals(spark, d), AS_OF, ["symbol"]))


_SINCE = AS_OF // DAY_MS * DAY_MS - 30 * DAY_MS
_RATE = "case when count(*) filter (result in ('win', 'loss'){0}) = 0 then 0.0 else count(*) filter (result = 'win'{0}) / count(*) filter (result in ('win', 'loss'){0}) end"
ALL_TIME_SQL = with_(SIGNALS) + " select symbol, count(*) as total, count(*) filter (result in ('win', 'loss')) as closed, count(*) filter (result = 'win') as wins, count(*) filter (result = 'loss') as losses, count(*) filter (result = 'open') as open, " + out(_RATE.format("") + " as win_rate", _RATE.format(f" and created_at >= {_SINCE}") + " as win_rate_30d", "coalesce(sum(pnl_pct) filter (result in ('win', 'loss')), 0) as total_pnl") + " from signals group by 1"


def merged_stats(spark, d):
    parts = ledger.ledger_stats(ledger.with_timeframe(T.signals(spark, d)), ["symbol", "timeframe"])
    return rounded(ledger.merge_stats(parts, ["timeframe"]))


MERGED_SQL = with_(SIGNALS, f"p as (select symbol, coalesce(timeframe, '4h') as timeframe, count(*) filter (result in ('win', 'loss')) as decided, avg(confidence) as conf, count(*) as total, count(*) filter (result = 'open') as open, count(*) filter (result = 'win') as wins, count(*) filter (result = 'loss') as losses, sum(pnl_pct) filter (result <> 'open') as pnl, max(pnl_pct) as best, min(pnl_pct) as worst, {_GAIN} as gain, {_COST} as cost from signals group by 1, 2)") + " select timeframe, cast(sum(total) as bigint) as total, cast(sum(open) as bigint) as open, cast(sum(total) - sum(open) as bigint) as closed, cast(sum(wins) as bigint) as wins, cast(sum(losses) as bigint) as losses, " + out(
    "sum(wins) / sum(wins + losses) as win_rate", "sum(pnl) as total_pnl", "sum(pnl) / (sum(total) - sum(open)) as avg_pnl", "greatest(max(best), 0) as best", "least(min(worst), 0) as worst", "sum(gain) as gross_win", "sum(cost) as gross_loss", "case when sum(cost) <> 0 then sum(gain) / abs(sum(cost)) when sum(gain) > 0 then null else 0.0 end as profit_factor", "sum(conf * decided) / sum(decided) as avg_confidence"
) + " from p group by 1"


def ledger_upsert(spark, d):
    """The ledger as a merged table: all signals logged as open, the closed ones closed in two merges, the rejected rejected."""
    s = T.signals(spark, d).where("created_at is not null")
    path = scratch(spark, "ledger")
    source_ledgers.log_signals(spark, path, s.select("id", "symbol", "direction", "timeframe", "confidence", "created_at"))
    closed = s.where(F.col("result").isin(*ledger.CLOSED)).withColumn("close_price", (100 + F.col("id") % 7).cast("double"))
    for half in (0, 1):
        source_ledgers.close_signals(spark, path, closed.where(F.pmod(F.col("id"), F.lit(2)) == half))
    source_ledgers.reject_signals(spark, path, s.where("result = 'rejected'").select("id", "closed_at"))
    return rounded(versions.read(spark, path).select("id", "symbol", "direction", "timeframe", "confidence", "created_at", "result", "closed_at", "close_price", "pnl_pct"))


UPSERT_SQL = with_(SIGNALS) + " select id, symbol, direction, coalesce(timeframe, '4h') as timeframe, created_at, result, closed_at, " + out("confidence as confidence", f"case when result in {CLOSED} then (100 + id % 7)::double end as close_price", f"case when result in {CLOSED} then pnl_pct end as pnl_pct") + " from signals"


def bot_metrics(spark, d):
    t = T.signals(spark, d).where("pnl_pct is not null")
    return rounded(backtest.bot_metrics(t.withColumn("pnl", F.col("pnl_pct") * 100.0), 10_000.0, ["symbol"]))


BOT_SQL = with_(SIGNALS, "t as (select symbol, pnl_pct * 100.0::double as pnl from signals where pnl_pct is not null)") + " select symbol, count(*) as trades, " + out("count(*) filter (pnl > 0) / count(*) as win_rate", "case when coalesce(sum(pnl) filter (not pnl > 0), 0) <> 0 then coalesce(sum(pnl) filter (pnl > 0), 0) / abs(sum(pnl) filter (not pnl > 0)) else 0.0 end as profit_factor", "case when count(*) >= 2 and stddev_samp(pnl / 10000) >= 1e-10 then avg(pnl / 10000) / stddev_samp(pnl / 10000) * sqrt(2190) else 0.0 end as sharpe") + " from t group by 1"


def open_signals_page(spark, d):
    return ledger.open_page(T.signals(spark, d), "1h", 100, 20).select("id", "symbol", "direction", "timeframe", "created_at", "result")


OPEN_PAGE_SQL = with_(SIGNALS) + " select id, symbol, direction, coalesce(timeframe, '4h') as timeframe, created_at, result from signals where result = 'open' and coalesce(timeframe, '4h') = '1h' order by created_at desc, id desc limit 100 offset 20"


def walk_forward_ml(spark, d):
    """The windows' results of a stand-in probability, of each symbol."""
    rows = labels.assign_folds(_scored(spark, d), labels.walk_forward_windows(spark, 694_224_000_000, 883_612_800_000, 12, 3)).where("role = 'test'")
    return rounded(models.walk_forward_ml(backtest.window_performance(rows, ["symbol", "fold"]), ["symbol"]))


def _windows():
    import datetime as dt

    at, end, rows = dt.datetime(1992, 1, 1), dt.datetime(1998, 1, 1), []
    month = lambda d, n: d.replace(year=d.year + (d.month - 1 + n) // 12, month=(d.month - 1 + n) % 12 + 1)
    ms = lambda d: int(d.replace(tzinfo=dt.UTC).timestamp() * 1000)
    while month(at, 15) <= end:
        rows.append(f"({len(rows) + 1}, {ms(month(at, 12))}, {ms(month(at, 15))})")
        at = month(at, 3)
    return "wf(fold, a, b) as (values " + ", ".join(rows) + ")"


_CONF = "greatest(p_up, 1 - p_up)"
WALK_ML_SQL = with_(
    DAILY, _SCORED, _windows(),
    "n as (select symbol, fold, p_up, (f / close - 1) * case when p_up >= 0.5 then 1 else -1 end as net from sc join wf on open_time >= a and open_time < b)",
    f"p as (select symbol, fold, 100.0 * count(*) filter ({_CONF} >= 0.55 and net > 0) / nullif(count(*) filter ({_CONF} >= 0.55), 0) as wr, coalesce(sum(net) filter ({_CONF} >= 0.55 and net > 0), 0) as won, -coalesce(sum(net) filter ({_CONF} >= 0.55 and net < 0), 0) as lost from n group by 1, 2)",
    "q as (select symbol, coalesce(wr, 0) as wr, case when lost > 0 then least(won / lost, 999) when won > 0 then 999 else 0 end as pf from p)",
) + " select symbol, count(*) as windows, " + out("100.0 * count(*) filter (pf > 1) / count(*) as profitable_windows_pct", "avg(wr) as avg_win_rate", "coalesce(avg(pf) filter (pf < 100), 0) as avg_profit_factor") + ", 100.0 * count(*) filter (pf > 1) / count(*) >= 60 as passes from q group by 1"


def selection_data(spark, d):
    b = T.daily(spark, d).withColumns({"atr_pct": F.lit(0.01), "regime": F.when(F.col("trade_count") % 3 == 0, "trend_up").when(F.col("trade_count") % 3 == 1, "trend_down").otherwise("high_vol")})
    return models.selection_data(b, "trend", 1.5, 1.0, 8).select("symbol", "open_time", "target", "role")


SELECTION_SQL = with_(DAILY, _BARRIER, "s as (select tb.symbol, tb.open_time, tb.label as target from tb join bars b using (symbol, open_time) where label <> 0 and trade_count % 3 < 2)") + " select symbol, open_time, target, case when row_number() over w - 1 < floor(count(*) over (partition by symbol) * 0.8::double) then 'train' else 'test' end as role from s window w as (partition by symbol order by open_time)"


def dataset_1h(spark, d):
    """Labelled 1h rows, from trades to splits."""
    x = jobs.dataset_1h(T.bars(spark, d, "1h"), T.bars(spark, d, "4h"), T.funding(spark, d), T.metrics(spark, d))
    return rounded(x.select("symbol", "open_time", "close", "regime", "atr_pct", "adx", "target", "future_return", F.array_join("splits", ",").alias("splits")))


def dataset_daily_rows(spark, d):
    """Labelled daily rows with the splits trend and high_vol."""
    m = jobs.matrix(T.daily(spark, d), T.funding(spark, d), T.metrics(spark, d), 1440, lookback=120, min_bars=100, window=100)
    x = jobs.dataset(jobs.trim(m, 120, 100).drop("bar_idx"), 1.5, 1.0, 6, False, "high_vol")
    return rounded(x.select("symbol", "open_time", "close", "regime", "atr_pct", "adx", "target", "future_return", F.array_join("splits", ",").alias("splits")))


def _dataset_sql(*source, first: str, up: float, down: float, horizon: int, **options):
    """Regimes over the source's bars, labels by them from the first bar that counts on."""
    a = "greatest(atr_pct, 0.005)"
    hits = ", ".join(f"case when lead(close, {k}) over w >= close * (1 + {up} * {a}) then {k} when lead(close, {k}) over w <= close * (1 - {down} * {a}) then -{k} end" for k in range(1, horizon + 1))
    return with_(
        *regime_ctes(*source, **options),
        f"warm as (select * from (select *, max(k) over (partition by symbol) as n from lab) t where {first})",
        f"lb as (select *, coalesce({hits}) as hit, lead(close, {horizon}) over w as fh, list(close) over (partition by symbol order by open_time rows between 1 following and {horizon} following) as ahead from warm {W})",
        recursive=True,
    ) + " select symbol, open_time, regime, sign(hit)::int as target, " + out("close as close", "atr_pct as atr_pct", "adx as adx", "ahead[abs(hit)] / close - 1 as future_return") + ", case when regime in ('trend_up', 'trend_down') then 'trend' when regime = 'high_vol' then 'high_vol' else '' end as splits from lb where fh is not null and hit is not null"


DATASET_1H_SQL = _dataset_sql(TRADES, bars_sql("1h"), first="k > 200 or n <= 200", up=1.5, down=1.0, horizon=6, period=10, lookback=168, min_bars=100, vol=0.75)
DATASET_DAILY_SQL = _dataset_sql(DAILY, first="case when n > 220 then k > 220 when n > 100 then k > 100 else k = n end", up=1.5, down=1.0, horizon=6)


def revenue(spark, d):
    return rounded(ledger.revenue(T.payments(spark, d), T.users(spark, d), "1995-03"), 2)


REVENUE_SQL = with_(PAYMENTS, USERS) + " select " + out("coalesce(sum(amount_usd) filter (status = 'paid'), 0) as total_usd", "coalesce(sum(amount_usd) filter (status = 'paid' and strftime(make_timestamp(created_at * 1000), '%Y-%m') = '1995-03'), 0) as month_usd", "coalesce(sum(amount_usd) filter (status = 'paid' and method = 'stars'), 0) as stars_usd", "coalesce(sum(amount_usd) filter (status = 'paid' and method = 'usdt'), 0) as usdt_usd", digits=2) + ", count(*) filter (status = 'paid') as paid_count, count(*) filter (status <> 'paid') as pending_count, (select count(*) filter (role = 'premium' and not banned) from users) as active_premium, (select count(*) from users) as users from payments"


def snapshot(spark, d):
    return ledger.snapshot(T.signals(spark, d))


SNAPSHOT_SQL = with_(SIGNALS, "l as (select * from signals order by created_at desc, id desc limit 1)") + " select (select count(*) from signals where result = 'open') as open_signals, (select count(*) from signals) as signals, id as last_id, symbol as last_symbol, direction as last_direction, created_at as last_created_at from l"


def newest_page(spark, d):
    return ledger.page(ledger.filter_signals(T.signals(spark, d), "4h", "R", "closed"), limit=20, offset=10).select("id", "symbol", "timeframe", "result", "created_at")


PAGE_SQL = with_(SIGNALS) + f" select id, symbol, coalesce(timeframe, '4h') as timeframe, result, created_at from signals where coalesce(timeframe, '4h') = '4h' and symbol like '%R%' and result in {CLOSED} order by created_at desc, id desc limit 20 offset 10"


def _open(spark, d):
    from tapeloom.operators.series import asof

    s = T.signals(spark, d).where("result = 'open'").drop("result", "closed_at", "pnl_pct", "rr_ratio", "duration_minutes")
    b = T.daily(spark, d).select("symbol", F.col("open_time").alias("_t"), F.col("close").alias("entry_price"))
    x = asof(s, b, "created_at", "_t", ["entry_price"]).where("entry_price is not null")
    long = F.col("direction") == "long"
    return x.select("id", "symbol", "direction", "entry_price", (F.col("entry_price") * F.when(long, 0.8).otherwise(1.2)).alias("stop_loss"), (F.col("entry_price") * F.when(long, 1.3).otherwise(0.7)).alias("take_profit"), "created_at", "confidence")


def first_touch(spark, d):
    return rounded(ledger.first_touch(_open(spark, d).drop("confidence"), T.daily(spark, d)), 9)


TOUCH_SQL = with_(
    DAILY,
    SIGNALS,
    "o as (select s.id, s.symbol, s.direction, s.created_at, b.close as entry_price from signals s asof join bars b on s.symbol = b.symbol and s.created_at >= b.open_time where s.result = 'open')",
    "p as (select *, entry_price * case when direction = 'long' then 0.8::double else 1.2::double end as stop_loss, entry_price * case when direction = 'long' then 1.3::double else 0.7::double end as take_profit from o)",
    "q as (select p.*, b.open_time as t, b.high, b.low, case when direction = 'long' then b.low <= stop_loss else b.high >= stop_loss end as st, case when direction = 'long' then b.high >= take_profit else b.low <= take_profit end as tg from p join bars b on b.symbol = p.symbol and b.open_time >= p.created_at)",
    "h as (select id, min(t) filter (st or tg) as ht, arg_min(case when st then 0 else 1 end, t) filter (st or tg) as won from q group by 1 having min(t) filter (st or tg) is not null)",
    "m as (select q.id, min(case when direction = 'long' then low - entry_price else entry_price - high end) as mae, max(case when direction = 'long' then high - entry_price else entry_price - low end) as mfe from q join h using (id) where q.t <= h.ht group by 1)",
    "r as (select p.*, won, ht, mae, mfe, case when won = 1 then take_profit else stop_loss end as cp from p join h using (id) join m using (id))",
) + " select id, symbol, direction, created_at, case when won = 1 then 'win' else 'loss' end as result, ht + 86400000 as closed_at, cast(floor((ht + 86400000 - created_at) / 60000) as bigint) as duration_minutes, " + out("entry_price as entry_price", "stop_loss as stop_loss", "take_profit as take_profit", "cp as close_price", "case when direction = 'long' then cp - entry_price else entry_price - cp end * 100 / entry_price as pnl_pct", "least(mae, 0) * 100 / entry_price as mae_pct", "greatest(mfe, 0) * 100 / entry_price as mfe_pct", "abs(take_profit - entry_price) / abs(entry_price - stop_loss) as rr_ratio", digits=9) + " from r"


def _taken(spark, d):
    """Every closed signal of the ledger, to be traded anew."""
    return T.signals(spark, d).where("closed_at is not null").select("id", "symbol", "direction", "created_at")


def table_backtest(spark, d):
    return rounded(backtest.table_backtest(_taken(spark, d), T.daily(spark, d)), 9)


_TRADED = (
    DAILY,
    SIGNALS,
    "p0 as (select s.id, s.symbol, s.direction, b.open_time as t0, b.open as e, case when s.direction = 'long' then 1.0::double else -1.0::double end as sg from signals s asof join bars b on s.symbol = b.symbol and s.created_at < b.open_time where s.closed_at is not null)",
    "p as (select *, e * (1 - sg * 0.02) as sl, e * (1 + sg * 0.03) as tp from p0)",
    "q as (select p.*, b.open_time as t, case when sg > 0 then b.low <= sl else b.high >= sl end as st, case when sg > 0 then b.high >= tp else b.low <= tp end as tg from p join bars b on b.symbol = p.symbol and b.open_time >= p.t0)",
    "h as (select id, min(t) as ht, arg_min(st, t) as lost from q where st or tg group by 1)",
    "tr0 as (select p.*, ht + 86400000 as ts, lost, case when lost then sl else tp end as cp from p join h using (id))",
    "tr1 as (select *, 1000 * (cp - e) * sg / e as gross, (ts - t0) / 3600000.0 as hours from tr0)",
    "tr as (select *, 2 * 1000 * 0.0005 * 0.9 + 2 * 1000 * 0.5 * 0.6 * sqrt(1000 / 30e9) + 1000 * 0.0003 * hours / 8 * sg as cost from tr1)",
)
TRADES_SQL = with_(*_TRADED) + " select id, symbol, direction, t0 as entry_time, ts, case when lost then 'loss' else 'win' end as result, " + out("e as entry_price", "cp as close_price", "gross as gross_pnl", "cost as total_cost", "gross - cost as pnl", digits=9) + " from tr"


def walk_forward_backtest(spark, d):
    windows = labels.walk_forward_windows(spark, 791_424_000_000, T1, 12, 3, 2)
    return rounded(backtest.walk_forward_backtest(_taken(spark, d), T.daily(spark, d), windows), 4)


_WALKED = (
    "w0(fold, a) as (select 1, make_timestamp(791424000000 * 1000) union all select fold + 1, a + interval 3 month from w0 where a + interval 3 month + interval 12 month + interval 3 month <= make_timestamp(1004572800000 * 1000))",
    "w1 as (select fold, epoch_ms(a + interval 12 month) as test_from, epoch_ms(a + interval 12 month + interval 3 month) as test_to from w0)",
    "i as (select fold, test_from, tr.*, gross - cost as pnl from tr join w1 on t0 >= test_from and ts <= test_to)",
    "tm as (select fold, count(*) as trades, 100.0 * count(*) filter (pnl > 0) / count(*) as wr, case when coalesce(-sum(pnl) filter (pnl < 0), 0) > 0 then coalesce(sum(pnl) filter (pnl > 0), 0) / -sum(pnl) filter (pnl < 0) else 'inf'::double end as pf from i group by 1)",
    "c0 as (select fold, (ts - 1) // 86400000 as dd, sum(pnl) as p, max(ts) as ts from i group by 1, 2)",
    "cv as (select fold, ts, 10000 + sum(p) over (partition by fold order by dd) as eq from c0 union all select distinct fold, test_from, 10000.0::double from i)",
    "dy as (select fold, ts // 86400000 as day, arg_max(eq, ts) as eq from cv group by 1, 2)",
    "dr as (select *, eq / nullif(greatest(lag(eq) over (partition by fold order by day), 0), 0) - 1 as r from dy)",
    "sh as (select fold, count(r) as n, avg(r) as m, stddev_samp(r) as sd from dr group by 1)",
    "pk as (select *, max(eq) over (partition by fold order by ts) as peak from cv)",
    "ag as (select fold, max(case when peak > 0 then (peak - eq) / peak * 100 else 0.0 end) as mdd, arg_min(eq, ts) as e0, arg_max(eq, ts) as e1, (max(ts) - min(ts)) / 86400000.0 as days from pk group by 1)",
    "mt as (select fold, trades, wr, pf, case when n >= 2 and sd >= 1e-8 then m / sd * sqrt(365) else 0.0 end as sharpe, mdd, e1 / e0 - 1 as tot, case when days > 0 and e1 / e0 > 0 then pow(e1 / e0, 365 / days) - 1 else 0.0 end as ann from tm join sh using (fold) join ag using (fold))",
)
WALK_BACKTEST_SQL = with_(*_TRADED, *_WALKED, recursive=True) + " select fold, trades, " + out("wr as win_rate", "pf as profit_factor", "sharpe as sharpe", "mdd as max_drawdown", "tot as total_return", "ann as annual_return", "case when mdd > 0 then ann / (mdd / 100) else 0.0 end as calmar", digits=4) + " from mt"


def walk_forward_gate(spark, d):
    windows = labels.walk_forward_windows(spark, 791_424_000_000, T1, 12, 3, 2)
    one = backtest.walk_forward_summary(backtest.walk_forward_backtest(_taken(spark, d), T.daily(spark, d), windows))
    return rounded(one.withColumn("failed", F.array_join("failed", ",")), 4)


WALK_GATE_SQL = with_(*_TRADED, *_WALKED, "g as (select count(*) as windows, 100.0 * count(*) filter (tot > 0) / count(*) as pp, avg(sharpe) as av, min(sharpe) as wo, sum(tot) as su from mt)", recursive=True) + " select windows, " + out("pp as profitable_pct", "av as avg_sharpe", "wo as worst_sharpe", "su as sum_return", digits=4) + ", pp >= 60 and av >= 0 and wo >= -1 and su >= 0 as passed, array_to_string(list_filter([case when pp < 60 then 'profitable_pct' end, case when av < 0 then 'avg_sharpe' end, case when wo < -1 then 'worst_sharpe' end, case when su < 0 then 'sum_return' end], lambda x: x is not null), ',') as failed from g"


def position_diff(spark, d):
    c = T.table(spark, d, "customer")
    own = c.where("c_custkey % 3 <> 0").select(F.col("c_custkey").cast("string").alias("symbol"), F.round("c_acctbal").alias("qty"))
    there = c.where("c_custkey % 5 <> 0").select(F.col("c_custkey").cast("string").alias("symbol"), F.when(F.col("c_custkey") % 7 == 0, -F.round("c_acctbal")).otherwise(F.round("c_acctbal")).alias("qty"))
    return ledger.position_diff(own, there)


DIFF_SQL = """with a as (select cast(c_custkey as varchar) as symbol, round(c_acctbal) as own_qty from customer where c_custkey % 3 <> 0),
b as (select cast(c_custkey as varchar) as symbol, case when c_custkey % 7 = 0 then -round(c_acctbal) else round(c_acctbal) end as exchange_qty from customer where c_custkey % 5 <> 0),
e as (select * from b where abs(exchange_qty) > 1e-10)
select coalesce(a.symbol, e.symbol) as symbol, own_qty, exchange_qty, case when own_qty is null then 'orphan' when exchange_qty is null then 'ghost' when sign(own_qty) <> sign(exchange_qty) or abs(own_qty - exchange_qty) >= 1e-8 then 'mismatch' else 'ok' end as kind from a full join e on a.symbol = e.symbol"""


def gap_list(spark, d):
    return audit.largest_gaps(T.bars(spark, d), 900_000, 10)


GAPS_SQL = with_(TRADES, bars_sql(), f"g as (select symbol, lag(open_time) over w as gap_from, open_time as gap_to from bars {W})") + " select symbol, gap_from, gap_to, gap_to - gap_from as gap_ms from g where gap_to - gap_from > 900000 order by gap_ms desc, symbol, gap_from limit 10"


def quality_report(spark, d):
    return audit.report(T.bars(spark, d), "15m")


REPORT_SQL = with_(
    TRADES,
    bars_sql(),
    f"g as (select *, open_time - lag(open_time) over w > 900000 as gap from bars {W})",
    "x as (select symbol, count(*) as bars, count(distinct open_time) as dt, count(distinct open_time // 86400000) * 96 as expected, count(*) filter (gap) as gaps, (count(*) filter (high < low) + count(*) filter (close <= 0) + count(*) filter (volume < 0)) as anomalies from g group by 1)",
) + " select symbol, bars, expected, round(dt * 100.0 / expected, 4) as pct, bars - dt as duplicates, gaps, 0::bigint as nulls, anomalies::bigint as anomalies, round(dt * 100.0 / expected, 4) >= 99.9 and gaps = 0 and anomalies = 0 and bars = dt as passed from x"


def continuity(spark, d):
    return audit.continuity(T.bars(spark, d), "15m")


CONTINUITY_SQL = with_(TRADES, bars_sql(), f"g as (select symbol, open_time - lag(open_time) over w as s, abs(close - lag(close) over w) / lag(close) over w as j from bars {W})") + " select symbol, count(*) filter (s <> 900000) as breaks, count(*) filter (j > 0.15) as jumps from g group by 1"


def completeness(spark, d):
    x = audit.completeness(T.daily(spark, d))
    return x.select("symbol", "expected", "found", "pct", F.array_join("missing", ",").alias("missing"))


COMPLETE_SQL = with_(
    DAILY,
    "f as (select distinct symbol, cast(make_timestamp(open_time * 1000) as date) as p from bars)",
    "r as (select symbol, unnest(generate_series(min(p)::timestamp, max(p)::timestamp, interval 1 day))::date as p from f group by symbol)",
    "j as (select r.symbol, r.p, f.p as have, row_number() over (partition by r.symbol, f.p is null order by r.p) as k from r left join f on f.symbol = r.symbol and f.p = r.p)",
) + " select symbol, count(*) as expected, count(have) as found, round(count(have) * 100.0 / count(*), 4) as pct, coalesce(string_agg(strftime(p, '%Y-%m-%d'), ',' order by p) filter (have is null and k <= 50), '') as missing from j group by symbol"


def anomaly_counts(spark, d):
    return audit.anomalies(T.daily(spark, d), T.funding(spark, d), T.metrics(spark, d), T.trades(spark, d))


ANOMALY_SQL = with_(DAILY, FUNDING, METRICS, TRADES) + """ select 'bars' as source, 'high_below_low' as rule, symbol, count(*) filter (high < low) as n from bars group by symbol
union all select 'bars', 'close_not_positive', symbol, count(*) filter (close <= 0) from bars group by symbol
union all select 'bars', 'negative_volume', symbol, count(*) filter (volume < 0) from bars group by symbol
union all select 'funding', 'extreme_rate', symbol, count(*) filter (abs(fundingRate) >= 0.05) from funding group by symbol
union all select 'metrics', 'negative_open_interest', symbol, count(*) filter (sum_open_interest_value < 0) from metrics group by symbol
union all select 'trades', 'price_not_positive', symbol, count(*) filter (price <= 0) from trades group by symbol
union all select 'trades', 'quantity_not_positive', symbol, count(*) filter (quantity <= 0) from trades group by symbol"""


def freshness(spark, d):
    s = T.signals(spark, d).withColumn("source", F.coalesce("timeframe", F.lit("none")))
    return audit.freshness(s, ["15m", "1h", "4h", "1d"], AS_OF, 40 * DAY_MS)


FRESH_SQL = with_(SIGNALS, "d(source) as (values ('15m'), ('1h'), ('4h'), ('1d'))", "g as (select timeframe as source, max(created_at) as newest, count(*) as rows_ from signals group by 1)") + f" select d.source, newest, coalesce(rows_, 0) as rows, {AS_OF} - newest as lag_ms, case when newest is null then 'never' when {AS_OF} - newest > {40 * DAY_MS} then 'stale' else 'fresh' end as state from d left join g using (source)"


def parity(spark, d):
    a = T.bars(spark, d, "1h")
    from tapeloom.operators.bars import resample

    b = resample(T.bars(spark, d, "15m"), "1h")
    return rounded(audit.parity(a, b, ["symbol", "open_time"], ["open", "high", "low", "close", "volume"]))


PARITY_SQL = with_(TRADES, bars_sql("1h")) + " select c as column, count(*) as rows, 0::bigint as mismatches, 0.0::double as mean_diff, 0.0::double as max_diff from bars, (values ('open'), ('high'), ('low'), ('close'), ('volume')) v(c) group by 1"


def leak_audit(spark, d):
    x = labels.fixed_horizon(T.daily(spark, d), 6).select("open", "volume", "future_return", "target")
    return rounded(audit.leak_audit(x, "target"), 4)


LEAK_SQL = with_(
    DAILY,
    f"a as (select open, volume, (f - close) / close as future_return, case when f > close then 1.0 else -1.0 end::double as y from (select *, lead(close, 6) over w as f from bars {W}) where f is not null)",
    "l as (select unnest(['open', 'volume', 'future_return']) as column, unnest([corr(open, y), corr(volume, y), corr(future_return, y)]) as c from a)",
) + " select \"column\", \"column\" = 'future_return' as suspicious_name, round(c, 4) + 0.0 as corr, \"column\" = 'future_return' or abs(c) > 0.9 as leak from l"


def clock_drift(spark, d):
    """Each symbol's trades as a feed of its own, in the order of their ids."""
    t = T.trades(spark, d)
    return audit.clock_drift(t.select(F.col("symbol").alias("feed"), "transact_time", F.col("trade_id").alias("_pos")), file="feed")


DRIFT_SQL = with_(TRADES, "s as (select symbol, transact_time - lag(transact_time) over (partition by symbol order by trade_id) as step from trades)") + " select symbol as feed, count(*) as rows, coalesce(min(step) >= 0, true) as monotonic, coalesce(max(step), 0) as max_step_ms from s group by 1"


def cost_table(spark, d):
    b = T.daily(spark, d)
    m = b.groupBy("symbol").agg(F.sum(F.col("volume") * F.col("close")).alias("daily_volume"), F.lit(0.6).alias("volatility"), F.lit(0.0001).alias("funding_rate"), F.lit(24.0).alias("hours_held"), F.lit(True).alias("is_long"))
    return rounded(risk.cost_table(m, [1_000, 50_000]).select("symbol", "notional", "is_maker", "entry_fee", "entry_slippage", "funding_cost", "total_cost", "total_cost_bps", "min_required_return_bps"), 4)


COST_SQL = with_(
    DAILY,
    "m as (select symbol, sum(volume * close) as dv from bars group by 1)",
    "c(notional) as (values (1000.0::double), (50000.0::double))",
    "k(is_maker, rate) as (values (true, 0.0002::double * 0.9), (false, 0.0005::double * 0.9))",
    "x as (select symbol, notional, is_maker, notional * rate as fee, notional * 0.5 * 0.6 * sqrt(notional / dv) as slip, notional * 0.0001 * 3 as fund from m, c, k)",
) + " select symbol, " + out("notional as notional", "fee as entry_fee", "slip as entry_slippage", "fund as funding_cost", "2 * fee + 2 * slip + fund as total_cost", "(2 * fee + 2 * slip + fund) / notional * 10000 as total_cost_bps", "(2 * fee + 2 * slip + fund) / notional * 30000 as min_required_return_bps", digits=4) + ", is_maker from x"


def _fills(spark, d):
    """orders as rows of five accounts, one of which has most: opens, closes and marks by the order's key."""
    o = T.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    kind = F.when(k % 4 == 0, "close").when(k % 4 == 3, "mark").otherwise("open")
    return o.select(F.when(c % 3 == 0, F.concat(F.lit("a"), (c % 4).cast("string"))).otherwise("main").alias("account"), k.alias("fill_id"), T.millis("o_orderdate").alias("ts"), T.six("o_orderkey").alias("symbol"), kind.alias("kind"), F.when(k % 5 < 2, -1).otherwise(1).alias("side"), (1 + c % 7).cast("double").alias("qty"), (100 + F.floor("o_totalprice") % 40).cast("double").alias("price"), F.lit(0.25).alias("fee"))


def account_fold(spark, d):
    s = accounts.accounts(_fills(spark, d), 10_000.0)
    return rounded(s)


_ACCOUNT = (
    f"""f as (select case when o_custkey % 3 = 0 then 'a' || (o_custkey % 4) else 'main' end as account, o_orderkey as fill_id, epoch_ms(cast(o_orderdate as timestamp)) as ts, {T._SIX_SQL.format('o_orderkey')} as symbol,
      case when o_orderkey % 4 = 0 then 'close' when o_orderkey % 4 = 3 then 'mark' else 'open' end as kind, case when o_orderkey % 5 < 2 then -1 else 1 end as side, (1 + o_custkey % 7)::double as qty, (100 + floor(o_totalprice) % 40)::double as price, 0.25::double as fee from orders)""",
    "g as (select *, coalesce(sum(case when kind = 'close' then 1 else 0 end) over (partition by account, symbol order by ts, fill_id rows between unbounded preceding and 1 preceding), 0) as seg from f)",
    "h as (select *, coalesce(sum(case when kind = 'open' then qty end) over s, 0) as q, sum(case when kind = 'open' then qty * price end) over s as pq, sum(case when kind = 'open' then fee end) over s as fees, first_value(case when kind = 'open' then side end ignore nulls) over s as way from g window s as (partition by account, symbol, seg order by ts, fill_id rows between unbounded preceding and current row))",
    "m as (select *, case when q > 0 then way * (price - pq / q) * q end as move from h)",
    "u as (select *, coalesce(last_value(case when kind = 'mark' then move end ignore nulls) over (partition by account, symbol, seg order by ts, fill_id rows between unbounded preceding and 1 preceding), 0) as was from m)",
    "r as (select *, case when kind = 'close' and q > 0 then move - fees - fee else 0 end as realised, case when kind = 'open' then -fee when kind = 'close' and q > 0 then move - fee else 0 end as paid, case when kind = 'mark' and q > 0 then move - was when kind = 'close' then -was else 0 end as fl, case when kind <> 'mark' then ts // 86400000 end as day from u)",
    "c as (select *, 10000 + sum(paid) over w as cash, sum(fl) over w as unrealised, sum(realised) over w as reals, sum(case when realised < 0 then 1 else 0 end) over w as lost, last_value(day ignore nulls) over (partition by account order by ts, fill_id rows between unbounded preceding and 1 preceding) as dayp from r window w as (partition by account order by ts, fill_id rows between unbounded preceding and current row))",
    """e as (select *, cash + unrealised as equity, case when q > 0 and kind = 'close' then cash + unrealised - fl when q > 0 and kind = 'mark' then cash + unrealised end as top,
      case when day is not null and (dayp is null or day <> dayp) then reals - realised end as r0, case when day is not null and dayp is null then 10000 when day is not null and day <> dayp then cash - paid + unrealised - fl end as e0,
      case when day is not null and (dayp is null or (day + 3) // 7 <> (dayp + 3) // 7) then reals - realised end as w0, case when kind = 'close' and q > 0 and realised >= 0 then lost end as clean from c)""",
    "z as (select *, greatest(10000, max(top) over w) as peak, last_value(r0 ignore nulls) over w as r1, last_value(e0 ignore nulls) over w as e1, last_value(w0 ignore nulls) over w as w1, coalesce(last_value(clean ignore nulls) over w, 0) as l1 from e window w as (partition by account order by ts, fill_id rows between unbounded preceding and current row))",
)
ACCOUNT_SQL = with_(*_ACCOUNT) + " select account, fill_id, ts, symbol, kind, " + out("case when q > 0 and kind <> 'close' then q else 0 end as position", "case when q > 0 and kind <> 'close' then pq / q end as avg_price", "realised as realised", "cash as cash", "unrealised as unrealised", "equity as equity", "peak as peak", "greatest((peak - equity) / peak, 0) as drawdown", "(reals - coalesce(r1, 0) + unrealised) / case when coalesce(e1, 0) > 0 then e1 else 10000 end as daily_pnl_pct", "(reals - coalesce(w1, 0) + unrealised) / 10000 as weekly_pnl_pct") + ", cast(lost - l1 as bigint) as loss_streak from z"


def breaker_episodes(spark, d):
    """How long each account's circuit breaker was in each state, and the worst P&L of the day meanwhile."""
    a = accounts.accounts(_fills(spark, d), 10_000.0)
    null = F.lit(None).cast("double")
    b = risk.breaker(a.select("account", "ts", "fill_id", (-F.col("drawdown")).alias("drawdown"), "weekly_pnl_pct", "daily_pnl_pct", F.col("loss_streak").alias("consecutive_losses"), null.alias("atr"), null.alias("avg_atr"), null.alias("funding_rate")))
    return rounded(episodes.episodes(b.withColumn("day_pct", F.round("daily_pnl_pct", 6)), "breaker", "day_pct", ties=("fill_id",)))


EPISODE_SQL = with_(
    *_ACCOUNT,
    "b0 as (select account, ts, fill_id, round((reals - coalesce(r1, 0) + unrealised) / case when coalesce(e1, 0) > 0 then e1 else 10000 end, 6) as day_pct, (reals - coalesce(r1, 0) + unrealised) / case when coalesce(e1, 0) > 0 then e1 else 10000 end as day_raw, (reals - coalesce(w1, 0) + unrealised) / 10000 as week_pct, greatest((peak - equity) / peak, 0) as dd, lost - l1 as streak from z)",
    "b1 as (select *, case when dd >= 0.15 then 'kill' when week_pct <= -0.08 then 'weekly_loss' when day_raw <= -0.03 then 'daily_loss' when streak >= 5 then 'loss_streak' else 'ok' end as state from b0)",
    "b2 as (select *, case when lag(state) over w is distinct from state then 1 else 0 end as turn from b1 window w as (partition by account order by ts, fill_id))",
    "b3 as (select *, sum(turn) over (partition by account order by ts, fill_id rows between unbounded preceding and current row) - 1 as k from b2)",
    "b4 as (select account, cast(k as bigint) as episode, min(state) as state, min(ts) as from_ts, count(*) as rows, min(day_pct) as worst from b3 group by 1, 2)",
) + " select account, episode, state, from_ts, lead(from_ts) over (partition by account order by episode) as to_ts, rows, round(worst, 6) + 0.0 as worst from b4"


def risk_chain(spark, d):
    s = _open(spark, d).withColumn("atr", F.col("entry_price") * 0.01).withColumn("equity", F.lit(10_000.0))
    k = F.col("id")
    x = risk.sized(s.drop("stop_loss", "take_profit"))
    x = x.select("*", (k % 20).cast("double").alias("drawdown_pct"), (-(k % 11) / 100.0).alias("weekly_pnl_pct"), (-(k % 5) / 100.0).alias("daily_pnl_pct"), (k % 7).alias("consecutive_losses"), (F.col("created_at") - (k % 48) * HOUR_MS).alias("last_loss_at"), (k % 4).alias("open_positions"), F.when(k % 9 != 0, (k % 13) / 10000.0).alias("funding_rate"), ((k % 25) / 1000.0).alias("atr_pct"), F.lit(3.0).alias("total_cost_bps"))
    return rounded(risk.gated(x).select("id", "contracts", "notional", "leverage", "stop_loss", "take_profit", "reason", "approved"), 8)


RISK_SQL = with_(
    DAILY,
    SIGNALS,
    "o as (select s.id, s.symbol, s.direction, s.created_at, s.confidence, b.close as e from signals s asof join bars b on s.symbol = b.symbol and s.created_at >= b.open_time where s.result = 'open')",
    "p as (select *, e * 0.01 as atr, case when direction = 'long' then 1 else -1 end as sg, 10000 * 0.01 / (e * 0.01 * 1.5) * e as want from o)",
) + " select id, " + out("least(want, 100000.0) / e as contracts", "least(want, 100000.0) as notional", "case when want > 100000 then 10.0 else want / 10000 end as leverage", "e - sg * atr * 1.5 as stop_loss", "e + sg * atr * 1.5 * 1.5 as take_profit", digits=8) + """, r as reason, r is null as approved from (select *, case when id % 20 > 15 then 'max_drawdown' when id % 11 >= 8 then 'weekly_loss' when id % 5 >= 3 then 'daily_loss' when id % 7 >= 5 and id % 48 < 4 then 'consecutive_losses' when id % 4 >= 3 then 'max_positions' when confidence < 0.55 then 'confidence' when id % 9 = 0 or id % 13 > 10 then 'funding_rate' when (id % 25) / 1000.0 > 0.02 then 'volatility' when (id % 25) * 10.0 < 15 then 'expected_return' end as r from p)"""


def buy_and_hold(spark, d):
    return rounded(backtest.equity_metrics(backtest.buy_and_hold(T.daily(spark, d)), ["symbol"]), 4)


HOLD_SQL = with_(
    DAILY,
    "c as (select symbol, open_time as t, close / first_value(close) over w * 10000 as e from bars " + W + ")",
    "r as (select *, e / lag(e) over (partition by symbol order by t) - 1 as ret, max(e) over (partition by symbol order by t) as peak from c)",
    "s as (select symbol, avg(ret) as m, stddev_samp(ret) as sd, max((peak - e) / peak * 100) as mdd, arg_max(e, t) / arg_min(e, t) - 1 as tot, (max(t) - min(t)) / 86400000.0 as days from r group by 1)",
) + " select symbol, " + out("m / sd * sqrt(365) as sharpe", "mdd as max_drawdown", "tot as total_return", "pow(1 + tot, 365 / days) - 1 as annual_return", "(pow(1 + tot, 365 / days) - 1) / (mdd / 100) as calmar", digits=4) + " from s"


def _trial_returns(spark, d):
    x = T.daily(spark, d).select("symbol", "open_time", "close")
    x = index_bars(x)
    from tapeloom.operators.series import on_slices

    x = on_slices(x, lambda y, w: y.withColumn("ret", F.ln(F.col("close") / F.lag("close").over(w))), 1).where("ret is not null")
    n = x.groupBy("symbol").agg(F.count("*").alias("total"))
    return x.join(n, "symbol").select(F.col("symbol").alias("trial"), (F.col("bar_idx") - 1).alias("idx"), "total", "ret")


def deflated_sharpe(spark, d):
    return rounded(validation.deflated_sharpe(_trial_returns(spark, d), trials=[6, 20, 100]), 4)


_E = {n: validation.expected_max(n) for n in (6, 20, 100)}


def _legacy(n):
    import math

    s = math.sqrt(2 * math.log(n))
    return s - (math.log(math.log(n)) + math.log(4 * math.pi)) / (2 * s)


_CDF = "case when {z} >= 0 then 1 - 0.5 * (t_ * (0.254829592 + t_ * (-0.284496736 + t_ * (1.421413741 + t_ * (-1.453152027 + t_ * 1.061405429)))) * exp(-{z} * {z} / 2)) else 0.5 * (t_ * (0.254829592 + t_ * (-0.284496736 + t_ * (1.421413741 + t_ * (-1.453152027 + t_ * 1.061405429)))) * exp(-{z} * {z} / 2)) end"


def _cdf(z):
    return "(" + _CDF.format(z=z).replace("t_", f"(1 / (1 + 0.3275911 * abs({z}) / sqrt(2)))") + ")"


DSR_SQL = with_(
    DAILY,
    f"r as (select symbol, ln(close / lag(close) over w) as r from bars {W})",
    "p as (select symbol, count(r) as n, avg(r) / stddev_samp(r) as sr, (count(r) - 2) / sqrt(count(r) * (count(r) - 1.0)) * skewness(r) as sk, kurtosis_pop(r) + 3 as ku from r where r is not null group by 1)",
    "b as (select arg_max(sr, sr) as sr, arg_max(sk, sr) as sk, arg_max(ku, sr) as ku, arg_max(n, sr) as n, stddev_samp(sr) as sp from p)",
    "e(n_trials, em, el) as (values " + ", ".join(f"({n}, {v!r}::double, {_legacy(n)!r}::double)" for n, v in _E.items()) + ")",
    "z as (select n_trials, sr, (sr - sp * em) * sqrt(n - 1) / sqrt(1 - sk * sr + (ku - 1) / 4 * sr * sr) as z1, (1 - sk * sr + (ku - 3) / 4 * sr * sr) / (n - 1) as ov, (sr - el) / sqrt((1 - sk * sr + (ku - 3) / 4 * sr * sr) / (n - 1)) as z2 from b, e)",
) + " select n_trials, " + out("sr as best_sharpe", f"{_cdf('z1')} as dsr", f"case when ov > 0 then {_cdf('z2')} end as dsr_legacy", digits=4) + " from z"


def overfitting(spark, d):
    return validation.overfitting_probability(validation.block_sums(_trial_returns(spark, d), 6))


PBO_SQL = with_(
    DAILY,
    f"r0 as (select symbol as trial, ln(close / lag(close) over w) as r, row_number() over w - 2 as i from bars {W})",
    "r as (select *, count(*) over (partition by trial) as n from r0 where r is not null)",
    "b as (select trial, least(i * 6 // n, 5) as b, count(*) as n, sum(r) as s, sum(r * r) as q from r group by 1, 2)",
    "c as (select row_number() over () as combo, [a, b, c] as ins from (select x.i as a, y.i as b, z.i as c from range(6) x(i), range(6) y(i), range(6) z(i) where x.i < y.i and y.i < z.i))",
    "g as (select combo, trial, list_contains(ins, b) as i, sum(s) / sum(n) / sqrt(sum(q) / sum(n) - (sum(s) / sum(n)) ** 2) as sr from b, c group by 1, 2, 3)",
    "w as (select combo, trial, max(sr) filter (i) as ins, max(sr) filter (not i) as outs from g group by 1, 2)",
    "k as (select combo, arg_max(outs, ins) as chosen from w group by 1)",
    "l as (select combo, count(*) filter (outs < chosen) + 1 as rank, count(*) as trials from w join k using (combo) group by 1)",
) + " select count(*) as combinations, round(avg((rank / (trials + 1) <= 0.5)::int), 6) as pbo from l"


def win_rate_t(spark, d):
    m = ledger.monthly(T.signals(spark, d)).select((F.col("win_rate") * 100.0).alias("win_rate"), "trades")
    return rounded(validation.win_rate_t(m), 4)


WIN_T_SQL = with_(SIGNALS, f"m as (select strftime(make_timestamp(closed_at * 1000), '%Y-%m') as m, 100.0::double * count(*) filter (result = 'win') / count(*) filter (result in ('win', 'loss')) as w, count(*) as k from signals where result in {CLOSED} group by 1)") + " select count(*) as windows, " + out("sum(w * k) / sum(k) as weighted_win_rate", "(sum(w * k) / sum(k) - 50) * sqrt(count(*)) / stddev_samp(w) as t_stat", "(sum(w * k) / sum(k) / 100 - 0.5) * sqrt(sum(k)) / 0.5 as z_stat", digits=4) + " from m"


def symbols(spark, d):
    e = T.table(spark, d, "events")
    raw = F.concat(F.col("event_type"), F.lit("usdt-perp.x"))
    return e.groupBy(normal_symbol(raw).alias("symbol")).agg(F.count("*").alias("n"))


SYMBOL_SQL = "select upper(event_type) || 'USDT' as symbol, count(*) as n from events group by 1"


def mean_funding(spark, d):
    return rounded(backtest.mean_funding(T.funding(spark, d), CUT, T1), 8)


FUND_MEAN_SQL = with_(FUNDING) + f" select symbol, round(coalesce(avg(abs(fundingRate)) filter (fundingTime between {CUT} and {T1}), 0.0001), 8) + 0.0 as avg_funding from funding group by 1"


def dataset_4h(spark, d):
    m = jobs.matrix(T.daily(spark, d), T.funding(spark, d), T.metrics(spark, d), 1440, lookback=120, min_bars=100, window=100)
    return rounded(jobs.dataset_summary(jobs.dataset(jobs.trim(m, 120, 100).drop("bar_idx"), 1.5, 1.0, 6, False, "high_vol")))


def dataset_15m(spark, d):
    m = jobs.matrix(T.bars(spark, d, "15m"), T.funding(spark, d), T.metrics(spark, d), 15, lookback=120, min_bars=100, window=50)
    c = jobs.chain(m, "15m", T.bars(spark, d, "1h"), T.bars(spark, d, "4h"))
    return rounded(jobs.dataset_summary(jobs.dataset(c, 2.0, 1.0, 8, True, "orb")))


def random_entries(spark, d):
    return rounded(backtest.random_entries(T.daily(spark, d)))


def stride_sample(spark, d):
    from tapeloom.sources.store import stride_sample as sample

    return rounded(sample(T.trades(spark, d), 0, 4_000_000_000_000, 100).select("trade_id", "symbol", "price", "transact_time"))


STRIDE_SQL = with_(TRADES, "a as (select *, row_number() over (partition by symbol order by transact_time) - 1 as k, count(*) over (partition by symbol) as n from trades)") + " select trade_id, symbol, round(price, 6) + 0.0 as price, transact_time from a where k % cast(ceil(n / 100.0) as bigint) = 0"


def range_scan(spark, d):
    from tapeloom.sources.store import scan

    return rounded(scan(T.daily(spark, d), "NO", 852_076_800_000, 883_612_800_000, ["symbol", "open_time", "close", "volume"]))


SCAN_SQL = with_(DAILY) + " select symbol, open_time, round(close, 6) + 0.0 as close, volume from bars where symbol = 'NO' and open_time between 852076800000 and 883612800000"


def meta_dataset(spark, d):
    b = T.daily(spark, d).withColumn("atr_pct", F.lit(0.01))
    b = b.withColumn("regime", F.element_at(F.array(*(F.lit(r) for r in ("trend_up", "trend_down", "range", "high_vol"))), (F.col("trade_count") % 4 + 1).cast("int")))
    score = lambda rows, name: rows.withColumn("p_up", 0.3 + F.pmod(F.floor(F.col("close")) + F.col("trade_count"), F.lit(50)) / 100.0)
    return rounded(jobs.meta_summary(jobs.meta_dataset(b, score)))


def _barrier_sql(name: str, up: float, down: float, h: int, regimes: str) -> str:
    hits = ", ".join(f"case when lead(close, {k}) over w >= close * (1 + {up} * 0.01) then {k} when lead(close, {k}) over w <= close * (1 - {down} * 0.01) then -{k} end" for k in range(1, h + 1))
    return f"select '{name}' as base_regime, symbol, regime, p, ahead[coalesce(abs(hit), {h})] / close - 1 as ret from (select *, coalesce({hits}) as hit, lead(close, {h}) over w as f, list(close) over (partition by symbol order by open_time rows between 1 following and {h} following) as ahead from rb {W}) where f is not null and regime in ({regimes})"


META_SUMMARY_SQL = with_(
    DAILY,
    "rb as (select *, ['trend_up', 'trend_down', 'range', 'high_vol'][trade_count % 4 + 1] as regime, 0.3 + cast((cast(floor(close) as bigint) + trade_count) % 50 as double) / 100.0 as p from bars)",
    "m as (" + _barrier_sql("trend", 1.25, 1.0, 4, "'trend_up', 'trend_down'") + " union all " + _barrier_sql("high_vol", 1.25, 1.0, 6, "'high_vol'") + ")",
    "n as (select *, ret * case when p >= 0.5 then 1 else -1 end - 0.0006 as net, greatest(p, 1 - p) as conf from m)",
) + " select base_regime, symbol, count(*) as rows, count(*) filter (net > 0) as good, " + out("100.0 * count(*) filter (net > 0) / count(*) as good_pct", "avg(conf) as mean_confidence", "avg(net) as mean_net", "stddev_samp(net) as std_net") + " from n group by grouping sets ((), (base_regime), (symbol))"


def pending_payments(spark, d):
    return ledger.pending_payments(T.payments(spark, d), "stars").select("payment_id", "amount_usd", "created_at")


PENDING_SQL = with_(PAYMENTS) + " select payment_id, amount_usd, created_at from payments where status = 'pending' and method = 'stars'"


def users_by_role(spark, d):
    return ledger.users_by_role(T.users(spark, d), "premium")


ROLE_SQL = with_(USERS) + " select * from users where role = 'premium' and not banned"


def created_per_day(spark, d):
    return ledger.created_per_day(T.signals(spark, d))


CREATED_SQL = with_(SIGNALS) + " select cast(make_timestamp(created_at * 1000) as date) as date, count(*) as signals from signals group by 1"


def newest_of_all(spark, d):
    s = T.signals(spark, d)
    parts = {f"ledger_{x}": s.where(F.col("timeframe") == x) for x in ("15m", "1h", "4h")}
    return ledger.newest_of_all(parts, 25, 5).select("source", "id", "symbol", "created_at")


NEWEST_SQL = with_(SIGNALS) + " select 'ledger_' || timeframe as source, id, symbol, created_at from signals where timeframe is not null order by created_at desc, id desc limit 25 offset 5"


def best_runs(spark, d):
    runs = T.table(spark, d, "customer").select(F.col("c_custkey").alias("run_id"), F.col("c_acctbal").alias("sharpe_ratio"))
    return ledger.best_runs(runs, "sharpe_ratio", 5)


BEST_SQL = "select c_custkey as run_id, c_acctbal as sharpe_ratio from customer order by c_acctbal desc, c_custkey limit 5"


def daily_stats(spark, d):
    return ledger.daily_stats(T.signals(spark, d)).select("timeframe", "date", "trades", "wins", F.round("pnl_pct", 6).alias("pnl_pct"))


DAYSTATS_SQL = with_(SIGNALS) + f" select coalesce(timeframe, '4h') as timeframe, cast(make_timestamp(closed_at * 1000) as date) as date, count(*) as trades, count(*) filter (result = 'win') as wins, round(sum(pnl_pct), 6) + 0.0 as pnl_pct from signals where result in {CLOSED} group by 1, 2"

QUERIES = {
    "fixed_horizon": (fixed_horizon, FIXED_SQL),
    "triple_barrier": (triple_barrier, BARRIER_SQL),
    "triple_barrier_hl": (triple_barrier_hl, BARRIER_HL_SQL),
    "label_statistics": (label_statistics, LABEL_STATS_SQL),
    "uniqueness_weights": (uniqueness_weights, WEIGHTS_SQL),
    "weight_summary": (weight_summary, WEIGHT_SUMMARY_SQL),
    "temporal_split": (temporal_split, SPLIT_SQL),
    "default_cut": (default_cut, CUT_SQL),
    "purged_folds": (purged_folds, FOLDS_SQL),
    "walk_forward_windows": (walk_forward, WALK_SQL),
    "barrier_grid": (grid_balance, GRID_SQL),
    "window_performance": (window_performance, PERF_SQL),
    "meta_labels": (meta_labels, META_SQL),
    "threshold_table": (threshold_table, THRESHOLD_SQL),
    "suggested_threshold": (suggested_threshold, SUGGEST_SQL),
    "signal_performance": (performance, PERFORMANCE_SQL),
    "performance_cube": (performance_cube, CUBE_SQL),
    "daily_equity": (daily_equity, EQUITY_SQL),
    "monthly_pnl": (monthly_pnl, MONTHLY_SQL),
    "daily_stats": (daily_stats, DAYSTATS_SQL),
    "ledger_stats": (ledger_stats, LEDGER_SQL),
    "merged_stats": (merged_stats, MERGED_SQL),
    "trading_stats": (trading_stats, TRADING_SQL),
    "all_time_stats": (all_time_stats, ALL_TIME_SQL),
    "revenue": (revenue, REVENUE_SQL),
    "ledger_snapshot": (snapshot, SNAPSHOT_SQL),
    "newest_signals": (newest_page, PAGE_SQL),
    "first_touch": (first_touch, TOUCH_SQL),
    "table_backtest": (table_backtest, TRADES_SQL),
    "walk_forward_backtest": (walk_forward_backtest, WALK_BACKTEST_SQL),
    "walk_forward_gate": (walk_forward_gate, WALK_GATE_SQL),
    "position_diff": (position_diff, DIFF_SQL),
    "largest_gaps": (gap_list, GAPS_SQL),
    "quality_report": (quality_report, REPORT_SQL),
    "bar_continuity": (continuity, CONTINUITY_SQL),
    "day_completeness": (completeness, COMPLETE_SQL),
    "anomaly_counts": (anomaly_counts, ANOMALY_SQL),
    "ledger_freshness": (freshness, FRESH_SQL),
    "resample_parity": (parity, PARITY_SQL),
    "leak_audit": (leak_audit, LEAK_SQL),
    "cost_table": (cost_table, COST_SQL),
    "risk_chain": (risk_chain, RISK_SQL),
    "account_fold": (account_fold, ACCOUNT_SQL),
    "breaker_episodes": (breaker_episodes, EPISODE_SQL),
    "ledger_upsert": (ledger_upsert, UPSERT_SQL),
    "clock_drift": (clock_drift, DRIFT_SQL),
    "bot_metrics": (bot_metrics, BOT_SQL),
    "open_signals_page": (open_signals_page, OPEN_PAGE_SQL),
    "walk_forward_ml": (walk_forward_ml, WALK_ML_SQL),
    "selection_data": (selection_data, SELECTION_SQL),
    "buy_and_hold": (buy_and_hold, HOLD_SQL),
    "deflated_sharpe": (deflated_sharpe, DSR_SQL),
    "overfitting_probability": (overfitting, PBO_SQL),
    "win_rate_t": (win_rate_t, WIN_T_SQL),
    "symbol_counts": (symbols, SYMBOL_SQL),
    "mean_funding": (mean_funding, FUND_MEAN_SQL),
    "meta_dataset": (meta_dataset, META_SUMMARY_SQL),
    "pending_payments": (pending_payments, PENDING_SQL),
    "users_by_role": (users_by_role, ROLE_SQL),
    "signals_per_day": (created_per_day, CREATED_SQL),
    "newest_of_all_ledgers": (newest_of_all, NEWEST_SQL),
    "best_runs": (best_runs, BEST_SQL),
    "dataset_1h": (dataset_1h, DATASET_1H_SQL),
    "dataset_daily_rows": (dataset_daily_rows, DATASET_DAILY_SQL),
    "dataset_daily": (dataset_4h, None),
    "dataset_15m": (dataset_15m, None),
    "random_entries": (random_entries, None),
    "stride_sample": (stride_sample, STRIDE_SQL),
    "range_scan": (range_scan, SCAN_SQL),
}
