"""Queries of bars and features, each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.scalar import rounded
from tapeloom.operators import bars as B
from tapeloom.operators import derivs, micro, mtf, regime, session
from tapeloom.plans import tapes as T
from tapeloom.plans.tapes import DAILY, FUNDING, METRICS, TRADES, bars_sql, div, out, with_

KEY = ["symbol", "open_time"]
W = "window w as (partition by symbol order by open_time)"


def _roll(expr: str, n: int) -> str:
    return f"{expr} over (partition by symbol order by open_time rows between {n - 1} preceding and current row)"


def _z(x: str, n: int, least: int | None = None) -> str:
    m, s, k = _roll(f"avg({x})", n), _roll(f"stddev_samp({x})", n), "row_number() over w"
    return f"coalesce(case when {k} >= {least or n} and {s} > 0 then ({x} - {m}) / {s} end, 0.0)"


def _full(x: str, n: int) -> str:
    return f"case when row_number() over w >= {n} then {x} end"


def _picked(df, *names):
    return rounded(df.select(*KEY, *names))


def _picked8(df, *names):
    return rounded(df.select(*KEY, *names), 8)


def bars_15m(spark, d):
    return rounded(T.bars(spark, d, "15m"))


BARS_15M = with_(TRADES, bars_sql()) + " select symbol, open_time, " + out(*(f"{c} as {c}" for c in ("open", "high", "low", "close", "volume", "taker_buy_volume", "quote_volume"))) + ", trade_count from bars"


def resample_1h(spark, d):
    return rounded(B.resample(T.bars(spark, d, "15m"), "1h"))


RESAMPLE_1H = with_(TRADES, bars_sql("1h")) + " select symbol, open_time, " + out(*(f"{c} as {c}" for c in ("open", "high", "low", "close", "volume", "taker_buy_volume"))) + ", cast(trade_count as bigint) as trade_count from bars"

_FLOW = ("cvd", "cvd_rolling_24", "cvd_rolling_96", "cvd_slope_3", "cvd_slope_6", "cvd_slope_12", "taker_buy_ratio")


def flow(spark, d):
    return _picked(micro.flow_features(T.bars(spark, d)), *_FLOW)


FLOW_SQL = with_(TRADES, bars_sql(), "c as (select *, 2 * taker_buy_volume - volume as cvd from bars)") + " select symbol, open_time, " + out("cvd as cvd", *(f"{_roll('sum(cvd)', n)} as cvd_rolling_{n}" for n in (24, 96)), *(f"coalesce((cvd - lag(cvd, {n}) over w) / {n}.0, 0.0) as cvd_slope_{n}" for n in (3, 6, 12)), f"{div('taker_buy_volume', 'volume')} as taker_buy_ratio") + f" from c {W}"

_VOLUME = ("volume_sma_20", "volume_ratio", "volume_zscore", "large_volume", "vwap_4h", "price_to_vwap")


def volume(spark, d):
    return _picked(micro.volume_features(T.bars(spark, d)), *_VOLUME)


VOLUME_SQL = with_(
    TRADES,
    bars_sql(),
    f"a as (select *, coalesce({_full(_roll('avg(volume)', 20), 20)}, 0.0) as sma, {_z('volume', 50)} as z, {_full(_roll('sum((high + low + close) / 3.0 * volume)', 6), 6)} as pv, {_full(_roll('sum(volume)', 6), 6)} as v6 from bars {W})",
    f"b as (select *, {div('volume', 'sma')} as ratio, {div('pv', 'v6')} as vwap from a)",
) + " select symbol, open_time, " + out("sma as volume_sma_20", "ratio as volume_ratio", "z as volume_zscore", "vwap as vwap_4h", f"{div('close', 'vwap', '1.0')} - 1.0 as price_to_vwap") + ", cast(ratio > 2.0 as int) as large_volume from b"

_PRICE = ("returns_1", "returns_3", "returns_6", "returns_12", "returns_24", "body_ratio", "upper_wick", "lower_wick", "gap")


def price(spark, d):
    return _picked(micro.price_features(T.bars(spark, d)), *_PRICE)


PRICE_SQL = with_(TRADES, bars_sql()) + " select symbol, open_time, " + out(*(f"coalesce(ln(close) - ln(lag(close, {n}) over w), 0.0) as returns_{n}" for n in (1, 3, 6, 12, 24)), f"{div('abs(close - open)', 'high - low')} as body_ratio", f"{div('high - greatest(open, close)', 'high - low')} as upper_wick", f"{div('least(open, close) - low', 'high - low')} as lower_wick", f"{div('open - lag(close) over w', 'lag(close) over w')} as gap") + f" from bars {W}"


def flow_derived(spark, d):
    x = micro.flow_derived(micro.price_features(micro.volume_features(micro.flow_features(T.bars(spark, d)))))
    return _picked(x, "cvd_slope_3bar", "cvd_slope_6bar", "cvd_divergence")


FLOW_DERIVED_SQL = with_(
    TRADES,
    bars_sql(),
    f"a as (select *, 2 * taker_buy_volume - volume as cvd, coalesce({_full(_roll('avg(volume)', 20), 20)}, 0.0) as sma, coalesce(ln(close) - ln(lag(close) over w), 0.0) as r from bars {W})",
    f"b as (select *, {div('cvd - lag(cvd, 3) over w', 'sma')} as s3, {div('cvd - lag(cvd, 6) over w', 'sma')} as s6 from a {W})",
) + " select symbol, open_time, " + out("s3 as cvd_slope_3bar", "s6 as cvd_slope_6bar") + ", case when r > 0 and s3 < 0 then 1 when not r > 0 and s3 > 0 then -1 else 0 end as cvd_divergence from b"


def volume_session(spark, d):
    return _picked(micro.volume_session_features(T.bars(spark, d)), "volume_vs_session_avg", "volume_momentum_3bar")


VOLUME_SESSION_SQL = with_(
    TRADES,
    bars_sql(),
    "a as (select *, avg(volume) over (partition by symbol, open_time // 3600000 % 24 order by open_time rows between 20 preceding and 1 preceding) as same, avg(volume) over (partition by symbol order by open_time rows between 3 preceding and 1 preceding) as prior from bars)",
) + " select symbol, open_time, " + out(f"{div('volume', 'same', '1.0')} as volume_vs_session_avg", f"{div('volume', 'prior', '1.0')} as volume_momentum_3bar") + " from a"


def efficiency(spark, d):
    return _picked(micro.efficiency_features(T.bars(spark, d)), "efficiency_ratio_10", "efficiency_ratio_20")


EFFICIENCY_SQL = with_(TRADES, bars_sql(), f"a as (select *, abs(close - lag(close) over w) as mv, row_number() over w as k from bars {W})") + " select symbol, open_time, " + out(*(f"case when k > {n} then least(greatest({div(f'abs(close - lag(close, {n}) over w)', _roll('sum(mv)', n))}, 0.0), 1.0) else 0.0 end as efficiency_ratio_{n}" for n in (10, 20))) + f" from a {W}"


def candles(spark, d):
    return _picked(micro.candle_features(T.bars(spark, d)), "candle_range", "candle_body", "candle_body_pct", "upper_wick_pct", "lower_wick_pct", "candle_direction")


CANDLES_SQL = with_(TRADES, bars_sql()) + " select symbol, open_time, " + out("high - low as candle_range", "abs(close - open) as candle_body", f"{div('abs(close - open)', 'high - low')} as candle_body_pct", f"{div('high - greatest(open, close)', 'high - low')} as upper_wick_pct", f"{div('least(open, close) - low', 'high - low')} as lower_wick_pct") + ", cast(sign(close - open) as int) as candle_direction from bars"

# exponential means by the plain recurrence, bar after bar
_EMA = """n as (select *, row_number() over (partition by symbol order by open_time) as k from bars),
e as (select symbol, open_time, k, close, close as n9, 1.0::double as d9, close as n21, 1.0::double as d21, close as e20 from n where k = 1
  union all select n.symbol, n.open_time, n.k, n.close, 0.8 * e.n9 + n.close, 0.8 * e.d9 + 1, (1 - 2 / 22.0::double) * e.n21 + n.close, (1 - 2 / 22.0::double) * e.d21 + 1,
    (1 - 2 / 21.0::double) * e.e20 + 2 / 21.0::double * n.close from e join n on n.symbol = e.symbol and n.k = e.k + 1)"""


def ema(spark, d):
    return _picked(micro.ema_features(T.daily(spark, d)), "ema9", "ema21", "ema9_slope_normalized", "ema21_slope_normalized", "ema9_cross_ema21", "ema9_cross_ema21_change")


EMA_SQL = with_(
    DAILY,
    _EMA,
    "f as (select *, n9 / d9 as a, n21 / d21 as b, greatest(close * 0.01, 1e-10) as u from e)",
    f"g as (select *, coalesce((a - lag(a, 3) over w) / u, 0.0) as sa, coalesce((b - lag(b, 3) over w) / u, 0.0) as sb, (a - b) / u as c from f {W})",
    recursive=True,
) + " select symbol, open_time, " + out("a as ema9", "b as ema21", "sa as ema9_slope_normalized", "sb as ema21_slope_normalized", "c as ema9_cross_ema21", "coalesce(c - lag(c) over w, 0.0) as ema9_cross_ema21_change") + f" from g {W}"


def ema_unadjusted(spark, d):
    from tapeloom.operators.series import ewm

    return _picked(ewm(T.daily(spark, d), "close", 2.0 / 21.0, "ema20"), "ema20")


EMA20_SQL = with_(DAILY, _EMA, recursive=True) + " select symbol, open_time, " + out("e20 as ema20") + " from e"

_FUND = ("funding_rate", "funding_abs", "funding_zscore_7d", "funding_zscore_30d", "funding_extreme", "funding_positive", "funding_cum_24h", "basis_approx", "basis_extreme", "funding_rate_change_1", "funding_rate_change_3", "funding_rate_zscore_rolling", "funding_rate_acceleration")


def funding_chain(spark, d):
    x = derivs.funding_features(T.daily(spark, d), T.funding(spark, d), 1440)
    return _picked(derivs.funding_momentum(derivs.basis_features(x)), *_FUND)


FUNDING_SQL = with_(
    DAILY,
    FUNDING,
    "j as (select b.*, coalesce(f.fundingRate, 0.0) as fr from bars b asof left join funding f on b.symbol = f.symbol and b.open_time >= f.fundingTime)",
    f"k as (select *, {_z('fr', 7)} as z7, {_z('fr', 30)} as z30, {_z('fr', 72, 10)} as z72, coalesce({_full(_roll('sum(fr)', 1), 1)}, 0.0) as cum, coalesce(fr - lag(fr) over w, 0.0) as c1, coalesce(fr - lag(fr, 3) over w, 0.0) as c3 from j {W})",
) + " select symbol, open_time, " + out("fr as funding_rate", "abs(fr) as funding_abs", "z7 as funding_zscore_7d", "z30 as funding_zscore_30d", "cum as funding_cum_24h", "cum as basis_approx", "c1 as funding_rate_change_1", "c3 as funding_rate_change_3", "z72 as funding_rate_zscore_rolling", "coalesce(c1 - lag(c1) over w, 0.0) as funding_rate_acceleration") + f", cast(abs(z7) > 2 as int) as funding_extreme, cast(fr > 0 as int) as funding_positive, cast(abs(cum) > 0.001 as int) as basis_extreme from k {W}"

_OI = ("oi_value", "oi_delta_4h", "oi_delta_12h", "oi_zscore", "ls_ratio_zscore", "oi_quadrant", "ls_ratio", "taker_vol_ratio", "oi_delta_1h", "oi_accel_vec", "oi_price_div_vec")


def oi_chain(spark, d):
    x = derivs.oi_features(micro.price_features(T.daily(spark, d)), T.metrics(spark, d), 1440)
    return _picked(derivs.oi_derived(x), *_OI)


OI_SQL = with_(
    DAILY,
    METRICS,
    "j as (select b.*, coalesce(m.sum_open_interest_value, 0.0) as oi, coalesce(m.count_long_short_ratio, 0.0) as ls, coalesce(m.sum_taker_long_short_vol_ratio, 0.0) as tv from bars b asof left join metrics m on b.symbol = m.symbol and b.open_time >= m.create_time)",
    f"k as (select *, {div('oi - lag(oi) over w', 'lag(oi) over w')} as d1, {_z('oi', 30)} as z, {_z('ls', 30)} as lz, close >= lag(close) over w as up, coalesce(ln(close) - ln(lag(close) over w), 0.0) as r from j {W})",
) + " select symbol, open_time, " + out("oi as oi_value", "d1 as oi_delta_4h", "d1 as oi_delta_12h", "z as oi_zscore", "lz as ls_ratio_zscore", "ls as ls_ratio", "tv as taker_vol_ratio", "d1 as oi_delta_1h", "coalesce(d1 - lag(d1) over w, 0.0) as oi_accel_vec") + f", case when up and d1 >= 0 then 1 when up and d1 < 0 then 2 when not up and d1 >= 0 then -1 else -2 end as oi_quadrant, case when r > 0 and d1 < 0 then 1 when not r > 0 and d1 < 0 then -1 else 0 end as oi_price_div_vec from k {W}"


def oi_velocity(spark, d):
    x = derivs.oi_velocity(derivs.oi_features(T.daily(spark, d), T.metrics(spark, d), 1440), 24)
    return rounded(x.select(*KEY, "oi_velocity", "oi_acceleration", "oi_price_divergence", "oi_exhaustion", "oi_velocity_zscore"), 4)


_CHANGE = "case when lag({0}) over w > 0 then ({0} - lag({0}) over w) / lag({0}) over w when lag({0}) over w is not null then 0.0 end"
OI_VELOCITY_SQL = with_(
    DAILY,
    METRICS,
    "j as (select b.*, coalesce(m.sum_open_interest_value, 0.0) as oi from bars b asof left join metrics m on b.symbol = m.symbol and b.open_time >= m.create_time)",
    f"k as (select *, {_CHANGE.format('oi')} as v, {_CHANGE.format('close')} as r, row_number() over w as n from j {W})",
    "l as (select *, lag(v) over w as pv, corr(r, v) over here as c, avg(v) over prior as m, stddev_pop(v) over prior as sd, count(v) over prior as k, count(case when v > 0 then 1 end) over prior as up from k"
    " window w as (partition by symbol order by open_time), here as (partition by symbol order by open_time rows between 22 preceding and current row), prior as (partition by symbol order by open_time rows between 22 preceding and 1 preceding))",
) + " select symbol, open_time, " + out("case when n >= 3 then v else 0.0 end as oi_velocity", "case when n >= 3 then v - pv else 0.0 end as oi_acceleration", "case when n >= 3 and not isnan(c) then greatest(least(c, 1.0), -1.0) else 0.0 end as oi_price_divergence", "case when n >= 3 and sd > 0 then (v - m) / sd else 0.0 end as oi_velocity_zscore", digits=4) + ", cast(coalesce(n >= 5 and up >= greatest(2, floor(k * 0.6)) and v < 0, false) as int) as oi_exhaustion from l"


_CLOCK = ("trading_session", "session_hour_sin", "session_hour_cos", "is_overlap", "is_dead_zone", "hours_to_session_end", "hours_to_funding_mark", "pre_funding_window", "post_funding_window", "funding_window_urgency", "day_of_week_sin", "day_of_week_cos", "is_weekend", "is_monday_asia_window", "is_high_vol_day")


def clock(spark, d):
    return _picked(session.weekday_features(session.funding_clock(session.session_features(T.bars(spark, d)))), *_CLOCK)


CLOCK_SQL = with_(
    TRADES,
    bars_sql(),
    "t as (select symbol, open_time, hour(make_timestamp(open_time * 1000)) as h, minute(make_timestamp(open_time * 1000)) as m, isodow(make_timestamp(open_time * 1000)) as dow from bars)",
    "u as (select *, h + m / 60.0::double as f from t)",
    "v as (select *, least(8.0, (1 - f + 24) % 24, (9 - f + 24) % 24, (17 - f + 24) % 24) as ahead, least(8.0, (f - 1 + 24) % 24, (f - 9 + 24) % 24, (f - 17 + 24) % 24) as since from u)",
) + f" select symbol, open_time, {list(session.SESSION_OF_HOUR)}[h + 1] as trading_session, h between 14 and 16 as is_overlap, h >= 22 or h <= 4 as is_dead_zone, ahead <= 2 as pre_funding_window, since <= 1 as post_funding_window, dow >= 6 as is_weekend, (dow = 7 and h >= 20) or (dow = 1 and h < 8) as is_monday_asia_window, dow in (3, 4) as is_high_vol_day, " + out("sin(h / 24.0 * 2 * pi()) as session_hour_sin", "cos(h / 24.0 * 2 * pi()) as session_hour_cos", f"{list(map(float, session.HOURS_TO_END))}[h + 1]::double as hours_to_session_end", "ahead as hours_to_funding_mark", "case when ahead <= 1 then 1.0 when ahead <= 2 then 0.5 else 0.0 end::double as funding_window_urgency", "sin((dow - 1) / 7.0 * 2 * pi()) as day_of_week_sin", "cos((dow - 1) / 7.0 * 2 * pi()) as day_of_week_cos") + " from v"

_DAYW = "over (partition by symbol, open_time // 86400000 order by open_time)"
_VWAP_CTE = f"v as (select *, {div(f'sum((high + low + close) / 3.0 * volume) {_DAYW}', f'sum(volume) {_DAYW}')} as vw, coalesce(stddev_samp(close) {_DAYW}, 0.0) as sd, sum(volume) {_DAYW} as today, coalesce({_full(_roll('avg(volume)', 720), 720)}, volume) as mv from bars {W})"


def session_vwap(spark, d):
    return _picked8(session.session_vwap(T.bars(spark, d)), "session_vwap", "session_vwap_std", "price_vs_session_vwap", "vwap_upper_band", "vwap_lower_band", "vwap_band_position", "session_cumulative_volume_ratio")


SESSION_VWAP_SQL = with_(TRADES, bars_sql(), _VWAP_CTE) + " select symbol, open_time, " + out("vw as session_vwap", "sd as session_vwap_std", f"{div('close - vw', 'vw')} as price_vs_session_vwap", "vw + sd as vwap_upper_band", "vw - sd as vwap_lower_band", "case when sd > 0 then least(greatest((close - vw) / sd, -4.0), 4.0) else 0.0 end as vwap_band_position", f"{div('today', 'mv * 24.0')} as session_cumulative_volume_ratio", digits=8) + " from v"


def weekly_vwap(spark, d):
    return _picked(session.weekly_vwap(T.bars(spark, d, "1h")), "avwap_weekly", "price_vs_avwap_weekly", "avwap_weekly_slope", "price_above_avwap")


_WEEK = "over (partition by symbol, isoyear(make_timestamp(open_time * 1000)), weekofyear(make_timestamp(open_time * 1000)) order by open_time)"
WEEKLY_VWAP_SQL = with_(TRADES, bars_sql("1h"), f"v as (select *, {div(f'sum((high + low + close) / 3.0 * volume) {_WEEK}', f'sum(volume) {_WEEK}')} as vw from bars)") + " select symbol, open_time, " + out("vw as avwap_weekly", f"{div('close - vw', 'vw')} as price_vs_avwap_weekly", f"{div('vw - lag(vw, 5) over w', 'lag(vw, 5) over w')} as avwap_weekly_slope") + f", close > vw as price_above_avwap from v {W}"


def session_momentum(spark, d):
    return _picked(session.session_momentum(session.session_vwap(T.bars(spark, d))), "session_open_return", "session_return_cumulative", "session_momentum_3bar", "vwap_slope_3bar", "vwap_slope_6bar", "price_above_vwap")


_BLOCK = "over (partition by symbol, open_time // 86400000, case when open_time // 3600000 % 24 < 8 then 0 when open_time // 3600000 % 24 < 13 then 1 else 2 end order by open_time)"
SESSION_MOMENTUM_SQL = with_(
    TRADES,
    bars_sql(),
    _VWAP_CTE,
    f"r as (select *, {div('close - lag(close) over w', 'lag(close) over w')} as ret, row_number() over w as k from v {W})",
) + " select symbol, open_time, " + out(f"first_value(ret) {_BLOCK} as session_open_return", f"{div(f'close - first_value(close) {_BLOCK}', f'first_value(close) {_BLOCK}')} as session_return_cumulative", f"case when k >= 3 then {_roll('sum(ret)', 3)} else 0.0 end as session_momentum_3bar", *(f"{div(f'vw - lag(vw, {n}) over w', f'lag(vw, {n}) over w')} as vwap_slope_{n}bar" for n in (3, 6))) + f", close > vw as price_above_vwap from r {W}"

_ORB = [f"orb_{s}_{n}" for n in session.SESSIONS for s in ("high", "low", "range")] + [f"orb_range_{n}_atr_pct" for n in session.SESSIONS]


def opening_ranges(spark, d):
    return _picked(session.opening_ranges(T.bars(spark, d)), *_ORB, "price_vs_current_orb", "dist_to_orb_high_pct", "dist_to_orb_low_pct", "orb_breakout_bull", "orb_breakout_bear", "bars_since_session_open", "is_session_trap_zone", "current_session")


def _orb_sql() -> str:
    raw = ", ".join(f"case when h >= {start} then {f}(case when h = {start} then {s} end) over (partition by symbol, open_time // 86400000 order by open_time) end as r_{s}_{n}" for n, start in session.SESSIONS.items() for s, f in (("high", "max"), ("low", "min")))
    fill = ", ".join(f"coalesce(last_value(r_{s}_{n} ignore nulls) over w, 0.0) as orb_{s}_{n}" for n in session.SESSIONS for s in ("high", "low"))
    pick = lambda s: f"case current_session when 2 then orb_{s}_london when 3 then orb_{s}_ny else orb_{s}_asia end as {s}_now"
    return with_(
        TRADES,
        bars_sql(),
        f"a as (select *, open_time // 3600000 % 24 as h, coalesce({_full(_roll('avg(volume)', 20), 20)}, 0.0) as av, coalesce({_full(_roll('avg(high - low)', 14), 14)}, 0.0) as height from bars {W})",
        f"b as (select *, {raw} from a)",
        f"c as (select *, {fill}, case when h < 5 then 0 when h < 8 then 1 when h < 13 then 2 when h < 22 then 3 else 0 end as current_session from b {W})",
        f"e as (select *, {pick('high')}, {pick('low')}, least(greatest((h - case current_session when 2 then 8 when 3 then 13 else 0 end) * 4, 0), 200) as since, case current_session when 1 then 32 when 3 then 36 else 20 end as len from c)",
    ) + " select symbol, open_time, " + out(*(f"orb_{s}_{n} as orb_{s}_{n}" for n in session.SESSIONS for s in ("high", "low")), *(f"orb_high_{n} - orb_low_{n} as orb_range_{n}" for n in session.SESSIONS), *(f"{div(f'orb_high_{n} - orb_low_{n}', 'height')} as orb_range_{n}_atr_pct" for n in session.SESSIONS), f"{div('high_now - close', 'close')} as dist_to_orb_high_pct", f"{div('close - low_now', 'close')} as dist_to_orb_low_pct") + ", case when close > high_now then 1 when close < low_now then -1 else 0 end as price_vs_current_orb, close > high_now and volume >= av * 1.3 as orb_breakout_bull, close < low_now and volume >= av * 1.3 as orb_breakout_bear, cast(since as int) as bars_since_session_open, since <= 2 or len - since <= 2 as is_session_trap_zone, current_session from e"


def mtf_1h(spark, d):
    x = mtf.for_1h(T.bars(spark, d, "1h"), T.bars(spark, d, "4h"))
    return _picked(x, "htf_4h_trend_dir", "price_vs_4h_ema20", "mtf_1h_4h_aligned", "mtf_alignment_score")


_DIR = "case when close > lag(close, {0}) over w then 1 when close < lag(close, {0}) over w then -1 else 0 end"
MTF_1H_SQL = with_(
    TRADES,
    bars_sql("1h", "b1"),
    bars_sql("4h", "bars"),
    _EMA,
    f"x as (select symbol, open_time + 14400000 as t, e20, {_DIR.format(3)} as dir from e {W})",
    f"o as (select *, {_DIR.format(3)} as own from b1 {W})",
    "j as (select o.*, x.dir, x.e20 from o asof left join x on o.symbol = x.symbol and o.open_time >= x.t)",
    recursive=True,
) + " select symbol, open_time, " + out(f"{div('close - e20', 'e20')} as price_vs_4h_ema20") + ", dir as htf_4h_trend_dir, coalesce(own = dir and own <> 0, false) as mtf_1h_4h_aligned, cast(abs(own) + abs(dir) as int) as mtf_alignment_score from j"


def mtf_15m(spark, d):
    x = mtf.for_15m(T.bars(spark, d, "15m"), session.session_vwap(T.bars(spark, d, "1h")), T.bars(spark, d, "4h"))
    return _picked(x, "htf_1h_trend_dir", "htf_4h_trend_dir", "htf_1h_vwap_position", "mtf_3tf_alignment", "htf_conflict", "htf_both_strong_trend")


MTF_15M_SQL = with_(
    TRADES,
    bars_sql("15m", "b15"),
    bars_sql("4h", "b4"),
    bars_sql("1h", "bars"),
    _VWAP_CTE,
    f"x1 as (select symbol, open_time + 3600000 as t, vw, {_DIR.format(3)} as dir from v {W})",
    f"x4 as (select symbol, open_time + 14400000 as t, {_DIR.format(3)} as dir from b4 {W})",
    f"o as (select *, {_DIR.format(4)} as own from b15 {W})",
    "j as (select o.*, x1.vw, x1.dir as d1 from o asof left join x1 on o.symbol = x1.symbol and o.open_time >= x1.t)",
    "k as (select j.*, x4.dir as d4 from j asof left join x4 on j.symbol = x4.symbol and j.open_time >= x4.t)",
) + " select symbol, open_time, " + out(f"{div('close - vw', 'vw')} as htf_1h_vwap_position") + ", d1 as htf_1h_trend_dir, d4 as htf_4h_trend_dir, case when abs(own) + abs(d1) + abs(d4) is null then null else least(abs(own) + abs(d1) + abs(d4), 3) end::int as mtf_3tf_alignment, coalesce(d1 * d4 < 0, false) as htf_conflict, false as htf_both_strong_trend from k"


def intrabar_4h(spark, d):
    return rounded(B.augment(T.bars(spark, d, "4h"), T.bars(spark, d, "15m")).select(*KEY, "cvd_sum", "cvd_slope", "realized_vol", "breakout_share"))


INTRABAR_SQL = with_(
    TRADES,
    bars_sql("15m"),
    "a as (select symbol, open_time // 14400000 * 14400000 as p, open_time, high, low, close, 2 * taker_buy_volume - volume as cvd from bars)",
    "b as (select *, sum(cvd) over q as run, row_number() over q - 1 as i, ln(close / lag(close) over q) as r, case when count(*) over q4 = 4 then high > max(high) over q4 or low < min(low) over q4 end as out_ from a window q as (partition by symbol, p order by open_time), q4 as (partition by symbol, p order by open_time rows between 4 preceding and 1 preceding))",
    "c as (select symbol, p as open_time, sum(cvd) as s, case when count(*) >= 2 then coalesce(regr_slope(run, i) / greatest(max(abs(run)), 1.0), 0.0) else 0.0 end as sl, coalesce(sqrt(sum(r * r)), 0.0) as rv, case when count(*) >= 5 then coalesce(cast(sum(out_::int) as double) / nullif(count(out_), 0), 0.0) else 0.0 end as bs from b group by 1, 2)",
) + " select symbol, open_time, " + out("s as cvd_sum", "sl as cvd_slope", "rv as realized_vol", "bs as breakout_share") + " from c"


def basis(spark, d):
    perp = derivs.funding_features(T.daily(spark, d), T.funding(spark, d), 1440)
    spot = T.daily(spark, d).withColumn("close", F.col("open"))
    return rounded(derivs.annualised_basis(perp, spot, 30).select(*KEY, "basis_bps", "basis_annualized", "basis_zscore_30d", "basis_extreme_sign"), 4)


BASIS_SQL = with_(
    DAILY,
    FUNDING,
    "j as (select b.*, coalesce(f.fundingRate, 0.0) as fr from bars b asof left join funding f on b.symbol = f.symbol and b.open_time >= f.fundingTime)",
    "k as (select *, case when open > 0 and close > 0 then (close - open) / open * 10000.0 end as bp, fr * 3 * 365.0 * 100.0 as ya from j)",
    "l as (select *, avg(bp) over p as m, stddev_pop(bp) over p as sd from k window p as (partition by symbol order by open_time rows between 30 preceding and 1 preceding))",
) + " select symbol, open_time, " + out("bp as basis_bps", "ya as basis_annualized", "case when sd > 0 then (bp - m) / sd else 0.0 end as basis_zscore_30d", digits=4) + ", case when ya > 30 then -1 when ya < -10 then 1 else 0 end as basis_extreme_sign from l"


def sentiment(spark, d):
    x = derivs.oi_features(T.daily(spark, d), T.metrics(spark, d), 1440)
    x = x.select(*KEY, (F.col("trade_count") % 101).alias("fear_greed"), F.col("ls_ratio").alias("long_short_ratio"), F.col("taker_vol_ratio").alias("top_trader_ls_ratio"))
    return rounded(derivs.sentiment(x).select(*KEY, "fear_greed_norm", "fear_greed_extreme", "ls_divergence", "sentiment_score"))


SENTIMENT_SQL = with_(
    DAILY,
    METRICS,
    "j as (select b.symbol, b.open_time, b.trade_count % 101 as fg, coalesce(m.count_long_short_ratio, 0.0) as ls, coalesce(m.sum_taker_long_short_vol_ratio, 0.0) as tv from bars b asof left join metrics m on b.symbol = m.symbol and b.open_time >= m.create_time)",
    "k as (select *, case when ls > 0 and tv > 0 then greatest(least(ln(tv / ls) / 1.5, 1.0), -1.0) else 0.0 end as lean, case when fg < 20 then 1 when fg > 80 then -1 else 0 end as ex from j)",
) + " select symbol, open_time, ex as fear_greed_extreme, " + out("fg / 100.0::double as fear_greed_norm", "lean as ls_divergence", "greatest(least(0.6 * (fg / 100.0::double - 0.5) * 2 + 0.4 * lean + 0.2 * ex, 1.0), -1.0) as sentiment_score") + " from k"


def liquidations(spark, d):
    orders = T.trades(spark, d).select("symbol", F.col("transact_time").alias("time"), "price", F.col("quantity").alias("qty"), F.when(F.col("is_buyer_maker"), "SELL").otherwise("BUY").alias("side"))
    rows = T.bars(spark, d, "4h").select(*KEY, "close", (F.col("high") - F.col("low")).alias("atr"))
    return rounded(derivs.liquidation_proximity(rows, orders).select(*KEY, "liq_cluster_long_pct", "liq_cluster_short_pct", "liq_imbalance", "liq_cascade_risk", "liq_volume_1h"), 4)


LIQUIDATIONS_SQL = with_(
    TRADES,
    bars_sql("4h"),
    "r as (select symbol, open_time, close as p, case when (high - low) * 0.1 > 0 then (high - low) * 0.1 else close * 0.0005 end as bin from bars)",
    "n as (select r.*, t.transact_time as t, t.price, t.price * t.quantity as n, case when t.is_buyer_maker then 'SELL' else 'BUY' end as side, max(t.transact_time) over (partition by r.symbol, r.open_time) as last from r join trades t on t.symbol = r.symbol and t.transact_time <= r.open_time and t.transact_time > r.open_time - 86400000)",
    "b as (select symbol, open_time, p, bin, side, floor(price / bin) as b, sum(n) as n, coalesce(sum(n) filter (t >= last - 3600000), 0.0) as h from n group by all)",
    "k as (select *, row_number() over (partition by symbol, open_time, side order by n desc, b) as k, ((b + 0.5) * bin - p) / p * 100 as d from b)",
    "g as (select symbol, open_time, least(coalesce(min(d) filter (side = 'SELL' and k <= 3 and d > 0), 0.0), 10.0) as lp, least(coalesce(min(-d) filter (side = 'BUY' and k <= 3 and d < 0), 0.0), 10.0) as sp, coalesce(sum(n) filter (side = 'SELL'), 0.0) as ln_, coalesce(sum(n) filter (side = 'BUY'), 0.0) as sn, sum(h) as h from k group by 1, 2)",
) + " select r.symbol, r.open_time, " + out("coalesce(lp, 0.0) as liq_cluster_long_pct", "coalesce(sp, 0.0) as liq_cluster_short_pct", "coalesce((ln_ - sn) / (ln_ + sn), 0.0) as liq_imbalance", "case when ln_ + sn > 0 then least(h / (ln_ + sn), 1.0) else 0.0 end as liq_cascade_risk", "coalesce(h, 0.0) as liq_volume_1h", digits=4) + " from r left join g on r.symbol = g.symbol and r.open_time = g.open_time"


def regimes(spark, d):
    x = regime.detect(T.daily(spark, d), lookback=120, min_bars=100, window=100)
    return rounded(x.select(*KEY, "atr", "adx", "atr_pct", "atr_percentile", "regime", "hurst", "trend_strength"))


def wilder_sql(period: int = 14) -> str:
    """Recurrences of the published averages over bars."""
    n = period
    return f"""n as (select *, row_number() over w as k, lag(close) over w as pc, high - lag(high) over w as up, lag(low) over w - low as dn from bars window w as (partition by symbol order by open_time)),
m as (select *, greatest(high - low, coalesce(abs(high - pc), 0), coalesce(abs(low - pc), 0)) as tr, case when up > dn and up > 0 then up else 0.0 end as pdm, case when dn > up and dn > 0 then dn else 0.0 end as mdm from n),
s as (select *, avg(tr) over q as tr14, avg(pdm) over q as p14, avg(mdm) over q as m14 from m window q as (partition by symbol order by open_time rows between {n - 1} preceding and current row)),
r as (select symbol, open_time, k, close, close as ema, null::double as atr, null::double as a, null::double as p, null::double as mm from s where k = 1
  union all select s.symbol, s.open_time, s.k, s.close, r.ema + 2 / {n + 1}.0::double * (s.close - r.ema),
    case when s.k < {n} then null when s.k = {n} then s.tr14 else (r.atr * {n - 1} + s.tr) / {n} end,
    case when s.k < {n + 1} then null when s.k = {n + 1} then s.tr14 else (r.a * {n - 1} + s.tr) / {n} end,
    case when s.k < {n + 1} then null when s.k = {n + 1} then s.p14 else (r.p * {n - 1} + s.pdm) / {n} end,
    case when s.k < {n + 1} then null when s.k = {n + 1} then s.m14 else (r.mm * {n - 1} + s.mdm) / {n} end
  from r join s on s.symbol = r.symbol and s.k = r.k + 1),
x as (select *, case when k >= {n + 1} then coalesce(case when pi_ + mi > 0 then abs(pi_ - mi) / (pi_ + mi) end, 0.0) * 100 end as dx from (select *, case when a > 0 then p / a else 0.0 end * 100 as pi_, case when a > 0 then mm / a else 0.0 end * 100 as mi from r) t),
y as (select *, avg(dx) over (partition by symbol order by open_time rows between {n - 1} preceding and current row) as dx14 from x),
z as (select symbol, open_time, k, null::double as adx from y where k = 1
  union all select y.symbol, y.open_time, y.k, case when y.k < {2 * n} then null when y.k = {2 * n} then y.dx14 else (z.adx * {n - 1} + y.dx) / {n} end from z join y on y.symbol = z.symbol and y.k = z.k + 1)"""


def regime_ctes(*source: str, period: int = 14, lookback: int = 120, min_bars: int = 100, vol: float = 0.8) -> tuple[str, ...]:
    """lab: each bar of the source's bars with its regime and what that is made of."""
    k = max(2, period // 3)
    return (
        *source,
        wilder_sql(period),
        f"f as (select y.symbol, y.open_time, y.k, y.close, coalesce(y.atr, 0.0) as atr, coalesce(z.adx, 0.0) as adx, case when y.k > {k} then y.ema - lag(y.ema, {k}) over (partition by y.symbol order by y.k) else coalesce(y.close - lag(y.close) over (partition by y.symbol order by y.k), 0.0) end as slope from y join z using (symbol, k, open_time))",
        f"h as (select *, list(atr) over (partition by symbol order by k rows between {lookback - 1} preceding and current row) as seen from f)",
        "g as (select *, case when len(list_filter(seen, lambda x: x > 0)) > 0 then cast(len(list_filter(seen, lambda x: x > 0 and x < atr)) as double) / len(list_filter(seen, lambda x: x > 0)) else 0.5 end as pct from h)",
        f"lab as (select symbol, open_time, k, close, atr, adx, case when k > {min_bars} then atr / close else 0.0 end as atr_pct, case when k > {min_bars} then pct else 0.5 end as atr_percentile, case when k <= {min_bars} then 'range' when pct > {vol} then 'high_vol' when adx > 20 then case when slope > 0 then 'trend_up' else 'trend_down' end else 'range' end as regime from g)",
    )


_REGIME = regime_ctes(DAILY)
_HURST = (
    "u0 as (select symbol, open_time, close, row_number() over (partition by symbol order by open_time) - 1 as k from bars)",
    "u1 as (select symbol, k, list(close) over (partition by symbol order by k rows between 99 preceding and current row) as p from u0)",
    "u2 as (select symbol, k, i, ln(p[i + 1] / p[i]) as r from u1, range(1, 100) t(i) where k >= 100 and (k - 100) % 6 = 0)",
    "u3 as (select symbol, k, l, (i - 1) // l as c, i, r, avg(r) over (partition by symbol, k, l, (i - 1) // l) as m from u2, range(2, 21) t(l) where (i - 1) // l < 99 // l)",
    "u4 as (select *, sum(r - m) over (partition by symbol, k, l, c order by i) as walk from u3)",
    "u5 as (select symbol, k, l, c, max(walk) - min(walk) as spread, stddev_samp(r) as dev from u4 group by 1, 2, 3, 4)",
    "u6 as (select symbol, k, l, avg(spread / dev) as rs from u5 where dev > 0 group by 1, 2, 3)",
    "u7 as (select symbol, k, case when count(*) >= 2 then greatest(least(regr_slope(ln(rs), ln(l)), 1.0), 0.0) else 0.5 end as h from u6 where rs > 0 group by 1, 2)",
    "hu as (select u0.symbol, u0.open_time, u0.k, coalesce(u7.h, 0.5) as hurst from u0 left join u7 on u7.symbol = u0.symbol and u7.k = u0.k - (u0.k - 100) % 6 and u0.k >= 100)",
)
REGIME_SQL = with_(*_REGIME, *_HURST, recursive=True) + " select symbol, open_time, regime, " + out("atr as atr", "adx as adx", "atr_pct as atr_pct", "atr_percentile as atr_percentile", "hurst as hurst", "case when lab.k > 100 then greatest(least(0.4 * abs(hurst - 0.5) * 2 + 0.6 * least(adx / 50, 1.0), 1.0), 0.0) else 0.0 end as trend_strength") + " from lab join hu using (symbol, open_time)"


def regime_statistics(spark, d):
    return regime.statistics(regime.detect(T.daily(spark, d), lookback=120, min_bars=100, window=100))


STATISTICS_SQL = with_(*_REGIME, *_HURST, "by_regime as (select regime, count(*) as n, avg(hurst) as h, avg(atr_pct) as a from lab join hu using (symbol, open_time) group by 1)", recursive=True) + " select v.regime, coalesce(n, 0) as bars, round(coalesce(n, 0) * 100.0 / sum(n) over (), 2) as pct, round(coalesce(h, 0.0), 4) as mean_hurst, round(coalesce(a, 0.0), 6) as mean_atr from (values ('trend_up'), ('trend_down'), ('range'), ('high_vol')) v(regime) left join by_regime using (regime)"


def regime_transitions(spark, d):
    return regime.transitions(regime.detect(T.daily(spark, d), lookback=120, min_bars=100, window=100))


TRANSITIONS_SQL = with_(*_REGIME, "steps as (select regime as to_regime, lag(regime) over (partition by symbol order by k) as from_regime from lab)", recursive=True) + " select from_regime, to_regime, count(*) as n from steps where from_regime <> to_regime group by 1, 2 order by n desc, from_regime, to_regime limit 10"


def hurst_histogram(spark, d):
    return rounded(regime.histogram(regime.hurst(T.daily(spark, d), 100, 100), "hurst"))


HISTOGRAM_SQL = with_(DAILY, *_HURST, "e as (select min(hurst) as lo, max(hurst) as hi from hu)", "x as (select least(floor((hurst - lo) * 10 / (hi - lo)), 9)::int as bin, count(*) as n from hu, e group by 1)") + " select b::int as bin, " + out("lo + (hi - lo) * b / 10 as bin_start") + ", coalesce(n, 0) as n from range(10) t(b) cross join e left join x on x.bin = b"


def vpin(spark, d):
    return rounded(micro.vpin(T.trades(spark, d), 200.0, 50), 4)


def vpin_latest(spark, d):
    return rounded(micro.vpin(T.trades(spark, d), 200.0, 20, "last"), 4)


_VPIN = (
    TRADES,
    "t as (select symbol, price, quantity as q, row_number() over w as k, coalesce(ln(price / lag(price) over w), 0.0) as r, sum(quantity) over w as upto from trades where quantity > 0 window w as (partition by symbol order by transact_time))",
    "s as (select symbol, stddev_pop(r) as sg from t group by 1)",
    "x as (select t.*, sg, unnest(range(cast((upto - q) // 200 as bigint), cast((upto - 1) // 200 as bigint) + 1)) as b from t join s using (symbol))",
    "y as (select *, least(upto, (b + 1) * 200) - greatest(upto - q, b * 200) as share, abs(r / sg) / sqrt(2) as z, 1 / (1 + 0.3275911 * abs(r / sg) / sqrt(2)) as tt from x)",
    "p as (select *, (1 - tt * (0.254829592 + tt * (-0.284496736 + tt * (1.421413741 + tt * (-1.453152027 + tt * 1.061405429)))) * exp(-z * z)) * case when r < 0 then -1 else 1 end as erf from y)",
    "g as (select symbol, b, abs(sum(share * erf)) as gap, sum(share) as filled from p group by 1, 2)",
)
VPIN_SQL = with_(*_VPIN) + " select symbol, count(*) as buckets, round(sum(gap) / (count(*) * 200.0), 4) + 0.0 as vpin from g where filled >= 200 and b < 50 group by symbol"
VPIN_LATEST_SQL = with_(*_VPIN, "full_ as (select *, row_number() over (partition by symbol order by b desc) as n from g where filled >= 200)") + " select symbol, count(*) as buckets, round(sum(gap) / (count(*) * 200.0), 4) + 0.0 as vpin from full_ where n <= 20 group by symbol"


def regime_defaults(spark, d):
    """Regimes with the look-backs of 4h bars, 540 and 300."""
    return rounded(regime.detect(T.daily(spark, d)).select(*KEY, "atr", "adx", "atr_pct", "atr_percentile", "regime"))


REGIME_DEFAULTS_SQL = with_(*regime_ctes(DAILY, lookback=540, min_bars=300), recursive=True) + " select symbol, open_time, regime, " + out("atr as atr", "adx as adx", "atr_pct as atr_pct", "atr_percentile as atr_percentile") + " from lab"



def settlement_rates(spark, d):
    t = T.trades(spark, d).select("symbol", F.col("transact_time").alias("ts"), F.col("price").alias("rate"))
    return rounded(derivs.settlements(t))


SETTLEMENTS_SQL = with_(TRADES) + " select symbol, transact_time // 3600000 * 3600000 as settled_at, round(arg_max(price, (transact_time, price)), 6) + 0.0 as rate, count(*) as ticks from trades where transact_time // 3600000 % 24 in (1, 9, 17) and transact_time // 60000 % 60 = 0 group by 1, 2"

QUERIES = {
    "bars_15m": (bars_15m, BARS_15M),
    "resample_1h": (resample_1h, RESAMPLE_1H),
    "flow_features": (flow, FLOW_SQL),
    "volume_features": (volume, VOLUME_SQL),
    "price_features": (price, PRICE_SQL),
    "flow_derived": (flow_derived, FLOW_DERIVED_SQL),
    "volume_session_features": (volume_session, VOLUME_SESSION_SQL),
    "efficiency_features": (efficiency, EFFICIENCY_SQL),
    "candle_features": (candles, CANDLES_SQL),
    "ema_features": (ema, EMA_SQL),
    "ema_unadjusted": (ema_unadjusted, EMA20_SQL),
    "funding_features": (funding_chain, FUNDING_SQL),
    "oi_features": (oi_chain, OI_SQL),
    "oi_velocity": (oi_velocity, OI_VELOCITY_SQL),
    "session_clock": (clock, CLOCK_SQL),
    "session_vwap": (session_vwap, SESSION_VWAP_SQL),
    "weekly_vwap": (weekly_vwap, WEEKLY_VWAP_SQL),
    "session_momentum": (session_momentum, SESSION_MOMENTUM_SQL),
    "basis": (basis, BASIS_SQL),
    "sentiment": (sentiment, SENTIMENT_SQL),
    "liquidations": (liquidations, LIQUIDATIONS_SQL),
    "opening_ranges": (opening_ranges, _orb_sql()),
    "mtf_1h": (mtf_1h, MTF_1H_SQL),
    "mtf_15m": (mtf_15m, MTF_15M_SQL),
    "intrabar_4h": (intrabar_4h, INTRABAR_SQL),
    "regime_labels": (regimes, REGIME_SQL),
    "regime_statistics": (regime_statistics, STATISTICS_SQL),
    "regime_transitions": (regime_transitions, TRANSITIONS_SQL),
    "hurst_histogram": (hurst_histogram, HISTOGRAM_SQL),
    "vpin": (vpin, VPIN_SQL),
    "vpin_latest": (vpin_latest, VPIN_LATEST_SQL),
    "regime_defaults": (regime_defaults, REGIME_DEFAULTS_SQL),
    "funding_settlements": (settlement_rates, SETTLEMENTS_SQL),
}
