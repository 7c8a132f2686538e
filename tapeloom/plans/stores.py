"""Queries of the store, of splits and of decisions: tables written to the shared folder and read again, and row-wise rules,
each with its SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from tapeloom.functions.lineage import scratch
from tapeloom.functions.scalar import DAY_MS, bar_open_of_close, rounded
from tapeloom.operators import backtest, labels, models, risk, validation
from tapeloom.plans import tapes as T
from tapeloom.plans.tapes import DAILY, FUNDING, TRADES, bars_sql, out, with_
from tapeloom.sources import store
from tapeloom.streaming import streams

HOUR_MS = 3_600_000
W = "window w as (partition by symbol order by open_time)"


def csv_trades(spark, d):
    """The trade tape written as exchange CSV and read back with its types."""
    path = scratch(spark, "csv")
    t = T.trades(spark, d).select(F.col("trade_id").alias("agg_trade_id"), "price", F.col("quantity").alias("qty"), F.col("trade_id").alias("first_trade_id"), F.col("trade_id").alias("last_trade_id"), "transact_time", "is_buyer_maker", "symbol")
    t.write.partitionBy("symbol").option("header", True).csv(path)
    x = store.read_csv(spark, path, "agg_trades")
    name = F.regexp_extract("_file", "symbol=([^/]+)/", 1)
    return rounded(x.where("not _bad").select(name.alias("symbol"), F.col("agg_trade_id").alias("trade_id"), "price", "quantity", "transact_time", "is_buyer_maker"))


CSV_SQL = with_(TRADES) + " select symbol, trade_id, " + out("price as price", "quantity::double as quantity") + ", transact_time, is_buyer_maker from trades"


def converted_trades(spark, d):
    """Each symbol's trades as exchange CSV, converted symbol by symbol; a second run finds nothing new."""
    raw, root = scratch(spark, "raw"), scratch(spark, "store")
    t = T.trades(spark, d).select(F.col("trade_id").alias("agg_trade_id"), "price", F.col("quantity").alias("qty"), F.col("trade_id").alias("first_trade_id"), F.col("trade_id").alias("last_trade_id"), "transact_time", "is_buyer_maker", "symbol")
    symbols = [r["symbol"] for r in t.select("symbol").distinct().collect()]  # a folder each
    t.repartition("symbol").write.partitionBy("symbol").option("header", True).csv(raw)
    for s in sorted(symbols):
        for _ in range(2):
            store.convert(spark, f"{raw}/symbol={s}/*.csv", root, "agg_trades", s)
    x = store.committed(spark, root, "agg_trades")
    return rounded(x.select("symbol", F.col("date").cast("string").alias("date"), F.col("agg_trade_id").alias("trade_id"), "price", "quantity", "transact_time", "is_buyer_maker"))


CONVERTED_SQL = with_(TRADES) + " select symbol, strftime(make_timestamp(transact_time * 1000), '%Y-%m-%d') as date, trade_id, " + out("price as price", "quantity::double as quantity") + ", transact_time, is_buyer_maker from trades"


def merged_sources(spark, d):
    """Bars of two sources, one row per symbol and time, the second source's where both have one."""
    b = T.daily(spark, d).select("symbol", "open_time", "close")
    other = b.where(F.pmod(F.col("open_time") / DAY_MS, F.lit(3)) == 0).withColumn("close", F.col("close") + 1)
    return rounded(store.deduplicated(b.where(F.pmod(F.col("open_time") / DAY_MS, F.lit(5)) != 0), other))


MERGED_SOURCES_SQL = with_(DAILY) + " select symbol, open_time, " + out("case when open_time // 86400000 % 3 = 0 then close + 1 else close end as close") + " from bars where open_time // 86400000 % 3 = 0 or open_time // 86400000 % 5 <> 0"


def better_bars(spark, d):
    """A symbol's own bars where they reach the end of the tape, else the other source's."""
    b = T.daily(spark, d).select("symbol", "open_time", "close")
    end = 904_608_000_000
    own = b.where((F.col("symbol").isin("RO", "NO")) | (F.col("open_time") < end - 900 * DAY_MS))
    return rounded(store.better_source(own, b.withColumn("close", -F.col("close")), end - 900 * DAY_MS, DAY_MS))


BETTER_SQL = with_(DAILY, "own as (select * from bars where symbol in ('RO', 'NO') or open_time < 826848000000)", "good as (select symbol from own group by 1 having max(open_time) >= 826675200000)") + " select symbol, open_time, " + out("close as close") + " from own where symbol in (select symbol from good) union all select symbol, open_time, " + out("-close as close") + " from bars where symbol not in (select symbol from good)"


def written_splits(spark, d):
    """Labelled rows written once for each split they belong to."""
    path = scratch(spark, "splits")
    x = labels.fixed_horizon(T.daily(spark, d), 6).select("symbol", "open_time", "target", "trade_count")
    store.write_splits(x, path, {"busy": F.col("trade_count") > 5, "up": F.col("target") == 1})
    return spark.read.parquet(path).select("symbol", "open_time", "target", "split")


SPLITS_SQL = with_(DAILY, f"a as (select *, lead(close, 6) over w as f from bars {W})", "t as (select symbol, open_time, case when f > close then 1 else -1 end as target, trade_count from a where f is not null)") + " select symbol, open_time, target, 'busy' as split from t where trade_count > 5 union all select symbol, open_time, target, 'up' from t where target = 1"


def funding_by_month(spark, d):
    """The funding table written by symbol and month."""
    path = scratch(spark, "funding")
    store.monthly_funding(T.funding(spark, d), path)
    x = spark.read.parquet(path)
    return rounded(x.groupBy("symbol", F.col("month").cast("string").alias("month")).agg(F.count("*").alias("rows"), F.sum("fundingRate").alias("total")))


MONTHS_SQL = with_(FUNDING) + " select symbol, strftime(make_timestamp(fundingTime * 1000), '%Y-%m') as month, count(*) as rows, " + out("sum(fundingRate) as total") + " from funding group by 1, 2"


def bar_events(spark, d):
    """A symbol's bars as events by the time they close."""
    b = T.daily(spark, d).withColumn("close_time", F.col("open_time") + DAY_MS - 1)
    return rounded(store.bar_events(b, "NO", 694_224_000_000, 820_454_400_000, 30.0).select("symbol", "ts_event", "close", "volume"))


EVENTS_SQL = with_(DAILY) + " select symbol, open_time + 86399999 as ts_event, " + out("close as close", "greatest(volume, 30) as volume") + " from bars where symbol = 'NO' and open_time >= 694224000000 and open_time < 820454400000"


def open_times(spark, d):
    """Trades by the hour whose last millisecond, or whose end, their time would be."""
    t = T.trades(spark, d).select("symbol", bar_open_of_close("transact_time", HOUR_MS).alias("open_time"))
    return t.groupBy("symbol", "open_time").agg(F.count("*").alias("trades"))


OPEN_TIMES_SQL = with_(TRADES) + " select symbol, ((transact_time + 1) // 3600000 - 1) * 3600000 as open_time, count(*) as trades from trades group by 1, 2"


def book_imbalance(spark, d):
    """Each order's lines as a book: odd ones bid, even ones ask."""
    li = T.table(spark, d, "lineitem")
    side = lambda odd: F.collect_list(F.when((F.col("l_linenumber") % 2 == 1) == F.lit(odd), F.struct(F.round("l_extendedprice", 2).alias("price"), F.col("l_quantity").cast("double").alias("qty"))))
    books = li.groupBy(F.col("l_orderkey").alias("ts")).agg(side(True).alias("bids"), side(False).alias("asks")).withColumn("symbol", F.lit("X"))
    return rounded(streams.book_imbalance(books, 2).select("ts", "bid_qty", "ask_qty", "imbalance"))


BOOK_SQL = "with n as (select l_orderkey as ts, l_linenumber % 2 = 1 as bid, l_quantity::double as q, row_number() over (partition by l_orderkey, l_linenumber % 2 = 1 order by case when l_linenumber % 2 = 1 then -round(l_extendedprice, 2) else round(l_extendedprice, 2) end, case when l_linenumber % 2 = 1 then -l_quantity else l_quantity end) as k from lineitem), s as (select ts, coalesce(sum(q) filter (bid and k <= 2), 0) as b, coalesce(sum(q) filter (not bid and k <= 2), 0) as a from n group by 1) select ts, " + out("b as bid_qty", "a as ask_qty", "case when a + b = 0 then 0.0 else (b - a) / (a + b) end as imbalance") + " from s"


def _labelled(spark, d):
    x = labels.fixed_horizon(T.daily(spark, d), 6)
    return x.withColumns({"regime": F.when(F.col("trade_count") % 3 == 0, "trend_up").when(F.col("trade_count") % 3 == 1, "trend_down").otherwise("range"), "guess": F.when(F.col("trade_count") % 2 == 0, 1).otherwise(-1)})


_LAB = (DAILY, f"a as (select *, lead(close, 6) over w as f from bars {W})", "lab as (select symbol, open_time, f / close - 1 as ret, case when f > close then 1 else -1 end as target, case trade_count % 3 when 0 then 'trend_up' when 1 then 'trend_down' else 'range' end as regime, case when trade_count % 2 = 0 then 1 else -1 end as guess from a where f is not null)")
CUT = 852_076_800_000  # 1997-01-01


def training_rows(spark, d):
    """Rows for fitting a trend model, with 24 bars left out before the cut."""
    return labels.training_rows(_labelled(spark, d), CUT, ["trend_up", "trend_down"], DAY_MS, 24).select("symbol", "open_time", "target", "role")


TRAINING_SQL = with_(*_LAB) + f" select symbol, open_time, target, case when open_time >= {CUT} then 'test' else 'train' end as role from lab where regime <> 'range' and (open_time >= {CUT} or open_time < {CUT - 24 * DAY_MS})"


def fit_end(spark, d):
    """Rows before the validation part, and those before its embargo, of each regime."""
    x = _labelled(spark, d)
    one = lambda r: labels.embargo_fit_end(x.where(F.col("regime") == r), CUT, 200 * DAY_MS).withColumn("regime", F.lit(r))
    return one("range").unionByName(one("trend_up"))


FIT_END_SQL = with_(*_LAB) + f" select regime, count(*) as n, greatest(count(*) filter (open_time < {CUT - 200 * DAY_MS}), count(*) // 2) as fit_end from lab where open_time < {CUT} and regime in ('range', 'trend_up') group by 1"


def sample_sizes(spark, d):
    """Whether a symbol's guesses of a month are enough to know their hit rate."""
    x = _labelled(spark, d).groupBy("symbol", F.floor(F.col("open_time") / (DAY_MS * 365)).alias("year")).agg(F.count("*").alias("n"), F.avg((F.col("guess") == F.col("target")).cast("double")).alias("p"))
    return rounded(labels.sample_size_ok(x))


SAMPLE_SQL = with_(*_LAB, "g as (select symbol, open_time // 31536000000 as year, count(*) as n, avg(case when guess = target then 1.0::double else 0.0 end) as p from lab group by 1, 2)") + " select symbol, year, n, " + out("p as p", "1.96 * sqrt(p * (1 - p) / n) as margin") + ", n >= 50 and 1.96 * sqrt(p * (1 - p) / n) <= 0.05 as sufficient from g"


def classification(spark, d):
    return backtest.classification(_labelled(spark, d), "target", "guess")


CLASS_SQL = with_(*_LAB, "k(c) as (values (1), (-1))", "m as (select c, count(*) filter (target = c and guess = c) as tp, count(*) filter (target = c) as s, count(*) filter (guess = c) as g from lab, k group by 1)", "r as (select *, tp / g as pr, tp / s as rc, 2 * (tp / g) * (tp / s) / (tp / g + tp / s) as f1 from m)") + " select round(100.0 * sum(tp) / sum(s), 2) as accuracy, round(100 * sum(pr * s) / sum(s), 2) as precision, round(100 * sum(rc * s) / sum(s), 2) as recall, round(100 * sum(f1 * s) / sum(s), 2) as f1 from r"


def ranked_cells(spark, d):
    """Barrier cells in the order of what a stand-in probability makes of them."""
    bars = T.daily(spark, d).withColumn("atr_pct", F.lit(0.01)).withColumn("p_up", 0.3 + F.pmod(F.floor("close") + F.col("trade_count"), F.lit(50)) / 100.0)
    x = labels.grid_labels(bars, [(1.0, 1.0, 6), (1.5, 1.0, 8), (1.25, 1.0, 4)], keep=["symbol", "open_time", "p_up"]).where("label <> 0")
    cells = backtest.window_performance(x, ["up", "down", "horizon"]).withColumn("win_rate", F.col("win_rate") / 100.0)
    return rounded(models.rank_grid(cells).select("up", "down", "horizon", "rows", "signals", "win_rate", "profit_factor", "score"))


def _cell(up, down, h):
    hits = ", ".join(f"case when lead(close, {k}) over w >= close * (1 + {up} * 0.01) then {k} when lead(close, {k}) over w <= close * (1 - {down} * 0.01) then -{k} end" for k in range(1, h + 1))
    return f"select {up}::double as up, {down}::double as down, {h} as horizon, p_up, ahead[abs(hit)] / close - 1 as ret from (select *, coalesce({hits}) as hit, lead(close, {h}) over w as fh, list(close) over (partition by symbol order by open_time rows between 1 following and {h} following) as ahead from b {W}) where fh is not null and hit is not null"


_CONF = "greatest(p_up, 1 - p_up) >= 0.55"
CELLS_SQL = with_(
    DAILY, "b as (select *, 0.3 + cast((cast(floor(close) as bigint) + trade_count) % 50 as double) / 100.0 as p_up from bars)",
    "c as (" + " union all ".join(f"(select * from ({_cell(*g)}))" for g in ((1.0, 1.0, 6), (1.5, 1.0, 8), (1.25, 1.0, 4))) + ")",
    "n as (select *, ret * case when p_up >= 0.5 then 1 else -1 end as net from c)",
    f"p as (select up, down, horizon, count(*) as rows, count(*) filter ({_CONF}) as signals, count(*) filter ({_CONF} and net > 0) / count(*) filter ({_CONF}) as win_rate, least(coalesce(sum(net) filter ({_CONF} and net > 0), 0) / -sum(net) filter ({_CONF} and net < 0), 999) as profit_factor from n group by 1, 2, 3)",
) + " select horizon, rows, signals, " + out("up as up", "down as down", "win_rate as win_rate", "profit_factor as profit_factor", "(win_rate - 0.5) * case when profit_factor >= 100 then 1 else profit_factor end * 10 as score") + " from p"


def _trips(spark, d):
    o = T.table(spark, d, "orders")
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    base = o.select(k.alias("order_id"), T.six("o_orderkey").alias("symbol"), F.when(k % 3 == 0, -1).otherwise(1).alias("side"), (1 + c % 5).cast("double").alias("qty"), (F.floor("o_totalprice") % 50 + 100).cast("double").alias("p"), T.millis("o_orderdate").alias("t"), F.col("o_orderstatus").alias("st"), c.alias("c"))
    opens = base.select("order_id", "symbol", "side", "qty", F.col("p").alias("price"), F.lit(0.2).alias("fee"), F.col("t").alias("ts"), F.lit(True).alias("opens"))
    closes = base.where("st <> 'O'").select("order_id", "symbol", "side", "qty", (F.col("p") + F.col("c") % 11 - 5).alias("price"), F.lit(0.3).alias("fee"), (F.col("t") + HOUR_MS).alias("ts"), F.lit(False).alias("opens"))
    return opens.unionByName(closes)


def paper_trading(spark, d):
    """Round trips of the filled orders, summed up."""
    f = _trips(spark, d)
    return rounded(risk.paper_stats(risk.round_trips(f), f, 10_000.0), 4)


PAPER_SQL = with_(
    f"o as (select o_orderkey as k, {T._SIX_SQL.format('o_orderkey')} as symbol, case when o_orderkey % 3 = 0 then -1 else 1 end as side, (1 + o_custkey % 5)::double as qty, (floor(o_totalprice)::bigint % 50 + 100)::double as p, o_custkey % 11 - 5 as move, o_orderstatus as st from orders)",
    "t as (select (((p + move) * (1 - side * 0.0002) - p * (1 + side * 0.0002)) * side * qty - 0.5) as pnl from o where st <> 'O')",
    "s as (select count(*) as n, count(*) filter (pnl > 0) as won, sum(pnl) as pnl from t)",
    "l as (select count(distinct symbol) as open_positions, 0.2 * count(*) as fees from o where st = 'O')",
) + " select " + out("10000 + pnl - fees as equity", "10000.0::double as initial_equity", "pnl as total_pnl", "pnl / 10000 as total_pnl_pct", "won / n as win_rate", digits=4) + ", n as total_trades, won as winning_trades, n - won as losing_trades, open_positions from s, l"


def decisions(spark, d):
    """Signals routed by regime, and 15m decisions by breakouts."""
    k = F.col("id")
    s = T.signals(spark, d).select("id", "confidence", F.when(k % 4 == 0, "trend_up").when(k % 4 == 1, "range").when(k % 4 == 2, "high_vol").otherwise("trend_down").alias("regime"), F.when(F.col("direction") == "long", 1).otherwise(-1).alias("direction"), (k % 5 == 0).alias("is_session_trap_zone"), (k % 3 == 0).alias("orb_breakout_bull"), (k % 7 < 3).alias("orb_breakout_bear"))
    return rounded(risk.decide_15m(risk.route(s)).select("id", "model", "min_confidence", "routed", "decision"))


DECISIONS_SQL = with_(T.SIGNALS, "s as (select id, confidence, direction, ['trend_up', 'range', 'high_vol', 'trend_down'][id % 4 + 1] as regime, id % 5 = 0 as trap, id % 3 = 0 as bull, id % 7 < 3 as bear from signals)") + " select id, case when regime = 'high_vol' then 'high_vol' else 'trend' end as model, " + out("case when regime = 'range' then 0.6 else 0.55 end as min_confidence") + ", confidence >= case when regime = 'range' then 0.6::double else 0.55::double end as routed, case when trap then 'trap' when bull = bear then 'no_breakout' when regime not like 'trend%' then 'no_trend' when (direction = 'long') <> bull then 'against_breakout' else 'take' end as decision from s"


def out_of_sample(spark, d):
    """The net returns of guesses after a date."""
    x = _labelled(spark, d).where(F.col("open_time") >= CUT).select("open_time", (F.col("future_return") * F.col("guess")).alias("ret"), (F.col("regime") != "range").alias("taken"))
    return rounded(validation.out_of_sample_report(x), 4)


OOS_SQL = with_(*_LAB, f"n as (select open_time // 86400000 as day, case when regime <> 'range' then ret * guess - 0.0007 end as net from lab where open_time >= {CUT})", "s as (select count(net) as n, count(*) as rows, count(*) filter (net > 0) as won, sum(net) filter (net > 0) as gain, -sum(net) filter (net < 0) as cost, sum(net) as total from n)", "q as (select avg(r) / stddev_samp(r) * sqrt(252) as sharpe from (select day, sum(net) as r from n group by 1) t)") + " select n as trades, " + out("100.0 * won / n as win_rate", "gain / cost as profit_factor", "sharpe as sharpe", "total / n / 0.0007 as fee_multiple", "n / rows as coverage", digits=4) + " from s, q"


def run_manifest(spark, d):
    """What a training run was made of."""
    return validation.manifest(labels.temporal_split(_labelled(spark, d), CUT, 24), ["volume", "close"])


MANIFEST_SQL = with_(*_LAB, "i as (select *, row_number() over (partition by symbol order by open_time) as k from lab)", f"e as (select symbol, max(k) as last from i where open_time < {CUT} group by 1)", f"r as (select i.*, case when open_time < {CUT} then 'train' else 'test' end as role from i left join e using (symbol) where open_time >= {CUT} or k <= last - 24)") + " select count(*) filter (role = 'train') as train_rows, count(*) filter (role = 'test') as test_rows, max(open_time) filter (role = 'train') as train_end, min(open_time) filter (role = 'test') as test_start, round(100.0 * count(*) filter (role = 'train' and target = 1) / count(*) filter (role = 'train'), 4) as train_long_pct, round(100.0 * count(*) filter (role = 'test' and target = 1) / count(*) filter (role = 'test'), 4) as test_long_pct, sha256('close,volume') as feature_hash, true as accepted from r"


QUERIES = {
    "csv_trades": (csv_trades, CSV_SQL),
    "converted_trades": (converted_trades, CONVERTED_SQL),
    "merged_sources": (merged_sources, MERGED_SOURCES_SQL),
    "better_bars": (better_bars, BETTER_SQL),
    "written_splits": (written_splits, SPLITS_SQL),
    "funding_by_month": (funding_by_month, MONTHS_SQL),
    "bar_events": (bar_events, EVENTS_SQL),
    "open_times": (open_times, OPEN_TIMES_SQL),
    "book_imbalance": (book_imbalance, BOOK_SQL),
    "training_rows": (training_rows, TRAINING_SQL),
    "fit_end": (fit_end, FIT_END_SQL),
    "sample_sizes": (sample_sizes, SAMPLE_SQL),
    "classification": (classification, CLASS_SQL),
    "ranked_cells": (ranked_cells, CELLS_SQL),
    "paper_trading": (paper_trading, PAPER_SQL),
    "decisions": (decisions, DECISIONS_SQL),
    "out_of_sample": (out_of_sample, OOS_SQL),
    "run_manifest": (run_manifest, MANIFEST_SQL),
}
