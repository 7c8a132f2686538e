"""The tape live: the batch operators' measures on Structured Streaming, with watermarks and keyed state."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.functions.scalar import DAY_MS, safe_divide


def with_latency(trades: DataFrame, warn_ms: int = 1000, received: str = "received_at") -> DataFrame:
    """Trades with side, latency in ms and a flag for slow ones (one projection; batch or stream)."""
    lag = F.col(received) - F.col("transact_time")
    return trades.select("*", lag.alias("latency_ms"), F.when(F.col("is_buyer_maker"), "sell").otherwise("buy").alias("side"), F.coalesce(lag > warn_ms, F.lit(False)).alias("slow"))


def slow_counts(trades: DataFrame, minutes: int = 1, late: str = "1 minute") -> DataFrame:
    """Per symbol and window: trades, slow ones, mean latency."""
    d = with_latency(trades).withColumn("ts", F.timestamp_millis("transact_time")).withWatermark("ts", late)
    g = d.groupBy("symbol", F.window("ts", f"{minutes} minutes").alias("w"))
    return g.agg(F.count("*").alias("trades"), F.count_if("slow").alias("slow"), F.avg("latency_ms").alias("mean_latency_ms")).select("symbol", F.unix_millis("w.start").alias("window_start"), "trades", "slow", "mean_latency_ms")


def taken():
    """The quantity that buyers took."""
    return F.when(~F.col("is_buyer_maker"), F.col("quantity")).otherwise(0)


def streaming_bars(trades: DataFrame, interval: str = "15 minutes", late: str = "10 minutes") -> DataFrame:
    """Tumbling bars as the batch operator makes them; a bar is final once the watermark has passed its end."""
    d = trades.withColumn("ts", F.timestamp_millis("transact_time")).withWatermark("ts", late)
    order = F.struct("transact_time", "trade_id")
    g = d.groupBy("symbol", F.window("ts", interval).alias("w"))
    out = g.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").cast("double").alias("volume"), F.sum(taken()).cast("double").alias("taker_buy_volume"), F.count("*").alias("trade_count"))
    return out.select("symbol", F.unix_millis("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "taker_buy_volume", "trade_count")


def book_imbalance(books: DataFrame, levels: int = 5) -> DataFrame:
    """(bids - asks) / (bids + asks) over the best levels of each book (bids, asks: arrays of (price, qty)); 0 if empty."""
    top = lambda c, asc: F.slice(F.sort_array(c, asc), 1, levels)
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x["qty"])
    b, a = total(top("bids", False)), total(top("asks", True))
    return books.select("symbol", "ts", b.alias("bid_qty"), a.alias("ask_qty"), safe_divide(b - a, b + a).alias("imbalance"))


def latest_by(rows: DataFrame, key: str, ts: str, columns: list[str]) -> DataFrame:
    """The newest row of each key (update or complete mode)."""
    return rows.groupBy(key).agg(F.max_by(F.struct(*columns), F.struct(ts, *columns)).alias("_r"), F.max(ts).alias(ts)).select(key, ts, "_r.*")


def latest_funding(rates: DataFrame, warn: float = 5e-4) -> DataFrame:
    return latest_by(rates, "symbol", "ts", ["rate"]).withColumn("extreme", F.abs("rate") > warn)


class LastTrades(StatefulProcessor):
    """Keeps the newest `n` trades of each symbol and puts out how many it holds, their volume and newest price."""

    def __init__(self, n: int = 1000):
        self.n = n

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.rows = handle.getListState("rows", "transact_time long, price double, quantity double")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        new = [(int(r.transact_time), float(r.price), float(r.quantity)) for d in rows for r in d.itertuples(index=False)]
        kept = sorted([*(tuple(x) for x in self.rows.get()), *new])[-self.n :]
        self.rows.put(kept)
        yield pd.DataFrame({"symbol": [key[0]], "held": [len(kept)], "volume": [float(sum(x[2] for x in kept))], "last_price": [kept[-1][1]]})

    def close(self) -> None:
        pass


def last_trades(trades: DataFrame, n: int = 1000) -> DataFrame:
    d = trades.select("symbol", "transact_time", F.col("price").cast("double"), F.col("quantity").cast("double"))
    return d.groupBy("symbol").transformWithStateInPandas(LastTrades(n), "symbol string, held long, volume double, last_price double", "Update", "None")


class RegimeChanges(StatefulProcessor):
    """Remembers a symbol's last regime and puts out a row when it changes."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.last = handle.getValueState("last", "regime string, open_time long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        bars = pd.concat(list(rows)).sort_values("open_time")
        last = self.last.get() if self.last.exists() else None
        out = []
        for r in bars.itertuples(index=False):
            if last is not None and r.open_time <= last[1]:
                continue  # late
            if last is not None and last[0] != r.regime:
                out.append((key[0], int(r.open_time), last[0], r.regime))
            last = (r.regime, int(r.open_time))
        if last is not None:
            self.last.update(last)
        yield pd.DataFrame(out, columns=["symbol", "open_time", "from_regime", "to_regime"])

    def close(self) -> None:
        pass


def regime_changes(bars: DataFrame) -> DataFrame:
    return bars.select("symbol", "open_time", "regime").groupBy("symbol").transformWithStateInPandas(RegimeChanges(), "symbol string, open_time long, from_regime string, to_regime string", "Append", "None")


class FeedHealth(StatefulProcessor):
    """Puts out a symbol when nothing has come from it for `quiet_ms` of processing time."""

    def __init__(self, quiet_ms: int = 30_000):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.seen = handle.getValueState("seen", "newest long, since long")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        newest, now = max(r["transact_time"] for r in rows), timerValues.getCurrentProcessingTimeInMs()
        if self.seen.exists():
            newest = max(newest, self.seen.get()[0])
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(now + self.quiet_ms)
        self.seen.update((newest, now))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        newest, since = self.seen.get()
        yield Row(symbol=key[0], last_trade=newest, quiet_since=since)

    def close(self) -> None:
        pass


def feed_health(trades: DataFrame, quiet_ms: int = 30_000) -> DataFrame:
    """Symbols that have gone quiet (symbol, last_trade, quiet_since): one row each time one does. Update mode."""
    d = trades.where(F.col("transact_time").isNotNull()).select("symbol", "transact_time")
    return d.groupBy("symbol").transformWithState(FeedHealth(quiet_ms), "symbol string, last_trade long, quiet_since long", "Update", "ProcessingTime")


class BreakerState(StatefulProcessor):
    """Folds closed trades (ts, pnl_pct as a share) of an account into daily and weekly P&L, drawdown and loss streak, and
    puts out the state after each batch."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.state = handle.getValueState("state", "equity double, peak double, day long, day_pnl double, week long, week_pnl double, losses long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timer_values) -> Iterator[pd.DataFrame]:  # noqa: N802
        s = list(self.state.get()) if self.state.exists() else [1.0, 1.0, -1, 0.0, -1, 0.0, 0]
        for r in pd.concat(list(rows)).sort_values("ts").itertuples(index=False):
            day = int(r.ts) // 86_400_000
            week = (day + 3) // 7
            s[3] = r.pnl_pct + (s[3] if day == s[2] else 0.0)
            s[5] = r.pnl_pct + (s[5] if week == s[4] else 0.0)
            s[0] *= 1 + r.pnl_pct
            s[1] = max(s[0], s[1])
            s[2], s[4], s[6] = day, week, s[6] + 1 if r.pnl_pct < 0 else 0
        self.state.update(tuple(s))
        yield pd.DataFrame({"account": [key[0]], "daily_pnl_pct": [s[3]], "weekly_pnl_pct": [s[5]], "drawdown": [s[0] / s[1] - 1], "consecutive_losses": [s[6]]})

    def close(self) -> None:
        pass


def breaker_states(trades: DataFrame) -> DataFrame:
    return trades.select("account", "ts", "pnl_pct").groupBy("account").transformWithStateInPandas(BreakerState(), "account string, daily_pnl_pct double, weekly_pnl_pct double, drawdown double, consecutive_losses long", "Update", "None")


def merge_history(batch: DataFrame, backfill: DataFrame, keep: int) -> DataFrame:
    """History and new rows, one per symbol and time (the new one counts), the newest `keep` of each symbol."""
    from pyspark.sql import Window

    both = backfill.withColumn("_new", F.lit(0)).unionByName(batch.withColumn("_new", F.lit(1)), allowMissingColumns=True)
    rest = [c for c in both.columns if c not in ("symbol", "open_time", "_new")]
    one = both.groupBy("symbol", "open_time").agg(F.max_by(F.struct(*rest), "_new").alias("_r")).select("symbol", "open_time", "_r.*")
    rank = F.row_number().over(Window.partitionBy("symbol").orderBy(F.desc("open_time")))
    return one.withColumn("_k", rank).where(F.col("_k") <= keep).drop("_k")


def _days(spark, table_path: str, first_ms: int, last_ms: int) -> list[str]:
    """The folders of the days from one time to another that are there."""
    path = spark._jvm.org.apache.hadoop.fs.Path
    fs = path(table_path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    names = (f"{table_path}/day={k}" for k in range(first_ms // DAY_MS, last_ms // DAY_MS + 1))
    return [n for n in names if fs.exists(path(n))]


def live_features(table_path: str, out_path: str, features, tail_bars: int, bar_ms: int):
    """A foreachBatch function: write the batch's bars to the table, run the batch feature function on the newest tail_bars
    of the symbols it touches, and write their last rows. The table has a folder a day, and in it one an epoch, so that an epoch
    that is replayed replaces what it wrote, and only the days of the tail are listed and read."""

    def run(batch: DataFrame, epoch: int) -> None:
        spark = batch.sparkSession
        rows = batch.withColumns({"day": F.floor(F.col("open_time") / DAY_MS), "epoch": F.lit(epoch)})
        rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "epoch").parquet(table_path)
        touched = batch.groupBy("symbol").agg(F.min("open_time").alias("_from"))
        ends = batch.agg(F.min("open_time").alias("a"), F.max("open_time").alias("b")).first()
        if ends["a"] is None:
            return
        oldest = ends["a"] - tail_bars * bar_ms
        history = spark.read.option("basePath", table_path).parquet(*_days(spark, table_path, oldest, ends["b"]))
        history = history.where((F.col("open_time") > oldest) & (F.col("epoch").cast("long") <= epoch)).drop("epoch", "day")
        tail = merge_history(batch, history.join(touched.select("symbol"), "symbol", "left_semi"), tail_bars)
        rows = features(tail)
        newest = rows.groupBy("symbol").agg(F.max("open_time").alias("open_time"))
        rows.join(newest, ["symbol", "open_time"]).write.mode("overwrite").parquet(f"{out_path}/epoch={epoch}")

    return run
