"""The live tail: bars of several lengths from one stream of trades, and as-of joins of streams.

Names and fallbacks are those of the batch tables, so that the batch features run on what comes out here.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.streaming.streams import taken

#: Names of live records, old and new, and of the batch tables (fixed values).
LIVE_NAMES = {"timestamp": "fundingTime", "funding_rate": "fundingRate"}
LIVE_OI_NAMES = {"timestamp": "create_time", "oi_value": "sum_open_interest_value"}


def funding_frame(records: DataFrame) -> DataFrame:
    """Live funding records with the batch table's names; records that have them already stay."""
    return records.withColumnsRenamed({a: b for a, b in LIVE_NAMES.items() if a in records.columns and b not in records.columns})


def open_interest_frame(records: DataFrame) -> DataFrame:
    return records.withColumnsRenamed({a: b for a, b in LIVE_OI_NAMES.items() if a in records.columns and b not in records.columns})


def with_taker(bars: DataFrame) -> DataFrame:
    """Bars whose missing taker volume is half the volume; taker_missing says where. Bars without the column have none."""
    have = F.col("taker_buy_volume") if "taker_buy_volume" in bars.columns else F.lit(None).cast("double")
    return bars.withColumn("taker_missing", have.isNull()).withColumn("taker_buy_volume", F.coalesce(have, F.col("volume") * 0.5))


def taker_gaps(bars: DataFrame) -> DataFrame:
    """Per symbol: bars, and those whose taker volume is made up."""
    return bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.count_if("taker_missing").alias("missing"))


def _resampled(bars: DataFrame, interval: str) -> DataFrame:
    """Longer bars from final shorter ones; final themselves once all that belongs to them is."""
    first, last = (lambda c: F.min_by(c, "open_time")), (lambda c: F.max_by(c, "open_time"))
    out = bars.groupBy("symbol", F.window("ts", interval).alias("w")).agg(first("open").alias("open"), F.max("high").alias("high"), F.min("low").alias("low"), last("close").alias("close"), F.sum("volume").alias("volume"), F.sum("taker_buy_volume").alias("taker_buy_volume"), F.sum("trade_count").alias("trade_count"))
    return _named(out)


def _named(out: DataFrame) -> DataFrame:
    return out.select("symbol", F.window_time("w").alias("ts"), F.unix_millis("w.start").alias("open_time"), "open", "high", "low", "close", "volume", "taker_buy_volume", "trade_count")


def chained_bars(trades: DataFrame, intervals=("15 minutes", "1 hour", "4 hours"), late: str = "10 minutes") -> DataFrame:
    """Bars of every interval (each a multiple of the one before) in one query: (interval, ts, symbol, open_time, ...). Each
    length is made of the final bars of the one before, and is final when the watermark has passed its end. Append mode."""
    order = F.struct("transact_time", "trade_id")
    d = trades.withColumn("ts", F.timestamp_millis("transact_time")).withWatermark("ts", late)
    g = d.groupBy("symbol", F.window("ts", intervals[0]).alias("w"))
    now = _named(g.agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("quantity").cast("double").alias("volume"), F.sum(taken()).cast("double").alias("taker_buy_volume"), F.count("*").alias("trade_count")))
    out = now.withColumn("interval", F.lit(intervals[0]))
    for longer in intervals[1:]:
        now = _resampled(now, longer)
        out = out.unionByName(now.withColumn("interval", F.lit(longer)))
    return out


class AsofTail(StatefulProcessor):
    """Holds left rows until the watermark has passed their time, when no right row at or before it can come any more. Of the
    right rows it keeps those that a later left row may need: the newest that the watermark has passed, and all after it."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.waiting = handle.getMapState("waiting", "t long", "rows string")
        self.context = handle.getMapState("context", "t long", "row string")

    def handleInputRows(self, key, rows: Iterator[Row], timerValues) -> Iterator[Row]:  # noqa: N802, N803
        left: dict[int, list[str]] = {}
        for r in rows:
            t = (r["t"],)
            if r["l"] is not None:
                left.setdefault(r["t"], []).append(r["l"])
                continue
            old = self.context.getValue(t) if self.context.containsKey(t) else None
            if old is None or _values(r["r"]) > _values(old[0]):
                self.context.updateValue(t, (r["r"],))
        for t, new in left.items():
            if self.waiting.containsKey((t,)):
                new = json.loads(self.waiting.getValue((t,))[0]) + new
            else:
                self.handle.registerTimer(t)
            self.waiting.updateValue((t,), (json.dumps(new),))
        return iter([])

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[Row]:  # noqa: N802, N803
        """All left rows that are due, in one pass over both; the timers of the others find nothing left to do."""
        if not self.waiting.containsKey((expiredTimerInfo.getExpiryTimeInMs(),)):
            return
        until = timerValues.getCurrentWatermarkInMs()
        due = sorted(k[0] for k in self.waiting.keys() if k[0] <= until)
        past = sorted(k[0] for k in self.context.keys() if k[0] <= until)
        at, found = -1, None
        for t in due:
            while at + 1 < len(past) and past[at + 1] <= t:
                at += 1
                found = None
            if found is None and at >= 0:
                found = self.context.getValue((past[at],))[0]
            for row in json.loads(self.waiting.getValue((t,))[0]):
                yield Row(key=key[0], l=row, r=found)
            self.waiting.removeKey((t,))
        for old in past[:-1]:
            self.context.removeKey((old,))

    def close(self) -> None:
        pass


def _values(row: str) -> list[tuple]:
    """A row's values in the order of Spark's structs, nulls first."""
    return [(v is not None, v) for v in json.loads(row).values()]


def streaming_asof(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, columns: list[str], key: str = "symbol", late: str = "10 minutes") -> DataFrame:
    """The batch as-of join on two streams: left with `columns` of the latest right row of its key at or before left_ts, null
    where there is none. A left row comes out when the watermark, of the slower stream, has passed its time; rows that are
    later than `late` are dropped. Times in milliseconds; of right rows at one time the largest counts. Append mode."""
    options = {"ignoreNullFields": "false"}
    a = left.select(F.col(key), F.col(left_ts).cast("long").alias("t"), F.to_json(F.struct(*left.columns), options).alias("l"), F.lit(None).cast("string").alias("r"))
    b = right.select(F.col(key), F.col(right_ts).cast("long").alias("t"), F.lit(None).cast("string").alias("l"), F.to_json(F.struct(*columns), options).alias("r"))
    mark = lambda d: d.where(F.col(key).isNotNull() & F.col("t").isNotNull()).withColumn("ts", F.timestamp_millis("t")).withWatermark("ts", late)
    kind = left.schema[key].dataType.simpleString()
    out = mark(a).unionByName(mark(b)).groupBy(key).transformWithState(AsofTail(), f"key {kind}, l string, r string", "Append", "EventTime")
    found = right.select(*columns).schema
    return out.select(F.from_json("l", left.schema).alias("l"), F.from_json("r", found).alias("r")).select("l.*", *(F.col("r").getField(c).alias(c) for c in columns))
