"""The signal feed: every opening and every close of a ledger's signals announced once, over replays and restarts.

The ledger arrives as change rows (source, id, symbol, direction, timeframe, created_at, closed_at, result, pnl_pct,
changed_at), times in milliseconds, in any order and more than once. A state per block of ids remembers what was announced.
What was there before the stream first started comes as initial state, and the marks say up to which id of a source openings
count as announced then. A signal whose close is announced is forgotten by an event-time timer once the watermark is so far past
its last change that a replay of it would be dropped as late.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from tapeloom.operators.ledger import CLOSED

MINUTE_MS = 60_000
COLUMNS = ("symbol", "direction", "timeframe", "created_at", "closed_at", "result", "pnl_pct", "changed_at")
ANNOUNCED = "source string, id long, kind string, symbol string, direction string, timeframe string, result string, pnl_pct double, changed_at long"
NAMES = [c.split()[0] for c in ANNOUNCED.split(", ")]
#: Ids whose state is held together. Ids of a ledger follow each other, so what changes in a batch lies in few blocks.
BLOCK = 1024
#: What was told of a signal (its place in the block, flags, when it is to be forgotten), and the flags.
KNOWN = np.dtype([("at", "<u2"), ("told", "u1"), ("due", "<i8")])
OPENED, CLOSE = np.uint8(1), np.uint8(2)


def start_marks(ledger: DataFrame, start_ms: int, recovery_minutes: int = 30) -> DataFrame:
    """(source, mark): openings up to this id count as announced when the feed starts. It is the highest id of those created
    before the last recovery_minutes, so that what was written shortly before the start is announced after all; 0 if there is
    none. With no recovery it is the highest id of all."""
    old = F.when(F.lit(recovery_minutes <= 0) | (F.col("created_at") <= start_ms - recovery_minutes * MINUTE_MS), F.col("id"))
    return ledger.groupBy("source").agg(F.coalesce(F.max(old), F.lit(0)).alias("mark"))


def initial_state(ledger: DataFrame, marks: DataFrame) -> DataFrame:
    """What counts as announced of the signals that are in the ledger when the feed starts: the openings up to the mark, and
    every close that has happened."""
    closed = F.col("result").isin(*CLOSED) & F.col("closed_at").isNotNull()
    opened = F.col("id") <= F.coalesce("mark", F.lit(0))
    rows = ledger.join(marks, "source", "left").select("source", "id", opened.alias("opened"), F.coalesce(closed, F.lit(False)).alias("closed"))
    return rows.where("opened or closed").groupBy("source", "id").agg(F.max("opened").alias("opened"), F.max("closed").alias("closed"))


class Announcer(StatefulProcessor):
    """Announces a signal's opening with its first row, also one that is closed already, and its close with the first row that
    shows it within fresh_ms. A key is a block of BLOCK ids of a source: what was told of them is one value, a record (KNOWN)
    for each signal that something was told of, so that state is read and written once a block and not once a signal."""

    def __init__(self, fresh_ms: int | None, keep_ms: int):
        self.fresh_ms, self.keep_ms = fresh_ms, keep_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.told = handle.getValueState("told", "known binary, timer long")

    def handleInitialState(self, key, initialState: pd.DataFrame, timerValues) -> None:  # noqa: N802, N803
        flags, due, timer = self._load()
        at = initialState["id"].to_numpy("int64") - key[1] * BLOCK
        opened, closed = (initialState[c].to_numpy(bool) for c in ("opened", "closed"))
        np.bitwise_or.at(flags, at, opened * OPENED | closed * CLOSE)
        due[at[closed]] = timerValues.getCurrentWatermarkInMs() + self.keep_ms
        self._save(flags, due, timer)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        flags, due, timer = self._load()
        d = pd.concat(list(rows), ignore_index=True)
        at, changed, mark = d["id"].to_numpy("int64") - key[1] * BLOCK, d["changed_at"].to_numpy("int64"), d["mark"].to_numpy("int64")
        closed_at = d["closed_at"].fillna(0).to_numpy("int64")
        order = np.lexsort((closed_at, changed, at))
        ids, firsts = np.unique(at[order], return_index=True)
        latest = changed[order[np.append(firsts[1:], len(order)) - 1]]
        first = order[firsts]
        opening = first[(d["id"].to_numpy("int64")[first] > mark[first]) & (flags[ids] & OPENED == 0)]
        shown = order[(d["result"].isin(CLOSED) & d["closed_at"].notna()).to_numpy()[order]]
        closing = shown[np.unique(at[shown], return_index=True)[1]]
        closing = closing[flags[at[closing]] & CLOSE == 0]
        flags[at[opening]] |= OPENED
        flags[at[closing]] |= CLOSE
        done = flags[ids] & CLOSE != 0
        due[ids[done]] = np.maximum(latest[done], timerValues.getCurrentWatermarkInMs()) + self.keep_ms
        self._save(flags, due, timer)
        if self.fresh_ms is not None:
            closing = closing[changed[closing] - closed_at[closing] <= self.fresh_ms]
        out = d.iloc[np.concatenate([opening, closing])]
        kinds = np.repeat(np.array(["open", "close"], dtype=object), [len(opening), len(closing)])
        yield out.assign(source=key[0], kind=kinds, timeframe=out["timeframe"].where(out["timeframe"].fillna("") != "", "4h"))[NAMES]

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:  # noqa: N802, N803
        """Forgets all signals of the block that are due; the block is woken again for the next one."""
        flags, due, _ = self._load()
        over = (flags & CLOSE != 0) & (due <= timerValues.getCurrentWatermarkInMs())
        flags[over] = 0
        self._save(flags, due, None)
        return iter([])

    def close(self) -> None:
        pass

    def _load(self):
        """What was told of each id of the block, when it is to be forgotten, and when the block's timer wakes it."""
        flags, due, timer = np.zeros(BLOCK, "uint8"), np.zeros(BLOCK, "int64"), None
        if self.told.exists():
            known, timer = self.told.get()
            known = np.frombuffer(known, KNOWN)
            flags[known["at"]], due[known["at"]] = known["told"], known["due"]
        return flags, due, timer

    def _save(self, flags, due, timer: int | None) -> None:
        at = np.flatnonzero(flags)
        ends = due[flags & CLOSE != 0]
        if len(ends) and (timer is None or ends.min() < timer):
            timer = int(ends.min())
            self.handle.registerTimer(timer)
        if len(at):
            known = np.zeros(len(at), KNOWN)
            known["at"], known["told"], known["due"] = at, flags[at], due[at]
            self.told.update((known.tobytes(), timer))
        else:
            self.told.clear()


def announcements(changes: DataFrame, marks: DataFrame, ledger: DataFrame | None = None, late: str = "1 hour", late_ms: int = 3_600_000, fresh_minutes: int | None = 10) -> DataFrame:
    """A stream of change rows as a stream of announcements (source, id, kind 'open' or 'close', ...), each exactly once.

    marks: from start_marks (sources that it lacks start at 0); ledger: what was there at the first start. Rows later than
    `late` (late_ms in numbers) are dropped; closes that are shown later than fresh_minutes after they happened are taken
    note of and not announced (None: all are). Append mode.
    """
    d = changes.select("source", F.col("id").cast("long").alias("id"), *COLUMNS).join(F.broadcast(marks), "source", "left")  # a row per source
    d = d.withColumn("mark", F.coalesce("mark", F.lit(0).cast("long"))).withColumn("ts", F.timestamp_millis("changed_at")).withWatermark("ts", late)
    blocks = lambda x: x.withColumn("block", F.expr(f"id div {BLOCK} - if(id % {BLOCK} < 0, 1, 0)")).groupBy("source", "block")
    known = None if ledger is None else blocks(initial_state(ledger, marks).withColumn("id", F.col("id").cast("long")))
    fresh = None if fresh_minutes is None else fresh_minutes * MINUTE_MS
    return blocks(d).transformWithStateInPandas(Announcer(fresh, late_ms), ANNOUNCED, "Append", "EventTime", known)


def new_events(events: DataFrame, late: str = "1 hour") -> DataFrame:
    """Breaker and regime events (source, id, event_type, message, created_at), each once, with the regimes that a change's
    message names ('N/A' where it has none)."""
    d = events.withColumn("ts", F.timestamp_millis("created_at")).withWatermark("ts", late).dropDuplicatesWithinWatermark(["source", "id"])
    named = lambda k: F.when(F.col("event_type") == "regime_change", F.coalesce(F.get_json_object("message", f"$.{k}"), F.lit("N/A")))
    return d.where(F.col("event_type").isin("regime_change", "circuit_breaker")).select("source", "id", "event_type", "message", "created_at", named("old").alias("from_regime"), named("new").alias("to_regime"))
