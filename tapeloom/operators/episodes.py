"""States that last: episodes of equal states along a key, and what held at a time.

Breaker and regime events are the beginnings of such episodes. Rows are compared and added up inside days, and days that go on
with an episode put together from a row per day, so that a key with very many rows is many tasks and is shuffled once.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.lineage import cut
from tapeloom.functions.scalar import DAY_MS
from tapeloom.operators.series import SLICE, asof, on_slices


def episodes(rows: DataFrame, state: str, worst: str, key: str = "account", ts: str = "ts", ties: tuple[str, ...] = (), size: int = SLICE) -> DataFrame:
    """Runs of rows with the same state (nulls are a state): (key, episode from 0, state, from_ts, to_ts, rows, worst). to_ts is
    when the next one begins, null for the one that is still open; worst is the least value of that column."""
    d = rows.where(F.col(key).isNotNull() & F.col(ts).isNotNull()).select(F.col(key), F.col(ts), *(c for c in ties if c not in (key, ts, state, worst)), F.col(state).alias("_state"), F.col(worst).alias("_worst"))
    d = d.withColumn("_d", F.floor(F.col(ts) / DAY_MS))
    along = Window.partitionBy(key, "_d").orderBy(ts, *(c for c in ties if c not in (key, ts)))
    held = F.struct("_state")
    d = d.withColumn("_was", F.lag(held).over(along)).withColumn("_turn", (F.col("_was").isNotNull() & ~F.col("_was").eqNullSafe(held)).cast("long"))
    d = d.withColumn("_n", F.sum("_turn").over(along.rowsBetween(Window.unboundedPreceding, 0)))
    parts = cut(d.groupBy(key, "_d", "_n", "_state").agg(F.min(ts).alias("from_ts"), F.count("*").alias("rows"), F.min("_worst").alias("worst")), "parts")
    # a day goes on with the episode that the day before it ended with, if its first state is the same
    days = parts.groupBy(key, "_d").agg(F.max("_n").alias("_turns"), F.min_by(held, "_n").alias("_first"), F.max_by(held, "_n").alias("_last"))
    order = Window.partitionBy(key).orderBy("_d")
    days = days.withColumn("_new", (~F.lag("_last").over(order).eqNullSafe(F.col("_first"))).cast("long"))
    start = F.sum(F.col("_new") + F.col("_turns")).over(order.rowsBetween(Window.unboundedPreceding, 0)) - F.col("_turns") - 1
    one = parts.join(days.select(key, "_d", start.alias("_start")), [key, "_d"]).groupBy(key, (F.col("_start") + F.col("_n")).alias("bar_idx"))
    one = one.agg(F.first("_state").alias("state"), F.min("from_ts").alias("from_ts"), F.sum("rows").alias("rows"), F.min("worst").alias("worst"))
    out = on_slices(cut(one, "episodes"), lambda x, w: x.withColumn("to_ts", F.lead("from_ts").over(w)), 0, 1, key=key, ts="from_ts", size=size)
    return out.select(key, F.col("bar_idx").alias("episode"), "state", "from_ts", "to_ts", "rows", "worst")


def state_at(times: DataFrame, of: DataFrame, ts: str = "ts", key: str = "account") -> DataFrame:
    """times with the state, and the beginning of it, that held at each: that of the last episode begun by then. Of episodes
    that begin at one time the last counts; null before the first."""
    right = of.groupBy(key, F.col("from_ts").alias("_from")).agg(F.max_by("state", "episode").alias("state"))
    return asof(times, right.withColumn("since", F.col("_from")), ts, "_from", ["since", "state"], key)


def events(of: DataFrame, kind: str, quiet: str | None = None, key: str = "account") -> DataFrame:
    """Episodes as event facts (key, ts, event_type, from_state, to_state), one for every change of state; quiet: changes to
    this state are no events."""
    d = on_slices(of.withColumn("bar_idx", F.col("episode")), lambda x, w: x.withColumn("from_state", F.lag("state").over(w)), 1, key=key, ts="from_ts")
    d = d.where("episode > 0") if quiet is None else d.where(~F.col("state").eqNullSafe(F.lit(quiet)))
    return d.select(key, F.col("from_ts").alias("ts"), F.lit(kind).alias("event_type"), "from_state", F.col("state").alias("to_state"))
