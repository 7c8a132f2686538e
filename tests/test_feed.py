"""Streams that announce once, join as of, chain windows, watch feeds and accounts: replayed, reordered, restarted."""

import collections
import json
import os
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.operators.bars import bars_from_trades
from tapeloom.operators.series import asof
from tapeloom.streaming import feed, streams, tail

MIN = 60_000
CHANGES = "source string, id long, symbol string, direction string, timeframe string, created_at long, closed_at long, result string, pnl_pct double, changed_at long"


class Files:
    """A folder of JSON files, one a batch."""

    def __init__(self, spark, root, name, schema):
        self.spark, self.path, self.schema, self.n = spark, f"{root}/{name}", schema, 0
        os.makedirs(self.path)

    def put(self, rows):
        names = [x.split()[0] for x in self.schema.split(",")]
        with open(f"{self.path}/.new", "w") as f:
            f.writelines(json.dumps(dict(zip(names, r))) + "\n" for r in rows)
        os.utime(f"{self.path}/.new", (1_700_000_000 + self.n, 1_700_000_000 + self.n))
        os.rename(f"{self.path}/.new", f"{self.path}/{self.n:05d}.json")
        self.n += 1

    def stream(self, per=1):
        return self.spark.readStream.schema(self.schema).option("maxFilesPerTrigger", per).json(self.path)


def run(df, root, name, mode="append", **options):
    """One run until the input is used up; a second call goes on from the checkpoint."""
    q = df.writeStream.format("parquet").option("path", f"{root}/{name}-out").option("checkpointLocation", f"{root}/{name}-ck").outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.read.parquet(f"{root}/{name}-out").collect()


def test_each_opening_and_close_is_announced_once(spark, tmp_dir):
    """Replayed, reordered and restarted; what was told before the first start isn't told again, but for the last half hour."""
    start = 1_000 * MIN
    row = lambda s, i, created, closed=None, result="open", pnl=None, changed=None: (s, i, "X", "long", None, created * MIN, None if closed is None else closed * MIN, result, pnl, (changed if changed is not None else closed if closed is not None else created) * MIN)
    before = [row("a", 1, 100), row("a", 2, 200, 300, "win", 1.0), row("a", 3, 975), row("a", 4, 980, 990, "loss", -1.0), row("b", 1, 10)]
    ledger = spark.createDataFrame(before, CHANGES)
    marks = feed.start_marks(ledger, start)
    assert {tuple(r) for r in marks.collect()} == {("a", 2), ("b", 1)}
    assert {tuple(r) for r in feed.start_marks(ledger, start, 0).collect()} == {("a", 4), ("b", 1)}
    later = [
        row("a", 1, 100, 1001, "win", 2.0),  # opened before the start, closed after it
        row("a", 5, 1002), row("a", 5, 1002, 1010, "breakeven", 0.0),
        row("a", 6, 1003, 1004, "loss", -2.0),  # only ever seen closed
        row("b", 2, 1005), row("c", 1, 1006),  # a source that is new
        row("b", 1, 10, 1000, "win", 1.0, changed=1011),  # shown eleven minutes late
        row("c", 2, 1007), row("c", 2, 1007, 1008, "rejected", None),
    ]
    files = Files(spark, tmp_dir, "changes", CHANGES)
    rng = random.Random(1)
    rows = [*before, *later, *later, *before]
    rng.shuffle(rows)
    for a in range(0, len(rows), 4):
        files.put(rows[a : a + 4])
    stream = lambda: feed.announcements(files.stream(), marks, ledger)
    run(stream(), tmp_dir, "feed")
    again = [*later, *before, row("a", 7, 1012), row("b", 2, 1005, 1013, "win", 3.0)]
    rng.shuffle(again)
    for a in range(0, len(again), 3):
        files.put(again[a : a + 3])
    got = run(stream(), tmp_dir, "feed")
    told = collections.Counter((r["kind"], r["source"], r["id"]) for r in got)
    assert set(told.values()) == {1}
    opened = {("open", *k) for k in [("a", 3), ("a", 4), ("a", 5), ("a", 6), ("a", 7), ("b", 2), ("c", 1), ("c", 2)]}
    closed = {("close", *k) for k in [("a", 1), ("a", 5), ("a", 6), ("b", 2)]}
    assert set(told) == opened | closed
    assert {r["timeframe"] for r in got} == {"4h"}


def test_forgotten_signals_are_not_announced_again(spark, tmp_dir):
    files = Files(spark, tmp_dir, "changes", CHANGES)
    row = ("a", 1, "X", "long", "1h", 0, 5 * MIN, "win", 1.0, 5 * MIN)
    marks = spark.createDataFrame([], "source string, mark long")
    far = lambda i, m: ("a", i, "X", "long", "1h", m * MIN, None, "open", None, m * MIN)
    files.put([row])
    for i, m in ((2, 100), (3, 200), (4, 400)):
        files.put([far(i, m)])
        files.put([row])  # later than the watermark once that has moved
    got = run(feed.announcements(files.stream(), marks), tmp_dir, "feed")
    assert collections.Counter((r["kind"], r["id"]) for r in got) == {("open", 1): 1, ("close", 1): 1, ("open", 2): 1, ("open", 3): 1, ("open", 4): 1}


def test_signals_share_a_state_by_blocks_of_ids(spark, tmp_dir):
    """Thousands of signals, ids below 0 and at the edges of blocks, each row twice: a state a block, and the same as signal by signal."""
    rng, rows, want = random.Random(5), [], set()
    for s in "ab":
        for i in [*rng.sample(range(-3 * feed.BLOCK, 3 * feed.BLOCK), 1000), -feed.BLOCK - 1, 4 * feed.BLOCK, 5 * feed.BLOCK - 1]:
            t = rng.randrange(1, 50) * MIN
            rows.append((s, i, "X", "long", rng.choice([None, "1h"]), t, None, "open", None, t))
            result = rng.choice(["open", "rejected", "win", "loss"])
            slow = rng.choice([0, 0, 11 * MIN])
            if result != "open":
                rows.append((s, i, "X", "long", None, t, t + MIN, result, 1.5, t + MIN + slow))
            want |= {(s, i, "open")} if i > (10 if s == "a" else 0) else set()
            want |= {(s, i, "close")} if result in ("win", "loss") and not slow else set()
    rows = list({(r[0], r[1], r[7]): r for r in rows}.values()) * 2
    rng.shuffle(rows)
    files = Files(spark, tmp_dir, "changes", CHANGES)
    for k in range(0, len(rows), len(rows) // 3 + 1):
        files.put(rows[k : k + len(rows) // 3 + 1])
    marks = spark.createDataFrame([("a", 10)], "source string, mark long")
    df = feed.announcements(files.stream(), marks, late="1000 days", late_ms=1000 * 86_400_000)
    q = df.writeStream.format("parquet").option("path", f"{tmp_dir}/out").option("checkpointLocation", f"{tmp_dir}/ck").trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    got = [(r["source"], r["id"], r["kind"]) for r in spark.read.parquet(f"{tmp_dir}/out").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    held = max(o["numRowsTotal"] for p in q.recentProgress for o in p["stateOperators"])
    assert 0 < held <= 2 * 8 * 8  # of 16 blocks a value and a few rows of timers, where there are 2006 signals


def test_events_come_once(spark, tmp_dir):
    files = Files(spark, tmp_dir, "events", "source string, id long, event_type string, message string, created_at long")
    rows = [("a", 1, "regime_change", '{"old": "range", "new": "trend_up"}', 5), ("a", 2, "circuit_breaker", "daily loss", MIN), ("a", 3, "error", "x", MIN), ("b", 1, "regime_change", "{}", MIN)]
    files.put(rows)
    files.put(rows[::-1])
    got = {tuple(r)[:3] + tuple(r)[5:] for r in run(feed.new_events(files.stream()), tmp_dir, "events")}
    assert got == {("a", 1, "regime_change", "range", "trend_up"), ("a", 2, "circuit_breaker", None, None), ("b", 1, "regime_change", "N/A", "N/A")}


LEFT, RIGHT = "symbol string, open_time long, close double", "symbol string, fundingTime long, fundingRate double, mark double"


def test_streaming_asof_equals_the_batch(spark, tmp_dir):
    rng = random.Random(4)
    left = [(rng.choice("AB"), rng.randrange(0, 600) * MIN, rng.random()) for _ in range(150)]
    left += [("A", 5 * MIN, 0.5)] * 2 + [("C", 7 * MIN, None)]
    right = [(rng.choice("AB"), rng.randrange(0, 600) * MIN, round(rng.uniform(-1, 1), 3), rng.choice([None, 1.5])) for _ in range(80)]
    a, b = Files(spark, tmp_dir, "left", LEFT), Files(spark, tmp_dir, "right", RIGHT)
    for f, rows in ((a, left), (b, right)):
        rows = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 60 * MIN))  # shuffled inside what the watermark allows
        for k in range(0, len(rows), 20):
            f.put(rows[k : k + 20])
    for f, end in ((a, ("Z", 10_000 * MIN, 0.0)), (b, ("Z", 10_000 * MIN, 0.0, None))):
        f.put([end])
    make = lambda: tail.streaming_asof(a.stream(3), b.stream(2), "open_time", "fundingTime", ["fundingRate", "mark"], late="70 minutes")
    got = run(make(), tmp_dir, "asof")
    want = asof(spark.createDataFrame(left, LEFT), spark.createDataFrame(right, RIGHT), "open_time", "fundingTime", ["fundingRate", "mark"]).collect()
    assert sorted(map(tuple, (r for r in got if r["symbol"] != "Z")), key=repr) == sorted(map(tuple, want), key=repr)


TRADES = "symbol string, transact_time long, trade_id long, price double, quantity double, is_buyer_maker boolean"


def test_chained_bars_equal_the_batch(spark, tmp_dir):
    rng = random.Random(5)
    rows = [(rng.choice("AB"), rng.randrange(0, 20 * 60) * MIN, i, float(rng.randrange(1, 99)), float(rng.randrange(1, 5)), rng.random() < 0.5) for i in range(600)]
    f = Files(spark, tmp_dir, "trades", TRADES)
    order = sorted(rows, key=lambda r: r[1] + rng.randrange(0, 8 * MIN))
    for k in range(0, len(order), 100):
        f.put(order[k : k + 100])
    for d in (3, 6, 9, 12):
        f.put([("Z", d * 86_400_000, 10_000 + d, 1.0, 1.0, True)])
    got = run(tail.chained_bars(f.stream()), tmp_dir, "chain")
    batch = spark.createDataFrame(rows, TRADES)
    for name, interval in (("15 minutes", "15m"), ("1 hour", "1h"), ("4 hours", "4h")):
        columns = ["symbol", "open_time", "open", "high", "low", "close", "volume", "taker_buy_volume", "trade_count"]
        want = bars_from_trades(batch, interval).select(*columns).collect()
        assert sorted(tuple(r[c] for c in columns) for r in got if r["interval"] == name and r["symbol"] != "Z") == sorted(map(tuple, want)), name


def test_live_records_take_the_names_of_the_tables(spark):
    f = tail.funding_frame(spark.createDataFrame([(1, 0.1)], "timestamp long, funding_rate double"))
    assert f.columns == ["fundingTime", "fundingRate"] and tail.funding_frame(f).columns == f.columns
    assert tail.open_interest_frame(spark.createDataFrame([(1, 2.0)], "timestamp long, oi_value double")).columns == ["create_time", "sum_open_interest_value"]
    bars = spark.createDataFrame([("A", 1, 10.0, None), ("A", 2, 10.0, 3.0)], "symbol string, open_time long, volume double, taker_buy_volume double")
    d = tail.with_taker(bars)
    assert [r["taker_buy_volume"] for r in d.orderBy("open_time").collect()] == [5.0, 3.0] and tuple(tail.taker_gaps(d).first()) == ("A", 2, 1)
    assert tail.with_taker(bars.drop("taker_buy_volume")).where("taker_missing").count() == 2


def memory(df, name, mode):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(300)
    assert q.exception() is None
    return df.sparkSession.table(name).collect()


def test_latest_funding_and_slow_trades(spark, tmp_dir):
    f = Files(spark, tmp_dir, "rates", "symbol string, ts long, rate double")
    f.put([("A", 2, 0.001), ("A", 1, 0.0)])
    f.put([("A", 1, 0.9), ("B", 5, -0.0004)])
    got = memory(streams.latest_funding(f.stream()), "latest_funding", "complete")
    assert {tuple(r) for r in got} == {("A", 2, 0.001, True), ("B", 5, -0.0004, False)}
    t = Files(spark, tmp_dir, "slow", "symbol string, transact_time long, received_at long, is_buyer_maker boolean")
    t.put([("A", 1000, 1500, True), ("A", 2000, 5000, False), ("A", 3000, None, False)])
    t.put([("Z", 10**9, 10**9, True)])
    got = {tuple(r) for r in memory(streams.slow_counts(t.stream()), "slow_counts", "append")}
    assert got == {("A", 0, 3, 1, 1750.0)}


def test_breaker_states_go_on_after_a_restart(spark, tmp_dir):
    day = 86_400_000
    f = Files(spark, tmp_dir, "pnl", "account string, ts long, pnl_pct double")
    rows = [("x", 0, -0.01), ("x", 1, -0.02), ("x", day, 0.05), ("x", 7 * day, -0.1), ("y", 3, 0.01)]
    f.put(rows[:2])
    run1 = streams.breaker_states(f.stream())
    q = lambda d: d.writeStream.format("memory").queryName("breaker_states").option("checkpointLocation", f"{tmp_dir}/ck").outputMode("update").trigger(availableNow=True).start()
    a = q(run1)
    a.awaitTermination(300)
    first = {r["account"]: tuple(r)[1:] for r in spark.table("breaker_states").collect()}
    assert first["x"][3] == 2 and first["x"][0] == pytest.approx(-0.03) and first["x"][2] == pytest.approx(0.99 * 0.98 - 1)
    f.put(rows[2:])
    got = {}

    def keep(batch, _):
        got.update({r["account"]: tuple(r)[1:] for r in batch.collect()})

    b = streams.breaker_states(f.stream()).writeStream.foreachBatch(keep).option("checkpointLocation", f"{tmp_dir}/ck").outputMode("update").trigger(availableNow=True).start()
    b.awaitTermination(300)
    assert b.exception() is None
    equity = 0.99 * 0.98 * 1.05
    assert got["x"] == (pytest.approx(-0.1), pytest.approx(-0.1), pytest.approx(equity * 0.9 / equity - 1), 1)
    assert got["y"][3] == 0 and got["y"][0] == pytest.approx(0.01)


def test_a_quiet_symbol_is_reported(spark, tmp_dir):
    f = Files(spark, tmp_dir, "ticks", "symbol string, transact_time long")
    f.put([("A", 5), ("A", 9)])
    d = streams.feed_health(f.stream(), quiet_ms=1500)
    q = d.writeStream.format("memory").queryName("feed_health").outputMode("update").trigger(processingTime="500 milliseconds").start()
    import time

    for _ in range(60):
        time.sleep(1)
        if spark.table("feed_health").count():
            break
    q.stop()
    r = spark.table("feed_health").first()
    assert (r["symbol"], r["last_trade"]) == ("A", 9)
