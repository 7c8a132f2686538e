"""Account folds, merged tables, committed conversions, sweeps and episodes against plain loops and crashes."""

import itertools
import math
import random

import pytest
from pyspark.sql import functions as F

from tapeloom.functions import lineage
from tapeloom.operators import accounts, audit, episodes, labels, ledger
from tapeloom.sources import ledgers, store, versions

DAY = 86_400_000
FILLS = "account string, fill_id long, ts long, symbol string, kind string, side int, qty double, price double, fee double"


def fold(rows, initial=10_000.0, base=None):
    """One account, row by row."""
    base = initial if base is None else base
    cash, peak, held = initial, base, {}
    day, week, day_start, daily, weekly, losses = None, None, base, 0.0, 0.0, 0
    out = []
    floating = lambda: sum(p["u"] for p in held.values())
    for account, i, ts, symbol, kind, side, qty, price, fee in rows:
        real, pos = 0.0, held.get(symbol)
        if kind in ("open", "close"):
            d = ts // DAY
            if d != day:
                day_start = cash + floating() if day is not None else base
                day, daily = d, 0.0
                if (d + 3) // 7 != week:
                    week, weekly = (d + 3) // 7, 0.0
        if kind == "open":
            cash -= fee
            if pos:
                pos["p"] = (pos["p"] * pos["q"] + price * qty) / (pos["q"] + qty)
                pos["q"] += qty
                pos["f"] += fee
            else:
                held[symbol] = {"side": side, "q": qty, "p": price, "f": fee, "u": 0.0}
        elif kind == "mark" and pos:
            pos["u"] = pos["side"] * (price - pos["p"]) * pos["q"]
            peak = max(peak, cash + floating())
        elif kind == "close" and pos:
            gross = pos["side"] * (price - pos["p"]) * pos["q"]
            real = gross - pos["f"] - fee
            cash += gross - fee
            daily, weekly = daily + real, weekly + real
            losses = losses + 1 if real < 0 else 0
            peak = max(peak, cash + floating())
            del held[symbol]
        elif kind == "sync":
            cash = price - floating()
            peak = max(peak, price)
        equity = cash + floating()
        pos = held.get(symbol)
        out.append((i, pos["q"] if pos else 0.0, pos["p"] if pos else None, real, cash, equity, peak, max((peak - equity) / peak, 0.0), (daily + floating()) / (day_start if day_start > 0 else base), (weekly + floating()) / base, losses))
    return out


def fills(seed, n, account="a"):
    rng, ts, out = random.Random(seed), 0, []
    for i in range(n):
        ts += rng.choice([0, 60_000, 3_600_000, 7_000_000])
        kind = rng.choices(["open", "close", "mark", "sync"], [5, 3, 4, 0.1])[0]
        out.append((account, i, ts, rng.choice("XYZ"), kind, rng.choice([1, -1]), float(rng.randrange(1, 5)), float(rng.randrange(9_000, 11_000) if kind == "sync" else rng.randrange(90, 110)), 0.25))
    return out


def same(got, want):
    columns = ("fill_id", "position", "avg_price", "realised", "cash", "equity", "peak", "drawdown", "daily_pnl_pct", "weekly_pnl_pct", "loss_streak")
    assert len(got) == len(want)
    for g, w in zip(got, want):
        for c, x in zip(columns, w):
            assert (g[c] is None and x is None) or g[c] == pytest.approx(x, rel=1e-9, abs=1e-7), (g["fill_id"], c, g[c], x)


def test_account_by_hand(spark):
    """Entry fees count against realised P&L, and turn a small win into a loss."""
    rows = [("a", 1, 1, "X", "open", 1, 1.0, 100.0, 0.2), ("a", 2, 2, "X", "open", -1, 1.0, 110.0, 0.2), ("a", 3, 3, "X", "mark", None, None, 120.0, None), ("a", 4, 4, "X", "close", None, None, 105.2, 0.2), ("a", 5, DAY, "Y", "close", None, None, 1.0, 9.0), ("a", 6, DAY + 1, "Y", "open", -1, 2.0, 50.0, 0.0), ("a", 7, DAY + 2, "Y", "close", None, None, 40.0, 0.0)]
    got = accounts.accounts(spark.createDataFrame(rows, FILLS), 1000.0).orderBy("fill_id").collect()
    r = got[3]
    assert r["realised"] == pytest.approx(0.4 - 0.6) and r["loss_streak"] == 1 and r["cash"] == pytest.approx(1000 - 0.4 + 0.4 - 0.2) and r["position"] == 0
    assert got[2]["unrealised"] == pytest.approx(30.0) and got[2]["peak"] == pytest.approx(1029.6)
    assert r["peak"] == pytest.approx(1029.8) and r["daily_pnl_pct"] == pytest.approx(-0.2 / 1000)  # the mark still counts when the peak is looked at
    assert got[4]["cash"] == r["cash"] and got[4]["loss_streak"] == 1 and got[4]["daily_pnl_pct"] == 0  # nothing to close; a new day
    assert got[6]["realised"] == pytest.approx(20.0) and got[6]["loss_streak"] == 0 and got[6]["daily_pnl_pct"] == pytest.approx(20 / 999.8) and got[6]["weekly_pnl_pct"] == pytest.approx(19.8 / 1000)


def test_accounts_equal_a_plain_fold_over_many_slices(spark):
    a, b = fills(1, 3000), fills(2, 200, "b")
    d = spark.createDataFrame(a + b + [(None, 1, 1, "X", "open", 1, 1.0, 1.0, 0.0)], FILLS).repartition(7)
    base = spark.createDataFrame([("b", 5000.0), ("b2", -1.0), ("a", float("nan"))], "account string, equity double")
    got = accounts.accounts(d, 10_000.0, base, size=64).orderBy("account", "fill_id").collect()
    same([r for r in got if r["account"] == "a"], fold(a))
    same([r for r in got if r["account"] == "b"], fold(b, base=5000.0))
    last = {r["account"]: r["fill_id"] for r in accounts.latest_states(accounts.accounts(d)).collect()}
    assert last == {"a": 2999, "b": 199}
    assert accounts.accounts(d.limit(0)).count() == 0


def test_trading_stats_by_hand(spark):
    rows = [("win", 2.0, 0.6, 90), ("win", 1.0, 0.8, 10), ("loss", -1.0, 0.7, 90), ("breakeven", 0.0, 0.5, 95), ("rejected", None, 0.5, 96), ("open", 5.0, 0.9, 97)]
    d = spark.createDataFrame([("a", r, p, c, day * DAY) for r, p, c, day in rows], "source string, result string, pnl_pct double, confidence double, created_at long")
    r = ledger.ledger_stats(d).first()
    assert (r["total"], r["open"], r["closed"], r["wins"], r["losses"]) == (6, 1, 5, 2, 1) and r["win_rate"] == pytest.approx(2 / 3)
    assert (r["total_pnl"], r["avg_pnl"], r["best"], r["worst"], r["gross_win"], r["gross_loss"], r["profit_factor"]) == (2.0, 0.5, 2.0, -1.0, 3.0, -1.0, 3.0)
    late = ledger.ledger_stats(d, as_of_ms=100 * DAY, days=30).first()
    assert (late["total"], late["wins"], late["profit_factor"]) == (5, 1, 2.0)
    assert ledger.ledger_stats(d.where("result = 'win'")).first()["profit_factor"] is None and ledger.ledger_stats(d.where("result = 'open'")).first()["profit_factor"] == 0.0
    assert ledger.all_time_stats(d, 100 * DAY + 5).select("closed", "win_rate", "win_rate_30d", "total_pnl").first()[:] == (3, pytest.approx(2 / 3), 0.5, 2.0)
    parts = ledger.ledger_stats(d.where("result = 'win'").withColumn("source", F.lit("b")), ["source"]).unionByName(ledger.ledger_stats(d.where("result <> 'win'"), ["source"]))
    m = ledger.merge_stats(parts).first()
    assert m["win_rate"] == pytest.approx(2 / 3) and m["profit_factor"] == 3.0 and m["avg_pnl"] == pytest.approx(2.0 / 5) and m["avg_confidence"] == pytest.approx((0.7 * 2 + 0.65 * 1) / 3)
    metrics = spark.createDataFrame([(1.0, 0.1, "range", 1, 5), (2.0, 0.2, "trend_up", 2, 9)], "equity double, daily_pnl double, regime string, open_positions int, updated_at long")
    one = ledger.live(d.withColumns({"id": F.monotonically_increasing_id(), "symbol": F.lit("X"), "direction": F.lit("long")}), metrics).first()
    assert (one["open_signals"], one["equity"], one["regime"], one["last_created_at"]) == (1, 2.0, "trend_up", 97 * DAY)


# --- merged tables ------------------------------------------------------------------------------------------------

SIGNALS = "id long, symbol string, direction string, timeframe string, created_at long"


def rows_of(d):
    return sorted(map(tuple, d.collect()), key=repr)


def test_a_ledger_is_merged(spark, tmp_dir):
    path = f"{tmp_dir}/ledger"
    signals = spark.createDataFrame([(i, "X", "long", None if i % 2 else "1h", i * 10 * DAY) for i in range(20)], SIGNALS)
    assert versions.read(spark, path) is None and ledgers.log_signals(spark, path, signals) == 1
    assert versions.manifest(spark, path).count() == 7  # months
    ledgers.close_signals(spark, path, spark.createDataFrame([(3, 5, 1.5, 2.0, "win"), (3, 9, 1.0, -1.0, "loss"), (19, 7, 1.0, 0.0, "breakeven"), (99, 1, 1.0, 1.0, "win")], "id long, closed_at long, close_price double, pnl_pct double, result string"))
    assert versions.versions(spark, path) == [1, 2]
    new = {r["part"] for r in versions.manifest(spark, path).where("folder like '000000000002%'").collect()}
    assert new == {"1970-01", "1970-07"}  # only the months of 3 and 19 were written
    ledgers.reject_signals(spark, path, spark.createDataFrame([(4, 11)], "id long, closed_at long"))
    ledgers.log_signals(spark, path, spark.createDataFrame([(100, "Y", "short", "15m", 400 * DAY)], SIGNALS))
    now = {r["id"]: r for r in versions.read(spark, path).collect()}
    assert len(now) == 21 and now[3]["result"] == "loss" and now[3]["closed_at"] == 9 and now[3]["timeframe"] == "4h"
    assert now[4]["result"] == "rejected" and now[4]["pnl_pct"] is None and now[4]["closed_at"] == 11
    assert now[5]["result"] == "open" and now[100]["result"] == "open" and now[2]["timeframe"] == "1h"
    first = {r["id"]: r["result"] for r in versions.read(spark, path, 1).collect()}
    assert len(first) == 20 and set(first.values()) == {"open"}
    before = rows_of(versions.read(spark, path))
    assert versions.vacuum(spark, path, keep=1) >= 1 and rows_of(versions.read(spark, path)) == before and versions.read(spark, path, 1) is None


def test_a_crash_between_any_two_writes_changes_nothing(spark, tmp_dir, monkeypatch):
    path = f"{tmp_dir}/t"
    d = spark.createDataFrame([(i, "p" + str(i % 3), i) for i in range(30)], "id long, p string, x long")
    versions.merge(spark, path, d, "id", F.col("p"))
    before = rows_of(versions.read(spark, path))
    change = spark.createDataFrame([(1, "p0", -1), (50, "p9", 50), (51, "p2", None), (None, "p1", 3)], "id long, p string, x long")

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:  # after the manifest, before the commit
        m.setattr(versions, "_commit", die)
        with pytest.raises(RuntimeError):
            versions.merge(spark, path, change, "id", F.col("p"))
    assert rows_of(versions.read(spark, path)) == before and versions.versions(spark, path) == [1]
    from pyspark.sql import DataFrameWriter

    real, count = DataFrameWriter.parquet, itertools.count()

    def fails_at(k):
        def parquet(self, where, *a, **b):
            if where.startswith(path) and next(count) == k:
                raise RuntimeError("killed")
            return real(self, where, *a, **b)

        return parquet

    for k in (0, 1):  # before the data, between data and manifest
        count = itertools.count()
        with monkeypatch.context() as m:
            m.setattr(DataFrameWriter, "parquet", fails_at(k))
            with pytest.raises(RuntimeError):
                versions.merge(spark, path, change, "id", F.col("p"))
        assert rows_of(versions.read(spark, path)) == before
    assert versions.merge(spark, path, change, "id", F.col("p")) == 2
    want = [(i, "p" + str(i % 3), i) for i in range(30) if i != 1] + [(1, "p0", -1), (50, "p9", 50), (51, "p2", None)]
    assert rows_of(versions.read(spark, path).select("id", "p", "x")) == sorted(want, key=repr)
    with pytest.raises(Exception):  # another merge onto the same version was first
        versions._commit(spark, path, 2, "x")
    assert versions.merge(spark, path, change.limit(0), "id", F.col("p")) == 2
    assert versions.vacuum(spark, path) >= 2 and versions.read(spark, path).count() == 32


def test_derived_tables_follow_the_ledger(spark, tmp_dir):
    path, daily, cache = (f"{tmp_dir}/{x}" for x in ("ledger", "daily", "cache"))
    ledgers.log_signals(spark, path, spark.createDataFrame([(i, "X", "long", None, i * DAY) for i in range(12)], SIGNALS).withColumns({"confidence": F.lit(0.6), "rr_ratio": F.lit(1.5), "duration_minutes": F.lit(60)}))
    close = lambda i, r, p: (i, (i + 1) * DAY, 1.0, p, r)
    ledgers.close_signals(spark, path, spark.createDataFrame([close(i, "win" if i % 2 else "loss", 1.0 if i % 2 else -0.5) for i in range(6)], "id long, closed_at long, close_price double, pnl_pct double, result string"))
    ledgers.refresh_daily(spark, path, daily)
    assert versions.read(spark, daily).count() == 6
    ledgers.close_signals(spark, path, spark.createDataFrame([close(8, "win", 2.0)], "id long, closed_at long, close_price double, pnl_pct double, result string"))
    ledgers.refresh_daily(spark, path, daily, since="1970-01-08")
    want = ledger.daily_stats(versions.read(spark, path))
    assert rows_of(versions.read(spark, daily).select(*want.columns)) == rows_of(want)
    ledgers.refresh_performance(spark, path, cache, 20 * DAY)
    ledgers.refresh_performance(spark, path, cache, 21 * DAY)
    now = versions.read(spark, cache)
    assert now.where("tf = 'all' and period_days = 30").first()["as_of"] == 21 * DAY and now.groupBy("key").count().where("count > 1").count() == 0
    m = f"{tmp_dir}/metrics"
    row = lambda e, t: spark.createDataFrame([("bot", e, 0.0, "range", 1, t)], "bot string, equity double, daily_pnl double, regime string, open_positions int, updated_at long")
    ledgers.record_metrics(spark, m, row(1.0, 5))
    ledgers.record_metrics(spark, m, row(2.0, 6))
    assert [tuple(r)[:2] for r in versions.read(spark, m).select("bot", "equity").collect()] == [("bot", 2.0)]


# --- conversions --------------------------------------------------------------------------------------------------


def kline(path, day, rows=3, volume=10):
    with open(path, "w") as f:
        f.write("open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore\n")
        f.writelines(f"{1_704_067_200_000 + day * DAY + i * 14_400_000},1,2,0.5,1.5,{volume},1,5,7,4,2,0\n" for i in range(rows))


def test_conversions_commit_once(spark, tmp_dir, monkeypatch):
    raw, root = tmp_dir, f"{tmp_dir}/store"
    for k in range(2):
        kline(f"{raw}/X-4h-2024-01-0{k + 1} (a+b).csv", k)
    open(f"{raw}/X-4h-2024-01-08.csv", "w").close()
    with open(f"{raw}/X-4h-2024-01-09.csv", "w") as f:
        f.write("open_time,open\nnonsense,1\n")
    go = lambda: tuple(store.convert(spark, f"{raw}/*.csv", root, "klines_4h", "X").first())

    def die(*_):
        raise RuntimeError("killed")

    with monkeypatch.context() as m:
        m.setattr(store, "_commit", die)
        with pytest.raises(RuntimeError):
            go()
    with pytest.raises(FileNotFoundError):
        store.committed(spark, root, "klines_4h")
    assert go() == (2, 0, 1, 1)
    assert store.committed(spark, root, "klines_4h").count() == 6  # the batch that died is not read
    assert go() == (0, 3, 0, 1)
    kline(f"{raw}/X-4h-2024-01-03.csv", 2)
    import os
    import time

    changed = f"{raw}/X-4h-2024-01-01 (a+b).csv"
    kline(changed, 0, rows=2, volume=99)
    os.utime(changed, (time.time() + 5, time.time() + 5))
    with monkeypatch.context() as m:
        m.setattr(store, "_commit", die)
        with pytest.raises(RuntimeError):
            go()
    assert store.committed(spark, root, "klines_4h").count() == 6
    assert go()[0] == 2
    now = store.committed(spark, root, "klines_4h")
    assert now.count() == 8 and now.where("volume = 99").count() == 2 and now.where("volume = 10").count() == 6


def test_fold_and_episodes_write_their_rows_twice(spark, monkeypatch):
    """Few passes over the rows, with positions and syncs that reach over many pieces of a day and over days."""
    written = []

    def counted(df, name="cut"):
        out = lineage.cut(df, name)
        written.append(out.count())
        return out

    monkeypatch.setattr(accounts, "cut", counted)
    monkeypatch.setattr(episodes, "cut", counted)
    rows = fills(3, 1200)
    states = accounts.accounts(spark.createDataFrame(rows, FILLS), size=5)
    want = fold(rows)
    same(states.orderBy("fill_id").collect(), want)
    got = episodes.episodes(states.withColumn("state", F.col("loss_streak") >= 2), "state", "equity", ties=("fill_id",)).orderBy("episode").collect()
    runs = [list(g) for _, g in itertools.groupby(want, key=lambda w: w[10] >= 2)]
    assert [r["rows"] for r in got] == [len(g) for g in runs]
    assert [r["worst"] for r in got] == pytest.approx([min(w[5] for w in g) for g in runs])
    assert sum(n >= len(rows) for n in written) <= 2


# --- sweeps and episodes ------------------------------------------------------------------------------------------


@pytest.mark.parametrize("size", [8192, 16])
def test_weights_by_sweep(spark, size):
    rng = random.Random(7)
    rows = [(s, i, i + rng.choice([0, 1, 5, 90])) for s in "AB" for i in range(300) if rng.random() < 0.4]
    rows += [("A", 10, 12), ("A", 10, 12), ("C", 5, 9)]
    d = spark.createDataFrame(rows, "symbol string, _bar_idx long, t1_bar long")
    got = sorted((r["symbol"], r["_bar_idx"], r["t1_bar"], round(r["weight"], 9)) for r in labels.uniqueness_weights(d, size=size).collect())
    want = []
    for s in "ABC":
        own = [(a, b) for x, a, b in rows if x == s]
        load = {}
        for a, b in own:
            for t in range(a, b + 1):
                load[t] = load.get(t, 0) + 1
        u = [sum(1 / load[t] for t in range(a, b + 1)) / (b - a + 1) for a, b in own]
        want += [(s, a, b, round(x / (sum(u) / len(u)), 9)) for (a, b), x in zip(own, u)]
    assert [g[:3] for g in got] == [w[:3] for w in sorted(want)] and all(abs(g[3] - w[3]) < 1e-7 for g, w in zip(got, sorted(want)))
    assert labels.uniqueness_weights(d.limit(0)).count() == 0


def test_drift_by_ranges(spark):
    rng = random.Random(8)
    rows = [(f, i, t) for f in "ab" for i, t in enumerate(itertools.accumulate(rng.choice([0, 5, 5, 30]) for _ in range(500)))]
    rows[255] = (rows[255][0], rows[255][1], rows[255][2] + 1000)
    d = spark.createDataFrame(rows, "_file string, _pos int, transact_time long")
    one = {r["_file"]: tuple(r)[1:] for r in audit.clock_drift(d).collect()}
    assert one == {r["_file"]: tuple(r)[1:] for r in audit.clock_drift(d, size=16).collect()} and one["a"][1] is False and one["b"] == (500, True, 30)


@pytest.mark.parametrize("size", [8192, 8])
def test_episodes(spark, size):
    rng = random.Random(9)
    rows = []
    for a in "xy":
        state = "ok"
        for t in range(120):
            state = rng.choice(["ok", "kill", None]) if rng.random() < 0.2 else state
            rows.append((a, t // 2 if a == "y" else t, t, state, round(rng.uniform(-1, 1), 3)))
    d = spark.createDataFrame(rows, "account string, ts long, n int, state string, pnl double")
    got = episodes.episodes(d, "state", "pnl", ties=("n",), size=size)
    want = []
    for a in "xy":
        runs = [(s, list(g)) for s, g in itertools.groupby((r for r in rows if r[0] == a), key=lambda r: r[3])]
        for k, (s, g) in enumerate(runs):
            want.append((a, k, s, g[0][1], runs[k + 1][1][0][1] if k + 1 < len(runs) else None, len(g), min(r[4] for r in g)))
    assert rows_of(got) == sorted(want, key=repr)
    times = spark.createDataFrame([("x", t) for t in (-1, 0, 60, 119, 500)] + [("z", 1)], "account string, ts long")
    at = {(r["account"], r["ts"]): (r["since"], r["state"]) for r in episodes.state_at(times, got).collect()}
    for (a, t), (since, state) in at.items():
        last = [w for w in want if w[0] == a and w[3] <= t]
        assert (since, state) == ((last[-1][3], last[-1][2]) if last else (None, None))
    e = episodes.events(got, "circuit_breaker", quiet="ok").collect()
    assert len(e) == sum(w[2] != "ok" for w in want) and all(r["event_type"] == "circuit_breaker" for r in e)
    assert math.isclose(len(episodes.events(got, "regime_change").collect()), len(want) - 2)
