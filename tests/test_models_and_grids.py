"""Barrier grids, searches, folds, permutations and order indexes against loops; look-ups; the library without its subpackage."""

import math
import os
import random
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

from tapeloom.operators import backtest, derivs, labels, ledger, models
from tapeloom.sources import store

HOUR, DAY = 3_600_000, 86_400_000


def walk(spark, n=400, symbols="AB", seed=3):
    rng, rows = random.Random(seed), []
    for s in symbols:
        p = 100.0
        for i in range(n):
            p *= 1 + rng.uniform(-0.02, 0.02)
            rows.append((s, i * DAY, p, rng.choice([None, 0.01, 0.02])))
    return spark.createDataFrame(rows, "symbol string, open_time long, close double, atr_pct double")


GRID = [(1.0, 1.0, 6), (1.5, 1.0, 8), (1.25, 1.0, 4), (1.0, 0.8, 6)]


def test_grid_labels_are_those_of_each_cell(spark):
    bars = walk(spark)
    got = labels.grid_labels(bars, GRID)
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 2  # rows and their counts by day: whatever the grid
    one = got.select("symbol", "open_time", "up", "down", "horizon", "label", F.round("future_return", 9).alias("r"), "t1_bar").collect()
    for up, down, h in GRID:
        want = labels.triple_barrier(bars, up, down, h).select("symbol", "open_time", "label", F.round("future_return", 9).alias("r"), "t1_bar").collect()
        own = [(r["symbol"], r["open_time"], r["label"], r["r"], r["t1_bar"]) for r in one if (r["up"], r["down"], r["horizon"]) == (up, down, h)]
        assert sorted(own) == sorted(map(tuple, want)), (up, down, h)


def test_grid_search_fits_the_best_cell_again(spark):
    bars = walk(spark, 300)
    bars = bars.withColumn("x", F.sin(F.col("open_time") / DAY / 5)).withColumn("y0", F.rand(1))
    ranked, model, best = models.grid_search(bars, ["x", "y0"], GRID, 240 * DAY, embargo=8, kind="logistic", refit="logistic", low=20.0, high=80.0)
    rows = ranked.collect()
    assert {(r["up"], r["horizon"]) for r in rows} <= {(u, h) for u, _, h in GRID} and len(rows) == len(GRID)
    assert tuple(rows[0]) == tuple(best) and rows[0]["score"] == max(r["score"] for r in rows)
    assert models.score(model, bars, ["x", "y0"]).where("p_up is null").count() == 0
    none = models.grid_search(bars, ["x"], GRID, 240 * DAY, low=99.0, high=100.0)
    assert none[0].count() == 0 and none[1] is None
    s = models.cell_summary(bars, GRID[:2]).collect()
    assert len(s) == 4 and all(r["w_mean"] == pytest.approx(1.0) and r["w_min"] <= 1 <= r["w_max"] for r in s)


def labelled(spark, n=1500):
    rng, rows = random.Random(5), []
    for i in range(n):
        a, b, c = rng.random(), rng.random(), rng.random()
        rows.append(("AB"[i % 2], i * DAY, a, b, c, 1 if a + 0.1 * b > 0.55 else -1, (a - 0.5) / 10))
    return spark.createDataFrame(rows, "symbol string, open_time long, a double, b double, c double, target int, future_return double")


def test_permutations_keep_blocks_and_give_importance(spark):
    d = labelled(spark)
    groups = {"a": ["a"], "rest": ["b", "c"]}
    p = models.permuted(d, groups, 2, block=100)
    n, plain = d.count(), d.agg(*(F.round(F.sum(c), 6) for c in "abc")).first()
    for r in p.groupBy("group", "repeat").agg(F.count("*"), *(F.round(F.sum(c), 6) for c in "abc")).collect():
        assert r[2] == n and r[3:] == plain[:]  # each block is dealt out among itself
    own = p.where("group is null").select(*d.columns)
    assert own.exceptAll(d).count() == 0
    moved = p.where("`group` = 'rest' and repeat = 1").join(d.select("symbol", "open_time", F.col("a").alias("a0"), F.col("b").alias("b0"), F.col("c").alias("c0")), ["symbol", "open_time"])
    assert moved.where("a <> a0").count() == 0 and moved.where("b <> b0").count() > 0.9 * n
    pairs = d.select(F.round("b", 9).alias("b"), F.round("c", 9).alias("c"))
    assert moved.select(F.round("b", 9).alias("b"), F.round("c", 9).alias("c")).exceptAll(pairs).count() == 0  # a group moves together
    model = models.fit(d, ["a", "b", "c"], kind="logistic")
    got = {r["feature"]: r["importance"] for r in models.permutation_importance(model, d, ["a", "b", "c"], repeats=3).collect()}
    assert got["a"] > 0.3 and abs(got["c"]) < 0.03 and got["a"] > got["b"]
    # the same by a loop over what was dealt
    one = models.permuted(d.select("symbol", "open_time", "a", "b", "c", "target"), {"a": ["a"]}, 3)
    hit = lambda x: models.score(model, x, ["a", "b", "c"]).agg(F.avg(((F.col("p_up") >= 0.5) == (F.col("target") == 1)).cast("double"))).first()[0]
    drops = [hit(d) - hit(one.where(f"`group` = 'a' and repeat = {r}")) for r in range(3)]
    assert got["a"] == pytest.approx(sum(drops) / 3)


def test_folds_are_evaluated(spark):
    d = labelled(spark, 900)
    folds = spark.createDataFrame([(1, 0, 300 * DAY, 300 * DAY, 450 * DAY), (2, 0, 600 * DAY, 600 * DAY, 900 * DAY), (3, 5000 * DAY, 6000 * DAY, 6000 * DAY, 7000 * DAY)], "fold int, train_from long, train_to long, test_from long, test_to long")
    got = {r["fold"]: r for r in models.evaluate_folds(d, folds, ["a", "b", "c"], threshold=0.5).collect()}
    assert set(got) == {1, 2} and got[1]["rows"] == 150 and got[2]["rows"] == 300 and all(r["win_rate"] > 85 for r in got.values())
    w = spark.createDataFrame([(60.0, 1.5), (40.0, 0.5), (100.0, 999.0)], "win_rate double, profit_factor double")
    assert tuple(models.walk_forward_ml(w).first()) == (3, pytest.approx(200 / 3), pytest.approx(200 / 3), 1.0, True)
    assert tuple(models.walk_forward_ml(w.limit(0)).first())[:4] == (0, 0.0, 0.0, 0.0)


def test_symbol_codes_and_selection(spark):
    d = spark.createDataFrame([("BTCUSDT",), ("SOLUSDT",), ("X",)], "symbol string")
    assert [r["symbol_encoded"] for r in models.with_symbol_code(d).collect()] == [0.0, 2.0, -1.0]
    bars = walk(spark, 100).withColumn("regime", F.when(F.col("open_time") / DAY % 2 == 0, "range").otherwise("trend_up"))
    got = models.selection_data(bars, "range", 1.0, 1.0, 6)
    for s in "AB":
        rows = sorted((r["open_time"], r["role"]) for r in got.where(F.col("symbol") == s).collect())
        k = int(len(rows) * 0.8)
        assert [r for _, r in rows] == ["train"] * k + ["test"] * (len(rows) - k)
    assert got.where("regime <> 'range'").count() == 0


def test_liquidations_against_a_loop(spark):
    rng = random.Random(11)
    for step in (4 * HOUR, 7_777_777):  # on a grid, and on none
        rows = [(s, k * step + 3 * DAY, rng.choice([None, 2.0, 0.5]), 100 + rng.uniform(-3, 3)) for s in "AB" for k in range(12)]
        orders = [("AB"[i % 2], int(rng.uniform(0, 6 * DAY)), 100 + rng.randrange(-40, 40) / 10, float(rng.randrange(1, 9)), rng.choice(["SELL", "buy"])) for i in range(800)]
        orders += [("A", 3 * DAY, 101.0, 50.0, "SELL"), ("A", 3 * DAY, 0.0, 1.0, "BUY"), ("B", 3 * DAY - 1, 99.0, 50.0, "BUY")]
        got = derivs.liquidation_proximity(spark.createDataFrame(rows, "symbol string, open_time long, atr double, close double"), spark.createDataFrame(orders, "symbol string, time long, price double, qty double, side string")).collect()
        assert len(got) == len(rows)
        for r in got:
            near = [(t, p, p * q, s.upper()) for x, t, p, q, s in orders if x == r["symbol"] and p > 0 and r["open_time"] - DAY < t <= r["open_time"]]
            size = (r["atr"] if r["atr"] is not None else r["close"] * 0.005) * 0.1
            now = max((t for t, *_ in near), default=0)
            total, hour = sum(n for _, _, n, _ in near), sum(n for t, _, n, _ in near if t >= now - HOUR)
            dist = {}
            for side, sign in (("SELL", 1), ("BUY", -1)):
                bins = {}
                for _, p, n, s in near:
                    if s == side:
                        bins[math.floor(p / size)] = bins.get(math.floor(p / size), 0) + n
                top = sorted(bins, key=lambda b: (-round(bins[b], 6), b))[:3]
                far = [d for b in top if (d := sign * ((b + 0.5) * size - r["close"]) / r["close"] * 100) > 0]
                dist[side] = min(min(far, default=0.0), 10.0)
            sell = sum(n for _, _, n, s in near if s == "SELL")
            want = (dist["SELL"], dist["BUY"], (2 * sell - total) / total if total else 0.0, min(hour / total, 1.0) if total else 0.0, hour)
            assert tuple(r[c] for c in ("liq_cluster_long_pct", "liq_cluster_short_pct", "liq_imbalance", "liq_cascade_risk", "liq_volume_1h")) == pytest.approx(want), r


def test_a_row_meets_prices_and_not_orders(spark):
    orders = spark.createDataFrame([("A", 1000 * i, 100.0 + i % 5, 1.0, "SELL") for i in range(5000)], "symbol string, time long, price double, n double, side string")
    index = derivs.order_index(orders, HOUR)
    assert index.count() == 5 and index.select(F.sum(F.aggregate("sums", F.lit(0.0), lambda s, x: s + x["n"]))).first()[0] == 5000


def test_small_look_ups(spark, tmp_dir):
    bars = spark.createDataFrame([("A", 1, 10.0, 11.0), ("A", 2, 11.0, 14.0)], "symbol string, open_time long, open double, close double")
    assert tuple(backtest.backtest_averages(bars).first()) == ("A", 12.0, 2)
    e = spark.createDataFrame([(1, "x", 5), (2, "y", 9), (3, "x", 9)], "id long, event_type string, created_at long")
    assert [r["id"] for r in ledger.newest_events(e).collect()] == [3, 2, 1] and [r["id"] for r in ledger.newest_events(e, "x", 1).collect()] == [3]
    t = spark.createDataFrame([(10.0,), (-5.0,), (0.0,)], "pnl double")
    m = backtest.bot_metrics(t, 100.0).first()
    r = [0.1, -0.05, 0.0]
    mean = sum(r) / 3
    std = (sum((x - mean) ** 2 for x in r) / 2) ** 0.5
    assert (m["trades"], m["profit_factor"]) == (3, 2.0) and m["win_rate"] == pytest.approx(1 / 3) and m["sharpe"] == pytest.approx(mean / std * (6 * 365) ** 0.5)
    d = spark.createDataFrame([("A", 1, 0.0, 7), ("A", 2, 5.0, 3), ("A", 9, 5.0, 12)], "symbol string, open_time long, volume double, close_time long")
    assert [tuple(x) for x in store.bar_events(d, "A", 1, 9).select("ts_event", "volume").collect()] == [(3, 5.0), (7, 0.001)]
    f = spark.createDataFrame([("A", 3, 0.1)], "symbol string, fundingTime long, fundingRate double")
    store.write_store(f, f"{tmp_dir}/second", "funding_rate")
    store.write_store(f.limit(0), f"{tmp_dir}/empty", "funding_rate")
    assert store.first_filled(spark, [f"{tmp_dir}/none", f"{tmp_dir}/empty", f"{tmp_dir}/second"], "funding_rate").count() == 1
    assert store.first_filled(spark, [f"{tmp_dir}/none"], "funding_rate") is None


def test_the_library_stands_without_the_subpackage(tmp_dir):
    """A copy without the training-data folders: the entry imports and keeps its own queries; other missing parts are errors."""
    root = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
    copy = f"{tmp_dir}/copy"
    os.makedirs(copy)
    shutil.copytree(f"{root}/tapeloom", f"{copy}/tapeloom", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(f"{root}/__spark_entry__.py", copy)
    code = "import __spark_entry__ as e; q, o = e.queries(), e.oracle_sql(); assert len(q) > 90 and set(o) <= set(q) and not any(n.startswith('op') and n[2].isdigit() for n in q), sorted(q); print(len(q))"
    done = subprocess.run([sys.executable, "-c", code], cwd=copy, env={k: v for k, v in os.environ.items() if k != "PYTHONPATH"}, capture_output=True, text=True, timeout=120)
    assert done.returncode == 0, done.stderr
