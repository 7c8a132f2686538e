"""The store's round trips, and streams that equal the batch operators."""

import os

from pyspark.sql import functions as F

from tapeloom.operators import models
from tapeloom.operators.bars import bars_from_trades
from tapeloom.plans import live, tapes
from tapeloom.sources import store
from tapeloom.streaming import streams

SF = "/root/testdata/sf0.001"
KLINES = "open_time,open,high,low,close,volume,close_time,quote_volume,count,taker_buy_volume,taker_buy_quote_volume,ignore\n"


def test_csv_to_store_and_back(spark, tmp_dir):
    day = 86_400_000
    for k in range(2):
        with open(f"{tmp_dir}/X-4h-2024-01-0{k + 1}.csv", "w") as f:
            f.write(KLINES)
            for i in range(6):
                t = 1_704_067_200_000 + k * day + i * 14_400_000
                f.write(f"{t},1.0,2.0,0.5,{'NA' if i == 2 else 1.5},{'bad' if i == 3 else 10},{t + 1},5,7,4,2,0\n")
    d = store.read_csv(spark, f"{tmp_dir}/*.csv", "klines_4h", "XUSDT")
    assert d.count() == 12 and d.where("_bad").count() == 2 and d.where("close is null").count() == 2
    assert {r[0] for r in d.select("_file_date").distinct().collect()} == {"2024-01-01", "2024-01-02"}
    root, manifest = f"{tmp_dir}/store", f"{tmp_dir}/manifest"
    first = store.convert(spark, f"{tmp_dir}/*.csv", root, "klines_4h", "XUSDT", manifest).first()
    assert tuple(first) == (2, 0, 0, 0)
    again = store.convert(spark, f"{tmp_dir}/*.csv", root, "klines_4h", "XUSDT", manifest).first()
    assert tuple(again) == (0, 2, 0, 0)
    t = store.store(spark, root, "klines_4h")
    got = store.scan(t, "XUSDT", 1_704_067_200_000 + day, 1_704_067_200_000 + day + 14_400_000, ["open_time", "close"])
    assert got.count() == 2 and "PartitionFilters: [isnotnull(symbol" in got._jdf.queryExecution().toString()
    inv = store.inventory(spark, root, "klines_4h").first()
    assert (inv["rows"], inv["first_date"], inv["last_date"]) == (12, "2024-01-01", "2024-01-02")
    assert store.validate_files(spark, f"{root}/klines_4h", "open_time").where("not valid").count() == 0


def test_times_as_text_and_headerless_files(spark, tmp_dir):
    with open(f"{tmp_dir}/m.csv", "w") as f:
        f.write("create_time,symbol,a,b,c,d,e,f\n2024-01-01 00:05:00,X,1,2,3,4,5,6\n")
    assert store.read_csv(spark, f"{tmp_dir}/m.csv", "metrics").first()["create_time"] == 1_704_067_500_000
    with open(f"{tmp_dir}/k.csv", "w") as f:
        f.write("1704067200000,1,2,0.5,1.5,10,1704067201000,5,7,4,2\n")
    r = store.read_kline_files(spark, f"{tmp_dir}/k.csv", "X", "1h").first()
    assert (r["close"], r["trade_count"], r["interval"]) == (1.5, 7, "1h")


def test_checksums(spark, tmp_dir):
    import hashlib

    with open(f"{tmp_dir}/a.zip", "wb") as f:
        f.write(b"abc")
    p = spark.createDataFrame([("a.zip", hashlib.sha256(b"abc").hexdigest())], "name string, sha256 string")
    assert store.checksums(spark, f"{tmp_dir}/*.zip", p).first()["state"] == "ok"


def test_dedup_and_source_choice(spark):
    a = spark.createDataFrame([("A", 1, 1.0), ("A", 2, 2.0)], "symbol string, open_time long, close double")
    b = spark.createDataFrame([("A", 2, 9.0), ("B", 1, 3.0)], "symbol string, open_time long, close double")
    assert sorted(map(tuple, store.deduplicated(a, b).collect())) == [("A", 1, 1.0), ("A", 2, 9.0), ("B", 1, 3.0)]
    assert sorted(map(tuple, store.better_source(a, b, 3, 1).collect())) == [("A", 1, 1.0), ("A", 2, 2.0), ("B", 1, 3.0)]


def run(query_df, name, mode):
    q = query_df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(180)
    assert q.exception() is None
    return query_df.sparkSession.table(name)


def source(spark, tmp_dir):
    t = tapes.trades(spark, SF)
    end = t.agg(F.max("transact_time")).first()[0]
    late = t.limit(1).withColumn("transact_time", F.lit(end + 10 * 86_400_000)).withColumn("symbol", F.lit("zzz"))  # closes all windows
    path = f"{tmp_dir}/trades"
    t.coalesce(1).write.parquet(path)
    late.coalesce(1).write.mode("append").parquet(path)
    return t, spark.readStream.schema(t.schema).option("maxFilesPerTrigger", 1).parquet(path)


def test_streamed_bars_equal_batch_bars(spark, tmp_dir):
    t, s = source(spark, tmp_dir)
    cols = ["symbol", "open_time", "open", "high", "low", "close", "volume", "taker_buy_volume", "trade_count"]
    d = streams.streaming_bars(s, late="40 days")
    got = {tuple(r) for r in run(d, "bars", "update").where("symbol <> 'zzz'").groupBy("symbol", "open_time").agg(*(F.max_by(c, "trade_count").alias(c) for c in cols[2:])).select(cols).collect()}
    assert got == {tuple(r) for r in bars_from_trades(t, "15m").select(cols).collect()}


def test_keyed_state(spark, tmp_dir):
    t, s = source(spark, tmp_dir)
    last = {r["symbol"]: r["held"] for r in run(streams.last_trades(s, 50), "last", "update").collect()}
    counts = {r["symbol"]: r["count"] for r in t.groupBy("symbol").count().collect()}
    assert all(last[k] == min(50, n) for k, n in counts.items())
    path = f"{tmp_dir}/reg"
    spark.createDataFrame([("A", i, "range" if i // 3 % 2 == 0 else "trend_up") for i in range(9)], "symbol string, open_time long, regime string").write.parquet(path)
    ch = run(streams.regime_changes(spark.readStream.schema("symbol string, open_time long, regime string").parquet(path)), "ch", "append").orderBy("open_time").collect()
    assert [(r["open_time"], r["to_regime"]) for r in ch] == [(3, "trend_up"), (6, "range")]


def test_book_and_latency(spark):
    b = spark.createDataFrame([("A", 1, [(10.0, 3.0), (9.0, 1.0)], [(11.0, 1.0), (12.0, 1.0)])], "symbol string, ts long, bids array<struct<price:double,qty:double>>, asks array<struct<price:double,qty:double>>")
    r = streams.book_imbalance(b, 1).first()
    assert (r["bid_qty"], r["ask_qty"], r["imbalance"]) == (3.0, 1.0, 0.5)
    x = streams.with_latency(spark.createDataFrame([(1000, 2500, True), (1000, 1500, False)], "transact_time long, received_at long, is_buyer_maker boolean")).collect()
    assert [(r["latency_ms"], r["side"], r["slow"]) for r in x] == [(1500, "sell", True), (500, "buy", False)]


def test_model_learns_and_scores(spark):
    d = spark.range(600).select(F.lit("A").alias("symbol"), (F.col("id") * 3_600_000).alias("open_time"), F.when(F.col("id") % 10 == 0, None).otherwise(F.sin(F.col("id"))).alias("a"), F.cos("id").alias("b")).withColumn("target", F.when(F.coalesce("a", F.lit(0.0)) > 0, 1).otherwise(-1))
    m = models.fit(d, ["a", "b"], kind="logistic")
    s = models.score(m, d, ["a", "b"])
    assert models.auc(s) > 0.95 and s.where("confidence < 0.5").count() == 0
    names, corr = models.correlation_matrix(d, ["a", "b"])
    assert names == ["a", "b"] and corr.shape == (2, 2)
    assert models.feature_clusters(["a", "b", "c"], [[1, 0.95, 0], [0.95, 1, 0], [0, 0, 1]], {"a": 1.0, "b": 2.0, "c": 0.5}, floor=1) == {"kept": ["b", "c"], "dropped": ["a"]}


def test_registry_is_whole():
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries()) and len(e.queries()) > 70 and os.path.isdir(SF)


def test_a_range_of_a_stream_is_written_by_many_tasks(spark, monkeypatch):
    """All files of a range of time come in one trigger, also where a range has few rows or none."""
    paths, scratch = [], live.scratch
    monkeypatch.setattr(live, "scratch", lambda *a: paths.append(scratch(*a)) or paths[-1])
    monkeypatch.setattr(live, "FILE_ROWS", 10, raising=False)
    rows = spark.range(1000).select((F.when(F.col("id") < 900, F.col("id") % 100).when(F.col("id") < 999, 250 + F.col("id") % 10).otherwise(400)).alias("t"), "id").repartition(6)
    got = live.run(spark, live.source(spark, rows, "t", rows.limit(1).withColumn("t", F.lit(999))), "append").cache()
    assert got.select("t", "id").where("t < 999").exceptAll(rows).count() == 0 and got.count() == 1001
    ranges = {r["epoch"]: (r["a"], r["b"]) for r in got.groupBy("epoch").agg(F.min("t").alias("a"), F.max("t").alias("b")).collect()}
    assert ranges == {0: (0, 99), 2: (250, 259), 3: (400, 400), 4: (999, 999)}
    assert len([x for x in os.listdir(paths[0]) if x.startswith("part-")]) > 5  # more than one for each range
