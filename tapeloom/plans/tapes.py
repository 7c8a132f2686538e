"""Tapes derived from the driver's tables, in Spark and (for the checks) in SQL: trades, bars, funding, open interest,
signals. Each SQL text is a common table expression that the queries' SQL is built on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.operators.bars import bars_from_trades

SIX = ("RO", "RF", "AF", "AO", "NO", "NF")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def millis(c):
    return F.unix_millis(F.col(c).cast("timestamp"))


def six(k):
    return F.element_at(F.array(*(F.lit(s) for s in SIX)), (F.pmod(F.col(k), F.lit(6)) + 1).cast("int"))


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events with a positive value: symbol is the event type, price the value, quantity props.k + 1."""
    e = table(spark, sf_dir, "events").where("value > 0")
    k = F.get_json_object("props", "$.k").cast("long")
    return e.select(F.col("event_id").alias("trade_id"), F.col("event_type").alias("symbol"), F.col("value").alias("price"), (k + 1).alias("quantity"), millis("ts").alias("transact_time"), (F.col("event_id") % 2 == 0).alias("is_buyer_maker"))


def bars(spark: SparkSession, sf_dir: str, interval: str = "15m") -> DataFrame:
    return bars_from_trades(trades(spark, sf_dir), interval)


def daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """lineitem as a daily tape: symbol is return flag and status, price the unit price."""
    li = table(spark, sf_dir, "lineitem")
    order = F.struct("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_quantity")
    price = F.col("l_extendedprice") / F.col("l_quantity")
    return (
        li.withColumn("price", price)
        .groupBy(F.concat("l_returnflag", "l_linestatus").alias("symbol"), F.unix_millis(F.col("l_shipdate").cast("timestamp")).alias("open_time"))
        .agg(F.min_by("price", order).alias("open"), F.max("price").alias("high"), F.min("price").alias("low"), F.max_by("price", order).alias("close"), F.sum("l_quantity").cast("double").alias("volume"), F.sum(F.when(F.col("l_linenumber") % 2 == 0, F.col("l_quantity")).otherwise(0)).cast("double").alias("taker_buy_volume"), F.count("*").alias("trade_count"))
    )


def funding(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rate = F.round(F.avg((F.pmod(F.col("o_orderkey"), F.lit(200)) - 100) / 100000), 8)
    return o.groupBy(six("o_orderkey").alias("symbol"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("fundingTime")).agg(rate.alias("fundingRate"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.groupBy(six("o_orderkey").alias("symbol"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("create_time")).agg(
        F.round(F.sum("o_totalprice"), 2).alias("sum_open_interest_value"), (0.5 + (F.count("*") % 10) / 10).alias("count_long_short_ratio"), (0.5 + (F.min("o_custkey") % 10) / 10).alias("sum_taker_long_short_vol_ratio")
    )


def signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as a ledger of signals, each on a hundredth of the account."""
    o = table(spark, sf_dir, "orders")
    k, cust = F.col("o_orderkey"), F.col("o_custkey")
    result = F.when(F.col("o_orderstatus") == "O", "open").when(k % 11 == 0, "rejected").when(k % 10 < 5, "win").when(k % 10 < 9, "loss").otherwise("breakeven")
    created = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    d = o.select(
        k.alias("id"),
        six("o_orderkey").alias("symbol"),
        F.when(F.col("o_orderpriority").substr(1, 1).isin("1", "2"), "long").otherwise("short").alias("direction"),
        F.when(cust % 7 == 0, F.lit(None)).when(cust % 3 == 0, "15m").when(cust % 3 == 1, "1h").otherwise("4h").alias("timeframe"),
        ((50 + cust % 50) / 100).alias("confidence"),
        created.alias("created_at"),
        result.alias("result"),
        F.when(result != "open", created + (4 + k % 90) * 3_600_000).alias("closed_at"),
        (F.when(result == "win", 1 + F.floor("o_totalprice") % 3).when(result == "loss", -(1 + F.floor("o_totalprice") % 3)).when(result == "breakeven", 0).cast("double") / 100.0).alias("pnl_pct"),
        (1 + (cust % 5) / 4).alias("rr_ratio"),
    )
    return d.withColumn("duration_minutes", ((F.col("closed_at") - F.col("created_at")) / 60000).cast("long"))


def users(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select(F.col("c_custkey").alias("user_id"), F.when(F.col("c_acctbal") > 5000, "premium").otherwise("free").alias("role"), (F.col("c_custkey") % 97 == 0).alias("banned"))


def payments(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select(F.col("o_orderkey").alias("payment_id"), F.col("o_custkey").alias("user_id"), F.when(F.col("o_orderstatus") == "F", "paid").otherwise("pending").alias("status"), F.when(F.col("o_orderkey") % 2 == 0, "stars").otherwise("usdt").alias("method"), F.round("o_totalprice", 2).alias("amount_usd"), F.unix_millis(F.col("o_orderdate").cast("timestamp")).alias("created_at"))


_SIX_SQL = "['RO','RF','AF','AO','NO','NF'][cast({0} % 6 as int) + 1]"
TRADES = "trades as (select event_id as trade_id, event_type as symbol, value as price, cast(json_extract_string(props, '$.k') as bigint) + 1 as quantity, epoch_us(ts) // 1000 as transact_time, event_id % 2 = 0 as is_buyer_maker from events where value > 0)"


def bars_sql(interval: str = "15m", name: str | None = None) -> str:
    from tapeloom.operators.bars import INTERVALS

    ms = INTERVALS[interval]
    return f"""{name or 'bars'} as (select symbol, transact_time // {ms} * {ms} as open_time,
      arg_min(price, (transact_time, trade_id)) as open, max(price) as high, min(price) as low, arg_max(price, (transact_time, trade_id)) as close,
      cast(sum(quantity) as double) as volume, cast(coalesce(sum(quantity) filter (not is_buyer_maker), 0) as double) as taker_buy_volume,
      sum(price * quantity) as quote_volume, count(*) as trade_count from trades group by 1, 2)"""


DAILY = """bars as (select l_returnflag || l_linestatus as symbol, epoch_ms(cast(l_shipdate as timestamp)) as open_time,
  arg_min(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) as open,
  max(l_extendedprice / l_quantity) as high, min(l_extendedprice / l_quantity) as low,
  arg_max(l_extendedprice / l_quantity, (l_orderkey, l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_quantity)) as close,
  cast(sum(l_quantity) as double) as volume, cast(sum(case when l_linenumber % 2 = 0 then l_quantity else 0 end) as double) as taker_buy_volume,
  count(*) as trade_count from lineitem group by 1, 2)"""
FUNDING = f"""funding as (select {_SIX_SQL.format('o_orderkey')} as symbol, epoch_ms(cast(o_orderdate as timestamp)) as fundingTime,
  round(avg((o_orderkey % 200 - 100) / 100000.0), 8) as fundingRate from orders group by 1, 2)"""
METRICS = f"""metrics as (select {_SIX_SQL.format('o_orderkey')} as symbol, epoch_ms(cast(o_orderdate as timestamp)) as create_time,
  round(sum(o_totalprice), 2) as sum_open_interest_value, 0.5 + cast(count(*) % 10 as double) / 10 as count_long_short_ratio,
  0.5 + cast(min(o_custkey) % 10 as double) / 10 as sum_taker_long_short_vol_ratio from orders group by 1, 2)"""
SIGNALS = f"""sig0 as (select *, case when o_orderstatus = 'O' then 'open' when o_orderkey % 11 = 0 then 'rejected' when o_orderkey % 10 < 5 then 'win'
    when o_orderkey % 10 < 9 then 'loss' else 'breakeven' end as result, epoch_ms(cast(o_orderdate as timestamp)) as created_at from orders),
signals as (select o_orderkey as id, {_SIX_SQL.format('o_orderkey')} as symbol,
    case when substr(o_orderpriority, 1, 1) in ('1', '2') then 'long' else 'short' end as direction,
    case when o_custkey % 7 = 0 then null when o_custkey % 3 = 0 then '15m' when o_custkey % 3 = 1 then '1h' else '4h' end as timeframe,
    (50 + o_custkey % 50) / 100.0::double as confidence, created_at, result,
    case when result <> 'open' then created_at + (4 + o_orderkey % 90) * 3600000 end as closed_at,
    cast(case result when 'win' then 1 + floor(o_totalprice) % 3 when 'loss' then -(1 + floor(o_totalprice) % 3) when 'breakeven' then 0 end as double) / 100.0::double as pnl_pct,
    1 + (o_custkey % 5) / 4.0::double as rr_ratio,
    case when result <> 'open' then (4 + o_orderkey % 90) * 60 end as duration_minutes from sig0)"""
USERS = "users as (select c_custkey as user_id, case when c_acctbal > 5000 then 'premium' else 'free' end as role, c_custkey % 97 = 0 as banned from customer)"
PAYMENTS = "payments as (select o_orderkey as payment_id, o_custkey as user_id, case when o_orderstatus = 'F' then 'paid' else 'pending' end as status, case when o_orderkey % 2 = 0 then 'stars' else 'usdt' end as method, round(o_totalprice, 2) as amount_usd, epoch_ms(cast(o_orderdate as timestamp)) as created_at from orders)"


def with_(*ctes: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",\n".join(ctes)


def div(a: str, b: str, fill: str = "0.0") -> str:
    return f"coalesce(case when ({b}) = 0 then {fill} when isnan(cast(({a}) / ({b}) as double)) then {fill} else ({a}) / ({b}) end, {fill})"


def out(*columns: str, digits: int = 6) -> str:
    """Expressions 'x as name' rounded; 'name' alone stays as it is."""
    done = []
    for c in columns:
        e, _, n = c.rpartition(" as ")
        done.append(f"round({e}, {digits}) + 0.0 as {n}" if e else c)
    return ", ".join(done)
