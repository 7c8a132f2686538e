"""Features from funding rates and open interest, joined as of each bar."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.lineage import cut
from tapeloom.functions.scalar import DAY_MS, HOUR_MS, clip, flag, safe_divide, zero
from tapeloom.operators.series import SLICE, asof, full, on_slices, rolling, zscore


def bars_for(minutes: int, bar_minutes: int) -> int:
    """Bars that a horizon is about as long as, at least one."""
    return max(1, minutes // max(1, bar_minutes))


def _size(back: int) -> int:
    return max(SLICE, back)


def funding_features(bars: DataFrame, funding: DataFrame, bar_minutes: int = 240) -> DataFrame:
    """The funding rate as of each bar (0 before the first), its size, z-scores over 7 and 30 days, flags and the sum of
    a day (0 until full). An empty funding table gives zeros."""
    d7, d30, d1 = (bars_for(m, bar_minutes) for m in (7 * 1440, 30 * 1440, 1440))
    d = asof(bars, funding.select("symbol", "fundingTime", F.col("fundingRate").cast("double").alias("funding_rate")), "open_time", "fundingTime", ["funding_rate"])
    d = d.withColumn("funding_rate", zero("funding_rate"))

    def step(x, w):
        z7 = zscore("funding_rate", w, d7)
        return x.select(
            "*",
            F.abs("funding_rate").alias("funding_abs"),
            z7.alias("funding_zscore_7d"),
            zscore("funding_rate", w, d30).alias("funding_zscore_30d"),
            flag(F.abs(z7) > 2.0).alias("funding_extreme"),
            flag(F.col("funding_rate") > 0).alias("funding_positive"),
            F.coalesce(full(F.sum("funding_rate").over(rolling(w, d1)), d1), F.lit(0.0)).alias("funding_cum_24h"),
        )

    return on_slices(d, step, d30, size=_size(d30))


def basis_features(bars: DataFrame) -> DataFrame:
    return bars.select("*", F.col("funding_cum_24h").alias("basis_approx"), flag(F.abs("funding_cum_24h") > 0.001).alias("basis_extreme"))


def oi_features(bars: DataFrame, metrics: DataFrame, bar_minutes: int = 240) -> DataFrame:
    """Open interest and positioning as of each bar (0 before the first): changes over 4 and 12 hours, z-scores over 30
    days, and the quadrant of price and open interest (1 up up, 2 up down, -1 down up, -2 else, the first bar too)."""
    h4, h12, d30 = (bars_for(m, bar_minutes) for m in (240, 720, 30 * 1440))
    names = {"sum_open_interest_value": "oi_value", "count_long_short_ratio": "ls_ratio", "sum_taker_long_short_vol_ratio": "taker_vol_ratio"}
    m = metrics.select("symbol", "create_time", *((F.col(a).cast("double") if a in metrics.columns else F.lit(0.0)).alias(b) for a, b in names.items()))
    d = asof(bars, m, "open_time", "create_time", list(names.values()))
    d = d.withColumns({n: zero(n) for n in names.values()})

    def step(x, w):
        change = lambda n: safe_divide(F.col("oi_value") - F.lag("oi_value", n).over(w), F.lag("oi_value", n).over(w))
        x = x.select("*", change(h4).alias("oi_delta_4h"), change(h12).alias("oi_delta_12h"), zscore("oi_value", w, d30).alias("oi_zscore"), zscore("ls_ratio", w, d30).alias("ls_ratio_zscore"), (F.col("close") >= F.lag("close").over(w)).alias("_up"))
        more = F.col("oi_delta_4h") >= 0
        quadrant = F.when(F.col("_up") & more, 1).when(F.col("_up") & ~more, 2).when(~F.col("_up") & more, -1).otherwise(-2)
        return x.withColumn("oi_quadrant", quadrant).drop("_up")

    return on_slices(d, step, d30, size=_size(d30))


def funding_momentum(bars: DataFrame, n: int = 72) -> DataFrame:
    """Changes of the funding rate over 1 and 3 bars, a z-score from 10 bars on, and the change of the change."""

    def step(d, w):
        fr = F.col("funding_rate")
        d = d.select("*", *(zero(fr - F.lag(fr, k).over(w)).alias(f"funding_rate_change_{k}") for k in (1, 3)), zscore(fr, w, n, 10).alias("funding_rate_zscore_rolling"))
        return d.withColumn("funding_rate_acceleration", zero(F.col("funding_rate_change_1") - F.lag("funding_rate_change_1").over(w)))

    return on_slices(bars, step, n + 2)


def oi_derived(bars: DataFrame) -> DataFrame:
    """Change of open interest over one bar, its change, and divergence from the last return. Needs oi_value, returns_1."""

    def step(d, w):
        before = F.lag("oi_value").over(w)
        d = d.withColumn("oi_delta_1h", safe_divide(F.col("oi_value") - before, before))
        d = d.withColumn("oi_accel_vec", zero(F.col("oi_delta_1h") - F.lag("oi_delta_1h").over(w)))
        up, down = F.col("returns_1") > 0, F.col("oi_delta_1h") < 0
        return d.withColumn("oi_price_div_vec", F.when(up & down, 1).when(~up & down, -1).otherwise(0))

    return on_slices(bars, step, 3)


def oi_velocity(bars: DataFrame, n: int = 24) -> DataFrame:
    """Of the last n bars (fewer at the start, from the third on; zeros before): relative change of open interest (0 where
    it was not positive), the change of that, its correlation with the returns of the price, its z-score against the bars
    before, and exhaustion: 60 % of the bars before, and two at least, rose, but this one falls (from the fifth bar on)."""

    def change(c, w):
        before = F.lag(c).over(w)
        return F.when(before > 0, (F.col(c) - before) / before).when(before.isNotNull(), 0.0)

    def step(d, w):
        d = d.select("*", change("oi_value", w).alias("_v"), change("close", w).alias("_r"))
        here, prior = w.rowsBetween(-(n - 2), 0), w.rowsBetween(-(n - 2), -1)
        started, v = F.col("bar_idx") >= 2, F.col("_v")
        deviation = F.stddev_pop("_v").over(prior)
        k = F.count("_v").over(prior)
        tired = (F.col("bar_idx") >= 4) & (F.count(F.when(v > 0, 1)).over(prior) >= F.greatest(F.lit(2), F.floor(k * 0.6))) & (v < 0)
        together = safe_divide(F.covar_pop("_r", "_v").over(here), F.stddev_pop("_r").over(here) * F.stddev_pop("_v").over(here))
        return d.select(
            "*",
            F.when(started, v).otherwise(0.0).alias("oi_velocity"),
            F.when(started, v - F.lag("_v").over(w)).otherwise(0.0).alias("oi_acceleration"),
            F.when(started, clip(together, -1.0, 1.0)).otherwise(0.0).alias("oi_price_divergence"),
            flag(tired).alias("oi_exhaustion"),
            F.when(started & (deviation > 0), (v - F.avg("_v").over(prior)) / deviation).otherwise(0.0).alias("oi_velocity_zscore"),
        ).drop("_v", "_r")

    return on_slices(bars, step, n + 1)


def annualised_basis(perp: DataFrame, spot: DataFrame, n: int = 90, interval_hours: int = 8) -> DataFrame:
    """Perpetual against spot price as of each bar in basis points, with the z-score against the n bars before; the funding
    rate as percent a year, and -1 where that is over 30, 1 where it is under -10, else 0. All 0 without two prices."""
    d = asof(perp, spot.select("symbol", F.col("open_time").alias("spot_time"), F.col("close").alias("spot")), "open_time", "spot_time", ["spot"])
    known = F.coalesce((F.col("spot") > 0) & (F.col("close") > 0), F.lit(False))

    def step(x, w):
        x = x.withColumn("_b", F.when(known, (F.col("close") - F.col("spot")) / F.col("spot") * 10_000.0))
        yearly = F.when(known, zero("funding_rate") * (24.0 / interval_hours) * 365.0 * 100.0).otherwise(0.0)
        prior = w.rowsBetween(-n, -1)
        deviation = F.stddev_pop("_b").over(prior)
        z = F.when(known & (deviation > 0), (F.col("_b") - F.avg("_b").over(prior)) / deviation).otherwise(0.0)
        return x.select("*", F.coalesce("_b", F.lit(0.0)).alias("basis_bps"), yearly.alias("basis_annualized"), z.alias("basis_zscore_30d"), F.when(yearly > 30.0, -1).when(yearly < -10.0, 1).otherwise(0).alias("basis_extreme_sign")).drop("_b")

    return on_slices(d, step, n)


def settlements(marks: DataFrame) -> DataFrame:
    """Funding settlements in a stream of mark-price rows (symbol, ts, rate): the last row of each settlement minute
    (01:00, 09:00 and 17:00 UTC), so that repeated ticks count once."""
    hour, minute = F.pmod(F.floor(F.col("ts") / 3_600_000), F.lit(24)), F.pmod(F.floor(F.col("ts") / 60_000), F.lit(60))
    rows = marks.where(hour.isin(1, 9, 17) & (minute == 0))
    when = (F.floor(F.col("ts") / 3_600_000) * 3_600_000).cast("long")
    return rows.groupBy("symbol", when.alias("settled_at")).agg(F.max_by("rate", F.struct("ts", "rate")).alias("rate"), F.count("*").alias("ticks"))


def sentiment(rows: DataFrame, fear_greed="fear_greed", ratio="long_short_ratio", top_ratio="top_trader_ls_ratio") -> DataFrame:
    """The fear and greed index (50 if unknown) from 0 to 1, its extremes (1 under 20, -1 over 80), how far top traders lean
    from the rest (log ratio over 1.5, held within 1; unknown ratios are 1), and the score of all three, held within 1."""
    index = clip(F.coalesce(F.nanvl(F.col(fear_greed).cast("double"), F.lit(None)), F.lit(50.0)), 0.0, 100.0)
    known = lambda c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(None)), F.lit(1.0))
    lean = F.when((known(ratio) > 0) & (known(top_ratio) > 0), clip(F.ln(known(top_ratio) / known(ratio)) / 1.5, -1.0, 1.0)).otherwise(0.0)
    extreme = F.when(index < 20, 1).when(index > 80, -1).otherwise(0)
    score = 0.6 * (index / 100.0 - 0.5) * 2.0 + 0.4 * lean + 0.2 * extreme
    return rows.select("*", (index / 100.0).alias("fear_greed_norm"), extreme.alias("fear_greed_extreme"), lean.alias("ls_divergence"), clip(score, -1.0, 1.0).alias("sentiment_score"))


#: Grids of time that rows are likely to lie on, in milliseconds, the coarsest first.
GRIDS = (86_400_000, 14_400_000, 3_600_000, 900_000, 300_000, 60_000, 1_000, 1)


def order_index(orders: DataFrame, grid_ms: int) -> DataFrame:
    """Orders (symbol, time, price, qty, side) as a row per symbol, day, side and price: `sums`, an array of (t, n), the notional
    of each interval of the grid, by the grid time that ends it. However many orders there are, a day has a row a price."""
    end = (F.ceil(F.col("time") / grid_ms) * grid_ms).cast("long")
    one = orders.groupBy("symbol", "side", "price", end.alias("t")).agg(F.sum("n").alias("n"))
    return one.groupBy("symbol", F.floor(F.col("t") / DAY_MS).alias("_day"), "side", "price").agg(F.array_sort(F.collect_list(F.struct("t", "n"))).alias("sums"))


def _last_hour(rows: DataFrame, orders: DataFrame, lookback_ms: int) -> DataFrame:
    """rows (symbol, open_time) with _hour: the notional of the last hour before the newest order up to each, no older than the
    look-back; from sums over each day's orders, looked up at both ends."""
    times = orders.groupBy("symbol", F.col("time").alias("_t")).agg(F.sum("n").alias("_n")).withColumn("_day", F.floor(F.col("_t") / DAY_MS))
    days = times.groupBy("symbol", "_day").agg(F.sum("_n").alias("_total"))
    sums = times.withColumn("_c", F.sum("_n").over(Window.partitionBy("symbol", "_day").orderBy("_t").rowsBetween(Window.unboundedPreceding, 0)))
    sums = cut(sums.join(days.select("symbol", (F.col("_day") + 1).alias("_day"), F.col("_total").alias("_before")), ["symbol", "_day"], "left").select("symbol", "_t", "_c", F.coalesce("_before", F.lit(0.0)).alias("_before")), "order-sums")
    look = lambda d, at, p: asof(d, sums.select("symbol", F.col("_t").alias(f"_t{p}"), F.col("_t").alias(f"_at{p}"), F.col("_c").alias(f"_c{p}"), F.col("_before").alias(f"_y{p}")), at, f"_t{p}", [f"_at{p}", f"_c{p}", f"_y{p}"])
    oldest = F.col("open_time") - lookback_ms
    d = look(rows, "open_time", 1).withColumn("_from", F.greatest(F.col("_at1") - HOUR_MS - 1, oldest))
    d = look(cut(d, "newest"), "_from", 2)
    day = lambda c: F.floor(F.col(c) / DAY_MS)
    whole = F.when(day("_from") < day("_at1"), F.col("_y1")).otherwise(0.0)  # of the day before
    gone = F.when(day("_at2") == day("_from"), F.col("_c2")).otherwise(0.0)
    hour = F.when(F.col("_at1") > oldest, F.col("_c1") + whole - gone)
    return d.withColumn("_hour", F.coalesce(hour, F.lit(0.0))).drop("_at1", "_c1", "_y1", "_from", "_at2", "_c2", "_y2")


def liquidation_proximity(rows: DataFrame, liquidations: DataFrame, lookback_hours: int = 24) -> DataFrame:
    """rows (symbol, open_time, close, and atr if there is one) with what the forced orders (symbol, time, price, qty, side) of
    the hours up to each say: the distance in percent (10 at most, 0 without) to the nearest of the three largest clusters of
    SELL orders above the price and of BUY orders below it, the imbalance of their notionals, and the share and the notional of
    the last hour before the newest order. Clusters are bins of a tenth of the atr (of half a percent of the price where it is
    unknown); equal ones rank by price. Orders without a positive price and quantity don't count. All 0 without orders.

    Orders are summed up by price and by the grid of time that all rows lie on, so that a row meets the prices of its days and
    not their orders.
    """
    lookback = lookback_hours * HOUR_MS
    price, atr = F.col("close"), F.col("atr") if "atr" in rows.columns else F.lit(None).cast("double")
    size = F.coalesce(F.nanvl(atr, F.lit(None)), price * 0.005) * 0.1
    key = ["symbol", "open_time"]
    off = rows.agg(*(F.coalesce(F.count_if(F.pmod("open_time", F.lit(g)) != 0), F.lit(0)).alias(str(g)) for g in GRIDS)).first()
    grid = next(g for g in GRIDS if off[str(g)] == 0 and lookback % g == 0)
    orders = liquidations.where("price > 0 and qty > 0").select("symbol", F.col("time"), "price", (F.col("price") * F.col("qty")).alias("n"), F.upper("side").alias("side"))
    asked = rows.where(price > 0).select(*key, price.alias("_p"), F.when(size > 0, size).otherwise(price * 0.0005).alias("_bin"))
    days = F.sequence(F.floor((F.col("open_time") - lookback) / DAY_MS), F.floor(F.col("open_time") / DAY_MS))
    near = asked.withColumn("_day", F.explode(days)).join(order_index(orders, grid), ["symbol", "_day"])
    inside = F.filter("sums", lambda x: (x["t"] <= F.col("open_time")) & (x["t"] > F.col("open_time") - lookback))
    near = near.withColumn("_n", F.aggregate(inside, F.lit(0.0), lambda s, x: s + x["n"])).where(F.size(inside) > 0)
    bins = near.groupBy(*key, "_p", "_bin", F.col("side").alias("_side"), F.floor(F.col("price") / F.col("_bin")).alias("_b")).agg(F.sum("_n").alias("_n"))
    rank = F.row_number().over(Window.partitionBy(*key, "_side").orderBy(F.desc("_n"), "_b"))
    middle = (F.col("_b") + 0.5) * F.col("_bin")
    ranked = bins.withColumn("_k", rank).withColumn("_d", (middle - F.col("_p")) / F.col("_p") * 100.0)
    of = lambda side: F.coalesce(F.sum(F.when(F.col("_side") == side, F.col("_n"))), F.lit(0.0))
    nearest = lambda side, d: F.least(F.coalesce(F.min(F.when((F.col("_side") == side) & (F.col("_k") <= 3) & (d > 0), d)), F.lit(0.0)), F.lit(10.0))
    found = ranked.groupBy(*key).agg(nearest("SELL", F.col("_d")).alias("liq_cluster_long_pct"), nearest("BUY", -F.col("_d")).alias("liq_cluster_short_pct"), safe_divide(of("SELL") - of("BUY"), of("SELL") + of("BUY")).alias("liq_imbalance"), F.sum("_n").alias("_total"))
    hours = _last_hour(asked.select(*key).distinct(), orders, lookback)
    found = found.join(hours, key).withColumns({"liq_cascade_risk": clip(safe_divide("_hour", "_total"), 0.0, 1.0), "liq_volume_1h": F.col("_hour")}).drop("_total", "_hour")
    return rows.join(found, key, "left").fillna(0.0, [c for c in found.columns if c.startswith("liq_")])
