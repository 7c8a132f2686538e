"""Data-quality checks over bars, partitions, ledgers and feature tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.scalar import DAY_MS, safe_divide
from tapeloom.operators.bars import INTERVALS
from tapeloom.operators.series import SLICE, on_slices


def completeness(rows: DataFrame, ts: str = "open_time", by: str = "symbol", monthly: bool = False, first: str | None = None, last: str | None = None, listed: int = 50) -> DataFrame:
    """Days (or months) from the first to the last (or as given) against those found: counts, percentage with 4 digits, the
    first missing ones."""
    unit = "month" if monthly else "day"
    period = F.to_date(F.date_trunc(unit, F.timestamp_millis(F.col(ts))))
    found = rows.select(by, period.alias("p")).distinct()
    ends = found.groupBy(by).agg(F.lit(first).cast("date").alias("a") if first else F.min("p").alias("a"), F.lit(last).cast("date").alias("b") if last else F.max("p").alias("b"))
    step = F.expr("interval 1 month" if monthly else "interval 1 day")
    expected = ends.select(by, F.explode(F.sequence("a", "b", step)).alias("p"))
    d = expected.join(found.withColumn("have", F.lit(1)), [by, "p"], "left")
    missing = F.array_sort(F.collect_list(F.when(F.col("have").isNull(), F.date_format("p", "yyyy-MM" if monthly else "yyyy-MM-dd"))))
    return d.groupBy(by).agg(F.count("*").alias("expected"), F.count("have").alias("found"), F.round(safe_divide(F.count("have") * 100.0, F.count("*")), 4).alias("pct"), F.slice(missing, 1, listed).alias("missing"))


def bar_completeness(bars: DataFrame, interval: str) -> DataFrame:
    """Per symbol: bars, distinct times, duplicates, expected bars of its days, percentage, bars with values of 0 or less."""
    a_day = DAY_MS // INTERVALS[interval]
    bad = F.least("open", "high", "low", "close") <= 0
    d = bars.groupBy("symbol").agg(F.count("*").alias("bars"), F.countDistinct("open_time").alias("distinct_times"), F.countDistinct(F.floor(F.col("open_time") / DAY_MS)).alias("days"), F.count_if(bad).alias("non_positive"), F.count_if(F.col("volume") < 0).alias("negative_volume"))
    return d.select("symbol", "bars", (F.col("bars") - F.col("distinct_times")).alias("duplicates"), (F.col("days") * a_day).alias("expected"), F.round(safe_divide(F.col("distinct_times") * 100.0, F.col("days") * a_day), 4).alias("pct"), "non_positive", "negative_volume")


def gaps(rows: DataFrame, threshold_ms: int, ts: str = "open_time") -> DataFrame:
    """Steps in time over the threshold: (symbol, gap_from, gap_to, gap_ms)."""
    d = on_slices(rows, lambda x, w: x.withColumn("gap_from", F.lag(ts).over(w)), 1, ts=ts)
    return d.where(F.col(ts) - F.col("gap_from") > threshold_ms).select("symbol", "gap_from", F.col(ts).alias("gap_to"), (F.col(ts) - F.col("gap_from")).alias("gap_ms"))


def largest_gaps(rows: DataFrame, threshold_ms: int, n: int = 10, ts: str = "open_time") -> DataFrame:
    return gaps(rows, threshold_ms, ts).orderBy(F.desc("gap_ms"), "symbol", "gap_from").limit(n)


def continuity(bars: DataFrame, interval: str, jump: float = 0.15) -> DataFrame:
    """Per symbol: steps that are not one bar, and closes that jump by more than `jump`."""

    def step(d, w):
        return d.select("*", F.lag("open_time").over(w).alias("_t"), F.lag("close").over(w).alias("_c"))

    d = on_slices(bars, step, 1)
    return d.groupBy("symbol").agg(F.count_if(F.col("open_time") - F.col("_t") != INTERVALS[interval]).alias("breaks"), F.count_if(F.abs(safe_divide(F.col("close") - F.col("_c"), F.col("_c"))) > jump).alias("jumps"))


def null_counts(rows: DataFrame, columns: list[str], by: list[str] | None = None) -> DataFrame:
    """(by, column, nulls): missing or NaN values of every column in one pass, one row each."""
    types = dict(rows.dtypes)
    miss = lambda c: F.count_if(F.col(c).isNull() | F.isnan(c) if types[c] in ("double", "float") else F.col(c).isNull())
    one = rows.groupBy(*(by or [])).agg(*(miss(c).alias(c) for c in columns))
    stack = ", ".join(f"'{c}', `{c}`" for c in columns)
    return one.selectExpr(*(by or []), f"stack({len(columns)}, {stack}) as (column, nulls)")


def anomalies(bars: DataFrame, funding: DataFrame | None = None, metrics: DataFrame | None = None, trades: DataFrame | None = None) -> DataFrame:
    """(source, rule, symbol, n): rows out of their domain."""
    parts = [("bars", bars, {"high_below_low": F.col("high") < F.col("low"), "close_not_positive": F.col("close") <= 0, "negative_volume": F.col("volume") < 0})]
    if funding is not None:
        parts.append(("funding", funding, {"extreme_rate": F.abs("fundingRate") >= 0.05}))
    if metrics is not None:
        parts.append(("metrics", metrics, {"negative_open_interest": F.col("sum_open_interest_value") < 0}))
    if trades is not None:
        parts.append(("trades", trades, {"price_not_positive": F.col("price") <= 0, "quantity_not_positive": F.col("quantity") <= 0}))
    out = None
    for source, d, rules in parts:
        one = d.groupBy("symbol").agg(*(F.count_if(c).alias(n) for n, c in rules.items()))
        rows = one.selectExpr(f"'{source}' as source", "symbol", f"stack({len(rules)}, {', '.join(f'{chr(39)}{n}{chr(39)}, `{n}`' for n in rules)}) as (rule, n)").select("source", "rule", "symbol", "n")
        out = rows if out is None else out.unionByName(rows)
    return out


def clock_drift(rows: DataFrame, ts: str = "transact_time", file: str = "_file", order: str = "_pos", size: int = SLICE) -> DataFrame:
    """Per file, over all its rows: whether times never go back, and the longest step.

    A range of `size` positions is summed up as its first and last time, and its least and longest step; the steps between
    ranges come from those summaries, so that a file is as many tasks as it has ranges.
    """
    part = [file, "_s"]
    d = rows.withColumn("_s", F.floor(F.col(order) / size))
    d = d.withColumn("_d", F.col(ts) - F.lag(ts).over(Window.partitionBy(*part).orderBy(order)))
    one = d.groupBy(*part).agg(F.count("*").alias("n"), F.min_by(ts, order).alias("_first"), F.max_by(ts, order).alias("_last"), F.min("_d").alias("_least"), F.max("_d").alias("_most"))
    one = one.withColumn("_x", F.col("_first") - F.lag("_last").over(Window.partitionBy(file).orderBy("_s")))
    least, most = F.min(F.least("_least", "_x")), F.max(F.greatest("_most", "_x"))
    return one.groupBy(file).agg(F.sum("n").alias("rows"), F.coalesce(least >= 0, F.lit(True)).alias("monotonic"), F.coalesce(most, F.lit(0)).alias("max_step_ms"))


def report(bars: DataFrame, interval: str, threshold: float = 99.9) -> DataFrame:
    """Per symbol: completeness, gaps, nulls, anomalies and whether all is well."""
    full = bar_completeness(bars, interval)
    g = gaps(bars, INTERVALS[interval]).groupBy("symbol").agg(F.count("*").alias("gaps"))
    n = null_counts(bars, ["open", "high", "low", "close", "volume"], ["symbol"]).groupBy("symbol").agg(F.sum("nulls").alias("nulls"))
    a = anomalies(bars).groupBy("symbol").agg(F.sum("n").alias("anomalies"))
    d = full.join(g, "symbol", "left").join(n, "symbol", "left").join(a, "symbol", "left").fillna(0, ["gaps", "nulls", "anomalies"])
    ok = (F.col("pct") >= threshold) & (F.col("gaps") == 0) & (F.col("nulls") == 0) & (F.col("anomalies") == 0) & (F.col("duplicates") == 0)
    return d.select("symbol", "bars", "expected", "pct", "duplicates", "gaps", "nulls", "anomalies", ok.alias("passed"))


def parity(one: DataFrame, other: DataFrame, key: list[str], columns: list[str], tolerance: float = 1e-6) -> DataFrame:
    """(column, rows, mismatches, mean and largest relative difference) of two builds of the same rows; a value missing on
    one side only is a mismatch."""
    d = one.select(*key, *(F.col(c).cast("double").alias(f"a_{c}") for c in columns)).join(other.select(*key, *(F.col(c).cast("double").alias(f"b_{c}") for c in columns)), key)
    long = d.selectExpr(*key, f"stack({len(columns)}, {', '.join(f'{chr(39)}{c}{chr(39)}, a_{c}, b_{c}' for c in columns)}) as (column, a, b)")
    diff = safe_divide(F.abs(F.col("a") - F.col("b")), F.greatest(F.abs("a"), F.abs("b")))
    off = (diff > tolerance) | (F.col("a").isNull() != F.col("b").isNull())
    return long.groupBy("column").agg(F.count("*").alias("rows"), F.count_if(off).alias("mismatches"), F.avg(diff).alias("mean_diff"), F.max(diff).alias("max_diff"))


def freshness(rows: DataFrame, sources: list[str], now_ms: int, stale_ms: int, source: str = "source", ts: str = "created_at") -> DataFrame:
    """Per expected source: never, stale or fresh by its newest row, and its lag."""
    dim = rows.sparkSession.createDataFrame([(s,) for s in sources], f"{source} string")
    got = rows.groupBy(source).agg(F.max(ts).alias("newest"), F.count("*").alias("rows"))
    lag = F.lit(now_ms) - F.col("newest")
    return F.broadcast(dim).join(got, source, "left").select(source, "newest", F.coalesce("rows", F.lit(0)).alias("rows"), lag.alias("lag_ms"), F.when(F.col("newest").isNull(), "never").when(lag > stale_ms, "stale").otherwise("fresh").alias("state"))


def published(payloads: DataFrame, ledger_newest: DataFrame, column: str = "payload", max_lag_s: int = 300) -> DataFrame:
    """Classes of a published freshness value {"last_signal_age": number or null} per source: absent, none, number or
    corrupt; and whether a number lags the ledger by more than max_lag_s."""
    text = F.col(column)
    raw = F.get_json_object(text, "$.last_signal_ts")
    has = text.rlike('"last_signal_ts"')
    value = raw.try_cast("long")
    kind = F.when(text.isNull() | ~has, "absent").when(text.rlike(r'"last_signal_ts"\s*:\s*null'), "none").when(value.isNotNull(), "number").otherwise("corrupt")
    d = payloads.withColumn("kind", kind).withColumn("published_ts", value).join(ledger_newest, "source", "left")
    return d.withColumn("lags", F.coalesce((F.col("newest") - F.col("published_ts")) / 1000 > max_lag_s, F.lit(False)))


def alerts_due(events: DataFrame, last_alerts: DataFrame, now_ms: int, cooldown_ms: int) -> DataFrame:
    """Events (source, event) whose last alert is older than the cool-down, or that never had one."""
    d = events.join(last_alerts.select("source", "event", "alerted_at"), ["source", "event"], "left")
    return d.where(F.col("alerted_at").isNull() | (F.lit(now_ms) - F.col("alerted_at") >= cooldown_ms))


# Words in a column's name that say it looks ahead.
LEAK_WORDS = ("target", "label", "future", "t1_bar", "fwd", "next")


def leak_audit(rows: DataFrame, target: str, limit: float = 0.9) -> DataFrame:
    """(column, suspicious_name, corr, leak) of every numeric column: its name, and its correlation with the target from
    moments (0 if undefined)."""
    cols = [n for n, t in rows.dtypes if t in ("double", "float", "int", "bigint", "tinyint", "smallint") and n != target]
    y = F.col(target).cast("double")
    moments = [m for c in cols for x in [F.col(c).cast("double")] for m in (F.avg(x).alias(f"m_{c}"), F.avg(x * x).alias(f"q_{c}"), F.avg(x * y).alias(f"p_{c}"))]
    one = rows.where(y.isNotNull()).agg(F.avg(y).alias("_y"), F.avg(y * y).alias("_yy"), *moments)
    long = one.selectExpr("_y", "_yy", f"stack({len(cols)}, {', '.join(f'{chr(39)}{c}{chr(39)}, m_{c}, q_{c}, p_{c}' for c in cols)}) as (column, m, q, p)")
    var = F.greatest(F.col("q") - F.col("m") * F.col("m"), F.lit(0.0)) * F.greatest(F.col("_yy") - F.col("_y") * F.col("_y"), F.lit(0.0))
    corr = safe_divide(F.col("p") - F.col("m") * F.col("_y"), F.sqrt(var))
    named = F.lower("column").rlike("|".join(LEAK_WORDS))
    return long.select("column", named.alias("suspicious_name"), corr.alias("corr"), (named | (F.abs(corr) > limit)).alias("leak"))
