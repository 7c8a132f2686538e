"""Forward labels, overlap weights, leakage-safe splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.functions.lineage import cut
from tapeloom.functions.scalar import DAY_MS, safe_divide
from tapeloom.operators.series import SLICE, index_bars, on_slices


def fixed_horizon(bars: DataFrame, k: int = 6) -> DataFrame:
    """target: 1 where the close is higher k bars on, else -1; future_return. The last k bars of each symbol are left out."""

    def step(d, w):
        ahead = F.lead("close", k).over(w)
        return d.select("*", safe_divide(ahead - F.col("close"), F.col("close")).alias("future_return"), F.when(ahead > F.col("close"), 1).otherwise(-1).alias("target"), ahead.isNotNull().alias("_ok"))

    return on_slices(bars, step, 0, k).where("_ok").drop("_ok")


def triple_barrier(bars: DataFrame, up: float = 1.5, down: float = 1.5, horizon: int = 8, min_atr: float = 0.005, touch: str = "close") -> DataFrame:
    """label (1, -1 or 0), future_return at the exit's close, t1_bar (number of the exit bar).

    Barriers are close * (1 + up * atr) and close * (1 - down * atr), atr at least min_atr (also where it is undefined). The
    first bar ahead that touches one decides, the upper one first; without a touch the label is 0 at the horizon. touch
    'hl' looks at highs and lows instead of closes. The last `horizon` bars are left out; nothing further ahead is read.
    """

    def step(d, w):
        a = F.greatest(F.coalesce(F.nanvl("atr_pct", F.lit(min_atr)), F.lit(min_atr)), F.lit(min_atr))
        high, low = F.col("close") * (1 + up * a), F.col("close") * (1 - down * a)
        top, bottom = ("close", "close") if touch == "close" else ("high", "low")
        # the places ahead that touch, in order; the first is the exit
        hit = F.array(*(F.when(F.lead(top, k).over(w) >= F.col("_high"), k).when(F.lead(bottom, k).over(w) <= F.col("_low"), -k) for k in range(1, horizon + 1)))
        d = d.withColumn("_high", high).withColumn("_low", low).withColumn("_hit", F.try_element_at(F.array_compact(hit), F.lit(1)))
        k = F.coalesce(F.abs("_hit"), F.lit(horizon))
        ahead = F.coalesce(*(F.when(k == n, F.lead("close", n).over(w)) for n in range(1, horizon + 1)))
        return d.select("*", F.when(F.col("_hit") > 0, 1).when(F.col("_hit") < 0, -1).otherwise(0).alias("label"), safe_divide(ahead - F.col("close"), F.col("close")).alias("future_return"), (F.col("bar_idx") + k).alias("t1_bar"), F.lead("close", horizon).over(w).isNotNull().alias("_ok"))

    return on_slices(bars, step, 0, horizon).where("_ok").drop("_ok", "_hit", "_high", "_low")


def target_rows(labelled: DataFrame) -> DataFrame:
    """Rows with a decided label, with the bar number they had before: _bar_idx, target."""
    return labelled.where("label <> 0").withColumn("_bar_idx", F.col("bar_idx")).withColumnRenamed("label", "target")


def label_statistics(labelled: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Counts and percentages of labels and the share that is not 0."""
    n = F.count("*")
    count = lambda v: F.count_if(F.col("label") == v)
    pct = lambda c: F.round(safe_divide(c * 100.0, n), 4)
    return labelled.groupBy(*(by or [])).agg(n.alias("total"), *(count(v).alias(name) for name, v in (("long_n", 1), ("short_n", -1), ("vertical_n", 0))), *(pct(count(v)).alias(name) for name, v in (("long_pct", 1), ("short_pct", -1), ("vertical_pct", 0))), pct(count(1) + count(-1)).alias("coverage"))


def uniqueness_weights(spans: DataFrame, first: str = "_bar_idx", last: str = "t1_bar", size: int = SLICE) -> DataFrame:
    """Weight of a labelled row: the mean of 1 / (labels that overlap a bar) over its span, divided by the symbol's mean.

    A sweep over the ends of the spans: between two ends the number of labels stays, so the sum of 1 / labels up to an end is
    a prefix sum over the ends before it, and a span's sum the difference of its two. How long spans are is of no matter. Ends
    are swept slice by slice; what a slice inherits comes from a row per symbol and slice.
    """
    ends = F.array(F.struct(F.col(first).alias("p"), F.lit(1).alias("d")), F.struct((F.col(last) + 1).alias("p"), F.lit(-1).alias("d")))
    rows = spans.where(F.col(first).isNotNull() & F.col(last).isNotNull()).select(F.monotonically_increasing_id().alias("_row"), F.col("symbol").alias("_k"), (F.col(last) - F.col(first) + 1).alias("_n"), F.struct(*spans.columns).alias("_r"), ends.alias("_e")).withColumn("_e", F.explode("_e"))
    at = cut(rows.select("_row", "_k", "_n", F.when(F.col("_e.d") == 1, F.col("_r")).alias("_r"), F.col("_e.p").alias("_p"), F.col("_e.d").alias("_d"), F.floor(F.col("_e.p") / size).alias("_s")), "ends")

    def inherited(d, *aggs):
        """Per symbol and slice what the slices before it add up to."""
        before = Window.partitionBy("_k").orderBy("_s").rowsBetween(Window.unboundedPreceding, -1)
        return d.groupBy("_k", "_s").agg(*(f(c).alias(n) for n, f, c, _ in aggs)).select("_k", "_s", *(g(n).over(before).alias(n) for n, _, _, g in aggs))

    inside = Window.partitionBy("_k", "_s").orderBy("_p")
    past, here = inside.rangeBetween(Window.unboundedPreceding, -1), inside.rangeBetween(Window.unboundedPreceding, 0)
    x = at.join(inherited(at, ("_c0", F.sum, "_d", F.sum), ("_p0", F.max, "_p", F.max)), ["_k", "_s"])
    load = F.coalesce("_c0", F.lit(0)) + F.coalesce(F.sum("_d").over(past), F.lit(0))  # labels over the bars since the end before
    gap = F.when(load > 0, (F.col("_p") - F.coalesce(F.max("_p").over(past), "_p0")) / load)
    x = x.withColumn("_g", F.when(F.row_number().over(inside) == F.rank().over(inside), gap))  # once an end
    x = cut(x.select("_row", "_k", "_n", "_r", "_d", "_s", F.coalesce(F.sum("_g").over(here), F.lit(0.0)).alias("_h")), "sweep")
    x = x.join(inherited(x, ("_h0", F.max, "_h", F.sum)).select("_k", "_s", F.coalesce("_h0", F.lit(0.0)).alias("_h0")), ["_k", "_s"])
    own = x.groupBy("_row", "_k", "_n").agg(F.first("_r", ignorenulls=True).alias("_r"), (F.sum(-F.col("_d") * F.col("_h")) + F.sum(-F.col("_d") * F.col("_h0"))).alias("_u"))
    own = cut(own.select("_k", "_r", (F.col("_u") / F.col("_n")).alias("_u")), "uniqueness")
    mean = own.groupBy("_k").agg(F.avg("_u").alias("_m"))
    return own.join(mean, "_k").select("_r.*", safe_divide("_u", "_m", 1.0).alias("weight"))


def weight_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Rows, and the least, largest and mean weight."""
    return rows.groupBy(*(by or [])).agg(F.count("*").alias("rows"), F.min("weight").alias("min_weight"), F.max("weight").alias("max_weight"), F.avg("weight").alias("mean_weight"))


def temporal_split(rows: DataFrame, cut_ms, embargo: int = 24) -> DataFrame:
    """role 'train' before the cut and 'test' from it on; the last `embargo` training rows of each symbol go."""
    cut = F.lit(cut_ms) if isinstance(cut_ms, int) else cut_ms
    d = rows if "bar_idx" in rows.columns else index_bars(rows)
    train = F.col("open_time") < cut
    ends = d.where(train).groupBy("symbol").agg(F.max("bar_idx").alias("_end"))
    d = d.join(ends, "symbol", "left").withColumn("role", F.when(train, "train").otherwise("test"))
    return d.where((F.col("role") == "test") | (F.col("bar_idx") <= F.col("_end") - embargo)).drop("_end")


def default_cut(rows: DataFrame, share: float = 0.2) -> DataFrame:
    """cut: the time after which the last `share` of the time range lies."""
    lo, hi = F.min("open_time"), F.max("open_time")
    return rows.agg((lo + F.floor((hi - lo) * (1.0 - share))).cast("long").alias("cut"))


def leaks(split: DataFrame) -> DataFrame:
    """One row: latest training and earliest test time, and whether they are in order."""
    last = F.max(F.when(F.col("role") == "train", F.col("open_time")))
    first = F.min(F.when(F.col("role") == "test", F.col("open_time")))
    return split.agg(last.alias("last_train"), first.alias("first_test"), F.coalesce(last < first, F.lit(True)).alias("clean"))


def training_rows(labelled: DataFrame, cut_ms: int, regimes: list[str] | None, bar_ms: int, embargo: int = 24, target: str = "target") -> DataFrame:
    """Rows for fitting: regimes filtered, symbols with one kind of target only left out, role by the cut, training rows
    within `embargo` bars of wall-clock time before the cut left out."""
    d = labelled.where(F.col("regime").isin(*regimes)) if regimes else labelled
    two = d.groupBy("symbol").agg(F.countDistinct(target).alias("k")).where("k >= 2").select("symbol")
    d = d.join(two, "symbol", "left_semi")
    t = F.col("open_time")
    return d.withColumn("role", F.when(t < cut_ms - embargo * bar_ms, "train").when(t >= cut_ms, "test")).where("role is not null")


def embargo_fit_end(rows: DataFrame, valid_from: int, embargo_ms: int) -> DataFrame:
    """One row: how many training rows, in time order, end before the embargo of the validation part; at least half."""
    n = F.count("*")
    fit = F.count_if(F.col("open_time") < valid_from - embargo_ms)
    return rows.where(F.col("open_time") < valid_from).agg(n.alias("n"), F.greatest(fit, F.floor(n / 2)).alias("fit_end"))


def fold_table(spark, t0: int, t1: int, folds: int = 5, embargo: float = 0.01) -> DataFrame:
    """Purged k-fold on a time axis: the axis is cut into folds + 1 blocks; fold k trains on all blocks before block k but
    for an embargo of a share of the axis, and tests on block k (its end open)."""
    block, gap = (t1 - t0) / (folds + 1), (t1 - t0) * embargo
    return spark.createDataFrame([(k, t0, int(t0 + k * block - gap), int(t0 + k * block), int(t0 + (k + 1) * block)) for k in range(1, folds + 1)], "fold int, train_from long, train_to long, test_from long, test_to long")


def assign_folds(rows: DataFrame, folds: DataFrame) -> DataFrame:
    """rows once per fold that they have a role in."""
    t = F.col("open_time")
    train, test = (t >= F.col("train_from")) & (t < F.col("train_to")), (t >= F.col("test_from")) & (t < F.col("test_to"))
    return rows.join(F.broadcast(folds), train | test).withColumn("role", F.when(test, "test").otherwise("train")).drop("train_from", "train_to", "test_from", "test_to")


def walk_forward_windows(spark, start_ms: int, end_ms: int, train_months: int = 12, test_months: int = 3, embargo_days: int = 2) -> DataFrame:
    """Windows by calendar months with clamped days; the start advances from the clamped day, test by test."""
    import calendar
    import datetime as dt

    def plus(d: dt.datetime, months: int) -> dt.datetime:
        y, m = divmod(d.year * 12 + d.month - 1 + months, 12)
        return d.replace(year=y, month=m + 1, day=min(d.day, calendar.monthrange(y, m + 1)[1]))

    ms = lambda d: int(d.replace(tzinfo=dt.UTC).timestamp() * 1000)
    epoch = dt.datetime(1970, 1, 1)
    at, end, rows = epoch + dt.timedelta(milliseconds=start_ms), epoch + dt.timedelta(milliseconds=end_ms), []
    while True:
        train_to = plus(at, train_months)
        test_to = plus(train_to, test_months)
        if test_to > end:
            break
        rows.append((len(rows) + 1, ms(at), ms(train_to) - embargo_days * DAY_MS, ms(train_to), ms(test_to)))
        at = plus(at, test_months)
    return spark.createDataFrame(rows, "fold int, train_from long, train_to long, test_from long, test_to long")


def grid_labels(bars: DataFrame, grid: list[tuple[float, float, int]], min_atr: float = 0.005, keep: list[str] | None = None) -> DataFrame:
    """triple_barrier of every cell (up, down, horizon) of a grid in one pass over the bars: a row per bar and cell, with up,
    down, horizon, label, future_return, t1_bar and the columns to keep (all).

    The closes ahead are gathered once, for the longest horizon, with their running extremes; those never fall (or rise), so
    the first touch of a barrier is found by how many of them don't reach it.
    """
    longest, kept = max(h for _, _, h in grid), keep or bars.columns

    def step(d, w):
        ahead = d.withColumn("_ahead", F.collect_list("close").over(w.rowsBetween(1, longest)))
        run = lambda f: F.expr(f"transform(sequence(1, greatest(size(_ahead), 1)), k -> {f}(slice(_ahead, 1, k)))")
        return ahead.withColumns({"_tops": run("array_max"), "_lows": run("array_min")})

    d = on_slices(bars, step, 0, longest)
    a = F.greatest(F.coalesce(F.nanvl("atr_pct", F.lit(min_atr)), F.lit(min_atr)), F.lit(min_atr))
    d = d.withColumn("_a", a)

    def cell(up, down, h):
        high, low = F.col("close") * (1 + up * F.col("_a")), F.col("close") * (1 - down * F.col("_a"))
        over = F.size(F.filter(F.slice("_tops", 1, h), lambda x: x < high)) + 1
        under = F.size(F.filter(F.slice("_lows", 1, h), lambda x: x > low)) + 1
        label = F.when((over <= h) & (over <= under), 1).when(under <= h, -1).otherwise(0)
        k = F.least(over, under, F.lit(h))
        out = F.get("_ahead", k - 1)
        found = F.struct(F.lit(float(up)).alias("up"), F.lit(float(down)).alias("down"), F.lit(h).alias("horizon"), label.alias("label"), safe_divide(out - F.col("close"), F.col("close")).alias("future_return"), (F.col("bar_idx") + k).alias("t1_bar"))
        return F.when(F.size("_ahead") >= h, found)

    cells = F.array_compact(F.array(*(cell(*g) for g in grid)))
    return d.select(*(c for c in dict.fromkeys([*kept, "bar_idx"])), F.inline(cells))


def grid_balance(bars: DataFrame, grid: list[tuple[float, float, int]], low: float = 35.0, high: float = 65.0, by: list[str] | None = None) -> DataFrame:
    """Class balance of every barrier cell (up, down, horizon): rows, share of longs among decided labels, gate."""
    d = grid_labels(bars, grid, keep=["symbol", "open_time"]).where("label <> 0")
    long_pct = F.round(safe_divide(F.count_if(F.col("label") == 1) * 100.0, F.count("*")), 4)
    return d.groupBy(*(by or []), "up", "down", "horizon").agg(F.count("*").alias("n"), long_pct.alias("long_pct"), long_pct.between(low, high).alias("balanced"))


def meta_labels(scored: DataFrame, cost: float = 0.0007) -> DataFrame:
    """From base probabilities p_up and future_return: direction, confidence, net return after cost, target (net > 0), the
    hour on the circle and the regime as flags."""
    from tapeloom.operators.session import hour

    direction = F.when(F.col("p_up") >= 0.5, 1).otherwise(-1)
    net = F.col("future_return") * direction - cost
    turn = hour().cast("double") / 24.0 * 2.0 * F.pi()
    return scored.select("*", direction.alias("base_direction"), F.greatest("p_up", 1 - F.col("p_up")).alias("base_confidence"), F.sin(turn).alias("hour_sin"), F.cos(turn).alias("hour_cos"), *((F.col("regime") == r).cast("int").alias(f"regime_{r}") for r in ("trend_up", "trend_down", "range", "high_vol")), net.alias("net_return"), (net > 0).cast("int").alias("meta_target"))


def meta_gate(rows: DataFrame, p: str, threshold: float = 0.55, smallest: float = 0.25) -> DataFrame:
    """take where p is at least the threshold; size grows from `smallest` to 1 with what is above it, 0 if not taken."""
    take = F.col(p) >= threshold
    size = F.least(F.greatest((F.col(p) - threshold) / (1 - threshold), F.lit(smallest)), F.lit(1.0))
    return rows.select("*", F.coalesce(take, F.lit(False)).alias("take"), F.when(take, size).otherwise(0.0).alias("size"))


def threshold_table(rows: DataFrame, thresholds: list[float], p: str = "p", target: str = "meta_target", net: str = "net_return") -> DataFrame:
    """Per threshold: rows taken, their share, precision, recall, win rate, profit factor (999 without losses), mean in bps."""
    cells = rows.sparkSession.createDataFrame([(float(t),) for t in thresholds], "threshold double")
    taken = F.col(p) >= F.col("threshold")
    d = rows.crossJoin(F.broadcast(cells))  # a few thresholds
    n = F.count_if(taken)
    hits = F.count_if(taken & (F.col(target) == 1))
    won, lost = F.sum(F.when(taken & (F.col(net) > 0), F.col(net))), -F.sum(F.when(taken & (F.col(net) < 0), F.col(net)))
    return d.groupBy("threshold").agg(n.alias("n_taken"), safe_divide(n, F.count("*")).alias("rate"), safe_divide(hits, n).alias("precision"), safe_divide(hits, F.count_if(F.col(target) == 1)).alias("recall"), safe_divide(F.count_if(taken & (F.col(net) > 0)), n).alias("win_rate"), F.when(F.coalesce(lost, F.lit(0.0)) > 0, F.least(safe_divide(F.coalesce(won, F.lit(0.0)), lost), F.lit(999.0))).otherwise(F.when(won > 0, 999.0).otherwise(0.0)).alias("profit_factor"), F.coalesce(F.avg(F.when(taken, F.col(net))) * 10000.0, F.lit(0.0)).alias("mean_bps"))


def suggest_threshold(rows: DataFrame, confidence: str = "confidence") -> DataFrame:
    """threshold: the highest of .70, .69 ... .52 that 10 to 40 % of the rows reach; .55 if none does."""
    cells = rows.sparkSession.range(52, 71).select((F.col("id") / 100.0).alias("threshold"))
    cover = rows.crossJoin(F.broadcast(cells)).groupBy("threshold").agg(F.avg((F.col(confidence) >= F.col("threshold")).cast("double")).alias("coverage"))
    return cover.agg(F.coalesce(F.max(F.when(F.col("coverage").between(0.10, 0.40), F.col("threshold"))), F.lit(0.55)).alias("threshold"))


def sample_size_ok(rows: DataFrame, n: str = "n", p: str = "p") -> DataFrame:
    """margin 1.96 * sqrt(p (1 - p) / n) and whether there are 50 rows at least and a margin of 5 % at most."""
    margin = 1.96 * F.sqrt(safe_divide(F.col(p) * (1 - F.col(p)), F.col(n), 1.0))
    return rows.select("*", margin.alias("margin"), ((F.col(n) >= 50) & (margin <= 0.05)).alias("sufficient"))
