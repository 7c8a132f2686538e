"""Time-series patterns that don't send a whole symbol to one task.

A tape has few symbols and very many bars, so windows over a symbol alone would run in as many tasks as there are
symbols. Bars are numbered from counts per day, cut into slices of many bars, and each slice takes along a halo of the
bars that its frames look back (or ahead) to. Windows then partition by symbol and slice.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from tapeloom.functions.scalar import DAY_MS, col

SLICE = 8192
Step = Callable[[DataFrame, WindowSpec], DataFrame]


def index_bars(df: DataFrame, key: str = "symbol", ts: str = "open_time", name: str = "bar_idx", span_ms: int = DAY_MS, ties: tuple[str, ...] = ()) -> DataFrame:
    """A dense number per symbol in time order, from 0: rows are counted per symbol and day, the (small) counts are summed
    up along the days, and rows are numbered inside their day. Equal times are numbered by `ties`, else in any order."""
    day = F.floor(F.col(ts) / span_ms)
    counts = df.groupBy(F.col(key).alias("_k"), day.alias("_d")).agg(F.count("*").alias("_n"))
    before = counts.withColumn("_before", F.coalesce(F.sum("_n").over(Window.partitionBy("_k").orderBy("_d").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("_n")
    inside = F.row_number().over(Window.partitionBy(key, "_day").orderBy(ts, *ties)) - 1
    rows = df.withColumn("_day", day).withColumn("_in", inside)
    joined = rows.join(before, (F.col(key) == F.col("_k")) & (F.col("_day") == F.col("_d")))
    return joined.withColumn(name, F.col("_before") + F.col("_in")).drop("_day", "_in", "_k", "_d", "_before")


def pieces(df: DataFrame, key: str, ts: str, ties: tuple[str, ...] = (), size: int = SLICE) -> DataFrame:
    """df with its day _d, the row's number _in inside the key's day, and _sub, its piece of `size` rows of that day: pieces
    in the order of (_d, _sub) and rows in that of _in are in time order, without a number along the whole key."""
    d = df.withColumn("_d", F.floor(F.col(ts) / DAY_MS))
    d = d.withColumn("_in", F.row_number().over(Window.partitionBy(key, "_d").orderBy(ts, *ties)) - 1)
    return d.withColumn("_sub", F.floor(F.col("_in") / size).cast("int"))


def on_slices(df: DataFrame, step: Step, back: int, ahead: int = 0, key: str = "symbol", ts: str = "open_time", size: int = SLICE) -> DataFrame:
    """step(df, window) on slices of `size` bars, where no frame of step reaches more than `back` bars into the past or
    `ahead` into the future. The result equals step over whole symbols. bar_idx is there for gates on the first bars."""
    if back > size or ahead > size:
        raise ValueError("a slice must be at least as long as the reach of its frames")
    if "bar_idx" not in df.columns:
        df = index_bars(df, key, ts)
    slice_ = F.floor(F.col("bar_idx") / size)
    at = F.col("bar_idx") - slice_ * size
    parts = [F.array(F.lit(0))]
    if back:
        parts.append(F.when(at >= size - back, F.array(F.lit(1))).otherwise(F.array().cast("array<int>")))
    if ahead:
        parts.append(F.when(at < ahead, F.array(F.lit(-1))).otherwise(F.array().cast("array<int>")))
    spread = df.withColumn("_shift", F.explode(F.concat(*parts))).withColumn("_slice", slice_ + F.col("_shift"))
    window = Window.partitionBy(key, "_slice").orderBy("bar_idx")
    return step(spread, window).where("_shift = 0").drop("_shift", "_slice")


def rolling(window: WindowSpec, n: int) -> WindowSpec:
    return window.rowsBetween(-(n - 1), 0)


def full(value: Column, n: int) -> Column:
    """value once n bars have been seen, null before."""
    return F.when(F.col("bar_idx") >= n - 1, value)


def zscore(x, window: WindowSpec, n: int, least: int | None = None) -> Column:
    """(x - mean) / sample deviation of the last n bars; 0 until `least` (by default n) bars are there or if all are equal."""
    x, frame = col(x), rolling(window, n)
    mean, std = F.avg(x).over(frame), F.stddev_samp(x).over(frame)
    z = F.when(std > 0, (x - mean) / std)
    return F.coalesce(F.when(F.col("bar_idx") >= (least or n) - 1, z), F.lit(0.0))


def correlation(x, y, window: WindowSpec, n: int) -> Column:
    """Pearson correlation of the last n bars from their moments; 0 where undefined or not full."""
    x, y, frame = col(x), col(y), rolling(window, n)
    mean = lambda c: F.avg(c).over(frame)
    cov = mean(x * y) - mean(x) * mean(y)
    vx, vy = (F.greatest(mean(c * c) - mean(c) * mean(c), F.lit(0.0)) for c in (x, y))
    r = F.try_divide(cov, F.sqrt(vx) * F.sqrt(vy))
    return F.coalesce(F.nanvl(full(r, n), F.lit(0.0)), F.lit(0.0))


def asof(left: DataFrame, right: DataFrame, left_ts: str, right_ts: str, columns: list[str], key: str = "symbol", span_ms: int = DAY_MS) -> DataFrame:
    """left with `columns` of the latest right row of the same key at or before left_ts; null where there is none.

    Of right rows at one time the largest (by columns) counts. Both sides are united and ordered inside spans of time;
    what a span inherits comes from a table of one row per key and span. Null keys or times match nothing.
    """
    names = left.columns
    picked = F.struct(*(F.col(c) for c in columns))
    r = right.select(F.col(key), F.col(right_ts).cast("long").alias("_t"), picked.alias("_r")).where(F.col(key).isNotNull() & F.col("_t").isNotNull())
    r = r.groupBy(key, "_t").agg(F.max("_r").alias("_r")).withColumn("_tag", F.lit(0))
    rows = left.select(F.col(key), F.col(left_ts).cast("long").alias("_t"), F.lit(1).alias("_tag"), F.struct(*names).alias("_l"))
    both = rows.unionByName(r, allowMissingColumns=True).withColumn("_span", F.floor(F.col("_t") / span_ms))
    here = F.last("_r", ignorenulls=True).over(Window.partitionBy(key, "_span").orderBy("_t", "_tag"))
    spans = both.groupBy(key, "_span").agg(F.max(F.when(F.col("_tag") == 0, F.struct("_t", "_r"))).alias("_last"))
    before = F.last("_last", ignorenulls=True).over(Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1))
    carried = spans.select(F.col(key).alias("_k"), F.col("_span").alias("_s"), before.getField("_r").alias("_before"))
    found = both.withColumn("_here", here).where("_tag = 1").join(carried, F.col(key).eqNullSafe(F.col("_k")) & F.col("_span").eqNullSafe(F.col("_s")), "left")
    value = F.when(F.col(key).isNotNull() & F.col("_t").isNotNull(), F.coalesce("_here", "_before"))
    return found.select(F.col("_l"), value.alias("_v")).select("_l.*", *(F.col("_v").getField(c).alias(c) for c in columns))


def ewm(df: DataFrame, value, alpha: float, name: str, adjust: bool = False, start: int = 0, seed=None, key: str = "symbol", ts: str = "open_time", size: int = 1024, halo: int = 640) -> DataFrame:
    """Exponential mean y = (1 - alpha) y' + alpha x along each symbol, as column `name`.

    adjust: weights normalised by their sum (else y starts as x). start, seed: the recurrence begins at that bar with the
    value of column seed; null before. A slice's halo is so long that what came before it has no weight left in a double
    ((1 - alpha) ** halo below 1e-16), and so short that no power in the sum over a slice overflows.
    """
    import math

    decay = -math.log1p(-alpha)
    halo = min(halo, max(1, math.ceil(40 / decay)))
    size = max(halo, min(size, int(600 / decay) - halo))
    if (size + halo) * decay > 690:
        raise ValueError("alpha is too large for slices of bars")

    def step(d: DataFrame, w: WindowSpec) -> DataFrame:
        d = d.withColumn("_x", col(value).cast("double") if seed is None else F.when(F.col("bar_idx") == start, F.col(seed)).otherwise(col(value)).cast("double"))
        live = F.col("bar_idx") >= start
        k = F.when(live, F.col("bar_idx") - F.greatest(F.col("_slice") * size - halo, F.lit(start))).cast("double")
        grow = F.exp(k * decay)  # (1 - alpha) ** -k
        weight = F.lit(1.0) if adjust else F.when(F.col("bar_idx") == start, 1.0).otherwise(alpha)
        run = w.rowsBetween(Window.unboundedPreceding, 0)
        top = F.sum(F.when(live, weight * F.col("_x") * grow)).over(run)
        y = top / F.sum(F.when(live, grow)).over(run) if adjust else top / grow
        return d.withColumn(name, F.when(live, y)).drop("_x")

    return on_slices(df, step, halo, key=key, ts=ts, size=size)


def running(df: DataFrame, outputs: dict[str, tuple[str, str]], key: str = "symbol", order: str = "open_time", span_ms: int = DAY_MS) -> DataFrame:
    """Prefix operations along each key: name -> (kind, column), kind one of sum, max, min, last (the last not-null value),
    prev (the last not-null value before the row).

    Rows run inside (key, span); a table of one row per key and span is scanned for what each span inherits.
    """
    kinds = {"sum": F.sum, "max": F.max, "min": F.min}
    d = df.withColumn("_span", F.floor(F.col(order) / span_ms))
    inside = Window.partitionBy(key, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    until = Window.partitionBy(key, "_span").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    before = Window.partitionBy(key).orderBy("_span").rowsBetween(Window.unboundedPreceding, -1)
    aggs, carry = [], []
    for n, (kind, c) in outputs.items():
        if kind in ("last", "prev"):
            d = d.withColumn(n, F.last(c, ignorenulls=True).over(inside if kind == "last" else until))
            aggs.append(F.max_by(F.col(c), F.when(F.col(c).isNotNull(), F.col(order))).alias(n))
            carry.append(F.last(n, ignorenulls=True).over(before).alias(f"_b_{n}"))
        else:
            d = d.withColumn(n, kinds[kind](c).over(inside))
            aggs.append(kinds[kind](c).alias(n))
            carry.append(kinds[kind](n).over(before).alias(f"_b_{n}"))
    spans = df.withColumn("_span", F.floor(F.col(order) / span_ms)).groupBy(key, "_span").agg(*aggs)
    inherited = spans.select(F.col(key).alias("_k"), F.col("_span").alias("_s"), *carry)
    out = d.join(inherited, (F.col(key) == F.col("_k")) & (F.col("_span") == F.col("_s")))
    merge = {"sum": lambda a, b: F.when(a.isNull() & b.isNull(), None).otherwise(F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))), "max": F.greatest, "min": F.least, "last": F.coalesce, "prev": F.coalesce}
    return out.withColumns({n: merge[kind](F.col(n), F.col(f"_b_{n}")) for n, (kind, _) in outputs.items()}).drop("_span", "_k", "_s", *(f"_b_{n}" for n in outputs))
