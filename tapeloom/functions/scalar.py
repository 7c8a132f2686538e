"""Column helpers that carry the conventions for undefined values: see each docstring."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

DAY_MS = 86_400_000
HOUR_MS = 3_600_000


def col(x) -> Column:
    return F.col(x) if isinstance(x, str) else x


def safe_divide(a, b, fill: float = 0.0) -> Column:
    """a / b; `fill` where b is 0 or the result is null or NaN."""
    return F.coalesce(F.nanvl(F.try_divide(col(a), col(b)), F.lit(None).cast("double")), F.lit(float(fill)))


def zero(x) -> Column:
    """x with null and NaN replaced by 0."""
    return F.coalesce(F.nanvl(col(x), F.lit(0.0)), F.lit(0.0))


def clip(x, low: float | None, high: float | None) -> Column:
    """x held between the bounds; null stays null."""
    x = col(x)
    if low is not None:
        x = F.when(x < low, F.lit(low)).otherwise(x)
    return F.when(x > high, F.lit(high)).otherwise(x) if high is not None else x


def flag(condition) -> Column:
    """1 where the condition holds, else 0; an unknown condition does not hold."""
    return F.coalesce(condition, F.lit(False)).cast("int")


def holds(condition) -> Column:
    return F.coalesce(condition, F.lit(False))


def sign(x) -> Column:
    """1, -1 or 0; null counts as 0."""
    x = col(x)
    return F.when(x > 0, 1).when(x < 0, -1).otherwise(0)


def at(ms="open_time") -> Column:
    return F.timestamp_millis(col(ms))


def normal_cdf(z) -> Column:
    """Standard normal distribution function by Abramowitz and Stegun 7.1.26 (error below 1.5e-7)."""
    z = col(z)
    x = F.abs(z) / F.lit(2.0**0.5)
    t = 1.0 / (1.0 + 0.3275911 * x)
    # fixed values of the published approximation
    poly = t * (0.254829592 + t * (-0.284496736 + t * (1.421413741 + t * (-1.453152027 + t * 1.061405429))))
    erf = 1.0 - poly * F.exp(-x * x)
    return 0.5 * (1.0 + F.when(z < 0, -erf).otherwise(erf))


def normal_symbol(x) -> Column:
    """The leading letters and digits of a symbol, upper case: 'btcusdt-perp.x' is 'BTCUSDT'."""
    return F.regexp_extract(F.upper(col(x)), "^[A-Z0-9]+", 0)


def bar_open_of_close(close_ts, bar_ms: int) -> Column:
    """The open time of the bar that a close time (its last millisecond, or the next open) belongs to."""
    return (F.floor((col(close_ts) + 1) / F.lit(bar_ms)) - 1) * F.lit(bar_ms)


def rounded(df, digits: int = 6):
    """df with all doubles rounded half up, -0.0 written as 0.0."""
    return df.select(*((F.round(F.col(n), digits) + F.lit(0.0)).alias(n) if t == "double" else F.col(n) for n, t in df.dtypes))
