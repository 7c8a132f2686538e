"""A signal ledger as a merged table: openings, closes, rejections, and the tables derived from it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tapeloom.functions.scalar import at
from tapeloom.operators import ledger
from tapeloom.sources import versions

def _month():
    """The partition of a signal: the month it was created in."""
    return F.coalesce(F.date_format(at("created_at"), "yyyy-MM"), F.lit("none"))


def log_signals(spark: SparkSession, path: str, signals: DataFrame, timeframe: str = "4h") -> int:
    """Write new signals (id, symbol, direction, created_at, ...) as open; a missing timeframe is the ledger's own."""
    own = F.coalesce("timeframe", F.lit(timeframe)) if "timeframe" in signals.columns else F.lit(timeframe)
    null = lambda t: F.lit(None).cast(t)
    rows = signals.withColumns({"timeframe": own, "result": F.lit("open"), "closed_at": null("long"), "close_price": null("double"), "pnl_pct": null("double")})
    return versions.merge(spark, path, rows, "id", _month())


def close_signals(spark: SparkSession, path: str, closes: DataFrame) -> int:
    """Close signals (id, closed_at, close_price, pnl_pct, result) that the ledger has; of several closes the last counts."""
    return versions.merge(spark, path, closes.select("id", "closed_at", "close_price", "pnl_pct", "result"), "id", F.lit("none"), newest="closed_at", insert=False)


def reject_signals(spark: SparkSession, path: str, rejected: DataFrame) -> int:
    """Mark signals (id, closed_at) as rejected: closed then, without P&L."""
    rows = rejected.select("id", "closed_at", F.lit("rejected").alias("result"), F.lit(None).cast("double").alias("pnl_pct"))
    return versions.merge(spark, path, rows, "id", F.lit("none"), newest="closed_at", insert=False)


def refresh_daily(spark: SparkSession, path: str, stats_path: str, since: str | None = None) -> int:
    """Merge the ledger's daily statistics by timeframe into their table; since: only days from this date on are written."""
    d = ledger.daily_stats(versions.read(spark, path))
    d = d if since is None else d.where(F.col("date") >= F.to_date(F.lit(since)))
    d = d.withColumn("key", F.concat_ws("|", "timeframe", F.col("date").cast("string")))
    return versions.merge(spark, stats_path, d, "key", F.date_format("date", "yyyy-MM"))


def refresh_performance(spark: SparkSession, path: str, cache_path: str, as_of_ms: int) -> int:
    """Merge the performance of every timeframe and period, as of a time, into their table."""
    rows = ledger.cube(versions.read(spark, path), as_of_ms).withColumn("as_of", F.lit(as_of_ms))
    rows = rows.withColumn("key", F.concat_ws("|", "tf", F.col("period_days").cast("string")))
    return versions.merge(spark, cache_path, rows, "key", F.col("tf"), newest="as_of")


def record_metrics(spark: SparkSession, path: str, rows: DataFrame) -> int:
    """Merge snapshots (bot, equity, daily_pnl, regime, open_positions, updated_at): the newest of each bot stays."""
    return versions.merge(spark, path, rows, "bot", F.lit("all"), newest="updated_at")
