"""Statistics that guard against overfitting: deflated Sharpe ratio, probability of back-test overfitting, t-statistics."""

from __future__ import annotations

import itertools
import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.scalar import normal_cdf, safe_divide
from tapeloom.operators.backtest import STATISTICS_GATE, VALIDATION_GATE_1H, gate

_EULER = 0.5772156649015329


def _quantile(p: float) -> float:
    """Inverse of the standard normal distribution function."""
    from statistics import NormalDist

    return NormalDist().inv_cdf(p)


def expected_max(n: int) -> float:
    """Expected largest of n standard normal draws (Bailey and Lopez de Prado)."""
    return (1 - _EULER) * _quantile(1 - 1 / n) + _EULER * _quantile(1 - 1 / (n * math.e)) if n > 1 else 0.0


def deflated_sharpe(returns: DataFrame, trial: str = "trial", ret: str = "ret", trials: list[int] | None = None) -> DataFrame:
    """Deflated Sharpe ratio of the best trial: (n_trials, best_sharpe, dsr, dsr_legacy), one row per assumed number of
    trials (by default those there are).

    Per-observation Sharpe ratios per trial; the benchmark is the expected maximum of n trials scaled by the spread of the
    trials; the error uses the best trial's skewness and kurtosis. dsr_legacy does not scale the benchmark and is null
    where its error is undefined. A single trial, or no spread, gives 0.
    """
    r = F.col(ret)
    per = returns.groupBy(trial).agg(F.count(r).alias("n"), safe_divide(F.avg(r), F.stddev_samp(r)).alias("sr"), F.skewness(r).alias("sk"), (F.kurtosis(r) + 3.0).alias("ku"))
    best = per.agg(F.max_by(F.struct("sr", "sk", "ku", "n"), F.struct("sr", F.col(trial))).alias("b"), F.stddev_samp("sr").alias("spread"), F.count("*").alias("k")).select("b.*", "spread", "k")
    spark = returns.sparkSession
    if trials is None:
        k = best.select("k").first()["k"]
        trials = [max(2, int(k))]
    cells = spark.createDataFrame([(n, expected_max(n), math.sqrt(2 * math.log(n)) - (math.log(math.log(n)) + math.log(4 * math.pi)) / (2 * math.sqrt(2 * math.log(n)))) for n in trials], "n_trials int, e_max double, e_legacy double")
    d = best.crossJoin(F.broadcast(cells))  # one row and a few
    sr, var = F.col("sr"), 1 - F.col("sk") * F.col("sr") + (F.col("ku") - 1) / 4 * F.col("sr") * F.col("sr")
    old = (1 - F.col("sk") * sr + (F.col("ku") - 3) / 4 * sr * sr) / (F.col("n") - 1)
    z = safe_divide((sr - F.col("spread") * F.col("e_max")) * F.sqrt(F.col("n") - 1), F.sqrt(F.greatest(var, F.lit(1e-12))))
    return d.select("n_trials", F.col("sr").alias("best_sharpe"), F.when((F.col("k") >= 2) & (F.col("spread") > 1e-12), normal_cdf(z)).otherwise(0.0).alias("dsr"), F.when(old > 0, normal_cdf((sr - F.col("e_legacy")) / F.sqrt(old))).alias("dsr_legacy"))


def overfitting_probability(blocks: DataFrame, n_blocks: int = 6) -> DataFrame:
    """Probability of back-test overfitting by combinatorially symmetric cross-validation: (combinations, pbo).

    blocks: (trial, block from 0, n, s, q): count, sum and sum of squares of returns. For every choice of half of the
    blocks the best trial in it is ranked on the other half; pbo is the share of choices where it ranks in the lower half.
    """
    spark = blocks.sparkSession
    combos = [(i, sorted(c)) for i, c in enumerate(itertools.combinations(range(n_blocks), n_blocks // 2))]
    picks = spark.createDataFrame(combos, "combo int, inside array<int>")
    d = blocks.crossJoin(F.broadcast(picks)).withColumn("is_in", F.array_contains("inside", F.col("block").cast("int")))  # a few dozen choices
    agg = d.groupBy("combo", "trial", "is_in").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q"))
    mean = F.col("s") / F.col("n")
    sharpe = safe_divide(mean, F.sqrt(F.greatest(F.col("q") / F.col("n") - mean * mean, F.lit(0.0))))
    wide = agg.groupBy("combo", "trial").agg(F.max(F.when(F.col("is_in"), sharpe)).alias("ins"), F.max(F.when(~F.col("is_in"), sharpe)).alias("outs"))
    best = wide.groupBy("combo").agg(F.max_by("outs", F.struct("ins", "trial")).alias("chosen"))
    ranked = wide.join(best, "combo").groupBy("combo").agg((F.count_if(F.col("outs") < F.col("chosen")) + 1).alias("rank"), F.count("*").alias("trials"))
    lower = F.col("rank") / (F.col("trials") + 1) <= 0.5
    return ranked.agg(F.count("*").alias("combinations"), F.round(F.avg(lower.cast("double")), 6).alias("pbo"))


def block_sums(returns: DataFrame, n_blocks: int, trial: str = "trial", index: str = "idx", total: str = "total", ret: str = "ret") -> DataFrame:
    """(trial, block, n, s, q) of returns numbered along the time axis."""
    b = F.least(F.floor(F.col(index) * n_blocks / F.col(total)), F.lit(n_blocks - 1)).cast("int")
    return returns.groupBy(F.col(trial).alias("trial"), b.alias("block")).agg(F.count("*").alias("n"), F.sum(ret).alias("s"), F.sum(F.col(ret) * F.col(ret)).alias("q"))


def win_rate_t(windows: DataFrame, win_rate: str = "win_rate", n: str = "trades") -> DataFrame:
    """One row: t of the trade-weighted win rate (percent) against 50 by the unweighted deviation over windows, and the z of
    a proportion test over all trades; 0 without spread."""
    w, k = F.col(win_rate), F.col(n)
    mean = safe_divide(F.sum(w * k), F.sum(k))
    std = F.stddev_samp(w)
    t = F.when((std > 1e-12) & (F.sum(k) > 0), safe_divide((mean - 50.0) * F.sqrt(F.count("*")), std)).otherwise(0.0)
    z = safe_divide((mean / 100.0 - 0.5) * F.sqrt(F.sum(k)), F.lit(0.5))
    return windows.agg(F.count("*").alias("windows"), mean.alias("weighted_win_rate"), t.alias("t_stat"), z.alias("z_stat"))


def out_of_sample_report(trades: DataFrame, cost: float = 0.0007, per_year: float = 252.0) -> DataFrame:
    """One row over trades (open_time, ret, taken): net win rate, profit factor, Sharpe of daily sums, mean net return as a
    multiple of the cost, coverage."""
    from tapeloom.functions.scalar import DAY_MS

    net = F.when(F.col("taken"), F.col("ret") - cost)
    days = trades.groupBy(F.floor(F.col("open_time") / DAY_MS).alias("day")).agg(F.sum(net).alias("r"), F.count("*").alias("rows"), F.count(net).alias("n"), F.count_if(net > 0).alias("w"), F.coalesce(F.sum(F.when(net > 0, net)), F.lit(0.0)).alias("g"), F.coalesce(-F.sum(F.when(net < 0, net)), F.lit(0.0)).alias("l"), F.coalesce(F.sum(net), F.lit(0.0)).alias("t"))
    n = F.sum("n")
    return days.agg(n.alias("trades"), (safe_divide(F.sum("w"), n) * 100.0).alias("win_rate"), F.when(F.sum("l") > 0, F.sum("g") / F.sum("l")).alias("profit_factor"), (safe_divide(F.avg("r"), F.stddev_samp("r")) * F.sqrt(F.lit(per_year))).alias("sharpe"), (safe_divide(F.sum("t"), n) / cost).alias("fee_multiple"), safe_divide(n, F.sum("rows")).alias("coverage"))


def validation_report(oos: DataFrame, dsr: DataFrame, pbo: DataFrame, t: DataFrame) -> DataFrame:
    """One row with the statistics' gate."""
    d = oos.select(F.col("trades").alias("signals"), "win_rate", "profit_factor", "sharpe", "fee_multiple", "coverage")
    d = d.crossJoin(dsr.select("dsr").limit(1)).crossJoin(pbo.select("pbo")).crossJoin(t.select("t_stat"))  # one row each
    return gate(d, STATISTICS_GATE)


def validation_report_1h(oos: DataFrame, windows: DataFrame, dsr: DataFrame, pbo: DataFrame, t: DataFrame) -> DataFrame:
    """One row of a 1h model's measures with its gate: trades out of sample, the windows of the walk-forward (win_rate,
    profit_factor), the statistics, and whether the trades are enough to know the win rate within 5 %."""
    from tapeloom.operators.labels import sample_size_ok
    from tapeloom.operators.models import walk_forward_ml

    d = sample_size_ok(oos.select(F.col("trades").alias("signals"), "win_rate", "profit_factor", "sharpe", "fee_multiple", "coverage", (F.col("win_rate") / 100.0).alias("_p")), "signals", "_p")
    d = d.withColumn("enough", (F.col("sufficient") & (F.col("_p") > 0) & (F.col("_p") < 1)).cast("int")).drop("_p", "margin", "sufficient")
    w = walk_forward_ml(windows).select("windows", "profitable_windows_pct", "avg_win_rate", "avg_profit_factor")
    d = d.crossJoin(w).crossJoin(dsr.select("dsr").limit(1)).crossJoin(pbo.select("pbo")).crossJoin(t.select("t_stat"))  # one row each
    return gate(d, VALIDATION_GATE_1H)


def manifest(rows: DataFrame, features: list[str], target: str = "target", verdict: bool = True) -> DataFrame:
    """One row that describes a training run: rows and time range by role, class balance, hash of the sorted feature names."""
    role = lambda r: F.col("role") == r
    share = lambda r: F.round(safe_divide(F.count_if(role(r) & (F.col(target) == 1)) * 100.0, F.count_if(role(r))), 4)
    return rows.agg(F.count_if(role("train")).alias("train_rows"), F.count_if(role("test")).alias("test_rows"), F.max(F.when(role("train"), F.col("open_time"))).alias("train_end"), F.min(F.when(role("test"), F.col("open_time"))).alias("test_start"), share("train").alias("train_long_pct"), share("test").alias("test_long_pct")).select("*", F.sha2(F.lit(",".join(sorted(features))), 256).alias("feature_hash"), F.lit(verdict).alias("accepted"))
