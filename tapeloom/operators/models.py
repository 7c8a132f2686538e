"""Direction models on MLlib: fitting, scoring, importance, feature clusters."""

from __future__ import annotations

from pyspark.ml import Pipeline
from pyspark.ml.classification import GBTClassifier, LogisticRegression
from pyspark.ml.evaluation import BinaryClassificationEvaluator
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.stat import Correlation
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tapeloom.functions.lineage import cut
from tapeloom.operators.series import index_bars

# Columns that are never features.
NOT_FEATURES = ("symbol", "open_time", "close_time", "bar_idx", "_bar_idx", "t1_bar", "target", "label", "future_return", "weight", "role", "fold", "datetime", "ignore", "up", "down", "horizon")


def feature_columns(df: DataFrame, exclude=NOT_FEATURES) -> list[str]:
    """Numeric and boolean columns not excluded, sorted by name."""
    kinds = ("double", "float", "int", "bigint", "smallint", "tinyint", "boolean")
    return sorted(n for n, t in df.dtypes if t in kinds and n not in exclude and not n.startswith("_"))


def prepared(df: DataFrame, features: list[str]) -> DataFrame:
    """Features as finite doubles, a missing or infinite value as 0 with a flag m_<name> beside it; features that df lacks
    are missing throughout. So the columns come out in the order they were trained in."""
    have = set(df.columns)
    cols = {}
    for f in features:
        x = F.col(f).cast("double") if f in have else F.lit(None).cast("double")
        bad = x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
        cols[f"x_{f}"] = F.when(bad, 0.0).otherwise(x)
        cols[f"m_{f}"] = bad.cast("double")
    return df.withColumns(cols)


def _inputs(features):
    return [c for f in features for c in (f"x_{f}", f"m_{f}")]


def balanced(df: DataFrame, target: str = "target", weight: str | None = "weight") -> DataFrame:
    """sample_weight: inverse class frequency, times the row's own weight; y: 1 or 0."""
    n = df.groupBy(target).agg(F.count("*").alias("_n"))
    total = df.agg(F.count("*").alias("_t"))
    k = F.broadcast(n.crossJoin(total).select(target, (F.col("_t") / (2.0 * F.col("_n"))).alias("_w")))  # a row per class
    own = F.col(weight) if weight and weight in df.columns else F.lit(1.0)
    return df.join(k, target).withColumn("sample_weight", F.col("_w") * own).withColumn("y", (F.col(target) == 1).cast("double")).drop("_w")


def fit(train: DataFrame, features: list[str], valid_share: float = 0.15, trees: int = 20, depth: int = 4, seed: int = 7, kind: str = "gbt"):
    """A pipeline fitted on rows (features, target, optional weight); boosting stops early on the last share of the time."""
    d = balanced(prepared(train, features))
    ends = d.agg(F.min("open_time").alias("a"), F.max("open_time").alias("b")).first()
    valid_from = ends["b"] - int((ends["b"] - ends["a"]) * valid_share)
    d = d.withColumn("is_valid", F.col("open_time") >= valid_from)
    assemble = VectorAssembler(inputCols=_inputs(features), outputCol="features")
    if kind == "gbt":
        model = GBTClassifier(labelCol="y", weightCol="sample_weight", validationIndicatorCol="is_valid", maxIter=trees, maxDepth=depth, seed=seed)
    else:
        model = LogisticRegression(labelCol="y", weightCol="sample_weight", maxIter=50, regParam=0.01)
    return Pipeline(stages=[assemble, model]).fit(d)


def score(model, rows: DataFrame, features: list[str], threshold: float = 0.55) -> DataFrame:
    """rows with p_up, confidence and direction (0 below the threshold)."""
    d = model.transform(prepared(rows, features)).withColumn("p_up", vector_to_array("probability")[1])
    conf = F.greatest("p_up", 1 - F.col("p_up"))
    way = F.when(conf < threshold, 0).when(F.col("p_up") >= 0.5, 1).otherwise(-1)
    return d.select(*rows.columns, "p_up", conf.alias("confidence"), way.alias("direction"))


def auc(scored: DataFrame, target: str = "target") -> float:
    d = scored.select((F.col(target) == 1).cast("double").alias("label"), F.col("p_up").alias("rawPrediction"))
    return BinaryClassificationEvaluator().evaluate(d)


#: Rows that are dealt out among themselves by a permutation.
BLOCK = 256


def permuted(test: DataFrame, groups: dict[str, list[str]], repeats: int, key: tuple[str, ...] = ("symbol", "open_time"), block: int = BLOCK) -> DataFrame:
    """test once for every group of features and repeat (columns group, repeat), the group's features dealt out anew among the
    rows of a block; and once as it is (group null). Blocks of about `block` rows are made by a hash of the key, and each
    carries its rows as an array, in which a permutation is a second index."""
    n = test.count()
    own = F.xxhash64(*key)
    cells = F.array(F.struct(F.lit(None).cast("string").alias("group"), F.lit(0).alias("repeat")), *(F.struct(F.lit(g).alias("group"), F.lit(r).alias("repeat")) for g in groups for r in range(repeats)))
    blocks = test.groupBy(F.pmod(own, F.lit(max(1, -(-n // block)))).alias("_b")).agg(F.array_sort(F.collect_list(F.struct(own.alias("_h"), F.struct(*test.columns).alias("r")))).alias("_rows"))
    d = blocks.select("_b", "_rows", F.explode(cells).alias("_c"))
    order = F.expr("transform(array_sort(transform(sequence(0, size(_rows) - 1), i -> struct(xxhash64(_b, i, _c.group, _c.repeat) as h, i as i))), x -> x.i)")
    d = d.withColumn("_p", order).select("_c", F.explode(F.expr("transform(_rows, (x, i) -> struct(x.r as own, _rows[_p[i]].r as dealt))")).alias("_x"))
    changed = {c: [g for g, cols in groups.items() if c in cols] for c in {c for cols in groups.values() for c in cols}}
    value = lambda c: F.when(F.col("_c.group").isin(*changed[c]), F.col(f"_x.dealt.{c}")).otherwise(F.col(f"_x.own.{c}")) if c in changed else F.col(f"_x.own.{c}")
    return d.select(F.col("_c.group").alias("group"), F.col("_c.repeat").alias("repeat"), *(value(c).alias(c) for c in test.columns))


def permutation_importance(model, test: DataFrame, features: list[str], groups: dict[str, list[str]] | None = None, repeats: int = 5, target: str = "target", key: tuple[str, ...] = ("symbol", "open_time")) -> DataFrame:
    """(feature, importance): mean drop of accuracy when a feature (or the features of a group together) is dealt out anew
    among the rows; all features and repeats are scored in one job."""
    groups = groups or {f: [f] for f in features}
    rows = permuted(test.select(*dict.fromkeys([*key, *(c for c in features if c in test.columns), target])), groups, repeats, key)
    hit = ((F.col("p_up") >= 0.5) == (F.col(target) == 1)).cast("double")
    found = score(model, rows, features).groupBy("group", "repeat").agg(F.avg(hit).alias("hit"))
    mean = found.groupBy("group").agg(F.avg("hit").alias("hit"))
    base = F.broadcast(mean.where("group is null").select(F.col("hit").alias("base")))  # one row
    return mean.where("group is not null").crossJoin(base).select(F.col("group").alias("feature"), (F.col("base") - F.col("hit")).alias("importance"))


def correlation_matrix(rows: DataFrame, features: list[str]):
    """(names, matrix) of the features that vary; made by Spark, the matrix is of constant size."""
    d = prepared(rows, features)
    var = d.agg(*(F.var_pop(f"x_{f}").alias(f) for f in features)).first()
    names = [f for f in features if (var[f] or 0.0) > 1e-12]
    vec = VectorAssembler(inputCols=[f"x_{f}" for f in names], outputCol="v").transform(d).select("v")
    return names, Correlation.corr(vec, "v").head()[0].toArray()


def feature_clusters(names: list[str], matrix, gain: dict[str, float], distance: float = 0.3, per_cluster: int = 1, floor: int = 5) -> dict[str, list[str]]:
    """Average-linkage clusters at 1 - |correlation| below `distance`; of each the features of most gain are kept; if fewer
    than `floor` stay in all, the best of the dropped come back. {'kept': [...], 'dropped': [...]}"""
    groups = [[i] for i in range(len(names))]
    gap = lambda a, b: sum(1 - abs(matrix[i][j]) for i in a for j in b) / (len(a) * len(b))
    while len(groups) > 1:
        best = min(((gap(a, b), i, j) for i, a in enumerate(groups) for j, b in enumerate(groups) if i < j), default=None)
        if best is None or best[0] > distance:
            break
        groups[best[1]] += groups.pop(best[2])
    order = lambda i: (-gain.get(names[i], 0.0), names[i])
    kept = [i for g in groups for i in sorted(g, key=order)[:per_cluster]]
    rest = sorted((i for i in range(len(names)) if i not in kept), key=order)
    while len(kept) < min(floor, len(names)):
        kept.append(rest.pop(0))
    return {"kept": sorted(names[i] for i in kept), "dropped": sorted(names[i] for i in rest)}


def in_parallel(spark, jobs: list, threads: int = 4) -> list:
    """The results of some jobs, a few of them in Spark at a time; in their order."""
    from multiprocessing.pool import ThreadPool

    from pyspark import inheritable_thread_target

    if not jobs:
        return []
    with ThreadPool(min(threads, len(jobs))) as pool:
        return pool.map(lambda job: inheritable_thread_target(spark)(job)(), jobs)


def evaluate_folds(rows: DataFrame, folds: DataFrame, features: list[str], kind: str = "logistic", threshold: float = 0.55, threads: int = 4) -> DataFrame:
    """One model per fold of (fold, role) rows, some fitted at a time; window_performance of each test part. Folds without
    rows to learn from or to test on are left out."""
    from tapeloom.operators.backtest import window_performance
    from tapeloom.operators.labels import assign_folds

    d = cut(assign_folds(rows, folds), "folds")
    both = d.groupBy("fold").agg(F.count_if(F.col("role") == "train").alias("a"), F.count_if(F.col("role") == "test").alias("b"), F.count_distinct(F.when(F.col("role") == "train", F.col("target"))).alias("c"))
    known = [r["fold"] for r in both.where("a > 0 and b > 0 and c > 1").orderBy("fold").collect()]  # a row a fold

    def one(f):
        part = d.where(F.col("fold") == f)
        model = fit(part.where("role = 'train'"), features, kind=kind)
        return cut(window_performance(score(model, part.where("role = 'test'"), features).withColumn("fold", F.lit(f)), ["fold"], threshold=threshold), "fold")

    parts = in_parallel(rows.sparkSession, [lambda f=f: one(f) for f in known], threads)
    out = None
    for p in parts:
        out = p if out is None else out.unionByName(p)
    return out


def walk_forward_ml(windows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Of the windows of a walk-forward (win_rate, profit_factor): how many, the percentage with a profit factor over 1, the
    mean win rate, the mean profit factor of those under 100 (0 if there is none), and whether 60 % or more are profitable."""
    n, good = F.count("*"), F.count_if(F.col("profit_factor") > 1.0)
    share = F.when(n > 0, good / n * 100.0).otherwise(0.0)
    return windows.groupBy(*(by or [])).agg(n.alias("windows"), share.alias("profitable_windows_pct"), F.coalesce(F.avg("win_rate"), F.lit(0.0)).alias("avg_win_rate"), F.coalesce(F.avg(F.when(F.col("profit_factor") < 100, F.col("profit_factor"))), F.lit(0.0)).alias("avg_profit_factor"), (share >= 60.0).alias("passes"))


#: Regimes of the models, and the code of each symbol that models know.
REGIMES = {"trend": ("trend_up", "trend_down"), "high_vol": ("high_vol",), "range": ("range",)}
SYMBOL_CODES = {"BTCUSDT": 0, "ETHUSDT": 1, "SOLUSDT": 2}


def with_symbol_code(rows: DataFrame, codes: dict[str, int] = SYMBOL_CODES) -> DataFrame:
    """rows with symbol_encoded, -1 for a symbol that has no code."""
    code = F.coalesce(*(F.when(F.col("symbol") == s, k) for s, k in codes.items()), F.lit(-1))
    return rows.withColumn("symbol_encoded", code.cast("double"))


def selection_data(features: DataFrame, regime: str, up: float, down: float, horizon: int, test_share: float = 0.2) -> DataFrame:
    """Labelled rows of a regime for choosing features, with role: of each symbol the first rows train, the last share test,
    by counts of rows."""
    from tapeloom.operators.labels import target_rows, triple_barrier

    d = target_rows(triple_barrier(features, up, down, horizon))
    d = d.where(F.col("regime").isin(*REGIMES[regime])).drop("bar_idx")
    d = cut(index_bars(d, name="_nth"), "selection")
    n = d.groupBy("symbol").agg(F.count("*").alias("_n"))
    return d.join(n, "symbol").withColumn("role", F.when(F.col("_nth") < F.floor(F.col("_n") * (1.0 - test_share)), "train").otherwise("test")).drop("_nth", "_n")


def cell_summary(features: DataFrame, grid: list[tuple[float, float, int]]) -> DataFrame:
    """Without any training: of each cell and symbol the decided rows, the share of longs, and the least, largest and mean
    weight."""
    from tapeloom.operators.labels import grid_labels, uniqueness_weights

    d = cut(grid_labels(features, grid, keep=["symbol", "open_time"]).where("label <> 0"), "cells")
    cell = F.concat_ws("|", "symbol", "up", "down", "horizon")
    w = uniqueness_weights(d.withColumn("_symbol", F.col("symbol")).withColumn("symbol", cell), "bar_idx", "t1_bar")
    return w.groupBy(F.col("_symbol").alias("symbol"), "up", "down", "horizon").agg(F.count("*").alias("rows"), F.round(F.count_if(F.col("label") == 1) / F.count("*"), 4).alias("pos_frac"), F.min("weight").alias("w_min"), F.max("weight").alias("w_max"), F.avg("weight").alias("w_mean"))


def grid_search(features: DataFrame, names: list[str], grid: list[tuple[float, float, int]], cut_ms: int, embargo: int = 24, low: float = 35.0, high: float = 65.0, kind: str = "logistic", threshold: float = 0.55, threads: int = 4, refit: str = "gbt"):
    """(cells, model, cell): every balanced cell fitted on what is before the cut and judged on what is after it, some at a
    time; the best one by rank_grid is fitted again as `refit` on the same rows. Labels of all cells come from one pass."""
    from tapeloom.operators.backtest import window_performance
    from tapeloom.operators.labels import grid_labels, temporal_split, uniqueness_weights

    d = cut(grid_labels(features, grid).where("label <> 0").withColumnRenamed("label", "target"), "cells")
    share = F.count_if(F.col("target") == 1) * 100.0 / F.count("*")
    good = d.groupBy("up", "down", "horizon").agg(F.count("*").alias("n"), share.alias("long_pct")).where(F.col("long_pct").between(low, high)).orderBy("up", "down", "horizon").collect()  # a row a cell

    def rows_of(c):
        own = d.where((F.col("up") == c["up"]) & (F.col("down") == c["down"]) & (F.col("horizon") == c["horizon"])).withColumn("_bar_idx", F.col("bar_idx"))
        return cut(temporal_split(uniqueness_weights(own), cut_ms, embargo), "cell")

    def judge(c):
        own = rows_of(c)
        model = fit(own.where("role = 'train'"), names, kind=kind)
        r = window_performance(score(model, own.where("role = 'test'"), names), [], threshold=threshold).first()
        return (c["up"], c["down"], c["horizon"], c["n"], c["long_pct"], r["win_rate"] / 100.0, r["profit_factor"], r["signals"])

    found = in_parallel(features.sparkSession, [lambda c=c: judge(c) for c in good], threads)
    cells = features.sparkSession.createDataFrame(found, "up double, down double, horizon int, n long, long_pct double, win_rate double, profit_factor double, signals long")
    ranked = rank_grid(cells)
    best = ranked.first()
    model = fit(rows_of(best).where("role = 'train'"), names, kind=refit) if best else None
    return ranked, model, best


def rank_grid(cells: DataFrame) -> DataFrame:
    """Cells (win_rate as a share, profit_factor) by (win_rate - .5) * profit_factor * 10, factors from 100 on counting as 1."""
    pf = F.when(F.col("profit_factor") >= 100, 1.0).otherwise(F.col("profit_factor"))
    return cells.withColumn("score", (F.col("win_rate") - 0.5) * pf * 10.0).orderBy(F.desc("score"), *(c for c in ("up", "down", "horizon") if c in cells.columns))
