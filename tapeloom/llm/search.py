"""Exact top-k search by inner product with pivot-table elimination.

A table, made and written once, holds the distances of every vector to a few dozen pivots, which lie far apart. For every
pivot p, |d(q, p) - d(x, p)| is a lower bound of d(q, x), and the largest of them bounds the inner product from above:
q.x = (|q|^2 + |x|^2 - d(q, x)^2) / 2. Vectors are dealt out in blocks of those with the same nearest pivot. A query looks
first into the blocks of its own nearest pivot; the k-th best score that it finds there goes with it, and it is sent on only
to blocks where the range of distances to every pivot leaves room for a better one. A block's rows are split in the same way,
by the pivot whose distances range farthest, into short runs; of a block's queries those whose bounds leave a run, nearer runs
first, take its scores in one product of matrices. Where products may exceed what a double holds exactly, a query looks at
candidates one by one in the order of their bounds and stops as soon as no further bound reaches its k-th best score.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import Accumulator
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tapeloom.llm.common import materialise

#: Pivots, and rows (those with the least hashes of their numbers) that they are picked from.
PIVOTS, PIVOT_SAMPLE = 32, 4096
#: Candidates, and queries, that one task holds at most, about.
BLOCK, QUERY_BLOCK = 32_768, 8192
_RUN = 64  # rows of a run at most
_PER_STEP = 64  # candidates evaluated at a time, in the order of their bounds


def integer_vectors(df: DataFrame, id_col: str = "vec_id", vector: str = "embedding", scale: float = 256.0) -> DataFrame:
    """(row, id, v), written: a number of the row, and floor(scale * x) of its components as whole doubles. Null vectors, null
    ids and vectors with null, NaN or infinite components take no part. Rows of one id each stand for themselves."""
    fine = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(vector, lambda x: F.col("_") * x.cast("double"))
    rows = df.where(F.col(id_col).isNotNull() & F.col(vector).isNotNull()).where(fine).select(F.col(id_col).cast("long").alias("id"), F.col(vector), F.lit(float(scale)).alias("_"))
    # floor() gives longs, which end at 2^63; doubles beyond 2^52 are whole anyway
    v = F.transform(whole, lambda x: F.when(F.abs(x) < 2.0**52, F.floor(x).cast("double")).otherwise(x))
    return materialise(rows.select(F.monotonically_increasing_id().alias("row"), "id", v.alias("v")), "vectors")


def pivots_of(x: np.ndarray, n: int) -> np.ndarray:
    """n pivots of a sample, each the vector farthest from those before it."""
    picked = [int(np.argmax((x * x).sum(axis=1)))]
    far = ((x - x[picked[0]]) ** 2).sum(axis=1)
    while len(picked) < min(n, len(x)):
        picked.append(int(np.argmax(far)))
        far = np.minimum(far, ((x - x[picked[-1]]) ** 2).sum(axis=1))
    return x[picked]


def _padded(vectors: list, n: int) -> np.ndarray:
    """Vectors cut, or filled up with zeros, to n components: one and the same pivot for all vectors of that length."""
    out = np.zeros((len(vectors), n))
    for i, v in enumerate(vectors):
        out[i, : min(n, len(v))] = v[:n]
    return out


def _matrix(column, n: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten() if isinstance(column, pa.ChunkedArray) else column.flatten(), float).reshape(-1, n)


def pivot_table(vectors: DataFrame, pivots: list) -> DataFrame:
    """vectors (row, id, v) with n, their lengths, d, their distances to the pivots, and pivot, the nearest one's number."""

    def run(batches):
        for b in batches:
            d = np.zeros((b.num_rows, len(pivots)), np.float32)
            values = b.column(2).to_pylist()
            for n in {len(v) for v in values}:
                at = np.flatnonzero([len(v) == n for v in values])
                x, p = np.asarray([values[i] for i in at], float).reshape(len(at), n), _padded(pivots, n)
                with np.errstate(all="ignore"):
                    d[at] = np.sqrt(np.maximum(0, (x * x).sum(axis=1)[:, None] + (p * p).sum(axis=1) - 2 * x @ p.T))
            d = np.nan_to_num(d, nan=np.inf)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array([len(v) for v in values], pa.int32()), pa.ListArray.from_arrays(pa.array(np.arange(len(d) + 1) * len(pivots), pa.int32()), pa.array(d.reshape(-1))), pa.array(d.argmin(axis=1), pa.int32())], names=["row", "id", "v", "n", "d", "pivot"])

    return materialise(vectors.select("row", "id", "v").mapInArrow(run, "row long, id long, v array<double>, n int, d array<float>, pivot int"), "pivot-table")


def _bounds(q2, x2, low, largest):
    """Upper bounds of inner products from lower bounds of distances, with room for the rounding of single precision."""
    with np.errstate(all="ignore"):
        return np.nan_to_num((q2 + x2 - low * low) / 2 + 4e-6 * (1 + largest), nan=np.inf, posinf=np.inf)


def _gaps(a, b, axis):
    with np.errstate(all="ignore"):
        return np.nan_to_num(np.abs(a - b), nan=0.0, posinf=0.0).max(axis=axis, initial=0.0)


def _runs(d: np.ndarray) -> list[np.ndarray]:
    """Rows with like distances to the pivots, in halves of halves of a block."""
    runs, left = [], [np.arange(len(d))]
    while left:
        at = left.pop()
        if len(at) <= _RUN:
            runs.append(np.sort(at))
            continue
        with np.errstate(all="ignore"):
            widest = int(np.argmax(np.nan_to_num(np.ptp(d[at], axis=0), nan=0.0)))
        half = np.argpartition(d[at, widest], len(at) // 2)
        left += [at[half[: len(at) // 2]], at[half[len(at) // 2 :]]]
    return runs


def _search_runs(q, q_rows, q_d, floor, x, rows, ids, d, k: int, largest: float) -> tuple[list, int]:
    """search_block for vectors whose products are exact in doubles."""
    runs, x2, q2 = _runs(d), (x * x).sum(axis=1), (q * q).sum(axis=1)
    gaps, run_of = np.empty((len(runs), len(q)), np.float32), np.empty(len(x), int)
    for r, at in enumerate(runs):
        run_of[at] = r
        with np.errstate(all="ignore"):
            off = np.maximum(0, np.maximum(d[at].min(axis=0) - q_d, q_d - d[at].max(axis=0)))
        gaps[r] = np.nan_to_num(off, nan=0.0, posinf=0.0).max(axis=1, initial=0.0)
    by_row = np.argsort(rows)
    own = by_row[np.minimum(np.searchsorted(rows, q_rows, sorter=by_row), len(rows) - 1)]
    own_run = np.where(rows[own] == q_rows, run_of[own], -1)
    best, of = np.full((len(q), k), -np.inf), np.full((len(q), k), np.iinfo(np.int64).max)
    reached, seen = floor.astype(float), 0
    for r in np.argsort(gaps.mean(axis=1), kind="stable"):
        at = runs[r]
        asks = np.flatnonzero(_bounds(q2, x2[at].max(), gaps[r].astype(float), largest) >= reached)
        if not len(asks):
            continue
        scores = q[asks] @ x[at].T
        mine = np.flatnonzero(own_run[asks] == r)
        scores[mine, np.searchsorted(at, own[asks[mine]])] = -np.inf
        seen += scores.size - len(mine)
        good = (scores >= reached[asks][:, None]) & (scores > -np.inf)
        hit = np.flatnonzero(good.any(axis=1))
        if len(hit):
            j = asks[hit]
            both = np.concatenate([best[j], np.where(good[hit], scores[hit], -np.inf)], axis=1)
            who = np.concatenate([of[j], np.broadcast_to(ids[at], (len(hit), len(at)))], axis=1)
            first = np.lexsort((who, -both), axis=1)[:, :k]
            best[j], of[j] = np.take_along_axis(both, first, 1), np.take_along_axis(who, first, 1)
            reached[j] = np.maximum(floor[j], best[j, -1])
    return [(int(j), int(best[j, i]), int(of[j, i])) for j, i in np.argwhere(best > -np.inf)], seen


def search_block(q: np.ndarray, q_rows, q_d: np.ndarray, floor: np.ndarray, x: np.ndarray, rows, ids, d: np.ndarray, k: int) -> tuple[list, int]:
    """The k best of a block for every query, of those that reach its floor: (index of query, score, id), and how many
    candidates were evaluated. Exact; ties go to the smaller id."""
    order = np.argsort(ids, kind="stable")
    x, ids, rows, d = x[order], ids[order], rows[order], d[order]
    with np.errstate(all="ignore"):
        x2, q2 = (x * x).sum(axis=1), (q * q).sum(axis=1)
        top = np.abs(x).max(initial=0) * np.abs(q).max(initial=0) * max(1, x.shape[1])
    largest = max(x2.max(initial=0), q2.max(initial=0), float(np.square(d.astype(float)).max(initial=0)))
    if top < 2.0**53:
        return _search_runs(q, q_rows, q_d, floor, x, rows, ids, d, k, largest)
    safe, d = top < 2.0**62, d.T.copy()
    xi, qi = (x.astype(np.int64), q.astype(np.int64)) if safe else ([[int(c) for c in v] for v in x], [[int(c) for c in v] for v in q])
    out, seen = [], 0
    for j in range(len(q)):
        bound = _bounds(q2[j], x2, _gaps(d, q_d[j][:, None], 0), largest)
        bound[rows == q_rows[j]] = -np.inf
        left = np.flatnonzero(bound >= floor[j])
        left = left[np.argsort(-bound[left], kind="stable")]
        best: list[tuple] = []
        for at in range(0, len(left), _PER_STEP):
            step = left[at : at + _PER_STEP]
            if len(best) == k and bound[step[0]] < best[-1][0] or bound[step[0]] == -np.inf:
                break
            step = step[bound[step] > -np.inf]
            scores = (xi[step] @ qi[j]).tolist() if safe else [sum(map(int.__mul__, xi[i], qi[j])) for i in step]
            seen += len(step)
            best = sorted([*best, *zip(scores, ids[step].tolist())], key=lambda r: (-r[0], r[1]))[:k]
        out += [(j, s, i) for s, i in best]
    return out, seen


_FOUND = "query_row long, query_id long, score long, wide double, vec_id long"


def _cells(candidates: DataFrame, queries: DataFrame, k: int, evaluated: Accumulator | None) -> DataFrame:
    """Found rows of every cell: candidates (c, sub, q, ...) and queries (c, sub, q, ..., floor) of one block and length."""

    def run(key, a: pa.Table, b: pa.Table) -> pa.Table:
        found = []
        if a.num_rows and b.num_rows:
            n = key[3].as_py()
            get = lambda t, c: np.asarray(t[c].combine_chunks())
            x, q, pivots = _matrix(a["v"], n) if n else np.zeros((a.num_rows, 0)), _matrix(b["v"], n) if n else np.zeros((b.num_rows, 0)), len(a["d"][0])
            q_rows, q_ids = get(b, "row"), get(b, "id")
            got, seen = search_block(q, q_rows, _matrix(b["d"], pivots), get(b, "floor"), x, get(a, "row"), get(a, "id"), _matrix(a["d"], pivots).astype(np.float32), k)
            if evaluated is not None:
                evaluated.add(seen)
            found = [(int(q_rows[j]), int(q_ids[j]), max(-(1 << 63), min((1 << 63) - 1, s)), float(s) if abs(s) < 10**300 else np.inf * (1 if s > 0 else -1), i) for j, s, i in got]
        columns = list(zip(*found, strict=True)) or [[]] * 5
        return pa.table({c: pa.array(v, t) for c, v, t in zip(("query_row", "query_id", "score", "wide", "vec_id"), columns, (pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.int64()), strict=True)})

    return candidates.groupBy("c", "sub", "q", "n").cogroup(queries.groupBy("c", "sub", "q", "n")).applyInArrow(run, _FOUND)


def search(vectors: DataFrame, is_query, k: int = 5, block: int = BLOCK, query_block: int = QUERY_BLOCK, n_pivots: int = PIVOTS, evaluated: Accumulator | None = None) -> DataFrame:
    """The k best of all other rows for every row for which is_query holds: (query_id, rank, vec_id, score).

    vectors: (row, id, v), as from integer_vectors. Only vectors of one length are compared; rows of equal ids each stand for
    themselves, as queries and as candidates. A row goes once to the blocks of queries of its pivot, a query to the blocks that
    its bounds leave; a task holds one block of each. Scores beyond a long are cut to its ends, and ranked by the nearest
    double. No rows give no rows. evaluated: counts the candidates whose inner products were worked out.
    """
    spark = vectors.sparkSession
    sample = [r["v"] for r in vectors.orderBy(F.xxhash64("row"), "row").select("v").limit(PIVOT_SAMPLE).collect()]  # bounded
    if not sample:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    with np.errstate(all="ignore"):
        pivots = np.nan_to_num(pivots_of(_padded(sample, max(map(len, sample))), n_pivots)).tolist()
    rows = pivot_table(vectors, pivots)
    rows = rows.withColumn("asks", F.coalesce(is_query, F.lit(False)))
    ranges = [f(F.col("d")[i]).alias(f"{name}{i}") for i in range(len(pivots)) for name, f in (("a", F.min), ("b", F.max))]
    x2 = F.max(F.aggregate("v", F.lit(0.0), lambda s, c: s + c * c)).alias("x2")
    kept = {r["pivot"]: r for r in rows.groupBy("pivot").agg(F.count("*").alias("m"), x2, *ranges).collect()}  # a row for each pivot
    n_queries = rows.where("asks").count()
    n_q = max(1, -(-n_queries // query_block))
    subs = F.create_map(*(F.lit(z) for p, r in kept.items() for z in (p, -(-r["m"] // block))))
    q_of = F.pmod(F.xxhash64("row", F.lit(1)), F.lit(n_q)).cast("int").alias("q")
    fields = ["row", "id", "v", "n", "d"]
    candidates = rows.select(F.col("pivot").alias("c"), F.pmod(F.xxhash64("row"), subs[F.col("pivot")]).cast("int").alias("sub"), F.explode(F.sequence(F.lit(0), F.lit(n_q - 1))).alias("q"), *fields)
    asked = rows.where("asks").select(*fields, "pivot", q_of)
    into = lambda frame, c: frame.withColumn("c", c).withColumn("sub", F.explode(F.sequence(F.lit(0), subs[F.col("c")] - 1)))

    home = into(asked.withColumn("floor", F.lit(float("-inf"))), F.col("pivot"))
    first = materialise(_cells(candidates, home.select("c", "sub", "q", "floor", *fields), k, evaluated), "found-at-home")
    place = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("wide"), "vec_id"))
    floors = first.withColumn("place", place).where(F.col("place") == k).select(F.col("query_row").alias("row"), F.least(F.col("score").cast("double"), "wide").alias("floor"))

    numbers = sorted(kept)
    low = np.asarray([[kept[c][f"a{i}"] for i in range(len(pivots))] for c in numbers])
    high = np.asarray([[kept[c][f"b{i}"] for i in range(len(pivots))] for c in numbers])
    most = np.asarray([kept[c]["x2"] for c in numbers])

    def reach(batches):
        """Queries with the pivots, but their own, whose blocks may hold a score of their floor."""
        for b in batches:
            at, to = [], []
            d, own, floor = _matrix(b.column(4), len(pivots)), np.asarray(b.column(5)), np.asarray(b.column(7))
            for j, v in enumerate(b.column(2).to_pylist()):
                with np.errstate(all="ignore"):
                    q2 = float(np.square(np.asarray(v, float)).sum())
                    gap = np.nan_to_num(np.maximum(0, np.maximum(low - d[j], d[j] - high)), nan=0.0, posinf=0.0).max(axis=1)
                    top = _bounds(q2, most, gap, np.maximum(np.maximum(q2, most), np.square(high.max(axis=1))))
                for c in np.flatnonzero(top >= floor[j]):
                    if numbers[c] != own[j]:
                        at.append(j), to.append(numbers[c])
            at = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(i).take(at) for i in (0, 1, 2, 3, 4, 6, 7)] + [pa.array(to, pa.int32())], names=[*fields, "q", "floor", "to"])

    open_ = asked.join(floors, "row", "left").select(*fields, "pivot", "q", F.coalesce("floor", F.lit(float("-inf"))).alias("floor"))
    sent = open_.mapInArrow(reach, "row long, id long, v array<double>, n int, d array<float>, q int, floor double, to int")
    away = into(sent, F.col("to")).select("c", "sub", "q", "floor", *fields)
    found = first.unionByName(_cells(candidates, away, k, evaluated))
    rank = F.row_number().over(Window.partitionBy("query_row").orderBy(F.desc("score"), F.desc("wide"), "vec_id"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
