"""Document quality by regularised quadratic discriminant analysis over document statistics."""

from __future__ import annotations

import operator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tapeloom.llm.common import materialise, small
from tapeloom.llm.tokens import texts

#: Byte classes whose shares are statistics of a text.
_CLASSES = {
    "upper": list(range(65, 91)),
    "lower": list(range(97, 123)),
    "digit": list(range(48, 58)),
    "stop": list(b".,;:'\"?()"),
    "bang": list(b"!"),
    "mark": list(b"%&*#$@^~_=+<>{}[]\\/"),
    "bar": list(b"|"),
    "high": list(range(128, 256)),
    "line": [10],
}
_PICK = np.zeros((256, len(_CLASSES)))
for _j, _codes in enumerate(_CLASSES.values()):
    _PICK[_codes, _j] = 1
#: The shares also enter as the largest one over this many stretches of the text, for texts that are only partly junk.
_STRETCHES = 4
_NAMES = [*_CLASSES, *(f"most_{c}" for c in ("upper", "bang", "mark", "bar")), "length", "word_length", "distinct", "repeated", "commonest", "stretch_repeated"]
SIZE = len(_NAMES)
_MOST = [list(_CLASSES).index(c) for c in ("upper", "bang", "mark", "bar")]


def _ratio(k, n, weight: float = 20.0, prior: float = 0.02):
    """log of a share drawn towards a prior, so that short texts are not extreme."""
    return np.log((k + weight * prior) / (n + weight))


def statistics(text: str) -> np.ndarray:
    """The transformed statistics of a whole text; all finite, for empty and very long texts too."""
    raw = np.frombuffer(text.encode("utf-8", "replace"), np.uint8)
    n = len(raw)
    edges = [n * k // _STRETCHES for k in range(_STRETCHES + 1)]
    parts = np.stack([np.bincount(raw[a:b], minlength=256) for a, b in zip(edges, edges[1:])]) @ _PICK
    sizes = np.diff(edges)[:, None]
    shares = _ratio(parts.sum(axis=0), n)
    most = _ratio(parts, sizes).max(axis=0)[_MOST]
    words = text.split()
    w = len(words)
    counts: dict[str, int] = {}
    for x in words:
        counts[x] = counts.get(x, 0) + 1
    same = np.fromiter(map(operator.eq, words, words[1:]), bool, max(0, w - 1))
    cut = [len(same) * k // _STRETCHES for k in range(_STRETCHES + 1)]
    runs = max(_ratio(int(same[a:b].sum()), b - a) for a, b in zip(cut, cut[1:]))
    rest = [
        np.log1p(n),
        np.log((n + 6 * 5) / (w + 5)),
        # distinct words against what a text of that length is expected to have (a power of its length)
        np.log((len(counts) + 5) / (w + 5) ** 0.9),
        _ratio(int(same.sum()), w),
        _ratio(max(counts.values(), default=0), w, 20.0, 0.06),
        runs,
    ]
    return np.concatenate([shares, most, rest])


def document_statistics(docs: DataFrame, id_col: str, text: str) -> DataFrame:
    """(id, x): one row of statistics per row of docs, in one pass over the texts. Null texts count as empty."""

    def run(batches):
        for b in batches:
            x = np.stack([statistics(t or "") for _, t in texts(b, "_text")]) if b.num_rows else np.zeros((0, SIZE))
            flat = pa.array(x.reshape(-1), pa.float64())
            yield pa.RecordBatch.from_arrays([b.column(0), pa.ListArray.from_arrays(pa.array(np.arange(len(x) + 1) * SIZE, pa.int32()), flat)], names=[id_col, "x"])

    rows = docs.select(F.col(id_col), F.col(text).alias("_text"))
    return rows.mapInArrow(run, T.StructType([rows.schema[id_col], T.StructField("x", T.ArrayType(T.DoubleType()))]))


@dataclass
class Model:
    """Per class: log prior, mean, inverse of the Cholesky factor of its shrunk covariance, log of its determinant.

    temperature divides the difference of the log densities before it becomes a probability: the statistics of a text hang
    together, so that the densities alone would be far too sure of themselves. It moves no score across 0.5.
    """

    classes: dict[int, tuple[float, np.ndarray, np.ndarray, float]]
    base: float
    temperature: float = 4.0

    def score(self, x: np.ndarray) -> np.ndarray:
        if len(self.classes) < 2:
            return np.full(len(x), self.base)
        side = []
        for c in (0, 1):
            prior, mean, inverse, det = self.classes[c]
            z = (x - mean) @ inverse.T
            side.append(prior - 0.5 * ((z * z).sum(axis=1) + det))
        gap = np.clip((side[1] - side[0]) / self.temperature, -500, 500)
        return 1 / (1 + np.exp(-gap))


def moments(rows: DataFrame) -> dict[int, tuple[int, np.ndarray, np.ndarray]]:
    """rows (y, x) -> class: (n, sum of x, sum of x xT). Tasks add up their rows; only the sums are shuffled."""

    def run(batches):
        total = {c: np.zeros(1 + SIZE + SIZE * SIZE) for c in (0, 1)}
        for b in batches:
            y = b.column(0).to_numpy(zero_copy_only=False)
            x = np.asarray(b.column(1).flatten()).reshape(-1, SIZE)
            for c in (0, 1):
                z = x[y == c]
                total[c] += np.concatenate([[len(z)], z.sum(axis=0), (z.T @ z).reshape(-1)])
        for c, v in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([c] * len(v), pa.int32()), pa.array(range(len(v)), pa.int32()), pa.array(v, pa.float64())], names=["y", "k", "v"])

    got = rows.select(F.col("y").cast("int"), "x").mapInArrow(run, "y int, k int, v double").groupBy("y", "k").agg(F.sum("v").alias("v")).collect()
    out = {c: np.zeros(1 + SIZE + SIZE * SIZE) for c in (0, 1)}
    for r in got:
        out[r["y"]][r["k"]] = r["v"]
    return {c: (int(v[0]), v[1 : 1 + SIZE], v[1 + SIZE :].reshape(SIZE, SIZE)) for c, v in out.items()}


def fit(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], own: float = 0.7, ridge: float = 0.15) -> Model:
    """Covariance of a class: `own` parts itself and the rest pooled, then `ridge` parts of its diagonal; fewer rows
    than statistics lower `own` in proportion."""
    n = sum(s[0] for s in sums.values())
    base = sums[1][0] / n if n else 0.5
    if min(s[0] for s in sums.values()) < 2:
        return Model({}, base)
    spread = {c: q - np.outer(s, s) / k for c, (k, s, q) in sums.items()}
    pooled = sum(spread.values()) / n
    classes = {}
    for c, (k, s, _) in sums.items():
        share = own * k / (k + SIZE)
        cov = share * spread[c] / k + (1 - share) * pooled
        cov = (1 - ridge) * cov + ridge * np.diag(np.diag(cov)) + 1e-4 * np.eye(SIZE)
        low = np.linalg.cholesky(cov)
        classes[c] = (float(np.log(k / n)), s / k, np.linalg.inv(low), float(2 * np.log(np.diag(low)).sum()))
    return Model(classes, base)


def score_quality(docs: DataFrame, labels: DataFrame, train, label: str = "quality", id_col: str = "doc_id", text: str = "text", threshold: float = 0.3) -> DataFrame:
    """Fit on the labelled rows for which `train` (a condition on the id) holds and score every row of docs.

    (id, score, predicted): score is the probability of label 1, predicted is 1 from the threshold on. Null texts count
    as empty; rows without a label, or with a null one, are scored only; an id labelled more than once counts with its
    largest label; if a class has no rows the score is the share of label 1 (0.5 without any labels). Repeated rows each
    come back, null ids too. An empty table gives no rows. The fit uses sums over all training rows.
    """
    rows = materialise(document_statistics(docs, id_col, text), "statistics")
    known = labels.where(train).where(F.col(id_col).isNotNull() & F.col(label).isin(0, 1)).groupBy(id_col).agg(F.max(label).alias("y"))
    known = materialise(known, "labels")
    model = fit(moments(rows.join(small(known), id_col).select("y", "x")))
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        m = shared.value
        for b in batches:
            x = np.asarray(b.column(1).flatten()).reshape(-1, SIZE)
            s = m.score(x)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(s, pa.float64()), pa.array((s >= threshold).astype("int32"), pa.int32())], names=[id_col, "score", "predicted"])

    return rows.mapInArrow(run, T.StructType([rows.schema[id_col], T.StructField("score", T.DoubleType()), T.StructField("predicted", T.IntegerType())]))
