"""Quality classifier: ridge regression on random Fourier features of document statistics, with isotonic calibration.

1. One pass turns each whole text into STATISTICS numbers (shares of character classes, word lengths, repeats, line shapes).
2. Labelled training rows are standardized and mapped to `features` cosines with random directions, whose inner products
   approximate a Gaussian kernel. Each task adds up its rows' normal equations, a matrix of fixed size; the sums of all tasks are solved
   on the driver. All training rows count, nothing is sampled.
3. The ridge scores of calibration rows (a part of the training rows that the fit has not seen) are summed in SCORE_BINS bins of equal width,
   and pooled into a non-decreasing function of the score. Prediction interpolates in it.

Null and empty texts have all-zero statistics and are scored like any other; very long ones are read whole, one at a time. Equal texts have equal scores. An empty table gives an empty one. Labels other than 0 and 1, null labels and labels without a
document are passed over; a document with several labels counts once for each. Without training rows of both kinds every score is the share
of label 1, or 0.5 without any. Rows without an id are scored, never trained on. Repeated rows stay repeated rows. Other columns, whatever their names, are ignored.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quire.llm.common import filter_arrow, map_arrow, saved
from quire.llm.wordhash import WordHasher
from quire.shipping import ship

FEATURES, RIDGE, SEED = 256, 1e-2, 7
SCORE_BINS = 512

_BYTES = np.arange(256)
#: Classes of bytes; each text's share of them is a statistic.
CLASSES = (
    (_BYTES >= 97) & (_BYTES <= 122),
    (_BYTES >= 65) & (_BYTES <= 90),
    (_BYTES >= 48) & (_BYTES <= 57),
    _BYTES == 32,
    _BYTES == 10,
    np.isin(_BYTES, [ord(c) for c in ".,;:'\"-()"]),
    np.isin(_BYTES, [ord(c) for c in "!?"]),
    np.isin(_BYTES, [ord(c) for c in "#$%&*@^~+=<>/\\_"]),
    np.isin(_BYTES, [ord(c) for c in "|[]{}`"]),
    _BYTES >= 128,
    (_BYTES < 32) & ~np.isin(_BYTES, [9, 10, 13]),
)
STATISTICS = len(CLASSES) + 11


def statistics(column: pa.Array, hasher: WordHasher) -> np.ndarray:
    """One row of numbers a text."""
    words, at = hasher.words(column)
    out = np.zeros((len(column), STATISTICS))
    groups = np.stack(CLASSES).astype(np.float64)
    for row, value in enumerate(column):
        raw = value.as_buffer()
        if raw is None or not raw.size:
            continue
        data = np.frombuffer(raw, np.uint8)
        counts = np.bincount(data, minlength=256)
        n = len(data)
        own = words[at[row] : at[row + 1]]
        k = max(1, len(own))
        shares = groups @ counts / n
        kinds, times = np.unique(own, return_counts=True)
        lines = counts[10] + 1
        upper, lower = shares[1], shares[0]
        out[row, : len(CLASSES)] = shares
        out[row, len(CLASSES) :] = (
            np.log1p(n),
            np.log1p(len(own)),
            n / k / 10,
            np.log1p(n / lines),
            len(kinds) / k,
            times.max(initial=0) / k,
            float(np.count_nonzero(own[1:] == own[:-1])) / k,
            float(np.count_nonzero(own[2:] == own[:-2])) / k,
            upper / (upper + lower) if upper + lower else 0.0,
            (counts[33] + counts[124] + counts[35] + counts[36] + counts[37] + counts[38] + counts[42]) / k,
            counts[46] / k,
        )
    return out


class Model:
    """Standardization, random directions, ridge weights and calibration."""

    def __init__(self, mean: np.ndarray, scale: np.ndarray, features: int, seed: int):
        draw = np.random.default_rng(seed)
        self.mean, self.scale = mean, scale
        self.directions = draw.normal(size=(len(mean), features)) / np.sqrt(len(mean))
        self.phases = draw.uniform(0, 2 * np.pi, features)
        self.weights = np.zeros(features + 1)
        self.low, self.high = 0.0, 1.0
        self.knots = self.values = np.zeros(0)

    def mapped(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.hstack([np.sqrt(2 / len(self.phases)) * np.cos(z @ self.directions + self.phases), np.ones((len(x), 1))])

    def raw(self, x: np.ndarray) -> np.ndarray:
        return self.mapped(x) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        if not len(self.values):
            return np.full(len(x), 0.5)
        return np.clip(np.interp(self.raw(x), self.knots, self.values), 0, 1)


def isotonic(values: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The nearest non-decreasing sequence, by pooling adjacent violators."""
    pools: list[list[float]] = []
    for value, weight in zip(values, weights, strict=True):
        pools.append([value, weight, 1])
        while len(pools) > 1 and pools[-2][0] >= pools[-1][0]:
            v, w, n = pools.pop()
            last = pools[-1]
            last[0] = (last[0] * last[1] + v * w) / (last[1] + w)
            last[1] += w
            last[2] += n
    return np.repeat([p[0] for p in pools], [int(p[2]) for p in pools])


def _array(raw: bytes) -> np.ndarray:
    return np.frombuffer(raw, np.float64)


def document_statistics(docs: DataFrame, keep: dict[str, Column], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id, the columns of keep, and stats, the statistics as one binary of doubles."""

    extra = list(keep)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = WordHasher()
        for batch in batches:
            stats = statistics(batch.column(batch.num_columns - 1), hasher)
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([x.tobytes() for x in stats], pa.binary())], names=["id", *extra, "stats"])

    rows = docs.select(F.col(id_col).alias("id"), *(c.alias(k) for k, c in keep.items()), F.col(text_col).alias("text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return map_arrow(rows, work, f"{kinds}, stats binary")


#: Vectors that one task of a round adds up, and that the driver does.
MERGED = 16


def _sums(rows: DataFrame, one: Callable[[np.ndarray, np.ndarray], np.ndarray]) -> np.ndarray:
    """The sum over all rows of one(labels, statistics), a vector of fixed size; added up in each task, then MERGED at a time in rounds, and the last of them here."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            if batch.num_rows:
                stats = np.stack([_array(x) for x in batch.column(1).to_pylist()])
                part = one(batch.column(0).to_numpy().astype(np.float64), stats)
                total = part if total is None else total + part
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = None
        for batch in batches:
            for raw in batch.column(0).to_pylist():
                total = _array(raw) if total is None else total + _array(raw)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sums"])

    merged, left = map_arrow(rows.select("label", "stats"), add, "sums binary"), rows.rdd.getNumPartitions()
    while left > MERGED:
        left = -(-left // MERGED)
        merged = map_arrow(merged.repartition(left), merge, "sums binary")
    got = [_array(r["sums"]) for r in merged.collect()]
    return sum(got) if got else one(np.zeros(0), np.zeros((0, STATISTICS)))


def fit(labelled: DataFrame, features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> Model:
    """labelled: label (0 or 1), calibrates (boolean) and stats."""
    moments = _sums(labelled, lambda y, x: np.concatenate([[len(y), y.sum()], x.sum(axis=0), (x * x).sum(axis=0)]))
    n, ones = moments[0], moments[1]
    mean = moments[2 : 2 + STATISTICS] / max(n, 1)
    scale = np.sqrt(np.maximum(moments[2 + STATISTICS :] / max(n, 1) - mean**2, 0))
    model = Model(mean, np.where(scale > 1e-9, scale, 1.0), features, seed)
    if n == 0 or ones in (0, n):
        if n:
            model.knots, model.values = np.zeros(1), np.array([ones / n])
        return model
    width = features + 1

    def normal(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        z = model.mapped(x)
        return np.concatenate([(z.T @ z).ravel(), z.T @ y])

    sums = _sums(labelled.where("not calibrates"), normal)
    matrix = sums[: width * width].reshape(width, width) + ridge * np.eye(width)
    model.weights = np.linalg.solve(matrix, sums[width * width :])

    def binned(y: np.ndarray, x: np.ndarray) -> np.ndarray:
        scores = model.raw(x)
        at = np.clip(((scores + 1) / 3 * SCORE_BINS).astype(int), 0, SCORE_BINS - 1)
        return np.concatenate([np.bincount(at, minlength=SCORE_BINS), np.bincount(at, y, SCORE_BINS), np.bincount(at, scores, SCORE_BINS)]).astype(np.float64)

    count, positive, total = _sums(labelled.where("calibrates"), binned).reshape(3, SCORE_BINS)
    used = count > 0
    if used.any():
        model.knots = total[used] / count[used]
        model.values = isotonic(positive[used] / count[used], count[used])
    else:
        model.knots, model.values = np.array([0.0, 1.0]), np.array([0.0, 1.0])
    return model


def _learned(docs: DataFrame, labels: DataFrame, held_out: Column, calibrates: Column, id_col: str, text_col: str, label_col: str, features: int, ridge: float, seed: int) -> tuple[DataFrame, Model]:
    """Every document's statistics, and the model of those that are labelled and not held out."""
    stats = saved(document_statistics(docs, {"held_out": held_out, "calibrates": calibrates}, id_col, text_col))
    known = labels.where(F.col(label_col).isin(0, 1)).select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("label"))
    labelled = saved(stats.where("not held_out").join(known, "id").select("label", "calibrates", "stats"))
    return stats, fit(labelled, features, ridge, seed)


def keep_good(docs: DataFrame, labels: DataFrame, held_out: Column, calibrates: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> DataFrame:
    """The rows of docs that classify() would predict as 1, with their columns."""
    _, model = _learned(docs, labels, held_out, calibrates, id_col, text_col, label_col, features, ridge, seed)

    def keeps():
        hasher = WordHasher()
        return lambda texts: (model.score(statistics(texts, hasher)) >= threshold).tolist() if len(texts) else []

    return filter_arrow(docs, text_col, keeps)


def classify(docs: DataFrame, labels: DataFrame, held_out: Column, calibrates: Column, threshold: float = 0.3, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", features: int = FEATURES, ridge: float = RIDGE, seed: int = SEED) -> DataFrame:
    """Per row of docs: id, held_out, score (0 to 1) and predicted (1 from threshold on). Held-out rows' labels are never read."""
    stats, model = _learned(docs, labels, held_out, calibrates, id_col, text_col, label_col, features, ridge, seed)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw = batch.column(2).to_pylist()
            scores = model.score(np.stack([_array(x) for x in raw])) if raw else np.zeros(0)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(scores), pa.array((scores >= threshold).astype(np.int32))], names=["id", "held_out", "score", "predicted"])

    kind = stats.schema["id"].dataType.simpleString()
    return map_arrow(stats.select("id", "held_out", "stats"), work, f"id {kind}, held_out boolean, score double, predicted int").withColumnRenamed("id", id_col)


ship(__name__)
