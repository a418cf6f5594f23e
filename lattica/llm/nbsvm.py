"""Quality classifier: naive Bayes support vectors.

Indicators of a text's byte n-grams (2 to 4 bytes, hashed to 2**18 features) are scaled by the features' class log-count
ratios and to unit length; a linear hinge-loss model over them is fitted by dual coordinate descent. A logistic curve,
fitted on labelled rows that the descent has not seen, turns margins into scores of 0 to 1.

The fit takes TRAIN_DOCS labelled documents at most, those of the least hash of doc_id, whatever the size of the input, and
of these as many as have TRAIN_FEATURES indicators in all; the indicators (integers, not texts) reach the driver. A text has
2**18 of them at most, however long. Scoring runs over every whole text without a shuffle.

Defined results: labels and texts of repeated doc_ids count once (the lesser quality, the least text), null labels not at all; without documents of
both classes every score is 0.5; null and empty texts have no indicators, so the score of the bias; repeated rows get
equal scores; an empty table gives an empty table; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.llm.kernels import U, column_bytes, mix, slices
from lattica.llm.shared import drop_table, give_back, same_columns, trimmed, written

#: Labelled documents that a fit takes at most, and their indicators (four bytes each on the driver).
TRAIN_DOCS, TRAIN_FEATURES = 12_000, 80_000_000
#: The least score of a document that is predicted good.
LEAST = 0.7
BITS, SIZES = 18, (2, 3, 4)
SCHEMA = "doc_id long, held_out boolean, score double, predicted int"


def fold(doc_id: Column) -> Column:
    return F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4))


def indicators(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(feature, text) of the distinct n-grams of each text, by text."""
    n = len(data)
    text = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
    keys = []
    code = data.astype(U)
    for k in range(2, max(SIZES) + 1):
        if n < k:
            break
        code = code[: n - k + 1] << U(8) | data[k - 1 :].astype(U)
        if k in SIZES:
            inside = text[k - 1 :] == text[: n - k + 1]
            feature = mix(code[inside] + (U(k) << U(40))) >> U(64 - BITS)
            keys.append(feature | text[: n - k + 1][inside].astype(U) << U(BITS))
    if not keys:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    key = np.concatenate(keys)
    key.sort()
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    key = key[new]
    return (key & U((1 << BITS) - 1)).astype(np.int64), (key >> U(BITS)).astype(np.int64)


@dataclass
class Model:
    ratio: np.ndarray  # class log-count ratio of each feature
    weight: np.ndarray  # of the scaled features
    bias: float
    slope: float
    offset: float

    def margins(self, feature: np.ndarray, text: np.ndarray, n: int) -> np.ndarray:
        ratio = self.ratio[feature]
        norm = np.sqrt(np.bincount(text, ratio * ratio, n))
        return np.bincount(text, ratio * self.weight[feature], n) / np.where(norm > 0, norm, 1) + self.bias

    def scores(self, margins: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * margins + self.offset, -50, 50)))


def descend(rows: list[np.ndarray], values: Sequence[np.ndarray], y: np.ndarray, n_features: int, c: float = 1.0, epochs: int = 12, seed: int = 7) -> tuple[np.ndarray, float]:
    """(weights, bias) of the L1-loss linear SVM by dual coordinate descent; a constant feature stands for the bias."""
    w, bias = np.zeros(n_features), 0.0
    alpha = np.zeros(len(rows))
    square = np.array([float(v @ v) + 1.0 for v in values])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            value = values[i]
            gradient = y[i] * (w[rows[i]] @ value + bias) - 1
            new = min(max(alpha[i] - gradient / square[i], 0.0), c)
            change = new - alpha[i]
            if change:
                w[rows[i]] += change * y[i] * value
                bias += change * y[i]
                alpha[i] = new
                worst = max(worst, abs(change))
        if worst < 1e-3:
            break
    return w, bias


class Scaled(Sequence):
    """The rows' ratios at unit length, made when asked for: kept ones would take as much memory as the rows."""

    def __init__(self, ratio: np.ndarray, rows: list[np.ndarray]):
        self.ratio, self.rows = ratio, rows

    def __len__(self) -> int:
        return len(self.rows)

    def __getitem__(self, i: int) -> np.ndarray:
        v = self.ratio[self.rows[i]]
        return (v / (np.linalg.norm(v) or 1.0)).astype(np.float32)


def logistic(margin: np.ndarray, y: np.ndarray, steps: int = 50) -> tuple[float, float]:
    """Slope and offset of the logistic curve through (margin, y in {0, 1}) by Newton's method, with smoothed targets."""
    hit, miss = y.sum(), len(y) - y.sum()
    t = np.where(y > 0, (hit + 1) / (hit + 2), 1 / (miss + 2))
    beta = np.array([1.0, 0.0])
    x = np.stack([margin, np.ones_like(margin)], axis=1)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ beta, -50, 50)))
        h = (x * (p * (1 - p))[:, None]).T @ x + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p) - 1e-6 * beta)
        beta = beta + np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def fit(rows: list[np.ndarray], labels: np.ndarray, smoothing: float = 1.0) -> Model | None:
    """rows: the features of each document; labels 0 or 1. None unless both classes occur often enough to set some aside."""
    y = np.asarray(labels, np.int64)
    if min((y == 0).sum(), (y == 1).sum()) < 1:
        return None
    n = 1 << BITS
    aside = np.zeros(len(y), bool)
    for k in (0, 1):
        of = np.flatnonzero(y == k)
        aside[of[: len(of) // 5]] = True  # rows come in hash order
    use = np.flatnonzero(~aside)
    counts = [np.full(n, smoothing), np.full(n, smoothing)]
    for i in use:
        counts[y[i]][rows[i]] += 1
    ratio = np.log(counts[1] / counts[1].sum()) - np.log(counts[0] / counts[0].sum())

    scaled = Scaled(ratio, rows)
    used = [rows[i] for i in use]
    w, bias = descend(used, Scaled(ratio, used), 2.0 * y[use] - 1, n)
    model = Model(ratio, w, bias, 1.0, 0.0)
    check = np.flatnonzero(aside) if aside.any() and len(set(y[aside])) == 2 else use
    margin = np.array([scaled[i] @ w[rows[i]] + bias for i in check])
    model.slope, model.offset = logistic(margin, y[check])
    return model


def train(docs: DataFrame, labels: DataFrame, most: int = TRAIN_DOCS, most_features: int = TRAIN_FEATURES) -> Model | None:
    """Fits on labelled documents outside the held-out fold."""
    known = labels.where(F.col("quality").isNotNull() & F.col("doc_id").isNotNull() & (fold(F.col("doc_id")) != 2))
    chosen = known.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = column_bytes(batch.column("text"))
            for a, b in slices(offsets):
                o = offsets[a : b + 1]
                feature, text = indicators(data[o[0] : o[-1]], o - o[0])
                at = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=b - a))])
                lists = pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(feature, pa.int32()))
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(a, b - a), batch.column("quality").slice(a, b - a), pa.array(np.diff(at)), lists], names=["doc_id", "quality", "n", "features"]
                )

    sample = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").groupBy("doc_id").agg(F.min("text").alias("text"), F.min("quality").cast("int").alias("quality"))
    made = written(sample.mapInArrow(trimmed(features), "doc_id long, quality int, n long, features array<int>"), "nbsvm-features")
    sizes = made.select("doc_id", "n").toArrow()  # a row of two numbers for each of the chosen documents
    doc, n = sizes.column("doc_id").to_numpy(), sizes.column("n").to_numpy()
    order = np.lexsort((doc, mix(doc.astype(U))))
    taken = order[np.cumsum(n[order]) <= most_features]
    if not len(taken):
        drop_table(made)
        return None
    table = made.select("doc_id", "quality", "features").toArrow() if len(taken) == len(doc) else made.join(
        F.broadcast(docs.sparkSession.createDataFrame([(int(x),) for x in doc[taken]], "doc_id long")), "doc_id"
    ).select("doc_id", "quality", "features").toArrow()
    drop_table(made)
    doc, quality = table.column("doc_id").to_numpy(), table.column("quality").to_numpy()
    rows = []
    for chunk in table.column("features").chunks:
        # views: the features stay where Arrow put them
        flat, at = chunk.flatten().to_numpy(), np.concatenate([[0], np.cumsum(chunk.value_lengths().to_numpy())])
        rows += [flat[a:b] for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
    order = np.lexsort((doc, mix(doc.astype(U))))
    rows = [rows[i] for i in order]
    model = fit(rows, (quality[order] == 1).astype(np.int64))
    del rows, table, chunk, flat
    give_back()
    return model


def scored(docs: DataFrame, model: Model | None, keep: float | None = None, least: float = LEAST) -> DataFrame:
    """doc_id, held_out, score, predicted of every document; with keep, docs' rows of at least that score instead."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)  # 2**18 features, whatever the input

    def scores(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        out = []
        for a, b in slices(offsets):
            o = offsets[a : b + 1]
            if shared.value is None:
                out.append(np.full(b - a, 0.5))
            else:
                out.append(shared.value.scores(shared.value.margins(*indicators(data[o[0] : o[-1]], o - o[0]), b - a)))
        return np.concatenate(out) if out else np.zeros(0)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = scores(*column_bytes(batch.column("text")))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("held_out"), pa.array(s), pa.array((s >= least).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    text = docs.columns.index("text")

    def filtered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch.filter(pa.array(scores(*column_bytes(batch.column(text))) >= keep))

    if keep is not None:
        return same_columns(docs, filtered)
    return docs.select("doc_id", "text", F.coalesce(fold(F.col("doc_id")) == 2, F.lit(False)).alias("held_out")).mapInArrow(trimmed(score), SCHEMA)
