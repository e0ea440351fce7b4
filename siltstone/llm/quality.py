"""Quality classifier: Naive Bayes support vectors.

Indicators of n-grams are scaled by log-count ratios of the two classes, each text's vector is scaled
to length one, and a linear hinge-loss model is fitted by dual coordinate descent. The n-grams are
words, pairs of words, and runs of one to three word shapes; a shape says how a word is cased, what
its last byte is, its length class and whether it repeats the word before. They are hashed to
``WIDTH`` columns. A Platt sigmoid, fitted on sampled rows that the model did not see, makes scores of margins.

The fit uses at most about ``SAMPLE`` labelled rows and ``SAMPLE_BYTES`` bytes of text (documented bounds), chosen by
hash among rows outside the held-out fold, in one task; every whole text is scored.

Defined cases: null and empty texts have no n-grams and get the score of the bias; rows without or with a
null label are not used for the fit, rows with several labels are used once for each, exact repeats of a row are
used once; without two classes to learn from every score is the share of label 1 (0.5 without any); repeated rows get
equal scores; a very long text is gone through by pieces; an empty table gives an empty result; other columns are
ignored, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import is_held_out
from .textbytes import buffers, mixed, slices, word_spans

WIDTH = 1 << 18
SAMPLE, SAMPLE_BYTES = 8000, 1 << 26
THRESHOLD = 0.3


def ngrams(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """Sorted distinct n-gram columns of each text of a slice."""
    hashes, starts, ends, at = word_spans(data, offsets)
    own = data[offsets[0] : offsets[-1]]
    n = len(hashes)
    if not n:
        return [np.zeros(0, np.uint32)] * (len(at) - 1)
    first, last = own[starts], own[ends - 1]
    upper, second = (first >= 65) & (first <= 90), own[np.minimum(starts + 1, ends - 1)]
    case = upper * 1 + ((second >= 65) & (second <= 90)) * 2 + (first >= 97) * 4
    mark = np.where((last < 48) | ((last > 57) & (last < 65)) | ((last > 90) & (last < 97)) | ((last > 122) & (last < 128)), last, 0)
    before = np.arange(n) - np.repeat(at[:-1], np.diff(at))  # words before in the same text
    second_on, third_on = np.flatnonzero(before >= 1), np.flatnonzero(before >= 2)
    same = np.zeros(n, np.uint64)
    same[second_on] = hashes[second_on] == hashes[second_on - 1]
    length = np.minimum(np.log2(ends - starts + 1).astype(np.int64), 5)
    shape = mixed(((case.astype(np.uint64) * np.uint64(256) + mark.astype(np.uint64)) * np.uint64(8) + length.astype(np.uint64)) * np.uint64(2) + same)
    a, b = np.uint64(0xD6E8FEB86659FD93), np.uint64(0xA0761D6478BD642F)
    pair, s2, s3 = hashes.copy(), shape.copy(), shape.copy()
    pair[second_on] += hashes[second_on - 1] * a
    s2[second_on] += shape[second_on - 1] * a
    s3[third_on] += shape[third_on - 1] * a + shape[third_on - 2] * b
    cols = np.stack([(mixed(x + np.uint64(i)) % np.uint64(WIDTH)).astype(np.uint32) for i, x in enumerate((hashes, pair, shape, s2, s3))], axis=1)
    out = []
    for t in range(len(at) - 1):
        mine = np.sort(cols[at[t] : at[t + 1]].ravel())
        out.append(mine[np.append(True, mine[1:] != mine[:-1])] if len(mine) else mine)
    return out


@dataclass
class Model:
    weights: np.ndarray  # WIDTH float32: ratio times hinge-loss weight
    bias: float
    slope: float
    shift: float
    ratios: np.ndarray  # WIDTH float32, for the length of a vector

    def scores(self, rows: list[np.ndarray]) -> np.ndarray:
        margin = np.full(len(rows), self.bias)
        for i, cols in enumerate(rows):
            if len(cols):
                r = self.ratios[cols]
                margin[i] += self.weights[cols].sum(dtype=np.float64) / max(1e-9, float(np.sqrt((r * r).sum(dtype=np.float64))))
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -40, 40)))


def _ratios(rows: list[np.ndarray], y: np.ndarray, smooth: float = 1.0) -> np.ndarray:
    good = np.full(WIDTH, smooth)
    bad = np.full(WIDTH, smooth)
    for cols, label in zip(rows, y, strict=True):
        (good if label else bad)[cols] += 1
    return np.log((good / good.sum()) / (bad / bad.sum())).astype(np.float32)


def dual_coordinate_descent(rows: list[tuple[np.ndarray, np.ndarray]], y: np.ndarray, cost: np.ndarray, epochs: int, seed: int = 3) -> tuple[np.ndarray, float]:
    """Weights and bias of the L1-loss linear SVM: coordinate steps on the dual, box [0, cost]."""
    w, bias, alpha = np.zeros(WIDTH), 0.0, np.zeros(len(rows))
    sign = np.where(y > 0, 1.0, -1.0)
    norm = np.array([float(v @ v) + 1 for _, v in rows])
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(rows)):
            cols, v = rows[i]
            g = sign[i] * (w[cols] @ v + bias) - 1
            new = min(max(alpha[i] - g / norm[i], 0.0), cost[i])
            step = (new - alpha[i]) * sign[i]
            if step:
                worst = max(worst, abs(step))
                w[cols] += step * v
                bias += step
                alpha[i] = new
        if worst < 1e-3:
            break
    return w, bias


def fit(rows: list[np.ndarray], y: np.ndarray, fold: np.ndarray, cost: float = 1.0, epochs: int = 12) -> Model:
    """Fit on rows outside ``fold``, calibrate on those inside."""
    y = np.asarray(y).astype(int)
    share = float(y.mean()) if len(y) else 0.5
    train, held = np.flatnonzero(~fold), np.flatnonzero(fold)
    if len(set(y[train])) < 2:
        level = min(max(share, 1e-6), 1 - 1e-6)
        zero = np.zeros(WIDTH, np.float32)
        return Model(zero, 0.0, 0.0, float(np.log(level / (1 - level))), zero)
    ratios = _ratios([rows[i] for i in train], y[train])
    scaled = []
    for i in train:
        v = ratios[rows[i]].astype(np.float64)
        scaled.append((rows[i], v / max(1e-9, np.sqrt(v @ v))))
    weight = np.where(y[train] > 0, 0.5 / y[train].mean(), 0.5 / (1 - y[train].mean()))
    w, bias = dual_coordinate_descent(scaled, y[train], cost * weight, epochs)
    model = Model((w * ratios).astype(np.float32), float(bias), 1.0, 0.0, ratios)
    use = held if len(set(y[held])) == 2 else train
    p = model.scores([rows[i] for i in use])
    margin = np.log(np.clip(p, 1e-15, 1) / np.clip(1 - p, 1e-15, 1))
    a, b = 1.0, 0.0
    target = np.where(y[use] > 0, (y[use].sum() + 1) / (y[use].sum() + 2), 1 / ((1 - y[use]).sum() + 2))
    for _ in range(50):  # Newton steps of the sigmoid's logistic fit
        q = 1 / (1 + np.exp(-np.clip(a * margin + b, -40, 40)))
        d, h = q - target, np.maximum(q * (1 - q), 1e-9)
        g = np.array([d @ margin, d.sum()])
        hess = np.array([[(h * margin) @ margin + 1e-6, h @ margin], [h @ margin, h.sum() + 1e-6]])
        step = np.linalg.solve(hess, g)
        a, b = a - step[0], b - step[1]
        if np.abs(step).max() < 1e-6:
            break
    model.slope, model.shift = float(max(a, 0.0)), float(b)
    return model


def _columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        data, offsets = buffers(batch.column("text"))
        for a, b in slices(offsets):
            rows = ngrams(data, offsets[a : b + 1])
            flat = pa.array([r.view(np.int32) for r in rows], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("h")[a:b], batch.column("label")[a:b], flat], names=["h", "label", "cols"])


def _fit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One model of all rows (h, label, cols)."""
    parts = list(batches)
    if parts:
        rows = pa.Table.from_batches(parts).sort_by([("h", "ascending"), ("label", "ascending")])
        y, h = rows.column("label").to_numpy(), rows.column("h").to_numpy()
        cols = [np.asarray(c.values).view(np.uint32) for c in rows.column("cols")]
        model = fit(cols, y, mixed(h.view(np.uint64) + np.uint64(23)) % np.uint64(5) == 0)
        data = io.BytesIO()
        np.savez(data, model.weights, model.ratios, np.array([model.bias, model.slope, model.shift]))
        yield pa.RecordBatch.from_arrays([pa.array([data.getvalue()], pa.binary())], names=["model"])


def _share(most: int, count: int) -> float:
    return min(1.0, most / max(1, count))


def _drawn(key: Column, share: float) -> Column:
    return F.pmod(key, F.lit(1_000_000)) < int(share * 1_000_000)


def train(docs: DataFrame, labels: DataFrame, label: str = "quality", sample: int = SAMPLE, sample_bytes: int = SAMPLE_BYTES) -> Model:
    """Fit on a hash sample of labelled rows outside the held-out fold.

    Ids are drawn first, as their labels are broadcast; then rows by a hash of their texts, as rows of one id may be many.
    """
    known = labels.where(F.col(label).isNotNull() & F.col("doc_id").isNotNull() & ~is_held_out(F.col("doc_id")))
    known = known.select("doc_id", F.col(label).cast("int").alias("label")).distinct()
    ids = known.where(_drawn(F.xxhash64("doc_id", F.lit(11)), _share(sample, known.count())))
    texts = docs.select("doc_id", "text", F.xxhash64("doc_id", "text").alias("h")).join(F.broadcast(ids), "doc_id")  # about ``sample`` ids
    size = texts.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.octet_length("text")), F.lit(0))).first()
    rows = texts.where(_drawn(F.xxhash64("h"), min(_share(sample, size[0]), _share(sample_bytes, size[1]))))
    rows = rows.select("h", "label", "text").dropDuplicates(["h", "label"])
    # The bounded sample is fitted in one task, where numpy has one thread: many would slow such small products.
    fitted = rows.mapInArrow(_columns, "h long, label int, cols array<int>").repartition(1).mapInArrow(_fit, "model binary").first()
    if fitted is None:
        return fit([], np.zeros(0, int), np.zeros(0, bool))
    weights, ratios, (bias, slope, shift) = np.load(io.BytesIO(fitted["model"])).values()
    return Model(weights, float(bias), float(slope), float(shift), ratios)


def _scorer(model: Model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                score = model.scores(ngrams(data, offsets[a : b + 1]))
                yield pa.RecordBatch.from_arrays([batch.column("doc_id")[a:b], pa.array(score)], names=["doc_id", "score"])

    return run


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """Per document: doc_id, held_out, score, predicted."""
    out = docs.select("doc_id", "text").mapInArrow(_scorer(model), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, score double")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))
