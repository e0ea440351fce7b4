"""Language identification by a byte convolutional network.

Bytes are embedded; filters of several widths run over fixed-length windows that cover the whole text
(neighbours overlap by the widest filter less one); each filter's maximum over a window feeds a
softmax. The network is trained in numpy on a hash sample of labelled excerpts and applied to batches
of windows; a text's prediction is the mean of its windows' probabilities, weighted by their bytes.

The fit uses at most about ``PER_LANG`` texts of each language and ``WINDOWS`` windows of each (documented
bounds); every whole text is classified.

Defined cases: a text that is null or has no letter is ``und`` with score 0; rows with null lang are not
learned from, and exact repeats of a row are learned from once; with nothing to learn from, every row is ``und``;
repeated rows get equal results; a very long text is learned from by an excerpt and classified by all its windows; an
empty table gives an empty result; other columns are ignored, whatever their names.
"""

from __future__ import annotations

import io
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import is_held_out
from .textbytes import buffers, slices

LENGTH, WIDTHS, FILTERS, DIM = 256, (2, 3, 4), 12, 6
PER_LANG, WINDOWS, EXCERPT = 400, 6, 4096
UNDETERMINED = "und"
_WIDE = max(WIDTHS)
_STRIDE = LENGTH - _WIDE + 1
#: Windows that go through the network at once, so that arrays stay in cache.
_BATCH = 32


@dataclass
class Network:
    langs: list[str]
    embed: np.ndarray  # 256 x DIM
    kernel: np.ndarray  # _WIDE * DIM x filters; rows beyond a filter's width are 0
    bias: np.ndarray
    out: np.ndarray  # filters x langs
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Unrolled inputs, activations before pooling and their maxima for windows x LENGTH bytes."""
        x = self.embed[windows]
        n, steps = len(windows), LENGTH - _WIDE + 1
        unrolled = np.empty((n, steps, _WIDE * DIM), np.float32)
        for k in range(_WIDE):
            unrolled[:, :, k * DIM : (k + 1) * DIM] = x[:, k : k + steps]
        act = (unrolled.reshape(-1, _WIDE * DIM) @ self.kernel).reshape(n, steps, -1)
        return unrolled, act, act.max(axis=1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        out = np.empty((len(windows), len(self.langs)), np.float32)
        for a in range(0, len(windows), _BATCH):
            top = self.pooled(windows[a : a + _BATCH])[2]
            out[a : a + _BATCH] = softmax(np.maximum(top + self.bias, 0) @ self.out + self.out_bias)
        return out


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def windows_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows (bytes, padded with 0) that cover each text; each text's first window (n + 1) and each
    window's number of bytes that are its own. An empty text has one empty window."""
    sizes = np.diff(offsets)
    count = np.maximum(1, -(-(sizes - (_WIDE - 1)) // _STRIDE))
    first = np.concatenate([[0], np.cumsum(count)])
    text = np.repeat(np.arange(len(sizes)), count)
    begin = (np.arange(first[-1]) - first[text]) * _STRIDE
    left = sizes[text] - begin
    at = (offsets[text] + begin)[:, None] + np.arange(LENGTH)
    inside = np.arange(LENGTH) < left[:, None]
    out = np.where(inside, data[np.minimum(at, max(0, len(data) - 1))] if len(data) else 0, 0).astype(np.uint8)
    return out, first, np.minimum(left, _STRIDE)


def has_letter(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    low = data[offsets[0] : offsets[-1]] | 32
    sums = np.concatenate([[0], np.cumsum((low >= 97) & (low <= 122), dtype=np.int64)])
    at = offsets - offsets[0]
    out = sums[at[1:]] > sums[at[:-1]]
    for i in np.flatnonzero(~out):
        out[i] = any(c.isalpha() for c in data[offsets[i] : offsets[i + 1]].tobytes().decode("utf-8", "replace"))
    return out


def fit(windows: np.ndarray, lang: np.ndarray, langs: list[str], epochs: int = 5, rate: float = 0.01, seed: int = 7) -> Network:
    """Train by Adam on windows (n x LENGTH bytes) and their language numbers."""
    rng = np.random.default_rng(seed)
    filters = FILTERS * len(WIDTHS)
    mask = np.zeros((_WIDE * DIM, filters), np.float32)
    for i, w in enumerate(WIDTHS):
        mask[: w * DIM, i * FILTERS : (i + 1) * FILTERS] = 1
    net = Network(
        langs,
        rng.normal(0, 0.5, (256, DIM)).astype(np.float32),
        (rng.normal(0, 0.4, mask.shape) * mask).astype(np.float32),
        np.zeros(filters, np.float32),
        rng.normal(0, 0.2, (filters, len(langs))).astype(np.float32),
        np.zeros(len(langs), np.float32),
    )
    weights = [net.embed, net.kernel, net.bias, net.out, net.out_bias]
    mean, square = [np.zeros_like(w) for w in weights], [np.zeros_like(w) for w in weights]
    step, size = 0, 64
    for epoch in range(epochs):
        order = rng.permutation(len(windows))
        for a in range(0, len(order), size):
            pick = order[a : a + size]
            x, y = windows[pick], lang[pick]
            unrolled, act, top = net.pooled(x)
            hidden = np.maximum(top + net.bias, 0)
            d = softmax(hidden @ net.out + net.out_bias)
            d[np.arange(len(y)), y] -= 1
            d /= len(y)
            d_hidden = (d @ net.out.T) * (hidden > 0)
            where = act.argmax(axis=1)  # windows x filters
            seen = unrolled[np.arange(len(x))[:, None], where]  # windows x filters x inputs
            d_kernel = np.einsum("nf,nfi->if", d_hidden, seen) * mask
            d_input = d_hidden[:, :, None] * net.kernel.T[None]  # windows x filters x inputs
            d_embed = np.zeros_like(net.embed)
            bytes_at = x[np.arange(len(x))[:, None, None], where[:, :, None] + np.arange(_WIDE)]
            np.add.at(d_embed, bytes_at.ravel(), d_input.reshape(-1, DIM))
            step += 1
            for w, g, m, s in zip(weights, (d_embed, d_kernel, d_hidden.sum(0), hidden.T @ d, d.sum(0)), mean, square, strict=True):
                m += 0.1 * (g - m)
                s += 0.001 * (g * g - s)
                w -= rate * (0.5**epoch if epoch > 1 else 1) * (m / (1 - 0.9**step)) / (np.sqrt(s / (1 - 0.999**step)) + 1e-8)
    return net


def train(docs: DataFrame, per_lang: int = PER_LANG) -> Network | None:
    """Fit on a hash sample of rows outside the held-out fold."""
    known = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~is_held_out(F.col("doc_id"))).select("doc_id", "lang", "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}  # one row per language
    if not counts:
        return None
    langs = sorted(counts)
    share = F.lit(0.0)
    for x in langs:
        share = F.when(F.col("lang") == x, min(1.0, per_lang / counts[x])).otherwise(share)
    # By a hash of the text too, as rows of one id (or of none) may be many; what still repeats is one row.
    drawn = F.pmod(F.xxhash64("doc_id", "text", F.lit(31)), F.lit(1_000_000)) < share * 1_000_000
    begin = 1 + F.pmod(F.xxhash64("doc_id", "text"), F.greatest(F.lit(1), F.length("text") - EXCERPT + 1))
    rows = known.where(drawn).select("doc_id", "lang", F.substring("text", begin.cast("int"), F.lit(EXCERPT)).alias("text")).distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = list(batches)
        if parts:
            data = io.BytesIO()
            net = _fit_texts(pa.Table.from_batches(parts).sort_by([("doc_id", "ascending"), ("lang", "ascending"), ("text", "ascending")]), langs)
            np.savez(data, net.embed, net.kernel, net.bias, net.out, net.out_bias)
            yield pa.RecordBatch.from_arrays([pa.array([data.getvalue()], pa.binary())], names=["net"])

    # The bounded sample is fitted in one task, where numpy has one thread: many would slow such small products.
    fitted = rows.repartition(1).mapInArrow(run, "net binary").first()
    if fitted is None:
        return None
    return Network(langs, *np.load(io.BytesIO(fitted["net"])).values())


def _fit_texts(rows: pa.Table, langs: list[str]) -> Network:
    data, offsets = buffers(rows.column("text"))
    number = {x: i for i, x in enumerate(langs)}
    own = np.array([number[x] for x in rows.column("lang").to_pylist()], np.int64)
    windows, first, _ = windows_of(data, offsets)
    keep = [w for i in range(len(own)) for w in np.linspace(first[i], first[i + 1] - 1, min(WINDOWS, first[i + 1] - first[i])).astype(int)]
    text = np.searchsorted(first, keep, "right") - 1
    return fit(windows[keep], own[text], langs)


def predict(net: Network, data: np.ndarray, offsets: np.ndarray) -> tuple[list[str], np.ndarray]:
    windows, first, used = windows_of(data, offsets)
    p = net.probabilities(windows) * np.maximum(used, 1)[:, None]
    p = np.add.reduceat(p, first[:-1], axis=0)
    p /= p.sum(axis=1, keepdims=True)
    letter = has_letter(data, offsets)
    best = p.argmax(axis=1)
    return [net.langs[b] if ok else UNDETERMINED for b, ok in zip(best, letter, strict=True)], np.where(letter, p[np.arange(len(p)), best], 0).astype(np.float64)


def _classifier(net: Network | None):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            others = [batch.column(i) for i, name in enumerate(batch.schema.names) if name != "text"]
            names = [name for name in batch.schema.names if name != "text"]
            for a, b in slices(offsets):
                lang, score = predict(net, data, offsets[a : b + 1]) if net else ([UNDETERMINED] * (b - a), np.zeros(b - a))
                yield pa.RecordBatch.from_arrays([*[c[a:b] for c in others], pa.array(lang, pa.string()), pa.array(score)], names=[*names, "lang_pred", "score"])

    return run


def identify(docs: DataFrame, net: Network | None) -> DataFrame:
    """Per document: doc_id, held_out, lang_pred, score."""
    out = docs.select("doc_id", "text").mapInArrow(_classifier(net), f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, lang_pred string, score double")
    return out.select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, net: Network | None, least: float = 0.3) -> DataFrame:
    """Rows of ``docs`` whose language is known with a score of ``least`` or more, all columns kept."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = buffers(batch.column("text"))
            for a, b in slices(offsets):
                lang, score = predict(net, data, offsets[a : b + 1]) if net else ([UNDETERMINED] * (b - a), np.zeros(b - a))
                yield batch.slice(a, b - a).filter(pa.array([x != UNDETERMINED and s >= least for x, s in zip(lang, score, strict=True)], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
