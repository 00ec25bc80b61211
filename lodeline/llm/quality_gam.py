"""Quality classifier: a generalised additive model with pairwise interactions.

Features of a text come from byte and word statistics of the whole text. Each is cut into bins at quantiles; shallow trees over the bins are
boosted in turn, one feature after the other, and summed into one lookup table for each feature. The pairs whose residuals a four-leaf tree
explains best get tables over coarse bins, boosted in the same way. A score is the logistic of the sum of table entries.

The model is fitted on a sample of `sample` labelled rows at most in expectation, chosen by a hash; scoring reads every whole text once
and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import held_out, text_runs
from .words import grams, split_words

SAMPLE, BINS, ROUNDS, RATE = 8000, 32, 60, 0.15
PAIRS, COARSE, PAIR_ROUNDS = 6, 8, 20

_CLASSES = {
    "upper": range(0x41, 0x5B),
    "lower": range(0x61, 0x7B),
    "digit": b"0123456789",
    "space": b" \t",
    "line": b"\n\r",
    "stop": b".,;:",
    "call": b"!?",
    "quote": b"'\"`",
    "bracket": b"()[]{}<>",
    "symbol": b"#$%&*@^~+=\\/_-",
    "bar": b"|",
    "high": range(0x80, 0x100),
}
FEATURES = [*_CLASSES, "words", "bytes", "word_bytes", "long_words", "one_byte_words", "distinct_words", "distinct_pairs", "again_next", "words_a_line", "capital_words", "stop_words"]


def features(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """One row of FEATURES for each text."""
    n = len(offsets) - 1
    size = np.diff(offsets).astype(np.float64)
    text = np.repeat(np.arange(n), np.diff(offsets))
    kind = np.zeros(256, np.int64)
    for i, members in enumerate(_CLASSES.values(), 1):
        kind[list(members)] = i
    width = len(_CLASSES) + 1
    classes = np.bincount(text * width + kind[data], minlength=n * width).reshape(n, width)[:, 1:]
    w = split_words(data, offsets)
    of, count = w.text, w.counts.astype(np.float64)
    length = (w.end - w.start).astype(np.float64)
    total = lambda mask: np.bincount(of[mask], minlength=n)

    def distinct(value: np.ndarray, owner: np.ndarray) -> np.ndarray:
        order = np.lexsort((value, owner))
        v, o = value[order], owner[order]
        new = np.ones(len(v), bool)
        new[1:] = (v[1:] != v[:-1]) | (o[1:] != o[:-1])
        return np.bincount(o[new], minlength=n)

    pair = grams(w.hash, 2)
    same = of[:-1] == of[1:] if len(of) > 1 else np.zeros(0, bool)
    again = np.zeros(len(of), bool)
    if len(of) > 1:
        again[1:] = (w.hash[1:] == w.hash[:-1]) & same
    first, last = (data[w.start], data[w.end - 1]) if len(of) else (data[:0], data[:0])
    words = np.maximum(count, 1)
    columns = [
        *(classes / np.maximum(size, 1)[:, None]).T,
        np.log1p(count),
        np.log1p(size),
        np.bincount(of, length, n) / words,
        total(length >= 16) / words,
        total(length == 1) / words,
        distinct(w.hash, of) / words,
        distinct(pair[same], of[1:][same]) / np.maximum(count - 1, 1),
        total(again) / words,
        count / (1 + classes[:, list(_CLASSES).index("line")]),
        total((first >= 0x41) & (first <= 0x5A)) / words,
        total(np.isin(last, np.frombuffer(b".,;:!?", np.uint8))) / words,
    ]
    return np.array(columns).T


def _leaves(gradient: np.ndarray, weight: np.ndarray, depth: int) -> np.ndarray:
    """Values of a tree of the given depth over ordered bins, fitted to sums of gradients and weights."""
    value = lambda g, h: g * g / (h + 1.0)
    out = np.full(len(gradient), gradient.sum() / (weight.sum() + 1.0))
    if depth and len(gradient) > 1:
        g, h = np.cumsum(gradient)[:-1], np.cumsum(weight)[:-1]
        whole_g, whole_h = gradient.sum(), weight.sum()
        gain = value(g, h) + value(whole_g - g, whole_h - h) - value(whole_g, whole_h)
        cut = int(gain.argmax()) + 1
        if gain[cut - 1] > 1e-9:
            out[:cut] = _leaves(gradient[:cut], weight[:cut], depth - 1)
            out[cut:] = _leaves(gradient[cut:], weight[cut:], depth - 1)
    return out


def _quadrants(gradient: np.ndarray, weight: np.ndarray) -> tuple[float, np.ndarray]:
    """Gain and values of the best cut of a table into four parts."""
    g, h = gradient.cumsum(0).cumsum(1), weight.cumsum(0).cumsum(1)
    parts = lambda t: np.array([t[:-1, :-1], t[:-1, -1:] - t[:-1, :-1], t[-1:, :-1] - t[:-1, :-1], t[-1, -1] - t[:-1, -1:] - t[-1:, :-1] + t[:-1, :-1]])
    pg, ph = parts(g), np.maximum(parts(h), 0)
    gain = (pg**2 / (ph + 1.0)).sum(0) - g[-1, -1] ** 2 / (h[-1, -1] + 1.0)
    i, j = np.unravel_index(gain.argmax(), gain.shape)
    leaf = pg[:, i, j] / (ph[:, i, j] + 1.0)
    out = np.empty_like(gradient)
    out[: i + 1, : j + 1], out[: i + 1, j + 1 :], out[i + 1 :, : j + 1], out[i + 1 :, j + 1 :] = leaf
    return float(gain[i, j]), out


@dataclass
class Model:
    edges: list[np.ndarray]
    tables: list[np.ndarray]
    coarse: list[np.ndarray]
    pairs: list[tuple[int, int, np.ndarray]]
    intercept: float

    def score(self, x: np.ndarray) -> np.ndarray:
        logit = np.full(len(x), self.intercept)
        for f, (edge, table) in enumerate(zip(self.edges, self.tables, strict=True)):
            logit += table[np.searchsorted(edge, x[:, f], "right")]
        for a, b, table in self.pairs:
            logit += table[np.searchsorted(self.coarse[a], x[:, a], "right"), np.searchsorted(self.coarse[b], x[:, b], "right")]
        return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def fit(x: np.ndarray, y: np.ndarray) -> Model:
    """Boost tables for the features and then for the best pairs of them; y is 0 or 1."""
    cuts = lambda column, bins: np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1]))
    edges = [cuts(x[:, f], BINS) for f in range(x.shape[1])]
    coarse = [cuts(x[:, f], COARSE) for f in range(x.shape[1])]
    at = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(edges)]
    rough = [np.searchsorted(e, x[:, f], "right") for f, e in enumerate(coarse)]
    tables = [np.zeros(len(e) + 1) for e in edges]
    rate = np.clip(y.mean(), 1e-3, 1 - 1e-3)
    intercept = float(np.log(rate / (1 - rate)))
    logit = np.full(len(y), intercept)
    residual = lambda: (lambda p: (y - p, p * (1 - p)))(1 / (1 + np.exp(-logit)))
    for _ in range(ROUNDS):
        for f, table in enumerate(tables):
            g, h = residual()
            step = RATE * _leaves(np.bincount(at[f], g, len(table)), np.bincount(at[f], h, len(table)), 2)
            table += step
            logit += step[at[f]]

    def sums(a: int, b: int, values: np.ndarray) -> np.ndarray:
        shape = len(coarse[a]) + 1, len(coarse[b]) + 1
        return np.bincount(rough[a] * shape[1] + rough[b], values, shape[0] * shape[1]).reshape(shape)

    g, h = residual()
    able = [f for f in range(x.shape[1]) if len(coarse[f])]
    gains = sorted(((_quadrants(sums(a, b, g), sums(a, b, h))[0], a, b) for i, a in enumerate(able) for b in able[i + 1 :]), reverse=True)[:PAIRS]
    pairs = [(a, b, np.zeros((len(coarse[a]) + 1, len(coarse[b]) + 1))) for _, a, b in gains]
    for _ in range(PAIR_ROUNDS):
        for a, b, table in pairs:
            g, h = residual()
            step = RATE * _quadrants(sums(a, b, g), sums(a, b, h))[1]
            table += step
            logit += step[rough[a], rough[b]]
    return Model(edges, tables, coarse, pairs, intercept)


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "quality", sample: int = SAMPLE) -> Model | None:
    """A model of labels whose rows are not held out; None without any. Of labels that repeat an id the mean counts, at least a half being 1;
    of texts that share an id the one with the least hash."""
    known = labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull() & ~held_out(id_col)).groupBy(id_col).agg((F.avg(label_col) >= 0.5).cast("int").alias("y")).withColumnRenamed(id_col, "id")
    n = known.count()
    chosen = known.where(F.pmod(F.xxhash64(F.col("id"), F.lit("sample")), F.lit(1_000_000)) < F.lit(min(1.0, sample / max(n, 1)) * 1_000_000))

    def describe(batches):
        for batch in batches:
            for first, m, data, offsets in text_runs(batch.column("text")):
                found = features(data, offsets)
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(first, m) for c in ("id", "y", "h")), pa.array([r.tobytes() for r in found], pa.binary())], names=["id", "y", "h", "x"])

    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"), F.xxhash64(text_col).alias("h"))
    found = texts.join(F.broadcast(chosen), "id").select("id", "y", "h", "text").mapInArrow(describe, "id long, y int, h long, x binary")
    got = found.groupBy("id").agg(F.min(F.struct("h", "y", "x")).alias("r")).select("id", "r.y", "r.x").collect()
    if not got:
        return None
    got.sort(key=lambda r: r[0])
    return fit(np.array([np.frombuffer(r[2]) for r in got]), np.array([float(r[1]) for r in got]))


def score(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text", threshold: float = 0.3) -> DataFrame:
    """id, score (0 to 1) and predicted (1 if score >= threshold). A null text counts as empty; without a model every score is 0.5.

    Null ids and repeated rows are kept; other columns are not read.
    """

    def run(batches):
        for batch in batches:
            out = [np.zeros(0)]
            for _, m, data, offsets in text_runs(batch.column("text")):
                out.append(model.score(features(data, offsets)) if model else np.full(m, 0.5))
            found = np.concatenate(out)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(found), pa.array((found >= threshold).astype(np.int32))], names=[id_col, "score", "predicted"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(run, f"`{id_col}` long, score double, predicted int")
