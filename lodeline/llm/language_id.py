"""Language identification by error-correcting output codes.

Every learned language has a codeword of +1 and -1; each bit is predicted by a linear classifier over hashed byte bigrams and trigrams of
the lower-cased text. A text's bits are decoded to the codeword of the least weighted loss: a bit's hinge loss, weighted by how far its
classifier beat chance in training. If the runner-up's loss is close, the text is flagged as ambiguous.

The classifiers are fitted on a sample of labelled texts, `sample` of all languages together at most in expectation, chosen by a hash;
prediction reads every whole text once and shuffles nothing.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, held_out, text_runs

SAMPLE, BUCKETS, UNDETERMINED = 2000, 1 << 13, "und"
_SHRINK = 5.0
_RUN = 1 << 19, 128  # bytes and texts that are counted together: a text's counts take 8 bytes for each bucket


def histograms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Counts of hashed bigrams and trigrams (texts x BUCKETS), and how many there are in each text."""
    n = len(offsets) - 1
    length = np.diff(offsets)
    text = np.repeat(np.arange(n), length)
    left = np.repeat(offsets[1:], length) - np.arange(len(data))  # bytes of the text from here
    b = data.astype(np.uint32)
    slots = []
    for k in (2, 3):
        at = np.flatnonzero(left >= k)
        h = np.full(len(at), k, np.uint32)
        for j in range(k):
            h = (h ^ b[at + j]) * np.uint32(0x01000193)
        h = (h * np.uint32(0x9E3779B1)) >> np.uint32(32 - 13)
        slots.append(text[at] * BUCKETS + h.astype(np.int64))
    counts = np.bincount(np.concatenate(slots), minlength=n * BUCKETS).reshape(n, BUCKETS)
    return counts, counts.sum(1)


def codewords(n: int) -> np.ndarray:
    """n codewords of +1 and -1: all splits of the languages in two for up to 5 of them, else the farthest apart of seeded random ones."""
    if n < 2:
        return np.ones((n, 1), np.int8)
    if n <= 5:
        return np.array([[1 if (bit >> i) & 1 else -1 for bit in range(1, 2**n, 2)][:-1] for i in range(n)], np.int8)
    rng, bits = np.random.default_rng(7), int(np.ceil(10 * np.log2(n)))
    best, apart = None, -1
    for _ in range(100):
        code = rng.choice(np.array([-1, 1], np.int8), (n, bits))
        code = code[:, np.abs(code.sum(0, dtype=np.int64)) < n]  # a bit must part the languages
        distance = (code.shape[1] - code.astype(np.int64) @ code.T.astype(np.int64)) // 2
        least = int((distance + np.eye(n, dtype=np.int64) * bits).min())
        if least > apart:
            best, apart = code, least
    return best


@dataclass
class Model:
    languages: list[str]
    code: np.ndarray  # languages x bits
    weight: np.ndarray  # of a bit's loss
    table: np.ndarray  # BUCKETS x bits
    bias: np.ndarray
    margin: float = 0.1

    def decode(self, counts: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Index of the language, score, and whether it is ambiguous, for each text."""
        bits = counts.astype(np.float32) @ self.table / (total + _SHRINK)[:, None] + self.bias
        loss = np.maximum(0, 1 - bits[:, None, :] * self.code[None]) @ self.weight
        best = loss.argmin(1)
        likely = np.exp(-8 * (loss - loss.min(1, keepdims=True)))
        second = np.partition(loss, 1, 1)[:, 1] if len(self.languages) > 1 else np.full(len(loss), np.inf)
        return best, 1 / likely.sum(1), second - loss.min(1) < self.margin


def fit(languages: list[str], counts: np.ndarray, total: np.ndarray, label: np.ndarray) -> Model:
    """Ridge regression of every bit on scaled frequencies, in the dual (texts x texts). counts is used up."""
    z = counts
    z /= (total + _SHRINK)[:, None].astype(np.float32)
    mean = z.mean(0)
    scale = z.std(0) + 1e-4
    z -= mean
    z /= scale
    code = codewords(len(languages))
    y = code[label].astype(np.float64)
    share = np.bincount(label, minlength=len(languages))[label]
    root = np.sqrt(len(label) / (len(languages) * share))  # languages weigh the same
    kernel = (z @ z.T).astype(np.float64) / z.shape[1]
    alpha = np.linalg.solve(kernel * root[:, None] * root[None] + 0.05 * np.eye(len(z)), y * root[:, None]) * root[:, None]
    table = (z.T @ alpha.astype(np.float32)) / z.shape[1] / scale[:, None]
    bias = -(mean @ table)
    right = (np.sign(kernel @ alpha) == y).mean(0)
    weight = np.maximum(2 * right - 1, 0.01)
    return Model(languages, code, weight / weight.sum(), table.astype(np.float32), bias.astype(np.float32))


def learn(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", sample: int = SAMPLE, training: Column | None = None) -> Model | None:
    """A model of the languages in lang_col, from rows where `training` holds (by default those not held out); None without such rows.

    It learns from about `sample` of these rows, chosen by a hash, an equal share for each language; or from about 20 of each language where that is more.
    """
    rows = docs.where(F.col(lang_col).isNotNull() & F.col(text_col).isNotNull() & (~held_out(id_col) if training is None else training))
    counts = {lang: n for lang, n in rows.groupBy(lang_col).count().collect()}
    if not counts:
        return None
    languages = sorted(counts, key=lambda x: x.encode())
    each = max(20, sample // len(languages))
    fraction = F.create_map(*(F.lit(x) for lang in languages for x in (lang, min(1.0, each / counts[lang]))))
    h = F.xxhash64(id_col, text_col, F.lit("sample"))
    chosen = rows.where(F.pmod(h, F.lit(1_000_000)) < fraction[F.col(lang_col)] * 1_000_000)
    chosen = chosen.select(F.col(lang_col).alias("lang"), F.lower(text_col).alias("text"), h.alias("h")).dropDuplicates(["h"])

    def sparse(batches):
        for batch in batches:
            for first, n, data, offsets in text_runs(batch.column("text"), *_RUN):
                found, total = histograms(data, offsets)
                at = [np.flatnonzero(row) for row in found]
                pack = [np.concatenate([i, row[i]]).astype("<u4").tobytes() for i, row in zip(at, found, strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column("lang").slice(first, n), pa.array(pack, pa.binary())], names=["lang", "grams"])

    got = chosen.select("lang", "text").mapInArrow(sparse, "lang string, grams binary").collect()
    got.sort(key=lambda r: (r[0].encode(), bytes(r[1])))
    label = np.array([languages.index(r[0]) for r in got])
    x = np.zeros((len(got), BUCKETS), np.float32)
    for i in range(len(got)):
        at, number = np.frombuffer(got[i][1], "<u4").reshape(2, -1)
        x[i, at] = number
        got[i] = None
    return fit(languages, x, x.sum(1), label) if got else None


def predict(docs: DataFrame, model: Model | None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs with lang_pred, score (0 to 1) and ambiguous. A text that is null or has no letter, or any text without a model: und, 0, true.

    Null ids, repeated rows and other columns are passed through; columns named lang_pred, score or ambiguous are replaced.
    """
    docs = docs.drop("lang_pred", "score", "ambiguous")
    if model is None:
        return docs.select("*", F.lit(UNDETERMINED).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(True).alias("ambiguous"))
    names = pa.array(model.languages, pa.string())

    def decode(batches):
        for batch in batches:
            out = []
            for _, _, data, offsets in text_runs(batch.column(lower), *_RUN):
                out.append(model.decode(*histograms(data, offsets)))
            best, score, unsure = (np.concatenate(x) for x in zip(*out, strict=True)) if out else (np.zeros(0, np.int64), np.zeros(0), np.zeros(0, bool))
            sound = batch.column(lettered).to_numpy(zero_copy_only=False).astype(bool)
            lang = pa.array(np.where(sound, best, -1), mask=~sound)
            columns = [batch.column(c) for c in kept]
            columns += [names.take(lang).fill_null(UNDETERMINED), pa.array(np.where(sound, score, 0.0)), pa.array(unsure | ~sound)]
            yield pa.RecordBatch.from_arrays(columns, names=[*kept, "lang_pred", "score", "ambiguous"])

    kept, lower, lettered = docs.columns, free_name(docs, "lower"), free_name(docs, "lettered")
    has_letter = F.coalesce(F.col(text_col).rlike(r"\p{L}"), F.lit(False))
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("ambiguous", T.BooleanType())])
    return docs.select("*", F.coalesce(F.lower(text_col), F.lit("")).alias(lower), has_letter.alias(lettered)).mapInArrow(decode, schema)
