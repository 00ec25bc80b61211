"""Product-quantised codes of vectors, trained by nearest-entry rounds with a kd-tree for each codebook.

Components become integers and vectors are cut into equal parts; each part position has a codebook of up to `entries` integer points. A round
sends the codebooks to all tasks as kd-trees, finds the nearest entry of every part, and replaces each entry by the floor of the mean of its parts. A
task adds its parts up before anything is shuffled, so a round moves a few integers for each entry and task, and the sums are exact.

The trees are searched branch and bound, for many parts at once: a node is entered while its box is no farther than the best entry so far. Nodes
at an equal distance are entered too, and of entries at equal distances the one with the lower index stays.

Scale: vectors are read once, kept as integers, and never shuffled; what the driver holds are codebooks, of a size that is set by parameters. The error of a
label is a sum before the shuffle, and meets its rows in a join whose hot labels adaptive execution splits.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, ragged

PARTS, ENTRIES, ROUNDS, LEAF = 16, 64, 2, 4
SCALE, MOST = 256, 1 << 24  # components as integers are at most MOST from 0, so that squared distances fit into 64 bits


@dataclass
class _Node:
    low: np.ndarray
    high: np.ndarray
    entries: np.ndarray | None = None  # of a leaf, in rising order
    left: _Node | None = None
    right: _Node | None = None


class KdTree:
    """Nearest entry of each of many points, all of 64-bit integers, by squared Euclidean distance and then index."""

    def __init__(self, entries: np.ndarray, leaf: int = LEAF):
        self.entries, self.leaf = np.asarray(entries, np.int64), leaf
        self.root = self._node(np.arange(len(entries)))

    def _node(self, own: np.ndarray) -> _Node:
        points = self.entries[own]
        node = _Node(points.min(0), points.max(0))
        widest = int((node.high - node.low).argmax())
        if len(own) <= self.leaf or node.low[widest] == node.high[widest]:
            node.entries = np.sort(own)
            return node
        order = np.argsort(points[:, widest], kind="stable")
        half = len(own) // 2
        node.left, node.right = self._node(own[order[:half]]), self._node(own[order[half:]])
        return node

    def nearest(self, points: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index and squared distance of the nearest entry of each point."""
        points = np.asarray(points, np.int64)
        best, index = np.full(len(points), np.iinfo(np.int64).max), np.full(len(points), len(self.entries))
        self._visit(self.root, np.arange(len(points)), np.zeros(len(points), np.int64), points, best, index)
        return index, best

    def _visit(self, node: _Node, who: np.ndarray, bound: np.ndarray, points: np.ndarray, best: np.ndarray, index: np.ndarray) -> None:
        """Points `who`, whose distance from the node's box is `bound`, that may have their nearest entry there."""
        who = who[bound <= best[who]]
        if not len(who):
            return
        if node.entries is not None:
            for e in node.entries.tolist():
                distance = ((points[who] - self.entries[e]) ** 2).sum(1)
                better = (distance < best[who]) | ((distance == best[who]) & (e < index[who]))
                best[who[better]], index[who[better]] = distance[better], e
            return
        left, right = self._bound(node.left, points[who]), self._bound(node.right, points[who])
        first = left <= right
        for near, far, which, to_near, to_far in ((node.left, node.right, first, left, right), (node.right, node.left, ~first, right, left)):
            self._visit(near, who[which], to_near[which], points, best, index)
            self._visit(far, who[which], to_far[which], points, best, index)

    @staticmethod
    def _bound(node: _Node, points: np.ndarray) -> np.ndarray:
        apart = np.maximum(node.low - points, 0) + np.maximum(points - node.high, 0)
        return (apart**2).sum(1)


def _integers(batch: pa.RecordBatch, column: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Rows whose vector is whole and finite; the components of these rows as integers; and their lengths. A null vector has no length."""
    vectors = batch.column(column)
    flat, row = ragged(vectors)
    x = flat.cast(pa.float64()).to_numpy(zero_copy_only=False)
    bad = np.zeros(batch.num_rows, bool)
    bad[row[~np.isfinite(x)]] = True  # a null component is NaN here
    length = np.bincount(row, minlength=batch.num_rows)
    good = np.flatnonzero(~bad & vectors.is_valid().to_numpy(zero_copy_only=False))
    whole = np.floor(SCALE * x[~bad[row]])
    if len(whole) and np.abs(whole).max() > MOST:
        raise ValueError(f"a component is beyond {MOST // SCALE}")
    return good, whole.astype(np.int64), length[good]


def integer_vectors(vectors: DataFrame, vector_col: str = "embedding") -> DataFrame:
    """vectors with one more column, __v: the components as floor(256 * x). Rows with a vector that is null, empty, or holds null or non-finite components are left out."""

    def convert(batches):
        for batch in batches:
            rows, values, length = _integers(batch, vector_col)
            rows, length = rows[length > 0], length[length > 0]
            edges = np.concatenate([[0], np.cumsum(length)]).astype(np.int32)
            taken = batch.take(pa.array(rows))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.ListArray.from_arrays(pa.array(edges), pa.array(values.astype(np.int32)))], names=[*batch.schema.names, "__v"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.schema.fields)
    return vectors.mapInArrow(convert, f"{fields}, __v array<int>")


def _parts(batch: pa.RecordBatch, column: str, parts: int) -> np.ndarray:
    """Vectors of one length as an array of rows, parts and components."""
    flat, _ = ragged(batch.column(column))
    return flat.to_numpy(zero_copy_only=False).astype(np.int64).reshape(batch.num_rows, parts, -1)


def train(kept: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "__v") -> np.ndarray:
    """Codebooks, an array of parts, entries and components. kept: a kept table of integer vectors of one length.

    They begin as the parts of the vectors with the smallest ids (rows without an id come last, equal ids by their vectors).
    """
    spark = kept.sparkSession
    first = kept.orderBy(F.col(id_col).asc_nulls_last(), vector_col).select(vector_col).limit(entries).collect()
    if not first:
        return np.zeros((parts, 0, 0), np.int64)
    books = np.array([r[0] for r in first], np.int64).reshape(len(first), parts, -1).transpose(1, 0, 2)
    for _ in range(rounds):
        sent = spark.sparkContext.broadcast([KdTree(b) for b in books])

        def add(batches, sent=sent, shape=books.shape):
            many, sums = np.zeros(shape[:2], np.int64), np.zeros(shape, np.int64)
            for batch in batches:
                points = _parts(batch, vector_col, parts)
                for p, tree in enumerate(sent.value):
                    index, _ = tree.nearest(points[:, p])
                    np.add.at(many[p], index, 1)
                    np.add.at(sums[p], index, points[:, p])
            p, e = np.nonzero(many)
            yield pa.RecordBatch.from_arrays([pa.array(p.astype(np.int32)), pa.array(e.astype(np.int32)), pa.array(many[p, e]), pa.array(sums[p, e].tolist(), pa.list_(pa.int64()))], names=["part", "entry", "n", "sums"])

        found = kept.select(vector_col).mapInArrow(add, "part int, entry int, n long, sums array<long>")
        whole = found.groupBy("part", "entry").agg(F.sum("n").alias("n"), *(F.sum(F.col("sums")[i]).alias(f"s{i}") for i in range(books.shape[2])))
        books = books.copy()
        for part, entry, n, *sums in whole.collect():  # a row for each entry of each codebook
            books[part, entry] = [s // n for s in sums]
        sent.unpersist()
    return books


def codebooks_sha256(books: np.ndarray) -> str:
    return hashlib.sha256(",".join(map(str, books.reshape(-1).tolist())).encode()).hexdigest()


def encode(kept: DataFrame, books: np.ndarray, vector_col: str = "__v") -> DataFrame:
    """kept with code (two hex digits for each part) and error (squared distances to the entries, summed) in place of vector_col."""
    sent = kept.sparkSession.sparkContext.broadcast([KdTree(b) for b in books if len(b)])
    names = [c for c in kept.columns if c != vector_col]
    digits = np.array([list(f"{i:02x}".encode()) for i in range(256)], np.uint8)

    def run(batches):
        trees = sent.value
        for batch in batches:
            points = _parts(batch, vector_col, len(trees))
            found = [tree.nearest(points[:, p]) for p, tree in enumerate(trees)]
            text = digits[np.column_stack([i for i, _ in found])].tobytes().decode()
            code = [text[i * 2 * len(trees) : (i + 1) * 2 * len(trees)] for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in names), pa.array(code, pa.string()), pa.array(sum(d for _, d in found))], names=[*names, "code", "error"])

    fields = "".join(f"`{f.name}` {f.dataType.simpleString()}, " for f in kept.schema.fields if f.name != vector_col)
    return kept.mapInArrow(run, f"{fields}code string, error long")


def compress(vectors: DataFrame, parts: int = PARTS, entries: int = ENTRIES, rounds: int = ROUNDS, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """id, code, error, label_error (errors of all rows with an equal label, nulls together) and codebooks_sha256 for each row with a whole vector.

    A vector that is null, empty, or holds null or non-finite components takes no part. The others have one length, a multiple of `parts`, else
    ValueError; so has a component beyond 2^16. Rows without an id are kept, and seed a codebook only after all others; rows that share
    an id are vectors of their own. With fewer vectors than entries the codebooks are shorter. No rows in, no rows out. Other columns are not read.
    """
    if not 0 < entries <= 256:
        raise ValueError("entries must be from 1 to 256")
    rows = vectors.select(F.col(id_col).cast("long").alias(id_col), F.col(label_col).alias("__label"), F.col(vector_col).cast("array<double>").alias("__x"))
    kept = keep(integer_vectors(rows, "__x").drop("__x"), "vectors")
    least, most = kept.agg(F.min(F.size("__v")), F.max(F.size("__v"))).first()
    if least != most or (least or 0) % parts:
        raise ValueError(f"vectors of {least} to {most} components can't be cut into {parts} equal parts")
    books = train(kept, parts, entries, rounds, id_col)
    coded = keep(encode(kept, books), "codes")
    of_label = F.coalesce(F.xxhash64("__label"), F.lit(0).cast("long"))  # dealt by this, not by the label, so that a hot one can be split
    sums = coded.groupBy("__label").agg(F.sum("error").alias("label_error")).select(of_label.alias("__g"), F.col("__label").alias("__l"), "label_error")
    met = coded.withColumn("__h", of_label).join(sums, (F.col("__h") == F.col("__g")) & F.col("__label").eqNullSafe(F.col("__l")))
    return met.select(id_col, "code", "error", "label_error", F.lit(codebooks_sha256(books)).alias("codebooks_sha256"))
