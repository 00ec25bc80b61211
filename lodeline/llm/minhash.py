"""MinHash near-duplicates: banded candidates, sequential Bayesian verification on signatures, exact verification of what survives.

A document is the set of its distinct word shingles; equal sets are one class. A signature has MINIMA minima, cut into bands; sets that agree in all
minima of a band share its bucket, and every bucket is a cell of candidates. Buckets with the same members count once.

Candidates are compared by a short form of their signatures, a byte of each minimum, a batch of positions after the other. After each batch the
posterior probability that the similarity reaches the threshold is known from the positions that agree (a uniform prior; two bytes also agree by
chance): a pair below `miss` is pruned. Pairs that survive all batches join their sets into one canopy.

Survivors are verified exactly, on the full sets, as those of the n-gram join: canopies are parted into cells of similar size, and all pairs of a
block are counted, but for those that are one component already. So a false survivor costs a comparison and no link is made up; a link is lost
only if its sets share no bucket (bands are as long as a chance of `miss` allows) or its pair is pruned, and then only if no other links join their
component.

Scale: text is read once for the signatures; the texts of canopies are shuffled once. Large buckets and canopies are cut into blocks (cells.py). A set
that a third of all documents share is one class; its copies meet in an aggregate and in a join that adaptive execution can split.
"""

from __future__ import annotations

from math import comb

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .cells import GROUP, MEMBERS, PIVOTS, block_links, cell_links, components, placed, tile_components
from .common import NULL_ID, discard, id_key, keep, own_exchange, text_runs
from .ngram_join import Bands, _classes, labelled, set_links, shingles
from .words import mix

MINIMA, BATCH, MISS = 160, 32, 1e-7
_SEEN_MOST = 1 << 20
_RNG = np.random.default_rng(20250311)
_FACTORS = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_TERMS = _RNG.integers(0, 2**63, MINIMA, dtype=np.uint64)


def shape(percent: int, miss: float = MISS) -> tuple[int, int]:
    """Bands, and minima of each: as many as let a pair of just that similarity share no bucket with a chance of at most `miss`; one at least."""
    rows = 1
    while rows < MINIMA and (1 - (percent / 100) ** (rows + 1)) ** (MINIMA // (rows + 1)) <= miss:
        rows += 1
    return MINIMA // rows, rows


def signatures(text: np.ndarray, value: np.ndarray, n_texts: int, bands: int, rows: int) -> tuple[np.ndarray, np.ndarray]:
    """Bucket of each band (a row for each text that has shingles, 64-bit) and a byte of each minimum. text and value: distinct shingles, by text."""
    first = np.searchsorted(text, np.arange(n_texts))
    buckets, short = np.zeros((n_texts, bands), np.uint64), np.zeros((n_texts, bands * rows), np.uint8)
    if not len(text):
        return buckets, short
    some = np.flatnonzero(np.bincount(text, minlength=n_texts))
    for r in range(rows):
        own = mix(value + np.uint64(r))
        for b in range(bands):
            at = b * rows + r
            least = mix(np.minimum.reduceat(own * _FACTORS[at] + _TERMS[at], first[some]))
            buckets[some, b] = mix(buckets[some, b] ^ least ^ np.uint64(b))
            short[some, at] = least & np.uint64(255)
    return buckets, short


def least_agreeing(n: int, percent: int, miss: float = MISS) -> int:
    """Of n compared bytes, the fewest that must agree for a posterior probability of at least `miss` that the similarity is percent / 100 or more.

    With a uniform prior of the share p of agreeing bytes, the posterior is Beta(m + 1, n - m + 1), whose mass above t is that of
    Binomial(n + 1, t) up to m. Bytes of other minima agree by a chance of 1/256.
    """
    t = percent / 100 + (1 - percent / 100) / 256
    below = 0.0
    for m in range(n + 1):
        below += comb(n + 1, m) * t**m * (1 - t) ** (n + 1 - m)
        if below >= miss:
            return m
    return n


def survivors(short: np.ndarray, guest: np.ndarray, percent: int, miss: float = MISS) -> np.ndarray:
    """For each of a block's signatures the first position of its component, by pairs that no batch of positions prunes."""
    width = short.shape[1]
    steps = [(start, min(start + BATCH, width)) for start in range(0, width, BATCH)]
    needed = [least_agreeing(end, percent, miss) for _, end in steps]

    def linked(left: np.ndarray):
        def with_left(right: np.ndarray) -> np.ndarray:
            out = np.zeros((len(left), len(right)), bool)
            (_, end), a, b = steps[0], short[left], short[right]
            agree = np.zeros((len(left), len(right)), np.uint8)
            for i in range(end):
                agree += a[:, i, None] == b[:, i]
            x, y = np.nonzero(agree >= needed[0])
            same = agree[x, y].astype(np.int64)
            for (start, end), least in zip(steps[1:], needed[1:], strict=True):
                same += (a[x, start:end] == b[y, start:end]).sum(1)
                x, y, same = x[same >= least], y[same >= least], same[same >= least]
            out[x, y] = True
            return out

        return with_left

    return tile_components(guest, linked)


def row_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85, miss: float = MISS, members: int = MEMBERS, group: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """For each row its key (k: the id, NULL_ID for null; th: the hash of the text), n (its shingles), and ck, cth: the least key of its component."""
    rows = docs.select(id_key(id_col).cast("long").alias("k"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    least, (bands, length) = Bands(percent).least(), shape(percent, miss)
    width = bands * length

    def describe(batches):
        seen: set[int] = set()
        for batch in batches:
            for at, n, data, offsets in text_runs(batch.column("text")):
                text, value = shingles(data, offsets, size)
                many, c, c2 = _classes(text, value, n)
                new = np.zeros(n, bool)
                for i in np.flatnonzero(many >= least).tolist():  # the task's later copies of a set have no signature
                    if c[i] not in seen:
                        new[i] = True
                        seen.add(int(c[i]))
                if len(seen) > _SEEN_MOST:
                    seen.clear()
                own = new[text]
                buckets, short = signatures(text[own], value[own], n, bands, length)
                keys = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(new * bands)]).astype(np.int32)), pa.array(buckets[new].reshape(-1).view(np.int64)), mask=pa.array(~new))
                marks = pa.array([short[i].tobytes() if new[i] else None for i in range(n)], pa.binary())
                columns = [batch.column("k").slice(at, n), batch.column("th").slice(at, n), *(pa.array(x.astype(np.int64)) for x in (many, c, c2, np.diff(offsets))), keys, marks]
                yield pa.RecordBatch.from_arrays(columns, names=["k", "th", "n", "c", "c2", "bytes", "buckets", "short"])

    sets = keep(rows.mapInArrow(describe, "k long, th long, n long, c long, c2 long, bytes long, buckets array<long>, short binary"), "sets")
    found = sets.where("n > 0").groupBy("n", "c", "c2").agg(F.min(F.struct("k", "th", "bytes")).alias("rep"), F.max("buckets").alias("buckets"), F.max("short").alias("short"))
    classes = keep(found, "classes")
    marked = classes.where("short IS NOT NULL")
    banded = marked.select("c", F.explode("buckets").alias("cell"))
    bucket = banded.groupBy("cell").agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("c")).alias("x"), F.min("c").alias("lo"), F.max("c").alias("hi")).where("n > 1")
    once = bucket.groupBy("n", "x", "lo", "hi").agg(F.min("cell").alias("cell")).select("cell")
    candidates = placed(banded.join(own_exchange(once, "cell"), "cell").withColumn("bytes", F.lit(width).cast("long")), members)

    def short_of(table: pa.Table) -> np.ndarray:
        return np.frombuffer(b"".join(table.column("short").to_pylist()), np.uint8).reshape(-1, width)

    fetch = lambda blocks: blocks.hint("merge").join(marked.select("c", "short"), "c")
    alike = cell_links(candidates, fetch, block_links(short_of, lambda values, guest: survivors(values, guest, percent, miss)), group * 16, pivots)
    discard(candidates)
    canopy = components(alike).withColumnRenamed("label", "canopy")
    links = set_links(docs, classes, canopy, id_col, text_col, size, percent, members, group, pivots)
    discard(canopy)
    discard(alike)
    return labelled(sets, classes, links)


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 85, miss: float = MISS, **options) -> DataFrame:
    """id, n_shingles, component_id, kept for each row of docs: the smallest id reachable by links of Jaccard similarity >= percent / 100.

    kept is whether the row's id is that of its component. Words are lower-cased (A-Z) runs of non-space bytes, shingles `size` of them. A null or
    empty text has no shingles and is linked with nothing. Rows with equal ids and texts are alike; rows with equal ids (or without) and other
    texts are separate members. A null id counts as the smallest and is given back as null; of rows without an id those are kept that are the
    least of their component by a hash of the text. An empty table gives no rows. Other columns are not read.
    """
    back = lambda column: F.when(F.col(column) != NULL_ID, F.col(column))
    kept = (F.col("k") == F.col("ck")) & ((F.col("k") != NULL_ID) | (F.col("th") == F.col("cth")))
    found = row_components(docs, id_col, text_col, size, percent, miss, **options)
    return found.select(back("k").alias(id_col), F.col("n").alias("n_shingles"), back("ck").alias("component_id"), kept.alias("kept"))
