"""Exact n-gram Jaccard self-join by universe partition and the pigeonhole principle; components of the links.

A document is the set of its distinct word shingles. Equal sets are one class, and classes are joined:

Size bands. A pair belongs to the band of its smaller set; a set also stands in the band below where it can be the larger of a pair.
Partition. In a band where linked sets differ in at most H shingles, every shingle is hashed to one of m segments. With m > H some segment
of the two sets is equal; with 2 m > H some segment differs by one shingle at most, which is found by indexing each segment and its
one-deletion neighbourhood. Which of the two a band uses is settled by cost: rows written, and segments of less than two shingles, which tell
little, that would have to be used.
Segment subsets. A set that can differ from its partners in h shingles indexes only h + 1 of its segments, the first in an order that
depends on a segment's content alone, small ones last: of two sets that share m - h segments, the first h + 1 of each hold a common one.

Verification. Sets that share a segment meet in its bucket. Linked sets share a bucket, so they lie in one component of the sets and buckets,
a canopy; a bucket gives its members' edges to one of them, not its pairs. Index rows are shuffled once: a task sends one row of each segment in
a run of its rows, and what it has joined already as a bucket of its own, so no bucket has more rows than there are runs. A canopy is parted into cells of similar size: a set lies in one,
and also in the next one up if it can be linked with sets there. A cell is dealt into blocks of bounded members and bytes, mostly one, and
a task counts the intersections of a block exactly, as products of 0/1 matrices of the shingles that its tiles share.

Cells of several blocks are compared in two rounds (cells.py). The texts of the sets in cells are found by a filter of their keys that is sent to the
readers, so only they are shuffled, once, into a table that both rounds read.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .cells import GROUP, MEMBERS, PIVOTS, block_links, cell_links, components, key_filter, passing, placed, tile_components
from .common import NULL_ID, discard, id_key, keep, own_exchange, text_runs
from .words import Prefix, grams, mix, split_words

_SEEN_MOST = 1 << 20
_COLUMNS = 2048
_RUN = 1 << 21


def shingles(data: np.ndarray, offsets: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles of a run of texts: text of each, and hash, in this order. A text with fewer words is one shingle; without words none."""
    w = split_words(data, offsets, lower=True)
    gram, count = grams(w.hash, size), w.counts
    text_end = np.repeat(w.first[1:], count)
    starts = np.flatnonzero(np.arange(len(text_end)) + size <= text_end)
    short = np.flatnonzero((count > 0) & (count < size))
    whole = Prefix(w.hash).run(w.first[short], w.first[short + 1])
    text = np.concatenate([np.repeat(np.arange(len(count)), count)[starts], short])
    value = np.concatenate([gram[starts] if len(starts) else np.zeros(0, np.uint64), whole])
    order = np.lexsort((value, text))
    text, value = text[order], value[order]
    new = np.ones(len(text), bool)
    new[1:] = (text[1:] != text[:-1]) | (value[1:] != value[:-1])
    return text[new], value[new]


def _sums(slot: np.ndarray, value: np.ndarray, n: int) -> np.ndarray:
    """Sums modulo 2^64 of value by slot."""
    low = np.bincount(slot, (value & np.uint64(0xFFFFFFFF)).astype(np.float64), n).astype(np.uint64)
    high = np.bincount(slot, (value >> np.uint64(32)).astype(np.float64), n).astype(np.uint64)
    return low + (high << np.uint64(32))


@dataclass(frozen=True)
class Bands:
    """Size bands for links of at least percent % Jaccard similarity."""

    percent: int
    ratio: float = 2.0
    spare: int = 2

    def least(self) -> int:
        """The smallest set that can be linked with another than itself."""
        return -(-self.percent // (100 - self.percent))

    def differ(self, size):
        """How much two linked sets can differ, the smaller having `size` shingles."""
        return size * (100 - self.percent) // self.percent

    def table(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Lower edge of each band, its segments, and whether it indexes one-deletion neighbourhoods."""
        edges = [self.least()]
        while edges[-1] < 1 << 31:
            edges.append(int(edges[-1] * self.ratio) + 1)
        segments, deletions = [], []
        for low, high in zip(edges, edges[1:], strict=False):
            h = self.differ(high - 1)
            plain, deleting = h + 1 + self.spare + h // 8, h // 2 + 1
            strong = plain * (1 - (1 + low / plain) * np.exp(-low / plain))
            needed = self.differ(low) + 1
            by_deletion = deleting + low < needed + 20 * max(0, needed - strong)
            segments.append(deleting if by_deletion else plain)
            deletions.append(by_deletion)
        return np.array(edges[:-1]), np.array(segments), np.array(deletions)


def segment_keys(text: np.ndarray, value: np.ndarray, n_texts: int, bands: Bands) -> tuple[np.ndarray, np.ndarray]:
    """Text and key of each index row; text and value: the distinct shingles."""
    edges, segments, deletions = bands.table()
    size = np.bincount(text, minlength=n_texts)
    linked = np.flatnonzero(size >= edges[0])
    own = np.searchsorted(edges, size[linked], "right") - 1
    smallest = -(-size[linked] * bands.percent // 100)  # that such a set can be linked with
    below = np.flatnonzero((own > 0) & (smallest < edges[own]))
    part_text = np.concatenate([linked, linked[below]])
    part_band = np.concatenate([own, own[below] - 1])
    base = np.concatenate([[0], np.cumsum(segments[part_band])]).astype(np.int64)
    first = np.concatenate([[0], np.cumsum(size)])
    length = size[part_text]
    part = np.repeat(np.arange(len(part_text)), length)
    token = np.repeat(first[part_text] - np.concatenate([[0], np.cumsum(length)])[:-1], length) + np.arange(length.sum())
    v = value[token]
    band = part_band[part]
    segment = ((mix(v ^ mix(band.astype(np.uint64) + np.uint64(77))) >> np.uint64(32)) * segments[band].astype(np.uint64)) >> np.uint64(32)
    slot = base[part] + segment.astype(np.int64)
    n_slots = int(base[-1])
    held, spread = np.bincount(slot, minlength=n_slots), mix(v + np.uint64(0x632BE59BD9B4E019))
    total = _sums(slot, spread, n_slots)
    slot_part = np.repeat(np.arange(len(part_text)), segments[part_band])
    within = np.arange(n_slots) - base[slot_part]
    place = mix((part_band[slot_part].astype(np.uint64) << np.uint64(32)) + within.astype(np.uint64))
    key = mix(total ^ place)
    order = np.lexsort((key, held < 2, slot_part))
    rank = np.empty(n_slots, np.int64)
    rank[order] = np.arange(n_slots) - base[slot_part[order]]
    p = bands.percent
    differ = np.concatenate([bands.differ(size[linked]), (100 - p) * (size[linked[below]] + edges[own[below]] - 1) // (100 + p)])
    written = deletions[part_band[slot_part]] | (rank <= differ[slot_part])
    less = np.flatnonzero(deletions[band])
    keys = np.concatenate([key[written], mix((total[slot[less]] - spread[less]) ^ place[slot[less]])])
    return part_text[np.concatenate([slot_part[written], part[less]])], keys


def joined_runs(key: np.ndarray, c: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Index rows (key, c) with the same components and each key once, that of its least c, in the given order. Each other c of a key is joined
    with that one: both are rows of a key that only such pairs have."""
    order = np.argsort(key, kind="stable")
    start = np.flatnonzero(np.append(True, key[order][1:] != key[order][:-1])[: len(key)])
    if len(start) == len(key):
        return key, c
    run = np.repeat(np.arange(len(start)), np.diff(np.append(start, len(key))))
    least = np.minimum.reduceat(c[order], start)
    first = np.sort(order[start])
    p = np.empty(len(key), c.dtype)
    p[order] = least[run]
    pairs = np.unique(np.column_stack([c, p])[c != p], axis=0)
    own = mix(mix(pairs[:, 0].view(np.uint64)) ^ pairs[:, 1].view(np.uint64))
    return np.concatenate([key[first], own, own]), np.concatenate([p[first], pairs[:, 0], pairs[:, 1]])


def _classes(text: np.ndarray, value: np.ndarray, n_texts: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Shingles of each text, and two hashes of its set."""
    size = np.bincount(text, minlength=n_texts)
    one = mix(_sums(text, mix(value ^ np.uint64(0xA0761D6478BD642F)), n_texts) + size.astype(np.uint64))
    other = mix(_sums(text, mix(value ^ np.uint64(0xE7037ED1A0B428DB)), n_texts))
    return size, one.view(np.int64), other.view(np.int64)


def block_components(values: list[np.ndarray], guest: np.ndarray, percent: int) -> np.ndarray:
    """For each of the sets in values (distinct hashes) the first position of its component, by links between sets that aren't guests, or, if there
    are guests, between those and the others. Tiles of sets that are one component already are not compared."""
    n = len(values)
    size = np.array([len(v) for v in values])
    every, owner = np.concatenate(values), np.repeat(np.arange(n), size)
    order = np.argsort(every, kind="stable")
    every, owner = every[order], owner[order]
    new = np.ones(len(every), bool)
    new[1:] = every[1:] != every[:-1]
    token = np.cumsum(new) - 1
    several = np.bincount(token)[token] > 1
    token, owner = np.unique(token[several], return_inverse=True)[1], owner[several]
    by_owner = np.argsort(owner, kind="stable")
    token, first = token[by_owner], np.searchsorted(owner[by_owner], np.arange(n + 1))
    n_tokens = int(token.max(initial=-1)) + 1

    def incidence(sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        return np.repeat(np.arange(len(sets)), first[sets + 1] - first[sets]), np.concatenate([token[first[i] : first[i + 1]] for i in sets])

    def matrix(rows: np.ndarray, columns: np.ndarray, n_rows: int, start: int) -> np.ndarray:
        here = (columns >= start) & (columns < start + _COLUMNS)
        out = np.zeros((n_rows, _COLUMNS), np.float32)
        out[rows[here], columns[here] - start] = 1
        return out

    def linked(left: np.ndarray):
        l_row, l_token = incidence(left)
        l_has = np.zeros(n_tokens, bool)
        l_has[l_token] = True

        def with_left(right: np.ndarray) -> np.ndarray:
            r_row, r_token = incidence(right)
            has = np.zeros(n_tokens, bool)
            has[r_token] = True
            has &= l_has
            number = np.where(has, np.cumsum(has) - 1, -1)
            both = np.zeros((len(left), len(right)), np.float32)
            for start in range(0, int(has.sum()), _COLUMNS):
                both += matrix(l_row, number[l_token], len(left), start) @ matrix(r_row, number[r_token], len(right), start).T
            return 100 * both >= percent * (size[left, None] + size[right] - both)

        return with_left

    return tile_components(guest, linked)


def set_links(docs: DataFrame, classes: DataFrame, canopy: DataFrame, id_col: str, text_col: str, size: int, percent: int, members: int = MEMBERS, group: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """A spanning forest (a, b) of the links, verified on the full sets, between classes (n, c, rep) of one canopy (v, canopy); a kept table."""

    def sets_of(table: pa.Table) -> list[np.ndarray]:
        values: list[np.ndarray] = []
        for _, n, data, offsets in text_runs(table.column("text")):
            text, value = shingles(data, offsets, size)
            values += np.split(value, np.searchsorted(text, np.arange(1, n)))
        return values

    width = 4 * math.log(100 / percent)
    level = lambda n: F.floor(F.log(n) / width).cast("long")
    cells = F.transform(F.array_distinct(F.array(level(F.col("n")), level(F.col("n") * (100.1 / percent)))), lambda x: F.xxhash64("canopy", x))
    in_cell = placed(classes.join(canopy, classes.c == canopy.v).select("c", "rep.*", F.explode(cells).alias("cell")), members)
    key = F.xxhash64("k", "th")
    keys = in_cell.select("k", "th").distinct()
    sent = key_filter(keys.select(key.alias("key")), "key", keys.count())
    rows = docs.select(id_key(id_col).cast("long").alias("k"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))
    found = passing(rows.select("*", key.alias("key")), "key", sent).drop("key").groupBy("k", "th").agg(F.first("text").alias("text"))
    texts = keep(found.join(keys, ["k", "th"], "left_semi"), "texts")
    fetch = lambda blocks: texts.join(blocks.hint("merge"), ["k", "th"]).select("c", "cell", "block", "guest", "text")  # noqa: E731  (never broadcast: it grows with the corpus)
    out = cell_links(in_cell, fetch, block_links(sets_of, lambda values, guest: block_components(values, guest, percent)), group, pivots)
    discard(texts)
    discard(in_cell)
    return out


def labelled(sets: DataFrame, classes: DataFrame, links: DataFrame) -> DataFrame:
    """k, th, n, ck, cth for each row of sets, from links between classes."""
    labels = components(links)
    linked = classes.join(labels, F.col("c") == F.col("v")).select("n", "c", "c2", "label", "rep")
    least = linked.groupBy("label").agg(F.min(F.struct("rep.k", "rep.th")).alias("least"))
    component = linked.join(own_exchange(least, "label"), "label").select("n", "c", "c2", "least")
    alone = F.struct(F.col("rep.k"), F.col("rep.th"))
    of_class = classes.join(component, ["n", "c", "c2"], "left").select("n", "c", "c2", F.coalesce("least", alone).alias("least"))
    each = sets.join(own_exchange(of_class, "c"), ["n", "c", "c2"], "left")
    return each.select("k", "th", "n", F.coalesce("least.k", "k").alias("ck"), F.coalesce("least.th", "th").alias("cth"))


def row_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, members: int = MEMBERS, group: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """For each row its key (k: the id, NULL_ID for null; th: the hash of the text), n (its shingles), and ck, cth: the least key of its component."""
    bands = Bands(percent)
    rows = docs.select(id_key(id_col).cast("long").alias("k"), F.xxhash64(text_col).alias("th"), F.col(text_col).alias("text"))

    def describe(batches):
        for batch in batches:
            out = [np.zeros(0, np.int64)] * 4
            for _, n, data, offsets in text_runs(batch.column("text")):
                found = [*_classes(*shingles(data, offsets, size), n), np.diff(offsets)]
                out = [np.concatenate(x) for x in zip(out, found, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column("k"), batch.column("th"), *(pa.array(x.astype(np.int64)) for x in out)], names=["k", "th", "n", "c", "c2", "bytes"])

    def index(batches):
        seen: set[int] = set()
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def sent() -> pa.RecordBatch:
            key, c = joined_runs(*(np.concatenate(x) for x in zip(*held, strict=True)))
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(c)], names=["seg", "c"])

        for batch in batches:
            for _, n, data, offsets in text_runs(batch.column("text")):
                text, value = shingles(data, offsets, size)
                c = _classes(text, value, n)[1]
                new = np.zeros(n, bool)
                for i, x in enumerate(c.tolist()):  # the task's later copies of a set add nothing
                    if x not in seen:
                        new[i] = True
                        seen.add(x)
                if len(seen) > _SEEN_MOST:
                    seen.clear()
                own = new[text]
                row, key = segment_keys(text[own], value[own], n, bands)
                held.append((key, c[row]))
                if sum(len(x) for x, _ in held) >= _RUN:
                    yield sent()
        if held:
            yield sent()

    sets = keep(rows.mapInArrow(describe, "k long, th long, n long, c long, c2 long, bytes long"), "sets")
    classes = keep(sets.where("n > 0").groupBy("n", "c", "c2").agg(F.min(F.struct("k", "th", "bytes")).alias("rep")), "classes")
    keys = rows.mapInArrow(index, "seg long, c long")
    least = keys.withColumn("p", F.min("c").over(W.partitionBy("seg")))
    meet = least.where("c <> p").select(F.col("c").alias("a"), F.col("p").alias("b")).distinct()
    canopy = components(meet).withColumnRenamed("label", "canopy")
    links = set_links(docs, classes, canopy, id_col, text_col, size, percent, members, group, pivots)
    discard(canopy)
    return labelled(sets, classes, links)


def join_components(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", size: int = 3, percent: int = 90, **options) -> DataFrame:
    """id, n_shingles, component_id for each row of docs: the smallest id reachable by links of Jaccard similarity >= percent / 100.

    Words are lower-cased (A-Z) runs of non-space bytes, shingles `size` of them. A null or empty text has no shingles and is linked with
    nothing; its component is its own id. Rows with equal ids and texts are alike; rows with equal ids (or without) and other texts are separate
    members. A null id counts as the smallest and is given back as null. An empty table gives no rows. Other columns are not read.
    """
    back = lambda column: F.when(F.col(column) != NULL_ID, F.col(column))
    return row_components(docs, id_col, text_col, size, percent, **options).select(back("k").alias(id_col), F.col("n").alias("n_shingles"), back("ck").alias("component_id"))
