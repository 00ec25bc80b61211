"""Components of the links within cells of any size: sets that may be linked are compared in blocks of bounded members.

A cell is a group of members of which some are linked. It is dealt into blocks, mostly one, and a task compares the members of a block pair
by pair; pairs of members that are one component already are left out by tiles. A few pivots of a cell of several blocks are sent to all of them, so
most of a large group of near copies is one component after the first round. A link still unseen has an end outside of the cell's largest
component; those members, and only those, are sent to all blocks in a second round. What is copied grows with what isn't linked to the rest, and
nothing is dropped.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import discard, keep, own_exchange
from .words import mix

MEMBERS, BYTES, PIVOTS, GROUP, TILE = 2048, 16 << 20, 16, 1024, 256
_MOST_BITS = 1 << 27  # of a sent filter: 16 MB


def components(links: DataFrame) -> DataFrame:
    """v, label for every end of the links (a, b): the least id of its component. Labels are passed to neighbours and then followed to the
    label's own label, so long chains end after few turns. Adaptive execution merges the partitions of small turns."""
    edges = keep(links.select("a", "b").union(links.select("b", "a")).distinct(), "edges")
    labels = keep(edges.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.lit(0).cast("long").alias("old"), F.least("v", "m").alias("label")), "labels")
    while True:
        now = labels.select("v", "label")
        near = edges.join(now.select(F.col("v").alias("b"), "label"), "b").groupBy(F.col("a").alias("v")).agg(F.min("label").alias("m"))
        least = now.join(near, "v").select("v", F.col("label").alias("old"), F.least("label", "m").alias("label"))
        jump = least.join(now.select(F.col("v").alias("label"), F.col("label").alias("further")), "label", "left")
        after = keep(jump.select("v", "old", F.least("label", "further").alias("label")), "labels")
        discard(labels)
        labels = after
        if not after.where("old <> label").limit(1).count():
            discard(edges)
            return labels.select("v", "label")


def unite(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels (the first position of each component) after the links between the positions a and b."""
    parent = label.copy()
    for x, y in np.unique(np.sort(np.column_stack([label[a], label[b]]), 1), axis=0).tolist():
        while parent[x] != x:
            x = int(parent[x])
        while parent[y] != y:
            y = int(parent[y])
        parent[max(x, y)] = min(x, y)
    while (parent[parent] != parent).any():
        parent = parent[parent]
    return parent


def tile_components(guest: np.ndarray, linked: Callable[[np.ndarray], Callable[[np.ndarray], np.ndarray]]) -> np.ndarray:
    """For each of a block's members the first position of its component, by links between members that aren't guests, or, if there are guests, between
    those and the others. linked(left)(right): whether each of the members left is linked with each of right. Tiles of members that are one component
    already are not compared."""
    label, homes, guests = np.arange(len(guest)), np.flatnonzero(~guest), np.flatnonzero(guest)
    for i in range(0, len(homes), TILE):
        left = homes[i : i + TILE]
        with_left = linked(left)
        others = guests if len(guests) else homes[i:]
        for j in range(0, len(others), TILE):
            right = others[j : j + TILE]
            if (label[left] == label[left[0]]).all() and (label[right] == label[left[0]]).all():
                continue
            a, b = np.nonzero(with_left(right) & (label[left, None] != label[right]))
            if len(a):
                label = unite(label, left[a], right[b])
    return label


def block_links(prepare: Callable[[pa.Table], list | np.ndarray], label: Callable[[list | np.ndarray, np.ndarray], np.ndarray]) -> Callable[[pa.Table], pa.Table]:
    """An Arrow function over the rows (c, cell, block, guest, ...) of some blocks that gives links (a, b). prepare: what each row is compared
    by; label: the components of a block, from a run of these and the guests among them."""

    def compare(table: pa.Table) -> pa.Table:
        table = table.sort_by([("cell", "ascending"), ("block", "ascending"), ("guest", "ascending"), ("c", "ascending")]).combine_chunks()
        key = np.array([table.column(c).to_numpy() for c in ("cell", "block")]).T
        ids, guest = table.column("c").to_numpy(), table.column("guest").to_numpy()
        values = prepare(table)
        edge = np.flatnonzero(np.append(True, (key[1:] != key[:-1]).any(1)))
        out = np.arange(len(ids))
        for first, last in zip(edge, [*edge[1:], len(ids)], strict=True):
            if last - first > 1:
                out[first:last] = first + label(values[first:last], guest[first:last])
        return pa.table({"a": ids[out != np.arange(len(ids))], "b": ids[out[out != np.arange(len(ids))]]})

    return compare


def placed(members: DataFrame, most: int = MEMBERS) -> DataFrame:
    """members (c, bytes, cell, ...) of cells that have several, with n (of the cell), blocks and own (a member's block); a kept table."""
    counts = members.groupBy("cell").agg(F.count("*").alias("n"), F.ceil(F.greatest(F.count("*") / most, F.sum("bytes") / BYTES)).alias("blocks")).where("n > 1")
    return keep(members.join(own_exchange(counts, "cell"), "cell").withColumn("own", F.pmod(F.xxhash64("c"), "blocks")), "cells")


def cell_links(members: DataFrame, fetch: Callable[[DataFrame], DataFrame], compare: Callable[[pa.Table], pa.Table], group: int = GROUP, pivots: int = PIVOTS) -> DataFrame:
    """A spanning forest (a, b) of the links in each cell, as far as components go; a kept table.

    members: what placed() gives. fetch: adds to rows (c, cell, block, guest, ...) what compare(), an Arrow function of block_links(), reads.
    """

    def links(rows: DataFrame, tag: str) -> DataFrame:
        rows = keep(rows, tag)
        n, total = rows.agg(F.count("*"), F.coalesce(F.sum("bytes"), F.lit(0))).first()
        groups = max(1, -(-n // group), -(-total // BYTES))
        own = F.pmod(F.xxhash64("cell", "block"), F.lit(groups)).alias("g")
        found = keep(fetch(rows.drop("bytes")).groupBy(own).applyInArrow(compare, "a long, b long"), "links")
        discard(rows)
        return found

    every = F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)
    pivot = (F.col("blocks") > 1) & (F.pmod(F.xxhash64("c", F.lit("pivot")), F.greatest(F.lit(1).cast("long"), F.floor(F.col("n") / pivots))) == 0)
    first = members.withColumn("block", F.explode(F.when(pivot, every).otherwise(F.array("own")))).withColumn("guest", F.lit(False))
    found = links(first.drop("own", "n", "blocks"), "blocks")
    if not members.where("blocks > 1").limit(1).count():
        return found
    of = members.where("blocks > 1").join(components(found), F.col("c") == F.col("v"), "left").withColumn("label", F.coalesce("label", "c")).drop("v")
    part = of.groupBy("cell", "label").agg(F.count("*").alias("many"))
    largest = part.groupBy("cell").agg(F.max(F.struct("many", "label")).alias("x")).select("cell", F.col("x.label").alias("largest"))
    apart = keep(of.join(own_exchange(largest, "cell"), "cell").withColumn("left_out", F.col("label") != F.col("largest")), "apart")
    guests = apart.where("left_out").withColumn("block", F.explode(every)).where("block <> own").withColumn("guest", F.lit(True))
    hosts = apart.join(own_exchange(apart.where("left_out").select("cell").distinct(), "cell"), "cell", "left_semi").select(*apart.columns, F.col("own").alias("block"), F.lit(False).alias("guest"))
    second = links(guests.unionByName(hosts).select(*(c for c in first.columns if c not in ("own", "n", "blocks"))), "second-round")
    both = keep(found.union(second), "links")
    for done in (apart, found, second):
        discard(done)
    return both


def key_filter(keys: DataFrame, column: str, n: int) -> bytes:
    """A Bloom filter of the n distinct long keys, 16 bits for each and 16 MB at most: beyond that it lets more of other keys pass."""
    bits = min(_MOST_BITS, 1 << max(13, (16 * max(1, n) - 1).bit_length()))
    piece = 1 << 13

    def mark(batches):
        held = np.zeros(bits, bool)
        for batch in batches:
            for probe in _probes(batch.column(0).to_numpy().view(np.uint64), bits):
                held[probe] = True
        parts = held.reshape(-1, piece)
        used = np.flatnonzero(parts.any(1))
        yield pa.RecordBatch.from_arrays([pa.array(used.astype(np.int32)), pa.array([np.packbits(parts[i]).tobytes() for i in used], pa.binary())], names=["at", "bits"])

    def merge(table: pa.Table) -> pa.Table:
        whole = np.zeros(piece // 8, np.uint8)
        for x in table.column("bits").to_pylist():
            whole |= np.frombuffer(x, np.uint8)
        return pa.table({"at": table.column("at").slice(0, 1), "bits": pa.array([whole.tobytes()], pa.binary())})

    out = bytearray(bits // 8)
    marked = keys.select(column).mapInArrow(mark, "at int, bits binary").groupBy("at").applyInArrow(merge, "at int, bits binary")
    for at, part in marked.collect():  # at most 16 MB in all
        out[at * piece // 8 : (at + 1) * piece // 8] = part
    return bytes(out)


def _probes(keys: np.ndarray, bits: int):
    keys = mix(keys)
    step = (keys >> np.uint64(40)) | np.uint64(1)
    for i in range(4):
        yield ((keys + np.uint64(i) * step) & np.uint64(bits - 1)).astype(np.int64)


def passing(rows: DataFrame, column: str, sent: bytes) -> DataFrame:
    """rows whose long key is in the filter, and a few others."""
    data = rows.sparkSession.sparkContext.broadcast(sent)

    def run(batches):
        held = np.frombuffer(data.value, np.uint8)
        for batch in batches:
            found = np.ones(batch.num_rows, bool)
            for probe in _probes(batch.column(column).to_numpy().view(np.uint64), 8 * len(held)):
                found &= (held[probe >> 3] >> (7 - (probe & 7)).astype(np.uint8)) & 1 == 1
            if found.any():
                yield batch.filter(pa.array(found))

    return rows.mapInArrow(run, rows.schema)


def parted(rows: DataFrame, column: str, sent: bytes) -> tuple[DataFrame, DataFrame]:
    """rows whose long key is in the filter (and a few others), and the rest; only the key goes through Python."""
    data = rows.sparkSession.sparkContext.broadcast(sent)

    @F.arrow_udf("boolean")
    def held(keys: pa.Array) -> pa.Array:
        bits, found = np.frombuffer(data.value, np.uint8), np.ones(len(keys), bool)
        for probe in _probes(keys.to_numpy(zero_copy_only=False).view(np.uint64), 8 * len(bits)):
            found &= (bits[probe >> 3] >> (7 - (probe & 7)).astype(np.uint8)) & 1 == 1
        return pa.array(found)

    return rows.where(held(column)), rows.where(~held(column))
