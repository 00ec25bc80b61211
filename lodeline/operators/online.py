"""The online parser: one pass over a source's records in order, greedy groups, and a cache by first token and length.

A record whose first token and length are cached joins the cached group without comparison; else the group with the highest similarity
(zip-wise, over the template's length; the first of equals) takes it if that exceeds the threshold, and if none does it starts a group.
The record carries its group's template as it is then; a group's size starts at 1 and grows with every record, the first included.

Groups are indexed by the length of their templates: those of one length are an array of token numbers that a record meets at once, and as similarity
is at most the record's length over the template's, templates too long to exceed the threshold are not looked at. A source is one sequential task
by definition, with its groups in memory; its records are read as sorted batches. Sources run in parallel. Blank records take no part.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text
from ..functions.patterns import WILDCARD

THRESHOLD = 0.6
RESULT = "source string, line_no long, group_id string, size long, template array<string>"


def cache_key(found: Column) -> Column:
    """First token and number of tokens; null without tokens."""
    return F.when(F.size(found) > 0, F.struct(F.get(found, F.lit(0)).alias("first_token"), F.size(found).cast("long").alias("n_tokens")))


def prefix_groups(lines: DataFrame) -> DataFrame:
    """length, prefix, n_lines, first: how many lines share the length and the first three characters of what follows the time of day, and the least."""
    rest = text.after_time(F.col("line"))
    return lines.groupBy(F.length(rest).cast("long").alias("length"), F.substring(rest, 1, 3).alias("prefix")).agg(F.count("*").alias("n_lines"), F.min("line").alias("first"))


def prefix_members(lines: DataFrame) -> DataFrame:
    """dataset, line_no, line with the length and prefix of its group of prefix_groups(): a row for each line, so a group may be of any size."""
    rest = text.after_time(F.col("line"))
    return lines.select("dataset", "line_no", "line", F.length(rest).cast("long").alias("length"), F.substring(rest, 1, 3).alias("prefix"))


class _Band:
    """Templates of one length: token numbers, 0 for a wildcard, and the group of each row."""

    def __init__(self, length: int):
        self.codes, self.group, self.n = np.zeros((4, length), np.int64), np.zeros(4, np.int64), 0

    def put(self, group: int, codes: Sequence[int]) -> int:
        if self.n == len(self.group):
            self.codes, self.group = np.concatenate([self.codes, self.codes]), np.concatenate([self.group, self.group])
        self.codes[self.n], self.group[self.n] = codes, group
        self.n += 1
        return self.n - 1

    def take(self, row: int) -> int:
        """Remove a row; the group whose row took its place, or -1."""
        self.n -= 1
        if row == self.n:
            return -1
        self.codes[row], self.group[row] = self.codes[self.n], self.group[self.n]
        return int(self.group[row])


class Groups:
    """State of one source. Group ids are hashes of the source and the line that started the group."""

    def __init__(self, source: str, threshold: float = THRESHOLD, groups: Iterable[tuple[str, Sequence[str], int]] = (), cache: dict[tuple[str, int], int] | None = None):
        """groups: id, template and size of the groups so far, in their order; cache: the group of each first token and length."""
        self.source, self.threshold, self.cache = source, threshold, dict(cache or {})
        self.ids: list[str] = []
        self.sizes: list[int] = []
        self.changed: set[int] = set()  # groups with other sizes or templates than at the start
        self.cached: set[tuple[str, int]] = set()  # new in the cache
        self._names, self._codes, self._bands = [WILDCARD], {WILDCARD: 0}, {}
        self._at: list[tuple[int, int]] = []  # length and row of each group's template
        for name, template, size in groups:
            self._start(name, template, size)

    def _start(self, name: str, template: Sequence[str], size: int) -> int:
        self.ids.append(name)
        self.sizes.append(size)
        self._at.append((0, 0))
        codes = []
        for t in template:
            codes.append(self._codes.setdefault(t, len(self._names)))
            if codes[-1] == len(self._names):
                self._names.append(t)
        self._put(len(self.ids) - 1, codes)
        return len(self.ids) - 1

    def _put(self, group: int, codes: Sequence[int]) -> None:
        if len(codes) not in self._bands:
            self._bands[len(codes)] = _Band(len(codes))
        self._at[group] = len(codes), self._bands[len(codes)].put(group, codes)

    def template(self, group: int) -> list[str]:
        length, row = self._at[group]
        return [self._names[c] for c in self._bands[length].codes[row]]

    def _nearest(self, x: np.ndarray) -> int:
        """The group with the highest similarity above the threshold, the first of equals, or -1."""
        best, at = self.threshold, -1
        for length, band in self._bands.items():
            m = min(length, len(x))
            if not band.n or m / length < best or m / length <= self.threshold:
                continue
            codes = band.codes[: band.n, :m]
            share = ((codes == x[:m]) | (codes == 0)).sum(1) / length
            most = float(share.max())
            if most > self.threshold and most >= best:
                first = int(band.group[: band.n][share == most].min())
                if most > best or at < 0 or first < at:
                    best, at = most, first
        return at

    def _merge(self, group: int, x: np.ndarray) -> None:
        length, row = self._at[group]
        band, m = self._bands[length], min(length, len(x))
        merged = np.where(band.codes[row, :m] == x[:m], x[:m], 0)
        if m < length:
            moved = band.take(row)
            if moved >= 0:
                self._at[moved] = length, row
            self._put(group, merged.tolist())
        else:
            band.codes[row] = merged

    def add(self, line_no: int, tokens: Sequence[str]) -> int:
        """The group of the next record."""
        key = tokens[0], len(tokens)
        at = self.cache.get(key, -1)
        x = np.array([self._codes.get(t, -1) for t in tokens])
        if at < 0:
            at = self._nearest(x)
            if at < 0:
                at = self._start(hashlib.sha1(f"{self.source}:{line_no}".encode()).hexdigest(), tokens, 1)
                x = np.array([self._codes[t] for t in tokens])
            self.cache[key] = at
            self.cached.add(key)
        self._merge(at, x)
        self.sizes[at] += 1
        self.changed.add(at)
        return at


def online_parse(records: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """source, line_no, group_id, size, template for each record (source, line_no, line) that is not blank."""
    rows = records.select("source", "line_no", text.tokens(F.col("line")).alias("tokens")).where(F.size("tokens") > 0)

    def run(batches):
        state = None
        for batch in batches:
            source, out = batch.column("source").to_pylist(), []
            for name, n, tokens in zip(source, batch.column("line_no").to_pylist(), batch.column("tokens"), strict=True):
                if state is None or state.source != name:
                    state = Groups(name, threshold)
                at = state.add(n, tokens.as_py())
                out.append((state.ids[at], state.sizes[at], state.template(at)))
            ids, sizes, templates = zip(*out, strict=True) if out else ((), (), ())
            yield pa.RecordBatch.from_arrays([batch.column("source"), batch.column("line_no"), pa.array(ids, pa.string()), pa.array(sizes, pa.int64()), pa.array(templates, pa.list_(pa.string()))], names=["source", "line_no", "group_id", "size", "template"])

    return rows.repartition("source").sortWithinPartitions("source", "line_no").mapInArrow(run, RESULT)
