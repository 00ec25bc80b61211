"""Packing token pieces into windows by Karmarkar-Karp multiway differencing.

Tokenising cuts each document into full windows and a rest; the rest is cut into powers of two down to `least_cut` tokens and a last piece
below that, so pieces fit together and few are tiny. Pieces are dealt by a hash into groups of about `group_tokens` tokens. In a group of T
tokens the rests go to k = ceil(T / window) windows: every piece starts as a partition of k sums, the two partitions with the largest
spread are merged largest against smallest until one is left, whose sums are as good as equal. If a sum exceeds the window, k rises and the
differencing starts again. A piece of a full window is a window of its own.

Scale: the text is tokenised once and never shuffled; pieces are rows of a few numbers. The number of groups follows the tokens. Equal
pieces are counted, and their counts cut into portions of a small share of a group; portions are dealt by a hash of the whole piece and the
portion's number, so long documents, rows that share an id (or have none) and repeated rows all spread over the groups.
"""

from __future__ import annotations

import base64
import heapq
import os
import re
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep

WINDOW, LEAST_CUT, GROUP_TOKENS, END = 2048, 16, 1 << 19, 1
_TEXTS = 256
_PORTIONS = 16  # of equal pieces, to a group


def piece_lengths(n: int, window: int = WINDOW, least_cut: int = LEAST_CUT) -> list[int]:
    """Lengths that n tokens are cut into: full windows, powers of two, and a last piece below least_cut."""
    out = [window] * (n // window)
    rest = n % window
    while rest >= least_cut:
        out.append(1 << (rest.bit_length() - 1))
        rest -= out[-1]
    return [*out, rest] if rest else out


def differencing(sizes: list[int], k: int) -> list[list[int]]:
    """Karmarkar-Karp: k lists of the positions in sizes, with sums as near to each other as differencing brings them.

    A partition holds its nonzero sums only, sorted from the largest, each with a chain of positions; the others are empty.
    """
    if not sizes:
        return [[] for _ in range(k)]
    heap = [(-s, i, [(s, i)]) for i, s in enumerate(sizes)]
    heapq.heapify(heap)
    while len(heap) > 1:
        _, i, one = heapq.heappop(heap)
        _, j, two = heapq.heappop(heap)
        free = k - len(one)  # the smallest sums of `one` meet the largest of `two`
        merged = list(one)
        for at, (s, chain) in enumerate(two):
            if at < free:
                merged.append((s, chain))
            else:
                back = len(one) - 1 - (at - free)
                merged[back] = (merged[back][0] + s, (merged[back][1], chain))
        merged.sort(key=lambda x: -x[0])
        if len(merged) == k and merged[-1][0]:
            spread = merged[0][0] - merged[-1][0]
        else:
            spread = merged[0][0]
        heapq.heappush(heap, (-spread, min(i, j), merged))
    out: list[list[int]] = []
    for _, chain in heap[0][2]:
        found, stack = [], [chain]
        while stack:
            x = stack.pop()
            if isinstance(x, tuple):
                stack += x
            else:
                found.append(x)
        out.append(sorted(found))
    return out + [[] for _ in range(k - len(out))]


def windows(sizes: list[int], window: int = WINDOW) -> list[list[int]]:
    """The pieces of each window: as many windows as their sum asks for, more if differencing exceeds the capacity."""
    k = -(-sum(sizes) // window)
    while True:
        parts = differencing(sizes, k)
        if all(sum(sizes[i] for i in p) <= window for p in parts):
            return [p for p in parts if p]
        k += max(1, k // 256)


class Tokens:
    """Ids of texts as little-endian 32-bit bytes, by the tokenizer in the file at `path`.

    With `ranks`, a file of the same vocabulary as merge ranks, texts of the scripts that all Unicode versions class alike are encoded from
    the ranks, which gives the same ids several times faster. Texts with other characters or a special token go to the tokenizer itself.
    """

    def __init__(self, path: str, ranks: str | None = None, pattern: str | None = None):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs the tasks side by side
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.encoding = None
        if ranks:
            import tiktoken

            with open(ranks, "rb") as f:
                merges = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
            self.encoding = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=merges, special_tokens={})
        special = [str(x.content) for x in self.tokenizer.get_added_tokens_decoder().values()]
        self.odd = re.compile("|".join(["[^\0-\u052f\u2000-\u206f\u20a0-\u20bf]", *map(re.escape, special)]))

    def encode(self, text: str) -> bytes:
        if self.encoding is None or self.odd.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


_OPEN: dict[tuple, Tokens] = {}


def _tokens(*files: str | None) -> Tokens:
    """The tokenizer of a Python worker, kept from one task to the next."""
    if files not in _OPEN:
        _OPEN[files] = Tokens(*files)
    return _OPEN[files]


def token_pieces(docs: DataFrame, files: tuple[str | None, ...], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, least_cut: int = LEAST_CUT, end: int = END) -> DataFrame:
    """A row for each piece of each document: id, start, length, ids_crc32, doc_tokens. files: the arguments of Tokens."""

    def cut(batches):
        tokens = _tokens(*files)
        last = int(end).to_bytes(4, "little")
        for batch in batches:
            ids, texts = batch.column("id"), batch.column("text")
            for first in range(0, batch.num_rows, _TEXTS):
                rows: list[tuple[int, int, int, int, int]] = []
                for at, text in enumerate(texts.slice(first, _TEXTS).to_pylist(), first):
                    data, start = memoryview(tokens.encode(text or "") + last), 0
                    n = len(data) // 4
                    for length in piece_lengths(n, window, least_cut):
                        rows.append((at, start, length, zlib.crc32(data[4 * start : 4 * (start + length)]), n))
                        start += length
                columns = np.array(rows, np.int64).T
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(columns[0])), *map(pa.array, columns[1:])], names=[id_col, "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(cut, f"{id_col} long, start long, length long, ids_crc32 long, doc_tokens long")


def pack_pieces(pieces: DataFrame, id_col: str = "doc_id", window: int = WINDOW, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """pieces with sequence_id and offset. pieces: a kept table; any columns beside id_col, start and length."""
    total = pieces.agg(F.sum("length")).first()[0] or 0
    groups = max(1, -(-total // group_tokens))
    names = pieces.columns

    def place(table: pa.Table) -> pa.Table:
        table = table.take(pa.array(np.repeat(np.arange(table.num_rows), table.column("__copies").to_numpy()))).drop_columns(["__copies"])
        table = table.sort_by([("length", "descending"), (id_col, "ascending"), ("start", "ascending"), *((c, "ascending") for c in names if c not in (id_col, "start", "length"))])
        sizes, group = table.column("length").to_numpy(), int(table.column("__group")[0].as_py())
        sequence, offset = np.zeros(len(sizes), np.int64), np.zeros(len(sizes), np.int64)
        full = int(np.searchsorted(-sizes, -window, "right"))
        sequence[:full] = np.arange(full)
        for number, members in enumerate(windows(sizes[full:].tolist(), window), full):
            at = 0
            for i in members:
                sequence[full + i], offset[full + i] = number, at
                at += int(sizes[full + i])
        table = table.drop_columns(["__group"])
        return table.append_column("sequence_id", pa.array((group << 32) + sequence)).append_column("offset", pa.array(offset))

    counted = pieces.groupBy(*names).agg(F.count("*").alias("__n"))
    most = F.greatest(F.lit(1).cast("long"), F.floor(F.lit(group_tokens / _PORTIONS) / F.col("length")))
    portions = counted.withColumn("__most", most).select("*", F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("__n") - 1) / F.col("__most")))).alias("__portion"))
    group = F.pmod(F.xxhash64(*names, "__portion"), F.lit(groups))
    dealt = portions.select(*names, F.least(F.col("__most"), F.col("__n") - F.col("__portion") * F.col("__most")).alias("__copies"), group.alias("__group"))
    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pieces.schema.fields)
    return dealt.groupBy("__group").applyInArrow(place, f"{fields}, sequence_id long, offset long")


def pack(docs: DataFrame, files: tuple[str | None, ...], id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, group_tokens: int = GROUP_TOKENS) -> DataFrame:
    """Every token of docs, each in one piece: id, start, length, ids_crc32, doc_tokens, sequence_id, offset.

    A null or empty text is the end token alone. Null ids are kept. Equal rows are packed each for itself. No rows in, no rows out. Other
    columns are not read. sequence_id: group number in the upper 32 bits, window number in the lower; offsets in a window are gapless.
    """
    return pack_pieces(keep(token_pieces(docs, files, id_col, text_col, window), "pieces"), id_col, window, group_tokens)
