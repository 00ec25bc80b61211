"""Alignment of the tokens of two tokenizers, A and B, by id-striped dense count matrices.

Both tokenizers cut the same bytes, a space and the text. The byte offsets where tokens of both end cut a document into groups; an A and a B
token whose byte ranges overlap are linked. The count of an id pair is the number of documents that hold it linked.

Stripes. An A id belongs to stripe id mod `stripes`; a stripe's counts are a dense matrix of its A ids by all B ids, of BLOCK numbers at most.
Tokenising writes a row for each run of documents and stripe, a chunk: the distinct pairs of each document in it, with their links. Chunks are
dealt into cells, a stripe or, where it holds more than its share of the links, one of several portions of it. A cell adds its chunks up in
a matrix; the nonzero numbers of all cells of a stripe are summed and go back to each of them. Row maxima give the best count of an A id, and the cell
scores the links of its own chunks, which never left it: both steps read one exchange.

Scale: each text is tokenised once. A cell holds at most a stripe's fair share and at most CELL links, whatever A id they have, so
frequent tokens spread. The counts are bounded by the two vocabularies, not by the corpus. Sums of a document go home as arrays by run.
"""

from __future__ import annotations

import hashlib
import itertools

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keep, text_runs
from .packing import Tokens

BLOCK, CELL = 1 << 23, 1 << 22
_DOCS = 1 << 16  # documents of a run; a document's place in it takes 16 bits
_ZEROS = ("n_a", "n_b", "n_groups", "n_links")


def _byte_characters() -> dict[str, int]:
    """The byte of each character of a byte-level vocabulary: printable bytes stand for themselves, the others, in order, for 256 and up."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = sorted(set(range(256)) - set(own))
    return {chr(b): b for b in own} | {chr(256 + i): b for i, b in enumerate(others)}


_BYTE = _byte_characters()


def byte_level(token: str) -> bytes:
    return bytes(_BYTE[c] for c in token if c in _BYTE)


class _Table:
    """Bytes of each id: all of them in a row, where each begins, and its length."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.concatenate([[0], np.cumsum(self.length)[:-1]]).astype(np.int64)
        self.data = np.frombuffer(b"".join(tokens), np.uint8)

    def joined(self, ids: np.ndarray) -> np.ndarray:
        length = self.length[ids]
        before = np.cumsum(length) - length
        return self.data[np.repeat(self.start[ids] - before, length) + np.arange(int(length.sum()))]


class Pair:
    """The two tokenizers. files: the tokenizer A, the same vocabulary as ranks and its pattern, and the model of B."""

    def __init__(self, path: str, ranks: str | None, pattern: str | None, model: str):
        import sentencepiece

        self.a = Tokens(path, ranks, pattern)
        self.a.tokenizer.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=model)
        entries = self.a.tokenizer.get_vocab()
        names = {i: t for t, i in entries.items()}
        self.n_a, self.n_b = max(names) + 1, self.b.get_piece_size()
        self.bytes_a = _Table([byte_level(names.get(i, "")) for i in range(self.n_a)])
        pieces = [(self.b.id_to_piece(i), self.b.is_byte(i)) for i in range(self.n_b)]
        self.bytes_b = _Table([bytes([int(p[3:5], 16)]) if is_byte else p.replace("▁", " ").encode() for p, is_byte in pieces])
        self.digits = np.array([list(str(i).encode().ljust(8, b"\0")) for i in range(max(self.n_a, self.n_b))], np.uint8)
        self.n_digits = np.count_nonzero(self.digits, 1)

    def encode(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        a = [self.encode_a(" " + t) for t in texts]
        b = [np.array(x, np.int64) for x in self.b.encode(texts, num_threads=1)]
        return a, b

    def encode_a(self, text: str) -> np.ndarray:
        tokens = self.a
        if tokens.encoding is None or tokens.odd.search(text):
            return np.array(tokens.tokenizer.encode(text, add_special_tokens=False).ids, np.int64)
        return tokens.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


_OPEN: dict[tuple, Pair] = {}


def _pair(files: tuple) -> Pair:
    """The tokenizers of a Python worker, kept from one task to the next."""
    if files not in _OPEN:
        _OPEN[files] = Pair(*files)
    return _OPEN[files]


class Aligned:
    """The tokens of a run of texts: n_a, n_b, n_groups, n_links and sha256 of each text, and doc, a, b of each link."""

    def __init__(self, pair: Pair, texts: list[str | None], data: np.ndarray, offsets: np.ndarray):
        """data[offsets[i]:offsets[i + 1]]: the bytes of texts[i]."""
        n = len(texts)
        size = np.diff(offsets)
        some = np.flatnonzero(size > 0)
        ids_a, ids_b = pair.encode([texts[i] for i in some])
        same = [len_a == len_b == size[i] + 1 for i, len_a, len_b in zip(some, (int(pair.bytes_a.length[x].sum()) for x in ids_a), (int(pair.bytes_b.length[x].sum()) for x in ids_b), strict=True)]
        some, ids_a, ids_b = some[same], list(itertools.compress(ids_a, same)), list(itertools.compress(ids_b, same))
        equal = []
        for i, a, b in zip(some, ids_a, ids_b, strict=True):
            text = data[offsets[i] : offsets[i + 1]]
            equal.append(all(x[0] == 32 and np.array_equal(x[1:], text) for x in (pair.bytes_a.joined(a), pair.bytes_b.joined(b))))
        some, ids_a, ids_b = some[equal], list(itertools.compress(ids_a, equal)), list(itertools.compress(ids_b, equal))
        self.n_a, self.n_b = (np.bincount(some, [len(x) for x in ids], n).astype(np.int64) for ids in (ids_a, ids_b))
        self.sha = [""] * n
        self.doc = self.a = self.b = np.zeros(0, np.int64)
        self.n_groups = self.n_links = np.zeros(n, np.int64)
        if not len(some):
            return
        a, b = np.concatenate(ids_a), np.concatenate(ids_b)
        doc_a, doc_b = np.repeat(some, self.n_a[some]), np.repeat(some, self.n_b[some])
        end_a, end_b = np.cumsum(pair.bytes_a.length[a]), np.cumsum(pair.bytes_b.length[b])
        ends = np.zeros(int(end_a[-1]) + 1, np.uint8)  # 1: a token of A ends here, 2: of B
        ends[end_a] = 1
        ends[end_b] += 2
        at = np.flatnonzero(ends)
        in_a, in_b, both = (ends[at] & 1).astype(np.int64), (ends[at] >> 1).astype(np.int64), ends[at] == 3
        of_a, of_b = np.cumsum(in_a) - in_a, np.cumsum(in_b) - in_b  # the tokens that cover what ends here
        self.doc, self.a, self.b = doc_a[of_a], a[of_a], b[of_b]
        self.n_links, self.n_groups = np.bincount(self.doc, minlength=n), np.bincount(self.doc[both], minlength=n)
        group = np.cumsum(both) - both
        group_a, group_b = group[in_a == 1], group[in_b == 1]
        n_groups = int(both.sum())
        before_a = np.concatenate([[0], np.cumsum(np.bincount(group_a, minlength=n_groups))])
        before_b = np.concatenate([[0], np.cumsum(np.bincount(group_b, minlength=n_groups))])
        place_a = np.arange(len(a)) + before_b[group_a]
        place_b = np.arange(len(b)) + before_a[group_b + 1]
        chars = np.zeros((len(a) + len(b), pair.digits.shape[1] + 1), np.uint8)
        chars[place_a, :-1], chars[place_b, :-1] = pair.digits[a], pair.digits[b]
        chars[place_a, -1] = np.where(both[in_a == 1], ord("|"), ord(","))
        chars[place_b, -1] = np.where(both[in_b == 1], ord(";"), ord(","))
        text = chars[chars != 0].tobytes()
        length = np.bincount(doc_a, pair.n_digits[a] + 1, n) + np.bincount(doc_b, pair.n_digits[b] + 1, n)
        edge = np.concatenate([[0], np.cumsum(length[some])]).astype(np.int64)
        for i, first, last in zip(some.tolist(), edge.tolist(), edge[1:].tolist(), strict=False):
            self.sha[i] = hashlib.sha256(text[first : last - 1]).hexdigest()


def _binary(arrays) -> pa.Array:
    return pa.array([x.tobytes() for x in arrays], pa.binary())


def _chunks(links: Aligned, stripes: int, rows: int, n_b: int):
    """Of each stripe: its number, links, distinct pairs as places in its matrix, documents of each, and document and links of each of these."""
    key = ((links.a % stripes * rows + links.a // stripes) * n_b + links.b) * _DOCS + links.doc
    key.sort()
    new = np.flatnonzero(np.append(True, key[1:] != key[:-1])) if len(key) else np.zeros(0, np.int64)
    times, key = np.diff(np.append(new, len(key))), key[new]
    pair, doc = key // _DOCS, key % _DOCS
    stripe = pair // (rows * n_b)
    edge = np.flatnonzero(np.append(True, stripe[1:] != stripe[:-1])) if len(key) else []
    for first, last in zip(edge, [*edge[1:], len(key)], strict=True):
        own = pair[first:last] % (rows * n_b)
        at = np.flatnonzero(np.append(True, own[1:] != own[:-1]))
        yield int(stripe[first]), last - first, own[at].astype("<i4"), np.diff(np.append(at, last - first)).astype("<u2"), doc[first:last].astype("<u2"), times[first:last].astype("<u4")


_ROW = "base long, place int, `{}` long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, stripe int, size long, pairs binary, many binary, docs binary, times binary"


def align(docs: DataFrame, files: tuple, id_col: str = "doc_id", text_col: str = "text", block: int = BLOCK, cell: int = CELL) -> DataFrame:
    """id, n_a, n_b, n_groups, n_links, groups_sha256, n_best, count_sum for each row of docs. files: the arguments of Pair.

    A text that is null or empty, or whose bytes either tokenizer doesn't give back, has no tokens: its numbers are 0 and groups_sha256 is ''.
    Rows are documents of their own whatever their ids: null and repeated ids are kept, and equal rows count as several documents. A text
    of any length is aligned whole. No rows in, no rows out. Other columns are not read.
    """
    n_a, n_b = _pair(files).n_a, _pair(files).n_b
    stripes = max(1, -(-n_a * n_b // block))
    rows = -(-n_a // stripes)
    names = ["base", "place", id_col, *_ZEROS, "groups_sha256", "stripe", "size", "pairs", "many", "docs", "times"]

    def tokenise(batches):
        pair, number = _pair(files), 0
        for batch in batches:
            ids = batch.column("id")
            for first, n, data, offsets in text_runs(batch.column("text"), texts=_DOCS):
                base = (TaskContext.get().partitionId() << 32) + number
                number += 1
                found = Aligned(pair, batch.column("text").slice(first, n).to_pylist(), data, offsets)
                numbers = [pa.array(np.asarray(x, np.int64)) for x in (found.n_a, found.n_b, found.n_groups, found.n_links)]
                lead = [pa.array(np.full(n, base)), pa.array(np.arange(n, dtype=np.int32)), ids.slice(first, n), *numbers, pa.array(found.sha)]
                none = [pa.nulls(n, t) for t in (pa.int32(), pa.int64(), *[pa.binary()] * 4)]
                yield pa.RecordBatch.from_arrays([*lead, *none], names=names)
                chunks = list(_chunks(found, stripes, rows, n_b))
                if chunks:
                    m, (stripe, size, *arrays) = len(chunks), zip(*chunks, strict=True)
                    lead = [pa.array(np.full(m, base)), pa.nulls(m, pa.int32()), *[pa.nulls(m, pa.int64())] * 5, pa.nulls(m, pa.string())]
                    yield pa.RecordBatch.from_arrays([*lead, pa.array(stripe, pa.int32()), pa.array(size, pa.int64()), *map(_binary, arrays)], names=names)

    kept = keep(docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text")).mapInArrow(tokenise, _ROW.format(id_col)), "aligned")
    chunks = kept.where("stripe IS NOT NULL").select("base", "stripe", "size", "pairs", "many", "docs", "times")
    load = dict(chunks.groupBy("stripe").agg(F.sum("size")).collect())  # a row for each stripe at most
    share = max(1, min(cell, -(-sum(load.values()) // stripes)))
    portions = F.array(*(F.lit(max(1, -(-load.get(s, 0) // share))) for s in range(stripes)))
    of_stripe = F.element_at(portions, F.col("stripe") + 1)
    cells = chunks.withColumn("portion", F.pmod(F.xxhash64("base"), of_stripe).cast("int")).drop("size")

    def unpacked(table: pa.Table):
        for pairs, many, docs_, times in zip(*(table.column(c).to_pylist() for c in ("pairs", "many", "docs", "times")), strict=True):
            yield np.frombuffer(pairs, "<i4"), np.frombuffer(many, "<u2"), np.frombuffer(docs_, "<u2"), np.frombuffer(times, "<u4")

    def count(table: pa.Table) -> pa.Table:
        matrix = np.zeros(rows * n_b, np.int64)
        for pairs, many, _, _ in unpacked(table):
            np.add.at(matrix, pairs, many.astype(np.int64))
        held = np.flatnonzero(matrix)
        return pa.table({"stripe": np.full(len(held), table.column("stripe")[0].as_py(), np.int32), "pair": held.astype(np.int32), "n": matrix[held]})

    def score(chunks_: pa.Table, counts_: pa.Table) -> pa.Table:
        matrix = np.zeros(rows * n_b, np.int64)
        matrix[counts_.column("pair").to_numpy()] = counts_.column("n").to_numpy()
        best = matrix.reshape(rows, n_b).max(1)
        out: tuple[list[np.ndarray], ...] = ([], [], [])  # a portion may have no chunk
        for pairs, many, docs_, times in unpacked(chunks_):
            n = matrix[pairs]
            is_best, n, times = np.repeat(n == best[pairs // n_b], many), np.repeat(n, many), times.astype(np.int64)
            sums = np.zeros((2, int(docs_.max()) + 1), np.int64)
            np.add.at(sums[0], docs_, times * is_best)
            np.add.at(sums[1], docs_, times * n)
            here = np.flatnonzero(sums[1])
            for column, values in zip(out, (here.astype("<u2"), sums[0, here].astype("<u4"), sums[1, here].astype("<i8")), strict=True):
                column.append(values)
        return pa.table({"base": chunks_.column("base"), **{name: _binary(x) for name, x in zip(("docs", "n_best", "count_sum"), out, strict=True)}})

    def finish(docs_: pa.Table, sums_: pa.Table) -> pa.Table:
        place = docs_.column("place").to_numpy()
        n_best, count_sum = np.zeros(_DOCS, np.int64), np.zeros(_DOCS, np.int64)
        for at, best, total in zip(*(sums_.column(c).to_pylist() for c in ("docs", "n_best", "count_sum")), strict=True):
            at = np.frombuffer(at, "<u2")
            n_best[at] += np.frombuffer(best, "<u4")
            count_sum[at] += np.frombuffer(total, "<i8")
        return docs_.drop_columns(["base", "place"]).append_column("n_best", pa.array(n_best[place])).append_column("count_sum", pa.array(count_sum[place]))

    cell_key = ["stripe", "portion"]
    partial = cells.groupBy(*cell_key).applyInArrow(count, "stripe int, pair int, n long")
    counts = partial.groupBy("stripe", "pair").agg(F.sum("n").alias("n"))
    sent = counts.withColumn("portion", F.explode(F.sequence(F.lit(0), (of_stripe - 1).cast("int"))))
    sums = cells.groupBy(*cell_key).cogroup(sent.groupBy(*cell_key)).applyInArrow(score, "base long, docs binary, n_best binary, count_sum binary")
    texts = kept.where("stripe IS NULL").select("base", "place", id_col, *_ZEROS, "groups_sha256")
    fields = f"`{id_col}` long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long"
    return texts.groupBy("base").cogroup(sums.groupBy("base")).applyInArrow(finish, fields)
