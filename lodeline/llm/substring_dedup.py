"""Substring dedup by relative Lempel-Ziv parsing: texts are factored greedily against the reference blocks of the whole corpus.

Blocks. In each window of `window` words the least hash of `anchor` consecutive words is its anchor; the longest run of windows with one
anchor is a block, so blocks depend on their words alone and every window lies in one block.

Reference. The reference holds each distinct block once, at its first place in the corpus (document, first word). Where an anchor has
several blocks, their edges differ though windows inside them may be equal, so each window of their first places is looked up among all of
these for its own first place. So a window of a text either is new, and part of the reference itself, or has one place there: that of its
block, or its own.

Parse. A text is read from its first window. At a window that is new, one word is literal. Else a factor starts at the window's place in the
reference and takes words as long as the next window of the text has the next place of the same reference document: as a window has one
place, this is the longest match that the reference gives. The next factor begins behind it. Windows across a factor's edge are judged like all
others, so a factor may start within the words of the one before and then gives only what follows. Factors have at least `window` words
before that cut; they are the duplicate spans: a word is in one if and only if a window over it starts earlier in the corpus.

Exact up to equal 64-bit hashes of different runs of words.

Scale: the text is shuffled once (one exchange serves all uses); else what moves is a small row for each block, about one in eight words. A
task sends only its first place of each block to where the first of all is found, so hot passages and copies meet as one row for each
batch; a batch's other places are joined to the answer, and adaptive execution can split that join's hot keys. No group is collected but
a text's own marks.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import NULL_ID, distinct_texts, own_exchange, ragged, text_runs
from .words import Prefix, grams, mix, split_words, window_minima

WINDOW, ANCHOR = 20, 5
_ROWS = 1 << 20  # of places that a task looks at together
#: at: 32 bits of the anchor, 31 of the first word, and whether the batch has more places of the key.
_PLACES = "t long, k long, key long, at long, first boolean"
_ANCHOR, _START, _MORE = "shiftright(at, 32)", "shiftright(at & 4294967295, 1)", "at & 1"
FACTORS = "array<struct<start:bigint,length:bigint,ref_id:bigint,ref_start:bigint>>"


class _Blocks:
    """Blocks of a run of texts; windows are numbered by their first word."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, window: int, anchor: int):
        self.words = w = split_words(data, offsets)
        self.window = window
        text_end = np.repeat(w.first[1:], w.counts)
        self.windows = np.flatnonzero(np.arange(len(text_end)) + window <= text_end)
        gram = grams(w.hash, anchor)
        self.prefix = Prefix(w.hash)
        at = window_minima(gram, window - anchor + 1)
        at = at[self.windows] if len(self.windows) else np.zeros(0, np.int64)
        new = np.ones(len(at), bool)
        new[1:] = (at[1:] != at[:-1]) | (np.diff(self.windows) != 1)
        self.block = np.cumsum(new) - 1  # of each window
        begin = np.flatnonzero(new)
        last = np.append(begin[1:], len(at))[: len(begin)] - 1
        self.text = np.searchsorted(w.first, self.windows[begin], "right") - 1 if len(begin) else begin
        self.start = self.windows[begin] - w.first[self.text]  # word of the text
        self.anchor = (gram[at[begin]] >> np.uint64(32)).astype(np.uint32).view(np.int32) if len(begin) else np.zeros(0, np.int32)
        self.hash = self.prefix.run(self.windows[begin], self.windows[last] + window).view(np.int64) if len(begin) else np.zeros(0, np.int64)

    def window_hash(self, chosen: np.ndarray) -> np.ndarray:
        at = self.windows[chosen]
        return self.prefix.run(at, at + self.window).view(np.int64)


def _first_like(text: np.ndarray, value: np.ndarray) -> np.ndarray:
    """For each element the first one with the same text and value."""
    _, first, group = np.unique(mix(value.view(np.uint64) ^ mix(text.astype(np.uint64))), return_index=True, return_inverse=True)
    return first[group]


def _place(text: np.ndarray, start: np.ndarray) -> np.ndarray:
    return (text.astype(np.int64) << 32) + start


class _Marks:
    """Places in the reference of some starts of some texts, from a column of marks."""

    def __init__(self, column: pa.Array):
        marks, row = ragged(column)
        starts, self.t, self.k = (x.to_numpy(zero_copy_only=False) for x in marks.flatten())
        self.s = starts & 0xFFFFFFFF
        place = _place(row, starts >> 32)
        self.order = np.argsort(place, kind="stable")
        self.place = place[self.order]

    def find(self, text: np.ndarray, start: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Number of the mark of each (text, start), and whether there is one."""
        if not len(self.place):
            return np.zeros(len(text), np.int64), np.zeros(len(text), bool)
        wanted = _place(text, start)
        at = np.minimum(np.searchsorted(self.place, wanted), len(self.place) - 1)
        return self.order[at], self.place[at] == wanted


class _Homes:
    """Reference places (k, t, s) of the windows of a run of texts, and whether they have one."""

    def __init__(self, n: int):
        self.known = np.zeros(n, bool)
        self.k, self.t, self.s = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)

    def put(self, at: np.ndarray, k: np.ndarray, t: np.ndarray, s: np.ndarray) -> None:
        self.known[at], self.k[at], self.t[at], self.s[at] = True, k, t, s

    def resolve(self, at: np.ndarray, text: np.ndarray, start: np.ndarray, value: np.ndarray, marks: _Marks, first: int, own_k: np.ndarray, own_t: np.ndarray) -> None:
        """Homes of the elements `at`: by their mark, or, for later copies in a text, as their first copy or at it."""
        copy_of = _first_like(text, value)
        mark, marked = marks.find(text[copy_of] + first, start[copy_of])
        self.put(at[marked], marks.k[mark[marked]], marks.t[mark[marked]], marks.s[mark[marked]])
        here = ~marked & (copy_of != np.arange(len(at)))
        self.put(at[here], own_k[text[here]], own_t[text[here]], start[copy_of[here]])


def _places(found: list[tuple[np.ndarray, ...]]) -> pa.RecordBatch:
    """Rows of _PLACES; of the places with one key the first is marked."""
    a, key, k, t, s = (np.concatenate(x) for x in zip(*found, strict=True))
    order = np.lexsort((s, t, k, key))
    new = np.ones(len(order), bool)
    new[1:] = key[order[1:]] != key[order[:-1]]
    first, more = np.zeros(len(order), bool), np.zeros(len(order), np.int64)
    first[order] = new
    more[order[:-1]] = ~new[1:]
    at = (a.astype(np.int64) << 32) | (s.astype(np.int64) << 1) | more
    return pa.RecordBatch.from_arrays([*(pa.array(x.astype(np.int64)) for x in (t, k, key, at)), pa.array(first)], names=["t", "k", "key", "at", "first"])


def _reference(places: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The first place of each key (never null; said so that all uses share one exchange) as a, t, k, s, and a mark (t, k, starts, ht, hk; starts: the first words here and there) for all others."""
    every = W.partitionBy("key")
    place = F.struct("k", "t", F.expr(_START).alias("s"))
    firsts = places.where("first AND key IS NOT NULL").select("t", "k", "key", "at").withColumn("home", F.min(place).over(every)).withColumn("more", F.max(F.expr(_MORE)).over(every))
    index = firsts.where(place == F.col("home"))
    others = places.where("NOT first").select("t", "k", "key", "at").join(own_exchange(index.where("more = 1").select("key", "home"), "key"), "key")
    mark = ["t", "k", F.expr(f"shiftleft({_START}, 32) | home.s AS starts"), F.col("home.t").alias("ht"), F.col("home.k").alias("hk")]
    return index.selectExpr(f"{_ANCHOR} AS a", "t", "k", f"{_START} AS s"), firsts.where(place != F.col("home")).select(*mark).unionByName(others.select(*mark))


def _gathered(marks: DataFrame, *lists: Column) -> DataFrame:
    """Lists of marks for each text. The marks are dealt as flat rows, which are smaller than lists of some of them."""
    return marks.repartition("k", "t").groupBy("k", "t").agg(*lists)


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", window: int = WINDOW, anchor: int = ANCHOR, keep_text: bool = False) -> DataFrame:
    """Remove each word that a window covers whose words also start earlier (smaller id, or same text further left).

    Returns id, n_words, n_removed, kept_sha256 (of the kept words joined by one space), spans (array of removed word ranges [start, end)),
    factors (the parse: words [start, start + length) stand at word ref_start of document ref_id; what is between factors is literal) and
    with keep_text the kept words as kept_text. A null or empty text has no words. A null id comes before all others. Rows with equal ids
    and texts are alike; rows with equal ids (or without) and other texts are documents of their own, in the order of a hash of their texts. An
    empty table gives no rows. Other columns are not read.
    """
    placed = distinct_texts(docs, id_col, text_col)

    def owners(batch):
        return batch.column("k").to_numpy(), batch.column("t").to_numpy()

    def block_places(batches):
        for batch in batches:
            (k, t), found, held = owners(batch), [], 0
            for first, _, data, offsets in text_runs(batch.column("text")):
                b = _Blocks(data, offsets, window, anchor)
                own = np.flatnonzero(_first_like(b.text, b.hash) == np.arange(len(b.hash)))
                text = b.text[own] + first
                found.append((b.anchor[own], b.hash[own], k[text], t[text], b.start[own]))
                held += len(own)
                if held > _ROWS:
                    yield _places(found)
                    found, held = [], 0
            if found:
                yield _places(found)

    def chosen_windows(b: _Blocks, first: int, marks: _Marks, branched: _Marks) -> np.ndarray:
        """Windows of blocks that stand first here and whose anchor has several blocks."""
        own = _first_like(b.text, b.hash) == np.arange(len(b.hash))
        new = own & ~marks.find(b.text + first, b.start)[1] & branched.find(b.text + first, b.start)[1]
        return np.flatnonzero(new[b.block]) if len(new) else b.block

    def window_places(batches):
        for batch in batches:
            (k, t), found, held = owners(batch), [], 0
            marks, branched = _Marks(batch.column("marks")), _Marks(batch.column("branched"))
            if not len(branched.place):
                continue
            for first, _, data, offsets in text_runs(batch.column("text")):
                b = _Blocks(data, offsets, window, anchor)
                chosen = chosen_windows(b, first, marks, branched)
                value, text = b.window_hash(chosen), b.text[b.block[chosen]]
                own = np.flatnonzero(_first_like(text, value) == np.arange(len(text)))
                at, text = chosen[own], text[own]
                found.append((b.anchor[b.block[at]], value[own], k[text + first], t[text + first], b.windows[at] - b.words.first[text]))
                held += len(own)
                if held > _ROWS:
                    yield _places(found)
                    found, held = [], 0
            if found:
                yield _places(found)

    def homes(b: _Blocks, first: int, k: np.ndarray, t: np.ndarray, marks: _Marks, branched: _Marks, wmarks: _Marks) -> _Homes:
        """The reference place of every window of a run."""
        of_block, out = _Homes(len(b.hash)), _Homes(len(b.windows))
        of_block.resolve(np.arange(len(b.hash)), b.text, b.start, b.hash, marks, first, k, t)
        if len(b.block):
            begin = b.windows - (b.words.first[b.text] + b.start)[b.block]
            out.known, out.k, out.t, out.s = of_block.known[b.block], of_block.k[b.block], of_block.t[b.block], of_block.s[b.block] + begin
        chosen = chosen_windows(b, first, marks, branched)
        text = b.text[b.block[chosen]]
        out.resolve(chosen, text, b.windows[chosen] - b.words.first[text], b.window_hash(chosen), wmarks, first, k, t)
        return out

    def cut(batches):
        for batch in batches:
            keys, ties = owners(batch)
            marks, branched, wmarks = (_Marks(batch.column(c)) for c in ("marks", "branched", "wmarks"))
            out: dict[str, list] = {"n_words": [], "n_removed": [], "kept_sha256": [], "spans": [], "kept_text": []}
            factors: list[np.ndarray] = [np.zeros((5, 0), np.int64)]  # text, start, length, ref_id, ref_start
            for first, n, data, offsets in text_runs(batch.column("text")):
                b = _Blocks(data, offsets, window, anchor)
                w, h = b.words, homes(b, first, keys[first : first + n], ties[first : first + n], marks, branched, wmarks)
                copied = np.flatnonzero(h.known)
                begins = np.ones(len(copied), bool)
                x, y = copied[1:], copied[:-1]
                begins[1:] = (b.windows[x] != b.windows[y] + 1) | (h.k[x] != h.k[y]) | (h.t[x] != h.t[y]) | (h.s[x] != h.s[y] + 1)
                head = copied[begins]
                lo, hi = b.windows[head], b.windows[copied[np.append(begins[1:], True)[: len(begins)]]] + window
                text = b.text[b.block[head]] if len(head) else head
                behind = np.zeros(len(head), np.int64)
                behind[1:] = np.where(text[1:] == text[:-1], hi[:-1], 0)
                start = np.maximum(lo, behind)
                factors.append(np.array([text + first, start - w.first[text], hi - start, h.k[head], h.s[head] + start - lo]))
                step = np.zeros(len(w.hash) + 1, np.int64)
                np.add.at(step, start, 1)
                np.add.at(step, hi, -1)
                gone = np.cumsum(step[:-1]) > 0
                kept = np.flatnonzero(~gone)
                text = w.text
                head = np.ones(len(kept), bool)
                head[1:] = text[kept[1:]] != text[kept[:-1]]
                mark = np.zeros(len(data) + 1, np.int64)
                lead = w.start[kept] - ~head  # with the white space before it, but for a text's first
                np.add.at(mark, lead, 1)
                np.add.at(mark, w.end[kept], -1)
                mask = np.cumsum(mark[:-1]) > 0
                copy = data.copy()
                copy[lead[~head]] = 0x20
                out_bytes = copy[mask].tobytes()
                ends = np.append(0, np.cumsum(mask))[offsets] if len(data) else np.zeros(len(offsets), np.int64)
                removed = np.append(0, np.cumsum(gone))[w.first]
                turn = np.flatnonzero(np.diff(np.concatenate([[0], gone.astype(np.int8), [0]])))
                out["n_words"].append(w.counts)
                out["n_removed"].append(np.diff(removed))
                for i in range(len(offsets) - 1):
                    piece = out_bytes[ends[i] : ends[i + 1]]
                    out["kept_sha256"].append(hashlib.sha256(piece).hexdigest())
                    if keep_text:
                        out["kept_text"].append(piece.decode())
                    if removed[i + 1] == removed[i]:
                        out["spans"].append([])
                        continue
                    lo, hi = w.first[i], w.first[i + 1]
                    edge = turn[np.searchsorted(turn, lo, "right") : np.searchsorted(turn, hi)]
                    edge = np.concatenate([[lo] if gone[lo] else [], edge, [hi] if gone[hi - 1] else []]).astype(np.int64) - lo
                    out["spans"].append(edge.tolist())
            count = lambda x: pa.array(np.concatenate(x), pa.int64()) if x else pa.array([], pa.int64())
            of, start, length, ref, ref_start = np.concatenate(factors, 1)
            ref = pa.array(ref, mask=ref == NULL_ID)
            listed = pa.ListArray.from_arrays(pa.array(np.searchsorted(of, np.arange(batch.num_rows + 1)), pa.int32()), pa.StructArray.from_arrays([pa.array(start), pa.array(length), ref, pa.array(ref_start)], ["start", "length", "ref_id", "ref_start"]))
            ids = pa.array(keys, mask=keys == NULL_ID)
            columns = [ids, batch.column("copies"), count(out["n_words"]), count(out["n_removed"]), pa.array(out["kept_sha256"], pa.string()), pa.array(out["spans"], pa.list_(pa.int64())), listed]
            names = [id_col, "copies", "n_words", "n_removed", "kept_sha256", "spans", "factors"]
            if keep_text:
                columns, names = [*columns, pa.array(out["kept_text"], pa.string())], [*names, "kept_text"]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    index, repeats = _reference(placed.mapInArrow(block_places, _PLACES))
    several = index.groupBy("a").agg(F.count("*").alias("n")).where("n > 1").select("a")
    branching = index.join(own_exchange(several, "a"), "a").selectExpr("t", "k", "shiftleft(s, 32) AS starts", "0L AS ht", "0L AS hk")
    either = repeats.withColumn("b", F.lit(False)).unionByName(branching.withColumn("b", F.lit(True)))
    mark = F.struct("starts", "ht", "hk")
    marks = _gathered(either, F.collect_list(F.when(~F.col("b"), mark)).alias("marks"), F.collect_list(F.when(F.col("b"), mark)).alias("branched"))
    parsed = placed.join(marks, ["k", "t"], "left")
    wmarks = _gathered(_reference(parsed.mapInArrow(window_places, _PLACES))[1], F.collect_list(mark).alias("wmarks"))
    fields = f"`{id_col}` long, copies long, n_words long, n_removed long, kept_sha256 string, spans array<long>, factors {FACTORS}" + ", kept_text string" * keep_text
    found = parsed.join(wmarks, ["k", "t"], "left").mapInArrow(cut, fields)
    return found.withColumn("copies", F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies")))).drop("copies")
