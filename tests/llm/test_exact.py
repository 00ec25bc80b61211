"""Operators with exact results against brute force, over texts with nulls, blanks, repeats, ties and clashing column names."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodeline.llm import cells, line_dedup, mixing, ngram_join, packing, substring_dedup, topk
from lodeline.llm.common import keep
from lodeline.llm.queries import queries, tokenizer_files

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, k long, n_words long, size long, th string"


def corpus(seed=0):
    """About 130 rows: passages shared in several surroundings, near and exact copies, a hot group, repeats in a text, odd texts."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(60)] + ["É", "x y", "日本"]
    say = lambda n: [rng.choice(words) for _ in range(n)]
    passage, base = say(50), say(120)
    texts = [None, "", "  \n\t ", "one", "Two words", "two WORDS", "a b c", "x " * 70, " ".join(say(25) * 3), "\n".join(" ".join(say(6)) for _ in range(400))]
    for _ in range(12):
        texts.append(" ".join(say(rng.randint(0, 30)) + passage[rng.randint(0, 10) : rng.randint(35, 50)] + say(rng.randint(0, 30))))
    for _ in range(40):
        near = list(base)
        for _ in range(rng.randint(0, 6)):
            near[rng.randrange(len(near))] = rng.choice(words)
        texts.append(" ".join(near))
    texts += [" ".join(base)] * 30
    for _ in range(20):
        texts.append("\n".join(rng.choice([" ".join(passage[i * 8 : i * 8 + 8]) for i in range(6)] + ["", " ", "end."]) for _ in range(rng.randint(1, 14))))
    for _ in range(15):
        texts.append(" ".join(say(rng.randint(3, 14))))
    rows = [(i * 3 % 997, t, rng.choice(["s1", "s2", None, "z"]) if rng.random() > 0.4 else "s1", 5, 6, 7, "q") for i, t in enumerate(texts)]
    return rows


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(corpus(), SCHEMA).repartition(5).cache()


def repeats(rows, window=20):
    first, out = {}, {}
    for i, t in sorted(rows):
        words = WORD.findall(t or "")
        gone = set()
        for at in range(len(words) - window + 1):
            if first.setdefault(tuple(words[at : at + window]), (i, at)) != (i, at):
                gone.update(range(at, at + window))
        out[i] = len(words), len(gone), hashlib.sha256(" ".join(w for j, w in enumerate(words) if j not in gone).encode()).hexdigest()
    return out


def test_substring_dedup(docs):
    got = substring_dedup.remove_repeats(docs, keep_text=True).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, r.kept_sha256) for r in got} == repeats([(r[0], r[1]) for r in corpus()])
    assert all(sum(b - a for a, b in zip(r.spans[::2], r.spans[1::2])) == r.n_removed for r in got)
    assert all(hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 for r in got)


def test_factors_rebuild_the_texts(docs):
    """Each factor stands at its earlier place in the reference, factors don't overlap, none goes on where the one before ends there."""
    words, n = {r[0]: WORD.findall(r[1] or "") for r in corpus()}, 0
    for r in substring_dedup.remove_repeats(docs).collect():
        own, at, reference, copied = words[r.doc_id], 0, None, []
        for f in r.factors:
            assert f.length > 0 and f.start >= at and (f.ref_id, f.ref_start) < (r.doc_id, f.start)
            assert words[f.ref_id][f.ref_start : f.ref_start + f.length] == own[f.start : f.start + f.length]
            assert f.start > at or (f.ref_id, f.ref_start) != reference
            at, reference = f.start + f.length, (f.ref_id, f.ref_start + f.length)
            copied += range(f.start, at)
            n += f.length >= 20
        assert copied == [j for a, b in zip(r.spans[::2], r.spans[1::2]) for j in range(a, b)]
    assert n > 60


def test_substring_dedup_edges(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(None, text), (1, text), (1, text), (2, text + " more"), (3, None)]
    got = [(r.doc_id, r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, 30, 0), (1, 30, 30), (1, 30, 30), (2, 31, 30), (3, 0, 0)], key=str)
    one = "a " * 40 + text
    again = substring_dedup.remove_repeats(spark.createDataFrame([(5, one), (5, text), (5, "b " + text), (None, one), (None, text)], "doc_id long, text string")).collect()
    assert sum(r.n_words - r.n_removed for r in again) == 1 + 30 + 1 and sorted(r.n_words for r in again) == [30, 30, 31, 70, 70]  # one a, text once, b
    assert substring_dedup.remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def shingle_set(text, size):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return frozenset(tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))) if words else frozenset()


def plain_components(rows, size, percent):
    sets = {i: shingle_set(t, size) for i, t in rows}
    label = {i: i for i in sets}
    root = lambda i: i if label[i] == i else root(label[i])
    ids = sorted(sets)
    for n, i in enumerate(ids):
        for j in ids[:n]:
            a, b = sets[i], sets[j]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                x, y = sorted((root(i), root(j)))
                label[y] = x
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize(("size", "percent"), [(3, 90), (5, 80), (1, 60)])
@pytest.mark.parametrize("members", [2048, 9])
def test_ngram_join(docs, size, percent, members):
    got = ngram_join.join_components(docs, size=size, percent=percent, members=members, group=64, pivots=2).collect()
    assert {r.doc_id: (r.n_shingles, r.component_id) for r in got} == plain_components([(r[0], r[1]) for r in corpus()], size, percent)


def test_ngram_join_edges(spark):
    text = " ".join(f"t{i}" for i in range(30))
    rows = [(None, text), (4, text + " z"), (5, None), (6, "a b"), (7, "A  B"), (7, "A  B"), (8, "")]
    got = sorted(map(tuple, ngram_join.join_components(spark.createDataFrame(rows, "doc_id long, text string")).collect()), key=str)
    assert got == sorted([(None, 28, None), (4, 29, None), (5, 0, 5), (6, 1, 6), (7, 1, 6), (7, 1, 6), (8, 0, 8)], key=str)
    assert ngram_join.join_components(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def near_copies(n, words=300, seed=5):
    rng = random.Random(seed)
    base = [f"b{i}" for i in range(words)]
    for i in range(n):
        own = list(base)
        for _ in range(rng.randint(1, 2)):
            own[rng.randrange(words)] = f"x{i}-{rng.randrange(10**6)}"
        yield " ".join(own)


def kept_rows(monkeypatch):
    """Rows of the blocks that ngram_join deals out, in both rounds, and the texts that are shuffled for them, by the tables it keeps."""
    found = {}

    def keep(df, tag, plain=cells.keep):
        out = plain(df, tag)
        if tag in ("blocks", "second-round", "texts"):
            found[tag] = found.get(tag, 0) + out.count()
        if tag == "cells":
            found["members"] = out.select("k", "th").distinct().count()
        return out

    monkeypatch.setattr(cells, "keep", keep)
    monkeypatch.setattr(ngram_join, "keep", keep)
    return found


def test_only_texts_in_cells_are_shuffled(spark, monkeypatch):
    """Of texts that are mostly alone, those of the cells are found by the filter of their keys, once for both rounds."""
    texts = [*near_copies(300), *(" ".join(f"q{i}-{j}" for j in range(40)) for i in range(3000))]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    let_through = []

    def passing(*args, plain=cells.passing):
        out = plain(*args)
        let_through.append(out.count())
        return out

    monkeypatch.setattr(ngram_join, "passing", passing)
    found = kept_rows(monkeypatch)
    got = ngram_join.join_components(docs, members=64, pivots=4).collect()
    assert len(got) == 3300 and {r.component_id for r in got if r.doc_id < 300} == {0} and all(r.component_id == r.doc_id for r in got if r.doc_id >= 300)
    assert found["second-round"] >= 0 and found["texts"] == found["members"] == 300 and len(let_through) == 1 and let_through[0] < 330


def test_a_filter_takes_all_its_keys(spark):
    rng = random.Random(8)
    keys = [rng.randrange(-(2**63), 2**63) for _ in range(5000)]
    rows = spark.createDataFrame([(k,) for k in [*keys, *(rng.randrange(2**62) for _ in range(20000))]], "key long").repartition(7)
    sent = cells.key_filter(rows.limit(1).union(spark.createDataFrame([(k,) for k in keys], "key long")), "key", len(keys))
    passed = {r.key for r in cells.passing(rows, "key", sent).collect()}
    assert set(keys) <= passed and len(passed) < 5300
    assert cells.passing(rows, "key", cells.key_filter(rows.where("key is null"), "key", 0)).count() == 0


def test_rows_follow_near_copies(spark, monkeypatch):
    """Twice as many near copies of one text, in cells of many blocks, are twice as many rows, not four times."""
    rows = []
    for n in (600, 1200, 2400):
        docs = spark.createDataFrame(list(enumerate(near_copies(n))), "doc_id long, text string")
        found = kept_rows(monkeypatch)
        got = ngram_join.join_components(docs, members=128, pivots=8).collect()
        assert len(got) == n and {r.component_id for r in got} == {0}
        rows.append(sum(found.values()))
        monkeypatch.undo()
    assert rows[1] < 2.3 * rows[0] and rows[2] < 2.3 * rows[1] and rows[2] < 4 * 2400


def test_shared_ids_are_rows_of_their_own(spark, monkeypatch):
    """Rows without an id and rows that share one: each text meets its own class only."""
    texts = list(near_copies(300)) + [f"own {i} {i * 7} " + " ".join(f"q{i}-{j}" for j in range(30)) for i in range(1200)]
    for number in (None, 7):
        docs = spark.createDataFrame([(number, t) for t in texts] + [(number, texts[0])] * 500, "doc_id long, text string")
        found = kept_rows(monkeypatch)
        rows = ngram_join.row_components(docs).collect()
        assert len(rows) == 2000 and len({(r.ck, r.cth) for r in rows}) == 1201 and found["blocks"] < 2 * 300
        assert sum((r.k, r.th) == (r.ck, r.cth) for r in rows) in (1201, 1701)  # the repeated row may be its component's least
        monkeypatch.undo()


def test_runs_of_index_rows_keep_their_components():
    rng = np.random.default_rng(6)

    def parts(key, c):
        label = {("c", x): ("c", x) for x in c.tolist()}
        root = lambda x: x if label.setdefault(x, x) == x else root(label[x])
        for k, x in zip(key.tolist(), c.tolist(), strict=True):
            label[root(("k", k))] = root(("c", x))
        groups = {}
        for x in set(c.tolist()):
            groups.setdefault(root(("c", x)), set()).add(x)
        return sorted(map(sorted, groups.values()))

    for n, keys in ((0, 1), (1, 1), (50, 1), (60, 500), (3000, 2500), (3000, 40)):
        key, c = rng.integers(0, keys, n).astype(np.uint64), rng.integers(-(2**62), 2**62, max(1, n // 3))[rng.integers(0, max(1, n // 3), n)]
        of, got = ngram_join.joined_runs(key, c)
        own = of < keys  # other keys are those of joined pairs
        assert parts(key, c) == parts(of, got)
        assert sorted(of[own].tolist()) == sorted(set(key.tolist())) or (n and len(of) == n)


@pytest.mark.parametrize("percent", [60, 80, 90])
def test_linked_sets_share_a_segment(percent):
    rng, bands = np.random.default_rng(percent), ngram_join.Bands(percent)
    for n in [*range(1, 60), 100, 333, 700]:
        x = rng.integers(0, 2**63, n, dtype=np.uint64)
        for _ in range(4):
            drop, add = rng.integers(0, n // 4 + 2), rng.integers(0, n // 4 + 2)
            y = np.concatenate([x[min(drop, n - 1) :], rng.integers(0, 2**63, add, dtype=np.uint64)])
            both = len(np.intersect1d(x, y))
            text = np.repeat([0, 1], [len(x), len(y)])
            of, key = ngram_join.segment_keys(text, np.concatenate([np.sort(x), np.sort(y)]), 2, bands)
            if 100 * both >= percent * (len(x) + len(y) - both) and both < max(len(x), len(y)):
                assert set(key[of == 0].tolist()) & set(key[of == 1].tolist())


def plain_lines(rows, length=3, long_words=20):
    first, later = {}, {}
    for i, t in sorted(rows):
        full = [(p, x) for p, x in enumerate((t or "").split("\n")) if x.strip(" ")]
        for at in range(len(full)):
            for n in {length, 1}:
                run = full[at : at + n]
                if len(run) == n and (n == length or len(WORD.findall(run[0][1])) >= long_words) and first.setdefault(tuple(x for _, x in run), (i, at)) != (i, at):
                    later.setdefault(i, []).append((at, n, run[0][0], run[-1][0]))
    out = {}
    for i, t in rows:
        gone, last = set(), 0
        spans = []
        for at, n, s, e in sorted(later.get(i, [])):
            if spans and at <= last:
                spans[-1] = spans[-1][0], max(spans[-1][1], e)
            else:
                spans.append((s, e))
            last = max(last, at + n)
        for s, e in spans:
            gone.update(range(s, e + 1))
        lines = t.split("\n") if t is not None else []
        out[i] = len(lines), len(gone), None if t is None else "\n".join(x for p, x in enumerate(lines) if p not in gone)
    return out


def test_line_dedup(docs):
    rows = [(r[0], r[1]) for r in corpus()]
    got = line_dedup.remove_repeated_lines(docs)
    assert got.columns == [*docs.columns, "n_lines", "n_removed", "removed_runs"]
    assert {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in got.collect()} == plain_lines(rows)


def full_lines():
    return {r[0]: [x for x in (r[1] or "").split("\n") if x.strip(" ")] for r in corpus()}


def test_line_matches_are_extended(docs):
    """Lines of a match equal those of an earlier place, as far as the lines that a run can reach agree; all later runs lie in matches."""
    lines, covered = full_lines(), {}
    first = {}
    for i in sorted(lines):
        for at in range(len(lines[i])):
            for n in (1, 3):
                if at + n <= len(lines[i]) and (n == 3 or len(WORD.findall(lines[i][at])) >= 20):
                    first.setdefault(tuple(lines[i][at : at + n]), (i, at))
    found = line_dedup.matches(docs).collect()
    longer = 0
    for m in found:
        own, there, at, ref, n = lines[m.k], lines[m.ref.k], m.i - 1, m.ref.i - 1, m.lines
        assert n in (1, 3) and m.n >= n and (m.ref.k, ref) < (m.k, at) and own[at : at + m.n] == there[ref : ref + m.n]
        if n == 3 and m.n < 5:  # less than the whole reach of a fingerprint
            ends = [at == 0 or ref == 0 or own[at - 1] != there[ref - 1], at + m.n == len(own) or ref + m.n == len(there) or own[at + m.n] != there[ref + m.n]]
            assert any(ends)
        longer += m.n > n
        covered.setdefault(m.k, set()).update((j, n) for j in range(at, at + m.n - n + 1))
    for i, own in lines.items():
        for at in range(len(own)):
            for n in (1, 3):
                run = tuple(own[at : at + n])
                if first.get(run, (i, at)) != (i, at) and len(run) == n:
                    assert (at, n) in covered[i]
    assert longer and sum(m.lines == 3 for m in found) > 5 and any(m.lines == 1 for m in found)


def test_joined_positions_are_fingerprints(spark, docs):
    """What is joined is positions: no more rows than fingerprints, and fewer than lines; also where one line is a tenth of all."""
    rng = random.Random(12)
    passage = [f"passage {i} of some length" for i in range(40)]
    texts = ["\n".join(x for i in range(30) for x in ("common line", f"own {n} {i} {rng.random()}", f"other {n} {i}")) for n in range(60)]
    texts += ["\n".join([f"head {n}", *passage[n % 7 : 10 + n % 20], f"tail {n}"]) for n in range(120)]
    hot = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for rows in (docs, hot):
        prints = keep(line_dedup.fingerprints(rows), "prints")
        joined, n_lines = line_dedup.positions(prints).count(), rows.selectExpr("explode(split(text, '\n')) AS x").where("trim(x) <> ''").count()
        assert 0 < joined <= prints.count() < n_lines
    assert {r.doc_id: r.text for r in line_dedup.remove_repeated_lines(hot).collect()} == {i: x[2] for i, x in plain_lines(list(enumerate(texts))).items()}


def test_a_text_of_many_lines(spark):
    """A text of 30,000 lines, most of which stand earlier in it or in another."""
    rng = random.Random(5)
    block = [f"line {i} {rng.random()}" for i in range(10_000)]
    rows = [(1, "\n".join(block)), (2, "\n".join(["new", *block, "x", *block[5000:], "y", *block[:5000]])), (3, "z" * (1 << 20) + "\n" + "\n".join(block[7:9]))]
    got = {r.doc_id: (r.n_lines, r.n_removed, r.text) for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == plain_lines(rows) and got[2][2] == "new\nx\ny"


@pytest.mark.parametrize(("shingle", "width"), [(1, 3), (2, 2), (3, 4)])
def test_equal_runs_share_a_fingerprint(docs, shingle, width):
    lines, length = full_lines(), shingle + width - 1
    chosen, runs = {}, 0
    for r in line_dedup.fingerprints(docs, shingle=shingle, width=width).collect():
        assert r.low <= r.first <= r.last and r.last + r.n <= r.low + len(r.around)
        for start in range(r.first, r.last + 1):
            own = tuple(lines[r.k][start - 1 : start - 1 + r.n])
            assert r.n in (1, length) and 0 <= r.at - start < width and chosen.setdefault((own, r.n), (r.g, r.at - start)) == (r.g, r.at - start)
            runs += 1
    long = sum(len(WORD.findall(line)) >= 20 for x in lines.values() for line in x)
    assert long and runs == long + sum(max(0, len(x) - length + 1) for x in lines.values())


def test_line_dedup_other_widths(docs):
    rows = [(r[0], r[1]) for r in corpus()]
    got = line_dedup.remove_repeated_lines(docs, shingle=2, width=2).collect()
    assert {r.doc_id: r.text for r in got} == {i: x[2] for i, x in plain_lines(rows).items()}


def test_line_dedup_edges(spark):
    rows = [(None, "a\nb\nc"), (1, "a\nb\nc\nd"), (1, "a\nb\nc\nd"), (2, "q\nq\nq\nq\nq"), (3, None)]
    got = [(r.doc_id, r.text) for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    assert sorted(got, key=str) == sorted([(None, "a\nb\nc"), (1, "d"), (1, "d"), (2, "q"), (3, None)], key=str)


def test_line_dedup_long_lines(spark):
    """A line of 20 words goes where it stands earlier, whatever its neighbours; one of 19 doesn't, alone or in a pair."""
    long, other, short = (" ".join(f"{c}{i}" for i in range(n)) for c, n in (("w", 20), ("v", 60), ("u", 19)))
    rows = [
        (1, f"a\n{long}\nb"),
        (2, f"c\n{long}\nd"),
        (3, long),
        (4, f"{short}\ne"),
        (5, f"{short}\ne"),
        (6, f"{other}\n \n{long}\nf"),
        (7, f"g\n{other}\n \n{long}\nf\nh"),
        (8, f"{other}\n{other}\n{short}"),
        (9, long.replace(" ", "\u00a0")),
        (10, long.replace(" ", "\u00a0")),
        (None, f"{long}\nnone"),
        (None, f"{long}\nnil"),
    ]
    got = [(r.doc_id, r.text, r.n_removed) for r in line_dedup.remove_repeated_lines(spark.createDataFrame(rows, "doc_id long, text string")).collect()]
    by_id = {i: (t, n) for i, t, n in got if i is not None}
    assert by_id == {i: (t, n) for i, (_, n, t) in plain_lines([(-1, f"{long}\nnone"), *(r for r in rows if r[0] is not None)]).items() if i > 0}
    assert [by_id[i][1] for i in range(1, 11)] == [1, 1, 1, 0, 0, 1, 4, 2, 0, 0]
    assert sorted(n for i, _, n in got if i is None) == [0, 1]


def test_line_dedup_single(spark, tmp_path):
    """Repeated single lines and pairs, and documents of one or two lines, which runs of three lines don't reach."""
    long = "a line of more than ten words that stands in several documents alone"
    rows = [(1, long), (2, long), (3, "p\nq"), (4, "p\n \nq"), (5, f"x\n{long}\ny\nz"), (6, "r\nr\ns"), (7, None), (8, ""), *((i + 10, t) for i, t, *_ in corpus())]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r.doc_id: (r.n_lines, r.n_removed, r.kept_sha256) for r in queries()["op8_line_dedup_single"](spark, str(tmp_path)).collect()}
    expected = {i: (n, gone, None if t is None else hashlib.sha256(t.encode()).hexdigest()) for i, (n, gone, t) in plain_lines(rows, 1).items()}
    assert got == expected and [got[i][1] for i in range(1, 9)] == [0, 1, 0, 3, 1, 1, 0, 0]


def test_mixing(docs):
    rows = mixing.mix(docs, block=4, shard_docs=20).collect()
    again = mixing.mix(docs, block=4, shard_docs=20).collect()
    assert sorted(rows) == sorted(again) and len(rows) == docs.count()
    texts = {r[0]: r for r in corpus()}
    assert all(r.size == len(WORD.findall(texts[r.doc_id][1] or "")) and r.taken <= 2 * r.size for r in rows)
    by = {}
    for r in rows:
        own = by.setdefault(texts[r.doc_id][2], [0, 0, r.target, r.source_size])
        own[0] += r.size
        own[1] += r.taken
    order = sorted((s for s in by if s is not None), key=lambda s: s.encode()) + [None] * (None in by)
    weight = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, left, open_ = {}, 1.5 * sum(x[0] for x in by.values()), set(by)
    while open_:
        rate = left / sum(weight[s] for s in open_)
        full = {s for s in open_ if 2 * by[s][0] <= rate * weight[s]}
        if not full:
            target |= {s: rate * weight[s] for s in open_}
            break
        target |= {s: 2 * by[s][0] for s in full}
        left -= sum(2 * by[s][0] for s in full)
        open_ -= full
    for s, (size, taken, given, source_size) in by.items():
        assert source_size == size and given == pytest.approx(target[s]) and abs(taken - given) <= 4 * 8


def test_apportionment_is_sainte_lague(spark):
    shards = [[50.0, 1.3, 7.7, 23.0, 0.0, 18.0], [1.5, 1.5, 1.5, 1.4], [0.4] * 7, [0.0]]
    for block in (1, 3, 7):
        table = spark.createDataFrame([(str(i), n, c) for n, claims in enumerate(shards) for i, c in enumerate(claims)], "name string, shard int, claim double")
        got = {(r.shard, r.name): r.quota for r in mixing.apportion(table, "claim", block).collect()}
        for n, claims in enumerate(shards):
            seats = [0] * len(claims)
            for _ in range(int(sum(claims) / block + 0.5)):
                seats[max(range(len(claims)), key=lambda i: (claims[i] / (2 * seats[i] + 1), -i))] += 1
            assert [got[n, str(i)] for i in range(len(claims))] == seats


def test_mixing_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert mixing.mix(empty).count() == 0 and mixing.mixed_documents(empty).count() == 0
    odd = spark.createDataFrame([(1, None, None, 0, 0, 0, ""), (None, "a b", None, 0, 0, 0, ""), (None, "a b", None, 0, 0, 0, "")], SCHEMA)
    assert [(r.size, r.source_size) for r in mixing.mix(odd).orderBy("size").collect()] == [(0, 4), (2, 4), (2, 4)]
    assert mixing.mixed_documents(odd).columns == odd.columns


def test_mixing_shared_ids(spark):
    """Rows without an id, or with one id, spread over the shards by their texts."""
    for number in (None, 3):
        docs = spark.createDataFrame([(number, f"a{i} b c", "s") for i in range(2000)] + [(number, "same text", "s")] * 300, "doc_id long, text string, source string")
        rows = mixing.mix(docs, shard_docs=50).collect()
        assert len(rows) == 2300 and sum(r.size for r in rows) == 6600 and 9700 <= sum(r.taken for r in rows) <= 10100
        part = sum(0 < r.taken % r.size for r in rows)
        assert 20 <= part <= 46  # at most one of each shard


def test_packing(docs):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(tokenizer_files()[0])
    pieces = packing.pack(docs, tokenizer_files(), window=256, group_tokens=4096).collect()
    by_doc, by_window = {}, {}
    for p in pieces:
        by_doc.setdefault(p.doc_id, []).append(p)
        by_window.setdefault(p.sequence_id, []).append(p)
    for i, t, *_ in corpus():
        ids = np.array(tokenizer.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        at = 0
        for p in sorted(by_doc[i], key=lambda p: p.start):
            assert (p.start, p.doc_tokens) == (at, len(ids)) and p.ids_crc32 == zlib.crc32(ids[at : at + p.length].tobytes())
            at += p.length
        assert at == len(ids)
    for own in by_window.values():
        at = 0
        for p in sorted(own, key=lambda p: p.offset):
            assert p.offset == at
            at += p.length
        assert at <= 256
    tokens = sum(p.length for p in pieces)
    assert len(by_window) * 256 < 1.1 * tokens + 256


def test_differencing():
    rng = random.Random(3)
    for k in (1, 2, 5, 9):
        sizes = [rng.randint(1, 60) for _ in range(70)]
        parts = packing.differencing(sizes, k)
        assert sorted(i for p in parts for i in p) == list(range(70)) and len(parts) == k
        sums = [sum(sizes[i] for i in p) for p in parts]
        assert max(sums) - min(sums) <= 3
    assert all(sum(s) <= 64 for s in ([[40, 30, 30][i] for i in p] for p in packing.windows([40, 30, 30], 64)))
    assert packing.windows([]) == []


def test_ranks_give_the_ids_of_the_tokenizer():
    """Random strings over all characters that the fast path takes, of every class, and mixes of them."""
    tokens = packing.Tokens(*tokenizer_files())
    plain = packing.Tokens(tokenizer_files()[0])
    rng = random.Random(6)
    admitted = [chr(c) for c in [*range(0x530), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0)]]
    classes = [admitted, list(" \t\n\r\x0b\x0c\x85\xa0\u2003\u2028"), list("'sStTrReEvVmMlLdD ’"), list("0123456789²½٠"[:12]), list("abcXYZéß ÀŁж "), list("!?.,-_#@(){}[]<>/\\\"'`~^|=+*&%$€₿…—")]
    for n in range(6000):
        pick = [rng.choice(classes) for _ in range(rng.randint(1, 3))]
        text = "".join(rng.choice(rng.choice(pick)) for _ in range(rng.randint(0, 60)))
        assert tokens.encode(text) == plain.encode(text), repr(text)


def test_packing_edges(spark):
    odd = spark.createDataFrame([(None, None), (1, ""), (1, "a <|endoftext|> b"), (1, "a <|endoftext|> b")], "doc_id long, text string")
    got = sorted((str(r.doc_id), r.doc_tokens) for r in packing.pack(odd, tokenizer_files()).where("start = 0").collect())
    assert got == [("1", 1), ("1", 5), ("1", 5), ("None", 1)]  # a, space, special token, space and b, end
    assert packing.pack(odd.where("doc_id = 9"), tokenizer_files()).count() == 0


def test_packing_spreads_shared_ids(spark):
    rows = [(None, 0, 256, i, 256) for i in range(400)] + [(7, 0, 256, 1, 256)] * 400 + [(9, 256, 3, 5, 259)] * 500
    pieces = spark.createDataFrame(rows, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long").repartition(3)
    got = packing.pack_pieces(pieces, window=256, group_tokens=4096).collect()
    assert sorted((tuple(r)[:5] for r in got), key=str) == sorted(rows, key=str)
    tokens, window = {}, {}
    for r in got:
        tokens[r.sequence_id >> 32] = tokens.get(r.sequence_id >> 32, 0) + r.length
        window[r.sequence_id] = window.get(r.sequence_id, 0) + r.length
    assert max(tokens.values()) <= 3 * 4096 and max(window.values()) <= 256


def plain_top(rows, k, every):
    sound = {(i, tuple(int(np.floor(256 * float(x))) for x in v)) for i, v in rows if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)}
    out = []
    for q, a in sound:
        if q % every == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for i, b in sound if i != q)
            out += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:k], 1)]
    return sorted(out)


def test_top_k(spark):
    rng = np.random.default_rng(1)
    rows = [(i, rng.normal(size=6).round(2).tolist()) for i in range(300)]
    hot = rng.normal(size=6).round(2).tolist()
    rows += [(300 + i, hot) for i in range(150)] + [(450, None), (451, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (452, [float("nan")] * 6), (453, [float("inf")] * 6), (None, hot), (300, hot)]
    table = spark.createDataFrame([(*r, 7) for r in rows], "vec_id long, embedding array<float>, score long")
    exact = [(i, None if v is None else [None if x is None else float(np.float32(x)) for x in v]) for i, v in rows]
    for blocks in ({}, {"candidates": 64, "queries": 4}):
        got = sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 25 == 0, **blocks).collect()))
        assert got == plain_top(exact, 5, 25)
    few = topk.top_k(table.where("vec_id < 3"), F.col("vec_id") == 0).collect()
    assert [r.rank for r in few] == [1, 2]
    assert topk.top_k(table.where("vec_id = -1"), F.lit(True)).count() == 0


def test_top_k_of_ids_with_several_vectors(spark):
    rng = np.random.default_rng(2)
    rows = [(i % 80, rng.integers(-40, 40, 4).tolist()) for i in range(400)] + [(25, rng.integers(-40, 40, 4).tolist()) for _ in range(60)]
    rows += rows[:30]
    table = spark.createDataFrame([(i, [x / 256 for x in v]) for i, v in rows], "vec_id long, embedding array<double>").repartition(7)
    once = sorted({(i, tuple(v)) for i, v in rows})
    expected = []
    for q in (0, 25, 50, 75):
        scores = sorted((-sum(x * y for x, y in zip(a, b, strict=True)), i) for p, a in once if p == q for i, b in once if i != q)
        expected += [(q, n, i, -s) for n, (s, i) in enumerate(scores[:5], 1)]
    for blocks in ({}, {"candidates": 64, "queries": 4}):
        assert sorted(map(tuple, topk.top_k(table, F.col("vec_id") % 25 == 0, **blocks).collect())) == expected


def test_very_long_texts(spark):
    """Texts of 100,000 words, which share most of them: repeated windows of words, and sets that are alike."""
    rng = random.Random(21)
    words = [f"w{rng.randrange(10**6)}" for _ in range(100_000)]
    other = [w if i % 400 else f"x{i}" for i, w in enumerate(words)]
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[50_000:])), (4, " ".join(words[:50_000] + [f"y{i}" for i in range(50_000)])), (5, "short")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_words, r.n_removed) for r in substring_dedup.remove_repeats(docs).collect()}
    seen, expected = set(), {}
    for i, text in rows:
        own, gone = text.split(), set()
        for at in range(len(own) - 19):
            window = hash(tuple(own[at : at + 20]))
            if window in seen:
                gone.update(range(at, at + 20))
            seen.add(window)
        expected[i] = len(own), len(gone)
    assert got == expected and got[3] == (50_000, 50_000)
    alike = {r.doc_id: r.component_id for r in ngram_join.join_components(docs).collect()}
    assert alike == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5}
