import random

import numpy as np
import pytest
from lodeline.llm import cells, minhash
from lodeline.llm.ngram_join import shingles
from lodeline.llm.words import mix
from test_exact import near_copies, plain_components


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def edited(rng, words, share):
    return " ".join(w if rng.random() > share else f"e{rng.randrange(10**6)}" for w in words)


def corpus(rng):
    rows = []
    for g in range(40):
        words = [f"g{g}w{rng.randrange(400)}" for _ in range(rng.randint(3, 200))]
        rows += [edited(rng, words, rng.choice([0, 0, 0.005, 0.02, 0.05, 0.1])) for _ in range(rng.randint(1, 6))]
    passage = " ".join(f"p{i}" for i in range(120))
    rows += [f"{passage} " + " ".join(f"o{n}-{i}" for i in range(rng.randint(10, 60))) for n in range(60)]
    rows += ["", None, " \t\n", "one", "One", "two words", "TWO  words", "é ß", "a b c", "A\x0bB\tC", rows[0], rows[0].upper()]
    rng.shuffle(rows)
    return list(enumerate(rows))


@pytest.mark.parametrize(("seed", "percent"), [(1, 85), (3, 70)])
def test_like_all_pairs(spark, seed, percent):
    rows = corpus(random.Random(seed))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in minhash.near_duplicates(frame(spark, rows), percent=percent).collect()}
    assert got == plain_components(rows, 3, percent)


@pytest.mark.parametrize("members", [16, 100])
def test_large_groups_in_blocks(spark, members):
    """A group of near copies, in buckets and cells of several blocks, and another one that is only found in the second round."""
    texts = [*near_copies(400), *near_copies(3, seed=9, words=280), *(" ".join(f"u{i}-{j}" for j in range(50)) for i in range(200))]
    rows = list(enumerate(texts))
    got = {r.doc_id: r.component_id for r in minhash.near_duplicates(frame(spark, rows).repartition(5), members=members, pivots=2).collect()}
    assert got == {i: c for i, (_, c) in plain_components(rows, 3, 85).items()} and sum(got[i] == 0 for i in range(400)) > 390


def test_ids_and_columns(spark):
    text = " ".join(f"t{i}" for i in range(40))
    rows = [(None, text), (None, f"{text} z"), (4, f"y {text}"), (5, None), (6, "a b"), (7, "A  B"), (7, "A  B"), (8, "")]
    got = sorted(map(tuple, minhash.near_duplicates(spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, kept int")).collect()), key=str)
    alike = [(n, c, k) for i, n, c, k in got if i is None]
    assert sorted(alike) == [(38, None, False), (39, None, True)] or sorted(alike) == [(38, None, True), (39, None, False)]
    assert [x for x in got if x[0] is not None] == [(4, 39, None, False), (5, 0, 5, True), (6, 1, 6, True), (7, 1, 6, False), (7, 1, 6, False), (8, 0, 8, True)]
    assert minhash.near_duplicates(frame(spark, [])).count() == 0
    assert minhash.near_duplicates(frame(spark, [(1, None), (2, "")])).count() == 2


def test_a_very_long_text(spark):
    rng = random.Random(4)
    words = [f"w{rng.randrange(10**6)}" for _ in range(120_000)]
    rows = [(0, " ".join(words)), (1, edited(rng, words, 0.02)), (2, edited(rng, words, 0.2)), (3, "x")]
    assert [r.component_id for r in minhash.near_duplicates(frame(spark, rows)).orderBy("doc_id").collect()] == [0, 0, 2, 3]


def test_minima_agree_as_often_as_sets_are_alike():
    rng = np.random.default_rng(2)
    for share in (0.3, 0.85):
        hits = []
        for _ in range(40):
            n = 600
            common, own = mix(rng.integers(0, 2**63, int(n * share), dtype=np.uint64)), [mix(rng.integers(0, 2**63, (n - int(n * share)) // 2, dtype=np.uint64)) for _ in range(2)]
            sets = [np.sort(np.concatenate([common, x])) for x in own]
            _, short = minhash.signatures(np.repeat([0, 1], [len(s) for s in sets]), np.concatenate(sets), 2, 32, 5)
            hits.append((short[0] == short[1]).mean())
        assert abs(np.mean(hits) - (share + (1 - share) / 256)) < 0.02


@pytest.mark.parametrize("percent", [70, 85, 95])
def test_few_pairs_at_the_threshold_are_pruned(percent):
    """The chance that a pair of just that similarity shares no bucket or is pruned by a batch; and most pairs far below it are pruned."""
    from math import comb

    (bands, rows), t = minhash.shape(percent), percent / 100
    assert bands * rows <= minhash.MINIMA and (1 - t**rows) ** bands <= minhash.MISS < (1 - t ** (rows + 1)) ** (minhash.MINIMA // (rows + 1))
    width, needed = bands * rows, lambda n: minhash.least_agreeing(n, percent)
    steps = [min(n, width) for n in range(minhash.BATCH, width + minhash.BATCH, minhash.BATCH)]
    below = lambda n, m, p: sum(comb(n, i) * p**i * (1 - p) ** (n - i) for i in range(m))
    assert sum(below(n, needed(n), t) for n in steps) < 2e-6
    assert below(minhash.BATCH, needed(minhash.BATCH), 0.1) > 0.95 and below(width, needed(width), t - 0.35) > 0.99
    assert minhash.least_agreeing(32, percent, 0.5) > minhash.least_agreeing(32, percent, 1e-9)


def test_survivors_hold_the_links():
    rng = random.Random(11)
    words = [f"w{i}" for i in range(200)]
    texts = [edited(rng, words, rng.choice([0, 0.01, 0.3])).encode() for _ in range(300)]
    offsets = np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    text, value = shingles(np.frombuffer(b"".join(texts), np.uint8), offsets, 3)
    _, short = minhash.signatures(text, value, len(texts), *minhash.shape(85))
    sets = [frozenset(value[text == i].tolist()) for i in range(len(texts))]
    label = minhash.survivors(short, np.zeros(len(texts), bool), 85)
    for i in range(0, 300, 7):
        for j in range(300):
            if len(sets[i] & sets[j]) >= 0.85 * len(sets[i] | sets[j]):
                assert label[i] == label[j]
    assert len(set(label.tolist())) > 50 and cells.TILE < 300
