import hashlib
import random

import numpy as np
import pytest
from lodeline.llm.vector_codes import KdTree, compress

SCHEMA = "vec_id long, embedding array<float>, label int"


def plain(rows, parts, entries, rounds):
    """compress() by comparing every part with every entry."""
    rows = [r for r in rows if r[1] and all(x is not None and np.isfinite(x) for x in r[1])]
    rows.sort(key=lambda r: (r[0] is None, r[0] or 0, [float(np.float32(x)) for x in r[1]]))
    x = np.array([np.floor(256 * np.float32(r[1]).astype(float)) for r in rows]).astype(np.int64).reshape(len(rows), parts, -1)
    books = x[:entries].transpose(1, 0, 2).copy()

    def assign():
        distance = ((x.transpose(1, 0, 2)[:, :, None, :] - books[:, None]) ** 2).sum(3)
        return distance.argmin(2), distance.min(2)

    for _ in range(rounds):
        index, _ = assign()
        for p in range(parts):
            for e in set(index[p].tolist()):
                own = x[index[p] == e, p]
                books[p, e] = own.sum(0) // len(own)
    index, distance = assign()
    errors = distance.sum(0).tolist()
    by_label = {}
    for r, e in zip(rows, errors, strict=True):
        by_label[r[2]] = by_label.get(r[2], 0) + e
    sha = hashlib.sha256(",".join(str(v) for v in books.reshape(-1)).encode()).hexdigest()
    return sorted(((r[0], "".join(f"{i:02x}" for i in index[:, n]), e, by_label[r[2]], sha) for n, (r, e) in enumerate(zip(rows, errors, strict=True))), key=str)


@pytest.mark.parametrize("seed", range(4))
def test_the_tree_gives_the_first_of_the_nearest(seed):
    rng = np.random.default_rng(seed)
    for n in (1, 2, 5, 64, 256):
        entries = rng.integers(-3, 4, (n, 4)) if seed % 2 else rng.integers(-9999, 9999, (n, 4))
        points = rng.integers(-5, 6, (400, 4)) if seed % 2 else rng.integers(-12000, 12000, (400, 4))
        index, distance = KdTree(entries, leaf=1 + seed).nearest(points)
        every = ((points[:, None] - entries) ** 2).sum(2)
        assert (index == every.argmin(1)).all() and (distance == every.min(1)).all()
    extreme = np.array([[1 << 24] * 4, [-(1 << 24)] * 4])
    assert KdTree(extreme).nearest(-extreme)[0].tolist() == [1, 0]


def rows(rng, n, size=8):
    out = [(i if i % 11 else None, [rng.gauss(0, 0.4) for _ in range(size)], rng.choice([0, 1, 2, None])) for i in range(n)]
    out += [(1000 + i, [0.25] * size, 7) for i in range(n // 3)]
    return out + [(5000, None, 1), (5001, [None] * size, 1), (5002, [float("nan")] * size, 1), (5003, [float("inf"), *[0.0] * (size - 1)], 1), (5004, [], 1), (7, [0.5] * size, 0), (7, [0.5] * size, 0)]


@pytest.mark.parametrize(("parts", "entries", "rounds"), [(4, 16, 2), (2, 5, 3), (8, 200, 1), (4, 8, 0)])
def test_like_every_entry(spark, parts, entries, rounds):
    table = rows(random.Random(parts), 120)
    got = compress(spark.createDataFrame(table, SCHEMA).repartition(5), parts, entries, rounds)
    assert got.columns == ["vec_id", "code", "error", "label_error", "codebooks_sha256"]
    assert sorted(map(tuple, got.collect()), key=str) == plain(table, parts, entries, rounds)


def test_negative_means_go_down(spark):
    table = [(0, [-0.01, 0.0], 1), (1, [-0.02, 0.0], 1), (2, [-0.5, 0.0], 1)]
    assert sorted(map(tuple, compress(spark.createDataFrame(table, SCHEMA), 2, 1, 1).collect())) == plain(table, 2, 1, 1)


def test_edges(spark):
    empty = compress(spark.createDataFrame([], SCHEMA))
    assert empty.count() == 0 and empty.columns[1] == "code"
    assert compress(spark.createDataFrame([(1, None, 1)], SCHEMA)).count() == 0
    clashing = spark.createDataFrame([(1, [0.5] * 16, "x", 3), (2, [0.5] * 16, "x", 4)], "vec_id long, embedding array<double>, label string, code int")
    assert [(r.code, r.error, r.label_error) for r in compress(clashing).collect()] == [("00" * 16, 0, 0)] * 2
    with pytest.raises(ValueError, match="equal parts"):
        compress(spark.createDataFrame([(1, [0.5] * 16, 1), (2, [0.5] * 32, 1)], SCHEMA))
    with pytest.raises(Exception, match="beyond"):
        compress(spark.createDataFrame([(1, [1e9] * 16, 1)], SCHEMA)).count()
