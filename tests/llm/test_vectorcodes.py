"""Codes and codebooks against plain k-means in whole numbers."""

import hashlib
import math

import numpy as np
import pytest

from ledgerloom.llm import vectorcodes
from ledgerloom.llm.common import read
from ledgerloom.llm.vectorcodes import nearest


def expected(rows, parts=8, entries=16, rounds=6):
    kept = [
        (i, label, [math.floor(4096 * x) for x in v])
        for i, v, label in rows
        if v is not None and all(x is not None and math.isfinite(x) for x in v)
    ]
    if not kept:
        return []
    width = len(kept[0][2]) // parts
    first = sorted(kept, key=lambda r: (r[0] is None, r[0] or 0, r[2]))[:entries]
    books, chosen = [], {}
    for p in range(parts):
        cut = slice(p * width, (p + 1) * width)
        book = [list(v[cut]) for _, _, v in first]
        for turn in range(rounds + 1):
            near = []
            for _, _, v in kept:
                far = [sum((a - b) ** 2 for a, b in zip(v[cut], e)) for e in book]
                near.append((far.index(min(far)), min(far)))
            if turn == rounds:
                break
            for e in range(len(book)):
                own = [v[cut] for (_, _, v), (n, _) in zip(kept, near) if n == e]
                if own:
                    book[e] = [sum(x) // len(own) for x in zip(*own)]
        books.append(book)
        chosen[p] = near
    digest = hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()
    errors = [sum(chosen[p][n][1] for p in range(parts)) for n in range(len(kept))]
    label = {}
    for (_, own, _), e in zip(kept, errors):
        label[own] = label.get(own, 0) + e
    return sorted(
        (
            (i, "".join(f"{chosen[p][n][0]:02x}" for p in range(parts)), errors[n], label[own], digest)
            for n, (i, own, _) in enumerate(kept)
        ),
        key=repr,
    )


def run(rows):
    return sorted(map(tuple, vectorcodes.encoded(rows).collect()), key=repr)


KIND = "vec_id long, embedding array<float>, label int, v string, code int"


def test_equals_brute_force(spark, small):
    rows = read(spark, small, "embeddings").select("vec_id", "embedding", "label")
    assert run(rows) == expected([tuple(r) for r in rows.collect()])


def test_hostile_vectors(spark):
    rng = np.random.default_rng(2)
    nan, inf = float("nan"), float("inf")
    rows = [(i, rng.integers(-3, 4, 16).astype(float).tolist(), i % 3, "x", 1) for i in range(60)]
    rows += [(5, rows[5][1], 2, "x", 1), (5, rows[7][1], None, "x", 1), (None, rows[9][1], None, "x", 1)]
    rows += [(70, None, 1, "x", 1), (71, [None] * 16, 1, "x", 1), (72, [nan] * 16, 1, "x", 1)]
    rows += [(-1, [1.0] * 15 + [inf], 1, "x", 1), (74, [-inf] + [0.0] * 15, 1, None, None)]
    table = spark.createDataFrame(rows, KIND).repartition(3)
    want = expected([(r[0], r[1], r[2]) for r in rows])
    assert run(table) == want and len(want) == 63


def test_fewer_vectors_than_entries(spark):
    rows = [(i, [0.25 * i] * 8, None, "x", 1) for i in range(3)]
    assert run(spark.createDataFrame(rows, KIND)) == expected([(r[0], r[1], r[2]) for r in rows])


def test_empty_tables(spark):
    assert run(spark.createDataFrame([], KIND)) == []
    assert run(spark.createDataFrame([(1, None, 1, "x", 1)], KIND)) == []


def test_other_shapes_are_errors(spark):
    for vectors in ([[1.0] * 8, [1.0] * 16], [[1.0] * 9], [[]], [[1e30] * 8]):
        rows = [(i, v, 1, "x", 1) for i, v in enumerate(vectors)]
        with pytest.raises(ValueError):
            vectorcodes.encoded(spark.createDataFrame(rows, KIND))


def test_search_finds_the_nearest_and_the_lower_index_on_ties():
    rng = np.random.default_rng(0)
    for _ in range(300):
        k, d, n, size = rng.integers(1, 17), rng.integers(1, 9), rng.integers(1, 50), rng.choice([2, 5, 2000])
        entries, vectors = rng.integers(-size, size + 1, (k, d)), rng.integers(-size, size + 1, (n, d))
        far = ((vectors[:, None] - entries[None]) ** 2).sum(axis=2)
        found, best = nearest(vectors, entries)
        assert (found == far.argmin(axis=1)).all() and (best == far.min(axis=1)).all()


def test_codes_stand_for_their_vectors():
    books = np.arange(2 * 3 * 4).reshape(2, 3, 4)
    codes = np.array([[0, 2], [1, 1]])
    assert vectorcodes.decoded(codes, books).tolist() == [
        [0, 1, 2, 3, 20, 21, 22, 23],
        [4, 5, 6, 7, 16, 17, 18, 19],
    ]
