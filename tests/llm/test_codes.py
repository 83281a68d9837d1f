"""Vector codes against brute force."""

import math

import numpy as np
import pytest

from cairn.llm import vector_codes as V


@pytest.mark.parametrize("seed", range(6))
def test_nearest_is_exact(seed):
    rng = np.random.default_rng(seed)
    wide = [3, 40, 5000, 1 << 25][seed % 4]
    entries = rng.integers(-wide, wide + 1, (int(rng.integers(1, 40)), 5))
    entries[len(entries) // 2 :] = entries[: len(entries) - len(entries) // 2]  # ties
    parts = np.concatenate([rng.integers(-wide, wide + 1, (500, 5)), entries])
    index, square = V.nearest(parts, entries)
    every = ((parts[:, None] - entries[None]) ** 2).sum(2)
    assert (square == every.min(1)).all() and (index == every.argmin(1)).all()


def test_roots_are_exact():
    squares = np.array([0, 1, 2, 3, 4, (1 << 30) ** 2 - 1, (1 << 30) ** 2, (1 << 30) ** 2 + 1, (1 << 31) ** 2 - 1, 2**61 + 1])
    down, up = V.roots(squares)
    assert down.tolist() == [math.isqrt(x) for x in squares.tolist()] and up.tolist() == [V.root_up(x) for x in squares.tolist()]


def test_the_tree_skips_entries():
    entries = np.array([[k * 1000, 0] for k in range(16)])
    measured = []

    class Watched(np.ndarray):
        pass

    tree = V.vantage_tree(entries)
    real = np.einsum

    def count(*args):
        measured.append(len(args[1]))
        return real(*args)

    np.einsum = count
    try:
        index, _ = V.nearest(np.array([[3010, 5]] * 100), entries, tree)
    finally:
        np.einsum = real
    assert (index == 3).all() and sum(measured) < 100 * 16


def brute(rows, parts=8, entries=16, rounds=6, scale=4096):
    kept = sorted(((i, lab, [math.floor(scale * x) for x in v]) for i, lab, v in rows if v and None not in v and np.isfinite(v).all()), key=lambda r: (r[0] is None, r[0], r[2]))
    if not kept:
        return [], []
    w = len(kept[0][2]) // parts
    cut = lambda v: [v[p * w : (p + 1) * w] for p in range(parts)]
    books = [[cut(v)[p] for _, _, v in kept[:entries]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), k) for k, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            own = {}
            for _, _, v in kept:
                own.setdefault(near(cut(v)[p], books[p])[1], []).append(cut(v)[p])
            books[p] = [[sum(c) // len(own[k]) for c in zip(*own[k], strict=True)] if k in own else e for k, e in enumerate(books[p])]
    found = [(i, lab, [near(x, books[p]) for p, x in enumerate(cut(v))]) for i, lab, v in kept]
    return [(i, lab, "".join(f"{k:02x}" for _, k in f), sum(d for d, _ in f)) for i, lab, f in found], books


SCHEMA = "vec_id long, embedding array<double>, label int, code string, error long, _label int, v string"


def odd_rows():
    rng = np.random.default_rng(5)
    rows = [(i, rng.normal(size=16).tolist(), int(rng.integers(0, 3))) for i in range(60)]
    hot = rng.normal(size=16).tolist()
    rows += [(100 + i, hot, None) for i in range(40)]
    rows += [(7, rows[7][1], 1), (7, hot, 2), (None, hot, 5), (200, None, 1), (201, [None] + [1.0] * 15, 1), (202, [math.nan] * 16, 1), (203, [math.inf] + [0.0] * 15, 1), (204, [-math.inf] + [0.0] * 15, None), (205, [], 1)]
    return rows


def test_codes_match_brute_force(spark):
    rows = odd_rows()
    df = spark.createDataFrame([(*r, "x", 9, 4, "y") for r in rows], SCHEMA).repartition(5)
    coded, books = V.code_vectors(df)
    want, want_books = brute([(i, lab, v) for i, v, lab in rows])
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, coded.collect()), key=key) == sorted(want, key=key)
    assert [b.tolist() for b in books] == want_books
    totals = {}
    for _, lab, _, e in want:
        totals[lab] = totals.get(lab, 0) + e
    for most in (100, 0):
        got = V.with_label_error(coded, most=most)
        assert sorted(map(tuple, got.select("vec_id", "label", "code", "error", "label_error").collect()), key=key) == sorted(((*r, totals[r[1]]) for r in want), key=key)


def test_edges(spark):
    df = spark.createDataFrame([(*r, "x", 9, 4, "y") for r in odd_rows()], SCHEMA)
    coded, books = V.code_vectors(df.limit(0))
    assert coded.count() == 0 and books == [] and V.with_label_error(coded).count() == 0
    assert V.code_vectors(df.where("embedding is null"))[0].count() == 0
    few, books = V.code_vectors(df.where("vec_id < 3"))
    assert few.count() == 3 and len(books[0]) == 3 and {r.error for r in few.collect()} == {0}
    with pytest.raises(ValueError):
        V.code_vectors(df, parts=5)
    more = df.union(spark.createDataFrame([(1, [1.0], 1, "", 0, 0, ""), (300, [1e30] * 16, 1, "", 0, 0, "")], SCHEMA))
    assert V.code_vectors(more.where("vec_id <> 1 or size(embedding) = 1").where("vec_id > 0"), rounds=1, parts=1)[0].count() == 1
    assert V.code_vectors(more)[0].count() == 103
