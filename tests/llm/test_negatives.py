"""Hard negatives against brute force."""

import math
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from cairn.llm import hard_negatives as H


def brute(rows, every=5, positives=5, negatives=3, window=(50, 95), scale=256):
    kept = {}
    for i, v, lab in rows:
        if i is not None and lab is not None and v and None not in v and np.isfinite(v).all():
            kept[i] = max(kept.get(i, (lab, [])), (lab, [math.floor(scale * x) for x in v]))
    out = []
    for a, (label, q) in kept.items():
        if a % every:
            continue
        by = sorted((-sum(x * y for x, y in zip(q, v, strict=True)), i, lab) for i, (lab, v) in kept.items() if i != a and len(v) == len(q))
        for s, p, _ in [r for r in by if r[2] == label][:positives]:
            fit = [r for r in by if r[2] != label and Fraction(window[0] * -s, 100) <= -r[0] <= Fraction(window[1] * -s, 100)]
            out += [(a, p, k + 1, i, -s, -n) for k, (n, i, _) in enumerate(fit[:negatives])]
    return sorted(out)


def clustered(seed, n=600, dim=8):
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(12, dim))
    rows = [(i, (centres[rng.integers(12)] + rng.normal(size=dim) * rng.choice([0.02, 0.2, 1.0])).tolist(), int(rng.integers(0, 4))) for i in range(n)]
    hot = centres[0].tolist()
    return rows + [(n + k, hot, k % 2) for k in range(150)]  # ties: equal vectors with two labels


@pytest.mark.parametrize("seed", range(4))
def test_walk_is_nearest_first(seed):
    rng = np.random.default_rng(seed)
    rows = np.array([r[1] for r in clustered(seed)]) * [256, 256, 4000, 3][seed]
    ints = np.floor(rows).astype(np.int64)
    labels = rng.integers(0, 3, len(ints))
    square = int((ints**2).sum(1).max())
    block = H.Block(np.arange(len(ints)), labels, ints, square, bucket=16)
    for a in range(0, len(ints), 40):
        scores = ints @ ints[a]
        for low, high in ((-(1 << 62), 1 << 62), tuple(np.sort(rng.choice(scores, 2)))):
            want = sorted((-int(s), i) for i, s in enumerate(scores) if low <= s <= high and labels[i] != labels[a])
            got = [(-s, i) for s, i in block.nearest_first(ints[a], low, high, lambda part, a=a: block.labels[part] != labels[a])]
            assert got == want


def test_walk_leaves_buckets_unopened():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(12, 8))
    ints = np.floor((centres[rng.integers(12, size=4096)] + rng.normal(size=(4096, 8)) * 0.02) * 256).astype(np.int64)
    block = H.Block(np.arange(len(ints)), np.zeros(len(ints)), ints, int((ints**2).sum(1).max()), bucket=16)
    opened = []
    list(zip(range(3), block.nearest_first(ints[5], -(1 << 62), 1 << 62, lambda part: opened.append(part) or np.ones(part.stop - part.start, bool)), strict=False))
    assert len(opened) < 256 / 4


def test_leaf_bounds_hold():
    ints = np.floor(np.array([r[1] for r in clustered(2)]) * 256).astype(np.int64)
    leaves = H.Leaves(ints[::7], int((ints**2).sum(1).max()), 16)
    leaf, far = leaves.of(ints)
    np.maximum.at(leaves.radii, leaf, far)
    low, high = leaves.bounds(ints[:50])
    scores = ints[:50] @ ints.T
    assert len(leaves.centres) > 4 and (scores <= high[:, leaf]).all() and (scores >= low[:, leaf]).all()
    assert (high < scores.max()).any()


SCHEMA = "vec_id long, embedding array<double>, label int, rank string, anchor_id int, score double, v string"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", 1, 0.5, "y") for r in rows], SCHEMA).repartition(6)


@pytest.mark.parametrize("seed,block,group", [(0, 100, 60), (1, 4000, 1 << 15)])
def test_negatives_match_brute_force(spark, seed, block, group):
    rows = clustered(seed)
    rows += [(2000, None, 1), (2005, [None] + [1.0] * 7, 1), (2010, [math.nan] * 8, 1), (2015, [math.inf] + [0.0] * 7, 1), (2020, [], 1), (2025, [1.0] * 8, None), (None, [1.0] * 8, 1), (2030, [0.0] * 8, 1), (2035, [1.0, 2.0], 0), (2036, [2.0, 2.0], 0), (2037, [1.0, 1.0], 1), (10, rows[10][1], rows[10][2]), (15, [0.5] * 8, 3)]
    got = H.hard_negatives(frame(spark, rows), F.col("vec_id") % 5 == 0, block=block, group=group, sample=64)
    assert sorted(map(tuple, got.collect())) == brute(rows)


def test_edges(spark):
    df = frame(spark, clustered(0, n=20))
    assert H.hard_negatives(df.limit(0), F.lit(True)).count() == 0
    assert H.hard_negatives(df, F.lit(None).cast("boolean")).count() == 0
    assert H.hard_negatives(df.where("vec_id = 3"), F.lit(True)).count() == 0
    huge = frame(spark, [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1), (2, [3.0, 1.0], 1), (3, [0.5, 1.0], 2)])
    assert sorted(map(tuple, H.hard_negatives(huge, F.col("vec_id") < 2).collect())) == []
