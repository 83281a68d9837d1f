"""Embedding near-dedup against brute force."""

import numpy as np

from cairn.llm import vector_dedup


def brute(rows, cosine=0.9):
    ids = sorted(rows)
    links = {i: set() for i in ids}
    good = {i: np.array(v, float) for i, v in rows.items() if v and None not in v and np.isfinite(np.array(v, float)).all() and any(v)}
    for a in good:
        for b in good:
            if a != b and len(good[a]) == len(good[b]) and good[a] @ good[b] / np.sqrt((good[a] @ good[a]) * (good[b] @ good[b])) >= cosine:
                links[a].add(b)
    out = {}
    for i in ids:
        seen, todo = {i}, [i]
        while todo:
            for x in links[todo.pop()] - seen:
                seen.add(x)
                todo.append(x)
        out[i] = (len(links[i]), min(seen), min(seen) == i)
    return out


def test_near_intervals_are_complete():
    rng = np.random.default_rng(0)
    lo = np.sort(rng.random((40, 3)), axis=0)
    hi = lo + rng.random((40, 3)) * 0.1
    want = [(i, j) for i in range(40) for j in range(i, 40) if vector_dedup.apart(lo[i], hi[i], lo[j], hi[j]) <= 0.2]
    assert vector_dedup.near_intervals(lo, hi, 0.2) == want
    want = [(i, j) for i in range(25) for j in range(15) if vector_dedup.apart(lo[i], hi[i], lo[25 + j], hi[25 + j]) <= 0.2]
    assert vector_dedup.near_intervals(lo[:25], hi[:25], 0.2, lo[25:], hi[25:]) == want


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(1)
    rows = {}
    for k in range(25):
        centre = rng.normal(size=16)
        for _ in range(rng.integers(1, 30)):
            rows[len(rows) * 3 + 1] = (centre + rng.normal(size=16) * rng.choice([0.1, 0.3, 0.5])).tolist()
    hot = rng.normal(size=16).tolist()
    for _ in range(120):
        rows[len(rows) * 3 + 1] = hot
    rows |= {5: None, 8: [0.0] * 16, 11: [None] + [1.0] * 15, 14: [float("nan")] * 16, 17: [float("inf")] + [1.0] * 15, 20: [], 23: [1.0, 2.0], 26: [2.0, 4.0], 29: [1e300] * 16, 32: [1e-300] * 16}
    df = spark.createDataFrame([(i, v, 7, "x") for i, v in rows.items()], "vec_id long, embedding array<double>, label int, unit string")
    got = {r.vec_id: (r.n_links, r.component_id, r.kept) for r in vector_dedup.vector_groups(df, sample=60).collect()}
    big = brute({i: v for i, v in rows.items() if i not in (29, 32)})
    assert {i: v for i, v in got.items() if i not in (29, 32)} == big
    assert got[29] == (1, 29, True) and got[32] == (1, 29, False)
    assert vector_dedup.vector_groups(df.limit(0)).count() == 0
    again = df.union(df.limit(3)).union(spark.createDataFrame([(None, [1.0] * 16, 1, "")], df.schema))
    assert vector_dedup.vector_groups(again).count() == len(rows) + 1
