"""Graph operators on literal graphs."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest

from cairn.functions.session import settle
from cairn.operators import components, graph


def nodes(spark, ids):
    return spark.createDataFrame([(i,) for i in ids], "id long")


def edges(spark, pairs):
    return spark.createDataFrame(pairs, "src long, dst long")


def ranks(spark, ids, pairs, **more):
    return {r.id: r.rank for r in graph.pagerank(nodes(spark, ids), edges(spark, pairs), **more).collect()}


def test_pagerank_small_graphs(spark):
    assert ranks(spark, [1], [])[1] == pytest.approx(1)
    got = ranks(spark, [1, 2], [(1, 1), (1, 2)], iterations=8)
    assert got[2] > got[1]
    assert ranks(spark, [1, 2, 3], [(1, 3), (2, 3), (1, 3)], iterations=4) == pytest.approx(ranks(spark, [1, 2, 3], [(1, 3), (2, 3)], iterations=4))
    assert sum(ranks(spark, range(1, 6), [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5), (5, 1)], iterations=6).values()) == pytest.approx(1)
    got = ranks(spark, [1, 2], [(1, 2), (1, 999)], iterations=3)
    assert set(got) == {1, 2}
    assert ranks(spark, [1, 2], [(1, 2)], iterations=0) == {1: 0.5, 2: 0.5}


def test_blast_and_reach(spark):
    cycle = {r.id: r.importers for r in components.blast_counts(edges(spark, [(1, 2), (2, 3), (3, 1)])).collect()}
    assert cycle == {1: 2, 2: 2, 3: 2}
    own = graph.blast_of(edges(spark, [(1, 1), (2, 1), (3, 2)]), nodes(spark, [1])).collect()
    assert {(r.node, r.direct) for r in own} == {(2, True), (3, False)}
    got = {r.node: r.depth for r in graph.reach(edges(spark, [(1, 2), (2, 3), (1, 3)]), spark.createDataFrame([(1, 1)], "seed long, node long"), 1).collect()}
    assert got == {1: 0, 2: 1, 3: 1}


def test_shortest_paths_count_all(spark):
    got = {r.node: (r.dist, r.paths, r.pred) for r in graph.shortest_paths(edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (4, 5)]), nodes(spark, [1])).collect()}
    assert got == {1: (0, 1, None), 2: (1, 1, 1), 3: (1, 1, 1), 4: (2, 2, 2), 5: (3, 2, 4)}


def test_path_to_targets(spark):
    e = edges(spark, [(1, 2), (1, 3), (2, 4), (3, 4), (3, 5), (4, 6), (5, 6), (6, 1)])
    row = graph.path_to(e, nodes(spark, [1]), nodes(spark, [4, 5])).first()
    assert (row.target, row.dist, row.path, row.alternatives) == (4, 2, [1, 2, 4], 2)
    assert tuple(graph.path_to(e, nodes(spark, [1]), nodes(spark, [1, 2])).first()) == (1, 0, [1], 0)
    assert graph.path_to(e, nodes(spark, [1]), nodes(spark, [99])).count() == 0
    assert graph.path_to(e, nodes(spark, [1]), nodes(spark, [6]), max_depth=2).count() == 0
    kinds = spark.createDataFrame([(1, 2, "call"), (2, 3, "type"), (1, 4, "type"), (4, 3, "type")], "src long, dst long, kind string")
    assert graph.path_to(kinds, nodes(spark, [1]), nodes(spark, [3]), kinds=["type"]).first().path == [1, 4, 3]


def test_communities_and_modularity(spark):
    cliques = [(a, b) for base in (0, 10) for a in range(base, base + 4) for b in range(a + 1, base + 4)]
    got = {r.id: r.cluster for r in graph.communities(nodes(spark, [*range(4), *range(10, 14), 99]), edges(spark, cliques)).collect()}
    assert len({got[k] for k in range(4)}) == 1 and len({got[k] for k in range(10, 14)}) == 1 and got[0] == 1 and got[10] == 2 and got[99] == 0
    q = graph.modularity(edges(spark, cliques), spark.createDataFrame(list(got.items()), "id long, cluster long")).first()[0]
    assert q == pytest.approx(0.5 + 2 * 4 * 9 / 24**2, abs=0.2) and q > 0.4


def local_moving(ids, pairs, gamma=1.0, passes=50, epsilon=1e-6):
    """The whole graph at once, in node order: community of each node, split where it is not connected, numbered by least node from size 3 on."""
    ids = sorted(ids)
    w = {}
    for a, b in pairs:
        if a != b:
            for x, y in ((a, b), (b, a)):
                w.setdefault(x, {})[y] = w.setdefault(x, {}).get(y, 0) + 1
    k = {v: sum(w.get(v, {}).values()) for v in ids}
    two_m, of = sum(k.values()), {v: v for v in ids}

    def quality():
        return sum((x - gamma * k[a] * k[b] / two_m) / two_m for a in w for b, x in w[a].items() if of[a] == of[b]) - sum(gamma * k[a] * k[b] / two_m**2 for a in ids for b in ids if of[a] == of[b] and b not in w.get(a, {}))

    before = quality() if two_m else 0
    for _ in range(passes if two_m else 0):
        moved = False
        for v in ids:
            near = {}
            for u, x in w.get(v, {}).items():
                near[of[u]] = near.get(of[u], 0) + x
            gain = lambda c: near.get(c, 0) - gamma * k[v] * sum(k[u] for u in ids if u != v and of[u] == c) / two_m  # noqa: B023, E731
            best, most = of[v], 0.0
            for c in sorted(near):
                if c != of[v] and gain(c) > most + 1e-12:
                    best, most = c, gain(c)
            if best != of[v] and most > gain(of[v]) + 1e-12:
                of[v], moved = best, True
        now = quality()
        if not moved or abs(now - before) < epsilon:
            break
        before = now
    out, number, left = {}, 0, list(ids)
    while left:
        part, todo = {left[0]}, [left[0]]
        while todo:
            v = todo.pop()
            for u in w.get(v, {}):
                if u not in part and of[u] == of[v]:
                    part.add(u)
                    todo.append(u)
        number += len(part) >= 3
        out |= {v: number if len(part) >= 3 else 0 for v in part}
        left = [v for v in left if v not in part]
    return out


def test_communities_match_moves_over_the_whole_graph(spark):
    rng = random.Random(5)
    for _ in range(6):
        pairs = [(base + rng.randrange(9), base + rng.randrange(9)) for base, n in ((0, 18), (20, 5), (40, 12)) for _ in range(n)]
        ids = sorted({x for p in pairs for x in p} | {90})
        got = {r.id: r.cluster for r in graph.communities(nodes(spark, ids), edges(spark, pairs)).collect()}
        assert got == local_moving(ids, pairs)


def test_communities_of_repeated_nodes_and_edges_to_nowhere(spark):
    pairs = [(1, 2), (2, 3), (1, 3), (3, 4), (4, 5), (5, 6), (4, 6), (1, 70), (70, 71), (80, 2)]
    ids = [1, 1, 2, 3, 4, 5, 6, 6, 90]
    got = sorted(tuple(r) for r in graph.communities(nodes(spark, ids), edges(spark, pairs)).collect())
    assert got == sorted(local_moving(set(ids), [p for p in pairs if {*p} <= {*ids}]).items())


def test_moves_hold_nodes_but_no_edges():
    rng = np.random.default_rng(3)
    n, m = 2000, 1_500_000
    pairs = np.unique(rng.integers(0, n, (m, 2)), axis=0)
    pairs = np.unique(np.sort(pairs[pairs[:, 0] != pairs[:, 1]], axis=1), axis=0)
    both = np.concatenate([pairs, pairs[:, ::-1]])
    both = both[np.lexsort((both[:, 1], both[:, 0]))]

    def batches():
        for k in range(0, len(both), 10_000):
            a, b = both[k : k + 10_000].T
            yield pa.RecordBatch.from_arrays([pa.array(np.zeros(len(a), np.int64)), pa.array(a), pa.array(b), pa.array(np.ones(len(a), np.int64))], ["component", "id", "b", "w"])

    tracemalloc.start()
    rows = sum(x.num_rows for x in graph._moves(batches(), 2.0 * len(pairs), 1.0, 1, 0.0))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert rows == n and len(both) > 1_900_000
    assert peak < 35 * len(both)  # some bounded chunks; dicts took over 100 bytes an edge's end


def test_large_hubs_move_as_others_do():
    rng = random.Random(9)
    n = 60
    w = {}
    for _ in range(400):
        a, b = rng.randrange(n), rng.randrange(n)
        if a != b:
            w.setdefault(a, {}).setdefault(b, 0)
            w[a][b] = w.setdefault(b, {})[a] = w[a][b] + 1
    starts = np.cumsum([0, *[len(w.get(v, {})) for v in range(n)]])
    others = np.array([u for v in range(n) for u in w.get(v, {})], np.int32)
    weights = np.array([x for v in range(n) for x in w.get(v, {}).values()], np.uint32)
    got = [graph._louvain(starts, others, weights, float(weights.sum()), 1.0, 50, 0.0, hub) for hub in (4096, 10, 0)]
    assert all(g[0].tolist() == got[0][0].tolist() and g[1] == got[0][1] for g in got)
    assert len(set(got[0][0].tolist())) < n / 2


def test_packed_nodes_move_as_single_edges_do():
    rng = np.random.default_rng(4)
    pairs = np.unique(np.sort(rng.integers(0, 300, (900, 2)), axis=1), axis=0)
    pairs = np.concatenate([pairs[pairs[:, 0] != pairs[:, 1]], [(999, k) for k in range(40)]])
    both = np.concatenate([pairs, pairs[:, ::-1]])
    both = both[np.lexsort((both[:, 1], both[:, 0]))]
    names, w = ["component", "id", "b", "w"], rng.integers(1, 4, 1000)
    weights = pa.array([int(w[(a * b) % 1000]) for a, b in both] + [None], pa.int64())
    columns = [pa.array(np.zeros(len(both) + 1, np.int64)), pa.array([*both[:, 0], 1234]), pa.array([*both[:, 1], None], pa.int64()), weights]
    rows = [pa.RecordBatch.from_arrays([c.slice(k, 64) for c in columns], names) for k in range(0, len(both) + 1, 64)]
    packed = list(graph._packed(iter(rows)))
    known = len({*both[:, 0].tolist()}) + 1
    assert known <= sum(x.num_rows for x in packed) <= known + len(rows)  # a node is one row, and one more where a batch ends inside it
    got = [[r for x in graph._moves(iter(b), 2.0 * len(pairs), 1.0, 50, 0.0) for r in x.to_pylist()] for b in (rows, packed)]
    assert got[0] == got[1] and len(got[0]) == known


def test_passes_in_which_little_moves_look_at_few_nodes(monkeypatch):
    n, seen = 60_000, []
    starts, ids = np.arange(0, 5 * n + 1, 5), np.arange(n)
    others = np.stack([ids // 6 * 6 + (ids + k) % 6 for k in range(1, 6)], axis=1).ravel().astype(np.int32)
    monkeypatch.setattr(graph, "Counter", lambda x, count=graph.Counter: seen.append(1) or count(x))
    part, gained = graph._louvain(starts, others, np.ones(5 * n, np.uint32), 5.0 * n, 1.0, 5, 0.0)
    assert part.tolist() == (ids // 6 + 1).tolist() and len(gained) == 1
    assert len(seen) < 1.5 * n  # two passes


def test_stars_join_what_their_pairs_joined():
    rng = np.random.default_rng(2)
    pairs = rng.integers(0, 500, (5000, 2)) // 7 * 7 + rng.integers(0, 2, (5000, 1))
    ids, where = np.unique(pairs, return_inverse=True)
    where = where.reshape(pairs.shape)
    for most in (1 << 20, 300, 10):
        batches = (pa.RecordBatch.from_arrays([pa.array(x) for x in pairs[k : k + 100].T], ["a", "b"]) for k in range(0, 5000, 100))
        stars = [r for x in graph._forest(batches, most) for r in zip(*(c.to_pylist() for c in x.columns), strict=True)]
        a, b = np.searchsorted(ids, np.array(stars).T)
        assert graph._least(len(ids), a, b).tolist() == graph._least(len(ids), where[:, 0], where[:, 1]).tolist()
        assert len(stars) < len(ids) or most < 1000
    assert list(graph._forest(iter([]))) == []


def test_pagerank_matches_a_loop(spark):
    rng = random.Random(6)
    for _ in range(3):
        pairs = [(rng.randrange(12), rng.randrange(12)) for _ in range(25)]
        ids = list(range(14))
        out = {i: {b for a, b in pairs if a == i and b != i} for i in ids}
        rank = {i: 1 / 14 for i in ids}
        for _ in range(5):
            loose = sum(rank[i] for i in ids if not out[i])
            rank = {i: (0.15 + 0.85 * loose) / 14 + 0.85 * sum(rank[j] / len(out[j]) for j in ids if i in out[j]) for i in ids}
        assert ranks(spark, ids, pairs, iterations=5, epsilon=0) == pytest.approx(rank)


def test_connected_matches_union_find(spark):
    rng = random.Random(0)
    pairs = [(rng.randrange(80), rng.randrange(80)) for _ in range(60)] + [(k, k + 1) for k in range(100, 140)]
    ids = sorted({x for p in pairs for x in p})
    label = {i: i for i in ids}
    for _ in ids:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert {r.id: r.component for r in graph.connected(nodes(spark, ids), edges(spark, pairs)).collect()} == label


def reached(pairs):
    """By node: the nodes that it reaches, itself included."""
    out, near = {}, {}
    for a, b in pairs:
        near.setdefault(a, set()).add(b)
        near.setdefault(b, set())
    for v in near:
        out[v], todo = {v}, [v]
        while todo:
            new = near[todo.pop()] - out[v]
            out[v] |= new
            todo += new
    return out


def test_components_and_blast_against_all_pairs(spark):
    rng = random.Random(1)
    ring = [(100 + k, 100 + (k + 1) % 16) for k in range(16)]
    chain = [(200 + k, 201 + k) for k in range(5)]
    pairs = [(rng.randrange(30), rng.randrange(30)) for _ in range(38)] + ring + chain + [(3, 107), (110, 200), (205, 4)]
    ends = reached([(a, b) for a, b in pairs if a != b])
    e = edges(spark, [*pairs, pairs[0]])
    parts = settle(components.strong_components(e))
    got = {r.id: r.component for r in parts.collect()}
    assert got == {v: min(u for u in ends[v] if v in ends[u]) for v in ends} and len(set(got.values())) < len(got) - 15
    got = {r.id: r.importers for r in components.blast_counts(e, parts=parts).collect()}
    assert got == {v: sum(v in ends[u] for u in ends) - 1 for v in ends}


def test_components_by_pieces_and_by_colours(spark, monkeypatch):
    rng = random.Random(3)
    pairs = [(base + rng.randrange(20), base + rng.randrange(20)) for base in (0, 50, 100) for _ in range(45)] + [(200 + k, 200 + (k * 7 + s) % 40) for k in range(40) for s in (1, 2)]
    ends = reached([(a, b) for a, b in pairs if a != b])
    want = {v: min(u for u in ends[v] if v in ends[u]) for v in ends}
    coloured, rounds = components._coloured, []
    monkeypatch.setattr(components, "_coloured", lambda e: rounds.append(e.count()) or coloured(e))
    for whole in (None, 70, 0):
        rounds.clear()
        assert {r.id: r.component for r in components.strong_components(edges(spark, pairs), whole).collect()} == want
        # All at once; the pieces of up to 70 edges in tasks and only the last by colours; all by colours.
        assert len(rounds) == 0 if whole is None else 70 < rounds[0] <= 80 if whole else rounds[0] > 80


def test_blast_of_cycles_takes_no_rounds_for_its_components(spark, monkeypatch):
    rng = random.Random(6)
    pairs = [(rng.randrange(40), rng.randrange(40)) for _ in range(60)] + [(100 + k, 100 + (k + 1) % 30) for k in range(30)] + [(3, 100)]
    ends = reached([(a, b) for a, b in pairs if a != b])
    calls, settled = [], components.settle
    monkeypatch.setattr(components, "settle", lambda df: calls.append(1) or settled(df))
    assert {r.id: r.importers for r in components.blast_counts(edges(spark, pairs)).collect()} == {v: sum(v in ends[u] for u in ends) - 1 for v in ends}
    assert len(calls) < 12  # edges, nodes and components; the pairs' own rounds are those of reach


def test_walk_finds_components_of_long_ways():
    n = 50_000
    assert set(components._roots(list(range(n + 1)), [*range(1, n), 0])) == {0}
    assert components._roots([*range(n), n - 1], list(range(1, n))) == list(range(n))
    rng = random.Random(8)
    for _ in range(40):
        to = [sorted({rng.randrange(25) for _ in range(rng.randrange(3))}) for _ in range(25)]
        ends = reached([(a, b) for a in range(25) for b in to[a]])
        starts = [sum(map(len, to[:v])) for v in range(26)]
        root = components._roots(starts, [u for x in to for u in x])
        assert all((root[a] == root[b]) == (a == b or b in ends.get(a, ()) and a in ends[b]) for a in range(25) for b in range(25))


def test_components_of_nulls_loops_and_nothing(spark):
    assert components.strong_components(edges(spark, [])).collect() == []
    got = components.strong_components(edges(spark, [(1, 1), (None, 2), (3, None), (4, 5), (5, 4), (4, 5)])).collect()
    assert sorted(map(tuple, got)) == [(4, 4), (5, 4)]
    assert sorted(map(tuple, components.blast_counts(edges(spark, [(1, 2), (2, 3), (3, 4)]), 2).collect())) == [(1, 0), (2, 1), (3, 2), (4, 2)]


def test_blast_walks_only_through_what_is_imported(spark, monkeypatch):
    walked, reach = [], components.reach
    monkeypatch.setattr(components, "reach", lambda e, seeds, *more: walked.append((e.count(), seeds.count())) or reach(e, seeds, *more))
    tree = [(100 + k, 10 + k % 3) for k in range(50)] + [(100, 11), (100, 1), (10, 1), (11, 1), (12, 1)]
    for pairs in (tree, [*tree, (200, 201), (201, 200), (201, 12), (1, 2), (2, 1)]):
        ends = reached(pairs)
        assert {r.id: r.importers for r in components.blast_counts(edges(spark, pairs)).collect()} == {v: sum(v in ends[u] for u in ends) - 1 for v in ends}
    assert walked == [(3, 4), (3, 4)]
