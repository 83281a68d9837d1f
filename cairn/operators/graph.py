"""Graph operators as joins: PageRank, reachability, shortest paths, communities."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from tempfile import TemporaryFile

import numpy as np
from pyspark.sql import DataFrame, Window as W, functions as F

from cairn.functions import scalar as X
from cairn.functions.session import settle


def clean_edges(edges: DataFrame, nodes: DataFrame | None = None) -> DataFrame:
    """Distinct (src, dst) without loops, and only between known nodes if these are given."""
    out = edges.where("src <> dst").select("src", "dst").distinct()
    if nodes is not None:
        known = nodes.select("id").distinct()
        out = out.join(known.withColumnRenamed("id", "src"), "src", "left_semi").join(known.withColumnRenamed("id", "dst"), "dst", "left_semi")
    return out


def pagerank(nodes: DataFrame, edges: DataFrame, iterations: int = 20, damping: float = 0.85, epsilon: float = 1e-5, prior: DataFrame | None = None) -> DataFrame:
    """(id, rank). Loops, repeated and dangling-ended edges do not count; what dangles is shared evenly. Stops when the ranks move less
    than epsilon in all. `prior` (id, rank) starts warm if its ranks sum over 1/2."""
    nodes = settle(nodes.select("id").distinct())
    n = nodes.count()
    if n == 0:
        return nodes.withColumn("rank", F.lit(0.0))
    edges = clean_edges(edges, nodes)
    out = edges.groupBy("src").agg(F.count("*").alias("degree"))
    edges = settle(edges.join(out, "src"))
    ranks = nodes.join(out.withColumnRenamed("src", "id"), "id", "left").withColumn("dangles", F.col("degree").isNull()).drop("degree")
    even = F.lit(1.0 / n)
    if prior is not None and (prior.agg(F.sum("rank")).first()[0] or 0) > 0.5:
        ranks = ranks.join(prior, "id", "left").select("id", "dangles", F.when(F.col("rank") > 0, F.col("rank")).otherwise(even).alias("rank"))
    else:
        ranks = ranks.withColumn("rank", even)
    ranks = settle(ranks)
    loose = F.coalesce(F.sum(F.when(F.col("dangles"), F.col("rank"))), F.lit(0.0))
    dangling = ranks.agg(loose).first()[0]
    for _ in range(iterations):
        given = edges.join(ranks.select(F.col("id").alias("src"), "rank"), "src").groupBy(F.col("dst").alias("id")).agg(F.sum(F.col("rank") / F.col("degree")).alias("given"))
        base = (1 - damping) / n + damping * dangling / n
        new = ranks.join(given, "id", "left").select("id", "dangles", F.col("rank").alias("old"), (F.lit(base) + damping * F.coalesce("given", F.lit(0.0))).alias("rank"))
        new = settle(new)
        # One look at the new ranks gives both what moved and what the next step shares out.
        moved, dangling = new.agg(F.sum(F.abs(F.col("rank") - F.col("old"))), loose).first()
        ranks = new.select("id", "dangles", "rank")
        if moved < epsilon:
            break
    return ranks.select("id", "rank")


def reach(edges: DataFrame, seeds: DataFrame, max_depth: int | None = None) -> DataFrame:
    """(seed, node, depth) over edges (src, dst) from seeds (seed, node), seeds included at depth 0: only the last frontier is joined on."""
    edges = settle(clean_edges(edges))
    seen = settle(seeds.select("seed", "node").distinct().withColumn("depth", F.lit(0)))
    frontier, depth = seen, 0
    while max_depth is None or depth < max_depth:
        depth += 1
        found = frontier.join(edges, frontier.node == edges.src).select("seed", F.col("dst").alias("node")).distinct()
        frontier = settle(found.join(seen, ["seed", "node"], "left_anti").withColumn("depth", F.lit(depth)))
        if frontier.isEmpty():
            break
        seen = settle(seen.unionByName(frontier)) if depth % 4 == 0 else seen.unionByName(frontier)
    return seen


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def blast_of(edges: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, node, direct) of the nodes that reach each target (id)."""
    seen = reach(reverse(edges), targets.select(F.col("id").alias("seed"), F.col("id").alias("node")))
    return seen.where("seed <> node").select(F.col("seed").alias("target"), "node", (F.col("depth") == 1).alias("direct"))


def shortest_paths(edges: DataFrame, sources: DataFrame, max_depth: int = 25) -> DataFrame:
    """(node, dist, paths, pred) from any source (id): number of shortest paths and the least predecessor on one."""
    edges = settle(clean_edges(edges))
    seen = settle(sources.select(F.col("id").alias("node")).distinct().select("node", F.lit(0).alias("dist"), F.lit(1).cast("long").alias("paths"), F.lit(None).cast("long").alias("pred")))
    frontier = seen
    for depth in range(1, min(max(max_depth, 1), 50) + 1):
        found = frontier.join(edges, frontier.node == edges.src).groupBy("dst").agg(F.sum("paths").alias("paths"), F.min("node").alias("pred"))
        found = found.join(seen.select(F.col("node").alias("dst")), "dst", "left_anti")
        frontier = settle(found.select(F.col("dst").alias("node"), F.lit(depth).alias("dist"), "paths", "pred"))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


def path_to(edges: DataFrame, sources: DataFrame, targets: DataFrame, max_depth: int = 25, kinds: list[str] | None = None) -> DataFrame:
    """One row, or none: the nearest target (id) that sources (id) reach: target, dist, path and alternatives, the number of other shortest paths to
    targets at that distance. Ties go to the least target, the path takes least predecessors. `kinds` keeps edges of some kinds only.

    Levels end at the first that holds a target; the path is found by one join a level, backwards.
    """
    if kinds is not None:
        edges = edges.where(F.col("kind").isin(kinds))
    edges = settle(clean_edges(edges))
    level = settle(sources.select(F.col("id").alias("node")).distinct().select("node", F.lit(1).cast("long").alias("paths"), F.lit(None).cast("long").alias("pred")))
    goal, levels, seen = targets.select(F.col("id").alias("node")).distinct(), [level], level.select("node")
    hit = level.join(goal, "node", "left_semi")
    for _ in range(min(max(max_depth, 1), 50)):
        if not hit.isEmpty():
            break
        found = levels[-1].join(edges, F.col("node") == edges.src).groupBy("dst").agg(F.sum("paths").alias("paths"), F.min("node").alias("pred"))
        level = settle(found.select(F.col("dst").alias("node"), "paths", "pred").join(seen, "node", "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = seen.unionByName(level.select("node"))
        hit = level.join(goal, "node", "left_semi")
    best = hit.agg(F.min("node").alias("target"), (F.sum("paths") - 1).alias("alternatives")).where("target is not null")
    walk = best.select("target", "alternatives", F.lit(len(levels) - 1).alias("dist"), F.col("target").alias("at"), F.array("target").alias("path"))
    for level in reversed(levels[1:]):
        step = level.select(F.col("node").alias("at"), "pred")
        walk = walk.join(step, "at").select("target", "alternatives", "dist", F.col("pred").alias("at"), F.concat(F.array("pred"), "path").alias("path"))
    return walk.select("target", "dist", "path", "alternatives")


def neighbours(edges: DataFrame, pairs: DataFrame, target: int, least: int = 2) -> DataFrame:
    """Nodes next to the target by an edge either way or by a pair seen at least `least` times."""
    near = edges.where(F.col("src") == target).select(F.col("dst").alias("id")).union(edges.where(F.col("dst") == target).select("src"))
    often = pairs.where(F.col("count") >= least)
    near = near.union(often.where(F.col("file_a") == target).select("file_b")).union(often.where(F.col("file_b") == target).select("file_a"))
    return near.where(F.col("id") != target).distinct()


def induced(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """Edges with both ends among the nodes (id)."""
    return edges.join(nodes.select(F.col("id").alias("src")), "src", "left_semi").join(nodes.select(F.col("id").alias("dst")), "dst", "left_semi")


def undirected(edges: DataFrame) -> DataFrame:
    """(a, b, w) with a < b: how many directed edges join the two."""
    return edges.where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.count("*").cast("double").alias("w"))


def modularity(edges: DataFrame, clusters: DataFrame, gamma: float = 1.0) -> DataFrame:
    """One row: the modularity of clusters (id, cluster), over pairs that share an edge."""
    w = undirected(edges)
    both = w.select("a", "b", "w").union(w.select("b", "a", "w"))
    degree = both.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    total = degree.agg(F.sum("k").alias("two_m"))
    left = clusters.join(degree, "id").select(F.col("id").alias("a"), F.col("cluster").alias("ca"), F.col("k").alias("ka"))
    right = left.select(F.col("a").alias("b"), F.col("ca").alias("cb"), F.col("ka").alias("kb"))
    inner = both.join(left, "a").join(right, "b").where("ca = cb").join(F.broadcast(total))  # one row
    return inner.agg(F.coalesce(F.sum((F.col("w") - gamma * F.col("ka") * F.col("kb") / F.col("two_m")) / F.col("two_m")), F.lit(0.0)).alias("modularity"))


class _Numbers:
    """Whole numbers of one type, appended in chunks; more than `most` of them go to a file without a name, so that they need no memory of the task's."""

    def __init__(self, kind: type, most: int = 1 << 20):
        self.kind, self.most, self.held, self.n, self.file = kind, most, [], 0, None

    def add(self, x: np.ndarray) -> None:
        self.held.append(x.astype(self.kind))
        self.n += len(x)
        if sum(map(len, self.held)) > self.most:
            self.file = self.file or TemporaryFile()
            self._write()

    def _write(self) -> None:
        for x in self.held:
            x.tofile(self.file)
        self.file.flush()
        self.held = []

    def array(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate([np.zeros(0, self.kind), *self.held])
        self._write()
        return np.memmap(self.file, self.kind, "r", shape=(self.n,)).view(np.ndarray)


def _stretches(starts: np.ndarray, most: int = 1 << 17) -> Iterator[tuple[int, int]]:
    """Nodes from and to, with `most` neighbours together or one node."""
    lo, n = 0, len(starts) - 1
    while lo < n:
        hi = max(lo + 1, int(np.searchsorted(starts, starts[lo] + most, "right")) - 1)
        yield lo, min(hi, n)
        lo = hi


def _least(n: int, u: np.ndarray, v: np.ndarray) -> np.ndarray:
    """For each of n nodes the least that pairs (u, v) join it with, by hooking to the lesser end and jumping."""
    label, apart = np.arange(n), True
    while apart:
        apart = False
        for k in range(0, len(u), 1 << 18):
            a, b = label[u[k : k + (1 << 18)]], label[v[k : k + (1 << 18)]]
            if (differ := a != b).any():
                apart = True
                np.minimum.at(label, np.maximum(a, b)[differ], np.minimum(a, b)[differ])
        while not ((further := label[label]) == label).all():
            label = further
    return label


def _groups(at: np.ndarray, u: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The communities next to a node with neighbours u, and the weight to each; some neighbours at a time."""
    some, heavy = [], []
    for k in range(0, len(u), 1 << 17):
        c, where = np.unique(at[u[k : k + (1 << 17)]], return_inverse=True)
        some.append(c)
        heavy.append(np.bincount(where, w[k : k + (1 << 17)]))
    if len(some) == 1:
        return some[0], heavy[0]
    c, where = np.unique(np.concatenate(some), return_inverse=True)
    return c, np.bincount(where, np.concatenate(heavy))


def _slack(lens: np.ndarray, own: np.ndarray, c: np.ndarray, w: np.ndarray | None, share: np.ndarray, degree: np.ndarray, mass: np.ndarray, two_m: float) -> tuple[np.ndarray, ...]:
    """By how much staying beats the best move, for nodes side by side with `lens` neighbours each, in communities c; less what rounding may hide. Also pairs of a node and a community next to it."""
    n, rows = len(mass), np.arange(len(lens))
    key = np.repeat(rows, lens) * n + c
    if w is None:
        key.sort()
    else:
        order = np.argsort(key)
        key, w = key[order], w[order]
    cut = np.flatnonzero(np.append(True, key[1:] != key[:-1])[: len(key)])
    x = np.diff(np.append(cut, len(key))) if w is None else np.add.reduceat(w.astype(np.int64), cut) if len(cut) else cut
    r, c = np.divmod(key[cut], n)
    mine = c == own[r]
    gain = np.where(mine, -np.inf, x - share[r] * mass[c] / two_m)
    most, inside = np.full(len(lens), -np.inf), np.zeros(len(lens))
    np.maximum.at(most, r, gain)
    inside[r[mine]] = x[mine]
    return np.maximum(inside - share * (mass[own] - degree) / two_m, 0) - most - 1e-9 * (1 + degree), r, c


def _waiting(open_: np.ndarray) -> Iterator[int]:
    """Where `open_` is set, in order; it may be set further on in the meantime."""
    v = 0
    while v < len(open_):
        v += int(open_[v:].argmax())
        if not open_[v]:
            return
        yield v
        v += 1


def _louvain(starts: np.ndarray, others: np.ndarray, weights: np.ndarray, two_m: float, gamma: float, passes: int, epsilon: float, hub: int = 256) -> tuple[np.ndarray, list[float]]:
    """Single-level local moving in node order, by the whole graph's weight `two_m`: a node moves to the neighbouring community of the greatest gain,
    if that is positive and more than staying gives; ties go to the smallest community. Ends behind a pass that gains less than `epsilon`. Split communities
    come apart; ids run from 1 in node order. Also the modularity that each pass gained.

    Node v's neighbours are others[starts[v] : starts[v + 1]]; they are read in order, a stretch at a time, and only the nodes' own state is held. Once few nodes move,
    a stretch is judged at once, and only those are looked at that would move, that have a neighbour which moved, or that may be swayed by what a community won or lost in the stretch so far."""
    n = len(starts) - 1
    degrees = np.zeros(n, np.int64)
    for lo, hi in _stretches(starts):
        upto = np.concatenate([[0], np.cumsum(weights[starts[lo] : starts[hi]], dtype=np.int64)])[starts[lo : hi + 1] - starts[lo]]
        degrees[lo:hi] = np.diff(upto)
    at, mass = np.arange(n, dtype=np.int32), degrees.copy()
    of, weight = list(range(n)), degrees.tolist()
    gained: list[float] = []
    # Single edges to communities of different weights differ in gain by more than rounding takes away.
    fine, calm = bool(two_m) and gamma / two_m > 1e-11 * max(1.0, gamma), False
    for _ in range(passes if two_m else 0):
        moves, sum_ = 0, 0.0
        for lo, hi in _stretches(starts):
            first, ends = int(starts[lo]), (starts[lo : hi + 1] - starts[lo]).tolist()
            large = ends[-1] > max(hub, 1 << 17)
            u, w = others[first : first + ends[-1]], weights[first : first + ends[-1]]
            ones = bool((w == 1).all())
            order, degree, drift, before = range(hi - lo), degrees[lo:hi].tolist(), 0, moves
            judged = calm and not large
            if judged:
                sway = 2 * gamma * degrees[lo:hi] / two_m
                slack, beside, community = _slack(np.diff(starts[lo : hi + 1]), at[lo:hi], at[u], None if ones else w, gamma * degrees[lo:hi], degrees[lo:hi], mass, two_m)
                open_ = slack <= 0
                order = _waiting(open_)
            if not large:
                nodes, heavy = None, None if ones else w.tolist()
            for k in order:
                i, j = ends[k], ends[k + 1]
                if i == j:
                    continue
                v, own, share = lo + k, of[lo + k], gamma * degree[k]
                left = weight[own] - degree[k]
                best, most = own, 0.0
                if large or j - i > hub:
                    some, x = _groups(at, u[i:j], w[i:j])
                    mine = some == own
                    stay = float(x[mine][0] if mine.any() else 0) - share * left / two_m
                    gain = np.where(mine, -np.inf, x - share * mass[some] / two_m)
                    if (top := float(gain.max())) > 0:
                        best, most = int(some[gain == top].min()), top
                else:
                    if nodes is None:
                        nodes = u.tolist()
                    near = list(map(of.__getitem__, nodes[i:j]))
                    if ones and fine and len(kinds := {*near, own}) > j - i:
                        weighs = list(map(weight.__getitem__, near))
                        light = min(weighs)
                        stay, top = 0 - share * left / two_m, 1 - share * light / two_m
                        if top > 0:
                            best, most = near[weighs.index(light)] if weighs.count(light) == 1 else min(c for c, x in zip(near, weighs, strict=True) if x == light), top
                    else:
                        if ones:
                            kinds = Counter(near)
                        else:
                            kinds = {}
                            for c, x in zip(near, heavy[i:j], strict=True):
                                kinds[c] = kinds.get(c, 0) + x
                        stay = kinds.get(own, 0) - share * left / two_m
                        for c, x in kinds.items():
                            gain = x - share * weight[c] / two_m
                            if gain >= most and c != own and (gain > most or best != own and c < best):
                                best, most = c, gain
                if best == own or most <= stay:
                    continue
                weight[own] = mass[own] = left
                weight[best] = mass[best] = weight[best] + degree[k]
                of[v] = at[v] = best
                moves, sum_ = moves + 1, sum_ + 2 * (most - stay) / two_m
                if judged:
                    if not drift:
                        by = np.argsort(community)
                        beside, community = beside[by], community[by]
                    drift += degree[k]
                    for c in (own, best):
                        swayed = beside[np.searchsorted(community, c) : np.searchsorted(community, c, "right")]
                        swayed = np.append(swayed, np.flatnonzero(at[lo:hi] == c))
                        open_[swayed[slack[swayed] <= sway[swayed] * drift]] = True
                    open_[(near := u[i:j])[(near > v) & (near < hi)] - lo] = True
            calm = (moves - before) * 8 < hi - lo
        if not moves:
            break
        gained.append(sum_)
        if sum_ < epsilon:
            break
    ends = _Numbers(np.int32), _Numbers(np.int32)
    for lo, hi in _stretches(starts):
        for k in range(int(starts[lo]), int(starts[hi]), 1 << 17):
            u = others[k : min(k + (1 << 17), int(starts[hi]))]
            v = np.searchsorted(starts[lo : hi + 1], np.arange(k, k + len(u)), "right") + lo - 1
            inside = (at[u] == at[v]) & (u < v)
            ends[0].add(u[inside])
            ends[1].add(v[inside])
    least = _least(n, ends[0].array(), ends[1].array())
    return np.unique(least, return_inverse=True)[1].astype(np.int32) + 1, gained


def _packed(batches):
    """From rows (component, id, b, w), ordered by component and id: rows (component, id, b, w) with lists, one or more a node, none of a hub longer than a batch."""
    import pyarrow as pa

    for batch in batches:
        component, id_ = (batch.column(k).to_numpy() for k in (0, 1))
        if not len(id_):
            continue
        cut = np.flatnonzero(np.append(True, (id_[1:] != id_[:-1]) | (component[1:] != component[:-1])))
        upto = np.append(0, np.cumsum(batch.column(2).is_valid().to_numpy(zero_copy_only=False)))
        starts = pa.array(upto[np.append(cut, len(id_))].astype(np.int32))
        lists = [pa.ListArray.from_arrays(starts, batch.column(k).drop_null()) for k in (2, 3)]
        yield pa.RecordBatch.from_arrays([pa.array(component[cut]), pa.array(id_[cut]), *lists], ["component", "id", "b", "w"])


def _moves(batches, two_m: float, gamma: float, passes: int, epsilon: float):
    """From rows (component, id, b, w), ordered by component and id, with each edge at both ends and b null at a node without any, or with lists b and w: batches of
    (component, id, part, gained), with `gained` in a component's first row."""
    import pyarrow as pa

    def worked(component: int, ids: np.ndarray, starts: np.ndarray, b: np.ndarray, w: np.ndarray):
        others, span = _Numbers(np.int32), int(ids[-1] - ids[0]) + 1
        # Ids that lie close together are looked up in a table.
        table = None
        if span <= 16 * len(ids):
            table = np.zeros(span, np.int32)
            table[ids - ids[0]] = np.arange(len(ids))
        for k in range(0, len(b), 1 << 18):
            some = b[k : k + (1 << 18)]
            others.add(np.searchsorted(ids, some) if table is None else table[some - ids[0]])
        del table
        part, gained = _louvain(np.append(starts, len(b)), others.array(), w, two_m, gamma, passes, epsilon)
        for k in range(0, len(ids), 1 << 16):
            own = ids[k : k + (1 << 16)]
            first = [gained if k == 0 else None, *[None] * (len(own) - 1)]
            columns = [pa.array(np.full(len(own), component)), pa.array(own), pa.array(part[k : k + (1 << 16)]), pa.array(first, pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays(columns, ["component", "id", "part", "gained"])

    now, last = None, None
    for batch in batches:
        component, id_ = (batch.column(k).to_numpy() for k in (0, 1))
        b, w = batch.column(2), batch.column(3)
        if pa.types.is_list(b.type):
            upto = np.append(0, np.cumsum(b.value_lengths().to_numpy()))
            b, w = b.flatten().to_numpy(), w.flatten().to_numpy()
        else:
            upto = np.append(0, np.cumsum(b.is_valid().to_numpy(zero_copy_only=False)))
            b, w = b.drop_null().to_numpy(), w.drop_null().to_numpy()
        cuts = [0, *(np.flatnonzero(component[1:] != component[:-1]) + 1).tolist(), len(component)] if len(component) else []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if component[i] != now:
                if now is not None:
                    yield from worked(now, *(x.array() for x in columns))
                now, last, columns = int(component[i]), None, [_Numbers(np.int64), _Numbers(np.int64), _Numbers(np.int64), _Numbers(np.uint32)]
            own = id_[i:j]
            new = np.concatenate([[last is None or own[0] != last], own[1:] != own[:-1]])
            columns[0].add(own[new])
            columns[1].add((columns[2].n + upto[i:j] - upto[i])[new])
            columns[2].add(b[upto[i] : upto[j]])
            columns[3].add(w[upto[i] : upto[j]])
            last = own[-1]
    if now is not None:
        yield from worked(now, *(x.array() for x in columns))


def _forest(batches, most: int = 1 << 20):
    """From pairs (a, b): pairs of each node with the least one that the task's pairs join it with; so many pairs at a time, and at the end once more."""
    import pyarrow as pa

    def stars(pairs: list) -> list:
        a, b = (np.concatenate(x) for x in zip(*pairs, strict=True))
        ids, where = np.unique(np.concatenate([a, b]), return_inverse=True)
        least = _least(len(ids), where[: len(a)], where[len(a) :])
        far = least != np.arange(len(ids))
        return [(ids[least[far]], ids[far])]

    held, n, stars_n = [], 0, 0
    for batch in batches:
        held.append(tuple(x.to_numpy() for x in batch.columns))
        n += batch.num_rows
        if n - stars_n >= most:
            held = stars(held)
            n = stars_n = len(held[0][0])
            if n >= most:
                yield pa.RecordBatch.from_arrays([*map(pa.array, held[0])], ["a", "b"])
                held, n, stars_n = [], 0, 0
    for a, b in stars(held) if held else []:
        yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _joined(nodes: DataFrame, pairs: DataFrame) -> DataFrame:
    """`connected` over pairs (a, b) of these nodes: each task first shrinks its pairs to stars."""
    w = pairs.where("a <> b").mapInArrow(_forest, "a long, b long").distinct()
    both = settle(w.union(w.select("b", "a")))
    label = settle(nodes.select("id", F.col("id").alias("component")))
    while True:
        near = both.join(label.withColumnRenamed("id", "b"), "b").groupBy(F.col("a").alias("id")).agg(F.min("component").alias("near"))
        new = label.join(near, "id", "left").select("id", F.col("component").alias("old"), F.least("component", F.coalesce("near", "component")).alias("component"))
        jump = new.select(F.col("id").alias("component"), F.col("component").alias("further"))
        new = settle(new.join(jump, "component").select("id", "old", F.least("component", "further").alias("component")))
        label = new.select("id", "component")
        if new.where("old <> component").isEmpty():
            return label


def connected(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(id, component): the least node that undirected edges reach, by hooking to the least neighbour and jumping."""
    return _joined(nodes, induced(edges, nodes).select(F.col("src").alias("a"), F.col("dst").alias("b")))


def communities(nodes: DataFrame, edges: DataFrame, gamma: float = 1.0, passes: int = 50, epsilon: float = 1e-6, least: int = 3) -> DataFrame:
    """(id, cluster): local moving over the whole graph until a pass gains less than `epsilon` of modularity; clusters below `least` nodes are 0, the others
    are numbered from 1 by their least node. Moves never leave a connected component, so components are worked on side by side; the order of moves
    inside one is part of the result, so a component is one task. Edges count between nodes of `nodes` only. That task holds some numbers a node; the edges lie in a file beside it."""
    nodes = settle(nodes.select("id").distinct())
    # A node's edges lie together, so that a task's stars are few.
    w = settle(undirected(induced(edges, nodes)).repartition("a"))
    component = _joined(nodes, w.select("a", "b"))
    two_m = 2 * (w.agg(F.sum("w")).first()[0] or 0.0)
    both = w.select(F.col("a").alias("id"), "b", "w").union(w.select("b", "a", "w"))
    rows = component.join(both, "id", "left").select("component", "id", "b", F.col("w").cast("int").alias("w"))
    # Nodes with lists of their neighbours go to the component's task, so that it sorts nodes and not edges.
    rows = rows.repartition("component", "id").sortWithinPartitions("component", "id").mapInArrow(_packed, "component long, id long, b array<long>, w array<int>")
    rows = rows.repartition("component").sortWithinPartitions("component", "id")
    # The only component with edges sees by itself when a pass gains too little.
    alone = component.groupBy("component").count().where("count > 1").limit(2).count() < 2

    def moves(most: int):
        return settle(rows.mapInArrow(lambda batches: _moves(batches, two_m, gamma, most, epsilon if alone else 0.0), "component long, id long, part int, gained array<double>"))

    parts = moves(passes)
    # A component does not see that all together gain too little to go on; then the passes up to there count.
    steps = parts.select(F.posexplode("gained").alias("step", "gain")).groupBy("step").agg(F.sum("gain").alias("gain")).where(F.col("gain") < epsilon)
    last = steps.agg(F.min("step")).first()[0]
    if last is not None and parts.where(F.size("gained") > last + 1).limit(1).count():
        parts = moves(last + 1)
    groups = parts.groupBy("component", "part").agg(F.count("*").alias("size"), F.min("id").alias("first"))
    big = groups.where(F.col("size") >= least).withColumn("cluster", F.row_number().over(W.orderBy("first")).cast("long"))
    return parts.join(big.select("component", "part", "cluster"), ["component", "part"], "left").select("id", F.coalesce("cluster", F.lit(0).cast("long")).alias("cluster"))


def unreachable_symbols(symbols: DataFrame, files: DataFrame, refs: DataFrame) -> DataFrame:
    """Functions and methods that references lead to from no root: `main`, exported symbols, files that a framework loads, tests. Symbols with their path."""
    rows = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    is_root = (F.col("name") == "main") | F.col("is_exported") | X.is_framework_entry(F.col("path")) | X.is_test_symbol(F.col("name"), F.col("kind"), F.col("path"))
    roots = rows.where(F.coalesce(is_root, F.lit(False))).select(F.lit(0).alias("seed"), F.col("id").alias("node"))
    live = reach(refs.select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst")), roots)
    return rows.where(F.col("kind").isin("function", "method")).join(live.select(F.col("node").alias("id")), "id", "left_anti")
