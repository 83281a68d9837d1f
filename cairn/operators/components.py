"""Strongly connected components, and how many nodes reach each node."""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark.sql import DataFrame, functions as F

from cairn.functions.session import settle
from cairn.operators.graph import _joined, clean_edges, reach, reverse

#: Fixed value: pieces of a graph with no more edges than this are worked on whole, each by one task.
WHOLE = 1 << 20

#: A round of shedding is followed by another while it leaves no more than this share of the edges; the colours take whatever is left.
PAYS = 0.9


def _shed(edges: DataFrame) -> DataFrame:
    """The edges between nodes that have edges both in and out: only those can lie on a cycle."""
    both = edges.select(F.col("src").alias("id")).intersect(edges.select("dst"))
    return edges.join(both.select(F.col("id").alias("src")), "src", "left_semi").join(both.select(F.col("id").alias("dst")), "dst", "left_semi")


def _links(edges: DataFrame, turn: int) -> DataFrame:
    """(id, before, after) of some nodes with one edge in and one out, no two of them next to each other. Each turn has its own order, so a third goes on average."""
    into = edges.groupBy(F.col("dst").alias("id")).agg(F.count("*").alias("n"), F.min("src").alias("before")).where("n = 1").drop("n")
    out = edges.groupBy(F.col("src").alias("id")).agg(F.count("*").alias("n"), F.min("dst").alias("after")).where("n = 1").drop("n")
    single = into.join(out, "id").withColumn("turn", F.xxhash64("id", F.lit(turn)))
    near = single.select(F.col("id").alias("near"), F.col("turn").alias("near_turn"))
    # A node goes if its turn comes before that of each neighbour that could go, too; a tie of hashes is settled by id.
    later = single.join(near.withColumnsRenamed({"near": "before", "near_turn": "t1"}), "before", "left").join(near.withColumnsRenamed({"near": "after", "near_turn": "t2"}), "after", "left")
    mine = F.struct("turn", "id")
    first = [F.col(t).isNull() | (mine < F.struct(F.col(t).alias("turn"), F.col(end).alias("id"))) for t, end in (("t1", "before"), ("t2", "after"))]
    return later.where(first[0] & first[1]).select("id", "before", "after")


def _coloured(edges: DataFrame) -> DataFrame:
    """(id, colour): the least node that reaches each node of the edges; only nodes whose colour changed send it on."""
    nodes = edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct()
    colours = moved = settle(nodes.withColumn("colour", F.col("id")))
    while not moved.isEmpty():
        given = edges.join(moved.withColumnRenamed("id", "src"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("colour").alias("given"))
        new = settle(colours.join(given, "id", "left").select("id", F.least("colour", "given").alias("colour"), F.coalesce(F.col("given") < F.col("colour"), F.lit(False)).alias("moved")))
        colours, moved = new.select("id", "colour"), new.where("moved").select("id", "colour")
    return colours


def _roots(starts: list[int], to: list[int]) -> list[int]:
    """For each node a node of its strong component, the same for all of them; node v's edges lead to to[starts[v] : starts[v + 1]]. Tarjan's walk, without recursion."""
    n = len(starts) - 1
    met, low, root, after, open_, count = [0] * n, [0] * n, [-1] * n, starts[:-1], [], 0
    for first in range(n):
        way = [] if met[first] else [first]
        while way:
            v = way[-1]
            if not met[v]:
                count += 1
                met[v] = low[v] = count
                open_.append(v)
            if after[v] < starts[v + 1]:
                u = to[after[v]]
                after[v] += 1
                if not met[u]:
                    way.append(u)
                elif root[u] < 0 and met[u] < low[v]:
                    low[v] = met[u]
                continue
            way.pop()
            if way and low[v] < low[way[-1]]:
                low[way[-1]] = low[v]
            while low[v] == met[v] and root[v] < 0:
                root[open_.pop()] = v
    return root


def _whole(batches):
    """From rows (piece, src, dst), ordered by piece: batches of (id, component), for one piece after the other."""
    import pyarrow as pa

    def worked(held: list):
        src, dst = (np.concatenate(x) for x in zip(*held, strict=True))
        ids, at = np.unique(np.concatenate([src, dst]), return_inverse=True)
        order = np.argsort(at[: len(src)], kind="stable")
        starts = np.searchsorted(at[: len(src)][order], np.arange(len(ids) + 1))
        root = np.array(_roots(starts.tolist(), at[len(src) :][order].tolist()))
        least = np.arange(len(ids))
        np.minimum.at(least, root, np.arange(len(ids)))
        return pa.RecordBatch.from_arrays([pa.array(ids), pa.array(ids[least[root]])], ["id", "component"])

    now, held = None, []
    for batch in batches:
        piece, src, dst = (x.to_numpy() for x in batch.columns)
        cuts = [0, *(np.flatnonzero(piece[1:] != piece[:-1]) + 1).tolist(), len(piece)] if len(piece) else []
        for i, j in zip(cuts, cuts[1:], strict=False):
            if held and piece[i] != now:
                yield worked(held)
                held = []
            now = piece[i]
            held.append((src[i:j], dst[i:j]))
    if held:
        yield worked(held)


def _pieces(edges: DataFrame, n: int, whole: int) -> tuple[DataFrame | None, DataFrame]:
    """(id, component) of those pieces of n edges that have `whole` edges or less, and the edges of the others. Nothing leads from one piece to another."""
    schema = "id long, component long"
    if n <= whole:
        return settle(edges.select(F.lit(0).cast("long").alias("piece"), "src", "dst").coalesce(1).mapInArrow(_whole, schema)), edges.limit(0)
    nodes = settle(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    piece = _joined(nodes, edges.select(F.col("src").alias("a"), F.col("dst").alias("b"))).select(F.col("id").alias("src"), F.col("component").alias("piece"))
    edges = settle(edges.join(piece, "src").select("piece", "src", "dst"))
    large = settle(edges.groupBy("piece").count().where(F.col("count") > whole).select("piece"))
    small = edges.join(large, "piece", "left_anti").repartition("piece").sortWithinPartitions("piece")
    return settle(small.mapInArrow(_whole, schema)), settle(edges.join(large, "piece", "left_semi").select("src", "dst"))


def strong_components(edges: DataFrame, whole: int | None = None) -> DataFrame:
    """(id, component): the least node of those that each node of the edges (src, dst) reaches and is reached by, itself included.

    Nodes off all cycles are shed in rounds, and nodes with one edge in and one out are taken out of their chains (some half of a chain a round), so long chains and
    rings shrink by halves. What is left falls into pieces that no edge joins; those of at most `whole` edges (WHOLE, if not given) are worked on side by side, each whole in
    one task. In larger ones each node takes the least node that reaches it as its colour; what leads back to that node inside the colour is a component,
    and goes. Rows that repeat, loops and nulls do not count; no edges give no rows. Each round reads edges that are left; a task holds at most `whole` of them, the driver none.
    """
    return _components(settle(clean_edges(edges.where("src is not null and dst is not null"))), WHOLE if whole is None else whole)


def _components(edges: DataFrame, whole: int) -> DataFrame:
    """`strong_components` of edges that are clean and settled."""
    nodes = settle(edges.select(F.col("src").alias("id")).union(edges.select("dst")).distinct())
    found, taken, rest, turn = [], [], edges, 0
    left = rest.count()
    while left:
        while left > whole:
            before, turn, rest = left, turn + 1, settle(_shed(rest))
            links = settle(_links(rest, turn))
            if not links.isEmpty():
                taken.append(links)
                ends = links.select("id")
                kept = rest.join(ends.withColumnRenamed("id", "src"), "src", "left_anti").join(ends.withColumnRenamed("id", "dst"), "dst", "left_anti")
                # A ring of two ends in a loop, which is no edge.
                rest = settle(kept.unionByName(links.select(F.col("before").alias("src"), F.col("after").alias("dst"))).where("src <> dst").distinct())
            left = rest.count()
            if left > PAYS * before or not left:
                break
        if not left:
            break
        part, rest = _pieces(rest, left, whole)
        found.append(part)
        if left <= whole or rest.isEmpty():
            break
        colours = _coloured(rest)
        inside = rest.join(colours.select(F.col("id").alias("src"), "colour"), "src").join(colours.select(F.col("id").alias("dst"), F.col("colour").alias("other")), "dst").where("colour = other").select("src", "dst", "colour")
        inside = settle(inside)
        part = frontier = settle(colours.where("id = colour").select("id", F.col("colour").alias("component")))
        while not frontier.isEmpty():
            back = inside.join(frontier.withColumnRenamed("id", "dst"), "dst").select(F.col("src").alias("id"), "component").distinct()
            frontier = settle(back.join(part, ["id", "component"], "left_anti"))
            part = part.unionByName(frontier)
        part = settle(part)
        found.append(part)
        done = part.select("id")
        rest = settle(rest.join(done.withColumnRenamed("id", "src"), "src", "left_anti").join(done.withColumnRenamed("id", "dst"), "dst", "left_anti"))
        left = rest.count()
    out = nodes.withColumn("component", F.col("id"))
    if found:
        out = out.join(reduce(DataFrame.unionByName, found).withColumnRenamed("component", "part"), "id", "left").select("id", F.coalesce("part", "id").alias("component"))
    # Components are named by their least node already, unless a lesser one was taken out of a chain.
    if not taken:
        return out
    out = settle(out)
    # What was taken out of a chain belongs to the component at both its ends, or to none; the last that went comes back first.
    for k, links in enumerate(reversed(taken), 1):
        near = links.join(out.select(F.col("id").alias("before"), F.col("component").alias("a")), "before").join(out.select(F.col("id").alias("after"), F.col("component").alias("b")), "after")
        back = near.where("a = b").select("id", F.col("a").alias("back"))
        out = out.join(back, "id", "left").select("id", F.coalesce("back", "component").alias("component"))
        # The lineage holds `out` three times a round, so it is cut each time but the last.
        out = settle(out) if k < len(taken) else out
    least = out.groupBy("component").agg(F.min("id").alias("least"))
    return out.join(least, "component").select("id", F.col("least").alias("component"))


def blast_counts(edges: DataFrame, max_depth: int | None = None, parts: DataFrame | None = None) -> DataFrame:
    """(id, importers): how many other nodes reach each node that occurs in an edge (src, dst), at any distance or within `max_depth` edges.

    Without a depth, the members of a component share one count: pairs are made of components, not of nodes, so a large cycle costs its size and not its square.
    The pairs of components of the acyclic rest are still as many as their closure holds. `parts` (id, component) are the components of all the edges, if they are known.
    Walks go through components that something imports; those that nothing imports end them, so they take no part in the rounds and are counted once behind them.
    """
    edges = settle(clean_edges(edges.where("src is not null and dst is not null")))
    if max_depth is not None:
        nodes = edges.select(F.col("src").alias("node")).union(edges.select("dst")).distinct()
        seen = reach(reverse(edges), nodes.select(F.col("node").alias("seed"), "node"), max_depth)
        return seen.groupBy(F.col("seed").alias("id")).agg((F.count("*") - 1).alias("importers"))
    parts = settle(_components(edges, WHOLE)) if parts is None else parts
    sizes = settle(parts.groupBy(F.col("component").alias("node")).agg(F.count("*").alias("n")))
    between = edges
    if not sizes.where("n > 1").isEmpty():
        between = edges.join(parts.withColumnsRenamed({"id": "src", "component": "a"}), "src").join(parts.withColumnsRenamed({"id": "dst", "component": "b"}), "dst")
        between = settle(between.where("a <> b").select(F.col("a").alias("src"), F.col("b").alias("dst")).distinct())
    inner = settle(between.select(F.col("dst").alias("node")).distinct())
    through = between.join(inner.withColumnRenamed("node", "src"), "src", "left_semi")
    ends = between.join(inner.withColumnRenamed("node", "src"), "src", "left_anti")
    seen = settle(reach(reverse(through), inner.select(F.col("node").alias("seed"), "node")).select("seed", "node"))
    own = seen.join(sizes, "node").select("seed", "n")
    # A seed that only ends lead to has each of them once; of others' an end is met on several ways.
    alone = seen.groupBy("seed").agg(F.count("*").alias("k")).where("k = 1").select("seed")
    sized = ends if between is edges else ends.join(sizes.withColumnRenamed("node", "src"), "src")
    single = sized.join(alone.withColumnRenamed("seed", "dst"), "dst", "left_semi").withColumnRenamed("dst", "seed")
    many = seen.join(alone, "seed", "left_anti").join(sized.withColumnRenamed("dst", "node"), "node").drop("node").distinct()
    n = F.lit(1) if between is edges else F.col("n")
    met = [own.groupBy("seed").agg(F.sum("n").alias("n")), *(rows.groupBy("seed").agg(F.sum(n).cast("long").alias("n")) for rows in (single, many))]
    counts = reduce(DataFrame.unionByName, met).groupBy(F.col("seed").alias("component")).agg((F.sum("n") - 1).alias("importers"))
    # What nothing imports is reached by its own component only.
    first = parts.join(sizes.withColumnRenamed("node", "component"), "component")
    return first.join(counts, "component", "left").select("id", F.coalesce("importers", F.col("n") - 1).alias("importers"))
