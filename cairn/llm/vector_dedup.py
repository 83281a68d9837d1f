"""Operator 7, embedding near-dedup by an epsilon grid order join.

Unit vectors with cosine >= c lie within eps = sqrt(2 - 2c) of each other. Vectors are laid out in
epsilon grid order: by the cells (edge eps) of their leading principal coordinates, one coordinate
after the other. The order is cut into blocks at sampled places. Intervals of the block sequence are
joined recursively, an interval pair whose boxes lie further apart than eps is skipped, and inside a
block pair the same recursion runs down to tiles that are multiplied out in double precision.

About sqrt(n / 48) blocks of sqrt(48 n) vectors are formed: the driver holds one box a block. Blocks travel in stretches of
the order, eight or as many as 32 MB each make: every stretch goes once to each stretch that it may link with, so what is shipped
grows with the number of stretches, and a task holds two of them. Stretch pairs give link counts and a spanning forest, never all pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm.shared import components, cut, table

_TILE = 256
_LEAD = 8
_STRETCHES = 8
_STRETCH_BYTES = 32_000_000


def apart(lo1, hi1, lo2, hi2) -> float:
    """The distance of two boxes."""
    gap = np.maximum(0.0, np.maximum(lo1 - hi2, lo2 - hi1))
    return float(np.sqrt((gap * gap).sum()))


def near_intervals(lo: np.ndarray, hi: np.ndarray, eps: float, lo2: np.ndarray | None = None, hi2: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Index pairs of boxes at most eps apart, by recursive joins of sequence intervals. Without a second sequence: i <= j of one."""
    own = lo2 is None
    lo2, hi2 = (lo, hi) if own else (lo2, hi2)
    out, stack = [], [(0, len(lo), 0, len(lo2))] if len(lo) and len(lo2) else []
    while stack:
        a, b, c, d = stack.pop()
        if own and c + (d - c) <= a:
            continue
        if apart(lo[a:b].min(0), hi[a:b].max(0), lo2[c:d].min(0), hi2[c:d].max(0)) > eps:
            continue
        if b - a == 1 and d - c == 1:
            if not own or a <= c:
                out.append((a, c))
        elif b - a >= d - c:
            m = (a + b) // 2
            stack += [(a, m, c, d), (m, b, c, d)]
        else:
            m = (c + d) // 2
            stack += [(a, b, c, m), (a, b, m, d)]
    return sorted(out)


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """The least node each of n nodes reaches over links i - j."""
    label = np.arange(n)
    while True:
        least = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, least)
        np.minimum.at(new, j, least)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def block_links(ids1, unit1, lead1, ids2, unit2, lead2, same: bool, cosine: float, eps: float):
    """(ids, links, roots) of the vectors of two blocks that have links in this pair."""

    def tiles(lead):
        at = list(range(0, len(lead), _TILE))
        return at, np.array([lead[k : k + _TILE].min(0) for k in at]), np.array([lead[k : k + _TILE].max(0) for k in at])

    (at1, lo1, hi1), (at2, lo2, hi2) = tiles(lead1), tiles(lead2)
    shift = 0 if same else len(ids1)
    n = len(ids1) + (0 if same else len(ids2))
    links, left, right = np.zeros(n, np.int64), [], []
    label = np.arange(n)
    for p, q in near_intervals(lo1, hi1, eps) if same else near_intervals(lo1, hi1, eps, lo2, hi2):
        a, b = at1[p], at2[q]
        close = unit1[a : a + _TILE] @ unit2[b : b + _TILE].T >= cosine
        if same and p == q:
            close = np.triu(close, 1)
        i, j = np.nonzero(close)
        if len(i):
            i, j = i + a, j + b + shift
            links += np.bincount(i, minlength=n) + np.bincount(j, minlength=n)
            left.append(i)
            right.append(j)
            if sum(map(len, left)) > 4_000_000:
                label = _forest(np.concatenate([*left, np.arange(n)]), np.concatenate([*right, label]), n)
                left, right = [], []
    if left:
        label = _forest(np.concatenate([*left, np.arange(n)]), np.concatenate([*right, label]), n)
    ids = ids1 if same else np.concatenate([ids1, ids2])
    has = links > 0
    return ids[has], links[has], ids[label[has]]


def _usable(column) -> tuple[np.ndarray, list]:
    """Row numbers and unit vectors (lists) of a batch's usable vectors."""
    at, out = [], []
    for k, v in enumerate(column.to_pylist()):
        if v and None not in v:
            x = np.array(v, np.float64)
            size = np.abs(x).max()
            if np.isfinite(size) and size > 0:
                x = x / size
                at.append(k)
                out.append(x / np.sqrt(x @ x))
    return np.array(at, np.int64), out


def _join_dimension(vectors: DataFrame, n: int, cosine: float, sample: int) -> DataFrame:
    """(vec_id, links, root) over vectors (vec_id, unit) of one length."""
    n_blocks = max(1, int(np.ceil(np.sqrt(n / 48))))
    take = max(sample, 16 * n_blocks)
    rows = vectors.orderBy(F.xxhash64("vec_id"), "vec_id").limit(take).collect()
    ids = np.array([r.vec_id for r in rows], np.int64)
    units = np.array([r.unit for r in rows])
    mean = units.mean(0)
    _, _, axes = np.linalg.svd(units - mean, full_matrices=False)
    axes = axes[:_LEAD]
    eps = float(np.sqrt(max(0.0, 2 - 2 * cosine))) + 1e-7

    def order_key(unit, ids):
        """Columns of the epsilon grid order, first to last: cells, the first coordinate, the id."""
        lead = (unit - mean) @ axes.T
        return lead, [*np.floor(lead / eps).T, lead[:, 0], ids]

    _, key = order_key(units, ids)
    places = np.lexsort(key[::-1])
    cuts = [places[len(places) * k // n_blocks] for k in range(1, n_blocks)]
    cut_keys = [tuple(float(c[i]) if c.dtype != np.int64 else int(c[i]) for c in key) for i in cuts]

    def deal(batches):
        from bisect import bisect_right

        import pyarrow as pa

        for batch in batches:
            if batch.num_rows:
                ids = batch.column(0).to_numpy()
                unit = batch.column(1).flatten().to_numpy().reshape(len(ids), -1)
                _, key = order_key(unit, ids)
                tuples = zip(*[c.tolist() for c in key], strict=True)
                block = pa.array([bisect_right(cut_keys, t) for t in tuples], pa.int32())
                yield pa.RecordBatch.from_arrays([block, *batch.columns], ["block", "vec_id", "unit"])

    def gather(rows):
        import pyarrow as pa

        ids = rows.column("vec_id").combine_chunks().to_numpy()
        unit = rows.column("unit").combine_chunks().flatten().to_numpy().reshape(len(ids), -1)
        lead, key = order_key(unit, ids)
        places = np.lexsort(key[::-1])
        ids, unit, lead = ids[places], unit[places], lead[places]
        return pa.table({"block": pa.array([rows.column("block")[0].as_py()], pa.int32()), "ids": pa.array([ids.tobytes()], pa.binary()), "units": pa.array([unit.tobytes()], pa.binary()), "lo": pa.array([lead.min(0).tolist()]), "hi": pa.array([lead.max(0).tolist()])})

    spark = vectors.sparkSession
    blocks = vectors.mapInArrow(deal, "block int, vec_id long, unit array<double>").groupBy("block").applyInArrow(gather, "block int, ids binary, units binary, lo array<double>, hi array<double>")
    blocks = cut(blocks)
    boxes = blocks.select("block", "lo", "hi").orderBy("block").collect()
    stretches = min(len(boxes), max(_STRETCHES, -(-n * units.shape[1] * 8 // _STRETCH_BYTES)))
    number = np.arange(len(boxes)) * stretches // len(boxes)
    starts = np.searchsorted(number, np.arange(stretches))
    lo, hi = np.minimum.reduceat(np.array([r.lo for r in boxes]), starts), np.maximum.reduceat(np.array([r.hi for r in boxes]), starts)
    pairs = [(k, end) for k, pair in enumerate(near_intervals(lo, hi, eps)) for end in {*pair}]
    pairs = spark.createDataFrame(pairs, "pair int, stretch int")
    of = spark.createDataFrame([(r.block, int(k)) for r, k in zip(boxes, number, strict=True)], "block int, stretch int")
    both = blocks.join(of, "block").join(pairs, "stretch")

    def links(rows):
        import pyarrow as pa

        stretch = np.array(rows.column("stretch").to_pylist())
        order = np.lexsort([rows.column("block").to_pylist(), stretch]).tolist()
        ids = [np.frombuffer(rows.column("ids")[k].as_py(), np.int64) for k in order]
        unit = [np.frombuffer(rows.column("units")[k].as_py()).reshape(len(i), -1) for k, i in zip(order, ids, strict=True)]
        lead = [(u - mean) @ axes.T for u in unit]
        lo, hi = np.array([x.min(0) for x in lead]), np.array([x.max(0) for x in lead])
        cut_at = int((stretch == stretch.min()).sum())
        if cut_at == len(order):
            near = near_intervals(lo, hi, eps)
        else:
            near = [(i, cut_at + j) for i, j in near_intervals(lo[:cut_at], hi[:cut_at], eps, lo[cut_at:], hi[cut_at:])]
        found = [block_links(ids[i], unit[i], lead[i], ids[j], unit[j], lead[j], i == j, cosine, eps) for i, j in near]
        out = [np.concatenate([np.zeros(0, np.int64), *(f[c] for f in found)]) for c in range(3)]
        return pa.table({"vec_id": out[0], "links": out[1], "root": out[2]})

    return both.groupBy("pair").applyInArrow(links, "vec_id long, links long, root long")


def vector_groups(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", cosine: float = 0.9, sample: int = 4096) -> DataFrame:
    """One row per id: vec_id, n_links, component_id, kept.

    Vectors link at a cosine of at least `cosine`. Null and zero vectors, and those with null or non-finite components, link with
    nothing, as do vectors of different lengths with each other and rows with a null id. Rows that repeat an id are one
    vector, the greatest in array order. `sample` vectors (more only for very many blocks) plan axes and block borders, which
    does not change the result. Labels and other columns play no part.
    """
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(embedding).cast("array<double>").alias("v")).groupBy("vec_id").agg(F.max("v").alias("v"))

    def units(batches):
        import pyarrow as pa

        for batch in batches:
            at, out = _usable(batch.column(1))
            unit = [None] * batch.num_rows
            for k, x in zip(at, out, strict=True):
                unit[k] = x
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(unit, pa.list_(pa.float64()))], ["vec_id", "unit"])

    rows = cut(rows.mapInArrow(units, "vec_id long, unit array<double>"))
    usable = rows.where("vec_id is not null and unit is not null")
    found = None
    for dim, n in usable.groupBy(F.size("unit").alias("dim")).agg(F.count("*").alias("n")).orderBy("dim").collect():
        part = _join_dimension(usable.where(F.size("unit") == dim), n, cosine, sample)
        found = part if found is None else found.unionByName(part)
    ids = rows.select("vec_id")
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"), F.lit(True).alias("kept"))
    found = cut(found)
    counts = found.groupBy("vec_id").agg(F.sum("links").alias("n_links"))
    groups = components(found.select(F.col("vec_id").alias("src"), F.col("root").alias("dst"))).withColumnRenamed("node", "vec_id")
    out = ids.join(counts, "vec_id", "left").join(groups, "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), component.alias("component_id"), F.col("vec_id").eqNullSafe(component).alias("kept"))


def op7_vector_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_groups(table(spark, sf_dir, "embeddings"))


ORACLE = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE embedding IS NOT NULL
), u AS (
  SELECT vec_id, e, sqrt(list_dot_product(e, e)) AS n FROM v WHERE list_dot_product(e, e) > 0
), l AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM u a JOIN u b ON a.vec_id <> b.vec_id AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9
), r AS (
  SELECT a AS vec_id, a AS other FROM l UNION SELECT r.vec_id, l.b FROM r JOIN l ON r.other = l.a
), c AS (SELECT vec_id, min(other) AS component FROM r GROUP BY 1
), n AS (SELECT a AS vec_id, count(*) AS n_links FROM l GROUP BY 1)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(component, vec_id)) AS component_id,
       vec_id = least(vec_id, coalesce(component, vec_id)) AS kept
FROM embeddings LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""
