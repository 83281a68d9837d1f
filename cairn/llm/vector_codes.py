"""Operator 11, vector code compression: codebooks of integer parts, nearest entries by vantage-point trees.

Vectors become integers and are cut into parts of equal length. Each part position has a codebook; a round assigns every part to its nearest
entry and moves the entries to the floored means of their parts. Spark runs a round as one pass that folds counts and sums in each task and adds
them up by (position, entry): what meets in one place are the entries, never the vectors.

In a task, the entries of a position form a vantage-point tree. A branch holds the distances of its entries from its vantage entry, rounded
outward to integers; whether a branch can hold an entry as near as the best so far is asked of squared distances whose roots are rounded outward,
too, and a branch that could tie is visited. Each visited entry is measured in integers, so the nearest one, and the lowest index of a tie, is exact.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from math import isqrt

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm.shared import cut, table

#: Integer components stay under this, so that squared distances of parts fit into 64 bits.
MOST = 1 << 26


@dataclass
class Branch:
    """A vantage entry and what lies nearer to it or farther than the median, each with the least and greatest distance, rounded outward."""

    entry: int
    near: Branch | None = None
    far: Branch | None = None
    near_range: tuple[int, int] = (0, 0)
    far_range: tuple[int, int] = (0, 0)


def root_up(x: int) -> int:
    """The least integer whose square is x or more."""
    r = isqrt(x)
    return r + (r * r < x)


def vantage_tree(entries: np.ndarray, members: list[int] | None = None) -> Branch | None:
    """The tree over rows of integer `entries`; the member of lowest index is the vantage entry."""
    members = list(range(len(entries))) if members is None else members
    if not members:
        return None
    top, rest = members[0], members[1:]
    branch = Branch(top)
    if rest:
        squares = {k: int(((entries[k] - entries[top]) ** 2).sum()) for k in rest}
        order = sorted(rest, key=lambda k: (squares[k], k))
        for name, part in (("near", order[: len(order) // 2]), ("far", order[len(order) // 2 :])):
            if part:
                setattr(branch, name, vantage_tree(entries, sorted(part)))
                setattr(branch, f"{name}_range", (isqrt(squares[part[0]]), root_up(squares[part[-1]])))
    return branch


def roots(squares: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Integer square roots of non-negative longs, rounded down and up."""
    down = np.sqrt(squares.astype(np.float64)).astype(np.int64)
    down -= down * down > squares
    down += (down + 1) * (down + 1) <= squares
    return down, down + (down * down < squares)


def nearest(parts: np.ndarray, entries: np.ndarray, tree: Branch | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(index, squared distance) of the nearest entry of each row of integer `parts`, lowest index first, by branch and bound over all rows at once."""
    tree = tree or vantage_tree(entries)
    n = len(parts)
    best, index = np.full(n, np.iinfo(np.int64).max), np.zeros(n, np.int64)

    def visit(branch: Branch | None, rows: np.ndarray) -> None:
        if branch is None or not len(rows):
            return
        gap = parts[rows] - entries[branch.entry]
        square = np.einsum("ij,ij->i", gap, gap)
        better = (square < best[rows]) | (square == best[rows]) & (branch.entry < index[rows])
        best[rows[better]], index[rows[better]] = square[better], branch.entry
        if branch.far is None:
            return
        down, up = roots(square)

        def go(child: Branch | None, span: tuple[int, int], which: np.ndarray) -> None:
            if child is not None and which.any():
                # Best distances have shrunk since, so the bound is asked anew for each child.
                reach = roots(best[rows[which]])[1]
                keep = (span[0] - up[which] <= reach) & (down[which] - span[1] <= reach)
                visit(child, rows[which][keep])

        first = down * 2 <= branch.near_range[1] + branch.far_range[0]
        go(branch.near, branch.near_range, first)
        go(branch.far, branch.far_range, first)
        go(branch.far, branch.far_range, ~first)
        go(branch.near, branch.near_range, ~first)

    visit(tree, np.arange(n))
    return index, best


def integers_of(column, scale: int, dim: int, most: int = MOST) -> tuple[np.ndarray, np.ndarray]:
    """(row numbers, integer vectors) of a batch's usable vectors of length `dim`: each component is scaled and floored, and stays under `most`."""
    import pyarrow as pa
    import pyarrow.compute as pc

    at = np.flatnonzero(pc.fill_null(pc.equal(pc.list_value_length(column), dim), False).to_numpy(zero_copy_only=False))
    # Null components come as NaN, which compares with nothing.
    values = column.take(pa.array(at)).flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(at), dim)
    with np.errstate(over="ignore", invalid="ignore"):
        scaled = np.floor(values * scale)
        good = (np.abs(scaled) < most).all(axis=1)
    return at[good], scaled[good].astype(np.int64)


def code_vectors(vectors: DataFrame, vec_id: str = "vec_id", embedding: str = "embedding", label: str = "label", parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> tuple[DataFrame, list[np.ndarray]]:
    """(rows, codebooks): rows vec_id, label, code, error; codebooks one integer array (entry, component) a part position.

    Dropped are rows whose vector is null or empty or holds null or non-finite components, or components that come to 2^26 or more in size.
    One length holds for all: that of the usable row with the smallest id (the smallest vector among equal ids); rows of other lengths are dropped,
    and a length that `parts` does not divide is a ValueError. Null ids come last. Rows that repeat an id, or id and vector, count each by itself.
    Fewer usable rows than `entries` make smaller codebooks; an empty table gives no rows and no codebooks. Other columns play no part.
    """
    import pyarrow as pa

    spark = vectors.sparkSession
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), F.col(label).alias("label"), F.col(embedding).cast("array<double>").alias("v"))
    usable = F.col("v").isNotNull() & (F.size("v") > 0) & F.forall("v", lambda x: x.isNotNull() & (x * scale < MOST) & (x * scale >= 1 - MOST))
    first = rows.where(usable).orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(1).collect()
    kind = vectors.schema[label].dataType
    if not first:
        return spark.createDataFrame([], "vec_id long, code string, error long").select("vec_id", F.lit(None).cast(kind).alias("label"), "code", "error"), []
    dim = len(first[0].v)
    if dim % parts:
        raise ValueError(f"{parts} parts do not divide vectors of {dim}")
    width = dim // parts

    def to_integers(batches):
        for batch in batches:
            at, ints = integers_of(batch.column(2), scale, dim)
            flat = pa.array(ints.astype(np.int32).reshape(-1))
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim), flat)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), lists], ["vec_id", "label", "v"])

    kept = cut(rows.mapInArrow(to_integers, f"vec_id long, label {kind.simpleString()}, v array<int>"))
    start = kept.orderBy(F.col("vec_id").asc_nulls_last(), "v").select("v").limit(entries).collect()
    books = [np.array([r.v[p * width : (p + 1) * width] for r in start], np.int64) for p in range(parts)]

    def integers(column) -> np.ndarray:
        return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)

    def fold(batches, books):
        """(part, entry, n, sums) of a task's rows."""
        trees = [vantage_tree(b) for b in books]
        counts, sums = np.zeros((parts, len(books[0])), np.int64), np.zeros((parts, len(books[0]), width), np.int64)
        for batch in batches:
            v = integers(batch.column(0))
            for p in range(parts):
                own = v[:, p * width : (p + 1) * width]
                index, _ = nearest(own, books[p], trees[p])
                counts[p] += np.bincount(index, minlength=len(books[p]))
                np.add.at(sums[p], index, own)
        at = [(p, e) for p, e in zip(*np.nonzero(counts), strict=True)]
        columns = [[int(p) for p, _ in at], [int(e) for _, e in at], [int(counts[p, e]) for p, e in at], [sums[p, e].tolist() for p, e in at]]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())], strict=True)], ["part", "entry", "n", "sums"])

    for _ in range(rounds):
        now = books
        folded = kept.select("v").mapInArrow(lambda batches, now=now: fold(batches, now), "part int, entry int, n long, sums array<long>")
        total = folded.groupBy("part", "entry").agg(F.sum("n").alias("n"), F.array(*[F.sum(F.col("sums")[k].cast("decimal(38,0)")) for k in range(width)]).alias("sums"))
        books = [b.copy() for b in books]
        for r in total.collect():  # at most parts x entries rows
            books[r.part][r.entry] = [int(s) // r.n for s in r.sums]

    def assign(batches):
        trees = [vantage_tree(b) for b in books]
        for batch in batches:
            v = integers(batch.column(2))
            found = [nearest(v[:, p * width : (p + 1) * width], books[p], trees[p]) for p in range(parts)]
            codes = np.stack([f[0] for f in found], axis=1)
            error = np.sum([f[1] for f in found], axis=0, dtype=np.int64)
            two = [f"{k:02x}" for k in range(entries)]
            written = ["".join([two[k] for k in row]) for row in codes.tolist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(written, pa.string()), pa.array(error, pa.int64())], ["vec_id", "label", "code", "error"])

    return kept.mapInArrow(assign, f"vec_id long, label {kind.simpleString()}, code string, error long"), books


def books_digest(books: list[np.ndarray]) -> str:
    """SHA-256 of all components in decimal, by part, entry and place."""
    return hashlib.sha256(",".join([str(x) for b in books for x in b.reshape(-1).tolist()]).encode()).hexdigest()


def with_label_error(coded: DataFrame, most: int = 1 << 16, salts: int = 16) -> DataFrame:
    """`coded` and the sum of the errors of its label, nulls together. Up to `most` labels are broadcast; more meet the rows by label and salt, so
    that a label of a third of all rows is dealt over `salts` tasks."""
    coded = cut(coded)
    totals = cut(coded.groupBy("label").agg(F.sum("error").alias("label_error")).withColumnRenamed("label", "_label"))
    same = F.col("label").eqNullSafe(F.col("_label"))
    if totals.count() <= most:
        return coded.join(F.broadcast(totals), same).drop("_label")
    dealt = totals.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return coded.withColumn("_own", F.pmod(F.xxhash64("vec_id"), F.lit(salts)).cast("int")).join(dealt, same & (F.col("_own") == F.col("_salt"))).drop("_label", "_own", "_salt")


def op11_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded, books = code_vectors(table(spark, sf_dir, "embeddings"))
    return with_label_error(coded).select("vec_id", "code", "error", "label_error", F.lit(books_digest(books)).alias("codebooks_sha256"))


def _oracle(parts: int = 8, entries: int = 16, rounds: int = 6, scale: int = 4096) -> str:
    """Lloyd rounds as a chain of table expressions; floors of negative means go down."""
    steps = [
        f"v AS MATERIALIZED (SELECT vec_id, label, row_number() OVER (ORDER BY vec_id, embedding) AS k, list_transform(embedding, lambda x: floor({scale} * x::DOUBLE)::BIGINT) AS e FROM embeddings"
        " WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0)",
        f"p AS MATERIALIZED (SELECT k, part, list_slice(e, part * len(e) // {parts} + 1, (part + 1) * len(e) // {parts}) AS x FROM v, range({parts}) r(part))",
        f"b0 AS MATERIALIZED (SELECT part, k - 1 AS entry, x AS c FROM p WHERE k <= {entries})",
    ]
    near = (
        "(SELECT k, part, x, unnest(min_by(struct_pack(entry := entry, d := d), (d, entry))) FROM (SELECT k, p.part, x, entry, list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT AS d"
        " FROM p JOIN b{n} b ON b.part = p.part) GROUP BY k, part, x)"
    )
    for n in range(rounds):
        steps.append(f"a{n} AS MATERIALIZED {near.format(n=n)}")
        mean = f"(SELECT part, entry, list((s - ((s % n) + n) % n) // n ORDER BY i) AS c FROM (SELECT part, entry, i, sum(x[i])::BIGINT AS s, count(*)::BIGINT AS n FROM a{n}, range(1, len(x) + 1) r(i) GROUP BY part, entry, i) GROUP BY part, entry)"
        steps.append(f"b{n + 1} AS MATERIALIZED (SELECT o.part, o.entry, coalesce(m.c, o.c) AS c FROM b{n} o LEFT JOIN {mean} m ON m.part = o.part AND m.entry = o.entry)")
    steps.append(f"z AS MATERIALIZED (SELECT k, string_agg(printf('%02x', entry), '' ORDER BY part) AS code, sum(d)::BIGINT AS error FROM {near.format(n=rounds)} GROUP BY k)")
    steps.append(f"h AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY part, entry)) AS codebooks_sha256 FROM b{rounds})")
    return "WITH " + ",\n".join(steps) + "\nSELECT vec_id, code, error, sum(error) OVER (PARTITION BY label)::BIGINT AS label_error, codebooks_sha256 FROM v JOIN z USING (k), h"


ORACLE = _oracle()
