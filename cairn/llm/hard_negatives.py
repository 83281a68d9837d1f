"""Operator 12, hard-negative mining: vantage-point trees over norm-augmented vectors.

With M at least every vector's length, x becomes (x, sqrt(M^2 - |x|^2)) and an anchor q becomes (q, 0). Their squared distance is
|q|^2 + M^2 - 2 q.x: high scores are small distances, and a window of scores is an annulus around the anchor. All vectors here are integers, so
anchors' squared distances and scores are exact; distances between augmented vectors are rounded outward.

Rows are dealt by the leaves of a vantage-point tree over a bounded sample, every leaf cut by a salt of the id into blocks of bounded size, so the
driver holds some 256 leaves and a crowded leaf is many tasks. A block's task grows its own vantage-point tree. Anchors travel to blocks, in groups
of bounded size: first to their own leaf, which bounds what is still to be found, then to those leaves that may hold more. In a block, an anchor
walks the tree nearest first, inside its annulus, until it has its k rows. Blocks' finds meet in rank windows by anchor, which keep k rows each
before they shuffle.
"""

from __future__ import annotations

import heapq
import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cairn.llm.shared import cut, table
from cairn.llm.vector_codes import integers_of

#: Integer components stay under this, so that scores and squared lengths fit into 64 bits.
MOST = 1 << 23
_BLOCK = 1 << 13
_ANCHORS = 1 << 15
_LEAVES = 1 << 8
_BUCKET = 128
_SLACK = 1e-6


def outward(low, high):
    """Distances with room for rounding: a little less and a little more."""
    return np.maximum(0.0, np.asarray(low) * (1 - 1e-9) - _SLACK), np.asarray(high) * (1 + 1e-9) + _SLACK


class Scorer:
    """Inner products of integer rows with an anchor as exact longs. Doubles do it as long as no sum can reach 2^53."""

    def __init__(self, rows: np.ndarray):
        self._ints, self._doubles, self._most = rows, rows.astype(np.float64), float(np.abs(rows).max(initial=0)) * rows.shape[1]

    def of(self, anchor: np.ndarray):
        """A function from slices of rows to their scores."""
        if self._most * float(np.abs(anchor).max(initial=0)) < 2**53:
            doubles = anchor.astype(np.float64)
            return lambda part: (self._doubles[part] @ doubles).astype(np.int64)
        return lambda part: self._ints[part] @ anchor


@dataclass
class Node:
    """A vantage point and its two sides, each with its range of distances from it; or a bucket of rows start..end."""

    start: int
    end: int
    point: int = -1
    near: Node | None = None
    far: Node | None = None
    near_range: tuple[float, float] = (0.0, 0.0)
    far_range: tuple[float, float] = (0.0, 0.0)


class Tree:
    """A vantage-point tree over augmented rows; leaves are buckets of `bucket` rows, vantage points are numbered."""

    def __init__(self, ints: np.ndarray, square: int, bucket: int = _BUCKET):
        lengths = np.einsum("ij,ij->i", ints, ints)
        self.lift = np.sqrt(np.maximum(0, square - lengths).astype(np.float64))
        self.order, self.points = np.arange(len(ints)), []
        self._ints, self._bucket = ints.astype(np.float64), bucket
        self.root = self._grow(0, len(ints))

    def _distances(self, rows: np.ndarray, point: int) -> np.ndarray:
        gap = self._ints[rows] - self._ints[point]
        return np.sqrt(np.einsum("ij,ij->i", gap, gap) + (self.lift[rows] - self.lift[point]) ** 2)

    def _grow(self, start: int, end: int) -> Node:
        node = Node(start, end)
        if end - start <= self._bucket:
            return node
        rows = self.order[start:end]
        # The row farthest from the first one sees more of the others on one side than a row in their midst.
        point = int(rows[np.argmax(self._distances(rows, int(rows[0])))])
        far = self._distances(rows, point)
        by = np.argsort(far, kind="stable")
        self.order[start:end], far = rows[by], far[by]
        middle = (end - start) // 2
        node.point = len(self.points)
        self.points.append(point)
        node.near_range = tuple(float(x) for x in outward(far[0], far[middle - 1]))
        node.far_range = tuple(float(x) for x in outward(far[middle], far[-1]))
        node.near, node.far = self._grow(start, start + middle), self._grow(start + middle, end)
        return node


class Block:
    """Rows of one block, in the order of its tree, ready for anchors."""

    def __init__(self, ids: np.ndarray, labels: np.ndarray, ints: np.ndarray, square: int, bucket: int = _BUCKET):
        self.tree = Tree(ints, square, bucket)
        order = self.tree.order
        self.ids, self.labels, self.square = ids[order], labels[order], square
        self.points, self.rows = Scorer(ints[np.array(self.tree.points, np.int64)]), Scorer(ints[order])

    def nearest_first(self, anchor: np.ndarray, low: int, high: int, wanted):
        """(score, id) of rows that `wanted` (a mask over row numbers) marks, with scores in low..high, best first, ties by id.

        A heap holds nodes by the least distance they can hold and rows by their own; a row leaves once no node can hold a better or an equal one.
        Nodes whose annulus misses the window are not opened. low may be raised through `send`.
        """
        length = int(anchor @ anchor) + self.square
        scores = self.rows.of(anchor)
        spans = np.sqrt(np.maximum(0, length - 2 * self.points.of(anchor)(slice(None))).astype(np.float64))
        span_low, span_high = outward(spans, spans)
        # 2 * score = length - distance^2, so a distance bounds scores from both sides.
        heap: list[tuple] = [(0.0, 0, 0, 0, (self.tree.root, math.inf))]
        ticket = 0
        while heap:
            key, is_row, less, row_id, what = heapq.heappop(heap)
            if is_row:
                raised = yield -less, row_id
                low = low if raised is None else max(low, raised)
                continue
            node, most = what
            best = (length - key * key) / 2 + 1
            worst = (length - most * most) / 2 - 1
            if best < low or worst > high:
                continue
            if node.point < 0:
                part = slice(node.start, node.end)
                score = scores(part)
                good = (score >= low) & (score <= high) & wanted(part)
                for s, i in zip(score[good].tolist(), self.ids[part][good].tolist(), strict=True):
                    heapq.heappush(heap, (math.sqrt(max(0, length - 2 * s)), 1, -s, i, None))
                continue
            d_low, d_high = float(span_low[node.point]), float(span_high[node.point])
            for child, (r_low, r_high) in ((node.near, node.near_range), (node.far, node.far_range)):
                least = max(0.0, d_low - r_high, r_low - d_high, key - _SLACK)
                ticket += 1
                heapq.heappush(heap, (float(outward(least, least)[0]), 0, 0, ticket, (child, min(most, d_high + r_high))))


def positives_in(block: Block, anchor_id: int, anchor: np.ndarray, label: int, k: int, low: int) -> list[tuple[int, int]]:
    """(score, id) of the first k other rows of the label, with scores of at least `low`."""
    walk = block.nearest_first(anchor, low, 1 << 62, lambda part: (block.labels[part] == label) & (block.ids[part] != anchor_id))
    out = []
    for found in walk:
        out.append(found)
        if len(out) == k:
            break
    return out


def negatives_in(block: Block, anchor: np.ndarray, label: int, k: int, windows: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    """(window number, score, id): for each window (low, high, number) the first k rows of other labels with scores in it, by one walk through all."""
    out, left = [], {number: [low, high, k] for low, high, number in windows if low <= high}
    if not left:
        return out
    walk = block.nearest_first(anchor, min(w[0] for w in left.values()), max(w[1] for w in left.values()), lambda part: block.labels[part] != label)
    try:
        score, row_id = next(walk)
        while True:
            for number, w in list(left.items()):
                if w[0] <= score <= w[1]:
                    out.append((number, score, row_id))
                    w[2] -= 1
                    if not w[2]:
                        del left[number]
                elif score < w[0]:
                    del left[number]
            if not left:
                return out
            score, row_id = walk.send(min(w[0] for w in left.values()))
    except StopIteration:
        return out


class Leaves:
    """Where rows are dealt: a vantage-point tree over a sample with about `leaves` leaves, and each leaf's range of distances from its own centre."""

    def __init__(self, sample: np.ndarray, square: int, leaves: int):
        tree = Tree(sample, square, max(1, -(-len(sample) // leaves)))
        self.square, self.steps, self.centres = square, [], []
        ints, lift = sample.astype(np.float64), tree.lift

        def number(node: Node) -> int:
            """Steps as (point, border, near, far); a leaf's number is stored as -1 - leaf."""
            if node.point < 0:
                rows = tree.order[node.start : node.end]
                self.centres.append(np.append(ints[rows].mean(0), lift[rows].mean()))
                return -len(self.centres)
            at = len(self.steps)
            self.steps.append(None)
            point = tree.points[node.point]
            border = (node.near_range[1] + node.far_range[0]) / 2
            self.steps[at] = (np.append(ints[point], lift[point]), border, number(node.near), number(node.far))
            return at

        self.root = number(tree.root)
        self.centres = np.array(self.centres)
        self.radii = np.zeros(len(self.centres))
        self.blocks = np.ones(len(self.centres), np.int64)

    def augmented(self, ints: np.ndarray) -> np.ndarray:
        lift = np.sqrt(np.maximum(0, self.square - np.einsum("ij,ij->i", ints, ints)).astype(np.float64))
        return np.concatenate([ints.astype(np.float64), lift[:, None]], axis=1)

    def of(self, ints: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(leaf, distance from its centre) of rows."""
        rows = self.augmented(ints)
        leaf = np.zeros(len(rows), np.int64)
        stack = [(self.root, np.arange(len(rows)))]
        while stack:
            at, which = stack.pop()
            if at < 0:
                leaf[which] = -1 - at
            elif len(which):
                point, border, near, far = self.steps[at]
                close = np.sqrt(((rows[which] - point) ** 2).sum(1)) <= border
                stack += [(near, which[close]), (far, which[~close])]
        return leaf, np.sqrt(((rows - self.centres[leaf]) ** 2).sum(1))

    def bounds(self, anchors: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(least, greatest) score of each anchor (row) with each leaf (column), rounded outward."""
        length = np.einsum("ij,ij->i", anchors, anchors) + self.square
        points = np.concatenate([anchors.astype(np.float64), np.zeros((len(anchors), 1))], axis=1)
        low, high = np.zeros((2, len(anchors), len(self.centres)))
        for k, centre in enumerate(self.centres):
            d = np.sqrt(((points - centre) ** 2).sum(1))
            near, far = outward(d - self.radii[k], d + self.radii[k])
            low[:, k], high[:, k] = (length - far * far) / 2 - 1, (length - near * near) / 2 + 1
        return low, high


def _first(rows: DataFrame, by: list[str], k: int) -> DataFrame:
    """The k rows of highest score a group, ties by smaller id, ranked; tasks keep k rows of a group before they shuffle."""
    return rows.withColumn("rank", F.row_number().over(W.partitionBy(*by).orderBy(F.desc("score"), "id"))).where(F.col("rank") <= k)


def _flat(column, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(len(column), dim)


def _mine(rows: DataFrame, dim: int, positives: int, negatives: int, window: tuple[int, int], sample: int, block: int, group: int) -> DataFrame:
    """The result over rows (vec_id, label, v, anchor) of one length."""
    import pyarrow as pa

    square, n = rows.agg(F.max(F.aggregate("v", F.lit(0).cast("long"), lambda a, x: a + x.cast("long") * x)), F.count("*")).first()
    some = rows.orderBy(F.xxhash64("vec_id"), "vec_id").select("v").limit(sample).collect()
    leaves = Leaves(np.array([r.v for r in some], np.int64), square, min(_LEAVES, max(1, -(-n // block))))

    def deal(batches):
        for b in batches:
            if b.num_rows:
                leaf, far = leaves.of(_flat(b.column(2), dim))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(leaf, pa.int32()), pa.array(far, pa.float64())], ["vec_id", "label", "v", "anchor", "leaf", "far"])

    dealt = cut(rows.mapInArrow(deal, "vec_id long, label long, v array<int>, anchor boolean, leaf int, far double"))
    for r in dealt.groupBy("leaf").agg(F.max("far").alias("far"), F.count("*").alias("n")).collect():  # some 256 rows
        leaves.radii[r.leaf], leaves.blocks[r.leaf] = outward(r.far, r.far)[1], -(-r.n // block)
    blocks, fixed = leaves.blocks.tolist(), leaves
    many = F.element_at(F.array(*[F.lit(int(x)) for x in blocks]), F.col("leaf") + 1)
    table_rows = dealt.withColumn("block", F.pmod(F.xxhash64("vec_id"), many).cast("int"))
    anchors = dealt.where("anchor").select("vec_id", "label", "v", "leaf")
    # Anchors come to a block in groups of about `group`, so that neither side of a task grows with the corpus; the block's rows are sent once a group.
    groups = max(1, -(-anchors.count() // group))
    turn = F.pmod(F.xxhash64("anchor_id", F.lit(1)), F.lit(groups)).cast("int")

    def visit(asked: DataFrame, own: bool) -> DataFrame:
        """Anchors (anchor_id, label, v, home, lows, highs) once for each leaf and block that they ask: their own leaf, or others that may hold scores in a window."""

        def spread(batches):
            for b in batches:
                if not b.num_rows:
                    continue
                ints, home = _flat(b.column(2), dim), b.column(3).to_numpy()
                if own:
                    ask = np.zeros((len(home), len(blocks)), bool)
                    ask[np.arange(len(home)), home] = True
                else:
                    low, high = fixed.bounds(ints)
                    windows = [b.column(4).to_pylist(), b.column(5).to_pylist()]
                    ask = np.zeros(low.shape, bool)
                    for k, (lows, highs) in enumerate(zip(*windows, strict=True)):
                        for a, z in zip(lows, highs, strict=True):
                            ask[k] |= (high[k] >= a) & (low[k] <= z) & (a <= z)
                    ask[np.arange(len(home)), home] = False
                who, leaf = np.nonzero(ask)
                times = np.array(blocks)[leaf]
                who, leaf = np.repeat(who, times), np.repeat(leaf, times)
                part = np.concatenate([np.arange(t) for t in times]) if len(times) else np.zeros(0, np.int64)
                for at in range(0, len(who), 4096):
                    step = slice(at, at + 4096)
                    yield pa.RecordBatch.from_arrays([*b.take(pa.array(who[step])).columns, pa.array(leaf[step], pa.int32()), pa.array(part[step], pa.int32())], [*b.schema.names, "leaf", "block"])

        columns = asked.select("anchor_id", "label", "v", "home", "lows", "highs", "numbers")
        sent = columns.mapInArrow(spread, "anchor_id long, label long, v array<int>, home int, lows array<long>, highs array<long>, numbers array<long>, leaf int, block int")
        return sent.withColumn("turn", turn)

    def search(asked: DataFrame, own: bool, find) -> DataFrame:
        """(anchor_id, number, score, id) that `find` gives for each anchor in each block it visits."""

        def meet(key, left, right):
            ids, numbers, scores, found = [], [], [], []
            if left.num_rows and right.num_rows:
                own_block = Block(left.column("vec_id").to_numpy(), left.column("label").to_numpy(), _flat(left.column("v").combine_chunks(), dim), square)
                vectors = _flat(right.column("v").combine_chunks(), dim)
                for k, r in enumerate(right.select(["anchor_id", "label", "lows", "highs", "numbers"]).to_pylist()):
                    for number, score, row_id in find(own_block, r, vectors[k]):
                        ids.append(r["anchor_id"])
                        numbers.append(number)
                        scores.append(score)
                        found.append(row_id)
            return pa.table([pa.array(x, pa.int64()) for x in (ids, numbers, scores, found)], ["anchor_id", "number", "score", "id"])

        sent = visit(asked, own)
        rows_ = table_rows.select("leaf", "block", "vec_id", "label", "v").withColumn("turn", F.explode(F.sequence(F.lit(0), F.lit(groups - 1))))
        by = ["leaf", "block", "turn"]
        return rows_.groupBy(*by).cogroup(sent.groupBy(*by)).applyInArrow(meet, "anchor_id long, number long, score long, id long")

    def like(block_: Block, r: dict, anchor: np.ndarray):
        return [(0, s, i) for s, i in positives_in(block_, r["anchor_id"], anchor, r["label"], positives, r["lows"][0])]

    def unlike(block_: Block, r: dict, anchor: np.ndarray):
        return negatives_in(block_, anchor, r["label"], negatives, list(zip(r["lows"], r["highs"], r["numbers"], strict=True)))

    long_array = lambda *x: F.array(*[c.cast("long") for c in x])
    least, greatest = F.lit(-(1 << 62)), F.lit(1 << 62)
    asked = anchors.select(F.col("vec_id").alias("anchor_id"), "label", "v", F.col("leaf").alias("home"), long_array(least).alias("lows"), long_array(greatest).alias("highs"), long_array(F.lit(0)).alias("numbers"))
    first = cut(_first(search(asked, True, like), ["anchor_id"], positives))
    bound = first.where(F.col("rank") == positives).select("anchor_id", F.col("score").alias("low"))
    again = asked.join(bound, "anchor_id", "left").withColumn("lows", long_array(F.coalesce("low", least))).drop("low")
    found = cut(_first(first.drop("rank").unionByName(search(again, False, like)), ["anchor_id"], positives))
    # In whole numbers, a window goes from the ceiling of its lower end to the floor of its upper one.
    low = F.expr(f"(score * {window[0]} + pmod(-score * {window[0]}, 100)) div 100")
    high = F.expr(f"(score * {window[1]} - pmod(score * {window[1]}, 100)) div 100")
    pairs = found.select("anchor_id", F.col("id").alias("positive_id"), F.col("score").alias("positive_score"), low.alias("low"), high.alias("high"))
    wanted = pairs.groupBy("anchor_id").agg(F.sort_array(F.collect_list(F.struct("positive_id", "low", "high"))).alias("w"))
    windows = asked.drop("lows", "highs", "numbers").join(wanted, "anchor_id")
    windows = windows.select("anchor_id", "label", "v", "home", F.col("w.low").alias("lows"), F.col("w.high").alias("highs"), F.col("w.positive_id").alias("numbers"))
    first = cut(_first(search(windows, True, unlike), ["anchor_id", "number"], negatives))
    bound = first.where(F.col("rank") == negatives).groupBy("anchor_id").agg(F.map_from_entries(F.collect_list(F.struct("number", "score"))).alias("raised"))
    again = windows.join(bound, "anchor_id", "left")
    lows = F.transform(F.arrays_zip("numbers", "lows"), lambda x: F.greatest(x["lows"], F.coalesce(F.try_element_at("raised", x["numbers"]), x["lows"])))
    again = again.withColumn("lows", lows).drop("raised")
    mined = _first(first.drop("rank").unionByName(search(again, False, unlike)), ["anchor_id", "number"], negatives)
    mined = mined.select("anchor_id", F.col("number").alias("positive_id"), F.col("rank").cast("int").alias("rank"), F.col("id").alias("negative_id"), F.col("score").alias("negative_score"))
    return mined.join(pairs.select("anchor_id", "positive_id", "positive_score"), ["anchor_id", "positive_id"]).select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")


def hard_negatives(vectors: DataFrame, anchor: Column, vec_id: str = "vec_id", embedding: str = "embedding", label: str | Column = "label", positives: int = 5, negatives: int = 3, window: tuple[int, int] = (50, 95), scale: int = 256, sample: int = 4096, block: int = _BLOCK, group: int = _ANCHORS) -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score.

    For each row that `anchor` marks, the first `positives` other rows of its label by (inner product of scaled and floored components descending, id);
    for each of those, the first `negatives` rows of other labels whose score is at least window[0] and at most window[1] hundredths of the positive's.
    A negative positive_score leaves an empty window. No part take rows with a null id, label or vector, an empty vector, or null or non-finite
    components, or components that come to 2^23 or more in size. Vectors of different lengths never meet. Rows that repeat an id are one row, the
    greatest by (label, vector). `sample` rows place the leaves, which does not change the result; `block` and `group` bound the rows and anchors of a task.
    Labels are integers; an empty table, or one without anchors, gives an empty result; other columns play no part.
    """
    import pyarrow as pa

    label = F.col(label) if isinstance(label, str) else label
    rows = vectors.select(F.col(vec_id).cast("long").alias("vec_id"), label.cast("long").alias("label"), F.col(embedding).cast("array<double>").alias("v"), F.coalesce(anchor, F.lit(False)).alias("anchor"))
    rows = rows.where("vec_id is not null and label is not null and v is not null and size(v) > 0").withColumn("dim", F.size("v"))

    def to_integers(batches):
        for b in batches:
            sizes = b.column(4).to_numpy()
            for dim in np.unique(sizes).tolist():
                part = b.take(pa.array(np.flatnonzero(sizes == dim)))
                at, ints = integers_of(part.column(2), scale, dim, MOST)
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(at) + 1, dtype=np.int32) * dim), pa.array(ints.astype(np.int32).reshape(-1)))
                part = part.take(pa.array(at))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), lists, part.column(3)], ["vec_id", "label", "v", "anchor"])

    rows = rows.mapInArrow(to_integers, "vec_id long, label long, v array<int>, anchor boolean")
    rows = cut(rows.groupBy("vec_id").agg(F.max(F.struct("label", "v", "anchor")).alias("r")).select("vec_id", "r.*"))
    out = None
    for (dim,) in rows.where("anchor").select(F.size("v").alias("dim")).distinct().orderBy("dim").collect():
        part = _mine(rows.where(F.size("v") == dim), dim, positives, negatives, window, sample, block, group)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return vectors.sparkSession.createDataFrame([], "anchor_id long, positive_id long, rank int, negative_id long, positive_score long, negative_score long")
    return out


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    return hard_negatives(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, label=label)


ORACLE = """
WITH v AS MATERIALIZED (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS MATERIALIZED (
  SELECT a.vec_id AS a, b.vec_id AS b, a.label = b.label AS same, list_dot_product(a.e, b.e)::BIGINT AS s FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0
), p AS (
  SELECT a, b, s FROM s WHERE same QUALIFY row_number() OVER (PARTITION BY a ORDER BY s DESC, b) <= 5
), n AS (
  SELECT p.a, p.b AS p, p.s AS ps, s.b AS n, s.s AS ns, row_number() OVER (PARTITION BY p.a, p.b ORDER BY s.s DESC, s.b) AS r
  FROM p JOIN s ON p.a = s.a AND NOT same AND 50 * p.s <= 100 * s.s AND 100 * s.s <= 95 * p.s
)
SELECT a AS anchor_id, p AS positive_id, r::INT AS rank, n AS negative_id, ps AS positive_score, ns AS negative_score FROM n WHERE r <= 3
"""
