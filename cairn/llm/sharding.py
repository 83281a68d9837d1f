"""Operator 9, sharding: best-fit-decreasing bin packing of indivisible groups.

Groups (equal texts) go largest first into the bin with the tightest remaining room, found in a
balanced tree of bins. Packing is sequential, so what the driver holds is bounded at any input size, though every group is
packed as an item: of groups of at least 1/`fine` of all bytes there are `fine` at most, each with its exact size, and smaller ones
come as classes of equal size (to eleven significant binary digits, some 30,000 classes at most) with their count. Items of one
class follow each other in the order of sizes, so a class fills the tightest bin, then the next tightest, at one look-up a
bin. A group's number in its class says which of these bins is its own.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cairn.llm.shared import cut, table


class _Tree:
    """A treap of (room, bin): insert, delete and the least entry not below a key, each in O(log n)."""

    def __init__(self):
        self.root, self._state = None, 0x9E3779B97F4A7C15

    def _priority(self):
        self._state = (self._state * 6364136223846793005 + 1442695040888963407) % 2**64
        return self._state >> 16

    def _split(self, node, key):
        """Two trees: entries below key, and the others. A node is [key, priority, left, right]."""
        if node is None:
            return None, None
        if node[0] < key:
            node[3], right = self._split(node[3], key)
            return node, right
        left, node[2] = self._split(node[2], key)
        return left, node

    def _merge(self, a, b):
        if a is None or b is None:
            return a or b
        if a[1] > b[1]:
            a[3] = self._merge(a[3], b)
            return a
        b[2] = self._merge(a, b[2])
        return b

    def add(self, room, name):
        left, right = self._split(self.root, (room, name))
        self.root = self._merge(self._merge(left, [(room, name), self._priority(), None, None]), right)

    def take(self, size):
        """Removes and returns the entry with the least room >= size, or None."""
        node, best = self.root, None
        while node is not None:
            if node[0][0] >= size:
                best, node = node[0], node[2]
            else:
                node = node[3]
        if best is not None:
            left, right = self._split(self.root, best)
            _, right = self._split(right, (best[0], best[1] + 1))
            self.root = self._merge(left, right)
        return best


def best_fit_decreasing(sizes: list[int], capacity: int, most_bins: int | None = None, counts: list[int] | None = None) -> list[list[tuple[int, int]]] | None:
    """For each entry, which stands for `counts` items of its size (one each by default), [(bin, items there)]; bins are numbered as they open. None
    if more than `most_bins` are needed.

    Ties in size go by position. An item above the capacity is an error: groups are indivisible.
    """
    if sizes and max(sizes) > capacity:
        raise ValueError("an item is larger than a bin")
    tree, bins, out = _Tree(), 0, [[] for _ in sizes]
    for i in sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)):
        left = counts[i] if counts else 1
        while left:
            found = tree.take(sizes[i])
            if found is None:
                if most_bins is not None and bins >= most_bins:
                    return None
                found, bins = (capacity, bins), bins + 1
            # The tightest bin stays the tightest until no further item of this size fits.
            n = min(left, found[0] // sizes[i])
            out[i].append((found[1], n))
            tree.add(found[0] - n * sizes[i], found[1])
            left -= n
    return out


def pack_evenly(sizes: list[int], n_bins: int, counts: list[int] | None = None) -> list[list[tuple[int, int]]]:
    """Best-fit-decreasing at the least capacity (to a few parts in a million) that needs no more than
    n_bins bins. An item larger than its even share gets a bin of its own, the rest share the others."""
    counts = counts or [1] * len(sizes)
    out, left, bins = [[] for _ in sizes], sorted(range(len(sizes)), key=lambda i: (-sizes[i], i)), n_bins
    rest, open_ = sum(s * n for s, n in zip(sizes, counts, strict=True)), list(counts)
    for i in left:
        while bins > 1 and open_[i] and sizes[i] * bins >= rest:
            out[i].append((n_bins - bins, 1))
            rest, bins, open_[i] = rest - sizes[i], bins - 1, open_[i] - 1
        if open_[i]:
            break
    left = [i for i in left if open_[i]]
    if left:
        least = max(-(-rest // bins), sizes[left[0]])
        slack = 0
        while (got := best_fit_decreasing([sizes[i] for i in left], least + slack, bins, [open_[i] for i in left])) is None:
            slack = max(1, least // 1_000_000, slack + slack // 2 + 1)
        for i, found in zip(left, got, strict=True):
            out[i] += [(n_bins - bins + b, n) for b, n in found]
    return out


def shard_documents(docs: DataFrame, n_shards: int = 16, doc_id: str = "doc_id", text: str = "text", fine: int = 65536, digits: int = 11) -> DataFrame:
    """One row per row of `docs`: doc_id, size, text_crc32, law ('bytes'), shard, slot, grown_shard (null).

    size is the UTF-8 length of the text plus 1; a null text counts as an empty one. Equal texts stay in one
    shard. Shards come as close to equal bytes as whole groups allow: a group larger than an even
    share has a shard to itself. Slots run from 0 without gaps in each shard, by hashed part and id;
    repeated rows get slots of their own. An empty table gives an empty result. Other columns of
    `docs` play no part.
    """
    t = F.coalesce(F.col(text), F.lit(""))
    rows = cut(docs.select(F.col(doc_id).cast("long").alias("doc_id"), (F.octet_length(t) + 1).cast("long").alias("size"), F.crc32(t).alias("text_crc32"), F.unhex(F.sha2(t, 256)).alias("digest")))
    total, n = rows.agg(F.sum("size"), F.count("*")).first()
    heavy = F.col("bytes").cast("decimal(38,0)") * fine >= F.lit(total or 0).cast("decimal(38,0)")
    cut_off = f"greatest(length(bin(bytes)) - {digits}, 0)"
    groups = rows.groupBy("digest").agg(F.sum("size").alias("bytes")).withColumn("class", F.when(~heavy, F.expr(f"shiftleft(shiftright(bytes, {cut_off}), {cut_off})")))
    groups = cut(groups)
    alone = sorted((int(r.bytes), bytes(r.digest)) for r in groups.where("class is null").select("digest", "bytes").collect())  # at most `fine`
    classes = sorted((r["class"], r.n, int(r.bytes)) for r in groups.where("class is not null").groupBy("class").agg(F.count("*").alias("n"), F.sum("bytes").alias("bytes")).collect())
    found = pack_evenly([b for b, _ in alone] + [-(-b // k) for _, k, b in classes], n_shards, [1] * len(alone) + [k for _, k, _ in classes])
    spark = docs.sparkSession
    big = spark.createDataFrame([(d, f[0][0]) for (_, d), f in zip(alone, found, strict=False)], "digest binary, big_shard int")
    # For each class: in how many parts its groups are numbered, and the shard of each stretch of numbers.
    stretches = []
    for (c, k, _), f in zip(classes, found[len(alone) :], strict=True):
        upto, own = 0, []
        for b, m in f:
            upto += m
            own.append((upto, b))
        stretches.append((c, max(1, int(k**0.5)), own))
    small = F.broadcast(spark.createDataFrame(stretches, "class long, parts int, stretches array<struct<upto:long,shard:int>>"))
    placed = groups.where("class is not null").select("digest", "class").join(small, "class").withColumn("part", F.pmod(F.xxhash64("digest"), F.col("parts")))
    counts = placed.groupBy("class", "part").agg(F.count("*").alias("n"))
    counts = counts.select("class", "part", (F.sum("n").over(W.partitionBy("class").orderBy("part").rowsBetween(W.unboundedPreceding, 0)) - F.col("n")).alias("before"))
    place = F.row_number().over(W.partitionBy("class", "part").orderBy("digest")).cast("long")
    placed = placed.withColumn("place", place).join(counts, ["class", "part"]).withColumn("place", F.col("place") + F.col("before"))
    placed = placed.select("digest", F.get(F.filter("stretches", lambda x: x["upto"] >= F.col("place")), F.lit(0))["shard"].alias("shard"))
    placed = placed.unionByName(groups.where("class is null").select("digest").join(F.broadcast(big), "digest").select("digest", F.col("big_shard").alias("shard")))
    dealt = rows.join(placed, "digest").select("doc_id", "size", "text_crc32", "digest", "shard")
    # Slots: a shard's rows are counted in about sqrt(n) parts, numbered within a part, then shifted.
    parts = max(1, int((n / n_shards) ** 0.5))
    dealt = cut(dealt.withColumn("part", F.pmod(F.xxhash64("doc_id", F.lit(9)), F.lit(parts))))
    counts = dealt.groupBy("shard", "part").agg(F.count("*").alias("rows"))
    before = F.coalesce(F.sum("rows").over(W.partitionBy("shard").orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    counts = counts.select("shard", "part", before.alias("before"))
    number = F.row_number().over(W.partitionBy("shard", "part").orderBy("doc_id", "digest"))
    out = dealt.withColumn("number", number).join(counts, ["shard", "part"])
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("before") + F.col("number") - 1).cast("long").alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op9_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))
