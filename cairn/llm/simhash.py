"""Operator 8, SimHash near-dedup by the generalised pigeonhole principle.

If two fingerprints differ in at most tau bits and parts i of the bits have thresholds t_i with
sum(t_i + 1) = tau + 1, some part differs in at most t_i bits. Bits that move together are grouped
into one part (they tell little apart, so it is cheap to keep them in one place), thresholds are
allotted by dynamic programming on the candidate counts estimated from a bounded sample, and each
fingerprint probes the keys within its part's threshold; every candidate is verified. The sample
only steers cost: any grouping and any thresholds of that sum give the same links.

Equal fingerprints are one node, so copies never meet in pairs. A bucket with more than `crowd` fingerprints (some seconds of comparing) is split
by the pigeonhole of the bits that are left, again and again, which loses no pair.
"""

from __future__ import annotations

from itertools import count
from math import comb

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window as W, functions as F

from cairn.llm.shared import components, cut, cut_small, small_batches, table

_BLOCK = 1 << 16
_NO_ID = 2**63 - 1
_ROW_PRICE = 60.0


def _shingle_hashes(words: list[bytes], width: int):
    """XXH64 (seed 42) of all shingles of `width` words, in blocks; a shorter text is one shingle."""
    from xxhash import xxh64_intdigest

    if not words:
        return
    joined = b" ".join(words)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1) - 1
    starts = np.concatenate([[0], ends[:-1] + 1])
    width = min(width, len(words))
    starts, ends = starts[: len(words) - width + 1], ends[width - 1 :]
    for at in range(0, len(starts), _BLOCK):
        s, e = starts[at : at + _BLOCK].tolist(), ends[at : at + _BLOCK].tolist()
        yield np.fromiter((xxh64_intdigest(joined[i:j], 42) for i, j in zip(s, e, strict=True)), np.uint64, len(s))


def _majorities(blocks, n_words: int) -> np.ndarray:
    """`n_words` words of 64 bits, each bit the majority over all hashes; the first over the hashes themselves, further ones over hashes mixed from them."""
    ones, n = np.zeros((n_words, 64), np.int64), 0
    for h in blocks:
        n += len(h)
        for k in range(n_words):
            if k:
                h = (h ^ (h >> np.uint64(31))) * np.uint64(0x9E3779B97F4A7C15)
                h ^= h >> np.uint64(29)
            ones[k] += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return np.packbits(2 * ones > n, axis=1, bitorder="little").view("<u8").ravel()


def _words(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "surrogatepass").lower().split()


def fingerprint(text: str | None, width: int = 3) -> int:
    """64 bits, each the majority of that bit over the XXH64 (seed 42) of all shingles of `width` words; zero without words."""
    return int(_majorities(_shingle_hashes(_words(text), width), 1)[0])


def similar_bits(similarity: float, bits: int, deviations: float = 2.0) -> int:
    """How many of `bits` may differ for shingle sets of this Jaccard similarity: the expected share, arccos(2J / (1 + J)) / pi, and some standard deviations."""
    share = float(np.arccos(2 * similarity / (1 + similarity)) / np.pi)
    return int(bits * share + deviations * np.sqrt(bits * share * (1 - share)))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in batch.column(1)], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps, pa.int64())], ["doc_id", "fp"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, fp long")


def group_bits(sample: np.ndarray, parts: int) -> list[int]:
    """Masks of `parts` parts of nearly equal width; each starts with the bit most correlated to the free ones and takes in its closest bits."""
    bits = np.unpackbits(sample.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(float) if len(sample) else np.zeros((1, 64))
    bits = bits - bits.mean(axis=0)
    norm = np.sqrt((bits**2).sum(axis=0))
    close = np.abs(bits.T @ bits) / np.maximum(np.outer(norm, norm), 1e-9)
    free, masks = set(range(64)), []
    for k in range(parts):
        width = (64 * (k + 1)) // parts - (64 * k) // parts
        order = sorted(free)
        own = [max(order, key=lambda b: (close[b, order].sum(), -b))]
        while len(own) < width:
            own.append(max(free - set(own), key=lambda b: (close[b, own].sum(), -b)))
        free -= set(own)
        masks.append(sum(1 << b for b in own))
    return masks


def allot(sample: np.ndarray, n: int, tau: int) -> list[tuple[int, int]]:
    """[(mask, threshold)] with the least estimated cost over 2 to tau + 1 parts: candidates verified and, at _ROW_PRICE times their price, rows shuffled."""
    best = None
    for parts in range(2, tau + 2):
        masks = group_bits(sample, parts)
        costs = []
        for mask in masks:
            width, own = mask.bit_count(), sample & np.uint64(mask)
            near = np.bincount(np.bitwise_count(own[:, None] ^ own[None, :]).ravel(), minlength=65) if len(own) > 1 else np.zeros(65)
            near[0] -= min(near[0], len(own))
            row, chance, probes = [0.0], 0.0, 0
            for t in range(min(tau, 3) + 1):
                probes, chance = probes + comb(width, t), chance + comb(width, t) / 2.0**width
                seen = near[: t + 1].sum() / max(1, len(own) * (len(own) - 1))
                row.append(n * n / 2 * max(seen, chance) + _ROW_PRICE * n * (probes + (t > 0)))
            costs.append(row)
        # ways[s]: cheapest thresholds whose t + 1 sum to s
        ways = {0: (0.0, [])}
        for row in costs:
            step = {}
            for s, (cost, chosen) in ways.items():
                for k, c in enumerate(row):
                    if s + k <= tau + 1 and (s + k not in step or cost + c < step[s + k][0]):
                        step[s + k] = (cost + c, [*chosen, k - 1])
            ways = step
        if tau + 1 in ways and (best is None or ways[tau + 1][0] < best[0]):
            best = (ways[tau + 1][0], [(m, t) for m, t in zip(masks, ways[tau + 1][1], strict=True) if t >= 0])
    return best[1]


def _signed(mask: int) -> int:
    return mask - 2**64 if mask >= 2**63 else mask


def _flips(mask: int, threshold: int) -> list[int]:
    from itertools import combinations

    bits = [1 << b for b in range(64) if mask >> b & 1]
    return [_signed(sum(c)) for t in range(threshold + 1) for c in combinations(bits, t)]


def _keys(parts: list[tuple[int, int, list[int]]], path: Column) -> Column:
    """An array of bucket ids: for (number, mask, flips) the hash of path, number and each flipped key."""

    def keys(number: int, mask: int, flips: list[int]) -> Column:
        key = F.col("fp").bitwiseAND(F.lit(_signed(mask)))
        return F.transform(F.array(*[F.lit(x) for x in flips]), lambda x: F.xxhash64(path, F.lit(number), key.bitwiseXOR(x)))

    return F.concat(*[keys(*part) for part in parts])


def _split(mask: int, parts: int) -> list[int]:
    bits = [1 << b for b in range(64) if mask >> b & 1]
    return [sum(bits[len(bits) * k // parts : len(bits) * (k + 1) // parts]) for k in range(parts)]


def plan(nodes: DataFrame, tau: int, sample: int = 1024) -> list[tuple[int, int]]:
    """allot for all nodes, on at most `sample` of their fingerprints, picked by hash."""
    seen = np.array([r.fp for r in nodes.select("fp").orderBy(F.xxhash64("fp")).limit(sample).collect()], np.int64).view(np.uint64)
    return allot(seen, nodes.count(), tau)


def near_links(nodes: DataFrame, tau: int = 3, parts: list[tuple[int, int]] | None = None, crowd: int = 32768, levels: int | None = None) -> DataFrame:
    """(src, dst) of all nodes whose fingerprints differ in at most tau bits. nodes: fp and a rep of its own, both long.

    With a column `group`, links inside a group are left out. Buckets of more than `crowd` nodes are split by the bits that are left, for as many levels
    as there are such buckets (`levels` at most, for tests); where tau bits are left, a bucket has 2^tau nodes at most.
    """
    parts = plan(nodes, tau) if parts is None else parts
    near = (F.bit_count(F.col("a.fp").bitwiseXOR(F.col("b.fp"))) <= tau) & (F.col("a.rep") < F.col("b.rep"))
    columns = [c for c in ("fp", "rep", "group") if c in nodes.columns]
    if "group" in columns:
        near = near & (F.col("a.group") != F.col("b.group"))
    out = None
    # One branch a part and level; `index` holds exact keys, `probe` the keys within the threshold.
    todo = [(nodes, nodes, F.lit(0).cast("long"), part, (1 << 64) - 1) for part in parts]
    for depth in count():
        branches, keys = [], None
        for left, right, path, (mask, t), left_bits in todo:
            index = left.select(*columns, F.explode(_keys([(mask % 1_000_003, mask, [0])], path)).alias("key"))
            probe = index if t == 0 and left is right else right.select(*columns, F.explode(_keys([(mask % 1_000_003, mask, _flips(mask, t))], path)).alias("key"))
            rest = left_bits & ~mask
            branches.append((index, probe, rest))
            if rest.bit_count() > tau:
                keys = index.select("key") if keys is None else keys.unionByName(index.select("key"))
        todo, full = [], None
        if keys is not None and (levels is None or depth + 1 < levels):  # one count for all parts of a level
            full = cut(keys.groupBy("key").agg(F.count("*").alias("rows")).where(F.col("rows") > crowd).select("key"))
            full = None if full.isEmpty() else full
        for index, probe, rest in branches:
            if full is not None and rest.bit_count() > tau:
                hot_index = index.join(full, "key", "left_semi")
                hot_probe = hot_index if probe is index else probe.join(full, "key", "left_semi")
                todo += [(hot_index, hot_probe, F.col("key"), (m, 0), rest) for m in _split(rest, tau + 1)]
                index, probe = index.join(full, "key", "left_anti"), probe.join(full, "key", "left_anti")
            pairs = index.alias("a").join(probe.alias("b"), "key")
            # Each of two near nodes probes the other's key, so taking one order loses none.
            pairs = pairs.where(near).select(F.col("a.rep").alias("src"), F.col("b.rep").alias("dst"))
            out = pairs if out is None else out.unionByName(pairs)
        if not todo:
            break
    return out


def _neighbours(nodes: DataFrame, tau: int, parts: list[tuple[int, int]], wide: tuple[str, ...], wide_tau: int, ahead: int = 6) -> DataFrame:
    """(src, dst): links to some of the next few nodes of the same keys. They tie a large group of near copies together at little cost."""
    columns = ["fp", "rep", *wide]
    rows = nodes.select(*columns, F.explode(_keys([(mask % 1_000_003, mask, [0]) for mask, _ in parts], F.lit(0).cast("long"))).alias("key"))
    order = W.partitionBy("key").orderBy("fp", "rep")
    found = []
    for k in range(1, ahead + 1):
        other = F.lead(F.struct(*columns), k).over(order)
        near = F.bit_count(F.col("fp").bitwiseXOR(other["fp"])) <= tau
        if wide:
            near = near & (sum(F.bit_count(F.col(c).bitwiseXOR(other[c])) for c in wide) <= wide_tau)
        found.append(F.when(near, other["rep"]))
    rows = rows.select("rep", F.filter(F.array(*found), lambda x: x.isNotNull()).alias("others")).where(F.size("others") > 0)
    return rows.select(F.col("rep").alias("src"), F.explode("others").alias("dst"))


def link_groups(nodes: DataFrame, tau: int, wide: tuple[str, ...] = (), wide_tau: int = 0) -> DataFrame:
    """nodes (fp, rep, wide...) and `component`: the least rep that links reach. Links need at most tau differing bits in fp and wide_tau in `wide` together.

    First neighbours in the buckets are linked, which already joins nearly all of a large group of near
    copies; then all links between different groups are found, exactly. So no group emits all its pairs, and no link that matters is lost.
    """
    parts = plan(nodes, tau)
    first = components(_neighbours(nodes, tau, parts, wide, wide_tau)).withColumnRenamed("component", "group")
    nodes = cut(nodes.join(first, nodes.rep == first.node, "left").select(*nodes.columns, F.coalesce("group", "rep").alias("group")))
    links = near_links(nodes, tau, parts).distinct()
    side = lambda end: nodes.select(F.col("rep").alias(end), F.struct("group", *wide).alias(f"{end}_node"))
    links = links.join(side("src"), "src").join(side("dst"), "dst")
    if wide:
        links = links.where(sum(F.bit_count(F.col(f"src_node.{c}").bitwiseXOR(F.col(f"dst_node.{c}"))) for c in wide) <= wide_tau)
    last = components(links.select(F.col("src_node.group").alias("src"), F.col("dst_node.group").alias("dst")))
    out = nodes.join(last, nodes.group == last.node, "left")
    return out.select(*[c for c in nodes.columns if c != "group"], F.coalesce("component", "group").alias("component"))


def simhash_groups(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 3, tau: int = 3) -> DataFrame:
    """One row per row of `docs`: doc_id, fingerprint (16 hex digits), component_id.

    Documents link where their fingerprints differ in at most `tau` bits; component_id is the smallest id that links reach. Null
    and wordless texts have the fingerprint zero and link like any other; texts of fewer words than `width` are one shingle. A null id counts as
    larger than any other and shows as null. Rows that repeat an id are rows of their own. An empty table gives an empty result.
    """
    with small_batches(docs.sparkSession):
        rows = cut(fingerprints(docs, doc_id, text, width))
    # A node's rep is its fingerprint: ids can be null or repeated, so the least one is only carried along.
    nodes = cut(rows.groupBy("fp").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("least_id")))
    groups = cut(link_groups(nodes.select("fp", F.col("fp").alias("rep")), tau).select("fp", "component").join(nodes, "fp"))
    least = groups.groupBy("component").agg(F.min("least_id").alias("least_id"))
    out = rows.join(groups.select("fp", "component").join(least, "component"), "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.nullif("least_id", F.lit(_NO_ID)).alias("component_id"))


def _shingles(text: str | None, width: int) -> np.ndarray:
    """The sorted distinct hashes of all shingles of `width` words; a wordless text has none."""
    return np.unique(np.concatenate([np.zeros(0, np.uint64), *_shingle_hashes(_words(text), width)]))


def _prefix(own: np.ndarray, similarity: float, listed: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first n - ceil(similarity * n) + 1 of n shingles, those that few documents hold first. Two sets of that Jaccard similarity share one of them."""
    n = len(own) - int(np.ceil(similarity * len(own) - 1e-9)) + 1 if len(own) else 0
    if len(listed) and n < len(own):
        spot = np.minimum(np.searchsorted(listed, own), len(listed) - 1)
        own = own[np.argsort(np.where(listed[spot] == own, counts[spot], 0), kind="stable")]
    return own[:n]


def _parities(own: np.ndarray, words: int) -> np.ndarray:
    """64 * words bits, each the parity of the shingles that fall on it: where two texts' bits differ, so do at least as many shingles."""
    odd = (np.bincount((own >> np.uint64(32)).astype(np.int64) % (64 * words), minlength=64 * words) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view("<u8")


def _common(source: DataFrame, width: int, sample: int, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The `most` shingles that most of about `sample` texts hold, sorted, and their counts; they only steer which shingles are probed first."""
    every = max(1, source.count() // sample)

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            for t in batch.column(0):
                yield pa.RecordBatch.from_arrays([pa.array(_shingles(t.as_py(), width).view(np.int64))], ["shingle"])

    found = source.where(F.pmod("th", F.lit(every)) == 0).select("text").mapInArrow(run, "shingle long")
    found = found.groupBy("shingle").count().where("count > 2").orderBy(F.desc("count"), "shingle").limit(most).collect()
    listed, counts = np.array([r.shingle for r in found], np.int64).view(np.uint64), np.array([r["count"] for r in found], np.int64)
    order = np.argsort(listed)
    return listed[order], counts[order]


def _verified(pairs: DataFrame, nodes: DataFrame, source: DataFrame, width: int, similarity: float, bits: int = 1 << 23) -> DataFrame:
    """The pairs (src, dst) whose shingle sets have this Jaccard similarity. Only texts of nodes in pairs are hashed again."""
    ends = pairs.select(F.col("src").alias("node")).unionByName(pairs.select(F.col("dst").alias("node"))).distinct()
    need = cut_small(nodes.join(ends, "node", "left_semi").select("node", "th"))
    # A bitmap of bounded size passes over nearly all other texts; the join decides.
    marks = np.zeros(bits // 32, np.uint32)
    for r in need.groupBy(F.expr(f"pmod(th, {bits}) div 32").alias("at")).agg(F.expr("bit_or(shiftleft(1L, cast(pmod(th, 32) as int)))").alias("mark")).collect():
        marks[r["at"]] = r["mark"]

    def run(batches):
        import pyarrow as pa

        for batch in batches:
            at = np.mod(batch.column(0).to_numpy(), bits)
            hit = np.flatnonzero(marks[at // 32] >> (at % 32).astype(np.uint32) & 1)
            for i in range(0, len(hit), 256):
                part = hit[i : i + 256]
                sets = [_shingles(batch.column(1)[int(k)].as_py(), width).view(np.int64) for k in part]
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(part)), pa.array(sets, pa.list_(pa.int64()))], ["th", "shingles"])

    sets = source.select("th", "text").mapInArrow(run, "th long, shingles array<long>").join(need, "th").dropDuplicates(["node"]).select("node", "shingles")
    side = lambda end: sets.select(F.col("node").alias(end), F.col("shingles").alias(f"{end}_set"))
    both = pairs.join(side("src"), "src").join(side("dst"), "dst")
    shared = F.size(F.array_intersect("src_set", "dst_set"))
    with small_batches(pairs.sparkSession):
        return cut_small(both.where(shared >= F.lit(similarity) * (F.size("src_set") + F.size("dst_set") - shared) - 1e-9).select("src", "dst"))


def _buckets(batches):
    """From rows (key, size, node) in that order: (key, node, p1, p2) of all nodes that share a key with another, and the nodes just before
    them in the bucket. Only the last rows of a batch are held; a partition's first and last row always leave, as their bucket may go on elsewhere."""
    import pyarrow as pa

    def out(key, size, node, done, end, last):
        pad = lambda x, k: np.concatenate([np.zeros(k, x.dtype), x[:-k]]) if len(x) > k else np.zeros(len(x), x.dtype)
        n = len(key)
        same = np.zeros(n + 1, bool)
        same[1:n] = key[1:] == key[:-1]
        keep = same[:n] | same[1:]
        if done == 0:
            keep[0] = True
        if last:
            keep[n - 1] = True
        keep[:done], keep[end:] = False, False
        at = np.flatnonzero(keep)
        before = [pa.array(pad(node, k)[at], mask=~((np.arange(n) >= k) & (pad(key, k) == key))[at]) for k in (1, 2)]
        return pa.RecordBatch.from_arrays([pa.array(key[at]), pa.array(node[at]), *before], ["key", "node", "p1", "p2"])

    held, done = None, 0
    for batch in batches:
        rows = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
        if held is not None:
            rows = [np.concatenate(x) for x in zip(held, rows, strict=True)]
        if not len(rows[0]):
            continue
        new = np.ones(len(rows[0]), bool)  # equal sets of several texts give equal rows
        new[1:] = (rows[0][1:] != rows[0][:-1]) | (rows[2][1:] != rows[2][:-1])
        rows = [x[new] for x in rows]
        n = len(rows[0])
        if n - 1 > done:
            yield out(*rows, done, n - 1, False)
        held, done = [x[-3:] for x in rows], min(2, n - 1) if n > 1 else 0
    if held is not None:
        yield out(*held, done, len(held[0]), True)


def near_copies(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", width: int = 5, similarity: float = 0.8, words: int = 4, tau: int = 3, sample: int = 8192, listed: int = 65536) -> DataFrame:
    """One row per row of `docs`: doc_id, component_id (the smallest id that links reach).

    Documents link where the sets of their distinct shingles of `width` words have a Jaccard similarity of at least `similarity`. Their SimHash
    fingerprints (64 majority bits over the distinct shingles) are probed as in simhash_groups: correlated bits together, thresholds by dynamic
    programming, all pairs within `tau` bits. Pairs of that similarity whose fingerprints are further apart (the farther, the nearer to it) come from a
    second probe: among the sets' prefixes (a fifth of the shingles, those that few documents hold first) one shingle is common.
    Candidates of both go whose sizes, parities or wide fingerprints (256 majority bits, the 64 among them, six standard deviations) are too far apart;
    every other one is verified on the sets. So no pair below the similarity links, and one above it is lost only by such a deviation (one in 10^9) or
    a clash of 64-bit hashes.

    Neighbours in the buckets of both are verified first, which ties nearly all of a large group; then only candidates in different groups.
    A bucket's main group never meets itself, so its size enters once, not squared. Equal sets are one node. Wordless and null texts are
    one group. Null ids and repeated rows as in simhash_groups. An empty table gives an empty result; other columns play no part.
    """
    names, odd = [f"b{k}" for k in range(words)], [f"p{k}" for k in range(words)]
    far = similar_bits(similarity, 64 * words, 6.0)
    source = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"), F.xxhash64(F.coalesce(F.col(text), F.lit(""))).alias("th"))
    spark = docs.sparkSession
    with small_batches(spark):
        common = _common(source, width, sample, listed)

    def run(batches):
        import pyarrow as pa
        from xxhash import xxh64_intdigest

        for batch in batches:
            found = []
            for t in batch.column(1):
                own = _shingles(t.as_py(), width)
                found.append((xxh64_intdigest(own.tobytes(), 42), len(own), _prefix(own, similarity, *common).view(np.int64), np.concatenate([_majorities([own], words), _parities(own, words)]).view(np.int64)))
            node = pa.array(np.array([f[0] for f in found], np.uint64).view(np.int64))
            bits = np.array([f[3] for f in found], np.int64).reshape(-1, 2 * words)
            columns = [node, pa.array([f[1] for f in found], pa.int32()), pa.array([f[2] for f in found], pa.list_(pa.int64())), *[pa.array(np.ascontiguousarray(bits[:, k])) for k in range(2 * words)]]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(2), *columns], ["doc_id", "th", "node", "size", "prefix", *names, *odd])

    with small_batches(spark):
        rows = cut(source.mapInArrow(run, "doc_id long, th long, node long, size int, prefix array<long>, " + ", ".join(f"{n} long" for n in [*names, *odd])))
    firsts = [F.first(c).alias(c) for c in ("size", *names, *odd)]
    nodes = cut_small(rows.groupBy("node").agg(F.min(F.coalesce("doc_id", F.lit(_NO_ID))).alias("least_id"), F.min("th").alias("th"), *firsts))
    facts = nodes.select("node", "size", *names, *odd)

    def near(a, b) -> Column:
        apart = lambda some: sum(F.bit_count(a(c).bitwiseXOR(b(c))) for c in some)
        sizes = F.least(a("size"), b("size")) >= F.lit(similarity) * F.greatest(a("size"), b("size")) - 1e-9
        wide = (apart(names) <= far) | (F.greatest(a("size"), b("size")) < 32)
        return sizes & wide & (apart(odd) <= F.lit((1 - similarity) / (1 + similarity)) * (a("size") + b("size")) + 1e-9)

    order = ["key", "size", "node"]
    keys = rows.select(F.explode("prefix").alias("key"), "size", "node").repartitionByRange(*order).sortWithinPartitions(*order)
    keys = cut_small(keys.mapInArrow(_buckets, "key long, node long, p1 long, p2 long"))
    first = keys.select("node", F.explode(F.array("p1", "p2")).alias("other")).where("other is not null")
    first = first.select(F.least("node", "other").alias("src"), F.greatest("node", "other").alias("dst"))
    prints = nodes.select(F.col(names[0]).alias("fp"), F.col("node").alias("rep"))
    parts = plan(prints, tau)
    beside = _neighbours(prints, tau, parts, (), 0).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst"))
    first = first.unionByName(beside).distinct()
    end = lambda name: facts.select(F.col("node").alias(name), F.struct("size", *names, *odd).alias(f"{name}_of"))
    could = lambda pairs: pairs.join(end("src"), "src").join(end("dst"), "dst").where(near(lambda c: F.col(f"src_of.{c}"), lambda c: F.col(f"dst_of.{c}"))).select("src", "dst")
    first = cut_small(could(first))
    links = _verified(first, nodes, source, width, similarity)
    groups = cut_small(components(links).withColumnRenamed("component", "group"))

    tied = cut_small(prints.join(groups, prints["rep"] == groups["node"], "left").select("fp", "rep", F.coalesce("group", "rep").alias("group")))
    probed = near_links(tied, tau, parts).select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct()
    probed = cut_small(could(probed.join(first, ["src", "dst"], "left_anti")))
    keys = cut_small(keys.select("key", "node").join(groups, "node", "left").select("key", "node", F.coalesce("group", "node").alias("group")))
    # A bucket of one group has no open pair.
    mains = keys.groupBy("key", "group").agg(F.count("*").alias("n")).groupBy("key").agg(F.max(F.struct("n", "group"))["group"].alias("main"), F.count("*").alias("groups"))
    keys = keys.join(mains.where("groups > 1").select("key", "main"), "key")
    more = rows.groupBy("node").agg(*[F.first(c).alias(c) for c in ("size", *names, *odd, "prefix")])
    at = F.array_position("prefix", F.col("key")).cast("int") - 1
    keys = keys.join(more, "node").select("key", "node", "group", "main", "size", *names, *odd, at.alias("at"), *[F.when(at >= k, F.get("prefix", at - k)).alias(f"prev{k}") for k in (1, 2)])
    a, b = (lambda c: F.col(f"a.{c}")), (lambda c: F.col(f"b.{c}"))
    once = (b("group") == b("main")) | (a("node") < b("node"))
    # A pair leaves at its first common key: not where a key shortly before is common, too, nor where too few shingles are left.
    again = [a(f"prev{i}") == b(f"prev{j}") for i in (1, 2) for j in (1, 2)]
    need = F.lit(similarity / (1 + similarity)) * (a("size") + b("size")) - 1e-9
    early = (a("size") - a("at") >= need) & (b("size") - b("at") >= need) & ~F.coalesce(F.greatest(*again), F.lit(False))
    open_ = (a("group") != b("group")) & once & early & near(a, b)
    rest = keys.where("group <> main").alias("a").join(keys.alias("b"), (a("key") == b("key")) & open_)
    rest = rest.select(F.least(a("node"), b("node")).alias("src"), F.greatest(a("node"), b("node")).alias("dst")).distinct()
    rest = cut_small(rest.join(first, ["src", "dst"], "left_anti").unionByName(probed).distinct())
    links = links.unionByName(_verified(rest, nodes, source, width, similarity))
    found = nodes.join(components(links), "node", "left").select("node", "least_id", F.coalesce("component", "node").alias("component"))
    least = found.groupBy("component").agg(F.min("least_id").alias("least_id"))
    found = found.drop("least_id").join(least, "component").select("node", "least_id")
    return rows.select("doc_id", "node").join(found, "node").select("doc_id", F.nullif("least_id", F.lit(_NO_ID)).alias("component_id"))


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash_groups(table(spark, sf_dir, "documents"))
