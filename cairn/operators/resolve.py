"""Reference resolution, and references kept over a re-index."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F


def resolve_references(names: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(ref_id, to_symbol_id, tier): names (ref_id, file_id, owner, name, kind) against symbols, nearest tier first.

    1 same owner in the same file, 2 same file, 3 imported file, 4 the only symbol of that name. The first tier with exactly one candidate wins;
    a tier with several makes the name ambiguous there and the next is tried. Calls only mean callables, types only types.

    Symbols are folded to a count and one id by what each tier compares, so a reference meets one row a tier, however many symbols share its name.
    """
    callable_, data = F.col("kind").isin("function", "method", "class", "struct"), ~F.col("kind").isin("function", "method", "variable")
    sorts = F.filter(F.array(F.when(callable_, "call"), F.when(data, "type"), F.lit("any")), lambda x: x.isNotNull())
    target = symbols.select("id", F.col("file_id").alias("to_file"), "name", F.col("owner_type").alias("owner"), F.explode(sorts).alias("sort"))
    folded = [F.count("*").alias("n"), F.min("id").alias("id")]
    by_owner = target.where("owner is not null").groupBy("name", "sort", "to_file", "owner").agg(*folded)
    by_file = target.groupBy("name", "sort", "to_file").agg(*folded)
    by_name = by_file.groupBy("name", "sort").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    uses = names.withColumn("sort", F.when(F.col("kind").isin("call", "type"), F.col("kind")).otherwise("any"))
    wanted = uses.select("file_id", "name", "sort").distinct()
    imported = wanted.join(edges.select(F.col("from_file").alias("file_id"), "to_file").distinct(), "file_id").join(by_file, ["to_file", "name", "sort"])
    imported = imported.groupBy("file_id", "name", "sort").agg(F.sum("n").alias("n"), F.min("id").alias("id"))
    tiers = [
        (by_owner.withColumnRenamed("to_file", "file_id"), ["name", "sort", "file_id", "owner"]), (by_file.withColumnRenamed("to_file", "file_id"), ["name", "sort", "file_id"]),
        (imported, ["name", "sort", "file_id"]), (by_name, ["name", "sort"]),
    ]
    for k, (fold, keys) in enumerate(tiers, 1):
        uses = uses.join(fold.where("n = 1").select(*keys, F.struct(F.col("id").alias("to_symbol_id"), F.lit(k).alias("tier")).alias(f"t{k}")), keys, "left")
    return uses.withColumn("hit", F.coalesce("t1", "t2", "t3", "t4")).where("hit is not null").select("ref_id", "hit.to_symbol_id", "hit.tier")


def snapshot_references(refs: DataFrame, symbols: DataFrame, files: DataFrame, changed: DataFrame) -> DataFrame:
    """References from unchanged files into changed ones (path), by path, name and kind of the target."""
    place = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id")
    target = place.join(changed, "path", "left_semi").select(F.col("id").alias("to_symbol_id"), "path", "name", F.col("kind").alias("symbol_kind"))
    source = place.join(changed, "path", "left_anti").select(F.col("id").alias("from_symbol_id"))
    return refs.join(target, "to_symbol_id").join(source, "from_symbol_id", "left_semi").select("from_symbol_id", "path", "name", "symbol_kind", F.col("kind").alias("ref_kind")).distinct()


def restore_references(snapshot: DataFrame, symbols: DataFrame, files: DataFrame) -> DataFrame:
    """References again, where the target matches exactly one new symbol and the source still exists."""
    place = symbols.join(files.select(F.col("id").alias("file_id"), "path"), "file_id").select("path", "name", F.col("kind").alias("symbol_kind"), F.col("id").alias("to_symbol_id"))
    one = place.withColumn("n", F.count("*").over(W.partitionBy("path", "name", "symbol_kind"))).where("n = 1").drop("n")
    return snapshot.join(one, ["path", "name", "symbol_kind"]).join(symbols.select(F.col("id").alias("from_symbol_id")), "from_symbol_id", "left_semi").select("from_symbol_id", "to_symbol_id", F.col("ref_kind").alias("kind"))


def callers_and_callees(refs: DataFrame, symbols: DataFrame, target: int, top: int = 5) -> DataFrame:
    """(side, id, name): the most important callers and callees of a symbol."""
    calls = refs.where("kind = 'call'")
    near = calls.where(F.col("to_symbol_id") == target).select(F.lit("caller").alias("side"), F.col("from_symbol_id").alias("id"))
    near = near.union(calls.where(F.col("from_symbol_id") == target).select(F.lit("callee"), "to_symbol_id")).distinct()
    rows = near.join(symbols.select("id", "name", "pagerank"), "id")
    return rows.withColumn("n", F.row_number().over(W.partitionBy("side").orderBy(F.desc("pagerank"), "id"))).where(F.col("n") <= top).select("side", "id", "name")


def call_levels(refs: DataFrame, symbols: DataFrame, name: str, direction: str = "both", depth: int = 1, limit: int = 50) -> DataFrame:
    """(direction, depth, name): names that calls lead to from a name, or from which they lead to it, at their least depth; the name itself is none of them.

    The walk goes from name to name over calls between symbols (`depth` is clamped to 1..10): only the names of the last level meet the calls.
    """
    from cairn.functions.session import settle

    if direction not in ("callers", "callees", "both"):
        raise ValueError("direction must be callers, callees or both")
    known = symbols.select("id", "name")
    calls = refs.where("kind = 'call'").select("from_symbol_id", "to_symbol_id").join(known.select(F.col("id").alias("from_symbol_id"), F.col("name").alias("a")), "from_symbol_id")
    calls = settle(calls.join(known.select(F.col("id").alias("to_symbol_id"), F.col("name").alias("b")), "to_symbol_id").where("a <> '' and b <> '' and a <> b").select("a", "b").distinct())
    start = known.where(F.col("name") == name).select("name").distinct()
    out = None
    for way, near, far in (("callees", "a", "b"), ("callers", "b", "a")):
        if direction not in (way, "both"):
            continue
        seen, level = start, start
        for k in range(1, min(max(depth, 1), 10) + 1):
            level = calls.join(level.select(F.col("name").alias(near)), near, "left_semi").select(F.col(far).alias("name")).distinct().join(seen, "name", "left_anti")
            level = settle(level)
            seen = seen.unionByName(level)
            rows = level.select(F.lit(way).alias("direction"), F.lit(k).alias("depth"), "name")
            out = rows if out is None else out.unionByName(rows)
            if level.isEmpty():
                break
    first = F.row_number().over(W.partitionBy("direction", "depth").orderBy("name"))
    return out.withColumn("n", first).where(F.col("n") <= limit).drop("n") if limit else out
