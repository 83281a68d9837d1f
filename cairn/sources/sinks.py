"""Sinks as DataFrame rewrites: upserts, inserts, cascading deletes, ids, integrity and maintenance reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cairn.functions.session import settle


def sequential(rows: DataFrame, order: list[str], name: str, first: int = 1) -> DataFrame:
    """`rows` with gapless numbers in an order without ties: sorted by ranges, then each partition goes on behind the counts of those before it.

    Only one count a partition is ever in one place.
    """
    placed = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    part, at = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = placed.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = counts.select("_part", before.alias("_before"))
    return placed.withColumn("_part", part).join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + at + first).drop("_at", "_part", "_before")


def upsert(old: DataFrame, new: DataFrame, key: list[str], order: str | None = None) -> DataFrame:
    """New rows replace old ones of the same key; of several new ones the greatest by `order` stays."""
    if order is not None:
        new = new.withColumn("_n", F.row_number().over(W.partitionBy(*key).orderBy(F.desc(order)))).where("_n = 1").drop("_n")
    return old.join(new.select(*key), key, "left_anti").unionByName(new, allowMissingColumns=True)


def upsert_files(old: DataFrame, new: DataFrame) -> DataFrame:
    """Files keep their id over an upsert by path; new paths go on behind the greatest id."""
    top = old.agg(F.coalesce(F.max("id"), F.lit(0)).alias("top"))
    rows = new.drop("id").join(old.select("path", "id"), "path", "left").join(F.broadcast(top))  # one row
    known, fresh = rows.where("id is not null").drop("top"), rows.where("id is null").drop("id")
    fresh = sequential(fresh, ["path"], "id").withColumn("id", F.col("top") + F.col("id")).drop("top")
    return old.join(new.select("path"), "path", "left_anti").unionByName(known.unionByName(fresh), allowMissingColumns=True)


def add_counts(old: DataFrame, new: DataFrame, key: list[str], count: str = "count") -> DataFrame:
    return old.unionByName(new).groupBy(*key).agg(F.sum(count).alias(count))


def insert_or_ignore(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    return old.unionByName(new.dropDuplicates(key).join(old.select(*key), key, "left_anti"))


def number_symbols(rows: DataFrame, first_id: int = 1) -> DataFrame:
    """Ids by (file_id, idx), and parent_id from parent_idx where that names an earlier symbol of the file."""
    out = sequential(rows, ["file_id", "idx"], "id", first_id)
    parent = out.select("file_id", F.col("idx").alias("parent_idx"), F.col("id").alias("_parent"))
    return out.join(parent, ["file_id", "parent_idx"], "left").withColumn("parent_id", F.when(F.col("parent_idx") < F.col("idx"), F.col("_parent"))).drop("_parent")


def delete_files(tables: dict[str, DataFrame], gone: DataFrame) -> dict[str, DataFrame]:
    """All tables without the files (id) and whatever hangs on them."""
    file_id = gone.select(F.col("id").alias("_gone")).distinct()
    drop = lambda df, column: df.join(file_id, F.col(column) == F.col("_gone"), "left_anti")
    out = dict(tables)
    out["files"], out["symbols"] = drop(tables["files"], "id"), drop(tables["symbols"], "file_id")
    for name, columns in (("edges", ["from_file", "to_file"]), ("co_changes", ["file_a", "file_b"])):
        if name in out:
            for c in columns:
                out[name] = drop(out[name], c)
    if "refs" in out:
        kept = out["symbols"].select("id")
        for c in ("from_symbol_id", "to_symbol_id"):
            out["refs"] = out["refs"].join(kept.withColumnRenamed("id", c), c, "left_semi")
    return out


def clear_content(tables: dict[str, DataFrame], files: DataFrame) -> dict[str, DataFrame]:
    """All tables without what the files (id) hold: symbols, call sites, relations, their import edges, and references from or to their symbols. The files stay."""
    file_id = files.select(F.col("id").alias("_gone")).distinct()
    out = dict(tables)
    for name, column in (("symbols", "file_id"), ("sites", "file_id"), ("relations", "file_id"), ("edges", "from_file")):
        if name in out:
            out[name] = out[name].join(file_id, F.col(column) == F.col("_gone"), "left_anti")
    if "refs" in out:
        gone = tables["symbols"].join(file_id, F.col("file_id") == F.col("_gone"), "left_semi").select(F.col("id").alias("_symbol"))
        for c in ("from_symbol_id", "to_symbol_id"):
            out["refs"] = out["refs"].join(gone, F.col(c) == F.col("_symbol"), "left_anti")
    return out


def under_prefix(files: DataFrame, prefix: str) -> DataFrame:
    """Files below a root alias, whatever wild cards its name holds."""
    return files.where(F.col("path").startswith(prefix.rstrip("/") + "/"))


def orphans(tables: dict[str, DataFrame]) -> DataFrame:
    """(reference, n): dangling ends, by column."""
    checks = [("symbols.file_id", "symbols", "file_id", "files"), ("edges.from_file", "edges", "from_file", "files"), ("edges.to_file", "edges", "to_file", "files"), ("refs.from_symbol_id", "refs", "from_symbol_id", "symbols"), ("refs.to_symbol_id", "refs", "to_symbol_id", "symbols")]
    out = None
    for name, table, column, target in checks:
        n = tables[table].join(tables[target].select(F.col("id").alias("_id")), F.col(column) == F.col("_id"), "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("reference"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def row_counts(tables: dict[str, DataFrame]) -> DataFrame:
    out = None
    for name, df in tables.items():
        n = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("name"), "n")
        out = n if out is None else out.unionByName(n)
    return out


def fingerprint(files: DataFrame) -> DataFrame:
    """One row that changes whenever a path, time or size does; order plays no part."""
    return files.agg(F.count("*").alias("n"), F.sum(F.xxhash64("path", "mtime_ns", "size_bytes").cast("decimal(38,0)")).alias("digest"))


def symbol_bodies(files: DataFrame, symbols: DataFrame, most_lines: int = 500) -> DataFrame:
    """(symbol_id, body, embed_text): the lines of each symbol, `most_lines` at most, out of files (file_id, text)."""
    rows = symbols.join(files.select("file_id", F.split("text", "\n").alias("_lines")), "file_id").where(F.col("line_start") <= F.size("_lines"))
    count = F.least(F.lit(most_lines), F.greatest(F.lit(1), F.col("line_end") - F.col("line_start") + 1)).cast("int")
    body = F.array_join(F.slice("_lines", F.col("line_start").cast("int"), count), "\n")
    return rows.select(F.col("id").alias("symbol_id"), body.alias("body"), F.concat("kind", F.lit(" "), "name", F.lit("\n"), body).alias("embed_text"))


def mailmapped(hunks: DataFrame, mailmap: DataFrame) -> DataFrame:
    """Blame hunks with canonical authors: mailmap (alias, name); no author counts as unknown."""
    named = hunks.join(mailmap.select(F.col("alias").alias("author"), F.col("name").alias("_name")), "author", "left")
    return named.withColumn("author", F.coalesce("_name", F.when(F.trim("author") != "", F.col("author")), F.lit("unknown"))).drop("_name")
