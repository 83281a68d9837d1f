"""Lookups, joins, aggregates and pages over the code-graph tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairn.functions import scalar as X
from cairn.functions.session import dealt, settle


def positive(name: str, value: int, least: int = 1, most: int | None = None) -> int:
    """`value`, or ValueError outside least..most."""
    if value < least or most is not None and value > most:
        raise ValueError(f"{name} must be in {least}..{most if most is not None else ''}")
    return value


def clamp_limit(value: int | None, default: int, most: int) -> int:
    return value if value is not None and 1 <= value <= most else default


def page(df: DataFrame, order: list, limit: int = 0, offset: int = 0) -> DataFrame:
    """Sorted rows from `offset` on; no limit at 0."""
    df = df.orderBy(*order)
    df = df.offset(offset) if offset else df
    return df.limit(limit) if limit else df


def symbols_with_file(symbols: DataFrame, files: DataFrame) -> DataFrame:
    return symbols.join(files.select(F.col("id").alias("file_id"), "path", "language", F.col("pagerank").alias("file_pagerank"), "change_count"), "file_id")


def find_symbols(symbols: DataFrame, files: DataFrame, name: str | None = None, pattern: str | None = None, kind: str | None = None, scope: str | None = None) -> DataFrame:
    """By exact name or pattern, kind alias and directory."""
    rows = symbols_with_file(symbols, files)
    if name is not None:
        rows = rows.where(F.col("name") == name)
    if pattern is not None:
        rows = rows.where(X.name_matches(F.col("name"), pattern))
    if kind is not None:
        rows = rows.where(X.kind_in(F.col("kind"), kind))
    return rows.where(X.in_scope(F.col("path"), scope)) if scope is not None else rows


def stale_files(files: DataFrame, symbols: DataFrame) -> DataFrame:
    return files.join(symbols, files.id == symbols.file_id, "left_anti")


def language_stats(files: DataFrame, symbols: DataFrame) -> DataFrame:
    """Files, lines, bytes and symbols by language; typed files with a JavaScript suffix count as javascript. Symbols are counted before the join."""
    count = symbols.groupBy("file_id").agg(F.count("*").alias("n_symbols"))
    rows = files.join(count, files.id == count.file_id, "left")
    js = (F.col("language") == "typescript") & F.col("path").rlike(r"\.(js|jsx|mjs|cjs)$")
    rows = rows.withColumn("language", F.when(js, "javascript").otherwise(F.col("language")))
    return rows.groupBy("language").agg(F.count("*").alias("file_count"), F.sum("line_count").alias("lines"), F.sum("size_bytes").alias("bytes"), F.coalesce(F.sum("n_symbols"), F.lit(0)).alias("symbols"))


def most_imported(edges: DataFrame, files: DataFrame, limit: int) -> DataFrame:
    count = edges.groupBy(F.col("to_file").alias("id")).agg(F.count("*").alias("importers"))
    return page(count.join(files.select("id", "path"), "id"), [F.desc("importers"), "id"], limit)


def unused_exports(symbols: DataFrame, files: DataFrame, edges: DataFrame, refs: DataFrame) -> DataFrame:
    """Exported, not excluded, in a language with exports, in a file that nothing imports, without a reference to it."""
    rows = symbols_with_file(symbols.where("is_exported and not unused_excluded"), files).where(~F.col("language").isin(X.NO_EXPORT_LANGUAGES))
    rows = rows.join(edges.select(F.col("to_file").alias("file_id")).distinct(), "file_id", "left_anti")
    return rows.join(refs.select(F.col("to_symbol_id").alias("id")).distinct(), "id", "left_anti")


def references_of(refs: DataFrame, symbols: DataFrame, files: DataFrame, targets: DataFrame) -> DataFrame:
    """Distinct (target, referring symbol, its file) of the target ids."""
    hit = refs.join(targets.select(F.col("id").alias("to_symbol_id")), "to_symbol_id", "left_semi")
    source = symbols_with_file(symbols, files).select(F.col("id").alias("from_symbol_id"), F.col("name").alias("from_name"), "path")
    return hit.join(source, "from_symbol_id").select(F.col("to_symbol_id").alias("target"), "from_symbol_id", "from_name", "path").distinct()


def referenced_by_tests(symbols: DataFrame, refs: DataFrame, files: DataFrame) -> DataFrame:
    tests = symbols.join(files.where(X.is_test_path(F.col("path"))).select(F.col("id").alias("file_id")), "file_id", "left_semi").select(F.col("id").alias("from_symbol_id"))
    return symbols.join(refs.join(tests, "from_symbol_id", "left_semi").select(F.col("to_symbol_id").alias("id")), "id", "left_semi")


def clone_groups(symbols: DataFrame, min_lines: int = 3) -> DataFrame:
    """Shapes with at least two distinct places of `min_lines` or more."""
    span = F.col("line_end") - F.col("line_start") + 1
    rows = symbols.where("shape_hash is not null and shape_hash <> ''").where(span >= positive("min_lines", min_lines))
    return rows.groupBy("shape_hash").agg(F.countDistinct("file_id", "line_start", "line_end").alias("places"), F.avg(span).alias("avg_lines")).where("places >= 2")


def clone_members(symbols: DataFrame, files: DataFrame, groups: DataFrame) -> DataFrame:
    """Members of the groups, one per place, whatever their length."""
    rows = symbols_with_file(symbols, files).join(groups.select("shape_hash", "places"), "shape_hash")
    first = F.row_number().over(W.partitionBy("shape_hash", "file_id", "line_start", "line_end").orderBy("id"))
    return rows.withColumn("_n", first).where("_n = 1").select("shape_hash", "places", "id", "path", "line_start")


def clone_counts(symbols: DataFrame, min_lines: int = 3, limit: int = 0) -> DataFrame:
    """(shape_hash, members, avg_lines) by number of members, equal places counted each, then by length. No limit at 0."""
    span = F.col("line_end") - F.col("line_start") + 1
    rows = symbols.where("shape_hash is not null and shape_hash <> ''").where(span >= positive("min_lines", min_lines))
    return page(rows.groupBy("shape_hash").agg(F.count("*").alias("members"), F.avg(span).alias("avg_lines")).where("members >= 2"), [F.desc("members"), F.desc("avg_lines"), "shape_hash"], limit)


def common_traits(members: DataFrame, traits: DataFrame, group: str = "shape_hash") -> DataFrame:
    """(group, trait) of the traits (id, trait) that all members (group, id) of a group have."""
    size = members.select(group, "id").distinct().groupBy(group).agg(F.count("*").alias("_size"))
    own = members.select(group, "id").distinct().join(traits.select("id", "trait").distinct(), "id").groupBy(group, "trait").agg(F.count("*").alias("_n"))
    return own.join(size, group).where("_n = _size").select(group, "trait")


def _cells(spans: DataFrame, key: str) -> tuple[DataFrame, int]:
    """(spans with level and cell, the highest level): each span (start..end) is cut into the largest aligned cells of 2^level places, two a level at most."""
    longest = spans.agg(F.max(F.col("end") - F.col("start") + 1)).first()[0] or 1  # one number
    top = max(0, int(longest).bit_length() - 1)
    start, end, level = F.col("start").cast("long"), F.col("end").cast("long") + 1, F.col("level")
    rows = spans.where(f"`{key}` is not null and start <= end").withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    rows = rows.withColumn("_size", F.expr("shiftleft(1L, level)")).withColumn("_lo", -F.floor(-start / F.col("_size"))).withColumn("_hi", F.floor(end / F.col("_size")))
    odd, even = F.when(F.col("_lo") % 2 != 0, F.col("_lo")), F.when((F.col("_hi") - 1) % 2 == 0, F.col("_hi") - 1)
    cells = F.array_distinct(F.filter(F.array(odd, even), lambda c: c.isNotNull()))
    return rows.where("_lo < _hi").withColumn("cell", F.explode(cells)).drop("_size", "_lo", "_hi"), top


def _looked_up(points: DataFrame, key: str, top: int) -> DataFrame:
    """Distinct points (key, at) with the cell of each level that holds them."""
    rows = points.select(key, "at").where(f"`{key}` is not null and at is not null").distinct().withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(top))))
    return rows.withColumn("cell", F.floor(F.col("at") / F.expr("shiftleft(1L, level)")))


def containing(points: DataFrame, spans: DataFrame, key: str, rows: int | None = None) -> DataFrame:
    """(key, at, id, start, end): each place (key, at) with every span (key, id, start, end) that holds it, both ends included; places count once.

    Spans and points meet by equal cells, and the cells of a span lie apart, so each pair that meets is one of the result. Of more than `rows` points or spans
    there are none; if it is known, tasks hold so many rows however large the tables are. Cells are many more than the spans, so they are not broadcast.
    """
    cells, top = _cells(spans.select(key, "id", "start", "end"), key)
    by, many = [key, "level", "cell"], rows and rows * (top + 1)
    looked = _looked_up(dealt(points.select(key, "at"), rows, key, "at"), key, top)
    return dealt(looked, many, *by).join(dealt(cells, many, *by).hint("merge"), by).select(key, "at", "id", "start", "end")


def innermost(points: DataFrame, spans: DataFrame, key: str) -> DataFrame:
    """Each point (key, at) with the span (key, id, start, end) of the greatest start that holds it, of several the one of the greatest id.

    A cell keeps only its best span, so a point meets one row a level, however many spans are nested around it.
    """
    cells, top = _cells(spans.select(key, "id", "start", "end"), key)
    best = cells.groupBy(key, "level", "cell").agg(F.max(F.struct("start", "id")).alias("best"))
    found = _looked_up(points, key, top).join(best, [key, "level", "cell"]).groupBy(key, "at").agg(F.max("best").alias("best"))
    return points.join(found, [key, "at"]).select(*points.columns, F.col("best.id").alias("span_id")).distinct()


def partners(co_changes: DataFrame, target: int, limit: int) -> DataFrame:
    both = co_changes.select(F.col("file_a").alias("file"), F.col("file_b").alias("partner"), "count").union(co_changes.select("file_b", "file_a", "count"))
    return page(both.where(F.col("file") == target).select("partner", "count"), [F.desc("count"), "partner"], limit)


def min_max(rows: DataFrame, value: str, name: str) -> DataFrame:
    """`rows` with the value's place between the least and the greatest of all rows: two numbers that every task gets."""
    ends = rows.agg(F.min(value).alias("_low"), F.max(value).alias("_high"))
    at = F.when(F.col("_high") > F.col("_low"), (F.col(value) - F.col("_low")) / (F.col("_high") - F.col("_low"))).otherwise(0.0)
    return rows.join(F.broadcast(ends)).withColumn(name, at).drop("_low", "_high")  # one row


def round_robin(rows: DataFrame, bucket: str, order: list, limit: int) -> DataFrame:
    """One row of each bucket in turn until the limit."""
    n = F.row_number().over(W.partitionBy(bucket).orderBy(*order))
    return page(rows.withColumn("turn", n), ["turn", bucket], limit)


def running_total(rows: DataFrame, order: list, amount: Column, name: str) -> DataFrame:
    """`rows` with the sum of `amount` over all rows up to each, in an order without ties: sorted by ranges, then each partition goes on behind the totals of those before it.

    Only one total a partition is ever in one place.
    """
    placed = settle(rows.withColumn("_amount", amount).repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_at", F.monotonically_increasing_id()))
    placed = placed.withColumn("_part", F.shiftright("_at", 33))
    before = F.coalesce(F.sum("_n").over(W.orderBy("_part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    starts = placed.groupBy("_part").agg(F.sum("_amount").alias("_n")).select("_part", before.alias("_before"))
    own = F.sum("_amount").over(W.partitionBy("_part").orderBy("_at").rowsBetween(W.unboundedPreceding, 0))
    return placed.join(F.broadcast(starts), "_part").withColumn(name, F.col("_before") + own).drop("_part", "_at", "_amount", "_before")


def token_budget(rows: DataFrame, text: str, order: list, budget: int) -> DataFrame:
    """Rows in order for as long as their tokens stay in the budget; null texts have none."""
    return running_total(rows, order, X.tokens(F.coalesce(F.length(text), F.lit(0))), "spent").where(F.col("spent") <= budget)


def path_diff(indexed: DataFrame, other: DataFrame) -> DataFrame:
    """Paths only there (added), only here (removed), or in both (unchanged)."""
    both = indexed.select("path").distinct().withColumn("a", F.lit(1)).join(other.select("path").distinct().withColumn("b", F.lit(1)), "path", "full")
    return both.select("path", F.when(F.col("a").isNull(), "added").when(F.col("b").isNull(), "removed").otherwise("unchanged").alias("state"))


def slices(bodies: DataFrame, start: Column, count: Column) -> DataFrame:
    """Lines start.. of each text (1-based)."""
    return bodies.withColumn("slice", F.array_join(F.slice(F.split("text", "\n"), start, count), "\n"))
