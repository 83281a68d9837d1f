"""Analytics over commits, blame hunks and histories."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cairn.functions.session import dealt
from cairn.operators.graph import reach
from cairn.operators.tables import containing


def co_change_pairs(commits: DataFrame, files: DataFrame | None = None, least: int = 2, most: int = 20, n_rows: int | None = None) -> DataFrame:
    """(file_a, file_b, count) over (commit_id, file): pairs of one commit of `least` to `most` files. The size bound keeps the pairs of a commit few.

    With `files` (file), both ends must be known. If the number of rows is known (`n_rows`), a task holds so many however many there are; the rows of a commit meet once, and all
    that is asked of a commit is asked there."""
    rows = dealt(commits.select("commit_id", "file"), n_rows, "commit_id").distinct()
    size = rows.groupBy("commit_id").agg(F.count("*").alias("n")).where(F.col("n").between(least, most))
    rows = rows.join(size.select("commit_id"), "commit_id", "left_semi")
    if files is not None:
        rows = rows.join(files, "file", "left_semi")
    sets = rows.groupBy("commit_id").agg(F.array_sort(F.collect_list("file")).alias("f"))
    pairs = sets.select(F.posexplode("f").alias("i", "file_a"), "f").select("file_a", F.explode(F.slice("f", F.col("i") + 2, F.size("f"))).alias("file_b"))
    return pairs.groupBy("file_a", "file_b").agg(F.count("*").alias("count"))


def churn(commits: DataFrame) -> DataFrame:
    return commits.select("commit_id", "file").distinct().groupBy("file").agg(F.count("*").alias("change_count"))


def mined_commits(commits: DataFrame, limit: int = 300) -> DataFrame:
    """(commit_id, file) of the `limit` latest commits (commit_id, file, time, parent_count) that are no merges. The limit bounds what is broadcast."""
    plain = commits.where("parent_count <= 1")
    latest = plain.groupBy("commit_id").agg(F.max("time").alias("time")).orderBy(F.desc("time"), F.desc("commit_id")).limit(limit)
    return plain.join(F.broadcast(latest.select("commit_id")), "commit_id", "left_semi").select("commit_id", "file")


def plain_churn(commits: DataFrame) -> DataFrame:
    """(file, change_count) over all commits that are no merges, whatever their size."""
    return churn(commits.where("parent_count <= 1"))


def by_change(trends: DataFrame, limit: int = 0, name: str = "series") -> DataFrame:
    """Trends with the greatest change first, up or down, then by name."""
    rows = trends.orderBy(F.desc(F.abs(F.col("delta"))), name)
    return rows.limit(limit) if limit else rows


def co_changes_of(commits: DataFrame, target: int, most: int = 30) -> DataFrame:
    """(partner, count) of one file, over its commits of 2 to `most` files."""
    rows = commits.select("commit_id", "file").distinct()
    own = rows.where(F.col("file") == target).select("commit_id")
    rows = rows.join(own, "commit_id", "left_semi")
    size = rows.groupBy("commit_id").agg(F.count("*").alias("n")).where(F.col("n").between(2, most))
    return rows.join(size.select("commit_id"), "commit_id", "left_semi").where(F.col("file") != target).groupBy(F.col("file").alias("partner")).agg(F.count("*").alias("count"))


def bus_factor(lines: DataFrame, by: str) -> DataFrame:
    """(by, authors, lines, bus_factor) over (by, author, lines): the fewest authors that hold at least half the lines."""
    own = lines.groupBy(by, "author").agg(F.sum("lines").alias("lines"))
    order = W.partitionBy(by).orderBy(F.desc("lines"), "author")
    own = own.withColumn("n", F.row_number().over(order)).withColumn("held", F.sum("lines").over(order.rowsBetween(W.unboundedPreceding, 0)))
    own = own.withColumn("half", F.ceil(F.sum("lines").over(W.partitionBy(by)) / 2))
    return own.groupBy(by).agg(F.count("*").alias("authors"), F.sum("lines").alias("lines"), F.min(F.when(F.col("held") >= F.col("half"), F.col("n"))).alias("bus_factor"))


def author_rollup(hunks: DataFrame) -> DataFrame:
    """(author, lines, last_commit): lines and the commit of the greatest (time, commit)."""
    return hunks.groupBy("author").agg(F.sum("lines").alias("lines"), F.max_by("commit", F.struct("time", "commit")).alias("last_commit"))


def blame_of_span(hunks: DataFrame, spans: DataFrame, rows: int | None = None) -> DataFrame:
    """(id, author, lines, share): lines of each span (path, id, start, end) by author, over hunks (path, author, line_start, line_count).

    Two stretches share lines if the first line of one lies in the other, so hunks and spans meet where they overlap and nowhere else. Of hunks and of spans there are
    `rows` at most; if it is known, a task holds so many of them however many there are.
    """
    own = hunks.where("line_count > 0").select("path", "author", F.col("line_start").cast("long").alias("start"), (F.col("line_start") + F.col("line_count") - 1).cast("long").alias("end"))
    own = dealt(own, rows, "path", "author", "start", "end").groupBy("path", "author", "start", "end").agg(F.count("*").alias("times"))
    spans = spans.select("path", "id", F.col("start").cast("long").alias("start"), F.col("end").cast("long").alias("end"))
    begun = own.select("path", F.col("start").alias("at"), "author", F.col("end").alias("hunk_end"), "times")
    inside = dealt(containing(begun, spans, "path", rows), rows, "path", "at").join(dealt(begun, rows, "path", "at").hint("merge"), ["path", "at"]).select("id", "author", (F.least("end", "hunk_end") - F.col("at") + 1).alias("n"), "times")
    first = spans.select("path", F.col("start").alias("at"), "id", F.col("end").alias("span_end"))
    around = containing(first, own.select("path", F.struct("author", "times").alias("id"), "start", "end"), "path", rows).where("start < at").withColumnRenamed("id", "hunk")
    around = dealt(around, rows, "path", "at").join(dealt(first, rows, "path", "at").hint("merge"), ["path", "at"]).where("span_end >= at").select("id", "hunk.author", (F.least("end", "span_end") - F.col("at") + 1).alias("n"), "hunk.times")
    lines = dealt(inside.unionByName(around), rows, "id").groupBy("id", "author").agg(F.sum(F.col("n") * F.col("times")).alias("lines"))
    return lines.withColumn("share", F.col("lines") * 100.0 / F.sum("lines").over(W.partitionBy("id")))


def trend(points: DataFrame) -> DataFrame:
    """(series, n, first, last, delta, direction) of series with two points or more, ordered by seq."""
    own = points.groupBy("series").agg(F.count("*").alias("n"), F.min_by("value", "seq").alias("first"), F.max_by("value", "seq").alias("last")).where("n >= 2")
    own = own.withColumn("delta", F.when(F.col("first") == 0, 0.0).otherwise((F.col("last") - F.col("first")) / F.col("first") * 100))
    return own.withColumn("direction", F.when(F.col("delta") > 10, "GROWING").when(F.col("delta") < -10, "SHRINKING").otherwise("STABLE"))


def markers(points: DataFrame) -> DataFrame:
    """Each point with (+), (-) or nothing against the one before."""
    before = F.lag("value").over(W.partitionBy("series").orderBy("seq"))
    return points.withColumn("marker", F.when(F.col("value") > before, "(+)").when(F.col("value") < before, "(-)").otherwise(""))


def parse_range(spec: str) -> tuple[str, str]:
    """(from, to) of `from..to`; one name alone reaches up to HEAD."""
    start, dots, end = spec.partition("..")
    if not start:
        raise ValueError(f"range '{spec}' has no start")
    return start, end.lstrip(".") if dots and end.lstrip(".") else "HEAD"


def check_range(parents: DataFrame, start: str, end: str) -> None:
    """ValueError where `end` is an ancestor of `start`, by (commit, parent)."""
    line = parents.select(F.col("commit").alias("src"), F.col("parent").alias("dst"))
    seeds = parents.sparkSession.createDataFrame([(0, start)], "seed int, node string")
    if start != end and not reach(line, seeds).where(F.col("node") == end).isEmpty():
        raise ValueError(f"range reversed: did you mean {end}..{start}?")


def changed_in_range(trees: DataFrame, start: str, end: str) -> DataFrame:
    """Sorted paths that were added, changed or removed between two revisions, by their trees (rev, path, blob)."""
    side = lambda rev, name: trees.where(F.col("rev") == rev).select("path", F.col("blob").alias(name))
    both = side(start, "old").join(side(end, "new"), "path", "full")
    return both.where(~F.col("old").eqNullSafe(F.col("new"))).select("path").distinct().orderBy("path")
