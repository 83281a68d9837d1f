"""Scores and composite analyses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window as W, functions as F

from cairn.functions import scalar as X
from cairn.operators.tables import min_max, page, positive, symbols_with_file


def file_complexity(symbols: DataFrame) -> DataFrame:
    return symbols.where("complexity is not null").groupBy("file_id").agg(F.max("complexity").alias("max_cc"), F.avg("complexity").alias("avg_cc"))


def hotspots(files: DataFrame, symbols: DataFrame, threshold: float | None = None) -> DataFrame:
    """Files with score = greatest complexity times importance times (1 + churn), where it is positive, and their health."""
    if threshold is not None and not 1 <= threshold <= 10:
        raise ValueError("threshold must be in 1..10")
    rows = files.join(file_complexity(symbols), files.id == F.col("file_id"))
    rows = rows.withColumn("score", F.col("max_cc") * F.col("pagerank") * (1 + F.col("change_count"))).where("score > 0")
    rows = rows.withColumn("health", X.health(F.col("max_cc"), F.col("pagerank"), F.col("change_count")))
    return rows if threshold is None else rows.where(F.col("health") <= threshold)


def symbol_hotspots(files: DataFrame, symbols: DataFrame) -> DataFrame:
    rows = symbols_with_file(symbols.where("complexity > 0"), files)
    return rows.withColumn("score", F.col("complexity") * F.col("pagerank") * (1 + F.col("change_count"))).where("score > 0")


#: Axes by which hotspots can be sorted: column, greatest first.
AXES = {"score": ("score", True), "health": ("health", False), "complexity": ("max_cc", True), "coupling": ("pagerank", True), "churn": ("change_count", True)}


def by_axis(rows: DataFrame, axis: str, limit: int) -> DataFrame:
    """The first hotspots by one of the axes, ties by id."""
    if axis not in AXES:
        raise ValueError(f"axis must be one of {', '.join(AXES)}")
    column, down = AXES[axis]
    return page(rows, [F.desc(column) if down else F.asc(column), "id"], limit)


def hot_score(files: DataFrame, symbols: DataFrame) -> DataFrame:
    rows = files.join(file_complexity(symbols), files.id == F.col("file_id"), "left")
    raw = F.col("pagerank") * (1 + F.log1p(F.coalesce("max_cc", F.lit(0)))) * (1 + F.log1p("change_count"))
    return min_max(rows.withColumn("raw", raw), "raw", "hot_score")


def god_functions(symbols: DataFrame, min_cc: int = 15, min_lines: int = 50) -> DataFrame:
    """Callables of great complexity and length; flat dispatchers by their match arms, where a column `arms` is given."""
    lines = F.greatest(F.lit(0), F.col("line_end") - F.col("line_start")) + 1
    rows = symbols.where(X.kind_in(F.col("kind"), "fn")).withColumn("lines", lines).where((F.col("complexity") >= min_cc) & (F.col("lines") >= min_lines))
    if "arms" not in rows.columns:
        return rows.withColumn("label", F.lit("god_function"))
    flat = (F.col("arms") >= 6) & (F.col("complexity") <= F.col("arms") + 5) | (F.col("arms") >= 12) & (F.col("arms") >= 0.4 * F.col("complexity"))
    return rows.withColumn("label", F.when(flat, "flat_dispatcher").otherwise("god_function"))


def long_parameters(symbols: DataFrame, least: int = 5) -> DataFrame:
    """Callables with many parameters. Signatures without four commas cannot have five and skip Python."""
    rows = symbols.where(X.kind_in(F.col("kind"), "fn")).where(F.regexp_count("signature", F.lit(",")) >= least - 1)
    return rows.withColumn("parameters", X.parameter_counts(F.col("signature"))).where(F.col("parameters") >= least)


def feature_envy(symbols: DataFrame, refs: DataFrame, ratio: float = 2.0, least: int = 2, dispatch: bool = True, shared: int = 3, fan_out: int = 5, share: float = 0.8) -> DataFrame:
    """Methods that call methods of another owner `ratio` times as often as their own: (id, envied, external, own, ratio), one row an envied owner.

    With `dispatch`, a call to a method name that `shared` owners or more have may go to any of them: an owner goes whose calls but one at most are such, and so
    does a caller with `fan_out` owners or more of whose calls this share is such.
    """
    if not 0 < ratio < float("inf"):
        raise ValueError("ratio must be positive and finite")
    source = symbols.where("kind = 'method' and owner_type is not null").where(~X.is_service_like(F.col("owner_type"))).select(F.col("id").alias("from_symbol_id"), F.col("owner_type").alias("owner"))
    target = symbols.where("owner_type is not null").where(X.has_self_receiver(F.col("signature"))).select(F.col("id").alias("to_symbol_id"), F.col("owner_type").alias("other"), F.col("name").alias("method"))
    owners = symbols.where("owner_type is not null").select("name", "owner_type").distinct().groupBy(F.col("name").alias("method")).agg(F.count("*").alias("owners")).where(F.col("owners") >= shared)
    target = target.join(owners, "method", "left")
    calls = refs.where("kind = 'call'").join(source, "from_symbol_id").join(target, "to_symbol_id").groupBy("from_symbol_id", "owner", "other")
    calls = calls.agg(F.count("*").alias("n"), F.count("owners").alias("any_of"))
    of, foreign = W.partitionBy("from_symbol_id"), F.col("owner") != F.col("other")
    total = lambda c: F.coalesce(F.sum(F.when(foreign, c)).over(of), F.lit(0))
    calls = calls.withColumn("own", F.coalesce(F.sum(F.when(~foreign, F.col("n"))).over(of), F.lit(0)))
    calls = calls.withColumn("spread", (total(F.lit(1)) >= fan_out) & (total(F.col("any_of")) >= share * total(F.col("n"))))
    out = calls.where(foreign).withColumn("ratio", F.when(F.col("own") == 0, F.col("n").cast("double")).otherwise(F.col("n") / F.col("own")))
    if dispatch:
        out = out.where(~F.col("spread") & (F.col("any_of") + 1 < F.col("n")))
    out = out.where((F.col("ratio") >= ratio) & (F.col("n") >= least))
    return out.select(F.col("from_symbol_id").alias("id"), F.col("other").alias("envied"), F.col("n").alias("external"), "own", "ratio")


def health_report(files: DataFrame, symbols: DataFrame, smells: DataFrame, min_cc: int = 15, max_health: float = 5.0) -> DataFrame:
    """Non-test files with a health of at most `max_health` that are hot or smell (file_id): severity Critical, High or Medium."""
    if not 0 <= max_health <= 10:
        raise ValueError("max_health must be in 0..10")
    rows = files.where(~X.is_test_path(F.col("path"))).join(file_complexity(symbols), files.id == F.col("file_id"))
    rows = rows.join(smells.select(F.col("file_id").alias("id")).distinct().withColumn("smells", F.lit(True)), "id", "left")
    hot = (F.col("max_cc") >= min_cc) & (F.col("pagerank") > 0) & (F.col("change_count") > 0)
    smell = F.coalesce("smells", F.lit(False))
    rows = rows.withColumn("health", X.health(F.col("max_cc"), F.col("pagerank"), F.col("change_count"))).where((hot | smell) & (F.col("health") <= max_health))
    return rows.withColumn("severity", F.when(hot & smell, "1 Critical").when(hot, "2 High").otherwise("3 Medium"))


def project_health(files: DataFrame, symbols: DataFrame, smells: DataFrame, top: int = 30) -> DataFrame:
    hot = page(hotspots(files, symbols), [F.desc("score"), "id"], top).select("id", F.lit(True).alias("hot"))
    rows = files.join(hot, "id", "left").join(smells.select(F.col("file_id").alias("id")).distinct().withColumn("smell", F.lit(True)), "id", "left")
    return rows.withColumn("level", F.when(F.col("hot") & F.col("smell"), "critical").when(F.col("smell"), "medium").when(F.col("hot"), "low").otherwise("ok"))


def health_summary(files: DataFrame, symbols: DataFrame, smells: DataFrame, top: int = 30) -> DataFrame:
    """One row over all flagged files, whatever a page shows of them: file_count, critical, medium, low, avg_health. Of files that only smell, the health is 0."""
    health = hotspots(files, symbols).select("id", "health")
    rows = project_health(files, symbols, smells, top).where("level <> 'ok'").join(health, "id", "left")
    of = lambda level: F.count(F.when(F.col("level") == level, 1)).alias(level)
    mean = F.avg(F.when(F.col("level") == "medium", 0.0).otherwise(F.col("health")))
    return rows.agg(F.count("*").alias("file_count"), of("critical"), of("medium"), of("low"), F.coalesce(mean, F.lit(0.0)).alias("avg_health"))


def quotas(rows: DataFrame, kind: str, order: list, limit: int) -> DataFrame:
    """At most `limit` rows, each kind by its share of all, one at least."""
    total = rows.groupBy(kind).agg(F.count("*").alias("of_kind"))
    every = W.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    total = total.withColumn("quota", F.greatest(F.lit(1), F.floor(F.lit(limit) * F.col("of_kind") / F.sum("of_kind").over(every))))
    n = F.row_number().over(W.partitionBy(kind).orderBy(*order))
    return rows.join(total, kind).withColumn("n", n).where("n <= quota")


def change_risk(files: DataFrame, symbols: DataFrame, changed: DataFrame, edges: DataFrame, violations: DataFrame) -> DataFrame:
    """(id, health, violations, tested, risk) of the changed files (id): clamp(10 - health + min(v, 3) / 2 + 1.5 without a test importer)."""
    rows = files.join(changed.select("id"), "id", "left_semi").join(file_complexity(symbols).withColumnRenamed("file_id", "id"), "id", "left")
    tests = files.where(X.is_test_path(F.col("path"))).select(F.col("id").alias("from_file"))
    tested = edges.join(tests, "from_file", "left_semi").select(F.col("to_file").alias("id")).distinct().withColumn("tested", F.lit(True))
    rows = rows.join(tested, "id", "left").join(violations, "id", "left")
    rows = rows.withColumn("health", X.health(F.coalesce("max_cc", F.lit(0)), F.col("pagerank"), F.col("change_count")))
    rows = rows.withColumn("tested", F.coalesce("tested", F.lit(False))).withColumn("violations", F.coalesce("violations", F.lit(0).cast("long")))
    risk = (10 - F.col("health")) + F.least("violations", F.lit(3)) * 0.5 + F.when(F.col("tested"), 0.0).otherwise(1.5)
    return rows.select("id", "path", "health", "violations", "tested", F.greatest(F.lit(0.0), F.least(F.lit(10.0), risk)).alias("risk"))


def convergence(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, n): files that import two changed files or more."""
    hit = edges.join(changed.select(F.col("id").alias("to_file")), "to_file", "left_semi")
    return hit.groupBy(F.col("from_file").alias("id")).agg(F.countDistinct("to_file").alias("n")).where("n >= 2")


def omissions(pairs: DataFrame, changed: DataFrame, top: int = 10) -> DataFrame:
    """(id, partner, count): each changed file's most frequent partners that are not changed."""
    both = pairs.select(F.col("file_a").alias("id"), F.col("file_b").alias("partner"), "count").union(pairs.select("file_b", "file_a", "count"))
    both = both.join(changed.select("id"), "id", "left_semi").join(changed.select(F.col("id").alias("partner")), "partner", "left_anti")
    return both.withColumn("n", F.row_number().over(W.partitionBy("id").orderBy(F.desc("count"), "partner"))).where(F.col("n") <= top).select("id", "partner", "count")


def test_file(files: DataFrame) -> Column:
    """Whether a file is a test: its column is_test where files have one, else its path says so."""
    return F.col("is_test") if "is_test" in files.columns else X.is_test_path(F.col("path"))


def test_map(files: DataFrame, edges: DataFrame) -> DataFrame:
    """(source, n_tests, tests): non-test files with the test files that import them."""
    tests = files.where(test_file(files)).select(F.col("id").alias("from_file"), F.col("path").alias("test"))
    sources = files.where(~test_file(files)).select(F.col("id").alias("to_file"), F.col("path").alias("source"))
    return edges.join(tests, "from_file").join(sources, "to_file").groupBy("source").agg(F.countDistinct("test").alias("n_tests"), F.min("test").alias("first_test"))


def test_gaps(files: DataFrame, symbols: DataFrame, edges: DataFrame, languages: list[str]) -> DataFrame:
    """(path, score): untested files of testable languages, worst first by (10 - health)(1 + importers / 10)."""
    tests = files.where(test_file(files)).select(F.col("id").alias("from_file"))
    tested = edges.join(tests, "from_file", "left_semi").select(F.col("to_file").alias("id")).distinct()
    rows = files.where(~test_file(files) & F.col("language").isin(languages)).join(tested, "id", "left_anti")
    importers = edges.groupBy(F.col("to_file").alias("id")).agg(F.countDistinct("from_file").alias("importers"))
    rows = rows.join(file_complexity(symbols).withColumnRenamed("file_id", "id"), "id", "left").join(importers, "id", "left")
    h = X.health(F.coalesce("max_cc", F.lit(0)), F.col("pagerank"), F.col("change_count"))
    return rows.select("path", ((10 - h) * (1 + F.coalesce("importers", F.lit(0)) / 10)).alias("score"))


def test_suggest(files: DataFrame, edges: DataFrame, pairs: DataFrame, changed: DataFrame) -> DataFrame:
    """(test, n_sources): tests that import changed sources or change with them, and changed tests themselves."""
    tests = files.where(test_file(files)).select(F.col("id").alias("test"))
    source = changed.select(F.col("id").alias("source"))
    importing = edges.select(F.col("from_file").alias("test"), F.col("to_file").alias("source")).join(source, "source", "left_semi").select("test", "source")
    often = omissions(pairs, changed).select(F.col("partner").alias("test"), F.col("id").alias("source"))
    own = source.select(F.col("source").alias("test"), "source")
    return importing.union(often).union(own).join(tests, "test", "left_semi").distinct().groupBy("test").agg(F.count("*").alias("n_sources"))


def context_rank(files: DataFrame, edges: DataFrame, pairs: DataFrame, target: int, mentioned: DataFrame, limit: int = 15) -> DataFrame:
    """(id, score): files worth reading with the target: imports 3 + 10 pr, importers 2 + 5 pr, partners 1.5 count (ten), two steps away 0.5, mentions 1."""
    rank = files.select("id", "pagerank")
    out = edges.where(F.col("from_file") == target).select(F.col("to_file").alias("id")).distinct().join(rank, "id").select("id", (3 + 10 * F.col("pagerank")).alias("score"))
    back = edges.where(F.col("to_file") == target).select(F.col("from_file").alias("id")).distinct().join(rank, "id").select("id", (2 + 5 * F.col("pagerank")).alias("score"))
    both = pairs.where(F.col("file_a") == target).select(F.col("file_b").alias("id"), "count").union(pairs.where(F.col("file_b") == target).select("file_a", "count"))
    often = page(both, [F.desc("count"), "id"], 10).select("id", (1.5 * F.col("count")).alias("score"))
    second = edges.join(back.select(F.col("id").alias("to_file")), "to_file", "left_semi").select(F.col("from_file").alias("id")).distinct().join(back.select("id"), "id", "left_anti").select("id", F.lit(0.5).alias("score"))
    said = mentioned.select("id", F.lit(1.0).alias("score"))
    rows = out.unionByName(back).unionByName(often).unionByName(second).unionByName(said).where(F.col("id") != target)
    return page(rows.groupBy("id").agg(F.sum("score").alias("score")), [F.desc(F.round("score", 9)), "id"], limit)


def guard(files: DataFrame, blast: DataFrame, acknowledged: DataFrame, min_rank: float = 0.05, min_blast: int = 10, now: Column | None = None, ttl: int = 600) -> DataFrame:
    """(id, denied): files of a great rank or blast radius (id, importers) are not edited without a fresh acknowledgement (id).

    With `now`, acknowledgements have a time `at` and are fresh for less than `ttl` seconds; none from after `now` or without a time is, and with a ttl of 0 none at all.
    """
    if now is not None:
        acknowledged = acknowledged.where((F.col("at") <= now) & (F.unix_micros(now) - F.unix_micros("at") < ttl * 1_000_000))
    rows = files.join(blast, "id", "left").join(acknowledged.select("id").distinct().withColumn("ack", F.lit(True)), "id", "left")
    heavy = (F.col("pagerank") >= min_rank) | (F.coalesce("importers", F.lit(0)) >= min_blast)
    return rows.select("id", (heavy & F.col("ack").isNull()).alias("denied"))


def refactor_plan(symbols: DataFrame, refs: DataFrame, tests: DataFrame, min_cc: int = 10) -> DataFrame:
    """(id, impact, safety): callables of complexity; safety counts 2 for tests (id), 1 each for private and for at most 3 callers."""
    callers = refs.groupBy(F.col("to_symbol_id").alias("id")).agg(F.countDistinct("from_symbol_id").alias("callers"))
    rows = symbols.where(X.kind_in(F.col("kind"), "fn")).where(F.col("complexity") >= max(positive("min_cc", min_cc), 5)).join(callers, "id", "left")
    rows = rows.join(tests.select("id").distinct().withColumn("tested", F.lit(2)), "id", "left")
    safety = F.coalesce("tested", F.lit(0)) + (~F.col("is_exported")).cast("int") + (F.coalesce("callers", F.lit(0)) <= 3).cast("int")
    return rows.select("id", F.when(F.col("complexity") >= 30, "HIGH").when(F.col("complexity") >= 20, "MEDIUM").otherwise("LOW").alias("impact"), F.when(safety <= 1, "RISKY").when(safety <= 3, "OK").otherwise("SAFE").alias("safety"))


def boundary_violations(edges: DataFrame, files: DataFrame, rules: list[dict]) -> DataFrame:
    """(rule_index, from_path, to_path): edges whose source fits a rule's `from`, whose target fits a deny and no allow; the first rule wins. Rules are
    configuration, so they become one expression."""
    rows = edges.select("from_file", "to_file").distinct().join(files.select(F.col("id").alias("from_file"), F.col("path").alias("from_path")), "from_file")
    rows = rows.join(files.select(F.col("id").alias("to_file"), F.col("path").alias("to_path")), "to_file")
    index = F.lit(None).cast("int")
    for k in reversed(range(len(rules))):
        any_of = lambda globs: F.col("to_path").rlike("|".join(map(X.glob_regex, globs))) if globs else F.lit(False)
        hit = F.col("from_path").rlike(X.glob_regex(rules[k]["from"])) & any_of(rules[k].get("deny")) & ~any_of(rules[k].get("allow"))
        index = F.when(hit, F.lit(k)).otherwise(index)
    return rows.withColumn("rule_index", index).where("rule_index is not null").select("rule_index", "from_path", "to_path")


def suggest_boundaries(edges: DataFrame, groups: DataFrame) -> DataFrame:
    """(from_group, to_group): ordered pairs of groups, over (id, group), that no edge crosses."""
    a, b = groups.select(F.col("id").alias("from_file"), F.col("group").alias("from_group")), groups.select(F.col("id").alias("to_file"), F.col("group").alias("to_group"))
    crossed = edges.join(a, "from_file").join(b, "to_file").select("from_group", "to_group").distinct()
    names = groups.select("group").distinct()
    other = names.agg(F.collect_set("group").alias("all"))  # one row of group names
    every = names.join(F.broadcast(other)).select(F.col("group").alias("from_group"), F.explode("all").alias("to_group")).where("from_group <> to_group")
    return every.join(crossed, ["from_group", "to_group"], "left_anti")


def cluster_edges(edges: DataFrame, groups: DataFrame) -> DataFrame:
    a, b = groups.select(F.col("id").alias("from_file"), F.col("group").alias("from_group")), groups.select(F.col("id").alias("to_file"), F.col("group").alias("to_group"))
    return edges.join(a, "from_file").join(b, "to_file").where("from_group <> to_group").groupBy("from_group", "to_group").agg(F.count("*").alias("n"))


def diff_impact(edges: DataFrame, changed: DataFrame) -> DataFrame:
    """(id, direct): unchanged files that import a changed one (id), directly or not."""
    from cairn.operators.graph import blast_of

    hit = blast_of(edges.select(F.col("from_file").alias("src"), F.col("to_file").alias("dst")), changed)
    return hit.groupBy(F.col("node").alias("id")).agg(F.max("direct").alias("direct")).join(changed.select("id"), "id", "left_anti")


def transitive_references(refs: DataFrame, symbols: DataFrame, edges: DataFrame, target: int, max_depth: int = 3) -> DataFrame:
    """(file_id, depth): files that refer to a symbol at depth 0, then files that import those, level by level."""
    from cairn.operators.graph import reach

    first = refs.where((F.col("to_symbol_id") == target) & (F.col("from_symbol_id") != target)).join(symbols.select(F.col("id").alias("from_symbol_id"), "file_id"), "from_symbol_id")
    seeds = first.select(F.lit(target).alias("seed"), F.col("file_id").alias("node")).distinct()
    back = edges.select(F.col("to_file").alias("src"), F.col("from_file").alias("dst"))
    return reach(back, seeds, max_depth).select(F.col("node").alias("file_id"), "depth")


def importer_groups(edges: DataFrame, files: DataFrame) -> DataFrame:
    """(path, importers, languages): how many files import a path, and in which languages, sorted."""
    source = files.select(F.col("id").alias("from_file"), F.col("language").alias("_l"))
    rows = edges.join(source, "from_file").groupBy("to_file").agg(F.count("*").alias("importers"), F.array_join(F.array_sort(F.collect_set("_l")), ",").alias("languages"))
    return rows.join(files.select(F.col("id").alias("to_file"), "path"), "to_file").select("path", "importers", "languages")


def impact(files: DataFrame, edges: DataFrame, pairs: DataFrame, target: int, top: int = 10) -> DataFrame:
    """(kind, id): direct and transitive importers outside tests, and the most frequent partners, of one file."""
    from cairn.operators.graph import blast_of

    one = files.where(F.col("id") == target).select("id")
    hit = blast_of(edges.select(F.col("from_file").alias("src"), F.col("to_file").alias("dst")), one).select(F.when(F.col("direct"), "direct").otherwise("transitive").alias("kind"), F.col("node").alias("id"))
    hit = hit.join(files.where(~X.is_test_path(F.col("path"))).select("id"), "id", "left_semi").select("kind", "id")
    often = omissions(pairs, one, top).select(F.lit("partner").alias("kind"), F.col("partner").alias("id"))
    return hit.unionByName(often)


def without_test_clones(members: DataFrame) -> DataFrame:
    """Clone members outside tests, of groups that keep two places."""
    rows = members.where(~X.is_test_path(F.col("path")))
    size = rows.groupBy("shape_hash").agg(F.count("*").alias("left")).where(F.col("left") >= 2).select("shape_hash")
    return rows.join(size, "shape_hash", "left_semi")
