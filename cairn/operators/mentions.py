"""What tests cover beside what they import: names of modules in their words, keys of dispatchers in their strings, and tests inside the source file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions import scalar as X
from cairn.functions.session import settle
from cairn.operators import scores

#: Rust files whose name says nothing of their module.
UNNAMED = ["mod", "lib", "main"]
#: Fixed value: attributes that mark a test inside a Rust file.
INLINE = r"#\[cfg\(test\)\]|#\[test\]|#\[[A-Za-z0-9:_]+::test\]"

#: Fixed value: a call of a dispatcher by a key.
DISPATCHER = r'call_tool_by_name\s*\(\s*"([A-Za-z_][A-Za-z0-9_]*)"'


def _words(text: Column) -> Column:
    return F.filter(F.split(F.lower(F.coalesce(text, F.lit(""))), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def module_stem(path: Column) -> Column:
    """The module that a Rust file is by its name; null for other files and for names that are no identifiers."""
    stem = F.regexp_extract(path, r"(?:^|/)([A-Za-z_][A-Za-z0-9_]*)\.rs$", 1)
    return F.when(~stem.isin("", *UNNAMED), stem)


def _sides(files: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(tests, sources), by the column is_test where files have one, else by path."""
    test = F.coalesce(scores.test_file(files), F.lit(False))
    return files.where(test), files.where(~test)


def mentioned(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(id) of the source files whose module name stands in a test file, as a word or as words in a row; files: id, path; texts: id, text.

    Tests give their distinct word sequences of the lengths that module names have, and these meet the distinct names: no pair of test and file is made, so a
    name that all tests hold or that many files bear costs no more than a rare one. Case and marks between words do not count; a text that is null has no words.
    """
    tests, sources = _sides(files)
    own = sources.select("id", _words(module_stem(F.col("path"))).alias("words")).where(F.size("words") > 0)
    own = settle(own.select("id", F.size("words").alias("k"), F.array_join("words", " ").alias("name")))
    # A file name has 255 bytes at most, so there are at most 128 lengths.
    lengths = sorted(r.k for r in own.select("k").distinct().collect())
    if not lengths:
        return own.select("id")
    rows = texts.join(tests.select("id"), "id", "left_semi").select(_words(F.col("text")).alias("words"))

    def sequences(k: int) -> Column:
        at = F.when(F.size("words") >= k, F.sequence(F.lit(1), F.size("words") - (k - 1))).otherwise(F.array().cast("array<int>"))
        return F.array_distinct(F.transform(at, lambda i: F.array_join(F.slice("words", i, k), " ")))

    said = rows.select(F.explode(F.concat(*[sequences(k) for k in lengths])).alias("name")).distinct()
    names = own.select("name").distinct().join(said, "name", "left_semi")
    return own.join(names, "name", "left_semi").select("id")


def dispatched(files: DataFrame, texts: DataFrame, pattern: str = DISPATCHER) -> DataFrame:
    """(test, source) ids where a string of the test, found by the first group of `pattern`, is the source file's name without its ending, with or without one
    prefix and underscore before it; files: id, path; texts: id, text. Case does not count; each pair comes once."""
    tests, sources = _sides(files)
    stem = F.lower(F.regexp_replace(X.basename(F.col("path")), r"\.[^.]*$", ""))
    stems = sources.select(F.col("id").alias("source"), stem.alias("stem")).where("stem <> ''")
    found = texts.join(tests.select("id"), "id", "left_semi").select(F.col("id").alias("test"), F.explode(F.array_distinct(F.transform(F.regexp_extract_all("text", F.lit(pattern), F.lit(1)), F.lower))).alias("literal"))
    parts = F.split("literal", "_")
    keys = found.select("test", F.explode(F.array(F.col("literal"), F.get(parts, F.lit(1)))).alias("stem")).where("stem is not null").distinct()
    return keys.join(stems, "stem").select("test", "source").distinct()


def inline_tested(files: DataFrame, texts: DataFrame) -> DataFrame:
    """(id) of the Rust files with a test of their own; files: id, path; texts: id, text."""
    return texts.where(F.col("text").rlike(INLINE)).join(files.where(F.col("path").endswith(".rs")).select("id"), "id", "left_semi").select("id").distinct()


def coverage(files: DataFrame, edges: DataFrame, texts: DataFrame, pattern: str = DISPATCHER) -> DataFrame:
    """(test, source) ids: tests that import a source file or call it by a dispatcher's key; edges: from_file, to_file."""
    tests, sources = _sides(files)
    imports = edges.select(F.col("from_file").alias("test"), F.col("to_file").alias("source")).join(tests.select(F.col("id").alias("test")), "test", "left_semi")
    imports = imports.join(sources.select(F.col("id").alias("source")), "source", "left_semi").select("test", "source")
    return imports.unionByName(dispatched(files, texts, pattern)).distinct()


def coverage_map(pairs: DataFrame, files: DataFrame, side: str = "source") -> DataFrame:
    """(path, n, first): of each covered source its tests, or with side `test` of each test its sources; how many, and the least path of them."""
    if side not in ("source", "test"):
        raise ValueError("side must be source or test")
    other = "test" if side == "source" else "source"
    named = pairs.join(files.select(F.col("id").alias(other), F.col("path").alias("partner")), other)
    counts = named.groupBy(F.col(side).alias("id")).agg(F.count("*").alias("n"), F.min("partner").alias("first"))
    return counts.join(files.select("id", "path"), "id").select("path", "n", "first")


def untested(files: DataFrame, edges: DataFrame, texts: DataFrame, languages: list[str]) -> DataFrame:
    """The rows of `files` that are sources of testable languages, that no test imports, that have no test inside and that no test mentions."""
    tests, sources = _sides(files)
    imported = edges.join(tests.select(F.col("id").alias("from_file")), "from_file", "left_semi").select(F.col("to_file").alias("id"))
    covered = imported.union(inline_tested(files, texts)).union(mentioned(files, texts)).distinct()
    return sources.where(F.col("language").isin(languages)).join(covered, "id", "left_anti")


def gaps(files: DataFrame, symbols: DataFrame, edges: DataFrame, texts: DataFrame, languages: list[str], min_rank: float = 0.0, scope: str | None = None) -> DataFrame:
    """(path, score) of the untested files, by (10 - health)(1 + importers / 10); `scope` is a file or a directory."""
    open_files = untested(files, edges, texts, languages).where(F.col("pagerank") >= min_rank)
    if scope is not None:
        open_files = open_files.where((F.col("path") == scope) | F.col("path").startswith(scope.rstrip("/") + "/"))
    # No test is among the files that are left, so the scores see all importers and rule out nothing more.
    return scores.test_gaps(open_files, symbols, edges, languages)


def suggest(files: DataFrame, edges: DataFrame, pairs: DataFrame, texts: DataFrame, changed: DataFrame, languages: list[str]) -> DataFrame:
    """(kind, id, n_sources): kind `run` for the tests to run after a change (ids), `untested` for changed sources that have no test to run, no test inside and no mention."""
    run = scores.test_suggest(files, edges, pairs, changed).select(F.lit("run").alias("kind"), F.col("test").alias("id"), "n_sources")
    tests = files.where(scores.test_file(files)).select(F.col("id").alias("partner"))
    with_partner = scores.omissions(pairs, changed).join(tests, "partner", "left_semi").select("id")
    rest = untested(files.join(changed.select("id"), "id", "left_semi").unionByName(files.where(scores.test_file(files))).dropDuplicates(["id"]), edges, texts, languages)
    rest = rest.join(with_partner, "id", "left_anti").select(F.lit("untested").alias("kind"), "id", F.lit(0).cast("long").alias("n_sources"))
    return run.unionByName(rest)
