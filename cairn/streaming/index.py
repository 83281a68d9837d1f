"""The base tables of the code graph under versions: a batch of file events parses the changed files alone.

What else a change can move is found by keys: import edges of other files move only when paths come or go, and a call of another file resolves anew only
if a symbol of its name came or went, or if the imports of its file moved. So the tables after any events equal those of an `ingest` of all files, but for ids,
which files keep over all versions and unchanged symbols, too. All tables of a version are committed by one mark.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.functions.session import settle
from cairn.sources.files import parse
from cairn.sources.ingest import call_sites, import_edges, ingest, references, symbol_rows, type_relations, written_imports
from cairn.sources.sinks import clear_content, number_symbols, upsert_files
from cairn.streaming import watch

TABLES = ["files", "symbols", "edges", "refs", "sites", "relations", "imports"]


def apply_changes(tables: dict[str, DataFrame], parsed: DataFrame, gone: DataFrame, go_module: str | None = None) -> dict[str, DataFrame]:
    """The tables after a batch: `parsed` are `parse`'s rows of files that are new or changed, one a path; `gone` (path) are deleted, unless they are among them."""
    parsed = settle(parsed)
    gone = settle(gone.select("path").distinct().join(parsed, "path", "left_anti").join(tables["files"], "path", "left_semi"))
    touched = settle(parsed.select("path").unionByName(gone))
    old_ids = settle(tables["files"].join(touched, "path", "left_semi").select("id"))
    files = settle(upsert_files(tables["files"], parsed.select("path", "language", "line_count").withColumn("id", F.lit(None).cast("long"))).join(gone, "path", "left_anti"))
    same_paths = gone.isEmpty() and parsed.join(tables["files"], "path", "left_anti").isEmpty()
    own = parsed.join(files.select("path", F.col("id").alias("file_id")), "path")
    left = clear_content(tables, old_ids)
    top = tables["symbols"].agg(F.max("id")).first()[0] or 0  # one number
    fresh = settle(number_symbols(symbol_rows(own), top + 1))
    symbols = settle(left["symbols"].unionByName(fresh))
    sites = settle(left["sites"].unionByName(call_sites(own, fresh)))
    relations = left["relations"].unionByName(type_relations(own))
    imports = settle(tables["imports"].join(touched, "path", "left_anti").unionByName(written_imports(parsed)))
    edges = left["edges"].unionByName(import_edges(imports.join(touched, "path", "left_semi"), files, go_module)) if same_paths else import_edges(imports, files, go_module)
    edges = settle(edges)
    # Calls that may resolve to something else: those of these names, and those of these files.
    cleared = tables["symbols"].join(old_ids.withColumnRenamed("id", "file_id"), "file_id", "left_semi")
    names = settle(cleared.select("name").unionByName(fresh.select("name")).distinct())
    before, now = tables["edges"].select("from_file", "to_file"), edges.select("from_file", "to_file")
    moved = before.exceptAll(now).unionByName(now.exceptAll(before)).select(F.col("from_file").alias("file_id"))
    sources = settle(moved.unionByName(own.select("file_id")).distinct())
    again = sites.join(names, "name", "left_semi").unionByName(sites.join(names, "name", "left_anti").join(sources, "file_id", "left_semi"))
    again = settle(again)
    ends = tables["symbols"].select("id", "name", "file_id")
    kept = left["refs"].join(ends.select(F.col("id").alias("to_symbol_id"), "name"), "to_symbol_id").join(names, "name", "left_anti")
    kept = kept.join(ends.select(F.col("id").alias("from_symbol_id"), "file_id"), "from_symbol_id").join(sources, "file_id", "left_anti")
    wanted = symbols.join(again.select("name").distinct(), "name", "left_semi")
    refs = kept.select("from_symbol_id", "to_symbol_id", "kind").unionByName(references(again, wanted, edges))
    return {"files": files, "symbols": symbols, "edges": edges, "refs": refs, "sites": sites, "relations": relations, "imports": imports}


def load_index(spark: SparkSession, folder: str) -> dict[str, DataFrame] | None:
    """The tables of the last version; None where there is none yet."""
    known = watch.versions(spark, folder)
    return {name: spark.read.parquet(f"{folder}/version={known[-1]}/{name}") for name in TABLES} if known else None


def maintain_index(events: DataFrame, folder: str, checkpoint: str, read: Callable[[DataFrame], DataFrame], go_module: str | None = None, trigger: dict | None = None):
    """Starts the stream of index versions. read(paths) gives (path, text, language) of those (path) that can be read; a changed path that cannot be is gone."""

    def write(batch: DataFrame, path: str) -> None:
        now = watch.coalesce_events(batch).groupBy("path").agg(F.max((F.col("op") == "changed").cast("int")).alias("changed"))
        parsed = settle(parse(read(now.where("changed = 1").select("path"))))
        tables = load_index(batch.sparkSession, folder)
        gone = now.select("path").join(parsed, "path", "left_anti")
        tables = ingest(parsed, go_module) if tables is None else apply_changes(tables, parsed, gone, go_module)
        for name in TABLES:
            tables[name].write.mode("overwrite").parquet(f"{path}/{name}")

    return watch.in_versions(events, folder, checkpoint, write, None, trigger)
