"""From parsed files to the tables of the code graph: files, symbols, import edges, references, call sites, type relations."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window as W, functions as F

from cairn.functions.session import settle
from cairn.operators.imports import resolve_imports
from cairn.operators.resolve import resolve_references
from cairn.sources.sinks import number_symbols, sequential


def written_imports(parsed: DataFrame) -> DataFrame:
    """(path, language, written): the specifiers of each file."""
    return parsed.select("path", "language", F.explode("imports").alias("written")).distinct()


def import_edges(imports: DataFrame, files: DataFrame, go_module: str | None = None) -> DataFrame:
    """(from_file, to_file, specifier) of the imports (path, language, written) that name another known file; files: id, path.

    A Rust `use` may end in an item, so where the whole path names no module, the path without its last part is taken.
    """
    outer = F.when((F.col("language") == "rust") & F.col("written").contains("::"), F.regexp_replace("written", "::[^:]*$", ""))
    rows = imports.select("path", "language", "written", F.posexplode(F.array("written", outer)).alias("n", "specifier")).where("specifier is not null")
    hits = rows.join(resolve_imports(rows, files, go_module), ["path", "specifier"])
    hits = hits.withColumn("best", F.min("n").over(W.partitionBy("path", "written"))).where("n = best")
    ends = hits.join(files.select("path", F.col("id").alias("from_file")), "path").join(files.select(F.col("path").alias("to_path"), F.col("id").alias("to_file")), "to_path")
    return ends.where("from_file <> to_file").select("from_file", "to_file", F.col("written").alias("specifier")).distinct()


def symbol_rows(own: DataFrame) -> DataFrame:
    """Symbols of parsed files with file_id, by their number in the file."""
    return own.select("file_id", F.posexplode("symbols").alias("idx", "s")).select("file_id", "idx", "s.*", F.lit(None).cast("int").alias("parent_idx"))


def call_rows(own: DataFrame) -> DataFrame:
    """(file_id, idx, owner, name, receiver, line, depth), one row a call of parsed files; idx and owner are those of the symbol that holds it. No rows are moved."""
    calls = own.select("file_id", "symbols", F.explode("calls").alias("c"))
    owner = F.when(F.col("c.idx") >= 0, F.get("symbols", F.col("c.idx"))["owner_type"])
    return calls.select("file_id", "c.idx", owner.alias("owner"), "c.name", "c.receiver", "c.line", "c.depth")


def call_sites(own: DataFrame, symbols: DataFrame) -> DataFrame:
    """(file_id, from_symbol_id, owner, name, receiver, line, depth), one row a call; calls outside any symbol have no from_symbol_id."""
    holder = symbols.select("file_id", "idx", F.col("id").alias("from_symbol_id"))
    return call_rows(own).join(holder, ["file_id", "idx"], "left").select("file_id", "from_symbol_id", "owner", "name", "receiver", "line", "depth")


def references(sites: DataFrame, symbols: DataFrame, edges: DataFrame) -> DataFrame:
    """(from_symbol_id, to_symbol_id, kind) of the calls that resolve."""
    names = sites.where("from_symbol_id is not null").select(F.struct("from_symbol_id", "name").alias("ref_id"), "file_id", "owner", "name", F.lit("call").alias("kind")).distinct()
    return resolve_references(names, symbols, edges).select("ref_id.from_symbol_id", "to_symbol_id", F.lit("call").alias("kind")).distinct()


def type_relations(own: DataFrame) -> DataFrame:
    """(file_id, sub_name, super_name, kind, line): one row a relation of a file, that of its first line."""
    rows = own.select("file_id", F.explode("relations").alias("r")).select("file_id", "r.*")
    return rows.groupBy("file_id", "sub_name", "super_name", "kind").agg(F.min("line").alias("line"))


def ingest(parsed: DataFrame, go_module: str | None = None) -> dict[str, DataFrame]:
    """The tables of `parse`'s rows: files (id by path), symbols (id by file and place), edges, refs (calls that resolve), sites, relations, imports.

    Each table is written once in the shared folder; texts pass Python once. Files without symbols or imports stay as files; an empty tree gives empty tables.
    """
    parsed = settle(parsed)
    files = settle(sequential(parsed.select("path", "language", "line_count"), ["path"], "id"))
    own = parsed.join(files.select("path", F.col("id").alias("file_id")), "path")
    symbols = settle(number_symbols(symbol_rows(own)))
    imports = settle(written_imports(parsed))
    edges = settle(import_edges(imports, files, go_module))
    sites = settle(call_sites(own, symbols))
    return {"files": files, "symbols": symbols, "edges": edges, "refs": settle(references(sites, symbols, edges)), "sites": sites, "relations": settle(type_relations(own)), "imports": imports}
