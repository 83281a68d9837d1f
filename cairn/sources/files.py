"""Sources: source trees, configuration, commit logs, blame output."""

from __future__ import annotations

import os
import re
import tomllib

import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from cairn.sources.ignore import kept
from cairn.sources.outline import Outline, lines_of_code

#: Languages by file suffix.
SUFFIXES = {"py": "python", "rs": "rust", "ts": "typescript", "tsx": "typescript", "js": "javascript", "go": "go", "java": "java", "c": "c", "h": "c", "cpp": "cpp", "rb": "ruby", "sh": "bash", "md": "markdown", "toml": "toml", "yaml": "yaml", "yml": "yaml", "json": "json", "sql": "sql"}

IMPORTS = {
    "python": r"^\s*(?:from\s+([\w.]+)\s+import|import\s+([\w.]+))", "rust": r"^\s*(?:pub\s+)?use\s+([\w:]+)", "go": r'^\s*(?:import\s+)?"([^"]+)"\s*$',
    "typescript": r"""^\s*(?:import|export)\b.*?['"]([^'"]+)['"]""", "java": r"^\s*import\s+(?:static\s+)?([\w.]+)",
}
IMPORTS["javascript"] = IMPORTS["typescript"]


#: File names that hold a language without a suffix.
FILENAMES = {"Dockerfile": "dockerfile", "Containerfile": "dockerfile", "Makefile": "makefile", "makefile": "makefile", "GNUmakefile": "makefile"}


def language_of(name: str) -> str | None:
    """By the whole file name, else by its suffix."""
    return FILENAMES.get(name) or (SUFFIXES.get(name.rpartition(".")[2].lower()) if "." in name else None)


def walk(spark: SparkSession, root: str, max_bytes: int = 1_000_000, ignore: tuple[str, ...] = (".gitignore",)) -> DataFrame:
    """(path, mtime_ns, size_bytes, text, language) of the source files under root, a path or an address that Arrow's file systems know.

    Hidden and empty files count, too (Spark's own readers pass over names that begin with a dot or an underscore). Left out: .git, what ignore files of these
    names or .git/info/exclude name, unknown languages, files over `max_bytes` and those that are not UTF-8. The driver lists names, as Spark's file index
    does; the texts are read by the executors, which must see the same root.
    """
    fs, top = pafs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
    listed = [f for f in fs.get_file_info(pafs.FileSelector(top, recursive=True)) if f.type == pafs.FileType.File]
    below = {f.path[len(top) :].lstrip("/"): f for f in listed}
    texts: dict[str, str] = {}
    for path in sorted(below, key=lambda x: (x != ".git/info/exclude", x)):
        if path == ".git/info/exclude" or path.rpartition("/")[2] in ignore and not path.startswith(".git/"):
            with fs.open_input_stream(below[path].path) as f:
                folder = "" if path == ".git/info/exclude" else path.rpartition("/")[0]
                texts[folder] = texts.get(folder, "") + f.read().decode("utf-8", "replace") + "\n"
    found = [below[p] for p in kept([p for p in below if not re.search(r"(^|/)\.git/", p)], texts)]
    rows = [("/" + f.path.lstrip("/"), f.mtime_ns, f.size, f.path, language_of(f.base_name)) for f in found if f.size <= max_bytes and language_of(f.base_name)]
    parts = max(1, sum(32_768 + r[2] for r in rows) // 33_554_432)
    files = spark.createDataFrame(rows, "path string, mtime_ns long, size_bytes long, _at string, language string").repartition(parts)

    def read(batches):
        own, _ = pafs.FileSystem.from_uri(root if "://" in root else os.path.abspath(root))
        for pdf in batches:
            for start in range(0, len(pdf), 64):
                part, texts = pdf.iloc[start : start + 64].copy(), []
                for at in part.pop("_at"):
                    with own.open_input_stream(at) as f:
                        content = f.read()
                    try:
                        texts.append(content.decode("utf-8"))
                    except UnicodeDecodeError:
                        texts.append(None)
                part.insert(3, "text", texts)
                yield part[part["text"].notna()]

    return files.mapInPandas(read, "path string, mtime_ns long, size_bytes long, text string, language string")


def changed_files(found: DataFrame, known: DataFrame) -> DataFrame:
    """Those whose (path, mtime_ns) is not known yet."""
    return found.join(known.select("path", "mtime_ns"), ["path", "mtime_ns"], "left_anti")


def tree_listing(lines: DataFrame) -> DataFrame:
    """(rev, path, blob) of the files in `mode type id<tab>path` lines (rev, line), as a recursive listing of a revision's tree has them."""
    head = F.split(F.substring_index("line", "\t", 1), " +")
    return lines.where(F.get(head, F.lit(1)) == "blob").select("rev", F.regexp_extract("line", r"^[^\t]*\t(.*)$", 1).alias("path"), F.get(head, F.lit(2)).alias("blob"))


SYMBOL = "struct<name:string,kind:string,line_start:int,line_end:int,signature:string,is_exported:boolean,owner_type:string,complexity:int,arms:int,shape_hash:string>"
PARTS = {
    "symbols": f"array<{SYMBOL}>", "imports": "array<string>", "calls": "array<struct<idx:int,name:string,receiver:string,line:int,depth:int>>",
    "relations": "array<struct<sub_name:string,super_name:string,kind:string,line:int>>",
}
#: Files that leave a task at once.
PIECE = 256


def imports_of(outline: Outline) -> list[str]:
    """Written specifiers, by line patterns over the lines that begin in code."""
    pattern = re.compile(IMPORTS.get(outline.language) or "(?!)")
    found = (pattern.match(line) for _, line in lines_of_code(outline))
    return [next(g for g in m.groups() if g) for m in found if m and any(m.groups())]


def parse(files: DataFrame, parts: tuple[str, ...] = tuple(PARTS)) -> DataFrame:
    """(path, language, line_count, symbols, imports, calls, relations) of walked files: one Arrow pass, one row a file. Of the last four, those named in `parts`.

    All but the specifiers of imports come from the tokens, so what strings and comments hold counts for nothing. Other languages than those of
    the outline give files without symbols. Files are dealt out by path first: a table that is small on disk may hold many, and lexing costs more than moving
    them. A task holds the outline of one file and the rows of PIECE.
    """
    fields = re.findall(r"(\w+):", SYMBOL)

    def row(text: str, language: str | None) -> dict:
        o, out = Outline(text, language, "symbols" in parts, "calls" in parts), {"line_count": text.count("\n") + (0 if text.endswith("\n") else 1)}
        if "symbols" in parts:
            out["symbols"] = [{f: s[f] for f in fields} for s in o.symbols]
        if "imports" in parts:
            out["imports"] = imports_of(o)
        if "calls" in parts:
            out["calls"] = o.calls if o.symbols else []
        if "relations" in parts:
            out["relations"] = [dict(zip(("sub_name", "super_name", "kind", "line"), r, strict=True)) for r in o.relations]
        return out

    def run(batches):
        for batch in batches:
            for start in range(0, batch.num_rows, PIECE):
                part = batch.slice(start, PIECE).to_pylist()
                yield pa.RecordBatch.from_pylist([{"path": r["path"], "language": r["language"]} | row(r["text"], r["language"]) for r in part], schema)

    names = [p for p in PARTS if p in parts]
    columns = "path string, language string, line_count long" + "".join(f", {p} {PARTS[p]}" for p in names)
    schema = to_arrow_schema(StructType.fromDDL(columns))
    spark = files.sparkSession
    dealt = max(int(spark.conf.get("spark.sql.shuffle.partitions")), 3 * spark.sparkContext.defaultParallelism)
    return files.select("path", "language", "text").repartition(dealt, "path").mapInArrow(run, columns)


def boundary_rules(toml: str) -> list[dict]:
    """[[boundary]] tables with from, deny and allow."""
    out = []
    for rule in tomllib.loads(toml).get("boundary", []):
        if not isinstance(rule.get("from"), str) or not rule.get("deny"):
            raise ValueError("a boundary needs from and deny")
        as_list = lambda x: [x] if isinstance(x, str) else list(x or [])
        out.append({"from": rule["from"], "deny": as_list(rule["deny"]), "allow": as_list(rule.get("allow"))})
    return out


def scan_rules(toml: str) -> tuple[list[tuple], list[str]]:
    """(custom rules, disabled ids) from `disable` and [[rule]] tables."""
    spec = tomllib.loads(toml)
    rules = []
    for r in spec.get("rule", []):
        re.compile(r["pattern"])
        rules.append((r["id"], r.get("name", r["id"]), r.get("severity", "medium").lower(), r.get("category", "custom"), r["pattern"], r.get("languages")))
    return rules, list(spec.get("disable", []))


def commit_log(lines: DataFrame) -> DataFrame:
    """(commit_id, seq, parent_count, path) from rows (seq, line) of `commit id parent...` headers each followed by path lines, one log a `seq` order."""
    from pyspark.sql import Window as W

    head = F.col("line").startswith("commit ")
    rows = lines.withColumn("header", F.last(F.when(head, F.col("line")), True).over(W.partitionBy("log").orderBy("seq").rowsBetween(W.unboundedPreceding, 0)))
    parts = F.split("header", " ")
    return rows.where(~head & (F.trim("line") != "")).select(parts[1].alias("commit_id"), "seq", (F.size(parts) - 2).alias("parent_count"), F.trim("line").alias("path")).where(~F.regexp_extract("path", r"([^/]*)$", 1).startswith("."))
