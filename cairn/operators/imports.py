"""Import specifiers to files: candidates as column expressions, then one equality join with the known paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions import scalar as X

#: File names that stand for their directory.
RUST_ROOTS = ["mod.rs", "lib.rs", "main.rs"]
RUST_CRATES = ["src/lib.rs", "src/main.rs", "lib.rs", "main.rs"]
SCRIPT_ENDINGS = ["", ".ts", ".tsx", ".js", ".jsx", "/index.ts", "/index.tsx", "/index.js", "/index.jsx"]
PYTHON_ENDINGS = [".py", "/__init__.py"]


def normal_path(path: Column) -> Column:
    """The path without `.` and `..`; null where it leaves the tree."""
    step = lambda acc, x: F.when(x == "..", F.when(F.size(acc) > 0, F.slice(acc, 1, F.size(acc) - 1))).otherwise(F.concat(acc, F.array(x)))
    parts = F.filter(F.split(path, "/"), lambda x: ~x.isin("", "."))
    return F.array_join(F.aggregate(parts, F.array().cast("array<string>"), step), "/")


def _under(folder: Column, path: Column) -> Column:
    return F.when(folder == "", path).otherwise(F.concat(folder, F.lit("/"), path))


def _ends(base: Column, endings: list[str]) -> list[Column]:
    return [F.concat(base, F.lit(e)) for e in endings]


def _script(base: Column, bare: Column) -> Column:
    """Relative specifiers, as a normal path and without its last suffix; a compiled suffix means its source first."""
    plain, view = base.rlike(r"\.(js|mjs|cjs)$"), base.rlike(r"\.jsx$")
    first = [F.when(plain, c) for c in _ends(bare, [".ts", ".tsx", ".d.ts"])] + [F.when(view, c) for c in _ends(bare, [".tsx", ".ts", ".jsx"])]
    return F.array(*first, *_ends(base, SCRIPT_ENDINGS))


def _rust(spec: Column, path: Column, folder: Column) -> Column:
    parts = F.split(spec, "::")
    head, rest = F.element_at(parts, 1), F.array_join(F.slice(parts, 2, F.size(parts)), "/")
    is_root, bare = X.basename(path).isin(RUST_ROOTS), rest == ""
    above = F.when(~is_root, folder).otherwise(F.when(folder != "", X.dirname(folder)))
    own = F.when(is_root, folder).otherwise(_under(folder, X.stem(path)))
    module = lambda base: _ends(base, [".rs", "/mod.rs"])
    crate = [F.when(bare, F.lit(c)) for c in RUST_CRATES] + [F.when(~bare, c) for c in [*module(F.concat(F.lit("src/"), rest)), *module(rest)]]
    outer = [F.when(bare, _under(above, F.lit(c))) for c in RUST_ROOTS] + [F.when(~bare, c) for c in module(_under(above, rest))]
    inner = [F.when(~bare, c) for c in module(_under(own, rest))]
    return F.when(head == "crate", F.array(*crate)).when(head == "super", F.array(*outer)).when(head == "self", F.array(*inner))


def _python(spec: Column, folder: Column) -> Column:
    """Relative specifiers: one dot is the file's own directory, each further one the next above."""
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    parts = F.filter(F.split(folder, "/"), lambda x: x != "")
    base = F.when((dots > 0) & (F.size(parts) >= dots - 1), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - dots + 1, F.lit(0))), "/"))
    module = F.replace(F.regexp_replace(spec, r"^\.+", ""), F.lit("."), F.lit("/"))
    target = F.when(module == "", base).otherwise(_under(base, module))
    return F.array(*_ends(F.when(target != "", target), PYTHON_ENDINGS))


def _header(spec: Column, folder: Column) -> Column:
    path = F.replace(spec, F.lit("\\"), F.lit("/"))
    return F.array(normal_path(_under(folder, path)), normal_path(path))


def python_roots(files: DataFrame) -> DataFrame:
    """(root): the parents of the packages (directories with an `__init__.py`) that are in no package themselves."""
    packages = files.where(F.col("path").endswith("/__init__.py")).select(X.dirname(F.col("path")).alias("package")).distinct()
    parents = packages.select(X.dirname(F.col("package")).alias("root")).distinct()
    return parents.join(packages.withColumnRenamed("package", "root"), "root", "left_anti")


def _python_modules(files: DataFrame) -> DataFrame:
    """(specifier, to_path, order): what an absolute import finds, through every root above a file; equal names go to the first root, then to the module."""
    parts = F.split("path", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda i: F.array_join(F.slice(parts, F.lit(1), i), "/"))
    rows = files.where(F.col("path").endswith(".py")).select("path", F.explode(above).alias("root")).join(python_roots(files), "root")
    rest = F.when(F.col("root") == "", F.col("path")).otherwise(F.expr("substring(path, length(root) + 2)"))
    package = rest.endswith("/__init__.py")
    name = F.replace(F.regexp_replace(rest, r"(/__init__)?\.py$", ""), F.lit("/"), F.lit("."))
    found = rows.select(name.alias("specifier"), F.struct(F.col("root"), package.cast("int").alias("package"), F.col("path").alias("to_path")).alias("hit"))
    return found.groupBy("specifier").agg(F.min("hit.root").alias("root"), F.min("hit").alias("hit")).select("specifier", "hit.to_path")


def _only_endings(files: DataFrame, wanted: DataFrame) -> DataFrame:
    """(specifier, to_path): wanted specifiers that end the path of exactly one C or C++ file, folded before they meet an import."""
    parts = F.split("path", "/")
    ends = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))
    rows = files.where(F.col("path").rlike(X.C_FILE)).select("path", F.explode(ends).alias("ending"))
    return rows.join(wanted.withColumnRenamed("key", "ending"), "ending", "left_semi").groupBy("ending").agg(F.count("*").alias("n"), F.min("path").alias("to_path")).where("n = 1").drop("n")


def resolve_imports(imports: DataFrame, files: DataFrame, go_module: str | None = None) -> DataFrame:
    """Distinct (path, specifier, to_path) of imports (path, language, specifier) that name a known file (path).

    Python (relative, and absolute through import roots), Rust (`crate`, `super`, `self`), JavaScript and TypeScript (relative), C and C++ (own directory, top,
    then the only path of that ending) name one file each, the first candidate that exists; Go names all files of a directory of `go_module`. Other
    languages, null specifiers and paths outside the tree name none. Every step is an equality join of paths; the files are never listed in one place.
    """
    known = files.select("path").distinct()
    rows = imports.where("specifier is not null").select("path", "language", "specifier").distinct()
    folder, spec, path, language = X.dirname(F.col("path")), F.col("specifier"), F.col("path"), F.col("language")
    c_like, script = language.isin("c", "cpp"), language.isin("javascript", "typescript")
    # Columns of their own: each of a script's candidates would work the path out again.
    based = rows.withColumn("base", F.when(script & spec.startswith("."), normal_path(_under(folder, spec)))).withColumn("bare", F.regexp_replace("base", r"\.[^./]+$", ""))
    options = (
        F.when(script, _script(F.col("base"), F.col("bare"))).when(language == "rust", _rust(spec, path, folder))
        .when(language == "python", _python(spec, folder)).when(c_like, _header(spec, folder))
    )
    target = known.withColumnRenamed("path", "to_path")
    tried = based.select("path", "specifier", F.posexplode(options).alias("n", "to_path")).where("to_path is not null").join(target, "to_path")
    found = tried.groupBy("path", "specifier").agg(F.min_by("to_path", "n").alias("to_path"))
    absolute = rows.where((language == "python") & ~spec.startswith(".")).select("path", "specifier").join(_python_modules(known), "specifier")
    left = rows.where(c_like).withColumn("key", F.replace(spec, F.lit("\\"), F.lit("/"))).join(found.select("path", "specifier"), ["path", "specifier"], "left_anti")
    ending = _only_endings(known, left.select("key").distinct())
    suffix = left.join(ending.withColumnRenamed("ending", "key"), "key")
    out = found.unionByName(absolute.select(found.columns)).unionByName(suffix.select(found.columns))
    if go_module is not None:
        below = F.regexp_replace(F.expr(f"substring(specifier, {len(go_module) + 1})"), "^/+", "")
        wanted = rows.where((language == "go") & spec.startswith(go_module)).select("path", "specifier", below.alias("folder")).where("folder <> ''")
        packages = known.where(F.col("path").endswith(".go")).select(F.col("path").alias("to_path"), X.dirname(F.col("path")).alias("folder"))
        out = out.unionByName(wanted.join(packages, "folder").select(found.columns))
    return out.distinct()
