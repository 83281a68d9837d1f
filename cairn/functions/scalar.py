"""Scalar functions over code-graph columns; all stay in the JVM but those marked as Arrow functions."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, functions as F

#: Aliases of symbol kinds; other kinds stand for themselves.
KIND_ALIASES = {
    "fn": ["function", "method"], "function": ["function", "method"], "func": ["function", "method"], "method": ["method"], "class": ["class", "struct"], "struct": ["struct", "class"],
    "trait": ["trait", "interface"], "interface": ["trait", "interface"], "var": ["variable", "const", "let"], "variable": ["variable", "const", "let"], "const": ["const", "constant"], "constant": ["const", "constant"],
}
#: Languages whose symbols have no export semantics.
NO_EXPORT_LANGUAGES = ["yaml", "toml", "hcl", "json", "ini", "makefile", "dockerfile", "helm", "css", "nginx", "caddyfile", "bash", "systemd"]
#: Languages whose files can have unit tests.
TESTABLE_LANGUAGES = ["rust", "typescript", "python", "go", "java", "kotlin", "swift", "csharp", "ruby", "php", "cpp", "c", "scala", "dart", "elixir", "lua", "zig", "haskell", "ocaml", "r"]
#: Directories and file names of tests.
TEST_DIRECTORIES = ["tests", "test", "benches", "__tests__", "spec"]
TEST_FILES = ["test.rs", "tests.rs"]
TEST_SUFFIXES = [
    "_test.rs", "_tests.rs", "_test.go", "_test.dart", ".test.ts", ".spec.ts", ".test.tsx", ".spec.tsx", ".test.js", ".spec.js", ".test.jsx", ".spec.jsx",
    "_test.py", "Test.java", "Tests.java", "Test.kt", "Tests.kt", "_spec.rb", "Test.cs", "Tests.cs",
]
#: Endings of types that hold services, not data.
SERVICE_SUFFIXES = ["Server", "Handler", "Controller", "Route", "Router", "Service", "Endpoint", "Dispatcher"]


def is_test_path(path: Column) -> Column:
    """Whether a path belongs to tests by its directories, its name or its suffix."""
    base = basename(path)
    suffix = "(" + "|".join(map(re.escape, TEST_SUFFIXES)) + ")$"
    return path.rlike("(^|/)(" + "|".join(TEST_DIRECTORIES) + ")/") | base.isin(TEST_FILES) | base.rlike(suffix) | (base.startswith("test_") & base.endswith(".py"))


#: Directories and file names that a framework or a plugin host loads by name.
ENTRY_DIRECTORIES = ["scripts/", "plugins/", "extensions/"]
ENTRY_FILES = [
    r"^plugin\.[^.]+$", r"^extension\.[^.]+$", r"^.+-plugin\.[^.]+$", r"^.+-extension\.[^.]+$",
    r"^\+page\.[^.]+$", r"^\+page\.(server|client)\.[^.]+$", r"^\+layout\.[^.]+$", r"^\+layout\.(server|client)\.[^.]+$", r"^\+server\.[^.]+$", r"^\+error\.[^.]+$",
    r"^hooks\.(server|client)\.[^.]+$", r"^svelte\.config\.[^.]+$", r"^vite\.config\.[^.]+$", r"^playwright\.config\.[^.]+$",
]
#: Parts of names and signatures that show user input: whole words of a name, parts of a name, parts of a signature.
INPUT_WORDS = ["request", "req", "params", "param", "argv", "args", "env", "environ", "query", "stdin", "handler", "handle", "route", "router", "webhook", "body", "payload", "form", "input", "cgi"]
INPUT_PARTS = ["request", "params", "argv", "webhook", "query", "payload", "stdin"]
INPUT_SIGNATURES = ["request", "httprequest", "params", "argv", "query", "webhook", "payload"]
#: Suffixes of C and C++ files.
C_FILE = r"(?i)\.(c|h|cc|cpp|cxx|hh|hpp|hxx)$"


def is_framework_entry(path: Column) -> Column:
    return path.rlike("^(" + "|".join(ENTRY_DIRECTORIES) + ")") | basename(path).rlike("|".join(ENTRY_FILES))


def is_test_symbol(name: Column, kind: Column, path: Column) -> Column:
    """Whether a test runner finds the symbol by itself: by its directory, its file's name, or, for callables, its own name."""
    base = basename(path)
    place = path.startswith("tests/") | path.contains("/tests/") | base.contains(".test.") | base.contains(".spec.") | F.substring_index(base, ".", 1).endswith("_test")
    return place | (kind.isin("function", "method") & (name.startswith("test_") | (name.startswith("Test") & (F.length(name) > 4))))


def is_input_source(name: Column, signature: Column) -> Column:
    """Whether a symbol plausibly takes user input, by words of its name or by its signature."""
    low = F.lower(name)
    word = low.rlike("(^|[^a-z0-9])(" + "|".join(INPUT_WORDS) + ")($|[^a-z0-9])")
    return word | low.rlike("|".join(INPUT_PARTS)) | F.coalesce(F.lower(signature).rlike("|".join(INPUT_SIGNATURES)), F.lit(False))


def mean_pool(tokens: Column, mask: Column) -> Column:
    """Mean of the vectors whose mask is not zero; zeros where none is."""
    kept = F.filter(F.arrays_zip(tokens.alias("v"), mask.alias("m")), lambda x: x["m"] != 0)
    zero = F.transform(F.element_at(tokens, 1), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda acc, x: F.zip_with(acc, x["v"], lambda a, b: a + b))
    return F.transform(total, lambda x: F.when(F.size(kept) > 0, x / F.size(kept)).otherwise(0.0))


def in_scope(path: Column, scope: str) -> Column:
    """The path itself or anything below it."""
    scope = scope.rstrip("/")
    return (path == scope) | path.startswith(scope + "/")


def kind_in(kind: Column, alias: str) -> Column:
    return F.lower(kind).isin(KIND_ALIASES.get(alias.lower(), [alias.lower()]))


def name_matches(name: Column, pattern: str) -> Column:
    """A regular expression, blind to case unless the pattern says so itself."""
    return name.rlike(pattern if "(?i)" in pattern or "(?-i)" in pattern else "(?i)" + pattern)


def basename(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def dirname(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def stem(path: Column) -> Column:
    return F.regexp_replace(basename(path), r"\.[^.]*$", "")


def health(complexity: Column, pagerank: Column, churn: Column) -> Column:
    """Mean of three falling terms, each 10 at rest: complexity, importance, churn."""
    return (10 / (1 + complexity / 10) + 10 / (1 + pagerank * 50) + 10 / (1 + churn / 8)) / 3


def tokens(chars: Column) -> Column:
    """About three characters a token."""
    return F.floor(chars / 3)


def shape(text: Column) -> Column:
    """Hash of the text with comments gone and every string, number and name as one placeholder; null if too short to compare.

    Explode it (one element) where a filter or group uses it: an explode keeps the optimizer from working it out once for each use.
    """
    lines = F.length(text) - F.length(F.replace(text, F.lit("\n"), F.lit(""))) + 1
    s = F.regexp_replace(F.when(lines >= 3, text), r"(?s)/\*.*?\*/", "")
    s = F.regexp_replace(s, r"//[^\n]*", "")
    s = F.regexp_replace(s, r'"[^"\n]*"', "_")
    s = F.regexp_replace(s, r"[\p{N}][\p{N}_.]*[a-zA-Z]*|[\p{L}_][\p{L}\p{N}_]*", "_")
    s = F.trim(F.regexp_replace(s, r"[ \t\n\r]+", " "))
    return F.get(F.transform(F.array(s), lambda x: F.when(F.octet_length(x) >= 10, F.md5(x))), F.lit(0))


def cosine(a: Column, b: Column) -> Column:
    """Dot product in double precision, in element order, over the product of norms."""

    def dot(x, y):
        return F.aggregate(F.zip_with(x, y, lambda p, q: p.cast("double") * q.cast("double")), F.lit(0.0), lambda s, v: s + v)

    return dot(a, b) / F.sqrt(dot(a, a) * dot(b, b))


def l2_normalised(v: Column) -> Column:
    """A zero vector stays zero."""
    norm = F.sqrt(F.aggregate(v, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return F.when(norm == 0, F.transform(v, lambda x: x.cast("double"))).otherwise(F.transform(v, lambda x: x.cast("double") / norm))


def has_self_receiver(signature: Column) -> Column:
    return signature.rlike(r"\(\s*(&\s*)?(mut\s+)?(self|this|cls)\b")


def is_service_like(owner: Column) -> Column:
    """By the ending of the name without module path and type parameters."""
    bare = F.trim(F.regexp_extract(F.substring_index(owner, "::", -1), r"^([^<]*)", 1))
    return bare.rlike("(" + "|".join(SERVICE_SUFFIXES) + ")$")


def parameter_count(signature: str | None) -> int:
    """Parameters of the first bracket pair, nested commas apart, without a leading self or cls."""
    if not signature or "(" not in signature:
        return 0
    depth, parts, own = 0, [], ""
    for c in signature[signature.index("(") :]:
        if c in "([{<":
            depth += 1
            own += c if depth > 1 else ""
        elif c in ")]}>":
            depth -= 1
            if depth == 0:
                break
            own += c
        elif c == "," and depth == 1:
            parts.append(own)
            own = ""
        else:
            own += c
    names = [p.strip() for p in [*parts, own] if p.strip()]
    return len(names) - bool(names and re.fullmatch(r"(&\s*)?('\w+\s+)?(mut\s+)?(self|cls)(\s*:.*)?", names[0]))


def parameter_counts(signature: Column) -> Column:
    """parameter_count of a column, as an Arrow function."""

    @F.pandas_udf("int")
    def run(s: pd.Series) -> pd.Series:
        return s.map(parameter_count)

    return run(signature)


def match_arms(body: str | None) -> int:
    """`=>` outside strings and comments."""
    return len(re.findall("=>", re.sub(r'"(\\.|[^"\\])*"|//[^\n]*|/\*.*?\*/', "", body or "", flags=re.S)))


def glob_regex(glob: str) -> str:
    """`**` crosses directories, `*` and `?` do not."""
    out, i = "", 0
    while i < len(glob):
        if glob.startswith("**/", i):
            out, i = out + "(?:.*/)?", i + 3
        elif glob.startswith("**", i):
            out, i = out + ".*", i + 2
        elif glob[i] == "*":
            out, i = out + "[^/]*", i + 1
        elif glob[i] == "?":
            out, i = out + "[^/]", i + 1
        else:
            out, i = out + re.escape(glob[i]), i + 1
    return f"^{out}$"


def fts_query(text: str) -> str:
    """A term as it may stand in a text query: plain words pass (a trailing * too), the rest is quoted."""
    text = text.strip()
    if not text:
        return '""'
    if re.fullmatch(r"\w+\*?", text) and text not in ("AND", "OR", "NOT", "NEAR"):
        return text
    return '"' + text.replace('"', '""') + '"'


def replace_word(text: Column, old: str, new: str) -> Column:
    """Whole words only, by Unicode letters."""
    return F.regexp_replace(text, rf"(?<![\p{{L}}\p{{N}}_]){re.escape(old)}(?![\p{{L}}\p{{N}}_])", new.replace("\\", "\\\\").replace("$", "\\$"))
