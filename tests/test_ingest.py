"""Source trees to tables, import resolution, stemming and name search."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from cairn.functions import scalar as X
from cairn.functions.stemming import stem
from cairn.operators import graph, history, names, rules
from cairn.operators.imports import normal_path, resolve_imports
from cairn.sources import files as sources, sinks
from cairn.sources.ingest import ingest

PATHS = [
    "src/pkg/__init__.py", "src/pkg/a.py", "src/pkg/sub/__init__.py", "src/pkg/sub/b.py", "tools/x.py", "lib.rs", "src/lib.rs", "src/graph/mod.rs", "src/graph/walk.rs", "src/util.rs", "web/app.ts",
    "web/view/index.tsx", "web/old.js", "inc/deep/only.h", "inc/util.h", "alt/util.h", "core/main.c", "core/near.h", "svc/db/one.go", "svc/db/two.go", "svc/main.go",
]
#: path, language, specifier, what it names.
CASES = [
    ("src/pkg/a.py", "python", "pkg.sub.b", ["src/pkg/sub/b.py"]), ("tools/x.py", "python", "pkg", ["src/pkg/__init__.py"]), ("tools/x.py", "python", "os.path", []),
    ("src/pkg/sub/b.py", "python", "..a", ["src/pkg/a.py"]), ("src/pkg/sub/b.py", "python", ".", ["src/pkg/sub/__init__.py"]), ("tools/x.py", "python", ".....a", []),
    ("src/util.rs", "rust", "crate", ["src/lib.rs"]), ("src/util.rs", "rust", "crate::graph", ["src/graph/mod.rs"]), ("src/graph/mod.rs", "rust", "super::util", ["src/util.rs"]),
    ("src/graph/mod.rs", "rust", "self::walk", ["src/graph/walk.rs"]), ("src/graph/walk.rs", "rust", "super", ["src/graph/mod.rs"]), ("src/util.rs", "rust", "serde::de", []),
    ("web/view/index.tsx", "typescript", "../app.js", ["web/app.ts"]), ("web/app.ts", "typescript", "./view", ["web/view/index.tsx"]), ("web/app.ts", "javascript", "./old", ["web/old.js"]),
    ("web/app.ts", "typescript", "react", []), ("web/app.ts", "typescript", "../../app", []), ("core/main.c", "c", "near.h", ["core/near.h"]), ("core/main.c", "c", "inc/util.h", ["inc/util.h"]),
    ("core/main.c", "c", "deep/only.h", ["inc/deep/only.h"]), ("core/main.c", "c", "util.h", []), ("svc/main.go", "go", "ex.org/m/svc/db", ["svc/db/one.go", "svc/db/two.go"]), ("svc/main.go", "go", "fmt", []),
    ("svc/main.go", "java", "a.b", []), ("tools/x.py", "python", None, []),
]


def test_import_resolvers(spark):
    files = spark.createDataFrame([(p,) for p in PATHS], "path string")
    imports = spark.createDataFrame([c[:3] for c in CASES] * 2, "path string, language string, specifier string")
    got = {tuple(r) for r in resolve_imports(imports, files, "ex.org/m").select("path", "specifier", "to_path").collect()}
    assert got == {(p, s, to) for p, _, s, targets in CASES for to in targets}
    assert resolve_imports(imports.limit(0), files).count() == 0 and resolve_imports(imports, files.limit(0), "ex.org/m").count() == 0


def test_normal_path(spark):
    rows = spark.createDataFrame([("a/./b/../c",), ("../x",), ("a/..",), ("a//b",)], "p string").select(normal_path(F.col("p"))).collect()
    assert [r[0] for r in rows] == ["a/c", None, "", "a/b"]


def test_tree_to_tables(spark, tmp_path):
    tree = {
        "app/__init__.py": "", "app/base.py": "def load(x):\n    return x\n\n\nclass Store:\n    def get(self, k):\n        return load(k)\n",
        "app/main.py": "from app.base import load\n\n\ndef main():\n    if load(1):\n        return other()\n\n\ndef other():\n    return unknown(2)\n", "notes.md": "# load(x)\n",
    }
    for name, text in tree.items():
        (tmp_path / name).parent.mkdir(exist_ok=True)
        (tmp_path / name).write_text(text)
    walked = sources.walk(spark, str(tmp_path)).withColumn("path", F.regexp_replace("path", re.escape(str(tmp_path)) + "/", ""))
    tables = ingest(sources.parse(walked))
    path = {r.id: r.path for r in tables["files"].collect()}
    assert [path[k] for k in sorted(path)] == sorted(tree) and sorted(path) == [1, 2, 3, 4]
    name = {r.id: r.name for r in tables["symbols"].collect()}
    assert sorted(name) == list(range(1, 6)) and sorted(name.values()) == ["Store", "get", "load", "main", "other"]
    assert [(path[r.from_file], path[r.to_file]) for r in tables["edges"].collect()] == [("app/main.py", "app/base.py")]
    assert {(name[r.from_symbol_id], name[r.to_symbol_id]) for r in tables["refs"].collect()} == {("get", "load"), ("main", "load"), ("main", "other")}
    assert all(df.count() == 0 for df in ingest(sources.parse(walked.limit(0))).values())


def test_sequential_ids(spark):
    values = random.Random(3).sample(range(10000), 2000)
    rows = spark.createDataFrame([(v,) for v in values], "v int").repartition(7)
    got = {r.v: r.id for r in sinks.sequential(rows, ["v"], "id", 5).collect()}
    assert got == {v: k for k, v in enumerate(sorted(values), 5)}


#: Pairs of the published description of the algorithm.
STEMS = {
    "caresses": "caress", "ponies": "poni", "cats": "cat", "feed": "feed", "agreed": "agre", "plastered": "plaster", "motoring": "motor", "sing": "sing", "conflated": "conflat", "troubled": "troubl",
    "hopping": "hop", "falling": "fall", "filing": "file", "happy": "happi", "sky": "sky", "relational": "relat", "conditional": "condit", "digitizer": "digit", "vietnamization": "vietnam", "sensibiliti": "sensibl",
    "triplicate": "triplic", "hopeful": "hope", "goodness": "good", "revival": "reviv", "adjustment": "adjust", "adoption": "adopt", "effective": "effect", "probate": "probat", "rate": "rate", "cease": "ceas",
    "controll": "control", "roll": "roll", "is": "is", "x9": "x9",
}


def test_stems():
    assert {w: stem(w) for w in STEMS} == STEMS
    rng, ends = random.Random(1), ["", "s", "ed", "ing", "ational", "bility", "ization", "ously", "iveness", "ies", "y", "ator", "ably", "fulness", "ement"]
    for _ in range(20000):
        word = "".join(rng.choice("abcdeilnorsty") for _ in range(rng.randint(1, 6))) + rng.choice(ends)
        found = stem(word)
        assert word.startswith(found[: max(1, len(found) - 2)]), word


def brute(rows, query):
    phrase, prefix, columns = names.parse_query(query)
    split = {r[0]: {c: [w for w in re.split(r"[\W_]+", r[k].lower()) if w] for k, c in enumerate(names.COLUMNS, 1)} for r in rows}
    size = {i: sum(map(len, f.values())) for i, f in split.items()}
    tf = {}
    for i, fields in split.items():
        for c in columns:
            words = [stem(w) for w in fields[c]]
            for at in range(len(words) - len(phrase) + 1):
                part = words[at : at + len(phrase)]
                if part == phrase or prefix and part[:-1] == phrase[:-1] and part[-1].startswith(phrase[-1]):
                    tf[i] = tf.get(i, 0) + 1
    n, mean, idf = len(rows), sum(size.values()) / len(rows), 0.0
    if tf:
        idf = math.log((n - len(tf) + 0.5) / (len(tf) + 0.5))
    weight = idf if idf > 0 else 1e-6
    return {i: weight * f * 2.2 / (f + 1.2 * (0.25 + 0.75 * size[i] / mean)) for i, f in tf.items()}


@pytest.mark.parametrize("query", ["parser", "Pars*", "parse_files", '"struct"', "src/parsing", "kind:methods", "name:src", "run again", "???"])
def test_name_search(spark, query):
    parts, rng = ["parse", "parser", "parsing", "file", "files", "run", "again", "src", "walk"], random.Random(4)
    rows = [(i, "_".join(rng.choices(parts, k=rng.randint(1, 4))), rng.choice(["struct", "method", "function"]), "src/" + "/".join(rng.choices(parts, k=3)) + ".rs") for i in range(120)]
    df = spark.createDataFrame(rows, "id long, name string, kind string, path string")
    got = {r.id: r.score for r in names.name_search(df, query, 0).collect()}
    assert got == pytest.approx(brute(rows, query) if query != "???" else {})


def test_framework_paths(spark):
    yes = ["scripts/a.sh", "plugins/b/c.py", "x/plugin.ts", "x/my-plugin.js", "x/my-extension.py", "r/+page.svelte", "r/+page.server.ts", "+layout.client.js", "r/+error.svelte", "hooks.server.ts", "a/vite.config.ts"]
    no = ["src/scripts/a.sh", "x/plugin.a.ts", "x/plugin", "r/+page", "r/page.ts", "hooks.ts", "r/+server.client.ts", "vite.config", "x/-plugin.ts"]
    rows = spark.createDataFrame([(p,) for p in yes + no], "path string").where(X.is_framework_entry(F.col("path"))).collect()
    assert {r.path for r in rows} == set(yes)


def test_unreachable_symbols(spark):
    files = spark.createDataFrame([(1, "src/a.rs"), (2, "tests/t.rs"), (3, "src/b_test.go"), (4, "src/a.spec.ts"), (5, "plugins/p.py")], "id long, path string")
    symbols = [
        (10, 1, "main", "function", False), (11, 1, "used", "function", False), (12, 1, "dead", "function", False), (13, 1, "chain", "method", False), (14, 1, "Shape", "struct", False), (15, 1, "api", "function", True),
        (16, 1, "test_it", "function", False), (17, 1, "TestConfig", "struct", False), (18, 1, "Test", "function", False), (20, 2, "t", "function", False), (30, 3, "g", "function", False), (40, 4, "s", "function", False), (50, 5, "p", "function", False),
    ]
    symbols = spark.createDataFrame(symbols, "id long, file_id long, name string, kind string, is_exported boolean")
    refs = spark.createDataFrame([(10, 11), (12, 13), (13, 12), (11, 11)], "from_symbol_id long, to_symbol_id long")
    assert sorted(r.id for r in graph.unreachable_symbols(symbols, files, refs).collect()) == [12, 13, 18]


def test_ranges(spark):
    parents = spark.createDataFrame([("c", "b"), ("b", "a"), ("x", "a")], "commit string, parent string")
    assert history.parse_range("a") == ("a", "HEAD") and history.parse_range("a..b") == ("a", "b") and history.parse_range("a..") == ("a", "HEAD")
    history.check_range(parents, "a", "c")
    history.check_range(parents, "x", "c")
    history.check_range(parents, "c", "c")
    with pytest.raises(ValueError, match=r"a\.\.c"):
        history.check_range(parents, "c", "a")
    lines = [("a", "100644 blob 11\tk"), ("a", "100644 blob 12\tgone"), ("c", "100644 blob 13\tk"), ("c", "100644 blob 14\tnew dir/f"), ("a", "100644 blob 15\tsame"), ("c", "100644 blob 15\tsame"), ("c", "160000 commit 16\tsub")]
    trees = sources.tree_listing(spark.createDataFrame(lines, "rev string, line string"))
    assert [tuple(r) for r in history.changed_in_range(trees, "a", "c").collect()] == [("gone",), ("k",), ("new dir/f",)]


def test_annotated_findings(spark):
    symbols = spark.createDataFrame([(1, "run_sql", None), (2, "middle", "fn middle()"), (3, "handleRequest", None), (4, "plain", "fn plain(q: HttpRequest)"), (5, "island", "fn island()")], "id long, name string, signature string")
    refs = spark.createDataFrame([(2, 1), (3, 2), (5, 5)], "from_symbol_id long, to_symbol_id long")
    findings = spark.createDataFrame([(1, "SEC003", "injection"), (1, "SEC006", "crypto"), (4, "X", "Deserialization"), (5, "SEC010", "injection")], "id long, rule string, category string")
    got = {(r.id, r.rule): (r.source, r.source_name, r.distance) for r in rules.annotated(findings, symbols, refs).collect()}
    assert got == {(1, "SEC003"): (3, "handleRequest", 2), (1, "SEC006"): (None, None, None), (4, "X"): (4, "plain", 0), (5, "SEC010"): (None, None, None)}


def test_mean_pool(spark):
    rows = [([[1.0, 2.0], [3.0, 4.0], [9.0, 9.0]], [1, 1, 0]), ([[1.0, 2.0]], [0]), ([[0.0, 0.0]], [1])]
    df = spark.createDataFrame(rows, "tokens array<array<double>>, mask array<int>")
    got = [r[0] for r in df.select(X.mean_pool(F.col("tokens"), F.col("mask"))).collect()]
    assert got == [[2.0, 3.0], [0.0, 0.0], [0.0, 0.0]]


def test_walk_reads_hidden_empty_and_not_ignored_files(spark, tmp_path):
    tree = {
        "a/__init__.py": b"", "a/_b.py": b"x = 1\n", ".hidden/c.rs": b"fn c() {}\n", ".git/d.py": b"no", ".git/info/exclude": b"out.py\n", "out.py": b"no", "bad.py": b"\xff\xfe", "long.py": b"#" * 2000,
        ".gitignore": b"# no\nbuild/\n*.js\n!keep.js\n/top.py\na/**/deep.py\n", "build/x.py": b"no", "build/keep.js": b"no", "v/a.js": b"no", "v/keep.js": b"1", "top.py": b"no", "v/top.py": b"1", "a/q/r/deep.py": b"no",
        "v/.gitignore": b"!a.js\nz[0-9].py\n", "v/z1.py": b"no", "v/za.py": b"1", "Makefile": b"all:\n", "image.png": b"1",
    }
    tree["v/a.js"] = b"back"
    for name, content in tree.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    rows = {r.path.removeprefix(str(tmp_path) + "/"): r for r in sources.walk(spark, str(tmp_path), max_bytes=1000).collect()}
    assert sorted(rows) == sorted(["a/__init__.py", "a/_b.py", ".hidden/c.rs", "v/a.js", "v/keep.js", "v/top.py", "v/za.py", "Makefile"])
    assert rows["a/__init__.py"].text == "" and rows["v/a.js"].text == "back" and rows["Makefile"].language == "makefile" and rows["a/_b.py"].size_bytes == 6
    assert rows["a/_b.py"].mtime_ns == (tmp_path / "a/_b.py").stat().st_mtime_ns


def test_parse_deals_files_out(spark):
    from cairn.sources.ingest import call_rows

    rows = [(f"f{k}.py", "python", f"class A:\n    def m(self):\n        g({k})\n\ng({k})\n") for k in range(600)]
    files = spark.createDataFrame(rows, "path string, language string, text string").coalesce(1)
    parsed = sources.parse(files)
    assert parsed.count() == 600 and parsed.groupBy(F.spark_partition_id()).count().count() >= 4
    assert sources.parse(files, ("relations",)).columns == ["path", "language", "line_count", "relations"]
    calls = call_rows(sources.parse(files, ("symbols", "calls")).withColumn("file_id", F.lit(1)))
    assert sorted((r.owner or "", r["count"]) for r in calls.groupBy("owner").count().collect()) == [("", 600), ("A", 600)]
    assert "Exchange" not in calls._jdf.queryExecution().optimizedPlan().toString() and calls.where("line > 5").count() == 0


def test_script_paths_are_worked_out_once(spark):
    """A script's candidates are many; each would go over the path's parts again."""
    rows = spark.createDataFrame([("src/a/x.ts", "typescript", "../b/./y.js"), ("src/a/x.ts", "typescript", "./z"), ("src/a/x.ts", "typescript", "react")], "path string, language string, specifier string")
    known = spark.createDataFrame([("src/a/x.ts",), ("src/b/y.ts",), ("src/a/z/index.ts",)], "path string")
    found = resolve_imports(rows, known)
    assert sorted((r.specifier, r.to_path) for r in found.collect()) == [("../b/./y.js", "src/b/y.ts"), ("./z", "src/a/z/index.ts")]
    assert found._jdf.queryExecution().optimizedPlan().toString().count("aggregate(") < 12
