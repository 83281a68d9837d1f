"""Rule scans over bodies."""

from __future__ import annotations

import re
from functools import reduce

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from cairn.functions import scalar as X
from cairn.functions.session import settle
from cairn.operators.graph import clean_edges
from cairn.operators.tables import page
from cairn.sources.lexer import tokens

#: Weights of severities.
SEVERITY = {"low": 1, "medium": 2, "high": 4, "critical": 8}
#: Id, name, severity, category, pattern over bodies, languages (None: all).
BUILTIN = [
    ("SEC001", "hardcoded-secret", "critical", "secrets", r'(?i)(password|passwd|secret|api_key|token)\s*=\s*"[^"]{4,}"', None),
    ("SEC002", "hardcoded-private-key", "critical", "secrets", r"-----BEGIN (RSA |EC |DSA )?PRIVATE KEY-----", None),
    ("SEC003", "sql-injection", "high", "injection", r'(?i)(?:format!\(|\.format\(|f")[^\n]*?\b(?:SELECT\s+(?:\*|DISTINCT|TOP|[`"\[]?\w)|INSERT\s+INTO\b|UPDATE\s+\w+\s+SET\b|DELETE\s+FROM\b|DROP\s+(?:TABLE|INDEX|VIEW|DATABASE|SCHEMA)\b)', None),
    ("SEC004", "command-injection", "high", "injection", r"(?i)(Command::new|\bsubprocess[.(]|os\.system|exec\(|eval\()", None),
    ("SEC005", "path-traversal", "medium", "injection", r"\.\./", None),
    ("SEC006", "insecure-hash", "medium", "crypto", r"(?i)\b(md5|sha1)\b", None),
    ("SEC007", "insecure-http", "low", "crypto", r"http://[a-zA-Z][a-zA-Z0-9.\-]+", None),
    ("SEC008", "unsafe-block", "medium", "unsafe", r"\bunsafe\b", ["rust"]),
    ("SEC009", "unwrap-in-exported", "low", "unsafe", r"\.unwrap\(\)", ["rust"]),
    ("SEC010", "eval-usage", "high", "injection", r"\beval\(", ["javascript", "typescript", "python"]),
    ("SEC011", "innerHTML-xss", "high", "injection", r"(?i)(innerHTML|dangerouslySetInnerHTML)", ["javascript", "typescript"]),
    ("SEC012", "debug-leak", "low", "info-leak", r"(dbg!\(|console\.log\(|print!\()", None),
    ("SEC013", "todo-security", "medium", "review", r"(?i)(TODO|FIXME|HACK|XXX).*(security|auth|vuln|inject)", None),
]
#: Fixed values (names of environment readers, shells, hosts): built-in patterns that pass over benign matches by looking around: values read from the environment, fixed commands that are no shells, local and
#: schema addresses.
NARROWED = {
    "SEC001": r'(?i)(password|passwd|secret|api_key|token)\s*=\s*"(?!\s*\$)(?![^"]*(process\.env|os\.environ|System\.getenv|env::var|ENV\[|getenv\())[^"]{4,}"',
    "SEC004": r'(?i)(Command::new(?!\s*\(\s*"(?!([^"]*[/\\])?(sh|bash|zsh|fish|dash|ksh|cmd(\.exe)?|powershell(\.exe)?|pwsh(\.exe)?)")[^"{]*"\s*\))|\bsubprocess[.(]|os\.system|exec\(|eval\()',
    "SEC007": r"http://(?<!xmlns[=:][^\n]{0,25}http://)(?!localhost|127\.|0\.0\.0\.0|www\.w3\.org)(?=[a-zA-Z][a-zA-Z0-9\-]*\.)[a-zA-Z][a-zA-Z0-9.\-]+",
}
#: What each match of a built-in pattern holds, all of it or one of it: a text without goes through no pattern. Literals are found many times faster than patterns that begin with several words.
HOLDS = {"SEC001": (all, ["=", '"']), "SEC002": (all, ["PRIVATE KEY"]), "SEC003": (any, ["(", '"']), "SEC005": (all, ["../"]), "SEC007": (all, ["http://"]), "SEC012": (any, ["!(", "console.log("])}
#: Macros that take a path in when the program is built, and methods that only look at the shape of one.
EMBEDS = ["include_str", "include_bytes", "concat"]
SHAPE_CHECKS = ["starts_with", "ends_with", "contains", "split", "split_terminator"]
#: Attributes of test functions, up to this many lines above them; what a line says that expects an error, up to so many lines around a finding.
TEST_ATTRIBUTE = r"^\s*#!?\[(?:[^\]]*,\s*)?(?:\w+::)*(?:test|rstest|proptest|test_case)\s*[\](,]|^\s*#!?\[cfg(?:_attr)?\(.*\btest\b"
ERROR_EXPECTED = r"^(?!\s*(?://|/\*|\*)).*(?:\.is_err\(\)|\.unwrap_err\(\)|\.expect_err\(|assert_err!\()|^(?!\s*(?://|/\*|\*))(?=.*assert_matches!)(?=.*Err\()|^(?!\s*(?://|/\*|\*))(?=.*assert!\()(?=.*matches!)(?=.*Err\()"
ATTRIBUTE_LINES, EXPECTED_LINES = 5, 10
#: Rules that report exported symbols only.
EXPORTED_ONLY = ["SEC009", "SEC012"]


def active_rules(custom: list[tuple] = (), disable: list[str] = ()) -> list[tuple]:
    """Built-in and custom rules without the disabled ones; a custom rule replaces one of its id."""
    own = {r[0] for r in custom}
    return [r for r in [*[r for r in BUILTIN if r[0] not in own], *custom] if r[0] not in set(disable)]


def unsafe_at(text: str, language: str | None) -> int:
    """Where the word `unsafe` first stands in code, from 1; 0 if only strings and comments hold it."""
    return next((t.at + 1 for t in tokens(text, language) if t.kind == "name" and t.text == "unsafe"), 0)


def traversal_at(text: str, language: str | None) -> int:
    """Where `../` first stands, from 1, unless in a string that a built-in embed or a check of a path's shape takes; 0 if nowhere."""
    calls, last, benign = [], ("", ""), []
    for t in tokens(text, language):
        if t.kind == "open":
            calls.append(last[0] == "!" and last[1] in EMBEDS or last[1] == "." and last[0] in SHAPE_CHECKS)
        elif t.kind == "close" and calls:
            calls.pop()
        elif t.kind == "string" and calls and calls[-1]:
            benign.append((t.at, t.at + len(t.text)))
        if t.kind != "comment":
            last = (t.text, last[0])
    found = (m.start() for m in re.finditer(r"\.\./", text))
    return next((at + 1 for at in found if not any(a <= at < z for a, z in benign)), 0)


#: Built-in rules whose first match is looked for among tokens, where the pattern matches at all.
CONTEXTS = {"SEC005": traversal_at, "SEC008": unsafe_at}


def _in_context(rule: str, text: Column, language: Column) -> Column:
    find = CONTEXTS[rule]

    @F.pandas_udf("int")
    def run(texts: pd.Series, languages: pd.Series) -> pd.Series:
        return pd.Series([find(t, lang) if t is not None else 0 for t, lang in zip(texts, languages, strict=True)], dtype="int32")

    return run(text, language)


def _expects_error(line: Column) -> Column:
    """Whether the body (text) of a test function (after the lines `above`) expects an error near the line; Rust only."""
    near = F.slice(F.split("text", "\n"), F.greatest(F.lit(1), line - EXPECTED_LINES), F.least(line, F.lit(EXPECTED_LINES + 1)) + EXPECTED_LINES)
    before = F.split(F.rtrim(F.col("above")), "\n")
    before = F.slice(before, F.greatest(F.lit(1), F.size(before) - ATTRIBUTE_LINES + 1), F.lit(ATTRIBUTE_LINES))
    marked = F.exists(before, lambda x: x.rlike(TEST_ATTRIBUTE))
    return (F.col("language") == "rust") & F.coalesce(marked, F.lit(False)) & F.exists(near, lambda x: x.rlike(ERROR_EXPECTED))


def _holds(text: str, how, literals: list[str]) -> Column:
    held = [F.contains(F.col(text), F.lit(x)) for x in literals]
    return reduce(Column.__and__ if how is all else Column.__or__, held)


def _found(facts: list):
    return lambda at: F.when(at > 0, F.struct(*facts, (at - 1).alias("at")))


def scan(bodies: DataFrame, rules: list[tuple], min_severity: str = "low", narrowed: bool = True) -> DataFrame:
    """(id, rule, severity, category, line, snippet, risk) of the first match of each rule in each body; with `narrowed`, of the first that is not benign.

    bodies: id, language, pagerank, is_exported, text. Rules are configuration, so each is an expression and the table is read once. With a column `above`, the
    lines before the body, `narrowed` also leaves out what stands beside an expected error in a test function.
    """
    hits = []
    builtin = {r[0]: r[4] for r in BUILTIN}
    for rule, _, severity, category, pattern, languages in rules:
        if SEVERITY[severity] < SEVERITY[min_severity]:
            continue
        fits = F.lit(True)
        if builtin.get(rule) == pattern and rule in HOLDS:
            fits = _holds("text", *HOLDS[rule])
        if narrowed and pattern in {r[4] for r in BUILTIN}:
            pattern = NARROWED.get(rule, pattern)
        if languages:
            fits = fits & F.col("language").isin(languages)
        if rule in EXPORTED_ONLY:
            fits = fits & F.col("is_exported")
        at = F.when(fits, F.regexp_instr("text", F.lit(f"(?-s:{pattern})")))
        if narrowed and rule in CONTEXTS and builtin.get(rule) == pattern:
            # Only bodies with a match travel to Python.
            bodies = bodies.withColumn(f"_{rule}", _in_context(rule, F.when(at > 0, F.col("text")), F.col("language")))
            at = F.col(f"_{rule}")
        facts = [F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(category).alias("category"), F.lit(SEVERITY[severity]).alias("weight")]
        hits.append(F.get(F.transform(F.array(at), _found(facts)), F.lit(0)))
    rows = bodies.withColumn("hit", F.explode(F.filter(F.array(*hits), lambda h: h.isNotNull())))
    head = F.expr("substring(text, 1, hit.at)")
    line = F.length(head) - F.length(F.replace(head, F.lit("\n"), F.lit(""))) + 1
    snippet = F.substring(F.trim(F.element_at(F.split("text", "\n"), line)), 1, 120)
    if narrowed and "above" in bodies.columns:
        rows = rows.where(~_expects_error(line))
    risk = F.col("hit.weight") * F.col("pagerank") * (1 + F.col("is_exported").cast("int"))
    return rows.select("id", "hit.rule", "hit.severity", "hit.category", line.alias("line"), snippet.alias("snippet"), risk.alias("risk"))


def scan_kinds(symbols: DataFrame, rules: list[tuple], category: str | None = None, path: str | None = None, include_tests: bool = False, min_severity: str = "low", narrowed: bool = True, limit: int = 0) -> DataFrame:
    """(id, rule, severity, category, line, snippet, risk), greatest risk first: rules over bodies, names and signatures.

    symbols: id, path, language, pagerank, is_exported, text, name, signature, line_start. A rule is (id, name, severity, category, pattern, languages) over
    bodies, or has a seventh value, `name` or `signature`; those find the symbol's own first line. Filters: category, part of the path, tests or not.
    """
    rows = symbols if include_tests else symbols.where(~X.is_test_path(F.col("path")))
    if path is not None:
        rows = rows.where(F.col("path").contains(path))
    chosen = [r for r in rules if category in (None, r[3]) and SEVERITY[r[2]] >= SEVERITY[min_severity]]
    found = scan(rows, [r[:6] for r in chosen if len(r) < 7 or r[6] == "body"], min_severity, narrowed) if any(len(r) < 7 or r[6] == "body" for r in chosen) else None
    others = []
    for rule, _, severity, kind, pattern, languages, where in [r for r in chosen if len(r) > 6 and r[6] != "body"]:
        fits = F.col(where).rlike(pattern)
        if languages:
            fits = fits & F.col("language").isin(languages)
        others.append(F.when(fits, F.struct(F.lit(rule).alias("rule"), F.lit(severity).alias("severity"), F.lit(kind).alias("category"), F.lit(SEVERITY[severity]).alias("weight"))))
    if others:
        own = rows.withColumn("hit", F.explode(F.filter(F.array(*others), lambda h: h.isNotNull())))
        risk = F.col("hit.weight") * F.col("pagerank") * (1 + F.col("is_exported").cast("int"))
        own = own.select("id", "hit.rule", "hit.severity", "hit.category", F.col("line_start").alias("line"), F.substring(F.trim(F.coalesce("signature", "name")), 1, 120).alias("snippet"), risk.alias("risk"))
        found = own if found is None else found.unionByName(own)
    if found is None:
        raise ValueError("no rule passes the filters")
    return page(found, [F.desc("risk"), "id", "rule"], limit)


def taint(edges: DataFrame, findings: DataFrame, inputs: DataFrame, max_depth: int = 20) -> DataFrame:
    """(id, source, distance, path): the nearest input (id) from which calls (src, dst) lead to a finding (id), and the nodes from it to the finding, both ends included.

    Ties go to the least input, and each node of the path is followed by the least that is one step nearer. All findings walk backwards together, a level at a time, and
    keep each level's (finding, node, next node); a finding whose level holds an input walks no further. The paths are rebuilt by one join a level. Findings that no
    input reaches within `max_depth` calls give no row; loops, repeated calls and repeated findings do not count.
    """
    edges, inputs = settle(clean_edges(edges)), settle(inputs.select(F.col("id").alias("node")).distinct())
    level = settle(findings.where("id is not null").select(F.col("id").alias("seed"), F.col("id").alias("node")).distinct().withColumn("next", F.expr("cast(null as long)")))
    levels, hits, seen = [level], [], level.select("seed", "node")
    for depth in range(max_depth + 1):
        hit = settle(level.join(inputs, "node", "left_semi").groupBy("seed").agg(F.min("node").alias("source")).withColumn("distance", F.lit(depth)))
        hits.append(hit)
        if depth == max_depth:
            break
        found = level.join(hit, "seed", "left_anti").join(edges, F.col("node") == F.col("dst")).groupBy("seed", "src").agg(F.min("node").alias("next"))
        level = settle(found.select("seed", F.col("src").alias("node"), "next").join(seen, ["seed", "node"], "left_anti"))
        if level.isEmpty():
            break
        levels.append(level)
        seen = settle(seen.unionByName(level.select("seed", "node"))) if len(levels) % 4 == 0 else seen.unionByName(level.select("seed", "node"))
    walk = reduce(DataFrame.unionByName, hits).withColumn("at", F.col("source")).withColumn("path", F.array("source"))
    for level in reversed(levels[1:]):
        # A node stands in one level of a finding only, so the rows of nearer inputs wait for theirs.
        walk = walk.join(level.withColumnRenamed("node", "at"), ["seed", "at"], "left")
        path = F.when(F.col("next").isNull(), F.col("path")).otherwise(F.concat("path", F.array("next")))
        walk = walk.select("seed", "source", "distance", F.coalesce("next", "at").alias("at"), path.alias("path"))
    return walk.select(F.col("seed").alias("id"), "source", "distance", "path")


#: Rules whose findings are sinks; findings of the category deserialization are, too.
SINKS = ["SEC003", "SEC004", "SEC010"]


def annotated(findings: DataFrame, symbols: DataFrame, refs: DataFrame, max_depth: int = 20) -> DataFrame:
    """All findings (id, rule, category) with source, source_name, distance and path: the nearest symbol that takes user input and from which references lead to a
    sink's symbol, itself included, and the names from it to the sink (#id for a symbol that is not there); null for findings that are no sinks or that no input
    reaches. Ties go to the least id."""
    is_sink = F.coalesce(F.col("rule").isin(SINKS) | (F.lower("category") == "deserialization"), F.lit(False))
    inputs = symbols.where(F.coalesce(X.is_input_source(F.col("name"), F.col("signature")), F.lit(False))).select("id")
    calls = refs.select(F.col("from_symbol_id").alias("src"), F.col("to_symbol_id").alias("dst"))
    near = settle(taint(calls, findings.where(is_sink).select("id"), inputs, max_depth))
    steps = near.select("id", F.posexplode("path").alias("n", "at")).join(symbols.select(F.col("id").alias("at"), "name"), "at", "left")
    # A path has at most max_depth + 1 steps, so no group of it grows with the data.
    named = steps.groupBy("id").agg(F.sort_array(F.collect_list(F.struct("n", F.coalesce("name", F.concat(F.lit("#"), "at")).alias("name")))).alias("steps"))
    named = named.select("id", F.col("steps.name").alias("path")).withColumn("source_name", F.get("path", F.lit(0)))
    near = near.select("id", "source", "distance").join(named, "id").withColumn("sink", F.lit(True))
    return findings.withColumn("sink", is_sink).join(near, ["id", "sink"], "left").drop("sink")
