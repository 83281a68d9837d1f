"""Analyses over parsed source text. Each part becomes a source file in one of five languages, with traps in strings and comments; documents are lexed as they are."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.operators import directories, graph, rules, scores
from cairn.plans.catalogue import query
from cairn.sources import files as sources, lexer
from cairn.sources.ingest import call_rows, type_relations

#: Source text by language: head, a line or two that is repeated `arms` times, tail. K is the part's number, B the number of its super type.
TEMPLATES = {
    "rust": (
        'use std::fmt;\n// fn fake() { lost(); }\npub struct T@K { n: u32 }\nimpl B@B for T@K {\n    pub fn run(&self) -> u32 {\n        let s = "if fake() { fn no()"; /* lost(/* deep( */ ) */\n        match self.n {\n',
        "            1 => self.help(2),\n",
        "        }\n    }\n}\n",
    ),
    "typescript": (
        "import x from './x';\n/* class Fake extends Lost { } */\nexport class T@K extends B@B {\n  run(a: number) {\n    const s = `if (fake()) { ${this.help(a)} } {`;\n",
        "    if (a > 1 && s) { g(a); } // lost(1)\n",
        "    return /lost(\\(/.test(s);\n  }\n}\n",
    ),
    "python": (
        'import os\nclass T@K(B@B):\n    """def fake(): lost(1)"""\n    def run(self, a):\n        s = \'if lost(\' # and lost(2)\n',
        "        if a and g(a):\n            self.help(a)\n",
        "        return s\n",
    ),
    "go": (
        'package p\n\nimport "fmt"\n\ntype T@K struct {\n\tB@B\n\tn int\n}\n\nfunc (t *T@K) run(a int) int {\n\ts := `if lost( {` // lost()\n',
        '\tif a > 1 || s == "(" { g(a) }\n',
        "\treturn t.help(a)\n}\n",
    ),
    "java": (
        'public class T@K extends Object implements B@B {\n  /** lost( */\n  @Override public int run(int a) {\n    String s = """\n lost( { """;\n',
        "    if (a > 1) { help(a); }\n",
        "    return new G(a).help(a);\n  }\n}\n",
    ),
}


def source_files(t):
    """(id, path, language, text): one file a part."""
    key, arms = F.col("p_partkey"), (F.col("p_size") % 9 + 3).cast("int")
    names = list(TEMPLATES)
    parts = [F.element_at(F.array(*[F.lit(TEMPLATES[n][k]) for n in names]), (key % 5 + 1).cast("int")) for k in range(3)]
    text = F.concat(parts[0], F.repeat(parts[1], arms), parts[2])
    text = F.replace(F.replace(text, F.lit("@K"), key.cast("string")), F.lit("@B"), (key % 7).cast("string"))
    return t.raw("part").select(key.alias("id"), F.concat(F.lit("gen/f"), key).alias("path"), F.element_at(F.array(*map(F.lit, names)), (key % 5 + 1).cast("int")).alias("language"), text.alias("text"))


def parsed_files(t, *parts):
    return sources.parse(source_files(t), parts).withColumn("file_id", F.regexp_extract("path", r"(\d+)$", 1).cast("long"))


#: What the generator says of each file: its number, language by number and repetitions.
GEN = ", g AS (SELECT p_partkey AS k, p_partkey % 5 AS l, (p_size % 9 + 3)::INT AS a FROM part)"


@query(
    GEN + """ SELECT 'gen/f' || k AS path, 'T' || k AS name, ['struct', 'class', 'class', 'struct', 'class'][l + 1] AS kind, NULL AS owner_type, [3, 3, 2, 5, 1][l + 1] AS line_start, [3, 8 + a, 6 + 2 * a, 8, 8 + a][l + 1] AS line_end,
    NULL::INT AS complexity, NULL::INT AS arms, true AS is_exported FROM g UNION ALL
    SELECT 'gen/f' || k, 'run', 'method', 'T' || k, [5, 4, 4, 10, 3][l + 1], [9 + a, 7 + a, 6 + 2 * a, 13 + a, 7 + a][l + 1], [2, 1 + 2 * a, 1 + 2 * a, 1 + 2 * a, 1 + a][l + 1], CASE WHEN l = 0 THEN a ELSE 0 END, l <> 3 FROM g"""
)
def parsed_symbols(t):
    return parsed_files(t, "symbols").select("path", F.explode("symbols").alias("s")).select("path", "s.name", "s.kind", "s.owner_type", "s.line_start", "s.line_end", "s.complexity", "s.arms", "s.is_exported")


@query(
    GEN + """, c AS (SELECT k, unnest([[['help', 'self', a::VARCHAR]], [['help', 'this', '1'], ['g', NULL, a::VARCHAR], ['test', '', '1']], [['g', NULL, a::VARCHAR], ['help', 'self', a::VARCHAR]], [['g', NULL, a::VARCHAR], ['help', 't', '1']],
    [['help', NULL, a::VARCHAR], ['G', NULL, '1'], ['help', '', '1']]][l + 1]) AS c FROM g) SELECT 'gen/f' || k AS path, 'T' || k AS owner, c[1] AS name, c[2] AS receiver, c[3]::BIGINT AS n FROM c"""
)
def parsed_call_sites(t):
    sites = call_rows(parsed_files(t, "symbols", "calls")).groupBy("file_id", "owner", "name", "receiver").agg(F.count("*").alias("n"))
    return sites.select(F.concat(F.lit("gen/f"), "file_id").alias("path"), "owner", "name", "receiver", "n")


RELATIONS = GEN + ", r AS (SELECT k AS file_id, 'T' || k AS sub_name, 'B' || k % 7 AS super_name, ['implements', 'extends', 'extends', 'extends', 'implements'][l + 1] AS kind, [4, 3, 2, 6, 1][l + 1] AS line FROM g UNION ALL SELECT k, 'T' || k, 'Object', 'extends', 1 FROM g WHERE l = 4)"


@query(RELATIONS + " SELECT * FROM r")
def parsed_relations(t):
    return type_relations(parsed_files(t, "relations"))


@query(RELATIONS + ", p AS (SELECT 'T' || p_partkey AS sub_name, 'B' || p_partkey % 7 AS super_name FROM part) SELECT 'B3' AS seed, 'B3' AS name, 0 AS depth UNION ALL SELECT 'B3', sub_name, 1 FROM p WHERE super_name = 'B3'")
def hierarchy_of_relations(t):
    """What extends or implements a type, over the relations that the lexer found."""
    edges = type_relations(parsed_files(t, "relations")).select(F.col("super_name").alias("src"), F.col("sub_name").alias("dst")).distinct()
    seed = t.spark.createDataFrame([("B3", "B3")], "seed string, node string")
    return graph.reach(edges, seed, 20).select("seed", F.col("node").alias("name"), "depth")


@query(GEN + " SELECT 'gen/f' || k AS path, 'run' AS name, [2, 1 + 2 * a, 1 + 2 * a, 1 + 2 * a, 1 + a][l + 1] AS complexity, CASE WHEN l = 0 AND a >= 6 THEN 'flat_dispatcher' ELSE 'god_function' END AS label FROM g WHERE [2, 1 + 2 * a, 1 + 2 * a, 1 + 2 * a, 1 + a][l + 1] >= 2 AND [5 + a, 4 + a, 3 + 2 * a, 4 + a, 5 + a][l + 1] >= 9")
def god_functions_by_arms(t):
    """Great callables of parsed files, flat dispatchers told by the arms that the lexer counts."""
    rows = parsed_files(t, "symbols").select("path", F.explode("symbols").alias("s")).select("path", "s.*")
    return scores.god_functions(rows, 2, 9).select("path", "name", "complexity", "label")


#: (lines above, body): real and benign matches of two rules.
BODIES = [
    ("", "fn a() {\n  /* unsafe */ unsafe { go(); }\n}"), ("", 'fn a() {\n  // unsafe\n  let s = "unsafe {\nunsafe"; }'), ("", 'fn a() { let p = include_str!("../x.sql"); }'),
    ("", 'fn a() {\n  if p.starts_with("../") { }\n  open("../y");\n}'), ("", 'fn a() { concat!("x"); open(p, "a../b"); }'), ("#[tokio::test]\n", 'fn t() {\n  open("../z");\n  assert!(run().is_err());\n}'),
    ("#[inline]\n", 'fn t() {\n  open("../z");\n  assert!(run().is_err());\n}'),
]


@query(", x(v, rule, line) AS (VALUES (0, 'SEC008', 2), (3, 'SEC005', 3), (4, 'SEC005', 1), (6, 'SEC005', 2)) SELECT p_partkey AS id, rule, line FROM part JOIN x ON p_partkey % 7 = v")
def rule_contexts(t):
    """Matches that stand in code, not in strings, comments, embeds, checks or beside expected errors."""
    kind = (F.col("p_partkey") % len(BODIES) + 1).cast("int")
    above, text = (F.element_at(F.array(*[F.lit(b[k]) for b in BODIES]), kind) for k in range(2))
    rows = t.raw("part").select(F.col("p_partkey").alias("id"), F.lit("rust").alias("language"), F.lit(0.1).alias("pagerank"), F.lit(True).alias("is_exported"), text.alias("text"), above.alias("above"))
    return rules.scan(rows, [x for x in rules.BUILTIN if x[0] in rules.CONTEXTS]).select("id", "rule", "line")


@query(GEN + ", s AS (SELECT k, l, a, 'run' AS kind FROM g UNION ALL SELECT k, l, a, 'type' FROM g WHERE l > 0) SELECT language, count(*) AS places FROM (SELECT *, ['rust', 'typescript', 'python', 'go', 'java'][l + 1] AS language FROM s) GROUP BY language, kind, CASE WHEN kind = 'type' AND l = 3 THEN 0 ELSE a END HAVING count(*) >= 2")
def clone_groups_by_tokens(t):
    """Groups of symbols of three lines or more with one skeleton, whatever their names, literals and comments."""
    rows = parsed_files(t, "symbols").select("language", F.explode("symbols").alias("s")).where("s.shape_hash is not null")
    return rows.groupBy("language", "s.shape_hash").agg(F.count("*").alias("places")).where("places >= 2").select("language", "places")


#: The lexer's pattern of plain text for an engine whose classes are ASCII only.
PLAIN = r"""//[^\n]*|/\*(?:[\s\S]*?\*/|[\s\S]*)|"(?:[^"\\\n]|\\[\s\S])*"|''(?:[^''\\\n]|\\[\s\S])*''|`[^`]*`|[\p{L}\p{Nl}\p{No}_][\p{L}\p{N}_]*|\p{Nd}[\p{L}\p{N}_]*(?:\.\p{Nd}[\p{L}\p{N}_]*)*|=>|->|::|:=|==|!=|<=|>=|&&|\|\||\?\?|\?\.|[^\p{L}\p{N}_\p{Z}\x{85}\t-\r\x1c-\x1f]"""


@query(
    rf""", x AS (SELECT doc_id, unnest(toks) AS tok, unnest(range(len(toks))) AS n FROM (SELECT doc_id, regexp_extract_all(text, '{PLAIN}') AS toks FROM documents)
    ), y AS (SELECT *, CASE WHEN starts_with(tok, '//') OR starts_with(tok, '/*') THEN 'comment' WHEN length(tok) > 1 AND tok[1] IN ('"', '''', '`') THEN 'string' WHEN regexp_matches(tok, '^[\p{{L}}\p{{Nl}}\p{{No}}_]') THEN 'name'
      WHEN regexp_matches(tok, '^\p{{Nd}}') THEN 'number' WHEN tok IN ('(', '[', '{{') THEN 'open' WHEN tok IN (')', ']', '}}') THEN 'close' ELSE 'mark' END AS kind FROM x
    ), z AS (SELECT *, sum(CASE kind WHEN 'open' THEN 1 WHEN 'close' THEN -1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY n) AS s FROM y
    ), d AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY doc_id ORDER BY n)) - CASE kind WHEN 'open' THEN 1 ELSE 0 END AS depth FROM z
    ) SELECT doc_id AS id, kind, count(*) AS n, sum(length(tok))::BIGINT AS letters, max(depth)::INT AS deepest, min(tok) AS least FROM d GROUP BY 1, 2"""
)
def lexed_documents(t):
    """Tokens of each document by kind: how many, how long, how deep in brackets at most."""
    rows = lexer.token_table(t.raw("documents").select(F.col("doc_id").alias("id"), "text", F.lit(None).cast("string").alias("language")))
    return rows.groupBy("id", "kind").agg(F.count("*").alias("n"), F.sum(F.length("text")).alias("letters"), F.max("depth").alias("deepest"), F.min("text").alias("least"))


#: Files of forty groups: some share a directory, some mostly, some none.
PLACED = """, pf AS (SELECT k AS id, c AS "group", CASE WHEN c < 15 THEN 'src/mod' || c % 6 || '/s' || k % 3 || '/f' || k || '.rs' WHEN c < 25 AND k % 7 < 3 THEN 'src/big' || c % 3 || '/f' || k || '.rs' WHEN c < 25 THEN 'x' || k % 17 || '/y' || k % 13 || '/f' || k || '.rs'
  ELSE 'z' || k % 19 || '/f' || k || '.rs' END AS path, 1.0::DOUBLE / (k + 1) AS pagerank FROM (SELECT p_partkey AS k, p_partkey % 40 AS c FROM part)),
  cd AS (SELECT "group", min(d) AS lo, max(d) AS hi FROM (SELECT "group", string_split(path, '/')[1:-2] AS d FROM pf) GROUP BY 1),
  co AS (SELECT "group", array_to_string(lo[1:coalesce(list_min(list_filter(range(1, len(lo) + 1), lambda i: lo[i] IS DISTINCT FROM hi[i])) - 1, len(lo))], '/') AS directory FROM cd)"""


def _placed(t):
    k = F.col("p_partkey")
    c = k % 40
    text = lambda *x: F.concat(*[F.lit(v) if isinstance(v, str) else v.cast("string") for v in x])
    path = F.when(c < 15, text("src/mod", c % 6, "/s", k % 3, "/f", k, ".rs")).when((c < 25) & (k % 7 < 3), text("src/big", c % 3, "/f", k, ".rs")).when(c < 25, text("x", k % 17, "/y", k % 13, "/f", k, ".rs"))
    return t.raw("part").select(k.alias("id"), c.alias("group"), path.when(c >= 25, text("z", k % 19, "/f", k, ".rs")).alias("path"), (F.lit(1.0) / (k + 1)).alias("pagerank"))


@query(
    PLACED + """, mo AS (SELECT "group", min_by(d, (-n, d)) AS modal, max(n) AS n FROM (SELECT "group", string_split(path, '/')[1] || '/' || string_split(path, '/')[2] AS d, count(*) AS n FROM pf WHERE len(string_split(path, '/')) >= 3 GROUP BY 1, 2) GROUP BY 1),
    al AS (SELECT "group", count(*) AS n, sum(pagerank) AS rank, min_by(path, (-pagerank, path)) AS top FROM pf GROUP BY 1),
    ba AS (SELECT al."group", rank, CASE WHEN contains(directory, '/') THEN directory WHEN mo.n * 10 >= al.n * 3 THEN modal ELSE regexp_extract(top, '([^/]*)\\.rs$', 1) END AS base FROM al JOIN co USING ("group") LEFT JOIN mo USING ("group")),
    nu AS (SELECT *, row_number() OVER (PARTITION BY base ORDER BY rank DESC, "group") AS n FROM ba)
    SELECT "group", round(rank, 9) AS rank, CASE WHEN n = 1 THEN base ELSE base || '-' || (SELECT min_by(regexp_extract(path, '([^/]*)\\.rs$', 1), (-pagerank, path)) FROM pf WHERE pf."group" = nu."group") END AS label FROM nu"""
)
def wiki_labels(t):
    return directories.group_labels(_placed(t)).withColumn("rank", F.round("rank", 9))


@query(
    PLACED + """, ed AS (SELECT DISTINCT l_partkey AS a, l_suppkey AS b FROM lineitem WHERE l_linenumber = 1), cr AS (SELECT DISTINCT x."group" AS f, y."group" AS t FROM ed JOIN pf x ON x.id = a JOIN pf y ON y.id = b WHERE x."group" % 3 = y."group" % 3),
    ok AS (FROM co WHERE contains(directory, '/')) SELECT x.directory || '/**' AS "from", array_to_string(list_sort(list(DISTINCT y.directory || '/**')), ' ') AS deny FROM ok x JOIN ok y ON x.directory <> y.directory WHERE (x."group", y."group") NOT IN (SELECT (f, t) FROM cr) GROUP BY 1"""
)
def boundaries_by_directory(t):
    edges = t.raw("lineitem").where("l_linenumber = 1 and l_partkey % 40 % 3 = l_suppkey % 40 % 3").select(F.col("l_partkey").alias("from_file"), F.col("l_suppkey").alias("to_file")).distinct()
    return directories.suggested_rules(_placed(t), edges).withColumn("deny", F.array_join("deny", " "))
