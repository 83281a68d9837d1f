"""Further named analyses with their SQL: reports, call walks, shortest paths, rule kinds."""

from __future__ import annotations

from pyspark.sql import functions as F

from cairn.functions.session import dealt
from cairn.operators import graph, history, imports, names, resolve, rules, scores, tables as T
from cairn.plans.catalogue import HEALTH, SMELLS, TEST, _smells, query, r

HOT = f"SELECT id, path, max_cc, pagerank, change_count, max_cc * pagerank * (1 + change_count) AS score, {HEALTH.format(cc='max_cc')} AS health FROM files JOIN cc ON id = file_id WHERE max_cc * pagerank * (1 + change_count) > 0"


@query("SELECT shape_hash, count(*) AS members, round(avg(line_end - line_start + 1), 6) AS avg_lines FROM bodies WHERE shape_hash IS NOT NULL AND shape_hash <> '' AND line_end >= 3 GROUP BY 1 HAVING count(*) >= 2 ORDER BY 2 DESC, avg(line_end - line_start + 1) DESC, 1 LIMIT 40")
def dashboard_clones(t):
    return T.clone_counts(t.bodies, 3, 40).select("shape_hash", "members", r("avg_lines").alias("avg_lines"))


@query(", m AS (SELECT shape_hash, id FROM bodies WHERE shape_hash IS NOT NULL), tr AS (SELECT doc_id AS id, lang AS trait FROM documents UNION SELECT doc_id, source FROM documents), z AS (SELECT shape_hash, count(*) AS size FROM m GROUP BY 1 HAVING count(*) >= 2) SELECT shape_hash, trait FROM m JOIN tr USING (id) JOIN z USING (shape_hash) GROUP BY 1, 2, size HAVING count(*) = size")
def clone_traits(t):
    docs = t.raw("documents").select(F.col("doc_id").alias("id"), F.explode(F.array("lang", "source")).alias("trait")).where("trait is not null")
    members = t.bodies.where("shape_hash is not null").select("shape_hash", "id")
    several = members.groupBy("shape_hash").agg(F.count("*").alias("n")).where("n >= 2").select("shape_hash")
    return T.common_traits(members.join(several, "shape_hash", "left_semi"), docs)


@query(", h AS (" + HOT + ") " + " UNION ALL ".join(f"(SELECT '{axis}' AS axis, id, round(score, 6) AS score FROM h ORDER BY {column} {'DESC' if down else 'ASC'}, id LIMIT 6)" for axis, (column, down) in scores.AXES.items()))
def hotspots_by_axis(t):
    rows = scores.hotspots(t.files, t.symbols)
    out = None
    for axis in scores.AXES:
        own = scores.by_axis(rows, axis, 6).select(F.lit(axis).alias("axis"), "id", r("score").alias("score"))
        out = own if out is None else out.unionByName(own)
    return out


@query(SMELLS + ", h AS (" + HOT + "), hot AS (SELECT id FROM h ORDER BY score DESC, id LIMIT 30), f AS (SELECT files.id, files.id IN (FROM hot) AS hot, files.id IN (SELECT file_id FROM smells) AS smell, health FROM files LEFT JOIN h USING (id)) SELECT count(*) AS file_count, count(*) FILTER (hot AND smell) AS critical, count(*) FILTER (smell AND NOT hot) AS medium, count(*) FILTER (hot AND NOT smell) AS low, round(coalesce(avg(CASE WHEN hot THEN health ELSE 0 END), 0), 6) AS avg_health FROM f WHERE hot OR smell")
def health_summary(t):
    return scores.health_summary(t.files, t.symbols, _smells(t)).withColumn("avg_health", r("avg_health"))


@query(", s AS (SELECT user_id AS series, min_by(value, (ts, event_id)) AS first, max_by(value, (ts, event_id)) AS last FROM events GROUP BY 1 HAVING count(*) >= 2), d AS (SELECT series, round(CASE WHEN first = 0 THEN 0 ELSE (last - first) / first * 100 END, 4) AS delta FROM s) SELECT series, delta FROM d ORDER BY abs(delta) DESC, series LIMIT 25")
def trend_by_change(t):
    return history.by_change(history.trend(t.points).withColumn("delta", r("delta", 4)), 25).select("series", "delta")


MINED = ", c AS (SELECT DISTINCT l_orderkey AS commit_id, l_partkey AS file, o_orderdate AS time FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_orderkey % 7 <> 0), latest AS (SELECT DISTINCT commit_id, time FROM c ORDER BY time DESC, commit_id DESC LIMIT 300)"


def _commits(t):
    orders = t.raw("orders").select(F.col("o_orderkey").alias("l_orderkey"), F.col("o_orderdate").alias("time"))
    lines = t.raw("lineitem").select("l_orderkey", "l_partkey")
    n = lines.count()  # from the files' footers; a task sorts so many rows of an order's lines however many there are
    rows = dealt(lines, n, "l_orderkey").join(dealt(orders, n, "l_orderkey"), "l_orderkey")
    return rows.select(F.col("l_orderkey").alias("commit_id"), F.col("l_partkey").alias("file"), "time", F.when(F.col("l_orderkey") % 7 == 0, 2).otherwise(1).alias("parent_count"))


@query(MINED + ", k AS (SELECT commit_id, file FROM c JOIN latest USING (commit_id)), n AS (SELECT commit_id FROM k GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20) SELECT a.file AS file_a, b.file AS file_b, count(*) AS count FROM k a JOIN k b ON a.commit_id = b.commit_id AND a.file < b.file WHERE a.commit_id IN (SELECT commit_id FROM n) GROUP BY 1, 2")
def cochange_mined(t):
    return history.co_change_pairs(history.mined_commits(_commits(t)))


@query(MINED + " SELECT file, count(*) AS change_count FROM c GROUP BY 1")
def churn_without_merges(t):
    return history.plain_churn(_commits(t))


@query(", y AS (SELECT p_partkey * 10 + 1 AS node, 0 AS depth, 1::BIGINT AS paths FROM part WHERE p_partkey <= 3), s1 AS (SELECT l.dst AS node, sum(paths) AS paths, min(node) AS pred FROM y JOIN (SELECT DISTINCT src, dst FROM layers) l ON l.src = node GROUP BY 1), s2 AS (SELECT l.dst AS node, sum(paths) AS paths, min(node) AS pred FROM s1 JOIN (SELECT DISTINCT src, dst FROM layers) l ON l.src = node GROUP BY 1), s3 AS (SELECT l.dst AS node, sum(paths) AS paths, min(node) AS pred FROM s2 JOIN (SELECT DISTINCT src, dst FROM layers) l ON l.src = node GROUP BY 1), b AS (SELECT min(node) AS target, (sum(paths) - 1)::BIGINT AS alternatives FROM s3) SELECT target, 3 AS dist, s1.pred || '>' || s1.node || '>' || s2.node || '>' || target AS path, alternatives FROM b JOIN s3 ON s3.node = target JOIN s2 ON s2.node = s3.pred JOIN s1 ON s1.node = s2.pred")
def path_to_targets(t):
    sources = t.raw("part").where("p_partkey <= 3").select((F.col("p_partkey") * 10 + 1).alias("id"))
    targets = t.raw("region").select((F.col("r_regionkey").cast("long") * 10 + 4).alias("id"))
    return graph.path_to(t.layers, sources, targets).withColumn("path", F.array_join("path", ">"))


CALLS = ", k AS (SELECT DISTINCT s.name AS a, x.name AS b FROM refs r JOIN symbols s ON s.id = from_symbol_id JOIN symbols x ON x.id = to_symbol_id WHERE r.kind = 'call' AND s.name <> '' AND x.name <> '' AND s.name <> x.name)"
LEVELS = CALLS + "".join(
    f", {w}1 AS (SELECT DISTINCT {far} AS name FROM k WHERE {near} = 'The' AND {far} <> 'The'), {w}2 AS (SELECT DISTINCT {far} AS name FROM k WHERE {near} IN (FROM {w}1) AND {far} <> 'The' AND {far} NOT IN (FROM {w}1))" for w, near, far in (("e", "a", "b"), ("r", "b", "a"))
)


@query(LEVELS + " SELECT 'callees' AS direction, 1 AS depth, name FROM e1 UNION ALL SELECT 'callees', 2, name FROM e2 UNION ALL SELECT 'callers', 1, name FROM r1 UNION ALL SELECT 'callers', 2, name FROM r2")
def call_levels(t):
    return resolve.call_levels(t.refs, t.symbols, "The", depth=2, limit=0)


KINDS = [("N1", "capital name", "high", "style", "^[A-Z]", None, "name"), ("G1", "receiver", "medium", "style", r"\(self", None, "signature"), ("X1", "other", "low", "review", "^Q", None, "name")]


@query(f"SELECT s.id, k.rule, k.severity, line_start AS line, round(weight * s.pagerank * (1 + s.is_exported::INT), 6) AS risk FROM symbols s JOIN files f ON f.id = file_id, (VALUES ('N1', 'high', 4), ('G1', 'medium', 2)) k(rule, severity, weight) WHERE NOT {TEST} AND contains(path, 'source/f1') AND (k.rule = 'N1' AND regexp_matches(name, '^[A-Z]') OR k.rule = 'G1' AND s.kind = 'method') ORDER BY weight * s.pagerank * (1 + s.is_exported::INT) DESC, s.id, k.rule LIMIT 200")
def rule_kinds(t):
    files = t.files.select(F.col("id").alias("file_id"), "path", "language")
    rows = t.symbols.select("id", "file_id", "name", "signature", "line_start", "pagerank", "is_exported").join(files, "file_id").withColumn("text", F.lit(""))
    return rules.scan_kinds(rows, KINDS, category="style", path="source/f1", limit=200).select("id", "rule", "severity", "line", r("risk").alias("risk"))


@query(", x AS (SELECT s.id, name, kind, path, is_exported FROM symbols s JOIN (SELECT id AS file_id, path FROM files) USING (file_id)), live AS (SELECT id AS node FROM x WHERE name = 'main' OR is_exported OR starts_with(path, 'tests/') OR kind IN ('function', 'method') AND (starts_with(name, 'test_') OR starts_with(name, 'Test') AND length(name) > 4) UNION SELECT to_symbol_id FROM live JOIN refs ON from_symbol_id = node) SELECT id, path FROM x WHERE kind IN ('function', 'method') AND id NOT IN (SELECT node FROM live)")
def dead_symbols(t):
    return graph.unreachable_symbols(t.symbols, t.files, t.refs).select("id", "path")


NAMED = r", x AS (SELECT s.id, name, kind, path, len(list_filter(string_split_regex(lower(name || ' ' || kind || ' ' || path), '[^\p{{L}}\p{{N}}]+'), lambda w: w <> '')) AS d FROM symbols s JOIN (SELECT id AS file_id, path FROM files) USING (file_id)), h AS (SELECT id, d FROM x WHERE {hit}), s AS (SELECT count(*) AS n, avg(d) AS mean, (SELECT count(*) FROM h) AS df FROM x), k AS (SELECT id, greatest(ln((n - df + 0.5) / (df + 0.5)), 1e-6) * 2.2 / (1 + 1.2 * (0.25 + 0.75 * d / mean)) AS score FROM h, s) SELECT id, round(score, 6) AS score FROM k ORDER BY round(score, 9) DESC, id LIMIT 200"


def _named(t):
    return t.symbols.select("id", "file_id", "name", "kind").join(t.files.select(F.col("id").alias("file_id"), "path"), "file_id")


@query(NAMED.format(hit="lower(name) IN ('the', 'thes')"))
def name_search(t):
    return names.name_search(_named(t), "The").select("id", r("score").alias("score"))


@query(NAMED.format(hit="kind = 'variable'"))
def name_search_kind(t):
    return names.name_search(_named(t), "kind:variables").select("id", r("score").alias("score"))


@query(", b AS (SELECT l_partkey AS path, year(l_shipdate) AS rev, max(l_quantity) AS blob FROM lineitem GROUP BY 1, 2) SELECT coalesce(x.path, y.path) AS path FROM (FROM b WHERE rev = 1995) x FULL JOIN (FROM b WHERE rev = 1996) y ON x.path = y.path WHERE x.blob IS DISTINCT FROM y.blob")
def changed_in_range(t):
    trees = t.raw("lineitem").groupBy(F.col("l_partkey").alias("path"), F.year("l_shipdate").alias("rev")).agg(F.max("l_quantity").alias("blob"))
    return history.changed_in_range(trees, 1995, 1996)


@query(", f AS (SELECT r_regionkey * 10 + 4 AS id, CASE WHEN r_regionkey % 2 = 0 THEN 'SEC003' ELSE 'SEC006' END AS rule FROM region), w AS (SELECT id AS seed, id AS node, 0 AS depth FROM f WHERE rule = 'SEC003' UNION SELECT seed, src, depth + 1 FROM w JOIN layers ON dst = node WHERE depth < 20), i AS (SELECT s_suppkey * 10 + 2 AS node FROM supplier WHERE s_acctbal < 0), h AS (SELECT seed AS id, min_by(node, (depth, node)) AS source, min(depth) AS distance FROM w WHERE node IN (FROM i) GROUP BY 1) SELECT id, rule, source, distance, 'read_input > nation' || s_nationkey || ' > region' || n_regionkey AS path FROM f LEFT JOIN h USING (id) LEFT JOIN supplier ON s_suppkey * 10 + 2 = source LEFT JOIN nation ON n_nationkey = s_nationkey")
def findings_annotated(t):
    findings = t.raw("region").select((F.col("r_regionkey").cast("long") * 10 + 4).alias("id"), F.when(F.col("r_regionkey") % 2 == 0, "SEC003").otherwise("SEC006").alias("rule"), F.lit("injection").alias("category"))
    symbols = t.raw("supplier").select((F.col("s_suppkey") * 10 + 2).alias("id"), F.when(F.col("s_acctbal") < 0, "read_input").otherwise(F.lit("store")).alias("name"), F.lit(None).cast("string").alias("signature"))
    others = t.raw("nation").select((F.col("n_nationkey").cast("long") * 10 + 3).alias("id"), F.concat(F.lit("nation"), "n_nationkey").alias("name"))
    others = others.union(t.raw("region").select(F.col("r_regionkey").cast("long") * 10 + 4, F.concat(F.lit("region"), "r_regionkey"))).withColumn("signature", F.lit(None).cast("string"))
    refs = t.layers.select(F.col("src").alias("from_symbol_id"), F.col("dst").alias("to_symbol_id"))
    return rules.annotated(findings, symbols.union(others), refs).select("id", "rule", "source", "distance", F.array_join("path", " > ").alias("path"))


IMPORTED = ", p AS (SELECT id, path, '../../' || path AS specifier FROM files)"


@query(IMPORTED + " SELECT a.path AS path, b.specifier, b.path AS to_path FROM edges JOIN files a ON a.id = from_file JOIN p b ON b.id = to_file WHERE NOT starts_with(a.path, 'tests/')")
def resolve_imports(t):
    target = t.files.select(F.col("id").alias("to_file"), F.concat(F.lit("../../"), "path").alias("specifier"))
    own = t.files.where(~F.col("path").startswith("tests/")).select(F.col("id").alias("from_file"), "path", F.lit("typescript").alias("language"))
    return imports.resolve_imports(t.edges.join(target, "to_file").join(own, "from_file"), t.files)
