"""The named analyses over the given tables, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cairn.functions import scalar as X
from cairn.operators import components, graph, history, resolve, rules, scores, search, tables as T, text_index
from cairn.functions.session import settle
from cairn.plans.adapters import SQL, Tables
from cairn.sources import sinks
from cairn.streaming import watch

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None, **extra):
    """Registers a function of Tables; `sql` goes behind the shared table expressions."""

    def add(f):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            return f(Tables(spark, sf_dir))

        run.__name__, run.__doc__ = f.__name__, f.__doc__
        QUERIES[f.__name__] = run
        if sql is not None:
            ORACLE[f.__name__] = SQL + sql
        return f

    return add


HEALTH = "(10 / (1 + {cc} / 10) + 10 / (1 + pagerank * 50) + 10 / (1 + change_count / 8)) / 3"
TEST = "starts_with(path, 'tests/')"
CHANGED = "src3"


def r(c, n=6):
    return F.round(c, n)


@query(f"SELECT path, max_cc, round(max_cc * pagerank * (1 + change_count), 6) AS score, round({HEALTH.format(cc='max_cc')}, 6) AS health FROM files JOIN cc ON id = file_id WHERE max_cc * pagerank * (1 + change_count) > 0")
def hotspots_file(t):
    return scores.hotspots(t.files, t.symbols).select("path", "max_cc", r("score").alias("score"), r("health").alias("health"))


@query("SELECT s.id, name, path, round(complexity * s.pagerank * (1 + change_count), 6) AS score FROM symbols s JOIN files f ON s.file_id = f.id WHERE complexity > 0 AND change_count >= 0 ORDER BY round(complexity * s.pagerank * (1 + change_count), 6) DESC, s.id LIMIT 50")
def hotspots_symbol(t):
    return T.page(scores.symbol_hotspots(t.files, t.symbols).select("id", "name", "path", r("score").alias("score")), [F.desc("score"), "id"], 50)


@query("SELECT language, count(*) AS file_count, sum(line_count)::BIGINT AS lines, sum(size_bytes)::BIGINT AS bytes, coalesce(sum(n), 0)::BIGINT AS symbols FROM files LEFT JOIN (SELECT file_id, count(*) AS n FROM symbols GROUP BY 1) ON id = file_id GROUP BY 1")
def language_stats(t):
    return T.language_stats(t.files, t.symbols)


@query("SELECT to_file AS id, path, count(*) AS importers FROM edges JOIN files ON id = to_file GROUP BY ALL ORDER BY 3 DESC, 1 LIMIT 25")
def most_imported(t):
    return T.most_imported(t.edges, t.files, 25).select("id", "path", "importers")


@query("SELECT s.id, path, line_start FROM symbols s JOIN files f ON f.id = file_id WHERE s.is_exported AND NOT unused_excluded AND file_id NOT IN (SELECT to_file FROM edges) AND s.id NOT IN (SELECT to_symbol_id FROM refs)")
def unused_exports(t):
    return T.unused_exports(t.symbols, t.files, t.edges, t.refs).select("id", "path", "line_start")


@query("SELECT shape_hash, count(DISTINCT file_id) AS places, round(avg(line_end - line_start + 1), 6) AS avg_lines FROM bodies WHERE shape_hash IS NOT NULL AND line_end >= 3 GROUP BY 1 HAVING count(*) >= 2")
def clone_groups(t):
    return T.clone_groups(t.bodies).select("shape_hash", "places", r("avg_lines").alias("avg_lines"))


@query(", g AS (SELECT shape_hash, count(*) AS places FROM bodies WHERE shape_hash IS NOT NULL AND line_end >= 3 GROUP BY 1 HAVING count(*) >= 2) SELECT shape_hash, places, b.id, path, line_start FROM bodies b JOIN g USING (shape_hash) JOIN files f ON f.id = b.file_id")
def clone_members(t):
    return T.clone_members(t.bodies, t.files, T.clone_groups(t.bodies)).withColumn("line_start", F.col("line_start").cast("int"))


@query("SELECT DISTINCT to_symbol_id AS target, from_symbol_id, name AS from_name, path FROM refs JOIN symbols s ON s.id = from_symbol_id JOIN files f ON f.id = s.file_id WHERE to_symbol_id IN (SELECT id FROM symbols WHERE name = 'The')")
def references_of(t):
    return T.references_of(t.refs, t.symbols, t.files, t.symbols.where("name = 'The'"))


@query(f"SELECT id FROM symbols WHERE id IN (SELECT to_symbol_id FROM refs JOIN symbols s ON s.id = from_symbol_id JOIN files f ON f.id = s.file_id WHERE {TEST})")
def referenced_by_tests(t):
    return T.referenced_by_tests(t.symbols, t.refs, t.files).select("id")


@query("SELECT partner, count FROM pairs2 WHERE id = 3 ORDER BY count DESC, partner LIMIT 10")
def partner_topk(t):
    return T.partners(t.file_pairs, 3, 10)


@query("SELECT p.partner, s.id AS symbol_id, s.name FROM pairs2 p JOIN symbols s ON s.file_id = p.partner WHERE p.id = 3 ORDER BY count DESC, s.pagerank DESC, s.id LIMIT 11")
def symbol_cochange_fanout(t):
    rows = T.partners(t.file_pairs, 3, 0).join(t.symbols.select(F.col("file_id").alias("partner"), F.col("id").alias("symbol_id"), "name", "pagerank"), "partner")
    return T.page(rows, [F.desc("count"), F.desc("pagerank"), "symbol_id"], 11).select("partner", "symbol_id", "name")


@query("SELECT p.file_id, p.at_line AS \"at\", max_by(s.id, (line_start, s.id)) AS span_id FROM (SELECT file_id, line_start + 1 AS at_line FROM symbols) p JOIN symbols s ON s.file_id = p.file_id AND line_start <= at_line AND at_line <= line_end GROUP BY 1, 2")
def enclosing_interval(t):
    points = t.symbols.select("file_id", (F.col("line_start") + 1).alias("at"))
    return T.innermost(points, t.symbols.select("file_id", "id", F.col("line_start").alias("start"), F.col("line_end").alias("end")), "file_id")


@query(", n AS (SELECT commit_id FROM commits GROUP BY 1 HAVING count(*) BETWEEN 2 AND 20) SELECT a.file AS file_a, b.file AS file_b, count(*) AS count FROM commits a JOIN commits b ON a.commit_id = b.commit_id AND a.file < b.file WHERE a.commit_id IN (SELECT commit_id FROM n) GROUP BY 1, 2")
def cochange_pairs(t):
    return history.co_change_pairs(t.commits, n_rows=t.commits.count())


@query("SELECT file, count(*) AS change_count FROM commits GROUP BY 1")
def churn(t):
    return history.churn(t.commits)


@query(", n AS (SELECT commit_id FROM commits GROUP BY 1 HAVING count(*) BETWEEN 2 AND 30) SELECT b.file AS partner, count(*) AS count FROM commits a JOIN commits b USING (commit_id) WHERE a.file = 11 AND b.file <> 11 AND commit_id IN (SELECT commit_id FROM n) GROUP BY 1")
def cochange_for_target(t):
    return history.co_changes_of(t.commits, 11)


BUS = ", own AS (SELECT {by} AS k, l_suppkey AS author, sum(l_quantity::BIGINT) AS lines FROM lineitem {join} GROUP BY 1, 2), o AS (SELECT *, row_number() OVER w AS n, sum(lines) OVER (PARTITION BY k ORDER BY lines DESC, author ROWS UNBOUNDED PRECEDING) AS held, ceil(sum(lines) OVER (PARTITION BY k) / 2) AS half FROM own WINDOW w AS (PARTITION BY k ORDER BY lines DESC, author)) SELECT k AS {name}, count(*) AS authors, sum(lines)::BIGINT AS lines, min(CASE WHEN held >= half THEN n END) AS bus_factor FROM o GROUP BY 1"


@query(BUS.format(by="l_partkey", join="", name="file"))
def bus_factor_file(t):
    return history.bus_factor(t.hunks, "file")


@query(BUS.format(by="p_brand", join="JOIN part ON p_partkey = l_partkey", name="module"))
def bus_factor_module(t):
    parts = t.raw("part").select(F.col("p_partkey").alias("file"), F.col("p_brand").alias("module"))
    return history.bus_factor(t.hunks.join(parts, "file"), "module")


@query("SELECT l_suppkey AS author, sum(l_quantity::BIGINT)::BIGINT AS lines, max_by(l_orderkey, (l_shipdate, l_orderkey)) AS last_commit FROM lineitem GROUP BY 1")
def author_rollup(t):
    return history.author_rollup(t.hunks)


@query(", h AS (SELECT l_partkey AS file, l_suppkey AS author, l_linenumber * 10 AS a, l_linenumber * 10 + l_quantity::BIGINT - 1 AS b FROM lineitem), o AS (SELECT file, author, sum(least(b, 60) - greatest(a, 20) + 1) AS lines FROM h WHERE a <= 60 AND b >= 20 GROUP BY 1, 2) SELECT file AS id, author, lines::BIGINT AS lines, round(lines * 100.0::DOUBLE / sum(lines) OVER (PARTITION BY file), 6) AS share FROM o")
def symbol_blame(t):
    hunks = t.raw("lineitem").select(F.col("l_partkey").alias("path"), F.col("l_suppkey").alias("author"), (F.col("l_linenumber") * 10).alias("line_start"), F.col("l_quantity").cast("long").alias("line_count"))
    spans = t.raw("part").select(F.col("p_partkey").alias("path"), F.col("p_partkey").alias("id"), F.lit(20).alias("start"), F.lit(60).alias("end"))
    return history.blame_of_span(hunks, spans, max(hunks.count(), spans.count())).withColumn("share", r("share"))


@query(", s AS (SELECT user_id AS series, count(*) AS n, min_by(value, (ts, event_id)) AS first, max_by(value, (ts, event_id)) AS last FROM events GROUP BY 1 HAVING count(*) >= 2), d AS (SELECT *, CASE WHEN first = 0 THEN 0 ELSE (last - first) / first * 100 END AS delta FROM s) SELECT series, n, first, last, round(delta, 4) AS delta, CASE WHEN delta > 10 THEN 'GROWING' WHEN delta < -10 THEN 'SHRINKING' ELSE 'STABLE' END AS direction FROM d")
def trend_direction(t):
    return history.trend(t.points).withColumn("delta", r("delta", 4))


@query("SELECT event_id, CASE WHEN value > b THEN '(+)' WHEN value < b THEN '(-)' ELSE '' END AS marker FROM (SELECT event_id, value, lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS b FROM events)")
def trend_markers(t):
    return history.markers(t.points).select("event_id", "marker")


def _pagerank_sql(steps: int, start: str) -> str:
    out = f", nodes AS (SELECT p_partkey AS id FROM part), deg AS (SELECT src, count(*) AS d FROM chain GROUP BY 1), n AS (SELECT count(*) AS n FROM nodes), r0 AS (SELECT id, {start} AS rank FROM nodes, n)"
    for k in range(steps):
        out += f", r{k + 1} AS (SELECT nodes.id, 0.15 / n + 0.85 * coalesce((SELECT sum(rank) FROM r{k} WHERE id NOT IN (SELECT src FROM deg)), 0) / n + 0.85 * coalesce(g, 0) AS rank FROM nodes CROSS JOIN n LEFT JOIN (SELECT dst, sum(rank / d) AS g FROM chain JOIN deg USING (src) JOIN r{k} ON r{k}.id = src GROUP BY 1) x ON x.dst = nodes.id)"
    return out + f" SELECT id, round(rank, 10) AS rank FROM r{steps}"


@query(_pagerank_sql(5, "1.0::DOUBLE / n"))
def pagerank_k(t):
    nodes = t.raw("part").select(F.col("p_partkey").alias("id"))
    return graph.pagerank(nodes, t.chain, iterations=5, epsilon=0).withColumn("rank", r("rank", 10))


@query(_pagerank_sql(3, "CASE WHEN id > 0 THEN 2.0::DOUBLE * id / (n * (n + 1)) ELSE 1.0::DOUBLE / n END"))
def pagerank_warm(t):
    nodes = t.raw("part").select(F.col("p_partkey").alias("id"))
    n = nodes.count()
    prior = nodes.withColumn("rank", 2.0 * F.col("id") / (n * (n + 1.0)))
    return graph.pagerank(nodes, t.chain, iterations=3, epsilon=0, prior=prior).withColumn("rank", r("rank", 10))


CLOSURE = ", up AS (SELECT dst AS seed, src AS node FROM layers UNION SELECT up.seed, l.src FROM up JOIN layers l ON l.dst = up.node)"


@query(CLOSURE + " SELECT n.id, count(node) AS importers FROM (SELECT src AS id FROM layers UNION SELECT dst FROM layers) n LEFT JOIN up ON up.seed = n.id GROUP BY 1")
def blast_counts(t):
    return components.blast_counts(t.layers)


NEXT = ", nx AS (SELECT src, min(dst) AS dst FROM chain GROUP BY 1 UNION SELECT src, max(dst) FROM chain GROUP BY 1), rc AS (SELECT src AS a, dst AS b FROM nx UNION SELECT rc.a, nx.dst FROM rc JOIN nx ON nx.src = rc.b), nd AS (SELECT a AS id FROM rc UNION SELECT b FROM rc)"


def _next(t):
    """(src, dst): each part's least and greatest next part; one large component and what hangs on it."""
    ends = t.steps.groupBy("src").agg(F.min("dst").alias("lo"), F.max("dst").alias("hi"))
    return ends.select("src", F.explode(F.array("lo", "hi")).alias("dst"))


@query(NEXT + " SELECT id, coalesce(least(id, c), id) AS component FROM nd LEFT JOIN (SELECT x.a AS id, min(x.b) AS c FROM rc x JOIN rc y ON x.a = y.b AND x.b = y.a GROUP BY 1) USING (id)")
def strong_components(t):
    return components.strong_components(_next(t))


@query(NEXT + " SELECT id, coalesce(n, 0) AS importers FROM nd LEFT JOIN (SELECT b AS id, count(*) AS n FROM rc WHERE a <> b GROUP BY 1) USING (id)")
def blast_of_cycles(t):
    return components.blast_counts(_next(t))


@query(CLOSURE + " SELECT seed AS target, node, EXISTS (SELECT 1 FROM layers WHERE src = node AND dst = seed) AS direct FROM up WHERE seed % 10 = 4")
def blast_for_set(t):
    return graph.blast_of(t.layers, t.raw("region").select((F.col("r_regionkey").cast("long") * 10 + 4).alias("id")))


@query(", walk AS (SELECT 1::BIGINT AS node, 0 AS depth UNION SELECT dst, depth + 1 FROM walk JOIN chain ON src = node WHERE depth < 2) SELECT node, min(depth)::INT AS depth FROM walk GROUP BY 1")
def transitive_bounded(t):
    return graph.reach(t.chain, t.spark.range(1).select(F.lit(1).cast("long").alias("seed"), F.lit(1).cast("long").alias("node")), 2).select("node", "depth")


def _paths_sql(steps: int) -> str:
    out = ", s0 AS (SELECT 1::BIGINT AS node, 0 AS dist, 1::HUGEINT AS paths, NULL::BIGINT AS pred), v0 AS (SELECT node FROM s0)"
    for k in range(1, steps + 1):
        out += f", s{k} AS (SELECT dst AS node, {k} AS dist, sum(paths) AS paths, min(node) AS pred FROM s{k - 1} JOIN chain ON src = node WHERE dst NOT IN (SELECT node FROM v{k - 1}) GROUP BY 1), v{k} AS (SELECT node FROM v{k - 1} UNION ALL SELECT node FROM s{k})"
    return out + " SELECT node, dist, paths::BIGINT AS paths, pred FROM (" + " UNION ALL ".join(f"SELECT * FROM s{k}" for k in range(steps + 1)) + ")"


@query(_paths_sql(6))
def shortest_path_counts(t):
    return graph.shortest_paths(t.chain, t.spark.range(1, 2), 6)


HIERARCHY = ", h AS (SELECT n_name AS sub, r_name AS sup FROM nation JOIN region ON r_regionkey = n_regionkey UNION ALL SELECT r_name, 'WORLD' FROM region)"


def _hierarchy(t):
    nation, region = t.raw("nation"), t.raw("region")
    sub = nation.join(region, nation.n_regionkey == region.r_regionkey).select(F.col("n_name").alias("src"), F.col("r_name").alias("dst"))
    return sub.union(region.select("r_name", F.lit("WORLD")))


@query(HIERARCHY + ", w AS (SELECT 'WORLD' AS node, 0 AS depth UNION ALL SELECT sub, depth + 1 FROM w JOIN h ON sup = node WHERE depth < 20) SELECT node, depth FROM w")
def hierarchy_sub(t):
    seed = t.spark.createDataFrame([("WORLD", "WORLD")], "seed string, node string")
    return graph.reach(graph.reverse(_hierarchy(t)), seed, 20).select("node", "depth")


@query(HIERARCHY + ", w AS (SELECT n_name AS seed, n_name AS node, 0 AS depth FROM nation UNION ALL SELECT seed, sup, depth + 1 FROM w JOIN h ON sub = node WHERE depth < 20) SELECT seed, node, depth FROM w")
def hierarchy_super(t):
    seeds = t.raw("nation").select(F.col("n_name").alias("seed"), F.col("n_name").alias("node"))
    return graph.reach(_hierarchy(t), seeds, 20)


@query(", live AS (SELECT s_suppkey * 10 + 2 AS node FROM supplier WHERE s_acctbal > 9000 UNION SELECT dst FROM live JOIN layers ON src = node) SELECT id FROM (SELECT src AS id FROM layers UNION SELECT dst FROM layers) WHERE id NOT IN (SELECT node FROM live)")
def dead_code(t):
    roots = t.raw("supplier").where("s_acctbal > 9000").select(F.lit(0).alias("seed"), (F.col("s_suppkey") * 10 + 2).alias("node"))
    nodes = t.layers.select(F.col("src").alias("id")).union(t.layers.select("dst")).distinct()
    return nodes.join(graph.reach(t.layers, roots).select(F.col("node").alias("id")), "id", "left_anti")


@query("SELECT DISTINCT id FROM (SELECT dst AS id FROM (SELECT from_file AS src, to_file AS dst FROM edges) WHERE src = 5 UNION SELECT from_file FROM edges WHERE to_file = 5 UNION SELECT partner FROM pairs2 WHERE id = 5 AND count >= 1) WHERE id <> 5")
def neighbours(t):
    return graph.neighbours(t.edges.select(F.col("from_file").alias("src"), F.col("to_file").alias("dst")), t.file_pairs, 5, 1)


@query("SELECT from_file AS src, to_file AS dst FROM edges WHERE from_file IN (SELECT id FROM files WHERE source = 'src3') AND to_file IN (SELECT id FROM files WHERE source = 'src3')")
def induced_subgraph(t):
    return graph.induced(t.edges.select(F.col("from_file").alias("src"), F.col("to_file").alias("dst")), t.files.where("source = 'src3'"))


@query(", x AS (SELECT id, pagerank * (1 + ln(1 + coalesce(max_cc, 0))) * (1 + ln(1 + change_count)) AS raw FROM files LEFT JOIN cc ON id = file_id) SELECT id, round((raw - min(raw) OVER ()) / (max(raw) OVER () - min(raw) OVER ()), 8) AS hot_score FROM x")
def hot_score(t):
    return scores.hot_score(t.files, t.symbols).select("id", r("hot_score", 8).alias("hot_score"))


SMELLS = ", smells AS (SELECT DISTINCT file_id FROM symbols WHERE kind IN ('function', 'method') AND complexity >= 8 AND line_end - line_start + 1 >= 5)"


def _smells(t):
    return scores.god_functions(t.symbols, 8, 5)


@query("SELECT id, complexity, line_end - line_start + 1 AS lines FROM symbols WHERE kind IN ('function', 'method') AND complexity >= 8 AND line_end - line_start + 1 >= 5")
def god_functions(t):
    return _smells(t).select("id", "complexity", "lines")


@query(
    """, sg AS (SELECT doc_id * 100000 + pos AS id, pos % 4 AS method, string_split('(' || CASE WHEN pos % 4 = 1 THEN 'self, ' ELSE '' END || line || ')', '') AS ch FROM lines WHERE pos % 4 < 2 AND length(line) - length(replace(line, ',', '')) + (pos % 4) >= 4),
    c1 AS (SELECT id, method, unnest(ch) AS ch, unnest(range(len(ch))) AS i FROM sg), c2 AS (SELECT *, sum(CASE WHEN ch IN ('(', '[', '{', '<') THEN 1 WHEN ch IN (')', ']', '}', '>') THEN -1 ELSE 0 END) OVER (PARTITION BY id ORDER BY i) AS d FROM c1),
    c3 AS (SELECT *, min(CASE WHEN d = 0 THEN i END) OVER (PARTITION BY id) AS stop FROM c2), c4 AS (SELECT *, ch = ',' AND d = 1 AS cut, sum((ch = ',' AND d = 1)::INT) OVER (PARTITION BY id ORDER BY i) AS part FROM c3 WHERE stop IS NULL OR i < stop),
    c5 AS (SELECT id, method, part FROM c4 WHERE i > 0 AND NOT cut AND trim(ch) <> '' GROUP BY ALL) SELECT id, (count(*) - any_value(method))::INT AS parameters FROM c5 GROUP BY id HAVING count(*) - any_value(method) >= 5"""
)
def long_parameters(t):
    return scores.long_parameters(t.symbols).select("id", "parameters")


@query(", c AS (SELECT from_symbol_id AS id, s.owner_type AS owner, x.owner_type AS other, count(*) AS n FROM refs r JOIN symbols s ON s.id = from_symbol_id JOIN symbols x ON x.id = to_symbol_id WHERE r.kind = 'call' AND s.kind = 'method' AND x.kind = 'method' GROUP BY 1, 2, 3) SELECT id, other AS envied, n AS external, 0::BIGINT AS own, n::DOUBLE AS ratio FROM c WHERE owner <> other AND n >= 1")
def feature_envy(t):
    return scores.feature_envy(t.symbols, t.refs, ratio=0.5, least=1, dispatch=False)


@query(
    """, m AS (SELECT p_partkey AS id, 'm' || p_partkey % 700 AS name, 'T' || p_partkey % 6 AS owner FROM part), w AS (SELECT name, count(DISTINCT owner) AS owners FROM m GROUP BY 1),
    c AS (SELECT l_orderkey % 1000 AS id, 'T' || l_orderkey % 5 AS own_type, owner AS other, count(*) AS n, sum((owners >= 3)::INT) AS s FROM lineitem JOIN m ON m.id = l_partkey JOIN w USING (name) GROUP BY ALL),
    f AS (SELECT *, coalesce(sum(CASE WHEN own_type = other THEN n END) OVER z, 0)::BIGINT AS own, coalesce(sum((own_type <> other)::INT) OVER z >= 5 AND sum(CASE WHEN own_type <> other THEN s END) OVER z >= 0.8 * sum(CASE WHEN own_type <> other THEN n END) OVER z, false) AS spread FROM c WINDOW z AS (PARTITION BY id))
    SELECT id, other AS envied, n AS external, own, round(n / CASE WHEN own = 0 THEN 1 ELSE own END, 6) AS ratio FROM f WHERE own_type <> other AND NOT spread AND s + 1 < n AND n >= 2 AND n >= 1.2 * CASE WHEN own = 0 THEN 1 ELSE own END"""
)
def envy_without_dispatch(t):
    """Orders call parts; names that several owners have may be dispatched to any."""
    key = F.col("p_partkey")
    methods = t.raw("part").select(key.alias("id"), F.concat(F.lit("m"), key % 700).alias("name"), F.concat(F.lit("T"), key % 6).alias("owner_type"), F.lit("(&self)").alias("signature"))
    line = t.raw("lineitem").select((F.col("l_orderkey") % 1000).alias("n"), "l_partkey")
    callers = line.select("n").distinct().select((-1 - F.col("n")).alias("id"), F.lit("caller").alias("name"), F.concat(F.lit("T"), F.col("n") % 5).alias("owner_type"), F.lit("()").alias("signature"))
    refs = line.select((-1 - F.col("n")).alias("from_symbol_id"), F.col("l_partkey").alias("to_symbol_id"), F.lit("call").alias("kind"))
    out = scores.feature_envy(methods.unionByName(callers).withColumn("kind", F.lit("method")), refs, ratio=1.2)
    return out.select((-1 - F.col("id")).alias("id"), "envied", "external", "own", r("ratio").alias("ratio"))


REPORT = SMELLS + f", rep AS (SELECT id, path, round({HEALTH.format(cc='max_cc')}, 6) AS health, max_cc >= 8 AND change_count > 0 AS hot, id IN (SELECT file_id FROM smells) AS smell FROM files JOIN cc ON id = file_id WHERE NOT {TEST}), sev AS (SELECT id, health, CASE WHEN hot AND smell THEN '1 Critical' WHEN hot THEN '2 High' ELSE '3 Medium' END AS severity FROM rep WHERE (hot OR smell) AND health <= 8)"


def _report(t):
    return scores.health_report(t.files, t.symbols, _smells(t), min_cc=8, max_health=8.0).select("id", r("health").alias("health"), "severity")


@query(REPORT + " SELECT * FROM sev")
def health_report(t):
    return _report(t)


@query(REPORT + ", o AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY health, id) AS turn FROM sev) SELECT id, severity, turn FROM o ORDER BY turn, severity LIMIT 15")
def round_robin_limit(t):
    return T.round_robin(_report(t), "severity", ["health", "id"], 15).select("id", "severity", F.col("turn").cast("long").alias("turn"))


@query(REPORT + ", k AS (SELECT severity, greatest(1, floor(20 * count(*) / sum(count(*)) OVER ())) AS quota FROM sev GROUP BY 1), o AS (SELECT *, row_number() OVER (PARTITION BY severity ORDER BY health, id) AS n FROM sev) SELECT id, severity FROM o JOIN k USING (severity) WHERE n <= quota")
def quota_limit(t):
    return scores.quotas(_report(t), "severity", ["health", "id"], 20).select("id", "severity")


@query(SMELLS + ", hot AS (SELECT id FROM files JOIN cc ON id = file_id WHERE max_cc * pagerank * (1 + change_count) > 0 ORDER BY max_cc * pagerank * (1 + change_count) DESC, id LIMIT 30) SELECT id, CASE WHEN id IN (FROM hot) AND id IN (SELECT file_id FROM smells) THEN 'critical' WHEN id IN (SELECT file_id FROM smells) THEN 'medium' WHEN id IN (FROM hot) THEN 'low' ELSE 'ok' END AS level FROM files")
def project_health(t):
    return scores.project_health(t.files, t.symbols, _smells(t)).select("id", "level")


VIOL = ", viol AS (SELECT from_file AS id, count(*) AS violations FROM edges JOIN files a ON a.id = from_file JOIN files b ON b.id = to_file WHERE a.source = 'src3' AND b.source = 'src5' GROUP BY 1)"


@query(VIOL + f", x AS (SELECT id, path, coalesce(violations, 0) AS violations, id IN (SELECT to_file FROM edges JOIN files f ON f.id = from_file WHERE starts_with(f.path, 'tests/')) AS tested, {HEALTH.format(cc='coalesce(max_cc, 0)')} AS health FROM files LEFT JOIN cc ON id = file_id LEFT JOIN viol USING (id) WHERE source = '{CHANGED}') SELECT id, path, violations, tested, round(health, 6) AS health, round(greatest(0, least(10, 10 - health + least(violations, 3) * 0.5::DOUBLE + CASE WHEN tested THEN 0 ELSE 1.5::DOUBLE END)), 6) AS risk FROM x")
def change_risk(t):
    side = t.files.select("id", "source")
    hit = t.edges.join(side.where("source = 'src3'").select(F.col("id").alias("from_file")), "from_file", "left_semi").join(side.where("source = 'src5'").select(F.col("id").alias("to_file")), "to_file", "left_semi")
    violations = hit.groupBy(F.col("from_file").alias("id")).agg(F.count("*").alias("violations"))
    out = scores.change_risk(t.files, t.symbols, side.where(F.col("source") == CHANGED), t.edges, violations)
    return out.withColumn("health", r("health")).withColumn("risk", r("risk"))


@query(f"SELECT from_file AS id, count(DISTINCT to_file) AS n FROM edges WHERE to_file IN (SELECT id FROM files WHERE source = '{CHANGED}') GROUP BY 1 HAVING count(DISTINCT to_file) >= 2")
def convergence(t):
    return scores.convergence(t.edges, t.files.where(F.col("source") == CHANGED))


@query(f", ch AS (SELECT id FROM files WHERE source = '{CHANGED}'), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count DESC, partner) AS n FROM pairs2 WHERE id IN (FROM ch) AND partner NOT IN (FROM ch)) SELECT id, partner, count FROM o WHERE n <= 10")
def omissions(t):
    return scores.omissions(t.file_pairs, t.files.where(F.col("source") == CHANGED))


@query("SELECT b.path AS source, count(DISTINCT a.path) AS n_tests, min(a.path) AS first_test FROM edges JOIN files a ON a.id = from_file JOIN files b ON b.id = to_file WHERE starts_with(a.path, 'tests/') AND NOT starts_with(b.path, 'tests/') GROUP BY 1")
def test_map(t):
    return scores.test_map(t.files, t.edges)


@query(f", imp AS (SELECT to_file AS id, count(DISTINCT from_file) AS n FROM edges GROUP BY 1), x AS (SELECT path, (10 - {HEALTH.format(cc='coalesce(max_cc, 0)')}) * (1 + coalesce(n, 0) / 10) AS score FROM files LEFT JOIN cc ON id = file_id LEFT JOIN imp USING (id) WHERE NOT {TEST} AND language IN ('en', 'de') AND id NOT IN (SELECT to_file FROM edges JOIN files f ON f.id = from_file WHERE starts_with(f.path, 'tests/'))) SELECT path, round(score, 6) AS score FROM x")
def test_gaps(t):
    return scores.test_gaps(t.files, t.symbols, t.edges, ["en", "de"]).withColumn("score", r("score"))


@query(f", ch AS (SELECT id FROM files WHERE source = '{CHANGED}'), o AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY count DESC, partner) AS n FROM pairs2 WHERE id IN (FROM ch) AND partner NOT IN (FROM ch)), x AS (SELECT from_file AS test, to_file AS source FROM edges WHERE to_file IN (FROM ch) UNION SELECT partner, id FROM o WHERE n <= 10 UNION SELECT id, id FROM ch) SELECT test, count(*) AS n_sources FROM x WHERE test IN (SELECT id FROM files WHERE {TEST}) GROUP BY 1")
def test_suggest(t):
    return scores.test_suggest(t.files, t.edges, t.file_pairs, t.files.where(F.col("source") == CHANGED))


@query(", o AS (SELECT to_file AS id, 3 + 10 * pagerank AS score FROM (SELECT DISTINCT to_file FROM edges WHERE from_file = 9) JOIN files ON id = to_file), b AS (SELECT from_file AS id, 2 + 5 * pagerank AS score FROM (SELECT DISTINCT from_file FROM edges WHERE to_file = 9) JOIN files ON id = from_file), c AS (SELECT partner AS id, 1.5::DOUBLE * count AS score FROM pairs2 WHERE id = 9 ORDER BY count DESC, partner LIMIT 10), s AS (SELECT DISTINCT from_file AS id, 0.5::DOUBLE AS score FROM edges WHERE to_file IN (SELECT id FROM b) AND from_file NOT IN (SELECT id FROM b)), m AS (SELECT doc_id AS id, 1.0::DOUBLE AS score FROM documents WHERE contains(text, 'there')) SELECT id, round(sum(score), 6) AS score FROM (FROM o UNION ALL FROM b UNION ALL FROM c UNION ALL FROM s UNION ALL FROM m) WHERE id <> 9 GROUP BY 1 ORDER BY round(sum(score), 9) DESC, id LIMIT 15")
def context_rank(t):
    mentioned = t.raw("documents").where(F.col("text").contains("there")).select(F.col("doc_id").alias("id"))
    return scores.context_rank(t.files, t.edges, t.file_pairs, 9, mentioned).withColumn("score", r("score"))


RULES = [{"from": "src/src3/**", "deny": ["src/src5/**", "tests/**"], "allow": ["tests/src3/*"]}, {"from": "src/**/*.de", "deny": ["src/**/*.es"]}]


@query(", x AS (SELECT DISTINCT a.path AS from_path, b.path AS to_path FROM edges JOIN files a ON a.id = from_file JOIN files b ON b.id = to_file), y AS (SELECT *, CASE WHEN starts_with(from_path, 'src/src3/') AND (starts_with(to_path, 'src/src5/') OR starts_with(to_path, 'tests/')) AND NOT regexp_matches(to_path, '^tests/src3/[^/]*$') THEN 0 WHEN starts_with(from_path, 'src/') AND ends_with(from_path, '.de') AND starts_with(to_path, 'src/') AND ends_with(to_path, '.es') THEN 1 END AS rule_index FROM x) SELECT rule_index, from_path, to_path FROM y WHERE rule_index IS NOT NULL")
def boundaries_check(t):
    return scores.boundary_violations(t.edges, t.files, RULES)


GROUPS = ", g AS (SELECT id, source || '-' || language AS \"group\" FROM files)"


def _groups(t):
    return t.files.select("id", F.concat("source", F.lit("-"), "language").alias("group"))


@query(GROUPS + ", n AS (SELECT DISTINCT \"group\" AS g FROM g) SELECT a.g AS from_group, b.g AS to_group FROM n a JOIN n b ON a.g <> b.g WHERE (a.g, b.g) NOT IN (SELECT DISTINCT (x.\"group\", y.\"group\") FROM edges JOIN g x ON x.id = from_file JOIN g y ON y.id = to_file)")
def boundaries_suggest(t):
    return scores.suggest_boundaries(t.edges, _groups(t))


@query(GROUPS + " SELECT x.\"group\" AS from_group, y.\"group\" AS to_group, count(*) AS n FROM edges JOIN g x ON x.id = from_file JOIN g y ON y.id = to_file WHERE x.\"group\" <> y.\"group\" GROUP BY 1, 2")
def cluster_edges(t):
    return scores.cluster_edges(t.edges, _groups(t))


@query(GROUPS + " SELECT \"group\", count(*) AS files, round(sum(pagerank), 6) AS rank, max_by(path, (pagerank, -id)) AS top_file FROM g JOIN files USING (id) GROUP BY 1")
def wiki_clusters(t):
    return t.files.join(_groups(t), "id").groupBy("group").agg(F.count("*").alias("files"), r(F.sum("pagerank")).alias("rank"), F.max_by("path", F.struct("pagerank", -F.col("id"))).alias("top_file"))


@query(", bl AS (SELECT to_file AS id, count(DISTINCT from_file) AS importers FROM edges GROUP BY 1) SELECT id, (pagerank >= 0.05 OR coalesce(importers, 0) >= 10) AND NOT is_exported AS denied FROM files LEFT JOIN bl USING (id)")
def guard_decision(t):
    blast = t.edges.groupBy(F.col("to_file").alias("id")).agg(F.countDistinct("from_file").alias("importers"))
    return scores.guard(t.files, blast, t.files.where("is_exported"))


@query(CLOSURE + """, bl AS (SELECT seed AS id, count(*) AS importers FROM up GROUP BY 1), ak AS (SELECT DISTINCT l_suppkey * 10 + 2 AS id FROM lineitem WHERE l_shipdate <= TIMESTAMP '1995-06-17 12:00:00' AND epoch(TIMESTAMP '1995-06-17 12:00:00' - l_shipdate::TIMESTAMP) < 432000)
    SELECT s_suppkey * 10 + 2 AS id, (1.0::DOUBLE / (s_suppkey + 1) >= 0.05 OR coalesce(importers, 0) >= 10) AND ak.id IS NULL AS denied FROM supplier LEFT JOIN bl ON bl.id = s_suppkey * 10 + 2 LEFT JOIN ak ON ak.id = s_suppkey * 10 + 2""")
def guard_by_blast(t):
    """Suppliers as files: rank, whole blast radius, and acknowledgements that end after five days."""
    files = t.raw("supplier").select((F.col("s_suppkey") * 10 + 2).alias("id"), (F.lit(1.0) / (F.col("s_suppkey") + 1)).alias("pagerank"))
    acks = t.raw("lineitem").select((F.col("l_suppkey") * 10 + 2).alias("id"), F.col("l_shipdate").cast("timestamp").alias("at"))
    return scores.guard(files, components.blast_counts(t.layers), acks, now=F.lit("1995-06-17 12:00:00").cast("timestamp"), ttl=432_000)


@query(", ca AS (SELECT to_symbol_id AS id, count(DISTINCT from_symbol_id) AS n FROM refs GROUP BY 1), x AS (SELECT s.id, complexity, 2 * CAST(s.id IN (SELECT to_symbol_id FROM refs JOIN symbols z ON z.id = from_symbol_id JOIN files f ON f.id = z.file_id WHERE starts_with(f.path, 'tests/')) AS INT) + CAST(NOT s.is_exported AS INT) + CAST(coalesce(n, 0) <= 3 AS INT) AS safety FROM symbols s LEFT JOIN ca ON ca.id = s.id WHERE kind IN ('function', 'method') AND complexity >= 5) SELECT id, CASE WHEN complexity >= 30 THEN 'HIGH' WHEN complexity >= 20 THEN 'MEDIUM' ELSE 'LOW' END AS impact, CASE WHEN safety <= 1 THEN 'RISKY' WHEN safety <= 3 THEN 'OK' ELSE 'SAFE' END AS safety FROM x")
def refactor_plan(t):
    return scores.refactor_plan(t.symbols, t.refs, T.referenced_by_tests(t.symbols, t.refs, t.files), 5)


def _bodies(t):
    return t.raw("documents").select(F.col("doc_id").alias("id"), "text")


WORDS = ", w AS (SELECT doc_id AS id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '') AS w FROM documents)"


@query(WORDS + ", c AS (SELECT id, len(w) AS l, len(list_filter(w, lambda x: x = 'that')) AS t0, len(list_filter(w, lambda x: x = 'with')) AS t1 FROM w), s AS (SELECT count(*) AS n, avg(l) AS m, sum((t0 > 0)::INT) AS d0, sum((t1 > 0)::INT) AS d1 FROM c) SELECT id, round(ln(1 + (n - d0 + 0.5::DOUBLE) / (d0 + 0.5::DOUBLE)) * t0 * 2.2::DOUBLE / (t0 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)) + ln(1 + (n - d1 + 0.5::DOUBLE) / (d1 + 0.5::DOUBLE)) * t1 * 2.2::DOUBLE / (t1 + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)), 6) AS score FROM c, s WHERE t0 > 0 OR t1 > 0 ORDER BY 2 DESC, id LIMIT 20")
def fts_search(t):
    return text_index.top(t.spark, t.text_index, ["that", "with"], 20, 6)


@query(WORDS + " SELECT id FROM w WHERE contains(' ' || array_to_string(w, ' ') || ' ', ' of the ')")
def phrase_search(t):
    return text_index.phrase(t.spark, t.text_index, ["of", "the"]).select("id")


@query(WORDS + ", p AS (SELECT id, list_filter(range(1, len(w)), lambda i: w[i] = 'that' AND w[i + 1] = 'the' AND w[i + 2] = 'the') AS s FROM w) SELECT id, len(s) AS n FROM p WHERE len(s) > 0")
def phrase_counts(t):
    return text_index.phrase(t.spark, t.text_index, ["that", "the", "the"]).withColumn("n", F.col("n").cast("long"))


@query(WORDS + ", u AS (SELECT DISTINCT id, unnest(w) AS term FROM w) SELECT term, count(*) AS df FROM u WHERE starts_with(term, 'wi') GROUP BY 1")
def index_terms(t):
    return text_index.terms_with(t.spark, t.text_index, "wi")


@query(WORDS + ", u AS (SELECT id, unnest(w) AS term FROM w) SELECT term, count(*) AS n, count(DISTINCT id) AS df FROM u GROUP BY 1")
def fts_terms(t):
    return search.postings(_bodies(t)).groupBy("term").agg(F.sum("tf").alias("n"), F.count("*").alias("df"))


@query("SELECT id, name FROM symbols WHERE starts_with(lower(name), 'the') ORDER BY pagerank DESC, id LIMIT 20")
def prefix_search(t):
    return search.prefix_search(t.symbols, "The").select("id", "name")


@query("SELECT name, levenshtein(lower(name), 'thern') AS distance FROM (SELECT DISTINCT name FROM symbols WHERE name <> '') WHERE levenshtein(lower(name), 'thern') <= 3 ORDER BY 2, 1 LIMIT 3")
def did_you_mean(t):
    return search.did_you_mean(t.symbols, "Thern").select("name", F.col("distance").cast("long").alias("distance"))


VEC = ", v AS (SELECT vec_id AS id, embedding::DOUBLE[] AS e FROM embeddings), q AS (SELECT e AS q FROM v WHERE id = 17), k AS (SELECT id, list_dot_product(e, q) / sqrt(list_dot_product(e, e) * list_dot_product(q, q)) AS cosine FROM v, q)"


def _vectors(t):
    v = t.raw("embeddings").select(F.col("vec_id").alias("id"), "embedding")
    return v, v.where("id = 17")


@query(VEC + " SELECT id, round(cosine, 6) AS cosine FROM k ORDER BY round(cosine, 9) DESC, id LIMIT 20")
def vector_topk(t):
    return search.vector_top(*_vectors(t), 20).withColumn("cosine", r("cosine"))


@query(VEC + ", a AS (SELECT id, row_number() OVER (ORDER BY round(cosine, 9) DESC, id) AS rank FROM k ORDER BY 2 LIMIT 60), c AS (SELECT doc_id AS id, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x <> '')) AS l, len(list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda x: x = 'there')) AS tf FROM documents), s AS (SELECT count(*) AS n, avg(l) AS m, sum((tf > 0)::INT) AS df FROM c), h AS (SELECT id, round(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / m)), 6) AS score FROM c, s WHERE tf > 0), b AS (SELECT id, row_number() OVER (ORDER BY score DESC, id) AS rank FROM h ORDER BY 2 LIMIT 60) SELECT id, round(sum(1.0::DOUBLE / (60 + rank)), 9) AS score FROM (FROM a UNION ALL FROM b) GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 20")
def rrf_hybrid(t):
    a = search.ranked(search.vector_top(*_vectors(t), 60), [F.desc(F.round("cosine", 9)), "id"])
    b = text_index.top(t.spark, t.text_index, ["there"], 60, 6)
    return search.rrf([a, search.ranked(b, [F.desc("score"), "id"])], 20).withColumn("score", r("score", 9))


CUSTOM = [("LIC001", "licence", "low", "licence", r"(?i)licensed under [A-Za-z0-9. -]+", None), ("PII001", "mail", "high", "pii", r"[A-Za-z0-9._]+@[A-Za-z0-9.]+", None)]
_SCANNED = [x for x in rules.active_rules(CUSTOM) if x[0] in ("SEC001", "SEC002", "SEC005", "SEC007", "SEC012", "LIC001", "PII001")]


def _scan_sql() -> str:
    parts = []
    for rule, _, severity, category, pattern, _ in _SCANNED:
        p = pattern.replace("'", "''")
        only = " AND is_exported" if rule in rules.EXPORTED_ONLY else ""
        parts.append(f"SELECT doc_id AS id, '{rule}' AS rule, '{severity}' AS severity, '{category}' AS category, round({rules.SEVERITY[severity]} * (1.0::DOUBLE / (doc_id + 1)) * (1 + is_exported::INT), 6) AS risk, len(string_split(regexp_extract(text, '(?s)^(.*?)(?-s:{p})', 1), chr(10))) AS line FROM docs WHERE regexp_matches(text, '{p}'){only}")
    return " " + " UNION ALL ".join(parts)


@query(_scan_sql())
def rule_scan(t):
    bodies = t.files.select("id", "language", "pagerank", "is_exported").join(_bodies(t), "id")
    return rules.scan(bodies, _SCANNED, narrowed=False).select("id", "rule", "severity", "category", r("risk").alias("risk"), F.col("line").cast("long").alias("line"))


@query(", x AS (SELECT r_regionkey * 10 + 4 AS seed, r_regionkey * 10 + 4 AS node, 0 AS depth FROM region UNION SELECT seed, src, depth + 1 FROM x JOIN layers ON dst = node WHERE depth < 20), i AS (SELECT s_suppkey * 10 + 2 AS node FROM supplier WHERE s_acctbal < 0) SELECT seed AS id, min_by(node, (depth, node)) AS source, min(depth) AS distance FROM x WHERE node IN (FROM i) GROUP BY 1")
def taint_path(t):
    findings = t.raw("region").select((F.col("r_regionkey").cast("long") * 10 + 4).alias("id"))
    return rules.taint(t.layers, findings, t.raw("supplier").where("s_acctbal < 0").select((F.col("s_suppkey") * 10 + 2).alias("id"))).drop("path")


@query()
def communities(t):
    layers = settle(t.layers)
    nodes = layers.select(F.col("src").alias("id")).union(layers.select("dst")).distinct()
    return graph.communities(nodes, layers)


@query(", c AS (SELECT DISTINCT id, id % 10 AS cluster FROM (SELECT src AS id FROM layers UNION ALL SELECT dst FROM layers)), e AS (SELECT least(src, dst) AS a, greatest(src, dst) AS b, count(*)::DOUBLE AS w FROM layers GROUP BY 1, 2), s AS (SELECT a, b, w FROM e UNION ALL SELECT b, a, w FROM e), k AS (SELECT a AS id, sum(w) AS k FROM s GROUP BY 1), m AS (SELECT sum(k) AS m FROM k) SELECT round(coalesce(sum((w - x.k * y.k / m) / m), 0), 9) AS modularity FROM s JOIN k x ON x.id = a JOIN k y ON y.id = b JOIN c ca ON ca.id = a JOIN c cb ON cb.id = b, m WHERE ca.cluster = cb.cluster")
def modularity(t):
    nodes = t.layers.select(F.col("src").alias("id")).union(t.layers.select("dst")).distinct()
    return graph.modularity(t.layers, nodes.withColumn("cluster", F.col("id") % 10)).withColumn("modularity", r("modularity", 9))


@query("SELECT coalesce(a.source, b.source) AS path, CASE WHEN a.source IS NULL THEN 'added' WHEN b.source IS NULL THEN 'removed' ELSE 'unchanged' END AS state FROM (SELECT DISTINCT source || lang AS source FROM documents WHERE n_chars > 9000) a FULL JOIN (SELECT DISTINCT source || lang AS source FROM documents WHERE n_chars < 60) b USING (source)")
def path_set_diff(t):
    docs = t.raw("documents").select(F.concat("source", "lang").alias("path"), "n_chars")
    return T.path_diff(docs.where("n_chars > 9000"), docs.where("n_chars < 60"))


@query(", x AS (SELECT doc_id AS id, sum(length(text) // 3) OVER (ORDER BY doc_id ROWS UNBOUNDED PRECEDING) AS spent FROM documents) SELECT id, spent::BIGINT AS spent FROM x WHERE spent <= 20000")
def token_budget_prefix(t):
    return T.token_budget(_bodies(t), "text", ["id"], 20000).select("id", "spent")


@query("SELECT s.id, s.name, path FROM symbols s JOIN files f ON f.id = file_id WHERE regexp_matches(s.name, '(?i)^th.*n$') AND kind IN ('function', 'method') AND starts_with(path, 'src/src3/')")
def find_symbols(t):
    return T.find_symbols(t.symbols, t.files, pattern="^th.*n$", kind="fn", scope="src/src3").select("id", "name", "path")


@query("SELECT id, path FROM files WHERE id NOT IN (SELECT file_id FROM symbols WHERE kind = 'variable')")
def stale_files(t):
    return T.stale_files(t.files, t.symbols.where("kind = 'variable'")).select("id", "path")


@query(f"SELECT {TEST} AS is_test, count(*) AS files, sum(line_count)::BIGINT AS lines, count(DISTINCT source) AS sources FROM files GROUP BY 1")
def stats(t):
    return t.files.groupBy(X.is_test_path(F.col("path")).alias("is_test")).agg(F.count("*").alias("files"), F.sum("line_count").alias("lines"), F.countDistinct("source").alias("sources"))


@query("SELECT id, kind, line_start, row_number() OVER (PARTITION BY kind ORDER BY line_start, id) AS n FROM symbols WHERE file_id = 12")
def outline(t):
    return t.symbols.where("file_id = 12").select("id", "kind", F.col("line_start").cast("long").alias("line_start"), F.row_number().over(W.partitionBy("kind").orderBy("line_start", "id")).cast("long").alias("n"))


@query("SELECT doc_id AS id, array_to_string(list_slice(string_split(text, chr(10)), 2, 4), chr(10)) AS slice FROM documents WHERE len(string_split(text, chr(10))) >= 2")
def read_slice(t):
    rows = _bodies(t).where(F.size(F.split("text", "\n")) >= 2)
    return T.slices(rows, F.lit(2), F.lit(3)).select("id", "slice")


@query("SELECT id, path, round(CASE WHEN source = 'src3' THEN pagerank * 10 ELSE pagerank END, 9) AS rank FROM files ORDER BY CASE WHEN source = 'src3' THEN pagerank * 10 ELSE pagerank END DESC, id LIMIT 40")
def boosted_map(t):
    rank = F.when(F.col("source") == "src3", F.col("pagerank") * 10).otherwise(F.col("pagerank"))
    return T.page(t.files.withColumn("rank", rank), [F.desc("rank"), "id"], 40).select("id", "path", r("rank", 9).alias("rank"))


@query(", b AS (SELECT to_file AS id, count(DISTINCT from_file) AS direct FROM edges GROUP BY 1), o AS (SELECT from_file AS id, count(*) AS imports FROM edges GROUP BY 1) SELECT id, coalesce(direct, 0) AS importers, coalesce(imports, 0) AS imports FROM files LEFT JOIN b USING (id) LEFT JOIN o USING (id)")
def deps(t):
    zero = F.lit(0).cast("long")
    back = t.edges.groupBy(F.col("to_file").alias("id")).agg(F.countDistinct("from_file").alias("importers"))
    out = t.edges.groupBy(F.col("from_file").alias("id")).agg(F.count("*").alias("imports"))
    return t.files.select("id").join(back, "id", "left").join(out, "id", "left").select("id", F.coalesce("importers", zero).alias("importers"), F.coalesce("imports", zero).alias("imports"))


@query(", n AS (SELECT 'caller' AS side, from_symbol_id AS id FROM refs WHERE kind = 'call' AND to_symbol_id = 700000 UNION SELECT 'callee', to_symbol_id FROM refs WHERE kind = 'call' AND from_symbol_id = 700000), o AS (SELECT side, n.id, name, row_number() OVER (PARTITION BY side ORDER BY pagerank DESC, n.id) AS k FROM n JOIN symbols s ON s.id = n.id) SELECT side, id, name FROM o WHERE k <= 5")
def focused_symbol(t):
    return resolve.callers_and_callees(t.refs, t.symbols, 700000)


@query(", nm AS (SELECT id AS ref_id, file_id, owner_type AS owner, name, ['call', 'use', 'type'][pos % 3 + 1] AS kind FROM symbols WHERE name <> ''), c AS (SELECT ref_id, s.id AS sid, CASE WHEN s.file_id = nm.file_id THEN 1 ELSE 0 END AS same, s.owner_type = nm.owner AS own, e.to_file IS NOT NULL AS imp FROM nm JOIN symbols s USING (name) LEFT JOIN edges e ON e.from_file = nm.file_id AND e.to_file = s.file_id WHERE CASE nm.kind WHEN 'call' THEN s.kind IN ('function', 'method', 'class', 'struct') WHEN 'type' THEN s.kind NOT IN ('function', 'method', 'variable') ELSE true END), ti AS (SELECT ref_id, sid, 1 AS tier FROM c WHERE same = 1 AND own UNION ALL SELECT ref_id, sid, 2 FROM c WHERE same = 1 UNION ALL SELECT ref_id, sid, 3 FROM c WHERE imp UNION ALL SELECT ref_id, sid, 4 FROM c), u AS (SELECT ref_id, tier, min(sid) AS sid FROM ti GROUP BY 1, 2 HAVING count(*) = 1) SELECT ref_id, min_by(sid, tier) AS to_symbol_id, min(tier)::INT AS tier FROM u GROUP BY 1")
def resolve_references(t):
    kind = F.element_at(F.array(*map(F.lit, ["call", "use", "type"])), F.col("pos") % 3 + 1)
    names = t.symbols.where("name <> ''").select(F.col("id").alias("ref_id"), "file_id", F.col("owner_type").alias("owner"), "name", kind.alias("kind"))
    return resolve.resolve_references(names, t.symbols, t.edges)


@query("SELECT from_symbol_id, to_symbol_id, kind FROM (SELECT DISTINCT r.from_symbol_id, r.to_symbol_id, r.kind, count(*) OVER (PARTITION BY x.file_id, x.name, x.kind, r.from_symbol_id, r.kind) AS n, x.file_id, x.name, x.kind AS k FROM refs r JOIN symbols x ON x.id = to_symbol_id JOIN files f ON f.id = x.file_id JOIN symbols s ON s.id = from_symbol_id JOIN files g ON g.id = s.file_id WHERE f.source = 'src3' AND g.source <> 'src3') y WHERE (SELECT count(*) FROM symbols z WHERE z.file_id = y.file_id AND z.name = y.name AND z.kind = y.k) = 1")
def restored_references(t):
    changed = t.files.where("source = 'src3'").select("path")
    symbols = t.symbols.select("id", "file_id", "name", "kind")
    return resolve.restore_references(resolve.snapshot_references(t.refs, symbols, t.files, changed), symbols, t.files)


@query("SELECT path, CASE WHEN n_new IS NULL THEN size ELSE n_new END AS size FROM (SELECT source || '/' || lang AS path, sum(n_chars)::BIGINT AS size FROM documents GROUP BY 1) a LEFT JOIN (SELECT source || '/' || lang AS p, max(n_chars) AS n_new FROM documents WHERE n_chars > 5000 GROUP BY 1) b ON p = path")
def upsert(t):
    docs = t.raw("documents").select(F.concat("source", F.lit("/"), "lang").alias("path"), "n_chars")
    old = docs.groupBy("path").agg(F.sum("n_chars").alias("size"))
    new = docs.where("n_chars > 5000").select("path", F.col("n_chars").alias("size"))
    return sinks.upsert(old, new, ["path"], "size")


@query(", gone AS (SELECT id FROM files WHERE source = 'src3') SELECT 'edges' AS name, count(*) AS n FROM edges WHERE from_file NOT IN (FROM gone) AND to_file NOT IN (FROM gone) UNION ALL SELECT 'files', count(*) FROM files WHERE id NOT IN (FROM gone) UNION ALL SELECT 'refs', count(*) FROM refs WHERE from_symbol_id // 100000 NOT IN (FROM gone) AND to_symbol_id // 100000 NOT IN (FROM gone) UNION ALL SELECT 'symbols', count(*) FROM symbols WHERE file_id NOT IN (FROM gone)")
def cascading_delete(t):
    tables = {"edges": t.edges, "files": t.files, "refs": t.refs, "symbols": t.symbols}
    return sinks.row_counts(sinks.delete_files(tables, t.files.where("source = 'src3'")))


@query("SELECT file_id, idx, id, CASE WHEN idx > 0 THEN id - 1 END AS parent_id FROM (SELECT file_id, pos AS idx, row_number() OVER (ORDER BY file_id, pos) AS id FROM symbols)")
def sequential_ids(t):
    rows = t.symbols.select("file_id", F.col("pos").cast("long").alias("idx"), (F.col("pos") - 1).cast("long").alias("parent_idx"))
    return sinks.number_symbols(rows).select("file_id", "idx", F.col("id").cast("long").alias("id"), F.col("parent_id").cast("long").alias("parent_id"))


@query(", l AS (SELECT user_id::VARCHAR AS root, event_type AS path, bool_or(value >= 50) AS changed, max(ts) AS last_seen FROM events GROUP BY 1, 2) SELECT root, path, last_seen FROM l WHERE changed")
def incremental_merge(t):
    events = t.raw("events").select(F.col("user_id").cast("string").alias("root"), F.col("event_type").alias("path"), F.when(F.col("value") >= 50, "changed").otherwise("deleted").alias("op"), F.col("ts").alias("event_time"))
    empty = t.spark.createDataFrame([], "root string, path string, last_seen timestamp")
    return watch.apply_events(empty, events)


@query(f", ch AS (SELECT src AS id FROM layers WHERE src % 10 = 3), up AS (SELECT id AS node, 0 AS d FROM ch UNION SELECT src, 1 FROM up JOIN layers ON dst = node) SELECT node AS id, node IN (SELECT src FROM layers WHERE dst IN (FROM ch)) AS direct FROM (SELECT DISTINCT node FROM up) WHERE node NOT IN (FROM ch)")
def diff_impact(t):
    edges = t.layers.select(F.col("src").alias("from_file"), F.col("dst").alias("to_file"))
    return scores.diff_impact(edges, t.raw("nation").select((F.col("n_nationkey").cast("long") * 10 + 3).alias("id")))


@query(", w AS (SELECT DISTINCT file_id AS node, 0 AS depth FROM refs JOIN symbols ON id = from_symbol_id WHERE to_symbol_id = 900000 UNION SELECT from_file, depth + 1 FROM w JOIN edges ON to_file = node WHERE depth < 3) SELECT node AS file_id, min(depth)::INT AS depth FROM w GROUP BY 1")
def refs_transitive(t):
    return scores.transitive_references(t.refs, t.symbols, t.edges, 900000)


@query("SELECT b.path, count(*) AS importers, array_to_string(list_sort(list_distinct(list(a.language))), ',') AS languages FROM edges JOIN files a ON a.id = from_file JOIN files b ON b.id = to_file GROUP BY 1")
def importer_groups(t):
    return scores.importer_groups(t.edges, t.files)


@query(f", up AS (SELECT from_file AS node FROM edges WHERE to_file = 40 UNION SELECT from_file FROM up JOIN edges ON to_file = node), o AS (SELECT partner FROM pairs2 WHERE id = 40 AND partner <> 40 ORDER BY count DESC, partner LIMIT 10) SELECT CASE WHEN node IN (SELECT from_file FROM edges WHERE to_file = 40) THEN 'direct' ELSE 'transitive' END AS kind, node AS id FROM up JOIN files ON id = node WHERE node <> 40 AND NOT {TEST} UNION ALL SELECT 'partner', partner FROM o")
def impact(t):
    return scores.impact(t.files, t.edges, t.file_pairs, 40)


@query(", up AS (SELECT from_file AS node, 1 AS depth FROM edges WHERE to_file = 60 UNION SELECT from_file, depth + 1 FROM up JOIN edges ON to_file = node WHERE depth < 5) SELECT 60::BIGINT AS id, (SELECT count(*) FROM symbols WHERE file_id = 60) AS symbols, (SELECT count(*) FROM edges WHERE to_file = 60) AS dependents, (SELECT count(DISTINCT node) FROM up WHERE node <> 60) AS transitive")
def focused_file(t):
    back = t.edges.select(F.col("to_file").alias("src"), F.col("from_file").alias("dst"))
    one = t.spark.createDataFrame([(60, 60)], "seed long, node long")
    far = graph.reach(back, one, 5).where("node <> 60").agg(F.count("*").alias("transitive"))
    near = t.edges.where("to_file = 60").agg(F.count("*").alias("dependents"))
    own = t.symbols.where("file_id = 60").agg(F.lit(60).cast("long").alias("id"), F.count("*").alias("symbols"))
    return own.join(F.broadcast(near)).join(F.broadcast(far))  # one row each


@query("SELECT s.id, path, line_start FROM symbols s JOIN files f ON f.id = file_id WHERE s.is_exported AND NOT unused_excluded AND file_id NOT IN (SELECT to_file FROM edges) AND s.id NOT IN (SELECT to_symbol_id FROM refs) ORDER BY path, line_start, s.id LIMIT 30 OFFSET 4")
def unused_page(t):
    rows = T.unused_exports(t.symbols, t.files, t.edges, t.refs)
    return T.page(rows, ["path", "line_start", "id"], 30, 4).select("id", "path", "line_start")


@query("SELECT 'edges.from_file' AS reference, count(*) AS n FROM edges WHERE from_file NOT IN (SELECT id FROM files) UNION ALL SELECT 'edges.to_file', count(*) FROM edges WHERE to_file NOT IN (SELECT id FROM files) UNION ALL SELECT 'refs.from_symbol_id', count(*) FROM refs WHERE from_symbol_id NOT IN (SELECT id FROM symbols) UNION ALL SELECT 'refs.to_symbol_id', count(*) FROM refs WHERE to_symbol_id NOT IN (SELECT id FROM symbols) UNION ALL SELECT 'symbols.file_id', count(*) FROM symbols WHERE file_id NOT IN (SELECT id FROM files)")
def integrity(t):
    return sinks.orphans({"files": t.files, "symbols": t.symbols, "edges": t.edges, "refs": t.refs})


@query(", b AS (SELECT doc_id AS symbol_id, array_to_string(list_slice(string_split(text, chr(10)), 1, 3), chr(10)) AS body, lang FROM documents) SELECT symbol_id, body, 'doc ' || lang || chr(10) || body AS embed_text FROM b")
def symbol_bodies(t):
    docs = t.raw("documents")
    symbols = docs.select(F.col("doc_id").alias("id"), F.col("doc_id").alias("file_id"), F.lit("doc").alias("kind"), F.col("lang").alias("name"), F.lit(1).alias("line_start"), F.lit(3).alias("line_end"))
    return sinks.symbol_bodies(docs.select(F.col("doc_id").alias("file_id"), "text"), symbols)


@query("SELECT vec_id AS id, round(list_sum(list_transform(embedding::DOUBLE[], lambda x: x * x)) ** 0.5, 6) AS norm, round(embedding[1]::DOUBLE / sqrt(list_dot_product(embedding::DOUBLE[], embedding::DOUBLE[])), 6) AS first FROM embeddings")
def normalised_vectors(t):
    norm = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    return t.raw("embeddings").select(F.col("vec_id").alias("id"), r(norm).alias("norm"), r(F.element_at(X.l2_normalised(F.col("embedding")), 1)).alias("first"))


@query("SELECT shape_hash, count(*) AS places FROM bodies b JOIN files f ON f.id = b.file_id WHERE NOT starts_with(path, 'tests/') AND shape_hash IN (SELECT shape_hash FROM bodies WHERE line_end >= 3 GROUP BY 1 HAVING count(*) >= 2) GROUP BY 1 HAVING count(*) >= 2")
def clones_without_tests(t):
    members = scores.without_test_clones(T.clone_members(t.bodies, t.files, T.clone_groups(t.bodies)))
    return members.groupBy("shape_hash").agg(F.count("*").alias("places"))


@query()
def rule_scan_narrowed(t):
    bodies = t.files.select("id", "language", "pagerank", "is_exported").join(_bodies(t), "id")
    return rules.scan(bodies, rules.active_rules(CUSTOM)).select("id", "rule", "severity", "line", "snippet")
