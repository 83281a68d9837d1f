"""Table, history, score, rule, source, sink and streaming operators on small literals."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from cairn.functions import scalar as X
from cairn.operators import history, resolve, rules, scores, search, tables as T
from cairn.sources import files, sinks
from cairn.streaming import watch

FILE = "id long, path string, language string, pagerank double, change_count long"
SYMBOL = "id long, file_id long, name string, kind string, line_start int, line_end int, signature string, is_exported boolean, unused_excluded boolean, pagerank double, complexity int, owner_type string, shape_hash string"


def symbol(i, f, name, kind="function", start=1, end=5, sig="", exported=True, cc=None, owner=None, shape=None):
    return (i, f, name, kind, start, end, sig, exported, False, 1.0 / i, cc, owner, shape)


@pytest.fixture
def small(spark):
    fs = spark.createDataFrame([(1, "src/a.rs", "rust", 0.5, 4), (2, "src/b.rs", "rust", 0.3, 0), (3, "tests/t.rs", "rust", 0.1, 1), (4, "conf/x.yaml", "yaml", 0.1, 9)], FILE)
    ss = spark.createDataFrame([symbol(1, 1, "Alpha", "struct", shape="h"), symbol(2, 1, "run", cc=20, end=80), symbol(3, 2, "run", shape="h"), symbol(4, 3, "check", shape="h"), symbol(5, 4, "key", "data"), symbol(6, 2, "alpha_two", "method", sig="(&self)", owner="B")], SYMBOL)
    edges = spark.createDataFrame([(3, 1), (2, 1)], "from_file long, to_file long")
    refs = spark.createDataFrame([(4, 2, "call"), (3, 2, "call"), (3, 2, "use")], "from_symbol_id long, to_symbol_id long, kind string")
    return fs, ss, edges, refs


def ids(df, column="id"):
    return sorted(r[column] for r in df.collect())


def test_lookups_and_joins(small):
    fs, ss, edges, refs = small
    assert ids(T.find_symbols(ss, fs, pattern="^alpha", scope="src")) == [1, 6] and ids(T.find_symbols(ss, fs, kind="fn")) == [2, 3, 4, 6]
    assert ids(T.unused_exports(ss, fs, edges, refs)) == [3, 4, 6]
    assert ids(T.referenced_by_tests(ss, refs, fs)) == [2]
    assert {(r.target, r.from_symbol_id) for r in T.references_of(refs, ss, fs, ss.where("id = 2")).collect()} == {(2, 3), (2, 4)}
    groups = T.clone_groups(ss)
    assert groups.first().places == 3 and T.clone_members(ss, fs, groups).count() == 3
    assert ids(T.stale_files(fs, ss.where("file_id <> 4"))) == [4]
    with pytest.raises(ValueError):
        T.clone_groups(ss, 0)
    assert T.clamp_limit(0, 5, 9) == 5 and T.clamp_limit(7, 5, 9) == 7


def test_predicates(spark):
    paths = ["tests/a.py", "src/test_x.py", "src/x_test.go", "src/FooTest.java", "src/a.spec.ts", "src/contest.py", "src/tests.rs", "a/spec/b.rb"]
    got = [r[0] for r in spark.createDataFrame([(p,) for p in paths], "p string").select(X.is_test_path(F.col("p"))).collect()]
    assert got == [True, True, True, True, True, False, True, True]
    assert X.parameter_count("fn f(&mut self, a: Map<K, V>, (b, c): (u8, u8))") == 2 and X.parameter_count("f()") == 0 and X.parameter_count(None) == 0
    assert X.match_arms('a => 1, // =>\n"=>" b => 2') == 2
    assert X.glob_regex("src/**/*.rs") == r"^src/(?:.*/)?[^/]*\.rs$"
    assert [X.fts_query(q) for q in ("foo", "foo*", "AND", "a b", 'x"y', " ")] == ["foo", "foo*", '"AND"', '"a b"', '"x""y"', '""']
    row = spark.createDataFrame([("x Foo été Foobar", [3.0, 4.0], [0.0, 0.0], "a::HttpServer<T>")], "t string, v array<double>, z array<double>, o string")
    got = row.select(X.replace_word(F.col("t"), "Foo", "Bar"), X.l2_normalised(F.col("v")), X.l2_normalised(F.col("z")), X.is_service_like(F.col("o"))).first()
    assert tuple(got) == ("x Bar été Foobar", [0.6, 0.8], [0.0, 0.0], True)


def test_history(spark):
    commits = spark.createDataFrame([("x", "a"), ("x", "b"), ("x", "c"), ("y", "a"), ("y", "b"), ("z", "a"), *[("big", str(k)) for k in range(21)]], "commit_id string, file string")
    assert {tuple(r) for r in history.co_change_pairs(commits).collect()} == {("a", "b", 2), ("a", "c", 1), ("b", "c", 1)}
    lines = spark.createDataFrame([("f", "p", 5), ("f", "q", 3), ("f", "r", 2), ("g", "p", 1)], "file string, author string, lines long")
    assert {r.file: (r.authors, r.bus_factor) for r in history.bus_factor(lines, "file").collect()} == {"f": (3, 1), "g": (1, 1)}
    points = spark.createDataFrame([("s", 1, 10.0), ("s", 2, 8.0), ("s", 3, 12.0), ("one", 1, 1.0), ("zero", 1, 0.0), ("zero", 2, 4.0)], "series string, seq int, value double")
    assert {r.series: (round(r.delta, 6), r.direction) for r in history.trend(points).collect()} == {"s": (20.0, "GROWING"), "zero": (0.0, "STABLE")}
    assert [r.marker for r in history.markers(points).where("series = 's'").orderBy("seq").collect()] == ["", "(-)", "(+)"]
    log = spark.createDataFrame([("l", 0, "commit c1"), ("l", 1, "a.py"), ("l", 2, "commit c2 p q"), ("l", 3, "b.py"), ("l", 4, "x/.hidden")], "log string, seq int, line string")
    assert sorted((r.commit_id, r.parent_count, r.path) for r in files.commit_log(log).collect()) == [("c1", 0, "a.py"), ("c2", 2, "b.py")]


def test_scores(small, spark):
    fs, ss, edges, refs = small
    hot = scores.hotspots(fs, ss).collect()
    assert [(r.path, r.score) for r in hot] == [("src/a.rs", 50.0)] and hot[0].health == pytest.approx((10 / 3 + 10 / 26 + 10 / 1.5) / 3)
    assert ids(scores.god_functions(ss)) == [2]
    with pytest.raises(ValueError):
        scores.hotspots(fs, ss, threshold=0)
    assert {r.severity for r in scores.health_report(fs, ss, scores.god_functions(ss)).collect()} == {"1 Critical"}
    assert [r.source for r in scores.test_map(fs, edges).collect()] == ["src/a.rs"] and [r.path for r in scores.test_gaps(fs, ss, edges, X.TESTABLE_LANGUAGES).collect()] == ["src/b.rs"]
    risk = {r.id: r.risk for r in scores.change_risk(fs, ss, fs.where("id < 3"), edges, spark.createDataFrame([(2, 5)], "id long, violations long")).collect()}
    assert risk[2] == pytest.approx(10 - (10 + 10 / 16 + 10) / 3 + 1.5 + 1.5)
    got = scores.boundary_violations(edges, fs, files.boundary_rules('[[boundary]]\nfrom = "tests/**"\ndeny = "src/**"\nallow = ["src/b.rs"]')).collect()
    assert [tuple(r) for r in got] == [(0, "tests/t.rs", "src/a.rs")]
    envy = [symbol(1, 1, "m", "method", sig="(self)", owner="A"), *[symbol(k, 1, f"x{k}", "method", sig="(self)", owner="B") for k in (2, 3)], symbol(4, 1, "y", "method", sig="(self)", owner="A")]
    calls = spark.createDataFrame([(1, 2, "call"), (1, 3, "call"), (1, 4, "call")], refs.schema)
    assert [tuple(r) for r in scores.feature_envy(spark.createDataFrame(envy, SYMBOL), calls).collect()] == [(1, "B", 2, 1, 2.0)]


def test_rules_and_search(spark):
    bodies = spark.createDataFrame([(1, "python", 0.5, True, 'x\n  token = "abcdef"\n'), (2, "rust", 0.1, False, "unsafe { a.unwrap() }"), (3, "go", 0.1, True, "nothing")], "id long, language string, pagerank double, is_exported boolean, text string")
    got = {(r.id, r.rule): (r.line, r.snippet, r.risk) for r in rules.scan(bodies, rules.active_rules()).collect()}
    assert got == {(1, "SEC001"): (2, 'token = "abcdef"', 8.0), (2, "SEC008"): (1, "unsafe { a.unwrap() }", pytest.approx(0.2))}
    custom, off = files.scan_rules('disable = ["SEC001"]\n[[rule]]\nid = "C1"\npattern = "noth"\nseverity = "High"')
    assert {(r.id, r.rule) for r in rules.scan(bodies, rules.active_rules(custom, off), "medium").collect()} == {(2, "SEC008"), (3, "C1")}
    benign = ['token = "${TOKEN}"', 'secret = "os.environ[1]"', "http://localhost/x http://a/b xmlns=\"http://x.org/y\"", 'Command::new("git")', 'Command::new("/bin/sh")', "http://evil.org", 'token = "hunter22"']
    texts = spark.createDataFrame([(k, "go", 0.1, True, t) for k, t in enumerate(benign)], bodies.schema)
    assert sorted((r.id, r.rule) for r in rules.scan(texts, rules.active_rules()).collect()) == [(4, "SEC004"), (5, "SEC007"), (6, "SEC001")]
    docs = spark.createDataFrame([(1, "the cat sat"), (2, "The dog. the-cat ran"), (3, None)], "id long, text string")
    assert [r.id for r in search.bm25(docs, ["cat"], 5).collect()] == [1, 2] and ids(search.phrase_search(docs, ["the", "cat"])) == [1, 2]
    lists = [spark.createDataFrame(x, "id long, rank int") for x in ([(1, 1), (2, 2)], [(2, 1), (3, 2)])]
    assert [r.id for r in search.rrf(lists, 9).collect()] == [2, 1, 3]


def test_resolution_tiers(spark):
    ss = spark.createDataFrame([symbol(1, 1, "a", owner="S", kind="method"), symbol(2, 1, "a"), symbol(3, 2, "b"), symbol(4, 3, "b"), symbol(5, 3, "c"), symbol(6, 3, "T", "struct"), symbol(7, 2, "d"), symbol(8, 3, "d")], SYMBOL)
    edges = spark.createDataFrame([(1, 2)], "from_file long, to_file long")
    names = spark.createDataFrame([(1, 1, "S", "a", "call"), (2, 1, None, "b", "call"), (3, 1, None, "c", "call"), (4, 1, None, "c", "type"), (5, 1, None, "T", "type"), (6, 4, None, "d", "call")], "ref_id long, file_id long, owner string, name string, kind string")
    got = {r.ref_id: (r.to_symbol_id, r.tier) for r in resolve.resolve_references(names, ss, edges).collect()}
    assert got == {1: (1, 1), 2: (3, 3), 3: (5, 4), 5: (6, 4)}


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "src").mkdir()
    (tmp_path / "src/a.py").write_text("import os\nclass A:\n    def f(self, x):\n        if x:\n            return 1\n\ndef _g():\n    pass\n")
    (tmp_path / ".git").mkdir()
    (tmp_path / ".git/b.py").write_text("def no(): pass")
    found = files.walk(spark, str(tmp_path))
    assert [r.language for r in found.collect()] == ["python"]
    row = files.parse(found).first()
    assert row.imports == ["os"] and row.line_count == 8
    assert [(s.name, s.kind, s.line_start, s.line_end, s.owner_type, s.complexity) for s in row.symbols] == [("A", "class", 2, 5, None, None), ("f", "method", 3, 5, "A", 2), ("_g", "function", 7, 8, None, 1)]
    assert files.changed_files(found, found).count() == 0
    old = spark.createDataFrame([(1, "a", 1), (2, "b", 1)], "id long, path string, mtime_ns long")
    new = spark.createDataFrame([(0, "b", 2), (0, "c", 2)], "id long, path string, mtime_ns long")
    assert sorted((r.path, r.id, r.mtime_ns) for r in sinks.upsert_files(old, new).collect()) == [("a", 1, 1), ("b", 2, 2), ("c", 3, 2)]
    rows = spark.createDataFrame([(7, 0, None), (7, 1, 0), (7, 2, 5), (9, 0, 0)], "file_id long, idx long, parent_idx long")
    assert sorted((r.id, r.parent_id) for r in sinks.number_symbols(rows).collect()) == sorted([(1, None), (2, 1), (3, None), (4, None)], key=lambda x: x[0])
    assert sinks.fingerprint(old.withColumn("size_bytes", F.lit(1))).first() == sinks.fingerprint(old.orderBy(F.desc("id")).withColumn("size_bytes", F.lit(1))).first()


def test_streaming_matches_a_batch(spark, tmp_path):
    now = dt.datetime(2024, 1, 1)
    rows = [("r", "a", "changed", now), ("r", "b", "changed", now), ("r", "b", "deleted", now), ("q", "c", "deleted", now)]
    later = [("r", "a", "deleted", now), ("q", "c", "changed", now)]
    for k, part in enumerate((rows, later)):
        spark.createDataFrame(part, watch.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{k}")
    seen = []
    for k in range(2):
        stream = spark.readStream.schema(watch.EVENTS).parquet(f"{tmp_path}/in/{k}")
        watch.maintain(stream, f"{tmp_path}/out", f"{tmp_path}/check{k}", lambda s, c, n: seen.append(c.count())).awaitTermination()
        if k == 0:
            first = watch.load_snapshot(spark, f"{tmp_path}/out")
            assert sorted((r.root, r.path) for r in first.collect()) == [("r", "a"), ("r", "b")]
    second = watch.load_snapshot(spark, f"{tmp_path}/out")
    assert sorted((r.root, r.path) for r in second.collect()) == [("q", "c"), ("r", "b")] and watch.versions(spark, f"{tmp_path}/out") == [0, 1]
    batch = watch.apply_events(watch.apply_events(first.limit(0), spark.createDataFrame(rows, watch.EVENTS)), spark.createDataFrame(later, watch.EVENTS))
    assert sorted((r.root, r.path) for r in batch.collect()) == [("q", "c"), ("r", "b")] and seen == [3, 2]
    due = watch.Cadence()
    assert [due.due(t) for t in (0, 1, 29, 31)] == [True, False, False, True]


def test_texts_without_what_a_rule_holds_go_through_no_pattern(spark):
    texts = ['key = "abc"\napi_key = "abcdef"', 'x format!("SELECT * FROM t', 'f"delete from t', "Api print!(x) console.log(y)", "a ../b", 'xmlns="http://a.example.org/x"\nsee http://b.example.org/y',
             'xmlns:y="http://a.example.org/x"', "-----BEGIN RSA PRIVATE KEY-----", "dbg!(1)", "plain words", None, "http://localhost/x http://c.example.org"]
    bodies = spark.createDataFrame([(i, "rust", 0.5, True, t) for i, t in enumerate(texts)], "id long, language string, pagerank double, is_exported boolean, text string")
    found = rules.scan(bodies, rules.active_rules())
    assert sorted((r.id, r.rule, r.line) for r in found.collect()) == [(0, "SEC001", 2), (1, "SEC003", 1), (2, "SEC003", 1), (3, "SEC012", 1), (4, "SEC005", 1), (5, "SEC007", 2), (7, "SEC002", 1), (8, "SEC012", 1), (11, "SEC007", 1)]
    # A pattern that begins by looking behind does so at each character.
    assert set(rules.HOLDS) == {"SEC001", "SEC002", "SEC003", "SEC005", "SEC007", "SEC012"} and not any(p.startswith("(?<") for p in rules.NARROWED.values())
