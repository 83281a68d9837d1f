"""What tests cover without importing it, on literal files."""

import os

import pandas as pd
import pytest

from pyspark.sql import functions as F

import __spark_entry__
from cairn.operators import mentions, scores
from tests import compare

FILES = [
    (1, "src/io/cli_runner.rs", "rust"), (2, "src/cli.rs", "rust"), (3, "src/io/mod.rs", "rust"), (4, "src/find.rs", "rust"), (5, "src/own.rs", "rust"), (6, "src/alone.rs", "rust"),
    (7, "tests/a.rs", "rust"), (8, "tests/b.rs", "rust"), (9, "src/9x.rs", "rust"), (10, "src/find.py", "python"), (11, "src/plain.rs", "rust"), (12, "tests/none.rs", "rust"), (13, "run.sh", "shell"),
]
TEXTS = [
    (1, "fn run() {}"), (2, "alone alone"), (5, "fn x() {}\n#[actix_rt::test]\nasync fn y() {}"), (6, "let v = vec![mod::test];"), (7, "use demo::CLI_Runner::run; mod io; 9x"),
    (8, 'call_tool_by_name( "Ns_Find", x); call_tool_by_name("plain")'), (12, None),
]


@pytest.fixture
def files(spark):
    rows = [(i, p, lang, 0.5 if i < 10 else 0.1, 0) for i, p, lang in FILES]
    return spark.createDataFrame(rows, "id long, path string, language string, pagerank double, change_count long")


@pytest.fixture
def texts(spark):
    return spark.createDataFrame(TEXTS, "id long, text string")


def test_mentioned_names(files, texts):
    # cli_runner stands as two words in a row, cli as the first of them; find and plain are words of the test that calls them.
    assert sorted(r.id for r in mentions.mentioned(files, texts).collect()) == [1, 2, 4, 11]
    assert mentions.mentioned(files, texts.limit(0)).count() == 0 and mentions.mentioned(files.where("id = 3"), texts).count() == 0


def test_dispatched_and_inline(files, texts):
    assert sorted(map(tuple, mentions.dispatched(files, texts.union(texts)).collect())) == [(8, 4), (8, 10), (8, 11)]
    assert [r.id for r in mentions.inline_tested(files, texts).collect()] == [5]


def test_map_gaps_and_suggestions(spark, files, texts):
    edges = spark.createDataFrame([(7, 3), (7, 3), (8, 4), (6, 9), (7, 8)], "from_file long, to_file long")
    pairs = mentions.coverage(files, edges, texts)
    assert sorted(map(tuple, mentions.coverage_map(pairs, files).collect())) == [("src/find.py", 1, "tests/b.rs"), ("src/find.rs", 1, "tests/b.rs"), ("src/io/mod.rs", 1, "tests/a.rs"), ("src/plain.rs", 1, "tests/b.rs")]
    assert sorted(map(tuple, mentions.coverage_map(pairs, files, "test").collect())) == [("tests/a.rs", 1, "src/io/mod.rs"), ("tests/b.rs", 3, "src/find.py")]
    symbols = spark.createDataFrame([(1, 6, 12)], "id long, file_id long, complexity int")
    gaps = lambda **more: {r.path for r in mentions.gaps(files, symbols, edges, texts, ["rust", "python"], **more).collect()}
    assert gaps() == {"src/alone.rs", "src/9x.rs", "src/find.py"} and gaps(min_rank=0.4) == {"src/alone.rs", "src/9x.rs"} and gaps(scope="src/alone.rs") == {"src/alone.rs"}
    changed = spark.createDataFrame([(3,), (5,), (6,), (9,), (12,), (13,)], "id long")
    partners = spark.createDataFrame([(7, 9, 4)], "file_a long, file_b long, count long")
    got = sorted(map(tuple, mentions.suggest(files, edges, partners, texts, changed, ["rust"]).collect()))
    assert got == [("run", 7, 2), ("run", 12, 1), ("untested", 6, 0)]


def test_guard_forgets_acknowledgements(spark):
    files = spark.createDataFrame([(i, 0.5 if i < 6 else 0.001) for i in range(1, 9)], "id long, pagerank double")
    blast = spark.createDataFrame([(7, 10), (8, 9)], "id long, importers long")
    times = [(1, "2024-01-01 00:00:00"), (1, "2024-01-01 00:09:59"), (2, "2024-01-01 00:00:01"), (3, "2024-01-01 00:00:00"), (4, "2024-01-01 00:10:01"), (5, None)]
    acks = spark.createDataFrame(times, "id long, at string").withColumn("at", F.col("at").cast("timestamp"))
    denied = lambda **more: {r.id for r in scores.guard(files, blast, acks, now=F.lit("2024-01-01 00:10:00").cast("timestamp"), **more).collect() if r.denied}
    assert denied() == {3, 4, 5, 7} and denied(ttl=0) == {1, 2, 3, 4, 5, 7} and denied(ttl=601) == {4, 5, 7}


def test_named_files_follow_their_own_side(spark, tmp_path, monkeypatch):
    """A source whose words look like a test's name stays a source, and a number is no key of a dispatcher, as in the SQL."""
    for name in os.listdir(compare.FOLDER):
        if name.split(".")[0] not in ("documents", "labels"):
            os.symlink(f"{compare.FOLDER}/{name}", tmp_path / name)
    texts = [(0, "tests here", "en"), (1, "some test of it", "en"), (2, "1 and", "fr"), (3, "1", "en"), (4, "some test", "fr"), (6, "test it", "en"), (7, "a tests.", "en"), (8, "test it", "fr"), (9, "and", "en")]
    rows = [(i, x, lang, "src3", len(x)) for i, x, lang in texts]
    pd.DataFrame(rows, columns=["doc_id", "text", "lang", "source", "n_chars"]).to_parquet(tmp_path / "documents.parquet", index=False)
    pd.DataFrame([(0, 1, 0)], columns=["doc_id", "quality", "toxic"]).to_parquet(tmp_path / "labels.parquet", index=False)
    monkeypatch.setattr(compare, "FOLDER", str(tmp_path))
    for name in ("module_mentions", "coverage_both_ways", "gaps_by_mentions", "suggest_with_untested"):
        compare.assert_same(spark, __spark_entry__.queries()[name], __spark_entry__.oracle_sql()[name])
