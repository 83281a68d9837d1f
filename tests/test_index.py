"""The incremental index against a full ingest, and versions over several checkpoints."""

import datetime as dt
import random

import pytest

from cairn.sources import files as sources, sinks
from cairn.sources.ingest import ingest
from cairn.streaming import index, watch

NOW = dt.datetime(2024, 1, 1)


def text_of(rng, k, paths):
    """A Python file that imports some files and defines and calls a few names that others share."""
    lines = [f"from {p[:-3].replace('/', '.')} import x" for p in rng.sample(paths, min(2, len(paths)))]
    for _ in range(rng.randint(0, 3)):
        name = f"f{rng.randrange(6)}"
        lines += [f"def {name}(a):", *[f"    f{rng.randrange(6)}(a)  # f9(a)" for _ in range(rng.randint(1, 3))], "    return a"]
    if rng.random() < 0.5:
        lines += [f"class C{k}(B{rng.randrange(3)}):", "    def run(self):", f"        return self.run() or f{rng.randrange(6)}(1)"]
    return "\n".join(lines) + "\n"


def named(tables):
    """The tables with paths and places instead of ids."""
    path = {r.id: r.path for r in tables["files"].collect()}
    symbol = {r.id: (path[r.file_id], r.idx) for r in tables["symbols"].collect()}
    out = {"files": sorted((r.path, r.language, r.line_count) for r in tables["files"].collect())}
    out["symbols"] = sorted((*symbol[r.id], r.name, r.kind, r.line_start, r.line_end, str(r.owner_type)) for r in tables["symbols"].collect())
    out["edges"] = sorted((path[r.from_file], path[r.to_file], r.specifier) for r in tables["edges"].collect())
    out["refs"] = sorted((symbol[r.from_symbol_id], symbol[r.to_symbol_id], r.kind) for r in tables["refs"].collect())
    out["sites"] = sorted((path[r.file_id], str(symbol.get(r.from_symbol_id)), r.name, r.line) for r in tables["sites"].collect())
    out["relations"] = sorted((path[r.file_id], r.sub_name, r.super_name, r.kind, r.line) for r in tables["relations"].collect())
    out["imports"] = sorted((r.path, r.written) for r in tables["imports"].collect())
    assert sinks.orphans(tables).where("n > 0").count() == 0
    return out


@pytest.mark.parametrize("seed", [4])
def test_any_edits_equal_a_full_ingest(spark, tmp_path, seed):
    rng = random.Random(seed)
    paths, tree, kept_ids = [f"p{k % 3}/m{k}.py" for k in range(9)], {}, {}
    for turn in range(3):
        events = []
        for k, path in enumerate(paths):
            if turn == 0 and k < 5 or turn and rng.random() < 0.4:
                if path in tree and rng.random() < 0.4:
                    del tree[path]
                    events.append(("r", path, "deleted", NOW))
                else:
                    tree[path] = text_of(rng, k, paths)
                    events += [("r", path, "deleted", NOW)] * rng.randrange(2) + [("r", path, "changed", NOW)]
        events.append(("r", "gone/none.py", "changed", NOW))
        spark.createDataFrame(events, watch.EVENTS).coalesce(1).write.parquet(f"{tmp_path}/in/{turn}")
        texts = spark.createDataFrame([(p, t, "python") for p, t in tree.items()], "path string, text string, language string")
        stream = spark.readStream.schema(watch.EVENTS).parquet(f"{tmp_path}/in/{turn}")
        index.maintain_index(stream, f"{tmp_path}/out", f"{tmp_path}/check{turn}", lambda wanted, texts=texts: texts.join(wanted, "path", "left_semi")).awaitTermination()
        tables = index.load_index(spark, f"{tmp_path}/out")
        assert named(tables) == named(ingest(sources.parse(texts)))
        ids = {r.path: r.id for r in tables["files"].collect()}
        assert all(ids[p] == i for p, i in kept_ids.items() if p in ids)
        kept_ids = ids
    assert watch.versions(spark, f"{tmp_path}/out") == [0, 1, 2]


def test_a_batch_that_runs_twice_is_written_once(spark, tmp_path):
    written = []
    spark.createDataFrame([("r", "a", "changed", NOW)], watch.EVENTS).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(watch.EVENTS).parquet(f"{tmp_path}/in")

    def write(batch, path):
        batch.write.mode("overwrite").parquet(path)
        written.append(path)
        if len(written) == 1:
            raise RuntimeError("lost before the mark")

    with pytest.raises(Exception, match="lost"):
        watch.in_versions(stream, f"{tmp_path}/out", f"{tmp_path}/check", write).awaitTermination()
    assert watch.versions(spark, f"{tmp_path}/out") == []
    seen = []
    for _ in range(2):
        watch.in_versions(stream, f"{tmp_path}/out", f"{tmp_path}/check", write, lambda b, n: seen.append(b.count())).awaitTermination()
    assert len(written) == 2 and seen == [1] and watch.versions(spark, f"{tmp_path}/out") == [0]
    mark = watch.committed(spark, f"{tmp_path}/out")[0][1]
    assert mark == watch.stream_id(spark, f"{tmp_path}/check") + "-0"


def test_clear_content_and_prefix(spark):
    tables = ingest(sources.parse(spark.createDataFrame([("a/x.py", "def f():\n    g()\n", "python"), ("a_/y.py", "def g():\n    f()\n", "python")], "path string, text string, language string")))
    assert tables["refs"].count() == 2
    one = sinks.under_prefix(tables["files"], "a")
    assert [r.path for r in one.collect()] == ["a/x.py"]
    left = sinks.clear_content(tables, one)
    assert left["files"].count() == 2 and [r.name for r in left["symbols"].collect()] == ["g"] and left["refs"].count() == 0 and left["sites"].count() == 1
    none = sinks.delete_files(tables, one)
    assert none["files"].count() == 1 and none["refs"].count() == 0
