"""The stored text index against brute force."""

import math
import random
import re

import pytest

from cairn.operators import text_index as I


@pytest.fixture(scope="module")
def stored(spark, tmp_path_factory):
    rng = random.Random(1)
    common = [f"w{k}" for k in range(8)]
    texts = {k: " ".join(rng.choice(common if rng.random() < 0.8 else [f"rare{rng.randrange(300)}"]) + rng.choice(["", ".", ", x-y"]) for _ in range(rng.randrange(0, 40))) for k in range(0, 3000, 2)}
    texts |= {1: None, 3: "", 5: "...", 7: "W1 w2 W1 w2 w1"}
    folder = str(tmp_path_factory.mktemp("index"))
    cell, I.CELL = I.CELL, 64
    I.build(spark.createDataFrame(list(texts.items()), "id long, text string").repartition(5), folder)
    I.CELL = cell
    return folder, {k: [w for w in re.split("[^a-z0-9]+", (t or "").lower()) if w] for k, t in texts.items()}


def brute(words, terms, limit):
    mean = sum(map(len, words.values())) / len(words)
    df = {t: sum(t in w for w in words.values()) for t in set(terms)}
    score = {}
    for k, w in words.items():
        if any(t in w for t in df):
            score[k] = round(sum(math.log(1 + (len(words) - d + 0.5) / (d + 0.5)) * w.count(t) * 2.2 / (w.count(t) + 1.2 * (0.25 + 0.75 * len(w) / mean)) for t, d in df.items()), 9)
    return sorted(score.items(), key=lambda x: (-x[1], x[0]))[:limit]


@pytest.mark.parametrize("terms,limit", [(["w1"], 5), (["rare7", "w2", "w2"], 10), (["rare1", "rare2", "rare3"], 7), (["none"], 3), (["none", "w3"], 2000), ([], 4)])
def test_top_equals_brute_force(spark, stored, terms, limit):
    folder, words = stored
    got = [(r.id, r.score) for r in I.top(spark, folder, terms, limit).collect()]
    want = brute(words, terms, limit)
    assert [g[0] for g in got] == [w[0] for w in want] and all(math.isclose(g[1], w[1], abs_tol=2e-9) for g, w in zip(got, want, strict=True))


@pytest.mark.parametrize("phrase", [["w1"], ["w1", "w2"], ["w1", "w2", "w1"], ["x", "y", "w3"], ["w1", "none"], ["w5", "w5"], []])
def test_phrases_equal_brute_force(spark, stored, phrase):
    folder, words = stored
    want = {k: n for k, w in words.items() if phrase and (n := sum(w[i : i + len(phrase)] == phrase for i in range(len(w))))}
    assert {r.id: r.n for r in I.phrase(spark, folder, phrase).collect()} == want


def test_terms_and_pruning(spark, stored, capsys):
    folder, words = stored
    want = {}
    for w in words.values():
        for t in {x for x in w if x.startswith("rare1")}:
            want[t] = want.get(t, 0) + 1
    assert {r.term: r.df for r in I.terms_with(spark, folder, "rare1").collect()} == want
    I.phrase(spark, folder, ["w1", "rare7"]).explain("formatted")
    plan = capsys.readouterr().out
    assert "EqualTo(term,w1)" in plan and "EqualTo(term,rare7)" in plan
    # Far from all cells are read for a rare term: its bounds rule the others out.
    cells = spark.read.parquet(f"{folder}/cells")
    assert cells.where("term = 'rare7'").count() < cells.select("cell").distinct().count()


def test_postings_move_once(spark, tmp_path, monkeypatch):
    """Between the texts and the stored postings lies one exchange, that of the sort by terms."""
    from pyspark.sql.readwriter import DataFrameWriter

    plans, write = {}, DataFrameWriter.parquet

    def parquet(self, path, *more, **named):
        plans[path.rpartition("/")[2]] = self._df._jdf.queryExecution().optimizedPlan().toString()
        return write(self, path, *more, **named)

    monkeypatch.setattr(DataFrameWriter, "parquet", parquet)
    I.build(spark.createDataFrame([(1, "a b a"), (2, None)], "id long, text string"), str(tmp_path / "index"))
    plan = plans["postings"]
    assert "Join" not in plan and "Aggregate" not in plan and plan.count("Repartition") == 1
    assert [tuple(r) for r in spark.read.parquet(f"{tmp_path}/index/postings").select("term", "tf", "length", "positions").orderBy("term").collect()] == [("a", 2, 3, [0, 2]), ("b", 1, 3, [1])]
