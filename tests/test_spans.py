"""Containment joins against brute force."""

import random

import pytest
from pyspark.sql import functions as F

from cairn.functions.session import TASK_ROWS, dealt
from cairn.operators import history, tables as T


def spans_of(seed, n=200):
    rng = random.Random(seed)
    out = []
    for k in range(n):
        start = rng.randrange(0, 100)
        out.append((rng.randrange(3), k, start, start + rng.choice([0, 1, 5, 40, 300])))
    out += [(0, 1000 + k, k, 400 - k) for k in range(150)] + [(1, 2000 + k, 10, 20) for k in range(5)] + [(2, 3000, 9, 8)]  # nested, tied and empty
    return out


@pytest.mark.parametrize("seed", range(3))
def test_containing_and_innermost(spark, seed):
    spans = spans_of(seed)
    rng = random.Random(seed)
    points = [(rng.randrange(4), rng.randrange(-3, 450), k) for k in range(300)]
    sf = spark.createDataFrame([*spans, (None, 1, 0, 9)], "key long, id long, start long, end long")
    pf = spark.createDataFrame([*points, (None, 5, 1), (0, None, 1)], "key long, at long, tag long")
    got = sorted((r.key, r["at"], r.id) for r in T.containing(pf, sf, "key").collect())
    assert got == sorted({(k, at, i) for k, at, _ in points for kk, i, a, z in spans if kk == k and a <= at <= z})
    inner = {tuple(r) for r in T.innermost(pf, sf, "key").collect()}
    best = {(k, at, tag): max(((a, i) for kk, i, a, z in spans if kk == k and a <= at <= z), default=None) for k, at, tag in points}
    assert inner == {(*p, b[1]) for p, b in best.items() if b}
    assert T.innermost(pf, sf.limit(0), "key").count() == 0 and T.containing(pf.limit(0), sf, "key").count() == 0


def test_deep_nesting_stays_small(spark):
    """A hundred thousand spans around as many points make ten thousand million pairs; the join sees some rows a point."""
    n = 100_000
    spans = spark.range(n).selectExpr("1 AS key", "id", "id AS start", f"{2 * n} - id AS end")
    points = spark.range(n).selectExpr("1 AS key", "id AS at")
    assert T.innermost(points, spans, "key").where("span_id <> at").count() == 0


def test_blame_of_overlaps(spark):
    rng = random.Random(2)
    hunks = [(rng.randrange(3), f"a{rng.randrange(4)}", rng.randrange(1, 60), rng.randrange(0, 30)) for _ in range(120)] + [(0, "a0", 5, 10)] * 2
    spans = [(p, i, a, z) for p, i, a, z in spans_of(5, 60) if i < 1000] + [(0, 900, 5, 14)]
    got = {(r.id, r.author): (r.lines, round(r.share, 6)) for r in history.blame_of_span(spark.createDataFrame(hunks, "path long, author string, line_start int, line_count int"), spark.createDataFrame(spans, "path long, id long, start int, end int")).collect()}
    want = {}
    for p, author, at, n in hunks:
        for q, i, a, z in spans:
            if p == q and (over := min(at + n - 1, z) - max(at, a) + 1) > 0:
                want[i, author] = want.get((i, author), 0) + over
    total = {}
    for (i, _), lines in want.items():
        total[i] = total.get(i, 0) + lines
    assert got == {k: (v, round(v * 100 / total[k[0]], 6)) for k, v in want.items()}


def test_running_total(spark):
    rng = random.Random(1)
    rows = [(k, rng.randrange(10)) for k in rng.sample(range(10_000), 1500)]
    got = {r.k: r.total for r in T.running_total(spark.createDataFrame(rows, "k long, n long").repartition(7), ["k"], F.col("n"), "total").collect()}
    want, total = {}, 0
    for k, n in sorted(rows):
        total += n
        want[k] = total
    assert got == want


def test_rows_that_are_dealt_give_the_same(spark):
    """As many tasks as the rows ask for, however few bytes a shuffle makes of them."""
    assert dealt(spark.range(10), 10 * TASK_ROWS, "id").rdd.getNumPartitions() == 10 and dealt(spark.range(10), 3 * TASK_ROWS + 1, "id").rdd.getNumPartitions() == 4
    rng = random.Random(5)
    hunks = spark.createDataFrame([(rng.randrange(4), rng.choice("abc"), rng.randrange(60), rng.randrange(30)) for _ in range(200)], "path long, author string, line_start int, line_count int")
    spans = spark.createDataFrame([(k % 4, k, 5 * k, 5 * k + 12) for k in range(12)], "path long, id long, start int, end int")
    plain, many = (sorted(map(tuple, history.blame_of_span(hunks, spans, rows).collect())) for rows in (None, 3 * TASK_ROWS))
    assert plain == many and plain
    commits = spark.createDataFrame([(rng.randrange(30), rng.randrange(12)) for _ in range(300)], "commit_id long, file long")
    plain, many = (sorted(map(tuple, history.co_change_pairs(commits, n_rows=rows).collect())) for rows in (None, 3 * TASK_ROWS))
    assert plain == many and plain
