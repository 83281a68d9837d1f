"""Common and modal directories against loops."""

import os
import random

from cairn.operators import directories as D


def test_directories_equal_loops(spark):
    rng = random.Random(4)
    rows = [(g, "/".join(rng.choice("ab") for _ in range(rng.randrange(1, 5))) + ".x") for g in range(60) for _ in range(rng.randrange(1, 5))]
    rows += [(100, "top.rs"), (101, "a/b/c.rs"), (101, "a/bc/c.rs"), (102, "a/b/c.rs")]
    df = spark.createDataFrame(rows, "group long, path string").repartition(4)
    common = {r.group: r.directory for r in D.common_directories(df).collect()}
    modal = {r.group: r.directory for r in D.modal_directories(df).collect()}
    for g in {g for g, _ in rows}:
        own = [p for k, p in rows if k == g]
        assert (common[g] or "") == os.path.commonpath([os.path.dirname(p) for p in own] if all("/" in p for p in own) else [""])
        twos = [p.rsplit("/", len(p.split("/")) - 2)[0] for p in own if p.count("/") >= 2]
        best = min(((-twos.count(d), d) for d in twos), default=None)
        assert modal.get(g) == (best[1] if best and -best[0] * 10 >= len(own) * 3 else None)


def test_labels_stay_apart(spark):
    rows = [(1, "src/a/x.rs", 0.9), (1, "src/a/y.rs", 0.1), (2, "src/a/a.rs", 0.5), (2, "src/a/q.rs", 0.4), (3, "src/a/q.rs", 0.3), (4, "src/a/mod.rs", 0.2), (5, "m.rs", 0.1), (6, "k/lib/mod.rs", 0.05), (6, "r.rs", 0.01)]
    got = {r.group: r.label for r in D.group_labels(spark.createDataFrame(rows, "group long, path string, pagerank double")).collect()}
    assert got == {1: "src/a", 2: "src/a-q", 3: "src/a-3", 4: "src/a-4", 5: "m", 6: "k/lib"}
