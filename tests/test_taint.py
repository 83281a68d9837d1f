"""Paths from inputs to findings, against a walk from each finding."""

import random

from cairn.operators import rules


def nearest(pairs, seed, inputs, most):
    """(input, distance, path) by levels; each node's next is the least of the level before."""
    level, after, seen = [seed], {}, {seed}
    for depth in range(most + 1):
        if hit := sorted(set(level) & inputs):
            path = [hit[0]]
            while path[-1] != seed:
                path.append(after[path[-1]])
            return hit[0], depth, path
        new = {}
        for v in sorted(level, reverse=True):
            new |= {a: v for a, b in pairs if b == v and a not in seen}
        after |= new
        seen |= set(new)
        level = list(new)
    return None


def test_paths_against_a_walk(spark):
    rng = random.Random(4)
    pairs = [(rng.randrange(60), rng.randrange(60)) for _ in range(130)]
    inputs, seeds = {2, 11, 30, 31, 47}, [5, 5, 7, 11, 20, 33, 58]
    edges = spark.createDataFrame([*pairs, pairs[0]], "src long, dst long")
    ids = lambda x: spark.createDataFrame([(i,) for i in x], "id long")
    for most, least in ((6, 5), (2, 2)):
        got = {r.id: (r.source, r.distance, r.path) for r in rules.taint(edges, ids(seeds), ids(inputs), most).collect()}
        want = {s: nearest(pairs, s, inputs, most) for s in seeds}
        assert got == {s: w for s, w in want.items() if w} and len(got) >= least


def test_names_of_the_path(spark):
    findings = spark.createDataFrame([(3, "SEC003", "injection"), (3, "SEC001", "secret"), (9, "X1", "Deserialization"), (1, "SEC010", "eval"), (8, "SEC004", "exec")], "id long, rule string, category string")
    symbols = spark.createDataFrame([(1, "read_request", None), (3, "run", None), (9, "load", None)], "id long, name string, signature string")
    refs = spark.createDataFrame([(1, 2), (2, 3), (3, 9), (9, 3)], "from_symbol_id long, to_symbol_id long")
    got = {(r.id, r.rule): (r.source_name, r.distance, r.path) for r in rules.annotated(findings, symbols, refs).collect()}
    assert got == {
        (3, "SEC003"): ("read_request", 2, ["read_request", "#2", "run"]), (3, "SEC001"): (None, None, None), (9, "X1"): ("read_request", 3, ["read_request", "#2", "run", "load"]),
        (1, "SEC010"): ("read_request", 0, ["read_request"]), (8, "SEC004"): (None, None, None),
    }
