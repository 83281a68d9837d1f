"""SimHash: fingerprints and links against brute force."""

import random

import numpy as np
import xxhash

from cairn.llm import simhash


def brute_fingerprint(text):
    words = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "").encode().split()
    if not words:
        return 0
    k = min(3, len(words))
    hs = [xxhash.xxh64_intdigest(b" ".join(words[i : i + k]), 42) for i in range(len(words) - k + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(nodes, linked):
    label = {i: i for i in nodes}
    for _ in nodes:
        before = dict(label)
        for a, b in linked:
            label[a] = label[b] = min(label[a], label[b])
        if before == label:
            break
    return label


def test_fingerprint_by_definition():
    rng = random.Random(0)
    texts = [None, "", " \x0b", "One", "One two", "É é É a b c", "a b c a b c a b c"] + [" ".join(rng.choice(["the", "Of", "x\ny", "été"]) for _ in range(rng.randint(1, 90))) for _ in range(40)]
    assert [simhash.fingerprint(t) for t in texts] == [brute_fingerprint(t) for t in texts]
    long = "lorem Ipsum dolor " * 30_000
    assert simhash.fingerprint(long) == brute_fingerprint(long)


def test_links_are_complete(spark):
    rng = random.Random(1)
    for crowd, levels in ((2048, 3), (12, 2)):
        fps = set()
        for _ in range(25):
            base = rng.getrandbits(64)
            for _ in range(8):
                fps.add(base)
                base ^= sum(1 << b for b in rng.sample(range(64), rng.randint(1, 4)))
        base = rng.getrandbits(64)
        fps |= {base ^ (1 << b) for b in range(40)}
        fps = sorted(fps)
        nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
        got = {tuple(sorted(r)) for r in simhash.near_links(nodes, crowd=crowd, levels=levels).collect()}
        want = {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3}
        assert got == want


def test_thresholds_sum_to_the_pigeonhole():
    rng = np.random.default_rng(0)
    for n in (10, 10**6, 10**9, 10**12):
        plan = simhash.allot(rng.integers(0, 2**64, 512, dtype=np.uint64), n, 3)
        assert sum(t + 1 for _, t in plan) == 4
        masks = [m for m, _ in plan]
        assert sum(m.bit_count() for m in masks) == (sum(masks)).bit_count()
    assert len(simhash.allot(rng.integers(0, 2**64, 512, dtype=np.uint64), 10**9, 3)) < 4


def test_probing_within_a_threshold(spark):
    rng = random.Random(4)
    parts = [(0xFFFFFFFF, 1), (0xFFFFFFFF << 32, 1)]
    fps = set()
    for _ in range(50):
        base = rng.getrandbits(64)
        fps |= {base, base ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64))}
    fps = sorted(fps)
    nodes = spark.createDataFrame([(int(np.uint64(f).view(np.int64)), i) for i, f in enumerate(fps)], "fp long, rep long")
    for crowd in (2048, 0):
        got = {tuple(sorted(r)) for r in simhash.near_links(nodes, parts=parts, crowd=crowd, levels=2).collect()}
        assert got == {(i, j) for i in range(len(fps)) for j in range(i + 1, len(fps)) if (fps[i] ^ fps[j]).bit_count() <= 3}


def test_groups_with_odd_rows(spark):
    rng = random.Random(2)
    words = ["alpha", "beta", "gamma", "delta", "eps"]
    rows = [(None, "null id"), (3, None), (1, ""), (2, "  "), (2, "  "), (40, "A b"), (41, "a  b")]
    for i in range(25):
        text = [rng.choice(words) + str(rng.randint(0, 50)) for _ in range(120)]
        rows.append((100 + 2 * i, " ".join(text)))
        text[rng.randrange(120)] = "changed"
        rows.append((101 + 2 * i, " ".join(text)))
    df = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, fp string")
    got = simhash.simhash_groups(df).collect()
    assert len(got) == len(rows)
    fp = {i: brute_fingerprint(t) for i, t in rows}
    ids = [i for i in fp if i is not None]
    linked = [(a, b) for a in ids for b in ids if a < b and (fp[a] ^ fp[b]).bit_count() <= 3]
    want = brute_components(ids, linked)
    for r in got:
        assert r.fingerprint == f"{fp[r.doc_id]:016x}"
        assert r.component_id == want.get(r.doc_id)
    assert simhash.simhash_groups(df.limit(0)).count() == 0


def test_null_and_repeated_ids_are_no_bridge(spark):
    rng = random.Random(5)
    text = lambda: [f"w{rng.randrange(5000)}" for _ in range(400)]
    a, b, c, d = text(), text(), text(), text()
    near = lambda t: t[:-1] + ["changed"]
    texts = [(1, a), (2, b), (None, near(a)), (None, near(b)), (7, c), (7, near(c)), (7, d)]
    rows = [(i, " ".join(t)) for i, t in texts]
    assert all((brute_fingerprint(rows[i][1]) ^ brute_fingerprint(rows[j][1])).bit_count() <= 3 for i, j in ((0, 2), (1, 3), (4, 5)))
    got = {(r.doc_id, r.fingerprint): r.component_id for r in simhash.simhash_groups(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    want = [1, 2, 1, 2, 7, 7, 7]
    assert got == {(i, f"{brute_fingerprint(t):016x}"): w for (i, t), w in zip(rows, want, strict=True)}
