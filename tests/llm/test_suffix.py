"""Repeated strings against brute force."""

import hashlib
import random

import numpy as np

from cairn.llm import suffix_dedup


def brute(rows, length):
    seen, out = set(), {}
    for i, t in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (t or "").encode()
        gone = np.zeros(len(data), bool)
        for s in range(len(data) - length + 1):
            x = data[s : s + length]
            if x in seen:
                gone[s : s + length] = True
            seen.add(x)
        spans = int((np.diff(np.concatenate([[0], gone.astype(int), [0]])) == 1).sum())
        out[i] = (len(data), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(data, np.uint8)[~gone])).hexdigest())
    return out


def rows_of(seed):
    rng = random.Random(seed)
    words = ["the", "of", "été", "and", "in", "thing", "re"] + ["".join(rng.choice("abcdef") for _ in range(rng.randint(2, 9))) for _ in range(60)]
    make = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passages = [make(30) for _ in range(4)]
    rows = [(None, make(40)), (3, None), (1, ""), (2, "ab" * 300), (4, "abab" * 80), (5, "on " * 200), (6, passages[0])]
    for i in range(10, 90):
        kind = rng.randint(0, 5)
        text = make(rng.randint(1, 120))
        if kind == 0:
            text = rng.choice(passages)
        if kind == 1:
            text = text + rng.choice(passages) + make(5) + rng.choice(passages)
        if kind == 2 and len(rows) > 10:
            text = rng.choice(rows[8:])[1]
        if kind == 3 and len(rows) > 10:
            w = rng.choice(rows[8:])[1].split(" ")
            w[rng.randrange(len(w))] = "edit"
            text = " ".join(w)
        rows.append((i, text))
    rows.append((99, make(20_000)))
    rng.shuffle(rows)
    return rows


def test_matches_brute_force(spark):
    for seed, parts in ((0, 1), (1, 9)):
        rows = rows_of(seed)
        df = spark.createDataFrame([(i, t, "x", 1) for i, t in rows], "doc_id long, text string, first string, n int").repartition(parts)
        got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df).collect()}
        assert got == brute(rows, 100)
    assert suffix_dedup.suffix_dedup(df.limit(0)).count() == 0
    assert suffix_dedup.suffix_dedup(df.union(df.limit(2))).count() == len(rows) + 2


def test_other_lengths(spark, monkeypatch):
    rows = rows_of(5)
    monkeypatch.setattr(suffix_dedup._refine, "__defaults__", (50,))
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5)
    got = {r.doc_id: (r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df, length=40, k=8).collect()}
    assert got == brute(rows, 40)


def test_long_texts_are_cut_in_segments(spark, monkeypatch):
    monkeypatch.setattr(suffix_dedup, "_SEGMENT", 300)
    data = np.random.default_rng(0).integers(97, 100, 5000).astype(np.uint8).tobytes()
    text = suffix_dedup.Text(data)
    first, count, at = suffix_dedup.phrases(text, 100, 24)
    assert (np.repeat(first, count) + np.concatenate([np.arange(c) for c in count]) == np.arange(4901)).all()
    assert ((at >= first + count - 1) & (at <= first + 76)).all()
