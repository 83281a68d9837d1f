"""Attention-based classifier: gradients, held-out accuracy and odd rows."""

import random
import zlib

import numpy as np

from cairn.llm import quality


def test_gradients_match_differences():
    rng = np.random.default_rng(0)
    m = quality.Model(5, 4, 3)
    x, starts, y = rng.normal(size=(9, 5)), np.array([0, 2, 3]), np.array([1.0, 0.0, 1.0])

    def loss():
        p = m.forward(x, starts)[0]
        return -np.mean(y * np.log(p) + (1 - y) * np.log(1 - p))

    p, kept = m.forward(x, starts)
    got = m.gradients(p, y, kept, starts)
    for n in m.NAMES:
        flat = getattr(m, n).reshape(-1)
        for k in range(len(flat)):
            old = flat[k]
            flat[k] = old + 1e-5
            up = loss()
            flat[k] = old - 1e-5
            down = loss()
            flat[k] = old
            assert abs((up - down) / 2e-5 - got[n].reshape(-1)[k]) < 1e-6


def make(seed, n):
    rng = random.Random(seed)
    words = ["".join(rng.choice("etaoinshr") for _ in range(rng.randint(2, 8))) for _ in range(300)]
    rows = []
    for i in range(n):
        text = [rng.choice(words) for _ in range(rng.choice([3, 40, 300]))]
        kind = rng.choice([None, None, None, 0, 1, 2])
        at = rng.randrange(len(text))
        if kind == 0:
            text[at:] = [w + "###" for w in text[at:]]
        if kind == 1:
            text = [w.upper() + "!!" for w in text]
        if kind == 2:
            text = [w for w in text[:8] for _ in range(12)]
        rows.append((i, " ".join(text), int(kind is None)))
    return rows


def test_held_out_accuracy_and_odd_rows(spark):
    rows = make(1, 900)
    docs = spark.createDataFrame([(i, t, "en", "x", 0.0) for i, t, _ in rows] + [(None, None, "", "", 0.0), (5000, "", "", "", 0.0), (5000, "", "", "", 0.0)], "doc_id long, text string, lang string, source string, score double")
    labels = spark.createDataFrame([(i, y, 0) for i, _, y in rows] + [(3, rows[3][2], 0), (7, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.quality_scores(docs, labels).collect()
    assert len(got) == 903 and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.3) for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in got if r.doc_id is not None)
    truth = {i: y for i, _, y in rows}
    right = [r.predicted == truth[r.doc_id] for r in got if r.held_out and r.doc_id in truth]
    assert len(right) > 100 and np.mean(right) > 0.93
    # Held-out labels are not looked at.
    turned = spark.createDataFrame([(i, 1 - y if quality.is_held_out(i) else y, 0) for i, _, y in rows], labels.schema)
    assert {r.doc_id: round(r.score, 9) for r in quality.quality_scores(docs, turned).collect()} == {r.doc_id: round(r.score, 9) for r in got}
    none = quality.quality_scores(docs, labels.limit(0)).collect()
    assert {r.score for r in none} == {0.5} and quality.quality_scores(docs.limit(0), labels).count() == 0


def test_whole_text_is_encoded():
    assert len(quality.passages("a " * 100_000)) == -(-100_001 // quality.PASSAGE)
    assert np.isfinite(quality.passages(None)).all() and len(quality.passages("")) == 1
