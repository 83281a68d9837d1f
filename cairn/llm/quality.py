"""Operator 10, quality classifier: attention-based multiple-instance learning.

A document is a bag of passages, its label belongs to the bag. Every passage is encoded, gated attention
(tanh times sigmoid) weighs the passages, and the weighted mean of their encodings is scored. The model
is fitted on a bounded, documented sample of labelled documents; every document's whole text is scored.
"""

from __future__ import annotations

import zlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm.shared import cut, small_batches, table

PASSAGE = 96
_MARKS = b".,;:!?#$%&*|/\\<>@_-'\"()[]{}=+~^`"
N_FEATURES = 8 + len(_MARKS) + 4


def _classes() -> np.ndarray:
    """Byte to class: lower, upper, digit, space, line end, other ASCII, lead and trail bytes, then each mark by itself."""
    out = np.full(256, 5, np.int64)
    out[ord("a") : ord("z") + 1] = 0
    out[ord("A") : ord("Z") + 1] = 1
    out[ord("0") : ord("9") + 1] = 2
    out[[32, 9, 11, 12]] = 3
    out[[10, 13]] = 4
    out[0xC0:] = 6
    out[0x80:0xC0] = 7
    for k, b in enumerate(_MARKS):
        out[b] = 8 + k
    return out


_CLASS = _classes()


def passages(text: str | None) -> np.ndarray:
    """One row of features for each passage of PASSAGE words of the whole text; an empty text is one empty passage."""
    words = (text or "").encode("utf-8", "surrogatepass").split(b" ")
    out = []
    for at in range(0, len(words), PASSAGE):
        part = words[at : at + PASSAGE]
        data = b" ".join(part)
        n, k = max(1, len(data)), len(part)
        counts = np.bincount(_CLASS[np.frombuffer(data, np.uint8)], minlength=8 + len(_MARKS)) / n
        same = sum(map(bytes.__eq__, part[1:], part)) / max(1, k - 1)
        pairs = len(set(zip(part, part[1:], strict=False))) / max(1, k - 1)
        out.append(np.concatenate([np.sqrt(counts), [len(set(part)) / k, pairs, same, np.log1p(n / k)]]))
    return np.array(out)


class Model:
    """Passage encoder, gated attention and bag score, with the features' scaling."""

    NAMES = ("w", "b", "v", "u", "a", "c", "d")

    def __init__(self, n: int = N_FEATURES, hidden: int = 24, gate: int = 12, seed: int = 7):
        rng = np.random.default_rng(seed)
        self.mean, self.scale = np.zeros(n), np.ones(n)
        self.w, self.b = rng.normal(0, n**-0.5, (n, hidden)), np.zeros(hidden)
        self.v, self.u = rng.normal(0, hidden**-0.5, (hidden, gate)), rng.normal(0, hidden**-0.5, (hidden, gate))
        self.a, self.c, self.d = rng.normal(0, gate**-0.5, gate), rng.normal(0, hidden**-0.5, hidden), np.zeros(1)

    def forward(self, x: np.ndarray, starts: np.ndarray):
        """x: passages of all bags, one after the other; starts: each bag's first passage."""
        sizes = np.diff(np.append(starts, len(x)))
        x = np.clip((x - self.mean) / self.scale, -6, 6)
        h = np.tanh(x @ self.w + self.b)
        t, s = np.tanh(h @ self.v), 1 / (1 + np.exp(-(h @ self.u)))
        e = (t * s) @ self.a
        e = np.exp(e - np.repeat(np.maximum.reduceat(e, starts), sizes))
        att = e / np.repeat(np.add.reduceat(e, starts), sizes)
        z = np.add.reduceat(att[:, None] * h, starts)
        p = 1 / (1 + np.exp(-np.clip(z @ self.c + self.d, -30, 30)))
        return p, (x, h, t, s, att, z, sizes)

    def gradients(self, p, y, kept, starts):
        x, h, t, s, att, z, sizes = kept
        g = (p - y) / len(y)
        dz = g[:, None] * self.c
        dzr = np.repeat(dz, sizes, axis=0)
        datt = (dzr * h).sum(1)
        de = att * (datt - np.repeat(np.add.reduceat(att * datt, starts), sizes))
        dt, ds = de[:, None] * self.a * s * (1 - t * t), de[:, None] * self.a * t * s * (1 - s)
        dh = (att[:, None] * dzr + dt @ self.v.T + ds @ self.u.T) * (1 - h * h)
        return {"w": x.T @ dh, "b": dh.sum(0), "v": h.T @ dt, "u": h.T @ ds, "a": (t * s).T @ de, "c": z.T @ g, "d": np.array([g.sum()])}

    def fit(self, bags: list[np.ndarray], labels: np.ndarray, epochs: int = 30, batch: int = 128, rate: float = 0.01, decay: float = 1e-4, seed: int = 11) -> Model:
        rng = np.random.default_rng(seed)
        every = np.concatenate(bags)
        self.mean, self.scale = every.mean(0), every.std(0) + 1e-3
        state = {n: [np.zeros_like(getattr(self, n)), np.zeros_like(getattr(self, n))] for n in self.NAMES}
        step = 0
        for epoch in range(epochs):
            order = rng.permutation(len(bags))
            for k in range(0, len(order), batch):
                own = order[k : k + batch]
                x = np.concatenate([bags[i] for i in own])
                starts = np.cumsum([0, *[len(bags[i]) for i in own[:-1]]])
                p, kept = self.forward(x, starts)
                step += 1
                for n, g in self.gradients(p, labels[own], kept, starts).items():
                    m, v = state[n]
                    g = g + decay * getattr(self, n)
                    m += 0.1 * (g - m)
                    v += 0.01 * (g * g - v)
                    lr = rate * 0.5 * (1 + np.cos(np.pi * epoch / epochs))
                    setattr(self, n, getattr(self, n) - lr * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-8))
        return self

    def scores(self, bags: list[np.ndarray]) -> np.ndarray:
        """In slices of bounded size."""
        out, k = [], 0
        while k < len(bags):
            end, n = k, 0
            while end < len(bags) and (end == k or n + len(bags[end]) <= 20_000):
                n += len(bags[end])
                end += 1
            starts = np.cumsum([0, *[len(b) for b in bags[k : end - 1]]])
            out.append(self.forward(np.concatenate(bags[k:end]), starts)[0])
            k = end
        return np.concatenate(out) if out else np.zeros(0)


def held_out(doc_id):
    """Column: whether crc32 of the id as text is divisible by 5; a null id counts as an empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit(""))) % 5 == 0


def train(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", most: int = 6000, most_passages: int = 200_000) -> Model | None:
    """Fits on at most `most` labelled, not held-out documents, picked by hash of the id; on whole texts, and on no more documents than have `most_passages` passages together.

    Rows without label or id are left out; an id with several labels counts by their mean, half as good. Rows that repeat an id are bags of their own. None without any such document.
    """
    known = labels.where(F.col(label).isNotNull() & F.col(doc_id).isNotNull() & ~held_out(F.col(doc_id)))
    known = known.groupBy(F.col(doc_id).cast("long").alias("id")).agg((F.avg(label) >= 0.5).cast("double").alias("y"))
    # `most` rows at most, so safe to broadcast
    chosen = known.orderBy(F.xxhash64("id", F.lit(10)), "id").limit(most)

    def encode(batches):
        import pyarrow as pa

        for batch in batches:
            for i in range(batch.num_rows):
                x = passages(batch.column(2)[i].as_py()).astype(np.float32)
                yield pa.RecordBatch.from_arrays([batch.column(0)[i : i + 1], batch.column(1)[i : i + 1], pa.array([len(x)], pa.int64()), pa.array([x.tobytes()], pa.binary())], ["id", "y", "n", "x"])

    texts = docs.select(F.col(doc_id).cast("long").alias("id"), F.col(text).alias("text")).join(F.broadcast(chosen), "id").select("id", "y", "text")
    with small_batches(docs.sparkSession):
        bags = cut(texts.mapInArrow(encode, "id long, y double, n long, x binary"))
    # The sample is bounded before its features come to the driver: whole documents in hash order, as far as the passages go.
    sizes = bags.groupBy("id").agg(F.sum("n").alias("n")).orderBy(F.xxhash64("id", F.lit(10)), "id").collect()
    ids = [r.id for r, upto in zip(sizes, np.cumsum([r.n for r in sizes]), strict=True) if upto <= most_passages]
    if not ids:
        return None
    picked = docs.sparkSession.createDataFrame([(i,) for i in ids], "id long")
    rows = sorted((r.id, r.y, bytes(r.x)) for r in bags.join(F.broadcast(picked), "id").collect())
    return Model().fit([np.frombuffer(r[2], np.float32).reshape(-1, N_FEATURES).astype(float) for r in rows], np.array([r[1] for r in rows]))


def with_score(docs: DataFrame, model: Model | None, text: str = "text", score: str = "score", rows: int = 512) -> DataFrame:
    """All columns of `docs`, and the score of the whole text: near 1 where label 1 is likelier, 1/2 without a model."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    at = docs.columns.index(text)

    def run(batches):
        import pyarrow as pa

        for whole in batches:
            for k in range(0, whole.num_rows, rows):  # the features of few texts at once, and small batches back
                batch = whole.slice(k, rows)
                bags = [passages(t.as_py()) for t in batch.column(at)] if model else []
                p = model.scores(bags) if model else np.full(batch.num_rows, 0.5)
                yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(p, pa.float64())], [*batch.schema.names, score])

    return docs.mapInArrow(run, StructType([*docs.schema.fields, StructField(score, DoubleType())]))


def quality_scores(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", threshold: float = 0.3, **settings) -> DataFrame:
    """One row per row of `docs`: doc_id, held_out, score, predicted.

    Null texts count as empty, and an empty text is a bag of one empty passage. Only the text enters the score. Repeated rows
    get equal scores; other columns play no part; an empty table gives an empty result.
    """
    model = train(docs, labels, doc_id, text, **settings)
    rows = with_score(docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")), model)
    return rows.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_scores(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def is_held_out(doc_id) -> bool:
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 5 == 0
