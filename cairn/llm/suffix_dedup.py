"""Operator 6, suffix-array dedup by prefix-free parsing, over the bytes of all documents.

A byte goes if it is covered by a string of `length` bytes that also starts earlier in the corpus
(smaller id, or same document and earlier start).

*Parsing.* The rolling hash of k bytes is a trigger where it is the least of some length - k + 1
neighbouring ones. Each string of `length` bytes holds exactly that many k-grams, so it belongs to the
trigger that is its own least k-gram, found from the string alone: equal strings belong to equal
triggers at equal distance. A phrase is all bytes of the strings of one trigger occurrence.

*Dictionary and parse.* Equal phrases are one dictionary entry; the parse names the entry at each place
in corpus order. Every later place of an entry repeats all its strings, which settles repetitive
text phrase by phrase. Only entries that share a trigger but not all bytes can share some strings: they are cut in cells of
few starts, compared the same way, and of what is still open the suffixes are put in suffix-array
order (to a depth of `length`), neighbours with a common prefix of `length` are one class, and the
parse's corpus order says which member comes first.

*Distribution.* A map task folds equal entries (and equal suffix classes) of its documents first, so the commonest passage
sends one row per task, and a trigger with many different phrases is known to be ambiguous at once. Triggers and
classes then meet by hash, and what they find goes back to the documents as runs of starts.
"""

from __future__ import annotations

import hashlib

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window as W, functions as F

from cairn.llm.shared import cut, table

_SEGMENT = 1 << 19
_NO_ID = 2**63 - 1
_RNG = np.random.default_rng(20240229)
_BYTE = _RNG.integers(1, 2**64, 256, dtype=np.uint64, endpoint=False)
_BASE = np.uint64(0x9E3779B97F4A7C15)
_INVERSE = np.uint64(pow(int(_BASE), -1, 2**64))
_powers: dict[str, np.ndarray] = {}


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to n - 1 of the base and of its inverse, modulo 2^64."""
    if len(_powers.get("up", ())) < n:
        size = max(n, 1 << 16)
        for name, base in (("up", _BASE), ("down", _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _powers[name] = np.multiply.accumulate(steps)
    return _powers["up"][:n], _powers["down"][:n]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


class Text:
    """The bytes of a text with hashes of any of their substrings."""

    def __init__(self, data: bytes):
        self.data = np.frombuffer(data, np.uint8)
        up, self.down = _power(len(data) + 1)
        self.sums = np.zeros(len(data) + 1, np.uint64)
        np.cumsum(_BYTE[self.data] * up[:-1], out=self.sums[1:])

    def hashes(self, start, end) -> np.ndarray:
        return _mix((self.sums[end] - self.sums[start]) * self.down[start])


def phrases(text: Text, length: int, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(first start, number of starts, trigger) of each phrase: every start of a string of `length` is in one phrase."""
    n, w = len(text.data), length - k + 1
    firsts, counts, at = [], [], []
    for a in range(0, max(0, n - length + 1), _SEGMENT):
        b = min(n - length + 1, a + _SEGMENT)
        grams = b - a + w - 1
        keys = _mix((text.sums[a + k : a + k + grams] - text.sums[a : a + grams]) * text.down[a : a + grams])
        keys = (keys & np.uint64(2**64 - 2**20)) | np.arange(grams, dtype=np.uint64)
        span = 1
        while span < w:  # the least key of `span` neighbours, doubled up to w
            step = min(span, w - span)
            keys = np.minimum(keys[: len(keys) - step], keys[step:])
            span += step
        trigger = (keys & np.uint64(2**20 - 1)).astype(np.int64) + a
        edge = np.concatenate([[0], np.flatnonzero(trigger[1:] != trigger[:-1]) + 1])
        firsts.append(edge + a)
        counts.append(np.diff(np.append(edge, b - a)))
        at.append(trigger[edge])
    if not firsts:
        return (np.zeros(0, np.int64),) * 3
    return np.concatenate(firsts), np.concatenate(counts), np.concatenate(at)


#: A run of starts as one long: first start, number of starts, whether it is still open, distance of the trigger from the first start.
_MOST, _OPEN = 2**16 - 1, 1 << 15


def _pack(first, count, lead=0):
    return (first.astype(np.int64) << 32) | (count.astype(np.int64) << 16) | lead


def _unpack(where) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(first, count, open, lead) of a list of runs."""
    x = np.array(where or [], np.int64)
    return x >> 32, (x >> 16) & _MOST, (x & _OPEN) > 0, x & (_OPEN - 1)


def _runs(doc: np.ndarray, first: np.ndarray, count: np.ndarray):
    """Runs of starts, given by document and start, with those that touch in one document joined, up to what a run can hold."""
    if not len(doc):
        return doc, first, count
    new = np.concatenate([[True], (doc[1:] != doc[:-1]) | (first[1:] != first[:-1] + count[:-1])])
    at = np.flatnonzero(new)
    doc, first, count = doc[at], first[at], np.add.reduceat(count, at)
    pieces = -(-count // _MOST)
    nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    return np.repeat(doc, pieces), np.repeat(first, pieces) + nth * _MOST, np.minimum(np.repeat(count, pieces) - nth * _MOST, _MOST)


def _in_order(batch) -> tuple[np.ndarray, np.ndarray]:
    """Row numbers and ids of an Arrow batch in ascending order of ids."""
    ids = batch.column(0).to_numpy(zero_copy_only=False)
    order = np.argsort(ids, kind="stable")
    return order, ids[order]


def _bytes(column, i: int) -> bytes:
    return (column[int(i)].as_py() or "").encode("utf-8", "surrogatepass")


_KEYED, _REPEATED, _AMBIGUOUS = 0, 1, 2
_ROWS = "kind byte, key long, entry long, id long, place long"


def _fold(ids, doc, first, count, lead, key, entry, own):
    """Rows (kind, key, entry, id, place) of phrases in corpus order; own: the first place of each distinct entry.

    _KEYED rows meet by key; those of no starts only say that the key has several entries. _REPEATED rows are runs that this
    batch alone proves to repeat, _AMBIGUOUS ones phrases of keys that have several entries in this batch.
    """
    import pyarrow as pa

    later = np.ones(len(doc), bool)
    later[own] = False
    _, which, n_entries = np.unique(key[own], return_inverse=True, return_counts=True)
    several = n_entries[which] > 1
    order = np.argsort(which[several], kind="stable")
    flags, group = own[several][order], which[several][order]
    if len(group):  # two entries of each such key are enough for the others to know
        turn = group[1:] != group[:-1]
        flags = flags[np.concatenate([[True], turn]) | np.concatenate([turn, [True]])]
    rd, rf, rc = _runs(doc[later], first[later], count[later])
    one, many = own[~several], own[several]
    kinds = np.repeat([_KEYED, _REPEATED, _AMBIGUOUS], [len(one) + len(flags), len(rd), len(many)]).astype(np.int8)
    spread = _mix(rd.astype(np.uint64) * np.uint64(1_000_003) + rf.astype(np.uint64)), _mix(entry[many] ^ first[many].astype(np.uint64))
    keys = np.concatenate([key[one], key[flags], *spread]).view(np.int64)
    entries = np.concatenate([entry[one], entry[flags], np.zeros(len(rd) + len(many), np.uint64)]).view(np.int64)
    places = [_pack(first[one], count[one], lead[one]), np.zeros(len(flags), np.int64), _pack(rf, rc), _pack(first[many], count[many], lead[many])]
    columns = [pa.array(kinds), pa.array(keys), pa.array(entries), pa.array(ids[np.concatenate([doc[one], doc[flags], rd, doc[many]])]), pa.array(np.concatenate(places))]
    return pa.RecordBatch.from_arrays(columns, ["kind", "key", "entry", "id", "place"])


def _parse(batches, length: int, k: int):
    """_fold of the phrases of (id, text) batches."""
    for batch in batches:
        order, ids = _in_order(batch)
        parts = []
        for d, i in enumerate(order):
            t = Text(_bytes(batch.column(1), i))
            first, count, at = phrases(t, length, k)
            if len(first):
                parts.append((np.full(len(first), d), first, count, at - first, t.hashes(at, at + k), t.hashes(first, first + count + (length - 1))))
        if parts:
            doc, first, count, lead, key, entry = (np.concatenate(x) for x in zip(*parts, strict=True))
            entry = _mix(entry ^ (key << np.uint64(1)) ^ count.astype(np.uint64))
            _, own = np.unique(entry, return_index=True)  # the first in corpus order
            yield _fold(ids, doc, first, count, lead, key, entry, own)


def suffix_classes(texts, doc: np.ndarray, start: np.ndarray, length: int) -> np.ndarray:
    """For each start, in corpus order, the number of the first one with the same `length` bytes.

    The suffixes are put in suffix-array order to the depth of `length`; equal neighbours are one class."""
    windows = np.empty((len(doc), length), np.uint8)
    edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1], [True]])) if len(doc) else []
    for a, b in zip(edge[:-1], edge[1:], strict=True):
        windows[a:b] = np.lib.stride_tricks.sliding_window_view(texts[doc[a]], length)[start[a:b]]
    suffixes = windows.view(f"S{length}").ravel()
    array = np.argsort(suffixes, kind="stable")
    sorted_ = windows[array]
    new = np.concatenate([[True], (sorted_[1:] != sorted_[:-1]).any(axis=1)]) if len(array) else np.zeros(0, bool)
    first = np.empty(len(array), np.int64)
    first[array] = array[np.flatnonzero(new)][np.cumsum(new) - 1] if len(array) else 0
    return first


def _cells(text: Text, where, length: int, cell: int):
    """(first, count, lead, key, entry) of the open runs of one text, cut in cells, or None."""
    first, count, open_, lead = _unpack(where)
    first, count, at = first[open_], count[open_], (first + lead)[open_]
    start = np.repeat(first, count) + np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    at = np.repeat(at, count)
    fits = start + length <= len(text.data)  # clips where two rows share an id
    start, at = start[fits], at[fits]
    by = np.argsort(start, kind="stable")
    start, at = start[by], at[by]
    if not len(start):
        return None
    nth = (at - start) // cell
    head = np.flatnonzero(np.concatenate([[True], (at[1:] != at[:-1]) | (nth[1:] != nth[:-1])]))
    first, at, nth = start[head], at[head], nth[head]
    count = np.diff(np.append(head, len(start)))
    if cell == 1:
        return first, count, at - first, text.hashes(first, first + length), text.hashes(first, first + length // 2)
    core = at - nth * cell
    key = _mix(text.hashes(core, core + (length - cell + 1)) ^ nth.astype(np.uint64))
    entry = _mix(text.hashes(first, first + count + (length - 1)) ^ (key << np.uint64(1)) ^ (count * 1024 + at - first).astype(np.uint64))
    return first, count, at - first, key, entry


def _refine(batches, length: int, cell: int, most: int = 300_000):
    """_fold of the open runs of (id, text, runs) batches, cut in cells of `cell` starts counted from the trigger, about `most` cells at a time.

    All strings that start in a cell share a core of length - cell + 1 bytes, whichever of them a phrase has: cells with
    different cores share nothing. Cells of one start are compared by their bytes.
    """

    def folded(ids, texts, parts):
        doc, first, count, lead, key, entry = (np.concatenate(x) for x in zip(*parts, strict=True))
        for a in range(0, len(doc), most):
            d, f, c, le, k, e = (x[a : a + most] for x in (doc, first, count, lead, key, entry))
            if cell > 1:
                _, own = np.unique(e, return_index=True)
            else:
                own = np.flatnonzero(suffix_classes(texts, d, f, length) == np.arange(len(d)))
            yield _fold(ids, d, f, c, le, k, e, own)

    for batch in batches:
        order, ids = _in_order(batch)
        texts, parts, n = {}, [], 0
        for d, i in enumerate(order):
            where = batch.column(2)[int(i)].as_py()
            if not where:
                continue
            text = Text(_bytes(batch.column(1), i))
            got = _cells(text, where, length, cell)
            if got is not None:
                texts[d] = text.data
                parts.append((np.full(len(got[0]), d), *got))
                n += len(got[0])
            if n >= most:
                yield from folded(ids, texts, parts)
                texts, parts, n = {}, [], 0
        if parts:
            yield from folded(ids, texts, parts)


def removed_spans(n: int, runs: list[tuple[int, int]], length: int) -> list[tuple[int, int]]:
    """Maximal runs of bytes covered by strings of `length` that start in `runs` of (first, count), within n bytes."""
    out: list[tuple[int, int]] = []
    for first, count in sorted(runs):
        a, b = first, min(n, first + count - 1 + length)
        if a >= b:
            continue
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], b))
        else:
            out.append((a, b))
    return out


def _cut(batches, length: int):
    """Rows (id, n_removed, n_spans, sha) of (id, text, runs...) batches: the closed runs of all columns go."""
    import pyarrow as pa

    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            data = (batch.column(1)[i].as_py() or "").encode("utf-8", "surrogatepass")
            runs = []
            for c in range(2, batch.num_columns):
                first, count, open_, _ = _unpack(batch.column(c)[i].as_py())
                runs += zip(first[~open_].tolist(), count[~open_].tolist(), strict=True)
            spans = removed_spans(len(data), runs, length)
            h, at = hashlib.sha256(), 0
            for a, b in spans:
                h.update(data[at:a])
                at = b
            h.update(data[at:])
            rows.append((batch.column(0)[i].as_py(), sum(b - a for a, b in spans), len(spans), h.hexdigest()))
        columns = list(zip(*rows, strict=True)) or [[]] * 4
        yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.int64()), pa.array(columns[2], pa.int64()), pa.array(columns[3], pa.string())], ["id", "n_removed", "n_spans", "sha"])


def _judge(folded: DataFrame, name: str) -> DataFrame:
    """(id, list of runs) from folded rows: a place repeats if an equal entry stands before it; it is open if its key has other entries."""
    # The partition is a column, not an expression: so both windows share one shuffle and one sort.
    keyed = F.col("keyed")
    order = W.partitionBy("keyed", "key").orderBy("entry", "id", "place")
    whole = order.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    folded = folded.withColumn("keyed", F.col("kind") == _KEYED)
    again = F.coalesce(F.lag("entry").over(order) == F.col("entry"), F.lit(False))
    seen = folded.select("*", again.alias("again"), (F.first("entry").over(whole) != F.last("entry").over(whole)).alias("mixed"))
    closed = (F.col("kind") == _REPEATED) | (keyed & F.col("again"))
    seen = seen.where("place <> 0").where(closed | (F.col("kind") == _AMBIGUOUS) | F.col("mixed"))
    return seen.groupBy("id").agg(F.collect_list(F.col("place").bitwiseOR(F.when(closed, F.lit(0)).otherwise(F.lit(_OPEN)).cast("long"))).alias(name))


def suffix_dedup(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", length: int = 100, k: int = 32, cell: int = 12) -> DataFrame:
    """One row per row of `docs`: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Null texts count as empty; texts shorter than `length` keep all. A null id comes after every other. Ids should be unique: rows that repeat an id are
    read as one document, and what is found for either is removed from both. Other columns of `docs` play no part.
    """
    rows = docs.select(F.coalesce(F.col(doc_id).cast("long"), F.lit(_NO_ID)).alias("id"), F.col(text).alias("text"))
    parsed = rows.where(F.octet_length("text") >= length).mapInArrow(lambda b: _parse(b, length, k), _ROWS)
    # `held` stands in the plan several times; its shuffle of texts runs once.
    held = rows.join(cut(_judge(parsed, "runs")), "id").select("id", "text", "runs")
    cells = _judge(held.mapInArrow(lambda b: _refine(b, length, cell), _ROWS), "cells")
    held = held.join(cells, "id", "left")
    single = _judge(held.select("id", "text", "cells").mapInArrow(lambda b: _refine(b, length, 1), _ROWS), "single")
    held = held.join(single, "id", "left").select("id", "text", "runs", "cells", "single")
    found = held.mapInArrow(lambda b: _cut(b, length), "id long, n_removed long, n_spans long, sha string")
    found = found.groupBy("id").agg(F.max("n_removed").alias("n_removed"), F.max("n_spans").alias("n_spans"), F.max("sha").alias("sha"))
    t = F.coalesce(F.col(text), F.lit(""))
    every = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.octet_length(t).cast("long").alias("n_bytes"), F.sha2(t, 256).alias("whole"))
    out = every.withColumn("id", F.coalesce("doc_id", F.lit(_NO_ID))).join(found, "id", "left")
    zero = F.lit(0).cast("long")
    return out.select("doc_id", "n_bytes", F.coalesce("n_removed", zero).alias("n_removed"), F.coalesce("n_spans", zero).alias("n_spans"), F.coalesce("sha", "whole").alias("kept_sha256"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup(table(spark, sf_dir, "documents"))
