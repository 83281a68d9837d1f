"""Operator 13, byte-level BPE by a sentencepiece model that is serialised directly from the vocabulary.

A rank file says which byte strings are tokens, and that of all neighbouring pairs whose union is a token the one of least rank merges first,
the leftmost first. Sentencepiece's BPE is the same rule over letters with scores, so each byte is written as one printable letter, each token as a
piece with its negative rank as score, and normalisation is the identity. Nothing is trained. Texts are cut into pre-tokens by the pattern, pre-tokens
are encoded by the model, and ids are decoded by the inverse mapping from letters to bytes.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterable, Iterator
from itertools import islice

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm.bpe import byte_letters
from cairn.llm.shared import table

_WINDOW = 1 << 15
_BLOCK = 1 << 12
_CHUNKS = 1 << 16
_WORDS = 1 << 17
_LONGEST = 64


def read_ranks(path: str) -> dict[bytes, int]:
    """Ranks by token, of lines with a token in base 64 and its rank."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


def serialised_model(ranks: dict[bytes, int]) -> tuple[bytes, list[int]]:
    """(model file, rank by piece number). Piece numbers follow the ranks; the unknown piece, which no byte ever needs, stands behind them."""
    from sentencepiece import sentencepiece_model_pb2 as pb

    missing = [b for b in range(256) if bytes([b]) not in ranks]
    if missing:
        raise ValueError(f"bytes without a token: {missing}")
    letters, model = byte_letters(), pb.ModelProto()
    order = sorted(ranks, key=ranks.__getitem__)
    for token in order:
        model.pieces.add(piece="".join([letters[b] for b in token]), score=-float(ranks[token]), type=pb.ModelProto.SentencePiece.NORMAL)
    model.pieces.add(piece="<unk>", score=0.0, type=pb.ModelProto.SentencePiece.UNKNOWN)
    spec = model.trainer_spec
    spec.model_type, spec.vocab_size = pb.TrainerSpec.BPE, len(model.pieces)
    spec.unk_id, spec.bos_id, spec.eos_id, spec.pad_id = len(order), -1, -1, -1
    own = model.normalizer_spec
    own.name, own.precompiled_charsmap = "identity", b""
    own.add_dummy_prefix = own.remove_extra_whitespaces = own.escape_whitespaces = False
    return model.SerializeToString(), [ranks[t] for t in order]


def _keep(cache: tuple[dict, dict], new: dict, most: int) -> tuple[dict, dict]:
    """A cache of two generations, (young, old), with `new`: a full young one becomes the old one."""
    young, old = cache
    if len(young) >= most:
        young, old = {}, young
    young |= new
    return young, old


def _joined(parts: list[tuple[str, int, bytes]]) -> tuple[str, int, bytes]:
    return " ".join([p[0] for p in parts]), sum([p[1] for p in parts]), b"".join([p[2] for p in parts])


class ByteBpe:
    """Ids of texts and bytes of ids. `spaced` says that a match of the pattern always ends between white space and another letter before it,
    whatever comes further on, as holds for patterns that take white space by itself or at the head of a word."""

    def __init__(self, path: str, pattern: str, spaced: bool = True):
        import regex
        import sentencepiece

        ranks = read_ranks(path)
        model, self._rank = serialised_model(ranks)
        self._model = sentencepiece.SentencePieceProcessor(model_proto=model)
        self._split = regex.compile(pattern)
        self._letters = byte_letters()
        self._to_letters = {b: x for b, x in enumerate(self._letters)}
        to_byte = {x: b for b, x in enumerate(self._letters)}
        # The inverse mapping: the pieces that the model holds, back to bytes.
        self._bytes = {rank: bytes([to_byte[x] for x in self._model.id_to_piece(k)]) for k, rank in enumerate(self._rank)}
        # A pre-token that is a token is that token, even where merges do not lead to it.
        self._plain, self._spaced = self._rank == list(range(len(self._rank))), spaced
        whole = list(ranks)
        merged = self._merged([t.decode("latin-1").translate(self._to_letters) for t in whole])
        self._whole = {t: ranks[t] for t, ids in zip(whole, merged, strict=True) if ids != [ranks[t]]}
        self.forget()

    def forget(self) -> None:
        """Empties the caches."""
        self._chunks: tuple[dict, dict] = {}, {}
        self._words: tuple[dict, dict] = {}, {}

    def _written(self, word: str) -> str:
        """The bytes of a pre-token as letters. Printable ASCII but the space stands for itself."""
        if word.isascii() and word.isprintable():
            return word.replace(" ", self._letters[32])
        return word.encode("utf-8").decode("latin-1").translate(self._to_letters)

    def _merged(self, written: list[str]) -> list[list[int]]:
        """Ids of strings of letters by merges alone."""
        found = self._model.encode(written, out_type=int, num_threads=1)
        if self._plain:
            return found
        rank = self._rank
        return [[rank[k] for k in ids] for ids in found]

    def _of_words(self, words: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """(ids joined by spaces, their number, what they decode to) of pre-tokens."""
        young, old = self._words
        out = {w: got for w in words if (got := young.get(w) or old.get(w))}
        fresh = [w for w in words if w not in out]
        decode, whole = self.decode, self._whole
        for w, ids in zip(fresh, self._merged(list(map(self._written, fresh))) if fresh else (), strict=True):
            if whole and (part := w.encode("utf-8")) in whole:
                ids = [whole[part]]
            out[w] = (" ".join(map(str, ids)), len(ids), decode(ids))
        self._words = _keep(self._words, out if max(map(len, out), default=0) <= _LONGEST else {w: got for w, got in out.items() if len(w) <= _LONGEST}, _WORDS)
        return out

    def _of_chunks(self, chunks: set[str]) -> dict[str, tuple[str, int, bytes]]:
        """The same of chunks, each behind a space, that are cut at the pattern."""
        split = self._split.findall
        cut = {c: split(" " + c) for c in chunks}
        words = self._of_words({w for ws in cut.values() for w in ws})
        out = {c: words[ws[0]] if len(ws) == 1 else _joined([words[w] for w in ws]) for c, ws in cut.items()}
        self._chunks = _keep(self._chunks, out, _CHUNKS)
        return out

    def _matches(self, text: str) -> Iterator[tuple[str, int, bytes]]:
        """The same of the matches of the pattern in any text, a bounded number of matches at a time."""
        found = self._split.finditer(text)
        while words := [m[0] for m in islice(found, _BLOCK)]:
            known = self._of_words(set(words))
            yield _joined([known[w] for w in words])

    def _between(self, chunks: list[str]) -> Iterator[tuple[str, int, bytes]]:
        """The same of chunks that each stand behind a space; the text before them ends in no white space."""
        young, old = self._chunks
        got = list(map(young.get, chunks))
        if None in got:
            # An empty chunk, or one that ends in white space, takes what follows with it; so does a long one for memory's sake.
            gaps = [k for k, g in enumerate(got) if g is None and (c := chunks[k]) and len(c) <= _LONGEST and not c[-1].isspace()]
            new = {chunks[k] for k in gaps}
            known = {c: old[c] for c in new if c in old}
            if known:
                self._chunks = _keep(self._chunks, known, _CHUNKS)
            known |= self._of_chunks(new.difference(known))
            for k in gaps:
                got[k] = known[chunks[k]]
        at = 0
        while None in got[at:]:
            start = got.index(None, at)
            if start > at:
                yield _joined(got[at:start])
            at = start + 1
            while at < len(chunks) and (not chunks[at - 1] or chunks[at - 1][-1].isspace()):
                at += 1
            yield from self._matches(" " + " ".join(chunks[start:at]))
        if at < len(chunks):
            yield _joined(got[at:])

    def pieces(self, text: str | None) -> Iterator[tuple[str, int, bytes]]:
        """The document in order and in parts: (ids joined by spaces, their number, what they decode to).

        Where the pattern keeps to `spaced`, windows end before a space that follows another letter than white space, and what stands between
        such spaces is looked up as a whole.
        """
        text = text or ""
        if not self._spaced:
            yield from self._matches(text)
            return
        at, size = 0, len(text)
        while at < size:
            end = text.find(" ", at + _WINDOW)
            while end > 0 and text[end - 1].isspace():
                end = text.find(" ", end + 1)
            end = size if end < 0 else end
            window, at = text[at:end], end
            chunks = window.split(" ")
            first = chunks.pop(0)
            if first:
                k = 0
                if first[-1].isspace():
                    k = next((i + 1 for i, c in enumerate(chunks) if c and not c[-1].isspace()), len(chunks))
                yield from self._matches(" ".join([first, *chunks[:k]]))
                chunks = chunks[k:]
            if chunks:
                yield from self._between(chunks)

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for p in self.pieces(text) for i in p[0].split(" ")]

    def decode(self, ids: Iterable[int]) -> bytes:
        """The bytes of ids; an id without a token is a KeyError."""
        return b"".join([self._bytes[i] for i in ids])


_loaded: dict[tuple[str, str], ByteBpe] = {}


def load(path: str, pattern: str) -> ByteBpe:
    """One model a process, file and pattern."""
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = ByteBpe(path, pattern)
    return _loaded[path, pattern]


def digests(bpe: ByteBpe, text: str | None) -> tuple[int, str, str]:
    """(number of tokens, SHA-256 of the ids, SHA-256 of the decoded bytes), part by part."""
    ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
    for a, k, b in bpe.pieces(text):
        if n:
            ids.update(b" ")
        ids.update(a.encode())
        decoded.update(b)
        n += k
    return n, ids.hexdigest(), decoded.hexdigest()


def byte_bpe_digests(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256. `path` is a rank file that every executor has.

    Null and empty texts have no tokens and the digests of nothing. Very long texts go through in blocks of pre-tokens. Rows are independent, so repeated
    rows and null ids need no care; an empty table stays empty; other columns play no part.
    """

    def run(batches):
        import pyarrow as pa

        # The caches stay for the next task of this process; both are bounded.
        bpe = load(path, pattern)
        for batch in batches:
            rows = [digests(bpe, t.as_py()) for t in batch.column(1)]
            columns = list(zip(*rows, strict=True)) or [[]] * 3
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id and its token ids. Same rules as byte_bpe_digests."""

    def run(batches):
        import pyarrow as pa

        bpe = load(path, pattern)
        for batch in batches:
            ids = pa.array([bpe.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, path: str, pattern: str, doc_id: str = "doc_id", ids: str = "ids") -> DataFrame:
    """One row per row of `encoded`: doc_id and the bytes of its ids; null ids are no ids."""

    def run(batches):
        import pyarrow as pa

        bpe = load(path, pattern)
        for batch in batches:
            content = pa.array([bpe.decode(x.as_py() or []) for x in batch.column(1)], pa.binary())
            yield pa.RecordBatch.from_arrays([batch.column(0), content], ["doc_id", "content"])

    return encoded.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, content binary")


def op13_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return byte_bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
