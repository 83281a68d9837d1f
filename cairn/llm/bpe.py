"""Operator 1, BPE encoding and decoding: a bounded-lookahead streaming transducer.

Merges apply in rank order, so what follows a byte can change tokens before it only through a chain of
merges of rising rank: merge (u, v) moves the changed place left by len(u) if v starts at it, and a
later merge (u', v') goes on only if v' begins with u. The longest such chain is the merge list's
sufficient lookahead L. A token that ends L + 1 bytes before the end of what has been read is thus
stable whatever follows, and the tokens after a stable boundary are those of the rest alone: the encoder emits stable
tokens and keeps a buffer of a few L.

The decoder is a state machine over bytes: it holds at most the open bytes of one character.
"""

from __future__ import annotations

import hashlib
import heapq
import json
from collections.abc import Iterable, Iterator

from pyspark.sql import DataFrame, SparkSession, functions as F

from cairn.llm.shared import table

#: White space as Unicode has it; Python's own classes also hold \x1c to \x1f.
_SPACES = "\t\n\x0b\x0c\r\x85\xa0                　"
_WINDOW = 1 << 16
_SHORT = 64
_BITS = 24
_MASK, _NONE = (1 << _BITS) - 1, 1 << 62
_CACHE = 1 << 16
_WORDS = 1 << 17


def byte_letters() -> list[str]:
    """The printable letter that stands for each byte in byte-level vocabularies: itself if printable, else the next free one from U+0100."""
    out, free = [], 0x100
    for b in range(256):
        if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b <= 0xFF:
            out.append(chr(b))
        else:
            out.append(chr(free))
            free += 1
    return out


def sufficient_lookahead(merges: list[tuple[str, str]]) -> int:
    """The greatest number of letters by which a change moves left, over chains of merges of rising rank."""
    reach: dict[str, int] = {}  # by prefix p: the farthest a later merge whose right part begins with p can move on
    most = 0
    for u, v in reversed(merges):
        far = len(u) + reach.get(u, 0)
        most = max(most, far)
        for k in range(1, len(v) + 1):
            p = v[:k]
            if reach.get(p, 0) < far:
                reach[p] = far
    return most


class Merger:
    """Tokens of one word, fed in parts."""

    def __init__(self, vocab: dict[str, int], merges: list[tuple[str, str]], suffix: str):
        letters = byte_letters()
        self.inner = [vocab.get(x) for x in letters]
        self.last = [vocab.get(x + suffix) for x in letters]
        self.rules = {}
        for rank, (u, v) in enumerate(merges):
            self.rules.setdefault((vocab[u], vocab[v]), (rank, vocab[u + v]))
        self.codes = {pair: rank << _BITS | new for pair, (rank, new) in self.rules.items()}
        plain = [(u, v.removesuffix(suffix) + ("\0" if suffix and v.endswith(suffix) else "")) for u, v in merges]
        self.lookahead = sufficient_lookahead(plain)

    def merge(self, symbols: list[int]) -> tuple[list[int], list[int]]:
        """(tokens, their lengths in symbols): the pair of least rank, leftmost first, merges until none is left."""
        n, rules = len(symbols), self.rules
        symbols, lengths = list(symbols), [1] * n
        after, before, alive = [*range(1, n), -1], [-1, *range(n - 1)], [True] * n
        heap = [(r[0], i, symbols[i], symbols[i + 1], r[1]) for i in range(n - 1) if (r := rules.get((symbols[i], symbols[i + 1])))]
        heapq.heapify(heap)
        while heap:
            _, i, a, b, new = heapq.heappop(heap)
            j = after[i]
            if not alive[i] or j < 0 or symbols[i] != a or symbols[j] != b:
                continue
            symbols[i], alive[j] = new, False
            lengths[i] += lengths[j]
            after[i] = after[j]
            if after[j] >= 0:
                before[after[j]] = i
            for x, y in ((before[i], i), (i, after[i])):
                if x >= 0 and y >= 0 and (r := rules.get((symbols[x], symbols[y]))):
                    heapq.heappush(heap, (r[0], x, symbols[x], symbols[y], r[1]))
        at = [i for i in range(n) if alive[i]]
        return [symbols[i] for i in at], [lengths[i] for i in at]

    def short(self, symbols: list[int]) -> list[int]:
        """The tokens of few symbols: merge without lengths, by a list of the pairs' ranks instead of a heap."""
        get, none = self.codes.get, _NONE
        codes = [get(p, none) for p in zip(symbols, symbols[1:])]
        while codes:
            best = min(codes)
            if best == none:
                break
            at = codes.index(best)
            new = best & _MASK
            symbols[at : at + 2] = [new]
            del codes[at]
            if at:
                codes[at - 1] = get((symbols[at - 1], new), none)
            if at < len(codes):
                codes[at] = get((new, symbols[at + 1]), none)
        return symbols

    def word(self, data: bytes) -> list[int]:
        """The tokens of a whole word; one that is longer than the lookahead goes through a stream."""
        if len(data) > _SHORT:
            open_ = Stream(self)
            return [*open_.feed(data), *open_.end()]
        inner = self.inner
        symbols = [inner[b] for b in data]
        symbols[-1] = self.last[data[-1]]
        return self.short(symbols if None not in symbols else [s for s in symbols if s is not None])


class Stream:
    """The tokens of one word that comes in parts, each as soon as it is stable; a few lookaheads of bytes are held."""

    def __init__(self, merger: Merger):
        self._merger, self._hold, self._room = merger, b"", 4 * (merger.lookahead + 1)

    def feed(self, part: bytes) -> Iterator[int]:
        m = self._merger
        for k in range(0, len(part), self._room):
            self._hold += part[k : k + self._room]
            if len(self._hold) > 2 * self._room:
                # A byte outside the vocabulary is dropped, as the library does without an unknown token.
                known = [b for b in self._hold if m.inner[b] is not None]
                tokens, lengths = m.merge([m.inner[b] for b in known])
                done = 0
                for token, length in zip(tokens, lengths, strict=True):
                    if done + length > len(known) - 1 - m.lookahead:
                        break
                    yield token
                    done += length
                self._hold = bytes(known[done:])

    def end(self) -> list[int]:
        m, hold = self._merger, self._hold
        self._hold = b""
        symbols = [*(m.inner[b] for b in hold[:-1]), *(m.last[b] for b in hold[-1:])]
        return m.merge([s for s in symbols if s is not None])[0]


class Decoder:
    """Bytes in, text out: complete characters leave at once, at most three open bytes are held. Ill-formed bytes become U+FFFD."""

    def __init__(self):
        import codecs

        self._machine = codecs.getincrementaldecoder("utf-8")("replace")

    def feed(self, data: bytes) -> str:
        return self._machine.decode(data)

    def end(self) -> str:
        return self._machine.decode(b"", True)


class Bpe:
    """A lower-casing word BPE: special strings, NFC, white space to one space, lower case, words by pattern, byte letters, merges."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        steps = [x["type"] for x in (spec.get("normalizer") or {}).get("normalizers", [])]
        if model["type"] != "BPE" or steps != ["NFC", "Replace", "Lowercase"] or spec.get("decoder") is not None:
            raise ValueError("only word BPE files with NFC, one space and lower case, and without a decoder, are known here")
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
        self.suffix = model["end_of_word_suffix"] or ""
        self.names = {i: t for t, i in model["vocab"].items()}
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names |= {i: t for t, i in self.special.items()}
        self.merger = Merger(model["vocab"], merges, self.suffix)
        (split,) = [p["pattern"]["Regex"] for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split"]
        self._words = regex.compile(split)
        self._marks = regex.compile("|".join(map(regex.escape, sorted(self.special, key=len, reverse=True)))) if self.special else None
        letter, mark = r"[\p{L}--[\u1160-\u11ff]]{4}", r"[!-&(-/:-@\[-`{-~]{4}"
        self._cuts = regex.compile(rf"(?<={letter})(?={letter})|(?<={mark})(?={mark})|(?<=[0-9])(?=[0-9])", regex.V1)
        self._bytes = {x: b for b, x in enumerate(byte_letters())}
        # Two generations of at most _CACHE chunks and of at most _WORDS words: what is in use moves to the young one, the old one goes as a whole.
        self.forget()

    def forget(self) -> None:
        """Empties the caches, as behind a task: its Python process lives on and goes to other work."""
        self._cache: dict[str, tuple[str, int, str]] = {}
        self._old: dict[str, tuple[str, int, str]] = {}
        self._known: dict[str, tuple[str, int, str]] = {}
        self._known_old: dict[str, tuple[str, int, str]] = {}

    def _normal(self, text: str) -> str:
        import unicodedata

        if not text.isascii():
            text = unicodedata.normalize("NFC", text).replace("Σ", "σ")  # each letter is lowered by itself, without final sigma
        for c in _SPACES:
            if c in text:
                text = text.replace(c, " ")
        return text.lower()

    def _windows(self, text: str) -> Iterator[tuple[str, bool]]:
        """The text in parts of about _WINDOW letters, and whether a word goes on behind the part.

        Cut at a space where one comes soon: no word and no composed letter crosses it. An unbroken text is cut between two digits, or
        within a run of letters or marks that normalisation leaves single and apart.
        """
        at = 0
        while at < len(text):
            end, goes_on = at + _WINDOW, False
            if end < len(text):
                cuts = [p for c in " \n\t" if (p := text.find(c, end, end + _WINDOW)) >= 0]
                if cuts:
                    end = min(cuts)
                else:
                    found = (m.start() for m in self._cuts.finditer(text, end))
                    end = next((p for p in found if not text[p].isalpha() or all(len(x := self._normal(c)) == 1 and x.isalpha() for c in text[p - 1 : p + 1])), len(text))
                    goes_on = end < len(text) and not text[end].isdigit()
            yield text[at:end], goes_on
            at = end

    def _word(self, word: str) -> tuple[str, int, str]:
        """(ids, their number, decoded) of a word."""
        got = self._known.get(word)
        if got is None:
            got = self._known_old.get(word)
            if got is None:
                ids = self.merger.word(word.encode("utf-8", "surrogatepass"))
                got = (" ".join(map(str, ids)), len(ids), self.raw(ids))
            if len(word) <= 64:
                if len(self._known) >= _WORDS:
                    self._known_old, self._known = self._known, {}
                self._known[word] = got
        return got

    def _chunk(self, chunk: str) -> tuple[str, int, str]:
        """(ids, their number, decoded) of what stands between two spaces, unless the young cache has it."""
        got = self._old.get(chunk)
        if got is None:
            words = [w for w in map(self._word, self._words.findall(chunk)) if w[1]]
            got = words[0] if len(words) == 1 else (" ".join([w[0] for w in words]), sum([w[1] for w in words]), " ".join([w[2] for w in words]))
        if len(chunk) <= 64:
            if len(self._cache) >= _CACHE:
                self._old, self._cache = self._cache, {}
            self._cache[chunk] = got
        return got

    def _unbroken(self, window: str, goes_on: bool, open_: Stream | None) -> tuple[list[int], Stream | None]:
        """The stable tokens of a part whose first word may go on from the part before, and the word that is open at its end."""
        words = [w.encode("utf-8", "surrogatepass") for c in self._normal(window).split(" ") for w in self._words.findall(c)]
        ids = []
        if open_:
            ids += open_.feed(words.pop(0))
            if words or not goes_on:
                ids += open_.end()
                open_ = None
        last = words.pop() if goes_on and words else None
        for w in words:
            ids += self.merger.word(w)
        if last is not None:
            open_ = Stream(self.merger)
            ids += open_.feed(last)
        return ids, open_

    def pieces(self, text: str | None) -> Iterator[tuple[str, int, str]]:
        """The document in parts: (ids joined by spaces, their number, what they decode to joined by spaces)."""
        text = text or ""
        at = 0
        for m in [*(self._marks.finditer(text) if self._marks and any(s in text for s in self.special) else ()), None]:
            part = text[at : m.start() if m else len(text)]
            open_ = None
            for window, goes_on in self._windows(part):
                if goes_on or open_:
                    ids, open_ = self._unbroken(window, goes_on, open_)
                    if ids:
                        yield " ".join(map(str, ids)), len(ids), self.raw(ids)
                    continue
                cache = self._cache
                got = [cache.get(c) or self._chunk(c) for c in self._normal(window).split(" ") if c]
                got = [g for g in got if g[1]]
                if got:
                    yield " ".join([g[0] for g in got]), sum([g[1] for g in got]), " ".join([g[2] for g in got])
            if m:
                i = self.special[m[0]]
                yield str(i), 1, self.names[i]
                at = m.end()

    def encode(self, text: str | None) -> list[int]:
        return [int(i) for p in self.pieces(text) for i in p[0].split(" ")]

    def raw(self, ids: Iterable[int]) -> str:
        """What a tokenizer file without a decoder decodes to: the tokens' names, joined by spaces."""
        return " ".join([self.names[i] for i in ids])

    def text(self, ids: Iterable[int]) -> Iterator[str]:
        """Readable text, piece by piece: bytes through the state machine, a space after each word."""
        machine, special = Decoder(), set(self.special.values())
        for i in ids:
            name = self.names[i]
            if i in special:
                yield machine.feed(name.encode())
                continue
            word = bool(self.suffix) and name.endswith(self.suffix)
            yield machine.feed(bytes(self._bytes[c] for c in (name.removesuffix(self.suffix) if word else name)) + b" " * word)
        yield machine.end()


_loaded: dict[str, Bpe] = {}


def load(path: str) -> Bpe:
    """One tokenizer a process and file."""
    if path not in _loaded:
        _loaded[path] = Bpe(path)
    return _loaded[path]


def digests(bpe: Bpe, text: str | None) -> tuple[int, str, str]:
    """(number of tokens, SHA-256 of the ids, SHA-256 of the decoded text), part by part."""
    ids, decoded, n = hashlib.sha256(), hashlib.sha256(), 0
    for a, k, b in bpe.pieces(text):
        if n:
            ids.update(b" ")
            decoded.update(b" ")
        ids.update(a.encode())
        decoded.update(b.encode())
        n += k
    return n, ids.hexdigest(), decoded.hexdigest()


def bpe_digests(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id, n_tokens, ids_sha256, decoded_sha256. `path` is a tokenizer file that every executor has.

    Null and empty texts have no tokens and the digests of nothing. Texts of any length go through in
    windows, unbroken ones too. Rows are independent, so repeated rows and null ids need no care; other columns play no part.
    """

    def run(batches):
        import pyarrow as pa

        bpe = load(path)
        try:
            for batch in batches:
                rows = [digests(bpe, t.as_py()) for t in batch.column(1)]
                columns = list(zip(*rows, strict=True)) or [[]] * 3
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(columns[0], pa.int64()), pa.array(columns[1], pa.string()), pa.array(columns[2], pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])
        finally:
            bpe.forget()

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of `docs`: doc_id and its token ids. Same rules as bpe_digests."""

    def run(batches):
        import pyarrow as pa

        bpe = load(path)
        try:
            for batch in batches:
                ids = pa.array([bpe.encode(t.as_py()) for t in batch.column(1)], pa.list_(pa.int32()))
                yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["doc_id", "ids"])
        finally:
            bpe.forget()

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_digests(table(spark, sf_dir, "documents"), default_path())
