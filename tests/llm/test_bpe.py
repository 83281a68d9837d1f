"""BPE against the tokenizers library."""

import hashlib
import random

import pytest
from tokenizers import Tokenizer

from cairn.llm import bpe


@pytest.fixture(scope="module")
def pair():
    return bpe.load(bpe.default_path()), Tokenizer.from_file(bpe.default_path())


def odd_texts():
    rng = random.Random(0)
    out = [None, "", " ", "\n\t", "It's I'LL don't 'tis", "a" * 5000, "ab" * 3000, "<|endoftext|>", "x<|startoftext|>Y<|endoftext|><|endoftext|> z", "<|endoftext", "ΟΔΟΣ ΣΑΣ", "İstanbul", "é ́x", "a b c\x1cd\x85e", "１２ ½ Ⅷ ٣", "漢字かな交じり 😀👩‍👩", "\U0001d400؀", "!!!???...", "a" + "!" * 2000, "ﬁ ẞ ß", "\x00\x01​﻿"]
    out += [f"a{chr(c)}b" for c in (*range(0x21), *range(0x7F, 0xAE), 0x1680, 0x180E, *range(0x2000, 0x2010), *range(0x2028, 0x2030), 0x205F, 0x3000, 0xFEFF)]
    letters = "aAbeE 'stréÉñ.,!?\n\t09½漢😀ΣİǅǺ #&$"
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    out += ["".join(rng.choice("theinganou") for _ in range(4000)) for _ in range(5)]
    return out


def test_same_ids_and_decoding(pair):
    own, library = pair
    for t in odd_texts():
        ids = library.encode(t or "", add_special_tokens=False).ids
        assert own.encode(t) == ids, t
        assert " ".join(p[2] for p in own.pieces(t)) == library.decode(ids, skip_special_tokens=False)


def test_windows_change_nothing(pair, monkeypatch):
    own, library = pair
    text = "the Étang isn't é as\ttall, as I'll say " * 400 + "x" * 3000
    monkeypatch.setattr(bpe, "_WINDOW", 50)
    assert own.encode(text) == library.encode(text, add_special_tokens=False).ids


def test_unbroken_texts_go_in_windows(pair, monkeypatch):
    own, library = pair
    rng = random.Random(6)
    monkeypatch.setattr(bpe, "_WINDOW", 60)
    texts = ["x" * 5000, "=" * 4000, "7" * 3000, "漢字" * 1500, "don't" * 600, "İ" * 900, "한" * 700, "é́" * 800, "a'll" * 500 + " b " + "q" * 300]
    texts += ["".join(rng.choice("theinganou") for _ in range(3000)), "".join(rng.choice("aбéİ漢7=!'") * rng.randint(1, 30) for _ in range(300)), "".join(rng.choice("abİσΣ") for _ in range(4000)) + "!" * 500 + " end"]
    for t in texts:
        windows = list(own._windows(t))
        assert "".join(w for w, _ in windows) == t
        assert own.encode(t) == library.encode(t, add_special_tokens=False).ids, t[:20]
    assert max(len(w) for w, _ in own._windows("x" * 300_000)) < 200 and max(len(w) for w, _ in own._windows("漢字" * 9000)) < 200


def test_lookahead_is_sufficient(pair):
    merger, rng = pair[0].merger, random.Random(1)
    assert 0 < merger.lookahead < 1000
    for _ in range(20):
        word = bytes(rng.choice(b"theinganoursxz") for _ in range(20_000))
        cuts = sorted(rng.sample(range(20_000), 12))
        parts = [word[a:b] for a, b in zip([0, *cuts], [*cuts, 20_000], strict=True)]
        whole = merger.merge([*(merger.inner[b] for b in word[:-1]), merger.last[word[-1]]])[0]
        stream = bpe.Stream(merger)
        assert [t for part in parts for t in stream.feed(part)] + stream.end() == whole
    # And by brute force for small merge lists: the bound holds for every continuation.
    for _ in range(200):
        merges, known = [], ["a", "b", "c"]
        for _ in range(6):
            u, v = rng.choice(known), rng.choice(known)
            if u + v not in known:
                merges.append((u, v))
                known.append(u + v)
        vocab = {t: i for i, t in enumerate([*bpe.byte_letters(), *(x for x in known if len(x) > 1)])}
        small = bpe.Merger(vocab, merges, "")
        word = bytes(rng.choice(b"abc") for _ in range(3000))
        stream = bpe.Stream(small)
        assert [*stream.feed(word), *stream.end()] == small.merge([small.inner[b] for b in word])[0]


def test_readable_round_trip(pair):
    own, _ = pair
    text = "été 漢字 😀 the end"
    assert "".join(own.text(own.encode(text))).split() == text.split()
    machine = bpe.Decoder()
    assert [machine.feed(bytes([b])) for b in "é😀".encode()] + [machine.end()] == ["", "é", "", "", "", "😀", ""]


def test_query_rows(pair, spark):
    own, library = pair
    rows = [(i, t, "x") for i, t in enumerate(odd_texts()[:40])] + [(None, "a b", "y"), (3, "a b", "y")]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string")
    got = sorted(map(tuple, bpe.bpe_digests(df, bpe.default_path()).collect()), key=repr)
    want = []
    for i, t, _ in rows:
        ids = library.encode(t or "", add_special_tokens=False).ids
        want.append((i, len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(library.decode(ids, skip_special_tokens=False).encode()).hexdigest()))
    assert got == sorted(want, key=repr)
    assert bpe.encode_documents(df.where("doc_id = 4"), bpe.default_path()).first().ids == own.encode(rows[4][1])
    assert bpe.bpe_digests(df.limit(0), bpe.default_path()).count() == 0
