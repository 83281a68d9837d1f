"""Byte-level BPE against the tiktoken library."""

import hashlib
import random

import public_tokenizers
import pytest
import tiktoken

from cairn.llm import byte_bpe

PATH = public_tokenizers.path("byte_bpe_50k.tiktoken")


@pytest.fixture(scope="module")
def pair():
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=byte_bpe.read_ranks(PATH), special_tokens={})
    return byte_bpe.load(PATH, public_tokenizers.PATTERN), library


def odd_texts():
    rng = random.Random(0)
    out = ["", " ", "   ", "\n\t ", " \n x", "It's I'LL don't 'tis they've'd", "a" * 5000, "ab" * 3000, " " * 4000 + "x", "<|endoftext|> <unk> <s>", "▁▁ ▁x", "İstanbul", "é ́x", "a\x1cb\x85c\xa0d　e", "１２ ½ Ⅷ ٣", "漢字かな交じり 😀👩‍👩", "\U0001d400؀", "!!!???...", "=" * 2000, "\x00\x01​﻿", "ĠĊġ Ġthe"]
    letters = "aAbeE 'stréÉñ.,!?\n\t09½漢😀ΣİǅǺ #&$▁Ġ"
    out += ["".join(rng.choice(letters) for _ in range(rng.randint(1, 200))) for _ in range(300)]
    out += ["".join(rng.choice("theinganou") for _ in range(4000)) for _ in range(5)]
    return out


def test_same_ids_and_bytes(pair):
    own, library = pair
    for t in odd_texts():
        ids = library.encode_ordinary(t)
        assert own.encode(t) == ids, t
        assert own.decode(ids) == library.decode_bytes(ids) == t.encode()
    assert own.encode(None) == []


def test_every_letter(pair):
    own, library = pair
    for low in range(0, 0x110000, 0x800):
        if low not in range(0xD800, 0xE000) and low not in range(0x34000, 0xE0000) and low < 0xF1000:  # no letters, or as those before
            text = "".join(f"a{chr(c)}b {chr(c)}" for c in range(low, low + 0x800))
            assert own.encode(text) == library.encode_ordinary(text), hex(low)


def test_every_token_is_itself(pair):
    """Also tokens to which merges do not lead."""
    own, _ = pair
    texts = {rank: token.decode("utf-8", "replace") for token, rank in byte_bpe.read_ranks(PATH).items()}
    single = {rank: text for rank, text in texts.items() if "\ufffd" not in text and own._split.findall(text) == [text]}
    got = own._of_words(set(single.values()))
    assert len(single) > 40_000 and all(got[text][0] == str(rank) for rank, text in single.items())


def test_a_token_out_of_reach_of_merges(tmp_path):
    import base64

    ranks = {bytes([b]): b for b in range(256)} | {b"bc": 300, b"ab": 301, b"abcd": 302}  # no pair makes abcd: ranks with gaps, too
    path = tmp_path / "ranks"
    path.write_bytes(b"".join(base64.b64encode(t) + b" %d\n" % r for t, r in ranks.items()))
    own = byte_bpe.ByteBpe(str(path), r"\S+|\s+", spaced=False)
    library = tiktoken.Encoding("tiny", pat_str=r"\S+|\s+", mergeable_ranks=ranks, special_tokens={})
    for t in ["abcd", "abcde abcd", "ab bc abc", "xabcd"]:
        assert own.encode(t) == library.encode_ordinary(t)
    with pytest.raises(ValueError):
        byte_bpe.serialised_model({b"a": 0})


def test_small_caches_and_blocks_change_nothing(pair, monkeypatch):
    _, library = pair
    for name, value in (("_CHUNKS", 3), ("_WORDS", 3), ("_BLOCK", 4), ("_WINDOW", 5), ("_LONGEST", 3)):
        monkeypatch.setattr(byte_bpe, name, value)
    own = byte_bpe.ByteBpe(PATH, public_tokenizers.PATTERN)
    for t in odd_texts()[:60]:
        ids = library.encode_ordinary(t)
        assert own.encode(t) == ids
        assert byte_bpe.digests(own, t) == (len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())
    rng = random.Random(3)
    spaces = ["".join(rng.choice("ab1.é \n\t　") for _ in range(rng.randint(1, 60))) for _ in range(1500)]
    for t in spaces:
        assert own.encode(t) == library.encode_ordinary(t), repr(t)
    monkeypatch.undo()
    for t in spaces:
        assert own.encode(t) == library.encode_ordinary(t), repr(t)
    own.forget()
    assert own.encode("the cat") == library.encode_ordinary("the cat")


def test_operator(spark, pair):
    own, library = pair
    texts = [None, "", "the cat", "the cat", "x" * 20000 + " " + "word " * 30000]
    rows = [(k if k != 3 else None, t, "a", 1) for k, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, ids string, n_tokens int")
    got = {(r.doc_id, r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.byte_bpe_digests(df, PATH, public_tokenizers.PATTERN).collect()}
    assert got == {(r[0], *byte_bpe.digests(own, r[1])) for r in rows}
    assert byte_bpe.byte_bpe_digests(df.limit(0), PATH, public_tokenizers.PATTERN).count() == 0
    encoded = byte_bpe.encode_documents(df, PATH, public_tokenizers.PATTERN)
    assert {(r.doc_id, tuple(r.ids)) for r in encoded.collect()} == {(r[0], tuple(library.encode_ordinary(r[1] or ""))) for r in rows}
    back = byte_bpe.decode_documents(encoded, PATH, public_tokenizers.PATTERN)
    assert sorted(bytes(r.content) for r in back.collect()) == sorted((t or "").encode() for t in texts)


def test_query_equals_the_library(spark, pair):
    _, library = pair
    folder = "/root/testdata/sf0.01"
    got = {r.doc_id: (r.n_tokens, r.ids_sha256, r.decoded_sha256) for r in byte_bpe.op13_byte_bpe(spark, folder).collect()}
    docs = spark.read.parquet(f"{folder}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(docs)
    for r in docs:
        ids = library.encode_ordinary(r.text or "")
        sha = lambda b: hashlib.sha256(b).hexdigest()
        assert got[r.doc_id] == (len(ids), sha(" ".join(map(str, ids)).encode()), sha((r.text or "").encode()))
