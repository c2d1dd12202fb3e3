"""Token counts and the BPE codec against the tokenizers library."""

import hashlib
import random
from pathlib import Path

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from eventloom.llm import bpe, pretokens, token_count

BYTE, WORD = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("word_bpe_49k.json")
DOCS = "doc_id long, text string, n_tokens string"  # the last one clashes with a result's name


@pytest.fixture(scope="module")
def libraries():
    return Tokenizer.from_file(BYTE), Tokenizer.from_file(WORD)


@pytest.fixture(scope="module")
def counter():
    return token_count.TokenCounter(Path(BYTE).read_text(encoding="utf-8"))


@pytest.fixture(scope="module")
def codecs():
    text = Path(WORD).read_text(encoding="utf-8")
    return bpe.BpeCodec(text), bpe.BpeCodec(text, leaf_chars=40, leaf_symbols=6)  # the second one joins all the time


def texts():
    rnd = random.Random(1)
    fast = [chr(i) for i in range(0x180) if not pretokens.OUTSIDE_FAST.search(chr(i))]
    odd = [*fast, *"'sreltdvm aaa  \n\n" * 6, "<|endoftext|>", "<|startoftext|>", "日本", "é", "İ", "Σς", "\x1c", " ", "😀", "ﬁ", "\x85", "١"]
    yield from (s for c in fast for s in (c, f"a{c}1 {c}", f" {c}{c} b", f"'{c}", f"{c}  x"))
    yield from ("".join(rnd.choices(odd, k=rnd.randint(0, 300))) for _ in range(300))
    yield from ("".join(rnd.choices("abnthe", k=rnd.randint(1, 1200))) for _ in range(60))
    yield from ("".join(rnd.choices(["a", "aa", "!", "-=", "ha"], k=400)) for _ in range(60))


def test_counts_equal_the_librarys(counter, libraries):
    for text in texts():
        assert counter.count(text) == len(libraries[0].encode(text, add_special_tokens=False).ids), text


def test_proven_strings_are_single_tokens(counter, libraries):
    for text in random.Random(2).sample(sorted(counter.counts.whole), 500):
        assert len(libraries[0].encode(text, add_special_tokens=False).ids) == 1


def test_codec_equals_the_library(codecs, libraries):
    for text in texts():
        ids = libraries[1].encode(text, add_special_tokens=False).ids
        for codec in codecs:
            got = codec.encode(text)
            assert got == np.array(ids, "<u4").tobytes(), text
        assert codecs[0].decode(got) == libraries[1].decode(ids, skip_special_tokens=False)


def test_long_texts_with_production_leaves(codecs, libraries):
    rnd = random.Random(9)
    spaced = " ".join("".join(rnd.choices("abcdeéñß'", k=rnd.randint(1, 9))) for _ in range(60000))
    odd = " ".join(rnd.choice(["日本", "e\u0301tat", "x" * 300, "don't", "12345", "!?!"]) for _ in range(40000))
    for text in (spaced, odd, "".join(rnd.choices("abnthe", k=100_000)), "a" * 70_001, " " * 90_000 + "x", "<|endoftext|>".join([spaced[:70_000], odd[:80_000]])):
        assert codecs[0].encode(text) == np.array(libraries[1].encode(text, add_special_tokens=False).ids, "<u4").tobytes()


def test_queries_on_odd_rows(spark, libraries):
    rows = [(1, "Hello world", "x"), (1, "Hello world", "x"), (2, None, None), (None, "", "y"), (3, "word " * 3000, ""), (4, "a" * 5000, "")]
    docs = spark.createDataFrame(rows, DOCS)
    counted = {tuple(r) for r in token_count.count_tokens(docs, BYTE).collect()}
    assert (2, 0, 0, False) in counted and (None, 0, 0, False) in counted
    assert any(r[0] == 3 and r[1] == 15000 and r[3] for r in counted)
    digests = {r["doc_id"]: r for r in bpe.encode_decode_digests(docs, WORD).collect()}
    for doc_id, text, _ in rows:
        ids = libraries[1].encode(text or "", add_special_tokens=False).ids
        assert digests[doc_id]["n_tokens"] == len(ids)
        assert digests[doc_id]["ids_sha256"] == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        assert digests[doc_id]["decoded_sha256"] == hashlib.sha256(libraries[1].decode(ids, skip_special_tokens=False).encode()).hexdigest()
    assert token_count.count_tokens(docs.limit(0), BYTE).count() == 0
    assert bpe.encode_decode(docs.limit(0), WORD).count() == 0


def test_memo_overflow(monkeypatch, libraries):
    monkeypatch.setattr(token_count, "MEMO_ENTRIES", 10)
    monkeypatch.setattr(bpe, "MEMO_ENTRIES", 10)
    counter, codec = token_count.TokenCounter(Path(BYTE).read_text()), bpe.BpeCodec(Path(WORD).read_text())
    text = " ".join(f"zq{i}xv" for i in range(200))
    assert counter.count(text) == len(libraries[0].encode(text).ids)
    assert codec.encode(text) == np.array(libraries[1].encode(text, add_special_tokens=False).ids, "<u4").tobytes()
