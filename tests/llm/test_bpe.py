import hashlib
import random

import numpy as np
import pytest

from tremorlake.llm import bpe
from tremorlake.llm.queries import vocab_path

EDGE = ["", " ", "\n\t", "a", "aaaaaaaaaaaa", "İstanbul ΣΑΣ ς ǅ", "é̀ Å ﬁ Å", "<|endoftext|>a b<|startoftext|><|endoftext|", "<|ENDOFTEXT|>", "it's I'LL 12345 ٣ Ⅷ ²", "日本語 テスト 👩‍👩‍👧 \x00\x1c\x1d\x85​ ﻿", "x" * 5000 + "　" + "é" * 300, "'s't're 've'm'll'd ''", "퟿\U0010ffff"]


@pytest.fixture(scope="module")
def ref():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(vocab_path("word_bpe_49k.json"))
    t.no_truncation()
    t.no_padding()
    return t


def random_text(r):
    pools = ["abcdefghij ETAOIN shrdlu ", "éèàçñüöß ÄÖÜ", "0123456789.,;!?'\"()-_<|>", "αβγδΣς ЖЙя", "中文字 かな", " \t\n\r\x0b\x0c  ", "".join(chr(r.randrange(1, 0xD800)) for _ in range(20))]
    return "".join(r.choice(r.choice(pools)) for _ in range(r.randrange(0, 200)))


def same(enc, ref, texts):
    for t, ids, want in zip(texts, enc.encode_batch(texts), ref.encode_batch(texts, add_special_tokens=False), strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == want.ids, t
        assert enc.decode(ids) == ref.decode(want.ids, skip_special_tokens=False)


def test_matches_the_library(ref):
    enc = bpe.WordBpe(bpe.load_spec(vocab_path("word_bpe_49k.json")))
    same(enc, ref, EDGE)
    r = random.Random(1)
    for _ in range(20):
        same(enc, ref, [random_text(r) for _ in range(100)])


def test_small_cache_changes_nothing(ref, monkeypatch):
    monkeypatch.setattr(bpe, "CACHE_WORDS", 10)
    monkeypatch.setattr(bpe, "CACHE_CHARS", 4)
    r = random.Random(2)
    enc = bpe.WordBpe(bpe.load_spec(vocab_path("word_bpe_49k.json")))
    for _ in range(5):
        same(enc, ref, [random_text(r) for _ in range(50)])


def test_rows(spark, ref):
    df = spark.createDataFrame([(1, None, 3), (2, "", 4), (2, "Hello world", 5), (2, "Hello world", 5), (None, "x", 6)], "doc_id long, text string, n_tokens int")
    rows = bpe.encode(df, vocab_path("word_bpe_49k.json")).collect()
    assert sorted((r.doc_id or 0, r.n_tokens) for r in rows) == [(0, 1), (1, 0), (2, 0), (2, 2), (2, 2)]
    assert {r.ids_sha256 for r in rows if r.n_tokens == 0} == {hashlib.sha256(b"").hexdigest()}
    hello = next(r for r in rows if r.n_tokens == 2)
    assert hello.ids == ref.encode("Hello world", add_special_tokens=False).ids
    assert bpe.encode(df.limit(0), vocab_path("word_bpe_49k.json")).count() == 0
