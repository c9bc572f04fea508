import math
import random
import re
from collections import Counter

import pyarrow as pa

from tremorlake.llm import fertility
from tremorlake.llm.queries import FERTILITY, vocab_path

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(text):
    text = text or ""
    words = WORD.findall(text)
    w = [tuple(words[i : i + 5]) for i in range(len(words) - 4)]
    c = Counter(w)
    rep = {i + k for i, x in enumerate(w) if c[x] > 1 for k in range(5)}
    seen, dup = set(), 0
    for line in text.split("\n"):
        if WORD.search(line):
            dup += line in seen
            seen.add(line)
    failed = len(words) < 10 or 100 * len(rep) > 20 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), dup, len(rep), failed


def test_base_against_brute_force(spark):
    r = random.Random(5)
    texts = [None, "", " \t\n\x0b\x0c\r", "a b c d e " * 40, "x\x1cy\x85z\xa0q w e r t y u i o p", "l\nl\nl \n\n \nl", "ü # | <> é\n" * 30, "w " * 30_000]
    texts += [" ".join(r.choice("abcdefg") for _ in range(r.randrange(0, 60))) for _ in range(200)] + ["\n".join(str(r.randrange(9000)) + r.choice([" ", "\n", "\t"]) for _ in range(r.randrange(3000))) for _ in range(20)]
    df = spark.createDataFrame([(i, t, "xx", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    for x in fertility.measure(df, vocab_path("piece_bpe_32k.model")).collect():
        assert (x.n_words, x.word_chars, x.n_symbols, x.n_dup_lines, x.n_repeat_words, x.base_failed) == brute(texts[x.doc_id]), x.doc_id
        assert not (x.base_failed and x.kept)
    assert fertility.measure(df.limit(0), vocab_path("piece_bpe_32k.model")).count() == 0


def test_bands(spark):
    clean = "The quick brown fox jumps over the lazy dog while seven other animals quietly watch the evening river"
    junk = " ".join(f"{w}***$$$" for w in clean.split())
    rows = [(1, clean, "en"), (2, junk, "en"), (3, clean.upper().replace(" ", "!! "), "en"), (4, "ᚠᛇᚻ᛫ᛒᛦᚦ᛫ᚠᚱᚩᚠᚢᚱ " * 3 + " ".join("ᚠᛇᚻ" + c for c in "ᛒᛦᚦᚠᚱᚩᚠᚢᚱ"), "en"), (5, clean, None), (5, clean, None)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    got = {x.doc_id: x for x in fertility.measure(df, vocab_path("piece_bpe_32k.model")).collect()}
    assert [got[i].kept for i in (1, 2, 3, 4, 5)] == [True, False, False, False, True]
    assert got[4].byte_share_0 > 0.5 and "byte_fallback" in got[4].reasons
    kept = fertility.keep_good(df, vocab_path("piece_bpe_32k.model")).collect()
    assert sorted((r.doc_id, r.text) for r in kept) == [(1, clean), (5, clean), (5, clean)]


def test_scripts():
    assert [fertility.script_of(t) for t in ("abc", "", "абв a", "αβγ", "日本語", "éa")] == ["latin", "latin", "cyrillic", "greek", "cjk", "latin"]


def plain_measures(words, encode, is_byte):
    """Characters a token, byte-fallback share and token entropy, word by word."""
    tokens = [t for w in words for t in encode(w)]
    n = len(tokens)
    if not n:
        return None, 0.0, 0.0
    return sum(map(len, words)) / n, sum(map(is_byte, tokens)) / n, -sum(c / n * math.log2(c / n) for c in Counter(tokens).values()) + 0.0


def test_measures_against_plain_encoding(spark):
    import base64

    import sentencepiece
    import tiktoken

    paths = [vocab_path(v) for v in FERTILITY]
    sp = sentencepiece.SentencePieceProcessor(model_file=paths[0])
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(paths[1], "rb"))}
    back = {i: t for t, i in ranks.items()}
    enc = tiktoken.Encoding("own", pat_str=r" ?\p{L}+|\p{N}+|[^\p{L}\p{N}]+", mergeable_ranks=ranks, special_tokens={})
    plain = [(sp.encode, sp.is_byte), (lambda w: enc.encode_ordinary(" " + w), lambda i: len(back[i]) == 1 and back[i][0] > 127)]
    r = random.Random(2)
    kinds = ["water", "Erdbeben", "ᚠᛇᚻ", "日本", "x9$$", "été", "12.5", "\U0001d11e", "naïve\x85co-op"]
    texts = [None, "", "one"] + [r.choice([" ", "\n\t"]).join(r.choices(kinds, k=r.randrange(1, 90))) for _ in range(700)]
    df = spark.createDataFrame([(i, t, None) for i, t in enumerate(texts)], "doc_id long, text string, lang string")
    for x in fertility.measure(df, paths).collect():
        for k, (encode, is_byte) in enumerate(plain):
            want = plain_measures(WORD.findall(texts[x.doc_id] or ""), encode, is_byte)
            got = [x[f"{c}_{k}"] for c in ("chars_per_token", "byte_share", "token_entropy")]
            assert all((a is None and b is None) or abs(a - b) < 1e-9 for a, b in zip(got, want)), x.doc_id


def test_bands_of_the_table(spark):
    # each band rejects what it is for, whatever the level of the language's own texts
    r = random.Random(7)
    prose = lambda n, vocab: " ".join(r.choice(vocab) for _ in range(n))
    en = [f"{a}{b}" for a in ("water", "river", "quake", "signal", "under", "stone") for b in ("", "s", "ed", "ing", "er", "like")]
    xx = [f"zq{a}{b}" for a in ("vx", "jk", "wv", "xh", "qq", "zz") for b in ("ø", "bb", "kk", "vw", "hh", "jj")]
    rows = [(i, prose(150, en), "en") for i in range(120)] + [(200 + i, prose(150, xx), "xx") for i in range(120)]
    odd = {900: " ".join(f"#{w}$%" for w in prose(150, en).split()), 901: prose(40, en) + " " + " ".join(f"ᚠ{k}ᛇᚻ" for k in range(80)), 902: " ".join(["water", "river"] * 1 + [f"water{k % 3}" for k in range(40)] + r.choices(["river", "rivers"], k=120)), 903: " ".join(["underlying", "internationally", "nevertheless", "communication", "administrative"][k * k % 5] for k in range(400)), 904: prose(150, xx)}
    rows += [(i, t, "en") for i, t in odd.items()]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    got = {x.doc_id: x for x in fertility.measure(df, [vocab_path(v) for v in FERTILITY]).collect()}
    assert all(got[i].kept for i, *_ in rows if i < 900)
    assert "chars_per_token" in got[900].reasons and "byte_fallback" in got[901].reasons and "token_entropy" in got[902].reasons and "chars_per_token" in got[903].reasons and not got[904].kept
    kept = fertility.keep_good(df.withColumn("_m_lang", df.lang), [vocab_path(v) for v in FERTILITY])
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, x in got.items() if x.kept) and kept.columns == df.columns


def test_windows_of_equal_hashes(monkeypatch):
    import numpy as np

    rolling = fertility.rolling
    monkeypatch.setattr(fertility, "rolling", lambda r, width: rolling(r, width) & np.uint64(1))
    r = random.Random(1)
    texts = [" ".join(r.choice("abcd") for _ in range(r.randrange(80))) for _ in range(50)]
    words = [t.split() for t in texts]
    codes = np.array([ord(w) for x in words for w in x], np.int64)
    got = fertility.repeated_words(codes, np.repeat(np.arange(50), [len(x) for x in words]), 50)
    assert got.tolist() == [brute(t)[4] for t in texts]


def test_parts_are_cut_by_bytes(monkeypatch):
    monkeypatch.setattr(fertility, "TEXTS", 3)
    monkeypatch.setattr(fertility, "TEXT_BYTES", 10)
    texts = ["aaaa", None, "", "bbbb", "é" * 6, "x", "y" * 40, "z" * 10, "", "w"]
    got = fertility.parts(pa.array(texts))
    assert got == [(0, 3), (3, 1), (4, 1), (5, 1), (6, 1), (7, 2), (9, 1)]
    assert fertility.parts(pa.array([], pa.string())) == []


def test_long_texts_measure_the_same_side_by_side_and_alone():
    with open(vocab_path(FERTILITY[0]), "rb") as f:
        vocabs = [(FERTILITY[0], f.read())]
    texts = ["the slow fault creeps and the tremor follows " * 8_000, "word " * 3, None, "x" * 300_000]
    together = fertility.Fertility(vocabs).columns(texts)
    for i, t in enumerate(texts):
        alone = fertility.Fertility(vocabs).columns([t])
        for k in ("n_words", "word_chars", "n_repeat_words", "n_tokens_0", "byte_share_0"):
            assert together[k][i] == alone[k][0], (i, k)
        assert abs(together["token_entropy_0"][i] - alone["token_entropy_0"][0]) < 1e-9
