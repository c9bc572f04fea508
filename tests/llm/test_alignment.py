import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from tokenizers import Tokenizer

from tremorlake.llm import alignment as A
from tremorlake.llm.queries import vocab_path

FILES = vocab_path("byte_bpe_50k.json"), vocab_path("piece_bpe_32k.model")
SCHEMA = "doc_id long, text string, n_a int, h string, id string"


@pytest.fixture(scope="module")
def plain_groups():
    """Plain: whole texts are encoded by both libraries, and cut where both end."""
    a = Tokenizer.from_file(FILES[0])
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=FILES[1])
    letters = {}
    spare = 256
    for x in range(256):
        own = 33 <= x <= 126 or 161 <= x <= 172 or 174 <= x <= 255
        letters[chr(x if own else spare)] = x
        spare += not own

    def bytes_b(i):
        piece = b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if re.fullmatch("<0x[0-9A-F]{2}>", piece) else piece.replace("▁", " ").encode()

    def f(text):
        if not text:
            return []
        want = (" " + text).encode()
        ta = [(i, bytes(letters[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        tb = [(i, bytes_b(i)) for i in b.encode(text)]
        if b"".join(x for _, x in ta) != want or b"".join(x for _, x in tb) != want:
            return []
        ends_a, ends_b = (dict(zip(np.cumsum([len(x) for _, x in t]).tolist(), range(1, len(t) + 1))) for t in (ta, tb))
        out, i, j = [], 0, 0
        for e in sorted(ends_a.keys() & ends_b.keys()):
            out.append(([x for x, _ in ta[i : ends_a[e]]], [x for x, _ in tb[j : ends_b[e]]]))
            i, j = ends_a[e], ends_b[e]
        return out

    return f


def expected(rows, groups):
    found = [groups(r[1]) for r in rows]
    count = Counter()
    for g in found:
        count.update({(x, y) for a, b in g for x in a for y in b})
    best = Counter()
    for (x, _), n in count.items():
        best[x] = max(best[x], n)
    out = Counter()
    for r, g in zip(rows, found):
        links = [(x, y) for a, b in g for x in a for y in b]
        text = ";".join(",".join(map(str, a)) + "|" + ",".join(map(str, b)) for a, b in g)
        out[r[0], sum(len(a) for a, _ in g), sum(len(b) for _, b in g), len(g), len(links), sum(count[x] == best[x[0]] for x in links), sum(count[x] for x in links), hashlib.sha256(text.encode()).hexdigest() if g else ""] += 1
    return out


ODD = [
    None, "", " ", "  ", "a", " a", "a ", "  a  b ", "a\n b", "a \nb", "\n", "\t x", "a  b", "a  b", "▁", "a▁b c", "x ▁ y", "<s>hi</s> <|endoftext|> x", "don't we'll I'M", "水は川 東京",
    "\U0001f600 \U0001f468‍\U0001f469‍\U0001f467", "é ﬁ １２", "a" * 3000, "ab" * 2000, "   " * 500 + "x", "12345 678 9", "\x00 \x1c \x85 b", "= = = ----- ", "x\r\n\r\ny", "ภาษา हिन्दी",
]


def some_rows(seed, n):
    r = random.Random(seed)
    words = ["the", "The", "water", "wasserfall", "été", "un", "123", "foo-bar", "x.y", "\n", "", " ", "中文", "don't", "zzzqx"]
    texts = [*ODD, *(r.choice([" ", " ", "\n", "  "]).join(r.choices(words, k=r.randrange(1, 40))) for _ in range(n))]
    return [*((i, t, 0, "h", "id") for i, t in enumerate(texts)), (3, "the water", 0, "h", "id"), (3, "the water", 0, "h", "id"), (None, "the water", 0, "h", "id"), (None, "123", 0, "h", "id")]


@pytest.mark.parametrize("block,shard,held,cache,large,batch", [(1 << 22, 1 << 15, 1 << 20, 200_000, 1 << 16, 2_000_000), (40, 10, 30, 40, 2, 300)])
def test_against_plain(spark, monkeypatch, plain_groups, block, shard, held, cache, large, batch):
    # several blocks of small shards, counts sent on in parts, segments forgotten, groups counted by distinct ids
    for k, v in {"BLOCK_KEYS": block, "SHARD_KEYS": shard, "HELD_PAIRS": held, "CACHE_SEGMENTS": cache, "LARGE_GROUP": large, "BATCH_CHARS": batch, "FAN_IN": 2}.items():
        monkeypatch.setattr(A, k, v)
    rows = some_rows(block, 60)
    df = spark.createDataFrame(rows, SCHEMA).repartition(3)
    assert Counter(map(tuple, A.align(df, *FILES).collect())) == expected(rows, plain_groups)


def test_empty_table_and_no_tokens(spark):
    assert A.align(spark.createDataFrame([], SCHEMA), *FILES).count() == 0
    assert [tuple(r) for r in A.align(spark.createDataFrame([(1, None, 0, "", "")], SCHEMA), *FILES).collect()] == [(1, 0, 0, 0, 0, 0, 0, "")]


@pytest.mark.parametrize("n,shards", [(0, 1), (1, 1), (1000, 1), (5000, 7)])
def test_hash_is_minimal_and_perfect(n, shards):
    r = np.random.default_rng(n)
    keys = np.unique(r.integers(0, 1 << 48, n))
    other = np.setdiff1d(r.integers(0, 1 << 48, 500), keys)
    shard = (A.mix(keys, 99) % np.uint64(shards)).astype(int)
    rows = []
    for s in range(shards):
        sizes, bits, order = A.levels_of(keys[shard == s])
        rows.append({"shard": s, "sizes": sizes, "bits": np.packbits(bits).tobytes(), "keys": order})
    table = A.PerfectHash(shards, rows)
    assert sorted(table.find(keys)) == list(range(len(keys)))
    assert (table.find(other) == -1).all()
