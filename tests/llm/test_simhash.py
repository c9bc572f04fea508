import random

import numpy as np
import pytest
import xxhash

from tremorlake.llm import simhash


def brute_fp(text):
    w = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "").encode().split()
    sh = [b" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    hs = [xxhash.xxh64_intdigest(s, 42) for s in sh]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hs) > len(hs))


def brute_components(fps):
    parent = dict.fromkeys(fps)
    parent = {f: f for f in parent}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    keys = list(parent)
    for i, a in enumerate(keys):
        for b in keys[:i]:
            if (a ^ b).bit_count() <= 2:
                parent[max(root(a), root(b))] = min(root(a), root(b))
    return {f: root(f) for f in keys}


def some_fps(r, n, hot):
    out = {0, 1, 3, (1 << 64) - 1}
    seeds = [r.getrandbits(64) for _ in range(n // 8)] + [0x1234567890ABCDEF]
    while len(out) < n:
        f = r.choice(seeds) if r.random() > hot else seeds[-1]
        for _ in range(r.choice([0, 1, 2, 3, 4])):
            f ^= 1 << r.randrange(64)
        out.add(f)
    return sorted(out)


def test_fingerprints(spark):
    r = random.Random(1)
    texts = [None, "", " ", "One", "one TWO", "a b c", "ÀB c\x85d e", "x y z " * 500] + [" ".join(r.choice("the of and tremor fault depth É".split()) for _ in range(r.randrange(1, 600))) for _ in range(60)]
    got = {x.doc_id: x.fp for x in simhash.fingerprints(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    assert {i: g % (1 << 64) for i, g in got.items()} == {i: brute_fp(t) for i, t in enumerate(texts)}


def test_index_finds_all_pairs():
    r = random.Random(2)
    for hot in (0, 0.7):
        fps = some_fps(r, 600, hot)
        fp = np.array(fps, np.uint64)
        fp = fp[np.argsort(simhash.gray_rank(fp), kind="stable")]
        got = {(int(fp[a]), int(fp[b])) for i, j in simhash.GrayIndex(np.zeros(len(fp), np.int64), fp).pairs() for a, b in zip(i, j)}
        want = {frozenset((a, b)) for k, a in enumerate(fps) for b in fps[:k] if (a ^ b).bit_count() <= 2}
        assert {frozenset(p) for p in got} == want and len(got) == len(want)


@pytest.mark.parametrize("hot_group", [4096, 5])
def test_components_against_brute_force(spark, monkeypatch, hot_group):
    monkeypatch.setattr(simhash, "HOT_GROUP", hot_group)
    r = random.Random(hot_group)
    fps = some_fps(r, 800, 0.4)
    signed = [f - (1 << 64) if f >> 63 else f for f in fps]
    e = simhash.links(spark.createDataFrame([(f,) for f in signed], "fp long"))
    roots = {x.v % (1 << 64): x.root % (1 << 64) for x in simhash.components(e).collect()}
    want = brute_components(fps)
    classes = lambda m: {frozenset(k for k in fps if m.get(k, k) == v) for v in {m.get(k, k) for k in fps}}
    assert classes(roots) == classes(want)


def test_long_chain(spark):
    n = 300
    edges = spark.createDataFrame([((i * 7919) % n, ((i + 1) * 7919) % n) for i in range(n - 1)], "a long, b long")
    got = simhash.components(edges).collect()
    assert {x.root for x in got} == {0} and len(got) == n - 1


def test_rows(spark):
    base = " ".join(f"w{i}" for i in range(200))
    rows = [(7, base, "p"), (3, base.upper(), "q"), (9, base + " tail", "r"), (5, None, "s"), (6, "", "t"), (None, "", "u"), (8, "other words entirely", "v"), (8, "other words entirely", "v")]
    df = spark.createDataFrame(rows, "doc_id long, text string, fingerprint string")
    got = {}
    for x in simhash.near_duplicates(df).collect():
        got.setdefault(x.doc_id, []).append(x)
    assert got[7][0].component_id == got[3][0].component_id == got[9][0].component_id == 3 or (brute_fp(base) ^ brute_fp(base + " tail")).bit_count() > 2
    assert got[5][0].fingerprint == "0" * 16 and got[6][0].component_id == 5 and got[None][0].component_id == 5
    assert len(got[8]) == 2 and got[8][0].fingerprint == f"{brute_fp('other words entirely'):016x}"
    kept = sorted((x.doc_id or -1, x.fingerprint) for x in simhash.keep_one(df).collect())
    assert kept == [(3, "q"), (5, "s"), (8, "v")]
    assert simhash.near_duplicates(df.limit(0)).count() == 0 and simhash.keep_one(df.limit(0)).count() == 0


def test_rows_of_one_id_are_judged_by_themselves(spark):
    a, b, c = (" ".join(f"{w}{i}" for i in range(80)) for w in "abc")
    rows = [(1, a), (5, a), (5, b), (5, b), (None, c), (None, c + " end"), (7, None)]
    kept = simhash.keep_one(spark.createDataFrame(rows, "_gone long, text string"), "_gone").collect()
    assert sorted((r._gone or 0, r.text or "") for r in kept if r._gone) == [(1, a), (5, b), (7, "")]
    assert [r.text for r in kept if r._gone is None] in ([c], [c + " end"])


def similarity(a, b):
    a, b = ({tuple(w[i : i + 5]) for i in range(len(w) - 4)} for w in (a.split(), b.split()))
    return len(a & b) / len(a | b)


@pytest.mark.parametrize("hot_group,broadcast", [(4096, 10**6), (8, 0)])
def test_near_copies_against_brute_force(spark, monkeypatch, hot_group, broadcast):
    monkeypatch.setattr(simhash, "HOT_GROUP", hot_group)
    monkeypatch.setattr(simhash, "BROADCAST_ROWS", broadcast)
    monkeypatch.setattr(simhash, "PIVOTS", 4)
    r = random.Random(12)
    word = lambda: f"w{int(r.paretovariate(0.6)) % 5000}"
    texts = [" ".join(word() for _ in range(r.choice([40, 150, 600]))) for _ in range(400)]
    pairs = []
    for i in range(300):
        words = texts[i].split()
        share = r.choice([0.005, 0.01, 0.015, 0.02])
        pairs.append((i, " ".join(word() if r.random() < share else w for w in words)))
    hot = texts[399].split()  # many copies of one text, each with a word of its own
    many = [" ".join(f"own{k}" if j == k % len(hot) else w for j, w in enumerate(hot)) for k in range(200)]
    rows = [*enumerate(texts), *((1000 + i, t) for i, t in pairs), *((5000 + k, t) for k, t in enumerate(many))]
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    assert set(range(400)) <= kept and not any(k >= 5000 for k in kept)
    near = [i for i, t in pairs if similarity(texts[i], t) >= 0.8]
    caught = [i for i in near if 1000 + i not in kept]
    assert len(near) > 150 and len(caught) >= 0.9 * len(near)
    assert all(similarity(texts[i], t) > 0.5 for i, t in pairs if 1000 + i not in kept)


def shingles(text):
    w = text.lower().split()
    return frozenset(tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))) if w else frozenset()


def brute_kept(rows):
    """Smallest ids of the components of the links at a similarity of 0.8 and more."""
    sets = [(i, shingles(t)) for i, t in rows]
    root = {i: i for i, _ in rows}

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, (i, a) in enumerate(sets):
        for j, b in sets[:k]:
            both = len(a & b)
            if a == b or 9 * both >= 4 * (len(a) + len(b)) and both:
                x, y = top(i), top(j)
                root[max(x, y)] = min(x, y)
    return {i for i, _ in rows if top(i) == i}


@pytest.mark.parametrize("hot_group", [4096, 6])
def test_no_link_of_the_threshold_is_left_out(spark, monkeypatch, hot_group):
    monkeypatch.setattr(simhash, "HOT_GROUP", hot_group)
    r = random.Random(31)
    word = lambda: f"w{r.randrange(4000)}"
    text = lambda n: [word() for _ in range(n)]
    texts = []
    for n in (5, 8, 9, 24, 104, 204):  # pairs from 0.7 to 0.9 by words at the end, many at 0.8 itself
        for k in range(40):
            a = text(n)
            cut = max(1, round((n - 4) * (0.2 if k % 2 else r.uniform(0.1, 0.3))))
            texts += [a, a[:-cut] if k % 3 else a[: -cut // 2] + text(cut // 2)]
    base = text(124)  # one large group, of which some are linked by others only
    for _ in range(60):
        a = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5])):
            a[r.randrange(len(a))] = word()
        texts.append(a)
    passage = text(60)  # long and common, but below the threshold
    texts += [text(r.choice([5, 15, 30])) + passage + text(4) for _ in range(60)]
    rows = list(enumerate(" ".join(t) for t in texts))
    r.shuffle(rows)
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute_kept(rows)
    assert kept == want and len(rows) - len(want) > 150


def test_candidate_keys_hold_a_shared_shingle():
    r = np.random.default_rng(4)
    often = r.choice(np.arange(1, 400, dtype=np.uint64), 90, replace=False)
    by_hash = np.argsort(often)
    for n in range(1, 120):
        a = np.sort(r.choice(np.arange(400, dtype=np.uint64), n, replace=False))
        b = a[r.permutation(n)[: -(-4 * n // 5)]]
        keys = [set(simhash.candidate_keys(np.sort(x), often[by_hash], by_hash).tolist()) for x in (a, b)]
        assert len(keys[0]) == n // 5 + 1 and keys[0] & keys[1]


def test_parities_never_exceed_what_one_set_has_alone():
    r = np.random.default_rng(7)
    sets = [np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64)) for n in (0, 1, 5, 40, 300, 2000)]
    sets += [np.unique(np.r_[s[len(s) // 9 :], r.integers(0, 1 << 63, len(s) // 9, dtype=np.uint64)]) for s in sets]
    bits = simhash.parities(sets)
    for a, x in zip(sets, bits, strict=True):
        for b, y in zip(sets, bits, strict=True):
            alone = len(np.setxor1d(a, b))
            differ = int(np.bitwise_count(x ^ y).sum())
            assert differ <= alone and differ % 2 == alone % 2
    assert not bits[0].any() and np.bitwise_count(bits[1] ^ bits[0]).sum() == 1 and simhash.parities([]).shape == (0, simhash.NEAR_WORDS)


def hot_texts(r, n, words=124):
    """Near copies of one text, of which about half are at 0.8 or more from it and few of the others from any."""
    base = [f"w{r.randrange(4000)}" for _ in range(words)]
    out = [list(base)]
    for _ in range(n - 1):
        a = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 5, 6])):
            a[r.randrange(words)] = f"own{r.randrange(10**6)}"
        out.append(a)
    return [" ".join(a) for a in out]


def compared(monkeypatch):
    """What the pairs that are compared by their shingles come to."""
    seen, real = [], simhash.similar
    monkeypatch.setattr(simhash, "similar", lambda pairs, *more: (seen.extend((x.a, x.b) for x in pairs.collect()), real(pairs, *more))[1])
    return seen


@pytest.mark.parametrize("hot_group", [4096, 150])
def test_a_large_group_of_near_copies_is_not_compared_pair_by_pair(spark, monkeypatch, hot_group):
    monkeypatch.setattr(simhash, "HOT_GROUP", hot_group)
    r = random.Random(77)
    rows = list(enumerate(hot_texts(r, 500)))
    r.shuffle(rows)
    seen = compared(monkeypatch)
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute_kept(rows)
    assert kept == want and 100 < len(want) < 400
    assert len(seen) == len(set(seen)) < 12 * len(rows)


@pytest.mark.parametrize("parity_shingles,rounds", [(60, 3), (24, 0), (0, 3), (10**6, 1)])
def test_links_over_the_size_where_parities_end(spark, monkeypatch, parity_shingles, rounds):
    monkeypatch.setattr(simhash, "PARITY_SHINGLES", parity_shingles)
    monkeypatch.setattr(simhash, "ROUNDS", rounds)
    monkeypatch.setattr(simhash, "PIVOTS", 1)
    r = random.Random(5)
    texts = []
    for k in range(25):  # chains of texts, each four fifths of the next or a little less
        n = r.choice([17, 20, 40, 48, 50, 60, 75])
        a = [f"t{k}w{r.randrange(10**6)}" for _ in range(n + 4)]
        texts.append(a)
        for _ in range(3):
            a = a[: 4 + -(-4 * (len(a) - 4) // 5) - (r.random() < 0.3)]
            texts.append(a)
    base = [f"w{r.randrange(4000)}" for _ in range(64)]
    for k in range(40):
        a = base + [f"tail{k}n{j}" for j in range(r.randrange(8))]
        a[r.randrange(64)] = f"own{k}"
        texts.append(a[r.randrange(3) :])
    rows = list(enumerate(" ".join(t) for t in texts))
    r.shuffle(rows)
    kept = {x.doc_id for x in simhash.keep_one(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()}
    want = brute_kept(rows)
    assert kept == want and len(rows) - len(want) > 60
