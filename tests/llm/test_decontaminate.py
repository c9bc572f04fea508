import math
import random
import re
from itertools import combinations

import numpy as np

from tremorlake.llm import decontaminate as dec

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute(docs, items):
    """Pairs with an overlap, by comparing along every diagonal."""
    split = lambda t: WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in t or ""))
    out = set()
    for i, t in items:
        q = split(t)
        if len(q) < 7:
            continue
        least = min(13, len(q))
        for d, x in docs:
            w = split(x)
            if sum(w.count(x) > 0 for x in q) < 0.5 * least:
                continue
            pad = np.array([""] * len(q) + w + [""] * len(q), object)
            q_arr = np.array(q, object)
            for s in range(len(pad) - len(q) + 1):
                e = np.r_[0, np.cumsum(pad[s : s + len(q)] == q_arr)]
                if e[-1] >= 0.5 * least and ((e[least:] - e[:-least]).max() >= 0.8 * least or e[-1] >= 0.8 * len(q)):
                    out.add((d, i))
                    break
    return out


def cases():
    r = random.Random(11)
    word = lambda: r.choice(["the", "of", "a", "and"] + [f"w{r.randrange(3000)}" for _ in range(5)])
    items = [(i, " ".join(word() for _ in range(r.randrange(15, 58)))) for i in range(25)] + [(90, "too short item"), (91, None), (92, "")]
    docs = []
    for d in range(75):
        body = [word() for _ in range(r.randrange(0, 200))]
        if d % 3 == 0:
            w = items[r.randrange(25)][1].split()
            if d % 2:  # substitutions, one word in eight
                w = [word() if k % 8 == 4 else x for k, x in enumerate(w)]
            at = r.randrange(len(body) + 1)
            body[at:at] = [x.upper() + r.choice(["", ",", "."]) for x in w]
        docs.append((d, " ".join(body)))
    return [*docs, (500, None), (501, ""), (502, items[0][1]), (502, items[0][1]), (503, "the " * 800)], items


def test_pairs_against_brute_force(spark, monkeypatch):
    docs, items = cases()
    df = spark.createDataFrame([(d, t, 1) for d, t in docs], "doc_id long, text string, item_id int")
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, items)
    for words in (2_000_000, 300):
        monkeypatch.setattr(dec, "BLOCK_WORDS", words)
        rows = dec.contaminated(df, bench).collect()
        assert {(r.doc_id, r.item_id) for r in rows} == want and len(rows) == len(want) + 1
        assert all(r.similarity >= 0.75 for r in rows)
        left = [r.doc_id for r in dec.drop_contaminated(df, bench).collect()]
        assert sorted(left) == sorted(d for d, _ in docs if d not in {p for p, _ in want})
    assert dec.contaminated(df.limit(0), bench).count() == 0 and dec.contaminated(df, bench.limit(0)).count() == 0
    assert dec.drop_contaminated(df, bench.limit(0)).count() == len(docs)


def test_every_allowed_substitution_is_found():
    for n in range(1, 17):
        item = [f"w{k}" for k in range(n)]
        index = dec.SeedIndex([(1, " ".join(item))])
        allowed = n - math.ceil(0.8 * n - 1e-9) if n >= 7 else 0
        for held in range(allowed + 1):
            texts = [" ".join(["before", *("x" if k in gone else w for k, w in enumerate(item)), "after"]) for gone in combinations(range(n), held)]
            found = {d for d, *_ in index.matches(texts)}
            assert len(found) == len(texts), (n, held, len(texts) - len(found))
        if n < 7:
            assert not index.matches([" ".join("x" if k == 0 else w for k, w in enumerate(item))])
            assert index.matches([" ".join(["a", *item, "b", *item])]) == [(0, 0, 1, n, n)]


def test_no_overlap_of_any_length_avoids_the_masks():
    # least number of unequal words in n words that keep every mask from a hit, over the outcomes of the last words
    for low, high, masks in ((7, 12, dec.SHORT_MASKS), (13, 90, dec.MASKS)):
        bits, full = [int(m, 2) for m in masks], (1 << max(map(len, masks)) - 1) - 1
        least, open_ = {0: 0}, []
        for n in range(1, high + 1):
            new = {}
            for state, cost in least.items():
                for equal in (0, 1):
                    s = state << 1 | equal
                    if not any(s & b == b for b in bits):
                        new[s & full] = min(new.get(s & full, n), cost + 1 - equal)
            least = new
            if n >= low and min(least.values()) <= n - math.ceil(0.8 * n - 1e-9):
                open_.append(n)
        # these two lengths have a mask more, whose patterns are tried one by one above; items of
        # over 75 words pass only with a stretch of 13 words that passes
        assert open_ == ([] if high == 12 else [15, 16])


def test_short_items_in_tables(spark):
    bench = spark.createDataFrame([(1, "alpha beta gamma"), (2, "one two three four five six seven"), (3, "...")], "item_id long, text string")
    df = spark.createDataFrame([(1, "so Alpha, beta gamma it is"), (2, "alpha beta delta"), (3, "one two three x five six seven"), (4, "one two x four x six seven"), (5, "...")], "doc_id long, text string")
    got = [(r.doc_id, r.item_id, r.first_word, r.n_words, r.n_equal) for r in dec.contaminated(df, bench).orderBy("doc_id").collect()]
    assert got == [(1, 1, 1, 3, 3), (3, 2, 0, 7, 6)]
    assert sorted(r.doc_id for r in dec.drop_contaminated(df, bench).collect()) == [2, 4, 5]


def test_extent_is_the_longest_similar_stretch():
    item = [f"w{k}" for k in range(100)]
    f = lambda words: dec.SeedIndex([(1, " ".join(item))]).matches([" ".join(words)])
    far = [w if k < 14 or k >= 88 else f"x{k}" for k, w in enumerate(item)]
    assert f(["a", "b", *far]) == [(0, 0, 2, 14, 14)]
    near = [w if k % 20 < 17 else "x" for k, w in enumerate(item)]
    assert f(near) == [(0, 0, 0, 97, 85)]
    assert f([*item[:13], "y", *item[40:70]]) == [(0, 0, 14, 30, 30)]


def test_stem_shared_by_many_items():
    # seconds follow the pairs compared, in slices of bounded size
    import time

    r = random.Random(2)
    stem = "which of the following statements about the passage is"
    items = [(i, f"{stem} {' '.join(f'u{r.randrange(10**6)}' for _ in range(20))}") for i in range(4000)]
    index = dec.SeedIndex(items)
    took = []
    for repeats in (5, 20):
        start = time.process_time()
        assert index.matches([" ".join([stem, "z"] * repeats)] * 4) == []
        took.append(time.process_time() - start)
    assert took[1] < 10 * took[0] + 1
    rest = items[7][1]
    assert index.matches([f"{stem} z {rest} {stem}"]) == [(0, 7, 10, 29, 29)]
