import hashlib
import random
import re

import pytest

from tremorlake.llm import substrings

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def brute(docs, window):
    """docs: [(id, text)] with different ids."""
    seen, out = set(), {}
    for d, t in sorted(docs):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if k in seen:
                gone[i : i + window] = [True] * window
            seen.add(k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def some_docs(seed, n):
    r = random.Random(seed)
    word = lambda: r.choice(["the", "of", "and", "x"] + [f"w{r.randrange(400)}" for _ in range(6)])
    passages = [[word() for _ in range(r.randrange(15, 90))] for _ in range(12)]
    docs = []
    for i in range(n):
        parts = []
        for _ in range(r.randrange(0, 6)):
            p = r.choice(passages)
            a = r.randrange(len(p))
            parts += p[a : a + r.randrange(10, 90)] if r.random() < 0.5 else [word() for _ in range(r.randrange(40))]
        if r.random() < 0.1:
            parts += ["la"] * r.randrange(60) + ["é" * 3, "a\x1cb"]
        docs.append((i * 3, r.choice([" ", "\n", "\t "]).join(parts)))
    copies = [(r.randrange(10**6) * 3 + 1, t) for _, t in r.choices(docs, k=n // 4)]
    return [*docs, *dict(copies).items(), (5, None), (8, ""), (11, "the " * 3000)]


@pytest.mark.parametrize("window,chunk,group,most,hot", [(20, 10**6, 10**7, 10**5, 10**6), (20, 700, 3000, 2, 40), (12, 3000, 10**5, 3, 10**6), (23, 2000, 500, 10**5, 60), (5, 900, 2000, 1, 20)])
def test_against_brute_force(spark, monkeypatch, window, chunk, group, most, hot):
    # chunks that cut texts, groups worked off in parts, several groups a partition, prefixes that go on past hot anchors
    monkeypatch.setattr(substrings, "CHUNK_WORDS", chunk)
    monkeypatch.setattr(substrings, "GROUP_BYTES", group)
    monkeypatch.setattr(substrings, "MOST_PARTITIONS", most)
    monkeypatch.setattr(substrings, "HOT_COUNT", hot)
    monkeypatch.setattr(substrings, "SORT_ROWS", 50)
    monkeypatch.setattr(substrings, "LEAST_COUNT", 2)
    docs = some_docs(window + chunk, 150)
    random.Random(0).shuffle(docs)
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, n_words int").repartition(5)
    want = brute(docs, window)
    for r in substrings.remove_repeats(df, window=window).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id], r.doc_id
        assert hashlib.sha256(r.kept_text.encode()).hexdigest() == r.kept_sha256 and sum(x.words for x in r.repeats) == r.n_removed


def test_repeated_rows_and_nulls(spark):
    a, b = " ".join(f"a{i}" for i in range(50)), " ".join(f"b{i}" for i in range(30))
    df = spark.createDataFrame([(2, a), (2, a), (3, a), (None, b), (1, b), (2, b)], "doc_id long, text string").repartition(6)
    got = sorted((r.doc_id if r.doc_id is not None else -1, r.n_words, r.n_removed) for r in substrings.remove_repeats(df).collect())
    assert got == [(-1, 30, 0), (1, 30, 30), (2, 30, 30), (2, 50, 0), (2, 50, 0), (3, 50, 50)]
    assert substrings.remove_repeats(df.limit(0)).count() == 0


def test_texts_without_id_of_equal_32_bit_hash(spark):
    from pyspark.sql import functions as F

    # two texts that the 32-bit hash takes for one: a passage of one of them also stands in a later document
    tail = " ".join(f"t{i}" for i in range(30))
    rows = spark.range(400_000).select("id", F.concat(F.lit("n"), F.col("id").cast("string"), F.lit(f" {tail}")).alias("text"))
    pair = rows.groupBy(F.hash("text").alias("h")).agg(F.collect_list("text").alias("t")).filter(F.size("t") > 1).orderBy("h").first().t
    first, second = sorted(pair)[:2]
    long = " ".join(f"u{i}" for i in range(25))
    for docs in ([(None, first), (None, second)], [(7, first), (7, second)], [(None, first), (None, second), (9, second + " " + long)]):
        df = spark.createDataFrame(docs, "doc_id long, text string").coalesce(1)
        got = substrings.remove_repeats(df).collect()
        # the tail stays in one of the two only
        assert sorted(r.n_removed for r in got)[:2] == [0, 30] and sum(r.n_removed == 0 for r in got) == 1


def test_words_decide_and_not_their_hash(spark, monkeypatch):
    # with hashes of few bits nearly all windows share theirs with others
    rolling = substrings.rolling
    monkeypatch.setattr(substrings, "rolling", lambda r, width: rolling(r, width) & substrings.np.uint64(3))
    docs = some_docs(4, 60)
    want = brute(docs, 20)
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    for r in substrings.remove_repeats(df).collect():
        assert (r.n_words, r.n_removed, r.kept_sha256) == want[r.doc_id]


def test_phrase_between_unique_words_is_no_anchor(spark, monkeypatch):
    # eight words that recur every twenty words and would be most windows' anchor: once counted as hot, their places
    # are dealt to many groups
    from pyspark.sql import functions as F

    np = substrings.np
    tries = ([*b"all of these words are always here".split(), b"%d" % k] for k in range(10**6))
    phrase, gram = next((b" ".join(w).decode(), g) for w in tries if (g := substrings.rolling(substrings.WordHasher()(b" ".join(w))[0], 8)[0]) < np.uint64(1 << 56))
    rows = [(i, " ".join(f"{phrase} " + " ".join(f"u{i}x{j}x{k}" for k in range(12)) for j in range(8))) for i in range(400)]
    df = spark.createDataFrame(rows, "d long, text string").selectExpr("d", "d AS th", "text").repartition(4)
    slots = [r.slot for r in substrings.prefix_counts(df, 20, 8).filter("slot >= 0 AND n > 500").collect()]
    assert slots == [int(gram) % substrings.SLOTS]
    bits = np.zeros(substrings.SLOTS, bool)
    bits[slots] = True
    share = []
    for hot in (None, spark.sparkContext.broadcast(np.packbits(bits).tobytes())):
        sizes = [r.n for r in substrings._stretches(df, 20, 8, hot, 64).groupBy("g").agg(F.sum(F.length("packed")).alias("n")).collect()]
        share.append(max(sizes) / sum(sizes))
    assert share[0] > 0.3 and share[1] < 0.05
    monkeypatch.setattr(substrings, "HOT_COUNT", 500)
    got = substrings.remove_repeats(spark.createDataFrame([*rows, (900, rows[7][1])], "doc_id long, text string").repartition(4)).collect()
    assert {r.doc_id for r in got if r.n_removed} == {900} and max(r.n_removed for r in got) == 160


def test_word_hashes(monkeypatch):
    monkeypatch.setattr(substrings, "HASH_BYTES", 64)
    r = random.Random(3)
    words = [bytes(r.choice(b"abc\xc3") for _ in range(r.choice([1, 2, 3, 70, 300]))) for _ in range(900)]
    hashes, byte = substrings.WordHasher()(b" ".join(words))
    assert len(hashes) == len(words) == len(byte) - 1 and len(set(hashes.tolist())) == len(set(words))
    assert len({(w, int(h)) for w, h in zip(words, hashes)}) == len(set(words))
