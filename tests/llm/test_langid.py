import math
import random
import zlib
from collections import Counter

import pytest

from tremorlake.llm import langid as L

SCHEMA = "doc_id long, text string, lang string, held_out int, score string"
VOCAB = {"en": "the and of to with water river stone green house under walking", "de": "der die und mit wasser fluss stein haus unter laufen schön", "fr": "le la et de avec eau rivière pierre vert maison sous marcher"}


def some_docs(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        lang = r.choice(list(VOCAB))
        words = VOCAB[lang].split()
        text = " ".join(r.choice(words) + (r.choice(["s", "ing", "en", "é"]) if r.random() < 0.2 else "") for _ in range(r.randrange(1, 30)))
        rows.append((i, r.choice([text, text.upper(), text.replace(" ", ", ")]), lang, 0, "x"))
    return rows


def plain(rows):
    """Predictions by the definition, without limits of the model's size."""
    learn = [r for r in rows if r[2] is not None and r[1] is not None and not (r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1)]
    docs = Counter(r[2] for r in learn)
    langs = sorted(docs)
    words = {x: Counter() for x in langs}
    for r in learn:
        words[r[2]].update(L.words_of(r[1]))
    parts = {(x, n): Counter() for x in langs for n in L.ORDERS}
    for x in langs:
        for w, k in words[x].items():
            for n in L.ORDERS:
                for g in L.grams(w, n):
                    parts[x, n][g] += k.bit_length()
    known = set().union(*words.values())

    def score(w, x):
        if w in known:
            return math.log((words[x][w] + 0.5) / (sum(words[x].values()) + 0.5 * len(known)))
        for n in L.ORDERS:
            all_ = set().union(*(parts[y, n] for y in langs))
            if hits := [g for g in L.grams(w, n) if g in all_]:
                return sum(math.log((parts[x, n][g] + 0.5) / (sum(parts[x, n].values()) + 0.5 * len(all_))) for g in hits) / len(hits)
        return 0.0

    out = []
    for _, text, *_ in rows:
        ws = L.words_of(text)
        if not ws or not langs:
            out.append(("und", 0.0))
            continue
        got = [sum(score(w, x) for w in ws) / math.sqrt(len(ws)) + math.log(docs[x] / sum(docs.values())) / len(ws) for x in langs]
        best = max(range(len(langs)), key=lambda i: got[i])
        out.append((langs[best], 1 / sum(math.exp(g - got[best]) for g in got)))
    return out


EDGES = [(900, None, "en", 0, "x"), (901, "", "de", 0, "x"), (902, "12 34 ²½ _", "fr", 0, "x"), (903, "水は川", None, 0, "x"), (904, "wasserfall", "zz", 0, "x"), (None, "the river", "en", 0, "x"), (5, "und", None, 0, "x"), (5, "und", None, 0, "x"), (906, "étés schönes", None, 0, "x")]


def test_against_plain(spark, monkeypatch):
    monkeypatch.setattr(L, "HELD", 50)  # counts are sent on in parts
    monkeypatch.setattr(L, "CACHE_CELLS", 10)
    rows = some_docs(150) + EDGES
    df = spark.createDataFrame(rows, SCHEMA).repartition(4)
    got = Counter((r.doc_id, r.held_out, r.lang_pred, round(r.score, 9)) for r in L.learn_and_identify(df).collect())
    want = Counter((r[0], r[0] is not None and zlib.crc32(str(r[0]).encode()) % 3 == 1, lang, round(s, 9)) for r, (lang, s) in zip(rows, plain(rows)))
    assert got == want


def test_held_out_accuracy_of_small_models(spark):
    rows = some_docs(600, 2)
    df = spark.createDataFrame(rows, SCHEMA)
    for limits in ({}, {"max_words": 30, "max_grams": 200}, {"max_words": 0}):
        model = L.fit(df, **limits)
        assert len(model["words"]) <= limits.get("max_words", L.MAX_WORDS) and len(model["grams"]) <= limits.get("max_grams", L.MAX_GRAMS)
        pred = {r.doc_id: r for r in L.identify(df, model).collect()}
        held = [r for r in rows if pred[r[0]].held_out]
        assert sum(pred[r[0]].lang_pred == r[2] for r in held) >= 0.97 * len(held)


def test_held_out_labels_do_not_matter(spark):
    rows = some_docs(200, 3)
    wrong = [(i, t, "en" if zlib.crc32(str(i).encode()) % 3 == 1 else x, a, b) for i, t, x, a, b in rows]
    a, b = (sorted(L.learn_and_identify(spark.createDataFrame(x, SCHEMA)).collect()) for x in (rows, wrong))
    assert a == b


def test_nothing_learned_and_long_texts(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert L.learn_and_identify(empty).count() == 0
    lone = spark.createDataFrame([(1, "the river", None, 0, "x")], SCHEMA)
    assert [(r.lang_pred, r.score) for r in L.learn_and_identify(lone).collect()] == [("und", 0.0)]
    model = L.fit(spark.createDataFrame(some_docs(100), SCHEMA))
    long = spark.createDataFrame([(1, "wasser " * 300_000, None, 0, "x"), (2, "a" * 500_000, None, 0, "x")], SCHEMA)
    assert {r.doc_id: r.lang_pred for r in L.identify(long, model).collect()}[1] == "de"


@pytest.mark.parametrize("limit", [1, 2])
def test_languages_of_most_documents(spark, limit):
    rows = some_docs(90) + [(1000 + i, "the and of", "en", 0, "x") for i in range(60)]
    model = L.fit(spark.createDataFrame(rows, SCHEMA), max_langs=limit)
    assert len(model["langs"]) == limit and "en" in model["langs"] and {w[0] for w in model["words"]} == set(model["langs"])


def test_plain_letters_are_those_of_unicode():
    import regex

    text = "".join(f" a{chr(c)}b" for c in range(1, 0x300))
    assert L.words_of(text) == regex.findall(r"\p{L}[\p{L}\p{M}]*", text.lower())
    assert L.words_of("E\u0301te\u0301 9x") == ["e\u0301te\u0301", "x"]
