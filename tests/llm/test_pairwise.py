import random
import zlib

import numpy as np

from tremorlake.llm import pairwise


def made(n, seed=1):
    r = random.Random(seed)
    rows = []
    for i in range(n):
        good = r.random() < 0.8
        words = [r.choice("the of fault depth seismic tremor and to rises quietly".split()) + r.choice(["", "", ","]) for _ in range(r.randrange(20, 80))]
        rows.append((i, " ".join(words if good else [w + "***" for w in words] if i % 2 else [words[0]] * 40), int(good)))
    return rows


def test_held_out_accuracy(spark):
    rows = made(600)
    df = spark.createDataFrame([(i, t, y) for i, t, y in rows] + [(9001, None, 0), (9002, "", 0), (None, "x y", 0)], "doc_id long, text string, score int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows if i % 4] + [(9999, 1), (None, 1)], "doc_id long, quality int")
    got = {x.doc_id: x for x in pairwise.classify(df, labels).collect()}
    assert len(got) == 603
    for i, _, y in rows:
        assert got[i].held_out == (zlib.crc32(str(i).encode()) % 5 == 0)
        assert 0 <= got[i].score <= 1 and got[i].predicted == int(got[i].score >= 0.3)
    held = [(got[i].predicted, y) for i, _, y in rows if got[i].held_out]
    assert np.mean([p == y for p, y in held]) > 0.97
    assert pairwise.classify(df.limit(0), labels).count() == 0
    assert {x.score for x in pairwise.classify(df, labels.limit(0)).collect()} == {0.5}


def test_held_out_labels_are_never_read(spark):
    rows = made(200, 2)
    df = spark.createDataFrame([(i, t) for i, t, _ in rows], "doc_id long, text string")
    a = spark.createDataFrame([(i, y) for i, _, y in rows], "doc_id long, quality int")
    b = spark.createDataFrame([(i, 1 - y if zlib.crc32(str(i).encode()) % 5 == 0 else y) for i, _, y in rows], "doc_id long, quality int")
    score = lambda x: {r.doc_id: r.score for r in pairwise.classify(df, x).collect()}
    assert score(a) == score(b)


def test_ids_that_repeat_and_odd_texts(spark):
    # labels of one id are averaged, and so are the measures of its documents; very long texts and clashing names do no harm
    rows = made(120, 3)
    docs = [(i, t, 1.0, 7) for i, t, _ in rows] + [(i, t, 1.0, 7) for i, t, _ in rows[:40]] + [(9000, "word, another. " * 200_000, 0.0, 1), (9001, "x" * 500_000, 0.0, 1), (9002, "\x00 \x1c é", 0.0, 1)]
    df = spark.createDataFrame(docs, "doc_id long, text string, score double, held_out int")
    labels = spark.createDataFrame([(i, y) for i, _, y in rows] + [(rows[0][0], 1 - rows[0][2])], "doc_id long, quality int")
    got = pairwise.classify(df, labels).collect()
    assert len(got) == len(docs) and all(0 <= r.score <= 1 for r in got)
    fit = pairwise.fit(df.filter("doc_id < 9000"), labels)
    again = pairwise.fit(df.filter("doc_id < 9000").repartition(7), labels.repartition(5))
    assert np.allclose(fit.weights, again.weights)
    other = {r.doc_id: r.score for r in pairwise.classify(df.repartition(9), labels).collect()}
    assert all(abs(other[r.doc_id] - r.score) < 1e-9 for r in got)


def test_weights_and_threshold_against_plain_gradient_descent():
    # the same pairs, drawn by the same seed, and the loss written out pair by pair
    rows = made(150, 5)
    x, y = np.array([pairwise.features(t) for _, t, _ in rows]), np.array([y for *_, y in rows])
    model = pairwise.Ranker(x, y)
    z = np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6), -4, 4)
    z = np.hstack([z, z**2])
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    draw = np.random.default_rng(42)
    n = min(pairwise.MAX_PAIRS, pairwise.PAIRS_EACH * max(len(good), len(bad)))
    left, right = draw.choice(good, n), draw.choice(bad, n)
    diff = z[left] - z[right]

    def loss(w):
        return np.mean(np.logaddexp(0, -(diff @ w))) + pairwise.RIDGE / 2 * w @ w

    def slope(w):
        return -(diff / (1 + np.exp(diff @ w))[:, None]).mean(axis=0) + pairwise.RIDGE * w

    # momentum on a convex loss whose curvature is known to be at most that of the squares, plus the ridge
    step = 1 / (np.linalg.norm(diff, 2) ** 2 / (4 * n) + pairwise.RIDGE)
    w = v = np.zeros(z.shape[1])
    for k in range(6000):
        ahead = v - step * slope(v)
        v, w = ahead + k / (k + 3) * (ahead - w), ahead
    assert abs(loss(w) - loss(model.weights)) < 1e-8 and np.abs(w - model.weights).max() < 1e-2 * max(1, np.abs(w).max())
    u = sorted(float(a @ w) for a in z)
    k = round(float(np.mean(y == 0)) * len(u))
    assert abs((u[k - 1] + u[k]) / 2 - model.threshold) < 1e-2 * max(1, abs(model.threshold))
    assert np.allclose(model.score(x), 1 / (1 + (1 - 0.3) / 0.3 * np.exp(np.clip(model.threshold - z @ model.weights, -25, 25))), atol=1e-6)
