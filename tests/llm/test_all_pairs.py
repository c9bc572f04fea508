"""The fit of op2 takes every labelled document and every pair of a good and a bad one."""

import zlib

import numpy as np

from tremorlake.llm import pairwise


def texts(n, seed):
    r = np.random.default_rng(seed)
    good = r.random(n) < 0.7
    words = np.array("the of fault depth seismic tremor and to rises quietly".split())
    made = [" ".join(w + ("***" if not g and r.random() < 0.2 else "") for w in r.choice(words, r.integers(5, 40))) for g in good]
    flip = r.random(n) < 0.15  # labels that the measures don't tell
    return [(i, t, int(g != f)) for i, (t, g, f) in enumerate(zip(made, good, flip, strict=True))]


def test_weights_are_those_of_all_pairs(spark):
    rows = [x for x in texts(260, 1) if zlib.crc32(str(x[0]).encode()) % 5]
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int")
    model = pairwise.fit(df, df)
    x, y = np.array([pairwise.features(t) for _, t, _ in rows]), np.array([y for *_, y in rows])
    z = np.clip((x - x.mean(axis=0)) / np.maximum(x.std(axis=0), 1e-6), -4, 4)
    z = np.hstack([z, z**2])
    diff = (z[y == 1][:, None] - z[y == 0][None]).reshape(-1, z.shape[1])  # written out pair by pair
    slope = lambda w: -(diff / (1 + np.exp(diff @ w))[:, None]).mean(axis=0) + pairwise.RIDGE * w
    w = np.zeros(z.shape[1])
    for _ in range(30):
        q = 1 / (1 + np.exp(diff @ w))
        w = w - np.linalg.solve((diff * (q * (1 - q))[:, None]).T @ diff / len(diff) + pairwise.RIDGE * np.eye(len(w)), slope(w))
    assert np.abs(slope(w)).max() < 1e-10 and np.abs(slope(model.weights)).max() < 1e-7
    assert np.abs(w - model.weights).max() < 1e-4
    u, k = np.sort(z @ model.weights), int((y == 0).sum())
    assert abs((u[k - 1] + u[k]) / 2 - model.threshold) < 1e-8
    again = pairwise.fit(df.repartition(9), df.repartition(3))
    assert (again.weights == model.weights).all() and again.threshold == model.threshold


def test_every_labelled_document_counts(spark):
    rows = [(i, "tremor " * (3 + i % 50) + ("!!! " if i % 3 else ""), int(i % 3 > 0)) for i in range(26_000)]
    rows = [x for x in rows if zlib.crc32(str(x[0]).encode()) % 5]
    assert len(rows) > 20_000
    df = spark.createDataFrame(rows, "doc_id long, text string, quality int").repartition(4)
    got = pairwise.fit(df, df)
    known = {t: pairwise.features(t) for _, t, _ in rows}
    assert np.abs(got.mean - np.array([known[t] for _, t, _ in rows]).mean(axis=0)).max() < 1e-9


def test_sums_over_nodes_are_those_over_documents():
    r = np.random.default_rng(3)
    u, at = r.uniform(-0.5, 0.5, 500), r.uniform(-6, 6, 200)
    u[:2] = pairwise._NODES[3], 0.5
    plain = (1 / (1 + np.exp(at[:, None] - u))).sum(axis=1)
    nodes = (1 / (1 + np.exp(at[:, None] - pairwise._NODES))) @ pairwise._shares(u).sum(axis=0)
    assert np.abs(plain - nodes).max() < 1e-9
