import hashlib
import math
import random

import pytest
from pyspark.sql import functions as F

from tremorlake.operators import boosting as B
from tremorlake.operators import models as M

COLS = ["a", "b", "c"]
SCHEMA = "zone string, id string, d date, y int, a double, b double, c double, p double"


def some_rows(seed, n, zones=("x", "y")):
    import datetime

    r = random.Random(seed)
    out = []
    for i in range(n):
        a, b = r.randrange(12), r.random()
        y = int(a / 12 + b * 0.5 + r.random() * 0.5 > 0.9)
        out.append((r.choice(zones), f"r{i}", datetime.date(2000, 1, 1) + datetime.timedelta(r.randrange(400)), y, None if r.random() < 0.1 else float(a), b, float(r.randrange(3)), 0.0))
    return out


def plain(train, test, p, allowed=(0, 1, 2)):
    """Boosting by plain loops over rows of (id, y, values): chances of the test rows, and gains by feature."""
    n, width = len(train), len(train[0][2])
    cols = [[v[k] for _, _, v in train] for k in range(width)]
    edges, fill = [], []
    for c in cols:
        known = sorted(x for x in c if x is not None) if p.impute == "median" else sorted(x or 0.0 for x in c)
        at = lambda q, known=known: known[max(1, math.ceil(q * len(known))) - 1]
        edges.append([at(k / p.bins) for k in range(1, p.bins)])
        fill.append(at(0.5) if p.impute == "median" else 0.0)
    classes = lambda v: [sum(e < (fill[k] if v[k] is None else v[k]) for e in edges[k]) for k in range(width)]
    rows = [(int(hashlib.md5(f"{p.seed}|{i}".encode()).hexdigest()[:8], 16), y, classes(v)) for i, y, v in train]
    later = [classes(v) for _, _, v in test]
    pos = sum(y for _, y, _ in rows)
    weight = (n - pos) / pos
    scores, out, gains = [0.0] * n, [0.0] * len(later), [0.0] * width
    leaf = lambda g, h: -g / (h + p.ridge) * p.rate
    for r in range(p.rounds):
        draw = sorted(allowed, key=lambda f: ((f + 1) * 40692 % B.PRIME) * ((r + 1) * 69621 % B.PRIME) % B.PRIME)
        use = sorted(draw[: max(1, int(p.colsample * len(allowed) + 0.5))])
        grad = []
        for (u, y, _), s in zip(rows, scores):
            q = 1 / (1 + math.exp(-s))
            w = (weight if y else 1.0) * ((u % B.PRIME) * ((r + 1) * 48271 % B.PRIME) % B.PRIME / B.PRIME < p.subsample)
            grad.append((math.floor(w * (q - y) * B.SCALE + 0.5), math.floor(w * (q * (1 - q)) * B.SCALE + 0.5)))

        def tree(at, depth, value):
            if depth == p.depth:
                return value
            g, h = (sum(grad[i][k] for i in at) / B.SCALE for k in (0, 1))
            value = leaf(g, h) if depth == 0 else value
            best = (0.0, None)
            for f in use:
                for c in range(p.bins - 1):
                    gl, hl = (sum(grad[i][k] for i in at if rows[i][2][f] <= c) / B.SCALE for k in (0, 1))
                    gr, hr = g - gl, h - hl
                    if hl >= p.least_weight and hr >= p.least_weight:
                        gain = gl * gl / (hl + p.ridge) + gr * gr / (hr + p.ridge) - g * g / (h + p.ridge)
                        if gain > best[0]:
                            best = (gain, (f, c, gl, hl, gr, hr))
            if best[1] is None:
                return value
            f, c, gl, hl, gr, hr = best[1]
            gains[f] += best[0]
            return f, c, tree([i for i in at if rows[i][2][f] <= c], depth + 1, leaf(gl, hl)), tree([i for i in at if rows[i][2][f] > c], depth + 1, leaf(gr, hr))

        def read(t, b):
            while isinstance(t, tuple):
                t = t[3] if b[t[0]] > t[1] else t[2]
            return t

        grown = tree(list(range(n)), 0, 0.0)
        scores = [s + read(grown, b) for s, (_, _, b) in zip(scores, rows)]
        out = [s + read(grown, b) for s, b in zip(out, later)]
    return [1 / (1 + math.exp(-s)) for s in out], gains


P = {"rounds": 5, "depth": 3, "bins": 8, "least_weight": 1.0, "rate": 0.3}


@pytest.mark.parametrize("local,impute", [(10**6, "zero"), (0, "zero"), (0, "median"), (10**6, "median")])
def test_equal_to_plain(spark, monkeypatch, local, impute):
    # in one task each, or scan by scan over packed rows whose scores are written anew every second round
    monkeypatch.setattr(B, "PACK_ROWS", 30)
    monkeypatch.setattr(B, "KEPT_ROUNDS", 2)
    monkeypatch.setattr(B, "SCORE_ROWS", 25)
    p = B.Boosting(**P, impute=impute)
    train, test = some_rows(1, 160), some_rows(2, 70)
    df = spark.createDataFrame(train, SCHEMA).repartition(3)
    models = B.fit_boosted(df, ["zone"], COLS, "y", "id", p, local_rows=local)
    got = {(r.zone, r.id): r.p for r in B.score(spark.createDataFrame(test, SCHEMA), models, ["zone"], COLS, ["id"], "y").collect()}
    gains = {r.zone: r.importance for r in models.collect()}
    assert len(got) == 70
    for z in ("x", "y"):
        cut = lambda rows, z=z: [(i, y, (a, b, c)) for zone, i, _, y, a, b, c, _ in rows if zone == z]
        want, gain = plain(cut(train), cut(test), p)
        assert [got[z, i] for i, _, _ in cut(test)] == pytest.approx(want, abs=1e-12)
        assert [gains[z][c] for c in COLS] == pytest.approx(gain, rel=1e-9)


def test_sets_see_their_features_only(spark):
    train = spark.createDataFrame(some_rows(3, 300, ("x",)), SCHEMA)
    test = spark.createDataFrame(some_rows(4, 300, ("x",)), SCHEMA)
    p = B.Boosting(**P)
    scores, models = M.ablation(train, test, {"ab": ["a", "b"], "c": ["c"]}, "y", "id", p)
    imp = {r["set"]: r.importance for r in models.collect()}
    assert imp["ab"]["c"] == 0 and imp["ab"]["a"] > 0 and imp["c"]["a"] == imp["c"]["b"] == 0
    rows = lambda seed: [(i, y, (a, b, c)) for _, i, _, y, a, b, c, _ in some_rows(seed, 300, ("x",))]
    want, _ = plain(rows(3), rows(4), p, (2,))
    got = {r.id: r.p for r in scores.filter("set = 'c'").collect()}
    assert [got[i] for i, _, _ in rows(4)] == pytest.approx(want, abs=1e-12)
    drops = {(r["set"], r.feature): r["drop"] for r in M.permutation_importance(test, models, ["set"], ["a", "b", "c"], "y", "id").collect()}
    assert drops["ab", "c"] == 0 == drops["c", "a"] and drops["ab", "a"] > 0.05


def test_shuffled_values_stay_whole(spark):
    rows = spark.createDataFrame(some_rows(5, 120), SCHEMA)
    got = B.shuffled(rows, COLS, "id").collect()
    assert len(got) == 120 * 4
    key = lambda x: (x is None, x)
    for c in COLS:
        was, now = ({r.id: r[c] for r in got if r.permuted == k} for k in (None, c))
        assert sorted(was.values(), key=key) == sorted(now.values(), key=key) and was != now
        assert all(r["b" if c == "a" else "a"] == {x.id: x for x in got if x.permuted is None}[r.id]["b" if c == "a" else "a"] for r in got if r.permuted == c)


def test_folds_and_their_status(spark):
    rows = some_rows(6, 200, ("x",)) + [("only", f"o{i}", r[2], 1, 1.0, 1.0, 1.0, 0.0) for i, r in enumerate(some_rows(7, 40))] + [(None, f"n{i}", r[2], 0, *r[4:]) for i, r in enumerate(some_rows(8, 30))]
    df = spark.createDataFrame(rows, SCHEMA)
    folds = [("2000-03-31", "2000-06-30"), ("2000-06-30", "2000-12-31")]
    t = {(r.zone, r.fold): r for r in M.fold_table(M.fold_rows(df, "y", "d", folds), "y", ["zone"]).collect()}
    assert {t["x", k].status for k in (1, 2)} == {"OK"} and t["only", 1].status == "SKIP_NO_TEST_POSITIVES" and t[None, 2].status == "SKIP_INSUFFICIENT_TRAIN"
    scores, models = M.walk_forward(df, ["zone"], COLS, "y", "d", "id", folds, B.Boosting(**P))
    assert {(r.zone, r.fold) for r in models.collect()} == {("x", 1), ("x", 2)}
    assert scores.count() == t["x", 1].n_test + t["x", 2].n_test
    assert B.fit_boosted(df.limit(0), ["zone"], COLS, "y", "id").count() == 0


def test_plan_of_a_scan_has_no_single_task(spark):
    df = spark.createDataFrame(some_rows(1, 50), SCHEMA)
    plan = B.score(df, B.fit_boosted(df, ["zone"], COLS, "y", "id", B.Boosting(**P)), ["zone"], COLS, ["id"])._jdf.queryExecution().toString()
    assert "SinglePartition" not in plan and "CartesianProduct" not in plan
    assert F.col("p") is not None
