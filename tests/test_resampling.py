import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tremorlake.operators import resampling as R
from tremorlake.operators import statistics as S


def test_slices_are_even_with_a_far_score(spark):
    df = spark.range(20000).select(F.when(F.col("id") == 7, 1e9).otherwise(F.col("id") / 20000).alias("x"))
    n = [r["count"] for r in S.with_slice(df, "x", S.edges_of(df, "x")).groupBy("_slice").count().collect()]
    assert len(n) > 1000 and max(n) < 2 * 20000 / 1024
    rows = df.withColumns({"y": (F.col("x") * 20000 % 3 < 1).cast("int"), "p": "x"} | {"p": F.col("x")})
    m = S.binary_metrics(rows, "y", "p").first()
    pos, neg = ([r.p for r in rows.filter(F.col("y") == k).collect()] for k in (1, 0))
    order = np.searchsorted(np.sort(neg), pos)
    assert abs(m.auroc - order.sum() / len(pos) / len(neg)) < 1e-12


def test_ranks_of_ties_and_groups(spark):
    r = random.Random(1)
    rows = [(r.choice(["a", "b", None]), r.choice([0.1, 0.1, 0.1, 0.5, None, 0.9]), i) for i in range(300)]
    df = spark.createDataFrame(rows, "g string, p double, i long").repartition(5)
    got = {(x.g, x.p, x.i): x["rank"] for x in S.ranked(df, "p", "i", by=["g"]).collect()}
    for g in ("a", "b", None):
        own = sorted((x for x in rows if x[0] == g), key=lambda x: (x[1] is not None, x[1] or 0, x[2]))
        assert [got[x] for x in own] == list(range(1, len(own) + 1))


@pytest.mark.parametrize("step_up", [False, True])
def test_fdr_with_many_equal_p(spark, step_up):
    rows = [("x", 0.001 * k, k) for k in range(1, 30)] + [("x", 0.01, k) for k in range(100, 160)] + [("x", None, 999), ("y", 0.04, 1)]
    df = spark.createDataFrame(rows, "g string, p double, i long")
    got = {(r.g, r.i): r for r in S.bh_fdr(df, "p", 0.05, step_up, ["g"]).collect()}
    own = sorted(x[1:] for x in rows if x[0] == "x" and x[1] is not None)
    own = [(p, i, k * 0.05 / len(own)) for k, (p, i) in enumerate(own, 1)]
    top = max((p for p, _, c in own if p <= c), default=-1)
    for p, i, c in own:
        assert got["x", i].rejected == (p <= top if step_up else p <= c) and abs(got["x", i].critical - c) < 1e-12
    assert got["y", 1].rejected and got["x", 999].rejected is None and len(got) == len(rows)


@pytest.mark.parametrize("k", [1, 2, 30, 31, 5000, 10**6, 10**9])
def test_poisson_law_is_exact(k):
    law = R.Poisson()
    low, below = law.table(k)
    assert abs(below[-1] - 1) < 1e-8
    p = np.diff(np.r_[0.0, below])
    j = low + np.arange(len(p))
    assert abs((p * j).sum() / k - 1) < 1e-8 and abs((p * (j - k) ** 2).sum() / k - 1) < 1e-6
    at = int(k) - low
    assert math.isclose(p[at], math.exp(-k + k * math.log(k) - math.lgamma(k + 1)), rel_tol=1e-5)
    u = (np.arange(1000) + 0.5) / 1000
    assert (np.searchsorted(below, u) + low == law.counts(k, u)).all()


def test_bootstrap_equals_plain(spark, monkeypatch):
    monkeypatch.setattr(R, "DRAWN", 7)
    r = random.Random(2)
    rows = [(int(r.random() < 0.4), r.choice([round(r.random(), 2), 1e9])) for _ in range(500)] + [(None, 0.5), (1, None)]
    got = R.bootstrap_auroc(spark.createDataFrame(rows, "y int, p double").repartition(6), "y", "p", 150, 9).first()
    table = {}
    for y, p in rows:
        if y is not None and p is not None:
            table.setdefault(p, [0, 0])[1 - y] += 1
    law, below, out, keys = R.Poisson(), 0, [], []
    for p in sorted(table):
        keys.append((below, *table[p]))
        below += sum(table[p])
    for it in range(150):
        won = pos = neg = 0.0
        for n, kp, kn in keys:
            draw = []
            for side, k in enumerate((kp, kn)):
                z = (int(R.mixed(np.array([n * 2 + side + (9 << 40)], np.uint64))[0]) + it) % 2**64
                u = ((int(R.mixed(np.array([z], np.uint64))[0]) >> 11) + 0.5) / 2**53
                draw.append(float(law.counts(k, np.array([u]))[0]))
            won += draw[0] * (neg + draw[1] / 2)
            pos, neg = pos + draw[0], neg + draw[1]
        out.append(won / pos / neg)
    assert got.replicates == 150
    assert [got.ci_low, got.ci_high] == pytest.approx(list(np.quantile(out, [0.025, 0.975])), abs=1e-12)


def plain_isotonic(points, asked):
    """Pool adjacent violators over (score, total, n), then straight lines between blocks."""
    blocks = []
    for x, t, n in sorted(points):
        blocks.append([x, x, t, n])
        while len(blocks) > 1 and blocks[-2][2] * blocks[-1][3] >= blocks[-1][2] * blocks[-2][3]:
            _, hi, t2, n2 = blocks.pop()
            blocks[-1] = [blocks[-1][0], hi, blocks[-1][2] + t2, blocks[-1][3] + n2]
    xs = [v for b in blocks for v in (b[0], b[1])]
    ys = [b[2] / b[3] for b in blocks for _ in (0, 1)]
    return np.interp(asked, xs, ys)


@pytest.mark.parametrize("n,noise", [(400, 0.5), (400, 0.0), (3, 1.0)])
def test_isotonic_equals_plain(spark, monkeypatch, n, noise):
    monkeypatch.setattr(R, "FAN_IN", 2)
    r = random.Random(n)
    data = [(f, round(r.random(), 3), float(r.random() < 0.5), 1.0) for f in (0, 1) for _ in range(n)] if noise else [(f, i / n, float(i), 1.0) for f in (0, 1) for i in range(n)]
    table = {}
    for f, x, t, k in data:
        a = table.setdefault((f, x), [0.0, 0.0])
        a[0] += t
        a[1] += k
    t = spark.createDataFrame([(f, x, a, k) for (f, x), (a, k) in table.items()], "fold int, score double, total double, n double").repartition(6)
    asked = sorted({round(r.uniform(-0.2, 1.2), 4) for _ in range(300)} | {x for _, x in table})
    ask = spark.createDataFrame([(f, x) for f in (0, 1) for x in asked], "fold int, score double")
    blocks = R.isotonic_blocks(t)
    got = {(v.fold, v.score): v.value for v in R.isotonic_values(blocks, ask).collect()}
    assert len(got) == 2 * len(asked)
    for f in (0, 1):
        want = plain_isotonic([(x, a, k) for (g, x), (a, k) in table.items() if g == f], asked)
        assert [got[f, x] for x in asked] == pytest.approx(list(want), abs=1e-12)


def test_calibration_of_nulls_and_nothing(spark):
    df = spark.createDataFrame([(i, i % 2, i / 50 if i else None) for i in range(50)], "id long, y int, p double")
    out = {r.id: r.calibrated for r in R.isotonic_calibrate(df, df, "y", "p", "id").collect()}
    assert len(out) == 50 and out[0] is None and all(0 <= v <= 1 for k, v in out.items() if k)
    assert {r.calibrated for r in R.isotonic_calibrate(df.limit(0), df, "y", "p", "id").collect()} == {None}
