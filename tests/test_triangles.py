import random

import numpy as np
import pytest

from tremorlake.operators import triangles


def by_definition(x, y):
    """All corner triples whose circle holds no other point."""
    n = len(x)
    found = set()
    for a in range(n):
        for b in range(a + 1, n):
            for c in range(b + 1, n):
                turn = (x[b] - x[a]) * (y[c] - y[a]) - (x[c] - x[a]) * (y[b] - y[a])
                if turn == 0:
                    continue
                ux, uy, vx, vy, wx, wy = x[a] - x, y[a] - y, x[b] - x, y[b] - y, x[c] - x, y[c] - y
                inside = (ux * ux + uy * uy) * (vx * wy - wx * vy) - (vx * vx + vy * vy) * (ux * wy - wx * uy) + (wx * wx + wy * wy) * (ux * vy - vx * uy)
                inside[[a, b, c]] = 0
                if not (inside * np.sign(turn) > 0).any():
                    found.add((a, b, c))
    return found


def test_delaunay_against_the_definition():
    r = np.random.default_rng(3)
    for n in (3, 4, 7, 25):
        x, y = r.random(n), r.random(n)
        got = triangles.delaunay(x, y)
        assert {tuple(sorted(t)) for t in got.tolist() if t[2] >= 0} == by_definition(x, y)
        assert len(got) == 2 * n - 2  # with the half-planes
    assert len(triangles.delaunay(np.arange(5.0), 2 * np.arange(5.0))) == 0
    assert len(triangles.delaunay(np.zeros(2), np.ones(2))) == 0


def network(r):
    """Zones of even places, of dense clusters with an empty middle, of a regular grid, of few places and of one line."""
    rows = [("even", 35 + 3 * r.random(), 139 + 3 * r.random()) for _ in range(900)]
    for la, lo in ((30, 10), (30, 12), (33, 10)):
        rows += [("clusters", la + r.gauss(0, 0.2), lo + r.gauss(0, 0.2)) for _ in range(250)]
    rows += [(None, 10 + i / 8, 20 + j / 8) for i in range(20) for j in range(20)]
    rows += [("few", 1.0, 1.0), ("few", 1.0, 2.0), ("few", 1.0, 1.0), ("line", 1.0, 1.0), ("line", 1.0, 2.0), ("line", 1.0, 3.0), ("none", None, 1.0), ("none", float("nan"), 1.0), ("none", 2.0, 1.0)]
    r.shuffle(rows)
    return [(z, i, la, lo, 0) for i, (z, la, lo) in enumerate(rows)]


@pytest.mark.parametrize("max_edge", [300.0, 25.0])
def test_tiles_give_the_triangles_of_the_whole_zone(spark, monkeypatch, max_edge):
    df = spark.createDataFrame(network(random.Random(8)), "zone string, station_id int, lat double, lon double, area int")
    run = lambda: sorted((str(r.zone), r.a, r.b, r.c, round(r.area, 6)) for r in triangles.triangulate(df, "zone", max_edge_km=max_edge).collect())
    monkeypatch.setattr(triangles, "TILE", 10_000)
    whole = run()
    monkeypatch.setattr(triangles, "TILE", 24)
    assert run() == whole
    assert {z for z, *_ in whole} == {"even", "clusters", "None"}
    if max_edge == 300.0:
        # a grid is covered once, whichever diagonals its squares get
        assert sum(z == "None" for z, *_ in whole) >= 2 * 19 * 19


def test_empty_network(spark):
    df = spark.createDataFrame([], "zone string, station_id string, lat double, lon double")
    got = triangles.triangulate(df, "zone")
    assert got.count() == 0 and dict(got.dtypes)["a"] == "string"
