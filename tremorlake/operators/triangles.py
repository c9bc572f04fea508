"""Delaunay triangles of station networks of any size, tile by tile, with a check that no other tile can change them."""

from __future__ import annotations

from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tremorlake.operators.checkpoints import checkpointed

#: Stations of a tile at most, and halvings of a zone's box; only places closer than a millionth of the box exceed it.
TILE, LEVELS = 256, 20
#: Tiles that one open triangle asks for in a round.
ASKED = 2
#: Kilometres by which places are moved to decide ties, as on regular grids; areas and edges are of the places themselves.
NUDGE = 1e-6


def delaunay(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Corners of all triangles, counterclockwise, and of the half-planes beyond the hull as (a, b, -1), in which other points
    would lie to the left of a -> b. Points are added one by one; the hole of the triangles whose circle holds
    the new one is closed with it. Points of one line have none."""
    n = len(x)
    turn = (x[1] - x[0]) * (y - y[0]) - (x - x[0]) * (y[1] - y[0]) if n > 2 else np.zeros(0)
    if not (turn != 0).any():
        return np.empty((0, 3), np.int64)
    k = int(np.flatnonzero(turn)[0])
    a, b, c = (0, 1, k) if turn[k] > 0 else (1, 0, k)
    tri = np.full((2 * n, 3), -1, np.int64)
    at = np.full((6, 2 * n), np.nan)
    far = np.zeros(2 * n, bool)
    px, py = np.r_[x, np.nan], np.r_[y, np.nan]

    def put(slots, corners):
        t = np.array(corners)
        tri[slots], far[slots] = t, t[:, 2] < 0
        at[:3, slots], at[3:, slots] = px[t].T, py[t].T

    put(np.arange(4), [(a, b, c), (b, a, -1), (c, b, -1), (a, c, -1)])
    m = 4
    for i in range(n):
        if i in (a, b, c):
            continue
        ax, bx, cx = at[:3, :m] - px[i]
        ay, by, cy = at[3:, :m] - py[i]
        ab = ax * by - bx * ay
        a2, b2, c2 = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
        inside = a2 * (bx * cy - cx * by) - b2 * (ax * cy - cx * ay) + c2 * ab
        bad = np.flatnonzero(np.where(far[:m], ab, inside) > 0)
        edges = {(p, q) for t in tri[bad].tolist() for p, q in ((t[0], t[1]), (t[1], t[2]), (t[2], t[0]))}
        new = [(q, i, -1) if p < 0 else (i, p, -1) if q < 0 else (p, q, i) for p, q in edges if (q, p) not in edges]
        if new:
            put(np.r_[bad, np.arange(m, m + len(new) - len(bad))], new)
            m += len(new) - len(bad)
    return tri[:m]


def _circles(x: np.ndarray, y: np.ndarray, tri: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Centres and radii of the circles through the corners."""
    (ax, bx, cx), (ay, by, cy) = x[tri].T, y[tri].T
    ux, uy, vx, vy = bx - ax, by - ay, cx - ax, cy - ay
    twice, u2, v2 = 2 * (ux * vy - uy * vx), ux * ux + uy * uy, vx * vx + vy * vy
    with np.errstate(divide="ignore", invalid="ignore"):
        ox, oy = (vy * u2 - uy * v2) / twice, (ux * v2 - vx * u2) / twice
    return ax + ox, ay + oy, np.hypot(ox, oy)


def _asked(x: np.ndarray, y: np.ndarray, tri: np.ndarray, own: np.ndarray, kept: np.ndarray, boxes: np.ndarray, near: np.ndarray) -> set[int]:
    """The boxes (x0, y0, x1, y1) to look into before the triangles with an ``own`` corner are sure: those that a triangle's
    circle, or a half-plane beyond the hull, touches; for triangles that are not ``kept`` only those ``near``."""
    out: set[int] = set()
    x0, y0, x1, y1 = boxes.T
    mine = np.flatnonzero((own[tri] & (tri >= 0)).any(axis=1))
    for part in np.array_split(mine, max(1, len(mine) * len(boxes) // 1_000_000)):
        t = tri[part]
        far = t[:, 2] < 0
        cx, cy, r = (v[:, None] for v in _circles(x, y, t))
        gap = np.hypot(np.maximum(np.maximum(x0 - cx, cx - x1), 0), np.maximum(np.maximum(y0 - cy, cy - y1), 0))
        touched = ~(gap > r * (1 + 1e-9) + 1e-6)
        # the corner of a box that lies farthest to the left of a hull edge
        ax, ay = x[t[:, 0], None], y[t[:, 0], None]
        dx, dy = x[t[:, 1], None] - ax, y[t[:, 1], None] - ay
        left = np.maximum(-dy * (x0 - ax), -dy * (x1 - ax)) + np.maximum(dx * (y0 - ay), dx * (y1 - ay))
        touched = np.where(far[:, None], left > -1e-6, touched) & (near | kept[part, None])
        corner = t[np.arange(len(t)), np.argmax(own[t] & (t >= 0), axis=1)]
        sx, sy = x[corner, None], y[corner, None]
        away = np.hypot(np.maximum(np.maximum(x0 - sx, sx - x1), 0), np.maximum(np.maximum(y0 - sy, sy - y1), 0))
        away = np.where(touched, away, np.inf)
        pick = np.argpartition(away, ASKED - 1, axis=1)[:, :ASKED] if len(boxes) > ASKED else np.tile(np.arange(len(boxes)), (len(t), 1))
        out.update(pick[np.isfinite(np.take_along_axis(away, pick, axis=1))].tolist())
    return out


def _tiles(places: DataFrame) -> DataFrame:
    """``places`` (z, qx, qy, n of the zone, ...) with ``tile``: the largest cells, by halving, of ``TILE`` places at most."""
    level = F.explode(F.sequence(F.lit(0), F.when(F.col("n") <= TILE, 0).otherwise(LEVELS)))
    cells = lambda df, *cols: df.select(*cols, level.alias("l")).withColumns({c: F.expr(f"shiftright({q}, {LEVELS} - l)") for c, q in (("cx", "qx"), ("cy", "qy"))})
    nodes = cells(places, "z", "qx", "qy", "n").groupBy("z", "l", "cx", "cy").agg(F.count(F.lit(1)).alias("k"))
    full = nodes.filter(F.col("k") > TILE).select("z", (F.col("l") + 1).alias("l"), F.col("cx").alias("ux"), F.col("cy").alias("uy"))
    small = nodes.filter((F.col("k") <= TILE) | (F.col("l") == LEVELS)).withColumns({"ux": F.shiftright("cx", 1), "uy": F.shiftright("cy", 1)})
    # a leaf is a small cell in a full one, or a whole small zone
    leaves = small.filter("l = 0").select("z", "l", "cx", "cy").unionByName(small.filter("l > 0").join(full, ["z", "l", "ux", "uy"], "left_semi").select("z", "l", "cx", "cy"))
    tile = F.expr(f"shiftleft(shiftleft(cast(cx as bigint), {LEVELS}) + cy, 5) + l").alias("tile")
    return cells(places, *places.columns).join(leaves, ["z", "l", "cx", "cy"]).select(*places.columns, tile)


def triangulate(net: DataFrame, zone: str, station: str = "station_id", max_edge_km: float = 300.0, min_area_km2: float = 1.0) -> DataFrame:
    """Delaunay triangles (a < b < c) of each zone's stations, with corners in local kilometres and their area; those with
    an edge over ``max_edge_km`` or an area under ``min_area_km2`` are left out.

    A zone is cut into tiles of up to ``TILE`` stations. Each tile triangulates its own stations and those of tiles it
    knows, and asks for a tile where the empty circle of a triangle with one of its corners, or the half-plane beyond a
    hull edge, touches that tile's box, until none is left: then its triangles are those of the whole zone. A triangle
    comes from the tile of its corner of the least name. Rounds follow the tiles that a circle crosses, not the
    size of the zone, and finished tiles leave. A task holds one tile, those it asked for, and the boxes of its zone, of
    which there is one for some 100 stations.

    Stations at one place count once, by the least name; those without a place are left out; a null zone is a zone. Zones of
    fewer than three places, or with all on one line, have no triangles, and an empty table gives none. Columns other than the four named are not read.
    """
    c = F.col
    kinds = dict(net.dtypes)
    src = net.select(c(zone).alias("zone"), c(station).alias("s"), c("lat").cast("double").alias("lat"), c("lon").cast("double").alias("lon"))
    src = src.filter(~F.isnan("lat") & ~F.isnan("lon") & c("s").isNotNull()).withColumn("z", F.to_json(F.struct("zone")))
    src = src.groupBy("z", "zone", "lat", "lon").agg(F.min("s").alias("s"))
    mid = src.groupBy("z").agg(F.avg("lat").alias("la"), F.avg("lon").alias("lo"), F.min("lat").alias("y0"), F.max("lat").alias("y1"), F.min("lon").alias("x0"), F.max("lon").alias("x1"), F.count(F.lit(1)).alias("n")).filter("n > 2")
    cell = lambda v, lo, hi: F.least(F.lit((1 << LEVELS) - 1), F.floor(F.coalesce((c(v) - c(lo)) / F.nullif(c(hi) - c(lo), F.lit(0.0)), F.lit(0.0)) * (1 << LEVELS))).cast("int")
    moved = lambda k: F.shiftrightunsigned(F.xxhash64("lat", "lon"), k).bitwiseAND(F.lit(0xFFFF)) * (NUDGE / 0xFFFF)
    places = src.join(mid, "z").select("z", "zone", "s", "n", cell("lon", "x0", "x1").alias("qx"), cell("lat", "y0", "y1").alias("qy"), (F.radians(c("lon") - c("lo")) * 6371 * F.cos(F.radians("la"))).alias("x"), (F.radians(c("lat") - c("la")) * 6371).alias("y"), moved(0).alias("mx"), moved(16).alias("my"))
    placed = checkpointed(_tiles(places).select("z", "zone", "tile", "s", "x", "y", (c("x") + c("mx")).alias("px"), (c("y") + c("my")).alias("py")))
    boxes = placed.groupBy("z", "tile").agg(F.min("px").alias("x0"), F.min("py").alias("y0"), F.max("px").alias("x1"), F.max("py").alias("y1"))
    boxes = checkpointed(boxes.groupBy("z").agg(F.sort_array(F.collect_list(F.struct("tile", "x0", "y0", "x1", "y1"))).alias("boxes")))
    kind = kinds[station]
    shape = f"a {kind}, b {kind}, c {kind}, ax double, ay double, bx double, by double, cx double, cy double, area double"
    names = [f.split(" ")[0] for f in shape.split(", ")]

    def fit(key, pts: pd.DataFrame, row: pd.DataFrame) -> pd.DataFrame:
        z, tile = key
        known = set(row.known.iloc[0])
        box = row.boxes.iloc[0]
        ids = np.array([b["tile"] for b in box], np.int64)
        edges = np.array([[b[k] for k in ("x0", "y0", "x1", "y1")] for b in box])
        # stations in the order of their names, so corners are named in order
        pts = pts.sort_values("s", ignore_index=True)
        own = (pts.other == tile).to_numpy()
        x, y, px, py, s = (pts[k].to_numpy() for k in ("x", "y", "px", "py", "s"))
        tri = delaunay(px, py)
        (ax, bx, cx), (ay, by, cy) = x[tri].T, y[tri].T
        area = np.abs((bx - ax) * (cy - ay) - (cx - ax) * (by - ay)) / 2
        edge = np.max([np.hypot(ax - bx, ay - by), np.hypot(bx - cx, by - cy), np.hypot(cx - ax, cy - ay)], axis=0)
        kept = (tri[:, 2] >= 0) & (edge <= max_edge_km) & (area >= min_area_km2)
        rest = np.flatnonzero(~np.isin(ids, list(known)))
        mine = edges[np.searchsorted(ids, tile)]
        away = np.hypot(np.maximum(np.maximum(edges[rest, 0] - mine[2], mine[0] - edges[rest, 2]), 0), np.maximum(np.maximum(edges[rest, 1] - mine[3], mine[1] - edges[rest, 3]), 0))
        if not len(tri):  # too few places to tell
            asked = rest[(order := np.argsort(away, kind="stable"))[:ASKED]][away[order[:ASKED]] <= max_edge_km]
        else:
            asked = rest[sorted(_asked(px, py, tri, own, kept, edges[rest], away <= max_edge_km))] if len(rest) else rest
        if len(asked):
            return pd.DataFrame({"z": z, "tile": tile, "want": ids[asked]}).reindex(columns=["z", "tile", "want", *names])
        kept[kept] = own[tri[kept].min(axis=1)]
        t = np.sort(tri[kept], axis=1)
        cols = {k: v for i, k in enumerate("abc") for k, v in ((k, s[t[:, i]]), (f"{k}x", x[t[:, i]]), (f"{k}y", y[t[:, i]]))}
        out = pd.DataFrame({"z": z, "tile": tile, "want": pd.Series([None] * len(t), dtype="Int64"), **cols, "area": area[kept]})
        return out[["z", "tile", "want", *names]]

    active = placed.select("z", "tile").distinct().withColumn("known", F.array("tile"))
    done = []
    while True:
        pts = active.select("z", "tile", F.explode("known").alias("other")).join(placed.withColumnRenamed("tile", "other"), ["z", "other"]).select("z", "tile", "other", "s", "x", "y", "px", "py")
        rows = active.join(boxes, "z").select(c("z").alias("rz"), c("tile").alias("rt"), "known", "boxes")
        out = checkpointed(pts.groupBy("z", "tile").cogroup(rows.groupBy("rz", "rt")).applyInPandas(fit, f"z string, tile long, want long, {shape}"))
        done.append(out.filter("want IS NULL").select("z", *names))
        asked = out.filter("want IS NOT NULL").groupBy("z", "tile").agg(F.collect_set("want").alias("more"))
        if asked.isEmpty():
            break
        active = checkpointed(active.join(asked, ["z", "tile"]).select("z", "tile", F.concat("known", "more").alias("known")))
    zones = placed.select("z", c("zone").alias(zone)).distinct()
    return reduce(DataFrame.unionByName, done).join(zones, "z").select(zone, *names)
