import math
import random
from datetime import date, timedelta

import numpy as np
from pyspark.sql import functions as F

from tremorlake.operators import epoch, resampling, spatial, stations, statistics, tables, triangles, windows
from tremorlake.operators.checkpoints import checkpointed
from tremorlake.operators.matching import gazetteer_match


def catalogue(spark, n=300, seed=1):
    r = random.Random(seed)
    rows = [(i, date(2000, 1, 1) + timedelta(days=r.randrange(400)), r.uniform(-3, 3) + 30, r.choice([179.5, -179.5, 10.0]) + r.uniform(-1, 1), round(r.uniform(3, 7.5), 2)) for i in range(n)]
    return rows, spark.createDataFrame(rows, "event_id long, d date, lat double, lon double, magnitude double")


def km(a, b):
    p, q = math.radians(a[2]), math.radians(b[2])
    h = math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2
    return 2 * 6371 * math.asin(min(1, math.sqrt(h)))


def test_decluster_against_walking_in_time(spark):
    rows, df = catalogue(spark)
    left = sorted(rows, key=lambda r: (r[1], r[0]))
    removed = set()
    for i, a in enumerate(left):
        if a[0] in removed:
            continue
        far, long_ = 10 ** (0.1238 * a[4] + 0.983), 10 ** (0.032 * a[4] + 2.7389) if a[4] >= 6.5 else 10 ** (0.5409 * a[4] - 0.547)
        removed |= {b[0] for b in left[i + 1 :] if (b[1] - a[1]).days <= long_ and km(a, b) <= far}
    got = spatial.decluster(df, checkpoint=checkpointed).collect()
    assert len(got) == len(rows) and {r.event_id for r in got if not r.is_mainshock} == removed and removed


def test_a_long_chain_of_windows_takes_few_rounds(spark):
    # at one place each event lies in the window of the one before it only, so every second one stays
    rows = [(i, date(2000, 1, 1) + timedelta(days=9 * i), 10.0, 20.0, 3.0) for i in range(300)]
    rows = [(i, d, la, lo, 3.1) for i, d, la, lo, _ in rows] + [(1000, date(2000, 1, 5), None, 20.0, 7.0)]
    df = spark.createDataFrame(rows, "event_id long, d date, lat double, lon double, magnitude double")
    days = 10 ** (0.5409 * 3.1 - 0.547)
    assert 9 < days < 18
    for block, most in ((20_000, 1), (50, 7)):
        cuts = []
        got = spatial.decluster(df, checkpoint=lambda x, cuts=cuts: cuts.append(1) or checkpointed(x), block_events=block).collect()
        assert {r.event_id: r.is_mainshock for r in got} == {i: i % 2 == 0 for i in range(300)} | {1000: True}
        assert (len(cuts) - 2) / 2 <= most  # rounds


def test_boxes_hold_their_edges(spark):
    pts = spark.createDataFrame([(1, 10.0, 20.0), (2, 9.999, 20.0), (3, None, 1.0), (4, -90.0, -180.0)], "id int, lat double, lon double")
    boxes = spark.createDataFrame([("a", 10.0, 20.0, 20.0, 30.0), ("w", -90.0, 90.0, -180.0, 180.0)], "fault_id string, lat_min double, lat_max double, lon_min double, lon_max double")
    assert sorted((r.id, r.fault_id) for r in spatial.bbox_join(pts, boxes).collect()) == [(1, "a"), (1, "w"), (2, "w"), (4, "w")]
    assert sum(r.fault_id == "global" for r in spatial.bbox_or_global(pts, boxes).collect()) == 4


def test_auroc_with_ties(spark):
    r = random.Random(3)
    rows = [(i, int(r.random() < 0.3), round(r.random(), 1)) for i in range(400)]
    df = spark.createDataFrame(rows, "id long, y int, p double")
    pos, neg = [p for _, y, p in rows if y], [p for _, y, p in rows if not y]
    want = sum((a > b) + (a == b) / 2 for a in pos for b in neg) / len(pos) / len(neg)
    m = statistics.binary_metrics(df, "y", "p").first()
    assert abs(m.auroc - want) < 1e-12 and abs(m.brier - np.mean([(p - y) ** 2 for _, y, p in rows])) < 1e-12
    same = statistics.binary_metrics(df.withColumn("p", F.pow("p", 3) * 7), "y", "p").first()
    assert abs(same.auroc - want) < 1e-12
    ci = resampling.bootstrap_auroc(df, "y", "p", 100, 1).first()
    assert ci.ci_low < want < ci.ci_high and ci.replicates == 100
    both = statistics.binary_metrics(df.withColumn("g", F.when(F.col("id") % 2 == 0, "a")), "y", "p", ["g"]).collect()
    assert sorted(str(x.g) for x in both) == ["None", "a"] and sum(x.n for x in both) == len(rows)
    assert statistics.binary_metrics(df.filter("y = 1"), "y", "p").first().auroc is None


def test_chi2_tails(spark):
    counts = spark.createDataFrame([(i, n) for i, n in enumerate([11, 11, 9, 13, 12, 15, 12, 13])], "bin int, n long").withColumn("expected", F.lit(12.0))
    got = statistics.chi2_uniform(counts).first()
    assert round(got.chi2, 4) == 1.8333 and round(got.p_value, 4) == 0.9685
    for x, k, want in ((3.3913, 7, 0.8466), (3.841458820694124, 1, 0.05), (5.991464547107979, 2, 0.05), (9.487729036781154, 4, 0.05)):
        assert abs(spark.range(1).select(statistics.chi2_sf(F.lit(x), F.lit(k)).alias("p")).first().p - want) < 1e-4


def test_fdr(spark):
    df = spark.createDataFrame([(i, p) for i, p in enumerate([0.001, 0.02, 0.03, 0.04, 0.9])], "i int, p double")
    assert [r.rejected for r in statistics.bh_fdr(df, "p").orderBy("i").collect()] == [True, True, True, True, False]
    late = spark.createDataFrame([(0, 0.03), (1, 0.035), (2, 0.036)], "i int, p double")
    assert [r.rejected for r in statistics.bh_fdr(late, "p").orderBy("i").collect()] == [False, False, True]
    assert [r.rejected for r in statistics.bh_fdr(late, "p", step_up=True).orderBy("i").collect()] == [True, True, True]


def test_permutations_do_not_depend_on_partitions(spark):
    rows, df = catalogue(spark, 50)
    a, b = ({tuple(r) for r in epoch.shifted(x.select("event_id", "d"), 5, 7, "2000-01-01", "2001-02-01").select("iter", "event_id", "d").collect()} for x in (df.repartition(1), df.repartition(6)))
    assert a == b and all(date(2000, 1, 1) <= d <= date(2001, 2, 1) for _, _, d in a)


def test_upsert_and_heartbeat(spark):
    t = spark.createDataFrame([(1, "a", 1), (2, "b", 2)], "k int, v string, keep int")
    u = spark.createDataFrame([(2, None), (3, "c")], "k int, v string")
    rows = lambda x: sorted(map(tuple, x.collect()))
    assert rows(tables.upsert(t, u, ["k"], ["v"])) == [(1, "a", 1), (2, None, 2), (3, "c", None)]
    assert rows(tables.upsert(t, u, ["k"], ["v"], False)) == [(1, "a", 1), (2, None, 2)]
    assert rows(tables.heartbeat_if_empty(t.filter("k > 9"), {"v": "alive"})) == [(None, "alive", None)]


def test_windows(spark):
    df = spark.createDataFrame([("z", i, v) for i, v in enumerate([1.0, None, None, None, None, 6.0, None])], "k string, i int, x double")
    got = [r.filled for r in windows.interpolate(df, "k", "i", "x").orderBy("i").collect()]
    assert got == [1.0, 2.0, 3.0, 4.0, None, 6.0, 6.0]
    q = spark.createDataFrame([(float(i),) for i in range(9)] + [(None,)], "x double")
    assert sorted((r.x, r.part) for r in windows.qcut(q, "x", 3).collect() if r.x is not None)[::4] == [(0.0, 0), (4.0, 1), (8.0, 2)]


def test_stations(spark):
    days = [date(2010, 1, 1) + timedelta(days=10 * i) for i in range(120)]
    t = lambda d: (d - date(2000, 1, 1)).days / 365.25
    rows = [("s", d, 3 + 2 * t(d) + 5 * math.cos(2 * math.pi * t(d)), None) for d in days]
    df = spark.createDataFrame(rows, "station_id string, d date, east double, north double")
    got = stations.secular_seasonal_resid(df, "station_id", "d", ["east", "north"]).collect()
    assert max(abs(r.east_resid) for r in got) < 1e-6 and all(r.north_resid is None or math.isnan(r.north_resid) for r in got)
    r = random.Random(4)
    net = [("z", i, 35 + r.random(), 139 + r.random()) for i in range(12)]
    nd = spark.createDataFrame(net, "zone string, station_id int, lat double, lon double")
    tri = triangles.triangulate(nd, "zone")
    assert tri.count() >= 10
    lat0, lon0 = np.mean([x[2] for x in net]), np.mean([x[3] for x in net])
    xy = {i: (math.radians(lo - lon0) * 6371 * math.cos(math.radians(lat0)), math.radians(la - lat0) * 6371) for _, i, la, lo in net}
    motion = spark.createDataFrame([(i, date(2020, 1, 1), 0.02 * x + 0.01 * y, 0.03 * y) for i, (x, y) in xy.items()], "station_id int, d date, east double, north double")
    s = stations.strain(tri, motion, "station_id").first()
    assert abs(s.dilatation - 0.05) < 1e-9 and abs(s.max_shear - math.hypot(0.005, 0.005)) < 1e-9


def test_gazetteer(spark):
    spans = spark.createDataFrame([(1, "Kyoto"), (2, "Kyotto"), (3, "Zzz"), (4, " france ")], "t int, span string")
    places = spark.createDataFrame([("Kyoto", "city"), ("France", "country")], "place string, kind string")
    assert sorted(map(tuple, gazetteer_match(spans, places, "t").collect())) == [(1, "Kyoto", "city", 0.95), (2, "Kyoto", "city", 0.88), (4, "France", "country", 0.90)]


def test_nearest_event_against_all_pairs(spark):
    # across the date line, at the poles and in empty regions
    r = random.Random(6)
    place = lambda: (r.choice([r.uniform(-90, 90), 89.9, -89.5, 12.0]), r.choice([r.uniform(-180, 180), 179.9, -179.9]))
    pts = [(i, date(2000, 1, 1) + timedelta(days=r.randrange(30)), *place()) for i in range(120)]
    evs = [(i, date(2000, 1, 1) + timedelta(days=r.randrange(40)), *place()) for i in range(150)]
    want = {}
    for p in pts:
        near = [(km(p, e), e[0]) for e in evs if 0 <= (e[1] - p[1]).days <= 5]
        if near:
            want[p[0]] = min(near)
    p, e = spark.createDataFrame(pts, "pid long, d date, lat double, lon double"), spark.createDataFrame(evs, "event_id long, d date, lat double, lon double")
    got = {x.pid: (x.km, x.event_id) for x in spatial.nearest_event(p, e, 0, 5, [], "pid").collect()}
    assert got.keys() == want.keys() and all(abs(got[i][0] - want[i][0]) < 1e-6 for i in want)


def test_tolerance_join_and_edges_against_all_pairs(spark):
    r = random.Random(7)
    rows = [(i, date(2000, 1, 1) + timedelta(days=r.randrange(6)), r.choice([r.uniform(-90, 90), 89.99, -5.0, 5.0]), r.choice([r.uniform(-180, 180), 179.99, -180.0]), round(r.uniform(-2, 8), 2)) for i in range(200)]
    df = spark.createDataFrame(rows, "event_id long, d date, lat double, lon double, magnitude double")
    a, b = [x for x in rows if x[0] % 2], [x for x in rows if not x[0] % 2]
    want = {x[0] for x in a if any(x[1] == y[1] and abs(x[2] - y[2]) < 1.5 and abs(x[3] - y[3]) < 1.5 for y in b)}
    got = [x.event_id for x in spatial.tolerance_join(df.filter("event_id % 2 = 1"), df.filter("event_id % 2 = 0"), 1.5, "event_id").collect()]
    assert set(got) == want and len(got) == len(want) and spatial.tolerance_join(df, df, 0, "event_id").count() == 0
    far = lambda m: 10 ** (0.1238 * m + 0.983)
    long_ = lambda m: 10 ** (0.032 * m + 2.7389) if m >= 6.5 else 10 ** (0.5409 * m - 0.547)
    edges = {(x[0], y[0]) for x in rows for y in rows if (y[1], y[0]) > (x[1], x[0]) and (y[1] - x[1]).days <= long_(x[4]) and km(x, y) <= far(x[4])}
    assert {(e.src, e.dst) for e in spatial.window_edges(df).collect()} == edges and edges


def test_verdicts(spark):
    df = spark.createDataFrame([("a", 9, 0.6, 0.55, 0.1), ("b", 9, 0.6, 0.58, 0.1), ("c", 4, 0.9, 0.1, 0.1), ("d", 9, 0.7, 0.5, 0.2), ("e", 9, None, 0.5, None), ("f", 9, 0.6, 0.5, None)], "s string, k int, a double, b double, sd double")
    v = statistics.verdict(df, "k", "a", "sd", base_auroc="b")
    assert [r.verdict for r in v.orderBy("s").collect()] == ["CONFIRMED", "NULL", "INSUFFICIENT_DATA", "CONFIRMED_UNSTABLE", "INSUFFICIENT_DATA", "CONFIRMED"]
    assert [statistics.verdict_of_systems(v, k).first().verdict for k in (3, 4)] == ["CONFIRMED", "NULL"]
    folds = spark.createDataFrame([("a", 0.6), ("a", 0.4), ("a", None), ("b", 0.6), ("b", 0.7), ("b", 0.2)], "s string, x double")
    assert [(r.passed, r.folds, r.majority) for r in statistics.majority_of_folds(folds, "x", ["s"]).orderBy("s").collect()] == [(1, 2, False), (2, 3, True)]


def test_baselines_and_centroid(spark):
    train = spark.createDataFrame([("a", 1, 4), ("a", 0, 2), ("b", 0, 0)], "z string, y int, recent int")
    test = spark.createDataFrame([(1, "a", 8), (2, "c", 1)], "id int, z string, recent int")
    got = statistics.baselines(train, test, "y", "z", "recent", "id", 42).orderBy("id").collect()
    assert [(r.climatology, round(r.global_mean, 4), r.persistence) for r in got] == [(0.5, 0.3333, 1.0), (1 / 3, 0.3333, 0.25)] and all(0 <= r.uniform < 1 for r in got)
    flat = spark.createDataFrame([("x", -k, -1.0) for k in range(1, 6)] + [("y", -2, 3.0), ("y", -9, 9.0)], "metric string, rel_day int, z double")
    got = statistics.centroid(flat, "z", ["metric"], 50).collect()
    assert [(r.metric, r.centroid, r.ci_low, r.ci_high, r.window_class) for r in got] == [("y", -2.0, -2.0, -2.0, "IONOSPHERIC")]
    up = statistics.intensification(flat, "z", ["x", "y"]).orderBy("metric").collect()
    assert [(r.rises, r.all_primary) for r in up] == [(False, False), (None, False)]


def test_sinks_and_run_log(spark, tmp_path):
    df = spark.createDataFrame([(i, f"v{i % 3}") for i in range(10)], "k long, v string")
    for kind in ("parquet", "csv", "json"):
        path = str(tmp_path / kind)
        tables.write_sink(df, path, kind=kind, rows_a_file=2)
        tables.write_sink(df.filter("k < 4"), path, kind=kind)
        tables.write_sink(df.filter("k > 7"), path, append=True, kind=kind)
        back = spark.read.schema("k long, v string").format(kind).option("header", True).load(path)
        assert sorted(map(tuple, back.collect())) == [(i, f"v{i % 3}") for i in (0, 1, 2, 3, 8, 9)]
    status = spark.createDataFrame([("b", False), ("a", False), ("c", True)], "feed string, ok boolean")
    for s in (status, status.filter("ok"), status.limit(0)):
        tables.run_log(s, str(tmp_path / "log"), F.lit("2020-01-01").cast("date"))
    assert sorted((r.passed, r.failed, r.note) for r in spark.read.parquet(str(tmp_path / "log")).collect()) == [(0, 0, ""), (1, 0, ""), (1, 2, "a,b")]
