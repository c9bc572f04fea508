"""Registered queries against their SQL on odd tables."""

import math
import random
from datetime import datetime, timedelta

import duckdb
import pyarrow as pa
import pyarrow.parquet as pq
import pytest

from tremorlake import plans  # noqa: F401
from tremorlake.plans import registry


def near(a, b):
    if isinstance(a, float) and isinstance(b, float):
        return math.isnan(a) and math.isnan(b) or math.isclose(a, b, rel_tol=1e-9, abs_tol=1e-6)
    return a == b


def check(spark, folder, name, **tables):
    """The rows of a query, which are those of its SQL, over ``tables``."""
    con = duckdb.connect()
    for t, cols in tables.items():
        pq.write_table(pa.table(cols), f"{folder}/{t}.parquet")
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{folder}/{t}.parquet'")
    df = registry.QUERIES[name](spark, str(folder))
    cols = sorted(df.columns)
    cur = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    order = lambda r: [str(x) for x in r if not isinstance(x, float)]
    want = sorted((tuple(r[names.index(c)] for c in cols) for r in cur.fetchall()), key=order)
    got = sorted((tuple(r) for r in df.select(*cols).collect()), key=order)
    assert len(got) == len(want) and all(near(x, y) for a, b in zip(got, want, strict=True) for x, y in zip(a, b, strict=True)), (got[:3], want[:3])
    return got


def orders(n, days, customer):
    """``n`` orders dealt to days, with customers by number."""
    day = [datetime(1995, 1, 1) + timedelta(days=i % days) for i in range(n)]
    return {"o_orderkey": list(range(n)), "o_custkey": [customer(i) for i in range(n)], "o_orderstatus": ["F"] * n, "o_totalprice": [100.0 * (i % 5000) for i in range(n)], "o_orderdate": day, "o_orderpriority": ["5-LOW"] * n}


@pytest.mark.parametrize("days", [12, 1])
def test_standard_scores_of_a_constant_are_not_a_number(spark, tmp_path, days):
    got = check(spark, tmp_path, "c13_scalar_stats", orders=orders(60, days, lambda i: 9))
    assert len(got) == days and all(z is None if days == 1 else math.isnan(z) for _, z in got)


def lineitem(n, days, price):
    day = [datetime(1995, 1, 1) + timedelta(days=i % days) for i in range(n)]
    return {"l_orderkey": list(range(n)), "l_linenumber": [1] * n, "l_returnflag": ["NR"[i % 2] for i in range(n)], "l_shipdate": day, "l_extendedprice": [price(i) for i in range(n)]}


@pytest.mark.parametrize(("days", "customer", "price"), [(12, lambda i: 9, lambda i: i * 1.5), (13, lambda i: i * i % 61, lambda i: 7.0), (1, lambda i: 9, lambda i: 7.0), (13, lambda i: i * i % 61, lambda i: i * 1.5)])
def test_correlations_with_a_constant_are_not_a_number(spark, tmp_path, days, customer, price):
    got = check(spark, tmp_path, "d10_corr", orders=orders(60, days, customer), lineitem=lineitem(40, days, price))
    varied = customer(1) != customer(2) and price(1) != price(2)
    assert got and all(isinstance(r, float) and math.isnan(r) != varied for row in got for r in row if isinstance(r, float))


def test_the_search_for_the_nearest_event_never_sends_points_to_all(spark, tmp_path):
    # by the size of files, points that are yet to be dealt to cells look few, and a driver can't hold them
    n = 300
    doc = {"doc_id": list(range(n)), "text": ["x"] * n, "source": ["s"] * n, "lang": ["en"] * n}
    check(spark, tmp_path, "h25_correspondence", documents=doc, labels={"doc_id": [0], "quality": [1], "toxic": [0]}, orders=orders(4000, 2400, lambda i: i * i % 9973) | {"o_totalprice": [300_000.0 + i % 7 * 30_000 for i in range(4000)]})
    plan = registry.QUERIES["c17_nearest_event"](spark, str(tmp_path))._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" in plan and "Broadcast" not in plan


def test_nearest_events_in_crowded_and_empty_regions(spark):
    from datetime import date

    from tremorlake.operators.spatial import nearest_event

    r = random.Random(4)
    spot = lambda i: (10 + r.random() * 0.02, 20 + r.random() * 0.02) if i % 3 else (r.uniform(-90, 90), r.uniform(-180, 180))
    day = lambda i: date(2000, 1, 1) + timedelta(days=r.randrange(20))
    p, e = ([(i, day(i), *spot(i)) for i in range(n)] for n in (150, 900))
    p += p[:3]  # ids that repeat
    km = lambda a, b: 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2)))
    want = {a[0]: min((km(a, b), b[0]) for b in e if 0 <= (b[1] - a[1]).days <= 5) for a in p if any(0 <= (b[1] - a[1]).days <= 5 for b in e)}
    frame = lambda rows, name: spark.createDataFrame(rows, f"{name} long, d date, lat double, lon double")
    for sides in (None, (1 / 512, 1 / 8)):
        got = {x.pid: (x.event_id, x.km) for x in nearest_event(frame(p, "pid"), frame(e, "event_id"), 0, 5, [], "pid", sides=sides).collect()}
        assert got.keys() == want.keys() and all(got[i][0] == want[i][1] and abs(got[i][1] - want[i][0]) < 1e-6 for i in want)


@pytest.mark.parametrize("crowd", [False, True])
def test_declustering_in_many_tiles_against_walking_in_time(spark, crowd):
    # across tiles, the date line and poles, in places where all windows meet, with few events a tile
    from datetime import date

    from tremorlake.operators import spatial
    from tremorlake.operators.checkpoints import checkpointed

    r = random.Random(8)
    spot = lambda: (r.choice([r.uniform(-90, 90), 90.0, 89.7, -89.8, r.uniform(-1, 1)]), r.choice([r.uniform(-180, 180), 179.9, -179.9, 0.0, r.uniform(-1, 1)]))
    if crowd:
        spot = lambda: (r.gauss(0, 0.6), r.gauss(0, 0.6))
    rows = [(i, date(2000, 1, 1) + timedelta(days=r.randrange(900)), *spot(), round(r.uniform(2, 8), 2)) for i in range(900)]
    km = lambda a, b: 2 * 6371.0 * math.asin(min(1.0, math.sqrt(math.sin(math.radians(b[2] - a[2]) / 2) ** 2 + math.cos(math.radians(a[2])) * math.cos(math.radians(b[2])) * math.sin(math.radians(b[3] - a[3]) / 2) ** 2)))
    main = []
    for b in sorted(rows, key=lambda x: (x[1], x[0])):
        days = lambda a: 10 ** (0.032 * a[4] + 2.7389) if a[4] >= 6.5 else 10 ** (0.5409 * a[4] - 0.547)
        if not any((b[1] - a[1]).days <= days(a) and km(a, b) <= 10 ** (0.1238 * a[4] + 0.983) for a in main):
            main.append(b)
    df = spark.createDataFrame(rows, "event_id long, d date, lat double, lon double, magnitude double")
    for block in (1, 40, 300):
        got = spatial.decluster(df, checkpoint=checkpointed, block_events=block).collect()
        assert len(got) == len(rows) and {x.event_id for x in got if x.is_mainshock} == {a[0] for a in main}


def test_declustering_cuts_lineage_of_events_and_never_of_their_pairs(spark):
    from datetime import date

    from tremorlake.operators import spatial
    from tremorlake.operators.checkpoints import checkpointed

    rows = [(i, date(2000, 1, 1) + timedelta(days=i % 50), 10.0, 20.0, 6.0) for i in range(300)]
    most = []
    kept = lambda x: most.append((y := checkpointed(x)).count()) or y
    got = spatial.decluster(spark.createDataFrame(rows, "event_id long, d date, lat double, lon double, magnitude double"), checkpoint=kept).collect()
    assert sum(x.is_mainshock for x in got) == 1 and max(most) <= len(rows)


def test_edges_are_not_brought_together_again(spark, tmp_path):
    # pairs grow by the square of the events, so only events are shuffled; events that repeat have the edges of each copy
    twice = orders(300, 20, lambda i: i * 31 % 9000)
    twice = {k: [*v, *v[:40]] for k, v in twice.items()} | {"o_totalprice": [320_000.0 + i % 300 * 500 for i in range(340)]}
    twice["o_totalprice"][300:] = twice["o_totalprice"][:40]
    twice["o_orderkey"] = [k // 10 for k in twice["o_orderkey"]]
    con = duckdb.connect()
    pq.write_table(pa.table(twice), tmp_path / "orders.parquet")
    con.execute(f"CREATE VIEW orders AS SELECT * FROM '{tmp_path}/orders.parquet'")
    want = sorted(con.execute(f"SELECT src, dst FROM ({registry.ORACLES['h13_window_edges']})").fetchall())
    df = registry.QUERIES["h13_window_edges"](spark, str(tmp_path)).select("src", "dst")
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, df.collect())) == want and len(set(want)) < len(want)
    assert plan.count("Exchange hashpartitioning") == 2 and "Aggregate" not in plan and "Broadcast" not in plan


def test_survivors_of_a_crowded_place_without_its_pairs(spark, tmp_path, monkeypatch):
    # all events lie at one place, in windows of one another
    from tremorlake.plans import evaluation

    kept = []
    monkeypatch.setattr(evaluation, "checkpointed", lambda df, cut=evaluation.checkpointed: kept.append((x := cut(df)).count()) or x)
    crowd = orders(200, 150, lambda i: 36000 * i)
    crowd |= {"o_orderkey": [18000 * i for i in range(200)], "o_totalprice": [310_000.0 + i % 9 * 20_000 for i in range(200)], "o_orderdate": [d + timedelta(days=900) for d in crowd["o_orderdate"]]}
    region = {"r_regionkey": list(range(5))}
    got = check(spark, tmp_path, "d23_sequence_survivors", orders=crowd, region=region)
    assert len(got) == 1 and 0 < kept[0] and max(kept) <= 200
