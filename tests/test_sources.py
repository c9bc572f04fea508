import json
from datetime import date, datetime

from tremorlake.sources import catalogs, grids, json_feeds, text_formats, xml_feeds


def lines(spark, *rows):
    return spark.createDataFrame([(r,) for r in rows], "value string")


def test_quake_features(spark):
    feed = {"features": [{"id": "a", "properties": {"mag": 5.1, "time": 86400000}, "geometry": {"type": "Point", "coordinates": [10.0, 20.0, 30.0]}}, {"properties": {"mag": 1.0}, "geometry": None}, {"properties": {"code": "c9", "time": 1}, "geometry": {"type": "Point", "coordinates": [1.0, 2.0]}}]}
    got = {r.event_id: r for r in json_feeds.quake_features(lines(spark, json.dumps(feed), "not json", "{}")).collect()}
    assert set(got) == {"a", "c9"} and got["a"].latitude == 20.0 and got["a"].time == datetime(1970, 1, 2) and got["c9"].depth_km is None


def test_alerts(spark):
    feed = {"features": [{"properties": {"event": "Flood", "sent": "2025-01-01T00:00:00Z", "severity": s}, "geometry": g} for s, g in (("Severe", {"type": "Point", "coordinates": [1, 2]}), ("Minor", None), ("Extreme", {"type": "Polygon", "coordinates": [[[0, 0], [2, 0], [2, 2]]]}))]}
    a = json_feeds.cap_geojson_alerts(lines(spark, json.dumps(feed)))
    assert {r.id for r in a.collect()} == {"Flood-2025-01-01T00:00:00Z"}
    assert sorted((r.severity, r.lat) for r in json_feeds.severe_only(a).collect()) == [("Extreme", None), ("Severe", 2.0)]


def test_header_rows_and_series(spark):
    t = json.dumps([["time_tag", "kp"], ["t1", "3"], ["t2"]])
    assert [tuple(r) for r in json_feeds.header_row_json(lines(spark, t), ["kp", "time_tag", "none"]).collect()] == [("3", "t1", None), (None, "t2", None)]
    idx = json.dumps([{"time": "t", "Kp": "0"}, {"kp_index": "4P"}])
    assert [tuple(r) for r in json_feeds.index_json(lines(spark, idx), {"t": ["time_tag", "time"], "kp": ["kp", "Kp", "kp_index"]}).collect()] == [("t", "0"), (None, "4P")]
    point = lambda v, d: {"value": v, "dateTime": d}
    s = {"value": {"timeSeries": [{"sourceInfo": {"siteName": "n", "siteCode": [{"value": "s1"}]}, "variable": {"variableCode": [{"value": "v"}]}, "values": [{"value": [point("1.5", "2025-01-01T00:00:00"), point("x", "bad")]}]}]}}
    got = json_feeds.nested_series(lines(spark, json.dumps(s))).collect()
    assert [(r.site, r.variable, r.value, r.ts is None) for r in got] == [("s1", "v", 1.5, False), ("s1", "v", None, True)]


def test_gauges(spark):
    rows = [("g1", "minor", 2.0), ("g2", "none", -999.0), ("g3", "none", 1.0)]
    df = spark.createDataFrame(rows, "gauge string, category string, stage double")
    assert [r.gauge for r in json_feeds.gauge_status(df).collect()] == ["g1"]
    quiet = sorted((r.gauge, r.stage) for r in json_feeds.gauge_status(df.filter("gauge != 'g1'"), heartbeat=2).collect())
    assert quiet == [("g2", None), ("g3", 1.0)]


def test_cap_xml(spark):
    alert = '<cap:alert xmlns:cap="urn:c"><cap:identifier>I1</cap:identifier><cap:info><cap:event>Tsunami</cap:event><cap:severity>Extreme</cap:severity><cap:area><cap:polygon>10.5,-20 11,-21</cap:polygon></cap:area></cap:info></cap:alert>'
    escaped = alert.replace("I1", "I2").replace("<", "&lt;").replace(">", "&gt;").replace('"', "&quot;")
    feed = f'<feed xmlns="http://www.w3.org/2005/Atom"><entry><title>A</title><content>{alert}</content></entry><entry><content type="text">{escaped}</content></entry><atom:entry xmlns:atom="x"><atom:title>only</atom:title><atom:link href="http://l"/></atom:entry></feed>'
    got = {r.identifier: r for r in xml_feeds.cap_xml_alerts(lines(spark, feed, "<feed></feed>")).collect()}
    assert got["I1"].lat == 10.5 and got["I1"].severity == "Extreme" and got["I2"].event == "Tsunami" and got["http://l"].headline == "only"


def test_text_tables(spark):
    kp = text_formats.kp_table(lines(spark, "# c", "2024 5 1 " + "3 " * 7 + "6 12 150.5", "2024 5 2 " + "1 " * 8 + "4 -1", "bad line")).collect()
    assert [(r.d, r.kp_max, r.ap, r.f107) for r in kp] == [(date(2024, 5, 1), 6.0, 12.0, 150.5), (date(2024, 5, 2), 1.0, 4.0, None)]
    dst = text_formats.hourly_dst(lines(spark, "  1  " + "-10 " * 23 + "9999", "MONTH", " 2 5"), 2024, 5).collect()
    assert [(r.d, r.dst_min, r.dst_mean) for r in dst] == [(date(2024, 5, 1), -10, -10.0)]
    om = text_formats.omni_hourly(lines(spark, "2024 1 0 30", "2024 1 1 99", "2024 366 0 10", "x y z w"), "kp", 99, 10).collect()
    assert sorted((r.d, r.kp_max) for r in om) == [(date(2024, 1, 1), 3.0), (date(2024, 12, 31), 1.0)]
    rep = lines(spark, ":Product: x\n:Energy:\n# c\n  2024 7.5 -1\n:Other:\n 1 2 3\n")
    assert [text_formats.sectioned_report(rep, "Energy", k).first().x for k in (1, 2)] == [7.5, None]
    fl = text_formats.flare_reports(lines(spark, "20240501 0100 C1.2", "20240501 0300 M2.0", "nothing")).collect()
    assert [(r.xray_class_max, r.has_m_flare, r.has_x_flare) for r in fl] == [("M", 1, 0)]


def test_station_formats(spark):
    iaga = " Format IAGA\nDATE       TIME         DOY     XXXH      XXXD   |\n2024-05-01 00:00:00.000 122  100.5  99999.0\n2024-05-01 01:00:00.000 122  99999.0 1.0\n"
    assert [(r.ts.hour, r.x) for r in text_formats.iaga_hourly(lines(spark, iaga, "junk"), "H").collect()] == [(0, 100.5), (1, None)]
    row = lambda k: f"ST01 24JAN01 {2024 + k / 366:.4f} 60310 2295 1 -120.0 1 0.001 2 0.002 3 0.003 0 0"
    p = text_formats.tenv3_positions(lines(spark, *map(row, range(5)), "header"), 5).collect()
    assert len(p) == 5 and p[0].east_mm == 1.0 and p[0].up_mm == 3.0
    net = spark.createDataFrame([(date(2024, 1, 1), "11,1,3"), (date(2024, 1, 1), "13,0,1,2,3"), (date(2024, 1, 2), "11,1,4"), (date(2024, 1, 3), "13,0,x")], "d date, value string")
    got = {r.d.day: r for r in text_formats.daily_network_csv(net).collect()}
    assert got[1].status == "ok" and got[1].n_reporting == 3 and abs(got[1].variance - 2 / 3) < 1e-12 and got[2].status == "no_data" and got[3].status == "decode_error"


def test_daily_network_reads_every_cell(spark):
    long = "13,0," + ",".join(["0"] * 100_000 + ["1"] * 50_000)
    net = spark.createDataFrame([(1, long), (1, "13,0,3"), (1, "11,1,150001"), (2, "13,0"), (3, "13,")], "d int, value string")
    got = {r.d: r for r in text_formats.daily_network_csv(net).collect()}
    assert abs(got[1]["mean"] - 50_003 / 150_001) < 1e-12 and got[1].n_reporting == 150_001
    assert got[2].status == got[3].status == "no_data"


def test_grid_cells(spark):
    rec = lambda body, label: f"{body:<60}{label}"
    values = [f"{v:5d}" for v in [*range(72), 9999]]
    block = [rec("  " + "".join(f"{x:6.1f}" for x in (87.5, -180.0, 180.0, 5.0, 450.0)), "LAT/LON1/LON2/DLON/H")] + ["".join(values[i : i + 16]) for i in range(0, 73, 16)]
    head = [rec("    -1", "EXPONENT")]
    one = [rec("     1", "START OF TEC MAP"), rec("  2024     5     1     0     0     0", "EPOCH OF CURRENT MAP"), *block, rec("     1", "END OF TEC MAP")]
    two = [rec("     2", "START OF TEC MAP"), rec("  2024     5     1     2     0     0", "EPOCH OF CURRENT MAP"), *block, rec("     2", "END OF TEC MAP")]
    got = grids.ionex_cells(lines(spark, "\n".join(head + one + two), "<!DOCTYPE html>", None, "cut", "\n".join(head + one)[:700])).collect()
    full = [r for r in got if r.map_idx == 1]
    assert len(full) == 73 and {r.lon: r.tec for r in full}[-180.0 + 5 * 70] == 7.0 and {r.lon: r.tec for r in full}[180.0] is None


def test_hazard_catalogues(spark):
    df = spark.createDataFrame([("1", "1990", "", None, "26", "5.5"), ("2", "1991", "2", "30", "0", "x"), ("3", "1992", "3", "4", "5", "6")], "id string, y string, m string, d string, h string, mag string")
    q = catalogs.unify(df, "wave", "src", {"id": "id", "year": "y", "month": "m", "day": "d", "hour": "h", "mag": "mag"})
    got = [(r.event_id, r.start_ts, r.mag) for r in catalogs.unify_hazards(q, q.limit(0)).orderBy("event_id").collect()]
    assert got == [("wave-1", datetime(1990, 1, 1), 5.5), ("wave-2", None, None), ("wave-3", datetime(1992, 3, 4, 5), 6.0)]
