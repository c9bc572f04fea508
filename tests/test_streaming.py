import json
from datetime import datetime

from pyspark.sql import functions as F

from tremorlake.streaming import feeds

SCHEMA = "id string, ts timestamp, v double"


def land(path, name, rows):
    path.mkdir(exist_ok=True)
    (path / name).write_text("\n".join(json.dumps(dict(zip(("id", "ts", "v"), r, strict=True))) for r in rows))


def test_upserts_rewrite_touched_buckets_only(spark, tmp_path):
    src, out = tmp_path / "in", tmp_path / "t"
    land(src, "1.json", [(f"k{i}", "2025-01-01T00:00:00", float(i)) for i in range(200)] + [(None, "2025-01-01T00:00:00", -1.0)])
    stream = feeds.feed_stream(spark, str(src), SCHEMA)
    run = lambda: feeds.upsert_stream(stream, str(out), ["id"], "ts", str(tmp_path / "cp"), 16).awaitTermination()
    run()
    files = lambda: {str(p) for p in out.rglob("part-*.parquet")}
    first = files()
    land(src, "2.json", [("k3", "2025-01-02T00:00:00", 999.0), ("new", "2025-01-01T00:00:00", 3.0), ("k4", "2024-01-02T00:00:00", 0.5)])
    run()
    table = feeds.BucketTable(spark, str(out), stream.schema, ["id"], 16)
    got = {r.id: r.v for r in table.read().collect()}
    assert len(got) == 202 and got["k3"] == 999.0 and got["k4"] == 4.0 and got["new"] == 3.0 and got[None] == -1.0
    assert 0 < len(first - files()) <= 3 and len(files()) <= 17  # old files of at most three buckets are gone
    # a batch that is run again changes nothing, nor does one that failed between its two writes
    before = sorted(map(tuple, table.read().drop("ts").collect()), key=str)
    table.upsert(spark.createDataFrame([("k5", None, 77.0)], SCHEMA), "ts", 1)
    assert sorted(map(tuple, table.read().drop("ts").collect()), key=str) == before


def test_log_of_more_batches_than_spark_keeps(spark, tmp_path):
    src, name = tmp_path / "in", "spark.sql.streaming.numRecentProgressUpdates"
    for i in range(25):
        land(src, f"{i:03}.json", [(f"k{i}", "2025-01-01T00:00:00", 1.0)] * (1 + i % 3))
    kept = spark.conf.get(name)
    spark.conf.set(name, "10")
    try:
        with feeds.RunLog(spark, str(tmp_path / "log")) as log:
            q = feeds.feed_stream(spark, str(src), SCHEMA, files_per_trigger=1).writeStream.format("noop").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
            q.awaitTermination()
            assert log.wait(q) and len(q.recentProgress) <= 10
    finally:
        spark.conf.set(name, kept)
    rows = log.read().filter(F.col("run") == str(q.runId)).collect()
    assert sorted(r.batch for r in rows) == list(range(25)) and sum(r.rows for r in rows) == 49


def test_silent_feeds_beat(spark, tmp_path):
    import time

    src, out = tmp_path / "in", str(tmp_path / "out")
    land(src, "1.json", [("a", "2025-01-01T00:00:00", 1.0), ("a", "2025-01-01T00:00:00", 1.0), ("b", "2025-01-01T00:00:00", 1.0)])
    known = spark.createDataFrame([("a",), ("never",)], "id string")
    q = feeds.start_heartbeats(feeds.feed_stream(spark, str(src), SCHEMA), "id", 1, out, str(tmp_path / "cp"), known)
    read = lambda: spark.read.schema("feed string, kind string, n bigint").parquet(out).collect()
    try:
        end = time.time() + 90
        while time.time() < end and (q.lastProgress is None or min(sum(r.feed == f and r.kind == "beat" for r in read()) for f in ("a", "b", "never")) < 2):
            time.sleep(1)
    finally:
        q.stop()
    rows = read()
    assert {f: sum(r.n for r in rows if r.feed == f) for f in ("a", "b", "never")} == {"a": 2, "b": 1, "never": 0}
    assert all(sum(r.feed == f and r.kind == "beat" for r in rows) >= 2 for f in ("a", "b", "never"))
    assert "RocksDB" not in spark.conf.get("spark.sql.streaming.stateStore.providerClass")


def test_once_by_id(spark, tmp_path):
    src = tmp_path / "in"
    land(src, "1.json", [("a", "2025-01-01T00:00:00", 1.0)])
    land(src, "2.json", [("a", "2025-01-01T00:00:00", 1.0), ("b", "2025-01-01T02:00:00", 2.0)])
    got = feeds.run_to_table(feeds.once_by_id(feeds.feed_stream(spark, str(src), SCHEMA, files_per_trigger=1), "id", "ts"), "append", str(tmp_path))
    assert sorted(r.id for r in got.collect()) == ["a", "b"]


def test_windows_and_latest(spark, tmp_path):
    src = tmp_path / "in"
    land(src, "1.json", [("a", "2025-01-01T00:10:00", 1.0), ("a", "2025-01-01T00:50:00", 2.0), ("a", "2025-01-01T03:00:00", 5.0)])
    s = feeds.feed_stream(spark, str(src), SCHEMA)
    w = feeds.run_to_table(feeds.window_counts(s, "ts", ["id"], "1 hour"), "complete", str(tmp_path)).collect()
    assert sorted((r.start, r.n) for r in w) == [(datetime(2025, 1, 1, 0), 2), (datetime(2025, 1, 1, 3), 1)]
    assert feeds.run_to_table(feeds.latest_values(s, "id", "ts", ["v"]), "complete", str(tmp_path)).first().v == 5.0


def test_match_and_publish(spark, tmp_path):
    a, b = tmp_path / "a", tmp_path / "b"
    land(a, "1.json", [("a", "2025-01-01T00:00:00", 1.0), ("x", "2025-01-05T00:00:00", 1.0), ("z", "2025-01-20T00:00:00", 1.0)])
    land(b, "1.json", [("m", "2025-01-01T00:00:30", 7.0), ("n", "2025-01-20T00:00:00", 8.0)])
    right = feeds.feed_stream(spark, str(b), SCHEMA).select(F.col("ts").alias("rts"), F.col("v").alias("rv"))
    got = feeds.run_to_table(feeds.match_feeds(feeds.feed_stream(spark, str(a), SCHEMA), right, "ts", "rts"), "append", str(tmp_path)).collect()
    assert {(r.id, r.rv) for r in got} >= {("a", 7.0), ("z", 8.0), ("x", None)}
    feeds.publish_stream(feeds.feed_stream(spark, str(a), SCHEMA), str(tmp_path / "pub"), str(tmp_path / "cp2")).awaitTermination()
    assert json.loads(spark.read.text(str(tmp_path / "pub")).orderBy("value").first().value)["id"] == "a"


def test_heartbeat_batches(spark, tmp_path):
    src = tmp_path / "in"
    land(src, "1.json", [("a", "2025-01-01T00:00:00", 1.0)])
    s = feeds.feed_stream(spark, str(src), SCHEMA).filter("v > 100")
    q = feeds.append_or_heartbeat(s, str(tmp_path / "out"), {"id": "alive"}, str(tmp_path / "cp"))
    q.awaitTermination()
    assert [r.id for r in spark.read.parquet(str(tmp_path / "out")).collect()] == ["alive"]
