from collections import Counter

import pytest

from tremorlake.llm import sharding


@pytest.mark.parametrize("n,shards", [(0, 4), (1, 4), (3, 4), (1003, 7), (2000, 24)])
def test_law(spark, n, shards):
    rows = [(i % max(1, n - 5), None if i % 11 == 0 else "hot" if i % 3 == 0 else f"s{i % 5}", i, "x") for i in range(n)]
    out = sharding.interleaved(spark.createDataFrame(rows, "doc_id long, source string, n int, shard string"), shards).collect()
    assert len(out) == n and sorted(r.n for r in out) == list(range(n))
    by = Counter(r["shard"] for r in out)
    assert not n or max(by.values()) - min([by[k] for k in range(shards)]) <= 1
    for k, c in by.items():
        assert sorted(r.slot for r in out if r["shard"] == k) == list(range(c))
    sizes = Counter(r.source for r in out)
    mix = Counter((r["shard"], r.source) for r in out)
    for (k, s), c in mix.items():
        assert abs(c - sizes[s] * by[k] / n) <= 2


def test_same_under_repartitioning(spark):
    df = spark.range(500).selectExpr("id doc_id", "cast(id % 3 as string) source")
    a, b = ({(r.doc_id, r["shard"], r.slot) for r in sharding.interleaved(x, 5).collect()} for x in (df.repartition(1), df.repartition(7)))
    assert a == b


def test_written_shards(spark, tmp_path):
    df = spark.range(100).selectExpr("id doc_id", "cast(id % 3 as string) source", "'t' text")
    sharding.write_shards(df, str(tmp_path / "out"), 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == 100 and back.select("shard").distinct().count() == 4


def test_query_and_its_sql(spark, tmp_path):
    import zlib

    import duckdb

    from tremorlake.llm import queries

    r = __import__("random").Random(6)
    docs = [(i * 5, None if i % 17 == 0 else "é𝄞 text " * r.randrange(40), None if i % 9 == 0 else f"s{i % 4}") for i in range(300)]
    path = str(tmp_path / "documents.parquet")
    spark.createDataFrame(docs, "doc_id long, text string, source string").repartition(3).write.parquet(path)
    got = queries.QUERIES["op9_interleaved_shards"](spark, str(tmp_path)).collect()
    sizes = {i: (len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t, _ in docs}
    assert {x.doc_id: (x.size, x.text_crc32) for x in got} == sizes and len(got) == 300
    sql = duckdb.sql(queries.ORACLES["op9_interleaved_shards"].replace("FROM documents", f"FROM '{path}/*.parquet'"))
    assert sorted(map(tuple, sql.fetchall())) == sorted(map(tuple, got)) and sql.columns == list(got[0].asDict())


def test_clashing_names(spark):
    df = spark.createDataFrame([(i, "ab"[i % 2], i, "r", 1, 2, 3, "s") for i in range(30)], "doc_id long, source string, _ps_s int, _rn string, _before int, _n int, shard int, _ps_rank string")
    out = sharding.interleaved(df, 4)
    assert out.columns == ["doc_id", "source", "_rn", "_before", "_n", "shard", "slot"]
    rows = out.collect()
    assert len(rows) == 30 and {r._rn for r in rows} == {"r"} and {r["shard"] for r in rows} == {0, 1, 2, 3}
