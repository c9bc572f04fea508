"""Structured Streaming over landed feeds: sources, idempotent appends, windows, joins, sinks."""

from __future__ import annotations

import threading
import time
from uuid import uuid4

from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StreamingQuery, StreamingQueryListener

from tremorlake.operators.checkpoints import drop_folder
from tremorlake.operators.tables import keep_latest


def feed_stream(spark: SparkSession, path: str, schema: T.StructType | str, fmt: str = "json", files_per_trigger: int = 1000, **options) -> DataFrame:
    """A stream of the files that land under ``path``, by a schema given beforehand."""
    return spark.readStream.format(fmt).schema(schema).option("maxFilesPerTrigger", files_per_trigger).options(**options).load(path)


def once_by_id(stream: DataFrame, ident: str, ts: str, delay: str = "7 days") -> DataFrame:
    """Rows of overlapping polls, each id once; ids are remembered for ``delay`` of event time."""
    return stream.withWatermark(ts, delay).dropDuplicatesWithinWatermark([ident])


def window_counts(stream: DataFrame, ts: str, keys: list[str], width: str, slide: str | None = None, delay: str = "1 hour") -> DataFrame:
    """Counts and greatest times by tumbling or sliding window of event time."""
    w = F.window(ts, width, slide) if slide else F.window(ts, width)
    return stream.withWatermark(ts, delay).groupBy(w, *keys).agg(F.count(F.lit(1)).alias("n"), F.max(ts).alias("newest")).select(F.col("window.start").alias("start"), *keys, "n", "newest")


def latest_values(stream: DataFrame, key: str, ts: str, cols: list[str]) -> DataFrame:
    """The newest values of each key, for update mode."""
    return stream.groupBy(key).agg(F.max(ts).alias(ts), F.max_by(F.struct(*cols), ts).alias("_v")).select(key, ts, "_v.*")


def match_feeds(left: DataFrame, right: DataFrame, ts: str, right_ts: str, unit: str = "minute", delay: str = "1 hour") -> DataFrame:
    """Left join of two feeds of the same time to the ``unit``; rows without a match come out when the watermark has passed."""
    a, b = left.withWatermark(ts, delay), right.withWatermark(right_ts, delay)
    near = (F.col(right_ts) >= F.col(ts) - F.expr(f"INTERVAL 1 {unit}")) & (F.col(right_ts) <= F.col(ts) + F.expr(f"INTERVAL 1 {unit}"))
    return a.join(b, (F.date_trunc(unit, ts) == F.date_trunc(unit, right_ts)) & near, "left_outer")


class BucketTable:
    """A table whose keys are hashed to buckets, each a partition folder. An upsert reads and rewrites the buckets of its rows only, by
    dynamic partition overwrite, so what it writes follows the batch. Readers that run at the same time may meet a bucket
    before or after its overwrite."""

    def __init__(self, spark: SparkSession, path: str, schema: T.StructType, key: list[str], buckets: int = 64):
        self.spark, self.path, self.schema, self.key, self.buckets = spark, path.rstrip("/"), schema, key, buckets

    def _exists(self, path: str) -> bool:
        at = self.spark._jvm.org.apache.hadoop.fs.Path(path)
        return at.getFileSystem(self.spark._jsc.hadoopConfiguration()).exists(at)

    def _read(self, path: str) -> DataFrame:
        return self.spark.read.schema(T.StructType([*self.schema, T.StructField("_bucket", T.IntegerType())])).parquet(path)

    def _with_bucket(self, df: DataFrame) -> DataFrame:
        return df.select(*self.schema.names, F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int").alias("_bucket"))

    def read(self) -> DataFrame:
        """The newest rows; none before the first upsert."""
        return self._read(self.path).drop("_bucket") if self._exists(self.path) else self.spark.createDataFrame([], self.schema)

    def upsert(self, df: DataFrame, order: str, batch: int) -> None:
        """Keeps the row of greatest ``order`` of each key, nulls last. The merged buckets are written aside first: a batch that is run again
        after a failure puts them in place again, and one that was done changes nothing."""
        aside = f"{self.path}-pending/{batch}"
        if not self._exists(f"{aside}/_SUCCESS"):
            new = self._with_bucket(df)
            if self._exists(self.path):
                touched = [r[0] for r in new.select("_bucket").distinct().collect()]  # at most the number of buckets
                new = new.unionByName(self._read(self.path).filter(F.col("_bucket").isin(touched)))
            keep_latest(new, self.key, [F.desc_nulls_last(order)]).repartition("_bucket").write.mode("overwrite").partitionBy("_bucket").parquet(aside)
        rows = self._read(aside).select(*self.schema.names, "_bucket")
        rows.repartition("_bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("_bucket").parquet(self.path)
        drop_folder(self.spark, f"{self.path}-pending/{batch - 1}")  # that batch is over, as this one came


def upsert_stream(stream: DataFrame, path: str, key: list[str], order: str, checkpoint: str, buckets: int = 64) -> StreamingQuery:
    """Keeps the newest row of each key in a ``BucketTable``."""
    table = BucketTable(stream.sparkSession, path, stream.schema, key, buckets)
    return stream.writeStream.foreachBatch(lambda batch, n: table.upsert(batch, order, n)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def append_or_heartbeat(stream: DataFrame, path: str, beat: dict, checkpoint: str) -> StreamingQuery:
    """Appends each batch; a batch without rows leaves one heartbeat row."""
    from tremorlake.operators.tables import heartbeat_if_empty

    def write(batch: DataFrame, number: int) -> None:
        heartbeat_if_empty(batch, beat).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def publish_stream(stream: DataFrame, path: str, checkpoint: str) -> StreamingQuery:
    """Each row as a JSON message in text files; for a broker set the format and its options instead."""
    value = stream.select(F.to_json(F.struct("*")).alias("value"))
    return value.writeStream.format("text").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


class RunLog(StreamingQueryListener):
    """Writes a row for each batch of a session's streams as it ends: (query, run, name, batch, at, rows, millis)."""

    SCHEMA = "query string, run string, name string, batch bigint, at string, rows bigint, millis bigint"

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path, self.ended = spark, path, {}

    def onQueryStarted(self, event) -> None:
        self.ended[str(event.runId)] = threading.Event()

    def onQueryProgress(self, event) -> None:
        p = event.progress
        row = (str(p.id), str(p.runId), p.name, p.batchId, p.timestamp, p.numInputRows, int(p.durationMs.get("triggerExecution", 0)))
        self.spark.createDataFrame([row], self.SCHEMA).coalesce(1).write.mode("append").parquet(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self.ended[str(event.runId)].set()

    def wait(self, query: StreamingQuery, seconds: float = 60) -> bool:
        """Until all of an ended query's batches are written, as its events come after it."""
        end = time.time() + seconds
        while str(query.runId) not in self.ended and time.time() < end:
            time.sleep(0.05)
        return str(query.runId) in self.ended and self.ended[str(query.runId)].wait(max(0, end - time.time()))

    def __enter__(self) -> RunLog:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def read(self) -> DataFrame:
        return self.spark.read.schema(self.SCHEMA).parquet(self.path)


class Silence(StatefulProcessor):
    """Counts rows of each feed, and beats when a feed has been silent for ``millis`` of processing time, and again after each such
    time. A timer of the feed's state does it, so it beats in batches to which no file came."""

    def __init__(self, millis: int):
        self.millis = millis

    def init(self, handle) -> None:
        self.handle = handle

    def _wind(self, timers) -> None:
        for t in list(self.handle.listTimers()):
            self.handle.deleteTimer(t)
        self.handle.registerTimer(timers.getCurrentProcessingTimeInMs() + self.millis)

    def handleInputRows(self, key, rows, timerValues):
        self._wind(timerValues)
        yield Row(feed=key[0], kind="data", n=sum(1 for _ in rows))

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo):
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)
        yield Row(feed=key[0], kind="beat", n=0)

    def handleInitialState(self, key, initialState, timerValues) -> None:
        self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + self.millis)

    def close(self) -> None:
        pass


def heartbeats(stream: DataFrame, feed: str, seconds: float, known: DataFrame | None = None) -> DataFrame:
    """A stream of (feed, kind, n): rows that came of each feed, kind ``data``, and a ``beat`` of each feed that was silent for
    ``seconds``. ``known``, a batch table with the same column, names feeds that may never have sent anything; without it a feed is
    known from its first row on. It needs the RocksDB state store: start it by ``start_heartbeats`` or set the provider."""
    first = known.select(F.col(feed).cast("string").alias("feed")).distinct().groupBy("feed") if known is not None else None
    by = stream.select(F.col(feed).cast("string").alias("feed")).groupBy("feed")
    return by.transformWithState(Silence(int(seconds * 1000)), "feed string, kind string, n bigint", "Append", "ProcessingTime", first)


def start_heartbeats(stream: DataFrame, feed: str, seconds: float, path: str, checkpoint: str, known: DataFrame | None = None, every: str = "1 second") -> StreamingQuery:
    """Appends ``heartbeats`` to Parquet files, with a batch ``every`` so often, whether a file has landed or not."""
    conf, name = stream.sparkSession.conf, "spark.sql.streaming.stateStore.providerClass"
    before = conf.get(name)
    conf.set(name, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:  # the query keeps the setting of its start
        return heartbeats(stream, feed, seconds, known).writeStream.format("parquet").option("path", path).outputMode("append").option("checkpointLocation", checkpoint).trigger(processingTime=every).start()
    finally:
        conf.set(name, before)


def run_to_table(stream: DataFrame, mode: str, base: str) -> DataFrame:
    """Runs a stream over all that has landed and gives its rows, written under ``base``."""
    run = f"{base.rstrip('/')}/stream-{uuid4().hex}"
    out = f"{run}/out"
    if mode == "append":
        q = stream.writeStream.format("parquet").option("path", out).outputMode("append").option("checkpointLocation", f"{run}/cp").trigger(availableNow=True).start()
    else:
        q = stream.writeStream.foreachBatch(lambda b, n: b.write.mode("overwrite").parquet(out)).outputMode("complete").option("checkpointLocation", f"{run}/cp").trigger(availableNow=True).start()
    q.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(out)
