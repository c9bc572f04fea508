"""Helpers shared by the operators: Arrow maps, word splitting, checkpoints."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from tremorlake.operators.checkpoints import checkpointed, drop_folder, shared_dir, written

__all__ = ["CHUNK", "arrow_keep", "arrow_map", "checkpointed", "drop_folder", "hold_batches", "shared_dir", "small_batches", "split_words", "written"]

#: Rows handed to a worker function at once.
CHUNK = 512
#: About how many bytes Spark sends to a Python worker at once. The default of 10,000 rows or 64 MB lies in a task's memory
#: several times, outside the heap: as Arrow vectors, as the bytes to be sent, and in the worker.
BATCH_BYTES = 4 << 20
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def hold_batches(spark: SparkSession) -> None:
    """From now on the session sends batches of about ``BATCH_BYTES`` to Python workers; for a program that owns its session."""
    spark.conf.set(_BATCH, str(BATCH_BYTES))


@contextmanager
def small_batches(spark: SparkSession) -> Iterator[None]:
    """What runs inside sends batches of about ``BATCH_BYTES`` to Python workers; a frame that is only made inside does not."""
    before = spark.conf.get(_BATCH)
    hold_batches(spark)
    try:
        yield
    finally:
        spark.conf.set(_BATCH, before)


def split_words(text: str) -> list[str]:
    """Words of ``[^\\x20\\x09-\\x0D]+``: bytes split at ASCII white space, and at nothing else."""
    parts = text.encode("utf-8", "surrogatepass").split()
    return b"\n".join(parts).decode("utf-8", "surrogatepass").split("\n")[: len(parts)]


def arrow_map(df: DataFrame, schema: str, make: Callable[[], Callable[..., dict]]) -> DataFrame:
    """Map ``df`` by chunks of rows: ``make()`` runs once a task and gives a function from
    column lists (by keyword) to the lists of the result's columns."""
    arrow = to_arrow_schema(T.StructType.fromDDL(schema))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or make()
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                out = f(**{n: part.column(i).to_pylist() for i, n in enumerate(part.schema.names)})
                yield pa.RecordBatch.from_pydict(out, schema=arrow)

    return df.mapInArrow(run, schema)


def arrow_keep(df: DataFrame, cols: list[str | None], make: Callable[[], Callable[..., list]]) -> DataFrame:
    """The rows of ``df``, all columns as they are, for which ``make()`` is true of the columns named
    (a list of nulls for None). Columns are taken by position, so extra names do no harm."""
    places = [c and df.columns.index(c) for c in cols]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        f = None
        for batch in batches:
            f = f or make()
            for at in range(0, batch.num_rows, CHUNK):
                part = batch.slice(at, CHUNK)
                given = [[None] * part.num_rows if i is None else part.column(i).to_pylist() for i in places]
                yield part.filter(pa.array(f(*given), pa.bool_()))

    return df.mapInArrow(run, df.schema)
