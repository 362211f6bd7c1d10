"""Run a stream over what its source holds now."""

from __future__ import annotations

import datetime
from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F

from loomset.storage import scratch_path

# Event time of the row that closes a bounded stream: behind any other.
_END = datetime.datetime(9000, 1, 1)


def _run(stream: DataFrame, path: str) -> DataFrame:
    query = (
        stream.writeStream.format("parquet")
        .option("path", f"{path}/table")
        .option("checkpointLocation", f"{path}/checkpoint")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(f"{path}/table")


def drain(stream: DataFrame, name: str) -> DataFrame:
    """Process all available input into a parquet table of the shared folder; return the table.

    Only rows the stream has emitted are in it: windows still open are not.
    """
    return _run(stream, scratch_path(stream.sparkSession, name))


def drain_all(
    source: DataFrame, build: Callable[[DataFrame], DataFrame], name: str, ts: str = "ts"
) -> DataFrame:
    """``drain`` of ``build(source)`` for a source that will get no more input: open windows are emitted too.

    The source is read together with a folder that is empty at first. After
    all input a row of a far event time is put there and the stream goes on:
    the watermark passes the end of every window. That row's own window stays
    open and is never emitted.
    """
    spark = source.sparkSession
    path = scratch_path(spark, name)
    empty = spark.createDataFrame([], source.schema)
    empty.write.parquet(f"{path}/closing")
    closing = spark.readStream.schema(source.schema).parquet(f"{path}/closing")
    stream = build(source.unionByName(closing))
    _run(stream, path)
    last = spark.range(1).select(
        *[
            (F.lit(_END) if f.name == ts else F.lit(None)).cast(f.dataType).alias(f.name)
            for f in source.schema
        ]
    )
    last.write.mode("append").parquet(f"{path}/closing")
    return _run(stream, path)
