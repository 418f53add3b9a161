"""Streams that run to the end of their input: sources, and sinks that a restart or a replay does not change."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from .. import storage


def table_stream(spark: SparkSession, folder: str, table: str, **options) -> DataFrame:
    """The Parquet table of a folder, one file or many, as a stream."""
    path = f"{folder}/{table}.parquet"
    schema = spark.read.parquet(path).schema
    reader = spark.readStream.schema(schema).options(recursiveFileLookup=True, **options)
    if storage.is_folder(spark, path):
        return reader.parquet(path)
    return reader.option("pathGlobFilter", f"{table}.parquet").parquet(folder)


def _to_the_end(writer, checkpoint: str) -> None:
    query = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    try:
        query.awaitTermination()
    finally:
        query.stop()


def append_rows(stream: DataFrame, out: str, checkpoint: str) -> None:
    """All rows that the input has, appended once each: the file sink keeps a log of its batches."""
    _to_the_end(stream.writeStream.format("parquet").outputMode("append").option("path", out), checkpoint)


def write_batches(stream: DataFrame, out: str, checkpoint: str, make: Callable[[DataFrame, int], DataFrame]) -> None:
    """``make`` of each batch, in the folder of the batch's number: a batch that comes again, after a lost
    commit, overwrites its own rows and nothing else."""

    def write(batch: DataFrame, number: int) -> None:
        make(batch, number).write.mode("overwrite").parquet(f"{out}/batch={number}")

    _to_the_end(stream.writeStream.foreachBatch(write), checkpoint)


def read_rows(spark: SparkSession, out: str, schema) -> DataFrame:
    """What a sink holds; no rows where it has written none."""
    return spark.read.schema(schema).parquet(out) if storage.exists(spark, out) else spark.createDataFrame([], schema)
