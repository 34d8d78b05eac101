"""Run a stream over what is available and read its result.

The caller names the folder of a stream. It holds the checkpoint and the result, so a later call
with the same folder goes on where the last one ended and reads only new input. Append output goes
to the file sink; update output is kept per batch and read as the last row per key. Every batch
writes to a folder of its own number, so one that runs again after a failure replaces its own
output. A stream without input gives an empty table.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T


def drain_append(stream: DataFrame, folder: str) -> DataFrame:
    """Rows a stream has appended so far."""
    spark = stream.sparkSession
    (stream.writeStream.format("parquet").outputMode("append").option("path", f"{folder}/rows")
     .option("checkpointLocation", f"{folder}/log").trigger(availableNow=True).start().awaitTermination())
    return spark.read.schema(stream.schema).parquet(f"{folder}/rows")


def drain_update(stream: DataFrame, folder: str, keys: Sequence[str]) -> DataFrame:
    """Last state of every key of a stream in update mode."""
    rest = [c for c in stream.columns if c not in keys]
    rows = drain_numbered(stream, folder, lambda batch: batch, stream.schema, "update")
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*rest), "batch").alias("r")).select(*keys, "r.*")


def drain_numbered(stream: DataFrame, folder: str, each: Callable[[DataFrame], DataFrame], schema: T.StructType,
                   mode: str = "append") -> DataFrame:
    """What ``each`` makes of every batch so far, with the number of the batch."""
    store(stream.sparkSession.createDataFrame([], schema), folder, -1)
    drain_batches(stream, folder, lambda batch, number: store(each(batch), folder, number), mode)
    return stored(stream.sparkSession, folder, schema)


def store(rows: DataFrame, folder: str, number: int) -> None:
    rows.write.mode("overwrite").parquet(f"{folder}/rows/batch={number}")


def stored(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    numbered = T.StructType([*schema.fields, T.StructField("batch", T.LongType())])
    return spark.read.option("basePath", f"{folder}/rows").schema(numbered).parquet(f"{folder}/rows")


def drain_batches(stream: DataFrame, folder: str, each: Callable[[DataFrame, int], None], mode: str = "append") -> None:
    (stream.writeStream.foreachBatch(each).outputMode(mode).option("checkpointLocation", f"{folder}/log")
     .trigger(availableNow=True).start().awaitTermination())
