"""Running a stream over what has arrived, into a table."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from themeloom.lineage import Workspace


FILES_PER_TRIGGER = 256  # so that a backlog is worked off in batches


def stream_of(
    spark: SparkSession, work: Workspace, name: str, table: DataFrame, files: int = FILES_PER_TRIGGER
) -> DataFrame:
    """A file stream over the folder that ``Workspace.save`` wrote ``name`` to."""
    return spark.readStream.schema(table.schema).option("maxFilesPerTrigger", files).parquet(f"{work.root}/{name}")


def drain_in_parts(
    rows: DataFrame, work: Workspace, name: str, make: Callable[[DataFrame], DataFrame], out: str, parts: int = 3
) -> DataFrame:
    """Lets ``rows`` arrive in ``parts`` by time, one micro-batch or more each, through one checkpoint."""
    spark = rows.sparkSession
    ends = rows.agg(F.min(F.unix_micros("ts")).alias("low"), F.max(F.unix_micros("ts")).alias("high")).first()
    low, high = ends["low"] or 0, ends["high"] or 0
    done = None
    for k in range(parts):
        at = F.least(F.floor((F.unix_micros("ts") - low) * parts / (high - low + 1)), F.lit(parts - 1))
        rows.filter(at == k).write.mode("append").parquet(f"{work.root}/{name}")
        done = drain(make(stream_of(spark, work, name, rows)), work, out)
    return done


def drain(stream: DataFrame, work: Workspace, name: str) -> DataFrame:
    """Appends all available rows to a parquet table and reads it back."""
    path = f"{work.root}/{name}"
    query = (
        stream.writeStream.format("parquet")
        .option("path", path)
        .option("checkpointLocation", f"{path}-checkpoint")
        .outputMode("append")
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
    return stream.sparkSession.read.schema(stream.schema).parquet(path)


def drain_batches(
    stream: DataFrame, handle: Callable[[DataFrame, int], None], checkpoint: str, mode: str = "append"
) -> None:
    """Hands every micro-batch to ``handle(batch, batch_id)`` until nothing is left."""
    query = (
        stream.writeStream.foreachBatch(handle)
        .option("checkpointLocation", checkpoint)
        .outputMode(mode)
        .trigger(availableNow=True)
        .start()
    )
    query.awaitTermination()
