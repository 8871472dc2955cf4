"""Incremental variants: arriving files are processed once, in micro-batches.

State and output live in the shared stage folder; every run names its own
checkpoint, so a restarted query goes on where it stopped.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.windows import dense_index
from ..sources.stage import path_exists
from ..sources.tables import schema_of


def arriving(spark: SparkSession, folder: str, table: str, pattern: str | None = None, files_per_batch: int | None = None) -> DataFrame:
    """Stream the files of a table as they arrive in a folder."""
    reader = spark.readStream.schema(schema_of(table)).option("pathGlobFilter", pattern or f"{table}.parquet")
    if files_per_batch:
        reader = reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(folder)


def finish(query: StreamingQuery) -> None:
    """Wait for the available data to be processed; raises what the query raised."""
    query.awaitTermination()


def running_dictionary(stream: DataFrame, cols: Sequence[str], out: str, checkpoint: str, name: str = "value") -> StreamingQuery:
    """Append each value to the output when it is first seen.

    The state holds one entry per distinct value, spread over the shuffle
    partitions; arriving rows are deduplicated within a task first.
    """
    values = stream.select(F.explode(F.array(*cols)).alias(name)).where(F.col(name).isNotNull())
    return (
        values.dropDuplicates([name]).writeStream.format("parquet").outputMode("append")
        .option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def stable_ids(stream: DataFrame, cols: Sequence[str], out: str, checkpoint: str, name: str = "value") -> StreamingQuery:
    """Number each value when it is first seen; it keeps its id over batches and restarts, and ids are dense.

    The keyed state of the deduplication lets only new values through. A batch numbers its
    own in their order, from the count of all earlier batches on, and writes them to a
    folder of its number: a batch that is repeated finds the same values, the same
    start and so the same ids.
    """
    values = stream.select(F.explode(F.array(*cols)).alias(name)).where(F.col(name).isNotNull())

    def number(batch: DataFrame, batch_id: int) -> None:
        spark = batch.sparkSession
        # A new batch has a higher number; a repeated one must not count itself.
        start = ids_of(spark, out, name).where(F.col("batch") < batch_id).count() if batch_id and path_exists(spark, out) else 0
        rows = dense_index(batch, [name], "id")
        rows.select(name, (F.col("id") + start).alias("id")).write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        values.dropDuplicates([name]).writeStream.foreachBatch(number).outputMode("append")
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def ids_of(spark: SparkSession, out: str, name: str = "value") -> DataFrame:
    """The values numbered so far, with the batch that saw them first."""
    return spark.read.schema(f"{name} string, id bigint, batch int").parquet(out)


def running_counts(stream: DataFrame, cols: Sequence[str], out: str, checkpoint: str) -> StreamingQuery:
    """Keep a table of row counts per combination; each batch replaces it.

    Batches write to a folder of their own number, so a repeated batch replaces
    itself; read the highest.
    """
    counts = stream.groupBy(*cols).agg(F.count(F.lit(1)).alias("n"))

    def replace(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={batch_id}")

    return (
        counts.writeStream.outputMode("complete").foreachBatch(replace)
        .option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    )


def latest_counts(spark: SparkSession, out: str) -> DataFrame:
    """The counts the last finished batch wrote."""
    every = spark.read.parquet(out)
    last = every.agg(F.max("batch")).head()[0]
    return every.where(F.col("batch") == last).drop("batch")


def per_group_sink(
    stream: DataFrame, transform: Callable[[DataFrame], DataFrame], group: str, out: str, checkpoint: str
) -> StreamingQuery:
    """Transform every batch and add it to one folder per group.

    A batch that is repeated after a failure overwrites the files of its number.
    """
    def write(batch: DataFrame, batch_id: int) -> None:
        transform(batch).write.mode("overwrite").partitionBy(group).parquet(f"{out}/batch={batch_id}")

    return (
        stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
        .trigger(availableNow=True).start()
    )
