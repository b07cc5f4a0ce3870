"""A job that goes on where it stopped: new files of a folder are processed once each.

The batch operators need no stream; this is for long annotation jobs (stress marks, fetched pages) whose work so far
must outlive a restart. Structured Streaming keeps the list of finished files in the checkpoint folder; each batch
is written under its own number, so a repeated batch overwrites itself.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T


def process_new_files(spark: SparkSession, source: str, schema: T.StructType, work: Callable[[DataFrame], DataFrame], out: str, checkpoint: str, files_per_batch: int = 500) -> None:
    """Applies ``work`` to the Parquet files of ``source`` that earlier calls haven't seen, and returns when done."""
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(source)

    def write(batch: DataFrame, number: int) -> None:
        work(batch).write.mode("overwrite").parquet(f"{out}/batch={number}")

    stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
