"""Append newly arriving flight CSV files to the partitioned flights table.

The analyses read one flat table; in production new monthly extracts keep
arriving. This is the same read -> prepare -> write as the batch path, run
as a Structured Streaming query over a folder: the file source tracks
which files were processed, and each micro-batch reads its files by their
headers, as the batch reader does, so files may have any column order.

A micro-batch is written under its own ``INGEST`` value (query and batch
number) by replacing just that partition: a batch that runs again after a
lost driver writes the same rows to the same place, so each file counts
once. ``trigger(availableNow=True)`` processes whatever is new and stops (a
scheduled incremental job). The stream's progress lives in the cluster's
checkpoint folder, so a restarted job resumes where it stopped.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.prep import prepare
from ..session import checkpoint_dir
from ..sources.readers import _path, read_flights_csv

QUERY_ID = "sql.streaming.queryId"      # Spark's own property of a micro-batch


def ingest_csv(spark: SparkSession, source_dir: str, table_path: str, columns: Iterable[str] = (),
               checkpoint: str | None = None, max_files_per_trigger: int | None = None,
               available_now: bool = True):
    """Start the ingest query; returns the ``StreamingQuery``.

    ``columns`` names what every file's header must hold, in any order; a
    file that lacks one fails the query before anything of its batch is
    written. ``checkpoint`` defaults to ``<spark.checkpoint.dir>/ingest-flights``.
    """
    ckpt = checkpoint or f"{checkpoint_dir(spark).rstrip('/')}/ingest-flights"
    required = list(columns)

    def write(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        # the files of this batch, as many as the trigger takes
        files = [r["path"] for r in batch.select(F.col("path")).distinct().collect()]
        if not files:
            return
        rows = prepare(read_flights_csv(session, [_path(f) for f in files], required=required))
        name = f"{session.sparkContext.getLocalProperty(QUERY_ID)}-{number}"
        (rows.withColumn("INGEST", F.lit(name)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
         .partitionBy("INGEST", "YEAR").parquet(table_path))

    reader = spark.readStream
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    lines = reader.text(source_dir).select(F.col("_metadata.file_path").alias("path"), F.col("_metadata.file_block_start").alias("start"))
    w = lines.writeStream.foreachBatch(write).option("checkpointLocation", ckpt)
    w = w.trigger(availableNow=True) if available_now else w.trigger(processingTime="1 minute")
    return w.start()
