"""Follows a folder of JSON-lines files: new runs go to a table, and a summary over all runs so far is made again.

The file source picks up new files, so a writer lands one file per batch.
Malformed lines are dropped.  The offset log makes each file count once; a
batch that is repeated after a failure replaces its own part of the table.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.history import SCHEMA, flatten


def run_stream(spark: SparkSession, folder: str, max_files: int = 100) -> DataFrame:
    schema = f"{SCHEMA}, _bad string"
    rows = spark.readStream.schema(schema).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad").option("maxFilesPerTrigger", max_files).json(folder)
    return flatten(rows.where("_bad is null and run_id is not null").drop("_bad"))


def follow(spark: SparkSession, folder: str, table: str, checkpoint: str, on_batch: Callable[[DataFrame, DataFrame, int], None], once: bool = False, every: str = "1 second") -> StreamingQuery:
    """Starts the query; ``on_batch`` gets (new runs, all runs, batch number) of every batch that has runs."""

    def step(batch: DataFrame, number: int) -> None:
        batch = batch.drop("phase")
        batch.write.mode("overwrite").parquet(f"{table}/batch={number}")
        new = spark.read.parquet(f"{table}/batch={number}")
        if new.head(1):
            on_batch(new, spark.read.option("basePath", table).parquet(table), number)

    writer = run_stream(spark, folder).writeStream.foreachBatch(step).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer.trigger(processingTime=every)).start()


def windowed(runs: DataFrame, width: str = "10 minutes", late: str = "10 minutes") -> DataFrame:
    """Runs, slower runs and mean time per profile and tumbling window; late data is kept for ``late``."""
    r = runs.withWatermark("ts", late)
    return r.groupBy(F.window("ts", width), "profile").agg(F.count("*").alias("runs"), F.count_if(F.col("ms") > F.col("ref_ms")).alias("slower"), F.avg("ms").alias("mean_ms"))
