"""Change statistics over a stream of changes: the tumbling-window form of the history aggregates."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quoin.plans.storage import shared_dir


def windowed_churn(changes: DataFrame, late: str = "1 hour", width: str = "1 hour") -> DataFrame:
    """(hour, path, changes, churn, last) from (ts, path, churn); state is dropped once late has passed."""
    kept = changes.withWatermark("ts", late)
    sums = kept.groupBy(F.window("ts", width).alias("w"), "path").agg(F.count("*").alias("changes"), F.sum("churn").alias("churn"), F.max("ts").alias("last"))
    return sums.select(F.col("w.start").alias("hour"), "path", "changes", F.round("churn", 4).alias("churn"), "last")


def replayed_churn(spark: SparkSession, path: str) -> DataFrame:
    """windowed_churn() of a file of events, run as a stream to its end.

    Each batch adds the windows that it changed to a folder, under its own number, so that a batch that is repeated
    replaces what it wrote; of a window the last batch counts. The stream's progress and state are in the shared folder.
    """
    schema = spark.read.parquet(path).schema
    folder, _, name = path.rpartition("/")
    events = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    changes = events.select(F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("path"), F.col("value").alias("churn"))
    windows, out = windowed_churn(changes), f"{shared_dir(spark)}/churn-{uuid.uuid4().hex}"

    def keep(rows: DataFrame, batch: int) -> None:
        rows.write.mode("overwrite").parquet(f"{out}/rows/batch={batch}")

    query = windows.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", f"{out}/progress").trigger(availableNow=True).start()
    query.awaitTermination()
    if query.exception() is not None:
        raise query.exception()
    last = F.max_by(F.struct("changes", "churn", "last"), "batch").alias("x")
    told = spark.read.schema(windows.schema.add("batch", "long")).parquet(f"{out}/rows")
    return told.groupBy("hour", "path").agg(last).select("hour", "path", "x.*")
