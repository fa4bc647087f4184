"""A usage log as a stream: counts by window with late rows, and the archive kept up to date by micro-batches."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.logs import USAGE
from ..sources.store import merge_archive


def usage_stream(spark: SparkSession, path: str) -> DataFrame:
    """Rows of JSON-lines files as they arrive, with at as a timestamp; broken rows are dropped."""
    rows = spark.readStream.schema(USAGE).json(path)
    return rows.withColumn("at", F.try_to_timestamp("at")).where(F.col("at").isNotNull())


def counts_by_window(rows: DataFrame, width: str = "1 hour", late: str = "1 hour") -> DataFrame:
    return rows.withWatermark("at", late).groupBy(F.window("at", width), "action").agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("start"), "action", "n")


def keep_archive(uploads: DataFrame, folder: str, checkpoint: str) -> StreamingQuery:
    """Merges each micro-batch of uploads into the archive under folder (see sources.store): a batch that runs again after a failure
    counts once, and only the parts that it touches are written."""
    return uploads.writeStream.foreachBatch(lambda batch, number: merge_archive(batch, folder, number)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
