"""Append-only logs and the archive of uploads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

USAGE = "at string, user string, action string, detail string"
FEEDBACK = "created_at string, user string, type string, message string, contact string, context string"


def tail(rows: DataFrame, limit: int, order: str = "line_ord") -> DataFrame:
    """The last rows by position in the log, the newest first."""
    return rows.orderBy(F.col(order).desc()).limit(limit)


def read_log(spark: SparkSession, path: str, schema: str = USAGE) -> DataFrame:
    """Rows of a JSON-lines log with line_ord; blank and broken lines are left out, fields that old rows lack are null."""
    rows = spark.read.schema(schema + ", _corrupt_record string").option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_corrupt_record").json(path)
    return rows.withColumn("line_ord", F.monotonically_increasing_id()).where("_corrupt_record is null").drop("_corrupt_record")


def append_usage(rows: DataFrame, path: str) -> None:
    """Appends (at, user, action, detail) with details of at most 300 characters."""
    rows.select("at", "user", "action", F.substring("detail", 1, 300).alias("detail")).write.mode("append").json(path)


def answer_detail(mode: Column, model: Column, question: Column, answer: Column) -> Column:
    return F.substring(F.concat_ws(" | ", mode, model, question, answer), 1, 300)


def feedback_rows(rows: DataFrame) -> DataFrame:
    """Feedback as it is stored: fields cut to their limits, rows with a blank message left out."""
    cut = {"type": 80, "message": 3000, "contact": 160}
    done = rows.withColumns({k: F.substring(F.trim(k), 1, n) for k, n in cut.items()})
    return done.where(F.col("message") != "")


def archived(uploads: DataFrame) -> DataFrame:
    """One row for each content of uploads(content, filename, uploader, at): counts, first and last time, names and uploaders.

    doc_id is the first 16 digits of the content's SHA-256. The grouping combines before its shuffle, so it is the same for a
    new archive and for more uploads added to one (see merged).
    """
    digest = F.sha2(F.col("content").cast("binary"), 256)
    return uploads.withColumn("content_sha256", digest).groupBy("content_sha256").agg(
        F.substring(F.first("content_sha256"), 1, 16).alias("doc_id"), F.count(F.lit(1)).alias("access_count"), F.min("at").alias("first_uploaded_at"), F.max("at").alias("last_uploaded_at"),
        F.array_sort(F.collect_set("filename")).alias("filenames"), F.array_sort(F.collect_set("uploader")).alias("uploaded_by"),
    )


def merged(archive: DataFrame, more: DataFrame) -> DataFrame:
    """Two archives as one: counts added, times and sets united."""
    return archive.unionByName(more).groupBy("content_sha256").agg(
        F.first("doc_id").alias("doc_id"), F.sum("access_count").alias("access_count"), F.min("first_uploaded_at").alias("first_uploaded_at"), F.max("last_uploaded_at").alias("last_uploaded_at"),
        F.array_sort(F.array_distinct(F.flatten(F.collect_list("filenames")))).alias("filenames"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("uploaded_by")))).alias("uploaded_by"),
    )


def listing(archive: DataFrame) -> DataFrame:
    name = F.element_at("filenames", 1)
    return archive.withColumn("name", name).orderBy(F.lower("name"), "first_uploaded_at", "doc_id")
