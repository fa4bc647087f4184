"""What a session needs before queries run."""

from __future__ import annotations

import re
import tempfile
import uuid
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession


#: The most bytes of rows that a Python worker is sent at once, where the application sets no other bound. Texts differ much in length.
BATCH_BYTES = ("spark.sql.execution.arrow.maxBytesPerBatch", "16m")


def prepared(spark: SparkSession) -> SparkSession:
    """spark, with batches bounded in bytes and Python workers that find this package even when the driver was started in another folder.

    On a cluster the package is installed, or sent along with --py-files, and this changes nothing.
    """
    root = str(Path(__file__).resolve().parent.parent)
    env = spark.sparkContext.environment
    paths = [p for p in env.get("PYTHONPATH", "").split(":") if p]
    if root not in paths:
        env["PYTHONPATH"] = ":".join([*paths, root])
    if not spark.sparkContext.getConf().contains(BATCH_BYTES[0]):
        spark.conf.set(*BATCH_BYTES)
    return spark


def shared_dir(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir, which every executor can read.

    Only where one process does all the work (a local master, as in tests) and the session names no folder, a temporary one takes
    its place. Anywhere else a folder of one machine would lose rows without a word, so there the setting is required.
    """
    path = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir", None)
    if not path:
        if not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        path = getattr(spark.sparkContext, "_own_shared_dir", None)
        if not path:
            path = spark.sparkContext._own_shared_dir = "file://" + tempfile.mkdtemp(prefix="spark-")
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(path)
    return path


def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no other run uses."""
    return f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settled(df: DataFrame) -> DataFrame:
    """df computed once and read again from a table in the shared folder: its lineage ends there, and its size is known."""
    path = new_path(df.sparkSession, "step")
    df.write.parquet(path)
    out = df.sparkSession.read.schema(df.schema).parquet(path)
    out._settled_at = path
    return out


def forget(*frames: DataFrame) -> None:
    """Deletes the tables of settled frames that nothing reads any more."""
    for df in frames:
        path = df.sparkSession._jvm.org.apache.hadoop.fs.Path(df._settled_at)
        path.getFileSystem(df.sparkSession._jsc.hadoopConfiguration()).delete(path, True)
