"""Tables that are published in versions: readers see one version whole, and a writer that fails leaves no trace in it.

A version is a small JSON file, versions/<number>.json, that names the folders it is made of. It gets its name by a rename that fails
where the name is taken, so of two writers one wins and the other starts again from the new version. Folders are never written to
again; expire deletes what no kept version names, so readers should not hold on to one for longer than KEPT versions.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .logs import archived, merged

#: Parts of an archive by the hash of the content, and versions that are kept for readers that still use them.
PARTS, KEPT = 64, 2
#: Seconds after which a folder that no version names is taken for what a failed writer left.
STRAY_S = 7 * 24 * 3600
#: Folders of a corpus cache after which they are put together.
FOLDERS = 8


def _path(spark: SparkSession, *parts: str):
    path = spark._jvm.org.apache.hadoop.fs.Path("/".join(p.rstrip("/") for p in parts))
    return path.getFileSystem(spark._jsc.hadoopConfiguration()), path


def _numbers(spark: SparkSession, folder: str) -> list[int]:
    fs, path = _path(spark, folder, "versions")
    return sorted(int(f.getPath().getName()[:-5]) for f in fs.listStatus(path) if f.getPath().getName().endswith(".json")) if fs.exists(path) else []


def version(spark: SparkSession, folder: str, number: int | None = None) -> tuple[int, dict]:
    """(number, what it names) of a version, the latest if none is asked for; (-1, {}) where there is none."""
    numbers = _numbers(spark, folder)
    if number is None and not numbers:
        return -1, {}
    number = numbers[-1] if number is None else number
    fs, path = _path(spark, folder, "versions", f"{number:012d}.json")
    stream = fs.open(path)
    try:
        return number, json.loads(bytes(stream.readAllBytes()).decode())
    finally:
        stream.close()


def publish(spark: SparkSession, folder: str, number: int, content: dict) -> bool:
    """Makes content the version of this number; False if another writer has made one.

    The text is written under a name of its own and then renamed to one that must be free, so no reader sees half of it.
    """
    fs, path = _path(spark, folder, "versions", f"{number:012d}.json")
    _, draft = _path(spark, folder, "versions", f"{uuid.uuid4().hex}.draft")
    fs.mkdirs(path.getParent())
    stream = fs.create(draft, False)
    try:
        stream.write(json.dumps(content, ensure_ascii=False).encode())
    finally:
        stream.close()
    kinds = spark._jvm.org.apache.hadoop.fs.Options.Rename
    never_over = spark.sparkContext._gateway.new_array(kinds, 1)
    never_over[0] = kinds.NONE
    try:
        spark._jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark._jsc.hadoopConfiguration()).rename(draft, path, never_over)
    except Py4JJavaError as e:
        fs.delete(draft, False)
        if "FileAlreadyExistsException" in str(e.java_exception.getClass()):
            return False
        raise
    return True


def new_folder(folder: str) -> str:
    return f"{folder.rstrip('/')}/data/{uuid.uuid4().hex}"


def expire(spark: SparkSession, folder: str, named: Callable[[dict], list[str]], keep: int = KEPT, stray_s: int = STRAY_S) -> None:
    """Deletes all but the latest versions, and the data folders that only these named.

    A folder that no version names may be another writer's, not published yet; it goes once it is stray_s seconds old.
    """
    numbers = _numbers(spark, folder)
    of = lambda ks: {n.rsplit("/data/", 1)[1].split("/")[0] for k in ks for n in named(version(spark, folder, k)[1])}
    used, old = of(numbers[-keep:]), of(numbers[:-keep])
    fs, data = _path(spark, folder, "data")
    for f in fs.listStatus(data) if fs.exists(data) else []:
        name, age = f.getPath().getName(), time.time() - f.getModificationTime() / 1000
        if name not in used and (name in old or age > stray_s):
            fs.delete(f.getPath(), True)
    for k in numbers[:-keep]:
        fs.delete(_path(spark, folder, "versions", f"{k:012d}.json")[1], False)


# The archive of uploads

_BUCKET = lambda parts: F.pmod(F.xxhash64("content_sha256"), F.lit(parts)).cast("int")


def read_archive(spark: SparkSession, folder: str) -> DataFrame | None:
    """The archive's rows in its latest version; None before there is one."""
    paths = sorted(version(spark, folder)[1].get("parts", {}).values())
    return spark.read.parquet(*paths) if paths else None


def merge_archive(uploads: DataFrame, folder: str, batch: int | None = None, parts: int = PARTS) -> int:
    """Adds uploads(content, filename, uploader, at) to the archive under folder; the number of the version that holds them.

    Only parts with new contents are read and written again. batch: the number of a micro-batch; one that the archive has already is
    left out, so a batch that runs again after a failure counts once. The number of parts is that of the first version.
    """
    spark = uploads.sparkSession
    new = archived(uploads).withColumn("part", _BUCKET(parts))
    while True:
        number, now = version(spark, folder)
        if batch is not None and batch <= now.get("batch", -1):
            return number
        held, count = now.get("parts", {}), now.get("count", parts)
        new = new.withColumn("part", _BUCKET(count))
        touched = sorted(r[0] for r in new.select("part").distinct().collect())  # at most the number of parts
        old = [held[str(p)] for p in touched if str(p) in held]
        rows = new.drop("part")
        if old:
            rows = merged(spark.read.parquet(*old), rows)
        out = new_folder(folder)
        rows.withColumn("part", _BUCKET(count)).repartition("part").write.partitionBy("part").parquet(out)
        content = {"parts": held | {str(p): f"{out}/part={p}" for p in touched}, "count": count, "batch": now.get("batch", -1) if batch is None else batch}
        if publish(spark, folder, number + 1, content):
            expire(spark, folder, lambda c: list(c["parts"].values()))
            return number + 1


# The cache of search chunks


def file_state(files: DataFrame, *settings: str) -> DataFrame:
    """(path, state) of files(path, size, modified): a hash that changes with the file or the settings by which it is taken apart."""
    return files.select("path", F.sha2(F.concat_ws("|", "path", "size", "modified", *[F.lit(s) for s in settings]), 256).alias("state"))


def cached_chunks(files: DataFrame, folder: str, chunked: Callable[[DataFrame], DataFrame], *settings: str) -> DataFrame:
    """Search chunks of files(path, size, modified), from the cache under folder where a file is as it was.

    chunked gives (path, ..) chunks of some of files; it is asked for new and changed files only, and not at all if there are none. What
    belongs to removed files goes. The columns of chunks must stay the same; other columns need another folder.
    """
    spark = files.sparkSession
    while True:
        number, now = version(spark, folder)
        state = file_state(files, *settings)
        live = spark.read.parquet(now["files"]) if now else None
        stale = state if live is None else state.join(live, ["path", "state"], "left_anti")
        gone = None if live is None else live.join(state, ["path", "state"], "left_anti")
        changed = not stale.isEmpty() if live is not None else True
        if not changed and gone.isEmpty():
            return _cached(spark, now)
        folders = now.get("folders", [])
        kept, out = new_folder(folder), new_folder(folder)
        state.write.parquet(kept)
        if changed:
            todo = files.join(stale.select("path"), "path", "left_semi")
            made = chunked(todo).join(stale, "path")
            if len(folders) >= FOLDERS:
                made = made.unionByName(_cached(spark, now, state=True).join(state, ["path", "state"], "left_semi"))
                folders = []
            made.write.parquet(out)
            folders = [*folders, out]
        if publish(spark, folder, number + 1, {"files": kept, "folders": folders}):
            expire(spark, folder, lambda c: [c["files"], *c["folders"]])
            return _cached(spark, version(spark, folder, number + 1)[1])


def _cached(spark: SparkSession, now: dict, state: bool = False) -> DataFrame:
    live = spark.read.parquet(now["files"])
    rows = spark.read.parquet(*now["folders"]).join(live, ["path", "state"], "left_semi")
    return rows if state else rows.drop("state")
