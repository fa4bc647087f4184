"""Versions that are published whole: the archive, the cache of chunks, and reports."""

import pytest
from pyspark.sql import functions as F

from tessel.operators import category
from tessel.sources import logs, store

UPLOADS = "content string, filename string, uploader string, at string"


def upload(spark, *rows):
    return spark.createDataFrame([(c, f"{c}.pdf", u, at) for c, u, at in rows], UPLOADS)


def archive(spark, folder):
    return {r.content_sha256: r for r in store.read_archive(spark, folder).collect()}


def folders(tmp_path):
    return {p.name for p in (tmp_path / "data").iterdir()}


def test_archive_rewrites_only_what_a_batch_touches(spark, tmp_path):
    folder = str(tmp_path)
    assert store.read_archive(spark, folder) is None
    rows = [(f"text {i}", "u", f"1{i}") for i in range(40)]
    store.merge_archive(upload(spark, *rows), folder, 0, parts=8)
    before = store.version(spark, folder)[1]["parts"]
    store.merge_archive(upload(spark, ("text 3", "v", "99"), ("text 3", "v", "98")), folder, 1, parts=5)
    after = store.version(spark, folder)[1]["parts"]
    assert sum(before[p] != after[p] for p in before) == 1 and len(after) == len(before) > 4
    whole = logs.archived(upload(spark, *rows, ("text 3", "v", "99"), ("text 3", "v", "98")))
    assert archive(spark, folder) == {r.content_sha256: r for r in whole.select(store.read_archive(spark, folder).columns).collect()}


def test_archive_counts_a_repeated_batch_once_and_survives_a_failed_one(spark, tmp_path, monkeypatch):
    folder = str(tmp_path)
    store.merge_archive(upload(spark, ("a", "u", "1")), folder, 0)
    store.merge_archive(upload(spark, ("a", "u", "1")), folder, 0)
    assert [r.access_count for r in archive(spark, folder).values()] == [1]
    with monkeypatch.context() as m:
        m.setattr(store, "publish", lambda *a: 1 / 0)  # it dies when its rows are written, but not published
        with pytest.raises(ZeroDivisionError):
            store.merge_archive(upload(spark, ("a", "u", "2"), ("b", "u", "2")), folder, 1)
    assert [r.access_count for r in archive(spark, folder).values()] == [1]
    store.merge_archive(upload(spark, ("a", "u", "2"), ("b", "u", "2")), folder, 1)
    assert sorted(r.access_count for r in archive(spark, folder).values()) == [1, 2]
    store.merge_archive(upload(spark, ("c", "u", "3")), folder, 2)
    before = folders(tmp_path)
    store.expire(spark, folder, lambda c: list(c["parts"].values()), stray_s=-1)
    assert len(before - folders(tmp_path)) == 1 and len(archive(spark, folder)) == 3  # what the failed batch left
    assert store.merge_archive(upload(spark), folder, 3) == 3 and len(archive(spark, folder)) == 3


def test_of_two_writers_one_starts_again(spark, tmp_path, monkeypatch):
    folder, real, calls = str(tmp_path), store.publish, []

    def late(*args):
        if not calls:
            calls.append(1)
            monkeypatch.setattr(store, "publish", real)
            store.merge_archive(upload(spark, ("other", "v", "5")), folder)
        return real(*args)

    monkeypatch.setattr(store, "publish", late)
    store.merge_archive(upload(spark, ("mine", "u", "6")), folder)
    assert sorted(r.filenames[0] for r in archive(spark, folder).values()) == ["mine.pdf", "other.pdf"]
    assert not store.publish(spark, folder, store.version(spark, folder)[0], {"parts": {}})
    assert not list((tmp_path / "versions").glob("*.draft"))


FILES = "path string, size long, modified string"


def test_cache_takes_apart_only_what_changed(spark, tmp_path):
    asked = []

    def chunked(files):
        asked.append(sorted(r.path for r in files.collect()))
        return files.select("path", F.explode(F.sequence(F.lit(1), F.col("size").cast("int"))).alias("chunk_ord"), F.concat("path", "modified").alias("text"))

    def read(*rows, version="v1"):
        got = store.cached_chunks(spark.createDataFrame(rows, FILES), str(tmp_path), chunked, version)
        return sorted((r.path, r.chunk_ord, r.text) for r in got.collect())

    want = lambda *rows: sorted((p, n + 1, p + m) for p, size, m in rows for n in range(size))
    a, b, c = ("a", 2, "1"), ("b", 1, "1"), ("c", 1, "1")
    assert read(a, b) == want(a, b) and read(a, b) == want(a, b) and asked == [["a", "b"]]
    new = ("b", 3, "2")
    assert read(a, new, c) == want(a, new, c) and asked[1:] == [["b", "c"]]
    assert read(new, c) == want(new, c) and read(new, c) == want(new, c) and asked[2:] == []
    assert read(new, c, version="v2") == want(new, c) and asked[2:] == [["b", "c"]]
    for k in range(2, 2 + store.FOLDERS + 2):  # folders are put together in the end
        c = ("c", 1, str(k))
        assert read(new, c, version="v2") == want(new, c) and asked[-1] == ["c"]
    assert len(store.version(spark, str(tmp_path))[1]["folders"]) <= store.FOLDERS
    before = folders(tmp_path)
    store.expire(spark, str(tmp_path), lambda c: [c["files"], *c["folders"]], stray_s=-1)
    assert folders(tmp_path) == before  # nothing is left behind
    assert read() == [] and len(folders(tmp_path)) <= 2 * store.FOLDERS + 4


def test_a_cache_of_nothing(spark, tmp_path):
    chunked = lambda files: files.select("path", F.lit("x").alias("text"))
    assert store.cached_chunks(spark.createDataFrame([], FILES), str(tmp_path), chunked).count() == 0


def test_readers_see_the_former_report_while_a_second_one_fails(spark, tmp_path, monkeypatch):
    def first_half(rows, path):
        rows.write.json(f"{path}/json")
        raise RuntimeError("lost")

    rows = spark.createDataFrame([("d", "one")], "domain string, text string")
    monkeypatch.setattr(category, "_write_report", lambda r, path: (r.write.json(f"{path}/json"), r.select("text").write.text(f"{path}/markdown")))
    assert category.report_folder(spark, str(tmp_path)) is None
    category.write_report(rows, str(tmp_path))
    with monkeypatch.context() as m:
        m.setattr(category, "_write_report", first_half)
        with pytest.raises(RuntimeError):
            category.write_report(rows.withColumn("text", F.lit("two")), str(tmp_path))
    now = category.report_folder(spark, str(tmp_path))
    assert spark.read.json(f"{now}/json").first().text == spark.read.text(f"{now}/markdown").first().value == "one"
    category.write_report(rows.withColumn("text", F.lit("three")), str(tmp_path))
    now = category.report_folder(spark, str(tmp_path))
    assert spark.read.json(f"{now}/json").first().text == spark.read.text(f"{now}/markdown").first().value == "three"
