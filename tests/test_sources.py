"""Readers, logs, the archive and streams."""

import io
import zipfile

from pyspark.sql import functions as F

from tessel.sources import documents, logs, store
from tessel.streaming import logs as streams


def docx(*paragraphs):
    ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t><w:tab/><w:t>end</w:t></w:r></w:p>" for p in paragraphs)
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr("word/document.xml", f"<w:document {ns}><w:body>{body}</w:body></w:document>")
    return out.getvalue()


def test_read_documents(spark, tmp_path):
    (tmp_path / "a.docx").write_bytes(docx("one", "two"))
    (tmp_path / "b.txt").write_bytes("限值 5 mm".encode("gb18030"))
    (tmp_path / "c.md").write_bytes("é".encode())
    (tmp_path / "d.doc").write_bytes(b"x")
    (tmp_path / "e.docx").write_bytes(b"broken")
    got = {r.doc_id.rsplit("/", 1)[1]: r.text for r in documents.read_documents(spark, str(tmp_path)).collect()}
    assert got == {"a.docx": "one\tend\ntwo\tend", "b.txt": "限值 5 mm", "c.md": "é", "e.docx": ""}


def test_logs(spark, tmp_path):
    rows = spark.createDataFrame([("2026-01-01T00:00:00Z", "u", "ask", "x" * 400)], "at string, user string, action string, detail string")
    logs.append_usage(rows, f"{tmp_path}/log")
    (tmp_path / "log" / "more.json").write_text('{"at": "2026-01-01T00:10:00Z", "action": "ask"}\nnot json\n')
    got = logs.read_log(spark, f"{tmp_path}/log").collect()
    assert sorted(len(r.detail or "") for r in got) == [0, 300]
    feedback = spark.createDataFrame([("t", " hi ", "c"), ("t", "  ", "c")], "type string, message string, contact string")
    assert [r.message for r in logs.feedback_rows(feedback).collect()] == ["hi"]


UPLOADS = "content string, filename string, uploader string, at string"


def test_archive_merges(spark):
    rows = [("x", "b.pdf", "u", "2"), ("x", "a.pdf", "v", "1"), ("y", "c.pdf", "u", "3")]
    whole = logs.archived(spark.createDataFrame(rows, UPLOADS))
    parts = logs.merged(logs.archived(spark.createDataFrame(rows[:1], UPLOADS)), logs.archived(spark.createDataFrame(rows[1:], UPLOADS)))
    assert sorted(map(tuple, whole.select(sorted(whole.columns)).collect())) == sorted(map(tuple, parts.select(sorted(whole.columns)).collect()))
    assert [r.name for r in logs.listing(whole).collect()] == ["a.pdf", "c.pdf"]


def test_streams(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "1.json").write_text('{"at": "2026-01-01T00:10:00Z", "action": "ask"}\n{"at": "2026-01-01T00:20:00Z", "action": "ask"}\n{"at": "bad", "action": "ask"}\n')
    q = streams.counts_by_window(streams.usage_stream(spark, f"{tmp_path}/in")).writeStream.outputMode("complete").format("memory").queryName("usage_counts").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert [(r.action, r.n) for r in spark.table("usage_counts").collect()] == [("ask", 2)]


def test_archive_stream(spark, tmp_path):
    spark.createDataFrame([("x", "a.pdf", "u", "1")], UPLOADS).write.json(f"{tmp_path}/up")
    q = streams.keep_archive(spark.readStream.schema(UPLOADS).json(f"{tmp_path}/up"), f"{tmp_path}/archive", f"{tmp_path}/cp")
    q.awaitTermination(120)
    assert store.read_archive(spark, f"{tmp_path}/archive").select("access_count").first()[0] == 1


def test_corpus(spark):
    manifest = spark.createDataFrame([("a\\b.pdf",), ("c.XML",), ("d.txt",), ("gone.pdf",)], "path string")
    files = spark.createDataFrame([("a/b.pdf",), ("c.XML",), ("d.txt",)], "path string")
    assert sorted(r.path for r in documents.corpus_files(manifest, files).collect()) == ["a/b.pdf", "c.XML"]
    one = files.select("path", F.lit("1").alias("size"), F.lit("2").alias("modified"))
    assert documents.fingerprint(one, "v1").first() == documents.fingerprint(one.orderBy(F.desc("path")), "v1").first() != documents.fingerprint(one, "v2").first()
