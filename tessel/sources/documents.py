"""Document scans: files by format, to pages(doc_id, page, text, text_source)."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from . import markup as xml

PAGES = "doc_id string, page int, text string, text_source string"
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def format_of(path: Column) -> Column:
    """docx, txt, rejected (.doc) or pdf (all else), by the suffix."""
    suffix = F.lower(F.regexp_extract(path, r"\.[^./\\]+$", 0))
    return F.when(suffix == ".docx", "docx").when(suffix.isin(".txt", ".md"), "txt").when(suffix == ".doc", "rejected").otherwise("pdf")


def kind_of_content(content: Column) -> Column:
    """pdf or xml by the first bytes, else unknown."""
    head = F.decode(F.substring(content, 1, 120), "ISO-8859-1")
    return F.when(F.startswith(head, F.lit("%PDF")), "pdf").when(F.contains(head, F.lit("<?xml")) | F.contains(head, F.lit("<")), "xml").otherwise("unknown")


def decoded_text(raw: bytes) -> str:
    for encoding in ("utf-8", "gb18030"):
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode("latin-1")


def docx_text(raw: bytes) -> str:
    """Paragraphs of a Word file, tabs and breaks as characters; an unreadable file is empty."""
    try:
        with zipfile.ZipFile(io.BytesIO(raw)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    marks = {f"{_WORD}tab": "\t", f"{_WORD}br": "\n", f"{_WORD}cr": "\n"}
    out = []
    for p in root.iter(f"{_WORD}p"):
        text = "".join((e.text or "") if e.tag == f"{_WORD}t" else marks.get(e.tag, "") for e in p.iter())
        if text := text.strip():
            out.append(text)
    return "\n".join(out)


def pdf_pages(raw: bytes) -> list[str]:
    """Texts of a PDF's pages, where the optional library is there; an unreadable file has none, a broken page an empty text."""
    try:
        from pypdf import PdfReader
    except ImportError:
        return []
    try:
        pages = PdfReader(io.BytesIO(raw)).pages
    except Exception:  # noqa: BLE001  whatever a damaged file raises
        return []
    out = []
    for p in pages:
        try:
            out.append(p.extract_text() or "")
        except Exception:  # noqa: BLE001
            out.append("")
    return out


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """PAGES of all files under path; .doc files give none. doc_id is the file's path."""

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for doc_id, kind, raw in zip(b.path, b.kind, b.content):
                raw = bytes(raw)
                texts = {"docx": lambda: [docx_text(raw)], "txt": lambda: [decoded_text(raw)], "pdf": lambda: pdf_pages(raw)}.get(kind, list)()
                source = "pypdf" if kind == "pdf" else kind
                yield pd.DataFrame({"doc_id": doc_id, "page": range(1, len(texts) + 1), "text": texts, "text_source": source})

    files = spark.read.format("binaryFile").load(path).select("path", format_of(F.col("path")).alias("kind"), "content")
    out = files.where("kind <> 'rejected'").mapInPandas(pages, PAGES)
    return out.withColumn("text", F.when(F.col("text_source") == "docx", F.col("text")).otherwise(T.clean_lines(F.col("text"))))


def refused(files: DataFrame, pages: DataFrame) -> DataFrame:
    """(doc_id, reason) of files(doc_id, path) that can't be used: 'format' by their suffix, 'empty' without any text on pages(doc_id, text).

    A damaged file has no text. So one bad file doesn't stop the others, and none goes without a word.
    """
    filled = pages.where(T.stripped(F.col("text")) != "").select("doc_id").distinct()
    bad = F.col("kind") == "rejected"
    rows = files.select("doc_id", format_of(F.col("path")).alias("kind")).join(filled.withColumn("filled", F.lit(True)), "doc_id", "left")
    return rows.where(bad | F.col("filled").isNull()).select("doc_id", F.when(bad, "format").otherwise("empty").alias("reason"))


def bad_sources(entries: DataFrame, pages: DataFrame, markup: DataFrame) -> DataFrame:
    """(doc_id, reason) of entries(doc_id, path) that give nothing to search: 'format' unless PDF or XML, 'missing' where nothing was read,
    'empty' where all pages are blank or markup holds no text, 'malformed' with the parser's words for XML that isn't well formed."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./\\]+)$", 1))
    rows = entries.select("doc_id", kind.alias("kind"))
    here = pages.groupBy("doc_id").agg(F.max(T.stripped(F.col("text")) != "").alias("filled"))
    of_pages = rows.where("kind = 'pdf'").join(here, "doc_id", "left").where(~F.coalesce("filled", F.lit(False))).select("doc_id", F.when(F.col("filled").isNull(), "missing").otherwise("empty").alias("reason"))
    read = xml.elements(markup.join(rows.where("kind = 'xml'").select("doc_id"), "doc_id", "left_semi"), ())
    there = markup.select("doc_id", F.lit(True).alias("there")).distinct().join(read.groupBy("doc_id").agg(F.max("error").alias("error"), F.max(F.col("text").isNotNull()).alias("filled")), "doc_id", "left")
    why = F.when(F.col("there").isNull(), "missing").when(F.col("error").isNotNull(), F.concat(F.lit("malformed: "), "error")).when(F.col("filled").isNull(), "empty")
    of_markup = rows.where("kind = 'xml'").join(there, "doc_id", "left").select("doc_id", why.alias("reason")).where(F.col("reason").isNotNull())
    others = rows.where(~F.col("kind").isin("pdf", "xml")).select("doc_id", F.lit("format").alias("reason"))
    return of_pages.unionByName(of_markup).unionByName(others)


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """The entries of manifests; a file that isn't JSON gives none."""
    schema = "domain string, region string, code string, title string, filename string, status string, path string, source_url string, bytes long, note string, local_source string, _broken string"
    found = spark.read.schema(schema).option("multiLine", True).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_broken").json(path)
    return found.where(F.col("_broken").isNull()).drop("_broken")


def corpus_files(manifest: DataFrame, files: DataFrame) -> DataFrame:
    """Entries of the manifest that are PDF or XML files which exist in files(path); / in paths for \\ ."""
    clean = lambda c: F.replace(c, F.lit("\\"), F.lit("/"))
    there = files.select(clean(F.col("path")).alias("path")).distinct()
    return manifest.withColumn("path", clean(F.col("path"))).where(F.lower("path").rlike(r"\.(pdf|xml)$")).join(there, "path", "left_semi")


def fingerprint(files: DataFrame, *settings: str) -> DataFrame:
    """One row: a hash of (path, size, modified) of all files and the settings, to tell whether a cache is valid.

    Each file's SHA-256 is read as four numbers of 60 bits, and these are summed over all files: the order doesn't matter, a file that
    comes, goes or changes does, and the sums combine before any shuffle, however many files there are.
    """
    each = F.sha2(F.concat_ws("|", "path", "size", "modified"), 256)
    part = lambda k: F.sum(F.conv(F.substring(each, 15 * k + 1, 15), 16, 10).cast("decimal(20,0)")).cast("string")
    sums = [F.coalesce(part(k), F.lit("0")) for k in range(4)]
    n = F.count(F.lit(1))
    return files.agg(n.alias("files"), F.sha2(F.concat_ws("\n", n.cast("string"), *sums, *[F.lit(s) for s in settings]), 256).alias("fingerprint"))
