"""Well-formed XML as rows: the texts of chosen elements, whole texts, sections, and what could not be read.

A document is parsed in parts by a streaming parser and gives rows; what follows (headings, blocks, chunks) is Spark's. Names count
without their prefix and in upper case. Entities and CDATA sections are text, comments are not. A document that isn't well formed
gives no rows but its error, as its first part can't be trusted either.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from xml.parsers import expat

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X

#: Characters that are parsed at a time, and rows that are handed on together.
PART, ROWS = 1 << 16, 1 << 12


def _local(name: str) -> str:
    return name.rpartition(":")[2].upper()


def _parsed(text: str | bytes, start: Callable, end: Callable, data: Callable | None = None) -> str | None:
    """Runs a parser over text; the error, if it isn't well formed. start and end get the parser and a local name."""
    p = expat.ParserCreate()
    p.buffer_text = True
    p.StartElementHandler = lambda name, _: start(p, _local(name))
    p.EndElementHandler = lambda name: end(p, _local(name))
    p.CharacterDataHandler = data
    try:
        for at in range(0, len(text), PART):
            p.Parse(text[at : at + PART], False)
        p.Parse(text[:0], True)
    except (expat.ExpatError, ValueError, LookupError) as e:  # the last two: an encoding that isn't known
        return str(e)
    return None


def texts_of(text: str | bytes, tags: tuple[str, ...], least: int) -> tuple[list[tuple], str | None]:
    """(rows (number, tag, text), error): each element with one of tags whose text has at least so many characters, numbered by
    where it begins among all with these tags. Without any, the whole text under no tag. Pieces around tags are parted by a blank."""
    rows: list[tuple] = []
    whole: list[str] = []
    opened: list[tuple[int, str, list[str]]] = []
    begun = 0

    def say(s: str) -> None:
        for _, _, parts in opened:
            parts.append(s)
        if not rows:
            whole.append(s)

    def start(_: object, name: str) -> None:
        nonlocal begun
        say(" ")
        if name in tags:
            opened.append((begun, name, []))
            begun += 1

    def end(_: object, name: str) -> None:
        if name in tags:
            number, tag, parts = opened.pop()
            found = " ".join("".join(parts).split())
            if len(found) >= least:
                rows.append((number, tag, found))
        say(" ")

    error = _parsed(text, start, end, say)
    if error is None and not rows and (found := " ".join("".join(whole).split())):
        rows.append((0, None, found))
    return ([] if error else sorted(rows, key=lambda r: r[0])), error


def _rows(docs: DataFrame, found: Callable[[str | bytes], Iterator[tuple]], kind: str) -> DataFrame:
    """For each row of docs(doc_id, text), text a string or bytes, what found gives for it, behind its doc_id. Null texts give nothing."""
    names = ["doc_id", *[c.split()[0] for c in kind.split(", ")]]
    types = {"int": pa.int32(), "string": pa.string()}
    fields = [types[c.split()[1]] for c in kind.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for i, text in enumerate(b.column(1)):
                if not text.is_valid:
                    continue
                rows = list(found(text.as_py()))
                for at in range(0, len(rows), ROWS):
                    part = rows[at : at + ROWS]
                    yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array([i] * len(part))), *[pa.array(c, t) for c, t in zip(zip(*part), fields)]], names)

    return docs.select("doc_id", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, {kind}")


def elements(docs: DataFrame, tags: tuple[str, ...] = X.XML_TAGS, least: int = 8) -> DataFrame:
    """(doc_id, p_ord, tag, text, error) of docs(doc_id, text): see texts_of. A document that can't be read has one row with its error."""

    def found(text: str | bytes) -> Iterator[tuple]:
        rows, error = texts_of(text, tags, least)
        return [(None, None, None, error)] if error else [(*r, None) for r in rows]

    return _rows(docs, found, "p_ord int, tag string, text string, error string")


def paragraphs(docs: DataFrame, tags: tuple[str, ...] = X.XML_TAGS) -> DataFrame:
    """(doc_id, p_ord, tag, text): elements of documents that are well formed; tag is null for the whole text of one without any."""
    return elements(docs, tags).where(F.col("error").isNull()).drop("error")


def errors(docs: DataFrame) -> DataFrame:
    """(doc_id, error) of documents that aren't well formed."""
    return elements(docs, ()).where(F.col("error").isNotNull()).select("doc_id", "error")


def texts(docs: DataFrame) -> DataFrame:
    """(doc_id, text): all text of each well-formed document that has any."""
    return elements(docs, ()).where(F.col("error").isNull()).select("doc_id", "text")


def sections(docs: DataFrame, element: str = "SECTION", number: str = "SECTNO") -> DataFrame:
    """(doc_id, section_ord, section, text): each element of this name with its markup; section is the text of its first child
    of the other name, up to that child's first element, in digits and dots."""

    def found(text: str | bytes) -> Iterator[tuple]:
        raw = text if isinstance(text, bytes) else text.encode()
        rows: list[tuple] = []
        opened: list[list] = []  # number among its kind, first byte, depth, text of its number or None
        said: list[str] | None = None
        depth = begun = 0

        def start(p: object, name: str) -> None:
            nonlocal depth, begun, said
            said = None
            depth += 1
            if name == element:
                opened.append([begun, p.CurrentByteIndex, depth, None])
                begun += 1
            elif name == number and opened and opened[-1][2] == depth - 1 and opened[-1][3] is None:
                opened[-1][3] = said = []

        def end(p: object, name: str) -> None:
            nonlocal depth, said
            said = None
            if name == element:
                n, first, _, no = opened.pop()
                last = raw.find(b">", p.CurrentByteIndex) + 1  # of the end tag, or of an empty element
                rows.append((n, "".join(c for c in "".join(no or []) if c.isdigit() or c == "."), raw[first:last]))
            depth -= 1

        def data(s: str) -> None:
            if said is not None:
                said.append(s)

        error = _parsed(raw, start, end, data)
        return [] if error else [(n, no, part.decode("utf-8", "replace")) for n, no, part in sorted(rows)]

    return _rows(docs, found, "section_ord int, section string, text string")


def section(docs: DataFrame, number: str) -> DataFrame:
    """(doc_id, section, text): the first section of each document whose number, in digits and dots, is this one."""
    rows = sections(docs).where(F.col("section") == number)
    return rows.groupBy("doc_id", "section").agg(F.min_by("text", "section_ord").alias("text"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, text): markup files as bytes, in whatever encoding they declare."""
    return spark.read.format("binaryFile").load(path).select(F.col("path").alias("doc_id"), F.col("content").alias("text"))
