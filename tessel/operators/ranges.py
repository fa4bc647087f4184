"""Clauses of documents that are larger than a task: the same rows as segment.clauses, found range by range.

No document is put together in one row or sorted in one task. Lines are numbered within ranges of pages, and what ranges hold
before them is added. Whether a segment goes on into the next depends on the length of what it carries, which is below SHORT: so a range
of segments is a map from SHORT states to SHORT states, and these maps can be worked out for all ranges at once and then chained.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import forget, settled
from . import segment
from .segment import amendment_documents, marked_lines, paragraphs

#: A segment of fewer characters goes on into the next one.
SHORT = 30
#: Pages, and segments, of a range.
PAGES, SEGMENTS = 64, 256


def segment_numbers(lines: DataFrame, pages: int = PAGES) -> DataFrame:
    """marked lines with the number of the heading that they follow (0 before the first), as segment.segment_ids gives it."""
    rows = lines.withColumn("range", F.floor(F.col("page") / pages).cast("long"))
    counts = rows.groupBy("doc_id", "range").agg(F.sum(F.col("is_heading").cast("long")).alias("n"))
    before = Window.partitionBy("doc_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("doc_id", "range", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    within = F.sum(F.col("is_heading").cast("long")).over(Window.partitionBy("doc_id", "range").orderBy("page", "line_ord").rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("within", within).join(counts, ["doc_id", "range"]).withColumn("segment", F.col("base") + F.col("within")).drop("base", "within", "range")


def _step(carry: Column, length: Column) -> Column:
    """The length that is carried on behind a segment of this length; 0 is nothing."""
    whole = F.when(carry == 0, length).otherwise(carry + 1 + length)
    return F.when(whole < SHORT, whole).otherwise(F.lit(0))


def clause_numbers(segments: DataFrame, size: int = SEGMENTS) -> DataFrame:
    """(doc_id, segment, clause, closes) of segments(doc_id, segment, length), numbered without gaps from the first: the clause that a
    segment becomes part of, from 0, and whether it is the one that completes it. What is carried past the last segment has no clause that closes."""
    zero, no_flags = F.lit(0), F.array().cast("array<struct<clause:int,closes:boolean>>")
    ranges = segments.groupBy("doc_id", F.floor(F.col("segment") / size).cast("long").alias("range")).agg(F.array_sort(F.collect_list(F.struct(F.col("segment").cast("long").alias("segment"), F.col("length").cast("int").alias("length")))).alias("s"))
    lengths = F.transform("s", lambda x: x["length"])
    mapped = F.aggregate(lengths, F.sequence(zero, F.lit(SHORT - 1)), lambda states, n: F.transform(states, lambda c: _step(c, n)))
    ranges = ranges.withColumn("map", mapped)
    # one number for each range of a document is what is put together here
    chain = ranges.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("range", "map"))).alias("maps"))
    begin = F.struct(zero.alias("carry"), F.array().cast("array<struct<range:bigint,carry:int>>").alias("all"))
    chained = F.aggregate("maps", begin, lambda st, m: F.struct(F.get(m["map"], st["carry"]).alias("carry"), F.concat(st["all"], F.array(F.struct(m["range"].alias("range"), st["carry"].alias("carry")))).alias("all")))["all"]
    entering = chain.select("doc_id", F.explode(chained).alias("e")).select("doc_id", "e.range", "e.carry")

    def walk(st: Column, n: Column) -> Column:
        after = _step(st["carry"], n)
        closes = after == 0
        flag = F.struct(st["clause"].alias("clause"), closes.alias("closes"))
        return F.struct(after.alias("carry"), (st["clause"] + closes.cast("int")).alias("clause"), F.concat(st["flags"], F.array(flag)).alias("flags"))

    walked = ranges.join(entering, ["doc_id", "range"]).withColumn("w", F.aggregate(lengths, F.struct(F.col("carry"), zero.alias("clause"), no_flags.alias("flags")), walk))
    before = Window.partitionBy("doc_id").orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    base = walked.select("doc_id", "range", F.coalesce(F.sum("w.clause").over(before), F.lit(0)).alias("base"))
    rows = walked.select("doc_id", "range", F.explode(F.arrays_zip(F.transform("s", lambda x: x["segment"]).alias("segment"), F.col("w.flags").alias("flag"))).alias("z"))
    rows = rows.select("doc_id", "range", F.col("z.segment").alias("segment"), F.col("z.flag.clause").alias("k"), F.col("z.flag.closes").alias("closes"))
    return rows.join(base, ["doc_id", "range"]).select("doc_id", "segment", (F.col("base") + F.col("k")).alias("clause"), "closes")


def clauses(pages: DataFrame, pages_of_range: int = PAGES, segments_of_range: int = SEGMENTS) -> DataFrame:
    """The rows of segment.clauses. A document's lines, segments and clauses are never in one row; a single clause is."""
    lines = settled(segment_numbers(marked_lines(pages), pages_of_range))
    rows = lines.groupBy("doc_id", "segment").agg(
        F.max(F.when(F.col("is_heading"), F.col("line"))).alias("heading"), (F.sum(F.length("line")) + F.count(F.lit(1)) - 1).alias("length"), F.when(F.col("segment") == 0, 1).otherwise(F.min("page")).cast("int").alias("start_page"), F.max("page").cast("int").alias("end_page")
    )
    # a document that begins with a heading has no segment 0
    first = rows.groupBy("doc_id").agg(F.min("segment").alias("first"))
    rows = rows.join(first, "doc_id").withColumn("segment", F.col("segment") - F.col("first")).drop("first")
    rows = settled(rows)
    numbered = settled(clause_numbers(rows.select("doc_id", "segment", "length"), segments_of_range))
    closed = rows.join(numbered.where("closes"), ["doc_id", "segment"]).select("doc_id", "clause", "heading", "start_page", "end_page")
    placed = lines.join(first, "doc_id").withColumn("segment", F.col("segment") - F.col("first")).join(numbered.select("doc_id", "segment", "clause"), ["doc_id", "segment"])
    texts = placed.groupBy("doc_id", "clause").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", "line_ord", "line"))), lambda r: r["line"]), "\n").alias("text"))
    found = closed.join(texts, ["doc_id", "clause"])
    sizes = closed.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    checked = amendment_documents(pages).join(sizes, "doc_id", "left").withColumn("n", F.coalesce("n", F.lit(0)))
    enough = (F.col("n") >= 2) | (F.col("amendment") & (F.col("n") >= 1))
    heading = F.coalesce("heading", F.substring(F.element_at(F.split("text", "\n"), 1), 1, 90))
    mine = found.join(checked.where(enough).select("doc_id"), "doc_id", "left_semi").select("doc_id", F.col("clause").alias("ord"), heading.alias("heading"), "text", "start_page", "end_page")
    others = paragraphs(pages.join(checked.where(~enough).select("doc_id"), "doc_id", "left_semi")).select("doc_id", F.col("clause_ord").cast("long").alias("ord"), "heading", "text", "start_page", "end_page")
    out = settled(segment._numbered(mine.unionByName(others), ["ord"]).drop("ord"))
    forget(lines, rows, numbered)
    return out
