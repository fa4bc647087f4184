"""Comparison of all documents of a category with each other, and the report of it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..session import settled
from ..sources import markup as xml
from ..sources import store
from . import compare, segment


def comparable(entries: DataFrame) -> DataFrame:
    """Entries of a manifest that have a PDF or markup file."""
    return entries.where(F.col("status").isin(*X.PRESENT) & F.lower("path").rlike(r"\.(pdf|xml)$"))


def category_clauses(entries: DataFrame, pages: DataFrame, markup: DataFrame) -> DataFrame:
    """All useful clauses of comparable entries(doc_id, code, path): those of a PDF's pages, or windows over a markup file's text.

    A document is taken apart once, however many pairs it is in: the clauses are a table in the shared folder.
    """
    pdf = F.lower("path").endswith(".pdf")
    mine = segment.clauses(pages.join(entries.where(pdf).select("doc_id"), "doc_id", "left_semi"), settled)
    coded = entries.where(~pdf).select("doc_id", "code")
    texts = xml.texts(markup.join(coded, "doc_id", "left_semi")).join(coded, "doc_id")
    cut = texts.select("doc_id", "code", F.posexplode(segment.windows(F.col("text"), *X.XML_COMPARED)).alias("n", "text")).withColumn("clause_ord", F.col("n") + 1)
    name = F.col("clause_ord").cast("string")
    zero = F.lit(0)
    others = cut.select(
        "doc_id", "clause_ord", F.concat(F.lit("X"), F.lpad(name, 4, "0")).alias("id"), F.concat("code", F.lit(" chunk "), name).alias("heading"), "text", zero.alias("start_page"), zero.alias("end_page")
    )
    return settled(segment.useful_clauses(mine.unionByName(others)))


def category_comparisons(entries: DataFrame, found: DataFrame) -> DataFrame:
    """One row for each pair of entries(doc_id, ord, domain, region, code) of one domain that both have clauses in found.

    Pairs meet within a domain only, the earlier entry on the left; only the first results of a pair come along.
    """
    rows = compare.domain_pairs(entries.select("doc_id", "ord", "domain", "region", "code")).withColumns({"l_doc": F.col("l_doc_id"), "r_doc": F.col("r_doc_id")})
    sizes = found.groupBy("doc_id").agg(F.count(F.lit(1)).alias("n"))
    side = lambda s: sizes.select(F.col("doc_id").alias(f"{s}_doc"), F.col("n").alias("left_clauses" if s == "l" else "right_clauses"))
    rows = settled(rows.join(side("l"), "l_doc").join(side("r"), "r_doc"))  # every step below meets these pairs again
    results = compare.ordered(compare.classified(compare.matched(rows.select("l_doc", "r_doc"), found)), "l_doc", "r_doc")
    done = compare.conclusion(results, "l_doc", "r_doc", top=X.TOP_RESULTS)
    return rows.join(done, ["l_doc", "r_doc"]).select(
        F.col("l_domain").alias("domain"), "l_ord", "r_ord", F.col("l_code").alias("left"), F.col("r_code").alias("right"), F.col("l_region").alias("left_region"), F.col("r_region").alias("right_region"),
        "left_clauses", "right_clauses", F.col("total").alias("result_count"), F.col("substantive").alias("substantive_count"), "low_confidence_ratio", "headline", "caveats", "change_type_counts", "risk_counts",
        "key_findings", "top_results",
    )


def report_sections(evaluations: DataFrame) -> DataFrame:
    """(domain, l_ord, r_ord, section): the report's text for each pair, in Markdown."""
    text = lambda c: F.col(c).cast("string")
    shown = F.transform(
        F.slice("top_results", 1, X.SHOWN_RESULTS),
        lambda r: F.concat(F.lit("- "), r["change_type"], F.lit(" / risk "), r["risk"], F.lit(" / score "), r["score"].cast("string"), F.lit(": "), F.substring(r["left_heading"], 1, 80), F.lit(" -> "), F.substring(r["right_heading"], 1, 80)),
    )
    counts = F.concat(
        F.lit("- Clauses: "), text("left_clauses"), F.lit(" vs "), text("right_clauses"), F.lit("; results: "), text("result_count"), F.lit("; substantive: "), text("substantive_count"),
        F.lit("; low-confidence ratio: "), text("low_confidence_ratio"),
    )
    head = F.array(F.concat(F.lit("### "), "left", F.lit(" vs "), "right"), F.lit(""), F.col("headline"), F.lit(""), counts)
    return evaluations.select("domain", "l_ord", "r_ord", F.array_join(F.concat(head, shown, F.array(F.lit(""))), "\n").alias("section"))


def report(evaluations: DataFrame) -> DataFrame:
    """(domain, report): the sections of each domain under its heading, in the order of the manifest. A domain's text is one row;
    write_report puts out what is too long for that."""
    rows = report_sections(evaluations).groupBy("domain").agg(F.array_sort(F.collect_list(F.struct("l_ord", "r_ord", "section"))).alias("s"))
    return rows.select("domain", F.concat(F.lit("## "), "domain", F.lit("\n\n"), F.array_join(F.transform("s", lambda x: x["section"]), "\n")).alias("report"))


def report_folder(spark: SparkSession, path: str) -> str | None:
    """The folder of the report that was last written whole under path, with json and markdown in it; None before there is one."""
    return store.version(spark, path)[1].get("report")


def write_report(evaluations: DataFrame, path: str) -> str:
    """A report under path: json with one line for each pair, and markdown, both in the order of domains and of the manifest; its folder.

    Rows are parted by ranges of that order, so the files, read by name, are one report, and a large domain takes several of them.
    Readers ask report_folder: it changes to the new report once both forms are there, so a write that fails leaves the former one.
    """
    spark, under = evaluations.sparkSession, path
    path = store.new_folder(under)
    _write_report(evaluations, path)
    while not store.publish(spark, under, store.version(spark, under)[0] + 1, {"report": path}):
        pass  # another report came first; this one follows it
    store.expire(spark, under, lambda c: [c["report"]])
    return path


def _write_report(evaluations: DataFrame, path: str) -> None:
    order = ["domain", "l_ord", "r_ord"]
    # read twice, worked out once: the Markdown is made from the lines that were written
    evaluations.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("overwrite").json(f"{path}/json")
    kept = evaluations.sparkSession.read.schema(evaluations.schema).json(f"{path}/json")
    first = kept.groupBy("domain").agg(F.min(F.struct("l_ord", "r_ord")).alias("first"))
    rows = report_sections(kept).join(first, "domain")
    starts = (F.col("l_ord") == F.col("first.l_ord")) & (F.col("r_ord") == F.col("first.r_ord"))
    pieces = rows.select(*order, F.when(starts, F.concat(F.lit("## "), "domain", F.lit("\n\n"), "section")).otherwise(F.col("section")).alias("value"))
    title = kept.sparkSession.range(1).select(F.lit("").alias("domain"), F.lit(None).cast(kept.schema["l_ord"].dataType).alias("l_ord"), F.lit(None).cast(kept.schema["r_ord"].dataType).alias("r_ord"), F.lit(X.REPORT_TITLE + "\n").alias("value"))
    title.unionByName(pieces).repartitionByRange(*order).sortWithinPartitions(*order).select("value").write.mode("overwrite").text(f"{path}/markdown")
