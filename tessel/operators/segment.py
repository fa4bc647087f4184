"""Pages to lines, clauses, paragraphs, windows, chunks and sentences. Documents are independent, so all work is by doc_id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..functions import text as T
from ..sources import markup as xml


def page_lines(pages: DataFrame) -> DataFrame:
    """pages(doc_id, page, text) -> (doc_id, page, line_ord, line)."""
    return pages.select("doc_id", "page", F.posexplode(T.lines(F.col("text"))).alias("line_ord", "line"))


def extraction_summary(pages: DataFrame, low: int = X.OCR_LOW_CHARS) -> DataFrame:
    """One row for each document of pages(doc_id, page, text, text_source): counts, coverage, method, pages read by OCR.

    wants_ocr tells whether few enough characters came out for OCR to be worth while.
    """
    chars = F.length(F.coalesce(T.stripped(F.col("text")), F.lit("")))
    out = pages.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("pages"), F.sum(chars).alias("total_text_chars"), F.count_if(chars >= low).alias("text_pages"), F.count_if(chars < low).alias("empty_pages"),
        F.array_sort(F.collect_list(F.when(F.col("text_source") == "ocr", F.col("page")))).alias("ocr_pages"),
        F.count_if(chars > 0).alias("_filled"), F.count_if((chars > 0) & (F.col("text_source") == "ocr")).alias("_ocr"),
    )
    by_ocr, filled = F.col("_ocr"), F.col("_filled")
    method = F.when(filled == 0, "empty").when(by_ocr == filled, "ocr").when(by_ocr > 0, "mixed").otherwise("pypdf")
    wants = (F.col("empty_pages") > 0) & ((F.col("empty_pages") / F.col("pages") >= X.OCR_LOW_RATIO) | (F.col("total_text_chars") / F.col("pages") < X.OCR_LOW_AVERAGE))
    return out.withColumns({"text_coverage": F.round(F.col("text_pages") / F.col("pages"), 3), "extract_method": method, "wants_ocr": wants}).drop("_ocr", "_filled")


def merge_pages(original: DataFrame, ocr: DataFrame, low: int = X.OCR_LOW_CHARS) -> DataFrame:
    """Pages of original, with the text of ocr where the original has few characters and ocr has more of them.

    Of several ocr rows of a page the last (by column ord, where there is one) counts.
    """
    order = F.col("ord") if "ord" in ocr.columns else F.length("text")
    last = ocr.groupBy("doc_id", "page").agg(F.max_by("text", order).alias("_ocr"))
    mine, theirs = F.length(T.stripped(F.col("text"))), F.length(T.stripped(F.col("_ocr")))
    take = F.coalesce((mine < low) & (theirs > mine), F.lit(False))
    return original.join(last, ["doc_id", "page"], "left").select(
        "doc_id", "page", F.when(take, F.col("_ocr")).otherwise(F.col("text")).alias("text"), F.when(take, "ocr").otherwise(F.col("text_source")).alias("text_source")
    )


def chosen_pages(original: DataFrame, ocr: DataFrame, low: int = X.OCR_LOW_CHARS) -> DataFrame:
    """The better of two extractions of each document, both pages(doc_id, page, text, text_source).

    Texts read by OCR count where the original wants OCR and they have more characters in all; they are then merged page by page.
    A document that has no original pages takes those of OCR.
    """
    chars = F.length(F.coalesce(T.stripped(F.col("text")), F.lit("")))
    before = extraction_summary(original, low).select("doc_id", "wants_ocr", "total_text_chars")
    after = ocr.groupBy("doc_id").agg(F.sum(chars).alias("_ocr_chars"))
    verdict = before.join(after, "doc_id", "right").select("doc_id", F.col("wants_ocr").isNull().alias("_alone"), (F.col("wants_ocr") & (F.col("_ocr_chars") > F.col("total_text_chars"))).alias("_better"))
    read = ocr.join(verdict, "doc_id")
    merged = merge_pages(original, read.where("_better"), low)
    return merged.unionByName(read.where("_alone").select("doc_id", "page", "text", "text_source"))


def readable(pages: DataFrame) -> DataFrame:
    """Pages of the documents that have any text at all; the others go as a whole."""
    filled = pages.where(T.stripped(F.col("text")) != "").select("doc_id").distinct()
    return pages.join(filled, "doc_id", "left_semi")


def amendment_documents(pages: DataFrame) -> DataFrame:
    """(doc_id, amendment): whether one of the first two pages says so."""
    says = F.contains("text", F.lit("Amendment")) & (F.contains("text", F.lit("UN Regulation No. 13")) | F.contains("text", F.lit("Addendum 12")))
    return pages.groupBy("doc_id").agg(F.coalesce(F.max(F.when(F.col("page") <= 2, says)), F.lit(False)).alias("amendment"))


def marked_lines(pages: DataFrame) -> DataFrame:
    """Lines that belong to clauses, with is_heading: no blank, contents or noise lines, no title page of an amendment."""
    lines = page_lines(pages).join(amendment_documents(pages), "doc_id").withColumn("line", T.stripped(F.col("line")))
    line, amendment = F.col("line"), F.col("amendment")
    kept = lines.where((line != "") & ~T.is_toc(line) & ~line.rlike(X.NOISE) & ~(amendment & (line.rlike(X.UN_NOISE) | (F.col("page") == 1))))
    heading = (F.length(line) <= 220) & (line.rlike(X.HEADING) | line.rlike(X.AMENDMENT_HEADING))
    return kept.withColumn("is_heading", heading)


def segment_ids(lines: DataFrame) -> DataFrame:
    """Lines with the number of the heading that they follow (0 before the first)."""
    return lines.withColumn("segment", F.sum(F.col("is_heading").cast("int")).over(Window.partitionBy("doc_id").orderBy("page", "line_ord").rowsBetween(Window.unboundedPreceding, 0)))


_CLAUSE = "array<struct<heading:string,text:string,start_page:int,end_page:int>>"


def _folded(segments: Column) -> Column:
    """Segments to clauses in order. A segment of under 30 characters goes on into the next, under the next one's heading."""
    state = F.struct(F.lit("").alias("carry"), F.lit(None).cast("int").alias("page"), F.array().cast(_CLAUSE).alias("done"))

    def step(s: Column, x: Column) -> Column:
        body = F.when(s["carry"] == "", x["text"]).otherwise(F.concat(s["carry"], F.lit("\n"), x["text"]))
        short = F.length(T.stripped(body)) < 30
        start = x["start_page"]
        clause = F.struct(
            F.coalesce(x["heading"], F.substring(F.element_at(F.split(body, "\n"), 1), 1, 90)).alias("heading"), body.alias("text"), start.alias("start_page"), x["end_page"].alias("end_page")
        )
        return F.struct(
            F.when(short, body).otherwise("").alias("carry"), F.when(short, start).alias("page"), F.when(short, s["done"]).otherwise(F.concat(s["done"], F.array(clause))).alias("done")
        )

    return F.aggregate(segments, state, step)["done"]


def _numbered(rows: DataFrame, order: list) -> DataFrame:
    n = F.row_number().over(Window.partitionBy("doc_id").orderBy(*order))
    return rows.withColumn("clause_ord", n).withColumn("id", F.concat(F.lit("C"), F.lpad(n.cast("string"), 4, "0")))


def clauses(pages: DataFrame, kept: Callable[[DataFrame], DataFrame] = lambda df: df) -> DataFrame:
    """(doc_id, clause_ord, id, heading, text, start_page, end_page). Too few clauses of a document give way to paragraphs.

    kept: what holds the documents' clauses (session.settled) while they are read twice, else they are worked out twice.
    """
    lines = segment_ids(marked_lines(pages))
    segments = lines.groupBy("doc_id", "segment").agg(
        F.max(F.when(F.col("is_heading"), F.col("line"))).alias("heading"), F.array_sort(F.collect_list(F.struct("page", "line_ord", "line"))).alias("rows"), F.when(F.col("segment") == 0, 1).otherwise(F.min("page")).alias("start_page"), F.max("page").alias("end_page")
    )
    ordered = segments.groupBy("doc_id").agg(
        F.transform(
            F.array_sort(F.collect_list(F.struct("segment", "heading", "rows", "start_page", "end_page"))),
            lambda s: F.struct(s["heading"].alias("heading"), F.array_join(F.transform(s["rows"], lambda r: r["line"]), "\n").alias("text"), s["start_page"].cast("int").alias("start_page"), s["end_page"].cast("int").alias("end_page")),
        ).alias("segments")
    )
    split = ordered.select("doc_id", _folded(F.col("segments")).alias("found"))
    checked = kept(amendment_documents(pages).join(split, "doc_id", "left").withColumn("n", F.coalesce(F.size("found"), F.lit(0))))
    enough = (F.col("n") >= 2) | (F.col("amendment") & (F.col("n") >= 1))
    mine = checked.where(enough).select("doc_id", F.posexplode("found").alias("ord", "c")).select("doc_id", "ord", "c.*")
    others = paragraphs(pages.join(checked.where(~enough).select("doc_id"), "doc_id", "left_semi")).select("doc_id", F.col("clause_ord").alias("ord"), "heading", "text", "start_page", "end_page")
    return _numbered(mine.unionByName(others), ["ord"]).drop("ord")


def paragraphs(pages: DataFrame) -> DataFrame:
    """Paragraphs and sentences that start anew, of 20 characters and more, without contents lines."""
    broken = T.by_script(F.col("text"), lambda x, of: F.split(x, of(X.PARAGRAPH_BREAK)))
    parts = pages.select("doc_id", "page", F.posexplode(broken).alias("part", "chunk"))
    kept = T.once(parts, text=T.let(T.stripped(F.col("chunk")), T.without_toc)).drop("chunk").where(F.length("text") >= 20)
    page = F.col("page").cast("int")
    # headings are made behind the shuffle, of texts whose lines all end alike by now
    heading = F.substring(F.substring_index("text", "\n", 1), 1, 90)
    return _numbered(kept, ["page", "part"]).select("doc_id", "clause_ord", "id", heading.alias("heading"), "text", page.alias("start_page"), page.alias("end_page"))


def windows(text: Column, size: int = 1200, overlap: int = 160) -> Column:
    """Texts of a sliding window, stripped, of more than 80 characters."""
    step = max(1, size - overlap)
    starts = F.sequence(F.lit(1), F.greatest(F.length(text), F.lit(1)), F.lit(step))
    return F.filter(F.transform(starts, lambda s: T.stripped(F.substring(text, s, F.lit(size)))), lambda x: F.length(x) > 80)


def packed_chunks(text: Column, size: int = 1500, overlap: int = 120) -> Column:
    """Parts between structural boundaries, packed up to size; packs of 80 characters and less go, oversize ones become windows."""
    parts = F.filter(F.transform(F.split(text, X.BOUNDARY), T.stripped), lambda p: p != "")
    state = F.struct(F.lit("").alias("now"), F.array().cast("array<string>").alias("done"))

    def step(s: Column, p: Column) -> Column:
        fits = F.length(s["now"]) + F.length(p) + 1 <= size
        joined = F.when(s["now"] == "", p).otherwise(F.concat_ws(" ", s["now"], p))
        full = F.when(F.length(s["now"]) > 80, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])
        return F.when(fits | (s["now"] == ""), F.struct(joined.alias("now"), s["done"].alias("done"))).otherwise(F.struct(p.alias("now"), full.alias("done")))

    def finish(s: Column) -> Column:
        return F.when(F.length(s["now"]) > 80, F.concat(s["done"], F.array(s["now"]))).otherwise(s["done"])

    packs = F.aggregate(parts, state, step, finish)
    split = F.flatten(F.transform(packs, lambda p: F.when(F.length(p) > size, windows(p, size, overlap)).otherwise(F.array(p))))
    return (
        F.when(F.length(text) <= size, F.when(F.length(text) > 80, F.array(text)).otherwise(F.array().cast("array<string>")))
        .when(F.size(parts) <= 1, windows(text, size, overlap))
        .otherwise(split)
    )


def clause_chunks(found: DataFrame) -> DataFrame:
    """Search chunks of clauses(doc_id, clause_ord, heading, text): each as an excerpt, and excerpts of its parts where it is long or
    has parameters. A part whose excerpt is that of the whole clause is left out."""
    text = T.compact(F.col("text"))
    base = found.withColumn("text", text).where(F.length("text") > 40)
    parts = F.when((F.length("text") > 1100) | F.col("text").rlike(X.ANCHOR), packed_chunks(F.col("text"), 1500, 140))
    rows = base.withColumn("parts", parts)
    whole = rows.select("doc_id", "clause_ord", F.lit(0).alias("part"), "heading", T.excerpt(F.col("text")).alias("text"))
    pieces = rows.where(F.size("parts") > 1).select("doc_id", "clause_ord", "heading", T.excerpt(F.col("text")).alias("all"), F.posexplode("parts").alias("i", "text"))
    pieces = pieces.withColumn("text", T.excerpt(F.col("text"))).where(F.col("text") != F.col("all"))
    pieces = pieces.select("doc_id", "clause_ord", (F.col("i") + 1).alias("part"), F.concat("heading", F.lit(" / parameter "), (F.col("i") + 1).cast("string")).alias("heading"), "text")
    return whole.unionByName(pieces)


def useful_clauses(found: DataFrame, cap: int | None = None) -> DataFrame:
    """The clauses of each document that have 50 characters and aren't mostly dots; with a cap, the first of them."""
    text = T.stripped(F.col("text"))
    dots = F.length(text) - F.length(F.translate(text, ".", ""))
    good = found.where((F.length(text) >= 50) & (dots <= F.length(text) * 0.35))
    if cap is None:
        return good
    return good.withColumn("n", F.row_number().over(Window.partitionBy("doc_id").orderBy("clause_ord"))).where(F.col("n") <= cap).drop("n")


def sentence_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, sentence_ord, sentence) of docs(doc_id, text)."""
    return docs.select("doc_id", F.posexplode(T.sentences(F.col("text"))).alias("sentence_ord", "sentence"))


def markup_paragraphs(docs: DataFrame, tags=X.XML_TAGS) -> DataFrame:
    """(doc_id, p_ord, text): texts of the elements with these tags in markup, of 8 characters and more, in order."""
    names = "|".join(tags)
    found = F.regexp_extract_all(F.col("text"), F.lit(rf"(?s)<(?:{names})(?:\s[^>]*)?>(.*?)</(?:{names})>"), 1)
    plain = lambda x: T.compact(F.regexp_replace(x, r"<[^>]+>", " "))
    kept = F.filter(F.transform(found, plain), lambda x: F.length(x) >= 8)
    whole = F.array(plain(F.col("text")))
    return docs.select("doc_id", F.posexplode(F.when(F.size(kept) > 0, kept).otherwise(whole)).alias("p_ord", "text"))


def markup_blocks(docs: DataFrame, tags=X.XML_TAGS, heading: str = X.XML_HEADING, read: Callable[..., DataFrame] = markup_paragraphs) -> DataFrame:
    """(doc_id, block, heading, text): paragraphs from each heading to the next; blocks of under 80 characters are dropped.

    read gives the paragraphs: markup_paragraphs takes markup of any kind, sources.markup.paragraphs well-formed XML. The whole text
    of XML without paragraphs is one block, however short.
    """
    rows = read(docs, tags)
    whole = F.col("tag").isNull() if "tag" in rows.columns else F.lit(False)
    order = Window.partitionBy("doc_id").orderBy("p_ord").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumns({"whole": whole, "is_heading": F.col("text").rlike(heading) & ~whole}).withColumn("block", F.sum(F.col("is_heading").cast("int")).over(order))
    out = rows.groupBy("doc_id", "block").agg(
        F.max(F.when(F.col("is_heading"), F.substring("text", 1, 180))).alias("heading"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("p_ord", "text"))), lambda r: r["text"]), " ").alias("text"), F.max("whole").alias("whole")
    )
    return out.where((F.length("text") >= 80) | F.col("whole")).drop("whole").withColumn("heading", F.coalesce("heading", F.lit("XML text")))


def markup_text(docs: DataFrame) -> DataFrame:
    """(doc_id, text): all text of markup, without its tags."""
    return docs.withColumn("text", T.compact(F.regexp_replace("text", r"<[^>]+>", " ")))


def markup_chunks(docs: DataFrame, tags=X.XML_TAGS, heading: str = X.XML_HEADING, read: Callable[..., DataFrame] = markup_paragraphs, texts: Callable[[DataFrame], DataFrame] = markup_text) -> DataFrame:
    """(doc_id, chunk_ord from 0, heading, page, text): excerpts of the packed parts of each block of docs(doc_id, code, text).

    A document without any gives windows of its whole text, named by its code. Null texts give nothing. read and texts give
    paragraphs and whole texts, as in markup_blocks.
    """
    kind = "array<struct<block:bigint,part:int,heading:string,text:string>>"
    blocks = markup_blocks(docs.select("doc_id", "text"), tags, heading, read).withColumn("parts", packed_chunks(F.col("text"), *X.XML_CHUNK))
    parts = blocks.select("doc_id", "block", "heading", F.size("parts").alias("n"), F.posexplode("parts").alias("part", "text"))
    name = F.when(F.col("n") > 1, F.concat("heading", F.lit(" / part "), (F.col("part") + 1).cast("string"))).otherwise(F.col("heading"))
    held = parts.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("block", "part", name.alias("heading"), T.excerpt(F.col("text")).alias("text")))).cast(kind).alias("_parts"))
    numbered = lambda w, i: F.struct(F.lit(0).alias("block"), i.alias("part"), F.concat("code", F.lit(" chunk "), (i + 1).cast("string")).alias("heading"), T.excerpt(w).alias("text"))
    whole = F.transform(windows(F.col("_text")), numbered).cast(kind)
    rest = docs.select("doc_id", "code").join(texts(docs).select("doc_id", F.col("text").alias("_text")), "doc_id")
    out = rest.join(held, "doc_id", "left").select("doc_id", F.posexplode(F.coalesce("_parts", whole)).alias("chunk_ord", "c"))
    return out.select("doc_id", "chunk_ord", "c.heading", F.lit(X.XML_PAGE).alias("page"), "c.text")


def search_chunks(entries: DataFrame, pages: DataFrame, markup: DataFrame) -> DataFrame:
    """Search chunks of PDF and markup entries alike: (doc_id, code, title, domain, region, path, chunk_ord, heading, page, text, extract_method, text_coverage).

    entries(doc_id, code, title, domain, region, path) are read from pages(doc_id, page, text, text_source) where the path ends in
    .pdf, else from markup(doc_id, text), which has XML. The last two columns tell how a PDF's text was had, and are null for markup.
    XML that isn't well formed gives no chunks (sources.markup.errors tells why), and no chunk is without a token to search for.
    """
    pdf = F.lower("path").endswith(".pdf")
    mine = pages.join(entries.where(pdf).select("doc_id"), "doc_id", "left_semi")
    found = clauses(mine)
    places = found.select("doc_id", "clause_ord", F.concat_ws("-", "start_page", "end_page").alias("page"))
    by_clause = clause_chunks(found).join(places, ["doc_id", "clause_ord"])
    order = F.row_number().over(Window.partitionBy("doc_id").orderBy("clause_ord", "part")) - 1
    by_clause = by_clause.select("doc_id", order.alias("chunk_ord"), "heading", "page", "text").join(extraction_summary(mine).select("doc_id", "extract_method", "text_coverage"), "doc_id")
    by_block = markup_chunks(markup.join(entries.where(~pdf).select("doc_id", "code"), "doc_id"), read=xml.paragraphs, texts=xml.texts)
    out = entries.select("doc_id", "code", "title", "domain", "region", "path").join(by_clause.unionByName(by_block, allowMissingColumns=True), "doc_id")
    return out.where(F.size(T.tokens(F.concat_ws(" ", "text", "code", "title"))) > 0)
