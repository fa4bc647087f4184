"""Inputs in the shapes that the operators take, made from the driver's tables, in Spark and in SQL alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import cells


def read(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


SQL_SPACE = "' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)"

#: Pages of 20 lines of each document.
PAGES_SQL = """
lines AS (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, unnest(range(0, len(string_split(text, chr(10))))) AS n FROM documents),
pages_of AS (SELECT doc_id, n // 20 + 1 AS page, string_agg(line, chr(10) ORDER BY n) AS text FROM lines GROUP BY doc_id, n // 20)
"""


def pages(spark: SparkSession, d: str) -> DataFrame:
    # pages are made before they become rows, so that no row has all lines of its document
    page = lambda l, p: F.struct((p + 1).alias("page"), F.array_join(F.slice(l, p * 20 + 1, F.lit(20)), "\n").alias("text"))
    every = T.let(F.split("text", "\n"), lambda l: F.transform(F.sequence(F.lit(0), F.floor((F.size(l) - 1) / 20).cast("int")), lambda p: page(l, p)))
    return read(spark, d, "documents").select("doc_id", F.inline(every))


#: Lines of regulations, in the order of the parts: a document for each brand in each 2,000 parts, so that documents grow in number.
DOC_CASE = "concat(p_brand, '/', CAST(floor(p_partkey / 2000) AS INT))"
LINE_CASE = """CASE p_partkey % 8
  WHEN 0 THEN concat('5.', p_size, ' ', p_name)
  WHEN 1 THEN concat(p_name, ' .......... ', p_size)
  WHEN 2 THEN concat('ICS 43.', p_size)
  WHEN 3 THEN concat('Annex ', p_size, ' ', p_type)
  WHEN 4 THEN concat('The ', p_name, ' shall be at least ', p_size, ' mm wide')
  WHEN 5 THEN concat('Article ', p_size)
  WHEN 6 THEN concat(p_name, '. . . . . . . . . ')
  ELSE concat('The test of the ', p_type, ' takes ', p_size, ' min at ', p_size + 20, ' km/h')
END"""
REGULATION_LINES_SQL = f"regulation AS (SELECT {DOC_CASE} AS doc_id, p_partkey AS line_ord, {LINE_CASE} AS line FROM part)"
#: Pages of them, 400 parts each.
REGULATION_PAGES_SQL = REGULATION_LINES_SQL + """,
numbered AS (SELECT *, CAST(floor(line_ord % 2000 / 400) AS INT) + 1 AS page FROM regulation),
regulation_pages AS (SELECT doc_id, page, string_agg(line, chr(10) ORDER BY line_ord) AS text FROM numbered GROUP BY doc_id, page)"""


def regulation_lines(spark: SparkSession, d: str) -> DataFrame:
    return read(spark, d, "part").select(F.expr(DOC_CASE).alias("doc_id"), F.lit(1).alias("page"), F.col("p_partkey").alias("line_ord"), F.expr(LINE_CASE).alias("line"))


def regulation_pages(spark: SparkSession, d: str) -> DataFrame:
    """Documents of these lines, about 16 on a page."""
    rows = regulation_lines(spark, d).withColumn("page", F.floor(F.col("line_ord") % 2000 / 400).cast("int") + 1)
    each = rows.groupBy("doc_id", "page").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("line_ord", "line"))), lambda r: r["line"]), "\n").alias("text"))
    return each


#: Two versions of a requirement for each part; every seventh has another value, others another wording, reference or nothing.
OLD_CASE = "concat('The ', p_name, ' of class GB ', 1000 + p_size, ' shall be at least ', p_size, ' mm and not exceeding ', p_size + 50, ' kN.')"
NEW_CASE = """CASE
  WHEN p_partkey % 7 = 0 THEN concat('The ', p_name, ' of class GB ', 1000 + p_size, ' shall be at least ', p_size + 1, ' mm and not exceeding ', p_size + 50, ' kN.')
  WHEN p_partkey % 7 = 1 THEN concat('The  ', upper(p_name), ' of class GB ', 1000 + p_size, ' shall be at least ', p_size, ' mm and not exceeding ', p_size + 50, ' kN.')
  WHEN p_partkey % 7 = 2 THEN concat('The ', p_name, ' of class GB ', 2000 + p_size, ' shall be at least ', p_size, ' mm and not exceeding ', p_size + 50, ' kN, with the latest test procedure.')
  WHEN p_partkey % 7 = 3 THEN concat('This applies to the ', p_name, ' of class GB ', 1000 + p_size, ' which has ', p_size, ' mm, up to ', p_size + 50, ' kN.')
  WHEN p_partkey % 7 = 4 THEN concat('The ', p_name, ' means class GB ', 1000 + p_size, ' of any size.')
  WHEN p_partkey % 7 = 5 THEN NULL
  ELSE concat('The ', p_name, ' of class GB ', 1000 + p_size, ' shall be at least ', p_size, ' mm and not exceeding ', p_size + 50, ' kN.')
END"""
#: A score for each pair of versions.
SCORE_CASE = "CASE WHEN p_partkey % 7 = 5 THEN 0.0 ELSE (40 + p_partkey % 60) / 100.0 END"


def versions(spark: SparkSession, d: str) -> DataFrame:
    """(part, brand, left, right, score) with clauses as structs; a new version that is missing is null."""
    clause = lambda text: F.struct(F.col("p_partkey").cast("int").alias("clause_ord"), F.col("p_name").alias("heading"), text.alias("text"), F.col("p_size").alias("start_page"), (F.col("p_size") + F.col("p_partkey") % 3).cast("int").alias("end_page"))
    # the work is in the texts that are made here, and a table of small rows may come in a single part
    parts = cells.spread(read(spark, d, "part").select("p_partkey", "p_name", "p_brand", "p_size"), "p_partkey")
    rows = parts.withColumns({"_old": F.expr(OLD_CASE), "_new": F.expr(NEW_CASE), "score": F.expr(SCORE_CASE).cast("double")})
    return rows.select(F.col("p_partkey").alias("part"), F.col("p_brand").alias("brand"), clause(F.col("_old")).alias("left"), F.when(F.col("_new").isNotNull(), clause(F.col("_new"))).alias("right"), "score")


#: A quantity with a unit in a sentence for each order line of the first order keys.
UNITS = ("mm", "kN", "km/h", "kPa", "dB", "g/km", "degrees", "lux", "%", "min", "°C", "kg")
SENTENCE_CASE = (
    "concat('The measured ', CASE l_linenumber % 4 WHEN 0 THEN 'speed' WHEN 1 THEN 'stopping distance' WHEN 2 THEN 'force' ELSE 'part' END, ' shall be at least ', CAST(l_quantity AS INT), ' ', "
    "CASE CAST(l_suppkey % 12 AS INT) " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(UNITS)) + " END, ' for lot ', l_orderkey, ' under FMVSS ', 100 + l_suppkey % 30, ' and ISO ', 9000 + l_linenumber, '.')"
)


def sentences(spark: SparkSession, d: str) -> DataFrame:
    # the work is in the texts that are made here, and a table of small rows may come in a single part
    rows = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity").repartition("l_orderkey", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", F.element_at(F.array(*[F.lit(u) for u in UNITS]), (F.col("l_suppkey") % 12 + 1).cast("int")).alias("unit"), F.expr(SENTENCE_CASE).alias("text"))


SENTENCES_SQL = (
    "s AS (SELECT l_orderkey, l_linenumber, l_partkey, CASE CAST(l_suppkey % 12 AS INT) " + " ".join(f"WHEN {i} THEN '{u}'" for i, u in enumerate(UNITS)) + f" END AS unit, {SENTENCE_CASE} AS text FROM lineitem)"
)


def questions(spark: SparkSession, d: str) -> DataFrame:
    """The benchmark's passages, whole."""
    return read(spark, d, "benchmark").select(F.col("item_id").alias("q_id"), F.col("text").alias("question"))


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Documents as chunks, their sources as headings."""
    return read(spark, d, "documents").select("doc_id", F.lit(0).alias("chunk_ord"), F.col("source").alias("heading"), "text", F.concat_ws(" ", F.col("doc_id").cast("string"), "source").alias("code_text"))


def regulation_entries(spark: SparkSession, d: str) -> DataFrame:
    """A manifest of the regulations: brands of one maker are a domain. Some are markup, some have no file."""
    doc = regulation_lines(spark, d).select("doc_id").distinct()
    n = F.crc32("doc_id")
    path = F.concat("doc_id", F.when(n % 7 == 0, ".txt").when(n % 3 == 0, ".XML").otherwise(".pdf"))
    return doc.select(
        "doc_id", F.col("doc_id").alias("ord"), F.concat(F.substring("doc_id", 1, 7), F.lit("/"), F.substring_index("doc_id", "/", -1)).alias("domain"), F.concat(F.lit("R"), (n % 4).cast("string")).alias("region"),
        F.col("doc_id").alias("code"), F.concat(F.lit("Regulation "), "doc_id").alias("title"), F.when(n % 11 == 0, "missing").otherwise("copied").alias("status"), path.alias("path"),
    )


def regulation_markup(spark: SparkSession, d: str) -> DataFrame:
    """The same documents as markup, a paragraph for each line."""
    rows = regulation_lines(spark, d).groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("line_ord", "line"))).alias("l"))  # 80 lines of each
    return rows.select("doc_id", F.concat(F.lit("<SECTION>"), F.array_join(F.transform("l", lambda r: F.concat(F.lit("<P>"), r["line"], F.lit("</P>"))), ""), F.lit("</SECTION>")).alias("text"))


#: Documents as XML, an element for each line: with entities, a prefix, a CDATA section, a child, or one element in another. Every
#: eleventh isn't well formed. What XML forbids and where lines end is taken out of the texts.
_LINE = r"regexp_replace({0}, '[\x00-\x1f\x7f-\x9f\x{{fffe}}\x{{ffff}}]|\]\]>', ' '{1})"
XML_LINES_SQL = f"""xml_lines AS (SELECT doc_id, unnest(range(0, len(l))) AS n, {_LINE.format("unnest(l)", ", 'g'")} AS line FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents)),
xml_elements AS (
  SELECT doc_id, n + n // 5 AS p_ord, CASE n % 5 WHEN 3 THEN 'HD' WHEN 4 THEN 'FP' ELSE 'P' END AS tag, CASE n % 5 WHEN 3 THEN line || ' (' || n || ') end' WHEN 4 THEN 'note ' || line || ' of ' || n ELSE line END AS line FROM xml_lines
  UNION ALL SELECT doc_id, n + n // 5 + 1, 'P', line FROM xml_lines WHERE n % 5 = 4
)"""


def xml_documents(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, text) as bytes."""
    line = lambda c: F.regexp_replace(c, r"[\x00-\x1f\x7f-\x9f\x{fffe}\x{ffff}]|\]\]>", " ")
    escaped = lambda c: F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&#62;"))

    def element(raw, n):
        x, no = line(raw), n.cast("string")
        kinds = [
            F.concat(F.lit("<P>"), escaped(x), F.lit("</P>\n")),
            F.concat(F.lit('<c:p at="1 &gt; 0">'), escaped(x), F.lit("</c:p><!-- <P>not this paragraph</P> -->")),
            F.concat(F.lit("<P><![CDATA["), x, F.lit("]]></P><ENT>an entry of a table</ENT>")),
            F.concat(F.lit('<HD SOURCE="HD1">'), escaped(x), F.lit("<E T='03'>("), no, F.lit(")</E>end</HD>")),
            F.concat(F.lit("<FP>note<P>"), escaped(x), F.lit("</P>of "), no, F.lit("</FP>")),
        ]
        return F.element_at(F.array(*kinds), (n % 5 + 1).cast("int"))

    body = F.array_join(F.transform(F.split(F.coalesce("text", F.lit("")), "\n"), element), "")
    head = F.concat(F.lit('<?xml version="1.0" encoding="UTF-8"?><CFR xmlns:c="urn:c"><SECTION N="1 > 0"><SECTNO>§ '), F.col("doc_id").cast("string"), F.lit(".5 <b>9</b></SECTNO>"))
    tail = F.when(F.col("doc_id") % 11 == 0, "</SECTION>").otherwise("</SECTION></CFR>")
    return read(spark, d, "documents").select("doc_id", F.encode(F.concat(head, body, tail), "UTF-8").alias("text"))
