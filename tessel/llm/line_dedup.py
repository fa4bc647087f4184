"""Line dedup: lines that many documents share stay in one document only.

Every line is normalised and hashed (128 bits); distinct documents are counted for each hash; the lines over the threshold
are dropped everywhere but in the largest doc_id that holds them; the rest is put together again by position. Only hashes,
ids and positions take part in the counting shuffles; texts are shuffled once, to meet their positions.
"""

from __future__ import annotations

import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ASCII_SPACE, quoted, skew_join, table



def _text(col: str) -> Column:
    return F.coalesce(F.col(col), F.lit(""))


def _at(values: Column, positions: Column) -> Column:
    """The values at these positions; the outer lambda has both worked out once for each row."""
    return F.transform(F.array(values), lambda v: F.transform(positions, lambda i: F.get(v, i)))[0]


def shared_line_positions(docs: DataFrame, min_chars: int = 40, min_docs: int = 5) -> DataFrame:
    """(doc_id, print, drop): for each document that loses lines, their positions. print is a hash of its text."""
    lines = docs.select("doc_id", F.xxhash64(_text("text")).alias("print"), F.posexplode(F.split(_text("text"), "\n")).alias("pos", "line"))
    stripped = lines.select("doc_id", "print", "pos", F.btrim("line", F.lit(ASCII_SPACE)).alias("line"))
    keys = stripped.where(F.length("line") >= min_chars).select(
        "doc_id", "print", "pos", F.unhex(F.md5(F.translate("line", string.ascii_uppercase, string.ascii_lowercase))).alias("key")
    )
    shared = (
        keys.select("key", "doc_id").distinct().groupBy("key").agg(F.count(F.lit(1)).alias("n"), F.max("doc_id").alias("keeper"))
    ).where(F.col("n") >= min_docs)
    lost = skew_join(keys, shared.select("key", "keeper"), "key").where(~F.col("doc_id").eqNullSafe(F.col("keeper")))
    return lost.groupBy("doc_id", "print").agg(F.collect_set("pos").alias("drop"))


def dedup_lines(docs: DataFrame, min_chars: int = 40, min_docs: int = 5, counts: str | None = "line_dedup") -> DataFrame:
    """docs with its columns, text replaced, and a struct column counts(n_lines, n_dropped), in place of one of that name; None: no such column.

    A key is the line without ASCII white space at its ends, A-Z lower-cased. Keys of at least min_chars code points in at
    least min_docs distinct doc_ids lose all their lines except in the largest of these ids. A null or empty text is one
    empty line and comes back as an empty text. Rows that share a doc_id count as one document; each keeps its own text. A null
    doc_id is one more document, never the keeper if there is another.
    """
    names = [n for n in docs.columns if n != counts]
    drops = shared_line_positions(docs, min_chars, min_docs).select(F.col("doc_id").alias("_op6_drop_id"), F.col("print").alias("_op6_drop_print"), F.col("drop").alias("_op6_drop"))
    rows = docs.withColumn("_op6_print", F.xxhash64(_text("text")))
    joined = rows.join(drops, F.col("doc_id").eqNullSafe(F.col("_op6_drop_id")) & (F.col("_op6_print") == F.col("_op6_drop_print")), "left")
    lines = F.split(_text("text"), "\n")
    kept = F.array_except(F.sequence(F.lit(0), F.col("_op6_n") - 1), F.col("_op6_drop"))
    done = joined.withColumn("_op6_n", F.size(lines)).withColumn(
        "_op6_kept", F.when(F.col("_op6_drop").isNull(), _text("text")).otherwise(F.array_join(_at(lines, kept), "\n"))
    )
    found = F.struct(F.col("_op6_n").cast("long").alias("n_lines"), F.coalesce(F.size("_op6_drop"), F.lit(0)).cast("long").alias("n_dropped"))
    return done.select(*[F.col("_op6_kept").alias("text") if n == "text" else c for n, c in zip(names, quoted(names))], *([found.alias(counts)] if counts else []))


def op6_line_dedup(spark, sf_dir: str) -> DataFrame:
    out = dedup_lines(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "line_dedup.n_lines", "line_dedup.n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


OP6_SQL = r"""
WITH l AS (
  SELECT doc_id, i AS pos, parts[i] AS line
  FROM (SELECT doc_id, parts, unnest(range(1, len(parts) + 1)) AS i
        FROM (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))
), k AS (
  SELECT doc_id, pos, line,
         translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)),
                   'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM l
), s AS (
  SELECT key, max(doc_id) AS keeper FROM k WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5
), m AS (
  SELECT k.doc_id, k.pos, k.line, (s.key IS NOT NULL AND k.doc_id <> s.keeper) AS gone FROM k LEFT JOIN s ON k.key = s.key
)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (WHERE gone)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id
"""
