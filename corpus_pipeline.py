"""From raw documents to packed sequences: two quality filters, line dedup, near-dedup and packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that the one before it kept. All but the last return the columns
of documents; the last returns one row for each piece of a document in a sequence.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessel.llm import decision_list, line_dedup, minhash, packing, rule_ensemble
from tessel.llm.common import forget, quoted, settled, table
from tessel.session import prepared


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rule ensemble accepts; it learns from the labels of those in docs that aren't held out.

    A null text counts as an empty one and is scored like any other. Repeated rows are judged each for itself, alike; an empty table, or one
    without labels, loses nothing here.
    """
    prepared(spark)
    return rule_ensemble.keep_good(docs, table(spark, sf_dir, "labels"))


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the base rules and the learned decision list.

    A null text has no words and fails the base rules, as an empty one does. Repeated rows are judged alike; without labels the base
    rules decide alone.
    """
    prepared(spark)
    return decision_list.keep_good(docs, table(spark, sf_dir, "labels"))


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, without lines that others share; n_chars follows the text.

    A null text becomes an empty one. Rows that repeat a doc_id count as one document, and each keeps its own text; a shared line stays
    in the largest doc_id. Other columns pass, whatever their names.
    """
    prepared(spark)
    out = line_dedup.dedup_lines(docs, counts=None)
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*quoted(docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document, that of the least id, of each class of near-duplicates.

    Texts without words are never duplicates. Rows that share a doc_id are one document and stay or go together; rows without an id stay.
    """
    prepared(spark)
    return minhash.keep_one(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents in sequences of 2,048 tokens; a null or empty text is its closing token alone, a repeated row is packed again."""
    prepared(spark)
    return packing.pack_documents(docs, packing.tokenizer_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("quality rules", quality_rules),
    ("line dedup", dedup_lines),
    ("MinHash near-dedup", near_dedup),
    ("packing", pack),
]

#: Fitted models and sampled hashes can't be told in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents; each result is written to the shared folder and read again by the next.

    A stage's table goes once the next one's is written; the last stage reads its input as the result is read, so that one stays.
    """
    docs, read = table(spark, sf_dir, "documents"), []
    for _, stage in STAGES[:-1]:
        docs = settled(stage(spark, docs, sf_dir))
        forget(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
