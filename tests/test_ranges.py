"""Clauses found range by range against those found document by document."""

import random

import pytest
from pyspark.sql import functions as F

from tessel.operators import ranges, segment


def documents(rng, n):
    kinds = ["5.{} heading", "a", "Annex 3 b", "Article 7", "a line of running text that is long enough by itself", "short line", ". . . . . . . . . 12", "", "6. The longer heading of a whole clause"]
    for d in range(n):
        for page in range(1, rng.randrange(2, 14)):
            lines = [rng.choice(kinds).format(rng.randrange(9)) for _ in range(rng.randrange(9))]
            if d % 5 == 1 and page == 1:
                lines.insert(0, "UN Regulation No. 13 Amendment 4")
            yield d, page, "\n".join(lines)


@pytest.mark.parametrize("pages, segments", [(1, 1), (2, 3), (64, 256)])
def test_clauses_by_ranges(spark, pages, segments):
    rows = [*documents(random.Random(9), 40), (100, 1, None), (101, 1, ""), (102, 3, "one paragraph that is long enough to count")]
    df = spark.createDataFrame(rows, "doc_id long, page int, text string")
    key = lambda r: (r.doc_id, r.clause_ord)
    columns = ["doc_id", "clause_ord", "id", "heading", "text", "start_page", "end_page"]
    want = sorted(segment.clauses(df).select(columns).collect(), key=key)
    assert sorted(ranges.clauses(df, pages, segments).select(columns).collect(), key=key) == want and len(want) > 100


def test_runs_of_short_segments_are_chained(spark):
    rng = random.Random(2)
    lengths = [rng.choice([1, 2, 9, 14, 28, 29, 30, 31, 80]) for _ in range(700)]
    got = ranges.clause_numbers(spark.createDataFrame([("d", i, n) for i, n in enumerate(lengths)], "doc_id string, segment long, length long"), 16).orderBy("segment").collect()
    carry = clause = 0
    for r, n in zip(got, lengths):
        whole = carry + 1 + n if carry else n
        assert (r.clause, r.closes) == (clause, whole >= 30)
        carry, clause = (0, clause + 1) if whole >= 30 else (whole, clause)


def test_a_long_document(spark):
    n = 6000
    lines = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: F.when(i % 5 == 0, F.concat(F.lit("5."), F.col("id").cast("string"), F.lit(" part"))).otherwise("text of this part, in a line")), "\n")
    pages = spark.range(n).select(F.lit("d").alias("doc_id"), (F.col("id") + 1).cast("int").alias("page"), lines.alias("text"))
    got = ranges.clauses(pages)
    assert got.count() == 5 * n and got.agg(F.max("end_page"), F.max("clause_ord")).first()[:] == (n, 5 * n)
