"""Pairs in cells of any size against all pairs."""

import random
from collections import Counter
from difflib import SequenceMatcher

import pytest

from tessel.operators import cells, compare


def entries(rng):
    rows = [("a" if i % 3 else "b", i, rng.choice(["", "red bolt", "redder bolt", "hot ring", "ölig", None])) for i in range(60)]
    return rows + [("c", 99, "alone"), (None, 100, "x"), (None, 101, "x")]


@pytest.mark.parametrize("block", [4, 2048])
def test_pairs_and_bounds_are_those_of_all_pairs(spark, block, monkeypatch):
    monkeypatch.setattr(cells, "BLOCK", block)
    monkeypatch.setattr(cells, "PAIRS_AT_ONCE", 50)
    rows = entries(random.Random(5))
    df = spark.createDataFrame(rows, "domain string, ord int, name string")
    want = {(x, y): (a, b) for d, x, a in rows for e, y, b in rows if d is not None and d == e and x < y}
    pairs = [(r.l_ord, r.r_ord) for r in compare.domain_pairs(df).collect()]
    assert sorted(pairs) == sorted(want)
    found = compare.pair_bounds(df).collect()
    assert sorted((r.l_ord, r.r_ord) for r in found) == sorted(want)
    for r in found:
        a, b = want[r.l_ord, r.r_ord]
        if a is None or b is None:
            assert r.by_length is None and r.by_characters is None
        else:
            n = len(a) + len(b)
            assert r.by_length == (2 * min(len(a), len(b)) / n if n else 1.0) and r.by_characters == (2 * (Counter(a) & Counter(b)).total() / n if n else 1.0)


def test_a_cell_is_bounded_and_tasks_share_the_work(spark, monkeypatch):
    """Rows of one domain, which one task had before, are in several parts."""
    monkeypatch.setattr(cells, "BLOCK", 16)
    df = spark.range(200).selectExpr("'a' AS domain", "id AS ord", "'n' AS name")
    parts = compare.domain_pairs(df).groupBy(__import__("pyspark").sql.functions.spark_partition_id()).count().collect()
    assert len(parts) > 4 and max(r["count"] for r in parts) < 200 * 199 / 4


@pytest.mark.parametrize("texts, clauses", [(3, 2), (256, 64)])
def test_scored_pairs_are_those_of_all_pairs(spark, texts, clauses, monkeypatch):
    monkeypatch.setattr(compare, "TEXTS", texts)
    monkeypatch.setattr(compare, "CLAUSES", clauses)
    rng = random.Random(6)
    kinds = ["the brake shall hold 5 mm", "the brake holds 5 mm", "a load", "", "xyz"]
    found = [(d, n, "H", rng.choice(kinds)) for d in "abc" for n in range(15)] + [("a", 99, None, "no key")]
    df = spark.createDataFrame(found, "doc_id string, clause_ord int, heading string, text string")
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("a", "none")]
    got = compare.scored_pairs(spark.createDataFrame(pairs, "l_doc string, r_doc string"), df).collect()
    key = lambda t: f"h {t}".strip()
    want = []
    for l, r in pairs:
        for d, i, h, x in found:
            for e, j, g, y in found:
                if d == l and e == r and h and g:
                    score = SequenceMatcher(None, key(y), key(x), autojunk=False).ratio()
                    want += [(l, r, i, j, score)] if score >= 0.32 else []
    assert sorted(tuple(x) for x in got) == sorted(want)


def test_pairs_of_texts_are_worked_out_once(spark, monkeypatch):
    """Documents of many clauses were cut into cells of 64, and each worked out the ratios of the same texts again."""
    seen, of = [], cells.in_cells
    monkeypatch.setattr(cells, "in_cells", lambda left, right, cell, *more: seen.append(left.select(*cell).distinct().count()) or of(left, right, cell, *more))
    df = spark.range(1000).selectExpr("if(id < 500, 'a', 'b') AS doc_id", "CAST(id AS INT) AS clause_ord", "'H' AS heading", "concat('the brake shall hold ', id % 7, ' mm') AS text")
    got = compare.scored_pairs(spark.createDataFrame([("a", "b")], "l_doc string, r_doc string"), df)
    assert got.count() == 500 * 500 and seen == [1]


@pytest.mark.parametrize("known, chars", [(1 << 21, 1 << 24), (8, 1 << 24), (1 << 10, 30)])
def test_remembered_ratios_are_those_of_the_matcher(known, chars, monkeypatch):
    monkeypatch.setattr(compare, "KNOWN", known)
    monkeypatch.setattr(compare, "KNOWN_CHARS", chars)
    monkeypatch.setattr(compare, "_matching", lambda m=compare.Matching(): m)
    rng = random.Random(9)
    texts = ["", *("".join(rng.choice("abc é漢") for _ in range(rng.randint(1, 20))) for _ in range(30))]
    for _ in range(4):
        lefts, rights = rng.sample(texts, 12), rng.sample(texts, 20)
        got = compare.ratios(lefts, rights, 0.32)
        for x, row in zip(lefts, got.tolist()):
            for y, score in zip(rights, row):
                want = SequenceMatcher(None, y, x, autojunk=False).ratio()
                assert score == want if want >= 0.32 else score < 0.32
    worked_out = compare._matching().worked_out
    compare.ratios(lefts, rights, 0.32)
    if known > 1000 and chars > 1000:
        assert compare._matching().worked_out == worked_out > 0
