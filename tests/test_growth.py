"""Plans whose work and memory must not grow faster than their input."""

import random
import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from __spark_entry__ import queries
from tessel.functions import fixed as X
from tessel.functions import text as T
from tessel.operators import assign, category, compare, segment
from tessel.plans import catalogue, derived
from tessel.session import settled


def plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def scans(df) -> int:
    return len(re.findall(r"(?m)^[\s:+\-|]*Relation", plan(df)))


def test_matrix_joins_nothing(spark, sf):
    # a join of hits by result was taken for small, and sent whole through the driver
    df = queries()["parameter_matrix"](spark, sf)
    assert "Join" not in plan(df) and scans(df) == 1


def test_matrix_of_one_sided_and_empty_clauses(spark):
    clause = "struct<clause_ord:int,heading:string,text:string,start_page:int,end_page:int>"
    of = lambda n, text: (n, f"h{n}", text, n, n + 1)
    rows = [
        ("a", 1, of(1, "The width of the plate shall be at least 5 mm and 7 kN."), of(2, "The width of the plate shall be at least 6 mm and 7 kN."), 0.9, "阈值/数值变化", "高"),
        ("a", 2, of(3, "The force on the plate shall be at least 9 kN here."), None, 0.0, "删除要求", "中"),
        ("a", 3, None, of(4, "The speed of the plate shall be at least 9 km/h here."), 0.0, "新增要求", "中"),
        ("a", 4, of(5, "This one has no quantity in it at all."), of(6, None), 0.4, "内容修改", "中"),
        (None, 1, of(7, "The force on the plate shall be at least 9 kN here."), None, 0.0, "删除要求", "中"),
    ]
    results = spark.createDataFrame(rows, f"g string, result_ord int, left {clause}, right {clause}, score double, change_type string, risk string")
    found = compare.parameter_matrix(results, "g").orderBy("row_ord").collect()
    got = [(r["g"], r["changed"], r["left_values"], r["right_values"], r["left_location"], r["right_location"], r["left_heading"], r["right_heading"]) for r in found]
    assert sorted(got) == sorted([
        ("a", True, "5 mm", "6 mm", "P1-2", "P2-3", "h1", "h2"), ("a", False, "7 kN", "7 kN", "P1-2", "P2-3", "h1", "h2"),
        ("a", True, "9 kN", "", "P3-4", "", "h3", ""), ("a", True, "", "9 km/h", "", "P4-5", "", "h4"),
    ])
    assert [r["row_ord"] for r in found] == [1, 2, 3, 4] and all(r["left_context"] or not r["left_values"] for r in found)


def test_versions_are_dealt_out(spark, sf):
    # parts are few bytes: a table of many fits one split, and all texts were made and judged in it
    assert "RepartitionByExpression" in plan(catalogue._classes(spark, sf))


def test_filters_work_out_a_result_once(spark, sf):
    df = queries()["result_filters"](spark, sf)
    assert scans(df) == 1 and "Window" not in plan(df)


def test_views_are_what_filters_keep(spark, sf):
    results = catalogue._classes(spark, sf).cache()
    found = {(r["view"], r["part"]) for r in compare.in_views(results).select("view", "part").collect()}
    assert found == {(v, r["part"]) for v in ("actionable", "high", "parameter", "all") for r in compare.filtered(results, v).select("part").collect()}
    empty = spark.createDataFrame([(1, None, None, None)], "part int, change_type string, risk string, summary string")
    assert [r["view"] for r in compare.in_views(empty).collect()] == ["all"]


@pytest.mark.parametrize("table", [assign.TABLE, 24])
def test_matching_characters_are_the_matchers(table, monkeypatch):
    monkeypatch.setattr(assign, "TABLE", table)
    of = random.Random(5)
    for letters in ("ab", "abc", "abcdefgh ", "aé漢𝔘 x"):
        for _ in range(300):
            a, b = ("".join(of.choice(letters) for _ in range(of.choice([0, 1, 2, 7, 8, 9, 15, 16, 17, of.randint(0, 60)]))) for _ in range(2))
            a = of.choice([a, b, b[: len(b) // 2] + a[:3] + b[len(b) // 2 :]])
            blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
            assert assign.matching_characters(assign.places(b), b, a) == sum(x.size for x in blocks)


def test_usual_texts_are_matched_by_runs(monkeypatch):
    # the matcher's loops over characters were nine tenths of the work of a category
    monkeypatch.setattr(assign, "SequenceMatcher", None)
    rights = assign.Rights([1, 2, 3], ["the width of the plate", "", "the force on the plate"], [None] * 3)
    score, i = rights.best(1, "the force of a plate", 0.32)
    assert i == 2 and score == SequenceMatcher(None, "the force on the plate", "the force of a plate", autojunk=False).ratio()
    assert rights.best(2, "", 0.32) == (1.0, 1)
    got = compare.ratios(["the force of a plate", ""], ["the force on the plate", ""], 0.32).tolist()
    assert got == [[score, -1.0], [-1.0, 1.0]]


@pytest.mark.parametrize("name", ["category_batch", "category_markdown"])
def test_pairs_of_a_category_are_found_once(name, spark, sf):
    # each step above held the manifest twice, and planned and read it again
    assert "p_partkey" not in plan(queries()[name](spark, sf))


def test_paragraphs_are_worked_out_once_and_headed_behind_the_shuffle(spark):
    # the text of a paragraph was made for its length, for itself and, split anew, for its heading, which was shuffled with it
    df = segment.paragraphs(spark.createDataFrame([("a", 1, "x")], "doc_id string, page int, text string"))
    above, below = plan(df).split("Window", 1)
    assert "substring_index" in above and "substring" not in below and below.count("Filter") == 1
    assert plan(df).count("[.…]{5,}") == 1


def test_paragraphs_of_odd_texts(spark):
    texts = [
        "One sentence that is long enough. Another one that is long enough too!\n\nA third paragraph\r\nwith two lines here",
        "Title of it ........ 12\n\n\nTitle of it ........ 12\n\nreal line of enough length\nTitle of it ........ 13\nlast line",
        "  wide blanks around a sentence. Next sentence is here\u0085and its second line third", "第一条 这是一个足够长的句子，用来测试分段的规则。 第二条 这也是一个足够长的句子，用来测试。", "", None, "short", "....................\n\na.b.c.d.e.f is a text of many dots", "x" * 19 + "\x1c", "\x1dy line of some length\n", "a\n" * 30,
        "\n \nTitle ........ 9\n\t\nbody of the page that follows",
    ]
    pages = spark.createDataFrame([(i, 1, t) for i, t in enumerate(texts)], "doc_id int, page int, text string")
    chunks = pages.select("doc_id", F.posexplode(F.split("text", X.PARAGRAPH_BREAK)).alias("part", "chunk"))
    plain = chunks.select("doc_id", "part", F.array_join(F.filter(T.lines(T.stripped(F.col("chunk"))), lambda x: ~T.is_toc(x)), "\n").alias("text")).where(F.length("text") >= 20)
    want = [(r["doc_id"], r["text"], r["h"]) for r in plain.withColumn("h", F.substring(F.element_at(T.lines(F.col("text")), 1), 1, 90)).orderBy("doc_id", "part").collect()]
    got = [(r["doc_id"], r["text"], r["heading"]) for r in segment.paragraphs(pages).orderBy("doc_id", "clause_ord").collect()]
    assert got == want and len(got) > 10


@pytest.mark.parametrize("small", [0, 30, assign.SMALL])
@pytest.mark.parametrize("table", [assign.TABLE, 24])
def test_parts_of_all_sizes_are_matched_alike(small, table, monkeypatch):
    monkeypatch.setattr(assign, "SMALL", small)
    monkeypatch.setattr(assign, "TABLE", table)
    of = random.Random(7)
    for letters in ("ab", "abcdefgh ", "aé漢𝔘 x"):
        for _ in range(150):
            a, b = ("".join(of.choice(letters) for _ in range(of.choice([0, 1, 2, 8, 16, of.randint(0, 60)]))) for _ in range(2))
            a = of.choice([a, b, b[: len(b) // 2] + a[:3] + b[len(b) // 2 :]])
            blocks = SequenceMatcher(None, a, b, autojunk=False).get_matching_blocks()
            assert assign.matching_characters(None, b, a) == sum(x.size for x in blocks)


def test_exact_ratios_only_where_no_bound_decides():
    # a text with the same characters came first, and its ratio was worked out before the bound of a closer text was known
    left = "the width of the plate"
    rights = assign.Rights([1, 2], [left[::-1], left + " x"], [None] * 2)
    score, i = rights.best(1, left, 0.32)
    assert i == 1 and score == SequenceMatcher(None, left + " x", left, autojunk=False).ratio() and rights.verified == 1


def test_one_side_alone_is_judged_without_its_text(spark):
    # most results of a category have one side, and their texts were searched for numbers and references all the same
    one = ("h", "The width shall be at least 5 mm as in GB 12.")
    rows = [(1, one, None, 0.0), (2, None, one, 0.0), (3, None, None, 0.0), (4, one, one, 1.0), (5, one, ("h", one[1].replace("5", "6")), 0.9), (6, one, ("h", None), 0.9)]
    side = "struct<heading:string,text:string>"
    df = compare.classified(spark.createDataFrame(rows, f"n int, left {side}, right {side}, score double"))
    assert re.search(r"isnotnull\(left#\d+\) AND isnotnull\(right#\d+\)", plan(df))
    got = {r["n"]: (r["change_type"], r["risk"], len(r["evidence"])) for r in df.collect()}
    assert got[1] == ("删除要求", "中", 1) and got[2] == ("新增要求", "中", 1) and got[3][2] == 0
    assert got[4] == ("无实质变化", "低", 2) and got[5] == ("阈值/数值变化", "高", 2) and got[6][2] == 1


def test_documents_of_a_category_are_folded_once(spark, sf, monkeypatch):
    # segments were folded for the documents that have enough clauses, and again to find those that haven't
    seen = []
    monkeypatch.setattr(category, "settled", lambda df: seen.append(df) or settled(df))
    entries = category.comparable(derived.regulation_entries(spark, sf))
    found = category.category_clauses(entries, derived.regulation_pages(spark, sf), derived.regulation_markup(spark, sf))
    assert ["found" in df.columns for df in seen] == [True, False]
    plain = segment.useful_clauses(segment.clauses(derived.regulation_pages(spark, sf).join(entries.where("lower(path) like '%.pdf'").select("doc_id"), "doc_id", "left_semi")))
    assert sorted(found.where("id like 'C%'").select(plain.columns).collect()) == sorted(plain.collect())
