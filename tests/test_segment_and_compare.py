"""Segmentation, matching and retrieval on small documents."""

import re
from difflib import SequenceMatcher

import pytest
from pyspark.sql import functions as F

from tessel.functions import fixed as X
from tessel.operators import compare, retrieve, segment

PAGES = "doc_id string, page int, text string, text_source string"


def pages(spark, *texts, doc="d"):
    return spark.createDataFrame([(doc, i, t, "pypdf") for i, t in enumerate(texts, 1)], PAGES)


def test_short_clause_goes_into_the_next(spark):
    text = "5.1 Alpha\nshort\n5.2 Beta\nThis body is long enough to stand for itself.\n5.3 Gamma\nAnd this body is also long enough for it."
    got = [(r.id, r.heading, r.text) for r in segment.clauses(pages(spark, text)).orderBy("clause_ord").collect()]
    assert [g[:2] for g in got] == [("C0001", "5.2 Beta"), ("C0002", "5.3 Gamma")]
    assert got[0][2].startswith("5.1 Alpha\nshort\n5.2 Beta")


def test_clauses_over_pages_and_noise(spark):
    first = "Preface line that comes before all headings here.\n12\nScope ........ 3\nAnnex A the first annex\nBody of the annex that is long enough."
    second = "It goes on here.\nArticle 7\nThe article's body is long enough as well."
    got = [(r.heading, r.start_page, r.end_page) for r in segment.clauses(pages(spark, first, second)).orderBy("clause_ord").collect()]
    assert got == [("Preface line that comes before all headings here.", 1, 1), ("Annex A the first annex", 1, 2), ("Article 7", 2, 2)]


def test_paragraphs_where_there_are_no_headings(spark):
    got = segment.clauses(pages(spark, "A first paragraph which is long.\n\nAnother paragraph, also long. Then a sentence of its own.")).orderBy("clause_ord").collect()
    assert [r.text for r in got] == ["A first paragraph which is long.", "Another paragraph, also long.", "Then a sentence of its own."]


def test_windows_and_packs(spark):
    text = "word " * 600
    row = spark.createDataFrame([(text,)], "t string").select(segment.windows(F.col("t")).alias("w"), segment.packed_chunks(F.trim("t"), 500, 50).alias("p")).first()
    assert row.w == [x for x in (text[s : s + 1200].strip() for s in range(0, len(text), 1040)) if len(x) > 80]
    assert all(len(p) <= 500 for p in row.p)
    marked = " ".join(f"S5.{i} {'requirement ' * 12}" for i in range(8)).strip()
    packs = spark.createDataFrame([(marked,)], "t string").select(segment.packed_chunks(F.col("t"), 400, 50).alias("p")).first().p
    want, now = [], ""
    for part in filter(None, map(str.strip, re.split(X.BOUNDARY.replace("(?iU)", "(?i)"), marked))):
        if not now or len(now) + len(part) + 1 <= 400:
            now = f"{now} {part}".strip()
        else:
            want, now = [*want, now], part
    assert packs == [p for p in [*want, now] if len(p) > 80]


def test_markup_blocks(spark):
    body = "text that makes the block long enough to be kept, which takes eighty characters or so"
    xml = f"<SECTION><P>S1. <E T='03'>Scope</E>.</P><P>too short</P><P>S2. Tests</P><FP>{body}</FP><HD>heading here</HD></SECTION>"
    docs = spark.createDataFrame([("x", xml)], "doc_id string, text string")
    assert [(r.heading, r.text) for r in segment.markup_blocks(docs).collect()] == [("S2. Tests", f"S2. Tests {body} heading here")]


def test_page_operators(spark):
    original = pages(spark, "tiny", "x" * 60, "")
    ocr = spark.createDataFrame([("d", 1, "o" * 90, 1), ("d", 1, "p" * 95, 2), ("d", 2, "q" * 99, 1)], "doc_id string, page int, text string, ord int")
    merged = segment.merge_pages(original, ocr)
    assert {r.page: (r.text[:1], r.text_source) for r in merged.collect()} == {1: ("p", "ocr"), 2: ("x", "pypdf"), 3: ("", "pypdf")}
    s = segment.extraction_summary(merged).first()
    assert (s.pages, s.text_pages, s.empty_pages, s.extract_method, s.ocr_pages, s.text_coverage, s.wants_ocr) == (3, 2, 1, "mixed", [1], 0.667, True)


@pytest.mark.parametrize(("left", "right", "want"), [("diet", "tide", 0.25), ("tide", "diet", 0.5)])
def test_ratio_order(spark, left, right, want):
    assert spark.createDataFrame([(left, right)], "l string, r string").select(compare.ratio("l", "r").alias("x")).first().x == want


CLAUSE = "doc_id string, clause_ord int, id string, heading string, text string, start_page int, end_page int"


def greedy(left, right):
    key = lambda t: f"h\n{t[:1200]}".replace("\n", " ").lower()
    used, out = set(), []
    for i, a in enumerate(left):
        best, at = 0.0, None
        for j, b in enumerate(right):
            if j not in used:
                m = SequenceMatcher(None, key(b), key(a), autojunk=False).ratio()
                if m > best:
                    best, at = m, j
        if at is not None and best >= 0.32:
            used.add(at)
            out.append((i, at, round(best, 9)))
    return out


def test_matching(spark):
    left = ["the brake shall hold the load", "the brake shall hold the load", "lamps are white", "zzzz qqqq xxxx", "tyres need a tread of 2 mm"]
    right = ["the brake shall hold a load", "lamps are all white", "tyres need a tread of 3 mm", "the brake shall hold the loads"]
    rows = [("l", i, f"C{i}", "h", t, 1, 1) for i, t in enumerate(left)] + [("r", i, f"C{i}", "h", t, 1, 1) for i, t in enumerate(right)]
    found = spark.createDataFrame(rows, CLAUSE)
    pairs = spark.createDataFrame([("l", "r"), ("l", "none")], "l_doc string, r_doc string")
    pairs = compare.with_both(pairs, found)
    got = sorted((r.l_ord, r.r_ord, round(r.score, 9)) for r in compare.assigned(compare.scored_pairs(pairs, found)).collect())
    assert got == greedy(left, right)
    results = compare.ordered(compare.classified(compare.matched(pairs, found)), "l_doc", "r_doc")
    assert results.count() == len(left) + len(right) - len(got)
    kinds = {(r.left and r.left.clause_ord, r.right and r.right.clause_ord): r.change_type for r in results.collect()}
    assert kinds[(4, 2)] == "阈值/数值变化" and kinds[(3, None)] == "删除要求"
    c = compare.conclusion(results, "l_doc", "r_doc").first()
    assert c.total == results.count() and c.deletions == 1 and c.change_type_counts["删除要求"] == 1


def test_bounds_lose_nothing(spark):
    texts = ["abc def", "fed cba", "aaaa", "", "the quick", "quick the", "é"]
    rows = spark.createDataFrame([(a, b) for a in texts for b in texts], "a string, b string")
    for r in rows.select("a", "b", compare.length_bound(F.col("a"), F.col("b")).alias("l"), compare.character_bound(F.col("a"), F.col("b")).alias("c")).collect():
        m = SequenceMatcher(None, r.b, r.a, autojunk=False)
        assert abs(r.l - m.real_quick_ratio()) < 1e-12 and abs(r.c - m.quick_ratio()) < 1e-12


def test_search_and_answer(spark):
    q = spark.createDataFrame([(1, "FMVSS 223 force in kN"), (2, "braking distance")], "q_id int, question string")
    chunks = [("a", 0, "S1", "The guard shall resist a force of 50 kN at point P1. It has a height of 560 mm above ground.", "FMVSS 223"), ("b", 0, "S2", "A force may act on it in any way that is possible.", "FMVSS 224"), ("c", 0, "S3", "The braking distance is measured from the start.", "UN R13")]
    chunks = spark.createDataFrame(chunks, "doc_id string, chunk_ord int, heading string, text string, code_text string")
    found = retrieve.search(q, chunks)
    by = {(r.q_id, r["rank"]): r.doc_id for r in found.collect()}
    assert by == {(1, 1): "a", (2, 1): "c"}
    rows = found.join(chunks.select("doc_id", "heading", "text", F.col("code_text").alias("code")), "doc_id").withColumns({"page": F.lit("1-2"), "fallback": F.lit(False)})
    text = {r.q_id: r for r in retrieve.answer_text(q, rows).collect()}
    sentence = "The guard shall resist a force of 50 kN at point P1."
    assert text[1].kind == "value" and text[1].answer.startswith(f"直接答案：相关数值为 50 kN。\n依据：FMVSS 223，S1，位置 1-2。\n原文片段：{sentence}")
    assert text[2].kind == "hint" and "未检索到带尺寸(mm/cm/m)的明确数值" in text[2].answer


def test_answer_kinds(spark):
    q = [(1, "总结这份法规"), (2, "what about the mirrors of it"), (3, "mirrors"), (4, "nothing at all"), (5, "which colour has the frame")]
    q = spark.createDataFrame(q, "q_id int, question string")
    long = "The scope of this is every vehicle of the kind " + "that is described here " * 20 + "."
    rows = [
        (1, 1, "UN R1", "Scope", "1", long, True), (1, 2, "UN R1", "Short", "2", "tiny  text", True),
        (2, 1, "UN R46", "Mirrors", "3", "Mirrors are fitted on both sides of it. Mirrors have 300 mm of height.", False),
        (2, 2, "UN R46", "Other", "4", "Mirrors are fitted on both sides of it. Other mirrors may be of 5 kg and 7 m.", False),
        (3, 1, "UN R46", "Mirrors", "3", "no words here are like it but many", True), (5, 1, "GB 1", "Frame", "9", "The frame has a colour that is grey.", False),
    ]
    found = spark.createDataFrame(rows, "q_id int, rank int, code string, heading string, page string, text string, fallback boolean")
    got = {r.q_id: (r.kind, r.answer) for r in retrieve.answer_text(q, found).collect()}
    assert {i: k for i, (k, _) in got.items()} == {1: "summary", 2: "value", 3: "no_value", 4: "nothing", 5: "sentence"}
    cut = long[:-1].strip() + "."
    assert got[1][1].split("\n") == [X.FALLBACK_PREFIX, X.SUMMARY_HEAD, f"- Scope，位置 1: {' '.join(long.split())[:240]}...", "- Short，位置 2: tiny text", X.SUMMARY_TAIL] and cut
    assert got[3][1] == f"{X.FALLBACK_PREFIX}\n没有抽取到明确数值。最相关依据是 UN R46，Mirrors，位置 3：no words here are like it but many"
    assert got[4][1] == X.NOTHING_FOUND and got[5][1] == "直接答案：The frame has a colour that is grey.\n依据：GB 1，Frame，位置 9。\n原文片段：The frame has a colour that is grey."
    assert "（数值：5 kg, 7 m）" in got[2][1] or "直接答案：相关数值为 5 kg, 7 m。" in got[2][1]
    assert got[2][1].count("原文片段") == 1


def test_routes(spark):
    text = "The braking distance of the vehicle shall be at most 50 m in every test that is made. It has a scope."
    chunks = spark.createDataFrame([(d, i, f"H{i}", f"{text} {i}", f"GB {d}") for d in (1, 2) for i in range(12)], "doc_id long, chunk_ord int, heading string, text string, code_text string")
    q = [("a", "braking distance", 1), ("b", "总结", 2), ("c", "zzz of pdf", 1), ("d", "zzz yyy", 2), ("e", "braking", 3), ("f", "", 1)]
    got = retrieve.routed(spark.createDataFrame(q, "q_id string, question string, doc_id long"), chunks).collect()
    routes = {r.q_id: (r.route, r.fallback, r.doc_id) for r in got}
    assert routes == {"a": ("search", False, 1), "b": ("summary", False, 2), "c": ("search", False, 1) if routes["c"][0] == "search" else ("overview", False, 1), "d": ("fallback", True, 2), "f": ("fallback", True, 1)}
    assert all(sorted(r["rank"] for r in got if r.q_id == i) == list(range(1, 9)) for i in routes)


def test_hits_are_the_first_eight_distinct(spark):
    many = " ".join(f"The force of part {i} is {i} kN and {i} kN again today." for i in range(1, 12))
    rows = spark.createDataFrame([(1, many), (2, ""), (3, None), (4, "No number stands in this sentence."), (5, "The width is 5 mm here and 5 MM there, speed 7 km/h as well.")], "id int, text string")
    got = {}
    for r in sorted(compare.parameter_hits(rows, "id").collect()):
        got.setdefault(r.id, []).append((r.hit_ord, r.value, r.label))
    assert [h[:2] for h in got[1]] == [(i, f"{i} kN") for i in range(1, 9)]
    assert got[5] == [(1, "5 mm", "尺寸/距离"), (2, "7 km/h", "速度")] and set(got) == {1, 5}


def test_excerpts_of_clause_chunks(spark):
    long = "The load shall be applied. " * 90
    found = spark.createDataFrame([("d", 1, "H", long), ("d", 2, "S", "short one"), ("d", 3, "P", "A text of more than forty characters without any of them.")], "doc_id string, clause_ord int, heading string, text string")
    got = {(r.clause_ord, r.part): r.text for r in segment.clause_chunks(found).collect()}
    assert got[1, 0] == long.strip()[:1400] + "..." and len(got) > 2 and all(len(t) <= 1403 for t in got.values())
    assert {k for k in got if k[0] != 1} == {(3, 0)} and sum(t == got[1, 0] for t in got.values()) == 1


def test_summaries_take_few_of_one_heading(spark):
    rows = [("d", i, "Same" if i < 7 else f"H{i}", "The scope of this shall be as it is written. " * 4) for i in range(12)]
    got = retrieve.summaries(spark.createDataFrame(rows, "doc_id string, chunk_ord int, heading string, text string"), 6).orderBy("rank").collect()
    assert len(got) == 6 and sum(r.chunk_ord < 7 for r in got) == 3


def test_chosen_pages(spark):
    page = lambda doc, n, text, source: (doc, n, text, source)
    original = spark.createDataFrame([page("scan", 1, "", "pypdf"), page("scan", 2, "x" * 60, "pypdf"), page("worse", 1, "y" * 30, "pypdf"), page("good", 1, "z" * 900, "pypdf"), page("null", 1, None, "pypdf")], PAGES)
    ocr = spark.createDataFrame([page("scan", 1, "read " * 20, "ocr"), page("scan", 2, "X" * 80, "ocr"), page("worse", 1, "y" * 30, "ocr"), page("good", 1, "z" * 950, "ocr"), page("broken", 1, "only here", "ocr")], PAGES)
    got = {(r.doc_id, r.page): (r.text_source, (r.text or "")[:1]) for r in segment.chosen_pages(original, ocr).collect()}
    assert got == {("scan", 1): ("ocr", "r"), ("scan", 2): ("pypdf", "x"), ("worse", 1): ("pypdf", "y"), ("good", 1): ("pypdf", "z"), ("null", 1): ("pypdf", ""), ("broken", 1): ("ocr", "o")}
    assert segment.chosen_pages(original.limit(0), ocr.limit(0)).count() == 0


def test_readable(spark):
    rows = spark.createDataFrame([("a", 1, " \n"), ("a", 2, "word"), ("b", 1, "  "), ("c", 1, None)], "doc_id string, page int, text string")
    assert {(r.doc_id, r.page) for r in segment.readable(rows).collect()} == {("a", 1), ("a", 2)}


def test_markup_chunks(spark):
    long = " ".join(f"S7.{i} {'requirement ' * 40}" for i in range(6)).strip()
    docs = [
        ("two", "C1", f"<R><P>S1. Scope</P><P>{'short block of text ' * 6}</P><P>S7. Tests</P><P>As follows: {long}</P></R>"),
        ("bare", "C2", f"<R><P>S1. Scope</P><B>{'plain words ' * 12}</B></R>"),
        ("none", "C3", "<R/>"), ("null", "C4", None),
    ]
    got = [tuple(r) for r in segment.markup_chunks(spark.createDataFrame(docs, "doc_id string, code string, text string")).orderBy("doc_id", "chunk_ord").collect()]
    assert [g[:4] for g in got if g[0] == "bare"] == [("bare", 0, "C2 chunk 1", "CFR XML")]
    two = [g for g in got if g[0] == "two"]
    assert [g[2] for g in two] == ["S1. Scope", *[f"S7. Tests / part {i}" for i in range(1, len(two))]] and len(two) > 2
    assert {g[0] for g in got} == {"two", "bare"} and all(len(g[4]) <= 1403 for g in got)


def _manifest(spark):
    rows = [("a", 1, "brakes", "eu", "R1", "a", "copied", "a.pdf"), ("b", 2, "brakes", "us", "R2", "b", "exists", "b.XML"), ("c", 3, "brakes", "us", "R3", "c", "missing", "c.pdf"), ("d", 4, "lights", "us", "R4", "d", "copied", "d.pdf"), ("e", 5, "brakes", "eu", "R5", "e", "copied", "e.txt")]
    return spark.createDataFrame(rows, "doc_id string, ord int, domain string, region string, code string, title string, status string, path string")


def _sources(spark):
    body = "5.{0} Force\nThe brake shall hold a force of at least {1} kN on a slope for all vehicles.\n"
    text = "".join(body.format(i, 10 + i) for i in range(1, 4))
    markup = spark.createDataFrame([("b", "<R><P>" + "The brake shall hold a force of at least 99 kN on a slope for all vehicles and trailers. " * 2 + "</P></R>")], "doc_id string, text string")
    return pages(spark, text, doc="a").unionByName(pages(spark, text, doc="d")), markup


def test_search_chunks_of_both_kinds(spark):
    from tessel.operators import category

    found = segment.search_chunks(category.comparable(_manifest(spark)), *_sources(spark)).collect()
    assert {(r.doc_id, r.page, r.extract_method, r.text_coverage) for r in found} == {("a", "1-1", "pypdf", 1.0), ("d", "1-1", "pypdf", 1.0), ("b", "CFR XML", None, None)}
    assert sorted(r.chunk_ord for r in found if r.doc_id == "a") == [0, 1, 2]


def test_category_comparison_and_report(spark, tmp_path):
    import json
    from pathlib import Path

    from tessel.operators import category

    entries = category.comparable(_manifest(spark))
    found = category.category_clauses(entries, *_sources(spark))
    out = category.category_comparisons(entries, found)
    row = out.collect()[0]
    assert out.count() == 1 and (row.left, row.right, row.left_clauses, row.right_clauses) == ("R1", "R2", 3, 1)
    # the plain way: each left clause takes the best right one that is free
    texts = {d: [(r.heading, r.text) for r in found.where(F.col("doc_id") == d).orderBy("clause_ord").collect()] for d in "ab"}
    key = lambda c: re.sub(r"\s+", " ", f"{c[0]}\n{c[1][:1200]}").strip().lower()
    scores = [SequenceMatcher(None, key(texts["b"][0]), key(c), autojunk=False).ratio() for c in texts["a"]]
    matched = any(s >= X.MATCH_FLOOR for s in scores)
    assert row.result_count == (3 if matched else 4) == len(row.top_results) and sum(row.change_type_counts.values()) == row.result_count
    assert [r.result_ord for r in row.top_results] == list(range(1, row.result_count + 1))
    category.write_report(out, str(tmp_path / "r"))
    now = Path(category.write_report(out, str(tmp_path / "r")))
    lines = [x for p in sorted((now / "markdown").glob("part-*")) for x in p.read_text().splitlines()]
    assert [x for x in lines if x.startswith("#")] == [X.REPORT_TITLE, "## brakes", "### R1 vs R2"] and f"results: {row.result_count};" in "\n".join(lines)
    assert [json.loads(x)["left"] for p in (now / "json").glob("part-*") for x in p.read_text().splitlines()] == ["R1"]
    assert category.report(out).collect()[0].report.startswith("## brakes\n\n### R1 vs R2\n\n" + row.headline)


def test_messages(spark):
    questions = spark.createDataFrame([(1, "How wide?"), (2, "None?")], "q_id int, question string")
    found = spark.createDataFrame([(1, 2, "GB 1", "h", "2", "second", True), (1, 1, "GB 1", "h", "1", "first  text", True)], "q_id int, rank int, code string, heading string, page string, text string, fallback boolean")
    got = {r.q_id: r for r in retrieve.messages(questions, found).collect()}
    assert got[1].user == "Question:\nHow wide?\n\nEvidence:\n[1] GB 1 | h | 1\nfirst text\n\n[2] GB 1 | h | 2\nsecond"
    assert f"'{X.FALLBACK_PREFIX}'" in got[1].system and got[2].system == X.SYSTEM_MESSAGE and got[2].user.endswith("Evidence:\n")
