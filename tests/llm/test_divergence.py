"""The divergence audit against a plain reading of its definition, and the sketch that goes before its counts."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from tessel.llm import divergence as D

KIND = "doc_id long, text string, lang string, source string, extra string"


def plain(rows, top=D.TOP_TERMS):
    rows = [[x or "" for x in r[1:4]] for r in rows]
    low = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
    docs = [(re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", t.translate(low)), lang, s) for t, lang, s in rows]
    out = set()
    for lang in {d[1] for d in docs}:
        mine = [d for d in docs if d[1] == lang]
        df = Counter(t for d in mine for t in set(d[0]))
        kept = sorted((t for t in df if df[t] >= 3), key=lambda t: t.encode())
        counts = {s: Counter(t for d in mine if d[2] == s for t in d[0]) for s in {d[2] for d in mine}}
        counts[None] = sum(counts.values(), Counter())

        def p(s, t):
            return 1 + 1_000_000_000 * (counts[s][t] + 1) // (sum(counts[s][k] for k in kept) + len(kept))

        for s in counts.keys() - {None}:
            pair = [(-sum((p(s, t) - p(q, t)) ** 2 // p(q, t) for t in kept), q.encode()) for q in counts.keys() - {None, s}]
            term = [(-((p(s, t) - p(None, t)) ** 2 // p(None, t)), t.encode()) for t in kept if counts[s][t] and p(s, t) > p(None, t)]
            for part, found, most in (("pair", pair, None), ("term", term, top)):
                out |= {(lang, s, part, item.decode(), -v, i + 1) for i, (v, item) in enumerate(sorted(found)[:most])}
    return out


def got(spark, rows, **how):
    found = [tuple(r) for r in D.audit(spark.createDataFrame(rows, KIND), **how).select("lang", "source", "part", "item", "value", "rank").collect()]
    assert len(found) == len(set(found))
    return set(found)


def test_audit_is_what_its_definition_says(spark):
    rng = random.Random(5)
    words = ["the", "The", "THE", "été", "ÉTÉ", "naïve", "x", "a-b", "q2w", "汉字", "rare1", "Zz", "zz"]
    rows = [(i, " ".join(rng.choices(words, range(1, len(words) + 1), k=rng.choice([0, 1, 5, 40]))), rng.choice(["en", "fr", "", None]), rng.choice(["a", "b", "é", None, ""]), "e") for i in range(120)]
    rows += [(None, None, None, None, None), (7, "the the", "en", "a", None), (7, "the the", "en", "a", None), (8, "!?", "xx", "lone", None), (9, None, "xx", "other", None)]
    assert got(spark, rows) == plain(rows)


def test_a_hot_source_a_long_text_and_few_listed_terms(spark):
    rng = random.Random(6)
    words = [f"{chr(97 + i % 26)}{chr(97 + i // 26)}" for i in range(300)]
    rows = [(i, " ".join(rng.choices(words, k=30)), "en", "hot" if i % 3 else f"s{i % 7}", None) for i in range(90)]
    rows += [(1000, "word " * 300_000 + "Last" + "a" * 1_500_000 + " tail", "en", "hot", None), (1001, "word last tail", "en", "s1", None), (1002, "word", "en", "s2", None)]
    assert got(spark, rows, top_terms=5) == plain(rows, 5)


def test_no_terms_and_no_rows(spark):
    rows = [(1, "one", "en", "a", None), (2, "two", "en", "b", None)]
    assert got(spark, rows) == {("en", "a", "pair", "b", 0, 1), ("en", "b", "pair", "a", 0, 1)}
    assert got(spark, []) == set()


def test_extra_columns_do_not_clash(spark):
    rows = [(i, "the cat", "en", "ab"[i % 2], 1, 2, 3, "t") for i in range(6)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, g long, n long, docs long, term string")
    assert D.audit(docs).count() == 2 and {r["value"] for r in D.audit(docs).collect()} == {0}


@pytest.mark.parametrize("size", [10, 3000])
def test_the_sketch_never_underestimates(size, monkeypatch):
    monkeypatch.setattr(D, "WIDTH_BITS", 10)
    rng = np.random.default_rng(size)
    h, n = np.unique(rng.integers(0, 2**63, size, np.uint64)), rng.integers(1, 6, size)
    sketch = D.Sketch(np.zeros((D.DEPTH, 1 << 10), np.uint8))
    for part in range(3):  # as separate tasks and flushes give them
        sketch.add(h, np.where(n > part, 1, 0) if part < 2 else np.maximum(n - 2, 0))
    assert sketch.possible(h)[n >= 3].all()
    if size == 10:
        assert not sketch.possible(h)[n < 3].any()


def test_terms_of_a_text_taken_apart(monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 7)
    for text in ("", " ", "Ab cd", "abcdefghij klm", "a b c d e f g h i j", "ÄÖÜ äöü ß" * 5, "x" * 50, "x" * 50 + " ", "7 days, 8 nights"):
        want = re.findall(rb"[a-z\x80-\xff]+", text.translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).encode())
        assert [t for part in D.term_parts(text.encode()) for t in part] == want
