"""Text functions against their definitions in plain Python."""

import re

import pytest
from pyspark.sql import functions as F

from tessel.functions import text as T


def one(spark, text, f):
    return spark.createDataFrame([(text,)], "t string").select(f(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize("text", ["a b　c", "  x \n\t y ", "", "É  ü", "one"])
def test_compact(spark, text):
    assert one(spark, text, T.compact) == re.sub(r"\s+", " ", text).strip()
    assert one(spark, text, T.normalized) == re.sub(r"\s+", " ", text).strip().lower()


@pytest.mark.parametrize("text", ["a\nb", "a\r\nb\n", "\n\na", "", "a\x85b c", "a\x0bb\x0c"])
def test_lines(spark, text):
    assert one(spark, text, T.lines) == text.splitlines()


def test_quote(spark):
    assert one(spark, "x " * 200, T.quote) == ("x " * 200).strip()[:320] + "..."
    assert one(spark, "short", T.quote) == "short"


@pytest.mark.parametrize(("line", "want"), [("Scope ....... 12", True), ("Scope … … … … … … … … x", True), ("A sentence. Another.", False), ("", False), ("1.2.3.4.5.6.7.8.9 but with a long text behind it that has many letters", False)])
def test_toc(spark, line, want):
    assert one(spark, line, T.is_toc) is want


@pytest.mark.parametrize(("text", "want"), [("30 % of", []), ("5%x", ["5%"]), ("80 dB(A)", ["80 dB"]), ("at least 50 in", ["50"]), ("shall be 20 mm", ["20", "20 mm"])])
def test_requirement_numbers(spark, text, want):
    assert sorted(one(spark, text, T.requirement_numbers)) == want


def test_codes(spark):
    assert one(spark, "See FMVSS 0123, UN R13, 49 CFR 571.223, GB/T 12676 and R100", T.regulation_codes) == ["FMVSS123", "FMVSS223", "GB12676", "UNR100", "UNR13"]


def test_tokens(spark):
    assert one(spark, "Brake-test P1/P2 a 12.5kN", T.tokens) == ["brake-test", "p1/p2", "12.5kn"]
    got = one(spark, "高压 and 电池", T.tokens)
    assert got[:3] == ["高压", "and", "电池"] and got[-3:] == ["高压", "压电", "电池"] and "voltage" in got


def test_sentences(spark):
    text = "This is the first sentence. Short. This is the second long sentence! And here is a third one?"
    got = one(spark, text, T.sentences)
    assert len(got) == 2 * 3 - 1 and got[3] == got[0] + " " + got[1]
    assert one(spark, "", T.sentences) == []


@pytest.mark.parametrize(("sentence", "unit", "want"), [("x", "kN", "载荷/力"), ("stopping within", "m", "距离"), ("width", "mm", "尺寸/距离"), ("the force", "kg", "载荷/力"), ("x", "kg", "其他数值"), ("x", "%", "比例/百分比")])
def test_labels(spark, sentence, unit, want):
    row = spark.createDataFrame([(sentence, unit)], "s string, u string").select(T.label_of(F.col("s"), F.col("u")).alias("x")).first()
    assert row.x == want


@pytest.mark.parametrize(("question", "want"), [("What temperature?", "temperature"), ("I know", "force"), ("the barrier", "pressure"), ("hello", ""), ("角度", "angle")])
def test_intents(spark, question, want):
    assert one(spark, question, T.intent_of) == want


def test_paths_and_addresses(spark):
    rows = [("/a/b/c", "/a/b", True, "c"), ("/a/bc", "/a/b", False, "/a/bc"), ("/a/b/../c", "/a/b", False, "/a/b/../c"), ("a\\b\\c", "a", True, "b/c"), ("/a/b/", "/a/./b/", True, "."), ("/../a", "/", True, "a"), (None, "/a", None, None)]
    df = spark.createDataFrame([r[:2] for r in rows], "path string, root string")
    got = df.select(T.is_under(F.col("path"), F.col("root")).alias("under"), T.shown_path(F.col("path"), F.col("root")).alias("shown")).collect()
    assert [tuple(r) for r in got] == [r[2:] for r in rows]
    assert spark.range(1).select(T.normalized_email(F.lit(" A@B.C\n"))).first()[0] == "a@b.c"


def test_patterns_of_ascii_find_the_same(spark):
    """Texts of ASCII take shorter patterns; with a character of another script behind them they take the patterns as they are."""
    import random

    rng = random.Random(8)
    words = ["12", "1,234.5", "3000000", "-4", "+5", " ", "\n", "  ", "mm", "km/h", "K", "degrees C", "degree", "minus", "at least", "shall be", "%", "dB(A)", "dB", "C", "GB/T", "ISO 9001", "UN R13", ". The", "\x0b", "\x1c", ".....", "x_1", "ohm/V", "s", "?"]
    texts = ["".join(rng.choices(words, k=rng.randrange(1, 14))) for _ in range(1500)]
    t, wide = F.col("t"), F.concat("t", F.lit(" 。"))
    from tessel.operators import compare

    fs = [T.answer_numbers, T.requirement_numbers, T.references, T.sentences, T.compact, T.stripped]
    ascii_, other = ([f(c).cast("string").alias(f"f{i}") for i, f in enumerate(fs)] for c in (t, wide))
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, t string")
    assert T.of_ascii(T.X.ANSWER_NUMBERS[1]) != T.X.ANSWER_NUMBERS[1]
    for a, b in zip(df.select("i", *ascii_[:3]).orderBy("i").collect(), df.select("i", *other[:3]).orderBy("i").collect()):
        assert a == b, texts[a.i]
    plain = [r.asDict() for r in df.select("i", T.compact(t).alias("c"), T.stripped(t).alias("s"), F.trim(F.regexp_replace("t", r"(?U)\s+", " ")).alias("c0"), F.regexp_replace("t", r"(?U)^\s+|\s+$", "").alias("s0")).collect()]
    assert all(r["c"] == r["c0"] and r["s"] == r["s0"] for r in plain)
    hits = lambda c: {(r.i, r.hit_ord, r.label, r.value, r.unit) for r in compare.parameter_hits(df.select("i", c.alias("text")), "i").collect()}
    long = F.concat(F.lit("measured "), F.regexp_replace("t", r"[.?\n]", ","))
    assert hits(F.concat(long, F.lit(" and so on"))) == hits(F.concat(long, F.lit(" and so 。n")))
