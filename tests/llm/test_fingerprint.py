"""Fingerprints: collision rates against exact similarities, and successors against a plain reading."""

import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import fingerprint as P
from tessel.llm.common import mixed

KIND = "doc_id long, text string, part string, extra int, fingerprint string"


def generalised_jaccard(a, b):
    keys = a.keys() | b.keys()
    return sum(min(a.get(k, 0), b.get(k, 0)) for k in keys) / sum(max(a.get(k, 0), b.get(k, 0)) for k in keys)


@pytest.mark.parametrize("fractional", [False, True])
def test_collision_rate_is_generalised_jaccard(fractional):
    rng, many = np.random.default_rng(2), P.Sampler(8192)
    for size, most in ((3, 2), (30, 4), (300, 9), (200, 1)):
        h = mixed(rng.integers(0, 2**63, size, np.uint64))
        weights = [rng.integers(0, most + 1, size) * (rng.random(size) if fractional else 1) for _ in range(2)]
        weights[1][: size // 2] = weights[0][: size // 2]
        sets = [{k: w for k, w in zip(h.tolist(), ws.tolist()) if w > 0} for ws in weights]
        samples = [many.samples(np.array([*s], np.uint64), np.array([*s.values()])) for s in sets]
        assert abs(float((samples[0] == samples[1]).mean()) - generalised_jaccard(*sets)) < 0.025


def test_draws_have_the_distributions_of_the_method():
    rng = np.random.default_rng(9)
    a, e, rest = (P._exponential(rng.integers(0, 1 << 32, 200_000, np.uint32)) for _ in range(3))
    r = np.log((a + e) / a) + rest
    for gamma in (a + e, r):  # mean and variance of Gamma(2, 1) are 2
        assert abs(gamma.mean() - 2) < 0.02 and abs(gamma.var() - 2) < 0.1
    assert abs((rest / r).mean() - 0.5) < 0.005 and abs((rest / r).var() - 1 / 12) < 0.005 and abs(np.corrcoef(rest / r, r)[0, 1]) < 0.01 and abs(np.corrcoef(a + e, r)[0, 1]) < 0.01


def plain(rows):
    order = sorted(rows, key=lambda r: (r[0] is None, -(r[0] or 0)))
    texts = [r[1] or "" for r in order]
    out = []
    for i, t in enumerate(texts):
        cut, following = len(t) // 3, texts[(i + 1) % len(texts)]
        out.append((order[i][0], len(t), hashlib.sha256((t[: len(t) - cut] + following[:cut]).encode()).hexdigest()))
    return out


@pytest.mark.parametrize("parts", [1, 3, 40])
def test_each_text_is_edited_with_the_next_one(spark, parts):
    rng = random.Random(parts)
    rows = [(i * 7 % 1009, "".join(rng.choices("aé汉😀 \n", k=rng.choice([0, 1, 2, 3, 50, 900]))), None, 1, "x") for i in range(150)]
    rows += [(-5, None, None, None, None), (None, "no id at all", None, None, None), (5000, "word " * 200_000, None, None, None)]
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", parts)
    try:
        got = P.compared_with_successors(spark.createDataFrame(rows, KIND).repartition(5)).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted([(r["doc_id"], r["n_chars"], r["edited_sha256"]) for r in got], key=repr) == sorted(plain(rows), key=repr)


def test_likeness_follows_the_texts(spark):
    rng = random.Random(1)
    a, b = (" ".join(rng.choices("abcdefghijklmnopqrstuvwxyz", k=900)) for _ in range(2))
    rows = [(9, a, None, None, None), (8, a, None, None, None), (7, b, None, None, None), (6, "", None, None, None), (5, " \n", None, None, None)]
    got = {r["doc_id"]: r for r in P.compared_with_successors(spark.createDataFrame(rows, KIND)).collect()}
    assert got[9]["fingerprint"] == got[8]["fingerprint"] and got[9]["near_next"] == 1.0
    assert got[8]["near_next"] < 0.05 and 0.35 < got[8]["near_edited"] < 0.65
    assert got[7]["near_next"] == 0.0 and got[6]["near_next"] == 1.0 and got[6]["fingerprint"] == got[5]["fingerprint"]
    assert 0.5 < got[7]["near_edited"] < 0.8  # the next text is empty: two thirds remain


def test_rows_that_share_an_id_and_single_rows(spark):
    rows = [(3, t, None, None, None) for t in ("x y z", "x y z", "other words", None)] + [(3, "x y z", None, None, None)]
    got = P.compared_with_successors(spark.createDataFrame(rows, KIND)).collect()
    assert sorted(r["n_chars"] for r in got) == [0, 5, 5, 5, 11] and sum(r["near_next"] == 1.0 for r in got) == 2
    single = P.compared_with_successors(spark.createDataFrame([(1, "a b c d e f", None, None, None)], KIND)).collect()
    assert [(r["near_next"], r["edited_sha256"]) for r in single] == [(1.0, hashlib.sha256(("a b c d e f"[:8] + "a b").encode()).hexdigest())]
    assert P.compared_with_successors(spark.createDataFrame([], KIND)).count() == 0


def test_fingerprint_and_likeness_as_columns(spark):
    rng = random.Random(4)
    texts = [" ".join(rng.choices("abcdefgh", k=60)) for _ in range(3)] + [None, "", "one two"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], KIND).withColumn("fp", P.fingerprint(F.col("text")))
    rows = df.select("doc_id", "fp", P.likeness(F.col("fp"), F.lit(df.where("doc_id = 1").first()["fp"])).alias("same")).orderBy("doc_id").collect()
    sampler = P.Sampler()
    import pyarrow as pa

    assert [r["fp"] for r in rows] == [P.written(s) for s in sampler.of_texts(pa.array(texts))]
    assert rows[1]["same"] == 1.0 and all(r["same"] < 1 for r in rows if r["doc_id"] != 1)
    assert rows[3]["fp"] == rows[4]["fp"] == "0" * P.SAMPLES * P.DIGITS
