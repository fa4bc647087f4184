"""Hard negatives against a plain reading, and what early discarding may not lose."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from tessel.llm import mining as M

KIND = "vec_id long, label int, embedding array<float>, cell int, wanted string"


def plain(rows, every):
    usable = {}
    for i, label, x, *_ in rows:
        if i is None or label is None or x is None or any(v is None or not math.isfinite(v) for v in x):
            continue
        r = (label, [float(np.float32(v)) for v in x])
        usable[i] = min(usable.get(i, r), r)
    cut = {i: [math.floor(256 * v) for v in x] for i, (_, x) in usable.items()}
    out = set()
    for a, (label, _) in usable.items():
        if a % every:
            continue
        score = {b: sum(p * q for p, q in zip(cut[a], cut[b])) for b in usable if b != a and len(cut[b]) == len(cut[a])}
        best = sorted(score, key=lambda b: (-score[b], b))
        for p in [b for b in best if usable[b][0] == label][:5]:
            near = [b for b in best if usable[b][0] != label and 80 * score[p] <= 100 * score[b] <= 100 * score[p]]
            out |= {(a, p, k + 1, n, score[p], score[n]) for k, n in enumerate(near[:5])}
    return out


def got(spark, rows, every):
    found = M.hard_negatives(spark.createDataFrame(rows, KIND), F.col("vec_id") % every == 0)
    found = [tuple(r) for r in found.select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score").collect()]
    assert len(found) == len(set(found))
    return set(found)


@pytest.mark.parametrize("few", [False, True])
def test_hard_negatives_are_what_their_definition_says(spark, few, monkeypatch):
    if few:  # many cells
        monkeypatch.setattr(M, "ANCHORS", 5)
        monkeypatch.setattr(M, "ROWS", 60)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 8))
    rows = []
    for i in range(400):
        x = centres[rng.integers(4)] + rng.normal(size=8) * 0.3
        if i % 5 == 0:
            x = np.round(x)  # ties
        rows.append((i, int(rng.choice([0, 0, 0, 1, 2, 3])), [float(v) for v in x / 2], 1, "w"))
    rows += [(1000 + i, i % 2, [0.5, 0.25, -0.5], 1, None) for i in range(30)]  # another length, all alike
    rows += [(2000, 7, [1.0] * 8, None, None), (2010, 8, [0.0] * 8, None, None), (2011, 8, [0.0] * 8, None, None), (2020, 9, [], None, None), (2021, 9, [], None, None), (2022, 3, [], None, None)]
    rows += [(None, 1, [1.0] * 8, 1, None), (3000, None, [1.0] * 8, 1, None), (3010, 1, None, 1, None), (3020, 1, [None] + [1.0] * 7, 1, None), (3030, 1, [math.nan] * 8, 1, None), (3040, 1, [math.inf] * 8, 1, None)]
    rows += [rows[20], rows[30], (40, 3, [0.125] * 8, 1, None)]
    assert got(spark, rows, 10) == plain(rows, 10)


def test_no_rows_and_no_anchors(spark):
    assert got(spark, [], 10) == set()
    assert got(spark, [(1, 0, [1.0], 0, ""), (2, 1, [1.0], 0, "")], 10) == set()
    assert got(spark, [(10, 0, [1.0], 0, ""), (2, 1, [1.0], 0, "")], 10) == set()


def test_survivors_keep_every_pair_within_bounds_and_few_others():
    rng = np.random.default_rng(4)
    spread = np.array([300.0] * 6 + [5.0] * 58)
    x = M.whole(rng.normal(size=(900, 64)) * spread / 256)
    basis = np.linalg.eigh(x.T @ x)[1][:, ::-1]
    turned = M.whole(rng.normal(size=(900, 64)) * spread @ np.linalg.qr(rng.normal(size=(64, 64)))[0] / 256)
    for rows, base in ((x, basis), (x, None), (turned, np.linalg.eigh(turned.T @ turned)[1][:, ::-1])):
        v = M.Vectors.of(np.arange(900), np.zeros(900), rows, base)
        a, b = v.part(slice(0, 100)), v.part(slice(100, 900))
        exact = a.x @ b.x.T
        low, high = np.quantile(exact, 0.99, axis=1), np.quantile(exact, 0.999, axis=1)
        low[0], high[0] = exact[0, 7], exact[0, 7]  # just one value
        i, j = M.survivors(a, b, low, high)
        inside = {*zip(*map(np.ndarray.tolist, np.nonzero((exact >= low[:, None]) & (exact <= high[:, None]))))}
        assert inside <= {*zip(i.tolist(), j.tolist())} and len(i) < 5 * len(inside) + 100
        assert (M.products(a.x[i], b.x[j]) == exact[i, j]).all()


def test_products_beyond_doubles_are_exact_or_an_error():
    a, b = np.array([[2.0**27, 1.0]]), np.array([[2.0**27, 1.0]])
    assert M.products(a, b).tolist() == [2**54 + 1]
    with pytest.raises(OverflowError):
        M.products(a * 4, b)


def test_best_few_in_order_of_score_and_id():
    rng, best, held = random.Random(8), M.Best(3, 4), {k: [] for k in range(3)}
    for _ in range(20):
        rows = [(rng.randrange(3), rng.randrange(6), rng.randrange(10_000)) for _ in range(rng.randrange(1, 9))]
        best.add(*(np.array(c) for c in zip(*rows)))
        for k, s, i in rows:
            held[k] = sorted([*held[k], (-s, i)])[:4]
    for k in range(3):
        assert [(-s, i) for s, i in zip(best.score[k].tolist(), best.id[k].tolist())] == held[k]
