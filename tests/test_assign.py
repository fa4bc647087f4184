"""Matches in rounds against taking turns, and bounds that lose nothing."""

import random
from difflib import SequenceMatcher

import pytest

from tessel.operators import assign


def turns(score, lefts, rights, floor):
    """Each left takes the best right that is free, the first of equals."""
    used, out = set(), set()
    for i in sorted(lefts):
        free = [(-score[i, j], j) for j in sorted(rights) if j not in used and score.get((i, j), -1) >= floor]
        if free:
            worse, j = min(free)
            used.add(j)
            out.add((i, j, -worse))
    return out


@pytest.mark.parametrize("ties", [3, 1000])
def test_rounds_end_where_turns_end(spark, ties):
    rng = random.Random(ties)
    rows = [(p, "r", i, j, rng.randrange(ties) / ties) for p in "abc" for i in range(14) for j in range(12) if rng.random() < 0.7]
    got = assign.assigned(spark.createDataFrame(rows, "l_doc string, r_doc string, l_ord int, r_ord int, score double")).collect()
    for p in "abc":
        want = turns({(i, j): s for q, _, i, j, s in rows if q == p}, range(14), range(12), 0)
        assert {(r.l_ord, r.r_ord, r.score) for r in got if r.l_doc == p} == want


def texts(rng, n):
    words = ["brake", "force", "shall", "hold", "load", "5 mm", "a", "test of"]
    return [" ".join(rng.choices(words, k=rng.randrange(7))) for _ in range(n)]


@pytest.mark.parametrize("block", [4, 256])
def test_best_matches_are_those_of_comparing_all(spark, block, monkeypatch):
    monkeypatch.setattr(assign, "BLOCK", block)
    rng = random.Random(2)
    docs = {"a": texts(rng, 18), "b": texts(rng, 15), "c": texts(rng, 3), "d": []}
    docs["b"][:4] = docs["a"][3:7]
    keys = [(d, 10 * n + 1, t, "x") for d, ts in docs.items() for n, t in enumerate(ts)] + [("c", 99, None, "x")]
    pairs = [("a", "b"), ("b", "a"), ("a", "c"), ("a", "d"), ("d", "b"), ("a", "b")]
    got = assign.best_matches(spark.createDataFrame(pairs, "l_doc string, r_doc string"), spark.createDataFrame(keys, "doc_id string, clause_ord int, key string, held string")).collect()
    assert len(got) == len(set(got))
    of = {d: {n: t or "" for e, n, t, _ in keys if e == d} for d in docs}
    for left, right in set(pairs):
        score = {(i, j): SequenceMatcher(None, y, x, autojunk=False).ratio() for i, x in of[left].items() for j, y in of[right].items()}
        assert {(r.l_ord, r.r_ord, r.score) for r in got if (r.l_doc, r.r_doc) == (left, right)} == turns(score, of[left], of[right], 0.32)


def test_common_subsequence_bounds_the_ratio():
    rng = random.Random(3)
    for _ in range(300):
        a, b = ("".join(rng.choices("abc汉", k=rng.randrange(25))) for _ in range(2))
        masks = {}
        for i, c in enumerate(a):
            masks[c] = masks.get(c, 0) | 1 << i
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        got = assign.common_subsequence(masks, len(a), b)
        assert got == table[-1][-1] and sum(m.size for m in SequenceMatcher(None, b, a, autojunk=False).get_matching_blocks()) <= got


def test_few_ratios_are_worked_out():
    rng = random.Random(4)
    lefts = [f"The part {rng.randrange(99)} of class GB {rng.randrange(2000)} shall be at least {rng.randrange(60)} mm and not exceeding {rng.randrange(90)} kN." for _ in range(40)]
    rights = assign.Rights(list(range(40)), [x.replace("shall be", "is") for x in rng.sample(lefts, 40)], [None] * 40)
    for i, x in enumerate(lefts):
        score, j = rights.best(i, x, 0.32)
        assert (score, -j) == max((SequenceMatcher(None, y, x, autojunk=False).ratio(), -n) for n, y in enumerate(rights.keys))
    assert rights.verified < 40 * 40 / 3


@pytest.mark.parametrize("block", [5, 65536])
def test_scores_of_cells_end_where_turns_end(spark, block, monkeypatch):
    monkeypatch.setattr(assign, "SCORED", block)
    score = lambda l, r: (l * 7919 + r * 104729) % 97 % 5 / 5.0  # noqa: E731, E741
    lefts, rights = [(p, "r", i) for p in "ab" for i in range(3, 20)], [(p, "r", j) for p in "ab" for j in range(14)]
    got = assign.assigned_by(spark.createDataFrame(lefts, "l_doc string, r_doc string, l_ord int"), spark.createDataFrame(rights, "l_doc string, r_doc string, r_ord int"), score, 0.32).collect()
    want = turns({(i, j): score(i, j) for i in range(3, 20) for j in range(14)}, range(3, 20), range(14), 0.32)
    for p in "ab":
        assert {(r.l_ord, r.r_ord, r.score) for r in got if r.l_doc == p} == want


def test_equal_texts_are_compared_once():
    """Copies, each of which was compared with all others before."""
    rights = assign.Rights(list(range(600)), [f"the part shall be {i % 6} mm wide" for i in range(600)], [None] * 600)
    taken = []
    for i in range(600):
        score, j = rights.best(i, f"the part shall be {i % 5} mm wide", 0.32)
        rights.held[j] = i
        taken.append(j)
    assert sorted(taken) == list(range(600)) and taken[:5] == [0, 1, 2, 3, 4] and rights.verified <= 30
