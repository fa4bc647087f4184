"""One-to-one matches of the clauses of two documents: each left clause in order takes the best right one that is still free.

All right clauses prefer the earliest left one, so proposals in rounds end where taking turns ends: every open left proposes to the
best right that isn't held by an earlier left; a right holds the earliest left that ever proposed to it, and one that loses its right
is open again. A round is a few jobs over all pairs of documents at once, and no row has all choices of a pair.

The best right is found by bounds. Clauses meet in cells of BLOCK left and BLOCK right ones at most. The characters that two texts share bound
their ratio, their longest common subsequence bounds it closely, and the exact ratio is worked out only where neither bound is below
the best found. Equal texts of a cell are compared once. Where all rights of a pair are in one cell, its lefts take turns there: what an earlier left of the cell proposes
to can't be had by a later one.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from difflib import SequenceMatcher
from functools import lru_cache, partial
from heapq import heapify, heappop, heapreplace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed as X
from ..session import forget, settled
from . import cells

#: Left and right clauses of a cell, by texts and by scores; left texts of a cell whose bounds are remembered; bytes of a table of equal places;
#: places of a part that is searched as strings; pairs of texts whose matching characters a worker remembers.
BLOCK, SCORED, REMEMBERED, TABLE, SMALL, KNOWN = 8192, 65536, 64, 1 << 20, 1 << 14, 1 << 14
_PAIR = ["l_doc", "r_doc"]


def common_subsequence(masks: dict[str, int], n: int, other: str) -> int:
    """The length of the longest common subsequence of other and a text of n characters, given as a mask of places for each character."""
    row = full = (1 << n) - 1
    for c in other:
        if hit := row & masks.get(c, 0):
            row = (row + hit) | (row - hit)
    return n - (row & full).bit_count()


def matching_characters(masks: dict[str, int] | None, text: str, other: str) -> int:
    """How many characters the matching blocks of other and text have; masks are the places of text, None where they aren't known yet.

    These are the longest run that both have, of equals the first in other and then in the text, and the same of what lies before and behind it, as
    in SequenceMatcher(None, other, text, autojunk=False). A small part is searched as strings. Of a larger one equal places are one number, a row
    for each character of other; runs of twice a length are those that are followed by another, so the longest is found by a few shifts of it. Where
    that number would be large, the matcher itself finds the run.
    """
    matcher, total, parts = None, 0, [(0, len(other), 0, len(text))]
    while parts:
        start, stop, low, high = parts.pop()
        if (stop - start) * (high - low) <= SMALL:
            total += _in_small(other[start:stop], text[low:high])
            continue
        masks = places(text) if masks is None else masks
        width = (high - low) // 8 + 1  # bytes of a row, in which a last bit is free
        if (stop - start) * width > TABLE:
            matcher = matcher or SequenceMatcher(None, other, text, autojunk=False)
            i, j, size = matcher.find_longest_match(start, stop, low, high)
        else:
            i, j, size = _longest_run({c: masks.get(c, 0) >> low & (1 << high - low) - 1 for c in set(other[start:stop])}, width, other[start:stop])
            i, j = start + i, low + j
        if not size:
            continue
        total += size
        parts += [p for p in ((start, i, low, j), (i + size, stop, j + size, high)) if p[0] < p[1] and p[2] < p[3]]
    return total


def _in_small(other: str, text: str) -> int:
    """matching_characters of short texts."""
    total, parts = 0, [(other, text)]
    while parts:
        a, b = parts.pop()
        at = size = i = 0
        n = min(len(a), len(b))
        while (end := i + size) < len(a) and size < n:
            if a[i : end + 1] in b:  # only a longer run than the one before
                at, size = i, size + 1
            else:
                i += 1
        if size:
            total, j = total + size, b.index(a[at : at + size])
            parts += [p for p in ((a[:at], b[:j]), (a[at + size :], b[j + size :])) if p[0] and p[1]]
    return total


def _longest_run(masks: dict[str, int], width: int, other: str) -> tuple[int, int, int]:
    """(place in other, place in the text, length) of the longest run, the first of equals, from masks that leave the last bit of width bytes free."""
    row = {c: mask.to_bytes(width, "little") for c, mask in masks.items()}
    runs, size, step = [int.from_bytes(b"".join([row[c] for c in other]), "little")], 1, 8 * width + 1
    while more := runs[-1] & runs[-1] >> size * step:
        runs.append(more)
        size *= 2
    if not (longest := runs.pop()):
        return 0, 0, 0
    while runs:
        shorter = runs.pop()
        if more := longest & shorter >> size * step:
            longest, size = more, size + (1 << len(runs))
    return *divmod((longest & -longest).bit_length() - 1, 8 * width), size


def places(text: str) -> dict[str, int]:
    """A mask of places for each character."""
    masks: dict[str, int] = {}
    for i, c in enumerate(text):
        masks[c] = masks.get(c, 0) | 1 << i
    return masks


@lru_cache(KNOWN)
def _matching(text: str, other: str) -> int:
    """matching_characters of texts that may come again in other pairs of documents, as what all documents of a kind say does."""
    return matching_characters(None, text, other)


_NEVER = np.iinfo(np.int64).max


def _held(held: list[int | None]) -> np.ndarray:
    return np.array([_NEVER if h is None else h for h in held], np.int64)


class Rights:
    """The right clauses of a cell. Each distinct text stands for the first of its clauses that no earlier left holds; lefts come in order."""

    def __init__(self, ords: list[int], keys: list[str], held: list[int | None]) -> None:
        self.ords, self.keys, self.held = np.array(ords, np.int64), keys, _held(held)
        members: dict[str, list[int]] = {}
        for i in np.argsort(self.ords, kind="stable").tolist():
            members.setdefault(keys[i], []).append(i)
        self.texts, self.members = list(members), [*map(np.array, members.values())]
        self.at = np.zeros(len(self.texts), np.int64)  # of each text, the first of its members that may be free
        self.place = np.array([m[0] for m in self.members], np.int64)
        self.column = {c: i for i, c in enumerate(sorted({c for k in self.texts for c in k}))}
        self.counts = np.zeros((len(self.texts), len(self.column)), np.int32)
        for row, k in zip(self.counts, self.texts):
            np.add.at(row, [self.column[c] for c in k], 1)
        self.lengths = np.array([len(k) for k in self.texts], np.int64)
        self.open = np.ones(len(self.texts), bool)
        self.known: dict[str, tuple] = {}
        self.verified = 0

    def _bounds(self, left: str) -> tuple:
        """The left's masks, the sum of lengths, and of each text a bound and how close it is (0 characters, 1 subsequence, 2 exact)."""
        if left not in self.known:
            counts, masks = np.zeros(len(self.column), np.int32), places(left)
            for c, mask in masks.items():
                if c in self.column:
                    counts[self.column[c]] = mask.bit_count()
            total = self.lengths + len(left)
            bound = np.where(total == 0, 1.0, 2.0 * np.minimum(self.counts, counts).sum(1) / np.maximum(total, 1))
            if len(self.known) >= REMEMBERED:
                del self.known[next(iter(self.known))]
            self.known[left] = masks, total, bound, np.zeros(len(bound), np.int8)
        return self.known[left]

    def best(self, left_ord: int, left: str, floor: float) -> tuple[float, int] | None:
        """(score, place) of the right with the highest ratio of those that no earlier left holds, the first of equals."""
        for u in np.flatnonzero(self.open & (self.held[self.place] <= left_ord)).tolist():
            free = np.flatnonzero(self.held[self.members[u][self.at[u] :]] > left_ord)
            self.open[u] = len(free) > 0
            if len(free):
                self.at[u] += free[0]
                self.place[u] = self.members[u][self.at[u]]
        masks, total, bound, close = self._bounds(left)
        first = self.ords[self.place]
        at = np.flatnonzero(self.open & (bound >= floor))
        # the highest bound is made closer until it is exact: no text is looked at whose bound is below the best ratio
        waiting = list(zip((-bound[at]).tolist(), first[at].tolist(), at.tolist()))
        heapify(waiting)
        while waiting:
            worse, n, u = waiting[0]
            if close[u] == 2:
                return -worse, int(self.place[u])
            if close[u] == 0 and total[u]:
                bound[u], close[u] = 2.0 * common_subsequence(masks, len(left), self.texts[u]) / total[u], 1
            else:
                self.verified += 1
                bound[u], close[u] = 2.0 * _matching(left, self.texts[u]) / total[u] if total[u] else 1.0, 2
            if bound[u] >= floor:
                heapreplace(waiting, (-float(bound[u]), n, u))
            else:
                heappop(waiting)
        return None


class Scores:
    """The right clauses of a cell by a function of places: score(left, rights)."""

    def __init__(self, score: Callable[[int, np.ndarray], np.ndarray], ords: list[int], keys: list, held: list[int | None]) -> None:
        order = np.argsort(np.array(ords, np.int64), kind="stable")
        self.score, self.ords, self.held = score, np.array(ords, np.int64)[order], _held(held)[order]

    def best(self, left_ord: int, left: None, floor: float) -> tuple[float, int] | None:
        if (self.held <= left_ord).mean() > 0.2:  # later lefts can't have these either
            free = self.held > left_ord
            self.ords, self.held = self.ords[free], self.held[free]
        scores = np.where(self.held > left_ord, self.score(left_ord, self.ords), -np.inf)
        if not len(scores) or scores[i := int(scores.argmax())] < floor:
            return None
        return float(scores[i]), i


def _cell(lefts: list[tuple], rights: list[tuple], alone: bool, floor: float, made: Callable) -> Iterator[tuple[int, int, float]]:
    """(l_ord, r_ord, score) that the lefts of a cell propose; alone tells that it has all rights of its pair."""
    found = made(*map(list, zip(*rights)))
    for l_ord, key, _ in sorted(lefts, key=lambda x: x[0]):
        if (best := found.best(l_ord, key, floor)) is not None:
            score, i = best
            if alone:
                found.held[i] = l_ord
            yield l_ord, int(found.ords[i]), score


def proposals(lefts: DataFrame, rights: DataFrame, floor: float, made: Callable = Rights) -> DataFrame:
    """(l_doc, r_doc, l_ord, r_ord, score): the best right for each of lefts(l_doc, r_doc, l_ord, l_block, key) among rights(l_doc, r_doc, r_ord, r_block, key, held).

    made: Rights of texts, or what has their best, ords and held, made from the ords, keys and held of a cell.
    """
    l_blocks = lefts.select(*_PAIR, "l_block").distinct()
    r_blocks = rights.select(*_PAIR, "r_block").distinct()
    r_blocks = r_blocks.withColumn("alone", F.count(F.lit(1)).over(Window.partitionBy(*_PAIR)) == 1)
    cell = [*_PAIR, "l_block", "r_block"]
    left = lefts.join(r_blocks, _PAIR).select(*cell, F.lit(True).alias("left"), F.col("l_ord").cast("long").alias("ord"), "key", F.lit(None).cast("long").alias("held"), "alone")
    right = rights.join(l_blocks, _PAIR).select(*cell, F.lit(False).alias("left"), F.col("r_ord").cast("long").alias("ord"), "key", F.col("held").cast("long").alias("held"), F.lit(None).cast("boolean").alias("alone"))
    rows = cells.spread(left.unionByName(right), *cell).sortWithinPartitions(*cell)  # small rows, much work
    kind = ", ".join(f"{c} {lefts.schema[c].dataType.simpleString()}" for c in _PAIR) + ", l_ord int, r_ord int, score double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, names, lefts, rights, alone = None, [], [], [], False
        out: list[tuple] = []

        def close() -> None:
            if lefts and rights:
                out.extend((*names, *p) for p in _cell(lefts, rights, alone, floor, made))

        for b in batches:
            types = [b.schema.field(c).type for c in _PAIR]
            for *here, l_block, r_block, is_left, n, key, held, whole in zip(*(c.to_pylist() for c in b.columns)):
                if (*here, l_block, r_block) != now:
                    close()
                    now, names, lefts, rights = (*here, l_block, r_block), here, [], []
                if is_left:
                    lefts.append((n, key, None))
                    alone = whole
                else:
                    rights.append((n, key, held))
            if out:
                yield _batch(out, types)
                out = []
        if now is not None:
            close()
        if out:
            yield _batch(out, types)

    def _batch(rows: list[tuple], types: list[pa.DataType]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), [*types, pa.int32(), pa.int32(), pa.float64()])], [*_PAIR, "l_ord", "r_ord", "score"])

    found = rows.mapInArrow(run, kind)
    best = found.groupBy(*_PAIR, "l_ord").agg(F.min(F.struct((-F.col("score")).alias("worse"), "r_ord")).alias("b"))
    return best.select(*_PAIR, "l_ord", "b.r_ord", (-F.col("b.worse")).alias("score"))


def in_rounds(propose: Callable[[DataFrame | None, DataFrame | None], DataFrame]) -> DataFrame:
    """(l_doc, r_doc, l_ord, r_ord, score) where no left is open any more.

    propose gets the open lefts(l_doc, r_doc, l_ord), None for all, and the held rights(l_doc, r_doc, r_ord, l_ord, score), None for none, and
    gives one proposal for each open left that still finds a right.
    """
    held = lost = None
    while True:
        new = settled(propose(lost, held))
        contenders = new if held is None else held.unionByName(new)
        won = contenders.groupBy(*_PAIR, "r_ord").agg(F.min(F.struct("l_ord", "score")).alias("w"))
        won = settled(won.select(*_PAIR, "w.l_ord", "r_ord", "w.score"))
        open_lefts = settled(contenders.select(*_PAIR, "l_ord").join(won, [*_PAIR, "l_ord"], "left_anti"))
        forget(new, *[x for x in (held, lost) if x is not None])
        held, lost = won, open_lefts
        if lost.isEmpty():
            forget(lost)
            return held


def assigned(scored: DataFrame) -> DataFrame:
    """One-to-one matches of scored(l_doc, r_doc, l_ord, r_ord, score): each left in order takes the best right that is still free, the first of equals."""
    scored = scored.select(*_PAIR, F.col("l_ord").cast("int").alias("l_ord"), F.col("r_ord").cast("int").alias("r_ord"), "score")

    def propose(lost: DataFrame | None, held: DataFrame | None) -> DataFrame:
        rows = scored if lost is None else scored.join(lost, [*_PAIR, "l_ord"], "left_semi")
        if held is not None:
            by = held.select(*_PAIR, "r_ord", F.col("l_ord").alias("by"))
            rows = rows.join(by, [*_PAIR, "r_ord"], "left").where(F.col("by").isNull() | (F.col("by") > F.col("l_ord")))
        best = rows.groupBy(*_PAIR, "l_ord").agg(F.min(F.struct((-F.col("score")).alias("worse"), "r_ord")).alias("b"))
        return best.select(*_PAIR, "l_ord", "b.r_ord", (-F.col("b.worse")).alias("score"))

    return in_rounds(propose)


def best_matches(pairs: DataFrame, keys: DataFrame, floor: float = X.MATCH_FLOOR) -> DataFrame:
    """The same for pairs(l_doc, r_doc) of documents and keys(doc_id, clause_ord, key), by the matching-blocks ratio of keys."""
    both = pairs.select(*_PAIR).distinct()
    block = F.floor((F.row_number().over(Window.partitionBy("doc_id").orderBy("clause_ord")) - 1) / BLOCK).cast("int")
    placed = keys.select("doc_id", F.col("clause_ord").cast("int").alias("ord"), F.coalesce("key", F.lit("")).alias("key"), block.alias("block"))
    side = lambda s: both.join(placed.select(F.col("doc_id").alias(f"{s}_doc"), F.col("ord").alias(f"{s}_ord"), F.col("block").alias(f"{s}_block"), "key"), f"{s}_doc")
    return _in_turns(side("l"), side("r"), floor, Rights)


def assigned_by(lefts: DataFrame, rights: DataFrame, score: Callable[[int, np.ndarray], np.ndarray], floor: float = X.MATCH_FLOOR) -> DataFrame:
    """The same for lefts(l_doc, r_doc, l_ord) and rights(l_doc, r_doc, r_ord) by score(l_ord, r_ords), which is worked out within cells:
    no row is made for a pair of clauses."""

    def side(rows: DataFrame, s: str) -> DataFrame:
        block = F.floor((F.row_number().over(Window.partitionBy(*_PAIR).orderBy(f"{s}_ord")) - 1) / SCORED).cast("int")
        return rows.select(*_PAIR, F.col(f"{s}_ord").cast("int").alias(f"{s}_ord"), block.alias(f"{s}_block"), F.lit(None).cast("string").alias("key"))

    return _in_turns(side(lefts, "l"), side(rights, "r"), floor, partial(Scores, score))


def _in_turns(lefts: DataFrame, rights: DataFrame, floor: float, made: Callable) -> DataFrame:
    def propose(lost: DataFrame | None, held: DataFrame | None) -> DataFrame:
        if lost is None:
            return proposals(lefts, rights.withColumn("held", F.lit(None).cast("long")), floor, made)
        by = held.select(*_PAIR, "r_ord", F.col("l_ord").alias("held"))
        there = rights.join(lost.select(*_PAIR).distinct(), _PAIR, "left_semi").join(by, [*_PAIR, "r_ord"], "left")
        return proposals(lefts.join(lost, [*_PAIR, "l_ord"], "left_semi"), there, floor, made)

    return in_rounds(propose)
