"""Near-duplicates of embeddings by spherical-cap filters of structured random product codes.

A filter is the cap of all vectors whose cosine with its direction reaches a bound. A product code gives WORDS ** PARTS
directions: the coordinates are dealt out among PARTS, each part has random codewords, and a direction is one codeword of each. Which
directions a vector reaches is decoded part by part; a choice goes on only if the best codewords of the other parts could still lift it
over the bound. Several independent codes are used, behind one random rotation.

With more vectors caps get smaller, so that a filter holds about HELD of them, and codewords and codes more. The chance that two vectors at an
angle share a filter of one code is measured on random pairs, which makes it a function of dimensions, bounds and angle alone; the
number of codes follows, so that two vectors at the angle of a link meet with a chance of LINK_RECALL. A ball of several vectors has wider
caps: it meets what its members may link with, at the angle of a link and its radius more, with one of RECALL. Vectors that share
a filter are compared in double precision; a pair that shares several counts in the first of them.

Tight balls come first: vectors whose best product code (a code of each of BLOCKS parts of the space) is the same are held
against a few anchors of it, and those within RADIUS of one are its ball. All of a ball are linked to each other by the triangle inequality on the sphere, and two balls are often
wholly linked, or wholly apart, by their centres alone. So a group of copies counts once in the filters, however large, and
its links are counted without being made. Comparisons run in blocks; of the balls that are wholly linked, a block gives out
only a count for each ball and a star for each set that hangs together, not the pairs. Only pairs of balls that their centres
leave open are compared member by member, in blocks of bounded size.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settled, skew_join, table
from .components import connected_components

SIMILAR = 0.9
#: Of filters: the parts of a product code, and how many codewords each may have. More balls take smaller caps and more codewords.
PARTS, WORDS = 2, (16, 32, 64, 128, 256, 512, 1024, 2048)
#: Vectors that a filter should hold, and the narrowest caps that few vectors get.
HELD, LEAST_CAP = 64, 0.3
#: Of balls: parts and codewords of the one code by which near vectors meet.
BLOCKS, BALL_CODES = 4, 24
#: The least chance that two balls which may hold a link share a filter, that of two vectors at a link's angle, and the most codes.
RECALL, LINK_RECALL, MOST_CODES = 0.995, 0.9995, 128
#: Random pairs of vectors that measure the chance of sharing a filter: so many for each of so many codes.
TRIALS, TRIAL_CODES = 256, 24
#: Degrees around an anchor within which vectors are one ball, and anchors of a filter. Twice RADIUS is far below the link's angle.
RADIUS, ANCHORS = 6.0, 8
#: Members of a block in comparisons.
BLOCK = 512
#: Slack in radians, above the rounding of angles; pairs of balls within it of a bound are compared member by member.
_EPS = 1e-6


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.linalg.norm(x, axis=1, keepdims=True)


class BallCode:
    """BALL_CODES random unit vectors for each of BLOCKS parts of the dimensions, fixed by the seed."""

    def __init__(self, dims: int, seed: int = 5) -> None:
        rng = np.random.default_rng(seed)
        self.parts = np.array_split(np.arange(dims), min(BLOCKS, dims))
        self.codes = [_unit(rng.normal(size=(BALL_CODES, len(p)))) / math.sqrt(len(self.parts)) for p in self.parts]

    def _scores(self, x: np.ndarray) -> list[np.ndarray]:
        return [x[:, p] @ c.T for p, c in zip(self.parts, self.codes)]

    def best(self, x: np.ndarray) -> np.ndarray:
        key = np.zeros(len(x), np.int64)
        for s in self._scores(x):
            key = key * BALL_CODES + s.argmax(axis=1)
        return key


def reach(cap: float, dims: int) -> float:
    """The share of the sphere whose cosine with a direction is at least cap."""
    t = np.linspace(-1.0, 1.0, 20_001)[1:-1]
    density = (1 - t * t) ** ((dims - 3) / 2)
    return float(density[t >= cap].sum() / density.sum())


class ProductCode:
    """words random codewords for each of PARTS sets of coordinates, fixed by the seed."""

    def __init__(self, dims: int, seed: int, words: int) -> None:
        rng = np.random.default_rng([17, seed])
        self.size = words
        self.parts = np.array_split(rng.permutation(dims), PARTS)
        self.words = [_unit(rng.normal(size=(words, len(p)))).T / math.sqrt(PARTS) for p in self.parts]

    def decode(self, x: np.ndarray, cap: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, direction) for all directions of the code that rows of x reach; cap has the bound of each row."""
        scores = [x[:, p] @ w for p, w in zip(self.parts, self.words)]
        best = np.array([s.max(axis=1) for s in scores])
        rows, total, found = np.arange(len(x)), np.zeros(len(x)), np.zeros(len(x), np.int64)
        for k, s in enumerate(scores):
            at, word = np.nonzero(total[:, None] + s[rows] >= (cap - best[k + 1 :].sum(axis=0))[rows][:, None])
            total, found, rows = total[at] + s[rows[at], word], found[at] * self.size + word, rows[at]
        return rows, found


def at_angle(rng: np.random.Generator, x: np.ndarray, angle: float) -> np.ndarray:
    """For each unit row of x, a random unit vector at the angle."""
    y = rng.normal(size=x.shape)
    y -= (x * y).sum(axis=1, keepdims=True) * x
    return math.cos(angle) * x + math.sin(angle) * _unit(y)


@lru_cache(maxsize=4096)
def shares_filter(cap: float, other: float, angle: float, dims: int, words: int) -> float:
    """The chance that two vectors at the angle, with bounds cap and other, share a filter of one code, as TRIALS random pairs for each of
    TRIAL_CODES show."""
    rng, hits = np.random.default_rng([23, dims]), 0
    for k in range(TRIAL_CODES):
        code, x = ProductCode(dims, 10_000 + k, words), _unit(rng.normal(size=(TRIALS, dims)))
        sides = ((x, cap), (at_angle(rng, x, angle), other))
        mine, theirs = (r * words**PARTS + f for r, f in (code.decode(y, np.full(len(y), c)) for y, c in sides))
        hits += len(np.unique(np.intersect1d(mine, theirs) // words**PARTS))
    return hits / (TRIALS * TRIAL_CODES)


@dataclass(frozen=True)
class Caps:
    """The filters of count product codes: the cosine with a direction that single vectors must reach, and that balls of several must."""

    dims: int
    cap: float
    wide: float
    count: int
    words: int

    @staticmethod
    def of(dims: int, balls: int, link: float, radius: float) -> Caps:
        """Caps that hold about HELD of the balls each, of as many codes as both recalls take.

        Single vectors need only meet at the angle of a link. A ball's centre may be farther from what its members link with, by its radius:
        it reaches the filters of wider caps, so that only balls pay for their radius.
        """
        space = max(dims, 4)  # zeros added to a vector leave its angles alone
        cap = next((c for c in np.arange(round(100 * LEAST_CAP), 95) / 100 if balls * reach(c, space) <= HELD), 0.94)

        def codes(cap: float, words: int) -> int:
            h = shares_filter(cap, cap, link, space, words)
            return math.ceil(math.log(1 - LINK_RECALL) / math.log1p(-h)) if 0 < h < 1 else (MOST_CODES + 1 if h == 0 else 2)

        while (words := next((w for w in WORDS if codes(cap, w) <= MOST_CODES), None)) is None and cap > 0.02:
            cap = round(cap - 0.02, 2)
        words = words or WORDS[-1]
        count, wide = min(codes(cap, words), MOST_CODES), cap

        def meets(wide: float) -> bool:
            pairs = ((cap, wide, link + radius), (wide, wide, link + 2 * radius))
            return all(1 - (1 - shares_filter(*caps, min(math.pi, a), space, words)) ** count >= RECALL for *caps, a in pairs)

        while wide > -0.9 and not meets(wide):
            wide = round(wide - 0.02, 2)
        return Caps(dims, float(cap), float(wide), count, words)

    def rotation(self) -> np.ndarray:
        space = max(self.dims, 4)
        q, r = np.linalg.qr(np.random.default_rng(29).normal(size=(space, space)))
        return (q * np.sign(np.diag(r)))[: self.dims]

    def decode(self, x: np.ndarray, is_ball: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, filter) for all filters that rows of x reach; filters of all codes are numbered through."""
        x, cap = x @ self.rotation(), np.where(is_ball, self.wide, self.cap)
        found = [(r, k * self.words**PARTS + f) for k in range(self.count) for r, f in [ProductCode(x.shape[1], k, self.words).decode(x, cap)]]
        return np.concatenate([r for r, _ in found]), np.concatenate([f for _, f in found])


def _angles(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(a @ b.T, -1.0, 1.0))


def _matrix(column: pa.Array) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False).astype(np.float64)
    return _unit(flat.reshape(len(column), -1)) if len(column) else flat.reshape(0, 1)


def usable(embedding: Column) -> Column:
    """Neither null, empty nor zero, and all components finite."""
    fine = lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))
    return F.coalesce(F.forall(embedding, fine) & F.exists(embedding, lambda x: x != 0), F.lit(False))


def _keyed(vectors: DataFrame) -> DataFrame:
    def key(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                x = _matrix(b.column(1))
                yield pa.RecordBatch.from_arrays([*b.columns, pa.array(BallCode(x.shape[1]).best(x))], ["vec_id", "v", "top"])

    return vectors.mapInArrow(key, "vec_id long, v array<double>, top long")


def _ball_of(vectors: DataFrame) -> DataFrame:
    """(vec_id, v, ball, angle): ball is an anchor's vec_id, or the vector's own where none is near; angle is to the anchor."""
    keyed = settled(_keyed(vectors))
    salted = keyed.groupBy("top", (F.xxhash64("vec_id") % ANCHORS).alias("salt")).agg(F.min_by(F.struct("vec_id", "v"), F.struct(F.xxhash64("vec_id"), "vec_id")).alias("a"))
    anchors = salted.groupBy("top").agg(F.sort_array(F.collect_list("a")).alias("anchors"))  # 2 * ANCHORS of each at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, x = b.column(0).to_pylist(), _matrix(b.column(1))
            balls, angles = [], []
            for i, near in enumerate(b.column(2)):
                near = near.as_py()
                # an anchor that is itself near an earlier anchor belongs to that one's ball, so balls are led by the first
                y = _unit(np.array([a["v"] for a in near]))
                led = np.tril(_angles(y, y) <= math.radians(RADIUS)).argmax(axis=1) == np.arange(len(near))
                mine = _angles(x[i : i + 1], y)[0]
                mine = np.where(led, mine, np.inf)
                k = int(mine.argmin())
                own = mine[k] > math.radians(RADIUS)
                balls.append(ids[i] if own else near[k]["vec_id"])
                angles.append(0.0 if own or near[k]["vec_id"] == ids[i] else float(mine[k]))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(balls, pa.int64()), pa.array(angles, pa.float64())], ["vec_id", "v", "ball", "angle"])

    return skew_join(keyed, anchors, "top").select("vec_id", "v", "anchors").mapInArrow(assign, "vec_id long, v array<double>, ball long, angle double")


def _stars(p: np.ndarray, q: np.ndarray, n: int) -> np.ndarray:
    """For each of n nodes the least node that the links p[i], q[i] reach from it."""
    least = np.arange(n)
    while len(p):
        before = least.copy()
        low = np.minimum(least[p], least[q])
        np.minimum.at(least, p, low)
        np.minimum.at(least, q, low)
        least = least[least]
        if (least == before).all():
            break
    return least


def _compared_balls(balls: DataFrame, similar: float) -> DataFrame:
    """(kind, a, b, n) over pairs of balls that may hold a link.

    kind 0: n vectors in other balls are linked to all of ball a; several rows of one a add up. kind 1: a and b hang together by
    such links. kind 2: the pair a < b is still open. Filters with many balls are dealt out as pairs of blocks of about BLOCK balls,
    so no task holds more than two blocks. A pair that shares several filters counts in the first of them. The rows of kind 0 and 1
    are bounded by the balls of a block, however many pairs are linked.
    """
    link = math.acos(similar)
    widest = min(math.pi, link + 2 * math.radians(RADIUS))
    dims = balls.select(F.size("v")).first()
    caps = Caps.of(dims[0] if dims else 1, balls.count(), link, math.radians(RADIUS))

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, 1024):
                part = b.slice(at, 1024)
                x = _matrix(part.column(1))
                rows, found = caps.decode(x, part.column(2).to_numpy() > 0)
                order = np.lexsort((found, rows))
                filters = pa.ListArray.from_arrays(pa.array(np.searchsorted(rows[order], np.arange(len(x) + 1)), pa.int32()), pa.array(found[order], pa.int32()))
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(2), part.column(3), pa.array([y.tobytes() for y in x], pa.binary()), filters], ["ball", "radius", "size", "x", "filters"])

    coded = settled(balls.select("ball", "v", "radius", "size").mapInArrow(decode, "ball long, radius double, size long, x binary, filters array<int>"))
    lists = coded.select("ball", F.explode("filters").alias("filter"))
    sizes = lists.groupBy("filter").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    dealt = skew_join(lists, sizes, "filter").withColumn("mine", F.pmod(F.xxhash64("ball"), F.col("n")).cast("int"))
    other = F.explode(F.sequence(F.lit(0), F.col("n") - 1)).alias("other")
    dealt = dealt.select("ball", "filter", "mine", other).select("ball", "filter", "mine", F.least("mine", "other").alias("i"), F.greatest("mine", "other").alias("j"))
    more = dealt.groupBy("filter", "i", "j").agg(F.count(F.lit(1)).alias("here")).where("here > 1").select("filter", "i", "j")
    rows = dealt.join(more, ["filter", "i", "j"], "left_semi").join(coded, "ball").select("filter", "i", "j", "mine", "ball", "radius", "size", "x", "filters")
    rows = rows.repartition("filter", "i", "j").sortWithinPartitions("filter", "i", "j", "ball")

    def compare(here: int, i: int, j: int, parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block = pa.Table.from_batches(parts).combine_chunks()
        ids, mine, radius, size = (block.column(c).to_numpy() for c in ("ball", "mine", "radius", "size"))
        side = np.arange(len(ids))
        left, right = (side, side) if i == j else (side[mine == i], side[mine == j])
        if not len(left) or not len(right):
            return
        x = np.frombuffer(b"".join(block.column("x").to_pylist()), np.float64).reshape(len(ids), -1)
        cosine = np.clip(x[left] @ x[right].T, -1.0, 1.0)
        near = cosine >= (math.cos(widest) - _EPS if radius.any() else similar)
        p, q = np.nonzero(np.triu(near, 1) if i == j else near)
        if not len(p):
            return
        cosine, p, q = cosine[p, q], left[p], right[q]
        both = radius[p] + radius[q]
        angle, single = np.arccos(cosine), both == 0
        linked = np.where(single, cosine >= similar, angle <= link + both + _EPS)
        sure = single | (angle + both <= link - _EPS)
        p, q, sure = p[linked], q[linked], sure[linked]
        # a filter below this one that both reach has the pair
        lists = block.column("filters").combine_chunks()
        values, of = lists.flatten().to_numpy(), np.repeat(side, lists.value_lengths().to_numpy())
        lower = values < here
        names, place = np.unique(values[lower], return_inverse=True)
        bits = np.zeros((len(ids), len(names) // 8 + 1), np.uint8)
        np.bitwise_or.at(bits, (of[lower], place >> 3), (1 << (place & 7)).astype(np.uint8))
        fresh = np.concatenate([~(bits[p[at : at + 16_384]] & bits[q[at : at + 16_384]]).any(axis=1) for at in range(0, len(p), 16_384)] or [np.zeros(0, bool)])
        p, q, sure = p[fresh], q[fresh], sure[fresh]
        opened = np.stack([np.minimum(ids[p[~sure]], ids[q[~sure]]), np.maximum(ids[p[~sure]], ids[q[~sure]])])
        p, q = p[sure], q[sure]
        whole = np.bincount(p, size[q], len(ids)) + np.bincount(q, size[p], len(ids))
        counted, least = np.flatnonzero(whole), _stars(p, q, len(ids))
        tied = np.flatnonzero(least != side)
        kinds = [(0, ids[counted], ids[counted], whole[counted].astype(np.int64)), (1, ids[least[tied]], ids[tied], tied), (2, *opened, opened[0])]
        for kind, a, b, n in kinds:
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), kind, np.int32)), *(pa.array(c, pa.int64()) for c in (a, b, n))], ["kind", "a", "b", "n"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, parts = None, []
        for b in batches:
            keys = np.stack([b.column(c).to_numpy() for c in ("filter", "i", "j")], 1)
            cuts = np.flatnonzero((keys[1:] != keys[:-1]).any(axis=1)) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(keys)]):
                if begin == end:
                    continue
                now = tuple(keys[begin].tolist())
                if now != key and parts:
                    yield from compare(*key, parts)
                    parts = []
                key = now
                parts.append(b.slice(begin, end - begin))
        if parts:
            yield from compare(*key, parts)

    return rows.mapInArrow(run, "kind int, a long, b long, n long")


def _open_links(open_pairs: DataFrame, members: DataFrame, similar: float) -> DataFrame:
    """(a, b, vec_id, n): over pairs of balls that are neither wholly linked nor wholly apart, each member's links in the other."""
    sizes = members.groupBy("ball").agg(F.ceil(F.count(F.lit(1)) / BLOCK).cast("int").alias("n"))
    blocks = skew_join(members, sizes, "ball").groupBy("ball", F.pmod(F.xxhash64("vec_id"), F.col("n")).alias("part")).agg(F.collect_list(F.struct("vec_id", "v")).alias("rows"))
    left = blocks.select(F.col("ball").alias("a"), F.col("rows").alias("x"))
    right = blocks.select(F.col("ball").alias("b"), F.col("rows").alias("y"))
    pairs = open_pairs.select("a", "b").join(left, "a").join(right, "b")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for r in b.to_pylist():
                x, y = (_unit(np.array([m["v"] for m in r[k]])) for k in "xy")
                hit = np.clip(x @ y.T, -1, 1) >= similar
                ids = [m["vec_id"] for k in "xy" for m in r[k]]
                n = np.concatenate([hit.sum(axis=1), hit.sum(axis=0)])
                yield pa.RecordBatch.from_pylist([{"a": r["a"], "b": r["b"], "vec_id": v, "n": int(k)} for v, k in zip(ids, n) if k], pa.schema([("a", pa.int64()), ("b", pa.int64()), ("vec_id", pa.int64()), ("n", pa.int64())]))

    return pairs.select("a", "b", "x", "y").mapInArrow(count, "a long, b long, vec_id long, n long")


def linked_vectors(vectors: DataFrame, similar: float = SIMILAR) -> DataFrame:
    """(vec_id, n_links, component_id) for each row of vectors(vec_id, embedding).

    n_links counts the other vectors at a cosine of at least similar (of 64-bit components); component_id is the least vec_id
    that links reach. Vectors that are null, empty, zero or hold null or non-finite components link with nothing, nor do
    vectors of different lengths with each other. Rows that share a vec_id must hold the same vector; they count as one and give one row.
    Rows without a vec_id are left out.
    """
    rows = vectors.where(F.col("vec_id").isNotNull()).select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("v"))
    rows = rows.groupBy("vec_id").agg(F.max("v").alias("v"))
    good = settled(rows.where(usable(F.col("v"))))
    parts = [_linked(good.where(F.size("v") == d), similar) for (d,) in sorted(good.select(F.size("v")).distinct().collect())]
    found = None
    for p in parts:
        found = p if found is None else found.unionByName(p)
    ids = rows.select("vec_id")
    if found is None:
        return ids.select("vec_id", F.lit(0).cast("long").alias("n_links"), F.col("vec_id").alias("component_id"))
    return ids.join(found, "vec_id", "left").select("vec_id", F.coalesce("n_links", F.lit(0).cast("long")).alias("n_links"), F.coalesce("component_id", "vec_id").alias("component_id"))


def _linked(good: DataFrame, similar: float) -> DataFrame:
    members = settled(_ball_of(good))
    balls = settled(
        members.groupBy("ball").agg(F.count(F.lit(1)).alias("size"), F.max("angle").alias("radius"), F.min("vec_id").alias("least"))
        .join(members.where("ball = vec_id").select("ball", "v"), "ball")
    )
    compared = settled(_compared_balls(balls, similar))
    opened = settled(_open_links(compared.where("kind = 2"), members, similar))
    by_ball = compared.where("kind = 0").groupBy("a").agg(F.sum("n").alias("whole")).withColumnRenamed("a", "ball")
    by_vector = opened.groupBy("vec_id").agg(F.sum("n").alias("more"))
    edges = compared.where("kind = 1").select("a", "b").unionByName(opened.select("a", "b")).distinct()
    of = connected_components(edges.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "ball")
    placed = balls.select("ball", "size", "least").join(of, "ball", "left").withColumn("component", F.coalesce("component", "ball")).join(by_ball, "ball", "left")
    least = placed.groupBy("component").agg(F.min("least").alias("component_id"))
    placed = skew_join(placed, least, "component").select("ball", (F.col("size") - 1 + F.coalesce("whole", F.lit(0))).alias("n"), "component_id")
    counted = skew_join(members.select("vec_id", "ball"), placed, "ball").join(by_vector, "vec_id", "left")
    return counted.select("vec_id", (F.col("n") + F.coalesce("more", F.lit(0))).cast("long").alias("n_links"), "component_id")


def op9_spherical(spark, sf_dir: str) -> DataFrame:
    out = linked_vectors(table(spark, sf_dir, "embeddings"))
    return out.select("vec_id", "n_links", "component_id", (F.col("vec_id") == F.col("component_id")).alias("kept"))
