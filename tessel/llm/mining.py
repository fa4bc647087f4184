"""Hard-negative mining: near rows of another label, found by partial products in a rotated basis.

1. Second moments of all rows give an orthogonal basis (PCA about the origin), which leaves inner products as they are and has
   most of a vector's length in its leading components.
2. Anchors and rows are dealt to cells: a cell has some of the anchors, ANCHORS at most on average, and a share of the rows, and
   streams the rows past its anchors. Positives are sought within a label, then negatives in all rows.
3. In a cell the products of the leading components are summed in steps. What remains is at most the product of the norms of the
   remaining components, plus a slack for rounding. A pair whose bounds can't reach what its anchor still wants goes at once.
4. Survivors are verified by the product of whole numbers. A cell hands on its best few of each anchor, and these are ranked.
The rotation only decides what is discarded early: any orthogonal basis gives the same rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import forget, settled, table

#: Factor of a component before it is cut to a whole number.
SCALE = 256.0
#: Positives of an anchor, negatives of a positive, and the percentages of the positive's score between which a negative's lies.
POSITIVES, NEGATIVES, LOW, HIGH = 5, 5, 80, 100
#: Anchors of a cell on average, and rows that one task streams past them.
ANCHORS, ROWS = 8192, 1 << 22
#: Classes of labels or lengths that are dealt out together.
BUCKETS = 64
#: Lengths of vectors that get a basis of their own, the most frequent ones; others are compared without rotation.
LENGTHS = 16
#: Products at least this large are an error, so that a hundred times a product fits into 64 bits.
TOO_LARGE = 2**56
#: Anchors and rows whose partial products are formed together, and pairs that are verified together.
BLOCK_ANCHORS, BLOCK_ROWS, VERIFIED = 512, 2048, 1 << 16
_NONE = np.iinfo(np.int64).min


def whole(x: np.ndarray) -> np.ndarray:
    """The scaled components, cut down to whole numbers (as doubles)."""
    return np.floor(SCALE * x.astype(np.float64))


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of the rows of a with those of b, which hold whole numbers. From TOO_LARGE on it is an error."""
    if len(a) and np.abs(a).max(initial=0) * np.abs(b).max(initial=0) * max(1, a.shape[1]) >= TOO_LARGE:
        found = [sum(int(x) * int(y) for x, y in zip(p, q)) for p, q in zip(a, b)]
        if any(abs(s) >= TOO_LARGE for s in found):
            raise OverflowError("the inner product of two vectors is too large")
        return np.array(found, np.int64)
    return np.einsum("ij,ij->i", a.astype(np.int64), b.astype(np.int64))


def steps(d: int) -> list[int]:
    """Numbers of leading components after which pairs are discarded."""
    return sorted({max(1, d // 8), max(1, d // 4), max(1, d // 2)}) if d else []


@dataclass
class Vectors:
    """Rows of one length: whole numbers, their rotation, norms, and the norms of what stands behind each step."""

    ids: np.ndarray
    labels: np.ndarray
    x: np.ndarray
    y: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))
    norm: np.ndarray = field(default_factory=lambda: np.zeros(0))
    rest: list[np.ndarray] = field(default_factory=list)

    @classmethod
    def of(cls, ids: np.ndarray, labels: np.ndarray, x: np.ndarray, basis: np.ndarray | None) -> Vectors:
        y = x if basis is None else x @ basis
        return cls(ids, labels, x, y, np.sqrt((x * x).sum(1)), [np.sqrt((y[:, m:] ** 2).sum(1)) for m in steps(x.shape[1])])

    def part(self, at: slice | np.ndarray) -> Vectors:
        return Vectors(self.ids[at], self.labels[at], self.x[at], self.y[at], self.norm[at], [r[at] for r in self.rest])


def survivors(a: Vectors, b: Vectors, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (row of a, row of b) whose product may lie from low to high, which each row of a has. None that does is left out."""
    d = a.x.shape[1]
    slack = 16 * max(d, 4) ** 2 * np.finfo(np.float64).eps
    i = j = part = None
    done = 0
    for k, m in enumerate(steps(d)):
        if i is None:
            part = a.y[:, :m] @ b.y[:, :m].T
            reach = np.outer(a.rest[k], b.rest[k]) + slack * np.outer(a.norm, b.norm)
            i, j = np.nonzero((part + reach >= low[:, None]) & (part - reach <= high[:, None]))
            part = part[i, j]
        else:
            part = part + np.einsum("ij,ij->i", a.y[i, done:m], b.y[j, done:m])
            reach = a.rest[k][i] * b.rest[k][j] + slack * a.norm[i] * b.norm[j]
            kept = np.flatnonzero((part + reach >= low[i]) & (part - reach <= high[i]))
            i, j, part = i[kept], j[kept], part[kept]
        done = m
    if i is None:  # vectors without components
        i, j = np.nonzero(np.ones((len(a.ids), len(b.ids)), bool))
    return i, j


class Best:
    """The best few (score, id) of each of n keys: higher scores first, then smaller ids."""

    def __init__(self, n: int, few: int) -> None:
        self.few = few
        self.score = np.full((n, few), _NONE, np.int64)
        self.id = np.zeros((n, few), np.int64)

    def add(self, key: np.ndarray, score: np.ndarray, ids: np.ndarray) -> None:
        new = np.flatnonzero(score >= self.score[key, -1])
        if not len(new):
            return
        key, score, ids = key[new], score[new], ids[new]
        touched = np.unique(key)
        held_k, held_s, held_i = np.repeat(touched, self.few), self.score[touched].reshape(-1), self.id[touched].reshape(-1)
        there = held_s != _NONE
        k, s, v = np.concatenate([held_k[there], key]), np.concatenate([held_s[there], score]), np.concatenate([held_i[there], ids])
        order = np.lexsort((v, -s, k))
        k, s, v = k[order], s[order], v[order]
        rank = np.arange(len(k)) - np.searchsorted(k, k)
        top = rank < self.few
        self.score[touched] = _NONE
        self.score[k[top], rank[top]], self.id[k[top], rank[top]] = s[top], v[top]


class Positives:
    """The best rows of its own label for each anchor."""

    out = "anchor_id long, positive_id long, positive_score long"

    def __init__(self, anchors: Vectors, wanted: np.ndarray) -> None:
        self.best = Best(len(anchors.ids), POSITIVES)

    @staticmethod
    def key(lengths: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return np.stack([lengths, labels.astype(np.int64)], 1)

    def bounds(self, at: slice) -> tuple[np.ndarray, np.ndarray]:
        fifth = self.best.score[at, -1]
        return np.where(fifth == _NONE, -np.inf, fifth.astype(np.float64)), np.full(len(fifth), np.inf)

    def add(self, anchors: Vectors, rows: Vectors, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
        self.best.add(i, score, rows.ids[j])

    def found(self, anchors: Vectors) -> list[np.ndarray]:
        i, rank = np.nonzero(self.best.score != _NONE)
        return [anchors.ids[i], self.best.id[i, rank], self.best.score[i, rank]]


class Negatives:
    """For each anchor and each of its positives the best rows of other labels with scores in the positive's range."""

    out = "anchor_id long, positive_id long, positive_score long, negative_id long, negative_score long"

    def __init__(self, anchors: Vectors, wanted: np.ndarray) -> None:
        self.id, self.p = wanted[:, :POSITIVES], wanted[:, POSITIVES:]  # a positive that isn't there, or below zero, has no range
        self.best = Best(self.p.size, NEGATIVES)

    @staticmethod
    def key(lengths: np.ndarray, labels: np.ndarray) -> np.ndarray:
        return lengths[:, None]

    def bounds(self, at: slice) -> tuple[np.ndarray, np.ndarray]:
        p, fifth = self.p[at].astype(np.float64), self.best.score[:, -1].reshape(self.p.shape)[at]
        least = np.where(p < 0, np.inf, np.maximum(p * LOW / 100 * (1 - 1e-12), np.where(fifth == _NONE, -np.inf, fifth.astype(np.float64))))
        return least.min(1), np.where(p < 0, -np.inf, p * HIGH / 100 * (1 + 1e-12)).max(1)

    def add(self, anchors: Vectors, rows: Vectors, i: np.ndarray, j: np.ndarray, score: np.ndarray) -> None:
        other = anchors.labels[i] != rows.labels[j]
        i, ids, score = i[other], rows.ids[j][other], score[other]
        for w in range(self.p.shape[1]):
            p = self.p[i, w]
            fits = np.flatnonzero((p >= 0) & (LOW * p <= 100 * score) & (100 * score <= HIGH * p))
            self.best.add(i[fits] * self.p.shape[1] + w, score[fits], ids[fits])

    def found(self, anchors: Vectors) -> list[np.ndarray]:
        k, rank = np.nonzero(self.best.score != _NONE)
        i, w = np.divmod(k, self.p.shape[1])
        return [anchors.ids[i], self.id[i, w], self.p[i, w], self.best.id[k, rank], self.best.score[k, rank]]


class Cell:
    """The anchors of a cell, by what they must share with a row, and what has been found for them."""

    def __init__(self, kind: type, bases: dict[int, np.ndarray]) -> None:
        self.kind, self.bases, self.waiting, self.groups = kind, bases, [], None

    def parts(self, b: pa.RecordBatch) -> Iterator[tuple[tuple, np.ndarray, Vectors]]:
        """(key, rows of the batch, vectors) for each key that has anchors, or for all before there are rows."""
        ids, labels = (b.column(c).to_numpy(zero_copy_only=False) for c in ("vec_id", "label"))
        lengths = b.column("embedding").value_lengths().to_numpy(zero_copy_only=False).astype(np.int64)
        values, starts = b.column("embedding").flatten().to_numpy(zero_copy_only=False), np.concatenate([[0], np.cumsum(lengths)])
        keys, of = np.unique(self.kind.key(lengths, labels), axis=0, return_inverse=True)
        of = of.reshape(-1)
        for n, key in enumerate(map(tuple, keys.tolist())):
            if self.groups is None or key in self.groups:
                at = np.flatnonzero(of == n)
                x = whole(values[starts[at][:, None] + np.arange(key[0])])
                yield key, at, Vectors.of(ids[at], labels[at], x, self.bases.get(key[0]))

    def anchors(self, b: pa.RecordBatch) -> None:
        wanted = b.column("wanted")
        for key, at, v in self.parts(b):
            self.waiting.append((key, v, np.array([wanted[i].as_py() for i in at.tolist()], np.int64).reshape(len(at), -1)))

    def rows(self, b: pa.RecordBatch) -> None:
        if self.groups is None:
            by: dict[tuple, list] = {}
            for key, v, wanted in self.waiting:
                by.setdefault(key, []).append((v, wanted))
            self.groups = {}
            for key, found in by.items():
                v = Vectors.of(*(np.concatenate([getattr(f, c) for f, _ in found]) for c in ("ids", "labels", "x")), self.bases.get(key[0]))
                self.groups[key] = v, self.kind(v, np.concatenate([w for _, w in found]))
            self.waiting = []
        for key, _, rows in self.parts(b):
            anchors, state = self.groups[key]
            begin, size = 0, 64  # few at first, until there are scores to beat
            while begin < len(rows.ids):
                some = rows.part(slice(begin, begin + size))
                for first in range(0, len(anchors.ids), BLOCK_ANCHORS):
                    at = slice(first, first + BLOCK_ANCHORS)
                    mine = anchors.part(at)
                    i, j = survivors(mine, some, *state.bounds(at))
                    others = mine.ids[i] != some.ids[j]
                    i, j = i[others], j[others]
                    for k in range(0, len(i), VERIFIED):
                        p, q = i[k : k + VERIFIED], j[k : k + VERIFIED]
                        state.add(anchors, some, p + first, q, products(mine.x[p], some.x[q]))
                begin, size = begin + size, min(2 * size, BLOCK_ROWS)

    def found(self, kind: str) -> Iterator[pa.RecordBatch]:
        for anchors, state in (self.groups or {}).values():
            columns = state.found(anchors)
            if len(columns[0]):
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], [c.split()[0] for c in kind.split(", ")])


def met(anchors: DataFrame, rows: DataFrame, bucket: Column, kind: type, bases: dict[int, np.ndarray]) -> DataFrame:
    """What kind finds for anchors(vec_id, label, embedding, wanted) among rows(vec_id, label, embedding), from each cell.

    Only rows of one bucket meet. Anchors and rows of a bucket are counted first, and the bucket gets cells by the product.
    """
    bucket = F.pmod(bucket, F.lit(BUCKETS)).cast("int")
    count = lambda df: {r[0]: r[1] for r in df.groupBy(bucket.alias("bucket")).count().collect()}  # noqa: E731  BUCKETS rows at most
    many_a, many_r = count(anchors), count(rows)
    work = {k: many_a[k] * many_r.get(k, 0) for k in many_a}
    tasks = int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    a_parts, r_parts, first = [0] * BUCKETS, [1] * BUCKETS, [0] * (BUCKETS + 1)
    for k in range(BUCKETS):
        if work.get(k):
            a_parts[k] = -(-many_a[k] // ANCHORS)
            r_parts[k] = max(-(-tasks * work[k] // (sum(work.values()) * a_parts[k])), -(-many_r[k] // ROWS))
        first[k + 1] = first[k] + a_parts[k] * r_parts[k]
    if not first[-1]:
        return rows.sparkSession.createDataFrame([], kind.out)
    of = lambda numbers: F.get(F.lit(numbers), F.col("_bucket"))
    block = lambda salt, parts: F.pmod(F.xxhash64("vec_id", F.lit(salt)), of(parts)).cast("int")
    each = lambda parts: F.explode(F.when(of(parts) > 0, F.sequence(F.lit(0), of(parts) - 1)))
    cell = lambda a, r: of(first) + a * of(r_parts) + r
    some = anchors.withColumn("_bucket", bucket).where(of(a_parts) > 0).withColumn("_r", each(r_parts))
    left = some.select(cell(block(1, a_parts), F.col("_r")).alias("cell"), F.lit(False).alias("row"), "vec_id", "label", "embedding", "wanted")
    all_rows = rows.withColumn("_bucket", bucket).withColumn("_a", each(a_parts))
    right = all_rows.select(cell(F.col("_a"), block(2, r_parts)).alias("cell"), F.lit(True).alias("row"), "vec_id", "label", "embedding", F.lit(None).cast("array<long>").alias("wanted"))
    dealt = left.unionByName(right).repartitionById(first[-1], "cell").sortWithinPartitions("cell", "row")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, cell = None, None
        for b in batches:
            cells, is_row = b.column("cell").to_numpy(), b.column("row").to_numpy(zero_copy_only=False)
            cuts = np.flatnonzero((cells[1:] != cells[:-1]) | (is_row[1:] != is_row[:-1])) + 1
            for begin, end in zip([0, *cuts.tolist()], [*cuts.tolist(), len(cells)]):
                if begin == end:
                    continue
                if cells[begin] != now:
                    if cell is not None:
                        yield from cell.found(kind.out)
                    now, cell = cells[begin], Cell(kind, bases)
                (cell.rows if is_row[begin] else cell.anchors)(b.slice(begin, end - begin))
        if cell is not None:
            yield from cell.found(kind.out)

    return dealt.mapInArrow(run, kind.out)


def principal_bases(rows: DataFrame) -> dict[int, np.ndarray]:
    """For each of the LENGTHS most frequent lengths the eigenvectors of the second moments, largest first, in columns."""
    size = F.size("embedding")
    lengths = {r[0] for r in rows.groupBy(size.alias("d")).count().orderBy(F.desc("count"), "d").limit(LENGTHS).collect() if r[0]}

    def moments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums = {d: np.zeros((d, d)) for d in lengths}
        for b in batches:
            sizes, values = b.column(0).value_lengths().to_numpy(zero_copy_only=False).astype(np.int64), b.column(0).flatten().to_numpy(zero_copy_only=False)
            starts = np.cumsum(sizes) - sizes
            for d in lengths.intersection(sizes.tolist()):
                x = whole(values[starts[sizes == d][:, None] + np.arange(d)])
                sums[d] += x.T @ x
        for d, found in sums.items():
            yield pa.RecordBatch.from_arrays([pa.array(np.full(d * d, d, np.int32)), pa.array(np.arange(d * d, dtype=np.int64)), pa.array(found.reshape(-1))], ["d", "at", "moment"])

    found = rows.select("embedding").mapInArrow(moments, "d int, at long, moment double").groupBy("d", "at").agg(F.sum("moment").alias("moment"))
    whole_moments: dict[int, np.ndarray] = {d: np.zeros(d * d) for d in lengths}
    for r in found.collect():  # the square of a length, for LENGTHS lengths at most
        whole_moments[r["d"]][r["at"]] = r["moment"]
    bases = {}
    for d, flat in whole_moments.items():
        m = flat.reshape(d, d)
        if np.isfinite(m).all():  # else without rotation
            bases[d] = np.linalg.eigh((m + m.T) / 2)[1][:, ::-1].copy()
    return bases


def hard_negatives(rows: DataFrame, anchor: Column) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) for the rows for which anchor holds.

    rows(vec_id, label, embedding): those with a null in one of them, or a component that is null or not finite, take no part. Of
    rows that share a vec_id the one with the smallest label, then vector, takes part. Vectors of different lengths never meet. Ties
    in score go by the smaller vec_id, and so do repeated vectors under several ids. An anchor that is alone with its label has no positives
    and no rows; neither has an empty table. Other columns are not read. A product of 2^56 or more is an error.
    """
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    plain = rows.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("label").cast("long").alias("label"), "embedding", anchor.alias("is_anchor"))
    plain = plain.where(F.col("vec_id").isNotNull() & F.col("label").isNotNull() & F.col("embedding").isNotNull()).where(fine)
    one = settled(plain.groupBy("vec_id").agg(F.min(F.struct("label", "embedding", "is_anchor")).alias("r")).select("vec_id", "r.*"))
    bases = principal_bases(one)
    rows, anchors = one.drop("is_anchor"), one.where("is_anchor").drop("is_anchor")
    nothing = F.array().cast("array<long>")
    near = met(anchors.withColumn("wanted", nothing), rows, F.xxhash64(F.size("embedding"), "label"), Positives, bases)
    rank = F.row_number().over(Window.partitionBy("anchor_id").orderBy(F.desc("positive_score"), "positive_id")).alias("rank")
    best = settled(near.select("*", rank).where(F.col("rank") <= POSITIVES))
    few = lambda c, none: F.transform(F.sequence(F.lit(1), F.lit(POSITIVES)), lambda k: F.coalesce(F.get(F.filter("p", lambda p: p["rank"] == k), F.lit(0))[c], F.lit(none).cast("long")))
    wanted = best.groupBy("anchor_id").agg(F.collect_list(F.struct("rank", "positive_id", "positive_score")).alias("p")).select(F.col("anchor_id").alias("vec_id"), F.concat(few("positive_id", 0), few("positive_score", -1)).alias("wanted"))
    asking = settled(anchors.join(wanted, "vec_id"))
    found = met(asking, rows, F.xxhash64(F.size("embedding")), Negatives, bases)
    rank = F.row_number().over(Window.partitionBy("anchor_id", "positive_id").orderBy(F.desc("negative_score"), "negative_id")).alias("rank")
    columns = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    out = settled(found.select("*", rank).where(F.col("rank") <= NEGATIVES).select(*columns))
    forget(one, best, asking)
    return out


def op12_hard_negatives(spark, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "embeddings").select("vec_id", F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label")).alias("label"), "embedding")
    return hard_negatives(rows, F.col("vec_id") % 100 == 0)


OP12_SQL = """
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS x
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS other_id, a.label = b.label AS same, list_inner_product(a.x, b.x)::BIGINT AS score
  FROM v a JOIN v b ON a.vec_id % 100 = 0 AND a.vec_id <> b.vec_id AND len(a.x) = len(b.x)
), p AS (
  SELECT anchor_id, other_id AS positive_id, score AS positive_score FROM s WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, other_id) <= 5
)
SELECT anchor_id, positive_id, row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id)::INTEGER AS rank,
       other_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s USING (anchor_id)
WHERE NOT same AND 80 * positive_score <= 100 * score AND 100 * score <= 100 * positive_score
QUALIFY row_number() OVER (PARTITION BY anchor_id, positive_id ORDER BY score DESC, other_id) <= 5
"""
