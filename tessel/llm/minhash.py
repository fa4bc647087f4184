"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles.

1. Document frequencies: a shingle's weight is its count times the root of 1 + ln(1 / f), f the share of documents that hold
   it, or FREQUENT where f is less. The root, because a copy's edits are the rarest shingles of all: undamped they outweigh what it
   shares. Only shingles in at least that share of documents need their exact frequency, and there are at most 1 / FREQUENT times the mean number of shingles of a document, however large the
   corpus. A first pass adds occurrences up in hashed buckets; no bucket below the bound can hold such a shingle. A second
   pass counts the shingles of the other buckets exactly.
2. Signatures: consistent weighted samples of each text, in bands; rows of one text have one representative.
3. Candidates: a band bucket is a set of texts. Pivots are compared with the other members of their bucket, and links make
   components. In each round pivots come from outside the largest component of a bucket, more of them each time, until its
   other members are in one component. So a tight group costs one comparison for each member, not one for each pair, and yet
   every pair of a bucket whose ends are in different components has been compared: no link between components is lost.
   Such comparisons run in blocks, and only links come out of them.
4. Each candidate pair is verified by its exact weighted Jaccard similarity.

Between rounds, state is in the shared folder. Texts cross the network once, to the candidates, and then only candidates do.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import forget, mixed, row_shingles, settled, skew_join, table
from .components import connected_components

#: Words of a shingle, and the least weighted Jaccard similarity of a link.
SHINGLE, SIMILAR = 5, 0.8
#: Bands of weighted samples: at 0.8, one of them agrees with a chance of 0.9998.
BANDS, ROWS = 12, 3
#: The share of documents below which shingles all count as equally rare.
FREQUENT = 0.005
#: Buckets of the first pass, and parts in which their counts are added up. Both are fixed, as is the size of the whole vector. A bucket
#: has FREQUENT of the documents by chance alone only where they have 2,600 shingles each; more of them are counted exactly then.
BUCKET_BITS, SLICES = 19, 64
#: Texts of a block in comparisons, and bytes of their shingles; a longer text is a block of its own.
BLOCK, BLOCK_BYTES = 512, 8 << 20
#: Comparisons up to which all of a bucket's members outside its largest component are pivots at once.
AT_ONCE = 1 << 22
_BUCKET_SHIFT = np.uint64(64 - BUCKET_BITS)


def shingles(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingle hashes in order, and how often each occurs."""
    _, _, h, tf = next(row_shingles(pa.array([text]), SHINGLE))
    return h, tf


def _bucket_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, docs, waiting, n = np.zeros(1 << BUCKET_BITS, np.int64), 0, [], 0
    for b in batches:
        docs += b.num_rows
        for _, _, h, _ in row_shingles(b.column(0), SHINGLE):
            waiting.append((h >> _BUCKET_SHIFT).view(np.int64))
            n += len(h)
            if n >= len(total):
                total += np.bincount(np.concatenate(waiting), minlength=len(total))
                waiting, n = [], 0
    if waiting:
        total += np.bincount(np.concatenate(waiting), minlength=len(total))
    parts = [p.tobytes() for p in np.split(total, SLICES)]
    yield pa.RecordBatch.from_arrays([pa.array(range(SLICES), pa.int32()), pa.array([docs] * SLICES, pa.int64()), pa.array(parts, pa.binary())], ["slice", "docs", "counts"])


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    found: dict[int, list] = {}
    for b in batches:
        for k, docs, counts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), b.column(2)):
            of = found.setdefault(k, [0, np.zeros((1 << BUCKET_BITS) // SLICES, np.int64)])
            of[0] += docs
            of[1] += np.frombuffer(counts.as_py(), np.int64)
    yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32()), pa.array([d for d, _ in found.values()], pa.int64()), pa.array([c.tobytes() for _, c in found.values()], pa.binary())], ["slice", "docs", "counts"])


def inverse_frequency(share: np.ndarray) -> np.ndarray:
    return np.sqrt(1.0 - np.log(np.maximum(share, FREQUENT))).astype(np.float32)


def frequent_shingles(docs: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The shingles in at least FREQUENT of all documents, in order, and the exact share of documents that hold each."""
    kind = "slice int, docs long, counts binary"
    rows = docs.select("text").mapInArrow(_bucket_counts, kind).repartition(SLICES, "slice").mapInArrow(_added, kind).collect()  # a vector of fixed size
    n = max((r["docs"] for r in rows), default=0)
    least = max(1, math.ceil(FREQUENT * n))
    full = np.zeros(1 << BUCKET_BITS, bool)
    for r in rows:
        part = np.frombuffer(bytes(r["counts"]), np.int64) >= least
        full[r["slice"] * len(part) : (r["slice"] + 1) * len(part)] = part
    if not full.any():
        return np.zeros(0, np.uint64), np.zeros(0)
    sent = docs.sparkSession.sparkContext.broadcast(full)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            held = [h[sent.value[(h >> _BUCKET_SHIFT).view(np.int64)]] for _, _, h, _ in row_shingles(b.column(0), SHINGLE)]
            h, counts = np.unique(np.concatenate(held) if held else np.zeros(0, np.uint64), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(counts, pa.int64())], ["shingle", "n"])

    exact = docs.select("text").mapInArrow(count, "shingle long, n long").groupBy("shingle").agg(F.sum("n").alias("n")).where(F.col("n") >= least)
    found = sorted((r["shingle"] % (1 << 64), r["n"]) for r in exact.collect())  # 1 / FREQUENT of the mean number of shingles at most
    return np.array([h for h, _ in found], np.uint64), np.array([k for _, k in found]) / max(n, 1)


@dataclass(frozen=True)
class Others:
    """Shingles of several texts, one after another, with what comparisons need of them."""

    h: np.ndarray
    weights: np.ndarray
    starts: np.ndarray
    sizes: np.ndarray
    full: np.ndarray
    total: np.ndarray


class Sampler:
    """Consistent weighted samples: a shingle of weight w is drawn with the same outcome in every text that gives it w.

    For each sample, r and c come from Gamma(2, 1) and beta is uniform, all as functions of the shingle's hash; two tables
    hold 2^16 draws each of r and ln c, read at different bits of the hash.
    """

    def __init__(self, frequent: np.ndarray, shares: np.ndarray, bands: int = BANDS, rows: int = ROWS, seed: int = 11) -> None:
        rng = np.random.default_rng(seed)
        self.bands_rows = bands, rows
        self.frequent = np.append(frequent, np.uint64(0))  # what stands last is never found at another's place
        self.idf = np.append(inverse_frequency(shares), np.float32(0))
        self.rarest = inverse_frequency(np.zeros(1))[0]
        self.factors = rng.integers(1, 2**63, bands * rows, np.uint64) * np.uint64(2) + np.uint64(1)
        self.r = rng.gamma(2.0, 1.0, 1 << 16).astype(np.float32)
        self.inverse_r = np.float32(1) / self.r
        self.ln_c = np.log(rng.gamma(2.0, 1.0, 1 << 16)).astype(np.float32)

    def weights(self, h: np.ndarray, tf: np.ndarray) -> np.ndarray:
        n = len(self.frequent) - 1
        if not n:
            return tf.astype(np.float32) * self.rarest
        at = np.searchsorted(self.frequent[:n], h)
        return tf.astype(np.float32) * np.where((self.frequent[at] == h) & (at < n), self.idf[at], self.rarest)

    def bands(self, h: np.ndarray, tf: np.ndarray, sizes: np.ndarray | None = None) -> np.ndarray:
        """For each text with shingles a row of 64-bit keys, one for each band, each with its band's number in it.

        sizes has the number of shingles of each text, in order; texts without any have no row.
        """
        sizes = np.array([len(h)]) if sizes is None else sizes[sizes > 0]
        n, (bands, rows) = len(sizes), self.bands_rows
        starts, of = np.cumsum(sizes) - sizes, np.repeat(np.arange(n), sizes)
        ln_w = np.log(self.weights(h, tf))
        drawn = np.empty((bands * rows, n), np.uint64)
        for k, factor in enumerate(self.factors if n else ()):
            x = h * factor
            at = (x >> np.uint64(48)).view(np.int64)
            r = self.r.take(at)
            beta = ((x >> np.uint64(16)) & np.uint64(0xFFFF)).astype(np.float32) * np.float32(2.0**-16)
            t = np.floor(ln_w * self.inverse_r.take(at) + beta)
            ln_a = self.ln_c.take(((x >> np.uint64(32)) & np.uint64(0xFFFF)).view(np.int64)) - r * (t - beta + np.float32(1))
            hit = np.flatnonzero(ln_a == np.minimum.reduceat(ln_a, starts).take(of))  # of equal ones, the least hash counts
            values = mixed(h[hit] ^ (t[hit].astype(np.int64).view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
            firsts = np.flatnonzero(np.diff(of[hit], prepend=-1))
            drawn[k] = np.minimum.reduceat(values, firsts)
        key = np.repeat((np.arange(bands, dtype=np.uint64) + np.uint64(1))[None, :], n, axis=0)
        for row in drawn.reshape(bands, rows, n).transpose(1, 2, 0):
            key = mixed((key * np.uint64(0xD6E8FEB86659FD93)) ^ row)
        return key.view(np.int64)

    def beside(self, others: list[tuple[np.ndarray, np.ndarray]]) -> Others:
        sizes = np.array([len(h) for h, _ in others], np.int64)
        full = np.flatnonzero(sizes)
        h = np.concatenate([others[i][0] for i in full]) if len(full) else np.zeros(0, np.uint64)
        tf = np.concatenate([others[i][1] for i in full]) if len(full) else np.zeros(0, np.int64)
        weights = self.weights(h, tf).astype(np.float64)
        starts = np.concatenate([[0], np.cumsum(sizes[full])[:-1]]).astype(np.int64)
        return Others(h, weights, starts, sizes, full, np.add.reduceat(weights, starts) if len(full) else np.zeros(0))

    def similarities(self, mine: tuple[np.ndarray, np.ndarray], others: Others) -> np.ndarray:
        """The weighted Jaccard similarity of one text with each of the others: the sum of the lesser weights by that of the larger."""
        (ha, ta), o = mine, others
        out = np.zeros(len(o.sizes))
        if not len(ha) or not len(o.full):
            return out
        wa = self.weights(ha, ta).astype(np.float64)
        at = np.minimum(np.searchsorted(ha, o.h), len(ha) - 1)
        shared = np.add.reduceat((ha[at] == o.h) * np.minimum(wa[at], o.weights), o.starts)
        out[o.full] = shared / (wa.sum() + o.total - shared)
        return out

    def similarity(self, a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
        return float(self.similarities(a, self.beside([b]))[0])


@dataclass(frozen=True)
class NearDuplicates:
    """classes: (doc_id, class_id); links: verified pairs (u, v) of representatives, u < v, that tie all of a class together."""

    classes: DataFrame
    links: DataFrame


def _signatures(docs: DataFrame, sampler) -> DataFrame:
    """(doc_id, print, bytes, bands): print tells texts apart, bytes is the size of its packed shingles; bands is null where a text has no word."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Sampler = sampler.value
        for b in batches:
            keys, sizes = [np.zeros((0, s.bands_rows[0]), np.int64)], [np.zeros(0, np.int64)]
            for _, n, h, tf in row_shingles(b.column(1), SHINGLE):
                sizes.append(n)
                keys.append(s.bands(h, tf, n))
            none = np.concatenate(sizes) == 0
            ends = np.concatenate([[0], np.cumsum(~none)]) * s.bands_rows[0]
            bands = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(keys).ravel()), mask=pa.array(none))
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array(12 * np.concatenate(sizes)), bands], ["doc_id", "print", "bytes", "bands"])

    return docs.select("doc_id", "text", F.unhex(F.md5("text")).alias("print")).mapInArrow(sign, "doc_id long, print binary, bytes long, bands array<long>")


def _packed_shingles(texts: DataFrame) -> DataFrame:
    """(doc_id, text) -> (doc_id, shingles): hashes and counts of each text, made once for all of its comparisons."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for first, sizes, h, tf in row_shingles(b.column(1), SHINGLE):
                ends = np.cumsum(sizes).tolist()
                made = [h[e - n : e].tobytes() + tf[e - n : e].astype(np.uint32).tobytes() for e, n in zip(ends, sizes.tolist())]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(first, len(made)), pa.array(made, pa.binary())], ["doc_id", "shingles"])

    return texts.select("doc_id", "text").mapInArrow(pack, "doc_id long, shingles binary")


def _unpacked(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(raw) // 12
    return np.frombuffer(raw, np.uint64, n), np.frombuffer(raw, np.uint32, n, 8 * n).astype(np.int64)


def _blocks(texts: Column, size: Column) -> Column:
    return F.greatest(F.ceil(texts / BLOCK), F.ceil(size / BLOCK_BYTES), F.lit(1)).cast("int")


def _links_in_groups(rows: DataFrame, sampler, similar: float) -> DataFrame:
    """(u, v), u < v: links between the pivots and the members of each group of rows(g1, g2, g3, is_pivot, component, doc_id, shingles).

    A link is sought where the components differ, and of those found in a group only such come out as tie components that weren't
    tied yet: no more than it has components, however many pairs are similar. Rows of a group follow each other, pivots first;
    what a task holds of them are the pivots and about BLOCK_BYTES of members.
    """
    group = ["g1", "g2", "g3"]
    rows = rows.repartition(*group).sortWithinPartitions(*group, F.desc("is_pivot"), "doc_id").select(*group, "is_pivot", "component", "doc_id", "shingles")

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s: Sampler = sampler.value
        u, v, now, held = [], [], None, 0
        pivots: list[tuple] = []
        members: list[tuple] = []
        above: dict[int, int] = {}

        def root(c: int) -> int:
            while (up := above.get(c, c)) != c:
                above[c] = c = above.get(up, up)
            return c

        def flush() -> None:
            beside = s.beside([m[2] for m in members])
            ids, components = np.array([m[0] for m in members], np.int64), np.array([m[1] for m in members], np.int64)
            for i, component, x in pivots:
                hit = np.flatnonzero((s.similarities(x, beside) >= similar) & (components != component))
                others, first = np.unique(components[hit], return_index=True)
                for other, at in zip(others.tolist(), hit[first].tolist()):
                    a, b = root(component), root(other)
                    if a != b:
                        above[a] = b
                        u.append(min(i, int(ids[at])))
                        v.append(max(i, int(ids[at])))
            members.clear()

        for b in batches:
            g1, g2, g3, pivot, component, doc = (b.column(k).to_pylist() for k in range(6))
            for k in range(b.num_rows):
                if now != (g1[k], g2[k], g3[k]):
                    if members:
                        flush()
                    now, held = (g1[k], g2[k], g3[k]), 0
                    pivots.clear()
                    above.clear()
                raw = b.column(6)[k].as_py()
                if pivot[k]:
                    pivots.append((doc[k], component[k], _unpacked(raw)))
                elif pivots:
                    members.append((doc[k], component[k], _unpacked(raw)))
                    held += len(raw)
                    if held >= BLOCK_BYTES:
                        flush()
                        held = 0
            if len(u) > 10_000:
                yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])
                u, v = [], []
        if members:
            flush()
        yield pa.RecordBatch.from_arrays([pa.array(u, pa.int64()), pa.array(v, pa.int64())], ["u", "v"])

    return rows.mapInArrow(compare, "u long, v long")


def _links_of_pivots(pairs: DataFrame, packed: DataFrame, sampler, similar: float) -> DataFrame:
    """Of pairs(u, v, size), those that are similar. size is about how many pairs u has: they are dealt out in blocks of its v."""
    members = pairs.select("u", F.pmod(F.xxhash64("v"), _blocks(F.col("size"), F.lit(0))).cast("int").alias("part"), F.lit(False).alias("is_pivot"), F.col("v").alias("doc_id"))
    pivots = members.select("u", "part", F.lit(True).alias("is_pivot"), F.col("u").alias("doc_id")).distinct()
    rows = members.unionByName(pivots).join(packed, "doc_id")
    rows = rows.select(F.col("u").alias("g1"), F.col("part").alias("g2"), F.lit(0).alias("g3"), "is_pivot", F.col("doc_id").alias("component"), "doc_id", "shingles")
    return _links_in_groups(rows, sampler, similar)


def _links_in_buckets(left: DataFrame, packed: DataFrame, sampler, similar: float) -> DataFrame:
    """The links (u, v) between each pivot of left(key, rep, component, is_pivot, m, p) and the members of its bucket in other components.

    A bucket is dealt out as pairs of one of m blocks of members and one of p blocks of pivots, each of about BLOCK texts and
    BLOCK_BYTES, however large it is; only links come out.
    """
    part = lambda n: F.pmod(F.xxhash64("rep"), n).cast("int")
    all_of = lambda n: F.explode(F.sequence(F.lit(0), n - 1))
    members = left.select("key", "rep", "component", F.lit(False).alias("is_pivot"), part(F.col("m")).alias("i"), all_of(F.col("p")).alias("j"))
    pivots = left.where("is_pivot").select("key", "rep", "component", "is_pivot", all_of(F.col("m")).alias("i"), part(F.col("p")).alias("j"))
    dealt = members.unionByName(pivots).join(packed.withColumnRenamed("doc_id", "rep"), "rep")
    dealt = dealt.select(F.col("key").alias("g1"), F.col("i").alias("g2"), F.col("j").alias("g3"), "is_pivot", "component", F.col("rep").alias("doc_id"), "shingles")
    return _links_in_groups(dealt, sampler, similar)


def near_duplicates(docs: DataFrame, similar: float = SIMILAR) -> NearDuplicates:
    """Classes of documents linked by a weighted Jaccard similarity of at least similar over shingles of five words.

    Equal texts are one class (empty ones too); a text without words, or null, is like no other text; a null text is alone. A
    text of fewer than five words is one shingle. class_id is the least doc_id of the class. Rows that share a doc_id are one
    document: they give one row, and their texts are in one class. Rows with a null doc_id have no identity and are left out.
    """
    spark = docs.sparkSession
    docs = docs.where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    sampler = spark.sparkContext.broadcast(Sampler(*frequent_shingles(docs)))  # two tables, and the bounded list of frequent shingles
    signed = settled(_signatures(docs, sampler))
    texts = signed.where(F.col("print").isNotNull()).groupBy("print").agg(F.min("doc_id").alias("rep"))
    members = settled(
        skew_join(signed, texts, "print", "left").select(
            "doc_id", "bytes", F.coalesce("rep", "doc_id").alias("rep"), F.when(F.col("doc_id") == F.col("rep"), F.col("bands")).alias("bands")
        )
    )
    forget(signed)

    # one row for each band of a text, of the buckets with more than one text
    keys = members.where(F.col("bands").isNotNull()).select("rep", "bytes", F.explode("bands").alias("key")).groupBy("rep", "key").agg(F.max("bytes").alias("bytes"))
    shared = keys.groupBy("key").agg(F.count(F.lit(1)).alias("size"), F.min("rep").alias("pivot")).where("size > 1")
    buckets = settled(skew_join(keys, shared, "key").select("key", "rep", "bytes", "pivot", "size"))
    candidates = buckets.select(F.col("rep").alias("doc_id")).distinct().hint("merge")  # the same plan at every size
    compared = settled(_packed_shingles(docs.join(candidates, "doc_id", "left_semi").where(F.col("text").isNotNull())))

    # rows of one doc_id with different texts tie these together
    several = members.groupBy("doc_id").agg(F.min("rep").alias("lo"), F.max("rep").alias("hi")).where("lo < hi").select("doc_id")
    tied = skew_join(members, several, "doc_id", "left_semi").select(F.col("rep").alias("u"), F.col("doc_id").alias("v")).where("u <> v")
    first = buckets.where("rep <> pivot").groupBy(F.col("pivot").alias("u"), F.col("rep").alias("v")).agg(F.max("size").alias("size"))
    links = settled(_links_of_pivots(first, compared, sampler, similar).unionByName(tied).distinct())
    # what a round leaves: members of buckets that weren't pivots yet
    left, pivots, gone = buckets.where("rep <> pivot").select("key", "rep", "bytes"), 32, [buckets]
    while True:
        of = connected_components(links, ready=True)
        placed = left.join(of.withColumnRenamed("node", "rep"), "rep", "left").select("key", "rep", "bytes", F.coalesce("component", "rep").alias("component"))
        parts = placed.groupBy("key", "component").agg(F.count(F.lit(1)).alias("n"), F.sum("bytes").alias("b"))
        tops = parts.groupBy("key").agg(F.max_by("component", F.struct("n", "component")).alias("top"), F.sum("n").alias("n"), (F.sum("n") - F.max("n")).alias("outside"), F.sum("b").alias("b")).where("outside > 0")
        left = settled(skew_join(placed, tops, "key"))
        forget(*gone)
        if left.isEmpty():
            break
        # pivots of this round: all members of a bucket outside its largest component where that is a bounded work, else about `pivots`
        whole = (F.col("outside") <= 2 * pivots) | (F.col("outside") * F.col("n") <= AT_ONCE)
        chance = F.xxhash64("rep", "key", F.lit(pivots)).bitwiseAND(F.lit((1 << 32) - 1)) / float(1 << 32)
        is_pivot = (F.col("component") != F.col("top")) & (whole | (chance < F.lit(float(pivots)) / F.col("outside")))
        few = F.when(whole, F.col("outside")).otherwise(F.lit(2 * pivots))
        marked = left.select("key", "rep", "bytes", "component", is_pivot.alias("is_pivot"), _blocks(F.col("n"), F.col("b")).alias("m"), _blocks(few, F.col("b") / F.col("n") * few).alias("p"))
        more = settled(links.unionByName(_links_in_buckets(marked, compared, sampler, similar)).distinct())
        gone = [left, links]
        links, left = more, marked.where("not is_pivot").select("key", "rep", "bytes")
        pivots *= 32
    classed = members.select("doc_id", "rep").join(of.withColumnRenamed("node", "rep"), "rep", "left")
    classes = settled(classed.groupBy("doc_id").agg(F.min(F.coalesce("component", "rep")).alias("class_id")))
    forget(members, compared, left)
    return NearDuplicates(classes, links)


def keep_one(docs: DataFrame) -> DataFrame:
    """The rows of docs whose document is the least of its class of near-duplicates; rows without an id stay."""
    kept = near_duplicates(docs).classes.where("doc_id = class_id").select(F.col("doc_id").alias("_kept"))
    rows = docs.join(kept, docs.doc_id == kept["_kept"], "left_semi")
    return rows.unionByName(docs.where(docs.doc_id.isNull()))


def op8_minhash(spark, sf_dir: str) -> DataFrame:
    classes = near_duplicates(table(spark, sf_dir, "documents")).classes
    return classes.select("doc_id", "class_id", (F.col("doc_id") == F.col("class_id")).alias("kept"))
