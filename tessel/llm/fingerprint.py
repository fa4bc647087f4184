"""Document fingerprints by consistent weighted sampling: the share of samples that two fingerprints have in common estimates the
generalised Jaccard similarity of their texts, sum of min / sum of max over weighted terms.

A term is a window of five words, its weight its count. For each sample a term of weight w draws r and c from Gamma(2, 1) and beta
from the unit interval, all of them functions of its hash alone, takes t = floor(ln w / r + beta), and the term with the least
c * exp(r * (beta - t - 1)) is the sample, together with its t.

Gamma(2, 1) is the sum of two exponentials, and these may be drawn in any order. Here a, the value of a term of weight one, comes
first (it is exponential), from a hash that orders as a does; c = a + e, r = ln(c / a) + e', beta = e' / r with two more
exponentials e and e'. So texts whose terms occur once need nothing but the least hash of each sample, and for any other
weight the value is a * exp(-r * t).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import mixed, row_shingles, table

#: Words of a term, samples of a fingerprint, and hexadecimal digits of a sample.
WORDS, SAMPLES, DIGITS = 5, 128, 4
#: Terms whose hashes are formed together, and those of other weights than one.
TERMS, WEIGHTED = 4096, 512
_ALL = np.uint64(1 << 32)


def _exponential(bits: np.ndarray) -> np.ndarray:
    """An exponential draw for each number of 32 bits, growing with it."""
    return -np.log1p(-(bits.astype(np.float64) + 0.5) / float(_ALL))


class Sampler:
    def __init__(self, samples: int = SAMPLES, seed: int = 17) -> None:
        rng = np.random.default_rng(seed)
        self.factors = rng.integers(0, 1 << 31, samples, np.uint32) * np.uint32(2) + np.uint32(1)
        self.offsets = rng.integers(0, 1 << 32, samples, np.uint32)
        self.seeds = rng.integers(0, 1 << 63, samples, np.uint64)

    def _order(self, h: np.ndarray) -> np.ndarray:
        """A number of 32 bits for each term and sample; with weight one the smaller number has the smaller value."""
        return (h >> np.uint64(32)).astype(np.uint32)[:, None] * self.factors + self.offsets

    def samples(self, h: np.ndarray, weights: np.ndarray) -> np.ndarray:
        """The samples of a text with these term hashes and weights, as numbers of 16 bits; 0 is kept for texts without terms."""
        if not len(h):
            return np.zeros(len(self.factors), np.uint16)
        least = np.full(len(self.factors), np.uint32(0xFFFFFFFF))
        t = np.zeros(len(least), np.int64)
        once = weights == 1
        single, value = h[once], np.full(len(least), np.inf)
        if len(single):
            for at in range(0, len(single), TERMS):
                np.minimum(least, self._order(single[at : at + TERMS]).min(axis=0), out=least)
            value = np.log(_exponential(least))
        others, ln_w, column = h[~once], np.log(weights[~once].astype(np.float64)), np.arange(len(least))
        for at in range(0, len(others), WEIGHTED):
            part = others[at : at + WEIGHTED]
            order = self._order(part)
            bits = mixed(part[:, None] ^ self.seeds)
            a = _exponential(order)
            e = _exponential(bits & np.uint64(0xFFFFFFFF))
            rest = _exponential(bits >> np.uint64(32))
            r = np.log((a + e) / a) + rest
            steps = np.floor(ln_w[at : at + WEIGHTED, None] / r + rest / r)
            found = np.log(a) - r * steps
            best = found.min(axis=0)
            tied = np.where(found == best, order, np.uint32(0xFFFFFFFF)).argmin(axis=0)
            better = (best < value) | ((best == value) & (order[tied, column] < least))
            value = np.where(better, best, value)
            least = np.where(better, order[tied, column], least)
            t = np.where(better, steps[tied, column].astype(np.int64), t)
        code = mixed(least.astype(np.uint64) ^ (t.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
        return ((code >> np.uint64(32)) % np.uint64(0xFFFF) + np.uint64(1)).astype(np.uint16)

    def of_texts(self, texts: pa.Array) -> list[np.ndarray]:
        """The samples of each text, whole; a null has none."""
        out: list[np.ndarray] = []
        for _, sizes, h, tf in row_shingles(texts, WORDS):
            ends = np.cumsum(sizes)
            out += [self.samples(h[b - n : b], tf[b - n : b]) for b, n in zip(ends.tolist(), sizes.tolist())]
        return out


def written(samples: np.ndarray) -> str:
    return samples.astype(">u2").tobytes().hex()


def fingerprint(text: Column) -> Column:
    """The fingerprint of a column of texts. Null and texts without words have the one of no terms, all zeros."""

    def each(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        sampler = Sampler()
        for texts in batches:
            yield pa.array([written(s) for s in sampler.of_texts(texts.cast(pa.large_string()))], pa.string())

    return F.arrow_udf(each, "string")(text)


def likeness(a: Column, b: Column) -> Column:
    """The share of samples that two fingerprints have in common: an estimate of the generalised Jaccard similarity of the texts."""
    same = F.filter(F.sequence(F.lit(0), F.lit(SAMPLES - 1)), lambda k: F.substr(a, k * DIGITS + 1, F.lit(DIGITS)) == F.substr(b, k * DIGITS + 1, F.lit(DIGITS)))
    return F.size(same) / F.lit(SAMPLES)


_LAST = (1 << 63) - 1


def with_successor(docs: DataFrame) -> DataFrame:
    """docs(doc_id, text), dealt and sorted so that each row's successor by descending doc_id follows it in its task.

    Columns part, extra, doc_id, text: rows of one part follow each other, and the last of a part is an extra row, the successor of
    the row before it; the first of all rows succeeds the last one. Texts are shuffled once. Where parts begin is found from ids
    and hashes alone, by a range partitioning as even as Spark's sampling makes it, of as many parts as there are shuffle partitions.
    """
    spark = docs.sparkSession
    order = F.coalesce(F.bitwise_not(F.col("doc_id").cast("long")), F.lit(_LAST)).alias("order")
    keyed = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text")).select("doc_id", "text", order, F.xxhash64("text").alias("tie"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ranges = keyed.select("order", "tie").repartitionByRange(tasks, "order", "tie")
    firsts = ranges.groupBy(F.spark_partition_id().alias("p")).agg(F.min(F.struct("order", "tie")).alias("k")).select("k.*").collect()  # a row for each part
    firsts = sorted((r["order"], r["tie"]) for r in firsts) or [(0, 0)]
    longs = lambda numbers: F.expr(f"array({','.join(f'{n}L' if n > -(1 << 63) else 'bigint(-9223372036854775808)' for n in numbers)})")
    orders, ties = longs([o for o, _ in firsts]), longs([t for _, t in firsts])

    def halve(s: Column, _: Column) -> Column:
        mid = F.floor((s["lo"] + s["hi"]) / 2).cast("int")
        o = F.get(orders, mid)
        begun = (o < F.col("order")) | ((o == F.col("order")) & (F.get(ties, mid) <= F.col("tie")))
        return F.when(s["lo"] >= s["hi"], s).otherwise(F.struct(F.when(begun, mid + 1).otherwise(s["lo"]).alias("lo"), F.when(begun, s["hi"]).otherwise(mid).alias("hi")))

    whole = F.struct(F.lit(0).alias("lo"), F.lit(len(firsts)).alias("hi"))
    part = F.aggregate(F.sequence(F.lit(0), F.lit(len(firsts).bit_length())), whole, halve)["lo"] - 1
    placed = keyed.withColumn("part", F.greatest(part, F.lit(0)))
    is_first = (F.get(orders, F.col("part")) == F.col("order")) & (F.get(ties, F.col("part")) == F.col("tie"))
    before = F.pmod(F.col("part") - 1, F.lit(len(firsts)))
    places = F.array(F.struct(F.col("part").alias("part"), F.lit(False).alias("extra")), F.when(is_first, F.struct(before.alias("part"), F.lit(True).alias("extra"))))
    dealt = placed.select("doc_id", "text", "order", "tie", F.explode(F.filter(places, lambda p: p.isNotNull())).alias("place"))
    dealt = dealt.select("place.part", "place.extra", "doc_id", "text", "order", "tie").repartitionById(len(firsts), "part")
    return dealt.sortWithinPartitions("part", "extra", "order", "tie").select("part", "extra", "doc_id", "text")


def edited(text: str, following: str) -> str:
    """text, with its last third replaced by as many characters of the beginning of the following one, or all it has."""
    cut = len(text) // 3
    return text[: len(text) - cut] + following[:cut]


def compared_with_successors(docs: DataFrame) -> DataFrame:
    """For each document its fingerprint, that of its text edited with the beginning of the next document's, and how alike they are.

    The next document is the one with the next smaller doc_id; the largest follows the smallest, and a single document follows
    itself. Null ids stand at the end; rows of one id follow each other in the order of a hash of the text, and equal rows are alike. Nulls
    and texts without words count as texts of no terms, which are alike. docs(doc_id, text, ..), other columns aren't read.
    Rows that repeat both id and text stay in one task, which streams them.
    """
    kind = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler, open_row = Sampler(), None
        for b in batches:
            if not b.num_rows:
                continue
            texts = b.column("text")
            rows = list(zip(b.column("part").to_pylist(), b.column("extra").to_pylist(), b.column("doc_id").to_pylist(), texts.to_pylist(), sampler.of_texts(texts)))
            if open_row is not None:
                rows.insert(0, open_row)
            pairs = [(x, y) for x, y in zip(rows, rows[1:]) if not x[1] and x[0] == y[0]]
            open_row = rows[-1]
            changed = [edited(x[3], y[3]) for x, y in pairs]
            signed = sampler.of_texts(pa.array(changed, pa.large_string()))
            out = [
                (x[2], len(x[3]), hashlib.sha256(c.encode()).hexdigest(), written(x[4]), written(s), float((x[4] == s).mean()), float((x[4] == y[4]).mean()))
                for (x, y), c, s in zip(pairs, changed, signed)
            ]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(zip(*out), (pa.int64(), pa.int64(), *[pa.string()] * 3, pa.float64(), pa.float64()))], [c.split()[0] for c in kind.split(", ")])

    return with_successor(docs).mapInArrow(run, kind)


def op11_fingerprint(spark, sf_dir: str) -> DataFrame:
    return compared_with_successors(table(spark, sf_dir, "documents"))
